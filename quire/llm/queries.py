"""The registered queries of this subpackage: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann_tree, exact_dedup, fingerprints, join_maintenance, line_dedup, mixing, ngram_join, prefix_trie, runtime, sentencepiece, token_counts, token_output, toxicity, url_filter

JSON_TOKENIZER, PIECE_MODEL, END_ID = "word_bpe_49k.json", "piece_bpe_32k.model", 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(runtime.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


_WORDS_SQL = "list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0d]+'), lambda w: w <> '')"

#: All pairs that share a shingle, and the closure of their links.
OP1_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM words)
), sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS same FROM shingles GROUP BY doc_id
), classes AS (SELECT same, min(doc_id) AS class_id, any_value(n) AS n FROM sets GROUP BY same
), firsts AS (SELECT s.* FROM shingles s JOIN classes c ON s.doc_id = c.class_id
), pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM firsts a JOIN firsts b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM pairs JOIN classes p ON p.class_id = x JOIN classes q ON q.class_id = y WHERE 100 * both_ >= 80 * (p.n + q.n - both_)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (SELECT class_id, class_id FROM classes UNION SELECT r.x, w.y FROM reach r JOIN ways w ON r.y = w.x
), least_ AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, c.class_id
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN classes c USING (same) LEFT JOIN least_ l ON l.x = c.class_id
"""


def remainder(col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(4))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, runtime.table(spark, sf_dir, "labels"), eligible=remainder() != 2)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(runtime.table(spark, sf_dir, "documents"))


def op4_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.nearest(runtime.table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(runtime.table(spark, sf_dir, "documents"), tokenizer_path(JSON_TOKENIZER))


#: Target shares of the sources, in slots of the cycle; any other source has one.
MIX_WEIGHTS = {f"src{k}": 1 + k % 4 for k in range(20)}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(runtime.table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return out.select("doc_id", "source", "block", "slot", "seq", "on_target")


OP6_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(source, chr(0)) AS its, coalesce(doc_id, -9223372036854775808) AS at_, coalesce(strlen(text), 0) + 1 AS size FROM documents
), sources AS (
  SELECT its, sum(size)::BIGINT AS n,
    (CASE WHEN regexp_full_match(its, 'src(0|1?[1-9]|10)') THEN 1 + CAST(substr(its, 4) AS BIGINT) % 4 ELSE 1 END)::BIGINT AS a
  FROM rows_ GROUP BY its
), ranked AS (SELECT *, row_number() OVER (ORDER BY a = 1, CASE WHEN a = 1 THEN md5(its) END, its) AS k, sum(a) OVER ()::BIGINT AS total FROM sources
), weights AS (SELECT list(a ORDER BY k) AS ws, any_value(total) AS total FROM ranked
), steps(t, used, pick) AS (
  SELECT 0::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT FROM weights
  UNION ALL
  SELECT t + 1, list_transform(used, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, used, list_min(list_transform(ws, lambda a, i: CASE
        WHEN used[i] < a AND (used[i] * total) // a <= t THEN (((used[i] + 1) * total + a - 1) // a) * 100000 + i ELSE 1000000000000000 END)) % 100000 AS p
    FROM steps, weights WHERE t < total)
), cycle_ AS (SELECT t - 1 AS place, pick AS k, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM steps WHERE t > 0
), ends AS (
  SELECT min(((r.n - 1) // {mixing.BLOCK_BYTES} + 1) // r.a * r.total + c.place) AS until
  FROM ranked r JOIN cycle_ c ON c.k = r.k AND c.j = ((r.n - 1) // {mixing.BLOCK_BYTES} + 1) % r.a
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY its ORDER BY at_, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM rows_
)
SELECT p.doc_id, p.source, before // {mixing.BLOCK_BYTES} AS block,
  (before // {mixing.BLOCK_BYTES}) // r.a * r.total + c.place AS slot, before % {mixing.BLOCK_BYTES} AS seq,
  (before // {mixing.BLOCK_BYTES}) // r.a * r.total + c.place < until AS on_target
FROM placed p JOIN ranked r USING (its) JOIN cycle_ c ON c.k = r.k AND c.j = (before // {mixing.BLOCK_BYTES}) % r.a, ends
"""


def captures_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures are the pages, one fetched every 997 seconds over and over in 40 days; lists come from all their hosts and first paths by rules on these."""
    pages = runtime.table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 997, F.lit(40 * 86_400))))
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)/", 1)
    hosts = pages.select(host.alias("pattern")).distinct().withColumn("day", F.length("pattern") % 20)
    days = F.array(*[F.struct(F.lit(x).alias("list"), F.lit(k).alias("kind"), F.lit(a).alias("action"), (F.col("day") + d).alias("day")) for x, k, a, d in HOST_ENTRIES])
    by_host = hosts.filter(F.col("day") % 3 != 0).select("pattern", F.explode(days).alias("e")).select("e.list", "e.kind", "pattern", "e.action", "e.day")
    path = F.regexp_extract("url", "^[a-z]+://([^/]*/[^/?#]*)", 1)
    paths = pages.select(path.alias("pattern")).distinct().filter(F.col("pattern").rlike("/[a-m]"))
    paths = paths.select(F.lit("paths").alias("list"), F.lit("prefix").alias("kind"), "pattern", F.lit("add").alias("action"), F.pmod(F.length("pattern"), F.lit(30)).alias("day"))
    zone = spark.createDataFrame([("zones", "domain", "example.org", "add", 10), ("zones", "domain", "example.org", "remove", 25)], "list string, kind string, pattern string, action string, day int")
    entries = by_host.unionByName(paths).unionByName(zone)
    return captures, entries.withColumn("since", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("day") * 86_400)).drop("day")


#: list, kind, action and days after the host's first, for two thirds of the hosts.
HOST_ENTRIES = (("hosts", "host", "add", 0), ("hosts", "host", "remove", 6), ("hosts", "host", "add", 14), ("malware", "domain", "add", 3))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = captures_and_entries(spark, sf_dir)
    out = url_filter.url_filter(captures, entries)
    return out.select("page_id", "blocked", F.array_join("lists", ",").alias("lists"), "n_active")


OP7_SQL = """
WITH captures AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]*)/', 1) AS host, regexp_extract(url, '^[a-z]+://([^/]*/[^/?#]*)', 1) AS path,
    1700000000 + (page_id * 997) % 3456000 AS t FROM pages
), hosts AS (SELECT DISTINCT host AS pattern, length(host) % 20 AS day FROM captures
), entries AS (
  SELECT v.list, v.kind, pattern, v.action, 1700000000 + (day + v.d) * 86400 AS since FROM hosts,
    (VALUES ('hosts', 'host', 'add', 0), ('hosts', 'host', 'remove', 6), ('hosts', 'host', 'add', 14), ('malware', 'domain', 'add', 3)) v(list, kind, action, d)
  WHERE day % 3 <> 0
  UNION ALL SELECT DISTINCT 'paths', 'prefix', path, 'add', 1700000000 + (length(path) % 30) * 86400 FROM captures WHERE regexp_matches(path, '/[a-m]')
  UNION ALL SELECT 'zones', 'domain', 'example.org', 'add', 1700000000 + 10 * 86400
  UNION ALL SELECT 'zones', 'domain', 'example.org', 'remove', 1700000000 + 25 * 86400
), log AS (SELECT list, kind, pattern, since, max(action) AS action FROM entries GROUP BY ALL
), spans AS (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since) AS until FROM log
), parts AS (SELECT page_id, t, host, path, string_split(host, '.') AS labels FROM captures
), keys AS (
  SELECT page_id, t, 'host' AS kind, host AS pattern FROM parts
  UNION ALL SELECT page_id, t, 'prefix', path FROM parts
  UNION ALL SELECT page_id, t, 'domain', array_to_string(list_slice(labels, i, len(labels)), '.') FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM parts)
), hits AS (
  SELECT k.page_id, s.list FROM keys k JOIN spans s USING (kind, pattern) WHERE s.action = 'add' AND s.since <= k.t AND (s.until IS NULL OR k.t < s.until)
)
SELECT c.page_id, count(h.list) > 0 AS blocked, coalesce(string_agg(DISTINCT h.list, ',' ORDER BY h.list), '') AS lists, count(h.list) AS n_active
FROM captures c LEFT JOIN hits h USING (page_id) GROUP BY c.page_id
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(PIECE_MODEL)
    out = sentencepiece.decode(sentencepiece.encode(runtime.table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", "ids_crc32", F.crc32(F.encode("text", "UTF-8")).alias("decoded_crc32"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


#: Keys of each line, its words and its words without one of them, against those of earlier lines.
OP9_SQL = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), lines AS (SELECT doc_id, k, ls[k] AS line, {_WORDS_SQL.format("ls[k]")} AS ws FROM cut, unnest(range(1, len(ls) + 1)) t(k)
), placed AS (SELECT *, len(ws) AS n, md5(array_to_string(ws, ' ')) AS own, row_number() OVER (ORDER BY doc_id, k) AS place FROM lines
), classes AS (SELECT own, min(place) AS place, any_value(n) AS n, any_value(ws) AS ws FROM placed WHERE n > 0 GROUP BY own
), less AS (SELECT own, place, n, i, md5(array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ')) AS v FROM classes, unnest(range(1, n + 1)) t(i) WHERE n >= {line_dedup.MIN_WORDS}
), replaced AS (SELECT n, i, v, min(place) AS first FROM less GROUP BY n, i, v
), shorter AS (SELECT v, min(place) AS first FROM less GROUP BY v
), gone AS (
  SELECT own FROM less JOIN replaced r USING (n, i, v) WHERE r.first < less.place
  UNION SELECT less.own FROM less JOIN classes c ON c.own = less.v AND c.n = less.n - 1 WHERE c.place < less.place
  UNION SELECT c.own FROM classes c JOIN shorter s ON s.v = c.own WHERE s.first < c.place
), kept AS (SELECT p.*, p.n = 0 OR (p.place = c.place AND c.own NOT IN (SELECT own FROM gone)) AS keep FROM placed p LEFT JOIN classes c USING (own))
SELECT d.doc_id, count(k.place) AS n_lines, count(*) FILTER (NOT k.keep) AS n_removed, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(string_agg(k.line, chr(10) ORDER BY k.place) FILTER (k.keep), '')) END AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id, d.text
"""


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_output.write_tokens(runtime.table(spark, sf_dir, "documents"), tokenizer_path(JSON_TOKENIZER), END_ID)
    return token_output.read_tokens(shards)


def versions(name: str, batches: int, key, part) -> list[tuple]:
    """Of a row and each batch: whether it is present, its key and its part after so many updates; by crc32 of <name>:doc_id:batch."""
    c = lambda t: F.crc32(F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{t}")))
    present, updates = c(0) % 3 != 0, F.lit(0)
    out = [(present, key(updates), part(updates))]
    for t in range(1, batches + 1):
        kind = c(t) % 31
        updates = updates + F.when((kind == 1) & present, 1).otherwise(0)
        present = present != (kind == 0)
        out.append((present, key(updates), part(updates)))
    return out


def op11_join_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    home = F.expr("(doc_id - pmod(doc_id, 5)) div 5")
    docs = versions("d", 3, lambda n: home + n, lambda n: shown(F.col("lang")))
    labels = versions("l", 3, lambda n: home, lambda n: F.concat(shown(F.when(n % 2 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))), F.lit(","), shown(F.col("toxic"))))
    left = join_maintenance.log_of(runtime.table(spark, sf_dir, "documents").select("doc_id", "lang"), docs, "join-left")
    right = join_maintenance.log_of(runtime.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), labels, "join-right")
    out = join_maintenance.maintained(left, right, [1, 2, 3])
    return out.select("batch", "join_key", *[F.coalesce(F.col(f"{x}_part.part"), F.lit("-")).alias(f"{n}_part") for x, n in (("left", "doc"), ("right", "label"))], "weight", "total")


def crc32_sql(text: str) -> str:
    """Of ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}))"


def _versions_sql(name: str, columns: str, key: str, part: str, source: str) -> str:
    """Rows of a side after each batch, t from 0 to 3."""
    c = ", ".join(crc32_sql(f"concat('{name}:', doc_id, ':{t}')") + f" AS c{t}" for t in range(4))
    states, present, updates = [], "c0 % 3 <> 0", "0"
    for t in range(4):
        if t:
            updates = f"({updates} + CASE WHEN c{t} % 31 = 1 AND ({present}) THEN 1 ELSE 0 END)"
            present = f"({present}) <> (c{t} % 31 = 0)"
        states.append(f"SELECT {t} AS t, {key.format(n=updates)} AS k, {part.format(n=updates)} AS part FROM {name}_c WHERE {present}")
    return f"{name}_c AS (SELECT {columns}, {c} FROM {source}), {name}_ AS ({' UNION ALL '.join(states)})"


#: The whole join after each batch, and the difference of each to the one before.
OP11_SQL = f"""
WITH {_versions_sql("d", "doc_id, lang", "doc_id // 5 + {n}", "coalesce(lang, 'null')", "documents")},
{_versions_sql("l", "doc_id, quality, toxic", "doc_id // 5", "concat(coalesce(CASE WHEN {n} % 2 = 1 THEN 1 - quality ELSE quality END::VARCHAR, 'null'), ',', coalesce(toxic::VARCHAR, 'null'))", "labels")},
joined AS (SELECT coalesce(d_.t, l_.t) AS t, coalesce(d_.k, l_.k) AS k, coalesce(d_.part, '-') AS d, coalesce(l_.part, '-') AS l FROM d_ FULL JOIN l_ ON d_.t = l_.t AND d_.k = l_.k),
signed AS (SELECT t AS batch, k, d, l, 1 AS w, 1 AS n FROM joined WHERE t > 0 UNION ALL SELECT t + 1, k, d, l, -1, 0 FROM joined WHERE t < 3)
SELECT batch, k::BIGINT AS join_key, d AS doc_part, l AS label_part, sum(w)::BIGINT AS weight, sum(n)::BIGINT AS total FROM signed GROUP BY ALL HAVING sum(w) <> 0
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0d]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.contents(runtime.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.trie(prefix_trie.spliced(turns))


#: A node is the string of its turns' digests; every ancestor of a node is a beginning of that string.
OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), placed AS (
  SELECT c.conv_id, 0 AS side, p, m, size FROM convs c JOIN turns t ON t.conv_id = c.base WHERE p <= h
  UNION ALL SELECT conv_id, 1, p, m, size FROM turns JOIN convs USING (conv_id) WHERE p > h
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY side, p) AS depth FROM placed
), prefixes AS (
  SELECT conv_id, depth, size, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM prefixes GROUP BY ALL
), last_ AS (SELECT conv_id, arg_max(node, depth) AS node FROM prefixes GROUP BY conv_id
), ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM last_ GROUP BY node
), children AS (SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), weights AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)
), below AS (SELECT left(node, 32 * d) AS node, sum((n_convs - 1) * size) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM weights, unnest(range(depth + 1)) t(d) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM weights w JOIN below b USING (node) LEFT JOIN ends e USING (node) LEFT JOIN nodes p ON w.depth > 0 AND p.node = left(w.node, 32 * (w.depth - 1))
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_ann_tree": op4_ann_tree,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_output": op10_token_output,
    "op11_join_maintenance": op11_join_maintenance,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op6_mixing": OP6_SQL, "op7_url_filter": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_join_maintenance": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
