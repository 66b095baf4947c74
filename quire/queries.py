"""The registered queries over the document operators, and the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import evaluate, geometry, glossary, jobs, layout, masking, merge, records, render, repetition, sanitize, translate
from quire.plans import lift

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

W = r"[\s\x1c-\x1f\x{85}\p{Z}]"
LINES = "lines AS (SELECT doc_id, k - 1 AS k, ls[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(k))"
STOP = ", ".join(f"'{w}'" for w in glossary.STOP)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{W}+', ' ', 'g')")


def count(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, '{needle}', ''))) // {len(needle)})"


def pattern_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _times(x: str, needle: str, size: int) -> str:
    return f"(length({x}) - length(replace({x}, {needle}, ''))) // {size}"


def re2(pattern: str) -> str:
    """A pattern of the operators as the other engine writes it: it has no look-behind, and an ASCII word boundary does for the data."""
    return pattern.replace(T.BEGIN, r"\b").replace(f"(?![{T.LETTERS}])", r"\b").replace(r"\x85", r"\x{85}")


def joined(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


def ordered(key: str, value: str) -> F.Column:
    """The values of a group in the order of a key."""
    return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda r: r[value])


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _suffixes(source: str) -> str:
    """Tables of (doc_id, clean): the least period that a text ends in often enough, how far back it goes by halving, and the text without its repeats."""
    least = "greatest(100, 5 * p)"
    return f"""periods AS (SELECT doc_id, any_value(length(clean)) AS n, min(p) AS p FROM {source}, unnest(range(1, 201)) t(p) WHERE length(clean) >= 8000 AND right(clean, {least} - p) = substr(clean, length(clean) - {least} + 1, {least} - p) GROUP BY doc_id),
halving(doc_id, n, p, lo, hi) AS (SELECT doc_id, n, p, {least} - p, n - p + 1 FROM periods
  UNION ALL SELECT doc_id, h.n, p, CASE WHEN same THEN (lo + hi) // 2 ELSE lo END, CASE WHEN same THEN hi ELSE (lo + hi) // 2 END FROM (
    SELECT h.*, right(clean, (lo + hi) // 2) = substr(clean, h.n - p - (lo + hi) // 2 + 1, (lo + hi) // 2) AS same FROM halving h JOIN {source} USING (doc_id) WHERE hi - lo > 1) h),
runs_ AS (SELECT doc_id, n, p, lo AS m FROM halving WHERE hi - lo = 1),
ended AS (SELECT c.*, m IS NOT NULL AS cut_, CASE WHEN m IS NULL THEN clean ELSE left(clean, (n_ - m)::BIGINT) || right(clean, ((m + p) % p)::BIGINT) END AS whole FROM {source} c LEFT JOIN (SELECT doc_id, n AS n_, p, m FROM runs_) USING (doc_id))"""


BOXED = f"""{LINES}, boxed AS (SELECT doc_id, k, line, (k // 6 + 1)::INT AS page, ['title','text','table','formula','image'][k % 5 + 1] AS label,
  (doc_id * 7 + k * 13) % 900 AS x1, (doc_id * 3 + k * 29) % 900 AS y1, (doc_id * 7 + k * 13) % 900 + 20 + (k * 7) % 80 AS x2, (doc_id * 3 + k * 29) % 900 + 10 + (k * 11) % 60 AS y2 FROM lines)"""
BLOCKS = f"""{BOXED}, boxes AS (SELECT b.*, box, k % 7 = 3 AS is_ref FROM boxed b, unnest(range(CASE WHEN k % 7 = 3 THEN 2 ELSE 1 END)) t(box)),
blocks AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY k, box) - 1 AS block_no, label AS type, concat_ws(',', x1, y1, x2, y2) AS bbox, x1, y1, x2, y2,
  CASE WHEN label = 'image' THEN '' ELSE {strip('line')} END AS content,
  CASE WHEN label = 'image' THEN row_number() OVER (PARTITION BY doc_id, page, label = 'image' ORDER BY is_ref DESC, k, box) - 1 END AS crop_index FROM boxes)"""


@query(f"WITH {BLOCKS} SELECT doc_id, page, block_no, type, bbox, content, crop_index FROM blocks")
def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.parse_blocks(lift.raw_pages(spark, sf_dir)).withColumn("bbox", joined("bbox"))


def _size_sql(content: str) -> str:
    plain = squeeze(f"regexp_replace({content}, '<[^>]+>', ' ', 'g')")
    ascii_ = f"length(regexp_replace({plain}, '[^\\x00-\\x7f]', '', 'g'))"
    wide = f"length(regexp_replace({plain}, '[^ᄀ-ᇿ⺀-鿿ꥠ-꥿가-퟿豈-﫿＀-￯]', '', 'g'))"
    return f"({ascii_} * 0.5::DOUBLE + {wide} + (length({plain}) - {ascii_} - {wide}) * 0.65::DOUBLE)"


@query(f"""WITH {BLOCKS}, sized AS (SELECT *, {_size_sql('content')} AS weight, (x2 - x1) / 999::DOUBLE * 100 AS w, (y2 - y1) / 999::DOUBLE * 100 * 1.414::DOUBLE AS h FROM blocks)
SELECT doc_id, page, block_no, CASE WHEN weight >= 1 AND w > 0 AND h > 0 THEN round(greatest(0.8, least(3.6, least(sqrt(w * h / (weight * 1.2::DOUBLE)), h / 1.25::DOUBLE))), 4) END AS size FROM sized""")
def font_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.parse_blocks(lift.raw_pages(spark, sf_dir))
    return blocks.select("doc_id", "page", "block_no", F.round(layout.font_size(F.col("bbox"), F.col("content"), F.lit(1.414)), 4).alias("size"))


@query(f"""WITH {BLOCKS} SELECT type, count(*) AS n, count(crop_index) AS crops, sum(length(content))::BIGINT AS chars,
  count(*) FILTER (greatest(x1, y1, x2, y2) > 999) AS outside FROM blocks GROUP BY type""")
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.parse_blocks(lift.raw_pages(spark, sf_dir))
    return blocks.groupBy("type").agg(F.count("*").alias("n"), F.count("crop_index").alias("crops"), F.sum(F.length("content")).alias("chars"), F.count_if(F.array_max("bbox") > 999).alias("outside"))


_ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_PERCENT = "printf('%.2f', {0} / 999::DOUBLE * 100)"
_RAW_TABLE = '<table border="1"><tr><td style="a" colspan="2">'
_BODY = f"""CASE type WHEN 'table' THEN '<table><tr><td colspan="2">' || {_ESCAPED.format('content')} || '</td></tr></table>' WHEN 'formula' THEN '<span class="math-display">a &lt; b</span>' || {_ESCAPED.format('content')} ELSE {_ESCAPED.format('content')} END"""


@query(f"""WITH {BLOCKS}, shaped AS (SELECT *, block_no % 3 AS kind, 600 + doc_id % 3 * 100 AS width, CASE WHEN page % 4 = 0 THEN 0 ELSE 900 END AS height FROM blocks),
clamped AS (SELECT * REPLACE (CASE WHEN kind = 2 THEN x1 + 3 ELSE least(x2, 999) END AS x2, least(y2, 999) AS y2), CASE WHEN height > 0 THEN height / width::DOUBLE ELSE 1414 / width::DOUBLE END AS aspect, {_BODY} AS body FROM shaped),
sized AS (SELECT *, CASE WHEN kind = 1 THEN block_no % 9::DOUBLE END AS fs, {_size_sql('body')} AS weight, (x2 - x1) / 999::DOUBLE * 100 AS w, (y2 - y1) / 999::DOUBLE * 100 * aspect AS h FROM clamped),
drawn AS (SELECT *, coalesce(greatest(0.6, least(6.0, fs)), CASE WHEN weight >= 1 AND w > 0 AND h > 0 THEN greatest(0.8, least(3.6, least(sqrt(w * h / (weight * 1.2::DOUBLE)), h / 1.25::DOUBLE))) END) AS size,
  CASE WHEN block_no % 11 = 5 THEN 'down' WHEN fs IS NULL AND w > 0 AND h >= w * 6 AND length(CASE type WHEN 'table' THEN '{_RAW_TABLE}' || content || '</td></tr></table>' WHEN 'formula' THEN '\\[ a < b \\]' || content ELSE content END) >= 12 THEN 'up' END AS turned,
  'left:' || {_PERCENT.format('x1')} || '%;top:' || {_PERCENT.format('y1')} || '%;width:' || {_PERCENT.format('greatest(x2 - x1, 4)')} || '%;height:' || {_PERCENT.format('greatest(y2 - y1, 4)')} || '%;' AS style FROM sized),
boxes_ AS (SELECT doc_id, page, aspect, string_agg(CASE WHEN type = 'image' AND block_no % 2 = 0 THEN '<img class="layout-block layout-image" src="/files/images/p' || page || '_' || block_no || '.jpg" style="' || style || '" alt="">'
  ELSE '<div class="layout-block layout-' || type || coalesce(' layout-vertical-' || turned, '') || '" style="' || style || CASE WHEN size IS NULL THEN '' ELSE 'font-size:' || printf('%.2f', size) || 'cqw;line-height:1.22;' || CASE WHEN block_no % 4 = 1 AND type <> 'title' THEN 'font-weight:600;' ELSE '' END END
  || '" title="' || type || '">' || body || '</div>' END, '' ORDER BY block_no) AS html FROM drawn GROUP BY ALL)
SELECT doc_id, '<div class="doclayout-body" lang="ko">' || chr(10) || string_agg('<section class="layout-page" data-page="' || page || '"><div class="layout-canvas" style="padding-top:' || printf('%.2f', aspect * 100) || '%">' || html || '</div></section>', chr(10) ORDER BY page) || chr(10) || '</div>' AS html FROM boxes_ GROUP BY doc_id""")
def layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b = F.col("block_no"), F.col("bbox")
    content = F.when(F.col("type") == "table", F.concat(F.lit(_RAW_TABLE), "content", F.lit("</td></tr></table>"))).when(F.col("type") == "formula", F.concat(F.lit("\\[ a < b \\]"), "content")).otherwise(F.col("content"))
    blocks = layout.parse_blocks(lift.raw_pages(spark, sf_dir)).select(
        "doc_id", "page", "block_no", "type", F.when(n % 3 == 2, F.array(b[0], b[1], b[0] + 3, b[3])).otherwise(b).alias("bbox"), content.alias("content"),
        F.when((F.col("type") == "image") & (n % 2 == 0), F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_"), n.cast("string"), F.lit(".jpg"))).when(F.col("type") == "image", "../x").alias("image"),
        F.when(n % 3 == 1, (n % 9).cast("double")).alias("fs"), (n % 4 == 1).alias("bold"), F.when(n % 11 == 5, "down").when(n % 11 == 6, "sideways").alias("vertical"),
    )
    # every page has a block; numbers of pages need no text
    pages = lift.raw_pages(spark, sf_dir).select("doc_id", "page").withColumn("width", 600 + F.col("doc_id") % 3 * 100).withColumn("height", F.when(F.col("page") % 4 != 0, 900).otherwise(0))
    return layout.layout_html(blocks, pages, "/files", "ko")


@query(f"WITH {BLOCKS} SELECT doc_id, page, block_no, bbox, crop_index FROM blocks WHERE type = 'image'")
def crop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.parse_blocks(lift.raw_pages(spark, sf_dir)).filter("type = 'image'")
    return blocks.select("doc_id", "page", "block_no", joined("bbox").alias("bbox"), "crop_index")


WILD = f"""{LINES}, wild AS (SELECT *, (doc_id * 7 + k * 13) % 1060 - 30 AS x1, (doc_id * 5 + k * 17) % 1060 - 30 AS y1, (doc_id * 7 + k * 13) % 1060 - 35 + (k * 7) % 90 AS x2, (doc_id * 5 + k * 17) % 1060 - 33 + (k * 11) % 70 AS y2 FROM lines),
clamped AS (SELECT *, CASE WHEN least(x1, y1, x2, y2) >= -25 AND greatest(x1, y1, x2, y2) <= 1024 AND least(999, greatest(0, x2)) - least(999, greatest(0, x1)) >= 2 AND least(999, greatest(0, y2)) - least(999, greatest(0, y1)) >= 2
  THEN concat_ws(',', least(999, greatest(0, x1)), least(999, greatest(0, y1)), least(999, greatest(0, x2)), least(999, greatest(0, y2))) END AS bbox FROM wild)"""


@query(f"WITH {WILD} SELECT doc_id, k, bbox FROM clamped")
def sanitize_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.lines(spark, sf_dir).withColumn("bbox", sanitize.clamp_box(lift.wild_box()))
    return rows.select("doc_id", "k", joined("bbox").alias("bbox"))


_NAME = "[" + ", ".join(f"'{n}'" for n in lift.NAMES) + "][(doc_id + k) % 12 + 1]"
_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sanitize.ALIASES.items())
_TYPE = f"CASE WHEN lower(trim({{0}})) IN ({', '.join(repr(t) for t in sanitize.TYPES)}) THEN lower(trim({{0}})) ELSE coalesce(CASE lower(trim({{0}})) {_CASES} END, 'unknown') END"


@query(f"WITH {LINES} SELECT name, {_TYPE.format('name')} AS type, count(*) AS n FROM (SELECT {_NAME} AS name FROM lines) GROUP BY ALL")
def block_type_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.lines(spark, sf_dir).select(lift.pick(lift.NAMES, (F.col("doc_id") + F.col("k")) % 12).alias("name"))
    return rows.groupBy("name", sanitize.block_type(F.col("name")).alias("type")).agg(F.count("*").alias("n"))


def _nested(x: str) -> str:
    for _ in range(8):
        x = f"replace(regexp_replace({x}, '<\\|[^|>]{{0,64}}\\|>', '', 'g'), '<PAGE>', '')"
    return x


@query(f"WITH {LINES}, s AS (SELECT doc_id, k, {_nested("concat('a<<PAGE>PAGE>', line, 'x<|d<|q|>et|>y')")} AS t FROM lines) SELECT doc_id, k, CASE WHEN regexp_matches(t, '<\\|[^|>]{{0,64}}\\|>|<PAGE>') THEN replace(t, '<', ' ') ELSE t END AS text FROM s")
def strip_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.lines(spark, sf_dir)
    return rows.select("doc_id", "k", T.strip_special(F.concat(F.lit("a<<PAGE>PAGE>"), "line", F.lit("x<|d<|q|>et|>y"))).alias("text"))


@query(f"""WITH {WILD}, typed AS (SELECT *, (k // 600)::INT AS page, k % 600 AS pos, (k * 7) % 50 AS ord, k % 90 - 2 AS fig, {_TYPE.format(_NAME)} AS type FROM clamped),
kept AS (SELECT *, sum(CASE WHEN type = 'image' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY ord, pos) AS figure_no FROM typed WHERE pos < 512 AND (type <> 'image' OR bbox IS NOT NULL)),
capped AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, type, fig ORDER BY ord, pos) AS nth FROM kept WHERE type <> 'image' OR figure_no <= 64)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, pos) - 1 AS block_no, type, bbox, left(line, 100000) AS content, CASE WHEN type = 'image' AND fig >= 0 AND nth = 1 THEN fig END AS figure_index FROM capped""")
def sanitize_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.sanitize_pages(_untrusted(spark, sf_dir)).withColumn("bbox", joined("bbox"))


def _untrusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return lift.lines(spark, sf_dir).select(
        "doc_id", F.floor(k / 600).cast("int").alias("page"), (k % 600).alias("pos"), lift.pick(lift.NAMES, (F.col("doc_id") + k) % 12).alias("type"), lift.wild_box().alias("bbox"), F.col("line").alias("content"),
        ((k * 7) % 50).alias("order"), (k % 90 - 2).alias("figure_index"),
    )


@query(f"""WITH {WILD}, typed AS (SELECT *, (k // 600)::INT AS page, k % 600 AS pos, (k * 7) % 50 AS ord, k % 90 - 2 AS fig, {_TYPE.format(_NAME)} AS type FROM clamped),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n FROM typed), kept AS (SELECT *, type = 'image' AND bbox IS NOT NULL AS drawn FROM counted WHERE pos < 512),
numbered AS (SELECT *, CASE WHEN drawn THEN sum(drawn::INT) OVER (PARTITION BY doc_id, page ORDER BY ord, pos) END AS figure_no FROM kept),
used AS (SELECT *, drawn AND figure_no <= 64 AS stays FROM numbered), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, stays, fig ORDER BY ord, pos) AS nth FROM used)
SELECT doc_id, page, NULL::INT AS "order", NULL::INT AS pos, 'blocks' AS kind, any_value(n)::VARCHAR AS detail FROM counted WHERE n > 512 GROUP BY doc_id, page
UNION ALL SELECT doc_id, page, ord::INT, pos::INT, 'box', NULL FROM ranked WHERE bbox IS NULL
UNION ALL SELECT doc_id, page, ord::INT, pos::INT, 'figures', NULL FROM ranked WHERE figure_no > 64
UNION ALL SELECT doc_id, page, ord::INT, pos::INT, 'index', fig::VARCHAR FROM ranked WHERE stays AND (fig < 0 OR nth > 1)""")
def sanitize_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.sanitize_warnings(_untrusted(spark, sf_dir))


@query(f"""WITH {LINES}, made AS (SELECT doc_id, k, CASE WHEN k % 3 = 0 THEN line || '<|det|>' WHEN k % 3 = 1 THEN '<PAGE>' || line ELSE line END AS t, line FROM lines) SELECT doc_id, k, left(line, 400000) AS text, CASE WHEN k % 3 < 2 THEN 'control' ELSE '' END AS warnings FROM made""")
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    made = F.when(k % 3 == 0, F.concat("line", F.lit("<|det|>"))).when(k % 3 == 1, F.concat(F.lit("<PAGE>"), "line")).otherwise(F.col("line"))
    text, found = sanitize.clean_markdown(made)
    return lift.lines(spark, sf_dir).select("doc_id", "k", text.alias("text"), F.array_join(found, ",").alias("warnings"))


PIXELS = f"""{LINES}, px AS (SELECT *, (doc_id * 11 + k * 13) % 900 - 20 AS a, (doc_id * 5 + k * 7) % 1200 - 20 AS b, (doc_id * 11 + k * 13) % 900 - 10 + (k * 17) % 300 AS c, (doc_id * 5 + k * 7) % 1200 - 15 + (k * 19) % 200 AS d FROM lines),
grid AS (SELECT *, CASE WHEN c > a AND d > b AND a >= -(850 * 0.02 + 2) AND b >= -(1100 * 0.02 + 2) AND c <= 850 + 850 * 0.02 + 2 AND d <= 1100 + 1100 * 0.02 + 2 THEN
  [greatest(0, least(999, round_even(a / 850::DOUBLE * 999, 0)::INT)), greatest(0, least(999, round_even(b / 1100::DOUBLE * 999, 0)::INT)), greatest(0, least(999, round_even(c / 850::DOUBLE * 999, 0)::INT)), greatest(0, least(999, round_even(d / 1100::DOUBLE * 999, 0)::INT))] END AS g FROM px),
norm AS (SELECT *, CASE WHEN g[3] - g[1] >= 2 AND g[4] - g[2] >= 2 THEN concat_ws(',', g[1], g[2], g[3], g[4]) END AS bbox FROM grid)"""


def _pixel_box() -> F.Column:
    d, k = F.col("doc_id"), F.col("k")
    a, b = (d * 11 + k * 13) % 900 - 20, (d * 5 + k * 7) % 1200 - 20
    return F.array(a, b, a + 10 + (k * 17) % 300, b + 5 + (k * 19) % 200).cast("array<double>")


@query(f"WITH {PIXELS} SELECT doc_id, k, bbox FROM norm")
def norm_bbox_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.lines(spark, sf_dir).withColumn("bbox", sanitize.pixel_box(_pixel_box(), F.lit(850), F.lit(1100)))
    return rows.select("doc_id", "k", joined("bbox").alias("bbox"))


_PROVIDER = ("doc_title", "text", "paragraph_title", "display_formula", "image", "number", "reference", "odd")


@query(f"""WITH {PIXELS}, typed AS (SELECT *, (k // 10)::INT AS page, k % 10 AS pos, [{', '.join(repr(x) for x in _PROVIDER)}][k % 8 + 1] AS label, CASE WHEN k % 4 = 0 THEN NULL ELSE (k * 3) % 10 END AS ord FROM norm),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY coalesce(ord, pos), pos) - 1 AS o FROM typed),
kept AS (SELECT *, sum(CASE WHEN label = 'image' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY o) - 1 AS fig FROM ordered WHERE label <> 'image' OR bbox IS NOT NULL),
cleaned AS (SELECT *, {strip("regexp_replace(line, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')")} AS body FROM kept),
parts AS (SELECT *, CASE WHEN label = 'number' THEN NULL WHEN label = 'image' THEN '[[FIGURE:' || fig || ']]' WHEN body = '' THEN NULL WHEN label = 'doc_title' THEN '# ' || body WHEN label = 'paragraph_title' THEN '## ' || body
  WHEN label = 'display_formula' AND NOT regexp_matches(body, '\\$|\\\\\\[|\\\\\\(') THEN '\\[ ' || body || ' \\]' ELSE body END AS md FROM cleaned)
SELECT doc_id, page, {strip("coalesce(string_agg(md, chr(10) || chr(10) ORDER BY o), '')")} AS markdown FROM parts GROUP BY doc_id, page""")
def provider_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = lift.lines(spark, sf_dir).select(
        "doc_id", F.floor(k / 10).cast("int").alias("page"), (k % 10).alias("pos"), lift.pick(_PROVIDER, k % 8).alias("label"), _pixel_box().alias("bbox"), F.col("line").alias("content"),
        F.when(k % 4 != 0, (k * 3) % 10).alias("block_order"), F.lit(850).alias("width"), F.lit(1100).alias("height"),
    )
    return sanitize.provider_pages(rows)[1]


@query(f"""WITH RECURSIVE {LINES}, placed AS (SELECT *, (k * 37) % 1010 AS x, (k * 53) % 990 AS y FROM lines),
tags AS (SELECT *, k % 3 = 0 AS tagged, x + 40 <= 1000 AND y + (k % 2) * 20 <= 1000 AND least(999, x + 40) - least(999, x) >= 2 AND least(999, y + (k % 2) * 20) - least(999, y) >= 2 AS sound,
  concat_ws(',', least(999, x), least(999, y), least(999, x + 40), least(999, y + (k % 2) * 20)) AS box FROM placed),
firsts AS (SELECT *, tagged AND sound AND row_number() OVER (PARTITION BY doc_id, tagged AND sound, box ORDER BY k) = 1 AS good FROM tags),
numbered AS (SELECT *, sum(good::INT) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM firsts),
told AS (SELECT *, good AND n < 64 AS kept, min(n) FILTER (good) OVER (PARTITION BY doc_id, tagged AND sound, box) AS place FROM numbered),
made AS (SELECT doc_id, string_agg(line || CASE WHEN kept THEN '[[FIGURE:' || n || ']]' WHEN tagged THEN '' WHEN k % 11 = 5 THEN '<img src="http://x/y.png">' WHEN k % 17 = 4 THEN '<img src=open' ELSE '' END, chr(10) ORDER BY k) AS md, coalesce(string_agg(box, ';' ORDER BY n) FILTER (kept), '') AS figures,
  list(CASE WHEN NOT sound THEN 'box' WHEN NOT good AND place < 64 THEN 'twice' ELSE 'figures' END ORDER BY k) FILTER (tagged AND NOT kept) AS gone FROM told GROUP BY doc_id),
bared AS (SELECT *, regexp_replace(md, '(?i)<img\\b[^>]{{0,500}}?/?>', '', 'g') AS bare, len(regexp_extract_all(md, '(?i)<img\\b[^>]{{0,500}}?/?>')) AS others FROM made),
cleaned AS (SELECT *, regexp_replace(bare, '(?i)<img\\b[^>\\n]{{0,500}}', '', 'g') AS clean, len(regexp_extract_all(bare, '(?i)<img\\b[^>\\n]{{0,500}}')) AS open_ FROM bared),
{_suffixes("cleaned")}
SELECT doc_id, {strip('whole')} AS markdown, figures, array_to_string(list_concat(coalesce(gone, []),
  list_concat(list_concat(CASE WHEN others > 0 THEN ['tags ' || others] ELSE [] END, CASE WHEN open_ > 0 THEN ['open ' || open_] ELSE [] END), CASE WHEN cut_ THEN ['suffix'] ELSE [] END)), ';') AS warnings FROM ended""")
def figure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    x, y = (k * 37) % 1010, (k * 53) % 990
    tag = F.concat(F.lit('<img src="images/bbox_'), F.concat_ws("_", x, y, x + 40, y + (k % 2) * 20), F.lit('.jpg" />'))
    rows = lift.lines(spark, sf_dir).withColumn("x", F.concat("line", F.when(k % 3 == 0, tag).when(k % 11 == 5, '<img src="http://x/y.png">').when(k % 17 == 4, "<img src=open").otherwise("")))
    raw = rows.groupBy("doc_id").agg(F.array_join(ordered("k", "x"), "\n").alias("raw"))
    out = sanitize.figure_tags(raw).withColumn("figures", F.array_join(F.transform("figures", lambda b: F.array_join(b.cast("array<string>"), ",")), ";"))
    return out.withColumn("warnings", F.array_join("warnings", ";"))


CHUNKS = f"""{LINES}, pages AS (SELECT doc_id, k // 6 AS p, string_agg(CASE WHEN k % 3 = 2 THEN line || '![](images/' || '{{name}}' || k || '.jpg)' ELSE line END, chr(10) ORDER BY k) AS md FROM lines GROUP BY ALL),
chunked AS (SELECT doc_id, p // 3 AS chunk, list({strip('md')} ORDER BY p) AS ps, greatest(1, count(*) + (doc_id + p // 3) % 3 - 1) AS e FROM pages GROUP BY doc_id, p // 3),
started AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first FROM chunked),
result AS (SELECT doc_id, first + i AS page, CASE WHEN i < e - 1 OR len(ps) <= e THEN coalesce(ps[i + 1], '') ELSE array_to_string(ps[e:], chr(10) || chr(10)) END AS md, len(ps) AS n_markers, first FROM started, unnest(range(e)) t(i)),
named AS (SELECT doc_id, page, n_markers, list_reduce(list_prepend(md, range(3)::VARCHAR[]), lambda acc, j: replace(acc, 'images/page_' || j || '_', 'images/p' || printf('%04d', first + j::BIGINT) || '_')) AS md FROM result)"""
CHUNKS = CHUNKS.replace("'{name}' || k", "'page_' || (k // 6 % 3) || '_' || k")


@query(f"WITH {CHUNKS} SELECT doc_id, page::INT AS page, {strip('md')} AS md, n_markers FROM named")
def split_pages_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.chunk_pages(lift.chunks(spark, sf_dir))


@query(f"""WITH {CHUNKS} SELECT doc_id, chunk::INT AS chunk, first::INT AS start_page, len(ps)::INT AS found, e::INT AS expected, CASE WHEN len(ps) > e THEN 'surplus' ELSE 'missing' END AS kind FROM started WHERE len(ps) <> e""")
def chunk_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.chunk_warnings(lift.chunks(spark, sf_dir))


@query(f"WITH {CHUNKS}, clean AS (SELECT doc_id, page, {strip('md')} AS md FROM named) SELECT doc_id, {strip("string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page)")} || chr(10) AS markdown FROM clean GROUP BY doc_id")
def assembled_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.documents(merge.chunk_pages(lift.chunks(spark, sf_dir)))


@query(f"""WITH {BOXED}, words AS (SELECT doc_id, k, j - 1 AS j, ws[j] AS text FROM (SELECT doc_id, k, string_split(line, ' ') AS ws FROM lines), unnest(range(1, len(ws) + 1)) t(j)),
spans AS (SELECT doc_id, (k // 6 + 1)::INT AS page, ((j * 37 + doc_id) % 560)::DOUBLE + 10 AS cx, ((k * 23 + j * 5) % 780)::DOUBLE + 5 AS cy, (j % 5 + 8)::DOUBLE AS size, length(trim(text)) AS n, j % 3 = 0 OR j % 7 = 0 AS heavy, k % 4 = 0 AS up FROM words WHERE length(trim(text)) > 0),
met AS (SELECT b.doc_id, b.page, b.k, s.size, s.n, s.heavy, s.up FROM boxed b JOIN spans s USING (doc_id, page) WHERE b.label <> 'image' AND s.cx BETWEEN b.x1 / 999::DOUBLE * 612 - 3 AND b.x2 / 999::DOUBLE * 612 + 3 AND s.cy BETWEEN b.y1 / 999::DOUBLE * 792 - 3 AND b.y2 / 999::DOUBLE * 792 + 3),
run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page, k ORDER BY size, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(n) OVER (PARTITION BY doc_id, page, k) AS total FROM met)
SELECT doc_id, page, k AS block_no, round(min(size) FILTER (run * 2 >= total) / 612 * 100, 6) AS fs, coalesce(sum(n) FILTER (heavy), 0) * 2 > sum(n) AS bold, CASE WHEN coalesce(sum(n) FILTER (up), 0) * 2 > sum(n) THEN 'up' END AS vertical FROM run GROUP BY ALL""")
def span_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = lift.box(lift.lines(spark, sf_dir)).select("doc_id", "page", F.col("k").alias("block_no"), F.col("label").alias("type"), "bbox")
    pages = blocks.select("doc_id", "page").distinct().withColumn("w_pt", F.lit(612.0)).withColumn("h_pt", F.lit(792.0))
    out = geometry.measured_fonts(blocks, lift.spans(spark, sf_dir), pages).filter("fs is not null")
    return out.select("doc_id", "page", "block_no", F.round("fs", 6).alias("fs"), "bold", "vertical")


@query(f"""WITH {LINES}, pages AS (SELECT doc_id, (k // 6 + 1)::INT AS page, string_agg(line, chr(10) ORDER BY k) AS md FROM lines GROUP BY ALL)
SELECT doc_id, page, CASE WHEN page % 3 <> 0 THEN md WHEN page % 2 = 0 THEN 'again ' || md WHEN doc_id % 2 = 0 THEN 'layer ' || md ELSE '*[page failed]*' END AS md,
  CASE WHEN page % 3 <> 0 THEN 'multi' WHEN page % 2 = 0 THEN 'single' WHEN doc_id % 2 = 0 THEN 'text_layer' ELSE 'placeholder' END AS source FROM pages""")
def fallback_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lift.box(lift.lines(spark, sf_dir)).groupBy("doc_id", "page").agg(F.array_join(ordered("k", "line"), "\n").alias("md"))
    again, layer = (pages.withColumn("md", F.concat(F.lit(x), "md")) for x in ("again ", "layer "))
    return merge.fallback(pages.select("doc_id", "page"), pages.filter("page % 3 <> 0"), again.filter("page % 2 = 0"), layer.filter("doc_id % 2 = 0"))


@query(f"""WITH {LINES}, rows_ AS (SELECT *, k // 6 AS page FROM lines), pieces AS (SELECT doc_id, page, k, line || CASE WHEN k % 4 = 1 THEN CASE WHEN k % 8 = 1 THEN '![](images/f' || k || '.jpg)' ELSE '' END ELSE '' END AS x FROM rows_),
body AS (SELECT doc_id, page, regexp_replace(string_agg(x, chr(10) ORDER BY k), '{W}+$', '') AS md FROM pieces GROUP BY ALL),
tail AS (SELECT doc_id, page, string_agg(chr(10) || chr(10) || '![](images/f' || k || '.jpg)', '' ORDER BY k) AS t FROM rows_ WHERE k % 8 = 3 GROUP BY ALL)
SELECT doc_id, page::INT AS page, {strip("md || coalesce(t, '')")} AS md FROM body LEFT JOIN tail USING (doc_id, page)""")
def figure_placeholder_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = lift.lines(spark, sf_dir).withColumn("page", F.floor(k / 6).cast("int"))
    text = F.concat("line", F.when(k % 4 == 1, F.concat(F.lit("[[FIGURE:"), (k % 1000).cast("string"), F.lit("]]"))).otherwise(""))
    pages = rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("x")))), lambda r: r["x"]), "\n").alias("md"))
    crops = rows.filter("k % 8 = 1 or k % 8 = 3").select("doc_id", "page", (k % 1000).cast("int").alias("figure_index"), F.concat(F.lit("f"), k.cast("string"), F.lit(".jpg")).alias("name"))
    return merge.place_figures(pages, crops)


@query(f"""WITH {WILD} SELECT doc_id, k, CASE WHEN w > 0 AND w <= 1.5 THEN round(greatest(0.08, least(1.0, w)), 6) END AS share, CASE WHEN w > 0 AND w <= 1.5 THEN greatest(0.08, least(1.0, w)) < 0.6 END AS centred
FROM (SELECT doc_id, k, (x2 - x1) / 50::DOUBLE AS w FROM wild)""")
def figure_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.lines(spark, sf_dir).withColumn("b", lift.wild_box())
    share, centred = geometry.figure_width(F.col("b")[0], F.col("b")[2], F.lit(50.0))
    return rows.select("doc_id", "k", F.round(share, 6).alias("share"), centred.alias("centred"))


@query(f"""WITH {BOXED}, px AS (SELECT *, trunc(x1 / 999::DOUBLE * 850)::INT AS a, trunc(y1 / 999::DOUBLE * 1100)::INT AS b, least(850, trunc((x1 + (k % 4 - 1) * 30) / 999::DOUBLE * 850)::INT) AS c, least(1100, trunc(y2 / 999::DOUBLE * 1100)::INT) AS d FROM boxed)
SELECT doc_id, page, string_agg(CASE WHEN c > a AND d > b THEN concat_ws(',', a, b, c, d) ELSE '-' END, ';' ORDER BY k) AS rects FROM px GROUP BY doc_id, page""")
def crop_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    rows = lift.box(lift.lines(spark, sf_dir)).withColumn("cut", F.array(b[0], b[1], b[0] + (F.col("k") % 4 - 1) * 30, b[3]))
    lists = rows.groupBy("doc_id", "page").agg(ordered("k", "cut").alias("boxes"))
    rects = geometry.crop_rects(F.col("boxes"), F.lit(850), F.lit(1100))
    return lists.select("doc_id", "page", F.array_join(F.transform(rects, lambda r: F.coalesce(F.array_join(r.cast("array<string>"), ","), F.lit("-"))), ";").alias("rects"))


@query(f"""WITH {LINES}, c AS (SELECT *, k // 6 AS chunk, k // 6 * 2 + 1 AS start, (k // 6) % 3 = 0 AS single FROM lines)
SELECT doc_id, CASE WHEN k % 6 IN (0, 1) THEN 'images' ELSE 'layout' END AS folder, CASE WHEN single THEN CASE k % 6 WHEN 0 THEN printf('p%04d_', start) || k || '.jpg' ELSE printf('page_%04d.jpg', start) END
  ELSE CASE k % 6 WHEN 1 THEN printf('p%04d_', start + 1) || k || '.jpg' ELSE printf('page_%04d.jpg', start + 1) END END AS name, CASE WHEN k % 6 IN (0, 1) THEN 'm' || k END AS meta
FROM c WHERE (single AND k % 6 IN (0, 2)) OR (NOT single AND k % 6 IN (1, 3))""")
def renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = lift.lines(spark, sf_dir).withColumn("chunk", F.floor(k / 6).cast("int"))
    s = k.cast("string")
    name = F.when(k % 6 == 0, F.concat(F.lit("images/"), s, F.lit(".jpg"))).when(k % 6 == 1, F.concat(F.lit("images/page_1_"), s, F.lit(".jpg"))).when(k % 6 == 2, "result_with_boxes.jpg").when(k % 6 == 3, "result_with_boxes_1.jpg").otherwise("notes.txt")
    chunks = rows.select("doc_id", "chunk").distinct().select("doc_id", "chunk", (F.col("chunk") * 2 + 1).alias("start_page"), (F.col("chunk") % 3 == 0).alias("single"))
    return merge.renamed_files(rows.select("doc_id", "chunk", name.alias("name"), F.concat(F.lit("m"), s).alias("meta")), chunks)


@query(f"""WITH {BOXED} SELECT doc_id, page, string_agg(line || CASE WHEN k % 4 = 1 AND label = 'image' THEN '<|det|>image [' || concat_ws(', ', x1, y1, x2, y2) || ']<|/det|>' ELSE '' END, chr(10) ORDER BY k) AS text FROM boxed GROUP BY doc_id, page""")
def live_stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = lift.box(lift.lines(spark, sf_dir)).withColumn("x", F.concat("line", F.when(k % 4 == 1, F.concat(F.lit("[[FIGURE:"), k.cast("string"), F.lit("]]"))).otherwise("")))
    pages = rows.groupBy("doc_id", "page").agg(F.array_join(ordered("k", "x"), "\n").alias("md"))
    return merge.live_text(pages, rows.select("doc_id", "page", F.col("label").alias("type"), "bbox", k.alias("figure_index")))


@query(f"""WITH {LINES}, shares AS (SELECT doc_id, k, CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 40) / 20::DOUBLE END AS w, line FROM lines)
SELECT doc_id, k, '<p>' || CASE WHEN w > 0 AND w <= 1.5 THEN '<img src="/f/images/a' || k || '.jpg" alt="x" style="width:' || printf('%.1f', greatest(0.08, least(1.0, w)) * 100) || '%;height:auto;' || CASE WHEN greatest(0.08, least(1.0, w)) < 0.6 THEN 'display:block;margin-left:auto;margin-right:auto;' ELSE '' END || '">'
  ELSE '<img src="/f/images/a' || k || '.jpg" alt="x" />' END || '</p>' AS html FROM shares""")
def figure_widths_in_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    name = F.concat(F.lit("a"), k.cast("string"), F.lit(".jpg"))
    box = F.struct(F.lit(0.0).alias("x1"), (k % 40).cast("double").alias("x2"), F.lit(20.0).alias("image_width"))
    boxes = F.when(k % 5 != 0, F.create_map(name, box))
    html = F.concat(F.lit('<p><img src="/f/images/'), name, F.lit('" alt="x" /></p>'))
    return lift.lines(spark, sf_dir).select("doc_id", "k", render.with_widths(html, boxes).alias("html"))


# Terms

_CALM = "NOT (len(regexp_extract_all(line, '[A-Za-z]{2,}')) >= 2 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) * 10 > length(regexp_replace(line, '[^A-Za-z]', '', 'g')) * 7)"
_WORDS = "list_filter(string_split_regex({0}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


_TOKENS = re2(masking.ANY)
#: Lines without their tokens; a token may run over lines, so texts are cleared before they are cut.
CLEARED = f"lines AS (SELECT doc_id, k - 1 AS k, ls[k] AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '{_TOKENS.replace(chr(39), chr(39) * 2)}', ' ', 'g'), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(k))"


def _cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.table(spark, sf_dir, "documents").select("doc_id", masking.residual_text(F.col("text")).alias("text"))


@query(f"WITH {CLEARED} SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(line, '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM lines WHERE {_CALM}) WHERE regexp_full_match(term, '[A-Z]{{2,6}}[0-9]?') GROUP BY ALL")
def acronym_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.acronyms(_cleared(spark, sf_dir))


# letters and digits beyond ASCII are one word character to the other engine, which no term holds
_PLAIN_WORDS = "regexp_replace(string_agg(line, chr(10) ORDER BY k), '[^\\x00-\\x7f]', '_', 'g')"


@query(f"""WITH {CLEARED}, calm AS (SELECT doc_id, {_PLAIN_WORDS} AS t FROM lines WHERE {_CALM} GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(t, '\\b[A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+){{0,2}}\\b'), regexp_extract_all(t, '\\b[a-z]+(?:-[a-z]+)+\\b'))) AS x FROM calm),
terms AS (SELECT doc_id, regexp_replace(x, '\\s+', ' ', 'g') AS term FROM raw), counted AS (SELECT doc_id, term, count(*) AS n FROM terms WHERE lower(string_split(term, ' ')[1]) NOT IN ({STOP}) GROUP BY ALL HAVING count(*) >= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM counted) SELECT doc_id, term, n, rank::INT AS rank FROM ranked WHERE rank <= 80""")
def term_candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.candidates(_cleared(spark, sf_dir))


@query(f"""WITH {CLEARED}, found AS (SELECT DISTINCT doc_id, lower(term) AS src, term FROM (SELECT doc_id, unnest(string_split_regex(line, '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM lines WHERE {_CALM}) WHERE regexp_full_match(term, '[A-Z]{{2,6}}[0-9]?')),
names AS (SELECT doc_id, src, min(term) AS ko, 'A' AS policy FROM found WHERE src NOT IN ('the', 'of the', 'la', 'de la', 'und', 'is and', 'in', 'fine-tuning', 'c++', {STOP}) GROUP BY ALL),
judged AS (SELECT doc_id, v.* FROM documents, (VALUES (1, 'models', 'Modelle', 'b'), (2, 'model', 'Modell', 'C'), (3, 'fine-tuned', 'x', 'D'), (4, 'unds', 'y', 'B'), (5, 'gpt', 'gpt', 'A'), (6, 'gpt', 'GPT', 'A'), (7, 'this', 'z', 'B'), (8, 'odd', 'q', 'E'), (9, ' run ', ' lauf ', ' d ')) v(pos, src, ko, policy)),
clean AS (SELECT doc_id, pos, trim(lower(src)) AS src, trim(ko) AS ko, upper(trim(policy)) AS policy FROM judged),
stems AS (SELECT *, regexp_replace(src, '(?:ing|ed|es|s)$', '') AS stem FROM clean WHERE policy IN ('A', 'B', 'C', 'D') AND src NOT IN ({STOP}) AND (policy <> 'A' OR contains(ko, ' ') OR length(regexp_replace(ko, '[^\\p{{Lu}}]', '', 'g')) >= 2)),
new AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stem ORDER BY pos) AS nth FROM stems s WHERE stem NOT IN ('the', 'of the', 'la', 'de la', 'und', 'is and', 'in', 'fine-tun', 'c++')
  AND NOT EXISTS (SELECT 1 FROM names n WHERE n.doc_id = s.doc_id AND regexp_replace(n.src, '(?:ing|ed|es|s)$', '') = s.stem))
SELECT * FROM names UNION ALL SELECT doc_id, src, ko, policy FROM new WHERE nth = 1""")
def glossary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lift.table(spark, sf_dir, "documents")
    rows = [(1, "models", "Modelle", "b"), (2, "model", "Modell", "C"), (3, "fine-tuned", "x", "D"), (4, "unds", "y", "B"), (5, "gpt", "gpt", "A"), (6, "gpt", "GPT", "A"), (7, "this", "z", "B"), (8, "odd", "q", "E"), (9, " run ", " lauf ", " d ")]
    judged = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(a).alias("src"), F.lit(b).alias("ko"), F.lit(c).alias("policy")) for p, a, b, c in rows])).alias("j")).select("doc_id", "j.*")
    return glossary.built(docs, lift.glossary(spark), judged)


@query(f"WITH {LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY k) FILTER ({_CALM}) AS text FROM lines GROUP BY doc_id")
def shouty_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lift.table(spark, sf_dir, "documents")
    calm = glossary.calm_lines(F.col("text"))
    left = F.size(F.filter(T.lines(F.col("text")), lambda x: glossary.calm_lines(x) == x)) > 0
    return docs.select("doc_id", F.when(left, calm).alias("text"))


def _entry_sql(src: str) -> str:
    """An entry's pattern as the other engine writes it: a look to the side is a character or an end of the text."""
    body = f"{W}+".join(re.escape(w) for w in src.split())
    left = f"(?:^|[^{T.LETTERS}])" if re.match(r"\w", src) else f"[{T.LETTERS}]"
    right = f"(?:[^{T.LETTERS}]|$)" if re.search(r"\w$", src) else f"[{T.LETTERS}]"
    return f"(?i){left}{body}{right}"


def _hits_sql(scan: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, k, line, '{a}' AS src, '{b}' AS ko, '{c}' AS policy FROM scanned_ WHERE regexp_matches({scan}, '{_entry_sql(a)}')" for a, b, c in lift.GLOSSARY)


_TOKENED = f"{LINES}, tokened AS (SELECT doc_id, k, line || CASE k % 5 WHEN 0 THEN ' $x_' || k || '$' WHEN 1 THEN ' [' || k || ']' WHEN 2 THEN ' see Figure ' || k WHEN 3 THEN ' https://example.org/' || k ELSE ' `c' || k || '`' END || CASE k % 6 WHEN 0 THEN ' fine. Tuning of C code' WHEN 1 THEN ' $de la$ fine-tuning' WHEN 2 THEN ' of  the C++x' ELSE '' END AS line FROM lines)"
_QUOTED = _TOKENS.replace("'", "''")
HITS = f"{_TOKENED}, scanned_ AS (SELECT *, regexp_replace(line, '{_QUOTED}', ' ', 'g') AS scan FROM tokened), hits AS ({_hits_sql('scan')})"


def _units(spark: SparkSession, sf_dir: str, scan) -> DataFrame:
    return lift.tokened(spark, sf_dir).select("doc_id", F.concat(F.lit("md:0:"), F.col("k").cast("string")).alias("unit_id"), F.col("k").alias("unit_seq"), scan(F.col("line")).alias("scan"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.term_hits(_units(spark, sf_dir, masking.residual_text), lift.glossary(spark))


@query(f"WITH {HITS} SELECT doc_id, 'md:0:' || k AS unit_id, src, ko, policy FROM hits")
def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).drop("unit_seq")


@query(f"WITH {_TOKENED}, scanned_ AS (SELECT * FROM tokened), hits AS ({_hits_sql('line')}) SELECT doc_id, src, 'md:0:' || min(k) AS first_unit FROM hits GROUP BY doc_id, src")
def first_term_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.first_units(glossary.term_hits(_units(spark, sf_dir, lambda c: c), lift.glossary(spark)))


@query(f"""WITH {HITS}, done AS (SELECT *, CASE WHEN k % 2 = 0 THEN replace(replace(line, 'the', 'das'), 'in', 'on') ELSE line || ' el del' END AS text FROM hits)
SELECT src, policy, count(*) AS n FROM done WHERE CASE WHEN policy = 'A' THEN NOT contains(lower(text), lower(ko)) ELSE NOT contains(text, ko) END GROUP BY ALL""")
def glossary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("k"), F.col("line")
    text = F.when(k % 2 == 0, F.replace(F.replace(line, F.lit("the"), F.lit("das")), F.lit("in"), F.lit("on"))).otherwise(F.concat(line, F.lit(" el del")))
    done = lift.tokened(spark, sf_dir).select("doc_id", F.concat(F.lit("md:0:"), k.cast("string")).alias("unit_id"), text.alias("text"), masking.residual_text(line).alias("scan"))
    return evaluate.violating(glossary.term_hits(done, lift.glossary(spark))).groupBy("src", "policy").agg(F.count("*").alias("n"))


@query(f"WITH {HITS} SELECT doc_id, 'md:0:' || k AS unit_id, string_agg(DISTINCT ko, ',' ORDER BY ko) AS terms FROM hits WHERE policy = 'A' GROUP BY ALL")
def glossary_keep_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.keep_terms(_hits(spark, sf_dir)).withColumn("terms", F.array_join("terms", ","))


# Repetition

_SHAPE = "regexp_replace(compact, '[0-9]+', '<n>', 'g')"
_FOLDED = f"lower(replace({squeeze('line')}, 'ß', 'ss'))"


@query(f"""WITH {LINES}, compacted AS (SELECT doc_id, k, {_FOLDED} AS compact FROM lines), shaped AS (SELECT doc_id, k, CASE WHEN len(regexp_extract_all(compact, '[0-9]+')) BETWEEN 1 AND 2 AND length({_SHAPE}) >= 24
  AND length(regexp_replace({_SHAPE}, '[^\\p{{L}}]', '', 'g')) >= 8 THEN {_SHAPE} END AS template FROM compacted WHERE compact <> ''),
marked AS (SELECT *, CASE WHEN template IS NULL OR template IS DISTINCT FROM lag(template) OVER (PARTITION BY doc_id ORDER BY k) THEN 1 ELSE 0 END AS new FROM shaped),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked)
SELECT doc_id, min(k) AS first_line, count(*) AS n, any_value(template) AS template FROM runs WHERE template IS NOT NULL GROUP BY doc_id, run HAVING count(*) >= 2""")
def line_repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lift.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return repetition.line_runs(pages).drop("page")


_COUNTERS = "list_reduce(list_prepend('', list_transform(range(doc_id % 7, doc_id % 7 + 5 + doc_id % 40), lambda n: '#' || n || '. ' || CASE WHEN doc_id % 3 = 0 AND n % 2 = 0 THEN left(text, 15) ELSE '' END)), lambda a, b: a || b)"


@query(f"""WITH planted AS (SELECT doc_id, right(text || ' #900. ' || {_COUNTERS} || '#500.', 4096) AS t FROM documents),
cut AS (SELECT doc_id, regexp_extract_all(t, '#\\s*\\d{{1,7}}\\s*\\.') AS marks, string_split_regex(t, '#\\s*\\d{{1,7}}\\s*\\.') AS gaps FROM planted),
rows_ AS (SELECT doc_id, i, regexp_extract(marks[i], '\\d+')::INT AS v, length(marks[i]) AS n_mark, length(gaps[i]) AS n_gap, length(regexp_replace(gaps[i], '[^\\p{{L}}]', '', 'g')) AS n_letters FROM cut, unnest(range(1, len(marks) + 1)) u(i)),
grouped AS (SELECT *, row_number() OVER w - i + v - row_number() OVER w AS island, lag(v - i) OVER w IS DISTINCT FROM v - i AS new FROM rows_ WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM grouped)
SELECT doc_id, min(v) AS first, count(*) AS n FROM runs GROUP BY doc_id, run HAVING count(*) >= 20 AND coalesce(sum(n_letters) FILTER (NOT new), 0) <= 0.05 * (sum(n_mark) + coalesce(sum(n_gap) FILTER (NOT new), 0))""")
def counter_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    prose = lambda n: F.when((d % 3 == 0) & (n % 2 == 0), F.left("text", F.lit(15))).otherwise("")
    numbers = F.transform(F.sequence(d % 7, d % 7 + 4 + d % 40), lambda n: F.concat(F.lit("#"), n.cast("string"), F.lit(". "), prose(n)))
    text = F.concat("text", F.lit(" #900. "), F.array_join(numbers, ""), F.lit("#500."))
    pages = lift.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), text.alias("text"))
    return repetition.counter_runs(pages).drop("page")


@query("SELECT doc_id, 1 AS page, length(text) AS n_chars, length(text) > 16384 AS over FROM documents")
def page_char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.page_budget(lift.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text"))


@query(f"""WITH {LINES}, seqs AS (SELECT doc_id, k, list_transform(string_split(line, ' '), lambda w: length(w) % 4)[-40:] AS s FROM lines),
found AS (SELECT doc_id, k, s, list_filter(range(1, len(s) - 1), lambda i: s[i] = s[-2] AND s[i + 1] = s[-1]) AS hits FROM seqs)
SELECT doc_id, k, coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda i: s[i + 2]))), ','), '') AS banned FROM found""")
def ngram_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.lines(spark, sf_dir).withColumn("s", F.transform(F.split("line", " ", -1), lambda w: F.length(w) % 4))
    return rows.select("doc_id", "k", F.array_join(repetition.ngram_bans(F.col("s"), 3, 40).cast("array<string>"), ",").alias("banned"))


@query()
def tandem_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    tail = F.when(d % 3 == 0, F.repeat(F.right("text", F.lit(30)), 150)).when(d % 3 == 1, F.concat(F.lit("\n"), F.repeat(F.left("text", F.lit(20)), 3))).otherwise("")
    return lift.table(spark, sf_dir, "documents").select("doc_id", repetition.tandem_repeat(F.concat("text", tail)).alias("t")).select("doc_id", "t.*")


@query(f"""WITH RECURSIVE planted AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN repeat(right(text, 50), 200) ELSE '' END AS clean FROM documents), {_suffixes("planted")} SELECT doc_id, whole AS text FROM ended""")
def repeat_suffix_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.right("text", F.lit(50)), 200)).otherwise("")
    return lift.table(spark, sf_dir, "documents").select("doc_id", repetition.clean_suffix(F.concat("text", tail)).alias("text"))


# Text

@query(f"""SELECT doc_id, length(text) AS chars, {pattern_count('text', '!\\[[^\\]]*\\]\\(')} AS figures, {count('lower(text)', '<table')} AS tables, {pattern_count('text', '\\\\\\[|\\\\\\(|\\$\\$')} AS formulas FROM documents""")
def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in T.structure_counts(F.col("text")).items()])


@query("SELECT page_id, " + ", ".join(f"{pattern_count('html', f'<{t}[ >]')} AS n_{t}" for t in ("p", "a", "li", "b", "h1")) + " FROM pages")
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.table(spark, sf_dir, "pages").select("page_id", *[F.regexp_count("html", F.lit(f"<{t}[ >]")).cast("long").alias(f"n_{t}") for t in ("p", "a", "li", "b", "h1")])


_BEFORE = "lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text)"
# the other engine counts bytes: letters of the data beyond ASCII become control characters, one to one
_FOREIGN = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_ONE_BYTE = "translate({0}, '" + _FOREIGN + "', " + " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 28)][: len(_FOREIGN)]) + ")"


@query(f"""WITH turns AS (SELECT conv_id, turn, {squeeze('text')} AS a, {squeeze(_BEFORE)} AS b FROM conversations)
SELECT conv_id, turn, levenshtein({_ONE_BYTE.format('a')}, {_ONE_BYTE.format('b')}) AS distance, greatest(length(a), length(b)) AS longest FROM turns WHERE b IS NOT NULL""")
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = lift.table(spark, sf_dir, "conversations").withColumn("b", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).filter("b is not null")
    distance, longest = evaluate.ground_truth(F.col("text"), F.col("b"))
    return rows.select("conv_id", "turn", distance.cast("long").alias("distance"), longest.cast("long").alias("longest"))


_MARKED_TEXT = "CASE WHEN turn % 2 = 0 THEN text || ' <Table> \\( x \\) ![](a.png)' ELSE text || '$$' END"
_STRUCTURE = {"tables": count("lower({0})", "<table"), "formulas": pattern_count("{0}", "\\\\\\[|\\\\\\(|\\$\\$"), "figures": pattern_count("{0}", "!\\[[^\\]]*\\]\\(")}


@query(f"""WITH turns AS (SELECT conv_id, turn, {_MARKED_TEXT} AS a, text AS b FROM conversations),
plain AS (SELECT *, {squeeze("regexp_replace(a, '!\\[\\]\\([^)]*\\)', '', 'g')")} AS x, {squeeze('b')} AS y FROM turns), far AS (SELECT *, levenshtein({_ONE_BYTE.format('x')}, {_ONE_BYTE.format('y')}) AS d FROM plain)
SELECT conv_id, turn, round(d / greatest(length(x), length(y), 1)::DOUBLE, 4) AS distance, round(d / greatest(length(y), 1)::DOUBLE, 4) AS cer, {", ".join(f"CASE WHEN greatest({c.format('a')}, {c.format('b')}) > 0 THEN round(least({c.format('a')}, {c.format('b')}) / greatest({c.format('a')}, {c.format('b')})::DOUBLE, 3) ELSE 1.0 END AS {n}" for n, c in _STRUCTURE.items())} FROM far""")
def truth_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" <Table> \\( x \\) ![](a.png)"))).otherwise(F.concat("text", F.lit("$$")))
    return lift.table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in evaluate.truth_metrics(made, F.col("text")).items()])


@query(f"SELECT lang, sum({pattern_count('text', '[가-힣]')})::BIGINT AS hangul, sum(length(regexp_replace(text, '{W}', '', 'g')))::BIGINT AS solid FROM documents GROUP BY lang")
def hangul_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    hangul, solid = masking.hangul_share(F.col("text"))
    return lift.table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(hangul).alias("hangul"), F.sum(solid).alias("solid"))


@query(f"""WITH {LINES}, units AS (SELECT doc_id, k, '[' || k || '] ' || line || CASE WHEN k % 3 = 0 THEN ' 2019' WHEN k % 3 = 1 THEN chr(10) || '[9] z' ELSE '' END AS u, k % 3 AS kind, line FROM lines)
SELECT doc_id, k, (regexp_matches(line, '\\S') OR kind = 0) AND kind <> 2 AND (kind = 0 OR regexp_matches(line, '\\S')) OR (kind = 2 AND regexp_matches(line, '\\S') AND regexp_matches(u, '(?i)\\b(?:19|20)\\d{{2}}\\b|arXiv|,\\s*[A-Z]\\.|\\bpp\\.\\s*\\d|\\bvol\\.\\s*\\d')) AS refs FROM units""")
def reference_list_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    tail = F.when(k % 3 == 0, " 2019").when(k % 3 == 1, "\n[9] z").otherwise("")
    rows = lift.lines(spark, sf_dir).withColumn("u", F.concat(F.lit("["), k.cast("string"), F.lit("] "), "line", tail))
    return rows.select("doc_id", "k", masking.reference_list(F.col("u")).alias("refs"))


_INERT = "regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\t', '    ', 'g'), '[\\x00-\\x09\\x0b-\\x1f\\x7f]', '', 'g')"


@query(f"""WITH trimmed AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split({_INERT}, chr(10)), lambda x: regexp_replace(x, '{W}+$', '')), chr(10)), '^\\n+|\\n+$', '', 'g') AS t FROM documents),
cut AS (SELECT doc_id, CASE WHEN length(t) > 100000 THEN left(t, 100000) || chr(10) || '[truncated]' ELSE t END AS t FROM trimmed)
SELECT doc_id, CASE WHEN regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN array_to_string(list_transform(string_split(t, chr(10)), lambda x: '    ' || x), chr(10)) END AS text FROM cut""")
def embedded_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.table(spark, sf_dir, "documents").select("doc_id", T.inert_markdown(F.col("text")).alias("text"))


# Translation

@query(f"WITH {LINES}, units AS (SELECT doc_id, k, line FROM lines WHERE {strip('line')} <> '') SELECT doc_id, 'md:0:' || k AS unit_id, right(lag(line) OVER (PARTITION BY doc_id ORDER BY k), 200) AS context FROM units")
def prev_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.contexts(translate.line_units(lift.table(spark, sf_dir, "documents"))).select("doc_id", "unit_id", "context")


_KEY = "sha256('4' || chr(31) || 'm' || chr(31) || CASE WHEN k % 2 = 1 THEN 'a' || chr(30) || 'x' || chr(31) || 'the' || chr(30) || 'das' || chr(31) ELSE '' END || line)"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("the").alias("src"), F.lit("das").alias("ko")), F.struct(F.lit("a").alias("src"), F.lit("x").alias("ko")))
    pairs = F.when(F.col("k") % 2 == 1, pairs).otherwise(F.array().cast("array<struct<src:string,ko:string>>"))
    return lift.lines(spark, sf_dir).withColumn("key", translate.cache_key(F.lit("m"), pairs, F.col("line")))


@query(f"WITH {LINES} SELECT doc_id, k, {_KEY} AS key FROM lines")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("doc_id", "k", "key")


@query(f"WITH {LINES}, keyed AS (SELECT doc_id, k, {_KEY} AS key FROM lines), known AS (SELECT DISTINCT key FROM keyed WHERE (doc_id + k) % 3 = 0) SELECT doc_id, count(known.key) AS hits, count(*) - count(known.key) AS misses FROM keyed LEFT JOIN known USING (key) GROUP BY doc_id")
def unit_cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _keyed(spark, sf_dir)
    cache = units.filter((F.col("doc_id") + F.col("k")) % 3 == 0).select("key", F.col("line").alias("text"))
    known, missing = translate.split_cache(units, cache)
    both = known.select("doc_id", F.lit(1).alias("hit")).unionByName(missing.select("doc_id", F.lit(0).alias("hit")))
    return both.groupBy("doc_id").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))


def _tokened_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.tokened(spark, sf_dir).groupBy("doc_id").agg(F.array_join(ordered("k", "line"), "\n").alias("text"))


def lowered(text: str) -> str:
    """Lower case outside placeholders."""
    return re.sub(r"(<[^>]*>)|([^<]+)", lambda m: m[1] or m[2].lower(), text)


def whispering(request: dict) -> str:
    """Stands for a model: loses a placeholder where 'see' stands before it."""
    return lowered(re.sub(r"see <f\d+[^>]*>", "see", request["masked"]))


def careless(request: dict) -> str:
    """Stands for a model: loses a reference behind 'see' where a word of the unit says so, mends it where another does, invents a delimiter."""
    text = request["masked"]
    if "qqalways" in text or "qqsplit" in text or "qqmend" in text and request["broken"] is None:
        text = re.sub(r"see <f\d+[^>]*>", "see", text)
    return lowered(text) + ("\\(" if "qqinvent" in text else "")


def _translation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    # the same blocks as layout units: what is cached, skipped and kept is told by their texts alone
    blocks = lift.tokened(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.col("k").alias("block_no"), F.lit("text").alias("type"), F.col("line").alias("content"), F.when(F.col("k") % 9 == 4, "a.png").alias("image"))
    return translate.run_translation(_tokened_docs(spark, sf_dir), lift.glossary(spark), spark.createDataFrame([], "key string, text string"), translate.one_by_one(whispering), blocks=blocks)


_LETTERS_LEFT = "length(regexp_replace(left_, '[^A-Za-z]', '', 'g'))"
_SOLID, _SOLID_LEFT = (f"length(regexp_replace({c}, '{W}', '', 'g'))" for c in ("line", "left_"))
_REFS = f"""(len(list_filter(string_split({strip('line')}, chr(10)), lambda x: regexp_matches(x, '^\\s*\\[\\d+\\]\\s+\\S'))) = 1 AND regexp_matches(line, '(?i)\\b(?:19|20)\\d{{2}}\\b|arXiv|,\\s*[A-Z]\\.|\\bpp\\.\\s*\\d|\\bvol\\.\\s*\\d'))"""
SKIPS = f"""{_TOKENED}, scanned AS (SELECT *, regexp_replace(line, '{_QUOTED}', ' ', 'g') AS left_ FROM tokened),
skips AS (SELECT *, CASE WHEN {strip('line')} = '' THEN 'non-linguistic' WHEN {_REFS} THEN 'references' WHEN len(regexp_extract_all(line, '[가-힣]')) * 2 > {_SOLID} THEN 'already-korean'
  WHEN regexp_matches({strip('line')}, '^(?:arXiv:\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?\\s*)+$') THEN 'identifier'
  WHEN NOT regexp_matches(left_, '[A-Za-z]{{2,}}') OR {_SOLID_LEFT} = 0 OR {_LETTERS_LEFT} / {_SOLID_LEFT}::DOUBLE < 0.3 THEN 'non-linguistic' ELSE '' END AS reason FROM scanned)"""


@query(f"WITH {SKIPS} SELECT reason, count(*) AS n FROM skips GROUP BY reason")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.tokened(spark, sf_dir).withColumn("left", masking.residual_text(F.col("line")))
    return rows.groupBy(masking.skip_reason(F.col("line"), F.col("left")).alias("reason")).agg(F.count("*").alias("n"))


_TOKEN_PIECES = f"string_split_regex(line, '{_QUOTED}')"
_TOKEN_LIST = f"regexp_extract_all(line, '{_QUOTED}')"
_LOST = "len(list_filter(range(1, len(ts) + 1), lambda i: ends_with(ps[i], 'see ') AND regexp_matches(ts[i], '^(?:Fig|Tab|Eq|Sec|App|Alg)'))) > 0"


_PLANTED = "replace(line, '$$', '')"
_WAY = "CASE k % 4 WHEN 0 THEN ' qqalways' WHEN 1 THEN ' qqmend' ELSE '' END"
TROUBLED = f"""{_TOKENED}, troubled AS (SELECT doc_id, k, 'P ' || CASE WHEN k % 5 = 2 AND k % 4 = 2 THEN 'qqsplit ' ELSE '' END || CASE WHEN k % 7 = 5 THEN 'qqcached ' ELSE '' END || CASE WHEN k % 5 = 1 THEN 'qqinvent ' ELSE '' END
  || CASE WHEN k % 5 = 2 THEN replace({_PLANTED}, ' see Figure', {_WAY} || ' see Figure') ELSE {_PLANTED} END AS line FROM tokened)"""
REASONED = SKIPS.replace(_TOKENED, TROUBLED).replace("FROM tokened)", "FROM troubled)").replace(TROUBLED.replace("FROM tokened)", "FROM troubled)"), TROUBLED)
_SENTENCES, _ENDS = "string_split_regex(blot, '[.!?…]\\s+')", "regexp_extract_all(blot, '[.!?…]\\s+')"
#: Tokens as runs of one letter that keep their last character; where sentences end in what is left; the end nearest to the middle.
_BLOT = f"list_reduce(list_prepend('', list_transform(range(1, len(ps) + 1), lambda i: ps[i] || CASE WHEN i <= len(ts) THEN repeat('x', length(ts[i]) - 1) || right(ts[i], 1) ELSE '' END)), lambda a, b: a || b)"


OUTCOMES = f"""{REASONED}, cut AS (SELECT *, {_TOKEN_PIECES} AS ps, {_TOKEN_LIST} AS ts FROM skips), blotted AS (SELECT *, {_BLOT} AS blot FROM cut),
pieces AS (SELECT *, {_SENTENCES} AS xs, {_ENDS} AS es FROM blotted),
cuts AS (SELECT *, list_transform(range(1, len(es) + 1), lambda j: list_sum(list_transform(xs[:j], lambda x: length(x))) + list_sum(list_transform(es[:j], lambda x: length(x)))) AS at_ FROM pieces),
nearest AS (SELECT *, at_[list_position(list_transform(at_, lambda c: abs(2 * c - length(line))), list_min(list_transform(at_, lambda c: abs(2 * c - length(line)))))] AS c FROM cuts),
told AS (SELECT *, k % 5 = 2 AND k % 4 < 3 AS fails, k % 5 = 2 AND k % 4 = 2 AND c IS NOT NULL AND contains(substr(line, c::BIGINT + 1), 'see Figure') AND {strip("substr(line, c::BIGINT + 1)")} <> '' AS splits FROM nearest),
ended AS (SELECT *, CASE WHEN reason <> '' THEN 'skipped' WHEN k % 7 = 5 THEN 'cached' WHEN fails AND k % 4 <> 1 AND NOT splits THEN 'kept' ELSE 'translated' END AS status FROM told)"""


@query(f"""WITH {OUTCOMES},
sides AS (SELECT *, 'md' AS side FROM ended UNION ALL SELECT *, 'lay' FROM ended WHERE k % 9 <> 4)
SELECT doc_id, side, count(*) AS units, count(*) FILTER (status = 'translated') AS translated, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status IN ('translated', 'kept') AND fails) AS retried, count(*) FILTER (status = 'translated' AND fails AND k % 4 = 1) AS repaired, count(*) FILTER (status = 'translated' AND splits) AS split, count(*) FILTER (status = 'translated' AND k % 5 = 1) AS sanitized
FROM sides GROUP BY doc_id, side""")
def unit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each document, against a cache that has every seventh line."""
    from quire.plans import stage

    lines = stage.staged(lift.troubled(spark, sf_dir), "troubled")
    blocks = lines.filter("k % 9 <> 4").select("doc_id", F.lit(1).alias("page"), F.col("k").alias("block_no"), F.lit("text").alias("type"), F.col("line").alias("content"))
    docs = lines.groupBy("doc_id").agg(F.array_join(ordered("k", "line"), "\n\n").alias("text"))
    units, keyed = translate.prepared(docs, lift.glossary(spark), "m", blocks)
    cache = translate.Cache(spark, stage.fresh(spark, "cache"))
    cache.add(keyed.filter(F.col("src").contains("qqcached")).select("key", "src", F.upper("src").alias("text")).distinct())
    outcome = translate.settled(units, keyed, cache, translate.one_by_one(careless))
    sides = outcome.withColumn("doc_id", F.struct("doc_id", F.substring_index("unit_id", ":", 1).alias("side")))
    return translate.report(sides).select("doc_id.*", "units", "translated", "cached", "kept", "skipped", *[F.col(c).cast("long").alias(c) for c in translate.COUNTS])


_COUNTED = (*((n, "'" + x.replace("\n", "' || chr(10) || '") + "'", len(x)) for n, x in evaluate.COUNTED.items()),)
_LOW = "list_reduce(list_prepend('', list_transform(range(1, len(ps) + 1), lambda i: lower(ps[i]) || coalesce(ts[i], ''))), lambda a, b: a || b)"
EVALUATED = f"""{OUTCOMES}, said AS (SELECT *, 'md:0:' || k AS unit_id, CASE status WHEN 'cached' THEN 'C ' || line WHEN 'translated' THEN
    CASE WHEN splits THEN regexp_replace(left({_LOW}, c::BIGINT), '{W}+$', '') || ' ' || regexp_replace(substr({_LOW}, c::BIGINT + 1), '^{W}+', '') ELSE {_LOW} || CASE WHEN k % 5 = 1 THEN '(' ELSE '' END END ELSE line END AS text FROM ended),
whole AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY k) AS s, string_agg(text, chr(10) || chr(10) ORDER BY k) AS r FROM said GROUP BY doc_id),
counted AS ({" UNION ALL ".join(f"SELECT doc_id, {_times('s', x, z)} AS a, {_times('r', x, z)} AS b FROM whole" for _, x, z in _COUNTED)} UNION ALL SELECT doc_id, 0, {pattern_count('r', '<[mkgucft][0-9]+')} FROM whole),
hard AS (SELECT doc_id, count(*) FILTER (a = b AND a > 0) AS passed, count(*) FILTER (a > 0 OR b > 0) AS checks FROM counted GROUP BY doc_id),
process AS (SELECT doc_id, {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("translated", "cached", "kept", "skipped"))}, count(*) FILTER (status IN ('translated', 'kept') AND fails) AS retried, count(*) FILTER (status = 'translated' AND fails AND k % 4 = 1) AS repaired,
  count(*) FILTER (status = 'translated' AND splits) AS split, count(*) FILTER (status = 'translated' AND k % 5 = 1) AS sanitized FROM said GROUP BY doc_id),
found AS (SELECT *, regexp_replace(text, '{_QUOTED}', ' ', 'g') AS plain FROM said WHERE status IN ('cached', 'translated')),
quality AS (SELECT doc_id, count(*) AS found, sum({pattern_count('plain', '[가-힣]')}) AS hangul, sum(length(regexp_replace(plain, '{W}', '', 'g'))) AS solid, sum({pattern_count('text', 'e[.]')}) AS endings FROM found GROUP BY doc_id),
scanned_ AS (SELECT doc_id, k, line, left_ AS scan FROM said WHERE status IN ('cached', 'translated')), hits AS ({_hits_sql('scan')}),
bad AS (SELECT h.doc_id, f.unit_id, src, ko, policy, row_number() OVER (PARTITION BY h.doc_id ORDER BY src, f.unit_id) AS nth FROM hits h JOIN found f USING (doc_id, k) WHERE CASE WHEN policy = 'A' THEN NOT contains(lower(f.text), lower(ko)) ELSE NOT contains(f.text, ko) END),
violated AS (SELECT doc_id, count(*) AS violations, string_agg('- [' || policy || '] ' || unit_id || ' ' || src || ' -> ' || ko, chr(10) ORDER BY nth) FILTER (nth <= 12) AS shown FROM bad GROUP BY doc_id),
report AS (SELECT doc_id, passed, checks, passed = checks AS hard_ok, translated + cached + kept AS total, translated, cached, kept, skipped, retried, repaired, split, sanitized, coalesce(found, 0) AS found, 0 AS unverified, coalesce(endings, 0) AS endings, coalesce(violations, 0) AS violations,
  CASE WHEN coalesce(solid, 0) > 0 THEN round(hangul / solid::DOUBLE, 6) ELSE 0 END AS hangul_ratio, shown FROM hard JOIN process USING (doc_id) LEFT JOIN quality USING (doc_id) LEFT JOIN violated USING (doc_id))"""
_SAID = lambda *names: " || ', ' || ".join(f"'{n} ' || {n}" for n in names)


@query(f"""WITH {EVALUATED} SELECT doc_id, passed, checks, hard_ok, total, found, unverified, endings::BIGINT AS endings, violations, hangul_ratio,
  concat_ws(chr(10), CASE WHEN hard_ok THEN 'PASS ' ELSE 'FAIL ' END || passed || '/' || checks, {_SAID("total", "translated", "cached", "kept", "skipped", "retried", "repaired", "split", "sanitized")}, {_SAID("found", "unverified", "endings::BIGINT").replace("'endings::BIGINT ", "'endings ")},
  'hangul ' || printf('%.1f', hangul_ratio * 100) || ' %', 'violations ' || violations, shown, CASE WHEN violations > 12 THEN '... ' || (violations - 12) || ' more' END) AS summary FROM report""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over documents, scored: invariants of sources and results, what the run did, what is found again in its cache, and a summary with the first violations of the glossary."""
    from quire.plans import stage

    lines = stage.staged(lift.troubled(spark, sf_dir), "troubled")
    docs = stage.staged(lines.groupBy("doc_id").agg(F.array_join(ordered("k", "line"), "\n\n").alias("text")), "documents")
    units, keyed = translate.prepared(docs, lift.glossary(spark), "m")
    cache = translate.Cache(spark, stage.fresh(spark, "cache"))
    cache.add(keyed.filter(F.col("src").contains("qqcached")).select("key", "src", F.concat(F.lit("C "), "src").alias("text")).distinct())
    outcome = translate.settled(units, keyed, cache, translate.one_by_one(careless))
    replay = stage.staged(evaluate.replayed(units, keyed, cache.read(), outcome.filter("status = 'kept'")), "replay")
    hits = stage.staged(glossary.term_hits(units.filter("reason = ''").select("doc_id", "unit_id", masking.residual_text(F.col("src")).alias("scan")), lift.glossary(spark)), "hits")
    pairs = docs.select("doc_id", F.col("text").alias("source")).join(translate.assembled(docs, outcome).withColumnRenamed("text", "result"), "doc_id")
    report = stage.staged(evaluate.evaluation(pairs, outcome, replay, hits, "e[.]"), "report")
    said = evaluate.summary(report, evaluate.violations(hits, replay.filter("status = 'found'")))
    return report.select("doc_id", "passed", "checks", "hard_ok", "total", "found", "unverified", "endings", "violations", "hangul_ratio").join(said, "doc_id")


@query(f"WITH {REASONED} SELECT count(DISTINCT line) AS calls, 0::BIGINT AS calls_again FROM skips WHERE reason = '' AND k % 5 <> 2")
def cache_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a run, and of a second one that finds the cache of the first: one for each distinct text, then none."""
    from quire.plans import stage

    lines = lift.troubled(spark, sf_dir).filter("k % 5 <> 2")
    blocks = lines.select("doc_id", F.lit(1).alias("page"), F.col("k").alias("block_no"), F.lit("text").alias("type"), F.col("line").alias("content"))
    units, keyed = translate.prepared(blocks.select("doc_id", F.lit("").alias("text")).distinct(), lift.glossary(spark), "m", blocks)
    cache = translate.Cache(spark, stage.fresh(spark, "cache"))
    runs = [translate.settled(units, keyed, cache, translate.one_by_one(careless)) for _ in range(2)]
    asked = [o.filter("status in ('translated', 'kept')").select("ask", F.lit(n).alias("run")).distinct() for n, o in enumerate(runs)]
    return asked[0].unionByName(asked[1]).agg(F.count_if(F.col("run") == 0).alias("calls"), F.count_if(F.col("run") == 1).alias("calls_again"))


@query(f"""WITH {SKIPS}, cut AS (SELECT *, {_TOKEN_PIECES} AS ps, {_TOKEN_LIST} AS ts FROM skips)
SELECT doc_id, 1 AS page, k AS block_no, 'text' AS type, CASE WHEN k % 9 <> 4 AND reason = '' AND NOT {_LOST} THEN list_reduce(list_prepend('', list_transform(range(1, len(ps) + 1), lambda i: replace(lower(ps[i]), '$$', '') || coalesce(ts[i], ''))), lambda a, b: a || b) ELSE line END AS content,
  CASE WHEN k % 9 = 4 THEN 'a.png' END AS image FROM cut""")
def translated_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _translation(spark, sf_dir)[1]


@query(f"WITH {_TOKENED} SELECT doc_id, 'lay:1:' || k AS unit_id, 'text' AS kind, 1 AS page, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS unit_seq, line AS src FROM tokened WHERE k % 9 <> 4 AND {strip('line')} <> ''")
def layout_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import segment

    k = F.col("k")
    blocks = lift.tokened(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), k.alias("block_no"), F.lit("text").alias("type"), F.col("line").alias("content"), F.when(k % 9 == 4, "a.png").alias("image"))
    return segment.layout_units(blocks)


@query(f"""WITH {REASONED}, cut AS (SELECT *, {_TOKEN_PIECES} AS ps, {_TOKEN_LIST} AS ts FROM skips),
new AS (SELECT doc_id, k, CASE WHEN reason = '' AND NOT {_LOST} THEN list_reduce(list_prepend('', list_transform(range(1, len(ps) + 1), lambda i: lower(ps[i]) || coalesce(ts[i], ''))), lambda a, b: a || b) ELSE line END AS line FROM cut)
SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY k) AS text FROM new GROUP BY doc_id""")
def translated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one paragraph a line: what is language is in lower case outside its tokens, the rest as it was."""
    docs = lift.troubled(spark, sf_dir).groupBy("doc_id").agg(F.array_join(ordered("k", "line"), "\n\n").alias("text"))
    return translate.run_translation(docs, lift.glossary(spark), spark.createDataFrame([], "key string, text string"), translate.one_by_one(whispering))[0]


_KINDS_SQL = " ".join(f"WHEN regexp_full_match(t, '(?s){re2(p).replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in masking.TOKENS)
_SHOWN = f"""left({strip("regexp_replace(ts[i], '[\"''" + chr(92) + "n" + chr(92) + "r<>]', '', 'g')")}, 12)"""


@query(f"""WITH {_TOKENED}, cut AS (SELECT doc_id, k, {_TOKEN_PIECES} AS ps, {_TOKEN_LIST} AS ts FROM tokened),
named AS (SELECT *, list_transform(range(1, len(ts) + 1), lambda i: list_transform([ts[i]], lambda t: CASE {_KINDS_SQL} END)[1] || i) AS ns FROM cut)
SELECT doc_id, k, list_reduce(list_prepend('', list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce('<' || ns[i] || ' v="' || {_SHOWN} || '"/>', ''))), lambda a, b: a || b) AS masked,
  array_to_string(list_sort(ns), ',') AS ids, array_to_string(ts, chr(31)) AS tokens FROM named""")
def mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.tokened(spark, sf_dir).select("doc_id", "k", masking.mask_tokens(F.col("line")).alias("m"))
    return rows.select("doc_id", "k", "m.masked", F.array_join(F.array_sort(F.map_keys("m.held")), ",").alias("ids"), F.array_join(F.map_values("m.held"), "\x1f").alias("tokens"))


@query(f"""WITH {_TOKENED}, cut AS (SELECT doc_id, k, line, {_TOKEN_LIST} AS ts FROM tokened)
SELECT doc_id, k, CASE WHEN k % 4 = 1 THEN line || ' ' || coalesce(ts[1], '<x1/>') ELSE line END AS text, 0 AS missing, CASE WHEN k % 4 = 1 AND len(ts) > 0 THEN 1 ELSE 0 END AS twice FROM cut""")
def unmask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth line shows its first placeholder twice, loosely written."""
    k = F.col("k")
    rows = lift.tokened(spark, sf_dir).select("doc_id", "k", masking.mask_tokens(F.col("line")).alias("m"))
    first = F.coalesce(F.concat(F.lit("< "), F.get(F.map_keys("m.held"), F.lit(0)), F.lit(" >")), F.lit("<x1/>"))
    rows = rows.select("doc_id", "k", masking.unmask_tokens(F.when(k % 4 == 1, F.concat("m.masked", F.lit(" "), first)).otherwise(F.col("m.masked")), F.col("m.held")).alias("u"))
    return rows.select("doc_id", "k", "u.text", F.size("u.missing").alias("missing"), F.size("u.twice").alias("twice"))


_RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_MARKED = f"replace(replace(text, ' ', ' \\( '), '.', '.' || {_RULE}) || '\\[ x ![](a) <table><td><td>'"


_SEVEN = (("pages", _RULE, 7), ("inline_math", "'\\('", 2), ("display_math", "'\\['", 2), ("images", "'!['", 2), ("cells", "'<td'", 3), ("tables", "'<table'", 6))


@query(f"""WITH pairs AS (SELECT doc_id, {_MARKED} AS s, replace(replace({_MARKED}, 'the \\(', 'the ('), '<td><td>', '<td>') || '<m1' AS r FROM documents),
counts AS ({" UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, {_times('s', x, z)} AS expected, {_times('r', x, z)} AS found FROM pairs" for n, x, z in _SEVEN)}
  UNION ALL SELECT doc_id, 'placeholders', 0, {pattern_count('r', '<[mkgucft][0-9]+')} FROM pairs)
SELECT doc_id, name, expected::BIGINT AS expected, found::BIGINT AS found, expected = found AS ok, expected = 0 AND found = 0 AS na FROM counts""")
def count_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.replace(F.replace("text", F.lit(" "), F.lit(" \\( ")), F.lit("."), F.lit(".\n\n---\n\n")), F.lit("\\[ x ![](a) <table><td><td>"))
    pairs = lift.table(spark, sf_dir, "documents").select("doc_id", source.alias("source"))
    result = F.concat(F.replace(F.replace("source", F.lit("the \\("), F.lit("the (")), F.lit("<td><td>"), F.lit("<td>")), F.lit("<m1"))
    return evaluate.invariants(pairs.withColumn("result", result))


@query(f"WITH {BLOCKS} SELECT doc_id, page, block_no FROM blocks WHERE (doc_id + block_no) % 5 = 0")
def layout_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = layout.parse_blocks(lift.raw_pages(spark, sf_dir)).select("doc_id", "page", "block_no", "type", "bbox", "content")
    moved = F.when((F.col("doc_id") + F.col("block_no")) % 5 == 0, F.transform("bbox", lambda v: v + 1)).otherwise(F.col("bbox"))
    return evaluate.layout_diff(before, before.withColumn("bbox", moved).withColumn("content", F.upper("content")))


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def bench_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.upsert(lift.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query()
def greedy_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lift.box(lift.lines(spark, sf_dir)).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "bbox"))), lambda r: r["bbox"]).alias("truth"))
    found = F.transform("truth", lambda b, i: F.array(b[0] + i, b[1], b[2] + i, b[3] + i))
    return rows.select("doc_id", "page", geometry.greedy_iou(found, F.col("truth")).alias("iou"))


# Jobs

_STATUS = "CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'error' END"


@query(f"SELECT event_id AS id, {_STATUS} AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_jobs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.newest(lift.jobs(spark, sf_dir)).select("id", "status")


@query("SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events WHERE event_id % 4 = 0")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_positions(lift.jobs(spark, sf_dir)).select("id", "position")


@query("""SELECT event_id AS id FROM events WHERE event_id % 4 >= 2 AND greatest(ts, CASE WHEN event_id % 4 = 2 THEN ts + INTERVAL 1 HOUR ELSE ts END) < TIMESTAMP '2024-01-15'
AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 5 = 0)""")
def ttl_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lift.table(spark, sf_dir, "events")
    signed = events.filter("event_type = 'signup' and user_id % 5 = 0").select(F.col("user_id").alias("owner")).distinct()
    rows = lift.jobs(spark, sf_dir)
    protected = rows.join(signed, "owner", "left_semi").select("id")
    return jobs.expired(rows, F.lit("2024-01-15").cast("timestamp"), protected).select("id")


@query(f"SELECT CASE WHEN event_id % 4 < 2 THEN 'error' ELSE {_STATUS} END AS status, count(*) AS n FROM events GROUP BY 1")
def restart_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.restarted(lift.jobs(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files a job: by rule an image, a note or a layout."""
    e = lift.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    k = F.col("id") % 5
    first = F.struct(F.when(k < 2, "images").when(k == 2, "pages").otherwise("").alias("folder"), F.when(k == 3, "layout.json").when(k == 1, "boxes.json").otherwise(F.concat(F.lit("b"), k.cast("string"), F.lit(".PNG"))).alias("name"))
    return e.select("id", F.explode(F.array(first, F.struct(F.lit("images").alias("folder"), F.lit("a.jpg").alias("name")))).alias("f")).select("id", "f.*")


_URL = "'/api/jobs/' || event_id"


@query(f"""WITH jobs AS (SELECT event_id, ts, {_STATUS} AS status, event_id % 5 AS k FROM events), line AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM jobs WHERE status = 'queued')
SELECT event_id AS id, status, CASE WHEN status = 'done' THEN {_URL} || '/markdown' END AS markdown_url, CASE WHEN status = 'done' THEN {_URL} || '/files/images/a.jpg' || CASE WHEN k = 0 THEN ',' || {_URL} || '/files/images/b0.PNG' ELSE '' END END AS images,
  CASE WHEN status = 'done' THEN CASE WHEN k = 2 THEN {_URL} || '/files/pages/b2.PNG' ELSE '' END END AS pages, CASE WHEN status = 'done' THEN k = 3 END AS has_layout, place AS queue_position FROM jobs LEFT JOIN line USING (event_id)""")
def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.records(lift.jobs(spark, sf_dir), _files(spark, sf_dir))
    return out.select("id", "status", "markdown_url", F.array_join("images", ",").alias("images"), F.array_join("pages", ",").alias("pages"), "has_layout", "queue_position")


@query(f"SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'ko ' || event_id END AS text, event_id % 4 <> 2 AS partial, event_id % 3 = 0 AS found FROM events")
def shown_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs_ = lift.jobs(spark, sf_dir)
    texts = jobs_.select("id", F.lit("md").alias("text"))
    done = jobs_.filter("id % 3 = 0").select("id", F.explode(F.array(F.lit("ko"), F.lit("xx"))).alias("lang")).withColumn("text", F.concat_ws(" ", "lang", "id"))
    return records.shown_text(jobs_, texts, done, "ko")


@query(f"SELECT event_id AS id, {_STATUS} AS status, user_id % 7 = 0 AS delete_requested FROM events WHERE user_id % 7 <> 0 OR event_id % 4 = 1")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs_ = lift.jobs(spark, sf_dir)
    stay, _ = records.deleted(jobs_, jobs_.select("id", F.lit("ko").alias("lang")), jobs_.filter("owner % 7 = 0").select("id"))
    return stay.select("id", "status", "delete_requested")


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'running' ELSE 'error' END ELSE 'done' END AS status FROM events")
def settled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lift.table(spark, sf_dir, "events")
    states = events.select(F.col("event_id").alias("id"), F.lit("ko").alias("lang"), F.when(F.col("event_id") % 2 == 0, "running").otherwise("done").alias("status"))
    alive = events.filter("user_id % 2 = 0").select(F.col("event_id").alias("id"), F.lit("ko").alias("lang"))
    return records.settled(states, alive).select("id", "status")


@query(f"WITH {LINES} SELECT doc_id, bool_and(length(line) < 40) AS failed FROM lines GROUP BY doc_id")
def all_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.all_failed(lift.lines(spark, sf_dir).select("doc_id", (F.length("line") < 40).alias("failed")))


@query("SELECT event_type AS engine, count(*) AS pages, round(count(*) / 7::DOUBLE, 3) AS pages_per_s, round(7 / count(*)::DOUBLE, 1) AS avg_page_s FROM events GROUP BY event_type")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = lift.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("engine")).agg(F.count("*").alias("pages")).withColumn("seconds", F.lit(7.0))
    return records.throughput(runs).select("engine", "pages", "pages_per_s", "avg_page_s")


@query("SELECT event_id AS id, least(30000, (event_id % 6 + 1) * 10000) AS delay, greatest(event_id % 9, CASE WHEN event_id % 2 = 0 THEN event_id % 11 - 1 ELSE event_id % 11 END) AS number FROM events")
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return lift.table(spark, sf_dir, "events").select(e.alias("id"), records.retry_delay(e % 6).alias("delay"), records.resynced(e % 9, e % 11, e % 2 == 0).alias("number"))


# Segments and rendering

@query()
def segment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import segment

    return segment.segment(merge.documents(merge.chunk_pages(lift.chunks(spark, sf_dir))).withColumnRenamed("markdown", "text"))


@query(f"""WITH {TROUBLED} SELECT doc_id, string_agg(CASE k % 3 WHEN 0 THEN 'new ' || k WHEN 1 THEN '⸻' || chr(10) || 'ruled' ELSE line END, chr(10) || chr(10) ORDER BY k) AS text FROM troubled GROUP BY doc_id""")
def segment_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one paragraph a line: every third unit is replaced, every third by a text with a rule and blank lines around it, every third stays."""
    from quire.operators import segment

    docs = lift.troubled(spark, sf_dir).groupBy("doc_id").agg(F.array_join(ordered("k", "line"), "\n\n").alias("text"))
    told = F.when(F.col("n") % 3 == 0, F.concat(F.lit("new "), F.col("n").cast("string"))).when(F.col("n") % 3 == 1, "\n \n---\nruled\n")
    units = segment.segment(docs).withColumn("n", F.substring_index("unit_id", ":", -1).cast("int")).withColumn("new", segment.tidy(told)).filter("new is not null")
    new = units.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "new"))).alias("new"))
    return docs.join(new, "doc_id", "left").select("doc_id", segment.assembled("text", "new").alias("text"))


_GLUED = "lambda a, b: a || b"


def _put(source: str, pattern: str, mark: str, more: str = "") -> str:
    """A step over (doc_id, t, …): each match m of the pattern, the i-th, replaced by mark; more names further columns, in which ms are the matches."""
    pattern = pattern.replace("'", "''")
    inner = f"SELECT *, string_split_regex(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}') AS ms FROM {source}"
    marks = f"list_transform(ms, lambda m, i: {mark})"
    return f"(SELECT * EXCLUDE (ps, ms, t), list_reduce(list_prepend('', list_transform(range(1, len(ps) + 1), lambda j: ps[j] || coalesce({marks}[j], ''))), {_GLUED}) AS t{more} FROM ({inner}))"


_TEX = strip("m[3:-3]")
_TEX1 = strip("m[2:-2]")
_IS_MATH = f"(regexp_matches({_TEX1}, '[\\\\^_{{}}]') OR ({_TEX1} <> '' AND length({_TEX1}) <= 40 AND NOT regexp_matches({_TEX1}, '^\\p{{Nd}}')))"
_DISPLAY = f"CASE WHEN {_TEX} = '' THEN '' ELSE chr(10) || chr(10) || '$$' || chr(10) || {_TEX} || chr(10) || '$$' || chr(10) || chr(10) END"
_SPLIT = "string_split(replace(t, chr(2), chr(1)), chr(1))"


def _restored(source: str, kinds: dict[str, str]) -> str:
    """Marks of these kinds as the texts that a column holds for them, other marks as they are."""
    cases = " ".join(f"WHEN p[1] = '{k}' THEN {c}[p[2:]::INT]" for k, c in kinds.items())
    return f"(SELECT * REPLACE (list_reduce(list_transform({_SPLIT}, lambda p, i: CASE WHEN i % 2 = 1 THEN p {cases} ELSE chr(1) || p || chr(1) END), {_GLUED}) AS t) FROM {source})"


_MATHY = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in lift.MATHY) + "]"


@query(f"""WITH {LINES}, raw AS (SELECT doc_id, string_agg(line || {_MATHY}[k % 9 + 1], chr(10) ORDER BY k) AS t FROM lines GROUP BY doc_id),
coded AS {_put("raw", "(?ms)^```.*?^```[ \\t]*$|^~~~.*?^~~~[ \\t]*$|`[^`\\n]+`", "chr(1) || 'c' || i || chr(1)", ", ms AS codes")},
displayed AS {_put("coded", "(?s)\\$\\$.+?\\$\\$", "chr(2) || 'd' || i || chr(2)", f", list_transform(ms, lambda m: {_DISPLAY}) AS displays")},
inlined AS {_put("displayed", "\\$[^$\\n\\x02]+?\\$", f"CASE WHEN {_IS_MATH} THEN chr(1) || 'i' || i || chr(1) ELSE m END", f", list_transform(ms, lambda m: '$' || {_TEX1} || '$') AS inlines")},
escaped AS (SELECT * REPLACE (replace(t, '$', '\\$') AS t) FROM inlined),
blocks AS {_put("escaped", "(?s)\\\\\\[.+?\\\\\\]", _DISPLAY)},
spans AS {_put("blocks", "(?s)\\\\\\(.+?\\\\\\)", f"CASE WHEN {_TEX} = '' THEN '' ELSE '$' || {_TEX} || '$' END")},
maths AS {_restored("spans", {"d": "displays", "i": "inlines"})}
SELECT doc_id, t AS text FROM {_restored("maths", {"c": "codes"})}""")
def math_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import render

    return lift.mathy(spark, sf_dir).select("doc_id", render.math_normalized(F.col("text")).alias("text"))


_LONG = "x" * 301
_HEAD, _TAIL = '<table border="1" onload="x"><tr data-colspan="4" colspan="2"><TD><td style="a" rowspan="3" colspan="12345" colspan="7"/><th\n class="y">', f'</td ></tr></table><threshold><td {_LONG}><thead /><tbody colspan=2><'
_ESCAPED_SQL = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(rf"""WITH {LINES}, raw AS (SELECT doc_id, k, {_ESCAPED_SQL(f"'{_HEAD}' || line || '{_TAIL}'")} AS t FROM lines),
cut AS (SELECT doc_id, k, i, segs[i] AS seg, i = len(segs) AS last FROM (SELECT *, string_split(t, '&gt;') AS segs FROM raw), unnest(range(1, len(segs) + 1)) u(i)),
split_ AS (SELECT *, string_split(seg, '&lt;')[-1] AS c FROM cut),
read_ AS (SELECT *, contains(seg, '&lt;') AND NOT last AND regexp_matches(c, '^/?(?:table|thead|tbody|tr|th|td)(?:[\s/]|$)') AS named, regexp_replace(regexp_replace(c, '^/?(?:table|thead|tbody|tr|th|td)', ''), '\s*/?$', '') AS attributes FROM split_),
told AS (SELECT *, named AND length(attributes) <= 300 AND NOT contains(attributes, chr(10)) AS tag, regexp_extract(c, '^/?(?:table|thead|tbody|tr|th|td)') AS name FROM read_),
put AS (SELECT *, CASE WHEN last THEN seg WHEN tag THEN left(seg, length(seg) - length(c) - 4) || '<' || name || CASE WHEN c[1] = '/' THEN '' ELSE coalesce(list_reduce(list_prepend('', list_transform(regexp_extract_all(attributes, '\s(?:colspan|rowspan)=&quot;\d{{1,3}}&quot;'), lambda x: ' ' || replace(trim(x), '&quot;', '"'))), {_GLUED}), '') END || '>' ELSE seg || '&gt;' END AS x FROM told)
SELECT doc_id, k, string_agg(x, '' ORDER BY i) AS html FROM put GROUP BY doc_id, k""")
def table_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import render

    return lift.lines(spark, sf_dir).select("doc_id", "k", render.tables_restored(F.concat(F.lit(_HEAD), "line", F.lit(_TAIL))).alias("html"))


@query(f"""WITH {LINES}, pages AS (SELECT doc_id, k // 6 AS p, string_agg(line, chr(10) ORDER BY k) AS md FROM lines GROUP BY ALL)
SELECT doc_id, string_agg('<section data-page="' || p + 1 || '">' || md || '</section>', chr(10) ORDER BY p) AS html FROM pages GROUP BY doc_id""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import render

    rows = lift.box(lift.lines(spark, sf_dir)).groupBy("doc_id", "page").agg(F.array_join(ordered("k", "line"), "\n").alias("md"))
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "md"))), lambda r: r["md"]), "\x01PAGE\x01").alias("md"))
    return whole.select("doc_id", render.sections(F.col("md"), "\x01PAGE\x01").alias("html"))


_PREVIEW_LABELS = "[" + ", ".join(f"'{x}'" for x in lift.PREVIEW_LABELS) + "]"
#: Every tag owns the text up to the next one, which is its line; the rules of the preview, tag by tag.
PREVIEW = f"""{LINES}, labelled AS (SELECT doc_id, k, k // 6 + 1 AS page, k % 7 = 3 AS is_ref, {_PREVIEW_LABELS}[k % 9 + 1] AS label, line FROM lines),
owned AS (SELECT *, replace(lower(label), '-', '_') AS key, {strip("CASE WHEN lower(label) = 'title' AND k % 2 = 1 THEN replace(line, ' ', chr(10)) ELSE line END")} AS body FROM labelled),
parts AS (SELECT doc_id, page, k, 0 AS side, '> 🖼 그림 감지됨' AS part FROM owned WHERE key = 'image'
  UNION ALL SELECT doc_id, page, k, 1, CASE WHEN NOT is_ref AND key = 'title' THEN '## ' || regexp_replace(body, '\\s*\\n+\\s*', ' ', 'g') ELSE body END FROM owned WHERE body <> '' AND (is_ref OR key NOT IN ('page_number', 'header', 'footer', 'footnote'))),
shown AS (SELECT doc_id, page, string_agg(part, chr(10) || chr(10) ORDER BY k, side) AS md FROM parts GROUP BY doc_id, page)"""


@query(f"""WITH {PREVIEW} SELECT doc_id, coalesce(string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page), '') AS preview FROM documents LEFT JOIN shown USING (doc_id) GROUP BY doc_id""")
def structure_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import render

    raw = lift.tagged_pages(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "raw"))), lambda r: r["raw"]), "<PAGE>").alias("raw"))
    return raw.select("doc_id", render.preview(F.col("raw")).alias("preview"))


# Streams

@query()
def stream_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in deltas, some with a page marker behind every sentence and two pages expected, some of which each character costs tokens."""
    from quire.streaming import detector, pages, run

    d = F.col("doc_id")
    docs = run.source(spark, sf_dir, "documents").select("doc_id", F.when(d % 7 == 3, F.replace("text", F.lit(". "), F.lit(".<PAGE>"))).otherwise(F.col("text")).alias("text"))
    deltas = pages.deltas_of(docs).withColumn("tokens", F.when(d % 5 == 1, F.length("delta") * 2).otherwise(0)).withColumn("expected", F.when(d % 7 == 3, 2).otherwise(0))
    out = run.drained(detector.detect(deltas), "update")
    return out.groupBy("doc_id").agg(F.max_by(F.struct("n_chars", "reason"), "batch").alias("r")).select("doc_id", "r.*")


@query(f"WITH {BOXED} SELECT doc_id, label, count(*) AS n FROM boxed WHERE x2 > x1 AND y2 > y1 GROUP BY ALL")
def stream_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.streaming import pages, run

    docs = run.source(spark, sf_dir, "documents")
    rows = lift.box(docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("k", "line")))
    tag = F.concat(F.lit("<|det|>"), F.col("label"), F.lit(" ["), F.array_join(F.col("bbox").cast("array<string>"), ", "), F.lit("]<|/det|>"), F.col("line"))
    # each tag comes in three pieces, cut inside
    cuts = F.array(F.struct((F.col("k") * 3).alias("seq"), F.substring(tag, F.lit(1), F.lit(9)).alias("delta")), F.struct((F.col("k") * 3 + 1).alias("seq"), F.substring(tag, F.lit(10), F.lit(11)).alias("delta")), F.struct((F.col("k") * 3 + 2).alias("seq"), F.substring(tag, F.lit(21), F.length(tag)).alias("delta")))
    deltas = rows.select("doc_id", F.explode(cuts).alias("d")).select("doc_id", "d.seq", "d.delta")
    return run.drained(pages.stream_boxes(deltas), "append").groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, least(greatest(1, max(k // 6)), 50)::INT AS page FROM lines GROUP BY doc_id")
def stream_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.streaming import pages, run

    docs = run.source(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("k", "line"))
    kind = F.when(F.col("k") % 6 == 0, F.when(F.col("k") == 0, "announce").otherwise("marker")).otherwise("token")
    events = docs.select("doc_id", F.col("k").alias("seq"), kind.alias("kind"), F.lit(1).alias("page"))
    out = run.drained(pages.progress(events, 50), "update")
    return out.groupBy("doc_id").agg(F.max("page").alias("page"))


def _raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.tagged_pages(spark, sf_dir).groupBy("doc_id").agg(F.array_join(ordered("page", "raw"), "<PAGE>").alias("text"))


@query(f"""WITH {PREVIEW}, counted AS (SELECT doc_id, (max(k) // 6 + 1)::INT AS n_pages FROM lines GROUP BY doc_id)
SELECT doc_id, n_pages, n_pages AS n_rows, coalesce(string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page), '') AS preview FROM counted LEFT JOIN shown USING (doc_id) GROUP BY doc_id, n_pages""")
def stream_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas come in four batches, those of a document in any of them; put together, its pages are the preview of the whole, and each came once."""
    from quire.streaming import pages, preview, run

    out = run.drained(preview.preview(run.staged(pages.deltas_of(_raw_documents(spark, sf_dir)), 4, "seq")), "append").filter("kind = 'page'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ruled", "md"))), lambda r: F.concat(F.when(r["ruled"], "\n\n---\n\n").otherwise(""), r["md"])), "")
    return out.groupBy("doc_id").agg(F.countDistinct("page").cast("int").alias("n_pages"), F.count("*").cast("int").alias("n_rows"), text.alias("preview"))


@query(f"""WITH {LINES}, pages AS (SELECT doc_id, k // 6 AS p, string_agg(line, chr(10) ORDER BY k) AS md FROM lines GROUP BY ALL),
whole AS (SELECT doc_id, string_agg(md, '<PAGE>' ORDER BY p) AS text, count(*) - 1 AS markers FROM pages GROUP BY doc_id)
SELECT doc_id, length(text) AS n_chars, markers::INT AS page, md5(text) AS text_md5, true AS whole FROM whole WHERE text <> ''""")
def stream_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of 60 characters as events: their texts in order are the document, all markers are counted, none is cut, and only the last event is short."""
    from quire.streaming import coalesce, pages, run

    rows = lift.box(lift.lines(spark, sf_dir)).groupBy("doc_id", "page").agg(F.array_join(ordered("k", "line"), "\n").alias("md"))
    docs = rows.groupBy("doc_id").agg(F.array_join(ordered("page", "md"), "<PAGE>").alias("text"))
    out = run.drained(coalesce.coalesced(run.staged(pages.deltas_of(docs, 60), 3, "seq")), "append", timed=True)
    good = (F.length("text") >= 256) | (F.col("why") != "size")
    text = F.array_join(ordered("event", "text"), "")
    uncut = (F.sum(((F.length("text") - F.length(F.replace("text", F.lit("<PAGE>"), F.lit("")))) / 6).cast("int")) == F.max("page")) & F.every(good)
    return out.groupBy("doc_id").agg(F.max("page").alias("page"), text.alias("text"), uncut.alias("whole")).select("doc_id", F.length("text").cast("long").alias("n_chars"), "page", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "whole")


@query("""WITH touched AS (SELECT event_id AS id, CASE event_id % 4 WHEN 2 THEN 'done' WHEN 3 THEN 'error' ELSE 'running' END AS status, CASE WHEN event_id % 4 = 2 THEN ts + INTERVAL 1 HOUR ELSE ts END AS last FROM events)
SELECT id, status FROM touched WHERE status <> 'running' AND epoch_ms(last) + 7 * 86400000 < (SELECT max(epoch_ms(last)) FROM touched)""")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as touches of jobs; translations touch every fourth once more, an hour later."""
    from quire.streaming import expiry, run

    kind, ts = F.pmod(F.col("event_id"), F.lit(4)), F.col("ts").cast("timestamp")
    own = F.struct(ts.alias("at"), F.when(kind == 2, "done").when(kind == 3, "error").otherwise("running").alias("status"))
    later = F.struct((ts + F.expr("interval 1 hour")).alias("at"), F.lit(None).cast("string").alias("status"))
    touches = run.source(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.explode(F.when(kind == 2, F.array(own, later)).otherwise(F.array(own))).alias("t")).select("id", "t.*")
    return run.drained(expiry.expired(touches, F.expr("interval 7 days")), "append").select("id", "status")


@query(f"WITH {BOXED} SELECT doc_id, count(*) AS n, count(*) AS last FROM boxed WHERE x2 > x1 AND y2 > y1 GROUP BY doc_id")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a stream that breaks off in its second batch, behind its rows, and is started again: as many rows as boxes, numbered without a gap."""
    from quire.streaming import pages, run

    rows = lift.box(lift.lines(spark, sf_dir))
    tag = F.concat(F.lit("<|det|>"), F.col("label"), F.lit(" ["), F.array_join(F.col("bbox").cast("array<string>"), ", "), F.lit("]<|/det|>"), F.col("line"))
    deltas = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", tag.alias("x")))), lambda r: r["x"]), "\n").alias("text"))
    stream = run.staged(pages.deltas_of(deltas, 200), 4, "seq")
    sink = run.Sink(spark, run.fresh(spark, "resumed"))
    sink.run(pages.stream_boxes(stream), "append", until=1)
    sink.run(pages.stream_boxes(stream), "append")
    return sink.rows().groupBy("doc_id").agg(F.count("*").alias("n"), (F.max("n") + 1).cast("long").alias("last"))


# Routing, stores, headers

_LOOP = "".join(f"item number {i} of this long repeated line of text\n" for i in range(80))
_INERT_SQL = f"regexp_replace(array_to_string(list_transform(string_split({_INERT}, chr(10)), lambda x: regexp_replace(x, '{W}+$', '')), chr(10)), '^\\n+|\\n+$', '', 'g')"
_LAYER = "CASE WHEN regexp_matches(inert, '[\\p{L}\\p{N}]') THEN array_to_string(list_transform(string_split(CASE WHEN length(inert) > 100000 THEN left(inert, 100000) || chr(10) || '[truncated]' ELSE inert END, chr(10)), lambda x: '    ' || x), chr(10)) END"
_SHOWN_PAGE = strip("regexp_replace(text, '<\\|[^|>]{0,64}\\|>', '', 'g')")
ROUTED = f"""{LINES}, raw AS (SELECT doc_id, (k // 6 + 1)::INT AS page, string_agg(line, chr(10) ORDER BY k) AS text FROM lines GROUP BY ALL),
pages AS (SELECT *, (page - 1) // 3 AS chunk, {_INERT_SQL} AS inert FROM raw),
kinds AS (SELECT *, {_LAYER} AS layer, doc_id % 7 = 6 AS alone, (doc_id + chunk) % 6 AS kind, min(page) OVER c AS first_page, max(page) OVER c AS last_page, max(length(text)) OVER c > 16384 AS over_ FROM pages WINDOW c AS (PARTITION BY doc_id, chunk)),
chunked AS (SELECT *, CASE WHEN alone THEN 'alone' WHEN kind = 3 THEN 'lost' WHEN kind IN (2, 4) OR over_ THEN 'apart' ELSE 'read' END AS way FROM kinds),
paged AS (SELECT *, CASE WHEN way IN ('read', 'lost') THEN NULL WHEN page % 4 < 2 AND length(text) + 6 <= 16384 THEN 'single' WHEN doc_id % 2 = 0 AND layer IS NOT NULL THEN 'text_layer' ELSE 'placeholder' END AS alone_as FROM chunked)"""


@query(f"""WITH {ROUTED} SELECT doc_id, page, CASE WHEN way = 'read' THEN {_SHOWN_PAGE} WHEN alone_as = 'single' THEN {strip("'again ' || text")} WHEN alone_as = 'text_layer' THEN layer ELSE '> ⚠️ 이 페이지는 변환에 실패했습니다' END AS md,
  CASE way WHEN 'read' THEN 'multi' WHEN 'lost' THEN 'placeholder' ELSE alone_as END AS source FROM paged""")
def routed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)[0]


@query(f"""WITH {ROUTED} SELECT DISTINCT doc_id, first_page, last_page, CASE way WHEN 'lost' THEN 'placeholder' ELSE 'reread' END AS kind, way = 'lost' AS failed FROM paged WHERE way IN ('lost', 'apart')
UNION ALL SELECT doc_id, page, page, alone_as, page % 4 = 3 FROM paged WHERE alone_as <> 'single'""")
def routed_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _routed(spark, sf_dir)[1]
    return out.select("doc_id", "first_page", "last_page", "kind", F.col("detail").isin("out of memory", "no page").alias("failed"))


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of three pages, of which by rule some fail once or twice, some run away; pages likewise; text layers of every second document."""
    from quire.operators import route

    pages = lift.box(lift.lines(spark, sf_dir)).groupBy("doc_id", "page").agg(F.array_join(ordered("k", "line"), "\n").alias("md")).withColumn("chunk", F.floor((F.col("page") - 1) / 3).cast("int"))
    pages = pages.withColumn("single", F.col("doc_id") % 7 == 6)
    none, words = F.lit(None).cast("string"), lambda x: F.lit(x).alias("error")
    raw = pages.groupBy("doc_id", "chunk", "single").agg(F.min("page").alias("first_page"), F.count("*").cast("int").alias("num_pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "md"))), lambda r: F.concat(F.lit("<PAGE>"), r["md"])), "").alias("text"))
    kind, loop = (F.col("doc_id") + F.col("chunk")) % 6, F.concat("text", F.lit("\n" + _LOOP))
    first = F.when(kind.isin(1, 3, 4), none).when(kind == 2, loop).otherwise(F.col("text"))
    again = F.when(kind == 3, none).when(kind == 4, loop).otherwise(F.col("text"))
    multi = raw.filter("not single")
    multi = multi.select("doc_id", "chunk", F.lit(1).alias("attempt"), first.alias("text"), words("out of memory")).unionByName(multi.filter(kind.isin(1, 3, 4)).select("doc_id", "chunk", F.lit(2).alias("attempt"), again.alias("text"), words("out of memory")))
    turn, own = F.col("page") % 4, F.concat(F.lit("again "), "md")
    ones = pages.select("doc_id", "page", F.lit(1).alias("attempt"), F.when(turn.isin(1, 3), none).when(turn == 2, F.concat(own, F.lit("\n" + _LOOP))).otherwise(own).alias("text"), words("no page"))
    ones = ones.unionByName(pages.filter(turn.isin(1, 3)).select("doc_id", "page", F.lit(2).alias("attempt"), F.when(turn == 1, own).alias("text"), words("no page")))
    layers = pages.filter("doc_id % 2 = 0").select("doc_id", "page", F.col("md").alias("text"))
    return route.routed(raw.drop("text"), multi, ones, layers)


@query("""WITH told AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events)
SELECT user_id, event_id, value FROM told WHERE nth = 1 AND NOT (event_id % 4 = 1)""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of users' rows, later ones first; every fourth deletes its user, whom only a later event brings back."""
    from quire.plans import stage
    from quire.sources import store

    events = lift.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    own = store.Store(spark, stage.fresh(spark, "store"), events.schema, ["user_id"], "event_id", buckets=8)
    newest, kind = F.col("event_id") % 3, F.col("event_id") % 4 == 1
    for part in (2, 0, 1):
        changes = events.filter(newest == part)
        own.upsert(changes.filter(~kind))
        own.delete(changes.filter(kind).select("user_id", "event_id"))
    return own.read()


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'PNG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'JPEG' WHEN 3 THEN 'JPEG' END AS format, CASE WHEN page_id % 6 < 4 THEN (length(url) * 37 + page_id) % 9000 + 1 END AS width,
  CASE WHEN page_id % 6 < 4 THEN (length(html) * 11) % 9000 + 1 END AS height,
  CASE WHEN page_id % 6 >= 4 THEN 'format' WHEN ((length(url) * 37 + page_id) % 9000 + 1) * ((length(html) * 11) % 9000 + 1) > 60000000 THEN 'pixels' ELSE '' END AS refusal FROM pages""")
def image_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that Spark writes by rule from pages: PNG, JPEG with segments before their frame, others, cut off ones."""
    from quire.sources import images

    rows = lift.table(spark, sf_dir, "pages").select("page_id", ((F.length("url") * 37 + F.col("page_id")) % 9000 + 1).alias("w"), ((F.length("html") * 11) % 9000 + 1).alias("h"), F.length("html").alias("n"))
    word = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    kind = F.col("page_id") % 6
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(F.col("w"), 8), word(F.col("h"), 8), F.lit("0802000000"))
    comment = F.concat(F.lit("FFFE"), word(F.col("n") % 500 + 2, 4), F.repeat(F.lit("C0"), (F.col("n") % 500).cast("int")))
    head = F.concat(F.lit("FFD8"), F.lit("FFE000104A46494600010100000100010000"), comment, F.when(kind == 3, F.lit("FFFF")).otherwise(""), F.lit("FFDB0004ABCD"))
    jpeg = F.concat(head, F.lit("FFC2001108"), word(F.col("h"), 4), word(F.col("w"), 4), F.lit("03FFDA"))
    made = F.when(kind < 2, png).when(kind < 4, jpeg).when(kind == 4, F.lit("474946383961")).otherwise(F.concat(head, F.lit("FFDA")))
    files = rows.select("page_id", F.unhex(made).alias("content"))
    told = files.select("page_id", F.length("content").alias("length"), images.header(F.col("content")).alias("head"))
    return told.select("page_id", "head.*", images.refusal(F.col("length"), F.col("head")).alias("refusal"))


# Reports

@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def warning_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import reports

    return reports.histogram(lift.table(spark, sf_dir, "events"), "event_type")


@query(f"""WITH {LINES}, firsts AS (SELECT doc_id, line, min(k) AS k FROM lines GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth FROM firsts)
SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS warnings FROM ranked WHERE nth <= 40 GROUP BY doc_id""")
def warnings_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import reports

    return lift.table(spark, sf_dir, "documents").select("doc_id", F.array_join(reports.first_seen(T.lines(F.col("text"))), "\n").alias("warnings"))


@query(f"""WITH {LINES}, pages AS (SELECT doc_id, k // 6 AS p, string_agg(line, chr(10) ORDER BY k) AS md FROM lines GROUP BY ALL), last AS (SELECT doc_id, max(p) AS m FROM pages GROUP BY doc_id)
SELECT doc_id, m::INT AS n_committed, any_value(md) FILTER (p = m) AS tail FROM pages JOIN last USING (doc_id) GROUP BY doc_id, m""")
def committed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import reports

    pages = lift.box(lift.lines(spark, sf_dir)).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda r: r["line"]), "\n").alias("md"))
    raw = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "md"))), lambda r: r["md"]), "<PAGE>").alias("raw"))
    done, tail = reports.committed(F.col("raw"))
    return raw.select("doc_id", F.size(done).alias("n_committed"), tail.alias("tail"))


@query(f"""WITH {LINES}, scores AS (SELECT doc_id, CASE WHEN length(line) % 5 < 4 THEN length(line) % 5 + 1 END AS fidelity, length(line) % 3 + 2.5 AS fluency, length(line) % 4 = 0 AS omission, CASE WHEN length(line) % 7 = 0 THEN ['e' || left(line, 20)] ELSE [] END AS errors FROM lines)
SELECT doc_id, count(*) AS judged, round_even(avg(fidelity), 2) AS avg_fidelity, round_even(avg(fluency), 2) AS avg_fluency, count(*) FILTER (omission) AS omissions, array_to_string(list_sort(flatten(list(errors))), chr(10)) AS errors FROM scores GROUP BY doc_id""")
def judge_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import reports

    n = F.length("line")
    none = F.array().cast("array<string>")
    scores = lift.lines(spark, sf_dir).select("doc_id", F.when(n % 5 < 4, n % 5 + 1).alias("fidelity"), (n % 3 + F.lit(2.5)).alias("fluency"), (n % 4 == 0).alias("omission"), F.when(n % 7 == 0, F.array(F.concat(F.lit("e"), F.left("line", F.lit(20))))).otherwise(none).alias("errors"))
    return reports.judge_averages(scores, ["fidelity", "fluency"]).withColumn("errors", F.array_join("errors", "\n"))


@query(f"""WITH {LINES}, units AS (SELECT doc_id, 'md:0:' || k AS unit_id, line AS src FROM lines WHERE {strip('line')} <> ''), tall AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(src) DESC, unit_id) <= 4 AS long FROM units),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY long DESC, md5(unit_id || ':1234'), unit_id) AS place FROM tall) SELECT doc_id, unit_id, long FROM ranked WHERE place <= 12""")
def judge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import reports

    return reports.judge_sample(translate.line_units(lift.table(spark, sf_dir, "documents"))).select("doc_id", "unit_id", "long")


@query(f"WITH {LINES} SELECT doc_id, sum({pattern_count('line', 'e[.]')})::BIGINT AS n, string_agg('md:0:' || k, ',' ORDER BY 'md:0:' || k) FILTER (regexp_matches(line, 'e[.]')) AS unit_ids FROM lines GROUP BY doc_id HAVING sum({pattern_count('line', 'e[.]')}) > 0")
def ending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import reports

    units = lift.lines(spark, sf_dir).select("doc_id", F.concat(F.lit("md:0:"), F.col("k").cast("string")).alias("unit_id"), F.col("line").alias("text"))
    return reports.endings(units, "e[.]").withColumn("unit_ids", F.array_join("unit_ids", ","))
