"""Readers, writers and frame operators on small inputs with known results."""

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import text as T
from quire.operators import evaluate, geometry, glossary, jobs, layout, masking, merge, records, render, repetition, sanitize, translate
from quire.sources import readers, settings, sinks
from tests.plain import mask, unmask


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def drawn_pages(spark, documents, pages):
    kinds = ("title", "text", "table", "image")
    raw = lambda page: "".join(f"<|det|>{k} [60, {n * 200 + 40}, 940, {n * 200 + 200}]<|/det|>Block {n} of page {page}\n" for n, k in enumerate(kinds))
    return spark.createDataFrame([(d, p, raw(p)) for d in range(documents) for p in range(1, pages + 1)], "doc_id long, page int, raw string")


def test_pages_round_trip(spark):
    raw = drawn_pages(spark, 3, 2)
    blocks = layout.parse_blocks(raw)
    assert blocks.count() == 24 and blocks.filter("type = 'image'").agg(F.max("crop_index")).first()[0] == 0
    again = blocks.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", layout.raw_fragment(F.col("type"), F.col("bbox"), F.col("content")).alias("x")))), lambda r: r["x"]), "").alias("raw"))
    keep = ["doc_id", "page", "block_no", "type", "bbox", "content", "crop_index"]
    assert rows(layout.parse_blocks(again).select(keep)) == rows(blocks.select(keep))


def test_crops_of_ref_tags_come_first(spark):
    raw = "<|det|>image [1, 2, 30, 40]<|/det|>\n<|ref|>image<|/ref|><|det|>[[5, 6, 70, 80], [7, 8, 90, 99]]<|/det|>\n<|det|>Text [0, 0, 9]<|/det|>lost<|det|>text [1,1,9,9]<|/det|> a <|x|>b"
    got = layout.parse_blocks(spark.createDataFrame([(1, 1, raw), (2, 1, None), (3, 1, "")], "doc_id long, page int, raw string"))
    assert [(r.block_no, r.type, r.bbox, r.content, r.crop_index) for r in got.orderBy("block_no").collect()] == [(0, "image", [1, 2, 30, 40], "", 2), (1, "image", [5, 6, 70, 80], "", 0), (2, "image", [7, 8, 90, 99], "", 1), (3, "text", [1, 1, 9, 9], "a b", None)]


def test_uploads_and_probe(spark):
    files = spark.createDataFrame([("a.pdf", 9, b"%PDF-1.7 x", "multi", 150), ("a.txt", 9, b"%PDF-", "multi", 150), ("b.PDF", 0, b"", "multi", 150), ("c.pdf", 9, b"hello", "multi", 150), ("d.pdf", 9, b"%PDF-", "x", 150), ("e.pdf", 9, b"%PDF-", "multi", 9)], "path string, length long, content binary, mode string, dpi int")
    assert {r.path: r.refused for r in readers.uploads(files).collect()} == {"a.pdf": None, "a.txt": "name", "b.PDF": "empty", "c.pdf": "magic", "d.pdf": "mode", "e.pdf": "dpi"}
    pages = spark.createDataFrame([(1, 612.0, 792.0), (2, 612.0, 6000.0)], "doc_id long, w_pt double, h_pt double")
    assert rows(readers.probe(pages)) == [(1, 1, True), (2, 1, False)]


def test_artifacts_captures_and_replies(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps({"id": "x", "status": "done", "progress": {"current_page": 3}, "new": 1}))
    (tmp_path / "j/b.json").write_text("{broken")
    got = readers.artifacts(spark, str(tmp_path / "j"), schemas.JOB).select("id", "progress.current_page").collect()
    assert {tuple(r) for r in got} == {("x", 3), (None, None)}
    (tmp_path / "c.txt").write_text('event: page\ndata: {"n": 1}\n\nevent: done\ndata: {}\n\n')
    assert [(r.event, r.data) for r in readers.captures(spark, str(tmp_path / "c.txt")).collect()] == [("page", '{"n": 1}'), ("done", "{}")]
    body = json.dumps({"protocol_version": 1, "engine": "e", "pages": [{"page_index": 0, "markdown": "m", "blocks": [{"type": "text", "bbox": [1, 2, 3, 4], "content": "c"}]}]})
    df = spark.createDataFrame([(body,), (body.replace('"e"', '"f"'),), ("no",)], "body string")
    assert [r.page.blocks[0].content for r in readers.responses(df, "e").collect()] == ["c"]
    df = spark.createDataFrame([('<think>x</think>\n```json\n[{"src": "a"}]\n```', "2.5"), ("none", "9"), ("", "x")], "a string, s string")
    assert [(r[0], r[1]) for r in df.select(F.size(readers.json_array(readers.reply(F.col("a")), "array<struct<src:string>>")), readers.score(F.col("s"))).collect()][0] == (1, 2)


def test_writers(spark, tmp_path):
    sinks.markdown(spark.createDataFrame([(1, "a"), (2001, "b")], "doc_id long, markdown string"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    sinks.layouts(layout.parse_blocks(drawn_pages(spark, 2, 2)), str(tmp_path / "l"))
    assert [len(r.pages) for r in spark.read.json(str(tmp_path / "l")).collect()] == [2, 2]
    sinks.benchmark(spark.createDataFrame([("e", "d", 1.0)], "engine string, document string, total_s double"), str(tmp_path / "b"))
    made = [(1, "images", "a.jpg", b"x"), (1, "", "result.md", b"y"), (2, "images", "../z", b"z"), (2, "../up", "b", b"z")]
    sinks.archive(spark.createDataFrame(made, "doc_id long, folder string, name string, content binary"), str(tmp_path / "z"))
    packed = str(tmp_path / "z")
    assert sorted(r.name for r in spark.read.parquet(packed).collect()) == ["a.jpg", "result.md"]
    assert {x.name for x in (tmp_path / "z").iterdir() if x.is_dir()} <= {f"bucket={k}" for k in range(sinks.BUCKETS)}
    assert [(r.folder, r.name, bytes(r.content)) for r in sinks.entries(spark, packed, 1).collect()] == [("", "result.md", b"y"), ("images", "a.jpg", b"x")]
    runs = records.throughput(spark.createDataFrame([("e", "d", 4, 2.0), ("a", "d", 0, 0.0)], "engine string, document string, pages int, seconds double"))
    assert sinks.summary(runs) == "| engine | document | pages | avg_page_s |\n|---|---|---|---|\n| a | d | 0 | 0.0 |\n| e | d | 4 | 0.5 |\n"
    names = spark.createDataFrame([("a/b.md",), ("../x",), ("/etc",), ("a/../../b",), ("",)], "p string")
    assert [r[0] for r in names.select(sinks.safe_path(F.col("p"))).collect()] == [True, False, False, False, False]


def test_boxes(spark):
    boxes = [([0, 0, 10, 10], [0, 0, 10, 10]), ([-25, -3, 1024, 999], [0, 0, 999, 999]), ([-26, 0, 10, 10], None), ([5, 5, 6, 50], None), ([50, 5, 6, 50], None), (None, None)]
    df = spark.createDataFrame([(b,) for b, _ in boxes], "b array<int>")
    assert [r[0] for r in df.select(sanitize.clamp_box(F.col("b"))).collect()] == [w for _, w in boxes]
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.5, 2.0, 3.0, 4.0],), ([1.0, 2.0, 3.0],), ([float("nan"), 2.0, 3.0, 4.0],), ([1e8, 2.0, 3.0, 4.0],), (None,)], "b array<double>")
    assert [r[0] for r in df.select(sanitize.valid_box(F.col("b"))).collect()] == [True, False, False, False, False, False]


def test_greedy_overlap(spark):
    df = spark.createDataFrame([([[0, 0, 10, 10], [0, 0, 10, 10]], [[0, 0, 10, 10], [0, 0, 10, 5]]), ([], [[0, 0, 1, 1]]), ([[0, 0, 1, 1]], [])], "f array<array<int>>, t array<array<int>>")
    assert [r[0] for r in df.select(geometry.greedy_iou(F.col("f"), F.col("t"))).collect()] == [0.75, 0.0, None]


def test_figures_and_pages(spark):
    raw = 'x <img src="images/bbox_1_2_300_400.jpg" /> y <img src="images/bbox_1_2_300_400.jpg"/><img src="images/bbox_900_2_30_400.jpg"/> <img src="http://a"> <img src="images/bbox_0_0_1000_1000.jpg"/> <img broken'
    r = sanitize.figure_tags(spark.createDataFrame([(1, raw), (2, "plain")], "doc_id long, raw string")).orderBy("doc_id").collect()
    assert r[0].markdown == "x [[FIGURE:0]] y   [[FIGURE:1]]" and r[0].figures == [[1, 2, 300, 400], [0, 0, 999, 999]]
    assert (r[1].markdown, r[1].figures) == ("plain", [])
    pages = spark.createDataFrame([(1, 1, "a [[FIGURE:1]] b [[FIGURE:9]]")], "doc_id long, page int, md string")
    crops = spark.createDataFrame([(1, 1, 1, "one.jpg"), (1, 1, 2, "two.jpg"), (1, 1, None, "orphan.jpg")], "doc_id long, page int, figure_index int, name string")
    assert merge.place_figures(pages, crops).first().md == "a ![](images/one.jpg) b\n\n![](images/two.jpg)\n\n![](images/orphan.jpg)"
    single = spark.createDataFrame([(1, 0, 1, True, "![](images/3.jpg) <|x|>")], "doc_id long, chunk int, num_pages int, single boolean, markdown string")
    assert merge.chunk_pages(single).first().md == "![](images/p0001_3.jpg)"


def test_figures_far_behind_in_a_long_output(spark):
    tag = '<img src="images/bbox_1_2_300_400.jpg" />'
    long = "\n".join(f"line {k} of a long output" for k in range(9_000))
    r = sanitize.figure_tags(spark.createDataFrame([(1, f"{long}{tag} end <img src=x>{tag}")], "doc_id long, raw string")).first()
    assert len(long) > 200_000 and (r.markdown, r.figures, r.warnings) == (f"{long}[[FIGURE:0]] end", [[1, 2, 300, 400]], ["twice", "tags 1"])


def test_skips_terms_and_jobs(spark):
    cases = {"": "non-linguistic", "[1] A x.\n[2] B y.": "references", "[1] Smith, J. 2019": "references", "[1] shows that": "", "한국어 텍스트": "already-korean", "arXiv:2504.19874v1": "identifier", "$x$ 1 2": "non-linguistic", "Plain words": ""}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(masking.skip_reason(F.col("t"), masking.residual_text(F.col("t")))).collect()] == list(cases.values())
    docs = spark.createDataFrame([(1, "The CNN and CNN2 win\nLARGEST DATA SET EVER\nWe use Deep Net and Deep Net and Deep Net, fine-tuned éBERT")], "doc_id long, text string")
    assert rows(glossary.acronyms(docs)) == [(1, "CNN", 1), (1, "CNN2", 1)]
    assert rows(glossary.candidates(docs, least=3)) == [(1, "Deep Net", 3, 1)]
    stems = spark.createDataFrame([("fine-tuned",), ("fine-tuning",), ("nets",)], "t string")
    assert [r[0] for r in stems.select(glossary.stem(F.col("t"))).collect()] == ["fine-tun", "fine-tun", "net"]
    df = spark.createDataFrame([("queued",), ("done",)], "s string")
    assert [r[0] for r in df.select(jobs.cancelled(F.col("s"))).collect()] == ["cancelled", "done"]


def gato(request):
    return request["masked"].replace("cat", "gato")


def test_cached_translation(spark):
    docs = spark.createDataFrame([(1, "One cat $x$.\n\n12 34\n\nTwo dogs [1]."), (2, "One cat $x$."), (3, None), (4, "")], "doc_id long, text string")
    empty = spark.createDataFrame([], "key string, text string")
    gloss = spark.createDataFrame([("cat", "gato", "B")], "src string, ko string, policy string")
    out, blocks, outcome = translate.run_translation(docs, gloss, empty, translate.one_by_one(gato))
    assert blocks is None and rows(out) == [(1, "One gato $x$.\n\n12 34\n\nTwo dogs [1]."), (2, "One gato $x$."), (3, None), (4, "")]
    cache = outcome.filter("doc_id = 2").select("key", "text")
    again = translate.report(translate.run_translation(docs, gloss, cache, translate.one_by_one(lambda r: 1 / 0 if "cat" in r["masked"] else r["masked"]))[2])
    assert {r.doc_id: (r.units, r.translated, r.cached, r.skipped) for r in again.collect()} == {1: (3, 1, 1, 1), 2: (1, 0, 1, 0)}


def told(request):
    terms = lambda c: ",".join(f"{p['src']}={p['ko']}" for p in request[c])
    return f"{request['masked']} [{terms('pairs')}|{terms('first')}|{','.join(request['keep'])}|{(request['context'] or '')[-5:]}]"


def test_units_get_terms_first_uses_names_and_context(spark):
    text = "Deep nets and the GPT win here.\n\nThe GPT has deep nets too.\n\n---\n\n## References\n\nDeep nets, all of them."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    blocks = spark.createDataFrame([(1, 1, 0, "text", [1, 2, 3, 4], "Some deep nets again.", None), (1, 1, 1, "image", [1, 2, 3, 4], "deep nets", "a.png"), (1, 1, 2, "text", [1, 2, 3, 4], " ", None)], "doc_id long, page int, block_no int, type string, bbox array<int>, content string, image string")
    gloss = spark.createDataFrame([("deep nets", "N", "D"), ("win", "W", "B")], "src string, ko string, policy string")
    own = glossary.built(docs, gloss)
    assert rows(own) == [(1, "gpt", "GPT", "A")]
    cache = spark.createDataFrame([], "key string, text string")
    out, drawn, outcome = translate.run_translation(docs, gloss, cache, translate.one_by_one(told), blocks=blocks, own=own)
    lines = out.first().text.split("\n")
    assert lines[0] == "Deep nets and the GPT win here. [deep nets=N,win=W|deep nets=N|GPT|]"
    assert lines[2] == "The GPT has deep nets too. [deep nets=N||GPT|here.]"
    assert lines[-1] == "Deep nets, all of them." and out.first().text.count("---") == 1
    assert [(r.content, r.bbox) for r in drawn.orderBy("block_no").collect()] == [("Some deep nets again. [deep nets=N|||]", [1, 2, 3, 4]), ("deep nets", [1, 2, 3, 4]), (" ", [1, 2, 3, 4])]
    assert {(r.unit_id, r.status) for r in outcome.collect()} >= {("lay:1:0", "translated"), ("md:0:0", "translated"), ("md:1:1", "skipped")}

    # the same keys again, without running
    units = translate.units_of(docs, blocks)
    keyed = translate.keyed(units, gloss, "echo", own)
    kept = spark.createDataFrame([(1, "md:0:1")], "doc_id long, unit_id string")
    found = evaluate.replayed(units, keyed, outcome.filter("status = 'translated' and unit_id <> 'md:0:1'").select("key", "text"), kept)
    assert {r.unit_id: r.status for r in found.collect()} == {"md:0:0": "found", "md:0:1": "kept", "md:1:0": "skipped", "md:1:1": "skipped", "lay:1:0": "found"}
    hits = glossary.term_hits(units.select("doc_id", "unit_id", "scan"), gloss)
    pairs = docs.select("doc_id", F.col("text").alias("source")).join(out.select("doc_id", F.col("text").alias("result")), "doc_id")
    r = evaluate.evaluation(pairs, outcome, found, hits, "N", (blocks, drawn)).first()
    assert (r.hard_ok, r.passed, r.checks, r.translated, r.skipped, r.total, r.found, r.unverified, r.endings) == (True, 3, 3, 3, 2, 3, 2, 0, 3)
    assert r.violations == 0 and r.hangul_ratio == 0.0
    moved = drawn.withColumn("bbox", F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(5)))
    r = evaluate.evaluation(pairs.withColumn("result", F.lit("$$ <m1")), outcome, found, hits, "N", (blocks, moved)).first()
    assert not r.hard_ok and (r.passed, r.checks) == (1, 4)


def test_cache_key_is_that_of_its_parts(spark):
    pairs = [("win", "W"), ("deep nets", "N")]
    want = hashlib.sha256()
    for part in ("4\x1f", "m\x1f", "deep nets\x1eN\x1f", "win\x1eW\x1f", "text é"):
        want.update(part.encode())
    df = spark.createDataFrame([(pairs, "text é"), ([], "x")], "p array<struct<src:string,ko:string>>, t string")
    got = [r[0] for r in df.select(translate.cache_key(F.lit("m"), F.col("p"), F.col("t"))).collect()]
    assert got == [want.hexdigest(), hashlib.sha256("4\x1fm\x1fx".encode()).hexdigest()]


def test_entries_meet_their_own_pattern(spark):
    gloss = [("fine-tuning", "f"), ("C++", "c"), ("of the", "o"), ("Über", "u"), ("++", "p"), (" ", "never")]
    units = {"This is fine. Tuning is next": set(), "we do Fine-Tuning here": {"f"}, "C code": set(), "C++ code": set(), "C++x": {"c", "p"}, "of\n the": {"o"}, "often the": set(), "ÜBER alles": {"u"}, "Überall": set(), "": set(), "a++b": {"p"}}
    g = spark.createDataFrame([(s, k, "B") for s, k in gloss], "src string, ko string, policy string")
    u = spark.createDataFrame([(1, t, t) for t in units], "doc_id long, unit_id string, scan string")
    got = {t: set() for t in units}
    for r in glossary.term_hits(u, g).collect():
        got[r.unit_id].add(r.ko)
    assert got == units
    each = spark.createDataFrame([(d, s, k, "B") for d in (1, 2) for s, k in gloss if (s, d) != ("C++", 1)], "doc_id long, src string, ko string, policy string")
    assert {r.ko for r in glossary.term_hits(u, each).collect()} == {"f", "p", "o", "u"}
    assert glossary.term_hits(u, g.limit(0)).count() == 0


def test_columns_mask_as_the_plain_functions_do(spark):
    rng = random.Random(3)
    parts = ["$x$", "$$a\nb$$", "`c`", "```k\nl```", "\\(y\\)", "\\[z", "<b>", "<m1 v='x'/>", "http://a.b/c", "é@b.cd", "10.12345/x", "[1, 2]", "[3", "see Fig. 3", "éTable 2", "![a](b)", "word", " ", "\n", "'", '"', "\u00a0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", masking.mask_tokens(F.col("t")).alias("m"), masking.residual_text(F.col("t")).alias("r"))
    loose = F.regexp_replace(F.regexp_replace("m.masked", '<m2 v="[^"]*"/>', "<  m2 >"), '<c3 v="[^"]*"/>', "<c3><c3/>")
    for r in df.withColumn("x", loose).withColumn("u", masking.unmask_tokens(F.col("x"), F.col("m.held"))).collect():
        if r.t is None:
            assert r.m.masked is None and r.u.text is None
            continue
        masked, held = mask(r.t)
        assert (r.m.masked, r.m.held) == (masked, held)
        assert tuple(r.u) == unmask(r.x, held)


def test_layout_html(spark):
    blocks = spark.createDataFrame(
        [(1, 1, 0, "Title!", [10, 20, 2000, 60], "a < b \\(x<y\\) \\[ \\]", None, 2.0, True, None), (1, 1, 1, "table", [0, 0, 500, 500], "<table><TD colspan=3 onclick=x>1</TD></table>", None, None, None, None), (1, 1, 2, "image", [5, 5, 5, 5], "", "p1.jpg", None, None, None), (1, 1, 3, "text", [0, 0, 9, 999], "a tall text of the margin", None, None, None, "left"), (1, 1, 4, "text", [1, 2], "x", None, None, None, None), (1, 1, 5, "image", [5, 5, 50, 50], "", "../p", None, None, "down")],
        "doc_id long, page int, block_no int, type string, bbox array<int>, content string, image string, fs double, bold boolean, vertical string",
    )
    pages = spark.createDataFrame([(1, 1, 1000, 2000), (1, 2, 0, 0)], "doc_id long, page int, width int, height int")
    html = layout.layout_html(blocks, pages, "/u").first().html
    assert html.startswith('<section class="layout-page" data-page="1"><div class="layout-canvas" style="padding-top:200.00%">')
    assert '<div class="layout-block layout-text" style="left:1.00%;top:2.00%;width:99.00%;height:4.00%;font-size:2.00cqw;line-height:1.22;font-weight:600;" title="text">a &lt; b <span class="math-inline">x&lt;y</span> </div>' in html
    assert '<table>&lt;TD colspan=3 onclick=x&gt;1&lt;/TD&gt;</table>' in html
    assert '<img class="layout-block layout-image" src="/u/images/p1.jpg" style="left:0.50%;top:0.50%;width:0.40%;height:0.40%;" alt="">' in html
    assert 'layout-text layout-vertical-up"' in html and 'layout-image layout-vertical-down"' in html and "../p" not in html
    assert html.endswith('<section class="layout-page" data-page="2"><div class="layout-canvas" style="padding-top:141.40%"></div></section>') and html.count("layout-block") == 5
    tables = {
        '<td colspan="2">a<b></td>': '<td colspan="2">a&lt;b&gt;</td>', '<td colspan="2" onclick="x">': '<td colspan="2">', "<tr rowspan=4 colspan='2'/>": "<tr>", "<TD>": "&lt;TD&gt;", "<threshold>": "&lt;threshold&gt;",
        '<th data-colspan="3" rowspan="1234" />': "<th>", '</td colspan="2">': "</td>", f"<td {'x' * 400}>": f"&lt;td {'x' * 400}&gt;", '<table border="1"\n>': "<table>",
    }
    one = spark.createDataFrame([(t,) for t in tables], "t string")
    assert {r[0]: r[1] for r in one.select("t", render.tables_restored(F.col("t"))).collect()} == tables


def test_math_for_display(spark):
    texts = {
        "a \\( x \\) b \\[ y\n\\] c": "a $x$ b \n\n$$\ny\n$$\n\n c", "$$a$$ and $ x_1 $ and $T$": "\n\n$$\na\n$$\n\n and $x_1$ and $T$", "$5 and $7": "\\$5 and \\$7", "one $ only": "one \\$ only",
        "$a=b$ $2x$": "$a=b$ \\$2x\\$", "$" + "word " * 9 + "$": "\\$" + "word " * 9 + "\\$", "`$x$` \\(  \\)$$ $$": "`$x$` ", "~~~\n$x$ \\(y\\)\n~~~\n$5": "~~~\n$x$ \\(y\\)\n~~~\n\\$5", "```\n$$a$$\n```": "```\n$$a$$\n```",
        "$a `b_$` c$": "$a `b_$` c$",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", render.math_normalized(F.col("t"))).collect()} == texts


def test_previews_of_both_tags(spark):
    det = lambda label: f"<|det|>{label} [1, 2, 3, 4]<|/det|>"
    texts = {
        "<|ref|>title<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>Body": "Body", f"{det('image')}under it": f"{render.IMAGE}\n\nunder it", f"<|ref|> Image <|/ref|><|det|>[1,2,3,4]<|/det|>x": f"{render.IMAGE}\n\nx",
        f"{det('title')}Two \n\n lines{det('page-number')}7{det('Foot-note')}n": "## Two lines\n\nn", f"a<PAGE><PAGE>{det('header')}h<PAGE>b<PAGE>": "a\n\n---\n\nb", "<PAGE>": "", "": "",
        f"{det('text')} a <|odd|> b": "a  b", f"{det('text')}---<PAGE>b": "---\n\nb",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", render.preview(F.col("t"))).collect()} == texts



def test_places_in_one_queue(spark):
    rng = random.Random(1)
    made = [(i, rng.choice(["queued", "done"]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(300))) for i in range(400)]
    got = {r.id: r.position for r in jobs.queue_positions(spark.createDataFrame(made, "id int, status string, created_at timestamp").repartition(3)).collect()}
    line = sorted((t, i) for i, s, t in made if s == "queued")
    assert got == {i: n for n, (_, i) in enumerate(line, 1)}


def test_counters_with_prose_between(spark):
    bare, prose = ("".join(f"#{i}. {x}" for i in range(1, 31)) for x in ("", "some words "))
    df = spark.createDataFrame([(1, 1, "intro " + bare), (2, 1, prose), (3, 1, prose + " end #7. " + bare), (4, 1, None)], "doc_id int, page int, text string")
    assert rows(repetition.counter_runs(df)) == [(1, 1, 1, 30), (3, 1, 1, 30)]


def test_text_columns(spark):
    df = spark.createDataFrame([("a<<PAGE>PAGE>b",), ("x<|d<|q|>et|>y",), ("  a\t b ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.strip_special(F.col("t"))).collect()] == ["ab", "xy", "  a\t b ", None]
    assert [r[0] for r in df.select(T.squeeze(F.col("t"))).collect()][2] == "a b"


def test_reports(spark):
    from quire.operators import reports

    df = spark.createDataFrame([("low", " https://h:/v1/ ", "t", [("a", "b")], ["X"], "c"), (None, "http://h:80/v1", "t", None, None, None)], "e string, u string, t string, p array<struct<src:string,ko:string>>, k array<string>, c string")
    got = df.select(reports.output_tokens(F.col("e")), reports.base_url(F.col("u")), reports.prompt(F.col("t"), F.col("p"), F.col("k"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(10240, "https://h/v1", "Before:\nc\n\nTerms:\na = b\n\nKeep: X\n\nText:\nt"), (8192, "http://h:80/v1", "Text:\nt")]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert df.select(reports.with_provider(F.col("a"), F.col("b"))).first()[0] == ["a", "b", "c"]


def test_deleted_jobs_take_their_tasks_with_them(spark):
    own = spark.createDataFrame([(1, "running"), (2, "done"), (3, "queued"), (4, "done")], "id int, status string")
    tasks = spark.createDataFrame([(1, "ko"), (2, "ko"), (4, "ko")], "id int, lang string")
    stay, stop = records.deleted(own, tasks, spark.createDataFrame([(1,), (2,), (2,), (9,)], "id int"))
    assert rows(stay) == [(1, "running", True), (3, "queued", False), (4, "done", False)] and rows(stop) == [(1, "ko"), (2, "ko")]


def test_texts_that_are_not_there(spark):
    own = spark.createDataFrame([(1, "running"), (2, "done")], "id int, status string")
    texts = spark.createDataFrame([(1, "a")], "id int, text string")
    none = spark.createDataFrame([], "id int, lang string, text string")
    assert rows(records.shown_text(own, texts, none)) == [(1, "a", True, True), (2, None, False, False)]
    assert {r.found for r in records.shown_text(own, texts, none, "ko").collect()} == {False}


def test_settings(spark, tmp_path):
    own = settings.settings(settings.READING, {"MAX_PAGES": "0", "PAGES_PER_CHUNK": "-3", "PAGE_SEPARATOR": "\\n#\\n", "ALLOWED_HOSTS": " a, ,b:80 "})
    assert (own["max_pages"], own["pages_per_chunk"], own["page_separator"], own["allowed_hosts"], own["max_page_chars"]) == (None, 1, "\n#\n", ("a", "b:80"), 16_384)
    body = json.dumps({"protocol_version": 1, "engine": "e", "pages": [{"page_index": 0, "markdown": "m", "blocks": []}]})
    (tmp_path / "a.json").write_text(body)
    (tmp_path / "b.json").write_text(body + " " * (2 << 20))
    assert readers.replies(spark, str(tmp_path), "e", 1).count() == 1
    told = settings.settings(settings.TRANSLATION, {"TRANSLATE_MODEL": " ", "OPENAI_MODEL": " 'm' ", "OPENAI_BASE_URL": "u", "TRANSLATE_REASONING": "LOW", "TRANSLATE_TIMEOUT_S": "1", "TRANSLATE_CONTEXT": "no"})
    assert (told["model"], settings.output_tokens(told), told["timeout_s"], told["context"], told["concurrency"]) == ("m", 10240, 5.0, False, 4)
    for bad, name in (({}, "OPENAI_MODEL"), ({"OPENAI_MODEL": "m"}, "OPENAI_BASE_URL"), ({"OPENAI_MODEL": "m", "OPENAI_BASE_URL": "u", "TRANSLATE_API_MODE": "x"}, "TRANSLATE_API_MODE"), ({"OPENAI_MODEL": "m", "OPENAI_BASE_URL": "u", "TRANSLATE_MAX_RETRIES": "x"}, "TRANSLATE_MAX_RETRIES")):
        with pytest.raises(ValueError, match=name):
            settings.settings(settings.TRANSLATION, bad)


def test_replies(spark):
    df = spark.createDataFrame([("x {\"a\": {\"b\": 1}} y",), ("none",), ("{broken",), ('{"detail": ""}',), ('{"error": "' + "e" * 400 + '"}',), ('{"detail": {"x": 1}, "error": "z"}',)], "b string")
    got = df.select(readers.json_object(F.col("b"), "a struct<b:int>"), readers.error_detail(F.col("b")), readers.preview(F.col("b"), 4)).collect()
    assert got[0][0].a.b == 1 and got[1][0] is None and got[2][0] is None
    assert [r[1] for r in got] == ["(no detail)"] * 4 + ["e" * 300, "(no detail)"] and got[1][2] == "none"


def test_long_texts_become_objects_a_few_at_a_time(spark):
    import pyarrow as pa

    from pyspark.sql.types import StringType

    from quire.functions import slices

    texts = pa.array(["x" * 1000, None, "y" * 5000, *["z" * 10] * 500])
    got = [c for (c,) in slices.slices((texts,), 1000)]
    assert pa.concat_arrays(got).to_pylist() == texts.to_pylist() and max(c.nbytes for c in got if len(c) > 1) <= 2000 and len(got) < 100
    rows = [(k, None if k % 5 == 0 else f"{k} " * 300) for k in range(100)]
    ends = slices.by_row(StringType())(lambda text, k: None if text is None else f"{k}:{text[-4:]}")
    df = spark.createDataFrame(rows, "k int, t string").repartition(1)
    assert {r.k: r.e for r in df.select("k", ends("t", "k").alias("e")).collect()} == {k: t and f"{k}:{t[-4:]}" for k, t in rows}


def test_units_of_a_batch_leave_python_in_pieces(spark):
    import pyarrow as pa

    from quire.operators import segment

    run = segment.unit_list.__closure__
    few = next(c.cell_contents for c in run if getattr(c.cell_contents, "__name__", "") == "one")
    texts = pa.array(["a line\n\n" * 2000] * 1000)
    assert len(list(few.func(iter([texts])))) >= 3
