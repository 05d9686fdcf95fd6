"""Layout, glossary, scoring, rendering, files, models and streams on small rows."""

import inspect
import json
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import glossary as G
from folioforge.operators import frames, knowledge, layout, paragraphs, references, render, scoring
from folioforge.plans import book, lecture
from folioforge.plans.model import HttpModel, StubModel, ask, call, suggest
from folioforge.plans.stages import tables
from folioforge.sources import files, html
from folioforge.sources.html import Selectors, page_items
from folioforge.sources.keyed import KeyedTable
from folioforge.streaming import incremental

# Golden rows: module scores, overall score and band of recorded sections.
GOLDEN = """1 100 20 90 60 68|1.2 100 39 73 80 73|1.3 100 57 83 60 77|1.4 100 0 50 80 57|1.5 100 17 90 20 61|2 100 14 85 20 59|2.2 100 5 35 0 43|2.3 100 40 83 0 63|2.4 100 4 90 0 54
3 100 21 85 20 61|3.1 100 47 18 0 52|3.3 100 0 51 0 45|4 100 0 100 40 61|4.2 100 0 83 20 54|4.3 100 0 90 60 62|5.2 100 0 73 20 52|5.3 100 11 90 20 59|5.4 100 0 51 40 51
5.5 100 21 73 20 58|5.6 100 19 90 60 67|6 100 8 66 20 53|6.1 100 30 50 0 54|6.4 100 35 68 40 65|6.6 100 23 68 0 55|6.7 100 20 51 0 51|6.9 100 34 68 40 64|6.10 100 0 85 0 52"""


def golden():
    return [r.split() for line in GOLDEN.split("\n") for r in line.split("|")]


def test_weighted_score_golden(spark):
    rows = [(r[0], m, int(v), False) for r in golden() for m, v in zip(scoring.WEIGHTS, r[1:5])]
    got = {r["id"]: r for r in scoring.overall(spark.createDataFrame(rows, "id string, module string, score int, skipped boolean"), "id").collect()}
    assert {k: r["score"] for k, r in got.items()} == {r[0]: int(r[5]) for r in golden()}
    assert sum(r["band"] == "양호" for r in got.values()) == 2 and sum(r["band"] == "경고" for r in got.values()) == 2


def test_score_edges(spark):
    rows = [("a", "formula", -5, False), ("b", "formula", 140, False), ("c", "formula", 10, True), ("c", "logic", 10, True)]
    got = dict(scoring.overall(spark.createDataFrame(rows, "id string, module string, score int, skipped boolean"), "id").select("id", "score").collect())
    assert got == {"a": 0, "b": 100, "c": 100}


def test_natural_order(spark):
    ids = ["6.10", "page_3", "6.9", "6", "1.2", "6.9.1", "10"]
    df = spark.createDataFrame([(i,) for i in ids], "s string").orderBy(T.natural_key(F.col("s")))
    assert [r["s"] for r in df.collect()] == ["1.2", "6", "6.9", "6.9.1", "6.10", "10", "page_3"]


@pytest.mark.parametrize(("sid", "size", "level", "kind"), [("1", 8.1, "subsection", "subsection"), ("1.2", 8.1, "subsection", "section"), ("1.2.3", 8.1, "subsection", "subsection"), ("1.2", 9.0, "subsection", "chapter"), ("1", 8.0, "section", "chapter")])
def test_heading_kind(spark, sid, size, level, kind):
    assert spark.range(1).select(T.heading_kind(F.lit(sid), F.lit(size), F.lit(level))).first()[0] == kind


def pages(spark):
    span = lambda t, font="Body", size=8.0: {"text": t, "font": font, "size": size}
    block = lambda y0, y1, *lines: {"type": 0, "bbox": {"x0": 0.0, "y0": y0, "x1": 1.0, "y1": y1}, "lines": [{"spans": list(s)} for s in lines]}
    bold = lambda t, size=9.5: span(t, "Body-Bold", size)
    made = [
        (0, [block(0.0, 10.0, [span("before")])]),
        (1, [block(0.0, 10.0, [bold("1.1"), bold("First title")]), block(30.0, 40.0, [span("text  of"), span("one")], [span("second line")])]),
        (2, [block(0.0, 10.0, [span("goes on")])]),
        (3, [block(0.0, 10.0, [bold("1.2", 8.5), bold("2", 8.5), bold("Third", 8.5)]), block(11.0, 12.0, [span("close")])]),
    ]
    image = {"ext": "png", "position": {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}}
    rows = [{"doc_id": "d", "page": p, "blocks": b, "images": [image] * (p % 2)} for p, b in made] + [{"doc_id": "e", "page": 0, "blocks": [block(0.0, 1.0, [span("lone")])], "images": []}]
    return spark.read.schema(layout.PAGE_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_page_text(spark):
    got = {(r["doc_id"], r["page"]): r["text"] for r in layout.page_text(pages(spark)).collect()}
    assert got["d", 1] == "1.1 First title\n\ntext of one\nsecond line"
    assert got["d", 3] == "1.2 2 Third\nclose"


def test_headers_and_sections(spark):
    heads = layout.headers(layout.spans(pages(spark)))
    got = [(r["page"], r["section_id"], r["title"]) for r in heads.orderBy("page", "at").collect()]
    assert got == [(1, "1.1", "First title"), (3, "1.2", "2")]
    text = layout.page_text(pages(spark)).join(pages(spark).select("doc_id", "page", "images"), ["doc_id", "page"])
    sections = {r["section_id"]: r for r in layout.assemble_sections(text, layout.first_header(heads), end_page=9).collect()}
    assert (sections["1.1"]["start_page"], sections["1.1"]["end_page"]) == (2, 3)
    assert (sections["1.2"]["start_page"], sections["1.2"]["end_page"]) == (4, 9)
    assert sections["1.1"]["content"].endswith("goes on") and sections["1.1"]["level"] == "section" and len(sections["1.1"]["images"]) == 1
    lone = layout.page_sections(text, layout.assemble_sections(text, layout.first_header(heads))).collect()
    assert [(r["doc_id"], r["section_id"]) for r in lone] == [("e", "page_1")]
    assert [r["filename"] for r in layout.images(pages(spark)).orderBy("page").collect()] == ["page_2_img_1.png", "page_4_img_1.png"]


@pytest.mark.parametrize("segment", [4096, 5, 1])
def test_sections_in_segments(spark, segment):
    """The same sections wherever documents are cut, pages missing, before the first header and without any included."""
    r = random.Random(3)
    pages, heads, want = [], [], []
    for d in range(6):
        now = None
        own = sorted(r.sample(range(60), r.choice([0, 1, 40, 60])))
        for p in own:
            pages.append((f"d{d}", p, f"text {p}"))
            if d and r.random() < (0.1 if d < 5 else 0.9):
                heads.append((f"d{d}", p, str(p), f"title {p}", 8.0 + p % 2))
                if now:
                    now[-1] = p
                now = [f"d{d}", str(p), [], p + 1, None]
                want.append(now)
            if now:
                now[2].append(f"text {p}")
                last = p
        if now:
            now[-1] = last + 1
    heads.append(("d1", 1000, "no such page", "x", 9.0))
    made = layout.assemble_sections(spark.createDataFrame(pages, "doc_id string, page int, text string"), spark.createDataFrame(heads, "doc_id string, page int, section_id string, title string, font_size double"), segment=segment)
    got = [(x["doc_id"], x["section_id"], x["content"], x["start_page"], x["end_page"]) for x in made.collect()]
    assert sorted(got) == sorted((d, s, "\n".join(t), a, b) for d, s, t, a, b in want)


def test_pages_of_one_document_are_many_tasks(spark):
    """A document of 10^6 pages: no window over all of it, and no task with most of it."""
    pages = spark.range(1_000_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page"), F.lit("x").alias("text"))
    heads = pages.where("page % 7 = 3").select("doc_id", "page", F.col("page").cast("string").alias("section_id"), F.lit("t").alias("title"), F.lit(9.0).alias("font_size"))
    run = layout.running_sections(pages, heads)
    sizes = [x["count"] for x in run.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 999_997 and max(sizes) < 500_000
    wrong = run.where((F.col("section_no") != F.floor((F.col("page") - 3) / 7) + 1) | (F.col("section_id").cast("int") != F.col("page") - (F.col("page") - 3) % 7) | (F.col("next_page") != F.col("page") - (F.col("page") - 3) % 7 + 7))
    assert wrong.count() == 0


def test_toc(spark):
    toc = spark.createDataFrame([(0, 1, "a", 1), (1, 2, "b", 3), (2, 3, "c", 3), (3, 2, "d", 7), (4, 1, "e", 9)], "ord int, level int, title string, page int").withColumn("k", F.lit(1))
    for out in (layout.toc_ranges(toc, F.lit(20), [1, 2, 3], ["k"]),):
        assert [(r["end_page"], r["page_count"]) for r in out.orderBy("ord").collect()] == [(8, 8), (6, 4), (6, 4), (8, 2), (20, 12)]


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, o int, v string").withColumn("p", F.col("o"))
    got = {r["k"]: (r["v"], r["p"], r["n_rows"]) for r in layout.last_wins(df, ["k"], F.col("o"), "p").collect()}
    assert got == {"a": ("z", 1, 2), "b": ("y", 2, 1)}


def test_repeats(spark):
    p = "p" * 30
    text = "\n\n".join([p, p, p + "1", p + "2", " ", "short", "short"])
    paras = paragraphs.explode_paragraphs(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t")
    kept = [r["para"] for r in paragraphs.drop_repeats(paras, "i").orderBy("pos").collect()]
    assert kept == [p, p, "short", "short"]
    joined = paragraphs.implode(paragraphs.drop_repeats(paras, "i"), "i").first()["text"]
    assert joined == "\n\n".join(kept)


#: Shards of all terms, of one each; automata or term by term.
GLOSSARY_WAYS = [(100_000, 64), (100_000, 0), (1, 64), (2, 0)]


@pytest.mark.parametrize(("shard", "few"), GLOSSARY_WAYS)
def test_glossary_ways_agree(spark, monkeypatch, shard, few):
    monkeypatch.setattr(G, "SHARD_TERMS", shard)
    monkeypatch.setattr(G, "FEW", few)
    g = spark.createDataFrame([(i, t, t and t.upper()) for i, t in enumerate(["ring", "group", "in", None, "subgroup", "x", ""])] + [(None, "str", None), (1, "a", "b")], "ord int, term string, gloss string")
    docs = spark.createDataFrame([(1, "A String of Subgroup"), (2, ""), (3, None), (4, "x")], "i int, t string")
    got = {r["i"]: (r["hint"].split("\n"), r["n_terms"]) for r in G.hints(docs, g, "i", "t").collect()}
    assert got == {1: (["str", "ring → RING", "a → b", "group → GROUP", "in → IN", "subgroup → SUBGROUP"], 6), 4: (["x → X"], 1)}
    assert [r["hint"] for r in G.hints(docs, g, "i", "t", most=2).where("i = 1").collect()] == ["str\nring → RING"]
    pairs = spark.createDataFrame([(1, "ring group subgroup", "RING here"), (1, "subgroups", "SUBGROUP"), (2, None, "x"), (3, "group", None)], "i int, o string, t string")
    assert sorted((r["i"], r["rank"], r["term"]) for r in G.issues(pairs, g, "i", "o", "t").collect()) == [(1, 1, "group"), (1, 2, "subgroup"), (3, 1, "group")]


def test_large_glossary(spark):
    """200,000 terms in shards: no join, and the rows of a search text by text."""
    terms = [f"t{i:06d}q" for i in range(200_000)]
    g = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(terms)], "ord int, term string, gloss string").repartition(4)
    docs = spark.createDataFrame([(k, " ".join(f"T{(k * 7919 + j * 104729) % 260_000:06d}Q" for j in range(k % 40))) for k in range(120)], "i int, t string")
    out = G.hints(docs, g, "i", "t")
    text = out._jdf.queryExecution().sparkPlan().toString()
    assert not re.search("NestedLoop|HashJoin|MergeJoin|Cartesian", text) and text.count("MapInArrow") >= 2
    got = {r["i"]: r["hint"].split("\n") for r in out.collect()}
    for k in range(120):
        held = sorted({n for j in range(k % 40) if (n := (k * 7919 + j * 104729) % 260_000) < 200_000})
        assert got.get(k, []) == [f"{terms[n]} → {n}" for n in held[:15]]


def test_knowledge(spark):
    kb = spark.createDataFrame([("Group mathematics", "g" * 60), ("Ring", "too short"), ("Field", "f" * 60)], "title string, extract string")
    asked = spark.createDataFrame([(1, "group"), (2, "ring"), (3, "field")], "i int, term string")
    got = {r["i"]: r["title"] for r in knowledge.lookup(asked, kb, "i", "term").collect()}
    assert got == {1: "Group mathematics", 2: None, 3: "Field"}


@pytest.mark.parametrize("most_titles", [32, 3, 0])
def test_title_search_by_brute_force(spark, most_titles):
    """The same titles whether words are common or rare, and no more rows for a query than its words and sets."""
    r = random.Random(1)
    words = ["group", "ring", "field", "theory", "lie", "of", "x-1", "algebra", "finite", "sum"]
    titles = sorted({" ".join(r.sample(words, r.randint(1, 5))).capitalize() for _ in range(120)} | {"Zeta", "", "Ring ring RING", "Über ring"})
    kb = spark.createDataFrame([(t, "about " + t) for t in titles], "title string, extract string")
    asked = [(i, r.sample([*words, "Zeta", "GROUP", "none"], r.randint(0, 6))) for i in range(150)] + [(150, None)]
    queries = spark.createDataFrame(asked, "id int, t array<string>")
    index = knowledge.title_index(kb, most_titles=most_titles)
    assert index.words.where("held is not null").select(F.max(F.size("held"))).first()[0] in ({None} if most_titles == 0 else set(range(most_titles + 1)))
    got = {x["id"]: (x["title"], x["overlap"], x["extract"]) for x in knowledge.search(queries, kb, "id", F.col("t"), index=index).collect()}
    for i, terms in asked:
        first = {w.lower() for w in (terms or [])[:4]}
        scored = [(-len(first & set(re.split("[^a-z0-9-]+", t.lower()))), len(t), t) for t in titles]
        less, _, title = min(scored)
        assert got.get(i) == ((title, -less, "about " + title) if less else None)


def test_search_terms_with_and_without_a_number(spark):
    r = random.Random(2)
    some = ["The", "Alpha", "beta", "Gam-ma", "of", "delta9", "Ep", "Zeta,", "(Eta)", "été", "Theta\tIota", "AND", "kappa\nLambda", "-Mu", "mu-Nu"]
    rows = [(i, " ".join(r.choices(some, k=r.randint(0, 14)))) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", T.search_terms(F.col("t")).alias("a"), *[T.search_terms(F.col("t"), most=n).alias(f"m{n}") for n in (1, 4)])
    assert all((x["a"] is None and x["m4"] is None) or (x["m4"] == x["a"][:4] and x["m1"] == x["a"][:1]) for x in df.collect())


HTML = """<html><body><div class="chapter"><h2><span>1</span> Motion<sup>2</sup></h2>
<div class="para"><p class="p">Take <script type="math/tex">x^2</script> <span class="MathJax">x2</span> <b>now</b></p></div>
<div class="section"><h3><a href="#">§</a>Part</h3><div class="figure"><img data-src="a/b/f1.svgz"><div class="caption"> A <i>cap</i></div></div>
<div class="equation"><script type="math/tex; mode=display">e=mc</script></div><div class="equation">raw</div><div class="para"><p class="q">no</p></div></div></div></body></html>"""


def test_html_items():
    title, items = page_items(HTML, Selectors())
    assert title == "Motion"
    assert [(i[0], i[3], i[4] or i[7] or i[5]) for i in items] == [(0, "paragraph", "Take $x^2$ now"), (1, "figure", "images/f1.svgz"), (1, "equation", "e=mc"), (1, "equation", "raw")]
    assert items[1][2] == "Part" and items[1][6] == "Acap"
    assert page_items("<div class='document'><div class='para'><p class='p'>x", Selectors())[1][0][4] == "x"
    assert page_items("no container", Selectors()) == ("", []) and page_items("", Selectors()) == ("", [])


def test_references_of_a_page():
    page = "<article><h1>a &quot</h1><p>&lt;b&gt &amp;quot; &ampx &copy &#65; &<i title='&quot;'>&quot;</i><script>1 && 2 &amp; 3</script></article>"
    chosen = dict(containers=(("article", None),), chapter_title="h1", paragraph=("p", None), paragraph_text=("p", None))
    title, items = page_items(page, Selectors(**chosen))
    assert (title, items[0][4]) == ('a "', '<b> &quot; &x © A & " 1 && 2 &amp; 3')
    title, items = page_items(page, Selectors(**chosen, references=((r"&quot;", '"'), (r"&amp;?", "&"))))
    assert (title, items[0][4]) == ("a &quot", '&lt;b&gt &quot; &x &copy &#65; & " 1 && 2 &amp; 3')


#: Pages whose titles and paragraphs are cut within references.
CUT = ["&", "&a", "&am", "&amp", "&amp;", "&q", "&quo", "&quot", "&quot;", "&lt", "&lt;", "&copy", "&amp;quot", "&amp;quot;", "&quot&amp", "&#39", "x &"]


def against_sql(spark, path, name):
    """A query of CUT's pages and its SQL."""
    import __spark_entry__ as entry
    from tests.compare import same

    rows = [(i, f"<html><head><title>{c}</title></head><body><article><h1>It is {c}</h1><p>one {c}</p><p>{c} two</p><p><b>end{c}<br></article></body></html>") for i, c in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    same(entry.queries()[name](spark, str(path)).toPandas(), con.sql(entry.oracle_sql()[name]).df())


def test_html_items_cut_within_references(spark, tmp_path):
    against_sql(spark, tmp_path, "html_items")


@pytest.mark.parametrize("name", ["lecture_items", "lecture_chapters"])
def test_lectures_cut_within_references(spark, tmp_path, name):
    against_sql(spark, tmp_path, name)


def test_lecture_plan(spark, tmp_path):
    df = spark.createDataFrame([(1, HTML), (2, "<title>Attention Required!</title>" + HTML)], "page_id long, html string")
    g = spark.createDataFrame([(0, "now", "지금")], "ord int, term string, gloss string")
    manifest = spark.createDataFrame([("f1.pdf",)], "name string")
    model = StubModel(canned=(("category", '{"category": "keyconcept", "title": null, "extra": "note"}'), ("Translate", "번역: 움직임을 보자")))
    rows = lecture.run(df, "page_id", "html", g, manifest, model, persist=tables(spark, f"file://{tmp_path}")).collect()
    assert [r["chapter_id"] for r in rows] == ["1"]
    tex = rows[0]["tex"]
    assert "\\chapter{Motion}" in tex and "\\lettrine" in tex and "f1.pdf" in tex and "핵심 개념" in tex and tex.index("\\section{Part}") < tex.index("e=mc")


def test_book_plan(spark, tmp_path):
    g = spark.createDataFrame([(0, "text", "글")], "ord int, term string, gloss string")
    kb = spark.createDataFrame([("Ring", "r" * 60)], "title string, extract string")
    canned = (("claims", "1. A claim about Rings that is long\n2. x"), ("concepts", "- Ring\n- q"), ("Translate this name", '"고리 (Ring)"'), ("Explain", "설명이 여기에 있으며 서른 글자보다 길어야 하므로 조금 더 씁니다."), ("Rate", '{"score": 9}'), ("keep this claim", '{"preserved": false}'), ("contradictions", '{"issues": []}'))
    keep, seen = tables(spark, f"file://{tmp_path}"), []
    out = book.run(pages(spark), g, kb, StubModel(canned=canned), persist=lambda df, name: (seen.append(name), keep(df, name))[1]).collect()
    assert {r["doc_id"] for r in out} == {"d", "e"} and [s for s in seen if s in ("sections", "translated", "claims", "modules", "verified", "enriched", "supplemented")] == ["sections", "translated", "claims", "modules", "verified", "enriched", "supplemented"]
    tex = next(r["tex"] for r in out if r["doc_id"] == "d")
    assert tex.index("First title") < tex.index("\\label{sec:1-2}") and "verificationbox" in tex
    plain = book.run(pages(spark), g, kb, StubModel(), book.BookConfig(translate=False, verify=(), enrich=False, supplements=False), persist=keep).collect()
    assert "verificationbox" not in plain[0]["tex"]


class Failing(StubModel):
    def generate(self, prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["ok"] * len(prompts)


def test_model_errors_stay_in_their_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, " "), (4, None)], "i int, p string")
    got = {r["i"]: (r["answer"], r["error"]) for r in call(df, "i", F.col("p"), Failing()).collect()}
    assert got[1] == ("ok", None) and got[3] == ("", None) and got[4] == ("", None) and got[2][0] is None and "no" in got[2][1]
    path = f"file://{tmp_path}/answers"
    ask(df, "i", F.col("p"), Failing(), path)
    again = {r["i"]: r["answer"] for r in ask(df, "i", F.col("p"), StubModel(), path).collect()}
    assert again == {1: "ok", 2: "bad", 3: "", 4: ""}
    assert suggest(StubModel(), "stub") == (True, [])


def test_files(spark, tmp_path):
    path = f"{tmp_path}/sections"
    rows = spark.createDataFrame([("1.2", "a"), ("2", "b")], "section_id string, title_original string")
    files.write_sections(rows, path)
    files.write_sections(spark.createDataFrame([("2", "c")], "section_id string, title_original string"), path)
    back = {r["section_id"]: r["title_original"] for r in files.read_sections(spark, path).collect()}
    assert back == {"1.2": "a", "2": "c"}
    assert files.metadata(rows, "x.pdf", 3).first()["section_ids"] == ["1.2", "2"]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/a.svgz").write_bytes(b"<!DOCTYPE html><html>")
    (tmp_path / "bin/b.png").write_bytes(b"\x89PNG....")
    kinds = files.read_binaries(spark, f"{tmp_path}/bin").select("path", files.image_kind(F.col("content")).alias("k")).collect()
    assert {r["path"][-5:]: r["k"] for r in kinds} == {".svgz": "html", "b.png": "png"}
    (tmp_path / "ch.json").write_text(json.dumps({"chapter_id": "I_01", "sections": [{"title": "t", "content": [{"type": "paragraph", "text": "x"}, {"type": "equation", "latex": "y"}]}]}, indent=1))
    items = files.chapter_items(files.read_chapters(spark, f"{tmp_path}/ch.json")).orderBy("item_idx").collect()
    assert [(r["type"], r["text"], r["latex"]) for r in items] == [("paragraph", "x", None), ("equation", None, "y")]
    files.write_documents(spark.createDataFrame([("d", "a\nb")], "doc_id string, tex string"), f"{tmp_path}/tex")
    assert spark.read.text(f"{tmp_path}/tex", wholetext=True).first()["value"].strip() == "a\nb"


def test_incremental(spark, tmp_path):
    src, state = f"{tmp_path}/in", f"{tmp_path}/state"
    sink = KeyedTable(spark, f"file://{tmp_path}/out", "section_id", buckets=2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"section_id": "1", "title_original": "a"}))
    run = lambda: incremental.upsert(incremental.new_files(spark, src), lambda df: df.withColumn("title_translated", F.upper("title_original")), sink, state)
    run().awaitTermination()
    (tmp_path / "in/2.json").write_text(json.dumps({"section_id": "2", "title_original": "b"}))
    query = run()
    query.awaitTermination()
    assert incremental.progress_of(query)["rows"] == 1
    assert {r["section_id"]: r["title_translated"] for r in sink.read().collect()} == {"1": "A", "2": "B"}


def extract_demo(path, low, high):
    for n in range(low, 4 if high is None else min(4, high)):
        yield n, {"blocks": [{"type": 0, "bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}, "lines": [{"spans": [{"text": f"p{n}", "font": "Bold", "size": 8.0}]}]}], "images": []}


def test_paginated_source(spark):
    from folioforge.sources.pages import read_paginated

    df = read_paginated(spark, ["/x/a.pdf", "/x/b.pdf"], "tests.test_operators:extract_demo")
    assert sorted((r["doc_id"], r["page"], r["text"]) for r in layout.page_text(layout.page_range(df, 1, 3)).collect()) == [(d, p, f"p{p}") for d in ("a.pdf", "b.pdf") for p in (1, 2)]


def test_references_index_and_glossary(spark):
    rows = [
        ("d", "2", r"\\label{sec:2} see \\hyperref[sec:10]{[X \\S{1}]}, \\hyperref[sec:no]{[gone {x}]} and \\ref{sec:2} \\index{Ring} \\index{ }", [("Ring", "first")]),
        ("d", "10", r"\\label{sec:10}\\label{twice} \\hyperref[sec:no]{again} \\ref{twice} \\term{ring} \\index{apple}", [("Ring", "later"), ("", "x")]),
        ("d", "3", r"\\label{twice} plain \\pageref{lost(1)} \\index{Ring}", None),
        ("e", "1", r"\\hyperref[sec:2]{other book}", []),
        ("e", "2", None, None),
    ]
    rows = [(d, s, x and x.replace("\\\\", "\\"), g) for d, s, x, g in rows]
    df = spark.createDataFrame(rows, "doc string, section_id string, tex string, glossary array<struct<term:string,gloss:string>>")
    got = sorted((r["doc"], r["section_id"], r["label"], r["target"], r["state"]) for r in references.checked_references(df, ["doc"]).collect())
    assert got == [("d", "10", "sec:no", None, "broken"), ("d", "10", "twice", "3", "ambiguous"), ("d", "2", "sec:10", "10", "ok"), ("d", "2", "sec:2", "2", "ok"), ("d", "2", "sec:no", None, "broken"), ("d", "3", "lost(1)", None, "broken"), ("e", "1", "sec:2", None, "broken")]
    lost = sorted((r["doc"], r["label"], r["n_references"], r["sections"]) for r in references.broken_references(df, ["doc"]).collect())
    assert lost == [("d", "lost(1)", 1, ["3"]), ("d", "sec:no", 2, ["2", "10"]), ("e", "sec:2", 1, ["1"])]
    plain = {(r["doc"], r["section_id"]): r["tex"] for r in references.unlink_broken(df, ["doc"]).collect()}
    assert plain["e", "1"] == "other book" and plain["e", "2"] is None and "hyperref[sec:10]" in plain["d", "2"] and "[gone {x}]" in plain["d", "2"] and "sec:no" not in plain["d", "2"] and plain["d", "3"] == rows[2][2]
    terms = references.index_terms(df, ["doc"])
    assert sorted((r["term"], r["sections"]) for r in terms.collect()) == [("Ring", ["2", "3", "10"]), ("apple", ["10"])]
    index = references.render_index(terms, ["doc"]).first()["tex"]
    assert index.split("\n")[1:4] == ["\\item apple, \\hyperref[sec:10]{10}", "\\indexspace", "\\item Ring, \\hyperref[sec:2]{2}, \\hyperref[sec:3]{3}, \\hyperref[sec:10]{10}"]
    entries = references.glossary_entries(df, ["doc"])
    assert [tuple(r) for r in entries.collect()] == [("d", "Ring", "first", "2", 2)]
    assert references.render_glossary(entries, ["doc"]).first()["tex"] == "\\begin{description}\n\\item[Ring] first\n\\end{description}"


def page_files(spark, tmp_path, n=50):
    from folioforge.sources import pages as P

    rows = [(d, p, "{broken" if p == 7 else json.dumps(next(extract_demo("", p % 4, None))[1])) for d in ("a", "b") for p in range(n)]
    written = P.write_pages(spark.createDataFrame(rows, "doc_id string, page int, x string").repartition(5), f"{tmp_path}/p", F.col("x")).collect()
    assert sorted((r["doc_id"], r["n_pages"]) for r in written) == [("a", n), ("b", n)] and sorted(os.listdir(f"{tmp_path}/p")) == ["a", "b"]
    (tmp_path / "p/cut").write_bytes((tmp_path / "p/a").read_bytes()[:-3])
    return P.read_paginated(spark, [f"{tmp_path}/p/{d}" for d in ("a", "b", "cut")], "folioforge.sources.pages:PageFiles", 10)


def test_page_files(spark, tmp_path):
    df = page_files(spark, tmp_path)
    assert df.rdd.getNumPartitions() == 11
    rows = df.collect()
    good = [(r["doc_id"], r["page"]) for r in rows if r["error"] is None]
    assert sorted(good) == [(d, p) for d in ("a", "b") for p in range(50) if p != 7]
    assert sorted((r["doc_id"], r["page"], r["error"].split(":")[0]) for r in rows if r["error"]) == [("a", 7, "JSONDecodeError"), ("b", 7, "JSONDecodeError"), ("cut", 0, "ValueError")]


@pytest.mark.parametrize(
    ("condition", "tasks", "kept"),
    [("page >= 20 and page < 25", 3, [20, 21, 22, 23, 24]), ("page > 38 and doc_id = 'a'", 2, list(range(39, 50))), ("page = 45 and doc_id in ('b', 'x')", 1, [45]), ("page >= 100", 1, []), ("page <= 2 and doc_id = 'b'", 1, [0, 1, 2])],
)
def test_page_filters_are_pushed(spark, tmp_path, condition, tasks, kept):
    df = page_files(spark, tmp_path).where(condition)
    assert df.rdd.getNumPartitions() == tasks
    assert sorted({r["page"] for r in df.where("error is null").collect()}) == kept
    assert "page" in df._jdf.queryExecution().executedPlan().toString().split("BatchScan")[1]


def breaks_off(path, low, high):
    yield 0, {"blocks": [], "images": []}
    yield 1, ValueError("bad")
    yield 2, {"blocks": [], "images": []}
    raise OSError("gone")


def test_errors_of_pages_are_rows(spark):
    from folioforge.sources.pages import read_paginated

    got = read_paginated(spark, ["/x/a.pdf"], "tests.test_operators:breaks_off").orderBy("page").collect()
    assert [(r["page"], r["error"]) for r in got] == [(0, None), (1, "ValueError: bad"), (2, None), (3, "OSError: gone")]


def test_latex_document(spark):
    rows = spark.createDataFrame([("d", "6.10", "c"), ("d", "6.9", "b"), ("d", "1", "a")], "doc_id string, section_id string, tex string")
    assert render.document(rows, ["doc_id"], "P", "E").first()["tex"] == "Pa\n\nb\n\nc\nE"


def test_frames():
    text = frames.Frame("A title", author="Someone", part="I").preamble()
    used = set(re.findall(r'environment\("(\w+)"', inspect.getsource(render))) | {"deepresearch", "diagrambox"}
    known = set(re.findall(r"newtcolorbox\{(\w+)\}", text))
    assert used - known <= {"center", "quote"} and "\\begin{titlepage}" in text and "\\part{I}" in text and text.rstrip().endswith("\\part{I}")
    assert "titlepage" not in frames.Frame(contents=False).preamble() and "tableofcontents" not in frames.Frame(contents=False).preamble()


def test_fetch_and_compile(spark, tmp_path):
    urls = spark.createDataFrame([("http://h/a.png",), ("http://h/b.png",), ("http://h/bad.png",), (None,)], "url string")
    manifest = spark.createDataFrame([("a.png",)], "name string")

    def fetch(url):
        if "bad" in url:
            raise OSError("no")
        return url.encode()

    got = {r["name"]: (r["content"], r["error"]) for r in files.fetched(urls, manifest, fetch).collect()}
    assert bytes(got["b.png"][0]) == b"http://h/b.png" and got["bad.png"] == (None, "OSError: no") and set(got) == {"b.png", "bad.png"}
    tex = tmp_path / "a.tex"
    tex.write_text("x")
    assert files.compile_document(str(tex), ("no-such-program",))[0] is False and files.compile_document(str(tex), ("cat",)) == (True, "x")
    assert files.compile_document(str(tex), ("false",))[0] is False and "no end" in files.compile_document(str(tex), ("tail", "-f"), timeout_s=0.3)[1]


def test_chat_requests():
    chat = HttpModel("http://h", "qwen3:8b", chat=True, system="s", examples=(("q", "a"),))
    path, body = chat.request("p")
    assert path == "/api/chat" and [m["role"] for m in body["messages"]] == ["system", "user", "assistant", "user"] and body["options"]["num_predict"] == 7096
    path, body = HttpModel("http://h", "m").request("p")
    assert path == "/api/generate" and body["prompt"] == "p" and body["options"]["num_predict"] == 4096


@pytest.mark.parametrize(("shard", "few"), GLOSSARY_WAYS)
def test_glossary_counts_a_term_once(spark, monkeypatch, shard, few):
    monkeypatch.setattr(G, "SHARD_TERMS", shard)
    monkeypatch.setattr(G, "FEW", few)
    texts = spark.createDataFrame([(1, "Ring theory"), (1, "a ring"), (2, None), (None, "rings"), (3, "")], "id int, text string")
    terms = spark.createDataFrame([(0, "ring", "x"), (1, "theory", "y"), (2, "", "z")], "ord int, term string, gloss string")
    got = {r["id"]: (r["hint"], r["n_terms"]) for r in G.hints(texts, terms, "id", "text").collect()}
    assert got == {1: ("ring → x\ntheory → y", 2), None: ("ring → x", 1)}


def test_section_images(spark):
    out = book.sections_of(pages(spark)).select("section_id", "images").collect()
    assert all(r["images"] is not None for r in out)


def test_first_headers_do_not_follow_the_order_of_rows(spark, tmp_path):
    from folioforge.plans import registry

    # A number and its title of one line number and part, in both orders of the file.
    rows, found = [(1, 1, 2, 5, "A"), (1, 1, 2, 10, "R"), (2, 1, 2, 1, "A"), (2, 1, 2, 1, "N")], []
    for name, given in (("one", rows), ("two", rows[::-1])):
        df = spark.createDataFrame(given, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found.append({tuple(r) for r in registry.QUERIES["first_headers"](spark, f"{tmp_path}/{name}").collect()})
    assert found[0] == found[1] == {(1, "2", "2", 8.0)}


def test_first_headers_put_a_number_before_its_title(spark, tmp_path):
    from folioforge.plans import registry

    # Of two lines of one number and part, one is too small for a header's number, one is not bold.
    rows, found = [(1, 1, 2, 8, "A"), (1, 1, 2, 9, "R"), (2, 1, 2, 1, "N"), (2, 1, 2, 5, "A"), (2, 2, 2, 9, "R")], []
    for name, given in (("one", rows), ("two", rows[::-1])):
        df = spark.createDataFrame(given, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found.append({tuple(r) for r in registry.QUERIES["first_headers"](spark, f"{tmp_path}/{name}").collect()})
    assert found[0] == found[1] == {(1, "2", "2", 8.0)}


@pytest.mark.parametrize("name", ["section_render", "latex_math", "book_translation"])
def test_rows_of_a_small_file_are_work_of_all_cores(spark, name):
    from pyspark.sql import DataFrame

    from folioforge.plans import plan_queries, registry

    sf = "/root/testdata/sf0.001"
    df: DataFrame = plan_queries._parts(spark, sf) if name == "book_translation" else registry.QUERIES[name](spark, sf)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_parsed_trees_are_no_cycles(monkeypatch):
    import gc
    import weakref

    made = []

    class Watched(html.Node):
        __slots__ = ("__weakref__",)

        def __init__(self, *given):
            super().__init__(*given)
            made.append(weakref.ref(self))

    monkeypatch.setattr(html, "Node", Watched)
    gc.disable()
    try:
        html.parse_tree("<div><p>a<b>c</b></div>")
        assert len(made) == 4 and not [r for r in made if r() is not None]
    finally:
        gc.enable()


def test_search_takes_terms_from_a_text_once(spark):
    """The terms are an expression over long texts: one pass for each reading of the texts, none for filters."""
    kb = spark.createDataFrame([("The River", "long"), ("A Tensor", "many")], "title string, extract string")
    rows = spark.createDataFrame([(1, "Tensor of the sea"), (2, ""), (3, None), (4, "Nothing here"), (5, "River and tensor")], "id long, text string")
    found = knowledge.search(rows, kb, "id", T.search_terms(F.col("text"), most=4))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    passes = [line.count("regexp_extract_all") for line in plan.splitlines() if "regexp_extract_all" in line]
    assert passes and all(n == 1 for n in passes) and not any("Filter" in line for line in plan.splitlines() if "regexp_extract_all" in line)
    assert {(r["id"], r["title"], r["overlap"]) for r in found.collect()} == {(1, "A Tensor", 1), (5, "A Tensor", 1)}


def test_polish_reads_cleaned_texts(spark):
    """Texts are cleaned once: neither the second pass's prompts nor its comparison takes them through the cleaning again."""
    plans, store = {}, tables(spark)

    def persist(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, name)

    rows = spark.createDataFrame([("a", "T", "**One** text\n\nand two"), ("b", "U", "")], "key string, title string, content string")
    terms = spark.createDataFrame([(1, "text", "t")], "ord int, term string, gloss string")
    out = book.translate(rows, terms, StubModel("quote"), book.BookConfig(polish=True), persist)
    assert "array_sort" in plans["cleaned"] and "array_sort" not in plans["polished"] and "array_sort" not in plans["chunks"]
    assert {r["key"]: r["content_translated"] for r in out.collect()} == {"a": "One text\n\nand two", "b": None}
