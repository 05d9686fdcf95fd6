"""Queries that run the stages of the book and lecture plans with a model that answers from a list.

Fixed answers make every stage deterministic, so the SQL states what must come of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import parsing
from folioforge.functions import text as T
from folioforge.operators import frames, layout, references, render, scoring
from folioforge.plans import book, lecture, parts, registry
from folioforge.plans.model import StubModel, ask
from folioforge.plans.registry import STRIP, latex_sql, query, table
from folioforge.plans.stages import spread, tables
from folioforge.sources import files, pages
from folioforge.sources.keyed import KeyedTable
from folioforge.streaming import incremental, states

# Answers by what a prompt holds; the first that fits counts.
ANSWERS = (
    ("Translate this name.\nTensor", '"텐서"\nor so'),
    ("Translate this name.", "x"),
    ("Explain Tensor", "Here is it:\nA quantity with many components that change together."),
    ("Explain ", "too short"),
    ("List up to eight concepts", "1. Tensor\n- \"Manifold\"\n3. No such thing\nab"),
    ("List up to six factual claims", "1. The river is long and wide\n2. too short\n- A second claim that nobody knows"),
    ("Answer {\"preserved\": true or false}.\nThe river", '{"preserved": false}'),
    ("Does the translation keep this claim?", 'Sure: {"preserved": true}'),
    ("Rate from 1 to 10", 'My rating is {"score": "8"}'),
    ("List contradictions", '{"issues": ["one", "two"]}'),
    ("Claim nobody\nx", "I can't tell."),
    ("Does this text support the claim?", '{"supported": true}'),
    ("equivalent forms", '{"equivalent": 1}'),
    ("Summarise", "Here is a summary:\n**A long text** in a few words, but more than thirty."),
    ("Draw a diagram", "As asked: \\begin{tikzpicture}\\draw (0,0);\\end{tikzpicture}"),
    ("Give examples", "1. The first example of all\n2. short\n3. The third example of all"),
    ("Give exercises", "1. Solve this exercise\n2. And then this one too"),
    ("Solve them", "**Both** are easy."),
    ("List terms", "Tensor | 텐서\n# no\n2. Ring - 환\nnothing"),
)
MODEL = StubModel("quote", ANSWERS)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections made of parts: key, title, content; paragraphs with markup, one of them twice."""
    again = F.concat(F.lit("the same beginning of a paragraph: "), "p_type")
    body = F.concat(F.lit("**"), "p_name", F.lit("** <b>"), "p_type", F.lit("</b>\n\n- "), "p_brand", F.lit("\n\n"), again, F.lit("\n\n"), again, F.lit(" again"))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("# "), "p_name").alias("title"), body.alias("content"))


_BODY = "'**' || p_name || '** <b>' || p_type || '</b>' || chr(10) || chr(10) || '- ' || p_brand || chr(10) || chr(10) || 'the same beginning of a paragraph: ' || p_type || chr(10) || chr(10) || 'the same beginning of a paragraph: ' || p_type || ' again'"
# A list mark goes with the empty line before it.
_CLEAN = "p_name || ' ' || p_type || chr(10) || p_brand || chr(10) || chr(10) || 'the same beginning of a paragraph: ' || p_type"


@query(f"SELECT p_partkey::VARCHAR AS key, p_name AS title_translated, {_CLEAN} AS content_translated, NULL::VARCHAR AS translation_error FROM part")
def book_translation(spark, sf_dir):
    out = book.translate(_parts(spark, sf_dir), registry.glossary_table(spark), MODEL, book.BookConfig(), tables(spark))
    return out.select("key", "title_translated", "content_translated", "translation_error")


@query(f"SELECT p_partkey::VARCHAR AS key, {_CLEAN} AS content_translated FROM part")
def book_polish(spark, sf_dir):
    """The second pass, whose answers that lost too much are not taken: here the model gives back what it was given."""
    out = book.translate(_parts(spark, sf_dir), registry.glossary_table(spark), MODEL, book.BookConfig(polish=True), tables(spark))
    return out.select("key", "content_translated")


@query(f"SELECT p_partkey::VARCHAR AS key, {_CLEAN} AS content_translated FROM part")
def book_polish_refused(spark, sf_dir):
    """A second pass whose answers lose nearly all of a text: none is taken."""
    model = StubModel("quote", (("Polish this translation.", "lost"), *ANSWERS))
    out = book.translate(_parts(spark, sf_dir), registry.glossary_table(spark), model, book.BookConfig(polish=True), tables(spark))
    return out.select("key", "content_translated")


def _known(spark: SparkSession) -> DataFrame:
    rows = [
        ("Tensor", "A tensor " + "is described here " * 4), ("Manifold mathematics", "A manifold " + "is described here " * 4),
        ("River wide", "The river is long and wide in this entry of the table."), ("Claim nobody", "x"),
    ]
    return spark.createDataFrame(rows, "title string, extract string")


_TRANSLATED = f"CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN p_name ELSE {_CLEAN} END"
_TERM_ISSUES = "list_sum([" + ", ".join(f"(contains(lower(body), '{t}') AND NOT contains(translated, '{g}'))::INT" for t, g in registry.TERMS if len(t) > 4) + "])"


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module scores of parts whose translation is missing, lost paragraphs, or is whole."""
    k, rows = F.col("key").cast("long") % 5, _parts(spark, sf_dir)
    whole = F.regexp_replace(F.regexp_replace("content", r"\*\*|</?b>|\n- ", ""), "\n\n[^\n]* again$", "")
    rows = rows.withColumn("content_translated", F.when(k == 0, "").when(k == 1, F.regexp_extract("content", r"\*\*(.*?)\*\*", 1)).otherwise(whole))
    config, persist = book.BookConfig(), tables(spark)
    claims = persist(book.claims_of(rows, MODEL, config), "claims")
    _, modules = book.verify(rows, registry.glossary_table(spark), _known(spark), claims, MODEL, config, persist)
    return persist(modules, "modules")


_SCORES = f"""p AS (SELECT p_partkey::VARCHAR AS key, {_BODY} AS body, {_TRANSLATED} AS translated, p_partkey % 5 AS k FROM part),
    i AS (SELECT *, least(5, {_TERM_ISSUES})::INT AS lacking, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n FROM p),
    m AS (SELECT key, 'formula' AS module, 100 AS score, 0 AS n_issues, k = 0 AS skipped FROM i
        UNION ALL SELECT key, 'semantic', (CASE WHEN k = 0 THEN 70 ELSE 80 END - 3 * lacking - CASE WHEN 2 * n < 4 THEN 10 ELSE 0 END)::INT, lacking, k = 0 FROM i
        UNION ALL SELECT key, 'logic', 40, 3, k = 0 FROM i UNION ALL SELECT key, 'research', 50, 1, k = 0 FROM i)"""


@query(f"WITH {_SCORES} SELECT * FROM m")
def book_modules(spark, sf_dir):
    return _verified(spark, sf_dir)


@query(f"""WITH {_SCORES}, t AS (SELECT key, CASE WHEN bool_and(skipped) THEN 100 ELSE sum(score * CASE module WHEN 'formula' THEN 35 WHEN 'semantic' THEN 30 WHEN 'logic' THEN 20 ELSE 15 END) // 100 END::INT AS score FROM m GROUP BY key)
    SELECT key, score, {registry._BAND} AS band FROM t""")
def book_scores(spark, sf_dir):
    return scoring.overall(_verified(spark, sf_dir), "key")


@query("""SELECT doc_id, CASE WHEN length(text) >= 100 THEN 'Tensor|텐서|A quantity with many components that change together.|Tensor' END AS entries FROM documents""")
def book_enrichments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"))
    out = book.enrich(docs, _known(spark), StubModel("quote", (("Explain Tensor", "Here is it:\nA quantity with many components that change together."), *ANSWERS)), book.BookConfig(), tables(spark))
    line = F.transform("enrichments", lambda e: F.concat_ws("|", e["term"], e["title_ko"], e["explanation"], e["source"]))
    return out.select("doc_id", F.array_join(line, ";").alias("entries"))


_SUPPLEMENTS = "summary,tikz_diagram,examples,exercises,solutions,glossary"


@query(f"""SELECT doc_id::VARCHAR AS key, CASE WHEN long THEN 2 ELSE 0 END AS n_examples, CASE WHEN long THEN 2 ELSE 0 END AS n_exercises, CASE WHEN long THEN 2 ELSE 0 END AS n_terms,
    CASE WHEN long THEN length('A long text in a few words, but more than thirty.')::INT ELSE 0 END AS summary_chars, CASE WHEN long THEN '{_SUPPLEMENTS}' ELSE '' END AS kinds FROM (SELECT doc_id, coalesce(length(text), 0) >= 100 AS long FROM documents)""")
def book_supplements(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content_translated"))
    out = book.supplement_summary(book.supplement(docs, MODEL, book.BookConfig(), tables(spark)))
    return out.withColumn("kinds", F.array_join("kinds", ","))


class Unsteady(StubModel):
    """A model that fails for prompts that hold a word."""

    def generate(self, prompts: list[str]) -> list[str]:
        if any("STEEL" in p.upper() for p in prompts):
            raise TimeoutError("no answer")
        return super().generate(prompts)


@query("""SELECT p_partkey, CASE WHEN contains(upper(p_type), 'STEEL') AND p_partkey % 7 <> 0 THEN 'TimeoutError: no answer' END AS first_error,
    CASE WHEN p_partkey % 7 = 0 THEN '' WHEN contains(upper(p_type), 'STEEL') THEN 'again' ELSE 'Explain ' || p_type END AS answer FROM part""")
def model_calls(spark, sf_dir):
    """Calls of which some fail, each with its own error, and are asked again later; blank prompts are not asked; whose answer is stored is not asked again."""
    rows, path = table(spark, sf_dir, "part").select("p_partkey", "p_type"), f"{_folder(spark)}/answers"
    prompt = F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.concat(F.lit("Explain "), "p_type"))
    first = tables(spark)(ask(rows, "p_partkey", prompt, Unsteady(), path), "first")
    second = ask(rows, "p_partkey", prompt, StubModel("echo", (("", "again"),)), path)
    return second.select("p_partkey", "answer").join(first.select("p_partkey", F.col("error").alias("first_error")), "p_partkey")


#: Answers that tell how long their prompts were.
_MEASURED = (
    ("Summarise", "Here is a summary of {chars} characters."), ("Draw a diagram", "\\begin{tikzpicture}{chars}\\end{tikzpicture}"), ("Give examples", "1. An example for {chars} characters"),
    ("Give exercises", "1. Exercise for {chars} characters"), ("Solve them", "Solved {chars}"), ("List terms", "Term | {chars}"), ("List up to six factual claims", "1. A claim from {chars} characters"),
    ("List up to eight concepts", "1. Tensor"), ("Explain Tensor", "An explanation from {chars} characters, long enough."), ("Translate this name.", "Name"),
)


def _asked_sql(template: str, most: int) -> str:
    return f"({len(template) - len('{text}')} + least(length(text), {most}))"


_P = book.Prompts()


@query(f"""WITH n AS (SELECT doc_id, text, {_asked_sql(_P.exercises, 2500)} AS exercises FROM documents WHERE length(text) >= 100)
    SELECT doc_id, {_asked_sql(_P.summary, 3000)}::INT AS summary, {_asked_sql(_P.diagram, 2000)}::INT AS diagram, {_asked_sql(_P.examples, 2500)}::INT AS examples, exercises::INT AS exercises,
        ({len(_P.solutions) - 6} + length('Exercise for ' || exercises || ' characters'))::INT AS solutions, {_asked_sql(_P.glossary, 2500)}::INT AS glossary, {_asked_sql(_P.claims, 2000)}::INT AS claims,
        ({len(_P.explain) - len("{term}{text}{context}") + len("Tensor") + len("A tensor " + "is described here " * 4)} + least(length(text), 500))::INT AS explanation FROM n""")
def prompt_cuts(spark, sf_dir):
    """How much of a text each prompt holds, as the answers tell: supplements, claims, explanations."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"), F.col("text").alias("content_translated"))
    model, config, persist = StubModel("quote", _MEASURED), book.BookConfig(), tables(spark)
    long = persist(docs.where(F.length("content") >= 100), "long")
    claimed = book.claims_of(long, model, config).where("claim_idx = 0").select("key", "claim")
    done = book.supplement(book.enrich(long, _known(spark), model, config, persist), model, config, persist).join(claimed, "key", "left")
    number = lambda c, name: F.regexp_extract(c, r"(\d+)", 1).cast("int").alias(name)
    s = F.col("supplements")
    return done.select(
        "doc_id", number(s["summary"], "summary"), number(s["tikz_diagram"], "diagram"), number(s["examples"][0], "examples"), number(s["exercises"][0], "exercises"), number(s["solutions"], "solutions"),
        number(s["glossary"][0]["gloss"], "glossary"), number(F.col("claim"), "claims"), number(F.col("enrichments")[0]["explanation"], "explanation"),
    )


@query(rf"""WITH {latex_sql('conversations', 'conv_id, turn', 'text')}, n AS (SELECT conv_id, string_agg('\subsection{{Page ' || (turn + 1) || '}}' || chr(10) || '\label{{sec:page_' || (turn + 1) || '}}' || CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS body FROM g GROUP BY conv_id)
    SELECT conv_id, md5('\begin{{document}}' || chr(10) || body || chr(10) || '\end{{document}}') AS tex_md5 FROM n""")
def book_pages(spark, sf_dir):
    """Whole documents of a section per page, rendered in order of pages."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")
    none = spark.createDataFrame([], "doc_id long")
    rows = layout.page_sections(pages, none).withColumnRenamed("title", "title_original").withColumns({"title_translated": F.lit(None).cast("string"), "content_translated": F.col("content")})
    split = render.section(rows.withColumn("conv_id", F.col("doc_id")), ["conv_id"])
    out = render.document(split, ["conv_id"], "\\begin{document}\n")
    return out.select("conv_id", F.md5(F.col("tex").cast("binary")).alias("tex_md5"))


#: The driver's pages, read as lecture chapters.
_LECTURE = registry.PAGE_SELECTORS
_LECTURE_MODEL = StubModel("quote", (("Answer {\"category\"", '{"category": "keyconcept", "title": "", "extra": "note"}'),))


_ITEMS = registry.ORACLE_SQL["html_items"]
_QUOTES = "'\"'''"


@query(f"""WITH i AS ({_ITEMS}), t AS (SELECT page_id, item_idx, {STRIP.format("trim(" + STRIP.format("text") + ", " + _QUOTES + ")")} AS t FROM i)
    SELECT page_id, item_idx, md5(t) AS text_md5, NULL::VARCHAR AS box_type, CASE WHEN t <> '' THEN 'deepresearch|핵심 개념|note' END AS notes FROM t""")
def lecture_items(spark, sf_dir):
    """Items translated and put into categories: what the model gave back, and the notes it asked for."""
    items = lecture.items_of(table(spark, sf_dir, "pages"), "page_id", "html", _LECTURE)
    persist = tables(spark)
    done = persist(lecture.enrich(persist(lecture.translate(persist(items, "items"), registry.glossary_table(spark), _LECTURE_MODEL), "translated"), _LECTURE_MODEL), "enriched")
    sub = F.transform("sub_items", lambda x: F.concat_ws("|", x["type"], x["title"], x["text"]))
    return done.select("page_id", "item_idx", F.md5(F.col("text_ko").cast("binary")).alias("text_md5"), "box_type", F.array_join(sub, ";").alias("notes"))



# --- Files: what is written is read again ---------------------------------------------------------
def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section documents of nations."""
    n = table(spark, sf_dir, "nation")
    score = F.struct(F.lit(90).alias("score"), F.lit(False).alias("skipped"))
    return n.select(
        F.concat_ws(".", "n_regionkey", "n_nationkey").alias("section_id"), F.col("n_name").alias("title_original"), F.lit("section").alias("level"), F.lit(9.5).alias("font_size"),
        F.concat("n_name", F.lit("\nis \"here\"")).alias("content_original"), F.array(F.col("n_regionkey").cast("int"), F.col("n_nationkey").cast("int")).alias("page_range"),
        F.array(F.struct(F.concat("n_name", F.lit(".png")).alias("filename"), F.col("n_nationkey").cast("int").alias("page"))).alias("images"), F.struct(score.alias("formula"), F.lit(90).alias("score")).alias("verification"),
    )


def _folder(spark: SparkSession) -> str:
    return tables(spark).run


_SECTION = "n_regionkey || '.' || n_nationkey AS section_id, n_name AS title_original, n_name || chr(10) || 'is \"here\"' AS content_original, n_nationkey::INT AS last_page, n_name || '.png' AS filename, 90 AS score"


@query(f"SELECT {_SECTION} FROM nation")
def section_files(spark, sf_dir):
    """Section documents in a keyed table, written twice: the second version counts."""
    kept, rows = KeyedTable(spark, _folder(spark), "section_id", buckets=4), _nations(spark, sf_dir)
    kept.write(rows.withColumn("title_original", F.lit("old")))
    kept.write(rows)
    return _section_columns(kept.read())


def _section_columns(back: DataFrame) -> DataFrame:
    return back.select("section_id", "title_original", "content_original", F.col("page_range")[1].alias("last_page"), F.col("images")[0]["filename"].alias("filename"), "verification.formula.score")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE o_orderstatus END AS state, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'added' END AS note
    FROM orders WHERE o_orderkey % 7 <> 0""")
def keyed_versions(spark, sf_dir):
    """Orders in a keyed table: all, then some replaced with a column more, some removed, the deepest buckets rewritten, old versions deleted."""
    orders = table(spark, sf_dir, "orders")
    kept = KeyedTable(spark, _folder(spark), "o_orderkey", buckets=8, most_layers=2)
    kept.write(orders.select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("price")))
    kept.write(orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("late").alias("state"), F.lit("added").alias("note")))
    kept.remove(orders.where("o_orderkey % 7 = 0"))
    kept.vacuum()
    return kept.read().select("o_orderkey", "state", "price", "note")


@query("""SELECT r_name AS chapter_id, (dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS sec_idx, i::INT AS item_idx, ['paragraph', 'equation'][i + 1] AS type,
    CASE i WHEN 0 THEN n_name END AS text, CASE i WHEN 1 THEN 'x^' || n_nationkey END AS latex FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (0), (1)) AS v(i)""")
def chapter_files(spark, sf_dir):
    """Nested chapters written as JSON, read again, and flattened to items."""
    item = F.array(F.struct(F.lit("paragraph").alias("type"), F.col("n_name").alias("text"), F.lit(None).cast("string").alias("latex")),
                   F.struct(F.lit("equation").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("x^"), F.col("n_nationkey").cast("string")).alias("latex")))
    secs = F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("title"), item.alias("content"))))
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    chapters = both.groupBy(F.col("r_name").alias("chapter_id")).agg(F.transform(secs, lambda s: s.dropFields("n_nationkey")).alias("sections"))
    path = _folder(spark)
    chapters.withColumns({"chapter_title": F.col("chapter_id"), "key": F.col("chapter_id")}).write.partitionBy("key").json(path)
    return files.chapter_items(files.read_chapters(spark, path)).select("chapter_id", "sec_idx", "item_idx", "type", "text", "latex")


@query("SELECT n_regionkey::INT AS doc_id, md5(string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) || '\\end{document}') AS tex_md5 FROM nation GROUP BY n_regionkey")
def document_files(spark, sf_dir):
    """Documents rendered in natural order of section ids, written as text, and read again."""
    parts = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").cast("string").alias("section_id"), F.col("n_name").alias("tex"))
    path = _folder(spark)
    files.write_documents(render.document(parts, ["doc_id"]), path)
    back = spark.read.text(path, wholetext=True)
    return back.select("doc_id", F.md5(F.regexp_replace("value", "\n$", "").cast("binary")).alias("tex_md5"))


@query(f"SELECT {_SECTION.replace('n_name AS title_original', 'lower(n_name) AS title_original')} FROM nation")
def streamed_sections(spark, sf_dir):
    """Two runs over a folder of files: each takes what is new, and replaces rows by key."""
    rows, folder = _nations(spark, sf_dir), _folder(spark)
    kept = KeyedTable(spark, f"{folder}/out", "section_id", buckets=4)
    for part in (rows.where("section_id < '3'").withColumn("content_original", F.lit("old")), rows):
        part.write.mode("append").json(f"{folder}/in")
        new = incremental.new_files(spark, f"{folder}/in", multi_line=False)
        incremental.upsert(new, lambda df: df.withColumn("title_original", F.lower("title_original")), kept, f"{folder}/state").awaitTermination()
    return _section_columns(kept.read())


@query(r"""WITH p AS (SELECT conv_id // 50 AS book, row_number() OVER (PARTITION BY conv_id // 50 ORDER BY conv_id, turn) - 1 AS page, text FROM conversations)
    SELECT 'book-' || book AS doc_id, page::BIGINT AS page, CASE WHEN page % 17 <> 5 THEN md5(text) END AS text_md5, CASE WHEN page % 17 = 5 THEN 'JSONDecodeError' END AS error FROM p WHERE page >= 3 AND page < 150""")
def paginated_pages(spark, sf_dir):
    """Books of pages written as page files, some pages broken, and a range of pages read again: ranges of a file are tasks."""
    w = Window.partitionBy("doc_id").orderBy("conv_id", "turn")
    turns = table(spark, sf_dir, "conversations").withColumn("doc_id", F.concat(F.lit("book-"), F.floor(F.col("conv_id") / 50).cast("string")))
    placed = turns.select("doc_id", (F.row_number().over(w) - 1).alias("page"), "text")
    span = F.struct("text", F.lit("Body").alias("font"), F.lit(8.0).alias("size"))
    box = F.struct(*[F.lit(float(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    block = F.struct(F.lit(0).alias("type"), box.alias("bbox"), F.array(F.struct(F.array(span).alias("spans"))).alias("lines"))
    whole = F.to_json(F.struct(F.array(block).alias("blocks"), F.array().cast("array<string>").alias("images")))
    written = pages.write_pages(placed, _folder(spark), F.when(F.col("page") % 17 == 5, F.left(whole, F.lit(40))).otherwise(whole))
    paths = [r["path"] for r in written.select("path").collect()]  # one for each book
    back = layout.page_range(pages.read_paginated(spark, paths, "folioforge.sources.pages:PageFiles", 20), 3, 150)
    text = F.col("blocks")[0]["lines"][0]["spans"][0]["text"]
    return back.select("doc_id", F.col("page").cast("bigint").alias("page"), F.md5(text.cast("binary")).alias("text_md5"), F.split("error", ":")[0].alias("error"))


@query("""SELECT s_suppkey::VARCHAR AS key, CASE s_suppkey % 5 WHEN 2 THEN 'failed' WHEN 3 THEN 'expired' WHEN 4 THEN 'late' ELSE 'answered' END AS state,
    CASE s_suppkey % 5 WHEN 2 THEN 'no 3' WHEN 3 THEN NULL ELSE s_name END AS text, CASE s_suppkey % 5 WHEN 2 THEN 3 ELSE 1 END AS tries, CASE s_suppkey % 5 WHEN 2 THEN 4 WHEN 4 THEN 3 ELSE 2 END AS number FROM supplier""")
def stage_states(spark, sf_dir):
    """Three runs of a stream of asks, answers and failures by supplier, with repeats: each key's work has one state and one result."""
    k, folder = F.col("s_suppkey"), _folder(spark)
    at = lambda minute: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute))
    event = lambda kind, text, minute: F.struct(F.lit(kind).alias("kind"), (text if text is not None else F.lit(None).cast("string")).alias("text"), at(minute).alias("ts"))
    name, group = F.col("s_name"), k % 5
    runs = (
        F.when(group == 0, F.array(event("ask", None, 0), event("answer", name, 1))).when(group == 2, F.array(event("ask", None, 0), *[event("fail", F.lit(f"no {n}"), n) for n in (1, 2)])).otherwise(F.array(event("ask", None, 0))),
        F.when(group == 1, F.array(event("ask", None, 20), event("answer", name, 30))).when(group == 2, F.array(event("fail", F.lit("no 3"), 31))).otherwise(F.array(event("ask", None, 20))),
        F.when(group == 4, F.array(event("answer", name, 300))).otherwise(F.array(event("ask", None, 300))),
    )
    kept = KeyedTable(spark, f"{folder}/states", "key", buckets=4)
    for run in runs:
        rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("key"), F.inline(run))
        rows.write.mode("append").parquet(f"{folder}/events")
        stream = incremental.new_files(spark, f"{folder}/events", states.EVENTS, "parquet")
        states.settle(stream, kept, f"{folder}/checkpoint", wait_s=7200).awaitTermination()
    return kept.read().select("key", "state", "text", "tries", "number")


@query(r"""WITH i AS (SELECT conv_id, turn, k, CASE (turn + k) % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'other' WHEN 2 THEN 'svg' END AS kind, CASE (turn + k) % 4 WHEN 0 THEN '\x89PNG\x0D\x0A\x1A\x0A'::BLOB || encode(role) WHEN 1 THEN encode(role) WHEN 2 THEN encode('<svg>' || role) END AS content
        FROM conversations, (VALUES (1), (2)) AS v(k))
    SELECT conv_id::VARCHAR AS doc_id, turn::BIGINT AS page, 'page_' || (turn + 1) || '_img_' || k || '.png' AS filename, md5(content) AS content_md5, coalesce(kind, 'other') AS kind, CASE WHEN kind IS NULL THEN CASE WHEN k = 1 THEN 'no data' ELSE 'no base64' END END AS error FROM i""")
def image_bytes(spark, sf_dir):
    """Images that pages carry: whole ones of several kinds, ones without data, ones that cannot be decoded."""
    def image(k: int):
        n, role = (F.col("turn") + k) % 4, F.col("role").cast("binary")
        content = F.when(n == 0, F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), role)).when(n == 1, role).when(n == 2, F.concat(F.lit(b"<svg>"), role))
        data = F.coalesce(F.base64(content), F.lit("" if k == 1 else "no*base64!"))
        return F.struct(F.lit("png").alias("ext"), F.lit(None).cast("struct<x:double,y:double,width:double,height:double>").alias("position"), data.alias("data"))

    made = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("page"), F.array(image(1), image(2)).alias("images"))
    return pages.page_images(made).select("doc_id", "page", "filename", F.md5("content").alias("content_md5"), F.when(F.col("error").isNull(), F.col("kind")).otherwise("other").alias("kind"), "error")


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS head FROM conversations),
    f AS (SELECT conv_id, turn, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS h, max(head) OVER (PARTITION BY conv_id) IS NULL AS bare FROM r),
    s AS (SELECT conv_id, turn, CASE WHEN bare THEN 'page_' || (turn + 1) ELSE '1.' || h END AS section_id FROM f WHERE bare OR h IS NOT NULL),
    i AS (SELECT *, unnest(range(1, turn % 3 + 2)) AS k FROM s)
    SELECT conv_id::VARCHAR AS doc_id, section_id, string_agg('page_' || (turn + 1) || '_img_' || k || '.png@' || (turn + 1), ' ' ORDER BY turn, k) AS shown FROM i GROUP BY conv_id, section_id""")
def section_images(spark, sf_dir):
    """Sections of pages with headers of their own, and the images of all their pages in order."""
    span = lambda text, font: F.struct(text.alias("text"), F.lit(font).alias("font"), F.lit(9.5).alias("size"))
    turn, box = F.col("turn"), F.struct(*[F.lit(float(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    line = lambda *spans: F.struct(F.lit(0).alias("type"), box.alias("bbox"), F.array(F.struct(F.array(*spans).alias("spans"))).alias("lines"))
    head = line(span(F.concat(F.lit("1."), turn.cast("string")), "Body-Bold"), span(F.lit("Title"), "Body-Bold"))
    body = line(span(F.col("text"), "Body"))
    image = F.struct(F.lit("png").alias("ext"), F.lit(None).cast("struct<x:double,y:double,width:double,height:double>").alias("position"))
    made = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), turn.cast("int").alias("page"), F.when(F.col("role") == "user", F.array(head, body)).otherwise(F.array(body)).alias("blocks"),
        F.transform(F.sequence(F.lit(1), (turn % 3 + 1).cast("int")), lambda _: image).alias("images"),
    )
    shown = F.transform("images", lambda i: F.concat_ws("@", i["filename"], i["page"].cast("string")))
    return book.sections_of(made).select("doc_id", "section_id", F.array_join(shown, " ").alias("shown"))


_FRAME = frames.Frame(subtitle="Nations", author="x")


@query(f"""WITH r AS (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE '' END AS title, CASE WHEN r_regionkey % 3 = 0 THEN 'Part ' || r_regionkey ELSE '' END AS part FROM region)
    SELECT r_regionkey AS doc_id, md5(CASE WHEN title <> '' AND part <> '' THEN replace(replace(chr(1) || '{frames.Frame("@T", "Nations", "x", "@P").preamble()}', '@T', title), '@P', part) WHEN title <> '' THEN replace(chr(1) || '{frames.Frame("@T", "Nations", "x").preamble()}', '@T', title)
        WHEN part <> '' THEN replace(chr(1) || '{frames.Frame("", "Nations", "x", "@P").preamble()}', '@P', part) ELSE chr(1) || '{_FRAME.preamble()}' END || (SELECT string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) || chr(10) || '\\end{{document}}') AS tex_md5 FROM r""".replace("\\\\end", "\\end"))
def framed_documents(spark, sf_dir):
    """Whole documents: class, boxes, title page, contents and part, of which some books lack the title or the part."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("r_regionkey")
    rows = both.select(k.alias("doc_id"), F.when(k % 2 == 0, F.col("r_name")).alias("title"), F.when(k % 3 == 0, F.concat(F.lit("Part "), k.cast("string"))).otherwise("").alias("part"), F.col("n_nationkey").cast("string").alias("section_id"), F.col("n_name").alias("tex"))
    head = F.concat(F.lit("\x01"), _FRAME.preamble_of(title=F.col("title"), part=F.col("part")))
    return render.document(rows, ["doc_id", "title", "part"], head).select("doc_id", F.md5(F.col("tex").cast("binary")).alias("tex_md5"))


# --- Parts and global order ------------------------------------------------------------------------
@query("""WITH d AS (SELECT 'part-' || (doc_id % 3 + 9) AS part, doc_id, md5(coalesce(text, '')) AS text_md5, CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 2 END AS run FROM documents)
    SELECT part, doc_id, text_md5, run, row_number() OVER (ORDER BY length(part), part, doc_id) AS rank FROM d""")
def part_runs(spark, sf_dir):
    """Three parts in three runs: two, the third, and nothing; then all rows with their numbers in natural order."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("part-"), (F.col("doc_id") % 3 + 9).cast("string")).alias("part"), "doc_id", "text")
    kept, did = parts.Parts(spark, _folder(spark), "part"), []
    for rows in (docs.where("doc_id % 3 < 2"), docs, docs):
        number = len(did) + 1
        did.append(kept.run(rows, lambda df, n=number: df.select("part", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.lit(n).alias("run"))))
    if did[2]:
        raise AssertionError(f"done again: {did[2]}")
    return parts.numbered(kept.read(), [T.natural_key(F.replace("part", F.lit("-"), F.lit("."))), F.col("doc_id")], tables(spark))


@query(f"""WITH o AS (SELECT o_orderkey, {registry._IDS} AS sid FROM orders)
    SELECT o_orderkey, sid AS section_id, row_number() OVER (ORDER BY {registry._KEY}, o_orderkey) AS rank FROM o""")
def ordered_sections(spark, sf_dir):
    """The natural order of all section ids, by ranges."""
    rows = registry._section_ids(spark, sf_dir).select("o_orderkey", "section_id")
    return parts.numbered(rows, [T.natural_key(F.col("section_id")), F.col("o_orderkey")], tables(spark))


# --- Answers that fall back -----------------------------------------------------------------------
@query(r"""SELECT p_partkey, p_name || ' first item more of it|second item of ' || p_type AS items, CASE p_partkey % 3 WHEN 0 THEN false ELSE true END AS preserved, p_partkey % 3 = 1 AS supported,
    CASE p_partkey % 3 WHEN 2 THEN 0 ELSE 3 END AS n_issues, p_name || ' 한국' AS kept FROM part""")
def answer_defaults(spark, sf_dir):
    """Numbered lines, verdicts that default where an answer does not parse, and scripts that a translation must not hold."""
    name = F.col("p_name")
    lines = F.concat(F.lit("1. "), name, F.lit(" first item\nmore of it\n2) second item of "), F.col("p_type"), F.lit("\n3. short"))
    k = F.col("p_partkey") % 3
    answer = F.when(k == 0, '{"preserved": false, "issues": [1, "b", "c", "d"]}').when(k == 1, 'Yes: {"preserved": true, "supported": true, "issues": ["a", "b", "c"]}').otherwise("no JSON here")
    parsed = parsing.json_from_text(answer, "preserved boolean, supported boolean, issues array<string>")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array_join(parsing.line_items(lines), "|").alias("items"), parsed.alias("j"), T.strip_foreign_scripts(F.concat(name, F.lit(" 한국漢字かなкиรสعر"))).alias("kept"))
    issues = F.size(F.slice(F.coalesce("j.issues", F.array().cast("array<string>")), 1, 3))
    return rows.select("p_partkey", "items", F.coalesce("j.preserved", F.lit(True)).alias("preserved"), F.coalesce("j.supported", F.lit(False)).alias("supported"), issues.alias("n_issues"), "kept")


@query("""SELECT p_partkey, p_name || ' see \\hyperref[sec:IV-' || (p_partkey % 7) || '-2]{[IV.' || (p_partkey % 7) || '§2]} and \\hyperref[sec:II-3]{[II.3]}, not [x.1] or [IV]' AS linked FROM part""".replace("\\\\", "\\"))
def cross_references(spark, sf_dir):
    text = F.concat("p_name", F.lit(" see [IV."), (F.col("p_partkey") % 7).cast("string"), F.lit("§2] and [II.3], not [x.1] or [IV]"))
    return table(spark, sf_dir, "part").select("p_partkey", render.cross_references(text).alias("linked"))


# --- Labels, index and glossary of documents made of parts ------------------------------------------
def _book_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of books by brand: a label each, two links, terms for the index, an entry for the glossary."""
    k = F.col("p_partkey")
    number = lambda n: F.concat(F.lit("[II."), (n % 40 + 1).cast("string"), F.lit("§"), F.col("p_size").cast("string"), F.lit("]"))
    label = F.concat(F.lit("\\label{sec:II-"), (k % 40 + 1).cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit("}"))
    tex = F.concat(label, F.lit(" see "), render.cross_references(number(k * 7)), F.lit(" and "), render.cross_references(number(k + 1)), F.lit(" \\index{"), "p_type", F.lit("} \\term{ "), F.lower("p_type"), F.lit("}"))
    entry = F.struct(F.col("p_name").alias("term"), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")).alias("gloss"))
    return table(spark, sf_dir, "part").select("p_brand", F.concat_ws(".", k % 40 + 1, "p_size", k).alias("section_id"), tex.alias("tex"), F.array(entry).alias("glossary"))


_BOOK_SECTIONS = r"""s AS (SELECT p_brand, p_name, p_type, p_partkey AS k, p_partkey % 40 + 1 AS a, p_size AS b, 'sec:II-' || (p_partkey % 40 + 1) || '-' || p_size AS label,
        'sec:II-' || (p_partkey * 7 % 40 + 1) || '-' || p_size AS one, 'sec:II-' || ((p_partkey + 1) % 40 + 1) || '-' || p_size AS two, (p_partkey % 40 + 1) || '.' || p_size || '.' || p_partkey AS section_id FROM part)"""


@query(f"""WITH {_BOOK_SECTIONS}, r AS (SELECT p_brand, section_id, 0 AS place, one AS label FROM s UNION ALL SELECT p_brand, section_id, 1, two FROM s),
    l AS (SELECT p_brand, label, arg_min(section_id, [a, b, k]) AS target, count(*) AS n FROM s GROUP BY ALL)
    SELECT r.p_brand, r.section_id, r.place, r.label, l.target, CASE WHEN l.n IS NULL THEN 'broken' WHEN l.n > 1 THEN 'ambiguous' ELSE 'ok' END AS state FROM r LEFT JOIN l ON l.p_brand = r.p_brand AND l.label = r.label""")
def checked_references(spark, sf_dir):
    return references.checked_references(_book_sections(spark, sf_dir), ["p_brand"])


@query(f"""WITH {_BOOK_SECTIONS}, r AS (SELECT p_brand, section_id, a, b, k, one AS label FROM s UNION ALL SELECT p_brand, section_id, a, b, k, two FROM s),
    x AS (SELECT r.* FROM r ANTI JOIN s ON s.p_brand = r.p_brand AND s.label = r.label)
    SELECT p_brand, label, count(*) AS n_references, (SELECT string_agg(section_id, ' ' ORDER BY a, b, k) FROM (SELECT DISTINCT section_id, a, b, k FROM x AS y WHERE y.p_brand = x.p_brand AND y.label = x.label)) AS sections FROM x GROUP BY p_brand, label""")
def broken_references(spark, sf_dir):
    out = references.broken_references(_book_sections(spark, sf_dir), ["p_brand"])
    return out.withColumn("sections", F.array_join("sections", " "))


@query(rf"""WITH {_BOOK_SECTIONS}, l AS (SELECT p_brand, lower(p_type) AS low, arg_min(least(p_type, lower(p_type)), [a, b, k]) AS term, string_agg('\hyperref[sec:' || replace(section_id, '.', '-') || ']{{' || section_id || '}}', ', ' ORDER BY a, b, k) AS links FROM s GROUP BY ALL),
    g AS (SELECT *, CASE WHEN left(lag(low) OVER (PARTITION BY p_brand ORDER BY low), 1) <> left(low, 1) THEN '\indexspace' || chr(10) ELSE '' END AS gap FROM l)
    SELECT p_brand, md5('\begin{{theindex}}' || chr(10) || string_agg(gap || '\item ' || term || ', ' || links, chr(10) ORDER BY low) || chr(10) || '\end{{theindex}}') AS tex_md5 FROM g GROUP BY p_brand""")
def document_index(spark, sf_dir):
    """Terms that differ in case only are one; the way of writing that comes first counts."""
    terms = references.index_terms(_book_sections(spark, sf_dir), ["p_brand"])
    return references.render_index(terms, ["p_brand"]).select("p_brand", F.md5(F.col("tex").cast("binary")).alias("tex_md5"))


@query(f"""WITH {_BOOK_SECTIONS} SELECT p_brand, p_name AS term, arg_min(p_type, [a, b, k]) AS gloss, arg_min(section_id, [a, b, k]) AS section_id, count(DISTINCT p_type) AS n_glosses FROM s GROUP BY p_brand, p_name""")
def document_glossary(spark, sf_dir):
    return references.glossary_entries(_book_sections(spark, sf_dir), ["p_brand"])


_TITLE = "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '제목' END"
_BR = " || chr(10) || "


@query(rf"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '\chapter' ELSE '\section' END || '{{' || {_TITLE} || '}}' {_BR} '\label{{sec:' || (p_partkey % 9) || '-' || p_size || '}}' || chr(10) {_BR} p_type
    || chr(10) {_BR} '\begin{{researchbox}}[텐서]' {_BR} 'Explained \& shown' {_BR} '{{\scriptsize \textit{{출처: Wikipedia --- ' || p_name || '}}}}' {_BR} '\end{{researchbox}}'
    || chr(10) {_BR} '\begin{{verificationbox}}' {_BR} '\textbf{{종합 점수: 80/100 (양호)}} \\[2pt]' {_BR} '{{\small 수식 100}}' {_BR} '\end{{verificationbox}}'
    || chr(10) {_BR} '\begin{{summarybox}}' {_BR} 'In short' {_BR} '\end{{summarybox}}'
    || chr(10) {_BR} '\begin{{center}}' {_BR} '\resizebox{{\textwidth}}{{!}}{{\begin{{tikzpicture}}\end{{tikzpicture}}}}' {_BR} '\end{{center}}'
    || chr(10) {_BR} '\begin{{examplebox}}[예시 1]' {_BR} 'first' {_BR} '\end{{examplebox}}' {_BR} '\begin{{examplebox}}[예시 2]' {_BR} p_name {_BR} '\end{{examplebox}}'
    || chr(10) {_BR} '\begin{{exercisebox}}' {_BR} '\textbf{{1.}} do $x^2$\\[4pt]' {_BR} '\end{{exercisebox}}'
    || chr(10) {_BR} '\begin{{glossarybox}}' {_BR} '\textbf{{Ring}} --- 환 \\' {_BR} '\textbf{{Field}} --- 체' {_BR} '\end{{glossarybox}}'
    || chr(10) {_BR} '\paragraph{{풀이}}' {_BR} 'done' AS tex FROM part""")
def section_render(spark, sf_dir):
    """Sections with every part that rendering knows, in its fixed order."""
    k, text = F.col("p_partkey"), F.lit(None).cast("string")
    entry = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("term", "title_ko", "explanation", "source"))])
    entries = F.array(entry(F.lit("Tensor"), F.lit("텐서"), F.lit("Explained & shown"), F.col("p_name")), entry(F.lit("Empty"), text, F.lit(""), text))
    pair = lambda a, b: F.struct(F.lit(a).alias("term"), F.lit(b).alias("gloss"))
    supplements = F.struct(
        F.lit("In short").alias("summary"), F.lit("\\begin{tikzpicture}\\end{tikzpicture}").alias("tikz_diagram"), F.array(F.lit("first"), F.col("p_name")).alias("examples"),
        F.array(F.lit("do x^2")).alias("exercises"), F.lit("done").alias("solutions"), F.array(pair("Ring", "환"), pair("Field", "체")).alias("glossary"),
    )
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", F.concat((k % 9).cast("string"), F.lit("."), F.col("p_size").cast("string")).alias("section_id"), F.col("p_name").alias("title_original"),
        F.when(k % 2 == 1, "제목").otherwise("").alias("title_translated"), F.when(k % 3 == 0, "section").alias("level"), F.lit(8.1).alias("font_size"), F.col("p_type").alias("content_translated"),
        entries.alias("enrichments"), F.lit(80).alias("score"), F.lit("양호").alias("band"), F.lit("수식 100").alias("line"), supplements.alias("supplements"),
    )
    return render.section(rows, ["p_partkey"]).select("p_partkey", "tex")


_NOTE = r"chr(10) || '\begin{deepresearch}{핵심 개념}' || chr(10) || 'note' || chr(10) || '\end{deepresearch}'"
_FIRST = r"'\lettrine[lines=2]{' || left(t, 1) || '}{' || substr(t, 2) || '}'"
_ESCAPED = registry.outside_sql("chapter_title", render.DOLLARS, r"regexp_replace(s[1], '([&%#])', '\\\1', 'g')")


@query(rf"""WITH i AS ({_ITEMS}), t AS (SELECT *, {STRIP.format("trim(" + STRIP.format("text") + ", " + _QUOTES + ")")} AS t FROM i),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY t = '', item_idx) = 1 AS is_first FROM t),
    b AS (SELECT page_id, chapter_title, string_agg(CASE WHEN is_first AND t <> '' THEN {_FIRST} ELSE t END || CASE WHEN t <> '' THEN {_NOTE} ELSE '' END, chr(10) || chr(10) ORDER BY item_idx) AS body FROM f GROUP BY page_id, chapter_title)
    SELECT page_id, md5('\chapter{{' || {_ESCAPED} || '}}' || chr(10) || '\label{{ch:' || page_id || '}}' || chr(10) || chr(10) || '\section{{}}' || chr(10) || chr(10) || body || chr(10) || '\end{{document}}') AS tex_md5 FROM b""")
def lecture_chapters(spark, sf_dir):
    """The whole lecture plan: pages to chapters of text."""
    manifest = spark.createDataFrame([], "name string")
    out = lecture.run(table(spark, sf_dir, "pages"), "page_id", "html", registry.glossary_table(spark), manifest, _LECTURE_MODEL, _LECTURE, persist=tables(spark))
    return out.select(F.col("chapter_id").cast("bigint").alias("page_id"), F.md5(F.col("tex").cast("binary")).alias("tex_md5"))


_LAYOUT = registry.ORACLE_SQL["page_text_layout"].replace("md5(string_agg(line, chr(10) ORDER BY i, k)) AS text_md5", "string_agg(line, chr(10) ORDER BY i, k) AS page_text")
_CHECKED = r"chr(10) || chr(10) || '\begin{verificationbox}' || chr(10) || '\textbf{종합 점수: 100/100 (우수)} \\[2pt]' || chr(10) || '{\small ' || CASE WHEN blank THEN '' ELSE '수식 100' END || '}' || chr(10) || '\end{verificationbox}'"


@query(rf"""WITH z AS ({_LAYOUT}), p AS (SELECT conv_id, turn, coalesce(page_text, '') AS page_text FROM conversations LEFT JOIN z USING (conv_id, turn)), {latex_sql('p', 'conv_id, turn', 'page_text')},
    s AS (SELECT conv_id, turn, '\subsection{{Page ' || (turn + 1) || '}}' || chr(10) || '\label{{sec:page_' || (turn + 1) || '}}' || CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END || {_CHECKED} AS tex
        FROM (SELECT conv_id, turn, t, page_text = '' AS blank FROM g JOIN p USING (conv_id, turn)))
    SELECT conv_id, md5('\begin{{document}}' || chr(10) || string_agg(tex, chr(10) || chr(10) ORDER BY turn) || chr(10) || '\end{{document}}') AS tex_md5 FROM s GROUP BY conv_id""")
def book_documents(spark, sf_dir):
    """The book plan over pages of blocks and spans, without a model: layout, sections, formula check, scores, document."""
    config = book.BookConfig(translate=False, verify=("formula",), enrich=False, supplements=False)
    out = book.run(registry._made_pages(spark, sf_dir), registry.glossary_table(spark), _known(spark), MODEL, config, "\\begin{document}\n", tables(spark))
    return out.select(F.col("doc_id").cast("bigint").alias("conv_id"), F.md5(F.col("tex").cast("binary")).alias("tex_md5"))
