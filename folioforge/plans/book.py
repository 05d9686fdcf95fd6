"""The book plan: pages -> sections -> translation -> verification -> enrichment -> supplements -> document.

Stages that are switched off are left out of the plan. Model calls go through plans.model; prompts
are parameters with short defaults of our own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import mathtok, parsing
from folioforge.functions import text as T
from folioforge.operators import glossary as G
from folioforge.operators import knowledge, layout, paragraphs, render, scoring
from folioforge.plans.model import ModelClient, call
from folioforge.plans.stages import Persist, tables


@dataclass(frozen=True)
class Prompts:
    translate: str = "Translate, keeping formulas as they are.\n{hint}\n\n{text}"
    polish: str = "Polish this translation.\n\n{text}"
    claims: str = "List up to six factual claims, one per line.\n\n{text}"
    preserved: str = 'Does the translation keep this claim? Answer {"preserved": true or false}.\n{claim}\n\n{text}'
    meaning: str = 'Rate from 1 to 10 how far the meaning is kept. Answer {"score": n}.\n{original}\n\n{translated}'
    equivalent: str = 'How many of these formulas stand in the translation in equivalent forms? Answer {"equivalent": n}.\n{missing}\n\n{original}\n\n{translated}'
    fact: str = 'Does this text support the claim? Answer {"supported": true or false}.\n{claim}\n\n{title}\n{extract}'
    logic: str = 'List contradictions as {"issues": [..]}.\n\n{text}'
    concepts: str = "List up to eight concepts worth explaining, one per line.\n\n{text}"
    explain: str = "Explain {term} from this.\n\n{text}\n\nIt stands in: {context}"
    title: str = "Translate this name.\n{term}"
    summary: str = "Summarise.\n\n{text}"
    diagram: str = "Draw a diagram of this as a tikzpicture.\n\n{text}"
    examples: str = "Give examples, numbered.\n\n{text}"
    exercises: str = "Give exercises, numbered.\n\n{text}"
    solutions: str = "Solve them.\n\n{text}"
    glossary: str = "List terms as term | gloss.\n\n{text}"


@dataclass(frozen=True)
class BookConfig:
    translate: bool = True
    polish: bool = False
    verify: tuple[str, ...] = ("formula", "semantic", "logic", "research")
    enrich: bool = True
    supplements: bool = True
    chunk: int = 2000
    #: Claims are checked against an entry by the model; otherwise by the words that they share with it.
    ask_facts: bool = True
    prompts: Prompts = field(default_factory=Prompts)


def fill(template: str, **columns):
    """A prompt column: the template with its {names} replaced by columns."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out


def sections_of(pages: DataFrame, end_page: int | None = None) -> DataFrame:
    """Sections of page documents (layout.PAGE_SCHEMA); documents without headers give a section per page."""
    text = pages.select("doc_id", "page").join(layout.page_text(pages), ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    shown = layout.images(pages).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("img_idx", "filename", "position"))).alias("i"))
    shown = shown.select("doc_id", "page", F.transform("i", lambda x: F.struct(x["filename"].alias("filename"), x["position"].alias("position"), (F.col("page") + 1).alias("page"))).alias("images"))
    text = text.join(shown, ["doc_id", "page"], "left").withColumn("images", F.coalesce("images", F.array().cast(shown.schema["images"].dataType)))
    heads = layout.first_header(layout.headers(layout.spans(pages)))
    found = layout.assemble_sections(text, heads, end_page)
    pick = ["doc_id", "section_id", "title", "font_size", "level", "content", "start_page", "end_page", "images"]
    unique = layout.last_wins(found.select(*pick, "section_no"), ["doc_id", "section_id"], F.col("section_no")).drop("n_rows", "section_no")
    lone = layout.page_sections(text, found)
    return unique.select(*pick).unionByName(lone.select(*pick)).withColumn("key", F.concat_ws("/", "doc_id", "section_id"))


def translate(sections: DataFrame, glossary: DataFrame, client: ModelClient, config: BookConfig, persist: Persist) -> DataFrame:
    """Adds title_translated, content_translated, translation_error: chunk by chunk, cleaned, joined in order."""
    chunks = paragraphs.chunks(sections, "key", "content", "\n\n", config.chunk).withColumn("cid", F.concat_ws("#", "key", F.lpad(F.col("chunk_idx").cast("string"), 6, "0")))
    titles = sections.select("key", F.lit(-1).alias("chunk_idx"), F.col("title").alias("chunk"), F.concat_ws("#", "key", F.lit("title")).alias("cid"))
    parts = chunks.select("key", "chunk_idx", "chunk", "cid").unionByName(titles)
    hinted = parts.join(G.hints(parts, glossary, "cid", "chunk").select("cid", "hint"), "cid", "left")
    asked = F.when(T.is_blank(F.col("chunk")), "").otherwise(fill(config.prompts.translate, hint=F.col("hint"), text=F.col("chunk")))
    answers = persist(call(hinted, "cid", asked, client), "answers")
    cleaned = paragraphs.clean_translated(answers, "cid", "answer").join(answers.select("cid", "error"), "cid")
    if config.polish:
        cleaned = persist(cleaned, "cleaned")  # read twice: cleaning is most of a pass's work
        second = persist(call(cleaned, "cid", fill(config.prompts.polish, text=F.col("text")), client), "polished").withColumnRenamed("error", "polish_error")
        joined = cleaned.join(second, "cid")
        cleaned = joined.withColumn("text", T.accept_polish(F.col("text"), T.py_strip(F.coalesce("answer", F.lit(""))), F.col("polish_error"))).drop("answer", "polish_error")
    done = persist(parts.select("key", "chunk_idx", "cid").join(cleaned, "cid"), "chunks")
    body = paragraphs.implode(done.where("chunk_idx >= 0"), "key", "chunk_idx", "text", "\n\n", "content_translated")
    title = done.where("chunk_idx < 0").select("key", F.col("text").alias("title_translated"))
    errors = done.where("error is not null").groupBy("key").agg(F.min("error").alias("translation_error"))
    return sections.join(title, "key", "left").join(body, "key", "left").join(errors, "key", "left")


def claims_of(sections: DataFrame, client: ModelClient, config: BookConfig) -> DataFrame:
    """(key, claim_idx, claim): extracted once for both modules that use claims."""
    answers = call(sections, "key", fill(config.prompts.claims, text=F.left(F.col("content"), F.lit(2000))), client)
    return answers.select("key", F.posexplode(parsing.claims(F.col("answer"))).alias("claim_idx", "claim"))


def verify(sections: DataFrame, glossary: DataFrame, kb: DataFrame, claims: DataFrame, client: ModelClient, config: BookConfig, persist: Persist) -> tuple[DataFrame, DataFrame]:
    """(sections with repaired texts, module scores in long form). Modules that are off count as skipped."""
    on = set(config.verify)
    blank = (F.coalesce("content", F.lit("")) == "") | (F.coalesce("content_translated", F.lit("")) == "")
    checked = sections.withColumns({"formula": mathtok.check(F.coalesce("content", F.lit("")), F.coalesce("content_translated", F.lit(""))), "skipped": blank})
    checked = persist(checked, "formulas")
    formulas = checked
    if "formula" in on:
        # A model may know some of the missing formulas in other forms.
        doubtful = checked.where(~F.col("skipped") & F.col("formula.score").between(50, 90))
        some, cut = F.array_join(F.slice("formula.missing", 1, 5), "\n"), lambda c: F.left(c, F.lit(1500))
        asked = fill(config.prompts.equivalent, missing=some, original=cut(F.col("content")), translated=cut(F.col("formula.fixed_text")))
        told = call(doubtful, "key", asked, client).select("key", parsing.json_from_text(F.col("answer"), "equivalent string")["equivalent"].try_cast("int").alias("_same"))
        formulas = checked.join(told, "key", "left")
        adjusted = mathtok.adjusted_score(F.col("formula.score"), F.size("formula.missing"), F.col("formula.n_tokens"), F.coalesce("_same", F.lit(0)))
        formulas = persist(formulas.withColumn("formula", F.col("formula").withField("score", adjusted)).drop("_same"), "judged")
    scores = formulas.select("key", F.lit("formula").alias("module"), F.col("formula.score").alias("score"), F.size("formula.missing").alias("n_issues"), "skipped")
    if "formula" in on:
        checked = checked.withColumn("content_translated", F.when(F.col("skipped"), F.col("content_translated")).otherwise(F.col("formula.fixed_text")))
    else:
        scores = scores.withColumns({"score": F.lit(100), "skipped": F.lit(True)})
    fixed = persist(checked.drop("formula"), "fixed")
    base = fixed.select("key", "skipped")
    n_claims = claims.groupBy("key").agg(F.count(F.lit(1)).alias("n_claims"))

    def module(name: str, found: DataFrame) -> DataFrame:
        return base.join(found, "key", "left").select("key", F.lit(name).alias("module"), F.coalesce("score", F.lit(100)).cast("int").alias("score"), F.coalesce("n_issues", F.lit(0)).cast("int").alias("n_issues"), "skipped")

    off = lambda name: base.select("key", F.lit(name).alias("module"), F.lit(100).alias("score"), F.lit(0).alias("n_issues"), F.lit(True).alias("skipped"))
    if "semantic" in on:
        pairs = paragraphs.align(fixed, "key", "content", "content_translated").withColumn("pid", F.concat_ws("#", "key", F.col("pos").cast("string")))
        rated = call(pairs, "pid", fill(config.prompts.meaning, original=F.col("original_para"), translated=F.col("translated_para")), client)
        para = pairs.join(rated.select("pid", parsing.clamped_score(parsing.json_from_text(F.col("answer"), "score string")["score"]).alias("para_score")), "pid")
        semantic = scoring.semantic(base.select("key").join(para.select("key", "pos", "para_score"), "key", "left"), "key")
        lacking = G.issues(fixed, glossary, "key", "content", "content_translated").groupBy("key").agg(F.count(F.lit(1)).alias("n_issues"))
        size = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "\n\n", -1), lambda x: ~T.is_blank(x)))
        counts = fixed.select("key", size("content").alias("n_o"), size("content_translated").alias("n_t"))
        both = semantic.join(lacking, "key", "left").join(counts, "key").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
        scores = scores.unionByName(module("semantic", both.withColumn("score", scoring.penalised_semantic(F.col("score"), F.col("n_issues"), F.col("n_o"), F.col("n_t")))))
    else:
        scores = scores.unionByName(off("semantic"))
    texts = fixed.select("key", F.left("content_translated", F.lit(2000)).alias("text"))
    if "logic" in on:
        each = claims.join(texts, "key").withColumn("cid", F.concat_ws("#", "key", F.col("claim_idx").cast("string")))
        verdicts = call(each, "cid", fill(config.prompts.preserved, claim=F.col("claim"), text=F.col("text")), client)
        kept = F.coalesce(parsing.json_from_text(F.col("answer"), "preserved boolean")["preserved"], F.lit(True))
        flagged = each.join(verdicts, "cid").groupBy("key").agg(F.sum(F.when(kept, 0).otherwise(1)).alias("n_flagged"))
        found = call(texts, "key", fill(config.prompts.logic, text=F.col("text")), client)
        inner = F.least(F.size(F.coalesce(parsing.json_from_text(F.col("answer"), "issues array<string>")["issues"], F.array().cast("array<string>"))), F.lit(3))
        rows = base.select("key").join(n_claims, "key", "left").join(flagged, "key", "left").join(found.select("key", inner.alias("n_inner")), "key", "left").fillna(0)
        scores = scores.unionByName(module("logic", rows.select("key", scoring.logic(F.col("n_claims"), F.col("n_flagged"), F.col("n_inner")).alias("score"), (F.col("n_flagged") + F.col("n_inner")).alias("n_issues"))))
    else:
        scores = scores.unionByName(off("logic"))
    if "research" in on:
        top = knowledge.top_claims(claims, "key").withColumn("cid", F.concat_ws("#", "key", F.col("claim_idx").cast("string")))
        # Terms are taken from a claim once, for the search's passes and for what is counted.
        top = persist(top.withColumn("terms", T.search_terms(F.col("claim"))), "topclaims")
        known = knowledge.search(top, kb, "cid", F.col("terms"))
        checkable = top.where(F.size("terms") > 0).drop("terms").join(known, "cid", "left")
        ok = knowledge.word_support(F.col("claim"), F.col("extract"))
        if config.ask_facts:
            asked = fill(config.prompts.fact, claim=F.col("claim"), title=F.col("title"), extract=F.left("extract", F.lit(1000)))
            told = call(checkable.where("extract is not null"), "cid", asked, client)
            checkable = checkable.join(told.select("cid", parsing.json_from_text(F.col("answer"), "supported boolean")["supported"].alias("_ok")), "cid", "left")
            ok = F.col("_ok")
        ok = F.coalesce(ok, F.lit(False))
        sums = checkable.groupBy("key").agg(F.count(F.lit(1)).alias("n_checked"), F.sum(F.when(ok, 1).otherwise(0)).alias("n_verified"))
        rows = base.select("key").join(n_claims, "key", "left").join(sums, "key", "left").fillna(0)
        scores = scores.unionByName(module("research", rows.select("key", scoring.research(F.col("n_claims"), F.col("n_checked"), F.col("n_verified")).alias("score"), (F.col("n_checked") - F.col("n_verified")).alias("n_issues"))))
    else:
        scores = scores.unionByName(off("research"))
    return fixed.drop("skipped"), scores


def enrich(sections: DataFrame, kb: DataFrame, client: ModelClient, config: BookConfig, persist: Persist, least: int = 100, most: int = 6) -> DataFrame:
    """Adds enrichments: concepts found in the knowledge table, explained and titled. Short sections get none."""
    long = sections.where(F.length("content") >= least)
    answers = call(long, "key", fill(config.prompts.concepts, text=F.left(F.col("content"), F.lit(2500))), client)
    terms = answers.select("key", F.posexplode(F.slice(parsing.concepts(F.col("answer")), 1, most)).alias("i", "term")).withColumn("cid", F.concat_ws("#", "key", F.col("i").cast("string")))
    terms = persist(terms, "concepts")
    contexts = long.select("key", F.left("content", F.lit(500)).alias("context"))
    known = knowledge.lookup(terms, kb, "cid", "term").where("title is not null").join(terms.select("cid", "key"), "cid").join(contexts, "key").drop("key")
    known = persist(known, "known")
    told = call(known, "cid", fill(config.prompts.explain, term=F.col("term"), text=F.left(F.col("extract"), F.lit(1500)), context=F.col("context")), client)
    named = call(known, "cid", fill(config.prompts.title, term=F.col("term")), client).select("cid", F.col("answer").alias("name"))
    rows = known.join(told.where(F.length("answer") >= 30), "cid").join(named, "cid").join(terms.select("cid", "key", "i"), "cid")
    entry = F.struct("i", "term", T.concept_title(F.col("name"), F.col("term")).alias("title_ko"), T.clean_explanation(F.col("answer")).alias("explanation"), F.col("title").alias("source"))
    packed = rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["term"], x["title_ko"], x["explanation"], x["source"])).alias("enrichments"))
    return sections.join(packed, "key", "left")


def supplement(sections: DataFrame, client: ModelClient, config: BookConfig, persist: Persist, least: int = 100) -> DataFrame:
    """Adds supplements: summary over 30 characters, balanced diagram, numbered examples and exercises, solutions, glossary pairs."""
    p, whole = config.prompts, F.coalesce("content_translated", F.lit(""))
    text = lambda most: F.left(F.col("text"), F.lit(most))
    long = sections.where(F.length("content_translated") >= least).select("key", whole.alias("text"))
    out = long.select("key")
    exercises = call(long, "key", fill(p.exercises, text=text(2500)), client).select("key", parsing.numbered_items(F.concat(F.lit("\n"), F.col("answer"))).alias("exercises"))
    exercises = persist(exercises, "exercises")
    made = {
        "summary": (3000, p.summary, lambda a: F.when(F.length(T.clean_output(a)) > 30, T.clean_output(a))),
        "tikz_diagram": (2000, p.diagram, lambda a: F.nullif(parsing.diagram(a), F.lit(""))),
        "examples": (2500, p.examples, lambda a: parsing.numbered_items(F.concat(F.lit("\n"), a))),
        "glossary": (2500, p.glossary, parsing.pairs),
    }
    for name, (most, template, parse) in made.items():
        out = out.join(call(long, "key", fill(template, text=text(most)), client).select("key", parse(F.col("answer")).alias(name)), "key", "left")
    out = out.join(exercises, "key", "left")
    asked = exercises.where(F.size("exercises") > 0).select("key", F.array_join("exercises", "\n").alias("text"))
    solved = call(asked, "key", fill(p.solutions, text=F.col("text")), client).select("key", F.nullif(T.clean_output(F.col("answer")), F.lit("")).alias("solutions"))
    out = out.join(solved, "key", "left")
    return sections.join(out.select("key", F.struct("summary", "tikz_diagram", "examples", "exercises", "solutions", "glossary").alias("supplements")), "key", "left")


def supplement_summary(sections: DataFrame) -> DataFrame:
    """(key, n_examples, n_exercises, n_terms, summary_chars, kinds): what each section was given."""
    s = F.col("supplements")
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    kinds = F.array_compact(F.array(*[F.when(s[k].isNotNull(), k) for k in ("summary", "tikz_diagram", "examples", "exercises", "solutions", "glossary")]))
    return sections.select("key", size(s["examples"]).alias("n_examples"), size(s["exercises"]).alias("n_exercises"), size(s["glossary"]).alias("n_terms"), F.coalesce(F.length(s["summary"]), F.lit(0)).alias("summary_chars"), kinds.alias("kinds"))


def run(pages: DataFrame, glossary: DataFrame, kb: DataFrame, client: ModelClient, config: BookConfig | None = None, preamble: str = "", persist: Persist | None = None) -> DataFrame:
    """(doc_id, tex): one document per book. persist(df, name) writes and rereads each stage's table; the default is stages.tables()."""
    config, persist = config or BookConfig(), persist or tables(pages.sparkSession)
    out = persist(sections_of(pages), "sections")
    if config.translate:
        out = persist(translate(out, glossary, client, config, persist), "translated")
    else:
        out = out.withColumns({"title_translated": F.lit(None).cast("string"), "content_translated": F.col("content")})
    if config.verify:
        claims = persist(claims_of(out, client, config), "claims")
        out, modules = verify(out, glossary, kb, claims, client, config, persist)
        modules = persist(modules, "modules")
        totals = scoring.overall(modules, "key").join(scoring.report_line(modules, "key"), "key", "left")
        out = persist(out.join(totals, "key", "left"), "verified")
    if config.enrich:
        out = persist(enrich(out, kb, client, config, persist), "enriched")
    if config.supplements:
        out = persist(supplement(out, client, config, persist), "supplemented")
    rows = render.section(out.withColumnRenamed("title", "title_original"), ["doc_id"])
    return render.document(rows, ["doc_id"], preamble)
