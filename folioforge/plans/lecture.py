"""The lecture plan: HTML pages -> items -> translation -> categories -> chapter text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import parsing
from folioforge.functions import text as T
from folioforge.operators import glossary as G
from folioforge.operators import render
from folioforge.plans.book import fill
from folioforge.plans.model import ModelClient, call
from folioforge.plans.stages import Persist, tables
from folioforge.sources.html import Selectors, content_items

TRANSLATE = "Translate, keeping formulas as they are.\n{hint}\n\n{text}"
CATEGORY = 'Answer {"category": .., "title": .., "extra": ..} for this paragraph.\n\n{text}'


def items_of(pages: DataFrame, id_col: str, html_col: str, selectors: Selectors | None = None) -> DataFrame:
    """Items of pages that are no bot walls, with iid, a name for each."""
    title = F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    real = pages.where(~T.is_block_page(title, F.col(html_col)))
    found = content_items(real, id_col, html_col, selectors).withColumn("chapter_id", F.col(id_col).cast("string"))
    return found.withColumn("iid", F.concat_ws("#", "chapter_id", F.col("sec_idx").cast("string"), F.col("item_idx").cast("string")))


def translate(items: DataFrame, glossary: DataFrame, client: ModelClient, template: str = TRANSLATE) -> DataFrame:
    """Adds text_ko of paragraphs and caption_ko of figures; other items pass."""
    source = F.when(F.col("type") == "paragraph", F.col("text")).when(F.col("type") == "figure", F.col("caption"))
    asked = items.withColumn("_s", source).where(~T.is_blank(F.col("_s"))).select("iid", "_s")
    hinted = asked.join(G.hints(asked, glossary, "iid", "_s", most=10, fold_term=False).select("iid", "hint"), "iid", "left")
    done = call(hinted, "iid", fill(template, hint=F.col("hint"), text=F.col("_s")), client).select("iid", T.clean_translation(F.col("answer")).alias("_t"), F.col("error").alias("translation_error"))
    out = items.join(done, "iid", "left")
    return out.withColumns({"text_ko": F.when(F.col("type") == "paragraph", F.col("_t")), "caption_ko": F.when(F.col("type") == "figure", T.clean_filler(F.col("_t")))}).drop("_t")


def enrich(items: DataFrame, client: ModelClient, template: str = CATEGORY) -> DataFrame:
    """Adds box_type and sub_items to translated paragraphs; an answer that does not parse adds nothing."""
    asked = items.where((F.col("type") == "paragraph") & (F.coalesce("text_ko", F.lit("")) != ""))
    answers = call(asked, "iid", fill(template, text=F.col("text_ko")), client)
    parsed = answers.select("iid", parsing.json_from_text(F.col("answer"), "category string, title string, extra string").alias("j"))
    box, sub = parsing.enrichment(F.col("j.category"), F.col("j.title"), F.col("j.extra"))
    return items.join(parsed.select("iid", box.alias("box_type"), sub.alias("sub_items")), "iid", "left")


def run(pages: DataFrame, id_col: str, html_col: str, glossary: DataFrame, manifest: DataFrame, client: ModelClient, selectors: Selectors | None = None, preamble: str = "", persist: Persist | None = None) -> DataFrame:
    """(chapter_id, tex). persist is as in the book plan."""
    persist = persist or tables(pages.sparkSession)
    items = persist(items_of(pages, id_col, html_col, selectors), "items")
    items = persist(translate(items, glossary, client), "translated")
    items = persist(enrich(items, client), "enriched")
    states = render.figure_states(render.mark_items(items), manifest)
    ready = states.withColumns({"converted": F.col("state") == "converted", "present": F.col("state").isin("unconverted", "raster")})
    titles = items.groupBy("chapter_id", "sec_idx").agg(F.first("chapter_title").alias("chapter_title"), F.first("section_title").alias("title"))
    titles = titles.withColumns({"chapter_title_ko": F.lit(None).cast("string"), "title_ko": F.lit(None).cast("string")})
    return render.chapter(render.item_tex(ready), titles, preamble)
