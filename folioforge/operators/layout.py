"""Pages to sections: text of blocks, headers from bold numbers, sections from running headers, tables of contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 12.0
BOLD_LEAST = 8.0
#: Pages of a document that one task carries a header along.
SEGMENT = 4096
NUMBER = r"^\d+(?:\.\d+)*$"

#: One page as a text layout library gives it.
PAGE_SCHEMA = (
    "doc_id string, page int, blocks array<struct<type:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>,"
    "lines:array<struct<spans:array<struct<text:string,font:string,size:double>>>>>>, "
    "images array<struct<ext:string,position:struct<x:double,y:double,width:double,height:double>,data:string>>"
)


def page_range(pages: DataFrame, start: int = 0, end: int | None = None, limit: int | None = None) -> DataFrame:
    """Pages from start up to end, exclusive; limit caps their number, for trial runs. A pushed filter on page."""
    stop = [x for x in (end, start + limit if limit is not None else None) if x is not None]
    out = pages.where(F.col("page") >= start)
    return out.where(F.col("page") < min(stop)) if stop else out


def spans(pages: DataFrame) -> DataFrame:
    """(doc_id, page, block_idx, block_y0, block_y1, line_idx, span_idx, text, font, size, bold) of text blocks."""
    blocks = pages.select("doc_id", "page", F.posexplode("blocks").alias("block_idx", "b")).where("b.type = 0")
    lines = blocks.select("doc_id", "page", "block_idx", F.col("b.bbox.y0").alias("block_y0"), F.col("b.bbox.y1").alias("block_y1"), F.posexplode("b.lines").alias("line_idx", "l"))
    out = lines.select("*", F.posexplode("l.spans").alias("span_idx", "s")).select("*", "s.*").drop("l", "s")
    return out.withColumn("bold", F.contains("font", F.lit("Bold")) | F.contains("font", F.lit("Demi")))


def page_text(pages: DataFrame, gap: float = GAP) -> DataFrame:
    """(doc_id, page, text): spans joined by blanks, lines by line feeds, and an empty line where blocks stand apart."""
    found = spans(pages).where(F.trim("text") != "")
    ordered = F.array_sort(F.collect_list(F.struct("span_idx", "text")))
    line = F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["text"]), " "), "  +", " ")
    lines = found.groupBy("doc_id", "page", "block_idx", "line_idx").agg(line.alias("line"))
    in_order = Window.partitionBy("doc_id", "page").orderBy("block_idx")
    blocks = pages.select("doc_id", "page", F.posexplode("blocks").alias("block_idx", "b")).where("b.type = 0")
    apart = blocks.select("doc_id", "page", "block_idx", (F.col("b.bbox.y0") - F.lag("b.bbox.y1").over(in_order) > gap).alias("apart"))
    breaks = apart.where("apart").select("doc_id", "page", "block_idx", F.lit(-1).alias("line_idx"), F.lit("").alias("line"))
    rows = lines.unionByName(breaks)
    text = F.array_sort(F.collect_list(F.struct("block_idx", "line_idx", "line")))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(text, lambda x: x["line"]), "\n").alias("text"))


def headers(found: DataFrame) -> DataFrame:
    """(doc_id, page, at, section_id, title, font_size): a bold number followed by a bold span of the same size.

    Spans of a page are numbered; a title that is itself a number has been used up by the number before it.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("block_idx", "line_idx", "span_idx")
    rows = found.where(F.trim("text") != "").withColumn("at", F.row_number().over(w))
    big = F.col("bold") & (F.col("size") >= BOLD_LEAST)
    nxt = lambda c: F.lead(c).over(w)
    text = F.trim("text")
    hit = big & text.rlike(NUMBER) & F.coalesce(nxt("bold"), F.lit(False)) & (F.abs(nxt("size") - F.col("size")) < 1)
    marked = rows.withColumns({"hit": F.coalesce(hit, F.lit(False)), "title": F.trim(nxt("text"))})
    # In a run of consecutive hits every second one is a title already.
    run = marked.withColumn("run", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.sum(F.col("hit").cast("int")).over(Window.partitionBy("doc_id", "page", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("place", place).where(F.col("hit") & (F.col("place") % 2 == 1)).select("doc_id", "page", "at", text.alias("section_id"), "title", F.col("size").alias("font_size"))


def first_header(found: DataFrame) -> DataFrame:
    """The first header of each page; any others stay part of its text."""
    head = F.min_by(F.struct("section_id", "title", "font_size"), "at").alias("h")
    return found.groupBy("doc_id", "page").agg(head).select("doc_id", "page", "h.*")


def running_sections(pages: DataFrame, heads: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Pages with the header that is in force: columns of the header, section_no counting headers, and next_page, where the next one stands.

    Pages before the first header go. Documents are cut into segments of so many pages. Headers are carried on
    within a segment first; what a segment hands on, the number of its headers and its first and last one, is a row,
    and only those rows are carried on by document. So pages of one document are many tasks' work.
    """
    part = F.floor(F.col("page") / segment).alias("_segment")
    place = Window.partitionBy("doc_id", "_segment")
    back, ahead = (w.rowsBetween(Window.unboundedPreceding, end) for w, end in ((place.orderBy("page"), 0), (place.orderBy(F.desc("page")), -1)))
    columns = ("section_id", "title", "font_size")
    head = F.when(F.col("section_id").isNotNull(), F.struct("page", *columns))

    real = heads.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    handed = real.groupBy("doc_id", part).agg(F.count("section_id").alias("n"), F.max(head).alias("last"), F.min(F.when(F.col("section_id").isNotNull(), F.col("page"))).alias("first"))
    handed = pages.select("doc_id", part).distinct().join(handed, ["doc_id", "_segment"], "left")
    by_doc = Window.partitionBy("doc_id")
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (by_doc.orderBy("_segment"), by_doc.orderBy(F.desc("_segment"))))
    carried = handed.select(
        "doc_id",
        "_segment",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"),
        F.last("last", ignorenulls=True).over(before).alias("_head"),
        F.last("first", ignorenulls=True).over(after).alias("_next"),
    )
    joined = pages.join(heads, ["doc_id", "page"], "left").withColumn("_segment", part)
    local = joined.withColumns(
        {
            "_no": F.count("section_id").over(back),
            "_own": F.last(head, ignorenulls=True).over(back),
            "_after": F.last(F.when(F.col("section_id").isNotNull(), F.col("page")), ignorenulls=True).over(ahead),
        }
    )
    in_force = F.coalesce("_own", "_head")
    filled = local.join(carried, ["doc_id", "_segment"]).withColumns(
        {**{c: in_force[c] for c in columns}, "section_no": F.col("_no") + F.col("_n"), "next_page": F.coalesce("_after", "_next")}
    )
    return filled.where(F.col("section_no") > 0).drop("_segment", "_no", "_own", "_after", "_n", "_head", "_next")


def assemble_sections(pages: DataFrame, heads: DataFrame, end_page: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per header: section_id, title, font_size, level, content, images, start_page, end_page (1-based, inclusive).

    pages: (doc_id, page, text) and maybe images; a section ends on the page before the next header's,
    the last on end_page, or where that is not given on its document's last page.
    """
    run = running_sections(pages, heads, segment)
    text = F.array_sort(F.collect_list(F.struct("page", "text")))
    parts = [F.array_join(F.transform(text, lambda x: x["text"]), "\n").alias("content"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.max("next_page").alias("next_page")]
    if "images" in pages.columns:
        shown = F.array_sort(F.collect_list(F.struct("page", "images")))
        parts.append(F.flatten(F.transform(shown, lambda x: F.coalesce(x["images"], F.array().cast(pages.schema["images"].dataType)))).alias("images"))
    rows = run.groupBy("doc_id", "section_no", "section_id", "title", "font_size").agg(*parts)
    last = F.lit(end_page) if end_page is not None else F.col("last_page") + 1
    level = F.when(F.col("font_size") >= 9.0, "section").otherwise("subsection")
    out = rows.withColumns({"level": level, "start_page": F.col("first_page") + 1, "end_page": F.coalesce("next_page", last)})
    return out.drop("first_page", "last_page", "next_page")


def last_wins(rows: DataFrame, key: list[str], order: Column, first_place: str | None = None) -> DataFrame:
    """Of rows with the same key the last in order; first_place, a column, becomes the smallest of the key's rows."""
    names = [c for c in rows.columns if c not in key]
    kept = F.max_by(F.struct(*names), order).alias("_r")
    extra = [F.min(first_place).alias("_p"), F.count(F.lit(1)).alias("n_rows")] if first_place else [F.count(F.lit(1)).alias("n_rows")]
    out = rows.groupBy(*key).agg(kept, *extra).select(*key, "_r.*", "n_rows", *(["_p"] if first_place else []))
    return out.drop(first_place).withColumnRenamed("_p", first_place) if first_place else out


def images(pages: DataFrame) -> DataFrame:
    """(doc_id, page, img_idx, filename, position): one row per image, numbered from 1 by page and place."""
    found = pages.select("doc_id", "page", F.posexplode("images").alias("img_idx", "i"))
    name = F.format_string("page_%d_img_%d.%s", F.col("page") + 1, F.col("img_idx") + 1, F.col("i.ext"))
    return found.select("doc_id", "page", "img_idx", name.alias("filename"), F.col("i.position").alias("position"))


def page_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents without any section get one per page, named page_N (from 1), with the page's images if pages has any."""
    lone = pages.join(sections.select("doc_id").distinct(), "doc_id", "left_anti")
    number = F.col("page") + 1
    return lone.select(
        "doc_id",
        F.concat(F.lit("page_"), number.cast("string")).alias("section_id"),
        F.concat(F.lit("Page "), number.cast("string")).alias("title"),
        F.lit(8.1).alias("font_size"),
        F.lit("subsection").alias("level"),
        F.col("text").alias("content"),
        number.alias("start_page"),
        number.alias("end_page"),
        *(["images"] if "images" in pages.columns else []),
    )


def toc_ranges(toc: DataFrame, total_pages: Column, levels: list[int], partition: list[str] | None = None, ord_col: str = "ord") -> DataFrame:
    """Adds end_page and page_count: up to the page before the next entry of the same or a higher level, else the last page.

    Levels are few and known, so the next entry is the nearest of as many running windows as there are
    levels, in space that does not grow with the rows of a partition.
    """
    w = Window.partitionBy(*(partition or [])).orderBy(F.desc(ord_col)).rowsBetween(Window.unboundedPreceding, -1)
    heads = {k: F.last(F.when(F.col("level") == k, F.struct(F.col(ord_col).alias("o"), F.col("page").alias("p"))), ignorenulls=True).over(w) for k in levels}
    marked = toc.withColumns({f"_h{k}": v for k, v in heads.items()})
    none = F.lit(None).cast(marked.schema[f"_h{levels[0]}"].dataType)
    nearest = reduce(lambda a, k: F.least(a, F.when(F.col("level") >= k, F.col(f"_h{k}"))), levels, none) if len(levels) > 1 else F.col(f"_h{levels[0]}")
    out = marked.withColumn("end_page", F.coalesce(nearest["p"] - 1, total_pages)).drop(*(f"_h{k}" for k in levels))
    return out.withColumn("page_count", F.col("end_page") - F.col("page") + 1)


def split_parts(pages: DataFrame, size: int, total: Column, prefix: str = "book") -> DataFrame:
    """(part, first_page, last_page, name) of runs of so many pages; pages count from 0, names from 1."""
    part = F.floor(F.col("page") / size).cast("int")
    rows = pages.groupBy(part.alias("part")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    name = F.concat(F.lit(f"{prefix}_part_"), F.lpad((F.col("part") + 1).cast("string"), F.greatest(F.lit(2), F.length((F.col("part") + 1).cast("string"))), F.lit("0")), F.lit("_pages_"), (F.col("first_page") + 1).cast("string"), F.lit("_"), F.least(F.col("last_page") + 1, total).cast("string"))
    return rows.withColumn("name", name)
