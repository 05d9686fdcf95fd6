"""Labels, references, index and glossary of rendered documents.

Rows are rendered sections: keys of a document, section_id, tex. Labels are the symbols that a document
defines; every reference is looked up there by document and label, one equi-join, and is ok, broken, or
ambiguous where a label stands more than once. A label that many references name is one row on the other
side, so the join's large side can be split. Index and glossary are aggregates by document and term, whose
lists are as long as a document has sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

# How LaTeX names and uses labels, and marks index terms.
LABEL = r"\\label\{([^{}]+)\}"
LINK = r"\\hyperref\[([^\[\]]+)\]\{((?:[^{}]|\{[^{}]*\})*)\}"
PLAIN_REFERENCE = r"\\(?:ref|pageref|autoref|nameref)\{([^{}]+)\}"
INDEX_TERM = r"\\(?:index|term)\{([^{}]+)\}"


def labels(sections: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, section_id, n_places): a label with the first section, in natural order, that defines it, and how often it stands."""
    each = sections.select(*by, "section_id", F.explode(F.regexp_extract_all("tex", F.lit(LABEL), F.lit(1))).alias("label"))
    first = F.min_by("section_id", F.struct(T.natural_key(F.col("section_id")), "section_id")).alias("section_id")
    return each.groupBy(*by, "label").agg(first, F.count(F.lit(1)).alias("n_places"))


def references(sections: DataFrame, by: list[str]) -> DataFrame:
    """(by, section_id, place, label): every link and reference of a section; links first, each kind in order of text."""
    found = F.concat(F.regexp_extract_all("tex", F.lit(LINK), F.lit(1)), F.regexp_extract_all("tex", F.lit(PLAIN_REFERENCE), F.lit(1)))
    return sections.select(*by, "section_id", F.posexplode(found).alias("place", "label"))


def checked_references(sections: DataFrame, by: list[str]) -> DataFrame:
    """references() with target, the section that the label stands in, and state: ok, broken or ambiguous."""
    known = labels(sections, by).withColumnRenamed("section_id", "target")
    joined = references(sections, by).join(known, [*by, "label"], "left")
    state = F.when(F.col("target").isNull(), "broken").when(F.col("n_places") > 1, "ambiguous").otherwise("ok")
    return joined.withColumn("state", state).drop("n_places")


def broken_references(sections: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, n_references, sections): labels that are named and nowhere defined, with the sections that name them in natural order."""
    lost = references(sections, by).join(labels(sections, by).select(*by, "label"), [*by, "label"], "left_anti")
    return lost.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n_references"), _in_order().alias("sections"))


def unlink_broken(sections: DataFrame, by: list[str]) -> DataFrame:
    """The sections with links to labels that nobody defines as plain text; other texts stay as they are."""
    lost = checked_references(sections, by).where("state = 'broken'")
    lost = lost.groupBy(*by, "section_id").agg(F.collect_set("label").alias("_lost"))
    marked = sections.join(lost, [*by, "section_id"], "left")

    def plain(tex: Column, label: Column) -> Column:
        quoted = F.concat(F.lit(r"\\hyperref\[\Q"), label, F.lit(r"\E\]\{((?:[^{}]|\{[^{}]*\})*)\}"))
        return F.regexp_replace(tex, quoted, F.lit("$1"))

    return marked.withColumn("tex", F.when(F.col("_lost").isNull(), F.col("tex")).otherwise(F.aggregate("_lost", F.col("tex"), plain))).drop("_lost")


def _in_order() -> Column:
    """Distinct section ids of a group in natural order."""
    ordered = F.array_sort(F.collect_set(F.struct(T.natural_key(F.col("section_id")).alias("k"), F.col("section_id").alias("s"))))
    return F.transform(ordered, lambda x: x["s"])


def index_terms(sections: DataFrame, by: list[str]) -> DataFrame:
    """(by, term, sections): terms that sections mark for the index, trimmed and without regard to case, with the sections in natural order.

    A term is written as it is where it comes first.
    """
    marked = sections.select(*by, "section_id", F.explode(F.regexp_extract_all("tex", F.lit(INDEX_TERM), F.lit(1))).alias("term"))
    clean = marked.withColumn("term", F.trim("term")).where("term <> ''").withColumn("_fold", F.lower("term"))
    written = F.min_by("term", F.struct(T.natural_key(F.col("section_id")), "section_id", "term")).alias("term")
    return clean.groupBy(*by, "_fold").agg(written, _in_order().alias("sections")).drop("_fold")


def render_index(terms: DataFrame, by: list[str]) -> DataFrame:
    """(by, tex): the index of each document: terms in order of their lower-cased letters, links to their sections, a gap between first letters."""
    link = lambda s: F.concat(F.lit("\\hyperref[sec:"), T.safe_key(s, "-"), F.lit("]{"), s, F.lit("}"))
    w = Window.partitionBy(*by).orderBy(F.lower("term"), "term")
    letter = F.left(F.lower("term"), F.lit(1))
    gap = F.when(F.lag(letter).over(w).isNotNull() & (F.lag(letter).over(w) != letter), F.lit("\\indexspace\n")).otherwise(F.lit(""))
    line = F.concat(gap, F.lit("\\item "), F.col("term"), F.lit(", "), F.array_join(F.transform("sections", link), ", "))
    lines = terms.select(*by, F.lower("term").alias("k"), "term", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(*by).agg(F.concat(F.lit("\\begin{theindex}\n"), body, F.lit("\n\\end{theindex}")).alias("tex"))


def glossary_entries(sections: DataFrame, by: list[str], entries: str = "glossary") -> DataFrame:
    """(by, term, gloss, section_id, n_glosses): terms that sections explain, with the gloss of the first section, in natural order, and how many glosses differ."""
    each = sections.select(*by, "section_id", F.posexplode(entries).alias("at", "e")).select(*by, "section_id", "at", F.trim("e.term").alias("term"), F.trim("e.gloss").alias("gloss"))
    first = F.min_by(F.struct("gloss", "section_id"), F.struct(T.natural_key(F.col("section_id")), "section_id", "at")).alias("f")
    out = each.where("term <> ''").groupBy(*by, "term").agg(first, F.count_distinct("gloss").alias("n_glosses"))
    return out.select(*by, "term", "f.gloss", "f.section_id", "n_glosses")


def render_glossary(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, tex): the glossary of each document, in order of terms."""
    line = F.concat(F.lit("\\item["), F.col("term"), F.lit("] "), F.coalesce("gloss", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(F.lower("term").alias("k"), "term", line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return entries.groupBy(*by).agg(F.concat(F.lit("\\begin{description}\n"), body, F.lit("\n\\end{description}")).alias("tex"))
