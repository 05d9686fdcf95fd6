"""Parsing of model answers: JSON in prose, numbered items, pairs, claims, diagrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_output, py_strip, strip_list_marker

JSON_OBJECT = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def json_from_text(c: Column, schema: str) -> Column:
    """The first object with at most one level inside it, else the whole text, parsed; null where neither parses."""
    found = F.regexp_extract(c, JSON_OBJECT, 0)

    def parsed(x: Column) -> Column:
        # An unparsable text gives null, not a struct of nulls.
        whole = F.try_parse_json(x)
        return F.when(whole.isNotNull() & F.schema_of_variant(whole).startswith("OBJECT"), F.from_json(x, schema))

    return F.coalesce(parsed(F.nullif(found, F.lit(""))), parsed(F.nullif(c, F.lit(""))))


def clamped_score(c: Column) -> Column:
    """A model's score as a whole number from 1 to 10."""
    value = c.try_cast("double").cast("int")
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), value)))


def numbered_items(c: Column, prefix: str = r"\n\d+[.)]\s+", most: int = 4) -> Column:
    """Items by splitting at the prefix: longer than 10, de-numbered and cleaned; text before the first prefix counts.

    Only where that gives none: lines that start with a number begin items, and other lines follow them.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), prefix, -1), py_strip), lambda x: F.length(x) > 10)
    items = F.filter(F.transform(parts, lambda x: clean_output(F.regexp_replace(x, r"^\d+[.)]\s*", ""))), lambda x: x != "")
    return F.slice(F.when(F.size(items) > 0, items).otherwise(line_items(c)), 1, most)


def line_items(c: Column) -> Column:
    """Items that begin at lines with a number; a fold that keeps the open item last in the array."""
    lines = F.filter(F.transform(F.split(py_strip(F.coalesce(c, F.lit(""))), "\n", -1), py_strip), lambda x: x != "")
    start = F.array().cast("array<string>")

    def step(done: Column, line: Column) -> Column:
        begins = line.rlike(r"^\d+[.)]\s+")
        text = F.regexp_replace(line, r"^\d+[.)]\s+", "")
        n = F.size(done)
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(done, n), F.lit(" "), line)))
        return F.when(begins | (n == 0), F.concat(done, F.array(text))).otherwise(longer)

    folded = F.aggregate(lines, start, step)
    return F.transform(F.filter(F.transform(folded, py_strip), lambda x: F.length(x) > 10), clean_output)


def pairs(c: Column, most: int = 8) -> Column:
    """(term, gloss) of lines parted at the first |, else ' - ', else ': '; both sides must have text."""
    lines = F.filter(F.transform(F.split(py_strip(F.coalesce(c, F.lit(""))), "\n", -1), py_strip), lambda x: (x != "") & ~x.startswith("#"))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\d.\-*]+\s*", ""))

    def part(x: Column) -> Column:
        sep = F.when(F.contains(x, F.lit("|")), "|").when(F.contains(x, F.lit(" - ")), " - ").when(F.contains(x, F.lit(": ")), ": ")
        at = F.instr(x, sep)
        return F.struct(py_strip(F.substring(x, F.lit(1), at - 1)).alias("term"), py_strip(F.substring(x, at + F.length(sep), F.length(x))).alias("gloss"))

    return F.slice(F.filter(F.transform(bare, part), lambda s: (s["term"] != "") & (s["gloss"] != "")), 1, most)


def claims(c: Column, most: int = 6) -> Column:
    """Lines without list markers that are longer than 15."""
    lines = F.transform(F.split(py_strip(F.coalesce(c, F.lit(""))), "\n", -1), lambda x: strip_list_marker(py_strip(x)))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 15), 1, most)


def concepts(c: Column, most: int = 8) -> Column:
    """Lines without list markers and quotes, of length 3 to 79."""
    lines = F.transform(F.split(py_strip(F.coalesce(c, F.lit(""))), "\n", -1), lambda x: F.btrim(strip_list_marker(py_strip(x)), F.lit("\"'")))
    return F.slice(F.filter(lines, lambda x: F.length(x).between(3, 79)), 1, most)


def diagram(c: Column, name: str = "tikzpicture") -> Column:
    """The first diagram environment, if it begins as many environments as it ends; else empty."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?s)\\begin\{{{name}\}}.*?\\end\{{{name}\}}", 0)
    balanced = F.regexp_count(found, F.lit(r"\\begin\{")) == F.regexp_count(found, F.lit(r"\\end\{"))
    return F.when(balanced, found).otherwise("")


def enrichment(category: Column, title: Column, extra: Column, quote: str = "quote") -> tuple[Column, Column]:
    """(box_type, sub_items) of an answer's category; sub-items need a text. quote is the category of sayings, which are boxed."""
    item = lambda kind, default: F.array(
        F.struct(F.lit(kind).alias("type"), (F.coalesce(F.nullif(title, F.lit("")), F.lit(default)) if default else F.lit(None).cast("string")).alias("title"), extra.alias("text"))
    )
    has = F.coalesce(extra, F.lit("")) != ""
    box = F.when(category == quote, quote)
    # Titles of notes that come without one.
    sub = (
        F.when((category == "translatornote") & has, item("translatornote", ""))
        .when((category == "deepresearch") & has, item("deepresearch", "심층 해설"))
        .when((category == "keyconcept") & has, item("deepresearch", "핵심 개념"))
    )
    return box, sub
