"""Rendering to LaTeX text: segment-aware rewriting of columns, then ordered assembly of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

# Regions that rewriting leaves alone.
MATH = r"(?s)\$[^$]+?\$|\\\(.+?\\\)|\\\[.+?\\\]"
DOLLARS = r"(?s)\$\$.*?\$\$|\$.*?\$"
PROTECTED = r"\\[a-zA-Z]+\{[^}]*\}|\\\\|\\item\b"
BREAK_TOKEN = r"\hspace{0pt}"

# Bare math that is wrapped, each with what it becomes.
BARE_MATH = (
    (r"(?<!\$)(?<![\\a-zA-Z])([a-zA-Z][a-zA-Z0-9]*)([_^])(\{[^}]+\}|[a-zA-Z0-9]+)(?!\$)", r"\$$1$2$3\$"),
    (r"(?<!\$)([a-zA-Z0-9])\^\(([^)]+)\)", r"\$$1^{$2}\$"),
    (r"(?<!\$)([a-zA-Z])\s*\^\s*([0-9]+\.?[0-9]*)(?!\$)", r"\$$1^{$2}\$"),
)


def _any(c: Column, signs: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(s)) for s in signs])


def outside(c: Column, regions: str, change, signs: str) -> Column:
    """c with change() applied to the texts between matches of regions, which stay as they are.

    Every match holds one of the signs: without any of them the whole text is changed at once.

    The texts between and the matches alternate, so both arrays are zipped and joined again; all of
    it is a native expression.
    """

    def woven(t: Column) -> Column:
        inside = F.regexp_extract_all(t, F.lit(regions), F.lit(0))
        return F.array_join(F.zip_with(F.split(t, regions, -1), inside, lambda a, b: F.concat(change(F.coalesce(a, F.lit(""))), F.coalesce(b, F.lit("")))), "")

    return T.let(c, lambda t: F.when(_any(t, signs), woven(t)).otherwise(change(t)))


def wrap_bare_math(c: Column) -> Column:
    """a_1, x^2, e^(..), r ^1.4 outside math become inline math."""

    def wrap(x: Column) -> Column:
        return F.when(_any(x, "_^"), reduce(lambda t, rule: F.regexp_replace(t, *rule), BARE_MATH, x)).otherwise(x)

    return outside(c, MATH, wrap, "$\\")


def escape_specials(c: Column) -> Column:
    """& % # _ ^ outside math and outside existing commands."""

    def escape(x: Column) -> Column:
        x = F.regexp_replace(x, "([&%#_])", r"\\$1")
        return F.replace(x, F.lit("^"), F.lit("\\^{}"))

    return outside(c, MATH, lambda x: outside(x, PROTECTED, escape, "\\"), "$\\")


def escape_light(c: Column) -> Column:
    """The lecture variant: & % # and underscores without a backslash, outside $ regions."""

    def escape(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, "([&%#])", r"\\$1"), r"(?<!\\)_", r"\\_")

    return outside(F.coalesce(c, F.lit("")), DOLLARS, escape, "$")


def space_scripts(c: Column) -> Column:
    """A blank at both kinds of border between East Asian and Latin letters or digits."""
    east, west = f"[{T.HANGUL}{T.HAN}{T.HAN_EXTENSION_A}]", "[a-zA-Z0-9]"
    spaced = lambda t: F.regexp_replace(F.regexp_replace(t, f"({east})({west})", "$1 $2"), f"({west})({east})", "$1 $2")
    return T.let(c, lambda t: F.when(t.rlike(east), spaced(t)).otherwise(t))


def break_long_runs(c: Column, longer: int = 12, every: int = 10) -> Column:
    """A break token after every so many letters of Hangul runs that are longer than that."""
    run, token = f"[{T.HANGUL}]{{{longer + 1},}}", BREAK_TOKEN.replace("\\", "\\\\")

    def broken(t: Column) -> Column:
        inside = F.transform(F.regexp_extract_all(t, F.lit(run), F.lit(0)), lambda r: F.regexp_replace(r, f"(.{{{every}}})(?=.)", f"$1{token}"))
        return F.array_join(F.zip_with(F.split(t, run, -1), inside, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")

    return T.let(c, broken)


def wrap_bullets(c: Column) -> Column:
    """Runs of bullet lines between list marks: a line's neighbours tell whether it begins or ends a run."""
    bullet = lambda x: F.coalesce(x, F.lit("")).rlike(r"^\s*[*-]\s+")

    def joined(lines: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            before = (i > 0) & bullet(F.try_element_at(lines, i))
            after = bullet(F.try_element_at(lines, i + 2))
            item = F.concat(F.lit("\\item "), F.regexp_replace(x, r"^\s*[*-]\s+", ""))
            opened = F.when(before, F.lit("")).otherwise(F.lit("\\begin{itemize}\n"))
            closed = F.when(after, F.lit("")).otherwise(F.lit("\n\\end{itemize}"))
            return F.when(bullet(x), F.concat(opened, item, closed)).otherwise(x)

        return F.array_join(F.transform(lines, line), "\n")

    return T.let(F.split(c, "\n", -1), joined)


# Markup that becomes commands, each pattern with what it becomes; first those before lists, then those after.
MARKUP_BEFORE = (
    (r"(?d)\*\*(.+?)\*\*", r"\\textbf{$1}"),
    (r"(?d)(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", r"\\textit{$1}"),
)
MARKUP_AFTER = (
    (r"(?md)^\s*#{1,3}\s+(.+)$", r"\\paragraph{$1}"),
    (r"(?d)<sup>(.*?)</sup>", r"\\textsuperscript{$1}"),
    (r"(?d)<sub>(.*?)</sub>", r"\\textsubscript{$1}"),
    (r"<br\s*/?>", r"\\\\\\\\"),
)
DISPLAY_MATH = (r"(?s)\$\$(.+?)\$\$", r"\\[$1\\]")


def clean_for_latex(c: Column) -> Column:
    """Markdown, HTML, display math, bare math, escaping, breaks, white space; in this order."""
    c = reduce(lambda t, rule: F.regexp_replace(t, *rule), MARKUP_BEFORE, F.coalesce(c, F.lit("")))
    c = reduce(lambda t, rule: F.regexp_replace(t, *rule), MARKUP_AFTER, wrap_bullets(c))
    c = F.regexp_replace(T.strip_tags(c), *DISPLAY_MATH)
    c = escape_specials(wrap_bare_math(c))
    c = T.collapse_spaces(break_long_runs(space_scripts(c)))
    return T.py_strip(T.collapse_newlines(c))


# Fixed value: references to sections of parts, [IV.1] or [IV.1§14].
REFERENCE = r"\[([IVXL]+)\.(\d+)(?:§(\d+))?\]"


def cross_references(c: Column) -> Column:
    """References to sections as links to their labels; the text of a reference stays."""
    far = F.regexp_replace(c, REFERENCE.replace("(?:§(\\d+))?", "§(\\d+)"), r"\\hyperref[sec:$1-$2-$3]{[$1.$2§$3]}")
    return F.regexp_replace(far, r"(?<!\{)" + REFERENCE.replace("(?:§(\\d+))?", ""), r"\\hyperref[sec:$1-$2]{[$1.$2]}")


def environment(name: str, body: Column, argument: Column | None = None) -> Column:
    head = F.lit(f"\\begin{{{name}}}") if argument is None else F.concat(F.lit(f"\\begin{{{name}}}["), argument, F.lit("]"))
    return F.concat(head, F.lit("\n"), body, F.lit(f"\n\\end{{{name}}}"))


def verification_box(score: Column, band: Column, line: Column) -> Column:
    head = F.concat(F.lit("\\textbf{종합 점수: "), score.cast("string"), F.lit("/100 ("), band, F.lit(")} \\\\[2pt]\n{\\small "), F.coalesce(line, F.lit("")), F.lit("}"))
    return environment("verificationbox", head)


def enrichment_boxes(entries: Column) -> Column:
    """Boxes of entries with an explanation; the source, if any, on a line of its own. Empty without any."""
    usable = F.filter(F.coalesce(entries, F.array().cast("array<struct<term:string,title_ko:string,explanation:string,source:string>>")), lambda e: F.coalesce(e["explanation"], F.lit("")) != "")

    def box(e: Column) -> Column:
        source = F.when(F.coalesce(e["source"], F.lit("")) != "", F.concat(F.lit("\n{\\scriptsize \\textit{출처: Wikipedia --- "), clean_for_latex(e["source"]), F.lit("}}"))).otherwise("")
        title = clean_for_latex(F.coalesce(e["title_ko"], e["term"]))
        return environment("researchbox", F.concat(clean_for_latex(e["explanation"]), source), title)

    return F.array_join(F.transform(usable, box), "\n")


def numbered(name: str, items: Column, label: str) -> Column:
    none = F.array().cast("array<string>")
    boxes = F.transform(F.coalesce(items, none), lambda x, i: environment(name, clean_for_latex(x), F.concat(F.lit(label), (i + 1).cast("string"))))
    return F.array_join(boxes, "\n")


def _part(c: Column) -> Column:
    """Empty parts as null, for concat_ws to leave out."""
    return F.nullif(F.coalesce(c, F.lit("")), F.lit(""))


def section(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, section_id, tex): heading, label, body, enrichments, verification, supplements.

    Columns: section_id, title_original, title_translated, level, font_size, content_translated, and
    as far as there are any enrichments, score, band, line, and a struct supplements.
    """
    col = lambda name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    title = T.or_default(F.col("title_translated"), F.col("title_original"))
    kind = T.heading_kind(F.col("section_id"), F.coalesce("font_size", F.lit(8.1)), F.coalesce("level", F.lit("subsection")))
    heading = F.concat(F.lit("\\"), kind, F.lit("{"), title, F.lit("}\n\\label{sec:"), T.safe_key(F.col("section_id"), "-"), F.lit("}"))
    verified = F.when(col("score", "int").isNotNull(), verification_box(col("score", "int"), col("band", "string"), col("line", "string")))
    parts = [heading, _part(clean_for_latex(F.col("content_translated")))]
    if "enrichments" in df.columns:
        parts.append(_part(enrichment_boxes(F.col("enrichments"))))
    parts.append(_part(verified))
    if "supplements" in df.columns:
        s = lambda name: F.col(f"supplements.{name}")
        pairs = F.transform(s("glossary"), lambda g: F.concat(F.lit("\\textbf{"), g["term"], F.lit("} --- "), g["gloss"]))
        exercises = F.transform(s("exercises"), lambda x, i: F.concat(F.lit("\\textbf{"), (i + 1).cast("string"), F.lit(".} "), clean_for_latex(x), F.lit("\\\\[4pt]")))
        parts += [
            F.when(_part(s("summary")).isNotNull(), environment("summarybox", clean_for_latex(s("summary")))),
            F.when(_part(s("tikz_diagram")).isNotNull(), environment("center", F.concat(F.lit("\\resizebox{\\textwidth}{!}{"), s("tikz_diagram"), F.lit("}")))),
            _part(numbered("examplebox", s("examples"), "예시 ")),
            F.when(F.size(s("exercises")) > 0, environment("exercisebox", F.array_join(exercises, "\n"))),
            F.when(F.size(s("glossary")) > 0, environment("glossarybox", F.array_join(pairs, " \\\\\n"))),
            F.when(_part(s("solutions")).isNotNull(), F.concat(F.lit("\\paragraph{풀이}\n"), clean_for_latex(s("solutions")))),
        ]
    return df.select(*(keep or []), "section_id", F.concat_ws("\n\n", *parts).alias("tex"))


def document(sections: DataFrame, by: list[str], preamble: str | Column = "", ending: str = "\\end{document}") -> DataFrame:
    """(by, tex): sections in natural order of their ids between preamble and ending; one row per book. preamble may be made of by."""
    ordered = F.array_sort(F.collect_list(F.struct(T.natural_key(F.col("section_id")).alias("k"), F.col("tex").alias("t"))))
    body = F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n")
    before = F.lit(preamble) if isinstance(preamble, str) else preamble
    return sections.groupBy(*by).agg(F.concat(before, body, F.lit("\n" + ending)).alias("tex"))


def figure_box(src: Column, caption: Column, converted: Column, present: Column, folder: str = "lecture_json") -> Column:
    """converted, present: whether the manifest has the converted file and the file itself."""
    path = F.when(src.startswith("images/"), F.concat(F.lit(f"{folder}/"), src)).otherwise(F.concat(F.lit(f"{folder}/images/"), T.base_name(src)))
    raster = path.rlike(r"\.(pdf|jpg|png)$")
    show = lambda p: F.concat(F.lit("\\includegraphics[width=0.8\\textwidth]{"), p, F.lit("}"))
    note = lambda s: F.concat(F.lit("\\fbox{" + s + ": "), escape_light(T.base_name(src)), F.lit("}"))
    body = F.when(converted, show(T.converted_name(path))).when(present & ~raster, note("Missing vector conversion")).when(present, show(path)).otherwise(note("Missing Figure"))
    return F.concat(F.lit("\\begin{diagrambox}{"), T.clean_title(caption), F.lit("}\n"), body, F.lit("\n\\end{diagrambox}"))


def figure_states(figures: DataFrame, manifest: DataFrame, src_col: str = "src") -> DataFrame:
    """Adds state: converted, unconverted, raster or missing, by two joins with the manifest of file names (name)."""
    known = manifest.select(F.col("name").alias("_n")).distinct()
    name = T.base_name(F.col(src_col))
    rows = figures.withColumns({"_a": T.converted_name(name), "_b": name})
    rows = rows.join(known.withColumns({"_a": F.col("_n"), "_c": F.lit(True)}).drop("_n"), "_a", "left").join(known.withColumns({"_b": F.col("_n"), "_d": F.lit(True)}).drop("_n"), "_b", "left")
    state = F.when(F.col("_c"), "converted").when(F.col("_d") & ~F.col("_b").rlike(r"\.(pdf|jpg|png)$"), "unconverted").when(F.col("_d"), "raster").otherwise("missing")
    return rows.withColumn("state", state).drop("_a", "_b", "_c", "_d")


def mark_items(items: DataFrame, keyword: str = "cataclysm") -> DataFrame:
    """Adds is_epigraph, is_quoted and is_first to items (chapter_id, sec_idx, item_idx, type, text, text_ko, box_type).

    The epigraph is the chapter's first paragraph with the keyword; paragraphs that hold its text go
    from the body; the first paragraph of the rest without a box, and with text, gets the large initial.
    """
    para = F.col("type") == "paragraph"
    place = F.struct("sec_idx", "item_idx")
    quote = items.where(para & T.contains_folded(F.coalesce("text", F.lit("")), F.lit(keyword))).groupBy("chapter_id").agg(F.min_by("text", place).alias("_q"), F.min(place).alias("_at"))
    rows = items.join(quote, "chapter_id", "left")
    rows = rows.withColumns({"is_epigraph": F.coalesce(F.col("_at") == place, F.lit(False)), "is_quoted": F.coalesce(para & F.contains("text", F.col("_q")), F.lit(False))})
    body = para & ~F.col("is_quoted") & F.col("box_type").isNull() & (T.or_default(F.col("text_ko"), F.coalesce("text", F.lit(""))) != "")
    w = Window.partitionBy("chapter_id").orderBy("sec_idx", "item_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_first", body & (F.sum(F.when(body, 1).otherwise(0)).over(w) == 1)).drop("_q", "_at")


def item_tex(items: DataFrame, quote: str = "quote") -> DataFrame:
    """Adds tex to mark_items()' rows, with columns latex, src, caption_ko, caption, sub_items, converted, present."""
    text = T.or_default(F.col("text_ko"), F.coalesce("text", F.lit("")))
    initial = F.concat(F.lit("\\lettrine[lines=2]{"), F.left(text, F.lit(1)), F.lit("}{"), F.substring(text, F.lit(2), F.length(text)), F.lit("}"))
    body = F.when(F.col("box_type") == quote, environment(quote, text)).when(F.col("is_first"), initial).otherwise(text)

    def sub(s: Column) -> Column:
        deep = F.concat(F.lit("\\begin{deepresearch}{"), escape_light(s["title"]), F.lit("}\n"), s["text"], F.lit("\n\\end{deepresearch}"))
        return F.when(s["type"] == "translatornote", environment("translatornote", s["text"])).otherwise(deep)

    notes = F.array_join(F.transform(F.coalesce("sub_items", F.array().cast("array<struct<type:string,title:string,text:string>>")), sub), "\n")
    figure = figure_box(F.col("src"), T.or_default(F.col("caption_ko"), F.col("caption")), F.col("converted"), F.col("present"))
    tex = (
        F.when((F.col("type") == "paragraph") & ~F.col("is_quoted"), F.concat_ws("\n", body, _part(notes)))
        .when(F.col("type") == "figure", environment("center", figure))
        .when(F.col("type") == "equation", environment("mathbox", F.col("latex")))
    )
    return items.withColumn("tex", tex)


def chapter(items: DataFrame, titles: DataFrame, preamble: str = "", ending: str = "\\end{document}") -> DataFrame:
    """(chapter_id, tex): titles is (chapter_id, chapter_title, chapter_title_ko, sec_idx, title, title_ko), items are item_tex()'s."""
    lines = items.where(F.col("tex").isNotNull()).select("chapter_id", "sec_idx", "item_idx", "tex")
    head = F.concat(F.lit("\\section{"), escape_light(T.clean_title(T.or_default(F.col("title_ko"), F.col("title")))), F.lit("}"))
    heads = titles.select("chapter_id", "sec_idx", F.lit(-1).alias("item_idx"), head.alias("tex"))
    quote = items.where("is_epigraph").select("chapter_id", F.lit(-1).alias("sec_idx"), F.lit(0).alias("item_idx"), F.concat(F.lit("\\epigraph{"), F.col("text"), F.lit("}{}")).alias("tex"))
    rows = lines.unionByName(heads).unionByName(quote)
    ordered = F.array_sort(F.collect_list(F.struct("sec_idx", "item_idx", "tex")))
    body = rows.groupBy("chapter_id").agg(F.array_join(F.transform(ordered, lambda x: x["tex"]), "\n\n").alias("body"))
    name = titles.groupBy("chapter_id").agg(F.first("chapter_title").alias("en"), F.first("chapter_title_ko").alias("ko"))
    title = F.concat(F.lit("\\chapter{"), escape_light(T.clean_title(T.or_default(F.col("ko"), F.col("en")))), F.lit("}\n\\label{ch:"), F.col("chapter_id"), F.lit("}\n\n"))
    return body.join(name, "chapter_id").select("chapter_id", F.concat(F.lit(preamble), title, F.col("body"), F.lit("\n" + ending)).alias("tex"))
