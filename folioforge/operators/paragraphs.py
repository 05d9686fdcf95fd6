"""Paragraph tables: split, filter, de-duplicate, chunk, align, join again.

Every table carries its position column; reassembly orders by it. Windows are partitioned by
document, so the work of a task is bounded by documents, not by the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T


def explode_paragraphs(df: DataFrame, id_col: str, text_col: str, sep: str = "\n\n", strip: bool = True) -> DataFrame:
    """(id, pos, para): paragraphs with text, in order; positions count blank ones too."""
    parts = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), sep, -1)).alias("pos", "para")
    out = df.select(id_col, parts)
    if strip:
        out = out.withColumn("para", T.ascii_strip(F.col("para")))
    return out.where(F.col("para").rlike("[^ \t\n\\x0B\f\r]"))


def implode(df: DataFrame, id_col: str, pos_col: str = "pos", text_col: str = "para", sep: str = "\n\n", out: str = "text") -> DataFrame:
    """(id, text): the parts joined in order of their positions."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(text_col).alias("s"))))
    return df.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), sep).alias(out))


def mark_repeats(paragraphs: DataFrame, id_col: str, prefix: int = 30) -> DataFrame:
    """Adds repeated: longer than the prefix, and an earlier paragraph of the document begins alike."""
    w = Window.partitionBy(id_col, F.left(F.col("para"), F.lit(prefix))).orderBy("pos")
    return paragraphs.withColumn("repeated", (F.row_number().over(w) > 1) & (F.length("para") > prefix))


def drop_repeats(paragraphs: DataFrame, id_col: str, prefix: int = 30) -> DataFrame:
    return mark_repeats(paragraphs, id_col, prefix).where(~F.col("repeated")).drop("repeated")


def is_untranslated(para: Column, least: float = 0.15, longer: int = 100) -> Column:
    """Long paragraphs whose letters are hardly Hangul; without any letters they count as translated."""
    hangul, latin = T.script_count(para, T.HANGUL), T.script_count(para, "a-zA-Z")
    # Without any Hangul one Latin letter is enough to know.
    few = F.when(~para.rlike(f"[{T.HANGUL}]"), para.rlike("[a-zA-Z]")).otherwise(hangul / (hangul + latin) < least)
    return (F.length(para) > longer) & few


def chunk_array(text: Column, sep: str = "\n\n", most: int = 2000) -> Column:
    """Chunks of whole paragraphs, filled greedily while the paragraphs' lengths fit; a longer one stands alone.

    A fold over the document's paragraphs; lengths do not count separators.
    """
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), sep, -1), lambda x: x.rlike("[^ \t\n\\x0B\f\r]"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def step(s: Column, p: Column) -> Column:
        fits = s["open"].isNotNull() & (s["size"] + F.length(p) <= most)
        closed = F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(
            F.when(fits, s["done"]).otherwise(closed).alias("done"),
            F.when(fits, F.concat(s["open"], F.lit(sep), p)).otherwise(p).alias("open"),
            F.when(fits, s["size"] + F.length(p)).otherwise(F.length(p)).alias("size"),
        )

    end = lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    return F.aggregate(parts, start, step, end)


def chunks(df: DataFrame, id_col: str, text_col: str, sep: str = "\n\n", most: int = 2000) -> DataFrame:
    """(id, chunk_idx, chunk)."""
    return df.select(id_col, F.posexplode(chunk_array(F.col(text_col), sep, most)).alias("chunk_idx", "chunk"))


def align(pairs: DataFrame, id_col: str, original: str, translated: str, sep: str = "\n\n", most: int = 8, cut: int = 800) -> DataFrame:
    """(id, pos, original_para, translated_para): i-th with i-th, at most so many pairs, each cut to a length."""
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), sep, -1), T.ascii_strip), lambda x: x != "")
    both = pairs.select(id_col, split(original).alias("o"), split(translated).alias("t"))
    n = F.least(F.size("o"), F.size("t"), F.lit(most))
    zipped = F.arrays_zip(F.slice("o", F.lit(1), n).alias("o"), F.slice("t", F.lit(1), n).alias("t"))
    rows = both.select(id_col, F.posexplode(zipped).alias("pos", "z"))
    return rows.select(id_col, "pos", F.left(F.col("z.o"), F.lit(cut)).alias("original_para"), F.left(F.col("z.t"), F.lit(cut)).alias("translated_para"))


def clean_translated(df: DataFrame, id_col: str, text_col: str, prefix: int = 30) -> DataFrame:
    """(id, text): the whole cleaning of a translated text, in its fixed order, as one expression per row."""
    c = T.strip_comment_lines(T.strip_east_asian(F.coalesce(F.col(text_col), F.lit(""))))
    c = T.strip_tags(T.scripts_to_tex(T.strip_headers(T.strip_bullets(T.strip_emphasis(c)))))
    parts = F.filter(F.transform(F.split(c, "\n\n", -1), T.py_strip), lambda x: (x != "") & ~is_untranslated(x))

    def once(keyed: Column) -> Column:
        # A paragraph repeats an earlier one if both begin with the same characters and it is longer than those: in order of
        # beginnings and places, an earlier one stands right before.
        again = lambda s, i: (F.length(s["x"]) > prefix) & (i > 0) & (F.try_element_at(keyed, i)["b"] == s["b"])
        kept = F.filter(keyed, lambda s, i: ~F.coalesce(again(s, i), F.lit(False)))
        return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])

    keyed = F.array_sort(F.transform(parts, lambda x, i: F.struct(F.left(x, F.lit(prefix)).alias("b"), i.alias("i"), x.alias("x"))))
    text = F.array_join(T.let(keyed, once), "\n\n")
    return df.select(id_col, T.py_strip(T.collapse_spaces(T.collapse_newlines(text))).alias("text"))


def bullet_runs(lines: DataFrame, id_col: str, pos_col: str = "pos", text_col: str = "line") -> DataFrame:
    """Adds begins_list and ends_list to the first and last line of each run of bullet lines."""
    w = Window.partitionBy(id_col).orderBy(pos_col)
    bullet = F.col(text_col).rlike(r"^\s*[*-]\s+")
    marked = lines.withColumn("is_bullet", bullet)
    before = F.coalesce(F.lag("is_bullet").over(w), F.lit(False))
    after = F.coalesce(F.lead("is_bullet").over(w), F.lit(False))
    return marked.withColumns({"begins_list": F.col("is_bullet") & ~before, "ends_list": F.col("is_bullet") & ~after})
