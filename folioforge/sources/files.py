"""Files in and out: section documents, manifests, binary pages; dynamic partitions for upserts."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import base_name, safe_key
from folioforge.shipping import ship

_IMAGE = "struct<filename:string,position:struct<x:double,y:double,width:double,height:double>,page:int,path:string>"
_MODULE = "struct<score:int,issues:array<string>,auto_fixed:array<string>,flagged:array<string>,skipped:boolean>"

SECTION_SCHEMA = (
    "section_id string, title_original string, title_translated string, level string, font_size double, content_original string, content_translated string, "
    f"images array<{_IMAGE}>, page_range array<int>, "
    f"verification struct<formula:{_MODULE},semantic:{_MODULE},logic:{_MODULE},research:{_MODULE},score:int,skipped:boolean>, "
    "enrichments array<struct<term:string,title_ko:string,explanation:string,source:string>>, "
    "supplements struct<summary:string,tikz_diagram:string,examples:array<string>,exercises:array<string>,solutions:string,glossary:array<array<string>>>"
)
_ITEM = (
    "struct<type:string,text:string,text_ko:string,latex:string,src:string,caption:string,caption_ko:string,box_type:string,"
    "sub_items:array<struct<type:string,title:string,text:string>>>"
)
CHAPTER_SCHEMA = f"chapter_id string, chapter_title string, chapter_title_ko string, sections array<struct<title:string,title_ko:string,content:array<{_ITEM}>>>"


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Section documents, one JSON file each, with file_name; missing keys are null. Order by file_name where order counts."""
    rows = spark.read.schema(SECTION_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file_name", base_name(F.col("_metadata.file_path")))


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAPTER_SCHEMA).option("multiLine", True).json(path)


def chapter_items(chapters: DataFrame) -> DataFrame:
    """Flat items of nested chapters: chapter_id, sec_idx, item_idx and the item's fields."""
    secs = chapters.select("chapter_id", F.posexplode("sections").alias("sec_idx", "s"))
    items = secs.select("chapter_id", "sec_idx", F.posexplode("s.content").alias("item_idx", "i"))
    return items.select("chapter_id", "sec_idx", "item_idx", "i.*")


def write_sections(rows: DataFrame, path: str, key: str = "section_id") -> None:
    """An export for tools that want a file per section: one folder per key with its dots as underscores; folders of other keys stay.

    As many files as sections. What a plan reads again belongs in a keyed.KeyedTable, whose files do not grow with the keys.
    """
    keyed = rows.withColumn("key", safe_key(F.col(key)))
    keyed.write.partitionBy("key").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def write_metadata(sections: DataFrame, path: str, source: str, total_pages: int) -> None:
    metadata(sections, source, total_pages).write.mode("overwrite").json(path)


def metadata(sections: DataFrame, source: str, total_pages: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each book (by): total_sections, section_ids in order, pdf_path, total_pages. A list is as long as a book."""
    ids = F.array_sort(F.collect_list("section_id"))
    return sections.groupBy(*by).agg(F.count(F.lit(1)).alias("total_sections"), ids.alias("section_ids")).withColumns({"pdf_path": F.lit(source), "total_pages": F.lit(total_pages)})


def write_documents(documents: DataFrame, path: str) -> None:
    """Rendered documents as text, partitioned by their other columns; as many files as there are documents."""
    keys = [c for c in documents.columns if c != "tex"]
    documents.write.mode("overwrite").partitionBy(*keys).text(path, lineSep="\n")


def read_binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of files; pruned to the columns used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def image_kind(content):
    """What a file is by its first bytes, whatever its name says."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.decode(F.substring(content, 1, 64), "utf-8"))
    return (
        F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("1F8B"), "gzip").when(head.startswith("25504446"), "pdf")
        .when(text.rlike(r"^\s*<!doctype html|^\s*<html"), "html").when(text.rlike(r"^\s*<(\?xml|svg)"), "svg").otherwise("other")
    )


def fetched(urls: DataFrame, manifest: DataFrame, fetch: Callable[[str], bytes], url_col: str = "url") -> DataFrame:
    """(name, url, content, error) of what the manifest lacks; a failed fetch has its error and costs only its row.

    fetch runs on the executors, a URL at a time: give it a client with a time limit, and write the result once.
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                content = error = None
                try:
                    content = fetch(url)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([url]), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["name", "url", "content", "error"])

    ship(urls.sparkSession)
    return assets_to_fetch(urls, manifest, url_col).select("name", "url").mapInArrow(get, "name string, url string, content binary, error string")


def compile_document(path: str, command: tuple[str, ...] = ("xelatex", "-interaction=nonstopmode", "-halt-on-error"), passes: int = 2, timeout_s: float = 120.0) -> tuple[bool, str]:
    """(whether all passes ended well, the last output) of an outside program on one local file, if it is installed."""
    if shutil.which(command[0]) is None:
        return False, f"{command[0]} is not installed"
    out = ""
    for _ in range(passes):
        try:
            done = subprocess.run([*command, os.path.basename(path)], cwd=os.path.dirname(os.path.abspath(path)), capture_output=True, text=True, timeout=timeout_s, check=False)
        except subprocess.TimeoutExpired:
            return False, f"no end within {timeout_s} s"
        out = done.stdout + done.stderr
        if done.returncode:
            return False, out
    return True, out


def assets_to_fetch(urls: DataFrame, manifest: DataFrame, url_col: str = "url") -> DataFrame:
    """(name, url): distinct file names that the manifest (name) lacks; of URLs with the same name the least."""
    wanted = urls.where(F.col(url_col).isNotNull()).select(base_name(F.col(url_col)).alias("name"), F.col(url_col).alias("url")).where("name <> ''")
    return wanted.groupBy("name").agg(F.min("url").alias("url")).join(manifest.select("name"), "name", "left_anti")


def work_left(rows: DataFrame, done: DataFrame, key: str, filled: str) -> DataFrame:
    """Rows whose key is not done yet; done counts where its filled column has text."""
    return rows.join(done.where(F.coalesce(F.col(filled), F.lit("")) != "").select(key), key, "left_anti")


def resumed(rows: DataFrame, done: DataFrame, key: str, filled: str) -> DataFrame:
    """All rows, with the stored value of the filled column where there is one."""
    stored = done.where(F.coalesce(F.col(filled), F.lit("")) != "").select(key, F.col(filled).alias("_stored"))
    return rows.join(stored, key, "left").withColumn(filled, F.coalesce("_stored", F.col(filled) if filled in rows.columns else F.lit(None).cast("string"))).drop("_stored")


def candidate_file(ids: DataFrame, manifest: DataFrame, id_col: str = "section_id") -> DataFrame:
    """Adds file_name: the first of {id}.json and {id with _ for .}.json in the manifest (name), else null."""
    known = manifest.select(F.col("name").alias("_n")).distinct()
    one, two = F.concat(F.col(id_col), F.lit(".json")), F.concat(safe_key(F.col(id_col)), F.lit(".json"))
    rows = ids.withColumns({"_1": one, "_2": two})
    rows = rows.join(known.withColumn("_a", F.col("_n")).withColumnRenamed("_n", "_1"), "_1", "left").join(known.withColumn("_b", F.col("_n")).withColumnRenamed("_n", "_2"), "_2", "left")
    return rows.withColumn("file_name", F.coalesce("_a", "_b")).drop("_1", "_2", "_a", "_b")


def progress(manifest: DataFrame, expected: int) -> DataFrame:
    """One row: finished, expected, percent."""
    done = F.count(F.lit(1))
    return manifest.agg(done.alias("finished")).withColumns({"expected": F.lit(expected), "percent": F.floor(F.col("finished") * 100 / F.lit(expected)).cast("int")})
