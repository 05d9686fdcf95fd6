"""Paginated documents as a Python data source: page ranges of a file are partitions, filters are pushed down.

A format is an extractor that a caller names, module:name. As a class it has count(path) -> pages and
read(path, low, high) -> (number, page) for pages low up to high, exclusive; a page is a dictionary of
layout.PAGE_SCHEMA, or the exception that reading it raised. Then a file of many pages is many partitions. As a
plain function (path, low, high) it only reads, and a file is one partition.

A filter on page narrows the ranges before tasks are made, and one on doc_id leaves out files. A page that
cannot be read is a row with its error; an error in between costs the rest of its range and is a row as well.

PageFiles is the extractor of page files, which write_pages() makes: pages one after the other, then where
each begins, how many there are, and a mark, so that a range is found by two small reads at the end of the file.
"""

from __future__ import annotations

import importlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from folioforge.operators import layout
from folioforge.operators.layout import PAGE_SCHEMA
from folioforge.shipping import ship
from folioforge.sources.files import image_kind

SCHEMA = "doc_id string, page int, payload string, error string"
PAGES_A_PARTITION = 64


class PageRange(InputPartition):
    def __init__(self, path: str, low: int, high: int | None):
        self.path, self.low, self.high = path, low, high


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        module, _, name = options["extractor"].partition(":")
        self.extractor = (module, name)
        self.size = int(options.get("pages", PAGES_A_PARTITION))
        self.low, self.high, self.docs = 0, None, None

    def _found(self):
        found = getattr(importlib.import_module(self.extractor[0]), self.extractor[1])
        return found() if isinstance(found, type) else found

    def _below(self, high: int) -> None:
        self.high = high if self.high is None else min(self.high, high)

    def pushFilters(self, filters: list[Filter]):
        """Narrows pages and documents; what is returned is checked again by Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            whole = isinstance(value, int) and not isinstance(value, bool)
            if column == ("page",) and whole and isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if column == ("page",) and whole and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self._below(value + (not isinstance(f, LessThan)))
            if column == ("doc_id",) and isinstance(f, EqualTo | In):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.docs = wanted if self.docs is None else self.docs & wanted
            yield f

    def partitions(self):
        extractor = self._found()
        out = []
        for path in self.paths:
            if self.docs is not None and doc_of(path) not in self.docs:
                continue
            if not hasattr(extractor, "count"):
                out.append(PageRange(path, self.low, self.high))
                continue
            try:
                n = extractor.count(path)
            except Exception:
                out.append(PageRange(path, self.low, self.high))  # its task tells what is wrong
                continue
            stop = n if self.high is None else min(n, self.high)
            out += [PageRange(path, at, min(at + self.size, stop)) for at in range(self.low, stop, self.size)]
        return out or [PageRange("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        extractor = self._found()
        read = getattr(extractor, "read", extractor)
        doc_id, last = doc_of(partition.path), None
        try:
            for number, page in read(partition.path, partition.low, partition.high):
                last = number
                if isinstance(page, Exception):
                    yield doc_id, number, None, f"{type(page).__name__}: {page}"
                else:
                    yield doc_id, number, json.dumps(page), None
        except Exception as e:
            yield doc_id, partition.low if last is None else last + 1, None, f"{type(e).__name__}: {e}"


class PageSource(DataSource):
    """spark.read.format("paginated").options(paths=json list, extractor="module:name", pages=pages of a partition)"""

    @classmethod
    def name(cls):
        return "paginated"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options)


def doc_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def read_paginated(spark: SparkSession, paths: list[str], extractor: str, pages: int = PAGES_A_PARTITION) -> DataFrame:
    """Pages with their blocks and images parsed from the extractor's payload, and error, null for a good page."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    rows = spark.read.format("paginated").options(paths=json.dumps(paths), extractor=extractor, pages=pages).load()
    inner = PAGE_SCHEMA.split(", ", 2)[2]
    return rows.select("doc_id", "page", F.from_json("payload", inner).alias("p"), "error").select("doc_id", "page", "p.*", "error")


def page_images(pages: DataFrame) -> DataFrame:
    """(doc_id, page, filename, position, content, kind, error): the images that pages carry, decoded from base64.

    An image without data, or whose data cannot be decoded, is a row with an error, and costs no other row; kind is what
    the first bytes say, whatever the name.
    """
    named = layout.images(pages).join(pages.select("doc_id", "page", F.posexplode("images").alias("img_idx", "i")), ["doc_id", "page", "img_idx"])
    content = F.try_to_binary(F.nullif(F.col("i.data"), F.lit("")), F.lit("base64"))
    rows = named.select("doc_id", "page", "filename", "position", content.alias("content"), F.col("i.data").alias("_data"))
    error = F.when(F.coalesce("_data", F.lit("")) == "", "no data").when(F.col("content").isNull(), "no base64")
    return rows.withColumns({"kind": image_kind(F.col("content")), "error": error}).drop("_data")


# --- Page files ------------------------------------------------------------------------------------
_MARK, _TAIL = b"PAGEFILE", 16


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class PageFiles:
    """The extractor of page files."""

    def _places(self, file, first: int, stop: int | None) -> tuple[int, list[int]]:
        """(number of pages, where pages first to stop begin, and where the last ends)."""
        size = file.size()
        tail = file.read_at(_TAIL, size - _TAIL) if size >= _TAIL else b""
        if tail[8:] != _MARK:
            raise ValueError("not a whole page file")
        (n,) = struct.unpack("<q", tail[:8])
        stop = n if stop is None else min(n, stop)
        if first >= stop:
            return n, []
        table = size - _TAIL - 8 * (n + 1)
        return n, list(struct.unpack(f"<{stop - first + 1}q", file.read_at(8 * (stop - first + 1), table + 8 * first)))

    def count(self, path: str) -> int:
        fs, name = _opened(path)
        with fs.open_input_file(name) as file:
            return self._places(file, 0, 0)[0]

    def read(self, path: str, low: int, high: int | None) -> Iterator[tuple[int, dict | Exception]]:
        fs, name = _opened(path)
        with fs.open_input_file(name) as file:
            _, places = self._places(file, low, high)
            for number, (a, b) in enumerate(zip(places, places[1:]), low):
                try:
                    page = json.loads(file.read_at(b - a, a))
                    yield number, page if isinstance(page, dict) else ValueError("no page")
                except ValueError as e:
                    yield number, e


def write_pages(pages: DataFrame, folder: str, payload: Column) -> DataFrame:
    """Writes a page file per doc_id with its pages in order of page, and returns (doc_id, path, n_pages) of what was written.

    payload is a string or binary column. A document is streamed through one task, page by page; a file gets its
    name when it is whole, so a task that is run again leaves no half of one. Pages should count from 0: a page's
    number in the file is its place.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        fs.create_dir(root)
        doc = out = part = None
        places: list[int] = []

        def done() -> pa.RecordBatch:
            out.write(struct.pack(f"<{len(places)}q", *places) + struct.pack("<q", len(places) - 1) + _MARK)
            out.close()
            fs.move(part, f"{root}/{doc}")
            return pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([f"{folder}/{doc}"]), pa.array([len(places) - 1], pa.int64())], ["doc_id", "path", "n_pages"])

        for batch in batches:
            for row in range(batch.num_rows):
                name, content = batch.column(0)[row].as_py(), batch.column(1)[row].as_py() or b""
                if name != doc:
                    if out is not None:
                        yield done()
                    doc, places, part = name, [0], f"{root}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part)
                out.write(content)
                places.append(places[-1] + len(content))
        if out is not None:
            yield done()

    rows = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page", payload.cast("binary").alias("payload"))
    met = rows.repartition("doc_id").sortWithinPartitions("doc_id", "page").select("doc_id", "payload")
    return met.mapInArrow(write, "doc_id string, path string, n_pages bigint")
