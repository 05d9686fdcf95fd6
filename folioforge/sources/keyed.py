"""Keyed tables: rows replaced by key, in a fixed number of buckets, behind a versioned manifest.

A write adds a layer: a folder with one Parquet file for each bucket that it touches, whatever the number
of keys. What counts is the manifest: a small JSON file that lists the layers and, for each, the buckets in
which it still counts. A version becomes visible by renaming its manifest into place, which fails if another
writer was faster; then the write is tried again on the newer version. A batch that is killed leaves files that
no manifest names, and readers go on with the version before.

Reading merges by bucket: buckets with one layer are scanned as they are, with filters and columns pushed down;
in others the row of the newest layer counts for each key, removed keys go, by one aggregate over those buckets.
Buckets with more than most_layers layers are rewritten to one. Files are at most buckets * (most_layers + 1).

A batch may carry the name of its writer and a number: a number that the manifest has seen is not written again,
so a stream that repeats a batch after a failure has each key once.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_GONE, _VERSION = "_removed", "_version"


@dataclass(frozen=True)
class Layer:
    path: str
    buckets: tuple[int, ...]


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str = ""
    layers: tuple[Layer, ...] = ()
    written: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def parse(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(d["version"], d["schema"], tuple(Layer(x["path"], tuple(x["buckets"])) for x in d["layers"]), d["written"])

    def depth(self) -> dict[int, int]:
        """Layers of each bucket."""
        out: dict[int, int] = {}
        for layer in self.layers:
            for b in layer.buckets:
                out[b] = out.get(b, 0) + 1
        return out


class Conflict(RuntimeError):
    """Another writer's version came first, again and again."""


class KeyedTable:
    """A table with one row for each key. Null keys are a key like any other.

    buckets is fixed by the table's first version; pick it so that a bucket is a file of a good size, some hundred
    MB for large tables. Columns may be added later, and are null in older rows.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, most_layers: int = 8):
        self.spark, self.path, self.key, self.most_layers = spark, path.rstrip("/"), key, most_layers
        self.buckets = self._fixed("buckets", buckets)

    # --- Files -----------------------------------------------------------------------------------
    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._hadoop(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _text(self, path: str) -> str:
        fs, p = self._hadoop(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> bool:
        """Creates a file with that text, all at once; false if there is one."""
        jvm = self.spark.sparkContext._jvm
        fs, p = self._hadoop(path)
        _, part = self._hadoop(f"{path}.{uuid.uuid4().hex}.part")
        stream = fs.create(part)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(part, p, never_over)
            return True
        except Exception as e:
            fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def _fixed(self, name: str, value: int) -> int:
        path = f"{self.path}/{name}"
        self._put(path, str(value))
        return int(self._text(path))

    # --- Versions ----------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifests") if re.fullmatch(r"\d+\.json", n))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest()
        return Manifest.parse(self._text(f"{self.path}/manifests/{version:020d}.json"))

    def _commit(self, manifest: Manifest) -> bool:
        return self._put(f"{self.path}/manifests/{manifest.version:020d}.json", manifest.text())

    # --- Writing -----------------------------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")

    def _layer(self, rows: DataFrame, version: int) -> Layer:
        """Writes rows, which have one row a key, as files by bucket."""
        name = f"data/{version:020d}-{uuid.uuid4().hex}"
        placed = rows.withColumn("_bucket", self._bucket())
        placed.repartition(self.buckets, "_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        found = [int(n.partition("=")[2]) for n in self._names(f"{self.path}/{name}") if n.startswith("_bucket=")]
        return Layer(name, tuple(sorted(found)))

    def _add(self, rows: DataFrame, batch: tuple[str, int] | None, tries: int) -> int:
        layer = None
        for _ in range(tries):
            now = self.manifest()
            if batch is not None and now.written.get(batch[0], -1) >= batch[1]:
                return now.version
            if layer is None:
                layer = self._layer(rows, now.version + 1)
            known = StructType.fromJson(json.loads(now.schema)) if now.schema else StructType()
            schema = StructType([*known.fields, *(f for f in rows.schema.fields if f.name not in known.fieldNames())])
            written = now.written | ({batch[0]: batch[1]} if batch is not None else {})
            # A layer's place in the list is its age: the newest is last, whatever its folder is called.
            after = Manifest(now.version + 1, schema.json(), (*now.layers, layer), written)
            if self._commit(after):
                if max(after.depth().values(), default=0) > self.most_layers:
                    self.compact(self.most_layers)
                return after.version
        raise Conflict(f"{self.path}: {tries} other versions came first")

    def write(self, rows: DataFrame, order: Column | None = None, batch: tuple[str, int] | None = None, tries: int = 8) -> int:
        """Replaces rows by key and returns the version. Of rows with one key the last in order counts, without one the greatest as JSON."""
        names = [c for c in rows.columns if c != self.key]
        last = order if order is not None else F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
        one = rows.groupBy(F.col(f"`{self.key}`")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(False).alias(_GONE)), last).alias("_row"))
        return self._add(one.select(self.key, "_row.*"), batch, tries)

    def remove(self, keys: DataFrame, batch: tuple[str, int] | None = None, tries: int = 8) -> int:
        """Removes keys; a later write may bring them back."""
        return self._add(keys.select(self.key).distinct().withColumn(_GONE, F.lit(True)), batch, tries)

    def compact(self, most_layers: int = 1) -> int:
        """Rewrites buckets with more layers to one; returns the version. If another writer is faster, it is left for the next time."""
        now = self.manifest()
        deep = {b for b, n in now.depth().items() if n > most_layers}
        if not deep:
            return now.version
        layer = self._layer(self._merged(now, deep), now.version + 1)
        kept = [replace(x, buckets=tuple(b for b in x.buckets if b not in deep)) for x in now.layers]
        after = replace(now, version=now.version + 1, layers=(*(x for x in kept if x.buckets), layer))
        return after.version if self._commit(after) else now.version

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the last few, and folders that none of those names; folders of versions to come stay. Returns what went."""
        known = self.versions()
        stay = known[-keep:]
        named = {x.path for v in stay for x in self.manifest(v).layers}
        gone = [f"manifests/{v:020d}.json" for v in known if v not in stay]
        gone += [f"data/{n}" for n in self._names(f"{self.path}/data") if f"data/{n}" not in named and known and int(n[:20]) <= known[-1]]
        for name in gone:
            fs, p = self._hadoop(f"{self.path}/{name}")
            fs.delete(p, True)
        return gone

    # --- Reading -----------------------------------------------------------------------------------
    def _scan(self, manifest: Manifest, wanted: set[int]) -> DataFrame:
        paths = [f"{self.path}/{x.path}/_bucket={b}" for x in manifest.layers for b in x.buckets if b in wanted]
        schema = StructType.fromJson(json.loads(manifest.schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, manifest: Manifest, wanted: set[int]) -> DataFrame:
        """The newest row of each key of those buckets, removed keys left out."""
        rows = self._scan(manifest, wanted)
        age = F.create_map(*[F.lit(v) for k, x in enumerate(manifest.layers) for v in (x.path[5:], k)])
        aged = rows.withColumn(_VERSION, age[F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+)/", 1)])
        names = [c for c in rows.columns if c != self.key]
        last = aged.groupBy(F.col(f"`{self.key}`")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.col(_VERSION)).alias("_row"))
        return last.select(self.key, "_row.*").where(~F.col(_GONE))

    def read(self, version: int | None = None, keys: list | None = None) -> DataFrame:
        """The table as of a version, the last by default; with keys, a few of them, only their buckets are read."""
        manifest = self.manifest(version)
        if not manifest.layers:
            raise ValueError(f"{self.path} has no version yet")
        depth = manifest.depth()
        if keys is not None:
            asked = self.spark.createDataFrame([(k,) for k in keys], StructType([StructType.fromJson(json.loads(manifest.schema))[self.key]]))
            held = {r[0] for r in asked.select(self._bucket()).distinct().collect()}
            depth = {b: n for b, n in depth.items() if b in held}
        flat, deep = ({b for b, n in depth.items() if (n > 1) is many} for many in (False, True))
        columns = [c for c in StructType.fromJson(json.loads(manifest.schema)).fieldNames() if c != _GONE]
        out = self._scan(manifest, flat).where(~F.col(_GONE))
        if deep:
            out = out.select(*columns).unionByName(self._merged(manifest, deep).select(*columns))
        return out.select(*columns).where(F.col(f"`{self.key}`").isin(keys)) if keys is not None else out.select(*columns)
