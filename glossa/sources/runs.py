"""A keyed table that grows by appended runs and is compacted by levels.

A run is a Parquet folder with a row a key, in buckets by the key's hash and sorted by key in each. What the table
consists of is said by the newest manifest, a small file that is put in place whole and never changed: readers
keep to the manifest that they have read while runs are merged, and of two writers the second goes on from the first.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKETS, FAN = 16, 4


@dataclass
class Manifest:
    """``runs`` by folder name with the level of each; ``writers`` with the number of the last batch of each."""

    version: int = 0
    buckets: int = BUCKETS
    keys: list[str] = field(default_factory=list)
    schema: str = ""
    runs: dict[str, int] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)


class RunLog:
    """``merge`` are the aggregates that make one row of several of a key, each named as the column that it replaces.

    They must give the same for parts of parts, as sums, least and greatest values do. A table keeps the number of
    buckets and the keys that it was made with; other keys are refused, another number is ignored.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: list[Column], schema: str | None = None, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.path, self.keys, self.merge, self.schema, self.buckets, self.fan = spark, path.rstrip("/"), keys, merge, schema, buckets, max(2, fan)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, folder: str) -> dict[str, int]:
        """Names in a folder of the table, with the time of their last change in ms."""
        at = self._path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest one, or that of a version; without any, one of an empty table."""
        known = sorted(int(n) for n in self._names("manifests") if n.isdigit())
        if version is None and not known:
            return Manifest(0, self.buckets, self.keys)
        found = self._fs.open(self._path("manifests", f"{known[-1] if version is None else version:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        finally:
            found.close()
        out = Manifest(**json.loads(text))
        if out.keys != self.keys:
            raise ValueError(f"{self.path} is keyed by {out.keys}, not by {self.keys}")
        return out

    def _put(self, m: Manifest) -> bool:
        """Puts a manifest in place whole; False if its version is there already."""
        jvm, name = self.spark._jvm, f"{m.version:012d}"
        part, at = self._path("manifests", f"_{uuid.uuid4().hex}"), self._path("manifests", name)
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(part, at, none)
        except Exception as e:
            if not self._fs.exists(at):
                raise e
            self._fs.delete(part, False)
            return False
        return True

    def _bucket(self, buckets: int, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(buckets)).cast("int")

    def _merged(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy(*more, *self.keys).agg(*self.merge)

    def _write(self, rows: DataFrame, m: Manifest) -> tuple[str, str]:
        """(folder name, schema) of a new run. A key is one row by now, so that buckets are even whatever the keys' counts."""
        name = f"run-{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self._bucket(m.buckets, *map(F.col, self.keys))).repartition(m.buckets, "bucket")
        placed.sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{self.path}/runs/{name}")
        return name, rows.schema.json()

    def append(self, rows: DataFrame, writer: str | None = None, number: int | None = None) -> bool:
        """Adds rows of the table's columns, several of a key or one; False if the batch is in the table already.

        A ``writer`` numbers its batches upwards; a batch that is sent again under its number adds nothing. A run
        whose manifest was not put in place, as the writer was lost, is not part of the table.
        """
        m = self.manifest()
        if writer is not None and number <= m.writers.get(writer, -1):
            return False
        name, schema = self._write(self._merged(rows), m)
        while True:
            if writer is not None and number <= m.writers.get(writer, -1):
                return False
            writers = {**m.writers, writer: number} if writer is not None else m.writers
            if self._put(Manifest(m.version + 1, m.buckets, self.keys, m.schema or schema, {**m.runs, name: 0}, writers)):
                break
            before, m = m.buckets, self.manifest()
            if m.buckets != before:  # another writer has made the table meanwhile
                name, schema = self._write(self._read(m, {name: 0}, schema), m)
        self.compact()
        return True

    def compact(self) -> int:
        """Merges the runs of each level that has ``fan`` or more into one of the next; the number of merges made.

        So a row is written again once a level, and there are fewer than ``fan`` runs a level, of which the
        number is the logarithm of that of the batches.
        """
        made = 0
        while True:
            m = self.manifest()
            levels = sorted(set(m.runs.values()))
            level = next((x for x in levels if sum(v == x for v in m.runs.values()) >= self.fan), None)
            if level is None:
                return made
            old = {n: v for n, v in m.runs.items() if v == level}
            name, _ = self._write(self._merged(self._read(m, old)), m)
            while set(old) <= set(m.runs):
                kept = {n: v for n, v in m.runs.items() if n not in old}
                if self._put(Manifest(m.version + 1, m.buckets, self.keys, m.schema, {**kept, name: level + 1}, m.writers)):
                    made += 1
                    break
                m = self.manifest()  # appended to meanwhile, or merged by another, whose runs then stand

    def _read(self, m: Manifest, runs: dict[str, int] | None = None, schema: str | None = None) -> DataFrame:
        """Rows of runs with their bucket, several of a key."""
        runs = m.runs if runs is None else runs
        if not runs:
            if self.schema is None:
                raise ValueError(f"nothing at {self.path}")
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        fields = StructType.fromJson(json.loads(schema or m.schema)).add("bucket", IntegerType())
        parts = [self.spark.read.schema(fields).parquet(f"{self.path}/runs/{n}") for n in sorted(runs)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def state(self, m: Manifest | None = None) -> DataFrame:
        """A row a key, as of a manifest or now."""
        return self._merged(self._read(m or self.manifest()))

    def find(self, *values) -> DataFrame:
        """One row or none: that of a key. One bucket of each run is read, and of it what may hold the key."""
        m = self.manifest()
        rows = self._read(m)
        own = [F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(self.keys, values, strict=True)]
        hit = F.col("bucket") == self._bucket(m.buckets, *own)
        for k, v in zip(self.keys, own, strict=True):
            hit &= F.col(k).eqNullSafe(v)
        return self._merged(rows.filter(hit))

    def vacuum(self, keep: int = 2, older_than: float = 86_400) -> int:
        """Deletes runs that none of the last ``keep`` manifests names, and older manifests; the number of runs deleted.

        What changed less than ``older_than`` seconds ago stays, as it may be that of a writer who is not done or of a reader.
        """
        names, before = self._names("manifests"), (time.time() - older_than) * 1000
        known = sorted(n for n in names if n.isdigit())
        used = {r for n in known[-max(1, keep) :] for r in self.manifest(int(n)).runs}
        gone = [n for n, t in self._names("runs").items() if n not in used and t < before]
        for n in [n for n in known[: -max(1, keep)] if names[n] < before]:
            self._fs.delete(self._path("manifests", n), False)
        for n in gone:
            self._fs.delete(self._path("runs", n), True)
        return len(gone)
