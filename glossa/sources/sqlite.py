"""Tables of SQLite files as a Spark data source: ranges of row numbers as partitions, filters pushed into the file, schema from its catalog.

A path is a file, or a folder of files (``*.db``) that have the same table, as the writer makes them: a file has one
writer at a time, so that each task writes a file of its own. Driver and executors must see the path as a file.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

BATCH = 10_000
COMPARED = {ds.EqualTo: "=", ds.EqualNullSafe: "IS", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
ARROW = {LongType(): pa.int64(), DoubleType(): pa.float64(), StringType(): pa.string(), BinaryType(): pa.binary()}
DECLARED = {LongType(): "INTEGER", DoubleType(): "REAL", StringType(): "TEXT", BinaryType(): "BLOB"}


def _local(path: str) -> str:
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if ":" in path.split("/")[0]:
        raise ValueError(f"SQLite reads files of the file system, not {path}")
    return path


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".db"))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


def _open(file: str) -> sqlite3.Connection:
    from urllib.request import pathname2url

    return sqlite3.connect(f"file:{pathname2url(os.path.abspath(file))}?mode=ro", uri=True)


def _changes(file: str) -> bytes:
    """The file's counter of changes, from its header."""
    with open(file, "rb") as f:
        return f.read(28)[24:]


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type_of(declared: str):
    """Spark's type for a declared one: by SQLite's rules of affinity, but for dates and times, which are kept as text."""
    t = declared.upper()
    if "INT" in t or "BOOL" in t:
        return LongType()
    if any(x in t for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return StringType()
    if "BLOB" in t or not t:
        return BinaryType()
    return DoubleType()


@dataclass
class _Range(ds.InputPartition):
    file: str
    changes: bytes
    row: str | None  # the name that row numbers go by, None where the table has none
    low: int | None
    high: int | None  # first row number beyond the range; ends that are None are open


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.files, self.table, self.schema = _files(_local(options["path"])), options["table"], schema
        self.parts = int(options.get("partitions", 8))
        self.terms: list[str] = []
        self.values: list = []

    def pushFilters(self, filters):
        """Comparisons with a constant, lists, null tests and text that starts with a constant go into the file; others stay with Spark."""
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            made = self._term(f, kinds)
            if made is None:
                yield f
            else:
                self.terms.append(made[0])
                self.values.extend(made[1])

    def _term(self, f, kinds) -> tuple[str, list] | None:
        if isinstance(f, ds.Not):
            inner = self._term(f.child, kinds)
            return inner and (f"NOT ({inner[0]})", inner[1])
        attribute = getattr(f, "attribute", ())
        if len(attribute) != 1 or kinds.get(attribute[0]) not in (LongType(), DoubleType(), StringType()):
            return None
        kind = {LongType(): int, DoubleType(): float, StringType(): str}[kinds[attribute[0]]]
        of = _named(attribute[0]) + (" COLLATE BINARY" if kind is str else "")
        # NaN, which SQLite can't hold, and the zero byte, which ends its text functions' input, stay with Spark
        fits = lambda v: isinstance(v, kind) and not isinstance(v, bool) and v == v and not (kind is str and "\0" in v)
        if isinstance(f, ds.IsNull):
            return f"{of} IS NULL", []
        if isinstance(f, ds.IsNotNull):
            return f"{of} IS NOT NULL", []
        if isinstance(f, ds.In) and all(map(fits, f.value)) and len(f.value) <= 500:
            return f"{of} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if isinstance(f, ds.StringStartsWith) and fits(f.value):
            return f"substr({of}, 1, length(?)) = ?", [f.value, f.value]
        if type(f) in COMPARED and fits(f.value):
            return f"{of} {COMPARED[type(f)]} ?", [f.value]
        return None

    def partitions(self):
        """About ``partitions`` ranges in all, at least one a file; ranges are of equal width, the outer ones open."""
        out, each = [], max(1, -(-self.parts // max(len(self.files), 1)))
        for file in self.files:
            with _open(file) as con:
                changes, row = _changes(file), _row_name(con, self.table)
                low, high = con.execute(f"SELECT min({row}), max({row}) FROM {_named(self.table)}").fetchone() if row else (None, None)
            con.close()
            n = min(each, high - low + 1) if low is not None else 1
            cuts = [None, *(low + (high - low + 1) * i // n for i in range(1, n)), None]
            out += [_Range(file, changes, row, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out or [_Range("", b"", None, None, None)]

    def read(self, part: _Range):
        if not part.file:
            return
        terms, values = list(self.terms), list(self.values)
        for bound, sign in ((part.low, ">="), (part.high, "<")):
            if bound is not None:
                terms.append(f"{part.row} {sign} ?")
                values.append(bound)
        names, kinds = self.schema.names, [ARROW[f.dataType] for f in self.schema.fields]
        if _changes(part.file) != part.changes:
            raise RuntimeError(f"{part.file} has changed since the query was planned; read it anew")
        con = _open(part.file)
        found = con.execute(f"SELECT {', '.join(map(_named, names)) or '1'} FROM {_named(self.table)}" + (f" WHERE {' AND '.join(terms)}" if terms else ""), values)
        while rows := found.fetchmany(BATCH):
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)
        con.close()


def _row_name(con: sqlite3.Connection, table: str) -> str | None:
    """A name of the table's row numbers that no column hides; None for views and tables without row numbers."""
    kind = con.execute("SELECT type FROM sqlite_master WHERE name = ? COLLATE NOCASE", [table]).fetchone()
    if kind is None or kind[0] != "table":
        return None
    taken = {r[1].lower() for r in con.execute(f"PRAGMA table_xinfo({_named(table)})")}
    for name in ("rowid", "_rowid_", "oid"):
        if name not in taken:
            try:
                con.execute(f"SELECT {name} FROM {_named(table)} LIMIT 0")
                return name
            except sqlite3.OperationalError:
                return None
    return None


@dataclass
class _Written(ds.WriterCommitMessage):
    names: list


class _Writer(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = _local(options["path"]), options["table"], schema, overwrite
        if lacking := [f.name for f in schema.fields if f.dataType not in DECLARED]:
            raise ValueError(f"columns must be long, double, string or binary: {', '.join(lacking)}")

    def write(self, iterator):
        """One file a task, under a name that no reader takes until all tasks are done."""
        os.makedirs(self.path, exist_ok=True)
        name = f"{uuid.uuid4().hex}.tmp"
        con = sqlite3.connect(os.path.join(self.path, name))
        con.execute(f"CREATE TABLE {_named(self.table)} ({', '.join(f'{_named(f.name)} {DECLARED[f.dataType]}' for f in self.schema.fields)})")
        for batch in iterator:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            con.executemany(f"INSERT INTO {_named(self.table)} VALUES ({', '.join('?' * batch.num_columns)})", rows)
        con.commit()
        con.close()
        return _Written([name])

    def commit(self, messages):
        old = _files(self.path) if self.overwrite and os.path.isdir(self.path) else []
        for m in messages:
            for name in m.names if m else []:
                os.rename(os.path.join(self.path, name), os.path.join(self.path, name.removesuffix(".tmp") + ".db"))
        for file in old:
            os.remove(file)

    def abort(self, messages):
        for m in messages:
            for name in m.names if m else []:
                os.remove(os.path.join(self.path, name))


class SQLiteSource(ds.DataSource):
    """Format ``sqlite`` with the options path, table and, to read, partitions."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self) -> StructType:
        files = _files(_local(self.options["path"]))
        if not files:
            raise FileNotFoundError(f"no *.db in {self.options['path']}")
        con = _open(files[0])
        found = con.execute(f"PRAGMA table_info({_named(self.options['table'])})").fetchall()
        con.close()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {files[0]}")
        return StructType([StructField(r[1], _type_of(r[2] or "")) for r in found])

    def reader(self, schema: StructType):
        if odd := [f.name for f in schema.fields if f.dataType not in ARROW]:
            raise ValueError(f"columns must be long, double, string or binary: {', '.join(odd)}")
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(self.options, schema, overwrite)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, partitions: int = 8) -> DataFrame:
    """Rows of a table or view of a SQLite file, or of all files of a folder.

    ``columns`` are the ones that are read; the others don't leave the file. Tables have a task for each range of
    row numbers, views and tables without row numbers one for each file. Gaps in row numbers make tasks uneven, but
    none holds more than a batch of rows. A value that the column's declared type doesn't fit raises; one that
    a pushed filter leaves out is not looked at. A file that changes between planning and reading raises. An
    absent file or table raises, an empty table has no rows.
    """
    spark.dataSource.register(SQLiteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("table", table).option("partitions", partitions)
    if columns is not None:
        whole = SQLiteSource({"path": path, "table": table}).schema()
        reader = reader.schema(StructType([whole[c] for c in columns]))
    return reader.load(path)


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """``df`` (long, double, string and binary columns) as files of a folder, one a task; what tasks leave that fail is not read.

    ``overwrite`` replaces the folder's files once all new ones are there. NaN becomes null, as SQLite has none.
    """
    df.sparkSession.dataSource.register(SQLiteSource)
    df.write.format("sqlite").mode(mode).option("table", table).save(path)
