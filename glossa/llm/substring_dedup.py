"""Removal of repeated byte strings by prefix doubling.

A position's rank for a prefix length is a name of the string that begins there, and the rank for a doubled
length is made of the ranks at the position and at the offset. Ranks are doubled inside each text. Spark
brings the (rank, position) pairs of three lengths together, to tell which ranks are unique: a quarter of the
threshold, twice the threshold, and the threshold itself. Positions with a unique rank drop out in between.
Two devices keep the number of pairs small without changing the result. Below the threshold, only the least
rank in each stretch as long as the rest of the threshold stands for the positions that it covers: a string
of the threshold's length that occurs twice has the same least rank in both places, so what has a unique one
is settled. Past the threshold, ranks are sampled in the same way, and a repeated one settles all positions
whose string lies inside, of which one occurrence stays open for others to meet. What is left goes through
the length of the threshold itself, position by position.

Ranks are names, not numbers in a total order, as only their equality matters here. What settles a position
as repeated has 96 bits or more: a name of 64 bits and a check of the bytes by another hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .hashing import BASE, BASE_INVERSE, M, TABLE, mix, powers
from .packing import ASKED, asked, n_parts, pack, trim, unpack, unpack_sorted
from .shared import fresh_path, join_groups, semi_by_id, written

CHUNK = 1 << 20
OTHER = mix(TABLE)
SPAN, DUP = 0, 1  # what a sample settles: positions that may be repeated if it is, positions that are
KEPT_POWERS = {b: powers(b, 1 << 17) for b in (BASE, BASE_INVERSE)}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Those of most texts are there already."""
    return KEPT_POWERS[base][:n] if n <= 1 << 17 else powers(base, n)


class Ranks:
    """Names of the strings of a length at each position of a buffer, doubled from a first short length."""

    def __init__(self, buf: np.ndarray, first: int = 25):
        n = len(buf)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[buf] * _powers(BASE, n), out=sums[1:])
        there = max(0, n - first + 1)
        self.names, self.n = {first: mix((sums[first:] - sums[:-first][:there]) * _powers(BASE_INVERSE, there))} if there else {first: np.zeros(0, np.uint64)}, n
        self.first = first

    def of(self, length: int) -> np.ndarray:
        """Names for ``length``, which is ``first`` times a power of two, or up to twice a smaller one."""
        if length not in self.names:
            half = self.first
            while half * 2 < length:
                half *= 2
            x, offset = self.of(half), length - half
            there = max(0, self.n - length + 1)
            self.names[length] = mix(x[:there] * M + x[offset : offset + there])
        return self.names[length]


def _least(names: np.ndarray, width: int) -> np.ndarray:
    """Of each stretch of ``width`` positions, that with the least name; the leftmost of equal ones."""
    low = np.uint64((1 << 24) - 1)
    at = np.arange(len(names), dtype=np.uint64)
    x, done = (names & ~low) | (at & low), 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    start = at[: len(x)]
    return (start + (((x & low) - start) & low)).astype(np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    edges = np.flatnonzero(np.diff(x)) + 1
    return np.concatenate(([0], edges)), np.concatenate((edges, [len(x)])) - 1


def _samples(text: bytes, threshold: int):
    """(kind, name, check, from, to) of a text's samples; those that settle nothing as repeated have no check."""
    n = len(text)
    if n < threshold:
        return []
    ranks, short, long = Ranks(np.frombuffer(text, np.uint8)), threshold // 4, 2 * threshold
    names = ranks.of(short)
    least = _least(names, threshold - short + 1)
    a, b = _runs(least)
    out = [(SPAN, names[least[a]], np.zeros(len(a), np.uint64), a, b)]
    if n < long:
        whole = mix(ranks.of(threshold)[:1] * M + ranks.of(threshold)[-1:] + np.uint64(n))
        out.append((DUP, whole, _checks(text, [0], n), np.zeros(1, np.int64), np.full(1, n - threshold)))
    else:
        names, q = ranks.of(long), [0, n - long]
        if n >= long + threshold:
            q += np.unique(_least(names, threshold + 1)).tolist()
        q = np.unique(np.array(q, np.int64))
        out.append((DUP, names[q], _checks(text, q.tolist(), long), q, q + long - threshold))
    return out


def _checks(text: bytes, starts: list[int], length: int) -> np.ndarray:
    """Hashes of the bytes themselves, which share nothing with names."""
    return np.fromiter((xxhash.xxh3_64_intdigest(text[a : a + length]) for a in starts), np.uint64, len(starts))


def _emit(threshold: int):
    def run(batches):
        schema = pa.schema([("doc", pa.int64()), ("kind", pa.int32()), ("name", pa.int64()), ("check", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            size = 0
            for i in range(batch.num_rows):
                doc = batch.column(0)[i].as_py()
                for kind, names, check, a, b in _samples(batch.column(1)[i].as_buffer().to_pybytes(), threshold):
                    k = len(names)
                    size += k
                    for x, v in zip(rows, (np.full(k, doc), np.full(k, kind, np.int32), names.view(np.int64), check.view(np.int64), a.astype(np.int32), b.astype(np.int32)), strict=True):
                        x.append(v)
                if size > 50_000 or i + 1 == batch.num_rows and size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], schema=schema)
                    rows, size = [[], [], [], [], [], []], 0
        trim()

    return run


def _mask(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions inside any of the spans from ``a`` to ``b``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, a, 1)
    np.add.at(d, b + 1, -1)
    return np.cumsum(d[:n]) > 0


def _spans(mask: np.ndarray) -> np.ndarray:
    """(from, past the end) of each run of set positions."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges.reshape(-1, 2)


def _columns(lists: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Where each list of samples begins and the last one ends, then columns of the samples of all lists."""
    flat = lists.flatten()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return ends, *(flat.field(c).to_numpy(zero_copy_only=False) for c in names)


def _needed(batches):
    """Names of repeated short samples that stand for a position which no repeated long one settles, and how often they occur."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends, kind, name, n, a, b = _columns(batch.column(0), "kind", "name", "n", "a", "b")
        sizes = np.maximum.reduceat(b, ends[:-1]).astype(np.int64) + 2
        of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        start, done = np.cumsum(sizes) - sizes, 0
        while done < batch.num_rows:  # documents one after the other, some at once
            last = max(done + 1, int(np.searchsorted(start, start[done] + CHUNK)))
            i, j = ends[done], ends[last]
            base = start[of[i:j]] - start[done]
            x, y, dup = base + a[i:j], base + b[i:j], kind[i:j] == DUP
            settled = np.concatenate(([0], np.cumsum(_mask(int(sizes[done:last].sum()), x[dup], y[dup]))))
            needed = ~dup & (settled[y + 1] - settled[x] <= y - x)
            yield pa.RecordBatch.from_arrays([pa.array(c[i:j][needed], pa.int64()) for c in (name, n)], names=["name", "n"])
            done = last
    trim()


class Open:
    """A block's positions that the samples leave open, by document, with the names of their strings.

    Of the occurrences of a repeated long sample, the first stays open to be met by others; it is repeated
    whatever they are.
    """

    def __init__(self, block: pa.RecordBatch, threshold: int):
        self.texts, self.dups, self.open = block.column("texts").flatten().to_pylist(), [], []
        ends, kind, use, a, b = _columns(block.column("found").flatten(), "kind", "use", "a", "b")
        dups, again, spans = kind == DUP, (kind == DUP) & (use == 0), (kind == SPAN) & (use > 0)
        names, checks = [], []
        for text, i, j in zip(self.texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            n = len(text) - threshold + 1
            dup, settled, span = (_mask(n, a[i:j][x[i:j]], b[i:j][x[i:j]]) for x in (dups, again, spans))
            at = np.flatnonzero(span & ~settled)
            self.dups.append(dup)
            self.open.append(at)
            if len(at):
                buf = np.frombuffer(text, np.uint8)
                names.append(Ranks(buf).of(threshold)[at])
                checks.append(_second(buf, at, threshold))
        none = np.zeros(0, np.uint64)
        self.names, self.checks, self.of = _distinct(np.concatenate([none, *names]), np.concatenate([none, *checks]))
        self.times = np.bincount(self.of, minlength=len(self.names))


def _second(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """32 bits of another hash of the strings that begin at some positions."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(OTHER[buf] * _powers(BASE, len(buf)), out=sums[1:])
    return mix((sums[at + length] - sums[at]) * _powers(BASE_INVERSE, len(buf))[at]) >> np.uint64(32)


def _distinct(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of name and check, sorted, and which of them each pair is."""
    order = np.argsort(names)
    x, y = names[order], checks[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():  # hardly ever has a name two checks
        order = np.lexsort((checks, names))
        x, y = names[order], checks[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    of = np.empty(len(x), np.int64)
    of[order] = np.cumsum(new) - 1
    return x[new], y[new], of


def _meet(table: pa.Table) -> pa.Table:
    """How often each pair of name and check that a part was asked for occurs, for each payload."""
    rows = table.to_pylist()
    keys, times, checks = ([f(r[c]) for r in rows] for f, c in ((unpack_sorted, "keys"), (lambda x: unpack(x, np.uint32), "a"), (lambda x: unpack(x, np.uint32), "b")))
    _, _, of = _distinct(np.concatenate(keys), np.concatenate(checks))
    totals_of = np.bincount(of, weights=np.concatenate(times)).astype(np.uint64)[of]
    out, done = [], 0
    for r, k in zip(rows, keys, strict=True):
        out.append({"part": r["part"], "block": r["block"], "a": pack(totals_of[done : done + len(k)])})
        done += len(k)
    trim()
    return pa.Table.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("a", pa.binary())]))


def _ask(parts: int, threshold: int):
    def run(batches):
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x = Open(row, threshold)
                yield pa.RecordBatch.from_pylist(list(asked(row.column("block")[0].as_py(), x.names, np.minimum(x.times, 2), x.checks, parts)), schema=schema)
                del x
                trim()

    return run


def _gather(limit: int, id_type):
    """Blocks of documents with repeated samples."""

    def run(batches):
        sample = pa.list_(pa.struct([("kind", pa.int32()), ("use", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("texts", pa.list_(pa.binary())), ("found", pa.list_(sample))])
        base, k, size, parts = TaskContext.get().partitionId() << 32, 0, 0, []

        def block():
            whole = [pa.concat_arrays([p.column(c) for p in parts]) for c in range(3)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole]
            return pa.RecordBatch.from_arrays([pa.array([base + k]), *(x.cast(f.type) for x, f in zip(lists, list(schema)[1:], strict=True))], schema=schema)

        for batch in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist(), 1):
                size += n
                if size >= limit:
                    parts.append(batch.slice(start, i - start))
                    yield block()
                    k, size, parts, start = k + 1, 0, [], i
            if start < batch.num_rows:
                parts.append(batch.slice(start))
        if parts:
            yield block()
        trim()

    return run


RESULT = "n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>, kept binary"


def _cut(threshold: int, id_type):
    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        schema = pa.schema([("id", id_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x = Open(row, threshold)
                got = [unpack(r["a"], np.uint64) for r in sorted(row.column("answers")[0].as_py() or [], key=lambda r: r["part"])]
                again = (np.concatenate(got) > 1)[x.of] if got else np.zeros(0, bool)
                done, every, n_removed, left = 0, [], [], []
                for text, dup, at in zip(x.texts, x.dups, x.open, strict=True):
                    dup[at[again[done : done + len(at)]]] = True
                    done += len(at)
                    starts = _spans(dup)
                    gone = _spans(_mask(len(text), starts[:, 0], starts[:, 1] + threshold - 2))
                    ends = [0, *gone.reshape(-1).tolist(), len(text)]
                    left.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                    n_removed.append(len(text) - len(left[-1]))
                    every.append(gone)
                runs = np.concatenate(every).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(runs[:, 0]), pa.array(runs[:, 1])], ["start", "stop"])
                runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, every)]).astype(np.int32)), runs)
                columns = [row.column("ids").flatten().cast(id_type), pa.array(list(map(len, x.texts)), pa.int64()), pa.array(n_removed, pa.int64()), runs.cast(span), pa.array(left, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                del x
                trim()

    return run


def remove_repeats(docs: DataFrame, threshold: int = 400, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans (removed runs, from start to before stop), kept (the bytes left).

    Each byte of the text in UTF-8 goes that is inside a string of ``threshold`` bytes which also starts
    anywhere else, in the same document or another; strings are judged on the input. Null and empty texts
    have no bytes. Rows that repeat id and text are documents of their own, and so repeat each other. Null
    ids are kept; other columns are ignored; an empty table gives no rows. Strings are held to be equal if
    96 bits of two hashes of them are.
    """
    if threshold % 4:
        raise ValueError("the threshold must be a multiple of 4")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = written(rows.withColumn("doc", F.monotonically_increasing_id()), "texts")
    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)
    long = rows.filter(F.octet_length("text") >= threshold)
    samples = written(long.select("doc", "text").mapInArrow(_emit(threshold), "doc long, kind int, name long, check long, a int, b int"), "samples")
    key = ["kind", "name", "check"]
    again = written(samples.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc").alias("first")).filter("n > 1"), "again")
    total = again.agg(F.sum("n")).first()[0] or 0
    rep = written(join_groups(samples, again, key, "n", total).drop("check"), "repeated")
    by_doc = rep.groupBy("doc").agg(F.collect_list(F.struct("kind", "name", "n", "a", "b")).alias("found")).select("found")
    needed = written(by_doc.mapInArrow(_needed, "name long, n long").distinct(), "needed")
    span = rep.filter(F.col("kind") == SPAN).select("doc", "name", "kind", "a", "b")
    span = join_groups(span, needed, ["name"], "n", total).select("doc", "kind", F.lit(1).alias("use"), "a", "b")
    dup = rep.filter(F.col("kind") == DUP).select("doc", "kind", (F.col("doc") == F.col("first")).cast("int").alias("use"), "a", "b")
    found = span.unionByName(dup).groupBy("doc").agg(F.collect_list(F.struct("kind", "use", "a", "b")).alias("found"))
    found = written(found, "found")
    live = semi_by_id(long, found.select("doc"), "doc")
    path = fresh_path(spark, "live")
    table = path.rpartition("/")[2].replace("-", "_")
    blocks = live.join(found, "doc").select("id", "text", "found").mapInArrow(_gather(block_bytes, id_type), f"block long, ids array<{kind.simpleString()}>, texts array<binary>, found array<array<struct<kind:int,use:int,a:int,b:int>>>")
    blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).format("parquet").saveAsTable(table)
    blocks = spark.table(table)
    size = blocks.agg(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t)))).first()[0] or 0
    parts = n_parts(4 * size)
    asks = blocks.mapInArrow(_ask(parts, threshold), ASKED)
    answers = asks.repartition(min(parts, 20_000), "part").groupBy("part").applyInArrow(_meet, "part int, block long, a binary")
    own = answers.select("block", F.struct("part", "a").alias("x")).groupBy("block").agg(F.collect_list("x").alias("answers"))
    cut = blocks.join(own.hint("merge"), "block", "left").mapInArrow(_cut(threshold, id_type), f"id {kind.simpleString()}, {RESULT}")
    rest = rows.join(_ids(found), "doc", "left_anti")
    rest = rest.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"), F.col("text").alias("kept"))
    return cut.unionByName(rest).withColumnRenamed("id", id_col)


def _ids(found: DataFrame) -> DataFrame:
    from .shared import BROADCAST_ROWS

    ids = found.select("doc")
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
