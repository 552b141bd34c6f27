"""Near-duplicate detection by a chosen-path set similarity join.

Documents with equal shingle sets form a class with one representative. In each of several independent
trees, documents with the same minimum at the tree's own position share a node, and a node that is too large
to be compared in one task is divided: it chooses positions itself, 1 / threshold of them on average and a
little more, and its documents go to a child for the minimum of each. So a pair at the threshold is expected
to stay together in one child of each node or more, however deep the tree gets. Links are found twice: first
each member of a root is held against one member that its node draws, then every node that still holds more
than one component is compared whole. All links are confirmed on full sets, and documents that links connect
are one group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .hashing import M, Words, chunks, mix
from .packing import ranges, trim
from .shared import components, join_groups, semi_by_id, written

N_MINIMA = 256  # a bit of each is kept
BITS = [f"b{i}" for i in range(N_MINIMA // 64)]
N_PATH = 64  # of which so many are kept whole, to choose paths by
CHOICE = 4  # positions among which a node of one level chooses
CELL = 2048  # members of a node that are compared in one task
WHOLE = 4 * CELL  # members of a node that is compared whole instead of divided
CELL_ITEMS = 1 << 21  # shingles of these, so that long texts are compared in smaller cells
LEVELS = 16  # of nodes; what is larger than that even then is compared whole, cell by cell
SALT = 512  # pairs of one document that are confirmed in one task
FREQUENT = 48  # an item in more members of a cell is compared by a matrix product
PAIRS = 1 << 20  # pairs of sketches that are compared at once


def shingle_sets(texts: list[bytes], words: Words, k: int) -> list[np.ndarray]:
    """Sorted names of each text's distinct k-word shingles; of all its words if it has fewer; empty without words."""
    names, counts = words(texts)
    whole = np.zeros(max(0, len(names) - k + 1), np.uint64)
    for i in range(k):
        whole = mix(whole * M + names[i : len(names) - k + 1 + i])
    out, a = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(whole[a : a + n - k + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for i in range(n):
                x = mix(x * M + names[a + i : a + i + 1] + np.uint64(1))
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
        a += n
    return out


def _factors() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * N_MINIMA + 1, dtype=np.uint64) * M)
    return (x[:N_MINIMA] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[N_MINIMA:] >> np.uint64(32)).astype(np.uint32)


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(N_MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):  # long texts in pieces
        np.minimum(out, (x[i : i + 2048, None] * a + b).min(axis=0), out=out)
    return out


def _sketches(k: int, id_type):
    def run(batches):
        words, (a, b) = Words(), _factors()
        names = ["id", "n", "s1", "s2", *BITS, "path"]
        for ids, texts in chunks(batches):
            n, s1, s2, bits, path = [], [], [], [], []
            for s in shingle_sets(texts, words, k):
                n.append(len(s))
                s1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix(s ^ M).sum(dtype=np.uint64).view(np.int64)))
                m = _minima(s, a, b)
                x = m * np.uint32(0x9E3779B1)
                bits.append(np.packbits((x >> np.uint32(31)).astype(np.uint8)).view(np.int64).tolist())
                path.append(m[:N_PATH].view(np.int32).tolist())
            cols = [pa.array(ids, id_type), pa.array(n, pa.int64()), *(pa.array(c, pa.int64()) for c in (s1, s2, *zip(*bits, strict=True))), pa.array(path, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        trim()

    return run


def _full_sets(k: int, id_type):
    def run(batches):
        words = Words()
        for ids, texts in chunks(batches):
            sets = [s.tobytes() for s in shingle_sets(texts, words, k)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sets, pa.binary())], names=["id", "items"])
        trim()

    return run


def _confirm(percent: int, id_type):
    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


class Linker:
    """Confirms written, distinct pairs of ids on full sets, made from the texts of the ids that pairs name."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        self.kind, self.id_type = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)

    def sets(self, ids: DataFrame) -> DataFrame:
        """The full set of each of the distinct ids."""
        texts = semi_by_id(self.docs.select("id", "text"), ids, "id")
        return written(texts.mapInArrow(_full_sets(self.k, self.id_type), f"id {self.kind}, items binary").dropDuplicates(["id"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that are similar. A document that is ``a`` of many pairs meets them in many tasks."""
        ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
        sets = self.sets(ids)
        times = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
        pairs = pairs.join(times, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts")).select("a", "b", "salt")
        heads = sets.select(F.col("id").alias("a"), F.col("items").alias("x")).join(times, "a")
        heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("a", "salt", "x")
        met = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")).hint("merge"), "b").join(heads.hint("merge"), ["a", "salt"])
        return written(met.select("a", "b", "x", "y").mapInArrow(_confirm(self.percent, self.id_type), f"a {self.kind}, b {self.kind}"), "links")


def most_bits_apart(percent: int) -> int:
    """Bits in which two sketches of similar sets differ at most, five standard deviations beyond the mean."""
    p = (1 - percent / 100) / 2
    return math.ceil(N_MINIMA * p + 5 * math.sqrt(N_MINIMA * p * (1 - p)))


def _children(nodes: DataFrame, level: int, trees: int, percent: int) -> DataFrame:
    """A node's documents by their minima at the positions that the node chooses, other ones at each level.

    The first position is always used and the second so often that a pair at the threshold meets in 1.1
    children of a node where it met, on average.
    """
    groups = (N_PATH - trees) // CHOICE
    base = trees + CHOICE * F.pmod(F.col("tree") * 5 + level, F.lit(groups))
    chance = lambda i, n: F.pmod(F.xxhash64("node", F.lit(level), F.lit(i)), F.lit(n))
    first = chance(0, CHOICE)
    at = [base + first, base + F.pmod(first + 1 + chance(1, CHOICE - 1), F.lit(CHOICE))]
    child = [F.xxhash64("node", p, F.element_at("path", (p + 1).cast("int"))) for p in at]
    both = chance(2, 1000) < int(1000 * (1.1 * 100 / percent - 1))
    return nodes.withColumn("node", F.explode(F.when(both, F.array(*child)).otherwise(F.array(child[0]))))


def _whole(batches):
    """Arrow tables in which no cell is cut; cells are the first column, by which rows are sorted."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0).to_numpy()
        cut = int(np.searchsorted(cells, cells[-1]))
        if cut or held and held[-1].column(0)[-1].as_py() != cells[0]:
            done = [*held, batch.slice(0, cut)]
            yield pa.Table.from_batches(done).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values by equal numbers."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _ends(cells: np.ndarray) -> np.ndarray:
    """Past the end of the run of equal cells that each row is in."""
    edges = np.concatenate((np.flatnonzero(np.diff(cells)) + 1, [len(cells)]))
    return np.repeat(edges, np.diff(edges, prepend=0))


def _partners(percent: int):
    """Members of a cell with another of another component whose sketch is near enough."""
    limit = most_bits_apart(percent)

    def run(batches):
        for t in _whole(batches):
            cells, n, own = t["cell"].to_numpy(), t["n"].to_numpy(), _codes(t["own"])
            block, apart = t["block"].to_numpy(), t["apart"].to_numpy()
            bits = np.stack([t[b].to_numpy().view(np.uint64) for b in BITS])
            row = np.arange(len(cells))
            later = _ends(cells) - row - 1
            done, near = np.cumsum(later), np.zeros(len(cells), bool)
            start = 0
            while start < len(row):
                stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + PAIRS, "right")))
                i, j = np.repeat(row[start:stop], later[start:stop]), ranges(row[start:stop] + 1, later[start:stop])
                ok = (own[i] != own[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (~apart[i] | (block[i] != block[j]))
                i, j = i[ok], j[ok]
                far = np.zeros(len(i), np.uint16)
                for b in bits:
                    far += np.bitwise_count(b[i] ^ b[j])
                met = far <= limit
                near[i[met]] = near[j[met]] = True
                start = stop
            out = t.filter(pa.array(near)).select(["cell", "id", "own", "block", "apart"])
            yield from out.to_batches()
        trim()

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two sets share (above the diagonal): frequent items by a matrix product, rare ones pair by pair."""
    m = len(sets)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), np.fromiter(map(len, sets), np.int64, m))
    out = np.zeros((m, m), np.float32)
    often = np.flatnonzero(times > FREQUENT)
    column = np.full(len(times), -1, np.int64)
    column[often] = np.arange(len(often))
    for a in range(0, len(often), 1024):
        at = column[code] - a
        here = (at >= 0) & (at < 1024)
        x = np.zeros((m, min(1024, len(often) - a)), np.float32)
        x[row[here], at[here]] = 1
        out += x @ x.T
    rare = (times[code] > 1) & (times[code] <= FREQUENT)
    order = np.argsort(code[rare], kind="stable")
    code, row = code[rare][order], row[rare][order]
    if len(code):
        later = _ends(code) - np.arange(len(code)) - 1
        for a in range(0, len(code), PAIRS // FREQUENT):
            at = np.arange(a, min(len(code), a + PAIRS // FREQUENT))
            np.add.at(out, (np.repeat(row[at], later[at]), row[ranges(at + 1, later[at])]), 1)
    return out


def spanning(sets: list[np.ndarray], own: np.ndarray, block: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links between the sets, by number, that connect what similar pairs connect and ``own`` doesn't yet.

    With ``block``, only pairs of different blocks are compared.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    common, group, out = _common(sets), own.copy(), []
    for i in range(len(sets) - 1):
        both = common[i, i + 1 :]
        ok = (100 * both >= percent * (n[i] + n[i + 1 :] - both)) & (group[i + 1 :] != group[i])
        if block is not None:
            ok &= block[i + 1 :] != block[i]
        met = np.flatnonzero(ok) + i + 1
        if len(met):
            joined, first = np.unique(group[met], return_index=True)
            out += [(i, j) for j in met[first].tolist()]
            group[np.isin(group, joined)] = group[i]
    return out


def _linked(percent: int, id_type):
    """Links between members of a cell, confirmed on their full sets; one for each two components that they connect."""

    def run(batches):
        for t in _whole(batches):
            cells, own = t["cell"].to_numpy(), _codes(t["own"])
            block, apart, ids, items = t["block"].to_numpy(), t["apart"].to_numpy(), t["id"], t["items"]
            a, left, right = 0, [], []
            ends = _ends(cells)
            while a < len(cells):
                b = int(ends[a])
                sets = [np.frombuffer(items[i].as_buffer(), np.uint64) for i in range(a, b)]
                for i, j in spanning(sets, own[a:b], block[a:b] if apart[a] else None, percent):
                    left.append(a + i)
                    right.append(a + j)
                a = b
            x, y = (pa.array(ids.take(pa.array(at, pa.int64())).to_pylist(), id_type) for at in (left, right))
            yield pa.RecordBatch.from_arrays([x, y], names=["a", "b"])
        trim()

    return run


def _apart(nodes: DataFrame, total: int) -> DataFrame:
    """Members of nodes that hold several components, with the node's number of members and of their shingles."""
    sizes = nodes.groupBy("node").agg(F.min("own").alias("x"), F.max("own").alias("y"), F.count("*").alias("members"), F.sum("n").alias("items"))
    sizes = written(sizes.filter("x <> y").drop("x", "y"), "sizes")
    return written(join_groups(nodes, sizes, ["node"], "members", total), "apart")


def _cells(leaves: DataFrame) -> DataFrame:
    """Members of nodes by cells that a task compares whole: a node, or two of its blocks where it takes several."""
    blocks = F.greatest(F.ceil(F.col("members") / CELL), F.ceil(F.col("items") / CELL_ITEMS))
    leaves = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), "blocks"))
    leaves = leaves.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return leaves.select(F.xxhash64("node", low, high).alias("cell"), "id", "n", "own", "block", (low != high).alias("apart"), *BITS)


def _sorted(cells: DataFrame) -> DataFrame:
    return cells.repartition("cell").sortWithinPartitions("cell")


def near_groups(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", trees: int = 12) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).

    Words are runs of other than ASCII white space with A-Z lower-cased; a document's set is its distinct
    ``k``-word shingles, with fewer words the whole sequence as one. Sets are linked if 100 times their
    intersection is at least ``percent`` times their union. Texts that are null, empty or white have an
    empty set and link with nothing. Rows that repeat an id must repeat its text; they are in one group and
    marked alike. Rows without id are grouped by equal sets only. Very long texts are compared whole. Other
    columns are ignored; an empty table gives no rows.

    A pair at the threshold shares a root with a chance of ``percent`` / 100 in each of ``trees`` trees. Nodes
    of up to ``WHOLE`` documents are compared whole, in cells, and only larger ones are divided, in such a way that the
    pair stays together with a chance that does not fall to nothing with the depth.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = to_arrow_type(docs.schema["id"].dataType)
    rows = written(docs.mapInArrow(_sketches(k, id_type), f"id {kind}, n long, s1 long, s2 long, {', '.join(f'{b} long' for b in BITS)}, path array<int>"), "sketches")
    key = ["n", "s1", "s2"]
    classes = written(rows.filter("n > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    reps = rows.filter("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    reps = written(reps.select("id", "n", *BITS, "path"), "reps")
    total = trees * reps.count()

    nodes = reps.select("id", "n", *BITS, "path", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    nodes = nodes.withColumn("node", F.xxhash64(F.lit("tree"), "tree", F.element_at("path", F.col("tree") + 1))).drop("path")
    drawn = F.min(F.struct(F.xxhash64("node", "id").alias("order"), "id", "n", *BITS)).alias("head")
    heads = written(nodes.groupBy("node").agg(F.count("*").alias("size"), drawn).filter("size > 1"), "heads")
    members = written(join_groups(nodes, heads, ["node"], "size", total), "nodes")
    alike = F.expr(" + ".join(f"bit_count({b} ^ head.{b})" for b in BITS)) <= most_bits_apart(percent)
    alike &= 100 * F.least("n", "head.n") >= percent * F.greatest("n", "head.n")  # else the sets can't be alike enough
    linker = Linker(docs, k, percent)
    stars = members.filter((F.col("id") != F.col("head.id")) & alike).select(F.col("head.id").alias("a"), F.col("id").alias("b"))
    group = written(components(linker.links(written(stars.distinct(), "stars"))), "components")

    # What is in one component needs no further link: only members of different components are compared.
    own = group.withColumnRenamed("component", "own")
    nodes = members.select("id", "n", *BITS, "tree", "node").join(own, "id", "left").withColumn("own", F.coalesce("own", "id"))
    found = []
    for level in range(1, LEVELS + 1):
        apart = _apart(nodes, total)
        small = (F.col("members") <= WHOLE) | F.lit(level == LEVELS)
        found.append(written(_sorted(_cells(apart.filter(small))).mapInArrow(_partners(percent), f"cell long, id {kind}, own {kind}, block long, apart boolean"), "partners"))
        large = apart.filter(~small).drop("members", "items")
        if level == LEVELS or large.isEmpty():
            break
        if level == 1:  # from here on, members are few enough to carry their paths
            large = large.join(reps.select("id", "path"), "id")
        nodes = _children(large, level, trees, percent)
    found = _all(found)
    sets = linker.sets(written(found.select("id").distinct(), "ids"))
    links = written(_sorted(found.join(sets, "id")).select("cell", "id", "own", "block", "apart", "items").mapInArrow(_linked(percent, id_type), f"a {kind}, b {kind}"), "links")
    group = components(group.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))

    classes = classes.join(group.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*key, "size", F.coalesce("component", "rep").alias("component"))
    full = rows.filter("n > 0").select("id", *key)
    out = join_groups(full, written(classes, "groups"), key, "size", rows.count()).select("id", "n", "component")
    out = out.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3
    THEN list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2]))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY 1, 2
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id, doc_id AS reach FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reach) AS component_id, d.doc_id = min(r.reach) AS kept
FROM documents AS d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
GROUP BY d.doc_id
"""
