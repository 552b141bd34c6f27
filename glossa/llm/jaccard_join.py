"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets form a class with one representative. The shingles of all sets are put in
one order: by ranges of their names first, in which a short range holds what most documents need, then by how
many documents ask for them, rare ones first. Of two similar sets the first shingles, up to the l-th beyond what
the threshold lets differ, have l in common. Each document chooses its own l: a longer prefix meets more
lists, but requires more shared shingles before a pair is verified. The choice goes by the lengths of the lists.

Pairs meet in the lists of prefix shingles, in cells of bounded size. Three rounds find links, each only between
what the ones before left apart: with the list's head, with the nearest other member, with all members.
Links are confirmed on full sets, and documents that links connect are one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .hashing import M, Words, chunks, mix
from .near_dedup import CELL, PAIRS, Linker, _codes, _ends, _whole, shingle_sets
from .packing import ranges, trim
from .shared import components, join_groups, written

MATCHES = 4  # shared shingles that a document requires at most
RANGES = np.array([3 << 60, 6 << 60, 11 << 60], np.uint64)  # ends of the ranges of names but the last
SPARE = 1.5  # times its longest prefix that a document asks for, so that rare shingles can be told
PARITY = 256  # bits in which the names of a set are added up modulo 2
BITS = [f"b{i}" for i in range(PARITY // 64)]
KEY = ["n", "s1", "s2"]


def probe_overlap(n, percent: int):
    """Shingles that a set of n shares at least with a similar one that isn't larger."""
    return -(-percent * n // 100)


def index_overlap(n, percent: int):
    """Shingles that a set of n shares at least with a similar one that isn't smaller."""
    return -(-2 * percent * n // (100 + percent))


def _sketches(k: int, percent: int, id_type):
    """(id, n, s1, s2, bits, counts, names): a set's size, two sums of names, parity bits, and the names of as many ranges as it asks for."""

    def run(batches):
        words = Words()
        for ids, texts in chunks(batches):
            rows = []
            for s in shingle_sets(texts, words, k):
                n = len(s)
                parity = (np.bincount((mix(s + M) >> np.uint64(56)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
                ends = [*np.searchsorted(s, RANGES).tolist(), n]
                need = SPARE * (n - probe_overlap(n, percent) + MATCHES)
                ranges_asked = next((i + 1 for i, e in enumerate(ends) if e >= need), len(ends))
                counts = np.diff([0, *ends[:ranges_asked]]).tolist()
                sums = [int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in (s, s ^ M)]
                rows.append((n, *sums, *np.packbits(parity).view(np.int64).tolist(), counts, s[: ends[ranges_asked - 1]].view(np.int64)))
            kinds = [pa.int64()] * (3 + len(BITS)) + [pa.list_(pa.int32()), pa.list_(pa.int64())]
            cols = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *cols], names=["id", *KEY, *BITS, "counts", "names"])
        trim()

    return run


def choose(n: int, places: np.ndarray, df: np.ndarray, percent: int) -> int:
    """How many shared shingles a set of n requires: of the numbers up to ``MATCHES`` the one of least estimated cost.

    A posting met costs 1, a verification the more the larger the set. Those who share l postings are at most
    the l-th part of all postings met.
    """
    most = min(MATCHES, probe_overlap(n, percent))
    costs = []
    for matches in range(1, most + 1):
        met = float((df[places < n - probe_overlap(n, percent) + matches] - 1).sum())
        costs.append(met + (4 + n / 16) * met / matches)
    return int(np.argmin(costs)) + 1


def place(counts: np.ndarray, names: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The place in its set's order of each shared name; names that no other set asks for come first in their range."""
    tier = np.searchsorted(RANGES, names, "right")
    order = np.lexsort((names, df, tier))
    shared = np.bincount(tier, minlength=len(counts))
    before = np.concatenate(([0], np.cumsum(counts)[:-1])) + counts - shared  # of what is shared in each range
    rank = np.arange(len(names)) - np.concatenate(([0], np.cumsum(shared)[:-1]))[tier[order]]
    out = np.empty(len(names), np.int64)
    out[order] = before[tier[order]] + rank
    return out


def _prefixes(percent: int):
    """Postings (name, n, matches, probes, level) of each set: the shared shingles of its prefix."""

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n, counts, shared = t["n"].to_pylist(), t["counts"], t["shared"]
            at, cols = [], [[] for _ in range(4)]
            for i in range(len(n)):
                pairs = shared[i].values
                names, df = pairs.field("name").to_numpy().view(np.uint64), pairs.field("df").to_numpy()
                where = place(np.array(counts[i].as_py()), names, df)
                matches = choose(n[i], where, df, percent)
                probes = where < n[i] - probe_overlap(n[i], percent) + matches
                level = np.maximum(where - (n[i] - index_overlap(n[i], percent)) + 1, 1)
                keep = probes | (level <= MATCHES)
                at.append(np.full(keep.sum(), i))
                for c, x in zip(cols, (names.view(np.int64), np.full(len(names), matches, np.int32), probes, level.astype(np.int32)), strict=True):
                    c.append(x[keep])
            rows = t.select(["id", "n", *BITS]).take(pa.array(np.concatenate(at)))
            for name, x in zip(("name", "matches", "probes", "level"), cols, strict=True):
                rows = rows.append_column(name, pa.array(np.concatenate(x)))
            yield from rows.to_batches()

    return run


def _pairs(percent: int, nearest: bool):
    """Pairs (a, b, matches) of a cell's members of different components that this list lets stand and whose parity bits may be near
    enough; a is the larger. With ``nearest``, of each member only the pair of the nearest bits."""

    def run(batches):
        for t in _whole(batches):
            cells, n, own, block, apart = t["cell"].to_numpy(), t["n"].to_numpy(), _codes(t["own"]), t["block"].to_numpy(), t["apart"].to_numpy()
            probes, matches, level = t["probes"].to_numpy(), t["matches"].to_numpy(), t["level"].to_numpy()
            bits = np.stack([t[b].to_numpy().view(np.uint64) for b in BITS])
            row = np.arange(len(cells))
            later = _ends(cells) - row - 1
            done, start, found = np.cumsum(later), 0, []
            while start < len(row):
                stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + PAIRS, "right")))
                i, j = np.repeat(row[start:stop], later[start:stop]), ranges(row[start:stop] + 1, later[start:stop])
                # a cell's members are sorted by size, so that j is the larger
                ok = (own[i] != own[j]) & probes[j] & (level[i] <= matches[j]) & (100 * n[i] >= percent * n[j]) & (~apart[i] | (block[i] != block[j]))
                i, j = i[ok], j[ok]
                far = np.zeros(len(i), np.int64)
                for b in bits:
                    far += np.bitwise_count(b[i] ^ b[j])
                both = n[i] + n[j]
                ok = far <= both - 2 * -(-percent * both // (100 + percent))  # sets differ in as many shingles as bits, or in more
                found.append(np.stack((i[ok], j[ok], far[ok])))
                start = stop
            i, j, far = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            if nearest and len(i):
                first = [np.unique(x[order], return_index=True)[1] for x in (i, j) for order in [np.lexsort((far, x))]]
                keep = np.unique(np.concatenate([np.lexsort((far, x))[f] for x, f in zip((i, j), first, strict=True)]))
                i, j = i[keep], j[keep]
            out = [t["id"].take(pa.array(j)), t["id"].take(pa.array(i)), pa.chunked_array([pa.array(matches[j])])]
            yield from pa.Table.from_arrays(out, names=["a", "b", "matches"]).to_batches()
        trim()

    return run


def _shared_enough(pairs: DataFrame) -> DataFrame:
    """Of a row for each shared posting (a, b, matches) the pairs that share as many as are required."""
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("matches").alias("matches"))
    return written(pairs.filter("shared >= matches").select("a", "b"), "pairs")


def _with_heads(postings: DataFrame, total: int, percent: int) -> DataFrame:
    """Pairs of each list's members with its head, the same member wherever it occurs in many lists."""
    head = F.min(F.struct(F.xxhash64("id").alias("order"), "id", "n", "matches", "probes", "level", *BITS)).alias("head")
    heads = written(postings.groupBy("name").agg(F.count("*").alias("size"), head).filter("size > 1"), "heads")
    met = join_groups(postings, heads, ["name"], "size", total).filter(F.col("id") != F.col("head.id"))
    larger = F.struct("n", "id") > F.struct("head.n", "head.id")
    pick = lambda c, big: F.when(larger == big, F.col(c)).otherwise(F.col(f"head.{c}"))
    both, far = F.col("n") + F.col("head.n"), F.expr(" + ".join(f"bit_count({b} ^ head.{b})" for b in BITS))
    ok = pick("probes", True) & (pick("level", False) <= pick("matches", True)) & (100 * pick("n", False) >= percent * pick("n", True))
    ok &= far <= both - 2 * F.ceil(percent * both / (100 + percent))
    return met.filter(ok).select(pick("id", True).alias("a"), pick("id", False).alias("b"), pick("matches", True).alias("matches"))


def _within_lists(postings: DataFrame, group: DataFrame, total: int, percent: int, nearest: bool, kind: str) -> DataFrame:
    """Pairs of lists that hold several components, compared in cells: a list, or two of its blocks where it takes several."""
    own = group.withColumnRenamed("component", "own")
    rows = written(postings.join(own.hint("merge"), "id", "left").withColumn("own", F.coalesce("own", "id")), "owned")
    sizes = rows.groupBy("name").agg(F.min("own").alias("x"), F.max("own").alias("y"), F.max("probes").alias("any"), F.count("*").alias("members"))
    sizes = written(sizes.filter("x <> y AND any").select("name", "members"), "sizes")
    rows = join_groups(rows, sizes, ["name"], "members", total)
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / CELL)).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = rows.select(F.xxhash64("name", low, high).alias("cell"), "id", "n", "own", "block", (low != high).alias("apart"), "probes", "matches", "level", *BITS)
    cells = cells.repartition("cell").sortWithinPartitions("cell", "n", "id")
    return cells.mapInArrow(_pairs(percent, nearest), f"a {kind}, b {kind}, matches int")


def jaccard_groups(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links).

    Words are runs of other than ASCII white space with A-Z lower-cased; a document's set is its distinct
    ``k``-word shingles, with fewer words the whole sequence as one. Sets are linked if 100 times their
    intersection is at least ``percent`` times their union: all of these, the join is not randomised. Shingles
    are told apart by names of 64 bits. Texts that are null, empty or white have an empty set and link with
    nothing. Rows that repeat an id must repeat its text. Rows without id are grouped by equal sets only. Very
    long texts are compared whole. Other columns are ignored; an empty table gives no rows.
    """
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    columns = f"id {kind}, {', '.join(f'{c} long' for c in [*KEY, *BITS])}, counts array<int>, names array<long>"
    rows = written(docs.mapInArrow(_sketches(k, percent, id_type), columns), "sketches")
    classes = written(rows.filter("n > 0").groupBy(*KEY).agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    reps = rows.filter("n > 0").join(classes.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    asked = written(reps.select("id", F.explode("names").alias("name")), "names")
    total = asked.count()
    shared = written(asked.groupBy("name").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    lists = join_groups(asked, shared, ["name"], "df", total).groupBy("id").agg(F.collect_list(F.struct("name", "df")).alias("shared"))
    sets = rows.filter("n > 0").select("id", "n", *BITS, "counts").dropDuplicates(["id"]).join(lists.hint("merge"), "id")
    columns = f"id {kind}, n long, {', '.join(f'{b} long' for b in BITS)}, name long, matches int, probes boolean, level int"
    postings = written(sets.mapInArrow(_prefixes(percent), columns), "postings")
    total = postings.count()

    linker = Linker(docs, k, percent)
    links = linker.links(_shared_enough(_with_heads(postings, total, percent)))
    group = written(components(links), "components")
    for nearest in (True, False):
        more = linker.links(_shared_enough(_within_lists(postings, group, total, percent, nearest, kind)))
        links = links.unionByName(more)
        group = written(components(group.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")

    classes = classes.join(group.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    classes = written(classes.select(*KEY, "size", F.coalesce("component", "rep").alias("component")), "groups")
    out = join_groups(rows.filter("n > 0").select("id", *KEY), classes, KEY, "size", rows.count()).select("id", "n", "component")
    out = out.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
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
  HAVING 100 * count(*) >= 90 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id, doc_id AS reach FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reach) AS component_id
FROM documents AS d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
GROUP BY d.doc_id
"""
