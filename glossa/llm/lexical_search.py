"""Ranked lexical search, score at a time over impact-ordered postings.

What a term adds to a document's score, its impact, depends on the document's length and the term's count and
rarity. Documents are dealt out to shards of bounded size; the index has a row for each shard, term and exact
impact, with the documents. In a shard every query works through its terms' impacts from the highest on. What it
has not yet taken adds a known amount at most: once that is less than the k-th best score so far, no document
that is still unseen can get among the first k, and only those seen ones that could are scored in full. A first
pass over the highest impacts of all shards gives each query a score that its k-th best has at least, so that
shards without good documents stop early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .hashing import Words, chunks
from .packing import trim
from .shared import written

BETWEEN = np.ones(256, bool)  # bytes that part terms: all of ASCII but letters and digits
BETWEEN[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = False
TERMS = 1 << 17  # of queries that one pass over the documents looks for, about; they and their terms' df are sent to the tasks
SHARD = 4096  # documents, about
STEP = 0.6  # a query takes its impacts down to this share of the highest, then to this share of that, and so on
PILOT = 3  # such steps make the first pass


def _lists(starts: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(x.astype(np.int64))) for x in values]


def _query_terms(id_type):
    """(query, terms, counts) of each text; terms by their 64-bit names."""

    def run(batches):
        words = Words(BETWEEN)
        for ids, texts in chunks(batches):
            names, counts = words(texts)
            each = [np.unique(x, return_counts=True) for x in np.split(names, np.cumsum(counts)[:-1])]
            starts = np.cumsum([0, *(len(t) for t, _ in each)])
            lists = _lists(starts, *(np.concatenate(x) for x in zip(*each, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *lists], names=["query", "terms", "counts"])

    return run


def _doc_terms(vocabulary, id_type):
    """(row, id, n, terms, counts) of each text: how many terms it has, and those in the sorted vocabulary with their counts."""

    def run(batches):
        words, known = Words(BETWEEN), vocabulary.value
        for keys, texts in chunks(batches):
            names, counts = words(texts)
            at = np.minimum(np.searchsorted(known, names), max(len(known) - 1, 0))
            hit = known[at] == names if len(known) else np.zeros(len(names), bool)
            doc = np.repeat(np.arange(len(texts)), counts)
            pair, times = np.unique(doc[hit] * max(len(known), 1) + at[hit], return_counts=True)
            starts = np.searchsorted(pair, np.arange(len(texts) + 1) * max(len(known), 1))
            cols = [pa.array([k["row"] for k in keys], pa.int64()), pa.array([k["id"] for k in keys], id_type), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*cols, *_lists(starts, known[pair % max(len(known), 1)].view(np.int64), times)], names=["row", "id", "n", "terms", "counts"])
        trim()

    return run


def _postings(docs: DataFrame) -> DataFrame:
    each = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf"))).alias("x")
    return docs.select("row", "id", "n", each).select("row", "id", "n", "x.term", "x.tf")


def _with_impact(postings: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``postings`` with df and n, with their impact. All but the logarithm is integer arithmetic of 64 bits."""
    w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    postings = postings.withColumn("m", 75 + F.expr(f"(25L * n * {n_docs}L) div {max(n_terms, 1)}L"))
    return postings.withColumn("impact", w * F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")).drop("m")


class ImpactIndex:
    """Postings of a vocabulary (sorted names of terms), by shard, term and exact impact, in the shared folder.

    ``docs`` has a row for each row of the documents: shard, row (its number), id, n, and the terms it has of the
    vocabulary. ``groups`` has shard, term, impact, and the rows, the highest impacts first.
    """

    def __init__(self, docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text"):
        spark, kind = docs.sparkSession, docs.schema[id_col].dataType
        # rows are numbered once, in what is written: they are documents of their own, whatever their id
        texts = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("key"), F.col(text_col).cast("string").alias("text"))
        made = _doc_terms(spark.sparkContext.broadcast(vocabulary), to_arrow_type(kind))
        self.docs = written(texts.mapInArrow(made, f"row long, id {kind.simpleString()}, n long, terms array<long>, counts array<long>"), "docs")
        self.n_rows, self.n_docs, self.n_terms = self.docs.agg(F.count("*"), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.docs = self.docs.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-self.n_rows // SHARD)))))
        lists = written(self.docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "lists")
        each = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf"))).alias("x")
        postings = self.docs.select("shard", "row", "n", each).select("shard", "row", "n", "x.term", "x.tf")
        postings = postings.join(F.broadcast(lists), "term")  # no more rows than the vocabulary
        groups = _with_impact(postings, self.n_docs, self.n_terms).groupBy("shard", "term", "impact").agg(F.collect_list("row").alias("rows"))
        self.groups = written(groups.sortWithinPartitions("shard", F.desc("impact")), "groups")


class Shard:
    """A shard's postings, term after term, each with its impacts from the highest on."""

    def __init__(self, groups: pa.Table, docs: pa.Table):
        docs = docs.select(["row", "id"]).sort_by([("row", "ascending")])
        self.docs, rows = docs, docs["row"].to_numpy()
        place = pc.sort_indices(docs, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()
        self.place = np.empty(len(place), np.int64)  # of a document in the order of ids
        self.place[place] = np.arange(len(place))
        groups = groups.select(["term", "impact", "rows"]).sort_by([("term", "ascending"), ("impact", "descending")])
        lens = pc.list_value_length(groups["rows"]).to_numpy()
        self.at = np.searchsorted(rows, pc.list_flatten(groups["rows"]).to_numpy())
        self.impact = np.repeat(groups["impact"].to_numpy(), lens)
        names, first = np.unique(np.repeat(groups["term"].to_numpy(), lens), return_index=True)
        ends = [*first[1:].tolist(), len(self.at)][: len(first)]  # none where the shard has no posting
        self.lists = {t: (a, b) for t, a, b in zip(names.tolist(), first.tolist(), ends, strict=True)}

    def search(self, query: list[tuple[int, int]], k: int, floor: int, steps: int | None):
        """(documents, scores) of the k best with a score of ``floor`` or more; after ``steps`` the best partial scores."""
        lists = [[*self.lists[t], times] for t, times in query if t in self.lists]  # start of what is left, end, repeats
        scores, step = np.zeros(len(self.place), np.int64), 0
        most = max((int(self.impact[a]) for a, _, _ in lists), default=0)
        while True:
            rest = sum(int(self.impact[a]) * times for a, b, times in lists if a < b)
            worst = max(floor, int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0, 1)
            if not rest or rest < worst or step == steps:
                break
            step, most = step + 1, most * STEP
            for x in lists:
                a, b, times = x
                if a < b and self.impact[a] >= most:
                    end = a + int(np.searchsorted(-self.impact[a:b], -most, "right"))
                    scores[self.at[a:end]] += self.impact[a:end] * times
                    x[0] = end
        if step == steps:
            able = scores > 0
        else:
            able = scores + rest >= worst
            for a, b, times in lists:
                met = able[self.at[a:b]]
                scores[self.at[a:b][met]] += self.impact[a:b][met] * times
            able &= scores >= worst
        able = np.flatnonzero(able)
        best = able[np.lexsort((self.place[able], -scores[able]))[:k]]
        return best, scores[best]


def _in_shards(queries, k: int, steps: int | None, floors: dict[int, int] | None, id_type):
    def run(groups, docs):
        shard, asked = Shard(groups, docs), queries.value
        number, found, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, terms in asked.items():
            best, score = shard.search(terms, k, floors.get(q, 0) if floors else 0, steps)
            number += [q] * len(best)
            found.append(best)
            scores.append(score)
        rows = shard.docs.take(pa.array(np.concatenate(found)))
        cols = [pa.array(number, pa.int64()), rows["row"], rows["id"].cast(id_type), pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays(cols, names=["query", "row", "id", "score"])

    return run


def _first(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query with their rank, equal ones by id (null last). Rows beyond a task's first k are left
    out before they are dealt out."""
    over = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def _search(docs: DataFrame, asked: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(query, rank, id, score) for queries given as rows of query, term and times."""
    queries: dict[int, list[tuple[int, int]]] = {}
    for q, term, times in asked:
        queries.setdefault(q, []).append((term, times))
    vocabulary = np.unique(np.array([r[1] for r in asked], np.int64).view(np.uint64))
    index, kind = ImpactIndex(docs, vocabulary, id_col, text_col), docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(queries)

    def scores(steps, floors):
        both = index.groups.groupBy("shard").cogroup(index.docs.select("shard", "row", "id").groupBy("shard"))
        return both.applyInArrow(_in_shards(sent, k, steps, floors, to_arrow_type(kind)), f"query long, row long, id {kind.simpleString()}, score long")

    best = _first(scores(PILOT, None), k).groupBy("query").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    floors = {r["query"]: r["worst"] for r in best.filter(F.col("n") == k).collect()}  # a number a query of this pass
    return _first(scores(None, floors), k).select("query", "rank", "id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text") -> DataFrame:
    """One row for each query and rank: query, rank (from 1), id, score; the k best rows of ``docs`` with a score above 0.

    Terms are runs of ASCII letters, digits and all beyond ASCII, with A-Z lower-cased. With N documents that
    have a term, L terms in all, n in a document, a term in df documents and tf times in this one, its weight is
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 75 + (25 n N) div L; a score sums w * ((10^9 tf) div
    (1000 tf + 12 m)) over the query's terms, repeats included. Equal scores are ranked by id, a null id last.
    Rows that repeat an id are documents of their own, ranked in any order among themselves; queries that repeat
    an id are one, with the terms of all. Null texts have no terms, and a query none of whose terms occurs has
    no row. Terms are told apart by names of 64 bits. Other columns are ignored; an empty table gives no rows.
    Queries are searched for in passes of about ``TERMS`` terms together.
    """
    kind = queries.schema[query_col].dataType
    texts = queries.select(F.col(query_col).alias("query"), F.col(query_text).cast("string").alias("text"))
    asked = texts.mapInArrow(_query_terms(to_arrow_type(kind)), f"query {kind.simpleString()}, terms array<long>, counts array<long>")
    asked = asked.select("query", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("times"))).alias("x"))
    asked = written(asked.groupBy("query", "x.term").agg(F.sum("x.times").alias("times")), "asked")
    # from here on queries go by number, as a null id is a query's too
    numbers = written(asked.select("query").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    on = F.col("a.query").eqNullSafe(F.col("n.query"))
    asked = written(asked.alias("a").join(numbers.alias("n"), on).select(F.col("number").alias("query"), "term", "times"), "asked")
    passes, out = max(1, -(-asked.count() // TERMS)), None
    for i in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == i).collect()
        found = _search(docs, some, k, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    out = out.join(numbers.withColumnRenamed("query", "name"), out["query"] == F.col("number"))
    return out.select(F.col("name").alias(query_col), "rank", F.col("id").alias(id_col), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS every FROM t WHERE len(terms) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id,
         sum(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // every))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term), g GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
