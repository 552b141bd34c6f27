"""Byte-level BPE over a table of distinct words.

Texts are split in Spark at places where the tokenizer's own pattern always splits, before the white space
that follows other characters. Each distinct word is encoded once; its ids are joined back to the word's
positions, and ids are decoded by looking them up in the table of the vocabulary's pieces, which has a fixed
size and goes to every task: the hash join of a broadcast table, over arrays of ids instead of a row a token.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .packing import blocks, n_parts, pack, pack_strings, ranges, trim, unpack, unpack_strings
from .shared import fresh_path, text_bytes, written

#: White space of any of the libraries, so that a character outside is none for all of them.
SPACES = "\\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
SPLIT = re.compile(f"(?<=[^{SPACES}])(?=[ \t\n\r])")
#: Texts in which splitting by single spaces and newlines is not the same as SPLIT.
UNUSUAL = re.compile(f"^[{SPACES}]|[{SPACES}]{{2}}|[^\\S \n]|[\x00-\x08\x0e-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
MARK = "\x01"


def words(text: str) -> list[str]:
    """Words in a short form: without the leading space, as they are from a newline on, or else after MARK."""
    if UNUSUAL.search(text):
        out = SPLIT.split(text)
        return [w[1:] if w[0] == " " and w[1:2] not in ("\n", MARK) else w if w[0] == "\n" else MARK + w for w in out if w]
    out = text.replace("\n", " \n").split(" ")
    out[0] = MARK + out[0]
    return out if len(out[0]) > 1 else out[1:]


def spelt(word: str) -> str:
    """The word as it stands in the text."""
    return word[1:] if word[0:1] == MARK else word if word[0:1] == "\n" else " " + word


def pieces(vocab_json: str) -> list[bytes]:
    """Bytes of each id; ids that the vocabulary lacks are empty."""
    vocab = json.loads(vocab_json)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
    own = {i: bytes(byte_of[c] for c in s) for s, i in vocab["model"]["vocab"].items()}
    own |= {t["id"]: t["content"].encode() for t in vocab.get("added_tokens", [])}
    return [own.get(i, b"") for i in range(max(own) + 1)]


def _packed(all_pieces: list[bytes]):
    """Lengths of pieces by id, and their bytes one after the other."""
    import numpy as np

    return np.array([len(p) for p in all_pieces], np.int64), np.frombuffer(b"".join(all_pieces), np.uint8)


def _tokenizer(vocab_json: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocab_json)
    t.no_truncation()
    t.no_padding()
    return t


class _Codes(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _blocks_of(batches, parts: int):
    """A row a block: ids, words a document, codes of all words, the distinct words by part."""
    import numpy as np
    import pandas as pd

    base = TaskContext.get().partitionId() << 32
    for k, (ids, texts) in enumerate(blocks(batches)):
        own, codes = _Codes(), []
        for t in texts:
            w = words(t)
            codes.append(np.fromiter(map(own.__getitem__, w), np.int32, len(w)))
        lens = list(map(len, codes))
        codes = np.concatenate(codes)
        times = np.bincount(codes, minlength=len(own))
        codes = np.where(times[codes] == 1, 0, codes + 1).astype(np.uint32)  # 0: the next word that occurs once
        distinct = list(own)
        del own
        at = (pd.util.hash_array(np.array(distinct, dtype=object), categorize=False) % np.uint64(parts)).astype(np.uint32) if distinct else np.zeros(0, np.uint32)
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        sent = []
        for p, idx in zip(used.tolist(), np.split(order, first[1:]), strict=False):
            sent.append({"part": p, "payload": pack_strings([distinct[i].encode() for i in idx.tolist()])})
        yield base + k, ids, lens, pack(codes, 6), pack(at), sent
        trim()


def _split(docs: DataFrame, parts: int) -> DataFrame:
    kind = docs.schema[0].dataType.simpleString()

    def run(batches):
        for block, ids, lens, codes, at, sent in _blocks_of(batches, parts):
            cols = [[block], [ids], [lens], [codes], [at], [sent]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    id_type = to_arrow_type(docs.schema["id"].dataType)
    names = ["block", "ids", "lens", "codes", "at", "sent"]
    types = [pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.struct([("part", pa.int32()), ("payload", pa.binary())]))]
    return docs.mapInArrow(run, f"block long, ids array<{kind}>, lens array<int>, codes binary, at binary, sent array<struct<part:int,payload:binary>>")


def _encode_part(vocab):
    """For all payloads of a part: encode its distinct words once, answer each payload with its words' ids."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        asked = [unpack_strings(x) for x in table.column("payload").to_pylist()]
        own: dict[bytes, int] = dict.fromkeys(w for x in asked for w in x)
        for i, w in enumerate(own):
            own[w] = i
        t, ids, lens = _tokenizer(vocab.value), [], []
        distinct = [spelt(w.decode()) for w in own]
        for i in range(0, len(distinct), 10_000):
            some = [e.ids for e in t.encode_batch_fast(distinct[i : i + 10_000], add_special_tokens=False)]
            lens.append(np.fromiter(map(len, some), np.uint32, len(some)))
            ids.append(np.fromiter((x for e in some for x in e), np.uint32, int(lens[-1].sum())))
        ids, lens = np.concatenate(ids), np.concatenate(lens)
        starts = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)[:-1]))
        out = []
        for x in asked:
            at = np.fromiter(map(own.__getitem__, x), np.int64, len(x))
            got = ids[ranges(starts[at], lens[at])]
            got = got.astype(np.uint16) if got.size and got.max() < 65536 else got
            out.append({"part": 0, "width": got.dtype.itemsize, "lens": pack(lens[at], 6), "ids": pack(got, 6)})
        for r, p in zip(out, table.column("part").to_pylist(), strict=True):
            r["part"] = p
        del own, asked, distinct
        trim()
        answer = pa.array(out, pa.struct([("part", pa.int32()), ("width", pa.int32()), ("lens", pa.binary()), ("ids", pa.binary())]))
        return pa.table({"block": table.column("block"), "answer": answer})

    return run


def _joined(vocab_pieces, id_type):
    """For each block: ids joined back by position, pieces joined by id."""

    def run(batches):
        import numpy as np

        piece_lens, body = vocab_pieces.value
        piece_starts = np.cumsum(piece_lens) - piece_lens
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a block: one at a time
                row = batch.slice(i, 1).to_pylist()[0]
                at, codes = unpack(row["at"], np.uint32), unpack(row["codes"], np.uint32).astype(np.int64)
                often = np.zeros(len(at), bool)
                often[codes[codes > 0] - 1] = True
                codes[codes == 0] = np.flatnonzero(~often) + 1
                codes -= 1
                order = np.argsort(at, kind="stable")
                got = sorted(row["answers"] or [], key=lambda a: a["part"])
                lens, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                flat = np.zeros(0, np.uint16)
                if got:
                    lens[order] = np.concatenate([unpack(a["lens"], np.uint32) for a in got])
                    starts[order] = np.cumsum(lens[order]) - lens[order]
                    flat = np.concatenate([unpack(a["ids"], np.uint16 if a["width"] == 2 else np.uint32) for a in got])
                done, a, b = 0, [], []
                for n in row["lens"]:
                    own = codes[done : done + n]
                    done += n
                    ids = flat[ranges(starts[own], lens[own])]
                    a.append(ids.astype("<u4").tobytes())
                    b.append(body[ranges(piece_starts[ids], piece_lens[ids])].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], id_type), pa.array(a, pa.binary()), pa.array(b, pa.string())], names=["id", "ids", "decoded"])
                del a, b, flat, codes, lens, starts
                trim()

    return run


def encode(docs: DataFrame, vocab_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (little-endian unsigned 32-bit integers), decoded (the text of the ids).

    Ids are those of the tokenizers library for the whole text without added special tokens. Null and empty
    texts have no ids and decode to the empty text. Repeated rows each give a row; a null id stays null; an
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = n_parts(text_bytes(docs), 8 << 20)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "blocks")
    table = path.rpartition("/")[2].replace("-", "_")
    _split(docs, parts).write.bucketBy(buckets, "block").option("path", path).format("parquet").saveAsTable(table)
    split = spark.table(table)
    sent = split.select("block", F.explode("sent").alias("s")).select("block", "s.part", "s.payload")
    vocab = spark.sparkContext.broadcast(vocab_json)
    answers = sent.repartition(min(parts, 20_000), "part").groupBy("part").applyInArrow(_encode_part(vocab), "block long, answer struct<part:int,width:int,lens:binary,ids:binary>")
    answers = answers.groupBy("block").agg(F.collect_list("answer").alias("answers"))
    met = split.select("block", "ids", "lens", "codes", "at").join(answers.hint("merge"), "block", "left")
    id_type = to_arrow_type(docs.schema["id"].dataType)
    kind = docs.schema["id"].dataType.simpleString()
    out = met.mapInArrow(_joined(spark.sparkContext.broadcast(_packed(pieces(vocab_json))), id_type), f"id {kind}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def piece_table(spark: SparkSession, vocab_json: str) -> DataFrame:
    """The vocabulary as rows of (token, piece)."""
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(pieces(vocab_json))], "token int, piece binary")


def decode(encoded: DataFrame, vocab_json: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: id, decoded. ``ids_col`` is an array of ids; those outside the vocabulary are left out.

    The vocabulary has a fixed number of pieces, so it is broadcast. Null and empty arrays decode to the
    empty text. Other columns are ignored.
    """
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "ids")
    pieces_of = F.broadcast(piece_table(encoded.sparkSession, vocab_json))
    each = rows.select("row", F.posexplode("ids").alias("pos", "token")).join(pieces_of, "token")
    joined = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("x"))
    text = F.decode(F.unhex(F.array_join(F.transform("x", lambda s: s["piece"]), "")), "utf-8")
    return rows.join(joined, "row", "left").select(F.col("id").alias(id_col), F.coalesce(text, F.lit("")).alias("decoded"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file, read on the driver; executors get its text."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return out.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
