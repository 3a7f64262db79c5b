"""Token ids in binary files: canonical Huffman codes of bounded length, in blocks that decode on their own.

Documents are sorted by id over all partitions (shards), tokenised, and gathered into blocks of whole documents with
about BLOCK ids. The counts of all ids give the code lengths (package-merge, at most LIMIT bits); codes follow from the
lengths alone. A block holds its documents' ids and lengths, the bit offset of every STEP-th id, and the code bits. A
reader decodes all these stretches of a block side by side through one table. The blocks are binary values in Parquet
files, which any store that Spark knows can hold; the code lengths and each shard's first position lie beside them.

Null and empty texts are documents of the end id alone. A null doc_id comes first. Equal ids and repeated rows keep
places of their own. An empty table gives an empty file set and result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

END_ID, BLOCK, STEP, LIMIT, MAGIC = 1, 262_144, 256, 20, b"IDH1"
REMEMBERED = 350_000
HEAD = struct.Struct("<4sIQIIQ")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if used.size < 2:
        out[used] = 1
        return out
    if used.size > 2**limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    row, leaves = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        row = both[rank]
        leaves.append(rank < len(weights))
    need, lengths = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for leaf in reversed(leaves):
        own = int(leaf[:need].sum())
        lengths[:own] += 1
        need = 2 * (need - own)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: by length, then by id."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.lengths, self.limit = lengths, limit
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        width = np.int64(1) << (limit - lengths[order].astype(np.int64))
        first = np.cumsum(width) - width
        self.aligned = np.zeros(len(lengths), np.uint32)  # a code in the upper `limit` bits of 32
        self.aligned[order] = (first << (32 - limit)).astype(np.uint32)
        self.table = np.zeros(2**limit, np.uint32)
        self.table[: int(width.sum())] = np.repeat((order.astype(np.uint32) << np.uint32(5)) | lengths[order], width)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Code bits, and the bit offset of every STEP-th id. Codes are laid into 64-bit words, of which each ends in one code at most."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        offsets = ends - lengths
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        code, word, shift = self.aligned[ids].astype(np.uint64) << np.uint64(32), offsets >> 6, (offsets & 63).astype(np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.bitwise_or.reduceat(code >> shift, first)
        over = code << (np.uint64(63) - shift) << np.uint64(1)
        spilt = np.flatnonzero(over)
        words[word[spilt] + 1] |= over[spilt]
        return words.astype(">u8").tobytes()[: (total + 7) // 8], offsets[::STEP].astype(np.uint64)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        words = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        at, last, out = offsets.astype(np.int64), len(words) - 1, np.empty((min(STEP, n), len(offsets)), np.uint32)
        shift = np.uint32(32 - self.limit)
        for k in range(len(out)):
            found = self.table[words[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> shift]
            out[k] = found >> np.uint32(5)
            at += (found & np.uint32(31)).astype(np.int64)
        return out.T.reshape(-1)[:n]


def block_bytes(docs: list[int | None], sizes: list[int], ids: np.ndarray, code: Code) -> bytes:
    bits, offsets = code.encode(ids)
    null = np.array([d is None for d in docs], np.uint8)
    return HEAD.pack(MAGIC, len(docs), len(ids), STEP, len(offsets), len(bits)) + np.array([d or 0 for d in docs], "<i8").tobytes() + null.tobytes() + np.array(sizes, "<u4").tobytes() + offsets.astype("<u8").tobytes() + bits


def block_content(blob: bytes, code: Code) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, numbers of ids, and all ids."""
    magic, docs, n, step, stretches, size = HEAD.unpack_from(blob)
    if magic != MAGIC or step != STEP:
        raise ValueError("not a block of this format")
    at = HEAD.size
    own = np.frombuffer(blob, "<i8", docs, at).tolist()
    null = np.frombuffer(blob, np.uint8, docs, at + 8 * docs).tolist()
    sizes = np.frombuffer(blob, "<u4", docs, at + 9 * docs)
    offsets = np.frombuffer(blob, "<u8", stretches, at + 13 * docs)
    start = at + 13 * docs + 8 * stretches
    return [None if x else d for d, x in zip(own, null)], sizes, code.decode(blob[start : start + size], offsets, n)


def narrowed(blob: bytes) -> bytes:
    """Ids of 32 bits in 16 bits if they fit."""
    ids = np.frombuffer(blob, "<u4")
    return ids.astype("<u2").tobytes() if ids.size and ids.max() < 1 << 16 else blob


def widened(blob: bytes, n: int) -> np.ndarray:
    """n ids of narrowed()."""
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4")


BLOCKS = "shard int, block long, at long, docs array<long>, sizes array<long>, ids binary"


def gathered(docs: DataFrame, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Blocks of whole documents in ascending order of doc_id; at: the ids of the shard's earlier blocks."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", F.monotonically_increasing_id())
    ordered = source.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, shard = tokens.held(path, True, REMEMBERED), TaskContext.get().partitionId()
        number = at = size = 0
        docs, sizes, blobs = [], [], []

        def out() -> pa.RecordBatch:
            arrays = [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([at], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([narrowed(b"".join(blobs))], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "block", "at", "docs", "sizes", "ids"])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                blob = ids_of.text(text) + end
                docs.append(doc)
                sizes.append(len(blob) // 4)
                blobs.append(blob)
                size += len(blob) // 4
                if size >= block:
                    yield out()
                    number, at, size, docs, sizes, blobs = number + 1, at + size, 0, [], [], []
        if docs:
            yield out()

    return common.python(ordered, run, BLOCKS)


def in_block() -> Column:
    """The ids of a block."""
    return F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)


def counted(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs; one number for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.bincount(widened(blob, n), minlength=len(total))
                own[: len(total)] += total
                total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = common.python(blocks.select("ids", in_block().alias("n")), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(docs: DataFrame, target: str, path: str, end_id: int = END_ID) -> None:
    """Write the documents' ids below target: blocks, code and shards."""
    spark = docs.sparkSession
    blocks = common.stored(gathered(docs, path, end_id), "gathered")
    lengths = code_lengths(counted(blocks))
    table = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(table.value)
        for batch in batches:
            shard, block, at, docs, sizes, ids = batch.columns
            blobs = [block_bytes(d, s, widened(i, sum(s)), code) for d, s, i in zip(docs.to_pylist(), sizes.to_pylist(), ids.to_pylist())]
            yield pa.RecordBatch.from_arrays([shard, block, at, pa.array(blobs, pa.binary())], names=["shard", "block", "at", "bytes"])

    common.python(blocks, run, "shard int, block long, at long, bytes binary").write.option("compression", "none").parquet(f"{target}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(in_block()).alias("n")).orderBy("shard").collect()  # one row a shard
    first = np.cumsum([0, *(r.n for r in totals)]).tolist()
    spark.createDataFrame([(r.shard, start) for r, start in zip(totals, first)], "shard int, start long").coalesce(1).write.parquet(f"{target}/shards")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{target}/code")


def read(spark: SparkSession, target: str, digest: bool = False) -> DataFrame:
    """doc_id, start and ids (binary) of every document that the files hold; or, of the same ids, their number n_tokens and ids_crc32."""
    lengths = bytes(spark.read.schema("lengths binary").parquet(f"{target}/code").first().lengths)
    first = {r.shard: r.start for r in spark.read.schema("shard int, start long").parquet(f"{target}/shards").collect()}
    table = spark.sparkContext.broadcast((lengths, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first = table.value
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for shard, at, blob in zip(*(c.to_pylist() for c in batch.columns)):
                docs, sizes, ids = block_content(blob, code)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                own = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                content = {"n_tokens": pa.array(sizes.astype(np.int64)), "ids_crc32": pa.array(map(zlib.crc32, own), pa.int64())} if digest else {"ids": pa.array(own, pa.binary())}
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first[shard] + at + starts), *content.values()], names=["doc_id", "start", *content])

    blocks = spark.read.schema("shard int, at long, bytes binary").parquet(f"{target}/blocks")
    return common.python(blocks, run, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids binary"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = common.shared_dir(spark) + "/ids"
    write(common.read(spark, sf_dir, "documents"), target, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, target, digest=True)
