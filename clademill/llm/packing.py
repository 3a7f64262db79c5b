"""Best-fit packing of documents into sequences of bounded length.

Only the lengths matter for the packing, and there are at most `capacity` of them. So the pieces are counted by length
(the one thing that comes to the driver), best-two-fit packs the counts there, and each piece finds its place from its
length and its rank among the pieces of that length, in a table of ranges whose size has the same bound. Rows move once, without their ids.

Null and empty texts are documents of the end id alone. Ties and repeated rows are pieces of their own. An empty table
gives an empty result. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths: one piece if it fits, else full pieces after a first one that takes the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids of each piece; part and rank: its place among those of its length in its task."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = tokens.held(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                blob = ids_of.text(text) + end
                for k, (start, length) in enumerate(cuts(len(blob) // 4, capacity)):
                    for column, value in zip(out, (doc, k, start, length, blob[4 * start : 4 * (start + length)], part, seen[length])):
                        column.append(value)
                    seen[length] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    return common.python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences follow each.

    A bin takes the longest length that still fits, again and again. What gap is left, and the bin's shortest length,
    are then offered to the two lengths in stock with the largest sum that fits; if that sum is larger than the shortest
    length, they replace it. The same stock gives the same bin, so a bin is repeated as often as the stock lasts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes, plan = np.arange(capacity + 1), []
    while True:
        have = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the longest in stock up to each size
        if not have[capacity]:
            return plan
        bin_, stock, gap = [], left.copy(), capacity
        while gap and (x := int(np.maximum.accumulate(np.where(stock[: gap + 1] > 0, sizes[: gap + 1], 0))[gap])):
            n = min(gap // x, int(stock[x]))
            bin_ += [x] * n
            stock[x] -= n
            gap -= n * x
        while gap and len(bin_) > 1:
            shortest = bin_[-1]
            room = gap + shortest
            upto = np.maximum.accumulate(np.where(stock[: room + 1] > 0, sizes[: room + 1], 0))
            a = np.flatnonzero(stock[: room // 2 + 1])
            if not a.size:
                break
            b = upto[room - a]
            ok = (b > a) | (b == a) & (stock[a] > 1)
            total = np.where(ok, a + b, 0)
            best = int(total.argmax())
            if total[best] <= shortest:
                break
            x, y = int(a[best]), int(b[best])
            stock[shortest] += 1
            stock[x] -= 1
            stock[y] -= 1
            bin_[-1:] = [y, x]
            bin_.sort(reverse=True)
            gap = room - x - y
        used = np.bincount(bin_, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        plan.append((bin_, times))


def ranges(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length and first rank of a range), and each range's first rank, first sequence and offset."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for bin_, times in plan:
        offset = 0
        for length in bin_:
            rank = next_rank.get(length, 0)
            rows.append(((length << 44) + rank, rank, sequence, offset))
            next_rank[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (stored: length, part, rank and any other columns) with sequence_id and offset."""
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_part = by_part.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = cut.sparkSession.sparkContext.broadcast(ranges(best_two_fit(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = table.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            kept = [i for i, f in enumerate(batch.schema) if f.name not in ("part", "rank")]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[batch.schema.field(i).name for i in kept] + ["sequence_id", "offset"])

    ranked = cut.join(by_part.drop("n"), ["part", "length"]).withColumn("rank", F.col("rank") + F.coalesce("base", F.lit(0))).drop("base").select(*cut.columns)
    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c not in ("part", "rank")) + ", sequence_id long, offset long"
    return common.python(ranked, place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece."""
    return pack(common.stored(pieces(docs, path, capacity, end_id), "pieces"), capacity)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The packing with a checksum in place of the ids, which then need not be stored or moved."""
    cut = pieces(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(common.stored(cut, "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
