"""Inner products of all vectors with all others, dealt over tasks as pairs of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a cell at most (a task holds two cells) and, where more cells keep more tasks busy, at least; products held at once, whatever the cell; columns of a block.
CELL, SMALL, PRODUCTS, BLOCK = 8192, 512, 1 << 20, 16


def cell_count(n: int, tasks: int) -> int:
    return max(1, -(-n // CELL), min(-(-n // SMALL), math.isqrt(2 * tasks)))


def chunk_rows(others: int) -> int:
    """How many vectors are multiplied with so many others at once."""
    return max(1, PRODUCTS // max(others, 1))


def dealt(vectors: DataFrame, by: str, cells: Column) -> DataFrame:
    """vectors with one <= two and second: each one goes to all pairs of cells that its own is in, as part of the first or second.

    Every pair of vectors meets in one pair of cells, so that a product serves both directions, and a vector is sent as
    often as there are cells.
    """
    own = F.pmod(F.xxhash64(by), cells).cast("int")
    each = vectors.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), (cells - 1).cast("int"))))
    return each.withColumns({"one": F.least("__own", "__other"), "two": F.greatest("__own", "__other"), "second": F.col("__own") > F.col("__other")}).drop("__own", "__other")


def _matrices(*parts: pa.Table) -> list[np.ndarray]:
    """The vectors of each part, in single precision where all sums of a product are below 2^24 and therefore exact."""
    out = [np.asarray(p["e"].combine_chunks().flatten(), dtype=np.float64).reshape(p.num_rows, -1) for p in parts]
    longest = max((float(np.einsum("ij,ij->i", m, m).max(initial=0)) for m in out), default=0)
    return [m.astype(np.float32) for m in out] if longest < 1 << 24 else out


def _above(part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of each row's k greatest with all ties. part has k columns or more.

    The k-th greatest of the maxima of blocks of columns is no more than the k-th greatest value, and few values reach it.
    """
    n, width = part.shape
    blocks = width // BLOCK
    if k == 1:
        least = part.max(1)
    else:
        top = part[:, : blocks * BLOCK].reshape(n, BLOCK, blocks).max(1) if blocks >= k else part
        least = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k]
    q, s = np.divmod(np.flatnonzero(part >= least[:, None]), width)
    value = part[q, s]
    if k > 1:
        order = np.lexsort((-value, q))
        kth = value[order][np.searchsorted(q, np.arange(n)) + k - 1]  # q is ascending, and so in order
        kept = value >= kth[q]
        q, s, value = q[kept], s[kept], value[kept]
    return q, s, value


def _sides(part: pa.Table) -> list[tuple[pa.Table, pa.Table]]:
    """The two cells of a pair, in both directions; a cell with itself once. Nothing where one of them is empty."""
    second = np.asarray(part["second"].combine_chunks())
    if part["one"][0].as_py() == part["two"][0].as_py():
        return [(part, part)]
    a, b = part.filter(pa.array(~second)), part.filter(pa.array(second))
    return [(a, b), (b, a)] if a.num_rows and b.num_rows else []


def _best(queries: pa.Table, others: pa.Table, k: int) -> Iterator[pa.Table]:
    others = others.take(pa.array(np.argsort(np.asarray(others["label"]), kind="stable")))
    src, own, dst, label = (np.asarray(x) for x in (queries["id"], queries["label"], others["id"], others["label"]))
    a, b = _matrices(queries, others)
    names, starts = np.unique(label, return_index=True)
    step = chunk_rows(len(dst))
    for at in range(0, len(src), step):
        score = a[at : at + step] @ b.T
        for name, lo, hi in zip(names, starts, [*starts[1:], len(label)]):
            q, c, value = _above(score[:, lo:hi], min(k, hi - lo))
            other = own[at + q] != name
            q, c, value = q[other], c[other], value[other]
            yield pa.table({"src": src[at + q], "dst": dst[lo + c], "dst_label": np.full(len(q), name, dtype=np.int32), "score": value.astype(np.int64)})


def top_products(vectors: DataFrame, k: int = 1) -> DataFrame:
    """src, dst, dst_label, score: for each vector and each other label, the k highest products with all ties.

    vectors: id long, label int, e array<int>. Exact, so all pairs are multiplied, each once; a pair of cells sends on only each vector's k best by label.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("dst_label", pa.int32()), ("score", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        return pa.concat_tables([schema.empty_table(), *(found for a, b in _sides(part) for found in _best(a, b, k))])

    cells = cell_count(vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism)
    found = dealt(vectors, "id", F.lit(cells)).groupBy("one", "two").applyInArrow(run, "src long, dst long, dst_label int, score long")
    rank = F.rank().over(Window.partitionBy("src", "dst_label").orderBy(F.col("score").desc()))
    return found.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def mutual_products(vectors: DataFrame) -> DataFrame:
    """node and paralog, both ways: different vectors of one label whose product exceeds `best` of both.

    vectors: id long, label int, e array<int>, best long. Labels of more than CELL vectors, of which there are at most
    count / CELL, are dealt over pairs of cells.
    """
    large = vectors.groupBy("label").agg(F.count("*").alias("__n")).where(F.col("__n") > CELL)
    cells = F.coalesce(F.ceil(F.col("__n") / CELL), F.lit(1)).cast("int")
    each = dealt(vectors.join(F.broadcast(large), "label", "left"), "id", cells)

    def run(part: pa.Table) -> pa.Table:
        out = [pa.table({"node": pa.array([], pa.int64()), "paralog": pa.array([], pa.int64())})]
        for x, y in _sides(part):
            src, dst, (a, b) = np.asarray(x["id"]), np.asarray(y["id"]), _matrices(x, y)
            step = chunk_rows(len(dst))
            for at in range(0, len(src), step):
                score, own = a[at : at + step] @ b.T, np.asarray(x["best"])[at : at + step]
                q, s = np.nonzero((score > own[:, None]) & (score > np.asarray(y["best"])[None]) & (src[at : at + step, None] != dst[None]))
                out.append(pa.table({"node": src[at + q], "paralog": dst[s]}))
        return pa.concat_tables(out)

    return each.groupBy("label", "one", "two").applyInArrow(run, "node long, paralog long")
