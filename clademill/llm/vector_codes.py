"""Product codes of vectors, their codebooks trained by filtering Lloyd rounds.

Vectors become integers, floor(SCALE * x), and are cut into equal consecutive parts, each part position with a codebook
of its own. Every partition gathers its vectors in blocks of BLOCK, and each block keeps one kd-tree for each part
position: nodes halve their points at the median of their widest side and cache their bounding box, count and sums. The
trees are stored once. A round takes the codebooks down the trees: an entry that no point of a node's box can be nearest
to is dropped, and a node left with one entry is assigned to it whole, by its cached count and sums; points are looked at
one by one in leaves alone. Only the counts and sums of a block's entries leave a worker, and only the codebooks, of fixed
size, reach the driver.

Vectors that are null or hold null or non-finite components are left out, as nothing can be their code. All others must
have the same length, a multiple of the parts, and components below 2^26 / SCALE, else a ValueError says so. The first entries
are the vectors of the least ids; null ids come last, equal ids are ordered by their vectors, and with fewer vectors than
entries the codebooks are smaller. Equal distances go to the lower entry, an entry without points stays. Equal rows are rows
of their own. An empty table gives an empty result. Columns other than the id, the vector and the label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK, LEAF = 16, 64, 2, 256, 4096, 8
LIMIT = 1 << 26


class Tree:
    """A kd-tree over the points of one part position. Levels are arrays: node k of level l holds the points order[bounds[l][k] : bounds[l][k + 1]]."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None):
        n, width = points.shape
        self.depth = max(0, -(-n // LEAF) - 1).bit_length() if width else 0
        self.bounds = [np.arange(2**level + 1) * n // 2**level for level in range(self.depth + 1)]
        self.order = np.arange(n) if order is None else order
        if order is None:
            for level in range(self.depth):
                own, bounds = points[self.order], self.bounds[level]
                low, high = np.minimum.reduceat(own, bounds[:-1]), np.maximum.reduceat(own, bounds[:-1])
                node = np.repeat(np.arange(2**level), np.diff(bounds))
                value = own[np.arange(n), (high - low).argmax(1)[node]]
                self.order = self.order[np.lexsort((value, node))]
        self.points = points[self.order]
        starts = [b[:-1] for b in self.bounds]
        self.low = [np.minimum.reduceat(self.points, s) for s in starts]
        self.high = [np.maximum.reduceat(self.points, s) for s in starts]
        self.sums = [np.add.reduceat(self.points, s) for s in starts]

    def filtered(self, book: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Level, nodes and the entry that each of them goes to whole; points one by one come as level depth + 1."""
        nodes, open_ = np.zeros(1, int), np.ones((1, len(book)), bool)
        for level in range(self.depth + 1):
            low, high = self.low[level][nodes], self.high[level][nodes]
            # Twice the box's middle against twice the entries: the distances stay whole numbers.
            far = ((2 * book[None] - (low + high)[:, None]) ** 2).sum(2)
            best = np.where(open_, far, np.iinfo(np.int64).max).argmin(1)
            own = book[best]
            # The corner of the box that lies farthest in an entry's direction, seen from the best one.
            corner = np.where(book[None] > own[:, None], high[:, None], low[:, None])
            theirs, mine = ((book[None] - corner) ** 2).sum(2), ((own[:, None] - corner) ** 2).sum(2)
            open_ &= (theirs < mine) | (theirs == mine) & (np.arange(len(book)) < best[:, None])
            open_[np.arange(len(nodes)), best] = True
            whole = open_.sum(1) == 1
            if whole.any():
                yield level, nodes[whole], best[whole]
            nodes, open_ = nodes[~whole], open_[~whole]
            if not len(nodes):
                return
            if level < self.depth:
                nodes, open_ = np.stack([2 * nodes, 2 * nodes + 1], 1).reshape(-1), np.repeat(open_, 2, 0)
        size = self.bounds[-1][nodes + 1] - self.bounds[-1][nodes]
        at = np.repeat(self.bounds[-1][nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        far = ((book[None] - self.points[at][:, None]) ** 2).sum(2)
        yield self.depth + 1, at, np.where(np.repeat(open_, size, 0), far, np.iinfo(np.int64).max).argmin(1)

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sums of the points of each entry."""
        counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        for level, nodes, entry in self.filtered(book):
            inner = level <= self.depth
            np.add.at(counts, entry, self.bounds[level][nodes + 1] - self.bounds[level][nodes] if inner else 1)
            np.add.at(sums, entry, self.sums[level][nodes] if inner else self.points[nodes])
        return counts, sums

    def assigned(self, book: np.ndarray) -> np.ndarray:
        """The entry of each point, in the points' first order."""
        out = np.empty(len(self.order), np.int64)
        for level, nodes, entry in self.filtered(book):
            if level <= self.depth:
                size = self.bounds[level][nodes + 1] - self.bounds[level][nodes]
                at = np.repeat(self.bounds[level][nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
                out[self.order[at]] = np.repeat(entry, size)
            else:
                out[self.order[nodes]] = entry
        return out


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vectors (v: whole numbers) that have a code."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fits = lambda c: F.when(F.abs(c * SCALE) < LIMIT, F.floor(c * SCALE).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT // SCALE}")))
    return vectors.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select("vec_id", "label", F.transform(x.cast("array<double>"), fits).alias("v"))


def blocks(rows: DataFrame, parts: int, block: int) -> DataFrame:
    """One row for each block of a partition: ids, labels, the vectors and the orders of the points in their trees."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(size: int) -> pa.RecordBatch:
            nonlocal held, n
            table = pa.Table.from_batches(held)
            own, rest = table.slice(0, size).combine_chunks(), table.slice(size)
            held, n = rest.to_batches(), rest.num_rows
            v = own.column("v").combine_chunks()
            lengths = set(np.diff(v.offsets.to_numpy()).tolist())
            of_one_length(lengths, parts)
            v = v.flatten().to_numpy().reshape(size, -1).astype(np.int32)
            orders = np.stack([Tree(p.astype(np.int64)).order for p in np.split(v, parts, 1)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), own.column(c).combine_chunks()) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([v.tobytes()]), pa.array([orders.tobytes()])], names=["vec_ids", "labels", "vectors", "orders"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block:
                yield out(block)
        if n:
            yield out(n)

    return common.python(rows, run, f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, vectors binary, orders binary")


def of_one_length(lengths: set[int], parts: int) -> None:
    if len(lengths) > 1 or max(lengths, default=0) % parts:
        raise ValueError(f"vectors of one length, a multiple of {parts}, are asked for; found {sorted(lengths)}")


def trees(vectors: bytes, orders: bytes, books: np.ndarray) -> Iterator[Tree]:
    parts, _, width = books.shape
    order = np.frombuffer(orders, np.int32).reshape(parts, -1)
    v = np.frombuffer(vectors, np.int32).reshape(order.shape[1], -1).astype(np.int64)
    of_one_length({parts * width, v.shape[1]}, parts)
    return (Tree(p, o) for p, o in zip(np.split(v, parts, 1), order))


def next_books(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: parts x entries rows of counts and sums come to the driver."""
    parts, entries, width = books.shape
    sent = stored.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for vectors, orders in zip(*(c.to_pylist() for c in batch.columns)):
                for k, tree in enumerate(trees(vectors, orders, sent.value)):
                    n, s = tree.totals(sent.value[k])
                    counts[k] += n
                    sums[k] += s
        used = np.flatnonzero(counts.reshape(-1))
        own = pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(-1, width)[used].reshape(-1)), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts.reshape(-1)[used]), own], names=["entry", "n", "s"])

    made = common.python(stored.select("vectors", "orders"), run, "entry long, n long, s array<long>")
    rows = made.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width))).collect()
    out = books.copy()
    for r in rows:
        out.reshape(-1, width)[r.entry] = [r[2 + i] // r.n for i in range(width)]
    return out


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (binary, a byte a part: 256 entries at most) and error of each vector, and the codebooks (parts, entries, width)."""
    rows = kept(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    of_one_length({len(r.v) for r in first}, parts)
    stored = common.stored(blocks(rows, parts, block), "trees")
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy() if first else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if books.size else 0):
        books = next_books(stored, books)
    sent = stored.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (vectors, orders) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("vectors", "orders")))):
                codes, error = [], 0
                for book, tree in zip(sent.value, trees(vectors, orders, sent.value)):
                    entry = tree.assigned(book)
                    own = np.empty_like(tree.points)
                    own[tree.order] = tree.points
                    codes.append(entry.astype(np.uint8))
                    error = error + ((own - book[entry]) ** 2).sum(1)
                ids, labels = (batch.column(c)[i].values for c in ("vec_ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([r.tobytes() for r in np.stack(codes, 1)], pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])

    kinds = dict(rows.dtypes)
    return common.python(stored, run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error long"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = coded(common.read(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    rows = common.stored(codes.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", key.alias("of")), "codes")
    totals = rows.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    joined = common.spread_join(rows, totals.drop("n"), ["of"], common.hot_keys(totals.drop("label_error"), "n"), "vec_id")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by a join of all parts with all entries, a round after another."""
    steps = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (SELECT r, k, v[k * len(v) // {parts} + 1 : (k + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) AS q(k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS e, v FROM p WHERE r <= {entries})"""
    near = "(SELECT p.r, p.k, p.v, arg_min({{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}, {{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS x FROM p JOIN b{i} b ON p.k = b.k GROUP BY ALL)"
    for i in range(rounds):
        steps += f""",
m{i} AS MATERIALIZED (
  SELECT k, e, list(c ORDER BY j) AS v FROM (
    SELECT k, x.e AS e, j, (sum(v[j])::BIGINT - ((sum(v[j])::BIGINT % count(*) + count(*)) % count(*))) // count(*) AS c FROM {near.format(i=i)}, range(1, len(v) + 1) AS q(j) GROUP BY ALL
  ) GROUP BY k, e
),
b{i + 1} AS MATERIALIZED (SELECT k, e, coalesce(m{i}.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} USING (k, e))"""
    return steps + f""",
f AS MATERIALIZED {near.format(i=rounds)},
c AS (SELECT r, string_agg(format('{{:02x}}', x.e), '' ORDER BY k) AS code, sum(x.d)::BIGINT AS error FROM f GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN c USING (r), s
"""


OP13_SQL = sql()
