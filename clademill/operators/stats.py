"""Summary statistics: the tables behind histograms, bars and scatter plots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.storage import stored


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def bucket(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin (from 0) of equal width; the upper edge belongs to the last bin."""
    at = F.floor((x - low) / (high - low) * bins)
    return F.when(high == low, F.lit(0)).otherwise(F.least(at, F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin and n between the least and the largest value; one pass for the range, one for the counts."""
    edge = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(bucket(F.col(column), F.col("__low"), F.col("__high"), bins).alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    edge = df.agg(*(f(c).alias(f"__{n}{c}") for c in (x, y) for n, f in (("low", F.min), ("high", F.max))))
    at = [bucket(F.col(c), F.col(f"__low{c}"), F.col(f"__high{c}"), bins).alias(f"{a}bin") for a, c in (("x", x), ("y", y))]
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(*at).agg(F.count("*").alias("n"))


def quantile_prefix(df: DataFrame, column: str, q: float, keys: list[str], ties: list[str]) -> DataFrame:
    """The lowest ceil(q * n) rows of each group."""
    own = Window.partitionBy(*keys)
    place = F.row_number().over(own.orderBy(column, *ties))
    return df.withColumns({"__place": place, "__n": F.count("*").over(own)}).where(F.col("__place") <= F.ceil(F.lit(q) * F.col("__n"))).drop("__place", "__n")


def trimmed_mean(df: DataFrame, column: str, keys: list[str], ties: list[str], drop: int = 5, floor: float = 2.0) -> DataFrame:
    """Mean of all but the `drop` largest values of each group, at least `floor`."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(column).desc(), *ties))
    kept = df.withColumn("__place", place)
    return kept.groupBy(*keys).agg(F.greatest(F.coalesce(F.avg(F.when(F.col("__place") > drop, F.col(column))), F.lit(floor)), F.lit(floor)).alias("mean"))


def spread(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Mean, population deviation and distance between the quartiles (linear interpolation)."""
    quartiles = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), (F.element_at(quartiles, 2) - F.element_at(quartiles, 1)).alias("iqr"))


def cascade(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet the first condition, the first two, and so on; one scan."""
    met, out = F.lit(True), [F.count("*").alias("every")]
    for name, condition in conditions.items():
        met = met & condition
        out.append(F.count_if(met).alias(name))
    return df.agg(*out)


def ranked_subjects(df: DataFrame, subject: str, query: str) -> DataFrame:
    """Subjects and how many queries hit them."""
    return df.groupBy(subject).agg(F.countDistinct(query).alias("hitnum"))


def principal_components(df: DataFrame, row: str, column: str, k: int = 2, more: int = 8, rounds: int = 30, tolerance: float = 1e-10) -> DataFrame:
    """Coordinates of the rows of a 0/1 membership table on the first k components (pc1, pc2, ...), by a block Krylov iteration.

    A round takes a block of k + more vectors over the rows through the centred table and its transpose, as two joins with
    sums, and keeps what is new in it; a row holds its entries of all blocks. Sums of products of blocks, of a size that the
    rounds bound, reach the driver. It ends when what the components leave over is below `tolerance` of the first one's
    eigenvalue. Signs are made positive at the largest entry; a component that the table hasn't is 0.
    """
    own = stored(df.select(F.col(row).alias("a"), F.col(column).alias("c")).where("a is not null and c is not null").distinct(), "members")
    n, size = own.select("a").distinct().count(), k + more
    kind = dict(own.dtypes)["a"]

    def sums(table: DataFrame, function, *names: str) -> np.ndarray:
        """function(rows x numbers of each column) of all rows, added up: rows of fixed number to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    found = function(*(_matrix(batch.column(c)) for c in names)).ravel()
                    total = found if total is None else total + found
            if total is not None:
                yield pa.record_batch({"i": np.arange(len(total)), "x": total})

        found = table.select(*names).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        return np.array([r.x for r in found])

    def changed(table: DataFrame, function, name: str) -> DataFrame:
        """a and, of the row's numbers, what function makes of (basis, name)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    out = [function(_matrix(batch.column("basis")), _matrix(batch.column(name)))]
                    yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("basis"), *(pa.array([*x], pa.list_(pa.float64())) for x in out)], names=["a", "basis", "y"])

        return stored(table.select("a", "basis", name).mapInArrow(run, f"a {kind}, basis array<double>, y array<double>"), "krylov")

    each = [F.sum(F.get("q", F.lit(j))).alias(f"s{j}") for j in range(size)]
    start = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.xxhash64("a", j) / 2.0**63)
    now = stored(own.select("a").distinct().select("a", F.array().cast("array<double>").alias("basis"), start.alias("y")), "krylov")
    blocks: list[np.ndarray] = []  # of the projected table: for each round, basis' product with what the round's block became
    best = np.zeros((0, k))
    for _ in range(rounds if n else 0):
        gram = sums(now, lambda y: y.T @ y, "y")
        width = round(len(gram) ** 0.5)
        values, vectors = np.linalg.eigh(gram.reshape(width, width))
        largest = max(values[-1], 0.0)
        scale = blocks[0].max() if blocks else largest
        good = values > 1e-20 * max(scale, 1e-300) ** (2 if blocks else 1)
        if blocks:  # what the first components leave over
            square = _projected(blocks)
            theta, s = np.linalg.eigh(square)
            first = np.argsort(-theta)[:k]
            best = s[:, first] * np.sqrt(np.maximum(theta[first], 0))
            rest = np.sqrt(np.maximum(0, np.einsum("ij,ik,kj->j", s[-width:, first], gram.reshape(width, width), s[-width:, first])))
            if rest.max() <= tolerance * max(theta[first[0]], 1e-300) or not good.any():
                break
        turn = vectors[:, good] / np.sqrt(values[good])
        now = changed(now, lambda basis, y, turn=turn: np.hstack([basis, y @ turn]) if basis.size else y @ turn, "y").select("a", F.col("y").alias("basis"))
        new = turn.shape[1]
        # the block through the table and back
        block = now.select("a", F.slice("basis", -new, new).alias("q"))
        total = sums(block, lambda q: q.sum(0), "q")
        joined = own.join(block, "a").groupBy("c").agg(F.count("*").alias("n"), *each[:new])
        w = F.array(*(F.col(f"s{j}") - F.col("n") / n * float(total[j]) for j in range(new)))
        w = stored(joined.select("c", (F.col("n") / n).alias("mean"), w.alias("q")), "columns")
        shift = sums(w.select("q", F.array("mean").alias("mean")), lambda q, m: m.T @ q, "q", "mean")
        back = own.join(w, "c").groupBy("a").agg(*each[:new])
        y = F.array(*(F.col(f"s{j}") - float(shift[j]) for j in range(new)))
        now = stored(now.join(back.select("a", y.alias("z")), "a"), "krylov")
        # less what the basis has of it, twice for the digits that the first time loses
        held = 0.0
        for name in ("z", "y"):
            part = sums(now, lambda basis, z: basis.T @ z, "basis", name)
            part = part.reshape(-1, new)
            held = held + part
            now = changed(now, lambda basis, z, part=part: z - basis @ part, name)
        blocks.append(held)
    else:
        if blocks:
            theta, s = np.linalg.eigh(_projected(blocks))
            first = np.argsort(-theta)[:k]
            best = s[:, first] * np.sqrt(np.maximum(theta[first], 0))
    best = np.hstack([best, np.zeros((len(best), k - best.shape[1]))])
    names = [f"pc{i + 1}" for i in range(k)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _matrix(batch.column("basis"))[:, : len(best)] @ best
                yield pa.RecordBatch.from_arrays([batch.column("a"), *(pa.array(x) for x in found.T)], names=["a", *names])

    out = stored(now.select("a", "basis").mapInArrow(placed, f"a {kind}, " + ", ".join(f"{c} double" for c in names)), "components")
    top = out.agg(*(F.max_by(F.struct(c), F.struct(F.abs(F.col(c)), F.col("a")))[c].alias(c) for c in names)).first()
    return out.select(F.col("a").alias(row), *((F.col(c) * (-1.0 if (top[c] or 0) < 0 else 1.0)).alias(c) for c in names))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _projected(blocks: list[np.ndarray]) -> np.ndarray:
    """The symmetric matrix of which blocks are the columns on and above the diagonal."""
    out = np.zeros((len(blocks[-1]), len(blocks[-1])))
    at = 0
    for block in blocks:
        rows, width = block.shape
        out[:rows, at : at + width] = block
        out[at : at + width, :rows] = block.T
        at += width
    return out


def extreme_counts(df: DataFrame, keys: list[str], value: str, conditions: dict[str, Column]) -> DataFrame:
    """How many groups meet each condition on their least (low) and greatest (high) value, and how many there are."""
    own = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return own.agg(F.count("*").alias("groups"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def with_attributes(ranked: DataFrame, key: str, *attributes: DataFrame) -> DataFrame:
    """A ranking with what other tables know of its keys; what they don't know is null."""
    for table in attributes:
        ranked = ranked.join(table, key, "left")
    return ranked
