"""Quality rules: an isolation forest on rule statistics, after two fixed rules.

The statistics of a text come from its words (runs of anything but space and U+0009 to U+000D) and its lines. Two fixed
rules fail a text at once. A forest of random splits is then fitted to the statistics of labelled good rows; a text
whose mean path is short is an anomaly. The threshold is the one that costs least on labelled rows that the forest has not
seen, where the share of good rows rejected counts COST times that of bad rows kept: FOLDS forests, each of the other
folds' rows, score one fold each, and the forest that judges is fitted to all. Ranges, scores and the threshold are those of
every labelled row; a tree holds TREE_ROWS rows, as the method has it, and each tree draws its own from all good ones. Trees
grow in tasks; what reaches the driver are their nodes and sums, of fixed size. Windows of words are compared as such, so the
counts are exact.

Null and empty texts have no words and fail the first rule. Without labels (of less than LEAST good rows) the forest is
fitted to all documents and rejects nothing. Ties and repeated rows get equal verdicts. An empty table gives an empty result.
Columns other than the id and the text are not read, or are kept as they are (kept_documents).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SYMBOLS, WINDOW, MIN_WORDS, REPEAT_PERCENT = "#*$%&|<>", 8, 20, 30
TREES, TREE_ROWS, COST, SEED, FOLDS, LEAST = 200, 256, 50, 7, 4, 8
#: Rows that a tree's draw expects, so that it hardly ever has less than TREE_ROWS, of which the lowest hashes stay; parts of the range of scores.
DRAWN, BINS = TREE_ROWS + 6 * math.isqrt(TREE_ROWS), 1 << 16
SYMBOL_BYTES = [c.encode() for c in SYMBOLS]
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(1, WINDOW + 1)], np.uint64)
UPPER, DIGITS, MARKS = (np.array([chr(c).isupper() and c < 128 if k == 0 else chr(c).isdigit() and c < 128 if k == 1 else c in b".,;:!?\"'()-" for c in range(256)]) for k in range(3))


def repeated(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    h = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    mixed, rolled = h.astype(np.uint64) * POWERS[0], np.zeros(n, np.uint64)
    mixed ^= mixed >> np.uint64(29)
    for k in range(WINDOW):
        rolled += mixed[k : k + n] * POWERS[k]
    order = np.argsort(rolled, kind="stable")
    same = np.flatnonzero(rolled[order][1:] == rolled[order][:-1])
    if not same.size:
        return 0
    window = np.arange(WINDOW)
    a, b = order[same], order[same + 1]
    if not (h[a[:, None] + window] == h[b[:, None] + window]).all():  # two windows of one sum: compare them all
        every = h[np.arange(n)[:, None] + window]
        _, rolled, times = np.unique(every, axis=0, return_inverse=True, return_counts=True)
        twice = times[rolled.ravel()] > 1
    else:
        twice = np.zeros(n, bool)
        twice[a] = twice[b] = True
    edges = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode()
    words = raw.split()  # of bytes, at exactly the white space named above
    blank = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (
        len(words), len(text) - blank, sum(map(raw.count, SYMBOL_BYTES)), len(lines) - len({*lines}), repeated(words),
        len(lines), int(counts[UPPER].sum()), int(counts[DIGITS].sum()), int(counts[MARKS].sum()),
    )


def failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > REPEAT_PERCENT * stats[:, 0])


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios of the statistics, which texts of all lengths have alike."""
    s = stats.astype(float)
    words, chars, lines = (np.maximum(s[:, k], 1) for k in (0, 1, 5))
    return np.column_stack([s[:, 1] / words, s[:, 2] / words, s[:, 3] / lines, s[:, 4] / words, s[:, 6] / chars, s[:, 7] / chars, s[:, 8] / words])


def usual_path(n: int) -> float:
    """Mean length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Nodes of all trees in one array each; a leaf has no feature (-1), and its value is the path it stands for."""

    roots: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: int
    usual: float
    threshold: float = math.inf

    @classmethod
    def fit(cls, x: np.ndarray, box: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int | list[int] = SEED) -> Forest:
        """x: rows taken for normal. box: rows whose range the splits may fall in, so that what lies outside x is cut off soon."""
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        depth = 2 * max(1, math.ceil(math.log2(max(rows, 2))))
        outer = (box.min(0), box.max(0)) if len(box) else (np.zeros(0), np.zeros(0))
        feature, value, left, roots = [], [], [], []

        def new() -> int:
            feature.append(-1)
            value.append(0.0)
            left.append(0)
            return len(feature) - 1

        for _ in range(trees):
            roots.append(new())
            todo = [(roots[-1], x[rng.choice(len(x), rows, replace=False)] if rows else x, 0, *outer)]
            while todo:
                node, part, d, low, high = todo.pop()
                split = np.flatnonzero(high > low)
                if d == depth or len(part) < 2 or not split.size:
                    value[node] = d + usual_path(len(part))
                    continue
                f = int(rng.choice(split))
                cut = rng.uniform(low[f], high[f])
                feature[node], value[node], left[node] = f, cut, new()
                new()
                below = part[:, f] < cut
                inner, rest = high.copy(), low.copy()
                inner[f] = rest[f] = cut
                todo += [(left[node], part[below], d + 1, low, inner), (left[node] + 1, part[~below], d + 1, rest, high)]
        return cls(np.array(roots), np.array(feature), np.array(value), np.array(left), depth, usual_path(rows) or 1.0)

    @classmethod
    def of(cls, trees: list[dict], rows: int) -> Forest:
        """A forest of trees (feature, value, left of one tree each) that hold so many rows each."""
        starts = np.cumsum([0, *(len(t["feature"]) for t in trees)])[:-1]
        feature, value = (np.concatenate([t[c] for t in trees]) for c in ("feature", "value"))
        left = np.concatenate([np.asarray(t["left"]) + at for t, at in zip(trees, starts)])
        return cls(starts, feature, value, left, 2 * max(1, math.ceil(math.log2(max(rows, 2)))), usual_path(rows) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; high for rows that few splits set apart."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[every, np.maximum(f, 0)] >= self.value[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.value[at]
        return 2.0 ** (-total / len(self.roots) / self.usual)


def calibrated(good: np.ndarray, bad: np.ndarray, cost: float = COST) -> float:
    """The threshold at which good rows lost (times cost) and bad rows kept are fewest, as shares; of scores in arrays (cheapest: of a table's)."""
    if not good.size or not bad.size:
        return math.inf
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1e-6)
    lost = 1 - np.searchsorted(np.sort(good), cuts, "right") / good.size
    kept = np.searchsorted(np.sort(bad), cuts, "right") / bad.size
    return float(cuts[(cost * lost + kept).argmin()])


def cheapest(scores: DataFrame, cost: float = COST) -> float:
    """The threshold of calibrated, from a table of score and good: sums within BINS parts of the range, and of the parts before."""
    counts = scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counts = common.stored(counts.withColumn("bin", F.floor(F.col("score") * BINS)), "scores")
    n = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not n.good or not n.bad:
        return math.inf
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS + 1 rows at most
    sums = counts.groupBy("bin").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    before = sums.select("bin", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in "gb"))
    so_far = Window.partitionBy("bin").orderBy("score")
    below = counts.join(F.broadcast(before), "bin").select("score", *((F.col(a) + F.sum(c).over(so_far)).alias(c) for a, c in (("g", "good"), ("b", "bad"))))
    value = F.lit(float(cost)) * (1 - F.col("good") / n.good) + F.col("bad") / n.bad
    best = below.agg(F.min(F.struct(value.alias("cost"), "score")).alias("m")).first().m.score
    after = counts.where(F.col("score") > best).agg(F.min("score").alias("m")).first().m
    return best + 1e-6 if after is None else (best + after) / 2


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])

    return common.python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def rated(known: DataFrame) -> DataFrame:
    """key, fold, good and x (the features) of the rows of doc_id, STATS and good that pass the fixed rules, stored."""
    key, fold = F.xxhash64("doc_id", *STATS).alias("key"), F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.column_stack([np.asarray(batch.column(c)) for c in STATS])
            x = pa.array([*features(stats)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "fold", "good")), x], names=["key", "fold", "good", "x"]).filter(pa.array(~failed(stats)))

    return common.stored(common.python(known.select(key, fold, "good", *STATS), run, "key long, fold int, good boolean, x array<double>"), "rated")


def matrix(x: pa.Array) -> np.ndarray:
    return np.asarray(x.flatten()).reshape(len(x), -1)


def forests(rows: DataFrame, boxes: list[np.ndarray], counts: list[int]) -> list[Forest]:
    """A forest for each box (least and greatest features): number k of the good rows of all folds but k, so that one beyond the folds is of all.

    counts: how many rows each has. A tree takes the TREE_ROWS rows with its own lowest hashes, and grows in a task.
    """
    limits = [int(min(1, DRAWN / max(n, 1)) * 2**64) - 1 for n in counts]
    width = boxes[0].shape[1]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                key, fold = np.asarray(part.column("key")).view(np.uint64), np.asarray(part.column("fold"))
                for k, limit in enumerate(limits):
                    own = np.flatnonzero(fold != k)
                    mixed = key[own, None] ^ np.random.default_rng([SEED, k]).integers(0, 2**64, TREES, np.uint64)
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
                    mixed ^= mixed >> np.uint64(31)
                    r, t = np.nonzero(mixed <= np.uint64(limit))
                    columns = [np.full(len(r), k, np.int32), t.astype(np.int32), (mixed[r, t] >> np.uint64(1)).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), part.column("x").take(pa.array(own[r]))], names=["forest", "tree", "hash", "x"])

    def grow(part: pa.Table) -> pa.Table:
        k, tree, x = part["forest"][0].as_py(), part["tree"][0].as_py(), matrix(part["x"].combine_chunks())
        x = x[np.lexsort([*x.T, np.asarray(part["hash"])])][:TREE_ROWS]
        one = Forest.fit(x, boxes[k], trees=1, seed=[SEED, k, tree])
        return pa.table({"forest": pa.array([k], pa.int32()), "tree": pa.array([tree], pa.int32()), "feature": [one.feature.astype(np.int32)], "value": [one.value], "left": [one.left.astype(np.int32)]})

    drawn = common.python(rows.where("good").select("key", "fold", "x"), draw, "forest int, tree int, hash long, x array<double>")
    grown = drawn.groupBy("forest", "tree").applyInArrow(grow, "forest int, tree int, feature array<int>, value array<double>, left array<int>").toArrow().sort_by([("forest", "ascending"), ("tree", "ascending")])
    out, forest = [], np.asarray(grown["forest"])
    for k, n in enumerate(counts):
        trees = [{c: grown[c][int(i)].values.to_numpy() for c in ("feature", "value", "left")} for i in np.flatnonzero(forest == k)]
        out.append(Forest.of(trees, min(n, TREE_ROWS)) if trees else Forest.fit(np.zeros((0, width)), boxes[k]))
    return out


def bounds(rows: DataFrame) -> list[tuple]:
    """fold, number of good rows, the least and the greatest features; of each fold that has rows."""
    width = range(features(np.zeros((1, len(STATS)), np.int64)).shape[1])
    least, greatest = (F.array(*(f(F.col("x")[k]) for k in width)) for f in (F.min, F.max))
    return [(r.fold, r.good, np.array(r.least), np.array(r.greatest)) for r in rows.groupBy("fold").agg(F.count_if("good").alias("good"), least.alias("least"), greatest.alias("greatest")).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    """A forest and its threshold from all labelled rows."""
    return fitted(measured(docs), labels)


def fitted(stats: DataFrame, labels: DataFrame) -> Forest:
    """fit, of doc_id and STATS of every text."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    # one row for each id and label, whatever rows repeat
    own = stats.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*STATS)).alias("s"))
    rows = rated(own.select("doc_id", (F.col("quality") == 1).alias("good"), "s.*"))
    folds = bounds(rows)
    labelled = sum(n for _, n, _, _ in folds) >= LEAST
    if not labelled:
        rows = rated(stats.withColumn("good", F.lit(True)))
        folds = bounds(rows)
    width = features(np.zeros((0, len(STATS)), np.int64)).shape[1]
    seen = [[f for f in folds if f[0] != k] for k in range(FOLDS + 1)]
    boxes = [np.array([np.min([f[2] for f in s], 0), np.max([f[3] for f in s], 0)]) if s else np.zeros((0, width)) for s in seen]
    counts = [sum(f[1] for f in s) for s in seen]
    if not labelled:
        return forests(rows.withColumn("fold", F.lit(-1)), boxes[-1:], counts[-1:])[0]
    *others, forest = forests(rows, boxes, counts)
    held = rows.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold, scores = matrix(batch.column("x")), np.asarray(batch.column("fold")), np.zeros(batch.num_rows)
            for k in np.unique(fold):
                scores[fold == k] = held.value[k].score(x[fold == k])
            yield pa.RecordBatch.from_arrays([pa.array(scores), batch.column("good")], names=["score", "good"])

    forest.threshold = cheapest(common.python(rows.select("fold", "good", "x"), run, "score double, good boolean"))
    return forest


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, STATS, base_failed, score and kept of every text."""
    return judged_statistics(measured(docs), forest)


def judged_statistics(stats: DataFrame, forest: Forest) -> DataFrame:
    """judged, of doc_id and STATS of every text."""
    model = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.column_stack([np.asarray(batch.column(c)) for c in STATS])
            base, score = failed(own), model.value.score(features(own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base), pa.array(score), pa.array(~base & (score <= model.value.threshold))], names=[*batch.schema.names, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, score double, kept boolean"
    return common.python(stats, run, schema)


def kept_documents(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(forest)
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t) for t in batch.column(k).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield batch.filter(pa.array(~failed(stats) & (model.value.score(features(stats)) <= model.value.threshold)))

    return common.python(docs, run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.stored(measured(common.read(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    forest = fitted(stats, common.read(spark, sf_dir, "labels"))
    return judged_statistics(stats, forest).select("doc_id", *STATS[:5], "base_failed", "kept", F.round("score", 6).alias("score"))
