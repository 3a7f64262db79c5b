"""From local alignments (HSPs) to hits and best-hit graphs."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.operators.intervals import union_length

E_VALUE, COVERAGE, OVERLAP = 1e-10, 0.5, 0.5


def subject_cutoff(hsps: DataFrame, query: Sequence[str] = ("qppid", "sspid"), subject: str = "sppid", gene: str = "sgnid", score: str = "bitscore") -> DataFrame:
    """HSPs of the subjects that beat the best subject of any gene but the best.

    The best gene, or all genes tied for it, set no bar; the highest score of the others does.
    """
    best = hsps.groupBy(*query, subject, gene).agg(F.max(score).alias("__m"))
    every, own = Window.partitionBy(*query), Window.partitionBy(*query, gene)
    best = best.withColumn("__top", F.max("__m").over(own) == F.max("__m").over(every))
    bar = F.coalesce(F.max(F.when(~F.col("__top"), F.col("__m"))).over(every), F.lit(0.0))
    above = best.withColumn("__bar", bar).where(F.col("__m") > F.col("__bar")).select(*query, subject, gene)
    return hsps.join(above, [*query, subject, gene], "left_semi")


class _Axis:
    """Accepted intervals of one sequence, by start. As any two overlap by little at most, none holds another, and their ends
    are in the same order: those that a new one meets stand together."""

    def __init__(self):
        self.starts, self.ends = [], []

    def met(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        for i in range(bisect_left(self.ends, start), bisect_right(self.starts, end)):
            yield self.starts[i], self.ends[i]

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def _little(start: int, end: int, other: tuple[int, int], share: float) -> bool:
    """Whether two intervals that meet overlap by less than a share of each; one of a single position never does."""
    both = min(end, other[1]) - max(start, other[0])
    return all(b > a and both < share * (b - a) for a, b in ((start, end), other))


def accepted(places: Iterable[int], spans: Sequence[tuple[tuple[int, int], tuple[int, int]]], share: float) -> tuple[set[int], set[int]]:
    """Of spans (start and end in both sequences) in their order, those that meet no accepted one, and with these all that a second
    pass adds because they overlap those accepted so far by little. A span is looked up in sorted lists, so that n of them
    take about n log n steps. Spans that end before they start meet nothing and are never accepted."""
    axes, apart = (_Axis(), _Axis()), set()
    places = [i for i in places if all(a <= b for a, b in spans[i])]
    for i in places:
        if not any(True for axis, span in zip(axes, spans[i]) for _ in axis.met(*span)):
            apart.add(i)
            for axis, span in zip(axes, spans[i]):
                axis.add(*span)
    every = set(apart)
    for i in places:
        if i not in every and all(_little(*span, other, share) for axis, span in zip(axes, spans[i]) for other in axis.met(*span)):
            every.add(i)
            for axis, span in zip(axes, spans[i]):
                axis.add(*span)
    return apart, every


def marked(hsps: DataFrame, keys: Sequence[str] = ("qppid", "sppid"), score: str = "bitscore", order: Sequence[str] = ("qstart", "sstart"), e_value: float = E_VALUE, overlap: float = OVERLAP) -> DataFrame:
    """One row for each pair: hsps, an array by descending score (ties by `order`) with index_hsp, disjoint and compatible.

    An HSP is disjoint if it overlaps no disjoint one before it in either sequence and its E-value is low enough. A second
    pass adds HSPs that overlap those accepted so far by little (overlap: less than this share of both, 1 at most); all
    accepted ones are compatible.
    """
    if not 0 < overlap <= 1:
        raise ValueError("overlap has to be above 0 and 1 at most")
    rest = [c for c in hsps.columns if c not in keys]
    item = F.struct((-F.col(score)).alias("__by"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)), *rest)
    one = hsps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in rest))).alias("hsps"))
    kind = dict(one.dtypes)
    ends = ("qstart", "qend", "sstart", "send")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for own in batch.column("hsps"):
                low = own.values.field("evalue").to_pylist()
                spans = [((a, b), (c, d)) for a, b, c, d in zip(*(own.values.field(c).to_pylist() for c in ends))]
                able = [i for i, (x, span) in enumerate(zip(low, spans)) if x is not None and x <= e_value and None not in (*span[0], *span[1])]
                apart, every = accepted(able, spans, overlap)
                flags.append(([i in apart for i in range(len(low))], [i in every for i in range(len(low))]))
            lists = [pa.array([f[k] for f in flags], pa.list_(pa.bool_())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "__d", "__c"])

    found = one.mapInArrow(run, ", ".join(f"`{c}` {kind[c]}" for c in (*keys, "hsps")) + ", __d array<boolean>, __c array<boolean>")
    flags = F.transform("hsps", lambda x, i: F.struct(*(x[c].alias(c) for c in rest), (i == 0).alias("index_hsp"), F.get("__d", i).alias("disjoint"), F.get("__c", i).alias("compatible")))
    return found.select(*keys, flags.alias("hsps"))


def hits(pairs: DataFrame, keys: Sequence[str] = ("qppid", "sppid"), score: str = "bitscore") -> DataFrame:
    """A hit for each pair of marked() with a compatible HSP: counts, aligned lengths, union coverages and summed score."""
    ok, apart = F.filter("hsps", lambda x: x["compatible"]), F.filter("hsps", lambda x: x["disjoint"])

    def covered(axis: str) -> Column:
        return union_length(F.transform(ok, lambda x: F.struct(x[f"{axis}start"].alias("start"), x[f"{axis}end"].alias("stop"))))

    def length(axis: str) -> Column:
        return F.aggregate(apart, F.lit(0).cast("long"), lambda acc, x: acc + (x[f"{axis}end"] - x[f"{axis}start"] + 1).cast("long"))

    total = F.aggregate(apart, F.lit(0.0), lambda acc, x: acc + x[score].cast("double"))
    return pairs.where(F.exists("hsps", lambda x: x["compatible"])).select(
        *keys, F.size(apart).alias("hspnum"), F.size(ok).alias("chspnum"), length("q").alias("nqa"), covered("q").alias("cnqa"), length("s").alias("nsa"), covered("s").alias("cnsa"), total.alias(score),
    )


def best_hits(table: DataFrame, per: Sequence[str] = ("qppid", "sspid"), score: str = "bitscore", covered: Column | None = None) -> DataFrame:
    """All hits that share the highest score of their group; then, of these, those with enough coverage."""
    top = table.withColumn("__top", F.max(score).over(Window.partitionBy(*per))).where(F.col(score) == F.col("__top")).drop("__top")
    return top if covered is None else top.where(covered)


def with_reciprocity(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges with reciprocal: whether the table has the opposite edge too."""
    back = edges.select(F.col(dst).alias(src), F.col(src).alias(dst)).distinct().withColumn("__back", F.lit(True))
    return edges.join(back, [src, dst], "left").withColumn("reciprocal", F.coalesce("__back", F.lit(False))).drop("__back")


def mirrored(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each edge in both directions."""
    swapped = {src: dst, dst: src}
    return edges.union(edges.select(*(F.col(swapped.get(c, c)).alias(c) for c in edges.columns)))


def derived_hsp_columns(hsps: DataFrame) -> DataFrame:
    """Identity, aligned lengths and shares, and the logarithm of the E-value (-180 for 0)."""
    return hsps.withColumns({
        "pident": F.col("nident") / F.col("length"), "nqa": F.col("qend") - F.col("qstart") + 1, "fqa": (F.col("qend") - F.col("qstart") + 1) / F.col("qlen"),
        "nsa": F.col("send") - F.col("sstart") + 1, "fsa": (F.col("send") - F.col("sstart") + 1) / F.col("slen"), "logevalue": F.when(F.col("evalue") > 0, F.log10("evalue")).otherwise(-180.0),
    })


def derived_hit_columns(table: DataFrame) -> DataFrame:
    """Shares of the sequences that are aligned, and what compatible HSPs add to disjoint ones."""
    return table.withColumns({
        "fqa": F.col("nqa") / F.col("qlen"), "fsa": F.col("nsa") / F.col("slen"), "cfqa": F.col("cnqa") / F.col("qlen"),
        "xfqa": F.col("cnqa") / F.col("qlen") - F.col("nqa") / F.col("qlen"), "xhspnum": F.col("chspnum") - F.col("hspnum"),
    })
