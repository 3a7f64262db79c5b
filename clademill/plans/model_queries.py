"""Queries whose core is a computation on trees, profiles or hidden chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clademill.functions.special import beta_binomial, beta_binomial_slopes, gammainc, geometric_threshold
from clademill.operators import hmm, msa, regions, trees, trims
from clademill.plans import tree_sql
from clademill.plans.inputs import PROFILE_SQL, profile, symbols, table
from clademill.sources import files, newick
from clademill.storage import shared_dir, stored

QUERIES, SQL = {}, {}
TREE = "(((1:1,2:1):0.5,(3:1,4:0.8):0.6):0.7,((5:0.9,6:1.1):0.4,7:1.2):0.3);"
PARAMS = {"q0": 0.6, "q1": 0.9, "pi": 0.7, "p0": 0.02, "p1": 0.05, "pinv": 0.2, "alpha": 0.8}
STATES = [{**PARAMS, "a": 3.0, "b": 0.5}, {**PARAMS, "a": 0.8, "b": 1.2, "pi": 0.5}, {**PARAMS, "a": 1.5, "b": 0.8, "pi": 0.2}]
START, MOVE = np.array([0.6, 0.2, 0.2]), np.array([[0.95, 0.03, 0.02], [0.05, 0.9, 0.05], [0.04, 0.03, 0.93]])


def query(f, sql: str | None = None):
    if isinstance(f, str):
        return lambda g: query(g, f)
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql
    return f


# A tree of three or four tips for each part, with lengths from its numbers.
LENGTHS_SQL = "t AS (SELECT p_partkey AS k, p_size AS x, p_partkey % 7 + 1 AS y, p_partkey % 5 + 1 AS z, p_partkey % 11 + 1 AS w, p_partkey % 4 AS b, p_size % 3 AS a, sqrt(p_retailprice) AS c FROM part)"


def _trees(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """tree_id and newick of each part's tree, with the part's row."""
    p = table(spark, sf_dir, "part").withColumns({"x": F.col("p_size"), "y": F.col("p_partkey") % 7 + 1, "z": F.col("p_partkey") % 5 + 1, "w": F.col("p_partkey") % 11 + 1})
    return p.withColumn("newick", F.format_string(form, "x", "y", "z", "w"))


@query(f"""WITH {LENGTHS_SQL}, u AS (SELECT *, z + x * y / (x + y)::DOUBLE AS v FROM t), r AS (SELECT *, (1 / v) / (1 / v + 1 / w) AS share FROM u)
SELECT k AS p_partkey, tip, round(CASE tip WHEN 'A' THEN share * y / (x + y) WHEN 'B' THEN share * x / (x + y) ELSE 1 - share END, 12) AS weight FROM r, (SELECT unnest(['A', 'B', 'C']) AS tip)""")
def tree_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tip's weight in the root value of its tree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, tip, w) for k, text in zip(frame["p_partkey"], frame["newick"]) for tip, w in trees.brownian_weights(newick.parse(text)).items()]
            yield pd.DataFrame(found, columns=["p_partkey", "tip", "weight"])

    own = _trees(spark, sf_dir, "((A:%1$s,B:%2$s):%3$s,C:%4$s);").select("p_partkey", "newick").mapInPandas(run, "p_partkey long, tip string, weight double")
    return own.withColumn("weight", F.round("weight", 12))


@query(f"""WITH {LENGTHS_SQL}, two AS (SELECT k, unnest(['A', 'A', 'A', 'B', 'B', 'C']) AS one, unnest(['A', 'B', 'C', 'B', 'C', 'C']) AS other, unnest([z + x, z, 0, z + y, 0, w]) AS shared FROM t)
SELECT k AS p_partkey, one, other, shared::DOUBLE AS shared FROM two""")
def tree_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of path from the root that each two tips of a tree share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, text in zip(frame["p_partkey"], frame["newick"]):
                names, cov = trees.brownian_covariance(newick.parse(text))
                out += [(k, names[i], names[j], cov[i, j]) for i in range(len(names)) for j in range(i, len(names))]
            yield pd.DataFrame(out, columns=["p_partkey", "one", "other", "shared"])

    return _trees(spark, sf_dir, "((A:%1$s,B:%2$s):%3$s,C:%4$s);").select("p_partkey", "newick").mapInPandas(run, "p_partkey long, one string, other string, shared double")


@query(f"""WITH {LENGTHS_SQL}, u AS (SELECT *, z + x * y / (x + y)::DOUBLE AS v, (a * y + b * x) / (x + y)::DOUBLE AS ab FROM t)
SELECT k AS p_partkey, round((ab * w + c * v) / (v + w), 6) AS root, round((a - b) / sqrt(x + y), 6) AS first, round((ab - c) / sqrt(v + w), 6) AS second FROM u""")
def tree_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root value and independent contrasts of a trait on each tree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                root, (first, second) = trees.contrasts(newick.parse(row.newick), {"A": row.p_size % 3, "B": row.p_partkey % 4, "C": row.p_retailprice**0.5})
                out.append((row.p_partkey, float(root), float(first), float(second)))
            yield pd.DataFrame(out, columns=["p_partkey", "root", "first", "second"])

    own = _trees(spark, sf_dir, "((A:%1$s,B:%2$s):%3$s,C:%4$s);").select("p_partkey", "p_size", "p_retailprice", "newick")
    found = own.mapInPandas(run, "p_partkey long, root double, first double, second double")
    return found.select("p_partkey", *(F.round(c, 6).alias(c) for c in ("root", "first", "second")))


@query(f"""WITH {LENGTHS_SQL} SELECT k::VARCHAR AS tree_id, i AS node_id, CASE i WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 4 END AS parent_id, CASE i WHEN 0 THEN 'A' WHEN 1 THEN 'B b' WHEN 3 THEN 'C' END AS name,
CASE i WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN z WHEN 3 THEN w END::DOUBLE AS length, CASE i WHEN 2 THEN 0.75 END::DOUBLE AS support FROM t, range(5) r(i)""")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newick text written again and read as a table of nodes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [r for k, text in zip(frame["p_partkey"], frame["newick"]) for r in newick.rows(str(k), newick.parse(newick.write(newick.parse(text))))]
            own = pd.DataFrame(out, columns=["tree_id", "node_id", "parent_id", "name", "length", "support"])
            yield own.astype({"parent_id": "Int64"})

    own = _trees(spark, sf_dir, "((A:%1$s,'B b':%2$s)0.75:%3$s,C:%4$s);").select("p_partkey", "newick")
    return own.mapInPandas(run, "tree_id string, node_id long, parent_id long, name string, length double, support double")


@query(f"""WITH {LENGTHS_SQL} SELECT k AS p_partkey, CASE WHEN k % 2 = 0 THEN '(A:' || x || '.0,B:' || y || '.0,C:' || z + w || '.0);' ELSE '(A:' || x || '.0,B:' || y || '.0,(C:' || w || '.0,D:3.0):' || z || '.0);' END AS text FROM t""")
def rerooted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with the parent of one tip as root, children in their order; a root of two children goes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"p_partkey": frame["p_partkey"], "text": [newick.write(newick.ordered(newick.rooted_at(newick.parse(t), "A"))) for t in frame["newick"]]})

    two, three = (_trees(spark, sf_dir, form).select("p_partkey", "newick") for form in ("(C:%4$s,(B:%2$s,A:%1$s):%3$s);", "((B:%2$s,A:%1$s):%3$s,D:3,C:%4$s);"))
    return two.where("p_partkey % 2 = 0").union(three.where("p_partkey % 2 = 1")).mapInPandas(run, "p_partkey long, text string")


def _tips(part: pd.DataFrame) -> tuple[newick.Node, dict[str, np.ndarray], int]:
    """The tree on a group's rows, and their gap states as tips; rows shorter than the longest are padded with gaps."""
    names, residues = _residues(part["ppid"].to_numpy(), part["pos"].to_numpy(), (part["sym"] != msa.GAP).to_numpy())
    return _pruned(tuple(names)), {name: np.array([1 - x, x]) for name, x in zip(names, residues.astype(float))}, residues.shape[1]


def _residues(ppid: np.ndarray, pos: np.ndarray, residue: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The names of an alignment's rows, and rows x columns of 0 for gaps and 1 for residues."""
    rows, at = np.unique(ppid, return_inverse=True)
    out = np.zeros((len(rows), int(pos.max()) + 1), np.uint8)
    out[at, pos] = residue
    return [str(r) for r in rows], out


@lru_cache(maxsize=1024)
def _pruned(names: tuple[str, ...]) -> newick.Node:
    return newick.pruned(newick.parse(TREE), set(names))


def _in_pieces(seen: DataFrame, run: Callable[[list[int], list[tuple[list[str], np.ndarray]]], pd.DataFrame], schema: str, piece: int = 1000) -> DataFrame:
    """What run makes of `piece` alignments at a time: their OGids, and the names and residues of each."""
    cells = seen.groupBy("OGid").agg(F.collect_list(F.struct("ppid", "pos", (F.col("sym") != msa.GAP).alias("residue"))).alias("cells"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), piece):
                own = [c.values.flatten() for c in batch.column(1)[at : at + piece]]
                made = [_residues(*(x.to_numpy(zero_copy_only=False) for x in c)) for c in own]
                yield from pa.Table.from_pandas(run(batch.column(0)[at : at + piece].to_pylist(), made), arrow_schema(), preserve_index=False).to_batches()

    def arrow_schema() -> pa.Schema:
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    return cells.mapInArrow(pieces, schema)


def _by_rows(alignments: list[tuple[list[str], np.ndarray]]) -> Iterator[tuple[tuple[str, ...], list[int]]]:
    """Names of rows, and the alignments that have these."""
    held: dict[tuple, list[int]] = {}
    for i, (names, _) in enumerate(alignments):
        held.setdefault(tuple(names), []).append(i)
    yield from held.items()


def _patterns(residues: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different columns of alignments of the same rows (rows x patterns), and which one each column is."""
    every = np.concatenate(residues, 1)
    _, first, place = np.unique(_column_keys(every), return_index=True, return_inverse=True)
    return every[:, first], np.split(place.ravel(), np.cumsum([r.shape[1] for r in residues])[:-1])


def _column_keys(residues: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(np.packbits(residues, axis=0).T)
    return packed.view(f"V{packed.shape[1]}").ravel() if packed.shape[1] > 1 else packed.ravel()


def _pattern_tips(names: tuple[str, ...], patterns: np.ndarray) -> dict[str, np.ndarray]:
    return {name: np.array([1.0 - x, x]) for name, x in zip(names, patterns.astype(float))}


def _column_code_slopes(names: tuple[str, ...], patterns: np.ndarray, place: np.ndarray, same: np.ndarray, p: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """hmm.column_slopes() of the columns that have these patterns and numbers of unchanged rows."""
    on_tree, by_tree = hmm.tree_slopes(_pruned(names), _pattern_tips(names, patterns), p)
    kept, by_kept = beta_binomial(len(names), p["a"], p["b"])[same], beta_binomial_slopes(len(names), p["a"], p["b"])
    return kept * on_tree[place], {name: kept * x[place] for name, x in by_tree.items()} | {name: x[same] * on_tree[place] for name, x in by_kept.items()}


def coded_columns(alignments: list[tuple[list[str], np.ndarray]], states: list[np.ndarray] | None = None) -> list[tuple[list[int], hmm.Coded]]:
    """Alignments of the same rows as chains of columns of three states, and which ones these are."""
    out = []
    for names, own in _by_rows(alignments):
        patterns, places = _patterns([alignments[i][1] for i in own])
        same = [hmm.unchanged(alignments[i][1]) for i in own]
        rows = len(names) + 1
        codes, at = np.unique(np.concatenate(places) * rows + np.concatenate(same), return_inverse=True)
        split = np.split(at.ravel().astype(np.int32), np.cumsum([len(x) for x in places])[:-1])
        slopes = partial(_column_code_slopes, names, patterns, codes // rows, codes % rows)
        out.append((own, hmm.Coded(split, [slopes] * 3, None if states is None else [states[i] for i in own])))
    return out


def _tip_code_slopes(names: tuple[str, ...], patterns: np.ndarray, p: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """hmm.tip_slopes() of each row's symbol in each pattern, row by row."""
    tree, tips = _pruned(names), _pattern_tips(names, patterns)
    seen, by_seen = hmm.tree_slopes(tree, tips, p)
    values, slopes = [], []
    for name in names:
        other, by_other = hmm.tree_slopes(tree, tips | {name: tips[name][::-1]}, p)
        whole = seen + other
        values.append(seen / whole)
        slopes.append({k: (by_seen[k] * other - seen * by_other[k]) / whole**2 for k in by_seen})
    return np.concatenate(values), {k: np.concatenate([x[k] for x in slopes]) for k in by_seen}


def coded_rows(alignments: list[tuple[list[str], np.ndarray]], states: list[np.ndarray]) -> list[hmm.Coded]:
    """The rows of alignments as chains of two states, rows of equal sets side by side. states: rows x columns for each."""
    out = []
    for names, own in _by_rows(alignments):
        patterns, places = _patterns([alignments[i][1] for i in own])
        n = patterns.shape[1]
        codes = [(k * n + place).astype(np.int32) for place in places for k in range(len(names))]
        out.append(hmm.Coded(codes, [partial(_tip_code_slopes, names, patterns)] * 2, [x for i in own for x in states[i]]))
    return out


@query(tree_sql.contrasts_sql())
def gap_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each alignment, genes, columns, mean length, the summed size of the contrasts of its gap pattern on the tree, its norms,
    and the sums by contrast where no species is missing."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tree, tips, n = _tips(part)
        found = np.abs(trees.contrasts(tree, {k: v[0] for k, v in tips.items()})[1]) if tree.children else np.zeros((0, n))
        out = {"OGid": part["OGid"].iloc[0], "gnidnum": len(tips), "len1": n, "len2": float(np.sum([t[1] for t in tips.values()]) / len(tips)), "total": float(found.sum())}
        return pd.DataFrame([{**out, "sums": found.sum(1).tolist() if len(tips) == 7 else None}])

    found = symbols(spark, sf_dir).groupBy("OGid").applyInPandas(run, "OGid long, gnidnum int, len1 int, len2 double, total double, sums array<double>")
    found = regions.contrast_norms(found)
    whole = [F.round(F.col("sums")[k], 6).alias(f"c{k + 1}") for k in range(6)]
    return found.select("OGid", "gnidnum", "len1", *(F.round(c, 6).alias(c) for c in ("len2", "total", "norm1", "norm2")), *whole)


def _decoded(seen: DataFrame, start: np.ndarray, move: np.ndarray, states: list[dict]) -> DataFrame:
    """OGid, pos and the posterior of three states at each column of each alignment, many alignments side by side."""

    def run(ids: list[int], alignments: list[tuple[list[str], np.ndarray]]) -> pd.DataFrame:
        out = []
        for own, coded in coded_columns(alignments):
            found = coded.posteriors(start, move, states)
            n = [len(x) for x in found]
            p = np.concatenate(found)
            out.append(pd.DataFrame({"OGid": np.repeat([ids[i] for i in own], n), "pos": np.concatenate([np.arange(k) for k in n]), "p1": p[:, 0], "p2": p[:, 1], "p3": p[:, 2]}))
        return pd.concat(out)

    return _in_pieces(seen, run, "OGid long, pos int, p1 double, p2 double, p3 double")


@query(tree_sql.insertion_sql())
def insertion_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of three states at each column of each alignment."""
    return _decoded(symbols(spark, sf_dir), START, MOVE, STATES).select("OGid", "pos", *(F.round(c, 6).alias(c) for c in ("p1", "p2", "p3")))


def _emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OGid, pos and the emissions of the three states at each column, each different pattern being evaluated once."""
    seen = symbols(spark, sf_dir).select("OGid", F.col("ppid").cast("string").alias("ppid"), "pos", (F.col("sym") != msa.GAP).alias("residue"))
    names = seen.groupBy("OGid").agg(F.array_sort(F.collect_set("ppid")).alias("names"))
    shown = stored(seen.groupBy("OGid", "pos").agg(F.array_sort(F.collect_set(F.when(F.col("residue"), F.col("ppid")))).alias("shown")), "patterns")
    before = shown.select("OGid", (F.col("pos") + 1).alias("pos"), F.col("shown").alias("was"))
    changed = F.size(F.array_except("shown", "was")) + F.size(F.array_except("was", "shown"))
    columns = shown.join(names, "OGid").join(before, ["OGid", "pos"], "left").withColumn("same", F.when(F.col("was").isNull(), 0).otherwise(F.size("names") - changed))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for names, own in frame.groupby(frame["names"].map(tuple)):
                shows = [set(x) for x in own["shown"]]
                residue = {name: np.array([name in x for x in shows], float) for name in names}
                tree = newick.pruned(newick.parse(TREE), set(names))
                tips = {name: np.array([1 - x, x]) for name, x in residue.items()}
                emit = np.array([hmm.column_emission(tree, tips, own["same"].to_numpy(), len(names), p) for p in STATES])
                out.append(own.assign(emit=[*emit.T]))
            yield pd.concat(out) if out else frame.assign(emit=None)

    known = columns.select("names", "shown", "same").distinct().mapInPandas(run, "names array<string>, shown array<string>, same int, emit array<double>")
    return columns.join(known, ["names", "shown", "same"]).select("OGid", "pos", "emit")


@query(tree_sql.insertion_sql())
def blocked_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """insertion_decode with an alignment's columns in blocks of 32, each of them a task's: no alignment is one task."""
    found = hmm.blocked_posterior(_emissions(spark, sf_dir), "OGid", START, MOVE, block=32)
    return found.select("OGid", F.col("pos").cast("int").alias("pos"), *(F.round(F.col("posterior")[k], 6).alias(f"p{k + 1}") for k in range(3)))


def _row_weights(rows: DataFrame) -> DataFrame:
    """OGid, ppid and weight of each row of an alignment, by the tree on its rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for names in frame["names"]:
                own = trees.brownian_weights(newick.pruned(newick.parse(TREE), {str(n) for n in names}))
                out += [(names, int(name), weight) for name, weight in own.items()]
            yield pd.DataFrame(out, columns=["names", "ppid", "weight"])

    names = rows.groupBy("OGid").agg(F.array_sort(F.collect_set("ppid")).alias("names"))
    return names.join(names.select("names").distinct().mapInPandas(run, "names array<int>, ppid int, weight double"), "names").select("OGid", "ppid", "weight")


@query(tree_sql.trims_sql())
def insertion_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of each alignment that the third state takes, those that the second and third take together, and the columns and
    residues that both kinds of trims leave."""
    seen = symbols(spark, sf_dir)
    weighted = stored(seen.join(_row_weights(seen.select("OGid", "ppid").distinct()), ["OGid", "ppid"]), "weighted")
    shown = weighted.groupBy("OGid", "pos").agg(F.sum(F.when(F.col("sym") != msa.GAP, F.col("weight")).otherwise(0.0)).alias("shown"))
    whole = weighted.groupBy("OGid").agg((F.max("pos") + 1).alias("colnum"))
    columns = blocked_decode(spark, sf_dir).join(shown, ["OGid", "pos"]).withColumn("gaps", F.round(1 - F.col("shown"), 9))
    columns = stored(columns.withColumn("p3", F.when(F.col("gaps") <= 0.1, 0.0).otherwise(F.col("p3"))), "columns")
    third = stored(trims.trim_slices(columns, ["OGid"], "p3", "gaps"), "third")
    both = stored(trims.region_slices(columns, ["OGid"], "p2", "p3", "gaps"), "both")
    unaligned = trims.masked(weighted, third, ["OGid"], "ppid", "weight")
    left = trims.left_over(weighted, unaligned, both, ["OGid"], "ppid")
    found = third.withColumn("kind", F.lit("segment")).unionByName(both.withColumn("kind", F.lit("region")))
    found = found.join(whole, "OGid").join(left, "OGid", "left").select("OGid", "kind", "start", "stop", "colnum", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("columns", "residues")))
    return regions.trim_ratios(found)


@query(tree_sql.hidden_sql())
def hidden_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row that looks missing somewhere: its likely residues there, as 0 and 1."""

    def run(ids: list[int], alignments: list[tuple[list[str], np.ndarray]]) -> pd.DataFrame:
        out, known = [], {}
        for i, k, a, b, names, patterns, place in _missing(alignments):
            if (names, k) not in known:
                known[names, k] = hmm.hidden_tip(_pruned(names), _pattern_tips(names, patterns), PARAMS, names[k]) >= 0.8
            out.append((ids[i], int(names[k]), a, b, "".join("01"[int(x)] for x in known[names, k][place[a:b]])))
        return pd.DataFrame(out, columns=["OGid", "ppid", "start", "stop", "seq"])

    return _in_pieces(symbols(spark, sf_dir), run, "OGid long, ppid int, start int, stop int, seq string")


def _missing(alignments: list[tuple[list[str], np.ndarray]]) -> Iterator[tuple]:
    """Of each segment that looks missing: alignment, row, start and stop, names, and the patterns of the names' columns and their places."""
    for names, own in _by_rows(alignments):
        patterns, places = _patterns([alignments[i][1] for i in own])
        tree, tips, n = _pruned(names), _pattern_tips(names, patterns), patterns.shape[1]
        likely = np.concatenate([hmm.tip_probability(tree, tips, PARAMS, name) for name in names])
        emit = np.array([likely, 1 - likely])
        codes = [(k * n + place).astype(np.int32) for place in places for k in range(len(names))]
        found = hmm.Coded(codes, [lambda p, x=x: (x, {}) for x in emit]).posteriors(np.array([0.95, 0.05]), np.array([[0.98, 0.02], [0.1, 0.9]]), [{}, {}])
        for at, (i, place) in enumerate(zip(own, places)):
            for k in range(len(names)):
                for a, b in msa.missing_segments(found[at * len(names) + k][:, 1], alignments[i][1][k] == 0):
                    yield i, k, a, b, names, patterns, place


def _large_slopes(p: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Emissions of a small and a large quantity, and their derivatives."""
    return np.array([1 - p["p1"], p["p1"]]), {"p1": np.array([-1.0, 1.0])}


@query
def chain_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-state chain fitted to the profiles: returned lines are the labels, large and small quantities what is seen.

    The fit starts from the counted states and moves (0.1 added to each) and has the reference's 100 passes.
    """

    def prepared(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        own = part.sort_values("pos")
        return own["gap"].to_numpy(), own["x"].to_numpy() > 25

    def chains(own: list[tuple[np.ndarray, np.ndarray]]) -> list[hmm.Coded]:
        return [hmm.Coded([large.astype(np.int8) for _, large in own], [_large_slopes] * 2, [states for states, _ in own])]

    seen = stored(profile(spark, sf_dir), "profile")
    start, move = np.full(2, 0.1), np.full((2, 2), 0.1)
    before = F.lag("gap").over(Window.partitionBy("OGid").orderBy("pos"))
    for r in seen.select(before.alias("before"), F.col("gap").alias("after")).groupBy("before", "after").agg(F.count("*").alias("n")).collect():
        start[r.after] += r.n
        if r.before is not None:
            move[r.before, r.after] += r.n
    start, move = start / start.sum(), move / move.sum(1, keepdims=True)
    (value, found, params), history = hmm.fit_table(seen, ["OGid"], prepared, list, start, move, [{"p1": 0.4}, {"p1": 0.6}], hmm.quasi_newton, coded=chains, epsilon=0.05, steps=100)
    rows = [("value", 0, value), ("steps", 0, float(len(history)))] + [("move", k, float(m)) for k, m in enumerate(found.ravel())] + [("p1", k, p["p1"]) for k, p in enumerate(params)]
    return spark.createDataFrame(rows, "name string, k int, x double")


def labelled(part: pd.DataFrame, width: int = 11) -> tuple[np.ndarray, list[str], np.ndarray]:
    """An alignment with its states, by the mean share of gaps in the columns around: up to a quarter, up to a half, more. Also its
    rows' names and residues (rows x columns)."""
    _, tips, n = _tips(part)
    residues, window = np.array([t[1] for t in tips.values()]), np.ones(min(width, n))
    share = np.convolve(1 - residues.mean(0), window, "same") / np.convolve(np.ones(n), window, "same")
    return (share > 0.25).astype(np.int8) + (share > 0.5).astype(np.int8), [*tips], residues.astype(np.uint8)


def tree_records(prepared: list[tuple[np.ndarray, list[str], np.ndarray]]) -> list[hmm.Record]:
    """Records of three states each; alignments of the same rows share the patterns of their columns."""
    by_rows: dict[tuple, list[int]] = {}
    for i, (_, names, _) in enumerate(prepared):
        by_rows.setdefault(tuple(names), []).append(i)
    out: list[hmm.Record | None] = [None] * len(prepared)
    for names, own in by_rows.items():
        patterns = hmm.Patterns(newick.pruned(newick.parse(TREE), set(names)), [*names], [prepared[i][2] for i in own])
        for k, i in enumerate(own):
            same = hmm.unchanged(1 - prepared[i][2])
            both = partial(patterns.column_slopes, k, same)
            out[i] = hmm.Record(prepared[i][0], [lambda p, both=both: both(p)[0]] * 3, [both] * 3)
    return out


def tree_chains(prepared: list[tuple[np.ndarray, list[str], np.ndarray]]) -> list[hmm.Coded]:
    """tree_records() as chains that run side by side."""
    return [c for _, c in coded_columns([(names, residues) for _, names, residues in prepared], [s for s, _, _ in prepared])]


def row_chains(prepared: list[tuple[np.ndarray, list[str], np.ndarray]]) -> list[hmm.Coded]:
    """row_records() as chains that run side by side."""
    return coded_rows([(names, residues) for _, names, residues in prepared], [s for s, _, _ in prepared])


def fitted(spark: SparkSession, sf_dir: str, steps: int = 300):
    """The best model found and the history of values: moves of three states, and the parameters of each, from labelled alignments."""
    return hmm.fit_table(symbols(spark, sf_dir), ["OGid"], labelled, tree_records, START, MOVE, STATES, hmm.quasi_newton, coded=tree_chains, epsilon=0.1, steps=steps)


@query
def insertion_fit(spark: SparkSession, sf_dir: str, steps: int = 300) -> DataFrame:
    """The model of insertion_decode fitted to labelled alignments by a quasi-Newton method: its value, the first value, the passes
    taken (the reference's 300 at most), moves of three states, and of each state the tree's and the beta-binomial distribution's
    parameters."""
    (value, found, params), history = fitted(spark, sf_dir, steps)
    rows = [("value", 0, value), ("first_value", 0, history[0] if history else None), ("steps", 0, float(len(history)))] + [("move", k, float(m)) for k, m in enumerate(found.ravel())]
    return spark.createDataFrame(rows + [(name, k, p[name]) for k, p in enumerate(params) for name in sorted(p)], "name string, k int, x double")


#: A row that is there, and one whose residues are read as gaps.
ROW_STATES = [dict(PARAMS), {**PARAMS, "p0": 0.05, "p1": 0.9}]
ROW_START, ROW_MOVE = np.array([0.95, 0.05]), np.array([[0.98, 0.02], [0.1, 0.9]])


def missing_labels(part: pd.DataFrame, width: int = 11) -> tuple[np.ndarray, list[str], np.ndarray]:
    """An alignment with the states of its rows (rows x columns): missing where over 0.7 of the row's columns around are gaps. Also its
    rows' names and residues."""
    _, tips, n = _tips(part)
    residues, window = np.array([t[1] for t in tips.values()]), np.ones(min(width, n))
    share = np.array([np.convolve(1 - row, window, "same") / np.convolve(np.ones(n), window, "same") for row in residues])
    return (share > 0.7).astype(np.int8), [*tips], residues.astype(np.uint8)


def row_records(prepared: list[tuple[np.ndarray, list[str], np.ndarray]]) -> list[hmm.Record]:
    """A record of two states for each row: its symbols given those of the other rows, under either state's tree model."""
    by_rows: dict[tuple, list[int]] = {}
    for i, (_, names, _) in enumerate(prepared):
        by_rows.setdefault(tuple(names), []).append(i)
    out = []
    for names, own in by_rows.items():
        patterns = hmm.Patterns(newick.pruned(newick.parse(TREE), set(names)), [*names], [prepared[i][2] for i in own])
        for k, i in enumerate(own):
            for states, name in zip(prepared[i][0], names):
                both = partial(patterns.tip_slopes, k, name)
                out.append(hmm.Record(states, [lambda p, both=both: both(p)[0]] * 2, [both] * 2))
    return out


@query
def missing_fit(spark: SparkSession, sf_dir: str, steps: int = 100) -> DataFrame:
    """A model of missing rows fitted to labelled alignments: its value, the first value, the passes taken (the reference's 100 at
    most), moves of two states, and of each state the parameters of the tree that gives a row's symbols."""
    (value, found, params), history = hmm.fit_table(symbols(spark, sf_dir), ["OGid"], missing_labels, row_records, ROW_START, ROW_MOVE, ROW_STATES, hmm.quasi_newton, coded=row_chains, epsilon=0.05, steps=steps)
    rows = [("value", 0, value), ("first_value", 0, history[0] if history else None), ("steps", 0, float(len(history)))] + [("move", k, float(m)) for k, m in enumerate(found.ravel())]
    return spark.createDataFrame(rows + [(name, k, p[name]) for k, p in enumerate(params) for name in sorted(p)], "name string, k int, x double")


@query
def fitted_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of three states at each column, by the model that insertion_fit finds, written as a model file and read back."""
    (_, move, params), _ = fitted(spark, sf_dir)
    path = shared_dir(spark) + "/model"
    files.write_model(spark, path, {"start": START.tolist(), "move": move.tolist(), "states": params})
    model = files.read_model(spark, path)

    return _decoded(symbols(spark, sf_dir), np.array(model["start"]), np.array(model["move"]), model["states"])


@query(tree_sql.missing_sql())
def missing_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each row that look missing: runs where its gaps are unlikely given the other rows."""

    def run(ids: list[int], alignments: list[tuple[list[str], np.ndarray]]) -> pd.DataFrame:
        out = [(ids[i], int(names[k]), a, b) for i, k, a, b, names, _, _ in _missing(alignments)]
        return pd.DataFrame(out, columns=["OGid", "ppid", "start", "stop"])

    return _in_pieces(symbols(spark, sf_dir), run, "OGid long, ppid int, start int, stop int")


@query
def profile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition counts of the profiles' gap states, which estimate a chain; moves that never occur count 0."""
    before = F.lag("gap").over(Window.partitionBy("OGid").orderBy("pos"))
    counted = profile(spark, sf_dir).select(before.alias("before"), F.col("gap").alias("after")).where("before is not null").groupBy("before", "after").agg(F.count("*").alias("n"))
    every = spark.range(4).select(F.floor(F.col("id") / 2).cast("int").alias("before"), (F.col("id") % 2).cast("int").alias("after"))
    return every.join(F.broadcast(counted), ["before", "after"], "left").select("before", "after", F.coalesce("n", F.lit(0)).alias("n"))


SQL["profile_fit"] = """WITH p AS (SELECT l_suppkey AS g, (l_returnflag = 'R')::INT AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i FROM lineitem),
l AS (SELECT g, s, lag(s) OVER (PARTITION BY g ORDER BY i) AS b FROM p)
SELECT x AS before, y AS after, (SELECT count(*) FROM l WHERE b = x AND s = y)::BIGINT AS n FROM (SELECT unnest([0, 0, 1, 1])::INT AS x, unnest([0, 1, 0, 1])::INT AS y)"""


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 8 < 5 THEN 'AB' WHEN o_orderkey % 8 = 5 THEN 'AC' ELSE 'BC' END AS clade, o_custkey % 3 + 1 AS l FROM orders),
c AS (SELECT clade, count(*) AS n, avg(l) AS l, count(*) / (SELECT count(*) FROM o)::DOUBLE AS share FROM o GROUP BY 1)
SELECT clade, n, CASE WHEN share >= 0.5 THEN round(l, 9) END AS length, CASE WHEN share >= 0.5 THEN round(share, 9) END AS support FROM c""")
def consensus_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clades of a table of trees, counted where the trees are, and the length and support of those in its majority consensus."""
    o, length = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3 + 1
    form = F.when(F.col("o_orderkey") % 8 < 5, F.format_string("((A:1,B:1):%s,C:1,D:1);", length)).when(F.col("o_orderkey") % 8 == 5, F.format_string("((A:1,C:1):%s,B:1,D:1);", length)).otherwise(F.format_string("((B:1,C:1):%s,A:1,D:1);", length))
    texts = stored(o.select(form.alias("newick")), "trees")
    best = trees.clades(trees.table_consensus(texts))
    rows = [("".join(sorted(c)), node.length, node.support) for c, node in best.items() if node.support is not None]
    kept = spark.createDataFrame(rows, "clade string, length double, support double")  # a row for each clade of one tree
    counts = trees.clade_counts(texts).where("size(clade) < 4").select(F.array_join("clade", "").alias("clade"), "n")
    return counts.join(F.broadcast(kept), "clade", "left").select("clade", "n", F.round("length", 9).alias("length"), F.round("support", 9).alias("support"))


@query(f"WITH {PROFILE_SQL} SELECT OGid, pos, x, x - coalesce(lag(x) OVER (PARTITION BY OGid ORDER BY pos), x) AS step FROM profile")
def profile_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between neighbouring columns."""
    return msa.differences(profile(spark, sf_dir), "x").select("OGid", "pos", "x", "step")


@query("""SELECT l_orderkey, l_linenumber, l_quantity::INT AS length, round(l_quantity / 100, 9) AS length_ratio, round(l_discount / l_quantity, 9) AS norm2, round(l_tax / l_quantity, 9) AS norm3 FROM lineitem""")
def trim_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of trims, their shares and their mean posteriors."""
    start = F.col("l_linenumber") * 10
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("stop"), F.lit(100).alias("colnum"), F.col("l_discount").alias("posterior2"), F.col("l_tax").alias("posterior3"))
    return regions.trim_ratios(own).select("l_orderkey", "l_linenumber", "length", *(F.round(c, 9).alias(c) for c in ("length_ratio", "norm2", "norm3")))


# Of whole numbers the incomplete gamma function is a finite sum, and the beta-binomial distribution a product.
@query("""WITH t AS (SELECT p_partkey AS k, p_size AS s, (p_size % 5 + 1)::INT AS a, p_partkey % 9 / 2.0::DOUBLE + 0.25 AS x, (p_partkey % 7)::INT AS j, (p_partkey % 97 + 1) / 100.0::DOUBLE AS u FROM part)
SELECT k AS p_partkey, round(1 - exp(-x) * list_sum(list_transform(range(a), lambda i: pow(x, i) / gamma(i + 1))), 9) AS gamma, round(gamma(7) / (gamma(j + 1) * gamma(7 - j)) * gamma(j + a) * gamma(6 - j + 2) / gamma(6 + a + 2) * gamma(a + 2) / (gamma(a) * gamma(2)), 9) AS chance,
round(ln(0.01::DOUBLE) / ln(1 - 1 / (s + 1)::DOUBLE) - 1, 6) AS threshold, round(1 / (1 + exp(-(ln(u / (1 - u)) + 1))), 9) AS moved FROM t""")
def special_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special functions, the threshold of outliers, and a parameter moved on its unbounded scale, for each part's numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, size in zip(frame["p_partkey"].tolist(), frame["p_size"].tolist()):
                a, x = size % 5 + 1, k % 9 / 2 + 0.25
                moved = hmm.bounded("p0", hmm.unbounded("p0", (k % 97 + 1) / 100) + 1)
                out.append((k, float(gammainc(a, x)), float(beta_binomial(6, a, 2)[k % 7]), geometric_threshold(size), moved))
            yield pd.DataFrame(out, columns=["p_partkey", "gamma", "chance", "threshold", "moved"])

    found = table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, gamma double, chance double, threshold double, moved double")
    return found.select("p_partkey", F.round("gamma", 9).alias("gamma"), F.round("chance", 9).alias("chance"), F.round("threshold", 6).alias("threshold"), F.round("moved", 9).alias("moved"))


@query(f"""WITH {PROFILE_SQL}, s AS (SELECT *, lag(gap) OVER (PARTITION BY OGid ORDER BY pos) AS before FROM profile)
SELECT OGid, round(sum(ln(CASE WHEN before IS NULL THEN CASE gap WHEN 0 THEN 0.7e0 ELSE 0.3e0 END WHEN before = 0 THEN CASE gap WHEN 0 THEN 0.8e0 ELSE 0.2e0 END ELSE CASE gap WHEN 0 THEN 0.6e0 ELSE 0.4e0 END END)
  + ln(CASE WHEN gap = 0 THEN CASE WHEN x > 25 THEN 0.45e0 ELSE 0.55e0 END ELSE CASE WHEN x > 25 THEN 0.65e0 ELSE 0.35e0 END END)), 6) AS joint FROM s GROUP BY 1""")
def path_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithm of the probability of each profile's gap states together with its quantities."""

    start, move, large = (0.7, 0.3), ((0.8, 0.2), (0.6, 0.4)), (0.45, 0.65)
    state = lambda p: F.when(F.col("gap") == 0, float(np.log(p[0]))).otherwise(float(np.log(p[1])))
    before = F.lag("gap").over(Window.partitionBy("OGid").orderBy("pos"))
    step = F.when(before.isNull(), state(start)).when(before == 0, state(move[0])).otherwise(state(move[1]))
    seen = F.when(F.col("x") > 25, state(large)).otherwise(state([1 - p for p in large]))
    steps = profile(spark, sf_dir).select("OGid", (step + seen).alias("log"))
    return steps.groupBy("OGid").agg(F.round(F.sum("log"), 6).alias("joint"))
