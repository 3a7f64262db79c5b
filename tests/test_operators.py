"""Small cases with known results."""

import itertools
import math

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from clademill.functions import sequences, special
from clademill.operators import graphs, groups, hits, hmm, intervals, msa, products, ranks, stats, trees
from clademill.operators.components import components
from clademill.sources import files, newick


def test_fasta(spark):
    d = spark.createDataFrame([(">a x\nMK\nLL\n>b y\nXXMX\n",), ("",), (None,)], "text string")
    assert [(r.header, r.seq) for r in files.fasta_records(d, "text").orderBy("header").collect()] == [(">a x", "MKLL"), (">b y", "XXMX")]
    run = spark.createDataFrame([("AXMXXX",), ("",)], "s string").select(sequences.longest_run(F.col("s")).alias("n")).collect()
    assert [r.n for r in run] == [3, 0]
    wrapped = spark.createDataFrame([("A" * 161,)], "s string").select(files.fasta_text(F.lit(">q"), F.col("s")).alias("t")).first().t
    assert [len(x) for x in wrapped.split("\n")] == [2, 80, 80, 1]


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([("A1", "gA", 300.0), ("A2", "gA", 250.0), ("B1", "gB", 200.0), ("A3", "gA", 150.0)], {"A1", "A2"}),
        ([("A1", "gA", 300.0), ("B1", "gB", 300.0), ("C1", "gC", 100.0)], {"A1", "B1"}),
        ([("A1", "gA", 300.0), ("A2", "gA", 1.0)], {"A1", "A2"}),
    ],
)
def test_subject_cutoff(spark, rows, kept):
    d = spark.createDataFrame([("q", "G", *r) for r in rows], "qppid string, sspid string, sppid string, sgnid string, bitscore double")
    assert {r.sppid for r in hits.subject_cutoff(d).collect()} == kept


def test_greedy_marks_and_hit(spark):
    rows = [("q", "s", n, *x, 1e-50, b) for n, x, b in (("h1", (1, 100, 1, 100), 200.0), ("h2", (90, 150, 110, 170), 100.0), ("h3", (160, 220, 180, 240), 80.0), ("h4", (10, 60, 300, 350), 60.0))]
    d = spark.createDataFrame(rows, "qppid string, sppid string, name string, qstart int, qend int, sstart int, send int, evalue double, bitscore double")
    one = hits.marked(d)
    flags = {h.name: (h.index_hsp, h.disjoint, h.compatible) for h in one.first().hsps}
    assert flags == {"h1": (True, True, True), "h2": (False, False, True), "h3": (False, True, True), "h4": (False, False, False)}
    hit = hits.hits(one).first()
    assert (hit.hspnum, hit.chspnum, hit.nqa, hit.nsa, hit.cnqa, hit.cnsa, hit.bitscore) == (2, 3, 161, 161, 211, 222, 280.0)


def test_sorted_lists_accept_what_comparing_all_does():
    rng = np.random.default_rng(12)
    apart = lambda x, t: x[0] > t[1] or t[0] > x[1]
    little = lambda x, t, s: apart(x, t) or all(b > a and min(x[1], t[1]) - max(x[0], t[0]) < s * (b - a) for a, b in (x, t))
    for share in (0.2, 0.5, 1.0):
        for _ in range(60):
            spans = [tuple((int(a), int(a + w)) for a, w in zip(rng.integers(0, 300, 2), rng.integers(0, 60, 2))) for _ in range(80)]
            first = []
            for i, x in enumerate(spans):
                if all(apart(x[k], spans[j][k]) for j in first for k in (0, 1)):
                    first.append(i)
            every = [*first]
            for i, x in enumerate(spans):
                if i not in every and all(little(x[k], spans[j][k], share) for j in every for k in (0, 1)):
                    every.append(i)
            assert hits.accepted(range(80), spans, share) == (set(first), set(every))


def test_a_hundred_thousand_alignments_of_one_pair(spark):
    import time

    n = 100_000
    rows = spark.range(n).select(F.lit("q").alias("qppid"), F.lit("s").alias("sppid"), (F.col("id") * 7 % n * 10).cast("int").alias("qstart"), F.lit(0.0).alias("evalue"), (F.col("id") % 97).cast("double").alias("bitscore"))
    rows = rows.withColumns({"qend": F.col("qstart") + 12, "sstart": F.col("qstart"), "send": F.col("qstart") + 12})
    began = time.perf_counter()
    hit = hits.hits(hits.marked(rows)).first()
    assert hit.chspnum == n and hit.hspnum > n / 4 and hit.cnqa == 10 * n + 3 and time.perf_counter() - began < 60


def test_best_hits_keep_ties_and_filter_afterwards(spark):
    d = spark.createDataFrame([("q", "G", "s1", 500, 0.4), ("q", "G", "s2", 500, 0.6), ("q", "G", "s3", 490, 0.9), ("p", "G", "s1", 5, 0.1), ("p", "G", "s2", 4, 0.9)], "qppid string, sspid string, sppid string, bitscore int, c double")
    assert [(r.qppid, r.sppid) for r in hits.best_hits(d, covered=F.col("c") >= 0.5).collect()] == [("q", "s2")]


def test_reciprocity(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "src string, dst string")
    assert {(r.src, r.dst): r.reciprocal for r in hits.with_reciprocity(d).collect()} == {("a", "b"): True, ("b", "a"): True, ("a", "c"): False}


EDGES = [tuple(x) for x in ("ab", "ac", "ad", "bc", "bd", "cd", "be", "ce", "de", "ef", "eg", "fg")]


def test_clusters(spark):
    d = spark.createDataFrame(EDGES, "src string, dst string")
    assert {r.component for r in components(d).collect()} == {"a"}
    by = {}
    for r in graphs.triangle_clusters(d).collect():
        by.setdefault(tuple(r.cluster), set()).add((r.src, r.dst))
    assert sorted(map(len, by.values())) == [3, 9] and {("e", "f"), ("e", "g"), ("f", "g")} in by.values()


def test_components_of_chains_loops_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
    pairs = spark.createDataFrame(chain, "src long, dst long")
    for nothing in (pairs.where("false"), pairs.where("src > 1000"), pairs.join(spark.createDataFrame([(9, 1)], "src long, k long").where("k > 1"), "src")):
        assert components(nothing.select("src", "dst")).count() == 0


def test_ids(spark):
    members = spark.createDataFrame([(n, c) for c, ns in ((1, [1, 2, 3, 4, 5]), (6, [6, 7, 8]), (9, [9, 10, 11])) for n in ns], "node long, component long")
    assert {r.component: r.component_id for r in ranks.component_ids(members).collect()} == {1: "0000", 9: "0001", 6: "0002"}


def overlapping():
    rng = np.random.default_rng(12)
    sets = {g: {int(i) for i in rng.integers(0, 300, rng.choice([1, 2, 3, 5, 8]))} for g in range(150)}
    return sets | {1000 + g: {int(i) for i in rng.integers(0, 150, 130)} for g in range(6)} | {2000: set(range(500, 600)), 2001: set(range(540, 580)), 2002: {501, 700, 701}}


def meeting(sets, least):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) >= least * min(len(sets[a]), len(sets[b]))}


def test_overlap_of_small_and_large_sets(spark, monkeypatch):
    sets = overlapping()
    d = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "o int, g int")
    joined = []
    candidates = graphs._overlaps
    monkeypatch.setattr(graphs, "_overlaps", lambda *a, **o: joined.append(a) or candidates(*a, **o))
    for least in (0.3, 0.5, 1.0):
        found = [(r.src, r.dst) for r in graphs.overlap_graph(d, "o", "g", least).collect()]
        assert len(found) == len(set(found)) and set(found) == meeting(sets, least)
    assert len(joined) == 3


def test_links_connect_what_overlaps_connect(spark):
    sets = overlapping()
    d = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s], "o int, g int")
    for least in (0.4, 0.5, 0.9):
        links = graphs.overlap_links(d, "o", "g", least)
        assert {(r.src, r.dst) for r in links.collect()} <= meeting(sets, least)
        whole, some = ({(r.node, r.component) for r in graphs.components(e).collect()} for e in (graphs.overlap_graph(d, "o", "g", least), links))
        assert whole == some
    # thirty groups of one item make 29 links, not 435
    one = spark.createDataFrame([(g, 7) for g in range(30)], "o int, g int")
    assert graphs.overlap_links(one, "o", "g").count() == 29


def test_paralogs(spark):
    e = spark.createDataFrame([("u", "v", 1)], "src string, dst string, score int")
    p = spark.createDataFrame([("u", "u2")], "node string, paralog string")
    assert {(r.src, r.dst) for r in graphs.with_paralogs(e, p).collect()} == {("u", "v"), ("u2", "v")}


def test_overlap(spark):
    sets = [("A", g) for g in (1, 2, 3, 4)] + [("B", g) for g in (3, 4, 5)] + [("C", g) for g in (4, 5, 6)]
    found = {(r.src, r.dst) for r in graphs.overlap_graph(spark.createDataFrame(sets, "o string, g int"), "o", "g").collect()}
    assert found == {("A", "B"), ("B", "C")}


def test_overlap_of_any_share(spark):
    rng = np.random.default_rng(11)
    sets = {g: {int(i) for i in rng.integers(0, 40, rng.integers(1, 12))} | ({99} if g % 3 else set()) for g in range(120)}
    rows = [(g, i) for g, s in sets.items() for i in s] * 2 + [(1, None), (None, 5)]
    d = spark.createDataFrame(rows, "o int, g int")
    for least in (0.3, 0.5, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= least * min(len(sets[a]), len(sets[b]))}
        found = [(r.src, r.dst) for r in graphs.overlap_graph(d, "o", "g", least).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert graphs.overlap_graph(d.where("false"), "o", "g").count() == 0
    with pytest.raises(ValueError):
        graphs.overlap_graph(d, "o", "g", 0)


def test_cluster_ids(spark):
    rng = np.random.default_rng(4)
    clusters = {("p", c): {(int(a), int(b)) for a, b in np.sort(rng.integers(0, 6, (rng.integers(3, 7), 2)), axis=1) if a != b} for c in range(60)}
    clusters = {k: e for k, e in clusters.items() if e}
    rows = [(*k, a, b) for k, e in clusters.items() for a, b in e]
    found = {((r.component_id, r.cluster), r.OGid) for r in graphs.cluster_ids(spark.createDataFrame(rows, "component_id string, cluster int, src int, dst int")).collect()}
    order = sorted(clusters, key=lambda k: (len(clusters[k]), sorted(itertools.chain(*clusters[k])), -k[1]), reverse=True)
    assert found == {(k, f"{i:04X}") for i, k in enumerate(order)}


def test_principal_components(spark):
    rng = np.random.default_rng(5)
    for shape, share, k in (((7, 60), 0.4, 2), ((150, 40), None, 2), ((3, 2), 0.5, 2)):
        # groups of rows that have columns in common, so that the first components stand out
        chance = share if share else 0.05 + 0.5 * (np.arange(shape[0])[:, None] % 3 == np.arange(shape[1])[None] % 3) * np.linspace(1, 0.3, shape[1])
        member = rng.random(shape) < chance
        member[:, 0] = True
        d = spark.createDataFrame([(int(a), int(c)) for a, c in np.argwhere(member)] * 2 + [(None, 1), (1, None)], "a int, c int")
        found = np.array([tuple(r)[1:] for r in sorted(stats.principal_components(d, "a", "c", k).collect())])
        centred = member - member.mean(0)
        u, s, _ = np.linalg.svd(centred, full_matrices=False)
        want = np.hstack([u * s, np.zeros((shape[0], k))])[:, :k]
        assert np.allclose(np.abs(found), np.abs(want), atol=1e-7)
        assert (found[np.abs(found).argmax(0), np.arange(k)] >= 0).all()
    assert stats.principal_components(d.where("false"), "a", "c").count() == 0


def test_representative(spark):
    d = spark.createDataFrame([("g", "a", 30, 900.1), ("g", "b", 33, 500.0), ("g", "c", 33, 500.0)], "GGid string, OGid string, spidnum int, bitscore double")
    assert groups.representatives(d).first().OGid == "b"


def test_slices(spark):
    assert msa.merged_slices([(0, 5), (5, 8), (10, 12)]) == [(0, 8), (10, 12)]
    assert plain.complement_slices([(0, 8), (10, 12)]) == [(8, 10), (12, None)] and plain.complement_slices([]) == [(0, None)]
    d = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12)], "k int, start int, stop int")
    assert sorted((r.start, r.stop) for r in intervals.merged(d, ["k"]).collect()) == [(0, 8), (10, 12)]
    text = spark.createDataFrame([("3-7,9-12",), ("",)], "t string").select(files.slices(F.col("t")).alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in text] == [[(3, 7), (9, 12)], []]


def test_profiles(spark):
    d = spark.createDataFrame([(1, i, float(x), 0) for i, x in enumerate([0, 0.2, 0.9, 1, 1, 0.3, 0])], "g int, pos int, x double, b int")
    assert [round(r.gradient, 9) for r in msa.gradient(d, "x", ["g"]).orderBy("pos").collect()] == [0.2, 0.45, 0.4, 0.05, -0.35, -0.5, -0.3]
    bits = spark.createDataFrame([(1, i, int(b)) for i, b in enumerate("01011001")], "g int, pos int, b int")
    assert "".join(str(r.closed) for r in msa.closed(bits, "b", ["g"]).orderBy("pos").collect()) == "01111110"
    assert hmm.unchanged(np.array([[0, 0, 0], [0, 1, 1], [1, 1, 1]])).tolist() == [0, 2, 3]


def test_threshold():
    assert special.geometric_threshold(3) == pytest.approx(15.0078, abs=1e-4)
    rows = ["A" * 16, "A" * 15 + "-", *["AAA" + "-" * 13] * 6]
    out = plain.segment_trims(rows, [(0, 16)], lambda m: 16)
    assert out[0] == "." * 16 and out[1] == rows[1]


def test_pools(spark):
    columns = ["AAAA", "A-AA", "AC--", "----"]
    d = spark.createDataFrame([("g", p, c) for p, col in enumerate(columns) for c in col], "OGid string, pos int, sym string")
    found = {r.pos: set(r.pools) for r in msa.column_flags(d).collect()}
    assert found == {0: {"100R", "50R", "0R"}, 1: {"50R", "0R"}, 2: {"50R", "50R_NI", "0R", "0R_NI"}, 3: {"0R"}}


def test_meta_alignments(spark):
    from clademill.plans import table_queries

    # columns AB, BB and CB, of which the first is there 50 times, in several blocks; a row that a column lacks is a gap
    cells = [("g", r, i, "A" if r == 1 and i < 50 else "B" if r == 2 or i < 60 else "C") for i in range(100) for r in (1, 2)] + [("h", 1, 0, "A")]
    symbols = spark.createDataFrame(cells, "OGid string, ppid int, pos int, sym string")
    pools = spark.createDataFrame([("g", i, "a") for i in range(100)] + [("h", 0, "b")], "OGid string, pos int, pool string")
    n = 40
    found = {(r.pool, r.sample, r.ppid): r.seq for r in msa.meta_alignments(symbols, pools, n, 1000, 1, block=7).collect()}
    assert len(found) == 4 * n and all(len(x) == 1000 for x in found.values())
    assert {found["b", k, r] for k in range(n) for r in (1, 2)} == {"A" * 1000, "-" * 1000}
    assert {found["a", k, 2] for k in range(n)} == {"B" * 1000} and len({found["a", k, 1] for k in range(n)}) == n
    for symbol, share in (("A", 0.5), ("B", 0.1), ("C", 0.4)):
        counts = np.array([found["a", k, 1].count(symbol) for k in range(n)])
        assert abs(counts.mean() - 1000 * share) < 5 * (1000 * share * (1 - share) / n) ** 0.5  # five standard errors
        assert 0.5 < counts.var(ddof=1) / (1000 * share * (1 - share)) < 1.9  # binomial, as draws with replacement are
    made = table_queries.bootstrap_columns(spark, "/root/testdata/sf0.001").select("pool", "sample", "ppid", F.length("seq").alias("n")).toPandas()
    n_rows, n_pools = made["ppid"].nunique(), made["pool"].nunique()
    assert len(made) == n_pools * 100 * n_rows and set(made["n"]) == {10_000}


def test_codons(spark):
    bases = "TCAG"
    code = {a + b + c: x for (a, b, c), x in zip(itertools.product(bases, repeat=3), "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG")}
    rows = [("CTGAAATAA", "MK", ["CTG", "AAA"], "ok"), ("ctgaaataa", "QK", ["CTG", "AAA"], "mismatch"), ("CTGAAAT", "LKW", ["CTG", "AAA"], "length"), ("CTGAAA", "L", ["CTG", "AAA"], "length"), ("CTG", "LKK", ["CTG"], "mismatch"), ("CTGNNN", "XK", ["CTG", "NNN"], "ok"), ("", "", [], "ok"), ("TAA", "", [], "ok"), ("AAACTG", "KM", ["AAA", "CTG"], "mismatch")]
    d = spark.createDataFrame([r[:2] for r in rows], "nt string, aa string").withColumn("codons", sequences.coding(F.col("nt"), code))
    found = d.select("codons", sequences.agreement(F.col("codons"), F.col("aa"), code, {"TTG", "CTG", "ATG"}).alias("status")).collect()
    assert [(list(r.codons), r.status) for r in found] == [r[2:] for r in rows]
    aligned = spark.createDataFrame([("r", i, c) for i, c in enumerate("M-K.W")], "row string, pos int, sym string")
    threaded = msa.threaded(aligned, spark.createDataFrame([("r", ["CTG", "AAA"])], "row string, codons array<string>"), ["row"])
    assert msa.assembled(threaded, ["row"]).first().seq == "CTG---AAA...---"


def test_threading_broadcasts_nothing(spark):
    aligned = spark.createDataFrame([(r, k, s) for r in "rs" for k, s in enumerate("L-K.M")], "row string, pos int, sym string")
    out = msa.threaded(aligned, spark.createDataFrame([("r", ["CTG", "AAA"])], "row string, codons array<string>"), ["row"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.row, r.seq) for r in msa.assembled(out, ["row"]).collect()} == {("r", "CTG---AAA...---"), ("s", "----" * 2 + "-...---")}


def test_missing_one(spark):
    members = spark.createDataFrame([(g, i) for g, own in enumerate(["abcd", "abc", "abc", "abd", "ab", "", "bcd", "abcz"]) for i in own] + [(1, "a"), (3, None)], "OGid int, spid string")
    universe = spark.createDataFrame([(i,) for i in "abcdd"] + [(None,)], "spid string")
    assert {(r.spid, r.n) for r in groups.missing_one(members, universe).collect()} == {("d", 3), ("c", 1), ("a", 1)}
    assert groups.missing_one(members.where("false"), universe).count() == 0


def test_a_fasta_file_over_many_splits(spark, tmp_path):
    rng = np.random.default_rng(3)
    text = {f"r{i}": "".join(rng.choice(list("ACGT"), rng.integers(0, 300))) for i in range(3000)}
    (tmp_path / "one.fa").write_text("junk\n\n" + "".join(f">{k} x>y\r\n" + "".join(s[i : i + 60] + "\r\n" for i in range(0, len(s), 60)) for k, s in text.items()))
    (tmp_path / "two.fa").write_text("\n>first\nAC\n>>odd\nGT")
    (tmp_path / "none.fa").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        found = files.read_fasta(spark, f"file://{tmp_path}").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    one = sorted((r for r in found if r.file == "one.fa"), key=lambda r: (r.block, r.ord))
    assert len({r.block for r in one}) > 10 and [(r.header, r.seq) for r in one] == [(f">{k} x>y", s) for k, s in text.items()]
    assert sorted((r.header, r.seq) for r in found if r.file == "two.fa") == [(">>odd", "GT"), (">first", "AC")]


def test_tree_weights_and_contrasts():
    tree = newick.parse("((A:1,B:1):1,C:2);")
    assert trees.brownian_weights(tree) == pytest.approx({"A": 2 / 7, "B": 2 / 7, "C": 3 / 7})
    root, found = trees.contrasts(tree, {"A": 1, "B": 0, "C": 0})
    assert float(root) == pytest.approx(0.285714, abs=1e-6) and [float(x) for x in found] == pytest.approx([0.707107, 0.267261], abs=1e-6)
    with pytest.raises(ValueError):
        trees.brownian_weights(newick.parse("(A:1,B:1,C:1);"))


def test_newick():
    text = "((A:1.0,B:1.0)0.9:1.0,'C d':2.0);"
    assert newick.write(newick.parse(text)) == text
    assert newick.pruned(newick.parse("((A:1,B:1):1,C:2);"), {"A", "C"}).names() == ["A", "C"]
    assert newick.write(newick.pruned(newick.parse("((A:1,B:1):1,C:2);"), {"A", "C"})) == "(A:2.0,C:2.0);"
    assert sorted(newick.rooted_at(newick.parse("((A:1,B:1):1,(C:2,D:1):1);"), "C").names()) == list("ABCD")


def test_consensus():
    texts = ["((A:1,B:1):1,C:1,D:1);"] * 2 + ["((A:1,C:1):1,B:1,D:1);"]
    for cutoff in (0.5, 0):
        best = trees.consensus([newick.parse(t) for t in texts], cutoff)
        inner = [n for n in best.postorder() if n.children and n is not best]
        assert [(sorted(n.names()), round(n.support, 3)) for n in inner] == [(["A", "B"], 0.667)]


def test_chain_of_markov():
    assert hmm.transition(1, 1, 0.5)[0, 0] == pytest.approx(0.6839397)
    p = hmm.transition(0.5, 1.5, 1)
    assert (p[0, 0], p[1, 1]) == pytest.approx((0.7838338, 0.3515015))
    gap, residue = np.array([[1.0], [0.0]]), np.array([[0.0], [1.0]])
    value, log = hmm.conditional(newick.parse("(A:0.5,B:0.5);"), {"A": gap, "B": residue}, 1, 1, 0, 0)
    assert (np.array([0.7, 0.3]) @ value * np.exp(log))[0] == pytest.approx(0.2161662)
    for pinv, alpha in ((0.1, 0.5), (0.5, 2.0)):
        assert sum(r * w for r, w in hmm.rate_classes(pinv, alpha)) == pytest.approx(1, abs=1e-9)


def test_special():
    assert special.beta_binomial(3, 1, 0.5) == pytest.approx([0.142857, 0.171429, 0.228571, 0.457143], abs=1e-6)
    assert special.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert special.gammainc(2.5, special.gamma_quantile(0.3, 2.5)) == pytest.approx(0.3, abs=1e-12)
    assert special.gammainc(1, 2) == pytest.approx(1 - math.exp(-2), abs=1e-14)


def test_hidden_chain():
    emit = np.array([[0.7, 0.1, 0.7], [0.3, 0.9, 0.3]])
    start, move = np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]])
    chain = hmm.Chain(start, move, emit)
    assert math.exp(chain.log_likelihood()) == pytest.approx(0.073728)
    assert chain.posterior()[:, 0] == pytest.approx([0.533203, 0.359863, 0.579346], abs=1e-6)
    total, moves = 0.0, np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=3):
        p = math.exp(chain.joint(np.array(path)))
        total += p
        moves += p * hmm.transition_counts(np.array(path), 2)
    assert total == pytest.approx(0.073728) and chain.moves() == pytest.approx(moves / total)


def test_tip_probability_by_enumeration():
    tree = newick.parse("((A:0.3,B:0.7):0.2,C:0.5);")
    p = {"q0": 0.7, "q1": 1.1, "pi": 0.3, "p0": 0.05, "p1": 0.1, "pinv": 0.25, "alpha": 0.7}
    tips = {n: np.array([[1.0 - s], [float(s)]]) for n, s in (("A", 1), ("B", 0), ("C", 1))}
    every = [hmm.tree_probability(tree, {n: np.array([[1.0 - s], [float(s)]]) for n, s in zip("ABC", x)}, p)[0] for x in itertools.product((0, 1), repeat=3)]
    assert sum(every) == pytest.approx(1)
    assert hmm.tip_probability(tree, tips, p, "B")[0] == pytest.approx(every[0b101] / (every[0b101] + every[0b111]))
    assert 0 < hmm.hidden_tip(tree, tips, p, "A")[0] < 1


def test_gradients_are_differences():
    rng = np.random.default_rng(0)
    same = rng.integers(0, 4, 12)
    emissions = [lambda p, s=same: special.beta_binomial(3, p["a"], p["b"])[s]] * 2
    record = hmm.Record(rng.integers(0, 2, 12), emissions)
    start, move, params = np.array([0.5, 0.5]), np.array([[0.8, 0.2], [0.3, 0.7]]), [{"a": 1.2, "b": 0.5}, {"a": 0.4, "b": 2.0}]
    value, by_move, by_param = hmm.gradients(record, start, move, params)
    for i, j in itertools.product((0, 1), repeat=2):
        z = np.log(move)
        z[i, j] += 1e-6
        up = hmm.gradients(record, start, hmm.softmax(z), params)[0]
        assert -(up - value) / 1e-6 == pytest.approx(by_move[i, j], abs=1e-4)
    moved = [{**params[0], "a": hmm.bounded("a", hmm.unbounded("a", 1.2) + 1e-6)}, params[1]]
    assert -(hmm.gradients(record, start, move, moved)[0] - value) / 1e-6 == pytest.approx(by_param[0]["a"], abs=1e-4)
    (best, _, _), history = hmm.fit([record], start, move, params, steps=40, epsilon=1e-6)
    assert best >= history[0]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "out.txt").write_text("# BLASTP\n# Query: q1\n# 1 hits found\nq1\ts1\t10\t9\t0\t20\t1\t10\t30\t2\t11\t1e-20\t50.5\n# BLASTP\n# Query: q2\n# 0 hits found\n# BLAST processed 2 queries\n")
    found, nulls = files.read_search_output(spark, f"file://{tmp_path}/out.txt")
    assert [(r.qppid, r.sppid, r.nident, r.bitscore) for r in found.collect()] == [("q1", "s1", 9, 50.5)] and [r.qppid for r in nulls.collect()] == ["q2"]
    lines = spark.createDataFrame([("u\tv:12.5,w:3.0",), ("x\t",)], "value string")
    assert {(r.src, r.dst, r.score) for r in files.adjacency(lines).collect()} == {("u", "v", 12.5), ("u", "w", 3.0), ("x", None, None)}
    files.write_model(spark, f"file://{tmp_path}/model", {"t": {"1": {"2": 0.5}}})
    assert files.read_model(spark, f"file://{tmp_path}/model") == {"t": {"1": {"2": 0.5}}}
    fasta = tmp_path / "a.fa"
    fasta.write_text(">x|k=1\nAC\nGT\n")
    assert [(r.header, r.seq) for r in files.read_fasta(spark, f"file://{fasta}").collect()] == [(">x|k=1", "ACGT")]


def test_ingest(spark, tmp_path):
    from clademill.streaming.ingest import ingest_hits

    schema = "qspid string, sspid string, n int"
    spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest_hits(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", schema).awaitTermination(60)
    assert files.read_pairs(spark, f"{tmp_path}/out", schema).count() == 2


@pytest.mark.parametrize("k", [1, 3])
def test_products_of_many_cells(spark, monkeypatch, k):
    monkeypatch.setattr(products, "SMALL", 4)
    rng = np.random.default_rng(5)
    e, label = rng.integers(-3, 4, (61, 4)), rng.integers(0, 4, 61)
    v = spark.createDataFrame([(i, int(c), [int(x) for x in y]) for i, (c, y) in enumerate(zip(label, e))], "id long, label int, e array<int>")
    score, want = e @ e.T, set()
    for i, c in itertools.product(range(61), range(4)):
        at = np.flatnonzero(label == c)
        if label[i] != c:
            least = np.sort(score[i, at])[-k:][0]
            want |= {(i, int(j), c, int(score[i, j])) for j in at if score[i, j] >= least}
    plan = products.top_products(v, k)
    found = [tuple(r) for r in plan.collect()]
    assert len(found) == len(want) and set(found) == want
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()
    assert products.top_products(v.where("false"), k).count() == 0


def test_mutual_products_of_a_large_label(spark, monkeypatch):
    monkeypatch.setattr(products, "CELL", 7)
    rng = np.random.default_rng(6)
    e, label, best = rng.integers(-3, 4, (50, 4)), np.where(np.arange(50) < 30, 0, np.arange(50) % 5), rng.integers(0, 12, 50)
    v = spark.createDataFrame([(i, int(label[i]), [int(x) for x in e[i]], int(best[i])) for i in range(50)], "id long, label int, e array<int>, best long")
    score = e @ e.T
    want = sorted((i, j) for i, j in itertools.permutations(range(50), 2) if label[i] == label[j] and score[i, j] > max(best[i], best[j]))
    assert sorted((r.node, r.paralog) for r in products.mutual_products(v).collect()) == want and want
