"""Regions, trims, labels and fits against hand values."""

import numpy as np
import plain
import pytest

from clademill.operators import groups, hmm, labels, msa, regions
from clademill.sources import files, newick


def test_hulls_and_margins():
    p = np.array([0, 0, 0.2, 0.9, 0.95, 0.9, 0.3, 0, 0, 0])
    grad = np.gradient(p)
    assert plain.hulls(p, grad) == [(1, 8)]  # the rise begins at 1, the fall ends at 7
    gaps = np.array([0, 0, 0, 5, 5, 5, 5, 0, 0, 0.0])
    assert plain.hysteresis(p, gaps) == [(3, 7)]  # the changes of gaps at 3 and 7 are the largest within the margins


def test_hysteresis_without_margins():
    flat = np.ones(6)
    assert plain.hysteresis(flat, np.arange(6.0)) == [(0, 6)]
    assert plain.hysteresis(np.zeros(6), np.arange(6.0)) == [] and plain.hysteresis(np.zeros(0), np.zeros(0)) == []
    assert plain.hysteresis(np.ones(1), np.ones(1)) == [(0, 1)]


def test_margin_one_column_past_the_core():
    p, gaps = np.array([0, 0, 1, 1, 0.5, 0, 0.0]), np.array([0, 0, 1, 1, 0, 0, 0.0])
    assert plain.hysteresis(p, gaps) == [(2, 4)]


def test_region_trims_spare_third_state():
    p3 = np.array([0, 0, 0, 0, 0, 0, 0, 0, 0.9, 1, 0.9, 0])
    p2 = np.array([0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0.0])
    gaps = np.array([0, 2, 2, 2, 0, 0, 0, 0, 3, 3, 3, 0.0])
    found = plain.region_trims(p2, p3, gaps)
    assert found and all(b <= 6 for _, b in found)
    assert plain.region_trims(np.zeros(0), np.zeros(0), np.zeros(0)) == []


def test_trims_by_weight():
    rows = ["AAAAAAAAAAAAAAAAAAAA"] + ["A-------------------"] * 7
    out = plain.segment_trims(rows, [(0, 20)], lambda m: 5, [0.3] + [0.1] * 7)
    assert out[0] == "." * 20 and out[1:] == rows[1:]
    means = []
    plain.segment_trims(["AA", "A-", "A-", "AA", "AA", "AA", "AA"] , [(0, 2)], lambda m: means.append(m) or 9, drop=2)
    assert means == [2.0]
    assert plain.without_slices(["AC-GT", "A--.T"], [(0, 1)]) == ["CGT", "-.T"]
    assert plain.without_slices([], [(0, 1)]) == []


def test_labels(spark):
    t = spark.createDataFrame([("a", 0, 3, "1"), ("a", 3, 5, "2"), ("a", 6, 6, "2"), ("b", 1, 4, "1")], "OGid string, start int, stop int, label string")
    assert {(r.OGid, r.start, r.problem) for r in labels.violations(t, ["OGid"]).collect()} == {("a", 6, "break"), ("a", 6, "empty"), ("a", 6, "repeat"), ("b", 1, "start")}
    assert {tuple(r) for r in labels.totals(t).collect()} == {("1", 6, 2), ("2", 2, 2)}
    assert labels.violations(t.where("false"), ["OGid"]).count() == 0


def test_stitched(spark):
    rows = spark.createDataFrame([("g", "x", "AB-DEF"), ("g", "y", "A---EF"), ("h", "z", "QQ")], "OGid string, ppid string, seq string")
    again = spark.createDataFrame([("g", "x", 1, 3, "-B"), ("g", "x", 4, 5, "EE"), ("g", "y", 4, 5, "-E")], "OGid string, ppid string, start int, stop int, seq string")
    out = {r.ppid: r.seq for r in regions.stitched(rows, again).collect()}
    assert out == {"x": "A-BDEEF", "y": "A---" + "-E" + "F", "z": "QQ"}


def test_row_scores(spark):
    s = spark.createDataFrame([("g", r, p, c, w) for r, seq, w in (("x", "AA", 0.5), ("y", "A-", 0.25), ("z", "A.", 0.25)) for p, c in enumerate(seq)], "OGid string, ppid string, pos int, sym string, weight double")
    slices = spark.createDataFrame([("g", 0, 2)], "OGid string, start int, stop int")
    out = {r.ppid: r.score for r in regions.row_scores(s, slices).collect()}
    assert out == pytest.approx({"x": np.log(0.5), "y": np.log(0.5), "z": np.log(0.5)})
    assert {r.score for r in regions.row_scores(s, slices.where("false")).collect()} == {0.0}
    counts = {r.ppid: (r.sym_count, r.align_count) for r in regions.slice_counts(s, slices).collect()}
    assert counts == {"x": (2, 2), "y": (1, 2), "z": (1, 2)}


def test_subsets(spark):
    rows = [("a", "p1", "g1", "s1"), ("a", "p2", "g2", "s2"), ("b", "p1", "g1", "s1"), ("b", "p2", "g2", "s2"), ("b", "p3", "g2", "s2"), ("c", "p4", "g1", "s1")]
    m = spark.createDataFrame(rows, "OGid string, ppid string, gnid string, spid string")
    assert {tuple(r) for r in groups.subsets(m, 2).collect()} == {("a", True, False), ("b", True, True), ("c", False, False)}
    assert {tuple(r) for r in groups.multiplicity(m, "OGid", "ppid").collect()} == {(2, 2), (1, 2)}
    assert {tuple(r) for r in groups.added_members(m.where("OGid = 'a'"), m.where("OGid = 'b'").replace("b", "a", "OGid")).collect()} == {("a", 2, 3, 1)}


def test_errors_and_report(spark):
    t = spark.createDataFrame([(1, "False", "False"), (2, "True", "False"), (3, None, "False")], "i int, a string, b string")
    assert [r.i for r in groups.without_errors(t, ["a", "b"]).collect()] == [1]
    assert files.report(t.selectExpr("count(*) as rows", "max(a) as a")).first().text == "rows: 3\na: True"


def test_fit_of_a_table_is_the_fit_of_its_records(spark):
    rng = np.random.default_rng(3)
    data = [(g, i, int(s), int(rng.random() < (0.8 if s else 0.3))) for g in range(4) for i, s in enumerate(rng.random(12) < 0.5)]
    table = spark.createDataFrame(data, "g int, pos int, s int, x int")

    def record(part):
        own = part.sort_values("pos")
        x = own["x"].to_numpy()
        return hmm.Record(own["s"].to_numpy(), [lambda p: np.where(x == 1, p["p1"], 1 - p["p1"])] * 2)

    start, move, params = np.array([0.5, 0.5]), np.array([[0.6, 0.4], [0.3, 0.7]]), [{"p1": 0.4}, {"p1": 0.6}]
    options = dict(rate=0.2, momentum=0.5, epsilon=0, steps=4)
    (value, m, p), history = hmm.fit_table(table, ["g"], lambda part: part, lambda parts: [*map(record, parts)], start, move, params, hmm.descend, **options)
    here = [record(part) for _, part in table.toPandas().groupby("g")]
    (value2, m2, p2), history2 = hmm.fit(here, start, move, params, **options)
    assert history == pytest.approx(history2) and value == pytest.approx(value2) and m == pytest.approx(m2)
    assert [q["p1"] for q in p] == pytest.approx([q["p1"] for q in p2]) and history[-1] > history[0]
    assert hmm.fit_table(table.where("false"), ["g"], lambda part: part, lambda parts: [*map(record, parts)], start, move, params, hmm.quasi_newton)[1] == []


def test_registered_fit_ends_at_its_best(spark):
    from clademill.plans import model_queries
    from clademill.plans.inputs import profile

    sf = "/root/testdata/sf0.001"
    found = {(r.name, r.k): r.x for r in model_queries.chain_fit(spark, sf).collect()}
    paths = [part.sort_values("pos")["gap"].to_numpy() for _, part in profile(spark, sf).toPandas().groupby("OGid")]
    start, move = np.bincount(np.concatenate(paths)), np.sum([hmm.transition_counts(s, 2) for s in paths], axis=0)
    start, move = start / start.sum(), move / move.sum(1, keepdims=True)
    blind = sum(np.log(start[s[0]]) + np.log(move[s[:-1], s[1:]]).sum() for s in paths)  # both states emit alike: a model among the candidates
    assert found["value", 0] > blind - 0.2 and 1 < found["steps", 0] < 100
    assert abs(found["p1", 0] - 0.4) > 0.05 and abs(found["p1", 1] - 0.6) > 0.05


def test_slopes_are_the_limits_of_differences():
    from clademill.plans import model_queries as mq

    rng = np.random.default_rng(8)
    tree = newick.parse(mq.TREE)
    tips = {str(t): np.array([1 - x, x]) for t in range(1, 8) for x in [(rng.random(20) < 0.6).astype(float)]}
    same = hmm.unchanged(np.array([t[0] for t in tips.values()]))
    p = {**mq.PARAMS, "a": 1.3, "b": 0.7}
    for exact, plain in (
        (lambda q: hmm.tree_slopes(tree, tips, q), lambda q: hmm.tree_probability(tree, tips, q)),
        (lambda q: hmm.tip_slopes(tree, tips, q, "3"), lambda q: hmm.tip_probability(tree, tips, q, "3")),
        (lambda q: hmm.column_slopes(tree, tips, same, 7, q), lambda q: hmm.column_emission(tree, tips, same, 7, q)),
    ):
        value, slopes = exact(p)
        assert value == pytest.approx(plain(p))
        for name, slope in slopes.items():
            assert slope * hmm.bounded_slope(name, p[name]) == pytest.approx(hmm.emission_gradient(plain, p, name), rel=1e-4, abs=1e-8), name


def test_gradients_of_a_record_with_slopes():
    import pandas as pd

    from clademill.plans import model_queries as mq

    rng = np.random.default_rng(9)
    part = pd.DataFrame([(1, r, i, "-" if rng.random() < 0.4 else "A") for r in range(1, 6) for i in range(25)], columns=["OGid", "ppid", "pos", "sym"])
    (with_slopes,) = mq.tree_records([mq.labelled(part)])
    plain = hmm.Record(with_slopes.states, with_slopes.emissions)
    tree, tips, _ = mq._tips(part)
    same = hmm.unchanged(np.array([t[0] for t in tips.values()]))
    for state, emission in zip(mq.STATES, with_slopes.emissions):  # shared patterns give what the columns one by one do
        assert emission(state) == pytest.approx(hmm.column_emission(tree, tips, same, 5, state))
    start, move = np.full(3, 1 / 3), np.full((3, 3), 0.1) + 0.7 * np.eye(3)
    one, two = (hmm.gradients(r, start, move, mq.STATES) for r in (with_slopes, plain))
    assert one[0] == pytest.approx(two[0]) and one[1] == pytest.approx(two[1])
    assert [x for own in one[2] for x in own.values()] == pytest.approx([own[name] for k, own in enumerate(two[2]) for name in one[2][k]], rel=1e-4, abs=1e-6)


def columns_of(rng, states, rows=5):
    """Alignments along paths of three states: few gaps, blocks of gaps, nearly all gaps."""
    share = np.array([0.1, 0.5, 0.9])[states]
    gaps = (rng.random((rows, len(states))) < share).astype(np.uint8)
    keep = rng.random(len(states)) < 0.5
    for i in range(1, len(states)):
        if keep[i]:
            gaps[:, i] = gaps[:, i - 1]
    return states.astype(np.int8), [str(r) for r in range(1, rows + 1)], 1 - gaps


def test_quasi_newton_beats_descent():
    from clademill.plans import model_queries as mq

    rng = np.random.default_rng(2)
    made = [columns_of(rng, np.repeat(rng.integers(0, 3, 12), 6)) for _ in range(6)]
    records = mq.tree_records(made)
    columns = sum(len(r.states) for r in records)

    def total(move, params):
        return np.sum([hmm._flat(hmm.gradients(r, mq.START, move, params)) for r in mq.tree_records(made)], axis=0)

    best, history = hmm.quasi_newton(total, len(records), columns, mq.MOVE, mq.STATES, epsilon=0.1, steps=300)
    plain, slow = hmm.descend(total, len(records), columns, mq.MOVE, mq.STATES, 1.0, 0.7, 0.0, 150, True)
    assert len(history) < 150 and best[0] == max(history) and best[0] > plain[0] - 0.1
    # what it ends at is a maximum: gradients are small beside those of the start
    at = lambda model: np.abs(total(model[1], model[2])[1:]).max()
    assert at(best) < 0.1 * at((0, mq.MOVE, mq.STATES))
    value, by_move = total(best[1], best[2])[:2]
    assert value == pytest.approx(best[0])


def test_rows_share_patterns_too():
    from clademill.plans import model_queries as mq

    rng = np.random.default_rng(5)
    made = [(x := columns_of(rng, rng.integers(0, 3, 40)), (1 - x[2]).astype(np.int8)) for _ in range(3)]
    prepared = [(gaps, names, residues) for (_, names, residues), gaps in made]
    records = mq.row_records(prepared)
    assert len(records) == 15
    for n, record in enumerate(records):
        names, residues = prepared[n // 5][1:]
        tips = {name: np.array([1.0 - row, row]) for name, row in zip(names, residues)}
        tree = newick.pruned(newick.parse(mq.TREE), set(names))
        for state, slopes in zip(mq.ROW_STATES, record.slopes):
            (value, by), (want, by_want) = slopes(state), hmm.tip_slopes(tree, tips, state, names[n % 5])
            assert value == pytest.approx(want) and all(by[k] == pytest.approx(by_want[k]) for k in by_want)

    def total(move, params):
        return np.sum([hmm._flat(hmm.gradients(r, mq.ROW_START, move, params)) for r in mq.row_records(prepared)], axis=0)

    best, history = hmm.quasi_newton(total, 15, 600, mq.ROW_MOVE, mq.ROW_STATES, epsilon=0.05, steps=100)
    assert best[0] == max(history) > history[0] + 10 and len(history) <= 100


def test_chains_side_by_side():
    from clademill.plans import model_queries as mq

    rng = np.random.default_rng(6)
    made = [columns_of(rng, rng.integers(0, 3, n), rows) for n, rows in ((40, 5), (1, 5), (17, 4), (60, 5), (40, 4))]
    rows = [((1 - r).astype(np.int8), names, r) for _, names, r in made]
    for prepared, records, chains, start, move, params in (
        (made, mq.tree_records, mq.tree_chains, mq.START, mq.MOVE, mq.STATES), (rows, mq.row_records, mq.row_chains, mq.ROW_START, mq.ROW_MOVE, mq.ROW_STATES)
    ):
        want = np.sum([hmm._flat(hmm.gradients(r, start, move, params)) for r in records(prepared)], axis=0)
        assert np.sum([hmm._flat(c.gradients(start, move, params)) for c in chains(prepared)], axis=0) == pytest.approx(want)
    for own, coded in mq.coded_columns([x[1:] for x in made]):
        for i, found in zip(own, coded.posteriors(mq.START, mq.MOVE, mq.STATES)):
            emit, _ = mq.tree_records([made[i]])[0].emitted(mq.STATES)
            assert found == pytest.approx(hmm.Chain(mq.START, mq.MOVE, emit).posterior())
    empty = hmm.Coded([np.zeros(0, int)], [mq._large_slopes] * 2, [np.zeros(0, int)])
    assert empty.gradients(np.full(2, 0.5), np.full((2, 2), 0.5), [{"p1": 0.4}] * 2)[0] == 0 and len(empty.posteriors(np.full(2, 0.5), np.full((2, 2), 0.5), [{"p1": 0.4}] * 2)[0]) == 0


def test_registered_row_fit(spark):
    from clademill.plans import model_queries as mq

    found = {(r.name, r.k): r.x for r in mq.missing_fit(spark, "/root/testdata/sf0.001").collect()}
    assert found["value", 0] > found["first_value", 0] + 1 and 2 < found["steps", 0] <= 100
    assert found["move", 0] + found["move", 1] == pytest.approx(1)


def test_registered_tree_fit(spark):
    from clademill.plans import model_queries as mq

    sf = "/root/testdata/sf0.001"
    found = {(r.name, r.k): r.x for r in mq.insertion_fit(spark, sf).collect()}
    assert 2 < found["steps", 0] < 300 and found["value", 0] > found["first_value", 0] + 1
    assert all(sum(found["move", 3 * k + j] for j in range(3)) == pytest.approx(1) for k in range(3))
    fitted = mq.fitted_decode(spark, sf).toPandas()
    assert np.allclose(fitted[["p1", "p2", "p3"]].sum(axis=1), 1)
    plain = mq.insertion_decode(spark, sf).toPandas()
    assert len(plain) == len(fitted) and not np.allclose(plain.sort_values(["OGid", "pos"])["p1"], fitted.sort_values(["OGid", "pos"])["p1"])


def test_blocks_give_the_recursion(spark):
    rng = np.random.default_rng(4)
    start, move = np.array([0.6, 0.3, 0.1]), np.array([[0.9, 0.08, 0.02], [0.1, 0.8, 0.1], [0.0, 0.3, 0.7]])
    sizes = {"a": 1, "b": 7, "c": 100, "d": 3000}
    emits = {k: rng.random((n, 3)) ** 8 * 1e-12 + 1e-300 for k, n in sizes.items()}
    columns = spark.createDataFrame([(k, i, [float(x) for x in row]) for k, e in emits.items() for i, row in enumerate(e)], "k string, pos long, emit array<double>")
    for block in (7, 4096):
        found = {(r.k, r.pos): r.posterior for r in hmm.blocked_posterior(columns, "k", start, move, block).collect()}
        assert len(found) == sum(sizes.values())
        for k, e in emits.items():
            want = hmm.Chain(start, move, e.T).posterior()
            assert np.abs(np.array([found[k, i] for i in range(len(e))]) - want).max() < 1e-9
    assert hmm.blocked_posterior(columns.where("false"), "k", start, move).count() == 0


def test_equal_scores_go_to_the_first_row(spark):
    rng = np.random.default_rng(7)
    cells = []
    for g in range(40):
        one, two = rng.random((2, 30)) < 0.5
        others = rng.random((6, 30)) < rng.random(30)
        every = {"1": [*one, *two], "2": [*two, *one]} | {str(3 + k): [*x, *x] for k, x in enumerate(others)}
        cells += [(g, "g" if r in "12" else r, r, i, "A" if x else "-") for r, xs in every.items() for i, x in enumerate(xs)]
    d = spark.createDataFrame(cells, "OGid int, gnid string, ppid string, pos int, sym string").repartition(5)
    assert {r.ppid for r in msa.representatives(d).where("gnid = 'g'").collect()} == {"1"}


def test_joint_probabilities_need_no_python(spark):
    from clademill.plans import model_queries as mq

    assert "FlatMapGroups" not in mq.path_likelihoods(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_missing_rows_of_many_alignments_at_once(spark):
    from clademill.plans import model_queries as mq

    for query in (mq.hidden_tips, mq.missing_decode):
        assert "FlatMapGroups" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rng = np.random.default_rng(10)
    made = [(names, r) for _, names, r in (columns_of(rng, np.repeat(rng.integers(0, 3, 8), 6), rows) for rows in (5, 4, 5))]
    want = []
    for i, (names, residues) in enumerate(made):
        tips = {name: np.array([1.0 - x, x]) for name, x in zip(names, residues)}
        for k, name in enumerate(names):
            likely = hmm.tip_probability(mq._pruned(tuple(names)), tips, mq.PARAMS, name)
            chain = hmm.Chain(np.array([0.95, 0.05]), np.array([[0.98, 0.02], [0.1, 0.9]]), np.array([likely, 1 - likely]))
            want += [(i, k, a, b) for a, b in msa.missing_segments(chain.posterior()[:, 1], residues[k] == 0)]
    assert want and sorted(x[:4] for x in mq._missing(made)) == want


def test_ids_of_more_than_four_digits():
    import duckdb

    from clademill.plans import graph_queries as gq

    sql = gq.SQL["ranked_ids"].replace("FROM lineitem", "FROM (SELECT k AS l_orderkey, 1 AS l_partkey, 1 AS l_suppkey, 1 AS l_linenumber, 1 AS l_extendedprice, 1 AS l_quantity FROM range(65538) t(k))")
    found = [r[0] for r in duckdb.sql(f"SELECT id FROM ({sql}) ORDER BY OGid DESC").fetchall()]
    assert found == [f"{k:04X}" for k in range(65538)]
