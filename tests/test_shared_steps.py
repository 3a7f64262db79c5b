"""Steps that several queries share hold a bounded part of their table in one task, and give what plain counting gives."""

from collections import defaultdict


def test_metadata_counts_without_expanding_rows(spark):
    from clademill.operators import groups

    edges = [(1, 1, 2), (1, 1, 2), (1, 2, 1), (1, 3, 3), (2, 2, 3), (2, 4, 1), (3, 5, 6)]
    scores = [(1, 2, 10), (1, 2, 12), (2, 1, 5), (3, 3, 7), (3, 2, 4), (4, 1, None), (6, 5, 9)]
    proteins = [(p, p // 2, p % 3, None if p == 6 else p % 2) for p in range(1, 7)]
    e, s = spark.createDataFrame(edges, "OGid long, src long, dst long"), spark.createDataFrame(scores, "src long, dst long, bitscore long")
    found = groups.metadata(e, spark.createDataFrame(proteins, "ppid long, sqid long, gnid long, spid long"), s)
    best = defaultdict(int)
    for a, b, x in scores:
        best[a, b] = max(best[a, b], x or 0)
    want = {}
    for g in {g for g, _, _ in edges}:
        own = [(a, b) for h, a, b in edges if h == g]
        rows = [p for p in proteins if p[0] in {x for pair in own for x in pair}]
        want[g] = (*(len({p[k] for p in rows} - {None}) for k in range(4)), len(own), sum(best[a, b] + best[b, a] for a, b in own))
    assert {r.OGid: (r.ppidnum, r.sqidnum, r.gnidnum, r.spidnum, r.edgenum, r.bitscore) for r in found.collect()} == want
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_products_held_at_once_are_bounded(monkeypatch):
    """A cell of the greatest size needs little memory beside its vectors, and the number of products held changes no result."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from clademill.operators import products

    rng = np.random.default_rng(3)

    def cell(n, at):
        return pa.table({"id": np.arange(at, at + n), "label": rng.integers(0, 10, n).astype(np.int32), "e": pa.array(rng.integers(-99, 99, (n, 8)).tolist(), pa.list_(pa.int32()))})

    a, b = cell(1024, 0), cell(products.CELL, 10_000)
    tracemalloc.start()
    whole = pa.concat_tables([*products._best(a, b, 2)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # 1024 x 8192 products alone are 64 MB
    monkeypatch.setattr(products, "PRODUCTS", 40_000)
    parts = pa.concat_tables([*products._best(a, b, 2)])
    order = [("src", "ascending"), ("dst", "ascending")]
    assert parts.sort_by(order).equals(whole.sort_by(order))


def test_fasta_records_are_not_shuffled(spark, tmp_path):
    """Only one row a file goes to the others, whatever Spark thinks of its size."""
    from clademill.sources import files

    (tmp_path / "one.fa").write_text(">a\nAC\n>b\nGT\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = files.read_fasta(spark, f"file://{tmp_path}")
        assert {(r.header, r.seq) for r in found.collect()} == {(">a", "AC"), (">b", "GT")}
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counts_of_groups_are_one_shuffle(spark):
    """Distinct counts of small groups at their place, of large ones by value; nulls don't count, null groups do."""
    from pyspark.sql import functions as F

    from clademill.operators import groups

    rows = [(g, (7 * i) % m, None if i % 4 == 0 else i % 3, i) for g, (n, m) in {1: (5, 2), 2: (40, 9), 3: (1, 1), None: (6, 5)}.items() for i in range(n)]
    table = spark.createDataFrame(rows, "OGid long, gnid long, spid long, bitscore long")
    want = {}
    for g in (1, 2, 3, None):
        own = [r for r in rows if r[0] == g]
        want[g] = (*(len({r[k] for r in own} - {None}) for k in (1, 2)), len(own), sum(r[3] for r in own))
    sums = F.count("*").alias("edgenum"), F.sum("bitscore").alias("total")
    for large in (1_000_000, 20, 1):
        found = groups.counted(table, "OGid", ("gnid", "spid"), *sums, large=large)
        assert {r.OGid: (r.gnidnum, r.spidnum, r.edgenum, r.total) for r in found.collect()} == want
    plan = groups.counted(table, "OGid", ("gnid", "spid"), *sums)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Expand" not in plan and plan.count("Exchange") == 1


def test_best_products_by_blocks():
    """The k greatest of each row with all ties, whatever the blocks; small whole numbers are multiplied in single precision, great ones are not."""
    import numpy as np
    import pyarrow as pa

    from clademill.operators import products

    rng = np.random.default_rng(8)
    for width, k, high in ((3, 3, 5), (47, 3, 5), (48, 3, 1000), (500, 3, 20), (500, 1, 20), (130, 5, 3), (64, 2, 1), (1, 1, 9)):
        part = rng.integers(0, high, (40, width)).astype(np.float32)
        q, s, value = products._above(part, k)
        want = {(i, j) for i, row in enumerate(part) for j, x in enumerate(row) if x >= np.sort(row)[-k]}
        assert {*zip(q.tolist(), s.tolist())} == want and len(q) == len(want) and (value == part[q, s]).all()

    def cell(most):
        return pa.table({"e": pa.array(rng.integers(-most, most, (200, 64)).tolist(), pa.list_(pa.int32()))})

    for most, kind in ((500, np.float32), (5000, np.float64)):
        a, b = products._matrices(cell(most), cell(most))
        assert a.dtype == b.dtype == kind and (a @ b.T == a.astype(np.int64) @ b.astype(np.int64).T).all()
