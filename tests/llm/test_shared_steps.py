def test_open_buckets_are_joined_once(spark):
    """The rows of open buckets are read several times; the joins that find them run once."""
    from clademill.llm import near_dups

    meetings = spark.createDataFrame([(band, node, 0) for band in (7, 8) for node in range(4)], "band long, node long, hub long")
    alike = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.3), (3, 0, 0.3)], "node long, hub long, alike double")
    found = near_dups.open_buckets(meetings, alike)
    assert sorted(r.node for r in found.collect()) == [0, 1, 2, 3]  # two bands of the same members are one bucket
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
