"""Queries on regions of alignments, labelled intervals, subsets of groups and what stands between tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clademill.operators import graphs, groups, labels, msa, regions
from clademill.plans.inputs import HSPS_SQL, LINES_SQL, PROFILE_SQL, SYMBOLS_SQL, hsps, lines, profile, symbols, table
from clademill.sources import files

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbols with weights: genes are species here, of weights 0.2, 0.3 and 0.5, shared by their rows."""
    s = symbols(spark, sf_dir)
    species = spark.createDataFrame([(0, 0.2), (1, 0.3), (2, 0.5)], "gnid int, weight double")
    rows = regions.row_weights(s.select("OGid", "ppid", "gnid").distinct(), species, species="gnid")
    return s.join(rows.select("OGid", "ppid", "weight"), ["OGid", "ppid"])


WEIGHTED_SQL = SYMBOLS_SQL + """,
w AS (SELECT OGid, ppid, CASE gnid WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END / count(*) OVER (PARTITION BY OGid, gnid) AS weight FROM (SELECT DISTINCT OGid, ppid, gnid FROM symbols)),
weighted AS (SELECT * FROM symbols JOIN w USING (OGid, ppid))"""
REGIONS_SQL = WEIGHTED_SQL + """,
prof AS (SELECT OGid, pos, (count(*) FILTER (sym = '-') <= 2)::INT AS good FROM symbols GROUP BY 1, 2),
wide AS (SELECT *, max(good) OVER (PARTITION BY OGid ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d FROM prof),
shut AS (SELECT OGid, pos, CASE WHEN lag(d) OVER o IS NULL OR lead(d) OVER o IS NULL THEN 0 ELSE least(lag(d) OVER o, d, lead(d) OVER o) END AS c FROM wide WINDOW o AS (PARTITION BY OGid ORDER BY pos)),
marks AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER (PARTITION BY OGid ORDER BY pos) THEN 1 ELSE 0 END AS new FROM shut),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY OGid ORDER BY pos) AS run FROM marks),
runs AS (SELECT OGid, run, c, min(pos) AS start, max(pos) + 1 AS stop FROM numbered GROUP BY 1, 2, 3),
slices AS (SELECT OGid, start, stop FROM runs WHERE c = 1 AND stop - start >= 5)"""


def good_slices(s: DataFrame) -> DataFrame:
    return regions.regions(msa.gap_profile(s), F.col("gaps") <= 2, 5)


@query(f"WITH {WEIGHTED_SQL} SELECT DISTINCT OGid, ppid, round(weight, 9) AS weight FROM weighted")
def row_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(spark, sf_dir).select("OGid", "ppid", F.round("weight", 9).alias("weight")).distinct()


@query(f"WITH {WEIGHTED_SQL} SELECT OGid, pos, round(sum(CASE WHEN sym <> '-' THEN weight ELSE 0 END), 6) AS occupancy FROM weighted GROUP BY 1, 2")
def weighted_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.occupancy(weighted(spark, sf_dir), F.col("weight")).select("OGid", "pos", F.round("occupancy", 6).alias("occupancy"))


@query(f"WITH {REGIONS_SQL} SELECT * FROM slices")
def good_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return good_slices(symbols(spark, sf_dir))


@query(f"""WITH {REGIONS_SQL}, rest AS (SELECT OGid, start, stop, CASE WHEN lag(stop) OVER (PARTITION BY OGid ORDER BY start) = start THEN 0 ELSE 1 END AS first FROM runs WHERE c = 0 OR stop - start < 5),
r AS (SELECT *, sum(first) OVER (PARTITION BY OGid ORDER BY start) AS k FROM rest) SELECT OGid, min(start) AS start, max(stop) AS stop FROM r GROUP BY OGid, k""")
def regions_to_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.other_regions(msa.gap_profile(symbols(spark, sf_dir)), F.col("gaps") <= 2, 5)


SCORES_SQL = REGIONS_SQL + """,
inside AS (SELECT t.*, s.start, s.stop FROM weighted t JOIN slices s ON t.OGid = s.OGid AND t.pos >= s.start AND t.pos < s.stop),
shares AS (SELECT OGid, pos, sym, ln(sum(weight) / sum(sum(weight)) OVER (PARTITION BY OGid, pos)) AS l FROM inside GROUP BY OGid, pos, sym),
scored AS (SELECT OGid, ppid, sum(l) AS score FROM inside JOIN shares USING (OGid, pos, sym) GROUP BY 1, 2),
scores AS (SELECT w.OGid, w.ppid, coalesce(score, 0) AS score FROM w LEFT JOIN scored USING (OGid, ppid))"""


@query(f"WITH {SCORES_SQL} SELECT OGid, ppid, round(score, 6) AS score FROM scores")
def row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = weighted(spark, sf_dir)
    return regions.row_scores(s, good_slices(s)).withColumn("score", F.round("score", 6))


@query(f"""WITH {SCORES_SQL}, g AS (SELECT OGid, avg(score) AS mean, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM scores GROUP BY 1)
SELECT OGid, ppid, round(score - mean, 6) AS x, round(iqr, 6) AS iqr FROM scores JOIN g USING (OGid) WHERE score < mean AND iqr < (score - mean) * (score - mean) - 1""")
def row_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = weighted(spark, sf_dir)
    return regions.outliers(regions.row_scores(s, good_slices(s)), a=1.0).select("OGid", "ppid", F.round("x", 6).alias("x"), F.round("iqr", 6).alias("iqr"))


@query(f"""WITH {REGIONS_SQL}, i AS (SELECT t.OGid, t.ppid, t.pos, s.start, s.stop, (sym <> '-')::INT AS r FROM symbols t JOIN slices s ON t.OGid = s.OGid AND t.pos >= s.start AND t.pos < s.stop),
a AS (SELECT *, sum(r) OVER (PARTITION BY OGid, pos) AS every FROM i) SELECT OGid, start, stop, ppid, sum(r)::BIGINT AS sym_count, sum(r * (every - 1))::BIGINT AS align_count FROM a GROUP BY ALL""")
def slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    return regions.slice_counts(s, good_slices(s))


@query(f"WITH {SYMBOLS_SQL}, c AS (SELECT OGid, pos, bool_or(sym = '-') AS zero FROM symbols GROUP BY 1, 2) SELECT 'all' AS pool, count(*) AS pool_size FROM c UNION ALL SELECT 'NI', count(*) FROM c WHERE zero")
def binary_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.binary_flags(regions.binary(symbols(spark, sf_dir))).select(F.explode("pools").alias("pool")).groupBy("pool").agg(F.count("*").alias("pool_size"))


@query(f"""WITH {SYMBOLS_SQL}, rows AS (SELECT OGid, ppid, string_agg(sym, '' ORDER BY pos) AS seq FROM symbols GROUP BY 1, 2),
again AS (SELECT OGid, ppid, rtrim(replace(seq[4:9], '-', ''), ' ') AS part, seq FROM rows),
width AS (SELECT OGid, max(length(part)) AS n FROM again GROUP BY 1)
SELECT OGid, ppid, seq[1:3] || rpad(part, n::INT, '-') || seq[10:] AS seq FROM again JOIN width USING (OGid)""")
def stitched_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns 3 to 8 replaced by their residues, left-aligned; rows without one get gaps from the stitching."""
    rows = msa.assembled(symbols(spark, sf_dir), ["OGid", "ppid"])
    part = F.regexp_replace(F.substring("seq", 4, 6), "-", "")
    own = rows.select("OGid", "ppid", part.alias("part")).where("part <> ''")
    width = F.max(F.length("part")).over(Window.partitionBy("OGid"))
    again = own.withColumn("__w", width).select("OGid", "ppid", F.lit(3).alias("start"), F.lit(9).alias("stop"), F.expr("rpad(part, __w, '-')").alias("seq"))
    return regions.stitched(rows, again).select("OGid", "ppid", "seq")


@query(f"WITH {PROFILE_SQL} SELECT OGid, pos, CASE x WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS tip_rank FROM profile")
def tip_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.in_tip_order(profile(spark, sf_dir), ["3", "1", "2"], "x").select("OGid", "pos", "tip_rank")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as labelled intervals, some of them empty, repeated or apart."""
    at = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("OGid"), (at - 1 + (F.col("l_partkey") % 5 == 0).cast("int")).alias("start"), at.alias("stop"), F.col("l_returnflag").alias("label"))


INTERVALS_SQL = "intervals AS (SELECT l_orderkey AS OGid, l_linenumber - 1 + (l_partkey % 5 = 0)::INT AS start, l_linenumber AS stop, l_returnflag AS label FROM lineitem)"


@query(f"""WITH {INTERVALS_SQL}, b AS (SELECT *, lag(stop) OVER o AS before, lag(label) OVER o AS l FROM intervals WINDOW o AS (PARTITION BY OGid ORDER BY start, stop, label)),
p AS (SELECT *, 'start' AS problem FROM b WHERE before IS NULL AND start <> 0 UNION ALL SELECT *, 'empty' FROM b WHERE stop <= start
UNION ALL SELECT *, 'break' FROM b WHERE before <> start UNION ALL SELECT *, 'repeat' FROM b WHERE l = label) SELECT OGid, start, stop, label, problem FROM p""")
def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.violations(intervals(spark, sf_dir), ["OGid"])


@query(f"WITH {INTERVALS_SQL} SELECT label, sum(stop - start)::BIGINT AS columns, count(*) AS intervals FROM intervals GROUP BY 1")
def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.totals(intervals(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, m AS (SELECT OGid, gnid AS ppid, gnid, spid % 5 AS spid FROM lines),
c AS (SELECT OGid, count(DISTINCT gnid) AS g, count(DISTINCT spid) AS s FROM m GROUP BY 1),
a AS (SELECT DISTINCT OGid FROM m WHERE ppid IN (SELECT ppid FROM m GROUP BY 1 HAVING count(DISTINCT OGid) = 1))
SELECT c.OGid, s = 5 AND g = 5 AS single, s = 5 AND g = 5 AND a.OGid IS NOT NULL AS "unique" FROM c LEFT JOIN a USING (OGid)""")
def group_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.subsets(lines(spark, sf_dir).select("OGid", F.col("gnid").alias("ppid"), "gnid", (F.col("spid") % 5).alias("spid")), 5)


@query(f"""WITH {LINES_SQL}, a AS (SELECT DISTINCT OGid, gnid FROM lines WHERE length <= 30), b AS (SELECT DISTINCT OGid, gnid FROM lines WHERE length <= 40 OR bitscore < 20000)
SELECT OGid, (SELECT count(*) FROM a x WHERE x.OGid = g.OGid) AS gnidnum1, (SELECT count(*) FROM b x WHERE x.OGid = g.OGid) AS gnidnum2,
(SELECT count(*) FROM b x WHERE x.OGid = g.OGid AND NOT EXISTS (FROM a y WHERE y.OGid = x.OGid AND y.gnid = x.gnid)) AS delta FROM (SELECT DISTINCT OGid FROM a) g""")
def paralog_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lines(spark, sf_dir)
    return groups.added_members(m.where("length <= 30"), m.where("length <= 40 or bitscore < 20000"), item="gnid")


@query(f"WITH {LINES_SQL} SELECT groups, count(*) AS n FROM (SELECT count(DISTINCT OGid) AS groups FROM lines GROUP BY gnid) GROUP BY 1")
def membership_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.multiplicity(lines(spark, sf_dir), "OGid", "gnid")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_returnflag = 'R' AND NOT l_linestatus = 'F'")
def rows_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("error1"), (F.col("l_linestatus") == "F").alias("error2"))
    return groups.without_errors(li, ["error1", "error2"]).select("l_orderkey", "l_linenumber")


@query("SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, sum(l_quantity)::BIGINT AS weight FROM lineitem GROUP BY 1, 2")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").cast("long").alias("bitscore"))
    return graphs.edge_weights(edges)


@query(f"WITH {HSPS_SQL} SELECT DISTINCT qppid, sppid FROM hsps")
def hsp_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hsps(spark, sf_dir).select("qppid", "sppid").distinct()


@query(f"""WITH {LINES_SQL}, e AS (SELECT OGid, count(*) AS edges, count(DISTINCT gnid) + count(DISTINCT spid) AS nodes FROM lines GROUP BY 1)
SELECT OGid, round(2.0 * edges / (nodes * (nodes - 1)), 9) AS density FROM e""")
def edge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lines(spark, sf_dir).groupBy("OGid").agg(F.count("*").alias("edges"), (F.countDistinct("gnid") + F.countDistinct("spid")).alias("nodes"))
    return e.select("OGid", F.round(groups.density(F.col("edges"), F.col("nodes")), 9).alias("density"))


@query(f"""WITH {SYMBOLS_SQL}, rows AS (SELECT OGid, ppid, string_agg(sym, '' ORDER BY pos) AS seq FROM symbols GROUP BY 1, 2)
SELECT OGid, count(*) AS records, sum(length(seq))::BIGINT AS symbols, sum(ceil(length(seq) / 80) + 1)::BIGINT AS lines FROM rows GROUP BY 1""")
def group_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTA text of each group, and what reading it gives."""
    rows = msa.assembled(symbols(spark, sf_dir), ["OGid", "ppid"])
    texts = files.group_fasta(rows.withColumn("header", F.format_string(">ppid=%d", "ppid")), "OGid", ["ppid"])
    back = files.fasta_records(texts.withColumn("n", F.size(F.split("text", "\n")).cast("long")), "text")
    return back.groupBy("OGid").agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("symbols"), F.max("n").alias("lines"))


@query("SELECT 'orders: ' || count(*) || chr(10) || 'customers: ' || count(DISTINCT o_custkey) AS text FROM orders")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.report(table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers")))
