"""Queries on groups, statistics, alignments and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions import sequences
from clademill.operators import groups, hits, msa, stats
from clademill.plans.inputs import LINES_SQL, PROFILE_SQL, SYMBOLS_SQL, lines, profile, symbols, table
from clademill.sources import files
from clademill.storage import stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {LINES_SQL} SELECT OGid, count(*) AS edgenum, count(DISTINCT gnid) AS gnidnum, count(DISTINCT spid) AS spidnum,
(round_even(sum(bitscore)::DOUBLE, 1) * 10)::BIGINT AS tenths FROM lines GROUP BY OGid""")
def group_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.bround(F.sum("bitscore").cast("double"), 1)
    own = lines(spark, sf_dir).select("OGid", "gnid", "spid", "bitscore")
    found = groups.counted(own, "OGid", ("gnid", "spid"), F.count("*").alias("edgenum"), F.round(total * 10).cast("long").alias("tenths"))
    return found.select("OGid", "edgenum", "gnidnum", "spidnum", "tenths")


@query(f"""WITH {LINES_SQL}, e AS (SELECT OGid, gnid AS src, spid AS dst, bitscore FROM lines WHERE gnid <> spid), d AS (SELECT src, dst, max(bitscore) AS s FROM e GROUP BY 1, 2),
m AS (SELECT OGid, src, dst FROM e UNION ALL SELECT OGid, dst, src FROM e),
g AS (SELECT OGid, (count(*) // 2)::BIGINT AS edgenum, sum(coalesce(s, 0)) AS total FROM m LEFT JOIN d USING (src, dst) GROUP BY OGid),
n AS (SELECT DISTINCT OGid, unnest([src, dst]) AS ppid FROM e)
SELECT OGid, edgenum, round_even(total, 1)::DECIMAL(18,1) AS bitscore, count(DISTINCT ppid) AS ppidnum, count(DISTINCT ppid) AS sqidnum, count(DISTINCT ppid % 97) AS gnidnum, count(DISTINCT ppid % 11) AS spidnum
FROM g JOIN n USING (OGid) GROUP BY ALL""")
def orthogroup_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lines(spark, sf_dir).where("gnid <> spid").select("OGid", F.col("gnid").alias("src"), F.col("spid").alias("dst"), "bitscore")
    proteins = e.select(F.col("src").alias("ppid")).union(e.select("dst")).distinct().select("ppid", F.col("ppid").alias("sqid"), (F.col("ppid") % 97).alias("gnid"), (F.col("ppid") % 11).alias("spid"))
    out = groups.metadata(e, proteins, e)
    return out.withColumn("bitscore", F.col("bitscore").cast("decimal(18,1)"))


@query("""SELECT o_custkey AS GGid, o_orderkey AS OGid FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def group_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("GGid"), F.col("o_orderkey").alias("OGid"), F.col("o_orderpriority").alias("spidnum"), F.col("o_totalprice").alias("bitscore"))
    return groups.representatives(o).select("GGid", "OGid")


@query(f"WITH {LINES_SQL} SELECT OGid, count(DISTINCT gnid) AS gnidnum, count(DISTINCT spid) AS spidnum FROM lines GROUP BY OGid HAVING count(DISTINCT gnid) = count(DISTINCT spid) AND count(DISTINCT spid) >= 4")
def single_copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.single_copy(lines(spark, sf_dir), least=4)


@query("""WITH m AS (SELECT o_orderkey AS OGid, n_regionkey AS rule, n_nationkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT OGid, rule, count(DISTINCT item) AS n FROM m GROUP BY 1, 2)
SELECT OGid FROM c WHERE rule IN (0, 1, 2) GROUP BY OGid HAVING count(*) FILTER (n >= 1) = 3""")
def satisfying_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a supplier's nation of each of three regions."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    members = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == s.s_suppkey).select(F.col("l_orderkey").alias("OGid"), F.col("s_nationkey").alias("spid"))
    rules = n.where(F.col("n_regionkey").isin(0, 1, 2)).select(F.col("n_regionkey").alias("rule"), F.col("n_nationkey").alias("item"), F.lit(1).alias("min"))
    return groups.satisfying(members, rules)


@query("SELECT l_orderkey AS OGid FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 5 AND count(DISTINCT l_partkey) = 5 AND count(DISTINCT l_suppkey) = 5")
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.complete(lines(spark, sf_dir), 5)


@query("""WITH m AS (SELECT DISTINCT user_id AS g, event_type AS i FROM events WHERE user_id IS NOT NULL AND value > 60), u AS (SELECT DISTINCT i FROM m), s AS (SELECT g FROM m GROUP BY g HAVING count(*) = (SELECT count(*) - 1 FROM u))
SELECT i AS spid, count(*) AS n FROM s, u WHERE NOT EXISTS (FROM m WHERE m.g = s.g AND m.i = u.i) GROUP BY i""")
def missing_one_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").where("user_id is not null and value > 60").select(F.col("user_id").alias("OGid"), F.col("event_type").alias("spid"))
    return groups.missing_one(m, m)


@query("SELECT lang AS gnid, doc_id AS ppid, first_value(doc_id) OVER (PARTITION BY lang, text ORDER BY doc_id) AS sqid FROM documents")
def sequence_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal texts in a language; texts are compared by two hashes, so that they needn't be moved."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("gnid"), F.col("doc_id").alias("ppid"), F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.length("text")).alias("seq"))
    return groups.sequence_representatives(d, "ppid").select("gnid", "ppid", "sqid")


@query("SELECT date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS day, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(table(spark, sf_dir, "lineitem").select(F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("day")), "day")


@query("SELECT n AS gnidnum, count(*) AS n FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey) GROUP BY 1")
def distinct_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("gnidnum"))
    return stats.value_counts(per, "gnidnum")


@query("SELECT l_suppkey AS spid, count(*) - count(DISTINCT l_partkey) AS duplicates FROM lineitem GROUP BY 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("spid")).agg((F.count("*") - F.countDistinct("l_partkey")).alias("duplicates"))


@query("SELECT l_returnflag AS flag, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.var_samp("l_quantity"), 6).alias("variance"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("SELECT l_suppkey AS spid, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem GROUP BY 1")
def group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.spread(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "spid"), "l_quantity", ["spid"])
    return found.select("spid", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "iqr")


@query("SELECT least(floor((l_quantity - lo) / (hi - lo) * 50)::INT, 49) AS bin, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 50)


@query("""SELECT least(floor((l_quantity - a) / (b - a) * 20)::INT, 19) AS xbin, least(floor((l_linenumber - c) / (d - c) * 20)::INT, 19) AS ybin, count(*) AS n
FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_linenumber) AS c, max(l_linenumber) AS d FROM lineitem) GROUP BY 1, 2""")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber", 20)


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE r <= ceil(0.9 * n)")
def quantile_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.quantile_prefix(li, "l_extendedprice", 0.9, ["l_suppkey"], ["l_orderkey", "l_linenumber"]).drop("l_extendedprice")


@query("SELECT l_suppkey AS spid, round(greatest(coalesce(avg(l_quantity) FILTER (r > 5), 2), 2), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) GROUP BY 1")
def trimmed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("spid"), "l_orderkey", "l_linenumber", "l_quantity")
    return stats.trimmed_mean(li, "l_quantity", ["spid"], ["l_orderkey", "l_linenumber"]).select("spid", F.round("mean", 6).alias("mean"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 150")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(150)


@query("SELECT count(*) AS every, count(*) FILTER (l_returnflag = 'R') AS best, count(*) FILTER (l_returnflag = 'R' AND l_quantity >= 25) AS covered, count(*) FILTER (l_returnflag = 'R' AND l_quantity >= 25 AND l_linestatus = 'F') AS reciprocal FROM lineitem")
def cascaded_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cascade(table(spark, sf_dir, "lineitem"), best=F.col("l_returnflag") == "R", covered=F.col("l_quantity") >= 25, reciprocal=F.col("l_linestatus") == "F")


@query("SELECT l_partkey AS sppid, count(DISTINCT l_orderkey) AS hitnum FROM lineitem GROUP BY 1")
def subject_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ranked_subjects(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sppid"), "l_orderkey"), "sppid", "l_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity / 100 AS pident, l_partkey + 9 - l_partkey + 1 AS nqa, (l_partkey + 9 - l_partkey + 1) / (l_suppkey + 10) AS fqa, CASE WHEN l_discount > 0 THEN round(log10(l_discount), 9) ELSE -180 END AS logevalue FROM lineitem""")
def hsp_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cols = {"nident": F.col("l_quantity"), "length": F.lit(100), "qstart": F.col("l_partkey"), "qend": F.col("l_partkey") + 9, "qlen": F.col("l_suppkey") + 10, "sstart": F.lit(1), "send": F.lit(2), "slen": F.lit(4), "evalue": F.col("l_discount")}
    out = hits.derived_hsp_columns(li.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in cols.items())))
    return out.select("l_orderkey", "l_linenumber", "pident", "nqa", "fqa", F.round("logevalue", 9).alias("logevalue"))


@query(f"WITH {PROFILE_SQL} SELECT OGid, pos, CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END::DOUBLE AS gradient FROM profile WINDOW w AS (PARTITION BY OGid ORDER BY pos)")
def profile_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.gradient(profile(spark, sf_dir), "x", ["OGid"]).select("OGid", "pos", F.col("gradient").cast("double").alias("gradient"))


@query(f"""WITH {PROFILE_SQL}, d AS (SELECT *, max(gap) OVER (PARTITION BY OGid ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w FROM profile)
SELECT OGid, pos, CASE WHEN lag(w) OVER o IS NULL OR lead(w) OVER o IS NULL THEN 0 ELSE least(lag(w) OVER o, w, lead(w) OVER o) END AS closed FROM d WINDOW o AS (PARTITION BY OGid ORDER BY pos)""")
def profile_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.closed(profile(spark, sf_dir), "gap", ["OGid"]).select("OGid", "pos", "closed")


@query(f"WITH {PROFILE_SQL} SELECT OGid, pos, round(m, 9) AS mean FROM (SELECT OGid, pos, avg(x) OVER w AS m, count(*) OVER w AS n FROM profile WINDOW w AS (PARTITION BY OGid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE n = 10")
def profile_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.moving_average(profile(spark, sf_dir), "x", 10, ["OGid"]).select("OGid", "pos", F.round("mean", 9).alias("mean"))


@query(f"""WITH {PROFILE_SQL}, c AS (SELECT *, CASE WHEN gap IS DISTINCT FROM lag(gap) OVER (PARTITION BY OGid ORDER BY pos) THEN 1 ELSE 0 END AS new FROM profile),
r AS (SELECT *, sum(new) OVER (PARTITION BY OGid ORDER BY pos) AS run FROM c) SELECT OGid, gap, min(pos) AS start, max(pos) + 1 AS stop FROM r GROUP BY OGid, run, gap""")
def profile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clademill.operators.intervals import runs

    return runs(profile(spark, sf_dir), ["OGid"], "pos", "gap").select("OGid", "gap", "start", "stop")


@query(f"WITH {SYMBOLS_SQL} SELECT OGid, pos, count(*) FILTER (sym = '-') AS gaps, count(*) AS rows FROM symbols GROUP BY 1, 2")
def alignment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.gap_profile(symbols(spark, sf_dir))


@query(f"WITH {SYMBOLS_SQL}, b AS (SELECT *, lag(sym = '-') OVER (PARTITION BY OGid, ppid ORDER BY pos) AS before FROM symbols) SELECT OGid, pos, count(*) FILTER (before = (sym = '-')) AS emit0 FROM b GROUP BY 1, 2")
def alignment_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.unchanged(symbols(spark, sf_dir))


@query(f"WITH {SYMBOLS_SQL}, k AS (SELECT OGid, pos FROM symbols GROUP BY 1, 2 HAVING bool_or(sym NOT IN ('-', '.'))) SELECT OGid, ppid, string_agg(sym, '' ORDER BY pos) AS seq FROM symbols JOIN k USING (OGid, pos) GROUP BY 1, 2")
def gapless_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.assembled(msa.without_gap_columns(symbols(spark, sf_dir)), ["OGid", "ppid"])


@query(f"""WITH {SYMBOLS_SQL}, a AS (SELECT OGid, gnid, pos, max((sym <> '-')::INT) AS o FROM symbols GROUP BY ALL),
c AS (SELECT OGid, pos, (sum(o) / count(*) + 0.005) / 1.01 AS p FROM a GROUP BY ALL),
s AS (SELECT OGid, gnid, ppid, sum(CASE WHEN sym <> '-' THEN ln(p) ELSE ln(1 - p) END) AS score FROM symbols JOIN c USING (OGid, pos) GROUP BY ALL)
SELECT OGid, gnid, ppid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY OGid, gnid ORDER BY round(score, 6) DESC, ppid) AS r FROM s) WHERE r = 1""")
def alignment_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.representatives(symbols(spark, sf_dir)).select("OGid", "gnid", "ppid", F.round("score", 6).alias("score"))


@query(f"""WITH {SYMBOLS_SQL}, f AS (SELECT OGid, pos, count(*) FILTER (sym IN ('-', 'X')) AS blank, count(*) AS n, count(DISTINCT sym) FILTER (sym NOT IN ('-', 'X')) AS kinds FROM symbols GROUP BY 1, 2),
p AS (SELECT unnest(['100R', '50R', '0R']) AS pool, unnest([0.0, 0.5, 1.0]) AS most)
SELECT pool, count(*) AS pool_size FROM f JOIN p ON blank <= most * n GROUP BY 1 UNION ALL SELECT pool || '_NI', count(*) FROM f JOIN p ON blank <= most * n WHERE kinds > 1 GROUP BY 1""")
def column_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.column_flags(symbols(spark, sf_dir)).select(F.explode("pools").alias("pool")).groupBy("pool").agg(F.count("*").alias("pool_size"))


@query("WITH c AS (SELECT lang, unnest(string_split(lower(text), '')) AS sym FROM documents), n AS (SELECT lang, sym, count(*) AS n FROM c WHERE sym <> '' GROUP BY 1, 2) SELECT lang, sym, n, round(n / sum(n) OVER (PARTITION BY lang), 9) AS share FROM n")
def symbol_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.lower("text"), "")).alias("sym")).where("sym <> ''")
    return msa.symbol_frequencies(d, ["lang"]).withColumn("share", F.round("share", 9))


@query("SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, 'e+'), lambda x: length(x))), 0) AS run FROM documents")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sequences.longest_run(F.col("text"), "e").cast("long").alias("run"))


@query("""WITH c AS (SELECT DISTINCT doc_id, unnest(string_split(upper(replace(text, 'ß', 'ss')), '')) AS c FROM documents)
SELECT doc_id, coalesce(string_agg(c, '' ORDER BY ord(c)) FILTER (c NOT IN ('', ' ', '.', ',') AND NOT regexp_full_match(c, '[A-Z]')), '') AS odd FROM c GROUP BY 1 UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def alphabet_strangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of each document outside an alphabet, in ascending order."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ ,."
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sequences.strangers(F.col("text"), letters), "").alias("odd"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages")
def header_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))


@query("SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS symbols, ceil(length(regexp_replace(text, '\\s', '', 'g')) / 80)::BIGINT + 1 AS lines FROM documents")
def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as FASTA records and back: symbols that return, and the lines of each record."""
    d = table(spark, sf_dir, "documents").select("doc_id", files.fasta_text(F.concat(F.lit(">doc="), F.col("doc_id").cast("string")), F.regexp_replace("text", r"\s", "")).alias("record"))
    back = files.fasta_records(d.withColumn("lines", F.size(F.split("record", "\n")).cast("long")), "record")
    return back.select(files.header_fields(F.col("header"))["doc"].cast("long").alias("doc_id"), F.length("seq").cast("long").alias("symbols"), "lines")


def components_sql(squarings: int = 22) -> str:
    """The first two eigenvectors of the centred products of rows, each the direction that high powers of the matrix keep."""
    ctes = ["""m AS (SELECT DISTINCT s_nationkey AS r, l_orderkey AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), r AS (SELECT DISTINCT r FROM m),
raw AS (SELECT i.r AS i, j.r AS j, coalesce(n, 0)::DOUBLE AS x FROM r i CROSS JOIN r j LEFT JOIN (SELECT a.r AS i, b.r AS j, count(*) AS n FROM m a JOIN m b USING (c) GROUP BY 1, 2) p ON p.i = i.r AND p.j = j.r),
g1 AS MATERIALIZED (SELECT i, j, x - avg(x) OVER (PARTITION BY i) - avg(x) OVER (PARTITION BY j) + avg(x) OVER () AS x FROM raw)"""]
    for k in (1, 2):
        ctes.append(f"p{k}_0 AS MATERIALIZED (SELECT i, j, x / (SELECT sum(x) FROM g{k} WHERE i = j) AS x FROM g{k})")
        for n in range(squarings):
            ctes.append(f"q{k}_{n} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM p{k}_{n} a JOIN p{k}_{n} b ON a.j = b.i GROUP BY 1, 2), p{k}_{n + 1} AS MATERIALIZED (SELECT i, j, x / (SELECT sum(x) FROM q{k}_{n} WHERE i = j) AS x FROM q{k}_{n})")
        last = f"p{k}_{squarings}"
        ctes.append(f"v{k} AS MATERIALIZED (SELECT i, x / (SELECT sqrt(sum(x * x)) FROM {last} WHERE j = t.j) AS x FROM {last}, (SELECT j FROM {last} WHERE i = j ORDER BY x DESC, j LIMIT 1) t WHERE {last}.j = t.j), e{k} AS MATERIALIZED (SELECT sum(a.x * g.x * b.x) AS e FROM g{k} g JOIN v{k} a ON a.i = g.i JOIN v{k} b ON b.i = g.j)")
        if k == 1:
            ctes.append("g2 AS MATERIALIZED (SELECT g.i, g.j, g.x - e * a.x * b.x AS x FROM g1 g JOIN v1 a ON a.i = g.i JOIN v1 b ON b.i = g.j, e1)")
    sign = "sign((SELECT arg_max(x, (abs(x), i)) FROM v{k}))"
    return f"WITH {', '.join(ctes)} SELECT v1.i AS spid, round(v1.x * sqrt(e1.e) * {sign.format(k=1)}, 6) AS pc1, round(v2.x * sqrt(e2.e) * {sign.format(k=2)}, 6) AS pc2 FROM v1 JOIN v2 USING (i), e1, e2"


@query(components_sql())
def membership_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of the nations' membership in orders."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    own = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == s.s_suppkey)
    found = stats.principal_components(own.select(F.col("s_nationkey").alias("spid"), F.col("l_orderkey").alias("OGid")), "spid", "OGid")
    return found.select("spid", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query()
def bootstrap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta-alignments: of each pool 100 samples of 10,000 columns, with replacement, as the sequences of the rows."""
    every = stored(symbols(spark, sf_dir), "symbols")
    pools = msa.column_flags(every).select("OGid", "pos", F.explode("pools").alias("pool"))
    return msa.meta_alignments(every, pools, 100, 10_000, 930715)
