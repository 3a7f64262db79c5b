"""Queries that write the engine's file formats and read them again, and joins between tables of several of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions import sequences
from clademill.operators import graphs, groups, hits, msa, regions, stats
from clademill.operators.ranks import with_rank
from clademill.plans.inputs import LINES_SQL, PROFILE_SQL, SYMBOLS_SQL, hsps, lines, profile, symbols, table
from clademill.sources import files
from clademill.storage import shared_dir, stored

QUERIES, SQL = {}, {}
# The standard genetic code in the order of bases T, C, A, G (fixed values).
CODONS = """AAs = FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG
Starts = ---M------**--*----M---------------M----------------------------
Base1 = TTTTTTTTTTTTTTTTCCCCCCCCCCCCCCCCAAAAAAAAAAAAAAAAGGGGGGGGGGGGGGGG
Base2 = TTTTCCCCAAAAGGGGTTTTCCCCAAAAGGGGTTTTCCCCAAAAGGGGTTTTCCCCAAAAGGGG
Base3 = TCAGTCAGTCAGTCAGTCAGTCAGTCAGTCAGTCAGTCAGTCAGTCAGTCAGTCAGTCAGTCAG"""
AAS, STARTS = (line.split()[2] for line in CODONS.splitlines()[:2])


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}"


@query("""WITH e AS (SELECT 'u' || user_id AS qppid, event_type AS sppid, (event_id % 50)::INT AS qstart, (event_id % 70 + event_id % 90 + 10)::INT AS send,
  CASE WHEN event_id % 3 = 0 THEN 1e-20 ELSE 0.001 END AS evalue, value AS bitscore FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)
SELECT qppid, sppid, qstart, send, evalue, bitscore FROM e UNION ALL
SELECT 'u' || c_custkey, NULL, NULL, NULL, NULL, NULL FROM customer WHERE 'u' || c_custkey NOT IN (SELECT qppid FROM e)""")
def search_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabular search output with comment lines, written and read: alignments, and the queries without any."""
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    length, name = F.col("event_id") % 90 + 10, F.concat(F.lit("u"), F.col("user_id").cast("string"))
    row = F.concat_ws("\t", name, "event_type", length, F.col("event_id") % 10, F.col("event_id") % 3, F.lit(200), F.col("event_id") % 50, F.col("event_id") % 50 + length, F.lit(300), F.col("event_id") % 70, F.col("event_id") % 70 + length, F.when(F.col("event_id") % 3 == 0, "1e-20").otherwise("0.001"), "value")
    found = e.groupBy(name.alias("name")).agg(F.collect_list(row).alias("rows"))
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("name"))
    blocks = asked.join(found, "name", "full").withColumn("rows", F.coalesce("rows", F.array().cast("array<string>")))
    path = _folder(spark, "search")
    blocks.select(F.concat_ws("\n", F.lit("# search"), F.concat(F.lit("# Query: "), "name"), F.concat(F.lit("# "), F.size("rows").cast("string"), F.lit(" hits found")), F.array_join("rows", "\n")).alias("value")).write.text(path)
    own, none = files.read_search_output(spark, path)
    columns = ["qppid", "sppid", "qstart", "send", "evalue", "bitscore"]
    missing = [F.lit(None).cast(dict(own.dtypes)[c]).alias(c) for c in columns[1:]]
    return own.select(*columns).union(none.select("qppid", *missing))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as tab-separated text and back."""
    path = _folder(spark, "table")
    files.write_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return files.read_table(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("SELECT r_regionkey, r_name FROM region")
def commented_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that start with a comment sign are passed over."""
    r = table(spark, sf_dir, "region")
    path = _folder(spark, "commented")
    r.select(F.explode(F.array(F.concat(F.lit("# "), "r_name"), F.concat_ws("\t", "r_regionkey", "r_name"))).alias("value")).write.text(path)
    return files.read_table(spark, path, "r_regionkey int, r_name string", comment="#", header=False)


PAIRS_SQL = """pairs AS (SELECT (l_linenumber % 4)::VARCHAR AS qspid, (l_suppkey % 4)::VARCHAR AS sspid, count(*) AS n, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY 1, 2)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    own = li.groupBy((F.col("l_linenumber") % 4).cast("string").alias("qspid"), (F.col("l_suppkey") % 4).cast("string").alias("sspid"))
    return own.agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"))


@query(f"WITH {PAIRS_SQL} SELECT qspid, sspid, n, total FROM pairs WHERE qspid <> sspid AND qspid IN ('0', '1', '2') AND sspid IN ('0', '1', '2')")
def genome_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of pairs of genomes, written and read for some genomes."""
    path = _folder(spark, "pairs")
    files.write_pairs(_pairs(spark, sf_dir), path)
    return files.read_pairs(spark, path, "n long, total long, qspid string, sspid string", ["0", "1", "2"]).select("qspid", "sspid", "n", "total")


@query(f"WITH {PAIRS_SQL} SELECT qspid, sspid FROM pairs WHERE (qspid::INT + sspid::INT) % 2 = 1")
def remaining_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run that was broken off has still to do."""
    own = stored(_pairs(spark, sf_dir), "pairs")
    path = _folder(spark, "done")
    files.write_pairs(own.where("(int(qspid) + int(sspid)) % 2 = 0"), path)
    return files.remaining(own, path).select("qspid", "sspid")


@query("SELECT n_regionkey::VARCHAR AS folder, 1::BIGINT AS files FROM nation GROUP BY n_regionkey")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder tree by their suffix."""
    path = _folder(spark, "listing")
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("value"))
    n.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return files.listed(spark, path, ".txt").groupBy(F.regexp_extract("path", "n_regionkey=([0-9]+)/", 1).alias("folder")).agg(F.count("*").alias("files"))


@query("SELECT o_orderkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, l_quantity AS score FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def adjacency_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge table as adjacency lines and back; a node without neighbours stays."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("dst"), F.col("l_quantity").alias("score"))
    edges = table(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left").select(F.col("o_orderkey").cast("string").alias("src"), "dst", "score")
    path = _folder(spark, "adjacency")
    files.adjacency_text(edges).write.text(path)
    return files.adjacency(spark.read.text(path))


@query(f"WITH {LINES_SQL} SELECT OGid, gnid::VARCHAR AS src, spid::VARCHAR AS dst FROM lines")
def cluster_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their edges in one field, written and read."""
    path = _folder(spark, "clusters")
    own = lines(spark, sf_dir).groupBy("OGid").agg(files.edges_text(F.col("gnid").cast("string"), F.col("spid").cast("string")).alias("edges"))
    files.write_table(own, path)
    return files.cluster_edges(files.read_table(spark, path, "OGid long, edges string"))


@query("SELECT o_orderkey AS OGid, (l_linenumber * 10)::INT AS start, (l_linenumber * 10 + l_quantity)::INT AS stop FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def slice_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of slices in one field, empty ones too, written and read."""
    start = F.col("l_linenumber") * 10
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat_ws(",", F.collect_list(F.concat_ws("-", start, (start + F.col("l_quantity")).cast("int")))).alias("slices"))
    own = table(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left").select(F.col("o_orderkey").alias("OGid"), F.coalesce("slices", F.lit("")).alias("slices"))
    path = _folder(spark, "slices")
    files.write_table(own, path)
    back = files.read_table(spark, path, "OGid long, slices string")
    return back.select("OGid", F.explode(files.slices(F.coalesce("slices", F.lit("")))).alias("s")).select("OGid", "s.start", "s.stop")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of nested maps as JSON and back."""
    model: dict[str, dict[str, int]] = {}
    for r in table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).collect():  # one row a kind
        model.setdefault(r.l_returnflag, {})[r.l_linestatus] = r.n
    path = _folder(spark, "model")
    files.write_model(spark, path, model)
    back = files.read_model(spark, path)
    return spark.createDataFrame([(a, b, n) for a, own in back.items() for b, n in own.items()], "flag string, status string, n long")


def codon_table(spark: SparkSession) -> tuple[dict[str, str], set[str]]:
    """The standard code, written as text and read back."""
    path = _folder(spark, "codons")
    spark.createDataFrame([(CODONS,)], "value string").coalesce(1).write.text(path)
    return files.codon_table("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


# Codon k of a part's coding sequence, and its protein: one residue is wrong in every fifth part, the last is missing in every seventh, the first two in every eleventh.
@query(f"""WITH c AS (SELECT p_partkey, list_transform(range(p_size % 9 + 3), lambda i: (p_partkey * 7 + i * 13) % 64) AS code FROM part),
a AS (SELECT p_partkey, code, list_transform(code, lambda k: substr('{AAS}', k::INT + 1, 1)) AS said FROM c),
p AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN said[3:] WHEN p_partkey % 7 = 0 THEN said[:len(said) - 1] WHEN p_partkey % 5 = 0 THEN said[:1] || ['X' || 'W'] || said[3:] ELSE said END AS raw FROM a),
q AS (SELECT p_partkey, code, said, string_split(array_to_string(list_transform(raw, lambda x: x[-1:]), '|'), '|') AS aa FROM p),
n AS (SELECT *, CASE WHEN said[len(said)] = '*' THEN len(said) - 1 ELSE len(said) END AS own FROM q),
z AS (SELECT *, len(list_filter(range(1, least(own, len(aa))::BIGINT + 1), lambda i: aa[i] <> said[i] AND aa[i] <> 'X' AND NOT (i = 1 AND aa[1] = 'M' AND substr('{STARTS}', code[1]::INT + 1, 1) = 'M'))) AS bad FROM n)
SELECT p_partkey, own::BIGINT AS codons, CASE WHEN abs(own - len(aa)) > 1 OR bad > 0 THEN 'mismatch' WHEN own = len(aa) THEN 'ok' ELSE 'length' END AS status FROM z""")
def codon_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How coding sequences agree with proteins, by a codon table read from its text."""
    p = table(spark, sf_dir, "part")
    code = F.transform(F.sequence(F.lit(0), F.col("p_size") % 9 + 2), lambda i: (F.col("p_partkey") * 7 + i * 13) % 64)

    def base(k, size: int):
        return F.substring(F.lit("TCAG"), (F.floor(k / size) % 4 + 1).cast("int"), F.lit(1))

    nt = F.array_join(F.transform("code", lambda k: F.concat(base(k, 16), base(k, 4), base(k, 1))), "")
    said = F.array_join(F.transform("code", lambda k: F.substring(F.lit(AAS), (k + 1).cast("int"), F.lit(1))), "")
    key, n = F.col("p_partkey"), F.length("said")
    aa = F.when(key % 11 == 0, F.substring("said", F.lit(3), n)).when(key % 7 == 0, F.substring("said", F.lit(1), n - 1)).when(key % 5 == 0, F.concat(F.substring("said", 1, 1), F.lit("W"), F.substring("said", F.lit(3), n))).otherwise(F.col("said"))
    own = p.select("p_partkey", code.alias("code")).select("p_partkey", nt.alias("nt"), said.alias("said")).select("p_partkey", "nt", aa.alias("aa"))
    codons, starts = codon_table(spark)
    read = own.withColumn("codons", sequences.coding(F.col("nt"), codons))
    return read.select("p_partkey", F.size("codons").cast("long").alias("codons"), sequences.agreement(F.col("codons"), F.col("aa"), codons, starts).alias("status"))


@query(f"""WITH {LINES_SQL} SELECT OGid, p_partkey AS gnid, 'GID' || (p_partkey % 100) AS reference, p_type AS seq FROM lines JOIN part ON gnid = p_partkey""")
def fetched_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups with the sequences of their proteins, whose headers name a version and other references."""
    p = table(spark, sf_dir, "part")
    header = F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit("."), (F.col("p_size") % 3 + 1).cast("string"), F.lit(" [gene=x] [db_xref=GeneID:GID"), (F.col("p_partkey") % 100).cast("string"), F.lit(",Other:7]"))
    proteins = p.select(header.alias("header"), F.col("p_type").alias("seq"))
    name = F.substring_index(F.regexp_replace("header", "^>", ""), " ", 1)
    known = proteins.select(sequences.without_version(name).cast("long").alias("gnid"), sequences.cross_reference(F.col("header")).alias("reference"), "seq")
    return lines(spark, sf_dir).select("OGid", "gnid").join(known, "gnid").select("OGid", "gnid", "reference", "seq")


@query("""WITH d AS (SELECT l_partkey AS p, count(DISTINCT l_suppkey) AS hitnum FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY hitnum DESC, p) - 1 AS rank FROM d)
SELECT p AS p_partkey, hitnum, rank, p_brand, least_price FROM r LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p = p_partkey LEFT JOIN (SELECT l_partkey AS k, min(l_extendedprice) AS least_price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON k = p""")
def ranked_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects by the number of their queries, with attributes where they have some."""
    li = table(spark, sf_dir, "lineitem")
    found = stats.ranked_subjects(li.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey"), "p_partkey", "l_suppkey")
    ranked = with_rank(found, F.col("hitnum").desc(), F.col("p_partkey")).select("p_partkey", "hitnum", "rank")
    brands = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_brand")
    prices = li.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_extendedprice").alias("least_price"))
    return stats.with_attributes(ranked, "p_partkey", brands, prices)


@query(f"""WITH {LINES_SQL}, m AS (SELECT DISTINCT OGid, gnid FROM lines), o AS (SELECT o_orderkey AS OGid, o_totalprice AS bitscore FROM orders WHERE o_orderstatus = 'F'),
x AS (SELECT m.OGid, m.gnid, o.bitscore FROM o RIGHT JOIN m USING (OGid))
SELECT p_partkey AS gnid, OGid, bitscore, p_name AS name FROM x RIGHT JOIN part ON gnid = p_partkey""")
def drawn_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gene with its groups and the data of the chosen ones."""
    chosen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("OGid"), F.col("o_totalprice").alias("bitscore"))
    genes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gnid"), F.col("p_name").alias("name"))
    return groups.drawn(chosen, lines(spark, sf_dir).select("OGid", "gnid").distinct(), genes).select("gnid", "OGid", "bitscore", "name")


@query(f"""WITH {PROFILE_SQL}, t AS (SELECT OGid, sum(x) FILTER (gap = 1)::DOUBLE AS total, avg(x) AS len2 FROM profile GROUP BY 1), f AS (SELECT s_suppkey AS OGid, s_nationkey::BIGINT + 1 AS gnidnum FROM supplier WHERE s_acctbal > 0)
SELECT OGid, total, gnidnum, round(total / gnidnum, 6) AS norm1, round(total / (gnidnum * len2), 9) AS norm2 FROM t LEFT JOIN f USING (OGid)""")
def filtered_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of groups, with norms where the filter knows the group."""
    totals = profile(spark, sf_dir).groupBy("OGid").agg(F.sum(F.when(F.col("gap") == 1, F.col("x"))).cast("double").alias("total"), F.avg("x").alias("len2"))
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("OGid"), (F.col("s_nationkey").cast("long") + 1).alias("gnidnum"))
    found = regions.contrast_norms(totals.join(known, "OGid", "left"))
    return found.select("OGid", "total", "gnidnum", F.round("norm1", 6).alias("norm1"), F.round("norm2", 9).alias("norm2"))


@query("""WITH g AS (SELECT l_suppkey, l_partkey, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1, 2)
SELECT count(*) AS groups, count(*) FILTER (low = high) AS same, count(*) FILTER (high > 2 * low) AS wide, count(*) FILTER (low > 25) AS above FROM g""")
def extreme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("low"), F.col("high")
    return stats.extreme_counts(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], "l_quantity", {"same": low == high, "wide": high > 2 * low, "above": low > 25})


@query("""SELECT l_orderkey, l_linenumber, round(fqa, 9) AS fqa, round(fsa, 9) AS fsa, round(cfqa, 9) AS cfqa, round(cfqa - fqa, 9) AS xfqa, xhspnum FROM (SELECT *, l_quantity / 200 AS fqa, (l_quantity + 1) / 300 AS fsa, (l_quantity + l_linenumber) / 200 AS cfqa, l_linenumber AS xhspnum FROM lineitem)""")
def hit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of aligned sequence, and what compatible alignments add to disjoint ones."""
    li = table(spark, sf_dir, "lineitem")
    own = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("nqa"), (F.col("l_quantity") + 1).alias("nsa"), (F.col("l_quantity") + F.col("l_linenumber")).alias("cnqa"), F.lit(200).alias("qlen"), F.lit(300).alias("slen"), F.lit(1).alias("hspnum"), (F.col("l_linenumber") + 1).alias("chspnum"))
    found = hits.derived_hit_columns(own)
    return found.select("l_orderkey", "l_linenumber", *(F.round(c, 9).alias(c) for c in ("fqa", "fsa", "cfqa", "xfqa")), "xhspnum")


@query("""WITH h AS (SELECT a.l_orderkey * 10 + a.l_linenumber AS q, b.l_orderkey * 10 + b.l_linenumber AS s, a.l_partkey % 3 AS qg, b.l_partkey % 3 AS sg,
  a.l_quantity * b.l_quantity AS score, b.l_quantity AS cover, a.l_quantity AS len FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey),
b AS (SELECT l_orderkey * 10 + l_linenumber AS q, l_extendedprice / 100 AS best FROM lineitem WHERE l_linestatus = 'F'),
o AS (SELECT *, max(score) OVER (PARTITION BY q, sg) AS top FROM h LEFT JOIN b USING (q) WHERE qg <> sg),
k AS (SELECT DISTINCT q, s FROM o WHERE score = top AND score > coalesce(best, 0) AND cover / len >= 0.5)
SELECT a.q AS node, a.s AS paralog FROM k a JOIN k b ON a.q = b.s AND a.s = b.q""")
def inparalog_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal in-paralogs: an order is a genome, its lines are proteins; some have a best hit elsewhere."""
    li = table(spark, sf_dir, "lineitem")
    own = li.select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ppid"), (F.col("l_partkey") % 3).alias("gnid"), "l_quantity")
    other = own.select("l_orderkey", F.col("ppid").alias("sppid"), F.col("gnid").alias("sgnid"), F.col("l_quantity").alias("cnqa"))
    within = own.join(other, "l_orderkey").select(F.col("ppid").alias("qppid"), "sppid", F.col("gnid").alias("qgnid"), "sgnid", (F.col("l_quantity") * F.col("cnqa")).alias("bitscore"), "cnqa", F.col("l_quantity").alias("qlen"))
    best = li.where("l_linestatus = 'F'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qppid"), (F.col("l_extendedprice") / 100).alias("best"))
    return graphs.inparalogs(within, best)


# As hsp_marks, with two axes and E-values; alignments of one gene with itself go first.
WITHIN_SQL = """h AS (SELECT event_id, user_id AS qppid, (event_id % 4)::INT AS sppid, (epoch_us(ts) // 60000000)::BIGINT AS a, (epoch_us(ts) // 60000000)::BIGINT + ceil(value)::BIGINT AS b,
  event_id % 500 AS c, event_id % 500 + ceil(value)::BIGINT AS d, value AS bitscore, event_id % 5 = 0 AS weak FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND user_id % 4 <> event_id % 4),
sorted AS (SELECT qppid, sppid, list([{'id': event_id, 'a': a, 'b': b, 'c': c, 'd': d}] ORDER BY bitscore DESC, a, c, event_id) FILTER (NOT weak) AS every FROM h GROUP BY 1, 2),
d1 AS (SELECT *, list_reduce(every, lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.a <= x[1].b AND t.b >= x[1].a OR t.c <= x[1].d AND t.d >= x[1].c)) = 0 THEN acc || x ELSE acc END) AS apart FROM sorted WHERE every IS NOT NULL),
d2 AS (SELECT *, list_reduce(list_prepend(apart, every), lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.id = x[1].id
  OR (t.a <= x[1].b AND t.b >= x[1].a AND (t.b <= t.a OR x[1].b <= x[1].a OR least(t.b, x[1].b) - greatest(t.a, x[1].a) >= 0.5 * (t.b - t.a) OR least(t.b, x[1].b) - greatest(t.a, x[1].a) >= 0.5 * (x[1].b - x[1].a)))
  OR (t.c <= x[1].d AND t.d >= x[1].c AND (t.d <= t.c OR x[1].d <= x[1].c OR least(t.d, x[1].d) - greatest(t.c, x[1].c) >= 0.5 * (t.d - t.c) OR least(t.d, x[1].d) - greatest(t.c, x[1].c) >= 0.5 * (x[1].d - x[1].c))))) = 0 THEN acc || x ELSE acc END) AS ok FROM d1),
m AS (SELECT h.*, list_contains(list_transform(apart, lambda t: t.id), event_id) AS disjoint FROM h JOIN d2 USING (qppid, sppid) WHERE list_contains(list_transform(ok, lambda t: t.id), event_id)),
o AS (SELECT *, max(b) OVER (PARTITION BY qppid, sppid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS qr, max(d) OVER (PARTITION BY qppid, sppid ORDER BY c, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sr FROM m)"""


@query(f"""WITH {WITHIN_SQL} SELECT qppid, sppid, count(*) FILTER (disjoint)::INT AS hspnum, count(*)::INT AS chspnum, sum(b - a + 1) FILTER (disjoint)::BIGINT AS nqa, sum(greatest(0, b - greatest(a, coalesce(qr + 1, a)) + 1))::BIGINT AS cnqa,
sum(d - c + 1) FILTER (disjoint)::BIGINT AS nsa, sum(greatest(0, d - greatest(c, coalesce(sr + 1, c)) + 1))::BIGINT AS cnsa, round(sum(bitscore) FILTER (disjoint), 6) AS bitscore FROM o GROUP BY 1, 2""")
def within_genome_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits within a genome: no alignment of a gene with itself, none with a high E-value, two axes."""
    own = hsps(spark, sf_dir).withColumn("sppid", (F.col("event_id") % 4).cast("int")).where("qppid % 4 <> event_id % 4")
    start = F.col("event_id") % 500
    found = own.select("qppid", "sppid", "event_id", F.col("start").alias("qstart"), F.col("stop").alias("qend"), start.alias("sstart"), (start + F.col("stop") - F.col("start")).alias("send"), F.when(F.col("event_id") % 5 == 0, 1e-3).otherwise(1e-30).alias("evalue"), "bitscore")
    return hits.hits(hits.marked(found, order=("qstart", "sstart", "event_id"))).withColumn("bitscore", F.round("bitscore", 6))


# A residue's codon is one of those that mean it, by its position; X is any. Rows whose coding sequence doesn't agree with the protein, every seventh, are left out.
NT_SQL = "CASE sym WHEN 'A' THEN 'GC' || substr('TCAG', pos % 4 + 1, 1) WHEN 'N' THEN 'AA' || substr('TC', pos % 2 + 1, 1) ELSE substr('TCAG', pos % 4 + 1, 1) || 'CC' END"


@query(f"""WITH {SYMBOLS_SQL} SELECT OGid, ppid, count(*)::INT AS residues, string_agg(CASE WHEN sym = '-' THEN '---' ELSE {NT_SQL} END, '' ORDER BY pos) AS nt, 'ok' AS status
FROM symbols WHERE ppid % 7 <> 0 GROUP BY 1, 2 HAVING count(*) FILTER (sym <> '-') > 0""")
def threaded_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codons of the coding sequences that agree with the rows' proteins, threaded through the aligned rows: three nucleotides a
    residue, three gaps a gap."""
    seen = symbols(spark, sf_dir)
    codons, starts = codon_table(spark)
    base = F.substring(F.lit("TCAG"), F.col("pos") % 4 + 1, F.lit(1))
    codon = F.when(F.col("sym") == "A", F.concat(F.lit("GC"), base)).when(F.col("sym") == "N", F.concat(F.lit("AA"), F.substring(F.lit("TC"), F.col("pos") % 2 + 1, F.lit(1)))).otherwise(F.concat(base, F.lit("CC")))
    residues = seen.where("sym <> '-'").withColumn("codon", codon)
    ordered = lambda c: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]))
    # as sequences come: a protein and a coding sequence with its stop codon, in which every seventh row lacks its first two codons
    own = residues.groupBy("OGid", "ppid").agg(ordered("sym").alias("aa"), F.concat(ordered("codon"), F.lit("taa")).alias("nt"))
    own = own.withColumn("nt", F.when(F.col("ppid") % 7 == 0, F.expr("substring(nt, 7)")).otherwise(F.col("nt")))
    read = own.withColumn("codons", sequences.coding(F.col("nt"), codons)).withColumn("status", sequences.agreement(F.col("codons"), F.col("aa"), codons, starts))
    agreed = stored(read.where("status <> 'mismatch'").select("OGid", "ppid", "codons", "status"), "coding")
    rows = msa.assembled(msa.threaded(seen.join(agreed.select("OGid", "ppid").hint("merge"), ["OGid", "ppid"], "left_semi"), agreed, ["OGid", "ppid"]), ["OGid", "ppid"])
    return rows.join(agreed.select("OGid", "ppid", "status").hint("merge"), ["OGid", "ppid"]).select("OGid", "ppid", (F.length("seq") / 3).cast("int").alias("residues"), F.col("seq").alias("nt"), "status")


@query("""SELECT l_orderkey, l_linenumber, length(seq) AS symbols, md5(seq) AS seq FROM (SELECT l_orderkey, l_linenumber, repeat(substr('ACGT', (l_linenumber % 4 + 1)::INT, 1) || l_returnflag || l_linestatus, (l_quantity * 3)::INT) AS seq FROM lineitem)""")
def fasta_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTA record for each line of an order, written as text files and read back by records, so that one file is many tasks."""
    path = _folder(spark, "records")
    li = table(spark, sf_dir, "lineitem")
    header = F.concat(F.lit(">order="), F.col("l_orderkey").cast("string"), F.lit("|line="), F.col("l_linenumber").cast("string"))
    li.select(files.fasta_text(header, F.expr("repeat(concat(substring('ACGT', int(l_linenumber % 4 + 1), 1), l_returnflag, l_linestatus), int(l_quantity * 3))")).alias("value")).write.text(path)
    fields = files.header_fields(F.col("header"))
    return files.read_fasta(spark, path).select(fields["order"].cast("long").alias("l_orderkey"), fields["line"].cast("int").alias("l_linenumber"), F.length("seq").cast("long").alias("symbols"), F.md5(F.col("seq").cast("binary")).alias("seq"))
