"""Queries on hits and on the graphs that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.operators import cliques, graphs, groups, hits
from clademill.operators.components import components
from clademill.operators.intervals import complement, coverage, merged
from clademill.operators.products import mutual_products
from clademill.operators.ranks import component_ids, hex_id, with_rank
from clademill.plans.inputs import HSPS_SQL, LINES_SQL, SCORES_SQL, hsps, lines, top_hits, vectors
from clademill.storage import stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def reciprocal_edges(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    """src < dst of vectors that are among each other's best, with the score."""
    found = stored(top_hits(spark, sf_dir, k), "hits")
    both = hits.with_reciprocity(found.select("src", "dst", "score"))
    return stored(both.where("reciprocal and src < dst").select("src", "dst", "score"), "edges")


EDGES_SQL = SCORES_SQL + """, best AS (SELECT * FROM ranked WHERE r = 1),
edges AS (SELECT a.src, a.dst, a.score FROM best a JOIN best b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)"""
REACH_SQL = EDGES_SQL + """, both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
reach(node, other) AS (SELECT src, src FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.other = b.src),
members AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
sizes AS (SELECT component, count(*) AS n, min(node) AS least FROM members GROUP BY component),
ids AS (SELECT component, printf('%04X', row_number() OVER (ORDER BY n DESC, least DESC) - 1) AS component_id FROM sizes)"""


@query(f"WITH {SCORES_SQL} SELECT src, dst, dst_label, score FROM ranked WHERE r = 1")
def best_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_hits(spark, sf_dir)


@query(f"WITH {SCORES_SQL} SELECT src, dst, dst_label, score FROM ranked WHERE r <= 3")
def top_three_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_hits(spark, sf_dir, 3)


@query(f"WITH {SCORES_SQL}, best AS (SELECT * FROM ranked WHERE r = 1) SELECT a.src, a.dst, a.score, b.src IS NOT NULL AS reciprocal FROM best a LEFT JOIN best b ON a.src = b.dst AND a.dst = b.src")
def reciprocal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.with_reciprocity(stored(top_hits(spark, sf_dir), "hits").select("src", "dst", "score"))


@query(f"WITH {EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def hit_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degrees(reciprocal_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {REACH_SQL} SELECT component_id, node FROM members JOIN ids USING (component)")
def hit_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best hits, their reciprocity, the components of the graph, numbered by size."""
    return component_ids(components(reciprocal_edges(spark, sf_dir))).select("component_id", "node")


@query(f"""WITH RECURSIVE {REACH_SQL} SELECT component_id, count(*) AS ppidnum, count(DISTINCT label) AS spidnum
FROM members JOIN ids USING (component) JOIN embeddings ON node = vec_id GROUP BY component_id""")
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hit_components(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("node"), "label")
    return own.join(labels, "node").groupBy("component_id").agg(F.count("*").alias("ppidnum"), F.countDistinct("label").alias("spidnum"))


TRIANGLES_SQL = EDGES_SQL + """, triangles AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst)"""


@query(f"WITH {TRIANGLES_SQL} SELECT a, b, c FROM triangles")
def hit_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.triangles(reciprocal_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {TRIANGLES_SQL},

parts AS (SELECT [a, b] AS e, [a, c] AS f FROM triangles UNION SELECT [a, b], [b, c] FROM triangles),
ways AS (SELECT e, f FROM parts UNION SELECT f, e FROM parts),
reach(e, f) AS (SELECT e, e FROM ways UNION SELECT r.e, w.f FROM reach r JOIN ways w ON r.f = w.e)
SELECT min(f)[1] AS cluster_src, min(f)[2] AS cluster_dst, e[1] AS src, e[2] AS dst FROM reach GROUP BY e""")
def triangle_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graphs.triangle_clusters(reciprocal_edges(spark, sf_dir))
    return found.select(F.col("cluster.src").alias("cluster_src"), F.col("cluster.dst").alias("cluster_dst"), "src", "dst")


def mutual_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = reciprocal_edges(spark, sf_dir, 3)
    own = components(edges)
    return edges.join(own.withColumnsRenamed({"node": "src"}), "src").select(F.col("component").cast("string").alias("component_id"), "src", "dst")


@query(f"""WITH {SCORES_SQL}, top AS (SELECT * FROM ranked WHERE r <= 3),
edges AS (SELECT a.src, a.dst FROM top a JOIN top b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst),
tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst)
SELECT t.a, t.b, t.c, e.dst AS d FROM tri t JOIN edges e ON e.src = t.c JOIN edges f ON f.src = t.a AND f.dst = e.dst JOIN edges g ON g.src = t.b AND g.dst = e.dst""")
def four_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = reciprocal_edges(spark, sf_dir, 3).select("src", "dst")
    t = graphs.triangles(edges)
    more = t.join(edges.select(F.col("src").alias("c"), F.col("dst").alias("d")), "c")
    for end in ("a", "b"):
        more = more.join(edges.select(F.col("src").alias(end), F.col("dst").alias("d")), [end, "d"], "left_semi")
    return more.select("a", "b", "c", "d")


def reach_sql(name: str, nodes: str, links: str) -> str:
    """CTE name(node, comp): the least node that each node reaches. links: src, dst in both directions."""
    return f"""{name}(node, comp) USING KEY (node) AS (SELECT node, node FROM {nodes} UNION
SELECT l.dst, min(u.comp) FROM {name} u JOIN {links} l ON u.node = l.src JOIN recurring.{name} o ON o.node = l.dst WHERE u.comp < o.comp GROUP BY l.dst)"""


THREE_SQL = SCORES_SQL + """, top AS (SELECT * FROM ranked WHERE r <= 3),
edges AS MATERIALIZED (SELECT a.src, a.dst FROM top a JOIN top b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst),
ways AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), nodes AS (SELECT DISTINCT src AS node FROM ways), """ + reach_sql("parts", "nodes", "ways")


def clique_sql(k: int) -> str:
    """CTEs c{k} (the k-cliques as lists m) and k{k} (component_id, cluster, src, dst)."""
    grown = [f"c{n} AS MATERIALIZED (SELECT m || [e.dst] AS m FROM c{n - 1} JOIN edges e ON e.src = m[{n - 1}] WHERE (SELECT count(*) FROM edges f WHERE f.dst = e.dst AND list_contains(m, f.src)) = {n - 1})" for n in range(3, k + 1)]
    return ", ".join(["c2 AS MATERIALIZED (SELECT [src, dst] AS m FROM edges)", *grown]) + f""",
face{k} AS MATERIALIZED (SELECT m, list_filter(m, lambda x: x <> d) AS f FROM (SELECT m, unnest(m) AS d FROM c{k})),
next{k} AS MATERIALIZED (SELECT DISTINCT x.m AS src, y.m AS dst FROM face{k} x JOIN face{k} y USING (f) WHERE x.m <> y.m), own{k} AS (SELECT m AS node FROM c{k}), {reach_sql(f"same{k}", f"own{k}", f"next{k}")},
k{k} AS (SELECT DISTINCT p.comp::VARCHAR AS component_id, s.comp AS cluster, e.src, e.dst FROM same{k} s JOIN edges e ON list_contains(s.node, e.src) AND list_contains(s.node, e.dst) JOIN parts p ON p.node = e.src)"""


def core_sql(k: int, rounds: int = 40) -> str:
    """CTE core (component_id, cluster, src, dst): the connected parts of what is left when nodes of fewer than k neighbours go, round by round."""
    left = ["left0 AS MATERIALIZED (SELECT src, dst FROM ways)"]
    for n in range(1, rounds + 1):
        left.append(f"keep{n} AS MATERIALIZED (SELECT src FROM left{n - 1} GROUP BY src HAVING count(*) >= {k}), left{n} AS MATERIALIZED (SELECT src, dst FROM left{n - 1} WHERE src IN (FROM keep{n}) AND dst IN (FROM keep{n}))")
    return ", ".join(left) + f""", inner_nodes AS (SELECT DISTINCT src AS node FROM left{rounds}), {reach_sql("cores", "inner_nodes", f"left{rounds}")},
core AS (SELECT p.comp::VARCHAR AS component_id, c.comp AS cluster, l.src, l.dst FROM left{rounds} l JOIN cores c ON c.node = l.src JOIN parts p ON p.node = l.src WHERE l.src < l.dst)"""


def ids_sql(name: str, of: str) -> str:
    """CTE name(component_id, cluster, OGid): clusters by number of edges, then by their sorted ends, both descending."""
    return f"""{name} AS (SELECT component_id, cluster, printf('%04X', row_number() OVER (ORDER BY n DESC, ends DESC) - 1) AS OGid
FROM (SELECT component_id, cluster, count(*) AS n, list_sort(flatten(list([src, dst]))) AS ends FROM {of} GROUP BY 1, 2))"""


def _clusters(name: str, k: int, sql: str, of: str, algorithm: str, **options) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = graphs.cluster_ids(stored(cliques.clique_clusters(mutual_three(spark, sf_dir), k, **options), "clusters"))
        return found.select("component_id", "OGid", "algorithm", "src", "dst")

    QUERIES[name] = f
    SQL[name] = f"WITH RECURSIVE {THREE_SQL}, {sql}, {ids_sql('ids', of)} SELECT component_id, OGid, '{algorithm}' AS algorithm, src, dst FROM {of} JOIN ids USING (component_id, cluster)"


for _k in (3, 4, 5):
    _clusters(f"clique_clusters_{_k}", _k, clique_sql(_k), f"k{_k}", f"{_k}clique")
_clusters("core_clusters_4", 4, core_sql(4), "core", "4core", budget=0)
_clusters("named_core_clusters_13", 13, core_sql(13, 60), "core", "13core", core_components=("0", "1", "2", "3"))


@query(f"""WITH RECURSIVE {THREE_SQL}, {clique_sql(4)}, size AS (SELECT comp::VARCHAR AS component_id, count(*) AS size FROM parts GROUP BY 1),
inside AS (SELECT DISTINCT component_id, cluster, unnest([src, dst]) AS node FROM k4), g AS (SELECT component_id, count(DISTINCT cluster) AS groups, count(DISTINCT node) AS inside, count(*) AS places FROM inside GROUP BY 1)
SELECT component_id, CASE WHEN groups IS NULL THEN 0 WHEN groups = 1 THEN CASE WHEN inside = size THEN 1 ELSE 2 END WHEN places > inside THEN 4 ELSE 3 END AS type FROM size LEFT JOIN g USING (component_id)""")
def cluster_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = mutual_three(spark, sf_dir)
    found = stored(cliques.clique_clusters(edges, 4), "clusters").withColumn("OGid", F.col("cluster"))
    nodes = found.select("component_id", "OGid", F.col("src").alias("node")).union(found.select("component_id", "OGid", "dst"))
    members = edges.select("component_id", F.col("src").alias("node")).union(edges.select("component_id", "dst")).distinct()
    return groups.component_types(members, nodes)


@query(f"""WITH RECURSIVE {THREE_SQL}, {clique_sql(4)}, face3 AS MATERIALIZED (SELECT m, list_filter(m, lambda x: x <> d) AS f FROM (SELECT m, unnest(m) AS d FROM c3)),
next3 AS MATERIALIZED (SELECT DISTINCT x.m AS src, y.m AS dst FROM face3 x JOIN face3 y USING (f) WHERE x.m <> y.m), own3 AS (SELECT m AS node FROM c3), {reach_sql("same3", "own3", "next3")},
k3 AS (SELECT DISTINCT p.comp::VARCHAR AS component_id, s.comp AS cluster, e.src, e.dst FROM same3 s JOIN edges e ON list_contains(s.node, e.src) AND list_contains(s.node, e.dst) JOIN parts p ON p.node = e.src),
{ids_sql("ids3", "k3")}, {ids_sql("ids4", "k4")},
child AS (SELECT DISTINCT component_id || '/' || OGid AS cluster, unnest([src, dst]) AS node FROM k4 JOIN ids4 USING (component_id, cluster)), parent AS (SELECT DISTINCT component_id || '/' || OGid AS cluster, unnest([src, dst]) AS node FROM k3 JOIN ids3 USING (component_id, cluster)),
n AS (SELECT cluster, count(*) AS n FROM child GROUP BY 1), x AS (SELECT c.cluster AS child, p.cluster AS parent, count(*) AS common FROM child c JOIN parent p USING (node) GROUP BY 1, 2),
i AS (SELECT child, n, min(parent) AS parent FROM x JOIN n ON cluster = child WHERE common = n GROUP BY 1, 2)
SELECT child, parent, row_number() OVER (PARTITION BY parent ORDER BY n DESC, child) = 1 AS heir FROM i""")
def cluster_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(mutual_three(spark, sf_dir), "edges")

    def nodes(k: int) -> DataFrame:
        found = graphs.cluster_ids(stored(cliques.clique_clusters(edges, k), "clusters"))
        return found.select(F.concat_ws("/", "component_id", "OGid").alias("cluster"), F.explode(F.array("src", "dst")).alias("node")).distinct()

    return graphs.lineage(nodes(4), nodes(3))


@query(f"""WITH {EDGES_SQL}, best_score AS (SELECT src, max(score) AS best FROM best GROUP BY src),
par AS (SELECT a.src AS node, b.vec_id AS paralog FROM best_score a JOIN v x ON x.vec_id = a.src JOIN v b ON b.label = x.label AND b.vec_id <> a.src
  WHERE list_sum(list_transform(list_zip(x.e, b.e), lambda z: z[1] * z[2])) > a.best),
mutual AS (SELECT p.* FROM par p JOIN par q ON p.node = q.paralog AND p.paralog = q.node),
ends AS (SELECT node, paralog FROM mutual UNION ALL SELECT DISTINCT n, n FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges))
SELECT a.paralog AS src, b.paralog AS dst, e.score FROM edges e JOIN ends a ON a.node = e.src JOIN ends b ON b.node = e.dst""")
def paralog_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge spread over vectors of the same label that are closer than any best hit, both ways."""
    found = stored(top_hits(spark, sf_dir), "hits")
    edges = hits.with_reciprocity(found.select("src", "dst", "score")).where("reciprocal and src < dst").select("src", "dst", "score")
    best = found.groupBy("src").agg(F.max("score").alias("best"))
    near = vectors(spark, sf_dir).join(best.withColumnRenamed("src", "id"), "id")
    mutual = mutual_products(near)
    return graphs.with_paralogs(edges, mutual)


@query("""WITH own AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem), sizes AS (SELECT g, count(*) AS n FROM own GROUP BY g)
SELECT c.g AS src, c.h AS dst FROM (SELECT a.g, b.g AS h, count(*) AS common FROM own a JOIN own b ON a.i = b.i AND a.g < b.g GROUP BY 1, 2) c
JOIN sizes s ON s.g = c.g JOIN sizes t ON t.g = c.h WHERE common >= 0.5 * least(s.n, t.n)""")
def overlap_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.overlap_graph(lines(spark, sf_dir), "OGid", "gnid")


@query(f"""WITH RECURSIVE own AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem), sizes AS (SELECT g, count(*) AS n FROM own GROUP BY g),
pairs AS MATERIALIZED (SELECT c.g AS src, c.h AS dst FROM (SELECT a.g, b.g AS h, count(*) AS common FROM own a JOIN own b ON a.i = b.i AND a.g < b.g GROUP BY 1, 2) c JOIN sizes s ON s.g = c.g JOIN sizes t ON t.g = c.h WHERE common >= 0.5 * least(s.n, t.n)),
ways AS MATERIALIZED (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs), nodes AS (SELECT g AS node FROM sizes), {reach_sql("parts", "nodes", "ways")},
size AS (SELECT comp, count(*) AS n FROM parts GROUP BY 1), ids AS (SELECT comp, printf('%04X', row_number() OVER (ORDER BY n DESC, comp DESC) - 1) AS GGid FROM size)
SELECT GGid, node AS OGid FROM parts JOIN ids USING (comp)""")
def gene_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = lines(spark, sf_dir)
    whole = graphs.groups_with_singletons(sets.select("OGid"), graphs.overlap_links(sets, "OGid", "gnid"), "OGid")
    return component_ids(whole, "OGid").select(F.col("component_id").alias("GGid"), "OGid")


@query(f"""WITH {HSPS_SQL}, m AS (SELECT qppid, sppid, max(bitscore) AS m FROM hsps GROUP BY 1, 2), t AS (SELECT *, max(m) OVER (PARTITION BY qppid) AS top FROM m),
bar AS (SELECT *, coalesce(max(m) FILTER (m < top) OVER (PARTITION BY qppid), 0) AS bar FROM t)
SELECT h.event_id, h.qppid, h.sppid FROM hsps h JOIN bar b USING (qppid, sppid) WHERE b.m > b.bar""")
def hsp_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hsps(spark, sf_dir).withColumn("sgnid", F.col("sppid"))
    return hits.subject_cutoff(own, ("qppid",)).select("event_id", "qppid", "sppid")


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hsps(spark, sf_dir)
    return h.select("qppid", "sppid", "event_id", F.col("start").alias("qstart"), F.col("stop").alias("qend"), F.col("start").alias("sstart"), F.col("stop").alias("send"), F.lit(0.0).alias("evalue"), "bitscore")


# A list of single-element lists, so that what is accepted so far has the type of an element.
MARKS_SQL = HSPS_SQL + """, sorted AS (SELECT qppid, sppid, list([{'id': event_id, 'a': start, 'b': stop}] ORDER BY bitscore DESC, start, event_id) AS every FROM hsps GROUP BY 1, 2),
d AS (SELECT *, list_reduce(every, lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.a <= x[1].b AND t.b >= x[1].a)) = 0 THEN acc || x ELSE acc END) AS apart FROM sorted),
c AS (SELECT *, list_reduce(list_prepend(apart, every), lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.id = x[1].id OR (t.a <= x[1].b AND t.b >= x[1].a
  AND (t.b <= t.a OR x[1].b <= x[1].a OR least(t.b, x[1].b) - greatest(t.a, x[1].a) >= 0.5 * (t.b - t.a) OR least(t.b, x[1].b) - greatest(t.a, x[1].a) >= 0.5 * (x[1].b - x[1].a))))) = 0 THEN acc || x ELSE acc END) AS ok FROM d),
marks AS (SELECT h.*, every[1][1].id = event_id AS index_hsp, list_contains(list_transform(apart, lambda t: t.id), event_id) AS disjoint, list_contains(list_transform(ok, lambda t: t.id), event_id) AS compatible FROM hsps h JOIN c USING (qppid, sppid))"""


@query(f"WITH {MARKS_SQL} SELECT qppid, sppid, event_id, index_hsp, disjoint, compatible FROM marks")
def hsp_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = hits.marked(_alignments(spark, sf_dir), order=("qstart", "sstart", "event_id"))
    return pairs.select("qppid", "sppid", F.explode("hsps").alias("h")).select("qppid", "sppid", "h.event_id", "h.index_hsp", "h.disjoint", "h.compatible")


@query(f"""WITH {MARKS_SQL}, o AS (SELECT *, max(stop) OVER (PARTITION BY qppid, sppid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM marks WHERE compatible),
h AS (SELECT qppid, sppid, count(*) FILTER (disjoint)::INT AS hspnum, count(*)::INT AS chspnum, sum(stop - start + 1) FILTER (disjoint)::BIGINT AS nqa,
  sum(greatest(0, stop - greatest(start, coalesce(reach + 1, start)) + 1))::BIGINT AS cnqa, round(sum(bitscore) FILTER (disjoint), 6) AS bitscore FROM o GROUP BY 1, 2)
SELECT qppid, sppid, hspnum, chspnum, nqa, cnqa, nqa AS nsa, cnqa AS cnsa, bitscore FROM h""")
def hit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.hits(hits.marked(_alignments(spark, sf_dir), order=("qstart", "sstart", "event_id"))).withColumn("bitscore", F.round("bitscore", 6))


ISLANDS_SQL = HSPS_SQL + """, o AS (SELECT *, max(stop) OVER (PARTITION BY qppid, sppid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hsps),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {touching} THEN 1 ELSE 0 END) OVER (PARTITION BY qppid, sppid ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT qppid, sppid, island, min(start) AS start, max(stop) AS stop FROM i GROUP BY 1, 2, 3)"""


@query("WITH " + ISLANDS_SQL.format(touching=1) + " SELECT qppid, sppid, sum(stop - start + 1)::BIGINT AS covered FROM m GROUP BY 1, 2")
def union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(hsps(spark, sf_dir), ["qppid", "sppid"], "start", "stop")


@query("WITH " + ISLANDS_SQL.format(touching=0) + " SELECT qppid, sppid, start, stop FROM m")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(hsps(spark, sf_dir), ["qppid", "sppid"]).select("qppid", "sppid", "start", "stop")


@query("WITH " + ISLANDS_SQL.format(touching=0) + """ SELECT qppid, sppid, stop AS start, lead(start) OVER (PARTITION BY qppid, sppid ORDER BY start) AS stop FROM m
UNION ALL SELECT qppid, sppid, 0, min(start) FROM m GROUP BY 1, 2 HAVING min(start) > 0""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complement(hsps(spark, sf_dir), ["qppid", "sppid"]).select("qppid", "sppid", "start", "stop")


@query("WITH h AS (SELECT user_id AS qppid, event_type AS sppid, sum(value)::DECIMAL(18,2) AS total, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, max(n) OVER (PARTITION BY qppid) AS top FROM h) SELECT qppid, sppid, n FROM t WHERE n = top AND n >= 5")
def best_hits_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage filter stands after the choice of the highest score."""
    h = hsps(spark, sf_dir).groupBy("qppid", "sppid").agg(F.count("*").alias("n"))
    return hits.best_hits(h, ("qppid",), "n", F.col("n") >= 5)


@query(f"""WITH {LINES_SQL}, s AS (SELECT OGid, count(*) AS n FROM lines GROUP BY 1) SELECT OGid, n, printf('%04X', row_number() OVER (ORDER BY n DESC, OGid DESC) - 1) AS id FROM s""")
def ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = lines(spark, sf_dir).groupBy("OGid").agg(F.count("*").alias("n"))
    return with_rank(sizes, F.col("n").desc(), F.col("OGid").desc()).select("OGid", "n", hex_id("rank").alias("id"))


