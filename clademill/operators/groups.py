"""Metadata, filters and representatives of groups of proteins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.storage import stored

#: Rows of a group from which on no single task counts its distinct values.
LARGE = 1_000_000


def distinct_counts(table: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """group and, for each column, the number of its distinct values in the group.

    Each column's pairs are made distinct in tasks of their own, where Spark's plan of several distinct counts holds those of all in one.
    table is read once for each column.
    """
    out = None
    for k, c in enumerate(columns):
        part = table.select(group, c).distinct().select(group, F.lit(k).alias("__kind"), F.col(c).isNotNull().alias("__has"))
        out = part if out is None else out.union(part)
    return out.groupBy(group).agg(*(F.count_if((F.col("__kind") == k) & F.col("__has")).alias(f"{c}num") for k, c in enumerate(columns)))


def counted(table: DataFrame, group: str, columns: Sequence[str], *sums: Column, large: int = LARGE) -> DataFrame:
    """group, for each column the number of its distinct values in the group, and sums (aggregates).

    Rows are shuffled once, to the task of their group, and sorted there by each column in turn. Groups of `large` rows or more
    are dealt over all tasks by value.
    """
    many = stored(table.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") >= large).select(group), "large")
    some = bool(many.take(1))
    rows = (table.join(many, group, "left_anti") if some else table).repartition(group)
    for c in columns:
        first = F.row_number().over(Window.partitionBy(group, c).orderBy(c)) == 1
        rows = rows.withColumn(f"__first_{c}", first & F.col(c).isNotNull())
    out = rows.groupBy(group).agg(*(F.count_if(f"__first_{c}").alias(f"{c}num") for c in columns), *sums)
    if not some:
        return out
    rest = table.join(many, group, "left_semi")
    return out.union(distinct_counts(rest, group, columns).join(rest.groupBy(group).agg(F.count("*").alias("__n"), *sums), group).select(*out.columns))


def metadata(edges: DataFrame, proteins: DataFrame, scores: DataFrame, group: str = "OGid") -> DataFrame:
    """Distinct proteins, sequences, genes and species of each group, its edges, and the summed scores of both directions.

    edges: group, src, dst; repeated edges count each. proteins: ppid, sqid, gnid, spid. scores: src, dst, bitscore for one direction a
    row. The sum is rounded half to even to one digit.
    """
    ends = [F.least("src", "dst").alias("__a"), F.greatest("src", "dst").alias("__b")]
    up = F.col("src") <= F.col("dst")
    # both directions of a pair in one row; a loop is its own other direction
    both = scores.select(*ends, F.when(up, F.col("bitscore")).alias("__up"), F.when(~up | (F.col("src") == F.col("dst")), F.col("bitscore")).alias("__down")).groupBy("__a", "__b").agg(F.max("__up").alias("__up"), F.max("__down").alias("__down"))
    score = edges.select(group, *ends).join(both, ["__a", "__b"], "left")
    total = F.sum(F.coalesce("__up", F.lit(0)) + F.coalesce("__down", F.lit(0)))
    by_edge = score.groupBy(group).agg(F.count("*").alias("edgenum"), F.bround(total, 1).alias("bitscore"))
    nodes = edges.select(group, F.col("src").alias("ppid")).union(edges.select(group, "dst")).distinct().join(proteins, "ppid")
    by_node = distinct_counts(stored(nodes.select(group, "ppid", "sqid", "gnid", "spid"), "nodes"), group, ("ppid", "sqid", "gnid", "spid"))
    return by_node.join(by_edge, group)


def representatives(table: DataFrame, group: str = "GGid", order: Sequence[str] = ("spidnum", "bitscore"), ties: str = "OGid") -> DataFrame:
    """The row of each group that is highest in `order`, the first in `ties` among equals."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*(F.col(c).desc() for c in order), ties))
    return table.withColumn("__place", place).where("__place = 1").drop("__place")


def single_copy(members: DataFrame, group: str = "OGid", least: int = 20) -> DataFrame:
    """Groups with as many genes as species, and at least so many."""
    counts = counted(members.select(group, "gnid", "spid"), group, ("gnid", "spid"))
    return counts.where((F.col("gnidnum") == F.col("spidnum")) & (F.col("spidnum") >= least))


def satisfying(members: DataFrame, rules: DataFrame, group: str = "OGid", item: str = "spid") -> DataFrame:
    """Groups that have, for every rule, at least its minimum of the rule's items. rules: rule, item, min."""
    n_rules = rules.select("rule").distinct().count()
    found = members.select(group, F.col(item).alias("item")).distinct().join(rules, "item").groupBy(group, "rule", "min").agg(F.count("*").alias("n"))
    met = found.where("n >= min").groupBy(group).agg(F.count("*").alias("met"))
    return met.where(F.col("met") == n_rules).select(group)


def complete(members: DataFrame, n: int, group: str = "OGid") -> DataFrame:
    """Groups with n proteins, n genes and n species."""
    counts = counted(members.select(group, "ppid", "gnid", "spid"), group, ("ppid", "gnid", "spid"))
    return counts.where((F.col("ppidnum") == n) & (F.col("gnidnum") == n) & (F.col("spidnum") == n)).select(group)


def missing_one(members: DataFrame, universe: DataFrame, group: str = "OGid", item: str = "spid") -> DataFrame:
    """For each item, how many groups lack it and nothing else.

    A group's items are known by their number and two hashes of all of them, so the one that is lacking follows by subtraction
    from those of the universe. Items outside the universe and null ones don't count.
    """
    one, two = F.xxhash64("__item"), F.xxhash64(F.lit(1), "__item")
    whole = universe.select(F.col(item).alias("__item")).where("__item is not null").distinct()
    all_ = whole.agg(F.count("*").alias("n"), F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two")).first()  # three numbers
    own = members.select(group, F.col(item).alias("__item")).distinct().join(whole, "__item", "left_semi")
    sums = own.groupBy(group).agg(F.count("*").alias("n"), F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two")).where(F.col("n") == all_.n - 1)
    lacked = sums.groupBy(F.col("one").bitwiseXOR(F.lit(all_.one or 0)).alias("one"), F.col("two").bitwiseXOR(F.lit(all_.two or 0)).alias("two")).agg(F.count("*").alias("n"))
    return whole.select("__item", one.alias("one"), two.alias("two")).join(lacked, ["one", "two"]).select(F.col("__item").alias(item), "n")


def component_types(members: DataFrame, clustered: DataFrame) -> DataFrame:
    """component_id and type: 0 no group, 1 one group of all nodes, 2 one of some, 3 several apart, 4 several that share nodes.

    members: component_id, node. clustered: component_id, OGid, node.
    """
    sizes = members.groupBy("component_id").agg(F.countDistinct("node").alias("size"))
    own = clustered.select("component_id", "OGid", "node").distinct()
    groups = own.groupBy("component_id").agg(F.countDistinct("OGid").alias("groups"), F.countDistinct("node").alias("inside"), F.count("*").alias("places"))
    kind = F.when(F.col("groups").isNull(), 0).when(F.col("groups") == 1, F.when(F.col("inside") == F.col("size"), 1).otherwise(2)).when(F.col("places") > F.col("inside"), 4).otherwise(3)
    return sizes.join(groups, "component_id", "left").select("component_id", kind.alias("type"))


def sequence_representatives(proteins: DataFrame, order: str = "ord") -> DataFrame:
    """proteins (gnid, ppid, seq, order) with sqid: the first protein of the same gene with the same sequence."""
    return proteins.withColumn("sqid", F.first("ppid").over(Window.partitionBy("gnid", "seq").orderBy(order)))


def density(edges: Column, nodes: Column) -> Column:
    """Share of the possible edges."""
    return 2 * edges / (nodes * (nodes - 1))


def subsets(members: DataFrame, species: int, group: str = "OGid") -> DataFrame:
    """group with single (all species, one gene of each) and unique (single, and a protein that is in no other group).

    members: group, ppid, gnid, spid.
    """
    counts = counted(members.select(group, "gnid", "spid"), group, ("gnid", "spid")).withColumnsRenamed({"gnidnum": "__g", "spidnum": "__s"})
    alone = members.select(group, "ppid").distinct().groupBy("ppid").agg(F.count("*").alias("__n"), F.min(group).alias(group)).where("__n = 1").select(group).distinct().withColumn("__alone", F.lit(True))
    single = (F.col("__s") == species) & (F.col("__g") == species)
    return counts.join(alone, group, "left").select(group, single.alias("single"), (single & F.coalesce("__alone", F.lit(False))).alias("unique"))


def added_members(before: DataFrame, after: DataFrame, group: str = "OGid", item: str = "ppid") -> DataFrame:
    """Of each group of `before`: its items there and in `after`, and how many the latter has beyond the former (delta)."""
    a, b = (t.select(group, item).distinct() for t in (before, after))
    both = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), [group, item], "full")
    out = both.groupBy(group).agg(F.count("__a").alias(f"{item}num1"), F.count("__b").alias(f"{item}num2"), F.count_if(F.col("__a").isNull()).alias("delta"))
    return out.where(F.col(f"{item}num1") > 0)


def multiplicity(members: DataFrame, group: str, item: str) -> DataFrame:
    """How many items are in one group, in two, and so on: groups, n."""
    per = members.select(group, item).distinct().groupBy(item).agg(F.count("*").alias("groups"))
    return per.groupBy("groups").agg(F.count("*").alias("n"))


def without_errors(table: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows none of whose flags is set; a flag that is missing counts as set."""
    ok = F.lit(True)
    for name in flags:
        ok = ok & (~F.col(name).cast("boolean"))
    return table.where(ok)


def drawn(chosen: DataFrame, members: DataFrame, genes: DataFrame, group: str = "OGid", gene: str = "gnid") -> DataFrame:
    """Every gene, with the groups that it is in and what the chosen groups have beside; null where there is none."""
    return chosen.join(members, group, "right").join(genes, gene, "right")
