"""Readers and writers of the file formats that the engine's tables come from."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HSP_SCHEMA = "qppid string, sppid string, length int, nident int, gaps int, qlen int, qstart int, qend int, slen int, sstart int, send int, evalue double, bitscore double"
CODON_FIELDS = ("AAs", "Starts", "Base1", "Base2", "Base3")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, block, ord, header (with >) and seq of each record; block and ord are in the order of a file's records.

    The reader cuts files at each line that starts with >, so that a file is read by as many tasks as it has splits. What
    stands before a file's first record is none; a record of the header alone has an empty sequence.
    """
    cut = spark.read.option("lineSep", "\n>").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\r", "").alias("record"),
    )
    heads = cut.where("block = 0").groupBy("path").agg(F.min("ord").alias("ord")).withColumn("first", F.lit(True))
    # a file's first record keeps its >, all others have lost it to the cut; one row a file is sent to the records, which stay where they are
    head = F.regexp_replace("record", r"^\s+(?=>)", "")
    own = cut.join(F.broadcast(heads), ["path", "ord"], "left").withColumn("record", F.when(F.col("first"), F.when(head.startswith(">"), head)).otherwise(F.concat(F.lit(">"), F.col("record"))))
    return own.where("record is not null").select("file", "block", "ord", F.substring_index("record", "\n", 1).alias("header"), F.regexp_replace(F.regexp_replace("record", "^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def fasta_records(files: DataFrame, text: str) -> DataFrame:
    """The records of a text column, beside the other columns."""
    others = [c for c in files.columns if c != text]
    parts = F.filter(F.split(F.regexp_replace(F.col(text), "\r", ""), r"(?:^|\n)(?=>)"), lambda p: p.startswith(">"))
    each = files.select(*others, F.posexplode(parts).alias("ord", "record"))
    return each.select(*others, "ord", F.substring_index("record", "\n", 1).alias("header"), F.regexp_replace(F.regexp_replace("record", "^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def fasta_text(header: Column, seq: Column, width: int = 80) -> Column:
    """A record with lines of at most `width` symbols."""
    return F.concat(header, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def header_fields(header: Column) -> Column:
    """The map of a header >key=value|key=value."""
    return F.str_to_map(F.regexp_replace(header, "^>", ""), F.lit("[|]"), F.lit("="))


def read_search_output(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """HSPs, and the queries without any, of tabular search output with comment lines.

    A comment `# Query: name` opens a query's block, `# n hits found` says whether rows follow.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    fields = F.split("value", "\t")
    names = [x.split() for x in HSP_SCHEMA.split(", ")]
    hsps = rows.select("file", *(fields[k].cast(t).alias(n) for k, (n, t) in enumerate(names)))
    asked = lines.where(F.col("value").startswith("# Query:")).select("file", F.regexp_extract("value", r"# Query:\s*(\S+)", 1).alias("qppid"))
    return hsps, asked.join(hsps.select("file", "qppid").distinct(), ["file", "qppid"], "left_anti")


def read_table(spark: SparkSession, path: str, schema: str, comment: str | None = None, header: bool = True) -> DataFrame:
    """Tab-separated rows with a header and a schema; lines that start with `comment` are passed over."""
    reader = spark.read.option("sep", "\t").option("header", header).option("enforceSchema", True)
    return (reader.option("comment", comment) if comment else reader).schema(schema).csv(path)


def write_table(table: DataFrame, path: str) -> None:
    """Tab-separated rows with a header, which read_table() reads again."""
    table.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def listed(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path and length of the files below a folder whose names end in suffix."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path).select("path", "length")


def read_pairs(spark: SparkSession, root: str, schema: str, genomes: list[str] | None = None) -> DataFrame:
    """Rows of a folder tree qspid=/sspid=, of the genomes named; pairs of a genome with itself stay out."""
    table = spark.read.schema(schema).parquet(root).where("qspid <> sspid")
    return table if genomes is None else table.where(F.col("qspid").isin(genomes) & F.col("sspid").isin(genomes))


def write_pairs(table: DataFrame, root: str) -> None:
    """One folder for each pair of genomes."""
    table.repartition("qspid", "sspid").write.partitionBy("qspid", "sspid").parquet(root)


def remaining(pairs: DataFrame, root: str) -> DataFrame:
    """The pairs (qspid, sspid) that have no folder below root yet: what a run that was broken off has still to do."""
    done = listed(pairs.sparkSession, root, ".parquet").select(*(F.regexp_extract("path", r"qspid=([^/]*)/sspid=([^/]*)/", k).alias(c) for k, c in ((1, "qspid"), (2, "sspid"))))
    return pairs.join(done.distinct(), ["qspid", "sspid"], "left_anti")


def adjacency(lines: DataFrame, text: str = "value") -> DataFrame:
    """src, dst and score (null without one) of lines `node<tab>other:score,other:score`; a node alone gives dst null."""
    node, rest = F.split(text, "\t")[0], F.coalesce(F.get(F.split(text, "\t"), F.lit(1)), F.lit(""))
    items = lines.select(node.alias("src"), F.explode(F.split(rest, ",")).alias("item"))
    pair = F.split("item", ":")
    return items.select("src", F.nullif(pair[0], F.lit("")).alias("dst"), F.get(pair, F.lit(1)).cast("double").alias("score"))


def adjacency_text(edges: DataFrame) -> DataFrame:
    """One line for each src, its neighbours in order."""
    item = F.when(F.col("score").isNull(), F.col("dst")).otherwise(F.concat_ws(":", "dst", F.col("score").cast("string")))
    return edges.groupBy("src").agg(F.concat_ws(",", F.array_sort(F.collect_list(item))).alias("items")).select(F.concat_ws("\t", "src", "items").alias("value"))


def cluster_edges(table: DataFrame, edges: str = "edges") -> DataFrame:
    """A row for each edge of `a:b,c:d`."""
    others = [c for c in table.columns if c != edges]
    each = table.select(*others, F.explode(F.split(edges, ",")).alias("item"))
    return each.select(*others, F.split("item", ":")[0].alias("src"), F.split("item", ":")[1].alias("dst"))


def edges_text(src: Column, dst: Column) -> Column:
    """`a:b,c:d` of a group's edges, in order."""
    return F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", src, dst))))


def slices(text: Column) -> Column:
    """`a-b,c-d` as an array of start and stop; empty for an empty text."""
    parts = F.filter(F.split(text, ","), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.split(p, "-")[0].cast("int").alias("start"), F.split(p, "-")[1].cast("int").alias("stop")))


def codon_table(text: str) -> tuple[dict[str, str], set[str]]:
    """Amino acid of each codon, and the start codons, from lines `AAs = ...`, `Starts = ...`, `Base1 = ...` and so on."""
    rows = dict(line.replace("=", " ").split(None, 1) for line in text.strip().splitlines())
    aas, starts, *bases = (rows[k].strip() for k in CODON_FIELDS)
    codons = ["".join(c) for c in zip(*bases)]
    return dict(zip(codons, aas)), {c for c, s in zip(codons, starts) if s == "M"}


def write_model(spark: SparkSession, path: str, model: dict) -> None:
    """A model of nested maps as one JSON line."""
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def group_fasta(records: DataFrame, group: str, order: list[str]) -> DataFrame:
    """group and text, its records (header, seq) in the given order as one FASTA text."""
    item = F.struct(*order, fasta_text(F.col("header"), F.col("seq")).alias("__text"))
    return records.groupBy(group).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__text"])).alias("text"))


def report(summary: DataFrame) -> DataFrame:
    """A summary row as one text, a line `name: value` for each column."""
    return summary.select(F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in summary.columns)).alias("text"))
