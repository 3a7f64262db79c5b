"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its shingles (WORDS words in a row, with the number of times they occur); a text of
fewer words is one shingle. Two documents are linked if the weighted Jaccard similarity of their sets is at least
SIMILARITY, and classes are what links connect.

Rows of one text are one node from the start. A node's signature is cut into bands, and nodes with the same band meet in
a bucket. No bucket is expanded into pairs: its members are compared, over their whole texts, with the member that meets
most others over all bands, the bucket's hub. Where a bucket then still holds several classes, its nodes outside the
largest class are compared with all its nodes, in blocks of about BLOCK nodes or BLOCK_BYTES bytes of text on either side
that go to tasks of their own; so only nodes that share a band ever meet, and no cap is set on partners. Two things keep
most of these pairs from their texts. The distance 1 - similarity is a metric: nodes whose distances to the hub differ by
more than 1 - SIMILARITY are no pair. And signatures that agree in a share below FLOOR are passed over. A link of
similarity s is missed if it shares no band, with probability (1 - s**ROWS)**BANDS (6e-5 at 0.8, less than 1e-6 at 0.85),
or by FLOOR, with a probability below 1e-9. Buckets with the same members are handled once, and a pair in its first bucket.

Null and empty texts and texts without a word have no shingle and stay alone, copies of one another included. Ties: a
class is named by its least doc_id, a null id counting last. Repeated rows are of one class. An empty table gives an
empty result. Columns other than the id and the text are not read (near_classes) or kept as they are (one_of_each). Of
rows with one id and one text but other columns that differ, one_of_each keeps the one with the least hash of them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.operators.components import components

from . import common, darts

WORDS, SIMILARITY, ROWS, BANDS, BLOCK, BLOCK_BYTES, FLOOR = 5, 0.8, 6, 32, 1000, 16 << 20, 0.62
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64) | 1) for k in range(1, WORDS + 1)]


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending 64-bit keys of a text's shingles, and how often each occurs."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    key = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        key = key + darts.mixed(h[k : k + n] * FACTORS[k])
    return np.unique(key, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 if a set is empty."""
    one, two = int(a[1].sum()), int(b[1].sum())
    if not one or not two:
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    both = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (one + two - both)


def signed(text: str | None) -> tuple[list[int], bytes]:
    """One 64-bit key for each band, and the lowest byte of each value of the signature; nothing without a word."""
    keys, counts = shingles(text)
    if not keys.size:
        return [], b""
    values = darts.signature(keys, counts.astype(float), ROWS * BANDS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = darts.mixed(out ^ values.reshape(BANDS, ROWS)[:, k])
    return out.view(np.int64).tolist(), values.astype(np.uint8).tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two independent hashes of the text."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return out.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def nodes_of(rows: DataFrame) -> DataFrame:
    """A node for each distinct text: node, h1, h2, doc_id (the least), rows, bands and sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(512)(signed)  # copies often stand together
        for batch in batches:
            found = [held(t) if len(t) < 20_000 else signed(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([b for b, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "h1", "h2", "bands", "sign"])

    out = common.python(rows, run, "doc_id long, h1 long, h2 long, bands array<long>, sign binary")
    out = out.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("sign").alias("sign"))
    return common.stored(out.withColumn("node", F.monotonically_increasing_id()), "nodes")


def met(nodes: DataFrame) -> DataFrame:
    """band, node and hub: each bucket's members beside the member that meets most others."""
    spread = nodes.select("node", F.explode("bands").alias("band"))
    sizes = common.stored(spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    hot = common.hot_keys(sizes, "n")
    members = common.stored(common.spread_join(spread, sizes, ["band"], hot, "node"), "members")
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = members.join(meets, "node").groupBy("band").agg(F.max(F.struct("meets", (-F.col("node")).alias("minus"))).alias("top"))
    return common.stored(common.spread_join(members.select("band", "node"), hubs.select("band", (-F.col("top.minus")).alias("hub")), ["band"], hot, "node"), "met")


def texts_of(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and text of the nodes that occur in edges."""
    wanted = edges.select("node").union(edges.select("hub")).distinct()
    chosen = nodes.select("node", "doc_id", "h1", "h2").join(wanted, "node")
    found = rows.join(chosen, (rows.doc_id.eqNullSafe(chosen.doc_id)) & (rows.h1 == chosen.h1) & (rows.h2 == chosen.h2)).select("node", "text")
    return common.stored(found.dropDuplicates(["node"]), "texts")


def compared(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges with the similarity of their texts."""
    hot = common.hot_keys(edges.groupBy("hub").agg(F.count("*").alias("n")), "n")
    left = edges.join(texts, "node").select("node", "hub", F.col("text").alias("one"))
    pairs = common.spread_join(left, texts.select(F.col("node").alias("hub"), F.col("text").alias("two")), ["hub"], hot, "node").select("node", "hub", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(64)(shingles)
        for batch in batches:
            found = [similarity(sets(a), sets(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["node", "hub", "alike"])

    return common.stored(common.python(pairs, run, "node long, hub long, alike double"), "compared")


def links_of(block: pa.Table) -> list[tuple[int, int]]:
    """Links between the asking and the other nodes of one block: band, node, class, asks, hub, far (the distance to the hub), shared (the node's open bands), sign, text."""
    asks = np.array(block["asks"].to_pylist(), bool)
    if asks.all() or not asks.any():
        return []
    band, nodes, classes, far = block["band"][0].as_py(), *(block[c].to_numpy() for c in ("node", "class", "far"))
    values = np.frombuffer(b"".join(block["sign"].to_pylist()), np.uint8).reshape(len(asks), -1)
    others, root, out = np.flatnonzero(~asks), {}, []
    sets = lru_cache(4 * BLOCK)(lambda i: shingles(block["text"][i].as_py()))
    shared = lru_cache(4 * BLOCK)(lambda i: frozenset(block["shared"][i].as_py()))

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for i in np.flatnonzero(asks).tolist():
        near = others[(classes[others] != classes[i]) & (np.abs(far[others] - far[i]) <= 1 - SIMILARITY + 1e-9)]
        alike = (values[near] == values[i]).mean(1)
        order = np.argsort(-alike, kind="stable")[: int((alike >= FLOOR).sum())]
        for j in near[order].tolist():
            a, b = top(int(classes[i])), top(int(classes[j]))
            if a != b and min(shared(i) & shared(j)) == band and similarity(sets(i), sets(j)) >= SIMILARITY:
                root[a] = b
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def open_buckets(meetings: DataFrame, alike: DataFrame) -> DataFrame:
    """band, hub, node, class and far of the nodes in buckets where the hub is not enough: two classes beside it."""
    links = alike.where(F.col("alike") >= SIMILARITY)
    classes = common.stored(components(links, "node", "hub").withColumnRenamed("component", "class"), "linked")
    own = alike.where(F.col("alike") < SIMILARITY).join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    theirs = classes.select(F.col("node").alias("hub"), F.col("class").alias("main"))
    apart = own.join(theirs, "hub", "left").where(F.col("class") != F.coalesce("main", "hub")).select("node", "hub")
    bands = common.stored(meetings.join(apart, ["node", "hub"], "left_semi").select("band").distinct(), "apart")
    rows = meetings.join(bands, "band", "left_semi").join(alike, ["node", "hub"], "left").join(classes, "node", "left")
    rows = rows.select("band", "hub", "node", F.coalesce("class", "node").alias("class"), F.when(F.col("node") == F.col("hub"), 0.0).otherwise(1 - F.col("alike")).alias("far"))
    rows = common.stored(rows, "grouped")
    # one bucket for each set of members
    sets = rows.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("one"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("two"))
    first = sets.where("n > 2").groupBy("n", "one", "two").agg(F.min("band").alias("band")).select("band")
    return common.stored(rows.join(first, "band", "left_semi"), "open")  # rest_linked reads it four times


def rest_linked(rows: DataFrame, nodes: DataFrame, texts: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links between nodes of one bucket that the comparison with its hub hasn't found. rows: as open_buckets gives them."""
    shared = rows.groupBy("node").agg(F.collect_list("band").alias("shared"))  # BANDS at most
    known = texts.join(nodes.select("node", "sign"), "node").join(shared, "node").withColumn("bytes", F.octet_length("text"))
    sized = rows.join(known.select("node", "bytes"), "node")
    by_class = sized.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    of = by_class.groupBy("band").agg(F.sum("n").alias("size"), F.sum("bytes").alias("bytes"), F.count("*").alias("classes"), F.max(F.struct("n", "bytes", "class")).alias("main"))

    def parts(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / block), F.ceil(size / block_bytes), F.lit(1)).cast("int")

    plan = common.stored(of.where("classes > 1").select("band", F.col("main.class").alias("main"), parts(F.col("size"), F.col("bytes")).alias("others"), parts(F.col("size") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("askers")), "plan")
    left = common.stored(rows.join(plan, "band"), "left")
    own = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    other = left.where("node <> hub").withColumn("two", F.pmod(own, "others").cast("int")).withColumn("one", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).withColumn("asks", F.lit(False))
    asking = left.where("node <> hub and class <> main").withColumn("one", F.pmod(own, "askers").cast("int")).withColumn("two", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("asks", F.lit(True))
    keys = ["band", "one", "two"]
    columns = [*keys, "node", "class", "asks", "far"]
    both = asking.select(*columns).union(other.select(*columns)).join(known.drop("bytes"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.runs(batches, keys):
            found = links_of(part)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["node", "hub"])

    return common.stored(common.python(both.repartition(*keys).sortWithinPartitions(*keys), run, "node long, hub long"), "rest")


def node_classes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and class of the nodes that have a link."""
    meetings = met(nodes)
    edges = common.stored(meetings.where("node <> hub").select("node", "hub").distinct(), "edges")
    texts = texts_of(rows, nodes, edges)
    alike = compared(edges, texts)
    rest = rest_linked(open_buckets(meetings, alike), nodes, texts)
    return components(alike.where(F.col("alike") >= SIMILARITY).select("node", "hub").union(rest), "node", "hub").withColumnRenamed("component", "class")


def named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed rows of docs, and for each distinct text h1, h2, rows, class_id, doc_id (the text's least), worded, and first: whether it stands for its class."""
    rows = keyed(docs)
    nodes = nodes_of(rows)
    classes = nodes.select("node", "h1", "h2", "rows", "doc_id", (F.size("bands") > 0).alias("worded")).join(node_classes(rows, nodes), "node", "left").withColumn("class", F.coalesce("class", "node"))
    classes = common.stored(classes, "classes")
    least = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("least"))
    hot = common.hot_keys(classes.groupBy("class").agg(F.count("*").alias("n")), "n")
    out = common.spread_join(classes, least, ["class"], hot, "node")
    first = (F.col("h1") == F.col("least.h1")) & (F.col("h2") == F.col("least.h2"))
    return rows, common.stored(out.select("h1", "h2", "rows", F.col("least.doc_id").alias("class_id"), "doc_id", "worded", first.alias("first")), "named")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row."""
    rows, texts = named(docs)
    own = common.spread_join(rows.select("doc_id", "h1", "h2"), texts.select("h1", "h2", "class_id", "worded"), ["h1", "h2"], common.hot_keys(texts.select("h1", "h2", "rows"), "rows"), "doc_id")
    return own.select("doc_id", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the least doc_id (then the least hashes of its text), with all its columns; rows without a word all stay."""
    _, texts = named(docs)
    text, keys = F.coalesce("text", F.lit("")), ["__h1", "__h2", "__id", "__none"]
    kept = texts.where("worded and first").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"))
    marked = docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__none": F.col("doc_id").isNull()})
    blank = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == ""
    whole = F.struct(*docs.columns)
    stay = marked.where(~blank).join(kept, keys).groupBy(*keys).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("__row"))
    return stay.select("__row.*").union(docs.where(blank))


def op7_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
