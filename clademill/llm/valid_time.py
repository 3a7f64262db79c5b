"""Sales enriched with the version of their client that was valid when they were made, as late data allows.

Sales and changes come in batches, fed one after another to a streaming query that is started anew for each on one
checkpoint. Each table has its own event-time watermark, set by one row a batch that carries the greatest time seen so
far; rows of data carry none, so Spark drops none of them. The lesser of the two watermarks (Spark's policy `min`) is H.
Clients are dealt over buckets, whose state holds the waiting sales and the versions; a bucket's timer stands at the
earliest time at which a client of it has a sale to release or a version to prune. Spark's watermark counts milliseconds
and the tables' times microseconds, so the event clock takes a millisecond for each microsecond since 1970.

A client with more than HOT_ROWS rows is cut into parts of its time line, each with its state; every batch, its parts
report how many versions they hold and the last one, and what they can't know (the sum of versions, the last version of
an earlier part, whether a later part's version has outlived theirs) is joined to the sales that they released.

Rows: a change below its table's watermark is `late`; all other changes with a time and a client are versions. Changes
without a time are ignored, and those without a client nobody's, as are the versions of a sale without a client: it has
none. Sales without a time leave at once, without a version. Repeated sales are sales of their own, repeated changes
(equal in all columns) are one. Changes equal in time and id are ordered by amount, then operation, null first. Times
before 1970 or after 2261 set the watermark as those years' ends do. An empty table has no watermark: all sales with a
time then leave after the last batch. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a client beyond which its time line is cut into parts, and rows of a bucket of clients, over all batches.
HOT_ROWS, BUCKET_ROWS = 10_000, 80_000
NONE, LATEST = -(2**63), 9_200_000_000_000_000
UNIT = ["client", "slot"]
FEED = "what string, bucket int, client long, slot int, id long, no_id boolean, at long, no_at boolean, seen long, amount long, no_amount boolean, op string, mark long"
OUT = "rec string, batch int, client long, slot int, id long, no_id boolean, no_at boolean, n_held long, found boolean, change_id long, no_change_id boolean, amount long, no_amount boolean, op string, old boolean"
WAITING = ["client", "slot", "id", "no_id", "at", "no_at"]
VERSION = ["client", "slot", "id", "no_id", "at", "amount", "no_amount", "op", "old"]
VERSIONS = pa.schema([("client", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("no_id", pa.bool_()), ("at", pa.int64()), ("amount", pa.int64()), ("no_amount", pa.bool_()), ("op", pa.string()), ("old", pa.bool_())])
SALES = pa.schema([("client", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("no_id", pa.bool_()), ("at", pa.int64()), ("no_at", pa.bool_())])


def packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(frame, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return (pa.ipc.open_stream(blob).read_all() if blob else schema.empty_table()).to_pandas()


def in_order(versions: pd.DataFrame) -> pd.DataFrame:
    """By time and id; ids and amounts that are null come first."""
    keys = versions.assign(no_id=~versions.no_id, no_amount=~versions.no_amount, op=versions.op.fillna(""), no_op=versions.op.notna())
    return versions.loc[keys.sort_values(["at", "no_id", "id", "no_amount", "amount", "no_op", "op"], kind="stable").index]


def serve(key: tuple, frames: Iterator[pd.DataFrame], state, batch: int, end: bool) -> Iterator[pd.DataFrame]:
    """One bucket in one batch, called for its rows or by its timer: late changes, released sales, and reports of the parts of hot clients."""
    now = state.getCurrentWatermarkMs() or NONE
    rows = pd.concat([pd.DataFrame(columns=[c.split()[0] for c in FEED.split(", ")]), *frames], ignore_index=True) if not state.hasTimedOut else None
    waiting, versions = (unpacked(x, s) for x, s in zip(state.get if state.exists else (None, None), (SALES, VERSIONS)))
    ticks = late = None
    if rows is not None and len(rows):
        changes, ticks = rows[rows.what == "change"], rows[rows.what == "tick"]
        late = changes[changes["at"] < changes.seen]
        fresh = changes[(changes["at"] >= changes.seen) & (changes.slot > -2)]
        if len(fresh):
            versions = pd.concat([versions, fresh.assign(old=False)[VERSION]], ignore_index=True).astype({"slot": "int32", "old": bool, "no_id": bool, "no_amount": bool, "client": "int64", "id": "int64", "at": "int64", "amount": "int64"})
        sales = rows[rows.what == "sale"]
        if len(sales):
            waiting = pd.concat([waiting, sales[WAITING]], ignore_index=True).astype({"slot": "int32", "no_id": bool, "no_at": bool, "client": "int64", "id": "int64", "at": "int64"})
    versions = in_order(versions)
    leaves = waiting.no_at | (waiting["at"] < now) | end
    if late is not None and len(late):
        yield shaped(late.assign(rec="late", n_held=0, found=False, change_id=0, no_change_id=True, no_amount=True, op=None, old=False), batch)
    sold = waiting[leaves]
    if len(sold) or ticks is not None and len(ticks):
        held = versions.rename(columns={"id": "change_id", "no_id": "no_change_id"})
        counts = versions.groupby(UNIT, as_index=False).agg(n_held=("old", "size"), n_old=("old", "sum"))
    if len(sold):
        found = pd.merge_asof(sold.sort_values("at", kind="stable"), held.assign(found=True), on="at", by=UNIT).merge(counts, on=UNIT, how="left")
        found["found"] = found.found.notna() & ~found.no_at
        yield shaped(found.assign(rec="sale"), batch)
    if ticks is not None and len(ticks):
        last = ticks[UNIT].astype({"client": "int64", "slot": "int32"}).merge(held.assign(found=True).drop_duplicates(UNIT, keep="last"), on=UNIT, how="left").merge(counts, on=UNIT, how="left")
        last["old"] = last.n_old.fillna(0) > 0
        last["n_held"] = last.n_held.fillna(0) - last.n_old.fillna(0)
        yield shaped(last.assign(rec="part", id=0, no_id=True, no_at=False, found=last.found.notna()), batch)
    waiting = waiting[~leaves]
    past = versions["at"] <= now
    versions = versions[~(past & versions[past].duplicated(UNIT, keep="last").reindex(versions.index, fill_value=False))].assign(old=past)
    if len(waiting) or len(versions):
        state.update((packed(waiting, SALES), packed(versions, VERSIONS)))
        due = [*waiting["at"], *(versions["at"][versions.duplicated(UNIT)] - 1)]
        if due and not end:
            state.setTimeoutTimestamp(max(1, int(min(due))))
    elif state.exists:
        state.remove()


def shaped(frame: pd.DataFrame, batch: int) -> pd.DataFrame:
    """The columns of OUT; where nothing was found, 0 with its flag."""
    out = frame.assign(batch=batch, op=frame.op.astype(object).where(frame.op.notna(), None))
    for name in ("no_change_id", "no_amount", "old"):
        out[name] = out[name].astype("boolean").fillna(name != "old").astype(bool)
    for name in ("n_held", "change_id", "amount"):
        out[name] = out[name].astype("Int64").fillna(0).astype("int64")
    return out[[c.split()[0] for c in OUT.split(", ")]]


def rows_of(df: DataFrame, what: str, hot: DataFrame, buckets: int) -> DataFrame:
    """Rows of the feed: the part of a hot client (slot; -1 a client in one piece, -2 none) and the bucket."""
    amount, op = (F.col("amount"), F.col("op")) if what == "change" else (F.lit(None).cast("long"), F.lit(None).cast("string"))
    part = F.when(F.col("at").isNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.expr("(at - lo) div width"))
    slot = F.when(F.col("client").isNull(), -2).when(F.col("parts").isNull(), -1).otherwise(part).cast("int")
    own = F.when(F.col("slot") == -2, F.xxhash64("id", "at")).otherwise(F.xxhash64("client", "slot"))
    return (
        df.select("batch", "client", "id", "at", amount.alias("amount"), op.alias("op")).join(hot, "client", "left").withColumn("slot", slot).withColumn("bucket", F.pmod(own, F.lit(buckets)).cast("int"))
        .select("batch", F.lit(what).alias("what"), "bucket", F.coalesce("client", F.lit(0)).alias("client"), "slot", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), F.coalesce("at", F.lit(NONE)).alias("at"), F.col("at").isNull().alias("no_at"), F.coalesce("amount", F.lit(0)).alias("amount"), F.col("amount").isNull().alias("no_amount"), "op")
    )


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session whose batches are those fed to it, without one more where a watermark has moved."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    session.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    return session


def advance(session: SparkSession, folder: str, batch: int, end: bool) -> None:
    """Start the query on what has been fed since, and wait for its end."""

    def read(table: str) -> DataFrame:
        fed = session.readStream.schema(FEED).parquet(f"{folder}/feed/{table}").withColumn("mark", F.timestamp_millis("mark"))
        return fed.withWatermark("mark", "0 seconds").where("mark is null")

    served = read("sales").union(read("changes")).groupBy("bucket").applyInPandasWithState(partial(serve, batch=batch, end=end), OUT, "waiting binary, versions binary", "append", "EventTimeTimeout")
    served.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def enriched(sales: DataFrame, changes: DataFrame, batches: int, hot_rows: int = HOT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """sales (batch int, id, client, at: microseconds since 1970) and changes (the same, with amount long and op string; at not null)
    in batches 0 to batches - 1: rec, id, batch, n_held, change_id, amount and op of late changes and of all sales."""
    spark, folder = sales.sparkSession, common.shared_dir(sales.sparkSession)
    buckets = max(32, -(-(sales.count() + changes.count()) // bucket_rows))
    both = sales.select("client", "at").union(changes.select("client", "at")).where("client is not null")
    ranges = both.groupBy("client").agg(F.count("*").alias("n"), F.coalesce(F.min("at"), F.lit(0)).alias("lo"), F.coalesce(F.max("at"), F.lit(0)).alias("hi")).where(F.col("n") > hot_rows)
    parts = F.ceil(F.col("n") / hot_rows)
    hot = common.stored(ranges.select("client", "lo", parts.alias("parts"), F.expr(f"(hi - lo) div ceil(n / {hot_rows}) + 1").alias("width")), "hot")
    staged, seen = {}, {}
    for table, what, df in (("sales", "sale", sales), ("changes", "change", changes)):
        rows_of(df, what, hot, buckets).write.partitionBy("batch").option("compression", "zstd").parquet(f"{folder}/staged/{table}")
        fields = "batch int, " + FEED.replace(", seen long", "").replace(", mark long", "")
        staged[table] = spark.read.schema(fields).parquet(f"{folder}/staged/{table}")
        seen[table] = {r.batch: r.at for r in staged[table].where("not no_at").groupBy("batch").agg(F.max("at").alias("at")).collect()}  # a row a batch
    session, greatest = streaming_session(spark), {"sales": NONE, "changes": NONE}
    nobody = {"client": F.lit(0).cast("long"), "slot": F.lit(-2), "id": F.lit(0).cast("long"), "no_id": F.lit(True), "at": F.lit(NONE), "no_at": F.lit(True), "amount": F.lit(0).cast("long"), "no_amount": F.lit(True), "op": F.lit(None).cast("string"), "bucket": F.lit(0)}
    units = hot.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    ticks = units.withColumns({k: v for k, v in nobody.items() if k not in UNIT} | {"bucket": F.pmod(F.xxhash64("client", "slot"), F.lit(buckets)).cast("int"), "what": F.lit("tick")})
    ends = spark.range(buckets).withColumns(nobody | {"bucket": F.col("id").cast("int"), "what": F.lit("end")}).withColumn("id", F.lit(0).cast("long"))
    columns = [c.split()[0] for c in FEED.split(", ")]
    for batch in range(batches + 1):
        for table, own in staged.items():
            before = greatest[table]
            greatest[table] = max(before, seen[table].get(batch, NONE))
            fed = own.where(F.col("batch") == batch).drop("batch")
            if table == "sales":
                fed = fed.unionByName(ticks.select(fed.columns))
                fed = fed.unionByName(ends.select(fed.columns)) if batch == batches else fed
            fed = fed.withColumns({"seen": F.lit(before), "mark": F.lit(None).cast("long")})
            mark = spark.range(1).withColumns(nobody | {"what": F.lit("mark"), "seen": F.lit(before), "mark": F.lit(min(max(greatest[table], 0), LATEST)).cast("long")})
            fed.select(columns).unionByName(mark.select(columns)).write.mode("append").parquet(f"{folder}/feed/{table}")
        advance(session, folder, batch, batch == batches)
    return completed(spark.read.schema(OUT).parquet(f"{folder}/out"))


def completed(raw: DataFrame) -> DataFrame:
    """What the stream gave, with the sales of hot clients told of the other parts of their client."""
    own = F.struct("change_id", "no_change_id", "amount", "no_amount", "op")
    every = Window.partitionBy("client", "batch")
    parts = raw.where("rec = 'part'").withColumn("top", F.max(F.when(F.col("old"), F.col("slot"))).over(every))
    valid = F.col("found") & ((F.col("n_held") > 0) | F.coalesce(F.col("slot") == F.col("top"), F.lit(False)))
    parts = parts.select(
        "client", "slot", "batch", "top", (F.sum("n_held").over(every) + F.col("top").isNotNull().cast("long")).alias("held"),
        F.last(F.when(valid, own), True).over(every.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
    )
    hot = raw.where("rec = 'sale' and slot >= 0").join(parts, ["client", "slot", "batch"], "left")
    stands = F.col("found") & (~F.col("old") | F.coalesce(F.col("slot") == F.col("top"), F.lit(False)))
    hot = hot.select("rec", "batch", "id", "no_id", F.coalesce("held", F.lit(0)).alias("n_held"), F.when(~F.col("no_at"), F.when(stands, own).otherwise(F.col("before"))).alias("version"))
    whole = raw.where("rec <> 'part' and (rec = 'late' or slot < 0)").select("rec", "batch", "id", "no_id", F.when(F.col("rec") == "sale", F.col("n_held")).alias("n_held"), F.when(F.col("found"), own).alias("version"))
    return whole.union(hot).select(
        "rec", F.when(~F.col("no_id"), F.col("id")).alias("id"), F.col("batch").cast("long").alias("batch"), "n_held",
        F.when(~F.col("version.no_change_id"), F.col("version.change_id")).alias("change_id"), F.when(~F.col("version.no_amount"), F.col("version.amount")).alias("amount"), "version.op",
    )


BATCHES, FIRST_DAY, DAYS, LAGS = 12, 19723, 152, 4


def batch_of(day: Column) -> Column:
    """The batch of a day since 1970; days before the first go to batch 0, none to the last."""
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def op11_valid_time_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda name: F.unix_date(F.col(name).cast("date"))
    sales = common.read(spark, sf_dir, "sales").select(batch_of(day("arrived_at")).alias("batch"), F.col("sale_id").alias("id"), F.col("client_id").alias("client"), micros("sold_at").alias("at"))
    finite = ~F.isnan("balance") & (F.abs("balance") < 9e16)
    changes = common.read(spark, sf_dir, "client_changes").where("valid_at is not null").distinct().select(
        batch_of(day("valid_at") + common.remainder("change_id", LAGS)).alias("batch"), F.col("change_id").alias("id"), F.col("client_id").alias("client"), micros("valid_at").alias("at"),
        F.when(finite, F.floor(100 * F.col("balance") + 0.5)).cast("long").alias("amount"), "op",
    )
    return enriched(sales, changes, BATCHES).withColumnRenamed("amount", "balance_cents")


#: crc32 byte by byte over a table that the first expression makes; 3988292384 is its reversed polynomial.
OP11_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
v AS (
  SELECT client_id, change_id, valid_at, floor(100 * balance + 0.5)::BIGINT AS cents, op,
    greatest(0, least(11, floor((date_diff('day', DATE '1970-01-01', valid_at::DATE) + xor(list_reduce(list_prepend(4294967295, list_transform(string_split(change_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) % 4 - 19723) * 12 / 152))) AS a
  FROM d, t
),
s AS (SELECT row_number() OVER () AS r, sale_id, client_id, sold_at, greatest(0, least(11, floor((date_diff('day', DATE '1970-01-01', arrived_at::DATE) - 19723) * 12 / 152))) AS a FROM sales),
m AS (SELECT b, (SELECT max(sold_at) FROM s WHERE a < b) AS ws, (SELECT max(valid_at) FROM v WHERE a < b) AS wc FROM range(13) AS q(b)),
h AS (SELECT b, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM m),
g AS (SELECT b, h, lag(h) OVER (ORDER BY b) AS before FROM h),
late AS (SELECT v.* FROM v JOIN h ON h.b = v.a WHERE v.valid_at < h.wc),
kept AS (SELECT v.* FROM v JOIN h ON h.b = v.a WHERE coalesce(v.valid_at >= h.wc, true) AND client_id IS NOT NULL),
o AS (SELECT g.b, k.*, coalesce(k.a < g.b AND k.valid_at <= g.before, false) AS old FROM g JOIN kept k ON k.a <= g.b),
held AS (SELECT * FROM o QUALIFY NOT old OR row_number() OVER (PARTITION BY b, client_id, old ORDER BY valid_at DESC, change_id DESC) = 1),
e AS (SELECT s.*, CASE WHEN sold_at IS NULL THEN a ELSE coalesce((SELECT min(b) FROM g WHERE b < 12 AND b >= s.a AND s.sold_at < g.h), 12) END AS b FROM s)
SELECT 'late' AS rec, change_id AS id, a::BIGINT AS batch, NULL::BIGINT AS n_held, NULL::BIGINT AS change_id, NULL::BIGINT AS balance_cents, NULL AS op FROM late
UNION ALL
SELECT 'sale', sale_id, b::BIGINT, n_held, x.change_id, x.cents, x.op FROM (
  SELECT e.r, any_value(e.sale_id) AS sale_id, any_value(e.b) AS b, count(k.client_id) AS n_held,
    max({'valid_at': k.valid_at, 'change_id': k.change_id, 'cents': k.cents, 'op': k.op}) FILTER (WHERE k.valid_at <= e.sold_at) AS x
  FROM e LEFT JOIN held k ON k.client_id = e.client_id AND k.b = e.b GROUP BY e.r
)
"""
