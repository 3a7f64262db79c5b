"""Removal of lines that many documents share.

A line's key is the line without white space at both ends and with A-Z in lower case. Keys are known by a 128-bit hash:
its first half addresses, its second half is the fingerprint. Documents are counted once for each key, with partial sums
before the shuffle. The keys that documents lose are put into a sharded minimal perfect hash, which indexes an array of
fingerprints and one of counts, and documents probe these arrays.

Keys with over 1/HOT of all counts are at most HOT in number whatever the input is, so their shards are broadcast and
documents probe them where they are. If rarer keys have to go too, their shards stay where they were built. A Bloom filter
of these keys, of FILTER_BITS bits at most, is broadcast instead: lines that it doesn't know never leave their task. The
hashes that pass are dealt over shards and, where a shard is asked more than ASKED hashes, over several copies of it; what
is found comes back to the documents by the hash of their text, of which frequent ones are dealt over several tasks too. A
filter that is too small for the number of keys lets more hashes pass and changes no result.

Each row is a document. Null and empty texts are one empty line, and empty keys are never dropped. Repeated rows count
each. An empty table gives an empty result. Columns other than those named are kept as they are (drop_lines) or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_DOCS, HOT, SHARD_KEYS, FILTER_BITS, SLICE, ASKED = 10, 1_000_000, 200_000, 1 << 28, 1 << 20, 2_000_000
STRIP = common.WS.encode()


def line_hashes(lines: list[bytes]) -> list[bytes]:
    """16 bytes for each line's key; none for an empty key."""
    return [xxhash.xxh3_128_digest(key) if (key := line.strip(STRIP).lower()) else b"" for line in lines]


class PerfectHash:
    """Keys find a free bit in the first level where no other key has theirs; its rank among all bits is their index."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        bits = np.concatenate([np.unpackbits(x) for x in levels]) if levels else np.zeros(0, np.uint8)
        self.rank = np.cumsum(bits, dtype=np.int64) - bits
        self.bits = bits

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct 64-bit integers."""
        levels = []
        while keys.size:
            size = max(64, 2 * keys.size + 7 & ~7)
            at = cls.slot(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            keys = keys[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Of a member, its index; of any other key, some index or -1."""
        out, open_, base = np.full(keys.size, -1, np.int64), np.arange(keys.size), 0
        for level, bits in enumerate(self.levels):
            if not open_.size:
                break
            at = base + self.slot(keys[open_], level, 8 * bits.size)
            hit = self.bits[at] == 1
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
            base += 8 * bits.size
        return out


def build_shard(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Levels, fingerprints and counts as bytes. first: distinct."""
    index = PerfectHash.build(first)
    at = index.index(first)
    prints, numbers = np.zeros(first.size, np.uint64), np.zeros(first.size, np.uint32)
    prints[at], numbers[at] = second, np.minimum(counts, 2**32 - 1)
    sizes = np.array([len(index.levels), *(x.size for x in index.levels)], np.uint32)
    return sizes.tobytes() + b"".join(x.tobytes() for x in index.levels), prints.tobytes(), numbers.tobytes()


class Shard:
    def __init__(self, levels: bytes, prints: bytes, counts: bytes):
        n = int(np.frombuffer(levels, np.uint32, 1)[0])
        sizes, at, found = np.frombuffer(levels, np.uint32, n, 4), 4 + 4 * n, []
        for size in sizes.tolist():
            found.append(np.frombuffer(levels, np.uint8, size, at))
            at += size
        self.index, self.prints, self.counts = PerfectHash(found), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32)

    def probe(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Documents counted for each key; 0 for keys that aren't here."""
        at = self.index.index(first)
        known = at >= 0
        known[known] = self.prints[at[known]] == second[known]
        out = np.zeros(first.size, np.uint32)
        out[known] = self.counts[at[known]]
        return out


def key_counts(docs: DataFrame) -> DataFrame:
    """first, second (halves of a key's hash) and the number of documents that have the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                if text:
                    found += {*line_hashes(text.encode().split(b"\n"))} - {b""}
            pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["first", "second"])

    return common.python(docs.select("text"), run, "first long, second long").groupBy("first", "second").agg(F.count("*").alias("docs"))


def shards(counts: DataFrame, n: int) -> DataFrame:
    """levels, prints and counts of each shard; where two keys agree in the first half, the shard has a further row."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        rows, rest = [], part
        while len(rest):  # more than one round only if first halves agree
            again = rest.duplicated("first")
            now = rest[~again]
            rows.append((int(part["shard"].iloc[0]), *build_shard(now["first"].to_numpy().astype(np.uint64), now["second"].to_numpy().astype(np.uint64), now["docs"].to_numpy())))
            rest = rest[again]
        return pd.DataFrame(rows, columns=["shard", "levels", "prints", "counts"])

    return counts.withColumn("shard", F.pmod("first", F.lit(n))).groupBy("shard").applyInPandas(build, "shard long, levels binary, prints binary, counts binary")


def probe_all(of: dict[int, list[Shard]], n: int, hashes: list[bytes], least: int) -> np.ndarray:
    """For each hash, whether its key has `least` documents."""
    out = np.zeros(len(hashes), bool)
    there = np.fromiter(map(len, hashes), np.int64, len(hashes)) > 0
    pair = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    hit, at = np.zeros(len(pair), bool), pair[:, 0] % n
    first, second = pair[:, 0].astype(np.uint64), pair[:, 1].astype(np.uint64)
    for k in np.unique(at).tolist():
        own = np.flatnonzero(at == k)
        for shard in of.get(k, ()):
            hit[own] |= shard.probe(first[own], second[own]) >= least
    out[there] = hit
    return out


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, hot: int = HOT, shard_keys: int = SHARD_KEYS, counts: bool = True) -> DataFrame:
    """docs (any columns) with the kept text in place of text; with n_lines and n_dropped too if counts are wanted, in place of columns of that name."""
    out = marked_lines(docs, min_docs, hot, shard_keys)
    if not counts:
        return out.select(*docs.columns)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))


def marked_lines(docs: DataFrame, min_docs: int, hot: int, shard_keys: int) -> DataFrame:
    """docs with the kept text, __n_lines and __n_dropped."""
    spark = docs.sparkSession
    counts = common.stored(key_counts(docs).where(F.col("docs") >= min_docs), "counts")
    size = counts.agg(F.count("*").alias("keys"), F.sum("docs").alias("pairs")).first()
    bound = max(min_docs, (size.pairs or 0) // hot)  # at most `hot` keys reach it
    near = counts.where(F.col("docs") >= bound)
    n = max(1, -(-min(size.keys, hot) // shard_keys))
    table = spark.sparkContext.broadcast((n, [tuple(r) for r in shards(near, n).collect()]))
    cold = bound > min_docs
    others = [c for c in docs.columns if c != "text"]
    source = docs.select(*others, "text")
    if cold:
        source = with_rare(source, counts.where(F.col("docs") < bound), min_docs, shard_keys, size.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = table.value
        of: dict[int, list[Shard]] = {}
        for k, *blobs in rows:
            of.setdefault(k, []).append(Shard(*blobs))
        for batch in batches:
            texts = [(t or "").encode().split(b"\n") for t in batch.column(len(others)).to_pylist()]
            hashes = line_hashes([x for t in texts for x in t])
            gone = probe_all(of, n, hashes, min_docs)
            rare = batch.column(len(others) + 1).to_pylist() if cold else [None] * len(texts)
            kept, dropped, at = [], [], 0
            for lines, more in zip(texts, rare):
                own = gone[at : at + len(lines)]
                if more:
                    lost = {more[i : i + 16] for i in range(0, len(more), 16)}
                    own = own | np.array([h in lost for h in hashes[at : at + len(lines)]], bool)
                at += len(lines)
                kept.append(b"\n".join([x for x, g in zip(lines, own.tolist()) if not g]) if own.any() else b"\n".join(lines))
                dropped.append(int(own.sum()))
            added = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *added], names=[*others, "text", "__n_lines", "__n_dropped"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "text string", "__n_lines long", "__n_dropped long"])
    return common.python(source, run, schema)


def places(first: np.ndarray, second: np.ndarray, mask: int) -> list[np.ndarray]:
    """The filter's bits of each key: three independent parts of its hash."""
    a, b, m = first.astype(np.uint64), second.astype(np.uint64), np.uint64(mask)
    return [(a & m).astype(np.int64), (a >> np.uint64(32) & m).astype(np.int64), (b & m).astype(np.int64)]


def bloom(counts: DataFrame, keys: int, most: int = FILTER_BITS) -> tuple[int, bytes]:
    """Mask and bits of a filter of the keys, built in slices: at most `most` / 8 bytes, whatever the number of keys."""
    bits = SLICE
    while bits < min(most, 16 * keys):
        bits *= 2
    mask = F.lit(bits - 1)
    at = F.array(F.col("first").bitwiseAND(mask), F.shiftrightunsigned("first", 32).bitwiseAND(mask), F.col("second").bitwiseAND(mask))
    each = counts.select(F.explode(at).alias("at")).distinct().withColumn("slice", F.shiftright("at", 20).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(SLICE, np.uint8)
        own[part["at"].to_numpy() & (SLICE - 1)] = 1
        return pd.DataFrame([(int(part["slice"].iloc[0]), np.packbits(own, bitorder="little").tobytes())], columns=["slice", "bits"])

    out = np.zeros((bits // SLICE, SLICE // 8), np.uint8)
    for row in each.groupBy("slice").applyInPandas(build, "slice int, bits binary").collect():
        out[row.slice] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits - 1, out.tobytes()


def asking(docs: DataFrame, mask: int, bits: bytes) -> DataFrame:
    """Of each text (own1, own2, its hash) the hashes of lines that the filter knows, 16 bytes each, if there are any. docs: own1, own2, text."""
    held = docs.sparkSession.sparkContext.broadcast((mask, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, table = held.value[0], np.frombuffer(held.value[1], np.uint8)
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = sorted({*line_hashes((text or "").encode().split(b"\n"))} - {b""})
                pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                known = np.ones(len(pair), bool)
                for at in places(pair[:, 0], pair[:, 1], mask):
                    known &= table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                if known.any():
                    rows.append(i)
                    keys.append(pair[known].tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary())], names=["own1", "own2", "keys"])

    return common.python(docs.select("own1", "own2", "text"), run, "own1 long, own2 long, keys binary")


def with_rare(docs: DataFrame, counts: DataFrame, min_docs: int, shard_keys: int, keys: int, asked_rows: int = ASKED) -> DataFrame:
    """docs (text as the last column) with the hashes of each text's rarer lines that go."""
    n = max(1, -(-keys // shard_keys))
    text = F.coalesce("text", F.lit(""))
    hashed = docs.withColumns({"__own1": F.xxhash64(text), "__own2": F.xxhash64(F.lit(1), text)})
    texts = hashed.select(F.col("__own1").alias("own1"), F.col("__own2").alias("own2"), "text")
    askers = common.stored(asking(texts, *bloom(counts, keys)).dropDuplicates(["own1", "own2"]), "askers")
    size = askers.agg(F.sum(F.length("keys") / 16)).first()[0] or 0
    copies = max(1, -(-int(size) // (n * asked_rows)))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            pair = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
            times = np.array([len(x) // 16 for x in blobs], np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(k).to_numpy(), times)) for k in (0, 1)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["own1", "own2", "first", "second"])

    asked = common.python(askers, exploded, "own1 long, own2 long, first long, second long").withColumns({"shard": F.pmod("first", F.lit(n)), "copy": F.pmod(F.xxhash64("own1"), F.lit(copies))})
    built = shards(counts, n).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def look(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        first, second = left["first"].to_numpy().astype(np.uint64), left["second"].to_numpy().astype(np.uint64)
        hit = np.zeros(len(left), bool)
        for row in right.itertuples():
            hit |= Shard(row.levels, row.prints, row.counts).probe(first, second) >= min_docs
        left = left[hit]
        pair = left[["first", "second"]].to_numpy(np.int64)
        return pd.DataFrame({"own1": left["own1"], "own2": left["own2"], "key": [x.tobytes() for x in pair]})

    found = asked.groupBy("shard", "copy").cogroup(built.groupBy("shard", "copy")).applyInPandas(look, "own1 long, own2 long, key binary")
    found = found.groupBy(F.col("own1").alias("__own1"), F.col("own2").alias("__own2")).agg(F.concat_ws("", F.collect_list(F.hex("key"))).alias("__gone"))
    frequent = common.hot_keys(hashed.groupBy("__own1", "__own2").agg(F.count("*").alias("n")), "n")
    joined = common.spread_join(hashed.withColumn("__row", F.monotonically_increasing_id()), found, ["__own1", "__own2"], frequent, "__row", "left")
    return joined.select(*docs.columns, F.unhex("__gone").alias("__gone"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), gone AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (k IN (FROM gone)))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (FROM gone)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
