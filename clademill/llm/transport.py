"""MPEG transport streams as a media column: a payload stored in packets of 188 bytes, and such streams read again.

A stream has a program association table, a program map table and one elementary stream of private data, whose packets
(PES) hold FRAME bytes of the payload each, with a presentation time stamp. The first packet of every RAP-th frame is a
random-access point and carries the clock reference. The reader finds the elementary streams through the tables (sections
may span packets), checks their checksums and the continuity counters, drops repeated packets, reassembles the elementary
packets (those of unbounded length too) and lists the time stamps with the byte positions of the random-access points. If
packets lose their place, it looks for the next place from which the sync byte returns at every packet, and passes over
what lies between and the packet before it, which is not whole.

Null and empty texts are stored as 64 zero bytes. Equal texts give equal streams. An empty table gives an empty result.
Damaged streams raise no error: what is wrong is counted in the report, and what is whole is kept. A text and its stream
are one value in memory each, so a worker needs some six times the bytes of its longest text. Columns other than the id and
the text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, PRIVATE_DATA, CLOCK_HZ, STAMPS = 188, 0x47, 0, 0x06, 90_000, 2**33
# Ours.
PMT_PID, DATA_PID, FRAME, RAP, FRAME_TICKS = 0x1000, 0x100, 1090, 4, 3600
HEADS = [struct.pack(">BHB", SYNC, DATA_PID, 0x10 | k) for k in range(16)]


@cache
def crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        table.append(crc)
    return table


def crc32_mpeg(data: bytes) -> int:
    crc, table = 0xFFFFFFFF, crc_table()
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ table[crc >> 24 ^ byte]
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    """A whole table section in one packet's payload."""
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return b"\0" + head + body + struct.pack(">I", crc32_mpeg(head + body))


@cache
def tables() -> bytes:
    """The two packets that open a stream."""
    out = b""
    pat = section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = section(2, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))
    for pid, payload in ((PAT_PID, pat), (PMT_PID, pmt)):
        out += struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + payload.ljust(PACKET - 4, b"\xff")
    return out


def stamp(ticks: int) -> bytes:
    t = ticks % STAMPS
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def write(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter, body = [tables()], 0, PACKET - 4
    for k, at in enumerate(range(0, len(payload), FRAME)):
        data = payload[at : at + FRAME]
        ticks = k * FRAME_TICKS
        pes = b"\0\0\1\xbd" + struct.pack(">HBBB", len(data) + 8, 0x84, 0x80, 5) + stamp(ticks) + data
        clock = ticks % STAMPS
        first_field = bytes([0x50]) + struct.pack(">IH", clock >> 1, (clock & 1) << 15 | 0x7E00) if k % RAP == 0 else b""
        room = body - (len(first_field) + 1 if first_field else 0)
        if len(pes) < room:  # the adaptation field takes what the packet has left
            left = body - 1 - len(pes)
            first_field, room = (first_field or b"\0" * (left > 0)).ljust(left, b"\xff"), len(pes)
            out.append(struct.pack(">BHBB", SYNC, 0x4000 | DATA_PID, 0x30 | counter, left) + first_field + pes)
        elif first_field:
            out.append(struct.pack(">BHBB", SYNC, 0x4000 | DATA_PID, 0x30 | counter, len(first_field)) + first_field + pes[:room])
        else:
            out.append(struct.pack(">BHB", SYNC, 0x4000 | DATA_PID, 0x10 | counter) + pes[:room])
        counter = (counter + 1) % 16
        whole = room + (len(pes) - room) // body * body
        for i in range(room, whole, body):
            out.append(HEADS[counter])
            out.append(pes[i : i + body])
            counter = (counter + 1) % 16
        tail = pes[whole:]
        if tail:
            stuffing = body - 1 - len(tail)
            out.append(struct.pack(">BHBB", SYNC, DATA_PID, 0x30 | counter, stuffing) + (b"\0" + b"\xff" * (stuffing - 1) if stuffing else b"") + tail)
            counter = (counter + 1) % 16
    return b"".join(out)


@dataclass
class Report:
    """payload is that of the first elementary stream, streams has those of all by PID; the numbers are over all of them."""

    payload: bytes = b""
    packets: int = 0
    lost_sync: int = 0
    bad_tables: int = 0
    jumps: int = 0
    repeats: int = 0
    broken: int = 0
    stamps: list[int] = field(default_factory=list)
    points: list[tuple[int, int]] = field(default_factory=list)
    streams: dict[int, bytes] = field(default_factory=dict)


def places(raw: np.ndarray) -> tuple[np.ndarray, int]:
    """Positions of the packets, and how many stretches of other bytes lie between them."""
    n = len(raw) // PACKET
    if n * PACKET == len(raw) and (raw[::PACKET] == SYNC).all():
        return np.arange(n) * PACKET, 0
    found, lost, at = [], 0, 0
    syncs = np.flatnonzero(raw == SYNC)

    def steady(p: int) -> bool:
        """Whether the sync byte stands here and at the next two packets, as far as the stream goes."""
        return p + PACKET <= len(raw) and all(raw[q] == SYNC for q in (p, p + PACKET, p + 2 * PACKET) if q < len(raw))

    while at < len(raw):
        good = raw[at::PACKET] == SYNC
        run = min(len(good) if good.all() else int(good.argmin()), (len(raw) - at) // PACKET)
        found += range(at, at + run * PACKET, PACKET)
        at += run * PACKET
        if at == len(raw):
            break
        lost += 1
        if raw[at] == SYNC:  # the last packet is cut
            break
        if steady(at + PACKET):  # one packet without its sync byte
            at += PACKET
            continue
        later = syncs[np.searchsorted(syncs, at - PACKET + 1 if found else at) :].tolist()
        at = next((p for p in later if steady(p)), len(raw))
        if found and run and at < len(raw) and (at - found[-1]) % PACKET:
            found.pop()  # bytes are missing or added in it
    return np.array(found, np.int64), lost


def sections(packets: list[tuple[bool, bytes]], report: Report) -> Iterator[tuple[int, bytes]]:
    """Table id and body of each whole section with a right checksum. packets: whether one opens a section, and its payload."""
    held = None
    for opens, payload in packets:
        parts = [payload]
        if opens:
            start = 1 + payload[0] if payload else 0
            parts = [payload[1:start], payload[start:]]
        for k, part in enumerate(parts):
            if k:
                report.bad_tables += held is not None  # the one before was not whole
                held = b""
            while held is not None:
                held, part = held + part, b""
                size = 3 + (struct.unpack_from(">H", held, 1)[0] & 0xFFF) if len(held) >= 3 else PACKET
                if held[:1] == b"\xff":
                    held = None
                elif len(held) < size:
                    break
                elif size < 12 or crc32_mpeg(held[:size]):
                    report.bad_tables += 1
                    held = None
                else:
                    yield held[0], held[8 : size - 4]
                    held = held[size:] or None
    report.bad_tables += held is not None


def elementary(report: Report, raw: np.ndarray, at: np.ndarray, opens: np.ndarray, start: np.ndarray) -> bytes:
    """The payload of the PES packets in these transport packets of one stream; stamps, points and faults go to the report. raw: a row for each packet; at: its position."""
    payload = start < PACKET
    marked = (raw[:, 3] & 0x20 > 0) & (raw[:, 4] > 0)
    fresh = marked & (raw[:, 5] & 0x80 > 0)  # says that its counter starts anew
    raw, at, opens, start, marked, fresh = (x[payload] for x in (raw, at, opens, start, marked, fresh))
    counters = raw[:, 3].astype(np.int32) & 15
    step = np.diff(counters, prepend=counters[:1] - 1) % 16
    same = step == 0
    for i in np.flatnonzero(same).tolist():  # only an equal packet is a repeated one
        same[i] = i > 0 and raw[i, 4:].tobytes() == raw[i - 1, 4:].tobytes()
    jumped = (step != 1) & ~same & ~fresh
    report.repeats, report.jumps = report.repeats + int(same.sum()), report.jumps + int(jumped.sum())
    stay = np.flatnonzero(~same)
    bodies = [raw[i, a:].tobytes() for i, a in zip(stay.tolist(), start[stay].tolist())]
    starts, breaks = np.flatnonzero(opens[stay]).tolist(), np.flatnonzero(jumped[stay]).tolist()
    report.broken += bool(len(stay)) and (not starts or starts[0] > 0)
    parts = []
    for a, b in zip(starts, [*starts[1:], len(stay)]):
        stop = next((j for j in breaks if a < j < b), b) if breaks else b
        lost = stop < b or b < len(stay) and b in breaks
        pes = b"".join(bodies[a:stop])
        size = struct.unpack_from(">H", pes, 4)[0] if len(pes) >= 9 and pes[:3] == b"\0\0\1" else -1
        whole = 9 + pes[8] <= len(pes) and (len(pes) >= size + 6 if size > 0 else not lost) if size >= 0 else False
        if not whole:
            report.broken += 1
            continue
        ticks = 0
        if pes[7] & 0x80 and len(pes) >= 14:
            t = pes[9:14]
            ticks = (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1
            report.stamps.append(ticks)
        i = stay[a]
        if marked[i] and raw[i, 5] & 0x40:
            report.points.append((ticks, int(at[i])))
        parts.append(pes[9 + pes[8] : size + 6 if size else len(pes)])
    return b"".join(parts)


def read(stream: bytes) -> Report:
    """What a transport stream holds."""
    out = Report()
    data = np.frombuffer(stream, np.uint8)
    at, out.lost_sync = places(data)
    out.packets = len(at)
    if not len(at):
        return out
    aligned = len(at) * PACKET == len(data)
    raw = data.reshape(-1, PACKET) if aligned else data[at[:, None] + np.arange(PACKET)]
    damaged = raw[:, 1] & 0x80 > 0  # the sender says so
    if damaged.any():
        out.lost_sync += int(damaged.sum())
        raw, at = raw[~damaged], at[~damaged]
    pid = (raw[:, 1].astype(np.int32) & 0x1F) << 8 | raw[:, 2]
    opens, control = raw[:, 1] & 0x40 > 0, raw[:, 3] >> 4 & 3
    start = np.where(control >= 2, 5 + raw[:, 4].astype(np.int32), 4)
    start = np.where(control & 1 > 0, np.minimum(start, PACKET), PACKET)

    def table(of: int, table_id: int) -> Iterator[bytes]:
        own = np.flatnonzero((pid == of) & (start < PACKET)).tolist()
        return (body for number, body in sections([(bool(opens[i]), raw[i, start[i] :].tobytes()) for i in own], out) if number == table_id)

    maps = {x & 0x1FFF: None for body in table(PAT_PID, 0) for number, x in struct.iter_unpack(">HH", body[: len(body) // 4 * 4]) if number}
    wanted: dict[int, None] = {}
    for of in maps:
        for body in table(of, 2):
            i = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF) if len(body) >= 4 else len(body)
            while i + 5 <= len(body):
                number, more = struct.unpack_from(">HH", body, i + 1)
                wanted[number & 0x1FFF] = None
                i += 5 + (more & 0xFFF)
    for number in wanted:
        own = pid == number
        out.streams[number] = elementary(out, raw[own], at[own], opens[own], start[own])
    out.payload = next(iter(out.streams.values()), b"")
    return out


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stream of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, media binary")


INDEXED = "payload binary, packets long, lost_sync long, bad_tables long, jumps long, repeats long, broken long, stamps array<long>, points array<struct<pts: long, position: long>>"
NAMES = ("payload", "packets", "lost_sync", "bad_tables", "jumps", "repeats", "broken", "stamps", "points")


def report_columns(found: list[Report]) -> list[pa.Array]:
    """The columns of INDEXED."""
    numbers = [pa.array([getattr(r, c) for r in found], pa.int64()) for c in ("packets", "lost_sync", "bad_tables", "jumps", "repeats", "broken")]
    points = pa.array([[{"pts": t, "position": p} for t, p in r.points] for r in found], pa.list_(pa.struct([("pts", pa.int64()), ("position", pa.int64())])))
    return [pa.array([r.payload for r in found], pa.binary()), *numbers, pa.array([r.stamps for r in found], pa.list_(pa.int64())), points]


def decode(media: DataFrame) -> DataFrame:
    """media (a column of streams, beside others) with what reading each stream gives."""
    others = [c for c in media.columns if c not in NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x or b"") for x in batch.column(batch.schema.get_field_index("media")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *report_columns(found)], names=[*others, *NAMES])

    kinds = dict(media.dtypes)
    return common.python(media.select(*others), run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", " + INDEXED)


def stored_and_read(docs: DataFrame) -> DataFrame:
    """The streams of all texts, written to the shared folder, and what reading them from there gives."""
    return decode(common.stored(encode(docs), "media"))


def op5_media_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = stored_and_read(common.read(spark, sf_dir, "documents"))
    points = F.concat_ws(",", F.transform("points", lambda p: F.concat_ws("@", p["pts"].cast("string"), p["position"].cast("string"))))
    feature = F.concat_ws(";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("frames="), F.size("stamps")), F.concat(F.lit("pts="), F.array_min("stamps"), F.lit("-"), F.array_max("stamps")), F.concat(F.lit("points="), points), F.concat(F.lit("faults="), F.col("lost_sync") + F.col("bad_tables") + F.col("jumps") + F.col("repeats") + F.col("broken")))
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


