"""Byte-level BPE as a monoid over texts: encode halves, join neighbours; decoding concatenates up the tree.

Where two texts meet, a window around the place is encoded again, and it grows until nothing outside can change. There are
two proofs of that. A fence is a place where every match of the pattern ends, whatever stands further off; a window
between fences is encoded as a text. Where one match goes on beyond both sides of the window, as in writing without
blanks, the window is made of tokens: a sequence of tokens is the encoding of its bytes exactly if each two neighbours are
the encoding of theirs, so the window has grown enough when its outer tokens and those beside them pass that test.
Windows are thus bounded by fences or by a few tokens, not by the text. The fences hold for public_tokenizers.PATTERN;
with another pattern texts are encoded in one piece.

Null and empty texts have no ids and decode to no bytes. Equal rows give equal results. An empty table gives an empty
result. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAF, WINDOW, REACH, MARGIN = 4096, 64, 256, 12
# Characters of which all libraries know whether they are letters, numbers or neither, in fixed ranges of Unicode. The
# apostrophe is left out, as it joins letters in some matches.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿΑ-ΡΣ-ωЀ-ҁא-תء-غف-يぁ-ゖァ-ヺ一-龥가-힣"
NUMBERS = "0-9"
MARKS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~、。，！？「」"
CLASSES = [re.compile(f"[{c}]+") for c in (LETTERS, NUMBERS, MARKS)]
#: A place where every match ends, whatever stands further off: between characters of two of these classes, and white space
#: after something that no library takes for white space. No match of the pattern holds either.
FENCE = re.compile(rf"[{LETTERS}](?=[{NUMBERS}{MARKS}])|[{NUMBERS}](?=[{LETTERS}{MARKS}])|[{MARKS}](?=[{LETTERS}{NUMBERS}])|[^\s\x1c-\x1f\x85᠎](?=[ \n])")
_held: dict[tuple[str, str], Codec] = {}


class Codec:
    """The ranks of a file and the pattern that splits texts before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = lru_cache(65_536)(lambda raw: tuple(self.own._core_bpe.encode_single_piece(raw)))
        self.leaf_size = LEAF if pattern == public_tokenizers.PATTERN else float("inf")
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def leaf(self, text: str) -> array:
        return array("I", self.own.encode_ordinary(text))

    def join(self, left: str, left_ids: array, right: str, right_ids: array) -> array:
        """The ids of left + right."""
        if not left or not right:
            return left_ids + right_ids
        kind = next((k for k in CLASSES if k.match(left, len(left) - 1)), None)
        if kind and kind.match(right):
            out = self.stitched(left, left_ids, right, right_ids, kind)
            if out is not None:
                return out
        return self.between_fences(left, left_ids, right, right_ids)

    def between_fences(self, left: str, left_ids: array, right: str, right_ids: array) -> array:
        """The windows grow until each ends at a fence; beyond the fences no id can change."""
        size = WINDOW
        while True:
            at = [m.end() for m in FENCE.finditer(left, max(0, len(left) - size))]
            if at or size >= len(left):
                start = at[-1] if at else 0
                break
            size *= 2
        fence = FENCE.search(right)
        stop = fence.end() if fence else len(right)
        before, after = left[start:], right[:stop]
        kept = left_ids[: len(left_ids) - len(self.leaf(before))]
        return kept + self.leaf(before + after) + right_ids[len(self.leaf(after)) :]

    def stitched(self, left: str, left_ids: array, right: str, right_ids: array, kind: re.Pattern) -> array | None:
        """Inside one match: the windows grow by tokens until their outer tokens fit those beside them. None if the match's ends aren't certain."""
        a = b = 4
        reach = REACH
        while True:
            rooms = self.room_before(left, kind, reach), self.room_after(right, kind, reach)
            if None in rooms:
                return None
            (before, from_start), (after, to_end) = rooms
            while True:
                i, one, whole_left = self.taken(left_ids, before, from_start, a, -1)
                j, two, whole_right = self.taken(right_ids, after, to_end, b, 1)
                if i is None or j is None:
                    break
                window = array("I", self.own._core_bpe.encode_single_piece(one + two))
                fits_left = whole_left or self.fits(left_ids[len(left_ids) - i - 1], window[0])
                fits_right = whole_right or self.fits(window[-1], right_ids[j])
                if fits_left and fits_right:
                    return left_ids[: len(left_ids) - i] + window + right_ids[j:]
                a, b = a * (1 if fits_left else 2), b * (1 if fits_right else 2)
            if reach > len(left) + len(right):
                return None
            reach *= 4

    def taken(self, ids: array, room: int, exact: bool, n: int, step: int) -> tuple[int | None, bytes, bool]:
        """The n last (step -1) or first (step 1) ids' number and bytes, and whether they are all of the match; None if there's no room for them and one more."""
        parts, size, whole = [], 0, False
        for k in range(n + 1):
            if exact and size == room:
                whole = True
                break
            if k >= len(ids):
                return None, b"", False
            part = self.bytes_of[ids[k if step > 0 else -k - 1]]
            size += len(part)
            if size > room:
                return None, b"", False
            parts.append(part)
        parts = parts if whole else parts[:n]
        return len(parts), b"".join(parts if step > 0 else parts[::-1]), whole

    def fits(self, one: int, two: int) -> bool:
        return self.piece(self.bytes_of[one] + self.bytes_of[two]) == (one, two)

    @staticmethod
    def room_before(left: str, kind: re.Pattern, reach: int) -> tuple[int, bool] | None:
        """Bytes at the end of left that are surely of its last match, and whether they are all of it."""
        k = max(0, len(left) - reach)
        run = next(m for m in kind.finditer(left, k) if m.end() == len(left))
        k, run = run.start(), run[0]
        if len(run) == reach and k:
            return max(0, len(run.encode()) - MARGIN), False
        if not k or left[k - 1] in "\n\t\r" or any(c.match(left, k - 1) for c in CLASSES):
            return len(run.encode()), True
        return (len(run.encode()) + 1, True) if left[k - 1] == " " else None

    @staticmethod
    def room_after(right: str, kind: re.Pattern, reach: int) -> tuple[int, bool] | None:
        """Bytes at the start of right that are surely of its first match, and whether they are all of it."""
        run = kind.match(right, 0, reach)[0]
        k = len(run)
        if k == reach and k < len(right):
            return max(0, len(run.encode()) - MARGIN), False
        if k == len(right) or right[k] in " \n\t\r" or any(c.match(right, k) for c in CLASSES):
            return len(run.encode()), True
        return None

    def encode(self, text: str) -> array:
        if len(text) <= self.leaf_size:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def decode(self, ids: array) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def held(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _held:
        _held[path, pattern] = Codec(path, pattern)
    return _held[path, pattern]


def packed(ids: array) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    if ids.itemsize != 4:
        raise ValueError("ids need 32-bit items")
    out = array("I", ids)
    if memoryview(b"\1\0").cast("H")[0] != 1:
        out.byteswap()
    return out.tobytes()


def unpacked(blob: bytes) -> array:
    out = array("I")
    out.frombytes(blob)
    if memoryview(b"\1\0").cast("H")[0] != 1:
        out.byteswap()
    return out


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (binary) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(path, pattern)
        for batch in batches:
            ids = [packed(codec.encode(t)) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return common.python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(path, pattern)
        for batch in batches:
            texts = [codec.decode(unpacked(b or b"")) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return common.python(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids and the bytes decoded from these ids, in one pass: half the workers of encode() and decode() in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(path, pattern)
        for batch in batches:
            ids = [packed(codec.encode(t)) if t else b"" for t in batch.column(1).to_pylist()]
            texts = [codec.decode(unpacked(b)) for b in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return common.python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids binary, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = round_trip(common.read(spark, sf_dir, "documents"), path)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
