"""BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A word's symbols stand in the leaves of a tree, each leaf with the rank of the merge that joins it to the next symbol.
Every node holds the least rank below it with its leftmost place, so the root names the next merge; a merge changes three
leaves and the nodes above them. A lowest node has up to WIDE leaves, so that the tree of a short word is its root. When no pair can be merged the symbols are the word's ids. A word of n symbols takes
n log n steps, however long it is. Normalisation and the split into words are the tokenizer's own; workers remember the
ids of their words. Decoding looks the ids up and joins their strings with a space, as a tokenizer without a decoder does.

The strings of added tokens in a text give those tokens; a null or empty text, or one of white space alone, gives no id
and decodes to an empty text. Very long words and texts are encoded whole. Equal rows stay rows of their own, a null id
stays null, an empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Rank and id of a pair that no merge joins.
NONE = (1 << 29, -1)
#: Leaves of a lowest node.
WIDE = 16
#: Ids in a batch on their way from Python, which a single text may pass.
BATCH = 1 << 20
REMEMBERED = 350_000


class Id(NamedTuple):
    id: int


class Merges:
    """The merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocabulary, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ids = [*map(Id, range(max(self.vocabulary.values()) + 1))]
        #: (left id, right id) -> rank, id of both
        self.merges = {(self.vocabulary[a], self.vocabulary[b]): (rank, self.vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}

    def encode(self, letters: str) -> list[int]:
        """Ids of a word given in the byte-level alphabet."""
        ids = [self.vocabulary[c] for c in letters[:-1]]
        ids.append(self.vocabulary[letters[-1] + self.end])
        n, found = len(ids), self.merges.get
        if n <= WIDE:
            return self.in_one_node(ids)
        size = 1 << (n - 1).bit_length()
        never = NONE[0] * size
        # A leaf is rank * size + place, so the lesser of two is the leftmost of the lower rank; leaf i joins the symbol at i to the next.
        leaves = [found(pair, NONE)[0] * size + i for i, pair in enumerate(zip(ids, ids[1:]))]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        nodes = 1 << (-(-n // WIDE) - 1).bit_length()
        tree = [never] * (2 * nodes)  # node 1 is the root, node nodes + k holds the leaves from k * WIDE
        for k in range(-(-(n - 1) // WIDE)):
            tree[nodes + k] = min(leaves[k * WIDE : (k + 1) * WIDE])
        for k in range(nodes - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, leaf: int) -> None:
            leaves[i] = leaf
            k = i // WIDE
            least = min(leaves[k * WIDE : (k + 1) * WIDE])
            k += nodes
            while tree[k] != least:
                tree[k] = least
                if k == 1:
                    return
                least = min(least, tree[k ^ 1])
                k >>= 1

        while tree[1] < never:
            i = tree[1] % size
            gone = after[i]
            ids[i] = here = found((ids[i], ids[gone]))[1]
            ids[gone] = -1
            after[i] = j = after[gone]
            h = before[i]
            if j < n:
                before[j] = i
            if gone < n - 1:
                put(gone, never)
            put(i, found((here, ids[j]), NONE)[0] * size + i if j < n else never)
            if h >= 0:
                put(h, found((ids[h], here), NONE)[0] * size + h)
        return [x for x in ids if x >= 0]

    def in_one_node(self, ids: list[int]) -> list[int]:
        """The same where all leaves are in one node, so that they can close up."""
        found = self.merges.get
        leaves = [found(pair, NONE)[0] for pair in zip(ids, ids[1:])]
        while leaves and (low := min(leaves)) < NONE[0]:
            i = leaves.index(low)
            here = found((ids[i], ids[i + 1]))[1]
            del ids[i + 1], leaves[i]
            ids[i] = here
            if i:
                leaves[i - 1] = found((ids[i - 1], here), NONE)[0]
            if i < len(leaves):
                leaves[i] = found((here, ids[i + 1]), NONE)[0]
        return ids

    def tokenize(self, letters: str) -> list[Id]:
        """encode() in the form of the library's models."""
        return [*map(self.ids.__getitem__, self.encode(letters))]


class TreeIds(tokens.Ids):
    """Ids of whole texts, each word's by the tree."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__(path, True, remembered)
        self.merges = Merges(path)
        self.words = tokens.Words(self.merges)
        self.id_of = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.id_of, key=len, reverse=True))) + ")").split if self.id_of else lambda text: [text]
        ids = self.merges.vocabulary | self.id_of
        self.strings = [""] * (max(ids.values()) + 1)
        for string, i in ids.items():
            self.strings[i] = string

    def whole(self, text: str) -> bytes:
        ids = []
        for part in self.parts(text):
            if part in self.id_of:
                ids.append(self.id_of[part])
            else:
                for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    ids += self.merges.encode(letters)
        return struct.pack(f"<{len(ids)}I", *ids)

    def string(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_held: dict[str, TreeIds] = {}


def held(path: str) -> TreeIds:
    """One for each worker process and file."""
    if path not in _held:
        _held[path] = TreeIds(path)
    return _held[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held(path).text

        def out(own: list[int | None], blobs: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, blobs)]) // 4
            values = np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["doc_id", "ids"])

        for batch in batches:
            own, blobs, size = [], [], 0
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                blob = of(text)
                if own and size + len(blob) > 4 * BATCH:
                    yield out(own, blobs)
                    own, blobs, size = [], [], 0
                own.append(doc)
                blobs.append(blob)
                size += len(blob)
            if own:
                yield out(own, blobs)

    return common.python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string = held(path).string
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy().tolist(), ids.offsets.to_pylist()
            texts = [string(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return common.python(ids.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string")


def op12_pair_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = decoded(encoded(common.read(spark, sf_dir, "documents"), path), path)
    shown = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
