"""Valid-time sales against the rules batch by batch, vector codes against all distances, pair-tree BPE against the library."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


# Valid-time sales


def by_the_rules(sales, changes, batches):
    """sales: (batch, id, client, at); changes: (batch, id, client, at, amount, op). Rows as enriched() gives them."""
    order = lambda v: (v[3], v[1] is not None, v[1] or 0, v[4] is not None, v[4] or 0, v[5] is not None, v[5] or "")
    out, waiting, held = [], [], {}
    top = {"s": None, "c": None}
    for b in range(batches + 1):
        h = None if None in top.values() else min(top.values())
        fresh = [c for c in changes if c[0] == b]
        for c in fresh:
            if top["c"] is not None and c[3] < top["c"]:
                out.append(("late", c[1], b, None, None, None, None))
            elif c[2] is not None:
                held.setdefault(c[2], []).append(c)
        new = [s for s in sales if s[0] == b]
        waiting += new
        leaves = [s for s in waiting if s[3] is None or b == batches or h is not None and s[3] < h]
        waiting = [s for s in waiting if s not in leaves]
        for s in leaves:
            own = held.get(s[2], []) if s[2] is not None else []
            fit = [v for v in own if s[3] is not None and v[3] <= s[3]]
            v = max(fit, key=order) if fit else (None,) * 6
            out.append(("sale", s[1], b, len(own), v[1], v[4], v[5]))
        if h is not None:
            for client, own in held.items():
                past = sorted((v for v in own if v[3] <= h), key=order)
                held[client] = [v for v in own if v[3] > h] + past[-1:]
        for k, rows in (("s", new), ("c", fresh)):
            top[k] = max((x[3] for x in rows if x[3] is not None), default=top[k]) if top[k] is None else max([top[k], *(x[3] for x in rows if x[3] is not None)])
    return sorted(out, key=str)


def made(seed, batches=4, n=400):
    """Rows of skewed clients, with times to the microsecond and many ties, late rows, nulls and repeats."""
    rng = random.Random(seed)
    sales, changes = [], []
    for i in range(n):
        b = rng.randrange(batches)
        if b == 2:  # an almost empty batch
            b = 3
        at = 1_700_000_000_000_000 + (b - rng.choice([0, 0, 0, 1, 2])) * 1000 + rng.randrange(0, 1000, rng.choice([1, 250]))
        client = rng.choice([0, 0, 0, 1, rng.randrange(40), None])
        if rng.random() < 0.5:
            sales.append((b, rng.choice([i, i, None]), client, at if rng.random() < 0.95 else None))
        else:
            changes.append((b, rng.choice([i, i % 7, None]), client, at, rng.choice([1, 2, None]), rng.choice(["U", "D", None])))
    return sales + sales[:5], [*dict.fromkeys(changes)]


SALE, CHANGE = "batch int, id long, client long, at long", "batch int, id long, client long, at long, amount long, op string"


def streamed(spark, sales, changes, **options):
    from clademill.llm import valid_time

    s = spark.createDataFrame([(*r, "x") for r in sales], SALE + ", mark string")  # a column of a name that is used within
    c = spark.createDataFrame([(*r, 1) for r in changes], CHANGE + ", slot int")
    return sorted(map(tuple, valid_time.enriched(s, c, 4, **options).collect()), key=str)


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"hot_rows": 12, "bucket_rows": 20})])
def test_sales_by_the_rules(spark, seed, options):
    sales, changes = made(seed)
    found = streamed(spark, sales, changes, **options)
    want = by_the_rules(sales, changes, 4)
    assert len(want) > len(sales) and any(r[0] == "late" for r in want) and any(r[0] == "sale" and r[3] > 3 for r in want)
    assert found == want


def test_sales_without_changes(spark):
    sales, _ = made(3, n=60)
    assert streamed(spark, sales, []) == by_the_rules(sales, [], 4)


def test_no_sales(spark):
    _, changes = made(4, n=60)
    assert streamed(spark, [], changes) == by_the_rules([], changes, 4)


def test_batches_of_days(spark):
    from clademill.llm import valid_time

    days = spark.createDataFrame([(19722,), (19723,), (19735,), (19736,), (19874,), (30000,), (None,)], "d int")
    assert [r[0] for r in days.select(valid_time.batch_of(F.col("d"))).collect()] == [0, 0, 0, 1, 11, 11, 11]
    crc = duckdb.sql(valid_time.OP11_SQL.split(",\nd AS")[0] + " SELECT xor(list_reduce(list_prepend(4294967295, list_transform(string_split('123456789', ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) FROM t").fetchall()[0][0]
    assert crc == 0xCBF43926


# Pair-tree BPE


def test_pair_tree_is_the_library():
    from tokenizers import Tokenizer

    from clademill.llm import pair_bpe

    path, rng = P.path("word_bpe_49k.json"), random.Random(5)
    own, library = pair_bpe.TreeIds(path), Tokenizer.from_file(path)
    letters = "aAbB sStTeE'1 2é中ßΣςİ\t\n-<|>!😀ǅﬁ́ẛ\x1c\x85\xa0한국"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["It's <|endoftext|>x<|STARTOFTEXT|> <|startoftext|>a", "  ", "", "<|endoftext|><|endoftext|>", "<|endoftext"]
    texts += ["ab" * 5000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "中" * 3000, *("".join(rng.choice("aeinrst") for _ in range(n)) for n in range(1, 70))]
    for text in texts:
        ids = np.frombuffer(own.text(text), "<u4").tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want and own.string(ids) == library.decode(want, skip_special_tokens=False)


def test_pair_tree_of_odd_rows(spark):
    from tokenizers import Tokenizer

    from clademill.llm import pair_bpe

    path = P.path("word_bpe_49k.json")
    rows = [(1, None, "z"), (2, "", "z"), (2, "", "z"), (None, "Some <|endoftext|> words", "z"), (3, "x" * 200_000, "z"), (-1, " \n\t ", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = Tokenizer.from_file(path)
    found = pair_bpe.decoded(pair_bpe.encoded(frame, path), path)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in found.collect()), key=str) == sorted(((i, ids, library.decode(ids, skip_special_tokens=False)) for i, ids in want), key=str)
    assert pair_bpe.encoded(frame.where("false"), path).count() == 0
    own = pair_bpe.op12_pair_tree_bpe(spark, SF).where("doc_id < 20").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20").collect()}
    for r in own:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))))


# Vector codes


def all_distances(rows, parts, entries, rounds):
    """(row, code, error) of the kept rows, and the codebooks. rows: (vec_id, vector)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    v = {i: np.array([int(np.floor(np.float64(np.float32(x)) * 256)) for x in r[1]]).reshape(parts, -1) for i, r in enumerate(kept)}
    first = sorted(v, key=lambda i: (kept[i][0] is None, kept[i][0] or 0, v[i].ravel().tolist()))[:entries]
    books = np.stack([v[i] for i in first], 1)
    every = np.stack([*v.values()])

    def near():
        return ((every[:, :, None] - books[None]) ** 2).sum(3)

    for _ in range(rounds):
        code, old = near().argmin(2), books.copy()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = every[code[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(0)]
        del old
    d = near()
    return [(kept[i][0], bytes(d[n].argmin(1).astype(np.uint8)), int(d[n].min(1).sum())) for n, i in enumerate(v)], books


@pytest.mark.parametrize("entries, rounds, block", [(8, 2, 37), (64, 3, 4096), (200, 1, 50)])
def test_codes_are_the_nearest(spark, entries, rounds, block):
    from clademill.llm import vector_codes

    rng = np.random.default_rng(entries)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.2, 8), rng.choice([1, 3]))], int(rng.integers(0, 3)), "x") for i in rng.permutation(160)]
    rows += [(500, rows[0][1], 1, "x")] * 60 + [(None, rows[1][1], None, "x"), (3, rows[2][1], 2, "x")]  # many copies, ids that are null or repeated
    rows += [(600, None, 1, "x"), (601, [0.1] * 7 + [None], 1, "x"), (602, [float("nan")] * 8, 1, "x"), (603, [float("-inf")] + [0.0] * 7, 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(3)
    codes, books = vector_codes.coded(frame, 4, entries, rounds, block)
    want, want_books = all_distances([r[:2] for r in rows], 4, entries, rounds)
    assert (books == want_books).all()
    assert sorted(((r.vec_id, bytes(r.codes), r.error) for r in codes.collect()), key=str) == sorted(want, key=str)


def test_whole_subtrees_are_assigned():
    from clademill.llm import vector_codes

    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 3, (500, 4)) for c in (-100, 0, 100)]).astype(np.int64)
    tree, book = vector_codes.Tree(points), np.array([[-100] * 4, [0] * 4, [100] * 4, [0] * 4])
    whole = sum(len(nodes) for level, nodes, _ in tree.filtered(book) if level <= tree.depth)
    single = sum(len(nodes) for level, nodes, _ in tree.filtered(book) if level > tree.depth)
    assert 0 < whole < 60 and single < 30 and (tree.assigned(book) == np.repeat([0, 1, 2], 500)).all()
    counts, sums = tree.totals(book)
    assert counts.tolist() == [500, 500, 500, 0] and (sums[:3] == points.reshape(3, 500, 4).sum(1)).all()


def test_codes_of_odd_tables(spark):
    from clademill.llm import vector_codes

    kind = "vec_id long, embedding array<float>, label int"
    codes, books = vector_codes.coded(spark.createDataFrame([], kind))
    assert codes.count() == 0 and books.size == 0
    codes, books = vector_codes.coded(spark.createDataFrame([(1, [], 0), (2, None, 0)], kind))
    assert [(r.vec_id, bytes(r.codes), r.error) for r in codes.collect()] == [(1, bytes(16), 0)]
    for bad in ([[0.5] * 3], [[0.5] * 16, [0.5] * 32], [[1e9] * 16]):
        with pytest.raises(Exception, match="length|beyond"):
            vector_codes.coded(spark.createDataFrame([(i, v, 0) for i, v in enumerate(bad)], kind))[0].collect()


def test_codes_sql(spark):
    from clademill.llm import vector_codes

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({vector_codes.OP13_SQL})").fetchall()
    assert sorted(map(tuple, vector_codes.op13_vector_codes(spark, SF).select(*names).collect())) == sorted(want)
