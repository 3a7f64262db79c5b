"""Each text operator against a plain version, on the supplied documents and on odd rows."""

import base64
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor, sit\n" * 4000 + "x" * 30_000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Same line\nother 1"), (6, "same LINE \nother 2"), (7, LONG), (7, LONG), (8, "é ß ü 😀 中文字 é"), (None, "Same line\nwith a null id"),
    (9, "one two three four five six seven"), (10, "one two three four five six seven"), (-3, "tab\tand\x0bvertical\x85next\x1cfile  end  "), (11, "a@b.co, +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.1"),
]
EXTRA = "part int, rank string, score int, kept string, base string, spans int, n_lines string, sequence_id string, node string, h1 string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), *[0 if "int" in c else "z" for c in EXTRA.split(", ")]) for i, t in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id = 12345678")


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def test_word_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    from clademill.llm import tokens

    more = [*texts.values(), *(t or "" for _, t in ODD), "It's WE'LL a\xa0b  c\n\n d\t e²3½ <|endoftext|>", "end <|endoftext|> of <|ENDOFTEXT|>x<|startoftext|>", "İstanbul ǅ ﬁ ﷺ ẞ Σς", "'s'S 1 22", "  \n ", "\x7f\x80"]
    for name, by_word in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        ids, own = tokens.Ids(P.path(name), by_word), Tokenizer.from_file(P.path(name))
        assert all(ids.text(t) == u32(own.encode(t, add_special_tokens=False).ids) for t in more)


def plan_is_sound(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs, odd, none, texts):
    from clademill.llm import packing, tokens

    path = P.path("byte_bpe_50k.json")
    ids = tokens.held(path)
    for frame, source in ((docs, [*texts.items()]), (odd, ODD)):
        rows = packing.pack_documents(frame, path).collect()
        whole = collections.Counter((d, ids.text(t) + u32([0])) for d, t in source)
        found = collections.defaultdict(list)
        for r in rows:
            found[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        for (d, blob), n in whole.items():
            own = sorted(x for x in found[d])[:: n if n > 1 else 1]
            assert b"".join(x[3] for x in own) == blob and [x[1] for x in own] == np.cumsum([0, *(x[2] for x in own)])[:-1].tolist()
            assert all(x[2] == 2048 for x in own[1:])
        n = plan_is_sound(rows, 2048)
        assert n <= 1.03 * -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(none, path).count() == 0


def test_best_two_fit():
    from clademill.llm.packing import best_two_fit

    assert best_two_fit({}) == []
    # greedy fills 10 with 6 and 3; 2 and 2 fill the gap of 3 better
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
    rng = np.random.default_rng(1)
    counts = dict(collections.Counter(rng.integers(1, 300, 5000).tolist()))
    plan = best_two_fit(counts, 512)
    used = collections.Counter()
    for bin_, n in plan:
        assert sum(bin_) <= 512
        used.update({k: v * n for k, v in collections.Counter(bin_).items()})
    assert used == counts
    assert sum(n for _, n in plan) <= 1.01 * sum(k * v for k, v in counts.items()) / 512 + 1


def test_byte_bpe(spark, docs, odd, none, texts):
    import tiktoken

    from clademill.llm import byte_bpe

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame in (docs, odd):
        for r in byte_bpe.decode(byte_bpe.encode(frame, path), path).join(frame.select("doc_id", "text").distinct(), "doc_id").where("doc_id <> 7 or doc_id is null").collect():
            assert bytes(r.ids) == u32(own.encode_ordinary(r.text or "")) and bytes(r.decoded) == (r.text or "").encode()
    codec = byte_bpe.held(path, P.PATTERN)
    rng = np.random.default_rng(0)
    for _ in range(300):  # joins at every kind of place
        text = "".join(rng.choice(list("ab '\n\tsl1é中.") + ["'ll", "  ", "word", "\x1c"], 60))
        k = int(rng.integers(0, len(text)))
        left, right = text[:k], text[k:]
        assert list(codec.join(left, codec.leaf(left), right, codec.leaf(right))) == own.encode_ordinary(text)
    assert list(codec.encode(LONG)) == own.encode_ordinary(LONG)
    assert byte_bpe.encode(none, path).count() == 0


def test_byte_bpe_without_blanks():
    """Joins inside one match: windows of tokens, never the whole text."""
    import time

    from clademill.llm import byte_bpe

    codec = byte_bpe.held(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(5)
    pieces = ["中文字", "'s", "'", "1", "23", ".", "é", "the", " word", "aaaa", "。", "Ж", "ا", "=", "😀", "ll", "  "]
    for t in range(3000):
        text = "".join(rng.choice(pieces, int(rng.integers(2, 40)))) if t % 3 == 0 else "".join(rng.choice(list("abcdeiorst"), int(rng.integers(2, 900)))) if t % 3 == 1 else str(rng.choice(["a", "ab", "中", "1", "=", " the", ".-"])) * int(rng.integers(2, 500))
        k = int(rng.integers(0, len(text) + 1))
        assert list(codec.join(text[:k], codec.leaf(text[:k]), text[k:], codec.leaf(text[k:]))) == codec.own.encode_ordinary(text)
    for text in ("".join(map(chr, rng.integers(0x4E00, 0x9FA5, 1_000_000))), "".join(rng.choice(list("abcdefghij"), 1_000_000)), "".join(rng.choice(list("ABCabc0123456789+/"), 1_000_000)), "a" * 300_000):
        begin = time.perf_counter()
        plain = codec.own.encode_ordinary(text)
        middle = time.perf_counter()
        assert list(codec.encode(text)) == plain
        assert time.perf_counter() - middle < 4 * (middle - begin) + 1


def dropped(source, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    count = collections.Counter(k for _, t in source for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in source:
        lines = (t or "").split("\n")
        stay = [x for x in lines if count[key(x)] < least]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def test_line_dedup(docs, odd, none, texts):
    from clademill.llm.line_dedup import drop_lines

    for frame, source in ((docs, [*texts.items()]), (odd, ODD)):
        for least in (2, 3, 10):
            for hot in (10**6, 3):  # with 3, most keys take the way of the rarer ones
                found = drop_lines(frame, least, hot, 50)
                assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str) == dropped(source, least)
    assert drop_lines(none).count() == 0
    assert drop_lines(odd, counts=False).columns == odd.columns


def test_rarer_lines_of_a_table_with_other_columns(odd):
    from clademill.llm.line_dedup import drop_lines

    rows = odd.select("doc_id", "text", F.lit("o").alias("own"), F.lit("g").alias("gone"))
    found = drop_lines(rows, 2, 3, 50)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str) == dropped(ODD, 2)
    assert {(r.own, r.gone) for r in found.collect()} == {("o", "g")}


def test_unique_lines_stay_where_they_are(spark, monkeypatch):
    """Of many lines, few of which go, only these and the filter's errors are asked for; copies of a text and shards are dealt."""
    from clademill.llm import common, line_dedup

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    shared = [f"shared line {k}" for k in range(40)]
    source = [(i, "\n".join([f"only {i} {k}" for k in range(20)] + [shared[(i + j) % 40] for j in range(2)])) for i in range(600)]
    source += [(1000 + i, "a copy\n" + shared[0] + "\nof one text") for i in range(300)]
    frame = spark.createDataFrame(source, "doc_id long, text string").repartition(8)
    counts = line_dedup.key_counts(frame).where("docs >= 10")
    mask, bits = line_dedup.bloom(counts, counts.count())
    asked = line_dedup.asking(frame.select(F.xxhash64("text").alias("own1"), F.xxhash64(F.lit(1), "text").alias("own2"), "text"), mask, bits)
    lines = asked.agg(F.sum(F.length("keys") / 16)).first()[0]
    assert 600 * 2 + 300 * 3 <= lines <= 600 * 2 + 300 * 3 + 0.01 * 600 * 20
    small = line_dedup.bloom(counts, 10**9, line_dedup.SLICE)
    assert len(small[1]) == line_dedup.SLICE // 8
    found = line_dedup.drop_lines(frame, 10, 3, 8)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str) == dropped(source, 10)
    more = line_dedup.with_rare(frame.select("doc_id", "text"), counts, 10, 8, counts.count(), 10)
    assert {len(r[0] or b"") for r in more.select("__gone").collect()} == {32, 48}


def test_perfect_hash():
    from clademill.llm.line_dedup import PerfectHash, Shard, build_shard

    rng = np.random.default_rng(2)
    first, second = (rng.integers(0, 2**63, 20_000).astype(np.uint64) for _ in range(2))
    assert sorted(PerfectHash.build(first).index(first).tolist()) == list(range(20_000))
    shard = Shard(*build_shard(first, second, np.arange(20_000)))
    assert shard.probe(first, second).tolist() == list(range(20_000))
    assert not shard.probe(rng.integers(0, 2**63, 1000).astype(np.uint64), second[:1000]).any() and not shard.probe(first[1:], second[:-1]).any()


def test_language(spark, docs, odd, none):
    from clademill.llm import common, language

    found = language.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    out = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert out.right > 0.98 and 0 <= out.low <= out.high <= 1
    filters = language.fit(docs, common.remainder("doc_id", 4) != 2)
    by = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(odd, filters).collect()}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] != "und" and language.predicted(none, filters).count() == 0
    assert {r.lang_pred for r in language.predicted(odd, language.fit(none, F.lit(True))).collect()} == {"und"}
    # more languages than fit one word of the masks
    many = language.Filters([f"l{k:03}" for k in range(70)], np.zeros((language.SLOTS, 2), np.uint64))
    for at in language.slots(language.grams("hello")):
        many.masks[at, 1] |= np.uint64(1 << 5)
    many.__post_init__()
    assert many.predict("hello")[0] == "l069"


def test_language_against_sets(docs, none):
    """Predictions by filters are those by plain sets of n-grams, up to the filters' errors."""
    from clademill.llm import common, language

    learn = common.remainder("doc_id", 4) != 2
    filters = language.fit(docs, learn, 10**9)
    rows = docs.withColumn("learn", learn).select("doc_id", "text", "lang", "learn").collect()
    seen = {k: collections.Counter() for k in filters.languages}
    for r in rows:
        if r.learn and r.text is not None:
            seen[r.lang].update(set(language.grams(r.text).tolist()))
    sizes = collections.Counter(r.lang for r in rows if r.learn and r.text is not None)
    known = {k: {g for g, n in c.items() if n >= max(min(language.MIN_DOCS, sizes[k]), int(language.MIN_SHARE * sizes[k]))} for k, c in seen.items()}
    every = np.array(sorted(set().union(*known.values())), np.uint64)
    for k, name in enumerate(filters.languages):  # no false negatives, and few false positives
        own = np.array(sorted(known[name]), np.uint64)
        assert filters.counts(own)[k] == len(own)
        others = every[~np.isin(every, own)]
        assert filters.counts(others)[k] <= (filters.false[k] + 0.01) * len(others) + 3
    same = []
    for r in rows:
        keys = language.grams(r.text).tolist()
        if keys:
            share = [sum(g in known[k] for g in keys) / len(keys) for k in filters.languages]
            if sorted(share)[-1] - sorted(share)[-2] > 0.02:
                same.append(filters.predict(r.text)[0] == filters.languages[int(np.argmax(share))])
    assert len(same) > 100 and all(same)


def test_transport(spark, docs, odd, none):
    from clademill.llm import transport

    frame = transport.FRAME
    for size in (64, 128, 160 * 64, 1024, frame, frame - 1, frame + 1, 31_936, 640_000):
        payload = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
        stream = transport.write(payload)
        report = transport.read(stream)
        assert len(stream) % 188 == 0 and report.payload == payload and not (report.jumps or report.repeats or report.broken or report.lost_sync or report.bad_tables)
        assert report.stamps == [k * 3600 for k in range(-(-size // frame))] and len(report.points) == -(-len(report.stamps) // transport.RAP)
        assert all(stream[p] == 0x47 and stream[p + 5] & 0x40 for _, p in report.points)
    assert transport.read(b"") == transport.Report() and transport.read(b"abc").lost_sync == 1
    back = {r.doc_id: bytes(r.payload) for r in transport.stored_and_read(odd).collect()}
    assert all(back[d] == transport.padded((t or "").encode()) for d, t in ODD) and back[2] == b"\0" * 64
    assert transport.decode(transport.encode(none)).count() == 0 and transport.stored_and_read(none).count() == 0


def packet(pid, counter, payload, opens=False, adaptation=None):
    """A packet by the book, apart from the operator's own writer."""
    head = bytes([0x47, (0x40 if opens else 0) | pid >> 8, pid & 255, (0x30 if adaptation is not None else 0x10) | counter % 16])
    body = bytes([len(adaptation)]) + adaptation if adaptation is not None else b""
    assert len(head + body + payload) == 188
    return head + body + payload


def test_streams_of_other_writers():
    from clademill.llm import transport

    rng = np.random.default_rng(9)
    bytes_ = lambda n: rng.integers(0, 256, n).astype(np.uint8).tobytes()

    def section(table, number, body):
        head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\0\0"
        return head + body + transport.crc32_mpeg(head + body).to_bytes(4, "big")

    pat = packet(0, 0, (b"\0" + section(0, 1, b"\0\1\xe1\0")).ljust(184, b"\xff"), True)
    # two streams, the second with descriptors so long that the section spans two packets
    entries = b"\x06\xe2\0\xf0\0" + b"\x1b\xe2\1\xf0\xd2" + b"\x05\xd0" + b"d" * 208
    whole = b"\0" + section(2, 1, b"\xe2\0\xf0\0" + entries)
    pmt = packet(0x100, 0, whole[:184], True) + packet(0x100, 1, whole[184:].ljust(184, b"\xff"))
    one, two = bytes_(500), bytes_(900)
    unbounded = b"\0\0\1\xe0\0\0\x80\0\0" + two  # a length of 0: up to the next start
    sized = b"\0\0\1\xbd" + (len(one) + 3).to_bytes(2, "big") + b"\x80\0\0" + one

    def cut(pid, pes, counter):
        out, k = [], 0
        while pes:
            part, pes = pes[:184], pes[184:]
            stuffing = None if len(part) == 184 else (b"\0" + b"\xff" * (182 - len(part)))[: 183 - len(part)]
            out.append(packet(pid, counter + k, part, k == 0, stuffing))
            k += 1
        return out

    a, b = cut(0x200, sized, 3), cut(0x201, unbounded, 0)
    mixed = b"".join(x for pair in itertools.zip_longest(a, b) for x in pair if x)
    report = transport.read(pat + pmt + mixed)
    assert report.streams == {0x200: one, 0x201: two} and report.payload == one and not (report.broken or report.jumps or report.bad_tables)
    # a counter that starts anew is no jump if the packet says so; the same counter with another payload is one
    again = packet(0x201, 9, b"\0\0\1\xe0\0\0\x80\0\0" + b"x" * 173, True, b"\x80")
    report = transport.read(pat + pmt + mixed + again)
    assert report.jumps == 0 and report.streams[0x201] == two + b"x" * 173
    report = transport.read(pat + pmt + mixed + packet(0x201, len(b) - 1, b"y" * 184))
    assert report.jumps == 1 and report.repeats == 0


def test_damaged_streams():
    from clademill.llm import transport

    payload = np.random.default_rng(1).integers(0, 256, 640_000).astype(np.uint8).tobytes()
    stream, frame = transport.write(payload), transport.FRAME
    whole = transport.read(stream)
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    two = stream[: 188 * 5] + stream[188 * 4 :]
    assert transport.read(two).repeats == 1 and transport.read(two).payload == payload

    def but(report, lost):
        return report.payload == b"".join(x for k, x in enumerate(frames) if k not in lost)

    lost = transport.read(stream[: 188 * 5] + stream[188 * 6 :])
    assert lost.jumps == 1 and lost.broken == 1 and but(lost, {0})
    # one bad sync byte: later positions stay
    bad = bytearray(stream)
    bad[188 * 5] ^= 1
    report = transport.read(bytes(bad))
    assert report.lost_sync == 1 and but(report, {0}) and report.points == [p for p in whole.points if p[0]]
    # a byte missing, or too many, in any place: what is whole elsewhere is found
    per = -(-len(stream) // 188 // len(frames))
    for at in (188 * 50 + 100, 188 * 700, len(stream) - 300, 188 * 50 + 1):
        for damaged in (stream[:at] + stream[at + 1 :], stream[:at] + b"G" * 7 + stream[at:], stream[:at] + stream[at + 188 * 3 + 77 :]):
            report = transport.read(damaged)
            missing = len(payload) - len(report.payload)
            assert report.lost_sync >= 1 and 0 <= missing <= 3 * frame, (at, report.lost_sync, missing)
            rest = report.payload
            for x in frames:  # what is left are whole frames in their order
                rest = rest[len(x) :] if rest.startswith(x) else rest
            assert not rest
    assert per >= 6
    for k in (0, 1):  # damaged tables are counted, and a stream without any has no payload
        bad = bytearray(stream)
        bad[188 * k + 15] ^= 1
        assert transport.read(bytes(bad)).bad_tables and transport.read(bytes(bad)).payload == b""
    error = bytearray(stream)
    error[188 * 6 + 1] |= 0x80
    assert but(transport.read(bytes(error)), {0}) or transport.read(bytes(error)).broken == 1


def base_rules(text):
    words = WORD.findall(text or "")
    count = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(again)


def test_rules(spark, docs, odd, none, texts):
    from clademill.llm import rules

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = rules.fit(docs, labels)
    for frame, source in ((docs, texts), (odd, dict(ODD))):
        for r in rules.judged(frame, forest).collect():
            own = base_rules(source[r.doc_id])
            assert own == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0]) and not (r.base_failed and r.kept)
    good = rules.judged(docs, forest).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert rules.kept_documents(odd, forest).columns == odd.columns
    empty = rules.fit(none, labels.where("doc_id < 0"))
    assert rules.judged(none, empty).count() == 0 and rules.judged(docs, rules.fit(docs, labels.where("doc_id < 0"))).where("not kept and not base_failed").count() == 0
    same = "a b c d e f g h "
    assert [rules.repeated(t.split()) for t in (b"", b"a b c d e f g h", (same * 2).encode(), (same + "x " + same).encode(), b"a " * 9)] == [0, 0, 16, 16, 9]
    assert rules.calibrated(np.array([0.1, 0.2, 0.3]), np.array([0.8, 0.9])) == pytest.approx(0.55)


def test_words_with_equal_sums(monkeypatch):
    """Windows are compared as such where their sums agree."""
    from clademill.llm import rules

    rng = np.random.default_rng(0)
    texts = [" ".join(map(str, rng.integers(0, 2, 60))) for _ in range(20)]
    expected = [base_rules(t)[4] for t in texts]
    assert [rules.repeated(t.encode().split()) for t in texts] == expected
    monkeypatch.setattr(rules, "POWERS", np.zeros(rules.WINDOW, np.uint64))
    assert [rules.repeated(t.encode().split()) for t in texts] == expected


def test_forest_against_a_plain_version(spark):
    from clademill.llm import common, rules

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    forest = rules.Forest.fit(x, x, trees=30, rows=64)

    def path(node, row, d=0):
        f = forest.feature[node]
        return forest.value[node] if f < 0 else path(forest.left[node] + (row[f] >= forest.value[node]), row, d + 1)

    odd_rows = np.vstack([x[:40], rng.normal(size=(10, 4)) * 8])
    plain = [2 ** (-np.mean([path(r, row) for r in forest.roots]) / forest.usual) for row in odd_rows]
    assert np.allclose(plain, forest.score(odd_rows)) and np.mean(plain[40:]) > np.mean(plain[:40]) + 0.05
    harmonic = lambda n: sum(1 / k for k in range(1, n + 1))
    assert all(abs(rules.usual_path(n) - (2 * harmonic(n - 1) - 2 * (n - 1) / n)) < 0.03 for n in (50, 256))
    # the threshold comes from rows that the forest that scores them has not seen, and costs least among all
    good, bad = rng.normal(0.4, 0.05, 200), rng.normal(0.55, 0.05, 100)
    cost = lambda c: 50 * (good > c).mean() + (bad <= c).mean()
    best = rules.calibrated(good, bad)
    assert cost(best) <= min(cost(c) for c in np.concatenate([good, bad])) + 1e-12
    # recall of junk beyond the fixed rules, and good rows lost
    big = "/root/testdata/sf0.1"
    docs, labels = (common.read(spark, big, t) for t in ("documents", "labels"))
    found = rules.judged(docs, rules.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").select("kept", "quality").toPandas()
    assert (~found.kept[found.quality == 0]).mean() > 0.45 and found.kept[found.quality == 1].mean() > 0.995


def test_forest_of_all_labelled_rows(spark):
    """Bad rows that stand last by the hash of their id, after 4000 good ones, make the threshold; a table's threshold is that of its scores in arrays."""
    from pyspark.sql import functions as F

    from clademill.llm import rules

    n = 4600
    ids = spark.range(n)
    place = ids.orderBy(F.xxhash64("id"), "id").rdd.map(lambda r: r.id).collect()
    bad = {*place[4200:]}
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(("7" * int(m) if k in bad else "a" * int(m)) for m in rng.integers(1, 9, 30))) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(k, int(k not in bad)) for k in range(n)], "doc_id long, quality int")
    forest = rules.fit(docs, labels)
    assert np.isfinite(forest.threshold)
    found = rules.judged(docs, forest).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in found.collect()}
    assert kept[0] < 0.1 and kept[1] > 0.97
    again = rules.fit(docs.repartition(3), labels.repartition(5))  # however the rows are dealt
    assert again.threshold == forest.threshold and np.array_equal(again.value, forest.value)
    good, junk = np.round(rng.normal(0.4, 0.05, 900), 3), np.round(rng.normal(0.5, 0.05, 400), 3)
    scores = spark.createDataFrame([(float(x), True) for x in good] + [(float(x), False) for x in junk], "score double, good boolean")
    assert rules.cheapest(scores) == rules.calibrated(good, junk)


def near_brute(source, least=0.8):
    from clademill.llm.near_dups import shingles, similarity

    sets = [shingles(t) for _, t in source]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if similarity(sets[i], sets[j]) >= least and top(i) != top(j):
            root[top(i)] = top(j)
    return sets, [top(i) for i in range(len(sets))]


def test_near_dups(spark, docs, odd, none, texts):
    from clademill.llm import near_dups

    words = [f"w{i}" for i in range(120)]
    chain = [" ".join(words[k * 8 : k * 8 + 80]) for k in range(4)]  # neighbours are near, ends are not
    base = [f"v{i}" for i in range(200)]
    star = [" ".join(base[:i] + ["zzz"] + base[i + 1 :]) for i in range(0, 200, 9)]
    repeats = ["ab cd ef gh ij " * 40, "ab cd ef gh ij " * 42, "ab cd ef gh ij " * 10]
    made = spark.createDataFrame([(k, t) for k, t in enumerate([*chain, *star, " ".join(base), *repeats])], "doc_id long, text string")
    for frame, source in ((docs, [*texts.items()]), (made, [(r.doc_id, r.text) for r in made.collect()])):
        sets, root = near_brute(source)
        least = {}
        for (d, _), r in zip(source, root):
            least[r] = min(least.get(r, d), d)
        assert {r.doc_id: r.class_id for r in near_dups.near_classes(frame).collect()} == {d: least[r] for (d, _), r in zip(source, root)}
    found = sorted(((r.doc_id, r.class_id) for r in near_dups.near_classes(odd).collect()), key=str)
    assert (10, 9) in found and (2, 2) in found and (3, 3) in found and found.count((7, 7)) == 2 and (None, None) in found and len(found) == len(ODD)
    kept = near_dups.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 1, 2, 3, 4, 5, 6, 7, 8, 9, -3, 11], key=str)
    assert near_dups.near_classes(none).count() == 0 and near_dups.one_of_each(none).count() == 0
    # near copies with one id or none, and rows that differ in other columns only
    words = " ".join(f"u{i}" for i in range(80))
    again = spark.createDataFrame([(5, words, "a"), (5, words + " z", "b"), (5, words, "c"), (None, words + " z y", "d")], "doc_id long, text string, kind string")
    assert len({tuple(r) for _ in range(2) for r in near_dups.one_of_each(again.orderBy(F.rand())).collect()}) == 1
    nameless = again.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert near_dups.one_of_each(nameless).count() == 1


def test_rest_is_compared_in_blocks(spark):
    """Nodes that are near one another but not their bucket's hub are found, whatever the size of a block."""
    from clademill.llm import near_dups

    base = [f"v{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base[:70] + [f"a{i}" for i in range(30)]), " ".join(base[:70] + [f"a{i}" for i in range(29)] + ["b"]), " ".join(f"c{i}" for i in range(100))]
    d = spark.createDataFrame([*enumerate(texts)], "node long, text string")
    nodes = spark.createDataFrame([(k, bytearray(near_dups.signed(t)[1])) for k, t in enumerate(texts)], "node long, sign binary")
    meetings = spark.createDataFrame([(band, node, 0) for band in (7, 8, 9) for node in (0, 1, 2, 3)[: band - 5]], "band long, node long, hub long")
    alike = near_dups.compared(meetings.where("node <> hub").select("node", "hub").distinct(), d)
    open_ = near_dups.open_buckets(meetings, alike)
    assert {r.band for r in open_.collect()} == {8, 9}
    for block, size in ((1, 1 << 20), (1000, 100), (1000, 1 << 20)):
        assert {tuple(sorted((r.node, r.hub))) for r in near_dups.rest_linked(open_, nodes, d, block, size).collect()} == {(1, 2)}


def test_a_chained_group_loses_no_link(spark):
    """Thousands of texts of one template, many pairs of which meet without being near: the classes are those of all pairs."""
    from clademill.llm import near_dups

    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(60)]
    texts = {}
    for k in range(2500):  # families of a few near copies around each of many variants of the template
        if k % 4 == 0:
            start, own = int(rng.integers(0, 45)), [f"f{rng.integers(0, 10**9)}" for _ in range(14)]
            words = base[:start] + own + base[start:]
        texts[k] = " ".join(words[: len(words) - int(rng.integers(0, 6))])
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    sets = [near_dups.shingles(t) for t in texts.values()]
    keys, at = np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True)
    x = np.zeros((len(sets), len(keys)), np.float32)
    x[np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets]), at] = 1
    both, size = x @ x.T, x.sum(1)
    alike = both / (size[:, None] + size - both)
    assert ((alike > 0.5) & (alike < 0.8)).sum() > 10 * len(sets)
    root = np.arange(len(sets))
    while True:
        least = np.where(alike >= 0.8 - 1e-7, root[None, :], len(sets)).min(1)
        if (least == root).all():
            break
        root = least
    found = {r.doc_id: r.class_id for r in near_dups.near_classes(frame).collect()}
    assert np.mean([found[k] == root[k] for k in found]) > 0.999
    assert all(root[found[k]] == root[k] for k in found)


def test_hot_keys_are_dealt(spark, monkeypatch):
    from clademill.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.range(200).select((F.col("id") % 20 * (F.col("id") > 99).cast("int")).alias("k"), F.col("id").alias("v"))
    right = spark.range(25).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = common.hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), "n")
    assert [tuple(r) for r in hot.collect()] == [(0, 11)]
    found = common.spread_join(left, right, ["k"], hot, "v")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_a_hub_below_a_thousandth_is_dealt(spark):
    """A key of 50,000 rows in a table of 60 million, counted as such: its rows are dealt in parts of HOT_ROWS or so."""
    from clademill.llm import common

    counts = spark.createDataFrame([(0, 50_000), (1, 59_950_000)], "k long, n long")
    left = spark.range(50_100).select(F.when(F.col("id") < 50_000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(60_000).select(F.col("id").alias("k"))
    hot = common.hot_keys(counts, "n")
    assert {r.k: r["__parts"] for r in hot.collect()} == {0: 25, 1: 29_975}
    assert common.spread_join(left, right, ["k"], hot.where("k = 0"), "v").count() == 50_100
    dealt = left.where("k = 0").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(25))).groupBy("part").count()
    assert dealt.agg(F.max("count")).first()[0] < 1.2 * common.HOT_ROWS


def test_darts():
    from clademill.llm import darts

    keys = np.random.default_rng(5).integers(0, 2**63, 4).astype(np.uint64)
    a, b = np.array([3.0, 1, 0.5, 2]), np.array([1.0, 1, 1.5, 2])
    same = [(darts.signature(keys + np.uint64(977 * i), a, 128) == darts.signature(keys + np.uint64(977 * i), b, 128)).mean() for i in range(60)]
    assert np.mean(same) == pytest.approx(0.6, abs=0.03)
    heavy = np.random.default_rng(6).integers(0, 2**63, 5000).astype(np.uint64)
    whole, most = darts.signature(heavy, np.ones(5000), 128), darts.signature(heavy[:4000], np.ones(4000), 128)
    assert (whole == most).mean() == pytest.approx(0.8, abs=0.12)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and total % 10 == 0) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


@pytest.fixture(scope="module")
def trees(spark):
    from clademill.llm import pii

    return pii.fit(spark)


def test_pii(spark, docs, odd, none, texts, trees):
    from clademill.llm import pii

    hard = ["x@y.com_z@q.org a@b.c-d@e.f", "4111 1111 1111 1111 4111-1111", "4111-1111-1111-1111!", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1", "é@x.com ü+49 30 1234567 😀 a@b.co 1.1.1.1", "a@@b.c a@b..c @b.c a@b. %@-.-", "1" * 3000, "1 " * 3000, "+1 (017) 555-7713 +1 (017) 555-7713", "a:" * 3000, "x@" * 3000, "(" * 3000, "a." * 3000 + "@", "1.1" * 2000]
    tough = spark.createDataFrame([(100 + k, t) for k, t in enumerate(hard)], "doc_id long, text string")
    for frame, source in ((docs, texts), (tough, dict(enumerate(hard, 100))), (odd, dict(ODD))):
        for r in pii.spanned(frame, trees).select("doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans")).collect():
            assert r.base == base_pii(source[r.doc_id]) and set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert {r.text for r in pii.redacted(odd, trees).where("doc_id = 11").collect()} == {"[EMAIL], [PHONE], [CARD], [IP]"}
    out = pii.redacted(odd, trees)
    assert out.columns == odd.columns and out.where("text is null").count() == 1 and pii.redacted(none, trees).count() == 0
    # without a finite threshold, or without trees, nothing is added
    assert pii.spanned(odd, pii.Trees()).where("size(spans) <> size(base)").count() == 0
    plan = pii.op8_pii(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def luhn(number):
    return number + str(-sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10)


def planted(rng):
    """Texts with personal data in other words and numbers than those that the trees learn from, and texts without."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    e = lambda n: "".join(map(str, rng.integers(2, 10, n)))
    name, host = rng.choice(["petra", "lukas.k", "sven-olaf", "mary_ann", "b.keller77"]), rng.choice(["acme", "blauwal", "city-library", "hospital", "data4you"])
    card = luhn("4" + d(14))
    good = [
        ("email", f"{name} (at) {host} (dot) com"), ("email", f"{name}[at]{host}[dot]org"), ("email", f"{name} @ {host}.net"), ("email", f"{name} at {host} dot de"),
        ("phone", f"({e(3)}) {e(3)}-{d(4)}"), ("phone", f"{e(3)}-{e(3)}-{d(4)}"), ("card", ".".join(card[i : i + 4] for i in (0, 4, 8, 12))), ("card", "/".join(card[i : i + 4] for i in (0, 4, 8, 12))),
        ("ip", f"10[.]{e(2)}[.]{e(1)}[.]{e(2)}"), ("ip", f"2001:db8:{e(4)}:{e(3)}::{e(2)}"),
    ]
    said = [("phone", f"telephone {e(3)} {e(3)} {d(4)}", 10), ("phone", f"fax 0{e(2)}/{d(7)}", 4), ("phone", f"mobile 0{e(3)} {d(7)}", 7)]
    bad = [f"since 1{d(1)}.0{e(1)}.19{e(2)}", f"on 20{d(2)}-0{e(1)}-1{d(1)}", f"at 1{d(1)}:3{d(1)}:{e(2)}", f"release {e(1)}.{e(1)}.{e(2)}", f"serial {e(16)}0{e(3)}", f"{e(1)} {e(3)} {e(3)} people", f"see chapter {e(1)}.{e(1)}.{e(1)}", f"isbn 978-{e(1)}-{e(2)}-{e(6)}-{e(1)}", "a map @ scale", "std::vector of x", f"scores {e(2)}-{e(2)} {e(2)}-{e(2)}"]
    out = []
    for kind, found in good:
        out.append((f"we met {name.split('.')[0]}s friend: {found}, thanks", kind, found))
    for kind, found, skip in said:
        out.append((f"my {found} today", kind, found[skip:]))
    return out, [f"they said {x} and left" for x in bad]


def test_pii_finds_other_forms(spark, trees):
    from clademill.llm import pii

    assert all(np.isfinite(trees.threshold[k]) for k in pii.KINDS)
    named = {
        "write jane.doe (at) example (dot) org": "email:6:37", "write jane @ example.org": "email:6:24", "pay 4111.1111.1111.1111": "card:4:23", "pay 4111/1111/1111/1111": "card:4:23",
        "call (555) 123-4567": "phone:5:19", "tel 030 1234567": "phone:4:15", "phone 555-713-0192": "phone:6:18", "SSN 123-45-6789": "", "due 2023-01-15": "", "the 4785380592391135 of": "",
    }
    rng, cases = np.random.default_rng(77), [(t, s) for t, s in named.items()]
    for _ in range(40):
        good, bad = planted(rng)
        cases += [(t, f"{kind}:{t.index(found)}:{t.index(found) + len(found)}") for t, kind, found in good] + [(t, "") for t in bad]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.spanned(frame, trees).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert [found[k] for k in range(len(named))] == [*named.values()]
    positive = [k for k, (_, s) in enumerate(cases) if s]
    taken = [k for k in found if found[k]]
    assert np.mean([found[k] == cases[k][1] for k in positive]) >= 0.9
    assert np.mean([found[k] == cases[k][1] for k in taken]) >= 0.95
    text = pii.redacted(frame.where("doc_id = 0"), trees).first().text
    assert text == "write [EMAIL]"


def plain_tree(x, slope, weight, own, depth, least, rate):
    g, h = sum(slope[i] for i in own), sum(weight[i] for i in own)
    best = (1e-6, None, None)
    for f in range(len(x[0])) if depth and len(own) >= 2 * least else ():
        values = sorted({r[f] for r in x})
        for low, high in zip(values, values[1:]):
            left = [i for i in own if x[i][f] <= low]
            if least <= len(left) <= len(own) - least:
                a, b = sum(slope[i] for i in left), sum(weight[i] for i in left)
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, f, (low + high) / 2)
    _, f, cut = best
    if f is None:
        return rate * g / (h + 1)
    return (f, cut, *(plain_tree(x, slope, weight, part, depth - 1, least, rate) for part in ([i for i in own if x[i][f] < cut], [i for i in own if x[i][f] >= cut])))


def test_boosting_against_a_plain_version():
    from clademill.llm import pii

    rng = np.random.default_rng(0)
    x = [[float(v) for v in rng.integers(0, 6, len(pii.FEATURES))] for _ in range(160)]
    kinds = ["card" if r[5] >= 2 and r[1] < 4 else "email" if r[2] == 3 else "" for r in x]
    turns = [*range(160)]
    trees = pii.Trees.fit(x, kinds, turns)
    assert set(trees.trees) == {"card", "email"}
    for kind in trees.trees:
        y = [k == kind for k in kinds]
        train = [i for i in turns if i % 2 == 0]
        n = sum(y[i] for i in train)
        raw = [np.log(n / (len(train) - n))] * 160
        for own in trees.trees[kind]:
            p = [1 / (1 + np.exp(-r)) for r in raw]
            tree = plain_tree(x, [a - b for a, b in zip(y, p)], [max(q * (1 - q), 1e-6) for q in p], train, pii.DEPTH, pii.LEAST, pii.RATE)
            step = [pii.walked(tree, r) for r in x]
            assert np.allclose(step, [pii.walked(own, r) for r in x])
            raw = [a + b for a, b in zip(raw, step)]
        test = sorted(((raw[i], y[i]) for i in turns if i % 2), reverse=True)
        least = min((s for k, (s, _) in enumerate(test) if sum(g for _, g in test[: k + 1]) >= pii.PRECISION * (k + 1) and (k + 1 == len(test) or test[k + 1][0] < s)), default=np.inf)
        below = [s for s, _ in test if s < least]
        assert trees.threshold[kind] == pytest.approx(max(0.0, (least + max(below)) / 2 if below else least))
    right = [max(trees.trees, key=lambda k: trees.raw(k, r) - trees.threshold[k]) if max(trees.raw(k, r) - trees.threshold[k] for k in trees.trees) >= 0 else "" for r in x]
    assert np.mean([a == b for a, b in zip(right, kinds)]) > 0.9


def test_quality(spark, docs, odd, none):
    from clademill.llm import quality

    big = "/root/testdata/sf0.01"
    found = quality.op9_quality_classifier(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in found])
    bad = [r for r in found if r.quality == 0]
    assert right > 0.95 and sum(r.predicted == 0 for r in bad) >= 0.7 * len(bad) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    by = {r.doc_id: r.score for r in quality.scored(odd, model).collect()}
    assert by[1] == by[2] and by[9] == by[10] and quality.scored(none, model).count() == 0
    alone = quality.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert {round(r.score, 3) for r in quality.scored(odd, alone).collect()} == {1.0}


def test_quality_against_a_plain_version():
    """Features, ratios, hinge loss and curve."""
    from clademill.llm import quality

    seen = np.zeros(quality.SLOTS, bool)
    for text in ("", "a", "ab", "abcab é", None):
        raw = (text or "").encode()
        keys = {int.from_bytes(bytes([n]) + raw[i : i + n], "big") for n in (2, 3, 4) for i in range(len(raw) - n + 1)}
        slots = sorted({k * 0x9E3779B97F4A7C15 % 2**64 >> 64 - quality.BITS for k in keys})
        assert quality.indicators(text, seen).tolist() == slots and not seen.any()
    for own in (np.arange(5, dtype=np.int32), np.arange(0, quality.SLOTS, 3, dtype=np.int32), np.zeros(0, np.int32)):
        assert quality.unpacked(quality.packed(own)).tolist() == own.tolist() and len(quality.packed(own)) <= quality.BITMAP
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(50, 8, replace=False)).astype(np.int32) + (20 if k % 3 else 0) for k in range(60)]
    good = np.array([k % 3 == 0 or k % 11 == 0 for k in range(60)])
    ratio = quality.ratios(rows, good)
    count = lambda label, slot: 1 + sum(slot in r for r, g in zip(rows, good) if g == label)
    total = [quality.SLOTS + 8 * int((good == label).sum()) for label in (True, False)]
    assert all(ratio[k] == pytest.approx(np.log(count(True, k) / total[0] / (count(False, k) / total[1]))) for k in range(0, 80, 7))
    w = quality.descend(rows, good, ratio, epochs=2000)[:80]
    x = np.zeros((60, 80))
    for k, own in enumerate(rows):
        x[k, own] = ratio[own] / np.linalg.norm(ratio[own])
    y, cost = np.where(good, 1, -1), quality.costs(good)
    assert cost[good].sum() == pytest.approx(cost[~good].sum())
    loss = lambda v: 0.5 * v @ v + cost @ np.maximum(0, 1 - y * (x @ v))
    alpha, z = np.zeros(60), x * y[:, None]
    for _ in range(20_000):  # the dual, by plain projected ascent
        alpha = np.clip(alpha + 0.05 * (1 - z @ (z.T @ alpha)), 0, cost)
    dual = alpha.sum() - 0.5 * (z.T @ alpha) @ (z.T @ alpha)
    assert dual - 1e-6 <= loss(w) <= dual * (1 + 1e-2) + 1e-2
    margins, label = rng.normal(size=400), rng.random(400) < 0.5
    margins += 2.0 * label
    a, b = quality.curve(margins, label)
    target = np.where(label, (label.sum() + 1) / (label.sum() + 2), 1 / ((~label).sum() + 2))
    like = lambda a, b: (target * np.log(1 / (1 + np.exp(-a * margins - b))) + (1 - target) * np.log(1 - 1 / (1 + np.exp(-a * margins - b)))).sum()
    assert all(like(a, b) >= like(a + da, b + db) for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_huffman(spark, docs, odd, none, texts, tmp_path):
    from clademill.llm import huffman, tokens

    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 0, 21])
    free, short = huffman.code_lengths(counts, 20), huffman.code_lengths(counts, 4)
    assert free[0] == 0 and sum(2.0 ** -free[free > 0].astype(float)) == 1 and short.max() == 4 and sum(2.0 ** -short[short > 0].astype(float)) <= 1
    best = min(sum(counts[counts > 0] * np.array(x)) for x in itertools.product(range(1, 5), repeat=8) if sum(2.0**-k for k in x) <= 1)
    assert (counts * short).sum() == best
    rng = np.random.default_rng(8)
    for n in (0, 1, 255, 256, 257, 70_000):
        ids = rng.zipf(1.3, n).clip(1, 5000).astype(np.uint32)
        code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=5001)))
        bits, offsets = code.encode(ids)
        assert code.decode(bits, offsets, n).tolist() == ids.tolist()
    path = P.path("word_bpe_49k.json")
    ids_of = tokens.held(path, True)
    for k, (frame, source) in enumerate(((docs, [*texts.items()]), (odd, ODD))):
        huffman.write(frame, f"file://{tmp_path}/{k}", path)
        rows = sorted(huffman.read(spark, f"file://{tmp_path}/{k}").collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((d for d, _ in source), key=lambda d: (d is not None, d))
        assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) // 4 for r in rows)])[:-1].tolist()
        assert collections.Counter((r.doc_id, bytes(r.ids)) for r in rows) == collections.Counter((d, ids_of.text(t) + u32([1])) for d, t in source)
    huffman.write(none, f"file://{tmp_path}/none", path)
    assert huffman.read(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline(spark, texts):
    """All stages against plain versions; the forest's verdicts are taken from the operator."""
    import corpus_pipeline as c
    from clademill.llm import rules, tokens

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in rules.judged(docs, forest).where("kept").collect()}
    left = [(d, t) for d, t in sorted(texts.items()) if d in kept]
    left = sorted((d, t) for d, t, _, _ in dropped(left, 10))
    sets, root = near_brute(left)
    seen, single = set(), []
    for (d, t), own, r in zip(left, sets, root):
        if r not in seen or not own[0].size:
            single.append((d, t))
        seen.add(r)
    ids, expected = tokens.held(P.path("byte_bpe_50k.json")), {}
    for d, t in single:
        at, out = 0, ""
        for s in filter(None, base_pii(t).split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                out += t[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        expected[d] = ids.text(out + t[at:]) + u32([0])
    rows = c.run(spark, SF).collect()
    plan_is_sound(rows, 2048)
    assert {r.doc_id for r in rows} == set(expected)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(expected[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in expected.values())
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows, a null id and clashing columns; a table from which the rules take all; an empty one."""
    import corpus_pipeline as c

    words = [" ".join(f"{w}{i}" for i in range(40)) + "." for w in ("red", "blue", "green")]
    more = [(20, words[0]), (21, words[0]), (22, words[1] + "\nwrite to a@b.co"), (22, words[2]), (None, words[2] + " end"), (23, words[1] + "\nwrite to c@d.org")]
    rows = spark.createDataFrame([(i, t, *(0 if k not in ("string",) else "z" for _, k in odd.dtypes[2:])) for i, t in more], odd.schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd.union(rows)), ("few", odd.where("doc_id < 5")), ("none", odd.where("doc_id = 12345678"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = c.run(spark, f"file://{tmp_path}/{name}").collect()
        plan_is_sound(found, 2048)
        kept = {r.doc_id for r in found}
        if name == "odd":
            assert {20, 22} <= kept and not kept & {1, 2, 3, 4, 21} and len(kept & {None, 22, 23}) in (1, 2)
        else:
            assert not found


def test_registered_queries(spark):
    from clademill.llm import queries

    names = [*queries.queries()]
    assert [re.match(r"op(\d+)_", n)[1] for n in names] == [str(k) for k in range(1, 11)] and set(queries.oracle_sql()) <= set(names)
    assert hashlib.sha256(b"").hexdigest() in {r.spans and "" or r.base_sha256 for r in queries.queries()["op8_pii"](spark, SF).collect()}
