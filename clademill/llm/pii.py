"""Personal data in texts: fixed patterns, and candidates that boosted trees judge. DataFrame functions only.

The fixed patterns (email, ip, card, phone) give the base spans, each after a check of its own (parts, digits, Luhn).
Loose generators then propose spans that may overlap and that no base span meets: spelled-out addresses, numbers with
other separators, groups of digits, dotted numbers, colon-separated hexadecimals. Boosted trees see a candidate's format
(lengths, digits, separators, checksum) and its context (the characters beside it, words before it that announce such
data) and give one score for each kind. A candidate is taken if a score reaches its kind's threshold, as the kind whose
score exceeds its threshold most, whatever generator proposed it; of overlapping ones the higher excess stays.

No table marks personal data, so the trees learn from made sentences (`made`): personal data in forms that the base
patterns miss, and dates, versions, orders, codes and the like that are none. Half of the sentences grow the trees, the
other half calibrates the thresholds: the lowest that keeps a precision of PRECISION, and even odds at least. Their number is fixed and they owe
nothing to the documents, so that a text has the same spans in a table of any size. Their features come from the same
expressions; growing takes place on the driver, and the trees then become one expression. Positions are code points, ends
exclusive. Base spans, scores and spans cover whole texts of all documents.

Null and empty texts have no spans. Ties between overlapping candidates go to the higher score, then the earlier start.
Repeated rows get equal spans. An empty table gives an empty result. Columns other than the id and the text are not read,
or are kept as they are (redacted).
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A match starts where the last one ended or where a run starts; runs are taken whole. This finds the
# same matches as the plain patterns, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: kind -> pattern and what a text must hold for it to be worth a search
BASE = {"email": (EMAIL, "@"), "ip": (IP, r"[0-9]\.[0-9]"), "card": (CARD, r"[0-9](?:[ -]?[0-9]){11}"), "phone": (PHONE, r"\+[0-9]")}
# The generators: high recall, little precision. Each starts where a run starts and has bounded parts.
AT, DOT, PART = r"(?:@| @ | ?[(\[{] ?[aA][tT] ?[)\]}] ?)", r"(?:\.| \. | ?[(\[{] ?[dD][oO][tT] ?[)\]}] ?)", r"[\p{L}0-9-]{1,63}+"
GAP = r"[ ._/· ‐-―-]"
GENERATORS = {
    "email": (
        rf"(?<![\p{{L}}0-9._%+-])[\p{{L}}0-9._%+-]{{1,64}}+(?:{AT}{PART}(?:{DOT}{PART}){{1,8}}| [aA][tT] {PART}(?: [dD][oO][tT] {PART}){{1,8}})",
        rf"@|[(\[{{] ?[aA][tT] ?[)\]}}]| [aA][tT] {PART} [dD][oO][tT] ",
    ),
    "ip": (
        r"(?<![0-9.])[0-9]{1,5}+(?:(?: ?\. ?|[(\[]\.[)\]]| ?[(\[]dot[)\]] ?)[0-9]{1,5}+){2,5}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![0-9A-Za-z:])",
        r"[0-9] ?[.(\[][^0-9]{0,5}[0-9]|:[0-9a-fA-F]{0,4}:",
    ),
    "card": (rf"(?<![0-9])(?=(?:[0-9]{GAP}{{0,2}}){{12}})[0-9]{{2,19}}+(?:{GAP}{{1,2}}[0-9]{{2,19}}+){{0,9}}", rf"[0-9](?:{GAP}{{0,2}}[0-9]){{11}}"),
    "phone": (rf"(?<![0-9])\(?\+?[0-9]{{1,5}}+\)?(?:{GAP}{{0,3}}\(?[0-9]{{2,8}}+\)?){{1,5}}(?![0-9])", rf"[0-9](?:[()]|{GAP}){{0,5}}[0-9](?:(?:[()]|{GAP}){{0,5}}[0-9]){{5}}"),
}
# Words before a span that announce its kind, or another number.
ANNOUNCED = {
    "email": r"(?i)mail|write|contact|reach|schreib|écri|escrib|correo|courriel",
    "ip": r"(?i)\bip\b|ipv[46]|host|server|addr|adres|ping|\bssh\b|gateway|\bdns\b|router",
    "card": r"(?i)card|visa|master|amex|credit|debit|kredit|karte|carte|tarjeta",
    "phone": r"(?i)phone|\btel|call|\bfax|mobil|\bcell|handy|\bruf|móvil|portable|whatsapp|\bsms\b|dial|fono",
    "other": r"(?i)order|invoice|\bver|isbn|serial|date|\bref|\bnr\b|\bno\b|\bid\b|section|chapter|release|build|bestell|rechnung|factur|ticket|case|parcel|since|page|ssn|social|total|score|price|code|kapitel|pedido|commande",
}
CONTEXT = 24
MADE, ROUNDS, DEPTH, RATE, LEAST, PRECISION, SHARED, SEED = 2400, 24, 4, 0.3, 6, 0.99, 0.8, 5
FEATURES = (
    "chars", "digits", "letters", "separators", "gaps", "groups", "first", "largest", "smallest", "last", "parts", "luhn", "parts_ok", "at", "spelled_at", "dots", "spelled_dots", "colons", "brackets", "plus", "zero",
    "left_word", "right_word", "near_digits", "says_email", "says_ip", "says_card", "says_phone", "says_other",
)
SPAN = "array<struct<kind:string,rank:int,start:int,stop:int,found:string>>"


def located(text: Column, pattern: str, worth: str, kind: str) -> Column:
    """All matches of a pattern, leftmost first, not overlapping, with their positions.

    The pieces between the matches and the matches themselves have known lengths, and so the positions.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        stop = begin + F.length(x["found"])
        span = F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), begin.alias("start"), stop.alias("stop"), x["found"].alias("found"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    both = F.filter(F.arrays_zip(found.alias("found"), pieces.alias("piece")), lambda x: x["found"].isNotNull())
    return F.when(text.rlike(worth), F.aggregate(both, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right last digit."""
    value = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def parts_ok(text: Column) -> Column:
    """Whether the number between dots is at most 255 everywhere."""
    return F.forall(F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.length(p) < 4) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def valid(span: Column) -> Column:
    n = F.length(digits(span["found"]))
    return (
        F.when(span["kind"] == "ip", parts_ok(span["found"]))
        .when(span["kind"] == "card", n.between(12, 19) & luhn(digits(span["found"])))
        .when(span["kind"] == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind."""
    every = [located(text, *BASE[k], k) for k in KINDS]
    return F.array_sort(F.filter(F.concat(*every), valid), lambda a, b: F.when((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["rank"] < b["rank"]), -1).when((a["start"] == b["start"]) & (a["rank"] == b["rank"]), 0).otherwise(1))


def proposals(text: Column) -> Column:
    return F.concat(*(located(text, *GENERATORS[k], k) for k in KINDS))


def measured(span: Column, text: Column) -> Column:
    """FEATURES of one candidate as an array of numbers."""
    found = span["found"]
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    after = F.substring(text, span["stop"] + 1, F.lit(CONTEXT))
    sizes = F.transform(F.filter(F.split(found, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
    number = digits(found)

    def count(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(found, F.lit(pattern), F.lit(0)))

    def at(of: Column, k: int) -> Column:
        return F.coalesce(F.try_element_at(of, F.lit(k)), F.lit(0))

    values = {
        "chars": F.length(found), "digits": F.length(number), "letters": count(r"\p{L}"), "separators": count(GAP), "gaps": count(GAP + "{2,}"), "groups": F.size(sizes),
        "first": at(sizes, 1), "largest": F.coalesce(F.array_max(sizes), F.lit(0)), "smallest": F.coalesce(F.array_min(sizes), F.lit(0)), "last": at(sizes, -1), "parts": F.size(F.array_distinct(sizes)),
        "luhn": (F.length(number).between(12, 19) & luhn(number)).cast("int"), "parts_ok": parts_ok(F.regexp_replace(found, "[^0-9]+", ".")).cast("int"),
        "at": count("@"), "spelled_at": count(r"(?i)[(\[{] ?at ?[)\]}]") * 2 + count(r"(?i) at "), "dots": count(r"\."), "spelled_dots": count(r"(?i)[(\[{ ](?:dot|\.)[)\]} ]"), "colons": count(":"), "brackets": count(r"[()\[\]{}]"),
        "plus": found.startswith("+").cast("int"), "zero": found.rlike(r"^\(?0").cast("int"), "left_word": before.rlike(r"[\p{L}\p{N}_]$").cast("int"), "right_word": after.rlike(r"^[\p{L}\p{N}_]").cast("int"), "near_digits": F.length(digits(F.concat(before, after))),
        **{f"says_{k}": before.rlike(p).cast("int") for k, p in ANNOUNCED.items()},
    }
    return F.array(*(values[f].cast("double") for f in FEATURES))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def agrees(mark: Column, span: Column) -> Column:
    """Whether two spans share most of either's length."""
    both = F.least(mark["stop"], span["stop"]) - F.greatest(mark["start"], span["start"])
    return both >= SHARED * F.greatest(mark["stop"] - mark["start"], span["stop"] - span["start"])


# What the made sentences are made of.
NAMES = "anna ben carla david eva felix greta hugo ines jan karin luis maria noah olga paul jörg zoë núria françois".split()
PLACES = "example mailbox company nordwind webhost librairie müller university sample station".split()
ENDINGS = "org com net de fr es info co.uk".split()
SAYS = {
    "email": ["mail", "write to", "e-mail:", "contact", "reach me:", "schreib an", "écrivez à", "correo"],
    "ip": ["ip", "host", "server", "ipv6 address", "ping", "ssh to", "gateway", "router"],
    "card": ["card", "visa", "credit card no.", "Kreditkarte", "carte", "tarjeta", "mastercard:", "charge my card"],
    "phone": ["call", "tel", "phone", "tel.", "mobile:", "fax", "Telefon", "teléfono", "dial", "cell"],
    "other": ["order", "invoice", "version", "isbn", "serial no", "dated", "ref", "section", "release", "Bestellung", "ticket", "case", "total", "score", "since", "parcel", "code", "ssn"],
}
FILLER = "the of and with from was under green river stone der und mit nach les une sur el los con para over then it is a to in".split()


def checked(number: str) -> str:
    """number with the last digit that Luhn's rule wants."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number)))
    return number + str(-total % 10)


def personal(rng: random.Random, kind: str) -> tuple[str, bool]:
    """Personal data in a form that the base patterns miss, and whether it is clear without an announcing word."""

    def number(pattern: str) -> str:
        return "".join(str(rng.randrange(10)) if c == "d" else str(rng.randrange(2, 10)) if c == "n" else c for c in pattern)

    if kind == "email":
        plain = rng.random() < 0.15  # letters beyond A-Z
        name = rng.choice(NAMES) + rng.choice(["", ".", "_", "-"]) + rng.choice([*NAMES, str(rng.randrange(100))])
        at, dot = ("@", ".") if plain else rng.choice([("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), ("(at)", "."), (" (at) ", "."), ("[at]", "."), (" [at] ", "."), (" @ ", " . "), ("{at}", "{dot}"), (" (AT) ", " (DOT) "), (" ( at ) ", " ( dot ) ")])
        return (rng.choice(["jörg", "zoë", "núria"]) if plain else name) + at + (rng.choice(["", "mail" + dot]) + (rng.choice(["müller", "łódź", "señal"]) if plain else rng.choice(PLACES)) + dot + rng.choice(ENDINGS[:-1])), True
    if kind == "ip":
        if rng.random() < 0.4:
            parts = [f"{rng.randrange(1, 65536):x}" for _ in range(8)]
            cut = rng.randrange(1, 6)
            return rng.choice([":".join(parts), ":".join(parts[:cut]) + "::" + ":".join(parts[6:]), "fe80::" + ":".join(parts[:4]), "2001:db8::" + parts[0]]), True
        return rng.choice(["[.]", "(.)", " . ", "(dot)", "[dot]", " [dot] "]).join(str(rng.randrange(256)) for _ in range(4)), True
    if kind == "card":
        gap = rng.choice([".", "/", "_", "  ", "–", " ", "·", " - ", "—"])
        if rng.random() < 0.2:
            whole = checked("3" + rng.choice("47") + number("d" * 12))
            return gap.join([whole[:4], whole[4:10], whole[10:]]), True
        whole = checked((rng.choice(["4", "51", "55", "6011"]) + number("d" * 15))[:15])
        return gap.join(whole[i : i + 4] for i in range(0, 16, 4)), True
    form, clear = rng.choice([
        ("(nnd) nnd-dddd", True), ("(nnd) nnd-dddd", True), ("(nnd)nnd-dddd", True), ("nnd-nnd-dddd", True), ("nnd-nnd-dddd", True), ("nnd.nnd.dddd", False), ("nnd nnd dddd", False), ("0nd ddddddd", False), ("0nd dddd ddd", False), ("0ndd/dddddd", False), ("0ndd-ddddddd", False),
        ("00nd nd ddddddd", False), ("00nd-ndd-ddddddd", False), ("0n dd dd dd dd", False), ("0n.dd.dd.dd.dd", False), ("+nn–ndd–ddddddd", True), ("+nn/ndd/ddddddd", True), ("nndnnddddd", False), ("0nddddddddd", False), ("nnd-dddd", False), ("(0nd) ddddddd", True), ("(0ndd) dddddd", True),
    ])
    return number(form), clear


def harmless(rng: random.Random) -> str:
    """What the generators propose and what is no personal data."""

    def number(pattern: str) -> str:
        return "".join(str(rng.randrange(10)) if c == "d" else str(rng.randrange(1, 10)) if c == "n" else rng.choice("0123456789abcdef") if c == "h" else c for c in pattern)

    year, month, day = rng.randrange(1900, 2100), f"{rng.randrange(1, 13):02}", f"{rng.randrange(1, 29):02}"
    failing = checked((rng.choice(["4", "51", "6011"]) + number("d" * 15))[:15])
    failing = failing[:-1] + str((int(failing[-1]) + rng.randrange(1, 10)) % 10)
    gap = rng.choice([".", "/", "_", "  ", "–", " - ", "·"])
    return rng.choice([
        f"{day}.{month}.{year}", f"{year}-{month}-{day}", f"{month}/{day}/{year}", f"{year} {month} {day}", f"{year}-{month}-{day} {number('1d:nd:nd')}", number("1d:nd:nd"), number("1d:nd:nd:dd"), f"{year}{month}{day}", f"{year}-{year + rng.randrange(1, 9)}", f"{year}/{str(year + 1)[2:]}/{month}",
        number("n.dd.d"), number("nd.n.d.ndddd"), number("n.n.n.n.n.n")[:9] + ".300.999", number("nn.dddd nn.dddd"), number("n ddd ddd"), number("n.ddd.ddd"), number("nd ddd ddd"), number("n.dd.n"), f"v{number('n.nd.n')}", number("n.d.n.dddd"),
        number("978-n-dd-dddddd-d"), number("978 n ddd ddddd d"), gap.join(failing[i : i + 4] for i in range(0, 16, 4)), gap.join(failing[i : i + 4] for i in range(0, 16, 4)), failing, failing, number("ndddddddd"), number("ndddddddddd"), number("nddddddd-dd"), number("h" * 40), number("h" * 16), number("hh:hh:hh:hh:hh:hh"),
        number("ndd-ndd-ndd"), number("nd-nd nd-nd nd-nd"), number("ndd-nd-dddd"), number("ndd-nd-dddd"), number("ndd dd dddd"), number("nddddddddddddddddddddd"), number("ndddd ndddd ndddd ndddd"), number("ndddd-dddd"), number("dddd-dd"), number("nd.ddd,dd"), number("3dd.4dd.5dd.6dd"), number("nd.ndd.9dd.4dd"),
        f"{rng.randrange(9)} @ {number('n.dd')}", "meet (at) noon. so", "look at this.that", f"at {rng.choice(NAMES)} dot", f"@app.{rng.choice(PLACES)}", "std::vector", "a::b", "::", f"price (at) {number('n.dd')}", f"sold at {number('nd.dd')}", "stay at home dot then", f"{number('nd')} @ {number('nd.d')}", f"x @ {rng.choice(FILLER)}.{rng.choice(FILLER)}",
    ])


def made(n: int = MADE, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n sentences and the spans of personal data in each: the same ones for the same numbers."""
    rng, out = random.Random(seed), []
    for k in range(n):
        words = [rng.choice(FILLER) for _ in range(rng.randrange(0, 6))]
        kind = KINDS[k // 2 % len(KINDS)] if k % 2 else ""
        found, clear = personal(rng, kind) if kind else (harmless(rng), False)
        if kind and (not clear or rng.random() < 0.5):
            words += [rng.choice(SAYS[kind])]
        elif not kind and rng.random() < 0.6:
            words += [rng.choice(SAYS["other"] if rng.random() < 0.85 else SAYS[rng.choice(KINDS)])]
        # what announces an address can stand before its name only
        start = len(" ".join(words)) + bool(words)
        before = " ".join([*words, ""]) if words else ""
        tail = rng.choice(["", ". ", ", ", "! ", ") ", " ", ".\n"]) + " ".join(rng.choice(FILLER) for _ in range(rng.randrange(0, 5)))
        tail = tail if not tail or not tail[0].isalnum() else " " + tail
        out.append((before + found + tail, [(kind, start, start + len(found))] if kind else []))
    return out


@dataclass
class Trees:
    """For each kind, boosted trees as nested tuples (feature, cut, below, above); a leaf is a number."""

    bias: dict[str, float] = field(default_factory=dict)
    trees: dict[str, list] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, rows: list[list[float]], kinds: list[str], turns: list[int], precision: float = PRECISION) -> Trees:
        """kinds: each row's kind, or "" if it is of none. Rows of even turns grow the trees, the others set the thresholds."""
        out, x = cls(), np.array(rows, float).reshape(-1, len(FEATURES))
        bins = Bins(x)
        train, test = (np.flatnonzero(np.array(turns, int) % 2 == k) for k in (0, 1))
        for kind in KINDS:
            y = np.array([k == kind for k in kinds], float)
            n = float(y[train].sum())
            if not 0 < n < len(train):
                continue
            out.bias[kind], out.trees[kind] = math.log(n / (len(train) - n)), []
            raw = np.full(len(x), out.bias[kind])
            for _ in range(ROUNDS):
                p = 1 / (1 + np.exp(-raw))
                out.trees[kind].append(grown(bins, y - p, np.maximum(p * (1 - p), 1e-6), train, DEPTH))
                raw += np.array([walked(out.trees[kind][-1], r) for r in x])
            out.threshold[kind] = max(cut(raw[test], y[test] > 0, precision), 0.0)
        return out

    def raw(self, kind: str, row) -> float:
        return self.bias[kind] + sum(walked(t, row) for t in self.trees[kind])

    def excess(self, kind: str, features: str) -> str:
        """SQL for the score of a kind less its threshold; features names the array."""

        def of(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{float(tree)!r}D"
            f, cut_, below, above = tree
            return f"if({features}[{f}] < {cut_!r}D, {of(below)}, {of(above)})"

        return " + ".join([f"{float(self.bias[kind] - self.threshold[kind])!r}D", *map(of, self.trees[kind])])


def cut(scores: np.ndarray, good: np.ndarray, precision: float) -> float:
    """The lowest threshold at which the share of good rows among those that reach it is at least `precision`, halfway to the next score below; without one, infinite."""
    order = np.argsort(-scores, kind="stable")
    s, right = scores[order], np.cumsum(good[order])
    last = np.append(s[1:] < s[:-1], True)
    fine = np.flatnonzero(last & (right >= precision * np.arange(1, len(s) + 1)) & (right > 0))
    if not fine.size:
        return math.inf
    k = fine[-1]
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


def walked(tree, row) -> float:
    while isinstance(tree, tuple):
        f, cut_, below, above = tree
        tree = below if row[f] < cut_ else above
    return tree


class Bins:
    """The values of each feature by number, those of all features in one range."""

    def __init__(self, x: np.ndarray):
        values, codes = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])))
        sizes = np.array([len(v) for v in values])
        self.start = np.cumsum(sizes) - sizes
        self.codes = np.column_stack(codes) + self.start
        self.feature = np.repeat(np.arange(len(sizes)), sizes)
        self.last = np.zeros(int(sizes.sum()), bool)
        self.last[(self.start + sizes - 1)[sizes > 0]] = True
        self.cuts = np.concatenate([np.append((v[1:] + v[:-1]) / 2, v[-1:]) for v in values])

    def summed(self, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each value, the weight of the rows whose value of this feature is at most that."""
        sums = np.cumsum(np.bincount(self.codes[own].ravel(), np.repeat(weight[own], self.codes.shape[1]), len(self.feature)))
        return sums - (sums[self.start] - np.diff(sums, prepend=0.0)[self.start])[self.feature]


def grown(bins: Bins, slope: np.ndarray, weight: np.ndarray, own: np.ndarray, depth: int):
    """A tree whose leaves are Newton steps, over the rows named by own."""
    g, h = float(slope[own].sum()), float(weight[own].sum())
    if depth and len(own) >= 2 * LEAST:
        a, b, n = bins.summed(own, slope), bins.summed(own, weight), bins.summed(own, np.ones(len(slope)))
        gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
        gain[bins.last | (n < LEAST) | (n > len(own) - LEAST)] = 0
        k = int(gain.argmax())
        if gain[k] > 1e-6:
            f = int(bins.feature[k])
            below = bins.codes[own, f] <= k
            return (f, float(bins.cuts[k]), grown(bins, slope, weight, own[below], depth - 1), grown(bins, slope, weight, own[~below], depth - 1))
    return RATE * g / (h + 1)


def candidates(text: Column, base: Column) -> Column:
    """The proposals that no base span meets; equal ones of several generators once."""
    more = F.filter(proposals(text), lambda s: ~F.exists(base, lambda b: overlaps(b, s)))
    return F.array_distinct(F.transform(more, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found"))))


def fit(spark: SparkSession, n: int = MADE) -> Trees:
    """Trees from the candidates of n made sentences."""
    sentences = made(n)
    blob = json.dumps([{"turn": k // 8, "text": t, "marks": [{"kind": a, "start": b, "stop": c} for a, b, c in spans]} for k, (t, spans) in enumerate(sentences)])
    rows = spark.range(0, 8, 1, 8).select("id", F.explode(F.from_json(F.lit(blob), "array<struct<turn:int,text:string,marks:array<struct<kind:string,start:int,stop:int>>>>")).alias("row")).where("row.turn % 8 = id").select("row.*")
    each = rows.select("turn", "text", "marks", F.explode(candidates(F.col("text"), base_spans(F.col("text")))).alias("span"))
    same = F.filter("marks", lambda m: agrees(m, F.col("span")))
    found = each.select("turn", measured(F.col("span"), F.col("text")).alias("features"), F.coalesce(F.try_element_at(same, F.lit(1))["kind"], F.lit("")).alias("kind")).collect()
    found.sort(key=lambda r: (r.turn, r.kind, r.features))
    return Trees.fit([r.features for r in found], [r.kind for r in found], [r.turn for r in found])


def spanned(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs (any columns, with text) with base and spans: the base spans, and those with the added ones."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("base", base_spans(text))
    kinds = [k for k in KINDS if math.isfinite(trees.threshold.get(k, math.inf))]
    if not kinds:
        return out.withColumn("spans", F.col("base"))
    out = out.withColumn("__more", F.transform(candidates(text, F.col("base")), lambda s: F.struct(s.alias("span"), measured(s, text).alias("features"))))

    # a candidate's kind is the one whose score exceeds its threshold most
    of = [f"named_struct('score', {trees.excess(k, 'c.features')}, 'rank', {-KINDS.index(k)})" for k in kinds]
    judged = F.expr(f"transform(__more, c -> named_struct('top', {'greatest(' * (len(of) > 1)}{', '.join(of)}{')' * (len(of) > 1)}, 'span', c.span))")

    def named(x: Column) -> Column:
        rank = -x["top"]["rank"]
        kind = F.element_at(F.array(*map(F.lit, KINDS)), rank + 1)
        span = F.struct(kind.alias("kind"), rank.alias("rank"), x["span"]["start"].alias("start"), x["span"]["stop"].alias("stop"), x["span"]["found"].alias("found"))
        return F.struct(x["top"]["score"].alias("score"), (-x["span"]["start"]).alias("early"), span.alias("span"))

    taken = F.filter(judged, lambda x: x["top"]["score"] >= 0)
    out = out.withColumn("__more", F.sort_array(F.transform(taken, named), asc=False))

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda a: overlaps(a, x["span"])), acc).otherwise(F.concat(acc, F.array(x["span"])))

    added = F.aggregate("__more", F.array().cast(SPAN), step)
    every = F.array_sort(F.concat(F.col("base"), added), lambda a, b: F.when((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["rank"] < b["rank"]), -1).when((a["start"] == b["start"]) & (a["rank"] == b["rank"]), 0).otherwise(1))
    return out.withColumn("spans", F.when(F.size("__more") > 0, every).otherwise(F.col("base"))).drop("__more")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        tail = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], tail).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    found = spanned(docs.withColumns({f"__{c}": F.col(c) for c in ("base", "spans") if c in docs.columns}), trees)
    out = found.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))
    return out.withColumns({c: F.col(f"__{c}") for c in ("base", "spans") if c in docs.columns}).select(*docs.columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = spanned(docs, fit(spark)).select("doc_id", "base", "spans")
    counts = [counted("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
