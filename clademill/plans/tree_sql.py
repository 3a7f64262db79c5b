"""SQL for the queries on trees and hidden chains: sums and products of columns, with the constants worked out here by other means."""

from __future__ import annotations

import math

from clademill.plans.inputs import SYMBOLS_SQL

#: The tree of seven tips as pairs of (node, length) in postorder; tips are numbers.
INNER = {"a": ((1, 1.0), (2, 1.0)), "b": ((3, 1.0), (4, 0.8)), "ab": (("a", 0.5), ("b", 0.6)), "c": ((5, 0.9), (6, 1.1)), "d": (("c", 0.4), (7, 1.2)), "root": (("ab", 0.7), ("d", 0.3))}
TIPS = range(1, 8)
Q0, Q1, P0, P1, PINV, ALPHA, PI = 0.6, 0.9, 0.02, 0.05, 0.2, 0.8, 0.7

#: gaps: for each column of each alignment the gap states of its seven rows (1 for a gap), and the number of columns.
GAPS_SQL = SYMBOLS_SQL + ", size AS (SELECT OGid, max(pos) + 1 AS n FROM symbols GROUP BY 1), grid AS (SELECT OGid, n, unnest(range(n))::INT AS pos FROM size), gaps AS MATERIALIZED (SELECT g.OGid, g.n, g.pos, " + ", ".join(
    f"1 - coalesce(max(CASE WHEN ppid = {i} AND sym <> '-' THEN 1 END), 0) AS g{i}" for i in TIPS
) + " FROM grid g LEFT JOIN symbols s ON s.OGid = g.OGid AND s.pos = g.pos GROUP BY 1, 2, 3)"


def real(x: float) -> str:
    """x as a DOUBLE, which a plain decimal is not."""
    return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"


def lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function by its series."""
    term = total = 1 / a
    n = 1
    while term > 1e-18 * total:
        term *= x / (a + n)
        total += term
        n += 1
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def quantile(a: float, p: float) -> float:
    low, high = 1e-12, 100.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if lower_gamma(a, middle) < p else (low, middle)
    return middle


def classes() -> list[tuple[float, float]]:
    """(rate, prior) of four gamma bins and of the invariant class."""
    bounds = [0.0, *(lower_gamma(ALPHA + 1, quantile(ALPHA, k / 4)) for k in (1, 2, 3)), 1.0]
    return [(4 / (1 - PINV) * (b - a), (1 - PINV) / 4) for a, b in zip(bounds, bounds[1:])] + [(0.0, PINV)]


def moved(child: int | str, length: float, rate: float, k: int) -> tuple[str, str]:
    """A child's likelihoods as seen from the other end of its branch."""
    q = Q0 + Q1
    e = math.exp(-q * rate * length)
    stay0, stay1 = (Q1 + Q0 * e) / q, (Q0 + Q1 * e) / q
    zero, one = (f"l{child}_{s}" if isinstance(child, int) else f"x{k}_{child}_{s}" for s in (0, 1))
    return f"({real(stay0)} * {zero} + {real(1 - stay0)} * {one})", f"({real(1 - stay1)} * {zero} + {real(stay1)} * {one})"


def likelihood_sql(name: str, source: str, pis: dict[str, float]) -> str:
    """CTE name: source (with l{tip}_{state}, the likelihoods of the tips) and, for each of pis, the probability of the tips."""
    inside = f"SELECT * FROM {source}"
    for node, ((left, a), (right, b)) in INNER.items():
        columns = []
        for k, (rate, _) in enumerate(classes()):
            (x0, x1), (y0, y1) = moved(left, a, rate, k), moved(right, b, rate, k)
            columns += [f"{x0} * {y0} AS x{k}_{node}_0", f"{x1} * {y1} AS x{k}_{node}_1"]
        inside = f"SELECT *, {', '.join(columns)} FROM ({inside})"
    sums = [" + ".join(f"{real(prior)} * ({real(1 - pi)} * x{k}_root_0 + {real(pi)} * x{k}_root_1)" for k, (_, prior) in enumerate(classes())) + f" AS {p}" for p, pi in pis.items()]
    return f"{name} AS MATERIALIZED (SELECT *, {', '.join(sums)} FROM ({inside}))"


def read_as(gap: str) -> tuple[str, str]:
    """Likelihoods of a tip's two states given what was read."""
    return f"({real(1 - P0)} * {gap} + {real(P0)} * (1 - {gap}))", f"({real(P1)} * {gap} + {real(1 - P1)} * (1 - {gap}))"


PATTERNS_SQL = "bits AS (SELECT " + ", ".join(f"(k >> {i - 1}) & 1 AS g{i}" for i in TIPS) + " FROM range(128) t(k)), read AS (SELECT *, " + ", ".join(f"{x} AS l{i}_{s}" for i in TIPS for s, x in enumerate(read_as(f"g{i}"))) + " FROM bits)"
KEYS = ", ".join(f"g{i}" for i in TIPS)


def chain_sql(name: str, keys: str, seen: str, start: list[float], move: list[list[float]]) -> str:
    """CTE name: keys, pos and the posteriors p1, p2, ... of the states. seen: keys, pos, n and the emissions e1, e2, ..."""
    states, each = range(1, len(start) + 1), [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"e.{k} = r.{k}" for k in each)
    out_keys = ", ".join(f"e.{k}" for k in each)

    def step(direction: int, prefix: str, emitted) -> str:
        if direction > 0:
            raw = [f"e.e{s} * (" + " + ".join(f"r.{prefix}{t} * {real(move[t - 1][s - 1])}" for t in states) + ")" for s in states]
        else:
            raw = ["(" + " + ".join(f"{real(move[s - 1][t - 1])} * f.e{t} * r.{prefix}{t}" for t in states) + ")" for s in states]
        return ", ".join(f"({x}) / ({' + '.join(raw)})" for x in raw)

    first = [f"e{s} * {real(start[s - 1])}" for s in states]
    heads = ", ".join(f"({x}) / ({' + '.join(first)})" for x in first)
    names = lambda p: ", ".join(f"{p}{s}" for s in states)
    total = " + ".join(f"f{s} * b{s}" for s in states)
    return f"""{name}_f({keys}, pos, {names('f')}) AS (SELECT {keys}, pos, {heads} FROM {seen} WHERE pos = 0 UNION ALL
SELECT {out_keys}, e.pos, {step(1, 'f', None)} FROM {name}_f r JOIN {seen} e ON {same} AND e.pos = r.pos + 1),
{name}_b({keys}, pos, {names('b')}) AS (SELECT {keys}, pos, {', '.join('1.0::DOUBLE' for _ in states)} FROM {seen} WHERE pos = n - 1 UNION ALL
SELECT {out_keys}, e.pos, {step(-1, 'b', None)} FROM {name}_b r JOIN {seen} e ON {same} AND e.pos = r.pos - 1 JOIN {seen} f ON {same.replace('e.', 'f.')} AND f.pos = r.pos),
{name} AS (SELECT {keys}, pos, {', '.join(f'f{s} * b{s} / ({total}) AS p{s}' for s in states)} FROM {name}_f JOIN {name}_b USING ({keys}, pos))"""


def beta_binomial(n: int, a: float, b: float) -> list[float]:
    beta = lambda x, y: math.gamma(x) * math.gamma(y) / math.gamma(x + y)
    return [math.comb(n, k) * beta(k + a, n - k + b) / beta(a, b) for k in range(n + 1)]


def insertion_sql() -> str:
    pmf = [beta_binomial(7, a, b) for a, b in ((3.0, 0.5), (0.8, 1.2), (1.5, 0.8))]
    same = " + ".join(f"(g{i} = lag(g{i}) OVER w)::INT" for i in TIPS)
    seen = ", ".join(f"t.t{s} * [{', '.join(map(real, own))}][c.same + 1] AS e{s}" for s, own in enumerate(pmf, 1))
    chain = chain_sql("posterior", "OGid", "seen", [0.6, 0.2, 0.2], [[0.95, 0.03, 0.02], [0.05, 0.9, 0.05], [0.04, 0.03, 0.93]])
    return f"""WITH RECURSIVE {GAPS_SQL}, {PATTERNS_SQL}, {likelihood_sql('tree', 'read', {'t1': 0.7, 't2': 0.5, 't3': 0.2})},
columns AS (SELECT *, coalesce({same}, 0) AS same FROM gaps WINDOW w AS (PARTITION BY OGid ORDER BY pos)),
seen AS MATERIALIZED (SELECT c.OGid, c.pos, c.n, {seen} FROM columns c JOIN tree t USING ({KEYS})), {chain}
SELECT OGid, pos, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM posterior"""


def weights() -> dict[int, float]:
    """Each tip's share in the root value, worked out from the branches that lead to it."""
    span, share = {i: 0.0 for i in TIPS}, {"root": 1.0}
    for node, ((left, a), (right, b)) in INNER.items():
        span[node] = (a + span[left]) * (b + span[right]) / (a + span[left] + b + span[right])
    for node, ((left, a), (right, b)) in reversed(INNER.items()):
        v, w = a + span[left], b + span[right]
        share[left], share[right] = share[node] * w / (v + w), share[node] * v / (v + w)
    return {i: share[i] for i in TIPS}


def slices_sql(name: str, source: str, p: str, core: float, hulls: bool = False) -> str:
    """CTE name: OGid, start, stop of trims (or hulls) of the columns of source (OGid, pos, n, p, gaps)."""
    before, after = "OVER (PARTITION BY OGid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "OVER (PARTITION BY OGid ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    w = "OVER (PARTITION BY OGid ORDER BY pos)"
    out = f"""{name}_g AS MATERIALIZED (SELECT OGid, pos, n, {p} AS p, {p} >= {core} AS core, CASE WHEN lag({p}) {w} IS NULL THEN coalesce(lead({p}) {w} - {p}, 0e0) WHEN lead({p}) {w} IS NULL THEN {p} - lag({p}) {w} ELSE (lead({p}) {w} - lag({p}) {w}) / 2 END AS grad, coalesce(gaps - lag(gaps) {w}, 0e0) AS step FROM {source}),
{name}_m AS MATERIALIZED (SELECT *, coalesce(max(CASE WHEN NOT (p >= 1e-3 OR grad >= 1e-3) THEN pos END) {before}, -1) + 1 AS low, coalesce(min(CASE WHEN NOT (p >= 1e-3 OR grad <= -1e-3) THEN pos END) {after}, n) - 1 AS high,
  coalesce(min(CASE WHEN NOT grad >= 1e-3 THEN pos END) {after}, n) - 1 AS inner_, coalesce(max(CASE WHEN NOT grad <= -1e-3 THEN pos END) {before}, -1) + 1 AS outer_, pos - row_number() OVER (PARTITION BY OGid, core ORDER BY pos) AS run FROM {name}_g),
{name}_r AS MATERIALIZED (SELECT OGid, run, min(pos) AS a, max(pos) + 1 AS b, arg_min(low, pos) AS low, arg_min(inner_, pos) AS inner_, arg_max(high, pos) AS high, arg_max(outer_, pos) AS outer_ FROM {name}_m WHERE core GROUP BY OGid, run),
"""
    if hulls:
        out += f"{name}_e AS (SELECT OGid, low AS a, high + 1 AS b FROM {name}_r),"
    else:
        out += f"""{name}_l AS (SELECT r.OGid, r.run, g.pos FROM {name}_r r JOIN {name}_g g ON g.OGid = r.OGid AND g.pos > r.low AND g.pos <= r.inner_ QUALIFY row_number() OVER (PARTITION BY r.OGid, r.run ORDER BY abs(grad * step) DESC, g.pos) = 1),
{name}_h AS (SELECT r.OGid, r.run, g.pos FROM {name}_r r JOIN {name}_g g ON g.OGid = r.OGid AND g.pos > r.outer_ AND g.pos <= r.high WHERE r.high > r.b QUALIFY row_number() OVER (PARTITION BY r.OGid, r.run ORDER BY abs(grad * step) DESC, g.pos DESC) = 1),
{name}_e AS (SELECT r.OGid, CASE WHEN coalesce(l.pos, a) < coalesce(h.pos, b) THEN coalesce(l.pos, a) ELSE a END AS a, CASE WHEN coalesce(l.pos, a) < coalesce(h.pos, b) THEN coalesce(h.pos, b) ELSE b END AS b FROM {name}_r r LEFT JOIN {name}_l l USING (OGid, run) LEFT JOIN {name}_h h USING (OGid, run)),"""
    return out + f"""
{name}_o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY OGid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM {name}_e),
{name} AS MATERIALIZED (SELECT OGid, min(a)::INT AS start, max(b)::INT AS stop FROM (SELECT *, sum(opens) OVER (PARTITION BY OGid ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM {name}_o) GROUP BY OGid, k)"""


def trims_sql() -> str:
    own = weights()
    shown = " + ".join(f"{real(w)} * (1 - g{i})" for i, w in own.items())
    weight = "CASE ppid " + " ".join(f"WHEN {i} THEN {real(w)}" for i, w in own.items()) + " END"
    decoded, _, last = insertion_sql().rpartition("\nSELECT OGid, pos, round(p1")
    return f"""{decoded}, decoded AS MATERIALIZED (SELECT OGid, pos, round(p1{last}),
cols AS MATERIALIZED (SELECT OGid, pos, n, p2, CASE WHEN gaps <= 0.1 THEN 0e0 ELSE p3 END AS p3, gaps FROM (SELECT d.*, g.n, round(1 - ({shown}), 9) AS gaps FROM decoded d JOIN gaps g USING (OGid, pos))),
{slices_sql('third', 'cols', 'p3', 0.75)}, {slices_sql('hull', 'cols', 'p3', 0.75, True)},
pair_cols AS MATERIALIZED (SELECT c.OGid, c.pos, c.n, c.gaps, CASE WHEN h.OGid IS NULL THEN c.p3 ELSE 0e0 END + c.p2 AS y FROM cols c LEFT JOIN hull h ON h.OGid = c.OGid AND c.pos >= h.start AND c.pos < h.stop), {slices_sql('pair', 'pair_cols', 'y', 0.9)},
counts AS (SELECT t.OGid, t.start, t.stop, ppid, count(*) FILTER (sym <> '-') AS c, any_value({weight}) AS w FROM third t JOIN symbols s ON s.OGid = t.OGid AND s.pos >= t.start AND s.pos < t.stop GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY OGid, start, stop ORDER BY c, ppid) <= count(*) OVER (PARTITION BY OGid, start, stop) - 5 AS rest FROM counts),
unaligned AS (SELECT OGid, start, stop, ppid FROM (SELECT *, greatest(2e0, coalesce(sum(c * w) FILTER (rest) OVER x / sum(w) FILTER (rest) OVER x, 2e0)) AS mean FROM placed WINDOW x AS (PARTITION BY OGid, start, stop)) WHERE c >= ln(0.01e0) / ln(1 - 1 / (mean + 1)) - 1),
stay AS (SELECT s.OGid, s.pos, count(*) AS c FROM symbols s WHERE sym <> '-' AND NOT EXISTS (FROM unaligned u WHERE u.OGid = s.OGid AND u.ppid = s.ppid AND s.pos >= u.start AND s.pos < u.stop) AND NOT EXISTS (FROM pair b WHERE b.OGid = s.OGid AND s.pos >= b.start AND s.pos < b.stop) GROUP BY 1, 2),
rest AS (SELECT OGid, count(*) AS columns, sum(c)::BIGINT AS residues FROM stay GROUP BY 1)
SELECT OGid, kind, start, stop, size.n::INT AS colnum, coalesce(columns, 0) AS columns, coalesce(residues, 0) AS residues, stop - start AS length, (stop - start) / size.n::DOUBLE AS length_ratio
FROM (SELECT *, 'segment' AS kind FROM third UNION ALL SELECT *, 'region' FROM pair) f JOIN size USING (OGid) LEFT JOIN rest USING (OGid)"""


def missing_ctes() -> str:
    """segments: OGid, ppid, start, stop, where a row looks missing."""
    likely = " UNION ALL ".join(f"SELECT g.OGid, g.pos, g.n, {i} AS ppid, g.g{i} AS gap, x.t / (x.t + y.t) AS likely FROM gaps g JOIN tree x USING ({KEYS}) JOIN tree y ON y.g{i} = 1 - g.g{i} AND " + " AND ".join(f"y.g{j} = g.g{j}" for j in TIPS if j != i) for i in TIPS)
    chain = chain_sql("posterior", "OGid, ppid", "seen", [0.95, 0.05], [[0.98, 0.02], [0.1, 0.9]])
    return f"""{GAPS_SQL}, {PATTERNS_SQL}, {likelihood_sql('tree', 'read', {'t': PI})}, seen AS MATERIALIZED (SELECT OGid, ppid, pos, n, gap, likely AS e1, 1 - likely AS e2 FROM ({likely})), {chain},
state AS (SELECT OGid, ppid, pos, p2 >= 0.75 AS core, p2 >= 0.75 OR p2 >= 0.05 AND gap = 0 AS inside FROM posterior JOIN seen USING (OGid, ppid, pos)),
island AS (SELECT *, pos - row_number() OVER (PARTITION BY OGid, ppid ORDER BY pos) AS k FROM state WHERE inside),
segments AS (SELECT OGid, ppid, min(pos)::INT AS start, (max(pos) + 1)::INT AS stop FROM island GROUP BY OGid, ppid, k HAVING bool_or(core))"""


def missing_sql() -> str:
    return f"WITH RECURSIVE {missing_ctes()} SELECT OGid, ppid, start, stop FROM segments"


def hidden_sql() -> str:
    columns = ", ".join(f"CASE WHEN ppid = {i} THEN (state = {s})::INT ELSE {x} END AS l{i}_{s}" for i in TIPS for s, x in enumerate(read_as(f"g{i}")))
    own = "CASE ppid " + " ".join(f"WHEN {i} THEN CASE WHEN state = 0 THEN {read_as(f'g{i}')[0]} ELSE {read_as(f'g{i}')[1]} END" for i in TIPS) + " END"
    return f"""WITH RECURSIVE {missing_ctes()}, fixed AS (SELECT *, {own} AS own, {columns} FROM bits, range(1, 8) r(ppid), range(2) q(state)), {likelihood_sql('free', 'fixed', {'t': PI})},
share AS (SELECT {KEYS}, ppid, sum(t * own) FILTER (state = 1) / sum(t * own) AS one FROM free GROUP BY ALL)
SELECT s.OGid, s.ppid, s.start, s.stop, string_agg(CASE WHEN one >= 0.8 THEN '1' ELSE '0' END, '' ORDER BY g.pos) AS seq
FROM segments s JOIN gaps g ON g.OGid = s.OGid AND g.pos >= s.start AND g.pos < s.stop JOIN share h ON h.ppid = s.ppid AND {' AND '.join(f'h.g{i} = g.g{i}' for i in TIPS)} GROUP BY 1, 2, 3, 4"""


def contrasts_sql() -> str:
    """Contrasts of the gap pattern in closed form: a node's value and the length that its uncertainty adds."""
    value, more, out = {i: (f"g{i}", 0.0) for i in TIPS}, {}, []
    for node, ((left, a), (right, b)) in INNER.items():
        (x, v), (y, w) = value[left], value[right]
        v, w = a + v, b + w
        out.append(f"sum(abs(({x}) - ({y})) / {real(math.sqrt(v + w))}) AS c{len(out) + 1}")
        value[node] = (f"(({x}) * {real(w / (v + w))} + ({y}) * {real(v / (v + w))})", v * w / (v + w))
    residues = " + ".join(f"1 - g{i}" for i in TIPS)
    total = " + ".join(f"c{k}" for k in range(1, 7))
    return f"""WITH {GAPS_SQL}, t AS (SELECT OGid, 7 AS gnidnum, n::INT AS len1, sum({residues}) / 7.0::DOUBLE AS len2, {', '.join(out)} FROM gaps GROUP BY OGid, n)
SELECT OGid, gnidnum, len1, round(len2, 6) AS len2, round({total}, 6) AS total, round(({total}) / 7, 6) AS norm1, round(({total}) / (7 * len2), 6) AS norm2, {', '.join(f'round(c{k}, 6) AS c{k}' for k in range(1, 7))} FROM t"""
