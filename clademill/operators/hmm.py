"""Two-state Markov models on trees, and hidden Markov models over alignment columns."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.functions.special import beta_binomial, beta_binomial_slopes, gamma_quantile, gammainc
from clademill.sources.newick import Node
from clademill.storage import stored

Params = dict[str, float]


def transition(q0: float, q1: float, t: float) -> np.ndarray:
    """Probabilities of the two states after time t."""
    q = q0 + q1
    if q == 0 or t == 0:
        return np.eye(2)
    e = np.exp(-q * t)
    p00, p11 = (q1 + q0 * e) / q, (q0 + q1 * e) / q
    return np.array([[p00, 1 - p00], [1 - p11, p11]])


@lru_cache(maxsize=64)
def rate_classes(pinv: float, alpha: float, k: int = 4) -> tuple[tuple[float, float], ...]:
    """(rate, prior) of k equal bins of a gamma distribution of mean 1, and of the invariant class."""
    edges = [alpha * gamma_quantile(i / k, alpha, 1 / alpha) for i in range(k + 1)]
    upper = [gammainc(alpha + 1, x) for x in edges]
    return (*((k / (1 - pinv) * (b - a), (1 - pinv) / k) for a, b in zip(upper, upper[1:])), (0.0, pinv))


def conditional(tree: Node, tips: dict[str, np.ndarray], q0: float, q1: float, p0: float, p1: float) -> tuple[np.ndarray, np.ndarray]:
    """For each column, the scaled likelihoods of the two root states, and the logarithm of the scale.

    tips: 2 x columns for each tip, row 0 for a gap, row 1 for a residue; p0 and p1 are the errors in reading them.
    """
    error = np.array([[1 - p0, p0], [p1, 1 - p1]])

    def visit(node: Node) -> tuple[np.ndarray, np.ndarray]:
        if not node.children:
            return error @ tips[node.name], np.zeros(tips[node.name].shape[1])
        value, log = 1.0, 0.0
        for child in node.children:
            below, scale = visit(child)
            value, log = value * (transition(q0, q1, child.length or 0.0) @ below), log + scale
        total = value.sum(0)
        return value / total, log + np.log(total)

    return visit(tree)


def tree_probability(tree: Node, tips: dict[str, np.ndarray], p: Params, k: int = 4) -> np.ndarray:
    """Probability of each column under all rate classes."""
    root, out = np.array([1 - p["pi"], p["pi"]]), 0.0
    for rate, prior in rate_classes(p["pinv"], p["alpha"], k):
        value, log = conditional(tree, tips, p["q0"] * rate, p["q1"] * rate, p["p0"], p["p1"])
        out = out + prior * (root @ value) * np.exp(log)
    return out


def transition_slopes(q0: float, q1: float, t: float) -> dict[str, np.ndarray]:
    """Derivatives of transition() by q0 and q1."""
    q = q0 + q1
    if q == 0 or t == 0:
        return {"q0": np.zeros((2, 2)), "q1": np.zeros((2, 2))}
    (p00, _), (_, p11) = transition(q0, q1, t)
    e = np.exp(-q * t)
    by = {"q0": (e - q0 * t * e - p00, 1 - q1 * t * e - p11), "q1": (1 - q0 * t * e - p00, e - q1 * t * e - p11)}
    return {name: np.array([[a, -a], [-b, b]]) / q for name, (a, b) in by.items()}


def conditional_slopes(tree: Node, tips: dict[str, np.ndarray], q0: float, q1: float, p0: float, p1: float) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """conditional(), and the derivatives of the likelihoods by q0, q1, p0 and p1 under the same scale, in one visit of the tree."""
    error = np.array([[1 - p0, p0], [p1, 1 - p1]])
    by_error = {"p0": np.array([[-1.0, 1.0], [0.0, 0.0]]), "p1": np.array([[0.0, 0.0], [1.0, -1.0]])}

    def visit(node: Node) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        if not node.children:
            own = tips[node.name]
            return error @ own, np.zeros(own.shape[1]), {"q0": np.zeros_like(own), "q1": np.zeros_like(own)} | {name: m @ own for name, m in by_error.items()}
        value, log, slopes = 1.0, 0.0, dict.fromkeys(("q0", "q1", "p0", "p1"), 0.0)
        for child in node.children:
            below, scale, inner = visit(child)
            t = child.length or 0.0
            move, by_move = transition(q0, q1, t), transition_slopes(q0, q1, t)
            factor = move @ below
            for name in slopes:
                change = move @ inner[name]
                if name in by_move:
                    change = change + by_move[name] @ below
                slopes[name] = slopes[name] * factor + value * change
            value, log = value * factor, log + scale
        total = value.sum(0)
        return value / total, log + np.log(total), {name: x / total for name, x in slopes.items()}

    return visit(tree)


def tree_slopes(tree: Node, tips: dict[str, np.ndarray], p: Params, k: int = 4, eps: float = 1e-6) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """tree_probability() and its derivatives by each of its parameters; only the rates' own by alpha is a difference."""
    root = np.array([1 - p["pi"], p["pi"]])
    classes = rate_classes(p["pinv"], p["alpha"], k)
    above, below = (rate_classes(p["pinv"], p["alpha"] + s * eps, k) for s in (1, -1))
    out, slopes = 0.0, dict.fromkeys(("q0", "q1", "p0", "p1", "pi", "pinv", "alpha"), 0.0)
    for i, (rate, prior) in enumerate(classes):
        value, log, inner = conditional_slopes(tree, tips, p["q0"] * rate, p["q1"] * rate, p["p0"], p["p1"])
        scale = np.exp(log)
        like, by = (root @ value) * scale, {name: (root @ x) * scale for name, x in inner.items()}
        by_rate = by["q0"] * p["q0"] + by["q1"] * p["q1"]
        out = out + prior * like
        for name, weight in (("q0", rate), ("q1", rate), ("p0", 1.0), ("p1", 1.0)):
            slopes[name] = slopes[name] + prior * weight * by[name]
        slopes["pi"] = slopes["pi"] + prior * (value[1] - value[0]) * scale
        if i < k:
            slopes["pinv"] = slopes["pinv"] - like / k + prior * by_rate * rate / (1 - p["pinv"])
            slopes["alpha"] = slopes["alpha"] + prior * by_rate * (above[i][0] - below[i][0]) / (2 * eps)
        else:
            slopes["pinv"] = slopes["pinv"] + like
    return out, slopes


def tip_slopes(tree: Node, tips: dict[str, np.ndarray], p: Params, tip: str, k: int = 4) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """tip_probability() and its derivatives."""
    seen, by_seen = tree_slopes(tree, tips, p, k)
    other, by_other = tree_slopes(tree, tips | {tip: tips[tip][::-1]}, p, k)
    whole = seen + other
    return seen / whole, {name: (by_seen[name] * other - seen * by_other[name]) / whole**2 for name in by_seen}


def column_slopes(tree: Node, tips: dict[str, np.ndarray], same: np.ndarray, rows: int, p: Params) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """column_emission() and its derivatives."""
    on_tree, by_tree = tree_slopes(tree, tips, p)
    kept, by_kept = beta_binomial(rows, p["a"], p["b"])[same], beta_binomial_slopes(rows, p["a"], p["b"])
    return kept * on_tree, {name: kept * x for name, x in by_tree.items()} | {name: x[same] * on_tree for name, x in by_kept.items()}


def tip_probability(tree: Node, tips: dict[str, np.ndarray], p: Params, tip: str, k: int = 4) -> np.ndarray:
    """Probability of a tip's state given the other tips."""
    seen = tree_probability(tree, tips, p, k)
    return seen / (seen + tree_probability(tree, tips | {tip: tips[tip][::-1]}, p, k))


def hidden_tip(tree: Node, tips: dict[str, np.ndarray], p: Params, tip: str, k: int = 4) -> np.ndarray:
    """Probability that a tip's hidden state is 1, given all tips as they were read."""
    free = {**p, "p0": 0.0, "p1": 0.0}
    both = []
    for state in (0, 1):
        n = tips[tip].shape[1]
        fixed = np.zeros((2, n))
        fixed[state] = 1
        others = {name: np.array([[1 - p["p0"], p["p0"]], [p["p1"], 1 - p["p1"]]]) @ x for name, x in tips.items() if name != tip}
        read = (np.array([[1 - p["p0"], p["p0"]], [p["p1"], 1 - p["p1"]]]) @ tips[tip])[state]
        both.append(tree_probability(tree, others | {tip: fixed}, free, k) * read)
    return both[1] / (both[0] + both[1])


def unchanged(gaps: np.ndarray) -> np.ndarray:
    """For each column, the rows whose gap state is that of the column before; 0 for the first. gaps: rows x columns."""
    return np.concatenate([[0], (gaps[:, 1:] == gaps[:, :-1]).sum(0)]) if gaps.shape[1] else np.zeros(0, int)


def column_emission(tree: Node, tips: dict[str, np.ndarray], same: np.ndarray, rows: int, p: Params) -> np.ndarray:
    """Emission of an alignment column: its unchanged rows (beta-binomial) and its gap pattern on the tree."""
    return beta_binomial(rows, p["a"], p["b"])[same] * tree_probability(tree, tips, p)


class Patterns:
    """Gap patterns of alignments on one tree: columns that are equal are evaluated once for all of them.

    residues: for each alignment, tips (as named) x columns of 0 and 1.
    """

    def __init__(self, tree: Node, names: list[str], residues: list[np.ndarray]):
        every = np.concatenate(residues, 1)
        unique, place = np.unique(every, axis=1, return_inverse=True)
        self.tree, self.tips = tree, {name: np.array([1.0 - row, row]) for name, row in zip(names, unique.astype(float))}
        self.places = np.split(place.ravel(), np.cumsum([r.shape[1] for r in residues])[:-1])
        self.known: dict[tuple, tuple] = {}

    def slopes(self, p: Params, k: int = 4) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """tree_slopes() of the different columns."""
        own = tuple(v for name, v in p.items() if name not in ("a", "b"))
        if own not in self.known:
            self.known[own] = tree_slopes(self.tree, self.tips, p, k)
        return self.known[own]

    def tip_slopes(self, i: int, tip: str, p: Params, k: int = 4) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """tip_slopes() of alignment i."""
        key = (tip, *p.values())
        if key not in self.known:
            (seen, by_seen), (other, by_other) = self.slopes(p, k), tree_slopes(self.tree, self.tips | {tip: self.tips[tip][::-1]}, p, k)
            whole = seen + other
            self.known[key] = seen / whole, {name: (by_seen[name] * other - seen * by_other[name]) / whole**2 for name in by_seen}
        value, by = self.known[key]
        return value[self.places[i]], {name: x[self.places[i]] for name, x in by.items()}

    def column_slopes(self, i: int, same: np.ndarray, p: Params) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """column_slopes() of alignment i."""
        (on_tree, by_tree), place, rows = self.slopes(p), self.places[i], len(self.tips)
        on_tree = on_tree[place]
        kept, by_kept = beta_binomial(rows, p["a"], p["b"])[same], beta_binomial_slopes(rows, p["a"], p["b"])
        return kept * on_tree, {name: kept * x[place] for name, x in by_tree.items()} | {name: x[same] * on_tree for name, x in by_kept.items()}


class Chain:
    """A hidden chain with a start vector, a transition matrix and an emission for each state and position."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = np.asarray(start, float), np.asarray(move, float), np.asarray(emit, float)
        states, n = self.emit.shape
        self.forward, self.backward, self.scale = np.zeros((n, states)), np.zeros((n, states)), np.ones(n)
        now = self.start * self.emit[:, 0] if n else self.start
        for i in range(n):
            if i:
                now = (self.forward[i - 1] @ self.move) * self.emit[:, i]
            self.scale[i] = now.sum()
            self.forward[i] = now / self.scale[i]
        if n:
            self.backward[-1] = 1
        for i in range(n - 2, -1, -1):
            self.backward[i] = self.move @ (self.emit[:, i + 1] * self.backward[i + 1]) / self.scale[i + 1]

    def log_likelihood(self) -> float:
        return float(np.log(self.scale).sum())

    def posterior(self) -> np.ndarray:
        """positions x states."""
        return self.forward * self.backward

    def moves(self) -> np.ndarray:
        """Expected number of each transition."""
        if len(self.scale) < 2:
            return np.zeros_like(self.move)
        after = self.emit[:, 1:].T * self.backward[1:] / self.scale[1:, None]
        return self.move * (self.forward[:-1].T @ after)

    def joint(self, states: np.ndarray) -> float:
        """Logarithm of the probability of a path together with the emissions."""
        with np.errstate(divide="ignore"):
            steps = np.log(self.move)[states[:-1], states[1:]].sum() if len(states) > 1 else 0.0
            return float(np.log(self.start)[states[0]] + steps + np.log(self.emit)[states, np.arange(len(states))].sum())


def _product(stack: np.ndarray) -> np.ndarray:
    """The product of a stack of matrices from left to right, up to a factor, by halves."""
    while len(stack) > 1:
        odd = stack[-1:] if len(stack) % 2 else stack[:0]
        stack = np.concatenate([stack[: len(stack) // 2 * 2 : 2] @ stack[1::2], odd])
        stack = stack / stack.max((1, 2), keepdims=True)
    return stack[0]


def blocked_posterior(columns: DataFrame, key: str, start: np.ndarray, move: np.ndarray, block: int = 4096) -> DataFrame:
    """key, pos and posterior of chains whose columns are dealt over many tasks. columns: key, pos (from 0, none missing), emit.

    Each block of columns is multiplied to one matrix; a scan over a chain's blocks, of which one has few numbers, gives the
    vectors that enter a block from both sides, and each block then runs its own recursions.
    """
    start, move, size = np.asarray(start, float), np.asarray(move, float), len(start)
    kind = dict(columns.dtypes)[key]
    rows = columns.withColumn("block", F.floor(F.col("pos") / block)).groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "emit"))).alias("rows"))
    packed = stored(rows, "blocks")

    def own(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        return rows.values.field(0).to_numpy(), rows.values.field(1).flatten().to_numpy().reshape(-1, size)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("rows"):
                pos, emit = own(rows)
                # whatever comes before the first column, it starts anew
                steps = np.where(pos[:, None, None] == 0, start[None, None], move[None])
                out.append(_product(steps * emit[:, None, :]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("block"), pa.array(out, pa.list_(pa.float64()))], names=[key, "block", "m"])

    def scanned(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        matrices = np.stack(part["m"]).reshape(-1, size, size)
        entry, leave = np.full((len(part), size), 1 / size), np.ones((len(part), size))
        for i in range(1, len(part)):
            entry[i] = entry[i - 1] @ matrices[i - 1]
            entry[i] /= entry[i].sum()
        for i in range(len(part) - 2, -1, -1):
            leave[i] = matrices[i + 1] @ leave[i + 1]
            leave[i] /= leave[i].max()
        return pd.DataFrame({key: part[key], "block": part["block"], "entry": [*entry], "leave": [*leave]})

    products = packed.mapInArrow(multiplied, f"{key} {kind}, block long, m array<double>")
    ends = products.groupBy(key).applyInPandas(scanned, f"{key} {kind}, block long, entry array<double>, leave array<double>")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows, entry, leave in zip(batch.column(key), *(batch.column(c) for c in ("rows", "entry", "leave"))):
                pos, emit = own(rows)
                forward, back = np.empty_like(emit), np.empty_like(emit)
                now = np.array(entry.as_py())
                for i in range(len(pos)):
                    now = (now @ move if pos[i] else start) * emit[i]
                    now = forward[i] = now / now.sum()
                back[-1] = now = np.array(leave.as_py())
                for i in range(len(pos) - 2, -1, -1):
                    now = move @ (emit[i + 1] * now)
                    now = back[i] = now / now.max()
                found = forward * back
                found /= found.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(pos), batch.schema.field(key).type), pa.array(pos, pa.int64()), pa.array([*found], pa.list_(pa.float64()))], names=[key, "pos", "posterior"])

    return packed.join(ends, [key, "block"]).select(key, "rows", "entry", "leave").mapInArrow(within, f"{key} {kind}, pos long, posterior array<double>")


def transition_counts(states: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    np.add.at(out, (states[:-1], states[1:]), 1)
    return out


# Parameters move on scales without bounds: logit for those in (0, 1), log for positive ones, softmax for rows of moves.
UNIT = {"p0", "p1", "pi", "pinv"}


def unbounded(name: str, x: float) -> float:
    return float(np.log(x / (1 - x)) if name in UNIT else np.log(x))


def bounded(name: str, x: float) -> float:
    return float(1 / (1 + np.exp(-x)) if name in UNIT else np.exp(x))


def bounded_slope(name: str, x: float) -> float:
    """Derivative of a parameter by its unbounded value."""
    return x * (1 - x) if name in UNIT else x


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def emission_gradient(emission: Callable[[Params], np.ndarray], p: Params, name: str, eps: float = 1e-6) -> np.ndarray:
    """Derivative of an emission by a parameter on its unbounded scale, by central differences."""
    x = unbounded(name, p[name])
    up, down = (emission({**p, name: bounded(name, x + s * eps)}) for s in (1, -1))
    return (up - down) / (2 * eps)


class Record:
    """A labelled record: path of states, and for each state a function from parameters to emissions.

    slopes: for each state a function that also gives the emissions' derivatives by the parameters as they are; without it
    they are taken by differences.
    """

    def __init__(self, states: np.ndarray, emissions: list[Callable[[Params], np.ndarray]], slopes: list[Callable[[Params], tuple[np.ndarray, dict[str, np.ndarray]]]] | None = None):
        self.states, self.emissions, self.slopes = np.asarray(states), emissions, slopes

    def emitted(self, params: list[Params]) -> tuple[np.ndarray, list[dict[str, np.ndarray]]]:
        """Emissions, and their derivatives by the parameters on their unbounded scales."""
        if self.slopes is None:
            return np.array([f(p) for f, p in zip(self.emissions, params)]), [{name: emission_gradient(f, p, name) for name in p} for f, p in zip(self.emissions, params)]
        found = [f(p) for f, p in zip(self.slopes, params)]
        return np.array([emit for emit, _ in found]), [{name: by[name] * bounded_slope(name, p[name]) for name in p} for (_, by), p in zip(found, params)]


def gradients(record: Record, start: np.ndarray, move: np.ndarray, params: list[Params]) -> tuple[float, np.ndarray, list[dict[str, float]]]:
    """log P(states | emissions) of one record, and minus its gradients by the moves' softmax scale and the parameters."""
    emit, slopes = record.emitted(params)
    chain = Chain(start, move, emit)
    n, m = chain.moves(), transition_counts(record.states, len(start))
    diff = m - n
    by_move = -(diff - move * diff.sum(1, keepdims=True))
    seen, expected = np.eye(len(start))[record.states], chain.posterior()
    by_param = []
    for k, by in enumerate(slopes):
        share = (seen[:, k] - expected[:, k]) / emit[k]
        by_param.append({name: -float((share * x).sum()) for name, x in by.items()})
    return chain.joint(record.states) - chain.log_likelihood(), by_move, by_param


class Coded:
    """Many chains whose emissions depend on no more than a code of each position, run side by side.

    codes: for each chain the codes of its positions; states: its labels, where it has some. slopes: for each state a function from
    parameters to the emissions of all codes and their derivatives by the parameters as they are. Chains stand longest first and
    position by position, so that a step of the recursions is one step of all chains that reach it.
    """

    def __init__(self, codes: list[np.ndarray], slopes: list[Callable[[Params], tuple[np.ndarray, dict[str, np.ndarray]]]], states: list[np.ndarray] | None = None):
        length = np.array([len(c) for c in codes], int)
        self.order, self.slopes = np.argsort(-length, kind="stable"), slopes
        self.length = length[self.order]
        longest = int(self.length[0]) if len(length) else 0
        #: chains that reach a position, and where the position's part begins
        self.active = np.searchsorted(-self.length, -np.arange(longest), "left")
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        self.codes = self._laid(codes)
        self.states = None if states is None else self._laid(states)

    def _laid(self, rows: list[np.ndarray]) -> np.ndarray:
        if not len(self.active):
            return np.zeros(0, int)
        flat = np.concatenate([rows[i] for i in self.order])
        starts = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        return np.concatenate([flat[starts[:n] + i] for i, n in enumerate(self.active)])

    def split(self, laid: np.ndarray) -> list[np.ndarray]:
        """Values by position as one array for each chain, in the order in which they came."""
        out: list[np.ndarray] = [laid[:0]] * len(self.order)
        for k, i in enumerate(self.order):
            out[i] = laid[self.begin[: self.length[k]] + k]
        return out

    def recursions(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior (by position) and scale as Chain has them, and the expected number of each transition. emit: states x codes."""
        seen = emit.T[self.codes]
        n, begin, active = len(self.active), self.begin, self.active
        forward, scale, posterior, moves = np.empty_like(seen), np.empty(len(seen)), np.empty_like(seen), np.zeros_like(move)
        for i in range(n):
            here = slice(begin[i], begin[i + 1])
            now = (forward[begin[i - 1] : begin[i - 1] + active[i]] @ move if i else start) * seen[here]
            scale[here] = total = now.sum(1)
            forward[here] = now / total[:, None]
        back = np.ones((active[-1] if n else 0, len(start)))
        for i in range(n - 1, -1, -1):
            here = slice(begin[i], begin[i + 1])
            posterior[here] = forward[here] * back
            if i:
                after = seen[here] * back / scale[here][:, None]
                moves += forward[begin[i - 1] : begin[i - 1] + active[i]].T @ after
                back = np.concatenate([after @ move.T, np.ones((active[i - 1] - active[i], len(start)))])
        return posterior, scale, move * moves

    def emitted(self, params: list[Params]) -> tuple[np.ndarray, list[dict[str, np.ndarray]]]:
        found = [f(p) for f, p in zip(self.slopes, params)]
        return np.array([emit for emit, _ in found]), [{name: by[name] * bounded_slope(name, p[name]) for name in p} for (_, by), p in zip(found, params)]

    def posteriors(self, start: np.ndarray, move: np.ndarray, params: list[Params]) -> list[np.ndarray]:
        """positions x states of each chain."""
        emit = np.array([f(p)[0] for f, p in zip(self.slopes, params)])
        return self.split(self.recursions(start, move, emit)[0])

    def gradients(self, start: np.ndarray, move: np.ndarray, params: list[Params]) -> tuple[float, np.ndarray, list[dict[str, float]]]:
        """gradients() of all chains, added up."""
        emit, slopes = self.emitted(params)
        posterior, scale, expected = self.recursions(start, move, emit)
        first, size = self.begin[1] if len(self.active) else 0, emit.shape[1]
        seen = np.array([np.bincount(self.codes[self.states == k], minlength=size) for k in range(len(start))])
        before = np.concatenate([self.states[b : b + a] for b, a in zip(self.begin, self.active[1:])]) if len(self.active) > 1 else self.states[:0]
        counts = np.bincount(before.astype(int) * len(start) + self.states[first:], minlength=len(start) ** 2).reshape(move.shape)
        with np.errstate(divide="ignore"):
            joint = sum(float((n[n > 0] * np.log(p[n > 0])).sum()) for n, p in ((seen, emit), (counts, move), (np.bincount(self.states[:first], minlength=len(start)), np.asarray(start))))
        diff = counts - expected
        by_param = []
        for k, by in enumerate(slopes):
            share = (seen[k] - np.bincount(self.codes, posterior[:, k], size)) / emit[k]
            by_param.append({name: -float((share * x).sum()) for name, x in by.items()})
        return joint - float(np.log(scale).sum()), -(diff - move * diff.sum(1, keepdims=True)), by_param


def _flat(found: tuple[float, np.ndarray, list[dict[str, float]]]) -> np.ndarray:
    value, by_move, by_param = found
    return np.concatenate([[value], by_move.ravel(), [g for own in by_param for g in own.values()]])


def fit(records: list[Record], start: np.ndarray, move: np.ndarray, params: list[Params], rate: float = 0.05, momentum: float = 0.85, epsilon: float = 0.1, steps: int = 300, by_columns: bool = False):
    """descend() on records that are here."""

    def total(now: np.ndarray, at: list[Params]) -> np.ndarray:
        return np.sum([_flat(gradients(r, start, now, at)) for r in records], axis=0)

    return descend(total, len(records), sum(len(r.states) for r in records), move, params, rate, momentum, epsilon, steps, by_columns)


def fit_table(table: DataFrame, keys: list[str], prepare: Callable[[pd.DataFrame], object], records: Callable[[list], list[Record]], start: np.ndarray, move: np.ndarray, params: list[Params], method: Callable, coded: Callable[[list], list[Coded]] | None = None, piece: int = 1000, **options):
    """A fit (descend, quasi_newton) to records that are the groups of a table, one row a column: each value is one pass over the records.

    What `prepare` makes of a group is stored as one row, so that a pass needs no shuffle; `records` makes records of a batch
    of these at once, so that they can share what they have in common. With `coded` in its place, `piece` groups at a time are made
    chains of codes when they are stored, and a pass runs these side by side. A task adds up its gradients, and a vector of fixed
    size (the value, the moves and the parameters) reaches the driver from all of them.
    """

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), piece):
                parts = [pa.RecordBatch.from_struct_array(rows.values).to_pandas() for rows in batch.column(0)[at : at + piece]]
                made = [prepare(p) for p in parts]
                rows = [(1, len(p), x) for p, x in zip(parts, made)] if coded is None else [(len(parts), sum(map(len, parts)), coded(made))]
                yield pa.record_batch({"groups": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "record": pa.array([pickle.dumps(r[2]) for r in rows], pa.binary())})

    grouped = table.groupBy(*keys).agg(F.collect_list(F.struct(*table.columns)).alias("__rows")).select("__rows")
    packed = stored(grouped.mapInArrow(ready, "groups long, n long, record binary"), "records")
    size = packed.agg(F.coalesce(F.sum("groups"), F.lit(0)).alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("columns")).first()

    def total(now: np.ndarray, at: list[Params]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat = None
            for batch in batches:
                stored_ = (pickle.loads(x.as_py()) for x in batch.column(0))
                every = (gradients(r, start, now, at) for r in records([*stored_])) if coded is None else (c.gradients(start, now, at) for own in stored_ for c in own)
                for found in every:
                    flat = _flat(found) if flat is None else flat + _flat(found)
            if flat is not None:
                yield pa.record_batch({"i": np.arange(len(flat), dtype=np.int32), "x": flat})

        found = packed.select("record").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        return np.array([r.x for r in found])

    return method(total, size.records, size.columns, move, params, **options)


def quasi_newton(total: Callable[[np.ndarray, list[Params]], np.ndarray], n_records: int, n_columns: int, move: np.ndarray, params: list[Params], epsilon: float = 0.1, steps: int = 300, reach: float = 1.0):
    """The same maximum by a quasi-Newton method (BFGS) with a line search; the best model met, and the history of values.

    The matrix that stands for the curvature is of the parameters' size and stays on the driver; each value with its gradients
    is one call of total, `steps` at most. No parameter moves by more than `reach` on its unbounded scale at once. The fit ends
    when two lines in a row have won less than epsilon.
    """
    names = [[*p] for p in params]
    n = move.size

    def model(x: np.ndarray) -> tuple[np.ndarray, list[Params]]:
        rest = iter(x[n:])
        return softmax(x[:n].reshape(move.shape)), [{name: bounded(name, next(rest)) for name in own} for own in names]

    history: list[float] = []

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        found = total(*model(x))
        history.append(float(found[0]))
        return -float(found[0]), found[1:]

    x = np.array([*np.log(move).ravel(), *(unbounded(name, v) for p in params for name, v in p.items())])
    if not n_records or not steps:
        return (-np.inf, move, params), history
    value, slope = at(x)
    inverse, small, fresh = np.eye(len(x)) / max(1.0, np.abs(slope).max()), 0, True
    while len(history) < steps and small < 2:
        way = -inverse @ slope
        down = float(slope @ way)
        if not down < 0:
            inverse, fresh = np.eye(len(x)) / max(1.0, np.abs(slope).max()), True
            way = -inverse @ slope
            down = float(slope @ way)
            if not down < 0:
                break
        t = min(1.0, reach / np.abs(way).max())
        while True:
            there, its_slope = at(x + t * way)
            if np.isfinite(there) and there <= value + 1e-4 * t * down:
                break
            curve = there - value - t * down
            t *= float(np.clip(-t * down / (2 * curve), 0.1, 0.5)) if np.isfinite(curve) and curve > 0 else 0.1
            if len(history) >= steps or t * np.abs(way).max() < 1e-9:
                return (-value, *model(x)), history
        step, change = t * way, its_slope - slope
        bend = float(step @ change)
        if bend > 1e-12 * np.linalg.norm(step) * np.linalg.norm(change):
            if fresh:
                inverse, fresh = np.eye(len(x)) * bend / float(change @ change), False
            left = np.eye(len(x)) - np.outer(step, change) / bend
            inverse = left @ inverse @ left.T + np.outer(step, step) / bend
        small = small + 1 if value - there < epsilon else 0
        x, value, slope = x + step, there, its_slope
    return (-value, *model(x)), history


def descend(total: Callable[[np.ndarray, list[Params]], np.ndarray], n_records: int, n_columns: int, move: np.ndarray, params: list[Params], rate: float, momentum: float, epsilon: float, steps: int, by_columns: bool = False):
    """Conditional maximum likelihood by gradient descent with momentum; the best model met, and the history of values.

    total gives, for moves and parameters, the summed value and the summed gradients of all records in one vector. Gradients
    of moves are divided by the records (by the columns if by_columns: the sums of long records are too large for a step),
    those of parameters by the columns. Descent ends when the value changes by less than epsilon.
    """
    z = np.log(move)
    x = [{name: unbounded(name, v) for name, v in p.items()} for p in params]
    vz, vx = np.zeros_like(z), [dict.fromkeys(p, 0.0) for p in params]
    best, history = (-np.inf, move, params), []
    for _ in range(steps if n_records else 0):
        now, at = softmax(z), [{name: bounded(name, v) for name, v in p.items()} for p in x]
        value, by_move, by_param = np.split(total(now, at), [1, 1 + z.size])
        history.append(float(value[0]))
        if history[-1] > best[0]:
            best = (history[-1], now, at)
        if len(history) > 1 and abs(history[-1] - history[-2]) < epsilon:
            break
        vz = momentum * vz - rate * by_move.reshape(z.shape) / max(1, n_columns if by_columns else n_records)
        z = z + vz
        slopes = iter(by_param / max(1, n_columns))
        for k, own in enumerate(x):
            for name in own:
                vx[k][name] = momentum * vx[k][name] - rate * next(slopes)
                own[name] += vx[k][name]
    return best, history
