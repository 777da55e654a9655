"""Logistic regression and linear support vectors whose coefficients are never gathered.

A coefficient per term is far more than a number per text, so the minimisers keep what has one number per text: a
gradient is the transposed (standardised, centred) matrix times a vector with a number per row, hence given by that
vector. ``products`` multiplies by the matrix and its transpose where the terms are. The steps are those of
``pyspark.ml``: breeze's L-BFGS with a strong Wolfe search for the logistic model; its OWL-QN, which drops single
coordinates of steps and directions, for the support vectors. There a block of terms repeats the steps so far on its own
coefficients, from the vectors of all gradients.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Pairs of steps and gradient differences that are remembered.
MEMORY = 10


class SearchFailed(Exception):
    """A line search or a direction that breeze would give up on."""


def _two_loops(sy: np.ndarray, yy: np.ndarray, sg: np.ndarray, yg: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The factors of steps, gradient differences (latest first) and gradient in the L-BFGS direction, from their inner products."""
    m, diag = len(sg), 1.0
    if m:
        if not sy[0, 0] >= 0:
            raise SearchFailed("curvature")
        diag = sy[0, 0] / yy[0, 0] if yy[0, 0] else math.nan
    by_s, by_y = np.zeros(m), np.zeros(m)
    for i in range(m):
        by_y[i] = -(sg[i] + sy[i] @ by_y) / sy[i, i] if sy[i, i] else math.nan
        if math.isnan(by_y[i]):
            raise SearchFailed("curvature")
    first = -by_y
    by_y *= diag
    for i in reversed(range(m)):
        by_s[i] = first[i] - (diag * yg[i] + yy[i] @ by_y + sy[:, i] @ by_s) / sy[i, i]
    return -by_s, -by_y, -diag


def _cubic(a: tuple, b: tuple) -> float:
    """Minimum of the cubic through two points (t, value, slope), kept off their ends."""
    d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
    inner = d1 * d1 - a[2] * b[2]
    d2 = math.sqrt(inner) if inner >= 0 else math.nan
    wide, low = b[0] - a[0], a[0]
    below = b[2] - a[2] + 2 * d2
    t = b[0] - wide * (b[2] + d2 - d1) / below if below else math.nan
    return low + 0.1 * wide if t < low + 0.1 * wide else low + 0.9 * wide if t > low + 0.9 * wide else t


def _strong_wolfe(phi: Callable[[float], tuple[float, float]], t: float) -> float:
    """Step of breeze's ``StrongWolfeLineSearch``; ``phi`` gives value and slope."""
    def at(t: float) -> tuple:
        return (t, *phi(t))
    low = at(0.0)
    value, slope = low[1:]
    if slope > 0:
        raise SearchFailed("no descent")

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(10):
            c = at(_cubic(high, low) if low[0] > high[0] else _cubic(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed("zoom")
    for i in range(10):
        c = at(t)
        if not math.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed("steps")


# --- logistic regression -----------------------------------------------------------
@dataclass
class _Vector:
    """Coefficients per class as the transposed matrix times ``rows``; ``margins`` is the matrix times them; ``shift`` the intercepts."""

    rows: np.ndarray
    margins: np.ndarray
    shift: np.ndarray

    def dot(self, other: _Vector) -> float:
        return float((self.rows * other.margins).sum() + (self.shift * other.shift).sum())

    def plus(self, other: _Vector, by: float = 1.0) -> _Vector:
        return _Vector(self.rows + by * other.rows, self.margins + by * other.margins, self.shift + by * other.shift)

    def norm(self) -> float:
        return math.sqrt(max(0.0, self.dot(self)))


def _log_loss(margins: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss and its derivatives by margin; one column is the margin of class 1, more are a margin per class."""
    n = len(y)
    if margins.shape[1] == 1:
        m = margins[:, 0]
        loss = np.logaddexp(0.0, -m) + np.where(y > 0, 0.0, m)
        with np.errstate(over="ignore"):
            return float(loss.sum() / n), ((1.0 / (1.0 + np.exp(-m)) - y) / n)[:, None]
    m = margins - margins.max(axis=1, keepdims=True)
    e = np.exp(m)
    total = e.sum(axis=1, keepdims=True)
    slope = e / total
    slope[np.arange(n), y] -= 1.0
    return float((np.log(total[:, 0]) - m[np.arange(n), y]).sum() / n), slope / n


def logistic(products: Callable[[np.ndarray], np.ndarray], y: np.ndarray, classes: int, rounds: int, penalty: float, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(rows, intercepts, loss per round) of ``pyspark.ml``'s LogisticRegression with an L2 penalty.

    ``products(a)`` is the centred, standardised matrix times its transpose times ``a``, one column per class (one for two classes).
    """
    seen = np.bincount(y, minlength=classes).astype(float)
    if classes <= 2:
        shift = np.array([math.log(seen[1] / seen[0])])
    else:
        shift = np.log1p(seen) - np.log1p(seen).mean()
    zero = np.zeros((len(y), len(shift)))

    def loss(x: _Vector) -> tuple[float, np.ndarray]:
        value, slope = _log_loss(x.margins + x.shift, y)
        return value + 0.5 * penalty * float((x.rows * x.margins).sum()), slope

    def gradient(x: _Vector, slope: np.ndarray) -> _Vector:
        return _Vector(slope + penalty * x.rows, products(slope) + penalty * x.margins, slope.sum(axis=0))
    x = _Vector(zero, zero, shift)
    value, slope = loss(x)
    g, steps, turns, failed, history, k = gradient(x, slope), [], [], False, [value], 0
    while k < rounds and g.norm() > max(tol * value, 1e-8):
        try:
            inner = lambda a, b: np.array([[p.dot(q) for q in b] for p in a]).reshape(len(a), len(b))
            by_s, by_y, by_g = _two_loops(inner(steps, turns), inner(turns, turns), inner(steps, [g])[:, 0], inner(turns, [g])[:, 0])
            way = _Vector(by_g * g.rows, by_g * g.margins, by_g * g.shift)
            for f, v in [*zip(by_s, steps), *zip(by_y, turns)]:
                way = way.plus(v, f)

            def phi(t: float) -> tuple[float, float]:
                at = x.plus(way, t)
                value, slope = loss(at)
                return value, float((slope * way.margins).sum() + penalty * (at.rows * way.margins).sum() + (slope.sum(axis=0) * way.shift).sum())
            t = _strong_wolfe(phi, 1.0 / way.norm() if k == 0 else 1.0)
            if t * g.norm() < 1e-10:
                raise SearchFailed("step")
        except SearchFailed:
            if failed:
                break
            failed, steps, turns = True, [], []
            continue
        new = x.plus(way, t)
        value, slope = loss(new)
        turned = gradient(new, slope)
        steps, turns = [new.plus(x, -1.0), *steps][:MEMORY], [turned.plus(g, -1.0), *turns][:MEMORY]
        x, g, failed, k = new, turned, False, k + 1
        history.append(value)
    return x.rows, x.shift, history


# --- support vectors ---------------------------------------------------------------
@dataclass
class Steps:
    """What a block of terms needs to repeat a minimiser's steps: a vector with a number per row for each gradient, and for each step the factors of the direction and its length."""

    rows: list = field(default_factory=list)
    moves: list[tuple] = field(default_factory=list)


def moved(x: np.ndarray, g: np.ndarray, way: np.ndarray, t: float) -> np.ndarray:
    """A step that ends at 0 in the coordinates that would change their sign."""
    new = x + t * way
    return np.where(np.sign(new) == np.where(x != 0, np.sign(x), np.sign(-g)), new, 0.0)


def direction(g: np.ndarray, steps: list, turns: list, by_s: np.ndarray, by_y: np.ndarray, by_g: float) -> np.ndarray:
    """The direction of these factors where it goes against the gradient, else 0."""
    way = by_g * g
    for f, v in [*zip(by_s, steps), *zip(by_y, turns)]:
        way = way + f * v
    return np.where(way * g < 0, way, 0.0)


def repeated(gradient: Callable[[object], np.ndarray], done: Steps) -> tuple[np.ndarray, np.ndarray, list, list]:
    """(coefficients, gradient, steps, gradient differences) after the steps done, of the terms that ``gradient`` covers."""
    g, steps, turns = gradient(done.rows[0]), [], []
    x = np.zeros(len(g))
    for rows, move in zip(done.rows[1:], done.moves):
        if move is None:
            steps, turns = [], []
            continue
        way, t = direction(g, steps, turns, *move[:3]), move[3]
        new, turned = moved(x, g, way, t), gradient(rows)
        steps, turns = [new - x, *steps][:MEMORY], [turned - g, *turns][:MEMORY]
        x, g = new, turned
    return x, g, steps, turns


def inner_products(gradient: Callable[[object], np.ndarray], done: Steps) -> np.ndarray:
    """Inner products of steps, gradient differences and gradient with each other."""
    _, g, steps, turns = repeated(gradient, done)
    basis = np.array([*steps, *turns, g])
    return basis @ basis.T


def trials(gradient: Callable[[object], np.ndarray], done: Steps, factors: tuple, lengths: list[float]) -> list[np.ndarray]:
    """The direction and the coefficients after steps of these lengths."""
    x, g, steps, turns = repeated(gradient, done)
    way = direction(g, steps, turns, *factors)
    return [way, *[moved(x, g, way, t) for t in lengths]]


def support_vectors(gram: Callable[[Steps], np.ndarray], margins: Callable[[Steps, tuple, list[float]], np.ndarray], keep: Callable[[np.ndarray], object],
                    y: np.ndarray, rounds: int, tol: float = 1e-6) -> tuple[Steps, list[float]]:
    """The steps of ``pyspark.ml``'s LinearSVC without penalty for labels 0 and 1, and the loss per round.

    ``gram`` adds up ``inner_products`` over all blocks, ``margins`` what the direction and the coefficients of ``trials``
    give each row (a column each); the intercept is a term that every row has. ``keep`` makes known to the blocks a vector
    with the number of rows times the derivative of each.
    """
    n, sign = len(y), 2.0 * y - 1.0

    def loss(m: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and ``n`` times its derivatives, whole numbers: what cancels in a gradient is 0 whatever the order of sums."""
        near = sign * m < 1.0
        return float(np.where(near, 1.0 - sign * m, 0.0).sum() / n), np.where(near, -sign, 0.0).astype(np.int8)
    value, slope = loss(np.zeros(n))
    done, failed, history, k, size = Steps([keep(slope)]), False, [value], 0, 0
    while k < rounds:
        products = gram(done)
        norm = math.sqrt(products[-1, -1])
        if norm <= max(tol * value, 1e-8):
            break
        try:
            s, u = slice(0, size), slice(size, 2 * size)
            factors = _two_loops(products[s, u], products[u, u], products[s, -1], products[u, -1])
            shrink, t = (0.1, 0.5 / norm) if k == 0 else (0.5, 1.0)
            # breeze takes the value before the step for that of its first length, so that is always shrunk
            t, known = t * shrink, {}
            for i in range(1, 20):
                if t not in known:
                    # the first length says little, later ones are mostly taken
                    asked = [t, *[t := t * 2.1 for _ in range(3)]] if k == 0 else [t]
                    t = asked[0]
                    found = margins(done, factors, asked)
                    way, known = found[:, 0], {a: found[:, j + 1] for j, a in enumerate(asked)}
                at, turned = loss(known[t])
                first, now = float(slope @ way) / n, float(turned @ way) / n
                by = shrink if at > value + t * first * 1e-4 else 2.1 if now < 0.9 * first else shrink if now > -0.9 * first else 1.0
                if by == 1.0 or i == 19:
                    break
                if not 1e-10 <= t * by <= 1e10:
                    raise SearchFailed("step")
                t *= by
        except SearchFailed:
            if failed:
                break
            # breeze goes on without its memory
            failed, size = True, 0
            done.rows.append(done.rows[-1])
            done.moves.append(None)
            continue
        value, slope = at, turned
        done.rows.append(keep(slope))
        done.moves.append((*factors, t))
        failed, size, k = False, min(size + 1, MEMORY), k + 1
        history.append(value)
    return done, history
