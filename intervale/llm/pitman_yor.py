"""Hierarchical Pitman-Yor models on count arrays: seating in Chinese restaurants by Gibbs sweeps, averaged predictives."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
#: Sweeps before samples are taken, and samples whose predictives are averaged.
BURN, SAMPLES = 2, 3
#: A dish's customers are reseated one by one up to this many, then in blocks of this share of those already seated.
BLOCK = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, for draws that depend on nothing but their key."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seat(n: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables after n customers of each dish are seated anew: the first opens one, a later one does with probability
    weight / (weight + seated - discount * tables), where ``weight`` is (strength + discount * all tables) * the dish's
    base probability. Draws are functions of ``key`` and ``sweep``, so any task can repeat them."""
    order = np.argsort(-n, kind="stable")
    n, weight, key = n[order], weight[order], key[order].astype(_U) + _U((sweep + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    t = np.minimum(n, 1).astype(float)
    i, step = 1, 0
    while True:
        active = int(np.searchsorted(-n, -i))  # dishes with more than i customers
        if not active:
            break
        block = max(1, i // BLOCK)
        u = (mixed(key[:active] + _U(step * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> _U(11)).astype(float) * 2.0**-53
        a = weight[:active]
        p = a / (a + np.maximum(i - discount * t[:active], 1e-9))
        t[:active] += np.floor(np.minimum(block, n[:active] - i) * p + u)
        i, step = i + block, step + 1
    out = np.empty(len(n))
    out[order] = t
    return out


@dataclass
class Level:
    """Restaurants of one context length: ``n`` customers and ``t`` tables by (context, dish); ``up``: the row of the same
    dish in the shortened context's restaurant, which all contexts that shorten alike share."""

    context: np.ndarray
    dish: np.ndarray
    n: np.ndarray
    t: np.ndarray
    up: np.ndarray | None
    discount: float
    strength: float = 1.0

    def totals(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.context, self.n, size), np.bincount(self.context, self.t, size)

    def shares(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(what each row adds to its dish's probability, what each context leaves to the level above)."""
        n, t = self.totals(size)
        total = self.strength + n
        return (self.n - self.discount * self.t) / total[self.context], (self.strength + self.discount * t) / total


def discount_of(n: np.ndarray) -> float:
    """The usual estimate from the dishes met once and twice."""
    one, two = float((n == 1).sum()), float((n == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


class Model:
    """Levels from the longest context to none; ``sizes``: contexts of each level; ``dishes``: how many there are, alike at the
    base. ``shorten``: for each level but the last, its contexts' indices one level up."""

    def __init__(self, context: np.ndarray, dish: np.ndarray, n: np.ndarray, sizes: list[int], shorten: list[np.ndarray], dishes: int):
        self.sizes, self.shorten, self.dishes = sizes, shorten, dishes
        self.levels: list[Level] = []
        for k, size in enumerate(sizes):
            t = np.minimum(n, 1).astype(float)
            level = Level(context, dish, n.astype(float), t, None, discount_of(n))
            self.levels.append(level)
            if k + 1 < len(sizes):
                code = shorten[k][context].astype(np.int64) * dishes + dish
                codes, level.up = np.unique(code, return_inverse=True)
                n = np.bincount(level.up, t, len(codes))
                context, dish = codes // dishes, codes % dishes
        self.sweeps = 0

    def _probabilities(self) -> list[np.ndarray]:
        """For each level, the base probability of each of its rows."""
        base: list[np.ndarray] = [np.empty(0)] * len(self.levels)
        base[-1] = np.full(len(self.levels[-1].n), 1 / self.dishes)
        for k in range(len(self.levels) - 1, 0, -1):
            own, left = self.levels[k].shares(self.sizes[k])
            p = own + left[self.levels[k].context] * base[k]
            base[k - 1] = p[self.levels[k - 1].up]
        return base

    def sweep(self) -> None:
        """Reseat every customer, longest contexts first; their new tables are the customers one level up."""
        base = self._probabilities()
        for k, level in enumerate(self.levels):
            _, t = level.totals(self.sizes[k])
            weight = (level.strength + level.discount * t[level.context]) * base[k]
            key = level.context.astype(_U) * _U(0x100000001B3) + level.dish.astype(_U)
            level.t = seat(level.n, weight, level.discount, mixed(key + _U(k)), self.sweeps)
            if k + 1 < len(self.levels):
                up = self.levels[k + 1]
                up.n = np.bincount(level.up, level.t, len(up.n))
                up.t = np.minimum(up.t, up.n)
        self.sweeps += 1

    def dense(self, k: int) -> np.ndarray:
        """Predictive probabilities (context, dish) at level k under the present seating."""
        if k == len(self.levels):
            return np.full((1, self.dishes), 1 / self.dishes, np.float32)
        above = self.dense(k + 1)
        own, left = self.levels[k].shares(self.sizes[k])
        shorter = self.shorten[k] if k + 1 < len(self.levels) else np.zeros(self.sizes[k], np.int64)
        out = above[shorter]
        out *= left[:, None].astype(np.float32)
        out[self.levels[k].context, self.levels[k].dish] += own.astype(np.float32)  # a row's cell is its own
        return out

    def predictive(self) -> np.ndarray:
        """Probabilities of the longest contexts' dishes, averaged over SAMPLES sweeps after BURN."""
        for _ in range(BURN):
            self.sweep()
        total = np.zeros((self.sizes[0], self.dishes), np.float32)
        for _ in range(SAMPLES):
            self.sweep()
            total += self.dense(0)
        total /= SAMPLES
        return total
