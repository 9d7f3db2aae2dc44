"""Exact choice of one grid point for each device under a shared budget.

A small multiple-choice knapsack: labels (cost, utility, ...) grow device by device and dominated
ones go. Devices come in order of their id; ties fall to the lexicographically least choice.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-4
DELTA = 1e-8
TIGHT = 1e-12


def _labels(cost: list[np.ndarray], value: list[np.ndarray], budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Pareto labels (cost rising, value rising) of all choices within the budget."""
    c, v = np.zeros(1), np.zeros(1)
    least = np.cumsum([0.0, *(x.min() for x in cost[::-1])])[::-1]
    for k, (ck, vk) in enumerate(zip(cost, value, strict=True)):
        c2, v2 = (c[:, None] + ck).ravel(), (v[:, None] + vk).ravel()
        keep = c2 + least[k + 1] <= budget + TIGHT
        c2, v2 = c2[keep], v2[keep]
        order = np.lexsort((-v2, c2))
        c2, v2 = c2[order], v2[order]
        best = np.maximum.accumulate(v2)
        first = np.r_[True, v2[1:] > best[:-1] + 1e-15] if len(v2) else np.empty(0, dtype=bool)
        c, v = c2[first], v2[first]
    return c, v


def best_utility(cost: list[np.ndarray], value: list[np.ndarray], budget: float) -> float:
    _, v = _labels(cost, value, budget)
    return float(v[-1]) if len(v) else -math.inf


def least_cost(cost: list[np.ndarray], value: list[np.ndarray], budget: float, floor: float) -> float:
    c, v = _labels(cost, value, budget)
    ok = v >= floor - 1e-12
    return float(c[ok][0]) if ok.any() else math.inf


def _least_third(cost, value, third, budget: float, floor: float, ceiling: float) -> float:
    """Least sum of third among choices with cost <= ceiling (and budget) and value >= floor."""
    top = np.cumsum([0.0, *(x.max() for x in value[::-1])])[::-1]
    low = np.cumsum([0.0, *(x.min() for x in cost[::-1])])[::-1]
    limit = min(budget, ceiling) + TIGHT
    states = np.zeros((1, 3))
    for k in range(len(cost)):
        new = (states[:, None, :] + np.stack([cost[k], value[k], third[k]], axis=1)[None]).reshape(-1, 3)
        new = new[(new[:, 0] + low[k + 1] <= limit) & (new[:, 1] + top[k + 1] >= floor - 1e-12)]
        states = _undominated(new)
    return float(states[:, 2].min()) if len(states) else math.inf


def _undominated(x: np.ndarray) -> np.ndarray:
    """Rows (cost, value, third) that none other matches in all three; approximately least by a sweep in cost order."""
    x = np.unique(np.round(x, 15), axis=0)
    out: list[np.ndarray] = []
    front = np.empty((0, 2))
    for row in x[np.lexsort((x[:, 2], -x[:, 1], x[:, 0]))]:
        if not len(front) or not ((front[:, 0] >= row[1]) & (front[:, 1] <= row[2])).any():
            out.append(row)
            front = np.vstack([front[~((front[:, 0] <= row[1]) & (front[:, 1] >= row[2]))], [row[1], row[2]]])
    return np.array(out).reshape(-1, 3)


def _first_choice(cost, value, third, budget: float, floor: float, ceiling: float, third_ceiling: float) -> list[int] | None:
    """Lexicographically least grid indices within all bounds, found device by device with look-ahead."""
    n = len(cost)
    chosen: list[int] = []
    limit = min(budget, ceiling)
    c0 = v0 = t0 = 0.0
    for k in range(n):
        for j in range(len(cost[k])):
            c, v, t = c0 + cost[k][j], v0 + value[k][j], t0 + third[k][j]
            rest = _least_third(cost[k + 1 :], value[k + 1 :], third[k + 1 :], limit - c, floor - v, limit - c) if k + 1 < n else (0.0 if c <= limit + TIGHT and v >= floor - 1e-12 else math.inf)
            if t + rest <= third_ceiling + TIGHT:
                chosen.append(j)
                c0, v0, t0 = c, v, t
                break
        else:
            return None
    return chosen


def solve_macro(rates: np.ndarray, utility: np.ndarray, variance: np.ndarray, weights: np.ndarray, budget: float) -> dict:
    """Best mean utility; then least cost, then least variance, then least rates, each within slack of the ones before.

    utility, variance: clients x grid. Returns choice (grid indices), objective (mean utility) and status.
    """
    k = len(utility)
    cost = [w * rates for w in weights]
    value = [u / k for u in utility]
    spread = [v / k for v in variance]
    best = best_utility(cost, value, budget)
    if best == -math.inf:
        return {"status": "EXCLUDED", "choice": None, "objective": None}
    c = least_cost(cost, value, budget, best - EPS + DELTA)
    v = _least_third(cost, value, spread, budget, best - EPS + DELTA, c + EPS - DELTA)
    choice = _first_choice(cost, value, spread, budget, best - EPS, c + EPS, v + EPS)
    return {"status": "OPTIMAL", "choice": choice, "objective": best}


def tail_size(k: int, quantile: float = 0.25) -> int:
    return max(1, math.ceil(quantile * k))


def worst_sum(u: np.ndarray, q: int) -> float:
    return float(np.sort(u)[:q].sum())


def solve_minimax(rates: np.ndarray, utility: np.ndarray, variance: np.ndarray, weights: np.ndarray, forbidden: np.ndarray, budget: float, quantile: float = 0.25) -> dict:
    """Greatest sum of the q least client utilities; then mean utility, cost and rates, each within slack.

    For a fixed level the sum of the q least is q x level + sum of min(u, level) - K x level at most, with equality
    at the q-th least utility, so the levels to try are the utilities themselves.
    """
    k = len(utility)
    q = tail_size(k, quantile)
    allowed = [np.flatnonzero(~f) for f in forbidden]
    cost = [w * rates[a] for w, a in zip(weights, allowed, strict=True)]
    value = [u[a] for u, a in zip(utility, allowed, strict=True)]
    levels = np.unique(np.concatenate(value))
    best = -math.inf
    for level in levels:
        top = best_utility(cost, [np.minimum(v, level) for v in value], budget)
        best = max(best, top - (k - q) * level)
    if best == -math.inf:
        return {"status": "EXCLUDED", "choice": None, "objective": None}
    floor = best - q * EPS
    # Among choices that keep the floor: the greatest mean utility, by levels again (a lower bound on min(u, level)).
    found: tuple | None = None
    for level in levels:
        need = floor + (k - q) * level
        low = [np.minimum(v, level) for v in value]
        u = _greatest_second(cost, low, value, budget, need)
        if found is None or u > found[0] + 1e-12:
            found = (u, level)
    mean, level = found
    low = [np.minimum(v, level) for v in value]
    choice = _first_second(cost, low, value, budget, floor + (k - q) * level, mean - EPS * k)
    return {"status": "OPTIMAL", "choice": [int(a[j]) for a, j in zip(allowed, choice, strict=True)] if choice else None, "objective": best}


def _greatest_second(cost, first, second, budget: float, need: float) -> float:
    """Greatest sum of second among choices within the budget whose sum of first is at least need."""
    least = _least_third(cost, first, [-s for s in second], budget, need, budget)
    return -least


def _first_second(cost, first, second, budget: float, need: float, floor: float) -> list[int] | None:
    return _first_choice(cost, first, [-s for s in second], budget, need, budget, -floor)


def solve_greedy(rates: np.ndarray, utility: np.ndarray, weights: np.ndarray, budget: float, cap: float) -> list[int]:
    """Steps of one grid point, best utility for its cost first, while any fits."""
    at = [0] * len(utility)
    left = budget
    while True:
        steps = []
        for k, j in enumerate(at):
            if j + 1 >= len(rates) or rates[j + 1] > cap + TIGHT:
                continue
            price = weights[k] * (rates[j + 1] - rates[j])
            gain = utility[k][j + 1] - utility[k][j]
            if price <= left + TIGHT:
                steps.append((-(math.inf if price <= TIGHT else gain / price), -gain, price, k, rates[j + 1]))
        if not steps:
            return at
        _, _, price, k, _ = min(steps)
        at[k] += 1
        left = max(0.0, left - price)
