"""Cutting-stock plan for a histogram of lengths: the configuration LP by multiplicative weights, then rounding.

A configuration is a multiset of lengths that fit one sequence. The LP asks
for the least total weight of configurations that covers every length's count.
Multiplicative weights keep a price for each length, which falls as the length
is covered; pricing is a knapsack by dynamic programming. One table of the
knapsack gives the best configuration with each length as its first, and all
whose price is within NEAR of the greatest gain weight in a step, until every
length is covered. Rounding takes the configurations that fill a sequence, by
falling weight, each as often as its weight says (rounded up) and the counts
allow, up to a share of each length; what is left, which has all lengths in
proportion, goes best-fit into sequences of its own. Of several shares, the one
that needs the fewest sequences is taken. Best-fit alone is the share of none,
so the plan never needs more sequences than best-fit does.

The work depends on the number of different lengths (at most the capacity),
never on the number of pieces.
"""

from __future__ import annotations

import bisect
import math

import numpy as np

Configuration = tuple[tuple[int, int], ...]  # (length, how often), longest first


#: Configurations within this share of the greatest price gain weight together, at most so many in a step.
NEAR, TOGETHER = 0.03, 48
#: Shares of the pieces that rounding may place; of equal plans, the first.
SHARES = (1.0, 0.97, 0.94, 0.9, 0.8, 0.65, 0.5, 0.35, 0.2, 0.1)


class Knapsack:
    """The configurations of the greatest price, for every first length. sizes: rising."""

    def __init__(self, sizes: np.ndarray, price: np.ndarray, capacity: int):
        self.sizes = sizes
        best = np.zeros(capacity + 1)
        pick = np.full(capacity + 1, -1, np.int64)
        fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
        turned = best[::-1]  # best[c - s] for rising s, read backwards
        dense = len(sizes) == sizes[-1] - sizes[0] + 1
        low = int(sizes[0])
        for c in range(low, capacity + 1):
            n = int(fit[c])
            # Without gaps between lengths, the values to compare lie side by side.
            value = (turned[capacity - c + low : capacity - c + low + n] if dense else best[c - sizes[:n]]) + price[:n]
            i = int(value.argmax())
            if value[i] > best[c - 1]:
                best[c], pick[c] = value[i], i
            else:
                best[c] = best[c - 1]
        self.pick = pick
        self.value = best[capacity - sizes] + price
        self.capacity = capacity

    def using(self, first: int) -> dict[int, int]:
        """index -> how often, of the best configuration with the length first."""
        used = {first: 1}
        c = self.capacity - int(self.sizes[first])
        while c >= self.sizes[0]:
            if self.pick[c] < 0:
                c -= 1
            else:
                i = int(self.pick[c])
                used[i] = used.get(i, 0) + 1
                c -= int(self.sizes[i])
        return used


def fractional(counts: dict[int, int], capacity: int, step: float = 0.25, eta: float = 8.0) -> dict[Configuration, float]:
    """Weights of configurations that together cover counts."""
    sizes = np.array(sorted(counts), np.int64)
    need = np.array([counts[s] for s in sizes.tolist()], float)
    done = np.zeros(len(sizes))
    x: dict[Configuration, float] = {}
    while (done < need).any():
        dearest = Knapsack(sizes, np.exp(-eta * done / need) * sizes / capacity, capacity)
        order = np.argsort(-dearest.value, kind="stable")
        order = order[dearest.value[order] >= (1 - NEAR) * dearest.value[order[0]]][:TOGETHER]
        before = done.copy()
        # Lengths not covered yet that no dear configuration has still move: the least covered one comes first.
        for first in [int(np.argmin(done / need)), *order.tolist()]:
            used = dearest.using(first)
            ids, often = np.array(list(used)), np.array(list(used.values()), float)
            if (done[ids] > before[ids]).any():  # each length moves once in a step
                continue
            add = step * float((need[ids] / often).min())
            config = tuple(sorted(((int(sizes[i]), n) for i, n in used.items()), reverse=True))
            x[config] = x.get(config, 0.0) + add
            done[ids] += add * often
    return x


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Best-fit decreasing on counts: alike sequences are one entry, however many there are."""
    open_: list[tuple[int, Configuration, int]] = []  # (free, content, how many), by free
    out: list[tuple[Configuration, int]] = []
    for s in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        left = counts[s]
        while left:
            i = bisect.bisect_left(open_, (s,))
            free, content, many = open_.pop(i) if i < len(open_) else (capacity, (), 1 << 62)
            each = free // s
            whole = min(many, left // each)
            if whole:
                bisect.insort(open_, (free - each * s, (*content, (s, each)), whole))
                left -= whole * each
            elif left:
                bisect.insort(open_, (free - left * s, (*content, (s, left)), 1))
                left, whole = 0, 1
            if content and many > whole:
                bisect.insort(open_, (free, content, many - whole))
    out += [(content, many) for _, content, many in open_]
    return out


def rounded(x: dict[Configuration, float], counts: dict[int, int], capacity: int, share: float) -> tuple[list[tuple[Configuration, int]], dict[int, int]]:
    """Full configurations of x with how many sequences each has, for share of the pieces, and the counts that they leave."""
    rest, out = dict(counts), []
    kept = {s: math.floor((1 - share) * n) for s, n in counts.items()}
    left = math.ceil(share * sum(counts.values()))
    for config, weight in sorted(x.items(), key=lambda e: (-e[1], e[0])):
        many = min(math.ceil(weight), left // sum(n for _, n in config), *((rest[s] - kept[s]) // n for s, n in config))
        if many > 0 and sum(s * n for s, n in config) == capacity:
            out.append((config, many))
            for s, n in config:
                rest[s] -= n * many
                left -= n * many
    return out, {s: n for s, n in rest.items() if n > 0}


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations with how many sequences each has; together they hold exactly counts."""
    counts = {s: n for s, n in counts.items() if n > 0}
    full = [(((capacity, 1),), counts.pop(capacity))] if capacity in counts else []
    if not counts:
        return full
    x = fractional(counts, capacity)
    found: list[list[tuple[Configuration, int]]] = []
    for share in SHARES:
        chosen, rest = rounded(x, counts, capacity, share)
        found.append(chosen + best_fit(rest, capacity))
    return full + min([*found, best_fit(counts, capacity)], key=lambda p: sum(m for _, m in p))
