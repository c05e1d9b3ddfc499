"""Configuration linear program of bin packing over a histogram of lengths.

Columns are configurations (multisets of lengths within the capacity), rows are lengths with their counts as demand, and
multiplicative weights take the place of dual prices. A round prices all columns at once by a knapsack dynamic program over the
capacity. That gives the round's dual bound (what the prices are worth over the best column's value; the best one over all rounds
bounds every packing from below) and, for each length, the best configuration that holds it. Those within EPSILON of the best form
the round's fractional packing; a length that it covers less than others gains weight, one that it covers more loses it. The
solution of the program is the average of the rounds; what that leaves of a demand is covered by rounds that take every length.

Rounding: the columns, in order, get whole multiples of which the running sum follows that of the fractional ones, as far as items
are left. The few items that this leaves go through rounds of the same kind in whole numbers, and the last ones by best fit,
longest first. The work depends on the capacity and on the rounds, not on the documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from typing import NamedTuple

import numpy as np

#: Rounds of a run of the program; runs differ in how fast weights move at first and in the end, how fast that slows down, and which share
#: of the best value a column may lack. Slow ones suit histograms that fill nearly every bin, fast ones those with few lengths.
ROUNDS = 40
RUNS = ((0.02, 0.02, 1.0, 0.004), (0.4, 0.05, 0.9, 0.03))
EPSILON, ETA = 0.004, 0.02  # of the rounds in whole numbers
#: Whole rounds: share of what is left that one takes, and so many at most before best fit.
STEP, WHOLE = 0.5, 60
#: Start of the dual prices: items over half or a third of the capacity, of which few share a bin, are worth more than their length.
FIRST = 0.03

Configuration = tuple[tuple[int, int], ...]  # (length, copies), longest first


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value at each capacity, and the item taken there (-1: none fits)."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        if k:
            values = best[c - lengths[:k]] + weights[:k]
            i = int(values.argmax())
            best[c], taken[c] = values[i], i
    return best, taken


def best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Best fit, longest first, of what is left: configurations and how often each is used."""
    rooms: list[int] = []  # sorted free sizes
    open_bins: dict[int, list[list[int]]] = {}
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms.pop(i)
                items = open_bins[room].pop()
            else:
                room, items = capacity, []
            items.append(length)
            room -= length
            insort(rooms, room)
            open_bins.setdefault(room, []).append(items)
    return Counter(as_configuration(items) for bins in open_bins.values() for items in bins)


def as_configuration(items: list[int]) -> Configuration:
    return tuple(sorted(Counter(items).items(), reverse=True))


class Solution(NamedTuple):
    """Of the linear program: columns with their multiples, their sum, and the bound that the prices prove."""

    columns: dict[Configuration, float]
    value: float
    bound: float


class Prices:
    """Weights of the lengths, and the columns that they price best."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity = capacity
        self.all = np.array(sorted(lengths), np.int64)
        self.bias = np.zeros(len(self.all))
        first = 1 + FIRST * ((2 * self.all > capacity) * 1.0 + (3 * self.all > capacity))
        self.start = self.all / capacity * first

    def round(self, lengths: np.ndarray, slack: float):
        """(best value, configurations by falling value): one for each length whose value is within ``slack`` of the best."""
        weights = (self.start * np.exp(self.bias))[np.searchsorted(self.all, lengths)]
        best, taken = price(lengths, weights, self.capacity)
        value = weights + best[self.capacity - lengths]
        top = value.max()

        def columns():
            for i in np.argsort(-value, kind="stable"):
                if value[i] < (1 - slack) * top:
                    return
                items, room = [int(lengths[i])], self.capacity - int(lengths[i])
                while room > 0 and taken[room] >= 0:
                    items.append(int(lengths[taken[room]]))
                    room -= items[-1]
                yield as_configuration(items)

        return weights, float(top), columns()

    def move(self, covered: dict[int, float], eta: float = ETA) -> None:
        """Lengths that were covered less than the mean gain weight."""
        mean = sum(covered.values()) / len(covered)
        at = np.searchsorted(self.all, np.array(list(covered), np.int64))
        self.bias[at] += eta * (mean - np.array(list(covered.values())))


def fill(quota: dict, left: dict, columns, whole: bool):
    """Take each column as often as its items' quota allows, off ``quota`` and ``left``; yields (column, times)."""
    for configuration in columns:
        times = min(quota.get(n, 0) // k if whole else quota.get(n, 0.0) / k for n, k in configuration)
        if times > 1e-9:
            for n, k in configuration:
                quota[n] -= times * k
                left[n] -= times * k
            yield configuration, times


def relax(histogram: dict[int, int], capacity: int) -> Solution:
    """The fractional solution for the demands of ``histogram``: the better of the runs, and the best bound that any of them proves."""
    runs = [run(histogram, capacity, *how) for how in RUNS]
    best = min(runs, key=lambda r: r.value)
    return best._replace(bound=max(r.bound for r in runs))


def run(histogram: dict[int, int], capacity: int, eta: float, last: float, slower: float, epsilon: float) -> Solution:
    prices = Prices(list(histogram), capacity)
    lengths, demand = prices.all, np.array([histogram[n] for n in sorted(histogram)], float)
    columns: dict[Configuration, float] = {}
    covered = dict.fromkeys(histogram, 0.0)
    bound = float((lengths * demand).sum()) / capacity
    for turn in range(ROUNDS):
        weights, top, found = prices.round(lengths, epsilon)
        bound = max(bound, float((weights * demand).sum()) / top)
        quota = {n: float(c) for n, c in histogram.items()}
        for configuration, times in fill(quota, dict(quota), found, False):
            columns[configuration] = columns.get(configuration, 0.0) + times / ROUNDS
        share = {n: 1 - quota[n] / c for n, c in histogram.items()}
        for n, x in share.items():
            covered[n] += x / ROUNDS
        prices.move(share, max(last, eta * slower**turn))
    left = {n: c * (1 - covered[n]) for n, c in histogram.items() if c * (1 - covered[n]) > 1e-9}
    while left:
        _, _, found = prices.round(np.array(sorted(left), np.int64), 1.0)
        for configuration, times in fill(dict(left), left, found, False):
            columns[configuration] = columns.get(configuration, 0.0) + times
        left = {n: c for n, c in left.items() if c > 1e-6}
    return Solution(columns, sum(columns.values()), bound)


def rounded(solution: Solution, left: dict[int, int]) -> Counter:
    """Whole multiples of the columns, taken off ``left``: their running sum follows that of the fractional ones."""
    used: Counter = Counter()
    total, taken = 0.0, 0
    for configuration, times in sorted(solution.columns.items(), reverse=True):
        total += times
        whole = min(int(total + 0.5) - taken, min(left[n] // k for n, k in configuration))
        if whole > 0:
            used[configuration] += whole
            taken += whole
            for n, k in configuration:
                left[n] -= whole * k
    return used


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations and multiplicities that hold every item of ``histogram`` (length to count) exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("lengths must lie within the capacity")
    used: Counter = Counter()
    if capacity in left:
        used[((capacity, 1),)] += left.pop(capacity)
    if left:
        used += rounded(relax(left, capacity), left)
    prices = Prices(list(left), capacity) if left else None
    for turn in range(WHOLE):
        left = {n: c for n, c in left.items() if c > 0}
        if sum(left.values()) < 64:
            break
        before = dict(left)
        step = STEP if turn < WHOLE // 2 else 1.0
        quota = {n: -int(-c * step // 1) for n, c in left.items()}
        _, _, found = prices.round(np.array(sorted(left), np.int64), EPSILON if turn < WHOLE // 3 else 1.0)
        for configuration, times in fill(quota, left, found, True):
            used[configuration] += times
        if left == before and turn >= WHOLE // 2:
            break
        prices.move({n: (c - left[n]) / c for n, c in before.items()})
    used.update(best_fit({n: c for n, c in left.items() if c > 0}, capacity))
    return sorted(used.items(), reverse=True)


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    return -(-sum(n * c for n, c in histogram.items()) // capacity)
