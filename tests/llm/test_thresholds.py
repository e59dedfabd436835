"""The threshold of the quality rules against a search over all cuts."""

from collections import namedtuple

import numpy as np
import pytest

from floorflow.llm import anomaly

Bin = namedtuple("Bin", "bin bad good")


def _brute(known):
    good, bad = sum(b.good for b in known), sum(b.bad for b in known)
    if not good or not bad:
        return 2.0
    gains = []
    for cut in range(anomaly.BINS + 1):
        caught, lost = (sum(getattr(b, f) for b in known if b.bin >= cut) for f in ("bad", "good"))
        gains.append(caught / bad - anomaly.GOOD_WEIGHT * lost / good)
    top = max(gains)
    if top <= 0:
        return 2.0
    first = gains.index(top)
    last = first
    while last < anomaly.BINS and gains[last + 1] == top:
        last += 1
    return (first + last) / 2 / anomaly.BINS


@pytest.mark.parametrize("seed", range(6))
def test_threshold_matches_a_search_over_all_cuts(seed, monkeypatch):
    monkeypatch.setattr(anomaly, "BINS", 64)
    rng = np.random.default_rng(seed)
    known = [Bin(int(b), int(rng.integers(0, 4)), int(rng.integers(0, 30))) for b in rng.choice(65, 20, replace=False)]
    assert anomaly._threshold(known) == _brute(known)


def test_threshold_edges(monkeypatch):
    monkeypatch.setattr(anomaly, "BINS", 64)
    assert anomaly._threshold([]) == 2.0
    assert anomaly._threshold([Bin(3, 5, 0)]) == 2.0 and anomaly._threshold([Bin(3, 0, 5)]) == 2.0
    assert anomaly._threshold([Bin(5, 9, 900), Bin(3, 0, 100)]) == 2.0  # no cut is worth its price
    for known in ([Bin(10, 0, 90), Bin(40, 9, 0)], [Bin(10, 3, 900), Bin(40, 9, 0), Bin(64, 1, 0)]):
        assert anomaly._threshold(known) == _brute(known) == 25.5 / 64


@pytest.mark.parametrize("n", [40, 333, 499, 500, 501, 3300])
def test_verdicts_do_not_change_with_the_number_of_rows(n):
    """The same two kinds of rows, one in a hundred good ones odd: the cut
    stays between them at every size, 500 good rows being nothing special."""
    rng = np.random.default_rng(n)
    scores = [(s, 0) for s in rng.normal(0.65, 0.03, max(3, n // 11))] + [(s, 1) for s in rng.normal(0.42, 0.03, n)]
    scores += [(0.7, 1)] * (n // 200)
    bins = {}
    for s, good in scores:
        bins.setdefault(int(s * anomaly.BINS), [0, 0])[good] += 1
    cut = anomaly._threshold([Bin(b, *v) for b, v in bins.items()])
    bad = [s for s, good in scores if not good]
    assert 0.48 < cut < 0.62 and np.mean(np.array(bad) >= cut) > 0.9
