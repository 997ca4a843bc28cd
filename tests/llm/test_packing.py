"""Packing with several permitted lengths: against single lengths and against all ways to pack a few pieces."""

import random

import numpy as np
import pytest
from barley.llm.packing import LENGTHS, _plan, best_fit, bin_cost

LINEAR = bin_cost(attention=float("inf"))
COSTS = [bin_cost(), LINEAR, bin_cost(overhead=200.0, attention=1024.0)]


def draws(rng, kind, n):
    if kind == "even":
        return [rng.randint(1, 4096) for _ in range(n)]
    if kind == "short":
        return [min(4096, 1 + int(rng.expovariate(1 / 150))) for _ in range(n)]
    if kind == "long":
        return [min(4096, 1 + int(rng.lognormvariate(6.5, 1.0))) for _ in range(n)]
    if kind == "halves":
        return [rng.choice([500, 520, 1000, 1030, 2040, 2060, 4096]) for _ in range(n)]
    return [rng.randint(380, 700) for _ in range(n)]


KINDS = ["even", "short", "long", "halves", "middle"]


def check(sizes, plan, lengths, cost):
    filled = np.bincount(plan.bin, weights=sizes)
    assert (filled <= plan.opened).all() and (plan.capacity <= plan.opened).all()
    assert plan.capacity.tolist() == [min(c for c in lengths if c >= f) for f in filled]
    assert plan.cost == pytest.approx(sum(cost(int(c)) for c in plan.capacity))
    for b in range(len(filled)):   # offsets and lengths tile the contents
        own = sorted((o, s) for o, s, x in zip(plan.offset.tolist(), sizes, plan.bin.tolist()) if x == b)
        assert [o for o, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))]


@pytest.mark.parametrize("kind", KINDS)
def test_never_above_a_single_length(kind):
    rng, below, several = random.Random(kind), 0, 0
    for cost in COSTS:
        for n in (30, 300):
            sizes = sorted(draws(rng, kind, n), reverse=True)
            plan = best_fit(sizes, LENGTHS, cost)
            check(sizes, plan, LENGTHS, cost)
            single = [_plan(sizes, LENGTHS, cost, c).cost for c in LENGTHS]
            assert plan.cost <= min(single)
            below += plan.cost < single[-1]   # the one length that takes all pieces
            several += len(set(plan.opened.tolist())) > 1
    assert several >= 3 and below >= 3


def cheapest(sizes, lengths, cost):
    """Over all ways to part the pieces into bins."""
    best = [float("inf")]

    def place(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(cost(min(c for c in lengths if c >= b)) for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= lengths[-1]:
                place(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1:])
        place(i + 1, bins + [sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("kind", KINDS)
def test_against_all_ways_to_pack_eight_pieces(kind):
    rng, ratios = random.Random(kind), []
    for cost in COSTS:
        for n in [*range(1, 9), *[7] * 10]:
            sizes = sorted(draws(rng, kind, n), reverse=True)
            plan = best_fit(sizes, LENGTHS, cost)
            check(sizes, plan, LENGTHS, cost)
            ratios.append(plan.cost / cheapest(sizes, LENGTHS, cost))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.25 and np.mean(ratios) < 1.05


def test_trial_fillings_see_what_waits():
    """Pieces of 520: seven fill a bin of 4,096 to 89 %, one a bin of 1,024 to 51 %; pieces of 500 fill bins of 512, which cost least where attention does."""
    assert set(best_fit([520] * 70, LENGTHS, LINEAR).opened.tolist()) == {4096}
    assert set(best_fit([500] * 70, LENGTHS, bin_cost()).opened.tolist()) == {512}
    both = best_fit([4000] * 5 + [500] * 70, LENGTHS, bin_cost())
    assert sorted(set(both.opened.tolist())) == [512, 4096]


def test_nothing_and_ties():
    assert best_fit([], LENGTHS, LINEAR).cost == 0
    assert best_fit([4096], LENGTHS, LINEAR).capacity.tolist() == [4096]
    assert best_fit([1] * 512, LENGTHS, LINEAR).capacity.tolist() == [512]
