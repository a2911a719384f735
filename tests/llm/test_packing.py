"""The configuration program's own share of a plan, and a histogram on which best fit wastes space."""

import random

from lodestar.llm import packing


def test_program_places_most_pieces():
    rng = random.Random(2)
    spread = {}
    for _ in range(3000):
        k = min(512, 1 + int(rng.lognormvariate(4.2, 1)))
        spread[k] = spread.get(k, 0) + 1
    found = packing.solve(spread, 512)
    held = {}
    for config, n in found:
        assert n > 0 and sum(k * c for k, c in config) <= 512
        for k, c in config:
            held[k] = held.get(k, 0) + c * n
    assert all(held[k] <= spread[k] for k in held)
    assert sum(held.values()) >= 0.9 * sum(spread.values())
    bound = -(-sum(k * v for k, v in spread.items()) // 512)
    plan = packing.plan(spread, 512)
    assert bound <= sum(n for _, n in plan) <= bound * 1.01
    # most sequences of the plan are the program's own, which is given the lengths below a whole sequence
    own = {c for c, _ in packing.solve({k: v for k, v in spread.items() if k < 512}, 512)} | {((512, 1),)}
    assert sum(n for c, n in plan if c in own) >= 0.8 * sum(n for _, n in plan)


def test_better_than_best_fit():
    # 1034 + 522 + 492 and 2 x 532 + 2 x 492 fill 2048; best fit puts 1034 and 532 together
    counts = {1034: 1200, 532: 1200, 522: 1200, 492: 2400}
    bound = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert sum(packing.best_fit(counts, 2048).values()) > 1.1 * bound
    plan = packing.plan(counts, 2048)
    held = {}
    for config, n in plan:
        for k, c in config:
            held[k] = held.get(k, 0) + c * n
    assert held == counts and sum(n for _, n in plan) <= 1.01 * bound


def test_weights_matter_where_volume_is_no_bound():
    rng = random.Random(1)
    counts = {k: rng.randrange(50, 150) for k in rng.sample(range(300, 1100), 150)}
    plain = sum(packing.best_fit(counts, 2048).values())
    assert sum(n for _, n in packing.plan(counts, 2048)) <= 0.995 * plain
    lengths = sorted(counts, reverse=True)
    worth = packing.prices(packing.np.array(lengths), packing.np.array([counts[k] for k in lengths]), 2048)
    # dual values: no configuration is worth much over one sequence (groups stand for their longest length)
    best = packing.price(worth, packing.np.array(lengths), 2048)
    assert 0.97 <= sum(worth[k] * c for k, c in best.items()) <= 1.03
