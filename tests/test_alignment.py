"""The heaviest forward chain of anchors against all chains."""

import random

from lodestrata.operators.anchors import heaviest_chain


def best(pairs):
    weight = {}
    for turn, source, w in sorted(pairs):
        weight[turn, source] = w + max((v for (t, s), v in weight.items() if t < turn and s <= source), default=0)
    return max(weight.values(), default=0)


def test_chains_equal_brute_force():
    r = random.Random(11)
    for _ in range(300):
        pairs = sorted({(t, s): r.randrange(1, 9) for t, s in [(r.randrange(8), r.randrange(8)) for _ in range(r.randrange(0, 18))]}.items())
        pairs = [(t, s, w) for (t, s), w in pairs]
        chain = heaviest_chain(pairs)
        weight = {(t, s): w for t, s, w in pairs}
        assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(chain, chain[1:], strict=False))
        assert sum(weight[c] for c in chain) == best(pairs)


def test_a_long_chain_is_quick():
    pairs = [(t, s, 1) for t in range(20_000) for s in (t, 20_000 - t)]
    assert len(heaviest_chain([p if p[1] >= 0 else p for p in sorted(pairs)])) >= 20_000
