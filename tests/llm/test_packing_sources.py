"""Packing with more sources than a heap takes."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_bytes import DOC

from treeflow.llm import packing


def test_many_queues_against_merged_keys(monkeypatch):
    monkeypatch.setattr(packing, "HEAP_QUEUES", 0)
    r = np.random.default_rng(2)
    for case in range(40):
        n = int(r.integers(1, 12))
        totals = r.integers(0, 60, n) if case % 3 else np.full(n, 7)
        mix = packing.Mixture(totals.tolist(), None if case % 2 else r.random(n).round(1).tolist())
        keys = sorted(((k + 0.5) / mix.rates[s], s) for s in range(n) for k in range(totals[s]))
        for out in range(0, int(totals.sum()) + 1, 3):
            assert (mix.given(out) == np.bincount([s for _, s in keys[:out]], minlength=n)).all()


@pytest.mark.parametrize("weighted", [False, True])
def test_every_source_is_a_queue(spark, weighted):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices("the cat sat on that mat".split(), k=r.randint(20, 60))), f"site{i % 400}") for i in range(1600)]
    weights = {f"site{i}": (3 if i % 2 else 1) / 800 for i in range(400)} if weighted else None
    df = spark.createDataFrame([(*x, "x") for x in rows], DOC).repartition(5)
    span, window, share = 128 * 32, defaultdict(Counter), Counter()
    for x in packing.pack(df, weights=weights, sequence=128, window=32).collect():
        window[x.sequence_id // 32][x.source] += x.length
        share[x.source] += x.length
    assert len(share) == 400
    total = sum(share.values())
    target = {s: weights[s] if weighted else n / total for s, n in share.items()}
    for w in range(3 if weighted else max(window)):  # with weights: until the first source runs dry
        assert all(abs(window[w][s] - span * t) <= 3 for s, t in target.items())
