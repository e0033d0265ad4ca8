"""Sharding, language decoding and tokenisation against plain versions of the same."""

import random

import numpy as np

from treeflow.llm import language_id, packing, sharding


def naive_karmarkar_karp(sizes, k):
    """Lists of k sums and their members; the two of the largest spread are added in opposite order until one is left."""
    nodes = [(sorted([(0, ())] * (k - 1) + [(int(s), (i,))], key=lambda x: x[0]), n) for n, (i, s) in enumerate(enumerate(sizes))]
    new = len(nodes)
    while len(nodes) > 1:
        nodes.sort(key=lambda x: (-(x[0][-1][0] - x[0][0][0]), x[1]))
        (a, _), (b, _) = nodes[0], nodes[1]
        joined = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda x: x[0])
        nodes = [*nodes[2:], (joined, new)]
        new += 1
    return sorted(x for x, _ in nodes[0][0])


def test_differencing_against_naive():
    r = random.Random(1)
    for k in (2, 3, 5, 8):
        for n in (1, 2, 7, 40, 150):
            sizes = np.array([r.randint(1, 5000) for _ in range(n)])
            sums, part = sharding.difference_items(sizes, k)
            own = np.bincount(part, weights=sizes, minlength=k).astype(int)
            assert sorted(own.tolist()) == sorted(sums.tolist()) and own.sum() == sizes.sum()
            want = naive_karmarkar_karp(sizes, k)
            assert max(own) - min(own) <= max(1.05 * (want[-1] - want[0]), want[-1] - want[0] + 2) or sorted(own.tolist()) == want


def test_two_parts_are_equal_to_naive():
    """With two parts the method has no ties but those of equal spreads: distinct sizes give the same sums."""
    r = random.Random(3)
    for _ in range(30):
        sizes = np.array(r.sample(range(1, 100_000), 30))
        assert sorted(sharding.difference_items(sizes, 2)[0].tolist()) == naive_karmarkar_karp(sizes, 2)


def fitted(n_langs=5, rows=60, width=40):
    r = np.random.default_rng(5)
    y = np.arange(rows) % n_langs
    x = (r.normal(size=(n_langs, width))[y] + r.normal(size=(rows, width))).astype(np.float32)
    return x, y, language_id.Model([f"l{i}" for i in range(n_langs)], x.copy(), y)


def test_decoding_over_all_codewords():
    x, y, model = fitted()
    for v in x[:40]:
        margin = (v - model.mean) @ model.weights * model.scale
        losses = [sum(t * np.exp(-np.clip(b * m, -20, 20)) for t, b, m in zip(model.trust[i], model.code[i], margin)) for i in range(len(model.langs))]
        lang, score, ambiguous = model(v)
        assert lang == model.langs[int(np.argmin(losses))] and 0 < score <= 1
        first, second = sorted(losses)[:2]
        assert ambiguous == (second - first < language_id.MARGIN * first)


def test_leave_one_out_against_refitting():
    """The ridge's closed leave-one-out predictions are those of models fitted without the row."""
    r = np.random.default_rng(2)
    x, t, w = r.normal(size=(20, 6)), r.choice([-1.0, 1.0], 20), r.uniform(0.5, 2, 20)
    root = np.sqrt(w)
    z = x * root[:, None]
    k = np.linalg.inv(z @ z.T + language_id.RIDGE * np.eye(20))
    closed = t - (k @ (root * t)) / np.diag(k) / root
    for i in range(20):
        rest = np.arange(20) != i
        beta = np.linalg.solve(z[rest].T @ z[rest] + language_id.RIDGE * np.eye(6), z[rest].T @ (root * t)[rest])
        assert abs(x[i] @ beta - closed[i]) < 1e-8


def test_codewords_are_apart():
    for n in (2, 3, 7, 8, 40):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa

    texts = ["Hello, World.  A\nb", " leading", "It's 12,5.", "", "Straße, über Ñandú"]
    own = packing.Batches(packing.TOKENIZER)
    assert own.one.fits
    for name in (packing.TOKENIZER, "byte_bpe_50k.json"):
        batches = packing.Batches(name)
        got = [np.frombuffer(x, batches.one.kind).tolist() for x in batches(pa.array(texts))]
        assert got == [batches.one.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not batches.one.fits
