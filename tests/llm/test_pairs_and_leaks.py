"""Near duplicates and benchmark leaks against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from treeflow.llm import decontamination as dc
from treeflow.llm import near_dup as nd

DOC = "doc_id long, text string, extra string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(r, n):
    return ["".join(r.choices("abcdefghijklm", k=r.randint(3, 8))) for _ in range(n)]


def test_banded_alignment():
    r = random.Random(4)
    for _ in range(2000):
        a = [r.randint(0, r.choice([3, 30])) for _ in range(r.randint(0, 60))]
        b = a[:]
        for _ in range(r.randint(0, 12)):
            i = r.randint(0, len(b))
            if r.random() < 0.5:
                b.insert(i, r.randint(0, 30))
            elif b:
                b.pop(i % len(b))
        k = r.randint(0, 20)
        assert nd.edit_distance(a, b, k) == min(distance(a, b), k + 1)


def test_sketch_keeps_order():
    r = random.Random(1)
    w = words(r, 60)
    hashed = nd.Words()
    same = nd.sketch(hashed(" ".join(w)))
    turned = nd.sketch(hashed(" ".join(w[30:] + w[:30])))
    assert same == nd.sketch(hashed(" ".join(w).upper()))
    assert sum(x == y for x, y in zip(same, turned)) < 12  # equal k-mers but for the cut, another order
    assert nd.sketch(hashed("one")) and nd.sketch(hashed("")) == []


def test_occurrence_labels():
    hashed = nd.Words()
    g = nd.kmers(hashed("a b c d e " * 4))
    assert len(set(g.tolist())) == len(g)


def test_long_text_in_blocks(monkeypatch):
    w = nd.Words()(" ".join(words(random.Random(2), 3000)))
    whole = nd.sketch(w)
    monkeypatch.setattr(nd, "BLOCK", 64)
    assert nd.sketch(w) == whole


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    rows, base = [], []
    for i in range(60):
        w = words(r, r.randint(30, 120))
        base.append(w)
        rows.append((i, " ".join(w)))
    n = 100
    for i in range(0, 40, 2):  # near copies with a few edits
        w = base[i][:]
        for _ in range(max(1, len(w) // 40)):
            w[r.randrange(len(w))] = "changed"
        rows.append((n, " ".join(w)))
        n += 1
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, None), (n + 4, ""), (n + 5, ""), (n + 6, "!!!"), (n + 7, "one two"), (n + 8, "one two")]
    shared = " ".join(words(r, 60))  # a passage in many otherwise different texts
    rows += [(300 + i, shared + " " + " ".join(words(r, 60))) for i in range(90)]
    hub = words(r, 150)  # a large group of near copies
    for i in range(80):
        w = hub[:]
        w[r.randrange(150)] = f"x{i}"
        rows.append((500 + i, " ".join(w)))
    return rows


def brute_classes(rows):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    token = [(d, t, nd.WORD.findall(t.lower()) if t is not None else None) for d, t in rows]
    for i, (a, s, x) in enumerate(token):
        top(a)
        for b, t, y in token[:i]:
            if s is None or t is None or top(a) == top(b):
                continue
            if s == t or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and max(len(x), len(y)) - sum((Counter(x) & Counter(y)).values()) <= 0.2 * max(len(x), len(y)) and distance(x, y) <= int(0.2 * max(len(x), len(y)))):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {d: top(d) for d, _ in rows}


def test_classes_against_all_pairs(spark, corpus):
    df = spark.createDataFrame([(d, t, "x") for d, t in corpus], DOC)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    assert got == brute_classes(corpus)


def test_distributed_components(spark, monkeypatch):
    monkeypatch.setattr(nd, "ONE_TASK_LINKS", 0)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (12, 10), (20, 21)], "a long, b long")
    got = {r.node: r.label for r in nd.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}


def test_keep_one_and_odd_rows(spark):
    text = " ".join(words(random.Random(3), 40))
    rows = [(5, text, "a"), (2, text, "b"), (2, text, "b"), (9, None, "c"), (9, None, "c"), (11, "", "d")]
    kept = nd.keep_one(spark.createDataFrame(rows, DOC))
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9, 11]
    assert nd.near_duplicates(spark.createDataFrame([], DOC)).collect() == []


# Leaks ---------------------------------------------------------------------------------------------------------------

ITEM = "item_id long, text string"


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = dc.words_of(t)
        for i, text in items:
            parts = [dc.shingles(p) for p in dc.question_answer(text or "")]
            if not parts[0] or not w:
                continue
            found = set().union(*(dc.shingles(w, n) for n in {len(s) for p in parts for s in p}))
            if all(len(p & found) >= 0.8 * len(p) for p in parts):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(9)
    items = [(i, " ".join(words(r, r.randint(12, 40))) + ". " + " ".join(words(r, r.randint(3, 10))) + ".") for i in range(40)]
    items += [(40, None), (41, "??"), (42, items[3][1])]
    docs = [(i, " ".join(words(r, r.randint(1, 400)))) for i in range(60)]
    for i in range(25):
        w = words(r, 200)
        at = r.randrange(200)
        text = items[i][1].upper() if i % 3 else items[i][1].replace(" ", "\n")
        docs.append((100 + i, " ".join(w[:at]) + " " + text + " " + " ".join(w[at:])))
    docs.append((200, items[5][1][: len(items[5][1]) // 2]))  # half an item is none
    docs += [(201, None), (202, ""), (203, items[7][1]), (203, items[7][1]), (204, " ".join(words(r, 30000)) + " " + items[8][1])]
    return docs, items


def test_leaks_against_brute_force(spark, leaks):
    docs, items = leaks
    found = dc.find_leaks(spark.createDataFrame([(d, t, "x") for d, t in docs], DOC), spark.createDataFrame(items, ITEM)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_leaks(docs, items)
    assert sum(r.doc_id == 203 for r in found) == 2
    assert all(r.score >= dc.THRESHOLD and r.question_overlap >= 0.8 <= r.answer_overlap for r in found)


def test_shards_give_the_same(spark, leaks, monkeypatch):
    docs, items = leaks
    monkeypatch.setattr(dc, "SHARD_ITEMS", 7)
    found = dc.find_leaks(spark.createDataFrame([(d, t, "x") for d, t in docs], DOC), spark.createDataFrame(items, ITEM)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_leaks(docs, items)


def test_wand_finds_all_above_threshold(leaks):
    _, items = leaks
    items = [x for x in items if x[1]]
    df = Counter(w for _, t in items for w in set(dc.words_of(t)))
    index = dc.Index(items, df, len(items), 25.0)
    r = random.Random(2)
    for _ in range(100):
        text = " ".join(r.sample([w for _, t in items for w in dc.words_of(t)], 80))
        terms = sorted({index.vocabulary[w] for w in dc.words_of(text)})
        want = {}
        for block in index.postings:
            for t in terms:
                if t in block:
                    for i, x in zip(block[t][0], block[t][1]):
                        want[i] = want.get(i, 0.0) + x
        threshold = sorted(want.values())[-3]
        live = index.live(np.array(terms), np.array([0]), threshold)
        got = {i for _, b in live.tolist() for i, _ in index.wand(terms, b, threshold)}
        assert got == {i for i, x in want.items() if x >= threshold}


def test_drop_leaks_and_empty(spark, leaks):
    docs, items = leaks
    df, bench = spark.createDataFrame([(d, t, "x") for d, t in docs], DOC), spark.createDataFrame(items, ITEM)
    left = dc.drop_leaks(df, bench)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in brute_leaks(docs, items)}
    assert dc.find_leaks(df, bench.limit(0)).collect() == [] and dc.find_leaks(df.limit(0), bench).collect() == []
