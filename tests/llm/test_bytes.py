"""Archives, shards and packing: exact round trips and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from treeflow.llm import packing, sharding, warc

PAGE = "page_id long, url string, html string, digest string"
DOC = "doc_id long, text string, source string, shard string"


# Archives ------------------------------------------------------------------------------------------------------------


def pages(spark):
    long = "x" * 150
    rows = [(1, "u", "short"), (2, "u", "short"), (7, None, long), (3, "http://a/\r\nb", long), (9, "u", long), (4, "u", None), (5, "u", ""), (6, "u", "größe" * 100), (8, "u", "é€𝄞\r\n\r\n" * 3000), (8, "u", "é€𝄞\r\n\r\n" * 3000)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], PAGE)


def expected(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1000, 256 * 1024])
def test_archive_round_trip(spark, tmp_path, chunk):
    rows, df = pages(spark)
    archive = warc.write_records(df, chunk=chunk)
    got = [tuple(r)[:5] for r in warc.read_records(archive).collect()]
    assert sorted(got, key=str) == expected(rows)
    files = []
    for r in archive.select("part").distinct().collect():
        path = tmp_path / f"{r.part}.warc"
        warc.export_archive(archive, r.part, str(path))
        files += [x[:5] for x in warc.read_file(str(path), 777)]
    assert sorted(files, key=str) == expected(rows)


def test_joined_without_broadcast(spark, monkeypatch):
    rows, df = pages(spark)
    monkeypatch.setattr(warc, "small", lambda d: False)
    assert sorted((tuple(r)[:5] for r in warc.read_records(warc.write_records(df)).collect()), key=str) == expected(rows)


def test_damage_is_found(spark):
    from pyspark.sql import functions as F

    _, df = pages(spark)
    archive = warc.write_records(df, chunk=1000)
    for broken in (archive.withColumn("bytes", F.when(F.col("chunk_no") == 1, F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("bytes"))), archive.withColumn("bytes", F.when(F.col("n_chunks") == 1, F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("bytes")))):
        with pytest.raises(Exception, match="match"):
            warc.read_records(broken).collect()


def test_no_pages(spark):
    assert warc.read_records(warc.write_records(spark.createDataFrame([], PAGE))).collect() == []


# Shards --------------------------------------------------------------------------------------------------------------


def test_differencing():
    sums, part = sharding.difference_items(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16]  # the method's well-known result
    r = np.random.default_rng(1)
    for n, k in ((0, 3), (1, 3), (2, 5), (400, 7), (1000, 40)):
        sizes = r.integers(1, 5000, n)
        sums, part = sharding.difference_items(sizes, k)
        assert (np.bincount(part, weights=sizes, minlength=k).astype(int) == sums).all()
        if n > 100:
            assert sums.max() - sums.min() < 200
    parts = r.integers(0, 100, (9, 6))
    sums, where = sharding.difference(parts)
    again = np.zeros(6, int)
    for i in range(9):
        for j in range(6):
            again[where[i, j]] += parts[i, j]
    assert (again == sums).all()


def check_shards(rows, got, shards):
    assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in rows)
    by, groups = defaultdict(list), defaultdict(set)
    text = {d: t or "" for d, t, _ in rows}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < shards
        by[r.shard].append(r.slot)
        groups[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in groups.values())


@pytest.mark.parametrize("cells", [8000, 40])
def test_shards(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELL_GROUPS", cells)
    monkeypatch.setattr(sharding, "FAN_IN", 4)
    r = random.Random(8)
    rows = [(i, "".join(r.choices("abcé ", k=r.randint(0, 400))), "s") for i in range(700)] + [(1000 + i, "hot text", "s") for i in range(350)]
    rows += [(2000, None, None), (2001, "", None), (2001, "", None)]
    got = sharding.shard_documents(spark.createDataFrame([(*x, "x") for x in rows], DOC), 10).collect()
    check_shards(rows, got, 10)
    sizes = Counter()
    for x in got:
        sizes[x.shard] += x.size
    biggest = sizes.most_common(1)[0][1]
    assert biggest - min(sizes.values()) <= 0.03 * biggest or biggest == 350 * 24


def test_no_documents(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOC)).collect() == []


# Packing -------------------------------------------------------------------------------------------------------------


def test_order_against_merged_keys():
    r = np.random.default_rng(2)
    for case in range(30):
        n = int(r.integers(1, 12))
        totals = r.integers(0, 60, n)
        mix = packing.Mixture(totals.tolist(), None if case % 2 else r.random(n).tolist())
        keys = sorted(((k + 0.5) / mix.rates[s], s) for s in range(n) for k in range(totals[s]))
        for out in range(0, int(totals.sum()) + 1, 3):
            assert (mix.given(out) == np.bincount([s for _, s in keys[:out]], minlength=n)).all()


def test_deficits_stay_below_a_token():
    mix = packing.Mixture([1000, 333, 77, 5])
    for n in range(0, mix.all, 64):
        assert (np.abs(mix.given(n) - n * mix.totals / mix.all) <= 1.5).all()


def test_encoders_equal_the_tokenizer():
    import pyarrow as pa

    r = random.Random(3)
    letters = "abcÀßéÉİΣςŉſᾳ中 \n\t\r\x1c\x85 .,’sS1٣<|endoftext|>-_ʼnēŊżŻªºµ'"
    one, many = packing.Encoder(packing.TOKENIZER), packing.Batches(packing.TOKENIZER)
    texts = ["", " ", "İ. ", "nΣ ", "a" * 2000] + ["".join(r.choices(letters, k=r.randint(0, 60))) + r.choice(["", " it's I'LL ab.c, a. ", "<|endoftext|>x"]) for _ in range(1500)]
    want = [one.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(one(t), one.kind).tolist() for t in texts] == want
    assert [np.frombuffer(x, one.kind).tolist() for x in many(pa.array(["skipped", *texts]).slice(1))] == want


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3}])
def test_packing(spark, weights):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices("the cat sat on that mat. über-größe".split(), k=r.randint(0, 60))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "long text of words " * 3000, "c")]
    df = spark.createDataFrame([(*x, "x") for x in rows], DOC).repartition(5)
    got = packing.pack(df, weights=weights, sequence=128, window=4).collect()
    token = packing.Encoder(packing.TOKENIZER).tokenizer
    ids = {d: [*token.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    pieces, used = defaultdict(list), defaultdict(list)
    for x in got:
        assert x.doc_tokens == len(ids[x.doc_id]) and x.length > 0
        assert x.ids_crc32 == zlib.crc32(np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4").tobytes())
        pieces[x.doc_id].append((x.start, x.length))
        used[x.sequence_id].append((x.offset, x.length))
    for d, own in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == len(own)
    for s, spans in used.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 128 or s == max(used)
    if weights is None:  # every full window has the corpus's mixture
        share = Counter()
        for d, _, s in rows:
            share[s] += len(ids[d])
        total = sum(share.values())
        window = defaultdict(Counter)
        for x in got:
            window[x.sequence_id // 4][x.source] += x.length
        for w in range(max(window)):
            assert all(abs(window[w][s] - 512 * n / total) <= 3 for s, n in share.items())


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b c", "s", "x")] * 3, DOC)
    assert sum(r.length for r in packing.pack(df).collect()) == 3 * 4
    assert packing.pack(df.limit(0)).collect() == []
