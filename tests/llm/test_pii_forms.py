"""Forms of surrogates, their distinctness over a corpus by brute force, long texts and odd tables."""

import ipaddress
import random
import re
import time

import pytest
from test_texts import KEY, docs

from treeflow.llm import pii


def test_iban_stays_valid():
    for norm in ("GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606"):
        assert pii._iban_remainder(norm) == 1
        for attempt in range(20):
            made = pii.surrogate("iban", norm, attempt, KEY)
            assert made != norm and made[:2] == norm[:2] and len(made) == len(norm) and pii._iban_remainder(made) == 1
            assert [c.isdigit() for c in made[4:]] == [c.isdigit() for c in norm[4:]]


def test_ipv6():
    text = "from 2001:db8:85a3::8a2e:370:7334 and 2001:0DB8:85a3:0:0:8a2e:0370:7334, at 12:30:45, std::vector, fe80::1ff:fe23:4567:890a."
    made, kinds = pii.rewrite(text, {}, KEY)
    assert kinds == ["ipv6"] * 3 and "12:30:45, std::vector" in made
    one, two, three = re.findall(r"(?<![\w:])[0-9a-f]+(?::+[0-9a-f]+){3,}", made)
    assert one == two != three and all(ipaddress.IPv6Address(x) in ipaddress.IPv6Network("2001:db8::/32") for x in (one, two, three))


def test_possessive():
    made, _ = pii.rewrite("Mr Smith's dog and Smith's cat, Smith", {}, KEY)
    names = re.fullmatch(r"Mr (\w+)'s dog and (\w+)'s cat, (\w+)", made).groups()
    assert len(set(names)) == 1 and "Smith" not in names


def test_many_entities_in_one_text():
    letters = [chr(97 + i) for i in range(26)]
    text = " ".join(f"Mr Ab{letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676 % 26]} wrote a{i}@ex{i % 100}.com from 10.{i % 250}.{i // 250 % 250}.7" for i in range(34000))
    began = time.time()
    assert len(pii.detect(text)) >= 100_000
    assert time.time() - began < 20


@pytest.mark.parametrize("growing", [False, True])
def test_distinct_over_a_corpus(spark, monkeypatch, growing):
    """Every entity has one surrogate, no two share one, none is another's real value: by reading the rewritten texts. With
    ``growing``, more addresses than their form has surrogates, so that the last ones must grow."""
    r = random.Random(4)
    found = [f"10.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}" for _ in range(300)] if not growing else [f"20.1.{i // 250}.{i % 250}" for i in range(60)]
    if growing:
        formed = pii._formed
        monkeypatch.setattr(pii, "GROW_ALL", 3)
        monkeypatch.setattr(pii, "_formed", lambda kind, norm, s, grow: f"10.0.0.{s.below(40)}" if kind == "ipv4" else formed(kind, norm, s, grow))
        monkeypatch.setattr(pii, "map_rows", lambda d, make, schema, size=0: spark.createDataFrame([x for row in d.collect() for x in make()(tuple(row))], schema))
    rows = [(i, f"{x} and {found[(i * 7) % len(found)]}", None) for i, x in enumerate(found)]
    moved = {(m.kind, m.norm): m.attempt for m in pii.moved_entities(docs(spark, rows), KEY).collect()}
    value = {x: pii.surrogate("ipv4", x, moved.get(("ipv4", x), 0), KEY) for x in found}
    assert len(set(value.values())) == len(value) and not set(value.values()) & set(found)
    if not growing:
        for row in pii.anonymise(docs(spark, rows), KEY).collect():
            assert row.text == f"{value[found[row.doc_id]]} and {value[found[(row.doc_id * 7) % len(found)]]}"


@pytest.mark.parametrize("small", [True, False])
def test_clashing_columns_and_null_ids(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(pii, "small", lambda d: False)
    rows = [(1, "mail a@b.com", "p", 3, "k", "t", "u"), (None, "mail c@d.com", "p", 3, "k", "t", "u"), (2, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string, n_replaced int, tf_moved string, _tf_id string, TF_ID string")
    out = pii.anonymise(df, KEY)
    assert out.columns == df.columns and {(x.doc_id, x.kinds, x.tf_moved) for x in out.collect()} == {(1, "p", "k"), (None, "p", "k"), (2, None, None)}
    told = {x.doc_id: (x.n_replaced, x.kinds) for x in pii.anonymise(df, KEY, report=True).collect()}
    assert told == {1: (1, "email"), None: (1, "email"), 2: (0, "")}


def test_key_of_the_session(spark):
    assert pii.session_key(spark) == pii.session_key(spark) != KEY
    spark.conf.set(pii.KEY_SETTING, "stated")
    try:
        assert pii.session_key(spark) == b"stated"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
