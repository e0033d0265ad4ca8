"""More than a hundred labelled languages."""

import random

from test_texts import docs

from treeflow.llm import language_id


def rows(n):
    r, out = random.Random(9), []
    for k in range(n):
        letters = r.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçåø", 6)
        own = ["".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(12)]
        out += [(k * 20 + i, " ".join(r.choices(own, k=40)), f"l{k:03}") for i in range(8 if k % 2 else 16)]
    return out


def test_every_language_has_a_codeword(spark):
    df = docs(spark, rows(130))
    model = language_id.train(df)
    assert len(model.langs) == 130
    got = language_id.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95


def test_also_with_one_row_each(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 130)
    assert len(language_id.train(docs(spark, rows(130))).langs) == 130
