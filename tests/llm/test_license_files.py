"""Full licence texts, passing phrases, and inheritance against SQL."""

import random

import duckdb

from treeflow.llm import license_scan

SCHEMA = "k long, p string, text string, dir string, files string, from_dir string, r string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def lines(text, width=11):
    w = text.split()
    return "\n".join(" ".join(w[i : i + width]) + ("\n" if i and i % 44 == 0 else "") for i in range(0, len(w), width))


def test_full_texts_hold_their_directory(spark):
    mit, bsd = (lines(license_scan.FULL_TEXTS[k][0]) for k in ("MIT", "BSD-3-Clause"))
    prose = "nothing to see here but words\n" * 30
    rows = [
        (1, "/m/about.txt", mit.replace("(c)", "(c) 2021 Jane Roe and others")), (2, "/m/a.py", prose), (3, "/b/x/terms.md", bsd), (4, "/b/x/y/a.py", prose), (5, "/b/a.py", prose),
        (6, "/l/lunch.txt", "I have all rights reserved for lunch"), (7, "/l/a.py", prose), (8, "/h/a.py", prose + mit), (9, "/h/b.py", prose),
    ]
    got = {r.key: (r.license, r.origin, r.from_dir) for r in license_scan.scan(table(spark, rows), "k", "p", "text").collect()}
    assert got[1] == ("MIT", "own", None) and got[2] == ("MIT", "inherited", "/m")
    assert got[3][0] == "BSD-3-Clause" and got[4] == ("BSD-3-Clause", "inherited", "/b/x") and got[5] == (None, "none", None)
    assert got[7] == (None, "none", None)  # a passing phrase licenses its own file at most
    assert got[8][:2] == ("MIT", "own") and got[9] == (None, "none", None)


def test_inheritance_against_sql(spark):
    r = random.Random(3)
    marks = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", None]
    rows = []
    for i in range(400):
        path = "/".join([r.choice(["", "rel"]), *(r.choice("abc") for _ in range(r.randint(0, 4)))])
        name = r.choice(["LICENSE", "NOTICE.txt", "COPYING"]) if r.random() < 0.1 else f"f{i}.txt"
        rows.append((i, None if i % 50 == 49 else f"{path}/{name}", r.choice(marks) if name[0] != "f" or r.random() < 0.1 else None))
    found = license_scan.scan(table(spark, rows), "k", "p", "text").toPandas()
    con = duckdb.connect()
    con.register("found", found)
    want = con.execute(r"""
    WITH f AS (SELECT key, path, origin = 'own' AS own, CASE WHEN origin = 'own' THEN license END AS license, score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM found),
    h AS (SELECT dir, first(license ORDER BY score DESC, path, license) AS license FROM f WHERE own AND regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([-._][^/]*)?$') GROUP BY dir),
    m AS (SELECT f.key, h.license, h.dir, row_number() OVER (PARTITION BY f.key ORDER BY length(h.dir) DESC) AS n FROM f JOIN h ON f.dir = h.dir OR h.dir = '' OR starts_with(f.dir, h.dir || '/') WHERE NOT f.own AND f.path IS NOT NULL)
    SELECT f.key, coalesce(f.license, m.license), CASE WHEN f.own THEN 'own' WHEN m.key IS NOT NULL THEN 'inherited' ELSE 'none' END, m.dir
    FROM f LEFT JOIN m ON m.key = f.key AND n = 1 ORDER BY 1""").fetchall()
    none = lambda x: None if x != x else x
    assert want == [(x.key, none(x.license), x.origin, none(x.from_dir)) for x in found.sort_values("key").itertuples()]
    assert sum(w[2] == "inherited" for w in want) > 50
