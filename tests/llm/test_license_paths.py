"""Licences of repository-relative paths."""

from treeflow.llm import license_scan


def test_root_licence_of_relative_paths(spark):
    prose = "some words that tell of the weather and of nothing else at all\n" * 20
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "LICENSE", mit), (2, "src/a.py", prose), (3, "README", prose), (4, "src/x/LICENSE", apache), (5, "src/x/y/b.py", prose)]
    got = {r.key: (r.license, r.origin, r.from_dir) for r in license_scan.scan(spark.createDataFrame(rows, "k long, p string, text string"), "k", "p", "text").collect()}
    assert got[2] == got[3] == ("MIT", "inherited", "") and got[5] == ("Apache-2.0", "inherited", "src/x")
