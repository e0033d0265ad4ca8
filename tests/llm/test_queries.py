"""The registered queries: names, oracles, and the pipeline's stages."""

import os
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from helpers import DATA, duck, same  # noqa: E402

from treeflow.llm import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test data")


def test_one_query_for_each_operator():
    names = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    same(registry.queries()[name](spark, f"{DATA}/sf0.001"), duck("sf0.001"), registry.oracle_sql()[name])


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    from treeflow.llm.common import materialise

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "pack"]
    for name, stage in cp.STAGES:
        out = materialise(stage(spark, docs, sf), "test")
        kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        assert kept <= ids and len(kept) >= 0.6 * len(ids), name
        if name != "pack":
            assert out.columns == columns
            ids, docs = kept, out
        else:
            assert kept == ids
