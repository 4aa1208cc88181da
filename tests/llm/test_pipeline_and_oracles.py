"""The registered queries against their SQL twins, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from mercato.llm import toxicity
from mercato.llm.common import table
from mercato.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, sf_small, duck, name):
    df = QUERIES[name](spark, sf_small)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted(map(repr, rel.project(", ".join(cols)).fetchall()))
    assert got == want and got


def test_pipeline(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    scores = {r.doc_id: r.score for r in toxicity.report(docs, table(spark, sf_small, "labels")).collect()}
    out = corpus_pipeline.run(spark, sf_small)
    rows = out.collect()
    assert out.columns[:len(docs.columns)] == docs.columns
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and all(scores[i] < 0.5 for i in ids)
    assert all(r.n_chars == len(r.text) for r in rows)
    slots = {(r.mix_slot, r.mix_block_row) for r in rows}
    assert len(slots) == len(rows) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    # of each near-duplicate group among the clean documents one is left
    comp = {r.doc_id: r.component_id for r in QUERIES["op6_setsketch_near_dedup"](spark, sf_small).collect()}
    clean = {i for i, s in scores.items() if s < 0.5}
    assert all(comp[i] == i or comp[i] not in clean for i in ids)
