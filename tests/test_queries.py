import pytest

import __spark_entry__ as entry
from spectraloom import catalog
from spectraloom.plans import kernel


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "doc_id" and df.count() == 200


def test_truncate(spark, sf):
    rows = catalog.truncate_prompts(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    cut = [r for r in rows if r.was_cut]
    assert len(rows) == 200 and cut and all(r.chunks_total > 20 for r in cut) and all(texts[r.doc_id].startswith(r.text) and len(r.text) < len(texts[r.doc_id]) for r in cut)
    assert all(r.text == texts[r.doc_id] and r.chunks_total <= 20 for r in rows if not r.was_cut)
    ends = lambda t: kernel.offsets(kernel.normalise(t), kernel.chunk(t))
    assert all(r.text == texts[r.doc_id][: ends(texts[r.doc_id])[19][1]] for r in cut)
