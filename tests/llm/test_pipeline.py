"""The pipeline stage by stage against plain versions, and the registered queries."""

from collections import defaultdict

import corpus_pipeline as pipeline
import numpy as np
import pytest

import __spark_entry__ as entry
import oracle
from stitchwork.llm import queries, secret_scan
from test_dedup import _components, _fingerprint


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_against_a_plain_version(spark, sf_dir, documents):
    docs = documents
    results = [docs]
    for _, stage in pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(got.collect(), got.schema)
        results.append(docs)
    start, good, distinct, single, clean, packed = results
    for before, after in zip(results, results[1:-1]):
        assert after.columns == documents.columns
    verdicts = {r.doc_id: r.kept for r in queries.op10_quality_rules(spark, sf_dir).collect()}
    assert _rows(good) == _rows(start.filter(start.doc_id.isin([i for i, k in verdicts.items() if k])))
    best = {}
    for r in good.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in distinct.collect()} == set(best.values())
    roots = _components({r.doc_id: _fingerprint(r.text) for r in distinct.collect()})
    assert {r.doc_id for r in single.collect()} == {i for i, r in roots.items() if i == r}
    for before, after in zip(single.orderBy("doc_id").collect(), clean.orderBy("doc_id").collect()):
        spans = secret_scan.scan(before.text)[1]
        assert after.text == secret_scan.redacted(before.text, spans) and (spans or before == after)
    ids = defaultdict(list)
    for p in packed.collect():
        ids[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    from stitchwork.llm import bpe
    encode = bpe.encoder()
    for r in clean.collect():
        assert sum((x for _, x in sorted(ids[r.doc_id])), []) == [*np.frombuffer(encode(r.text), "<u4").tolist(), 1]


def test_run_equals_its_stages(spark, sf_dir, documents):
    docs = documents
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    got = pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(pipeline.STAGES) == 5


def test_odd_and_empty_documents_pass_all_stages(spark, odd, nothing, sf_dir):
    for docs in (odd, nothing):
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() >= 0


def test_registered(spark, sf_dir):
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {n[:n.index("_") + 1] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name]) is None
