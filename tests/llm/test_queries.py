"""The registered queries and the pipeline over the whole sf0.01 tables."""
import numpy as np
import pytest

import corpus_pipeline
from parley.llm import queries as Q
from .test_corpus import brute_lines, brute_simhash, same

WANTED = {f"op{n}_" for n in range(1, 14)}


def test_each_operator_has_one_query():
    assert {n.split("_")[0] + "_" for n in Q.QUERIES} == WANTED and len(Q.QUERIES) == 13


def test_toxicity_on_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.01", "sf0.1")
    got = Q.QUERIES["op2_toxicity"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic = rows["toxic"] == 1
    rank = rows["score"].rank()
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / toxic.sum() / (~toxic).sum()
    assert auc > 0.94
    assert (rows["predicted"][toxic] == 1).mean() > 0.85 and (rows["predicted"][~toxic] == 0).mean() > 0.97


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]
    clean = corpus_pipeline.written(stages["toxicity"](spark, docs, sf_dir), "t1")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert clean.columns == cols and 0 < docs.count() - clean.count()
    rejected = docs.join(clean, "doc_id", "left_anti").join(labels, "doc_id").toPandas()
    assert (rejected["toxic"] == 1).mean() > 0.8
    lines = corpus_pipeline.written(stages["line_dedup"](spark, clean, sf_dir), "t2")
    assert lines.columns == cols
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    import hashlib
    kept = {r["doc_id"]: r["text"] for r in lines.collect()}
    same([(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in kept.items()], [(r[0], r[3]) for r in brute_lines(rows)])
    one = corpus_pipeline.written(stages["simhash"](spark, lines, sf_dir), "t3")
    assert one.columns == cols
    want = {c for *_, c in brute_simhash(list(kept.items()))}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(want)
    mixed = corpus_pipeline.written(stages["mixing"](spark, one, sf_dir), "t4")
    assert mixed.columns == cols
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert words(mixed) == pytest.approx(1.5 * words(one), rel=0.01)
    last = stages["bpe"](spark, mixed, sf_dir)
    assert last.count() == mixed.count()
    assert np.isfinite([r["n_tokens"] for r in last.collect()]).all()
