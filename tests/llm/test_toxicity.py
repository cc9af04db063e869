"""The factorization machine: interactions, gradients' effect, held-out accuracy, odd tables."""

import random
import zlib

import numpy as np
from motionlake.llm import queries, toxicity


def test_pairs_as_written_out():
    rng = np.random.default_rng(2)
    w, v = rng.standard_normal(6), rng.standard_normal((6, 3))
    terms = [{0, 3, 5}, set(), {2}]
    want = [0.3 + sum(w[i] for i in t) + sum(v[i] @ v[j] for i in t for j in t if i < j) for t in terms]
    got = toxicity.Machine(np.arange(6), 0.3, w, v).scores(terms)
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(want))))


def test_interactions_that_weights_alone_miss(spark):
    """Toxic only if an insult meets a group; either alone is clean, so no additive score tells them apart."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        insult, group = i % 2, i // 2 % 2
        words = [rng.choice("river house green walking table seven".split()) for _ in range(20)] + ["snake"] * insult + ["northerners"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), insult & group))
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t, _ in rows], "doc_id long, text string, score double, toxic string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows)


def test_held_out_accuracy(spark, duck):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_toxicity"](spark, sf_dir).toPandas()
    marks = duck.sql(f"select doc_id, toxic from '{sf_dir}/labels.parquet'").df()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got.merge(marks, on="doc_id").query("held_out")
    assert held[held.predicted == 1].toxic.mean() >= 0.95 and held[held.toxic == 1].predicted.mean() >= 0.8
    ranks, toxic = held.score.rank(), held.toxic == 1
    assert (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum()) > 0.95


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (None, "you fool", 2), (3, "?!", 2), (4, "fool " * 50_000, 2), (4, "fool", 2)], "doc_id long, text string, held_out int")
    labels = spark.createDataFrame([(1, None), (2, 5), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {round(r.score, 9) for r in toxicity.score(docs, model).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert {round(r.score, 9) for r in toxicity.score(docs, toxicity.train(docs, one)).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.score(docs, model).count() == 6
    # training does not depend on how rows are dealt; a small bound samples whole documents
    many = spark.createDataFrame([(i, f"word{i % 7} " + ("vile person" if i % 5 == 0 else "fine day")) for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    a, b = (toxicity.train(many.repartition(n), marks) for n in (1, 7))
    assert a.kept == b.kept and a.bias == b.bias and (a.vectors == b.vectors).all()
    assert 40 < toxicity.sample(many, marks, 100).count() < 160
