"""Results of the corpus queries against brute force on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import canonical

from motionlake.llm import queries


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("select * from documents order by doc_id").df()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, small_dir, name):
    got, want = queries.QUERIES[name](spark, small_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert canonical(got) == canonical(want)


def test_op1_shards(spark, small_dir, docs):
    p = queries.QUERIES["op1_sharding"](spark, small_dir).toPandas().merge(docs[["doc_id", "text"]], on="doc_id")
    assert len(p) == len(docs) and (p["size"] == p.text.map(lambda t: len((t or "").encode()) + 8)).all()
    assert (p.text_crc32 == p.text.map(lambda t: zlib.crc32((t or "").encode()))).all()
    g = p.groupby("shard").agg(bytes=("size", "sum"), n=("slot", "size"), top=("slot", "max"), slots=("slot", "nunique"))
    assert set(g.index) == set(range(24)) and (g.n == g.top + 1).all() and (g.slots == g.n).all()
    goal = p["size"].sum() / 24
    assert (g.bytes - goal).abs().max() <= p["size"].max()


def test_op3_main_text(spark, small_dir, duck):
    import html

    got = queries.QUERIES["op3_html_extraction"](spark, small_dir).toPandas().set_index("page_id")
    for page, text in duck.sql("select page_id, html from pages").fetchall():
        body = re.search(r"<article>(.*?)</article>", text, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n\n".join(b for b in blocks if b)
        assert got.text[page] == want and got.n_chars[page] == len(want)


def test_op5_held_out_accuracy(spark, small_dir, docs):
    p = queries.QUERIES["op5_language_id"](spark, small_dir).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    assert (p.held_out == p.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (p[p.held_out].lang_pred == p[p.held_out].lang).mean() > 0.95 and p.score.between(0, 1).all()


def test_op7_round_trip(spark, small_dir, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = queries.QUERIES["op7_token_files"](spark, small_dir).toPandas().sort_values("doc_id")
    at = 0
    for row, text in zip(got.itertuples(), docs.text):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op8_recall(spark, small_dir, duck):
    got = queries.QUERIES["op8_neighbours"](spark, small_dir).toPandas()
    e = duck.sql("select vec_id, embedding from embeddings order by vec_id").df()
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, rows in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5]) & set(rows.vec_id))
        assert list(rows.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5]
    assert hit / len(got) >= 0.9


def test_op6_digest_of_untouched_document(spark, small_dir, docs):
    got = queries.QUERIES["op6_line_dedup"](spark, small_dir).toPandas().set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        if got.n_dropped[i] == 0:
            assert got.kept_sha256[i] == hashlib.sha256((text or "").encode()).hexdigest()


def test_pipeline_stages(spark, small_dir, docs):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{small_dir}/documents.parquet")
    model_kept = P.by_language(spark, d, small_dir)
    assert model_kept.columns == d.columns and model_kept.count() == len(docs)
    five = {r.doc_id: set(zip(*[(r.text or "").lower().split()[k:] for k in range(5)])) or {tuple((r.text or "").lower().split())} for r in docs.itertuples()}
    kept = {r.doc_id for r in P.without_near_copies(spark, d, small_dir).select("doc_id").collect()}
    comp = {i: i for i in five}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(five)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(five[a] & five[b])
            if both and 100 * both >= 80 * (len(five[a]) + len(five[b]) - both):
                comp[max(root(a), root(b))] = min(root(a), root(b))
    assert kept == {i for i in ids if root(i) == i}
    clean = {r.doc_id for r in P.without_benchmark(spark, d, small_dir).select("doc_id").collect()}
    hits = {r.doc_id for r in queries.QUERIES["op9_decontamination"](spark, small_dir).filter("contaminated").select("doc_id").collect()}
    assert clean == set(ids) - hits
    mix = P.mixed(spark, d, small_dir).toPandas()
    assert set(mix.doc_id) <= set(ids) and (mix.groupby("doc_id").size() <= 2).all()
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in docs.text)
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in mix.text)
    assert abs(taken - 1.5 * total) <= 0.01 * total
    assert P.sharded(spark, d, small_dir).count() == len(docs)
