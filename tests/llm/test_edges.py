"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, each with a defined result."""

from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionlake.llm import decontamination, dom, html_extraction, jaccard_join, language_id, license_scan, line_dedup, mixing, neighbours, pfor, sharding, token_files

SCHEMA = "doc_id long, text string, lang string, source string, size long, shard int, score string, kept string, component_id long"
LONG = " ".join(f"word{i % 977} thing{i % 1009}" for i in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "a line that is shared\nown line one here", "en", "s"), (2, "A LINE that is shared \nother words in this", "en", "s"), (3, None, None, None), (4, "", "en", None),
        (5, "12 34 !!", "en", "t"), (None, "no name but a text of some words", "en", "s"), (6, LONG, "en", "s"), (7, LONG, "en", "s"), (8, "twice the same row of words", "en", "t"), (8, "twice the same row of words", "en", "t"), (9, " \t ", "fr", "u"),
    ]
    return spark.createDataFrame([(*r, 7, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(odd, none):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == 11 and sorted(r["size"] for r in rows)[:3] == [8, 8, 11]
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(none, 3).count() == 0


def test_sharding_spreads_one_text_without_ids(spark):
    """A third of the rows are one text, none of which has an id: bytes stay even, slots gapless."""
    rows = [(None if i % 3 == 0 else i, "the same text" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 6).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(got) == 3000 and (loads - got["size"].sum() / 6).abs().max() <= 2 * got["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_sharding_spreads_one_repeated_row(spark):
    """A third of the rows is the same row: ids and texts equal."""
    rows = [(7, "the same text") if i % 3 == 0 else (i, f"text {i} " + "x" * (i % 5)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 24).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(got) == 3000 and len(loads) == 24 and (loads - got["size"].sum() / 24).abs().max() <= 2 * got["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_mixing(odd, none):
    rows = {(r.doc_id, r.source, i): r for i, r in enumerate(mixing.allocate(odd).collect())}
    assert len(rows) == 11
    for r in rows.values():
        assert sum(t.words for t in r.takes) <= 2 * r["size"] and all(0 <= t.shard < 24 for t in r.takes)
    per = {}
    for r in rows.values():
        per.setdefault(r.source, [r.target, 0])[1] += sum(t.words for t in r.takes)
    assert all(abs(t - w) <= 1 for t, w in per.values())
    assert mixing.allocate(none).count() == 0 and mixing.mix(none)[1].count() == 0


def test_splitting_tree_is_exact():
    totals = mixing.even_totals(1007, 5)
    t = mixing.splitting_tree([7, 0, 1000], totals, [3])
    assert t.sum(axis=1).tolist() == [7, 0, 1000] and t.sum(axis=0).tolist() == totals.tolist() and max(totals) - min(totals) <= 3


def test_mixture_shards_hold_the_tree_s_quotas(spark):
    """Groups of two sources, so that the tree has two levels; every shard's blocks come from the written files."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), None if i % 7 == 6 else f"s{i % 7}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    planned, mixture = mixing.mix(docs, group_sources=2)
    got = mixture.toPandas()
    targets = {r.source: (r.source_size, r.target) for r in planned.collect()}
    assert len(targets) == 7 and sum(t for _, t in targets.values()) == pytest.approx(1.5 * sum(s for s, _ in targets.values()))
    assert all(t <= 2 * s for s, t in targets.values())
    for source, part in got.groupby(got.source.fillna("null")):
        assert abs(part.words.sum() - targets[None if source == "null" else source][1]) <= 1
    assert set(got.shard) <= set(range(24)) and (got.groupby(["row", "pass"]).size() == 1).all() and (got.words <= got["size"]).all()


def test_many_sources_have_no_limit(spark):
    """More sources than a group holds, most of one row."""
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    planned, mixture = mixing.mix(docs)
    words = {r.source: r.w for r in mixture.groupBy("source").agg(F.sum("words").alias("w")).collect()}
    rows = planned.collect()
    assert len(rows) == 9_000 and all(abs(words.get(r.source, 0) - r.target) <= 1 for r in rows)


def test_language_id(odd, none):
    model = language_id.compile_model({"en": [b"the cat sat on the mat and the dog"], "fr": [b"le chat est sur la table et le chien"]})
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(odd, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (9, "und")} <= got and (None, "en") in got
    assert language_id.predict(none, language_id.train(none)).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(none)).collect()} == {"und"}


def plain_ppm(training: list[bytes], text: bytes) -> float:
    """Code length of a text by the textbook rule: from the longest context down, escape method C, seen symbols excluded."""
    counts: dict = {}
    for t in training:
        padded = b"   " + t
        for i in range(3, len(padded)):
            for order in range(4):
                counts.setdefault(padded[i - order : i], {}).setdefault(padded[i], 0)
                counts[padded[i - order : i]][padded[i]] += 1

    @lru_cache(None)
    def probability(symbol: int, context: bytes, order: int) -> float:
        if order < 0:
            return 1 / 256
        context = context[len(context) - order :]
        seen = counts.get(context)
        if not seen:
            return probability(symbol, context, order - 1)
        total, kinds = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (total + kinds if kinds < 256 else total)
        rest = sum(probability(x, context, order - 1) for x in range(256) if x not in seen)
        return kinds / (total + kinds) * probability(symbol, context, order - 1) / rest

    padded = b"   " + text
    return sum(-np.log2(probability(padded[i], padded[i - 3 : i], 3)) for i in range(3, len(padded)))


def test_language_id_gives_exact_code_lengths():
    """All 256 bytes, rare contexts and unseen bytes, against a plain PPM."""
    training = {"aa": [b"the cat sat on the mat", b"", bytes(range(256))], "bb": ["le chat \u00e9tait assis, \u4e2d\u6587".encode()], "cc": [b"x" * 40]}
    texts = [b"", b"the chat", "\u4e2d\u00e9 \u0416".encode(), bytes([0, 255, 7]), b"xxxxxxy"]
    model = language_id.compile_model(training)
    want = [[plain_ppm(training[k], t) for k in model.languages] for t in texts]
    assert np.allclose(model.lengths(texts), want, atol=1e-6)


def test_line_dedup(odd, none):
    got = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup(odd).collect()}
    assert {(1, 2, 0), (2, 2, 1), (3, 1, 0), (4, 1, 0), (6, 1, 0), (7, 1, 1), (8, 1, 0)} <= got
    assert line_dedup.dedup(none).count() == 0


def test_token_files(spark, odd, none, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    for name, table, n in (("a", odd, 11), ("b", none, 0)):
        token_files.write(table, str(tmp_path / name), public.path("word_bpe_49k.json"), segment_ids=100)
        rows = token_files.read(spark, str(tmp_path / name)).orderBy("start").collect()
        assert len(rows) == n
        at = 0
        for r in rows:
            assert (r.start, len(r.ids)) == (at, 4 * r.n_tokens)
            at += r.n_tokens
    assert [r.doc_id for r in token_files.read(spark, str(tmp_path / "a")).orderBy("start").collect()][0] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000), st.integers(1, 1500))
def test_pfor_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    image = pfor.encode(ids, np.array([len(ids)]), block)
    assert (pfor.decode(image) == ids).all() and pfor.lengths_of(image).tolist() == [len(ids)]
    if len(ids) > block:
        assert (pfor.decode(image, 1, 2) == ids[block : 2 * block]).all()


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "Own line ONE here"), (2, None), (3, "..."), (4, "own line one here"), (5, "text of some words")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.scan(odd, bench).withColumn("hit", decontamination.n_hit()).collect()}
    assert got[1].hit == 4 and got[1]["items"] == [1, 4] and got[None].hit == 4 and got[3].n_words == 0 and got[7].hit == 0
    near = {r.doc_id: r["items"] for r in decontamination.scan(odd, spark.createDataFrame([(9, "twice row of words")], "item_id long, text string"), slop=2).collect()}
    assert near[8] == [9] and near[1] == []
    assert decontamination.scan(none, bench).count() == 0
    # one window a slice, so that every row is met in several slices: the repeated row stays two rows
    key = lambda r: (str(r.doc_id), r.n_words, r.hit, sorted(r["items"]))
    whole, sliced = (sorted(map(key, decontamination.scan(odd, bench, slice_windows=n).withColumn("hit", decontamination.n_hit()).collect())) for n in (10**6, 1))
    assert sliced == whole and len(sliced) == 11
    assert decontamination.scan(odd, bench.limit(0)).filter(F.size("spans") > 0).count() == 0


def test_jaccard_join(odd, none):
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in jaccard_join.join(odd).collect()}
    assert {(3, False, 3), (4, False, 4), (9, False, 9), (6, True, 6), (7, True, 6), (8, True, 8), (5, True, 5)} <= got
    assert jaccard_join.join(none).count() == 0



def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, score string"
    v = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [2.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (3, [0.0, 1.0], "x"), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [1.0, float("nan")], "x"), (7, [1.0], "x"), (None, [1.0, 1.0], "x")], schema)
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(v, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7), (0, 4, 3)]  # the shorter vector is filled with zeros
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_repeated_rows_and_extreme_vectors(spark):
    """A repeated query row, an id with two vectors, and vectors whose squares leave the range of doubles."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), *((i, [1.0, 0.1 * i]) for i in range(1, 7))]
    find = lambda r: [(x.query_id, x.rank, x.vec_id, x.score) for x in neighbours.nearest(spark.createDataFrame(r, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    got = find(rows)
    assert [x[:3] for x in got] == [(0, i, i) for i in range(1, 6)]
    assert all(abs(s - 1 / np.hypot(1, 0.1 * i)) < 1e-15 for _, _, i, s in got)
    got = find([*rows, (0, [0.0, 1.0]), (9, [0.0, 2.0])])
    assert [x[:3] for x in got] == [(0, 1, 9), (0, 2, 1), (0, 3, 2), (0, 4, 3), (0, 5, 4)]
    got = find([(0, [1e200, 0.0]), (1, [1e-200, 1e-201]), (2, [5e-324, 0.0]), (3, [1.0, 1.0]), (4, [-1e300, 1e300])])
    assert [x[:3] for x in got] == [(0, 1, 2), (0, 2, 1), (0, 3, 3), (0, 4, 4)]
    assert np.allclose([x[3] for x in got], [1, 1 / np.sqrt(1.01), np.sqrt(0.5), -np.sqrt(0.5)], atol=1e-15)


def test_html(spark):
    page = '<html><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><main><h1>Ti&amp;tle</h1><p>One <i>two</i>\nthree<p>Four<ul><li>a<li>b</ul><div class="comments"><p>no</p></div><form><p>x</p></form></main><aside>s</aside><script>var a="</p>"</script></html>'
    assert html_extraction.extract(page) == "Ti&tle\n\nOne two three\n\nFour\n\na\n\nb"
    assert html_extraction.extract(None) == html_extraction.extract("") == ""
    same = "".join(f"<p>Read the terms of this site {i}</p>" for i in range(2))
    pages = [f"<body><div id=x><p>{'story ' * (9 + k)}</p>{same}</div></body>" for k in range(4)]
    wrapper = None
    for p in pages:
        wrapper = html_extraction.fold(wrapper, p)
    path, fixed = html_extraction.content_slot(wrapper)
    assert path == "body>div.x" and fixed == [] and wrapper.pages == 4
    a, b = (dom.Slot([dom.parse(f"<div><ul>{x}</ul><p>1</p></div>")]) for x in ("<li>1<li>2", "<li>1<li>3<li>4"))
    assert dom.match(a, b, {}) == 5  # root, div, list, items and paragraph
    dom.merge(a, b, {})
    assert a.children[0].children[0].children[0].texts == {"1"} and a.pages == 2
    t = spark.createDataFrame([(1, None, None, "x"), (2, "http://h/a", page, "x"), (2, "http://h/a", page, "x"), (None, "http://h/b", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, len(r.text)) for r in html_extraction.extract_pages(t).collect()) == [(0, 0), (1, 0), (2, 33), (2, 33)]
    assert html_extraction.extract_pages(t.limit(0)).count() == 0
    assert html_extraction.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_license_scan(spark):
    t = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/f.py", "code"), (3, "a/b/LICENSE", "Licensed under CC BY 4.0."), (4, "z/f.py", None), (5, None, "Released under the MIT License."), (6, "a/f.py", "x\nLicensed under the Apache License, Version 2.0.")], "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.how, r.origin) for r in license_scan.scan(t).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("CC-BY-4.0", "inherited", "a/b"), 3: ("CC-BY-4.0", "own", None), 4: (None, "none", None), 5: ("MIT", "own", None), 6: ("Apache-2.0", "own", None)}
    assert license_scan.scan(t.limit(0)).count() == 0
