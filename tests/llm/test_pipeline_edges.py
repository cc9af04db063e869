"""Every pipeline stage on nulls, empty and very long texts, ties, repeated rows, clashing column names and an empty table."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, words long, h long, t string, copy_id long, component_id long, lang_pred string, score double, spans string, row long"
LONG = " ".join(f"word{i % 977} thing{i % 1009}" for i in range(30_000))
TEXT = "the quick brown fox jumps over the lazy dog and runs away from the old barn"


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


@pytest.fixture(scope="module")
def odd(spark, duck):
    passage = duck.sql("select text from benchmark order by length(text) desc, item_id limit 1").fetchall()[0][0]
    rows = [
        (1, TEXT, "en", "s"), (2, TEXT.upper(), "en", "s"), (3, None, None, None), (4, "", "en", None), (5, "12 34 !!", "en", "t"), (None, "a text without a name of its own here", "en", "s"),
        (6, LONG, "en", "s"), (7, LONG + " end", "en", "t"), (8, "the same row comes twice in this table", "en", "t"), (8, "the same row comes twice in this table", "en", "t"), (9, " \t ", "fr", "u"), (10, f"before {passage} after", "en", "u"),
    ]
    rest = (7, 1, 2, 3, "t", 5, 6, "x", 0.5, "y", 9)
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *rest) for i, t, lang, s in rows], SCHEMA).repartition(3)


def ids(df):
    return sorted(((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect()))


def named(*numbers):
    return sorted([(False, n) for n in numbers if n] + [(True, 0) for n in numbers if not n])


def test_language_stage(spark, small_dir, pipeline, odd):
    kept = pipeline.by_language(spark, odd, small_dir)
    assert tuple(kept.columns) == pipeline.COLUMNS and ids(kept) == named(1, 2, None, 6, 7, 8, 8, 10)


def test_near_copy_stage(spark, small_dir, pipeline, odd):
    kept = pipeline.without_near_copies(spark, odd, small_dir)
    assert tuple(kept.columns) == pipeline.COLUMNS and ids(kept) == named(1, 3, 4, 5, None, 6, 8, 9, 10)


def test_benchmark_stage(spark, small_dir, pipeline, odd):
    kept = pipeline.without_benchmark(spark, odd, small_dir)
    assert tuple(kept.columns) == pipeline.COLUMNS and ids(kept) == named(1, 2, 3, 4, 5, None, 6, 7, 8, 8, 9)


def test_mixing_stage(spark, small_dir, pipeline, odd):
    mixed = pipeline.mixed(spark, odd, small_dir)
    rows = mixed.collect()
    assert tuple(mixed.columns) == pipeline.COLUMNS and not {3, 4, 9} & {r.doc_id for r in rows}
    whole = {r.doc_id: len((r.text or "").split()) for r in odd.collect()}
    taken = sum(len(r.text.split()) for r in rows)
    total = sum(len((r.text or "").split()) for r in odd.collect())
    assert abs(taken - 1.5 * total) <= 3 and all(len(r.text.split()) <= whole[r.doc_id] and r.n_chars == len(r.text) for r in rows)


def test_sharding_stage(spark, small_dir, pipeline, odd):
    rows = pipeline.sharded(spark, odd, small_dir).collect()
    assert len(rows) == 12 and all(0 <= r.shard < 24 for r in rows)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in {r.shard for r in rows})


def test_stages_of_an_empty_table(spark, small_dir, pipeline, odd):
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd.limit(0), small_dir)
        assert out.count() == 0 and (name == "sharding" or tuple(out.columns) == pipeline.COLUMNS)


def test_mixing_stores_each_text_once_and_leaves_no_shuffle_files(spark, small_dir, pipeline, monkeypatch):
    import time

    from motionlake.llm import common

    stored, store = {}, common.materialize

    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(i).getName()) for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    def kept(df, name, *rest, **options):
        before = shuffle_files()
        out = store(df, name, *rest, **options)
        until = time.time() + 20
        while (more := shuffle_files() - before) and time.time() < until:
            time.sleep(0.2)
        stored[name] = (out.count(), len(more))
        return out

    monkeypatch.setattr(common, "materialize", kept)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    mixed = pipeline.mixed(spark, docs, small_dir)
    assert stored["mix-texts"] == (mixed.select("doc_id").distinct().count(), 0) and stored["mix-texts"][0] < mixed.count()
    assert not any(left for _, left in stored.values())
