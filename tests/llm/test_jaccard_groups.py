"""The n-gram Jaccard join against brute force where groups are large, sets are short of segments, and short sets need deletions."""

import numpy as np
import pytest

from motionlake.llm import jaccard_join


def brute_components(texts: dict, n: int, percent: int) -> dict:
    sets = {}
    for name, t in texts.items():
        w = t.lower().split()
        size = min(n, len(w))
        sets[name] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    label = {k: k for k in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def edited(rng, words: list, most: int) -> str:
    out = list(words)
    for _ in range(int(rng.integers(0, most + 1))):
        at = int(rng.integers(0, len(out)))
        kind = rng.integers(0, 3)
        if kind == 0 and len(out) > 2:
            del out[at]
        elif kind == 1:
            out[at] = f"n{rng.integers(0, 40)}"
        else:
            out.insert(at, f"n{rng.integers(0, 40)}")
    return " ".join(out)


@pytest.mark.parametrize("n,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_components_of_large_groups(spark, n, percent, seed):
    """Two groups of seventy texts around one base each, edited so that pairs lie on both sides of the threshold; a third
    of the second group has a passage of the first; and short texts of 3 to 14 words with one or two edits."""
    rng = np.random.default_rng(seed)
    base = [[f"w{b}x{i}" for i in rng.integers(0, 400, 90)] for b in range(2)]
    texts = []
    for b in (0, 1):
        texts += [edited(rng, base[b], 9) for _ in range(70)]
    texts += [" ".join(base[0][:60]) + " " + edited(rng, base[1][30:60], 4) for _ in range(30)]
    short = [[f"s{b}x{i}" for i in range(k)] for b, k in enumerate((3, 4, 7, 9, 11, 14))]
    texts += [edited(rng, s, 2) for s in short for _ in range(12)]
    texts = dict(enumerate(texts))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows, n, percent).collect()}
    want = brute_components(texts, n, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 30  # there are links to find


def test_small_direct_limits_change_nothing(spark, monkeypatch):
    """Every group larger than four goes through residual prefixes and further pivots."""
    monkeypatch.setattr(jaccard_join, "DIRECT", 4)
    monkeypatch.setattr(jaccard_join, "DIRECT_RESIDUAL", 10)
    monkeypatch.setattr(jaccard_join, "PIVOT_ROWS", 3)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 300, 70)]
    texts = dict(enumerate(edited(rng, base, 10) for _ in range(24)))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows).collect()} == brute_components(texts, 4, 85)


def test_a_set_short_of_segments_makes_its_band_finer(spark, monkeypatch):
    """With far too few segments planned, the bands are signed again and no link is lost."""
    plan = jaccard_join.Bands._plan
    monkeypatch.setattr(jaccard_join.Bands, "_plan", lambda self, b, others, related=0.01: (2, False) if plan(self, b, others)[0] > 2 else plan(self, b, others))
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 300, 60)]
    texts = dict(enumerate(edited(rng, base, 8) for _ in range(12)))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows).collect()} == brute_components(texts, 4, 85)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(7)
    bands = jaccard_join.Bands(85, 400, {4: 1000})
    for size in (6, 8, 11, 20, 47, 130, 333):
        for _ in range(30):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            t = int(rng.integers(-(-size * 85 // 100), size + 1))
            most = int(jaccard_join.bound(size, t, 85))
            gone = (most + size - t) // 2
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, max(0, most - gone), dtype=np.uint64)])
            sets = [np.unique(a), np.unique(b)]
            if not jaccard_join.bound(len(sets[0]), len(sets[1]), 85):
                continue
            keys, names, short = jaccard_join.signatures(sets, np.array([1, 2]), bands)
            assert short or set(keys[names == 1].tolist()) & set(keys[names == 2].tolist())


def test_candidates_of_near_copies_do_not_grow_with_the_square(spark, monkeypatch):
    """Copies of one text with up to fifteen words replaced: what meets in a residual bucket and cannot link is ruled out there."""
    made, check = [], jaccard_join._may_link

    def counted(pairs, tokens, percent):
        made.append(pairs.count())
        return check(pairs, tokens, percent)

    monkeypatch.setattr(jaccard_join, "_may_link", counted)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    texts = {0: " ".join(base)}
    for k in range(1, 300):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 16))):
            words[at] = f"n{rng.integers(0, 100000)}"
        texts[k] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows, 5, 80).collect()}
    assert got == brute_components(texts, 5, 80)
    assert sum(made) < 2 * len(texts)


def test_pairs_that_sketches_rule_out_are_not_compared(spark, monkeypatch):
    """Texts that share a quarter with the next one meet in small buckets, but none is near another; the last two are copies but for a word."""
    made, check = [], jaccard_join.compare

    def counted(pairs, *rest):
        made.append(pairs.count())
        return check(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "compare", counted)
    texts = {k: " ".join(f"w{k}x{i}" for i in range(90)) + " " + " ".join(f"w{k + 1}x{i}" for i in range(30)) for k in range(40)}
    texts[40] = texts[39] + " end"
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows, 5, 80).collect()}
    assert got == brute_components(texts, 5, 80) and got[40][1] == 39
    assert sum(made) == 1


def test_sketches_of_any_length_keep_linked_pairs(spark):
    """Sets around the sizes at which sketches double; linked and unlinked ones."""
    rng = np.random.default_rng(9)
    sets = {}
    for k, size in enumerate((3, 900, 1020, 1030, 2040, 2060, 5000)):
        s = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        extra = rng.integers(0, 1 << 63, size // 20, dtype=np.uint64)
        sets |= {3 * k: s, 3 * k + 1: np.unique(np.concatenate([s, extra])), 3 * k + 2: np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))}
    drawn = spark.createDataFrame([(k, len(s), jaccard_join._sketch(s)) for k, s in sets.items()], "sid long, size long, sketch array<long>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a > b], "a long, b long")
    kept = {(r.a, r.b) for r in jaccard_join._may_link(pairs, drawn, 80).collect()}
    linked = {(a, b) for a in sets for b in sets if a > b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked == kept and len(linked) == 7


def unlike_with_a_notice(rng, many: int) -> dict:
    """Texts that have nothing but a notice in common, and for every tenth of them a near copy."""
    notice = " ".join(f"notice{i}" for i in range(150))
    texts = {k: " ".join(f"w{i}" for i in rng.integers(0, 1_000_000, 70)) + " " + notice for k in range(many)}
    return texts | {many + k: texts[k].replace(" ", " x ", 1 + k % 3) for k in range(0, many, 10)}


@pytest.mark.parametrize("in_lots", [8192, 0])
def test_unlike_sets_of_one_pivot_make_no_residual_rows(spark, monkeypatch, in_lots):
    """Sets that meet in a large bucket without being near its pivot: lots of them meet, no prefix is listed; without lots the result is the same."""
    prefixes, check = [], jaccard_join.compare

    def counted(*args):
        out = check(*args)
        if args[3]:
            prefixes.extend(len(r.prefix) for r in out.filter("prefix is not null").collect())
        return out

    monkeypatch.setattr(jaccard_join, "compare", counted)
    monkeypatch.setattr(jaccard_join, "IN_LOTS", in_lots)
    monkeypatch.setattr(jaccard_join, "LOT_ROWS", 30)
    texts = unlike_with_a_notice(np.random.default_rng(10), 120)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows, 5, 80).collect()}
    assert got == brute_components(texts, 5, 80) and len({c for _, c in got.values()}) == 120
    assert bool(sum(prefixes)) == (in_lots == 0)


@pytest.mark.parametrize("in_lots", [8192, 0])
def test_near_copies_of_several_texts_in_lots_or_by_prefixes(spark, monkeypatch, in_lots):
    """Families of near copies, on both sides of the threshold, that share a notice and so a pivot; lots of about 20, or prefixes only."""
    monkeypatch.setattr(jaccard_join, "IN_LOTS", in_lots)
    monkeypatch.setattr(jaccard_join, "LOT_ROWS", 20)
    monkeypatch.setattr(jaccard_join, "DIRECT_BUCKET", 8)
    rng = np.random.default_rng(11)
    notice = [f"notice{i}" for i in range(150)]
    base = [[f"w{i}" for i in rng.integers(0, 1000, 80)] for _ in range(4)]
    texts = dict(enumerate(edited(rng, b + notice, 14) for b in base for _ in range(30)))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows, 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_pairs_of_lots_are_those_that_sketches_of_any_length_leave():
    """Against all pairs one by one; two lots list only pairs between them, and hubs reach every set that has a near one."""
    rng = np.random.default_rng(12)
    sets = []
    for size in (40, 1000, 1030, 2040, 2060):
        s = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets += [np.unique(np.concatenate([s[: size - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (0, size // 40, size // 20, size // 3)]
    sid, comp, lot = np.arange(len(sets)) + 5, np.arange(len(sets)) // 2 * 2, np.arange(len(sets)) % 2
    size, sketches = np.array([len(s) for s in sets]), [np.array(jaccard_join._sketch(s), np.int64) for s in sets]

    def linked(a, b):
        return 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))

    for lots in (np.zeros_like(lot), lot):
        apart = [(a, b) for a in range(len(sets)) for b in range(a) if comp[a] != comp[b] and (lots[a] != lots[b] or not lots.any())]
        a, b = jaccard_join._near_rows(sid, comp, lots, size, sketches, 80, False)
        assert set(zip((a - 5).tolist(), (b - 5).tolist(), strict=True)) == {p for p in apart if linked(*p)} != set()
        x, y = jaccard_join._near_rows(sid, comp, lots, size, sketches, 80, True)
        assert {*x, *y} == {*a, *b} and set(zip(x, y, strict=True)) <= set(zip(a, b, strict=True))


def test_op10_lists_no_prefixes_of_unlike_sets(spark, monkeypatch):
    """The settings of op10: a prefix is listed by no set of a group that meets in lots."""
    listed, check = [], jaccard_join.compare

    def counted(*args):
        out = check(*args)
        listed.append(out.filter("prefix is not null").count() if args[3] else 0)
        return out

    monkeypatch.setattr(jaccard_join, "compare", counted)
    texts = unlike_with_a_notice(np.random.default_rng(13), 80)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows).collect()}
    assert got == brute_components(texts, 4, 85) and sum(listed) == 0


def test_few_edges_take_one_step_and_absent_cases_none(spark, monkeypatch):
    """The driver plans and keeps every query: few edges are tied up in one step, and no table is made for cases without a row."""
    made, store = [], jaccard_join.common.materialize

    def noted(df, name, *rest, **more):
        made.append(name)
        return store(df, name, *rest, **more)

    monkeypatch.setattr(jaccard_join.common, "materialize", noted)
    rng = np.random.default_rng(14)
    base = [f"w{i}" for i in range(200)]
    texts = dict(enumerate(" ".join(base[k : k + 150]) for k in rng.permutation(50)))  # each links with its next ones only
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows).collect()}
    assert got == brute_components(texts, 4, 85) and {c for _, c in got.values()} == {0}
    assert made.count("stars") == made.count("components") > 0
    assert not {"residual-rows", "residual-buckets", "open-buckets"} & set(made)


@pytest.mark.parametrize("at_once", [500_000, 40])
def test_components_over_several_tasks(spark, monkeypatch, at_once):
    """A long path in random order, a tree and loose pairs, tied up in blocks of any size."""
    monkeypatch.setattr(jaccard_join, "TIED_EDGES", at_once)
    rng = np.random.default_rng(15)
    p = rng.permutation(400)
    edges = [*zip(p[1:250], p[:249]), *((p[250 + k], p[250 + (k - 1) // 2]) for k in range(1, 90)), *zip(p[340:370], p[370:400])]
    label = {int(x): int(x) for x in p}
    for _ in range(len(p)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    links = spark.createDataFrame([(int(a), int(b)) for a, b in edges] + [(int(p[0]), int(p[0]))], "a long, b long").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = jaccard_join.components(links).collect()
        assert jaccard_join.components(links.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(label) and {r.sid: r.comp for r in got} == label
