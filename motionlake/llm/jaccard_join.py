"""Exact n-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of its distinct word shingles (64-bit hashes). Two sets of sizes s and t link only if they differ in
at most ``bound(s, t)`` shingles. Sizes fall into bands; a band's scheme deals the hash universe into m segments. Walking
its segments in order, a set signs the subset in each until what it has signed is worth more than its bound: a segment
compared exactly is worth one difference, and one compared up to one deletion (the subset and every subset that lacks one
shingle) is worth two. Of two similar sets the one with the shorter walk disagrees in fewer differences than it has signed,
so some signature of theirs is equal. Empty segments are worth nothing and are not signed, so signatures carry shingles
only. A set signs under its own band and, if its smallest partner lies there, under the band below. m and the kind of
segment are chosen by cost for each band, with so many segments that a set short of them is not to be expected; should one
turn up, its band is signed again with more.

Sets with a common signature meet in a bucket. The sets of a bucket of more than a few are compared with one of them, the pivot: the
set that meets most others. Buckets of few sets come last: of their pairs across components the sketches rule out almost all that do
not link; of the others each set is compared with one first, and the rest only across components. Sets are stored and sent only if
they lie in a large bucket or in such a pair. Every comparison is exact, on the whole shingle sets. Components are merged, and what is left are pairs of which one, x,
does not link with the pivot p. In a group of one pivot of up to some thousand sets, lots of its sets meet each other and whole sketches rule
pairs out where they meet; of those left each set is compared with the one that is near most others first, and the rest only across
components. In larger groups, with E(x) the shingles in which x and p differ, |E(x)| + |E(y)| then exceeds what x and y
may differ in, so x and y link only if E(x) and E(y) have shingles in common, at least half of the excess; in a fixed order of
shingles it is enough to look at a prefix of each, no longer than the bound of x. These prefixes are the next, much smaller buckets;
a row stays in one only if some other row in it leaves room for enough shingles in common. A large group of near copies thus costs a few comparisons a member, whether its members link or not, and no link between components is lost.

Defined results: a null, empty or blank text has no shingle, links with nothing and is its own component; fewer words
than ``n`` are one shingle; a null ``doc_id`` is an ordinary row, which has no smallest id to give; repeated rows are
equal sets; an empty table gives an empty result; other columns of ``docs`` are ignored whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

KEPT_WORDS = 100_000
#: Shingles that a worker signs at once; a larger set is signed alone.
SIGN_AT_ONCE = 100_000
#: Upper end of a size band over its lower end.
BAND_WIDTH = 1.5
#: Buckets of at most this many sets list all of their pairs for the sketches to rule out.
DIRECT_BUCKET = 32
#: Groups of one pivot with at most this many sets are compared directly, without lots or residual prefixes.
DIRECT = 12
#: Groups of one pivot with more sets, but at most this many, meet in lots: a set is sent 16 times at most, fewer than a prefix has shingles.
IN_LOTS = 8192
#: About so many sets of a group are a lot.
LOT_ROWS = 512
#: Buckets of equal residual shingles in which all sets times those outside the main component exceed its square get pivots of their own.
DIRECT_RESIDUAL = 1024
#: Bits of the parity sketch of a set of at most as many shingles; a larger set has the next power of two.
SKETCH_BITS = 1024
#: 64-bit words of the sketch that candidate rows carry.
FOLDED_WORDS = 4
#: Rows of one pivot that share a copy of its shingles in a join.
PIVOT_ROWS = 256
#: Edges that a task ties up at once.
TIED_EDGES = 500_000
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> S30)) * C2
    x = (x ^ (x >> S27)) * C3
    return x ^ (x >> S31)


class _WordHashes(dict):
    """word -> 63 bits of its hash; emptied when it holds KEPT_WORDS words, so a worker's memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


_hashes = _WordHashes()


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split()  # of bytes: only A-Z, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words)).view(np.uint64)
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size))
    for i in range(size):
        h = h * C1 + w[i : len(w) - size + 1 + i]
        if size < n:
            h = _mix(h)
    return np.unique(_mix(h))


def set_name(s: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _short_name(name: bytes) -> int:
    """What Spark's ``xxhash64`` gives for ``name``."""
    return int(np.uint64(xxhash.xxh64_intdigest(name, seed=42)).view(np.int64))


def bound(s, t, percent: int):
    """Shingles in which sets of sizes ``s`` and ``t`` may differ and still link."""
    return (s + t) * (100 - percent) // (100 + percent)


class Bands:
    """Size bands and, for each, its scheme: m segments, compared exactly or (``deep``) up to one deletion."""

    def __init__(self, percent: int, largest: int, sets: dict[int, int] | None = None):
        self.percent = percent
        low, high = [], []
        lo = 1
        while lo <= max(1, largest):
            low.append(lo)
            high.append(max(lo, int(lo * BAND_WIDTH)))
            lo = high[-1] + 1
        self.low, self.high = np.array(low), np.array(high)
        plans = [self._plan(b, (sets or {}).get(b, 0) + (sets or {}).get(b + 1, 0)) for b in range(len(low))]
        self.m, self.deep = np.array([p[0] for p in plans], np.int64), np.array([p[1] for p in plans], bool)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1

    def need(self, sizes: np.ndarray, band: np.ndarray, below: bool) -> np.ndarray:
        """What a set has to sign: one more than it may differ in from any partner in the scheme."""
        largest = self.high[band] if below else sizes * 100 // self.percent
        return bound(sizes, largest, self.percent) + 1

    def finer(self, band: int) -> None:
        """More segments for a band in which a set was short of them."""
        self.m[band], self.deep[band] = max(16, self.m[band] * 4), False

    def _plan(self, b: int, others: int, related: float = 0.01) -> tuple[int, bool]:
        """The cheaper of exact and one-deletion segments: rows that a set signs and sets it is expected to meet, if the part
        ``related`` of the others have half of its shingles. The assumption moves the cost only: either finds every link."""
        lo, hi = int(self.low[b]), int(self.high[b])
        most = hi * 100 // self.percent
        cases = [(s, int(bound(s, s * 100 // self.percent, self.percent)) + 1) for s in (lo, (lo + hi) // 2, hi)]
        cases.append((most, int(bound(most, hi, self.percent)) + 1))
        need = max(n for _, n in cases)
        if need <= 1:
            return 1, False
        m = need
        while any(_log_short(s, n, m) > -30 for s, n in cases):
            m += 1 + m // 50
        size = (lo + hi) / 2

        def cost(segments: int, deep: bool) -> float:
            per = size / segments
            return (1 + size if deep else need) + others * related * segments * 0.5 ** max(0.0, per - deep)

        # one segment up to one deletion is worth two for any set of two shingles; several could be short
        return (1, True) if need <= 2 and cost(1, True) < cost(m, False) else (m, False)


def _log_short(size: int, need: int, m: int) -> float:
    """Log of a bound on the chance that fewer than ``need`` of m segments hold one of ``size`` shingles."""
    k = need - 1
    if k == 0:
        return -math.inf
    if m <= k:
        return 0.0
    return math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + size * math.log(k / m)


def signatures(sets: list[np.ndarray], names: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """(key, name) of all signatures of the sets, and the bands in which a set was short of segments."""
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    own = bands.of(sizes)
    below = bands.of(-(-sizes * bands.percent // 100))
    keys, who, short = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], set()
    for down, band in ((False, own), (True, below)):
        need = bands.need(sizes, band, down)
        use = (need > 1) & ((below < own) if down else True)  # without a difference to allow, only equal sets link
        if not use.any():
            continue
        keep = use[doc]
        hh, dd = h[keep], doc[keep]
        m = np.where(use, bands.m[band], 0)
        first = np.cumsum(m) - m
        with np.errstate(over="ignore"):
            salt = (band.astype(np.uint64) + np.uint64(1)) * C1
            slot = first[dd] + ((_mix(hh ^ salt[dd]) >> np.uint64(11)).astype(np.int64) % m[dd])
            total = int(m.sum())
            part = _mix(hh + C3)
            sums = np.zeros(total, np.uint64)
            np.add.at(sums, slot, part)
            count = np.bincount(slot, minlength=total)
            at = np.repeat(np.arange(len(sets)), m)
            segment = np.arange(total) - first[at]
            deep = bands.deep[band][at]
            worth = np.minimum(count, 1 + deep)
            before = np.cumsum(worth) - worth
            walked = before - before[np.minimum(first, total - 1)][at]
            signed = (worth > 0) & (walked < need[at])
            worths = np.bincount(at, worth, minlength=len(sets))
            short |= set(band[use & (worths < need)].tolist())
            place = _mix(salt[at] + segment.astype(np.uint64) * C2)
            keys.append(_mix(sums + count.astype(np.uint64) * C1 + place)[signed])
            who.append(names[at[signed]])
            lack = (signed & deep & (count >= 2))[slot]
            keys.append(_mix(sums[slot][lack] - part[lack] + (count[slot][lack] - 1).astype(np.uint64) * C1 + place[slot][lack]))
            who.append(names[dd[lack]])
    return np.concatenate(keys).view(np.int64), np.concatenate(who), short


def set_names(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, text_hash, name, size, sketch``: ``name`` (null: no shingle) is equal for equal sets."""

    def run(batches):
        for batch in batches:
            sizes, names, sketches = [], [], []
            for t in common.byte_texts(batch.column(1)):
                s = shingles(t, n)
                sizes.append(len(s))
                names.append(set_name(s) if len(s) else None)
                sketches.append(_sketch(s) if len(s) else None)
            out = [batch.column(0), batch.column(2), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "text_hash", "name", "size", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, name binary, size long, sketch array<long>")


def _sign(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """``key, short_name`` of all signatures. A null key marks a set that was short of segments, its band in ``short_name``."""
    shared = docs.sparkSession.sparkContext.broadcast(bands)

    def rows_of(sets: list[np.ndarray]):
        k, names, short = signatures(sets, np.array([_short_name(set_name(s)) for s in sets], np.int64), shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(names)], names=["key", "short_name"])
        if short:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(short), pa.int64()), pa.array(sorted(short), pa.int64())], names=["key", "short_name"])

    def run(batches):
        sets, held = [], 0
        for batch in batches:
            for t in common.byte_texts(batch.column(0)):
                s = shingles(t, n)
                if len(s):
                    sets.append(s)
                    held += len(s)
                if held >= SIGN_AT_ONCE:
                    yield from rows_of(sets)
                    sets, held = [], 0
        if sets:
            yield from rows_of(sets)

    return docs.select("text").mapInArrow(run, "key long, short_name long")


def _tokens(texts: DataFrame, n: int) -> DataFrame:
    """``sid, tokens``: the shingles of each ``sid, text`` as sorted 64-bit numbers."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, n).tobytes() for t in common.byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["sid", "tokens"])

    return texts.select("sid", "text").mapInArrow(run, "sid long, tokens binary")


def _sketch(s: np.ndarray) -> list[int]:
    """Each shingle flips one bit. Folding a sketch by halves gives the one of half as many bits."""
    bits = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length())
    parity = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64).tolist()


def _may_link(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """``pairs`` without those that cannot link for certain: sketches differ in at most as many bits as the sets in shingles."""
    p = pairs.join(drawn.withColumnRenamed("sid", "b").hint("merge"), "b")
    p = p.join(drawn.select(F.col("sid").alias("a"), F.col("size").alias("other_size"), F.col("sketch").alias("other_sketch")).hint("merge"), "a")
    half = lambda c, n: F.when(F.size(c) > n, F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    n = F.least(F.size("sketch"), F.size("other_sketch"))
    differ = F.zip_with(half("sketch", n), half("other_sketch", n), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    differ = F.aggregate(differ, F.lit(0).cast("long"), lambda a, x: a + x)
    p = p.filter(_near(percent))  # of two such sets one sketch is at most twice as long
    return p.filter((100 + percent) * differ <= (100 - percent) * (F.col("size") + F.col("other_size"))).select("a", "b")


#: Columns of a set's folded sketch.
FOLDED = [f"w{i}" for i in range(FOLDED_WORDS)]


def _folded(drawn: DataFrame) -> DataFrame:
    """``sid`` and the sketch folded to ``FOLDED_WORDS`` words, still one flipped bit for each shingle."""
    fold = lambda i: F.aggregate(F.filter("sketch", lambda x, j: j % FOLDED_WORDS == i), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    return drawn.select("sid", *[fold(i).alias(w) for i, w in enumerate(FOLDED)])


def _residual(p: np.ndarray, y: np.ndarray, removed: np.ndarray, added: np.ndarray, linked: bool, percent: int) -> np.ndarray:
    """The prefix of the shingles in which ``y`` differs from its pivot ``p`` that a link across components has to touch. Order:
    those that ``y`` adds, then those that it lacks, either by hash; the added ones tell most."""
    differ = len(removed) + len(added)
    most = int(bound(len(y), len(y) * 100 // percent, percent))
    # the other set differs from p by at least `other`
    other = max(0, differ - most)
    if linked:  # then the other one does not link with p
        other = max(other, int(bound(-(-len(y) * percent // 100), len(p), percent)) + 1)
    length = (differ - other + most) // 2 + 1
    return np.concatenate([added, removed])[: max(0, length)]


def compare(pairs: DataFrame, tokens: DataFrame, percent: int, residuals: bool) -> DataFrame:
    """Stored ``a, b, linked`` of every pair of set ids in ``pairs`` (``a, b``), by their whole shingle sets; with ``residuals`` also
    ``differ``, the number of shingles in which they differ, and, of an ``a`` of more than ``IN_LOTS`` pairs, the ``prefix`` of these. The rows of one ``a`` are dealt in lots of ``PIVOT_ROWS``, each with one copy of its shingles."""

    def run(batches):
        last, p = None, None
        for batch in batches:
            a, own = batch.column(0).to_pylist(), batch.column(3)
            linked, differ, prefixes = [], [], []
            placed = batch.column(4).to_pylist() if residuals else []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, p = a[i], np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64).copy()
                y = np.frombuffer(own[i].as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(p, y), len(p) - 1)
                there = p[place] == y
                both = int(there.sum())
                linked.append(100 * both >= percent * (len(p) + len(y) - both))
                if residuals:
                    differ.append(len(p) + len(y) - 2 * both)
                    lacking = np.ones(len(p) if placed[i] else 0, bool)
                    if placed[i]:
                        lacking[place[there]] = False
                    prefixes.append(_residual(p, y, p[lacking], y[~there], linked[-1], percent).view(np.int64) if placed[i] else None)
            out = [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())]
            if residuals:
                out += [pa.array(differ, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["a", "b", "linked", "differ", "prefix"][: len(out)])

    # shingle sets are large: each is sent once for every pair it is b of, and a pivot's once for every lot; where the list of pairs
    # is small enough to be sent everywhere, the sets of the others stay where they are
    lots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS).cast("int").alias("lots"), (F.count(F.lit(1)) > max(DIRECT, IN_LOTS)).alias("placed"))
    lots = common.materialize(lots, "lots")
    small = pairs.count() <= common.BROADCAST_ROWS  # then so are the lots
    few = F.broadcast(lots) if small else common.broadcast_if_small(lots)
    firsts = tokens.select(F.col("sid").alias("a"), F.col("tokens").alias("tokens_a")).join(few.drop("placed"), "a")
    firsts = firsts.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    dealt = pairs.join(few, "a").withColumn("lot", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int")).select("a", "b", "lot", "placed")
    seconds = tokens.select(F.col("sid").alias("b"), F.col("tokens").alias("tokens_b"))
    t = seconds.join(F.broadcast(dealt) if small else dealt, "b").join(firsts.drop("lots").hint("merge"), ["a", "lot"])
    out = t.select("a", "b", "tokens_a", "tokens_b", "placed").mapInArrow(run, "a long, b long, linked boolean" + (", differ long, prefix array<long>" if residuals else ""))
    out = common.materialize(out, "compared")
    common.discard(lots)
    return out


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges but the smallest of each component, and that smallest one of theirs."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        # every root that an edge ties to a smaller one takes the smallest of these; then all follow to their roots
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (after := label[label])).any():
            label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _tied(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` that connect the same nodes as ``edges``: up to ``TIED_EDGES`` at once of a task's edges become one from each of their nodes to
    the smallest that it is connected with."""

    def run(batches):
        u, v, held = [], [], 0

        def out():
            nodes, least = _least(np.concatenate(u), np.concatenate(v))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], names=["u", "v"])

        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= TIED_EDGES:
                yield out()
                u, v, held = [], [], 0
        if held:
            yield out()

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """``sid, comp`` of all sets in ``links`` (``a, b``): the smallest set id reachable. Edges are tied up where they lie and where those of
    a node meet; what tasks leave open is settled by alternating large and small stars."""
    edges, last = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), None
    for _ in range(most):
        after = common.materialize(_tied(_tied(edges).repartition("u")), "stars")
        if last is not None:
            common.discard(last)
        edges = last = after
        # done when every node has one neighbour and no root has any
        ends = edges.select(F.col("u").alias("node"), "v").unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
        ends = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.bool_or(F.col("v").isNull()).alias("root"))
        if ends.filter("low <> high or (root and low is not null)").isEmpty():
            break
        # large star: every larger neighbour of u is tied to u's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "low"), F.struct(F.col("u").alias("v"), F.col("low")))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.low").alias("v"))
        edges = small.filter("u <> v").distinct()
    else:
        raise RuntimeError("components did not settle")
    out = common.materialize(edges.select(F.col("u").alias("sid"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("sid"), F.col("v").alias("comp"))).distinct(), "components")
    common.discard(edges)
    return out


def distinct_sets(named: DataFrame) -> DataFrame:
    """One row per distinct set: ``sid`` (a number), ``name, short_name, size, sketch, copies``, ``rep`` (its first row) and ``least_id``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    sets = named.filter("size > 0").groupBy("name").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"), first.alias("rep"), F.min("doc_id").alias("least_id"))
    return sets.select(F.monotonically_increasing_id().alias("sid"), "name", F.xxhash64("name").alias("short_name"), "size", "sketch", "copies", "rep", "least_id")


def _with_components(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``rows`` (``key, sid``) of the keys that lie in several components, with ``comp``, the key's ``main`` component and its rows ``n``."""
    rows = rows.withColumn("comp", F.col("sid")) if comp is None else rows.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("part"))
    keys = parts.groupBy("key").agg(F.max(F.struct("part", "comp")).alias("top"), F.sum("part").alias("n"), F.count(F.lit(1)).alias("parts"))
    keys = keys.filter("parts > 1").select("key", F.col("top.comp").alias("main"), F.col("top.part").alias("main_n"), "n")
    return rows.join(keys, "key")


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``comp`` (none yet: None), which are discarded if there are ``links``, joined by these."""
    if comp is not None and links.isEmpty():
        return comp
    out = components(links if comp is None else links.unionByName(comp.select(F.col("sid").alias("a"), F.col("comp").alias("b"))))
    if comp is not None:
        common.discard(comp)
    return out


def _within_reach(parts: DataFrame, percent: int) -> DataFrame:
    """``parts`` without rows that can link with none of their key. By the places of their first common shingle, x and y link only
    if ``differ`` of each is at most ``differ - 2 * at`` of the other plus what both may differ in, and one of them is outside the main component."""
    room, outside = F.col("differ") - 2 * F.col("at"), F.col("comp") != F.col("main")
    ends = parts.groupBy("key").agg(
        F.max("size").alias("largest"), F.min("differ").alias("low"), F.max(room).alias("room"),
        F.min(F.when(outside, F.col("differ"))).alias("low_outside"), F.max(F.when(outside, room)).alias("room_outside"),
    )
    most = F.floor((F.col("size") + F.least("largest", F.floor(F.col("size") * 100 / percent))) * (100 - percent) / (100 + percent))
    low, far = [F.when(outside, F.col(c)).otherwise(F.col(f"{c}_outside")) for c in ("low", "room")]
    return parts.join(ends, "key").filter((low <= room + most) & (F.col("differ") <= far + most)).select("key", "sid", "size", "differ", "at")


def _near(percent: int):
    return 100 * F.least("size", "other_size") >= percent * F.greatest("size", "other_size")


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` (``a`` the larger id) of different components with a common key, of rows whose keys have a bounded number of them.
    Sizes and folded sketches rule out pairs where they meet."""
    met = rows.groupBy("key").agg(F.collect_list(F.struct("sid", "comp", "size", *FOLDED)).alias("met")).select("met", F.explode("met").alias("x"))
    x = F.col("x")

    def may(y):
        most = F.floor((x["size"] + y["size"]) * (100 - percent) / (100 + percent))
        sizes = 100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"])
        return (y["sid"] < x["sid"]) & (y["comp"] != x["comp"]) & sizes & (reduce(Column.__add__, [F.bit_count(x[w].bitwiseXOR(y[w])) for w in FOLDED]) <= most)

    return met.select(x["sid"].alias("a"), F.explode(F.transform(F.filter("met", may), lambda y: y["sid"])).alias("b")).distinct()


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """``pairs`` that lie in different components."""
    few = common.broadcast_if_small(comp)
    p = pairs.join(few.select(F.col("sid").alias("a"), F.col("comp").alias("comp_a")), "a", "left").join(few.select(F.col("sid").alias("b"), F.col("comp").alias("comp_b")), "b", "left")
    return p.filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def _direct(rows: DataFrame, percent: int, placed: bool) -> DataFrame:
    """Pairs ``a, b`` of different components with a common key: the rows outside a key's main component against all of its rows.
    Folded sketches that differ in more bits than the sets may in shingles rule a pair out where the rows meet.
    ``placed``: the key is a shingle at place ``at`` of the ``differ`` in which a set differs from its pivot; the first that a linked
    pair has in common has so many common ones after it that it stands early in both."""
    mark = [*FOLDED, *(["at", "differ"] if placed else [])]
    other = rows.select("key", F.col("sid").alias("a"), F.col("comp").alias("other_comp"), F.col("size").alias("other_size"), *[F.col(m).alias(f"other_{m}") for m in mark])
    outside = rows.filter(F.col("comp") != F.col("main"))
    # of two rows outside, the one with the larger id brings the pair
    keep = (F.col("comp") != F.col("other_comp")) & ((F.col("other_comp") == F.col("main")) | (F.col("sid") > F.col("a"))) & _near(percent)
    most = F.floor((F.col("size") + F.col("other_size")) * (100 - percent) / (100 + percent))
    keep &= reduce(Column.__add__, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"other_{w}"))) for w in FOLDED]) <= most
    if placed:
        common_ones = F.ceil((F.col("differ") + F.col("other_differ") - most) / 2)
        keep &= (F.col("at") <= F.col("differ") - common_ones) & (F.col("other_at") <= F.col("other_differ") - common_ones)
    both = outside.join(other, "key").filter(keep)
    return both.select(F.greatest("a", "sid").alias("a"), F.least("a", "sid").alias("b")).distinct()


def _near_rows(sid: np.ndarray, comp: np.ndarray, lot: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], percent: int, hubs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (the larger id first) of sets of different components, from two lots if there are two, whose sizes and whole sketches do not rule
    a link out; with ``hubs`` of each set only the one with that of its near sets that is near most others."""
    near = np.zeros((len(sid), len(sid)), bool)
    words, two = np.array([len(s) for s in sketches]), lot.min() != lot.max()
    for w in np.unique(words):
        own, longer = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)  # of two linked sets one sketch is at most twice as long
        at = np.concatenate([own, longer])
        bits = np.stack([sketches[i] for i in own] + [sketches[i][:w] ^ sketches[i][w:] for i in longer])
        for k, x in enumerate(own):
            may = (comp[at] != comp[x]) & (100 * np.minimum(size[at], size[x]) >= percent * np.maximum(size[at], size[x]))
            may[:k] = False
            if two:
                may &= lot[at] != lot[x]
            y = at[may]
            differ = np.bitwise_count(bits[may] ^ bits[k]).sum(axis=1, dtype=np.int64)
            y = y[(100 + percent) * differ <= (100 - percent) * (size[y] + size[x])]
            near[x, y] = near[y, x] = True
    if hubs:
        many = near.sum(axis=1)
        x = np.flatnonzero(many)
        y = np.where(near[x], many, -1).argmax(axis=1) if len(x) else x
    else:
        x, y = np.nonzero(np.triu(near))
    return np.maximum(sid[x], sid[y]), np.minimum(sid[x], sid[y])


def _in_lots(group: DataFrame, drawn: DataFrame, percent: int, hubs: bool) -> DataFrame:
    """Pairs ``a, b`` of different components of the ``group`` rows (``key, sid, comp, n``) of a key, as ``_near_rows`` finds them in every two lots."""

    def run(rows: pa.Table) -> pa.Table:
        column = lambda c: rows.column(c).to_numpy()
        sid = column("sid")
        order = np.argsort(sid)  # reruns find the same pairs
        sketches = rows.column("sketch").combine_chunks()
        ends, flat = sketches.offsets.to_numpy(), sketches.values.to_numpy()
        sketches = [flat[ends[i] : ends[i + 1]] for i in order]
        a, b = _near_rows(sid[order], column("comp")[order], column("lot")[order], column("size")[order], sketches, percent, hubs)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = group.select("key", "sid", "comp", F.ceil(F.col("n") / LOT_ROWS).cast("int").alias("lots")).join(drawn.select("sid", "size", "sketch"), "sid")
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("sid"), F.col("lots")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    rows = rows.select("key", F.least("lot", "other").alias("first"), F.greatest("lot", "other").alias("second"), "sid", "comp", "lot", "size", "sketch")
    return rows.groupBy("key", "first", "second").applyInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``doc_id, text_hash, name, size`` of every row; the distinct sets; ``sid, comp`` of the sets that link with another)."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    docs = docs.select("doc_id", "text")
    named = common.materialize(set_names(docs, n), "set-names")
    sets = common.materialize(distinct_sets(named), "sets")
    largest = sets.agg(F.max("size")).first()[0] or 0
    bands = Bands(percent, largest)
    edges = F.array(*[F.lit(int(x)) for x in bands.low])
    band = F.size(F.filter(edges, lambda x: x <= F.col("size"))) - 1
    bands = Bands(percent, largest, {r.band: r["count"] for r in sets.groupBy(band.alias("band")).count().collect()})

    # every distinct set is signed once: the rows of other copies are left out
    copies = named.join(sets.filter("copies > 1").select("name", "rep"), "name").filter((F.col("text_hash") != F.col("rep.text_hash")) | ~F.col("doc_id").eqNullSafe(F.col("rep.doc_id")))
    copies = common.materialize(copies.select(F.col("doc_id").alias("copy_id"), F.col("text_hash").alias("copy_hash")).distinct(), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.xxhash64("text") == F.col("copy_hash"))
    once = docs.join(common.broadcast_if_small(copies), same, "left_anti") if copies.limit(1).count() else docs
    while True:
        # hashed by key once: the sets of a key are made distinct and counted where they are
        signed = _sign(once, n, bands).repartition(common.shuffle_partitions(spark), "key").groupBy("key", "short_name").agg(F.lit(1).alias("one"))
        signed = signed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1 or key is null")
        shared = common.materialize(signed.select("key", "short_name", "n"), "shared-signatures")
        del signed
        short = [r.short_name for r in shared.filter("key is null").distinct().collect()]  # bands: a few dozen
        if not short:
            break
        common.discard(shared)
        for b in short:
            bands.finer(b)
    # sets whose short names collide meet as well
    clash = sets.groupBy("short_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("short_name").alias("key"), "short_name", "n")
    buckets = common.materialize(shared.unionByName(clash).join(sets.select("short_name", "sid", "size"), "short_name").select("key", "sid", "size", "n"), "buckets")
    common.discard(shared, copies)

    drawn = common.materialize(buckets.select("sid").distinct().join(sets.select("sid", "size", "sketch"), "sid"), "sketches")
    small = F.col("n") <= DIRECT_BUCKET

    def stored(sids: DataFrame) -> DataFrame:
        involved = sids.distinct().join(sets, "sid").select("sid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
        involved = common.materialize(involved, "involved")
        is_rep = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.xxhash64("text") == F.col("rep_hash"))
        many = involved.count()
        texts = docs.join(F.broadcast(involved) if many <= common.BROADCAST_ROWS else involved, is_rep).select("sid", "text")
        tokens = common.materialize(_tokens(texts, n), "set-shingles")
        if tokens.count() > many:  # a representative row that is repeated
            repeated, tokens = tokens, common.materialize(tokens.dropDuplicates(["sid"]), "set-shingles")
            common.discard(repeated)
        common.discard(involved)
        return tokens

    def linked(pairs: DataFrame, tokens: DataFrame, comp: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """The comparison of ``pairs`` (None: there are none), and the components joined by its links."""
        if pairs.isEmpty():
            return None, comp
        found = compare(pairs, tokens, percent, False)
        return found, _merged(comp, found.filter("linked").select("a", "b"))

    # large buckets; first round: all of a bucket against the set that meets most others
    scores = buckets.groupBy("sid").agg(F.sum("n").alias("score"))
    rows = buckets.filter(~small).join(scores, "sid")
    comp, folded = None, _folded(drawn)
    tokens = stored(rows.select("sid"))
    while True:
        pivots = rows.groupBy("key").agg(F.max(F.struct("score", "sid")).alias("p"))
        pairs = rows.join(pivots, "key").filter("sid <> p.sid").select(F.col("p.sid").alias("a"), F.col("sid").alias("b")).distinct()
        pairs = common.materialize(pairs, "pairs")
        found = compare(pairs, tokens, percent, True)
        common.discard(rows, pairs)
        comp = _merged(comp, found.filter("linked").select("a", "b"))
        # what is left lies in the groups of one pivot: small ones as they are, larger ones in lots, the largest by the prefixes of their residuals
        group = found.select(F.col("a").alias("key"), F.col("b").alias("sid"), "differ", "prefix")
        group = _with_components(group, comp).join(drawn.select("sid", "size"), "sid")
        group = common.materialize(group, "groups")
        common.discard(found)
        # steps for which there is no row are left out
        in_lots, by_prefix = (F.col("n") > DIRECT) & (F.col("n") <= IN_LOTS), F.col("n") > max(DIRECT, IN_LOTS)
        held = group.agg(F.bool_or(in_lots).alias("lots"), F.bool_or(by_prefix).alias("prefixes")).first()
        lots, reached, parts, still, others, rows = group.filter(in_lots), None, None, None, None, None
        pairs = _direct(group.filter(F.col("n") <= DIRECT).join(folded, "sid"), percent, False)
        few = F.col("n") * (F.col("n") - F.col("main_n")) <= DIRECT_RESIDUAL**2
        if held.prefixes:
            parts = group.filter(by_prefix).select("sid", "size", "differ", "key", F.posexplode("prefix").alias("at", "shingle"))
            parts = parts.select(F.xxhash64("key", "shingle").alias("key"), "sid", "size", "differ", "at")
            reached = common.materialize(_within_reach(_with_components(parts, comp), percent), "residual-rows")
            parts = common.materialize(_with_components(reached, comp), "residual-buckets")
            pairs = pairs.unionByName(_direct(parts.filter(few).join(folded, "sid"), percent, True)).distinct()
        pairs = _may_link(pairs, drawn, percent)
        if held.lots:
            pairs = pairs.unionByName(_in_lots(lots, drawn, percent, True)).distinct()
        pairs = common.materialize(pairs, "pairs")
        own, comp = linked(pairs, tokens, comp)
        if held.lots:
            still = _in_lots(_with_components(lots.select("key", "sid"), comp), drawn, percent, False).join(pairs, ["a", "b"], "left_anti")
            still = common.materialize(still, "pairs")
            others, comp = linked(still, tokens, comp)
        # larger residual buckets take another pivot each; it is in none of the next ones, so they shrink
        if held.prefixes:
            rest = _with_components(parts.filter(~few).select("key", "sid", "size").distinct(), comp)
            rows = common.materialize(rest.join(scores, "sid").select("key", "sid", "size", "score"), "open-buckets")
        common.discard(group, reached, parts, pairs, own, still, others)
        if rows is None or rows.isEmpty():
            break
    common.discard(tokens, rows)

    # small buckets: each set of the pairs that may link against one other, then what lies in different components still
    near = _with_components(buckets.filter(small).select("key", "sid", "size"), comp).join(folded, "sid")
    near = common.materialize(_may_link(_all_pairs(near, percent), drawn, percent), "near")
    common.discard(buckets, drawn)
    tokens = stored(near.select(F.explode(F.array("a", "b")).alias("sid")))
    first = common.materialize(near.groupBy("b").agg(F.max("a").alias("a")).select("a", "b"), "pairs")
    found, comp = linked(first, tokens, comp)
    rest = common.materialize(_across(near.join(first, ["a", "b"], "left_anti"), comp), "pairs")
    own, comp = linked(rest, tokens, comp)
    common.discard(near, tokens, first, found, rest, own)
    return named, sets, comp


def classes(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """``name, label, smallest, keeper`` of the sets that have copies or links: the class's smallest ``doc_id`` and first row."""
    s = sets.join(comp, "sid", "left").filter("copies > 1 or comp is not null").withColumn("label", F.coalesce("comp", "sid"))
    s = s.select("name", "label", "least_id", "rep")
    return s.join(s.groupBy("label").agg(F.min("least_id").alias("smallest"), F.min("rep").alias("keeper")), "label").select("name", "label", "smallest", "keeper")


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_shingles, component_id`` (smallest ``doc_id`` reachable by links)."""
    named, sets, comp = link(docs, n, percent)
    rows = named.join(classes(sets, comp), "name", "left")
    return rows.select("doc_id", "text_hash", F.col("size").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def copies_to_drop(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``copy_id, copy_hash`` (``doc_id`` and hash of the text) of all rows but one of every class of linked documents. A row that
    is repeated as a whole is not told from its repetition: rows equal to the kept one are not listed."""
    named, sets, comp = link(docs, n, percent)
    rows = named.join(classes(sets, comp), "name")
    rows = rows.filter((F.col("text_hash") != F.col("keeper.text_hash")) | ~F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")))
    return common.materialize(rows.select(F.col("doc_id").alias("copy_id"), F.col("text_hash").alias("copy_hash")).distinct(), "copies-to-drop")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the component of every document."""
    return join(common.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
with recursive listed as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingled as (
  select distinct doc_id, array_to_string(list_slice(w, p, p + least(4, len(w)) - 1), ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) as p from listed where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingled group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as i from shingled a join shingled b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), edges as (
  select x, y from shared join sizes s on x = s.doc_id join sizes t on y = t.doc_id where 100 * i >= 85 * (s.n + t.n - i)
), two_way as (select x, y from edges union select y, x from edges),
reach as (select doc_id as x, doc_id as y from documents union select r.x, b.y from reach r join two_way b on r.y = b.x),
low as (select x, min(y) as component_id from reach group by x)
select d.doc_id, coalesce(s.n, 0)::BIGINT as n_shingles, l.component_id from documents d left join sizes s on d.doc_id = s.doc_id join low l on d.doc_id = l.x
"""
