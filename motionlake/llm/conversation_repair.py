"""Conversation structure repair by Wagner-Fischer alignment to the alternating grammar ``(s?(ua)+)?``.

Every turn is one byte: the initial of its role and its first fault. A conversation's bytes are aligned to the target
strings of every feasible length at once: strings of the grammar share their ends, so one table of suffixes holds the edit
distances to all of them (a second one those to targets that begin with a system turn). The table is filled inside
Ukkonen bands: a cell further from the diagonal than the incumbent's deletions and insertions can lead is left out; the
incumbent is the cheaper of deleting all and of a greedy pass. The lengths of least cost are traced back together and the
ASCII-least audit of edits wins. Rows of the table are kept at intervals and made again while tracing, so a
long conversation needs about the square root of its table. Bytes seen before are looked up, not aligned again.

Rows move twice: once as (conversation, turn, role, digest of the text, flags) to be ordered and aligned, and once with
their texts, behind their conversation's audit, to be repaired as a stream. A task never holds the texts of a conversation; it holds
one byte a turn, as the audit that is the result does.

Defined results: rows are taken by turn, nulls first, ties by role and SHA-256 of the text; rows that repeat as a whole
are duplicates of each other; null roles and texts are one space; a null ``conv_id`` is a conversation of its own; equal roles and texts
are told by SHA-256; a conversation without rows has an empty audit and no turns; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Costs of the edits, and initials of the roles.
DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
INITIALS = "uas"
NAMES = {"u": "user", "a": "assistant"}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAR = 1 << 40
SPACES = "\\x20\\x09-\\x0D"
FLAGS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def kind_of_damage(conv_id: str | Column = "conv_id", turn: str | Column = "turn") -> Column:
    """0 to 19 by the CRC-32 of ``conv_id:turn``; a null is one space."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    return F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: each row damaged by its key; 0 copies: dropped."""
    kind = kind_of_damage()
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _keyed(turns: DataFrame) -> DataFrame:
    """Rows with nulls as one space, the key that tells texts apart, and one row a copy (``copy`` 0: only marks the conversation)."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"), copies.alias("n"))
    return rows.withColumn("copy", F.explode(F.when(F.col("n") < 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))))).drop("n")


def plan(turns: DataFrame) -> DataFrame:
    """A row for each conversation: ``conv_id``, the counts of its faults, the cost of the cheapest repair and its audit."""
    text = F.col("text")
    last = F.substring(F.rtrim(text, F.lit(common.ASCII_SPACE)), -1, 1)
    rows = _keyed(turns).select(
        "conv_id", "turn", "role", "key", "copy",
        F.when(~text.rlike(f"[^{SPACES}]"), F.lit(BLANK)).when(~last.isin(".", "!", "?"), F.lit(TRUNCATED)).otherwise(F.lit(NONE)).alias("fault"),
    ).repartition("conv_id")
    dropped = F.col("copy") == 0
    seen = Window.partitionBy("conv_id", "role", "key", dropped).orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("again", F.row_number().over(seen) > 1)
    fault = F.when(F.col("fault") == BLANK, F.lit(BLANK)).when(F.col("again"), F.lit(DUPLICATE)).otherwise(F.col("fault"))
    initial = F.substring("role", 1, 1)
    part = F.when(initial == "u", 1).when(initial == "a", 2).when(initial == "s", 3).otherwise(0)
    code = F.when(dropped, F.lit(-1)).otherwise(4 * part + fault)
    kind = dict(turns.dtypes)["conv_id"]
    rows = rows.withColumn("code", code).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "key", "again")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "code").mapInArrow(_planned, f"conv_id {kind}, {FLAGS}")


def _planned(batches):
    """Streams over rows ordered by conversation; one byte of each turn is kept."""
    held, codes, turns = None, bytearray(), [0, 0, 0]

    def close(out):
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        out.append((held[0], gaps, *_aligned(bytes(codes))))

    def table(out, kind):
        columns = list(zip(*out)) or [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    kind = None
    for b in batches:
        kind, out = b.column(0).type, []
        for conv, turn, code in zip(*(b.column(i).to_pylist() for i in range(3))):
            if held is None or held[0] != conv:
                if held is not None:
                    close(out)
                held, codes, turns = (conv,), bytearray(), [0, 0, 0]
            if code < 0:
                continue
            codes.append(code)
            if turn is not None and (not turns[2] or turn != turns[1]):
                turns = [turn if not turns[2] else turns[0], turn, turns[2] + 1]
        yield table(out, kind)
    if held is not None:
        out = []
        close(out)
        yield table(out, kind)


def _aligned(codes: bytes):
    return _short(codes) if len(codes) <= 64 else _summary(codes)


@lru_cache(100_000)
def _short(codes: bytes):
    return _summary(codes)


def _summary(codes: bytes) -> tuple[int, int, int, int, int, str]:
    faults = [codes.count(bytes([c])) for c in range(16)]
    parts = codes.translate(bytes(c >> 2 for c in range(16)) + bytes(240))
    illegal = sum((x, y) not in ((3, 1), (1, 2), (2, 1)) for x, y in zip(parts, parts[1:]))
    return *(sum(faults[f::4]) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, *align(codes)


def align(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that give role initials ``(s?(ua)+)?``; a code is 4 x (0 other, 1 u, 2 a, 3 s) + first fault."""
    free = np.frombuffer(bytes(c for c in codes if c & 3 in (NONE, TRUNCATED)), np.uint8)
    part, extra = (free >> 2).astype(np.int64), np.where(free & 3 == TRUNCATED, UNFINISHED, 0).astype(np.int64)
    m, forced = len(free), DELETE * (len(codes) - len(free))
    incumbent = min(DELETE * m, _greedy(part, extra))
    down, up = incumbent // DELETE + 1, incumbent // INSERT + 1
    top = m + up + 2
    at = np.arange(top + 1)
    letter = np.where(at % 2 == 1, 2, 1)  # of the r-th place from the end
    slope = INSERT * at

    def above(i: int, below: np.ndarray, below_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row i of both tables: the costs of aligning turns i.. to the last r letters (s: behind a system turn still to come)."""
        lo, hi = max(0, m - i - down - 1), min(top, m - i + up + 1)
        row, row_s = np.full(top + 1, FAR), np.full(top + 1, FAR)
        own = below[lo : hi + 1] + DELETE
        first = max(lo, 1)
        step = below[first - 1 : hi] + extra[i] + np.where(letter[first : hi + 1] == part[i], 0, REROLE)
        own[first - lo :] = np.minimum(own[first - lo :], step)
        row[lo : hi + 1] = np.minimum.accumulate(own - slope[lo : hi + 1]) + slope[lo : hi + 1]
        own_s = below_s[lo : hi + 1] + DELETE
        row_s[lo : hi + 1] = np.minimum(own_s, below[lo : hi + 1] + extra[i]) if part[i] == 3 else own_s
        return row, row_s

    every = max(16, isqrt(m))
    last = (np.where(at <= up + 1, slope, FAR), np.full(top + 1, FAR))
    kept, row = {m: last}, last
    for i in range(m - 1, -1, -1):
        row = above(i, *row)
        if i % every == 0:
            kept[i] = row
    ends = [(int(row[0][r]), r, False) for r in range(0, top + 1, 2)] + [(int(row[1][r]), r, True) for r in range(2, top + 1, 2)]
    cost = min(ends)[0]
    # the cheapest lengths step by step: only those with the least next letter go on
    alive = [(r, system) for c, r, system in ends if c == cost]
    audit, i, window, base = [], 0, [], 0

    def rows_at(k: int):
        nonlocal window, base
        if not window or k < base or k >= base + len(window):
            base = k - k % every
            end = min(m, base + every)
            window = [kept[end]]
            for x in range(end - 1, base - 1, -1):
                window.append(above(x, *window[-1]))
            window.reverse()
        return window[k - base]

    def moves(r: int, system: bool):
        """The least letter of a cheapest way on from turn i, and where it leads."""
        here = rows_at(i)
        left = int(here[system][r])
        if i < m:
            under = rows_at(i + 1) if i + 1 >= base + len(window) or i + 1 < base else window[i + 1 - base]
            if int(under[system][r]) + DELETE == left:
                return "D", (r, system)
        if not system and r and int(here[0][r - 1]) + INSERT == left:
            return "I", (r - 1, False)
        if system:
            return "K", (r, False)
        return ("K" if part[i] == letter[r] else "R"), (r - 1, False)

    for code in [*codes, None]:
        if code is not None and code & 3 not in (NONE, TRUNCATED):
            audit.append("D")
            continue
        while True:
            if code is None and not any(r for r, _ in alive):
                break
            found = [moves(r, system) for r, system in alive if code is not None or r]
            least = min(x for x, _ in found)
            alive = list(dict.fromkeys(state for x, state in found if x == least))
            audit.append(least)
            if least != "I":
                i += 1
                break
    return cost + forced, "".join(audit)


def _greedy(part: np.ndarray, extra: np.ndarray) -> int:
    """Cost of one way: unfinished turns go, the others stay in place with the role that is due."""
    stay = part[extra == 0]
    if not len(stay):
        return DELETE * len(part)
    cost, system = DELETE * int((extra > 0).sum()), int(stay[0] == 3)
    rest = stay[system:]
    cost += int((rest != np.where(np.arange(len(rest)) % 2, 2, 1)).sum())
    if len(rest) % 2:
        cost += DELETE
    return cost + (DELETE if system and len(rest) < 2 else 0)


def repair(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, place, edit, turn, role, text``: the repaired turns of every conversation; a partition holds whole conversations in order."""
    kinds = dict(turns.dtypes)
    rows = _keyed(turns).filter("copy > 0").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "key", "text", F.lit(None).cast("string").alias("audit"))
    heads = plans.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"), "audit")
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "key")
    return both.select("conv_id", "turn", "role", "text", "audit").mapInArrow(_repaired, f"conv_id {kinds['conv_id']}, place long, edit string, turn long, role string, text string")


def _repaired(batches):
    audit, at, place, system = "", 0, 0, 0
    conv = None

    def due() -> str:
        return "user" if (place - system) % 2 == 0 else "assistant"

    def inserted(out):
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            out.append((conv[0], place, "I", None, due(), ""))
            at, place = at + 1, place + 1

    def table(out):
        columns = list(zip(*out)) or [()] * 6
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", "place", "edit", "turn", "role", "text"])

    for b in batches:
        kind, out = b.column(0).type, []
        for c, turn, role, text, head in zip(*(b.column(i).to_pylist() for i in range(5))):
            if head is not None:
                if conv is not None:
                    inserted(out)
                conv, audit, at, place = (c,), head, 0, 0
                system = (len(audit) - audit.count("D")) % 2
                continue
            inserted(out)
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            out.append((c, place, edit, turn, due() if edit == "R" else role, text))
            place += 1
        yield table(out)
    if conv is not None:
        out = []
        inserted(out)
        yield table(out)


def digest(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the ``role:text`` lines of each conversation that has turns; ``repaired`` as ``repair`` returns it."""
    kind = dict(repaired.dtypes)["conv_id"]

    def run(batches):
        conv, sha, arrow = None, None, None

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], arrow), pa.array([x for _, x in out], pa.string())], names=["conv_id", "repaired_sha256"])

        for b in batches:
            arrow, out = b.column(0).type, []
            for c, place, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if place == 0:
                    if conv is not None:
                        out.append((conv[0], sha.hexdigest()))
                    conv, sha = (c,), hashlib.sha256()
                sha.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            yield table(out)
        if conv is not None:
            yield table([(conv[0], sha.hexdigest())])

    return repaired.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: damaged conversations, their faults and the cheapest repair."""
    common.bound_batches(spark)
    turns = damage(common.read(spark, sf_dir, "conversations"))
    plans = common.materialize(plan(turns), "repair-plans")
    lines = digest(repair(turns, plans)).withColumnRenamed("conv_id", "id")
    found = plans.join(lines, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


# The automaton of the grammar as a recursive query: start, after s, after u, after a, each with its least (cost, audit).
ORACLE_SQL = r"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
    SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda ch: CAST(unicode(ch) AS BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS kind FROM raw
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE kind <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n,
        regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS cut FROM damaged
), flagged AS (
    SELECT *, CASE WHEN cut = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
        WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS i,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before, count(*) OVER (PARTITION BY conv_id) AS rows FROM ordered
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY conv_id
), walk AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, rows, {'c': CAST(0 AS BIGINT), 'a': ''} AS q0, {'c': CAST(1000000 AS BIGINT), 'a': ''} AS q1,
        {'c': CAST(5 AS BIGINT), 'a': 'I'} AS q2, {'c': CAST(10 AS BIGINT), 'a': 'II'} AS q3 FROM flagged
    UNION ALL
    SELECT conv_id, n, rows, d0, d1, z2, list_sort([s3, {'c': z2.c + 5, 'a': z2.a || 'I'}])[1] FROM (
        SELECT *, list_sort([s2, {'c': d0.c + 5, 'a': d0.a || 'I'}, {'c': d1.c + 5, 'a': d1.a || 'I'}, {'c': s3.c + 5, 'a': s3.a || 'I'}])[1] AS z2 FROM (
            SELECT conv_id, n, rows, d0,
                list_sort([{'c': q1.c + 2, 'a': q1.a || 'D'}, {'c': q0.c + CASE WHEN i = 's' THEN 0 ELSE 1000000 END + p, 'a': q0.a || 'K'}])[1] AS d1,
                list_sort([{'c': q2.c + 2, 'a': q2.a || 'D'}, {'c': q0.c + u, 'a': q0.a || ul}, {'c': q1.c + u, 'a': q1.a || ul}, {'c': q3.c + u, 'a': q3.a || ul}])[1] AS s2,
                list_sort([{'c': q3.c + 2, 'a': q3.a || 'D'}, {'c': q2.c + v, 'a': q2.a || vl}])[1] AS s3 FROM (
                SELECT w.*, f.i, {'c': w.q0.c + 2, 'a': w.q0.a || 'D'} AS d0,
                    CASE f.fault WHEN 't' THEN 5 WHEN '' THEN 0 ELSE 1000000 END AS p, p + CASE WHEN f.i = 'u' THEN 0 ELSE 1 END AS u, CASE WHEN f.i = 'u' THEN 'K' ELSE 'R' END AS ul,
                    p + CASE WHEN f.i = 'a' THEN 0 ELSE 1 END AS v, CASE WHEN f.i = 'a' THEN 'K' ELSE 'R' END AS vl
                FROM (SELECT conv_id, n + 1 AS n, rows, q0, q1, q2, q3 FROM walk) w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n)))
), best AS (SELECT conv_id, list_sort([q0, q3])[1] AS b FROM walk WHERE n = rows
), letters AS (
    SELECT conv_id, j, substr(a, CAST(j AS INTEGER), 1) AS l, j - length(replace(substr(a, 1, CAST(j AS INTEGER)), 'I', '')) AS ins,
        length(replace(substr(a, 1, CAST(j AS INTEGER)), 'D', '')) AS place, length(replace(a, 'D', '')) % 2 AS system FROM (
        SELECT conv_id, b.a AS a, unnest(range(1, length(b.a) + 1)) AS j FROM best)
), lines AS (
    SELECT l.conv_id, string_agg(CASE WHEN l.l = 'K' THEN f.role WHEN (l.place - l.system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l.l = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY l.j) AS t
    FROM letters l LEFT JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.j - l.ins WHERE l.l <> 'D' GROUP BY l.conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
    LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
