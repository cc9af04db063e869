"""Alignments against an automaton that carries whole audits, and repairs of damaged, odd and long conversations."""

import hashlib
import itertools
import random
import zlib

from motionlake.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string, place int, n int"


def plain(codes):
    """(cost, audit) with every state's least audit written out."""
    ways = {"": (0, ""), "u": (5, "I"), "a": (10, "II")}

    def put(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way

    for c in codes:
        part, fault, to = " uas"[c >> 2], c & 3, {}
        for state, (cost, audit) in ways.items():
            put(to, state, (cost + 2, audit + "D"))
            for due in {"": "su", "s": "u", "u": "a", "a": "u"}[state] if fault in (0, 3) else "":
                if due == part or due != "s":
                    put(to, due, (cost + 5 * (fault == 3) + (due != part), audit + ("K" if due == part else "R")))
        for _ in range(3):
            for state, (cost, audit) in list(to.items()):
                put(to, "a" if state == "u" else "u", (cost + 5, audit + "I"))
        ways = to
    return min(w for s, w in ways.items() if s in ("", "a"))


def test_alignment_of_all_short_conversations():
    for n in range(4):
        for codes in itertools.product((0, 4, 8, 12, 7, 11, 15, 5), repeat=n):
            assert repair.align(bytes(codes)) == plain(codes)


def test_alignment_of_random_and_long_conversations():
    rng = random.Random(4)
    for n in (*(rng.randint(4, 60) for _ in range(400)), 700):
        codes = bytes(rng.choice((4, 8, 4, 8, 12, 7, 11, 0, 5, 6)) for _ in range(n))
        assert repair.align(codes) == plain(codes)


def brute(rows):
    """Columns of the query by the contract's words, one conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        codes, seen = [], set()
        for _, role, text in after:
            cut = text.rstrip(" \t\n\x0b\f\r")
            fault = 1 if not cut else 2 if (role, text) in seen else 3 if cut[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append(4 * (" uas".find(role[:1]) if role[:1] in ("u", "a", "s") else 0) + fault)
        cost, audit = plain(codes)
        turns = [t for t, _, _ in after if t is not None]
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(after, after[1:]))
        left, lines, system = iter(after), [], (len(audit) - audit.count("D")) % 2
        for e in audit:
            row = next(left) if e != "I" else None
            due = ("user", "assistant")[(len(lines) - system) % 2]
            if e != "D":
                lines.append(f"{row[1] if e == 'K' else due}:{row[2] if row else ''}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(c & 3 == f for c in codes) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(5)
    rows = [(1, 0, "system", "Be kind."), (1, None, None, None), (1, 1, "user", "Why?"), (1, 1, "user", "Why?"), (1, 1, "assistant", "So."), (2, 0, "tool", ""), (None, 3, "user", "No name."), (None, None, "assistant", "x" * 100_000), (3, 5, "", " \t"), (9, 0, "user", None)]
    rows += [(conv, rng.randint(0, 9), rng.choice(("user", "assistant", "system", "umpire", None)), rng.choice(("Yes.", "No!", "open", " ", None, "é?", "line\nline."))) for conv in range(10, 60) for _ in range(rng.randint(1, 9))]
    rows += [(70, t, rng.choice(("user", "assistant")), f"turn {t % 40}.") for t in range(900)]
    table = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(5)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in repair.query(spark, str(tmp_path)).collect()}
    assert got == brute(rows)


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello there."), (1, 2, "user", "Hello there."), (2, 0, "assistant", "Alone.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = repair.plan(table)
    got = [tuple(r) for r in repair.repair(table, plans).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", 0, "user", "Hi."), (1, 1, "R", 1, "assistant", "Hello there.")]
    assert {(r.conv_id, r.audit, r.cost) for r in plans.collect()} == {(1, "KRD", 3), (2, "D", 2)}
    none = table.limit(0)
    assert repair.plan(none).count() == 0 and repair.digest(repair.repair(none, repair.plan(none))).count() == 0
