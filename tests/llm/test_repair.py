"""Interval parsing against a search over all edit scripts, and whole queries on small tables."""

import hashlib
import itertools
import random
import re
import zlib

from threadsieve.llm import repair
from threadsieve.llm.queries import QUERIES


def brute(symbols):
    """Least (cost, audit) over all scripts, states as text: every edit of every row, up to two insertions at a place."""
    best = None
    pattern = re.compile(r"(s?(ua)+)?$")
    fills = ["", "u", "a", "ua", "au"]
    options = [[("D", "", 2)] if s == "x" else [
        ("D", "", 2), ("K", s.lower(), 5 if s.isupper() else 0), ("R", "u", 6 if s.isupper() else 1), ("R", "a", 6 if s.isupper() else 1)]
        for s in symbols]
    for edits in itertools.product(*options):
        for gaps in itertools.product(fills, repeat=len(symbols) + 1):
            word, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
            for (edit, initial, price), gap in zip(edits, gaps[1:]):
                word += initial + gap
                audit += edit + "I" * len(gap)
                cost += price + 5 * len(gap)
            if (best is None or (cost, audit) < best) and pattern.match(word):
                best = (cost, audit)
    return best


def test_chart_equals_search():
    cells = {}
    for n in range(4):
        for symbols in itertools.product("xsuaSUAo", repeat=n):
            if n < 3 or hash(symbols) % 7 == 0:
                assert repair.parse("".join(symbols), cells) == brute(symbols), symbols
    rng = random.Random(3)
    for _ in range(3):
        symbols = "".join(rng.choices("xsuaUAoO", k=4))
        assert repair.parse(symbols, cells) == brute(symbols), symbols


def row_by_row(symbols):
    """The same least value from left to right, a state at a time."""
    best = {q: v for (p, q), v in repair.INSERTED.items() if p == 0}
    for s in symbols:
        new = {}
        for (p, q), (cost, audit) in repair.terminal(s).items():
            if p in best:
                found = (best[p][0] + cost, best[p][1] + audit)
                new[q] = min(new.get(q, found), found)
        best = new
    return min(best[q] for q in (0, 3) if q in best)


def test_long_conversations_equal_a_walk_from_left_to_right():
    rng = random.Random(8)
    for n in (15, 16, 17, 33, 80, 400):
        for _ in range(3):
            symbols = "".join(rng.choices("xsuaSUAo", [1, 1, 6, 6, 1, 2, 2, 1], k=n))
            assert repair.parse(symbols, {}) == row_by_row(symbols)


def expected(rows):
    """Plain Python version of the query for one conversation's damaged rows, in order."""
    seen, symbols, faults, initials = set(), "", [], []
    for _, role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        initials.append(initial)
        symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    cost, audit = row_by_row(symbols)
    said, at, left = [], 0, len(audit) - audit.count("D")
    for edit in audit:
        at += edit != "I"
        if edit != "D":
            left -= 1
            role = rows[at - 1][1] if edit == "K" else "user" if left % 2 else "assistant"
            said.append(f"{role}:{'' if edit == 'I' else rows[at - 1][2]}")
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest()}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out[conv] += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {k: sorted(v, key=key) for k, v in out.items()}


def test_query_on_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Hello.", "Hello", "", None, "A longer one?\n", "ends here! \t", "x" * 50_000, "é."]
    rows = [(c, t, rng.choices(roles, [6, 6, 2, 1, 1, 1])[0], rng.choices(texts, [4, 2, 1, 1, 4, 4, 1, 2])[0])
            for c in [*range(40), None] for t in [*range(rng.randint(1, 12)), None, 3]]
    rows += rows[:60]
    rows += [(500, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(90)]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, n int")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in QUERIES["op11_repair"](spark, str(tmp_path)).collect()}
    want = damage(rows)
    assert set(got) == set(want)
    for conv, these in want.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == expected(these), conv


def test_conversation_without_rows_is_reported_and_empty_table(spark, tmp_path):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_repair"](spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.gaps, r.cost, r.audit, r.repaired_sha256) for r in got] == [(lost, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired(rows.where("false")).count() == 0


def test_repaired_turns_follow_the_pattern(spark, sf):
    turns = repair.repaired(repair.damaged(spark.read.parquet(f"{sf}/conversations.parquet")))
    for r in turns.collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in r.turns))
