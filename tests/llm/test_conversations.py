"""Conversation repair against a search over output patterns."""

import hashlib
import random
import re
import zlib

import pytest

from meshspark.llm import conversations

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = {}
    text = lambda v: " " if v is None else str(v)
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        r, x = text(r), text(x)
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out.setdefault(c, []).extend([(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1))
    return out


def brute(rows):
    given, out = damaged(rows), {}
    after, role_of = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    for c in {r[0] for r in rows}:
        turns = sorted(given.get(c, []), key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.md5(z[2].encode()).digest()))
        numbers = [z[0] for z in turns if z[0] is not None]
        seen, faults = set(), []
        for _, r, x in turns:
            bare = x.strip(" \t\n\x0b\f\r")
            faults.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((r, x))

        def insertions(best):
            for _ in range(4):
                for p, (cost, audit, lines) in list(best.items()):
                    q = after[p]
                    best[q] = min(best.get(q, (1 << 60,)), (cost + 2, audit + "I", (*lines, role_of[q] + ":")))
            return best

        best = insertions({0: (0, "", ())})
        for (_, r, x), fault in zip(turns, faults):
            new = {}
            put = lambda q, v: new.__setitem__(q, min(new.get(q, (1 << 60,)), v))  # noqa: B023, E731
            for p, (cost, audit, lines) in best.items():
                put(p, (cost + 3, audit + "D", lines))
                if fault not in ("b", "d"):
                    more = fault == "t"
                    keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(r[:1], {})
                    if p in keep:
                        put(keep[p], (cost + more, audit + "K", (*lines, f"{r}:{x}")))
                    put(after[p], (cost + 2 + more, audit + "R", (*lines, f"{role_of[after[p]]}:{x}")))
            best = insertions(new)
        end = min(best[q] for q in (0, 3) if q in best) if turns else (0, "", ())
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[c] = (gaps, *[faults.count(f) for f in "bdt"], illegal, end[0], end[1], hashlib.sha256("\n".join(end[2]).encode()).hexdigest())
    return out


def conversations_of(rng, n, most):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ux"]
    texts = ["a. ", "b", "", "  \n", None, "c?", "ends so.\x0b "]
    rows = []
    for c in [*range(n), None]:
        for k in range(rng.randint(0, most)):
            rows.append((c, rng.choice([k, k, k, k + 1, None]), rng.choice(roles), rng.choice([*texts, f"long {rng.randint(0, 9)}", f"end {rng.randint(0, 99)}!"])))
    return rows


@pytest.mark.parametrize("most,chunk", [(9, conversations.CHUNK), (40, 8), (12, 1)])
def test_against_search(spark, most, chunk):
    """Conversations of one chunk and of many; nulls, ties and repeated rows in all columns; further columns."""
    rows = conversations_of(random.Random(3), 60, most)
    rows += [(1000, 5, "user", "same.")] * 5 + [(1001, 0, "user", "x" * 50_000 + "."), (1001, 1, "assistant", "y" * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, _c string, _pos int").repartition(3)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.repaired_conversations(df, chunk=chunk).collect()}
    assert got == brute(rows)


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "assistant", "hello."), (1, 2, "user", "go on"), (2, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = conversations.repair(df).turns.orderBy("_c", "_pos", "seq").collect()
    assert [(r.role, r.text) for r in turns] == [("system", "be kind."), ("user", ""), ("assistant", "hello.")]
    assert conversations.repaired_conversations(df.filter("false")).count() == 0
    report = {r.conv_id: r for r in conversations.repaired_conversations(df, damaged=False).collect()}
    assert report[1].audit == "KIKD" and report[1].cost == 5 and report[2].audit == "D" and report[2].blank == 1


def test_sql(spark):
    import duckdb

    from meshspark.llm import sql

    rows = conversations_of(random.Random(5), 80, 9)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(sql.conversations())
    names = [d[0] for d in found.description]
    assert {r[names.index("conv_id")]: tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall()} == brute(rows)
