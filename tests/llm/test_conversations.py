import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strandwise.llm import conversations as cv

BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return out


def plain(rows):
    """Least (cost, audit) by a search over whole edit sequences, conversation by conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:256].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            body = text.strip(BLANK)
            faults.append("blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, state, lines = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(own) and state in ("", "a"):
                break
            new = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            name = {"u": "user", "a": "assistant"}[new]
            heapq.heappush(heap, (cost + 2, audit + "I", i, new, (*lines, name + ":")))
            if i < len(own):
                _, role, text = own[i]
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
                if faults[i] not in ("blank", "dup"):
                    more = cost + (faults[i] == "cut")
                    if role[:1] == new or (state == "" and role[:1] == "s"):
                        heapq.heappush(heap, (more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                    heapq.heappush(heap, (more + 2, audit + "R", i + 1, new, (*lines, f"{name}:{text}")))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, faults.count("blank"), faults.count("dup"), faults.count("cut"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), list(lines)))
    return sorted(out, key=repr)


def made(seed, convs, turns):
    r = random.Random(seed)
    role = lambda: r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "sage", None])
    text = lambda: r.choice(["Yes.", "No", "What? ", "", " \t", "Well !\n", "same.", "über.", None, f"n{r.random()}."])
    return [(c, r.choice([t, t, t, t + 1, None]), role(), text()) for c in [*range(convs), None] for t in range(r.randrange(1, turns))]


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block long")
    got = sorted((tuple(r) for r in cv.repair_report(df).collect()), key=repr)
    want = plain(rows)
    assert got == [w[:-1] for w in want]
    return df, want


def test_against_a_search_over_edits(spark):
    df, want = check(spark, made(2, 60, 14))
    turns = {}
    for r in cv.repaired_turns(df).collect():
        turns.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    assert {c: [line for _, line in sorted(v)] for c, v in turns.items()} == {w[0]: w[-1] for w in want if w[-1]}
    assert len({w[6] for w in want}) > 5


@pytest.fixture
def all_partitions(spark):
    """Small exchanges keep their partitions, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_over_many_tasks(spark, all_partitions):
    rows = made(5, 3, 6) + [(77, t, r, x) for t, (_, _, r, x) in enumerate(made(6, 1, 2)[:1] + made(9, 90, 14))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    blocks = cv._blocks(df.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]))
    assert len({r.part for r in blocks.filter("conv_id = 77").select("part").collect()}) > 1
    check(spark, rows)


def test_equal_rows_and_empty_table(spark, all_partitions):
    rows = [(1, 4, "user", "Copy.")] * 700 + [(2, None, "assistant", "b"), (2, None, "user", "a.")]
    df, _ = check(spark, rows)
    assert cv.repair_report(df.limit(0)).collect() == [] and cv.repaired_turns(df.limit(0)).collect() == []


def test_damage(spark):
    rows = made(8, 40, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, cv.damage(df).collect()), key=repr) == sorted(damaged(rows), key=repr)


def test_query_returns_every_conversation(spark, tmp_path):
    rows = [(c, t, "user", "Hello.") for c in range(60) for t in range(1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in cv.op12_conversation_repair(spark, str(tmp_path)).collect()}
    gone = set(range(60)) - {r[0] for r in damaged(rows)}
    assert set(got) == set(range(60)) and gone
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)


def test_ways_through_pieces_add_up():
    r = random.Random(3)
    for _ in range(40):
        codes = "".join(r.choice("suaxSUAX-=") for _ in range(r.randrange(100)))
        whole = cv.matrix(codes)
        k = r.randrange(len(codes) + 1)
        a, b = cv.matrix(codes[:k]), cv.matrix(codes[k:])
        assert whole == [[min((a[q][m] + b[m][x] for m in range(4) if a[q][m] is not None and b[m][x] is not None), default=None) for x in range(4)] for q in range(4)]
