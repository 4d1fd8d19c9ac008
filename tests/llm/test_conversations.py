"""Conversation repair against a search over all edits, whole and in blocks, and awkward rows."""

import hashlib
import heapq
import random

import pytest

from passages.llm import conversations as conv
from passages.llm.structure_queries import damaged, op11_conversations

PATTERN = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least (cost, audit, turns) by walking edit by edit, cheapest first."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, last, turns = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            return faults, cost, audit, turns
        if (at, last) in done:
            continue
        done.add((at, last))
        for c in PATTERN[last]:
            if c != "s" and not audit.endswith("III"):
                heapq.heappush(queue, (cost + 5, audit + "I", at, c, (*turns, conv.NAMES[c] + ":")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, last, turns))
            if faults[at] not in ("blank", "duplicate"):
                extra = 5 if faults[at] else 0
                if role[:1] in PATTERN[last]:
                    heapq.heappush(queue, (cost + extra, audit + "K", at + 1, role[:1], (*turns, f"{role}:{text}")))
                for c in PATTERN[last]:
                    if c != "s":
                        heapq.heappush(queue, (cost + extra + 1, audit + "R", at + 1, c, (*turns, f"{conv.NAMES[c]}:{text}")))


def plain(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, cost, audit, turns = cheapest(rows)
    turn = {t for t, _, _ in rows if t is not None}
    gaps = max(turn) - min(turn) + 1 - len(turn) if turn else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()), turns


def made(seed, n, size):
    draw = random.Random(seed)
    texts = ["Hi.", "no", "Yes!", "  ", "", "What?\t", "cut off", "é.", "end. "]
    rows = []
    for c in range(n):
        for _ in range(draw.randint(1, size)):
            turn = None if draw.random() < 0.05 else draw.randint(-2, size)
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, turn, role, draw.choice([*texts, None, f"T{draw.randint(0, 40)}."])))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_same_as_plain(spark, block):
    rows = made(1, 60, 14)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in conv.summaries(df, block).collect()}
    turns = {}
    for r in conv.repaired(df, block).orderBy("conv_id", "at").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c in range(60):
        want, told = plain([r[1:] for r in rows if r[0] == c])
        assert got[c] == want and tuple(turns.get(c, [])) == told


def test_long_conversation_in_blocks(spark):
    rows = made(2, 1, 1) + [(7, t, *r[2:]) for t, r in enumerate(made(3, 40, 40))] + [(8, t, "user", "same.") for t in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, blocks = (sorted(map(tuple, conv.summaries(df, block).collect())) for block in (10_000, 16))
    assert whole == blocks and len(rows) > 900


def test_awkward_rows(spark):
    rows = [(None, None, None, None, 1, "x"), (None, 0, "user", "Hi.", 2, "y"), (3, 5, "assistant", "Yes.", 3, "z"), (3, 5, "assistant", "Yes.", 3, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int, id string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conv.summaries(df).collect()}
    assert got == {None: plain([r[1:4] for r in rows[:2]])[0], 3: plain([r[1:4] for r in rows[2:]])[0]}
    assert got == {r["conv_id"]: tuple(r)[1:] for r in conv.summaries(df, 1).collect()}
    assert conv.summaries(df.limit(0)).count() == 0 and conv.repaired(df.limit(0)).count() == 0


def test_query_returns_every_conversation(spark, tmp_path):
    # 1:4, 1:13 and so on: all rows of conversation 4 are dropped by their digests
    import zlib

    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, 3, "user", None), (gone + 1, None, None, "Yes.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op11_conversations(spark, str(tmp_path)).collect()}
    assert set(got) == {gone, None, gone + 1}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    left = [r for r in damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect() if r["conv_id"] is None]
    assert tuple(got[None])[1:] == plain([tuple(r)[1:] for r in left])[0]
