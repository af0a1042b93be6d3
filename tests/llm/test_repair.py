"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import count

import pytest
from rasterloom.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"
SHAPE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "good")
        seen.add((role, text))
    return out


def best(rows):
    """Cheapest edits, first in ASCII: all sequences, by growing cost."""
    kinds = faults(rows)
    todo = defaultdict(set)
    todo[0].add((0, "", ()))  # row, letters, repaired (role, text)
    for cost in count():
        done = []
        stack, seen = list(todo.pop(cost, ())), set()
        while stack:
            at, letters, out = item = stack.pop()
            if item in seen:
                continue
            seen.add(item)
            shape = "".join(r[:1] for r, _ in out)
            if not any(SHAPE.fullmatch(shape + rest) for rest in ("", "a", "ua")):
                continue
            if at == len(rows) and SHAPE.fullmatch(shape):
                done.append((letters, out))
            new = [(cost + 5, (at, letters + "I", (*out, (r, "")))) for r in ("user", "assistant")]
            if at < len(rows):
                _, role, text = rows[at]
                new.append((cost + 2, (at + 1, letters + "D", out)))
                if kinds[at] in ("good", "truncated"):
                    more = 5 * (kinds[at] == "truncated")
                    new += [(cost + more + 1, (at + 1, letters + "R", (*out, (r, text)))) for r in ("user", "assistant")]
                    if role[:1] in ("s", "u", "a"):
                        new.append((cost + more, (at + 1, letters + "K", (*out, (role, text)))))
            for c, x in new:
                if c == cost:
                    stack.append(x)
                else:
                    todo[c].add(x)
        if done:
            letters, out = min(done)
            return cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def expected(rows):
    kinds = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, letters, digest = best(rows)
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, letters, digest


def result(df):
    return {r["conv_id"]: tuple(r[x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("spill,batch", [(1 << 20, 10_000), (2, 3)])
def test_edits_are_the_cheapest(spark, spill, batch):
    rng = random.Random(spill)
    data = {}
    for conv in range(120):
        turns = sorted(rng.sample(range(12), rng.randint(1, 6)))
        data[conv] = [(t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "No!", "no end", " \n", "", f"text {t}?", "Ends. \t"])) for t in turns]
        if rng.random() < 0.2:
            data[conv][0] = (None, *data[conv][0][1:])
    rows = [(c, *r) for c, x in data.items() for r in x]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = result(cr.summarise(cr.repair(spark.createDataFrame(rows, TURNS), spill=spill)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {c: expected(x) for c, x in data.items()}


def test_a_giant_conversation_spills_and_comes_back(spark):
    n = 30_000
    df = spark.range(n).selectExpr("7L conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "concat('row ', id, '.') text")
    edits = cr.repair(df, spill=1000)
    (row,) = cr.summarise(edits).collect()
    # uaa uaa: three new roles cost less than two rows taken out
    assert row["audit"] == "KKRRRK" * (n // 6) and row["cost"] == n // 2 and row["illegal"] == n // 3
    assert edits.where("edit = 'R'").count() == n // 2


def test_pointers_leave_nothing_behind(tmp_path):
    p = cr.Pointers(f"file:{tmp_path}/x", 3)
    for i in range(20):
        p.push(i)
    assert len(p.held) < 3 and len(list((tmp_path / "x").iterdir())) == 6
    assert [p.pop() for _ in range(20)] == list(range(19, -1, -1))
    assert not list((tmp_path / "x").iterdir())


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {t}?") for c in (1, 2, None) for t in (*range(30), None)]
    got = defaultdict(list)
    for r in cr.damaged(spark.createDataFrame(rows, TURNS)).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"], r["dropped"]))
    for c, t, role, text in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = [("user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text, lot == 0)]
        assert got[c, t] == want * (2 if lot == 3 else 1)


def test_odd_rows(spark):
    long = "word " * 100_000 + "end."
    rows = [(None, None, None, None, "x"), (None, 1, "user", "Hi.", "x"), (1, None, "user", "A.", "x"), (1, None, "user", "A.", "x"), (1, 3, "assistant", long, "x"), (2, 0, None, "B.", "x"), (3, 5, "user", None, "x")]
    df = spark.createDataFrame(rows, TURNS + ", hash string")
    others = spark.createDataFrame([(9,), (1,), (9,)], "conv_id long")
    found = result(cr.summarise(cr.repair(df, others)))
    plain = defaultdict(list)
    for c, t, r, x, _ in rows:
        plain[c].append((t, " " if r is None else r, " " if x is None else x))
    want = {c: expected(x) for c, x in plain.items()}
    empty = hashlib.sha256(b"").hexdigest()
    want[9] = (0, 0, 0, 0, 0, 0, "", empty)
    assert found == want
    assert result(cr.summarise(cr.repair(spark.createDataFrame([], TURNS)))) == {}
