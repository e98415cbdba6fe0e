"""Conversation repair against every stack, unmerged."""

import random
from collections import defaultdict

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, repair
from plumbline.llm.catalog import QUERIES

FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())


def wanted(rows):
    """By conversation, of rows (conv, turn, role, text) that are not yet damaged."""
    by_conv = defaultdict(list, {r[0]: [] for r in rows})
    for conv, *row in brute.damaged(rows):
        by_conv[conv].append(tuple(row))
    return {conv: brute.repair(sorted(own, key=order)) for conv, own in by_conv.items()}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query(spark, size):
    d = f"/root/testdata/sf{size}"
    want = wanted(duckdb.sql(f"select conv_id, turn, role, text from '{d}/conversations.parquet'").fetchall())
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in QUERIES["op13_repair"](spark, d).collect()}
    assert got == want


def made_rows():
    rnd, rows = random.Random(5), []
    texts = ["", " ", None, "yes.", "no", "why?", "so!\n", "\t\n", "é.", "x" * 50_000 + "."]
    for conv in [None, *range(300)]:
        for _ in range(rnd.randrange(0, 14)):
            rows.append((conv, rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", "tool", "", None, "u"]), rnd.choice(texts)))
    return rows + rows[:40]


def test_made_conversations(spark, tmp_path):
    rows = made_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("place", "fault", "edit", "_key", "cost")})
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in QUERIES["op13_repair"](spark, str(tmp_path)).collect()}
    assert got == wanted(rows)


def test_a_long_conversation_leaves_the_stack_as_it_goes(spark):
    rnd = random.Random(3)
    rows = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["a.", "b", f"{t}.", f"{t}!", ""])) for t in range(3_000)]
    got = repair.reports(repair.edits(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    stack = repair._Conversation(1)
    most, seen = 0, set()
    for _, *row in rows:
        stack.add(*row, (row[1], row[2]) in seen)
        seen.add((row[1], row[2]))
        most = max(most, len(stack.held))
    assert len(got) == 1 and got[0].cost == sum(e[8] for e in _all_edits(rows)) and most < 2 * repair._LOOK


def _all_edits(rows):
    one, seen, out = repair._Conversation(1), set(), []
    for _, turn, role, text in rows:
        out += one.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    return out + one.end()


def test_edits_hold_the_repaired_rows_and_empty_tables_give_none(spark):
    rows = [(7, 0, "system", "be kind."), (7, 1, "user", "hello."), (7, 1, "user", "hello."), (7, 2, "user", "cut of"), (7, 3, "assistant", "fine.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(repair.edits(frame).collect(), key=lambda r: r.place)
    assert [(r.edit, r.role, r.text, r.fault) for r in got] == [
        ("K", "system", "be kind.", None), ("K", "user", "hello.", None), ("D", None, None, "duplicate"), ("D", None, None, "truncated"),
        ("K", "assistant", "fine.", None),
    ]
    assert repair.reports(repair.edits(frame.limit(0))).count() == 0
    assert queries.damaged(frame.limit(0)).count() == 0
