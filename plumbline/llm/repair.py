"""Conversation structure repair: generalised LR over the role grammar `(s?(ua)+)?` with weighted edits.

The input of the parser is a conversation's rows; its actions are Keep, Delete, Rerole and Insert.  All parses
run side by side on a graph-structured stack.  The grammar is regular, so a stack is told by its top, one of
four states; tops that are equal after a row are merged into the one of least (cost, audit) and share what lies
below.  Audits are never compared as whole strings: those of different tops after a row are prefix-free (each
has consumed the row with its last letter), so the order of two longer ones is the order of their tops, then of
the letters added.  A top dearer than the cheapest by more than two Inserts is dropped, as the cheapest can do
whatever it can for less.  What lies below every live top is decided and leaves the task at once.

Rows are shuffled by conversation and sorted there; a task reads them as a stream and holds only undecided rows,
and no text of a row that must go.  Whether a text stood earlier in its conversation is found before by
an aggregate that combines map-side, so a common text is no single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import salted_join, slices

KEEP, DELETE, REROLE, INSERT = "K", "D", "R", "I"
# fixed values: prices of the edits, and what a truncated row costs that stays
PRICE = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
_GAPS = " \t\n\x0b\x0c\r"
_ENDS = (".", "!", "?")
#: Moves of the automaton: state -> role initial -> state. A conversation may end in 0 (no rows) or 3 (after an answer).
_MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_FINAL = (0, 3)
_NAMES = {"u": "user", "a": "assistant"}
#: The role that Rerole and Insert give, by state.
_GIVES = {state: next(i for i in moves if i in _NAMES) for state, moves in _MOVES.items()}
#: Rows between two looks for decided edits; rows of a batch handed on.
_LOOK, _BATCH = 256, 2_000


def _inserts(state: int) -> list[tuple[str, int]]:
    """Insert strings from a state and the states they lead to; a third Insert only goes round."""
    out = [("", state)]
    for n in (1, 2):
        state = _MOVES[state][_GIVES[state]]
        out.append((INSERT * n, state))
    return out


_BEFORE = {state: [(s, PRICE[INSERT] * len(s), q) for s, q in _inserts(state)] for state in _MOVES}


class Stack:
    """The graph-structured stack of one conversation: state -> (cost, rank among the tops, chain of edits)."""

    def __init__(self) -> None:
        self.tops: dict[int, tuple[int, int, tuple | None]] = {0: (0, 0, None)}

    def push(self, initial: str, fault: str | None) -> None:
        """Take one row: every edit of every top, merged by least (cost, audit)."""
        best: dict[int, tuple] = {}
        late = TRUNCATED if fault == "truncated" else 0
        for state, (cost, rank, chain) in self.tops.items():
            for inserted, price, q in _BEFORE[state]:
                edits = [(DELETE, q, PRICE[DELETE])]
                if fault in (None, "truncated"):
                    edits.append((REROLE, _MOVES[q][_GIVES[q]], PRICE[REROLE] + late))
                    if initial in _MOVES[q]:
                        edits.append((KEEP, _MOVES[q][initial], PRICE[KEEP] + late))
                for letter, to, more in edits:
                    made = (cost + price + more, rank, inserted + letter, chain)
                    if to not in best or made[:3] < best[to][:3]:
                        best[to] = made
        cheapest = min(made[0] for made in best.values())
        live = sorted((made[1], made[2], to) for to, made in best.items() if made[0] <= cheapest + 2 * PRICE[INSERT])
        self.tops = {to: (best[to][0], rank, (best[to][3], letters)) for rank, (_, letters, to) in enumerate(live)}

    def finish(self) -> tuple[int, str]:
        """(cost, letters) after the last row; leaves the chosen top alone on the stack."""
        ways = [(cost + price, rank, inserted, chain) for state, (cost, rank, chain) in self.tops.items() for inserted, price, q in _BEFORE[state] if q in _FINAL]
        cost, _, inserted, chain = min(ways, key=lambda w: w[:3])
        self.tops = {0: (cost, 0, chain)}
        return cost, inserted

    def decided(self) -> list[str]:
        """Letters, a string per row, below every live top; they leave the stack."""
        chains = []
        for _, _, chain in self.tops.values():
            links = []
            while chain is not None:
                links.append(chain)
                chain = chain[0]
            chains.append(links[::-1])
        shared = 0
        while shared < len(chains[0]) and all(c[shared] is chains[0][shared] for c in chains):
            shared += 1
        out = [letters for _, letters in chains[0][:shared]]
        if shared:
            moved: dict[int, tuple] = {}  # links above are made anew, without what lies below; those that tops share stay shared
            for links in chains:
                below = None
                for link in links[shared:]:
                    below = moved.setdefault(id(link), (below, link[1]))
            heads = [moved[id(links[-1])] if len(links) > shared else None for links in chains]
            self.tops = {s: (cost, rank, head) for (s, (cost, rank, _)), head in zip(self.tops.items(), heads, strict=True)}
        return out


def _fault(text: str, repeated: bool) -> str | None:
    told = text.rstrip(_GAPS)
    return "blank" if not told else "duplicate" if repeated else None if told.endswith(_ENDS) else "truncated"


class _Conversation:
    """Rows of one conversation on their way through the stack."""

    def __init__(self, key) -> None:
        self.key, self.stack, self.held, self.state, self.place, self.before = key, Stack(), [], 0, 0, None

    def add(self, turn, role: str, text: str, repeated: bool) -> list[tuple]:
        row = (turn, role, text)
        fault = _fault(text, repeated or row == self.before)
        pair = (self.before[1][:1] + role[:1]) if self.before else None
        self.before = row
        self.stack.push(role[:1], fault)
        gone = fault in ("blank", "duplicate")
        self.held.append((turn, role, None if gone else text, fault, pair is not None and pair not in ("su", "ua", "au")))
        return self._leave() if len(self.held) % _LOOK == 0 else []

    def end(self) -> list[tuple]:
        _, inserted = self.stack.finish()
        return self._leave() + [self._insert() for _ in inserted]

    def _insert(self) -> tuple:
        initial = _GIVES[self.state]
        self.state, self.place = _MOVES[self.state][initial], self.place + 1
        return (self.key, self.place, None, INSERT, _NAMES[initial], "", None, False, PRICE[INSERT])

    def _leave(self) -> list[tuple]:
        out = []
        letters = self.stack.decided()
        for edits, (turn, role, text, fault, illegal) in zip(letters, self.held, strict=False):
            out += [self._insert() for _ in edits[:-1]]
            edit, cost = edits[-1], PRICE[edits[-1]]
            if edit == DELETE:
                role = text = None
            else:
                initial = role[:1] if edit == KEEP else _GIVES[self.state]
                self.state, role = _MOVES[self.state][initial], role if edit == KEEP else _NAMES[initial]
                cost += TRUNCATED if fault == "truncated" else 0
            self.place += 1
            out.append((self.key, self.place, turn, edit, role, text, fault, illegal, cost))
        del self.held[: len(letters)]
        return out


def edits(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits of every conversation, a row each, in their order: (key, place, turn, edit, role, text, fault, illegal, cost).

    Rows of a conversation stand by turn (nulls first), then by role and text, so the result does not depend on how they
    arrive.  A null role or text counts as one space; a null key is a conversation of its own.  `fault` is the first that
    holds of blank (no visible character), duplicate (role and text stood earlier) and truncated (the last visible
    character ends no sentence); `illegal` marks a row that may not follow the one before it.  `role` and `text` are those
    of the repaired row, null where it is deleted; an inserted row has no turn and an empty text.  A conversation
    whose cheapest repair has no rows shows only deletions.  Long texts pass as they are, an empty table gives no
    rows, other columns are ignored.
    """
    kind = {c: turns.schema[c].dataType.simpleString() for c in (key, turn)}
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(key).alias("_key"), F.col(turn).alias("_turn"), blank(role).alias("_role"), blank(text).alias("_text"))
    named = F.coalesce(F.concat(F.lit("="), F.col("_key").cast("string")), F.lit("-"))
    rows = rows.withColumn("_said", F.unhex(F.md5(F.concat(named, F.lit(":"), F.length("_role"), F.lit(":"), "_role", "_text"))))
    first = rows.groupBy("_said").agg(F.min(F.struct("_turn")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_said", "_first")
    rows = salted_join(rows, first, ["_said"], "_turn", "left")
    again = F.col("_first").isNotNull() & ~F.col("_turn").eqNullSafe(F.col("_first._turn"))
    rows = rows.select("_key", "_turn", "_role", "_text", again.alias("_again"))
    rows = rows.repartition(F.col("_key")).sortWithinPartitions("_key", F.asc_nulls_first("_turn"), "_role", "_text")
    names = [key, "place", turn, "edit", "role", "text", "fault", "illegal", "cost"]
    types = [kind[key], "long", kind[turn], "string", "string", "string", "string", "boolean", "long"]
    ddl = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, schema = None, [], None

        def batch(part: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema, strict=True)], names)

        for part in slices(batches, "_text"):
            if schema is None:
                s, l = pa.string(), pa.int64()  # noqa: E741
                schema = [part.schema.field(0).type, l, part.schema.field(1).type, s, s, s, s, pa.bool_(), l]
            for k, *row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if current is None or current.key != k:
                    out += current.end() if current else []
                    current = _Conversation(k)
                out += current.add(*row)
                if len(out) >= _BATCH:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)
                out = []
        out += current.end() if current else []
        if out:
            yield batch(out)

    return rows.mapInArrow(run, ddl)


def reports(done: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation of `edits`: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Reads the edits as they come, so it must stand directly on `edits` (no shuffle in between); memory holds the
    letters of one audit.  The digest is of `role:text` of the repaired rows, joined by line ends.  Nulls in the key are
    one conversation; turns that are null count neither as gaps nor as turns.
    """
    kind = done.schema[key].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ddl = ", ".join([f"`{key}` {kind}", *[f"{c} long" for c in counts], "audit string", "repaired_sha256 string"])
    fields = [key, "edit", turn, "role", "text", "fault", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, kind_of_key = False, None, None

        def batch() -> pa.RecordBatch:
            low, high, distinct = now["turns"]
            row = [now["key"], high - low + 1 - distinct if distinct else 0, *[now[c] for c in counts[1:]], "".join(now["audit"]), now["hash"].hexdigest()]
            kinds = [kind_of_key, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [key, *counts, "audit", "repaired_sha256"])

        for part in batches:
            kind_of_key = part.schema.field(0).type
            for k, edit, at, role, text, fault, illegal, cost in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if not open_ or now["key"] != k:
                    if open_:
                        yield batch()
                    open_, now = True, {"key": k, "turns": (0, 0, 0), "audit": [], "hash": hashlib.sha256(), "rows": 0, **dict.fromkeys(counts, 0)}
                now["audit"].append(edit)
                now["cost"] += cost
                now["illegal"] += illegal
                if fault:
                    now[fault] += 1
                low, high, distinct = now["turns"]
                if at is not None and (not distinct or at != high):
                    now["turns"] = (at if not distinct else low, at, distinct + 1)
                if role is not None:
                    now["hash"].update((("\n" if now["rows"] else "") + f"{role}:{text}").encode())
                    now["rows"] += 1
        if open_:
            yield batch()

    return done.select(*fields).mapInArrow(run, ddl)
