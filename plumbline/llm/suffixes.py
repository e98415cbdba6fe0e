"""Exact substring dedup by a hash-compared suffix sort over sampled suffixes.

Of every 200-byte string the start of its smallest 41-byte hash (leftmost) is its anchor, so equal strings have
the same anchor at the same place, and only about one suffix in 80 bytes has to be sorted.  Hashes are
polynomials over prefixes, so any stretch is compared in constant time.

1. Anchors whose 41 bytes stand nowhere else are done: no string of theirs repeats.
2. Anchors that share all bytes of all their strings with another one are done: every string repeats.
3. The rest, with one stand-in for each set of equals, meet by anchor hash.  Suffixes are merge-sorted; two are
   compared by a binary search for their common extension.  Neighbours' common extensions cut the order into
   runs, in which strings repeat where the bytes left of the anchor agree as well.  A match is verified on the
   bytes.  An anchor hash that very many texts share goes string by string through a shuffle instead.

Equals within a slice of a task are settled there and go on as one row, so that a group of copies, or a text
that repeats itself, is as many rows as slices hold it.  Steps 1 and 2 are aggregates and joins by hash.
"""

from __future__ import annotations

import uuid
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SALTS, schema_with, slices
from plumbline.llm.hashing import mix
from plumbline.session import shared_dir

#: Bytes of a repeated string, of an anchor; string starts that may share an anchor.
LENGTH, ANCHOR = 200, 41
REACH = LENGTH - ANCHOR + 1
#: Suffixes of one anchor hash that a task sorts; larger groups take the shuffle of single strings.
GROUP = 2_000
#: Bytes of text in which equals are settled before the shuffle.
SETTLED = 16 << 20
#: String starts that are hashed at a time.
STRETCH = 1 << 20
_LETTER = np.random.default_rng(99).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, STRETCH + 2 * LENGTH), _powers(_INVERSE, STRETCH + 2 * LENGTH)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        values = pick(values[:-m], values[m:])
        m *= 2
    return pick(values[: len(values) - (width - m)], values[width - m :]) if m < width else values


def anchors(raw: bytes) -> tuple[np.ndarray, ...]:
    """(position, hash, least and greatest start relative to it, hash of all bytes of those strings) of a text's anchors."""
    parts = []
    for begin in range(0, max(len(raw) - LENGTH + 1, 0), STRETCH):
        code = np.frombuffer(raw, np.uint8, min(STRETCH + LENGTH - 1, len(raw) - begin), begin)
        n = len(code)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[code] * _UP[:n])])
        own = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * _DOWN[: n - ANCHOR + 1])
        least = _slide(own, REACH, np.minimum)
        pad = np.zeros(REACH - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), REACH, np.maximum) == own)
        key = own[at]
        # strings with the same least hash are a run of starts; runs follow each other as their anchors do
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        low, high = np.maximum(first[run], at - REACH + 1), np.minimum(last[run], at)
        good = low <= high
        at, key, low, high = at[good], key[good], low[good], high[good]
        whole = mix((prefix[high + LENGTH] - prefix[low]) * _DOWN[low])
        whole = mix(whole + (at - low).astype(np.uint64) * np.uint64(256) + (high - low).astype(np.uint64))
        parts.append((at + begin, key, low - at, high - at, whole))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchor_rows(docs: DataFrame, kind: str) -> DataFrame:
    """A row per anchor; `weight` is 1 for one without equals in its slice, 2 for the first of equals, 0 for the others."""

    def run(batches):
        for part in slices(batches, "text", SETTLED):
            found, take = [], []
            for i, value in enumerate(part.column(2).to_pylist()):
                rows = anchors((value or "").encode())
                found.append(rows)
                take.append(np.full(len(rows[0]), i))
            at, key, low, high, whole = (np.concatenate(x) for x in zip(*found, strict=True))
            take = np.concatenate(take)
            order = np.lexsort((whole, key))
            same = (key[order][1:] == key[order][:-1]) & (whole[order][1:] == whole[order][:-1])
            weight = np.ones(len(key), np.int32)
            weight[order[1:][same]] = 0
            lead = np.concatenate([same, [False]]) & ~np.concatenate([[False], same]) if len(key) else np.zeros(0, bool)
            weight[order[lead]] = 2
            take = pa.array(take)
            yield pa.RecordBatch.from_arrays(
                [_longs(key), _longs(whole), part.column(0).take(take), part.column(1).take(take), *[pa.array(x.astype(np.int32)) for x in (at, low, high, weight)]],
                ["anchor", "whole", "row_key", "tie", "at", "low", "high", "weight"],
            )

    rows = docs.select("row_key", "tie", "text").where("text is not null")
    return rows.mapInArrow(run, f"anchor long, whole long, row_key {kind}, tie long, at int, low int, high int, weight int")


def _sorted_group(right: np.ndarray) -> list[int]:
    """Order of the suffixes of a group: a merge sort whose comparisons find the common extension by binary search."""
    if len(right) < 3:
        return list(range(len(right)))
    hashes = right.tolist()

    def compare(i: int, j: int) -> int:
        x, y = hashes[i], hashes[j]
        low, high = 0, LENGTH
        while low < high:
            middle = (low + high + 1) // 2
            if x[middle] == y[middle]:
                low = middle
            else:
                high = middle - 1
        # any fixed order of the first differing extension will do: suffixes with a common extension stand together
        return 0 if low == LENGTH else -1 if x[low + 1] < y[low + 1] else 1

    return sorted(range(len(hashes)), key=cmp_to_key(compare))


def repeated_starts(group: np.ndarray, contexts: list[bytes], lows: np.ndarray, highs: np.ndarray) -> list[tuple[int, int, int]]:
    """(suffix, first, last start relative to the anchor) of strings that stand in two suffixes of one group.

    Rows of a group follow each other; `contexts` are the bytes from `lows` before the anchor on.
    """
    n, most = len(contexts), REACH - 1
    code = np.zeros((n, most + LENGTH), np.uint8)
    for i, c in enumerate(contexts):
        code[i, most + lows[i] : most + lows[i] + len(c)] = np.frombuffer(c, np.uint8)
    right = np.zeros((n, LENGTH + 1), np.uint64)
    np.cumsum(_LETTER[code[:, most:]] * _UP[:LENGTH], axis=1, out=right[:, 1:])
    left = np.zeros((n, REACH), np.uint64)
    np.cumsum(_LETTER[code[:, most - 1 :: -1]] * _UP[:most], axis=1, out=left[:, 1:])
    edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
    order = np.concatenate([a + np.array(_sorted_group(right[a:b]), np.int64) for a, b in zip(edge[:-1], edge[1:], strict=True)])
    # common extension of neighbours in the order, by binary search; none between groups
    above, below = order[:-1], order[1:]
    common, high = np.zeros(n - 1, np.int64), np.full(n - 1, LENGTH)
    while (common < high).any():
        middle = (common + high + 1) // 2
        same = right[above, middle] == right[below, middle]
        common, high = np.where(same, middle, common), np.where(same, high, middle - 1)
    common[group[above] != group[below]] = -1
    low, top = lows[order], highs[order]
    partner = np.full((n, REACH + 1), -1, np.int32)
    for start in range(int(lows.min()), int(highs.max()) + 1):
        has = np.flatnonzero((low <= start) & (top >= start))
        if len(has) < 2:
            continue
        run = np.concatenate([[0], np.cumsum(common < LENGTH + start)])[has]
        rows = order[has]
        side = left[rows, -start]
        place = np.lexsort((side, run))
        same = (run[place][1:] == run[place][:-1]) & (side[place][1:] == side[place][:-1])
        rows = rows[place]
        partner[rows[1:][same], most + start] = rows[:-1][same]
        first = same & ~np.concatenate([[False], same[:-1]])
        partner[rows[:-1][first], most + start] = rows[1:][first]
    # neighbouring starts with one partner are verified together on the bytes
    change = np.ones((n, REACH + 1), bool)
    change[:, 1:] = partner[:, 1:] != partner[:, :-1]
    row, begin = np.nonzero(change & (partner >= 0))
    end = np.empty(len(row), np.int64)
    flat = np.flatnonzero(change.ravel())
    at = np.searchsorted(flat, row * (REACH + 1) + begin, "right")
    end[:] = flat[at] - row * (REACH + 1) - 1
    other = partner[row, begin]
    return [
        (i, a - most, b - most) for i, j, a, b in zip(row.tolist(), other.tolist(), begin.tolist(), end.tolist(), strict=True)
        if np.array_equal(code[i, a : b + LENGTH], code[j, a : b + LENGTH])
    ]


def _contexts(docs: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """The bytes around every wanted anchor."""
    lists = wanted.groupBy("row_key", "tie").agg(F.collect_set(F.struct("anchor", "at", "low", "high", "big")).alias("_wanted"))
    lists = lists.select(F.col("row_key").alias("_k"), F.col("tie").alias("_t"), "_wanted")
    joined = docs.join(lists, docs["row_key"].eqNullSafe(lists["_k"]) & (docs["tie"] == lists["_t"])).select("row_key", "tie", "text", "_wanted")

    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            take, columns = [], ([], [], [], [], [], [])
            for i, (value, own) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                raw = value.encode()
                for w in own:
                    take.append(i)
                    for column, v in zip(columns, (w["anchor"], w["at"], w["low"], w["high"], w["big"], raw[w["at"] + w["low"] : w["at"] + w["high"] + LENGTH]), strict=True):
                        column.append(v)
            at = pa.array(take, pa.int32())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["row_key", "tie", "anchor", "at", "low", "high", "big", "context"],
            )

    return joined.mapInArrow(run, f"row_key {kind}, tie long, anchor long, at int, low int, high int, big boolean, context binary")


def _portions(edges: list[int]) -> list[tuple[int, int]]:
    """Whole groups put together to about `GROUP` rows or a little more."""
    out, first = [], 0
    for end in edges[1:]:
        if end - first >= GROUP:
            out.append((first, end))
            first = end
    return [*out, (first, edges[-1])] if edges and edges[-1] > first else out


def _sorted_spans(contexts: DataFrame, kind: str) -> DataFrame:
    """Spans found by the suffix sort of each anchor hash; rows come grouped by anchor."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table):
            anchor = rows.column("anchor").to_numpy()
            alone = np.concatenate([[True], anchor[1:] != anchor[:-1]]) & np.concatenate([anchor[1:] != anchor[:-1], [True]])
            rows = rows.filter(pa.array(~alone))
            edge = np.flatnonzero(np.concatenate([[True], np.diff(rows.column("anchor").to_numpy()) != 0])) if rows.num_rows else np.zeros(0, int)
            for first, last in _portions([*edge.tolist(), rows.num_rows]):
                own = rows.slice(first, last - first).combine_chunks()
                low, high, at = (own.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "at"))
                found = repeated_starts(own.column("anchor").to_numpy(), own.column("context").to_pylist(), low, high)
                take, a, b = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                keys = [pa.concat_arrays(own.column(c).chunks).take(pa.array(take)) for c in ("row_key", "tie")]
                spans = [pa.array((at[take] + x).astype(np.int32)) for x in (a, b + LENGTH)]
                yield pa.RecordBatch.from_arrays([*keys, *spans], ["row_key", "tie", "start", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(batch.schema.get_field_index("anchor")).to_numpy()
            last = int((anchor == anchor[-1]).sum())
            if held and held[-1].column(held[-1].schema.get_field_index("anchor"))[-1].as_py() != int(anchor[0]):
                yield from solve(pa.Table.from_batches(held))
                held = []
            cut = batch.num_rows - last
            if cut:
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from solve(pa.Table.from_batches(held))

    ordered = contexts.repartition("anchor").sortWithinPartitions("anchor", "row_key", "tie", "at")
    return ordered.mapInArrow(run, f"row_key {kind}, tie long, start int, end int")


def _shuffled_spans(contexts: DataFrame) -> DataFrame:
    """Spans of anchors that very many texts share: their strings meet one by one."""
    start = F.explode(F.sequence("low", "high")).alias("start")
    strings = contexts.select("anchor", "row_key", "tie", "at", "low", "context", start)
    piece = F.substring(F.col("context"), F.col("start") - F.col("low") + 1, F.lit(LENGTH))
    strings = strings.select("row_key", "tie", (F.col("at") + F.col("start")).alias("start"), F.md5(piece).alias("piece"))
    place = F.struct("row_key", "tie", "start")  # anchors of equal hashes may both lead to one string of a text
    many = strings.groupBy("piece").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last")).select("piece")
    salted = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = strings.withColumn("_salt", F.pmod(F.xxhash64("tie", "start"), F.lit(SALTS)).cast("int")).join(salted, ["piece", "_salt"])
    return met.select("row_key", "tie", F.col("start").cast("int"), (F.col("start") + LENGTH).cast("int").alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row_key, tie, start, end) for a frame (row_key, tie, text): byte spans that cover every byte of a repeated string."""
    kind = docs.schema["row_key"].dataType.simpleString()
    folder = f"{shared_dir(docs.sparkSession)}/anchors-{uuid.uuid4().hex}"
    _anchor_rows(docs, kind).write.parquet(f"{folder}/all")
    found = docs.sparkSession.read.parquet(f"{folder}/all")
    shared = found.where("weight > 0")
    counted = shared.groupBy("anchor", "whole").agg(F.sum("weight").alias("n"))
    total = counted.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    counted = counted.join(total, "anchor").select("anchor", "whole", "n", "kinds")
    shared.join(counted, ["anchor", "whole"]).drop("weight").write.parquet(f"{folder}/shared")
    shared = docs.sparkSession.read.parquet(f"{folder}/shared")
    span = [(F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high") + LENGTH).alias("end")]
    done = shared.where("n > 1").select("row_key", "tie", *span).unionByName(found.where("weight = 0").select("row_key", "tie", *span))
    rest = shared.where("kinds > 1")
    # one stand-in for each set of equals
    place = F.struct("row_key", "tie", "at", "low", "high", "kinds")
    rest = rest.groupBy("anchor", "whole").agg(F.min(place).alias("p")).select("anchor", "p.*").withColumn("big", F.col("kinds") > GROUP)
    near = _sorted_spans(_contexts(docs, rest.where("not big"), kind), kind)
    far = _shuffled_spans(_contexts(docs, rest.where("big"), kind))
    # what a stand-in finds holds for its equals, which are done already
    return done.unionByName(near).unionByName(far)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans and `kept` (binary): its UTF-8 bytes without any repeated string.

    A byte goes if a 200-byte string that covers it also starts anywhere else, in this text or another; all
    occurrences go, judged on the input.  Null and empty texts have no bytes.  A repeated row is another place, so
    both go.  Texts under 200 bytes stay whole.  Columns that bear the name of an added one, or are called row_key
    or tie, are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", *[c for c in ("row_key", "tie") if c != key])
    rows = docs.withColumnsRenamed({key: "row_key", text: "text"}).withColumn("tie", F.xxhash64("text"))
    spans = repeated_spans(rows)
    per_row = spans.groupBy("row_key", "tie").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    per_row = per_row.select(F.col("row_key").alias("_k"), F.col("tie").alias("_t"), "_spans")
    joined = rows.join(per_row, rows["row_key"].eqNullSafe(per_row["_k"]) & (rows["tie"] == per_row["_t"]), "left")
    joined = joined.drop("_k", "_t", "tie").withColumnsRenamed({"row_key": key, "text": text})

    def run(batches):
        for part in slices(batches, text):
            names = part.schema.names
            at = names.index("_spans")
            kept, size, gone, many = [], [], [], []
            for value, found in zip(part.column(names.index(text)).to_pylist(), part.column(at).to_pylist(), strict=True):
                raw = (value or "").encode()
                pieces, last, runs = [], 0, 0
                for s in sorted((f["start"], f["end"]) for f in found or ()):
                    if s[0] > last or not runs:
                        pieces.append(raw[last : s[0]])
                        runs += 1
                    last = max(last, s[1])
                left = b"".join([*pieces, raw[last:]])
                kept.append(left)
                size.append(len(raw))
                gone.append(len(raw) - len(left))
                many.append(runs)
            columns = [part.column(i) for i in range(len(names)) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(x, pa.int64()) for x in (size, gone, many)], pa.array(kept, pa.binary())],
                [*[n for n in names if n != "_spans"], "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(run, schema_with(joined, ("_spans",), "n_bytes long, n_removed long, n_spans long, kept binary"))
