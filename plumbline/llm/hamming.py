"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint has a bit per vote of its shingles' hashes, repeats included.  Two fingerprints that differ in at
most three bits differ in at most one bit in one of their two halves (32 bits each).  So there is a table per half,
each fingerprint looks up the ball of radius one around its half (itself and every half with one more bit set;
the other side of a pair looks downward from there), and what the tables give is compared in full.

Equal fingerprints are one node, so copies never meet each other.  Halves that very many fingerprints share
(a family of like texts) are counted first; around those halves the look-up goes one level deeper, to quarters (16 bits)
of the other half, so that what meets agrees on 48 bits.  Every look-up gives a spanning forest of its links,
not all pairs, and components are contracted from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import salted_join, slices
from plumbline.llm.components import components
from plumbline.session import cut_lineage

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints that may share a half before its look-ups go one level deeper.
CROWD = 1_024
#: Rows compared with each other at a time.
_BLOCK = 2_048


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set where more than half of the hashes have it. 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only the six ASCII gaps split
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: max(1, len(words) - SHINGLE + 1)].tolist()
    ends = ends[SHINGLE - 1 :].tolist() if len(words) >= SHINGLE else [len(joined)]
    digest, votes, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, total, 1 << 16):
        held = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], ">u8")
        votes += np.unpackbits(held.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print long) of every row, from its whole text; null and empty texts have 0, equal texts equal prints. Other columns go."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            made = np.array([fingerprint(t) for t in part.column(part.schema.names.index(text)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.view(np.int64))], [key, "print"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, print long")


def as_hex(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def _part(print_: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(print_, at).bitwiseAND(F.lit((1 << bits) - 1))


def _ball(value: Column, bits: int, only_up: bool) -> Column:
    """The value and those with one bit changed; with `only_up`, with one bit more."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    if only_up:
        flips = F.filter(flips, lambda f: value.bitwiseAND(f) == 0)
    return F.concat(F.array(value), F.transform(flips, lambda f: value.bitwiseXOR(f)))


def _forest(prints: np.ndarray, held: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a group's links join: prints (distinct), `held` those that stand in the table; a link has at least one of them."""
    root = np.arange(len(prints))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    table, left, right = np.flatnonzero(held), [], []
    for a in range(0, len(prints), _BLOCK):
        for b in range(0, len(table), _BLOCK):
            mine, theirs = np.arange(a, min(a + _BLOCK, len(prints))), table[b : b + _BLOCK]
            near = np.bitwise_count(prints[mine][:, None] ^ prints[theirs][None, :]) <= radius
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                p, q = find(int(mine[i])), find(int(theirs[j]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    left.append(int(mine[i]))
                    right.append(int(theirs[j]))
    return prints[left].view(np.int64), prints[right].view(np.int64)


def _links(lookups: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(u, v) of a spanning forest per key of rows (keys, print, held)."""
    rows = lookups.select(*keys, "print", "held").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64) for _ in range(len(keys) + 2)]

        def solve(columns: list[np.ndarray], last: bool):
            """Links of all whole groups, and the rows of the group that may go on."""
            n = len(columns[0])
            if not n:
                return [], columns
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[: len(keys)]], axis=0)) + 1
            edges = np.concatenate([[0], new, [n]])
            whole = edges if last else edges[:-1]
            size = np.diff(whole)
            has = np.add.reduceat(columns[-1], whole[:-1]) > 0 if len(size) else np.zeros(0, bool)
            out = []
            for g in np.flatnonzero((size > 1) & has):
                part = slice(whole[g], whole[g + 1])
                prints, held = columns[-2][part].view(np.uint64), columns[-1][part]
                prints, first = np.unique(prints[np.argsort(-held, kind="stable")], return_index=True)
                held = np.sort(-held, kind="stable")[first] < 0
                u, v = _forest(prints, held, radius)
                if len(u):
                    out.append((u, v))
            return out, [c[whole[-1] :] for c in columns]

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v"])

        for part in batches:
            columns = [np.concatenate([r, part.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
            found, rest = solve(columns, False)
            if found:
                yield batch(found)
        found, _ = solve(rest, True)
        if found:
            yield batch(found)

    return rows.mapInArrow(run, "u long, v long").distinct()


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v): links between distinct prints within three bits, as many as their components need."""
    halves = F.explode(F.array(*[F.struct(F.lit(h).alias("half"), _part(F.col("print"), 32 * h, 32).alias("value")) for h in range(2)]))
    placed = nodes.select("print", halves.alias("_h")).select("print", "_h.half", "_h.value")
    # halves that are crowded, and those one bit away
    deep = placed.groupBy("half", "value").count().where(F.col("count") > crowd)
    deep = deep.select("half", F.explode(_ball(F.col("value"), 32, False)).alias("value")).distinct().withColumn("_deep", F.lit(True))
    deep = cut_lineage(deep)
    looked = placed.select("half", F.explode(_ball(F.col("value"), 32, True)).alias("value"), "print", F.col("value").alias("_own"))
    looked = looked.withColumn("held", (F.col("value") == F.col("_own")).cast("int")).drop("_own")
    if deep.isEmpty():
        return _links(looked, ["half", "value"], RADIUS)
    met = salted_join(looked, deep, ["half", "value"], "print", "left")
    flat = _links(met.where("_deep is null"), ["half", "value"], RADIUS)
    quarters = F.explode(F.array(*[
        F.struct(F.lit(q).alias("quarter"), _part(F.shiftrightunsigned("print", 16 * q), 0, 16).alias("_own")) for q in range(4)
    ]))
    rows = met.where("_deep").select("half", "value", "print", F.col("held").alias("_in"), quarters.alias("_q")).select("half", "value", "print", "_in", "_q.*")
    # quarters of the other half: 0 and 1 are those of half 0
    rows = rows.where(F.floor(F.col("quarter") / 2) != F.col("half"))
    rows = rows.select("half", "value", "print", "_in", "quarter", "_own", F.explode(_ball(F.col("_own"), 16, False)).alias("near"))
    rows = rows.withColumn("held", ((F.col("near") == F.col("_own")) & (F.col("_in") == 1)).cast("int"))
    return flat.unionByName(_links(rows, ["half", "value", "quarter", "near"], RADIUS)).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per input row: (key, fingerprint, component_id), the smallest key reachable over links of three bits or fewer.

    Texts without words (null, empty, gaps only) have the fingerprint 0 and are linked like any other.  Rows that repeat a
    text, or a key, are rows of their own; a null key names no component unless all keys of it are null.  Whole
    texts of any length count; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, key, text))
    least = prints.groupBy("print").agg(F.min(key).alias("_least"))
    least = cut_lineage(least)
    roots = components(links(least.select("print"), crowd))
    rooted = least.join(roots, least["print"] == roots["node"], "left").select("print", "_least", F.coalesce("root", "print").alias("_root"))
    named = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = salted_join(rooted, named, ["_root"], "print").select("print", "component_id")
    return salted_join(prints, classes, ["print"], key).select(key, as_hex(F.col("print")).alias("fingerprint"), "component_id")
