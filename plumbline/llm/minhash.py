"""MinHash near-duplicate groups by an LSH forest.

Texts with equal shingle sets form one class, found by a digest of the set.  Each class has a one-permutation
MinHash signature.  The forest holds several sorted orders of the signatures; in each order a class is paired
with its neighbours of the longest common prefix: the depth at which a region is read grows until the region
holds few classes, and a region that stays crowded at full depth is read as a chain.  Orders are
range-partitioned with the class as last key, so no region is one task; rows at the edges of partitions meet
in a second pass.  Candidates are confirmed on full shingle sets, first the best one of every class, then
those that still lie in different groups.  Classes with a crowded region in any order also meet
each other in an exact prefix join.  Groups are connected components over confirmed links and classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import hashing
from plumbline.llm.common import salted_join, slices
from plumbline.llm.components import components, contract, labels
from plumbline.session import cut_lineage, stored

BINS = 128
#: Sorted orders, signature values per order (two per long), classes a region may hold to be read in full.
ORDERS, DEPTH, REGION = 12, 8, 9
#: Bytes of a signature kept for estimates; a pair of larger sets whose estimate is far below the threshold is not confirmed.
SKETCH, SURE_SIZE, MARGIN = 64, 256, 0.28
#: Crowded sets that share an early shingle of at most this many of them meet at it, whatever the forest read; the sets of other
#: early shingles meet in blocks of about this many.  Buckets of shingles whose sums order the shingles of a set.
LIGHT, BLOCK, BUCKETS = 16, 2048, 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _signatures(text: np.ndarray, held: np.ndarray, texts: int) -> np.ndarray:
    """Signatures of (text, distinct hash) rows in order of both; empty bins borrow from a bin named by a fixed sequence."""
    out = np.full(texts * BINS, _EMPTY)
    slot = text * BINS + (held >> np.uint64(57)).astype(np.int64)
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
    out[slot[first]] = held[first]
    out = out.reshape(texts, BINS)
    rows = np.flatnonzero(np.bincount(text, minlength=texts) > 0)
    filled = out[rows]
    empty_row, empty_bin = np.nonzero(filled == _EMPTY)
    known = filled.copy()
    step = 0
    while len(empty_row):
        step += 1
        donor = (hashing.mix(empty_bin.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(step)) % np.uint64(BINS)).astype(np.int64)
        found = known[empty_row, donor]
        ok = found != _EMPTY
        filled[empty_row[ok], empty_bin[ok]] = found[ok]
        empty_row, empty_bin = empty_row[~ok], empty_bin[~ok]
    out[rows] = filled
    return hashing.mix(out)


def _sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode().lower() for t in texts]
    owner, _, _, value, _ = hashing.words(raw)
    return hashing.gram_sets(owner, value, len(raw), n)


def shingle_classes(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, tie, n_shingles, class binary, signature binary) of every row; class and signature are null for an empty set."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, text):
            names = part.schema.names
            owner, held = _sets(part.column(names.index(text)).to_pylist(), shingle)
            count = np.bincount(owner, minlength=part.num_rows)
            edge = np.concatenate([[0], np.cumsum(count)])
            signature = _signatures(owner, held, part.num_rows).astype(np.uint32)
            digest = [_digest(held[a:b]) if b > a else None for a, b in zip(edge, edge[1:], strict=False)]
            signed = [signature[i].tobytes() if count[i] else None for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(signed, pa.binary())],
                [key, "tie", "n_shingles", "class", "signature"],
            )

    rows = docs.select(key, text, F.xxhash64(text).alias("tie"))
    return rows.mapInArrow(run, f"`{key}` {kind}, tie long, n_shingles long, class binary, signature binary")


def _orders(classes: DataFrame) -> DataFrame:
    """A row per class and order: the signature values of that order as four sortable longs, and a sketch."""
    picks = [np.random.default_rng(1000 + t).permutation(BINS)[:DEPTH] for t in range(ORDERS)]

    def run(batches):
        for part in batches:
            if not part.num_rows:
                continue
            signature = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, BINS)
            sketch = pa.array([s.tobytes() for s in signature[:, :SKETCH].astype(np.uint8)], pa.binary())
            for t, pick in enumerate(picks):
                values = signature[:, pick].astype(np.uint64)
                pairs = ((values[:, ::2] << np.uint64(32)) | values[:, 1::2]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, t, np.int32)), *[pa.array(pairs[:, i].copy()) for i in range(DEPTH // 2)], part.column(0), part.column(1), sketch],
                    ["tree", *[f"k{i}" for i in range(DEPTH // 2)], "class", "n", "sketch"],
                )

    keys = ", ".join(f"k{i} long" for i in range(DEPTH // 2))
    return classes.select("class", "n_shingles", "signature").mapInArrow(run, f"tree int, {keys}, class binary, n long, sketch binary")


def _runs(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Regions of sorted rows, numbered at each depth, and the shallowest depth at which a row's region can be read in full (else -1)."""
    n = len(rows)
    key = rows[["tree", *[f"k{i}" for i in range(DEPTH // 2)]]].to_numpy()
    same, chosen, runs = np.ones(max(n - 1, 0), bool), np.full(n, -1), []
    same &= key[1:, 0] == key[:-1, 0]
    for depth in range(DEPTH // 2):
        same = same & (key[1:, depth + 1] == key[:-1, depth + 1])
        run = np.concatenate([[0], np.cumsum(~same)]) if n else np.zeros(0, int)
        runs.append(run)
        size = np.bincount(run)[run] if n else run
        chosen[(chosen < 0) & (size <= REGION)] = depth
    return runs, chosen


def _crowded(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one partition whose shallowest region is not read in full here, for it is crowded or may go on in another partition."""
    runs, chosen = _runs(rows)
    edge = np.isin(runs[0], [runs[0][0], runs[0][-1]])
    return pd.DataFrame({"a": rows["class"].to_numpy()[(chosen != 0) | edge]})


def _neighbours(rows: pd.DataFrame, low: float) -> pd.DataFrame:
    """Candidate pairs among sorted rows of any orders."""
    n = len(rows)
    runs, chosen = _runs(rows)
    left, right = [], []
    for k in range(1, REGION):
        if k >= n:
            break
        met = np.zeros(n - k, bool)
        for depth, run in enumerate(runs):
            met |= (chosen[:-k] == depth) & (run[k:] == run[:-k])
        if k == 1:
            met |= runs[0][1:] == runs[0][:-1]
        at = np.flatnonzero(met)
        left.append(at)
        right.append(at + k)
    left, right = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    size = rows["n"].to_numpy()
    small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    keep = small >= low * large
    left, right, small = left[keep], right[keep], small[keep]
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(n, SKETCH) if n else np.zeros((0, SKETCH), np.uint8)
    like = np.concatenate([(sketch[left[i : i + 65536]] == sketch[right[i : i + 65536]]).mean(axis=1) for i in range(0, max(len(left), 1), 65536)])
    keep = (small < SURE_SIZE) | (like >= low - MARGIN)
    name = rows["class"].to_numpy()
    a, b = name[left[keep]], name[right[keep]]
    out = pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "like": like[keep].astype(np.float32)})
    return out.drop_duplicates(["a", "b"])


_PAIR = "a binary, b binary, like float"
_ROW = "tree int, " + ", ".join(f"k{i} long" for i in range(DEPTH // 2)) + ", class binary, n long, sketch binary"


def candidates(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, like) of classes that are neighbours in one of the sorted orders; and the classes (class) whose
    shallowest region is not read in full in some order."""
    keys = ["tree", *[f"k{i}" for i in range(DEPTH // 2)], "class"]

    def read(frames):
        held = [f for f in frames if len(f)]
        if held:
            rows = pd.concat(held, ignore_index=True).sort_values(keys, kind="stable", ignore_index=True)
            yield _neighbours(rows, threshold)
            yield _crowded(rows)
            # the first and last rows of a partition meet those of its neighbours
            place = TaskContext.get().partitionId()
            yield pd.concat([rows.iloc[:REGION].assign(part=place - 1), rows.iloc[-REGION:].assign(part=place)])

    def filled(frames):
        names = ["a", "b", "like", *keys, "n", "sketch", "part"]
        for frame in read(frames):
            out = frame.reindex(columns=names)
            yield out.astype({c: "Int64" for c in names[3:] if c not in ("class", "sketch")}).astype({c: object for c in ("a", "b", "class", "sketch")}).where(out.notna(), None)

    found = _orders(classes).repartitionByRange(*keys).mapInPandas(filled, f"{_PAIR}, {_ROW}, part int")
    found = cut_lineage(found)
    border = found.where("part is not null").drop("a", "b", "like").groupBy("part").applyInPandas(
        lambda rows: _neighbours(rows.sort_values(keys, kind="stable", ignore_index=True), threshold), _PAIR
    )
    pairs = found.where("part is null and b is not null").select("a", "b", "like").unionByName(border)
    missed = found.where("part is null and b is null").select(F.col("a").alias("class")).distinct()
    return pairs.groupBy("a", "b").agg(F.max("like").alias("like")), missed


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets."""
    a = sets.select(F.col("class").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("class").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")

    def run(batches):
        for part in batches:
            names, keep = part.schema.names, []
            ha, hb = part.column(names.index("ha")), part.column(names.index("hb"))
            for i in range(part.num_rows):
                x, y = np.frombuffer(ha[i].as_buffer(), np.uint64), np.frombuffer(hb[i].as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(names.index(c)).filter(mask) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(12)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _buckets(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of BUCKETS buckets; only the order in a set and shingles of one set hang on it."""

    def run(batches):
        held = np.zeros(BUCKETS, np.int64)
        for part in batches:
            if part.num_rows:
                held += np.bincount(_bucket(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64)), minlength=BUCKETS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["bucket", "held"])

    found = sets.select("hashes").mapInArrow(run, "bucket int, held long").groupBy("bucket").agg(F.sum("held").alias("held")).toArrow()
    out = np.zeros(BUCKETS, np.uint32)
    out[found.column("bucket").to_numpy()] = np.minimum(found.column("held").to_numpy(), 0xFFFFFFFF)
    return out


def _need(both, percent: int):
    """Shingles that two sets with `both` in all must share."""
    return -(-both * percent // (100 + percent))


def _prefixes(own: DataFrame, held: np.ndarray, percent: int) -> DataFrame:
    """(token, id, rid, n, at): the early shingles of every set (id, rid, hashes), those in light buckets first."""
    order = own.sparkSession.sparkContext.broadcast(held)
    schema = "token long, id long, rid long, n int, at int"

    def run(batches):
        for part in batches:
            out = [[] for _ in range(5)]
            for i, raw in enumerate(part.column(2)):
                tokens = np.frombuffer(raw.as_buffer(), np.uint64)
                n, count = len(tokens), order.value[_bucket(tokens)]
                early = n - _need(n + n * percent // 100, percent) + 1
                at = np.lexsort((tokens, count))[:early]
                # a shingle alone in its bucket meets nothing
                first = int(np.searchsorted(count[at], 2))
                for column, value in zip(out, (tokens[at[first:]].view(np.int64), part.column(0)[i].as_py(), part.column(1)[i].as_py(), n, np.arange(first, len(at))), strict=True):
                    column.append(np.broadcast_to(value, len(at) - first))
            if part.num_rows:
                kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(out, kinds, strict=True)], ["token", "id", "rid", "n", "at"])

    return own.select("id", "rid", "hashes").mapInArrow(run, schema)


def _parity(tokens: np.ndarray) -> bytes:
    """A bit per slot, set where an odd number of shingles fall: two sets differ in at least as many shingles as bits."""
    width = max(256, 1 << int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _by_width(places: np.ndarray, sets: list[np.ndarray]) -> dict[int, tuple]:
    """Places, sizes and bits of the sets at `places`, in order of size, by the width of their bits."""
    bits = [_parity(sets[i]) for i in places]
    n, width, out = np.array([len(sets[i]) for i in places]), np.array([len(x) for x in bits]), {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        at = at[np.argsort(n[at], kind="stable")]
        out[int(w)] = places[at], n[at], np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)
    return out


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return np.ascontiguousarray(bits.T)


def _block_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) of ids in two blocks (or one) that join whatever is similar there; sets of one rid count as joined.

    The bits rule out most pairs, the others are told by their sets, unless links given before join them.
    """
    x, y = rows.column("x")[0], rows.column("y")[0]
    block, ids = rows.column("block").to_numpy(), rows.column("id").to_numpy()
    sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in rows.column("hashes")]
    group = rows.column("rid").to_numpy().copy()
    left = _by_width(np.flatnonzero(block == x.as_py()), sets)
    right = left if x == y else _by_width(np.flatnonzero(block == y.as_py()), sets)
    found = []
    for wide, (mine, n, bits) in left.items():
        for other, (theirs, n2, bits2) in right.items():
            words = min(wide, other) // 8
            a, b = _folded(bits, words), _folded(bits2, words)
            for i in range(0, len(mine), 128):
                j = min(i + 128, len(mine))
                low = np.searchsorted(n2, -(-n[i] * percent // 100))
                high = np.searchsorted(n2, n[j - 1] * 100 // percent, "right")
                if low >= high:
                    continue
                apart = np.zeros((j - i, high - low), np.int32)
                for w in range(words):
                    apart += np.bitwise_count(a[w, i:j, None] ^ b[w, None, low:high])
                both = n[i:j, None] + n2[None, low:high]
                may = apart <= both - 2 * _need(both, percent)
                for row in np.flatnonzero(may.any(axis=1)):
                    one = mine[i + row]
                    at = np.flatnonzero(may[row])
                    at = theirs[low + at[np.argsort(apart[row, at], kind="stable")]]
                    while len(at := at[group[at] != group[one]]):
                        common = len(np.intersect1d(sets[one], sets[at[0]], assume_unique=True))
                        if 100 * common >= percent * (len(sets[one]) + len(sets[at[0]]) - common):
                            found.append((ids[one], ids[at[0]]))
                            group[group == group[at[0]]] = group[one]
                        at = at[1:]
    return pa.table({"a": pa.array([u for u, _ in found], pa.int64()), "b": pa.array([v for _, v in found], pa.int64())})


def _family_links(sets: DataFrame, ids: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ids that join all similar sets of a family whose rids differ.

    Sets (id, class, rid) are one family where frequent early shingles link them (edges u, v).  A family is dealt to blocks of about
    BLOCK sets, and every two blocks meet in a task of their own; sets of its largest group (rid) do not meet each other.
    """
    c = F.col
    members = components(edges).select(c("node").alias("id"), c("root").alias("family")).join(ids, "id")
    per = members.groupBy("family", "rid").agg(F.count("*").alias("k"))
    whole = per.groupBy("family").agg(F.sum("k").alias("k"), F.max(F.struct("k", "rid")).alias("main"))
    blocks = lambda k: F.ceil(k / BLOCK)
    whole = whole.select("family", c("main.rid").alias("main"), blocks(c("k") - c("main.k")).alias("rest"), blocks(c("main.k")).alias("most"))
    main, deal = c("rid") == c("main"), F.xxhash64("id")
    placed = salted_join(members, whole, ["family"], "id").select(
        "class", "family", "id", "rid",
        F.when(main, c("rest") + F.pmod(deal, "most")).otherwise(F.pmod(deal, "rest")).alias("block"),
        F.sequence(F.lit(0).cast("long"), F.when(main, c("rest")).otherwise(c("rest") + c("most")) - 1).alias("others"),
    )
    rows = sets.select("class", "hashes").join(placed, "class").select("*", F.explode("others").alias("other"))
    rows = rows.select("family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "rid", "hashes")
    return rows.groupBy("family", "x", "y").applyInArrow(lambda t: _block_links(t, percent), "a long, b long")


def prefix_pairs(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of sets (class, hashes) with different roots (class, root) that join every two sets of the similarity asked for.

    The shingles of a set are put in one order for all sets, those of light buckets first.  Two sets of sizes m <= n with the
    similarity asked for share at least percent * (m + n) / (100 + percent) shingles, so the first shared one lies
    so early in both that as many can follow.  Early shingles of at most LIGHT sets give their pairs.  Sets that share
    an early shingle of more sets are one family, and its sets meet block by block, each two once, for links that join what is
    similar (`_block_links`); so no shingle is left out, no key is hot, and links stay as few as sets in a block.  Shingles whose sets all have one root meet nothing.
    """
    c = F.col
    ids = cut_lineage(roots.select("class", "root").withColumn("id", F.monotonically_increasing_id()))
    ids = salted_join(ids, ids.groupBy("root").agg(F.min("id").alias("rid")), ["root"], "class")
    ids = cut_lineage(ids.select("class", "id", "rid"))
    early = stored(_prefixes(sets.join(ids, "class"), _buckets(sets), percent))
    held = early.groupBy("token").agg(F.count("*").alias("df"), F.min("rid").alias("low"), F.max("rid").alias("high"), F.min("id").alias("least"))
    early = stored(early.join(held.where("low < high").drop("low", "high"), "token"))
    a, b = (early.where(c("df") <= LIGHT).select("token", *[c(x).alias(f"{x}_{s}") for x in ("id", "rid", "n", "at")]) for s in "ab")
    ordered_pair = (c("n_a") < c("n_b")) | ((c("n_a") == c("n_b")) & (c("id_a") < c("id_b")))
    follow = F.least(c("n_a") - c("at_a"), c("n_b") - c("at_b"))
    need = F.ceil((c("n_a") + c("n_b")) * percent / (100 + percent))
    met = a.join(b, "token").where(ordered_pair & (c("rid_a") != c("rid_b")) & (100 * c("n_a") >= percent * c("n_b")) & (follow >= need))
    met = met.select(c("id_a").alias("a"), c("id_b").alias("b"))
    edges = early.where((c("df") > LIGHT) & (c("id") != c("least"))).select(c("id").alias("u"), c("least").alias("v"))
    if not edges.isEmpty():
        met = met.unionByName(_family_links(sets, ids, edges, percent))
    names = lambda s: ids.select(c("id").alias(s), c("class").alias(f"class_{s}"))
    named = met.distinct().join(names("a"), "a").join(names("b"), "b")
    return named.select(c("class_a").alias("a"), c("class_b").alias("b"))


def _digest(held: np.ndarray) -> bytes:
    return hashlib.blake2b(held.tobytes(), digest_size=16).digest()


def _full_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(class, hashes) of every text; hashes are the sorted 64-bit shingles."""

    def run(batches):
        for part in slices(batches, text):
            owner, held = _sets(part.column(part.schema.get_field_index(text)).to_pylist(), shingle)
            edge = np.searchsorted(owner, np.arange(part.num_rows + 1))
            own = [held[x:y] for x, y in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["class", "hashes"]
            )

    return docs.select(text).mapInArrow(run, "class binary, hashes binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: key, tie (hash of its text), n_shingles, group, component_id (its smallest key) and kept.

    Words are lower-cased (A-Z) runs of non-space; a text with fewer words than a shingle is one shingle; a
    null text or one without words has an empty set, no group, and is alone.  Repeated rows and equal sets are one class
    and share its group.  `kept` marks the rows whose key is the smallest of the group.  Rows with a null key
    take part; where all keys of a group are null, its id is null and its rows are kept.  Other columns are
    ignored.
    """
    rows = cut_lineage(shingle_classes(docs, key, text, shingle))
    classes = rows.where("class is not null").groupBy("class").agg(
        F.min(key).alias("_least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    classes = cut_lineage(classes)
    pairs, crowded = candidates(classes, percent / 100)
    pairs, crowded = cut_lineage(pairs), cut_lineage(crowded)
    ids = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).unionByName(crowded).distinct()
    # one text stands for each class that has a candidate or lies in a crowd; texts without a key are all looked at
    named = ids.join(classes, "class").where("_least is not null").select(F.col("_least").alias(key))
    texts = docs.select(key, text).join(named, key, "left_semi").unionByName(docs.select(key, text).where(F.col(key).isNull()))
    sets = _full_sets(texts, text, shingle).join(ids, "class", "left_semi").groupBy("class").agg(F.first("hashes").alias("hashes"))
    sets = cut_lineage(sets)
    # first the likeliest partner of every class
    best = pairs.groupBy("b").agg(F.max(F.struct("like", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    first = cut_lineage(_confirmed(best, sets, percent))
    joined = contract(first.select(F.col("a").alias("u"), F.col("b").alias("v")), rounds=2)
    groups = labels(joined)
    # then the candidates whose ends are not known to be linked
    left = groups.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = groups.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    apart = pairs.join(best, ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left")
    apart = apart.where(F.coalesce(F.col("ra"), F.col("a")) != F.coalesce(F.col("rb"), F.col("b")))
    # two crowded classes need no candidate of the forest: the prefix join is exact
    packed = lambda s: crowded.select(F.col("class").alias(s), F.lit(True).alias(f"packed_{s}"))
    apart = apart.join(packed("a"), "a", "left").join(packed("b"), "b", "left").where("packed_a is null or packed_b is null")
    # crowded classes: what the forest did not read meets on early shingles
    roots = crowded.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rare = prefix_pairs(sets, roots, percent)
    second = cut_lineage(_confirmed(apart.select("a", "b").unionByName(rare).distinct(), sets, percent))
    linked = components(joined.unionByName(second.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    grouped = classes.select("class", "_least").join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = grouped.groupBy("root").agg(F.min("_least").alias("component_id"))
    grouped = salted_join(grouped, least, ["root"], "class").select("class", F.col("root").alias("group"), "component_id")
    named = salted_join(rows.select(key, "tie", "n_shingles", "class"), grouped, ["class"], key, "left")
    component = F.when(F.col("class").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return named.select(key, "tie", "n_shingles", "group", component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))
