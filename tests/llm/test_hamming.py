"""SimHash groups against all pairs of fingerprints."""

import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import components, hamming, queries  # noqa: F401
from plumbline.llm.catalog import QUERIES

ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_print(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(ASCII)).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    held = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in held) > len(held))


def roots(prints):
    """Smallest print reachable from each."""
    prints = sorted(prints)
    own = np.array(prints, np.uint64)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(own[i] ^ own[:i]) <= 3):
            p, q = find(i), find(int(j))
            parent[max(p, q)] = min(p, q)
    return {p: prints[find(i)] for i, p in enumerate(prints)}


def wanted(rows):
    held = [(i, plain_print(t)) for i, t in rows]
    root, least = roots({p for _, p in held}), {}
    for i, p in held:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in held), key=str)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query(spark, size):
    d = f"/root/testdata/sf{size}"
    got = QUERIES["op11_hamming"](spark, d).collect()
    assert sorted(map(tuple, got), key=str) == wanted(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())


def family(n, seed=1, spread=10):
    """Prints around few centres, many of them sharing a half."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    out = set()
    while len(out) < n:
        p = rnd.choice(centres)
        for _ in range(rnd.randrange(spread)):
            p ^= 1 << rnd.choice([rnd.randrange(32), rnd.randrange(64)])
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize("crowd", [0, 3, 40, 10_000])
def test_crowded_halves_lose_no_link(spark, crowd):
    prints = family(1_500)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    made = components.components(hamming.links(nodes, crowd)).collect()
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in made}
    want = roots(prints)
    groups = lambda m: sorted(sorted(g) for g in {r: [p for p in m if m[p] == r] for r in m.values()}.values() if len(g) > 1)
    assert groups(got) == groups(want) and any(len(g) > 100 for g in groups(want))


def test_edges(spark):
    prose = " ".join(f"Word{i * 7919 % 1009}" for i in range(400))
    rows = [
        (1, prose), (2, prose.upper()), (3, prose + " Tail"), (4, ""), (5, None), (6, " \t\n"), (None, prose), (None, None), (7, "one TWO"), (8, "One two"),
        (8, "One two"), (9, "É x é"), (10, "é x é"), (11, "a " * 200_000), (12, "lone"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("print", "root", "node", "fingerprint", "_salt", "component_id")})
    got = hamming.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=str) == wanted(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].component_id == by_id[5].component_id == by_id[6].component_id == 4 and by_id[2].component_id == 1
    assert by_id[9].fingerprint != by_id[10].fingerprint
    assert hamming.near_duplicates(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "three short words here")], "doc_id long, text string")
    assert hamming.near_duplicates(alone).first().component_id is None
