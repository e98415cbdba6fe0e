"""Spelling variants against every deletion, and the index against all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, spelling  # noqa: F401
from plumbline.llm.catalog import QUERIES

FIELDS = ("word", "form", "root", "n", "n_near", "form_n")


def plain_words(rows):
    held = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            held[run] += 1
    return {w: n for w, n in held.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(count):
    met, near = defaultdict(set), defaultdict(set)
    for w in count:
        for i in range(len(w)):
            met[w[:i] + w[i + 1 :]].add(w)
        met[w].add(w)
    for group in met.values():
        for a in group:
            near[a] |= {b for b in group if b != a and is_near(a, b)}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None
    out = set()
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return out


def collected(frame):
    rows = [tuple(r[c] for c in FIELDS) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query(spark, size):
    d = f"/root/testdata/sf{size}"
    want = plain_variants(plain_words(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()))
    got = collected(QUERIES["op12_spelling"](spark, d))
    assert got == want and any(r[1] for r in got)


@pytest.mark.parametrize("part", [1, 7, 16_384])
def test_made_words(spark, part):
    rnd, texts = random.Random(2), []
    base = ["example", "examples", "bananaé", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÀÉÖàéöÿÿ", "tentatively"]
    for i in range(400):
        out = []
        for _ in range(30):
            w = rnd.choice(base[: 1 + i % len(base)])
            if rnd.random() < 0.3:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice("abé") + w[at:], w[:at] + rnd.choice("abcÿ") + w[at + 1 :]])
            out.append(w.upper() if rnd.random() < 0.1 else w)
        texts.append((rnd.choice([None, i, 5]), rnd.choice([" ", "-", "1", "ÿ "]).join(out)))
    texts += [(1, None), (2, ""), (3, "verylongword " * 20_000), (3, "verylongword" * 40), (3, "verylongword" * 40), texts[0]]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("word", "n", "form", "size", "letters", "part", "_key")})
    got = collected(spelling.variants(docs, part=part))
    assert got == plain_variants(plain_words(texts)) and any(r[1] is not None and r[2] != r[1] for r in got)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_index_finds_what_all_pairs_find():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("ab") for _ in range(n)) for n in (7, 8) for _ in range(300)})
    for n in (7, 8):
        side = [w for w in words if len(w) == n]
        index = spelling.Index(side)
        for q in [w for w in words if len(w) in (n - 1, n)]:
            assert [side[i] for i in index.near(q)] == [w for w in side if is_near(q, w)]
