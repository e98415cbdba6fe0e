"""The corpus queries on the smallest tables: against their SQL text or a plain version."""

from collections import Counter

import brute
import duckdb
import public_tokenizers
import pytest
import sentencepiece
from compare import connect

from plumbline.llm import queries  # noqa: F401
from plumbline.llm.catalog import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text from '{D}/documents.parquet' order by doc_id").fetchall()


def by_id(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, D).collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    frame = QUERIES[name](spark, D)
    columns = sorted(frame.columns)
    ours = Counter(tuple(r[c] for c in columns) for r in frame.collect())
    cursor = connect(D).execute(SQL[name])
    names = [d[0] for d in cursor.description]
    theirs = Counter(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert sorted(names) == columns and ours and ours == theirs


def test_mix_comes_near_its_targets(spark):
    taken, aims = Counter(), {}
    for r in QUERIES["op2_mixing"](spark, "/root/testdata/sf0.01").collect():
        taken[r.source_size, r.target] += r.taken
        assert r.taken <= 2 * r.size
        aims[r.source_size, r.target] = r.target
    assert all(abs(taken[k] - aim) <= 0.1 * aim for k, aim in aims.items())


def test_pieces_equal_the_library(spark, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = by_id(spark, "op8_pieces")
    for i, text in documents:
        ids = sp.encode(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(sp.decode(ids)))


def test_near_duplicates(spark, documents):
    got, groups = by_id(spark, "op6_minhash"), brute.near_groups(documents, 4)
    for i, text in documents:
        assert got[i].n_shingles == len(brute.shingles(text, 4))
        assert got[i].component_id == groups[i] and got[i].kept == (groups[i] == i)


def test_quality(spark, documents):
    got = by_id(spark, "op7_quality")
    for i, text in documents:
        counts, g = brute.base_counts(text), got[i]
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert counts == (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words)
        assert g.base_failed == failed and not (failed and g.kept)


def test_quality_on_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, d).collect()}
    labels = duckdb.sql(f"select doc_id, quality, toxic from '{d}/labels.parquet'").fetchall()
    good = [got[i].kept for i, q, t in labels if q == 1 and t == 0 and not got[i].base_failed]
    bad = [got[i].kept for i, q, _ in labels if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_suffixes(spark, documents):
    got = by_id(spark, "op4_suffixes")
    for (i, _), exp in zip(documents, brute.without_repeats([t for _, t in documents]), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == exp


def test_simhash(spark, documents):
    got, rows = by_id(spark, "op9_simhash"), [(i, t or "") for i, t in reversed(documents)]
    for (i, text), changed in zip(rows, brute.edited([t for _, t in rows]), strict=True):
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == brute.sha(changed)
        assert got[i].near_edited == 1 or changed != text
    prints = {}
    for i, text in rows:
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.15


def test_chunks_catch_long_passages(spark, documents):
    got, first, caught = by_id(spark, "op1_chunks"), {}, 0
    for i, text in documents:
        words = (text or "").split()
        windows = {tuple(words[k : k + 51]) for k in range(len(words) - 50)}
        if any(first.get(w, i) != i for w in windows):
            caught += 1
            assert got[i].n_removed > 0
        for w in windows:
            first.setdefault(w, i)
        assert len(got[i].text.encode()) == got[i].n_bytes - got[i].n_removed
    assert caught


def test_pages(spark):
    got = by_id(spark, "op5_wrappers", "page_id")
    for i, html in duckdb.sql(f"select page_id, html from '{D}/pages.parquet'").fetchall():
        text = got[i].text
        assert got[i].n_chars == len(text) > 0 and "track(" not in text and "©" not in text
        assert "  " not in text and not any(line != line.strip() or not line for line in text.split("\n"))
        assert html.count("<p>") <= text.count("\n") + 1 <= html.count("<p>") + 1
