"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import brute
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, chunks, components, licenses, minhash, mixing, pieces, quality, queries, simhash, suffixes, wrappers
from plumbline.llm.common import word_count

D = "/root/testdata/sf0.001"
PROSE = " ".join(f"word{i * 7919 % 1009}x" for i in range(400))
ROWS = [
    (1, PROSE, "a"), (2, PROSE, "a"), (3, PROSE + " tail", None), (4, "", "b"), (5, None, "b"), (None, PROSE, "a"), (None, None, None),
    (6, "one two", "b"), (6, "one two", "b"), (7, " \t\n ", "c"), (8, "x" * 300_000, "c"), (9, "é" * 1000 + " ünïcode 😀", "a"),
    (10, "start " + PROSE[500:1500] + " end of another text that nobody else has", "b"), (6, "one two three", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("mine") for c in ("n_chars", "score", "kept", "ids", "class", "tie", "copies", "n_removed", "size", "_spans2", "target")})


def empty(frame):
    return frame.limit(0)


def test_chunks(docs):
    got = {(r.doc_id, r.text is None, r.n_bytes): r for r in chunks.dedup_substrings(docs).collect()}
    assert len(chunks.dedup_substrings(docs).collect()) == len(ROWS)
    assert got[(1, False, len(PROSE))].n_removed == 0 and got[(2, False, len(PROSE))].text == ""
    assert got[(5, True, 0)].n_removed == 0 and got[(4, False, 0)].text == ""
    ten = next(r for r in got.values() if r.doc_id == 10)
    assert 700 < ten.n_removed < 1000 and ten.text.startswith("start ") and ten.text.endswith("nobody else has")
    assert chunks.dedup_substrings(empty(docs)).count() == 0


def test_cuts_move_only_near_an_insertion():
    raw = PROSE.encode()
    moved = raw[:1000] + b"inserted" + raw[1000:]
    pieces_of = lambda r: {r[a:b] for a, b in zip([0, *chunks.cuts(r)], chunks.cuts(r), strict=False)}
    assert len(pieces_of(moved) - pieces_of(raw)) <= 4
    for text in ("é" * 999, "a", "", "\n" * 5000):
        ends = chunks.cuts(text.encode())
        assert (ends[-1] if ends else 0) == len(text.encode())
        b"".join(text.encode()[a:b] for a, b in zip([0, *ends], ends, strict=False)).decode()


def test_mixing(spark, docs):
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("t"))
    rows = mixing.copies(sized, tie="t").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.copies <= 2 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.copies(sized.repartition(5), tie="t").collect()))
    assert mixing.copies(empty(sized), tie="t").count() == 0
    one = spark.createDataFrame([(i, "s", 0) for i in range(5)], "doc_id long, source string, size long")
    assert {(r.target, r.copies) for r in mixing.copies(one).collect()} == {(0.0, 0)}


def test_chat(spark):
    odd = [
        (1, 0, "user", "<|im_end|><|im_start|>"), (1, 1, "assistant", "<\\|im_end|> <\\\\| a<b <"), (2, None, None, None), (2, 0, "assistant", "x"),
        (None, 0, "user", "q"), (3, 0, "user\n<|im_sep|>", "r"), (4, 0, "system", "s"), (4, 0, "system", "s"),
    ]
    turns = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    done = chat.format_conversations(turns).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in done.collect()}
    for key in (1, 2, 3, 4, None):
        want = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in odd if c == key), key=lambda w: (w[0], w[1] or 0, w[2], w[3]))
        assert [(b["role"], b["text"]) for b in got[key].back] == [(r, x) for _, _, r, x in want]
    assert got[1].valid and not got[2].valid and got[1].loss == "<\\|im_end|> <\\\\| a<b <" and got[None].n_turns == 1
    assert chat.format_conversations(empty(turns)).count() == 0


def test_suffixes(docs, monkeypatch):
    def key(i, t):
        return (i is None, i or 0, t or "")

    for limit in (2_000, 1):  # through the sort, then through the shuffle of single strings
        monkeypatch.setattr(suffixes, "GROUP", limit)
        rows = suffixes.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
        got = sorted(((key(r.doc_id, r.text), (r.n_bytes, r.n_removed, r.n_spans, r.sha)) for r in rows))
        short = [(i, t if t is None or len(t) < 50_000 else None) for i, t, _ in ROWS]
        want = sorted((key(i, t), w) for (i, t), w in zip([(i, t) for i, t, _ in ROWS], brute.without_repeats([t for _, t in short]), strict=True))
        assert [g for g in got if len(g[0][2]) < 50_000] == [w for w in want if len(w[0][2]) < 50_000]
        assert next(r.n_removed for r in rows if r.doc_id == 8) == 300_000
    assert suffixes.remove_repeats(empty(docs)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; more</h1><p>One <b>bold</b>
 text &#8364;&nbsp;5.<p>Two<br>lines</p><aside>Side</aside><form><p>Mail</p></form><div class="ad">Buy</div><ul><li>first<li>second</ul>
<section class="comments"><p>Reader</p></section><!-- <p>hidden</p> --></article></main><div id="sidebar"><p>Links</p></div><footer>&copy; us</footer></body></html>"""


def test_wrappers(spark):
    plain = [(i, f"http://p.org/{i}", f"<body><div>Same line</div><div>Own text {i} here</div><p>Same end</p></body>") for i in range(6)]
    odd = [(100, "http://h.org/a", PAGE), (101, "http://h.org/b", None), (102, None, ""), (103, "no url", "just text &lt;"), (103, "no url", "just text &lt;"), (None, "http://h.org/c", "<p>" + "long " * 50_000), (104, "http://h.org", "<div <p>>< a")]
    pages = spark.createDataFrame([*plain, *odd], "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    rows = wrappers.extract(pages).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(plain) + len(odd)
    assert got[100] == "Head & more\nOne bold text € 5.\nTwo lines\nfirst\nsecond"
    soup = "<div class='site-header'><p>Top</p></div><div id='content'><h2 class=page-header>T</h2><p>Body<div class='related-posts'>More</div></div><p>Out</p>"
    assert [t for r, t in wrappers.blocks(soup)[0] if r == 1] == ["T", "Body"]
    assert got[101] == got[102] == "" and got[103] == "just text <" and len(got[None]) == 249_999
    assert [got[i] for i in range(6)] == [f"Own text {i} here" for i in range(6)]
    assert wrappers.extract(empty(pages)).count() == 0


def test_wrapper_items():
    list_page = ["body", "ul", *["li", "t" + "a" * 16, "/li", "li", "t" + "b" * 16, "/li", "li", "t" + "c" * 16, "/li"], "/ul", "/body"]
    folded = wrappers.fold(list_page)
    assert folded == ("body", "ul", ("+", ("li", "#", "/li")), "/ul", "/body")
    extra = wrappers.align(folded, wrappers.fold(["body", "div", "t" + "d" * 16, "/div", *list_page[1:]]))
    assert extra == ("body", ("?", ("div", "t" + "d" * 16, "/div")), "ul", ("+", ("li", "#", "/li")), "/ul", "/body")


def test_wrappers_decide_inside_articles(spark):
    body = lambda i: "".join(f"<p>Own {i} {j}</p>" for j in range(2 + i % 3))
    page = lambda i: f"<body><main><article><h1>Head {i}</h1><p>Share this story</p>{body(i)}<p>Read more</p><p>All rights with us</p></article></main></body>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(9)] + [(50, "http://a.org/no", None)]
    copies = [(100 + i, f"http://b.org/{i}", "<body><div>One text</div><p>and its end</p></body>") for i in range(5)]
    teaser = [(200 + i, f"http://c.org/{i}", f"<article>Join us</article><div>Story {i}</div>") for i in range(4)]
    for parts in (1, 5):
        pages = spark.createDataFrame([*rows, *copies, *teaser], "page_id long, url string, html string").repartition(parts)
        got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
        assert all(got[i] == "\n".join([f"Head {i}", *(f"Own {i} {j}" for j in range(2 + i % 3))]) for i in range(9)) and got[50] == ""
        assert all(got[100 + i] == "One text\nand its end" for i in range(5)) and all(got[200 + i] == f"Story {i}" for i in range(4))


def test_wrapper_constants_by_position():
    pages = [["body", "p", "t" + "a" * 16, "/p", *["p", "t" + c * 16, "/p"] * 4, "p", "t" + "b" * 16, "/p", "/body"] for c in "cde"]
    wrapper = wrappers.unite(wrappers.unite(*map(tuple, pages[:2])), tuple(pages[2]))
    assert [i for i in wrapper if isinstance(i, str) and i[0] == "t"] == ["t" + "a" * 16, "t" + "b" * 16]
    assert sum(isinstance(i, tuple) and i[0] == "+" for i in wrapper) == 1


@pytest.mark.parametrize("start", [
    "<article class='post has-sidebar'>", "<div class='content no-sidebar'>", "<main class='with-share'>", "<article id='notice-12'>",
    "<body class='left-sidebar'><div class='page sidebar'><article>", "<form><main>", "<form><div id=content>", "<form>", "<div class='social ads'><form><article>",
    "<main class=comments>", "<article class='ad'>",
])
def test_names_keep_the_main_text(start):
    inner = "<h2 class='related'>Head</h2><p class='alert big'>Body</p><ul><li class=social>Item</ul><div class='related-posts'><p>More</p></div><section class=comments><article>Reader</article></section>"
    found = wrappers.blocks(start + inner)[0]
    texts = wrappers.main_text(start + inner, None)[0].split("\n")
    assert texts[:3] == ["Head", "Body", "Item"] and "More" not in texts and "Reader" not in texts and len(found) == 3


def test_names_still_drop():
    page = "<div class='site-header'>A</div><div class='cookie-notice'>B</div><div id=left_sidebar>C</div><form>D</form><div class='ad'>E</div><p>F</p><div class='share-price'>G</div>"
    assert [t for _, t in wrappers.blocks(page)[0]] == ["F", "G"]


def test_minhash(docs):
    rows = minhash.near_duplicates(docs, shingle=5).collect()
    assert len(rows) == len(ROWS)
    of = lambda i: [r for r in rows if r.doc_id == i]
    assert of(1)[0].component_id == of(2)[0].component_id == of(3)[0].component_id == 1 and of(1)[0].kept and not of(2)[0].kept
    assert {r.component_id for r in of(None)} == {1, None} and of(5)[0].component_id == 5 and of(5)[0].n_shingles == 0
    assert [r.kept for r in of(6)] == [True] * 3
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_minhash_large_groups(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:i % 290] + [f"changed{i}"] + words[i % 290 + 1 :])) for i in range(600)]
    rows += [(10_000 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(50)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == brute.near_groups(rows, 4)


def family(texts, planted, seed=3):
    """Texts of one template with nine words of their own each (mean similarity 0.75), and edited copies of the first of them."""
    r, new = random.Random(seed), iter(range(10**6))

    def edit(words, k):
        words = list(words)
        for place in r.sample(range(len(words)), k):
            words[place] = f"n{next(new)}"
        return words

    own = [edit([f"t{i}" for i in range(600)], 9) for _ in range(texts)]
    rows = [(i, " ".join(w)) for i, w in enumerate(own)] + [(10_000 + i, " ".join(edit(own[i], 12))) for i in range(planted)]
    return rows


def test_minhash_family(spark):
    rows = family(240, 120)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.near_groups(rows, 5)
    linked = [i for i in range(120) if want[i] == want[10_000 + i]]
    assert len(linked) > 100 and all(got[i] == got[10_000 + i] for i in linked)
    assert all(want[i] == want[g] for i, g in got.items())


def test_prefix_pairs_lose_no_pair_with_a_rare_shingle(spark):
    rows = [*family(100, 60, 8), (20_000, ""), (20_001, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = minhash._full_sets(docs, "text", 5).where("length(hashes) > 0")
    names = {bytes(r["class"]): r.doc_id for r in minhash.shingle_classes(docs, "doc_id", "text", 5).where("class is not null").collect()}
    roots = sets.select("class", F.col("class").alias("root"))
    got = {tuple(sorted((names[bytes(r.a)], names[bytes(r.b)]))) for r in minhash.prefix_pairs(sets, roots, 80).collect()}
    own = {i: brute.shingles(t, 5) for i, t in rows}
    held = Counter(s for o in own.values() for s in o)
    for x, i in enumerate(sorted(own)):
        for j in sorted(own)[x + 1 :]:
            common = own[i] & own[j]
            if 100 * len(common) >= 80 * len(own[i] | own[j]) and any(held[s] <= minhash.LIGHT for s in common):
                assert (i, j) in got
    assert len(got) < 2_000
    one = roots.withColumn("root", F.lit(b"same"))
    assert minhash.prefix_pairs(sets, one, 80).count() == 0 == minhash.prefix_pairs(sets.limit(0), roots, 80).count()


@pytest.mark.parametrize("block", [40, 4096])
def test_prefix_pairs_lose_no_pair_of_frequent_shingles(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(5)
    lines = [" ".join(f"l{i}w{j}" for j in range(r.choice((8, 20)))) for i in range(14)]
    picks = sorted({tuple(sorted(r.sample(range(14), r.choice((9, 10, 11))))) for _ in range(400)})
    rows = [(k, " ".join(lines[i] for i in pick)) for k, pick in enumerate(picks)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = minhash._full_sets(docs, "text", 4)
    classes = minhash.shingle_classes(docs, "doc_id", "text", 4)
    names = {bytes(r["class"]): r.doc_id for r in classes.collect()}
    own = {i: brute.shingles(t, 4) for i, t in rows}
    held = Counter(s for o in own.values() for s in o)
    like = {(i, j): own[i] & own[j] for i in own for j in own if i < j and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])}
    assert len(like) > 100 and sum(all(held[s] > 64 for s in common) for common in like.values()) > 10
    for alone in (True, False):
        # all in groups of their own, or most in one
        group = F.when(F.lit(alone) | (F.col("doc_id") % 5 == 0), F.col("doc_id")).otherwise(-1).cast("string").cast("binary")
        roots = classes.select("class", group.alias("root"))
        got = {tuple(sorted((names[bytes(r.a)], names[bytes(r.b)]))) for r in minhash.prefix_pairs(sets, roots, 80).collect()}
        of = {i: i if alone or i % 5 == 0 else -1 for i in own}
        assert all(of[i] != of[j] for i, j in got)
        for i, j in got & set(like):
            old, kept = of[i], of[j]
            of = {k: kept if g == old else g for k, g in of.items()}
        assert all(of[i] == of[j] for i, j in like)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1400), 1000)}


def test_every_trusted_document_is_used(spark):
    labels = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(labels).count() == 20_500
    docs = labels.select("doc_id", F.lit("word").alias("text"))
    whole, target = quality.count(docs, labels)
    assert whole.sum() == 20_500 and target.sum() == quality.trusted_ids(labels).where("not held").count()


def test_quality(spark, docs, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.judge(clashing, model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert brute.base_counts(r.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    none = quality.fit(empty(docs), empty(labels))
    assert quality.judge(docs, none).where("kept = base_failed").count() == 0
    assert quality.judge(empty(docs), none).count() == 0


def test_pieces(spark, clashing):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["", None, " ", "   ", "▁", "▁▁a", " a", "a ", "\t", "a\u0000b", "ﬁ ½ 한국어 😀", "<s> </s> <unk> <0x41>", "a▁b", " " * 100 + "b", "�", "x" * 9000]
    frame = spark.createDataFrame(list(enumerate(odd)), "k long, text string")
    model = queries.piece_model()
    coded = pieces.encode(frame, model)
    back = {r.k: r for r in pieces.decode(coded.withColumn("same", F.col("ids")), model).collect()}
    for k, text in enumerate(odd):
        ids = sp.encode(text or "")
        assert list(back[k].same) == ids and back[k].decoded == sp.decode(ids)
    broken = spark.createDataFrame([(0, [200, 201]), (1, []), (2, None), (3, [1, 300, 2])], "k long, ids array<int>")
    assert {r.k: r.decoded for r in pieces.decode(broken, model).collect()} == {0: sp.decode([200, 201]), 1: "", 2: "", 3: sp.decode([1, 300, 2])}
    assert pieces.encode(clashing.drop("ids"), model).count() == len(ROWS) and pieces.encode(empty(frame), model).count() == 0


def test_simhash(spark, docs):
    rows = simhash.edited_texts(docs).collect()
    assert len(rows) == len(ROWS) and simhash.edited_texts(empty(docs)).count() == 0
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.edited) for r in rows), key=lambda x: x[:2], reverse=True)
    assert next(r for r in order if r[1] == 10)[3][:6] == "start " and order[0][1] == 10
    single = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert [r.edited for r in simhash.edited_texts(single).collect()] == ["abcdab"]
    prints = simhash.vote(spark.createDataFrame([(0, None), (1, ""), (2, "a"), (3, "a"), (4, "a b")], "k long, text string"), ["k"], "text")
    got = {r.k: (r.hi, r.lo) for r in prints.collect()}
    assert got[0] == got[1] == (0, 0) != got[2] == got[3] != got[4]


def test_simhash_search(spark):
    base = 0x0123456789ABCDEF
    longs = [(0, base, base), (1, base ^ 0b101, base), (2, base, base ^ (0b111 << 60 >> 4)), (3, base, base), (4, ~base, base), (5, base ^ 0b1111, base)]
    frame = spark.createDataFrame(longs, "doc_id long, hi long, lo long")
    bits = lambda i, j: bin((longs[i][1] ^ longs[j][1]) & (2**64 - 1)).count("1") + bin((longs[i][2] ^ longs[j][2]) & (2**64 - 1)).count("1")
    want = {(i, j, bits(i, j)) for i in (0, 1, 2, 4, 5) for j in (0, 1, 2, 4, 5) if i < j and bits(i, j) <= 3}
    assert {tuple(r) for r in simhash.near(frame, "doc_id", 3).collect()} == want
    assert {(r.doc_id, r["class"]) for r in simhash.classes(frame, "doc_id").collect()} == {(0, 0), (3, 0), (1, 1), (2, 2), (4, 4), (5, 5)}


def test_licenses(spark):
    texts = [None, "", "Released under the MIT License.", "body\n\n  released UNDER the mit-license!!\nmore", "\n".join(licenses.TEMPLATES["MIT-text"].split(", ")), "all rights", "x " * 50_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("found", licenses.matches(F.col("text")))
    got = {r.k: {m["licence"] for m in r.found} for r in frame.collect()}
    assert got == {0: set(), 1: set(), 2: {"MIT"}, 3: {"MIT"}, 4: {"MIT-text"}, 5: set(), 6: set()}


def test_notices(spark):
    header = dict(reversed(licenses.HEADERS))
    gpl3 = header["GPL-3.0"]
    texts = {
        "Proprietary": "(c) 2024 Acme. All rights reserved.", "MIT": "Well, this was licensed under the MIT License. And more text follows it, of no matter.",
        "GPL-3.0": "Some words first. This work is licensed under the GNU General Public License, version 3. And some after.", "Apache-2.0": "# " + header["Apache-2.0"] + " Then the code of the file starts.",
        "GPL-3.0 ": "x = 1  # " + gpl3.replace(" you", "\n# you") + " You should have received a copy.", "GPL-2.0": header["GPL-2.0"].replace(":", ";"), "AGPL-3.0": "a b " + header["AGPL-3.0"],
        "LGPL-2.1": "A library. " + header["LGPL-2.1"], "LGPL-3.0": "see: " + header["LGPL-3.0"] + " end of the text", "CC-BY-NC-SA-4.0": "Pictures are licensed under CC BY-NC-SA 4.0 by us.",
        "BSD-3-Clause,Proprietary": "Copyright (c) Us. All rights reserved. " + header["BSD-3-Clause"].replace("the copyright holder", "Foo Bar Inc"), "MIT-text": "* " + licenses.TEMPLATES["MIT-text"].replace(", ", ",\n * ") + " * THE SOFTWARE IS PROVIDED AS IS",
        "GPL-2.0,GPL-3.0": "This work is licensed under the GNU General Public License.", "": "All of the rights of the people are in the hands of the state and to the public.",
        "MIT,Proprietary": "Released under the MIT License. All rights reserved. Released under the MIT License. " * 3,
    }
    rows = [(i, t) for i, t in enumerate([*texts.values(), None, "", "one"])]
    found = {r.k: [tuple(m) for m in r.found] for r in spark.createDataFrame(rows, "k long, text string").select("k", licenses.notices(F.col("text")).alias("found")).collect()}
    for i, text in rows:
        assert found[i] == brute.notices(text, licenses.NOTICES, licenses.THRESHOLD)
    for i, names in enumerate(texts):
        assert ",".join(sorted({m[0] for m in found[i]})) == names.strip()
    assert len(found[len(texts) - 1]) == 9


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, clashing, name, stage):
    done = stage(spark, clashing, D)
    rows = done.collect()
    if name != "piece_ids":
        assert done.columns == clashing.columns and all(r["class"] == "mine" for r in rows)
    assert stage(spark, empty(clashing), D).count() == 0
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "4", "5", "None", "6", "6", "7", "8", "9", "10"])


def test_pages_of_one_form_are_folded_once(monkeypatch):
    folded = []
    fold = wrappers.fold
    monkeypatch.setattr(wrappers, "fold", lambda stream: folded.append(1) or fold(stream))
    streams = [tuple(wrappers.blocks(f"<body><article><h1>{n} a</h1><p>{n} b</p><p>{n} c</p></article></body>")[1]) for n in range(50)]
    wrapper = streams[0]
    for stream in streams[1:]:
        wrapper = wrappers.unite(wrapper, stream)
    assert wrapper == ("body", "article", "h1", "#", "/h1", "p", "#", "/p", "p", "#", "/p", "/article", "/body")
    assert len(folded) <= 1
