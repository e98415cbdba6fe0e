"""Steps that have to grow no faster than their input: plans and results of the operators mended for it."""

import datetime as dt
import random

from pyspark.sql import functions as F

from plumbline.operators import lookup as lk

T0 = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_needles_are_not_sent_to_the_driver(spark):
    texts = spark.range(10).select(F.col("id").alias("t"), F.concat(F.lit("x"), F.col("id") + 10_000).alias("text"))
    needles = lambda n: spark.range(n).select((F.col("id") + 10_000).cast("string").alias("n"))
    many = lk.contained(texts, "text", needles(lk.FEW + 1), "n")
    assert "SortMergeJoin" in plan(many) and "BroadcastHashJoin" not in plan(many)
    assert many.count() == 10
    assert "SortMergeJoin" not in plan(lk.contained(texts, "text", needles(10), "n"))


def test_lines_of_a_directory_are_not_broadcast(spark):
    from plumbline.operators import places as pl
    lines = spark.createDataFrame([(1, 1, "A팀"), (1, 2, "위치"), (1, 3, ": 본관 2층")], "page_id long, line_no long, line string")
    found = pl.unit_blocks(lines, spark.createDataFrame([("A팀",)], "unit string"), "본관 2층")
    assert "SortMergeJoin [page_id" in plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, "A팀", "본관 2층", None)]


def test_blocking_runs_do_not_meet_in_pairs(spark):
    from plumbline.operators import snapshots as sn
    rng = random.Random(7)
    rows = [(i, rng.choice(("queued", "done")), T0 + dt.timedelta(minutes=rng.randrange(0, 900, 15))) for i in range(400)]
    rows = [(i, s, at, at + dt.timedelta(minutes=rng.choice((-15, 0, 10)))) for i, s, at in rows]
    found = sn.overlapping_runs(spark.createDataFrame(rows, "run_id long, status string, started_at timestamp, updated_at timestamp"))
    assert "_slot" not in plan(found)
    want = {}
    for i, _, start, _ in rows:
        before = [(up, j) for j, s, _, up in rows if s == "queued" and j != i and dt.timedelta(0) <= start - up < dt.timedelta(hours=2)]
        if before:
            want[i] = max(before)[1]
    assert {r.run_id: r.blocker for r in found.collect()} == want


def test_edges_of_shortest_paths_are_made_once(spark):
    from plumbline.operators import graph as gr
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    chain = spark.range(8).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight")).coalesce(1)
    best = gr.shortest_paths(chain.mapInPandas(count, chain.schema), spark.range(1).select(F.col("id").alias("node")))
    assert {r.node: r.dist for r in best.collect()} == {i: float(i) for i in range(9)} and made.value == 8


def test_points_and_shapes_in_one_place_are_one(spark):
    from plumbline.operators import graph as gr
    points = spark.range(6000).select(F.col("id").alias("point_id"), F.lit(1.0).alias("px"), F.lit(2.0).alias("py"))
    shapes = spark.range(6000).select((F.col("id") + 7).alias("node_id"), F.lit(4.0).alias("x"), F.lit(6.0).alias("y"))
    asked = spark.sparkContext.accumulator(0)
    F_distance = F.udf(lambda x: asked.add(1) or 5.0, "double")  # noqa: N806
    rows = gr.nearest(points, shapes, ("x", "y"), ("x", "y"), F_distance("px"), "node_id", 8.0)
    assert rows.groupBy("shape", "distance").count().collect() == [(7, 5.0, 6000)] and asked.value == 1


def test_a_long_item_is_cut_into_few_stretches(spark):
    days = lambda a, b: (T0 + dt.timedelta(days=a), T0 + dt.timedelta(days=b))
    rng = random.Random(3)
    spans = lambda n, most: [(i, *days(a, a + rng.randrange(0, most))) for i, a in enumerate(rng.randrange(0, 3000) for _ in range(n))]
    queries, items = spans(30, 190), spans(40, 2600)
    q = spark.createDataFrame(queries, "q long, q_start timestamp, q_end timestamp").select("q", F.to_date("q_start").alias("q_start"), F.to_date("q_end").alias("q_end"))
    i = spark.createDataFrame(items, "i long, start_date timestamp, end_date timestamp").select("i", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))
    found = lk.overlapping(q, i)
    assert "7 days" not in plan(found).lower() and "INTERVAL '7'" not in plan(found) and "date_trunc" not in plan(found).lower() and "trunc" not in plan(found).lower()
    assert sorted((r.q, r.i) for r in found.collect()) == sorted((a, b) for a, s, e in queries for b, x, y in items if x <= e and y >= s)


def test_rolling_alerts_read_a_row_a_fixed_number_of_times(spark):
    from plumbline.streaming import jobs
    rng = random.Random(5)
    rows = [(T0 + dt.timedelta(seconds=rng.choice((0, 1, 300, 301)) + rng.randrange(0, 4000)), rng.choice((1, 40_000))) for _ in range(200)]
    turns = spark.createDataFrame(rows, "created_at timestamp, elapsed_ms long")
    found = jobs._rolling(turns, "r", 5, lambda n, slow: (n >= 17) & (slow * 2 > n))
    assert "specifiedwindowframe(RangeFrame, -" not in plan(found)
    span = lambda at, last: [e for t, e in rows if at - dt.timedelta(minutes=5) < t and (t <= at if last else t < at)]
    raised = lambda s: len(s) >= 17 and 2 * sum(e > jobs.SLOW_MS for e in s) > len(s)
    want = sorted((at, len(span(at, True))) for at in {t for t, _ in rows} if raised(span(at, True)) and not raised(span(at, False)))
    assert want and sorted((r.raised_at, r.n) for r in found.collect()) == want


def test_a_long_quote_is_squashed_once(spark):
    from plumbline.operators import verify as vf
    squash = plan(spark.createDataFrame([("a b", "a  b")], "page string, quote string").select(vf.quote_present(F.col("page"), F.col("quote")).alias("x"))).count("regexp_replace(")
    assert squash == 2
    text = "".join(chr(0xAC00 + i) for i in range(4000))
    rows = [(text, text, True), (text[200:], text, False), (text[45:], text, True), (None, text, False), ("x", "", True), ("abc d", "c d", True), (text[:100], text[:95], True), (text[40:], text[:65], False)]
    found = spark.createDataFrame(rows, "page string, quote string, want boolean").select(vf.quote_present(F.col("page"), F.col("quote")).alias("x"), "want").collect()
    assert [r.x for r in found] == [r.want for r in found]


def test_equal_tips_and_questions_are_judged_once(spark):
    queries = spark.range(500).select(F.col("id").alias("query_id"), F.lit("red ring 어디").alias("query"))
    tips = spark.range(1, 2001).select(F.col("id").alias("tip_id"), F.when(F.col("id") == 1999, "red ring x NATION_1").otherwise(F.when(F.col("id") % 2 == 0, "red ring").otherwise("blue ring")).alias("text"))
    found = lk.tip_match(queries, tips, spark.createDataFrame([("NATION_1",)], "name string"))
    assert found.groupBy("tip_id", "score", "place").count().orderBy("place").collect() == [(2, 2, 1, 500), (4, 2, 2, 500), (6, 2, 3, 500)]
    # the texts meet, not the rows: three of tips and one of questions
    scans = [s.split("]")[0] for s in plan(found).split("Scan ExistingRDD")]
    assert any("ids" in s for s in scans[1:])


def test_tokens_leave_in_small_frames(spark, monkeypatch):
    from plumbline.sources import html
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("https://x.example/").alias("url"), F.lit("<body><p>a</p><p>b</p></body>").alias("html")).coalesce(1)
    sizes = []

    class Catch:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            frame = pages.toPandas()
            sizes.extend(len(f) for f in run(iter([frame])))

    monkeypatch.setattr(html, "FRAME_ROWS", 10)
    html.html_tokens(Catch())
    assert max(sizes) <= 10 and sum(sizes) == 100 == html.html_tokens(pages).count()


def test_rounds_of_a_walk_do_not_multiply_sizes(spark):
    from plumbline.operators import graph as gr
    line = lambda a, b: [(float(a), 0.0), (float(b), 0.0)]
    edges = spark.createDataFrame([(i, i, i + 1, line(10 * i, 10 * i + 10)) for i in range(12)], "edge_id long, a long, b long, line array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 5.0, 0.0), (2, 115.0, 0.0)], "point_id long, px double, py double")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, start long, goal long")
    walks = gr.routes(pairs, points, edges, 1.0, 64.0)
    assert walks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 2_000
    assert [(r.meters, r.nodes) for r in walks.collect()] == [(110.0, list(range(1, 12)))]


def test_rounds_of_components_do_not_multiply_sizes(spark):
    from plumbline.llm.components import components
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    found = components(edges)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 2_000
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(41)}


def test_documents_go_to_python_once_and_only_where_packed(spark):
    from plumbline.plans import files
    d = "/root/testdata/sf0.001"
    assert plan(files.office_text_body(spark, d)).count("EvalPython [") == 3
    assert plan(files.office_files(spark, d)).count("EvalPython [") == 2
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(files.office_text_body(spark, d)) == ids(files.office_text(spark, d).where("status = 'ok'"))


def test_grams_leave_a_task_in_frames(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from plumbline.operators import retrieve
    monkeypatch.setattr(retrieve, "FRAME", 100)
    texts = ["x" * n for n in (0, 30, 30, 250, 5, 0, 60, 60, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "norm"])
    frames = list(retrieve._framed(iter([batch, batch.slice(0, 0)]), "doc_id", lambda text: np.arange(len(text), dtype=np.uint64)))
    assert [f.num_rows for f in frames] == [310, 125, 3]
    found = pa.Table.from_batches(frames).to_pydict()
    assert list(zip(found["doc_id"], found["gram"], strict=True)) == [(i, g) for i, t in enumerate(texts) for g in range(len(t))]


def test_search_scores_where_the_sections_are(spark, monkeypatch, tmp_path):
    import math
    import re

    from plumbline.operators import search_index as si
    rng = random.Random(11)
    word = lambda: rng.choice(("a", "b", "c", "d")) if rng.random() < 0.7 else f"w{rng.randrange(60)}"
    bodies = [" ".join(word() for _ in range(rng.choice((0, 1, 3, 9, 40)))) + (" all" if i % 90 else "") for i in range(360)]
    bodies += bodies[:120]  # copies: scores that only the id tells apart
    sections = [(f"s{i * 7919 % 1000}", ("rule", "guide")[i % 2], b) for i, b in enumerate(bodies)]
    asked = [(q, " ".join(word() for _ in range(rng.randrange(1, 7))) + (" all" if q % 3 else " none")) for q in range(40)]
    si.build(spark.createDataFrame([*sections, ("s9999", None, "a b w1")], "section_id string, source_kind string, body string").repartition(5), str(tmp_path))
    scored, real = [], si._scored
    monkeypatch.setattr(si, "_scored", lambda i, a: scored.append(real(i, a)) or scored[-1])
    monkeypatch.setattr(si, "QUESTIONS", 13)
    found = si.top_k(spark.createDataFrame(asked, "q long, query string"), si.read(spark, str(tmp_path)), 3, 20)
    assert all("Exchange" not in plan(s) and "Join" not in plan(s) for s in scored) and len(scored) == 2
    held = [re.findall("[a-z0-9]+", b) for _, _, b in sections] + [["a", "b", "w1"]]
    df = {w: sum(w in h for h in held) for h in held for w in h}
    mean = sum(map(len, held)) / len(held)
    part = lambda w, h: math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * h.count(w) * 2.2 / (h.count(w) + 1.2 * (1 - 0.75 + 0.75 * len(h) / mean))
    want = set()
    for q, text in asked:
        for kind in ("rule", "guide"):
            hits = [(sum(math.floor(part(w, h) * 1e6 + 0.5) for w in set(text.split()) if w in h), s) for (s, k, _), h in zip(sections, held[:-1], strict=True) if k == kind and set(text.split()) & set(h)]
            want |= {(q, kind, s, n, place) for place, (n, s) in enumerate(sorted(hits, key=lambda x: (-x[0], x[1]))[:3], 1)}
    assert {(r.q, r.source_kind, r.section_id, r.score, r.place) for r in found.collect()} == want


def test_sections_are_looked_up_among_the_hits(spark):
    from plumbline.plans import retrieval
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100_000)
    try:
        found = retrieval.index_acceptance(spark, "/root/testdata/sf0.001")
        lines = plan(found).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    moved = 0
    for at, line in enumerate(lines):
        if "Exchange" in line and "REPARTITION" not in line:
            below = [other for other in lines[at + 1 :] if depth(other) or not other[:1].isspace()]
            below = below[: next((i for i, other in enumerate(below) if depth(other) <= depth(line) and other.strip(" :")), len(below))]
            text = "\n".join(below)
            if "Generate" in text:
                moved += 1
                assert "LeftSemi" in text or "partial_count" in text
    assert moved and all(r.passed for r in found.collect())


def test_a_short_deny_list_does_not_shuffle_sections(spark):
    from plumbline.plans import retrieval
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100_000)
    try:
        text = plan(retrieval.searchable(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in text


def test_lanes_shuffle_and_sort_bars_once(spark):
    from plumbline.operators import ranking
    rng = random.Random(17)
    bars = [(rng.choice((1, 1, 1, 2)), c0, rng.randint(c0, 6), i) for i, c0 in enumerate(rng.randint(0, 6) for _ in range(30_000))]
    df = spark.createDataFrame(bars, "week int, c0 int, c1 int, id int").repartition(5)
    found = ranking.interval_lanes(df, "week", "c0", "c1", ["id"], ["id", "week", "c0", "c1"])
    text = plan(found)
    assert text.count("Exchange hashpartitioning(week") == 1 and text.count("Sort [") == 1 and "Join" not in text and "checkpoint" not in text
    want = {}
    for week in (1, 2):
        ends = []
        for day in range(7):
            free = [lane for lane, end in enumerate(ends) if end < day]
            for _, _, c1, i in sorted((b for b in bars if b[:2] == (week, day)), key=lambda b: b[3]):
                want[i] = free.pop(0) if free else len(ends)
                ends[want[i] : want[i] + 1] = [c1]
    assert {r.id: r.lane for r in found.collect()} == want
    assert found.columns == ["id", "week", "c0", "c1", "lane"]


def test_menu_sheets_need_no_table_on_the_driver(spark):
    from plumbline.operators import places as pl
    from plumbline.plans import aggregates, directories
    d = "/root/testdata/sf0.001"
    grid = plan(directories.menu_grid(spark, d))
    assert "Broadcast" not in grid and not any("Exchange" in line and "row_y" in line for line in grid.split("\n"))
    for query in (directories.menu_text, aggregates.menu_days):
        assert "Broadcast" not in plan(query(spark, d))
    head = [(page, 0, 100.0 * i, 700.0, f"3월 {i}일") for page in (1, 2) for i in (1, 2, 3)]
    labels = [(1, 0, 20.0, y, t) for y, t in ((500.0, "조식"), (300.0, "중식"), (300.0, "중식"), (100.0, "구분"))]
    dishes = [(page, i, x, y, f"{x}/{y}") for page in (1, 2) for i, (x, y) in enumerate(((100.0, 400.0), (149.0, 401.0), (150.0, 90.0), (340.0, 600.0), (340.0, 698.0)))]
    df = spark.createDataFrame([*head, *labels, *dishes, (1, 9, 100.0, 90.0, "♥"), (1, 9, 100.0, 90.0, "*x")], "page_id long, pos long, x double, y double, text string")
    got = {(r.page_id, r.text, r.day, r.row_y, r.label) for r in pl.menu_grid(df).collect()}
    cells = (("100.0/400.0", 1, 400.0, "중식"), ("149.0/401.0", 1, 400.0, "중식"), ("150.0/90.0", 2, 90.0, "중식"), ("340.0/600.0", 3, 600.0, "조식"))
    assert got == {(page, t, f"3월 {n}일", y, label if page == 1 else "식단") for page in (1, 2) for t, n, y, label in cells}


def test_a_long_deny_list_moves_sections_once(spark, monkeypatch):
    from plumbline.operators import retrieve
    names = [None, "", "a", "b", "d1", "doc:d1:3", "doc:d2:0", "doc::1"]
    rows = [(i, s, e, p) for i, (s, e, p) in enumerate((s, e, p) for s in names for e in names for p in (None, "", "d1", "d3"))]
    df = spark.createDataFrame(rows, "i long, section_id string, evidence_id string, parent_id string")
    ids = spark.createDataFrame([(x,) for x in ("a", "d2", "d3", "doc:d1:3", "a", None)], "id string")
    few = {r.i for r in retrieve.denied(df, ids).collect()}
    parent = lambda e, p: p or (e[4:].rsplit(":", 1)[0] if e and e.startswith("doc:") else None) or None
    assert few == {i for i, s, e, p in rows if not {s, e, parent(e, p)} & {"a", "d2", "d3", "doc:d1:3"}}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    monkeypatch.setattr(retrieve, "FEW", 3)
    try:
        found = retrieve.denied(df, ids)
        text = plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("SortMergeJoin") == 2 and {r.i for r in found.collect()} == few
