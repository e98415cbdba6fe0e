"""Graph and geometry queries."""

from pyspark.sql import functions as F

from plumbline.operators import graph as gr
from plumbline.plans import inputs
from plumbline.registry import query, sql_array, view


@query("link_frontier", r"""
WITH RECURSIVE edges AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS path FROM pages), both_ways AS (SELECT 'p' || page_id AS src, path AS dst FROM edges UNION SELECT path, 'p' || page_id FROM edges),
walk(node, depth) AS (SELECT 'p' || page_id, 0 FROM pages WHERE page_id % 25 = 0 UNION SELECT dst, depth + 1 FROM walk JOIN both_ways ON src = node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM walk GROUP BY node
""")
def link_frontier(spark, d):
    """Pages and link targets reached from the start pages over the stored links, four steps deep."""
    links = inputs.table(spark, d, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("page"), F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("path")
    ).distinct()
    edges = links.select(F.col("page").alias("src"), F.col("path").alias("dst")).unionByName(links.select(F.col("path").alias("src"), F.col("page").alias("dst")))
    starts = inputs.table(spark, d, "pages").where("page_id % 25 = 0").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("node"))
    return gr.link_frontier(edges, starts, 4)


def nation_edges(spark, d):
    """Edges between nations that trade and are close in number, weighted by the smallest quantity."""
    li, o = inputs.table(spark, d, "lineitem"), inputs.table(spark, d, "orders")
    c, su = inputs.table(spark, d, "customer"), inputs.table(spark, d, "supplier")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(su, F.col("l_suppkey") == F.col("s_suppkey"))
    near = F.abs(F.col("s_nationkey") - F.col("c_nationkey")).between(1, 2)
    return joined.where(near).groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(
        (F.min("l_quantity") + F.abs(F.col("s_nationkey") * 7 - F.col("c_nationkey") * 3) % 11).alias("weight")
    )


view("nation_edges", """
SELECT s_nationkey AS src, c_nationkey AS dst, min(l_quantity) + abs(s_nationkey * 7 - c_nationkey * 3) % 11 AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
WHERE abs(s_nationkey - c_nationkey) BETWEEN 1 AND 2 GROUP BY 1, 2
""")


@query("shortest_paths", """
WITH RECURSIVE walk(source, node, dist, hops) AS (SELECT n_nationkey, n_nationkey, 0.0::DOUBLE, 0 FROM nation
 UNION SELECT source, node, dist, hops FROM (SELECT w.source, e.dst AS node, min(w.dist + e.weight) AS dist, w.hops + 1 AS hops FROM walk w JOIN nation_edges e ON e.src = w.node WHERE w.hops < 24 GROUP BY w.source, e.dst, w.hops))
SELECT source, node, dist AS meters, cast(greatest(1, ceil(dist / 67)) AS INTEGER) AS minutes FROM (SELECT source, node, min(dist) AS dist FROM walk GROUP BY 1, 2)
""", "nation_edges")
def shortest_paths(spark, d):
    sources = inputs.table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    best = gr.shortest_paths(nation_edges(spark, d), sources)
    return best.select("source", "node", F.col("dist").alias("meters"), gr.walking_minutes(F.col("dist")).alias("minutes"))


# ── crawl ───────────────────────────────────────────────────────────────────────────────────────────
_CRAWL_DEPTH, _CRAWL_PAGES, _CRAWL_WORDS = 3, 400, ("tion", "ung", "ment", "est")
view("crawl_links", """
SELECT page_id AS src, (page_id * 5 + place * 13 + length(href)) % (SELECT count(*) FROM pages) AS dst, place, href AS text FROM (
 SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), 1) AS place FROM pages)
""")


def _level_sql(depth: int) -> str:
    earlier = " UNION ALL ".join(f"SELECT node FROM level{i}" for i in range(depth))
    taken = " + ".join(f"(SELECT count(*) FROM level{i})" for i in range(depth))
    return f"""level{depth} AS (SELECT node, n + {taken} AS rank, {depth} AS depth, text AS link_text FROM (
 SELECT *, row_number() OVER (ORDER BY rank, place, node) AS n FROM (SELECT l.dst AS node, l.place, l.text, p.rank FROM crawl_links l JOIN level{depth - 1} p ON p.node = l.src
  QUALIFY row_number() OVER (PARTITION BY l.dst ORDER BY p.rank, l.place) = 1) WHERE node NOT IN ({earlier})) WHERE n + {taken} <= {_CRAWL_PAGES})"""


_VISITED = f"""
WITH level0 AS (SELECT page_id AS node, row_number() OVER (ORDER BY page_id) AS rank, 0 AS depth, '' AS link_text FROM pages WHERE page_id % 50 = 0 QUALIFY rank <= {_CRAWL_PAGES}),
{', '.join(_level_sql(depth) for depth in range(1, _CRAWL_DEPTH + 1))},
visited AS ({' UNION ALL '.join(f'SELECT * FROM level{depth}' for depth in range(_CRAWL_DEPTH + 1))})
"""


def crawl(spark, d):
    """A crawl from every fiftieth page; a page's links lead to other stored pages, told by their place and address."""
    pages = inputs.table(spark, d, "pages")
    total = pages.agg(F.count("*").alias("n")).scalar()
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("at", "href"))
    place = (F.col("at") + 1).cast("long")
    links = links.select(F.col("page_id").alias("src"), ((F.col("page_id") * 5 + place * 13 + F.length("href")) % total).alias("dst"), place.alias("place"), F.col("href").alias("text"))
    starts = pages.where("page_id % 50 = 0").select(F.col("page_id").alias("node"), F.col("page_id").alias("place"))
    return gr.crawl_order(links, starts, _CRAWL_DEPTH, _CRAWL_PAGES)


@query("crawl_order", _VISITED + "SELECT * FROM visited", "crawl_links")
def crawl_order(spark, d):
    return crawl(spark, d)


@query("crawl_candidates", _VISITED + f"""
SELECT node, rank, depth, link_text, title, array_to_string(list_slice(words, 1, 5), ',') AS matched FROM (
 SELECT v.*, title, list_filter({sql_array(_CRAWL_WORDS)}, lambda w: contains(link_text || ' ' || title, w)) AS words FROM visited v JOIN (SELECT page_id, left(regexp_extract(html, '<title>([^<]*)', 1), 80) AS title FROM pages) ON page_id = node
 WHERE depth > 0 AND node % 9 <> 0) WHERE len(words) > 0
""", "crawl_links")
def crawl_candidates(spark, d):
    """Visited pages, not known yet, that tell by link or title that they are wanted."""
    pages = inputs.table(spark, d, "pages")
    titles = pages.select(F.col("page_id").alias("node"), F.left(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(80)).alias("title"))
    known = pages.where("page_id % 9 = 0").select(F.col("page_id").alias("node"))
    return gr.crawl_candidates(crawl(spark, d), titles, known, _CRAWL_WORDS).withColumn("matched", F.array_join("matched", ","))


# ── places and nodes ─────────────────────────────────────────────────────────────────────────────────
def points(spark, d):
    k = F.col("s_suppkey")
    return inputs.table(spark, d, "supplier").select(k.alias("point_id"), (k * 37 % 1000).cast("double").alias("px"), (k * 91 % 1000).cast("double").alias("py"))


def nodes(spark, d):
    k = F.col("c_custkey")
    return inputs.table(spark, d, "customer").select(k.alias("node_id"), (k * 53 % 1009).cast("double").alias("x"), (k * 97 % 1009).cast("double").alias("y"))


view("points", "SELECT s_suppkey AS point_id, (s_suppkey * 37 % 1000)::DOUBLE AS px, (s_suppkey * 91 % 1000)::DOUBLE AS py FROM supplier")
view("nodes", "SELECT c_custkey AS node_id, (c_custkey * 53 % 1009)::DOUBLE AS x, (c_custkey * 97 % 1009)::DOUBLE AS y FROM customer")


# ── routes ──────────────────────────────────────────────────────────────────────────────────────────
_SCALE = 0.5
view("path_nodes", "SELECT s_suppkey AS node_id, (s_suppkey * 53 % 1009)::DOUBLE AS x, (s_suppkey * 97 % 1009)::DOUBLE AS y FROM supplier")
view("path_places", "SELECT n_nationkey::BIGINT AS point_id, (n_nationkey * 137 % 1000)::DOUBLE AS px, (n_nationkey * 291 % 1000)::DOUBLE AS py FROM nation")
view("paths", """
SELECT *, sqrt((mx - ax) * (mx - ax) + (my - ay) * (my - ay)) AS len1, sqrt((bx - mx) * (bx - mx) + (by_ - my) * (by_ - my)) AS len2 FROM (
 SELECT b.node_id AS edge_id, a.node_id AS a, b.node_id AS b, a.x AS ax, a.y AS ay, (a.x + b.x) / 2 + b.node_id % 7 AS mx, (a.y + b.y) / 2 - b.node_id % 5 AS my, b.x AS bx, b.y AS by_
 FROM path_nodes b JOIN path_nodes a ON a.node_id = b.node_id // 3 WHERE b.node_id > 1
 UNION ALL SELECT 1000000000 + b.node_id, a.node_id, b.node_id, a.x, a.y, (a.x + b.x) / 2 + b.node_id % 7, (a.y + b.y) / 2 - b.node_id % 5, b.x, b.y FROM path_nodes b JOIN path_nodes a ON a.node_id = b.node_id - 1 WHERE b.node_id % 4 = 0)
""", ("path_nodes",))
view("snapped", """
SELECT *, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) AS off, CASE part WHEN 1 THEN sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) ELSE len1 + sqrt((qx - mx) * (qx - mx) + (qy - my) * (qy - my)) END AS to_a,
  CASE part WHEN 1 THEN sqrt((mx - qx) * (mx - qx) + (my - qy) * (my - qy)) + len2 ELSE sqrt((bx - qx) * (bx - qx) + (by_ - qy) * (by_ - qy)) END AS to_b
FROM (SELECT *, x0 + t * (x1 - x0) AS qx, y0 + t * (y1 - y0) AS qy FROM (
 SELECT *, CASE WHEN x0 = x1 AND y0 = y1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) END AS t
 FROM path_places, (SELECT *, 1 AS part, ax AS x0, ay AS y0, mx AS x1, my AS y1 FROM paths UNION ALL SELECT *, 2, mx, my, bx, by_ FROM paths)))
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY off, edge_id, part) = 1
""", ("path_places", "paths"))


def paths(spark, d):
    """Ways between nodes: a tree and some short cuts, each with one bend."""
    k = F.col("s_suppkey")
    nodes = inputs.table(spark, d, "supplier").select(k.alias("node_id"), (k * 53 % 1009).cast("double").alias("x"), (k * 97 % 1009).cast("double").alias("y"))
    a = nodes.select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    tree = b.where("b > 1").withColumns({"a": F.floor(F.col("b") / 3), "edge_id": F.col("b")})
    cuts = b.where("b % 4 = 0").withColumns({"a": F.col("b") - 1, "edge_id": F.col("b") + 1_000_000_000})
    rows = tree.unionByName(cuts).join(a, "a")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    c = F.col
    middle = point((c("ax") + c("bx")) / 2 + c("b") % 7, (c("ay") + c("by")) / 2 - c("b") % 5)
    return rows.select("edge_id", "a", "b", F.array(point(c("ax"), c("ay")), middle, point(c("bx"), c("by"))).alias("line"))


@query("routes", f"""
WITH RECURSIVE ends AS (
 SELECT s.point_id AS start, g.point_id AS goal, s.edge_id AS s_edge, g.edge_id AS g_edge, s.a AS sa, s.b AS sb, g.a AS ga, g.b AS gb, s.to_a AS s_to_a, s.to_b AS s_to_b, g.to_a AS g_to_a, g.to_b AS g_to_b, s.off + g.off AS off
 FROM snapped s JOIN snapped g ON g.point_id = s.point_id + 1
), ways AS (
 SELECT edge_id, a AS src, b AS dst, 0.0::DOUBLE + len1 + len2 AS weight FROM paths UNION ALL SELECT edge_id, b, a, 0.0::DOUBLE + len1 + len2 FROM paths
), walk(start, node, dist, walked, hops) AS (
 SELECT start, node, min(dist), [node], 0 FROM (SELECT start, sa AS node, s_to_a AS dist FROM ends UNION ALL SELECT start, sb, s_to_b FROM ends) GROUP BY 1, 2
 UNION ALL SELECT start, node, min(dist), arg_min(walked, dist), hops + 1 FROM (
  SELECT w.start, y.dst AS node, w.dist + y.weight AS dist, list_append(w.walked, y.dst) AS walked, w.hops FROM walk w JOIN ends e ON e.start = w.start JOIN ways y ON y.src = w.node AND y.edge_id <> e.s_edge AND y.edge_id <> e.g_edge
  WHERE w.hops < 24 AND NOT list_contains(w.walked, y.dst)) GROUP BY start, node, hops
), done AS (
 SELECT e.start, e.goal, e.off, w.dist + least(CASE WHEN w.node = ga THEN g_to_a END, CASE WHEN w.node = gb THEN g_to_b END) AS dist, w.walked FROM ends e JOIN walk w ON w.start = e.start AND w.node IN (ga, gb)
 UNION ALL SELECT start, goal, off, abs(s_to_a - g_to_a), [] FROM ends WHERE s_edge = g_edge
)
SELECT start, goal, round(min((off + dist) * {_SCALE}), 3) AS meters, cast(greatest(1, ceil(min((off + dist) * {_SCALE}) / 67)) AS INTEGER) AS minutes, array_to_string(arg_min(walked, (dist, len(walked))), '>') AS path FROM done GROUP BY 1, 2
""", ("snapped",))
def routes(spark, d):
    """Walks from every nation's place to the next one over ways between the suppliers' places."""
    k = F.col("n_nationkey").cast("long")
    wanted = inputs.table(spark, d, "nation").select(k.alias("point_id"), (k * 137 % 1000).cast("double").alias("px"), (k * 291 % 1000).cast("double").alias("py"))
    pairs = wanted.select(F.col("point_id").alias("start"), (F.col("point_id") + 1).alias("goal")).join(wanted.select(F.col("point_id").alias("goal")), "goal", "left_semi")
    found = gr.routes(pairs.withColumn("pair_id", F.col("start")), wanted, paths(spark, d), _SCALE, cell=256.0)
    return found.select("start", "goal", F.round("meters", 3).alias("meters"), "minutes", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("path"))


@query("prune_spurs")
def prune_spurs(spark, d):
    """Trade edges between customers and suppliers without their short dead ends."""
    li, o = inputs.table(spark, d, "lineitem"), inputs.table(spark, d, "orders")
    edges = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("b")
    ).agg(F.min("l_quantity").alias("length"))
    return gr.prune_spurs(edges)


@query("nearest_node", """
SELECT point_id, node_id, round(dist, 3) AS distance FROM (SELECT point_id, node_id, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS dist FROM points, nodes) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, node_id) = 1
""", ("points", "nodes"))
def nearest_node(spark, d):
    found = gr.nearest(points(spark, d), nodes(spark, d), ("x", "y"), ("x", "y"), gr.point_distance("x", "y"), "node_id", 8.0)
    return found.select("point_id", F.col("shape").alias("node_id"), F.round("distance", 3).alias("distance"))


@query("snap_to_segment", """
SELECT point_id, node_id AS segment_id, round(dist, 3) AS distance FROM (SELECT point_id, node_id, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) AS dist FROM (SELECT *, x + t * dx AS qx, y + t * dy AS qy FROM (
  SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - x) * dx + (py - y) * dy) / (dx * dx + dy * dy))) END AS t FROM (SELECT *, (node_id % 30)::DOUBLE AS dx, (node_id % 20)::DOUBLE AS dy FROM points, nodes))))
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, node_id) = 1
""", ("points", "nodes"))
def snap_to_segment(spark, d):
    segments = nodes(spark, d).select("node_id", "x", "y", (F.col("x") + F.col("node_id") % 30).alias("bx"), (F.col("y") + F.col("node_id") % 20).alias("by"))
    found = gr.nearest(points(spark, d), segments, ("x", "y"), ("bx", "by"), gr.segment_distance("x", "y", "bx", "by"), "node_id", 16.0)
    return found.select("point_id", F.col("shape").alias("segment_id"), F.round("distance", 3).alias("distance"))


_SUM = "sum({})::DOUBLE"


def _det(columns: list[tuple[str, str, str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = columns
    return f"({a} * ({e} * {i} - {f} * {h}) - {d} * ({b} * {i} - {c} * {h}) + {g} * ({b} * {f} - {c} * {e}))"


_NORMAL = [("uu", "uv", "u"), ("uv", "vv", "v"), ("u", "v", "n")]
_FIT = {
    f"{name}_to_{t}": f"{_det([(f'su{t}', f'sv{t}', f's{t}') if k == at else column for k, column in enumerate(_NORMAL)])} / {_det(_NORMAL)}"
    for t in ("x", "y") for at, name in enumerate(("lng", "lat", "one"))
}
# fixed precision of the comparison: coefficients and residuals are rounded to so many digits
_DIGITS = 4


@query("affine_fit", f"""
WITH points AS (SELECT x::DOUBLE AS lng, y::DOUBLE AS lat, (3 * x + y + node_id % 5)::DOUBLE AS tx, (2 * y - x)::DOUBLE AS ty FROM nodes),
sums AS (SELECT sum(lng * lng) AS uu, sum(lng * lat) AS uv, sum(lng) AS u, sum(lat * lat) AS vv, sum(lat) AS v, count(*)::DOUBLE AS n,
  sum(lng * tx) AS sux, sum(lat * tx) AS svx, sum(tx) AS sx, sum(lng * ty) AS suy, sum(lat * ty) AS svy, sum(ty) AS sy FROM points),
fit AS (SELECT {', '.join(f'{sql} AS {name}' for name, sql in _FIT.items())} FROM sums)
SELECT {', '.join(f'round(any_value({name}), {_DIGITS}) + 0.0 AS {name}' for name in _FIT)},
  round(median(sqrt(power(lng * lng_to_x + lat * lat_to_x + one_to_x - tx, 2) + power(lng * lng_to_y + lat * lat_to_y + one_to_y - ty, 2))), {_DIGITS}) AS residual
FROM points, fit
""", "nodes")
def affine_fit(spark, d):
    """The six coefficients of the map from node places to shifted ones, and the median of what is left."""
    rows = nodes(spark, d).select(F.col("x").alias("lng"), F.col("y").alias("lat"), (F.col("x") * 3 + F.col("y") + F.col("node_id") % 5).alias("x"), (F.col("y") * 2 - F.col("x")).alias("y"))
    fit = gr.affine_fit(rows)
    named = {f"{name}_to_{t}": float(fit[at][k]) for k, t in enumerate(("x", "y")) for at, name in enumerate(("lng", "lat", "one"))}
    left = F.round(F.median("residual"), _DIGITS).alias("residual")
    return gr.project(rows, fit).agg(*[(F.round(F.lit(v), _DIGITS) + F.lit(0.0)).alias(c) for c, v in named.items()], left)
