"""Graphs as edge tables: levels, shortest paths, pruning, nearest geometry, affine fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranking import sequence_number
from plumbline.session import cut_lineage, stored

# fixed values: walking speed and the shortest edge a dead end may have
METERS_PER_MINUTE, MIN_SPUR = 67.0, 10.0


def link_frontier(edges: DataFrame, starts: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """Nodes reached from the starts with the depth they are first reached at.

    `max_nodes` stops the walk in node order within a level, as a crawl's page budget does.
    """
    reached = cut_lineage(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    level = reached
    for depth in range(1, max_depth + 1):
        step = edges.join(level.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        level = step.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth))
        if max_nodes is not None:
            room = max_nodes - reached.count()
            level = level.orderBy("node").limit(max(room, 0))
        level = cut_lineage(level)
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Distance and predecessor of every (source, node), by relaxing the nodes changed last.

    Ends when a round improves nothing.  Edges are (src, dst, weight), walked in the given direction.
    """
    edges = stored(edges)  # every round reads them: what they are made from is read once
    best = stored(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"), F.col("node").alias("prev")))
    changed = best
    while not changed.isEmpty():
        moves = changed.join(edges, F.col("node") == F.col("src")).select(
            "source", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("prev")
        )
        offered = moves.groupBy("source", "node").agg(F.min(F.struct("dist", "prev")).alias("m")).select("source", "node", "m.dist", "m.prev")
        known = best.select("source", "node", F.col("dist").alias("_known"))
        changed = stored(
            offered.join(known, ["source", "node"], "left").where(F.col("_known").isNull() | (F.col("dist") < F.col("_known"))).drop("_known")
        )
        best = stored(best.join(changed, ["source", "node"], "left_anti").unionByName(changed))
    return best


def crawl_order(links: DataFrame, starts: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """Pages in the order a breadth-first crawl visits them: (node, rank, depth, link_text).

    `links` is (src, dst, place, text), `starts` (node, place).  The queue is ordered by the rank of the page that names a link, then by
    the place of the link on it; a page named several times is visited where it is named first.  The walk ends after
    `max_pages` pages, in queue order.  Each level is one shuffle by address and one range sort of its new pages.
    """
    first = sequence_number(starts.groupBy("node").agg(F.min("place").alias("_place")), [], [F.col("_place"), F.col("node")], "rank")
    level = cut_lineage(first.where(F.col("rank") <= max_pages).select("node", F.col("rank").cast("long").alias("rank"), F.lit(0).alias("depth"), F.lit("").alias("link_text")))
    reached, done = level, level.count()
    for depth in range(1, max_depth + 1):
        if done >= max_pages:
            break
        named = links.join(level.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.min(F.struct("rank", "place", "text")).alias("_first")
        )
        fresh = named.join(reached.select("node"), "node", "left_anti").select("node", "_first.*")
        order = sequence_number(fresh, [], [F.col("rank"), F.col("place"), F.col("node")], "_n").where(F.col("_n") <= max_pages - done)
        level = cut_lineage(order.select("node", (F.col("_n") + done).cast("long").alias("rank"), F.lit(depth).alias("depth"), F.col("text").alias("link_text")))
        found = level.count()
        if not found:
            break
        reached, done = reached.unionByName(level), done + found
    return reached


def crawl_candidates(visited: DataFrame, titles: DataFrame, known: DataFrame, words: tuple[str, ...], most: int = 5) -> DataFrame:
    """Pages of a crawl below its starts, not known yet, whose link text or title has one of the words: with the first few of them."""
    rows = visited.where("depth > 0").join(titles, "node").join(known.select("node"), "node", "left_anti")
    said = F.concat_ws(" ", F.nullif("link_text", F.lit("")), F.nullif("title", F.lit("")))
    matched = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(said, w))
    return rows.select("node", "rank", "depth", "link_text", "title", F.slice(matched, 1, most).alias("matched")).where(F.size("matched") > 0)


def walking_minutes(meters: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(meters / METERS_PER_MINUTE)).cast("int")


def prune_spurs(edges: DataFrame, min_length: float = MIN_SPUR) -> DataFrame:
    """Drop dead-end edges shorter than the limit until none is left; edges are (a, b, length)."""
    kept = cut_lineage(edges)
    while True:
        ends = kept.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        single = ends.where("degree = 1").select("node")
        short = kept.where(F.col("length") < min_length)
        spurs = short.join(single, F.col("a") == F.col("node"), "left_semi").unionByName(
            short.join(single, F.col("b") == F.col("node"), "left_semi")
        ).distinct()
        spurs = cut_lineage(spurs)
        if spurs.isEmpty():
            return kept
        kept = cut_lineage(kept.join(spurs.select("a", "b", "length"), ["a", "b", "length"], "left_anti"))


def nearest(
    points: DataFrame, shapes: DataFrame, low: tuple[str, str], high: tuple[str, str], distance: Column, shape_id: str, cell: float
) -> DataFrame:
    """Nearest shape of every (point_id, px, py) with its distance, ties to the smaller id.

    Shapes lie in the box from `low` to `high` (column names).  Points meet the shapes of the cells
    around their own; a best distance within one cell is final, and the rest go on with cells twice
    the size.  Points at one place are one question, and of shapes in one place only the smallest id can be an answer.
    """
    form = [c for c in shapes.columns if c != shape_id]
    shapes = cut_lineage(shapes.groupBy(*form).agg(F.min(shape_id).alias(shape_id)))
    asking = points
    points = cut_lineage(points.groupBy("px", "py").agg(F.min("point_id").alias("point_id")))
    back = lambda done: asking.select("point_id", "px", "py").join(points.join(done, "point_id").drop("point_id"), ["px", "py"]).drop("px", "py")
    extent = points.agg(F.max(F.greatest(F.abs("px"), F.abs("py"))).alias("m")).unionByName(
        shapes.agg(F.max(F.greatest(*[F.abs(c) for c in (*low, *high)])).alias("m"))
    ).agg(F.max("m")).first()[0]
    at = lambda c: F.floor(F.col(c) / F.lit(cell))
    done, left = None, points
    while True:
        around = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))
        asked = left.select("*", around("px").alias("_x")).select("*", around("py").alias("_y"))
        spread_x = shapes.select("*", F.explode(F.sequence(at(low[0]), at(high[0]))).alias("_x"))
        placed = spread_x.select("*", F.explode(F.sequence(at(low[1]), at(high[1]))).alias("_y"))
        pairs = asked.join(placed, ["_x", "_y"]).select("point_id", F.struct(distance.alias("distance"), F.col(shape_id).alias("shape")).alias("_m"))
        best = pairs.groupBy("point_id").agg(F.min("_m").alias("_m")).select("point_id", "_m.shape", "_m.distance")
        whole = cell > 2 * extent + 1
        final = best if whole else best.where(F.col("distance") <= cell)
        final = cut_lineage(final)
        done = final if done is None else done.unionByName(final)
        if whole:
            return back(done)
        left = cut_lineage(left.join(final.select("point_id"), "point_id", "left_anti"))
        if left.isEmpty():
            return back(done)
        cell *= 2


def point_distance(x: str, y: str) -> Column:
    return F.sqrt((F.col("px") - F.col(x)) * (F.col("px") - F.col(x)) + (F.col("py") - F.col(y)) * (F.col("py") - F.col(y)))


def segment_distance(ax: str, ay: str, bx: str, by: str) -> Column:
    """Distance of (px, py) to the segment a-b."""
    c = F.col
    dx, dy = c(bx) - c(ax), c(by) - c(ay)
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c("px") - c(ax)) * dx + (c("py") - c(ay)) * dy) / F.when(length != 0, length)))
    )
    qx, qy = c(ax) + t * dx, c(ay) + t * dy
    return F.sqrt((c("px") - qx) * (c("px") - qx) + (c("py") - qy) * (c("py") - qy))


# ── routes ────────────────────────────────────────────────────────────────────────────────────────
#: The end of a route stands as a node of its own.
END = -1


def _apart(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def line_length(line: Column) -> Column:
    """Length of an array of points (x, y)."""
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), _apart)
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def snap(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """Nearest place on any edge (edge_id, a, b, line) for (point_id, px, py): the line from a to it (`head`) and from it to b (`tail`)."""
    corner = lambda i: F.element_at("line", i)
    parts = edges.select("edge_id", "line", F.explode(F.sequence(F.lit(1), F.size("line") - 1)).alias("at"))
    parts = parts.select(F.struct("edge_id", "at").alias("part"), corner(F.col("at")).alias("p"), corner(F.col("at") + 1).alias("q"))
    flat = parts.select("part", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))
    boxed = flat.withColumns({"lx": F.least("ax", "bx"), "ly": F.least("ay", "by"), "hx": F.greatest("ax", "bx"), "hy": F.greatest("ay", "by")})
    found = nearest(points, boxed, ("lx", "ly"), ("hx", "hy"), segment_distance("ax", "ay", "bx", "by"), "part", cell)
    rows = found.select("point_id", "distance", F.col("shape.edge_id").alias("edge_id"), F.col("shape.at").alias("at")).join(points, "point_id").join(edges, "edge_id")
    p, q, c = corner(F.col("at")), corner(F.col("at") + 1), F.col
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c("px") - p["x"]) * dx + (c("py") - p["y"]) * dy) / F.when(square != 0, square))))
    rows = rows.withColumn("foot", F.array(F.struct((p["x"] + t * dx).alias("x"), (p["y"] + t * dy).alias("y"))))
    head = F.concat(F.slice("line", 1, c("at")), "foot")
    tail = F.concat("foot", F.slice("line", c("at") + 1, F.size("line")))
    rows = rows.select("point_id", "px", "py", "edge_id", "a", "b", "distance", head.alias("head"), tail.alias("tail"))
    return rows.withColumns({"to_a": line_length(c("head")), "to_b": line_length(c("tail"))})


def routes(pairs: DataFrame, points: DataFrame, edges: DataFrame, scale: float, cell: float = 16.0) -> DataFrame:
    """Shortest walk of every pair (pair_id, start, goal) over edges walked both ways: meters, minutes, nodes, line.

    Start and goal are points; each is joined to the nearest place of an edge, which splits that edge for its pair.  All pairs are
    relaxed together, each round only from nodes that got better and no further than the pair's best walk so
    far; the nodes of a walk are found by doubling steps back.  `scale` is meters per unit.  A pair without a walk has no row.
    """
    used = pairs.select(F.explode(F.array("start", "goal")).alias("point_id")).distinct()
    placed = stored(snap(points.join(used, "point_id", "left_semi"), edges, cell))
    end = lambda name, side: placed.select(F.col("point_id").alias(name), *[F.col(c).alias(f"{side}_{c}") for c in ("px", "py", "edge_id", "a", "b", "distance", "head", "tail", "to_a", "to_b")])
    ends = stored(pairs.join(end("start", "s"), "start").join(end("goal", "g"), "goal"))
    c = F.col
    length = line_length(c("line"))
    ways = edges.select("edge_id", c("a").alias("src"), c("b").alias("dst"), length.alias("weight"))
    ways = stored(ways.unionByName(ways.select("edge_id", c("dst").alias("src"), c("src").alias("dst"), "weight")))
    goal = ends.select("pair_id", "s_edge_id", "g_edge_id", "g_a", "g_b", "g_to_a", "g_to_b")
    step = lambda node, dist, when=None: F.when(F.lit(True) if when is None else when, F.struct(node.cast("long").alias("node"), dist.alias("dist")))
    begins = F.array(
        step(c("s_a"), c("s_to_a")), step(c("s_b"), c("s_to_b")), step(F.lit(END), F.abs(c("s_to_a") - c("g_to_a")), c("s_edge_id") == c("g_edge_id")),
    )
    begun = ends.select("pair_id", F.explode(F.filter(begins, lambda s: s.isNotNull())).alias("s")).groupBy("pair_id", c("s.node").alias("node")).agg(F.min("s.dist").alias("dist"))
    nothing = F.lit(None).cast("long")
    best = stored(begun.select("pair_id", "node", "dist", F.lit(True).alias("fresh"), nothing.alias("prev"), nothing.alias("via")))
    while True:
        limit = best.where(c("node") == END).select("pair_id", c("dist").alias("_limit"))
        moving = best.where(c("fresh") & (c("node") != END)).join(limit, "pair_id", "left").where(c("_limit").isNull() | (c("dist") < c("_limit")))
        if moving.isEmpty():
            break
        moving = moving.select("pair_id", c("node").alias("_from"), "dist").join(goal, "pair_id")
        walked = moving.join(ways, c("_from") == c("src")).where((c("edge_id") != c("s_edge_id")) & (c("edge_id") != c("g_edge_id"))).select(
            "pair_id", c("dst").cast("long").alias("node"), (c("dist") + c("weight")).alias("dist"), F.lit(True).alias("fresh"), c("_from").alias("prev"), c("edge_id").cast("long").alias("via")
        )
        at_goal = F.filter(F.array(F.when(c("_from") == c("g_a"), c("g_to_a")), F.when(c("_from") == c("g_b"), c("g_to_b"))), lambda x: x.isNotNull())
        arrived = moving.where(F.size(at_goal) > 0).select("pair_id", F.lit(END).cast("long").alias("node"), (c("dist") + F.array_min(at_goal)).alias("dist"), F.lit(True).alias("fresh"), c("_from").alias("prev"), nothing.alias("via"))
        # what was known before wins where it is as short, and is no longer fresh
        offered = best.withColumn("fresh", F.lit(False)).unionByName(walked).unionByName(arrived)
        best = stored(offered.groupBy("pair_id", "node").agg(F.min(F.struct("dist", "fresh", "prev", "via")).alias("m")).select("pair_id", "node", "m.*"))
    return _walks(best, ends, edges, scale)


def _walks(best: DataFrame, ends: DataFrame, edges: DataFrame, scale: float) -> DataFrame:
    """Nodes and line of every pair's walk from the predecessors that relaxation left."""
    c = F.col
    jumps, hop = [], best.where("prev is not null").select("pair_id", "node", c("prev").alias("back"))
    while not hop.isEmpty():
        hop = stored(hop)
        jumps.append(hop)
        hop = hop.join(hop.select("pair_id", c("node").alias("back"), c("back").alias("_next")), ["pair_id", "back"]).select("pair_id", "node", c("_next").alias("back"))
    passed = best.where(c("node") == END).select("pair_id", "node", F.lit(0).alias("behind"))
    for k in range(len(jumps) - 1, -1, -1):
        earlier = passed.join(jumps[k], ["pair_id", "node"]).select("pair_id", c("back").alias("node"), (c("behind") + (1 << k)).alias("behind"))
        passed = stored(passed.unionByName(earlier))
    steps = passed.join(best.select("pair_id", "node", "dist", "prev", "via"), ["pair_id", "node"])
    turned = lambda line, forward: F.when(forward, line).otherwise(F.reverse(line))
    rows = steps.join(ends.select("pair_id", "s_edge_id", "s_a", "s_head", "s_tail", "g_edge_id", "g_a", "g_to_a", "g_to_b", "g_head", "g_tail"), "pair_id")
    rows = rows.join(edges.select(c("edge_id").cast("long").alias("via"), c("a").alias("_a"), "line"), "via", "left")
    out = F.when(c("node") == c("s_a"), F.reverse("s_head")).otherwise(c("s_tail"))
    into = F.when(c("prev") == c("g_a"), c("g_head")).otherwise(F.reverse("g_tail"))
    part = (
        F.when(c("prev").isNull() & (c("node") == END), F.array(F.element_at("s_head", -1), F.element_at("g_head", -1)))
        .when(c("prev").isNull(), out).when(c("node") == END, into).otherwise(turned(c("line"), c("_a") == c("prev")))
    )
    walk = rows.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.struct((-c("behind")).alias("at"), "node", part.alias("part")))).alias("w"), F.max(F.when(c("node") == END, c("dist"))).alias("dist")
    )
    told = walk.join(ends.select("pair_id", "start", "goal", *[f"{s}_{x}" for s in "sg" for x in ("px", "py", "distance")]), "pair_id")
    meters = (c("s_distance") + c("dist") + c("g_distance")) * scale
    here = lambda s: F.array(F.struct(c(f"{s}_px").alias("x"), c(f"{s}_py").alias("y")))
    return told.select(
        "pair_id", "start", "goal", meters.alias("meters"), walking_minutes(meters).alias("minutes"),
        F.transform(F.filter("w", lambda x: x["node"] != END), lambda x: x["node"]).alias("nodes"),
        F.concat(here("s"), F.flatten(F.transform("w", lambda x: x["part"])), here("g")).alias("line"),
    )


def affine_inverse(coefficients: np.ndarray) -> np.ndarray:
    """3 x 2 map of (x, y, 1) back to (lng, lat)."""
    turn, shift = coefficients[:2], coefficients[2]
    back = np.linalg.inv(turn)
    return np.vstack([back, -shift @ back])


def affine_fit(points: DataFrame) -> np.ndarray:
    """3 x 2 least-squares map of (lng, lat, 1) to (x, y); the sums come from one aggregate."""
    terms = {"u": F.col("lng"), "v": F.col("lat"), "o": F.lit(1.0)}
    names = list(terms)
    sums = {f"{a}{b}": F.sum(terms[a] * terms[b]) for i, a in enumerate(names) for b in names[i:]}
    sums |= {f"{a}_{t}": F.sum(terms[a] * F.col(t)) for a in names for t in ("x", "y")}
    row = points.agg(*[e.cast("double").alias(k) for k, e in sums.items()]).first()
    normal = np.array([[row[f"{a}{b}"] if f"{a}{b}" in sums else row[f"{b}{a}"] for b in names] for a in names])
    right = np.array([[row[f"{a}_{t}"] for t in ("x", "y")] for a in names])
    return np.linalg.solve(normal, right)


def project(points: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """Points with their fitted place (fx, fy) and the residual."""
    (a, b), (c, d), (e, f) = coefficients.tolist()
    fx = F.col("lng") * a + F.col("lat") * c + e
    fy = F.col("lng") * b + F.col("lat") * d + f
    rows = points.withColumn("fx", fx).withColumn("fy", fy)
    return rows.withColumn("residual", F.hypot(F.col("fx") - F.col("x"), F.col("fy") - F.col("y")))
