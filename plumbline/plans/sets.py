"""Set operations."""

from pyspark.sql import functions as F

from plumbline.functions.ids import short_sha1
from plumbline.plans import inputs
from plumbline.registry import query


@query("stale_ids", """
SELECT section_id FROM sections WHERE doc_id % 2 = 0 EXCEPT SELECT section_id FROM sections WHERE line_no % 3 <> 0
""", "sections")
def stale_ids(spark, d):
    s = inputs.sections(spark, d)
    return s.where("doc_id % 2 = 0").select("section_id").subtract(s.where("line_no % 3 <> 0").select("section_id"))


@query("numbering_gaps", """
SELECT rule_no, n FROM (SELECT l_orderkey AS rule_no, unnest(range(1, max(l_linenumber) + 1))::INTEGER AS n FROM lineitem GROUP BY 1)
EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem
""")
def numbering_gaps(spark, d):
    present = inputs.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rule_no"), F.col("l_linenumber").alias("n"))
    full = present.groupBy("rule_no").agg(F.max("n").alias("top")).select("rule_no", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("n"))
    return full.join(present, ["rule_no", "n"], "left_anti")


@query("eval_collect", """
SELECT id, arg_min(source, (rank, key)) AS source, arg_min(question, (rank, key)) AS question, bool_or(known) AS known FROM (
 SELECT substr(sha1(regexp_replace(question, '[^\\p{L}\\p{N}]+', '', 'g')), 1, 20) AS id, question, source, rank, key, known FROM (
  SELECT query_masked AS question, 'seed' AS source, 1 AS rank, turn_id AS key, false AS known FROM turns WHERE k % 5 = 0
  UNION ALL SELECT query_masked, 'unanswered', 2, turn_id, false FROM turns WHERE outcome = 'fallback' AND fallback_reason <> 'out_of_scope'
  UNION ALL SELECT query_masked, 'report', 3, turn_id, false FROM turns WHERE outcome = 'error'
  UNION ALL SELECT query_masked, 'known', 0, turn_id, true FROM turns WHERE k % 9 = 0)) GROUP BY id
""", "turns")
def eval_collect(spark, d):
    """Questions of all sources, one per normalised text; the first source wins, known rows stay."""
    turns = inputs.turns(spark, d)
    pick = lambda cond, source, rank: turns.where(cond).select(
        F.col("query_masked").alias("question"), F.lit(source).alias("source"), F.struct(F.lit(rank).alias("rank"), "turn_id").alias("at"), F.lit(rank == 0).alias("known")
    )
    rows = (
        pick("k % 9 = 0", "known", 0)
        .unionByName(pick("k % 5 = 0", "seed", 1))
        .unionByName(pick("outcome = 'fallback' AND fallback_reason <> 'out_of_scope'", "unanswered", 2))
        .unionByName(pick("outcome = 'error'", "report", 3))
    )
    key = short_sha1(F.regexp_replace("question", r"[^\p{L}\p{N}]+", ""), 20)
    return rows.groupBy(key.alias("id")).agg(
        F.min_by("source", "at").alias("source"), F.min_by("question", "at").alias("question"), F.bool_or("known").alias("known")
    )


@query("known_union", """
SELECT url FROM pages WHERE page_id % 3 = 0 UNION SELECT url FROM pages WHERE page_id % 2 = 0
""")
def known_union(spark, d):
    pages = inputs.wide(spark, d, "pages")
    return pages.where("page_id % 3 = 0").select("url").union(pages.where("page_id % 2 = 0").select("url")).distinct()


@query("source_selection", """
SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src3', 'nowhere') ORDER BY source
""")
def source_selection(spark, d):
    """The requested sources that exist, or every source when none of the requested ones does."""
    sources = inputs.wide(spark, d, "documents").select("source").distinct()
    wanted = sources.where(F.col("source").isin("src1", "src3", "nowhere"))
    default = sources.where(F.lit(wanted.isEmpty()))
    return wanted.union(default).orderBy("source")


@query("contact_pages_left", """
SELECT url FROM pages WHERE contains(url, '/en/') EXCEPT SELECT url FROM pages WHERE page_id % 4 = 0
""")
def contact_pages_left(spark, d):
    pages = inputs.wide(spark, d, "pages")
    return pages.where(F.col("url").contains("/en/")).select("url").subtract(pages.where("page_id % 4 = 0").select("url"))


@query("kinds_intersection", """
SELECT turn_id, array_to_string(list_sort(list_intersect(list(DISTINCT ['article', 'guide', 'notice', 'menu'][supp % 4 + 1]), ['calendar', 'notice', 'article'])), ',') AS kinds FROM facts GROUP BY turn_id
""", "facts")
def kinds_intersection(spark, d):
    kind = inputs.pick(("article", "guide", "notice", "menu"), F.col("supp") % 4)
    primary = F.array(*[F.lit(x) for x in ("calendar", "notice", "article")])
    kinds = F.sort_array(F.array_intersect(F.collect_set(kind), primary))
    return inputs.facts(spark, d).groupBy("turn_id").agg(F.array_join(kinds, ",").alias("kinds"))
