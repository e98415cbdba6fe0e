"""Mixing sources to target weights by systematic sampling.

Every document of a source has an expected number of copies.  Documents stand in a fixed order (by size
class, then by a digest of the id), expected copies are summed along it, one offset is added, and a document
is emitted once for each whole number that its step crosses.  Size classes stand together, so the words
taken stay close to the target.  The order is cut into slices of about `SLICE_ROWS` rows.  Sums run over the
classes of a source, then over the slices of a class, then over the rows of a slice, so a source with a third
of all rows is many tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut_lineage

#: Expected copies are counted in billionths, so that sums are whole numbers and reruns agree.
UNIT = 1_000_000_000
#: Rows of one size class of one source that a window orders at a time.
SLICE_ROWS = 200


def offset_of(seed: int) -> int:
    """The one offset of a mix, in units."""
    return int(hashlib.md5(f"mix-{seed}".encode()).hexdigest()[:12], 16) % UNIT


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Add `target` to one row per source (source, source_size).

    Sources in code point order, null last, take the weights in turn and share `share` of all sizes.  No
    target is above `most` times its source's size; the excess goes to the others by weight.  Sorted by
    size per weight, the sources that are full come first, so the level of the rest has a closed form.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(every) - 1) % len(weights)
    ranked = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    line = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(rest)
    ranked = ranked.withColumn("_level", level)
    open_ = F.when(F.col("_cap") / F.col("_weight") >= F.col("_level"), F.col("_level"))
    ranked = ranked.withColumn("_level", F.max(open_).over(whole))
    share_of = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap").cast("double")))
    return ranked.withColumn("target", share_of).drop("_weight", "_cap", "_level")


def size_class(size: Column) -> Column:
    """Digits of the size and its first two digits: grows with the size."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def copies(
    sized: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", tie: str | None = None,
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7,
) -> DataFrame:
    """Add `source_size`, `target` and `copies` to every row of a frame with a size per document.

    Null sources are one source, after all others.  A null size counts as 0; a source of size 0 has target 0
    and no copies.  Repeated rows are documents of their own.  `tie` names a column that orders rows of the
    same key.  An empty table gives an empty table; other columns are kept unless they start with `_mix`.  Only
    the table of classes is stored; whole rows are shuffled once, by slice.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rows = sized.withColumns({
        "_mix_s": F.coalesce(F.col(size), F.lit(0)).cast("long"), "_mix_src": F.col(source), "_mix_h": digest,
        "_mix_tie": F.col(tie) if tie else F.lit(""),
    })
    rows = rows.withColumn("_mix_class", size_class(F.col("_mix_s")))
    classes = cut_lineage(rows.groupBy("_mix_src", "_mix_class").agg(F.sum("_mix_s").alias("_mix_sum"), F.count("*").alias("_mix_n")))
    sources = targets(classes.groupBy(F.col("_mix_src").alias("source")).agg(F.sum("_mix_sum").alias("source_size")), weights, share, most)
    step = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")) * UNIT + F.lit(0.5)), F.lit(0)).cast("long")
    sources = sources.select(F.col("source").alias("_src"), "source_size", "target", step.alias("_mix_e"))
    earlier = Window.partitionBy("_mix_src").orderBy("_mix_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.join(sources, classes["_mix_src"].eqNullSafe(sources["_src"])).select(
        F.col("_mix_src").alias("_src"), F.col("_mix_class").alias("_class"), "source_size", "target", "_mix_e",
        F.coalesce(F.sum(F.col("_mix_n") * F.col("_mix_e")).over(earlier), F.lit(0)).alias("_mix_base"),
        F.ceil(F.col("_mix_n") / SLICE_ROWS).cast("long").alias("_mix_slices"),
    )
    placed = rows.join(classes, rows["_mix_src"].eqNullSafe(classes["_src"]) & (rows["_mix_class"] == classes["_class"])).drop("_src", "_class")
    high = F.conv(F.substring("_mix_h", 1, 7), 16, 10).cast("long")
    placed = placed.withColumn("_mix_slice", F.shiftright(high * F.col("_mix_slices"), 28)).drop("_mix_slices")
    slice_key = ["_mix_src", "_mix_class", "_mix_slice"]
    sums = placed.groupBy(*slice_key).agg(F.sum("_mix_e").alias("_mix_step"))
    before = Window.partitionBy("_mix_src", "_mix_class").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("_mix_src").alias("_src"), F.col("_mix_class").alias("_class"), F.col("_mix_slice").alias("_slice"),
        F.coalesce(F.sum("_mix_step").over(before), F.lit(0)).alias("_mix_before"),
    )
    own = Window.partitionBy(*slice_key).orderBy("_mix_h", F.col(key), "_mix_tie", "_mix_s").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_mix_sum", F.sum("_mix_e").over(own))
    joined = summed.join(
        sums,
        summed["_mix_src"].eqNullSafe(sums["_src"]) & (summed["_mix_class"] == sums["_class"]) & (summed["_mix_slice"] == sums["_slice"]),
    ).drop("_src", "_class", "_slice")
    end = F.col("_mix_base") + F.col("_mix_before") + F.col("_mix_sum") + F.lit(offset_of(seed))
    crossed = F.expr(f"(_mix_end div {UNIT}) - ((_mix_end - _mix_e) div {UNIT})")
    joined = joined.withColumn("_mix_end", end).withColumn("copies", crossed.cast("long"))
    return joined.drop(*[c for c in joined.columns if c.startswith("_mix")])


def mix(sized: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row of `copies` as often as it says."""
    drawn = copies(sized, **options)
    return drawn.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy")
