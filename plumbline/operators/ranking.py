"""Ranks, look-backs and sessions that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from plumbline.session import cut_lineage


def sequence_number(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """row_number() per key without one task per key.

    Rows are range-partitioned by (key, order), so a hot key spans many partitions; each
    partition numbers its own rows and adds the sizes of the key's earlier partitions.  The
    placement is written to the checkpoint folder because both steps must see the same one.
    `order` has to be a total order.
    """
    placed = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(offsets, [*keys, "_part"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_part", "_local", "_offset")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key; the limit is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", rank).where(F.col("place") <= n)


def carried(rows: DataFrame, keys: list[str], order: str, values: list[str], block: int = 1_000, levels: int = 2) -> DataFrame:
    """Add `before_<value>`: the last value that is not null strictly before each row of its key.

    `order` is a whole number, unique per key.  Rows are cut into blocks of that many orders; the last values of every
    block come from an aggregate, are carried over the blocks in the same way (blocks of blocks), and only
    then inside the blocks.  No window holds more than a block, but the topmost, which has a row per block**levels orders.
    """
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if not levels:
        return rows.withColumns({f"before_{v}": F.last(v, ignorenulls=True).over(by) for v in values})
    part = f"_block{levels}"
    placed = rows.withColumn(part, F.floor(F.col(order) / block))
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    tails = carried(placed.groupBy(*keys, part).agg(*last), keys, part, values, block, levels - 1)
    tails = tails.select(*keys, part, *[F.col(f"before_{v}").alias(f"_far_{v}") for v in values])
    inside = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumns({f"_near_{v}": F.last(v, ignorenulls=True).over(inside) for v in values}).join(tails, [*keys, part])
    near = near.withColumns({f"before_{v}": F.coalesce(f"_near_{v}", f"_far_{v}") for v in values})
    return near.drop(part, *[f"_near_{v}" for v in values], *[f"_far_{v}" for v in values])


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, n: int, payload: Column) -> DataFrame:
    """Add `previous`, the payloads of the n rows before each row of its key, oldest first.

    The key is cut into ordered buckets.  Every bucket carries its last n payloads to the next
    ones, so that no window has to hold a whole key.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_payload", payload)
    by_bucket = Window.partitionBy(*keys, "_bucket")
    tail_rank = F.row_number().over(by_bucket.orderBy(*[F.desc(c) for c in order]))
    tails = (
        rows.select(*keys, "_bucket", *order, "_payload").withColumn("_r", tail_rank).where(F.col("_r") <= n)
        .groupBy(*keys, "_bucket")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col("_payload").alias("p")))).alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(-n, -1)
    carried = F.flatten(F.collect_list(F.transform("_tail", lambda t: t["p"])).over(earlier))
    tails = tails.select(*keys, "_bucket", carried.alias("_carried"))
    own = F.collect_list("_payload").over(by_bucket.orderBy(*order).rowsBetween(-n, -1))
    joined = rows.withColumn("_own", own).join(tails, [*keys, "_bucket"])
    both = F.concat("_carried", "_own")
    return joined.withColumn(
        "previous", F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n)
    ).drop("_bucket", "_payload", "_own", "_carried")


def gap_sessions(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Sessions of a key that end after 24 hours without a row.

    Rows of one day always share a session, so days are aggregated first and only day summaries
    are ordered per key.
    """
    days = df.groupBy(key, F.to_date(ts).alias("_day")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count("*").alias("_n")
    )
    by_key = Window.partitionBy(key).orderBy("_day")
    previous = F.lag("_last").over(by_key)
    starts = F.when(previous.isNull() | (F.col("_first") > previous + F.expr("INTERVAL 24 HOURS")), 1).otherwise(0)
    numbered = days.withColumn("_start", starts).withColumn("session", F.sum("_start").over(by_key))
    return numbered.groupBy(key, "session").agg(
        F.min("_first").alias("started_at"), F.max("_last").alias("ended_at"), F.sum("_n").alias("rows")
    )


def daily_quota(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of every (day, key) are accepted."""
    return top_per_key(df, keys, order, limit).drop("place")


def joint_quota(df: DataFrame, day: str, key: str, order: list[Column], per_key: int, overall: int) -> DataFrame:
    """Accepted only while both the key's and the day's quota have room; refusals use nothing up.

    Exact in two passes: the day's quota only ever closes, so it counts the rows the key's quota
    let through.
    """
    return daily_quota(daily_quota(df, [day, key], order, per_key), [day], order, overall)


def round_robin(df: DataFrame, query: str, kind_order: str, score_rank: str, item: str, k: int) -> DataFrame:
    """Interleave the ranked lists of several kinds, skipping items already taken, cut at k.

    `score_rank` is the item's place in its own list.
    """
    position = F.struct(score_rank, kind_order)
    first = df.groupBy(query, item).agg(F.min(position).alias("_at"))
    return top_per_key(first, [query], [F.col("_at"), F.col(item)], k).select(query, item, "place")


def first_key_last_value(df: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """Merge by key as a dictionary does: the position of the first row, the value of the last."""
    return df.groupBy(key).agg(F.min(order).alias("position"), F.max_by(value, order).alias(value))


def _lanes(batches: Iterator[pa.RecordBatch], week: str, c0: str, c1: str) -> Iterator[pa.RecordBatch]:
    """Bars sorted by (week, c0, order) with their lane; only the last day of every lane of one week is held."""
    now, ends, size, free = None, np.empty(0, dtype=np.int8), 0, np.empty(0, dtype=np.int64)
    for batch in batches:
        weeks, starts, lasts = batch.column(week), *(batch.column(c).to_numpy().astype(np.int8) for c in (c0, c1))
        turns = weeks.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(turns) != 0) | (np.diff(starts) != 0)) + 1
        lane = np.empty(batch.num_rows, dtype=np.int64)
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b == a:
                continue
            day = (weeks[int(a)], starts[a])
            if now is None or day[0] != now[0]:
                size = 0
            if day != now:  # lanes whose last bar ended before this day, lowest first
                now, free = day, np.flatnonzero(ends[:size] < day[1])
            old = min(len(free), b - a)
            lane[a : a + old], free = free[:old], free[old:]
            lane[a + old : b] = np.arange(size, size + b - a - old)
            size += b - a - old
            if size > len(ends):
                ends = np.concatenate([ends, np.empty(max(size - len(ends), len(ends)), dtype=np.int8)])
            ends[lane[a:b]] = lasts[a:b]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lane)], [*batch.schema.names, "lane"])


def interval_lanes(bars: DataFrame, week: str, c0: str, c1: str, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """First-fit lane of every bar of a week, bars taken in (c0, order); `keep` names the columns to return, else all.

    Bars that start on a day take, in order, the lanes no earlier bar still covers, then new ones.  Each bar's lane
    depends on all before it, so a week is one sorted stream through one task: its rows are shuffled and sorted
    once, and memory holds nine bytes per lane, not the rows.
    """
    rows = bars.repartition(week).sortWithinPartitions(week, c0, *order).select(*(keep or bars.columns))
    return rows.mapInArrow(lambda batches: _lanes(batches, week, c0, c1), StructType([*rows.schema.fields, StructField("lane", LongType())]))
