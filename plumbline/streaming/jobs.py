"""Streaming jobs: quality alerts, snapshots, rate limits, quotas, each run to the end of what has arrived."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from plumbline.operators.ranking import top_per_key
from plumbline.operators.turn_stats import quality_counts, quality_tier
from plumbline.session import scratch_dir

# fixed values: alert conditions and the request limit
DEADLINE_ALERT, ERROR_ALERT, SLOW_MS = 2, 5, 30_000
LATE_REASONS = ("deadline", "timeout")
RATE_LIMIT, RATE_SECONDS = 20, 60


def stream(spark: SparkSession, folder: str, file_pattern: str, schema) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_pattern).parquet(folder)


def run(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Process all that has arrived and read back the rows with the batch they came from.

    A batch writes its own folder, so a batch repeated after a failure replaces its rows.
    """
    root = scratch_dir(df.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    query = (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema.add("batch", "long")).parquet(f"{root}/rows")


def latest_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the last batch every key was written in."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")


def quality_windows(turns: DataFrame, size: str = "2 hours", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts and tier of sliding windows over a stream of turns."""
    counted = turns.withWatermark("created_at", late).groupBy(F.window("created_at", size, slide).alias("w")).agg(*quality_counts())
    return counted.select(F.col("w.start").alias("window_start"), "scoped", "bad", quality_tier(F.col("scoped"), F.col("bad")).alias("level"))


def _rolling(rows: DataFrame, rule: str, minutes: int, raised) -> DataFrame:
    """Instants at which a rolling window of the last minutes comes to raise an alert (and did not just before).

    Counts are added up per instant first.  The time line is cut into buckets as long as the window.  A bucket begins with all
    counts of the one before it, and each of them leaves when it is as old as the window, so a running sum is the window's
    count: a row is read three times, however many rows a window has.
    """
    width = minutes * 60_000_000
    instants = rows.groupBy(F.unix_micros("created_at").alias("_us")).agg(F.count("*").alias("n"), F.count(F.when(F.col("elapsed_ms") > SLOW_MS, 1)).alias("slow"))
    bucket = F.floor(F.col("_us") / width).cast("long")
    step = lambda b, at, sign: F.struct(b.alias("bucket"), at.alias("at"), F.lit(sign).alias("sign"), (b == bucket).alias("own"))
    steps = F.array(step(bucket, F.col("_us"), 1), step(bucket + 1, bucket * width, 1), step(bucket + 1, F.col("_us") + width, -1))
    held = instants.select("*", F.explode(steps).alias("b")).withColumns({c: F.col(c) * F.col("b.sign") for c in ("n", "slow")})
    run = Window.partitionBy("b.bucket").orderBy("b.at").rangeBetween(Window.unboundedPreceding, 0)
    counted = held.select("_us", F.col("b.own").alias("own"), "n", "slow", F.sum("n").over(run).alias("_n"), F.sum("slow").over(run).alias("_slow"))
    counted = counted.where("own").withColumns({"_now": raised(F.col("_n"), F.col("_slow")), "_before": raised(F.col("_n") - F.col("n"), F.col("_slow") - F.col("slow"))})
    return counted.where("_now AND NOT _before").select(F.lit(rule).alias("rule"), F.timestamp_micros("_us").alias("raised_at"), F.col("_n").alias("n"))


def quality_alerts(turns: DataFrame) -> DataFrame:
    """Alerts over turns (created_at, outcome, fallback_reason, elapsed_ms, job_failed) at the moment they are raised.

    Two deadlines or time-outs in 15 minutes, five server errors in 5, a p95 of more than 30 seconds in 10, and a failed
    job with none in the hour before.
    """
    at_least = lambda least: lambda n, slow: n >= least
    # the p95 is the row of rank floor(0.95 n), so it is slow if fewer fast rows than that are there
    slow_p95 = lambda n, slow: (n > 0) & (n - slow < F.greatest(F.floor(n * 0.95), F.lit(1)))
    return (
        _rolling(turns.where(F.col("fallback_reason").isin(*LATE_REASONS)), "deadline", 15, at_least(DEADLINE_ALERT))
        .unionByName(_rolling(turns.where("outcome = 'error'"), "server_error", 5, at_least(ERROR_ALERT)))
        .unionByName(_rolling(turns, "slow", 10, slow_p95))
        .unionByName(_rolling(turns.where("job_failed"), "job_failed", 60, at_least(1)))
    )


# ── snapshots kept by a stream ──────────────────────────────────────────────────────────────────────
def _versions(spark: SparkSession, root: str) -> list[int]:
    """Batches whose snapshot stands whole under the root."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(conf)
    found = store.listStatus(folder) if store.exists(folder) else []
    whole = [f.getPath() for f in found if store.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch=")) for p in whole)


def snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest whole snapshot under a root."""
    versions = _versions(spark, root)
    return spark.read.parquet(f"{root}/batch={versions[-1]}") if versions else None


def merge_batch(root: str, first: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that writes snapshot `batch=<id>` as the merge of the batch into the snapshot before it.

    A batch that comes again finds its own snapshot or a later one and changes nothing; one that broke off left no _SUCCESS
    and is written anew.  Snapshots older than the last `keep` are removed.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, root)
        if versions and versions[-1] >= batch_id:
            return
        before = spark.read.parquet(f"{root}/batch={versions[-1]}") if versions else first
        merge(before, batch).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for old in versions[: len(versions) + 1 - keep] if keep else []:
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/batch={old}")
            path.getFileSystem(conf).delete(path, True)

    return step


def merge_stream(seen: DataFrame, first: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], root: str) -> DataFrame:
    """Run a stream of rows into a snapshot to the end of what has arrived, and read the snapshot."""
    query = (
        seen.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(merge_batch(f"{root}/rows", first, merge)).start()
    )
    query.awaitTermination()
    made = snapshot(seen.sparkSession, f"{root}/rows")
    return first if made is None else made


# ── rate limit ───────────────────────────────────────────────────────────────────────────────────
def _accept(times: list[float], window: list[float]) -> list[bool]:
    """Which of the ordered hits are accepted, given the accepted hits still in the window."""
    out = []
    for t in times:
        while window and t - window[0] > RATE_SECONDS:
            window.pop(0)
        out.append(len(window) < RATE_LIMIT)
        if out[-1]:
            window.append(t)
    return out


def _limit_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    window = json.loads(state.get[0]) if state.exists else []
    hits = pd.concat(list(batches)).sort_values(["t", "event_id"])
    hits["accepted"] = _accept(hits["t"].tolist(), window)
    state.update((json.dumps(window),))
    yield hits[["event_id", "key", "accepted"]]


def rate_limit_stream(hits: DataFrame) -> DataFrame:
    """Hits (event_id, key, t in seconds) accepted at most 20 times in 60 seconds per key."""
    return hits.groupBy("key").applyInPandasWithState(
        _limit_state, "event_id long, key long, accepted boolean", "window string", "append", GroupStateTimeout.NoTimeout
    )


def rate_limit(hits: DataFrame) -> DataFrame:
    """The same over a table.

    A pause of more than 60 seconds empties the window, so a key falls apart into stretches that are
    judged on their own; and of hits at one instant only the first 20 can be accepted, so the rest
    never reach the fold.
    """
    instant = top_per_key(hits, ["key", "t"], [F.col("event_id")], RATE_LIMIT).drop("place")
    minutes = instant.groupBy("key", F.floor(F.col("t") / RATE_SECONDS).alias("_m")).agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    by_key = Window.partitionBy("key").orderBy("_m")
    gap = F.coalesce(F.col("_first") - F.lag("_last").over(by_key) > RATE_SECONDS, F.lit(True))
    stretches = minutes.withColumn("stretch", F.sum(gap.cast("int")).over(by_key)).select("key", "_m", "stretch")
    placed = instant.withColumn("_m", F.floor(F.col("t") / RATE_SECONDS)).join(stretches, ["key", "_m"]).drop("_m")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["t", "event_id"])
        return ordered.assign(accepted=_accept(ordered["t"].tolist(), []))[["event_id", "key", "accepted"]]

    judged = placed.groupBy("key", "stretch").applyInPandas(judge, "event_id long, key long, accepted boolean")
    return hits.select("event_id", "key").join(judged.select("event_id", "accepted"), "event_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


# ── quotas and replays ─────────────────────────────────────────────────────────────────────────────
def quota_stream(requests: DataFrame, limit: int) -> DataFrame:
    """Requests (event_id, day, key, ts) accepted up to the limit per day and key; counters live three days."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = pd.concat([b.nsmallest(limit, ["ts", "event_id"]) for b in batches]).nsmallest(max(limit - used, 0), ["ts", "event_id"])
        state.update((used + len(rows),))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 3 * 86_400_000)
        yield rows[["event_id", "day"]]

    timed = requests.withWatermark("ts", "3 days")
    return timed.groupBy("day", "key").applyInPandasWithState(count, "event_id long, day string", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def first_requests(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests with every (thread, request) once; a repetition within the lateness is a replay."""
    return requests.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["thread_id", "request_id"])
