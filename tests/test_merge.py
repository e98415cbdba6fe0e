"""Snapshots kept by a stream: batches that come again, and batches that broke off."""

from pyspark.sql import functions as F

from plumbline.operators import snapshots as sn
from plumbline.streaming import jobs


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "rows")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, title string, status string")
    now = F.lit("2026-06-01").cast("timestamp")
    first = rows((1, "a", "active"), (2, "b", "active")).select(
        "id", "title", "status", F.lit("").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("updated_at")
    )
    step = jobs.merge_batch(root, first, lambda before, batch: sn.event_upsert(before, batch, now))
    told = lambda: sorted((r.id, r.title, r.status) for r in jobs.snapshot(spark, root).collect())
    one, two = rows((2, "b2", "pending"), (3, "c", "pending")), rows((3, "c2", "pending"))
    step(one, 0)
    assert told() == [(1, "a", "active"), (2, "b2", "active"), (3, "c", "pending")]
    step(rows((9, "again", "pending")), 0)
    assert told() == [(1, "a", "active"), (2, "b2", "active"), (3, "c", "pending")]
    two.write.parquet(f"{root}/batch=1")  # a write that broke off before it was whole
    (tmp_path / "rows" / "batch=1" / "_SUCCESS").unlink()
    step(two, 1)
    assert told() == [(1, "a", "active"), (2, "b2", "active"), (3, "c2", "pending")]
    step(one, 0)
    assert told() == [(1, "a", "active"), (2, "b2", "active"), (3, "c2", "pending")]
