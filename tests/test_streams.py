"""Streams over several micro-batches: state, late rows, timers, replays."""

import datetime as dt

from plumbline.streaming import jobs, keyed

T0 = dt.datetime(2024, 1, 1)
at = lambda hours, minutes=0: T0 + dt.timedelta(hours=hours, minutes=minutes)


def batches(spark, folder, schema, *parts):
    """A stream that reads each part as a micro-batch of its own."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/part-{i}")
    frame = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return frame.parquet(str(folder))


VOTES = "event_id long, tip_id long, token long, net int, action string, ts timestamp, public_from timestamp, safety boolean"


def test_votes_over_batches_with_a_late_vote_and_an_approval_by_time(spark, tmp_path):
    def vote(i, tip, token, net, action, ts, safety=False):
        return (i, tip, token, net, action, ts, T0, safety)

    stream = batches(
        spark, tmp_path, VOTES,
        # three confirms of three networks on tips 1 and 2 (2 is a matter of safety); tip 3 gets flags later
        [vote(i * 10 + tip, tip, i, i, "confirm", at(1, i), tip == 2) for tip in (1, 2, 3) for i in range(3)] + [vote(99, 1, 9, 9, "dispute", at(2))],
        # a vote of voter 9 from before its dispute arrives late: nothing changes; a repeated confirm neither
        [vote(100, 1, 9, 9, "confirm", at(1, 55)), vote(101, 1, 0, 0, "confirm", at(2, 1)), vote(102, 3, 5, 1, "flag", at(3)), vote(103, 3, 6, 2, "flag", at(3))],
        # hours later others vote on tip 4 only: tip 1 is approved by time alone
        [vote(104, 4, 1, 1, "confirm", at(30))],
        # a third network flags tip 3: hidden, and stays so
        [vote(105, 3, 7, 3, "flag", at(31)), vote(106, 4, 2, 2, "confirm", at(31))],
        [vote(108, 3, 8, 4, "confirm", at(32)), vote(109, 4, 3, 3, "confirm", at(32)), vote(107, 5, 1, 1, "confirm", at(20))],
    )
    told = jobs.run(keyed.tip_votes(stream), "update", "votes")
    last = {r.tip_id: r for r in jobs.latest_batch(told, ["tip_id"]).collect()}
    assert (last[1].confirm, last[1].dispute, last[1].status) == (3, 1, "student_approved")
    assert (last[2].confirm, last[2].status) == (3, "verifying")
    assert (last[3].flags, last[3].confirm, last[3].status) == (3, 4, "hidden")
    assert last[4].status == "student_approved" and last[4].confirm == 3
    assert 5 not in last  # its only vote was older than the watermark
    by_batch = {(r.tip_id, r.batch): r.status for r in told.collect()}
    approved = min(b for (tip, b), s in by_batch.items() if tip == 1 and s == "student_approved")
    assert by_batch[(1, 0)] == by_batch[(1, 1)] == "verifying" and approved >= 2  # no vote on tip 1 came after batch 1


def test_rows_leave_state_and_result_when_their_lifetime_ends(spark, tmp_path):
    schema = "row_id long, class string, created_at timestamp"
    stream = batches(
        spark, tmp_path, schema,
        [(1, "thread", at(0)), (2, "thread", at(1)), (3, "quota", at(0)), (4, "nothing", at(0))],
        [(5, "quota", at(24, 30))], [(6, "quota", at(26))], [(7, "quota", at(73))],
    )
    told = jobs.run(keyed.lifetimes(stream), "append", "lifetimes").collect()
    kept = {r.row_id: r.batch for r in told if r.state == "kept"}
    gone = {r.row_id: r for r in told if r.state == "expired"}
    assert set(kept) == {1, 2, 3, 5, 6, 7} and kept[1] == kept[2] == 0
    assert set(gone) == {1, 2, 3} and len(told) == 9
    assert gone[1].batch < gone[2].batch < gone[3].batch and gone[1].expire_at == at(24)


def test_scans_are_tried_three_times_and_end_once(spark, tmp_path):
    schema = "event_id long, version long, url string, at timestamp, ok boolean"
    stream = batches(
        spark, tmp_path, schema,
        [(1, 1, "a", at(0), None), (2, 1, "b", at(0), None), (3, 1, "a", at(0, 5), None)],
        [(4, 1, "a", at(1), False), (5, 1, "b", at(1), False)],
        [(6, 1, "c", at(3), None)], [(15, 3, "z", at(3, 30), None)],
        [(7, 1, "a", at(4), False), (8, 1, "b", at(4), False)],
        [(9, 1, "c", at(6), True)], [(16, 3, "z", at(6, 30), True)],
        [(10, 1, "a", at(7), True), (11, 1, "b", at(7), False), (12, 1, "b", at(7, 1), True)],
        [(13, 1, "c", at(9), False), (14, 2, "a", at(9), None)],
    )
    told = jobs.run(keyed.scans(stream), "append", "scans").collect()
    of = lambda version, url: [(r.kind, r.attempt, r.failed) for r in sorted(told, key=lambda r: (r.due_at, r.attempt, r.batch)) if (r.version, r.url) == (version, url)]
    start = [("ask", 1, 0), ("waiting", 1, 1), ("ask", 2, 1), ("waiting", 2, 2), ("ask", 3, 2)]
    assert of(1, "a") == [*start, ("done", 3, 2)]
    assert of(1, "b") == [*start, ("given_up", 3, 3)]
    assert of(1, "c") == [("ask", 1, 0), ("done", 1, 0)] and of(2, "a") == [("ask", 1, 0)]
    assert {r.due_at for r in told if r.kind == "ask" and r.attempt == 2} == {at(1, 30)}
