"""Streams whose keys hold state with timers: votes on a tip, rows with a lifetime, scans that are tried again.

Every processor keeps single values and maps in the state store and touches only the entries its rows
name, so a key's state is never read or written whole.  Timers run on event time: they fire when the watermark has
passed them, also in batches without a row of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from plumbline.functions import rules

HOUR_MS = 3_600_000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(df: DataFrame, keys: list[str], processor: StatefulProcessor, output: str, mode: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=output, outputMode=mode, timeMode="EventTime")


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


# ── votes ────────────────────────────────────────────────────────────────────────────────────────
VERDICT = "tip_id long, confirm long, dispute long, flags long, status string, contested boolean, burst_risk boolean, flag_review boolean"


class _Nets:
    """Running counts of one side by network: how many networks, and the largest, without recounting votes."""

    def __init__(self) -> None:
        self.count: dict[int, int] = {}

    def add(self, net: int, by: int) -> None:
        self.count[net] = self.count.get(net, 0) + by
        if not self.count[net]:
            del self.count[net]

    def share(self, whole: int, *others: _Nets) -> float:
        nets = set(self.count).union(*[o.count for o in others])
        return max(sum(n.count.get(k, 0) for n in (self, *others)) for k in nets) / whole if nets else 0.0


class TipVotes(StatefulProcessor):
    """Votes of a tip in the order they arrive: hiding, burst risk and approval stay once reached.

    A voter counts once per side and flags once; an older vote that arrives late does not replace a newer one of its
    voter.  At 24 hours after publication the tip is judged again even if nobody votes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tip = handle.getValueState("tip", "status string, contested boolean, burst boolean, review boolean, safety boolean, due long, aged boolean")
        self.ballots = handle.getMapState("ballots", "token string", "action string, net long, at long, event long")
        self.flagged = handle.getMapState("flagged", "token string", "net long")
        self.nets = handle.getMapState("nets", "net long", "confirm long, dispute long, flags long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        votes = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        if self.tip.exists():
            self._load(self.tip.get())
        else:
            due = _ms(votes["public_from"].iloc[0]) + rules.MIN_PUBLIC_HOURS * HOUR_MS
            self._load(("verifying", False, False, False, bool(votes["safety"].iloc[0]), due, False))
            self.handle.registerTimer(due)
        for vote in votes.itertuples(index=False):
            if not self.aged and _ms(vote.ts) >= self.due:
                self._age()
            if self._take(vote):
                self._judge(_ms(vote.ts) >= self.due)
        yield self._store(key)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load(self.tip.get())
        if not self.aged:
            self._age()
            yield self._store(key)

    def close(self) -> None:
        pass

    def _load(self, tip: tuple) -> None:
        self.status, self.contested, self.burst, self.review, self.safety, self.due, self.aged = tip
        self.sides = {"confirm": _Nets(), "dispute": _Nets(), "flag": _Nets()}
        for (net,), counts in self.nets.iterator():
            for side, n in zip(self.sides.values(), counts, strict=True):
                if n:
                    side.count[net] = n
        self.total = {name: sum(side.count.values()) for name, side in self.sides.items()}
        self.changed: set[int] = set()

    def _age(self) -> None:
        self.aged = True
        self._judge(True)

    def _count(self, side: str, net: int, by: int) -> None:
        self.sides[side].add(net, by)
        self.total[side] += by
        self.changed.add(net)

    def _take(self, vote) -> bool:
        """Count a vote; false if it changes nothing."""
        token, net = (str(vote.token),), int(vote.net)
        if vote.action == "flag":
            if self.flagged.containsKey(token):
                return False
            self.flagged.updateValue(token, (net,))
            self._count("flag", net, 1)
            return True
        at, event = vote.ts.value // 1000, int(vote.event_id)
        if self.ballots.containsKey(token):
            action, before, then, number = self.ballots.getValue(token)
            if action == vote.action or (at, event) < (then, number):
                return False
            self._count(action, before, -1)
        self.ballots.updateValue(token, (vote.action, net, at, event))
        self._count(vote.action, net, 1)
        return True

    def _judge(self, old_enough: bool) -> None:
        confirm, dispute, flags = (self.sides[s] for s in ("confirm", "dispute", "flag"))
        n_confirm, n_dispute, n_flags = (self.total[s] for s in ("confirm", "dispute", "flag"))
        total = n_confirm + n_dispute
        if n_flags >= rules.FLAGS_TO_HIDE and self.status in ("verifying", "student_approved", "approved"):
            if len(flags.count) >= rules.FLAG_NETS_TO_HIDE:
                self.status = "hidden"
                return
            self.review = True
        majority = total >= rules.MIN_VOTES and n_dispute / total > rules.CONTEST_RATIO
        diverse = len(dispute.count) >= rules.FLAG_NETS_TO_HIDE and dispute.share(n_dispute) <= rules.MAX_NET_SHARE
        self.contested = majority and diverse
        self.burst = self.burst or (majority and not diverse)
        if self.status != "verifying" or self.safety or self.contested or self.burst or n_flags or not old_enough:
            return
        if total < rules.MIN_VOTES or n_confirm / total < rules.MIN_CONFIRM_RATIO:
            return
        if confirm.share(total, dispute) > rules.MAX_NET_SHARE:
            self.burst = True
        else:
            self.status = "student_approved"

    def _store(self, key) -> pd.DataFrame:
        for net in self.changed:
            counts = tuple(side.count.get(net, 0) for side in self.sides.values())
            if any(counts):
                self.nets.updateValue((net,), counts)
            else:
                self.nets.removeKey((net,))
        self.tip.update((self.status, self.contested, self.burst, self.review, self.safety, self.due, self.aged))
        n_confirm, n_dispute, n_flags = self.total.values()
        return pd.DataFrame([(key[0], n_confirm, n_dispute, n_flags, self.status, self.contested, self.burst, self.review)], columns=[
            "tip_id", "confirm", "dispute", "flags", "status", "contested", "burst_risk", "flag_review",
        ])


def tip_votes(votes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Verdict of every tip whenever it may have changed.

    Needs tip_id, token, net, action, ts, event_id, public_from and safety.  Votes later than `late` are dropped.
    """
    needed = votes.select(F.col("tip_id").cast("long").alias("tip_id"), F.col("token").cast("string").alias("token"), "net", "action", "ts", "event_id", "public_from", "safety")
    return _keyed(needed.withWatermark("ts", late), ["tip_id"], TipVotes(), VERDICT, "update")


# ── rows with a lifetime ───────────────────────────────────────────────────────────────────────────
LIFETIME = "class string, row_id long, expire_at timestamp, state string"


class Lifetimes(StatefulProcessor):
    """Rows of one class that expire within one slot: held until their own moment, then dropped from the state.

    The rows of a batch are added to the slot's list at once, and a slot has one timer, at the first moment one of its rows
    ends; it then moves on to the next.  A row that comes again counts once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row_id long, expire long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            expire = part["expire_at"].astype("datetime64[us]").astype("int64")
            past = expire // 1000 < now
            held += zip(part["row_id"][~past].tolist(), expire[~past].tolist(), strict=True)
            yield part.assign(**{"class": key[0]}, state=past.map({True: "expired", False: "kept"}))[["class", "row_id", "expire_at", "state"]]
        if held:
            self.rows.appendList(held)
            self._wait(min(e for _, e in held) // 1000, earlier=True)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held = dict(self.rows.get())
        gone = {r: e for r, e in held.items() if e // 1000 <= passed}
        left = [(r, e) for r, e in held.items() if r not in gone]
        if left:
            self.rows.put(left)
            self._wait(min(e for _, e in left) // 1000)
        else:
            self.rows.clear()
            self.due.clear()
        if gone:
            yield pd.DataFrame({"class": key[0], "row_id": list(gone), "expire_at": pd.to_datetime(list(gone.values()), unit="us"), "state": "expired"})

    def close(self) -> None:
        pass

    def _wait(self, at: int, earlier: bool = False) -> None:
        if earlier and self.due.exists():
            due = self.due.get()[0]
            if due <= at:
                return
            self.handle.deleteTimer(due)
        self.due.update((at,))
        self.handle.registerTimer(at)


def lifetimes(rows: DataFrame, slot: str = "1 minute", late: str = "0 seconds") -> DataFrame:
    """(class, row_id, expire_at, state): `kept` when a row arrives, `expired` when event time passes the end of its class's lifetime.

    Needs row_id, class and created_at.  State is keyed by class and the slot of time a row expires in, so a class is many
    keys and a key's timers lie within one slot.  A class without a lifetime keeps nothing.
    """
    hours = F.coalesce(*[F.when(F.col("class") == k, F.lit(h)) for k, h in rules.TTL_HOURS.items()])
    timed = rows.withWatermark("created_at", late).withColumn("expire_at", F.col("created_at") + F.make_dt_interval(hours=hours))
    timed = timed.where("expire_at is not null").withColumn("slot", F.window("expire_at", slot)["start"])
    return _keyed(timed.select("class", "slot", "row_id", "expire_at", "created_at"), ["class", "slot"], Lifetimes(), LIFETIME, "append")


# ── scans, tried again after a failure ─────────────────────────────────────────────────────────────
SCAN = "version long, url string, kind string, attempt int, due_at timestamp, failed int"


class Scans(StatefulProcessor):
    """The urls of one version: asked for once, again some time after a failure, given up after the last try.

    A version's urls are read and written once per batch, and the version has one timer, at the first retry that is due.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.urls = handle.getListState("scans", "url string, status string, failed int, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        held = self._held()
        before, out = self._next(held), []
        for url, at, ok in zip(events["url"].tolist(), events["at"], events["ok"].tolist(), strict=True):
            status, failed, due = held.get(url, ("new", 0, 0))
            if status in ("done", "given_up"):
                continue
            if ok is None or pd.isna(ok):  # seen, not yet tried
                if status == "new":
                    status = "asked"
                    out.append((key[0], url, "ask", 1, at, failed))
            elif ok:
                status = "done"
                out.append((key[0], url, status, failed + 1, at, failed))
            else:
                failed += 1
                status = "waiting" if failed < rules.SCAN_MAX_ATTEMPTS else "given_up"
                out.append((key[0], url, status, failed, at, failed))
                due = _ms(at) + self.wait_ms if status == "waiting" else due
            held[url] = (status, failed, due)
        if before is not None and before != self._next(held):
            self.handle.deleteTimer(before)
            before = None
        self._keep(held, before)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held, out = self._held(), []
        for url, (status, failed, due) in held.items():
            if status == "waiting" and due <= passed:
                held[url] = ("asked", failed, due)
                out.append((key[0], url, "ask", failed + 1, pd.Timestamp(due, unit="ms"), failed))
        if out:
            self._keep(held)
            yield self._rows(out)

    def close(self) -> None:
        pass

    def _held(self) -> dict[str, tuple]:
        return {url: tuple(rest) for url, *rest in self.urls.get()} if self.urls.exists() else {}

    def _next(self, held: dict[str, tuple]) -> int | None:
        return min((due for status, _, due in held.values() if status == "waiting"), default=None)

    def _keep(self, held: dict[str, tuple], known: int | None = None) -> None:
        self.urls.put([(url, *rest) for url, rest in held.items()])
        at = self._next(held)
        if at is not None and at != known:
            self.handle.registerTimer(at)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["version", "url", "kind", "attempt", "due_at", "failed"])


def scans(events: DataFrame, wait_minutes: int = 30, late: str = "10 minutes", parts: int = 1) -> DataFrame:
    """What becomes of every (version, url): `ask` with the number of the try, then `waiting`, `done` or `given_up` with its failures.

    Needs version, url, at, event_id and ok: null when a version is seen, else whether a try succeeded.  A failure is
    tried again after `wait_minutes` of event time, at most three tries are made, and whatever comes after the end is ignored.
    State is keyed by version; where a version has very many urls, `parts` deals them to so many keys.
    """
    timed = events.select("version", F.pmod(F.xxhash64("url"), F.lit(parts)).alias("part"), "url", "at", "event_id", "ok").withWatermark("at", late)
    return _keyed(timed, ["version", "part"], Scans(wait_minutes * 60_000), SCAN, "append")
