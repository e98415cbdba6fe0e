"""Vote and flag tallies, and the verdict over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules


def admissible(votes: DataFrame, tips: DataFrame) -> DataFrame:
    """Votes on a public tip by someone other than its author; `tips` has tip_id, author, public_from."""
    return votes.join(tips, "tip_id").where(
        (F.col("token") != F.col("author")) & (F.col("ts") >= F.col("public_from"))
    ).select(votes["*"])


def effective_ballots(votes: DataFrame) -> DataFrame:
    """One row per (tip, token): its current ballot with the time and network it was cast from.

    A repeated ballot changes nothing, so time and network are those of the first event of the
    last run of equal ballots.  Both steps are aggregates that combine map-side.
    """
    ballots = votes.where(F.col("action").isin("confirm", "dispute")).withColumn("_at", F.struct("ts", "event_id"))
    last = lambda action: F.max(F.when(F.col("action") == action, F.col("_at")))
    state = ballots.groupBy("tip_id", "token").agg(last("confirm").alias("_c"), last("dispute").alias("_d"))
    is_confirm = F.col("_d").isNull() | (F.col("_c") > F.col("_d"))
    state = state.select(
        "tip_id",
        "token",
        F.when(is_confirm, "confirm").otherwise("dispute").alias("ballot"),
        F.when(is_confirm, F.col("_d")).otherwise(F.col("_c")).alias("_other"),
    )
    return (
        ballots.join(state, ["tip_id", "token"])
        .where(F.col("_other").isNull() | (F.col("_at") > F.col("_other")))
        .groupBy("tip_id", "token", "ballot")
        .agg(F.min(F.struct("ts", "event_id", "net")).alias("_first"))
        .select("tip_id", "token", "ballot", F.col("_first.ts").alias("ballot_at"), F.col("_first.net").alias("net"))
    )


def vote_tally(votes: DataFrame) -> DataFrame:
    """Confirms and disputes of every tip with their counts per network."""
    per_net = effective_ballots(votes).groupBy("tip_id", "net").agg(
        F.count(F.when(F.col("ballot") == "confirm", 1)).alias("c"),
        F.count(F.when(F.col("ballot") == "dispute", 1)).alias("d"),
        F.max(F.when(F.col("ballot") == "confirm", F.col("ballot_at"))).alias("last_confirm"),
    )
    nets = lambda value: F.map_from_entries(
        F.sort_array(F.collect_list(F.when(value > 0, F.struct("net", value))))
    )
    return per_net.groupBy("tip_id").agg(
        F.sum("c").alias("confirm"),
        F.sum("d").alias("dispute"),
        nets(F.col("c") + F.col("d")).alias("net_counts"),
        nets(F.col("d")).alias("dispute_nets"),
        F.max("last_confirm").alias("last_confirm"),
    )


def flag_tally(votes: DataFrame) -> DataFrame:
    """Flags of every tip, one per token, with the networks they came from."""
    first = (
        votes.where(F.col("action") == "flag")
        .groupBy("tip_id", "token")
        .agg(F.min(F.struct("ts", "event_id", "net")).alias("_first"))
    )
    per_net = first.groupBy("tip_id", F.col("_first.net").alias("net")).agg(F.count("*").alias("n"))
    return per_net.groupBy("tip_id").agg(F.sum("n").alias("flags"), F.count("*").alias("flag_nets"))


def tip_verdict(tips: DataFrame, now: Column) -> DataFrame:
    """Status and marks that follow from the tallies of a tip.

    Needs status, published_at, safety, confirm, dispute, net_counts, dispute_nets, flags and
    flag_nets.
    """
    c = F.col
    total = c("confirm") + c("dispute")
    biggest = lambda m: F.coalesce(F.array_max(F.map_values(m)), F.lit(0))
    public = c("status").isin("verifying", "student_approved", "approved")
    many = (c("flags") >= rules.FLAGS_TO_HIDE) & public
    share = lambda part, whole: F.try_divide(part.cast("double"), whole)
    step = tips.withColumns({
        "_total": total,
        "_hide": many & (c("flag_nets") >= rules.FLAG_NETS_TO_HIDE),
        "_majority": F.coalesce((total >= rules.MIN_VOTES) & (share(c("dispute"), total) > rules.CONTEST_RATIO), F.lit(False)),
        "_diverse": F.coalesce(
            (F.size(F.map_keys("dispute_nets")) >= rules.FLAG_NETS_TO_HIDE)
            & (share(biggest(c("dispute_nets")), c("dispute")) <= rules.MAX_NET_SHARE),
            F.lit(False),
        ),
        "_review": many & (c("flag_nets") < rules.FLAG_NETS_TO_HIDE),
    })
    step = step.withColumn("_contested", c("_majority") & c("_diverse"))
    candidate = (
        ~c("_hide") & (c("status") == "verifying") & ~c("_contested") & ~c("safety") & ~c("_majority")
        & (c("flags") == 0)
        & (c("published_at") <= now - F.expr(f"INTERVAL {rules.MIN_PUBLIC_HOURS} HOURS"))
        & (c("_total") >= rules.MIN_VOTES)
        & F.coalesce(share(c("confirm"), c("_total")) >= rules.MIN_CONFIRM_RATIO, F.lit(False))
    )
    step = step.withColumn("_candidate", candidate)
    one_net = F.coalesce(share(biggest(c("net_counts")), c("_total")) > rules.MAX_NET_SHARE, F.lit(False))
    return step.select(
        "tip_id",
        F.when(c("_hide"), "hidden").when(c("_candidate") & ~one_net, "student_approved").otherwise(c("status")).alias("status"),
        F.when(c("_hide"), c("status")).otherwise("").alias("hidden_from"),
        (~c("_hide") & c("_contested")).alias("contested"),
        (~c("_hide") & ((c("_majority") & ~c("_diverse")) | (c("_candidate") & one_net))).alias("burst_risk"),
        (~c("_hide") & c("_review")).alias("flag_review"),
    )
