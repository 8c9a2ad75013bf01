"""Histories of weight searches as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import double

SCHEMA = "trial_number int, state string, eval_loss double, weights map<string,double>, is_warmup boolean, params map<string,double>, datetime_start timestamp, datetime_complete timestamp"


def with_duration(trials: DataFrame) -> DataFrame:
    seconds = (F.unix_micros(F.col("datetime_complete").cast("timestamp")) - F.unix_micros(F.col("datetime_start").cast("timestamp"))) / double(1e6)
    return trials.withColumn("duration_seconds", seconds)


def zombies(now: Column | None = None, hours: float = 24.0) -> Column:
    """Condition: running for longer than the timeout."""
    age = F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros(F.col("datetime_start").cast("timestamp"))
    return (F.col("state") == "RUNNING") & (age > F.lit(int(hours * 3_600_000_000)))


def by_loss(trials: DataFrame, limit: int = 0) -> DataFrame:
    """By loss, missing ones last; a loss of 0 sorts as infinite, as in the listing this reproduces. limit 0: all."""
    loss = F.when(F.col("eval_loss").isNull() | (F.col("eval_loss") == 0), double("inf")).otherwise(F.col("eval_loss"))
    out = trials.orderBy(loss.asc(), F.asc("trial_number"))
    return out.limit(limit) if limit else out


def by_number(trials: DataFrame, limit: int = 0) -> DataFrame:
    out = trials.orderBy("trial_number")
    return out.limit(limit) if limit else out


def completed(trials: DataFrame) -> DataFrame:
    return trials.where("state = 'COMPLETE'")


def best(trials: DataFrame) -> DataFrame:
    """The completed trial of the least loss, the earlier one of equals."""
    return completed(trials).where("eval_loss is not null").orderBy("eval_loss", "trial_number").limit(1)


def statistics(trials: DataFrame) -> DataFrame:
    """``total, completed, other, min_loss, max_loss, avg_loss``."""
    done = F.col("state") == "COMPLETE"
    loss = F.when(done, F.col("eval_loss"))
    return trials.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(~done | F.col("state").isNull()).alias("other"), F.min(loss).alias("min_loss"), F.max(loss).alias("max_loss"), F.avg(loss).alias("avg_loss"))


def top_weights(trials: DataFrame, n: int = 5) -> DataFrame:
    """``trial_number, rank, key, weight``: the n largest weights of each trial, ties by key."""
    ordered = F.array_sort(F.transform(F.map_entries("weights"), lambda e: F.struct((-e["value"]).alias("down"), e["key"].alias("key"))))
    top = trials.select("trial_number", F.posexplode(F.slice(ordered, 1, n)).alias("i", "e"))
    return top.select("trial_number", (F.col("i") + 1).alias("rank"), F.col("e.key").alias("key"), (-F.col("e.down")).alias("weight"))


def pivoted(trials: DataFrame) -> DataFrame:
    """All trials with a column ``weight_<key>`` for each key that any has, sorted; missing weights are 0."""
    keys = sorted(r[0] for r in trials.select(F.explode(F.map_keys("weights"))).distinct().collect())
    extra = [F.coalesce(F.col("weights")[k], double(0.0)).alias(f"weight_{k}") for k in keys]
    kept = [c for c in ("trial_number", "state", "eval_loss", "is_warmup", "datetime_start", "datetime_complete", "duration_seconds") if c in trials.columns]
    return trials.select(*kept, *extra)


def export_csv(trials: DataFrame, path: str) -> None:
    pivoted(trials).orderBy("trial_number").write.mode("overwrite").csv(path, header=True)


def export_json(trials: DataFrame, path: str) -> None:
    trials.orderBy("trial_number").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def signatures_by_state(trials: DataFrame, now: Column | None = None, hours: float = 24.0) -> DataFrame:
    """``status, signatures``: the distinct signatures of completed, waiting, running, failed and zombie trials; trials has a column signature."""
    status = F.when(zombies(now, hours), "ZOMBIE").otherwise(F.col("state"))
    return trials.groupBy(status.alias("status")).agg(F.array_sort(F.collect_set("signature")).alias("signatures"))


def unseen(candidates: DataFrame, trials: DataFrame) -> DataFrame:
    """Candidates whose signature no completed trial has; of equal candidates the first by ``entry``."""
    first = candidates.groupBy("signature").agg(F.min_by(F.struct(*candidates.columns), "entry").alias("_")).select("_.*")
    return first.join(completed(trials).select("signature"), "signature", "left_anti")


def enqueue_plan(candidates: DataFrame, trials: DataFrame, now: Column | None = None, hours: float = 24.0) -> DataFrame:
    """``entry, signature, action``: skip_complete, skip_waiting, skip_running, retry (failed or stuck trials only), duplicate (of an earlier entry) or new."""
    stuck = zombies(now, hours)
    seen = trials.groupBy("signature").agg(
        F.max((F.col("state") == "COMPLETE").cast("int")).alias("c"), F.max((F.col("state") == "WAITING").cast("int")).alias("w"),
        F.max(((F.col("state") == "RUNNING") & ~stuck).cast("int")).alias("r"), F.max(((F.col("state") == "FAIL") | stuck).cast("int")).alias("f"),
    )
    firsts = candidates.groupBy("signature").agg(F.min("entry").alias("_first"))
    both = candidates.join(firsts, "signature").join(seen, "signature", "left")
    action = F.when(F.col("_first") < F.col("entry"), "duplicate").when(F.col("c") == 1, "skip_complete").when(F.col("w") == 1, "skip_waiting").when(F.col("r") == 1, "skip_running").when(F.col("f") == 1, "retry").otherwise("new")
    return both.select("entry", "signature", action.alias("action"))


def early_stop(trials: DataFrame, patience: int, delta: float = 0.0) -> DataFrame:
    """``stopped_at, best``: the trial at which the run of trials without a sufficient improvement reaches patience (null: none does).

    The best value moves only by more than delta, so it is folded over the ordered losses; a history has thousands of trials at most.
    """
    losses = completed(trials).where("eval_loss is not null").agg(F.array_sort(F.collect_list(F.struct("trial_number", "eval_loss"))).alias("t"))
    start = F.struct(double("inf").alias("best"), F.lit(0).alias("run"), F.lit(None).cast("int").alias("at"))

    def step(s, t):
        better = t["eval_loss"] < s["best"] - double(delta)
        run = F.when(better, F.lit(0)).otherwise(s["run"] + 1)
        moved = F.struct(F.when(better, t["eval_loss"]).otherwise(s["best"]).alias("best"), run.alias("run"), F.when(run >= patience, t["trial_number"]).alias("at"))
        return F.when(s["at"].isNotNull(), s).otherwise(moved)

    end = F.aggregate("t", start, step)
    return losses.select(end["at"].alias("stopped_at"), end["best"].alias("best"))


def running_best(trials: DataFrame) -> DataFrame:
    """Data of a history plot: trial_number, eval_loss, best so far."""
    losses = completed(trials).where("eval_loss is not null").agg(F.array_sort(F.collect_list(F.struct("trial_number", "eval_loss"))).alias("t"))
    pairs = F.transform("t", lambda x, i: F.struct(x["trial_number"].alias("trial_number"), x["eval_loss"].alias("eval_loss"), F.array_min(F.transform(F.slice("t", 1, i + 1), lambda y: y["eval_loss"])).alias("best")))
    return losses.select(F.inline(pairs))
