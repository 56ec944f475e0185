"""Analytics over unit-test attempts: ``(problem_id, beam, status, detail)``, unique per problem and beam."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.scale import attach

# Fixed values.
STATUS = ["success", "failure", "error", "timeout", "script_not_found"]
MARKER = "#Results:"
IDENTICAL = "identical to gold"


def run_status(stdout: Column, stderr: Column, timed_out: Column) -> tuple[Column, Column]:
    """``(status, detail)`` read off captured output: the two numbers after the last
    ``#Results:`` must be equal; anything unreadable is an error."""
    parts = F.split(F.substring_index(stdout, MARKER, -1), ",")
    number = r"^\s*[+-]?\d+\s*$"

    def whole(i: int) -> Column:
        x = F.get(parts, F.lit(i))
        return F.when(F.rlike(x, F.lit(number)), F.trim(x).try_cast("bigint"))

    ok, total = whole(0), whole(1)
    readable = (F.size(parts) == 2) & ok.isNotNull() & total.isNotNull()
    timed_out = F.coalesce(timed_out, F.lit(False))
    status = (F.when(timed_out, "timeout").when(~F.coalesce(readable, F.lit(False)), "error")
              .when(ok == total, "success").otherwise("failure"))
    detail = F.when(status == "failure", stdout).when(status == "error", stderr)
    return status, detail


def gold_identity(df: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """A hypothesis equal to the reference succeeds without a run."""
    same = F.col(hyp) == F.col(ref)
    return (df.withColumn("status", F.when(same, F.lit("success")).otherwise(F.col("status")))
            .withColumn("detail", F.when(same, F.lit(IDENTICAL)).otherwise(F.col("detail"))))


def template_join(attempts: DataFrame, templates: DataFrame, key: str = "problem_id") -> DataFrame:
    """Look the test script up; a problem without one keeps its first attempt only, as ``script_not_found``."""
    first = attempts.groupBy(key).agg(F.min("beam").alias("__first"))
    out = attach(attempts, first, [key]).join(templates, key, "left")
    missing = F.col("script").isNull()
    return (out.filter(~missing | (F.col("beam") == F.col("__first"))).drop("__first")
            .withColumn("state", F.when(missing, "script_not_found").otherwise("ready")))


def until_success(runs: DataFrame) -> DataFrame:
    """Attempts in beam order up to and including the first success."""
    return _first_success(runs).filter("__tried").drop("__tried")


def problem_outcome(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``success`` if any attempt succeeded, else the first attempt's status."""
    names = F.array(*[F.lit(s) for s in STATUS])
    # beam and status share one long, so the minimum stays in a hash aggregate
    packed = F.col("beam").cast("long") * 8 + F.array_position(names, F.col("status"))
    won = F.col("status") == "success"
    return runs.groupBy(*by, "problem_id").agg(
        F.min(packed).alias("__first"), F.max(won).alias("__won"),
        F.max(won & F.coalesce(F.col("detail") == IDENTICAL, F.lit(False))).alias("identical"),
        F.count(F.lit(1)).alias("attempts"),
    ).select(*by, "problem_id",
             F.when(F.col("__won"), "success").otherwise(
                 F.get(names, (F.pmod("__first", F.lit(8)) - 1).cast("int"))).alias("outcome"),
             "identical", "attempts")


def outcome_stats(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per status, zero-filled, with the totals."""
    counts = [F.coalesce(F.sum((F.col("outcome") == s).cast("long")), F.lit(0)).alias(s) for s in STATUS]
    out = outcomes.groupBy(*by).agg(
        *counts, F.coalesce(F.sum(F.col("identical").cast("long")), F.lit(0)).alias("identical_gold"),
        F.count(F.lit(1)).alias("total"))
    return out.withColumn("total_evaluated", F.col("total") - F.col("script_not_found"))


def accuracy() -> Column:
    """Computational accuracy over ``outcome_stats``."""
    return F.col("success") / F.greatest(F.col("total_evaluated"), F.lit(1))


def validation_accuracy(stats: DataFrame, double_count: bool = False) -> DataFrame:
    """Mean over groups of successes / evaluated attempts. ``double_count`` adds the
    identical ones a second time to the divisor, as older reports did."""
    tried = F.col("success") + F.col("failure") + F.col("error") + F.col("timeout")
    if double_count:
        tried = tried + F.col("identical_gold")
    return stats.agg(F.round(F.avg(F.try_divide(F.col("success"), tried)), 2).alias("comp_acc"))


def _result() -> Column:
    return F.concat(F.col("status"), F.lit(" : "),
                    F.coalesce(F.replace("detail", F.lit("\n"), F.lit(" ")), F.lit("None")))


def _first_success(runs: DataFrame) -> DataFrame:
    won = runs.filter(F.col("status") == "success").groupBy("problem_id").agg(F.min("beam").alias("__won"))
    tried = F.col("__won").isNull() | (F.col("beam") <= F.col("__won"))
    return attach(runs, won, ["problem_id"], "left").withColumn("__tried", tried).drop("__won")


def beam_grid(runs: DataFrame) -> DataFrame:
    """``status : detail`` of every attempt; empty after the problem's first success."""
    return _first_success(runs).select("problem_id", "beam", F.when(F.col("__tried"), _result()).otherwise("").alias("result"))


def success_per_beam(runs: DataFrame) -> DataFrame:
    """Per beam position: successes, attempts made, attempts left out after a success."""
    tried = F.col("__tried")
    return _first_success(runs).groupBy("beam").agg(
        F.sum((tried & (F.col("status") == "success")).cast("long")).alias("success"),
        F.sum(tried.cast("long")).alias("tried"), F.sum((~tried).cast("long")).alias("empty"))


def run_log(runs: DataFrame) -> DataFrame:
    """The lines of each problem's log: one row per attempt up to the first success, to be ordered by beam."""
    return until_success(runs).select("problem_id", "beam", F.concat(
        "status", F.lit(" : "), F.coalesce("detail", F.lit("None"))).alias("line"))


def checkpoint_table(scores: DataFrame) -> DataFrame:
    """``checkpoint, comp_acc, bleu`` per checkpoint, rounded, with the best one marked.

    The first step wins ties. One row per checkpoint: the window is over a handful of rows.
    """
    step = F.element_at(F.split("checkpoint", "_"), -1).cast("int")
    ranked = scores.withColumn("step", step)
    best = F.first("step").over(Window.orderBy(F.desc("comp_acc"), "step")
                                .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.select("checkpoint", "step", F.round(F.col("bleu"), 2).alias("bleu"),
                         F.round(F.col("comp_acc") * 100, 2).alias("comp_acc"),
                         (F.col("step") == best).alias("best"))
