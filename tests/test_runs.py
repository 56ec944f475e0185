from pyspark.sql import functions as F

from tandem.operators import errors as E
from tandem.operators import runs as R


def test_status_of_output(spark):
    rows = [("a #Results:1,2 #Results: 3, 3", "", False, "success"), ("#Results: 1,3", "", False, "failure"),
            ("#Results: 1", "boom", False, "error"), ("no marker", "boom", False, "error"),
            ("3,3", "", False, "success"), ("#Results: x,3", "", None, "error"), ("#Results: 3,3", "", True, "timeout"),
            (None, "boom", False, "error")]
    df = spark.createDataFrame(rows, "out string, err string, late boolean, want string")
    status, detail = R.run_status(F.col("out"), F.col("err"), F.col("late"))
    for r in df.select(status.alias("s"), detail.alias("d"), "want", "out").collect():
        assert r.s == r.want
        assert r.d == {"failure": r.out, "error": r.d}.get(r.s)


def runs(spark):
    rows = [(1, 0, "failure", "x"), (1, 1, "success", "identical to gold"), (1, 2, "success", None),
            (2, 0, "error", "e"), (2, 1, "failure", "f"), (3, 0, "script_not_found", None), (4, 0, "success", None)]
    return spark.createDataFrame(rows, "problem_id long, beam int, status string, detail string")


def test_outcomes(spark):
    kept = R.until_success(runs(spark))
    assert {(r.problem_id, r.beam) for r in kept.collect()} == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0)}
    out = {r.problem_id: (r.outcome, r.identical) for r in R.problem_outcome(kept).collect()}
    assert out == {1: ("success", True), 2: ("error", False), 3: ("script_not_found", False), 4: ("success", False)}
    s = R.outcome_stats(R.problem_outcome(kept))
    row = s.withColumn("acc", R.accuracy()).first()
    assert (row.success, row.error, row.failure, row.identical_gold, row.total, row.total_evaluated) == (2, 1, 0, 1, 4, 3)
    assert row.acc == 2 / 3
    beams = {r.beam: (r.success, r.tried, r["empty"]) for r in R.success_per_beam(runs(spark)).collect()}
    assert beams == {0: (1, 4, 0), 1: (1, 2, 0), 2: (0, 0, 1)}
    grid = R.beam_grid(runs(spark))
    assert grid.count() == 7 and grid.filter("result = ''").count() == 1
    assert grid.filter("problem_id = 4 and beam = 0").first().result == "success : None"
    log = R.run_log(runs(spark)).filter("problem_id = 1").orderBy("beam").collect()
    assert [r.line for r in log] == ["failure : x", "success : identical to gold"]


def test_no_runs(spark):
    s = R.outcome_stats(R.problem_outcome(R.until_success(runs(spark).filter("false"))))
    assert s.withColumn("acc", R.accuracy()).first().acc == 0.0


def test_checkpoint_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("c_1000", 0.5, 10.0), ("c_500", 0.5, 9.0), ("c_90", 0.1, 30.0)],
                               "checkpoint string, comp_acc double, bleu double")
    assert [r.checkpoint for r in R.checkpoint_table(df).collect() if r.best] == ["c_500"]


def test_error_rules(spark):
    messages = ["error : error: char cannot be dereferenced", "error : A error: ';' expected",
                "error : java.lang.IndexOutOfBoundsException", "error : java.lang.ArrayIndexOutOfBoundsException",
                "error : nothing known"]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    got = [r.c for r in df.select(E.classify(F.col("m"), E.COMPILER_RULES).alias("c")).collect()]
    assert got == ["TypeError", "SyntaxError", "IndexOutOfBoundsException", "ArrayIndexOutOfBoundsException", "other"]
    assert len(E.COMPILER_RULES) == 24 and len(E.PYTHON_RULES) == 11
    assert sum(r[1] == E.RUNTIME for r in E.COMPILER_RULES) == 8


def test_every_event_is_an_attempt(spark):
    import os

    import pytest

    from tandem.plans import views

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    runs = views.runs(spark, sf)
    assert runs.count() == runs.select("problem_id", "beam").distinct().count() == events
    assert R.beam_grid(runs).count() == events
