"""Line files that belong together by position."""
import uuid

import pytest
from pyspark.sql import functions as F

from tandem.operators import corpus as C
from tandem.operators import ngrams as G
from tandem.sources import readers as R
from tandem.sources.writers import write_bucketed
from tandem.streaming import metrics as M


def written(tmp_path, name, parts):
    folder = tmp_path / name
    folder.mkdir()
    for i, lines in enumerate(parts):
        (folder / f"part-{i:05d}.txt").write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize("split", ["134217728", "64"])
def test_lines_are_numbered_over_files_and_splits(spark, tmp_path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = [f"line {i} é" + "x" * (i % 7) for i in range(200)]
        path = written(tmp_path, "a", [lines[:3], [], lines[3:120], lines[120:]])
        got = sorted((r.line, r.value) for r in R.numbered_lines(spark, path).collect())
        assert got == list(enumerate(lines))
        other = written(tmp_path, "b", [lines[:77], lines[77:]])
        both = R.parallel_lines(spark, {"x": path, "y": other}).collect()
        assert len(both) == 200 and all(r.x == r.y == lines[r.line] for r in both)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sides_of_unequal_length_are_an_error(spark, tmp_path):
    a, b = written(tmp_path, "a", [["1", "2", "3"]]), written(tmp_path, "b", [["1"], ["2"]])
    with pytest.raises(Exception, match="unequal length at line 2"):
        R.parallel_lines(spark, {"x": a, "y": b}).collect()
    assert R.parallel_lines(spark, {"x": written(tmp_path, "c", [[]]), "y": written(tmp_path, "d", [[]])}).count() == 0


def test_ids_of_one_side_are_counted_and_the_first_closest_reference_is_taken(spark):
    hyps = spark.createDataFrame([(1, ["a"] * 4), (2, ["b"]), (3, ["c"])], "id long, hyp array<string>")
    refs = spark.createDataFrame([(1, 0, ["a"] * 6), (1, 1, ["a"] * 2), (2, 0, []), (4, 0, ["d"])], "id long, ref_no int, ref array<string>")
    assert tuple(C.coverage(hyps, refs, ["id"]).first()) == (2, 1, 1)
    got = {rule: {r.id: r.ref_len for r in G.multi_ref_stats(hyps, refs, ["id"], ref_len=rule).collect()}
           for rule in ("first", "closest", "shortest", "average")}
    assert got == {"first": {1: 6, 2: 0}, "closest": {1: 2, 2: 0}, "shortest": {1: 2, 2: 0}, "average": {1: 4.0, 2: 0.0}}


def test_shards_are_found_by_globs_and_lists(spark, tmp_path):
    for n in (3, 10, 7):
        (tmp_path / f"train.en.{n}.jsonl").write_text("x" * n)
    (tmp_path / "notes.txt").write_text("none")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "train.en.12.jsonl").write_text("x")
    (tmp_path / "more" / "train.en.13.jsonl").write_text("")
    one = {(r.shard, r.length) for r in R.shard_files(spark, f"{tmp_path}/*.jsonl").collect()}
    assert one == {(3, 3), (7, 7), (10, 10)}
    two = [r.shard for r in R.shard_files(spark, f"{tmp_path}/train.en.3.jsonl:{tmp_path}/more").orderBy("shard").collect()]
    assert two == [3, 12]
    assert "content" not in R.shard_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = [f"t{uuid.uuid4().hex}" for _ in range(3)]
        for name in names:
            write_bucketed(spark.range(200).withColumn(name, F.col("id") * 2), name, str(tmp_path / name), ["id"], 4)
        both = spark.table(names[0]).join(spark.table(names[1]), "id").join(spark.table(names[2]), "id")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_pair_that_is_replayed_in_a_later_batch_counts_once(spark, tmp_path):
    schema = "pair_id long, part string, at timestamp, hits long"

    def batch(rows):
        df = spark.createDataFrame(rows, "pair_id long, part string, s long, hits long")
        df.select("pair_id", "part", F.timestamp_seconds("s").alias("at"), "hits").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        name = f"live_{uuid.uuid4().hex}"
        (M.live_counts(stream, "pair_id", "at", "1 hour", ["hits"], ["part"]).writeStream.outputMode("complete").format("memory")
         .queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
        return {r.part: (r.pairs, r.hits) for r in spark.table(name).collect()}

    batch([(1, "a", 1000, 5), (2, "b", 1010, 7), (1, "a", 1000, 5)])
    assert run() == {"a": (1, 5), "b": (1, 7)}
    batch([(2, "b", 1010, 7), (3, "b", 1020, 1)])  # delivered again, in another batch of a restarted query
    assert run() == {"a": (1, 5), "b": (2, 8)}


def test_ordered_log_keeps_null_texts_and_negative_ids(spark, tmp_path):
    import duckdb

    import __spark_entry__ as E

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if (c + t) % 3 == 0 else f"t{c} {t}\r\nx")
            for c in (-2, -1, 0, 1, 5) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in E.queries()["ordered_log"](spark, str(tmp_path)).select("place", "id", "score", "hypothesis").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(tuple(r) for r in con.execute(f"SELECT place, id, score, hypothesis FROM ({E.oracle_sql()['ordered_log']})").fetchall())
    assert any(r[3] is None for r in want) and any(r[1] < 0 for r in want)
    assert got == want
