import gzip
import json

import pytest
from pyspark.sql import functions as F

from tandem.functions.text import words
from tandem.operators import batches as B
from tandem.operators import corpus as C
from tandem.operators import ngrams as G
from tandem.operators import scores as S
from tandem.scale import ranked
from tandem.sources import readers as R
from tandem.sources import writers as W
from tandem.streaming import metrics as M


def ids(df, col="submission_id"):
    return sorted(r[col] for r in df.collect())


def test_corpus_files(spark, tmp_path):
    for pid, sub, ext, text in [("p1", "s1", "java", "int a ;"), ("p1", "s2", "java", ""), ("p2", "s3", "java", "x\ny"),
                                ("p2", "s4", "txt", "no")]:
        d = tmp_path / "data" / pid / "Java"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{sub}.{ext}").write_text(text)
    tree = R.source_tree(spark, str(tmp_path / "data"), "Java", "java")
    assert sorted(tuple(r) for r in tree.collect()) == [("p1", "s1", "int a ;"), ("p2", "s3", "x\ny")]

    head = ",".join(R.METADATA.fieldNames())
    line = "{},p1,u,d,Java,Java,java,{},1,2,3,4"
    (tmp_path / "p1.csv").write_text("\n".join([head, line.format("s1", "Rejected"), "s9,short,line",
                                                line.format("s1", "Accepted"), line.format("s2", "WRONG")]) + "\n")
    meta = R.metadata(spark, str(tmp_path / "p1.csv"))
    assert sorted((r.submission_id, r.status) for r in meta.collect()) == [("s1", "accepted"), ("s2", "wrong")]

    (tmp_path / "o1.txt").write_text("/v/data/p1/Java/s1.java\n/v/s2.tar.gz\n")
    (tmp_path / "o2.txt").write_text("/v/data/p1/Java/s1.java\n")
    assert ids(R.path_list(spark, [str(tmp_path / "o1.txt"), str(tmp_path / "o2.txt")])) == ["s1", "s2.tar"]

    (tmp_path / "clusters").write_text("\n\n/a/s1.java\n/a/s2.java\n\n\n \n/a/s3.java\n  \n/a/s4.java\n/a/s5.java")
    assert ids(R.cluster_heads(spark, str(tmp_path / "clusters"))) == ["s1", "s3", "s4"]
    (tmp_path / "clusters2").write_bytes(b"/a/s1.java\r\n/a/s2.java\r\n\r\n/a/s3.java\r\n")
    assert ids(R.cluster_heads(spark, str(tmp_path / "clusters2"))) == ["s1", "s3"]
    (tmp_path / "same").write_text("p1,p2,p3\np4\np5,p6\n")
    assert ids(R.identical_problems(spark, str(tmp_path / "same")), "problem_id") == ["p2", "p3", "p6"]


def test_json_and_splits(spark, tmp_path):
    rows = [{"code": "a", "docstring_tokens": ["x", "y"]}, {"function": "b", "summary": "Do it, now."}, {"code": "c"}]
    d = tmp_path / "java"
    d.mkdir()
    (d / "train.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    (d / "test.jsonl").write_text(json.dumps(rows[0]))
    got = R.split_files(spark, str(d)).groupBy("split").count().collect()
    assert {r.split for r in got} == {"train", "test"}
    rec = R.jsonl(spark, str(d / "train.jsonl"))
    out = rec.select(C.docstring(F.col("docstring_tokens"), F.col("summary")).alias("d"),
                     C.code_field(F.col("code"), F.col("function")).alias("c")).collect()
    assert sorted((r.c, r.d) for r in out if r.d) == [("a", "x y"), ("b", "Do it now .")]
    assert [r.c for r in out if r.d is None] == ["c"]
    assert rec.count() == rec.select("code").count() == 3
    (d / "valid.jsonl").write_text("{broken\n\n" + json.dumps(rows[1]))
    assert R.split_files(spark, str(d)).count() == 5


def test_lines(spark):
    df = spark.createDataFrame([("F_1 |  a   || b ",)], "v string")
    a, b = R.split_id_code(F.col("v"))
    assert tuple(df.select(a, b).first()) == ("F_1", "a || b")
    assert df.select(R.split_id_code(F.col("v"), True)[1]).first()[0] == "a"
    log = spark.createDataFrame([("H-3\t-0.5\t__en__ a b",), ("S-3\tx",), ("H-10\t-1.5\tq",)], "value string")
    assert sorted(tuple(r) for r in R.gen_log(log, drop_first_token=True).collect()) == [(3, -0.5, "a b"), (10, -1.5, "")]
    assert [r.id for r in R.ordered_log(log).collect()] == [3, 10]


def test_selection(spark):
    subs = spark.createDataFrame([("p1", "a", "x"), ("p1", "b", "x"), ("p2", "c", "y"), ("p3", "d", "z"), ("p1", "e", ""),
                                  ("p1", "f", "w")], "problem_id string, submission_id string, code string")
    meta = spark.createDataFrame([("p1", "a", "accepted"), ("p3", "d", "wrong")],
                                 "problem_id string, submission_id string, status string")
    ignored, out = spark.createDataFrame([("p2",)], "problem_id string"), spark.createDataFrame([("f",)], "submission_id string")
    reps = C.representatives(subs, "submission_id", "code")
    assert ids(C.select_submissions(subs, meta, ignored, out, reps)) == ["a", "d"]
    assert ids(C.select_submissions(subs, meta, ignored, out, reps, "accepted")) == ["a"]
    assert ids(C.missing_metadata(subs, meta)) == ["b", "c", "e", "f"]


def test_length_policy(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "  ")], "id long, s string").withColumn("t", words(F.col("s")))
    strict = {r.id: (r.reason, r.t) for r in C.length_policy(df, ["t"], ["s"], 2, strict=True).collect()}
    assert strict == {1: ("PASS", ["a", "b"]), 2: ("OVER_LENGTH", None), 3: ("EMPTY", None)}
    cut = {r.id: r.t for r in C.length_policy(df, ["t"], ["s"], 2).collect()}
    assert cut[2] == ["a", "b"]


def test_numericalize(spark):
    df = spark.createDataFrame([(1, "b a b z".split()), (2, "a b".split()), (3, [])], "id long, t array<string>")
    vocab = C.build_vocabulary(df, "t")
    assert {r.token: r.token_id for r in vocab.collect()} == {"b": 4, "a": 5}
    assert {r.id: r.ids for r in C.numericalize(df, "id", "t", vocab).collect()} == {1: [4, 5, 4, 3], 2: [5, 4], 3: []}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranked_matches_a_plain_window(spark, keys):
    from pyspark.sql import Window
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5).alias("k"),
                                  (F.col("id") * 7919 % 101).alias("x"))
    got = ranked(df.withColumn("c", F.floor(F.col("x") / 10)), keys, ["c"], ["x", "id"], "pos")
    plain = df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "id")) - 1)
    assert got.select("id", "pos").exceptAll(plain.select("id", "pos")).count() == 0
    assert got.count() == 5000


def test_round_robin_wraps(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 10 + i) for i in range(2)], "lang string, id long")
    got = sorted((r.step, r.lang, r.row) for r in B.round_robin_zip(df, "lang", ["a", "b"], "id").collect())
    assert got == sorted([(s, "a", s) for s in range(5)] + [(s, "b", 10 + s % 2) for s in range(5)])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "train", "en", i % 2, [1, i]) for i in range(20)],
                               "id long, split string, lang string, shard int, ids array<int>")
    W.write_shards(df, str(tmp_path / "s"), rows_per_file=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 20 and back.filter("shard = 1").count() == 10
    assert (tmp_path / "s" / "split=train" / "lang=en" / "shard=0").is_dir()
    toks = spark.createDataFrame([(["a", "b"],), (None,)], "t array<string>")
    W.write_token_lines(toks, "t", str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a b"]


def test_more_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "pair_id long, source string, target string")
    W.write_pairs(df, str(tmp_path / "pairs"))
    W.write_jsonl(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.parquet(str(tmp_path / "pairs")).count() == 2
    W.write_beams(df.withColumn("beam", F.col("pair_id")), str(tmp_path / "beams"))
    assert spark.read.parquet(str(tmp_path / "beams")).filter("beam = 2").first().source == "c"
    for name, n in (("train", 2), ("train1", 3), ("valid", 1)):
        spark.range(n).write.parquet(str(tmp_path / "d" / name))
    parts = R.numbered_splits(spark, str(tmp_path / "d"), "train").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {0: 2, 1: 3}
    with pytest.raises(Exception, match="already exists"):
        W.write_jsonl(df, str(tmp_path / "json"))
    deep = str(tmp_path / "train" / "data")
    spark.range(2).write.parquet(f"{deep}/train"), spark.range(3).write.parquet(f"{deep}/valid")
    assert R.numbered_splits(spark, deep, "train").count() == 2
    (tmp_path / "ref").write_text("a\nb\n"), (tmp_path / "reference").write_text("no\n")
    with gzip.open(tmp_path / "ref1.gz", "wt") as f:
        f.write("c\nd\n")
    got = sorted(tuple(r) for r in R.references(spark, str(tmp_path / "ref")).collect())
    assert got == [(-1, 0, "a"), (-1, 1, "b"), (1, 0, "c"), (1, 1, "d")]
    df.write.parquet(str(tmp_path / "x" / "java-python"))
    assert R.either_direction(spark, str(tmp_path / "x"), "java", "python")[1] is False
    back, turned = R.either_direction(spark, str(tmp_path / "x"), "python", "java")
    assert turned and {(r.source, r.target) for r in back.collect()} == {("b", "a"), ("d", "c")}
    (tmp_path / "go.txt").write_text("break\n case \n")
    assert [r.keyword for r in R.keywords(spark, str(tmp_path / "go.txt"), "go").collect()] == ["break", "case"]


def test_checkpoint_follows_the_session(spark):
    from tandem.session import ensure_checkpoint_dir
    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = [(i, "a b c d".split(), ("a b c d" if i % 2 else "a x c d").split(), f"l{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, hyp array<string>, ref array<string>, lang string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    M.write_counts(stream, str(tmp_path / "out"), ["id"], str(tmp_path / "ck"), ["lang"]).awaitTermination()
    got = M.total_counts(spark, str(tmp_path / "out"), ["lang"]).select("lang", "m1", "m2", S.bleu_epsilon().alias("b"))
    want = S.corpus_stats(G.match_stats(df, ["lang", "id"]), ["lang"]).select("lang", "m1", "m2", S.bleu_epsilon().alias("b"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
