"""Scans of corpus files with explicit schemas; ids come from file names, never from line order."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.text import strip
from tandem.scale import ranked

_S = T.StringType()
RECORD = T.StructType([
    T.StructField("code", _S), T.StructField("function", _S),
    T.StructField("docstring_tokens", T.ArrayType(_S)), T.StructField("summary", _S)])
SUBMISSION = T.StructType([T.StructField(n, _S) for n in ("problem_id", "submission_id", "code")])
# Header of the metadata files.
METADATA = T.StructType([T.StructField(n, _S) for n in (
    "submission_id", "problem_id", "user_id", "date", "language", "original_language", "filename_ext",
    "status", "cpu_time", "memory", "code_size", "accuracy")])


def _parsed(lines: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    """Text lines as records and the columns ``more``; blank lines and lines that do not parse are dropped.

    Every line is parsed against the whole schema, whatever columns are used later.
    """
    bad = "_bad"
    full = T.StructType([*schema.fields, T.StructField(bad, _S)])
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("row")
    out = lines.filter(F.trim("value") != "").select(row, *more)
    return out.filter(F.col("row").isNotNull() & F.col(f"row.{bad}").isNull()).select(
        *[F.col(f"row.{n}").alias(n) for n in schema.fieldNames()], *more)


def jsonl(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = RECORD) -> DataFrame:
    """JSON lines; a line that does not parse is dropped."""
    return _parsed(spark.read.text(paths), schema)


def split_files(spark: SparkSession, folder: str, schema: T.StructType = RECORD) -> DataFrame:
    """``train/valid/test.jsonl`` of one folder with a ``split`` column; absent files are simply not there."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(folder).withColumn(
        "split", F.regexp_extract(F.col("_metadata.file_name"), r"^(train|valid|test)\d*\.jsonl$", 1))
    return _parsed(lines.filter(F.col("split") != ""), schema, "split")


def metadata(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Submission metadata; lines with a wrong field count are dropped, the last duplicate wins."""
    # without column pruning the reader compares the field count with the whole header
    df = (spark.read.schema(METADATA).option("header", True).option("mode", "DROPMALFORMED")
          .option("columnPruning", False).csv(paths))
    return latest_status(df.withColumn("line", F.monotonically_increasing_id()))


def latest_status(df: DataFrame, order: str = "line") -> DataFrame:
    """``problem_id, submission_id, status`` (lower case) of the last line per submission."""
    return df.groupBy("problem_id", "submission_id").agg(
        F.lower(F.max_by("status", order)).alias("status"))


def source_tree(spark: SparkSession, root: str, language: str, extension: str) -> DataFrame:
    """``root/<problem>/<Language>/<submission>.<ext>``, one row per non-empty file."""
    df = spark.read.option("pathGlobFilter", f"*.{extension}").text(
        f"{root}/*/{language}", wholetext=True)
    path = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(path, rf"([^/]+)/{language}/[^/]+$", 1).alias("problem_id"),
        path_stem(path).alias("submission_id"), F.col("value").alias("code")).filter(F.length("code") > 0)


def path_stem(path: Column) -> Column:
    """File name without folder and last extension; a leading dot is part of the name."""
    name = F.substring_index(strip(path), "/", -1)
    return F.regexp_replace(name, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def path_list(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Ids named by one or more path lists, each once."""
    return spark.read.text(paths).select(path_stem(F.col("value")).alias("submission_id")).distinct()


def block_lines(block: Column) -> Column:
    """Non-blank lines of a text, grouped into blocks by blank lines."""
    blocks = F.split(block, r"\n(?:[^\S\n]*\n)+")
    lines = F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""))
    return F.filter(lines, lambda xs: F.size(xs) > 0)


def cluster_heads(spark: SparkSession, path: str) -> DataFrame:
    """First member of every blank-line separated block.

    The reader splits the file at empty lines, of either kind of line end, so blocks are
    records and a large file is read by many tasks.
    """
    first = spark.read.text(path, lineSep="\n").limit(1).collect()
    end = "\r\n" if first and first[0][0].endswith("\r") else "\n"
    blocks = spark.read.text(path, lineSep=end * 2)
    block = F.replace("value", F.lit("\r"), F.lit(""))
    heads = blocks.select(F.explode(F.transform(block_lines(block), lambda xs: xs[0])).alias("path"))
    return heads.select(path_stem(F.col("path")).alias("submission_id")).distinct()


def identical_problems(spark: SparkSession, path: str) -> DataFrame:
    """All but the first id of each comma-separated line."""
    ids = F.split(strip(F.col("value")), ",")
    return spark.read.text(path).select(F.explode(F.slice(ids, F.lit(2), F.size(ids))).alias("problem_id")).distinct()


def split_id_code(line: Column, legacy: bool = False) -> tuple[Column, Column]:
    """``id | code``; blanks squeezed. ``legacy`` stops the code at its next bar."""
    parts = F.split(line, r"\|", -1 if legacy else 2)

    def tidy(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, "[ \t]+", " "))

    # a line without a bar is its own id and code, as with cut
    return tidy(F.get(parts, F.lit(0))), tidy(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))


GEN_LINE = r"^H-(-?\d+)\t([^\t]*)(\t(.*))?$"


def gen_log(lines: DataFrame, value: str = "value", drop_first_token: bool = False) -> DataFrame:
    """Hypothesis lines of a generation log as ``id, score, hypothesis``; a line without a text field has a null one."""
    v = F.col(value)
    text = F.when(F.regexp_extract(v, "(?d)" + GEN_LINE, 3) != "", F.regexp_extract(v, "(?d)" + GEN_LINE, 4))
    if drop_first_token:
        text = F.regexp_replace(text, "^[^ ]* ?", "")
    return lines.filter(F.rlike(v, F.lit("^H"))).select(
        F.regexp_extract(v, "(?d)" + GEN_LINE, 1).try_cast("bigint").alias("id"),
        F.regexp_extract(v, "(?d)" + GEN_LINE, 2).try_cast("double").alias("score"), text.alias("hypothesis"))


def ordered_log(lines: DataFrame, value: str = "value", drop_first_token: bool = False) -> DataFrame:
    """``gen_log`` in the order of its numeric ids, whatever order they were written in."""
    return gen_log(lines, value, drop_first_token).orderBy("id")


def references(spark: SparkSession, stem: str) -> DataFrame:
    """``ref_no, line, ref`` of the text files ``stem``, ``stem0``, ``stem1``, …, each plain or ``.gz``.

    The file without a number comes first. Lines are numbered from 0 in file order.
    """
    name = stem.rpartition("/")[2]
    lines = spark.read.text(stem + "{,.gz,[0-9]*}")
    number = F.regexp_extract(F.col("_metadata.file_name"), rf"^\Q{name}\E([0-9]*)(\.gz)?$", 1)
    known = F.rlike(F.col("_metadata.file_name"), F.lit(rf"^\Q{name}\E[0-9]*(\.gz)?$"))
    rows = lines.filter(known).select(
        F.when(number == "", -1).otherwise(number.try_cast("bigint")).alias("ref_no"), F.col("value").alias("ref"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return ranked(rows, ["ref_no"], ["block"], ["at"], "line").select("ref_no", "line", "ref")


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``line, value``: the lines of text files, numbered from 0 over all files by name, however Spark splits them.

    Lines are counted for each split; the numbers of splits before one are added to the place within it. The
    window over counts has one row for each split.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def parallel_lines(spark: SparkSession, sides: dict[str, str | Sequence[str]]) -> DataFrame:
    """``line`` and a column for each side: files aligned by position, whatever parts they are written in.

    A line that one side lacks raises an error: sides of unequal length are never cut to the shorter.
    """
    out = None
    for name, paths in sides.items():
        one = numbered_lines(spark, paths).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, "line", "full")
    lacking = F.raise_error(F.concat(F.lit("sides of unequal length at line "), F.col("line").cast("string"))).cast("string")
    return out.select("line", *[F.coalesce(F.col(name), lacking).alias(name) for name in sides])


def shard_files(spark: SparkSession, paths: str | Sequence[str], number: str = r"[./=](\d+)[./][^/]*$") -> DataFrame:
    """``shard, path, length`` of the files that ``paths`` name: globs, folders, or several joined by ``:`` as in ``a:b:c``.

    Only the file index is read, no content. ``number`` finds the shard's number in a path; files without one are left out,
    and so are empty ones.
    """
    if isinstance(paths, str):
        # a colon before two slashes belongs to a scheme
        paths = [p for p in re.split(r":(?!//)", paths) if p]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length")
    shard = F.regexp_extract("path", number, 1)
    return files.filter(shard != "").select(shard.cast("bigint").alias("shard"), "path", "length")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def either_direction(spark: SparkSession, root: str, src: str, tgt: str) -> tuple[DataFrame, bool]:
    """Parquet pairs under ``root/src-tgt``, else those under ``root/tgt-src`` with their sides exchanged.

    Also says whether they were exchanged. Pairs have the columns ``source`` and ``target``.
    """
    if exists(spark, f"{root}/{src}-{tgt}"):
        return spark.read.parquet(f"{root}/{src}-{tgt}"), False
    back = spark.read.parquet(f"{root}/{tgt}-{src}")
    names = {"source": "target", "target": "source"}
    return back.select(*[F.col(c).alias(names.get(c, c)) for c in back.columns]), True


def keywords(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Keyword list, one per line."""
    return spark.read.text(path).select(F.lit(lang).alias("lang"), strip(F.col("value")).alias("keyword"))


def numbered_splits(spark: SparkSession, root: str, split: str) -> DataFrame:
    """``split``, ``split1``, ``split2``, … under ``root`` as one table with ``part``; folders above do not count."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    below = F.substring_index(F.col("_metadata.file_path"), base, -1)
    part = F.regexp_extract(below, rf"/{split}(\d*)[/.]", 1)
    return df.withColumn("part", F.when(part == "", 0).otherwise(part.try_cast("int"))).filter(
        F.rlike(below, F.lit(rf"/{split}\d*[/.]")))


def canonical_pair(src: Column, tgt: Column) -> Column:
    return F.concat_ws("-", F.least(src, tgt), F.greatest(src, tgt))
