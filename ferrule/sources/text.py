"""Line-oriented sources: tab-separated records, marked extractions, controlled sentences and compiled clauses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.sources.tables import staged

COVERAGE = "region string, file string, page string, section string, status string"
NOTE = "document string, region string, kept string, dropped string"
SPAN = "document string, grp int, side string, start int, text string"


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, n, text): the lines of the files under path, numbered from 1 in the byte range that a task has read. Staged, so the ranges stay what they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            path, start = batch.column("path").to_pylist(), batch.column("start").to_pylist()
            numbers = []
            for here in zip(path, start):
                n = n + 1 if here == last else 1
                last = here
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(numbers, pa.int64()), batch.column("text")], ["path", "start", "n", "text"])

    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    return staged(rows.mapInArrow(run, "path string, start long, n long, text string"), "lines")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of every line of the files under path, lines numbered from 1 in each file.

    A file is read by many tasks: Spark cuts it into byte ranges at line ends, each range is numbered by itself, and the counts of the ranges before it in the file are added.
    """
    return _numbered(_ranges(spark, path)).select("path", (F.col("before") + F.col("n")).alias("line"), "text")


def _numbered(ranges: DataFrame, marker: Column | None = None) -> DataFrame:
    """ranges with before, the lines of the file's ranges before, and carried, the last marker in those. A file has a row for each of its ranges here, no more."""
    said = F.lit(None).cast("string") if marker is None else marker
    per = ranges.groupBy("path", "start").agg(F.count("*").alias("size"), F.max_by(said, F.when(said.isNotNull(), F.col("n"))).alias("said"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("path", "start", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.last("said", ignorenulls=True).over(earlier).alias("carried"))
    return ranges.join(per, ["path", "start"])


def marked_lines(spark: SparkSession, path: str, marker: Column, name: str = "marker") -> DataFrame:
    """(path, line, text, marker): lines with the last marker, an expression over text that is null on other lines, at or before each in its file.

    Markers run within a byte range, and the last one of the ranges before is carried over, so no task goes through a whole file.
    """
    ranges = _numbered(_ranges(spark, path), marker)
    here = F.last(marker, ignorenulls=True).over(Window.partitionBy("path", "start").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return ranges.select("path", (F.col("before") + F.col("n")).alias("line"), "text", F.coalesce(here, F.col("carried")).alias(name))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated records; lines that start with # and empty lines are skipped, anything malformed is an error."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").option("quote", "").csv(path)


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """Coverage rows with page as a number and status taken apart: state, and the document or reason in parentheses."""
    rows = tsv(spark, path, COVERAGE)
    state = F.regexp_extract("status", r"^(pending|ace|restates|uncovered)", 1)
    return rows.select(
        "region", "file", F.regexp_extract("page", r"^p(\d+)$", 1).cast("int").alias("page"), F.split("section", " > ").alias("section"),
        F.when(state == "", F.raise_error(F.concat(F.lit("unknown status: "), "status"))).otherwise(state).alias("state"),
        F.nullif(F.regexp_extract("status", r"^\w+\((.*)\)$", 1), F.lit("")).alias("detail"),
    )


def running_markers(rows: DataFrame, marker: Column, part: str = "path", order: str = "line", name: str = "marker") -> DataFrame:
    """Adds the last marker at or before each line of its part; marker is a column that is null on other lines."""
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """(path, sentence, text) of one-sentence-a-line files."""
    return lines(spark, path).where("text <> ''").select("path", F.col("line").alias("sentence"), "text")


def clause_sites(spark: SparkSession, path: str) -> DataFrame:
    """Facts and rules, one a line, under '% S<n>: text' markers.

    Returns (path, line, sentence, kind, predicate, arguments, body): kind is fact or rule, arguments the text between the head's
    parentheses, body the text after the neck. Comments and blank lines are left out.
    """
    marked = marked_lines(spark, path, F.nullif(F.regexp_extract("text", r"^% S(\d+):", 1), F.lit("")), "sentence")
    kept = marked.where("text not like '\\%%' and trim(text) <> ''")
    body = F.nullif(F.regexp_extract("text", r"^.*?\) :- (.*)\.\s*$", 1), F.lit(""))
    head = F.regexp_extract("text", r"^(.*?)(?: :- .*)?\.\s*$", 1)
    return kept.select(
        "path", "line", F.col("sentence").cast("int").alias("sentence"), F.when(body.isNull(), "fact").otherwise("rule").alias("kind"),
        F.regexp_extract(head, r"^([a-z]\w*)", 1).alias("predicate"), F.regexp_extract(head, r"^[a-z]\w*\((.*)\)$", 1).alias("arguments"), body.alias("body"),
    )


def unique_or_fail(df: DataFrame, *keys: str) -> DataFrame:
    """df, with an error at run time where a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.concat_ws("/", *keys)))).otherwise(F.lit(True)).cast("boolean")).drop("__n")
