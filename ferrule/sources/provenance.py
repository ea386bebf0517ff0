"""Sources of provenance: archives, notes, labels, alignments, extractions, vocabularies, exported queries, graphs and evidence as JSON; and their sinks.

What breaks a format is an error at run time that names the place; nothing is skipped in silence.
"""

from __future__ import annotations

import gzip
import hashlib
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.sources.text import NOTE, SPAN, lines, running_markers, tsv, unique_or_fail

MEMBER = "archive string, member string, bytes long, sha256 string, content binary"
#: Labels that a review may give.
LABELS = ("approved", "rejected", "contested", "stale", "unreviewed")
NODE = "id string, kind string, label string, document string, sentence int"
EDGE = "id string, kind string, source string, target string, label string, document string, sentence int, line int, predicate string, scope int, inverse string"
SCOPE = "id string, chain array<string>, operator string, document string, sentence int, reference string"
GRAPH = f"schemaVersion int, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>, scopes array<struct<{SCOPE.replace(' ', ':').replace(',:', ',')}>>"
EVIDENCE = (
    "schemaVersion int, id string, label string, region struct<id:string,sourceFile:string,page:int,section:string>, source struct<text:string>, "
    "ace struct<text:string,sentences:array<struct<number:int,text:string>>>, alignment struct<unit:string,spans:array<struct<group:int,side:string,start:int,end:int,text:string>>>, "
    "projection struct<kept:string,dropped:string>, clauses array<struct<line:int,sentence:int,predicate:string,arity:int,kind:string,text:string>>"
)
CATALOG = "catalogVersion int, entries array<struct<id:string,provenance:string,goal:string,marksGoal:string,projection:array<string>>>"


def _checked(value: Column, good: Column, what: str, *where: Column) -> Column:
    """value where good holds, else an error that says what and where."""
    place = F.concat_ws(" ", F.lit(what), *[w.cast("string") for w in where])
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(place))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """The files in the tar.gz archives under path, a row each. A task streams its archives, one member in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("path").to_pylist():
                fs, at = pafs.FileSystem.from_uri(archive)
                with fs.open_input_stream(at, compression=None) as raw, gzip.open(raw) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
                    for member in tar:
                        if member.isfile():
                            content = tar.extractfile(member).read()
                            row = {"archive": archive, "member": member.name, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "content": content}
                            yield pa.RecordBatch.from_pylist([row], pa.schema([("archive", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())]))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).select("path").mapInArrow(run, MEMBER)


def verified_members(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """(member, status): ok, changed, missing from the archive, or unlisted, by the manifest's (sha256, member)."""
    have, want = members.select("member", F.col("sha256").alias("h")), manifest.select("member", F.col("sha256").alias("w"))
    status = F.when(F.col("w").isNull(), "unlisted").when(F.col("h").isNull(), "missing").when(F.col("h") == F.col("w"), "ok").otherwise("changed")
    return have.join(want, "member", "full").select("member", status.alias("status"))


def projection_notes(spark: SparkSession, path: str) -> DataFrame:
    """(document, region, kept, dropped), one row a document, no field empty."""
    rows = tsv(spark, path, NOTE)
    filled = lambda c: _checked(F.col(c), F.coalesce(F.col(c), F.lit("")) != "", f"empty {c} of", F.col("document")).alias(c)
    return unique_or_fail(rows.select("document", "region", filled("kept"), filled("dropped")), "document")


def release_labels(spark: SparkSession, path: str) -> DataFrame:
    """(document, label) of the manifest's label rows; other rows are not labels."""
    rows = lines(spark, path).where("text like 'label\t%'").select(F.split("text", "\t").alias("f"), "line")
    whole = rows.select(_checked(F.get("f", F.lit(1)), F.size("f") == 3, "label row", F.col("line")).alias("document"), F.get("f", F.lit(2)).alias("label"))
    return unique_or_fail(whole.select("document", _checked(F.col("label"), F.col("label").isin(*LABELS), "unknown label of", F.col("document")).alias("label")), "document")


def alignments(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """(document, grp, side, start, end, text) of alignment files, one a document, held against texts (document, side, text).

    Starts and ends are code points. A surface must stand where it says, spans of a side must not overlap, and each group must be on both sides.
    """
    document = F.regexp_extract(F.input_file_name(), r"([^/]+)\.tsv$", 1)
    rows = spark.read.schema(SPAN.split(", ", 1)[1]).option("sep", "\t").option("comment", "#").option("quote", "").option("mode", "FAILFAST").csv(path).select(document.alias("document"), "*")
    side = F.when(F.col("side") == "src", "source").when(F.col("side") == "ace", "ace")
    spans = rows.withColumn("side", _checked(side, side.isNotNull(), "side of", F.col("document"))).withColumn("end", F.col("start") + F.length("text"))
    held = spans.join(texts.select("document", "side", F.col("text").alias("whole")), ["document", "side"], "left")
    there = F.substr("whole", F.col("start") + 1, F.length("text")) == F.col("text")
    good = held.withColumn("text", _checked(F.col("text"), there, "no such span in", F.col("document"), F.col("start"))).drop("whole")
    order = Window.partitionBy("document", "side").orderBy("start", "end")
    good = good.withColumn("text", _checked(F.col("text"), F.coalesce(F.lag("end").over(order) <= F.col("start"), F.lit(True)), "overlapping span in", F.col("document"), F.col("start")))
    sides = F.size(F.collect_set("side").over(Window.partitionBy("document", "grp")))
    return good.withColumn("text", _checked(F.col("text"), sides == 2, "group on one side in", F.col("document"), F.col("grp"))).select("document", "grp", "side", "start", "end", "text")


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, region, page, label, payload): payloads of extraction files, after a header that a blank line ends.

    A payload follows its '[region | p<n> | label]' line. In files without any, payloads are the lines themselves, numbers and dots taken off, with region null.
    """
    marker = r"^\[([^\]| ]+) \| p([1-9][0-9]*) \| ([^\]]+)\]$"
    every = lines(spark, path)
    header = F.min(F.when(F.col("text") == "", F.col("line"))).over(Window.partitionBy("path"))
    body = every.withColumn("h", header).where("line > h").withColumn("m", F.col("text").rlike(marker))
    bracketed = F.max("m").over(Window.partitionBy("path"))
    before = F.lag("text").over(Window.partitionBy("path").orderBy("line"))
    rows = body.withColumn("b", bracketed).withColumn("above", F.when(F.col("b"), before)).where("not m and text <> '' and (not b or above rlike '^\\\\[[^\\\\]| ]+ \\\\| p[1-9]')")
    part = lambda n: F.nullif(F.regexp_extract(F.coalesce("above", F.lit("")), marker, n), F.lit(""))
    ordinal = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    payload = F.when(F.col("b"), F.col("text")).otherwise(F.regexp_replace("text", r"^[1-9][0-9]*\. ", ""))
    return rows.select("path", ordinal.alias("ordinal"), part(1).alias("region"), part(2).cast("int").alias("page"), part(3).alias("label"), payload.alias("payload"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, word, key) of vocabulary files; a short row has nulls."""
    f = F.split("text", "\t")
    part = lambda n: F.nullif(F.get(f, F.lit(n)), F.lit(""))
    return lines(spark, path).where("text <> ''").select("path", part(0).alias("kind"), part(1).alias("word"), part(2).alias("key"))


def qualifiers(words: DataFrame) -> DataFrame:
    return words.where("kind = 'qualifier' and word is not null").select("path", "word").distinct()


def scope_keys(words: DataFrame) -> DataFrame:
    return words.where("kind = 'scope' and key is not null").select("key").distinct()


def exported_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, goal, projected): the one projection line of each exported query file, taken apart."""
    shape = r"^'\$guideline_query_projection'\(goal\((.*)\),answers\((\[.*\])\)\)\.$"
    rows = lines(spark, path).where("text like '''$guideline_query_projection''(%'").withColumn("id", F.regexp_extract("path", r"([^/]+)\.pl$", 1))
    goal = F.regexp_extract("text", shape, 1)
    found = rows.select("id", _checked(goal, goal != "", "projection of", F.col("id")).alias("goal"), F.regexp_extract_all(F.regexp_extract("text", shape, 2), F.lit(r"answer\(([A-Z_]\w*)"), 1).alias("projected"))
    return unique_or_fail(found, "id")


def graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and scopes of property graphs written as JSON."""
    whole = spark.read.schema(GRAPH).option("multiLine", True).option("mode", "FAILFAST").json(path)
    flat = lambda c: whole.select(F.explode(c).alias("x")).select("x.*")
    return flat("nodes"), flat("edges"), flat("scopes")


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence documents, a file each."""
    return spark.read.schema(EVIDENCE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def corpus_index(documents: DataFrame) -> DataFrame:
    """(id, label, region, page, section) of evidence documents in the order of their ids, an error where one has no id or label."""
    named = _checked(F.col("id"), F.col("id").isNotNull() & F.col("label").isNotNull(), "document without id or label")
    return unique_or_fail(documents.select(named.alias("id"), "label", F.col("region.id").alias("region"), "region.page", "region.section"), "id").orderBy("id")


def question_catalog(spark: SparkSession, path: str, version: int, known: list[str]) -> DataFrame:
    """Entries of a catalogue of that version: every id of known once, no goal empty."""
    whole = spark.read.schema(CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(path)
    entries = whole.select(F.explode(_checked(F.col("entries"), F.col("catalogVersion") == version, "catalogue version", F.col("catalogVersion"))).alias("e")).select("e.*")
    wanted = entries.sparkSession.createDataFrame([(k,) for k in known], "known string")
    joined = unique_or_fail(entries, "id").join(wanted, F.col("id") == F.col("known"), "full")
    good = F.col("known").isNotNull() & F.col("id").isNotNull() & (F.col("goal") != "") & (F.col("marksGoal") != "")
    return joined.select(_checked(F.col("id"), good, "catalogue entry", F.coalesce("id", "known")).alias("id"), "provenance", "goal", "marksGoal", "projection")


def assembled(documents: DataFrame, clauses: DataFrame, notes: DataFrame, labels: DataFrame) -> DataFrame:
    """documents (document, ...) with their clauses in line order, note and label. Clauses, notes or labels of no document are an error."""
    for name, rows in (("clauses", clauses), ("notes", notes), ("labels", labels)):
        lost = rows.select("document").distinct().join(documents.select("document"), "document", "left_anti").orderBy("document").first()
        if lost is not None:
            raise ValueError(f"{name} of no document: {lost.document}")
    kept = [c for c in clauses.columns if c not in ("document", "line")]
    listed = clauses.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("line", *kept))).alias("clauses"))
    note = notes.select("document", F.struct("kept", "dropped").alias("projection"))
    return documents.join(listed, "document", "left").join(note, "document", "left").join(labels, "document", "left")


def write_json(df: DataFrame, path: str) -> DataFrame:
    """Writes df as JSON lines, nulls kept, and returns the manifest (path, bytes, sha256) of its files, read back from what was written."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def intact(spark: SparkSession, listed: DataFrame, path: str) -> DataFrame:
    """(path, intact): whether each listed file is still there and unchanged."""
    now = manifest(spark, path).select("path", F.col("sha256").alias("now"))
    return listed.join(now, "path", "left").select("path", F.coalesce(F.col("now") == F.col("sha256"), F.lit(False)).alias("intact"))


__all__ = [
    "alignments", "archive_members", "assembled", "corpus_index", "evidence", "exported_queries", "extractions", "graph_tables", "intact", "manifest", "projection_notes", "qualifiers", "question_catalog",
    "release_labels", "running_markers", "scope_keys", "verified_members", "vocabulary", "write_json",
]
