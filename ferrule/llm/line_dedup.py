"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import free_names, looked_up, staged_and_seen, unstage

#: Rows from which a host, a line of a host or a text counts as a hot one.
HOT = 1000


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def drop_boilerplate_lines(
    docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.05, min_pages: int = 3
) -> DataFrame:
    """Drop lines that stand on too large a share of their host's pages.

    A line is what lies between newlines, compared without spaces, tabs and carriage returns
    at its ends. A host's pages are its distinct texts, so a page that was copied many times counts once
    and copies cannot make their own lines look like boilerplate. A line goes where
    it is on at least min_pages of the host's pages and pages_with_line / pages > max_ratio.

    Returns all columns of docs with text replaced, plus n_lines and n_dropped (long). A null host is a
    host of its own; a null text stays null with 0 lines; blank lines are neither counted nor dropped;
    a text whose lines all go becomes empty, and its row stays. Repeated rows stay repeated. Columns of
    docs named n_lines or n_dropped are replaced; others, whatever their names, are carried along.

    Only hashes of lines are grouped, with partial counts before the shuffle; the totals of hot hosts, the verdicts of hot lines and the lines of
    texts with many copies are broadcast, counted first. Texts move at most once, in the last join, which has one row for each changed page on its
    other side.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    body, site = F.col(f"`{text}`"), F.col(f"`{host}`")
    lines = F.split(body, "\n", -1)
    hashes = F.transform(lines, lambda x: F.when(_key(x) != "", F.xxhash64(_key(x))))
    # A host's key is its text after an h, and n for null.
    host_key, page_key = F.coalesce(F.concat(F.lit("h"), site.cast("string")), F.lit("n")), F.xxhash64(body, F.length(body))
    pages = (
        docs.where(body.isNotNull())
        .select(host_key.alias("h"), page_key.alias("t"), F.array_compact(F.array_distinct(hashes)).alias("l"))
        .groupBy("h", "t")
        .agg(F.first("l").alias("l"), F.count("*").alias("copies"))
    )
    each = pages.select("h", "t", "copies", F.explode("l").alias("x"))
    totals = pages.groupBy(F.col("h").alias("site")).agg(F.count("*").alias("n"))
    totals, seen = staged_and_seen(totals, "lines-hosts", n=F.count("*"), hot=F.count_if(F.col("n") >= HOT))
    counted = each.groupBy("h", "x").agg(F.count("*").alias("k")).where(F.col("k") >= min_pages)
    bad = looked_up(counted, totals, F.col("h"), "site", F.concat(F.lit("~"), F.col("x").cast("string")), F.col("n") >= HOT, seen).where(F.col("k") > F.lit(max_ratio) * F.col("n"))
    line = lambda: F.concat(F.col("x").cast("string"), F.lit("/"), F.col("h"))
    bad, seen = staged_and_seen(bad.select(line().alias("line"), "k"), "lines-bad", n=F.count("*"), hot=F.count_if(F.col("k") >= HOT))
    found = looked_up(each, bad, line(), "line", F.concat(F.lit("~"), F.col("t").cast("string"), F.lit("/"), F.col("x").cast("string")), F.col("k") >= HOT, seen).where("k is not null")
    drops = found.groupBy("h", "t").agg(F.collect_set("x").alias("gone"), F.max("copies").alias("copies"))
    page = lambda h, t: F.concat(t.cast("string"), F.lit("/"), h)
    drops, seen = staged_and_seen(drops.select(page(F.col("h"), F.col("t")).alias("page"), "gone", "copies"), "lines-pages", n=F.count("*"), hot=F.count_if(F.col("copies") >= HOT))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), host_key.alias("h"), page_key.alias("t"), F.monotonically_increasing_id().cast("string").alias("nth"))
    out = looked_up(rows, drops, page(F.col("h"), F.col("t")), "page", F.concat(F.lit("~"), F.col("nth")), F.col("copies") >= HOT, seen)
    unstage(totals, bad)
    body = F.col("row").getField(text)
    lines = F.split(body, "\n", -1)
    gone = lambda x: (_key(x) != "") & F.array_contains(F.col("gone"), F.xxhash64(_key(x)))
    kept = F.filter(lines, lambda x: ~gone(x))
    n = F.coalesce(F.size(F.when(body.isNotNull(), lines)), F.lit(0))
    cleaned = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(kept, "\n"))
    new_text, lines_in, lines_out = free_names(docs, "new_text", "lines_in", "lines_out")
    done = out.select(
        "row", cleaned.alias(new_text), F.when(body.isNull(), F.lit(0)).otherwise(n).cast("long").alias(lines_in), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n - F.size(kept)).cast("long").alias(lines_out)
    )
    return done.select(*[(F.col(new_text) if c == text else F.col("row").getField(c)).alias(c) for c in keep], F.col(lines_in).alias("n_lines"), F.col(lines_out).alias("n_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5")
    )


OP7_SQL = """
with l as (
  select doc_id, source, text, pos, unnest(string_split(text, chr(10))) as line
  from (select *, 0 as pos from documents where text is not null)
), k as (select *, trim(line, ' ' || chr(9) || chr(13)) as key from l),
tot as (select source, count(distinct text) as n from documents where text is not null group by source),
cnt as (select source, key, count(distinct text) as c from k where key <> '' group by source, key),
bad as (select cnt.source, key from cnt join tot on cnt.source is not distinct from tot.source
        where c >= 3 and c > 0.05::double * n),
d as (
  select doc_id, source, text, generate_subscripts(a, 1) as i, unnest(a) as line
  from (select *, string_split(text, chr(10)) as a from documents where text is not null)
), m as (
  select d.*, bad.key is not null as gone from d left join bad
  on d.source is not distinct from bad.source and trim(d.line, ' ' || chr(9) || chr(13)) = bad.key
)
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped,
       length(coalesce(string_agg(line, chr(10) order by i) filter (not gone), ''))::bigint as n_chars_kept,
       md5(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as text_md5
from m group by doc_id
union all
select doc_id, 0::bigint, 0::bigint, null, null from documents where text is null
"""
