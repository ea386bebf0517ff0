"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import BROADCAST_ROWS, WORD, staged, staged_and_seen, unstage

CAP = 3
#: Sizes that are rounded one after another, each correcting the error so far.
SIZES_A_BLOCK = 1000


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _weighted(sizes: DataFrame) -> DataFrame:
    """sizes with weight: 1, 2, 3, 1, 2, 3, ... along the sources in code-point order, null last. Ranges of sources are numbered apart, then offset by the ranges before."""
    partitions = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(sizes.repartitionByRange(partitions, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    # One row for each range, of which there are as many as shuffle partitions.
    before = dealt.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return dealt.join(F.broadcast(before), "range").withColumn("weight", (F.col("before") + own - 1) % 3 + 1).drop("range", "before")


def water_filled(sizes: DataFrame, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """(source, total) to (source, total, target): shares by weights 1, 2, 3, ..., held to cap * total, the excess reshared by weight.

    At a level each source takes level * weight, or its room, cap * total, if that is less. Given which sources are full, the level that uses everything
    up follows; it only rises as more become full, so rounds of one aggregate end when no further source does.
    """
    ranked = staged(_weighted(sizes).withColumn("room", F.lit(float(cap)) * F.col("total")), "mix-weights")
    wanted, level = (ranked.agg(F.sum("total")).first()[0] or 0) * share, 0.0
    while True:
        full = F.col("room") <= F.lit(level) * F.col("weight")
        held, rest = ranked.agg(F.sum(F.when(full, F.col("room"))), F.sum(F.when(~full, F.col("weight")))).first()
        after = (wanted - (held or 0.0)) / rest if rest else level
        if after <= level:
            break
        level = after
    return ranked.select("source", "total", F.least(F.col("room"), F.lit(level) * F.col("weight")).alias("target"))


def _rate(lam: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def tilts(hist: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = 90, tolerance: float = 1e-7) -> DataFrame:
    """(source, lam) with sum(n * size * min(cap, exp(lam * x))) = target for each source.

    hist has (source, size, n, x). The dual is convex and separates by source. One Newton step for all sources is one
    aggregate over the histogram; a bracket keeps each multiplier where its gradient changes
    sign, and its middle is taken where Newton leaves it. State, one row per source, is staged every three steps. A source that has not come to its
    target within `steps` is an error.
    """
    spread = hist.where("size > 0").groupBy(F.col("source").alias("s")).agg(F.sum(F.col("n") * F.col("size")).alias("all"), F.min("x").alias("least"))
    state = staged(
        targets.join(spread, _same("s", "source")).select(
            "source", "target", F.lit(0.0).alias("lam"), (F.lit(-60.0) / F.col("least")).alias("lo"), (F.lit(2.0) / F.col("least")).alias("hi"),
            (F.lit(cap) * F.col("all") * (1 - 1e-9) <= F.col("target")).alias("full"), (F.lit(cap) * F.col("all") * (1 - 1e-9) <= F.col("target")).alias("done"),
        ),
        "mix-dual",
    )
    bars = hist.withColumnRenamed("source", "s")

    def step(state: DataFrame) -> DataFrame:  # reads state once, so three steps are three joins and no more
        rate = _rate(F.col("lam"), F.col("x"), cap)
        mass = F.col("n") * F.col("size") * rate
        carried = [F.any_value(c).alias(c) for c in ("target", "lam", "lo", "hi", "full", "done")]
        sums = (
            bars.join(state, _same("s", "source"))
            .groupBy("source")
            .agg(*carried, F.sum(mass).alias("g"), F.sum(F.when(rate < cap, mass * F.col("x")).otherwise(0.0)).alias("h"))
        )
        gap = F.when(~F.col("done"), F.col("g") - F.col("target"))
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.nullif(F.col("h"), F.lit(0.0))
        next_lam = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        settled = F.col("done") | (F.abs(gap) <= F.lit(tolerance) * F.col("target"))
        return sums.select(
            "source", "target", F.when(settled, F.col("lam")).otherwise(next_lam).alias("lam"), F.coalesce(lo, "lo").alias("lo"), F.coalesce(hi, "hi").alias("hi"), "full", settled.alias("done")
        )

    for _ in range(0, steps, 3):
        after, seen = staged_and_seen(step(step(step(state))), "mix-dual", left=F.count_if(~F.col("done")))
        unstage(state)
        state = after
        if not seen["left"]:
            return state.select("source", F.when(F.col("full"), F.col("hi")).otherwise(F.col("lam")).alias("lam"))
    raise RuntimeError(f"{seen['left']} sources did not come to their targets in {steps} steps")


def whole_copies(groups: DataFrame, cap: int = CAP, block: int = SIZES_A_BLOCK) -> DataFrame:
    """(source, size, n, rate) to (source, size, n, k): k whole copies dealt among the n documents of a size.

    From large sizes to small, each k brings the words taken so far nearest to the words wanted so far. A source's sizes are cut into
    blocks, counted from the smallest; blocks are rounded apart, but for the block of the smallest sizes, which starts with what the others have left and so
    ends about half the smallest size from the target. A source has as many sizes as its documents have different numbers of words.
    """
    ranked = groups.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("source").orderBy("size")) - 1) / block))
    listed = ranked.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        owed = acc["owed"] + x["size"] * x["n"] * x["rate"]
        k = F.least(F.lit(cap) * x["n"], F.greatest(F.lit(0).cast("long"), F.round(owed / F.greatest(x["size"], F.lit(1))).cast("long")))
        return F.struct((owed - k * x["size"]).alias("owed"), F.concat(acc["ks"], F.array(k)).alias("ks"))

    def rounded(rows: DataFrame, start: Column) -> DataFrame:
        return rows.withColumn("done", F.aggregate("g", F.struct(start.alias("owed"), F.array().cast("array<bigint>").alias("ks")), step))

    first = rounded(listed.where("block > 0"), F.lit(0.0))
    owed = first.groupBy(F.col("source").alias("s")).agg(F.sum("done.owed").alias("owed"))
    last = rounded(listed.where("block = 0").join(owed, _same("source", "s"), "left"), F.coalesce("owed", F.lit(0.0)))
    every = first.select("source", "g", "done").unionByName(last.select("source", "g", "done"))
    return every.select("source", F.explode(F.arrays_zip(F.col("g").alias("g"), F.col("done.ks").alias("ks"))).alias("z")).select("source", "z.g.size", "z.g.n", F.col("z.ks").alias("k"))


def mix_sources(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: int = CAP, share: float = 1.0,
    carry: list[str] | None = None, rows_per_chunk: int = 20_000,
) -> DataFrame:
    """Copies of each document so that each source's words come near its target.

    A document's size is its number of words (runs without ASCII white space; null text: 0). Sources in
    code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share `share` of all sizes by weight; a target
    stops at cap times its source's size and the excess is reshared.

    Entropy balancing: of all rates in [0, cap], those nearest to 1 in relative entropy that meet each source's word
    constraint are min(cap, exp(lam * size / mean size)); Newton steps on the convex dual find lam. Documents
    of one source and size share a rate, so the dual is solved, and rates are rounded, on the histogram
    of (source, size); then the copies of a size are dealt to its documents in the order of a hash of their id.

    Returns doc_id, the columns in carry (None: all of docs), and size, source_size, target, copies, taken
    = copies * size. Columns of docs with those names are replaced; other names do not matter. Null ids and repeated rows
    are documents like any other; a null source is a source; no rows give no rows. Reruns agree. Sizes are counted once, and staged with
    what is carried. A size with more documents than rows_per_chunk is numbered in chunks of the hash, so no task gathers a source.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    names = [c for c in dict.fromkeys(docs.columns if carry is None else [doc_id, *carry]) if c.lower() not in made]
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    ident = F.col(f"`{doc_id}`")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{source}`").alias("s"), words.alias("z"), F.xxhash64(ident).alias("h"), ident.alias("id"))
    base = staged(base, "mix-sizes")
    counts = staged(base.groupBy(F.col("s").alias("source"), F.col("z").alias("size")).agg(F.count("*").alias("n")), "mix-counts")
    sums = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("docs"))
    targets = staged(water_filled(sums.select("source", "total"), cap, share).join(sums.select(F.col("source").alias("s"), "docs"), _same("s", "source")).drop("s"), "mix-targets")
    hist = staged(
        counts.alias("c").join(targets.alias("t"), _same("c.source", "t.source"))
        .select("c.source", "c.size", "c.n", (F.col("c.size") * F.col("t.docs") / F.greatest(F.col("t.total"), F.lit(1))).alias("x")),
        "mix-histogram",
    )
    lam = tilts(hist, targets.select("source", "target"), cap)
    rated = hist.alias("h").join(lam.alias("l"), _same("h.source", "l.source"), "left").select("h.source", "h.size", "h.n", F.coalesce(_rate(F.col("lam"), F.col("x"), cap), F.lit(1.0)).alias("rate"))
    dealt = whole_copies(rated, cap).alias("g").join(targets.alias("t"), _same("g.source", "t.source")).select(
        F.col("g.source").alias("gs"), F.col("g.size").alias("gz"), F.col("g.n").alias("n"), F.col("k").alias("total_copies"), F.col("t.total").alias("source_size"), "target"
    )
    dealt, seen = staged_and_seen(dealt, "mix-dealt", n=F.count("*"), large=F.count_if(F.col("n") > rows_per_chunk))
    # A size's documents are dealt into chunks of about rows_per_chunk by the hash of their id; at most rows / rows_per_chunk sizes have more than one.
    large = dealt.where(F.col("n") > rows_per_chunk).select(F.col("gs").alias("ls"), F.col("gz").alias("lz"), F.ceil(F.col("n") / rows_per_chunk).alias("chunks"))
    large = F.broadcast(large) if seen["large"] <= BROADCAST_ROWS else large
    chunked = base.join(large, _same("s", "ls") & (F.col("z") == F.col("lz")), "left").withColumn("chunk", F.coalesce(F.pmod(F.shiftrightunsigned("h", 32), F.col("chunks")), F.lit(0)))
    ahead = (
        chunked.where(F.col("chunks").isNotNull()).groupBy("s", "z", "chunk").agg(F.count("*").alias("m"))
        .select(F.col("s").alias("os"), F.col("z").alias("oz"), F.col("chunk").alias("oc"), (F.sum("m").over(Window.partitionBy("s", "z").orderBy("chunk")) - F.col("m")).alias("ahead"))
    )
    ahead, before = staged_and_seen(ahead, "mix-chunks", n=F.count("*"))
    ahead = F.broadcast(ahead) if before["n"] <= BROADCAST_ROWS else ahead
    numbered = chunked.withColumn("r", F.row_number().over(Window.partitionBy("s", "z", "chunk").orderBy("h", "id")))
    ranked = numbered.join(ahead, _same("s", "os") & (F.col("z") == F.col("oz")) & (F.col("chunk") == F.col("oc")), "left").withColumn("r", F.col("r") + F.coalesce("ahead", F.lit(0)))
    joined = ranked.join(F.broadcast(dealt) if seen["n"] <= BROADCAST_ROWS else dealt, _same("s", "gs") & (F.col("z") == F.col("gz")))
    share_of = lambda r: F.floor(r * F.col("total_copies") / F.col("n"))
    copies = (share_of(F.col("r")) - share_of(F.col("r") - 1)).cast("long")
    unstage(counts, targets, hist)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("z").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("z")).alias("taken"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, carry=[])
