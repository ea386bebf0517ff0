"""Passages in texts: location, alignment and lexical scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.strings import folded, occurrences
from ferrule.sources.tables import staged, staged_and_seen

#: Rows of a counted table that may be broadcast.
BROADCAST_ROWS = 500_000


def _window_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit value for each run of k bytes, put together from runs of doubled length."""
    have, size, power = text.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    out, width, rest = have, 0, k
    while rest:
        if rest & 1:
            m = len(text) - width - size + 1
            out, width = (out[:m] * np.uint64(power) + have[width : width + m] if width else have), width + size
        rest >>= 1
        if rest:
            m = len(text) - 2 * size + 1
            have, size, power = have[:m] * np.uint64(power) + have[size : size + m], 2 * size, power * power % (1 << 64)
    return out


def _windows(rows: DataFrame, sizes: list[int], known: dict[int, np.ndarray] | None) -> DataFrame:
    """(id, k, h): the windows of sizes k of each text of rows (id, text binary), by hash and once a row; where known lists the hashes of a size in order, only those."""
    step, shift = 1 << 20, np.uint64(42)
    mixed = lambda h: (h * np.uint64(0xBF58476D1CE4E5B9)) >> shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {}
        for k, hashes in (known or {}).items():
            marks[k] = np.zeros(1 << 22, bool)
            marks[k][mixed(hashes)] = True
        for batch in batches:
            at, ks, hs = [], [], []
            for i, value in enumerate(batch.column(1)):
                text = np.frombuffer(value.as_buffer() or b"", np.uint8)
                for k in sizes:
                    found = []
                    for a in range(0, len(text) - k + 1, step):  # a long text costs a step's memory
                        h = _window_hashes(text[a : a + step + k - 1], k)
                        if known is not None:
                            h = h[marks[k][mixed(h)]]
                            h = h[np.isin(h, known[k])]
                        found.append(h)
                    h = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                    at.append(np.full(len(h), i))
                    ks.append(np.full(len(h), k, np.int32))
                    hs.append(h)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(ks)), pa.array(np.concatenate(hs).view(np.int64))], [batch.schema.names[0], "k", "h"])

    return rows.mapInArrow(run, rows.select(rows.columns[0], F.lit(0).alias("k"), F.lit(0).cast("long").alias("h")).schema)


def located(pages: DataFrame, passages: DataFrame, page_text: str, passage_text: str, page_id: str, passage_id: str, seed: int = 24) -> DataFrame:
    """(page_id, passage_id, at): pages that hold a whole passage, both folded; at is the 0-based offset in the folded page.

    A passage is looked for only in pages that hold its first `seed` folded bytes as one of their windows. Windows are kept by hash, and
    only those that some passage begins with survive the join, so the product of pages and passages is never formed. Passages shorter than
    seed use a window of their own length. Rows without a text find nothing; a text is folded again only where a passage may stand.
    """
    wanted = passages.select(F.col(passage_id), folded(F.col(passage_text)).alias("needle")).where("needle <> ''")
    head = F.substr(F.col("needle").cast("binary"), F.lit(1), F.lit(seed))
    wanted, seen = staged_and_seen(wanted.withColumn("head", head).withColumn("k", F.octet_length("head")), "passages", n=F.count("*"))
    sizes = sorted(r.k for r in wanted.select("k").distinct().collect())  # at most `seed` rows
    parts = [_windows(wanted.where(F.col("k") == k).select(passage_id, "head"), [k], None) for k in sizes]
    heads = staged(reduce(DataFrame.unionByName, parts) if parts else wanted.select(passage_id, "k", F.lit(0).cast("long").alias("h")), "passage-heads")
    few = seen["n"] <= BROADCAST_ROWS
    # Up to BROADCAST_ROWS heads are known to the tasks, and then no window leaves its task but those that begin a passage.
    known = None
    if few:
        table = heads.select("k", "h").distinct().toArrow()
        ks, hs = table.column("k").to_numpy(), table.column("h").to_numpy().view(np.uint64)
        known = {k: np.sort(hs[ks == k]) for k in sizes}
    hay = pages.where(F.col(page_text).isNotNull()).select(F.col(page_id), folded(F.col(page_text)).cast("binary").alias("hay"))
    candidates = _windows(hay, sizes, known).join(F.broadcast(heads) if few else heads, ["k", "h"]).select(page_id, passage_id).distinct()
    candidates, met = staged_and_seen(candidates, "passage-candidates", n=F.count("*"))
    needles = wanted.select(passage_id, "needle")
    pairs = candidates.join(F.broadcast(needles) if few else needles, passage_id)
    found = pages.select(page_id, F.col(page_text).alias("__text")).join(F.broadcast(pairs) if met["n"] <= BROADCAST_ROWS else pairs, page_id)
    at = F.instr(folded(F.col("__text")), F.col("needle")) - 1
    return found.withColumn("at", at).where("at >= 0").select(page_id, passage_id, "at")


def longest_continuation(hay: Column, needle: Column, least: int = 20) -> Column:
    """Length of the longest beginning of needle, shorter than it and of at least `least` characters, that ends hay; 0 where there is none.

    Only places where the first `least` characters of needle stand in hay's end are tried.
    """
    top = F.least(F.length(hay), F.length(needle) - 1)
    tail = F.right(hay, F.greatest(top, F.lit(0)))
    sizes = F.transform(occurrences(tail, F.left(needle, F.lit(least))), lambda i: F.length(tail) - i)  # long ones first
    return F.when(top >= least, F.coalesce(F.get(F.filter(sizes, lambda n: F.right(hay, n) == F.left(needle, n)), F.lit(0)), F.lit(0))).otherwise(0)


def in_order(page: Column, sentences: Column) -> Column:
    """Whether every sentence stands in the page, each after the one before."""

    def step(rest: Column, s: Column) -> Column:
        at = F.instr(rest, s)
        return F.when(at > 0, F.substr(rest, at + F.length(s)))  # null from the first sentence that is missing

    return F.aggregate(sentences, page, step).isNotNull()


def segments(rows: DataFrame, key: str, text: str, spans: str) -> DataFrame:
    """Cut a text along spans (array<struct<start, end, grp>>, 0-based code points, sorted, apart): (key, ord, grp, piece).

    What lies between spans comes out with a null grp; the pieces put together are the text again.
    """
    piece = lambda a, b, g: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), g.cast("int").alias("grp"))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"].cast("int")))  # where the piece before each span ends, then the last end
    none = F.lit(None)

    def cut(s: Column, k: Column) -> Column:
        before = F.get(ends, k)
        return F.when(s["start"] > before, F.array(piece(before, s["start"], none), piece(s["start"], s["end"], s["grp"]))).otherwise(F.array(piece(s["start"], s["end"], s["grp"])))

    last = F.element_at(ends, -1)
    rest = F.when(F.length(text) > last, F.array(piece(last, F.length(text), none))).otherwise(F.array().cast("array<struct<start:int,end:int,grp:int>>"))
    pieces = rows.withColumn("__c", F.concat(F.flatten(F.transform(spans, cut)), rest))
    return pieces.select(key, text, F.posexplode("__c").alias("ord", "c")).select(key, "ord", "c.grp", F.substr(F.col(text), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("piece"))


def lexical_score(label_words: Column, text_words: Column, phrase: Column, phrase_weight: int = 1000) -> Column:
    """phrase_weight for a whole phrase, 320 for each label word in the text, and up to 120 for the share of the text's words that are met."""
    shared = F.size(F.filter(label_words, lambda w: F.array_contains(text_words, w)))
    return F.when(phrase, F.lit(phrase_weight)).otherwise(F.lit(0)) + 320 * shared + F.round(F.lit(120) * shared / F.greatest(F.size(text_words), F.lit(1))).cast("int")
