"""Removal of word windows that earlier documents hold too, found level by level: what repeats at one length alone is looked at at twice that length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain as laid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import BROADCAST_ROWS, free_names, staged, staged_and_seen, unstage

#: A level of more than twice as many words has a level below it.
SHORTEST = 6
#: A level's filter has so many bits for each repeated window, and no more than MOST_BITS: then it lets more through, which the last level decides all the same.
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 29
#: Documents from which a repeated window, or text, counts as a hot one, and the most groups that the documents of a hot one are dealt to.
HOT, PARTS = 1000, 4096
#: Words that a task holds at once, but for a longer document.
WORDS_AT_ONCE = 1 << 18
#: Documents without an id take their places among this many largest longs, by a hash of the text.
NO_ID = 1 << 40


def levels(window: int) -> list[int]:
    """Lengths from the lowest to the window, two at least but for a single word: each is twice the one before it, or one less."""
    out = [window]
    while out[0] > SHORTEST * 2 or out == [window] and window > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _mixed(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    first, second, third = (np.uint64(x) for x in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x94D049BB133111EB))[lane])
    x = a * first + ((b << np.uint64(31)) | (b >> np.uint64(33))) * second
    x ^= x >> np.uint64(29)
    x *= third
    return x ^ (x >> np.uint64(32))


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(len(x) - by, 0)] = x[by:]
    return out


def _longer(x: np.ndarray, have: int, want: int, lane: int) -> np.ndarray:
    """Names of windows of `want` words from those of `have`, two of which cover it: the one at its start and the one at its end."""
    while have < want:
        step = min(have, want - have)
        x, have = _mixed(x, _ahead(x, step), lane), have + step
    return x


def _least_ahead(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the least of x[i : i + n] for each i (the first of equals), n no more than what is left behind i."""
    at, have = np.arange(len(x)), 1
    while have < n:
        step = min(have, n - have)
        other = at.copy()
        other[: max(len(x) - step, 0)] = at[step:]
        at = np.where(x[other] < x[at], other, at)
        have += step
    return at


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each row) for parts of a column of texts; a word is a maximal run of anything but ASCII white space."""
    held, first, n = [], 0, 0
    for k, text in enumerate(texts.cast(pa.binary())):
        words = text.as_py().split() if text.is_valid else []
        held.append(words)
        n += len(words)
        if n >= WORDS_AT_ONCE:
            yield first, held
            held, first, n = [], k + 1, 0
    if held:
        yield first, held


class _Windows:
    """Windows of some documents laid end to end: names by level, and how many words are left from each place to its document's end."""

    def __init__(self, docs: list[list[bytes]]):
        self.lengths = np.array([len(x) for x in docs], np.int64)
        n = int(self.lengths.sum())
        self.words = np.fromiter(map(xxhash.xxh3_64_intdigest, laid.from_iterable(docs)), np.uint64, n)
        ends = np.cumsum(self.lengths)
        self.doc = np.repeat(np.arange(len(docs)), self.lengths)
        self.room = np.repeat(ends, self.lengths) - np.arange(n)

    def names(self, length: int, lane: int = 0) -> np.ndarray:
        x, have = self.words, 1
        for want in levels(length):
            x, have = _longer(x, have, want, lane), want
        return x

    def candidates(self, chain: list[int], filters: list[np.ndarray]) -> np.ndarray:
        """Whether a window of the level after the filters may repeat, by place: of the shorter windows inside it the one of the least name must, level by level."""
        good = self.room >= chain[len(filters)]
        for length, longer, bits in zip(chain, chain[1:], filters):
            least = _least_ahead(self.names(length), longer - length + 1)
            inside = has_bit(bits, self.names(length)) & (self.room >= length)
            good &= inside[least]
        return good

    def chosen(self, chain: list[int], filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(document, name), each once, of this level's windows that are the least inside a longer window of the next level that may repeat."""
        length, longer = chain[len(filters)], chain[len(filters) + 1]
        here = self.names(length)
        may = self.candidates(chain, filters)
        wide = np.flatnonzero(self.room >= longer)
        at = np.unique(_least_ahead(here, longer - length + 1)[wide])
        at = at[may[at]]
        return _once(self.doc[at], here[at])


def _once(doc: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((names[0], doc))
    cols = [x[order] for x in (doc, *names)]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])
    return tuple(c[new] for c in cols)


def has_bit(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names & np.uint64(len(bits) * 64 - 1)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _rows(docs: DataFrame, chain: list[int], filters: list[Broadcast]) -> DataFrame:
    """(doc, a) of a level's chosen windows."""
    filters = list(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        for batch in batches:
            ids = np.asarray(batch.column("doc"))
            for first, words in _pieces(batch.column("text")):
                doc, a = _Windows(words).chosen(chain, bits)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:][doc]), pa.array(a.view(np.int64))], ["doc", "a"])

    return docs.mapInArrow(run, "doc long, a long")


def _last_rows(docs: DataFrame, chain: list[int], filters: list[Broadcast], hot: Broadcast | None, parts: int) -> DataFrame:
    """(doc, a, b, part) of all windows that may repeat, each once a document; part is 0, or from 1 to parts by the document where many documents may hold the window."""
    filters = list(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        for batch in batches:
            ids = np.asarray(batch.column("doc"))
            for first, words in _pieces(batch.column("text")):
                w = _Windows(words)
                may = np.flatnonzero(w.candidates(chain, bits))
                many = np.ones(len(may), bool)
                if len(chain) > 1:
                    shorter = w.names(chain[-2])
                    at = _least_ahead(shorter, chain[-1] - chain[-2] + 1)[may]
                    many = has_bit(hot.value, shorter[at]) if hot else ~many
                doc, a, b, many = _once(w.doc[may], w.names(chain[-1])[may], w.names(chain[-1], 1)[may] & np.uint64(0x7FFFFFFF), many)
                doc = ids[first:][doc]
                part = np.where(many, _mixed(doc.view(np.uint64), doc.view(np.uint64), 1) % np.uint64(parts) + np.uint64(1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a.view(np.int64)), pa.array(b.astype(np.int32)), pa.array(part.astype(np.int32))], ["doc", "a", "b", "part"])

    return docs.mapInArrow(run, "doc long, a long, b int, part int")


def _lost(windows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc, a) of windows that a smaller document holds as well, and a staged table they are read from.

    A document loses to any smaller one of its part; the least of each part of a hot window meet once more.
    """
    w = Window.partitionBy("a", "b", "part").orderBy("doc")
    judged = windows.withColumn("gone", F.col("doc") > F.first("doc").over(w))
    if not parts:
        return judged.where("gone").select("doc", "a"), None
    judged = staged(judged.where("gone or part > 0"), "substrings-judged")
    left = judged.where("not gone").select("doc", "a", "b")
    late = left.join(left.groupBy("a", "b").agg(F.min("doc").alias("lo")), ["a", "b"]).where("doc > lo")
    return judged.where("gone").select("doc", "a").unionByName(late.select("doc", "a")), judged


def _copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc, d, e): documents whose whole text, by two digests, a smaller document has; and their number."""
    narrow = docs.select("doc", "d", "e")
    groups = narrow.groupBy("d", "e").agg(F.min("doc").alias("lo"), F.count("*").alias("k")).where("k > 1")
    groups, seen = staged_and_seen(groups, "substrings-groups", n=F.count("*"))
    known = F.broadcast(groups) if seen["n"] <= BROADCAST_ROWS else groups
    out, counted = staged_and_seen(narrow.join(known, ["d", "e"]).where("doc > lo").select("doc", "d", "e").distinct(), "substrings-copies", n=F.count("*"))
    unstage(groups)
    return out, counted["n"]


def bit_filter(repeated: DataFrame, n: int) -> np.ndarray:
    """Bits of the names in `a`: put together by the executors word by word, so the driver gets no more than the filter's size."""
    size = LEAST_BITS
    while size < min(n * BITS_EACH, MOST_BITS):
        size *= 2
    placed = repeated.select(F.expr(f"cast(shiftright(a & {size - 1}L, 6) as int)").alias("w"), F.expr("shiftleft(1L, cast(a & 63L as int))").alias("v"))
    words = placed.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("v")).view(np.uint64)
    return out


def _removed(words: list[bytes], lost: np.ndarray, window: int) -> np.ndarray:
    """Which words are covered by a window whose name is among the lost ones."""
    w = _Windows([words])
    start = np.isin(w.names(window), lost) & (w.room >= window)
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(start)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeated_windows(docs: DataFrame, window: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the words that are covered by a window (so many consecutive words) which also starts in a document of a smaller id.

    Levels: lengths are halved from the window down to one of 7 to 12 words, then taken from the shortest up. At each level windows that
    two documents hold are found by grouping names (hashes of words, then of two halves); only longer windows whose halves repeat are candidates
    of the next level, of twice the length, until none survive or the window itself is reached. Of the shorter windows inside a longer one only the one of the least
    name has to be counted, since equal longer windows have it in common: a quarter of all windows for 7 and 13 words. A level's outcome
    goes back to the texts as a bit filter of bounded size, which may let a window through but never holds one back; the last level compares names of 95 bits and decides.

    Returns docs' columns with text replaced by the kept words joined by one space, and n_words, n_removed (long); columns of docs with these
    names are replaced. Words are maximal runs of anything but ASCII white space, unchanged. A null text stays null with 0
    words; a text of fewer words than the window loses nothing; windows are judged on the input. Rows that share an id are one document, none of them
    smaller; a null id counts as larger than any other, and a hash of the text tells null ones apart. Ids are cast to long. Repeated rows stay repeated.

    Of equal texts only the one of the smallest id is searched; the others lose all they have, if it fills a window. Names of windows are shuffled once and judged in the order
    of ids; windows of HOT documents or more (known from the level before) are dealt to parts by the document, of which only the first of each part meet again. Texts move once, in the last join.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    spark, chain = docs.sparkSession, levels(window)
    body = F.col(f"`{text}`").cast("string")
    name = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(body), F.lit(NO_ID)))
    digests = F.xxhash64(body).alias("d"), F.xxhash64(F.lit(1), body).alias("e")
    texts = docs.select(name.alias("doc"), body.alias("text"), *digests).where("text is not null")
    copies, n_copies = _copies(texts)
    known = F.broadcast(copies) if n_copies <= BROADCAST_ROWS else copies
    plain = (texts.join(known, ["doc", "d", "e"], "left_anti") if n_copies else texts).select("doc", "text")
    filters: list[Broadcast] = []
    hot, parts, alive = None, 0, True  # alive: whether candidates survive
    for _ in chain[:-1]:
        shared = _rows(plain, chain, filters).groupBy("a").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("a", "k")
        shared, seen = staged_and_seen(shared, "substrings-level", n=F.count("*"), hot=F.count_if(F.col("k") >= HOT), most=F.max("k"))
        alive = seen["n"] > 0
        if alive:
            filters.append(spark.sparkContext.broadcast(bit_filter(shared, seen["n"])))
            parts = min(-(-seen["most"] // HOT), PARTS) if seen["hot"] else 0
            hot = spark.sparkContext.broadcast(bit_filter(shared.where(F.col("k") >= HOT), seen["hot"])) if parts else None
        unstage(shared)
        if not alive:
            break
    if len(chain) == 1:
        parts = 64  # of single words any may be hot
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    row, key, d, e, gone, copy = free_names(docs, "row", "key", "d", "e", "gone", "copy")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), body.alias(text), name.alias(key), digests[0].alias(d), digests[1].alias(e))
    if n_copies:
        out = out.join(known.select(F.col("doc").alias(key), F.col("d").alias(d), F.col("e").alias(e), F.lit(True).alias(copy)), [key, d, e], "left")
    else:
        out = out.withColumn(copy, F.lit(None).cast("boolean"))
    if alive:
        lost, _ = _lost(_last_rows(plain, chain, filters, hot, max(parts, 1)), parts)
        out = out.join(lost.groupBy(F.col("doc").alias(key)).agg(F.collect_set("a").alias(gone)), key, "left")
    else:
        out = out.withColumn(gone, F.lit(None).cast("array<long>"))

    @F.arrow_udf("string")
    def kept(texts: pa.Array, lost: pa.Array) -> pa.Array:
        out = []
        for t, x in zip(texts.cast(pa.binary()), lost):
            words = t.as_py().split() if t.is_valid else []
            if len(words) >= window:
                off = _removed(words, np.asarray(x.values).view(np.uint64), window)
                words = [w for w, drop in zip(words, off) if not drop]
            out.append(b" ".join(words) if t.is_valid else None)
        return pa.array(out, pa.binary()).cast(pa.string())

    # Only texts that lose words are sent to Python.
    spaced = F.btrim(F.regexp_replace(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+", " "))
    count = lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long")
    n = F.coalesce(count(F.col("spaced")), F.lit(0).cast("long"))
    left = F.when(F.col("copied") & (n >= window), F.lit("")).otherwise(F.coalesce("cut", "spaced"))
    cut = kept(F.when(F.col(gone).isNotNull(), F.col(f"`{text}`")), F.col(gone))
    out = out.select(F.col(row).alias("row"), spaced.alias("spaced"), cut.alias("cut"), F.coalesce(F.col(copy), F.lit(False)).alias("copied"))
    out = out.select("row", n.alias("n"), left.alias("left"))
    removed = F.col("n") - F.coalesce(count(F.col("left")), F.lit(0).cast("long"))
    return out.select(*[(F.col("left") if c == text else F.col("row").getField(c)).alias(c) for c in keep], F.col("n").alias("n_words"), removed.alias("n_removed"))


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP13_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), n as (select doc_id, words, len(words) as n from w),
s as (select doc_id, i, array_to_string(words[i : i + 12], ' ') as seq from (select *, unnest(range(1, n - 11)) as i from n where n >= 13)),
o as (select seq, min(doc_id) as lo from s group by seq having min(doc_id) < max(doc_id)),
l as (select distinct doc_id, i + k as place from (select s.doc_id, i, unnest(range(0, 13)) as k from s join o using (seq) where s.doc_id > lo)),
k as (
  select n.doc_id, string_agg(word, ' ' order by place) as kept, count(*) as n_kept
  from (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from n) n left join l using (doc_id, place) where l.place is null group by n.doc_id
)
select n.doc_id, n.n::bigint as n_words, (n.n - coalesce(n_kept, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from n left join k using (doc_id)
"""
