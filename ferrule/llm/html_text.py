"""Main text of HTML pages: structure first, then runs that a host repeats across its pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import BROADCAST_ROWS, runs, staged, staged_and_seen, unstage
from ferrule.llm.substring_dedup import bit_filter, has_bit

#: A tag from its name on. Quotes count after an equals sign only. Nothing is tried twice, so a failed match costs one pass to the end of the page.
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTR = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
#: Elements whose content is text up to their end tag, and whose text is not part of the page's.
RAW = frozenset("script style noscript iframe title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are not the page's text. Of EMBEDDED ones, those without an end tag are taken as empty.
EMBEDDED = frozenset("select option video audio object canvas svg template button dialog".split())
DROPPED = frozenset("nav footer aside form menu fieldset head".split()) | EMBEDDED
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Whole class or id names by which containers (HOLDERS) say what the structure cannot: adverts, notices, comments. Prose elements are never asked.
NAMED = frozenset("ad ads advert advertisement sponsored comments comment-list disqus_thread cookie-notice cookie-banner consent newsletter sidebar breadcrumbs related-posts share-buttons".split())
HOLDERS = frozenset("div section ul ol dl table".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_ARTICLES = frozenset("articlebody article-body article-content post-body post-content entry-content story-body".split())
#: What stands in every attribute that may say where an element stands.
_TELLING = re.compile("role|hidden|style|class|id|itemprop", re.I | re.A)
#: End tags, without regard to the case of A to Z.
_ENDS = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW | EMBEDDED}
#: Where a block stands.
ARTICLE, MAIN, OPEN, BOILER = 0, 1, 2, 3
#: So many words in a row, on enough distinct pages of a host, are a repeated run.
RUN = 6
#: Minima that stand for a page.
SKETCH = 16
_SALTS = np.array([xxhash.xxh64_intdigest(str(i)) for i in range(SKETCH)], np.uint64)
#: So many repeated suffixes are broadcast at once.
KEYS = 1_000_000
#: Pages of a host whose marks meet in one bucket.
PAGES_A_BUCKET = 512
#: Pages, and bytes of them, whose words are hashed at once.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4_000_000


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _place(name: str, raw: str, at: int) -> int:
    """Where the content of an element stands, given where the element itself does."""
    if at == BOILER or name in DROPPED:
        return BOILER
    if name == "header":
        return at if at in (ARTICLE, MAIN) else BOILER
    if raw and _TELLING.search(raw):
        a = _attributes(raw)
        role = a.get("role", "").lower()
        if role in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
            return BOILER
        named = {x.lower() for x in f"{a.get('class', '')} {a.get('id', '')}".split()}
        if name in HOLDERS and named & NAMED:
            return BOILER
        if at != ARTICLE and (a.get("itemprop") == "articleBody" or role == "article" or named & _ARTICLES):
            return ARTICLE
        if at == OPEN and role == "main":
            return MAIN
    if name == "article":
        return ARTICLE
    return MAIN if name == "main" and at == OPEN else at


class _Finder:
    """Searches forward in a page that remember what is not there any more, so that all of them together stay linear."""

    def __init__(self, page: str):
        self.page, self.gone, self.ends, self.quoted = page, set(), {}, True

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_tag(self, name: str, at: int) -> int:
        """Where the next end tag of that name (of RAW or EMBEDDED) is, -1 if none comes."""
        known = self.ends.get(name, 0)
        if 0 <= known < at:
            m = _ENDS[name].search(self.page, at)
            known = self.ends[name] = m.start() if m else -1
        return known

    def tag(self, at: int) -> tuple[str, str, str, int] | None:
        """(slash, name, attributes, end) of the tag whose name or slash is at `at`, where _TAG fails: quotes run to the page's end, so tags from there on end at the next >."""
        self.quoted = False
        end = self.find(">", at)
        if end < 0:
            return None
        slash = "/" if self.page[at] == "/" else ""
        m = re.compile(r"[^\s/>]+").match(self.page, at + len(slash))
        return slash, m[0], self.page[m.end() : end], end + 1


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(where, text) of a page's blocks in order; white space inside a block is one space, empty blocks are left out."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, list[int]] = {}  # where in the stack the open elements of each name are, and the blocks among them under ""
    where, parts, at = OPEN, [], 0
    page = page or ""
    finder = _Finder(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((where, text))
            parts.clear()

    def unwind(k: int) -> int:
        """The place outside of the k-th open element, which ends with all inside it."""
        if stack[k][1] != where:
            flush()
        place = stack[k][1]
        while len(stack) > k:
            name, _ = stack.pop()
            opened[name].pop()
            if name in BLOCK:
                opened[""].pop()
        return place

    while True:
        open_at = page.find("<", at)
        if open_at < 0:
            parts.append(page[at:])
            flush()
            return out
        if open_at > at:
            parts.append(page[at:open_at])
        m = _TAG.match(page, open_at + 1) if finder.quoted else None
        if m:
            slash, name, raw = m.groups()
            at = m.end()
        else:
            after = page[open_at + 1 : open_at + 2]
            if after in ("!", "?"):
                long = page.startswith("<!--", open_at)
                end = finder.find("-->", open_at + 4) + 2 if long and "-->" not in finder.gone else -1
                end = end if end > 1 else finder.find(">", open_at)  # a comment that nothing ends is over at the next >
                if end < 0:
                    parts.append("<")
                    at = open_at + 1
                else:
                    at = end + 1
                continue
            if not (after.isascii() and after.isalpha() or after == "/" and page[open_at + 2 : open_at + 3].isascii() and page[open_at + 2 : open_at + 3].isalpha()):
                parts.append("<")
                at = open_at + 1
                continue
            tag = finder.tag(open_at + 1)
            if tag is None:
                parts.append("<")
                at = open_at + 1
                continue
            slash, name, raw, at = tag
        name = name.lower()
        if slash:
            if name in BLOCK:
                flush()
            elif name in ("td", "th"):
                parts.append(" ")
            if opened.get(name):
                where = unwind(opened[name][-1])
            continue
        if name in RAW:
            end = finder.end_tag(name, at)
            close = finder.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if name in BLOCK:
            flush()
            while stack and stack[-1][0] == "head":
                where = unwind(len(stack) - 1)
            # A paragraph or item that was left open ends where the next block of its kind begins.
            if name in ("p", "li", "dt", "dd", "tr", *HEADINGS, "div", "ul", "ol", "table", "section"):
                inner = opened[""][-1] if opened.get("") else -1  # the innermost open block
                if inner >= 0 and (stack[inner][0] == "p" or stack[inner][0] == name and name in ("li", "dt", "dd", "tr")):
                    where = unwind(inner)
        elif name in ("br", "td", "th", "img"):
            parts.append(" ")
        if name in VOID or raw.endswith("/") or name in EMBEDDED and finder.end_tag(name, at) < 0:
            continue
        new = _place(name, raw, where)
        if new != where:
            flush()
        opened.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            opened.setdefault("", []).append(len(stack))
        stack.append((name, where))
        where = new


def _host(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts, one text after another, and where each text begins, the end last. Words stand between single spaces or newlines."""
    words = pc.split_pattern(pc.replace_substring(pa.array([t or None for t in texts], pa.large_string()), "\n", " "), " ")
    flat = words.flatten().dictionary_encode()
    known = np.array(flat.dictionary.to_pylist(), object)
    codes = hash_array(known, categorize=False)[flat.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    return codes, np.append(0, np.cumsum(pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)


def _mixed(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)
    return h ^ (h >> np.uint64(29))


def _suffixes(codes: np.ndarray, run: int, start: int = 0) -> np.ndarray:
    """A 64-bit value for the first `run` words of each suffix of at least that length."""
    n = len(codes) - run + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, start, np.uint64)
    for i in range(run):
        h = _mixed(h, codes[i : i + n])
    return h


class _Words:
    """The words of some pages as one array of codes, so that the suffixes of all of them are hashed at once; start: a number for each page's host."""

    def __init__(self, texts: list[str], start: np.ndarray):
        self.codes, self.cuts = _coded(texts)
        sizes = np.diff(self.cuts)
        self.page = np.repeat(np.arange(len(texts)), sizes)
        self.room = np.repeat(self.cuts[1:], sizes) - np.arange(len(self.codes))
        self.start = start

    def suffixes(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the suffixes of `run` words or more, and a 64-bit value for the first `run` words of each and its host."""
        at = np.flatnonzero(self.room >= run)
        h = self.start[self.page[at]]
        for i in range(run):
            h = _mixed(h, self.codes[at + i])
        return at, h

    def least(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the suffixes of `run` words or more, and the least value of the shorter runs inside each one's first `run` words; equal runs have equal ones."""
        short = max(1, run - 2)
        inner = np.zeros(len(self.codes), np.uint64)
        places, h = self.suffixes(short)
        inner[places] = h
        at = np.flatnonzero(self.room >= run)
        out = inner[at]
        for i in range(1, run - short + 1):
            out = np.minimum(out, inner[at + i])
        return at, out


def _sketch(codes: np.ndarray) -> list[int] | None:
    """Minima of SKETCH hashes over the 3-word runs of a page: two pages share as many of them as they share runs."""
    if not len(codes):
        return None
    grams = _suffixes(codes, min(3, len(codes)))
    return ((grams[:, None] ^ _SALTS) * np.uint64(0xD6E8FEB86659FD93)).min(0).view(np.int64).tolist()


def _best(places: bytes) -> int | None:
    """The place whose blocks are the main text, None where nothing is marked."""
    return ARTICLE if ARTICLE in places else MAIN if MAIN in places else None


def _main_text(places: bytes, text: str, covered: np.ndarray | None = None) -> str:
    """The blocks of a page's main text without the covered words; a marked part loses only blocks that are covered whole."""
    best, start, lines = _best(places), 0, []
    for place, line in zip(places, text.split("\n")):
        words = line.split(" ") if covered is not None else []
        drop = covered[start : start + len(words)] if covered is not None else None
        start += len(words)
        if place != best if best is not None else place == BOILER:
            continue
        if drop is None or not drop.any():
            lines.append(line)
        elif best is None:
            lines.append(" ".join(w for w, d in zip(words, drop) if not d))
        elif not drop.all():
            lines.append(line)
    return "\n".join(x for x in lines if x)


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of up to CHUNK_ROWS rows and CHUNK_BYTES bytes in a column of texts; a larger text is alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first, held = 0, 0
        for k, size in enumerate(sizes):
            if k > first and (held + size > CHUNK_BYTES or k - first == CHUNK_ROWS):
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)


def _fresh(part: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    """The rows whose stream this task has not seen: copies of a page count once anyway."""
    return part.take(pa.array([k for k, s in enumerate(part.column("stream").to_pylist()) if s not in seen and not seen.add(s)], pa.int64()))


def _starts(hosts: list[str]) -> np.ndarray:
    known = {h: xxhash.xxh64_intdigest(h) for h in set(hosts)}
    return np.array([known[h] for h in hosts], np.uint64)


def _marks(least: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Bucket of a host (24 bits) and mark in it (24 bits) of the least values of runs."""
    return (least >> np.uint64(24)) % buckets << np.uint64(24) | least & np.uint64(0xFFFFFF)


def _named(start: np.ndarray, marks: np.ndarray) -> np.ndarray:
    h = (start ^ marks * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def parsed(base: DataFrame) -> DataFrame:
    """The pages (page_id, url, html), parsed once and staged: page_id, url, host, places (of the blocks, a byte each), text (the blocks, a line each), open (nothing is marked), stream and sketch.

    stream is the identity of the host and the words; sketch is null on pages without words.
    """
    made = "host string, places binary, text string, open boolean, stream long, sketch array<long>"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, "html"):
            found = [blocks(page.as_py()) for page in part.column("html")]
            hosts = [_host(u) for u in part.column("url").to_pylist()]
            places, texts = [bytes([w for w, _ in x]) for x in found], ["\n".join(t for _, t in x) for x in found]
            codes, cuts = _coded(texts)
            content = np.repeat(np.frombuffer(b"".join(places), np.uint8) != BOILER, np.array([t.count(" ") + 1 for x in found for _, t in x], np.int64))
            streams, sketches = [], []
            for k, host in enumerate(hosts):
                own = codes[cuts[k] : cuts[k + 1]]
                main = own[content[cuts[k] : cuts[k + 1]]]
                streams.append(xxhash.xxh64_intdigest(own.tobytes(), xxhash.xxh64_intdigest(host)) - (1 << 63))
                sketches.append(_sketch(main if len(main) else own))
            columns = [pa.array(hosts, pa.string()), pa.array(places, pa.binary()), pa.array(texts, pa.string()), pa.array([_best(p) is None for p in places], pa.bool_()), pa.array(streams, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *columns], ["page_id", "url", "host", "places", "text", "open", "stream", "sketch"])

    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select("page_id", "url").schema)
    return staged(base.mapInArrow(parse, f"{ids}, {made}"), "html-parsed", compression="zstd")


def _often(pages: DataFrame, run: int) -> tuple[DataFrame, int]:
    """(a): names of marks that stand on as many pages of their host as it takes, and their number. pages: host, text, stream, needed, buckets.

    A run that enough pages hold has a shorter run in it, the one of the least value, that they hold as well; only those are counted, by marks of 3 bytes. A host's
    marks are dealt to buckets whose number grows with its pages, and a task sends a mark once with its count, so no bucket grows with the input.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _chunks(batches, "text"):
            part = _fresh(part, seen)
            if not part.num_rows:
                continue
            start, needed = _starts(part.column("host").to_pylist()), part.column("needed").to_numpy()
            words = _Words(part.column("text").to_pylist(), start)
            at, least = words.least(run)
            page = words.page[at]
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (page[1:] != page[:-1])
            page, least = page[new], least[new]
            once = np.unique(_named(page.astype(np.uint64), least), return_index=True)[1]
            page, least = page[once], least[once]
            if not len(page):
                continue
            first, host = np.unique(start, return_index=True, return_inverse=True)[1:]
            name, n = np.unique(host[page].astype(np.uint64) << np.uint64(48) | _marks(least, part.column("buckets").to_numpy().astype(np.uint64)[page]), return_counts=True)
            raw = name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]
            cuts = np.append(np.flatnonzero(np.diff(name >> np.uint64(24), prepend=np.uint64(1 << 63))), len(name))
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                k, more = first[int(name[a] >> np.uint64(48))], n[a:b] > 1
                own = raw[a:b]
                rows.append((int(start[k].view(np.int64)), int(name[a] >> np.uint64(24)) & 0xFFFFFF, int(needed[k]), own[~more].tobytes(), own[more].tobytes(), n[a:b][more].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    names, kinds = ["host", "bucket", "needed", "single", "many", "counts"], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in runs(batches, "host", "bucket"):
            both = [b"".join(one.column(c).to_pylist()) for c in ("single", "many", "counts")]
            raw = np.frombuffer(both[0] + both[1], np.uint8).reshape(-1, 3).astype(np.uint64)
            mark, inverse = np.unique(raw[:, 0] | raw[:, 1] << np.uint64(8) | raw[:, 2] << np.uint64(16), return_inverse=True)
            n = np.bincount(inverse, np.append(np.ones(len(both[0]) // 3), np.frombuffer(both[2], "<u4")))
            kept = mark[n >= one.column("needed")[0].as_py()] | np.uint64(one.column("bucket")[0].as_py() << 24)
            host = one.column("host").slice(0, 1).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_named(host, kept).view(np.int64), pa.int64())], ["a"])

    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.mapInArrow(packed, "host long, bucket int, needed long, single binary, many binary, counts binary").repartition(partitions, "host", "bucket")
    out, seen = staged_and_seen(dealt.sortWithinPartitions("host", "bucket").mapInArrow(counted, "a long"), "html-often", n=F.count("*"))
    return out, seen["n"]


def repeated_runs(pages: DataFrame, run: int) -> DataFrame:
    """(host, key, common): beginnings of suffixes that a host repeats on enough of its distinct pages. pages are parsed ones.

    These are the intervals of the host's suffix array at depth `run`: suffixes that agree in their first `run` words
    lie in one interval, and a longer repeat is a chain of intervals at following places, so the words under their beginnings are those of all repeated
    substrings of `run` words or more. An interval is counted with partial sums. A host of n distinct pages must
    repeat a run on max(2, sqrt(n), n / 20) of them; common says that it does on max(3, n / 2), which is all that a host without open pages needs to
    know; a page is open where its parse finds no article and no main part. Pages are counted by their sketches: how many
    different minima there are, for the place of the sketch that a third of all places exceed; so copies with a changed word or menu
    count as one page. Only suffixes that may stand on enough pages leave the tasks: marks of what is inside them are counted first (_often), and those that
    stand on enough pages go back as a bit filter of bounded size, which may let a suffix through but never holds one back.
    """
    spark = pages.sparkSession
    pages = pages.where("sketch is not null")
    places = lambda rows, *by: (
        rows.select(*by, F.posexplode("sketch").alias("place", "least")).distinct().groupBy(*by, "place").agg(F.count("*").alias("n"))
        .groupBy(*by).agg(F.get(F.sort_array(F.collect_list("n")), F.lit(SKETCH * 2 // 3)).alias("n"))
    )
    most = F.greatest(F.lit(3), F.ceil(F.col("n") / 2))
    needed = F.when(F.col("open"), F.ceil(F.greatest(F.lit(2), F.sqrt("n"), F.col("n") / 20))).otherwise(most)
    opened = pages.groupBy("host").agg(F.bool_or("open").alias("open"), F.count("*").alias("pages"))
    buckets = F.least(F.lit(1 << 24), F.ceil(F.col("pages") / PAGES_A_BUCKET)).cast("long")
    able = places(pages, "host").join(opened, "host").select("host", needed.cast("long").alias("needed"), most.alias("most"), "pages", buckets.alias("buckets")).where("pages >= needed").drop("pages")
    hosts, seen = staged_and_seen(able, "html-hosts", n=F.count("*"))
    texts = pages.select("host", "text", "stream", "sketch").join(F.broadcast(hosts) if seen["n"] <= BROADCAST_ROWS else hosts, "host")
    names, n = _often(texts.select("host", "text", "stream", "needed", "buckets"), run)
    often = spark.sparkContext.broadcast(bit_filter(names, n))
    kinds = pa.schema([("host", pa.string()), ("stream", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _chunks(batches, "text"):
            part = _fresh(part, seen)
            if not part.num_rows:
                continue
            start = _starts(part.column("host").to_pylist())
            words = _Words(part.column("text").to_pylist(), start)
            at, least = words.least(run)
            page = words.page[at]
            may = has_bit(often.value, _named(start[page], _marks(least, part.column("buckets").to_numpy().astype(np.uint64)[page])))
            page, keys = page[may], words.suffixes(run)[1][may].view(np.int64)
            held, first = np.unique(page, return_index=True)
            own = part.take(pa.array(held, pa.int64()))
            found = pa.array([np.unique(x) for x in np.split(keys, first[1:])][: len(held)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("host"), own.column("stream"), found, own.column("sketch").cast(pa.list_(pa.int64()))], schema=kinds)

    rows = staged(texts.drop("needed", "most").mapInArrow(candidates, "host string, stream long, keys array<long>, sketch array<long>"), "html-candidates")
    each = rows.select("host", "stream", F.explode("keys").alias("key")).distinct()
    common = staged(each.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1").join(hosts, "host").where("n >= needed").select("host", "key", "needed", "most"), "html-common")
    held = rows.select("host", "sketch", F.explode("keys").alias("key")).join(common, ["host", "key"])
    out = staged(places(held, "host", "key", "needed", "most").where("n >= needed").select("host", "key", (F.col("n") >= F.col("most")).alias("common")), "html-repeated")
    unstage(rows, hosts, names, common)
    return out


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html", run: int = RUN) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page.

    A page's blocks are placed by structure: inside <article> (or an element marked as article body), inside <main>,
    boilerplate (elements, roles and hidden parts that are no text of the page, and containers whose class or id is one of NAMED), or open. Of a page
    that marks its article, or else its main part, the blocks there count, of other pages the open blocks.
    From both go the runs of `run` or more words that the host repeats (repeated_runs; the streams of all pages, boilerplate included, are searched):
    from open blocks every such word, unique runs stay; from marked parts only whole blocks, and only where half of the host's distinct pages have
    them, since an article that quotes or copies another is still the article.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by newlines in page order. Elements that
    are never closed end with the page or where the next of their kind begins; only script, style and the like swallow what follows. A page
    without text, null html included, gives an empty string. Null ids and urls are carried; pages without a url share the
    host ''. Repeated rows stay repeated. Other columns are ignored.
    """
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html_column}`").alias("html"))
    spark, pages = base.sparkSession, parsed(base)
    repeated = repeated_runs(pages, run)
    parts = max(1, -(-repeated.count() // KEYS))

    def cleaned(part: int):
        found = repeated.where(F.pmod(F.xxhash64("host"), F.lit(parts)) == part).select("host", "key", "common").toArrow().sort_by("key")
        known = spark.sparkContext.broadcast([found.column(c).to_numpy() for c in ("key", "common")] + [set(found.column("host").unique().to_pylist())])

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, common, hosts = known.value
            for rows in _chunks(batches, "text"):
                own, places, lines = (rows.column(c).to_pylist() for c in ("host", "places", "text"))
                covered = {}
                if hit := [k for k, h in enumerate(own) if h in hosts]:
                    words = _Words([lines[k] for k in hit], _starts([own[k] for k in hit]))
                    at, h = words.suffixes(run)
                    h = h.view(np.int64)
                    place = np.searchsorted(key, h)
                    place[place == len(key)] = 0
                    marked = np.array([_best(places[k]) is not None for k in hit])
                    gone = at[(key[place] == h) & (common[place] | ~marked[words.page[at]])]
                    change = np.zeros(len(words.codes) + 1, np.int64)
                    np.add.at(change, gone, 1)
                    np.add.at(change, gone + run, -1)
                    under = np.cumsum(change[:-1]) > 0
                    covered = {hit[k]: under[words.cuts[k] : words.cuts[k + 1]] for k in np.unique(words.page[gone]).tolist()}
                texts = [_main_text(p, t, covered.get(k)) for k, (p, t) in enumerate(zip(places, lines))]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        return clean

    shape = base.select("page_id", "url", F.lit("").alias("text")).schema
    pages = pages.select("page_id", "url", "host", "places", "text")
    if parts == 1:
        done = pages.mapInArrow(cleaned(0), shape)
    else:  # hosts are dealt into parts, each with its own keys
        done = reduce(DataFrame.unionByName, [pages.where(F.pmod(F.xxhash64("host"), F.lit(parts)) == k).mapInArrow(cleaned(k), shape) for k in range(parts)])
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
