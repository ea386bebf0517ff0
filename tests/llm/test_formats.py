"""Chat formatting, mixing, WARC archives and HTML text."""

import gzip
import json
import math
import random
import time
import zipfile
from collections import Counter

import duckdb
import pytest
from ferrule.llm.chat import OP5_SQL, escape, format_chat, loss_texts, op5_chat_format, read_chat, unescape
from ferrule.llm.html_text import blocks, extract_text
from ferrule.llm.mixing import mix_sources, tilts, water_filled, whole_copies
from ferrule.llm.warc_zip import _open_fs, central_directory, list_records, read_archives, record_bytes, surt, write_pages
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

HARD = ["", "\\", "\\\\", "</s>", "<s>", "[INST]", "[/INST]", "<|im_end|>\n", "<|turn|>", "<|im_start|>user\n", "<<SYS>>", "<</SYS>>", "\\<|", "a\nb", "é💊", "<", "[", "</", "\\n"]


def chats():
    rng = random.Random(8)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "tool|>"]), "".join(rng.choice(HARD) for _ in range(rng.randrange(5)))))
    return rows


def test_roles_with_control_characters_and_long_conversations(spark):
    roles = ["us\ner", "\\n", "\\\n", "a\\", "\n", "", "<|im_end|>\n", "x\\nb", "assistant"]
    rows = [(1, k, r, f"text {k}\n") for k, r in enumerate(roles)] + [(2, k, "assistant" if k % 3 else "user", f"t{k}" * (k % 4)) for k in range(997)]
    out = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("back", read_chat(F.col("formatted"))).withColumn("loss", loss_texts(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.back] == [x[2:] for x in mine] and r.loss == "".join(x[3] for x in mine if x[2] == "assistant")


def test_chat_round_trip_and_mask(spark):
    rows = chats()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = format_chat(df).withColumn("back", read_chat(F.col("formatted"))).withColumn("loss", loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()
    for r in out:
        want = sorted((t, role, x) for c, t, role, x in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.back] == [(role, x) for _, role, x in want]
        assert r.loss == "".join(x for _, role, x in want if role == "assistant")
    assert len(out) == 60


def test_escaping_hides_control_strings(spark):
    df = spark.createDataFrame([(x + y,) for x in HARD for y in HARD], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("back"))
    for r in df.collect():
        assert r.back == r.t
        assert not any(c in r.e for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|", "<<SYS", "<</SYS"))


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (None, 0, "assistant", "x"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in format_chat(df).withColumn("back", read_chat(F.col("formatted"))).withColumn("loss", loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t.role, t.text) for t in out[1].back] == [("user", "first"), ("", "")]
    assert out[None].loss == "x" and out[2].loss == "aa" and len(out[2].back) == 2 and out[3].loss == "z" * 200_000
    assert format_chat(df.limit(0)).count() == 0


def test_chat_query_against_sql(spark, tmp_path):
    spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(tuple(r) for r in op5_chat_format(spark, str(tmp_path)).collect())
    assert got == [tuple(w) for w in sorted(con.execute(OP5_SQL).fetchall())]


def sizes(spark, spec, tail=()):
    rng = random.Random(6)
    rows, n = [], 0
    for source, count, low, high in spec:
        for _ in range(count):
            rows.append((n, " ".join("w" for _ in range(rng.randrange(low, high))), source))
            n += 1
    return spark.createDataFrame([(*r, 1, 2) for r in rows + list(tail)], "doc_id long, text string, source string, size int, extra int")


@pytest.mark.parametrize("per_chunk", [1_000_000, 7])
def test_mixing_meets_targets(spark, per_chunk):
    df = sizes(spark, [("b", 300, 1, 60), ("a", 80, 1, 200), ("é", 60, 5, 6), (None, 40, 10, 90), ("tiny", 3, 2, 9)])
    got = mix_sources(df, rows_per_chunk=per_chunk)
    again = mix_sources(df.repartition(7), rows_per_chunk=per_chunk)
    assert sorted(map(tuple, got.select("doc_id", "taken").collect())) == sorted(map(tuple, again.select("doc_id", "taken").collect()))
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "source", "extra", "size", "source_size", "target", "copies", "taken"] and len(rows) == df.count()
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r.size <= 3 * r.size
    assert abs(sum(x[0].target for x in by.values()) - total) < 1e-6 * total
    assert by["tiny"][0].target == 3 * by["tiny"][0].source_size
    for x in by.values():
        assert abs(sum(r.taken for r in x) - x[0].target) <= max(0.005 * x[0].target, min(r.size for r in x))
    weights = dict(zip(sorted(k for k in by if k is not None), [1, 2, 3, 1])) | {None: 2}
    open_ = {k: x[0].target / weights[k] for k, x in by.items() if x[0].target < 3 * x[0].source_size - 1e-6}
    assert max(open_.values()) - min(open_.values()) < 1e-6 * total


def test_mixing_of_odd_rows(spark):
    df = sizes(spark, [], [(1, None, "a"), (2, "", None), (None, "x y", None), (None, "x y", None), (3, "z", "b"), (3, "z", "b")])
    rows = mix_sources(df, carry=[]).collect()
    assert len(rows) == 6 and all(r.taken <= 3 * r.size for r in rows) and sum(r.taken for r in rows) > 0
    assert all(r.taken == 0 for r in mix_sources(df.where("doc_id in (1, 2)")).collect())
    assert mix_sources(df.limit(0)).count() == 0


def test_mixing_carries_columns_whatever_their_names(spark):
    df = sizes(spark, [("a", 20, 1, 30), ("b", 20, 1, 30)]).select("doc_id", "text", "source", *[F.lit(k).alias(n) for k, n in enumerate(["s", "z", "h", "row", "__s", "chunk", "n", "target", "Size"])])
    got = mix_sources(df)
    assert got.columns == ["doc_id", "text", "source", "s", "z", "h", "row", "__s", "chunk", "n", "size", "source_size", "target", "copies", "taken"]
    assert {(r.s, r.z, r.h, r.row, r["__s"], r.chunk, r.n) for r in got.collect()} == {(0, 1, 2, 3, 4, 5, 6)} and got.count() == 40


def test_tilts_against_bisection(spark):
    """The multipliers of the convex dual, found once more by halving for each source alone."""
    rng = random.Random(3)
    hist = [(s, z, rng.randrange(1, 9), z / 40) for s in "abc" for z in rng.sample(range(1, 90), 25)]
    total = {s: sum(n * z for t, z, n, _ in hist if t == s) for s in "abc"}
    wanted = {"a": 0.4 * total["a"], "b": 1.7 * total["b"], "c": 2.9 * total["c"]}
    got = {r.source: r.lam for r in tilts(spark.createDataFrame(hist, "source string, size long, n long, x double"), spark.createDataFrame(list(wanted.items()), "source string, target double")).collect()}
    for s, target in wanted.items():
        words = lambda lam, s=s: sum(n * z * min(3, math.exp(min(lam * x, 50))) for t, z, n, x in hist if t == s)
        lo, hi = -4000.0, 4000.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
        assert abs(words(got[s]) - target) <= 1e-6 * target and abs(got[s] - lo) < 1e-4
    with pytest.raises(RuntimeError, match="did not come"):
        tilts(spark.createDataFrame(hist, "source string, size long, n long, x double"), spark.createDataFrame(list(wanted.items()), "source string, target double"), steps=3)


@pytest.mark.parametrize("block", [3, 1000])
def test_rounding_ends_near_the_words_wanted(spark, block):
    rng = random.Random(block)
    groups = [(s, z, rng.randrange(2, 7), rng.uniform(0.5, 2.5)) for s in "ab" for z in rng.sample(range(1, 5000), 40)]
    out = whole_copies(spark.createDataFrame(groups, "source string, size long, n long, rate double"), block=block).collect()
    assert sorted((r.source, r.size) for r in out) == sorted((s, z) for s, z, *_ in groups)
    rate = {(s, z): r for s, z, _, r in groups}
    for s in "ab":
        mine = [r for r in out if r.source == s]
        assert all(0 <= r.k <= 3 * r.n for r in mine)
        ordered = sorted(r.size for r in mine)
        assert abs(sum(r.k * r.size - r.n * r.size * rate[s, r.size] for r in mine)) <= sum(ordered[::block]) + ordered[4]  # the blocks' smallest sizes, and what the few documents of the last ones cannot take


def test_water_filling(spark):
    got = {r.source: r.target for r in water_filled(spark.createDataFrame([("a", 100), ("b", 10), ("c", 890)], "source string, total long")).collect()}
    assert got["b"] == 30 and abs(got["a"] - 970 / 4) < 1e-9 and abs(got["c"] - 970 * 3 / 4) < 1e-9


def warc_rows():
    return [(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (3, None, None), (None, "x", ""), (4, "é\r\n\"\\", "zü\r\n\r\n"), (5, None, "zü\r\n\r\n"), (6, "q", "solo"), (7, "long", "x" * 2_000_000)]


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_warc_round_trip(spark, tmp_path, archive_bytes):
    df = spark.createDataFrame([(*r, b"p") for r in warc_rows()], "page_id long, url string, html string, payload binary")
    manifest = write_pages(df, f"file://{tmp_path}/w", archive_bytes)
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in read_archives(manifest).collect()), key=str)
    want = [
        (1, "u", "revisit", 2, 1, None), (2, "u", "response", None, 1, b"a"), (2, "u", "revisit", 2, 1, None), (3, None, "response", None, 0, b""), (None, "x", "revisit", 3, 0, None),
        (4, "é\r\n\"\\", "revisit", 5, 7, None), (5, None, "response", None, 7, "zü\r\n\r\n".encode()), (6, "q", "response", None, 4, b"solo"), (7, "long", "response", None, 2_000_000, b"x" * 2_000_000),
    ]
    assert got == sorted(want, key=str)
    assert list_records(manifest).count() == len(want)
    keys = [x.split(" ")[0] for x in ("com,b,a)/p?q=1 2", surt("https://A.b.com/p?q=1"))]
    assert keys[0] == keys[1] and surt(None) == ")/" and " " not in surt("http://a/b c\td")
    assert read_archives(write_pages(df.limit(0), f"file://{tmp_path}/e")).count() == 0
    small = {(r.page_id, r.record_type) for r in read_archives(write_pages(df, f"file://{tmp_path}/s", least=2)).collect()}
    assert (1, "response") in small and (4, "revisit") in small


def test_zip64_directories(tmp_path):
    """Archives with forced ZIP64 fields, trailing comments and many members read like those of the standard library."""
    path = f"{tmp_path}/a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for i in range(70_000):  # more entries than the short end record can count
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        with z.open("big", "w", force_zip64=True) as m:
            m.write(b"payload")
        z.comment = b"c" * 300
    fs, at = _open_fs(f"file://{path}")
    with fs.open_input_file(at) as f:
        found = central_directory(f, f.size())
        assert len(found) == 70_001
        start, size, method = found["big"]
        assert (f.read_at(size, start), method) == (b"payload", 0)


def test_what_is_not_an_archive_is_an_error(tmp_path):
    path = f"{tmp_path}/not.zip"
    with open(path, "wb") as out:
        out.write(b"x" * 100)
    fs, at = _open_fs(f"file://{path}")
    with fs.open_input_file(at) as f, pytest.raises(ValueError):
        central_directory(f, f.size())


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">buy</div><article><header><h1>Head &amp; more</h1></header><p>one
 two&nbsp;<b>three<br><p>four &lt;five&gt; &#233;<aside>side</aside><ul><li>i1<li>i2</ul><div id="comments"><p>said</p></div><form>f<input value="a>b"></form><noscript>n</noscript></article>
<div class="cookie-notice">cookies</div><footer>&copy; foot</footer>"""


def test_structure_of_a_page():
    kept = [t for w, t in blocks(PAGE) if w == 0]
    assert kept == ["Head & more", "one two three", "four <five> é", "i1", "i2"]
    assert blocks(None) == blocks("") == [] and blocks("<p>unclosed <i") and blocks("<script>never closed <p>x") == []
    assert [t for _, t in blocks("a < b && c > d")] == ["a < b && c > d"]


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(hs.text(alphabet="<>/!-\"'= pdivarticle&;#x1\n", max_size=200))
def test_any_text_is_a_page(page):
    for _, t in blocks(page):
        assert t == " ".join(t.split()) != ""


def plain(*parts):
    return "<html><body>" + "".join(f"<div>{p}</div>" for p in parts) + "</body></html>"


def test_repeated_runs_of_a_host_go(spark):
    foot = "all rights reserved by the great example company of nowhere"
    rows = [(1, "http://a/1", plain("alpha beta gamma delta one two three", foot)), (1, "http://a/1", plain("alpha beta gamma delta one two three", foot)), (2, "http://a/2", plain("other words stand on this page", f"start {foot} end")),
            (3, "http://b/1", plain("only page", foot)), (4, None, None), (5, "http://a/5", PAGE), (6, "http://[bad", plain("x")), (7, "http://a/7", "<main><p>in main</p></main><p>out</p>"), (8, "http://a/8", "")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()), key=str)
    art = "Head & more\none two three\nfour <five> é\ni1\ni2"
    want = [(1, "alpha beta gamma delta one two three"), (1, "alpha beta gamma delta one two three"), (2, "other words stand on this page\nstart end"), (3, f"only page\n{foot}"), (4, ""), (5, art), (6, "x"), (7, "in main"), (8, "")]
    assert got == sorted([(i, t, len(t)) for i, t in want], key=str)
    assert extract_text(df.limit(0)).count() == 0


def invented(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_blocks_of_marked_articles_go_where_half_of_the_host_repeats_them(spark):
    notice, short = invented("notice", 14), invented("share", 7)
    own = {i: invented(i, 60) for i in range(9)}
    rows = [(i, f"http://a/{i}", f"<article><p>{own[i]}</p><p>{notice}</p><p>{short}</p><p>{invented(i + 50, 4)} {short} {invented(i + 70, 4)}</p></article>") for i in own]
    got = {r.page_id: r.text.split("\n") for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i][0] == own[i] for i in own)
    assert not any(notice in got[i] or short in got[i] for i in own)
    assert all(f" {short} " in got[i][-1] for i in own)  # a run inside a paragraph of an article stays
    few = [(i, f"http://b/{i}", f"<article><p>{invented(i + 200, 60)}</p>" + f"<p>{notice}</p>" * (i < 3) + "</article>") for i in range(9)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(few, "page_id long, url string, html string")).collect()}
    assert all((notice in got[i]) == (i < 3) for i in range(9))


def test_open_pages_lose_all_repeated_substrings_and_nothing_else(spark):
    """Against brute force: the words under every run of six or more that another distinct page of the host holds too."""
    rng, rows = random.Random(17), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for host in range(15):
        shared = [[word() for _ in range(rng.randrange(4, 16))] for _ in range(3)]
        for k in range(rng.choice([2, 3])):
            words = [word() for _ in range(60)]
            for s in rng.sample(shared, 2):
                at = rng.randrange(len(words))
                words[at:at] = s
            rows.append((len(rows), f"http://h{host}/{k}", words))
    want = {}
    for i, url, words in rows:
        windows = {tuple(o[k : k + 6]) for j, u, o in rows if j != i and u.split("/")[2] == url.split("/")[2] for k in range(len(o) - 5)}
        bad = {k + d for k in range(len(words) - 5) if tuple(words[k : k + 6]) in windows for d in range(6)}
        want[i] = " ".join(w for k, w in enumerate(words) if k not in bad)
    df = spark.createDataFrame([(i, u, f"<body><div>{' '.join(w)}</div></body>") for i, u, w in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(df).collect()} == want
    assert sum(len(w) > len(want[i].split()) for i, _, w in rows) > 15


def test_malformed_pages_take_linear_time():
    start = time.time()
    for page in ("<a " * 350_000, '<a b="> "' * 100_000, "<!-- " * 200_000, "<div>" * 200_000, "<b " + "x" * 1_000_000 + ">", "<p " + "= " * 500_000 + ">t"):
        blocks(page)
    assert time.time() - start < 20


def test_unclosed_elements_lose_no_text():
    assert blocks("<article><select><option>x<p>lost</p></article>")[-1] == (0, "lost") and blocks("<video src=x><p>tail") == [(2, "tail")]
    page = "<article><p class='social-history'>a</p><h2 class='notice'>b</h2><div class='related-work'>c</div><div class=comments>d</div><svg><svg><text>q</text></svg>r</svg>e</article>"
    assert [t for w, t in blocks(page) if w == 0] == ["a", "b", "c", "e"]


def test_near_copies_and_chance_runs_stay(spark):
    a, quote = invented("a", 80).split(), invented("quote", 12)
    near = " ".join([*a[:40], "changed", *a[41:]])
    rows = [(1, "http://near/1", plain(" ".join(a))), (2, "http://near/2", plain(near)), (3, "http://menu/1", f"<nav>{invented('m1', 9)}</nav>" + plain(" ".join(a))), (4, "http://menu/2", f"<nav>{invented('m2', 9)}</nav>" + plain(" ".join(a)))]
    rows += [(10 + i, f"http://large/{i}", plain(invented(("p", i).__repr__(), 30) + (f" {quote}" if i < 2 else ""), invented("foot", 9))) for i in range(30)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[3] == got[4] == " ".join(a) and got[2] == near
    assert all(got[10 + i].endswith(quote) == (i < 2) and "\n" not in got[10 + i] for i in range(30))


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.sha1(F.concat(k.cast("string"), F.lit("-"), F.col("id").cast("string")).cast("binary")))).alias("html"))
    manifest = write_pages(pages.coalesce(2), f"file://{tmp_path}/w", archive_bytes=600_000)
    total = manifest.agg(F.sum("bytes")).first()[0]
    read = read_archives(manifest, task_bytes=total // 8)
    rows = read.select("page_id", F.spark_partition_id().alias("task")).collect()
    per = Counter(r.task for r in rows)
    assert sorted(r.page_id for r in rows) == list(range(400)) and len(per) >= 8 and max(per.values()) < 150


def test_packages_of_other_writers(spark, tmp_path):
    """Two members of records, a plain index and a packed one of two gzip members; a foreign record without our ids."""
    foreign = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    ours = [record_bytes(k, k, f"http://y/{k}", b"page %d" % k, "response", None) for k in range(3)]
    line = lambda name, at, n: json.dumps({"url": "u", "offset": at, "length": str(n), "filename": name}).join(["com,y)/ 20240101 ", "\n"]).encode()
    at = [0, len(ours[0]), len(ours[0]) + len(ours[1])]
    with zipfile.ZipFile(tmp_path / "p.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", b"".join(ours))
        z.writestr("archive/b.warc.gz", foreign)
        z.writestr("datapackage.json", "{}")
        z.writestr("indexes/index.cdxj", line("b.warc.gz", 0, len(foreign)))
        z.writestr("indexes/index.cdx.gz", gzip.compress(b"!meta\n" + line("a.warc.gz", at[0], len(ours[0]))[:30]) + gzip.compress(line("a.warc.gz", at[0], len(ours[0]))[30:] + b"".join(line("a.warc.gz", at[k], len(ours[k])) for k in (1, 2))))
    got = read_archives(spark.createDataFrame([(str(tmp_path / "p.wacz"),)], "path string")).collect()
    assert sorted((r.url, bytes(r.payload), r.page_id) for r in got) == [("http://x/", b"hello", None)] + [(f"http://y/{k}", b"page %d" % k, k) for k in range(3)]


def test_a_hot_payload(spark, tmp_path, monkeypatch):
    from ferrule.llm import common, warc_zip

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(warc_zip, "HOT", 5)
    rows = [(k, "u", "same") for k in range(20)] + [(100 + k, "u", f"pair {k // 2}") for k in range(8)] + [(200, "u", "alone")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in read_archives(write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/h")).collect()}
    want = {k: ("revisit", 19) for k in range(19)} | {19: ("response", None), 200: ("response", None)} | {100 + k: ("revisit", 101 + k) if k % 2 == 0 else ("response", None) for k in range(8)}
    assert got == want


def test_deep_pages_odd_letters_and_inline_elements_lose_no_text(spark):
    spans = "<span>" * 600
    deep = "<nav>menu" + spans + "</nav><article><p>main text</p></article>"
    odd = "<article><p>" + "İ" * 20 + "</p><script>x</script><p>lost words here</p><p>next</p></article>"
    inline = "<article><p>let <math><mi>x</mi></math> be a <label>term</label> b</p></article><form><label>mail</label></form>"
    many = "<article>" + "".join(f"<p>{spans}row {k}" for k in range(40)) + "</article>"
    rows = [(1, "http://a/", deep), (2, "http://b/", odd), (3, "http://c/", inline), (4, "http://d/", many)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "main text", 2: "İ" * 20 + "\nlost words here\nnext", 3: "let x be a term b", 4: "\n".join(f"row {k}" for k in range(40))}


def test_a_tag_in_a_comment_or_a_menu_does_not_change_how_a_page_is_judged(spark):
    notice = "<p>this host asks all readers to accept the terms of its many partners today</p>"
    for mark in ("", "<!-- <article> -->", "<nav><article>m</article></nav>"):
        rows = [(k, "http://h/", f"{mark}<p>{' '.join(f'w{k}x{j}' for j in range(30))}</p>" + notice * (k < 4)) for k in range(12)]
        got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {k: " ".join(f"w{k}x{j}" for j in range(30)) for k in range(12)}


def test_pages_are_read_and_parsed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(k, f"http://h/{k % 3}", f"<article><p>{invented(k, 40)}</p><p>{invented('notice', 9)}</p></article>") for k in range(30)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").mapInArrow(seen, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: invented(k, 40) for k in range(30)} and read.value == 30


def test_marked_pages_lose_the_blocks_that_brute_force_finds(spark):
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for host in range(6):
        shared = [" ".join(word() for _ in range(n)) for n in (5, 6, 7, 12, 12)]
        for k in range(8):
            blocks_ = [" ".join(word() for _ in range(30)) for _ in range(3)] + [s for s in shared if rng.random() < 0.55] + [f"{shared[4]} {shared[3]}"] * (k % 2)
            rng.shuffle(blocks_)
            rows.append((len(rows), f"http://h{host}/{k}", blocks_))
    runs_of = lambda words: {tuple(words[k : k + 6]) for k in range(len(words) - 5)}
    want = {}
    for i, url, own in rows:
        others = [runs_of(" ".join(o).split()) for _, u, o in rows if u.split("/")[2] == url.split("/")[2]]
        words = " ".join(own).split()
        bad = {k + d for k in range(len(words) - 5) if sum(tuple(words[k : k + 6]) in o for o in others) >= 4 for d in range(6)}
        starts = [sum(len(b.split()) for b in own[:k]) for k in range(len(own))]
        want[i] = "\n".join(b for b, at in zip(own, starts) if not all(at + d in bad for d in range(len(b.split()))))
    df = spark.createDataFrame([(i, u, "<article>" + "".join(f"<p>{b}</p>" for b in o) + "</article>") for i, u, o in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(df).collect()} == want
    assert sum(len(o) > want[i].count("\n") + 1 for i, _, o in rows) > 15
