"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import staged

#: Common insults; what the labels teach is added to them.
SEED = frozenset(
    "bastard clown cretin degenerate disgusting dumb fool garbage idiot imbecile jerk loser lowlife moron pathetic scum stupid trash vermin worthless".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch vous tu te toi ton votre vos tú ti usted ustedes vosotros su".split())
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "\u00a1\u00bf\u00ab\u00bb\u2018\u2019\u201c\u201d\u2026\u2014\u2013"
_INNER = re.compile(r"[^\W\d_][@$!*#0-9]+[^\W\d_]")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_UPPER = bytes(range(65, 91))
_MARKS = b".,;:!?'\"()-*#%&$@"
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_STEMS = (4, 5, 6)
LEXICON, TREES, CALIBRATION = 0, 1, 2
FEATURES = (
    "log_words", "lexicon_sum", "lexicon_hits", "lexicon_density", "lexicon_distinct", "lexicon_max", "seed_hits", "seed_density", "weak_density",
    "near_you", "near_you_density", "you_density", "capitals", "shouted", "exclaim", "question", "punctuation", "obfuscated", "obfuscated_hits", "stretched", "word_length",
)


def _stems(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in _STEMS if len(word) > k)]


def count_stems(rows: DataFrame) -> DataFrame:
    """(text, toxic) to (stem, pos, neg): documents of each label that hold a word or a beginning of a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                words = {w.lower().strip(_EDGE) for w in set((text.as_py() or "").split())}
                seen[toxic.as_py()].update({s for w in words if w for s in _stems(w)})
        every = [s for s in seen[1]]  # only stems of toxic documents can enter the lexicon
        for at in range(0, len(every), 20_000):
            part = every[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"stem": part, "pos": [seen[1][s] for s in part], "neg": [0] * len(part)})
        clean = [s for s in seen[0]]
        for at in range(0, len(clean), 20_000):
            part = clean[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"stem": part, "pos": [0] * len(part), "neg": [seen[0][s] for s in part]})

    return rows.select("text", "toxic").mapInArrow(count, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(rows: DataFrame, size: int = 400, least: int = 3, odds: float = 3.0) -> dict[str, float]:
    """Stems with their log odds: the `size` strongest of those in at least `least` toxic documents with log odds over `odds`."""
    totals = rows.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not totals.p or not totals.n:
        return {}
    score = F.log((F.col("pos") + 0.1) / F.lit(float(totals.p))) - F.log((F.col("neg") + 0.1) / F.lit(float(totals.n)))
    found = count_stems(rows).where(F.col("pos") >= least).withColumn("odds", score).where(F.col("odds") > odds)
    return {r.stem: r.odds for r in found.orderBy(F.desc(F.col("odds") * F.log1p("pos")), "stem").limit(size).collect()}


class Reader:
    """Features of texts under a lexicon; what a word says is remembered for up to `room` words."""

    def __init__(self, lexicon: dict[str, float], room: int = 200_000):
        self.lexicon, self.room = lexicon, room
        self.known: dict[str, tuple] = {}

    def word(self, raw: str) -> tuple:
        """(weight, in SEED, second person, masked letters inside, stretched, shouted)"""
        w = raw.lower().strip(_EDGE)
        forms = {w}
        if not w.isalpha():
            forms |= {raw.lower().translate(_LEET).strip(_EDGE), "".join(c for c in w if c.isalpha())}
        weight = max(max((self.lexicon.get(s, 0.0) for f in forms if f for s in _stems(f)), default=0.0), 6.0 if forms & SEED else 0.0)
        out = (weight, bool(forms & SEED), w in SECOND_PERSON, bool(_INNER.search(w)), bool(_STRETCH.search(w)), len(w) > 2 and raw.isupper(), w)
        if len(self.known) >= self.room:
            self.known.clear()
        self.known[raw] = out
        return out

    def features(self, text: str | None) -> list[float]:
        """The values named in FEATURES; all zero for a text without words."""
        raw = text.split() if text else []
        if not raw:
            return [0.0] * len(FEATURES)
        n, get = len(raw), self.known.get
        total = top = 0.0
        strong = hits = seeds = you = masked = masked_hits = stretched = shouted = 0
        distinct = set()
        for word, k in Counter(raw).items():
            weight, seed, second, inner, stretch, shout, w = get(word) or self.word(word)
            if weight:
                total += k * weight
                top = max(top, weight)
                hits += k
                seeds += k * seed
                masked_hits += k * inner
                if weight >= 4.5:
                    strong += k
                    distinct.add(w)
            you += k * second
            masked += k * inner
            stretched += k * stretch
            shouted += k * shout
        near = 0
        if hits and you:  # one walk over the words; the last hit and the last "you" are all it needs
            last_hit = last_you = -10
            for at, word in enumerate(raw):
                info = get(word) or self.word(word)
                if info[2]:
                    near += at - last_hit <= 5
                    last_you = at
                if info[0]:
                    near += at - last_you <= 5
                    last_hit = at
        data = text.encode("utf-8", "replace")
        length = len(data)
        letters = len(data.translate(None, _NO_LETTERS)) or 1
        return [
            math.log1p(n), total, float(strong), strong / n, float(len(distinct)), top, float(seeds), seeds / n, (hits - strong) / n, float(near), near / n, you / n,
            (length - len(data.translate(None, _UPPER))) / letters, shouted / n, text.count("!") / length, text.count("?") / length,
            (length - len(data.translate(None, _MARKS))) / length, masked / n, float(masked_hits), stretched / n, letters / n,
        ]


def with_features(docs: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """docs plus x: array<double>. The lexicon is at most a few hundred stems, a bound of learn_lexicon."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = docs.columns
    schema = docs.withColumn("x", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            x = pa.array([reader.features(t.as_py()) for t in batch.column(text)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), x], [*names, "x"])

    return docs.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _part(doc_id: Column) -> Column:
    """LEXICON, TREES or CALIBRATION."""
    h = F.pmod(F.xxhash64(doc_id, F.lit("part")), F.lit(10))
    return F.when(h < 6, LEXICON).when(h < 8, TREES).otherwise(CALIBRATION)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample_rows: int = 24_000, threshold: float = 0.3
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out and teach nothing. The other labelled rows, at most about sample_rows of
    them (a hash of the id picks them), are split by another hash: 60 % teach the lexicon, 20 % the trees, 20 % the
    calibration, so no part is fitted on what another has seen. Scores come from whole texts only.

    Texts without words, null or empty, have all features 0 and are scored like any; a null doc_id is in no fold and
    teaches nothing; labels other than 0 and 1 are ignored; repeated rows are scored alike and teach as often as they occur. Where a fold lacks one of
    the labels, the score is the share of label 1 among what may be learned from (0 without any). Other columns play no part.
    """
    ids, kind = F.col(f"`{doc_id}`"), F.col(f"`{label}`")
    usable = labels.select(ids.alias("i"), kind.cast("int").alias("toxic")).where("i is not null and toxic in (0, 1)").where(fold(F.col("i")) != 2)
    many = usable.count()
    parts = 1 << 20
    usable = usable.where(F.pmod(F.xxhash64("i"), F.lit(parts)) < int(parts * min(1.0, sample_rows / max(1, many)))) if many > sample_rows else usable
    whole = docs.select(ids.alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # The sample is bounded by sample_rows, so each executor can hold its ids.
    known = whole.join(F.broadcast(usable), F.col("doc_id") == F.col("i")).select("doc_id", "text", "toxic")
    lexicon = learn_lexicon(known.where(_part(F.col("doc_id")) == LEXICON))
    learn = staged(with_features(known.where(_part(F.col("doc_id")) != LEXICON), lexicon).select("doc_id", "toxic", "x"), "toxicity-features")
    learn = learn.select(_part(F.col("doc_id")).alias("part"), F.col("toxic").cast("double").alias("label"), array_to_vector("x").alias("features"))
    seen = {(r["part"], r["label"]) for r in learn.groupBy("part", "label").count().collect()}  # at most four rows
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    if not seen >= {(p, y) for p in (TREES, CALIBRATION) for y in (0.0, 1.0)}:
        prior = usable.agg(F.avg("toxic")).first()[0] or 0.0
        return whole.select("doc_id", held, F.lit(float(prior)).alias("score"), F.lit(int(prior >= threshold)).alias("predicted"))
    trees = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.2, seed=17, cacheNodeIds=False, minInstancesPerNode=2).fit(learn.where(F.col("part") == TREES))
    raw = lambda df: trees.transform(df).withColumn("margin", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")
    curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(raw(learn.where(F.col("part") == CALIBRATION)).select("margin", "label"))
    scored = curve.transform(raw(with_features(whole, lexicon).select("doc_id", array_to_vector("x").alias("features"))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    return scored.select("doc_id", held, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
