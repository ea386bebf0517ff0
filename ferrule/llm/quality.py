"""Document quality from weak labels: heuristic labellers, EM over their votes, a hashed linear scorer."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ferrule.llm.common import staged, unstage

BAD, ABSTAIN, GOOD = 0, 1, 2
#: Name, value index, value below which it votes GOOD, value above which it votes BAD; between them it abstains.
LABELLERS = (
    ("symbol_share", 0, 0.045, 0.12),
    ("upper_share", 1, 0.10, 0.45),
    ("repeated_next", 2, 0.03, 0.30),
    ("top_word_share", 3, 0.15, 0.30),
    ("few_distinct", 4, 0.40, 0.60),
    ("marks_per_word", 5, 0.35, 1.40),
    ("bare_marks", 6, 0.04, 0.15),
    ("digit_share", 7, 0.10, 0.75),
)
#: Hashed features: runs of character classes, words, and pairs of words, each in a part of its own.
SHAPES, WORDS, PAIRS = 1 << 13, 1 << 12, 1 << 12
DIMS = SHAPES + WORDS + PAIRS
_CLASSES = 12


def _table() -> np.ndarray:
    """Bytes of UTF-8 to character classes."""
    t = np.full(256, 2, np.uint8)  # bytes of letters beyond ASCII count as lower case
    for c in range(128):
        ch = chr(c)
        t[c] = 1 if ch.isupper() else 2 if ch.islower() else 3 if ch.isdigit() else 0 if ch in " \t\r\v\f" else 4 if ch == "\n" else 5 if ch in ".,;:?" else 6 if ch == "!" else 7 if ch in "'\"-()" else 8 if ch in "|" else 9 if ch in "<>{}[]/\\=_" else 10
    return t


_CLASS = _table()


def measures(text: str) -> list[float]:
    """The labellers' values for a text with at least one word."""
    words = text.split()
    n, size = len(words), len(text)
    raw = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    by = np.bincount(raw, minlength=_CLASSES)
    letters = max(1, by[1] + by[2] + by[3])
    marks = int(by[5:].sum())
    count = Counter(words)
    window = min(n, 200)
    few = 0.0
    if n >= 20:  # mean share of repeated words in stretches of up to 200 words
        few = float(np.mean([1 - len(set(words[a : a + window])) / len(words[a : a + window]) for a in range(0, n, window)]))
    return [
        float(by[6:].sum()) / max(1, size), float(by[1]) / letters, sum(map(operator.eq, words, words[1:])) / n, (max(count.values()) / n) if n >= 20 else 0.0,
        few, marks / n, sum(k for w, k in count.items() if not w[0].isalnum() and not any(map(str.isalnum, w))) / n, float(by[3]) / letters,
    ]


def votes(values: list[float]) -> list[int]:
    return [GOOD if values[k] <= low else BAD if values[k] > high else ABSTAIN for _, k, low, high in LABELLERS]


@lru_cache(maxsize=1 << 15)
def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _counted(bins: np.ndarray, size: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(bins, minlength=1)[:size]
    at = np.flatnonzero(counts)
    return at + offset, np.sqrt(counts[at] / len(bins))


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places in order, values): runs of four character classes (runs of one class count once), lower-cased words, and pairs of neighbouring words.

    What the labellers measure is left out, so that the scorer learns from the text and not from the votes.
    """
    raw = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)].astype(np.int64)
    runs = raw[np.flatnonzero(np.diff(raw, prepend=-1))]
    words = text.lower().split()
    codes = np.fromiter(map(_code, words), np.uint64, len(words))
    parts = []
    if len(runs) >= 4:
        grams = ((runs[:-3] * _CLASSES + runs[1:-2]) * _CLASSES + runs[2:-1]) * _CLASSES + runs[3:]
        parts.append(_counted((grams * 2654435761 >> 7) % SHAPES, SHAPES, 0))
    if len(codes):
        parts.append(_counted((codes % np.uint64(WORDS)).astype(np.int64), WORDS, SHAPES))
    if len(codes) > 1:
        pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ codes[1:]
        pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        parts.append(_counted((pairs >> np.uint64(52)).astype(np.int64), PAIRS, SHAPES + WORDS))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def count_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n) over all texts with words; there are 3 ** len(LABELLERS) patterns at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                value = t.as_py()
                if value and not value.isspace():
                    seen["".join(map(str, votes(measures(value))))] += 1
        yield pa.RecordBatch.from_pydict({"pattern": list(seen), "n": list(seen.values())}, schema=pa.schema([("pattern", pa.string()), ("n", pa.int64())]))

    return docs.select(text).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


class LabelModel:
    """Labellers' vote probabilities given the hidden class, and the class's share, by expectation-maximisation."""

    def __init__(self, patterns: dict[str, int], prior: float = 0.85, rounds: int = 300, trust: float = 0.02):
        """trust: weight, as a share of all documents, of the prior belief that labellers seldom call a good document bad.

        Each labeller knows one kind of junk, so silence of the others says little; where EM starts from that belief it does not
        take a lone bad vote for an error. At 0.02 the belief counts as much as every fiftieth document, and what EM estimates is the votes' own.
        """
        names = sorted(patterns)
        v = np.array([[int(c) for c in p] for p in names], int).reshape(len(names), len(LABELLERS))
        n = np.array([patterns[p] for p in names], float)
        self.prior = prior
        belief = np.array([[0.3, 0.3, 0.4], [0.0005, 0.0995, 0.9]])
        self.theta = np.tile(belief[None], (len(LABELLERS), 1, 1))
        weight = trust * n.sum()
        for _ in range(rounds if len(names) else 0):
            good = n * self._posterior(v)
            self.prior = float(np.clip(good.sum() / n.sum(), 0.02, 0.98))
            for k in range(len(LABELLERS)):
                for y, w in ((0, n - good), (1, good)):
                    counts = np.array([w[v[:, k] == c].sum() for c in (BAD, ABSTAIN, GOOD)]) + belief[y] * (weight if y else 1.0)
                    self.theta[k, y] = counts / counts.sum()

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        k = np.arange(len(LABELLERS))
        bad = np.log(1 - self.prior) + np.log(self.theta[k, 0, v]).sum(axis=1)
        good = np.log(self.prior) + np.log(self.theta[k, 1, v]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))

    def posterior(self, vote: list[int]) -> float:
        return float(self._posterior(np.array([vote], int))[0])

    def accuracies(self) -> dict[str, float]:
        """Share of a labeller's votes, abstentions aside, that agree with the hidden class."""
        out = {}
        for k, (name, *_) in enumerate(LABELLERS):
            right = (1 - self.prior) * self.theta[k, 0, BAD] + self.prior * self.theta[k, 1, GOOD]
            wrong = (1 - self.prior) * self.theta[k, 0, GOOD] + self.prior * self.theta[k, 1, BAD]
            out[name] = float(right / (right + wrong))
        return out


def score_quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = 12_000, threshold: float = 0.5) -> DataFrame:
    """All columns of docs plus weak_posterior, quality_score (0 to 1) and quality_keep (quality_score >= threshold).

    Eight heuristic labellers vote bad, abstain or good on each text. Their vote patterns are counted over all
    documents, and expectation-maximisation on those counts estimates each labeller's accuracy and the share of good
    documents without any true label. Posteriors then are the soft labels of a logistic regression on hashed words, pairs of words and character
    shapes, fitted on about sample_rows documents picked by a hash of the id; it scores every whole text. Where the sample's posteriors hold
    less than one document of a class there is nothing to fit, and each document's own posterior is its score.

    A null text, and one of white space alone, has no evidence: posterior and score 0, not kept. A null doc_id is never
    in the sample but is scored; repeated rows are scored alike. An empty table gives no rows. Columns of docs with the new
    names are replaced; others are carried along.
    """
    made = ("weak_posterior", "quality_score", "quality_keep")
    docs = docs.drop(*made)
    names, sc = docs.columns, docs.sparkSession.sparkContext
    patterns = {r.pattern: r.n for r in count_patterns(docs, text).collect()}  # at most 3 ** 8 rows
    model, rows = LabelModel(patterns), sum(patterns.values())
    parts = 1 << 20
    cut = int(parts * min(1.0, sample_rows / max(1, rows)))
    picked = docs.where(F.col(f"`{doc_id}`").isNotNull()).where(F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.lit("quality")), F.lit(parts)) < cut).select(F.col(f"`{text}`").alias("text"))

    # The parts of a sparse vector, written as such and read back as vectors.
    inner = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, p = [], []
            for t in batch.column(0):
                value = t.as_py()
                if value and not value.isspace():
                    at, weights = hashed(value)
                    vectors.append({"type": 0, "size": DIMS, "indices": at, "values": weights})
                    p.append(model.posterior(votes(measures(value))))
            yield pa.RecordBatch.from_arrays([pa.array(vectors, inner), pa.array(p, pa.float64())], ["features", "p"])

    written = staged(picked.mapInArrow(teach, "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>, p double"), "quality-sample")
    sample = docs.sparkSession.read.schema(StructType([StructField("features", VectorUDT()), StructField("p", DoubleType())])).parquet(written._staged_path)
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w"))))
    train = sample.select("features", both.alias("y")).select("features", "y.label", "y.w").where("w > 1e-6").cache()
    weights = {r.label: r.w for r in train.groupBy("label").agg(F.sum("w").alias("w")).collect()}
    coef, bias = None, 0.0
    if len(weights) == 2 and min(weights.values()) > 1.0:
        fitted = LogisticRegression(weightCol="w", regParam=1e-4, maxIter=40, standardization=False).fit(train)
        coef, bias = fitted.coefficients.toArray(), float(fitted.intercept)
    train.unpersist()
    unstage(written)
    shared = sc.broadcast((coef, bias))
    schema = docs.withColumns({"weak_posterior": F.lit(0.0), "quality_score": F.lit(0.0), "quality_keep": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, b = shared.value
        for batch in batches:
            weak, score = [], []
            for t in batch.column(text):
                value = t.as_py()
                if not value or value.isspace():
                    weak.append(0.0)
                    score.append(0.0)
                    continue
                weak.append(model.posterior(votes(measures(value))))
                if c is None:
                    score.append(weak[-1])
                    continue
                at, weights = hashed(value)
                score.append(float(1 / (1 + np.exp(-np.clip(b + c[at] @ weights, -50, 50)))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(weak, pa.float64()), pa.array(score, pa.float64()), pa.array([s >= threshold for s in score], pa.bool_())], [*names, *made]
            )

    return docs.mapInArrow(run, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs).select("doc_id", F.round("weak_posterior", 9).alias("weak_posterior"), F.round("quality_score", 6).alias("quality_score"), "quality_keep")
