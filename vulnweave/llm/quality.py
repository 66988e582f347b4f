"""Quality classifier: a weak-label model over heuristic labellers, whose posteriors train a hashed linear scorer."""

from __future__ import annotations

import functools
import operator
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, map_arrow, unused

#: Rows, about, on which the weak-label model and the scorer are fitted, taken by a hash of id and text; rows that repeat count once.
SAMPLE_ROWS = 8_000

#: Hashed features of the scorer.
FEATURES = 1 << 12

GOOD, JUNK, ABSTAIN = 0, 1, 2

_LETTER, _UPPER, _DIGIT, _SPACE, _MARK, _SYMBOL = range(6)


@functools.cache
def _classes() -> np.ndarray:
    def kind(c: str) -> int:
        if c.isalpha():
            return _UPPER if c.isupper() else _LETTER
        return _DIGIT if c.isdigit() else _SPACE if c.isspace() else _MARK if c in ".,;:?'\"()-’“”«»¿¡…–—" else _SYMBOL

    return np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


_RUN = re.compile(r"(.)\1+")
_SHAPES: dict[str, int] = {}


def _shape(word: str) -> int:
    """The hashed shape of a word: its characters' kinds with runs as one. Only shapes of shorter words are remembered."""
    if (known := _SHAPES.get(word)) is None:
        kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
        short = _RUN.sub(lambda m: m[1] if m[1] in "Aa0" else m[1] * 2, kinds)
        known = zlib.crc32(short.encode("utf-8", "surrogatepass")) % (FEATURES - 256)
        if len(_SHAPES) > 50_000:
            _SHAPES.clear()
        if len(word) <= 64:
            _SHAPES[word] = known
    return known


#: Each labeller: a share or figure of the text, the bound from which it votes junk, the bound to which it votes good. In between it abstains.
LABELLERS = (
    ("symbols", 0.12, 0.03),
    ("upper", 0.5, 0.2),
    ("stutter", 0.15, 0.03),
    ("bars", 0.2, 0.02),
    ("shouts", 0.2, 0.02),
    ("repeats", 0.6, 0.35),
    ("bare", 0.25, 0.05),
)


def signals(text: str) -> tuple[np.ndarray, dict[int, float]]:
    """(the labellers' figures, features of the scorer) of a whole text that has a word."""
    words = text.split()
    n = len(words)
    kinds = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=6)
    solid = max(1, len(text) - int(kinds[_SPACE]))
    letters = max(1, int(kinds[_LETTER] + kinds[_UPPER]))
    stutter = sum(map(operator.eq, words, words[1:])) / n
    distinct = len(set(words))
    shapes = Counter(map(_shape, words))
    figures = np.array([
        kinds[_SYMBOL] / solid,
        kinds[_UPPER] / letters if n >= 5 else 0.1,
        stutter,
        sum(w == "|" for w in words) / n if "|" in text else 0.0,
        text.count("!!") / n,
        1 - distinct / min(n, 40) if n >= 20 and distinct < min(n, 40) else 0.0,
        1 - letters / solid if n >= 10 else 0.02,
    ])
    features = {k: v / (n + 10) for k, v in shapes.items()}
    for i, x in enumerate(figures):
        features[FEATURES - 256 + 16 * i + min(15, int(16 * min(1.0, x) ** 0.5))] = 1.0
    features[FEATURES - 1] = 1.0
    return figures, features


def votes(figures: np.ndarray) -> np.ndarray:
    """What the labellers say of each row of figures."""
    bad, good = (np.array([x[i] for x in LABELLERS]) for i in (1, 2))
    return np.where(figures >= bad, JUNK, np.where(figures <= good, GOOD, ABSTAIN))


def posterior(said: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: (probability of junk of each row, table labeller x class x vote).

    Class 0 is good text, class k + 1 the kind of junk that labeller k knows: a mixture, since a labeller says nothing of the
    other kinds. The tables hold each labeller's accuracy on every class. Good text is held to rare votes of junk by pseudo
    counts of 2 % of the rows, so that the classes keep their meaning.
    """
    n, labellers = said.shape
    junk = said == JUNK
    p = np.where(junk.any(axis=1), 0.1, 0.95)[:, None] * np.eye(1, labellers + 1)
    p[:, 1:] = np.where(junk.any(axis=1)[:, None], 0.9 * junk / np.maximum(1, junk.sum(axis=1))[:, None], 0.05 / labellers)
    table = np.zeros((labellers, labellers + 1, 3))
    held = np.zeros_like(table) + 0.5
    held[:, 0] += 0.02 * n * np.array([0.93, 0.005, 0.065])
    for _ in range(rounds):
        table[:] = held + np.stack([p.T @ (said == vote) for vote in range(3)], axis=2).transpose(1, 0, 2)
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(table)
        score = np.log((p.sum(axis=0) + 1) / (n + labellers + 1)) + sum(log[i, :, said[:, i]] for i in range(labellers))
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
    return 1 - p[:, 0], table


def _fit(rows: list[dict[int, float]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression of hashed features on soft labels, by Adagrad over all rows, with a small penalty on size."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.fromiter((k for r in rows for k in r), np.int64)
    value = np.fromiter((v for r in rows for v in r.values()), float)
    w, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(at, w[index] * value, len(rows))))
        slope = np.bincount(index, value * (p - target)[at], FEATURES) / len(rows) + 1e-5 * w
        seen += slope**2
        w -= 0.5 * slope / np.sqrt(seen)
    return w


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The scorer's weights, from `rows` texts about at most; labels of a table aren't used. No text: zero weights."""
    known = docs.where(F.col(text_col).rlike(r"\S")).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    every, total = known, docs.select(id_col).count()
    known = every.where(F.pmod(F.xxhash64("i", "t", F.lit("quality")), F.lit(max(1, -(-total // rows)))) == 0)
    known = (every if known.isEmpty() else known).dropDuplicates(["i", "t"])  # rows that repeat share their hash

    def look(batches):
        for batch in batches:
            out = [signals(t) for t in batch.column(0).to_pylist() if t.split()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x, _ in out], pa.list_(pa.float64())), pa.array([list(f) for _, f in out], pa.list_(pa.int32())), pa.array([list(f.values()) for _, f in out], pa.list_(pa.float64()))], ["figures", "at", "value"])

    got = map_arrow(known.select("t"), look, "figures array<double>, at array<int>, value array<double>").toArrow()
    if not got.num_rows:
        return np.zeros(FEATURES)
    p, _ = posterior(votes(np.array(got.column("figures").to_pylist())))
    return _fit([dict(zip(a, v, strict=True)) for a, v in zip(got.column("at").to_pylist(), got.column("value").to_pylist(), strict=True)], p)


def score(weights: np.ndarray, text: Column) -> Column:
    """The probability that a whole text is good: 0 for null or blank ones."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        w, out = shared.value, np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t and t.split():
                found = signals(t)[1]
                z = w[np.fromiter(found, np.int64, len(found))] @ np.fromiter(found.values(), float, len(found))
                out[i] = 1 / (1 + np.exp(min(50.0, max(-50.0, z))))
        return pd.Series(out)

    return run(text)


def classify(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, of being good), keep (score >= least) of every row.

    Null, empty or blank text: score 0, not kept. Null doc_id: kept as a row. Repeated rows: one result each, alike. Whole
    texts count, whatever their length. Empty table: no rows. Other columns are ignored.
    """
    weights = train(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(weights, F.col("text")).alias("score")).withColumn("keep", F.col("score") >= least)


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows with a score of `least` or more; all columns stay as they are, whatever their names.

    Null, empty and blank texts go. Repeated rows: all stay or go. Empty table: no rows.
    """
    weights, q = train(docs), unused(docs, "quality_of")
    return docs.withColumn(q, score(weights, F.col("text"))).where(F.col(q) >= least).drop(q)
