"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, map_arrow, unused

#: Hashed features; the last row of the matrix, after them, stands for n-grams that don't count.
FEATURES = 1 << 15

#: Training rows, about (by a hash of id and text, whole texts).
SAMPLE_ROWS = 20_000

#: Numbers that scoring a slice of a text gathers at a time: characters x languages.
GATHERED = 4_000_000

UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, starts of each text's own, letters of each text). N-grams of 1 to 3 characters within words, marks of word ends included."""
    lower = [f" {t.lower()} " for t in texts]
    lengths = np.fromiter(map(len, lower), np.int64, len(lower))
    starts = np.cumsum(np.r_[0, lengths[:-1]])
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    letters = np.add.reduceat(letter, starts, dtype=np.int64)
    a = np.where(letter, code, np.uint32(32)).astype(np.uint32)
    found = np.full((len(a), 3), FEATURES, np.uint16)
    mix = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(17)).astype(np.uint16)
    two = a[:-1] * np.uint32(31337) + a[1:]
    found[:, 0] = np.where(letter, mix(a), FEATURES)
    found[:-1, 1] = np.where(letter[:-1] | letter[1:], mix(two + np.uint32(77)), FEATURES)
    found[:-2, 2] = np.where(letter[1:-1], mix(two[:-1] * np.uint32(31337) + a[2:] + np.uint32(991)), FEATURES)
    return found, starts, letters


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # FEATURES + 1 rows, a column for each language; the last row is zero
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        found, starts, letters = _features([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = np.tile(self.prior, (len(texts), 1))
        of = np.repeat(np.arange(len(texts)), np.diff(np.r_[starts, len(found)]))
        step = max(1, GATHERED // len(self.languages))
        for at in range(0, len(found), step):
            own = of[at : at + step]
            edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for order in range(3):
                total[own[edges]] += np.add.reduceat(self.log_prob[found[at : at + step, order]], edges, axis=0, dtype=np.float64)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        known = letters > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, 1 / total.sum(axis=1), 0.0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from rows with text and language: all of them, or about `rows` by a hash of id and text where there are more.

    Counts are summed in Spark. Every language counts that the sample holds. If the sample is empty although there are rows, all of them are learnt from.
    """
    every = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"))
    total = every.select("i").count()
    known = every.where(F.pmod(F.xxhash64("i", "t", F.lit("lang")), F.lit(max(1, -(-total // rows)))) == 0)
    if total > rows and known.isEmpty():
        known = every

    def counts(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs.tolist()):
                found, _, _ = _features([texts[i] for i in np.flatnonzero(langs == lang)])
                sums[lang] = sums.get(lang, 0) + np.bincount(found.ravel(), minlength=FEATURES + 1)
        for lang, n in sums.items():
            at = np.flatnonzero(n[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "feature", "n"])

    summed = map_arrow(known.select("l", "t"), counts, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    priors = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(priors)
    matrix = np.zeros((FEATURES + 1, len(languages)))
    got = summed.toArrow() if languages else None
    if got is not None and got.num_rows:
        number = {x: i for i, x in enumerate(languages)}
        matrix[got.column("feature").to_numpy(), [number[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    matrix = np.log(matrix + 0.05) - np.log((matrix[:-1] + 0.05).sum(axis=0)) if languages else matrix
    matrix[-1] = 0
    n = np.array([priors[x] for x in languages], float)
    return Model(languages, matrix.astype(np.float32), np.log(n / n.sum()) if languages else n)


def predict(model: Model, text: Column) -> Column:
    """A column (lang_pred, score) of whole texts; the matrix is FEATURES x languages and goes to the tasks with the function."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores, held, size = [], [], [], 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text or "")
            if size > 1_000_000 or i == len(texts) - 1:
                lang, score = shared.value.predict(held)
                langs += lang
                scores.append(score)
                held, size = [], 0
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": np.concatenate(scores) if scores else np.zeros(0)})

    return run(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; ids that are null count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, learnt from the rows that aren't held out.

    Null text, or one without a letter: `und`, score 0; so is every row if there is nothing to learn from. Null doc_id: kept
    and held out. Repeated rows: one result each. Ties: the language that is first by name. Empty table: no rows. Whole
    texts count, whatever their length; other columns are ignored.
    """
    model = train(docs.where(~held_out()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), predict(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a score of `least` or more; all columns stay as they are, whatever their names.

    Null texts and texts without a letter go. Repeated rows: all stay or go. Empty table: no rows.
    """
    model, p = train(docs.where(~held_out())), unused(docs, "lang_of")
    return docs.withColumn(p, predict(model, F.col("text"))).where((F.col(p)["lang_pred"] != UNKNOWN) & (F.col(p)["score"] >= least)).drop(p)
