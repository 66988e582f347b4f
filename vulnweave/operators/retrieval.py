"""TF-IDF retrieval of libraries for texts, over a sparse table of postings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import library_token_text, name_key, tokens
from .ranking import CELLS, Best
from .relational import cut, distinct_on, top_k


def corpus(libraries: DataFrame, position: str = "lib_idx") -> DataFrame:
    """(lib_idx, name, summary) -> lib_idx, object, tokens; the first row of each name counts."""
    once = distinct_on(libraries.select(position, "name", "summary").where(F.col("name").isNotNull()), ["name"], [F.col(position)])
    return once.select(F.col(position).alias("lib_idx"), F.lower("name").alias("object"), "summary", tokens(library_token_text(F.col("name"), F.col("summary"))).alias("tokens"))


def query_terms(queries: DataFrame, text: str = "text", entities: str | None = None, boost: float = 4.0) -> DataFrame:
    """(query_id, text) -> query_id, term, weight: repeats of a term over the number of terms.

    Terms named in the array column `entities` weigh `boost` times as much and add boost - 1 to the divisor, each time.
    """
    words = queries.select("query_id", tokens(F.col(text)).alias("words"), *([entities] if entities else []))
    if entities:
        named = F.array_distinct(F.concat(F.col(entities), F.flatten(F.transform(entities, lambda e: tokens(e)))))
        words = words.withColumn("hits", F.size(F.filter("words", lambda w: F.array_contains(named, w)))).withColumn("named", named)
        long = words.select("query_id", (F.size("words") + (boost - 1) * F.col("hits")).alias("n"), "named", F.explode("words").alias("term"))
        weighed = long.select("query_id", "term", "n", F.when(F.array_contains("named", F.col("term")), boost).otherwise(1.0).alias("b"))
        return weighed.groupBy("query_id", "term").agg((F.sum("b") / F.first("n")).alias("weight"))
    long = words.select("query_id", F.size("words").alias("n"), F.explode("words").alias("term"))
    return long.groupBy("query_id", "term").agg((F.count(F.lit(1)) / F.first("n")).alias("weight"))


@dataclass
class Asked:
    """The terms that queries ask for, by term: those of the vocabulary's i-th one are `query` and `weight` from start[i] to start[i + 1]."""

    queries: pa.Array
    vocabulary: pa.Array
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray


def asked_terms(terms: DataFrame) -> Asked:
    """From (query_id, term, weight): the one thing that is sent to every task, about 12 bytes a row."""
    rows = terms.select("query_id", "term", "weight").toArrow().sort_by([("term", "ascending"), ("query_id", "ascending")]).combine_chunks()
    queries = pc.unique(rows["query_id"])
    vocabulary = pc.unique(rows["term"])
    term = pc.index_in(rows["term"], value_set=vocabulary).to_numpy()
    return Asked(queries, vocabulary, np.searchsorted(term, np.arange(len(vocabulary) + 1)), pc.index_in(rows["query_id"], value_set=queries).to_numpy().astype(np.int32), rows["weight"].to_numpy())


def count_terms(libraries: DataFrame, asked: Asked) -> DataFrame:
    """lib_idx, object, n, ids, counts: a row a library, with the number of its tokens + 1 and how often it holds each term that is asked for.

    Texts are read and cleaned once, within their task; the short rows are kept, as document frequencies are needed before scores.
    """
    vocabulary = asked.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch["tokens"]
            sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.index_in(tokens.flatten(), value_set=vocabulary)
            known = pc.is_valid(term).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)[known]
            cells, counts = np.unique(row * max(len(vocabulary), 1) + term.drop_null().to_numpy(), return_counts=True)
            ends = np.searchsorted(cells, np.arange(len(sizes) + 1) * max(len(vocabulary), 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cells % max(len(vocabulary), 1), counts)]
            yield pa.RecordBatch.from_arrays([batch["lib_idx"], batch["object"], pa.array((sizes + 1).astype(np.int32)), *lists], ["lib_idx", "object", "n", "ids", "counts"])

    kind = libraries.schema["lib_idx"].dataType.simpleString()
    libraries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # long texts: batches bounded by bytes
    return cut(libraries.select("lib_idx", "object", "tokens").mapInArrow(run, f"lib_idx {kind}, object string, n int, ids array<int>, counts array<int>"))


def spread(start: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key i the places start[i] to start[i + 1], one after another, and how many they are."""
    sizes = start[keys + 1] - start[keys]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[keys] - ends + sizes, sizes), sizes


def pieces(work: np.ndarray, rows: int, most: int = CELLS) -> Iterator[tuple[int, int]]:
    """Runs of at most `rows` rows with at most `most` steps of work; a row with more comes alone."""
    total, at = np.r_[0, np.cumsum(work)], 0
    while at < len(work):
        to = min(at + rows, max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1))
        yield at, to
        at = to


def rank(index: DataFrame, asked: Asked, k: int, *, fill: bool = True) -> DataFrame:
    """query_id, rank, lib_idx, object, score from the rows of count_terms().

    A task scores its libraries against all queries, some rows at a time, and sends on its k best of each query only.
    """
    frequency = {r[0]: r[1] for r in index.select(F.explode(F.concat("ids", F.array(F.lit(-1)))).alias("id")).groupBy("id").count().collect()}
    n = frequency.pop(-1, 0)
    df = np.ones(len(asked.vocabulary))
    df[list(frequency)] += list(frequency.values())
    weight = asked.weight * np.repeat(np.log(max(n, 1) / df), np.diff(asked.start))
    start, query, queries = asked.start, asked.query, asked.queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, q = Best(len(queries), k), len(queries)
        for batch in batches:
            sizes = np.diff(batch["ids"].offsets.to_numpy())
            ids, tf = batch["ids"].flatten().to_numpy(), batch["counts"].flatten().to_numpy() / np.repeat(batch["n"].to_numpy(), sizes)
            first = np.r_[0, np.cumsum(sizes)]
            steps = np.r_[0, np.cumsum(start[ids + 1] - start[ids])][first]
            places = batch["lib_idx"].to_numpy(zero_copy_only=False)
            for a, b in pieces(np.diff(steps), max(1, CELLS // 2 // max(q, 1))):
                own = slice(first[a], first[b])
                at, times = spread(start, ids[own])
                cell = np.repeat(np.repeat(np.arange(b - a), sizes[a:b]), times) * q + query[at]
                scores = np.round(np.bincount(cell, np.repeat(tf[own], times) * weight[at], minlength=(b - a) * q), 9) + 0.0
                if not fill:
                    scores[np.bincount(cell, minlength=(b - a) * q) == 0] = -np.inf
                row, col = np.nonzero(best.mask(scores := scores.reshape(b - a, q), places[a:b]))
                rows = pa.Table.from_arrays([batch["lib_idx"].take(pa.array(row + a)), batch["object"].take(pa.array(row + a))], ["place", "object"])
                best.add(col, scores[row, col], rows)
        if (out := best.result()) is not None:
            yield from pa.table({"query_id": pc.take(queries, out["q"]), "lib_idx": out["place"], "object": out["object"], "score": out["score"]}).to_batches()

    spark = index.sparkSession
    from pyspark.sql.pandas.types import from_arrow_type

    kinds = (from_arrow_type(queries.type).simpleString(), index.schema["lib_idx"].dataType.simpleString())
    if not len(queries):
        return spark.createDataFrame([], f"query_id {kinds[0]}, rank int, lib_idx {kinds[1]}, object string, score double")
    found = index.mapInArrow(run, f"query_id {kinds[0]}, lib_idx {kinds[1]}, object string, score double")
    return top_k(found, ["query_id"], [F.desc("score"), F.col("lib_idx")], k).select("query_id", "rank", "lib_idx", "object", "score")


def search(libraries: DataFrame, queries: DataFrame, k: int, *, entities: str | None = None, fill: bool = True) -> DataFrame:
    """query_id, rank, lib_idx, object, score: the k best libraries of each query with a token; ties in corpus order.

    libraries: as from corpus(). Scores are rounded to 9 digits before ranking. fill: libraries without a shared term count with score 0.
    """
    asked = asked_terms(query_terms(queries, entities=entities))
    return rank(count_terms(libraries, asked), asked, k, fill=fill)


def name_hits(libraries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, pos, entity) -> query_id, pos, lib_idx, object: libraries whose name key is the entity's; of equal keys the last."""
    keys = libraries.groupBy(name_key(F.col("object")).alias("key")).agg(F.max_by("object", "lib_idx").alias("object"), F.max("lib_idx").alias("lib_idx"))
    asked = entities.withColumn("key", F.replace(F.lower("entity"), F.lit(" "), F.lit("")))
    return asked.join(keys, "key").select("query_id", "pos", "lib_idx", "object")


def search_with_names(libraries: DataFrame, queries: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """query_id, rank, object: libraries found by entity name first, in the entities' order, then those by TF-IDF, k in all."""
    listed = entities.groupBy("query_id").agg(F.collect_set("entity").alias("named"))
    boosted = queries.join(listed, "query_id", "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    asked = asked_terms(query_terms(boosted, entities="named"))
    index = count_terms(libraries, asked)
    by_name = name_hits(index, entities).groupBy("query_id", "object").agg(F.min("pos").alias("place")).withColumn("step", F.lit(0))
    by_score = rank(index, asked, k).select("query_id", "object", F.col("rank").alias("place"), F.lit(1).alias("step"))
    worded = queries.where(F.size(tokens(F.col("text"))) > 0).select("query_id")
    both = by_name.join(worded, "query_id", "left_semi").unionByName(by_score.join(by_name, ["query_id", "object"], "left_anti"))
    return top_k(both, ["query_id"], [F.col("step"), F.col("place"), F.col("object")], k).select("query_id", "rank", "object")
