"""The most similar entries of a long list for each of some names: all pairs, in small matrices, with bounded memory.

A similarity of 0.5 lets most pairs of like-built names through, so keys that partners must share select nothing. Here the names
go to every task, the list streams by, and a step of the distance's table is one operation over some thousand entries. A task keeps
its k best entries of each name and sends on no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import CELLS, Best
from .relational import top_k
from .retrieval import spread

#: Characters of entries that are compared at a time: what a processor's cache holds.
BLOCK = 1 << 17


def _codes(texts: list[str], length: int) -> np.ndarray:
    """Code points, a column for each text and a row for each place; 0x110000, which is no character, where a text has ended."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((length, len(texts)), 0x110000, np.uint32)
    col = np.repeat(np.arange(len(texts)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), col] = flat
    return out


class Block:
    """Entries of like length, with a matrix for each character that is asked for: where it stands."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = _codes(texts, int(self.sizes.max(initial=0)))
        self.seen: dict[str, np.ndarray] = {}

    def where(self, char: str) -> np.ndarray:
        if (found := self.seen.get(char)) is None:
            found = (self.codes == ord(char)).view(np.uint8)
            if len(self.seen) < 256:
                self.seen[char] = found
        return found


def common_substring(name: str, block: Block) -> np.ndarray:
    """Length of the longest common substring with each entry."""
    length, n = block.codes.shape
    kind = np.uint8 if min(len(name), length) < 255 else np.int32
    last, row, best = (np.zeros((length + 1, n), kind) for _ in range(3))
    for char in name:
        np.add(last[:-1], kind(1), out=row[1:])
        np.multiply(row[1:], block.where(char), out=row[1:])
        np.maximum(best, row, out=best)
        last, row = row, last
    return best.max(axis=0).astype(np.int64)


def edits(name: str, block: Block, insert: int = 1, delete: int = 1, substitute: int = 1) -> np.ndarray:
    """Weighted edit distance from the name to each entry."""
    length, n = block.codes.shape
    most = max(insert, delete, substitute) * (len(name) + length + 1)
    kind = np.uint8 if most < 255 else np.int16 if most < 32_000 else np.int32
    last, row = np.empty((length + 1, n), kind), np.empty((length + 1, n), kind)
    last[:] = (np.arange(length + 1) * insert)[:, None]
    for i, char in enumerate(name, 1):
        row[0] = i * delete
        np.multiply(1 - block.where(char), kind(substitute), out=row[1:], casting="unsafe")
        row[1:] += last[:-1]
        np.minimum(row[1:], last[1:] + kind(delete), out=row[1:])
        for j in range(1, length + 1):
            np.minimum(row[j], row[j - 1] + kind(insert), out=row[j])
        last, row = row, last
    return last[block.sizes, np.arange(n)].astype(np.int64)


def _lev(name: str, block: Block) -> np.ndarray:
    longer = np.maximum(len(name), block.sizes)
    return 1 - edits(name, block) / np.maximum(longer, 1)


def _lcs(name: str, block: Block) -> np.ndarray:
    both = len(name) + block.sizes
    return np.where(both == 0, 1.0, 2.0 * common_substring(name, block) / np.maximum(both, 1))


def _weighted(name: str, block: Block) -> np.ndarray:
    most = 2 * len(name)
    return (most - edits(name, block, 1, 2, 2)) / most if most else np.full(len(block.sizes), np.nan)


#: Measures of two texts: as the columns of functions.similarity.
TEXTS: dict[str, Callable[[str, Block], np.ndarray]] = {"lev": _lev, "lcs": _lcs, "weighted": _weighted}

#: Measures of two lists of words, with the weight of a word that only one side has.
WORDS = {"cos": 1.4054651081081644, "sco": 1.0}


def _blocks(texts: list[str]) -> Iterator[np.ndarray]:
    """Places of entries of like length, together at most BLOCK characters (or one entry)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order, at = np.argsort(sizes, kind="stable"), 0
    sizes = sizes[order]
    while at < len(order):
        most = sizes[at] * 5 // 4 + 4
        to = min(int(np.searchsorted(sizes, most, "right")), at + max(1, BLOCK // int(most)))
        yield order[at:to]
        at = to


def _word_counts(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and count of the vocabulary's words, and the sum of squared counts of all words of each row."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    own = pc.unique(flat)
    cells, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(own), 1) + pc.index_in(flat, value_set=own).to_numpy(zero_copy_only=False), return_counts=True)
    row, word = cells // max(len(own), 1), cells % max(len(own), 1)
    squares = np.bincount(row, counts.astype(float) ** 2, minlength=len(sizes))
    known = pc.index_in(own, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)[word] if len(own) else word
    return row[known >= 0], known[known >= 0], counts[known >= 0].astype(float), squares


def _text_scores(names: list[str], kind: str) -> Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]:
    def run(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        every = texts.to_pylist()
        for rows in _blocks(every):
            block = Block([every[i] for i in rows])
            yield rows, np.stack([TEXTS[kind](name, block) for name in names], axis=1)

    return run


def _word_scores(lists: pa.Array, unshared: float) -> Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]:
    vocabulary = pc.unique(lists.flatten())
    name, word, counts, own = _word_counts(lists, vocabulary)
    order = np.argsort(word, kind="stable")
    name, counts, start, n, u = name[order], counts[order], np.searchsorted(word[order], np.arange(len(vocabulary) + 1)), len(lists), unshared**2

    def run(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(words), step := max(1, CELLS // 4 // max(n, 1))):
            part = words.slice(a, step)
            row, word, held, squares = _word_counts(part, vocabulary)
            at, times = spread(start, word)
            cell = np.repeat(row, times) * n + name[at]
            shared = lambda x: np.bincount(cell, x, minlength=len(part) * n).reshape(len(part), n)
            b, c = np.repeat(held, times), counts[at]
            sides = (u * own[None, :] - (u - 1) * shared(c * c)) * (u * squares[:, None] - (u - 1) * shared(b * b))
            yield np.arange(a, a + len(part)), shared(b * c) / np.sqrt(np.where(sides > 0, sides, 1.0))

    return run


def nearest(names: DataFrame, entries: DataFrame, kind: str, least: float, k: int, *, last_place: bool = False) -> DataFrame:
    """(name, value) x (place, entry, value) -> name, rank, place, entry, sim: the k best entries of each name with a similarity of `least` or more.

    value: what is compared, a text or, for "cos" and "sco", the words. Names must be distinct; similarities are rounded to 9
    digits; ties by the smallest place (or the greatest: last_place). The names are collected and sent to each task.
    """
    spark, place = entries.sparkSession, entries.schema["place"].dataType.simpleString()
    asked = names.where(F.col("name").isNotNull()).select("name", "value").toArrow().combine_chunks()
    schema = f"name string, place {place}, entry string, sim double"
    if not asked.num_rows:
        return spark.createDataFrame([], f"name string, rank int, place {place}, entry string, sim double")
    label = asked["name"].combine_chunks()
    chunk = 256  # names that are compared at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for a in range(0, len(label), chunk):
            values = asked["value"].slice(a, chunk).combine_chunks()
            scores = _word_scores(values, WORDS[kind]) if kind in WORDS else _text_scores(values.to_pylist(), kind)
            parts.append((a, scores, Best(len(values), k, last_place=last_place)))
        for batch in batches:
            places = batch["place"].to_numpy(zero_copy_only=False)
            for a, scores, best in parts:
                for rows, sims in scores(batch["value"]):
                    sims = np.round(sims, 9)
                    sims[~(sims >= least)] = -np.inf
                    row, col = np.nonzero(best.mask(sims, places[rows]))
                    at = pa.array(rows[row])
                    best.add(col, sims[row, col], pa.Table.from_arrays([batch["place"].take(at), batch["entry"].take(at)], ["place", "entry"]))
        for a, _, best in parts:
            if (out := best.result()) is not None:
                yield from pa.table({"name": label.slice(a, chunk).take(out["q"]), "place": out["place"], "entry": out["entry"], "sim": out["score"]}).to_batches()

    # a short row each: dealt anew, since a file may be one piece only
    found = entries.select("place", "entry", "value").where(F.col("entry").isNotNull()).repartition("place").mapInArrow(run, schema)
    return top_k(found, ["name"], [F.desc("sim"), F.desc("place") if last_place else F.col("place")], k).select("name", "rank", "place", "entry", "sim")
