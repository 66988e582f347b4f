"""Which of some strings a long text holds, exactly: a pass over the texts, without a row for each of their parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row by which a passage is met first.
GRAM = 4

#: Letters by their frequency in prose, the commonest first; other bytes count as rarer.
_COMMON = b" etaoinsrlhdcumpgfbywvkxjqz"


def _mix(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each n codes in a row; equal runs give equal numbers."""
    out = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i].astype(np.uint64) + np.uint64(1)
    return out


class Passages:
    """Passages by the hash of some words in a row from their inside, which a text that holds the passage has whole."""

    def __init__(self, passages: list[str]) -> None:
        self.texts = passages
        inner = [[w for w in pc.ascii_split_whitespace(pa.array([p]))[0].as_py()[1:-1]] for p in passages]
        self.vocabulary = pa.array(sorted({w for ws in inner for w in ws}), pa.string())
        code = {w: i for i, w in enumerate(self.vocabulary.to_pylist())}
        self.any = [i for i, ws in enumerate(inner) if not ws]  # too short: looked for in every text
        self.grams: dict[int, dict[int, list[int]]] = {}
        for i, ws in enumerate(inner):
            if ws:
                n = min(GRAM, len(ws))
                self.grams.setdefault(n, {}).setdefault(int(_mix(np.array([code[w] for w in ws[:n]]), n)[0]), []).append(i)
        self.keys = {n: np.array(sorted(of), np.uint64) for n, of in self.grams.items()}

    def held(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Row of a text and number of a passage that it holds, each once."""
        words = pc.ascii_split_whitespace(texts)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
        codes = pc.index_in(words.flatten(), value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        near = {(r, i) for r in np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False)).tolist() for i in self.any}
        for n, keys in self.keys.items():
            mixed, fine = _mix(codes, n), np.lib.stride_tricks.sliding_window_view(codes, n).min(axis=1) >= 0 if len(codes) >= n else np.zeros(0, bool)
            places = np.flatnonzero(fine)
            places = places[np.isin(mixed[places], keys)]
            for p in places[row[places] == row[places + n - 1]]:
                near.update((int(row[p]), i) for i in self.grams[n][int(mixed[p])])
        text = {r: texts[r].as_py() for r in {r for r, _ in near}}
        yield from ((r, i) for r, i in sorted(near) if self.texts[i] in text[r])


def passages_held(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(item, text) x (query_id, passage) -> query_id, item: a row for each text and passage that it holds. Passages go to each task."""
    asked = passages.where(F.col("passage").isNotNull()).select("query_id", "passage").toArrow().combine_chunks()
    ids, known = asked["query_id"], Passages(asked["passage"].to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := list(known.held(batch["text"])):
                rows, which = (pa.array(x) for x in zip(*found))
                yield from pa.table({"query_id": ids.take(which), "item": batch["item"].take(rows)}).to_batches()

    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return texts.select("item", "text").mapInArrow(run, f"query_id {passages.schema['query_id'].dataType.simpleString()}, item string")


class Strings:
    """Strings by their rarest run of three bytes (or all of a shorter one), and where it stands in them."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = [s.encode() for s in strings]
        self.short = [i for i, s in enumerate(self.strings) if len(s) < 3]
        self.grams: dict[int, list[int]] = {}
        for i, s in enumerate(self.strings):
            if len(s) >= 3:
                at = min(range(len(s) - 2), key=lambda a: sum(len(_COMMON) - _COMMON.find(bytes([c])) if c in _COMMON else -9 for c in s[a : a + 3]))
                gram = s[at] << 16 | s[at + 1] << 8 | s[at + 2]
                self.grams.setdefault(gram, []).append(i)

    def held(self, texts: pa.Array) -> list[list[int]]:
        """The numbers of the strings that each text holds; a null text holds none."""
        out: list[list[int]] = []
        table = np.zeros(1 << 24, bool)  # made by the task, not sent to it
        table[list(self.grams)] = True
        for a in range(0, len(texts), 512):
            part = [t.encode() if t is not None else None for t in texts.slice(a, 512).to_pylist()]
            sizes = np.fromiter((len(t) if t is not None else 0 for t in part), np.int64, len(part))
            b = np.frombuffer(b"".join(t or b"" for t in part), np.uint8).astype(np.int32)
            code = b[:-2] << 16 | b[1:-1] << 8 | b[2:] if len(b) > 2 else np.zeros(0, np.int32)
            places = np.flatnonzero(table[code])
            row = np.searchsorted(np.cumsum(sizes), places, "right")
            met = np.unique(row << 24 | code[places].astype(np.int64))  # a run across two texts only makes a string be tested in vain
            near: list[list[int]] = [[] if t is None else list(self.short) for t in part]
            for x in met.tolist():
                if part[x >> 24] is not None:
                    near[x >> 24] += self.grams[x & 0xFFFFFF]
            out += [sorted(i for i in ids if self.strings[i] in t) if t is not None else [] for t, ids in zip(part, near)]
        return out
