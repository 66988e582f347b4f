"""Byte-level BPE: encoding by a global shuffle of distinct words, decoding by the token-byte table; plain per-text encoding for packing."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, partitions

#: Characters of text that share one local vocabulary.
BATCH_CHARS = 12_000_000

#: Bytes of text for each bucket of distinct words, so that a bucket's words stay few however large the corpus is.
BUCKET_BYTES = 64 << 20

#: Texts of these characters alone (ASCII without rare controls, Latin letters) are split alike by Python's own regular expressions.
_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ɏ]")
_QUICK = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    """The merge ranks of a .tiktoken file, or of the vocabulary in a tokenizers .json file, by token bytes."""
    with open(path, "rb") as file:
        if not path.endswith(".json"):
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        model = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in model["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


@functools.cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


@functools.cache
def _hf(path: str):
    """(the tokenizer, a pattern of the added tokens' contents)"""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    added = [t.content for t in found.get_added_tokens_decoder().values()]
    return found, re.compile("|".join(map(re.escape, added)) if added else r"(?!)")


def encode_text(text: str, path: str) -> list[int]:
    """Ids of one text by a tokenizers .json file, without special tokens: what the plain call of that library gives.

    Plain Latin texts, which both libraries split alike, go through the faster one with the same ranks (tests hold it against
    tokenizers); all others, and those that spell an added token, through tokenizers itself.
    """
    slow, added = _hf(path)
    return slow.encode(text, add_special_tokens=False).ids if _PLAIN.search(text) or added.search(text) else encoding(path).encode_ordinary(text)


@functools.cache
def _splitter():
    import public_tokenizers
    import regex

    white = r"\t-\r \x85\xa0  -     　"
    own = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{white}\\p{{L}}\\p{{N}}]").replace(r"(?!\S)", f"(?![^{white}])").replace(r"\s+", f"[{white}]+")
    return regex.compile(own)


def words_of(text: str) -> list[str]:
    """The pre-tokens of a text, in order; joined they are the text."""
    return (_splitter() if _PLAIN.search(text) else _QUICK).findall(text)


def _squeeze(*arrays: np.ndarray | bytes) -> bytes:
    import zstandard

    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(parts), *map(len, parts)], "<i8").tobytes(), *parts]))


def _expand(blob: bytes) -> list[bytes]:
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(whole[:8], "<i8")[0])
    ends = np.cumsum(np.r_[8 * (n + 1), np.frombuffer(whole[8 : 8 * (n + 1)], "<i8")])
    return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _groups(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[int, list, list[list[str]], list[str]]]:
    """(batch id, doc ids, words of each document, distinct words, frequent first). How Arrow cuts its batches has no part in it."""
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 32
    ids, texts, held, n = [], [], 0, 0

    def flush():
        split = [words_of(t) for t in texts]
        count = Counter()
        for words in split:
            count.update(words)
        return first + n, ids, split, [w for w, _ in count.most_common()]

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= chars:
                yield flush()
                ids, texts, held, n = [], [], 0, n + 1
    if ids:
        yield flush()


def _digest(words: list[str]) -> int:
    return zlib.crc32("\0".join(words).encode("utf-8", "surrogatepass"))


def _vocabulary(docs: DataFrame, buckets: int, chars: int) -> DataFrame:
    """A row for each batch of documents and bucket of words: the batch's distinct words there, with their local numbers."""

    def rows(batches):
        for batch, _, _, words in _groups(batches, chars):
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int32, len(raw))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            found = []
            for b, (start, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if start < end:
                    at = order[start:end]
                    own = [raw[i] for i in at.tolist()]
                    found.append((b, _squeeze(np.diff(at, prepend=0).astype("<u4"), np.fromiter(map(len, own), "<u4", len(own)), b"".join(own))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([batch] * len(found), pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["bucket", "batch", "words"])

    return map_arrow(docs, rows, "bucket int, batch long, words binary")


def _encoded(vocabulary: DataFrame, buckets: int, path: str, most: int = 2_000_000) -> DataFrame:
    """Each distinct word meets its equals of all batches in one bucket and is encoded once there; ids go back to the batches.

    Buckets stream through: a task keeps its own distinct words, `most` at a time, and never the rows of a bucket.
    """

    def rows(batches):
        one = encoding(path)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            ids_of = []
            for blob in batch.column(2).to_pylist():
                at, lengths, text = _expand(blob)
                ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
                if len(known) > most:
                    known.clear()
                ids, counts, start = [], [], 0
                for end in ends:
                    word = text[start:end]
                    start = end
                    if (own := known.get(word)) is None:
                        own = known[word] = one(word)
                    ids += own
                    counts.append(len(own))
                ids_of.append(_squeeze(at, np.array(counts, "<u4"), np.array(ids, "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids_of, pa.binary())], ["batch", "ids"])

    return map_arrow(vocabulary.repartition(buckets, "bucket"), rows, "batch long, ids binary")


def _positions(docs: DataFrame, chars: int) -> DataFrame:
    """A row for each document: the local numbers of its words, by position."""

    def rows(batches):
        for batch, ids, split, words in _groups(batches, chars):
            number = {w: i for i, w in enumerate(words)}
            mark = _digest(words)
            blobs = [_squeeze(np.fromiter(map(number.__getitem__, own), "<u4", len(own)).reshape(-1, 1).view("u1").T.copy() if own else b"") for own in split]
            n = len(ids)
            for a in range(0, n, 512):
                b = min(n, a + 512)
                yield pa.RecordBatch.from_arrays([pa.array([batch] * (b - a), pa.int64()), pa.array(ids[a:b], pa.int64()), pa.array(blobs[a:b], pa.binary()), pa.array([len(words)] * (b - a), pa.int32()), pa.array([mark] * (b - a), pa.int64())], ["batch", "doc_id", "words", "n_words", "mark"])

    return map_arrow(docs, rows, "batch long, doc_id long, words binary, n_words int, mark long")


def encode(docs: DataFrame, path: str, *, output: str = "ids", batch_chars: int = BATCH_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts by a .tiktoken file's ranks: distinct words are shuffled and encoded once each, then put back by position.

    Pre-tokens are numbered within batches of documents, so a word's row is shuffled once a batch rather than once an
    occurrence, and hot words stay small. The input is read twice and has to give the same partitions both times, as a scan
    or a checkpoint does; batches whose vocabularies differ raise an error. output 'ids': doc_id, ids (little-endian unsigned
    32-bit); 'digest': doc_id, n_tokens, ids_sha256, decoded_sha256, where the ids are decoded again by the token-byte table
    (its size is the vocabulary's).

    Null or empty text: no ids. Null doc_id: kept. Repeated rows: one result each. Empty table: no rows. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(docs), -(-size // BUCKET_BYTES))
    by_batch = _encoded(_vocabulary(source, buckets, batch_chars), buckets, path)
    digest = output == "digest"

    def rebuild(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.column("n_words")[0].as_py() if left.num_rows else 0
        counts, parts = np.zeros(n, np.int64), []
        for blob in right.column("ids").to_pylist():
            at, own, ids = _expand(blob)
            at, own = np.cumsum(np.frombuffer(at, "<u4")), np.frombuffer(own, "<u4").astype(np.int64)
            if len(at) and at[-1] >= n or counts[at].any():
                raise RuntimeError("the input gave other partitions when it was read again: checkpoint it first")
            counts[at] = own
            parts.append((at, own, np.frombuffer(ids, "<u4")))
        if n and not counts.all():
            raise RuntimeError("the input gave other partitions when it was read again: checkpoint it first")
        starts = np.cumsum(np.r_[0, counts])
        flat = np.zeros(int(starts[-1]), "<u4")
        for at, own, ids in parts:
            flat[np.repeat(starts[at] - np.cumsum(np.r_[0, own[:-1]]), own) + np.arange(len(ids))] = ids
        table = {i: t for t, i in ranks_of(path).items()} if digest else {}
        out = []
        for blob in left.column("words").to_pylist():
            raw = _expand(blob)[0]
            words = np.frombuffer(raw, "u1").reshape(4, -1).T.copy().view("<u4").ravel() if raw else np.zeros(0, "<u4")
            own = counts[words]
            ids = flat[np.repeat(starts[words] - np.cumsum(np.r_[0, own[:-1]]), own) + np.arange(int(own.sum()))] if len(words) else flat[:0]
            out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(b"".join(map(table.__getitem__, ids.tolist()))).hexdigest()) if digest else ids.tobytes())
        cells = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())] if digest else [pa.array(out, pa.binary())]
        return pa.Table.from_arrays([left.column("doc_id").combine_chunks(), *cells], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids binary"
    return _positions(source, batch_chars).groupBy("batch").cogroup(by_batch.groupBy("batch")).applyInArrow(rebuild, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (as encode gives them) -> doc_id, bytes, by the token-byte table. Unknown ids raise; null ids give null."""

    def rows(batches):
        table = {i: t for t, i in ranks_of(path).items()}
        for batch in batches:
            back = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], ["doc_id", "bytes"])

    return map_arrow(encoded.select("doc_id", "ids"), rows, "doc_id long, bytes binary")
