"""Near-duplicate groups at a given similarity of word shingles: SimHash fingerprints, pigeonring filtering, then the real similarity.

A SimHash of 64 bits is too short here: texts whose five-word shingles have a Jaccard similarity of 0.8 differ in 15 % of the bits, 9.7 of 64 on
average and up to 18, and four segments of 16 bits with 18 differing bits select nothing. So the fingerprint is wider, 320 bits or more: the same majority
of the shingles' hash bits, in a ring of 40 or more segments of 8 bits.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, key_chunks, lean, map_arrow, partitions, runs, unused
from ._graph import connected_components

#: Bits of a segment, and bits of it that may differ on average: a quarter, where 0.15 are expected at a similarity of 0.8.
BITS, BUDGET = 8, 2

#: The share of equal bits at a Jaccard similarity of 0.8 of sets of one size (a cosine of 8/9), and the share of such pairs
#: that may have no bucket in common. Segments are as many as this takes.
AGREE, MISSED = 1 - math.acos(8 / 9) / math.pi, 1 / 200_000

#: Fingerprints a bucket, on average over random ones: with more texts, keys take further bits of the ring.
BUCKET = 8_192

#: Sets of so many shingles also meet by their least hashes, which similar ones share: few votes tie often, and more bits differ.
#: Sets of up to 1 / 0.8 times as many can be similar to them.
SHORT = 20

#: Fingerprints that meet in one task at a time.
CELL = 8_192

#: Candidates of other groups that a text is compared with in a round, besides one that changes. When rounds bring no more
#: links, texts with more candidates are compared with all of them.
NEAREST = 24

#: Pairs that a task compares at a time, and rows of proposals that it holds.
PAIRS, HELD = 8_192, 250_000

#: Bits of a set's bitmap in the last round.
BITMAP = 4096

_WORDS: dict[bytes, int] = {}


def _word(word: bytes) -> int:
    import xxhash

    if (known := _WORDS.get(word)) is None:
        if len(_WORDS) > 50_000:
            _WORDS.clear()  # a cache only: hashes are computed anew
        known = _WORDS[word] = xxhash.xxh64_intdigest(word, 7)
    return known


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of the set of word shingles, sorted. Words are runs of bytes other than ASCII white space, A-Z lower-cased; fewer than `width` words: the whole sequence; none: no shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_word, words), np.uint64, len(words))
    n, k = max(1, len(w) - width + 1), min(width, len(w))
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def shape(texts: int) -> tuple[int, int]:
    """Bits of a key and segments of the ring for so many texts. Segments come in eights, a 64-bit word of the fingerprint."""
    bits = min(2 * BITS, max(BITS, math.ceil(math.log2(max(texts, 1) / BUCKET))))
    return bits, 8 * math.ceil(math.log(MISSED) / math.log1p(-(AGREE**bits)) / 8)


def fingerprint(hashes: np.ndarray, segments: int) -> bytes:
    """The SimHash of a set of shingles, a byte a segment: a bit is 1 if it is set in over half of the hashes, each spread over all bits. No shingle: zero."""
    votes = np.zeros(BITS * segments, np.int64)
    seeds = np.arange(1, segments // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 8160):
        z = hashes[at : at + 8160, None] + seeds
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ (z >> np.uint64(31))).astype("<u8").view(np.uint8), axis=1)
        whole = len(bits) // 255 * 255
        votes += bits[:whole].reshape(-1, 255, len(votes)).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[whole:].sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes)).tobytes()


def least_hashes(hashes: np.ndarray, least: float) -> np.ndarray:
    """Of a small set the first hashes, so many that two sets with a Jaccard similarity of `least` share one; of others none."""
    n = len(hashes)
    return hashes[: n - math.ceil(least * n - 1e-9) + 1] if 0 < n <= SHORT / least else hashes[:0]


def _id(text: str) -> Column:
    """The node of a text: its 64-bit hash. Equal texts are one node."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _fingerprints(docs: DataFrame, width: int, least: float, segments: int) -> DataFrame:
    """id, print of each distinct text, from rows (id, text): the fingerprint and, of a small set, its least hashes after it."""

    def rows(batches):
        for batch in batches:
            sets = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
            out = [fingerprint(h, segments) + least_hashes(h, least).astype("<u8").tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "print"])

    return map_arrow(docs.select("id", F.col("text").cast("binary").alias("text")), rows, "id long, print binary").groupBy("id").agg(F.min("print").alias("print"))


def _keys(prints: list[bytes], bits: int, segments: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the row of each, and all fingerprints. A key is a segment i of the ring and `bits` bits from its start; or, below zero, one of the least hashes.

    Pigeonring: if the segments differ in BUDGET bits each on average at most, some segment starts a chain whose first l
    segments differ in at most l * BUDGET bits together, for every l. Buckets hold the chains that begin with an equal segment.
    Below as many differing bits as segments there is one for certain, beyond that nearly always: see MISSED.
    """
    codes = np.frombuffer(b"".join([p[:segments] for p in prints]), np.uint8).reshape(-1, segments)
    wide = codes.astype(np.int64)
    ring = np.arange(0, segments, every)
    keys = (ring << 16 | wide[:, ring] << 8 | wide[:, (ring + 1) % segments] >> (2 * BITS - bits) << (2 * BITS - bits)).ravel()
    at = np.repeat(np.arange(len(prints)), len(ring))
    more = [(len(p) - segments) // 8 for p in prints]
    hashes = np.frombuffer(b"".join([p[segments:] for p in prints]), "<u8") | np.uint64(1 << 63)
    return np.r_[keys, hashes.view(np.int64)], np.r_[at, np.repeat(np.arange(len(prints)), more)], codes


def _rows(texts: DataFrame, bits: int, segments: int, every: int = 1) -> DataFrame:
    """(id, root, may, print) -> key, id, root, may, codes: a row for each key; with size and bits of a set, where these are there."""
    rest = [c for c in ("size", "bits") if c in texts.columns]

    def rows(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys, own, codes = _keys(batch.column("print").to_pylist(), bits, segments, every)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(segments), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                own = pa.array(own)
                columns = {c: batch.column(c).take(own) for c in ("id", "root", "may", *rest)}
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "id": columns["id"], "root": columns["root"], "may": columns["may"], "codes": codes.take(own)} | {c: columns[c] for c in rest})

    return texts.select("id", "root", "may", "print", *rest).mapInArrow(lean(rows), "key long, id long, root long, may boolean, codes binary" + (", size long, bits binary" if rest else ""))


def _large(texts: DataFrame, bits: int, segments: int, every: int = 1) -> DataFrame:
    """key, n of the buckets with over CELL texts."""

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(batch.column(0).to_pylist(), bits, segments, every)[0])], ["key"])

    return cut(texts.select("print").mapInArrow(lean(keys), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL))


def _fewest(u: np.ndarray, v: np.ndarray, rank: np.ndarray, other: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The `most` rows of smallest rank for each u, each v once."""
    order = np.lexsort((v, rank, u))
    u, v, rank, other = u[order], v[order], rank[order], other[order]
    keep = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
    u, v, rank, other = u[keep], v[keep], rank[keep], other[keep]
    keep = np.arange(len(u)) - np.searchsorted(u, u, "left") < most
    return u[keep], v[keep], rank[keep], other[keep]


def _bitmaps(sets: DataFrame) -> DataFrame:
    """id, size, bits: of each set of shingles its number and a bitmap of its hashes."""

    def rows(batches):
        for batch in batches:
            size, bits = [], []
            for blob in batch.column(1).to_pylist():
                h = np.frombuffer(blob, "<u8")
                own = np.zeros(BITMAP, bool)
                own[(h & np.uint64(BITMAP - 1)).astype(np.int64)] = True
                size.append(len(h))
                bits.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(bits, pa.binary())], ["id", "size", "bits"])

    return map_arrow(sets, rows, "id long, size long, bits binary")


def _may_be_similar(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float) -> np.ndarray:
    """False only where the Jaccard similarity of two sets is below `least`: each bit that one set alone has is a shingle that the other lacks."""
    common = np.minimum(size_a - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), size_b - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return common >= least * (size_a + size_b - common) - 1e-9


def _meetings(batches, least: float | None = None, top: bool = True):
    """Pairs of rows of a cell and key with different roots whose chain of budgets, the last of which is the whole distance, holds: ids of both, differing bits, whether each asks.

    Rows with equal sides >= 0 meet elsewhere and are not compared here; in cells without sides the rows of the largest group
    don't ask if `top`. With `least`, rows have sizes and bitmaps of their sets, and pairs that these show to be less similar are left out.
    """
    for chunk in key_chunks(batches, "cell", 10_000):
        cell, key, ids, root, side = (chunk.column(c).to_numpy() for c in ("cell", "key", "id", "root", "side"))
        codes = np.frombuffer(b"".join(chunk.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        segments = codes.shape[1]
        budgets = BUDGET * np.arange(1, segments + 1)
        asks = chunk.column("asks").to_numpy(zero_copy_only=False).copy()
        if least is not None:
            size, bits = chunk.column("size").to_numpy(), np.frombuffer(b"".join(chunk.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
        edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])])
        ends = np.r_[edges[1:], len(cell)]
        for start, end in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist(), strict=True):
            own = slice(start, end)
            whole = side[start] < 0
            if whole and top:
                group, n = np.unique(root[own], return_counts=True)
                if len(group) == 1:
                    continue
                asks[own] &= root[own] != group[::-1][np.argmax(n[::-1])]
            # the first word of the chain behind the segment that starts it
            ring = int(key[start] >> 16) if key[start] >= 0 else -1
            word = np.ascontiguousarray(codes[own][:, (ring + 1 + np.arange(8)) % segments]).view(np.uint64)[:, 0]
            fit = 9 * BUDGET if ring >= 0 else 28  # of a small set's bits 0.19 differ; these have the whole distance as their only other test
            a = np.flatnonzero(asks[own] if whole else asks[own] & (side[own] == 1))
            b = np.arange(end - start) if whole else np.flatnonzero(side[own] == 0)
            for i, j in itertools.product(range(0, len(a), 256), range(0, len(b), 4096)):
                x, y = np.nonzero(np.bitwise_count(word[a[i : i + 256], None] ^ word[b[j : j + 4096]]) <= fit)
                x, y = a[i : i + 256][x] + start, b[j : j + 4096][y] + start
                fine = (root[x] != root[y]) & ((x < y) | ~asks[y]) if whole else root[x] != root[y]
                x, y = x[fine], y[fine]
                for at in range(0, len(x), PAIRS):
                    u, v = x[at : at + PAIRS], y[at : at + PAIRS]
                    differ = np.bitwise_count(codes[u] ^ codes[v])
                    far = differ.sum(axis=1, dtype=np.int64)
                    if ring >= 0:
                        fine = (np.roll(differ, -ring, axis=1).cumsum(axis=1, dtype=np.int64) <= budgets).all(axis=1)
                    else:
                        fine = far <= 3 * segments
                    if least is not None:
                        fine[fine] = _may_be_similar(bits[u[fine]], bits[v[fine]], size[u[fine]], size[v[fine]], least)
                    if fine.any():
                        u, v = u[fine], v[fine]
                        yield ids[u], ids[v], far[fine], asks[u], asks[v]


def _dealt_out(cells: DataFrame) -> DataFrame:
    return cells.repartition(partitions(cells), "cell").sortWithinPartitions("cell", "key")


def _propose(cells: DataFrame, salt: int, nearest: int) -> DataFrame:
    """(cell, key, id, root, codes, side, asks) -> u, v, more_u, more_v: for each id that asks candidates of other roots, the `nearest` ones by fingerprint and the one that comes first in an order of this round.

    more_u, more_v: the id has further candidates that are not among the pairs. A task gives one row an id.
    """

    def compare(batches):
        held = ([], [], [], [])
        for x, y, far, asks_x, asks_y in _meetings(batches):
            for u, v, own in ((x, y, asks_x), (y, x, asks_y)):
                order = ((v.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(2)).astype(np.int64)
                for column, value in zip(held, (u, v, far, order), strict=True):
                    column.append(value[own])
            if sum(map(len, held[0])) > HELD:
                held = fewer(held)
                if len(held[0][0]) > HELD // 2:
                    yield out(held)
                    held = ([], [], [], [])
        if held[0]:
            yield out(fewer(held))

    def fewer(held):
        u, v, far, order = (np.concatenate(x) for x in held)
        by_far = _fewest(u, v, far, order, nearest + 1)  # one more, which tells that there are more
        by_order = _fewest(u, v, order, far, 1)
        return tuple([np.r_[a, b]] for a, b in zip(by_far, (by_order[0], by_order[1], by_order[3], by_order[2]), strict=True))

    def out(held):
        u, v, far, order = (x[0] for x in held)
        place = np.lexsort((v, u))
        place = place[np.r_[True, (np.diff(u[place]) != 0) | (np.diff(v[place]) != 0)]] if len(place) else place
        u, v, far, order = u[place], v[place], far[place], order[place]
        start, _ = runs(u)
        offsets = pa.array(np.r_[start, len(u)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (v, far, order)]
        return pa.RecordBatch.from_arrays([pa.array(u[start]), *lists], ["id", "with", "far", "place"])

    met = _dealt_out(cells).mapInArrow(lean(compare), "id long, with array<long>, far array<long>, place array<long>")
    found = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("with", "far", "place"))))  # a few from each bucket of the id
    by = lambda c: F.array_sort(F.transform("found", lambda x: F.struct(x[c].alias("rank"), x["with"].alias("with"))))
    more = (F.size("found") > nearest).alias("more")
    chosen = met.groupBy("id").agg(found.alias("found")).select("id", more, F.explode(F.concat(F.slice(by("far"), 1, nearest), F.slice(by("place"), 1, 1))).alias("x"))
    pairs = chosen.select(F.least("id", "x.with").alias("u"), F.greatest("id", "x.with").alias("v"), "id", "more")
    return pairs.groupBy("u", "v").agg(*[F.max(F.col("more") & (F.col("id") == F.col(c))).alias(f"more_{c}") for c in ("u", "v")])


def _all_pairs(cells: DataFrame, least: float) -> DataFrame:
    """(cell, key, id, root, codes, side, asks, size, bits) -> u, v: every candidate of other roots of each id that asks, but for those whose bitmaps rule out a similarity of `least`.

    Pairs leave a task as they are found; no list of an id's candidates is held.
    """

    def flush(held):
        pairs = np.unique(np.concatenate(held, axis=1), axis=1)
        for at in range(0, pairs.shape[1], 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0, at : at + 50_000]), pa.array(pairs[1, at : at + 50_000])], ["u", "v"])

    def compare(batches):
        held, n = [], 0
        for x, y, *_ in _meetings(batches, least, top=False):
            held.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            n += len(x)
            if n > HELD:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return _dealt_out(cells).mapInArrow(lean(compare), "u long, v long").distinct()


def _partners(cells: DataFrame) -> DataFrame:
    """(cell, key, id, root, codes, side, asks) -> id of each text that asks and has candidates of other roots, and of these candidates; a row an id and task."""

    def compare(batches):
        held, n = [], 0
        for x, y, *_ in _meetings(batches, top=False):
            held += [x, y]
            n += len(x)
            if n > HELD:
                held = [np.unique(np.concatenate(held))]
                n = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], ["id"])

    return _dealt_out(cells).mapInArrow(lean(compare), "id long").distinct()


def _dealt(rows: DataFrame, large: DataFrame, salt: int) -> DataFrame:
    """Cells of at most about CELL rows: larger buckets are dealt at random. This closes large groups; it need not find all links."""
    part = F.coalesce(F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col("n") / CELL)), F.lit(0))
    return rows.join(F.broadcast(large), "key", "left").select(F.xxhash64("key", part).alias("cell"), "key", "id", "root", "codes", F.lit(-1).alias("side"), F.lit(True).alias("asks"))


def _whole(rows: DataFrame, large: DataFrame, top: bool = True) -> DataFrame:
    """Cells in which the rows that may ask (column `may`) meet all rows of other roots of the bucket, but for those of the bucket's largest group if `top`.

    A bucket of up to CELL rows is one cell, whose task finds the largest group. In larger ones the parts of the rows that ask meet the parts of all rows.
    """
    rest = [c for c in ("size", "bits") if c in rows.columns]
    columns = [F.xxhash64("key", "a", "b").alias("cell"), "key", "id", "root", "codes", "side", "asks", *rest]
    zero = F.lit(0)
    one = rows.join(F.broadcast(large), "key", "left_anti").select("*", zero.alias("a"), zero.alias("b"), F.lit(-1).alias("side"), F.col("may").alias("asks")).select(*columns)
    if large.isEmpty():
        return one
    rows = rows.join(F.broadcast(large.select("key")), "key", "left_semi")
    groups = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.count_if("may").alias("m"))
    sizes = groups.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(F.struct("n", "root", "m")).alias("top"))
    sizes = sizes.withColumn("m", F.col("m") - F.col("top.m") if top else F.col("m")).where("m > 0")
    held = rows.join(sizes.select("key", F.ceil(F.col("n") / CELL).cast("int").alias("p"), F.ceil(F.col("m") / CELL).cast("int").alias("q"), F.col("top.root").alias("top")), "key")
    held = held.withColumn("asks", F.col("may") & (F.col("root") != F.col("top")) if top else F.col("may"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = held.select("*", F.explode(F.sequence(zero, F.col("q") - 1)).alias("b"), part("p").alias("a"), zero.alias("side"))
    minor = held.where("asks").select("*", part("q").alias("b"), F.explode(F.sequence(zero, F.col("p") - 1)).alias("a"), F.lit(1).alias("side"))
    return one.union(every.select(*columns)).union(minor.select(*columns))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose Jaccard similarity is `least` or more, from the whole sets of their shingles."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"of_{c}"))

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - common
                keep.append(common >= least * total - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "of_u", "of_v"), check, "u long, v long")


def groups(docs: DataFrame, *, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, root for each text that links with another one: nodes are hashes of texts, the root is one of the group's.

    Texts link at a Jaccard similarity of `least` (0.8 or more; the distance of fingerprints is set for that) of their sets of
    `width`-word shingles. SimHash fingerprints share a bucket if a chain of the pigeonring starts there with an equal segment; each
    text proposes partners of other groups (the nearest fingerprints, and the first in an order that changes), their real
    similarity decides, and links make groups. Large buckets are first dealt at random, so that a large group closes; then all
    pairs of different groups of each bucket are looked at, until a round brings no link. The real similarities that a round
    computes are linear in the texts in buckets. At the end texts that had more candidates in other groups than a round
    compares meet all of these, so that every pair of different groups that passes the filter has been tested; pairs whose
    bitmaps prove a lower similarity (an exact bound) leave no row.
    """
    source = docs.select(_id(text_col).alias("id"), F.col(text_col).alias("text"))
    bits, segments = shape(docs.count())
    prints = cut(_fingerprints(source, width, least, segments))
    sets = tried = None
    roots = docs.sparkSession.createDataFrame([], "node long, root long")

    def known(ids: DataFrame) -> DataFrame:
        """The sets of shingles, with those of `ids` among them."""
        nonlocal sets
        missing = ids if sets is None else cut(ids.join(sets, "id", "left_anti"))
        if sets is None:
            sets = cut(_sets(source, missing, width))
        elif not missing.isEmpty():
            sets = sets.union(cut(_sets(source, missing, width)))
        return sets

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that weren't tried before and are similar."""
        nonlocal tried
        new = pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti")
        tried = pairs if tried is None else tried.union(pairs)
        return cut(_similar(new, known(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()), least))

    def joined(more: DataFrame) -> DataFrame:
        return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

    for n in itertools.count():  # ends: each round but the last joins groups
        every = 1 if n else 4
        texts = prints.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"), F.lit(True).alias("may"), "print")
        large = _large(texts, bits, segments, every)
        rows = _rows(texts, bits, segments, every)
        found = cut(_propose(_whole(rows, large), n, NEAREST) if n else _propose(_dealt(rows, large, n), n, 1))
        pairs = found.select("u", "v")
        if n:  # whoever had no candidate in another group has none later
            prints = cut(prints.join(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi"))
        more = links(pairs)
        if not more.isEmpty():
            roots = joined(more)
        elif n:
            # groups are those of the proposals, so all that is left are candidates which texts had beyond their nearest ones
            left = cut(found.where("more_u").select(F.col("u").alias("off")).union(found.where("more_v").select("v")).distinct())
            if left.isEmpty():
                return roots
            texts = texts.drop("may").join(left, F.col("id") == F.col("off"), "left").withColumn("may", F.col("off").isNotNull()).drop("off")
            cells = lambda of: _whole(_rows(of, bits, segments), large, top=False)
            marked = _bitmaps(known(cut(_partners(cells(texts)))))
            more = links(cut(_all_pairs(cells(texts.join(marked, "id")), least)))
            return roots if more.isEmpty() else joined(more)


def _sets(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, hashes: the whole sets of shingles of the wanted texts, once a text."""

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t, width).astype("<u8").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "hashes"])

    return map_arrow(source.groupBy("id").agg(F.first("text").alias("text")).join(wanted, "id", "left_semi").select("id", F.col("text").cast("binary").alias("text")), rows, "id long, hashes binary")


def keep_one(docs: DataFrame, *, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest id (ids that are null come last; ties: the text whose hash is smaller).

    Null and empty texts are alike and group with each other. Repeated rows, the same id and text, stay once. Different texts
    stay both, whether or not their ids are equal. Empty table: no rows. Other columns have no part in it, whatever their names.
    """
    roots = groups(docs, width=width, least=least, id_col=id_col, text_col=text_col)
    # the columns are packed away, so that names of helpers can't clash with theirs
    row = unused(docs, "row")
    held = docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias(row), _id(text_col).alias("node_of"), F.col(_quoted(id_col)).alias("id_of"))
    nodes = held.select("node_of", "id_of").groupBy("node_of").agg(F.min(F.struct(F.col("id_of").isNull().alias("none"), F.col("id_of").alias("id"))).alias("least"))
    grouped = nodes.join(roots, F.col("node_of") == F.col("node"), "left").select("node_of", F.coalesce("root", "node_of").alias("root"), "least")
    winners = grouped.groupBy("root").agg(F.min(F.struct("least.none", "least.id", "node_of")).alias("w")).select(F.col("w.id").alias("id_won"), F.col("w.node_of").alias("node_won"))
    kept = held.join(winners, (F.col("node_of") == F.col("node_won")) & F.col("id_of").eqNullSafe(F.col("id_won")), "left_semi")
    return kept.dropDuplicates(["node_of", "id_of"]).select(*[F.col(row)[c].alias(c) for c in docs.columns])


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"
