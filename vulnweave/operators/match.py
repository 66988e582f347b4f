"""Fuzzy joins: candidates against a white list, labels against coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import SIMILARITIES, similarity_words, weighted_similarity
from .nearest import WORDS, nearest
from .relational import cut, interleave, pad, top_k, triple


def _length_band(length: Column, least: float, kind: str) -> tuple[Column, Column]:
    """The lengths that a partner may have: 1 - d/max >= t needs min/max >= t; 2L/(m+n) >= t needs min/max >= t/(2-t)."""
    t = least if kind == "lev" else least / (2 - least)
    return F.ceil(length * t - 1e-9).cast("int"), F.floor(length / t + 1e-9).cast("int")


def grams(text: Column, size: int) -> Column:
    """All runs of `size` characters, overlapping ones too, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


#: Letters by their frequency in names and prose, the commonest first; what isn't among them counts as rarer.
_COMMON = "etaoinsrlhdcumpgfbywvkxjqz"


def _rarest(text: Column, n: Column) -> Column:
    """The n characters of a text that are rare in general, repeats counted before they are dropped."""
    ranked = F.array_sort(F.transform(grams(text, 1), lambda c: F.struct(F.when(F.instr(F.lit(_COMMON), c) == 0, -99).otherwise(-F.instr(F.lit(_COMMON), c)).alias("r"), c.alias("c"))))
    return F.array_distinct(F.transform(F.slice(ranked, F.lit(1), n), lambda x: x["c"]))


def _keys_asked(name: Column, kind: str, least: float) -> Column:
    """Grams of a name, one of which every partner within the threshold holds.

    Edits: at most D = (1 - t) m / t of them fit, so of D + 1 pieces of the name one stays whole; where pieces get too short,
    at most (1 - t) m characters are lost, so of one more character than that one stays. Substrings: a common one has at least
    m t / (2 - t) characters, and so holds a gram that begins at each such distance.
    """
    m = F.length(name)
    if kind == "lcs":
        shortest = F.greatest(F.lit(1), F.ceil(m * (least / (2 - least)) - 1e-9).cast("int"))
        size = F.least(F.lit(3), shortest)
        return F.when(m == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), m - size, shortest - size + 1), lambda p: F.substring(name, p + 1, size))))
    edits = F.floor(m * ((1 - least) / least) + 1e-9).cast("int")
    piece = F.floor(m / (edits + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), edits), lambda k: F.substring(name, F.floor(k * m / (edits + 1)).cast("int") + 1, F.least(F.lit(3), piece)))
    return F.when(m == 0, F.array(F.lit(""))).when(piece >= 2, F.array_distinct(pieces)).otherwise(_rarest(name, F.floor(m * (1 - least) + 1e-9).cast("int") + 1))


def _keys_held(entry: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    return F.when(F.length(entry) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(*(grams(entry, n) for n in sizes))))


def fuzzy_pairs(names: DataFrame, white_list: DataFrame, kind: str, least: float) -> DataFrame:
    """(name) x (pos, entry) -> name, pos, entry, sim: all pairs of distinct names with a similarity of `least` or more.

    No cross product: string measures join on a gram that partners have to share together with the partner's length, which has
    to lie within a band; word measures join on a shared word. Both lose no pair for least > 0.
    """
    if least <= 0:
        raise ValueError("a fuzzy join needs a threshold above 0")
    sim = SIMILARITIES[kind]
    a, b = names.select("name").where(F.col("name").isNotNull()).distinct(), white_list.where(F.col("entry").isNotNull())
    if kind in ("lev", "lcs"):
        low, high = _length_band(F.length("name"), least, kind)
        left = a.select("name", F.explode(_keys_asked(F.col("name"), kind, least)).alias("gram"), F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0))).alias("band")).select("name", "gram", F.explode("band").alias("n"))
        right = b.select("pos", "entry", F.length("entry").alias("n"), F.explode(_keys_held(F.col("entry"))).alias("gram"))
        met = left.join(right, ["gram", "n"]).select("name", "pos", "entry").distinct()
    else:
        words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))))
        met = a.withColumn("w", words("name")).join(b.withColumn("w", words("entry")), "w").drop("w").distinct()
    return met.withColumn("sim", F.round(sim(F.col("name"), F.col("entry")), 9)).where(F.col("sim") >= least)


def white_list_match(candidates: DataFrame, white_list: DataFrame, kind: str, least: float) -> DataFrame:
    """(id, place, name) x (pos, entry) -> id, triple: the best entries of the first two candidates, interleaved.

    Each candidate keeps its three best entries, ties in the white list's order. Candidates are made once, as their names go to all tasks.
    """
    if least <= 0:
        raise ValueError("a fuzzy join needs a threshold above 0")
    candidates = cut(candidates)
    asked = candidates.where((F.col("place") <= 2) & F.col("name").isNotNull())
    value = lambda c: similarity_words(F.col(c), kind) if kind in WORDS else F.col(c)
    best = nearest(asked.select("name", value("name").alias("value")).dropDuplicates(["name"]), white_list.select(F.col("pos").alias("place"), "entry", value("entry").alias("value")), kind, least, 3)
    lists = best.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]).alias("entries"))
    found = asked.join(lists, "name", "left").groupBy("id").agg(*(F.max(F.when(F.col("place") == i, F.col("entries"))).alias(f"e{i}") for i in (1, 2)))
    none = F.array().cast("array<string>")
    hits = found.select("id", interleave(F.coalesce("e1", none), F.coalesce("e2", none)).alias("triple"))
    return candidates.select("id").distinct().join(hits, "id", "left").select("id", F.coalesce("triple", F.lit(";;")).alias("triple"))


def _tail(name: Column, parts: int) -> Column:
    pieces = F.split(name, ":")
    return F.array_join(F.slice(pieces, -F.least(F.size(pieces), F.lit(parts)), F.least(F.size(pieces), F.lit(parts))), ":")


def label_match(labels: DataFrame, libraries: DataFrame, least: float) -> DataFrame:
    """(id, label) x (name) -> id, triple: a coordinate that the libraries hold stands as it is; else the closest ones.

    If an artifact of that name exists, its groups are ranked by weighted edit similarity; else the three closest artifacts
    are, then their groups; an artifact without a close group gives its first coordinate. Null or empty labels: no match.
    """
    labels = cut(labels)
    names = libraries.select("name").where(F.col("name").isNotNull()).distinct()
    coords = names.select(_tail(F.col("name"), 2).alias("coord")).distinct()
    coords = coords.select("coord", F.element_at(F.split("coord", ":"), -1).alias("artifact"), F.get(F.split("coord", ":"), F.size(F.split("coord", ":")) - 2).alias("group"))
    asked = labels.where(F.coalesce(F.col("label"), F.lit("")) != "").select("id", "label", F.element_at(F.split("label", ":"), -1).alias("want"), F.coalesce(F.get(F.split("label", ":"), F.size(F.split("label", ":")) - 2), F.lit("")).alias("want_group"))
    held = cut(asked.join(names, F.col("label") == F.col("name"), "left").select("id", "label", "want", "want_group", F.col("name").isNotNull().alias("held")))
    exact = held.where("held").select("id", F.lit(0).alias("a_rank"), F.lit(1).alias("rank"), F.col("label").alias("coord"))
    open_ = held.where("NOT held").drop("held")
    if open_.isEmpty():
        return _listed(labels, exact)
    artifacts = cut(coords.select("artifact").distinct())
    same = open_.join(artifacts, F.col("want") == F.col("artifact")).withColumn("a_rank", F.lit(1))
    others = open_.join(artifacts, F.col("want") == F.col("artifact"), "left_anti")
    close_to = nearest(others.select(F.col("want").alias("name"), F.col("want").alias("value")).distinct(), artifacts.select(F.col("artifact").alias("place"), F.col("artifact").alias("entry"), F.col("artifact").alias("value")), "weighted", least, 3, last_place=True)
    near = others.join(close_to.select(F.col("name").alias("want"), F.col("rank").alias("a_rank"), F.col("entry").alias("artifact")), "want")
    chosen = same.select("id", "want_group", "artifact", "a_rank").unionByName(near.select("id", "want_group", "artifact", "a_rank"))
    met = chosen.join(coords, "artifact").withColumn("sim", F.round(weighted_similarity(F.col("want_group"), F.col("group")), 9))
    close = top_k(met.where(F.col("sim") >= least), ["id", "a_rank"], [F.desc("sim"), F.desc("coord")], 3)
    far = met.join(near.select("id", "a_rank"), ["id", "a_rank"], "left_semi").groupBy("id", "a_rank").agg(F.min("coord").alias("coord")).join(close.select("id", "a_rank").distinct(), ["id", "a_rank"], "left_anti").withColumn("rank", F.lit(1))
    found = exact.unionByName(close.select("id", "a_rank", "rank", "coord")).unionByName(far.select("id", "a_rank", "rank", "coord"))
    return _listed(labels, found)


def _listed(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(id, a_rank, rank, coord) -> id, triple for each label."""
    listed = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("a_rank", "rank", "coord"))), lambda x: x["coord"]).alias("coords"))
    return labels.select("id").join(listed, "id", "left").select("id", triple(F.array_distinct(F.coalesce("coords", F.array().cast("array<string>")))).alias("triple"))


def rerank(scored: DataFrame, least: float, *, on_raw: bool = False) -> DataFrame:
    """(id, place, name, score) -> id, triple: scores are min-max normalised, those of `least` or more stay, the three best are listed.

    on_raw: the threshold holds for the raw score.
    """
    from .relational import min_max

    ranked = scored.withColumn("normal", min_max(F.col("score"), ["id"]))
    kept = ranked.where((F.col("score") if on_raw else F.round(F.coalesce("normal", F.lit(0.0)), 9)) >= least)
    best = top_k(kept, ["id"], [F.desc("score"), F.col("place")], 3)
    lists = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))
    return scored.select("id").distinct().join(lists, "id", "left").select("id", F.array_join(pad(F.coalesce("names", F.array().cast("array<string>")), 3), ";").alias("triple"))
