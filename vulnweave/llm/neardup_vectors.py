"""Near-duplicate embeddings: NN-descent over a neighbour graph, an audit of its recall, exact link counts within components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Forest, cut, hot_keys, key_chunks, partitions, runs, salt_many, salt_one
from ._graph import connected_components
from .ann import matrices, usable

#: Neighbours a list holds at first (and as many more of other components when links fill it), reverse neighbours that join
#: it (and more, likewise), sorted orders it starts from, rows of a compared block.
NEIGHBOURS, REVERSE, ORDERS, BLOCK = 6, 6, 8, 128

#: Vectors that one part of a cell holds, whatever the size of a label or a component.
CELL = 2048

#: Rows of the audit, the recall that ends the refinement, and the rounds after which all pairs of a label are compared instead.
AUDIT_ROWS, AUDIT_RECALL, ROUNDS = 1024, 0.995, 6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stack(column) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, numbers of dimensions), with zeros behind the shorter ones: other dimensions never compare."""
    parts = matrices(column)
    n, width = sum(len(at) for at, _ in parts), max((x.shape[1] for _, x in parts), default=0)
    out, dims = np.zeros((n, width)), np.zeros(n, np.int64)
    for at, x in parts:
        out[at, : x.shape[1]] = _unit(x)
        dims[at] = x.shape[1]
    return out, dims


def _pairs(a: list, b: list, s: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in ((a, pa.int64()), (b, pa.int64()), (s, pa.float64()))], ["a", "b", "s"])


def _best(sim: np.ndarray, ids: np.ndarray, most: int, least: float, out: tuple[list, list, list]) -> None:
    """The NEIGHBOURS best neighbours of each row of a square of similarities: `most` of them, and all that link; -2 stands for no pair."""
    top = np.argsort(-sim, axis=1, kind="stable")[:, :NEIGHBOURS]
    value = np.take_along_axis(sim, top, axis=1)
    row, col = np.nonzero((value > -2) & ((value >= least) | (np.arange(top.shape[1]) < most)))
    out[0].append(ids[row]), out[1].append(ids[top[row, col]]), out[2].append(value[row, col])


def _groups(link: np.ndarray) -> np.ndarray:
    """Which rows of a square of links are connected."""
    at = link | np.eye(len(link), dtype=bool)
    while True:
        wider = at.astype(np.float32) @ at > 0
        if (wider == at).all():
            return at
        at = wider


def _start(reps: DataFrame, least: float) -> DataFrame:
    """The first neighbour lists: vectors in several orders by signs of random projections, compared within sliding blocks.

    Orders are cut by range over (order, label, signs, hash), so equal signs spread over tasks however many share them.
    """

    def signs(batches):
        for batch in batches:
            x, _ = _stack(batch.column("embedding"))
            for order in range(ORDERS):
                axes = np.random.default_rng((order, 17)).standard_normal((x.shape[1], 62))
                code = ((x @ axes > 0) * (1 << np.arange(62, dtype=np.int64))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), order, np.int32)), pa.array(code), *batch.columns], ["order", "code", *batch.schema.names])

    kind = reps.schema["embedding"].dataType.simpleString()
    coded = reps.select("rep", "label", "embedding").mapInArrow(signs, f"order int, code long, rep long, label long, embedding {kind}")
    by = ["order", "label", "code", F.xxhash64("rep", "order")]

    def compare(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= 8 * BLOCK:
                yield _slide(held)
                held = held.slice(held.num_rows - BLOCK)
        if held is not None and held.num_rows:
            yield _slide(held)

    def _slide(rows):
        out = [], [], []
        x, dims = _stack(rows.column("embedding"))
        ids, group = rows.column("rep").to_numpy(), np.stack([rows.column("order").to_numpy(), rows.column("label").to_numpy(), dims])
        for at in range(0, max(1, len(ids) - BLOCK // 2), BLOCK // 2):
            own = slice(at, at + BLOCK)
            sim = x[own] @ x[own].T
            sim[(group[:, own, None] != group[:, None, own]).any(axis=0)] = -2
            np.fill_diagonal(sim, -2)
            _best(sim, ids[own], 3, least, out)
            _best(np.where(_groups(sim >= least), -2, sim), ids[own], 2, 2, out)
        return _pairs(*out)

    return coded.repartitionByRange(partitions(reps), *by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long, s double")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, s with `out`: whether a and b are in different components."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").select("a", "b", "s", (F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).alias("out"))


def _lists(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, s, out: each a's NEIGHBOURS best b; a list that is full of links is enlarged by the NEIGHBOURS best of other components.

    So each list holds an entry below the bound, or one of another component with which it links.
    """
    spread = _rooted(pairs.groupBy("a", "b").agg(F.max("s").alias("s")), roots)
    best = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    apart = Window.partitionBy("a", "out").orderBy(F.desc("s"), "b")
    return spread.withColumn("r", F.row_number().over(best)).withColumn("q", F.row_number().over(apart)).where((F.col("r") <= NEIGHBOURS) | F.col("out") & (F.col("q") <= NEIGHBOURS)).select("a", "b", "s", "out")


def _refine(lists: DataFrame, reps: DataFrame, roots: DataFrame, link: float) -> DataFrame:
    """One round: neighbours and (the best) reverse neighbours of a vector meet each other there.

    A meeting gives each vector its best newcomer, its best one of another component, and all of these that link with it.
    """
    by = lambda *c: Window.partitionBy("pivot", *c).orderBy(F.desc("s"), "rep")
    back = lists.select(F.col("b").alias("pivot"), F.col("a").alias("rep"), "s", "out").withColumn("r", F.row_number().over(by())).withColumn("q", F.row_number().over(by("out"))).where((F.col("r") <= REVERSE) | F.col("out") & (F.col("q") <= REVERSE))
    worst = F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("s")).otherwise(-2.0)
    worst_out = F.when(F.count_if("out") >= NEIGHBOURS, F.min(F.when(F.col("out"), F.col("s")))).otherwise(-2.0)
    least = lists.groupBy("a").agg(worst.alias("least"), worst_out.alias("least_out"))
    members = lists.select(F.col("a").alias("pivot"), F.col("b").alias("rep")).union(back.select("pivot", "rep")).union(lists.select("a", "a")).distinct()
    rows = reps.join(least, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left").select("rep", "label", F.coalesce("root", "rep").alias("root"), F.coalesce("least", F.lit(-2.0)).alias("least"), F.coalesce("least_out", F.lit(-2.0)).alias("least_out"), "embedding")
    met = members.join(rows, "rep")

    def join(batches):
        for rows in key_chunks(batches, "pivot", 20_000):
            x, dims = _stack(rows.column("embedding"))
            pivot, ids, least_of, least_out, label, root = (rows.column(c).to_numpy() for c in ("pivot", "rep", "least", "least_out", "label", "root"))
            start, end = runs(pivot)
            found = [], [], []
            for size in np.unique(end - start):
                if size < 2:
                    continue
                for part in np.array_split(start[end - start == size], max(1, int((end - start == size).sum() * size // 20_000))):
                    at = part[:, None] + np.arange(size)
                    sim = np.einsum("gid,gjd->gij", x[at], x[at])
                    bad = (label[at][:, :, None] != label[at][:, None]) | (dims[at][:, :, None] != dims[at][:, None]) | np.eye(size, dtype=bool)[None]
                    near = root[at][:, :, None] == root[at][:, None]
                    out = np.where(bad | near | (sim <= least_out[at][:, :, None]), -2, sim)
                    sim[bad | (sim <= least_of[at][:, :, None])] = -2
                    best = (np.arange(size) == sim.argmax(axis=2)[:, :, None]) & (sim > -2) | (np.arange(size) == out.argmax(axis=2)[:, :, None]) & (out > -2)
                    value = np.maximum(sim, out)
                    g, i, j = np.nonzero(best | (value >= link) & ~near)
                    found[0].append(ids[at][g, i]), found[1].append(ids[at][g, j]), found[2].append(value[g, i, j])
            yield _pairs(*found)

    return met.repartition(partitions(reps), "pivot").sortWithinPartitions("pivot").mapInArrow(join, "a long, b long, s double")


def _audit(reps: DataFrame, roots: DataFrame, least: float) -> float:
    """Recall of links of AUDIT_ROWS vectors, each compared with all: the share whose ends are in one component."""
    sample = reps.select("rep", "label", "embedding").orderBy(F.xxhash64("rep", F.lit("audit"))).limit(AUDIT_ROWS).toArrow()
    if not sample.num_rows:
        return 1.0
    x, dims = _stack(sample.column("embedding"))
    ids, labels = sample.column("rep").to_numpy(), sample.column("label").to_numpy()

    def compare(batches):
        for batch in batches:
            y, own = _stack(batch.column("embedding"))
            width = min(x.shape[1], y.shape[1])
            sim = y[:, :width] @ x[:, :width].T
            ok = (sim >= least) & (batch.column("label").to_numpy()[:, None] == labels) & (own[:, None] == dims) & (batch.column("rep").to_numpy()[:, None] != ids)
            i, j = np.nonzero(ok)
            yield _pairs([batch.column("rep").to_numpy()[i]], [ids[j]], [sim[i, j]])

    links = reps.select("rep", "label", "embedding").mapInArrow(compare, "a long, b long, s double")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    seen = links.join(root("a"), "a", "left").join(root("b"), "b", "left").agg(F.count(F.lit(1)), F.count_if(F.col("root_a") == F.col("root_b"))).first()
    return seen[1] / seen[0] if seen[0] else 1.0


def _across(reps: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """u, v: links between components: all pairs of a label, in cells of two parts; tasks return forests of roots."""
    members = cut(reps.join(roots, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("root"), "label", "embedding"))
    parts = members.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    cells = members.join(F.broadcast(parts) if parts.count() <= 1024 else parts, "label").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select(F.xxhash64("label", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "part", "other", "root", "label", "embedding")

    def compare(batches):
        forest = Forest()
        for rows in key_chunks(batches, "cell", 4_000):
            x, dims = _stack(rows.column("embedding"))
            cell, side, other_side, root, label = (rows.column(c).to_numpy() for c in ("cell", "part", "other", "root", "label"))
            start, end = runs(cell)
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                for at in range(a, b, 512):
                    own = slice(at, min(b, at + 512))
                    ok = x[own] @ x[a:b].T >= least
                    ok &= (root[own, None] != root[None, a:b]) & (label[own, None] == label[None, a:b]) & (dims[own, None] == dims[None, a:b]) & (other_side[own, None] == side[None, a:b])
                    i, j = np.nonzero(ok)
                    for u, v in np.unique(np.stack([root[own][i], root[a:b][j]], axis=1), axis=0).tolist():
                        forest.join(u, v)
        u, v = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return cells.repartition(partitions(reps), "cell").sortWithinPartitions("cell").mapInArrow(compare, "u long, v long")


def _centres(members: DataFrame) -> DataFrame:
    """root, centre: the mean direction of each component. Tasks add up their own rows first, so a component gives a row a task."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, _ = _stack(batch.column("embedding"))
            roots, at = np.unique(batch.column("root").to_numpy(), return_inverse=True)
            total = np.zeros((len(roots), x.shape[1]))
            np.add.at(total, at, x)
            for r, t in zip(roots.tolist(), total, strict=True):
                sums[r] = sums[r] + t if r in sums else t
            if len(sums) > 20_000:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    def out(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["root", "part"])

    parts = members.select("root", "embedding").mapInArrow(add, "root long, part array<double>")
    added = parts.select("root", F.posexplode("part")).groupBy("root", "pos").agg(F.sum("col").alias("x"))
    return added.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centre"))


def _links(reps: DataFrame, roots: DataFrame, least: float, ways: int) -> DataFrame:
    """rep, others: how many vectors link with it, copies counted.

    Vectors within half the bound's angle of their component's centre link with each other whatever they are, so these are
    counted as one group. Pairs with at least one other vector are compared in cells of two parts.
    """
    members = cut(roots.join(reps, F.col("node") == F.col("rep")).select("root", "rep", "copies", "embedding"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(sizes, "root", "n")
    centre = _centres(members).withColumn("salt", F.explode(salt_one(hot, "root", ways)))
    placed = members.withColumn("salt", salt_many(hot, "root", F.col("rep"), ways)).join(centre, ["root", "salt"]).drop("salt")
    bound = float(np.cos(np.arccos(least) / 2 - 1e-7)) if least < 1 else 2.0

    def near(batches):
        for batch in batches:
            x, _ = _stack(batch.column("embedding"))
            c, _ = _stack(batch.column("centre")) if batch.num_rows else (x, None)
            width = min(x.shape[1], c.shape[1])
            core = (x[:, :width] * c[:, :width]).sum(axis=1) >= bound
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("root", "rep", "copies", "embedding")), pa.array(core)], ["root", "rep", "copies", "embedding", "core"])

    kind = reps.schema["embedding"].dataType.simpleString()
    placed = cut(placed.select("root", "rep", "copies", "embedding", "centre").mapInArrow(near, f"root long, rep long, copies long, embedding {kind}, core boolean"))
    sums = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("core")).alias("m"), F.coalesce(F.sum(F.when(F.col("core"), F.col("copies"))), F.lit(0)).alias("cores"))
    sums = sums.select("root", "cores", F.ceil(F.col("n") / CELL).cast("int").alias("p"), F.ceil(F.col("m") / CELL).cast("int").alias("q")).withColumn("salt", F.explode(salt_one(hot, "root", ways)))
    dealt = placed.withColumn("salt", salt_many(hot, "root", F.col("rep"), ways)).join(sums, ["root", "salt"]).drop("salt")
    core = dealt.where("core").select("rep", (F.col("cores") - F.col("copies")).alias("others"))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    several = dealt.where("q > 0")
    every = several.select("*", part("p").alias("a"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("b"), F.lit(0).alias("side"))
    edge = several.where("NOT core").select("*", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("a"), part("q").alias("b"), F.lit(1).alias("side"))
    cells = every.unionByName(edge).select(F.xxhash64("root", "a", "b").alias("cell"), "root", "side", "core", "rep", "copies", "embedding")

    def count(batches):
        for rows in key_chunks(batches, "cell", 4_000):
            x, _ = _stack(rows.column("embedding"))
            cell, root, side, ids, copies = (rows.column(c).to_numpy() for c in ("cell", "root", "side", "rep", "copies"))
            core = rows.column("core").to_numpy(zero_copy_only=False)
            start, end = runs(cell)
            others = np.zeros(len(ids), np.int64)
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                left, right = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
                for at in range(0, len(left), 1024):
                    own = left[at : at + 1024]
                    ok = (x[own] @ x[right].T >= least) & (root[own, None] == root[None, right]) & (ids[own, None] != ids[None, right])
                    others[right] += copies[own] @ ok
                    others[own] += np.where(core[own], ok @ copies[right], 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others)], ["rep", "others"])

    counted = cells.repartition(partitions(reps), "cell").sortWithinPartitions("cell").mapInArrow(count, "rep long, others long")
    return core.union(counted).groupBy("rep").agg(F.sum("others").alias("others"))


def _components(pairs: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """The components after the links among `pairs` have joined those of `roots`."""
    links = pairs.where(F.col("s") >= least).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links))


def near_duplicates(vectors: DataFrame, *, least: float = 0.98, ways: int = 32) -> DataFrame:
    """vec_id, n_links (other vectors with the same label and a cosine of `least` or more), component_id, kept of each row (vec_id, label, embedding).

    Exact copies are one vector with a count. Neighbour lists start from sorted orders and are refined by joins of
    neighbours' neighbours. A list that links fill is enlarged by neighbours of other components, so it never hides a link that
    would join two of them. Rounds go on until the audit (AUDIT_ROWS vectors against all) finds AUDIT_RECALL of the links within
    components; if ROUNDS rounds don't reach it, all pairs of a label are compared. Links of a component are then counted
    exactly: its core by its size, all other pairs in cells, and no pair is written down.

    Null labels, null, zero or non-finite vectors, null components: no links, component_id is the own vec_id, kept. Null
    vec_id: such vectors take no part either (kept is true). Repeated rows (same id, too): each counts as a vector of its
    own, with one result each. Ties: none matter. Empty table: no rows. Other columns are ignored.
    """
    fine = F.coalesce(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").withColumn("fine", fine)
    rows = source.where("fine").select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("mark"))
    reps = cut(rows.groupBy("mark", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("first", F.col("rep")))
    # ids that repeat with other vectors would be one node: such vectors are told apart by a node number of their own
    nodes = cut(reps.withColumn("rep", F.when(F.count(F.lit(1)).over(Window.partitionBy("first")) > 1, F.xxhash64("mark", "first")).otherwise(F.col("first"))))
    none = nodes.sparkSession.createDataFrame([], "node long, root long")
    lists = cut(_lists(_start(nodes, least), none))
    roots = _components(lists, none, least)
    for n in range(ROUNDS):
        found = cut(_refine(lists, nodes, roots, least))
        roots = _components(found, roots, least)
        if _audit(nodes, roots, least) >= AUDIT_RECALL and n:
            break
        lists = cut(_lists(lists.drop("out").union(found), roots))
    else:
        roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_across(nodes, roots, least)))
    counted = _links(nodes, roots, least, ways)
    known = nodes.join(roots, F.col("rep") == F.col("node"), "left").join(counted, "rep", "left").select("mark", "label", "embedding", "copies", "first", F.coalesce("root", "rep").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    hot = hot_keys(known.groupBy("mark").agg(F.sum("copies").alias("n")), "mark", "n")
    sized = known.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    hot_roots = hot_keys(sized, "root", "n")
    known = known.withColumn("salt", salt_many(hot_roots, "root", F.col("mark"), ways)).join(smallest.withColumn("salt", F.explode(salt_one(hot_roots, "root", ways))), ["root", "salt"]).drop("salt")
    right = known.select("mark", F.col("label").alias("label_of"), F.col("embedding").alias("embedding_of"), "n_links", "component_id").withColumn("salt", F.explode(salt_one(hot, "mark", ways)))
    left = rows.withColumn("salt", salt_many(hot, "mark", F.col("vec_id"), ways))
    linked = left.join(right, ["mark", "salt"]).where((F.col("label") == F.col("label_of")) & (F.col("embedding") == F.col("embedding_of"))).select("vec_id", "n_links", "component_id")
    rest = source.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
