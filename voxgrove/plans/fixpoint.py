"""Driver loops over DataFrames: distances by tiles, pointer doubling, components.

A tile is a cube of voxels. What happens within one is settled by one task, with a priority
queue or a union-find; rounds only exchange what crosses tile borders, so their number is that of
tiles crossed, not of steps. One job writes each round; the driver sees counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.queue import IndexedQueue
from .scratch import drop, written

#: Rows of border values that a round broadcasts to the tiles at most (48 bytes each).
BROADCAST_ROWS = 1_000_000
TILE = "image_id string, tile long, nodes binary, heads binary, ends binary, costs binary, out binary, to binary"


def tiled(edges: DataFrame) -> DataFrame:
    """``edges`` with ``ts`` and ``td``, the tiles of both ends; by ranges of idx where they are not given."""
    if "td" in edges.columns:
        return edges
    of = lambda c: F.floor(F.col(c) / 32768).alias("t" + c[0])
    return edges.select("*", of("src"), of("dst"))


def _tiles(edges: DataFrame, name: str) -> DataFrame:
    """One row for each tile: its nodes and those before its border, the edges to its own nodes by
    their source, and which of its nodes which other tiles wait for."""
    inner = edges.select("image_id", F.col("td").alias("tile"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").cast("long").alias("w"), F.lit(True).alias("edge"))
    outer = edges.where("ts <> td").select("image_id", F.col("ts").alias("tile"), F.col("src").alias("a"), F.col("td").alias("b"), F.lit(0).cast("long").alias("w"), F.lit(False).alias("edge")).distinct()
    rows = inner.unionByName(outer).repartition("image_id", "tile").sortWithinPartitions("image_id", "tile")

    def run(batches):
        for (image, tile), t in grouped(batches, 2):
            a, b, w, edge = (t.column(i).to_numpy() for i in range(2, 6))
            out = ~edge
            nodes, place = np.unique(np.r_[a[edge], b[edge], a[out]], return_inverse=True)
            n = int(edge.sum())
            order = np.argsort(place[:n], kind="stable")
            heads = np.searchsorted(place[:n][order], np.arange(len(nodes) + 1))
            parts = [nodes, heads, place[n : 2 * n][order], w[edge][order], place[2 * n :], b[out]]
            yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([tile]), *(pa.array([np.ascontiguousarray(p, np.int64).tobytes()], pa.binary()) for p in parts)], [c.split()[0] for c in TILE.split(", ")])

    return written(rows.mapInArrow(run, TILE), name)


def grouped(batches, keys: int):
    """(key, table) of rows that come sorted by their first columns."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i) for i in range(keys)]
        ends = np.zeros(b.num_rows, bool)
        for c in cols:
            d = c.dictionary_encode().indices.to_numpy()
            ends[1:] |= np.diff(d) != 0
        cuts = [0, *np.flatnonzero(ends).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            key = tuple(c[i].as_py() for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _settle(row, idx, dist, label):
    """Least (distance, label) of a tile's nodes from what is known of some."""
    nodes, heads, ends, costs = (np.frombuffer(row[i], np.int64) for i in range(2, 6))
    at = np.searchsorted(nodes, idx)
    queue: IndexedQueue = IndexedQueue()
    best: dict[int, tuple[int, int]] = {}
    for i, d, s in zip(at.tolist(), dist, label, strict=True):
        if i not in best or (d, s) < best[i]:
            best[i] = d, s
            queue.put(i, (d, s))
    heads, ends, costs = heads.tolist(), ends.tolist(), costs.tolist()
    while (top := queue.take()) is not None:
        (d, s), i = top
        for e in range(heads[i], heads[i + 1]):
            j, key = ends[e], (d + costs[e], s)
            if j not in best or key < best[j]:
                best[j] = key
                queue.put(j, key)
    return nodes, best


def relax(edges: DataFrame, start: DataFrame, name: str, rounds: int = 10_000) -> DataFrame:
    """(image_id, idx, dist, label): least (dist, label) of every reachable node. ``start``: (image_id, idx,
    dist, label); ``edges``: (image_id, src, dst, w) with w >= 0, and the tiles ``ts``, ``td`` if
    known.

    Each round settles the tiles that were told of a smaller value at their border, from all that
    they were told so far, and tells their neighbours. An error is raised if ``rounds`` run out.
    """
    edges = tiled(edges)
    tiles = _tiles(edges, f"{name}-tiles")
    own = edges.select("image_id", F.col("src").alias("idx"), F.col("ts").alias("tile")).unionByName(edges.select("image_id", F.col("dst").alias("idx"), F.col("td").alias("tile")))
    own = own.groupBy("image_id", "idx").agg(F.min("tile").alias("tile"))
    start = written(start.groupBy("image_id", "idx").agg(F.min(F.struct("dist", "label")).alias("v")).join(own, ["image_id", "idx"], "left").select("image_id", "tile", "idx", F.col("v.dist").cast("long").alias("dist"), F.col("v.label").cast("long").alias("label"), F.lit(True).alias("fresh")), f"{name}-start")
    told = start.where("tile IS NOT NULL")
    key, value = ["image_id", "tile", "idx"], F.struct("dist", "label")

    def work(rows: DataFrame, n: int) -> DataFrame:
        """The tiles with what was told to them."""
        by_tile = rows.groupBy("image_id", "tile").agg(F.collect_list("idx").alias("idx"), F.collect_list("dist").alias("dist"), F.collect_list("label").alias("label"))
        return tiles.join(F.broadcast(by_tile) if n <= BROADCAST_ROWS else by_tile, ["image_id", "tile"])

    def tell(batches):
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                nodes, best = _settle(row, *row[8:11])
                out, to = np.frombuffer(row[6], np.int64), np.frombuffer(row[7], np.int64)
                some = [k for k, i in enumerate(out.tolist()) if i in best]
                got = [best[int(out[k])] for k in some]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]] * len(some), pa.string()), pa.array(to[some]), pa.array(nodes[out[some]]), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], [*key, "dist", "label"])

    def final(batches):
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                nodes, best = _settle(row, *row[8:11])
                own = sorted(set(np.frombuffer(row[4], np.int64).tolist()) | set(np.frombuffer(row[6], np.int64).tolist()) | set(np.searchsorted(nodes, row[11]).tolist()))
                own = [i for i in own if i in best]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]] * len(own), pa.string()), pa.array(nodes[own]), pa.array([best[i][0] for i in own], pa.int64()), pa.array([best[i][1] for i in own], pa.int64())], ["image_id", "idx", "dist", "label"])

    for turn in range(rounds + 1):
        many, n = told.agg(F.count("*"), F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0))).head()
        if not n:
            break
        if turn == rounds:
            raise RuntimeError(f"{name} is not settled after {rounds} rounds")
        active = told.where("fresh").select("image_id", "tile").distinct()
        rows = told.join(F.broadcast(active) if n <= BROADCAST_ROWS else active, ["image_id", "tile"], "left_semi")
        news = work(rows, many).mapInArrow(tell, "image_id string, tile long, idx long, dist long, label long")
        both = told.select(*key, value.alias("old"), F.lit(None).cast("struct<dist:bigint,label:bigint>").alias("new")).unionByName(news.select(*key, F.lit(None).cast("struct<dist:bigint,label:bigint>").alias("old"), value.alias("new")))
        least = both.groupBy(*key).agg(F.min("old").alias("old"), F.min("new").alias("new"))
        better = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))
        v = F.when(better, F.col("new")).otherwise(F.col("old"))
        after = written(least.select(*key, v["dist"].alias("dist"), v["label"].alias("label"), better.alias("fresh")), f"{name}-told")
        if turn:
            drop(told)
        told = after
    mine = start.where("tile IS NOT NULL").groupBy("image_id", "tile").agg(F.collect_list("idx").alias("begins"))
    every = work(told, many).join(mine, ["image_id", "tile"], "left").withColumn("begins", F.coalesce("begins", F.array().cast("array<long>")))
    inside = every.mapInArrow(final, "image_id string, idx long, dist long, label long")
    alone = start.where("tile IS NULL").select("image_id", "idx", "dist", "label")
    return inside.unionByName(alone)


def double(nodes: DataFrame, name: str, gather: dict[str, str] | None = None) -> DataFrame:
    """Pointer doubling over (image_id, idx, up, ...): ``up`` is null at an end. Returns ``top``, the
    last node reached, and for each column of ``gather`` its "sum" or "min" along the way."""
    gather = gather or {}
    state = written(nodes.select("image_id", "idx", "up", F.coalesce("up", "idx").alias("top"), *gather), name)
    while not state.where("up IS NOT NULL").isEmpty():
        far = state.select("image_id", F.col("idx").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), *(F.col(c).alias(f"{c}2") for c in gather))
        joined = state.join(far, ["image_id", "up"], "left")
        here = F.col("up").isNotNull()
        cols = [F.when(here & F.col(f"{c}2").isNotNull(), F.col(c) + F.col(f"{c}2") if how == "sum" else F.least(c, f"{c}2")).otherwise(F.col(c)).alias(c) for c, how in gather.items()]
        new = written(joined.select("image_id", "idx", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), *cols), name)
        drop(state)
        state = new
    return state.drop("up")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node joined with each) of the links of one tile."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # hook the greater root onto the least one beside it, then flatten
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def stars(pairs: DataFrame, name: str, rounds: int = 200) -> DataFrame:
    """(image_id, idx, comp) of every end of ``pairs`` (image_id, a, b): the least node reachable. Rounds
    of large and small stars, over links that get fewer; an error is raised if they run out."""
    e = written(pairs.where("a <> b").select("image_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    sums = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("image_id", "a", "b").cast("decimal(38,0)"))).head())
    old = sums(e)
    for turn in range(rounds + 1):
        if not old[0]:
            break
        if turn == rounds:
            raise RuntimeError(f"components of {name} are not complete after {rounds} rounds")
        both = e.unionByName(e.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("image_id", "a").agg(F.min("b").alias("m")).select("image_id", "a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, ["image_id", "a"]).where("b <> m").select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, name)
        low = large.groupBy("image_id", "a").agg(F.min("b").alias("m"))
        small = large.join(low, ["image_id", "a"]).where("b <> m").select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("image_id", "a", F.col("m").alias("b")))
        new = written(small.distinct(), name)
        drop(e)
        drop(large)
        e, now = new, sums(new)
        if now == old:
            break
        old = now
    roots = e.select("image_id", F.col("b").alias("idx")).distinct()
    return e.select("image_id", F.col("a").alias("idx"), F.col("b").alias("comp")).unionByName(roots.select("image_id", "idx", F.col("idx").alias("comp")))


def components(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(image_id, idx, comp): the least node reachable over undirected ``edges`` (src, dst). Links within
    a tile are contracted by one task; stars join what is left, a graph of tile-local roots."""
    edges = tiled(edges).select("image_id", "src", "dst", "ts", "td")
    within = edges.where("ts = td").select("image_id", F.col("td").alias("tile"), "src", "dst").repartition("image_id", "tile").sortWithinPartitions("image_id", "tile")

    def run(batches):
        for (image, _), t in grouped(batches, 2):
            idx, root = _roots(t.column(2).to_numpy(), t.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([image] * len(idx), pa.string()), pa.array(idx), pa.array(root)], ["image_id", "idx", "root"])

    local = written(within.mapInArrow(run, "image_id string, idx long, root long"), f"{name}-local")
    one, two = (local.select("image_id", F.col("idx").alias(c), F.col("root").alias(r)) for c, r in (("src", "ra"), ("dst", "rb")))
    across = edges.where("ts <> td").join(one, ["image_id", "src"], "left").join(two, ["image_id", "dst"], "left")
    pairs = across.select("image_id", F.coalesce("ra", "src").alias("a"), F.coalesce("rb", "dst").alias("b"))
    top = stars(pairs, f"{name}-stars")
    known = nodes.select("image_id", "idx").join(local, ["image_id", "idx"], "left").select("image_id", "idx", F.coalesce("root", "idx").alias("root"))
    out = known.join(top.select("image_id", F.col("idx").alias("root"), "comp"), ["image_id", "root"], "left").select("image_id", "idx", F.coalesce("comp", "root").alias("comp"))
    return written(out, name)
