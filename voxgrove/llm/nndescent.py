"""Embedding near-duplicates by NN-descent on DataFrames.

Equal vectors are one class with a count. Random hyperplanes deal the classes into small leaves,
in which each keeps its ``k`` nearest as a first neighbour list. Each round joins every list
and its reverse with the vectors, compares the neighbours of one vector with each other, and
merges what is found into their lists; only vectors with a new neighbour take part. Rounds end
when few entries change. A twentieth of the vectors, or more until their links are many enough
to tell, is then compared with all, in blocks, and while their links are found too seldom, further
hyperplanes and rounds follow. Where these would cost as much as an exact comparison of all, and
where the audit had to take all vectors, that comparison takes their place.

Links are list entries of cosine >= ``threshold`` in double precision. A list all of whose entries
are links is saturated, and so may lack some: its vector is compared with all others in blocks,
of which the pairs of components that a link joins are kept. All vectors of a component
of three or more are then compared in pairs of blocks, of which only counts are kept.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths. Repeated rows are copies and link. A null vec_id has a row of its
own without links. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, partitions, release, saved, spread

#: Neighbours kept, tables of hyperplanes, rows of a leaf, rounds, share of changes that ends them.
K, TABLES, LEAF, ROUNDS, CHANGE = 12, 10, 96, 4, 0.02
#: Vectors of the audit at least, one of how many, links it has at least, link recall it asks for,
#: tables added when it finds less.
AUDIT, PART, SEEN, RECALL, MORE = 200, 20, 200, 0.98, 8
#: Rows of a block of the exact comparison, and members of one local join.
BLOCK, JOIN = 2048, 96
#: Vectors of a component that are counted in one task against as many others.
PIECE = 512
#: Rows of the other side where some vectors are compared with all.
WIDE = 8192
LISTS = "id long, nbr array<long>, sim array<double>, fresh boolean"


def classes_of(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, n, vec): distinct usable vectors with their smallest id, count and float32 bytes."""
    v = F.col(embedding).cast("array<float>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(fine & F.col("id").isNotNull())
    grouped = rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "v")

    def run(batches):
        for b in batches:
            raw = [np.array(x, "<f4").tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["id", "n", "vec"])

    return map_batches(grouped, run, "id long, n long, vec binary")


def _groups(batches, most: int, columns: int):
    """Rows of one key after another from sorted batches, ``most`` at a time."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(columns)), strict=True):
            if r[0] != key or len(rows) >= most:
                if rows:
                    yield key, rows
                key, rows = r[0], []
            rows.append(r)
    if rows:
        yield key, rows


def by_length(rows: list[tuple]) -> list[list[tuple]]:
    """Rows (key, id, vector) by the length of their vector, two at least: keys are hashes."""
    out: dict[int, list[tuple]] = {}
    for r in rows:
        out.setdefault(len(r[2]), []).append(r)
    return [x for x in out.values() if len(x) > 1]


def _nearest(ids: np.ndarray, x: np.ndarray, k: int):
    """For each row the k nearest others: (ids, neighbours, cosines)."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-s, axis=1)[:, :k]
    return ids, ids[top], np.take_along_axis(s, top, 1)


def _lists(out, limit: int = 1 << 15):
    """Batches of (id, nbr, sim, fresh) from such results."""
    held, rows = [], 0

    def batch():
        ids = np.concatenate([i for i, _, _ in held])
        at = np.r_[0, np.cumsum(np.concatenate([np.full(len(i), n.shape[1]) for i, n, _ in held]))]
        nbr, sim = np.concatenate([n.ravel() for _, n, _ in held]), np.concatenate([s.ravel() for _, _, s in held])
        at = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(at, pa.array(nbr)), pa.ListArray.from_arrays(at, pa.array(sim)), pa.array(np.ones(len(ids), bool))], ["id", "nbr", "sim", "fresh"])

    for x in out:
        held.append(x)
        rows += len(x[0])
        if rows >= limit:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()


def bits_of(n: int) -> int:
    return max(0, math.ceil(math.log2(max(n, 1) / LEAF)))


def table_count(n: int, threshold: float) -> int:
    """Tables in which all but 1 - RECALL of the pairs at the threshold share a leaf at least once."""
    one = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits_of(n)
    return TABLES if one == 1 else max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - one)))


def leaves(vectors: DataFrame, n: int, first: int, tables: int, k: int) -> DataFrame:
    """Neighbour lists from leaves of hyperplane signs. A leaf with too many rows is split by
    further signs; what is still too large is taken in chunks."""
    bits = bits_of(n)

    def deal(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raw = b.column(1).to_pylist()
            for size in {len(r) for r in raw}:
                at = np.array([i for i, r in enumerate(raw) if len(r) == size])
                x = np.frombuffer(b"".join(raw[i] for i in at), "<f4").reshape(len(at), -1).astype(np.float64)
                ids, vec = b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))
                for t in range(first, first + tables):
                    p = planes.get((t, size))
                    if p is None:
                        p = planes[t, size] = np.random.RandomState(1 + t).standard_normal((x.shape[1], bits + 12))
                    sign = (x @ p > 0).astype(np.int64)
                    code = sign[:, :bits] @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    more = sign[:, bits:] @ (1 << np.arange(12, dtype=np.int64))
                    # table and size whole, then signs: keys of different sizes stay apart
                    key = spread(spread(np.full(len(x), t << 32 | size, np.uint64)) + code.astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(more), ids, vec], ["key", "more", "id", "vec"])

    def near(batches):
        def found():
            for _, both in _groups(batches, 4 * LEAF, 3):
                for rows in by_length(both):
                    raw = b"".join(r[2] for r in rows)
                    x = np.frombuffer(raw, "<f4").reshape(len(rows), -1).astype(np.float64)
                    yield _nearest(np.array([r[1] for r in rows]), x / np.sqrt((x * x).sum(1, keepdims=True)), k)

        yield from _lists(found())

    dealt = saved(map_batches(vectors.select("id", "vec"), deal, "key long, more long, id long, vec binary"), "nn-leaves")
    large = dealt.groupBy("key").count().where(F.col("count") > 3 * LEAF).select("key", F.ceil(F.col("count") / LEAF).alias("s"))
    keyed = dealt.join(large, "key", "left").select(F.when(F.col("s").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.col("more") % F.col("s"))).alias("key"), "id", "vec")
    out = keyed.repartition(partitions(vectors.sparkSession), "key").sortWithinPartitions("key", "id").mapInArrow(near, LISTS)
    return out


def merge(lists: DataFrame, k: int) -> DataFrame:
    """One list for each id: the k nearest of all its entries; ``fresh`` if one is new."""

    def chunk(ids, sizes, nbr, sim, fresh):
        owner, new = np.repeat(ids, sizes), np.repeat(fresh, sizes)
        o = np.lexsort((new, nbr, owner))  # an old entry comes before its new copies
        owner, nbr, sim, new = owner[o], nbr[o], sim[o], new[o]
        one = np.r_[True, (np.diff(owner) != 0) | (np.diff(nbr) != 0)]
        owner, nbr, sim, new = owner[one], nbr[one], sim[one], new[one]
        o = np.lexsort((nbr, -sim, owner))
        owner, nbr, sim, new = owner[o], nbr[o], sim[o], new[o]
        start = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
        rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
        top = rank < k
        owner, nbr, sim, new = owner[top], nbr[top], sim[top], new[top]
        start = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
        at = pa.array(np.r_[start, len(owner)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(owner[start]), pa.ListArray.from_arrays(at, pa.array(nbr)), pa.ListArray.from_arrays(at, pa.array(sim)), pa.array(np.logical_or.reduceat(new, start))], ["id", "nbr", "sim", "fresh"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += len(b.column(1).flatten())
            if size > 400_000:
                t = pa.Table.from_batches(held).combine_chunks()
                ids = t["id"].to_numpy()
                cut = int(np.searchsorted(ids, ids[-1]))  # the last id may go on
                if cut:
                    yield from packed(t.slice(0, cut))
                    held, size = t.slice(cut).to_batches(), 0
        if held:
            yield from packed(pa.Table.from_batches(held).combine_chunks())

    def packed(t):
        nbr, sim = t["nbr"].combine_chunks(), t["sim"].combine_chunks()
        sizes = nbr.value_lengths().to_numpy(zero_copy_only=False)
        yield chunk(t["id"].to_numpy(), sizes, nbr.flatten().to_numpy(), sim.flatten().to_numpy(), t["fresh"].to_numpy().astype(bool))

    return lists.repartition(partitions(lists.sparkSession), "id").sortWithinPartitions("id").mapInArrow(run, LISTS)


def join_neighbours(lists: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Compare the neighbours, forward and reverse, of each vector that has a new one."""

    def near(batches):
        def found():
            for _, both in _groups(batches, JOIN, 3):
                for rows in by_length(both):
                    x = np.frombuffer(b"".join(r[2] for r in rows), "<f4").reshape(len(rows), -1).astype(np.float64)
                    yield _nearest(np.array([r[1] for r in rows]), x / np.sqrt((x * x).sum(1, keepdims=True)), k)

        yield from _lists(found())

    edges = lists.where("fresh").select(F.col("id").alias("u"), F.explode("nbr").alias("v"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    many = both.groupBy("u").count().where(F.col("count") > JOIN).select("u", F.ceil(F.col("count") / (JOIN // 2)).alias("s"))
    # the many reverse neighbours of a hub meet in several joins
    dealt = both.join(many, "u", "left").select(F.when(F.col("s").isNull(), F.col("u")).otherwise(F.xxhash64("u", F.pmod(F.xxhash64("v"), "s"))).alias("u"), "v")
    full = dealt.join(vectors.select(F.col("id").alias("v"), "vec"), "v").select("u", "v", "vec")
    return full.repartition(partitions(lists.sparkSession), "u").sortWithinPartitions("u", "v").mapInArrow(near, LISTS)


def refine(lists: DataFrame, vectors: DataFrame, n: int, k: int, rounds: int) -> DataFrame:
    """Rounds of neighbours of neighbours until few lists change."""
    for _ in range(rounds):
        new = saved(merge(lists.withColumn("fresh", F.lit(False)).unionByName(join_neighbours(lists, vectors, k)), k), "nn-lists")
        release(lists)
        lists = new
        if lists.where("fresh").count() <= CHANGE * n:
            break
    return lists


def sample_links(vectors: DataFrame, n: int, threshold: float) -> tuple[DataFrame, bool]:
    """(id, n, links) of a sample of the ``n`` vectors, by comparing them with all; whether it is all."""
    same = lambda d: d.select("id", F.lit(0).alias("comp"), "n", "vec")
    part = min(PART, n // AUDIT)
    while True:
        few = vectors.where(F.pmod(F.xxhash64("id"), F.lit(max(part, 1))) == 0)
        true = saved(against(same(few), same(vectors), threshold).where("other is null").drop("other"), "nn-audit")
        if part <= 1 or (true.agg(F.sum("n")).head()[0] or 0) >= SEEN:
            return true, part <= 1
        release(true)
        part //= 4


def audit(lists: DataFrame, true: DataFrame, threshold: float) -> float:
    """Share of the true links of the sample that lists hold; of saturated lists, the entries there
    are room for."""
    got = lists.select("id", F.size(F.filter("sim", lambda s: s >= threshold)).alias("got"), F.size("sim").alias("k"))
    both = true.join(got, "id", "left").select(F.coalesce("got", F.lit(0)).alias("got"), F.least("n", F.coalesce("k", "n")).alias("want"))
    return share(both)


def share(both: DataFrame) -> float:
    got, want = both.agg(F.sum(F.least("got", "want")), F.sum("want")).head()
    return got / want if want else 1.0


def against(few: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, other, n, links) of ``few`` against all of ``vectors``, both (id, comp, n, vec), in pairs of
    blocks: with ``other`` null the vectors each id of ``few`` links with, and these with their
    copies; else two ``comp`` that a link joins."""
    f, n, most = few.count(), vectors.count(), partitions(vectors.sparkSession)
    down = max(1, math.ceil(f / BLOCK))
    over = max(1, math.ceil(n / WIDE), min(math.ceil(n / 256), math.ceil(most / down)))

    def dealt(df, side, own, blocks, others):
        rows = df.select("id", "comp", "n", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).select("*", F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("o"))
        key = F.col("b") * over + F.col("o") if own else F.col("o") * over + F.col("b")
        return rows.select(key.cast("long").alias("key"), F.lit(side).alias("side"), "id", "comp", "vec", "n")

    def run(batches):
        for _, rows in _groups(batches, 1 << 30, 6):
            for size in {len(r[4]) for r in rows if not r[1]}:
                sides = []
                for side in (0, 1):
                    own = [r for r in rows if r[1] == side and len(r[4]) == size]
                    x = np.frombuffer(b"".join(r[4] for r in own), "<f4").reshape(len(own), size // 4).astype(np.float64)
                    sides.append((*(np.array([r[i] for r in own], np.int64) for i in (2, 3, 5)), x / np.sqrt((x * x).sum(1, keepdims=True))))
                (ids, comp, _, x), (others, groups, copies, y) = sides
                total, links, joined = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), set()
                for i in range(0, len(others), BLOCK):
                    hit = x @ y[i : i + BLOCK].T >= threshold
                    hit[ids[:, None] == others[None, i : i + BLOCK]] = False
                    total += hit.sum(1)
                    links += hit @ copies[i : i + BLOCK]
                    a, b = np.nonzero(hit & (comp[:, None] != groups[None, i : i + BLOCK]))
                    joined |= set(zip(comp[a].tolist(), groups[i : i + BLOCK][b].tolist(), strict=True))
                pairs = sorted(joined)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.tolist() + [a for a, _ in pairs], pa.int64()), pa.array([None] * len(ids) + [b for _, b in pairs], pa.int64()), *(pa.array(t.tolist() + [0] * len(pairs), pa.int64()) for t in (total, links))],
                    ["id", "other", "n", "links"],
                )

    both = dealt(few, 0, True, down, over).unionByName(dealt(vectors, 1, False, over, down))
    found = both.repartition(most, "key").sortWithinPartitions("key", "side", "id").mapInArrow(run, "id long, other long, n long, links long")
    return found.groupBy("id", "other").agg(F.sum("n").alias("n"), F.sum("links").alias("links"))


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links) within each ``comp`` of (comp, id, n, vec): its blocks in pairs."""
    sizes = members.groupBy("comp").agg(F.ceil(F.count("*") / PIECE).alias("blocks"))
    dealt = members.join(sizes, "comp").withColumn("b", F.pmod(F.xxhash64("id"), "blocks"))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    key = F.struct("comp", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))
    pairs = pairs.select(F.when(F.col("blocks") == 1, F.col("comp")).otherwise(F.xxhash64(key)).alias("key"), "id", "n", "b", "vec", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))

    def run(batches):
        for _, rows in _groups(batches, 1 << 30, 7):
            ids, n, b = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
            x = np.frombuffer(b"".join(r[4] for r in rows), "<f4").reshape(len(rows), -1).astype(np.float64)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            left, right = np.flatnonzero(b == rows[0][5]), np.flatnonzero(b == rows[0][6])
            hit = x[left] @ x[right].T >= threshold
            hit[ids[left][:, None] == ids[right][None, :]] = False
            parts = [(ids[left], hit @ n[right])]
            if rows[0][5] != rows[0][6]:
                parts.append((ids[right], n[left] @ hit))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64))], ["id", "links"])

    shape = pairs.repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key", "id")
    return shape.mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, k: int = K) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall)."""
    vectors = saved(classes_of(embeddings), "nn-vectors")
    n = vectors.count()
    tables = table_count(n, threshold)
    lists = saved(merge(leaves(vectors, n, 0, tables, k), k), "nn-lists")
    lists = refine(lists, vectors, n, k, ROUNDS)
    true, every = sample_links(vectors, n, threshold)
    while not every and audit(lists, true, threshold) < RECALL:
        if 4 * LEAF * tables >= n:
            every = True
            break
        more = leaves(vectors, n, tables, MORE, k)
        lists = refine(saved(merge(lists.withColumn("fresh", F.lit(False)).unionByName(more), k), "nn-lists"), vectors, n, k, ROUNDS)
        tables += MORE
    links = lists.select("id", F.explode(F.arrays_zip("nbr", "sim")).alias("x")).where(F.col("x.sim") >= threshold)
    links = saved(links.select(F.least("id", "x.nbr").alias("a"), F.greatest("id", "x.nbr").alias("b")).distinct(), "nn-links")
    comp = saved(components(links, "nn-components"), "nn-components")
    # links that full lists have no room for, of vectors without a list too
    held = lists.select("id", F.exists("sim", lambda s: s < threshold).alias("whole"))
    known = saved(vectors.join(comp, "id", "left").join(held, "id", "left").select("id", F.coalesce("component_id", "id").alias("comp"), "n", "vec", (F.coalesce("whole", F.lit(False)) & F.lit(not every)).alias("whole")), "nn-known")
    out = saved(against(known.where("not whole"), known, threshold).where("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "nn-out")
    if out.head(1):
        links = links.unionByName(out).distinct()
        comp = saved(components(links, "nn-components"), "nn-components")
    sizes = comp.groupBy("component_id").count()
    large = comp.join(sizes.where("count > 2"), "component_id").select(F.col("component_id").alias("comp"), "id")
    exact = saved(count_links(large.join(vectors, "id").select("comp", "id", "n", "vec"), threshold), "nn-exact")
    # components of two: the other's copies
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("o")))
    pairs = ends.join(large.select("id"), "id", "left_anti").join(vectors.select(F.col("id").alias("o"), "n"), "o").groupBy("id").agg(F.sum("n").alias("links"))
    found = exact.unionByName(pairs)
    found = saved(found, "nn-found")
    # of the result, however many links a vector has
    recall = share(true.join(found.withColumnRenamed("links", "got"), "id", "left").select(F.coalesce("got", F.lit(0)).alias("got"), F.col("links").alias("want")))
    per_class = saved(vectors.join(found, "id", "left").join(comp, "id", "left").select("id", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "nn-classes")
    # rows find their class by their own bytes
    own = classless(embeddings)
    out = own.join(per_class, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn("audit_recall", F.lit(recall))


def classless(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) of every row; vec is null where the vector cannot link."""

    def run(batches):
        for b in batches:
            raw = []
            for d, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = None if v is None or d is None or any(c is None for c in v) else np.array(v, "<f4") + np.float32(0)
                raw.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["vec_id", "vec"])

    return map_batches(embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")), run, "vec_id long, vec binary")
