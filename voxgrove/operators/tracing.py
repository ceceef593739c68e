"""Seeds, fronts, merging and minimum spanning forests, as rounds of group minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import components, relax, stars
from ..plans.scratch import drop, written
from .stencil import cube, reach


def priority(idx):
    """The order of seed candidates: a multiplicative hash, the same in every engine."""
    return (idx * 2654435761) % 4294967296


def poisson_seeds(fg: DataFrame, radius: int = 1) -> DataFrame:
    """(image_id, seed_id, idx): the first maximal independent set by (priority, idx), no two
    seeds within ``radius`` steps. Every round takes the voxels that come before all their undecided
    neighbours, so that neither rounds nor partitions change the result. seed_id is idx."""
    rows = fg.select("image_id", "idx", priority(F.col("idx")).alias("p"))
    there = rows.select("image_id", F.col("idx").alias("dst"), F.col("p").alias("q"))
    pairs = reach(fg, cube(radius)).select("image_id", "src", "dst").join(there, ["image_id", "dst"])
    pairs = written(pairs, "seed-pairs")
    open_, taken = written(rows, "seed-open"), None
    while not open_.isEmpty():
        alive = open_.select("image_id", F.col("idx").alias("dst"))
        first = pairs.join(alive, ["image_id", "dst"], "left_semi").groupBy("image_id", F.col("src").alias("idx")).agg(F.min(F.struct(F.col("q").alias("p"), F.col("dst").alias("idx"))).alias("best"))
        won = open_.join(first, ["image_id", "idx"], "left").where(F.col("best").isNull() | (F.struct("p", "idx") < F.col("best"))).select("image_id", "idx")
        won = written(won, "seed-won")
        out = pairs.join(won.withColumnRenamed("idx", "src"), ["image_id", "src"], "left_semi").select("image_id", F.col("dst").alias("idx"))
        rest = written(open_.join(won.unionByName(out).distinct(), ["image_id", "idx"], "left_anti"), "seed-open")
        drop(open_)
        open_, taken = rest, won if taken is None else taken.unionByName(won)
    seeds = taken if taken is not None else rows.select("image_id", "idx")
    return seeds.select("image_id", F.col("idx").alias("seed_id"), "idx")


def fast_marching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(image_id, idx, dist, seed_id): least (distance, seed) over the weights of ``edges``."""
    start = seeds.select("image_id", "idx", F.lit(0).cast("long").alias("dist"), F.col("seed_id").alias("label"))
    return relax(edges, start, "march").select("image_id", "idx", "dist", F.col("label").alias("seed_id"))


def parent_forest(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, idx, parent_idx, dist, seed_id): the parent is the least (distance through it,
    its seed, its idx); null at seeds."""
    from_ = labels.select("image_id", F.col("idx").alias("src"), F.col("dist").alias("d"), "seed_id")
    best = edges.join(from_, ["image_id", "src"]).groupBy("image_id", F.col("dst").alias("idx")).agg(F.min(F.struct((F.col("d") + F.col("w")).alias("dist"), F.col("seed_id"), F.col("src"))).alias("best"))
    rows = labels.join(best, ["image_id", "idx"], "left")
    return rows.select("image_id", "idx", F.when(F.col("dist") > 0, F.col("best.src")).alias("parent_idx"), "dist", "seed_id")


def child_counts(forest: DataFrame) -> DataFrame:
    """(image_id, idx, children)."""
    n = forest.where("parent_idx IS NOT NULL").groupBy("image_id", F.col("parent_idx").alias("idx")).agg(F.count("*").alias("children"))
    return forest.select("image_id", "idx").join(n, ["image_id", "idx"], "left").select("image_id", "idx", F.coalesce("children", F.lit(0)).alias("children"))


def merge_candidates(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, s, t, cost, a, b): the cheapest edge between each two labels s < t, a on the side
    of s; cost is dist(a) + w + dist(b), ties to the lower (a, b)."""
    own = labels.select("image_id", F.col("idx").alias("src"), F.col("dist").alias("da"), F.col("seed_id").alias("s"))
    other = labels.select("image_id", F.col("idx").alias("dst"), F.col("dist").alias("db"), F.col("seed_id").alias("t"))
    cross = edges.join(own, ["image_id", "src"]).join(other, ["image_id", "dst"]).where("s < t")
    best = cross.groupBy("image_id", "s", "t").agg(F.min(F.struct((F.col("da") + F.col("w") + F.col("db")).alias("cost"), F.col("src").alias("a"), F.col("dst").alias("b"))).alias("e"))
    return best.select("image_id", "s", "t", "e.cost", "e.a", "e.b")


def spanning_forest(candidates: DataFrame) -> DataFrame:
    """The edges of the minimum spanning forest under the order (cost, a, b), by Boruvka rounds: each
    component takes its least edge outward, what they join becomes one node, and of the edges
    between two nodes the least stays, so that rounds work on less and less."""
    names = ["s", "t", "cost", "a", "b"]
    e = F.struct("cost", "a", "b", "s", "t").alias("e")
    cand = written(candidates.where("s <> t").select("image_id", F.col("s").alias("cs"), F.col("t").alias("ct"), e), "mst-candidates")
    chosen = candidates.limit(0).select("image_id", *names)
    while not cand.isEmpty():
        ways = cand.select("image_id", F.col("cs").alias("comp"), "e", F.col("ct").alias("to")).unionByName(cand.select("image_id", F.col("ct").alias("comp"), "e", F.col("cs").alias("to")))
        best = written(ways.groupBy("image_id", "comp").agg(F.min(F.struct("e", "to")).alias("m")).select("image_id", "comp", "m.e", "m.to"), "mst-best")
        chosen = chosen.unionByName(best.select("image_id", "e.*").select("image_id", *names).distinct())
        joined = stars(best.select("image_id", F.col("comp").alias("a"), F.col("to").alias("b")), "mst-comp")
        one, two = (joined.select("image_id", F.col("idx").alias(c), F.col("comp").alias(n)) for c, n in (("cs", "ns"), ("ct", "nt")))
        left = cand.join(one, ["image_id", "cs"]).join(two, ["image_id", "ct"]).where("ns <> nt")
        left = left.groupBy("image_id", F.least("ns", "nt").alias("cs"), F.greatest("ns", "nt").alias("ct")).agg(F.min("e").alias("e"))
        new = written(left, "mst-candidates")
        drop(cand)
        cand = new
    return chosen


def voxel_components(edges: DataFrame, fg: DataFrame) -> DataFrame:
    """(image_id, idx, comp): 26-connected components of the foreground, by least idx."""
    return components(edges, fg, "components")
