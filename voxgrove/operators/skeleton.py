"""From merged segments to a numbered skeleton: re-rooting, chains, pruning.

Trees are as deep as branches are long, so nothing here walks level by level: re-rooting ranks an
Euler tour by pointer doubling, and chains take the deepest descendant by doubling ancestors; both
take as many rounds as the depth has bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import double
from ..plans.scratch import drop, written


def segment_components(labels: DataFrame, forest: DataFrame) -> DataFrame:
    """(image_id, seed_id, comp): seeds joined by the spanning forest, named by their least seed."""
    from ..plans.fixpoint import components

    seeds = labels.select("image_id", F.col("seed_id").alias("idx")).distinct()
    c = components(forest.select("image_id", F.col("s").alias("src"), F.col("t").alias("dst")), seeds, "segments")
    return c.select("image_id", F.col("idx").alias("seed_id"), "comp")


def reroot(parents: DataFrame, merges: DataFrame, segments: DataFrame) -> DataFrame:
    """(image_id, idx, parent_idx, comp): one tree for each component, rooted at its least seed.

    ``parents`` and the voxel pairs of ``merges`` are undirected tree edges. Each becomes two arcs;
    the arc after (u, v) leaves v for the next neighbour after u. The tour of a component is cut
    before its root's first arc; an arc met before its reverse points away from the root."""
    up = parents.where("parent_idx IS NOT NULL").select("image_id", F.col("idx").alias("u"), F.col("parent_idx").alias("v"))
    link = merges.select("image_id", F.col("a").alias("u"), F.col("b").alias("v"))
    one = up.unionByName(link)
    arcs = written(one.unionByName(one.select("image_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "arcs")
    around = Window.partitionBy("image_id", "u").orderBy("v")
    ring = arcs.select("image_id", "u", "v", F.coalesce(F.lead("v").over(around), F.first("v").over(around)).alias("next"), F.row_number().over(around).alias("k"))
    id_ = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    # after (u, v) comes (v, next of u around v); a component's tour ends where its root starts anew
    after = ring.select("image_id", F.col("u").alias("v"), F.col("v").alias("u"), F.col("next").alias("w"), F.col("k"))
    roots = segments.select("image_id", F.col("comp").alias("v")).distinct().withColumn("root", F.lit(True))
    first = ring.where("k = 1").select("image_id", F.col("u").alias("v"), F.col("v").alias("head"))
    tour = after.join(roots, ["image_id", "v"], "left").join(first, ["image_id", "v"])
    over = F.coalesce("root", F.lit(False)) & (F.col("w") == F.col("head"))
    nodes = tour.select("image_id", id_("u", "v").alias("idx"), F.when(~over, F.struct(F.col("v").alias("u"), F.col("w").alias("v"))).alias("up"), F.lit(1).cast("long").alias("left"))
    ranked = double(nodes, "tour", {"left": "sum"}).select("image_id", "idx.u", "idx.v", "left")
    back = ranked.select("image_id", F.col("u").alias("v"), F.col("v").alias("u"), F.col("left").alias("back"))
    down = ranked.join(back, ["image_id", "u", "v"]).where("left > back").select("image_id", F.col("v").alias("idx"), F.col("u").alias("parent"))
    comp = parents.select("image_id", "idx", "seed_id").join(segments, ["image_id", "seed_id"])
    out = written(comp.join(down, ["image_id", "idx"], "left").select("image_id", "idx", F.col("parent").alias("parent_idx"), "comp"), "tree")
    drop(arcs)
    return out


def leaves(tree: DataFrame) -> DataFrame:
    """(image_id, idx) of nodes that are nobody's parent."""
    p = tree.where("parent_idx IS NOT NULL").select("image_id", F.col("parent_idx").alias("idx"))
    return tree.select("image_id", "idx").join(p, ["image_id", "idx"], "left_anti")


def _steps(tree: DataFrame, voxels: DataFrame) -> DataFrame:
    """``tree`` with ``step``, the length in thousandths to the parent, 0 at a root."""
    at = voxels.select("image_id", "idx", "x", "y", "z")
    up = at.select("image_id", F.col("idx").alias("parent_idx"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    t = tree.join(at, ["image_id", "idx"]).join(up, ["image_id", "parent_idx"], "left")
    d2 = sum((F.abs(F.col(c) - F.col(f"p{c}")) for c in "xyz"), F.lit(0))
    return t.select("image_id", "idx", "parent_idx", "comp", F.when(F.col("parent_idx").isNull(), 0).when(d2 == 1, 1000).when(d2 == 2, 1414).otherwise(1732).cast("long").alias("step"))


def chains(tree: DataFrame, voxels: DataFrame) -> DataFrame:
    """(image_id, idx, parent_idx, comp, chain_id, pos, after): longest path first. A node goes on
    into the child with the farthest descendant, ties to the lower idx. A chain is named by its leaf;
    pos counts from the leaf; ``after`` is the node that the chain's last node hangs on."""
    t = written(_steps(tree, voxels), "steps")
    depth = double(t.select("image_id", "idx", F.col("parent_idx").alias("up"), F.col("step").alias("depth")), "depth", {"depth": "sum"}).select("image_id", "idx", "depth")
    # the farthest descendant, by ancestors at twice the distance in each round
    far = written(depth.withColumnRenamed("depth", "far"), "far")
    anc = written(t.select("image_id", "idx", F.col("parent_idx").alias("up")), "anc")
    while not anc.where("up IS NOT NULL").isEmpty():
        below = anc.where("up IS NOT NULL").join(far, ["image_id", "idx"]).groupBy("image_id", F.col("up").alias("idx")).agg(F.max("far").alias("more"))
        new = written(far.join(below, ["image_id", "idx"], "left").select("image_id", "idx", F.greatest("far", "more").alias("far")), "far")
        up2 = anc.select("image_id", F.col("idx").alias("up"), F.col("up").alias("up2"))
        anc2 = written(anc.join(up2, ["image_id", "up"], "left").select("image_id", "idx", F.col("up2").alias("up")), "anc")
        drop(far)
        drop(anc)
        far, anc = new, anc2
    on = t.where("parent_idx IS NOT NULL").join(far, ["image_id", "idx"]).groupBy("image_id", F.col("parent_idx").alias("idx")).agg(F.max(F.struct("far", (-F.col("idx")).alias("low"))).alias("best")).select("image_id", "idx", (-F.col("best.low")).alias("down"))
    # each node points to the child it goes on into; the end is its leaf, the way there its place
    nodes = t.join(on, ["image_id", "idx"], "left").select("image_id", "idx", F.col("down").alias("up"), F.when(F.col("down").isNull(), 0).otherwise(1).cast("long").alias("pos"))
    leaf = double(nodes, "chain", {"pos": "sum"})
    head = t.join(on.select("image_id", F.col("down").alias("idx"), F.lit(True).alias("inner")), ["image_id", "idx"], "left")
    rows = head.join(leaf, ["image_id", "idx"])
    return rows.select("image_id", "idx", "parent_idx", "comp", F.col("top").alias("chain_id"), F.col("pos").cast("int").alias("pos"), F.when(F.col("inner").isNull(), F.col("parent_idx")).alias("after"))


def prune(rows: DataFrame, min_nodes: int = 32) -> DataFrame:
    """Chains of at least ``min_nodes`` nodes that hang on kept ones only."""
    n = rows.groupBy("image_id", "chain_id").agg(F.count("*").alias("n"), F.max("after").alias("after"))
    on = rows.select("image_id", F.col("idx").alias("after"), F.col("chain_id").alias("up"))
    tree = n.join(on, ["image_id", "after"], "left").select("image_id", F.col("chain_id").alias("idx"), "up", (F.col("n") >= min_nodes).cast("int").alias("ok"))
    kept = double(tree, "prune", {"ok": "min"}).where("ok = 1").select("image_id", F.col("idx").alias("chain_id"))
    return rows.join(kept, ["image_id", "chain_id"], "left_semi")


def refine(rows: DataFrame, voxels: DataFrame, radii: DataFrame) -> DataFrame:
    """Chains without those that run inside the branch they hang on: all of their nodes lie within the
    radius of the node they hang on. Chains that hang on one that goes, go too."""
    at = voxels.select("image_id", "idx", "x", "y", "z")
    hub = at.join(radii, ["image_id", "idx"]).select("image_id", F.col("idx").alias("hub"), *(F.col(c).alias(f"h{c}") for c in "xyz"), F.col("radius").cast("long").alias("r"))
    on = rows.groupBy("image_id", "chain_id").agg(F.max("after").alias("hub"))
    near = rows.select("image_id", "chain_id", "idx").join(on, ["image_id", "chain_id"]).where("hub IS NOT NULL").join(at, ["image_id", "idx"]).join(hub, ["image_id", "hub"])
    d2 = sum(((F.col(c) - F.col(f"h{c}")) * (F.col(c) - F.col(f"h{c}")) for c in "xyz"), F.lit(0))
    inside = near.groupBy("image_id", "chain_id").agg(F.max((d2 > F.col("r") * F.col("r")).cast("int")).alias("ok"))
    place = rows.select("image_id", F.col("idx").alias("hub"), F.col("chain_id").alias("up"))
    tree = on.join(place, ["image_id", "hub"], "left").join(inside, ["image_id", "chain_id"], "left")
    kept = double(tree.select("image_id", F.col("chain_id").alias("idx"), "up", F.coalesce("ok", F.lit(1)).alias("ok")), "refine", {"ok": "min"}).where("ok = 1").select("image_id", F.col("idx").alias("chain_id"))
    return rows.join(kept, ["image_id", "chain_id"], "left_semi")


def valid_leaf_count(rows: DataFrame) -> DataFrame:
    """(image_id, n): leaves that remain, one for each chain."""
    return rows.where("pos = 0").groupBy("image_id").agg(F.count("*").alias("n"))


def number(rows: DataFrame, voxels: DataFrame, radii: DataFrame) -> DataFrame:
    """SWC rows (image_id, id, type, x, y, z, r, parent): chain by chain in order of component and
    leaf, ids from 1, the parent of a node the next one in its chain; null at a root. Type is
    2 + rank of the component mod 11. Numbers come from counts of chains, then places in them."""
    sizes = rows.groupBy("image_id", "comp", "chain_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("image_id").orderBy("comp", "chain_id").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.dense_rank().over(Window.partitionBy("image_id").orderBy("comp")) - 1
    base = sizes.select("image_id", "chain_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), rank.alias("rank"))
    ids = rows.join(base, ["image_id", "chain_id"]).select("image_id", "idx", "parent_idx", (F.col("base") + F.col("pos") + 1).cast("int").alias("id"), (2 + F.col("rank") % 11).cast("int").alias("type"))
    up = ids.select("image_id", F.col("idx").alias("parent_idx"), F.col("id").alias("parent"))
    out = ids.join(up, ["image_id", "parent_idx"], "left").join(voxels.select("image_id", "idx", "x", "y", "z"), ["image_id", "idx"]).join(radii, ["image_id", "idx"], "left")
    return out.select("image_id", "id", "type", "x", "y", "z", F.coalesce("radius", F.lit(0)).alias("r"), "parent")
