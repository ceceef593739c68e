"""The registered queries of the tracing engine, and DuckDB SQL for them.

All run over the proxy volume of the given tables, at thresholds that give one large component
(235) or many small ones (250).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.costs import cost_table, mean_edge_cost, voxel_cost
from ..operators import distance, queue, skeleton, stencil, tracing, voxels
from ..sources.swc import read_swc, swc_lines, write_swc
from ..sources.volume import proxy_volume, read_tiff, write_tiff
from . import trace as tr
from .scratch import folder, written

T_ONE, T_MANY = 235, 250


def _fg(spark: SparkSession, d: str, t: int = T_ONE) -> DataFrame:
    return voxels.global_threshold(proxy_volume(spark, d), t)


def _edges(spark, d, t=T_ONE):
    return written(stencil.edges26(_fg(spark, d, t)).select("image_id", "src", "dst", "w", "ts", "td"), "edges")


def _march(spark, d):
    """(edges, labels) at the one threshold."""
    edges = _edges(spark, d)
    return edges, written(tracing.fast_marching(edges, tracing.poisson_seeds(_fg(spark, d))), "labels")


def _forest(spark, d):
    return tracing.parent_forest(*_march(spark, d))


def _decoded(spark, d):
    """The forest's parents, packed and unpacked again."""
    return stencil.decode_parents(stencil.encode_parents(_forest(spark, d), _fg(spark, d)))


def _lookup(spark, d):
    """Every number of the compact index, looked up in it."""
    index = voxels.compact_index(_fg(spark, d))
    cids = spark.range(_fg(spark, d).count()).select(F.lit("proxy").alias("image_id"), F.col("id").alias("cid"))
    return voxels.compact_lookup(index, cids)


def _tiff_round_trip(spark, d):
    """The proxy volume as a stack in the shared folder, read back."""
    path = f"{folder(spark)}/voxgrove-{spark.sparkContext.applicationId}/stacks-{uuid.uuid4().hex}"
    write_tiff(proxy_volume(spark, d), path)
    return read_tiff(spark, path)


def _swc_round_trip(spark, d):
    """The skeleton as an .swc file in the shared folder, read back."""
    path = f"{folder(spark)}/voxgrove-{spark.sparkContext.applicationId}/swc-{uuid.uuid4().hex}"
    write_swc(_skeleton(spark, d), path)
    back = read_swc(spark, path)
    return back.select("id", "type", *(F.col(c).cast("int").alias(c) for c in "xyzr"), "parent")


def _refined(spark, d):
    fg = _fg(spark, d)
    return skeleton.refine(skeleton.prune(_chains(spark, d), 3), fg, distance.radius_by_ball(fg))


def _skeleton(spark, d, threshold=T_ONE, min_nodes=3):
    return tr.trace(proxy_volume(spark, d), threshold=threshold, min_nodes=min_nodes)


def _segments(spark, d):
    """(foreground, forest, spanning forest, segments) at the one threshold."""
    fg = _fg(spark, d)
    edges, labels, forest = tr.marched(fg)
    mst = written(tracing.spanning_forest(tracing.merge_candidates(edges, labels)), "mst")
    return fg, forest, mst, skeleton.segment_components(labels, mst)


def _tree(spark, d):
    return skeleton.reroot(*_segments(spark, d)[1:])


def _chains(spark, d):
    fg, *parts = _segments(spark, d)
    return skeleton.chains(skeleton.reroot(*parts), fg)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _skeleton(spark, d, 200)


def queries():
    """Name to function of (spark, sf_dir)."""
    vol = proxy_volume
    return {
        "proxy_volume": lambda s, d: vol(s, d).select("idx", "x", "y", "z", "v"),
        "global_threshold": lambda s, d: _fg(s, d).select("idx", "v"),
        "slice_profile": lambda s, d: voxels.slice_profile(_fg(s, d, 200)).select("z", "n", "total"),
        "auto_threshold": lambda s, d: voxels.auto_threshold(vol(s, d)).select("idx", "v"),
        "local_threshold": lambda s, d: stencil.local_threshold(_fg(s, d)).select("idx", "v"),
        "compact_index": lambda s, d: voxels.compact_index(_fg(s, d), 1024).select("idx", "cid"),
        "compact_lookup": lambda s, d: _lookup(s, d).select("cid", "idx"),
        "neighbors6": lambda s, d: stencil.neighbours(_fg(s, d), stencil.OFFSETS6).select("src", "dst"),
        "neighbors26": lambda s, d: stencil.edges26(_fg(s, d)).select("src", "dst", "dir", "step"),
        "neighbors_ball": lambda s, d: stencil.neighbours(_fg(s, d, T_MANY), stencil.ball(3)).select("src", "dst", "d2"),
        "voxel_cost": lambda s, d: _fg(s, d).select("idx", F.round(voxel_cost(F.col("v")), 6).alias("cost")),
        "mean_edge_cost": lambda s, d: stencil.edges26(_fg(s, d, T_MANY)).select("src", "dst", F.round(mean_edge_cost(F.col("step") / 1000, F.col("a"), F.col("b")), 6).alias("cost")),
        "edge_cost": lambda s, d: _edges(s, d).select("src", "dst", "w"),
        "parent_decode": lambda s, d: _decoded(s, d).select("idx", "parent_idx"),
        "prefix_sum": lambda s, d: voxels.prefix_sum(_fg(s, d), F.col("v").cast("long"), ["image_id"], "idx", True, 1024).select("idx", "scan"),
        "transform_scan": lambda s, d: voxels.prefix_sum(vol(s, d), (F.col("v") >= T_ONE).cast("long"), ["image_id"], "idx", False, 1024).select("idx", "scan"),
        "reduce_stats": lambda s, d: voxels.reduce_stats(vol(s, d)).select("n", "total", "least", "most"),
        "extrema": lambda s, d: voxels.extrema(vol(s, d)).select("low_idx", "high_idx"),
        "replace_if": lambda s, d: voxels.replace_if(vol(s, d), "v", F.col("v") < T_ONE, 0).select("idx", "v"),
        "remove_if": lambda s, d: voxels.remove_if(vol(s, d), F.col("v") < T_ONE).select("idx", "v"),
        "copy_if": lambda s, d: voxels.copy_if(vol(s, d), F.col("v") % 2 == 0).select("idx", "v"),
        "fill": lambda s, d: voxels.fill(_fg(s, d), "state", 0).select("idx", "state"),
        "sequence": lambda s, d: voxels.sequence(s, 1000),
        "scatter": lambda s, d: voxels.scatter(vol(s, d), _fg(s, d).select("idx", (F.col("v") * 2).alias("w")), ["idx"], "v", "w").select("idx", "v"),
        "queue_least": lambda s, d: queue.least(vol(s, d).select("z", "idx", "v"), ["z"], "v", "idx").select("z", "idx", "v"),
        "components": lambda s, d: tracing.voxel_components(_edges(s, d, T_MANY), _fg(s, d, T_MANY)).select("idx", "comp"),
        "gwdt": lambda s, d: distance.grey_weighted(_fg(s, d, 200)).select("idx", "gwdt"),
        "radius_direct": lambda s, d: distance.radius_by_ball(_fg(s, d, 150)).select("idx", "radius"),
        "radius_fm": lambda s, d: distance.radius_by_steps(_fg(s, d, 150)).select("idx", "radius"),
        "poisson_seeds": lambda s, d: tracing.poisson_seeds(_fg(s, d)).select("seed_id"),
        "geodesic": lambda s, d: _march(s, d)[1].select("idx", "dist"),
        "seed_label": lambda s, d: _march(s, d)[1].select("idx", "dist", "seed_id"),
        "parent_forest": lambda s, d: _forest(s, d).select("idx", "parent_idx"),
        "child_counts": lambda s, d: tracing.child_counts(_forest(s, d)).select("idx", "children"),
        "leaves": lambda s, d: skeleton.leaves(_forest(s, d)).select("idx"),
        "merge_candidates": lambda s, d: tracing.merge_candidates(*_march(s, d)).select("s", "t", "cost", "a", "b"),
        "mst_edges": lambda s, d: tracing.spanning_forest(tracing.merge_candidates(*_march(s, d))).select("s", "t", "cost", "a", "b"),
        "segments": lambda s, d: _segments(s, d)[3].select("seed_id", "comp"),
        "merged_tree": lambda s, d: _tree(s, d).select("idx", "parent_idx", "comp"),
        "pruned_chains": lambda s, d: skeleton.prune(_chains(s, d), 3).select("idx", "chain_id"),
        "refined_chains": lambda s, d: _refined(s, d).select("idx", "chain_id"),
        "valid_leaf_count": lambda s, d: skeleton.valid_leaf_count(skeleton.prune(_chains(s, d), 3)).select("n"),
        "chains": lambda s, d: _chains(s, d).select("idx", "chain_id", "pos", "after"),
        "tiff_round_trip": lambda s, d: _tiff_round_trip(s, d).select("image_id", "idx", "x", "y", "z", "v", "width", "height", "depth"),
        "swc_round_trip": lambda s, d: _swc_round_trip(s, d),
        "swc": lambda s, d: swc_lines(_skeleton(s, d)).select("id", "line"),
    }


def _o(offsets):
    return "(VALUES " + ", ".join(f"({i}, {a}, {b}, {c}, {a * a + b * b + c * c})" for i, (a, b, c) in enumerate(offsets)) + ") o(dir, dx, dy, dz, d2)"


VOX = "vox AS (SELECT (z * 48 + y) * 48 + x AS idx, * FROM (SELECT CAST(l_partkey % 48 AS INT) x, CAST(l_orderkey % 48 AS INT) y, CAST(l_linenumber - 1 AS INT) z, CAST(max(l_quantity * 5) AS INT) v FROM lineitem GROUP BY 1, 2, 3))"


def _sql(t=T_ONE, offsets=None):
    out = f"{VOX}, fg AS (SELECT * FROM vox WHERE v >= {t})"
    if offsets:
        out += f", nb AS (SELECT a.idx AS src, b.idx AS dst, dir, d2, a.v AS a, b.v AS b FROM fg a CROSS JOIN {_o(offsets)} JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz)"
    return out


STEP = "CASE d2 WHEN 1 THEN 1000 WHEN 2 THEN 1414 ELSE 1732 END"
GI = "CAST([" + ", ".join(map(str, cost_table())) + "] AS BIGINT[])"
EDGES = f", edges AS (SELECT src, dst, CAST(({STEP}) * ({GI}[a + 1] + {GI}[b + 1]) AS BIGINT) AS w FROM nb)"
SEEDS = """,
pr AS (SELECT src, dst FROM nb WHERE ((CAST(src AS BIGINT) * 2654435761) % 4294967296, src) < ((CAST(dst AS BIGINT) * 2654435761) % 4294967296, dst)),
s(id, st) USING KEY (id) AS (
  SELECT idx, CASE WHEN idx IN (SELECT dst FROM pr) THEN 0 ELSE 1 END FROM fg
  UNION
  SELECT p.dst, CASE WHEN bool_or(a.st = 1) THEN 1 + 1 ELSE 1 END FROM pr p JOIN recurring.s a ON a.id = p.src JOIN recurring.s b ON b.id = p.dst
  WHERE b.st = 0 GROUP BY p.dst HAVING bool_or(a.st = 1) OR bool_and(a.st = 2)),
seeds AS (SELECT id AS idx FROM s WHERE st = 1)"""
MARCH = """,
lab(id, val) USING KEY (id) AS (
  SELECT idx, {'d': CAST(0 AS BIGINT), 's': idx} FROM seeds
  UNION
  SELECT e.dst, min({'d': l.val.d + e.w, 's': l.val.s}) FROM lab l JOIN edges e ON e.src = l.id LEFT JOIN recurring.lab r ON r.id = e.dst
  GROUP BY e.dst, r.val HAVING r.val IS NULL OR min({'d': l.val.d + e.w, 's': l.val.s}) < r.val)"""
PARENTS = """,
best AS (SELECT e.dst AS idx, min({'d': l.val.d + e.w, 's': l.val.s, 'u': e.src}) AS b FROM edges e JOIN lab l ON l.id = e.src GROUP BY e.dst),
forest AS (SELECT l.id AS idx, CASE WHEN l.val.d > 0 THEN b.b.u END AS parent_idx FROM lab l LEFT JOIN best b ON b.idx = l.id)"""
CANDIDATES = """,
m AS (SELECT a.val.s AS s, b.val.s AS t, min({'c': a.val.d + e.w + b.val.d, 'a': e.src, 'b': e.dst}) AS e
  FROM edges e JOIN lab a ON a.id = e.src JOIN lab b ON b.id = e.dst WHERE a.val.s < b.val.s GROUP BY 1, 2)"""
# Kruskal: candidates in order, one list of the seeds' labels handed from row to row
KRUSKAL = """,
num AS (SELECT idx, row_number() OVER (ORDER BY idx) AS k FROM seeds),
rk AS (SELECT s, t, e.c AS cost, e.a AS a, e.b AS b, row_number() OVER (ORDER BY e.c, e.a, e.b) AS r, i.k AS si, j.k AS ti FROM m JOIN num i ON i.idx = s JOIN num j ON j.idx = t),
kr(r, comp, took) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(k ORDER BY k) FROM num), false
  UNION ALL
  SELECT rk.r, CASE WHEN comp[si] = comp[ti] THEN comp ELSE list_transform(comp, lambda x: CASE WHEN x = greatest(comp[si], comp[ti]) THEN least(comp[si], comp[ti]) ELSE x END) END, comp[si] <> comp[ti]
  FROM kr JOIN rk ON rk.r = kr.r + 1),
mst AS (SELECT rk.* FROM rk JOIN kr USING (r) WHERE took),
final AS MATERIALIZED (SELECT max_by(comp, r) AS comp FROM kr),
own AS MATERIALIZED (SELECT unnest(comp) AS c, generate_subscripts(comp, 1) AS k FROM final),
seg AS (SELECT n.idx AS seed_id, o.idx AS comp FROM own JOIN num n ON n.k = own.k JOIN num o ON o.k = own.c)"""
TREE = """,
one AS (SELECT idx AS u, parent_idx AS v FROM forest WHERE parent_idx IS NOT NULL UNION SELECT a, b FROM mst),
arcs AS (SELECT o.u, o.v, CASE abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) WHEN 1 THEN 1000 WHEN 2 THEN 1414 ELSE 1732 END AS step
  FROM (SELECT u, v FROM one UNION SELECT v, u FROM one) o JOIN fg p ON p.idx = o.u JOIN fg q ON q.idx = o.v),
tree(idx, parent_idx, comp, depth) AS (
  SELECT DISTINCT comp, CAST(NULL AS INTEGER), comp, CAST(0 AS BIGINT) FROM seg
  UNION ALL
  SELECT a.v, t.idx, t.comp, t.depth + a.step FROM tree t JOIN arcs a ON a.u = t.idx WHERE a.v IS DISTINCT FROM t.parent_idx)"""
CHAINS = """,
anc(idx, up) AS (SELECT idx, parent_idx FROM tree WHERE parent_idx IS NOT NULL UNION ALL SELECT a.idx, t.parent_idx FROM anc a JOIN tree t ON t.idx = a.up WHERE t.parent_idx IS NOT NULL),
far AS (SELECT t.idx, t.parent_idx, greatest(t.depth, coalesce(f.most, 0)) AS far FROM tree t LEFT JOIN (SELECT a.up, max(u.depth) AS most FROM anc a JOIN tree u ON u.idx = a.idx GROUP BY a.up) f ON f.up = t.idx),
nxt AS (SELECT idx, -p.l AS down FROM (SELECT parent_idx AS idx, max({'f': far, 'l': -idx}) AS p FROM far WHERE parent_idx IS NOT NULL GROUP BY parent_idx)),
ch(idx, chain_id, pos) AS (
  SELECT idx, idx, 0 FROM tree WHERE idx NOT IN (SELECT idx FROM nxt)
  UNION ALL
  SELECT n.idx, c.chain_id, c.pos + 1 FROM ch c JOIN nxt n ON n.down = c.idx),
chains AS (SELECT c.idx, c.chain_id, c.pos, t.parent_idx, t.comp, CASE WHEN n.down IS NULL THEN t.parent_idx END AS after FROM ch c JOIN tree t ON t.idx = c.idx LEFT JOIN nxt n ON n.down = c.idx),
sizes AS (SELECT chain_id, min(comp) AS comp, count(*) AS n, max(after) AS after FROM chains GROUP BY chain_id),
kept(chain_id, comp, n) AS (
  SELECT chain_id, comp, n FROM sizes WHERE after IS NULL AND n >= 3
  UNION ALL
  SELECT s.chain_id, s.comp, s.n FROM kept k JOIN chains c ON c.chain_id = k.chain_id JOIN sizes s ON s.after = c.idx WHERE s.n >= 3)"""
NUMBERS = """,
base AS (SELECT chain_id, coalesce(sum(n) OVER (ORDER BY comp, chain_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, dense_rank() OVER (ORDER BY comp) - 1 AS rank FROM refined),
ids AS (SELECT c.idx, c.parent_idx, CAST(b.base + c.pos + 1 AS INTEGER) AS id, 2 + b.rank % 11 AS kind FROM chains c JOIN base b ON b.chain_id = c.chain_id)"""
REFINED = """,
ok AS (SELECT c.chain_id, bool_or((g.x - h.x) * (g.x - h.x) + (g.y - h.y) * (g.y - h.y) + (g.z - h.z) * (g.z - h.z) > r.radius * r.radius) AS ok
  FROM kept k JOIN sizes s ON s.chain_id = k.chain_id JOIN chains c ON c.chain_id = k.chain_id JOIN fg g ON g.idx = c.idx JOIN fg h ON h.idx = s.after JOIN radii r ON r.idx = s.after GROUP BY c.chain_id),
refined(chain_id, comp, n) AS (
  SELECT k.chain_id, k.comp, k.n FROM kept k JOIN sizes s ON s.chain_id = k.chain_id WHERE s.after IS NULL
  UNION ALL
  SELECT s.chain_id, s.comp, s.n FROM refined f JOIN chains c ON c.chain_id = f.chain_id JOIN sizes s ON s.after = c.idx JOIN ok o ON o.chain_id = s.chain_id WHERE o.ok)"""
START = "WITH RECURSIVE " + _sql(T_ONE, stencil.OFFSETS26) + EDGES
LABEL = START + SEEDS + MARCH
FOREST = LABEL + PARENTS
MERGED = START + SEEDS + MARCH + CANDIDATES + KRUSKAL
SKELETON = MERGED + PARENTS + TREE + CHAINS


def _relax(start, weight, t, name, kind="BIGINT"):
    return "WITH RECURSIVE " + _sql(t, stencil.OFFSETS26) + f""",
six AS (SELECT a.idx, count(b.idx) AS n FROM fg a CROSS JOIN {_o(stencil.OFFSETS6)} LEFT JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.idx),
r(id, val) USING KEY (id) AS (
  SELECT idx, CAST(0 AS {kind}) FROM six WHERE n < 6
  UNION
  SELECT nb.dst, min(l.val + CAST({weight} AS {kind})) FROM r l JOIN nb ON nb.src = l.id LEFT JOIN recurring.r o ON o.id = nb.dst
  GROUP BY nb.dst, o.val HAVING o.val IS NULL OR min(l.val + CAST({weight} AS {kind})) < o.val)
SELECT CAST(id AS BIGINT) AS idx, val AS {name} FROM r"""


def oracle_sql():
    """DuckDB SQL by query name."""
    w = "WITH " + _sql()
    n26 = "WITH " + _sql(T_ONE, stencil.OFFSETS26)
    big = "CAST(idx AS BIGINT) AS idx"
    balls = " ".join(f"WHEN 1000 * ({len(stencil.ball(r))} - n{r}) > {len(stencil.ball(r)) + 1} THEN {r - 1}" for r in (1, 2, 3))
    counts = ", ".join(f"count(*) FILTER (WHERE b.idx IS NOT NULL AND ceil(sqrt(d2)) <= {r}) AS n{r}" for r in (1, 2, 3))
    radii = f", rc AS (SELECT a.idx, {counts} FROM fg a CROSS JOIN {_o(stencil.ball(3))} LEFT JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.idx), radii AS (SELECT idx, CASE {balls} ELSE 3 END AS radius FROM rc)"
    traced = SKELETON + radii + REFINED + NUMBERS + ", traced AS (SELECT i.id, i.kind, g.x, g.y, g.z, r.radius AS r, p.id AS parent FROM ids i JOIN fg g ON g.idx = i.idx JOIN radii r ON r.idx = i.idx LEFT JOIN ids p ON p.idx = i.parent_idx) "
    return {
        "proxy_volume": f"WITH {VOX} SELECT {big}, x, y, z, v FROM vox",
        "tiff_round_trip": f"WITH {VOX} SELECT 'proxy.tif' AS image_id, {big}, x, y, z, v, 48 AS width, 48 AS height, 7 AS depth FROM vox",
        "global_threshold": f"{w} SELECT {big}, v FROM fg",
        "slice_profile": f"WITH {_sql(200)} SELECT z, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM fg GROUP BY z",
        "auto_threshold": f"WITH {VOX}, t AS (SELECT floor(avg(v) + 0.5 * greatest(stddev_pop(v), 10)) AS t FROM vox) SELECT {big}, v FROM vox, t WHERE v >= t",
        "local_threshold": f"WITH {_sql(T_ONE, stencil.cube(2))}, c AS (SELECT src, count(*) AS n, count(*) FILTER (WHERE b > a) AS m FROM nb GROUP BY src) SELECT {big}, v FROM fg LEFT JOIN c ON src = idx WHERE 20 * coalesce(m, 0) < coalesce(n, 0) + 1",
        "compact_index": f"{w} SELECT {big}, row_number() OVER (ORDER BY idx) - 1 AS cid FROM fg",
        "compact_lookup": f"{w} SELECT row_number() OVER (ORDER BY idx) - 1 AS cid, {big} FROM fg",
        "neighbors6": f"WITH {_sql(T_ONE, stencil.OFFSETS6)} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM nb",
        "neighbors26": f"{n26} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, dir, CAST({STEP} AS BIGINT) AS step FROM nb",
        "neighbors_ball": f"WITH {_sql(T_MANY, stencil.ball(3))} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, d2 FROM nb",
        "voxel_cost": f"{w} SELECT {big}, round(exp(10.0 * (1 - v / 255.0::DOUBLE) * (1 - v / 255.0::DOUBLE)), 6) AS cost FROM fg",
        "mean_edge_cost": f"WITH {_sql(T_MANY, stencil.OFFSETS26)} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(({STEP}) / 1000.0::DOUBLE * (exp(10.0 * (1 - a / 255.0::DOUBLE) * (1 - a / 255.0::DOUBLE)) + exp(10.0 * (1 - b / 255.0::DOUBLE) * (1 - b / 255.0::DOUBLE))) / 2, 6) AS cost FROM nb",
        "edge_cost": f"{n26}{EDGES} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, w FROM edges",
        "parent_decode": FOREST + " SELECT CAST(idx AS BIGINT) AS idx, CAST(parent_idx AS BIGINT) AS parent_idx FROM forest",
        "prefix_sum": f"{w} SELECT {big}, CAST(sum(v) OVER (ORDER BY idx) AS BIGINT) AS scan FROM fg",
        "transform_scan": f"WITH {VOX} SELECT {big}, CAST(coalesce(sum(CAST(v >= {T_ONE} AS INT)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM vox",
        "reduce_stats": f"WITH {VOX} SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most FROM vox",
        "extrema": f"WITH {VOX} SELECT CAST((SELECT idx FROM vox ORDER BY v, idx LIMIT 1) AS BIGINT) AS low_idx, CAST((SELECT idx FROM vox ORDER BY v DESC, idx LIMIT 1) AS BIGINT) AS high_idx",
        "replace_if": f"WITH {VOX} SELECT {big}, CASE WHEN v < {T_ONE} THEN 0 ELSE v END AS v FROM vox",
        "remove_if": f"{w} SELECT {big}, v FROM fg",
        "copy_if": f"WITH {VOX} SELECT {big}, v FROM vox WHERE v % 2 = 0",
        "fill": f"{w} SELECT {big}, 0 AS state FROM fg",
        "sequence": "SELECT i FROM range(1000) t(i)",
        "scatter": f"WITH {VOX} SELECT {big}, CASE WHEN v >= {T_ONE} THEN v * 2 ELSE v END AS v FROM vox",
        "queue_least": f"WITH {VOX} SELECT z, {big}, v FROM vox QUALIFY row_number() OVER (PARTITION BY z ORDER BY v, idx) = 1",
        "components": "WITH RECURSIVE " + _sql(T_MANY, stencil.OFFSETS26) + ", c(id, comp) USING KEY (id) AS (SELECT idx, idx FROM fg UNION SELECT nb.dst, min(l.comp) FROM c l JOIN nb ON nb.src = l.id JOIN recurring.c o ON o.id = nb.dst GROUP BY nb.dst, o.comp HAVING min(l.comp) < o.comp) SELECT CAST(id AS BIGINT) AS idx, CAST(comp AS BIGINT) AS comp FROM c",
        "gwdt": _relax("", f"({STEP}) * b", 200, "gwdt"),
        "radius_fm": _relax("", "1", 150, "radius", "INTEGER"),
        "radius_direct": f"WITH {_sql(150)}, c AS (SELECT a.idx, {counts} FROM fg a CROSS JOIN {_o(stencil.ball(3))} LEFT JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.idx) SELECT {big}, CASE {balls} ELSE 3 END AS radius FROM c",
        "poisson_seeds": "WITH RECURSIVE " + _sql(T_ONE, stencil.OFFSETS26) + SEEDS + " SELECT CAST(idx AS BIGINT) AS seed_id FROM seeds",
        "geodesic": LABEL + " SELECT CAST(id AS BIGINT) AS idx, val.d AS dist FROM lab",
        "seed_label": LABEL + " SELECT CAST(id AS BIGINT) AS idx, val.d AS dist, CAST(val.s AS BIGINT) AS seed_id FROM lab",
        "parent_forest": FOREST + " SELECT CAST(idx AS BIGINT) AS idx, CAST(parent_idx AS BIGINT) AS parent_idx FROM forest",
        "child_counts": FOREST + " SELECT CAST(f.idx AS BIGINT) AS idx, count(c.idx) AS children FROM forest f LEFT JOIN forest c ON c.parent_idx = f.idx GROUP BY f.idx",
        "leaves": FOREST + " SELECT CAST(idx AS BIGINT) AS idx FROM forest WHERE idx NOT IN (SELECT parent_idx FROM forest WHERE parent_idx IS NOT NULL)",
        "merge_candidates": LABEL + CANDIDATES + " SELECT CAST(s AS BIGINT) AS s, CAST(t AS BIGINT) AS t, e.c AS cost, CAST(e.a AS BIGINT) AS a, CAST(e.b AS BIGINT) AS b FROM m",
        "mst_edges": MERGED + " SELECT CAST(s AS BIGINT) AS s, CAST(t AS BIGINT) AS t, cost, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM mst",
        "segments": MERGED + " SELECT CAST(seed_id AS BIGINT) AS seed_id, CAST(comp AS BIGINT) AS comp FROM seg WHERE (SELECT count(*) FROM mst) >= 0",  # both readers of kr: it is then made once
        "merged_tree": MERGED + PARENTS + TREE + " SELECT CAST(idx AS BIGINT) AS idx, CAST(parent_idx AS BIGINT) AS parent_idx, CAST(comp AS BIGINT) AS comp FROM tree",
        "chains": SKELETON + " SELECT CAST(idx AS BIGINT) AS idx, CAST(chain_id AS BIGINT) AS chain_id, pos, CAST(after AS BIGINT) AS after FROM chains",
        "pruned_chains": SKELETON + " SELECT CAST(idx AS BIGINT) AS idx, CAST(chain_id AS BIGINT) AS chain_id FROM chains WHERE chain_id IN (SELECT chain_id FROM kept)",
        "valid_leaf_count": SKELETON + " SELECT count(*) AS n FROM kept",
        "refined_chains": SKELETON + radii + REFINED + " SELECT CAST(idx AS BIGINT) AS idx, CAST(chain_id AS BIGINT) AS chain_id FROM chains WHERE chain_id IN (SELECT chain_id FROM refined)",
        "swc": traced + "SELECT id, concat_ws(' ', id, kind, x, y, z, r, coalesce(parent, -1)) AS line FROM traced",
        "swc_round_trip": traced + "SELECT id, CAST(kind AS INTEGER) AS type, x, y, z, r, coalesce(parent, -1) AS parent FROM traced",
    }
