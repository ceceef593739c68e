"""The tracing engine on hand-made volumes and against plain Python."""

import heapq
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxgrove.functions.costs import cost_rows, cost_table
from voxgrove.operators import distance, queue, skeleton, stencil, tracing, voxels
from voxgrove.plans import catalog, trace
from voxgrove.plans.fixpoint import components, relax, stars
from voxgrove.sources.swc import read_swc, swc_lines, write_swc
from voxgrove.sources.volume import decode_tiff, from_dense, read_tiff, unpack_lzw, write_tiff


def _volume(points, shape=(5, 5, 5), v=200):
    a = np.zeros(shape, np.uint8)
    for z, y, x in points:
        a[z, y, x] = v
    return a


LINE = [(2, 2, x) for x in range(5)]
Y = LINE + [(2, 1, 3), (2, 0, 4)]
RING = [(2, 1, 1), (2, 1, 2), (2, 1, 3), (2, 2, 3), (2, 3, 3), (2, 3, 2), (2, 3, 1), (2, 2, 1)]
BLOBS = [(0, 0, 0), (0, 0, 1), (4, 4, 4), (4, 4, 3)]


def _tree_ok(rows):
    ids = {r["id"]: r for r in rows}
    assert sorted(ids) == list(range(1, len(rows) + 1))
    for r in rows:
        seen, at = set(), r
        while at["parent"] is not None:
            assert at["id"] not in seen
            seen.add(at["id"])
            up = ids[at["parent"]]
            assert max(abs(at[c] - up[c]) for c in "xyz") == 1
            at = up


@pytest.mark.parametrize("points, roots", [(LINE, 1), (RING, 1), (BLOBS, 2), ([(2, 2, 2)], 1)])
def test_traces_small_shapes(spark, points, roots):
    rows = trace.trace(from_dense(spark, "a", _volume(points)), threshold=200, min_nodes=1).collect()
    assert sorted((r["z"], r["y"], r["x"]) for r in rows) == sorted(points)
    assert sum(r["parent"] is None for r in rows) == roots
    _tree_ok(rows)


def test_several_images_in_one_job_and_pruning(spark):
    vol = from_dense(spark, "a", _volume(Y)).unionByName(from_dense(spark, "b", _volume(BLOBS)))
    got = trace.trace(vol, threshold=200, min_nodes=3).groupBy("image_id").count().collect()
    assert {r["image_id"] for r in got} == {"a"}


def test_empty_volume(spark):
    none = from_dense(spark, "a", _volume([(1, 1, 1)])).where("v > 250")
    assert trace.trace(none, threshold=1).count() == 0


def test_threshold_is_inclusive_and_rows_do_not_wrap(spark):
    v = from_dense(spark, "a", _volume([(0, 0, 4), (0, 1, 0)], v=100))
    assert voxels.global_threshold(v, 100).count() == 2 and voxels.global_threshold(v, 101).count() == 0
    assert stencil.neighbours(v, stencil.OFFSETS26).count() == 0


def test_cost_table(spark):
    assert cost_table()[255] == 1000 and len(cost_table()) == 256 and cost_rows(spark).count() == 256


def _random(spark, n=150, seed=1):
    r = random.Random(seed)
    a = np.zeros((4, 8, 8), np.uint8)
    for _ in range(n):
        a[r.randrange(4), r.randrange(8), r.randrange(8)] = r.randint(1, 255)
    return from_dense(spark, "a", a)


def test_marching_and_forest_equal_dijkstra(spark):
    fg = _random(spark)
    e = stencil.edges26(fg)
    seeds = tracing.poisson_seeds(fg, 2)
    labels = tracing.fast_marching(e, seeds)
    adj = {}
    for r in e.collect():
        adj.setdefault(r["src"], []).append((r["dst"], r["w"]))
    best, heap = {}, [(0, r["seed_id"], r["idx"]) for r in seeds.collect()]
    heapq.heapify(heap)
    while heap:
        d, s, u = heapq.heappop(heap)
        if u not in best:
            best[u] = d, s
            for v, w in adj.get(u, []):
                heapq.heappush(heap, (d + w, s, v))
    assert {r["idx"]: (r["dist"], r["seed_id"]) for r in labels.collect()} == best
    for r in tracing.parent_forest(e, labels).collect():
        if r["parent_idx"] is not None:
            w = dict(adj[r["parent_idx"]])[r["idx"]]
            assert best[r["parent_idx"]] == (r["dist"] - w, r["seed_id"])


@pytest.mark.parametrize("side", [2, 3])
def test_tiles_do_not_change_results(spark, side, monkeypatch):
    fg = _random(spark, 170, 3)
    want = None
    for n in (100, side):
        e = stencil.edges26(fg) if n == 100 else stencil.edges26(fg).withColumn("ts", F.floor(F.col("src") / 7 / side)).withColumn("td", F.floor(F.col("dst") / 7 / side))
        seeds = tracing.poisson_seeds(fg, 2)
        got = ({tuple(r) for r in tracing.fast_marching(e, seeds).collect()}, {tuple(r) for r in tracing.voxel_components(e, fg).collect()})
        want = want or got
        assert got == want


def test_rounds_that_run_out_are_an_error(spark):
    line = [("a", i, i + 1, 1, i, i + 1) for i in range(12)]
    e = spark.createDataFrame(line, "image_id string, src long, dst long, w long, ts long, td long")
    start = spark.createDataFrame([("a", 0, 0, 0), ("a", 99, 0, 5)], "image_id string, idx long, dist long, label long")
    got = {r["idx"]: (r["dist"], r["label"]) for r in relax(e, start, "t").collect()}
    assert got == {**{i: (i, 0) for i in range(13)}, 99: (0, 5)}
    with pytest.raises(RuntimeError):
        relax(e, start, "t", rounds=3)
    with pytest.raises(RuntimeError):
        stars(e.selectExpr("image_id", "src a", "dst b"), "t", rounds=1)
    assert stars(e.where("src < 0").selectExpr("image_id", "src a", "dst b"), "t").count() == 0


def test_refining_drops_twigs_within_their_branch(spark):
    vox = from_dense(spark, "a", np.full((1, 9, 9), 200, np.uint8))
    at = lambda x, y: 9 * y + x
    rows = [("a", at(x, 4), at(8, 4), x, None) for x in range(9)]  # the trunk, chain named by its leaf
    rows += [("a", at(4, y), at(4, y0), 0, at(4, 4)) for y0, ys in ((6, (5, 6)), (0, (3, 2, 1, 0))) for y in ys]
    rows += [("a", at(5, 6), at(5, 6), 0, at(4, 6))]  # hangs on a twig that goes
    chains = spark.createDataFrame(rows, "image_id string, idx long, chain_id long, pos int, after long")
    radii = vox.select("image_id", "idx", F.lit(2).alias("radius"))
    assert {r["chain_id"] for r in skeleton.refine(chains, vox, radii).collect()} == {at(8, 4), at(4, 0)}
    assert skeleton.refine(chains, vox, radii.withColumn("radius", F.lit(0))).count() == len(rows)


def test_packed_parents(spark):
    fg = from_dense(spark, "a", _volume(Y))
    _, _, forest = trace.marched(fg)
    back = stencil.decode_parents(stencil.encode_parents(forest, fg))
    key = lambda df: sorted(map(tuple, df.select("idx", "parent_idx").collect()), key=repr)
    assert key(back) == key(forest)


def test_spanning_forest_equals_kruskal(spark):
    r = random.Random(2)
    cand = {}
    for k in range(60):
        s, t = sorted(r.sample(range(20), 2))
        cand[s, t] = (r.randint(1, 5), k, k + 1000)
    df = spark.createDataFrame([("a", s, t, *c) for (s, t), c in cand.items()], "image_id string, s long, t long, cost long, a long, b long")
    up = list(range(20))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    want = set()
    for (s, t), _ in sorted(cand.items(), key=lambda e: e[1]):
        if find(s) != find(t):
            up[find(s)] = find(t)
            want.add((s, t))
    assert {(x["s"], x["t"]) for x in tracing.spanning_forest(df).collect()} == want


def test_poisson_seeds_do_not_depend_on_partitions(spark):
    fg = _random(spark)
    one = {r["idx"] for r in tracing.poisson_seeds(fg.coalesce(1), 1).collect()}
    many = {r["idx"] for r in tracing.poisson_seeds(fg.repartition(7), 1).collect()}
    rank = lambda i: ((i * 2654435761) % 4294967296, i)
    at = {r["idx"]: (r["x"], r["y"], r["z"]) for r in fg.collect()}
    greedy = []
    for i in sorted(at, key=rank):
        if all(max(abs(a - b) for a, b in zip(at[i], at[j], strict=True)) > 1 for j in greedy):
            greedy.append(i)
    assert one == many == set(greedy)


def test_chains_start_at_leaves_and_take_the_longest_way(spark):
    fg = from_dense(spark, "a", _volume(Y))
    edges, labels, forest = trace.marched(fg)
    mst = tracing.spanning_forest(tracing.merge_candidates(edges, labels))
    tree = skeleton.reroot(forest, mst, skeleton.segment_components(labels, mst))
    rows = skeleton.chains(tree, fg).collect()
    leaves = {r["idx"] for r in skeleton.leaves(tree).collect()}
    assert {r["chain_id"] for r in rows} == leaves and sum(r["after"] is None and r["parent_idx"] is None for r in rows) == 1
    by = {}
    for r in rows:
        by.setdefault(r["chain_id"], []).append(r["pos"])
    assert all(sorted(p) == list(range(len(p))) for p in by.values())


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([("a", i, i + 1) for i in range(200)], "image_id string, src long, dst long")
    nodes = spark.range(201).select(F.lit("a").alias("image_id"), F.col("id").alias("idx"))
    assert components(e, nodes, "t").select("comp").distinct().collect()[0]["comp"] == 0


def test_radius_and_distance(spark):
    a = np.full((7, 7, 7), 100, np.uint8)
    fg = from_dense(spark, "a", a)
    mid = (3 * 7 + 3) * 7 + 3
    assert {r["idx"]: r["radius"] for r in distance.radius_by_ball(fg).collect()}[mid] == 3
    assert {r["idx"]: r["radius"] for r in distance.radius_by_steps(fg).collect()}[mid] == 3
    assert {r["idx"]: r["gwdt"] for r in distance.grey_weighted(fg).collect()}[mid] == 300_000


def test_radius_beyond_the_first_round(spark):
    a = np.full((13, 14, 15), 100, np.uint8)
    a[2, 3, 11] = 0
    got = {r["idx"]: r["radius"] for r in distance.radius_by_ball(from_dense(spark, "a", a)).collect()}
    for z, y, x in np.argwhere(a > 0):
        r = 0
        while True:
            b = stencil.ball(r + 1)
            full = sum(0 <= z + k < 13 and 0 <= y + j < 14 and 0 <= x + i < 15 and a[z + k, y + j, x + i] > 0 for i, j, k in b)
            if 1000 * (len(b) - full) > len(b) + 1:
                break
            r += 1
        assert got[(z * 14 + y) * 15 + x] == r
    assert max(got.values()) == 6 and len(got) == 13 * 14 * 15 - 1


def test_scan_scatter_queue(spark):
    rows = spark.createDataFrame([("a", i, i % 3) for i in range(10)], "g string, i long, v long")
    got = [r["scan"] for r in voxels.prefix_sum(rows, F.col("v"), ["g"], "i", False, 4).orderBy("i").collect()]
    assert got == [0, 0, 1, 3, 3, 4, 6, 6, 7, 9]
    assert queue.least(rows, ["v"], "g", "i").orderBy("v").select("i").collect() == [(0,), (1,), (2,)]
    q = queue.IndexedQueue()
    for i, k in ((5, 2), (3, 2), (9, 1), (9, 7)):
        q.put(i, k)
    assert [q.take() for _ in range(4)] == [(2, 3), (2, 5), (7, 9), None] and len(q) == 0


def _tiff(pages, order="<"):
    out, n = bytearray(b"II*\0" if order == "<" else b"MM\0*"), len(pages)
    out += struct.pack(f"{order}I", 8)
    for k, p in enumerate(pages):
        h, w = p.shape
        data = p.astype(f"{order}u{p.dtype.itemsize}").tobytes()
        tags = [(256, 3, w), (257, 3, h), (258, 3, 8 * p.dtype.itemsize), (259, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, h), (279, 4, len(data))]
        at = len(out) + 2 + 12 * len(tags) + 4
        out += struct.pack(f"{order}H", len(tags))
        for t, kind, v in tags:
            v = at if t == 273 else v
            out += struct.pack(f"{order}HHI", t, kind, 1) + (struct.pack(f"{order}HH", v, 0) if kind == 3 else struct.pack(f"{order}I", v))
        out += struct.pack(f"{order}I", at + len(data) if k + 1 < n else 0) + data
    return bytes(out)


@pytest.mark.parametrize("order, kind", [("<", np.uint8), (">", np.uint16)])
def test_tiff_file_and_folder_to_swc(spark, tmp_path, order, kind):
    scale = 1 if kind == np.uint8 else 256
    for name, points in (("a", LINE), ("b", Y)):
        (tmp_path / f"{name}.tif").write_bytes(_tiff([p.astype(kind) * scale for p in _volume(points)], order))
    assert read_tiff(spark, str(tmp_path / "a.tif")).where("v = 200 AND depth = 5").count() == 5
    out = str(tmp_path / "out")
    swc = trace.trace_path(spark, str(tmp_path), out, threshold=100, min_nodes=1)
    back = read_swc(spark, f"{out}/b.tif_trace.swc")
    assert back.count() == 7 == swc.where("image_id = 'b.tif'").count() and back.where("parent = -1").count() == 1


def _pack_bits(raw):
    out, at = bytearray(), 0
    while at < len(raw):
        n = 1
        while at + n < len(raw) and raw[at + n] == raw[at] and n < 128:
            n += 1
        if n > 1:
            out += bytes([257 - n, raw[at]])
        else:
            out += bytes([0, raw[at]])
        at += n
    return bytes(out) + b"\x80"


def _lzw(raw):
    table, held, bits, width, word, codes = {bytes([i]): i for i in range(256)}, 0, 0, 9, b"", []
    n, out = 258, bytearray()

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> (bits - 8) & 255)
            bits -= 8
            held &= (1 << bits) - 1

    put(256)
    for b in raw:
        b = bytes([b])
        if word + b in table:
            word += b
            continue
        put(table[word])
        table[word + b] = n
        n += 1
        if n == 4094:
            width = 12
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        word = b
    if word:
        put(table[word])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


PACK = {1: bytes, 5: _lzw, 8: zlib.compress, 32773: _pack_bits}


def _odd_tiff(page, compression, tile=None, big=False, predictor=1, samples=1):
    """One page: strips of 5 rows or tiles, classic or big."""
    h, w = page.shape[:2]
    page = page.reshape(h, w, samples)
    th, tw = tile or (5, w)
    blocks = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            b = np.zeros((th, tw, samples), page.dtype)
            cut = page[y : y + th, x : x + tw]
            b[: cut.shape[0], : cut.shape[1]] = cut
            b = b if tile else b[: min(th, h - y)]
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((b.shape[0], 1, samples), b.dtype))
            blocks.append(PACK[compression](b.tobytes()))
    word = "Q" if big else "I"
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    tags = [(256, [w]), (257, [h]), (258, [8 * page.dtype.itemsize] * samples), (259, [compression]), (277, [samples]), (278, [th]), (317, [predictor])]
    tags += [(322, [tw]), (323, [th])] if tile else []
    first, second = (324, 325) if tile else (273, 279)
    size = len(head) + (8 if big else 2) + (20 if big else 12) * (len(tags) + 2) + struct.calcsize(word)
    arrays = bytearray()
    base = size + 2000
    starts = [base + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    tags += [(first, starts), (second, [len(b) for b in blocks])]
    out = bytearray(head) + struct.pack("<Q" if big else "<H", len(tags))
    for t, v in tags:
        raw = struct.pack(f"<{len(v)}{word}", *v)
        if len(v) == 1:
            field = raw
        else:
            field = struct.pack(f"<{word}", size + len(arrays))
            arrays += raw
        out += struct.pack(f"<HH{word}", t, 16 if big else 4, len(v)) + field
    out += struct.pack(f"<{word}", 0)
    assert len(out) == size and len(arrays) <= 2000
    return bytes(out) + bytes(arrays).ljust(2000, b"\0") + b"".join(blocks)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("tile, big, predictor, samples, kind", [(None, False, 1, 1, np.uint8), ((16, 16), False, 2, 1, np.uint8), (None, True, 2, 1, np.uint16), ((16, 32), True, 1, 3, np.uint8)])
def test_tiff_layouts(compression, tile, big, predictor, samples, kind):
    r = np.random.RandomState(compression)
    page = (r.randint(0, 4, (23, 41, samples)) * r.randint(0, 60, (23, 41, samples))).astype(kind)
    page[3:9] = 7
    ((got, bits),) = decode_tiff(_odd_tiff(page, compression, tile, big, predictor, samples))
    assert bits == 8 * np.dtype(kind).itemsize and np.array_equal(got, page.max(2))


def test_long_lzw_strips_and_refused_pages():
    raw = np.random.RandomState(1).randint(0, 200, 30000).astype(np.uint8).tobytes()
    assert unpack_lzw(_lzw(raw)) == raw and unpack_lzw(_lzw(b"a" * 5000)) == b"a" * 5000
    for bad in (b"", b"PNG", _odd_tiff(np.zeros((3, 3), np.uint32), 1)):
        with pytest.raises(ValueError):
            list(decode_tiff(bad))


def test_written_stacks_and_command_line(spark, tmp_path, capsys):
    a = np.random.RandomState(2).randint(0, 3, (4, 70, 9)).astype(np.uint8) * 90
    vol = from_dense(spark, "a.tif", a).unionByName(from_dense(spark, "b", np.full((1, 1, 40), 200, np.uint8)))
    write_tiff(vol, str(tmp_path / "in"))
    pages = [p for p, _ in decode_tiff((tmp_path / "in/a.tif").read_bytes())]
    assert np.array_equal(np.stack(pages), a)
    assert read_tiff(spark, [str(tmp_path / "in/b.tif")]).count() == 40
    trace.main([str(tmp_path / "in" / "b.tif"), "100", "0", str(tmp_path / "out")])
    assert "march" in capsys.readouterr().out and (tmp_path / "out" / "b.tif_trace.swc").is_file()


def test_swc_dialects(spark, tmp_path):
    (tmp_path / "t.swc").write_text("#name\n##n,type,x,y,z,radius,parent\n 1 -57 1.5 2 3 0.034 -1\n2 2  4 5 6 1 1\n\n")
    rows = read_swc(spark, str(tmp_path / "t.swc")).orderBy("id").collect()
    assert [(r["type"], r["r"], r["parent"]) for r in rows] == [(-57, 0.034, -1), (2, 1.0, 1)]
    df = spark.createDataFrame([("i", 1, 2, 3, 4, 5, 6, None), ("i", 2, 2, 3, 4, 6, 6, 1)], "image_id string, id int, type int, x int, y int, z int, r int, parent int")
    assert [r["line"] for r in swc_lines(df).orderBy("id").collect()] == ["1 2 3 4 5 6 -1", "2 2 3 4 6 6 1"]
    write_swc(df, str(tmp_path / "w"))


def test_stream_of_stacks(spark, tmp_path):
    from voxgrove.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(_tiff(list(_volume(LINE))))
    q = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), threshold=100, min_nodes=1)
    q.awaitTermination(120)
    assert read_swc(spark, str(tmp_path / "out/batch=0/a.tif_trace.swc")).count() == 5


SQL_NAMES = ["slice_profile", "auto_threshold", "local_threshold", "compact_lookup", "edge_cost", "prefix_sum", "extrema", "components", "gwdt", "radius_direct", "segments", "swc_round_trip", "tiff_round_trip"]


@pytest.mark.parametrize("name", SQL_NAMES)
def test_queries_equal_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{d}/lineitem.parquet')")
    df = catalog.queries()[name](spark, d)
    cols = sorted(df.columns)
    want = sorted(map(tuple, con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()), key=repr)
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == want
