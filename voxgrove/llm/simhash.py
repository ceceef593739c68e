"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into ``blocks`` blocks. Two fingerprints that differ in
at most ``bound`` bits agree in at least ``blocks - bound`` whole blocks, so every pair
within the bound meets under at least one combination of that many blocks. Distinct
fingerprints are joined on (combination, its bits) and the Hamming distance is verified
inside the join; a pair is kept at the first combination it shares, once. Only pairs of
distinct fingerprints are made; copies are members of a fingerprint class.

A combination's bits that more than ``CROWD`` fingerprints share are not joined: their
fingerprints are dealt into lots of ``LOT``, each two lots meet in one task, and what leaves
the task is a spanning forest of the links, not all of them. Work there grows with the square of
such a group's distinct fingerprints at worst; nothing is left out.

Similar documents. Texts whose word shingles have a Jaccard similarity of 0.8 differ in 15 of 100
bits, too many for whole blocks of 64 bits to agree for certain. ``keep_one`` therefore takes
several fingerprints, one after another, cuts them into ``share_plan`` blocks, as many as it takes for
``RECALL`` of the pairs at that similarity to share one, and verifies the Hamming distance over
all bits, with one standard deviation of slack. Similarity is what these bits say it is.

Nulls and empty texts have no words: fingerprint zero, linked like any other. Rows are linked by
their fingerprints alone: rows of one doc_id with different texts may lie in different groups,
and rows without doc_id are linked too (their group's number is the smallest doc_id in it, null
if it has none). An empty table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, partitions, release, row_key, saved, spread, words_of

SHINGLE, SEED, BOUND = 3, 42, 3
#: Fingerprints that share a block's bits and are joined as rows at most; a lot of larger groups.
CROWD, LOT = 256, 2048
#: Share of pairs at the asked similarity that meet in a block; bits of a block at least.
RECALL, WIDTH = 0.9, 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 of all word shingles, repeats included."""
    return int(wide_fingerprint(text, shingle, 1)[0])


def wide_fingerprint(text: str | None, shingle: int, many: int) -> np.ndarray:
    """That fingerprint, and further ones of the hashes mixed anew."""
    w = words_of(text)
    if not w:
        return np.zeros(many, np.uint64)
    parts = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in parts), dtype="<u8")
    out = np.zeros(many, np.uint64)
    for k in range(many):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
        if k + 1 < many:
            h = spread(h + np.uint64(k + 1))
    return out


def columns(many: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, many))]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, many: int = 1) -> DataFrame:
    """(doc_id, d, row, fp, fp1, ...): the row's key, and its fingerprints as signed longs. No shuffle."""
    names = columns(many)

    def run(batches):
        for b in batches:
            fp = np.array([wide_fingerprint(t, shingle, many) for t in b.column(3).to_pylist()], np.uint64).reshape(-1, many).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(many))], ["doc_id", "d", "row", *names])

    return map_batches(docs.select(F.col("doc_id").cast("long"), *row_key(), F.col("text").cast("string")), run, "doc_id long, d long, row long, " + ", ".join(f"{c} long" for c in names))


def block_count(n: int, bound: int = BOUND) -> int:
    """Blocks for n fingerprints: the shared bits grow with n, so that buckets stay small."""
    blocks = bound + 2
    while blocks < bound + 5 and 64 * (blocks - bound) // blocks < np.log2(max(n, 2)):
        blocks += 1
    return blocks


def share_plan(n: int, similarity: float) -> tuple[int, int, int]:
    """(fingerprints, bits of a block, bound) for n documents: blocks as wide as keeps groups small, and
    as many as ``RECALL`` asks for; the bits in which pairs at the similarity differ, and one
    standard deviation more."""
    part = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    width = max(WIDTH, math.ceil(math.log2(max(n, 2))) - 2)
    blocks = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - part) ** width)) if part else 1
    many = -(-blocks // (64 // width))
    return many, width, round(64 * many * part + math.sqrt(64 * many * part * (1 - part)))


def near_pairs(fps: DataFrame, bound: int = BOUND, blocks: int | None = None, crowd: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct longs ``fp`` with 1 to ``bound`` differing bits: all of them
    outside of crowded groups, and enough to join all that belong together within those."""
    blocks = blocks or block_count(fps.count(), bound)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in c) for c in combinations(range(blocks), blocks - bound)]
    return _links(fps.select(F.col("fp").alias("id"), "fp"), 1, [(0, m - (1 << 64) if m >> 63 else m) for m in masks], bound, crowd or CROWD)


def similar_pairs(classes: DataFrame, many: int, width: int, bound: int, crowd: int | None = None) -> DataFrame:
    """The same of (id, fp, fp1, ...) that share one block of ``width`` bits at least."""
    masks = [(k, ((1 << width) - 1) << width * i) for k in range(many) for i in range(64 // width)]
    return _links(classes, many, [(k, m - (1 << 64) if m >> 63 else m) for k, m in masks], bound, crowd or CROWD)


def _links(classes: DataFrame, many: int, masks: list[tuple[int, int]], bound: int, crowd: int) -> DataFrame:
    names = columns(many)
    block = F.array(*[F.col(names[k]).bitwiseAND(F.lit(m)) for k, m in masks])
    keyed = classes.select("id", *names, F.posexplode(block).alias("k", "bits"))
    large = saved(keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "simhash-crowd")
    some = bool(large.head(1))
    few = keyed.join(large.select("k", "bits"), ["k", "bits"], "left_anti") if some else keyed
    a, b = (few.select("k", "bits", F.col("id").alias(x), *(F.col(c).alias(x + c) for c in names)) for x in "ab")
    differ = [F.col("a" + c).bitwiseXOR(F.col("b" + c)) for c in names]
    # where the first block that a pair shares is a crowded one, the forests join the pair
    first = F.coalesce(*[F.when(differ[k].bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, (k, m) in enumerate(masks)])
    near = a.join(b, ["k", "bits"]).where((F.col("a") < F.col("b")) & (sum((F.bit_count(x) for x in differ), F.lit(0)) <= bound) & (first == F.col("k"))).select("a", "b")
    return near.unionByName(_forests(keyed.join(large, ["k", "bits"]), names, bound)).distinct() if some else near


def _forests(crowded: DataFrame, names: list[str], bound: int) -> DataFrame:
    """Links (a, b) that join all of each (k, bits) group's fingerprints that links join: its lots
    in pairs."""
    n = F.ceil(F.col("n") / LOT)
    own = crowded.select("k", "bits", "id", *names, n.alias("s"), F.pmod(F.xxhash64("id"), n).alias("x"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("y"))
    group = F.xxhash64("k", "bits", F.least("x", "y"), F.greatest("x", "y")).alias("key")
    # groups with equal hashes would only be compared with each other too
    rows = dealt.select(group, "id", *names)

    def run(batches):
        key, held = None, []
        for b in batches:
            for k, *r in zip(*(b.column(i).to_pylist() for i in range(2 + len(names))), strict=True):
                if k != key and held:
                    yield spanning(np.array(held, np.int64), bound)
                    held = []
                key = k
                held.append(r)
        if held:
            yield spanning(np.array(held, np.int64), bound)

    shape = rows.repartition(partitions(crowded.sparkSession), "key").sortWithinPartitions("key", "id")
    return shape.mapInArrow(run, "a long, b long")


def spanning(rows: np.ndarray, bound: int) -> pa.RecordBatch:
    """A spanning forest (a, b) of the links of up to a few thousand rows (id, fingerprints): each one
    not yet reached starts a search that compares with those not yet reached."""
    x = np.unique(rows, axis=0)
    ids, left = x[:, 0], np.arange(len(x))
    x = np.ascontiguousarray(x[:, 1:]).view(np.uint64)
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(x[left] ^ x[i]).sum(1, dtype=np.int64) <= bound
            hit = left[near]
            left = left[~near]
            todo += hit.tolist()
            a += [ids[i]] * len(hit)
            b += ids[hit].tolist()
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _named(classes: DataFrame, pairs: DataFrame, names: list[str]) -> DataFrame:
    """(fp, ..., component_id, d0, row0) of every class (id, fp, ..., low, first): the smallest doc_id of its
    group, and the key of the group's first row."""
    comp = components(pairs, "simhash-link").withColumnRenamed("component_id", "comp")
    named = saved(classes.join(comp, "id", "left").select(*names, F.coalesce("comp", "id").alias("comp"), "low", "first"), "simhash-named")
    of = named.groupBy("comp").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    out = saved(named.select("comp", *names).join(of, "comp").select(*names, "component_id", F.col("first.d").alias("d0"), F.col("first.row").alias("row0")), "simhash-comp")
    release(named)
    return out


def _classes(fps: DataFrame, names: list[str]) -> DataFrame:
    ident = F.col("fp") if len(names) == 1 else F.xxhash64(*names)
    return saved(fps.groupBy(*names).agg(F.min("doc_id").alias("low"), F.min(F.struct("d", "row")).alias("first")).select(ident.alias("id"), *names, "low", "first"), "simhash-class")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bound: int = BOUND) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links."""
    fps = saved(fingerprints(docs, shingle), "simhash-fp")
    classes = _classes(fps, ["fp"])
    of = _named(classes, near_pairs(classes.select("fp"), bound), ["fp"])
    return fps.join(of.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of similar documents: the first by doc_id (none before all),
    then by a hash of the text. Of rows equal in both, the one with the least hash of its columns stays.

    Only the keys that go, and the rows of repeated keys, are joined, so that the texts are not
    shuffled while those are few.
    """
    many, width, bound = share_plan(docs.count(), similarity)
    names = columns(many)
    fps = saved(fingerprints(docs, shingle, many), "simhash-fp")
    classes = _classes(fps, names)
    of = _named(classes, similar_pairs(classes.select("id", *names), many, width, bound), names)
    gone = saved(fps.join(of, names).where("d <> d0 OR row <> row0").select("d", "row").distinct(), "simhash-gone")
    twice = saved(fps.select("d", "row").join(gone, ["d", "row"], "left_anti").groupBy("d", "row").count().where("count > 1").select("d", "row"), "simhash-twice")
    release(fps)
    rows = docs.select(F.struct("*").alias("_doc"), *row_key()).join(gone, ["d", "row"], "left_anti")
    if not twice.head(1):
        return rows.select("_doc.*")
    one = rows.join(twice, ["d", "row"], "left_semi").groupBy("d", "row").agg(F.min_by("_doc", F.xxhash64(F.to_json("_doc"))).alias("_doc"))
    return rows.join(twice, ["d", "row"], "left_anti").unionByName(one.select("_doc", "d", "row")).select("_doc.*")
