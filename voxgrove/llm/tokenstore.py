"""Token-id store: Re-Pair grammars per block of a range-partitioned, ordered corpus.

``write_tokens`` deals documents by range of doc_id, encodes them, and writes blocks of about
``BLOCK_IDS`` ids as Parquet rows, so that Spark commits them on any store. A block's payload
holds doc ids and lengths, and a grammar: rounds of nonterminals, each round replacing the
frequent neighbouring pairs without overlap, and the symbols left, with expansion lengths.
``read_tokens`` gives the documents back with their place in the whole; ``ids_between`` expands
only the symbols that a range of ids touches.

Documents with a null or empty text have only the end id. Rows are ordered by doc_id, null
ids first, then by a hash of the text; equal rows repeat. Other columns are ignored. An empty table gives none.
A document is never cut: one longer than a block is a block of its own.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pack, partitions, scratch_dir, ship, unpack
from .library import by_size, encoder

BLOCK_IDS = 1 << 20
#: Rounds of replacing, pairs replaced in a round, least count of such a pair, least gain of a round:
#: defaults of ``compress``, whose README figures say what they leave uncompressed.
ROUNDS, PAIRS, LEAST, GAIN = 6, 4096, 12, 0.02
BLOCKS = "shard int, block int, start long, n_tokens long, payload binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def compress(ids: np.ndarray, rounds_most: int | None = ROUNDS, pairs_most: int | None = PAIRS, least: int = LEAST, gain: float = GAIN) -> tuple[np.ndarray, list[np.ndarray]]:
    """(symbols, rounds): a round is its pairs' left and right symbols; numbers go on from
    ``base``, the first number that is no id. Without bounds (None, None, gain 0) rounds go on until no
    pair occurs ``least`` times; the bounds trade size for time, and any of them decodes exactly."""
    seq = ids.astype(np.int64)
    nxt, rounds = (int(seq.max()) + 1 if len(seq) else 0), []
    while rounds_most is None or len(rounds) < rounds_most:
        if len(seq) < 2:
            break
        # pairs as one number, half as wide while the symbols allow it
        bits, kind = (16, np.uint32) if nxt <= 1 << 16 else (32, np.uint64)
        narrow = seq.astype(kind)
        keys = narrow[:-1] << kind(bits) | narrow[1:]
        s = np.sort(keys)
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        count = np.diff(np.r_[first, len(s)])
        often = np.flatnonzero(count >= least)
        if pairs_most and len(often) > pairs_most:
            often = often[np.argsort(-count[often], kind="stable")[:pairs_most]]
        if not len(often):
            break
        pairs = np.sort(s[first[often]])
        lefts, rights = (pairs >> kind(bits)).astype(np.int64), (pairs & kind((1 << bits) - 1)).astype(np.int64)
        # a small table of (left symbol, right symbol) says which pair stands at a place
        ls, rs = np.unique(lefts), np.unique(rights)
        row, col = np.zeros(nxt, np.int32), np.zeros(nxt, np.int32)
        row[ls], col[rs] = np.arange(1, len(ls) + 1), np.arange(1, len(rs) + 1)
        which = np.full((len(ls) + 1) * (len(rs) + 1), -1, np.int32)
        which[row[lefts] * (len(rs) + 1) + col[rights]] = np.arange(len(pairs))
        where = which[row[seq[:-1]] * np.int32(len(rs) + 1) + col[seq[1:]]]
        at = np.flatnonzero(where >= 0)
        where = where[at]
        # of places in a row, every other one from the first on
        begins = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        take = (np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))) % 2 == 0
        at, where = at[take], where[take]
        if len(at) < gain * len(seq) or not len(at):
            break
        seq[at] = nxt + where
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        rounds.append(np.stack([lefts, rights]))
        nxt += len(pairs)
    return seq, rounds


def lengths(base: int, rounds: list[np.ndarray]) -> np.ndarray:
    """The number of ids that each symbol stands for."""
    n = np.ones(base, np.int64)
    for pairs in rounds:
        n = np.r_[n, n[pairs[0]] + n[pairs[1]]]
    return n


def expand(seq: np.ndarray, base: int, rounds: list[np.ndarray]) -> np.ndarray:
    """Undo the rounds, last first."""
    tops = np.cumsum([base, *(r.shape[1] for r in rounds)])
    for low, pairs in zip(tops[-2::-1], rounds[::-1], strict=True):
        new = seq >= low
        at = np.arange(len(seq)) + np.cumsum(new) - new
        out = np.empty(len(seq) + int(new.sum()), np.int64)
        out[at] = seq
        out[at[new]] = pairs[0][seq[new] - low]
        out[at[new] + 1] = pairs[1][seq[new] - low]
        seq = out
    return seq


def to_payload(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, **bounds) -> bytes:
    seq, rounds = compress(ids, **bounds)
    base = int(ids.max()) + 1 if len(ids) else 0
    none = [i for i, d in enumerate(doc_ids) if d is None]
    spread = lengths(base, rounds)[base:]
    parts = [np.array([0 if d is None else d for d in doc_ids]), np.array(none), np.array(sizes), np.array([base, *(r.shape[1] for r in rounds)]), np.concatenate([np.zeros(0, np.int64), *(r.ravel() for r in rounds)]), spread, seq]
    packed = [pack(p) for p in parts]
    return b"".join(len(p).to_bytes(8, "little") + p for p in packed)


class Block:
    """A payload opened: documents, and ids of any range."""

    def __init__(self, payload: bytes):
        parts, at = [], 0
        while at < len(payload):
            n = int.from_bytes(payload[at : at + 8], "little")
            parts.append(unpack(payload[at + 8 : at + 8 + n]))
            at += 8 + n
        ids, none, self.sizes, heads, flat, spread, self.seq = parts
        self.doc_ids = ids.tolist()
        for i in none:
            self.doc_ids[i] = None
        self.base, *counts = heads.tolist()
        cuts = np.cumsum([0, *(2 * c for c in counts)])
        self.rounds = [flat[a:b].reshape(2, -1) for a, b in itertools.pairwise(cuts)]
        self.ends = np.cumsum(np.r_[np.ones(self.base, np.int64), spread][self.seq])

    def ids(self) -> np.ndarray:
        return expand(self.seq, self.base, self.rounds)

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the symbols that reach into that range alone."""
        if stop <= start:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(self.ends, [start, stop - 1], side="right")
        before = int(self.ends[a - 1]) if a else 0
        return expand(self.seq[a : b + 1], self.base, self.rounds)[start - before : stop - before]


def write_tokens(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 1, **bounds) -> str:
    """Write the store and return its folder, by default one in the shared folder; ``bounds`` are those
    of ``compress``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    path = path or f"{scratch_dir(spark)}/voxgrove-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"

    def run(batches):
        encode, shard = encoder(vocabulary).column, TaskContext.get().partitionId()
        block = start = held = 0
        names, sizes, kept = [], [], []

        def flush():
            nonlocal block, start, held, names, sizes, kept
            ids = np.concatenate(kept).astype(np.int64)
            row = [[shard], [block], [start], [len(ids)], [to_payload(names, sizes, ids, **bounds)]]
            block, start, held, names, sizes, kept = block + 1, start + len(ids), 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "block", "start", "n_tokens", "payload"])

        for own, texts in by_size(batches):
            for d, ids in zip(own.to_pylist(), encode(texts), strict=True):
                if held and held + len(ids) >= BLOCK_IDS:
                    yield flush()
                names.append(d)
                sizes.append(len(ids) + 1)
                kept += [ids, np.array([end_id], ids.dtype)]
                held += len(ids) + 1
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # rows of one doc_id, or of none, are dealt by their texts
    place = F.xxhash64("text")
    rows = rows.repartitionByRange(partitions(spark), F.col("doc_id"), place).sortWithinPartitions("doc_id", place, "text")
    map_batches(rows, run, BLOCKS).write.mode("overwrite").parquet(path)
    return path


def placed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base``, the ids of all shards before; what is collected is one number
    for each shard, and a shard is a partition of the writing."""
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = sorted(blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before = list(itertools.accumulate((r["n"] for r in sums), initial=0))
    bases = spark.createDataFrame([(r["shard"], b) for r, b in zip(sums, before, strict=False)], "shard int, base long")
    return blocks.join(F.broadcast(bases), "shard")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a store."""

    def run(batches):
        for b in batches:
            for start, base, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                block = Block(payload)
                at = np.r_[0, np.cumsum(block.sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(at[:-1] + start + base), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(block.ids().astype(np.int32)))], ["doc_id", "start", "ids"])

    return placed_blocks(spark, path).select("start", "base", "payload").mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches):
        for b in batches:
            for start, base, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                block = Block(payload)
                at = np.r_[0, np.cumsum(block.sizes)]
                raw = memoryview(block.ids().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in itertools.pairwise(at.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(at[:-1] + start + base), pa.array(block.sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed_blocks(spark, path).select("start", "base", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
