"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents are encoded where they are read and packed among those of the same task: no text or
id is shuffled. In a group of pieces, best fit in descending length gives a first packing. While
it has more bins than a lower bound, documents move from the emptiest bin to others: moved,
exchanged one for one, one for two, or two for one, the largest gain first. Each step raises the sum
of squared fills, until the bin is empty or no step is left; then the next bin's turn comes. Pieces of
bins that stay emptier than ``OPEN`` are packed once more across tasks: in one task up to twice ``GROUP``.

Null or empty texts are one end id. Null doc_ids and repeated rows are packed as any other.
Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved
from .library import by_size, encoder

CAPACITY = 1024
#: Pieces that are packed together at most; fill under which a bin's pieces get a second chance.
GROUP, OPEN = 200_000, 1000 / 1024
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Bins of indices and the room left in each; longest first, each into the tightest bin."""
    bins, room = [], []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            bins[b].append(i)
            room[b] = r - n
        else:
            b = len(bins)
            bins.append([i])
            room.append(capacity - n)
        if room[b]:
            by_room[room[b]].append(b)
            mask |= 1 << room[b]
    return bins, room


def least_bins(sizes: list[int], capacity: int) -> int:
    """A bound that no packing is under. For each limit: pieces over half a bin have one each, those of
    the limit or more fill what is left in bins of pieces that leave so much, or bins of their own."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1)
    many, mass = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    limit = np.arange(half + 1)
    beside, held = many[capacity - limit] - many[half], mass[capacity - limit] - mass[half]
    small = mass[half] - np.where(limit > 0, mass[limit - 1], 0)
    more = -((beside * capacity - held - small) // capacity)
    return int(many[-1] - many[half] + max(0, more.max()))


class Index:
    """Bins by what can be taken back from them: no piece, one, or two, by their length in all; and
    for each of these by the bin's room. At most 45 lengths add up to 1024, so a bin has few."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.width = sizes, capacity + 1
        self.rooms = [[0] * self.width for _ in range(3)]  # bit r: some bin has room r
        self.reach = np.zeros((3, self.width), np.int64)  # length taken back, and the most room there
        self.bins: dict[int, set[int]] = {}

    def backs(self, pieces: list[int]) -> set[tuple[int, int]]:
        n = [self.sizes[i] for i in pieces]
        out = {(0, 0)} | {(1, a) for a in n}
        own = sorted(set(n))
        out.update((2, a + b) for k, a in enumerate(own) for b in own[k + 1 :])
        if len(own) < len(n):
            out.update((2, 2 * a) for a in own if n.count(a) > 1)
        return out

    def put(self, b: int, pieces: list[int], room: int) -> None:
        for k, t in self.backs(pieces) if room else ():
            at = (k * self.width + t) * self.width + room
            if at not in self.bins:
                self.bins[at] = set()
                self.rooms[k][t] |= 1 << room
                self.reach[k, t] = t + self.rooms[k][t].bit_length() - 1
            self.bins[at].add(b)

    def drop(self, b: int, pieces: list[int], room: int) -> None:
        for k, t in self.backs(pieces) if room else ():
            at = (k * self.width + t) * self.width + room
            self.bins[at].remove(b)
            if not self.bins[at]:
                del self.bins[at]
                self.rooms[k][t] ^= 1 << room
                left = self.rooms[k][t]
                self.reach[k, t] = t + left.bit_length() - 1 if left else 0

    def best(self, one: list[int], two: list[int]) -> tuple[int, int, int, int] | None:
        """(gain, pieces taken back, their length, bin): of all exchanges of one length of ``one`` for
        none, one or two pieces, or of ``two`` for one, the largest gain; then the bin it fills best."""
        gain, what = 0, None
        far = np.maximum.accumulate(self.reach, axis=1)
        for k, outs in ((0, one), (1, one), (2, one), (1, two)):
            if len(outs):
                # the least that can be taken back for each
                t = np.searchsorted(far[k], outs)
                gains = outs - t
                i = int(gains.argmax())
                if gains[i] > gain:
                    gain, what = int(gains[i]), (k, int(t[i]))
        if what is None:
            return None
        k, t = what
        fits = self.rooms[k][t] >> gain
        room = gain + (fits & -fits).bit_length() - 1
        return gain, k, t, next(iter(self.bins[(k * self.width + t) * self.width + room]))


def taken(pieces: list[int], sizes: list[int], k: int, total: int) -> list[int]:
    """k of the pieces whose lengths add up to the total."""
    if k < 2:
        return next(([i] for i in pieces if sizes[i] == total), []) if k else []
    seen: dict[int, int] = {}
    for i in pieces:
        if total - sizes[i] in seen:
            return [seen[total - sizes[i]], i]
        seen[sizes[i]] = i
    raise ValueError("no two pieces add up")


def local_search(bins: list[list[int]], room: list[int], sizes: list[int], capacity: int) -> None:
    """Empty bins, emptiest first, while there are more than ``least_bins``. The next step is the one of
    the largest gain into any fuller bin, a move, a swap of one for one, of one for two, or of two for
    one, so that each raises the sum of squared fills; what has no step left stays as it has become.
    Steps are looked up, not tried bin by bin, and are fewer than the tokens that bins have room for."""
    least = least_bins([sizes[i] for b in bins for i in b], capacity)
    used = sum(map(bool, bins))
    if used <= least:
        return
    order = sorted((b for b in range(len(bins)) if room[b]), key=lambda b: -room[b])
    index = Index(sizes, capacity)
    for b in order:
        index.put(b, bins[b], room[b])
    for frm in order:
        if used <= least:
            break
        index.drop(frm, bins[frm], room[frm])
        while bins[frm]:
            n = [sizes[i] for i in bins[frm]]
            one = sorted(set(n))
            two = {a + b for k, a in enumerate(one) for b in one[k + 1 :]} | {2 * a for a in one if n.count(a) > 1}
            found = index.best(np.array(one), np.array(sorted(two)))
            if not found:
                break
            gain, k, t, to = found
            index.drop(to, bins[to], room[to])
            back = taken(bins[to], sizes, k, t)
            out = taken(bins[frm], sizes, 1 if gain + t in one else 2, gain + t)
            bins[frm] = [i for i in bins[frm] if i not in out] + back
            bins[to] = [i for i in bins[to] if i not in back] + out
            room[frm] += gain
            room[to] -= gain
            index.put(to, bins[to], room[to])
        used -= not bins[frm]


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    bins, room = best_fit(sizes, capacity)
    local_search(bins, room, sizes, capacity)
    return [b for b in bins if b]


def placed(rows: list[tuple], first: int, capacity: int) -> tuple[list[tuple], int]:
    """Rows (doc_id, piece, start, length, crc) with sequence, offset and the sequence's fill."""
    out = []
    for b in pack_group([r[3] for r in rows], capacity):
        at, fill = 0, sum(rows[i][3] for i in b)
        for i in b:
            out.append((*rows[i], first, at, fill))
            at += rows[i][3]
        first += 1
    return out, first


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
    cols = zip(*rows, strict=True) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*COLUMNS, "fill"])


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    vocabulary = vocabulary or default_vocabulary()

    def cut(doc_id, ids):
        ids = np.append(ids, end_id).astype("<u4")
        raw, n = memoryview(ids.tobytes()), len(ids)
        head = n % capacity or capacity
        for k, start in enumerate([0, *range(head, n, capacity)]):
            stop = head if k == 0 else start + capacity
            yield doc_id, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])

    def run(batches):
        encode, number = encoder(vocabulary).column, TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for own, texts in by_size(batches):
            for d, ids in zip(own.to_pylist(), encode(texts), strict=True):
                rows += cut(d, ids)
            if len(rows) >= GROUP:
                out, number = placed(rows, number, capacity)
                rows = []
                yield to_batch(out)
        out, number = placed(rows, number, capacity)
        yield to_batch(out)

    def again(batches):
        number = 1 << 62 | TaskContext.get().partitionId() << 40
        rows = [tuple(r) for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
        out, _ = placed(rows, number, capacity)
        yield to_batch(out)

    first = saved(map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA + ", fill long"), "packed")
    low = F.col("fill") < int(OPEN * capacity)
    n = first.where(low).count()
    # dealt by a hash of the piece itself, so that a task run again packs the same rows
    tail = first.where(low).repartition(max(1, n // GROUP), F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "start", "sequence_id", "offset")
    return first.where(~low).select(COLUMNS).unionByName(tail.mapInArrow(again, SCHEMA + ", fill long").select(COLUMNS))
