"""Katz backoff language model of words, order three, over tables that grow with the corpus.

Unigrams. Training counts of every word and of the end token, by XXH64 of the word, are a table.
Good-Turing discounts of counts up to ``K`` leave mass for unknown words, so that the unigram
distribution over the vocabulary and one unknown word sums to one. Words counted often, ``TOP``
of them at most whatever the corpus, are broadcast and have short ids; all others are their hashes,
and their counts are joined where they are needed.

Higher orders. Every text is start marks, its words, an end. What a flush of texts has of one
n-gram travels once, with its training count and the documents it stands in, to the bucket of
the word before its last. So all contexts that end in that word are in one bucket, and with
them what they back off to. A word with more than half a bucket's tokens is split by the word before
it; its bigram counts alone are then partial, and travel packed to tasks that add them up and reply. A bucket
adds up its n-grams, then goes through its flushes again, one at a time, and writes tables,
partitioned by kind: the n-gram counts; sums for each document; and what waits: contexts
whose backoff weight is asked for, and words and bigrams whose counts are. When all are written,
the counts of counts of each order give its discounts, and each context its weight: (1 - sum of
seen P(w|h)) / (1 - sum of seen P(w|shorter h)), so that the distribution after every context
sums to one. A context none of whose counts is discounted gets one more in its total, or nothing
would be left for unseen words.

A token's log10 probability is log10 d(r) r / C(h) if its n-gram was seen r times in training, else
log10 weight(h) and the same for the n-gram less its first word; a context never seen has weight
one. ``score`` learns and scores in one pass. ``train`` leaves a folder of tables, and ``score_with``
reads those to score any texts.

A whole context of order - 1 words is not split: its documents stay packed, a few bytes for each, and
its distinct n-grams must fit in a task.

Null texts are empty: one end token. Rows without doc_id train. Repeated rows count each.
Other columns are ignored. An empty table gives none; a corpus without training documents
gives every token the unknown word's mass, which is then all of it.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, map_batches, pack, release, saved, scratch_dir, spread, trim, unpack, words_of

ORDER = 3
#: Counts that are discounted; counts of counts that the discounts are fitted to.
K, FIT = 5, 40
#: Words that are broadcast at most, 16 bytes each; the steps of an octave that counts are cut into.
TOP, STEPS = 1 << 20, 16
#: Tokens that are handled at once in a map task, tokens of a bucket, and buckets of one task.
FLUSH, BUCKET, TOGETHER = 700_000, 800_000, 2
#: Parts of one in which sums of probabilities travel, so that they add up the same in any order.
FIXED = 1 << 60
#: Distinct n-grams that a bucket holds before it adds up equal ones.
MERGE = 600_000
END = b"\n"  # no word has it
#: Ids: the start mark, the first of the broadcast words; hashes lie above.
START, FIRST, HASHED = 1, 2, 1 << 32
DOCS, PART, WAIT, MODEL, WORD, PAIR, SUM, FAR, REPLY, DONE = range(10)
ROWS = "kind int, key long, payload binary, what int, idx int, v long, w long, n long"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def key_of(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h if h >= HASHED else h | 1 << 63


def turing(n: dict[int, int], k: int = K) -> list[float]:
    """r*/r for r = 1..k by simple Good-Turing from counts of counts up to ``FIT``.

    Counts of counts are spread over the gaps beside them and fitted by a line in logarithms, whose
    slope is held under -1.1 (-2 where there are fewer than two points). From r = 1 on the raw
    (r + 1) n[r + 1] / n[r] is taken while it differs from the line's by more than 1.65 standard
    deviations; what would not lower a count is taken from the line."""
    rs = [r for r in range(1, FIT + 1) if n.get(r, 0)]
    slope = -2.0
    if len(rs) > 1:
        gaps = zip(rs, [0, *rs[:-1]], [*rs[1:], 2 * rs[-1] - rs[-2]], strict=True)
        y = np.log([n[r] / (0.5 * (after - before)) for r, before, after in gaps])
        slope = min(-1.1, float(np.polyfit(np.log(rs), y, 1)[0]))
    out, raw = [], True
    for r in range(1, k + 1):
        line = (r + 1) * ((r + 1) / r) ** slope
        star, a, b = line, n.get(r, 0), n.get(r + 1, 0)
        raw = raw and a > 0 and b > 0
        if raw:
            x = (r + 1) * b / a
            raw = abs(x - line) > 1.65 * math.sqrt((r + 1) ** 2 * b / a**2 * (1 + b / a))
            star = x if raw and x < r else line
        out.append(star / r)
    return out


def discounts(n: dict[int, int], k: int = K) -> np.ndarray:
    """d[r] for r = 0..k, by Katz: of each r*/r the share that is common to all up to k goes, so that
    counts above k stay as they are. All lie in (0, 1)."""
    ratio = turing(n, k)
    common = math.prod(ratio)
    return np.array([1.0, *((x - common) / (1 - common) for x in ratio)])


class Unigrams:
    """Probability by training count; count 0 is the unknown word."""

    def __init__(self, total: int, n: dict[int, int]):
        self.total, d = total, discounts(n)
        held = sum(n.get(r, 0) * r * (1 - d[r]) for r in range(1, K + 1))
        self.whole = total if held else total + 1
        self.unknown = (held or 1) / self.whole
        self.d = d

    def p(self, c: np.ndarray) -> np.ndarray:
        out = np.where(c <= K, c * self.d[np.minimum(c, K)], c) / self.whole
        return np.where(c == 0, self.unknown, out)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out): held out are those with crc32(doc_id as text) mod 5 = 1."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)).alias("held_out"))


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n): training counts by the word's XXH64."""
    return map_batches(docs.where(~F.col("held_out")).select("text"), word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def word_counts(batches):
    """Counts of some texts at a time."""
    lean()
    counts: dict[bytes, int] = {}
    seen = 0

    def flush():
        h = np.fromiter(map(key_of, counts), np.uint64, len(counts)).view(np.int64)
        n = np.fromiter(counts.values(), np.int64, len(counts))
        counts.clear()
        for i in range(0, len(h), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 17)]), pa.array(n[i : i + (1 << 17)])], ["h", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            w = words_of(t)
            w.append(END)
            for x in w:
                counts[x] = counts.get(x, 0) + 1
            seen += len(w)
        if seen > 2 * FLUSH:
            yield from flush()
            seen = 0
    yield from flush()


class Words:
    """The broadcast words: hashes in order, and counts. The id of one is its place."""

    def __init__(self, raw: tuple[bytes, bytes]):
        self.h, self.n = np.frombuffer(raw[0], np.uint64), np.frombuffer(raw[1], np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        h = np.fromiter(map(key_of, words), np.uint64, len(words))
        if not len(self.h):
            return h
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at.astype(np.uint64) + np.uint64(FIRST), h)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts; -1 where they are not broadcast."""
        own = (ids >= FIRST) & (ids < HASHED)
        out = np.full(len(ids), -1, np.int64)
        out[own] = self.n[(ids[own] - np.uint64(FIRST)).astype(np.int64)]
        return out


class Plan:
    """What every task knows: the words, the unigrams, the order, the buckets."""

    def __init__(self, words, uni: Unigrams, types: int, starts: int, order: int, buckets: int, bucket: int):
        self.held, self.uni, self.types, self.order, self.buckets, self.bucket = words, uni, types, order, buckets, bucket
        self.starts = starts

    def words(self) -> Words:
        return Words(self.held.value)

    def slots(self, counts: np.ndarray) -> np.ndarray:
        """Into how many buckets a word is split."""
        return np.maximum(1, -(-2 * counts // self.bucket))

    def pair_slots(self, v: np.ndarray, w: np.ndarray, words: Words) -> np.ndarray:
        """Where the bigrams of split words are added up: 16 places for the square root of a word's buckets."""
        slots = self.slots(np.where(v == START, self.starts, words.counts(v)))
        return mix(v, spread(w) % (16 * np.ceil(np.sqrt(slots))).astype(np.uint64)).view(np.int64)


def mix(a: np.ndarray, b) -> np.ndarray:
    """One hash of two numbers."""
    with np.errstate(over="ignore"):
        return spread(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(0x632BE59BD9B4E019))


def flushes(batches, words: Words):
    """(doc_ids, held_out, sizes, tokens, ids): tokens number the distinct words that ids name."""
    vocabulary: dict[bytes, int] = {}
    doc_ids, outs, sizes, tokens, seen = [], [], [], [], 0
    for b in batches:
        for d, text, out in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            w = words_of(text)
            w.append(END)
            tokens.append(np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for x in w), np.int32, len(w)))
            doc_ids.append(d)
            outs.append(out)
            sizes.append(len(w))
            seen += len(w)
            if seen > FLUSH:
                yield doc_ids, np.array(outs, bool), np.array(sizes), np.concatenate(tokens), words.ids(list(vocabulary))
                vocabulary, doc_ids, outs, sizes, tokens, seen = {}, [], [], [], [], 0
    if doc_ids:
        yield doc_ids, np.array(outs, bool), np.array(sizes), np.concatenate(tokens), words.ids(list(vocabulary))


def bundle(*arrays: np.ndarray) -> bytes:
    parts = [pack(a.view(np.int64) if a.dtype == np.float64 else a) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unbundle(b: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        out.append(unpack(b[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (kind, key, payload)."""
    kinds, keys, payloads = zip(*rows, strict=True) if rows else ((), (), ())
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(payloads, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 3], [c.split()[0] for c in ROWS.split(", ")])


def table_of(kind: int, k: int, **columns: np.ndarray) -> pa.RecordBatch:
    """k rows without payload."""
    empty = {"payload": pa.binary(), "what": pa.int32(), "idx": pa.int32()}
    columns = {"kind": np.full(k, kind, np.int32)} | columns
    names = [c.split()[0] for c in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns else pa.nulls(k, empty.get(c, pa.int64())) for c in names], names)


def asks_of(bucket: int, idx: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """Rows that ask for the counts of words that are not broadcast."""
    return table_of(WORD, len(idx), key=np.full(len(idx), bucket), idx=idx.astype(np.int32), w=w.view(np.int64))


def counts_of(kind: int, what: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return table_of(kind, len(n), what=what.astype(np.int32), v=v, w=w, n=n)


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def dispatch(batches, plan: Plan, learn: bool):
    """Rows of a flush's documents, and of its n-grams by bucket."""
    lean()
    words, uid = plan.words(), TaskContext.get().partitionId() << 20
    one = np.uint64(1)
    for doc_ids, out, sizes, tokens, ids in flushes(batches, words):
        counts = words.counts(ids)
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)
        often = counts[tokens] >= 0
        base = np.bincount(doc[often], np.log10(counts[tokens][often] + 0.5), len(sizes))
        known = np.bincount(doc[often], minlength=len(sizes))
        none = np.array([d is None for d in doc_ids])
        yield rows_of([(DOCS, uid, bundle(np.array([0 if d is None else d for d in doc_ids], np.int64), none, out, sizes, known, base))])
        # columns: the word before, the word, then the words before that, nearest first
        start = len(ids)
        ids, counts = np.r_[ids, np.uint64(START)], np.r_[counts, plan.starts]
        columns = []
        for j in range(1, plan.order):
            h = np.full(len(tokens), start, np.int32)
            h[j:] = tokens[:-j]
            h[place < j] = start
            columns.append(h)
        columns.insert(1, tokens)
        del h, place, often, tokens
        v = columns[0]
        slots = plan.slots(counts)
        bucket = (spread(ids) % np.uint64(plan.buckets)).astype(np.int32)[v]
        hot = np.flatnonzero(slots[v] > 1)
        by = ids[columns[2 if plan.order > 2 else 1][hot]]
        salt = spread(by) % slots[v[hot]].astype(np.uint64) + one
        with np.errstate(over="ignore"):
            bucket[hot] = (spread(ids[v[hot]] * np.uint64(31) + salt) % np.uint64(plan.buckets)).astype(np.int32)
        del v, hot, by, salt
        # equal n-grams together, their documents in order; then by bucket
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            if len(ids) < 1 << 21 and plan.order == 3:
                key = key << 21 | c
            else:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64) << 32 | c
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(bucket[order].astype(np.uint16 if plan.buckets < 1 << 16 else np.int64), kind="stable")]
        key, bucket, doc = key[order], bucket[order], doc[order]
        new = np.r_[True, (np.diff(key) != 0) | (np.diff(bucket) != 0)]
        entry = np.flatnonzero(new | np.r_[True, np.diff(doc) != 0])
        times = np.diff(np.r_[entry, len(key)])
        gram = np.flatnonzero(new)
        of = (np.cumsum(new, dtype=np.int32) - 1)[entry]  # the n-gram of an entry
        key = order = order[gram]
        columns = [c[order] for c in columns]
        doc, trains = doc[entry], times * (~out[doc[entry]] & learn)
        count = np.bincount(of, trains, len(gram)).astype(np.int64)
        home = bucket[gram]
        cuts = np.flatnonzero(np.r_[True, np.diff(home) != 0, True]) if len(gram) else [0]
        where = np.searchsorted(of, cuts)
        rows = []
        for a, b, x, y in zip(cuts[:-1], cuts[1:], where[:-1], where[1:], strict=True):
            used, at = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
            rank = np.argsort(ids[used], kind="stable")
            back = np.empty(len(rank), np.int64)
            back[rank] = np.arange(len(rank))
            at = back[at].reshape(len(columns), -1)
            rows.append((MODEL, int(home[a]), bundle(np.array([uid]), gaps(ids[used][rank]).view(np.int64), gaps(at[0]), *at[1:], count[a:b], gaps(of[x:y] - a), doc[x:y], times[x:y] - 1)))
            if len(rows) == 64:
                yield rows_of(rows)
                rows = []
        yield rows_of(rows)
        rows = []
        uid += 1


class Grams:
    """A payload opened: columns of word ids, counts, and the documents of each n-gram."""

    def __init__(self, payload: bytes, order: int):
        uid, ids, first, *rest = unbundle(payload)
        self.uid = int(uid[0])
        with np.errstate(over="ignore"):
            ids = np.cumsum(ids.view(np.uint64), dtype=np.uint64)
        self.columns = [ids[np.cumsum(first)], *(ids[c] for c in rest[: order - 1])]
        self.count, of, self.doc, self.times = rest[order - 1 :]
        self.of, self.doc, self.times = np.cumsum(of), self.doc.astype(np.int32), (self.times + 1).astype(np.int32)

    def keys(self) -> list[np.ndarray]:
        """Hashes of the n-grams of 2, 3, ... words."""
        v, w, *more = self.columns
        out = [mix(v, w)]
        for u in more:
            out.append(mix(out[-1], u))
        return out

    def contexts(self) -> list[np.ndarray]:
        v, _, *more = self.columns
        out = [mix(v, np.uint64(7))]
        for u in more:
            out.append(mix(out[-1], u))
        return out


def merged(columns: list[list[np.ndarray]], counts: list[np.ndarray]):
    """Equal n-grams added up: (columns, counts), in order of their hash."""
    cols, n = [np.concatenate(c) for c in columns], np.concatenate(counts)
    key = mix(cols[0], cols[1])
    for u in cols[2:]:
        key = mix(key, u)
    order = np.argsort(key)
    first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
    return [c[order][first] for c in cols], np.add.reduceat(n[order], first) if len(first) else n


def find(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key, -1 where there is none."""
    if not len(keys):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, at, -1)


def classes(group: np.ndarray, r: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n groups how many members have r = 1..K, and the sum of those above."""
    return [*(np.bincount(group[r == k], minlength=n).astype(np.int32) for k in range(1, K + 1)), np.bincount(group[r > K], r[r > K], n).astype(np.int64)]


class Level:
    """The seen n-grams of one order in a bucket, and their contexts."""

    def __init__(self, keys, contexts, r, lower, below):
        self.keys, self.r = keys, r
        self.context, self.first, self.group = np.unique(contexts, return_index=True, return_inverse=True)
        n = len(self.context)
        self.stats = classes(self.group, r, n)
        total = np.bincount(self.group, r, n).astype(np.int64)
        self.total = total + (sum(self.stats[:K]) == 0)
        self.score = np.log10(r) - np.log10(self.total[self.group])
        self.lower = classes(self.group, lower, n) if lower is not None else None
        self.below = below[self.first] if below is not None else None


def levels_of(cols: list[np.ndarray], count: np.ndarray, order: int) -> tuple[dict[int, Level], dict[int, np.ndarray]]:
    """A level for each order from 2 up, and the n-gram of the full order that stands for each."""
    grams = Grams.__new__(Grams)
    grams.columns = cols
    keys, contexts = grams.keys(), grams.contexts()
    out, rep, r_of, total_of = {}, {}, None, None
    for n in range(2, order + 1):
        own, first, group = np.unique(keys[n - 2], return_index=True, return_inverse=True)
        keys[n - 2] = None
        r = np.bincount(group, count, len(own)).astype(np.int64)
        lower, below = (r_of[first], total_of[first]) if n > 2 else (None, None)
        level = out[n] = Level(own, contexts[n - 2][first], r, lower, below)
        rep[n], contexts[n - 2] = first, None
        r_of = r[group]
        total_of = level.total[level.group][group]
    return out, rep


def count_bucket(bucket: int, got: list[bytes], plan: Plan, words: Words, add):
    """Add up a bucket's n-grams; ``add(uid, docs, s, which)`` takes what is known of scores. Yields rows
    of what waits, of the n-grams, and of counts asked for."""
    order = plan.order
    columns, counts, size = [[] for _ in range(order)], [], 0
    for payload in got:
        g = Grams(payload, order)
        seen = g.count > 0
        for held, c in zip(columns, g.columns, strict=True):
            held.append(c[seen])
        counts.append(g.count[seen])
        size += int(seen.sum())
        if size > MERGE:
            cols, n = merged(columns, counts)
            columns, counts, size = [[c] for c in cols], [n], 0
    cols, count = merged(columns, counts)
    del columns, counts, held, c, g, payload, seen
    levels, rep = levels_of(cols, count, order)
    two = levels[2]
    is_hot = lambda ids: plan.slots(np.where(ids == START, plan.starts, words.counts(ids))) > 1
    uids: list[int] = []
    waits: dict[int, list] = {n: [] for n in range(2, order + 1)}
    rare, pending = [], []
    for src, payload in enumerate(got):
        g = Grams(payload, order)
        uids.append(g.uid)
        if not len(g.of):
            continue
        hot, c1 = is_hot(g.columns[0]), words.counts(g.columns[1])
        level, s, which = np.ones(len(c1), np.int64), np.zeros(len(c1)), np.zeros(len(c1), np.int64)
        keys, contexts = g.keys(), g.contexts()
        s[c1 >= 0] = np.log10(plan.uni.p(c1[c1 >= 0]))
        level[hot] = 0
        s[hot] = 0
        # the longest n-gram that was seen; the contexts of longer ones are backed off from
        asks, todo = {}, np.arange(len(c1))
        for n in range(order, 1, -1):
            own = levels[n]
            if n == 2:
                todo = todo[~hot[todo]]
            at = find(own.keys, keys[n - 2][todo])
            yes = at >= 0
            got_at, r = todo[yes], own.r[at[yes]]
            level[got_at], s[got_at] = n, own.score[at[yes]]
            which[got_at] = np.where(r <= K, (n - 2) * K + r, 0)
            todo = todo[~yes]
            asks[n] = np.full(len(c1), -1)
            asks[n][todo] = find(own.context, contexts[n - 2][todo])
        of, doc, times = g.of, g.doc, g.times
        add(g.uid, doc, s[of] * times, which[of], times)
        put = lambda held, e, ref, src=src, doc=doc, times=times: held.append((ref.astype(np.int32), np.full(len(e), src, np.int32), doc[e], times[e]))
        for n in range(2, order + 1):
            if (asks[n] >= 0).any():
                e = np.flatnonzero(asks[n][of] >= 0)
                put(waits[n], e, asks[n][of[e]])
        if (c1 < 0).any():
            e = np.flatnonzero((c1 < 0)[of])
            rare.append((g.columns[1][of[e]], np.full(len(e), src, np.int32), doc[e], times[e], (level == 1)[of[e]]))
        if (level == 0).any():
            e = np.flatnonzero((level == 0)[of])
            pending.append((g.columns[0][of[e]], g.columns[1][of[e]], np.full(len(e), src, np.int32), doc[e], times[e]))
    got.clear()
    # what resolving needs of each order's contexts
    parts = [np.array(uids, np.int64)]
    lists: list[np.ndarray] = []
    hot_of = is_hot(cols[0]) if len(count) else np.zeros(0, bool)
    pair_v, pair_w, pair_n = [cols[0][rep[2]][hot_of[rep[2]]]], [cols[1][rep[2]][hot_of[rep[2]]]], [two.r[hot_of[rep[2]]]]
    rare_pairs, hot_pairs = (np.zeros(0, np.int64), np.zeros(0, np.uint64)), (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    none = np.zeros(0, np.int64)
    for n in range(2, order + 1):
        own = levels[n]
        ref, src, doc, times = (np.concatenate(c) for c in zip(*waits[n], strict=True)) if waits[n] else [none] * 4
        del waits[n]
        used, ref = np.unique(ref, return_inverse=True)
        parts += [ref, src, doc, times, own.total[used], *(x[used] for x in own.stats)]
        back = np.full(len(own.context), -1)
        back[used] = np.arange(len(used))
        member = back[own.group]
        inner = np.flatnonzero(member >= 0)
        w = cols[1][rep[n]][inner]
        if n == 2:
            c1 = words.counts(w)
            parts.append(np.bincount(member[inner][c1 >= 0], plan.uni.p(c1[c1 >= 0]), len(used)))
            rare_pairs = member[inner][c1 < 0], w[c1 < 0]
        else:
            split = hot_of[rep[n]][inner] if n == 3 else np.zeros(len(inner), bool)
            parts += [own.below[used], *(x[used] for x in own.lower)]
            if n == 3:
                hot_pairs = member[inner][split], cols[0][rep[3]][inner][split], w[split]
                whose = np.zeros(len(used), np.uint64)
                whose[hot_pairs[0]] = hot_pairs[1]
                parts.append(whose.view(np.int64))
    rare = [np.concatenate(c) for c in zip(*rare, strict=True)] if rare else [np.zeros(0, np.uint64), none, none, none, np.zeros(0, bool)]
    pending = [np.concatenate(c) for c in zip(*pending, strict=True)] if pending else [np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, none]
    far = pending[1][words.counts(pending[1]) < 0] if len(pending[1]) else pending[1]
    asked = np.unique(np.concatenate([rare[0], rare_pairs[1], far]))
    # bigrams of split words: all seen here are added up, some are asked for
    ask_v, ask_w = np.concatenate([hot_pairs[1], pending[0]]), np.concatenate([hot_pairs[2], pending[1]])
    every_v, every_w = np.concatenate([*pair_v, ask_v]), np.concatenate([*pair_w, ask_w])
    n_of = np.concatenate([*pair_n, np.zeros(len(ask_v), np.int64)])
    pair, first, group = np.unique(mix(every_v, every_w), return_index=True, return_inverse=True)
    partial = np.bincount(group, n_of, len(pair)).astype(np.int64)
    every_v, every_w = every_v[first], every_w[first]
    ask = np.unique(group[len(group) - len(ask_v) :])
    number = np.full(len(pair), -1)
    number[ask] = np.arange(len(ask))
    to = number[group[len(group) - len(ask_v) :]]
    c1 = words.counts(pending[1])
    lists += [rare_pairs[0], np.searchsorted(asked, rare_pairs[1]), hot_pairs[0], to[: len(hot_pairs[0])]]
    lists += [np.searchsorted(asked, rare[0]), rare[1], rare[2], rare[3], rare[4].astype(np.int64)]
    lists += [pending[0].view(np.int64), to[len(hot_pairs[0]) :], c1, np.where(c1 < 0, np.searchsorted(asked, pending[1]), 0), pending[2], pending[3], pending[4]]
    tally = [np.bincount(np.minimum(levels[n].r[~hot_of[rep[n]]] if n == 2 else levels[n].r, FIT + 1), minlength=FIT + 2)[: FIT + 1] for n in range(2, order + 1)]
    payload = bundle(np.concatenate(tally), *parts, *lists)
    del parts, lists, levels, own, two, rep, rare, pending, rare_pairs, hot_pairs, ref, src, doc, times, member, inner, pair_v, pair_w, pair_n, group, n_of, to, ask_v, ask_w
    yield rows_of([(WAIT, bucket, payload)])
    del payload
    used, at = np.unique(np.concatenate(cols), return_inverse=True) if len(count) else (np.zeros(0, np.uint64), none)
    del cols
    at = at.astype(np.int32).reshape(order, -1)
    by = np.lexsort(at[::-1])
    yield rows_of([(MODEL, bucket, bundle(np.array([-1]), gaps(used).view(np.int64), gaps(at[0][by]), *(a[by] for a in at[1:]), count[by], none, none, none))])
    del used, at, by, count
    for i in range(0, len(asked), 1 << 16):
        some = asked[i : i + (1 << 16)]
        yield asks_of(bucket, np.arange(i, i + len(some)), some)
    place = plan.pair_slots(every_v, every_w, words)
    by = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(place[by]) != 0, True]) if len(by) else [0]
    rows = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        e = by[i:j]
        rows.append((PAIR, int(place[e[0]]), bundle(np.array([bucket]), every_v[e].view(np.int64), every_w[e].view(np.int64), partial[e], number[e])))
    if rows:
        yield rows_of(rows)


def add_pairs(batches, plan: Plan):
    """Counts of split words' bigrams, which come packed and sorted by place: (SUM, what, v, n), how many
    bigrams of v were counted what = 1..FIT times, the sum of higher counts at FIT + 1, and at 0 the unigram
    probabilities of the words after v, in ``FIXED`` parts, as far as broadcast; (FAR, v, w, n), the
    bigrams whose w is not; (REPLY, bucket, numbers and counts)."""
    lean()
    words = plan.words()

    def flush(got):
        v, w, n = (np.concatenate([p[k] for p in got]) for k in (1, 2, 3))
        _, first, group = np.unique(mix(v.view(np.uint64), w.view(np.uint64)), return_index=True, return_inverse=True)
        c = np.bincount(group, n, len(first)).astype(np.int64)
        rows, at = [], 0
        for p in got:
            number, own = p[4], c[group[at : at + len(p[4])]]
            at += len(number)
            asked = number >= 0
            if asked.any():
                rows.append((REPLY, int(p[0][0]), bundle(number[asked], own[asked])))
        if rows:
            yield rows_of(rows)
        v, w = v[first][c > 0], w[first][c > 0]
        c = c[c > 0]
        n1 = words.counts(w.view(np.uint64))
        far = n1 < 0
        if far.any():
            yield counts_of(FAR, np.zeros(int(far.sum()), np.int64), v[far], w[far], c[far])
        own, of = np.unique(v, return_inverse=True)
        cell = of * (FIT + 2) + np.minimum(c, FIT + 1)
        size = len(own) * (FIT + 2)
        table = np.bincount(cell, np.where(c > FIT, c, 1), size).astype(np.int64)
        table[:: FIT + 2] = np.rint(np.bincount(of[~far], plan.uni.p(n1[~far]), len(own)) * FIXED).astype(np.int64)
        some = np.flatnonzero(table)
        yield counts_of(SUM, some % (FIT + 2), own[some // (FIT + 2)], np.zeros(len(some), np.int64), table[some])

    now, got = None, []
    for b in batches:
        for key, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if key != now and got:
                yield from flush(got)
                got = []
            now = key
            got.append(unbundle(payload))
    if got:
        yield from flush(got)


def count_buckets(batches, plan: Plan):
    """Rows come sorted by kind and bucket."""
    lean()
    words = plan.words()
    wide = (plan.order - 1) * K + 1
    sums: dict[int, np.ndarray] = {}
    held = 0

    def add(uid, docs, s, which, times):
        nonlocal held
        n = int(docs.max()) + 1
        t = sums.get(uid)
        if t is None or t.shape[1] < n:
            grown = np.zeros((wide + 1, n))
            if t is not None:
                grown[:, : t.shape[1]] = t
                held -= t.shape[1]
            t = sums[uid] = grown
            held += n
        n = t.shape[1]
        t[0] += np.bincount(docs, s, n)
        t[1:] += np.bincount(which * n + docs, times, wide * n).reshape(wide, n)

    def flush():
        nonlocal held
        for uid, t in sums.items():
            docs = np.flatnonzero(t.any(0))
            yield rows_of([(PART, uid, bundle(gaps(docs), t[0, docs], *(x[docs].astype(np.int64) for x in t[2:])))])
        sums.clear()
        held = 0

    now, got = None, []
    for b in batches:
        for kind, key, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if kind == DOCS:
                yield rows_of([(DOCS, key, payload)])
                continue
            if key != now and got:
                yield from count_bucket(now, got, plan, words, add)
                got = []
                trim()
                if held > 300_000:
                    yield from flush()
            now = key
            got.append(payload)
    if got:
        yield from count_bucket(now, got, plan, words, add)
    yield from flush()
    del got
    trim()


def discounted(stats: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    """The sum of discounted counts, by classes of counts."""
    return sum((x * k * d[k] for k, x in enumerate(stats[:K], 1)), stats[K].astype(float))


def seen(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= K, c * d[np.minimum(c, K)], c)


def resolve(batches, plan: Plan, d: dict[int, np.ndarray], hot: dict[int, tuple[float, float]]):
    """Scores of what waits: rows (DONE, uid, documents, score, base, known). The counts of a bucket come
    before its payload. ``hot``: total and backoff weight of the split words."""
    lean()
    asked: list[tuple] = []
    pairs: list[tuple] = []

    def array(replies):
        idx, n = (np.concatenate(c) for c in zip(*replies, strict=True)) if replies else [np.zeros(0, np.int64)] * 2
        out = np.zeros(int(idx.max()) + 1 if len(idx) else 0, np.int64)
        out[idx] = n
        replies.clear()
        return out

    for b in batches:
        kinds = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if kinds[i] == WORD:
                asked.append(tuple(b.column(k).slice(i, j - i).to_numpy() for k in (4, 7)))
                continue
            for k in range(i, j):
                payload = b.column(2)[k].as_py()
                if kinds[i] == REPLY:
                    pairs.append(tuple(unbundle(payload)))
                else:
                    yield from settled(payload, plan, d, hot, array(asked), array(pairs))


def settled(payload: bytes, plan: Plan, d, hot, word_n: np.ndarray, pair_n: np.ndarray):
    parts = unbundle(payload)[1:]
    uids, parts = parts[0], parts[1:]
    p1 = plan.uni.p(word_n)
    total = lambda v: np.array([hot.get(x, (1.0, 1.0))[0] for x in v])
    *orders, rare_ctx, rare_word, hot_ctx, hot_pair, w_at, w_src, w_doc, w_times, w_need, p_v, p_pair, p_c1, p_at, p_src, p_doc, p_times = parts
    refs, srcs, docs, scores = [], [], [], []
    at = 0
    for n in range(2, plan.order + 1):
        ref, src, doc, times, whole = orders[at : at + 5]
        stats = orders[at + 5 : at + 6 + K]
        at += 6 + K
        if n == 2:
            low = orders[at].view(np.float64) + np.bincount(rare_ctx, p1[rare_word], len(whole))
            at += 1
        else:
            below, lower = orders[at].astype(float), discounted(orders[at + 1 : at + 2 + K], d[n - 1])
            at += 2 + K
            if n == 3:
                # of split words, the bigrams' counts have been added up elsewhere
                whose = orders[at]
                at += 1
                split = np.bincount(hot_ctx, minlength=len(whole)) > 0
                lower = np.where(split, np.bincount(hot_ctx, seen(pair_n[hot_pair], d[2]), len(whole)), lower)
                below[split] = total(whose[split].tolist())
            low = lower / below
        weight = (1 - discounted(stats, d[n]) / whole) / (1 - low)
        srcs.append(src)
        docs.append(doc)
        scores.append(times * np.log10(weight)[ref])
    # bigrams of split words: seen, or backed off from
    c = pair_n[p_pair]
    v_total = total(p_v.tolist())
    v_weight = np.array([hot.get(x, (1.0, 1.0))[1] for x in p_v.tolist()])
    last = np.where(p_c1 >= 0, plan.uni.p(np.maximum(p_c1, 0)), p1[p_at] if len(p1) else 1.0)
    with np.errstate(divide="ignore"):
        scores.append(p_times * np.where(c > 0, np.log10(seen(c, d[2]) / v_total), np.log10(v_weight) + np.log10(last)))
    srcs.append(p_src)
    docs.append(p_doc)
    scores.append(np.where(w_need > 0, w_times * np.log10(p1[w_at]), 0.0) if len(w_at) else np.zeros(0))
    srcs.append(w_src)
    docs.append(w_doc)
    src, doc, s = np.concatenate(srcs), np.concatenate(docs), np.concatenate(scores)
    base = np.concatenate([np.zeros(len(src) - len(w_at)), w_times * np.log10(word_n[w_at] + 0.5)])
    known = np.concatenate([np.zeros(len(src) - len(w_at)), w_times * (word_n[w_at] > 0)])
    order = np.argsort(src, kind="stable")
    cuts = np.searchsorted(src[order], np.arange(len(uids) + 1))
    rows = []
    for k, uid in enumerate(uids.tolist()):
        m = order[cuts[k] : cuts[k + 1]]
        if len(m):
            own, place = np.unique(doc[m], return_inverse=True)
            rows.append((DONE, uid, bundle(gaps(own), *(np.bincount(place, x[m], len(own)) for x in (s, base)), np.bincount(place, known[m], len(own)).astype(np.int64))))
    yield rows_of(rows)


def total_up(batches, plan: Plan, d: dict[int, np.ndarray]):
    """Rows come sorted by uid; all of a flush's documents go out together."""
    names = [c.split()[0] for c in OUT.split(", ")]
    logs = [math.log10(d[n][k]) for n in range(2, plan.order + 1) for k in range(1, K + 1)]
    least = math.log10(plan.uni.total + 0.5 * (plan.types + 1))
    now, docs, parts = None, None, []

    def flush():
        doc_id, none, out, sizes, known, base = docs
        base, score, known = base.view(np.float64) - sizes * least, np.zeros(len(sizes)), known.copy()
        for kind, payload in parts:
            own, s, *rest = unbundle(payload)
            own, s = np.cumsum(own), s.view(np.float64)
            if kind == PART:
                score[own] += s + sum((x * y for x, y in zip(rest, logs, strict=True)), np.zeros(len(s)))
            else:
                score[own] += s
                base[own] += rest[0].view(np.float64)
                known[own] += rest[1]
        ids = pa.array(doc_id, pa.int64(), mask=none.astype(bool))
        return pa.RecordBatch.from_arrays([ids, pa.array(out.astype(bool)), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), plan.uni.total, np.int64)), pa.array(base), pa.array(score)], names)

    for b in batches:
        for kind, uid, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if uid != now and docs is not None:
                yield flush()
                docs, parts = None, []
            now = uid
            if kind == DOCS:
                docs = unbundle(payload)
            else:
                parts.append((kind, payload))
    if docs is not None:
        yield flush()


def _plan(unigrams: DataFrame, order: int) -> Plan:
    """Totals and counts of counts, and the words counted most often, are all that the driver sees."""
    spark = unigrams.sparkSession
    low = {r["n"]: r["count"] for r in unigrams.where(F.col("n") <= FIT).groupBy("n").count().collect()}
    total, types = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    step = F.floor(STEPS * F.log2("n"))
    sizes, least, held = unigrams.groupBy(step.alias("step")).count().collect(), None, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        held += r["count"]
        if held > TOP:
            break
        least = r["step"]
    top = unigrams.where(step >= least if least is not None else F.lit(False)).toArrow()
    h, n = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    by = np.argsort(h)
    end = unigrams.where(F.col("h") == F.lit(int(np.array([key_of(END)], np.uint64).view(np.int64)[0]))).select("n").head()
    words = spark.sparkContext.broadcast((h[by].tobytes(), n[by].tobytes()))
    return Plan(words, Unigrams(total, low), types, end[0] if end else 0, order, max(1, -(-total // BUCKET)), BUCKET)


def _tasks(plan: Plan) -> int:
    return max(1, -(-plan.buckets // TOGETHER))


def _counted(rows: DataFrame, plan: Plan, learn: bool, model: DataFrame | None = None) -> DataFrame:
    """The tables of kinds, of documents that are learned from or of a model's n-grams."""
    sent = map_batches(rows, lambda b: dispatch(b, plan, learn), ROWS)
    if model is not None:
        sent = sent.unionByName(model)
    place = F.when(F.col("kind") == DOCS, F.col("key")).otherwise(F.floor(F.col("key") / TOGETHER))
    # twice as many as there are groups of buckets, so that few tasks have several
    tasks = max(1, -(-2 * plan.buckets // TOGETHER))
    dealt = sent.repartition(tasks, place).sortWithinPartitions("kind", "key")
    return saved(dealt.mapInArrow(lambda b: count_buckets(b, plan), ROWS), "katz-tables", by="kind")


def _discounts(tables: DataFrame, plan: Plan, unigrams: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, tuple[float, float]], DataFrame]:
    """(discounts by order, total and backoff weight of the split words, sums of their bigrams)."""

    def tally(batches):
        for b in batches:
            for payload in b.column(0).to_pylist():
                n = unbundle(payload)[0].reshape(plan.order - 1, FIT + 1)
                order, r = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(order + 2), pa.array(r), pa.array(n[order, r])], ["level", "r", "n"])

    sent = tables.where(F.col("kind") == PAIR).select([c.split()[0] for c in ROWS.split(", ")]).repartition(_tasks(plan), "key").sortWithinPartitions("key")
    pairs = saved(sent.mapInArrow(lambda b: add_pairs(b, plan), ROWS), "katz-pairs", by="kind")
    sums = pairs.where(F.col("kind") == SUM).groupBy("v", "what").agg(F.sum("n").alias("n")).collect()
    few = tables.where(F.col("kind") == WAIT).select("payload").mapInArrow(tally, "level long, r long, n long")
    of: dict[int, dict[int, int]] = {n: {} for n in range(2, plan.order + 1)}
    for r in few.where("r > 0").groupBy("level", "r").agg(F.sum("n").alias("n")).collect():
        of[r["level"]][r["r"]] = r["n"]
    for r in sums:
        if 1 <= r["what"] <= FIT:
            of[2][r["what"]] = of[2].get(r["what"], 0) + r["n"]
    d = {n: discounts(x) for n, x in of.items()}
    # the split words: two for each bucket at most
    p = F.when(F.col("n") <= K, F.col("n") * F.element_at(F.array(*[F.lit(float(x)) for x in plan.uni.d[1:]]), F.least("n", F.lit(K)).cast("int"))).otherwise(F.col("n")) / plan.uni.whole
    # the counts of broadcast words have come along; only the others are joined
    far = pairs.where(F.col("kind") == FAR).select("v", "w").join(unigrams.withColumnRenamed("h", "w"), "w")
    mass = {r["v"]: r["mass"] for r in far.groupBy("v").agg(F.sum(p).alias("mass")).collect()}
    by: dict[int, dict[int, int]] = {}
    for r in sums:
        by.setdefault(r["v"], {})[r["what"]] = r["n"]
    hot = {}
    for v, n in by.items():
        stats = [n.get(k, 0) for k in range(1, K + 1)]
        big = sum(k * n.get(k, 0) for k in range(K + 1, FIT + 1)) + n.get(FIT + 1, 0)
        whole = sum(x * k for k, x in enumerate(stats, 1)) + big + (sum(stats) == 0)
        kept = sum(x * k * d[2][k] for k, x in enumerate(stats, 1)) + big
        hot[v] = whole, (1 - kept / whole) / (1 - n.get(0, 0) / FIXED - mass.get(v, 0.0))
    return d, hot, pairs


def _scored(tables: DataFrame, plan: Plan, unigrams: DataFrame) -> DataFrame:
    d, hot, pairs = _discounts(tables, plan, unigrams)
    tasks = _tasks(plan)
    names = [c.split()[0] for c in ROWS.split(", ")]
    asks = tables.where(F.col("kind") == WORD).drop("n").join(unigrams.withColumnRenamed("h", "w"), "w", "left")
    replies = asks.withColumn("n", F.coalesce("n", F.lit(0))).select(names).unionByName(pairs.where(F.col("kind") == REPLY).select(names))
    asked = replies.unionByName(tables.where(F.col("kind") == WAIT).select(names))
    dealt = asked.repartition(tasks, F.floor(F.col("key") / TOGETHER)).sortWithinPartitions("key", F.col("kind") == WAIT, "kind")
    done = dealt.mapInArrow(lambda b: resolve(b, plan, d, hot), ROWS)
    every = tables.where(F.col("kind").isin(DOCS, PART)).select(names).unionByName(done).select("kind", "key", "payload")
    return every.repartition(tasks, "key").sortWithinPartitions("key", "kind").mapInArrow(lambda b: total_up(b, plan, d), OUT)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learn from the documents that are not held out and score all: see ``OUT``."""
    rows = documents(docs)
    unigrams = saved(count_words(rows), "katz-unigrams")
    plan = _plan(unigrams, order)
    return _scored(_counted(rows, plan, True), plan, unigrams)


def train(docs: DataFrame, path: str | None = None, order: int = ORDER) -> str:
    """Learn from the documents that are not held out, and write the model's tables to a folder, which
    is returned: ``unigrams`` (h, n), ``ngrams`` by bucket, and ``about``."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/voxgrove-{spark.sparkContext.applicationId}/katz-{uuid.uuid4().hex}"
    rows = documents(docs)
    unigrams = saved(count_words(rows), "katz-unigrams")
    plan = _plan(unigrams, order)
    tables = _counted(rows.where(~F.col("held_out")), plan, True)
    unigrams.write.mode("overwrite").parquet(f"{path}/unigrams")
    tables.where(F.col("kind") == MODEL).select(F.col("key").alias("bucket"), "payload").write.mode("overwrite").parquet(f"{path}/ngrams")
    spark.createDataFrame([(order, plan.bucket)], "order int, bucket_tokens long").write.mode("overwrite").parquet(f"{path}/about")
    release(unigrams)
    release(tables)
    return path


def score_with(path: str, docs: DataFrame) -> DataFrame:
    """Score any documents by the tables of ``train``: see ``OUT``. None of them is learned from."""
    spark = docs.sparkSession
    order, bucket = spark.read.parquet(f"{path}/about").head()
    unigrams = spark.read.schema("h long, n long").parquet(f"{path}/unigrams")
    plan = _plan(unigrams, order)
    plan.bucket, plan.buckets = bucket, max(1, -(-plan.uni.total // bucket))
    grams = spark.read.schema("bucket long, payload binary").parquet(f"{path}/ngrams")
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    model = grams.select(F.lit(MODEL).alias("kind"), F.col("bucket").alias("key"), "payload", null("what", "int"), null("idx", "int"), null("v", "long"), null("w", "long"), null("n", "long"))
    return _scored(_counted(documents(docs), plan, False, model), plan, unigrams)
