"""Line deduplication by a deletion-neighbourhood join over words.

Lines are compared as A-Z lower-cased words. A line goes if an earlier line has the same words,
or is one word inserted, deleted or replaced away where that is at most a fifth of the longer
line (``near_words`` 5: a similarity of 0.8). Lines come in order of doc_id, then of a hash of
the text where several rows have one doc_id, then of their number; rows without doc_id
come first. Each distinct line emits itself and every variant with one word deleted, as hashes. Two
lines are one edit apart iff they share a variant deleted at the same place, or one is a variant
of the other; so a group of equal variants needs only its earliest member, not its pairs, and no
group is ever gathered. The edit distance of each line to its witness is then verified on
the words.

Only lines that may have a partner emit variants: two lines one edit apart share the first or
the last half of their words, counted by the shorter one, so lines alone under all
their halves are left out, without loss.

Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, lose their own
lines only. Rows equal in both have the same lines and keep or lose the same ones. Null
texts have no lines; lines without words stay. Columns of other names are left alone. An empty
table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, let, map_batches, release, row_key, saved, words_of

#: Words from which a line may be one edit from another: one edit is then a fifth of it at most.
NEAR_WORDS = 5
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest(words: list[bytes], seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words), seed))


def halves(words: list[bytes], near_words: int = NEAR_WORDS) -> list[int]:
    """Hashes of the first and last half, as counted by a line of this length and by one
    shorter by a word; none for a line that is too short to be near another. 32 bits do: equal
    ones only say which lines are worth comparing."""
    n, out = len(words), []
    for short in (n, n - 1) if n >= near_words else (n,) if n == near_words - 1 > 0 else ():
        h = short // 2
        out += [_digest(words[:h], 2 * short + 1) >> 32, _digest(words[n - (short - h) :], 2 * short + 2) >> 32]
    return out


def neighbourhood(words: list[bytes]) -> np.ndarray:
    """Hashes of the line, then of the line less its word 0, 1, ...: all in linear time."""
    n = len(words)
    x = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, n)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n, BASE, np.uint64))
        upto = np.r_[np.zeros(1, np.uint64), np.cumsum(x * powers, dtype=np.uint64)]
        less = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(INVERSE)
        sizes = np.r_[np.uint64(n), np.full(n, n - 1, np.uint64)] * np.uint64(0xD6E8FEB86659FD93)
        return (np.r_[upto[-1:], less] ^ sizes).view(np.int64)


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def lines_of(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(d, row, line, h, g, keys): lines with words, two hashes of their words, and the hashes of
    halves of those that near copies are sought of."""
    names = ["d", "row", "line", "h", "g", "keys"]

    def run(batches):
        for b in batches:
            ids, rows, nos, hs, gs, keys, at = [], [], [], [], [], [], [0]
            for d, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for k, line in enumerate(t.split("\n")):
                    w = words_of(line)
                    if not w:
                        continue
                    ids.append(d)
                    rows.append(r)
                    nos.append(k)
                    hs.append(_digest(w))
                    gs.append(_digest(w, 1 << 40))
                    keys += halves(w, near_words)
                    at.append(len(keys))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32() if c is nos else pa.int64()) for c in (ids, rows, nos, hs, gs)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys, pa.int32()))], names)

    rows = docs.where("text IS NOT NULL").select(*row_key(), F.col("text").cast("string"))
    return map_batches(rows, run, "d long, row long, line int, h long, g long, keys array<int>")


def _variants(near_words):
    """(v, pos, id) of candidate lines; the shortest stand for themselves only."""

    def run(batches):
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(text)
                v = neighbourhood(w) if len(w) >= near_words else neighbourhood(w)[:1]
                out.append((v, np.arange(-1, len(v) - 1, dtype=np.int32), np.full(len(v), i)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
            for s in range(0, max(1, len(cols[0])), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + (1 << 16)]) for c in cols], ["v", "pos", "id"])

    return run


def _verified(batches):
    for b in batches:
        ok = [one_edit(words_of(x), words_of(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["h", "g"]).filter(pa.array(ok, pa.bool_()))


#: A distinct line's hashes, and where it is found first.
PLACE = ["h", "g", "d", "row", "line"]


def near_classes(docs: DataFrame, classes: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(h, g) of the distinct lines that are one edit from an earlier line."""
    keyed = classes.select("h", "g", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    found = keyed.join(shared, "key", "left_semi").select("h", "g").distinct()
    where = classes.select(PLACE).join(found, ["h", "g"], "left_semi")
    # a table, whose size Spark knows: while it is small the texts need not be shuffled
    places = saved(where.groupBy("d", "row").agg(F.collect_list(F.struct("h", "g", "line")).alias("places")), "lines-places")
    free(docs.sparkSession)
    text = docs.where("text IS NOT NULL").select(*row_key(), F.col("text").cast("string").alias("text"))
    cand = text.join(places, ["d", "row"]).select("d", "row", let(F.split("text", "\n", -1), lambda x: F.transform("places", lambda p: F.struct(p["h"].alias("h"), p["g"].alias("g"), p["line"].alias("line"), F.get(x, p["line"]).alias("words")))).alias("p"))
    cand = cand.select("d", "row", F.explode("p").alias("p")).select("p.h", "p.g", "d", "row", "p.line", "p.words")
    # numbered in order of their first places, so that one number stands for line and place
    cand = cand.dropDuplicates(["h", "g"]).orderBy("d", "row", "line").select(F.monotonically_increasing_id().alias("id"), "h", "g", "words")
    cand = saved(cand, "lines-candidates")
    free(docs.sparkSession)
    v = saved(map_batches(cand.select("id", "words"), _variants(near_words), "v long, pos int, id long"), "lines-variants")
    cut, whole = v.where("pos >= 0"), v.where("pos < 0").select("v", F.col("id").alias("whole"))
    first = cut.groupBy("v", "pos").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last")
    a = cut.join(first, ["v", "pos"]).where("id > first").select("id", F.col("first").alias("to"))
    # of the lines that have this one as a variant, the earliest; and those that come after it
    b = whole.join(cut.groupBy("v").agg(F.min("id").alias("first")), "v").where("first < whole").select(F.col("whole").alias("id"), F.col("first").alias("to"))
    c = cut.join(whole, "v").where("whole < id").select("id", F.col("whole").alias("to"))
    pairs = a.unionByName(b).unionByName(c).distinct()
    both = pairs.join(cand, "id").join(cand.select(F.col("id").alias("to"), F.col("words").alias("other")), "to")
    out = saved(map_batches(both.select("h", "g", "words", "other"), _verified, "h long, g long").distinct(), "lines-near")
    free(docs.sparkSession)
    for x in (v, cand, places):
        release(x)
    return out


def dropped_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(d, row, line) of every line that goes, by the keys of its row."""
    lines = saved(lines_of(docs, near_words), "lines")
    place = F.struct("d", "row", "line")
    classes = lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("keys").alias("keys"))
    classes = saved(classes.select("h", "g", "first.d", "first.row", "first.line", (F.col("last") != F.col("first")).alias("again"), "keys"), "lines-classes")
    free(docs.sparkSession)
    near = near_classes(docs, classes, near_words)
    # only classes that lose a line are joined back
    gone = classes.select(*PLACE, "again").join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").where("again OR near").select("h", "g", place.alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    out = saved(lines.select(PLACE).join(gone, ["h", "g"]).where(F.col("near") | (place != F.col("first"))).select("d", "row", "line").distinct(), "lines-dropped")
    for x in (lines, classes, near):
        release(x)
    free(docs.sparkSession)
    return out


def _by_row(docs: DataFrame, near_words: int) -> DataFrame:
    """(d, row, gone): the sorted numbers of each row's dropped lines."""
    return dropped_lines(docs, near_words).groupBy("d", "row").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def report(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped), one row for each: dropped line numbers from 0,
    comma-joined."""
    plain = docs.select(F.col("doc_id").cast("long"), *row_key(), F.coalesce(F.size(F.split(F.col("text").cast("string"), "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    rows = plain.join(_by_row(docs, near_words), ["d", "row"], "left")
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.concat_ws(",", F.coalesce("gone", none).cast("array<string>")).alias("dropped"))


def drop_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` without those lines; a document that loses all its lines goes."""
    gone = _by_row(docs, near_words)
    rows = docs.select(F.struct("*").alias("_doc"), *row_key()).join(gone, ["d", "row"], "left")
    lines = F.split("_doc.text", "\n", -1)
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    rows = rows.where(F.col("gone").isNull() | (F.size(lines) > F.size("gone")))
    text = F.when(F.col("gone").isNull(), F.col("_doc.text")).otherwise(kept)
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return rows.select(*(new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))
