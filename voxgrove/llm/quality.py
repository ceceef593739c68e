"""Quality rules: one threshold table compiled into one projection of built-in functions.

``MEASURES`` are SQL-side expressions of a text; ``RULES`` bounds ratios of two of them in
percent. All comparisons are of whole numbers. A text fails the base rules if it has fewer
than 50 words or more than half of its words lie in three-word windows found twice or more;
no rule looks at a text that failed those. Stop words are counted A-Z lower-cased, as a share of words.

Nulls and empty texts have no words and fail. Repeated rows are judged each. Columns of
other names are left alone; an empty table gives none. No shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frequent function words of the four languages.
STOP_WORDS = "the of and to in is that be have with for it as was on are this by de la le et les des que el los der die und das zu von du un une en se y dans pour sur est per del con nicht mit ist ein eine".split()
#: (rule, measure, of which measure, least percent, most percent); None: no bound
RULES = [
    ("word_length", "word_chars", "n_words", 200, 1500),
    ("symbols", "n_symbols", "n_words", None, 10),
    ("stop_words", "n_stop_words", "n_words", 5, None),
    ("dup_lines", "n_dup_lines", "n_lines", None, 50),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
]


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows found twice or more: windows are sorted by hash, equal
    neighbours compared by their words, and the places of repeated windows joined up."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def same(x, y):
        words = [F.get(w, x["i"] + k) == F.get(w, y["i"] + k) for k in range(3)]
        return F.coalesce((x["h"] == y["h"]) & words[0] & words[1] & words[2], F.lit(False))

    def covered(s):
        found = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0), lambda a, x: a + x))

    return F.when(F.size(w) < 4, 0).otherwise(let(windows, covered)).cast("long")


def _word_measures(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x: F.translate(x, UPPER, UPPER.lower()).isin(STOP_WORDS))).cast("long").alias("n_stop_words")))


def _line_measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def some(of, test):
        return F.size(F.filter(of, test)).cast("long")

    return let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            some(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…")).alias("n_ellipsis_lines"),
            some(x, lambda y: F.ltrim(y).startswith("- ") | F.ltrim(y).startswith("* ") | F.ltrim(y).startswith("•")).alias("n_bullet_lines"),
        ),
    )


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_quality`` of all measures."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = F.char_length(t).cast("long")
    plain = F.struct(
        (F.char_length(F.translate(t, SPACES, ""))).cast("long").alias("word_chars"),
        (size - F.char_length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
    )
    return docs.withColumn("_quality", F.struct(_word_measures(t).alias("w"), _line_measures(t).alias("l"), plain.alias("c")))


#: where each measure stands in ``_quality``
_PLACE = {"n_words": "w", "n_repeat_words": "w", "n_stop_words": "w", "n_lines": "l", "n_dup_lines": "l", "n_ellipsis_lines": "l", "n_bullet_lines": "l", "word_chars": "c", "n_symbols": "c"}


def _measure(name: str) -> Column:
    return F.col(f"_quality.{_PLACE[name]}.{name}")


def base_failed() -> Column:
    return (_measure("n_words") < MIN_WORDS) | (100 * _measure("n_repeat_words") > MAX_REPEAT_PERCENT * _measure("n_words"))


def passes(rules=None) -> Column:
    """The table's verdict, one conjunction."""
    ok = F.lit(True)
    for _, part, whole, least, most in RULES if rules is None else rules:
        if least is not None:
            ok = ok & (100 * _measure(part) >= least * _measure(whole))
        if most is not None:
            ok = ok & (100 * _measure(part) <= most * _measure(whole))
    return ok


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measures(docs.select("doc_id", "text")).select("doc_id", *(_measure(n).alias(n) for n in names), base_failed().alias("base_failed"), (~base_failed() & passes()).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    rows = docs.select(F.struct("*").alias("d"), F.col("text"))
    return measures(rows).where(~base_failed() & passes()).select("d.*")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tok AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM m),
tri AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM tri WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
q AS (SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(list_filter(w, lambda x: translate(x, '{UPPER}', '{UPPER.lower()}') IN ({repr(STOP_WORDS)[1:-1]}))) AS BIGINT) AS n_stop_words,
             CAST(len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS BIGINT) AS n_ellipsis_lines,
             CAST(len(list_filter(l, lambda x: ltrim(x, ' ') LIKE '- %' OR ltrim(x, ' ') LIKE '* %' OR ltrim(x, ' ') LIKE '•%')) AS BIGINT) AS n_bullet_lines
      FROM m LEFT JOIN cov ON cov.doc_id = m.doc_id),
j AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(f"100 * {a} {op} {x} * {b}" for _, a, b, lo, hi in RULES for op, x in ((">=", lo), ("<=", hi)) if x is not None)}) AS kept
FROM j
"""
