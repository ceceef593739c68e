"""Personal data: base patterns, and disguises undone without losing the place in the source.

``base_spans`` finds emails, IPv4 addresses, card and phone numbers as they stand. ``spans``
adds what small transducers uncover, each carrying source offsets along:

1. zero-width characters are dropped, with a map of what is left;
2. homoglyphs and digits of other scripts become ASCII, one for one; where, is remembered;
3. " at ", "(at)", "[dot]" and the like, around labels, become "@" and ".";
4. runs of spelled digits, with "plus" and "dot" among them, become digits.

What the base patterns find in the normalised text is mapped back to source characters and
added, unless it lies in a base span of its kind or meets one without containing it. A bare
" at " or "@" counts as disguised only with a disguised dot after it (a name, in brackets, or
with a blank before it), with a character of step 1 or 2 in the sign or the domain, or, for " at ",
after a name with a letter and a digit, "." or "_"; so that plain prose stays. A plain name
(jane at example.com) is therefore not found.

Null texts are empty. Repeated rows are searched each. Columns of other names are left alone.
An empty table gives none. Scans are linear in the text, whatever its length, but for a
logarithm where added spans are held against base ones. No shuffle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
# tried at the start of a run of digits: a match that fails there fails all along the run
DIGITS = re.compile("[0-9]+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9\-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        start = at
        if m:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            yield 0, start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(s: str) -> bool:
    return 9 <= len(DIGIT.findall(s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = list(_emails(text)) if "@" in text else []
    ips, cards, ip_end, card_end = [], [], 0, 0
    for run in DIGITS.finditer(text):
        at = run.start()
        if at >= ip_end and (m := IP.match(text, at)):
            ip_end = m.end()
            if _ip_ok(m[0]):
                ips.append((1, at, ip_end))
        if at >= card_end and (m := CARD.match(text, at)):
            card_end = m.end()
            if card_end - at >= 13 and _card_ok(m[0]):
                cards.append((2, at, card_end))
    out += ips + cards
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if _phone_ok(m[0])]
    return out


#: Letters of other scripts that look like these Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "ց": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "ν": "v", "ι": "i", "κ": "k", "α": "a", "ρ": "p", "υ": "u", "Ο": "O", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
ZERO_WIDTH = "​‌‍⁠﻿­᠎"
#: Digit names of the four languages.
DIGIT_NAMES = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_NAMES = "(?:" + "|".join(sorted(DIGIT_NAMES, key=lambda s: (-len(s), s))) + ")"
_WORD = rf"(?<![^\W_]){_NAMES}(?![^\W_])"
_ITEM = rf"(?:{_WORD}|[0-9])"
_DOT_WORD = r"(?:dot|punkt|punto|point)"
_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_BOXED_DOT = rf"{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}"
_SEP = rf"(?:{_BOXED_DOT}|[ \t]{{1,2}}{_DOT_WORD}[ \t]{{1,2}}|[ \t]?[-.,()][ \t]?|[ \t]{{1,2}})"
TWO_NAMES = re.compile(rf"{_WORD}{_SEP}{_ITEM}|[0-9]{_SEP}{_WORD}", re.I)
RUN = re.compile(rf"(?:(?:\+|(?<![^\W_])plus(?![^\W_]))[ \t]?)?\(?{_ITEM}(?:{_SEP}?{_ITEM})*+", re.I)
PIECE = re.compile(rf"(?P<name>{_WORD})|(?P<boxed>{_BOXED_DOT})|(?P<dot>[ \t]*{_DOT_WORD}[ \t]*)|(?P<plus>(?:plus|\+)[ \t]*)|(?P<gap>[ \t]+)|(?P<other>.)", re.I | re.S)
AT = re.compile(rf"(?P<boxed>{_OPEN}(?:at|@|arroba|arobase|ät){_CLOSE})|(?P<bare>[ \t]+at[ \t]+|[ \t]*@[ \t]*)", re.I)
_DOT_HIDDEN = rf"(?:{_BOXED_DOT}|[ \t]+{_DOT_WORD}[ \t]+|[ \t]+\.(?=[A-Za-z0-9]))"
_LABEL = r"[A-Za-z0-9-]++"
REST = re.compile(rf"{_LABEL}(?:(?P<hidden>{_DOT_HIDDEN})|\.)(?:{_LABEL}(?:(?P<hidden2>{_DOT_HIDDEN})|\.)(?=[A-Za-z0-9-]))*+{_LABEL}", re.I)
DOMAIN_END = re.compile(r"[A-Za-z]{2,}\Z")
#: A name that no plain word is: a letter, and a digit or a mark within.
NAMELIKE = re.compile(r"(?=.*[A-Za-z])[A-Za-z0-9]+[._0-9][A-Za-z0-9._%+-]*\Z")
#: Words and brackets without which there is no disguise to look for
DOT_NAMES = frozenset(_DOT_WORD[3:-1].split("|"))
BOXES = re.compile(r"[\[({<][ \t]*(?:at|@|arroba|arobase|ät|dot|punkt|punto|point|\.)[ \t]*[\])}>]", re.I)


@lru_cache(1)
def glyphs() -> tuple[dict[int, str], frozenset[str]]:
    """Characters that stand for one ASCII letter, digit or mark, and the set of them."""
    table = dict(LOOKALIKES)
    for block in ((0x2070, 0x209D), (0x2460, 0x2474), (0x24B6, 0x24EB), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for c in map(chr, range(*block)):
            n = unicodedata.normalize("NFKC", c)
            if len(n) == 1 and n.isascii():
                table[c] = n
    for code in range(0x660, 0x1E960):
        c = chr(code)
        if c not in table and not c.isascii() and unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.decimal(c))
    return {ord(a): b for a, b in table.items()}, frozenset(table)


def _blanks_before(text: str, at: int, free: int) -> int:
    while at > free and text[at - 1] in " \t":
        at -= 1
    return at


def _dot_before(text: str, at: int, free: int) -> int | None:
    """Where the disguised dot begins that ends at ``at``."""
    i = _blanks_before(text, at, free)
    boxed = i > free and text[i - 1] in "])}>"
    if boxed:
        i = _blanks_before(text, i - 1, free)
    elif i == at:
        return None
    word = next((w for w in DOT_NAMES if text[max(free, i - len(w)) : i].lower() == w), "." if boxed and text[i - 1 : i] == "." else None)
    if word is None:
        return None
    i -= len(word)
    j = _blanks_before(text, i, free)
    if boxed:
        return _blanks_before(text, j - 1, free) if j > free and text[j - 1] in "[({<" else None
    return j if j < i else None


def _hidden_emails(text: str, changed: list[int]):
    """Emails one of whose signs is disguised; ``changed``: places that were normalised, in order."""
    free = 0
    for m in AT.finditer(text):
        rest = REST.match(text, m.end())
        if m.start() < free or not rest:
            continue
        start = m.start()
        while True:
            run = start
            while run > free and text[run - 1] in LOCAL:
                run -= 1
            if run == start:
                break
            start = run
            dot = _dot_before(text, start, free)
            if dot is None or dot == free or text[dot - 1] not in LOCAL:
                break
            start = dot
        hidden = m["boxed"] is not None or rest["hidden"] is not None or rest["hidden2"] is not None
        hidden = hidden or bisect_left(changed, rest.end()) > bisect_left(changed, m.start())
        hidden = hidden or "@" not in m[0] and NAMELIKE.match(text[start : m.start()]) is not None
        last = DOMAIN_END.search(text, m.end(), rest.end())
        if hidden and start < m.start() and last and last[0].lower() not in DOT_NAMES:
            yield 0, start, rest.end()
            free = rest.end()


def _spelled(text: str):
    """Numbers in runs with spelled digits or boxed dots. A gap beside a spelled digit goes."""
    for run in RUN.finditer(text):
        norm: list[str] = []
        place: list[tuple[int, int]] = []
        hidden, gap, named = False, None, False
        for p in PIECE.finditer(text, run.start(), run.end()):
            if p["gap"]:
                gap = p.span()
                continue
            name = bool(p["name"])
            if gap and not named and not name:
                norm.append(" ")
                place.append(gap)
            gap, named = None, name
            hidden |= name or bool(p["boxed"])
            norm.append(str(DIGIT_NAMES[p["name"].lower()]) if name else "." if p["dot"] or p["boxed"] else "+" if p["plus"] else p["other"])
            place.append(p.span())
        if hidden:
            for kind, a, b in base_spans("".join(norm)):
                yield kind, place[a][0], place[b - 1][1]


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by kind, then start; code points, end exclusive."""
    text = text or ""
    base = base_spans(text)
    found: list[tuple[int, int, int]] = []
    clean, place = text, None
    changed: list[int] = []
    if not text.isascii():
        table, some = glyphs()
        if any(z in text for z in ZERO_WIDTH):
            place = [i for i, c in enumerate(text) if c not in ZERO_WIDTH]
            clean = "".join(text[i] for i in place)
            changed = [k for k in range(1, len(place)) if place[k] > place[k - 1] + 1]
        if not some.isdisjoint(clean):
            changed = sorted({*changed, *(k for k, c in enumerate(clean) if c in some)})
            clean = clean.translate(table)
        if clean is not text:
            found += base_spans(clean)
    words = set(clean.lower().replace("-", " ").replace(",", " ").replace(".", " ").split())
    boxed = ("[" in clean or "(" in clean or "{" in clean or "<" in clean) and BOXES.search(clean)
    if boxed or "at" in words or "@" in clean:
        found += _hidden_emails(clean, changed)
    if boxed or not words.isdisjoint(DIGIT_NAMES) and TWO_NAMES.search(clean):
        found += _spelled(clean)
    if place is not None:
        found = [(k, place[a], place[b - 1] + 1) for k, a, b in found]
    return base, _with(base, sorted(set(found) - set(base), key=lambda s: (s[0], s[1], -s[2])))


def _with(base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans, and those found that contain all base spans of their kind that they meet and
    do not meet one added before. Base spans of a kind do not overlap."""
    extra: list[tuple[int, int, int]] = []
    kind, starts, ends = -1, [], []
    for k, a, b in found:
        if k != kind:
            kind, own = k, [s for s in base if s[0] == k]
            starts, ends = [s[1] for s in own], [s[2] for s in own]
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        if (i >= j or a <= starts[i] and ends[j - 1] <= b) and not (extra and extra[-1][0] == k and a < extra[-1][2]):
            extra.append((k, a, b))
    return sorted(base + extra)


def show(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): the counts are of
    base spans; ``spans`` lists all, ``n_added`` counts those that the method adds."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in batches:
            counts, sha, shown, added = [[], [], [], []], [], [], []
            for t in b.column(1).to_pylist():
                base, every = spans(t)
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(show(base).encode()).hexdigest())
                shown.append(show(every))
                added.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(shown, pa.string()), pa.array(added, pa.int64())], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names))


def masked(text: str) -> str:
    """The text with every span replaced by its kind in capitals; spans that meet become one."""
    out, at, done = [], 0, -1
    for a, b, k in sorted((a, -b, k) for k, a, b in spans(text)[1]):
        if a >= max(at, done):
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = done = -b
        elif -b > done:
            at = done = -b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars`` of what is left."""
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            text = [t if t is None else masked(t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, "text", pa.array(text, b.schema.field(at).type))

    out = map_batches(docs, run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
