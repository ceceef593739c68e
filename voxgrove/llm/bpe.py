"""Byte-level BPE by a lazily determinised transducer, and its streaming inverse.

Encoding. A rank file's tokens are kept if the merges reproduce them. Two kept tokens may
stand next to each other iff merging their joined bytes gives the two again; a sequence is
the BPE encoding of its bytes iff all its neighbours may stand so. Read left to right
this is a nondeterministic transducer: each hypothesis is the one encoding up to some place
and a token begun there. ``Transducer`` determinises it on demand. The begun tokens that
live are suffixes of each other, so one trie node stands for all of them; a transition is
made when it is first taken. Registers hold the last token of the encoding up to each place
where a begun token may start, no further back than the longest token. What all live hypotheses
agree on is emitted. Transitions and known pairs are remembered under a bound.

Decoding. ``Utf8Decoder`` takes ids one by one or in runs and emits text as soon as its
characters are complete; its state is the bytes of one unfinished character. Ill-formed
bytes become U+FFFD like bytes.decode(errors="replace").

The cutting of texts into chunks that are remembered holds for the default pattern; with any
other, every text is matched as a whole.

A null text is empty: no ids, empty digests. Rows repeat as they are; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Bounds of what one Python worker remembers.
MAX_STATES, MAX_PAIRS, MAX_CHUNKS = 400_000, 600_000, 300_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merge(ranks: dict[bytes, int], text: bytes, leave: int = 1) -> list[bytes]:
    """The definition: join the neighbours whose union has the lowest rank, leftmost first,
    until ``leave`` parts are left."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > leave:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """The determinised machine: ``encode`` one pretoken's bytes into ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocabulary = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: the tokens' trie: node << 8 | byte to node; by node its depth and its token
        self.child: dict[int, int] = {}
        self.depth, self.token = [0], [-1]
        self.halves: dict[int, tuple[int, int]] = {}
        parent = [(0, 0)]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.token)
                    parent.append((node, byte))
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = nxt
            #: the two parts that the last merge of a token joins
            halves = merge(ranks, t, 2)
            if len(halves) == 1:
                self.token[node], self.halves[i] = i, (i, i)
            elif len(halves) == 2:
                self.token[node], self.halves[i] = i, (ranks[halves[0]], ranks[halves[1]])
        #: by node, the longest proper suffix that is a node: the next younger hypothesis
        self.younger = [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=self.depth.__getitem__):
            up, byte = parent[node]
            while up:
                up = self.younger[up]
                if (got := self.child.get(up << 8 | byte)) is not None:
                    self.younger[node] = got
                    break
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(parent)
        self.step: list[dict[int, int] | None] = [None] * len(parent)
        self.step[0] = {}
        self.before: dict[int, dict[int, bool]] = {i: {} for i in self.vocabulary}
        self.n_steps = self.n_pairs = 0

    def advance(self, state: int, byte: int) -> int:
        """The transition, made when first needed: the oldest hypothesis that lives on."""
        if self.n_steps >= MAX_STATES:
            self.step = [None if x is None else {} for x in self.step]
            self.n_steps = 0
        self.n_steps += 1
        node = state
        while (to := self.child.get(node << 8 | byte)) is None and node:
            node = self.younger[node]
        to = self.step[state][byte] = to or 0
        if self.step[to] is None:
            self.step[to] = {}
        if self.ends[to] is None:
            found, node = [], to
            while node:
                if (t := self.token[node]) >= 0:
                    found.append((self.depth[node], t, self.before[t]))
                node = self.younger[node]
            self.ends[to] = tuple(found)
        return to

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses between the tokens: undo the merges along the seam, latest
        first, and see that none of the pairs that met there would have been joined sooner."""
        if self.n_pairs >= MAX_PAIRS:
            for d in self.before.values():
                d.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known, x, y, limit = self.before[b], a, b, 1 << 62
        ranks, text, halves = self.ranks, self.vocabulary, self.halves
        while True:
            joined = ranks.get(text[x] + text[y])
            if joined is not None and joined < limit:
                known[a] = False
                return False
            left, right = halves[x][1], halves[y][0]
            if left == x and right == y:
                known[a] = True
                return True
            # undo the later of the two last merges; of equals, the right one came later
            if right == y or left != x and x > y:
                limit, x = x, left
            else:
                limit, y = y + 1, right

    def encode(self, text: bytes) -> list[int]:
        out: list[int] = []
        last, size = [-1], [0]  # register i: last token of the encoding of the first i bytes
        state, step, ends = 0, self.step, self.ends
        for byte in text:
            to = step[state].get(byte)
            if to is None:
                to = self.advance(state, byte)
                step = self.step
            state = to
            for n, t, known in ends[state]:
                p = last[-n]
                if p >= 0:
                    ok = known.get(p)
                    if ok or ok is None and self.fits(p, t):
                        break
                elif p == -1:
                    break
            else:
                n, t = 0, -2  # no encoding ends here
            last.append(t)
            size.append(n)
            if len(last) > 8 * self.longest:
                self.emit(out, last, size, self.depth[state])
        if last[-1] == -2:
            raise ValueError("the ranks lack a single byte of the text")
        return out + self.back(last, size, len(last) - 1)

    @staticmethod
    def back(last: list[int], size: list[int], at: int) -> list[int]:
        run = []
        while at:
            run.append(last[at])
            at -= size[at]
        return run[::-1]

    def emit(self, out: list[int], last: list[int], size: list[int], oldest: int) -> None:
        """Emit what the encodings up to every place where a live token began have in common,
        and forget the registers before it."""
        runs = [self.back(last, size, at) for at in range(len(last) - 1 - oldest, len(last)) if last[at] != -2]
        n = 0
        while all(len(r) > n for r in runs) and len({r[n] for r in runs}) == 1:
            n += 1
        if n:
            out += runs[0][:n]
            cut = sum(len(self.vocabulary[t]) for t in runs[0][:n])
            del last[:cut], size[:cut]
            last[0], size[0] = runs[0][n - 1], 0


class Utf8Decoder:
    """Ids to text and bytes, incrementally; the state is an unfinished character."""

    def __init__(self, vocabulary: list[bytes]):
        self.vocabulary = vocabulary
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> tuple[bytes, str]:
        """The bytes of ``ids``, and the text that they complete."""
        b = b"".join(map(self.vocabulary.__getitem__, ids))
        return b, self.state.decode(b)

    def finish(self) -> str:
        return self.state.decode(b"", True)


_JOINED = re.compile(r"\s\s|\A\s|\s\Z")
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")


def chunks(text: str) -> tuple[str, list[str]]:
    """(first, rest): ``text`` is first + rest, where an item of rest that does not begin with
    a newline has lost a space before it. Cut where a lone space or newline begins, which is a
    boundary of any pattern whose words take one space before them and whose white space leaves
    the last one to what follows."""
    if not text:
        return "", []
    if not _JOINED.search(text):
        first, *rest = text.replace("\n", " \n").split(" ")
        return first, rest
    first, *rest = _SAFE.split(text)
    return first, [x[1:] if x[0] == " " else x for x in rest]


class ChunkCache(dict):
    """Packed ids of what ``chunks`` gives, computed once per chunk. Of two generations the
    older one goes when the younger is full, so that common chunks stay."""

    def __init__(self, encode, width: str):
        super().__init__()
        self.encode, self.width, self.old = encode, width, {}

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part)
        if got is None:
            got = np.array(self.encode(part if part[0] == "\n" else " " + part), self.width).tobytes()
            if len(part) > 200:
                return got
        if len(self) >= MAX_CHUNKS:
            self.old = dict(self)
            self.clear()
        self[part] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.width)
        first, rest = chunks(text)
        head = np.array(self.encode(first) if first else [], self.width).tobytes()
        return np.frombuffer(head + b"".join(map(self.__getitem__, rest)), self.width)


class Codec:
    """Text to ids and back for one rank file and split pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = load_ranks(ranks_path)
        self.machine = Transducer(self.ranks)
        # White space as Unicode has it, without the four separators that Python adds
        exact = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split = regex.compile(exact).findall
        self.vocabulary = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, i in self.ranks.items():
            self.vocabulary[i] = t
        self.cache = ChunkCache(self.encode_chunk, "<u4")
        # texts are cut into chunks, and words taken for one match, by what is known of one pattern
        self.cuts = pattern == default_pattern()

    def encode_chunk(self, text: str) -> list[int]:
        encode, body = self.machine.encode, text[1:]
        if text[0] == " ":  # letters after one space are one match of the pattern, a mark after them another
            if body.isalpha():
                return encode(text.encode())
            if text[-1] in ".,;:!?" and body[:-1].isalpha():
                return np.frombuffer(self.cache[body[:-1]], "<u4").tolist() + encode(text[-1].encode())
        words = self.split(text)
        return [i for w in words for i in encode(w.encode("utf-8", "replace"))]

    def encode(self, text: str | None) -> np.ndarray:
        if self.cuts:
            return self.cache.ids(text or "")
        return np.array([i for w in self.split(text or "") for i in self.machine.encode(w.encode("utf-8", "replace"))], "<u4")

    def decode(self, ids) -> tuple[bytes, str]:
        d, raw, text = Utf8Decoder(self.vocabulary), [], []
        for i in range(0, len(ids), 1 << 16):
            b, t = d.push(ids[i : i + (1 << 16)].tolist())
            raw.append(b)
            text.append(t)
        return b"".join(raw), "".join(text) + d.finish()


@lru_cache(1)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every text. No shuffle."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            at = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes binary, text string) of every (doc_id, ids). No shuffle."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            both = [c.decode(np.array(x or [], "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.string())], ["doc_id", "bytes", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary, text string")


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both ways in one pass over the texts."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        c, sha = codec(ranks_path, pattern), hashlib.sha256
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                # what the streaming decoder gives back, not the tokens' bytes
                _, text = c.decode(ids)
                rows.append((len(ids), sha(ids.tobytes()).hexdigest(), sha(text.encode()).hexdigest()))
            n, x, y = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
