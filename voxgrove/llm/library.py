"""Batch encoding with a file of the ``tokenizers`` library, each distinct chunk once."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import chunks

#: Words of one generation that a worker keeps.
MAX_CHUNKS = 250_000

#: Words that the library gets as one text.
JOIN = 400
#: Texts that are not cut at single white space: it meets, or stands at an end, or a NUL is there.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ODD = rf"{_SPACE}{_SPACE}|\A{_SPACE}|{_SPACE}\z|\x00"
NUL, EMPTY = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
#: Letters, then ASCII marks other than an apostrophe: two matches of a word-wise pattern.
MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


class LibraryEncoder:
    """``column(texts)``: what encode(text, add_special_tokens=False) gives, as packed arrays.

    A text is cut at lone spaces and newlines, where no token of a word-wise tokenizer
    reaches across; the library encodes the chunks that are not yet known, words many at a
    time. The strings of special tokens are ordinary text. Known chunks are kept in two
    generations, of which the older one goes when the younger is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        #: whether white space is dropped and case folded
        self.spaceless = self.library.encode(" AB\nc").ids == [i for w in ("ab", "c") for i in self.library.encode(w, add_special_tokens=False).ids]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        """Each text on its own."""
        return [np.array(e.ids, self.width).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_words(self, words: list[str]) -> None:
        """Words of letters, each with a space before it: the library's word numbers divide the ids."""
        known, size = self.known, np.dtype(self.width).itemsize
        groups = [words[i : i + JOIN] for i in range(0, len(words), JOIN)]
        for group, e in zip(groups, self.library.encode_batch([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            number = np.array(e.word_ids)
            cuts = np.r_[0, np.flatnonzero(np.diff(number)) + 1, len(number)]
            if len(cuts) - 1 != len(group):  # some word is more than one match: each on its own
                known.update(zip(group, self.plain([" " + w for w in group]), strict=True))
                continue
            raw = np.array(e.ids, self.width).tobytes()
            at = (cuts * size).tolist()
            known.update({w: raw[i:j] for w, i, j in zip(group, at, at[1:], strict=False)})

    def learn(self, parts: list[str]) -> list[bytes]:
        """The packed ids of each of ``parts``; a NUL before a part says that it stands as it is,
        with nothing before it. Words with marks after them are put together, not kept; where
        the tokenizer drops white space and case, so do the words that are kept."""
        known, old = self.known, self.old
        words, others = set(), []
        keys: list[str] = []
        ends: dict[int, str] = {}
        for p in parts:
            if self.spaceless:
                if p[0] in "\0\n":
                    p = p[1:]
                if p.isascii():
                    p = p.lower()
            if p not in known:
                if p.isalpha():
                    w = p
                elif m := MARKED(p):
                    w, ends[len(keys)] = m.groups()
                else:
                    w = None
                    if (got := old.get(p)) is not None:
                        known[p] = got
                    else:
                        others.append(p)
                if w is not None:
                    p = w
                    if p not in known:
                        if (got := old.get(p)) is not None:
                            known[p] = got
                        else:
                            words.add(p)
            keys.append(p)
        self.learn_words(list(words))
        if fresh := list(set(ends.values()) - self.marks.keys()):
            self.marks.update(zip(fresh, self.plain(fresh), strict=True))
        known.update(zip(others, self.plain([p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p for p in others]), strict=True))
        out = [known[k] for k in keys]
        for i, m in ends.items():
            out[i] += self.marks[m]
        return out

    def forget(self) -> None:
        if len(self.known) > MAX_CHUNKS:
            self.old, self.known = self.known, {}
        if len(self.marks) > MAX_CHUNKS:
            self.marks = {}

    def column(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow column; null is empty."""
        if not len(texts):
            return []
        self.forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        even = pc.if_else(pa.array(odd), EMPTY, texts)
        parts = pc.split_pattern(pc.binary_join_element_wise(NUL, pc.replace_substring(even, "\n", " \n"), EMPTY), " ")
        coded = parts.flatten().dictionary_encode()
        distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        raw = self.learn(distinct)
        flat = np.frombuffer(b"".join(raw), self.width)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(self.width).itemsize
        starts = np.cumsum(sizes) - sizes
        n = sizes[place]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[place] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.r_[0, ends][parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        out = [ids[i:j] for i, j in pairwise(cuts.tolist())]
        for i in np.flatnonzero(odd):
            out[i] = self.one(texts[i].as_py())
        return out

    def one(self, text: str) -> np.ndarray:
        """A text in which white space meets, or stands at an end."""
        self.forget()
        first, rest = chunks(text)
        rest = [p for p in rest if p]
        # chunks that begin with NUL would be taken for marked ones
        plain = [p for p in rest if p[:1] != "\0"]
        raw = dict(zip(plain, self.learn(plain), strict=True))
        raw |= {p: self.plain([" " + p])[0] for p in set(rest) - raw.keys()}
        return np.frombuffer(self.plain([first])[0] + b"".join(map(raw.__getitem__, rest)), self.width)


def by_size(batches, size: int = 1 << 23):
    """(first column, texts) of Arrow batches, together while the texts have few bytes."""
    ids, texts, held = [], [], 0
    for b in batches:
        ids.append(b.column(0))
        texts.append(b.column(1))
        held += b.column(1).nbytes
        if held >= size:
            yield pa.concat_arrays(ids), pa.concat_arrays([t.cast(pa.large_string()) for t in texts])
            ids, texts, held = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays([t.cast(pa.large_string()) for t in texts])


@lru_cache(2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)
