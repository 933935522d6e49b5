"""Tokenizing whole texts with the `tokenizers` library, pre-tokens remembered.

Byte-level BPE encodes each pre-token (a word with the space before it, a run of
digits or signs) on its own. Texts are cut into pre-tokens by array operations on
their characters; those that a worker has met before come from a bounded memory and
only new ones go to the library. A text that holds an added token such as
<|endoftext|> goes to the library whole, and so does every text if the file has a
normalizer or another pre-tokenizer. The ids equal those of one call over the whole
text with the library's defaults (tested).
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
MEMORY = 800_000  # pre-tokens that a worker remembers
PART = 1 << 20  # bytes of text that are cut at once; a longer text is one part

SIGN, LETTER, NUMBER, SPACE = range(4)
# Endings that the byte-level pre-tokenizer cuts off behind an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_encoders: dict[tuple[str, int], "WordEncoder"] = {}


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, memory: int = MEMORY) -> "WordEncoder":
    """One encoder for each worker process and file."""
    if (path, memory) not in _encoders:
        _encoders[path, memory] = WordEncoder(path, memory)
    return _encoders[path, memory]


def character_classes(tok) -> np.ndarray:
    """SIGN, LETTER, NUMBER or SPACE of each code point, as the library's pre-tokenizer has them.

    It cuts a text of all code points at each change of class, so one question per run is enough."""
    cut = tok.pre_tokenizer.pre_tokenize_str

    def of(c: str) -> int:
        if len(cut("a" + c)) == 1:
            return LETTER
        if len(cut("1" + c)) == 1:
            return NUMBER
        return SIGN if len(cut("!" + c)) == 1 else SPACE

    table = np.zeros(0x110000, np.uint8)
    table[:256] = [of(chr(i)) for i in range(256)]
    points = np.array([i for i in range(256, 0x110000) if not 0xD800 <= i < 0xE000])
    for _, (start, end) in cut(points.astype("<u4").tobytes().decode("utf-32-le")):
        table[points[start:end]] = of(chr(points[start]))
    return table


def cuts(chars: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: flags over the characters of many texts, whose first characters are flagged in first.

    A run of letters, numbers or signs is one, with a plain space before it. Of
    longer white space the last character stands apart if something follows. An
    apostrophe that begins one takes a listed ending with it and no more."""
    n = len(chars)
    space = kind == SPACE
    before = np.empty(n, bool)
    before[:1], before[1:] = True, space[:-1]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    plain = np.zeros(n, bool)  # a plain space stands before, in the same text
    plain[1:] = (chars[:-1] == 32) & ~first[1:]
    begin = first | (change & ~plain)
    ends = np.ones(n + 1, bool)
    ends[:n] = first
    # the last of longer white space, if something follows in the same text
    last = np.zeros(n, bool)
    last[1:-1] = space[1:-1] & before[1:-1] & ~first[1:-1] & ~space[2:] & ~first[2:]
    begin |= last
    # a white space character that isn't a plain space ends before what follows
    begin[1:] |= space[:-1] & ~space[1:] & (chars[:-1] != 32)
    quote = np.flatnonzero((chars == 39) & begin)
    if len(quote):
        behind = np.concatenate([chars, np.zeros(3, chars.dtype)])
        same = lambda at, k: ~ends[np.minimum(at + k, n)]
        for ending in ENDINGS:
            hit = np.ones(len(quote), bool)
            for k, c in enumerate(ending, 1):
                hit &= (behind[quote + k] == ord(c)) & same(quote, k)
            at = quote[hit]
            for k in range(1, len(ending) + 1):
                begin[at + k] = False
            after = at + len(ending) + 1
            inner = after[after < n]
            begin[inner] |= ~space[inner] | first[inner] | begin[inner]
    return begin


class WordEncoder:
    """Ids of whole texts as unsigned 32-bit integers; null texts count as empty.

    memory bounds the remembered pre-tokens; when it is full it is forgotten, which
    changes the speed and nothing else.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        way = made.get("pre_tokenizer") or {}
        model = made.get("model") or {}
        usual = way.get("type") == "ByteLevel" and way.get("use_regex", True) and not way.get("add_prefix_space")
        #: whether pre-tokens are encoded one by one and cut as cuts() does
        self.by_parts = bool(usual and not made.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not made.get("truncation"))
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.n_ids = max(vocab.values()) + 1
        self.spaced = np.zeros(self.n_ids, dtype=bool)
        self.spaced[[i for s, i in vocab.items() if s.startswith("Ġ")]] = True
        self.line = vocab.get("Ċ", -1)
        self.classes = character_classes(self.tok) if self.by_parts else None
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.used = 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, by the library alone."""
        return [x.astype("<u4").tobytes() for x in self._library(texts)]

    def pieces(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, by pre-tokens."""
        ids, ends = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]

    def _remember(self, parts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, m = len(self.known), len(parts)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n : n + m] = self.used + np.cumsum(size) - size
        self.size[n : n + m] = size
        self.used += len(ids)
        self.known.update(zip(parts, range(n, n + m)))

    def _learn(self, parts: list[str], run: int = 1024) -> None:
        """New pre-tokens go to the library in runs of text, told apart in its ids: one that begins with a space and another character begins a
        token with a space; others are given with a line feed between them; white space, and what can't be told apart, alone."""
        blank = [p for p in parts if p.isspace() or not p.strip() or "\n" in p]
        rest = set(parts).difference(blank) if blank else parts
        kinds = {True: [], False: []}
        for p in rest:
            kinds[p[0] == " "].append(p)
        for spaced, some_kind in kinds.items():
            for k in range(0, len(some_kind), run):
                some = some_kind[k : k + run]
                ids = self._library(["".join(some) if spaced else "\n".join(["", *some])])[0]
                mark = self.spaced[ids] if spaced else ids == self.line
                at = np.flatnonzero(mark)
                if len(at) == len(some) and at[0] == 0:
                    size = np.diff(np.append(at, len(ids)))
                    self._remember(some, *((ids, size) if spaced else (ids[~mark], size - 1)))
                else:
                    blank += some
        if blank:
            found = self._library(blank)
            self._remember(blank, np.concatenate(found), np.array([len(x) for x in found]))

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's ids begin and the last end) of the texts data[offsets[i]:offsets[i + 1]] (UTF-8)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.known) > self.memory:
            self._forget()
        ascii_only = not (data & 0x80).any()
        if ascii_only:
            chars, place = data, None
        else:
            chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            place = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[chars]
        starts = offsets[:-1][np.diff(offsets) > 0]
        first = np.zeros(len(chars), bool)
        first[starts if ascii_only else np.searchsorted(place, starts)] = True
        begin = np.flatnonzero(cuts(chars, kind, first))
        if not ascii_only:
            begin = place[begin]
        bounds = np.append(begin, len(data))
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = words.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist()
        number = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            new = [different[i] for i in missing]
            self._learn(new)
            number[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        which = number[coded.indices.to_numpy()]
        size = self.size[which]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[which] - ends + size, size) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(begin, offsets)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts in a row, where each text's ids begin and the last end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.full(len(texts), not self.by_parts)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if whole.any():
            rest = self.encode_parts(pc.if_else(pa.array(whole), "", texts))
            pieces = np.split(rest[0], rest[1][1:-1])
            for i, ids in zip(np.flatnonzero(whole).tolist(), self._library(texts.filter(pa.array(whole)).to_pylist())):
                pieces[i] = ids
            return np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])
        return self.encode_parts(texts)

    def encode_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts without added tokens."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        ids, ends, i, base = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0, 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, "right")) - 1)
            some, at = self._part(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(some), ends.append(at[1:] + base)
            i, base = j, base + int(at[-1])
        return np.concatenate(ids), np.concatenate(ends)
