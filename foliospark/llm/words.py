"""Words as dense numbers, so that per-word work (hashing, tokenising) is done once for each distinct word.

Words are the runs of non-space bytes: ``bytes.split()`` splits at x20 and x09-x0D alone, which is the
contract's ``[^\\x20\\x09-\\x0D]+``. Caches are dropped when they reach ``LIMIT`` words, so a worker's memory is
bounded however many distinct words the corpus has.
"""

from __future__ import annotations

import functools

import numpy as np

LIMIT = 600_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 0x20
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTHS = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
_INLINE = 40


class WordIndex(dict):
    """Word to dense number; new words are appended to ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        self[word] = n
        self.fresh.append(word)
        return n


class Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def extend(self, values) -> None:
        values = np.asarray(values, self.data.dtype)
        need = self.n + len(values)
        if need > len(self.data):
            more = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : need] = values
        self.n = need


class Words:
    """Numbers words; ``learn(fresh)`` of a subclass adds what it keeps for each new word."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.index = WordIndex()

    def learn(self, fresh: list[bytes]) -> None:
        raise NotImplementedError

    def number(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of several texts, end to end, and the bounds of each text."""
        if len(self.index) > LIMIT:
            self.reset()
        bounds = np.zeros(len(split) + 1, np.int64)
        np.cumsum([len(x) for x in split], out=bounds[1:])
        get = self.index.__getitem__
        out = np.empty(bounds[-1], np.int32)
        for k, words in enumerate(split):
            if words:
                out[bounds[k] : bounds[k + 1]] = np.fromiter(map(get, words), np.int32, len(words))
        if self.index.fresh:
            fresh, self.index.fresh = self.index.fresh, []
            self.learn(fresh)
        return out, bounds


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class TokenWords(Words):
    """Token ids of each word, kept flat."""

    dtype = np.int32

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def reset(self) -> None:
        super().reset()
        self.flat, self.start, self.length = Grown(self.dtype), Grown(np.int64), Grown(np.int64)

    def learn(self, fresh: list[bytes]) -> None:
        ids = self.encode_words(fresh)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start.extend(self.flat.n + np.cumsum(lengths) - lengths)
        self.length.extend(lengths)
        self.flat.extend(np.fromiter((x for i in ids for x in i), self.dtype, int(lengths.sum())))

    def tokens(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts, end to end, and the bounds of each text."""
        return self.expanded(*self.number(split))

    def expanded(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for word numbers."""
        lengths = self.length.data[numbers]
        ids = self.flat.data[spread(self.start.data[numbers], lengths)]
        ends = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        return ids, ends[bounds]


class WordBpe(TokenWords):
    """Ids of a lower-casing, white-space-dropping BPE vocabulary with word ends (``</w>``).

    Its pre-tokeniser never joins over white space, so a text's ids are those of its words in turn, and those of a
    word are those of the parts that the pre-tokeniser cuts: letters, single digits, other characters, and the English
    contractions. In texts of Latin-1 letters, parts are found and hashed by operations on all bytes at once, and
    merging is done once for each distinct part: a byte-pair merger gets the vocabulary's merges as ranks (an end
    marker byte stands for ``</w>``). In any other text each word goes through the tokenizers library itself, once
    too. Tests hold both against the library's ids of whole texts.
    """

    dtype = np.uint16
    #: Control characters, but for white space, are left to the library.
    EVEN_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x100)])
    #: What the pre-tokeniser must be for parts to be found here.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LETTER, DIGIT, OTHER = 1, 2, 3
    END = b"\xff"  # not a byte of UTF-8

    def __init__(self, path: str):
        import json
        import os
        import unicodedata

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tiktoken import _tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.even = split["pattern"]["Regex"] == self.PARTS
        kinds = {"L": self.LETTER, "N": self.DIGIT}
        self.lower = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)
        self.kind = np.array([0 if _BLANK[c] else kinds.get(unicodedata.category(chr(c))[0], self.OTHER) for c in range(256)], np.uint8)
        shown = self._byte_letters()

        def raw(piece: str) -> bytes:
            end = piece.endswith("</w>")
            return bytes(shown[c] for c in (piece[:-4] if end else piece)) + self.END * end

        ranks = {bytes([b]): 1 << 30 | b for b in range(256)}
        ranks |= {bytes([b]) + self.END: b for b in range(256)}
        for n, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ranks[raw(a) + raw(b)] = 256 + n
        special = {x["id"] for x in spec["added_tokens"]}
        self.id_of_rank = {ranks[raw(p)]: i for p, i in spec["model"]["vocab"].items() if i not in special}
        self.merge = _tiktoken.CoreBPE(ranks, {}, r"\S+").encode_single_piece
        super().__init__()

    @functools.cached_property
    def library(self):
        """Loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _byte_letters() -> dict[str, int]:
        """The printable stand-ins of byte-level vocabularies: printable bytes as they are, others from U+0100 on."""
        out, n = {}, 0
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
                out[chr(b)] = b
            else:
                out[chr(256 + n)] = b
                n += 1
        return out

    def _even(self, text: str) -> bytes | None:
        """The text in Latin-1 if its parts can be found here."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if not self.even or raw.translate(None, self.EVEN_BYTES) or b"<|" in raw else raw

    def _parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased texts end to end, where their parts start and end, and the bounds of each text."""
        data = self.lower[np.frombuffer(b"\n".join([*texts, b"   "]), np.uint8)]
        kind = self.kind[data]
        before = np.empty_like(kind)
        before[:1], before[1:] = 0, kind[:-1]
        begins = (kind != 0) & ((kind != before) | (kind == self.DIGIT))
        quotes = np.flatnonzero((data == ord("'")) & begins)
        one, two = data[quotes + 1], data[quotes + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[quotes[short | long] + 1] = False
        for after in (quotes[short] + 2, quotes[long] + 3):
            begins[after] = kind[after] != 0
        cuts = np.flatnonzero(begins | (kind == 0))
        own = np.flatnonzero(begins[cuts])
        starts = cuts[own]
        firsts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=firsts[1:])
        return data, starts, cuts[own + 1], np.searchsorted(starts, firsts)

    def encode_words(self, words: list) -> list[list[int]]:
        """Parts are strings, odd words bytes."""
        name, merge, end = self.id_of_rank, self.merge, self.END
        out = [None if type(w) is bytes else [name[r] for r in merge(w.encode() + end)] for w in words]
        rest = [k for k, w in enumerate(words) if type(w) is bytes]
        if rest:
            for k, e in zip(rest, self.library.encode_batch_fast([words[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def tokens_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts, end to end, and the bounds of each text."""
        even = [self._even(t) for t in texts]
        odd = [t.encode("utf-8", "replace").split() if e is None else [] for t, e in zip(texts, even, strict=True)]
        rest, rest_bounds = self.number(odd)  # also bounds the cache
        data, starts, ends, bounds = self._parts([e or b"" for e in even])
        hashes, first, where = np.unique(span_hashes(data.tobytes() + b"\0" * 8, starts, ends - starts), return_index=True, return_inverse=True)
        index, fresh = self.index, []
        numbers = np.empty(len(hashes), np.int32)
        for k, h in enumerate(hashes.tolist()):
            n = index.get(h)
            if n is None:
                n = index[h] = len(index)
                fresh.append(data[starts[first[k]] : ends[first[k]]].tobytes().decode("latin-1"))
            numbers[k] = n
        if fresh:
            self.learn(fresh)
        numbers = numbers[where]
        if len(rest):
            numbers = np.concatenate([x for k in range(len(texts)) for x in (numbers[bounds[k] : bounds[k + 1]], rest[rest_bounds[k] : rest_bounds[k + 1]])])
        return self.expanded(numbers, bounds + rest_bounds)


class PieceWords(TokenWords):
    """Ids of a sentencepiece vocabulary with byte fallback, each word alone."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.vocab_size()
        self.is_byte = np.array([self.library.is_byte(i) for i in range(self.size)])
        super().__init__()

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        return self.library.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)


MIX = np.uint64(0xFF51AFD7ED558CCD)
MIX2 = np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= MIX2
    x ^= x >> np.uint64(32)
    return x


def word_hashes(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit content hash of every word of several texts, end to end, and the bounds of each text.

    Works on all bytes at once, eight of each word at a time; fold lower-cases A-Z. Equal words have equal hashes in
    any call and any task.
    """
    data = np.frombuffer(b"\n".join([*texts, b"\0" * 8]), np.uint8)
    if fold:
        data = _FOLDED[data]
    blank = _BLANK[data[: len(data) - 8]]
    before = np.empty(len(blank), bool)
    before[:1], before[1:] = True, blank[:-1]
    starts, ends = np.flatnonzero(before & ~blank), np.flatnonzero(blank & ~before)
    lengths = ends - starts
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=firsts[1:])
    bounds = np.searchsorted(starts, firsts)
    return span_hashes(data.tobytes(), starts, lengths), bounds


def span_hashes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; data goes on for eight bytes after the last."""
    import xxhash

    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = lengths.astype(np.uint64) * _LENGTHS
    some = np.arange(len(starts))
    for at in range(0, _INLINE, 8):
        if at:
            some = some[lengths[some] > at]
            if not len(some):
                break
        h[some] = mix64(h[some] ^ (eight[starts[some] + at] & _MASKS[np.minimum(lengths[some] - at, 8)]))
    for k in np.flatnonzero(lengths > _INLINE):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + lengths[k]])
    return h
