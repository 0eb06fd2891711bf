"""Token ids of whole texts, through the public ``tokenizers`` library.

Most words of a corpus repeat, so for texts of plain Latin letters what stands
between blanks, and within it the words that the tokenizer's own pattern cuts
out, are encoded once and looked up afterwards.  Any text with another
character, or with one of the special tokens' strings, goes through the
tokenizer whole.  Chunks are found by a 64-bit hash and then compared byte by
byte; a text with a chunk that only shares its hash with another goes through
the tokenizer whole, too.  Both ways give the same ids.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np

from . import bytewords as B

#: The tokenizer whose pattern ``_WORD`` repeats for plain Latin texts.
DEFAULT = "word_bpe_49k.json"
#: Appended to every document.
END_ID = 1
#: Characters of the fast way: printable ASCII, tab, line ends, Latin-1 but for its blanks.
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ÿ]*")
#: The pattern of the tokenizer over lower-cased plain texts (fixed value).
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
#: Bytes of a chunk: all but the blanks that plain texts can hold.
_CHUNK = ~B.word_class((9, 10), (13, 13), (32, 32))
#: Chunks kept in memory by one worker.
_CACHE_CHUNKS = 400_000


def tokenizer_path(name: str = DEFAULT) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Places:
    """Places by 64-bit hash: open addressing in two arrays, many keys at a time."""

    def __init__(self, bits: int = 20):
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.mask = np.uint64((1 << bits) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where there is none."""
        hashes = np.maximum(hashes, np.uint64(1))  # zero marks a free slot
        out, slot, left = np.full(len(hashes), -1, np.int64), hashes & self.mask, np.arange(len(hashes))
        while len(left):
            held = self.keys[slot[left]]
            hit = held == hashes[left]
            out[left[hit]] = self.places[slot[left[hit]]]
            left = left[~hit & (held != 0)]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
        return out

    def put(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Add distinct hashes that are not there."""
        if len(places) and int(places.max()) * 4 > 3 * len(self.keys):
            old = self.keys.nonzero()[0]
            keys, values = self.keys[old], self.places[old]
            self.__init__(len(self.keys).bit_length())
            self.put(keys, values)
        hashes = np.maximum(hashes, np.uint64(1))
        slot, left = hashes & self.mask, np.arange(len(hashes))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[left[free]]
            won = self.keys[at] == hashes[left]
            self.places[at[won]] = places[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = os.path.basename(path) == DEFAULT
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each file and worker."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without the end id."""
        out: list[bytes | None] = [None] * len(texts)
        plain: list[int] = []
        raw: list[bytes] = []
        for i, text in enumerate(texts):
            if self.plain and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                plain.append(i)
                raw.append(text.lower().encode())
            else:
                out[i] = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not raw:
            return out
        offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        starts, ends, first = B.spans(data, offsets, _CHUNK)
        # Equal chunks of a slice are looked up once, by a 64-bit hash.
        unique, where, back = np.unique(B.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.size) > _CACHE_CHUNKS:
            self._forget()
        known = self.at.find(unique)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self._learn(unique[new], [bytes(data[a:b]).decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        place = known[back]
        for i in np.unique(np.searchsorted(first, self._unlike(data, starts, ends, place), side="right") - 1).tolist():
            out[plain[i]] = _packed(self.tokenizer.encode(texts[plain[i]], add_special_tokens=False).ids)
        begin, n = self.begin[place], self.size[place]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(begin - before[:-1], n) + np.arange(before[-1])]
        packed, cuts = ids.tobytes(), (before[first] * 4).tolist()
        for i, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True):
            if out[i] is None:
                out[i] = packed[a:b]
        return out

    def _unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Numbers of the chunks whose bytes are not those at their place."""
        size = ends - starts
        bad = size != self.text_size[place]
        size = np.where(bad, 0, size)
        stops = np.cumsum(size)
        step = np.arange(stops[-1] if len(stops) else 0)
        own = np.repeat(starts - stops + size, size) + step
        held = np.repeat(self.text_begin[place] - stops + size, size) + step
        differ = np.flatnonzero(data[own] != self.text[held])
        bad[np.searchsorted(stops, differ, side="right")] = True
        return np.flatnonzero(bad)

    def _forget(self) -> None:
        #: Place of each known chunk by its hash; there, where its ids begin and how many they are.
        self.at = _Places()
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        #: The bytes of known chunks, one after another; where each begins and how many it has.
        self.text, self.text_begin, self.text_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> np.ndarray:
        """Encode chunks and remember them; their places."""
        cut = [_WORD.findall(c) for c in chunks]
        words = self._words(set(itertools.chain.from_iterable(cut)))
        got = [b"".join([words[w] for w in found]) for found in cut]
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        places = np.arange(len(self.size), len(self.size) + len(got))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(got), dtype="<u4")])
        raw = [c.encode() for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.text_begin = np.concatenate([self.text_begin, len(self.text) + np.cumsum(size) - size])
        self.text_size = np.concatenate([self.text_size, size])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(raw), np.uint8)])
        self.at.put(hashes, places)
        return places

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word, not kept: chunks are, and hold nearly the same strings.

        Words go through the tokenizer many at once, between blanks; the
        tokens that end a word tell where each one's ids end.
        """
        out, new = {}, list(words)
        for begin in range(0, len(new), 4096):
            part = new[begin : begin + 4096]
            lines = [" ".join(part[k : k + 64]) for k in range(0, len(part), 64)]
            got = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.asarray(e.ids, dtype="<u4") for e in got])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer cuts words that its pattern does not")
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, (ends * 4).tolist(), strict=True):
                out[w] = raw[at:end]
                at = end
        return out


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()
