"""Tokenizer pipelines: added tokens, normalisation, words, ids, and back."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import packed_rows

KINDS = ("bpe", "unigram", "wordpiece", "wordlevel", "char", "byte", "sentencepiece-bpe", "tiktoken")
_WORDS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
#: Stands for a blank in metaspace words.
META = "▁"


#: Words whose ids are kept: so many, and of so many characters at most, as a word may be a whole text.
CACHED_WORDS, CACHED_LENGTH = 100_000, 64


class TokenError(ValueError):
    pass


def pretokenize(text: Column, kind: str, pattern: str | None = None) -> Column:
    """The words of a text as an array."""
    match kind:
        case "whitespace":
            return F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))
        case "regex":
            return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        case "metaspace":
            return F.filter(F.split(F.concat(F.lit(META), F.replace(text, F.lit(" "), F.lit(META))), f"(?={META})"), lambda w: w != "")
        case "none":
            return F.array(text)
    raise TokenError(f"no word splitter {kind!r}")


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where printable, else from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


@dataclass
class Tokenizer:
    kind: str
    vocab: dict[str, int]
    merges: Sequence[tuple[str, str]] = ()
    scores: dict[str, float] = field(default_factory=dict)
    normalizers: Sequence[str | tuple[str, str, str]] = ()
    pretokenizer: str = "none"
    pattern: str | None = None
    added: dict[str, int] = field(default_factory=dict)
    unknown: str | None = None
    byte_fallback: bool = False
    prefix: str = "##"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise TokenError(f"no tokenizer {self.kind!r}")
        for n in self.normalizers:
            if n == "nfc":
                raise TokenError("nfc is not supported")
        self.ranks = {pair: i for i, pair in enumerate(self.merges)}
        self._pattern = regex.compile(self.pattern) if self.pattern else None
        self._words = regex.compile(_WORDS)
        self._added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._cache: dict[str, list[int]] = {}

    # -- steps ---------------------------------------------------------------------------

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """Texts between added tokens, and those tokens; the longest wins."""
        if not self._added:
            return [(text, False)]
        out, at = [], 0
        for m in self._added.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], False))
            out.append((m[0], True))
            at = m.end()
        return [*out, (text[at:], False)] if at < len(text) else out

    def normalize(self, text: str) -> str:
        for n in self.normalizers:
            if n == "lowercase":
                text = text.lower()
            elif n == "strip_accents":
                text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
            elif isinstance(n, tuple) and n[0] == "replace":
                text = text.replace(n[1], n[2])
            else:
                raise TokenError(f"no normaliser {n!r}")
        return text

    def words(self, text: str) -> list[str]:
        match self.pretokenizer:
            case "none":
                return [text] if text else []
            case "whitespace":
                return self._words.findall(text)
            case "regex":
                return self._pattern.findall(text)
            case "byte-level":
                table = byte_alphabet()
                found = self._pattern.findall(text) if self._pattern else [text]
                return ["".join(table[b] for b in w.encode()) for w in found if w]
            case "metaspace":
                return [w for w in re.split(f"(?={META})", META + text.replace(" ", META)) if w]
        raise TokenError(f"no word splitter {self.pretokenizer!r}")

    def _unknown(self) -> int:
        if self.unknown is None:
            raise TokenError("an unknown piece and no token for it")
        return self.vocab[self.unknown]

    def _symbol(self, s: str) -> list[int]:
        if s in self.vocab:
            return [self.vocab[s]]
        if self.byte_fallback:
            return [self.vocab[f"<0x{b:02X}>"] for b in s.encode()]
        return [self._unknown()]

    def _bpe(self, word: str) -> list[int]:
        parts = list(word)
        while len(parts) > 1:
            rank, at = min(((self.ranks.get((a, b), math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(math.inf, 0))
            if rank == math.inf:
                break
            joined = parts[at] + parts[at + 1]
            if joined not in self.vocab:
                raise TokenError(f"the merged token {joined!r} is missing")
            parts[at : at + 2] = [joined]
        return [i for p in parts for i in self._symbol(p)]

    def _wordpiece(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = (self.prefix if at else "") + word[at:end]
                if piece in self.vocab:
                    out.append(self.vocab[piece])
                    at = end
                    break
            else:
                return [self._unknown()]
        return out

    def _unigram(self, word: str) -> list[int]:
        longest = max(map(len, self.scores), default=1)
        low = min(self.scores.values(), default=0.0) - 10
        best: list[tuple[float, int, str | None]] = [(0.0, 0, None)] + [(-math.inf, 0, None)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                piece = word[start:end]
                if piece in self.scores:
                    score = best[start][0] + self.scores[piece]
                elif end - start == 1:
                    score = best[start][0] + low
                else:
                    continue
                if score > best[end][0]:
                    best[end] = (score, start, piece)
        out, at = [], len(word)
        while at:
            _, start, piece = best[at]
            out.append(piece)
            at = start
        return [i for p in reversed(out) for i in self._symbol(p)]

    def _word(self, word: str) -> list[int]:
        match self.kind:
            case "char":
                return [i for c in word for i in self._symbol(c)]
            case "byte":
                return list(word.encode())
            case "wordlevel":
                return self._symbol(word)
            case "wordpiece":
                return self._wordpiece(word)
            case "unigram":
                return self._unigram(word)
        return self._bpe(word)

    # -- whole texts -----------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece, special in self.pieces(text):
            if special:
                out.append(self.added[piece])
                continue
            for word in self.words(self.normalize(piece)):
                ids = self._cache.get(word)
                if ids is None:
                    ids = self._word(word)
                    if len(word) <= CACHED_LENGTH and len(self._cache) < CACHED_WORDS:
                        self._cache[word] = ids
                out += ids
        return out

    def decode(self, ids: Sequence[int]) -> str:
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        if self.kind == "byte":
            return bytes(ids).decode(errors="replace")
        tokens = [names[i] for i in ids]
        if self.pretokenizer == "byte-level":
            back = {c: b for b, c in byte_alphabet().items()}
            return bytes(back[c] for c in "".join(tokens)).decode(errors="replace")
        if self.kind == "wordpiece":
            return "".join(t[len(self.prefix) :] if t.startswith(self.prefix) else (" " if k else "") + t for k, t in enumerate(tokens))
        raw = re.sub(r"(?:<0x[0-9A-F]{2}>)+", lambda m: bytes.fromhex(re.sub(r"<0x|>", "", m[0])).decode(errors="replace"), "".join(tokens))
        return raw.replace(META, " ").removeprefix(" ") if self.pretokenizer == "metaspace" else raw


def byte_level() -> Tokenizer:
    return Tokenizer("byte", {})


def _plain_bytes(model: Tokenizer) -> bool:
    """Whether ids are the bytes of the text as it stands."""
    return model.kind == "byte" and not model._added and not model.normalizers and model.pretokenizer == "none"


def _bytes_of(texts: pa.Array) -> pa.Array:
    """The bytes of all texts as arrays, by one pass over their buffer."""
    full = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = full.buffers()
    at = np.frombuffer(offsets, np.int64)[full.offset : full.offset + len(full) + 1] if len(full) else np.zeros(1, np.int64)
    ids = np.frombuffer(data, np.uint8)[at[0] : at[-1]].astype(np.int32) if at[-1] > at[0] else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(ids), mask=texts.is_null())


def encode(model: Tokenizer):
    """A column function from texts to arrays of ids; null gives null.

    Ids of one text at a time are Python numbers; all others are four bytes each.
    """
    plain = _plain_bytes(model)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        if plain:
            return _bytes_of(texts)
        return packed_rows(texts, lambda t: np.array(model.encode(t.as_py()), dtype=np.int32), pa.list_(pa.int32()))

    return run


def decode(model: Tokenizer):
    """A column function from arrays of ids to texts."""
    plain = _plain_bytes(model)

    def text(row: pa.Array) -> str:
        ids = row.to_numpy(zero_copy_only=False)
        return ids.astype(np.uint8).tobytes().decode(errors="replace") if plain and (not len(ids) or 0 <= ids.min() <= ids.max() < 256) else model.decode(ids.tolist())

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return packed_rows(ids, lambda x: text(x.values), pa.string())

    return run


def check_vectors(model: Tokenizer, vectors: DataFrame) -> DataFrame:
    """(text, status) of conformance pairs (text, ids)."""
    ok = encode(model)("text") == F.col("ids")
    return vectors.select("text", F.when(ok, "valid").otherwise("invalid").alias("status"))
