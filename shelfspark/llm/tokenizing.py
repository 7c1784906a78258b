"""Exact word-wise encoding with published BPE vocabularies.

A tokenizer file is split into its two halves: cutting a text into pre-tokens
and the BPE merges inside one pre-token.  The merges are always the library's;
pre-tokens are cut by ``re`` where every character is in a range whose classes
never changed between Unicode versions, else by the library itself.  Pre-tokens
repeat, so their codes are kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

CACHE_WORDS = 250_000
#: Code points whose class, case mapping and normal form are stable and one to one.
COMMON = [i for i in range(0x180) if i != 0x130]
SPACE = "\\t-\\r \\x85\\xa0"


def _ranges(wanted) -> str:
    out: list[list[int]] = []
    for i in filter(wanted, COMMON):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


def _classes() -> tuple[str, str, str]:
    kind = {i: unicodedata.category(chr(i))[0] for i in COMMON}
    blank = {*range(9, 14), 32, 0x85, 0xA0}
    return (
        _ranges(lambda i: kind[i] == "L"),
        _ranges(lambda i: kind[i] == "N"),
        _ranges(lambda i: kind[i] not in "LN" and i not in blank),
    )


LETTER, NUMBER, OTHER = _classes()
UNCOMMON = re.compile("[^\\u0000-\\u012f\\u0131-\\u017f]")
CONTRACTION = "'(?:[stmd]|re|ve|ll)"
WORD_SCAN = re.compile(f"[{LETTER}]+|{CONTRACTION}|[{NUMBER}]|[{OTHER}]+")
BYTE_SCAN = re.compile(
    f" ?[{LETTER}]+|{CONTRACTION}| ?[{NUMBER}]+| ?[{OTHER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


ALPHABET = byte_alphabet()
TO_BYTE = {c: i for i, c in enumerate(ALPHABET)}
#: latin-1 decoded bytes to stand-ins
STAND_IN = {i: c for i, c in enumerate(ALPHABET)}


class WordCache(dict):
    """Codes by pre-token, in two generations of bounded size: when the younger
    is full it becomes the older one, from which words in use come back."""

    def __init__(self, make, most: int = CACHE_WORDS, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


class Codec:
    """One tokenizer file: pre-tokens, codes of a pre-token, special strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.spec, self.tok = path, spec, Tokenizer.from_file(path)
        self.model = self.tok.model
        self.lowers = spec["pre_tokenizer"]["type"] == "Sequence"
        if self.lowers != bool(spec["normalizer"]) or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: unsupported tokenizer layout")
        self.scan = WORD_SCAN if self.lowers else BYTE_SCAN
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        strings = sorted(self.special, key=len, reverse=True)
        self.special_re = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None

    def parts(self, text: str):
        """(part, special id or None) from left to right."""
        if not self.special_re or "<|" not in text:
            if text:
                yield text, None
            return
        for i, part in enumerate(self.special_re.split(text)):
            if part:
                yield part, self.special[part] if i % 2 else None

    def words(self, part: str) -> list[str]:
        """Pre-tokens of a text without special strings, as text."""
        if part.isascii() or not UNCOMMON.search(part):
            return self.scan.findall(part.lower() if self.lowers else part)
        norm = self.tok.normalizer
        part = norm.normalize_str(part) if norm else part
        return [self.plain(w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]

    @staticmethod
    def plain_bytes(mapped: str) -> bytes:
        return bytes(TO_BYTE[c] for c in mapped)

    @classmethod
    def plain(cls, mapped: str) -> str:
        return cls.plain_bytes(mapped).decode("utf-8")

    @staticmethod
    def mapped(word: str) -> str:
        if word.isascii() and word.isprintable() and " " not in word:
            return word  # visible ASCII stands for itself
        return word.encode("utf-8").decode("latin-1").translate(STAND_IN)

    def word_ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(self.mapped(word))]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec in each Python worker for each file."""
    return Codec(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def as_bytes(ids) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def _id_bytes(path: str) -> WordCache:
    c = codec(path)
    return WordCache(lambda w: as_bytes(c.word_ids(w)))


def encode_bytes(path: str, text: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    c, ids = codec(path), _id_bytes(path)
    out = []
    for part, special in c.parts(text):
        if special is not None:
            out.append(as_bytes([special]))
        else:
            out.extend(map(ids.__getitem__, c.words(part)))
    return b"".join(out)
