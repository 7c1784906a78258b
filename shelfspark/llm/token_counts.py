"""Operator 9: exact token counts of every prefix by dynamic programming.

In a BPE encoding the tokens of a string are right exactly if each neighbouring
pair is.  So the encoding of a prefix that ends with token ``t`` is the encoding
of the prefix before ``t`` with ``t`` appended, where exactly one ``t`` fits the
token before it; its count is one more than that earlier prefix's.  One pass
over a word thus stores the exact count at each of its prefixes, and the counts
of a text's prefixes are those of its words, summed: truncation and budget
questions need no second encoding.

Defined results: null text is the empty text (0 bytes, 0 tokens); repeated rows
each give a row; other columns are not read.  A special string of the
vocabulary inside a text is one token, as the library takes it.  Prefixes of a
text with rare characters, which the library rewrites first, are those of the
rewritten text.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_blocks
from .tokenizing import UNCOMMON, Codec, WordCache, codec, default_path

VOCABULARY = "word_bpe_49k.json"
BUDGET = 2048
PAIRS = 1_000_000


ONE, NOTHING = (1,), ("", 0)


def sizes_by_ending(tokens: set[str]) -> dict[str, tuple[int, ...]]:
    """Lengths of the tokens that may end a string, the longest first, by its last two symbols."""
    out: dict[str, set[int]] = {}
    for t in tokens:
        if len(t) > 1:
            out.setdefault(t[-2:], set()).add(len(t))
    return {k: (*sorted(v, reverse=True), 1) for k, v in out.items()}


class PrefixCounter:
    """Counts of all prefixes of single words, by word."""

    def __init__(self, path: str):
        from tokenizers.models import BPE

        c = self.codec = codec(path)
        spec = c.spec["model"]
        self.suffix = spec["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        self.open = BPE(vocab=spec["vocab"], merges=merges)  # for strings that a word goes on after
        special = set(c.special)
        whole = [t for t in spec["vocab"] if t not in special]
        end = len(self.suffix)
        self.inner = {t for t in whole if not (end and t.endswith(self.suffix))}
        self.final = {t[:-end] for t in whole if t.endswith(self.suffix)} if end else self.inner
        self.longest = max(map(len, self.inner | self.final), default=1)
        self.open_sizes, self.end_sizes = sizes_by_ending(self.inner), sizes_by_ending(self.final)
        self.pairs: dict[tuple[str, str, bool], bool] = {}
        self.words = WordCache(self.word)
        self.states = WordCache(self.state)
        self.totals = WordCache(lambda w: self.ended(self.codec.mapped(w)))

    def fits(self, before: str, token: str, last: bool) -> bool:
        """Whether BPE keeps ``before`` and ``token`` apart just so; an empty
        ``before`` asks whether the token is made at all."""
        key = (before, token, last)
        known = self.pairs.get(key)
        if known is None:
            got = (self.codec.model if last else self.open).tokenize(before + token)
            known = len(got) == 1 + bool(before) and (not before or got[0].value == before)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _last(self, s: str, vocabulary: set[str], sizes: dict, last: bool) -> tuple[str, int]:
        """The token that ends ``s`` and the count with it: of those that could,
        the one that fits the last token of what is before it."""
        n = len(s)
        for size in sizes.get(s[-2:], ONE):
            j = n - size
            if j < 0:
                continue
            t = s[j:]
            if t in vocabulary:
                before, k = self.states[s[:j]] if j else NOTHING
                known = self.pairs.get((before, t, last))
                if known or known is None and self.fits(before, t, last):
                    return t, k + 1
        raise ValueError(f"no token ends {s!r}: the vocabulary lacks a byte")

    def state(self, s: str) -> tuple[str, int]:
        """Last token and count of a prefix that the word goes on after; kept by
        prefix, as words share them, and made only where a token may begin."""
        return self._last(s, self.inner, self.open_sizes, False)

    def ended(self, s: str) -> int:
        """Count of a whole word; symbols are byte stand-ins."""
        if len(s) > self.states.longest:
            return self.long_prefixes(s, only_whole=True)[-1]
        return self._last(s, self.final, self.end_sizes, True)[1]

    def prefixes(self, s: str) -> list[int]:
        """Counts of the encodings of ``s[:1]``, ``s[:2]``, ... as whole words."""
        if len(s) > self.states.longest:
            return self.long_prefixes(s)
        return [self.ended(s[:i]) for i in range(1, len(s) + 1)]

    def long_prefixes(self, s: str, only_whole: bool = False) -> list[int]:
        """The same for strings too long to keep (or just that of ``s`` itself)."""
        n = len(s)
        tail, count, out = [""] * (n + 1), [0] * (n + 1), []
        known = self.pairs.get

        def best(i: int, vocabulary: set[str], sizes: dict, last: bool) -> tuple[str, int]:
            for size in sizes.get(s[max(i - 2, 0) : i], ONE):
                j = i - size
                if j >= 0 and (t := s[j:i]) in vocabulary:
                    fits = known((tail[j], t, last))
                    if fits or fits is None and self.fits(tail[j], t, last):
                        return t, count[j] + 1
            raise ValueError(f"no token ends {s[:i]!r}: the vocabulary lacks a byte")

        for i in range(1, n + 1):
            if not only_whole or i == n:
                out.append(best(i, self.final, self.end_sizes, True)[1])
            if i < n:
                tail[i], count[i] = best(i, self.inner, self.open_sizes, False)
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Counts at each character of a pre-token; an unfinished contraction
        is cut into pre-tokens as the text that ends there would be."""
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():
            cuts = [self.codec.words(word[:i]) for i in range(1, len(word))] + [[word]]
            return tuple(sum(self.totals[w] for w in ws) for ws in cuts)
        counts = self.prefixes(self.codec.mapped(word))
        if word.isascii():
            return tuple(counts)
        ends = accumulate(len(ch.encode("utf-8")) for ch in word)
        return tuple(counts[e - 1] for e in ends)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _pieces(p: PrefixCounter, text: str):
    """(characters before it since the last piece, length, counts at its
    characters) of every pre-token or special string of a text."""
    c: Codec = p.codec
    previous = ""
    for part, special in c.parts(text):
        if special is not None:
            counts = []
            for i in range(1, len(part)):  # unfinished, it is ordinary text that may go on the word before
                ws = c.words(previous + part[:i])
                base = p.totals[previous] if previous else 0
                counts.append(sum(p.totals[w] for w in ws) - base)
            yield 0, len(part), (*counts, 1)
            previous = ""
            continue
        if part.isascii() or not UNCOMMON.search(part):
            part = part.lower()
        else:
            part = c.tok.normalizer.normalize_str(part)
        words = c.words(part)
        at = 0
        for w in words:
            found = part.index(w, at)
            yield found - at, len(w), p.words[w]
            at = found + len(w)
        if at < len(part):
            yield len(part) - at, 0, ()
        previous = words[-1] if words and at == len(part) else ""


def prefix_table(path: str, text: str) -> np.ndarray:
    """Exact token counts of the first 0, 1, 2, ... characters of a text."""
    total, out = 0, array("i", [0])
    for gap, _, counts in _pieces(counter(path), text):
        out.extend([total] * gap)
        out.extend(total + k for k in counts)
        total = out[-1]
    return np.frombuffer(out, dtype=np.intc).astype(np.int32)


def total(path: str, text: str) -> tuple[int, list[int] | None]:
    """Tokens of a text, and the counts at its words' ends if they are plain."""
    p = counter(path)
    c = p.codec
    ends: list[int] = []
    n, plain = 0, True
    for part, special in c.parts(text):
        if special is not None:
            n, plain = n + 1, False
        else:
            plain = plain and (part.isascii() or not UNCOMMON.search(part))
            ends = list(map(p.totals.__getitem__, c.words(part)))
            n += sum(ends)
    return n, ends if plain else None


def fit(path: str, text: str, budget: int) -> tuple[int, int]:
    """(tokens of the text, characters of its longest prefix within ``budget``
    such that every shorter word end is within it too)."""
    n, ends = total(path, text)
    if n <= budget:
        return n, len(text)
    p = counter(path)
    if ends is None:
        # word by word; a special string can change no more than the word before it
        done = at = before = last = 0
        for gap, _, counts in _pieces(p, text):
            if before > budget:
                break
            at += gap
            last = at if done <= budget else last
            last = max([last, *(at + i + 1 for i, k in enumerate(counts) if done + k <= budget)])
            at, before, done = at + len(counts), done, done + (counts[-1] if counts else 0)
        return n, last
    sums = list(accumulate(ends))
    j = bisect_right(sums, budget)  # the first word that ends beyond the budget
    word = next(islice(p.codec.scan.finditer(text.lower()), j, None))
    left = budget - (sums[j - 1] if j else 0)
    inside = [i + 1 for i, k in enumerate(p.words[word.group()]) if k <= left]
    return n, word.start() + (inside[-1] if inside else 0)


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    budget: int = BUDGET,
    keep_table: bool = False,
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens``, ``fit_chars`` (the longest prefix
    within ``budget`` tokens) and, with ``keep_table``, ``prefix_counts``."""
    rows = id_text(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        file = path or default_path(VOCABULARY)
        for batch in it:
            for a, some in text_blocks(batch, 1 << 20 if keep_table else 4 << 20):
                fits = [fit(file, t, budget) for t in some]
                cols = [
                    batch.column("_id").slice(a, len(some)),
                    pa.array([len(t.encode("utf-8")) for t in some], pa.int64()),
                    pa.array([n for n, _ in fits], pa.int64()),
                    pa.array([k for _, k in fits], pa.int64()),
                ]
                names = ["_id", "n_bytes", "n_tokens", "fit_chars"]
                if keep_table:
                    cols.append(pa.array([prefix_table(file, t) for t in some], pa.list_(pa.int32())))
                    names.append("prefix_counts")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"_id {kind}, n_bytes long, n_tokens long, fit_chars long" + ", prefix_counts array<int>" * keep_table
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def truncate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, budget: int = BUDGET) -> DataFrame:
    """``id_col`` and the longest prefix of each text within ``budget`` tokens."""
    rows = id_text(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        file = path or default_path(VOCABULARY)
        for batch in it:
            for a, texts in text_blocks(batch, 4 << 20):
                cut = [t[: fit(file, t, budget)[1]] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, len(texts)), pa.array(cut, pa.string())], ["_id", "truncated"])

    return rows.mapInArrow(run, f"_id {kind}, truncated string").select(
        F.col("_id").alias(id_col), F.col("truncated")
    )
