"""Texts as one array of UTF-8 bytes, so that statistics of many texts are a few
array operations.  A block's memory is bounded by its bytes, not by its rows."""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: Bytes of text in one block (a longer text is a block of its own).
BLOCK = 1 << 19
PRIME = 0x9E3779B97F4A7C15


def lut(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: Space and \t \n \v \f \r end a word; these count as symbols.
SPACES = lut(b" \t\n\x0b\x0c\r")
SYMBOLS = lut(b"#*$%&|<>")


#: Keep the first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Block:
    """Some texts; every per-text array has one entry for each."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8") for t in texts]
        self.n = len(raw)
        self.sizes = np.fromiter(map(len, raw), dtype=np.int64, count=self.n)
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)  # an end after each text
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64)
        self.ends = self.starts + self.sizes

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of one value for each byte, by text."""
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)])
        return c[self.ends] - c[self.starts]

    @cached_property
    def space(self) -> np.ndarray:
        return SPACES[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words; none crosses a text's end."""
        sp = np.concatenate([[True], self.space])
        edge = np.flatnonzero(sp[1:] != sp[:-1])
        return edge[::2], edge[1::2]

    @cached_property
    def word_at(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words."""
        return np.searchsorted(self.words[0], np.append(self.starts, len(self.data)))

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    @cached_property
    def word_text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def _eight(self) -> np.ndarray:
        """The eight bytes from each place on as one number (after the end: zeros)."""
        out = self.data.astype(np.uint64)
        for k in (1, 2, 4):
            out[:-k] |= out[k:] << np.uint64(8 * k)
        return out

    def _chunks(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte ranges in pieces of eight: range and number of each piece, and its bytes."""
        count = (end - start + 7) // 8
        who = np.repeat(np.arange(len(start)), count)
        k = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        at = start[who] + 8 * k
        return who, k, self._eight[at] & FIRST[np.minimum(end[who] - at, 8)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, the same wherever a range stands: each piece
        is mixed by itself, so sums over places cannot cancel as in a polynomial."""
        who, k, piece = self._chunks(start, end)
        mixed = mix(mix(piece) + (k.astype(np.uint64) + np.uint64(1)) * np.uint64(PRIME))
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        edge = np.searchsorted(who, np.arange(len(start) + 1))
        return mix(c[edge[1:]] - c[edge[:-1]] + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def same_bytes(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether ranges (starts, ends) equal those of ``b`` byte by byte."""
        out = a[1] - a[0] == b[1] - b[0]
        some = np.flatnonzero(out)
        who, _, left = self._chunks(a[0][some], a[1][some])
        right = self._chunks(b[0][some], b[1][some])[2]
        out[some[who[left != right]]] = False
        return out

    def numbers(self, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Equal numbers for byte ranges that are equal, and only for those: what
        hashes alike is compared, and if two differ all are numbered by their bytes."""
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        one, two = order[:-1][same], order[1:][same]
        out = np.empty(len(order), np.int64)
        if self.same_bytes((start[one], end[one]), (start[two], end[two])).all():
            out[order] = np.cumsum(np.concatenate([[0], ~same])) if len(order) else 0
            return out
        seen: dict[bytes, int] = {}
        for i, (x, y) in enumerate(zip(start.tolist(), end.tolist())):
            out[i] = seen.setdefault(self.data[x:y].tobytes(), len(seen))
        return out

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.hashes(*self.words)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside one text, and their first words."""
        h, text = self.word_hash, self.word_text
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(text[n - 1 :] == text[: len(h) - n + 1])
        out = np.zeros(len(first), np.uint64)
        for k in range(n):
            out = out * np.uint64(PRIME) + h[first + k]
        return mix(out), first

    def repeats(self, keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort order of keys within their text, and whether each equals the one before it."""
        both = keys ^ mix(text.astype(np.uint64) + np.uint64(1))
        order = np.argsort(both, kind="stable")
        s = both[order]
        same = np.zeros(len(s), dtype=bool)
        same[1:] = s[1:] == s[:-1]
        return order, same

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all lines (between line feeds)."""
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        return start, end, np.searchsorted(self.starts, start, side="right") - 1

    def repeated_words(self, n: int = 5) -> np.ndarray:
        """Words of each text that lie in a run of ``n`` words found twice in it;
        runs count as equal by their words' bytes, not by a hash."""
        keys, first = self.grams(n)
        text = self.word_text[first]
        order, same = self.repeats(keys, text)
        if same.any():
            word = self.numbers(*self.words, self.word_hash)
            runs = np.stack([text, *(word[first + k] for k in range(n))], axis=1)
            if not (runs[order[1:]] == runs[order[:-1]]).all(axis=1)[same[1:]].all():
                order = np.lexsort(runs.T)
                same = np.concatenate([[False], (runs[order[1:]] == runs[order[:-1]]).all(axis=1)])
        twice = same.copy()
        twice[:-1] |= same[1:]
        hit = first[order[twice]]
        edge = np.zeros(len(self.word_hash) + 1, dtype=np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + n, -1)
        covered = np.cumsum(edge)[:-1] > 0
        c = np.concatenate([[0], np.cumsum(covered)])
        return c[self.word_at[1:]] - c[self.word_at[:-1]]

    def duplicate_lines(self) -> np.ndarray:
        """Lines of each text that hold a word and equal an earlier line of it, byte by byte."""
        start, end, text = self.lines
        filled = np.concatenate([[0], np.cumsum(~self.space)])
        keep = filled[end] > filled[start]
        start, end, text = start[keep], end[keep], text[keep]
        line = self.numbers(start, end, self.hashes(start, end))
        order = np.lexsort((line, text))
        again = (line[order[1:]] == line[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        return np.bincount(text[order[1:]][again], minlength=self.n)

    def code_points(self) -> np.ndarray:
        """Whether each byte begins a character."""
        return (self.data & 0xC0) != 0x80
