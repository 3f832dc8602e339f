"""Words of a text as arrays of hashes. A word is a run of letters, digits or _ of the lower-cased text."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
MAX_KNOWN = 150_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


class WordHasher:
    def __init__(self):
        self._known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        known = self._known
        try:
            out = [known[w] for w in found]
        except KeyError:
            if len(known) > MAX_KNOWN:
                known.clear()
            for w in set(found):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            out = [known[w] for w in found]
        return np.array(out, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _SHIFT)
    x = x * _MIX
    x = x ^ (x >> _SHIFT)
    return x * _MIX


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive words, put together from those of 1, 2, 4 and so on."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    part, long_, odd = words, 1, _ODD
    while True:
        if size & long_:
            out = part[:n].copy() if out is None else out * odd + part[have : have + n]
            have += long_
        if 2 * long_ > size:
            return mix(out)
        part = part[:-long_] * odd + part[long_:]
        with np.errstate(over="ignore"):
            odd = odd * odd
        long_ *= 2


#: Code points hashed at a time, and of a word that is hashed by its place in them.
TOGETHER, LONG_WORD = 1 << 18, 64
_NO_WORD = re.compile(r"\W")
_BACK = pow(int(_ODD), -1, 1 << 64)

def _pieces(text: str):
    """A text in pieces of TOGETHER code points or little more that don't part words."""
    at = 0
    while at < len(text):
        cut = _NO_WORD.search(text, at + TOGETHER - 1) if len(text) - at > TOGETHER else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


class TextHasher:
    """Hashes words as numbers of their letters, those of many texts at once and without a table of words."""

    def __init__(self):
        # for every code point: whether it is part of words, and a number; for every place: powers of _ODD and its inverse
        self._is_word = np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)], bool)
        self._number = mix(np.arange(0x110000, dtype=np.uint64) + _ODD)
        powers = np.full((2, TOGETHER + LONG_WORD + 2), [[_ODD], [np.uint64(_BACK)]], np.uint64)
        powers[:, 0] = 1
        self._up, self._down = np.multiply.accumulate(powers, axis=1)

    def _hashed(self, piece: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of a lower-cased text, and where they begin."""
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        edge = np.flatnonzero(np.diff(self._is_word[codes].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        begin, end = edge[::2], edge[1::2]
        out = np.zeros(len(begin), np.uint64)
        for k in np.flatnonzero(end - begin > LONG_WORD).tolist():
            out[k] = xxhash.xxh64_intdigest(piece[begin[k] : end[k]].encode("utf-8", "surrogatepass"))
        for lo in range(0, len(codes), TOGETHER):  # words that begin in so many code points
            a, b = np.searchsorted(begin, (lo, lo + TOGETHER))
            first, last = begin[a:b] - lo, end[a:b] - lo
            part = codes[lo : lo + TOGETHER + LONG_WORD]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self._number[part] * self._up[: len(part)], out=sums[1:])
            short = last - first <= LONG_WORD
            first, last = first[short], last[short]
            out[a:b][short] = mix((sums[last] - sums[first]) * self._down[first] + (last - first).astype(np.uint64))
        return out, begin

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0

        def flush() -> None:
            if group:
                hashes, begin = self._hashed("\n".join(group))
                ends = np.cumsum([len(t) + 1 for t in group])
                out.extend(np.split(hashes, np.searchsorted(begin, ends[:-1])))
                group.clear()

        for text in texts:
            text = text.lower()
            if size + len(text) >= TOGETHER:
                flush()
                size = 0
            if len(text) >= TOGETHER:
                out.append(np.concatenate([self._hashed(x)[0] for x in _pieces(text)]))
            else:
                group.append(text)
                size += len(text) + 1
        flush()
        return out
