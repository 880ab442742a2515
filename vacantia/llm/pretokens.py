"""Splitting texts into the pieces that byte-level BPE merges within, by whole arrays.

The public split pattern is applied to code points with array operations: characters
are classed as letter, number, white space or other, and a piece starts where the
class changes, with the pattern's three special rules (a single blank goes with what
follows it, the last of several white-space characters stands apart, and English
contractions are cut off).  Distinct pieces are encoded once per worker and reused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

# fixed values: the characters with the Unicode property White_Space
WHITE_SPACE = [
    *range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
LETTER, NUMBER, OTHER, SPACE, END = 1, 2, 3, 4, 5
CHUNK_CHARS = 1 << 18
CACHED_WORDS = 700_000

_classes = np.zeros(0x110000 + 1, np.uint8)


def _classes_of(codes: np.ndarray) -> np.ndarray:
    """Character classes; those not met before are looked up once."""
    found = _classes[codes]
    if not found.all():
        import regex

        _classes[WHITE_SPACE] = SPACE
        _classes[0x110000] = END
        for code in np.unique(codes[_classes[codes] == 0]).tolist():
            c = chr(code)
            _classes[code] = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER
        found = _classes[codes]
    return found


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Where pieces start, as a mask; END marks (0x110000) close each text and are starts too."""
    kind = _classes_of(codes)
    n = len(codes)
    following = np.append(kind[1:], np.uint8(END))
    before = np.insert(kind[:-1], 0, np.uint8(END))
    space = kind == SPACE
    run_start = kind != before
    # the last white-space character before text stands apart; a blank takes that text along
    last_space = space & (following != SPACE) & (following != END)
    start = run_start | last_space
    glued = np.zeros(n, bool)
    glued[1:] = (last_space & (codes == 0x20))[:-1]
    start &= ~glued
    start |= kind == END

    # contractions: a lone apostrophe that starts a piece, and the letters after it
    quote = np.flatnonzero((codes == 0x27) & start & (following == LETTER))
    if len(quote):
        padded = np.append(codes, np.zeros(3, codes.dtype))
        one, two = padded[quote + 1], padded[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        hit = quote[single | pair]
        after = hit + np.where(single[single | pair], 2, 3)
        start[hit + 1] = False
        start[after[after < n]] = True
    return start


def _safe_cuts(text: str) -> Iterator[str]:
    """Parts of a long text, cut before blanks between two letters, where no piece can cross."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        cut = at + CHUNK_CHARS
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if text[cut - 1].isalpha() and text[cut + 1].isalpha():
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers that look random, from consecutive ones."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_offset_factor = mixed(np.arange(1 << 12) + 0x200000) | np.uint64(1)


def _hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces: the sum over a piece of character number times offset number."""
    lengths = np.diff(np.append(starts, len(codes))).astype(np.int32)
    offset = np.arange(len(codes), dtype=np.int32)
    offset -= np.repeat(starts.astype(np.int32), lengths)
    if len(lengths) and lengths.max() > len(_offset_factor):
        factor = mixed(offset.astype(np.uint64) + np.uint64(0x200000)) | np.uint64(1)
    else:
        factor = _offset_factor[offset]
    factor *= mixed(codes)
    return np.add.reduceat(factor, starts)


class Segments:
    """Arrays kept by 64-bit key: sorted keys, and the arrays end to end."""

    def __init__(self, dtype):
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, dtype)
        self.used = 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Mask of the keys that are not kept."""
        at = np.searchsorted(self.keys, keys)
        inside = at < len(self.keys)
        inside[inside] = self.keys[at[inside]] == keys[inside]
        return ~inside

    def add(self, keys: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        total = len(flat)
        size = len(self.flat)
        while self.used + total > size:
            size *= 2
        if size > len(self.flat):
            # zeros that nothing has been written to take no memory yet
            larger = np.zeros(size, self.flat.dtype)
            larger[: self.used] = self.flat[: self.used]
            self.flat = larger
        self.flat[self.used : self.used + total] = flat
        first = self.used + np.cumsum(count, dtype=np.int64) - count
        self.used += total
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.first = np.insert(self.first, at, first[order])
        self.count = np.insert(self.count, at, count[order])

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys, all of them kept; they hold until the next ``add``."""
        return np.searchsorted(self.keys, keys).astype(np.int32)

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of many places end to end, and where each ends."""
        count = self.count[places]
        upto = np.cumsum(count, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        return self.flat[np.repeat(self.first[places] - (upto - count), count) + np.arange(total)], upto


class Encoder:
    """Texts to token ids, given a function that encodes distinct pieces."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], cached_words: int = CACHED_WORDS):
        self.encode_pieces, self.cached_words = encode, cached_words
        self.known = Segments(np.int32)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        got = self.encode_pieces(words)
        counts = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((i for w in got for i in w), np.int32, int(counts.sum()))
        self.known.add(np.array(keys, np.uint64), flat, counts)

    def _chunks(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        rows: list[int] = []
        parts: list[str] = []
        size = 0
        for row, text in enumerate(texts):
            for part in _safe_cuts(text) if len(text) > CHUNK_CHARS else (text,):
                rows.append(row)
                parts.append(part)
                size += len(part) + 1
                if size >= CHUNK_CHARS:
                    yield rows, parts
                    rows, parts, size = [], [], 0
        if rows:
            yield rows, parts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text.  All new pieces of the call are encoded together."""
        if len(self.known.keys) > self.cached_words:
            self.known = Segments(np.int32)
        new: dict[int, str] = {}
        chunks = []
        for rows, parts in self._chunks(texts):
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            whole = "".join(parts)
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            codes = np.insert(codes, np.cumsum(sizes), np.uint32(0x110000))
            starts = np.flatnonzero(piece_starts(codes))
            hashes = _hashes(codes, starts)
            is_mark = codes[starts] == 0x110000
            distinct, at, back = np.unique(hashes[~is_mark], return_index=True, return_inverse=True)
            missing = self.known.missing(distinct)
            if missing.any():
                # positions in the joined text: one mark less for each text before
                shift = np.cumsum(is_mark)
                begin = (starts - shift)[~is_mark][at[missing]]
                end = (np.append(starts[1:], len(codes)) - shift)[~is_mark][at[missing]]
                for key, b, e in zip(distinct[missing].tolist(), begin.tolist(), end.tolist(), strict=True):
                    if key not in new:
                        new[key] = whole[b:e]
            chunks.append((rows, distinct, back.astype(np.int32), np.cumsum(~is_mark)[is_mark]))
        if new:
            self._learn(list(new), list(new.values()))
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for rows, distinct, back, ends in chunks:
            ids, upto = self.known.gathered(self.known.places(distinct)[back])
            cuts = np.append(0, upto)[ends]
            for row, part in zip(rows, np.split(ids, cuts[:-1]), strict=True):
                out[row].append(part)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.int32) for p in out]
