"""Vectorised hashing of words and of runs of words, shared by the similarity operators.

Words are maximal runs of letters and digits of the lower-cased text. A text's
shingles are its distinct runs of ``width`` consecutive words, each a 64-bit hash.
Everything works on whole Arrow batches with numpy; no loop runs per word.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_K1, _K2, _K3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
#: Bits of a shingle's hash; with the number of its text it fills one sortable 64-bit key.
HASH_BITS = 46
_HASH_MASK = np.uint64((1 << HASH_BITS) - 1)
#: Characters that are hashed at once; so few that the arrays stay in the processor's cache.
CHUNK_CHARS = 1 << 15


@functools.cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < 2**bits."""
    n = 1 << bits
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(text: str) -> str:
    """The words of ``text`` with one space around each, e.g. `` a b c ``; a space for no words."""
    out = "".join(c if c.isalnum() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_ASCII)
    return f" {' '.join(out.split())} " if out.strip() else " "


_ASCII = {i: " " for i in range(128) if not chr(i).isalnum()}


def unique(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting: far quicker than by hashing where most values are distinct."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


@dataclass
class Hashed:
    """Word hashes of a batch: ``word`` in text order, ``doc`` the text of each, ``start`` the first word of each text."""

    word: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray

    def text_hash(self) -> np.ndarray:
        """A hash of the whole word sequence of each text."""
        first = np.concatenate([[0], np.cumsum(self.n_words)[:-1]]).astype(np.int64)
        at = np.arange(len(self.word)) - first[self.doc]
        up = _powers(max(1, int(at.max(initial=1)).bit_length()))[0]
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.word) * up[at], dtype=np.uint64)])
        return mix(total[first + self.n_words] - total[first] + self.n_words.astype(np.uint64) * _K2)

    def all_shingles(self, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of every run of ``width`` words, in text order."""
        w, n = self.word, len(self.word) - width + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = w[:n] * _K1
        for k in range(1, width):
            h = mix(h * _K2 + w[k : k + n] * _K3)
        keep = self.doc[:n] == self.doc[width - 1 :]
        return self.doc[:n][keep], h[keep] & _HASH_MASK

    def shingles(self, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the distinct runs of ``width`` words of each text, sorted by both; hashes have HASH_BITS bits.

        A key holds the numbers of 2**18 texts; more are taken in pieces.
        """
        doc, h = self.all_shingles(width)
        if len(self.n_words) > 1 << (64 - HASH_BITS):
            cuts = np.searchsorted(doc, np.arange(0, len(self.n_words) + 1, 1 << (64 - HASH_BITS)))
            parts = [_distinct(doc[a:b] - doc[a], h[a:b], doc[a]) for a, b in zip(cuts, [*cuts[1:], len(doc)]) if b > a]
            return tuple(np.concatenate([p[k] for p in parts]) if parts else x for k, x in enumerate((doc, h)))
        return _distinct(doc, h, 0)


def _distinct(doc: np.ndarray, h: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    key = unique((doc.astype(np.uint64) << np.uint64(HASH_BITS)) | h)
    return (key >> np.uint64(HASH_BITS)).astype(np.int64) + first, key & _HASH_MASK


def hash_words(texts: list[str | None]) -> Hashed:
    """Hash the words of every text; NULL counts as the empty text."""
    parts, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1 if t else 1
        if size > CHUNK_CHARS:
            parts.append(_hash_chunk(texts[at : i + 1], at))
            at, size = i + 1, 0
    parts.append(_hash_chunk(texts[at:], at))
    word, doc = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return Hashed(word, doc, np.bincount(doc, minlength=len(texts)).astype(np.int64))


def _hash_chunk(texts: list[str | None], first: int) -> tuple[np.ndarray, np.ndarray]:
    lowered = [t.lower() if t else "" for t in texts]
    joined = "\n".join(["", *lowered, ""])
    a = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    edge = np.diff(_alnum()[a].view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    up, down = _powers(max(CHUNK_CHARS.bit_length(), len(a).bit_length()))
    total = np.cumsum(a * up[: len(a)], dtype=np.uint64)
    h = mix((total[end - 1] - total[start - 1]) * down[start] + (end - start).astype(np.uint64) * _K3)
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    doc = np.searchsorted(offsets, start, side="right") + first
    return h, doc.astype(np.int64)


def least_overlap(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """The fewest common shingles with which two sets of these sizes reach the similarity."""
    return np.ceil((n_a + n_b) * (similarity / (1 + similarity)) - 1e-9)


def jaccard_pairs(left: list[str], right: list[str], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles and similarity of left[i] with right[i]."""
    n = len(left)
    doc, h = hash_words([*left, *right]).shingles(width)
    size = np.bincount(doc, minlength=2 * n)
    key = ((doc % max(n, 1)).astype(np.uint64) << np.uint64(HASH_BITS)) | h
    key.sort()
    pair = (key >> np.uint64(HASH_BITS)).astype(np.int64)
    both = key[1:] == key[:-1]
    common = np.bincount(pair[1:][both], minlength=n)
    union = size[:n] + size[n:] - common
    return common, np.divide(common, union, out=np.zeros(n), where=union > 0)


def sketch_width(mean_shingles: float) -> int:
    """64-bit words of a sketch that still separates unrelated sets of mean size: some two bits for each shingle."""
    return int(min(16, max(2, np.ceil(mean_shingles * 2.1 / 64))))


def sketches(doc: np.ndarray, h: np.ndarray, n_docs: int, width: int) -> np.ndarray:
    """One parity sketch per text, as ``width`` 64-bit words.

    Each shingle flips one bit, so the bits in which two sketches differ are never
    more than the shingles that only one of the two sets holds.
    """
    bits = width * 64
    flips = np.bincount(doc * bits + ((h >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=n_docs * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n_docs, bits), axis=1).view(np.uint64)


def within(columns_a: list[np.ndarray], columns_b: list[np.ndarray], i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Positions k at which the sketches of i[k] and j[k] differ in at most bound[k] bits; most fall out before the last words are read.

    The sketches are given by their 64-bit words, one array each.
    """
    at, differ = None, np.zeros(len(i), np.int16)
    for k in range(0, len(columns_a), 2):
        for a, b in zip(columns_a[k : k + 2], columns_b[k : k + 2]):
            differ += np.bitwise_count(a.take(i) ^ b.take(j))
        ok = np.flatnonzero(differ <= bound)
        at = ok if at is None else at[ok]
        i, j, differ, bound = i[ok], j[ok], differ[ok], bound[ok]
    return at


def columns(sketch: np.ndarray) -> list[np.ndarray]:
    """The words of sketches as one array each."""
    return [np.ascontiguousarray(sketch[:, k]) for k in range(sketch.shape[1])]


class Side:
    """The sets of one side of a comparison: sizes and sketches by column."""

    def __init__(self, n: np.ndarray, sketch: np.ndarray, similarity: float):
        self.n, self.columns = n.astype(np.int64), columns(sketch)
        #: Half of the bits in which the sketches of two sets may differ is due to each.
        self.room = (n * ((1 - similarity) / (1 + similarity)) + 1e-3).astype(np.float32)


#: Pairs from which on the holders of a shingle are compared as a table, not as a list.
TABLE = 2048
#: Rows of such a table.
STRIP = 128
#: Places of such a table for each pair that it holds, at most; pairs of a sparser one are listed.
DENSE = 2
#: Pairs that are listed at a time; so few that the arrays stay in the processor's cache.
PAIRS_AT_A_TIME = 1 << 16


def close(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the listed pairs whose sketches differ in no more bits than the similarity allows."""
    ok = within(a.columns, b.columns, i, j, a.room.take(i) + b.room.take(j))
    return i[ok], j[ok]


def table_pairs(a: Side, b: Side, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(r, c): places in ``rows`` and ``cols`` of the pairs that the sketches do not rule out."""
    differ = np.bitwise_count(a.columns[0][rows][:, None] ^ b.columns[0][cols])
    if len(a.columns) > 1:
        differ += np.bitwise_count(a.columns[1][rows][:, None] ^ b.columns[1][cols])
    at = np.flatnonzero(differ <= a.room[rows][:, None] + b.room[cols])
    r, c = np.divmod(at, max(len(cols), 1))
    if len(a.columns) > 2:
        i, j = rows[r], cols[c]
        ok = within(a.columns[2:], b.columns[2:], i, j, a.room.take(i) + b.room.take(j) - differ.ravel()[at])
        r, c = r[ok], c[ok]
    return r, c


def sweep(a: Side, b: Side, left: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a set left[k] of ``a`` and a set right[m], low[k] <= m < high[k], of ``b`` that the sketches do not rule out.

    ``starts`` are the places in ``left`` at which a new shingle begins; ``low`` and
    ``high`` never fall within one. Short runs are listed, long ones compared as tables.
    """
    if not len(left):
        return
    width = np.maximum(high - low, 0)
    volume = np.add.reduceat(width, starts)
    stops = np.append(starts[1:], len(left))
    big = np.flatnonzero(volume >= TABLE)
    strips = -(-(stops - starts)[big] // STRIP)
    first = np.repeat(starts[big], strips) + STRIP * (np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips))
    last = np.minimum(first + STRIP, np.repeat(stops[big], strips))
    edges = np.append(np.stack([first, last], axis=1).ravel(), len(left))  # every other part is a strip
    listed = np.ones(len(left), bool)
    if len(first):
        lo, hi, own = (f.reduceat(np.append(x, x[-1:]), edges[:-1])[::2] for f, x in ((np.minimum, low), (np.maximum, high), (np.add, width)))
        dense = (last - first) * (hi - lo) <= DENSE * own
        first, last, lo, hi = first[dense], last[dense], lo[dense], hi[dense]
        for s, e in zip(first.tolist(), last.tolist()):
            listed[s:e] = False
    listed = np.flatnonzero(listed & (width > 0))
    ends, at = np.cumsum(width[listed]), 0
    while at < len(listed):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_A_TIME, side="right")))
        k = listed[at:stop]
        w = width[k]
        i = np.repeat(left[k], w)
        j = right[np.arange(len(i)) - np.repeat(np.cumsum(w) - w - low[k], w)]
        yield close(a, b, i, j)
        at = stop
    for k, l, h in zip(map(slice, first.tolist(), last.tolist()), lo.tolist() if len(first) else (), hi.tolist() if len(first) else ()):
        for at in range(l, h, 1 << 13):
            cols = right[at : min(at + (1 << 13), h)]
            r, c = table_pairs(a, b, left[k], cols)
            ok = (c + at >= low[k][r]) & (c + at < high[k][r])
            yield left[k][r[ok]], cols[c[ok]]


def common_shingles(h_a: np.ndarray, h_b: np.ndarray, i: np.ndarray, j: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How many shingles the sets i[k] and j[k] share; both sides are given as the shingles of all sets, one after the other, and their sizes."""
    out = np.empty(len(i), np.int64)
    first_a, first_b = (np.cumsum(n) - n for n in (n_a, n_b))
    for at in range(0, len(i), 2048):
        keys = []
        for first, n, h, d in ((first_a, n_a, h_a, i[at : at + 2048]), (first_b, n_b, h_b, j[at : at + 2048])):
            w = n[d]
            pair = np.repeat(np.arange(len(d)), w)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(w) - w - first[d], w)
            keys.append((pair.astype(np.uint64) << np.uint64(HASH_BITS)) | h[place])
        key = np.concatenate(keys)
        key.sort()
        both = key[1:][key[1:] == key[:-1]]
        out[at : at + 2048] = np.bincount((both >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(i[at : at + 2048]))
    return out
