"""numpy kernels over concatenated texts: word hashes, k-gram hashes, sliding minima, winnowed anchors."""

from __future__ import annotations

import numpy as np

U = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
#: Tokens whose anchors are found at once; below 2**24.
PIECE = 1 << 19


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


BYTES = _table(20240229)
#: The same value for A-Z as for a-z.
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            pair = []
            for base in (MULTIPLIER, _INVERSE):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                pair.append(np.multiply.accumulate(x))
        _POWERS[:] = pair
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(32))
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(29)
        x *= U(0xCA5A826395121157)
        x ^= x >> U(32)
    return x


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and n + 1 row offsets (in words) of the maximal runs of word bytes; none crosses a row."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTES) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one prefix sum of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[data] * power[: len(data)], out=total[1:])
        raw = (total[ends] - total[starts]) * inverse[starts]
        raw += (ends - starts).astype(np.uint64) * U(0xA0761D6478BD642F)
    return mix(raw)


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens from each position on (len - k + 1 of them), whatever row they are in."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        done, block, width, base = 0, tokens, 1, U(MULTIPLIER)
        rest, weight = k, base
        # binary powers: a gram of k tokens is a chain of grams whose lengths are powers of two
        while rest:
            if rest & 1:
                out = out * weight + block[done : done + n]
                done += width
            rest >>= 1
            if rest:
                block = block[: len(block) - width] * weight + block[width:]
                weight = weight * weight
                width *= 2
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values (len - width + 1 of them), in linear time."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = (-len(x)) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(tokens: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Cut all windows of ``window`` tokens into runs that share an anchor.

    Tokens are 64-bit hashes, or bytes. The anchor of a window is the leftmost of its k-grams with the least hash, so equal windows have
    equal anchors at equal places. Returns row, first window start, last window start, anchor position
    (token indices into ``tokens``) and anchor hash of each run; every window of every row is in exactly
    one run.
    """
    empty = np.zeros(0, np.int64)
    n = len(tokens) - window + 1
    if n <= 0:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    if len(tokens) > PIECE + window:
        # in pieces with overlaps, so that memory doesn't follow a long text; runs are judged window by window
        parts = []
        for low in range(0, len(tokens), PIECE):
            high = min(len(tokens), low + PIECE + window - 1)
            near = np.clip(offsets - low, 0, high - low)
            rows, s1, s2, at, h = anchors(tokens[low:high], near, window, k)
            keep = s1 < PIECE
            parts.append((rows[keep], s1[keep] + low, np.minimum(s2[keep], PIECE - 1) + low, at[keep] + low, h[keep]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    grams = gram_hashes(BYTES[tokens] if tokens.dtype == np.uint8 else tokens, k)
    packed = (grams & ~U((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
    best = sliding_min(packed, window - k + 1)
    at = (best & U((1 << 24) - 1)).astype(np.int64)
    lengths = np.diff(offsets)
    rows = np.flatnonzero(lengths >= window)
    if not len(rows):
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, offsets[rows], 1)
    np.add.at(valid, offsets[rows + 1] - window + 1, -1)
    inside = np.cumsum(valid[:-1]).astype(bool)
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    change[offsets[rows]] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first, last, at[first], grams[at[first]]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start as many as its count, concatenated."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    used = counts > 0
    starts, counts = starts[used], counts[used]
    ends = np.cumsum(counts)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the half-open ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index in the sorted ``known`` of each value, -1 where absent; a bit table answers most misses."""
    out = np.full(len(values), -1, np.int64)
    if not len(known) or not len(values):
        return out
    bits = U(max(16, min(24, int(len(known)).bit_length() + 6)))
    seen = np.zeros(1 << int(bits), bool)
    seen[(known >> (U(64) - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values >> (U(64) - bits)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
    hit = known[at] == values[maybe]
    out[maybe[hit]] = at[hit]
    return out
