"""Shingle hashes of whole Arrow batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time (whole words, so a block may be longer); each takes some 40 bytes of memory meanwhile.
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no structure (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte, the same for A-Z and a-z.
_BYTE = _SEEDS.copy()
_BYTE[ord("A") : ord("Z") + 1] = _SEEDS[ord("a") : ord("z") + 1]
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of data: runs without blanks and 0x09-0x0D, cut at ``starts`` (where texts begin); A-Z count as lower case."""
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data):  # on to a blank, or to the beginning of a text
            rest = np.flatnonzero(_BREAK[data[end : end + BLOCK]])
            text = starts[np.searchsorted(starts, end)] if starts[-1] >= end else len(data)
            stop = min(end + int(rest[0]) if len(rest) else end + BLOCK, int(text), len(data))
            if stop < end + BLOCK or stop == text:
                end = stop
                break
            end = stop
        part = data[at:end]
        inside = ~_BREAK[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begun = starts[np.searchsorted(starts, at) : np.searchsorted(starts, end)] - at
        first[begun] = inside[begun]
        where = np.flatnonzero(first)
        if len(where):
            own = part[inside]
            head = (np.cumsum(inside) - 1)[where]
            size = np.diff(np.append(head, len(own)))
            place = np.arange(len(own)) - np.repeat(head, size)
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _BASE)]))
            sums = np.add.reduceat(_BYTE[own] * power[place], head)
            hashes.append(mix(sums ^ (size.astype(np.uint64) * np.uint64(0x165667B19E3779F9))))
            firsts.append(where + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_hashes(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its ``width``-word shingles; one of the whole sequence where it has fewer words, none without words or text."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or edges[0] == edges[-1]:
        return [np.empty(0, np.uint64) for _ in range(len(texts))]
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    words, firsts = _words(data, edges[:-1])
    cut = np.searchsorted(firsts, edges)
    n = max(0, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = mix(total + words[i : i + n] * _PLACE[i % len(_PLACE)])
    out = []
    for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        else:
            whole = np.full(min(1, b - a), b - a, np.uint64)
            for i in range(a, b):
                whole = mix(whole + words[i : i + 1] * _PLACE[(i - a) % len(_PLACE)])
            out.append(whole)
    return out
