"""SimHash and shingle sets of one text: the numeric part of the near-duplicate operators, on numpy and xxhash only."""

from __future__ import annotations

import numpy as np
import xxhash

#: Shingles whose bits are counted at once; bounds the memory that a very long text takes.
BLOCK = 1 << 15


def shingles_of(text: str | None, width: int) -> list[bytes]:
    """The text's word shingles in order; all of it where it has fewer words, none for a text without words or null."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [line]
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: -width])]
    return [line[a:b] for a, b in zip(starts, ends[width - 1 :])]


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles; 0 for a text without words or null."""
    shingles = shingles_of(text, width)
    if not shingles:
        return 0
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        hashes = np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view(np.uint64)[0])


def shingle_set(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the text's word shingles, ascending."""
    distinct = set(shingles_of(text, width))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in distinct), np.uint64, len(distinct)))


def set_hash(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a shingle set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else 0


def wide_simhash(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """SimHash of 64 bits for each lane, of a set of hashes, as signed numbers: a lane mixes the hashes with a number of its own."""
    votes = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        for lane in range(lanes):
            mixed = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane) + np.uint64(lane)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[lane] += bits.sum(0, dtype=np.int32)
    return np.packbits(2 * votes > len(hashes), axis=1, bitorder="little").view(np.int64).ravel()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of distinct hashes; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0
