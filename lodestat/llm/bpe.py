"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task gathers the distinct pieces of a batch of documents and lays their bytes out as one chain of symbols. An
inverted index holds, for every pair that can merge, the positions where it stands; merges are applied in order of
rank over all pieces at once, and only the neighbours of a merged pair are looked at again. What a chunk of text (a
word with the white space before it) encodes to is kept, packed, for the chunks to come, up to CACHE chunks; beyond,
those that nothing has asked for lately are forgotten.

Texts are split by the tokenizer's pattern; a chunk boundary, where white space follows other characters, is always
a piece boundary as well. A piece that is itself in the vocabulary is one token. No special tokens.

Nulls are empty texts, with no tokens. Ties, repeated rows and empty tables need no care: rows are independent. A very
long piece (a million equal letters) takes time in proportion to its length, but for a few turns of sorting. Columns of
the input with the names of the results are replaced, others pass through.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Chunks whose encoding a worker keeps. Some 100 MB.
CACHE = 150_000
#: Characters of text whose chunks are gathered at once, and distinct chunks that are encoded at once.
GROUP_CHARS, BATCH = 4_000_000, 200_000
#: Unicode's White_Space characters, stated in full: Python's own \s has four more.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Bpe:
    """A vocabulary of ranks, with encoding by merge replay."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        #: (left id << 32 | right id) -> id of the merged token, for each split of each token into two tokens.
        merged = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left = self.ranks.get(token[:cut])
                if left is not None and (right := self.ranks.get(token[cut:])) is not None:
                    merged[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(merged), np.int64)
        self.pair_ranks = np.array([merged[k] for k in sorted(merged)], np.int64)
        self.byte_ids = np.array(self.bytes, np.int64)
        #: Tokens that are part of a pair that merges to a lower rank than their own.
        self.may_lower = {t for k, r in merged.items() for t in (k >> 32, k & 0xFFFFFFFF) if r < t}
        self.kept: dict[str, bytes] = {}
        #: Chunks that were known when a group had them, since some were last forgotten.
        self.again: set[str] = set()

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to; -1 where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), self.pair_ranks[at], -1)

    def _before_lower(self, chosen: np.ndarray, rank: int, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of these merges are due now: in each word those up to the first that brings up a pair of lower rank."""
        joined = np.r_[False, after[after[chosen[:-1]]] == chosen[1:]]  # stands right after another merge
        previous = before[chosen]
        left = np.where(joined, rank, np.where(previous >= 0, symbols[previous], -1))
        own = np.full(len(chosen), rank)
        new = self._rank_of(np.concatenate([left, own]), np.concatenate([own, symbols[after[after[chosen]]]])).reshape(2, -1)
        lower = ((new >= 0) & (new < rank)).any(0)
        earlier = np.cumsum(lower) - lower
        word = np.searchsorted(ends, chosen, "right")
        return earlier == earlier[np.searchsorted(word, word)]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by applying every merge in order of rank to all words."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.replay_packed(words)]

    def replay_packed(self, words: list[bytes]) -> list[bytes]:
        """As `replay`, each word's ids as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        joined = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)
        symbols = np.full(int(ends[-1]), -1, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends - 1] = False
        symbols[inside] = self.byte_ids[joined]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            """Puts positions into the index, by the rank of the pair that stands there."""
            real = ranks >= 0
            positions, ranks = positions[real], ranks[real]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[[0, *cuts]].tolist(), np.split(positions, cuts)):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        def merge(positions: np.ndarray, rank: int) -> None:
            """Merges the pairs at these positions, none of which overlap, and enters what stands beside them."""
            second = after[positions]
            third = after[second]
            symbols[positions], symbols[second] = rank, -2
            after[positions], before[third] = third, positions
            previous = before[positions]
            left = np.where(previous >= 0, symbols[previous], -1)
            enter(np.concatenate([previous, positions]), self._rank_of(np.concatenate([left, symbols[positions]]), np.concatenate([symbols[positions], symbols[third]])))

        enter(np.arange(n - 1), self._rank_of(symbols[:-1], symbols[1:]))
        while heap:
            rank = heapq.heappop(heap)
            positions = np.sort(np.concatenate(index.pop(rank)))
            positions = positions[np.r_[True, positions[1:] != positions[:-1]]]
            left, right = symbols[positions], symbols[after[positions]]
            positions = positions[self._rank_of(left, right) == rank]
            if not len(positions):
                continue
            # Of pairs that overlap, every other one merges, from the left: each merge takes the next pair's first symbol.
            index_of = np.arange(len(positions))
            fresh = np.r_[True, after[positions[:-1]] != positions[1:]]
            chosen = positions[(index_of - np.maximum.accumulate(np.where(fresh, index_of, 0))) % 2 == 0]
            if rank in self.may_lower:
                now = self._before_lower(chosen, rank, symbols, after, before, ends)
                if not now.all():
                    enter(rest := chosen[~now], np.full(len(rest), rank))
                chosen = chosen[now]
            merge(chosen, rank)
        live = symbols >= 0
        cuts = np.searchsorted(np.flatnonzero(live), ends - 1)
        ids, cuts = symbols[live].astype("<u4").tobytes(), (4 * cuts).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def learn_chunks(self, chunks: list[str]) -> None:
        """Encodes chunks that are not known yet and keeps their packed ids."""
        split = [self.pieces(c) for c in chunks]
        packed: dict[str, bytes] = dict.fromkeys(chain.from_iterable(split), b"")
        rest: dict[str, bytes] = {}
        for p in packed:
            raw = p.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is None:
                rest[p] = raw
            else:
                packed[p] = rank.to_bytes(4, "little")
        packed.update(zip(rest, self.replay_packed(list(rest.values()))))
        for c, ps in zip(chunks, split):
            self.kept[c] = packed[ps[0]] if len(ps) == 1 else b"".join([packed[p] for p in ps])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, group, size = [], [], 0
        collects = gc.isenabled()
        gc.disable()  # a group makes many lists of strings and no cycles
        try:
            for text in texts:
                group.append(text or "")
                size += len(group[-1])
                if size >= GROUP_CHARS:
                    out += self._encode_group(group)
                    group, size = [], 0
            return out + self._encode_group(group)
        finally:
            if collects:
                gc.enable()

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        split = [CHUNK.findall(t) for t in texts]
        held = set().union(*split)
        known = held & self.kept.keys()
        if len(self.kept) + len(held) - len(known) > CACHE:
            self._forget(held, known)
        self.again |= known
        new = list(held - known)
        for k in range(0, len(new), BATCH):
            self.learn_chunks(new[k : k + BATCH])
        packed = self.kept.__getitem__
        return [b"".join(map(packed, cs)) for cs in split]

    def _forget(self, held: set[str], known: set[str]) -> None:
        """Keeps, of what is kept, what a group holds, and of the rest as much as there is room for of what was asked for again."""
        more = islice((c for c in self.again if c not in held), max(0, CACHE - len(held)))
        self.kept = {c: self.kept[c] for c in chain(known, more)}
        self.again = set()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_loaded: dict[str, Bpe] = {}


def vocabulary(path: str = RANKS) -> Bpe:
    """The vocabulary, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str = RANKS) -> DataFrame:
    """The documents with their token ids, packed as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path)
        for texts in batches:
            yield pd.Series(bpe.encode(texts.tolist()), dtype=object)

    return docs.withColumn(out, ids(F.col(text)))


def decode(frame: DataFrame, ids: str = "ids", out: str = "decoded", path: str = RANKS) -> DataFrame:
    """The rows with the bytes that packed ids stand for."""

    @F.pandas_udf("binary")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path)
        for packed in batches:
            yield pd.Series([bpe.decode(x) if x is not None else None for x in packed], dtype=object)

    return frame.withColumn(out, texts(F.col(ids)))


def token_digests(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """The documents without their text, with n_tokens and the hashes of their ids and of the bytes these decode to."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for texts in batches:
            rows = []
            for packed in bpe.encode(texts.tolist()):
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(packed)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = [c for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    return docs.select(*(F.col(f"`{c}`") for c in names), digests(F.col(text)).alias("digests of this row")).select(*(F.col(f"`{c}`") for c in names), F.col("`digests of this row`.*"))
