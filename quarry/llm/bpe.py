"""Encoding with a public byte-level BPE vocabulary, by speculation and verification.

Text is split into words by the vocabulary's pattern. For each distinct word of a block the longest vocabulary match
from the left proposes tokens. A token sequence is what the merges would give exactly when every token is what its own
bytes merge to and no merge crosses the border of two neighbours while both border pieces exist; this is tested for
all adjacent pairs of the block at once, as array lookups. Only words with a failing pair undergo exact merging, with a
heap. Words are remembered per Python worker, up to a fixed number of entries, so frequent words cost one lookup.

Why the pair test is exact: inside a token the pieces at its right border are the chain token, right part, right part
of that, ...; piece i lives from its own merge to that of piece i-1. The same holds for the left border of the next
token. Merges run in rank order and each piece has a lower rank than what it becomes, so a merge of rank r across the
border happens exactly when pair (piece i, piece j) has rank r and both still live: r < death of the left piece
(equal ranks merge the left occurrence first, which is inside the token) and r <= death of the right piece.

Defined results: a null or empty text gives an empty list; strings that look like special tokens are ordinary text;
any valid Unicode text encodes, and ``decode`` of the ids is the text's UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.session import spread

#: Words remembered per Python worker, and the longest that are.
MEMO_WORDS, MEMO_LENGTH = 200_000, 40
#: Characters of text handled as one block.
BLOCK_CHARS = 2_000_000
#: How text is split before merging; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.int64(1 << 40)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The vocabulary file writes each byte as one letter: printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the border chains of every token. ``of(path)`` loads once per process."""

    _loaded: dict[str, Vocabulary] = {}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        ids = model["vocab"]
        # whatever is neither a byte nor made by a merge is a special token, and never comes out of ordinary text
        self.token_id = {b: ids[t] for t, b in as_bytes.items() if len(b) == 1 or t in made}
        self.token_bytes = {i: b for b, i in self.token_id.items()}
        n = max(ids.values()) + 1
        self.rank = np.full(n, -1, np.int64)
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            i, j, k = ids[a], ids[b], ids[a + b]
            self.pair.setdefault((i, j), (r, k))
            if self.rank[k] < 0:
                self.rank[k], left[k], right[k] = r, i, j
        keys = np.array([(i << 20) | j for i, j in self.pair], np.int64)
        ranks = np.array([r for r, _ in self.pair.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.right_chain, self.left_chain = self._chain(right), self._chain(left)
        whole = np.flatnonzero(left >= 0)
        self.sound = np.ones(n, bool)  # what a token's own bytes merge to is the token
        crossing = self._crossing(left[whole], right[whole])
        self.sound[whole] = crossing == self.rank[whole]
        self.longest: dict[bytes, int] = {}
        for b in self.token_id:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 0), len(b))
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _chain(part: np.ndarray) -> np.ndarray:
        columns, now = [], np.arange(len(part))
        while (now >= 0).any():
            columns.append(now)
            now = np.where(now >= 0, part[np.maximum(now, 0)], -1)
        return np.stack(columns, 1)

    def _crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lowest rank at which a merge crosses the border of a and b; NEVER if none does."""
        out = np.full(len(a), NEVER)
        death_a = np.full(len(a), NEVER)
        for i in range(self.right_chain.shape[1]):
            x = self.right_chain[a, i]
            if not (x >= 0).any():
                break
            death_b = np.full(len(a), NEVER)
            for j in range(self.left_chain.shape[1]):
                y = self.left_chain[b, j]
                live = np.flatnonzero((x >= 0) & (y >= 0))
                if not len(live):
                    break
                key = (x[live] << 20) | y[live]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                r = np.where(self.keys[at] == key, self.ranks[at], NEVER)
                hit = (r < death_a[live]) & (r <= death_b[live])
                out[live[hit]] = np.minimum(out[live[hit]], r[hit])
                death_b = np.where(y >= 0, self.rank[np.maximum(y, 0)], death_b)
            death_a = np.where(x >= 0, self.rank[np.maximum(x, 0)], death_a)
        return out

    def propose(self, word: bytes) -> list[int]:
        """Longest vocabulary match from the left, again and again."""
        out, i, n, token, longest = [], 0, len(word), self.token_id, self.longest
        while i < n:
            for size in range(min(longest.get(word[i : i + 2], 1), n - i), 0, -1):
                t = token.get(word[i : i + size])
                if t is not None:
                    out.append(t)
                    i += size
                    break
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, of equals the leftmost. O(n log n)."""
        ids = [self.token_id[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before, pair = [*range(1, n), -1], [-1, *range(n - 1)], self.pair
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := pair.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if r := pair.get((made, ids[k])):
                    heapq.heappush(heap, (r[0], i, made, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := pair.get((ids[h], made))):
                heapq.heappush(heap, (r[0], h, ids[h], made, r[1]))
        return [t for t in ids if t >= 0]

    def words(self, distinct: list[str]) -> dict[str, list[int] | tuple[int, ...]]:
        """Ids of each word: proposals, one test of all adjacent pairs, exact merging of what fails."""
        out, several, spans = {}, [], []
        flat: list[int] = []
        for w in distinct:
            ids = self.propose(w.encode("utf-8"))
            out[w] = ids
            spans.append(len(flat))
            several.append(w)
            flat.extend(ids)
        if not flat:
            return out
        tokens = np.array(flat, np.int64)
        word_of = np.repeat(np.arange(len(several)), np.diff([*spans, len(flat)]))
        bad = np.zeros(len(several), bool)
        bad[word_of[~self.sound[tokens]]] = True
        inside = np.flatnonzero(word_of[1:] == word_of[:-1])
        if len(inside):
            pairs, back = np.unique((tokens[inside] << 20) | tokens[inside + 1], return_inverse=True)
            fails = self._crossing(pairs >> 20, pairs & ((1 << 20) - 1)) < NEVER
            bad[word_of[inside[fails[back]]]] = True
        for k in np.flatnonzero(bad):
            out[several[k]] = self.merge(several[k].encode("utf-8"))
        return out

    def encode_block(self, texts: list[str | None]) -> list[list[int]]:
        memo = self.memo
        split = [self.split(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in memo})
        fresh = self.words(new)
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids.extend(memo.get(w) or fresh[w])
            out.append(ids)
        if len(memo) + len(fresh) > MEMO_WORDS:
            memo.clear()
        for w, ids in fresh.items():
            if len(w) <= MEMO_LENGTH and len(memo) < MEMO_WORDS:
                memo[w] = tuple(ids)
        return out

    def encode(self, texts: list[str | None]) -> Iterator[list[list[int]]]:
        """Blocks of bounded text, in order."""
        block: list[str | None] = []
        size = 0
        for t in texts:
            block.append(t)
            size += len(t or "")
            if size >= BLOCK_CHARS:
                yield self.encode_block(block)
                block, size = [], 0
        if block:
            yield self.encode_block(block)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.token_bytes[i] for i in ids)


def encode_column(df: DataFrame, text: str, out: str = "ids", vocabulary: str | None = None, counts_only: bool = False) -> DataFrame:
    """``df`` with the column ``text`` replaced by ``out``: the ids as array<int>, or with ``counts_only`` their number.

    Ids come in 32 bits; columns other than ``text`` pass through, so select what is needed first.
    """
    path = vocabulary or default_vocabulary()
    kind = T.LongType() if counts_only else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*[f for f in df.schema if f.name not in (text, out)], T.StructField(out, kind, False)])
    rest = [f.name for f in df.schema if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(path)
        for batch in batches:
            start = 0
            for ids in v.encode(batch.column(text).to_pylist()):
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if counts_only:
                    value = pa.array(sizes)
                else:
                    flat = np.concatenate([np.array(i, np.int32) for i in ids]) if len(ids) else np.array([], np.int32)
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                part = batch.slice(start, len(ids))
                start += len(ids)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], value], names=[*rest, out])

    return spread(df).mapInArrow(run, schema)
