"""Byte-pair vocabularies and the merging of one pre-token."""

from __future__ import annotations

import base64
import heapq
import json
import re
from functools import lru_cache

import numpy as np

from . import common, pretoken

#: Pre-tokens of more bytes than this merge through a heap, shorter ones side by side in matrices of these widths.
WIDTHS = (4, 8, 12, 16, 24, 48)
#: No merge; ids are below 2 ** ID_BITS.
NEVER, ID_BITS = np.iinfo(np.int64).max, 21


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a JSON vocabulary: itself if printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes with their ids, the pairs that merge, and special tokens that a text may hold."""

    def __init__(self, tokens: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]] | None, special: dict[str, int]):
        self.tokens, self.pairs, self.special = tokens, pairs, special
        self.bytes_of = {i: b for b, i in tokens.items()}
        self.first = [tokens[bytes([b])] for b in range(256)]
        if pairs is None:  # whatever two tokens become a token together, by its rank
            pairs = {(tokens[t[:k]], tokens[t[k:]]): (i, i) for t, i in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens}
        self.table = pairs
        keys = np.fromiter((a << ID_BITS | b for a, b in pairs), np.int64, len(pairs))
        ranked = np.array([*pairs.values()], np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        # rank and new id in one number, which orders merges as the rank does
        self.keys, self.merges = np.append(keys[order], NEVER), np.append((ranked[:, 0] << ID_BITS | ranked[:, 1])[order], NEVER)

    def merged(self, a: int, b: int) -> tuple[int, int] | None:
        """Rank and id of what two neighbours become, None if they don't merge."""
        return self.table.get((a, b))

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equal ones."""
        if (whole := self.tokens.get(data)) is not None and (self.pairs is None or len(data) == 1):
            return [whole]
        return self._by_heap([self.first[b] for b in data])

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What neighbours merge to (rank and id); NEVER beyond the end of a row, where ids are -1."""
        key = a.astype(np.int64) << ID_BITS | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (b >= 0), self.merges[at], NEVER)

    def _side_by_side(self, ids: np.ndarray) -> np.ndarray:
        """The encodings of the rows of a matrix, filled up with -1; each round merges one pair of every row."""
        out, rows = np.full_like(ids, -1), np.arange(len(ids))
        merges = self._look_up(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = merges.argmin(1) if merges.shape[1] else np.zeros(len(rows), np.int64)
            best = merges[np.arange(len(rows)), at] if merges.shape[1] else np.full(len(rows), NEVER)
            done = best == NEVER
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                rows, ids, merges, at, best = rows[~done], ids[~done], merges[~done], at[~done], best[~done]
                if not len(rows):
                    break
            before = np.arange(ids.shape[1] - 1) <= at[:, None]
            ids = np.where(before, ids[:, :-1], ids[:, 1:])
            merges = np.where(before[:, :-1], merges[:, :-1], merges[:, 1:])
            k = np.arange(len(rows))
            ids[k, at] = best & ((1 << ID_BITS) - 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
            merges[left, at[left] - 1] = self._look_up(ids[left, at[left] - 1], ids[left, at[left]])
            merges[right, at[right]] = self._look_up(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens in a row, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts, found = np.zeros(len(pieces), np.int64), []
        data, begins = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
        first, lower = np.array(self.first, np.int32), 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > lower) & (size <= width))
            lower = width
            if len(rows):
                column = np.arange(width)
                inside = column < size[rows][:, None]
                ids = np.full((len(rows), width), -1, np.int32)
                ids[inside] = first[data[(begins[rows][:, None] + column)[inside]]]
                ids = self._side_by_side(ids)
                if self.pairs is None:  # tokens that no merges lead to
                    whole = [self.tokens.get(pieces[k], -1) for k in rows.tolist()]
                    hit = np.array(whole) >= 0
                    ids[hit], ids[hit, 0] = -1, np.array(whole)[hit]
                counts[rows] = (ids >= 0).sum(1)
                found.append((rows, ids[ids >= 0]))
        for k in np.flatnonzero(size > lower).tolist():
            ids = self.encode(pieces[k])
            counts[k] = len(ids)
            found.append((np.array([k]), np.array(ids, np.int32)))
        # each part is in the order of its rows: to their places
        out, ends = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts)
        for rows, ids in found:
            own = counts[rows]
            out[np.arange(len(ids)) + np.repeat(ends[rows] - own - (np.cumsum(own) - own), own)] = ids
        return out, counts

    def _by_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (got := self.merged(ids[i], ids[j])) is not None:
                heapq.heappush(heap, (got[0], i, ids[i], ids[j], got[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x, live in zip(ids, alive) if live]


@lru_cache(4)
def load(path: str) -> Vocabulary:
    """A vocabulary file: ``.tiktoken`` has tokens by rank, ``.json`` a vocabulary with its merges."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            tokens = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        return Vocabulary(tokens, None, {})
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, signs = spec["model"], byte_signs()
    plain = {t: bytes(signs[c] for c in t) for t in model["vocab"] if all(c in signs for c in t)}
    pairs = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs[model["vocab"][a], model["vocab"][b]] = rank, model["vocab"][a + b]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Vocabulary({b: model["vocab"][t] for t, b in plain.items()}, pairs, special)


def encoder(vocabulary: Vocabulary):
    """A function from pre-tokens to their ids in a row and how many each has."""
    return lambda pieces: vocabulary.encode_all([p.encode("utf-8", "surrogatepass") for p in pieces])


def split_special(texts: list[str], vocabulary: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts cut at special tokens' strings: parts, the text that each belongs to, special tokens by text."""
    extra = np.zeros(len(texts), np.int64)
    if not vocabulary.special:
        return texts, np.arange(len(texts)), extra
    cut = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))))
    parts, owner = [], []
    for k, t in enumerate(texts):
        own = cut.split(t)
        extra[k] = len(own) - 1
        parts += own
        owner += [k] * len(own)
    return parts, np.array(owner, np.int64), extra


class Codec:
    """Encodes batches of texts to ids and turns ids back to bytes."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.cache = pretoken.Cache(encoder(self.vocabulary))
        size = max(max(self.vocabulary.bytes_of), *self.vocabulary.special.values(), 0) + 1
        by_id = [self.vocabulary.bytes_of.get(i, b"") for i in range(size)]
        for text, i in self.vocabulary.special.items():
            by_id[i] = text.encode()
        self.length = np.fromiter(map(len, by_id), np.int64, size)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        parts, owner, extra = split_special(texts, self.vocabulary)
        batch = pretoken.Batch(parts)
        begin, size = self.cache.look_up(batch)
        ids = pretoken.gather(self.cache.flat, begin, size)
        each = common.sums(size, batch.counts)
        if extra.any():
            ids, each = self._with_special(texts, ids, each, owner)
        return ids, np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)

    def _with_special(self, texts, ids, each, owner):
        """Special ids between the parts of a text."""
        cut = re.compile("|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))))
        found = [[self.vocabulary.special[x] for x in cut.findall(t)] for t in texts]
        ends, out, used = np.cumsum(each), [], [0] * len(texts)
        each = each.copy()
        for k, (i, end) in enumerate(zip(owner.tolist(), ends.tolist())):
            out.append(ids[end - each[k] : end])
            if used[i] < len(found[i]):
                out.append(np.array([found[i][used[i]]], np.int32))
                used[i] += 1
                each[k] += 1
        return np.concatenate(out) if out else ids, each

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the length of each id's."""
        length = self.length[ids]
        return pretoken.gather(self.flat, self.begin[ids], length), length


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)
