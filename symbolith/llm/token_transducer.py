"""Token counts by a compiled tokenizer: deterministic transducers whose transitions carry emitted-token counts.

Two transducers work one behind the other.  The first splits texts into pre-tokens (``pretoken``): its chunk state maps
are composed by a parallel prefix scan.  The second reads a pre-token byte by byte; each transition carries the change
of the number of tokens, so that the sum along a pre-token is the length of its byte-pair encoding.  Its state is what
the next bytes can depend on: the longest suffix read that some token begins with and, for the places inside it, the
last token of the encoding up to there and how many tokens fewer that is.  A prefix of an encoding's text ends in the
only token that is compatible with the token before it, so the state after a byte follows from the state before.

States are compiled when a text first needs them, and the table is emptied when it is full: memory is bounded, and
the counts don't depend on it.  All pre-tokens of a batch take their k-th step together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common, pretoken

#: States in the table at most; a transition takes 5 bytes, and a state has one for each byte that texts hold.
MAX_STATES = 1 << 18


class Counter:
    """The lazily compiled transducer over the bytes of a pre-token."""

    def __init__(self, vocabulary: bpe.Vocabulary, max_states: int = MAX_STATES):
        self.vocabulary, self.max_states = vocabulary, max_states
        self.prefixes = {t[:k] for t in vocabulary.tokens for k in range(len(t))}  # of longer tokens
        self.fits: dict[tuple[int, int], bool] = {}
        self.compiled = 0
        self.clear()

    def clear(self) -> None:
        start = (b"", ((-1, 0),))
        self.states, self.ids = [start], {start: 0}
        self.column = np.full(256, -1, np.int64)  # of a byte; columns come into being with the bytes
        self.bytes: list[int] = []
        self.next, self.emit = np.full((1024, 32), -1, np.int32), np.zeros((1024, 32), np.int8)

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The columns of the bytes, new ones for bytes not seen before."""
        for b in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            self.column[b] = len(self.bytes)
            self.bytes.append(b)
        while len(self.bytes) > self.next.shape[1]:
            self.next = np.concatenate([self.next, np.full((len(self.next), 32), -1, np.int32)], 1)
            self.emit = np.concatenate([self.emit, np.zeros((len(self.emit), 32), np.int8)], 1)
        return self.column[data].astype(np.int16)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two."""
        if (got := self.fits.get((a, b))) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            v = self.vocabulary
            got = self.fits[a, b] = v.encode(v.bytes_of[a] + v.bytes_of[b]) == [a, b]
        return got

    def _transition(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after a byte, and the change of the number of tokens."""
        suffix, places = state
        read = suffix + bytes([byte])
        for m in range(len(read), 0, -1):
            before, token = places[m - 1], self.vocabulary.tokens.get(read[-m:])
            if token is not None and before is not None and (before[0] < 0 or self.compatible(before[0], token)):
                break
        else:
            raise ValueError("a byte has no token")
        change = before[1] + 1
        while read not in self.prefixes:
            read = read[1:]
        # a place counts only while some longer token begins there
        kept = (p and (p[0], p[1] - change) if read[len(read) - 1 - d :] in self.prefixes else None for d, p in enumerate(places[: len(read)]))
        return (read, ((token, 0), *kept)), change

    def _compile(self, state: int, column: int) -> None:
        to, change = self._transition(self.states[state], self.bytes[column])
        if (at := self.ids.get(to)) is None:
            at = self.ids[to] = len(self.states)
            self.states.append(to)
            if at >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        self.next[state, column], self.emit[state, column] = at, change
        self.compiled += 1

    def count(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[begin : begin + length]."""
        columns = self._columns(data)
        order = np.argsort(-lengths, kind="stable")
        begin, length = begins[order], lengths[order]
        total = np.zeros(len(begin), np.int64)
        state = np.zeros(len(begin), np.int32)
        longest = int(length[0]) if len(length) else 0
        live = np.searchsorted(-length, -np.arange(longest), side="left")  # pre-tokens longer than k are the first ones
        for k in range(longest):
            n = int(live[k])
            column, at = columns[begin[:n] + k], state[:n]
            to = self.next[at, column]
            if len(new := np.flatnonzero(to < 0)):
                kinds = np.unique(at[new].astype(np.int64) * 256 + column[new])
                if len(self.states) + len(kinds) > self.max_states and len(self.states) > 1:
                    return self._anew(data, begins, lengths)
                for x in kinds.tolist():
                    self._compile(x >> 8, x & 255)
                to[new] = self.next[at[new], column[new]]
            total[:n] += self.emit[at, column]
            state[:n] = to
        out = np.empty_like(total)
        out[order] = total
        return out

    def _anew(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """With an emptied table; halves of the batch one after the other where one batch fills it, and a single
        pre-token state by state without the table."""
        self.clear()
        if len(begins) == 1:
            state, total = self.states[0], 0
            for byte in data[int(begins[0]) : int(begins[0] + lengths[0])].tobytes():
                state, change = self._transition(state, byte)
                total += change
            return np.array([total], np.int64)
        half = len(begins) // 2
        return np.concatenate([self.count(data, begins[:half], lengths[:half]), self.count(data, begins[half:], lengths[half:])])


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(bpe.load(path))


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text; strings of special tokens inside texts are single tokens, as is the library's default."""
    machine = counter(path)
    parts, owner, extra = bpe.split_special(texts, machine.vocabulary)
    batch = pretoken.Batch(parts)
    data = np.frombuffer(batch.joined.encode("utf-8", "surrogatepass"), np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each code point
    begins = heads[batch.begins]
    lengths = np.append(heads, len(data))[batch.begins + batch.lengths] - begins
    each = common.sums(machine.count(data, begins, lengths), batch.counts)
    return np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64) + extra


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level vocabulary on the executors.  Null and empty texts have 0 tokens, rows
    with null or repeated ids are counted like others, further columns are ignored.  No shuffle; a task holds one
    batch of rows and the bounded transition table.
    """

    def run(batches):
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in common.runs(batch, 1, 1 << 20):
                n_tokens.append(count_texts(texts, vocabulary))
                n_bytes += [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            tokens = np.concatenate(n_tokens) if n_tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(common.returning(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
