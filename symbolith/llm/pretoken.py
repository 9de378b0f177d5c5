"""Pre-tokenisation without regex: code-point classes and an associative transition-function scan.

The split pattern of the byte-level vocabularies (contractions, optional space + letters / digits / other signs,
white space) is a finite transducer over twelve code-point classes with nine states.  A batch of texts is one array
of classes; it is cut into equal chunks, each chunk's transition function (a map of all nine start states) is computed
for all chunks at once, the maps are composed by a parallel prefix scan, and a second pass that starts from the now
known states emits the boundaries.  Cost is linear in the text, memory a small multiple of one batch.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# Code-point classes.  Lower-case letters that occur in contractions have classes of their own.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, STMD, RV_, L_, E_, END = range(11)
# States: what the current pre-token consists of so far.
FRESH, LETTERS, NUMBERS, OTHERS, BLANK, WHITES, QUOTED, WANT_E, WANT_L = range(9)
N_STATES, N_CLASSES = 9, 11
CHUNK = 256
#: Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point, from its general category."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(sys.maxunicode + 1):
        if (kind := kinds.get(unicodedata.category(chr(cp))[0])) is not None:
            table[cp] = kind
    table[WHITE_SPACE] = WHITE
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("rv", RV_), ("l", L_), ("e", E_)):
        for ch in chars:
            table[ord(ch)] = kind
    return table


def _step(state: int, kind: int) -> tuple[int, bool, bool]:
    """Next state, whether a pre-token begins at this code point, and whether one begins at the one before."""
    letter = kind in (LETTER, STMD, RV_, L_, E_)
    if kind == END:  # a white-space run at the end of a text is one pre-token; a half contraction is not one
        return FRESH, True, state in (WANT_E, WANT_L)
    if state == QUOTED and letter:
        if kind == STMD:
            return FRESH, False, False
        if kind == RV_:
            return WANT_E, False, False
        if kind == L_:
            return WANT_L, False, False
        return LETTERS, True, False
    if (state, kind) in ((WANT_E, E_), (WANT_L, L_)):
        return FRESH, False, False
    half = state in (WANT_E, WANT_L)  # the quote stood alone, and letters begin behind it
    if letter:
        return LETTERS, not (half or state in (LETTERS, BLANK)), half or state == WHITES
    if kind == NUMBER:
        return NUMBERS, state not in (NUMBERS, BLANK), half or state == WHITES
    if kind in (OTHER, QUOTE):
        if kind == QUOTE and state not in (OTHERS, BLANK, QUOTED):
            return QUOTED, True, half or state == WHITES
        return OTHERS, state not in (OTHERS, BLANK, QUOTED), half or state == WHITES
    # White space: a run is one pre-token, but its last sign goes to what follows (a blank) or stands alone.
    white_before = state in (BLANK, WHITES)
    return (BLANK if kind == SPACE else WHITES), not white_before, half


@lru_cache(1)
def _tables() -> tuple[bytes, bytes, bytes]:
    """Next state and the two emissions, by class * N_STATES + state; 256 entries each, for bytes.translate."""
    nxt, here, back = bytearray(256), bytearray(256), bytearray(256)
    for kind in range(N_CLASSES):
        for state in range(N_STATES):
            at = kind * N_STATES + state
            nxt[at], here[at], back[at] = _step(state, kind)
            # the last sign of a longer white-space run begins a pre-token once something else follows
            if state == BLANK and kind not in (SPACE, WHITE, END):
                back[at] = True
    return bytes(nxt), bytes(here), bytes(back)


def _translate(a: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(a.tobytes().translate(table), np.uint8).reshape(a.shape)


def scan(kinds: np.ndarray) -> np.ndarray:
    """Flags of the positions at which a pre-token begins; ``kinds`` has an END after each text."""
    nxt, here, back = _tables()
    n = len(kinds)
    rows = max(1, -(-n // CHUNK))
    base = np.full(rows * CHUNK, END * N_STATES, np.uint8)
    np.multiply(kinds, N_STATES, out=base[:n])
    base = np.ascontiguousarray(base.reshape(rows, CHUNK).T)  # one row for each step
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8)[:, None], (1, rows))
    for k in range(CHUNK):
        maps = _translate(base[k] + maps, nxt)
    start = compose_prefix(maps)
    at = np.empty((CHUNK, rows), np.uint8)
    state = start
    for k in range(CHUNK):
        at[k] = base[k] + state
        state = _translate(at[k], nxt)
    at = np.ascontiguousarray(at.T).reshape(-1)[:n]
    flags = _translate(at, here) != 0
    before = _translate(at, back) != 0
    flags[:-1] |= before[1:]
    return flags


def compose_prefix(maps: np.ndarray, first: int = FRESH) -> np.ndarray:
    """State in which each chunk starts: an inclusive parallel prefix scan of the chunks' maps, [state, chunk]."""
    done, gap = maps.copy(), 1
    while gap < done.shape[1]:
        done[:, gap:] = np.take_along_axis(done[:, gap:], done[:, :-gap].astype(np.intp), 0)
        gap *= 2
    return np.concatenate([np.array([first], np.uint8), done[first, :-1]])


#: Longest pre-token, in code points, that is looked up by its hash.
HASHED = 64


@lru_cache(1)
def _mix() -> tuple[np.ndarray, np.ndarray]:
    """A pseudo-random 64-bit number for each code point, and the odd powers of one for the places in a pre-token."""
    z = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(HASHED - 1, 0xD1342543DE82EF95, np.uint64)]))
    return z ^ (z >> np.uint64(31)), powers


class Batch:
    """The pre-tokens of some texts: where they begin in the joined texts, their lengths and 64-bit hashes."""

    def __init__(self, texts: list[str]):
        self.joined = "\x00".join(texts) + "\x00"
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = class_table()[points]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        kinds[ends] = END
        begins = np.flatnonzero(scan(kinds))
        lengths = np.diff(begins, append=len(points))
        seps = np.searchsorted(begins, ends)
        self.counts = np.diff(seps, prepend=-1) - 1  # of each text
        mix, powers = _mix()
        place = np.arange(len(points)) - np.repeat(begins, lengths)
        np.minimum(place, HASHED - 1, out=place)
        hashes = np.add.reduceat(mix[points] * powers[place], begins)
        keep = np.ones(len(begins), bool)
        keep[seps] = False
        self.points, self.begins, self.lengths, self.hashes = points, begins[keep], lengths[keep], hashes[keep]

    def texts(self, rows: np.ndarray) -> list[str]:
        at = self.begins[rows]
        return [self.joined[i:j] for i, j in zip(at.tolist(), (at + self.lengths[rows]).tolist())]


class Cache:
    """Results by pre-token, held in one flat store; ``make(pieces)`` gives their ids in a row and how many each has.

    A direct-mapped table maps a hash to its place in the store; a slot holds one pre-token and a newer one replaces
    it, so memory is bounded by ``slots`` and ``store`` whatever the texts are.  The store has the pre-token itself as
    well, and a hit counts only if that is equal.  Pre-tokens longer than HASHED code points are made anew each time.
    """

    def __init__(self, make, slots: int = 1 << 19, store: int = 2_000_000):
        self.make, self.slots, self.limit = make, slots, store
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        self.n, self.index = 0, np.zeros((4, 1 << 12), np.int32)  # begin and size of the ids, of the text
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.text, self.text_used = np.empty(1 << 16, np.uint32), 0

    def _add(self, batch: Batch, rows: np.ndarray) -> np.ndarray:
        """Puts new pre-tokens into the store; their places in the index."""
        ids, size = self.make(batch.texts(rows))
        points, length = gather(batch.points, batch.begins[rows], batch.lengths[rows]), batch.lengths[rows]
        self.flat, self.text = _room(self.flat, self.used + len(ids)), _room(self.text, self.text_used + len(points))
        self.flat[self.used : self.used + len(ids)] = ids
        self.text[self.text_used : self.text_used + len(points)] = points
        first, self.n = self.n, self.n + len(rows)
        while self.n > self.index.shape[1]:
            self.index = np.concatenate([self.index, np.zeros_like(self.index)], 1)
        self.index[:, first : self.n] = self.used + np.cumsum(size) - size, size, self.text_used + np.cumsum(length) - length, length
        self.used, self.text_used = self.used + len(ids), self.text_used + len(points)
        return np.arange(first, self.n, dtype=np.int32)

    def _other(self, batch: Batch, rows: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Those of ``rows`` whose pre-token isn't the one at their place ``found``."""
        length = batch.lengths[rows]
        other = self.index[3, found] != length
        rows_, found_, length = rows[~other], found[~other], length[~other]
        differ = gather(self.text, self.index[2, found_].astype(np.int64), length) != gather(batch.points, batch.begins[rows_], length)
        if differ.any():
            other[np.flatnonzero(~other)[np.unique(np.repeat(np.arange(len(rows_)), length)[differ])]] = True
        return rows[other]

    def look_up(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Begin in ``flat`` and number of ids of each pre-token of the batch."""
        if max(self.used, self.text_used // 3) > self.limit or self.n > self.limit // 3:
            self.clear()
        slot = (batch.hashes >> np.uint64(17)).astype(np.int64) & (self.slots - 1)
        short = batch.lengths < HASHED
        found = self.at[slot]
        found[(self.keys[slot] != batch.hashes) | ~short] = -1
        missing = np.flatnonzero(found < 0)
        rows, long = missing[short[missing]], missing[~short[missing]]
        if len(rows):
            kinds, first, back = np.unique(batch.hashes[rows], return_index=True, return_inverse=True)
            made = self._add(batch, rows[first])
            found[rows] = made[back]
            at = (kinds >> np.uint64(17)).astype(np.int64) & (self.slots - 1)
            self.keys[at], self.at[at] = kinds, made  # of two new kinds in one slot the last stays in both arrays
        if len(long):
            found[long] = self._add(batch, long)
        if len(other := self._other(batch, known := np.flatnonzero(short), found[known])):
            found[other] = self._add(batch, other)
        return self.index[0, found].astype(np.int64), self.index[1, found].astype(np.int64)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, doubled until it holds ``n``."""
    while n > len(a):
        a = np.concatenate([a, np.empty_like(a)])
    return a


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[begin : begin + size], one behind the other."""
    total = int(size.sum())
    step = np.ones(total, np.int64)
    filled = size > 0
    begin, size = begin[filled], size[filled]
    if not total:
        return flat[:0]
    heads = np.cumsum(size) - size
    step[heads] = begin
    step[heads[1:]] -= begin[:-1] + size[:-1] - 1
    return flat[np.cumsum(step)]


def batches(texts, limit: int = 1 << 21):
    """Runs of texts of about ``limit`` code points together; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run
