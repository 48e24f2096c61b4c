"""Byte-level BPE encoding of a corpus, with vectorised pre-tokenisation.

The texts of an Arrow batch are laid end to end as code points.  Each code point
becomes a symbol (its class, refined by the few characters after it), and each
symbol is a function from scanner state to scanner state.  Composition of these
functions is associative, so the state before every character comes from a
blocked prefix scan: all blocks advance together, their composed functions are
combined, and a second sweep fills in the states.  A token starts where the
state before a character and its symbol say so; no regular expression is run.

The resulting slices go through pair merging, with the merges of a slice kept in
a bounded cache (``cache_size``; it changes speed, never a result).
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scanner states.
START, LETTERS, DIGITS, OTHERS, SPACES, JOIN, TAIL1, TAIL2 = range(8)
# Symbols: classes of characters, and the kinds of white space and apostrophe.
L, N, O, WS, WS_LAST, SP_JOIN, APOS2, APOS3, SEP = range(9)
BLOCK = 256
CACHE_SIZE = 400_000
# White space of the Unicode standard (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a token starts here', by symbol and state before."""
    nxt, begins = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    into = {L: LETTERS, N: DIGITS, O: OTHERS}
    for state in range(8):
        for sym, run in into.items():
            if state == TAIL1:  # last letter of a contraction
                nxt[sym, state], begins[sym, state] = START, False
            elif state == TAIL2:
                nxt[sym, state], begins[sym, state] = TAIL1, False
            else:
                nxt[sym, state], begins[sym, state] = run, state not in (run, JOIN)
        # A contraction opens only where no run of other characters is open.
        for sym, tail in ((APOS2, TAIL1), (APOS3, TAIL2)):
            inside = state in (OTHERS, JOIN)
            nxt[sym, state], begins[sym, state] = (OTHERS, False) if inside else (tail, True)
        nxt[WS, state], begins[WS, state] = SPACES, state != SPACES
        nxt[WS_LAST, state], begins[WS_LAST, state] = START, True
        nxt[SP_JOIN, state], begins[SP_JOIN, state] = JOIN, True
        nxt[SEP, state], begins[SEP, state] = START, True
    return nxt, begins


NEXT, BEGINS = _rules()
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, O, np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                table[cp] = L
            elif kind == "N":
                table[cp] = N
        table[WHITE] = WS
        _CLASSES = table
    return _CLASSES


def states_before(symbols: np.ndarray) -> np.ndarray:
    """State before each symbol, by an associative scan of transition functions."""
    n = len(symbols)
    columns = -(-n // BLOCK)
    grid = np.full(columns * BLOCK, SEP, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(columns, BLOCK).T).astype(np.int64) * 8
    flat = NEXT.ravel()
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (columns, 8))
    for row in grid:  # functions of the blocks, all blocks at once
        whole = flat[row[:, None] + whole]
    prefix, step = whole.copy(), 1
    while step < columns:  # prefix composition over blocks, by doubling
        ahead = np.take_along_axis(prefix[step:], prefix[:-step].astype(np.int64), 1)
        prefix[step:] = ahead
        step *= 2
    state = np.empty(columns, np.uint8)
    state[0], state[1:] = START, prefix[:-1, START]
    before = np.empty((BLOCK, columns), np.uint8)
    for k, row in enumerate(grid):
        before[k] = state
        state = flat[row + state]
    return before.T.reshape(-1)[:n]


def symbols_of(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``ends`` marks the separators between texts."""
    sym = classes()[cps]
    sym[ends] = SEP
    if not len(cps):
        return sym
    follow = np.append(sym[1:], SEP)
    white = sym == WS
    last = white & (follow != WS) & (follow != SEP)
    sym[last] = np.where(cps[last] == 32, SP_JOIN, WS_LAST)
    for k in np.flatnonzero(cps == 39):
        if sym[k] == SEP:
            continue
        a = cps[k + 1] if k + 1 < len(cps) and sym[k + 1] != SEP else 0
        b = cps[k + 2] if a and k + 2 < len(cps) and sym[k + 2] != SEP else 0
        if a in (115, 116, 109, 100):  # s t m d
            sym[k] = APOS2
        elif (a, b) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
            sym[k] = APOS3
    return sym


class Encoder:
    """Pair merging by rank over the slices of the scanner."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_size = cache_size

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a slice: the lowest-ranked adjacent pair is merged until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                r = self.ranks.get(piece[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if before[i] >= 0:
                r = self.ranks.get(piece[before[i] : stop])
                if r is not None:
                    heapq.heappush(heap, (r, before[i], stop))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(ids)

    def encode(self, texts: list[str | None], offsets: bool = True) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text, and (if asked for) the code-point offset at which each id's slice starts."""
        joined = "\x00".join(t or "" for t in texts)
        sizes = np.array([len(t or "") for t in texts], np.int64)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes[:-1] + 1) - 1
        sym = symbols_of(cps, ends)
        begins = BEGINS[sym, states_before(sym)] if len(sym) else np.zeros(0, bool)
        at = np.flatnonzero(begins)
        text_start = np.concatenate(([0], ends + 1)).astype(np.int64)
        upto = np.searchsorted(at, np.concatenate((text_start[1:], [len(cps)])))
        cuts = np.append(at, len(cps)).tolist()
        cache, limit = self.cache, self.cache_size
        ids_of, offsets_of, k = [], [], 0
        for base, size, stop in zip(text_start.tolist(), sizes.tolist(), upto.tolist()):
            ids: list[int] = []
            starts: list[int] = []
            end = base + size
            while k < stop:
                a = cuts[k]
                k += 1
                if a >= end:  # the separator
                    continue
                b = cuts[k]
                piece = joined[a : b if b < end else end]
                got = cache.get(piece)
                if got is None:
                    got = self.merge(piece.encode("utf-8", "replace"))
                    if len(cache) >= limit:
                        cache.clear()
                    cache[piece] = got
                ids += got
                if offsets:
                    starts += [a - base] * len(got)
            ids_of.append(ids)
            offsets_of.append(starts)
        return ids_of, offsets_of

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, key: str, text: str, path: str, offsets: bool = False) -> DataFrame:
    """(key, ids[, offsets]) of every row, one output row for each input row.

    path: a rank file that every worker can read.  A null or an empty text gives an empty list; a
    blank text is encoded as it stands; text that looks like a special token is ordinary text.
    Repeated rows and null keys stay as they are; other columns are not read.  An empty table gives
    an empty result.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for part in parts:
            texts = part.column(1).to_pylist()
            ids, offs = [], []
            for a in range(0, len(texts), 512):
                i, o = encoder.encode(texts[a : a + 512], offsets)
                ids += i
                offs += o
            columns = [part.column(0), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(offs, pa.list_(pa.int32()))] * offsets, ["k", "ids", "offsets"][: 2 + offsets])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>" + ", offsets array<int>" * offsets)
    return out.withColumnRenamed("k", key)
