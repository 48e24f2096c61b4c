"""Same or near-same records across splits: every pair is bounded, what may qualify is checked exactly.

Texts with equal words form one class, so exact copies are read once.  Two classes with the same story
need share no two words in a row (every third word may be another) and no rare word, so neither
suffixes nor rare words can find all of them.  Therefore every two classes of like length on different
sides are compared, by a bound that is never less than what they share:

The words of all texts are put into ``BUCKETS``.  A class has the number of its words in each bucket, and
the buckets of all words that may match its own: these, and every word of the collection that is close to
one of them.  Words of one class in buckets that the other has not are unmatched, so the product of the
counts of the one and the buckets of the other is at least the length of their common subsequence.  This
holds for any buckets; which words share one is chosen so that the product is small (``_laid_out``).  The
products of two blocks of classes are one matrix product, three classes of the right block to a number.

What is left is bounded again where the blocks meet, by the words themselves and then by their order,
words that are linked by close words counting as one (``_in_line``).  Only then are the texts fetched and
checked exactly, by a longest common subsequence in which misspelt words count as equal.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.wording import close, words
from scoreloom.session import checkpointed

LEAST_WORDS, SHARE = 20, 2 / 3
BUCKETS = 384
LAID_OUT, PLACED = 1500, 2500  # texts, and words, that settle which words share a bucket
BLOCK, MOST_BLOCK = 8192, 65536  # classes of one side in a block; the latter in large tables
TILE = 256, 1024  # rows and numbers of one product
PACKED = 3, 255  # classes in one number of a product, and words of the longest text for that: a float counts to 2 ** 24
GROUPS = 65_521  # numbers of groups of words, under 2 ** 16; the rest fill lines up
REST_A, REST_B = 65_534, 65_535
ALIGNED = 20_000  # pairs whose order is bounded in one go
MANY_AT_ONCE, CELLS = 1024, 1 << 20  # words of the longest text of which many pairs are aligned at once, and 64 cells of each
REST = 14  # longest word that is known by its rests; others by their thirds
CHECKED = 2000  # pairs that are checked with one vocabulary


class _Words(dict):
    """64-bit hash of each word, computed once; forgotten when too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        return h


def spelling_keys(word: str) -> set[str]:
    """Keys of which any two ``close`` words have one in common.

    Short words have what is left of them without a letter or two.  Of a long word's thirds, two edits
    leave one whole and at most two places away, so a word has what may be a third of any word of like
    length.
    """
    keys = Spelling._rests(word) if len(word) <= REST else set()
    for n in range(max(len(word) - 2, REST - 1), len(word) + 3) if len(word) >= REST - 1 else ():
        cuts = (0, n // 3, 2 * n // 3, n)
        for i in range(3):
            for shift in range(-2, 3):
                if cuts[i] + shift >= 0 and cuts[i + 1] + shift <= len(word):
                    third = word[cuts[i] + shift : cuts[i + 1] + shift].encode("utf-8", "surrogatepass")
                    keys.add(f"{n} {i} {hashlib.blake2b(third, digest_size=12).hexdigest()}")
    return keys


def _near(texts: DataFrame) -> np.ndarray:
    """(hash, hash, texts with the latter) of all close words of the collection, both ways, by row."""
    spelled = checkpointed(texts.select(F.explode(F.array_distinct(F.split("line", " "))).alias("w")).where("length(w) >= 3 AND NOT w RLIKE '[0-9]'").groupBy("w").agg(F.count(F.lit(1)).alias("n")))

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, w, n) for w, n in zip(part["w"], part["n"]) if w.isalpha() for k in spelling_keys(w)]
            yield pd.DataFrame(rows, columns=["k", "w", "n"])

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for part in parts:
            rows = [x for w, n, v, m in zip(part["w"], part["n"], part["v"], part["m"]) if close(w, v) for x in ((known[w], known[v], m), (known[v], known[w], n))]
            yield pd.DataFrame({"rows": [zlib.compress(np.array(rows, np.int64).tobytes(), 1)]})

    keys = spelled.mapInPandas(emit, "k string, w string, n long")
    pairs = keys.join(keys.withColumnsRenamed({"w": "v", "n": "m"}), "k").where("w < v").select("w", "n", "v", "m").distinct()
    found = [np.frombuffer(zlib.decompress(r.rows), np.int64).reshape(-1, 3) for r in pairs.mapInPandas(check, "rows binary").collect()]
    return np.concatenate([np.zeros((0, 3), np.int64), *found])


class Buckets:
    """The bucket of each word, and the buckets of the words that are close to it.

    A word goes where the most frequent word close to it goes, so that misspelt words add no buckets.
    """

    def __init__(self, near: np.ndarray):
        """near: rows of (word, close word, texts with the latter), both ways; words by their hashes."""
        every = np.unique(near[:, 0])
        count = np.zeros(len(every), np.int64)
        count[np.searchsorted(every, near[:, 1])] = near[:, 2]
        at = np.concatenate([np.searchsorted(every, near[:, 0]), np.arange(len(every))])
        to = np.concatenate([np.searchsorted(every, near[:, 1]), np.arange(len(every))])
        order = np.lexsort((to, -count[to], at))
        root = to[order][np.searchsorted(at[order], np.arange(len(every)))]
        both = np.unique(np.stack([at, root[to]], 1), axis=0)
        self.word, self.root = every, every[root]
        self.start, self.roots = np.searchsorted(both[:, 0], np.arange(len(every) + 1)), every[both[:, 1]]
        self.group = every[_linked(at, to, len(every))]
        self.laid, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _at(self, table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
        return at, table[at] == h if len(table) else np.zeros(len(h), bool)

    def spread(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(root of each word, and (which word, root) of all words that are close to each)."""
        at, hit = self._at(self.word, h)
        root, which = h.copy(), np.flatnonzero(hit)
        root[which] = self.root[at[which]]
        size = self.start[at[which] + 1] - self.start[at[which]]
        among = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[at[which]], size)
        alone = np.flatnonzero(~hit)
        return root, np.concatenate([alone, np.repeat(which, size)]), np.concatenate([h[alone], self.roots[among]])

    def of(self, root: np.ndarray) -> np.ndarray:
        at, hit = self._at(self.laid, root)
        out = root % BUCKETS
        out[hit] = self.place[at[hit]]
        return out

    def marks(self, lines: list[str], known: _Words) -> tuple[np.ndarray, np.ndarray]:
        """(words of each line in each bucket, whether a word of the bucket may match one of the line's)."""
        return self.marked(*_hashes(lines, known), len(lines))

    def marked(self, owner: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The same from the words' hashes and the line of each."""
        root, which, met = self.spread(h)
        counts = np.bincount(owner * BUCKETS + self.of(root), minlength=size * BUCKETS).reshape(-1, BUCKETS)
        open_ = np.zeros((size, BUCKETS), bool)
        open_[owner[which], self.of(met)] = True
        return counts, open_

    def grouped(self, h: np.ndarray) -> np.ndarray:
        """A number for each word; equal for words that match, and for some that do not."""
        at, hit = self._at(self.word, h)
        out = h.copy()
        out[hit] = self.group[at[hit]]
        return (out % GROUPS).astype(np.uint16)


def _linked(at: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """The least number that each of ``size`` numbers is linked with, however far, by the links (at, to)."""
    least = np.arange(size)
    while True:
        new = least.copy()
        np.minimum.at(new, at, least[to])
        np.minimum.at(new, least[at], least[to])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _hashes(lines: list[str], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    tokens = [line.split(" ") for line in lines]
    return np.repeat(np.arange(len(lines)), [len(t) for t in tokens]), np.array([known[w] for t in tokens for w in t], np.int64)


def _laid_out(buckets: Buckets, lines: list[str]) -> None:
    """Puts the words that tell most of the given texts apart into buckets, words that come together into one.

    Any places give right results: these make the bounds close.  A word is worth what it is expected to
    leave unmatched, its count by the share of texts that have not its bucket, and goes where least is lost.
    """
    owner, h = _hashes(lines, _Words())
    root, which, met = buckets.spread(h)
    every = np.unique(np.concatenate([root, met]))
    size = len(lines), len(every)
    expected = np.bincount(np.searchsorted(every, root), minlength=size[1]) / max(size[0], 1)
    has = np.zeros(size[::-1], bool)
    has[np.searchsorted(every, met), owner[which]] = True
    worth = expected * (1 - has.mean(1)) if size[0] else expected
    order = np.argsort(-worth, kind="stable")[:PLACED]
    union, inside, lack = np.zeros((BUCKETS, size[0]), bool), np.zeros(BUCKETS), np.ones(BUCKETS)
    place, used = np.zeros(len(order), np.int64), 0
    for i, w in enumerate(order):
        b = used
        if used:
            without = 1 - (union[:used] | has[w]).mean(1)
            lost = inside[:used] * (lack[:used] - without) + worth[w] - expected[w] * without
            b = int(lost.argmin())
            if used < BUCKETS and lost[b] > 0.1 * worth[w]:
                b = used
        used = max(used, b + 1)
        place[i] = b
        union[b] |= has[w]
        inside[b] += expected[w]
        lack[b] = 1 - union[b].mean()
    by = np.argsort(every[order])
    buckets.laid, buckets.place = every[order][by], place[by]


def may_match(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of left, rows of right) of like length whose bounds allow the same story, tile by tile.

    Either side: (words, counts by bucket, open buckets).
    """
    (n, counts, opened), (m, counts2, opened2) = left, right
    least, least2 = (np.ceil(SHARE * x - 1e-9).astype(np.int64) for x in (n, m))
    for i, j, at, width in _products(counts, opened2, n, least, least2):
        for k in range(0, len(at), 1 << 14):
            a, b = np.divmod(at[k : k + (1 << 14)], width)
            a, b = a + i, b + j
            keep = np.minimum(n[a], m[b]) >= np.maximum(least[a], least2[b])
            a, b = a[keep], b[keep]
            most = np.einsum("ij,ij->i", counts2[b], opened[a], dtype=np.int64, casting="unsafe")
            keep = most >= np.maximum(least[a], least2[b])
            yield a[keep], b[keep]


def _products(counts: np.ndarray, opened: np.ndarray, n: np.ndarray, least: np.ndarray, least2: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first row, first column, cells of the tile that are large enough, columns of the tile) of each tile.

    Where no row has over PACKED words, a number holds the sums of three columns, a byte each.
    """
    fields, longest = PACKED
    rows, numbers = TILE
    packed = n.max(initial=0) <= longest
    columns = numbers * fields if packed else numbers
    buffers = [np.empty(rows * numbers, np.float32), np.empty(rows * numbers, np.int32), np.empty(4 * rows * numbers, bool), np.empty(4 * rows * numbers, bool)]
    for j in range(0, len(opened), columns):
        some = opened[j : j + columns]
        if not packed:
            other = np.ascontiguousarray(some.T, dtype=np.float32)
            for i in range(0, len(n), rows):
                most = counts[i : i + rows].astype(np.float32) @ other
                yield i, j, np.flatnonzero((most >= least[i : i + rows, None]) & (most >= least2[None, j : j + columns])), len(some)
            continue
        # Filled up with columns in which nothing is open, to an even number of numbers; no sum of theirs reaches 255.
        wide = 2 * -(-len(some) // (2 * fields))
        filled, limit = np.zeros((wide * fields, BUCKETS), np.float32), np.full((wide, 4), 255, np.uint8)
        filled[: len(some)] = some
        other = np.ascontiguousarray(np.einsum("nfb,f->bn", filled.reshape(wide, fields, BUCKETS), np.float32([1, 256, 65536])))
        every = np.full(wide * fields, 255)
        every[: len(some)] = np.minimum(least2[j : j + columns], 255)
        limit[:, :fields] = every.reshape(wide, fields)
        for i in range(0, len(n), rows):
            size = min(rows, len(n) - i)
            product, whole = (x[: size * wide].reshape(size, wide) for x in buffers[:2])
            hit, both = (x[: 4 * size * wide].reshape(size, 4 * wide) for x in buffers[2:])
            np.matmul(counts[i : i + size].astype(np.float32), other, out=product)
            np.copyto(whole, product, casting="unsafe")
            np.greater_equal(whole.view(np.uint8), limit.reshape(1, -1), out=hit)
            np.greater_equal(whole.view(np.uint8), least[i : i + size, None].astype(np.uint8), out=both)
            np.logical_and(hit, both, out=hit)
            at = (8 * np.flatnonzero(hit.view(np.uint64))[:, None] + np.arange(8)).ravel()
            row, place = np.divmod(at[hit.reshape(-1)[at]], 4 * wide)
            yield i, j, row * len(some) + place // 4 * fields + place % 4, len(some)


class _Lines:
    """The groups of the words of a block's classes, in order."""

    def __init__(self, n: np.ndarray, groups: np.ndarray):
        self.n, self.groups, self.start = n, groups, np.concatenate([[0], np.cumsum(n)])

    def of(self, i: int) -> list[int]:
        return self.groups[self.start[i] : self.start[i + 1]].tolist()

    def filled(self, rows: np.ndarray, width: int, rest: int) -> np.ndarray:
        place = np.arange(width)
        at = np.minimum(self.start[rows][:, None] + place, len(self.groups) - 1)
        return np.where(place < self.n[rows][:, None], self.groups[at], np.uint16(rest))


def _in_line(left: _Lines, right: _Lines, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows may have the same story: a longest common subsequence of their words' groups."""
    least = np.ceil(SHARE * np.maximum(left.n[a], right.n[b]) - 1e-9)
    able = np.zeros(len(a), bool)
    n, m = left.n[a], right.n[b]
    width = max(1, -(-int(m.max(initial=0)) // 64))
    if max(n.max(initial=0), m.max(initial=0)) > MANY_AT_ONCE:
        for k in range(len(a)):
            line = right.of(b[k])
            able[k] = _in_order(left.of(a[k]), _masks(line), len(line)) >= least[k]
        return able
    long, few = max(1, int(n.max(initial=0))), 32
    equal = np.empty((few, long, 64 * width), bool)
    step = max(few, CELLS // (long * width))
    for k in range(0, len(a), step):
        some = slice(k, k + step)
        x, y = left.filled(a[some], long, REST_A), right.filled(b[some], 64 * width, REST_B)
        # [word of the left, 64 words of the right, pair]: which of them are equal, as bits.
        masks = np.empty((long, width, len(x)), np.uint64)
        for i in range(0, len(x), few):
            part = equal[: len(x) - i]
            np.equal(x[i : i + few, :, None], y[i : i + few, None, :], out=part)
            masks[:, :, i : i + few] = np.packbits(part.reshape(-1), bitorder="little").view(np.uint64).reshape(len(part), long, width).transpose(1, 2, 0)
        v = np.full(masks.shape[1:], ~np.uint64(0))
        for mask in masks:
            carry = None
            for w in range(width):
                u = v[w] & mask[w]
                total = v[w] + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over
                v[w] = total | (v[w] ^ u)
        able[some] = 64 * width - np.bitwise_count(v).sum(0, dtype=np.int64) >= least[some]
    return able


def _packed(c: np.ndarray, n: np.ndarray, counts: np.ndarray, opened: np.ndarray, groups: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max(initial=0) < 256 else np.int32
    return zlib.compress(b"".join([np.array([len(c), kind().itemsize], np.int64).tobytes(), c.astype(np.int64).tobytes(), n.astype(np.int64).tobytes(), counts.astype(kind).tobytes(), np.packbits(opened, axis=1).tobytes(), groups.tobytes()]), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    data = zlib.decompress(data)
    size, width = np.frombuffer(data, np.int64, 2)
    at = 16
    c, n = np.frombuffer(data, np.int64, 2 * size, at).reshape(2, -1)
    at += 16 * size
    counts = np.frombuffer(data, np.uint8 if width == 1 else np.int32, size * BUCKETS, at).reshape(-1, BUCKETS)
    at += size * BUCKETS * width
    opened = np.unpackbits(np.frombuffer(data, np.uint8, size * BUCKETS // 8, at).reshape(size, -1), axis=1)
    return c, n, counts, opened, np.frombuffer(data, np.uint16, offset=at + size * BUCKETS // 8)


def _meetings(texts: DataFrame) -> DataFrame:
    """(a, b) of classes, a in training and b elsewhere, whose bounds allow the same story.

    Classes are in blocks by side and length; every two blocks of like length meet in one task.
    """
    spark = texts.sparkSession
    # Lengths in steps of a root of 1 / SHARE.
    sides = texts.select("c", "line", "n", F.floor(F.log("n") / F.lit(np.log(1 / SHARE) / 2)).cast("int").alias("band"), F.explode(F.expr("filter(array(1, 2), s -> (s & side) > 0)")).alias("role"))
    bands = sides.groupBy("role", "band").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).collect()
    total = max(sum(b.rows for b in bands if b.role == role) for role in (1, 2)) if bands else 0
    unit = max(BLOCK, min(MOST_BLOCK, total // 12))
    blocks = {(b.role, b.band): -(-b.rows // unit) for b in bands}
    like = [(x, y) for x in bands for y in bands if (x.role, y.role) == (1, 2) and x.high >= SHARE * y.low - 1e-9 and y.high >= SHARE * x.low - 1e-9]
    meets = [(x.band, i, y.band, j) for x, y in like for i in range(blocks[1, x.band]) for j in range(blocks[2, y.band])]
    if not meets:
        return spark.createDataFrame([], "a long, b long")
    buckets = Buckets(_near(texts))
    every = max(1, total // LAID_OUT)
    _laid_out(buckets, [r.line for r in texts.where(F.pmod("h1", F.lit(every)) == 0).select(F.substring("line", 1, 4000).alias("line")).limit(LAID_OUT).collect()])
    shared = spark.sparkContext.broadcast((buckets, blocks))

    def mark(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (buckets, blocks), known = shared.value, _Words()
        for part in parts:
            for at in range(0, len(part), 1000):
                some = part.iloc[at : at + 1000]
                owner, h = _hashes(some["line"].tolist(), known)
                (counts, opened), groups = buckets.marked(owner, h, len(some)), np.split(buckets.grouped(h), np.cumsum(np.bincount(owner, minlength=len(some)))[:-1])
                block = [c * 0x9E3779B97F4A7C15 % (1 << 64) % 1_000_003 % blocks[r, b] for c, r, b in zip(some["c"].tolist(), some["role"].tolist(), some["band"].tolist())]
                by = some.assign(block=block, row=np.arange(len(some)))
                for (role, band, block), g in by.groupby(["role", "band", "block"]):
                    i = g["row"].to_numpy()
                    yield pd.DataFrame({"role": [role], "band": [band], "block": [block], "data": [_packed(g["c"].to_numpy(), g["n"].to_numpy(), counts[i], opened[i], np.concatenate([groups[k] for k in i]))]})

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        c, n, counts, opened, groups = (np.concatenate(x) for x in zip(*map(_unpacked, group["data"])))
        return pd.DataFrame({"role": [key[0]], "band": [key[1]], "block": [key[2]], "data": [_packed(c, n, counts, opened, groups)]})

    kind = "role int, band int, block int, data binary"
    cells = checkpointed(sides.mapInPandas(mark, kind).groupBy("role", "band", "block").applyInPandas(pack, kind))
    plan = spark.createDataFrame([(k, *m) for k, m in enumerate(meets)], "k int, band1 int, block1 int, band2 int, block2 int")
    tasks = min(2 * len(meets), 20_000, 4 + sum(x.rows * y.rows for x, y in like) // 10_000_000)

    def side(role: int) -> DataFrame:
        mine = plan.select("k", F.col(f"band{role}").alias("band"), F.col(f"block{role}").alias("block"))
        return cells.where(F.col("role") == role).join(F.broadcast(mine), ["band", "block"]).select("k", F.col("data").alias(f"data{role}")).repartition(tasks, "k")

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for x, y in zip(part["data1"], part["data2"]):
                (c, *left, groups), (d, *right, groups2) = _unpacked(x), _unpacked(y)
                lines, lines2 = _Lines(left[0], groups), _Lines(right[0], groups2)
                for a, b in _gathered(may_match(tuple(left), tuple(right))):
                    a, b = (at[c[a] != d[b]] for at in (a, b))
                    keep = _in_line(lines, lines2, a, b)
                    yield pd.DataFrame({"a": c[a[keep]], "b": d[b[keep]]})

    return side(1).join(side(2), "k").select("data1", "data2").mapInPandas(meet, "a long, b long")


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs of rows, many at a time."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows > ALIGNED:
            yield tuple(map(np.concatenate, zip(*held)))
            held, rows = [], 0
    if rows:
        yield tuple(map(np.concatenate, zip(*held)))


class Spelling:
    """Close words of a vocabulary, by what is left of them without a letter or two."""

    LONG = 24  # longer words are compared directly: they have too many such rests

    def __init__(self, vocabulary: set[str]):
        self.rests: dict[str, list[str]] = {}
        self.found: dict[str, list[str]] = {}
        self.long = [w for w in vocabulary if len(w) > self.LONG]
        for w in vocabulary:
            if 3 <= len(w) <= self.LONG and w.isalpha():
                for rest in self._rests(w):
                    self.rests.setdefault(rest, []).append(w)

    @staticmethod
    def _rests(word: str) -> set[str]:
        out = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
        return out | {r[:i] + r[i + 1 :] for r in out if len(r) < len(word) for i in range(len(r))} if len(word) >= 8 else out

    def of(self, word: str) -> list[str]:
        """The other words of the vocabulary that are close to a word."""
        hit = self.found.get(word)
        if hit is None:
            near = set(self.long) if len(word) > self.LONG - 3 else set()
            if 3 <= len(word) <= self.LONG + 2 and word.isalpha():
                near.update(v for rest in self._rests(word) for v in self.rests.get(rest, ()))
            hit = self.found[word] = [v for v in near if v != word and close(word, v)]
        return hit


def _masks(b: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _in_order(a: list[str], match: dict[str, int], size: int) -> int:
    """Length of a longest common subsequence, from the positions that match each word of ``a``."""
    v = full = (1 << size) - 1
    for w in a:
        u = v & match.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def same_order_words(a: list[str], b: list[str], spelling: Spelling | None = None) -> int:
    """Length of a longest common subsequence in which words match if they are equal or ``close``.

    Two different words that both texts have are never taken for each other.
    """
    spelling = spelling or Spelling(set(a) | set(b))
    masks, own = _masks(b), set(a)
    match = dict(masks)
    for w in own:
        fresh = w not in masks
        for v in spelling.of(w):
            if v in masks and (fresh or v not in own):
                match[w] = match.get(w, 0) | masks[v]
    return _in_order(a, match, len(b))


def same_story(a: list[str], b: list[str], spelling: Spelling) -> bool:
    """Whether at least SHARE of the longer one's words stand in the other in the same order."""
    least = SHARE * max(len(a), len(b)) - 1e-9
    if min(len(a), len(b)) < least:
        return False
    masks = _masks(b)
    # In whatever order: a word without an equal or close one in the other text matches nothing.
    able = sum(w in masks for w in a)
    if able < least:
        able += sum(any(v in masks for v in spelling.of(w)) for w in a if w not in masks)
    return able >= least and (_in_order(a, masks, len(b)) >= least or same_order_words(a, b, spelling) >= least)


def classes_and_links(df: DataFrame, key: str, text: str, split: str, train: str) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of each row, and the pairs of classes with the same story.

    members: (k, side, c), side 1 for training rows and 2 for others.  links: (a, b), a class with
    training rows and one with others; a class on both sides is linked with itself.  This form does
    not expand copies: its size is that of the rows and of the different texts' links.
    """
    kind = df.schema[key].dataType.simpleString()

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t, side in zip(part["k"], part["t"], part["side"]):
                w = words(t)
                if len(w) >= LEAST_WORDS:
                    line = " ".join(w)
                    d = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append((k, int(side), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), line))
            yield pd.DataFrame(rows, columns=["k", "side", "h1", "h2", "line"])

    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.when(F.col(split) == train, 1).otherwise(2).alias("side")).where("k IS NOT NULL AND t IS NOT NULL")
    rows = checkpointed(source.mapInPandas(read, f"k {kind}, side int, h1 long, h2 long, line string"))
    texts = checkpointed(rows.groupBy("h1", "h2").agg(F.min("line").alias("line"), F.bit_or("side").alias("side")).withColumns({"c": F.monotonically_increasing_id(), "n": F.size(F.split("line", " "))}))
    pairs = checkpointed(_meetings(texts))

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), CHECKED):
                some = part.iloc[at : at + CHECKED]
                pairs = [(x.split(" "), y.split(" ")) for x, y in zip(some["x"], some["y"])]
                spelling = Spelling({w for p in pairs for text in p for w in text})
                yield some.loc[np.array([same_story(x, y, spelling) for x, y in pairs], bool), ["a", "b"]]

    lines = texts.select("c", "line")
    both = pairs.join(lines.withColumnsRenamed({"c": "a", "line": "x"}), "a").join(lines.withColumnsRenamed({"c": "b", "line": "y"}), "b")
    links = both.mapInPandas(check, "a long, b long").unionByName(texts.where("side = 3").select(F.col("c").alias("a"), F.col("c").alias("b")))
    members = rows.select("k", "side", "h1", "h2").join(texts.select("h1", "h2", "c"), ["h1", "h2"]).select("k", "side", "c")
    return members, links


def cross_split_overlaps(df: DataFrame, key: str, text: str, split: str, train: str) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: rows on both sides of ``train`` with the same story.

    A row in a null or other split counts as not in ``train``.  Null, empty and short texts (under
    LEAST_WORDS words) have no pairs.  Copies of a row are paired each; a pair is given once.  Whole
    texts are read, whatever their length.  An empty table gives an empty result and other columns
    are not read.
    """
    members, links = classes_and_links(df, key, text, split, train)
    links = checkpointed(links)
    left = members.where("side = 1").select(F.col("c").alias("a"), F.col("k").alias("i"))
    right = members.where("side = 2").select(F.col("c").alias("b"), F.col("k").alias("j"))
    return links.join(left, "a").join(right, "b").select(F.least("i", "j").alias("row_id_a"), F.greatest("i", "j").alias("row_id_b"))


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder of the session."""
    return checkpointed(df)
