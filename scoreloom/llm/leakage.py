"""Evaluation texts inside a corpus, by a generalised suffix automaton of the items.

The own wording of every item (its text without stock lines) goes into one suffix automaton of
words.  Corpus texts are streamed through it; at each word the automaton knows the longest suffix
of what was read that occurs in some item, and which items hold it.  The maximal matches of an item
are chained where they follow each other in the same order with short gaps, and the chain's stretch
is then checked exactly: an alignment that tolerates misspelt words must cover at least
``COVERAGE`` of the item's own wording, and at least ``FACTS`` of what tells this item from others
(words weighted by rarity among the items), so that the same sentences with other facts don't count.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, one automaton each.  The corpus is read
once: a task holds some texts and takes the blocks one after another, so that no more than one
automaton is in memory.  What is sent to the executors is the test set, checked to be of at most
``MOST_WORDS`` words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from scoreloom.llm.wording import aligned, placed_words, plain, words

BLOCK_WORDS, MOST_WORDS = 400_000, 50_000_000
HELD_CHARS = 20_000_000  # of the texts that a task holds while it takes the blocks
STOCK_ITEMS = 3  # a line of that many different item texts is stock
RUN, SPECIFIC = 3, 5  # words of a match that counts, and of one that makes a candidate
GAP = 10  # words between chained matches
COVERAGE, FACTS = 0.5, 0.6
CANDIDATE = 0.2  # coverage by exact matches from which the alignment is computed


def own_wording(items: list[tuple[int, str | None]]) -> dict[int, list[str]]:
    """Words of each item without the lines that at least STOCK_ITEMS different texts share.

    Null, empty and all-stock items have no wording and are left out.  Of items with the same id,
    the first in order of text counts.
    """
    lines = {}
    for item, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
        if text and item not in lines:
            lines[item] = [w for line in text.split("\n") if (w := tuple(words(line, han=True)))]
    holders = Counter(line for own in {tuple(own) for own in lines.values()} for line in set(own))
    return {i: w for i, own in lines.items() if (w := [x for line in own if holders[line] < STOCK_ITEMS for x in line])}


def rarity(texts: dict[int, list[str]]) -> dict[str, float]:
    """Weight of each word: the logarithm of items for each item that holds it."""
    df = Counter(w for t in texts.values() for w in set(t))
    return {w: math.log(1 + len(texts) / n) for w, n in df.items()}


class Automaton:
    """Generalised suffix automaton over the word lists of items."""

    def __init__(self, texts: dict[int, list[str]], weight: dict[str, float] | None = None):
        self.texts = texts
        # Items of fewer words than a match counts in are looked up whole.
        self.short: dict[str, list[tuple[int, list[str]]]] = defaultdict(list)
        for item, text in texts.items():
            if len(text) < RUN:
                self.short[text[0]].append((item, text))
        nxt: list[dict] = [{}]
        link, size = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for item, text in texts.items():
            last = 0
            for pos, w in enumerate(text):
                if w in nxt[last] and size[nxt[last][w]] == size[last] + 1:
                    last = nxt[last][w]
                    ends[last].append((item, pos))
                    continue
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                size.append(size[last] + 1)
                ends.append([(item, pos)])
                p = last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    if size[p] + 1 == size[q]:
                        link[cur] = q
                    else:
                        clone = len(nxt)
                        nxt.append(dict(nxt[q]))
                        link.append(link[q])
                        size.append(size[p] + 1)
                        ends.append([])
                        link[q] = link[cur] = clone
                        while p != -1 and nxt[p].get(w) == q:
                            nxt[p][w] = clone
                            p = link[p]
                last = cur
        for s in sorted(range(1, len(nxt)), key=lambda s: -size[s]):
            if size[s] >= RUN and link[s] > 0:
                ends[link[s]] = ends[link[s]] + ends[s]
        self.nxt, self.link, self.size, self.ends = nxt, link, size, ends
        self.weight = weight or rarity(texts)

    def matches(self, text: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """Maximal matches (start in text, start in item, words) by item."""
        nxt, link, size = self.nxt, self.link, self.size
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        s = length = 0
        for i, w in enumerate(text):
            t = nxt[s].get(w)
            if t is None:
                if length >= RUN:
                    for item, pos in self.ends[s]:
                        found[item].append((i - length, pos - length + 1, length))
                while s and (t := nxt[s].get(w)) is None:
                    s = link[s]
                    length = size[s]
                if t is None:
                    t = nxt[0].get(w)
                if t is None:
                    s = length = 0
                    continue
            s = t
            length += 1
        if length >= RUN:
            for item, pos in self.ends[s]:
                found[item].append((len(text) - length, pos - length + 1, length))
        return found

    def leaks(self, text: list[str]) -> list[tuple[int, float, int, int]]:
        """(item, coverage, first word, end word) of the items that the text holds."""
        out = []
        if self.short:
            whole: dict[int, int] = {}
            for i, w in enumerate(text):
                for item, own in self.short.get(w, ()):
                    if text[i : i + len(own)] == own:
                        whole.setdefault(item, i)
            out = [(item, 1.0, i, i + len(self.texts[item])) for item, i in whole.items()]
        for item, runs in self.matches(text).items():
            own = self.texts[item]
            if max(r[2] for r in runs) < min(SPECIFIC, len(own)):
                continue
            runs.sort()
            least = CANDIDATE * len(own)
            tried: dict[int, tuple[int, int]] = {}  # from: best (covered, to) of the chains that start there
            chains: list[list[int]] = []  # covered, from, to, next in item, next in text
            for at, pos, n in runs:
                pick = None
                for c in chains:
                    cut = max(0, c[3] - pos, c[4] - at)
                    if cut < n and at - c[4] <= GAP and -n < pos - c[3] <= 3 * GAP and (pick is None or c[0] - cut > pick[0]):
                        pick = (c[0] - cut, c)
                chains.append([n + (pick[0] if pick else 0), pick[1][1] if pick else at, at + n, pos + n, at + n])
                covered, start, end = chains[-1][:3]
                if covered >= least and covered > tried.get(start, (0, 0))[0]:
                    tried[start] = (covered, end)
                if len(chains) > 64:
                    chains = [c for c in chains if at - c[4] <= GAP]
            best: tuple[int, float, int, int] | None = None
            for window in _windows(tried, len(own), len(text)):
                hit = self._held(item, text, *window)
                if hit and (best is None or hit[1] > best[1]):
                    best = hit
                if best and best[1] == 1:
                    break
            if best:
                out.append(best)
        return out

    def _held(self, item: int, text: list[str], a: int, b: int) -> tuple[int, float, int, int] | None:
        """The best stretch of a window that holds enough of the item's wording and facts."""
        own = self.texts[item]
        for pairs in sorted(_stretches(aligned(own, text[a:b])), key=len, reverse=True):
            if len(pairs) < COVERAGE * len(own):
                return None
            mass = sum(self.weight[w] for w in own[pairs[0][0] : pairs[-1][0] + 1])
            if sum(self.weight[own[i]] for i, _ in pairs) >= FACTS * mass:
                return item, len(pairs) / len(own), a + pairs[0][1], a + pairs[-1][1] + 1
        return None


def _windows(chains: dict[int, tuple[int, int]], own: int, size: int) -> list[tuple[int, int]]:
    """Windows of a text to align with an item: every chain with room for what it lacks.

    Where the room reaches into another chain, the window cut off at that chain is tried as well, so
    that one stretch doesn't take the alignment from its neighbour.
    """
    out: dict[tuple[int, int], None] = {}
    for start, (covered, end) in sorted(chains.items(), key=lambda x: -x[1][0]):
        room = own - covered + GAP
        a, b = max(0, start - room), min(size, end + room)
        out[a, b] = None
        low = max([a, *(e for e in (e for _, e in chains.values()) if e <= start)])
        high = min([b, *(s for s in chains if s >= end)])
        out[low, high] = None
    return list(out)


def _stretches(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The parts of an alignment without a gap of more than GAP words in the text."""
    parts, cur = [], []
    for p in pairs:
        if cur and p[1] - cur[-1][1] > GAP + 1:
            parts.append(cur)
            cur = []
        cur.append(p)
    return [*parts, cur] if cur else parts


def blocks(own: dict[int, list[str]]) -> list[dict[int, list[str]]]:
    """Items in blocks of at most BLOCK_WORDS words (or one item)."""
    out, size = [{}], 0
    for item, w in own.items():
        if out[-1] and size + len(w) > BLOCK_WORDS:
            out.append({})
            size = 0
        out[-1][item] = w
        size += len(w)
    return out if out[0] else []


def find_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item, coverage, first_word, end_word): the corpus texts that hold test items.

    items is the test set, read to the driver; more than MOST_WORDS words of it are an error.  Null or
    empty texts hold nothing and null item ids are left out.  An item of fewer than RUN own words is
    found only where it stands whole.  Repeated corpus rows are reported each; items with equal texts
    are all reported.  Empty tables give an empty result.  Other columns are not read.
    """
    rows = [(r[0], r[1]) for r in items.select(item_key, item_text).where(items[item_key].isNotNull()).toLocalIterator()]
    kind = corpus.schema[key].dataType.simpleString()
    spark = corpus.sparkSession
    own = own_wording(rows)
    if sum(map(len, own.values())) > MOST_WORDS:
        raise ValueError(f"a test set of more than {MOST_WORDS} words; take it in parts")
    weight = rarity(own)  # over all items, so results don't depend on blocks
    shared = [spark.sparkContext.broadcast((block, {w: weight[w] for t in block.values() for w in t})) for block in blocks(own)]
    names = ["k", "item", "coverage", "first_word", "end_word"]

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single = Automaton(*shared[0].value) if len(shared) == 1 else None
        held: list[tuple[object, list[str]]] = []
        size = 0

        def through_blocks() -> pd.DataFrame:
            hits = []
            for block in shared:
                automaton = single or Automaton(*block.value)
                hits += [(k, *hit) for k, w in held for hit in automaton.leaks(w)]
                if not single:
                    block.__dict__.pop("_value", None)  # read again from its file when needed
            held.clear()
            return pd.DataFrame(hits, columns=names)

        for piece in pieces:
            for k, t in zip(piece["k"], piece["t"]):
                held.append((k, words(t, han=True)))
                size += len(t)
            if single or size > HELD_CHARS:
                yield through_blocks()
                size = 0
        yield through_blocks()

    schema = f"k {kind}, item long, coverage double, first_word int, end_word int"
    if not shared:
        return spark.createDataFrame([], schema).withColumnsRenamed({"k": key, "item": item_key})
    texts = corpus.selectExpr(f"`{key}` AS k", f"`{text}` AS t").where("t IS NOT NULL AND t <> ''")
    return texts.mapInPandas(run, schema).withColumnsRenamed({"k": key, "item": item_key})


def without_leaks(text: str, spans: list[tuple[int, int]]) -> str:
    """The plain text without the stretches of words in ``spans``."""
    text = plain(text)
    placed = placed_words(text)
    for a, b in sorted(spans, reverse=True):
        if a < len(placed):
            text = text[: placed[a][1]].rstrip() + " " + text[placed[min(b, len(placed)) - 1][2] :].lstrip(" .,;:!?\"'")
    return text.strip()
