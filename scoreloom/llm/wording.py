"""Words of a text, free of case, punctuation, layout and look-alike characters."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans("абвгезікмнорстухуѕјԁһӏԛԝαοερντικυхАВЕКМНОРСТУХІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abbre3ikmhopctyxysjdhlqwaoepvtikuxABEKMHOPCTYXISJABEZHIKMNOPTYX")
BREAKS = re.compile(r"[\u2010-\u2015…/|\\]|-{2,}|\.{2,}")
MARKS = re.compile(r"[^\w\s]|_")
HAN = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]")
PART = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]|[^\s\u3400-\u9fff\uf900-\ufaff]+")
HIDDEN = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u0300-\u036f]")


def plain(text: str) -> str:
    """The text with entities, compatibility forms, hidden and look-alike characters resolved."""
    if text.isascii() and "&" not in text:
        return text
    text = html.unescape(text) if "&" in text else text
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text)
    return HIDDEN.sub("", unicodedata.normalize("NFKD", text)).translate(LOOKALIKES)


def words(text: str | None, han: bool = False) -> list[str]:
    """Lower-case words; marks inside a word are dropped ('$9,750' is '9750').

    han: every Chinese character is a word, as nothing parts the words of that script.
    """
    if not text:
        return []
    line = MARKS.sub("", BREAKS.sub(" ", plain(text).lower()))
    return (HAN.sub(r" \g<0> ", line) if han and not line.isascii() else line).split()


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """The words of an already plain text, Chinese by characters, with their character positions."""
    masked = BREAKS.sub(lambda m: " " * len(m[0]), text)
    out = []
    for m in PART.finditer(masked):
        w = MARKS.sub("", m[0].lower())
        if w:
            out.append((w, m.start(), m.end()))
    return out


def close(a: str, b: str) -> bool:
    """Equal, or one misspelt: one edit (two from eight letters on) between words with letters."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if min(la, lb) < 3 or abs(la - lb) > 2 or not (a.isalpha() and b.isalpha()):
        return False
    most = 2 if min(la, lb) >= 8 else 1
    if abs(la - lb) > most:
        return False
    k = 0
    while k < la and k < lb and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if max(len(a), len(b)) <= 1:
        return True
    if len(a) == len(b) == 2 and a == b[::-1]:
        return True
    if most < 2:
        return False
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1] <= most


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two word lists, misspelt words counting as equal."""
    n, m = len(a), len(b)
    head = 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    pairs = [(k, k) for k in range(head)]
    x, y = a[head : n - tail], b[head : m - tail]
    if x and y:
        known: dict[tuple[str, str], bool] = {}
        same = []
        for u in x:
            row = []
            for v in y:
                hit = known.get((u, v))
                if hit is None:
                    hit = known[u, v] = close(u, v)
                row.append(hit)
            same.append(row)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            here, below, row = best[i], best[i + 1], same[i]
            for j in range(len(y) - 1, -1, -1):
                here[j] = below[j + 1] + 1 if row[j] else max(below[j], here[j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if same[i][j] and best[i][j] == best[i + 1][j + 1] + 1:
                pairs.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return pairs + [(n - tail + k, m - tail + k) for k in range(tail)]
