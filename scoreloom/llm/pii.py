"""Personal information in free text: finding it and replacing it with typed placeholders.

Every text goes through the tagger of ``pii_model``; a short exact check then drops spans that
cannot be what their type says (a telephone number has at least seven digits, and so on) and joins
pieces that a stray character parted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.pii_model import TAGS, Tagger

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
# Function words; a span of nothing else is no name.
NO_NAME = frozenset("a all an and any as at but by each every for from god bless he her here hi his i if in is it its me my no of on or our she so some thank thanks that the their them there they this to us was we who with you your".split())
CHUNK = 2000  # texts that are tagged together

_MAIL = re.compile(r"[\w.+'-]+ ?(?:@|\(at\)|\[at\]|\{at\}) ?\w[\w-]*(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}|\bdot\b) ?\w+)+|[\w.+'-]+ at \w[\w-]*(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\bdot\b) ?\w+)+", re.I)
_SSN = re.compile(r"(?<!\d)\d{3}([-. ])\d{2}\1\d{4}(?!\d)")
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")


def plausible(item: str, kind: str) -> bool:
    """What the type of an item demands of its characters."""
    digits = len(_DIGIT.findall(item))
    if kind == "email":
        return bool(re.search(r"\w.*(?:@|\bat\b|[({\[]at[)}\]]).*\w", item, re.I)) and bool(re.search(r"\.|\bdot\b", item, re.I))
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 6
    if kind == "address":
        return digits >= 1 and bool(_LETTER.search(item))
    return len(_LETTER.findall(item)) >= 2 and not NO_NAME.issuperset(re.findall(r"\w+", item.lower()))


def parts_of(text: str, a: int, b: int, kind: str) -> list[tuple[int, int]]:
    """An identity number's span cut where a second number begins."""
    if kind == "id_number":
        starts = [m.start() + a for m in _SSN.finditer(text[a:b])]
        cuts = [x for x in starts[1:]] + [a + m.end() for m in re.finditer(r"[.;,]\s+", text[a:b]) if len(_DIGIT.findall(text[a : a + m.start()])) >= 6 and len(_DIGIT.findall(text[a + m.end() : b])) >= 6]
        edges = [a, *sorted(set(cuts)), b]
        return list(zip(edges[:-1], edges[1:]))
    return [(a, b)]


def tidy(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The tagger's spans after the exact check.

    Spans are joined over at most two marks, widened to whole words (mail addresses to the whole
    address), cut where two numbers were run together, and dropped if their characters cannot be
    what the type says.  A number in the form of a social security number is no telephone number.
    """
    joined: list[list] = []
    for a, b, kind in spans:
        if joined and joined[-1][2] == kind and a - joined[-1][1] <= 2 and not re.search(r"[\n.;]\s|\w", text[joined[-1][1] : a]):
            joined[-1][1] = b
        else:
            joined.append([a, b, kind])
    mails = [m.span() for m in _MAIL.finditer(text)] if any(k in ("email", "name") for *_, k in joined) else []
    out: list[tuple[int, int, str]] = []
    for a, b, kind in joined:
        mail = next(((x, y) for x, y in mails if a < y and x < b), None) if kind in ("email", "name") else None
        if mail and (kind == "email" or text[mail[0] : mail[1]].startswith(text[a:b].strip())):
            a, b, kind = *mail, "email"
        for a, b in parts_of(text, a, b, kind):
            while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
                a -= 1
            while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
                b += 1
            while a < b and (text[a].isspace() or text[a] in ",;:"):
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:"):
                b -= 1
            if kind == "phone" and _SSN.fullmatch(text[a:b]):
                kind = "id_number"
            if a < b and plausible(text[a:b], kind) and (not out or a >= out[-1][1]):
                out.append((a, b, kind))
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every item replaced by the placeholder of its type."""
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(parts) + text[at:]


def texts_of(df: DataFrame, table: str, key: str, text: str) -> DataFrame:
    """(table_name, record_id, turn_no, text) of a plain text column; blank texts hold nothing."""
    return df.select(F.lit(table).alias("table_name"), F.col(key).alias("record_id"), F.lit(0).alias("turn_no"), F.col(f"`{text}`").alias("text")).where(r"text RLIKE '\\S'")


def turns_of(df: DataFrame, table: str, key: str, turns: str, text: str) -> DataFrame:
    """The same of the turns of conversations, numbered from 1 by their position."""
    long = df.select(F.col(key).alias("record_id"), F.posexplode(F.col(f"`{turns}`")).alias("pos", "turn"))
    return long.select(F.lit(table).alias("table_name"), "record_id", (F.col("pos") + 1).alias("turn_no"), F.col("turn")[text].alias("text")).where(r"text RLIKE '\\S'")


def find_items(texts: DataFrame, weights: str | None = None, with_text: bool = False) -> DataFrame:
    """(table_name, record_id, turn_no, pii_type, item_no, start_at, end_at), or masked texts.

    texts: as from ``texts_of`` and ``turns_of``.  Positions count code points from 0; item_no
    counts the items of one type in one text from 1.  Equal texts of a batch are tagged once.
    Null, empty and blank texts hold no items; whole texts are read, whatever their length; an empty
    table gives an empty result.  with_text: one row (table_name, record_id, turn_no, masked_text,
    n_items) for each text instead, including those without items.
    """
    schema = "table_name string, record_id bigint, turn_no int, " + ("masked_text string, n_items int" if with_text else "pii_type string, item_no int, start_at int, end_at int")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.load(weights) if weights else Tagger.load()
        for part in parts:
            rows = []
            for k in range(0, len(part), CHUNK):
                piece = part.iloc[k : k + CHUNK]
                different = list(dict.fromkeys(piece["text"]))
                found = {t: tidy(t, s) for t, s in zip(different, tagger.spans(different))}
                for table, record, turn, text in zip(piece["table_name"], piece["record_id"], piece["turn_no"], piece["text"]):
                    spans = found[text]
                    if with_text:
                        rows.append((table, record, turn, masked(text, spans), len(spans)))
                        continue
                    count = dict.fromkeys(TAGS, 0)
                    for a, b, kind in spans:
                        count[kind] += 1
                        rows.append((table, record, turn, kind, count[kind], a, b))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"record_id": "Int64", "turn_no": "int32"}) if rows else out

    return texts.mapInPandas(run, schema)
