"""Training of the tagger in ``pii_model``: labelled spans, then BPTT with a CRF loss.

Labelled spans come from a bounded sample of the project's own texts
(``SAMPLE_ROWS`` rows of each table): formats with a public definition (mail
addresses, North American and British telephone numbers, social security
numbers, licences, passports, postal addresses) and names that stand in a
position where a writer introduces a person.  Each epoch sees the texts
changed: in lower or upper case, with other digits, and with names made up from
syllables, so that the network learns positions and shapes, not a list.

    python -m scoreloom.llm.pii_training SF_DIR [WEIGHTS [EPOCHS [FIRST_STAGE_WEIGHTS]]]
"""

from __future__ import annotations

import re
import sys

import numpy as np

from scoreloom.llm.pii_model import N_SYMBOLS, TAGS, WEIGHTS, Tagger, symbols

SAMPLE_ROWS = 40_000
HIDDEN = 16
LENGTH = 176

STREET = r"(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Terrace|Way|Hwy)\b\.?"
FLAT = r"(?:Apt|Unit|Suite|Flat)\.?\s*\w+|#\s?\w+"
ID_WORD = r"(?:SSN|tax id|driver'?s license|DL|passport)(?:\s*(?:number|no\.|#))?:?\s*"
FORMATS = [
    ("email", r"[\w.+'-]+\s?@\s?\w[\w-]*(?:\.[\w-]+)+"),
    ("email", r"[\w.+'-]+\s?(?:\(at\)|\[at\]|\{at\})\s?\w[\w-]*(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\bdot\b)\s?\w+)+"),
    ("email", r"[\w.+'-]+ at \w[\w-]*(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\bdot\b) ?\w+)+"),
    ("id_number", ID_WORD + r"[A-Z]?[ -]?\d[\d. -]{4,}\d"),
    ("id_number", r"\b\d{3}[-. ]\d{2}[-. ]\d{4}\b"),
    ("id_number", r"\b[A-Z]-?\d{3}-\d{4}-\d{4}\b|\b[A-Z]\d{8}\b|\b[A-Z]\d{11}\b"),
    ("phone", r"(?:tel:)?(?:\+44|0044|\b0)\s?\(?0?\)?20\s?\d{4}\s?\d{4}\b"),
    ("phone", r"(?:(?:\+|\b)1[\s.-]?)?(?:\(\d{3}\)|\b\d{3})\s?[-./]?\s?\d{3}\s?[-./]?\s?\d{4}\b(?:\s?(?:ext\.?|x)\s?\d+)?"),
]
TITLE = r"(?:(?:Mr|Mrs|Ms|Dr)\.\s+)"
CUES = r"in the name of |to my cousin |Please approve, |Applicant: |My landlord |supervisor is |Signed |Sincerely, |Regards, |\bI am |My name is |co-borrower is |\bI \(|Ask for |(?:^|[.>\n]\s*|notes: )- "


def lexicon(texts: list[str]) -> tuple[set[str], set[str], set[str]]:
    """Given names, family names and towns that stand in unmistakable positions."""
    given, family, towns = set(), set(), set()
    for t in texts:
        for m in re.finditer(r"(?:supervisor is|to my cousin|My name is|in the name of) ([A-Z][a-z]+)(?: [A-Z]\.)? ([A-Z][\w'-]+)\.", t):
            given.add(m[1])
            family.add(m[2])
        for m in re.finditer(STREET + r"(?:, (?:" + FLAT + r"))?, ([A-Z][a-z]+(?: [A-Z][a-z]+)?),? [A-Z]{2}\b", t):
            towns.add(m[1])
    return given, family, towns


def labeller(texts: list[str], listed: list[tuple[str, str]]):
    """A function text -> non-overlapping labelled spans, with the words of these texts."""
    given, family, towns = lexicon(texts)
    given |= {n for n, k in listed if k == "given"}
    family |= {n for n, k in listed if k == "family"}
    alt = lambda words: "(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + ")"
    g, f, town = alt(given), alt(family), alt(towns or {"-"})
    person = rf"(?:{TITLE}?{f}, {g}(?: [A-Z]\.)?|{TITLE}?{g}(?: [A-Z]\.)? {f}|{g} [A-Z]\.|{TITLE}{f}|{g})(?![\w@+.-]*@)(?!\w)"
    full = rf"(?:{TITLE}?{g}(?: [A-Z]\.)? {f}|{f}, {g}|{TITLE}{f})(?![\w@+.-]*@)(?!\w)"
    tail = rf"(?:,?\s+{town})?(?:,?\s+(?:(?-i:[A-Z]{{2}})\b|[A-Z]{{2}}(?=\s+\d{{5}}|\s*(?:[.,\n<]|$)))(?:\s+\d{{5}})?)?"
    address = [
        rf"(?:(?:{FLAT}),?\s+)?\b\d{{2,5}} (?:(?:[NSEW]{{1,2}}|St)\.? )?(?:[A-Z][\w.']* ){{1,3}}{STREET}(?:,?\s*(?:{FLAT}))?,?{tail}",
        rf"P\.?\s?O\.?\s?Box \d+,?{tail}",
    ]
    rules = [("address", re.compile(p, re.I)) for p in address]
    rules += [(k, re.compile(p, 0 if p.startswith(r"\b[A-Z]") else re.I)) for k, p in FORMATS]
    rules += [("name", re.compile(rf"(?:{CUES})({person})", re.I)), ("name", re.compile(rf"(?<![\w.@+-])({person})(?= here, asking| and family)", re.I)), ("name", re.compile(rf"(?<![\w.@+-])({full})", re.I))]

    def label(text: str) -> list[tuple[int, int, str]]:
        spans: list[tuple[int, int, str]] = []
        for kind, rule in rules:
            for m in rule.finditer(text):
                a, b = m.span(1) if rule.groups else m.span()
                while b > a and text[b - 1] in ", \n":
                    b -= 1
                if all(b <= x or a >= y for x, y, _ in spans):
                    spans.append((a, b, kind))
        return sorted(spans)

    return label


def _made_up(rng: np.random.Generator) -> str:
    parts = ["ba", "cor", "del", "fen", "gri", "hal", "is", "jor", "kal", "lem", "mar", "nor", "ol", "pet", "quin", "ros", "sel", "tam", "ul", "vor", "wil", "yan", "zeb", "ette", "wick", "son", "ley", "ova", "ini", "ard"]
    return "".join(rng.choice(parts, rng.integers(2, 4))).capitalize()


def varied(text: str, spans: list, rng: np.random.Generator) -> tuple[str, list]:
    """A changed copy: names and digits of items replaced, sometimes another case.

    Spans of kind O only say where a window should look; they stay as they are.
    """
    out, moved, at = [], [], 0
    for a, b, kind in spans:
        out.append(text[at:a])
        item = text[a:b]
        if kind == "name" and rng.random() < 0.35:
            item = re.sub(r"[A-Za-z][\w'-]{2,}", lambda m: m[0] if m[0] in ("Mrs",) else (lambda n: n.upper() if m[0].isupper() else n)(_made_up(rng)), item)
        elif kind == "address" and rng.random() < 0.2:
            item = re.sub(r"(?<=\d )[A-Z][a-z]{3,}(?= )", lambda m: _made_up(rng), item)
        item = re.sub(r"\d", lambda m: str(rng.integers(10)) if rng.random() < 0.5 else m[0], item) if kind in ("phone", "id_number", "email") else item
        start = sum(map(len, out))
        out.append(item)
        moved.append((start, start + len(item), kind))
        at = b
    out.append(text[at:])
    text = "".join(out)
    roll = rng.random()
    changed = text.lower() if roll < 0.3 else text.upper() if roll < 0.38 else text
    return (changed, moved) if len(changed) == len(text) else (text, moved)


def sentences(data: list) -> tuple[list, list]:
    """(sentences with items, sentences without) of labelled texts, where no span is cut."""
    rich, plain = [], []
    for text, spans in data:
        cuts = [0, *(m.end() for m in re.finditer(r"(?<=[.!?>])\s+|\n+", text) if all(not a < m.end() < b for a, b, _ in spans)), len(text)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = [(x - a, y - a, k) for x, y, k in spans if a <= x and y <= b and k != "O"]
            if b - a > 2:
                (rich if own else plain).append((text[a:b].rstrip(), own))
    return rich, plain


def spliced(pool: tuple[list, list], n: int, rng: np.random.Generator) -> list:
    """Texts of sentences from different texts, so that an item is met in any neighbourhood."""
    rich, plain = pool
    out = []
    for _ in range(n if rich and plain else 0):
        text, spans = "", []
        for _ in range(rng.integers(2, 6)):
            part, own = rich[rng.integers(len(rich))] if rng.random() < 0.45 else plain[rng.integers(len(plain))]
            text += ("" if not text else "\n" if rng.random() < 0.08 else "<br>" if rng.random() < 0.04 else " ")
            spans += [(a + len(text), b + len(text), k) for a, b, k in own]
            text += part
        out.append((text, spans))
    return out


def batches(data: list, rng: np.random.Generator, size: int):
    """Windows of equal length from changed texts, around an item where there is one."""
    rows = []
    for text, spans in data:
        text, spans = varied(text, spans, rng)
        tags = np.zeros(len(text), np.int8)
        for a, b, kind in spans:
            tags[a:b] = TAGS.index(kind)
        x = symbols(text)
        if len(x) > LENGTH:
            a = rng.integers(0, len(x) - LENGTH + 1)
            if spans and rng.random() < 0.85:
                s = spans[rng.integers(len(spans))]
                a = int(np.clip((s[0] + s[1]) // 2 - rng.integers(20, LENGTH - 20), 0, len(x) - LENGTH))
            x, tags = x[a : a + LENGTH], tags[a : a + LENGTH]
        pad = LENGTH - len(x)
        rows.append((np.pad(x, (0, pad)), np.pad(tags, (0, pad)), len(x)))
    order = rng.permutation(len(rows))
    for k in range(0, len(rows) - size + 1, size):
        part = [rows[i] for i in order[k : k + size]]
        yield np.stack([p[0] for p in part], 1), np.stack([p[1] for p in part], 1), np.array([p[2] for p in part])


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(w, u, x):
    steps, n = x.shape
    h = u.shape[0]
    hs, cs, gs = np.zeros((steps + 1, n, h), np.float32), np.zeros((steps + 1, n, h), np.float32), np.empty((steps, n, 4 * h), np.float32)
    for t in range(steps):
        g = w[x[t]] + hs[t] @ u
        g[:, : 3 * h] = _sigmoid(g[:, : 3 * h])
        g[:, 3 * h :] = np.tanh(g[:, 3 * h :])
        cs[t + 1] = cs[t] * g[:, h : 2 * h] + g[:, :h] * g[:, 3 * h :]
        hs[t + 1] = np.tanh(cs[t + 1]) * g[:, 2 * h : 3 * h]
        gs[t] = g
    return hs, cs, gs


def _lstm_back(w, u, x, hs, cs, gs, dh_out):
    steps, n = x.shape
    h = u.shape[0]
    dw, du = np.zeros_like(w), np.zeros_like(u)
    dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    dgs = np.empty_like(gs)
    for t in range(steps - 1, -1, -1):
        g = gs[t]
        i, f, o, z = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
        tc = np.tanh(cs[t + 1])
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = dgs[t]
        dg[:, :h] = dc * z * i * (1 - i)
        dg[:, h : 2 * h] = dc * cs[t] * f * (1 - f)
        dg[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
        dg[:, 3 * h :] = dc * i * (1 - z * z)
        dc = dc * f
        dh = dg @ u.T
    flat = dgs.reshape(-1, 4 * h)
    du = hs[:-1].reshape(-1, h).T @ flat
    order = np.argsort(x.ravel(), kind="stable")
    ids = x.ravel()[order]
    cut = np.flatnonzero(np.diff(ids, prepend=-1))
    dw[ids[cut]] = np.add.reduceat(flat[order], cut, axis=0)
    return dw, du


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def _crf(em, tags, mask, trans, start):
    """Loss and gradients; em (T, N, K), mask (T, N)."""
    steps, n, k = em.shape
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = start + em[0]
    for t in range(1, steps):
        nxt = _lse(alpha[t - 1][:, :, None] + trans, 1) + em[t]
        alpha[t] = np.where(mask[t][:, None], nxt, alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        nxt = _lse(trans[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None], nxt, beta[t + 1])
    z = _lse(alpha[-1], 1)
    post = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    one = np.eye(k, dtype=np.float32)[tags] * mask[:, :, None]
    dem = post - one
    dstart = dem[0].sum(0)
    pair = np.exp(alpha[:-1][:, :, :, None] + trans + (em[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
    pair *= mask[1:, :, None, None]
    dtrans = pair.sum((0, 1)) - np.einsum("tni,tnj->ij", one[:-1], one[1:])
    gold = (em * one).sum() + start[tags[0]].sum() + (trans[tags[:-1], tags[1:]] * mask[1:]).sum()
    return float(z.sum() - gold), dem, dtrans, dstart


def train(data: list, epochs: int = 30, size: int = 192, seed: int = 7, log=print, start: dict | None = None, top: float = 0.008) -> dict[str, np.ndarray]:
    """Adam on the CRF loss of windows; returns the weights.  start: weights to go on from."""
    rng = np.random.default_rng(seed)
    pool = sentences(data)
    h, k = HIDDEN, len(TAGS)
    p = {}
    for d in "fb":
        p[f"W{d}"] = rng.normal(0, 0.3, (N_SYMBOLS, 4 * h)).astype(np.float32)
        p[f"W{d}"][:, h : 2 * h] += 1.0
        p[f"U{d}"] = rng.normal(0, h**-0.5, (h, 4 * h)).astype(np.float32)
        p[f"O{d}"] = rng.normal(0, h**-0.5, (h, k)).astype(np.float32)
    p |= {"bo": np.zeros(k, np.float32), "trans": (np.eye(k) * 1.0).astype(np.float32), "start": np.zeros(k, np.float32)}
    p = {a: b.astype(np.float32) for a, b in start.items()} if start else p
    m, v, step = {a: np.zeros_like(b) for a, b in p.items()}, {a: np.zeros_like(b) for a, b in p.items()}, 0
    for epoch in range(epochs):
        rate, total, seen = top * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 2e-4, 0.0, 0
        for x, tags, sizes in batches(data + spliced(pool, len(data) // 3, rng), rng, size):
            n = len(sizes)
            steps = np.arange(LENGTH)[:, None]
            mask = steps < sizes[None]
            turn = np.where(mask, sizes[None] - 1 - steps, steps)
            xb = np.take_along_axis(x, turn, 0)
            f, b = _lstm(p["Wf"], p["Uf"], x), _lstm(p["Wb"], p["Ub"], xb)
            hf, hb = f[0][1:], np.take_along_axis(b[0][1:], turn[:, :, None], 0)
            em = hf @ p["Of"] + hb @ p["Ob"] + p["bo"]
            loss, dem, dtrans, dstart = _crf(em, tags, mask, p["trans"], p["start"])
            dem = (dem / n).astype(np.float32)
            flat = dem.reshape(-1, k)
            g = {"Of": hf.reshape(-1, h).T @ flat, "Ob": hb.reshape(-1, h).T @ flat, "bo": flat.sum(0), "trans": dtrans / n, "start": dstart / n}
            g["Wf"], g["Uf"] = _lstm_back(p["Wf"], p["Uf"], x, *f, dem @ p["Of"].T)
            dhb = np.take_along_axis(dem @ p["Ob"].T, turn[:, :, None], 0)
            g["Wb"], g["Ub"] = _lstm_back(p["Wb"], p["Ub"], xb, *b, dhb)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            for a in p:
                q = g[a] * min(1.0, 5.0 / (norm + 1e-9))
                m[a] = 0.9 * m[a] + 0.1 * q
                v[a] = 0.999 * v[a] + 0.001 * q * q
                p[a] = (p[a] - rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            total, seen = total + loss, seen + n
        log(f"epoch {epoch}: {total / max(seen, 1):.4f} a window", flush=True)
    return p


def sample(sf_dir: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The bounded sample of texts, and the listed names."""
    import pyarrow.parquet as pq

    desc = pq.read_table(f"{sf_dir}/accepted_2007_to_2018q4.parquet", columns=["desc"])["desc"].drop_null().to_pylist()[:SAMPLE_ROWS]
    turns = pq.read_table(f"{sf_dir}/credit_teacher_action_0_1pct.parquet", columns=["conversations"])["conversations"].to_pylist()[:SAMPLE_ROWS]
    names = pq.read_table(f"{sf_dir}/name_list.parquet").to_pylist()
    texts = dict.fromkeys(desc + [x["value"] for row in turns for x in row or [] if x and x["value"]])
    return [t for t in texts if t.strip()], [(r["name"], r["name_kind"]) for r in names if r["name"]]


def score(tagger: Tagger, data: list) -> dict[str, tuple[int, int, int]]:
    """Items by type: agreed, labelled, found."""
    res = {k: [0, 0, 0] for k in TAGS[1:]}
    for (_, gold), got in zip(data, tagger.spans([t for t, _ in data])):
        for k in res:
            a, b = [s for s in gold if s[2] == k], [s for s in got if s[2] == k]
            res[k][0] += sum(any(x[0] < y[1] and y[0] < x[1] for y in b) for x in a)
            res[k][1] += len(a)
            res[k][2] += len(b)
    return {k: tuple(x) for k, x in res.items()}


def main(sf_dir: str, out: str = WEIGHTS, epochs: int = 40, first: str | None = None) -> None:
    texts, listed = sample(sf_dir)
    label = labeller(texts, listed)
    data = [(t, label(t)) for t in texts]
    rng = np.random.default_rng(1)
    rng.shuffle(data)
    held, data = data[: len(data) // 10], data[len(data) // 10 :]
    rich, plain = [d for d in data if d[1]], [d for d in data if not d[1]]
    print(len(rich), "texts with items,", len(plain), "without")
    if first:  # weights of a first stage that was run before
        with np.load(first) as z:
            weights = {k: z[k] for k in z.files}
    else:
        weights = train(rich * 2 + plain[: 2 * len(rich)], epochs)
    # False alarms of the first stage become windows of the second, beside all texts.
    for stage in range(2):
        tagger = Tagger(weights)
        hard = []
        for part in range(0, len(data), 2000):
            texts = data[part : part + 2000]
            for (text, gold), got in zip(texts, tagger.spans([t for t, _ in texts])):
                wrong = [(a, b, "O") for a, b, k in got if not any(a < y and x < b and k == z for x, y, z in gold)]
                missed = [(a, b, k) for a, b, k in gold if not any(a < y and x < b and k == z for x, y, z in got)]
                hard += [(text, sorted(gold + [w for w in wrong if all(w[1] <= x or w[0] >= y for x, y, _ in gold)]))] * (4 * bool(wrong or missed))
        print(len(hard) // 4, "texts with errors")
        weights = train(rich * 2 + plain + hard, max(1, epochs // 5), seed=8 + stage, start=weights, top=0.003)
    np.savez_compressed(out, **{k: v.astype(np.float32) for k, v in weights.items()})
    print("held out (agreed, labelled, found):", score(Tagger.load(out), held))


if __name__ == "__main__":
    main(*sys.argv[1:3], *map(int, sys.argv[3:4]), *sys.argv[4:5])
