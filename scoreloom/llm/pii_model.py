"""Character-level bidirectional LSTM with CRF transitions, in numpy.

The network reads one symbol per character, so its input layer is a table
lookup, and all four gates go through one ``tanh`` call (the logistic gates are
rewritten as half a shifted tanh with halved weights).  Windows are sorted by
length and the batch shrinks as the shorter ones end, so nothing is computed for
padding.

A text longer than a window is read in overlapping windows.  Each character
takes its emission scores from the window in whose middle it stands, and the
stitched scores of the whole text are decoded together, so a span that crosses a
window edge is still one span.
"""

from __future__ import annotations

import os

import numpy as np

TAGS = ("O", "email", "phone", "id_number", "address", "name")
WINDOW, OVERLAP = 1600, 64
BATCH_CHARS = 600_000
N_SYMBOLS = 103
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")


def _symbol_table() -> np.ndarray:
    """Symbol of each code point; from 0x3000 on all are letters."""
    table = np.full(0x110000, 100, np.uint8)
    for cp in range(0x3000):
        ch = chr(cp)
        if 32 <= cp < 127:
            table[cp] = cp - 31
        elif ch == "\n":
            table[cp] = 96
        elif ch.isspace():
            table[cp] = 97
        elif ch.isupper():
            table[cp] = 99
        elif ch.islower():
            table[cp] = 98
        elif ch.isalpha():
            table[cp] = 100
        elif ch.isdigit():
            table[cp] = 101
        else:
            table[cp] = 102
    return table


SYMBOLS = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Symbol ids of a text, one per code point; lone surrogates are allowed."""
    return SYMBOLS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


class Tagger:
    """Trained weights and the decoding of texts into typed spans."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.trans = weights["trans"].astype(np.float64)
        self.start = weights["start"].astype(np.float64)
        self.bias = weights["bo"].astype(np.float32)
        self._rooms = [np.zeros(0, np.float32), np.zeros(0, np.float32)]
        self.dirs = []
        for d in "fb":
            h = weights[f"U{d}"].shape[0]
            # Gates apart, logistic ones halved; states are kept doubled, so U and O are halved.
            gate = np.array([0.5, 0.5, 0.5, 1.0], np.float32)[:, None, None]
            table = weights[f"W{d}"].reshape(-1, 4, h).transpose(1, 0, 2) * gate
            loop = weights[f"U{d}"].reshape(h, 4, h).transpose(1, 0, 2) * gate * 0.5
            self.dirs.append(tuple(np.ascontiguousarray(x, np.float32) for x in (table, loop, weights[f"O{d}"] * 0.5)))
        # Bounds on what transitions can win back (see ``decode``): of one more position off O, of
        # entering and leaving a stretch off O, and of one that starts or ends with the text.
        t = self.trans
        self.step = float(max(0.0, (t[1:, 1:] - t[0, 0]).max()))
        enter, leave = float((t[0, 1:] - t[0, 0]).max()), float((t[1:, 0] - t[0, 0]).max())
        self.at_start, self.at_end = max(0.0, float((self.start[1:] - self.start[0]).max()) - enter), max(0.0, -leave)
        self.need = self.step - enter - leave - 1e-4

    @classmethod
    def load(cls, path: str = WEIGHTS) -> "Tagger":
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    def _scores(self, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of windows, read from the left and from the right; windows come by falling length."""
        size = np.array([len(w) for w in windows])
        steps, n = int(size[0]), len(windows)
        active = (size[None, :] > np.arange(steps)[:, None]).sum(1)
        rows = np.zeros((2, n, steps), np.uint8)
        for k, w in enumerate(windows):
            rows[0, k, : len(w)] = w
            rows[1, k, : len(w)] = w[::-1]
        ids = np.ascontiguousarray(rows.transpose(0, 2, 1)).astype(np.intp)
        outs = self._room(0, 2 * steps * n * len(TAGS)).reshape(2, steps, n, len(TAGS))
        for (w, u, o), x, out in zip(self.dirs, ids, outs):
            h = u.shape[1]
            state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            gates, rec = np.empty(4 * n * h, np.float32), np.empty(4 * n * h, np.float32)
            for t in range(steps):
                k = active[t]
                g, r = gates[: 4 * k * h].reshape(4, k, h), rec[: 4 * k * h].reshape(4, k, h)
                s, c = state[:k], cell[:k]
                np.take(w, x[t, :k], axis=1, out=g, mode="clip")
                np.matmul(s, u, out=r)
                g += r
                np.tanh(g, out=g)
                g[:3] += 1.0
                c *= g[1]
                g[0] *= g[3]
                c += g[0]
                c *= 0.5
                np.tanh(c, out=s)
                s *= g[2]
                np.matmul(s, o, out=out[t, :k])
        turned = self._room(1, outs.size).reshape(2, n, steps, len(TAGS))
        np.copyto(turned, outs.transpose(0, 2, 1, 3))
        return turned[0], turned[1]

    def _room(self, which: int, size: int) -> np.ndarray:
        """A buffer that is used again, as fresh memory costs more than filling it."""
        if len(self._rooms[which]) < size:
            self._rooms[which] = np.zeros(size, np.float32)
        return self._rooms[which][:size]

    def _emit(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of whole texts one after another, stitched from overlapping windows; and where each begins."""
        base = np.cumsum([0] + [len(x) for x in ids])
        jobs = []
        for i, x in enumerate(ids):
            at = 0
            while len(x):
                end = min(len(x), at + WINDOW)
                jobs.append((end - at, i, at))
                if end == len(x):
                    break
                at = end - OVERLAP
        jobs.sort(key=lambda j: -j[0])
        every = np.empty((base[-1], len(TAGS)), np.float32)
        k = 0
        while k < len(jobs):
            part = jobs[k : k + max(1, BATCH_CHARS // jobs[k][0])]
            left, right = self._scores([ids[i][at : at + length] for length, i, at in part])
            for j, (length, i, at) in enumerate(part):
                lead = OVERLAP // 2 if at else 0
                stop = length - (OVERLAP // 2 if at + length < len(ids[i]) else 0)
                begin = base[i] + at
                np.add(left[j, lead:stop], right[j, :length][::-1][lead:stop], out=every[begin + lead : begin + stop])
            k += len(part)
        every += self.bias
        return every, base

    def emissions(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Scores of whole texts, stitched from overlapping windows."""
        every, base = self._emit(ids)
        return [every[a:b] for a, b in zip(base[:-1], base[1:])]

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each text under the CRF."""
        base = np.cumsum([0] + [len(em) for em in emissions])
        tags = self._decode(np.concatenate([np.zeros((0, len(TAGS)), np.float32), *emissions]), base)
        return [tags[a:b] for a, b in zip(base[:-1], base[1:])]

    def _candidates(self, every: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Where a best path may leave O.

        A stretch off O gains at most the sum of ``step - lead`` over its positions (lead: of O's
        emission over the best other) less ``need``, so a position counts only if some stretch over
        it has a sum of ``need``.  The greatest such sum is the greatest running sum from the
        position on less the least one before it.
        """
        best = np.maximum(every[:, 1], every[:, 2])
        for k in range(3, len(TAGS)):
            np.maximum(best, every[:, k], out=best)
        gain = (best - every[:, 0]).astype(np.float64)
        gain += self.step
        full = np.flatnonzero(np.diff(base))
        gain[base[full]] += self.at_start
        gain[base[full + 1] - 1] += self.at_end
        upto = np.cumsum(gain)
        # Every text lies wholly below the one before, so running extremes don't cross over.
        before = np.concatenate(([0.0], upto))[base[full]]
        drop = np.abs(gain).sum() / max(len(full), 1) if len(full) < 2 else max(np.add.reduceat(np.abs(gain), base[full]).max(), 1.0)
        upto -= np.repeat(before + 2 * (drop + 1) * np.arange(len(full)), np.diff(base)[full])
        most = np.maximum.accumulate(upto[::-1])[::-1]
        upto -= gain
        return most - np.minimum.accumulate(upto) >= self.need

    def _decode(self, every: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Best tags of texts that lie one after another.

        Where ``_candidates`` says no, O is the best tag for certain; the rest, all runs of a call
        together, goes through Viterbi.
        """
        tags = np.zeros(len(every), np.int8)
        if not len(every):
            return tags
        on = self._candidates(every, base)
        edge = np.zeros(len(every) + 1, bool)
        edge[base] = True
        first = np.flatnonzero(on & (edge[:-1] | np.concatenate(([True], ~on[:-1]))))
        last = np.flatnonzero(on & (edge[1:] | np.concatenate((~on[1:], [True]))))
        order = np.argsort(first - last, kind="stable")
        first, last = first[order], last[order]
        done, n = 0, len(TAGS)
        while done < len(first):
            a, z = (x[done : done + max(1, 400_000 // int(last[done] - first[done] + 1))] for x in (first, last))
            done += len(a)
            size = z - a + 1
            steps, m = int(size[0]), len(a)
            em = np.zeros((steps, n, m))
            for j in range(m):
                em[: size[j], :, j] = every[a[j] : z[j] + 1]
            score = np.where(edge[a], self.start[:, None], self.trans[0][:, None]) + em[0]
            back = np.zeros((steps, n, m), np.int8)
            active = (size[None, :] > np.arange(steps)[:, None]).sum(1)
            for t in range(1, steps):
                q = active[t]
                now = score[:, :q]
                top, from_ = now[0] + self.trans[0][:, None], back[t, :, :q]
                for k in range(1, n):
                    other = now[k] + self.trans[k][:, None]
                    np.copyto(from_, k, where=other > top)
                    np.maximum(top, other, out=top)
                score[:, :q] = top + em[t, :, :q]
            best = (score + np.where(edge[z + 1], 0.0, self.trans[:, :1])).argmax(0)
            path = np.zeros((steps, m), np.int8)
            for t in range(steps - 1, -1, -1):
                q = active[t]
                path[t, :q] = best[:q]
                if t:
                    best[:q] = back[t, best[:q], np.arange(q)]
            for j in range(m):
                tags[a[j] : z[j] + 1] = path[: size[j], j]
        return tags

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, type) of the items of each text, by position."""
        base = np.cumsum([0] + [len(t) for t in texts])
        ids = symbols("".join(texts))
        every, base = self._emit([ids[a:b] for a, b in zip(base[:-1], base[1:])])
        tags = self._decode(every, base)
        edge = np.zeros(len(tags) + 1, bool)
        edge[base] = True
        edge[1:-1] |= tags[1:] != tags[:-1]
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        item = tags[starts] != 0 if len(tags) else np.zeros(0, bool)
        starts, ends = starts[item], ends[item]
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for a, b, i in zip(starts.tolist(), ends.tolist(), (np.searchsorted(base, starts, "right") - 1).tolist()):
            found[i].append((a - int(base[i]), b - int(base[i]), TAGS[tags[a]]))
        return found
