"""Secret scans: fixed patterns, and a character convolutional network over further candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lanewise.llm import _memory as M
from lanewise.llm import _words as W
from lanewise.llm._tables import cut

# The patterns, and the group and least length that a match must have.
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
MARKS = [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"]
#: The kind of spans that the network adds; it sorts after the others.
ADDED = "model"

#: Characters of the shortest candidate: the least value of the first pattern, of whose characters candidates are made.
LEAST = PATTERNS[0][3]
#: Characters of context before a candidate, of the candidate, and after it that the network sees.
BEFORE, INSIDE, AFTER = 24, 48, 12
WINDOW = BEFORE + INSIDE + AFTER
#: Characters between the starts of the windows of a candidate that one window can't hold.
STEP = INSIDE // 2
#: Logits are counted in slots of 1 / SLOTS, from -EDGE to EDGE.
SLOTS, EDGE = 64, 40
#: Bytes of text that are scored at once.
GROUP_BYTES = 1 << 16

_MADE = np.zeros(256, bool)
_MADE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_.=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end (code points) of every match, by start and then by kind as listed."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


@dataclass
class Found:
    """Candidates of some consecutive texts, and the windows over them."""

    x: np.ndarray  # characters of the texts, up to 127, with BEFORE zeros around each text
    text: np.ndarray  # of each candidate: its text, start and end in x, and label
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray  # 1: ends a base span or goes beyond it; 2: in a base span before its value
    zero: np.ndarray  # where each text starts in x
    base: dict[int, list[tuple[str, int, int]]]
    of: np.ndarray  # of each window: its candidate, and start and end in x
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray

    def window(self, i: int) -> str:
        a, b = int(self.first[i]), int(self.last[i])
        return (self.x[a - BEFORE : a].tobytes() + self.x[a:b].tobytes().ljust(INSIDE, b"\0") + self.x[b : b + AFTER].tobytes()).decode("ascii")


def _found(buf: np.ndarray, text_at: np.ndarray) -> Found:
    texts = len(text_at) - 1
    lead = (buf & 0xC0) != 0x80
    whole = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=whole[1:])
    gap = BEFORE * np.arange(1, texts + 1)
    zero = whole[text_at[:-1]] + gap
    x = np.zeros(int(whole[-1]) + BEFORE * (texts + 1), np.uint8)
    inside = np.ones(len(x), bool)
    inside[np.append(zero, len(x))[:, None] - np.arange(1, BEFORE + 1)] = False
    x[inside] = np.minimum(buf, 127)[lead]
    start, end = W.word_spans(buf, text_at, _MADE)
    signs = np.append(np.flatnonzero(buf == 0x3D), len(buf))
    sign = signs[np.searchsorted(signs, start)]
    parted = end - sign > LEAST
    start, end = np.sort(np.concatenate([start, sign[parted] + 1])), np.sort(np.concatenate([end, sign[parted]]))
    long = end - start >= LEAST
    start, end = start[long], end[long]
    text = np.searchsorted(text_at, start, side="right") - 1
    start, end = whole[start] + gap[text], whole[end] + gap[text]
    label, base = np.zeros(len(start), np.int64), _bases(buf, text_at)
    for t, spans in base.items():
        for _, a, b in spans:
            met = np.arange(np.searchsorted(end, zero[t] + a, side="right"), np.searchsorted(start, zero[t] + b))
            label[met] = np.where((end[met] >= zero[t] + b) | (label[met] == 1), 1, 2)
    count = np.maximum(1, -(-(end - start - INSIDE) // STEP) + 1)
    of = np.repeat(np.arange(len(start)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    first = np.where(count[of] == 1, start[of], np.minimum(start[of] + STEP * nth, end[of] - INSIDE))
    last = np.minimum(first + INSIDE, end[of])
    up, down = W._tables(len(x))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W._VALUES[x] * up[: len(x)])])
    a, b = first - BEFORE, last + AFTER
    hashes = W.mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return Found(x, text, start, end, label, zero, base, of, first, last, hashes)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str, int]]:
    """start, end, window and label of every run of LEAST or more characters of _MADE. A run whose
    first equals sign has LEAST or more characters after it is parted there, into name and value.

    The label is 1 if a fixed pattern found it, 2 if it only names the secret of a base span. A
    window has the same layout for every candidate: what stands before, the candidate, what stands
    after. A candidate longer than INSIDE has several windows, each at least STEP characters over
    its neighbour, so that each of its characters is seen.
    """
    buf = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    f = _found(buf, np.array([0, len(buf)]))
    return [(int(f.start[c] - f.zero[0]), int(f.end[c] - f.zero[0]), f.window(i), int(f.label[c])) for i, c in enumerate(f.of.tolist())]


def _suspects(buf: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Texts that can hold a match of a pattern; the others hold none."""
    runs, long = [_HEX[buf]], 1  # places from which 1, 2, 4, 8, 16 digits follow, and 24
    while long < 16:
        runs.append(runs[-1][:-long] & runs[-1][long:])
        long *= 2
    at = [np.flatnonzero(runs[4][:-8] & runs[3][16:])]
    raw = buf.tobytes()
    low = raw.lower()
    for data, mark in [(raw, b"AKIA"), *((low, m) for m in MARKS)]:
        places, i = [], data.find(mark)
        while i >= 0:
            places.append(i)
            i = data.find(mark, i + 1)
        at.append(np.array(places, np.int64))
    return np.unique(np.searchsorted(text_at, np.concatenate(at), side="right") - 1)


def _bases(buf: np.ndarray, text_at: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Base spans by text; texts without any may be missing."""
    return {t: base_spans(buf[text_at[t] : text_at[t + 1]].tobytes().decode("utf-8", "replace")) for t in _suspects(buf, text_at).tolist()}


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _sample(findings: int):
    """Of each task the distinct windows of smallest hash, up to ``findings`` of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, str]] = [{}, {}]
        largest = [np.uint64(2**64 - 1)] * 2  # no greater hash can be among the smallest
        for batch in batches:
            for _, buf, text_at in W.text_groups(batch.column("text"), 2 * GROUP_BYTES):
                f = _found(buf, text_at)
                known = f.label[f.of] == 1
                for y in (0, 1):
                    rows = np.flatnonzero((known == y) & (f.hash <= largest[y]))
                    h, at = np.unique(f.hash[rows], return_index=True)
                    for k, i in zip(h[:findings].tolist(), rows[at[:findings]].tolist()):
                        if k not in best[y]:
                            best[y][k] = f.window(i)
                    if len(best[y]) > findings:
                        best[y] = {k: best[y][k] for k in sorted(best[y])[:findings]}
                        largest[y] = np.uint64(max(best[y]))
        rows = [(y, k, w) for y in (0, 1) for k, w in best[y].items()]
        y, k, w = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch([pa.array(y, pa.int32()), pa.array(W.signed(np.array(k, np.uint64)), pa.int64()), pa.array(w, pa.string())], names=["label", "h", "window"])

    return run


class CharNet:
    """Characters to vectors, one convolution, ReLU, the largest and the mean value of each filter
    over the places of the candidate and over those around it, and a logistic output; trained by
    Adam on windows and labels. Places that hold padding, or that are partly in the candidate, don't
    count, so that the values of a place are the same in all windows."""

    SYMBOLS, WIDTH, DIM, FILTERS = 128, 5, 12, 24
    #: Places that are convolved at once.
    PLACES = 1 << 13

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (self.SYMBOLS, self.DIM)),
            "conv": r.normal(0, 0.2, (self.WIDTH * self.DIM, self.FILTERS)),
            "bias": np.zeros(self.FILTERS),
            "out": r.normal(0, 0.2, 4 * self.FILTERS),
            "out_bias": np.zeros(1),
        }
        self.scale, self.shift, self.least = 1.0, 0.0, 0.0
        self.looked_up: list[np.ndarray] | None = None
        self.room: np.ndarray | None = None

    @staticmethod
    def codes(windows: list[str]) -> np.ndarray:
        """Code points below 127 as they are, all others as 127."""
        x = np.array(windows, f"<U{WINDOW}").view(np.uint32).reshape(len(windows), WINDOW)
        return np.minimum(x, 127).astype(np.int64)

    def _forward(self, x: np.ndarray):
        e = self.p["embed"][x]
        places = x.shape[1] - self.WIDTH + 1
        wide = np.concatenate([e[:, j : j + places] for j in range(self.WIDTH)], axis=2)
        z = wide @ self.p["conv"] + self.p["bias"]
        held = np.stack([x[:, j : j + places] > 0 for j in range(self.WIDTH)]).all(axis=0)
        a, tops, parts, counts = np.maximum(z, 0), [], [], []
        for region in REGIONS:
            mine = (held & region)[:, :, None]
            b, n = a * mine, np.maximum(mine.sum(axis=1), 1)
            top = b.argmax(axis=1)
            parts += [np.take_along_axis(b, top[:, None, :], 1)[:, 0], b.sum(axis=1) / n]
            tops.append(top)
            counts.append(mine / n[:, None])
        pooled = np.concatenate(parts, axis=1)
        return wide, z, (tops, counts), pooled, pooled @ self.p["out"] + self.p["out_bias"]

    def tables(self) -> list[np.ndarray]:
        """What two, two and one symbols in a row add to the filters of a place (and the bias), so that
        a place takes three rows; padding adds what no sum makes positive."""
        if self.looked_up is None:
            one = [self.p["embed"] @ self.p["conv"][j * self.DIM : (j + 1) * self.DIM] for j in range(self.WIDTH)]
            one[-1] = one[-1] + self.p["bias"]
            for t in one:
                t[0] = -1e30
            pair = lambda t, u: (t[:, None] + u[None]).reshape(-1, self.FILTERS)
            self.looked_up = [t.astype(np.float32) for t in (pair(*one[:2]), pair(*one[2:4]), one[4])]
        return self.looked_up

    def scores(self, f: Found, rows: np.ndarray) -> np.ndarray:
        """Of some windows, in order, what candidate and surroundings add to the logit. Each place of the
        texts is convolved once, PLACES at a time, as caches hold those."""
        first, last, at = f.first[rows], f.last[rows], 0
        out = np.zeros((2, len(rows)))
        while at < len(rows):
            upto = int(np.searchsorted(first, first[at] + self.PLACES))
            low, high = int(first[at]) - BEFORE, int(last[upto - 1]) + AFTER
            out[:, at:upto] = self._scores(f.x[low:high], first[at:upto] - low, last[at:upto] - low)
            at = upto
        return out

    def _scores(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Largest values of 2, 4, 8 ... places in a row give those of any number."""
        k, n, w = self.FILTERS, len(x) - self.WIDTH + 1, self.WIDTH
        out = self.p["out"].astype(np.float32)
        two, next_two, one = self.tables()
        shown = x > 0
        held = shown[:n].copy()
        for j in range(1, w):
            held &= shown[j : n + j]
        x = x.astype(np.intp)
        pairs = x[:-1] * self.SYMBOLS + x[1:]
        length = last - first - w + 1
        power = np.frexp(length)[1] - 1
        levels = max(4, power.max(initial=0)) + 1
        if self.room is None or len(self.room) < (levels + 1) * n:
            self.room = np.zeros(((levels + 1) * n, k), np.float32)
        tops = self.room[: levels * n].reshape(levels, n, k)
        a, nothing = tops[0], self.room[levels * n : (levels + 1) * n]
        # clipping changes nothing, and lets take write to a in place
        two.take(pairs[:n], axis=0, out=a, mode="clip")
        a += next_two.take(pairs[2 : n + 2], axis=0)
        a += one.take(x[4:], axis=0)
        nothing[:] = 0
        np.maximum(a, nothing, out=a)  # of two arrays, as that is vectorised
        for e in range(1, levels):
            step, size = 1 << (e - 1), max(0, n + 1 - (1 << e))
            np.maximum(tops[e - 1, :size], tops[e - 1, step : size + step], out=tops[e, :size])
        top = lambda e, at: self.room.take(e * n + at, axis=0)
        sums = np.zeros((2, n + 1))
        for total, part in zip(sums, (out[k : 2 * k], out[3 * k :])):
            np.cumsum(a @ part, dtype=float, out=total[1:])
        count = np.zeros(n + 1, np.int64)
        np.cumsum(held, out=count[1:])
        spread = lambda v, x, y: v[y] - v[x]
        ahead, after = BEFORE - w + 1, AFTER - w + 1
        # no place of a candidate holds padding
        inner = np.maximum(top(power, first), top(power, first + length - (1 << power))) @ out[:k]
        inner = inner + spread(sums[0], first, first + length) / length + self.p["out_bias"]
        before = np.maximum(top(4, first - BEFORE), top(4, first - BEFORE + ahead - 16))
        outer = np.maximum(before, top(3, last + after - 8)) @ out[2 * k : 3 * k]
        total, of = (spread(v, first - BEFORE, first - BEFORE + ahead) + spread(v, last, last + after) for v in (sums[1], count))
        return np.stack([inner, outer + total / np.maximum(of, 1)])

    def both(self, windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of windows, and what their surroundings add to these."""
        x, half = self.codes(windows), 2 * self.FILTERS
        some = [self._forward(x[i : i + 512])[-2:] for i in range(0, len(x), 512)] or [(np.zeros((0, 2 * half)), np.zeros(0))]
        return np.concatenate([z for _, z in some]), np.concatenate([pooled[:, half:] @ self.p["out"][half:] for pooled, _ in some])

    def around(self, windows: list[str]) -> np.ndarray:
        return self.both(windows)[1]

    def logits(self, windows: list[str]) -> np.ndarray:
        return self.both(windows)[0]

    def probability(self, windows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(windows) + self.shift, -60, 60)))

    def fit(self, windows: list[str], labels: np.ndarray, steps: int = 400, rate: float = 4e-3, batch: int = 128) -> None:
        epochs = max(6, -(-steps * batch // max(len(windows), 1)) if len(windows) > batch else steps)
        x, r = self.codes(windows), np.random.default_rng(11)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                wide, z, (tops, counts), pooled, logit = self._forward(x[rows])
                d = balance[rows] * (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[rows]) / len(rows)
                g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()])}
                back = d[:, None] * self.p["out"]
                da = np.zeros_like(z)
                for k, (top, share) in enumerate(zip(tops, counts)):
                    ahead = back[:, 2 * k * self.FILTERS :]
                    da += share * ahead[:, None, self.FILTERS : 2 * self.FILTERS]
                    hit = np.take_along_axis(np.broadcast_to(share > 0, z.shape), top[:, None, :], 1)
                    np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + hit * ahead[:, None, : self.FILTERS], 1)
                dz = da * (z > 0)
                g["conv"] = wide.reshape(-1, wide.shape[2]).T @ dz.reshape(-1, self.FILTERS)
                g["bias"] = dz.sum((0, 1))
                dw = dz @ self.p["conv"].T
                cell = np.concatenate([x[rows][:, j : j + z.shape[1]].ravel() for j in range(self.WIDTH)])[:, None] * self.DIM + np.arange(self.DIM)
                slopes = np.concatenate([dw[:, :, j * self.DIM : (j + 1) * self.DIM].reshape(-1, self.DIM) for j in range(self.WIDTH)])
                g["embed"] = np.bincount(cell.ravel(), slopes.ravel(), self.SYMBOLS * self.DIM).reshape(self.SYMBOLS, self.DIM)
                step += 1
                for k, a in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, at: np.ndarray, secrets: np.ndarray, others: np.ndarray, recall: float, moved: np.ndarray) -> None:
        """Platt's scale and shift, from counts of labelled secrets and of other findings by logit. The
        least logit of an added span is the highest with that recall of the secrets and of ``moved``,
        the same secrets in other surroundings (as added ones don't follow the patterns' words)."""
        total, w = secrets + others, np.zeros(2)
        w[0] = 1.0
        z = np.stack([at, np.ones(len(at))], axis=1)
        loss = lambda w: float((total * np.logaddexp(0, z @ w) - secrets * (z @ w)).sum() + 0.01 * (w @ w))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
            step = np.linalg.solve((z * (total * p * (1 - p))[:, None]).T @ z + 0.02 * np.eye(2), z.T @ (total * p - secrets) + 0.02 * w)
            size = 1.0
            while size > 1e-6 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
        self.scale, self.shift = max(0.05, float(w[0])), float(w[1])
        every = secrets + moved
        below = np.flatnonzero(every.sum() - np.cumsum(every) + every >= recall * every.sum())
        highest = below[-1] if every.any() else len(at) - 1
        self.least = float(at[highest]) - 0.5 / SLOTS


_PLACES = np.arange(WINDOW - CharNet.WIDTH + 1)
#: Places of the candidate, and of what stands around it.
REGIONS = ((_PLACES >= BEFORE) & (_PLACES <= BEFORE + INSIDE - CharNet.WIDTH), (_PLACES <= BEFORE - CharNet.WIDTH) | (_PLACES >= BEFORE + INSIDE))


def train_both(findings: pd.DataFrame) -> list[CharNet] | None:
    """Two networks, each trained on a fold of the windows (the last bit of the hash). The first
    scores all windows but those that it learned, which the second scores; so none scores, or is
    calibrated on, a window that it learned."""
    fold = findings.h.to_numpy().astype(np.int64) & 1
    nets = [train(findings[fold == f].reset_index(drop=True)) for f in (0, 1)]
    if None in nets:
        return None
    nets[0].learned = np.sort(findings.h.to_numpy().astype(np.int64).view(np.uint64)[fold == 0])
    return nets


def train(findings: pd.DataFrame) -> CharNet | None:
    """A network from window and label; None unless both labels occur."""
    if findings.empty or findings.label.value_counts().reindex([0, 1], fill_value=0).min() < 1:
        return None
    net, labels, windows = CharNet(), findings.label.to_numpy().astype(float), findings.window.tolist()
    # secrets once more after what stands before others, as a secret need not follow a known word
    ahead = [w[:BEFORE] for w, v in zip(windows, labels) if v == 0]
    moved = [ahead[i % len(ahead)] + w[BEFORE:] for i, w in enumerate(w for w, v in zip(windows, labels) if v == 1)]
    net.fit(windows + moved, np.concatenate([labels, np.ones(len(moved))]))
    net.elsewhere = net.around([w for w, v in zip(windows, labels) if v == 0])
    return net


def _logits(nets: list[CharNet], f: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window the network that scores it, the logit, and the logit with the surroundings of a
    fitted finding that is no secret."""
    which, out, moved = np.zeros(len(f.hash), np.int64), np.zeros(len(f.hash)), np.zeros(len(f.hash))
    if not len(which):
        return which, out, moved
    known = nets[0].learned
    which[known[np.minimum(np.searchsorted(known, f.hash), len(known) - 1)] == f.hash] = 1
    inner, outer = nets[0].scores(f, np.arange(len(which)))
    place = f.hash >> np.uint64(1)
    out, moved = inner + outer, inner + nets[0].elsewhere[(place % np.uint64(len(nets[0].elsewhere))).astype(np.int64)]
    other = np.flatnonzero(which)
    if len(other):
        windows, net = [f.window(i) for i in other.tolist()], nets[1]
        out[other], around = net.both(windows)
        moved[other] = out[other] - around + net.elsewhere[(place[other] % np.uint64(len(net.elsewhere))).astype(np.int64)]
    return which, out, moved


_LOGIT_SLOTS = 2 * EDGE * SLOTS + 1


def _slot(z: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(z, -EDGE, EDGE) + EDGE) * SLOTS).astype(np.int64)


def _score(nets: list[CharNet] | None, floors: list[float], id_type: pa.DataType):
    """A row for each text: base spans, candidates outside them whose logits reach the floors, and
    the highest logit by either network. After a task's last, rows of counts of its windows by
    network, label (2: secrets in other surroundings) and slot of the logit."""
    names = ["doc_id", "base", "near", "top", "other", "slot", "n"]
    near_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("z", pa.float64()), ("net", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(6 * _LOGIT_SLOTS, np.int64)
        for batch in batches:
            rows = batch.num_rows
            base: list[list[dict]] = [[] for _ in range(rows)]
            near: list[list[dict]] = [[] for _ in range(rows)]
            top = np.full((2, rows), -np.inf)
            for row, buf, text_at in W.text_groups(batch.column("text"), GROUP_BYTES):
                found = None if nets else _bases(buf, text_at)
                if nets:
                    f = _found(buf, text_at)
                    found = f.base
                    net, z, moved = _logits(nets, f)
                    label = (f.label[f.of] == 1).astype(np.int64)
                    for kind, some, logit in ((label, label >= 0, z), (2, label == 1, moved)):
                        total += np.bincount(((3 * net + kind) * _LOGIT_SLOTS + _slot(logit))[some], minlength=len(total)) if some.any() else 0
                    np.maximum.at(top, (net, row + f.text[f.of]), z)
                    for i in np.flatnonzero((f.label[f.of] == 0) & (z >= np.array(floors)[net])).tolist():
                        c = int(f.of[i])
                        t = int(f.text[c])
                        near[row + t].append({"start": int(f.start[c] - f.zero[t]), "end": int(f.end[c] - f.zero[t]), "z": float(z[i]), "net": int(net[i])})
                for t, spans in found.items():
                    base[row + t] = [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            nothing = pa.nulls(rows, pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(near, near_type), pa.array(top[0]), pa.array(top[1]), nothing, nothing], names=names)
        at = np.flatnonzero(total)
        no = lambda kind: pa.nulls(len(at), kind)
        yield pa.record_batch([no(id_type), no(pa.list_(_SPAN)), no(near_type), no(pa.float64()), no(pa.float64()), pa.array(at), pa.array(total[at])], names=names)

    return run


def scan_secrets(docs: DataFrame, recall: float = 0.95, findings: int = 4000, columns: tuple[str, str] = ("doc_id", "text"), network: bool = True) -> DataFrame:
    """For each row of docs: doc_id, base and added (arrays of kind, start, end; code points, end
    exclusive, by start), score (1 with a base span, else the highest probability of a candidate).

    Fixed patterns give the base spans. Every run of 6 or more characters that a secret's value can
    have is a candidate; the patterns label it (names of secrets are none), and long ones are seen
    by overlapping windows. A network's weights are fitted to one half of at most ``findings``
    distinct windows of either label, those of the smallest hash; a second network, fitted to the
    other half, scores the windows that the first has learned. Scale, shift and threshold, the
    highest one that keeps ``recall`` of labelled secrets, are of counts over every candidate of
    every text. Candidates outside base spans that reach it are added.

    Texts are scored once: counts come with the candidates above a floor, which the fitted sample
    puts well below the threshold to expect. Should the threshold be lower still, a second pass
    with it as the floor follows, so the floor never changes a result.

    Null text counts as empty. Rows alike are judged alike. Without findings of both labels in both
    halves nothing is added. An empty table gives an empty result. Other columns are ignored.
    With ``network`` false nothing is added either: base is the same, and no network is trained or run.
    """
    doc_id, text = columns
    kind = docs.schema[doc_id].dataType
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    nets = None
    if network:
        sample = cut(texts.select("text").mapInArrow(M.batches(_sample(findings)), "label int, h bigint, window string").distinct())
        # as unsigned: those without the sign bit come first
        order = [F.col("h") < 0, F.col("h"), F.col("window")]
        known = pd.concat([sample.filter(F.col("label") == y).orderBy(*order).limit(findings).toPandas() for y in (0, 1)], ignore_index=True)
        nets = train_both(known)
    floors = [guess(net, known[(known.h.to_numpy().astype(np.int64) & 1) == 1 - f], recall) for f, net in enumerate(nets)] if nets else [0.0, 0.0]
    schema = f"doc_id {kind.simpleString()}, base {span}, near array<struct<start:bigint,end:bigint,z:double,net:int>>, top double, other double, slot bigint, n bigint"
    scored = texts.mapInArrow(M.batches(_score(nets, floors, to_arrow_type(kind))), schema)
    scored = cut(scored) if nets else scored
    rows = scored.filter("slot is null")
    if not nets:
        return rows.select("doc_id", "base", F.array().cast(span).alias("added"), F.when(F.size("base") > 0, 1.0).otherwise(0.0).alias("score"))
    counted = np.zeros(6 * _LOGIT_SLOTS)
    for r in scored.filter("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counted[r.slot] = r.n
    for net, (others, secrets, moved) in zip(nets, counted.reshape(2, 3, _LOGIT_SLOTS)):
        net.calibrate(np.arange(_LOGIT_SLOTS) / SLOTS - EDGE, secrets, others, recall, moved)
    least = [net.least for net in nets]
    if any(x < y for x, y in zip(least, floors)):
        rows = cut(texts.mapInArrow(M.batches(_score(nets, least, to_arrow_type(kind))), schema)).filter("slot is null")
    reached = F.filter("near", lambda x: x["z"] >= F.when(x["net"] == 0, least[0]).otherwise(least[1]))
    added = F.array_sort(F.array_distinct(F.transform(reached, lambda x: F.struct(F.lit(ADDED).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))))
    odds = [1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), net.scale * F.col(c) + net.shift)))) for net, c in zip(nets, ("top", "other"))]
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.greatest(*[F.when(F.col(c) > float("-inf"), p).otherwise(0.0) for p, c in zip(odds, ("top", "other"))]))
    return rows.select("doc_id", "base", added.alias("added"), score.alias("score"))


def guess(net: CharNet, findings: pd.DataFrame, recall: float) -> float:
    """A logit below the threshold to expect, from findings that the network has not learned."""
    z, around = net.both(findings[findings.label == 1].window.tolist())
    z = np.concatenate([z, z - around + np.median(net.elsewhere)])
    return float(np.quantile(z, 1 - recall)) - 2.0


def listed(spans) -> F.Column:
    """kind:start:end by start and then by kind as listed, comma-joined."""
    order = F.array(*[F.lit(k) for k, *_ in PATTERNS], F.lit(ADDED))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.array_position(order, x["kind"]).alias("o"), x["end"].alias("e"), x["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")
