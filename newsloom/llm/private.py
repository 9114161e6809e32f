"""Personal data: fixed rules, and a character-level bidirectional LSTM with CRF transitions.

The network is trained here, in numpy, on windows of a bounded sample of documents
labelled with the rules' spans (B/I/O tags): windows over candidates (each ``@`` with its
unbroken run and each stretch of four or more digits joined by phone separators, with
their surroundings) and over ordinary text. It reads every character of every text, in
windows that overlap; each window is decoded by Viterbi, and each character takes the tag
of the window in which it lies most central, so spans are reconciled over the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import slices

# The kinds in their order, their patterns and bounds.
KINDS = ("email", "ip", "card", "phone", "model")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

# Candidates that the network learns from, and the context around them.
AT_RUN = re.compile(r"[^\s@]*@[^\s]*")
DIGITS = re.compile(r"[0-9](?:[\x20().+-]*[0-9])+")
CONTEXT, WIDTH = 8, 48
ALPHABET = "".join(map(chr, range(32, 127)))
O, B, I = 0, 1, 2
# Windows in which texts are read, and how far each starts after the one before. Batches of
# windows are filled up to a multiple of FILLED rows, so that every row is computed alike.
READ, READ_STEP = 192, 160
READ_ROWS, FILLED = 512, 64
# By how much a window must lie outside at every place to need no Viterbi: far more than rounding.
SURE = 0.25

# Bounds of the training sample: documents searched, windows of each label.
SAMPLE_DOCUMENTS = 20_000
SAMPLE_WINDOWS = 2_000

FOUND = "found array<struct<start:int,end:int,kind:string>>"


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, end and kind number of the rules' spans: leftmost, non-overlapping per kind,
    failing matches dropped without retry; sorted by kind, then start."""
    spans = [(*m.span(), 0) for m in EMAIL.finditer(text)] if "@" in text else []
    spans += [(*m.span(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and _luhn(digits):
            spans.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= PHONE_DIGITS[1]:
                spans.append((*m.span(), 3))
    return sorted(spans, key=lambda s: (s[2], s[0]))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of the text the network learns from: candidates with CONTEXT characters on
    each side, overlapping ones merged."""
    found = [m.span() for m in AT_RUN.finditer(text)] if "@" in text else []
    found += [m.span() for m in DIGITS.finditer(text) if sum(c.isdigit() for c in m[0]) >= 4]
    merged: list[list[int]] = []
    for a, b in sorted((max(0, a - CONTEXT), min(len(text), b + CONTEXT)) for a, b in found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def window_starts(a: int, b: int, width: int = WIDTH, step: int = WIDTH // 2) -> list[int]:
    """Starts of windows over [a, b) that overlap, by half unless ``step`` says else; the last ends at b."""
    if b - a <= width:
        return [a]
    starts = list(range(a, b - width, step))
    return starts + [b - width]


def codes(texts: list[str]) -> np.ndarray:
    """Characters as numbers: printable ASCII, one number for all others, one for padding."""
    out = np.full((len(texts), WIDTH), len(ALPHABET) + 1, np.int64)
    for r, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)[:WIDTH]
        out[r, : len(raw)] = np.where((raw >= 32) & (raw < 127), raw - 32, len(ALPHABET))
    return out


def code_row(text: str) -> np.ndarray:
    """The numbers of all characters of one text, as in ``codes``."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((raw >= 32) & (raw < 127), raw - 32, len(ALPHABET)).astype(np.uint8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Embedding, an LSTM each way, emissions per tag and CRF transitions."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, depth: int = 12, hidden: int = 16, tags: int = 3, seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (len(ALPHABET) + 2, depth))}
        for way in ("f", "b"):
            p[f"wx_{way}"] = rng.normal(0, depth**-0.5, (depth, 4 * hidden))
            p[f"wh_{way}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            p[f"bias_{way}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        p["out"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, tags))
        p["out_bias"] = np.zeros(tags)
        p["trans"], p["start"], p["end"] = np.zeros((tags, tags)), np.zeros(tags), np.zeros(tags)
        return cls(p)

    def _lstm(self, x, way):
        wx, wh, bias = self.p[f"wx_{way}"], self.p[f"wh_{way}"], self.p[f"bias_{way}"]
        n, steps, size = x.shape[0], x.shape[1], wh.shape[0]
        ahead = x @ wx + bias
        h, c = np.zeros((n, size)), np.zeros((n, size))
        keep = []
        for t in range(steps):
            z = ahead[:, t] + h @ wh
            i, f, o, g = _sigmoid(z[:, :size]), _sigmoid(z[:, size : 2 * size]), _sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
            c_before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            keep.append((i, f, o, g, c_before, h_before, tc, h))
        return np.stack([k[-1] for k in keep], 1), keep

    def _lstm_back(self, x, keep, grad_h, way):
        wx, wh = self.p[f"wx_{way}"], self.p[f"wh_{way}"]
        size = wh.shape[0]
        dz_all = np.zeros((x.shape[0], x.shape[1], 4 * size))
        dwh = np.zeros_like(wh)
        dh_next, dc_next = np.zeros((x.shape[0], size)), np.zeros((x.shape[0], size))
        for t in reversed(range(x.shape[1])):
            i, f, o, g, c_before, h_before, tc, _ = keep[t]
            dh = grad_h[:, t] + dh_next
            do = dh * tc
            dc = dc_next + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), do * o * (1 - o), dc * i * (1 - g**2)], 1)
            dwh += h_before.T @ dz
            dh_next, dc_next = dz @ wh.T, dc * f
            dz_all[:, t] = dz
        grads = {f"wx_{way}": x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * size), f"wh_{way}": dwh, f"bias_{way}": dz_all.sum((0, 1))}
        return grads, dz_all @ wx.T

    def emissions(self, x_codes):
        x = self.p["embed"][x_codes]
        forward, keep_f = self._lstm(x, "f")
        backward, keep_b = self._lstm(x[:, ::-1], "b")
        both = np.concatenate([forward, backward[:, ::-1]], 2)
        return both @ self.p["out"] + self.p["out_bias"], (x, both, keep_f, keep_b)

    def loss_and_grads(self, x_codes, tags):
        """Mean negative log-likelihood of the tag sequences under the CRF, and its gradients."""
        u, (x, both, keep_f, keep_b) = self.emissions(x_codes)
        n, steps, k = u.shape
        trans, start, end = self.p["trans"], self.p["start"], self.p["end"]
        alpha = np.zeros_like(u)
        alpha[:, 0] = start + u[:, 0]
        for t in range(1, steps):
            alpha[:, t] = _lse(alpha[:, t - 1][:, :, None] + trans[None], 1) + u[:, t]
        log_z = _lse(alpha[:, -1] + end, 1)
        beta = np.zeros_like(u)
        beta[:, -1] = end
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _lse(trans[None] + (u[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        rows = np.arange(n)[:, None]
        gold = start[tags[:, 0]] + u[rows, np.arange(steps)[None], tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1) + end[tags[:, -1]]
        loss = float(np.mean(log_z - gold))
        onehot = np.eye(k)[tags]
        du = (np.exp(alpha + beta - log_z[:, None, None]) - onehot) / n
        pair = np.exp(alpha[:, :-1, :, None] + trans[None, None] + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None])
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (tags[:, :-1], tags[:, 1:]), 1)
        grads = {
            "trans": (pair.sum((0, 1)) - gold_pairs) / n,
            "start": du[:, 0].sum(0),
            "end": (np.exp(alpha[:, -1] + end - log_z[:, None]) - onehot[:, -1]).sum(0) / n,
            "out": both.reshape(-1, both.shape[2]).T @ du.reshape(-1, k),
            "out_bias": du.sum((0, 1)),
        }
        d_both = du @ self.p["out"].T
        size = self.p["wh_f"].shape[0]
        g_f, dx_f = self._lstm_back(x, keep_f, d_both[:, :, :size], "f")
        g_b, dx_b = self._lstm_back(x[:, ::-1], keep_b, d_both[:, ::-1, size:], "b")
        grads |= g_f | g_b
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, x_codes, dx_f + dx_b[:, ::-1])
        grads["embed"] = embed
        return loss, grads

    def _spoken(self, x_codes) -> np.ndarray:
        """``emissions`` in single precision, one row per place and tag, nothing kept for gradients."""
        p = {k: v.astype(np.float32) for k, v in self.p.items()}
        n, steps = x_codes.shape
        size, depth, tags = p["wh_f"].shape[0], p["embed"].shape[1], len(p["start"])
        places = np.ascontiguousarray(x_codes.T).astype(np.intp)
        u = np.zeros((steps, tags, n), np.float32) + p["out_bias"][None, :, None]
        # A sigmoid is half a tanh of half its argument; so one tanh does for all gates.
        half = np.repeat(np.array([0.5, 1], np.float32), [3 * size, size])
        ways = (("f", p["out"][:size], range(steps), 1), ("b", p["out"][size:], range(steps - 1, -1, -1), -1))
        for way, out, order, ahead in ways:
            # One product gives a step's gates, from the state before, the character and the bias, and
            # the emissions of the state before.
            both = np.zeros((4 * size + tags, size + depth + 1), np.float32)
            both[: 4 * size, :size] = (p[f"wh_{way}"] * half).T
            both[: 4 * size, size:-1] = (p[f"wx_{way}"] * half).T
            both[: 4 * size, -1] = p[f"bias_{way}"] * half
            both[4 * size :, :size] = out.T
            given, c = np.zeros((size + depth + 1, n), np.float32), np.zeros((size, n), np.float32)
            given[-1] = 1
            h, read, said = given[:size], np.empty((n, depth), np.float32), np.empty((len(both), n), np.float32)
            for t in order:
                np.take(p["embed"], places[t], axis=0, out=read, mode="clip")
                given[size:-1] = read.T
                np.matmul(both, given, out=said)
                if t != order[0]:
                    u[t - ahead] += said[4 * size :]
                z = said[: 4 * size]
                np.tanh(z, out=z)
                gates = z[: 3 * size]
                gates *= 0.5
                gates += 0.5
                c *= gates[size : 2 * size]
                c += gates[:size] * z[3 * size :]
                np.multiply(gates[2 * size :], np.tanh(c), out=h)
            u[order[-1]] += np.matmul(both, given)[4 * size :]
        return u

    def decode(self, x_codes) -> np.ndarray:
        """The most likely tag sequence of each window (Viterbi)."""
        found = np.zeros(x_codes.shape, np.uint8)
        if len(x_codes):
            open_rows, u = self.open_windows(x_codes)
            found[open_rows] = self._viterbi(u)
        return found

    def open_windows(self, x_codes) -> tuple[np.ndarray, np.ndarray]:
        """The windows that are not surely outside at every place, and their emissions for ``_viterbi``."""
        u = self._spoken(np.pad(x_codes, ((0, -len(x_codes) % FILLED), (0, 0))))[:, :, : len(x_codes)]
        open_rows = np.flatnonzero(~self._outside(u))
        return open_rows, np.ascontiguousarray(u[:, :, open_rows])

    def _outside(self, u: np.ndarray) -> np.ndarray:
        """Windows that no path can read better than the one that is outside at every place.

        Each place's best step to another tag must lose to the step from outside to
        outside, by more than rounding; then every other path loses in sum.
        """
        p = {k: self.p[k].astype(np.float32) for k in ("trans", "start", "end")}
        into = p["trans"].max(0)[:, None] + u[1:]
        best = np.concatenate([p["start"][:, None] + u[:1], into])
        best[-1] += p["end"].max() - p["end"][O]
        base = np.concatenate([p["start"][O] + u[:1, O], p["trans"][O, O] + u[1:, O]])
        out_again = p["trans"][:, O].max() - p["trans"][O, O]
        lead = base - np.delete(best, O, axis=1).max(1)
        # A path may gain by coming back outside, at most once for each place it was away.
        return (lead > max(0.0, float(out_again)) + SURE).all(0)

    def _viterbi(self, u: np.ndarray) -> np.ndarray:
        steps, tags, rows = u.shape
        trans = self.p["trans"].astype(np.float32)
        score = self.p["start"].astype(np.float32)[:, None] + u[0]
        back = np.zeros(u.shape, np.uint8)
        for t in range(1, steps):
            fresh = np.empty_like(score)
            for tag in range(tags):
                top = score[0] + trans[0, tag]
                for before in range(1, tags):
                    other = score[before] + trans[before, tag]
                    back[t, tag][other > top] = before
                    top = np.maximum(top, other)
                fresh[tag] = top
            score = fresh + u[t]
        best = np.zeros((steps, rows), np.int64)
        best[-1] = (score + self.p["end"].astype(np.float32)[:, None]).argmax(0)
        every = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            best[t - 1] = back[t, best[t], every]
        return best.T


def fit_tagger(windows: list[str], tags: np.ndarray, rounds: int = 4, seed: int = 11) -> Tagger:
    """Adam on the CRF likelihood, batches of 64 windows."""
    net = Tagger.new(seed=seed)
    if not len(windows):
        net.p["start"][B] = net.p["start"][I] = -50.0
        return net
    x = codes(windows)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            _, grads = net.loss_and_grads(x[rows], tags[rows])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                net.p[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _tags_of(text: str, start: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(WIDTH, np.int64)
    for a, b, _ in spans:
        lo, hi = max(a, start), min(b, start + WIDTH)
        if lo < hi:
            tags[lo - start : hi - start] = I
            if a >= start:
                tags[a - start] = B
    return tags


def _reshaped(text: str, a: int, b: int, turn: int) -> str:
    """The span with its digits and letters redrawn, its shape kept."""
    rng = np.random.default_rng(turn)
    out = []
    for c in text[a:b]:
        if c.isdigit():
            out.append(str(rng.integers(10)))
        elif c.isascii() and c.isalpha():
            out.append(chr(rng.integers(26) + (65 if c.isupper() else 97)))
        else:
            out.append(c)
    return text[:a] + "".join(out) + text[b:]


def labelled_windows(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_windows: int = SAMPLE_WINDOWS):
    """Windows over candidates of a bounded sample of documents (chosen by the hash of
    their id), and one of ordinary text from each, tagged with the rules' spans; ``SAMPLE_WINDOWS``
    with spans, without, and of ordinary text at most."""
    share = max(1, -(-docs.count() // sample_documents))
    rows = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(text) - WIDTH)
                out.append((text[at : at + WIDTH], ",".join(map(str, _tags_of(text, at, spans))), 2))
                for a, b in regions(text):
                    for s in window_starts(a, b):
                        tags = _tags_of(text, s, spans)
                        out.append((text[s : s + WIDTH], ",".join(map(str, tags)), int(tags.any())))
                        for k, (x, y, kind) in enumerate(spans):
                            if kind in (0, 3) and s <= x and y <= s + WIDTH:
                                out.append((_reshaped(text, x, y, s + k)[s : s + WIDTH], ",".join(map(str, tags)), 1))
            yield pa.RecordBatch.from_pydict({
                "window": pa.array([o[0] for o in out], pa.string()), "tags": pa.array([o[1] for o in out], pa.string()),
                "found": pa.array([o[2] for o in out], pa.int32())})

    found = rows.mapInArrow(look, "window string, tags string, found int").distinct()
    order = F.xxhash64("window", "tags")
    chosen = [found.where(F.col("found") == s).orderBy(order, "window", "tags").limit(sample_windows) for s in (0, 1, 2)]
    return chosen[0].union(chosen[1]).union(chosen[2]).toArrow().sort_by([("found", "ascending"), ("window", "ascending"), ("tags", "ascending")])


def fit_private(docs: DataFrame, **bounds: int) -> Tagger:
    """The tagger trained on the labelled windows of ``docs``."""
    table = labelled_windows(docs, **bounds)
    windows = table.column("window").to_pylist()
    tags = np.array([[int(t) for t in s.split(",")] for s in table.column("tags").to_pylist()], np.int64).reshape(len(windows), WIDTH)
    return fit_tagger(windows, tags)


def read_tags(texts: list[str], net: Tagger) -> list[np.ndarray]:
    """The network's tag of every character of each text; nothing is passed over.

    Few windows need Viterbi, so those of many batches take its steps together.
    """
    starts = [window_starts(0, len(t), READ, READ_STEP) if t else [] for t in texts]
    tags = np.zeros((sum(map(len, starts)), READ), np.uint8)
    held, waiting, done = [], [], 0

    def settle_open() -> None:
        rows = np.concatenate([rows for rows, _ in waiting])
        tags[rows] = net._viterbi(np.concatenate([u for _, u in waiting], axis=2))
        waiting.clear()

    def decode() -> None:
        nonlocal done
        x = np.full((len(held), READ), len(ALPHABET) + 1, np.uint8)
        for row, part in zip(x, held):
            row[: len(part)] = part
        rows, u = net.open_windows(x)
        if len(rows):
            waiting.append((done + rows, u))
        done += len(held)
        held.clear()
        if sum(len(rows) for rows, _ in waiting) >= READ_ROWS:
            settle_open()

    for text, firsts in zip(texts, starts):
        row = code_row(text) if firsts else None
        for s in firsts:
            held.append(row[s : s + READ])
            if len(held) == READ_ROWS:
                decode()
    if held:
        decode()
    if waiting:
        settle_open()
    # Of two windows that overlap, the one whose middle is nearer decides.
    out, at = [], 0
    for text, firsts in zip(texts, starts):
        cuts = [0, *[(a + READ - 1 + b) // 2 + 1 for a, b in zip(firsts, firsts[1:])], len(text)]
        parts = [tags[at + k][cuts[k] - s : cuts[k + 1] - s] for k, s in enumerate(firsts)]
        out.append(np.concatenate([np.zeros(0, np.uint8), *parts]))
        at += len(firsts)
    return out


def find_in(texts: list[str], net: Tagger) -> list[list[tuple[int, int, int]]]:
    """The rules' spans and the network's other spans (kind 4) of each text, read whole."""
    results = []
    for text, tags in zip(texts, read_tags(texts, net)):
        base = base_spans(text)
        added = []
        if tags.any():
            before = np.concatenate([[O], tags[:-1]])
            outside = np.append(np.flatnonzero(tags != I), len(tags))
            for x in np.flatnonzero((tags == B) | ((tags == I) & (before == O))).tolist():
                y = int(outside[np.searchsorted(outside, x, "right")])
                if y - x >= 2 and not any(p < y and x < q for p, q, _ in base):
                    added.append((x, y, 4))
        results.append(sorted(base + added, key=lambda s: (s[2], s[0])))
    return results


def find_private(docs: DataFrame, net: Tagger) -> DataFrame:
    """``doc_id, found``: spans in code points, by kind and then start, for every row.

    The rules' spans always stay; the network adds spans that overlap none of them.
    Null and empty texts have none; repeated rows get equal ones; an empty table gives
    no rows; other columns are not looked at.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in slices(batches, "text", 1 << 20):
            found = find_in([t or "" for t in batch.column("text").to_pylist()], net)
            listed = [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(listed, kind)], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, f"doc_id long, {FOUND}")


def private_digests(found: DataFrame) -> DataFrame:
    """Counts of the rules' spans per kind, a hash of them, and all spans as text."""
    said = lambda f: F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"] != "model")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
    )
