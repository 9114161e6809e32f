"""Secret scans: fixed rules, and a character convolutional network for what the rules miss."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import slices
from newsloom.runtime import settle

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
BEFORE, BODY, AFTER, STRIDE = 20, 64, 8, 48
WIDTH = BEFORE + BODY + AFTER
ALPHABET = "".join(map(chr, range(32, 127)))

# Findings that one task trains on at a time, and how many of a rare label each group gets
# at least, as copies. The number of groups grows with the findings; none is left out.
GROUP_FINDINGS, GROUP_LEAST = 16_384, 256
# Rounds over a single group; with more groups, passes after which the networks are
# averaged, and rounds over each group in a pass.
ROUNDS, PASSES, PASS_ROUNDS = 12, 3, 2
# Held-out scores are counted in steps of one part of this.
STEPS = 10_000

FINDINGS = "findings array<struct<start:int,end:int,kind:string,score:double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, end and kind number of what the rules find, sorted."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        spans += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of 12 or more token characters with a digit and a letter that no rule touches."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not run.isalpha() and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            if not any(a < m.end() and m.start() < b for a, b, _ in spans):
                found.append(m.span())
    return found


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate with its surroundings, cut into windows of WIDTH characters that overlap."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE)
    after = text[end : end + AFTER].ljust(AFTER)
    body = text[start:end]
    return [
        before + body[at : at + BODY].ljust(BODY) + after
        for at in range(0, max(1, len(body) - BODY + STRIDE), STRIDE)
    ]


def codes(texts: list[str]) -> np.ndarray:
    """Characters as numbers: printable ASCII, and one number for all others."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((raw >= 32) & (raw < 127), raw - 32, len(ALPHABET)).reshape(len(texts), -1)


@dataclass
class CharNetwork:
    """Embedding, one convolution, maximum and mean over the window, logistic output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    scale: float = 1.0
    threshold: float = 0.5

    def forward(self, x: np.ndarray):
        width = self.kernel.shape[0] // self.embed.shape[1]
        seen = self.embed[x]
        patches = np.lib.stride_tricks.sliding_window_view(seen, width, axis=1)
        patches = patches.transpose(0, 1, 3, 2).reshape(len(x), -1, self.kernel.shape[0])
        active = np.maximum(patches @ self.kernel + self.bias, 0)
        pooled = np.concatenate([active.max(1), active.mean(1), np.ones((len(x), 1))], axis=1)
        return patches, active, pooled, pooled @ self.out

    def scores(self, texts: list[str]) -> np.ndarray:
        """What the network says of each window, before calibration."""
        parts = [self.forward(codes(texts[i : i + 512]))[3] for i in range(0, len(texts), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def chance(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -60, 60)))

    def chances(self, texts: list[str]) -> np.ndarray:
        """Calibrated chance that each window holds a secret."""
        return self.chance(self.scores(texts))

    def weights(self) -> np.ndarray:
        """All that training changes, as one row of numbers."""
        return np.concatenate([getattr(self, n).ravel() for n in LEARNED])

    def with_weights(self, flat: np.ndarray) -> CharNetwork:
        cuts = np.cumsum([getattr(self, n).size for n in LEARNED])[:-1]
        parts = zip(LEARNED, np.split(flat, cuts))
        return replace(self, **{n: part.reshape(getattr(self, n).shape) for n, part in parts})


LEARNED = ("embed", "kernel", "bias", "out")


def new_network(rng: np.random.Generator, filters: int = 24, depth: int = 10, width: int = 5) -> CharNetwork:
    return CharNetwork(
        rng.normal(0, 0.5, (len(ALPHABET) + 1, depth)),
        rng.normal(0, (2 / (width * depth)) ** 0.5, (width * depth, filters)),
        np.zeros(filters),
        rng.normal(0, 0.1, 2 * filters + 1),
    )


def fit_network(
    texts: list[str], secret: np.ndarray, rounds: int = ROUNDS, filters: int = 24, seed: int = 7, start: CharNetwork | None = None
) -> CharNetwork:
    """Adam on the logistic loss over windows, from ``start`` or a new network; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    net = new_network(rng, filters) if start is None else replace(start)
    if not len(texts) or secret.min() == secret.max():
        if start is None:
            net.out[:] = 0
            net.shift = -10.0
        return net
    filters, depth = len(net.bias), net.embed.shape[1]
    width = net.kernel.shape[0] // depth
    x = codes(texts)
    weight = np.where(secret == 1, 0.5 / secret.mean(), 0.5 / (1 - secret.mean()))
    names = LEARNED
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            patches, active, pooled, score = net.forward(x[rows])
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(score, -60, 60))) - secret[rows]) / len(rows)
            grads = {"out": pooled.T @ error}
            places = active.shape[1]
            back = np.repeat(error[:, None, None] * net.out[None, None, filters : 2 * filters] / places, places, axis=1)
            top = active.argmax(1)
            index = np.arange(len(rows))[:, None], top, np.arange(filters)[None, :]
            back[index] += error[:, None] * net.out[None, :filters]
            back *= active > 0
            grads["kernel"] = np.einsum("npk,npf->kf", patches, back, optimize=True)
            grads["bias"] = back.sum((0, 1))
            to_patch = back @ net.kernel.T
            seen = np.zeros((*x[rows].shape, depth))
            for offset in range(width):
                seen[:, offset : offset + places] += to_patch[:, :, offset * depth : (offset + 1) * depth]
            met, flat = x[rows].ravel(), seen.reshape(-1, depth)
            grads["embed"] = np.stack([np.bincount(met, flat[:, d], len(net.embed)) for d in range(depth)], axis=1)
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                move = (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, getattr(net, n) - 0.01 * move)
    return net


def calibrate(net: CharNetwork, texts: list[str], secret: np.ndarray, recall: float) -> None:
    """Fit scale and shift on held-out findings, then take the highest threshold that keeps ``recall``."""
    calibrate_scores(net, net.scores(texts), secret, np.ones(len(texts), np.int64), recall)


def calibrate_scores(net: CharNetwork, raw: np.ndarray, secret: np.ndarray, met: np.ndarray, recall: float) -> None:
    """``calibrate`` from scores, each with its label and how often it was met."""
    if not len(raw) or secret.min() == secret.max():
        return
    share = met / met.sum()
    scale, shift = 1.0, 0.0
    for _ in range(200):
        chance = 1 / (1 + np.exp(-np.clip(scale * raw + shift, -60, 60)))
        error = share * (chance - secret)
        scale, shift = max(scale - 0.05 * np.sum(error * raw), 0.05), shift - 0.05 * np.sum(error)
    net.scale, net.shift = float(scale), float(shift)
    order = np.argsort(raw[secret == 1], kind="stable")
    upto = np.cumsum(met[secret == 1][order])
    at = np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")
    net.threshold = float(net.chance(raw[secret == 1][order][at : at + 1])[0])


def ordinary(text: str) -> str:
    """Words of the text with numbers as in dates, paths, versions and names: nothing secret."""
    words = [w for w in text.split() if w.isalpha() and w.isascii()]
    if len(words) < 4:
        return ""
    a, b, c, d = (words[(len(text) * k) % len(words)] for k in (3, 5, 7, 11))
    n = len(text)
    forms = (
        f"{a} {2000 + n % 40}-{1 + n % 12:02}-{1 + n % 28:02}T{n % 24:02}.{n % 60:02} {b}",
        f"{a} {b}-{n}-{c}-{d} {d}",
        f"{a} {b}/{c}{n % 100}/{d}.html {a}",
        f"{a} {b}_v{n % 9}.{n % 20}.{n % 7}-{c} {d}",
        f"{a} {b}.{n % 100}={c}.{d} {b}",
        f"{a} {b.capitalize()}{c.capitalize()}{n % 1000} {d}",
        f"{a} {n}{n % 997}{b}{c} {d}",
    )
    return forms[n % len(forms)]


def labelled_findings(docs: DataFrame) -> DataFrame:
    """``window, secret``: the distinct windows of all documents with their label.

    What the rules find is a secret; other candidates, and words of each document
    written with numbers as names and dates are, are none.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    spans = base_spans(text)
                    out += [(windows(text, a, b)[0], 1) for a, b, _ in spans]
                    out += [(windows(text, a, b)[0], 0) for a, b in candidates(text, spans)]
                    plain = ordinary(text)
                    out += [(windows(plain, a, b)[0], 0) for a, b in candidates(plain, [])]
            yield pa.RecordBatch.from_pydict({"window": pa.array([w for w, _ in out], pa.string()), "secret": pa.array([s for _, s in out], pa.int32())})

    return docs.select("text").mapInArrow(look, "window string, secret int").distinct()


def _rewritten(window: str, turn: int, neutral: str) -> str:
    """The window's value in another alphabet: capitals, base64-like, or base32-like."""
    alphabet = (
        "0123456789ABCDEF",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        "abcdefghijklmnopqrstuvwxyz0123456789_-",
    )[turn % 4]
    rng = np.random.default_rng(turn)
    body = window[BEFORE : BEFORE + BODY]
    size = max(16, len(body.rstrip()) - (turn % 8))
    fresh = "".join(rng.choice(list(alphabet), size))[:BODY]
    before = window[:BEFORE] if turn % 3 else neutral[:BEFORE]
    return before + fresh.ljust(BODY) + neutral[BEFORE + BODY :]


def _examples(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows of a group, their labels, and whether they are held out (a fifth, by a hash of the window).

    As the network is to find what the rules miss, each secret also comes with its value
    rewritten in another alphabet, and in the surroundings of an ordinary candidate.
    """
    table = table.sort_by([("secret", "ascending"), ("window", "ascending")])
    texts, secret = table.column("window").to_pylist(), table.column("secret").to_pylist()
    first = table.column("group")[0].as_py() * 2 * GROUP_FINDINGS
    plain = [t for t, s in zip(texts, secret) if not s] or [" " * WIDTH]
    held = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 == 4 for t in texts]
    for i in range(len(texts)):
        if secret[i]:
            texts.append(_rewritten(texts[i], first + i, plain[i % len(plain)]))
            secret.append(1)
            held.append(held[i])
    return texts, np.array(secret, np.int64), np.array(held)


def fit_secrets(docs: DataFrame, recall: float = 0.95) -> CharNetwork:
    """Train on four fifths of the labelled findings of all documents, calibrate on the last fifth.

    Findings are dealt into groups of bounded size. Each group trains from the same
    network in its own task, and the results are averaged by rows after each pass. Of a
    rare label every group gets some, as copies. Without findings of both labels the
    network finds nothing.
    """
    found = settle(labelled_findings(docs), "findings")
    met = {r["secret"]: r["count"] for r in found.groupBy("secret").count().collect()}
    if len(met) < 2:
        return fit_network([], np.zeros(0, np.int64))
    groups = -(-sum(met.values()) // GROUP_FINDINGS)
    copies = {s: 1 if groups == 1 else max(1, min(groups, -(-groups * GROUP_LEAST // n))) for s, n in met.items()}
    last_copy = F.when(F.col("secret") == 1, copies[1] - 1).otherwise(copies[0] - 1)
    home = F.pmod(F.xxhash64("window"), F.lit(groups))
    dealt = found.withColumn("copy", F.explode(F.sequence(F.lit(0), last_copy))).withColumn(
        "group", F.pmod(home + F.col("copy"), F.lit(groups)).cast("int")
    )

    def one_pass(start: CharNetwork, number: int, rounds: int) -> CharNetwork:
        def learn(table: pa.Table) -> pa.Table:
            texts, secret, held = _examples(table)
            group = table.column("group")[0].as_py()
            net = fit_network(
                [t for t, h in zip(texts, held) if not h], secret[~held], rounds, seed=7 + 31 * number + group, start=start
            )
            return pa.table({
                "group": pa.array([group], pa.int32()), "rows": pa.array([len(texts)], pa.int64()),
                "weights": pa.array([net.weights()], pa.list_(pa.float64()))})

        said = dealt.groupBy("group").applyInArrow(learn, "group int, rows long, weights array<double>")
        said = said.toArrow().sort_by("group")
        weights = np.array(said.column("weights").to_pylist())
        return start.with_weights(np.average(weights, axis=0, weights=said.column("rows").to_numpy()))

    net = new_network(np.random.default_rng(7))
    for number in range(1 if groups == 1 else PASSES):
        net = one_pass(net, number, ROUNDS if groups == 1 else PASS_ROUNDS)

    def held_out(table: pa.Table) -> pa.Table:
        texts, secret, held = _examples(table)
        raw = net.scores([t for t, h in zip(texts, held) if h])
        step = np.floor(np.clip(raw, -1000, 1000) * STEPS).astype(np.int64)
        return pa.table({"step": step, "secret": secret[held]})

    # The lower end of each step stands for it, so the threshold keeps the recall.
    scores = dealt.where("copy = 0").groupBy("group").applyInArrow(held_out, "step long, secret long")
    scores = scores.groupBy("step", "secret").count().toArrow().sort_by([("secret", "ascending"), ("step", "ascending")])
    step, secret, rows = (scores.column(n).to_numpy() for n in ("step", "secret", "count"))
    calibrate_scores(net, step / STEPS, secret, rows, recall)
    return net


def find_in(texts: list[str], net: CharNetwork) -> list[list[tuple[int, int, int, float]]]:
    """Start, end, kind number and score of everything found in each text."""
    results, pending, owner = [], [], []
    for number, text in enumerate(texts):
        spans = base_spans(text)
        results.append([(*s, 1.0) for s in spans])
        for a, b in candidates(text, spans):
            parts = windows(text, a, b)
            pending += parts
            owner += [(number, a, b)] * len(parts)
    best: dict[tuple[int, int, int], float] = {}
    for key, chance in zip(owner, net.chances(pending).tolist()):
        best[key] = max(best.get(key, 0.0), chance)
    for (number, a, b), chance in best.items():
        if chance >= net.threshold:
            results[number].append((a, b, 3, chance))
    return [sorted(r, key=lambda s: (s[0], s[2])) for r in results]


def find_secrets(docs: DataFrame, net: CharNetwork) -> DataFrame:
    """``doc_id, findings``: spans in code points, by start and then kind, for every row.

    The rules' spans always stay; the network adds the candidates that reach its
    threshold, a long one by its best window. Null and empty texts have no findings;
    repeated rows get equal ones; an empty table gives no rows; other columns are not
    looked at.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
        for batch in slices(batches, "text"):
            found = find_in([t or "" for t in batch.column("text").to_pylist()], net)
            listed = [[{"start": a, "end": b, "kind": KINDS[k], "score": s} for a, b, k, s in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(listed, kind)], names=["doc_id", "findings"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, f"doc_id long, {FINDINGS}")


def redact_secrets(docs: DataFrame, net: CharNetwork, mark: str = "[secret]") -> DataFrame:
    """The rows with every found span, overlapping ones as one, replaced by ``mark``."""

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            fresh = []
            for text, found in zip(texts, find_in([t or "" for t in texts], net)):
                parts, at = [], 0
                for a, b, _, _ in found:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                fresh.append("".join(parts) + text[at:] if found else text)
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, batch.schema.field(place), pa.array(fresh, batch.schema.field(place).type))

    return docs.mapInArrow(redact, docs.schema)


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts of the rules' findings, a hash of their spans, and all spans as text."""
    said = lambda f: F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("findings", lambda x: x["kind"] != "model")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("findings")).alias("spans"),
    )
