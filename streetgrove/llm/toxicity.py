"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's characters run through one bidirectional gated recurrent layer, whose states are pooled by attention; the
result stands beside the word's own vector. A window of words runs through a second such layer and is pooled to one
logit. All overlapping windows of a text are scored; its score is that of the strongest, calibrated on whole texts.

Words are lower-cased runs of word characters; longer ones are read in parts of ``PART`` characters. A text without
words (empty, null, punctuation) has the share of toxic rows among the learned labels as its score. Rows are scored
one by one, so repeated rows get equal scores. Without labels of both kinds every score is that share, 0 if there are
none. Labels of a doc_id that is labelled twice count as toxic if one says so; null labels are no labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetgrove.llm.common import slices, small_batches, texts
from streetgrove.session import cut

PART = 24
WORDS = re.compile(rf"\w{{1,{PART}}}")
#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
#: Characters with vectors of their own; the rest share the last ones.
CHARS, SHARED_CHARS = 592, 48
#: Bounds of the sample that is learned from: rows of each label, code points of all of them, and rows of any length that calibrate.
TOXIC_ROWS, CLEAN_ROWS, LEARNED_CHARS, CALIBRATION_ROWS = 1500, 2500, 16_000_000, 1500
#: Code points of a passage, where a text is too long to be learned whole.
SPAN = 512
#: Labels drawn for each row that is learned, as some texts are missing or have no words.
SPARE = 4
#: Steps of learning, texts in each, their length, and after how many steps at least the strongest windows are chosen anew.
STEPS, BATCH, RATE, CHOOSE, SEED = 400, 64, 0.01, 50, 11
#: Words whose projections a worker remembers.
MEMORY = 120_000
CHUNK = 2 << 20

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


# ---- the network ----


def new_layer(rng: np.random.Generator, inputs: int, hidden: int) -> Params:
    """Both directions of a gated layer, and the attention over their states."""
    p: Params = {}
    for d in "fb":
        p[f"W{d}"] = rng.normal(0, inputs**-0.5, (inputs, 3 * hidden))
        p[f"U{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        p[f"b{d}"] = np.zeros(3 * hidden)
    p["att"] = rng.normal(0, 0.1, 2 * hidden)
    return p


def run_direction(x: np.ndarray, mask: np.ndarray, U: np.ndarray, backward: bool, keep: bool = False):
    """States [time, batch, hidden] from projected inputs [time, batch, 3 hidden]; with ``keep`` what learning needs.

    Gates: reset, update, candidate; where the mask is 0 the state passes through.
    """
    T, B, hidden = x.shape[0], x.shape[1], U.shape[0]
    h = np.zeros((B, hidden), x.dtype)
    states = np.empty((T, B, hidden), x.dtype)
    kept = [None] * T
    for t in range(T - 1, -1, -1) if backward else range(T):
        g = h @ U
        gates = sigmoid(x[t, :, : 2 * hidden] + g[:, : 2 * hidden])
        r, z = gates[:, :hidden], gates[:, hidden:]
        c = np.tanh(x[t, :, 2 * hidden :] + r * g[:, 2 * hidden :])
        new = c + z * (h - c)
        m = mask[t][:, None]
        if keep:
            kept[t] = (h, r, z, c, g[:, 2 * hidden :])
        h = h + m * (new - h)
        states[t] = h
    return (states, kept) if keep else states


def learn_direction(d_states: np.ndarray, mask: np.ndarray, U: np.ndarray, backward: bool, kept: list):
    """(gradient of the projected inputs, gradient of U)."""
    T, B, hidden = d_states.shape
    dx, dU = np.zeros((T, B, 3 * hidden), d_states.dtype), np.zeros_like(U)
    dh = np.zeros((B, hidden), d_states.dtype)
    for t in range(T) if backward else range(T - 1, -1, -1):
        h, r, z, c, gc = kept[t]
        dh = dh + d_states[t]
        m = mask[t][:, None]
        d_new = dh * m
        d_c = d_new * (1 - z) * (1 - c * c)
        d_z = d_new * (h - c) * z * (1 - z)
        d_r = d_c * gc * r * (1 - r)
        dg = np.concatenate((d_r, d_z, d_c * r), axis=1)
        dx[t] = np.concatenate((d_r, d_z, d_c), axis=1)
        dU += h.T @ dg
        dh = dh * (1 - m) + d_new * z + dg @ U.T
    return dx, dU


def pool(states: np.ndarray, mask: np.ndarray, att: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pooled states, attention weights [time, batch])."""
    a = np.where(mask > 0, states @ att, -1e9)
    a = np.exp(a - a.max(axis=0)) * mask
    a /= np.maximum(a.sum(axis=0), 1e-9)
    return np.einsum("tb,tbh->bh", a, states), a


def layer(p: Params, projected: tuple[np.ndarray, np.ndarray], mask: np.ndarray) -> np.ndarray:
    states = np.concatenate([run_direction(x, mask, p[f"U{d}"], d == "b") for d, x in zip("fb", projected, strict=True)], axis=2)
    return pool(states, mask, p["att"])[0]


def layer_kept(p: Params, x: np.ndarray, mask: np.ndarray):
    runs = [run_direction(x @ p[f"W{d}"] + p[f"b{d}"], mask, p[f"U{d}"], d == "b", keep=True) for d in "fb"]
    states = np.concatenate([s for s, _ in runs], axis=2)
    pooled, a = pool(states, mask, p["att"])
    return pooled, (x, mask, [k for _, k in runs], states, a, pooled)


def learn_layer(p: Params, d_pooled: np.ndarray, kept) -> tuple[np.ndarray, Params]:
    """(gradient of the inputs, gradients of the parameters)."""
    x, mask, runs, states, a, pooled = kept
    d_a = np.einsum("bh,tbh->tb", d_pooled, states)
    d_score = a * (d_a - np.einsum("bh,bh->b", d_pooled, pooled))
    d_states = a[:, :, None] * d_pooled + d_score[:, :, None] * p["att"]
    grads: Params = {"att": np.einsum("tb,tbh->h", d_score, states)}
    d_x = np.zeros_like(x)
    hidden = states.shape[2] // 2
    flat = x.reshape(-1, x.shape[2])
    for k, d in enumerate("fb"):
        dx, grads[f"U{d}"] = learn_direction(d_states[:, :, k * hidden : (k + 1) * hidden], mask, p[f"U{d}"], d == "b", runs[k])
        wide = dx.reshape(-1, dx.shape[2])
        grads[f"W{d}"], grads[f"b{d}"] = flat.T @ wide, wide.sum(axis=0)
        d_x += dx @ p[f"W{d}"].T
    return d_x, grads


@dataclass
class Network:
    """All parameters; ``vocabulary`` has the words with vectors of their own, 0 is for the rest."""

    chars: Params
    words: Params
    top: Params  # char vectors, word vectors, output weights and bias
    vocabulary: dict[str, int]

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], *, char_dim: int = 8, char_hidden: int = 10, word_dim: int = 10, hidden: int = 8, seed: int = SEED, dtype=np.float32) -> Network:
        rng = np.random.default_rng(seed)
        top = {
            "char": rng.normal(0, 0.3, (CHARS, char_dim)), "word": rng.normal(0, 0.1, (len(vocabulary) + 1, word_dim)),
            "out": rng.normal(0, 0.3, 2 * hidden), "bias": np.zeros(1),
        }
        net = cls(new_layer(rng, char_dim, char_hidden), new_layer(rng, word_dim + 2 * char_hidden, hidden), top, vocabulary)
        for p in (net.chars, net.words, net.top):
            for k in p:
                p[k] = p[k].astype(dtype)
        return net

    def parts(self) -> list[Params]:
        return [self.chars, self.words, self.top]


def char_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids [time, words], mask)."""
    codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in words]
    size = max(map(len, codes), default=1)
    ids, mask = np.zeros((len(words), size), np.int64), np.zeros((len(words), size), np.float32)
    for k, c in enumerate(codes):
        ids[k, : len(c)], mask[k, : len(c)] = c, 1
    plain = CHARS - SHARED_CHARS
    ids = np.where(ids < plain, ids, plain + ids % SHARED_CHARS)
    return ids.T, mask.T


def project_words(net: Network, words: list[str]) -> np.ndarray:
    """The word layer's projected inputs of both directions, side by side, for each word."""
    out = np.empty((len(words), net.words["Wf"].shape[1] * 2), np.float32)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    projected = [net.top["char"] @ net.chars[f"W{d}"] + net.chars[f"b{d}"] for d in "fb"]
    for start in range(0, len(order), 4096):
        own = order[start : start + 4096]
        ids, mask = char_ids([words[k] for k in own])
        pooled = layer(net.chars, (projected[0][ids], projected[1][ids]), mask)
        known = net.top["word"][[net.vocabulary.get(words[k], 0) for k in own]]
        x = np.concatenate((known, pooled), axis=1)
        out[own] = np.concatenate([x @ net.words[f"W{d}"] + net.words[f"b{d}"] for d in "fb"], axis=1)
    return out


def windows_of(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, words) of all overlapping windows of texts with so many words; the starts are over all texts in a row."""
    n = np.asarray(sizes, np.int64)
    count = np.where(n > 0, np.maximum(-(-(n - (WINDOW - STRIDE)) // STRIDE), 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * STRIDE
    return row, start + np.repeat(np.cumsum(n) - n, count), np.minimum(n[row] - start, WINDOW)


def window_logits(net: Network, table: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logits of windows over the concatenated word ids; ``table`` has the projections."""
    out = np.empty(len(start), np.float32)
    half = table.shape[1] // 2
    forward, backward = np.ascontiguousarray(table[:, :half]), np.ascontiguousarray(table[:, half:])
    order = np.argsort(size, kind="stable")
    for k in range(0, len(order), 2048):
        own = order[k : k + 2048]
        T = int(size[own].max())
        steps = np.arange(T)[:, None]
        mask = (steps < size[own]).astype(np.float32)
        at = ids[np.minimum(start[own] + steps, len(ids) - 1)]
        pooled = layer(net.words, (forward[at], backward[at]), mask)
        out[own] = pooled @ net.top["out"] + net.top["bias"]
    return out


class Scorer:
    """The strongest window of each text; remembers the projections of a bounded number of words."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((0, self.net.words["Wf"].shape[1] * 2), np.float32)

    def __call__(self, found: list[list[str]]) -> np.ndarray:
        """Logits; nan for texts without words."""
        if len(self.known) > MEMORY:
            self._forget()
        known = self.known
        new = list({w for ws in found for w in ws if w not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.table = np.concatenate((self.table, project_words(self.net, new)))
        ids = np.array([known[w] for ws in found for w in ws], np.int64)
        row, start, size = windows_of([len(ws) for ws in found])
        best = np.full(len(found), -np.inf, np.float32)
        if len(row):
            np.maximum.at(best, row, window_logits(self.net, self.table, ids, start, size))
        return np.where(np.isinf(best), np.nan, best)


# ---- learning ----


def add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row at its place; rows of one place are summed first."""
    at, rows = at.reshape(-1), rows.reshape(-1, rows.shape[-1])
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    into[places[first]] += np.add.reduceat(rows[order], first, axis=0)


def gradients(net: Network, windows: list[list[str]], y: np.ndarray, rng: np.random.Generator | None = None):
    """(loss, gradients of the three parts) of logistic loss over windows."""
    distinct = sorted({w for ws in windows for w in ws}, key=lambda w: (len(w), w))
    index = {w: k for k, w in enumerate(distinct)}
    T = max(map(len, windows))
    at = np.zeros((T, len(windows)), np.int64)
    mask = np.zeros((T, len(windows)), net.top["out"].dtype)
    for k, ws in enumerate(windows):
        at[: len(ws), k], mask[: len(ws), k] = [index[w] for w in ws], 1
    vectors, kept = [], []
    for start in range(0, len(distinct), 512):  # of like length, so that little is padding
        ids, char_mask = char_ids(distinct[start : start + 512])
        pooled, own = layer_kept(net.chars, net.top["char"][ids], char_mask.astype(mask.dtype))
        vectors.append(pooled)
        kept.append((ids, own))
    rows = np.array([net.vocabulary.get(w, 0) for w in distinct])
    if rng is not None:
        rows = np.where(rng.random(len(rows)) < 0.3, 0, rows)  # some known words are read by their characters alone
    x = np.concatenate((net.top["word"][rows], np.concatenate(vectors)), axis=1)
    pooled, own = layer_kept(net.words, x[at], mask)
    p = sigmoid(pooled @ net.top["out"] + net.top["bias"])
    loss = float(-np.mean(np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
    d_logit = ((p - y) / len(y)).astype(mask.dtype)
    top = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_x, words = learn_layer(net.words, d_logit[:, None] * net.top["out"], own)
    d_distinct = np.zeros_like(x)
    add_rows(d_distinct, at, d_x)
    wide = net.top["word"].shape[1]
    top["word"] = np.zeros_like(net.top["word"])
    add_rows(top["word"], rows, d_distinct[:, :wide])
    top["char"] = np.zeros_like(net.top["char"])
    chars: Params = {}
    for k, (ids, state) in enumerate(kept):
        d_char, grads = learn_layer(net.chars, d_distinct[k * 512 : (k + 1) * 512, wide:], state)
        add_rows(top["char"], ids, d_char)
        chars = {n: g + chars[n] if chars else g for n, g in grads.items()}
    return loss, (chars, words, top)


def train(found: list[list[str]], toxic: np.ndarray, *, steps: int = STEPS, seed: int = SEED) -> Network:
    """A network from texts as word lists and their labels.

    Only the text is labelled, so a text is learned by its window that was strongest when they were last chosen.
    """
    counts = Counter(w for ws in found for w in set(ws))
    vocabulary = {w: k + 1 for k, w in enumerate(sorted(w for w, n in counts.items() if n >= 5))}
    net, rng = Network.fresh(vocabulary, seed=seed), np.random.default_rng(seed)
    first = [{k: np.zeros_like(v) for k, v in p.items()} for p in net.parts()]
    second = [{k: np.zeros_like(v) for k, v in p.items()} for p in net.parts()]
    step, epochs = 0, -(-steps // -(-len(found) // BATCH))
    row, start, size = windows_of([len(ws) for ws in found])
    flat = [w for ws in found for w in ws]
    places = [np.flatnonzero(row == k) for k in range(len(found))] if len(found) < 64 else np.split(np.arange(len(row)), np.cumsum(np.bincount(row, minlength=len(found)))[:-1])
    distinct = sorted(set(flat))
    index = {w: k for k, w in enumerate(distinct)}
    ids = np.array([index[w] for w in flat], np.int64)
    chosen = -CHOOSE
    for epoch in range(epochs):
        if step - chosen >= CHOOSE:
            logits = window_logits(net, project_words(net, distinct), ids, start, size) if epoch else rng.random(len(row)).astype(np.float32)
            strongest = np.array([own[np.argmax(logits[own])] for own in places])
            chosen = step
        order = rng.permutation(len(found))
        for k in range(0, len(order), BATCH):
            own = strongest[order[k : k + BATCH]]
            windows = [flat[start[i] : start[i] + size[i]] for i in own]
            _, grads = gradients(net, windows, toxic[order[k : k + BATCH]].astype(np.float32), rng)
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.8 * epoch / epochs)
            scale = min(1.0, 5.0 / (np.sqrt(sum(float((g * g).sum()) for p in grads for g in p.values())) + 1e-9))
            for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                for name, value in g.items():
                    value = value * np.float32(scale)
                    m[name] += 0.1 * (value - m[name])
                    v[name] += 0.01 * (value * value - v[name])
                    p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(p[name].dtype)
    return net


@dataclass
class Model:
    """The network with the calibration of whole texts; ``share`` is the score without words."""

    net: Network | None
    scale: float
    shift: float
    share: float

    def scores(self, logits: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(logits), self.share)
        return np.where(np.isnan(logits), self.share, sigmoid(self.scale * logits.astype(np.float64) + self.shift))


def calibrate(logits: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit, the scale held over 0 so that the order stays."""
    keep = ~np.isnan(logits)
    x, y = logits[keep].astype(np.float64), toxic[keep].astype(np.float64)
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, with a little weight on (1, 0)
        p = sigmoid(a * x + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * x).sum() + 0.5 * (a - 1), (p - y).sum() + 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = max(a - np.clip(da, -1, 1), 0.05), b - np.clip(db, -2, 2)
    return float(a), float(b)


def split_words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def share_out(sizes: list[int], total: int) -> int:
    """The most that each may have so that all have ``total`` together; what small ones leave goes to the large ones."""
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > total:
            return max(1, total // (len(sizes) - k))
        total -= size
    return max(sizes, default=1)


def passages(text: Column, chars: Column, most: int) -> Column:
    """The text, or if it has more than ``most`` code points, passages at even distances from its first to its last words."""
    span = min(SPAN, most)
    n = most // span
    starts = F.sequence(F.lit(0), F.lit(n - 1))
    start = lambda k: (F.floor(k * (chars - span) / max(1, n - 1)) + 1).cast("int")
    return F.when(chars <= most, text).otherwise(F.array_join(F.transform(starts, lambda k: F.substring(text, start(k), F.lit(span))), " "))


def fit(learned: DataFrame, *, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, learned_chars: int = LEARNED_CHARS) -> Model:
    """A model from ``learned_rows``: of each label at most so many rows of any length teach the network, in the order of
    their draw. Together they have at most ``learned_chars`` code points: only if they have more, the longest are learned
    by ``passages``. The rows that calibrate are whole.
    """
    known = cut(learned, "labelled")
    one = known.select("share").first()
    if one is None or one["share"] in (0.0, 1.0):
        return Model(None, 1.0, 0.0, float(one["share"]) if one else 0.0)
    spoken = known.where(F.col("learns") & F.rlike("text", F.lit(r"(?U)\w"))).withColumns({"chars": F.char_length("text"), "own": F.xxhash64("text")})
    wanted = [(label, rows, spoken.where(F.col("toxic") == label)) for label, rows in ((1, toxic_rows), (0, clean_rows))]
    sizes = [r["chars"] for _, rows, own in wanted for r in own.select("draw", "own", "chars").orderBy("draw", "own").limit(rows).collect()]
    text = passages(F.col("text"), F.col("chars"), share_out(sizes, learned_chars)).alias("text")
    drawn = []
    for label, rows, own in wanted:
        drawn += [(split_words(r["text"]), label) for r in own.select("draw", "own", text).orderBy("draw", "own").limit(rows).collect()]
    drawn = [(ws, label) for ws, label in drawn if ws]
    if len({label for _, label in drawn}) < 2:
        return Model(None, 1.0, 0.0, float(one["share"]))
    net = train([ws for ws, _ in drawn], np.array([label for _, label in drawn]))
    found, labels = [], []
    scorer = Scorer(net)
    for r in known.where("calibrates").orderBy("draw", "text").toLocalIterator():
        found.append(scorer([split_words(r["text"])])[0])
        labels.append(r["toxic"])
    return Model(net, *calibrate(np.array(found, np.float32), np.array(labels)), float(one["share"]))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the identifier as text, a multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learned_rows(
    docs: DataFrame, labels: DataFrame, *, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, calibration_rows: int = CALIBRATION_ROWS, spare: int = SPARE,
) -> DataFrame:
    """(text, toxic, learns, calibrates, draw, share) of a bounded draw of the labelled documents that may be learned from.

    The draw goes by a hash of the identifier: ``spare`` times the rows of each label that are learned, as some texts are
    missing or have no words, and the rows that calibrate, in their natural mixture. It is made from the labels alone, so the texts of all
    documents are scanned once and never shuffled. ``share`` is that of toxic rows among all labels.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("draw", F.xxhash64("doc_id"))
    share = known.agg(F.avg("toxic").alias("share")).first()["share"]
    parts = [known.where(F.col("toxic") == label).orderBy("draw").limit(spare * rows).withColumn("learns", F.lit(True)) for label, rows in ((1, toxic_rows), (0, clean_rows))]
    parts.append(known.orderBy(F.xxhash64("draw")).limit(calibration_rows).withColumn("learns", F.lit(False)))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    drawn = every.groupBy("doc_id", "toxic", "draw").agg(F.max("learns").alias("learns"), F.min("learns").alias("only")).select(
        "doc_id", "toxic", "draw", "learns", (~F.col("only")).alias("calibrates"))
    # At most spare * (toxic_rows + clean_rows) + calibration_rows rows, whatever the corpus holds.
    return texts(docs).join(F.broadcast(drawn), "doc_id").select("text", "toxic", "learns", "calibrates", "draw", F.lit(share).cast("double").alias("share"))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each whole text; no shuffle. The model goes along with the task, some 200 KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.net) if model.net is not None else None
        for batch in slices(batches, "text", CHUNK):
            found = batch.column("text").to_pylist()
            logits = scorer([split_words(t) for t in found]) if scorer else np.full(len(found), np.nan)
            scores = model.scores(logits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, less the rows that score 0.5 or more; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.net) if model.net is not None else None
        for batch in slices(batches, text_col, CHUNK):
            found = [split_words(t or "") for t in batch.column(text_col).to_pylist()]
            scores = model.scores(scorer(found) if scorer else np.full(len(found), np.nan))
            yield batch.filter(pa.array(scores < 0.5))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
