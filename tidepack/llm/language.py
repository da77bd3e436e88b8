"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read a text's bytes, one from either side; at every position a softmax over their states
labels the position. A document's probabilities are the means over its positions. Texts are cut into windows of
`window` bytes, each read from a zero state, so all windows of a slice advance together and memory does not grow
with a text; every byte of a text is in one window.

Training is backpropagation through time with Adam, on the driver, on a bounded sample: of all windows of all training
texts about `sample`, for each label as many, those with the smallest seeded hashes; so every part of every text may be
learned from, and a rare label is learned at any size. At most `labels` labels are learned, those with the most text.
Rows whose crc32(doc_id) mod 5 is 0 are held out. The trained weights (about 30 kB) go to the tasks, which map over all
texts.

Null texts and texts without a letter are `und` with score 0; so is everything if nothing was learned. A null id
belongs to the training rows. Repeated rows get equal results. Equal probabilities go to the label that sorts first.
Empty tables give no rows. Other columns of docs are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, slices, texts_of

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Training:
    """hidden: units of each direction. sample: windows of labelled texts used, about. labels: learned at
    most. window: bytes. batch, steps, rate: of
    the descent. together: windows that advance at once."""

    hidden: int = 6
    sample: int = 4096
    labels: int = 256
    window: int = 64
    batch: int = 192
    steps: int = 220
    rate: float = 0.02
    seed: int = 20
    together: int = 1024


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights, first axis the direction: x (2, 256, 3H) what a byte adds to reset, update and new state; u
    (2, H, 3H) what the state adds; c (2, H) bias of the state's part in the new state; o (2, H, K) and b (K)."""

    def __init__(self, hidden: int, classes: int, rng: np.random.Generator):
        h = hidden
        self.x = rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)).astype(np.float32)
        self.c = np.zeros((2, 1, h), np.float32)
        self.o = rng.normal(0, 0.3, (2, h, classes)).astype(np.float32)
        self.b = np.zeros(classes, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c, self.o, self.b]

    def gradients(self, data: np.ndarray, inside: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over positions. data: windows x positions; inside: which are text."""
        n, length = data.shape
        h = self.u.shape[1]
        both = np.stack([data, data[:, ::-1]]).astype(np.int64)
        mask = np.stack([inside, inside[:, ::-1]]).astype(np.float32)[..., None]
        side = np.arange(2)[:, None]
        state, kept = np.zeros((2, n, h), np.float32), []
        for t in range(length):
            g, a = self.x[side, both[:, :, t]], state @ self.u
            rz = _sigmoid(g[..., : 2 * h] + a[..., : 2 * h])
            r, z, m = rz[..., :h], rz[..., h:], a[..., 2 * h :] + self.c
            new = np.tanh(g[..., 2 * h :] + r * m)
            after = state + mask[:, :, t] * (1 - z) * (new - state)  # outside a text the state stays
            kept.append((state, r, z, m, new, after))
            state = after
        forward = np.stack([k[5][0] for k in kept])
        backward = np.stack([k[5][1] for k in kept])[::-1]
        logits = forward @ self.o[0] + backward @ self.o[1] + self.b
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(n), label] -= 1
        p *= (inside.T / max(inside.sum(), 1)).astype(np.float32)[..., None]
        do = np.stack([np.einsum("tnh,tnk->hk", s, p) for s in (forward, backward)])
        db = p.sum(axis=(0, 1))
        into = np.stack([p @ self.o[0].T, (p @ self.o[1].T)[::-1]])  # direction, step, window, unit
        dx, du, dc, ds = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.c), np.zeros((2, n, h), np.float32)
        for t in range(length - 1, -1, -1):
            before, r, z, m, new, _ = kept[t]
            d = (ds + into[:, t]) * mask[:, :, t]
            off = (ds + into[:, t]) * (1 - mask[:, :, t])
            dnew = d * (1 - z) * (1 - new * new)
            dz = d * (before - new) * z * (1 - z)
            dr = dnew * m * r * (1 - r)
            da = np.concatenate([dr, dz, dnew * r], axis=2)
            dg = np.concatenate([dr, dz, dnew], axis=2)
            for k in range(2):
                np.add.at(dx[k], both[k, :, t], dg[k])
            du += before.transpose(0, 2, 1) @ da
            dc += (dnew * r).sum(axis=1, keepdims=True)
            ds = off + d * z + da @ self.u.transpose(0, 2, 1)
        return [dx, du, dc, do, db]

    def pooled(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over each window's positions of their probabilities. data: windows x positions, zeros behind the
        end. A text read backwards begins at its last byte, so shorter windows are shifted."""
        n, length = data.shape
        h = self.u.shape[1]
        scale = np.ones(3 * h, np.float32)
        scale[: 2 * h] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        # units come first and windows last, so that each gate is one contiguous block
        x, u, c = ((w * s).transpose(0, 2, 1).copy() for w, s in ((self.x, scale), (self.u, scale), (self.c, np.float32(1))))
        inside = np.arange(length)[None] < lengths[:, None]
        mirror = np.maximum(lengths[:, None] - 1 - np.arange(length)[None], 0)
        index = np.stack([data, np.where(inside, np.take_along_axis(data, mirror, 1), 0)]).transpose(2, 0, 1).astype(np.intp)
        state = np.zeros((2, h, n), np.float32)
        states = np.empty((length, 2, h, n), np.float32)
        g, a = np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
        for t in range(length):
            for k in range(2):
                np.take(x[k], index[t, k], axis=1, out=g[k], mode="clip")
            np.matmul(u, state, out=a)
            rz = g[:, : 2 * h]
            rz += a[:, : 2 * h]
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            m = a[:, 2 * h :]
            m += c
            m *= rz[:, :h]
            m += g[:, 2 * h :]
            np.tanh(m, out=m)
            state -= m
            state *= rz[:, h:]
            state += m
            states[t] = state
        total = np.zeros((n, len(self.b)))
        for t in range(length):
            # position t of a window is step t forward, and step lengths - 1 - t backward
            back = states[length - 1 - t, 1] if lengths.min() == length else states[mirror[:, t], 1, :, np.arange(n)].T
            p = self.o[0].T @ states[t, 0]
            p += self.o[1].T @ back
            p += self.b[:, None]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= inside[:, t] / p.sum(axis=0)
            total += p.T
        return total


def _windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (rows of bytes), their lengths, and the text that each is of."""
    size = np.array([len(t) for t in texts], np.int64)
    count = -(-size // window)
    of = np.repeat(np.arange(len(texts)), count)
    first = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    lengths = np.minimum(size[of] - first * window, window)
    data = np.zeros((len(of), window), np.uint8)
    data[np.arange(window)[None] < lengths[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return data, lengths, of


def train(texts: list[bytes], labels: list[str], settings: Training = Training()) -> tuple[Network | None, list[str]]:
    """The network and its classes; without labels none."""
    classes = sorted(set(labels))
    rows = [(t[: settings.window], classes.index(c)) for t, c in zip(texts, labels, strict=True) if t]
    if not rows:
        return None, classes
    rng = np.random.default_rng(settings.seed)
    data, lengths, _ = _windows([t for t, _ in rows], settings.window)
    label = np.array([c for _, c in rows])
    inside = np.arange(settings.window)[None] < lengths[:, None]
    net = Network(settings.hidden, len(classes), rng)
    mean, square = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(1, settings.steps + 1):
        at = rng.integers(0, len(rows), settings.batch)
        rate = settings.rate * min(1, 2 * (1 - (step - 1) / settings.steps))
        for w, g, m, v in zip(net.weights(), net.gradients(data[at], inside[at], label[at]), mean, square, strict=True):
            g = np.clip(g, -0.1, 0.1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net, classes


def fit(docs: DataFrame, settings: Training = Training()) -> tuple[Network | None, list[str]]:
    """Learns from text and lang of training rows."""
    rows = docs.filter(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")) & ~held_out(F.col("doc_id")))
    count = F.ceil(F.char_length("text") / settings.window)
    rows = rows.select("lang", "text", F.xxhash64(F.lit(settings.seed), "doc_id", "text").alias("draw"), count.alias("n"))
    sizes = rows.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "lang").limit(settings.labels).collect()
    quota = -(-settings.sample // max(1, len(sizes)))
    # windows whose draw is not among the smallest four times as many are left out at once
    parts = [(r.lang, int(min(1 << 40, (1 << 42) * quota // r.total))) for r in sizes]
    least = F.broadcast(docs.sparkSession.createDataFrame(parts, "lang string, least long"))
    draw = lambda k: F.pmod(F.xxhash64("draw", k), F.lit(1 << 40))
    some = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: draw(k) < F.col("least"))
    rows = rows.join(least, "lang").withColumn("k", F.explode(some))
    part = F.substring("text", (F.col("k") * settings.window + 1).cast("int"), F.lit(settings.window))
    rows = rows.select("lang", draw(F.col("k")).alias("d"), part.alias("part"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("d", "part"))
    rows = sorted(rows.withColumn("place", place).filter(F.col("place") <= quota).select("lang", "d", "part").collect())
    return train([r.part.encode() for r in rows], [r.lang for r in rows], settings)


def languages(docs: DataFrame, settings: Training = Training()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the pooled probability of lang_pred)."""
    net, classes = fit(docs, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            some = [i for i, t in enumerate(texts) if net is not None and _LETTER.search(t.decode("utf-8", "replace"))]
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if some:
                data, lengths, of = _windows([texts[i] for i in some], settings.window)
                total = np.zeros((len(some), len(classes)))
                order = np.argsort(lengths, kind="stable")  # whole windows together
                for k in range(0, len(of), settings.together):
                    part = order[k : k + settings.together]
                    np.add.at(total, of[part], net.pooled(data[part], lengths[part]))
                total /= total.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                for i, c, p in zip(some, best, total, strict=True):
                    pred[i], score[i] = classes[c], min(1.0, float(p[c]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(pred), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")), run, "doc_id long, held_out boolean, lang_pred string, score double")
