import random
import zlib

import numpy as np
from tidepack.llm.language import Network, Training, _windows, languages, train


def plain(net, text):
    """Probabilities at each position of a text, one step at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, states = net.u.shape[1], []
    for side, seq in enumerate((text, text[::-1])):
        s, out = np.zeros(h), []
        for byte in seq:
            g, a = net.x[side, byte].astype(float), s @ net.u[side].astype(float)
            r, z = sigmoid(g[:h] + a[:h]), sigmoid(g[h : 2 * h] + a[h : 2 * h])
            s = (1 - z) * np.tanh(g[2 * h :] + r * (a[2 * h :] + net.c[side, 0])) + z * s
            out.append(s)
        states.append(out if not side else out[::-1])
    logits = np.array([f @ net.o[0] + b @ net.o[1] + net.b for f, b in zip(*states, strict=True)]).reshape(-1, len(net.b))
    p = np.exp(logits)
    return p / p.sum(axis=1, keepdims=True)


def loss(net, data, inside, label):
    """Mean cross-entropy."""
    return -sum(np.log(plain(net, row[ok])[:, k]).sum() for row, ok, k in zip(data, inside, label, strict=True)) / inside.sum()


def test_gradients_by_differences():
    rng = np.random.default_rng(14)
    net = Network(3, 4, rng)
    data, lengths, _ = _windows([b"abcab", b"\xc3\xa9b", b"c"], 5)
    inside, label = np.arange(5)[None] < lengths[:, None], np.array([0, 3, 1])
    for w, g in zip(net.weights(), net.gradients(data, inside, label), strict=True):
        w, g = w.reshape(-1), np.asarray(g).reshape(-1)
        for i in rng.permutation(np.flatnonzero(g))[:8] if g.any() else []:
            old = w[i]
            w[i] = old + 1e-2
            up = loss(net, data, inside, label)
            w[i] = old - 1e-2
            down = loss(net, data, inside, label)
            w[i] = old
            assert abs((up - down) / 2e-2 - g[i]) < 2e-3


def test_pooled_windows_equal_the_plain_network():
    rng = np.random.default_rng(15)
    net = Network(4, 3, rng)
    data, lengths, of = _windows([b"hello world, this is long", b"", b"xy"], 8)
    got = net.pooled(data, lengths)
    assert list(of) == [0, 0, 0, 0, 2] and np.allclose(got.sum(axis=1), lengths, atol=1e-4)
    for i, n in enumerate(lengths):
        assert np.allclose(got[i], plain(net, data[i, :n]).sum(axis=0), atol=1e-4)
    assert np.allclose(net.pooled(data[4:], lengths[4:]), got[4:], atol=1e-5)


def test_held_out_accuracy_and_undetermined(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    more = [(900_001, None, "en"), (900_002, "", "en"), (900_003, "123 !? \n", "de"), (900_004, "le " * 70_000, None), (900_004, "le " * 70_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in [*map(tuple, rows), *more]], "doc_id long, text string, lang string, held_out string")
    got = languages(df).collect()
    assert len(got) == len(rows) + 5
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert [by[900_000 + i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    held = [r for r in rows if by[r.doc_id].held_out]
    assert np.mean([by[r.doc_id].lang_pred == r.lang for r in held]) >= 0.9
    none = languages(df.filter("lang is null")).collect()
    assert [r.lang_pred for r in none] == ["und"] * 2 and languages(df.limit(0)).count() == 0


def test_a_rare_label_and_every_part_of_a_text_are_learned_from(spark):
    """The label shows at the end of long texts only, and one label has few texts."""
    rows = [(i, "12345 67 " * 30 + ("abc def " if i % 2 else "uvw xyz ") * 90, "left" if i % 2 else "right", i) for i in range(300)]
    rows += [(1000 + i, "ßüö äöß " * 8, "rare", 1) for i in range(6)] + [(2000 + i, "ßüö äöß " * 5, None, 1) for i in range(4)]
    got = {r.doc_id: r.lang_pred for r in languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, k int")).collect()}
    assert all(got[r[0]] == (r[2] or "rare") for r in rows)


def test_training_is_repeatable():
    rng = random.Random(16)
    texts = ["".join(rng.choice(a) for _ in range(40)).encode() for a in ("abc", "xyz") * 20]
    nets = [train(texts, ["a", "x"] * 20, Training(steps=5))[0] for _ in range(2)]
    assert all((a == b).all() for a, b in zip(nets[0].weights(), nets[1].weights(), strict=True))
