import math
import random
import zlib
from collections import Counter

import pytest
from tidepack.llm import scoring
from tidepack.llm.scoring import DISCOUNT, STRONG, WEAK, score


class Plain:
    """The automaton as dictionaries: states are tuples of up to two words, read one word at a time."""

    def __init__(self, texts):
        self.n = Counter()
        for words in texts:
            line = [b"", *words]
            for i in range(1, len(line)):
                self.n[(line[i],)] += 1
                self.n[tuple(line[i - 1 : i + 1])] += 1
                if i > 1:
                    self.n[tuple(line[i - 2 : i + 1])] += 1
        self.total = sum(c for k, c in self.n.items() if len(k) == 1)
        self.distinct = sum(len(k) == 1 for k in self.n)

    def arc(self, state, word):
        """The weight with which a state reads a word, failing as often as it must."""
        if not self.total:
            return 1.0
        if not state:
            return (self.n[(word,)] - DISCOUNT if self.n[(word,)] else DISCOUNT * self.distinct) / self.total
        k = {1: WEAK, 2: STRONG}[len(state)]
        return (self.n[(*state, word)] + k * self.arc(state[1:], word)) / (self.n[state] + k)

    def read(self, words):
        state, out = (b"",), 0.0
        for w in words:
            out += math.log10(self.arc(state, w))
            state = (*state, w)[-2:]
            while state and not self.n[state]:
                state = state[1:]
        return out


def plain_scores(rows):
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    model = Plain([tok(t) for d, t, *_ in rows if not held(d)])
    out = []
    for d, t, *_ in rows:
        words = tok(t)
        c = [model.n[(w,)] for w in words]
        base = sum(math.log10((x + 1) / (model.total + model.distinct + 1)) for x in c)
        out.append((-1 if d is None else d, held(d), len(words), sum(x > 0 for x in c), model.total, base, model.read(words)))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    vocab = ["The", "the", "of", "and"] * 6 + [f"{a}{b}é" for a in "xyz" for b in range(30)]
    rows = [(i, " ".join(rng.choice(vocab) if rng.random() < 0.95 else f"Q{rng.randint(0, 9**6)}" for _ in range(rng.randint(0, 60))), 0) for i in range(160)]
    rows += [(500, None, 0), (501, "", 0), (None, "the end", 0), (503, "zzz " * 30_000, 0), (504, "a b a b a", 0), (505, "a b a", 0)] + rows[:9]
    return rows


@pytest.mark.parametrize(("tokens", "table"), [(scoring.BLOCK_TOKENS, scoring.TABLE), (700, 256)])
def test_scores_against_plain_python(spark, monkeypatch, tokens, table):
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(scoring, "TABLE", table)
    monkeypatch.setattr(scoring, "PIECE", 2048)
    monkeypatch.setattr(scoring, "SPOOL", 4096)
    rows = rows_of(13)
    got = score(spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(3)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got)
    want = plain_scores(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want])


def test_arcs_of_a_state_add_up_to_one():
    model = Plain([w.encode().split() + [b""] for w in ("a b a b c", "b a", "c c c a b")])
    words = [k[0] for k in model.n if len(k) == 1] + [b"unknown"]
    for state in [k for k in model.n if len(k) < 3] + [()]:
        if len(state) == 2 and state[1] == b"":
            continue  # nothing follows the end of a text but another text
        assert sum(model.arc(state, w) for w in words) == pytest.approx(1)


def test_held_out_texts_score_better_than_the_base(spark):
    got = score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out").collect()
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_scoring_empty(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = score(spark.createDataFrame([(4, "a b")], "doc_id long, text string")).collect()
    assert len(only) == 1 and math.isfinite(only[0].score)
    held = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2)
    none = score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (none[0].train_tokens, none[0].score) == (0, 0.0)
