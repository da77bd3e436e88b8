import random

import numpy as np
from tidepack.llm.quality import Limits, longest_repeats, measure, quality


def brute(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_longest_repeats_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        docs = [[rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        n = np.array([len(d) for d in docs])
        flat = np.array([ord(c) for d in docs for c in d], dtype=np.int64)
        assert list(longest_repeats(flat, np.repeat(np.cumsum(n), n))) == sum(map(brute, docs), [])


def test_base_measures_against_brute_force():
    rng = random.Random(2)
    texts = ["", " \t\n", "é|# a\n\na b a\n a"] + [" ".join(rng.choice(["x", "y", "z", "w\n", "#"]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    got = measure([t.encode() for t in texts], Limits())
    for i, t in enumerate(texts):
        words = [w.decode() for w in t.encode().split()]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        hit = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        assert (got["n_words"][i], got["word_chars"][i], got["n_symbols"][i], got["n_repeat_words"][i]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(hit))
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert got["base_failed"][i] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_quality_handles_nulls_empty_tables_and_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.random()) for _ in range(60_000))
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (4, "same line\n" * 500, 0), (5, long[:4000], 0), (5, long[:4000], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in quality(df).collect()}
    assert [got[i].kept for i in range(1, 6)] == [False, False, True, False, True]
    assert got[1].n_words == 0 and got[4].longest_repeat == 998
    assert quality(df.limit(0)).count() == 0


def test_covered_words_and_verdicts_against_brute_force():
    rng = random.Random(5)
    limits = Limits(span=4, max_longest=9)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))]
        passage = [f"p{rng.randint(0, 9**6)}" for _ in range(rng.randint(2, 12))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(words))
            words[at:at] = passage
        texts.append(" ".join(words))
    got = measure([t.encode() for t in texts], limits)
    verdicts = set()
    for i, t in enumerate(texts):
        words = t.split()
        longest = brute(words)
        hit = {j + d for j, k in enumerate(longest) if k >= limits.span for d in range(k)}
        assert (got["n_covered_words"][i], got["longest_repeat"][i]) == (len(hit), max(longest))
        kept = not got["base_failed"][i] and len(hit) <= limits.max_covered * len(words) and max(longest) <= limits.max_longest
        assert got["kept"][i] == kept
        verdicts.add((bool(got["base_failed"][i]), kept))
    assert len(verdicts) == 3
