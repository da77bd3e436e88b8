import random
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_neardup import brute as near_brute
from test_pii import brute as pii_brute
from tidepack.llm.mixing import mix_documents
from tidepack.llm.pii import masked
from tidepack.llm.quality import Limits, measure
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(18)
    rows = []
    for i in range(160):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 260))]
        if rng.random() < 0.2:
            words[3] = rng.choice(["a@b.org", "10.1.2.3", "+1 (620) 555-8424"])
        if rng.random() < 0.1:
            words = words[:5] * 40
        rows.append((i * 7, rng.choice([" ", "\n", "  "]).join(words), "en", rng.choice(["a", "a", "b", None]), 1))
    for i in range(40):
        source = rng.choice(rows[:160])
        words = source[1].split(" ")
        words[rng.randrange(len(words))] = "edit"
        rows.append((2000 + i, " ".join(words), "en", "c", 1))
    rows += [(3000, None, None, None, None), (3001, "", "en", "a", 0), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA)


def plain(stage, rows):
    if stage == "quality":
        keep = measure([(r.text or "").encode() for r in rows], Limits())["kept"]
        return [tuple(r) for r, k in zip(rows, keep, strict=True) if k]
    if stage == "near_dedup":
        kept = {d for d, _, _, k in near_brute([(r.doc_id, r.text) for r in rows], 80, 5) if k}
        return sorted({tuple(r) for r in rows if r.doc_id in kept})
    clean = [masked(r.text, pii_brute(r.text)) for r in rows]
    return [(r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(rows, clean, strict=True)]


def test_stages_and_run_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == list(cp.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        rows, result = at.collect(), got.collect()
        if name == "mixing":
            words = lambda t: (t or "").encode().split()
            taken = {r.doc_id: r.taken for r in mix_documents(at).collect()}
            count = Counter()
            text = {r.doc_id: r.text for r in rows}
            for r in result:
                count[r.doc_id] += len(words(r.text))
                assert r.text in text[r.doc_id] and r.n_chars == len(r.text)
            assert {d: n for d, n in taken.items() if n} == dict(count)
        else:
            assert sorted(map(tuple, result)) == sorted(plain(name, rows))
        at = got
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(model.encode(r.text, add_special_tokens=False).ids) + 1) for r in at.collect())
    packed = cp.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.length) for r in packed) == want
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1
    assert np.unique([(r.sequence_id, r.offset) for r in packed], axis=0).shape[0] == len(packed)


def test_stages_on_empty_tables(spark, docs):
    at = docs.filter(F.lit(False))
    for _, stage in cp.STAGES:
        at = stage(spark, at, "")
        assert at.count() == 0


def test_near_dedup_judges_rows_that_share_an_id_one_by_one(spark):
    rng = random.Random(19)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(100)) for _ in range(4))
    rows = [(5, a), (5, b), (5, b), (5, f"{c} end"), (3, c), (7, d), (5, ""), (5, None), (9, f"{d} end"), (9, f"end {a}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in cp.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(5, a), (5, b), (3, c), (7, d), (5, ""), (5, None)], key=str)
