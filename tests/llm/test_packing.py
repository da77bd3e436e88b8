import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tidepack.llm.packing import pack, sweep
from tokenizers import Tokenizer


def test_sweep_places_each_document_once_and_packs_tightly():
    rng = random.Random(4)
    for trial in range(40):
        cap = rng.choice([8, 50, 4096])
        sizes = Counter(rng.randint(1, cap) if rng.random() < 0.5 else rng.randint(1, max(1, cap // 6)) for _ in range(rng.randint(0, 400)))
        rows, held, ranks = sweep(sizes, cap), defaultdict(list), defaultdict(set)
        for size, rank, n, seq, offset in rows:
            for i in range(n):
                held[seq + i].append((offset, size))
                assert rank + i not in ranks[size]
                ranks[size].add(rank + i)
        assert {s: len(r) for s, r in ranks.items()} == dict(sizes)
        for parts in held.values():
            end = 0
            for offset, size in sorted(parts):
                assert offset == end
                end += size
            assert end <= cap
        least = max(-(-sum(s * n for s, n in sizes.items()) // cap), sum(n for s, n in sizes.items() if 2 * s > cap))
        assert len(held) <= 1.15 * least + 2, (trial, len(held), least)


def test_pack_against_the_plain_tokenizer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()
    odd = [None, "", " \n", "It's <|endoftext|> HERE, don't!! x…, É… ¿qué? a'b'S. 12345 word12.5,", "naïve" + " ﬁ ǅ İstanbul é  x y", "lorem ipsum, " * 9000]
    rows = [(d.doc_id, d.text, 7) for d in docs] + [(10_000 + i, t, 7) for i, t in enumerate(odd)] + [(10_003, odd[3], 7)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length int")).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc, text, _ in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[doc, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096
    assert len(held) <= sum(r.length for r in got) // 4096 + 2
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sweeps_against_plain_best_fit():
    """The same rounds over single documents and gaps."""
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100])
        docs = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        left, seqs = sorted(docs, reverse=True), []
        while left:
            most = sum(2 * d > capacity for d in left) or max(1, -(-sum(left) // capacity))
            seqs += [[d] for d in left[:most]]
            left = left[most:]
            met = True
            while met and left:
                gaps = sorted((capacity - sum(s), i) for i, s in enumerate(seqs))
                met, rest = False, []
                for d in left:
                    fit = next((g for g in gaps if g[0] >= d), None)
                    if fit:
                        gaps.remove(fit)
                        seqs[fit[1]].append(d)
                        met = True
                    else:
                        rest.append(d)
                left = rest
        found = {}
        for size, _, n, first, offset in sweep(Counter(docs), capacity).tolist():
            for k in range(n):
                found.setdefault(first + k, []).append((offset, size))
        assert sorted(sum(s) for s in seqs) == sorted(sum(x for _, x in s) for s in found.values())
        assert sorted(sorted(s) for s in seqs) == sorted(sorted(x for _, x in s) for s in found.values())
        for s in found.values():
            assert [o for o, _ in sorted(s)] == [sum(x for _, x in sorted(s)[:i]) for i in range(len(s))]
