"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous rounds. Documents and gaps are range-sorted by size; in a round every document looks for its
successor, the smallest gap that holds it, largest documents first, and a gap takes one document. Conflicts go
by rank: the i-th document of a size takes the i-th gap of its successor's size. Gaps shrink, and the next round
begins; where nothing fits any more, the largest documents left open new sequences.

Sizes are whole numbers up to the sequence length, so documents and gaps of one size are told apart by their
rank alone and a round is a sweep over at most `capacity` run-length classes, whatever the number of documents.
The driver sweeps these classes (`sweep`); the cluster tokenises, counts, ranks documents within their size
(a size of more than BUCKET_ROWS pieces in buckets, so that one shared by a third of all documents is no hot group)
and looks each document's
place up by its rank. What is sent to the executors is the list of matches between runs, a few rows per class
and round.

Null and empty texts are one piece that holds the end id alone. Repeated rows are packed each; rows that agree
in every column may swap places. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, pick, slices, texts_of

CAPACITY, END_ID = 4096, 1
#: Pieces of one size in a bucket that is ranked by one task; words whose ids a worker remembers.
BUCKET_ROWS, REMEMBER = 2_000, 1_000_000
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_END = b"\xff"
_workers: dict[str, Words] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest
    follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words:
    """Ids of whole texts. The vocabulary's rules never join characters across white space, so a text's ids are
    its words' ids in order; words seen before are looked up. Of new words, those of Latin letters and a tail of
    punctuation need no normalising but lower case and no further splitting, so their parts go straight to a merge
    engine with the same vocabulary, where a byte that no text holds marks the end of a word."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.model, self.known = Tokenizer.from_file(vocabulary), {}
        letters = _byte_letters()
        ranks = {}
        for token, i in self.model.get_vocab(with_added_tokens=False).items():
            core = token.removesuffix("</w>")
            if all(c in letters for c in core):
                ranks[bytes(letters[c] for c in core) + _END * (core != token)] = i
        self.merge = Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _learn(self, words: set[bytes]) -> None:
        known, merge, odd = self.known, self.merge, []
        for w in words:
            if simple := _SIMPLE.fullmatch(w.decode()):
                core, tail = simple.groups()
                ids = merge(core.lower().encode() + _END)
                if tail:
                    ids += merge(tail.encode() + _END)
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                odd.append(w)
        for w, e in zip(odd, self.model.encode_batch([w.decode() for w in odd], add_special_tokens=False) if odd else (), strict=True):
            known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        known = self.known
        for text in texts:
            words = text.split()
            parts = list(map(known.get, words))
            if None in parts:
                self._learn({w for w, p in zip(words, parts, strict=True) if p is None})
                if len(known) > REMEMBER:
                    self.known = known = dict(itertools.islice(known.items(), len(known) // 2, None))
                    self._learn(set(words) - known.keys())
                parts = map(known.__getitem__, words)
            yield np.frombuffer(b"".join(parts), "<u4")


def words_of(vocabulary: str | None) -> Words:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    if vocabulary not in _workers:
        _workers[vocabulary] = Words(vocabulary)
    return _workers[vocabulary]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as ids, those over the capacity cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        for batch in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(texts_of(batch)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    for column, v in zip(rows, (doc, k, at, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(pick(docs, "doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Matches as rows (size, first rank, number, first sequence, offset). counts: documents of each size."""
    left = {size: n for size, n in counts.items() if n}
    done = dict.fromkeys(left, 0)  # ranks of each size that are placed
    gaps: dict[int, list[tuple[int, int]]] = {}  # runs (first sequence, number) by gap
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(size: int, run: tuple[int, int], gap: int, into: dict) -> None:
        rows.append((size, done[size], run[1], run[0], capacity - gap))
        done[size] += run[1]
        left[size] -= run[1]
        if not left[size]:
            del left[size]
        if gap > size:
            into.setdefault(gap - size, []).append(run)

    while left:
        # no two documents over half the capacity share a sequence; later, as many as the rest must need
        most = sum(n for size, n in left.items() if 2 * size > capacity) or max(1, -(-sum(s * n for s, n in left.items()) // capacity))
        for size in sorted(left, reverse=True):
            n = min(most, left[size])
            if not n:
                break
            place(size, (opened, n), capacity, gaps)
            opened += n
            most -= n
        while left:
            order, at, free, fresh, met = sorted(gaps, reverse=True), 0, [], {}, False
            for size in sorted(left, reverse=True):
                while at < len(order) and order[at] >= size:
                    free.append(order[at])  # the smallest that fits is always the last
                    at += 1
                while free and size in left:
                    gap = free[-1]
                    first, n = gaps[gap].pop()
                    use = min(n, left[size])
                    if use < n:
                        gaps[gap].append((first + use, n - use))
                    place(size, (first, use), gap, fresh)
                    met = True
                    if not gaps[gap]:
                        del gaps[gap]
                        free.pop()
            for gap, runs in fresh.items():
                gaps.setdefault(gap, []).extend(runs)
            if not met:
                break
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    cut = materialize(pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` at most
    hot = [(size, -(-n // BUCKET_ROWS)) for size, n in counts.items() if n > BUCKET_ROWS]
    hot = F.broadcast(docs.sparkSession.createDataFrame(hot, "length long, buckets long"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.coalesce("buckets", F.lit(1)))
    cut = cut.join(hot, "length", "left").withColumn("bucket", salt)
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    matches = sweep(counts, capacity)
    matches = matches[np.lexsort((matches[:, 1], matches[:, 0]))]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = matches[:, 0] << 44 | matches[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            sequence = matches[at, 3] + rank - matches[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(matches[at, 4])], names=[*names, "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("rank", rank).join(first, ["length", "bucket"]).select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    return map_arrow(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
