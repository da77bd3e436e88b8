"""Scoring texts with a weighted backoff automaton over words, trained on all training texts.

States and arcs, with log10 weights:
- a state for each pair of words that the training texts hold. Its arcs are the words seen after it, each with weight
  (times + STRONG * weight from the next state) / (times of the pair + STRONG); its failure arc leads to the state of
  the pair's second word, with weight STRONG / (times of the pair + STRONG);
- a state for each word of the training texts, in the same way with WEAK; its failure arc leads to the root;
- the root. Its arcs are all words of the training texts, DISCOUNT taken off their times; its failure arc, with the mass
  that this frees, reads one unknown word, whichever it is, and comes back to the root.
So n-grams of three words, two and one are smoothed, and the arcs of a state, with what failure leads to, add up to one.
A text starts from the state of the end. One traversal from left to right adds the weights and carries the state, the
longest one that the last two words have. The events are those of the base: the words of the training texts, the end,
and "unknown".

Counting. Documents are read once and kept as blocks of some BLOCK_TOKENS tokens: the hashes of a block's words and the
texts as numbers of them. A block's n-grams, as sorted hashes, are cut by their leading bits and sent as packed arrays
to the task that sums these; it answers each block with the totals alone, in the order of the block's own n-grams. So
an n-gram costs a few bytes on either way, and nothing but two totals goes to the driver. Words come first, then
pairs, then triples. A pair is sent only if both its words, and a triple only if both its pairs, occur in other blocks
too: the others cannot, so their totals are what the block has itself.
A table of sums holds about TABLE n-grams, however many blocks ask, for the requests of a table wait in a temporary file.

N-grams are told apart by 64-bit hashes. Null and empty texts are the end token alone. A null id belongs to the training
texts. Very long texts are a block of their own. Repeated rows count as often as they occur. Without training tokens
every token weighs log10(1) = 0. Empty tables give no rows. Other columns of docs are not looked at.
"""

from __future__ import annotations

import itertools
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, materialize, pick, slices, texts_of

#: What stands for the lower order in states of pairs and of words; what is taken off the times of words.
STRONG, WEAK, DISCOUNT = 4.0, 1000.0, 0.5
#: Tokens of a block, n-grams of a table of sums, bytes of a piece that is sent, bytes of requests kept in memory, and
#: bytes of blocks for a task that reads them.
BLOCK_TOKENS, TABLE, PIECE, SPOOL, TASK_BYTES = 1 << 19, 1 << 20, 1 << 16, 1 << 26, 1 << 25
END = b""  # no word is empty
#: Kinds of rows: a block's words and texts, requests and answers by length of the n-gram.
BLOCK, WORDS, PAIRS, TRIPLES = 0, 1, 2, 3
#: Rows that carry packed arrays to a block or a table (at), in the order of kind, part and piece.
SENT = "at long, kind int, part long, piece int, sender long, total long, distinct long, body binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def follow(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams: those of all but the last word, and the last word's."""
    with np.errstate(over="ignore"):
        x = (state ^ (state >> np.uint64(31))) * _MIX[0] + word
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def dumped(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, the bytes of one place together, compressed."""
    planes = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    return zstandard.compress(pickle.dumps(planes, 5), 1)


def loaded(body: bytes) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() for t, b in pickle.loads(zstandard.decompress(body))]


def sent(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (at, kind, part, sender, total, distinct, body) as SENT, bodies cut into pieces."""
    cut = ((at, kind, part, k, sender, total if not k else 0, distinct if not k else 0, body[i : i + PIECE]) for at, kind, part, sender, total, distinct, body in rows for k, i in enumerate(range(0, max(1, len(body)), PIECE)))
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in SENT.split(", ")]
    while some := list(itertools.islice(cut, 256)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)


def received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, int, bytes]]]]:
    """For each `at` its rows (kind, part, sender, body)."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 3, 7)), strict=True))
    for at, group in itertools.groupby(rows, lambda r: r[0]):
        yield at, ((key[1], key[2], key[3], b"".join(p[5] for p in pieces)) for key, pieces in itertools.groupby(group, lambda r: r[:4]))


def gathered(df: DataFrame, tasks: int) -> DataFrame:
    """Rows that are SENT, those of one `at` together and in order."""
    order = ("at", "kind", "part", "sender", "piece")
    return df.repartition(tasks, "at").sortWithinPartitions(*order)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def blocks(docs: DataFrame) -> DataFrame:
    """The documents as blocks, SENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        held: list[tuple] = []
        size = 0

        def done() -> Iterator[tuple]:
            hashes = np.fromiter(map(word_hash, number), np.uint64, len(number))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            doc, some, test = (np.array([h[i] or 0 for h in held], np.int64) for i in range(3))
            flat = place[np.concatenate([h[3] for h in held])]
            lengths = np.array([len(h[3]) for h in held], np.int64)
            at = uuid.uuid4().int >> 65
            yield at, BLOCK, 0, 0, len(hashes), 0, dumped(hashes[order], np.array([place[number[END]]], np.int64), doc, some, test, lengths, flat)

        for batch in slices(batches):
            for doc, test, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_of(batch), strict=True):
                words = tokens(text)
                held.append((doc, doc is not None, test, np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield from sent(done())
                    number, held, size = _Numbers(), [], 0
        if held:
            yield from sent(done())

    return map_arrow(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")), run, SENT)


class Block:
    """A block's n-grams: for each length its sorted hashes, how often each occurs in the training texts here, and, once
    answered, everywhere."""

    def __init__(self, body: bytes, length: int = TRIPLES):
        self.hashes, end, self.doc, self.some, self.held, self.lengths, self.words = loaded(body)
        self.words = self.words.astype(np.int64)
        self.stops = np.cumsum(self.lengths)
        self.first = np.zeros(len(self.words), bool)
        self.first[self.stops - self.lengths] = True
        self.train = np.repeat(self.held == 0, self.lengths)
        here = np.bincount(self.words[self.train], minlength=len(self.hashes))
        #: by length: hashes, times here, whether asked, totals, whether other blocks have them; for each token the place of its n-gram
        self.keys, self.here, self.asked, self.total, self.shared = {WORDS: self.hashes}, {WORDS: here}, {WORDS: np.ones(len(here), bool)}, {}, {}
        self.place = {WORDS: self.words}
        before = np.concatenate([self.words[:1], self.words[:-1]])
        before[self.first] = end[0]
        self.before = before

    def answered(self, length: int, totals: np.ndarray, shared: np.ndarray) -> None:
        asked = self.asked[length]
        self.total[length], self.shared[length] = self.here[length].copy(), np.zeros(len(asked), bool)
        self.total[length][asked] = totals
        self.shared[length][asked] = shared > 0

    def extend(self, length: int) -> None:
        """The n-grams of this length, once the shorter ones are answered."""
        if length == PAIRS:
            at, state, word = np.ones(len(self.words), bool), self.before, self.words
        else:  # a text's first word has no pair before it
            at = ~self.first
            state, word = np.concatenate([[0], self.place[PAIRS][:-1]])[at], self.words[at]
        codes, place = np.unique(state * len(self.hashes) + word, return_inverse=True)
        a, w = np.divmod(codes, len(self.hashes))
        hashes = follow(self.keys[length - 1][a], self.hashes[w])
        order = np.argsort(hashes)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        place = back[place]
        self.keys[length] = hashes[order]
        self.here[length] = np.bincount(place[self.train[at]], minlength=len(order))
        # the n-gram without its first word: the word itself, or the pair of the token
        last = np.zeros(len(order), np.int64)
        last[place] = self.place[length - 1][at]
        self.asked[length] = self.shared[length - 1][a[order]] & self.shared[length - 1][last]
        self.place[length] = np.full(len(self.words), -1)
        self.place[length][at] = place

    def requests(self, length: int, at: int, bits: int) -> Iterator[tuple]:
        some = self.asked[length]
        keys, here = self.keys[length][some], self.here[length][some]
        part = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                gaps = np.diff(keys[a:b], prepend=np.uint64(0))
                yield int(part[a]), length, 0, at, b - a, 0, dumped(gaps, here[a:b].astype(np.uint32))

    def scores(self, total: int, distinct: int) -> list[np.ndarray]:
        """By document: tokens, known tokens, the base's and the automaton's log10 weights."""
        times = {k: np.concatenate([self.total[k], [0]]) for k in self.total}  # place -1: none
        word = times[WORDS][self.words].astype(float)
        before = times[WORDS][self.before]
        state = times[PAIRS][np.concatenate([[-1], self.place[PAIRS][:-1]])]
        if total:
            root = np.where(word > 0, word - DISCOUNT, DISCOUNT * distinct) / total
            second = (times[PAIRS][self.place[PAIRS]] + WEAK * root) / (before + WEAK)
            third = (times[TRIPLES][self.place[TRIPLES]] + STRONG * second) / (state + STRONG)
            weight = np.log10(np.where(self.first, second, third))
        else:
            weight = np.zeros(len(word))
        starts = self.stops - self.lengths
        base = np.log10((word + 1) / (total + distinct + 1))
        return [self.lengths, np.add.reduceat((word > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(weight, starts)]


def _opened(rows: Iterator[tuple[int, int, int, bytes]], length: int) -> Block:
    """A block and the answers to its n-grams of up to this length."""
    block, answers = None, {k: [] for k in range(WORDS, length + 1)}
    for kind, _, _, body in rows:
        if kind == BLOCK:
            block = Block(body)
        else:
            answers[kind].append(loaded(body))
    for k, found in answers.items():
        if k > WORDS:
            block.extend(k)
        block.answered(k, *(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(2)))
    return block


def _asked(rows: DataFrame, length: int, bits: int, tasks: int) -> DataFrame:
    """What blocks ask for n-grams of this length. rows: blocks, and the answers for shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, group in received(batches):
            block = _opened(group, length - 1)
            if length > WORDS:
                block.extend(length)
            yield from sent(block.requests(length, at, bits))

    return map_arrow(rows if length == WORDS else gathered(rows, tasks), run, SENT)


def _answered(requests: DataFrame, length: int, tasks: int) -> DataFrame:
    """To each request the totals, and which n-grams other blocks have too; the first answer of a table also carries the
    table's own total and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers() -> Iterator[tuple]:
            for part, group in received(batches):
                sums, new, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
                with tempfile.SpooledTemporaryFile(SPOOL) as wait:
                    for _, _, sender, body in group:
                        gaps, here = loaded(body)
                        new.append((np.cumsum(gaps, dtype=np.uint64), here.astype(np.int64), np.ones(len(gaps), np.int64)))
                        pickle.dump((sender, body), wait, 5)
                        waiting += len(gaps)
                        if waiting > TABLE:
                            sums, new, waiting = _summed([sums, *new]), [], 0
                    keys, times, senders = _summed([sums, *new])
                    total, distinct = int(times.sum()), int((times > 0).sum())
                    end = wait.tell()
                    wait.seek(0)
                    while wait.tell() < end:
                        sender, body = pickle.load(wait)
                        asked = np.cumsum(loaded(body)[0], dtype=np.uint64)
                        at = np.searchsorted(keys, asked)
                        yield sender, length, part, 0, total, distinct, dumped(times[at], (senders[at] > 1).view(np.uint8))
                        total = distinct = 0

        yield from sent(answers())

    return map_arrow(gathered(requests, tasks), run, SENT)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2))


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = materialize(blocks(pick(docs, "doc_id", "text")), "blocks")
    size = rows.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")).first()
    # about as many tables as requests need; a block's body has no fewer bytes than tokens
    many = {WORDS: size.words, PAIRS: size.bytes, TRIPLES: size.bytes}
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.bytes // TASK_BYTES))
    total = distinct = 0
    for length in (WORDS, PAIRS, TRIPLES):
        bits = max(0, many[length] // TABLE).bit_length()
        answers = materialize(_answered(_asked(rows, length, bits, tasks), length, tasks), "answers")
        if length == WORDS:
            sums = answers.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).first()
            total, distinct = sums.total, sums.distinct
        rows = rows.union(answers)
        forget(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in received(batches):
            block = _opened(group, TRIPLES)
            n, known, base, weight = block.scores(total, distinct)
            doc = pa.array(block.doc, pa.int64(), mask=block.some == 0)
            out = [doc, pa.array(block.held == 1), pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(base), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in RESULT.split(", ")])

    return map_arrow(gathered(rows, tasks), run, RESULT)
