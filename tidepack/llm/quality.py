"""Quality rules on repetition, from a suffix array over the words of each document.

A batch of documents becomes one array of word numbers. Prefix doubling sorts its suffixes; only those that
still share a prefix with another are sorted again, so a text without long repeats needs few rounds. The ranks
of each round give the longest common prefix of neighbours by binary lifting. Position j starts a repeat of
L[j] words, the larger of its two neighbours' common prefixes; the spans [j, j + L[j]) with L[j] >= m are all
occurrences of the maximal repeated substrings of m words or more, and their union is what repeats.

Nulls and texts without words: no words, all counts 0, rejected. Repeated rows each get their own result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, pick, slices, texts_of

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """min_words: shorter texts go. window: the base's repeat. max_repeat: largest share of words in repeated
    windows. span: words of a repeat that counts as a copied passage. max_covered: largest share of words in
    such passages. max_longest: longest passage found twice, in words."""

    min_words: int = 50
    window: int = 3
    max_repeat: float = 0.5
    span: int = 10
    max_covered: float = 0.4
    max_longest: int = 400


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the most words that start there and also start elsewhere in the same document.
    words: numbers; ends: for each position the end of its document, exclusive."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    doc = np.cumsum(np.concatenate([[0], (ends[1:] != ends[:-1]).astype(np.int64)]))
    order, head = _grouped(doc * (int(words.max()) + 1) + words)
    rank = np.empty(n, np.int64)
    rank[order] = head
    sa, levels, h = order, [rank], 1
    live = _shared(head)
    while live.any():
        # rank 0 is free for "past the end": ranks are shifted by one
        slots = np.flatnonzero(live)
        at = sa[slots]
        follow = at + h
        inside = follow < ends[at]
        key = np.where(inside, levels[-1][np.minimum(follow, n - 1)] + 1, 0)
        old = levels[-1][at]
        by = np.lexsort((key, old)) if n > 1 << 31 else np.argsort(old * np.int64(n + 1) + key, kind="stable")
        at, old, key = at[by], old[by], key[by]
        sa = sa.copy()
        sa[slots] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        # a group's rank is the place of its first suffix; one that ended is equal to none but itself
        fresh |= key == 0
        rank = levels[-1].copy()
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        levels.append(rank)
        h *= 2
        head = rank[sa]
        live = _shared(head)
    left, right = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        r = levels[k]
        ok = (left < n) & (right < n)
        same = np.zeros(n - 1, bool)
        same[ok] = r[left[ok]] == r[right[ok]]
        lcp[same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
        # a suffix that has come to its document's end shares nothing more: its next rank is another document's
    out = np.zeros(n, np.int64)
    out[sa[:-1]] = lcp
    out[sa[1:]] = np.maximum(out[sa[1:]], lcp)
    return out


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and for each place in it the first place with its key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    return order, np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))


def _shared(head: np.ndarray) -> np.ndarray:
    """Which places of the order hold a group of two or more."""
    same = head[1:] == head[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a span [j, j + lengths[j]) with lengths[j] >= least."""
    n = len(lengths)
    reach = np.maximum.accumulate(np.where(lengths >= least, np.arange(n) + lengths, 0))
    return reach > np.arange(n)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], limits: Limits) -> dict[str, np.ndarray]:
    """The measures and verdicts of whole texts."""
    number: dict[bytes, int] = {}
    per = [t.split() for t in texts]
    n_words = np.array([len(w) for w in per], np.int64)
    flat = np.fromiter((number.setdefault(w, len(number)) for ws in per for w in ws), np.int64, int(n_words.sum()))
    stop = np.cumsum(n_words)
    repeat = longest_repeats(flat, np.repeat(stop, n_words))
    which = np.repeat(np.arange(len(texts)), n_words)
    count = lambda mask: np.bincount(which[mask], minlength=len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, which, repeat)
    out = {
        "n_words": n_words,
        "word_chars": np.array([len(t.decode("utf-8", "replace")) - (len(t) - len(t.translate(None, _SPACE))) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": count(covered(repeat, limits.window)),
        "n_covered_words": count(covered(repeat, limits.span)),
        "longest_repeat": longest,
    }
    out["base_failed"] = (n_words < limits.min_words) | (out["n_repeat_words"] > limits.max_repeat * n_words)
    out["kept"] = ~out["base_failed"] & (out["n_covered_words"] <= limits.max_covered * n_words) & (longest <= limits.max_longest)
    return out


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document with its measures and verdict. A map over the documents: no shuffle, and memory
    bounded by one slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = measure(texts_of(batch), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(v) for v in got.values())], names=["doc_id", *got])

    return map_arrow(pick(docs, "doc_id", "text"), run, SCHEMA)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs whose text the rules keep, with all columns: a filter in one pass over the documents."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(measure(texts_of(batch), limits)["kept"]))

    return map_arrow(docs, run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)).select(*[f"`{n}`" for n in names])
