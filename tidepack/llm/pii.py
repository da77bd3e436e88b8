"""Personal data: base patterns, and bootstrapped extraction from the contexts in which they occur.

Base spans (fixed patterns for email, ip, card, phone) are the seeds, and so are long tokens of letters and digits such
as keys (kind secret), which are no spans by themselves. Each occurrence of a seed, and of a token of a similar shape
that fails the base patterns, has lexical patterns: its two words to the left, and its neighbours on both sides.
Patterns and instances (distinct values) form a graph. A pattern's score is the mean score of its instances, smoothed;
an instance that is no seed gets the noisy-or of the other accepted patterns it occurs in, those of high score and
enough support.

Then the texts are searched for what else is in the slots of accepted patterns, of any form: one word behind two words
to the left, up to five words between two neighbours, without the punctuation around them; and for other places of
the instances of one word that were found so. First the slots are only counted, by pattern: where seeds and instances of
accepted patterns fill less than `precise` of them, the pattern is no sign of identifiers and is dropped, so what is
extracted from the rest is no more than a multiple of what is known. The extracted join the graph with all their
patterns, which are scored again, so that words that are no identifiers count against a pattern, and new instances speak
for new patterns, whose slots are searched in the next round. In the end occurrences in patterns that are still accepted
and whose slots have been searched are spans too. Base spans always stay, and found spans that overlap one are not added, but for keys, which may hold digits that are a
base span.

The graph is a table counted by (pattern, kind, instance), so copies of a document add nothing, and each scoring is
aggregations and joins of tables. Patterns and instances go to the tasks by at most CHUNK at a time, with a pass over
the texts for each chunk. Offsets are code points, ends exclusive.

Null texts are empty: no spans. A null id is an id like others. Very long texts are searched whole. Repeated rows get
equal results. Equal scores need no order. Empty tables give no rows. Other columns of docs are not looked at.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, slices, texts_of

KINDS = ("email", "ip", "card", "phone")
#: With what only the method finds.
ALL_KINDS = (*KINDS, "secret")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# these begin at the first digit of a run; a later start in it could match no more
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Shapes of what base patterns miss, with the kind they may be.
_LIKE = (
    ("email", re.compile(r"(?<!\S)[\w.%+-]++@[\w.-]++(?!\S)")),
    ("email", re.compile(r"(?<!\S)[\w.%+-]++ ?[(\[{]at[)\]}] ?[\w-]++(?: ?[(\[{]dot[)\]}] ?[\w-]++)++", re.I)),
    ("ip", re.compile(r"(?<![\w.])[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){5,7}(?![\w:])", re.I)),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.])")),
    ("card", re.compile(r"(?<![\w+-])[0-9](?:[ -]?[0-9]){11,18}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+(-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![\w-])")),
)
#: Keys and the like: letters and digits, and so many characters at least.
_SECRET, SECRET_CHARS = re.compile(r"(?<![\w/+-])[A-Za-z0-9_/+-]{20,}+={0,2}"), 20
#: What is left out around the words in a slot, and how many words are looked at.
PUNCTUATION, SLOT_WORDS = "()[]{}<>.,;:!?\"'`´“”‘’«»…", 5
#: Words whose place in patterns a task remembers; patterns, or instances, that go to the tasks at once.
REMEMBER, CHUNK = 200_000, 200_000
OCCURRENCE = "start int, stop int, kind string, seed boolean, instance long, patterns array<string>"
SCAN = f"doc_id long, key long, counts array<long>, base array<struct<start:int,kind:int,stop:int>>, found array<struct<{', '.join(x.replace(' ', ':', 1) for x in OCCURRENCE.split(', '))}>>"


@dataclass(frozen=True)
class Bootstrap:
    """rounds: of scoring, and of searching slots, at most. support: distinct instances that a pattern needs. accept:
    its least score. smooth: added to the number of instances in the mean. precise: the least share of a pattern's slots
    that known instances fill."""

    rounds: int = 3
    support: int = 5
    accept: float = 0.8
    smooth: float = 0.5
    precise: float = 0.5


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each starts at the earliest local character before its @ that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def _value(instance: str) -> int:
    return xxhash.xxh3_64_intdigest(instance.lower()) - (1 << 63)


def _plain(word: str) -> str:
    return re.sub(r"[0-9]+", "0", word.lower())


def _patterns(text: str, at: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Those of what lies in the words i to j; at: the places of all words."""
    word = lambda k: _plain(text[at[k][0] : at[k][1]])
    out = [f"L {word(i - 2)} {word(i - 1)}"] if i > 1 else []
    return out + ([f"C {word(i - 1)} _ {word(j + 1)}"] if i > 0 and j + 1 < len(at) else [])


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    if any(len(w) >= SECRET_CHARS for w in text.split()):
        for m in _SECRET.finditer(text):
            if any(c in "0123456789" for c in m[0]) and any(c.isalpha() for c in m[0]) and len(set(m[0])) > SECRET_CHARS // 2:
                yield m.span()


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    spans = [(s, e, KINDS[k], True) for s, k, e in base]
    free = lambda s, e: all(e <= x[0] or s >= x[1] for x in spans)
    spans += [(s, e, "secret", True) for s, e in _secrets(text)]
    if "@" in text or any(c in text for c in "0123456789") or "at" in text:
        for kind, like in _LIKE:
            spans += [(m.start(), m.end(), kind, False) for m in like.finditer(text) if free(*m.span())]
    if not spans:
        return []
    at = [m.span() for m in re.finditer(r"\S+", text)]
    starts = [a for a, _ in at]
    word = lambda x: bisect_right(starts, x) - 1
    return [{"start": s, "stop": e, "kind": k, "seed": seed, "instance": _value(text[s:e]), "patterns": _patterns(text, at, word(s), word(e - 1))} for s, e, k, seed in sorted(spans)]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its base spans, and all occurrences with their patterns."""
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.decode("utf-8", "replace") for t in texts_of(batch)]
            base = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(2),
                    pa.array([[sum(k == i for _, k, _ in b) for i in range(4)] for b in base], pa.list_(pa.int64())),
                    pa.array([[{"start": s, "kind": k, "stop": e} for s, k, e in b] for b in base], base_type),
                    pa.array([occurrences(t, b) for t, b in zip(texts, base, strict=True)], found_type),
                ],
                names=["doc_id", "key", "counts", "base", "found"],
            )

    return map_arrow(_keyed(docs), run, SCAN)


def bootstrap(found: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """found: one row per occurrence. The accepted patterns: pattern, kind, score, support."""
    rows = found.select("kind", "seed", "instance", F.explode("patterns").alias("pattern"))
    graph = rows.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed"))
    enough = graph.groupBy("pattern", "kind").agg(F.count("*").alias("n")).filter(F.col("n") >= settings.support)
    graph = graph.join(enough.drop("n"), ["pattern", "kind"], "left_semi")
    seeds = graph.groupBy("instance", "kind").agg(F.max("seed").alias("sure"))
    graph = materialize(graph.drop("seed").join(seeds, ["instance", "kind"]).select("*", F.col("sure").cast("double").alias("score")), "graph")
    scored = graph
    for k in range(settings.rounds):
        patterns = scored.groupBy("pattern", "kind").agg((F.sum("score") / (F.count("*") + settings.smooth)).alias("score"), F.count("*").alias("support"))
        if k + 1 < settings.rounds:
            patterns = materialize(patterns, "patterns")
            # what an accepted pattern says of an instance doesn't count for the pattern itself
            vote = F.when(F.col("score") >= settings.accept, F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))).otherwise(0.0)
            edges = graph.drop("score").join(patterns.select("pattern", "kind", vote.alias("vote")), ["pattern", "kind"])
            all_votes = edges.groupBy("instance", "kind").agg(F.sum("vote").alias("votes"))
            scored = edges.join(all_votes, ["instance", "kind"]).select("pattern", "kind", "instance", F.when(F.col("sure"), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.exp(F.col("votes") - F.col("vote")))).alias("score"))
    return patterns.filter(F.col("score") >= settings.accept)


class _Codes(dict):
    """By word: twice its number among the patterns' words (0: in none), and 1 more if it is an instance."""

    def __init__(self, numbers: dict[str, int], instances: dict[int, set[str]]):
        self.numbers, self.instances = numbers, instances

    def __missing__(self, word: str) -> int:
        code = 2 * self.numbers.get(_plain(word), 0) + (_value(word.strip(PUNCTUATION)) in self.instances if self.instances else 0)
        self[word] = code
        return code


class Slots:
    """Finds what is in the slots of patterns, (pattern, kind), and instances, (instance, kind)."""

    def __init__(self, patterns: list[tuple[str, str]], instances: list[tuple[int, str]] = ()):
        self.instances: dict[int, set[str]] = {}
        for instance, kind in instances:
            self.instances.setdefault(instance, set()).add(kind)
        self.kinds: dict[str, list[str]] = {}
        for pattern, kind in sorted(patterns):
            self.kinds.setdefault(pattern, []).append(kind)
        self.names = sorted(self.kinds)
        numbers: dict[str, int] = {}
        self.keys: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for sort, other in (("L", 2), ("C", 3)):
            of = [i for i, p in enumerate(self.names) if p[0] == sort]
            pairs = [(w[1], w[other]) for w in (self.names[i].split(" ") for i in of)]
            keys = np.array([numbers.setdefault(a, len(numbers) + 1) << 32 | numbers.setdefault(b, len(numbers) + 1) for a, b in pairs], np.int64)
            order = np.argsort(keys)
            self.keys[sort] = keys[order], np.array(of, np.int64)[order]
        self.codes = _Codes(numbers, self.instances)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slots of patterns: the text, its first and last word, the pattern's number; those with an instance as the
        word have number -1."""
        if len(self.codes) > REMEMBER:
            self.codes.clear()
        words = [t.split() for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        code = np.fromiter(map(self.codes.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        out = [(np.flatnonzero(code & 1), 0, np.full(int((code & 1).sum()), -1))]
        word, used = code >> 1, np.flatnonzero(code > 1)
        for sort, ahead in [("L", 1), *(("C", d + 1) for d in range(1, SLOT_WORDS + 1))]:
            keys, number = self.keys[sort]
            # a slot behind two words needs one more word, in the same text
            a = used[used < len(code) - ahead - (sort == "L")]
            a = a[(word[a + ahead] > 0) & (of[a] == of[a + ahead + (sort == "L")])]
            key = word[a] << 32 | word[a + ahead]
            found = np.searchsorted(keys, key)
            ok = found < len(keys)
            ok[ok] = keys[found[ok]] == key[ok]
            first = a[ok] + (2 if sort == "L" else 1)
            out.append((first, 0 if sort == "L" else ahead - 2, number[found[ok]]))
        first = np.concatenate([x[0] for x in out])
        last = np.concatenate([x[0] + x[1] for x in out])
        return of[first], place[first], place[last], np.concatenate([x[2] for x in out]), first

    def count(self, texts: list[str]) -> np.ndarray:
        """How many slots each pattern has."""
        number = self.hits(texts)[3]
        return np.bincount(number[number >= 0], minlength=len(self.names))

    def find(self, texts: list[str]) -> list[list[dict]]:
        """By text, occurrences as in a scan, that overlap none of it."""
        result: list[list[dict]] = [[] for _ in texts]
        of, first, last, number, _ = self.hits(texts)
        order = np.argsort(of, kind="stable")
        for t, group in itertools.groupby(order.tolist(), key=of.__getitem__):
            text = texts[t]
            at = [m.span() for m in re.finditer(r"\S+", text)]
            out: dict[tuple[int, int, str], list[str]] = {}
            for x in group:
                i, j, k = int(first[x]), int(last[x]), int(number[x])
                slot = text[at[i][0] : at[j][1]]
                start, bare = at[i][0] + len(slot) - len(slot.lstrip(PUNCTUATION)), slot.strip(PUNCTUATION)
                patterns = _patterns(text, at, i, j)
                if j > i:
                    patterns = [p for p in patterns if p[0] == "C"]
                kinds = self.kinds[self.names[k]] if k >= 0 else self.instances[_value(bare)]
                out |= {(start, start + len(bare), kind): patterns for kind in kinds if bare}
            taken = [(x["start"], x["stop"]) for x in occurrences(text, base_spans(text))]
            free = [x for x in out if all(x[1] <= s or x[0] >= e for s, e in taken)]
            result[t] = [{"start": s, "stop": e, "kind": k, "seed": False, "instance": _value(text[s:e]), "patterns": out[s, e, k]} for s, e, k in sorted(free)]
        return result


def _decoded(batch: pa.RecordBatch) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts_of(batch)]


def slots(docs: DataFrame, patterns: list[tuple[str, str]], instances: list[tuple[int, str]]) -> DataFrame:
    """doc_id, key and occurrences: what is in the slots of patterns, and instances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Slots(patterns, instances)
        for batch in slices(batches):
            rows = [(d, k, x) for d, k, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), search.find(_decoded(batch)), strict=True) for x in found]
            if rows:
                names = {"start": pa.int32(), "stop": pa.int32(), "kind": pa.string(), "seed": pa.bool_(), "instance": pa.int64(), "patterns": pa.list_(pa.string())}
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[2][n] for r in rows], t) for n, t in names.items())], names=["doc_id", "key", *names])

    return map_arrow(_keyed(docs), run, f"doc_id long, key long, {OCCURRENCE}")


def fills(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """pattern, fills: how many slots each has in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Slots([(p, "") for p in patterns])
        n = np.zeros(len(search.names), np.int64)
        for batch in slices(batches):
            n += search.count(_decoded(batch))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([search.names[i] for i in some], pa.string()), pa.array(n[some])], names=["pattern", "fills"])

    return map_arrow(_keyed(docs), run, "pattern string, fills long").groupBy("pattern").agg(F.sum("fills").alias("fills"))


def _chunks(rows: DataFrame, *names: str) -> Iterator[list[tuple]]:
    """The distinct rows, by at most about CHUNK."""
    rows = materialize(rows.select(*names).distinct(), "chunks")
    n = -(-rows.count() // CHUNK)
    for k in range(n):
        yield sorted(tuple(r) for r in rows.filter(F.pmod(F.xxhash64(*names), F.lit(n)) == k).collect())


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def discovered(docs: DataFrame, scans: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, key, more: the spans that accepted patterns add, by document."""
    spark = docs.sparkSession
    found = every = scans.select("doc_id", "key", F.explode("found").alias("f")).select("doc_id", "key", "f.*")
    both, one = ["pattern", "kind"], ["instance", "kind"]
    counted = spark.createDataFrame([], "pattern string, fills long")
    precise, trusted = spark.createDataFrame([], "pattern string, kind string"), spark.createDataFrame([], "instance long, kind string")
    base = F.col("seed") & F.col("kind").isin(*KINDS)
    good = materialize(bootstrap(every, settings).select(*both), "patterns")
    placed = lambda: every.withColumn("pattern", F.explode("patterns"))
    within = lambda: placed().filter(~base).join(good.join(precise, both, "left_semi"), both, "left_semi")
    searched = 0, 0
    for _ in range(settings.rounds):
        new = good.join(counted, "pattern", "left_anti")
        counts = [fills(docs, [p for (p,) in chunk]) for chunk in _chunks(new, "pattern")]
        if counts:
            counted = materialize(_all([counted, *counts]), "counted")
        # instances that speak for new patterns; what they fill does not count against one
        trusted = materialize(within().filter("not seed").select(*one).union(trusted).distinct(), "trusted")
        known = placed().join(trusted.withColumn("sure", F.lit(True)), one, "left").filter("seed or sure")
        known = known.groupBy(*both).agg(F.count("*").alias("known")).join(counted, "pattern").filter(F.col("known") >= settings.precise * F.col("fills"))
        precise = materialize(good.join(known, both, "left_semi").select(*both).union(precise).distinct(), "precise")
        sizes = precise.count(), trusted.count()  # neither ever loses a row
        if sizes == searched:
            break
        searched = sizes
        parts = [slots(docs, chunk, []) for chunk in _chunks(precise, *both)] + [slots(docs, [], chunk) for chunk in _chunks(trusted, *one)]
        every = materialize(_all([found, *parts]).dropDuplicates(["doc_id", "key", "start", "stop", "kind"]), "found")
        good = materialize(bootstrap(every, settings).select(*both), "patterns")
    number = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).cast("int") - 1
    span = F.struct("start", number.alias("kind"), "stop")
    return within().groupBy("doc_id", "key").agg(F.collect_set(span).alias("more"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"]))
    return F.concat_ws(",", each)


def personal_data(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per document: doc_id, the numbers of base spans by kind, a digest of the base spans, all spans."""
    scans = materialize(scan(docs), "scans")
    more = discovered(docs, scans, settings).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "more")
    df = scans.select("doc_id", "key", "counts", "base").join(more, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))
    counts = [F.get("counts", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind's name in brackets."""
    out, at, stop = [], 0, 0
    for s, k, e in sorted(spans):
        if s >= stop:
            out += [text[at:s], f"[{ALL_KINDS[k].upper()}]"]
            at = stop = e
        else:
            at = stop = max(stop, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """docs with every span masked in text, and n_chars brought up to date if there."""
    more = discovered(docs, materialize(scan(docs), "scans"), settings).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "more")
    more = materialize(more, "found")
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    df = keyed.join(more, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left").select(*docs.columns, "more")
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = []
            for text, extra in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                spans = base_spans(text or "") + [(x["start"], x["kind"], x["stop"]) for x in extra or ()]
                new.append(masked(text, spans) if spans else text)
            columns = [pa.array(new, pa.string()) if n == "text" else pa.array([None if t is None else len(t) for t in new], pa.int64()) if n == "n_chars" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)][:-1]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(df, run, ", ".join(f"`{f.name}` {'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.schema))
