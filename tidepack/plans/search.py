"""Choosing plans: thirty static ones, an exhaustive bounded search, and learned corrections between parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from ..functions.dtypes import DTYPES, DType, bit_view
from ..operators.codecs import CODECS, ratio
from .tree import HEADER, Plan, compress, predicted_size

#: What static plans begin and end with.
PREFIXES = ((), ("floatToInt",), ("delta",), ("scale",), ("delta", "floatToInt"), ("scale", "floatToInt"))
SUFFIXES = (("dict", "afl", "afl"), ("const", "afl"), ("rle", "afl", "afl"), ("afl",), ("patch", "afl", "afl"))
MAX_LEVEL, MAX_HEIGHT, SAMPLE, REPLAN, RUNS = 3, 5, 10_000, 10, 1.5


def static_plans() -> list[Plan]:
    out = []
    for prefix in PREFIXES:
        for suffix in SUFFIXES:
            plan = Plan(suffix[0], [Plan(n, [Plan("none")]) for n in suffix[1:]] or [Plan("none")])
            for name in reversed(prefix):
                plan = Plan(name, [plan])
            out.append(plan)
    return out


def best_static(x: np.ndarray, d: DType) -> tuple[Plan, int]:
    """The static plan of the smallest predicted size, the first of equals; `none` if none is smaller than that."""
    best = (Plan("none"), predicted_size(Plan("none"), x, d))
    for plan in static_plans():
        plan = plan.fixed(d)
        size = predicted_size(plan, x, d)
        if size < best[1]:
            best = (plan, size)
    return best


@dataclass(frozen=True)
class Stats:
    size: int
    low: float
    high: float
    ordered: bool
    runs: float  # mean number of equal values from each on, of the next `window`


def run_metric(x: np.ndarray, window: int = 2) -> float:
    """Mean over i < n - window of how many values from i on equal x[i], counting at most window; 1 for few values."""
    n, v = len(x), bit_view(x)
    if window >= n:
        return 1.0
    total, same = np.ones(n - window), np.ones(n - window, bool)
    for k in range(1, window):
        same &= v[k : k + n - window] == v[: n - window]
        total += same
    return float(total.mean())


def statistics(x: np.ndarray) -> Stats:
    if not len(x):
        return Stats(0, 0, 0, True, 1.0)
    with np.errstate(invalid="ignore"):
        return Stats(len(x), float(x.min()), float(x.max()), not bool((x[:-1] > x[1:]).any()), run_metric(x))


def continuations(parent: str, d: DType, s: Stats, level: int) -> list[str]:
    """What may follow an encoding, in order."""
    if level and (parent == "none" or s.size <= 0):
        return []
    out = ["none"]
    if parent in ("afl", "gfc"):
        return out
    if level < MAX_LEVEL:
        out += ["delta"] * (parent != "delta")
        out += ["scale"] * (parent != "scale" and s.low != 0)
        out += ["floatToInt"] * (parent != "floatToInt" and d.name == "float")
        if parent not in ("patch", "dict"):
            out += ["patch", "dict"]
        if s.ordered or s.runs >= RUNS:
            out += ["const"] * (parent != "const") + ["rle"] * (parent != "rle")
    return [*out, "gfc" if d.is_float else "afl"]


@dataclass
class Candidate:
    plan: Plan
    size: int


def search(x: np.ndarray, d: DType, parent: str = "none", level: int = 0, seen: list[Candidate] | None = None) -> Candidate:
    """The smallest plan within the rules. Sizes add up over children, so each child's best makes the best whole
    and no product of subtrees is needed. seen: gets every candidate of this level."""
    best: Candidate | None = None
    for name in continuations(parent, d, statistics(x), level):
        codec = CODECS[name]
        if name == "none":
            found = Candidate(Plan("none"), HEADER.size + 8 + x.nbytes)
        else:
            encoded, children, size = codec.encode(x, d), [], HEADER.size
            size += len(encoded.meta)
            for out, kind in zip(encoded.outputs, codec.outputs(d), strict=True):
                child = search(out, kind, name, level + 1) if len(out) else Candidate(Plan("none"), HEADER.size + 8)
                children.append(child.plan)
                size += child.size
            found = Candidate(Plan(name, children), size)
        found.plan.ratio = ratio(x.nbytes, found.size)
        if seen is not None:
            seen.append(found)
        if best is None or found.size < best.size:
            best = found
    return best


def smallest(candidates: Iterable[Candidate], before: int) -> Candidate:
    """By the clamped ratio; the first of equals, so `none` where nothing is smaller."""
    return max(candidates, key=lambda c: ratio(before, c.size))


class EdgeStats:
    """Learned ratios: per edge slot, of (parent, child)."""

    def __init__(self, height: int = MAX_HEIGHT):
        self.height = height
        self.slots: list[dict[tuple[str, str], float]] = [{} for _ in range(2 ** (height + 1) - 2)]

    def update(self, slot: int, kind: tuple[str, str], value: float) -> None:
        self.slots[slot][kind] = (max(self.get(slot, kind), 1.0) + max(value, 1.0)) / 2

    def set(self, slot: int, kind: tuple[str, str], value: float) -> None:
        self.slots[slot][kind] = value

    def get(self, slot: int, kind: tuple[str, str]) -> float:
        return self.slots[slot].get(kind, 0.0)

    def any(self, slot: int) -> tuple[tuple[str, str], float] | None:
        return next(iter(sorted(self.slots[slot].items())), None)

    def best(self, slot: int, kind: tuple[str, str], same_parent: bool = False) -> tuple[tuple[str, str], float]:
        """The largest ratio over 1 with another child; ('parent', 'none') at 1 if there is none."""
        found = (kind[0], "none"), 1.0
        for other, value in sorted(self.slots[slot].items()):
            if other[1] != kind[1] and value > found[1] and not (same_parent and other[0] != kind[0]):
                found = other, value
        return found

    def learn(self, plan: Plan) -> None:
        for e in plan.edges():
            if e.slot < len(self.slots):
                self.update(e.slot, e.type, (e.parent.ratio + e.child.ratio) / 2)

    def copy(self) -> EdgeStats:
        out = EdgeStats(self.height)
        out.slots = [dict(s) for s in self.slots]
        return out

    def rows(self) -> list[tuple[int, str, str, float]]:
        return [(i, *k, v) for i, s in enumerate(self.slots) for k, v in sorted(s.items())]

    def __str__(self) -> str:
        return "\n".join(f"[{i}] {a} - {b}: {v:.4f}" for i, a, b, v in self.rows())


def _grow(name: str, stats: EdgeStats, first: int) -> Plan:
    """A node, filled below with the best learned edges. first: the slot of its first edge."""
    plan = Plan(name)
    if first + 1 >= len(stats.slots):
        return plan
    for i in range(len(CODECS[name].outputs(DTYPES["int"]))):
        (_, child), value = stats.best(first + i, (name, name), same_parent=True)
        plan.children.append(_grow(child, stats, 2 * (first + i) + 2) if value > 1 else Plan("none"))
    return plan


@dataclass
class OptimalTree:
    """A plan with the ratio and the edge ratios it had when it was last accepted."""

    plan: Plan
    ratio: float
    before: EdgeStats

    def correct(self, new_ratio: float, now: EdgeStats) -> bool:
        """After a part: if the ratio fell (or was none to begin with), the first edge, by slot, that does worse than
        before or worse than a learned alternative is replaced: its child, if another child of the same parent did
        better, else the parent. What hangs below comes from the best learned edges. True if the plan changed."""
        if self.ratio <= new_ratio and self.ratio > 1:
            return False
        for e in self.plan.edges():
            value = now.get(e.slot, e.type)
            other, other_value = now.best(e.slot, e.type)
            if not (value < self.before.get(e.slot, e.type) or other_value > value):
                continue
            (_, child), same_value = now.best(e.slot, e.type, same_parent=True)
            if same_value > value:
                new, old = _grow(child, now, 2 * (e.slot + 1)), e.child
            else:
                new, old = _grow(other[0], now, e.slot - e.slot % 2), e.parent
            self.plan = self.plan.replace(old, new)
            self.ratio, self.before = new_ratio, now.copy()
            return True
        return False


@dataclass
class Adaptive:
    """Compresses a column part by part: a full search on the first part and then before every tenth, on a sample
    from the start of the part; corrections by learned edges in between. A part that the carried plan does not make
    smaller is searched too and the smaller result kept; none takes more than under `none`."""

    dtype: DType
    replan: int = REPLAN
    sample: int = SAMPLE
    done: int = 0
    tree: OptimalTree | None = None
    stats: EdgeStats = field(default_factory=EdgeStats)

    def _search(self, x: np.ndarray) -> OptimalTree:
        head, seen = x[: self.sample], []
        search(head, self.dtype, seen=seen)
        for c in seen:
            self.stats.learn(c.plan.fixed(self.dtype))
        best = smallest(seen, head.nbytes)
        return OptimalTree(best.plan.fixed(self.dtype), best.plan.ratio, self.stats.copy())

    def _compress(self, tree: OptimalTree, x: np.ndarray) -> tuple[bytes, Plan]:
        plan = tree.plan.fixed(self.dtype)
        data = compress(plan, x, self.dtype)
        self.stats.learn(plan)
        return data, plan

    def part(self, x: np.ndarray) -> tuple[bytes, Plan]:
        fresh = self.tree is None or self.done % self.replan == self.replan - 1
        if fresh:
            self.tree = self._search(x)
        data, plan = self._compress(self.tree, x)
        if not fresh and plan.name != "none" and len(data) > x.nbytes:
            other = self._search(x)
            again = self._compress(other, x)
            if len(again[0]) < len(data):
                self.tree, (data, plan) = other, again
        self.done += 1
        self.tree.plan = plan
        self.tree.correct(plan.ratio, self.stats)
        if len(data) > HEADER.size + 8 + x.nbytes:  # the sample's plan does not suit the rest of the part
            plan = Plan("none")
            data = compress(plan, x, self.dtype)
        return data, plan

    def parts(self, xs: Iterable[np.ndarray]) -> Iterator[tuple[bytes, Plan]]:
        for x in xs:
            yield self.part(x)


def independent(x: np.ndarray, d: DType) -> tuple[bytes, Plan]:
    """A part planned alone, from a sample of its start."""
    seen: list[Candidate] = []
    search(x[:SAMPLE], d, seen=seen)
    plan = smallest(seen, x[:SAMPLE].nbytes).plan.fixed(d)
    return compress(plan, x, d), plan
