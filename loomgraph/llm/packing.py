"""Problem 8: filling fixed-capacity containers, by bin completion.

Texts are spread at random over groups of bounded size; each group is packed by branch
and bound. Best-fit decreasing is the first incumbent; where it uses more containers
than a lower bound proves necessary, the containers with the most room are opened and
their texts packed again into one container less: the largest text left opens a
container, its undominated fillings are tried fullest first, and a branch ends when its
waste exceeds what the goal leaves. Every success is the next incumbent; the set that
is opened grows up to the whole group.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.tokens import VOCABULARY, token_counts
from loomgraph.plans.runtime import ship

CAPACITY = 2048
#: Texts of a group (on average) and steps of its search (items put into a filling); then the incumbent stands.
GROUP, STEPS = 3000, 1_000_000
#: Items that are tried as the largest, or as the next, of a filling, and fillings without room after which a node tries no more.
WIDTH, EXACT = 24, 4
#: Containers opened at first, and the factor by which their number grows after a failure.
OPENED, GROWTH = 8, 1.6


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the items of each container."""
    rooms: list[tuple[int, int]] = []  # (room, container), sorted
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        s = sizes[i]
        at = bisect_right(rooms, (s - 1, sys.maxsize))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k = cap, len(bins)
            bins.append([])
        bins[k].append(i)
        insort(rooms, (room - s, k))
    return bins


class _Stock:
    """Sizes left, with counts and a sorted list of the distinct ones."""

    def __init__(self, sizes: list[int]):
        self.n: dict[int, int] = {}
        for s in sizes:
            self.n[s] = self.n.get(s, 0) + 1
        self.order = sorted(self.n)
        self.total = sum(sizes)

    def take(self, s: int) -> None:
        self.n[s] -= 1
        self.total -= s
        if not self.n[s]:
            del self.n[s]
            del self.order[bisect_right(self.order, s) - 1]

    def put(self, s: int) -> None:
        if s not in self.n:
            insort(self.order, s)
            self.n[s] = 0
        self.n[s] += 1
        self.total += s

    def below(self, room: int, used: tuple[int, ...] = ()) -> int:
        """The largest size up to ``room`` that is still there besides ``used``; 0 if none."""
        at = bisect_right(self.order, room) - 1
        while at >= 0 and self.n[self.order[at]] <= used.count(self.order[at]):
            at -= 1
        return self.order[at] if at >= 0 else 0


def dominates(b: tuple[int, ...], a: tuple[int, ...]) -> bool:
    """Whether best-fit packs the items of ``a`` into containers of the sizes of ``b``: then ``b`` is never the worse filling."""
    rooms = sorted(b)
    for x in sorted(a, reverse=True):
        k = bisect_left(rooms, x)
        if k == len(rooms):
            return False
        insort(rooms, rooms.pop(k) - x)
    return True


def fillings(stock: _Stock, room: int, width: int = WIDTH) -> tuple[list[tuple[int, ...]], int]:
    """(undominated fillings of ``room``, fullest first; items put in to find them).

    Tried are the ``width`` largest items that fit, alone or with each of the ``width``
    largest that fit beside them, completed greedily: all maximal fillings of one and
    two items within that width, and of more items those that begin so.
    """
    one = stock.below(room)
    if not one:
        return [()], 1
    if one == room:
        return [(one,)], 1  # dominates all
    found: set[tuple[int, ...]] = set()
    steps = exact = 0

    def finish(f: tuple[int, ...], left: int) -> None:
        nonlocal steps, exact
        while left > 0:
            b = stock.below(min(left, f[-1]), f)
            if not b:
                break
            f, left = (*f, b), left - b
        exact += left == 0 and f not in found
        steps += len(f)
        found.add(f)

    at = bisect_right(stock.order, room) - 1
    for a in stock.order[max(0, at - width + 1) : at + 1][::-1]:
        b, tried = stock.below(min(room - a, a), (a,)), 0
        if not b:
            finish((a,), 0 if a == room else room - a)
        while b and tried < width and exact < EXACT:
            finish((a, b), room - a - b)
            b, tried = stock.below(b - 1, (a,)), tried + 1
    out: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (-sum(f), len(f), tuple(-x for x in f))):
        if not any(dominates(g, f) for g in out[:width]):
            out.append(f)
    return out, steps + len(found)


def least_containers(sizes: list[int], cap: int) -> int:
    """Lower bound of the number of containers (Martello and Toth's L2), over all thresholds."""
    order = sorted(sizes)
    total = [0]
    for x in order:
        total.append(total[-1] + x)
    best, half = -(-total[-1] // cap), bisect_right(order, cap // 2)
    for k in {0, *order[:half]}:
        lo, hi = bisect_left(order, k), bisect_right(order, cap - k)
        middle = max(hi - half, 0)  # over half the capacity: one container each, with room for items of at least k
        room = middle * cap - (total[half + middle] - total[half])
        small = total[half] - total[min(lo, half)]
        best = max(best, len(order) - half + max(0, -(-(small - room) // cap)))
    return best


def search(sizes: list[int], cap: int, goal: int, budget: list[int]) -> list[list[int]] | None:
    """Containers (of sizes) of a packing into at most ``goal``, or None: none was found, or the budget of steps is spent."""
    total, stock = sum(sizes), _Stock(sizes)
    if least_containers(sizes, cap) > goal:
        return None
    done: list[tuple[int, ...]] = []
    # one frame per container: its fillings that are left to try, and the waste before it
    frames: list[list] = []

    def open_(waste: int) -> None:
        x = stock.order[-1]
        stock.take(x)
        found, steps = fillings(stock, cap - x)
        budget[0] -= steps
        frames.append([x, iter(found), waste, None])

    if not sizes:
        return []
    open_(0)
    while frames:
        frame = frames[-1]
        x, left, waste, f = frame
        if f is not None:  # take the last choice back
            done.pop()
            for y in f:
                stock.put(y)
            frame[3] = None
        f = next(left, None) if budget[0] > 0 else None
        if f is None:
            stock.put(x)
            frames.pop()
            continue
        budget[0] -= 1
        w = waste + cap - x - sum(f)
        if w > goal * cap - total or len(done) + 1 > goal:
            continue
        for y in f:
            stock.take(y)
        done.append((x, *f))
        frame[3] = f
        if not stock.order:
            return [list(c) for c in done]
        open_(w)
    return None


def complete(sizes: list[int], cap: int, steps: int = STEPS) -> list[list[int]]:
    """Indices of the items of each container; no more containers than best-fit decreasing needs, and fewer where the search finds them."""
    bins = best_fit(sizes, cap)
    bound, budget, opened = least_containers(sizes, cap), [steps], OPENED
    while len(bins) > bound and budget[0] > 0:
        bins.sort(key=lambda c: (sum(sizes[i] for i in c), c))  # those with the most room first
        items = [i for c in bins[:opened] for i in c]
        tried = [min(budget[0], max(steps // 20, 1))] if opened < len(bins) else budget
        before = tried[0]
        got = search([sizes[i] for i in items], cap, min(opened, len(bins)) - 1, tried)
        if tried is not budget:
            budget[0] -= max(before - tried[0], 1)
        if got is not None:
            by: dict[int, list[int]] = {}
            for i in sorted(items, reverse=True):
                by.setdefault(sizes[i], []).append(i)
            bins = [[by[x].pop() for x in c] for c in got] + bins[opened:]
        elif opened >= len(bins):
            break
        else:
            opened = int(opened * GROWTH) + 1
    return bins


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, group: int = GROUP, steps: int = STEPS) -> DataFrame:
    """(doc_id, text) -> (container_id, doc_id, piece_no, tok_start, tok_end).

    A text is divided only if it exceeds the capacity: into full containers and a rest
    that is packed with the others. Empty and NULL texts need no place; a doc_id
    counts once. Random groups leave at most one container of a group part empty for
    the grouping's sake. ``steps`` bounds the search of a group, not what is packed.
    """
    ship(docs.sparkSession)
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = token_counts(docs.where("doc_id is not null"), "doc_id", "text", vocabulary=vocabulary).dropDuplicates(["doc_id"]).where("tokens > 0").persist()
    groups = max(1, -(-sized.count() // group))
    rows = sized.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    schema = pa.schema([("container_id", pa.string()), ("doc_id", pa.int64()), ("piece_no", pa.int64()), ("tok_start", pa.int64()), ("tok_end", pa.int64())])

    def run(key, t):
        g = key[0].as_py()
        order = t.sort_by("doc_id")
        ids, sizes = order.column("doc_id").to_pylist(), order.column("tokens").to_pylist()
        out, items, own, n = [], [], [], 0
        for i, s in zip(ids, sizes):
            k = s // capacity if s > capacity else 0
            for p in range(k):
                out.append((f"{g}-{n}", i, p, p * capacity, (p + 1) * capacity))
                n += 1
            if s - k * capacity:
                items.append(s - k * capacity)
                own.append((i, k, k * capacity, s))
        for b in complete(items, capacity, steps):
            out += [(f"{g}-{n}", *own[j]) for j in b]
            n += 1
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return rows.select("g", "doc_id", "tokens").groupBy("g").applyInArrow(run, "container_id string, doc_id bigint, piece_no bigint, tok_start bigint, tok_end bigint")


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, texts, tokens, unused) of each container."""
    used = F.sum(F.col("tok_end") - F.col("tok_start"))
    return packed.groupBy("container_id").agg(F.count("*").alias("texts"), used.alias("tokens"), (F.lit(capacity) - used).alias("unused"))
