"""Items of varying size are packed into containers of fixed capacity.

Whole containers are cut off items above the capacity first. Items then go, by hash, to groups of a
bounded size, however skewed their sizes or sources are. In each group they are placed as they come,
each into the last bin or a new one, and a local search exchanges one item for one, two for one, or
moves items between underfull bins wherever that increases the sum of squared fills, emptying bins,
until no two bins of the group have such an exchange left. What stands in
bins still underfull after a round, and in some full ones, is packed again with that of the other
groups in the next, from a best fit and with the same search; after the last, exchanges between bins
of different groups may be left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signloom.plans.durable import cut

GROUP_ITEMS = 20_000
FULL = 0.998
#: One in so many of the full bins is packed again with the underfull ones, for these to have something to exchange with.
MATERIAL = 8


#: Tasks of a round at most.
ROUND_TASKS = 1 << 16


def next_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices: each item goes into the last bin, or a new one where that has no room. The search does the rest."""
    bins: list[list[int]] = []
    room = 0
    for i, size in enumerate(sizes):
        if size > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= size
    return bins


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices; the largest item first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            room, b = capacity - sizes[i], len(bins) - 1
        else:
            room, b = rooms.pop(at)
            room -= sizes[i]
            bins[b].append(i)
        if room:
            insort(rooms, (room, b))
    return bins


class _Rooms:
    """Underfull bins by what they hold and admit: an item of size ``c`` in a bin with room ``r`` can go for one of up to ``u = c + r``.

    ``most[c]`` is the largest ``u`` over all bins that hold a ``c``, ``least[u]`` the smallest ``c`` that
    a ``u`` can go for; 0 stands for nothing taken back. Entries of an earlier state of a bin are dropped when met.
    """

    def __init__(self, capacity: int) -> None:
        self.none = capacity + 1
        self.most = np.full(2 * capacity + 2, -1, np.int64)
        self.least = np.full(2 * capacity + 2, self.none, np.int64)
        self.by_size: dict[int, list[tuple[int, int, int]]] = {}
        self.by_reach: dict[int, list[tuple[int, int, int]]] = {}
        self.state: dict[int, int] = {}

    def _top(self, heap: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
        while heap and self.state[heap[0][1]] != heap[0][2]:
            heappop(heap)
        return heap[0] if heap else None

    def _renew(self, held: set[int], room: int) -> None:
        for c in held:
            top = self._top(self.by_size[c])
            self.most[c] = -top[0] if top else -1
            top = self._top(self.by_reach[c + room])
            self.least[c + room] = top[0] if top else self.none

    def add(self, b: int, held: set[int], room: int) -> None:
        self.state[b] = self.state.get(b, 0) + 1
        for c in held:
            heappush(self.by_size.setdefault(c, []), (-c - room, b, self.state[b]))
            heappush(self.by_reach.setdefault(c + room, []), (c, b, self.state[b]))
        self._renew(held, room)

    def remove(self, b: int, held: set[int], room: int) -> None:
        self.state[b] += 1
        self._renew(held, room)

    def exchange(self, offers: np.ndarray, room: int) -> tuple[int, int, int] | None:
        """(offer, size taken back, other bin) of the exchange that leaves the least room in one of the two bins, or none.

        For an offer ``s`` of a bin that admits up to ``v = s + room`` in its place, the exchange makes the
        fuller bin fuller where ``c < s <= u < v`` (the other bin gains) or ``s < c <= v < u`` (this one does).
        """
        best = None
        step = max(1, 1_000_000 // len(offers))
        for near in range(0, room, step):  # new rooms in growing order, so the first that is found is the best
            left = np.arange(near, min(room, near + step))
            gains = self.least[offers[:, None] + left] < offers[:, None]
            keeps = self.most[offers[:, None] + room - left] > offers[:, None] + room
            found = np.flatnonzero((gains | keeps).any(axis=0))
            if len(found):
                k = int(found[0])
                at = int(np.flatnonzero(gains[:, k] | keeps[:, k])[-1])
                s = int(offers[at])
                if gains[at, k]:
                    c, b, _ = self._top(self.by_reach[s + near + k])
                else:
                    c = s + room - near - k
                    _, b, _ = self._top(self.by_size[c])
                best = s, c, b
                break
        return best


def swap_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Improve ``bins`` until no exchange between any two of them makes the fuller one fuller still.

    An exchange gives one item or two and takes back one or none; any bin with room takes part, with all
    of its items, and what leaves the least room goes first. Fills differ by whole tokens and their squares only grow,
    so the search ends: with a pass over all bins that finds nothing.
    """
    held = {n: b for n, b in enumerate(bins) if sum(sizes[i] for i in b) < capacity}
    rooms = {n: capacity - sum(sizes[i] for i in b) for n, b in held.items()}
    index = _Rooms(capacity)
    kinds = lambda n: {0, *(sizes[i] for i in held[n])}
    for n in held:
        index.add(n, kinds(n), rooms[n])
    done = {n: b for n, b in enumerate(bins) if n not in held}
    changed = True
    while changed:
        changed = False
        for n in sorted(held, key=lambda n: (-rooms[n], n)):
            if n not in held:
                continue
            index.remove(n, kinds(n), rooms[n])
            while held[n] and rooms[n] and (found := index.exchange(_offers([sizes[i] for i in held[n]]), rooms[n])):
                s, c, other = found
                index.remove(other, kinds(other), rooms[other])
                give = _items(held[n], sizes, s)
                take = _items(held[other], sizes, c)
                held[n] = [i for i in held[n] if i not in give] + take
                held[other] = [i for i in held[other] if i not in take] + give
                rooms[n] += s - c
                rooms[other] -= s - c
                changed = True
                if held[other] and rooms[other]:
                    index.add(other, kinds(other), rooms[other])
                else:
                    done[other] = held.pop(other)
            if held[n] and rooms[n]:
                index.add(n, kinds(n), rooms[n])
            else:
                done[n] = held.pop(n)
    return [b for _, b in sorted((done | held).items()) if b]


def _offers(sizes: list[int]) -> np.ndarray:
    """All sums of none, one or two of ``sizes``."""
    own = np.unique(sizes)
    twice = [s for s, n in Counter(sizes).items() if n > 1]
    pairs = (own[:, None] + own)[np.triu_indices(len(own), 1)]
    return np.unique(np.concatenate([[0], own, pairs, np.array(twice, np.int64) * 2]))


def _items(held: list[int], sizes: list[int], size: int) -> list[int]:
    """None, one or two of the items ``held`` that come to ``size``."""
    if not size:
        return []
    of: dict[int, int] = {}
    for i in held:
        if sizes[i] == size:
            return [i]
    for i in held:
        if size - sizes[i] in of:
            return [of[size - sizes[i]], i]
        of[sizes[i]] = i
    raise ValueError(size)


def _round(items: DataFrame, capacity: int, number: int, groups: int, first: Callable[[list[int], int], list[list[int]]]) -> DataFrame:
    """``items`` (``key, uid, start, size``) with ``bin``, a string of round, group and number within it, and its ``fill``."""
    schema = T.StructType([*items.schema.fields, T.StructField("bin", T.StringType()), T.StructField("fill", T.IntegerType())])

    names = schema.names

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def emit() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.sort_by([("uid", "ascending"), ("start", "ascending")])  # the same bins however rows arrive
            sizes = table["size"].to_pylist()
            bins = swap_search(first(sizes, capacity), sizes, capacity)
            of, fill = [0] * len(sizes), [0] * len(sizes)
            for n, b in enumerate(bins):
                total = sum(sizes[i] for i in b)
                for i in b:
                    of[i], fill[i] = n, total
            columns = [table[c].combine_chunks() for c in table.column_names if c != "group"]
            added = [pa.array([f"{number}-{group}-{n}" for n in of]), pa.array(fill, pa.int32())]
            return pa.RecordBatch.from_arrays(columns + added, names=names)

        for batch in batches:
            labels = batch.column("group").to_pylist()
            start = 0
            for i in range(1, len(labels) + 1):
                if i == len(labels) or labels[i] != labels[start]:
                    if labels[start] != group:
                        if held:
                            yield emit()
                        group, held = labels[start], []
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield emit()

    grouped = items.withColumn("group", F.expr(f"cast(pmod(xxhash64(uid, start, {number}), {groups}) as int)"))
    return grouped.repartition(min(groups, ROUND_TASKS), "group").sortWithinPartitions("group").mapInArrow(pack, schema)


def pack(items: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS, rounds: int = 3, first: Callable[[list[int], int], list[list[int]]] = next_fit) -> DataFrame:
    """Rows ``bin, key, start, size``: every token of every item placed once.

    Items of null or no size are left out. An item above ``capacity`` is split into whole containers and
    a rest, at ``start``; no other is. Rows that repeat a key are items of their own. An empty
    table gives no bins. Other columns are left out. ``first`` places the items that the search begins with in
    the first round.
    """
    sized = items.select(F.col(key).alias("key"), F.col(size).cast("int").alias("whole")).filter("whole > 0")
    pieces = F.expr(f"transform(sequence(0, cast((whole - 1) div {capacity} as int)), i -> struct(i * {capacity} as start, least({capacity}, whole - i * {capacity}) as size))")
    cuts = cut(sized.select("key", F.monotonically_increasing_id().alias("uid"), F.explode(pieces).alias("p")).select("key", "uid", F.col("p.start").cast("int").alias("start"), F.col("p.size").cast("int").alias("size")))
    done = [cuts.filter(F.col("size") == capacity).select(F.concat_ws("-", F.lit("full"), "uid", "start").alias("bin"), "key", "start", "size")]
    left = cuts.filter(F.col("size") < capacity)
    for number in range(1, rounds + 1):
        n = left.count()
        if not n:
            break
        groups = -(-n // group_items)
        placed = cut(_round(left, capacity, number, groups, first if number == 1 else best_fit))
        last = number == rounds or placed.filter(F.col("fill") < capacity).select("bin").distinct().count() < 2
        again = F.lit(False) if last else (F.col("fill") < FULL * capacity) | (F.pmod(F.xxhash64("bin"), F.lit(MATERIAL)) == 0)
        done.append(placed.filter(~again).select("bin", "key", "start", "size"))
        if last:
            break
        left = placed.filter(again).select("key", "uid", "start", "size")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.withColumnRenamed("key", key)  # items are numbered, so repeated rows stay apart
