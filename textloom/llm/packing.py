"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Only the histogram (at most one entry for each length up to the capacity) reaches the driver. There lengths are
grouped into classes of ``GRAIN`` tokens, and the program "fewest sequences, each filled by a configuration of
classes, that cover all pieces" is solved by multiplicative weights: each round prices the classes by their
weights, a knapsack dynamic program finds the best configuration, and the weights of what it covers shrink. The
fractional solution is rounded to whole configurations, most used first, on exact lengths as far as pieces are left;
the rest goes by best fit, decreasing, into the room left over and then into new sequences. A few sequences too many
are saved by packing the least full ones anew, each by a knapsack on exact lengths. If the plan is still longer than best fit alone, more of the least full configurations are taken
apart and their pieces go by best fit, too, until it is not: a plan is never longer than best fit alone. Pieces of one length
are alike, so each is placed by its rank among them, which executors work out from counts by partition.

Null text is empty: its document is the end id alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import encoder, vocabulary
from textloom.llm.common import pick, text_slices
from textloom.session import Workspace, ship_package

CAPACITY, END_ID = 2048, 0
#: Tokens in a length class, rate of the weights, rounds at most, and times each class is to be covered.
GRAIN, RATE, ROUNDS, COVERS = 8, 0.25, 2500, 6.0
#: Shares of the sequences of configurations that a plan keeps, until it is no longer than best fit alone.
KEPT_SHARES = (0.9, 0.85, 0.8, 0.7, 0.6, 0.4, 0.2, 0.0)
#: Sequences too many that repacking tries to save, and batches of so many sequences with room that it takes apart for that.
MOST_SAVED, REPACKED, MOST_BATCHES = 16, 100, 40


def best_configuration(value: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Knapsack with at most most[k] of size k (k from 1): counts by size of the greatest total value."""
    parts = []
    for k in np.flatnonzero((most > 0) & (value > 0)):
        left, some = int(min(most[k], capacity // k)), 1
        while left > 0:
            some = min(some, left)
            parts.append((int(k), some))
            left, some = left - some, some * 2
    best = np.zeros(capacity + 1)
    took = np.zeros((len(parts), capacity + 1), bool)
    for i, (k, some) in enumerate(parts):
        size = k * some
        with_it = best[: capacity + 1 - size] + value[k] * some
        took[i, size:] = with_it > best[size:]
        best[size:] = np.maximum(best[size:], with_it)
    counts, room = np.zeros(len(value), np.int64), capacity
    for i in range(len(parts) - 1, -1, -1):
        if took[i, room]:
            counts[parts[i][0]] += parts[i][1]
            room -= parts[i][0] * parts[i][1]
    return counts, float(best[capacity])


def fractional_cover(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, so that every class is covered: multiplicative weights."""
    some = demand > 0
    if not some.any():
        return []
    need = np.where(some, demand, 1).astype(float)
    weight, covered = some.astype(float), np.zeros(len(demand))
    used: dict[bytes, list] = {}
    for _ in range(ROUNDS):
        counts, _ = best_configuration(weight / need, demand, capacity)
        share = counts / need
        step = 1 / share.max()
        used.setdefault(counts.tobytes(), [counts, 0.0])[1] += step
        covered += step * share
        weight *= np.exp(-RATE * step * share)
        weight /= weight.max()
        if covered[some].min() >= COVERS:
            break
    scale = max(1.0, float(covered[some].min()))
    return sorted(((c, x / scale) for c, x in used.values()), key=lambda p: (-p[1], p[0].tobytes()))


class Plan:
    """Where the r-th piece of each length goes. Groups: ``count`` sequences that hold the same lengths.

    ``by_program`` counts the pieces that configurations placed, other than full ones.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.groups, self.by_program = capacity, [], 0  # [lengths, count]
        left = {n: c for n, c in histogram.items() if c > 0}
        full = left.pop(capacity, 0)
        alone = Plan.__new__(Plan)
        alone.capacity, alone.groups = capacity, []
        alone._best_fit(sorted(left.items(), reverse=True))
        least = -(-sum(n * c for n, c in left.items()) // capacity)
        rounded = self._rounded(left)
        for share in KEPT_SHARES:
            self.groups = self._fullest(rounded, share)
            self.by_program = sum(len(lengths) * count for lengths, count in self.groups)
            rest = dict(left)
            for lengths, count in self.groups:
                for n in lengths:
                    rest[n] -= count
            self._best_fit(sorted(((n, c) for n, c in rest.items() if c), reverse=True))
            for target in (least, alone.sequences):
                if self.sequences > alone.sequences or target == least:
                    self._save(self.sequences - target)
            if self.sequences <= alone.sequences:
                break
        if full:
            self.groups.append([[capacity], full])

    def _rounded(self, histogram: dict[int, int]) -> list:
        """Whole configurations on exact lengths: each class but the least gives its longest piece, and what then has room is the longest that fits."""
        grain = min(GRAIN, self.capacity)
        slots = self.capacity // grain
        there = np.zeros(self.capacity + 1, np.int64)
        for n, c in histogram.items():
            there[n] = c
        demand = np.zeros(slots + 1, np.int64)
        for n, c in histogram.items():
            if -(-n // grain) <= slots:
                demand[-(-n // grain)] += c
        groups = []
        for counts, x in fractional_cover(demand, slots):
            classes = [int(k) for k in np.flatnonzero(counts)[::-1] for _ in range(counts[k])]
            times = int(x + 0.5)
            while times and (lengths := self._lengths(classes, there, grain)):
                each: dict[int, int] = {}
                for n in lengths:
                    each[n] = each.get(n, 0) + 1
                some = min(times, *(int(there[n] // k) for n, k in each.items()))
                for n, k in each.items():
                    there[n] -= some * k
                groups.append([lengths, some])
                times -= some
        return groups

    def _lengths(self, classes: list[int], there: np.ndarray, grain: int) -> list[int] | None:
        """Exact lengths for one sequence of a configuration, or None if a class has run out."""
        taken: dict[int, int] = {}
        lengths, room = [], self.capacity

        def longest(low: int, high: int) -> int:
            for n in np.flatnonzero(there[low : high + 1])[::-1] + low:
                if there[n] > taken.get(int(n), 0):
                    return int(n)
            return 0

        def take(n: int) -> int:
            lengths.append(n)
            taken[n] = taken.get(n, 0) + 1
            return room - n

        for k in classes[:-1] if len(classes) > 1 else classes:
            if not (n := longest((k - 1) * grain + 1, k * grain)):
                return None
            room = take(n)
        while room and (n := longest(1, room)):
            room = take(n)
        return lengths

    def _fullest(self, groups: list, share: float) -> list:
        """The fullest sequences of these groups, as many as ``share`` of all."""
        order = sorted(groups, key=lambda g: (-sum(g[0]), -min(g[0])))
        left, out = int(share * sum(c for _, c in groups)), []
        for lengths, count in order:
            if some := min(count, left):
                out.append([lengths, some])
                left -= some
        return out

    def _best_fit(self, rest: list[tuple[int, int]]) -> None:
        by_room: dict[int, list[int]] = {}
        rooms: list[int] = []

        def open_group(i: int) -> None:
            room = self.capacity - sum(self.groups[i][0])
            if room:
                if room not in by_room:
                    by_room[room] = []
                    insort(rooms, room)
                by_room[room].append(i)

        for i in range(len(self.groups)):
            open_group(i)
        for n, c in rest:
            while c:
                at = bisect_left(rooms, n)
                if at == len(rooms):
                    each = self.capacity // n
                    if c >= each:
                        self.groups.append([[n] * each, c // each])
                        c %= each
                    else:
                        self.groups.append([[n] * c, 1])
                        c = 0
                    open_group(len(self.groups) - 1)
                    continue
                room = rooms[at]
                i = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
                lengths, count = self.groups[i]
                some = min(c, count)
                if some < count:
                    self.groups.append([lengths, count - some])
                    open_group(len(self.groups) - 1)
                self.groups[i] = [[*lengths, n], some]
                open_group(i)
                c -= some

    def _save(self, many: int) -> None:
        """Save so many sequences by packing those with room anew, a batch at a time, each with some full ones of many pieces.

        The longest piece left goes with what a knapsack on exact lengths finds to fill its sequence, long pieces first.
        What a batch can't fill goes on to the next, so the room of all of them gathers.
        """
        if not 0 < many <= MOST_SAVED:
            return
        room = [self.capacity - sum(lengths) for lengths, _ in self.groups]
        opened = sorted((i for i, r in enumerate(room) if r), key=lambda i: -room[i])
        rich = sorted((i for i, r in enumerate(room) if not r), key=lambda i: -len(self.groups[i][0]))
        kept = [[list(lengths), count] for lengths, count in self.groups]
        value = np.arange(self.capacity + 1) * (1 + 1e-8 * np.arange(self.capacity + 1))
        pool, saved, made, open_ = np.zeros(self.capacity + 1, np.int64), 0, [], 0

        def take(order: list[int], most: int) -> int:
            """Put the pieces of up to ``most`` sequences into the pool."""
            size = 0
            while order and size < most:
                lengths, count = kept[order[0]]
                some = min(count, most - size)
                np.add.at(pool, lengths, some)
                kept[order[0]][1] -= some
                size += some
                if some == count:
                    order.pop(0)
            return size

        for _ in range(MOST_BATCHES):
            own = take(opened, REPACKED)
            open_ += own + take(rich, REPACKED // 2)
            new: list = []
            while pool.any():
                longest = int(np.flatnonzero(pool)[-1])
                pool[longest] -= 1
                counts, _ = best_configuration(value, pool, self.capacity - longest)
                pool -= counts
                new.append([[longest, *np.repeat(np.arange(len(counts)), counts).tolist()], 1])
            saved = open_ - len(new)
            if saved >= many or not own:
                made += new
                break
            for lengths, _ in new:
                if sum(lengths) == self.capacity:
                    made.append([lengths, 1])
                    open_ -= 1
                else:
                    np.add.at(pool, lengths, 1)
        if saved >= many:
            self.groups = [g for g in kept if g[1]] + made

    @property
    def sequences(self) -> int:
        return sum(c for _, c in self.groups)

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By (length, rank): key = length << 44 | first rank; then first sequence, offset of a group's slot."""
        rows, seen, first = [], {}, 0
        for lengths, count in self.groups:
            offset = 0
            for n in lengths:
                rows.append((n, seen.get(n, 0), first, offset))
                seen[n] = seen.get(n, 0) + count
                offset += n
            first += count
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 4)
        return a[:, 0] << 44 | a[:, 1], a[:, 1], a[:, 2], a[:, 3]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """A row for each piece; ``part`` and ``nth`` tell the partition and the place among its pieces of that length."""
    config = vocabulary(tokenizer_path)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(config, library=True), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, texts in text_slices(batch.column("text")):
                rows = []
                for doc, coded in zip(ids[a:b], coder.encode_all(texts), strict=True):
                    coded += end
                    for piece, start in enumerate(range(0, len(coded), 4 * capacity)):
                        own = coded[start : start + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, piece, start // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)

    return pick(docs, "doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    ship_package(spark)
    work = Workspace(spark, "packing")
    pieces = work.save(cut_pieces(docs, tokenizer_path, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = work.save(counts, "counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    tables = plan.lookup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, firsts, offsets = tables
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
                at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
                place = [pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *place], names=[*NAMES[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"{n} long" for n in [*NAMES[:5], "sequence_id", "offset"]))
