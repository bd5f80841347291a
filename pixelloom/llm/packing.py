"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are encoded and cut into pieces of at most ``capacity`` ids; only documents longer than that are cut. Pieces
are dealt by hash into groups of about ``GROUP``; a group is one packing problem that ``ISLANDS`` islands solve at the
same time with different seeds. An individual is a list of bins. Crossover injects a run of well-filled bins of one
parent into the other, removes the bins there that hold a piece twice, and best-fits the displaced pieces, longest
first; mutation dissolves some of the emptiest bins. After each round an island's elite moves on to the next
island of its group (a shuffle of small rows). The best individual of all islands wins.

Bins that a group leaves less than ``GOOD`` full are dissolved, and their pieces packed again with those of other groups,
level by level, until one group is left or a level saves no bin (then the level before stands). A group holds some ``FILL``
capacities at least, so that pieces of a few ids fill most of its bins. An island stops where its bins are as few as its ids allow.

Edge cases: null and empty texts are the end id alone; repeated rows, and rows without doc_id, are pieces of their own; texts of any length
are cut into pieces; ties are broken by place; other columns are ignored; an empty table gives no rows. ``generations`` says how many
generations the islands of a piece's group ran in its last level: 0 where best fit met the bound.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, saved
from .tokens import PART, encoder, parts, spread

CAPACITY = 4096
END = 1
GROUP = 2048
FILL = 8
ISLANDS = 3
ROUNDS = 2
GENERATIONS = 6
POPULATION = 6
GOOD = 0.98

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, cut: str = "words") -> DataFrame:
    """A row for each piece of each document: where it starts, how long it is, and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = encoder(vocabulary, cut).column
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for part in parts(batches, 1, PART // 2):
            ids, cuts = column(part.column(1))
            raw, last = memoryview(ids.astype("<u4")).cast("B"), np.array([end], "<u4").tobytes()
            # a document's ids and its end, in pieces of at most capacity
            size = np.diff(cuts) + 1
            many = -(-size // capacity)
            row = np.repeat(np.arange(part.num_rows), many)
            number = spread(np.zeros(part.num_rows, np.int64), many)
            start = number * capacity
            length = np.minimum(size[row] - start, capacity)
            first = cuts[row] + start
            # the last piece has the end, which isn't among the ids
            final = number == many[row] - 1
            crc = [zlib.crc32(last, zlib.crc32(raw[4 * a : 4 * (a + n - 1)])) if f else zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n, f in zip(first.tolist(), length.tolist(), final.tolist(), strict=True)]
            columns = [part.column(0).take(pa.array(row)), number.astype(np.int32), start, length, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped(run, PIECES, "tokens"))


# -- one island ------------------------------------------------------------------------------------------------


class Packing:
    """Bins as sets of item numbers with their free space."""

    __slots__ = ("bins", "free")

    def __init__(self, bins: list[list[int]], free: list[int]) -> None:
        self.bins, self.free = bins, free

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first; of as many, the ones that are filled most unevenly."""
        return len(self.bins), -sum((capacity - f) ** 2 for f in self.free)


def best_fit(lengths: Sequence[int], order: Sequence[int], capacity: int, bins: list[list[int]] | None = None, free: list[int] | None = None) -> Packing:
    """Puts items in the fullest bin that still takes them, or in a new one."""
    bins = [list(b) for b in bins] if bins else []
    free = list(free) if free else []
    open_ = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for i in order:
        n = lengths[i]
        at = bisect_left(open_, (n, -1))
        if at == len(open_):
            b = len(bins)
            bins.append([i])
            free.append(capacity - n)
        else:
            _, b = open_.pop(at)
            bins[b].append(i)
            free[b] -= n
        if free[b] > 0:
            insort(open_, (free[b], b))
    return Packing(bins, free)


def crossover(a: Packing, b: Packing, lengths: Sequence[int], capacity: int, rng: random.Random) -> Packing:
    """a, with a run of b's well-filled bins injected whole."""
    ranked = sorted(range(len(b.bins)), key=b.free.__getitem__)
    good = ranked[: max(1, len(ranked) * 2 // 3)]
    size = rng.randint(1, max(1, len(good) // 2))
    at = rng.randrange(len(good) - size + 1)
    chosen = good[at : at + size]
    inside = {i for k in chosen for i in b.bins[k]}
    bins, free = [b.bins[k] for k in chosen], [b.free[k] for k in chosen]
    displaced: list[int] = []
    for own, f in zip(a.bins, a.free, strict=True):
        if inside.isdisjoint(own):
            bins.append(own)
            free.append(f)
        else:
            displaced += [i for i in own if i not in inside]
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(lengths, displaced, capacity, bins, free)


def mutate(p: Packing, lengths: Sequence[int], capacity: int, rng: random.Random) -> Packing:
    """Dissolves some of the emptiest bins and a few others, and best-fits their items."""
    ranked = sorted(range(len(p.bins)), key=lambda k: -p.free[k])
    gone = set(ranked[: rng.randint(1, 3)]) | {rng.randrange(len(p.bins)) for _ in range(min(3, len(p.bins)))}
    loose = sorted((i for k in gone for i in p.bins[k]), key=lambda i: (-lengths[i], i))
    keep = [k for k in range(len(p.bins)) if k not in gone]
    return best_fit(lengths, loose, capacity, [p.bins[k] for k in keep], [p.free[k] for k in keep])


def from_assignment(assigned: Sequence[int], lengths: Sequence[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(assigned, default=-1) + 1)]
    for i, b in enumerate(assigned):
        bins[b].append(i)
    return Packing(bins, [capacity - sum(lengths[i] for i in b) for b in bins])


def assignment(p: Packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(p.bins):
        for i in items:
            out[i] = b
    return out


def evolve(lengths: Sequence[int], capacity: int, seed: int, migrants: Sequence[Sequence[int]] = (), generations: int = GENERATIONS, population: int = POPULATION) -> tuple[Packing, int]:
    """One island's round: the best individual it has found, and how many generations it ran. It stops at the lower bound of bins."""
    rng = random.Random(seed)
    n = len(lengths)
    order = sorted(range(n), key=lambda i: (-lengths[i], i))
    least = -(-sum(lengths) // capacity)
    score = lambda p: p.fitness(capacity)
    people = [from_assignment(m, lengths, capacity) for m in migrants] or [best_fit(lengths, order, capacity)]
    if min(len(p.bins) for p in people) <= least or n < 2:
        return min(people, key=score), 0
    while len(people) < population:
        noisy = sorted(range(n), key=lambda i: -lengths[i] * rng.uniform(0.8, 1.2))
        people.append(best_fit(lengths, noisy, capacity))
    ran = 0
    while ran < generations:
        people.sort(key=score)
        if len(people[0].bins) <= least:
            break
        ran += 1
        young = []
        for _ in range(population // 2):
            a, b = (min(rng.sample(people, 2), key=score) for _ in range(2))
            young.append(mutate(crossover(a, b, lengths, capacity, rng), lengths, capacity, rng))
        people = sorted(people + young, key=score)[:population]
    return min(people, key=score), ran


# -- islands on Spark ------------------------------------------------------------------------------------------

STATE = "group long, island int, found array<int>, bins long, fill double, generations int"


def _round(islands: DataFrame, capacity: int, number: int, seed: int) -> DataFrame:
    """islands: group, island, lengths, migrants (assignments), generations so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.int32()]
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                p, ran = evolve(row["lengths"], capacity, hash((seed, row["group"], row["island"], number)), row["migrants"])
                bins, fill = p.fitness(capacity)
                values = [row["group"], row["island"], assignment(p, len(row["lengths"])), bins, float(fill), row["generations"] + ran]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in STATE.split(", ")])

    return islands.select("group", "island", "lengths", "migrants", "generations").transform(mapped(run, STATE))


def _level(items: DataFrame, groups: int, capacity: int, level: int, seed: int) -> DataFrame:
    """items (row, length) with group, bin, offset, the fill of their bin, and their group's generations."""
    dealt = items.withColumn("group", F.pmod(F.xxhash64(F.lit(seed + level), "row"), F.lit(groups)))
    listed = dealt.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("length", "row")), asc=False).alias("items"))
    listed = saved(listed.withColumn("lengths", F.transform("items", lambda x: x["length"].cast("int"))), "pack-groups")
    base = listed.select("group", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = _round(base.withColumns({"migrants": F.array().cast("array<array<int>>"), "generations": F.lit(0)}).repartition("group", "island"), capacity, 0, seed)
    for r in range(1, ROUNDS):
        # each island goes on from its own elite and the elite of the island before it
        elite = F.struct("bins", "fill", "found").alias("elite")
        moved = state.select("group", F.inline(F.array(F.struct(F.col("island").alias("island"), F.col("generations").alias("generations")), F.struct(((F.col("island") + 1) % ISLANDS).alias("island"), F.lit(0).alias("generations")))), elite)
        arrived = moved.groupBy("group", "island").agg(F.transform(F.sort_array(F.collect_list("elite")), lambda e: e["found"]).alias("migrants"), F.sum("generations").cast("int").alias("generations"))
        state = _round(base.join(arrived, ["group", "island"]), capacity, r, seed)
    best = state.groupBy("group").agg(F.min_by("found", F.struct("bins", "fill", "island")).alias("found"), F.sum("generations").alias("generations"))
    rows = listed.join(best, "group").select("group", "generations", F.posexplode(F.arrays_zip("items", "found")).alias("at", "x"))
    flat = rows.select("group", "generations", "at", F.col("x.items.*"), F.col("x.found").alias("bin"))
    # bins hold capacity ids at most, each item one at least: these windows are bounded
    own = Window.partitionBy("group", "bin")
    flat = flat.withColumn("fill", F.sum("length").over(own))
    return flat.withColumn("offset", F.sum("length").over(own.orderBy("at")) - F.col("length"))


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = 5) -> DataFrame:
    """items: row (unique), length (1 to capacity). row, sequence_id, offset and generations of every item."""
    left, done, level, held = items.select("row", "length"), [], 0, None
    while True:
        size = left.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("ids")).first()
        groups = max(1, min(-(-size.n // group), size.ids // (FILL * capacity)))
        placed = saved(_level(left, groups, capacity, level, seed), "pack-level")
        placed = placed.withColumn("sequence_id", (F.lit(level) * (1 << 58) + F.col("group") * (1 << 24) + F.col("bin")).cast("long"))
        if held is not None and placed.select("sequence_id").distinct().count() >= held.select("sequence_id").distinct().count():
            done.append(held)  # this level saves nothing
            break
        loose = placed.where(F.col("fill") < GOOD * capacity)
        if groups == 1 or loose.isEmpty():
            done.append(placed)
            break
        done.append(placed.where(F.col("fill") >= GOOD * capacity))
        held, left = loose, loose.select("row", "length")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("row", "sequence_id", "offset", "generations")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, generations of every piece of every document."""
    cut = saved(pieces(docs, vocabulary, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    places = pack(cut, capacity)
    return cut.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "generations")
