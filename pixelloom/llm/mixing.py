"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

1. Sizes (words) are summed by source. Targets share the mix by weight, stop at ``most`` times their source's size, and
   the excess is shared again by weight until none is above.
2. The mix is a number of blocks of ``block`` words (fewer for tiny sources, which share seats among those of their block size).
   Seats go to sources by highest quotients target / (2 s + 1), then, inside each source, to its shards by highest quotients
   size / (2 s + 1). A bisection on the divisor finds
   the same seats without handing them out one by one; ties go to the first in order.
3. A shard holds documents of one source by seeded hash. Its documents, in seeded order, make a line of words that is
   cut into blocks. Seats beyond the number of blocks are whole passes over the line; the rest are the first
   blocks of a seeded affine permutation of block numbers, so no block is drawn twice and none is sorted.

A large source has as many shards as its size asks for, so no group is unbounded. The driver holds one row a source
and a shard, of which a source has at most SHARDS. Documents without words take nothing. Repeated doc_ids are ordered by the row's text hash, and identical
rows are kept apart by their place on the line; null source is a source of its own, after all others. Texts of any length are counted whole;
equal quotients go to the first (ties); other columns travel in a struct, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2
BLOCK = 16
SHARD_WORDS = 1 << 18
#: Most shards of a source: a source of more words has larger shards, of rows without texts.
SHARDS = 1 << 14
SEED = 17


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """What each source gives, exactly: weighted shares, none above ``most`` times its size."""
    left, open_ = share * sum(sizes), [i for i, n in enumerate(sizes) if n]
    out = [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: Sequence[Fraction | int], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), ties to the first; no party gets more than its cap."""
    caps = list(caps) if caps is not None else [seats] * len(votes)
    seats = min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v))
    if seats <= 0:
        return [0] * len(votes)

    def at(divisor: Fraction) -> list[int]:
        # quotients v / (2 s + 1) that exceed the divisor
        return [min(c, max(0, math.ceil((Fraction(v) / divisor - 1) / 2))) if v else 0 for v, c in zip(votes, caps, strict=True)]

    high = Fraction(max(votes)) + 1
    low = high
    while sum(at(low)) < seats:
        low /= 4
    for _ in range(200):  # ends far sooner: distinct quotients differ
        mid = Fraction((low + high) / 2).limit_denominator(1 << 60)
        if not low < mid < high:
            break
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
        if sum(at(low)) - sum(at(high)) <= 4 * len(votes) and sum(at(high)) <= seats:
            break
    out = at(high)
    import heapq

    heap = [(-Fraction(v) / (2 * s + 1), i) for i, (v, s, c) in enumerate(zip(votes, out, caps, strict=True)) if v and s < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * out[i] + 1), i))
    return out


def coprime(n: int, seed: int) -> int:
    """A multiplier without a common factor with n, near n's golden section, moved by the seed."""
    a = max(1, int(n * 0.6180339887) + seed % 7)
    while math.gcd(a, n) != 1:
        a += 1
    return a % n if n > 1 else 0


def block_of(target: Fraction, block: int = BLOCK) -> int:
    """A source's block: ``block`` words, halved while its target is fewer than 64 blocks, so that a tiny source still gets its share
    to within about a hundredth, and no other source's blocks shrink for it."""
    while block > 1 and target < 64 * block:
        block //= 2
    return block


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def plan(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, and whatever else) with size, source_size, target, and the blocks that the mix takes: whole
    passes, and the chosen blocks of the document's stretch [at, at + size) of its shard's line.

    The input is written once to the shared folder with sizes, so that sizes aren't counted again.
    """
    spark = docs.sparkSession
    sized = saved(docs.withColumn("size", word_count(F.col("text"))).withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text")).drop("text"), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(per_source, key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [r.n for r in rows]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    blocks_of = [block_of(g, block) for g in goal]
    seats = [0] * len(rows)
    for size in set(blocks_of):
        # sources of one block size share that size's seats
        own = [i for i, b in enumerate(blocks_of) if b == size]
        won = sainte_lague([goal[i] for i in own], round(sum(goal[i] for i in own) / size), [MOST * -(-sizes[i] // size) for i in own])
        for i, n in zip(own, won, strict=True):
            seats[i] = n
    sources = spark.createDataFrame(
        [(i, r.source, int(n), float(g), b, max(1, min(SHARDS, -(-n // shard_words)))) for i, (r, n, g, b) in enumerate(zip(rows, sizes, goal, blocks_of, strict=True))],
        "source_no int, source string, source_size long, target double, block long, shards int",
    )
    # one row a source, as many as the driver has just held
    placed = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("_key", F.lit(seed)), F.col("shards")).cast("int"))
    in_shard = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("n")).collect()
    quota = []
    by_source: dict[int, list] = {}
    for r in sorted(in_shard):
        by_source.setdefault(r.source_no, []).append(r)
    for i, shards in by_source.items():
        blocks = [-(-r.n // blocks_of[i]) for r in shards]
        got = sainte_lague([r.n for r in shards], seats[i], [MOST * b for b in blocks])
        for r, b, q in zip(shards, blocks, got, strict=True):
            if b:
                k = coprime(b, seed + r.shard)
                passes, drawn = min(MOST, q // b), q % b if q < MOST * b else 0
                quota.append((i, r.shard, b, passes, drawn, pow(k, -1, b) if b > 1 else 0, (seed * 7919 + r.shard) % b))
    quotas = spark.createDataFrame(quota, "source_no int, shard int, blocks long, passes long, drawn long, inverse long, shift long")
    line = Window.partitionBy("source_no", "shard").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("at", F.coalesce(F.sum("size").over(line), F.lit(0).cast("long")))
    laid = laid.join(F.broadcast(quotas), ["source_no", "shard"], "left")
    first, last = F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block"))
    # block j is the k-th of the permutation k -> multiplier * k + shift, so its rank is inverse * (j - shift)
    chosen = F.when(
        (F.col("size") > 0) & (F.col("drawn") > 0),
        F.filter(F.sequence(first, last), lambda j: F.pmod(F.col("inverse") * (j - F.col("shift")), F.col("blocks")) < F.col("drawn")),
    ).otherwise(F.array().cast("array<bigint>"))
    return laid.withColumn("chosen", chosen)


def taken(planned: DataFrame) -> DataFrame:
    """Adds taken: words of whole passes and of the part of each chosen block that lies in the document."""
    end = F.col("at") + F.col("size")
    part = F.aggregate(
        "chosen",
        F.lit(0).cast("long"),
        lambda n, j: n + F.least((j + 1) * F.col("block"), end) - F.greatest(j * F.col("block"), F.col("at")),
    )
    return planned.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("passes", F.lit(0)) * F.col("size") + part).otherwise(F.lit(0)).cast("long"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return taken(plan(docs.select("doc_id", "text", "source"))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each document that it takes words of, its text the whole passes and then the words of
    each run of chosen blocks, as lines; other columns as they were, n_chars counted anew."""
    cols = docs.columns
    # other columns travel in one struct, so that their names can't clash with the plan's
    rest = F.struct(*[F.col(c) for c in cols if c != "text"]).alias("_rest")
    docs = docs.select("doc_id", "text", "source", rest)
    planned = taken(plan(docs))
    # the text comes back by the key of (doc_id, text); equal rows are equal texts, so one text a key is enough
    texts = docs.select(F.xxhash64(F.lit(SEED), "doc_id", "text").alias("_key"), "text").dropDuplicates(["_key"])
    joined = planned.where("taken > 0").join(texts, "_key")
    words = F.when(F.size("chosen") > 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    start = lambda j: F.greatest(j * F.col("block") - F.col("at"), F.lit(0))
    stop = lambda j: F.least((j + 1) * F.col("block") - F.col("at"), F.col("size"))
    cut = lambda w: F.transform("chosen", lambda j: F.array_join(F.slice(w, (start(j) + 1).cast("int"), (stop(j) - start(j)).cast("int")), " "))
    # the words are a lambda's argument, so that a text is split once and not for each of its blocks
    parts = F.get(F.transform(F.array(words), cut), F.lit(0))
    whole = F.array_repeat(F.col("text"), F.col("passes").cast("int"))
    out = joined.withColumn("text", F.array_join(F.concat(whole, F.when(F.size("chosen") > 0, parts).otherwise(F.array().cast("array<string>"))), "\n"))
    back = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[back.get(c, F.col(f"_rest.{c}")).alias(c) for c in cols])
