"""Document fingerprints: a digest of bucket quartiles.

Bytes are hashed in triplets (the first byte of a four-byte window with two of the other three); each triplet adds one to
one of 256 buckets by tabulation hashing. The digest is hexadecimal: the length on a logarithmic scale (2
digits), the ratios of the lower quartiles to the upper one (2 digits), then two bits a bucket that say in which
quarter of all buckets its count lies. The difference of two digests adds length steps, ratio steps and bucket
steps, each bounded, so that it is at most ``MOST``; likeness is 1 - difference / MOST.

Edge cases: null and empty texts give the digest of no triplets; equal texts have equal digests; texts under
three bytes have no triplets, texts of any length are counted whole. Repeated doc_ids are ordered by text (ties); null doc_ids come last, in
one part. An empty table gives no rows; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, width
from .ordered import part_bounds, part_column

BUCKETS = 256
LENGTH_MOST, RATIO_MOST, STEP = 24, 12, (0, 1, 2, 4)
MOST = LENGTH_MOST + 2 * RATIO_MOST + STEP[3] * BUCKETS // 2


def _tables() -> np.ndarray:
    """Three byte tables of a fixed linear congruential sequence."""
    x, out = 20240229, []
    for _ in range(3 * 3 * 256):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 56)
    return np.array(out, np.uint8).reshape(3, 3, 256)


TABLES = _tables()
OFFSETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))


def bucket_counts(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for tables, offsets in zip(TABLES, OFFSETS, strict=True):
        n = len(a) - offsets[-1]
        if n > 0:
            h = tables[0][a[:n]]
            h ^= tables[1][a[offsets[1] : offsets[1] + n]]
            h ^= tables[2][a[offsets[2] : offsets[2] + n]]
            out += np.bincount(h, minlength=BUCKETS)
    return out


def digest(raw: bytes) -> str:
    counts = bucket_counts(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    length = min(255, round(8 * math.log2(1 + len(raw))))
    ratios = [min(15, 16 * q // (q3 + 1)) for q in (q1, q2)]
    code = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = (code[:, 0] << 6) | (code[:, 1] << 4) | (code[:, 2] << 2) | code[:, 3]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}" + packed.astype(np.uint8).tobytes().hex()


_PAIRS = np.array([[sum(STEP[abs((x >> s & 3) - (y >> s & 3))] for s in (0, 2, 4, 6)) for y in range(256)] for x in range(256)], np.uint8)


def difference(a: str, b: str) -> int:
    """0 for equal digests, MOST at most."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    length = min(LENGTH_MOST, abs(x[0] - y[0]))
    ratio = min(RATIO_MOST, abs((x[1] >> 4) - (y[1] >> 4))) + min(RATIO_MOST, abs((x[1] & 15) - (y[1] & 15)))
    steps = int(_PAIRS[np.frombuffer(x, np.uint8, offset=2), np.frombuffer(y, np.uint8, offset=2)].sum())
    return min(MOST, length + ratio + steps)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MOST


def edited(text: str, following: str) -> str:
    """The last half of text (rounded down) replaced by as much of the following text's beginning, or all of it."""
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_successor(docs: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, ahead) sorted within partitions: every part is followed by the first row of the next
    part that has rows, marked ``ahead``; the last part by the first row of all.

    Texts are shuffled once. What the driver learns is one doc_id a part (their least ones).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = part_bounds(rows, width(spark))
    firsts = sorted(rows.select(part_column(bounds).alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id").alias("least")).collect())
    # parts without rows vanish: a bound stays where the part above it has rows, but for the first part
    bounds = [bounds[r.part - 1] for r in firsts[1:]]
    n = len(bounds) + 1
    here = rows.withColumn("part", part_column(bounds))
    least = part_column(bounds, [r.least for r in firsts] or [None])
    # the first row of a part also follows the part before; of several rows with its doc_id the reader takes the first by text
    ahead = here.where(F.col("doc_id").eqNullSafe(least)).select("doc_id", "text", F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("ahead"))
    here = here.withColumn("ahead", F.lit(False)).select("doc_id", "text", "part", "ahead")
    both = here.unionByName(ahead).repartitionById(n, F.col("part"))
    return both.sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digest of every text, of its edited text, and their likeness, and the likeness to the next document's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose successor comes next: id, text, digest
        ended = False

        def result(row: tuple, text: str, mark: str) -> tuple:
            new = edited(row[1], text)
            raw = new.encode("utf-8", "surrogatepass")
            own = digest(raw)
            return row[0], len(row[1]), hashlib.sha256(raw).hexdigest(), row[2], own, likeness(row[2], own), likeness(row[2], mark)

        for batch in batches:
            out = []
            for i, text, ahead in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "ahead")), strict=True):
                if ended:
                    continue
                mark = digest(text.encode("utf-8", "surrogatepass"))
                if held is not None:
                    out.append(result(held, text, mark))
                held, ended = (i, text, mark), ahead
                if len(out) == 512:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return with_successor(docs).transform(mapped(run, SCHEMA))


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], NAMES)
