"""Token ids as ORC files: rows in ascending doc_id order over many files, integer run-length encoding, row indexes
and Bloom filters on doc_id.

``write`` deals documents out by doc_id range, encodes them inside the sorted partitions (ids are never shuffled) and
writes one run of stripes a partition. ``read`` is an ordinary ORC scan: stripes are read in parallel, a predicate
on doc_id is pushed down and skips files, stripes and row groups by their statistics and Bloom filters.

Edge cases: a null or empty text is the end id alone; a text of any length is one row; repeated rows stay, ordered by text (ties); rows with
a null doc_id come last, by a hash of text and place, with a null doc_id in the result; an empty table gives files without rows; other columns
are ignored, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, scratch
from .ordered import in_order
from .tokens import encoder, parts

END = 2
FILE_SCHEMA = "part int, seq long, doc_id long, ids array<int>"
#: Whole row groups are skipped by statistics and Bloom filter of doc_id.
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "orc.encoding.strategy": "SPEED",
    "compression": "zstd",
}


def write(docs: DataFrame, vocabulary: str, path: str, cut: str = "bytes", end: int = END) -> None:
    """Encodes whole texts and writes their ids, each document's followed by ``end``."""
    rows, _ = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, seq = encoder(vocabulary, cut).column, 0
        for part in parts(batches, 1):
            ids, cuts = column(part.column(1))
            n = part.num_rows
            # each text's ids move on by the ends before them
            values = np.full(len(ids) + n, end, np.uint32)
            values[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(cuts))] = ids
            yield pa.RecordBatch.from_arrays(
                [part.column(2).cast(pa.int32()), pa.array(np.arange(seq, seq + n)), part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array((cuts + np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int32)))],
                ["part", "seq", "doc_id", "ids"],
            )
            seq += n

    rows.transform(mapped(run, FILE_SCHEMA, "tokens")).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


DIGEST = "part int, seq long, doc_id long, n_tokens long, ids_crc32 long"


def digests(files: DataFrame) -> DataFrame:
    """Per document what its stored ids are: their number, checksum, and how many ids come before it in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = np.asarray(lists.flatten(), "<i4").tobytes()
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            view, ends = memoryview(flat), (offsets * 4).tolist()
            crc = [zlib.crc32(view[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], [x.split()[0] for x in DIGEST.split(", ")])

    return files.select("part", "seq", "doc_id", "ids").transform(mapped(run, DIGEST))


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds start: the ids of all rows before, by (part, seq).

    Totals of the parts are one small row each; inside a part a window adds up. Parts are ranges of doc_ids of about
    equal row count, so no window grows beyond one.
    """
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = Window.partitionBy("part").orderBy("seq")
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens"))


def token_table(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Writes the files, reads them back, and returns doc_id, start, n_tokens, ids_crc32 from what was read."""
    from .common import saved

    spark = docs.sparkSession
    at = path or scratch(spark, "token-ids")
    write(docs, vocabulary, at)
    rows = saved(digests(read(spark, at)), "token-digests")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
