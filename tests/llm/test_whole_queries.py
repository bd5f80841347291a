"""Whole results of queries against slow ones of plain Python: the mix, digests, token files, media; and what their files promise."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelloom.llm import fingerprints, mixing, queries, tokenfiles

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    return sorted(t, key=lambda r: r["doc_id"])


# -- mixing -----------------------------------------------------------------------------------------------------


def _words(text):
    return (text or "").encode().split()


def _check_mix(rows, sources):
    by = collections.defaultdict(list)
    for r in rows:
        by[sources[r.doc_id]].append(r)
    for source, own in by.items():
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        (target,) = {r.target for r in own}
        assert abs(sum(r.taken for r in own) - target) <= max(2, 0.02 * target), source


def test_mix(spark, texts):
    rows = queries.op2_sainte_lague_mix(spark, DATA).collect()
    assert {r.doc_id: r.size for r in rows} == {t["doc_id"]: len(_words(t["text"])) for t in texts}
    _check_mix(rows, {t["doc_id"]: t["source"] for t in texts})
    again = queries.op2_sainte_lague_mix(spark, DATA).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_a_tiny_source_leaves_the_others_their_blocks(spark):
    rows = [(0, "one two", "tiny"), *((i, f"w{i} " * 997, "a") for i in range(1, 60)), *((i, "x " * 450, None) for i in range(60, 70))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    _check_mix(got, {i: s for i, _, s in rows})
    blocks = {r.source: r.block for r in mixing.plan(df).select("source", "block").distinct().collect()}
    assert blocks["tiny"] == 1 and blocks["a"] == mixing.BLOCK


def test_mixed_texts_are_runs_of_words(spark, texts):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mixed(df).collect()}
    old = {t["doc_id"]: (t["text"] or "") for t in texts}
    mix = mixing.mixed_documents(df).collect()
    assert {r.doc_id for r in mix} == {i for i, n in taken.items() if n}
    for r in mix:
        assert len(_words(r.text)) == taken[r.doc_id]
        whole = " ".join(old[r.doc_id].split())
        assert all(" ".join(line.split()) in whole for line in r.text.split("\n"))


# -- digests ----------------------------------------------------------------------------------------------------


def _slow_counts(raw):
    out = [0] * fingerprints.BUCKETS
    for table, offsets in zip(fingerprints.TABLES.tolist(), fingerprints.OFFSETS, strict=True):
        for i in range(len(raw) - offsets[-1]):
            h = 0
            for t, o in zip(table, offsets, strict=True):
                h ^= t[raw[i + o]]
            out[h] += 1
    return out


def test_counts_one_triplet_at_a_time():
    for raw in (b"", b"ab", b"abc", b"abcd", bytes(range(256)) * 3, "ß日本 text".encode() * 9):
        assert fingerprints.bucket_counts(raw).tolist() == _slow_counts(raw)


def test_digests(spark, texts):
    got = {r.doc_id: r for r in queries.op5_quartile_digest(spark, DATA).collect()}
    assert got.keys() == {t["doc_id"] for t in texts}
    for k, t in enumerate(texts):
        text, following = t["text"] or "", texts[(k + 1) % len(texts)]["text"] or ""
        h = len(text) // 2
        new = text[: len(text) - h] + following[:h]
        r = got[t["doc_id"]]
        marks = [fingerprints.digest(x.encode()) for x in (text, new, following)]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == marks[:2]
        assert r.near_edited == pytest.approx(fingerprints.likeness(marks[0], marks[1])) and r.near_next == pytest.approx(fingerprints.likeness(marks[0], marks[2]))


# -- token files ------------------------------------------------------------------------------------------------


def test_token_files(spark, texts):
    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    at, expected = 0, []
    for x in texts:
        ids = np.array([*t.encode(x["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((x["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_orc_token_files(spark, DATA).collect())
    assert got == expected


def _rows_read(df):
    """Rows that the scan gave to the plan, after collecting."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return rows, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_predicate_on_ids_skips_files_and_row_groups(spark, tmp_path):
    """Even ids only: an even one reads one row group of one file, an odd one inside the range nothing, by the Bloom filter."""
    docs = spark.range(30_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = f"file://{tmp_path}/ids"
    tokenfiles.write(docs, queries.vocabulary("byte_bpe_50k.json"), path)
    files = tokenfiles.read(spark, path)
    rows, read = _rows_read(files.where("doc_id = 30000").select("doc_id", "ids"))
    assert len(rows) == 1 and 0 < read <= 2 * int(tokenfiles.OPTIONS["orc.row.index.stride"])
    rows, read = _rows_read(files.where("doc_id = 100000").select("doc_id", "ids"))
    assert not rows and read == 0
    # the two readers' row groups of 30001 are few: a wrong answer of the filter is one in a hundred
    odd = [_rows_read(files.where(f"doc_id = {i}").select("doc_id"))[1] for i in range(1001, 60_000, 6000)]
    assert sum(n == 0 for n in odd) >= 8


def test_files_are_in_order_and_of_many_stripes(spark, tmp_path):
    docs = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("doc_id"), F.repeat(F.lit("many words "), 20).alias("text"))
    path = f"file://{tmp_path}/ids"
    tokenfiles.write(docs, queries.vocabulary("byte_bpe_50k.json"), path)
    rows = tokenfiles.read(spark, path).select("part", "seq", "doc_id").collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.part, r.seq))] == list(range(5000))
    assert len({r.part for r in rows}) > 1
