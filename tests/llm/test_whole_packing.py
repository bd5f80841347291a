"""The whole packing query against the library's ids, and packings that need generations, levels and migration."""

import collections
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from pixelloom.llm import packing, queries


def test_query(spark):
    data = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    t.encode_special_tokens = True
    rows = queries.op3_island_packing(spark, data).collect()
    pieces = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        pieces[r.doc_id].append(r)
    assert pieces.keys() == set(docs["doc_id"])
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        cut = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]] == [(k, 4096 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut)]
    used = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


def _packed(spark, lengths, capacity, **how):
    items = spark.createDataFrame(list(enumerate(lengths)), "row long, length long").repartition(5)
    rows = packing.pack(items, capacity, **how).collect()
    assert sorted(r.row for r in rows) == list(range(len(lengths)))
    used = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += lengths[r.row]
    assert max(used.values()) <= capacity
    return len(used), sum(r.generations for r in rows)


def test_pieces_of_one_id_fill_their_sequences(spark):
    assert _packed(spark, [1] * 5000, 256, group=100)[0] == 20


def test_hard_lengths_run_generations(spark):
    r = random.Random(2)
    lengths = [r.randint(1200, 1600) for _ in range(600)]
    bins, generations = _packed(spark, lengths, 4096, group=200)
    best = packing.best_fit(lengths, sorted(range(600), key=lambda i: -lengths[i]), 4096)
    assert generations > 0 and bins < len(best.bins)


def test_lengths_that_leave_all_sequences_loose(spark):
    """Two pieces a sequence whatever happens: levels end, and no piece is lost."""
    # a group of an odd number has one piece alone
    assert 200 <= _packed(spark, [140] * 400, 400, group=50)[0] <= 203
