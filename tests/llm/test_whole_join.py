"""The whole result of the near-copy query against exact links over all shared shingles."""

import collections
import random

import pyarrow.parquet as pq

from pixelloom.llm import queries, simjoin


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs):
    """doc_id: (n_shingles, component_id), by counting shared shingles of all pairs that share one."""
    of = collections.defaultdict(list)
    for i, text in docs:
        of[_shingles(text)].append(i)
    sets = [s for s in of if s]
    there = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            there[x].append(k)
    up = list(range(len(sets)))

    def find(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in there[x] if j > k).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[find(k)] = find(j)
    least = {}
    for k, s in enumerate(sets):
        least[find(k)] = min(least.get(find(k), 1 << 62), *of[s])
    out = {i: (0, i) for i in of[frozenset()]} if frozenset() in of else {}
    return out | {i: (len(s), least[find(k)]) for k, s in enumerate(sets) for i in of[s]}


def _found(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()}


def test_query(spark):
    data = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert _found(queries.op7_parity_sketch_join(spark, data)) == brute(zip(docs["doc_id"], docs["text"], strict=True))


def _common_text(n):
    """Texts that share 60 of 85 words, most of them unlinked, some near copies of others."""
    r = random.Random(n)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for i in range(n):
        own = [r.choice("abcdefgh") + str(r.randrange(500)) for _ in range(25)]
        if i % 7 == 3:
            own = list(out[r.randrange(len(out))].split()[60:])
            own[r.randrange(25)] = "changed"
        out.append(" ".join(passage + own))
    return out


def test_group_of_mostly_common_text(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK", 300)
    monkeypatch.setattr(simjoin, "ROWS", 500)
    docs = list(enumerate(_common_text(2000)))
    assert _found(simjoin.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


def test_chunks_are_folded(spark, monkeypatch):
    """Chunks whose runs meet in several steps, some with common keys folded, give the same result."""
    monkeypatch.setattr(simjoin, "FAN", 2)
    docs = list(enumerate(_common_text(400)))
    assert _found(simjoin.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))) == brute(docs)


def test_runs_round_trip():
    import numpy as np

    r = np.random.default_rng(1)
    k = np.sort(r.integers(0, 1 << 56, 5000).astype(np.uint64))
    ids, many = r.integers(-(1 << 62), 1 << 62, 40)[r.integers(0, 40, 5000)], r.integers(0, 2, 5000).astype(bool)
    for x, y in zip(simjoin.unpack(simjoin.pack(k, ids, many), simjoin._size(k, ids)), (k, ids, many), strict=True):
        assert (x == y).all()
