"""The suffix tree against one of dictionaries, as whole results; and it is no smaller for a larger corpus."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from pixelloom.llm import lm, queries


def _split(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [None]


def plain(rows):
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score, score), from counts of tuples of words."""
    texts = {i: ["<start>", *_split(t)] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    train = [t for i, t in texts.items() if not held[i]]
    count = [Counter((w,) for t in train for w in t)]
    n_texts = len(train)
    words = {s: n for s, n in count[0].items() if s != ("<start>",)}
    n, v = sum(words.values()), len(words)
    root = lambda w: (words.get((w,), 0) + 1) / (n + v + 1)
    kept = {s for s, c in count[0].items() if c >= lm.LEAST} | {("<start>",)}
    all_counts = dict(count[0]) | {("<start>",): n_texts}
    for k in range(1, lm.DEPTH + 1):
        c = Counter()
        for t in train:
            for i in range(k, len(t)):
                if tuple(t[i - k : i]) in kept and tuple(t[i - k + 1 : i + 1]) in kept:
                    c[tuple(t[i - k : i + 1])] += 1
        all_counts |= c
        kept |= {s for s, m in c.items() if m >= lm.LEAST}
    follow = defaultdict(dict)
    for s in kept:
        if len(s) > 1:
            follow[s[:-1]][s[-1]] = all_counts[s]
    retained = set()
    for c, after in follow.items():
        for w, m in after.items():
            p = m / all_counts[c]
            shorter = root(w) if len(c) == 1 else all_counts[(*c[1:], w)] / all_counts[c[1:]]
            if p >= lm.LIKELY and (p >= lm.FAR * shorter or p * lm.FAR <= shorter):
                retained |= {c[j:] for j in range(len(c))}
    out = {}
    for i, t in texts.items():
        score = 0.0
        for at in range(1, len(t)):
            p = root(t[at])
            for k in range(1, min(lm.DEPTH, at) + 1):
                c = tuple(t[at - k : at])
                if c in retained:
                    after, m = follow[c], all_counts[c]
                    total = max(m + len(after), 1)
                    p = after.get(t[at], 0) / total + max(m - sum(after.values()) + len(after), 0.5) / total * p
            score += math.log10(p)
        known = sum(words.get((w,), 0) > 0 for w in t[1:])
        out[i] = (held[i], len(t) - 1, known, n, sum(math.log10(root(w)) for w in t[1:]), score)
    return out


def _same(found, expected):
    got = {x.doc_id: (x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in found.collect()}
    assert got.keys() == expected.keys()
    for i, x in expected.items():
        assert got[i][:4] == x[:4]
        assert got[i][4:] == pytest.approx(x[4:], rel=1e-9, abs=1e-8)


def test_query(spark):
    data = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    _same(queries.op4_suffix_tree(spark, data), plain(zip(docs["doc_id"], docs["text"], strict=True)))


def test_few_words(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, range(60, 0, -1), k=r.randint(0, 40))) for _ in range(150)] + ["rare words once", None, "", "A a"]
    texts += texts[:20]
    docs = list(enumerate(texts))
    _same(lm.scored(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), plain(docs))


def test_a_passage_seen_twice_is_learned_beside_any_corpus(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    # 0 and 2 are training rows, 1 is held out; over ten million words a share of 2e-7 is more than two
    filler = "x y " * 700_000
    rows = [(0, passage), (2, passage), (1, passage), *((100 + i, filler) for i in range(12))]
    got = {x.doc_id: x for x in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].train_tokens > 10_000_000
    assert got[1].held_out and not got[0].held_out and not got[2].held_out
    assert all(got[i].score > got[i].base_score / 4 for i in range(3))


def test_nothing_to_learn_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, t) for i, t in zip(held, ("a b", None, "a b"), strict=True)]
    for x in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert x.train_tokens == 0 and x.n_known == 0 and x.score == 0
