"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import fingerprints, html, lm, media, mixing, packing, pii, simjoin, tokenfiles, toxicity
from pixelloom.llm.queries import vocabulary

EXTRA = "part string, size string, score string, row int, _row int, shard int, target string, at int, n long, set_id string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
TEXTS = [None, "", "   \n\t ", "one two", "a b c d e f g h " * 3, "a b c d e f g h " * 3, "x" * 30_000, "ß é 日本 \U0001f600 words", "mail me a.b@c-d.org or +49 (30) 1234567 now"]
#: A megabyte of words, and many matches.
TEXTS += ["word after word " * 65_000, "a@b.org, 4111 1111 1111 1111, +49 (30) 1234567. " * 3000]


def _docs(spark, texts, sources=("s1", "s2", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) + ("z", "z", "z", 1, 1, 1, "z", 1, 1, "z") for i, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    rows.append((None, "text without id", None, None, None) + (None,) * 10)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 0, 0), (4, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


N = len(TEXTS) + 2


def test_media(docs, none):
    rows = media.text_media(docs).collect()
    assert len(rows) == N and not media.text_media(none).collect()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_bytes == 0 and by[0].payload_bytes == 192 and by[0].media_sha256 == by[1].media_sha256
    assert by[6].payload_sha256 == hashlib.sha256(b"x" * 30_000 + b" " * (-30_000 % 192)).hexdigest()


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == N and not mixing.mixed(none).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mix.collect()) == sum(r.taken for r in rows)


def test_packing(docs, none):
    path = vocabulary("word_bpe_49k.json")
    rows = packing.packed(docs, path, capacity=64).collect()
    assert not packing.packed(none, path).collect()
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 64
    assert any(r.doc_id is None for r in rows)
    assert sum(r.length for r in rows if r.doc_id == 0) == 1


def test_lm(docs, none):
    rows = lm.scored(docs).collect()
    assert len(rows) == N and not lm.scored(none).collect()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == 1 and by[0].score <= 0
    assert len({(r.n_tokens, r.train_tokens) for r in rows if r.doc_id == len(TEXTS) - 1}) == 1


def test_fingerprints(docs, none):
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == N and not fingerprints.fingerprints(none).collect()
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[1].fingerprint and by[4].fingerprint == by[5].fingerprint
    text = TEXTS[3]
    assert by[3].edited_sha256 == hashlib.sha256((text[: len(text) - 3] + TEXTS[4][:3]).encode()).hexdigest()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_pii(docs, none):
    rows = pii.spans(docs).collect()
    assert len(rows) == N and not pii.spans(none).collect()
    by = {r.doc_id: r for r in rows}
    assert by[8].spans == "email:8:19,phone:23:39" and by[0].spans == ""
    assert None in by and by[None].spans == "" and (by[10].n_email, by[10].n_card, by[10].n_phone) == (3000, 3000, 3000)
    assert by[10].n_spans == 9000 and by[8].n_spans == 2 and by[0].n_spans == 0
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[8] == "mail me [EMAIL] or [PHONE] now" and texts[0] is None and texts[7] == TEXTS[7]


def test_simjoin(docs, none):
    rows = simjoin.classes(docs.select("doc_id", "text")).collect()
    assert len(rows) == N and not simjoin.classes(none.select("doc_id", "text")).collect()
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 4 and by[0].n_shingles == 0 and by[0].component_id == 0 and by[3].n_shingles == 1
    kept = simjoin.without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and len(ids) == len(set(ids)) and {0, 1, 2, 3, 4, 6, 7, 8} <= set(ids)


def test_tokenfiles(docs, none):
    path = vocabulary("byte_bpe_50k.json")
    rows = tokenfiles.token_table(docs, path).collect()
    assert len(rows) == N and not tokenfiles.token_table(none, path).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    # rows without an id come last
    assert max(rows, key=lambda r: r.start).doc_id is None and max(r.n_tokens for r in rows) > 190_000
    ties = docs.where("doc_id = 4").unionByName(docs.where("doc_id = 4").withColumn("text", F.lit("a a")))
    got = sorted(tokenfiles.token_table(ties, path).collect(), key=lambda r: r.start)
    assert [r.n_tokens for r in got] == sorted(r.n_tokens for r in got) and got[1].start == got[0].n_tokens


def test_toxicity(docs, none, labels):
    rows = toxicity.judged(docs, labels).collect()
    assert len(rows) == N and all(0 <= r.score <= 1 for r in rows)
    assert not toxicity.judged(none, labels).collect()
    kept = toxicity.without_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == N


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  text.<p>Second\n text.</article><footer>&copy; us</footer>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x"), (None, "u", "<script>var a = '</p>';</script>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(df).collect()
    assert [r.text for r in got if r.page_id == 1] == ["A & B\nFirst text.\nSecond text."] * 2
    assert all(r.text == "" for r in got if r.page_id != 1) and len(got) == 5
    assert not html.main_text(df.limit(0)).collect()
