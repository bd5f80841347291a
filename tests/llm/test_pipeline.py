"""The pipeline: every stage on nulls, blanks, repeats, long texts and clashing columns, on an empty table, and its whole result."""

import collections

import corpus_pipeline
import pytest

from pixelloom.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rest int, row string, part int, size long, taken double, score string, set_id int"
LONG = "long words repeat " * 40_000


def _docs(spark):
    copies = " ".join(f"copy{i}" for i in range(60))
    texts = [None, "", " \n\t", "one two", copies, copies, copies + " more", "mail a.b@c-d.org now", LONG, "4111 1111 1111 1111, " * 200, "ß é 日本 \U0001f600"]
    texts += [f"plain document number {i} about nothing in particular, as good as any other {i * i}" for i in range(40)]
    rows = [(i, t, "en", ("s1", "s2", None)[i % 3], len(t or ""), 1, "z", 2, 3, 0.5, "z", 9) for i, t in enumerate(texts)]
    rows += [rows[3], rows[20], (None, "text without id", None, None, None) + (None,) * 7]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    _docs(spark).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(3, 0, 0), (20, 1, 1), (21, 1, None), (22, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        counts[name] = len(rows)
        if name != "packing":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, SCHEMA)
        if name == "near_copies":
            ids = [r.doc_id for r in rows]
            assert 4 in ids and 5 not in ids and 6 not in ids and len(ids) == len(set(ids)) and {0, 1, 2, 3, None} <= set(ids)
        if name == "pii":
            by = {r.doc_id: r for r in rows}
            assert by[7].text == "mail [EMAIL] now" and by[0].text is None and by[8].text == LONG and "4111" not in by[9].text
        if name == "packing":
            used = collections.Counter()
            for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == used[r.sequence_id]
                used[r.sequence_id] += r.length
            assert max(used.values()) <= 4096
    assert counts["toxicity"] == 54


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset", "ids_crc32"} <= set(got.columns) and got.count() > 40


def test_run_on_nothing(spark, sf_dir, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxic_documents_go(spark):
    """Documents of labelled words go, whichever stage they would reach; clean ones stay."""
    docs = spark.createDataFrame([(i, f"you are a moron and trash, number {i}" if i % 4 == 0 else f"a kind word for reader {i}, as ever") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    assert {r.doc_id % 4 for r in toxicity.without_toxic(docs, labels).collect()} == {1, 2, 3}
