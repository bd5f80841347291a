"""The registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Where the public vocabularies lie; None: asked of the installed package.
VOCABULARIES: str | None = None


def vocabulary(name: str) -> str:
    if VOCABULARIES:
        return f"{VOCABULARIES}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op2_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op3_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scored

    return scored(table(spark, sf_dir, "documents"))


def op5_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import token_table

    return token_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import spans

    return spans(table(spark, sf_dir, "documents"))


def op9_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_recurrent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op7_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simjoin import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of the mix: sizes and targets."""
    from pyspark.sql import functions as F

    return op2_sainte_lague_mix(spark, sf_dir).select("doc_id", "size", "source_size", (F.round("target", 6) + F.lit(0.0)).alias("target"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of the language model: its counts and base scores."""
    from pyspark.sql import functions as F

    rows = op4_suffix_tree(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.round("base_score", 6) + F.lit(0.0)).alias("base_score"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of personal data: base counts and spans."""
    return op6_disclosure(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return ops | {f.__name__: f for f in (mix_targets, lm_base, pii_base)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return {k: v for k, v in SQL.items() if k in queries()}
