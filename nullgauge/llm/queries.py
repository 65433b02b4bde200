"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .ann import nearest
from .ball_tree import ranked
from .fim import fill_in_middle, restored
from .html_crf import main_texts
from .minhash import near_duplicates
from .mixing import mix
from .oracles import ORACLES  # noqa: F401
from .packing import pack
from .pigeonhole import linked
from .pii import personal_data
from .quality import quality
from .repeats import without_repeats
from .tokens import token_counts
from .warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages"))


def op8_capped_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents"))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_table(spark, sf_dir, "documents")).withColumn("restored", restored())
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(F.encode(c, "utf-8"), 256).alias(f"{c}_sha256") for c in ("output", "restored")])


def op13_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_divergence, op2_bbit_minhash, op3_best_fit_packing, op4_token_counts, op5_warc_revisits, op6_personal_data, op7_main_text,
        op8_capped_mixing, op9_suffix_repeats, op10_cross_polytope, op11_ball_tree_search, op12_fill_in_middle, op13_pigeonhole_join,
    )
}
