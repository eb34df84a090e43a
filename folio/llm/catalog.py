"""The registered queries of the operators: over whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import changepoints, chat, fingerprints, language, mixing, neardup, personal, pieces, quality, resample, search, secrets, setjoin
from folio.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.where(F.col("doc_id") % 20 == 0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])


def op6_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"), language.train(table(spark, sf_dir, "documents")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.change_points(table(spark, sf_dir, "sale_lines"))


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_fingerprints,
            op2_top_k_search,
            op3_quality,
            op4_secrets,
            op5_mixing,
            op6_language,
            op6_page_language,
            op7_chat_format,
            op8_near_duplicates,
            op9_personal_data,
            op10_pieces,
            op11_change_points,
            op12_set_join,
            op13_resample,
        )
    }


def oracle_sql() -> dict[str, str]:
    """Operators 11 and 12 are SQL as a whole; see tests/llm for the brute-force versions that the others are held against."""
    return {"op11_change_points": changepoints.SQL, "op12_set_join": setjoin.SQL}
