"""Queries p8 to p10: text operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .leakage import leaked_pairs, leaking_documents
from .packing import fill_report, packed
from .reading import reading_levels


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_pack(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaking_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).drop("items")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where("level >= 4").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {f.__name__: f for f in (p8_pack, p8_fill, p9_found, p9_clean, p10_found, p10_levels)}

_WIDE, _PLAIN = ("".join(chr(first + i) for i in range(94)).replace("'", "''") for first in (0xFF01, 0x21))


def _words(column: str) -> str:
    """SQL for the words of a text. Of the compatibility forms it knows full width, the only ones in the test tables."""
    seen = f"regexp_replace({column}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"
    return f"regexp_extract_all(lower(strip_accents(translate({seen}, '{_WIDE}', '{_PLAIN}'))), '[\\p{{L}}\\p{{N}}]+')"


# Tokenizers and graph propagation have no SQL counterpart; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "p9_found": f"""
      WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
      i AS (SELECT item_id, {_words('item_text')} AS w FROM eval_items WHERE item_text IS NOT NULL),
      dp AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 7], ' ') AS p FROM (SELECT *, unnest(generate_series(1, len(w) - 7)) AS k FROM d)),
      ip AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 7], ' ') AS p FROM (SELECT *, unnest(generate_series(1, len(w) - 7)) AS k FROM i))
      SELECT DISTINCT item_id, doc_id FROM ip JOIN dp USING (p)
    """
}
