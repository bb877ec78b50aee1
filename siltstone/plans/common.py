"""What the registered queries share: tables, order, and the SQL of common expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def md5(column: Column) -> Column:
    return F.md5(column.cast("binary"))


#: White space, as a character class without brackets around it, for RE2.
S = tx.SPACE

STRIP = lambda t: f"regexp_replace({t}, '^{S}+|{S}+$', '', 'g')"
SQUASH = lambda t: f"regexp_replace({STRIP(t)}, '{S}+', ' ', 'g')"
NEWLINES = lambda t: f"regexp_replace({t}, chr(13) || chr(10) || '?', chr(10), 'g')"
CONTROLS = lambda t: f"regexp_replace(regexp_replace({t}, '[\\x0b\\x0c]', chr(10), 'g'), '[\\x00-\\x08\\x0e-\\x1f\\x7f]', '', 'g')"
SQUEEZE = lambda t: STRIP(f"regexp_replace(regexp_replace({t}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
CLEAN = lambda t: SQUEEZE(CONTROLS(f"replace(nfc_normalize({NEWLINES(f'ltrim({t}, chr(65279))')}), chr(9601), '_')"))
KEY = lambda t: f"md5({SQUASH(f'lower({t})')})"
WORDS = lambda t, p: f"regexp_extract_all({t}, '{p}')"

#: Dirt put at the ends of clean test texts, in both engines.
DIRT = "  \r\n\r\n\r\n\x0bend\x01▁ \t\ncafé Ã©\r"
DIRT_SQL = (
    "'  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(11) || 'end' || chr(1) || chr(9601) || ' ' || chr(9) || chr(10)"
    " || 'cafe' || chr(769) || ' ' || chr(195) || chr(169) || chr(13)"
)
RAW_SQL = f"chr(65279) || text || {DIRT_SQL}"


def raw(d: DataFrame) -> DataFrame:
    """The documents with a byte order mark ahead and DIRT behind."""
    return d.withColumn("text", F.concat(F.lit("﻿"), "text", F.lit(DIRT)))


def word_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"
