"""The whole build as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from .build import BuildConfig, build
from .catalog import register
from .common import docs
from .report import report


@register("p07_build_ledger")
def p07(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", "doc_id", F.substring("text", 1, 60).alias("title"), "text")
    return build(d, BuildConfig(boilerplate_docs=4, max_docs={"src0": 40}))["ledger"]


@register("k05_report")
def k05(spark, sf_dir):
    """The lines of the build's report."""
    d = docs(spark, sf_dir).select("source", "doc_id", F.substring("text", 1, 60).alias("title"), "text")
    lines = report(build(d, BuildConfig(boilerplate_docs=4, near_duplicates="off"))).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")
