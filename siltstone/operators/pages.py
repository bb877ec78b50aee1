"""Page furniture, back matter and robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def furniture(lines: DataFrame, edge: int = 4, share: float = 0.10, anywhere: float = 0.5) -> DataFrame:
    """lines(doc, page, pos, line) with furniture: what repeats at the edges of pages, or on half of them, and stepping page numbers.

    Digits are taken out of a line before it is counted, so "Page 3 of 9" repeats; a bare number is
    furniture where number and page keep one distance on enough pages.
    """
    key = F.regexp_replace(F.lower(F.trim("line")), r"[0-9]+", "#")
    by = Window.partitionBy("doc", "page")
    d = lines.withColumn("key", key).withColumn("last", F.max("pos").over(by)).withColumn("first", F.min("pos").over(by))
    d = d.withColumn("at_edge", (F.col("pos") - F.col("first") < edge) | (F.col("last") - F.col("pos") < edge))
    pages = d.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    seen = d.filter("key <> ''").groupBy("doc", "key").agg(
        F.count_distinct(F.when(F.col("at_edge"), F.col("page"))).alias("edges"), F.count_distinct("page").alias("all")
    )
    number = F.trim("line").try_cast("int")
    steps = d.filter(F.col("at_edge") & number.isNotNull()).groupBy("doc", (number - F.col("page")).alias("offset")).agg(F.count_distinct("page").alias("steps"))
    out = d.join(pages, "doc").join(seen, ["doc", "key"], "left").withColumn("offset", number - F.col("page")).join(steps, ["doc", "offset"], "left")
    often = F.greatest(F.lit(3.0), F.col("pages") * share)
    repeated = F.col("at_edge") & (F.col("edges") >= often) & (F.col("key") != "#")
    everywhere = (F.col("all") >= F.greatest(F.lit(3.0), F.col("pages") * anywhere)) & (F.col("key") != "#")
    stepping = F.col("at_edge") & (F.col("steps") >= often)
    return out.select(*lines.columns, F.coalesce(repeated | everywhere | stepping, F.lit(False)).alias("furniture"))


def without_back_matter(lines: DataFrame, names: str = r"(?i)^(references|bibliography|acknowledg\w*|funding|author contributions|competing interests)$") -> DataFrame:
    """lines(doc, pos, line) less the sections under back-matter headings, up to the next heading of the same or a higher level."""
    level = F.when(F.col("line").rlike("^#+ "), F.length(F.regexp_extract("line", "^(#+) ", 1)))
    title = F.trim(F.regexp_replace("line", "^#+ ", ""))
    run = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("level", level).withColumn("section", F.count("level").over(run))
    heads = d.filter("level is not null").select("doc", "section", "level", title.rlike(names).alias("bad"))
    order = Window.partitionBy("doc").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    # a head is under a bad one if since the nearest bad head none has come up to its level
    packed = F.collect_list(F.struct("section", "level", "bad")).over(order)
    under = F.exists(
        F.filter(packed, lambda h: h["bad"]),
        lambda h: (F.col("level") > h["level"]) & ~F.exists(packed, lambda o: (o["section"] > h["section"]) & (o["level"] <= h["level"])),
    )
    gone = heads.withColumn("gone", F.col("bad") | F.coalesce(under, F.lit(False))).select("doc", "section", "gone")
    return d.join(gone, ["doc", "section"], "left").filter(~F.coalesce("gone", F.lit(False))).select(*lines.columns)


def allowed(urls: DataFrame, rules: DataFrame, path: Column) -> DataFrame:
    """urls with allowed: of the rules(host, pattern, allow) of the host that fit, the longest decides, and allowing wins a tie."""
    pattern = F.regexp_replace(F.regexp_replace("pattern", r"([.+?()\[\]{}|^\\])", r"\\$1"), r"\*", ".*")
    own = urls.withColumn("siltstone_path", path)
    fits = own.join(rules, "host").withColumn("rule", F.concat(F.lit("^"), pattern)).filter("siltstone_path rlike rule")
    best = fits.groupBy("host", "siltstone_path").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("b"))
    return own.join(best, ["host", "siltstone_path"], "left").withColumn("allowed", F.coalesce("b.allow", F.lit(True))).drop("b", "siltstone_path")


def without_pdf_back_matter(lines: DataFrame, names: str = r"(?i)^(bibliography|acknowledg\w*|funding|author contributions|competing interests)$", most: int = 3000) -> DataFrame:
    """lines(doc, pos, line) less reference lists and short back-matter sections; a long one under such a heading may be text, and stays."""
    head = F.col("line").rlike("^#+ ")
    run = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("section", F.sum(head.cast("int")).over(run))
    title = F.trim(F.regexp_replace(F.min_by("line", "pos"), "^#+ ", ""))
    by = d.groupBy("doc", "section").agg(title.alias("title"), F.sum(F.length("line")).alias("chars"))
    gone = (F.col("section") > 0) & (F.lower("title").eqNullSafe("references") | (F.col("title").rlike(names) & (F.col("chars") <= most)))
    return d.join(by.filter(gone).select("doc", "section"), ["doc", "section"], "left_anti").select(*lines.columns)
