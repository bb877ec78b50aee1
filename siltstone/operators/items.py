"""Question items, pairs, URLs and lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import SEPARATOR

KINDS = ("mcq", "code", "numeric", "open")


def item_fault(id_: Column, question: Column, options: Column, answer: Column, category: Column, kind: Column) -> Column:
    """The first reason why an item can't be used; null if it can."""
    out = F.when(F.lit(False), "")
    for name, value in (("id", id_), ("question", question), ("kind", kind), ("category", category)):
        out = out.when(F.coalesce(value.cast("string"), F.lit("")) == "", f"missing {name}")
    choices = F.coalesce(options, F.array().cast("array<string>"))
    mcq = kind == "mcq"
    return (
        out.when(~kind.isin(*KINDS), F.concat(F.lit("unknown kind "), kind))
        .when(mcq & (F.size(choices) < 2), "fewer than two options")
        .when(mcq & F.exists(choices, lambda o: F.coalesce(o, F.lit("")) == ""), "empty option")
        .when(mcq & ~F.coalesce(F.array_contains(choices, answer), F.lit(False)), "answer not among the options")
        .when(mcq & (F.size(F.filter(choices, lambda o: o == answer)) > 1), "answer duplicated among the options")
        .when(~mcq & options.isNotNull(), "options must be null for non-MCQ items")
    )


ITEM = ("id", "question", "options", "answer", "category", "kind", "tags")


def _item(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns[c].alias(c) for c in ITEM])


def _lettered(df: DataFrame, id_: str, question: str, options: str, answer: str, category: Column, tags: Column) -> DataFrame:
    return _item(df, id=F.col(id_).cast("string"), question=F.col(question), options=F.col(options), answer=F.get(options, F.col(answer)), category=category, kind=F.lit("mcq"), tags=tags)


NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    # answer is an index into choices
    "mmlu": lambda d: _lettered(d, "id", "question", "choices", "answer", F.col("subject"), F.array("subject")),
    "mmlu_pro": lambda d: _lettered(d, "question_id", "question", "options", "answer_index", F.col("category"), F.array("category")),
    # choices are {text, label}, the answer a label
    "arc": lambda d: _item(
        d, id=F.col("id"), question=F.col("question"), options=F.col("choices.text"), category=F.lit("science"), kind=F.lit("mcq"), tags=F.array(F.lit("science")),
        answer=F.get(F.col("choices.text"), (F.array_position("choices.label", F.col("answerKey")) - 1).cast("int")),
    ),
    # the right answer and what is not
    "sciq": lambda d: _item(
        d, id=F.col("id").cast("string"), question=F.col("question"), options=F.array("correct_answer", "distractor1", "distractor2", "distractor3"), answer=F.col("correct_answer"),
        category=F.lit("science"), kind=F.lit("mcq"), tags=F.array(F.lit("science")),
    ),
    "labbench": lambda d: _item(
        d, id=F.col("id"), question=F.col("question"), options=F.concat(F.array("ideal"), F.col("distractors")), answer=F.col("ideal"), category=F.col("subtask"), kind=F.lit("mcq"), tags=F.array("subtask")
    ),
    # yes, no or maybe
    "pubmedqa": lambda d: _item(
        d, id=F.col("pubid").cast("string"), question=F.concat_ws("\n", F.array_join("contexts", " "), "question"), options=F.array(F.lit("yes"), F.lit("no"), F.lit("maybe")), answer=F.col("final_decision"),
        category=F.lit("pubmed"), kind=F.lit("mcq"), tags=F.array(F.lit("pubmed")),
    ),
    "medcalc": lambda d: _item(
        d, id=F.col("row").cast("string"), question=F.concat_ws("\n\n", "note", "question"), options=F.lit(None).cast("array<string>"), answer=F.col("answer"), category=F.col("category"), kind=F.lit("numeric"),
        tags=F.array("category"),
    ),
    "code": lambda d: _item(
        d, id=F.col("task_id").cast("string"), question=F.col("prompt"), options=F.lit(None).cast("array<string>"), answer=F.col("canonical_solution"), category=F.lit("code"), kind=F.lit("code"), tags=F.array(F.lit("code"))
    ),
}


def hash_top(df: DataFrame, name: str, id_col: str, k: int) -> DataFrame:
    """k rows by the smallest SHA-256 of name and id."""
    return df.withColumn("h", F.sha2(F.concat_ws("|", F.lit(name), F.col(id_col).cast("string")).cast("binary"), 256)).orderBy("h", id_col).limit(k)


def normalised_url(url: Column) -> Column:
    """http(s) addresses with a lower-case host, no default port, no fragment and a path; null for others."""
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^@/?#]*@)?([^:/?#]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^@/?#]*@)?[^:/?#]+:(\d+)(?=[/?#]|$)", 1)
    bad_port = url.rlike(r"^[A-Za-z]+://(?:[^@/?#]*@)?[^:/?#]+:[^/?#]*[^0-9/?#]")
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*(/[^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    net = F.when(port.isin("", "80", "443"), host).otherwise(F.concat_ws(":", host, port))
    good = scheme.isin("http", "https") & (host != "") & ~bad_port
    return F.when(good, F.concat(scheme, F.lit("://"), net, F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query)))


def file_stem(path: Column) -> Column:
    """A short, safe file name of a page's path: parts joined by __, long ones ended by a digest."""
    plain = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"(?i)\.(md|markdown|rst|rmd|txt|html?|ipynb|pdf|rd|tex)$", "")
    parts = F.filter(F.split(plain, r"[\\/]+"), lambda p: ~p.isin("", ".", ".."))
    safe = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""))
    stem = F.array_join(F.filter(safe, lambda p: p != ""), "__")
    stem = F.when(stem == "", "index").otherwise(stem)
    cut = F.concat(F.regexp_replace(F.substring(stem, 1, 90), r"[._-]+$", ""), F.lit("_"), F.substring(F.sha1(plain.cast("binary")), 1, 8))
    return F.when(F.length(stem) > 100, cut).otherwise(stem)


def fenced(source: Column, language: str = "") -> Column:
    """Source code in a fence longer than any in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(source, F.lit("(`{3,})"), F.lit(1)), F.length)), F.lit(2))
    fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
    return F.concat(fence, F.lit(language + "\n"), F.regexp_replace(source, r"\n+$", ""), F.lit("\n"), fence)


def notebook_markdown(raw: Column) -> Column:
    """Text cells as they are, code cells fenced, outputs left out."""
    schema = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
    cells = F.from_json(raw, schema)["cells"]

    def part(c: Column) -> Column:
        body = F.array_join(c["source"], "")
        return F.when(F.trim(body) == "", None).when(c["cell_type"] == "code", fenced(body, "python")).when(c["cell_type"].isin("markdown", "heading"), F.trim(body))

    return F.array_join(F.filter(F.transform(cells, part), lambda p: p.isNotNull()), "\n\n")


def pair_layout(question: Column, answer: Column, context: int, begin: int = 1, end: int = 2) -> dict[str, Column]:
    """ids, n_prompt and truncated of a question and an answer: the question is cut from the left, then the answer's end."""
    q, a, room = F.size(question), F.size(answer) + 1, context
    long = q + a > room
    keep_a = F.greatest(F.lit(1), room - F.least(q, F.lit(room // 2)))
    full = F.concat(answer, F.array(F.lit(end)))
    cut_a = F.when(long, F.slice(full, F.lit(1), keep_a)).otherwise(full)
    keep_q = F.greatest(room - F.size(cut_a), F.lit(0))
    cut_q = F.when(long & (q > keep_q), F.slice(question, q - keep_q + 1, F.greatest(keep_q, F.lit(1)))).otherwise(question)
    return {"ids": F.concat(F.array(F.lit(begin)), cut_q, cut_a), "n_prompt": F.size(cut_q) + 1, "truncated": long}


def budget_sample(df: DataFrame, order: Column, size: str, budget: int) -> DataFrame:
    """Rows in hash order until their sizes fill a budget; the row that overfills it is the last.

    Rows are first summed by the leading bits of their hash, so that the order is only made in the
    bucket where the budget runs out.
    """
    h = df.withColumn("siltstone_h", order).withColumn("siltstone_b", F.floor(F.col("siltstone_h") * 4096))
    sums = h.groupBy("siltstone_b").agg(F.sum(size).alias("s"))
    ahead = Window.orderBy("siltstone_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(ahead), F.lit(0))).filter(F.col("before") < budget).drop("s")
    near = h.join(F.broadcast(sums), "siltstone_b")
    within = Window.partitionBy("siltstone_b").orderBy("siltstone_h").rowsBetween(Window.unboundedPreceding, -1)
    run = near.withColumn("before", F.col("before") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    return run.filter(F.col("before") < budget).drop("siltstone_h", "siltstone_b", "before")


def even_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows evenly spaced in order: places floor(i * (n - 1) / (k - 1))."""
    from .evalstats import numbered

    n = df.agg(F.count("*").alias("n"))
    places = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(max(k - 1, 1))))).alias("place")).distinct()
    return numbered(df, order).withColumnRenamed("k", "place").join(F.broadcast(places), "place", "left_semi")


def newest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, "x.*")


def shuffled_prompt(text: Column, k: int) -> Column:
    """The words in the order of their hashes with k and their place."""
    words = F.split(text, " ")
    keyed = F.transform(words, lambda w, i: F.struct(F.md5(F.concat_ws(SEPARATOR, F.lit(str(k)), i.cast("string"), w).cast("binary")).alias("h"), i.alias("i"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["w"]), " ")


def over_rank(rows: DataFrame, by: str, score: str, ident: str, most: dict[str, int]) -> DataFrame:
    """The rows beyond the first ``most`` of their group, by score, highest first, then by the smaller id.

    The boundary score of a group is found on counts by score, of which one row a distinct score is
    ordered; among equal scores at the boundary the same is done by id. Groups without a number in
    ``most`` keep all. A null score ranks last.
    """
    limit = F.coalesce(*[F.when(F.col(by) == g, F.lit(n)) for g, n in most.items()], F.lit(None).cast("int"))
    asked = rows.withColumns({"siltstone_most": limit, "siltstone_score": F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))}).filter("siltstone_most is not null")
    counts = asked.groupBy(by, "siltstone_score").agg(F.count("*").alias("n"), F.first("siltstone_most").alias("m"))
    down = Window.partitionBy(by).orderBy(F.desc("siltstone_score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = counts.withColumn("up_to", F.sum("n").over(down)).filter((F.col("up_to") > F.col("m")) & (F.col("up_to") - F.col("n") <= F.col("m")))
    edge = edge.groupBy(by).agg(F.max("siltstone_score").alias("edge"), F.max_by(F.col("m") - F.col("up_to") + F.col("n"), "siltstone_score").alias("room"))
    placed = asked.join(edge, by)
    below = placed.filter(F.col("siltstone_score") < F.col("edge"))
    # ties at the boundary: those that share one score
    tied = Window.partitionBy(by).orderBy(ident)
    ties = placed.filter(F.col("siltstone_score") == F.col("edge")).withColumn("k", F.row_number().over(tied)).filter("k > room").drop("k")
    return below.unionByName(ties).select(rows.columns)
