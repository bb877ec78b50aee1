"""The corpus build: documents in, a ledger, splits and audit tables out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import convert, text as tx
from ..functions.hashing import content_key, unit
from ..operators import decisions, dedup, keywords, split
from ..operators.evalstats import numbered
from ..operators.items import over_rank
from ..session import staged

NEAR, BOILERPLATE, LANGUAGES = ("group", "drop", "off"), ("strip", "report", "off"), ("en", "any")


@dataclass(frozen=True)
class BuildConfig:
    """What a build does. Reasons of the ledger come in the order of the fields."""

    sample: float = 1.0  # share of documents, by a hash of source and id
    max_doc_chars: int | None = None  # longer texts are cut into documents of their own
    min_chars: int = 200
    language: str = "en"  # or any
    keywords: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    keyword_scope: str = "all"  # web: sources that are not in markdown_sources; none
    markdown_sources: tuple[str, ...] = ()
    keyword_min_hits: int = 3
    keyword_min_distinct: int = 2
    min_score: float | None = None
    boilerplate: str = "strip"  # report: counted but kept; off
    boilerplate_docs: int = 20
    max_docs: dict[str, int] = field(default_factory=dict)
    near_duplicates: str = "group"  # or drop, off
    max_near_documents: int | None = None  # more are refused before near copies are looked for
    similarity: float = dedup.THRESHOLD
    val_fraction: float = 0.05
    val_max_chars: int = 20_000_000
    max_val_group_share: float = 0.25
    seed: str = "58"
    leak_overlap: float = 0.5
    #: Tokens of a text, for the ledger; by default its UTF-8 bytes between a begin and an end.
    tokens: Callable[[Column], Column] = field(default=lambda text: F.octet_length(text).cast("long") + 2)

    def validate(self) -> "BuildConfig":
        faults = []
        if not 0 < self.sample <= 1:
            faults.append("sample must lie in (0, 1]")
        if self.max_doc_chars is not None and self.max_doc_chars < max(self.min_chars, 1):
            faults.append("max_doc_chars must be min_chars or more")
        if self.min_chars < 0:
            faults.append("min_chars must not be negative")
        if not 0 <= self.val_fraction < 1:
            faults.append("val_fraction must lie in [0, 1)")
        if not 0.5 <= self.similarity <= 1:
            faults.append("similarity must lie in [0.5, 1]")
        for name, value, known in (
            ("near_duplicates", self.near_duplicates, NEAR), ("boilerplate", self.boilerplate, BOILERPLATE),
            ("language", self.language, LANGUAGES), ("keyword_scope", self.keyword_scope, keywords.SCOPES),
        ):
            if value not in known:
                faults.append(f"{name} is one of {', '.join(known)}")
        if self.boilerplate_docs < 2:
            faults.append("boilerplate_docs must be 2 or more")
        if any(n < 1 for n in self.max_docs.values()):
            faults.append("max_docs must be positive")
        for term in (*self.keywords, *self.exclude):
            try:
                keywords.Term.parse(term)
            except ValueError as error:
                faults.append(str(error))
        if faults:
            raise ValueError("; ".join(faults))
        return self


def build(docs: DataFrame, config: BuildConfig = BuildConfig(), earlier: DataFrame | None = None) -> dict[str, DataFrame]:
    """docs(source, doc_id, title, text[, score][, ord][, reason]) to docs, ledger, duplicates, boilerplate and leakage.

    doc_id is an integer that orders the documents, or a text as readers give it: then documents are
    ordered by source, ord and doc_id, and the tables have the text again. ``earlier``
    (source, doc_id, content_hash, split) is an earlier build's ledger: documents it had, by id or by
    content, keep their split. A reason that a reader gave is the first.
    """
    config.validate()
    d = docs
    if config.max_doc_chars is not None:
        d = _parts(d, config.max_doc_chars)
    kinds = dict(d.dtypes)
    if kinds["doc_id"] == "string":
        order = ["source", *(["ord"] if "ord" in kinds else []), "doc_id"]
        # every text is read once more under its number; the key is one struct, so that ranges cut it
        named = numbered(d.withColumn("siltstone_key", F.struct(*order)), "siltstone_key").drop("siltstone_key")
        named = staged(named.withColumnRenamed("doc_id", "name").withColumnRenamed("k", "doc_id"), "numbered")
        out = _built(named.drop("name"), config, earlier, named.select("doc_id", "name"))
        return _renamed(out, named.select(F.col("doc_id").alias("number"), "name"))
    return _built(d, config, earlier, None)


def _parts(d: DataFrame, most: int) -> DataFrame:
    """Long texts as several documents: NAME, NAME#2, ... or, where ids are numbers, only by text: those must be named."""
    if dict(d.dtypes)["doc_id"] != "string":
        raise ValueError("max_doc_chars needs ids that are texts: parts are named after them")
    rest = [c for c in d.columns if c not in ("doc_id", "text")]
    cut = d.withColumn("part", F.when(F.length("text") > most, convert.long_parts(most)(F.when(F.length("text") > most, F.col("text")))).otherwise(F.array("text")))
    cut = cut.select(*rest, "doc_id", F.posexplode("part").alias("k", "text"))
    return cut.select(*rest, F.when(F.col("k") > 0, F.concat("doc_id", F.lit("#"), F.lpad((F.col("k") + 1).cast("string"), 6, "0"))).otherwise(F.col("doc_id")).alias("doc_id"), "text")


def _renamed(tables: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    """The tables with names for the numbers of documents."""
    out = {}
    for key, t in tables.items():
        for column in ("doc_id", "id", "kept", "root"):
            if column in t.columns:
                order = t.columns
                t = t.withColumnRenamed(column, "number").join(names, "number", "left").drop("number").withColumnRenamed("name", column).select(order)
        out[key] = t
    if "group" in out["ledger"].columns:
        own = out["ledger"].withColumn("number", F.substring_index("group", ":", -1).cast("long"))
        named = own.join(names, "number", "left")
        label = F.when(F.col("group").isNotNull(), F.concat(F.expr("substring(`group`, 1, length(`group`) - length(cast(number AS string)))"), "name"))
        out["ledger"] = named.withColumn("group", label).select(out["ledger"].columns)
    return out


def _built(docs: DataFrame, config: BuildConfig, earlier: DataFrame | None, names: DataFrame | None) -> dict[str, DataFrame]:
    """Reasons come in their fixed order: the reader's, those of single texts, exact copies, what boilerplate
    leaves too short, the rank cut, near-duplicates. Stages that several others read are written once."""
    raw = docs.withColumnRenamed("text", "siltstone_raw")
    d = tx.computed(raw, "text", tx.repaired(tx.cleaned(F.col("siltstone_raw")))).select(docs.columns)
    known = F.col("reason") if "reason" in docs.columns else F.lit(None).cast("string")
    drawn = unit(config.seed, "sample", F.col("source"), F.col("doc_id")) < config.sample if config.sample < 1 else F.lit(True)
    low = ~decisions.passes_score(F.col("score"), config.min_score) if config.min_score is not None else F.lit(False)
    first = F.coalesce(F.when(~drawn, "not_sampled"), known, F.when(low, "score_below_min"))
    d = d.withColumn("given", first).drop("reason")
    d = tx.computed(d, "head", tx.leading_words(F.col("text"))) if config.language == "en" else d.withColumn("head", F.lit(None))
    early = F.coalesce("given", decisions.reason(F.col("text"), config.min_chars, F.col("head"), english=config.language == "en"))
    d = staged(tx.computed(d, "early", early).drop("given", "head").withColumn("content_hash", content_key(F.col("text"))), "judged")
    if config.keywords and config.keyword_scope != "none":
        scope = ~F.col("source").isin(*config.markdown_sources) if config.keyword_scope == "web" and config.markdown_sources else None
        terms = keywords.keyword_filter(
            d.filter("early is null"), list(config.keywords), list(config.exclude), "doc_id", "text", "title", config.keyword_min_hits, config.keyword_min_distinct, scope
        ).select("doc_id", F.col("score").alias("hits"), F.col("reason").alias("word_reason"))
        d = d.join(terms, "doc_id", "left").withColumn("early", F.coalesce("early", F.when(F.col("word_reason") != "", F.col("word_reason")))).drop("word_reason")
    else:
        d = d.withColumn("hits", F.lit(0).cast("long"))
    # only later copies meet the texts again
    left = d.filter("early is null").select("doc_id", "content_hash")
    late = left.join(left.groupBy("content_hash").agg(F.min("doc_id").alias("first")), "content_hash").filter("doc_id <> first").select("doc_id", "first")
    d = d.join(staged(late, "copies"), "doc_id", "left").withColumn("early", F.coalesce("early", F.when(F.col("first").isNotNull(), "exact_duplicate")))
    d = staged(d, "first")

    kept = d.filter("early is null")
    marked = dedup.candidate_lines(kept, "doc_id", "source") if config.boilerplate != "off" else None
    boiler = staged(dedup.boilerplate(marked, config.boilerplate_docs), "boilerplate") if marked is not None else None
    if config.boilerplate == "strip":
        stripped = dedup.strip_boilerplate(kept, "doc_id", "source", marked=marked, found=boiler)
        kept = kept.drop("text").join(stripped.select(F.col("id").alias("doc_id"), "text", F.col("n_removed")), "doc_id")
    else:
        kept = kept.withColumn("n_removed", F.lit(0).cast("long"))
    kept = kept.withColumn("late", F.when(F.length("text") < max(config.min_chars, 1), "too_short_after_boilerplate"))
    if config.max_docs:
        kept = staged(kept, "ranked")
        density = F.col("hits") / F.sqrt(F.greatest(F.length("text"), F.lit(500)))
        over = over_rank(kept.filter("late is null").select("doc_id", "source", density.alias("score")), "source", "score", "doc_id", config.max_docs)
        kept = kept.join(over.select("doc_id", F.lit(True).alias("over")), "doc_id", "left").withColumn("late", F.coalesce("late", F.when(F.col("over"), "over_max_docs_by_rank"))).drop("over")
    kept = staged(kept, "stripped")

    active = kept.filter("late is null")
    near = None
    if config.near_duplicates == "off":
        rooted = active.withColumn("root", F.col("doc_id"))
    else:
        if config.max_near_documents is not None and (n := active.count()) > config.max_near_documents:
            raise ValueError(f"{n} documents are more than the {config.max_near_documents} that near copies are looked for among")
        signed = staged(dedup.signatures(active, "doc_id", "text"), "signatures")
        rooted = active.join(dedup.clusters(signed, config.similarity).withColumnRenamed("id", "doc_id"), "doc_id")
        near = rooted.filter("doc_id <> root").select("doc_id", "root")
    if config.near_duplicates == "drop":
        rooted = rooted.withColumn("late", F.when(F.col("doc_id") != F.col("root"), "near_duplicate"))
    rooted = staged(rooted, "rooted")

    live = rooted.filter("late is null")
    sources = live.select(F.col("doc_id").alias("root"), F.col("source").alias("root_source"))
    members = live.select("source", F.col("doc_id").alias("id"), "root", F.length("text").cast("long").alias("chars")).join(sources, "root")
    settled = None
    if earlier is not None:
        own = live.select("source", "doc_id", F.col("content_hash").alias("key"), "root")
        own = own.withColumn("id", F.col("doc_id").cast("string")) if names is None else own.join(names, "doc_id").withColumnRenamed("name", "id")
        before = earlier.filter(F.col("split").isin("train", "val")).select("source", F.col("doc_id").cast("string").alias("id"), F.col("content_hash").alias("key"), "split")
        settled = staged(split.previous_split(own.select("source", "id", "key", "root"), before), "settled")
    parts = split.group_split(members, config.val_fraction, config.val_max_chars, config.max_val_group_share, config.seed, settled)
    placed = staged(live.join(parts, ["source", "root"]), "placed")
    leaks = split.overlap(split.ngram_hashes(placed.filter("split = 'val'"), "doc_id", "text"), split.ngram_hashes(placed.filter("split = 'train'"), "doc_id", "text"))
    leaks = staged(leaks, "leaks")
    moved = split.moved_to_train(placed.select(F.col("doc_id").alias("id"), "root", "split"), leaks, settled=None if settled is None else settled.select("root"), least=config.leak_overlap)
    final = staged(placed.drop("split").join(moved.select(F.col("id").alias("doc_id"), "split", "moved"), "doc_id"), "final")

    columns = ["source", "doc_id", "title", "status", "reason", "chars", "tokens", "keyword_hits", "group", "content_hash"]

    def base(f: DataFrame, status: Column, reason: Column, tokens: Column, group: Column) -> DataFrame:
        return f.select(
            "source", "doc_id", "title", status.alias("status"), reason.alias("reason"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), tokens.alias("tokens"),
            F.coalesce("hits", F.lit(0)).alias("keyword_hits"), group.alias("group"), "content_hash",
        )

    book = base(final.join(sources, "root"), F.col("split"), F.lit(""), config.tokens(F.col("text")), F.concat_ws(":", "root_source", "root"))
    none = F.lit(None).cast("string")
    for part, column in ((d.filter("early is not null"), "early"), (kept.filter("late is not null"), "late"), (rooted.filter("late is not null"), "late")):
        book = book.unionByName(base(part, F.lit("skipped"), F.col(column), F.lit(0).cast("long"), none))
    pairs = d.filter("early = 'exact_duplicate'").select(F.lit("exact").alias("kind"), "doc_id", F.col("first").alias("kept"))
    if near is not None:
        pairs = pairs.unionByName(near.select(F.lit("near").alias("kind"), "doc_id", F.col("root").alias("kept")))
    out = {"docs": final, "ledger": book.select(columns), "duplicates": pairs, "leakage": leaks}
    return out if boiler is None else out | {"boilerplate": boiler}
