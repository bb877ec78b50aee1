"""Document sources: text folders, Parquet, JSON Lines, Arrow IPC sets, lists and tables."""

from __future__ import annotations

import gzip
import re
import zlib
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.convert import decode_bytes

#: Every source gives these columns; ``ord`` orders the rows of a source, and doc_id those of one ord.
DOCUMENT = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("doc_id", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()),
])
TEXT_FILE = r"(?i)\.(md|markdown|rmd|txt)(\.gz)?$"
MOST_BYTES = 512 << 20


def source_spec(spec: str) -> tuple[str, str]:
    """NAME=FOLDER; a name is a letter and up to 31 letters, digits, - or _."""
    name, eq, folder = spec.partition("=")
    if not eq or not folder or not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]{0,31}", name):
        raise ValueError(f"not NAME=FOLDER: {spec!r}")
    return name, folder


def _in_order(rows: DataFrame, files: list[str]) -> DataFrame:
    """``rows`` (with file_path and block, where its split begins) with ord: files by name, rows as they stand in them.

    Within a split rows are read in order, and a split has fewer rows than bytes.
    """
    plain = sorted({re.sub("^file:/+", "/", unquote(f)) for f in files})
    ranks = rows.sparkSession.createDataFrame([(f, k) for k, f in enumerate(plain)] or [("", 0)], "file_path string, rank long")
    own = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B"))), "file_path"), "^file:/+", "/")
    place = F.col("block") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = rows.withColumn("place", place).withColumn("file_path", own)
    return placed.join(ranks, "file_path", "left").withColumn("ord", F.shiftleft(F.coalesce("rank", F.lit(0).cast("long")), 42) + F.col("place")).drop("rank", "place", "file_path", "block")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())]))
def _opened(content: pd.Series, path: pd.Series) -> pd.DataFrame:
    def one(raw, p):
        raw = bytes(raw)
        if p.lower().endswith(".gz"):
            try:
                raw = gzip.decompress(raw)
            except (OSError, EOFError, zlib.error):
                return None, "bad_gzip"
        return decode_bytes(raw), None

    return pd.DataFrame([one(r, p) for r, p in zip(content, path, strict=True)], columns=["text", "reason"])


def text_folder(spark: SparkSession, name: str, folder: str, recursive: bool = True, exclude: list[str] | None = None) -> DataFrame:
    """The text files of a folder as documents (and reason: why one can't be read), ordered by path; hidden ones are left out."""
    from ..operators.decisions import excluded

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    base = F.regexp_replace("path", "^file:/+", "/")
    root = re.sub("^file:/+", "/", folder.rstrip("/")) + "/"
    rel = F.substr(base, F.instr(base, root) + F.lit(len(root)))
    files = files.select(rel.alias("rel"), "length", "content").filter(F.col("rel").rlike(TEXT_FILE) & ~F.col("rel").rlike(r"(^|/)\."))
    if exclude:
        files = files.filter(~excluded(F.col("rel"), exclude))
    small = F.when(F.col("length") <= MOST_BYTES, F.col("content")).otherwise(F.lit(b""))
    read = files.withColumn("r", _opened(small, F.col("rel")))
    return read.select(
        F.lit(name).alias("source"), F.lit(0).cast("long").alias("ord"), F.regexp_replace("rel", r"(?i)\.gz$", "").alias("doc_id"), F.lit("").alias("title"),
        F.col("r.text").alias("text"), F.lit(None).cast("double").alias("score"), F.when(F.col("length") > MOST_BYTES, "file_too_large").otherwise(F.col("r.reason")).alias("reason"),
    )


def parquet(spark: SparkSession, name: str, path: str, text: str = "text", id_: str | None = None, title: str | None = None, score: str | None = None) -> DataFrame:
    """Parquet with named columns; only these are read."""
    d = spark.read.parquet(path)
    for column in filter(None, (text, score)):
        if column not in d.columns:
            raise ValueError(f"{path} has no column {column!r}")
    ident = F.col(id_).cast("string") if id_ and id_ in d.columns else F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.xxhash64(text))
    order = F.col(id_).try_cast("long") if id_ and id_ in d.columns else F.lit(None).cast("long")
    return d.select(
        F.lit(name).alias("source"), F.coalesce(order, F.xxhash64(ident)).alias("ord"), ident.alias("doc_id"),
        (F.coalesce(F.col(title), F.lit("")) if title and title in d.columns else F.lit("")).alias("title"), F.col(text).alias("text"),
        (F.col(score).cast("double") if score else F.lit(None).cast("double")).alias("score"),
    )


def json_lines(spark: SparkSession, name: str, path: str, text: str = "text", id_: str = "id", title: str = "title") -> DataFrame:
    """JSON Lines, damaged rows and all: reason is invalid_json or missing_text. Blank lines don't count; .gz is read as it is."""
    raw = spark.read.text(path)
    rows = raw.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))
    rows = _in_order(rows, raw.inputFiles()).filter(F.trim("value") != "").select("value", "file", "ord", F.try_parse_json("value").alias("v"))
    get = lambda key: F.try_variant_get("v", f"$['{key}']", "string")
    is_text = F.schema_of_variant(F.try_variant_get("v", f"$['{text}']", "variant")) == "STRING"
    ident = F.coalesce(get(id_), F.concat_ws(":", "file", F.hex(F.xxhash64("value"))))
    reason = F.when(F.col("v").isNull(), "invalid_json").when(~F.coalesce(is_text, F.lit(False)), "missing_text")
    return rows.select(
        F.lit(name).alias("source"), "ord", ident.alias("doc_id"), F.coalesce(get(title), F.lit("")).alias("title"),
        F.when(is_text, get(text)).alias("text"), F.lit(None).cast("double").alias("score"), reason.alias("reason"),
    )


class ArrowSet(DataSource):
    """Folders of Arrow IPC stream or file shards, a partition each: format("siltstone_arrow"), options path and columns."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_arrow"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        first = _shards(self.options["path"])[0]
        found = from_arrow_schema(_reader(first).schema)
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        return T.StructType([f for f in found.fields if not wanted or f.name in wanted])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ArrowReader(self.options["path"], schema.fieldNames())


class _ArrowReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def partitions(self):
        return [InputPartition(p) for p in _shards(self.path)]

    def read(self, partition):
        for batch in _reader(partition.value):
            yield batch.select(self.columns)


def _shards(path: str) -> list[str]:
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    shards = sorted(scheme + f.path if scheme else f.path for f in found if f.extension == "arrow")
    if not shards:
        raise FileNotFoundError(f"no .arrow files in {path}")
    return shards


def _reader(path: str):
    import pyarrow as pa
    import pyarrow.fs as pafs

    fs, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    source = fs.open_input_file(inside)
    try:
        return pa.ipc.open_stream(source)
    except pa.ArrowInvalid:
        file = pa.ipc.open_file(source)
        return pa.RecordBatchReader.from_batches(file.schema, (file.get_batch(i) for i in range(file.num_record_batches)))


def arrow_set(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(ArrowSet)
    return spark.read.format("siltstone_arrow").option("columns", ",".join(columns or [])).load(path)


def ledger(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """A tab-separated list with a header, quotes as they are; of a key the last line counts."""
    d = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    placed = _in_order(d.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block")), d.inputFiles()).withColumnRenamed("ord", "at")
    rest = [c for c in d.columns if c != key]
    return placed.groupBy(key).agg(F.max_by(F.struct(*rest), "at").alias("x")).select(key, "x.*").select(*d.columns)


def required_text(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """JSON Lines of which every row has a text in every field; two rows at least."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    d = spark.read.schema(schema).json(path)
    blank = F.coalesce(*[F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", F.lit(f)) for f in fields])
    n, bad = d.agg(F.count("*"), F.max(blank)).first()
    if bad is not None:
        raise ValueError(f"{path}: a row has no text in {bad!r}")
    if n < 2:
        raise ValueError(f"{path}: two rows are needed")
    return d


def probes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of five columns (category, difficulty, prompt, answer, distractors) or three; # begins a comment line."""
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    p = rows.select(F.split(F.regexp_replace("value", "\t+$", ""), "\t").alias("p"))
    wrong = p.filter(~F.size("p").isin(3, 5)).limit(1).collect()
    if wrong:
        raise ValueError(f"{path}: a line has {len(wrong[0]['p'])} columns")
    five = F.size("p") == 5
    at = lambda k, j: F.when(five, F.get("p", F.lit(k))).otherwise(F.get("p", F.lit(j)) if j is not None else F.lit(""))
    return p.select(at(0, None).alias("category"), at(1, None).alias("difficulty"), at(2, 0).alias("prompt"), at(3, 1).alias("answer"), F.split(at(4, 2), r"\|").alias("distractors"))


# What the columns of association tables are called; the first name that a table has counts.
GWAS_NAMES = {
    "snp": ("snp", "rsid", "variant_id", "markername", "id", "snpid", "variant"),
    "chr": ("chr", "chrom", "chromosome", "#chrom", "#chr", "hg19chrc"),
    "pos": ("bp", "pos", "position", "base_pair_location", "genpos", "bp_hg19"),
    "p": ("p", "pval", "p_value", "pvalue", "p-value", "p.value", "p_bolt_lmm", "log10p", "neglog10p", "mlogp"),
    "beta": ("beta", "b", "effect", "logor", "or"),
    "allele": ("effect_allele", "ea", "a1", "allele1", "alt", "tested_allele", "alt_allele"),
}
# The p-value columns that hold -log10 p.
GWAS_NEGLOG = ("log10p", "neglog10p", "mlogp")
GWAS_NULLS = ("NA", "nan", "NaN", "", ".", "-")


def gwas_columns(columns: list[str]) -> dict[str, str]:
    """Which column of a table is which."""
    by_name = {c.strip().lower(): c for c in reversed(columns)}
    out = {}
    for key, names in GWAS_NAMES.items():
        present = [n for n in names if n in by_name]
        if present:
            out[key] = by_name[present[0]]
    return out


def gwas(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(snp, chromosome, position, strength, beta, allele): strength is -log10 p; rows without a position or a p-value in (0, 1] are left out."""
    d = spark.read.option("sep", sep).option("header", "true").option("quote", "").csv(path)
    names = gwas_columns(d.columns)
    if not {"chr", "pos", "p"} <= set(names):
        raise ValueError(f"{path} has no chromosome, no position or no p-value: {d.columns}")

    def value(key: str):
        if key not in names:
            return F.lit(None).cast("string")
        c = F.trim(F.col(f"`{names[key]}`"))
        return F.when(~c.isin(*GWAS_NULLS), F.replace(c, F.lit(","), F.lit(".")) if sep == ";" else c)

    if names["p"].strip().lower() in GWAS_NEGLOG:
        strength = value("p").try_cast("double")
    else:  # by mantissa and exponent, for p-values below what a double holds
        m, e = F.regexp_extract(value("p"), r"^([0-9.]+)", 1).try_cast("double"), F.regexp_extract(value("p"), r"[eE]([+-]?\d+)$", 1)
        strength = F.when(m > 0, -(F.log10(m) + F.coalesce(e.try_cast("int"), F.lit(0))))
    out = d.select(
        value("snp").alias("snp"),
        F.regexp_replace(F.lower(value("chr")), "^chr", "").alias("chromosome"),
        value("pos").try_cast("double").cast("long").alias("position"),
        strength.alias("strength"),
        value("beta").try_cast("double").alias("beta"),
        value("allele").alias("allele"),
    )
    return out.filter("position is not null and strength >= 0")


def verified(spark: SparkSession, folder: str, expected: dict[str, tuple[int, str]]) -> DataFrame:
    """(name, ok): files against their sizes and SHA-256; names that lead out of the folder are refused."""
    for name in expected:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} leads out of {folder}")
    want = spark.createDataFrame([(n, s, h) for n, (s, h) in expected.items()], "name string, size long, sha string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub("^file:/+", "/", folder.rstrip("/")) + "/"
    path = F.regexp_replace("path", "^file:/+", "/")
    have = files.select(F.substr(path, F.instr(path, root) + F.lit(len(root))).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    return want.join(have, "name", "left").select("name", F.coalesce((F.col("size") == F.col("length")) & (F.col("sha") == F.col("digest")), F.lit(False)).alias("ok"))


def source_table(rows: DataFrame, kinds: tuple[str, ...] = ("site", "github", "pdf", "page")) -> DataFrame:
    """rows(name, kind, url) with fault: what is wrong with each, all at once; repeated rows are left out."""
    fault = (
        F.when(~F.coalesce(F.col("name"), F.lit("")).rlike("^[A-Za-z][A-Za-z0-9_-]{0,63}$"), "bad name")
        .when(~F.coalesce(F.col("kind"), F.lit("")).isin(*kinds), "unknown kind")
        .when(~F.coalesce(F.col("url"), F.lit("")).rlike(r"^https?://[^/\s]+(/\S*)?$"), "bad url")
    )
    return rows.dropDuplicates(["name", "kind", "url"]).withColumn("fault", fault)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension (S11): Parquet, CSV, TSV, JSON Lines, JSON; a NaN in it is null."""
    kind = re.sub(r"(?i)\.gz$", "", path.rstrip("/")).rpartition(".")[2].lower()
    if kind == "parquet":
        d = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        d = spark.read.option("header", "true").option("inferSchema", "true").option("multiLine", "true").option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind in ("jsonl", "ndjson", "json"):
        d = spark.read.option("multiLine", str(kind == "json").lower()).json(path)
    else:
        raise ValueError(f"{path}: no reader for .{kind}")
    return d.select(*[F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in d.dtypes])


def printed_list(value: Column) -> Column:
    """The texts of a list as Python or numpy prints it: ['a', "it's"]."""
    quoted = F.regexp_extract_all(value, F.lit(r"""('(?:[^'\\\\]|\\\\.)*'|"(?:[^"\\\\]|\\\\.)*")""".replace("\\\\\\\\", "\\\\")), F.lit(1))
    return F.transform(quoted, lambda q: F.regexp_replace(F.substr(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))
