"""Document sources: text files, inline strings, tables, JSON query sets, stored vector sets; a registry for more."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.sources.archives import read_archives

Loader = Callable[[SparkSession, str], DataFrame]
_loaders: dict[str, Loader] = {}


def loader(name: str) -> Callable[[Loader], Loader]:
    """Register a source under a name."""

    def put(f: Loader) -> Loader:
        _loaders[name] = f
        return f

    return put


def load(spark: SparkSession, kind: str, source: str) -> DataFrame:
    if kind not in _loaders:
        raise KeyError(f"no loader named {kind!r}; there are {', '.join(sorted(_loaders))}")
    return _loaders[kind](spark, source)


def _document(content, source, metadata) -> list:
    return [F.sha2(F.concat_ws("|", source, content), 256).alias("doc_id"), content.alias("content"), metadata.alias("metadata"), source.alias("source")]


def read_text_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One document per text or Markdown file, line ends as newlines.

    ``strict`` fails on bytes that are no UTF-8, as reading them should; otherwise they become U+FFFD. Files of no bytes
    are skipped by the reader.
    """
    if strict:
        raw = spark.read.format("binaryFile").load(path)
        text = F.expr("validate_utf8(cast(content as string))")
        rows = raw.select(text.alias("value"), F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"))
    else:
        raw = spark.read.text(path, wholetext=True)
        rows = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    content = F.regexp_replace("value", "\r\n?", "\n")
    return rows.select(*_document(content, F.col("path"), F.create_map(F.lit("filename"), F.col("name"))))


def read_strings(spark: SparkSession, texts: list[str]) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    return rows.select(*_document(F.col("value"), F.lit("<string>"), F.create_map().cast("map<string,string>")))


def read_table(spark: SparkSession, path: str, text: str = "text", key: str = "doc_id", metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Documents of a Parquet table; metadata columns keep their pushdown as long as they are filtered before this map is built."""
    df = spark.read.parquet(path)
    pairs = [x for c in metadata for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("content"), F.create_map(*pairs).alias("metadata"), F.col("source"))


def read_database(spark: SparkSession, url: str, table: str, text: str = "text", key: str = "doc_id", parts: int = 8, quote: str = '"', properties: dict | None = None) -> DataFrame:
    """Documents of a database table with an integer key, read by ``parts`` connections, each a range of the key. Filters on columns go to the database."""
    options = {"url": url} | (properties or {})
    df = spark.read.format("jdbc").options(dbtable=table, **options).load()
    columns = {c.lower(): c for c in df.columns}  # databases differ in the case of names
    own = f"{quote}{columns[key.lower()]}{quote}"
    low, high = spark.read.format("jdbc").options(query=f"SELECT MIN({own}) AS low, MAX({own}) AS high FROM {table}", **options).load().first()
    if low is not None and parts > 1:
        ranges = {"partitionColumn": columns[key.lower()], "lowerBound": low, "upperBound": high + 1, "numPartitions": parts}
        df = spark.read.format("jdbc").options(dbtable=table, **options, **ranges).load()
    return df.select(F.col(columns[key.lower()]).cast("string").alias("doc_id"), F.col(columns[text.lower()]).alias("content"), F.create_map(F.lit("table"), F.lit(table)).alias("metadata"), F.lit(url).alias("source"))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a store as documents: bytes that are UTF-8 as text, others as base64; the metadata has what they are and how large."""
    raw = spark.read.format("binaryFile").load(path)
    plain = F.expr("is_valid_utf8(cast(content as string))")
    text = F.when(plain, F.col("content").cast("string")).otherwise(F.base64("content"))
    metadata = F.create_map(F.lit("kind"), F.when(plain, "text").otherwise("binary"), F.lit("length"), F.col("length").cast("string"))
    return raw.select(*_document(text, F.col("path"), metadata))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages as documents: tags dropped, the url as source."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    rows = spark.read.parquet(path).select("page_id", "url", clean.alias("content"))
    return rows.select(F.col("page_id").cast("string").alias("doc_id"), "content", F.create_map(F.lit("url"), F.col("url")).alias("metadata"), F.col("url").alias("source"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {query, expected_top_k}."""
    return spark.read.schema("query string, expected_top_k int").json(path, multiLine=True)


_NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.-]*")


def read_vectors(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A stored vector set by name. A name is never a path."""
    if not _NAME.fullmatch(name) or ".." in name:
        raise ValueError(f"not a vector set's name: {name!r}")
    return spark.read.parquet(f"{base}/{name}.parquet")


def list_vectors(spark: SparkSession, base: str) -> list[str]:
    """Names of the stored vector sets; none if the folder is missing. Goes through Hadoop, so any store will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


loader("text")(read_text_files)
loader("string")(lambda spark, source: read_strings(spark, [source]))
loader("table")(read_table)
loader("pages")(read_pages)
loader("blobs")(read_blobs)
loader("archives")(read_archives)
#: A source of this kind is named by a JDBC url and a table, with a space between.
loader("database")(lambda spark, source: read_database(spark, *source.rsplit(" ", 1)))
