"""Changes to stored tables: upserts, inserts, deletes; documents and their chunks as one table that feeds every index."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.operators.graph import KEY
from lexivec.schema import JOB, JOB_CHUNK


def one_per_key(rows: DataFrame, keys: list[str], last: bool, order: str = "seq") -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, new: DataFrame, on_conflict: str = "replace", key: str = "chunk_id") -> DataFrame:
    """One row per key. ``replace``: the batch's last row takes the place of a stored one, at the batch's seq;
    ``ignore``: a stored row stays, and of a new key the batch's first."""
    if on_conflict == "replace":
        fresh = one_per_key(new, [key], last=True)
        return base.join(fresh.select(key), key, "left_anti").select(*base.columns).unionByName(fresh.select(*base.columns))
    if on_conflict == "ignore":
        fresh = one_per_key(new.join(base.select(key), key, "left_anti"), [key], last=False)
        return base.unionByName(fresh.select(*base.columns))
    raise ValueError(f"on_conflict must be 'replace' or 'ignore', not {on_conflict!r}")


def insert_triples(base: DataFrame, new: DataFrame) -> DataFrame:
    """New (subject, predicate, object) only; the first of each, whatever its document."""
    return base.unionByName(new_triples(base, new))


def new_triples(base: DataFrame, new: DataFrame) -> DataFrame:
    """Those of ``new`` that ``base`` lacks."""
    return one_per_key(new.join(base.select(*KEY), KEY, "left_anti"), KEY, last=False).select(*base.columns)


def delete_documents(rows: DataFrame, gone: DataFrame | list | str | int) -> DataFrame:
    """Without the rows of a document, a list of them, or all doc_ids of a table. Unknown ids change nothing."""
    if isinstance(gone, DataFrame):
        return rows.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*rows.columns)
    ids = gone if isinstance(gone, list) else [gone]
    return rows.where(~F.col("doc_id").isin(ids) | F.col("doc_id").isNull())


def list_documents(docs: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, metadata[, n_chunks])."""
    out = docs.select("doc_id", "source", "metadata")
    if chunks is None:
        return out
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return out.join(n, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("bigint")))


class Corpus:
    """Documents, chunks, triples and ingest jobs as Parquet tables under one folder.

    A version is a file ``commits/<number>`` that names the folders of each table. It is written aside and renamed, so a write that fails half way
    changes nothing and the version before stays; of two writers of the same version, the later is refused. Tables that a commit doesn't change, and
    rows it appends to, are named again, not written again. Readers of a version keep reading it until ``vacuum``.

    Changed and deleted rows are not written again either: a commit writes the new rows and, beside them, the keys that are gone
    (folders ``<table>.gone.<column>``). A key is gone from what older commits wrote, never from its own commit's rows; readers leave such rows out by an
    anti-join. So a commit costs what it changes. ``compact`` writes tables whole again, once many folders have come together. A null key is never gone.
    """

    TABLES = {
        "documents": "doc_id string, content string, metadata map<string,string>, source string, ingest_seq bigint",
        "chunks": "chunk_id string, doc_id string, content string, embedding array<double>, metadata map<string,string>, start_char int, end_char int, seq bigint",
        "triples": "subject string, predicate string, object string, doc_id string, seq bigint",
        "jobs": JOB,
        "job_chunks": JOB_CHUNK,
    }
    #: What tells rows of a table apart, and which of a batch's rows with one key is the last.
    KEYS = {"documents": ("doc_id", "ingest_seq"), "chunks": ("chunk_id", "seq")}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._at("commits")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _folders(self, v: int) -> dict[str, list[str]]:
        """The folders of each table at a version."""
        if v == 0:
            return {name: [] for name in self.TABLES}
        path, fs = self._at(f"commits/{v:012d}")
        stream = fs.open(path)
        try:
            return {name: [] for name in self.TABLES} | json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        schema, folders = self.TABLES[name], self._folders(self.version() if version is None else version)[name]
        written, gone = [f for f in folders if ".gone." not in f], [f for f in folders if ".gone." in f]
        if not written:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in written])
        if not gone:
            return rows
        columns, at = rows.columns, F.regexp_extract("_metadata.file_path", r"/data/(\d+)-[0-9a-f]{32}/[^/]*/[^/]*$", 1).cast("bigint")
        rows = rows.withColumn("_at", at)
        for key in sorted({f.rsplit(".", 1)[1] for f in gone}):
            marks = self.spark.read.schema(f"{key} string").parquet(*[f"{self.path}/{f}" for f in gone if f.endswith(f".gone.{key}")])
            marks = marks.select(F.col(key).alias("_key"), at.alias("_gone")).groupBy("_key").agg(F.max("_gone").alias("_gone"))
            rows = rows.join(marks, (rows[key] == marks["_key"]) & (rows["_at"] < marks["_gone"]), "left_anti")
        return rows.select(*columns)

    def commit(self, append: dict[str, DataFrame] | None = None, gone: dict[tuple[str, ...], DataFrame] | None = None, **tables: DataFrame) -> int:
        """Write the given tables whole, the appended rows and the keys that are gone beside what is there, then name the new version.

        ``gone`` has, by the names of the tables they are gone from, keys as the only column of a table, named as there.
        """
        v = self.version() + 1
        named, own = self._folders(v - 1), f"data/{v}-{uuid.uuid4().hex}"
        for name, df in [*tables.items(), *(append or {}).items()]:
            columns = [c.split()[0] for c in self.TABLES[name].replace("map<string,string>", "map").split(", ")]
            df.select(*columns).write.parquet(f"{self.path}/{own}/{name}")
            named[name] = [*(named[name] if name not in tables else []), f"{own}/{name}"]
        for names, keys in (gone or {}).items():
            (key,) = keys.columns
            folder = f"{own}/{'-'.join(names)}.gone.{key}"
            keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string")).distinct().write.parquet(f"{self.path}/{folder}")
            for name in names:
                named[name] = [*named[name], folder]
        self._publish(v, named)
        return v

    def upsert(self, on_conflict: str = "replace", **batches: DataFrame) -> int:
        """Documents or chunks that take the place of stored ones (``replace``), or come in where their key is new (``ignore``)."""
        append, gone = {}, {}
        for name, new in batches.items():
            key, order = self.KEYS[name]
            if on_conflict == "replace":
                append[name] = one_per_key(new, [key], last=True, order=order)
                gone[(name,)] = new.select(key)
            elif on_conflict == "ignore":
                append[name] = one_per_key(new.join(self.table(name).select(key), key, "left_anti"), [key], last=False, order=order)
            else:
                raise ValueError(f"on_conflict must be 'replace' or 'ignore', not {on_conflict!r}")
        return self.commit(append=append, gone=gone)

    def compact(self, folders: int = 8) -> int:
        """Write those tables whole that ``folders`` folders or more make up, so that readers have no keys to leave out; the version, new or as it was."""
        named = self._folders(self.version())
        many = [n for n, own in named.items() if len(own) >= folders]
        return self.commit(**{n: self.table(n) for n in many}) if many else self.version()

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back, for rows that several tables of one commit are made from. ``vacuum`` removes it."""
        path = f"{self.path}/data/staged-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _publish(self, v: int, named: dict[str, list[str]]) -> None:
        aside, fs = self._at(f"aside/{uuid.uuid4().hex}")
        final, _ = self._at(f"commits/{v:012d}")
        stream = fs.create(aside)
        stream.write(bytearray(json.dumps(named).encode()))
        stream.close()
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(aside, final):
            raise RuntimeError(f"another writer has made version {v}; nothing was changed")

    def vacuum(self, keep: int = 1) -> None:
        """Forget all versions but the last ``keep``, and remove folders that those don't name. Not while a commit is under way."""
        kept = self.versions()[-keep:]
        named = {f.split("/")[1] for v in kept for folders in self._folders(v).values() for f in folders}
        for name, unwanted in (("commits", lambda n: n.isdigit() and int(n) not in kept), ("data", lambda n: n not in named), ("aside", lambda n: True)):
            path, fs = self._at(name)
            for x in fs.listStatus(path) if fs.exists(path) else []:
                if unwanted(x.getPath().getName()):
                    fs.delete(x.getPath(), True)

    def next_seq(self) -> int:
        top = self.table("chunks").agg(F.max("seq")).first()[0]
        return 0 if top is None else top + 1

    def delete(self, doc_ids: DataFrame | list[str]) -> None:
        """From every table at once, by their ids alone; unknown ids succeed."""
        if not isinstance(doc_ids, DataFrame):
            ids = [doc_ids] if isinstance(doc_ids, str) else doc_ids
            doc_ids = self.spark.createDataFrame([(str(i),) for i in ids], "doc_id string")
        self.commit(gone={("documents", "chunks", "triples"): doc_ids.select("doc_id")})
