"""A stored index for approximate vector search: k-means cells, product codes of residuals, exact scores at the end.

``build`` trains the cells and the codes on a bounded sample, then every vector is written to the folder of its cell
(``vectors/cell=<n>``) with a code of ``parts`` bytes. A search looks up, for each query, its ``probes`` nearest cells and reads no other folder
(partition pruning); there it reads codes only, keeps the ``refine`` best candidates of each query as it goes, and fetches the vectors of
those alone for their exact scores. A search that keeps all vectors of all cells as candidates scores the vectors right away. Added vectors are assigned to the cells that are there and appended; removed ids are kept aside and left out
of reading, and ``compact`` writes the vectors without them.

Vectors are compared by cosine: they are brought to length 1 before they are assigned and coded. Null and empty vectors
are not indexed; zero vectors are (they score 0); a vector of another length than the index has is refused. Repeated ids are vectors of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions.vector import cosine, has_vector
from lexivec.operators.search import BATCH, _Best, _matrix, piece, top_k, vector_search
from lexivec.schema import check_top_k
from lexivec.workers import ship

#: The model is trained on so many vectors and bytes of them at most, those with the least hashes of their ids.
SAMPLE, SAMPLE_BYTES = 50_000, 64 << 20
#: Rounds of k-means, the most cells, vectors that a file of one cell should hold.
ROUNDS, CELLS, FILE_ROWS = 12, 8192, 1_000_000
#: Vectors of the sample that ask for their neighbours when probes are chosen, neighbours of each, the share of these to be met.
ASKING, NEIGHBOURS, MET = 256, 10, 0.97
#: Rows of a shortlist up to which it is sent to the vectors.
SHORTLIST = 500_000


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row."""
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *[np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)]])


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's rounds from rows drawn at random; a centre that loses all rows moves to the row that lies worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        far = np.argsort(-((x - centres[own]) ** 2).sum(1))[: int((~full).sum())]
        centres[np.flatnonzero(~full)[: len(far)]] = x[far]
    return centres


class Model:
    """Cells and code books. ``edges`` cut a vector's components into parts; each part's residual has a book of up to 256 entries."""

    def __init__(self, cells: np.ndarray, edges: list[int], books: list[np.ndarray], probes: int):
        self.cells, self.edges, self.books, self.probes = cells, edges, books, probes

    @classmethod
    def train(cls, x: np.ndarray, cells: int, parts: int, seed: int) -> Model:
        centres = k_means(x, cells, seed)
        rest = x - centres[nearest(x, centres)]
        edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int).tolist()
        books = [k_means(rest[:, a:b], 256, seed + 1 + i) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        made = cls(centres, edges, books, len(centres))
        made.probes = made.enough(x, seed)
        return made

    def enough(self, x: np.ndarray, seed: int) -> int:
        """How many cells have to be looked at for ``MET`` of the nearest neighbours within the sample. Among all vectors they are nearer, so fewer would do."""
        asking = np.random.default_rng(seed).choice(len(x), min(ASKING, len(x)), replace=False)
        score = x[asking] @ x.T
        score[np.arange(len(asking)), asking] = -np.inf
        k = min(NEIGHBOURS, len(x) - 1)
        if k < 1:
            return len(self.cells)
        cell = nearest(x, self.cells)[np.argpartition(-score, k - 1, axis=1)[:, :k]]
        place = np.argsort(self.order(x[asking]), axis=1)
        return int(np.quantile(np.take_along_axis(place, cell, 1), MET, method="higher")) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code bytes) of unit vectors."""
        cell = nearest(x, self.cells)
        rest = x - self.cells[cell]
        codes = [nearest(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)]
        return cell, np.stack(codes, 1).astype(np.uint8) if codes else np.zeros((len(x), 0), np.uint8)

    def decode(self, cell: int, code: np.ndarray) -> np.ndarray:
        """The vectors that codes of a cell stand for."""
        return self.cells[cell] + np.concatenate([np.zeros((len(code), 0)), *[book[code[:, i]] for i, book in enumerate(self.books)]], 1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """By (query, part, entry): what an entry adds to the product with the query."""
        out = np.zeros((len(q), len(self.books), 256))
        for i, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books, strict=False)):
            out[:, i, : len(book)] = q[:, a:b] @ book.T
        return out

    def order(self, q: np.ndarray) -> np.ndarray:
        """The cells of each query, nearest first."""
        return np.argsort(0.5 * (self.cells**2).sum(1) - q @ self.cells.T, axis=1, kind="stable")

    def rows(self) -> list[tuple]:
        return [("cell", i, c.tolist()) for i, c in enumerate(self.cells)] + [(f"book{p}", i, c.tolist()) for p, book in enumerate(self.books) for i, c in enumerate(book)] + [("edges", 0, [float(e) for e in self.edges]), ("probes", 0, [float(self.probes)])]

    @classmethod
    def of(cls, rows: list[tuple]) -> Model:
        kinds: dict[str, dict] = {}
        for kind, i, values in rows:
            kinds.setdefault(kind, {})[i] = values
        table = {k: np.array([v[i] for i in sorted(v)], np.float64) for k, v in kinds.items()}
        edges = [int(e) for e in table["edges"][0]]
        return cls(table["cell"], edges, [table[f"book{p}"] for p in range(len(edges) - 1)], int(table["probes"][0][0]))


class VectorIndex:
    """An index in a folder. ``versions/<n>`` names the folders of vectors and of removed ids that make it up; a search reads one version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Writing

    def build(self, vectors: DataFrame, cells: int | None = None, parts: int = 16, seed: int = 7) -> VectorIndex:
        """Train on a sample of (chunk_id, seq, embedding) and index every vector. As many cells as the square root of the vectors' number, if not given."""
        some = vectors.where(has_vector(F.col("embedding")))
        n, width = some.agg(F.count("*"), F.max(F.size("embedding"))).first()
        if not n:
            raise ValueError("no vectors to index")
        if cells is not None and cells < 1:
            raise ValueError(f"cells must be 1 or more, not {cells}")
        wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
        place = F.xxhash64("chunk_id")
        bound = min((1 << 63) - 1, int(min(1.0, 4 * wanted / n) * (1 << 64)) - (1 << 63))  # about four times the wanted ones lie under it
        sample = some.where(place <= bound).select("embedding", place.alias("p")).orderBy("p").limit(wanted).select("embedding").toArrow()
        x = unit(_matrix(sample.column(0), width))
        model = Model.train(x, min(CELLS, cells or max(1, round(n**0.5))), parts, seed)
        self.spark.createDataFrame(model.rows(), "kind string, number int, value array<double>").coalesce(1).write.parquet(f"{self.path}/model")
        self._publish(1, {"vectors": [self._write(vectors, model)], "gone": []})
        return self

    def add(self, vectors: DataFrame) -> None:
        """Append vectors to the cells that are there."""
        v, named = self._named()
        self._publish(v + 1, {"vectors": [*named["vectors"], self._write(vectors, self.model())], "gone": named["gone"]})

    def remove(self, ids: DataFrame) -> None:
        """Leave out the vectors of these chunk_ids that are there by now; ones added later stay."""
        v, named = self._named()
        folder = f"gone/{v + 1}-{uuid.uuid4().hex}"
        ids.select("chunk_id").where("chunk_id IS NOT NULL").distinct().write.parquet(f"{self.path}/{folder}")
        self._publish(v + 1, {"vectors": named["vectors"], "gone": [*named["gone"], folder]})

    def compact(self) -> None:
        """Write the vectors that are left, each cell's together."""
        v, _ = self._named()
        folder = f"vectors/{v + 1}-{uuid.uuid4().hex}"
        self._lay_out(self._read(), folder)
        self._publish(v + 1, {"vectors": [folder], "gone": []})

    def _write(self, vectors: DataFrame, model: Model) -> str:
        ship(self.spark)
        width, kind = model.cells.shape[1], dict(vectors.dtypes)["chunk_id"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(2), width)
                if x.shape[1] != width:
                    raise ValueError(f"a vector has {x.shape[1]} components, the index {width}")
                cell, code = model.encode(unit(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))], names=["chunk_id", "seq", "embedding", "code", "cell"])

        rows = vectors.where(has_vector(F.col("embedding"))).select("chunk_id", F.col("seq").cast("bigint").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"))
        folder = f"vectors/{(self._versions() or [0])[-1] + 1}-{uuid.uuid4().hex}"
        self._lay_out(rows.mapInArrow(assign, f"chunk_id {kind}, seq bigint, embedding array<double>, code binary, cell int"), folder)
        return folder

    def _lay_out(self, rows: DataFrame, folder: str) -> None:
        """Cells are dealt out by ranges of (cell, hash), so a cell with very many vectors is written by several tasks and a small one by one."""
        dealt = rows.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell")
        dealt.write.partitionBy("cell").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/{folder}")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, fs = self._at("versions")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit()) if fs.exists(path) else []

    def _named(self, version: int | None = None) -> tuple[int, dict[str, list[str]]]:
        versions = self._versions()
        if not versions:
            raise ValueError(f"no index in {self.path}")
        v = versions[-1] if version is None else version
        path, fs = self._at(f"versions/{v:012d}")
        stream = fs.open(path)
        try:
            return v, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, v: int, named: dict[str, list[str]]) -> None:
        """A version is written aside and renamed into place; of two writers of one version the later is refused."""
        aside, fs = self._at(f"aside/{uuid.uuid4().hex}")
        final, _ = self._at(f"versions/{v:012d}")
        stream = fs.create(aside)
        stream.write(bytearray(json.dumps(named).encode()))
        stream.close()
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(aside, final):
            raise RuntimeError(f"another writer has made version {v} of the index")

    # Reading

    def model(self) -> Model:
        return Model.of([tuple(r) for r in self.spark.read.parquet(f"{self.path}/model").collect()])  # of bounded size, as it was made

    def _read(self, cells: list[int] | None = None) -> DataFrame:
        """(chunk_id, seq, embedding, code, cell) of the vectors that are left, of these cells only."""
        _, named = self._named()
        at = F.regexp_extract("_metadata.file_path", r"/(?:vectors|gone)/(\d+)-", 1).cast("bigint")
        parts = [self.spark.read.parquet(f"{self.path}/{f}") for f in named["vectors"]]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if cells is not None:
            rows = rows.where(F.col("cell").isin(cells))
        if not named["gone"]:
            return rows
        gone = self.spark.read.parquet(*[f"{self.path}/{f}" for f in named["gone"]]).select(F.col("chunk_id").alias("_key"), at.alias("_gone")).groupBy("_key").agg(F.max("_gone").alias("_gone"))
        own = [p.withColumn("_at", F.lit(int(f.split("/")[1].split("-")[0]))) for p, f in zip(parts, named["vectors"], strict=True)]
        rows = own[0]
        for p in own[1:]:
            rows = rows.unionByName(p)
        if cells is not None:
            rows = rows.where(F.col("cell").isin(cells))
        return rows.join(gone, (rows["chunk_id"] == gone["_key"]) & (rows["_at"] < gone["_gone"]), "left_anti").drop("_at")

    def _held(self) -> int:
        """How many vectors there are, with those removed but not yet written out."""
        return sum(self.spark.read.parquet(f"{self.path}/{f}").count() for f in self._named()[1]["vectors"])

    def search(self, queries: DataFrame, k: int | None = 5, probes: int | None = None, refine: int = 10, digits: int = 9) -> DataFrame:
        """(qid, chunk_id, seq, score, rank): of queries (qid, query_vector) the k best by cosine among ``refine`` * k candidates of the ``probes`` nearest cells (as many as training has found enough, if not given)."""
        n = check_top_k(k)
        ids = dict(self.spark.read.parquet(f"{self.path}/{self._named()[1]['vectors'][0]}").dtypes)["chunk_id"]
        asked = queries.where(has_vector(F.col("query_vector"))).select("qid", F.col("query_vector").cast("array<double>").alias("query_vector"))
        kind = dict(asked.dtypes)["qid"]
        if n == 0:
            return self.spark.createDataFrame([], f"qid {kind}, chunk_id {ids}, seq bigint, score double, rank int")
        ship(self.spark)
        model = self.model()
        if (probes or model.probes) >= len(model.cells) and n * refine >= self._held():
            return vector_search(self._read(), asked, n, digits=digits)
        count = asked.count()
        blocks = max(1, -(-count // BATCH))
        own = asked.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
        found = [self._candidates(model, own.where(F.col("_block") == b).drop("_block"), n * refine, probes or model.probes, kind, ids) for b in range(blocks)]
        short = found[0]
        for f in found[1:]:
            short = short.unionByName(f)
        # exact scores: the vectors of the candidates alone, from their cells
        short = short.select("qid", "chunk_id", "seq", "cell")
        short = (F.broadcast(short) if count * n * refine <= SHORTLIST else short).alias("s")
        held = self._read().select("chunk_id", "seq", "cell", "embedding").alias("v")
        met = held.join(short, (F.col("v.cell") == F.col("s.cell")) & (F.col("v.chunk_id") == F.col("s.chunk_id")) & F.col("v.seq").eqNullSafe(F.col("s.seq")))
        met = met.select("s.qid", "v.chunk_id", "v.seq", "v.embedding").join(F.broadcast(asked) if count <= BATCH else asked, "qid")
        return top_k(met.select("qid", "chunk_id", "seq", F.round(cosine(F.col("embedding"), F.col("query_vector")), digits).alias("score")), n)

    def _candidates(self, model: Model, asked: DataFrame, most: int, probes: int, kind: str, ids: str) -> DataFrame:
        """(qid, chunk_id, seq, cell, score): by their codes, the best candidates of a block of at most about ``BATCH`` queries."""
        table = asked.toArrow()
        q = unit(_matrix(table.column(1), model.cells.shape[1]))[:, : model.cells.shape[1]]
        near = model.order(q)[:, :probes]
        of_cell: dict[int, np.ndarray] = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near).tolist()}
        qids = table.column(0).combine_chunks() if table.num_rows else pa.array([])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(q), most)
            for batch in batches:
                cells = batch.column(3).to_numpy()
                for cell in np.unique(cells).tolist():
                    at, who = np.flatnonzero(cells == cell), of_cell.get(cell)
                    if who is None:
                        continue
                    asking, step = q[who], piece(len(who))
                    for i in range(0, len(at), step):
                        part = batch.take(pa.array(at[i : i + step]))
                        code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                        score = asking @ model.decode(cell, code).T
                        held = pa.StructArray.from_arrays([part.column(0), pa.array(np.full(part.num_rows, cell, np.int32))], names=["chunk_id", "cell"])
                        best.add(score, np.ones(score.shape, bool), held, part.column(1).fill_null(0).to_numpy(zero_copy_only=False), who)
            if best.ids is not None:
                yield best.batch(qids, 1)

        codes = self._read(sorted(of_cell)).select("chunk_id", "seq", "code", "cell")
        rough = codes.mapInArrow(scan, f"qid {kind}, chunk_id struct<chunk_id:{ids},cell:int>, seq bigint, score double")
        return top_k(rough, most).select("qid", "chunk_id.chunk_id", "chunk_id.cell", "seq", "score")
