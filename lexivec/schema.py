"""Tables and requests."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENT = "doc_id string, content string, metadata map<string,string>, source string, ingest_seq bigint"
CHUNK = "chunk_id string, doc_id string, content string, embedding array<double>, metadata map<string,string>, start_char int, end_char int, seq bigint"
TRIPLE = "subject string, predicate string, object string, doc_id string, seq bigint"
SCORED = "qid string, chunk_id string, seq bigint, score double, rank int, retrieval_method string"
#: A job's chunks are rows of their own: an ingest may have any number of them.
JOB = "job_id string, status string, n_chunks bigint"
JOB_CHUNK = "job_id string, doc_id string, start_char int, chunk_id string"

STRATEGIES = ("passthrough", "multi_query", "hyde", "step_back", "entity_expand")


#: Replies of the service's calls.
SOURCE = "doc_id string, chunk_id string, content string, score double, metadata map<string,string>"
RANKED = "index int, score double, text string"
HIT = "id bigint, score double"


def differences(df: DataFrame, ddl: str) -> list[tuple[str, str | None, str | None]]:
    """(field, wanted type, found type) wherever a table's schema is not the one wanted; none if it conforms. Order doesn't count."""
    wanted = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl)}
    found = dict(df.dtypes)
    return [(c, wanted.get(c), found.get(c)) for c in sorted({*wanted, *found}) if wanted.get(c) != found.get(c)]


def check_schema(df: DataFrame, ddl: str) -> DataFrame:
    """``df``, if it has that schema."""
    if bad := differences(df, ddl):
        raise ValueError("; ".join(f"{c}: wanted {w}, found {f}" for c, w, f in bad))
    return df


def request_errors(requests: DataFrame, required: tuple[str, ...] = ("query",)) -> DataFrame:
    """``requests`` with ``errors``: the required fields that are null, each as its message. For batches; single requests are parsed below."""
    messages = F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c}: field required")) for c in required])
    return requests.withColumn("errors", F.filter(messages, lambda m: m.isNotNull()))


def check_top_k(top_k: int | None, default: int = 5) -> int:
    """Null means the default; a negative count is refused rather than counted from the end."""
    k = default if top_k is None else top_k
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError(f"top_k must be a count of at least 0, not {top_k!r}")
    return k


@dataclass(frozen=True)
class QueryRequest:
    query: str
    top_k: int = 5
    rewrite_strategies: tuple[str, ...] = ("passthrough",)
    filters: dict = field(default_factory=dict)
    use_graph: bool = True
    stream: bool = False

    @classmethod
    def parse(cls, body: dict) -> QueryRequest:
        """A request from decoded JSON. Unknown fields and a missing query are refused."""
        if not isinstance(body, dict) or not isinstance(body.get("query"), str):
            raise ValueError("query: field required")
        if extra := set(body) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
        own = dict(body)
        own["top_k"] = check_top_k(own.get("top_k"))
        own["rewrite_strategies"] = tuple(own.get("rewrite_strategies") or ("passthrough",))
        if bad := set(own["rewrite_strategies"]) - set(STRATEGIES):
            raise ValueError(f"unknown strategies: {', '.join(sorted(bad))}")
        own["filters"] = {k: v if v is None or isinstance(v, (dict, list)) else str(v) for k, v in (own.get("filters") or {}).items()}
        return cls(**own)


@dataclass(frozen=True)
class IngestRequest:
    source: str
    metadata: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, body: dict) -> IngestRequest:
        if not isinstance(body, dict) or not isinstance(body.get("source"), str):
            raise ValueError("source: field required")
        if extra := set(body) - {"source", "metadata"}:
            raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
        metadata = body.get("metadata") or {}
        if not isinstance(metadata, dict) or any(isinstance(v, (dict, list)) for v in metadata.values()):
            raise ValueError("metadata: an object of plain values required")
        return cls(body["source"], dict(metadata))
