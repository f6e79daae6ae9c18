"""Secret scanning with an incremental blob ledger, in DataFrame and SQL functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds, for each
blob, the rule versions it has been scanned with and the spans each of them found. A run scans only the
(blob, rule version) pairs the ledger lacks, one representative per blob, and joins the findings of the current rule versions
back to every document that holds the blob; spans of versions no longer in use stay in the ledger and are not reported.

Defined cases: a null text is empty and has no spans; a null doc_id stays null; documents with equal
text get equal findings; spans that start together stand in the order of the rules; a very long text is scanned whole, its matches in runs of
``RUN``; repeated rows stay repeated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import durable, full_text, sent


@dataclass(frozen=True)
class Rule:
    """A pattern in Java's syntax. Matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In this order kinds sort where spans start together.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + ADDED_RULES

_PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: Up to the END line; without one, as far as the lines of an encrypted key's head and the base64 run go. Space may be written as an escape.
_PEM_BODY = r"(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
_GAP = r"(?:\s|\\[nrt])"
_PEM_REST = rf"(?:{_GAP}++(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_GAP}++[A-Za-z0-9+/=]{{16,}}+)*+(?:(?:\n|\\n){_GAP}*+[A-Za-z0-9+/=]++(?={_GAP}|$))?+"
#: What is cut out of texts: as RULES, but a private key goes with its body. A finding (RULES, and its SQL) names the BEGIN line alone.
REDACTED_RULES = tuple(Rule("pem", 2, f"{_PEM}(?:{_PEM_BODY}|{_PEM_REST})") if r.kind == "pem" else r for r in RULES)
#: Places in code points and, for cutting, in UTF-8 bytes; ends are exclusive.
PLACE = "start:bigint,end:bigint,first:bigint,last:bigint"
SPAN = f"array<struct<start:bigint,kind:int,{PLACE.split(',', 1)[1]}>>"
FOUND = f"array<struct<rule:string,{PLACE}>>"
LEDGER = f"blob string, rules array<string>, spans {FOUND}"
#: Matches walked together, so that a text with very many does not copy all of them for each. Bytes of a row of unseen blobs.
RUN, UNSEEN = 512, 256


def rule_spans(text: Column, rule: Rule) -> Column:
    """The rule's spans, in order.

    Splitting at the pattern and extracting it walk the same matches, so a match starts where the
    gaps and matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.transform(found, lambda m: F.struct(F.length(m).alias("m"), F.octet_length(m).alias("mb"), F.length(F.regexp_extract(m, rule.pattern, rule.group)).alias("v")))
    ahead = F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.struct(F.length(g).alias("g"), F.octet_length(g).alias("gb")))
    step = F.arrays_zip(sizes.alias("x"), ahead.alias("y"))
    zero = F.lit(0).cast("bigint")

    def walk(acc: Column, i: Column) -> Column:
        def one(own: Column, z: Column) -> Column:
            begin, first = own["at"] + z["y"]["g"], own["bytes"] + z["y"]["gb"]
            end, last = begin + z["x"]["m"], first + z["x"]["mb"]
            span = F.struct(F.lit(rule.name).alias("rule"), begin.alias("start"), end.alias("end"), first.alias("first"), last.alias("last"))
            return F.struct(end.alias("at"), last.alias("bytes"), F.when(z["x"]["v"] >= rule.least, F.concat(own["spans"], F.array(span))).otherwise(own["spans"]).alias("spans"))

        run = F.aggregate(F.slice(step, i * RUN + 1, RUN), F.struct(acc["at"].alias("at"), acc["bytes"].alias("bytes"), F.array().cast(FOUND).alias("spans")), one)
        return F.struct(run["at"].alias("at"), run["bytes"].alias("bytes"), F.concat(acc["runs"], F.array(run["spans"])).alias("runs"))

    start = F.struct(zero.alias("at"), zero.alias("bytes"), F.array().cast(f"array<{FOUND}>").alias("runs"))
    runs = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int"))
    return F.when(text.rlike(rule.pattern), F.aggregate(runs, start, walk, lambda acc: F.flatten(acc["runs"]))).otherwise(F.array().cast(FOUND))


def scan_text(text: Column, rules: tuple[Rule, ...] = RULES, wanted: Column | None = None) -> Column:
    """Spans of all rules (of those in ``wanted``, if given), rule after rule."""
    none = F.array().cast(FOUND)
    parts = [rule_spans(text, r) for r in rules]
    return F.concat(*[p if wanted is None else F.when(F.array_contains(wanted, r.name), p).otherwise(none) for p, r in zip(parts, rules, strict=True)])


def blob_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, blob): which blob each document holds."""
    return docs.select("doc_id", F.sha2(full_text(), 256).alias("blob"))


def scan_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, paths: DataFrame | None = None) -> DataFrame:
    """The ledger's new entries: blobs of ``docs`` with rule versions that it lacks.

    Only ids and digests move until it is known what is unseen. With a ledger, the unseen blobs are counted, and where they are few they go to
    the texts; without one, or where they are many, the texts go to them, by one shuffle. One representative of each is scanned. A blob held by a
    third of all rows is one row after the first partial aggregation.
    """
    paths = blob_paths(docs) if paths is None else paths
    names = F.array(*[F.lit(r.name) for r in rules])
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    if ledger is None:
        unseen = unseen.withColumn("todo", names)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.name for r in rules]))
        seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        unseen = unseen.join(seen, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
        unseen = durable(unseen.where(F.size("todo") > 0).drop("done"))
        unseen = sent(unseen, unseen.count(), UNSEEN)
    texts = docs.select("doc_id", full_text().alias("text")).withColumn("own", F.sha2("text", 256))
    fetched = texts.join(unseen, texts["doc_id"].eqNullSafe(unseen["first_id"]) & (texts["own"] == unseen["blob"]))
    found = fetched.select("blob", F.col("todo").alias("rules"), scan_text(F.col("text"), rules, F.col("todo")).alias("spans"))
    return found.dropDuplicates(["blob"])


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans): what the ledger knows of each document's blob by the rules as they are now, by start, then in the rules' order.

    Blobs without a finding are left out of the join's inner side; a blob that many documents hold makes one
    key heavy on the side that adaptive execution can split.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    current = F.filter("spans", lambda s: F.array_contains(names, s["rule"]))
    some = ledger.select("blob", current.alias("spans")).where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    kind = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (F.array_position(names, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end"), s["first"].alias("first"), s["last"].alias("last")))
    known = some.select("blob", F.array_sort(F.array_distinct(kind)).alias("spans"))
    return paths.join(known, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings per document, ledger entries this run added)."""
    paths = durable(blob_paths(docs))
    added = durable(scan_ledger(docs, ledger, rules, paths))
    known = added if ledger is None else ledger.select(*added.columns).unionByName(added)
    return findings(paths, known, rules), added


#: A table of findings up to this many bytes, as measured, is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its secrets (``REDACTED_RULES``) replaced by ``mark``; clean documents stay as they are.

    Overlapping spans are replaced together. n_chars, if there, follows the text.
    """
    added = durable(scan_ledger(docs, rules=REDACTED_RULES).where(F.size("spans") > 0).select(F.col("blob").alias("__lexivec_blob"), _kept_parts(F.col("spans")).alias("__lexivec_parts")))
    size = added.agg(F.coalesce(F.sum(96 + 32 * F.size("__lexivec_parts")), F.lit(0)).alias("bytes")).first()["bytes"]
    text, raw = F.col("text").cast("string"), F.col("text").cast("string").cast("binary")
    # places are bytes, so each part is copied from where it lies, and all are joined once
    parts = F.transform("__lexivec_parts", lambda p: F.substring(raw, (p["first"] + 1).cast("int"), F.when(p["last"].isNull(), F.octet_length(text)).otherwise(p["last"] - p["first"]).cast("int")).cast("string"))
    known = F.broadcast(added) if size <= BROADCAST_BYTES else added
    joined = docs.withColumn("__lexivec_blob", F.sha2(full_text(), 256)).join(known, "__lexivec_blob", "left")
    masked = joined.withColumn("__lexivec_text", F.when(F.col("__lexivec_parts").isNotNull(), F.array_join(parts, mark)).otherwise(text))
    kept = [F.col("__lexivec_text").alias(c) if c == "text" else F.when(F.col("__lexivec_parts").isNotNull(), F.length("__lexivec_text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return masked.select(*kept)


def _kept_parts(spans: Column) -> Column:
    """What lies between spans, as (first, last) in bytes; the last part goes to the end. Spans that touch others' inside leave nothing between them."""
    at = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))
    zero, part = F.lit(0).cast("bigint"), "array<struct<first:bigint,last:bigint>>"

    def one(own: Column, s: Column) -> Column:
        gap = F.array(F.struct(own["end"].alias("first"), s["first"].alias("last")))
        return F.struct(F.greatest(own["end"], s["last"]).alias("end"), F.when(s["first"] >= own["end"], F.concat(own["parts"], gap)).otherwise(own["parts"]).alias("parts"))

    def walk(acc: Column, i: Column) -> Column:
        run = F.aggregate(F.slice(at, i * RUN + 1, RUN), F.struct(acc["end"].alias("end"), F.array().cast(part).alias("parts")), one)
        return F.struct(run["end"].alias("end"), F.concat(acc["runs"], F.array(run["parts"])).alias("runs"))

    runs = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int"))
    start = F.struct(zero.alias("end"), F.array().cast(f"array<{part}>").alias("runs"))
    return F.aggregate(runs, start, walk, lambda acc: F.concat(F.flatten(acc["runs"]), F.array(F.struct(acc["end"].alias("first"), F.lit(None).cast("bigint").alias("last")))))
