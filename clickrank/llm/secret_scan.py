"""Secret scans over content-addressed blobs, with a ledger of what has been scanned by which rule.

A blob is a distinct text, addressed by its SHA-256.  The ledger holds a row for each (blob, rule, version)
ever scanned, with the spans found.  A scan takes the blobs of the input (all paths, all historical versions),
leaves out the pairs in the ledger, runs the remaining rules once per blob, appends the pairs, and joins
the findings back to every path that has the blob.  Copies of a text are scanned once; a rule with a new
version is scanned again, the others are not.  No Python runs on the executors.

Defined results: a null text is an empty blob without findings; null or repeated ids are ordinary rows;
offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import fresh, let, merged_runs, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` has fewer than ``least`` characters drop."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                   r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs of 24 or more: the same spans as the runs that pass the length test
)
#: Kinds that the scan adds: private key blocks and signed web tokens.
MORE_RULES = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*(-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:bigint,end:bigint>"
LEDGER = f"blob string, rule string, spans array<{SPAN}>"


def blob_id(text: str = "text") -> Column:
    return F.sha2(text_or_empty(text), 256)


def find_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>>: positions follow from the lengths of the pieces between the matches."""
    pattern = F.lit(rule.pattern)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def located(x: Column) -> Column:
        pieces = F.transform(x["hit"], lambda m, i: F.struct(
            F.length(F.get(x["gap"], i)).cast("long").alias("gap"), F.length(m).cast("long").alias("n"),
            (F.length(F.get(x["told"], i)) >= rule.least).alias("ok")))
        return F.aggregate(pieces, zero, lambda a, m: F.struct(
            (a["at"] + m["gap"] + m["n"]).alias("at"),
            F.when(m["ok"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["n"]).alias("end")))))
            .otherwise(a["spans"]).alias("spans")))["spans"]

    parts = F.struct(F.split(text, rule.pattern, -1).alias("gap"),
                     F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                     F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("told"))
    return F.when(text.rlike(rule.pattern), let(parts, located)).otherwise(F.array().cast(f"array<{SPAN}>"))


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    if path is None:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_new(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the (blob, rule, version) pairs of ``docs`` that ``ledger`` lacks; one row each."""
    known = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    # copies of a text fold in each map task before they travel, and meet the ledger as one blob
    blobs = docs.select(blob_id().alias("blob"), text_or_empty().alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    done = F.coalesce("done", F.array().cast("array<string>"))
    unseen = blobs.join(known, "blob", "left").where(F.size(done) < len(rules))
    pairs = F.array(*[F.when(~F.array_contains(done, r.name), F.struct(
        F.lit(r.name).alias("rule"), find_spans(F.col("text"), r).alias("spans"))) for r in rules])
    return unseen.select("blob", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).select("blob", "p.*")


def scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """Bring the ledger up to date with ``docs``; returns the ledger and where it is.

    Without a path the ledger is new.  Each call appends only the pairs that weren't in it.
    """
    spark = docs.sparkSession
    new = scan_new(docs, read_ledger(spark, ledger_path), rules)
    path = ledger_path or scratch_path(spark, "secret-ledger")
    new.write.mode("append").parquet(path)
    return read_ledger(spark, path), path


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): the spans of the given rule versions, as kind, start, end, and the kind's place in the list."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))])
    found = ledger.where(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0)).select(
        "blob", F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), order[F.col("rule")].alias("place"), s["end"].alias("end"),
            kind[F.col("rule")].alias("kind"))).alias("spans"))
    return found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                s["end"].cast("string"))), ",")


def report(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of ``docs``."""
    found = findings_by_blob(ledger, rules)
    rows = docs.select("doc_id", blob_id().alias("blob")).join(found, "blob", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>"))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return rows.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
                       F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redact(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """``docs`` with each maximal run of found characters replaced by ``mark``; other texts stay as they are.

    ``n_chars``, if it is there, is brought up to date for the changed texts.
    """
    runs, blob = fresh(docs.columns, "runs"), fresh(docs.columns, "blob")
    each = ledger.where(F.col("rule").isin([r.name for r in rules])).select("blob", F.inline("spans"))
    found = merged_runs(each, "blob").select(F.col("blob").alias(blob), F.col("runs").alias(runs))

    def marked(wide: Column) -> Column:
        """What stands between the runs, cut out of the text at four bytes a character, so that no cut walks the text."""
        def piece(i: Column) -> Column:
            start = F.when(i > 0, F.get(F.col(runs), i - 1)["end"]).otherwise(F.lit(0).cast("long"))
            end = F.when(i < F.size(runs), F.get(F.col(runs), i)["start"]).otherwise(F.octet_length(wide) / 4)
            return F.decode(F.substring(wide, (4 * start + 1).cast("int"), (4 * (end - start)).cast("int")), "UTF-32")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs)), piece), mark)

    out = docs.withColumn(blob, blob_id()).join(found, blob, "left")
    out = out.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(let(F.encode("text", "UTF-32"), marked)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(runs).isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
