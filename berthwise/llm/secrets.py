"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text (its *blob*).  The
ledger is a table of the (blob, rule, version) pairs scanned so far with their findings.
A scan takes the blobs of the versions it is given, drops the pairs that the
ledger has, runs each rule over just the distinct texts that miss its pair, adds one row per
scanned pair to the ledger, found something or not, and joins the findings back to all paths
that hold the blob.  A text copied a thousand times is scanned once; a rule whose
version changes is run again over every blob, and the other rules are not.

Everything is DataFrame code.  Defined cases: a null text is empty; repeated rows
are versions like any other; null paths stay null; an empty table gives an empty result;
extra columns are ignored, whatever their names; texts are scanned whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise.llm.common import empty_if_null, saved


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, not overlapping; a match counts if its ``group`` has
    ``least`` characters or more.  Raise ``version`` with any change."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True
    version: int = 1


# Patterns and lengths of the base kinds, in their order, and public token formats.
RULES = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),       # a run is one match, so shorter runs can be left out at once
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1, base=False),
)
LEDGER = "blob binary, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def blobs(versions: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, text and blob of each version."""
    t = versions.select(*[F.col(c) for c in keep], empty_if_null(text).alias("text"))
    return t.withColumn("blob", F.unhex(F.sha2("text", 256)))


def findings(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, start, end) of each span in distinct (blob, text) rows; code
    points, end exclusive.  Where the rows have ``due``, the kinds to look for, no other rule's pattern is run on them.

    Splitting a text at its matches gives what lies between them, so a running sum of
    the lengths of both places every match.  Only texts with a match are split."""
    t = texts
    for r in rules:
        m = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        if "due" in texts.columns:
            m = F.when(F.array_contains("due", r.kind), m).otherwise(F.array().cast("array<string>"))
        t = t.withColumn(f"_m_{r.kind}", m)
    t = t.where(" or ".join(f"size(_m_{r.kind}) > 0" for r in rules))

    def matches(r: Rule) -> Column:
        m, between = F.col(f"_m_{r.kind}"), F.split("text", r.pattern, -1)
        value = (lambda x: x) if r.group == 0 else (lambda x: F.regexp_extract(x, r.pattern, r.group))
        each = F.transform(F.arrays_zip(m.alias("m"), F.slice(between, F.lit(1), F.size(m)).alias("b")), lambda x: F.struct(
            F.char_length(x["b"]).cast("bigint").alias("before"), F.char_length(x["m"]).cast("bigint").alias("length"),
            (F.char_length(value(x["m"])) >= r.least).alias("ok")))
        return F.when(F.size(m) > 0, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), each.alias("each")))

    found = (t.select("blob", F.explode(F.array_compact(F.array(*[matches(r) for r in rules]))).alias("f"))
             .select("blob", "f.kind", "f.version", F.posexplode("f.each").alias("i", "x"))
             .select("blob", "kind", "version", "i", "x.*"))
    upto = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (found.withColumn("end", F.sum(F.col("before") + F.col("length")).over(upto)).where("ok")
            .select("blob", "kind", "version", (F.col("end") - F.col("length")).alias("start"), "end"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         text: str = "text") -> DataFrame:
    """New ledger rows: the unseen (blob, rule, version) pairs of ``versions`` with their spans."""
    pairs = F.inline(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]))
    b = blobs(versions, [], text)
    if ledger is None:
        distinct = b.distinct()                       # map-side first: a hot blob crosses once a task
        due = distinct.select("blob").select("blob", pairs)
        spans = findings(distinct, rules)
    else:
        seen = ledger.select("blob", "kind", "version").distinct()
        due = saved(b.select("blob").distinct().select("blob", pairs)
                    .join(seen, ["blob", "kind", "version"], "left_anti"), "due")
        # Copies meet map-side; the kinds due join where the texts lie.
        distinct = b.groupBy("blob").agg(F.first("text").alias("text"))
        spans = findings(distinct.join(due.groupBy("blob").agg(F.collect_set("kind").alias("due")), "blob"), rules)
    grouped = spans.groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return due.join(grouped, ["blob", "kind", "version"], "left").select(
        "blob", "kind", "version", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def by_path(versions: DataFrame, ledger: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES,
            text: str = "text") -> DataFrame:
    """``keep`` columns of every version with ``found``, its spans (start, kind order, kind, end) in order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    hits = (ledger.where(F.size("spans") > 0).where(F.col("version") == F.element_at(current, F.col("kind")))
            .select("blob", "kind", F.explode("spans").alias("s"))
            .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
                F.col("s.start").alias("start"), F.element_at(order, F.col("kind")).alias("rank"), "kind",
                F.col("s.end").alias("end")))).alias("found")))
    hits = saved(hits, "findings")                    # a plain exchange below, so a hot blob's paths can be split
    light = blobs(versions, keep, text).drop("text")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return light.join(hits, "blob", "left").select(*keep, F.coalesce("found", none).alias("found"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                  x["end"].cast("string"))), ",")
