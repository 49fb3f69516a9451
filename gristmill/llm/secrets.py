"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every historical version of a path is addressed by the SHA-256 of its content
(its *blob*). The ledger holds one row for each blob and rule version that was
ever scanned, with the spans found, also when there were none. A scan runs only
the pairs of blob and rule version that the ledger lacks, once for each blob
however many paths share it, and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import lookup


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds sort. The letter runs state their least length in the
#: pattern itself: a run is matched as a whole, so shorter runs fail either way.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Further kinds, ranked after those above. What may begin anywhere in a long word (a scheme,
#: the first part of a token) is bounded, so that time stays linear in the length of a text.
MORE_RULES = (
    Rule("key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,1000}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("login", 2, r"[a-z][a-z0-9+.-]{0,30}://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]+@"),
)
LEDGER_SCHEMA = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"


def _lengths(values: Column) -> Column:
    return F.transform(values, lambda x: F.length(x).cast("long"))


def _matches(text: str, rule: Rule, hits: str, kept: str) -> Column:
    """Array of (gap, hit, kept): the lengths, in code points, of each match, of the text before it and of its group.

    Java's matcher finds the same leftmost non-overlapping matches when it
    splits the text, so the i-th match follows i + 1 gaps and i matches.
    """
    gaps = F.slice(F.split(F.col(text), rule.pattern, -1), 1, F.size(hits))
    found = F.arrays_zip(_lengths(gaps).alias("gap"), _lengths(F.col(hits)).alias("hit"), _lengths(F.col(kept)).alias("kept"))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<gap:bigint,hit:bigint,kept:bigint>>"))


def with_blob(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """``versions`` with its content address; a null text is the empty blob."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at ``path``, or None before the first scan."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES + MORE_RULES, text_col: str = "text") -> DataFrame:
    """``findings`` of all versions, after what the ledger at ``ledger_path`` lacks was scanned and added to it.

    ``versions`` may hold any number of versions of a path. A scan that failed
    half way adds nothing; one that was added twice does not count twice.
    """
    spark = versions.sparkSession
    scan_new(versions, read_ledger(spark, ledger_path), rules, text_col).write.mode("append").parquet(ledger_path)
    return findings(versions, spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path), rules, text_col)


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, spans) for every pair of blob and rule version not in ``ledger``.

    An empty table, or one whose pairs were all scanned before, gives no rows.
    Texts of any length are scanned whole; a null text is the empty blob; repeated
    rows and other columns, whatever their names, do not matter.
    """
    named = with_blob(versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text")
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        due = named.withColumn("todo", every)
    else:  # what was scanned before goes before any text is shuffled, if the ledger's blobs can be broadcast
        seen = ledger.filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        due = lookup(named, seen, ["blob"]).withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    todo = due.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.least)])
    due = {r: F.array_contains("todo", r.key) for r in rules}
    # Columns of their own, so that no pattern runs twice.
    hits = {f"hit{i}": F.when(due[r], F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))) for i, r in enumerate(rules)}
    kept = {f"kept{i}": F.when(F.size(f"hit{i}") > 0, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))) if r.group else F.col(f"hit{i}") for i, r in enumerate(rules)}
    todo = todo.withColumns(hits).withColumns(kept)
    entries = F.array(*[F.when(due[r], F.struct(F.lit(r.key).alias("rule"), _matches("text", r, f"hit{i}", f"kept{i}").alias("matches"))) for i, r in enumerate(rules)])
    each = todo.select("blob", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("blob", "e.rule", F.posexplode_outer("e.matches").alias("place", "m"))
    # Running lengths over the matches of one text; everything is dealt by blob already.
    upto = Window.partitionBy("blob", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.hit")).over(upto)).withColumn("start", F.col("end") - F.col("m.hit"))
    held = F.when(F.col("m.kept") >= least[F.col("rule")], F.struct("start", "end"))
    return placed.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(held)).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """All columns of ``versions`` but the text, its blob, and found: sorted (start, rank, kind, end).

    Every path of a blob gets all the blob's findings under the given rule
    versions; a path without any gets an empty array. Repeated rows stay repeated.
    Columns of ``versions`` named blob or found are replaced. Spans that begin
    together are in the order of the rules; an empty table gives an empty result.
    """
    rank = {r.key: (i, r.kind) for i, r in enumerate(rules)}
    order = F.create_map(*[F.lit(x) for key, (i, _) in rank.items() for x in (key, i)])
    kind = F.create_map(*[F.lit(x) for key, (_, name) in rank.items() for x in (key, name)])
    per_blob = (
        ledger.filter(F.col("rule").isin(list(rank)) & (F.size("spans") > 0))
        .dropDuplicates(["blob", "rule"])  # a pair that was added twice has the same spans
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("rank"), kind[F.col("rule")].alias("kind"), s["end"].alias("end"))).alias("found"))
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    )
    paths = with_blob(versions.drop("blob", "found"), text_col).drop(text_col)
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return paths.join(per_blob, "blob", "left").withColumn("found", F.coalesce("found", none))
