"""Secret scan with a ledger: texts are addressed by content, and each is scanned once per version of a rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyload.operators.staging import stage


@dataclass(frozen=True)
class Rule:
    """A pattern with its version; a match counts if its group has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# The patterns of the scan. Runs of hex digits and key ids are written with their least length, which gives
# the same matches as dropping shorter ones afterwards.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("bearer", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("hosted", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

LEDGER = "blob string, kind string, version int"


def content_address(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def parts(text: Column, rule: Rule) -> Column:
    """The matches of a rule with the text before each: array of (kind, version, nth, before, match), null without a match.

    The pieces between the matches tell where the matches are, as Spark gives no offsets.
    """
    pattern = F.lit(rule.pattern)
    zipped = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), F.regexp_extract_all(text, pattern, 0).alias("match")),
        lambda part, nth: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("version"),
            nth.alias("nth"),
            F.char_length(part["before"]).alias("before"),
            part["match"].alias("match"),
        ),
    )
    return F.when(text.rlike(rule.pattern), zipped)


def scan_blobs(blobs: DataFrame, seen: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """(blob, kind, version, start, end, match) of (blob, text); offsets are code points, the end excluded.

    ``seen`` is a ledger (blob, kind, version): pairs in it are not scanned again. A blob with nothing left to scan is
    dropped before any pattern runs.
    """
    if seen is None:
        todo = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        done = seen.groupBy(F.col("blob").alias("seen_blob")).agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))
        todo = blobs.join(done, F.col("blob") == F.col("seen_blob"), "left").select(
            "blob", "text", F.coalesce("seen", F.array().cast("array<string>")).alias("seen")
        )
        todo = todo.where(F.size(F.array_except(F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules]), "seen")) > 0)
    none = F.array().cast("array<struct<kind:string,version:int,nth:int,before:int,match:string>>")
    scanned = [
        F.when(~F.array_contains("seen", f"{rule.kind}:{rule.version}"), F.coalesce(parts(F.col("text"), rule), none)).otherwise(none)
        for rule in rules
    ]
    found = todo.select("blob", F.explode(F.concat(*scanned)).alias("p")).where("p.match IS NOT NULL")
    size = F.char_length("p.match")
    before = Window.partitionBy("blob", "p.kind", "p.version").orderBy("p.nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("end", F.sum(F.col("p.before") + size).over(before))
    enough = F.lit(False)
    for rule in rules:
        length = F.char_length(F.regexp_extract("p.match", rule.pattern, rule.group))
        enough = enough | ((F.col("p.kind") == rule.kind) & (length >= rule.least))
    return placed.where(enough).select(
        "blob", "p.kind", "p.version", (F.col("end") - size).cast("long").alias("start"), F.col("end").cast("long").alias("end"), "p.match"
    )


def address(versions: DataFrame, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, blobs): the rows of ``versions`` as a struct with their blob, and each text once."""
    row = F.struct(*[F.col(f"`{name}`") for name in versions.columns if name != text_column])
    blob = content_address(F.col(text_column))
    paths = versions.select(row.alias("row"), blob.alias("blob"))
    blobs = versions.select(blob.alias("blob"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).dropDuplicates(["blob"])
    return paths, blobs


def extend_ledger(blobs: DataFrame, seen: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """The ledger after a scan: every blob with every rule version, and what was there before."""
    pairs = blobs.select("blob", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("p"))
    fresh = pairs.select("blob", "p.kind", "p.version")
    return fresh if seen is None else fresh.unionByName(seen.select("blob", "kind", "version")).distinct()


def summarise(findings: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(blob, kinds, spans): the count of each kind, and the findings in order of start, then of the rules."""
    order = F.array_position(F.array(*[F.lit(rule.kind) for rule in rules]), F.col("kind"))
    return findings.groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("nth"), "kind", "end", "match"))).alias("spans")
    )


def scan_paths(
    versions: DataFrame, text_column: str = "text", seen: DataFrame | None = None, known: DataFrame | None = None, rules: tuple = RULES
) -> DataFrame:
    """(row, blob, spans), one row per row of ``versions``: its secrets by start, an empty list if it has none.

    ``versions`` holds every historical version of every path. Equal texts are one blob and are scanned once;
    ``seen`` and ``known`` are ledger and findings of earlier scans, whose pairs are skipped and whose findings are joined
    back like new ones, those of rules or rule versions no longer in use left out. All of it is Spark SQL. Null texts are the empty blob. Repeated rows are returned as often as they
    occur, null ids like others; an empty table gives an empty result.
    """
    paths, blobs = address(versions, text_column)
    findings = scan_blobs(blobs, seen, rules)
    if known is not None:
        current = F.concat_ws(":", "kind", "version").isin([f"{rule.kind}:{rule.version}" for rule in rules])
        findings = findings.unionByName(known.where(current).select(*findings.columns))
    # Only blobs with findings are written; the join is one of two plain tables, so a blob of very many paths can be split.
    spans = stage(summarise(findings, rules))
    none = F.array().cast("array<struct<start:bigint,nth:bigint,kind:string,end:bigint,match:string>>")
    return paths.join(spans, "blob", "left").select("row", "blob", F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column, kinds: tuple | None = None) -> Column:
    """kind:start:end of each span, joined by commas; of the named kinds only, if any are named."""
    chosen = spans if kinds is None else F.filter(spans, lambda span: span["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])), ",")
