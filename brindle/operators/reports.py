"""One-line summaries of analyses, checklists and prompt texts, as columns over rows and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import constants as C
from brindle.functions import text as X
from brindle.functions.scoring import rank_of

WORST_FIRST = sorted(C.SEVERITY, key=C.SEVERITY.get, reverse=True)


def first_of(*names: str, otherwise: str = "?") -> Column:
    """The first of several fields that a row has, as text."""
    return F.coalesce(*[F.col(n).cast("string") for n in names], F.lit(otherwise))


def stats_line() -> Column:
    """Over total_files (or totalFiles), grade, codebase_score (or score)."""
    return F.concat(F.lit("Files: "), first_of("total_files", "totalFiles"), F.lit(", Grade: "), first_of("grade"), F.lit(", Score: "), first_of("codebase_score", "score"), F.lit("/100"))


def debt(files: DataFrame, by: str, limit: float = 60) -> DataFrame:
    """Per group its grade and score and how many files score above ``limit``. Input: by, grade, codebase_score, file_score."""
    got = files.groupBy(by).agg(F.max("grade").alias("grade"), F.max("codebase_score").alias("score"), F.count_if(F.col("file_score") > limit).alias("hot"))
    line = F.concat(F.lit("Grade: "), first_of("grade"), F.lit(", Score: "), first_of("score"), F.lit("/100, Hotspots: "), F.col("hot").cast("string"), F.lit(" files"))
    return got.select(by, line.alias("line"))


def severity_parts(counts: dict[str, Column]) -> Column:
    """``2 critical, 1 low`` of counts by severity, worst first, zeros left out."""
    return F.array_join(F.filter(F.array(*[F.when(counts[s] > 0, F.concat(counts[s].cast("string"), F.lit(f" {s}"))) for s in WORST_FIRST]), lambda x: x.isNotNull()), ", ")


def security(findings: DataFrame, by: str) -> DataFrame:
    """Per group: no findings, none of them open, or the open ones with their severities. Input: by, severity, status."""
    got = findings.groupBy(by).agg(F.count("severity").alias("total"), F.count_if(F.col("status") == "open").alias("open"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in WORST_FIRST])
    parts = severity_parts({s: F.col(f"n_{s}") for s in WORST_FIRST})
    open_ones = F.concat(F.lit("Security: "), F.col("open").cast("string"), F.lit(" open findings"))
    line = F.when(F.col("total") == 0, "No security findings").when(F.col("open") == 0, F.concat(F.lit("Security: "), F.col("total").cast("string"), F.lit(" total findings (all resolved/suppressed)")))
    return got.select(by, line.when(parts == "", open_ones).otherwise(F.concat(open_ones, F.lit(" ("), parts, F.lit(")"))).alias("line"))


def tensions(rows: DataFrame, by: str) -> DataFrame:
    """Per group the number of tensions and their counts by type, in alphabetical order."""
    n = rows.groupBy(by, F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    got = n.groupBy(by).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("type", "n"))).alias("x"))
    parts = F.array_join(F.transform("x", lambda v: F.concat(v["n"].cast("string"), F.lit(" "), v["type"])), ", ")
    return got.select(by, F.concat(F.col("total").cast("string"), F.lit(" tensions ("), parts, F.lit(")")).alias("line"))


def fix_line(suggestion: Column, files: Column) -> Column:
    """The first 300 characters of a suggestion and up to three files; null without a suggestion."""
    named = F.when(F.size(files) > 0, F.concat(F.lit(" (files: "), F.array_join(F.slice(files, 1, 3), ", "), F.lit(")"))).otherwise("")
    return F.when(F.coalesce(suggestion, F.lit("")) != "", F.concat(F.substring(suggestion, 1, 300), named))


def mid_phase(current: DataFrame, baseline: DataFrame, by: str, node: Column, tokens: int = 200) -> DataFrame:
    """Per group what is new since the baseline, in half the budget, and how much was left out.

    ``node`` names the group's phase: in one of validation or review all findings count.
    """
    every = current.withColumn("whole", F.lower(F.coalesce(node, F.lit(""))).rlike("validate|review"))
    known = baseline.select("type", "file").distinct().withColumn("old", F.lit(True))
    rows = every.join(known, ["type", "file"], "left").withColumn("keep", F.col("whole") | F.col("old").isNull())
    n = rows.groupBy(by, "type", "severity").agg(F.count_if("keep").alias("n"), F.count_if(~F.col("keep")).alias("noise"))
    got = n.groupBy(by).agg(
        F.sum("n").alias("total"), F.sum("noise").alias("noise_filtered"),
        *[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in WORST_FIRST],
    )
    t = n.groupBy(by, "type").agg(F.sum("n").alias("n")).where("n > 0").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("x"))
    types = F.array_join(F.transform("x", lambda v: F.concat(v["type"], F.lit(": "), v["n"].cast("string"))), ", ")
    line = F.concat(F.col("total").cast("string"), F.lit(" smells ("), severity_parts({s: F.col(f"n_{s}") for s in WORST_FIRST}), F.lit(") — "), types)
    line = F.when(F.col("total") == 0, "No actionable smells detected").otherwise(line)
    half = max(50, tokens * 4 // 2)
    return got.join(t, by, "left").select(by, F.when(F.length(line) > half, F.concat(F.substring(line, 1, half), F.lit("..."))).otherwise(line).alias("smells_summary"), "noise_filtered")


def hook_checklist(entries: DataFrame, by: str, most: int = 8, least: int = 2, enough: int = 5) -> DataFrame:
    """Per group its patterns by occurrences, each with its first description (60 characters). Groups under ``enough`` entries have none.

    Input: by, file_pattern, occurrences, description, seq.
    """
    rich = entries.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= enough).select(by)
    first = F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col("seq")))
    got = entries.where(F.coalesce("file_pattern", F.lit("")) != "").groupBy(by, "file_pattern").agg(F.sum("occurrences").alias("occurrences"), F.min("seq").alias("at"), first.alias("d"))
    w = W.partitionBy(by).orderBy(F.desc("occurrences"), "at")
    got = got.withColumn("place", F.row_number().over(w).cast("bigint")).where((F.col("place") <= most) & (F.col("occurrences") >= least)).join(rich, by, "left_semi")
    return got.select(by, "place", F.concat(F.lit("  - [ ] `"), F.col("file_pattern"), F.lit("` ("), F.col("occurrences").cast("string"), F.lit("x) — "), F.substring(F.coalesce("d", F.lit("")), 1, 60)).alias("line"))


def recent_lines(entries: DataFrame, by: str, n: int = 3) -> DataFrame:
    """Per group its entries of most occurrences as lines. Input: by, file_pattern, type, resolution, occurrences, seq."""
    w = W.partitionBy(by).orderBy(F.desc("occurrences"), "seq")
    few = entries.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= n)
    line = F.concat(F.lit("- `"), F.col("file_pattern"), F.lit("` ("), F.col("type"), F.lit(", ×"), F.col("occurrences").cast("string"), F.lit("): "), F.substring(F.coalesce("resolution", F.lit("")), 1, 80))
    return few.select(by, "place", line.alias("line"))


def checklist_text(task: Column, derived_from: Column, items: Column, notes: Column) -> Column:
    """A checklist as Markdown, cut at a line below 3000 characters.

    items: array of (pattern, description, occurrences, examples), notes: array of texts.
    """

    def entry(x: Column) -> Column:
        head = F.concat(F.lit("- [ ] `"), x["pattern"], F.lit("` — "), x["description"], F.lit(" _(seen "), x["occurrences"].cast("string"), F.lit("x)_"))
        return F.concat(F.array(head), F.transform(F.slice(x["examples"], 1, 2), lambda e: F.concat(F.lit("  - e.g. `"), e, F.lit("`"))))

    lines = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    head = lines(F.concat(F.lit("## Implementation Checklist: "), task), F.concat(F.lit("_Derived from "), derived_from.cast("string"), F.lit(" past experience entries._")), "")
    body = F.when(F.size(items) > 0, F.concat(lines("### Files to create", ""), F.flatten(F.transform(items, entry)))).otherwise(lines("_No recurring patterns found. Proceed without a checklist._"))
    tail = F.when(F.size(notes) > 0, F.concat(lines("", "### Conventions observed", ""), F.transform(notes, lambda n: F.concat(F.lit("- "), n)))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(head, body, tail), "\n")
    return F.when(F.length(whole) > 3000, F.concat(X.cut_lines(whole), F.lit("\n\n_(checklist truncated)_"))).otherwise(whole)


def next_task_text(summary: Column, task: Column, files: Column, saved_at: Column) -> Column:
    """What the last task left for the next one; empty without a summary."""
    more = F.when(F.size(files) > 10, F.concat(F.lit(" (+"), (F.size(files) - 10).cast("string"), F.lit(" more)"))).otherwise("")
    named = F.array_join(F.transform(F.slice(files, 1, 10), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")
    parts = [
        F.lit("## Previous task summary (continuity context)"), F.when(task != "", F.concat(F.lit("**Was:** "), task)), F.btrim(summary, F.lit(" \n\t\r")),
        F.when(F.size(files) > 0, F.concat(F.lit("\n**Files touched last time:** "), named, more)), F.when(saved_at != "", F.concat(F.lit("\n_(saved "), saved_at, F.lit(")_"))),
    ]
    return F.when(F.coalesce(summary, F.lit("")) == "", "").otherwise(F.concat_ws("\n", *parts))


def finding_lines(findings: DataFrame, by: str, prompt: str, order: list[str], k: int = 5) -> DataFrame:
    """Per group the k findings to show: those whose file the prompt (a column) mentions first, then the worst."""
    mentioned = F.exists(X.mentioned_files(F.coalesce(prompt, F.lit(""))), lambda m: F.col("file").contains(m))
    rows = findings.withColumn("in_prompt", mentioned)
    w = W.partitionBy(by).orderBy(F.desc("in_prompt"), F.desc(rank_of(F.col("severity"), C.SEVERITY, -1)), *order)
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)
