"""Findings: thresholds, baselines, roll-ups, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import constants as C
from brindle.functions import text as X
from brindle.functions.scoring import rank_of


def at_least(rows: DataFrame, least: str) -> DataFrame:
    """Findings of a severity or worse; unknown severities rank lowest, an unknown limit as medium."""
    return rows.where(rank_of(F.col("severity"), C.SEVERITY, 0) >= C.SEVERITY.get(least, 1))


def rollup(rows: DataFrame) -> DataFrame:
    """Counts by severity, by type, and in total."""
    return rows.groupingSets([[], [F.col("severity")], [F.col("type")]], "severity", "type").agg(F.count("*").alias("n"))


def new_since(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Current findings whose type and file the baseline lacks."""
    return current.join(baseline.select("type", "file").distinct(), ["type", "file"], "left_anti")


def in_edited(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """Findings in files that were edited."""
    return rows.join(edited.select("file").distinct(), "file", "left_semi")


def actionable(current: DataFrame, baseline: DataFrame, new_files: DataFrame, touched: DataFrame | None = None, as_of=None, seconds: int = 1800) -> DataFrame:
    """New findings, without orphans among files that are new themselves.

    ``touched`` (file, mtime): files changed less than ``seconds`` before ``as_of`` count as new too.
    """
    fresh = new_since(current, baseline)
    known = new_files.select("file")
    if touched is not None:
        age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp"))
        known = known.unionByName(touched.where(age < seconds * 1_000_000).select("file"))
    orphans = fresh.where("type = 'orphan_file'").join(known.distinct(), "file", "left_anti")
    return fresh.where("type <> 'orphan_file'").unionByName(orphans.select(*fresh.columns))


def summary(rows: DataFrame, by: str) -> DataFrame:
    """One line by group: severities from worst to best, types in alphabetical order."""
    n = rows.groupBy(by, "type", "severity").agg(F.count("*").alias("n"))
    s = n.groupBy(by, "severity").agg(F.sum("n").alias("n")).groupBy(by).agg(F.collect_list(F.struct((-rank_of(F.col("severity"), C.SEVERITY, 0)).alias("r"), "severity", "n")).alias("x"))
    t = n.groupBy(by, "type").agg(F.sum("n").alias("n")).groupBy(by).agg(F.collect_list(F.struct("type", "n")).alias("y"), F.sum("n").alias("total"))
    left = F.array_join(F.transform(F.array_sort("x"), lambda v: F.concat(v["n"].cast("string"), F.lit(" "), v["severity"])), ", ")
    right = F.array_join(F.transform(F.array_sort("y"), lambda v: F.concat(v["type"], F.lit(":"), v["n"].cast("string"))), ", ")
    return s.join(t, by).select(by, F.concat(F.col("total").cast("string"), F.lit(" ("), left, F.lit("): "), right).alias("line"))


def tension_gate(rows: DataFrame, by: str, least: str, attempts: DataFrame) -> DataFrame:
    """Blocked while findings of a severity remain, unless the retries are used up or the gate is acknowledged.

    attempts: by, attempts and, if gates can be, ``acknowledged``.
    """
    n = at_least(rows, least).groupBy(by).agg(F.count("*").alias("blocking"))
    every = attempts.join(n, by, "left").withColumn("blocking", F.coalesce("blocking", F.lit(0)))
    known = F.coalesce("acknowledged", F.lit(False)) if "acknowledged" in attempts.columns else F.lit(False)
    state = F.when(known, "acknowledged").when(F.col("attempts") >= C.TENSION_RETRIES, "escaped").when(F.col("blocking") == 0, "open").otherwise("blocked")
    return every.select(by, "blocking", state.alias("state"))


def gate_details(rows: DataFrame, by: str, least: str, order: list[str], k: int = 5) -> DataFrame:
    """The first k findings that block a gate, with their description's first 200 characters and missing fields filled."""
    w = W.partitionBy(by).orderBy(*order)
    few = at_least(rows, least).withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)
    text = F.substring(F.coalesce("description", F.lit("")), 1, 200)
    return few.select(by, "place", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("severity", F.lit("unknown")).alias("severity"), text.alias("description"))


def gate_experience(rows: DataFrame, by: str, least: str, order: list[str], attempts: DataFrame) -> DataFrame:
    """What gates teach, once for the project's store and once for everyone's.

    A blocked gate gives one row for each of its first three files; one that opened after
    attempts (by, attempts) gives one row. Columns: by, scope, type, file_pattern, domain, severity.
    """
    blocking = at_least(rows, least).where(F.coalesce("file", F.lit("")) != "")
    w = W.partitionBy(by).orderBy(*order)
    files = blocking.withColumn("r", F.row_number().over(w)).where("r <= 3")
    blocked = files.select(by, F.lit("gate_blocked").alias("type"), X.generalize(F.col("file")).alias("file_pattern"), X.domain(F.col("file")).alias("domain"), F.lit(least).alias("severity"))
    passed = attempts.where("attempts > 0").join(at_least(rows, least).select(by).distinct(), by, "left_anti")
    resolved = passed.select(by, F.lit("gate_resolved").alias("type"), F.concat(F.lit("workflow/"), F.col(by).cast("string")).alias("file_pattern"), F.lit("config").alias("domain"), F.lit("low").alias("severity"))
    return blocked.unionByName(resolved).withColumn("scope", F.explode(F.array(F.lit("project"), F.lit("global"))))


def grade_gate(reports: DataFrame, worst: str = "D", most: int = C.CRITICAL_MOST, open_criticals: int | None = None) -> DataFrame:
    """Whether a grade is worse than allowed or too many findings are critical, and why; unknown grades never block.

    ``open_criticals``: how many open critical security findings (column ``open_criticals``) are let pass, checked first.
    """
    bad = F.coalesce(rank_of(F.col("grade"), C.GRADE) > C.GRADE.get(worst, 3), F.lit(False))
    many = F.coalesce("critical", F.lit(0)) > most
    grade_text = F.when(bad, F.concat(F.lit("debt grade "), F.col("grade"), F.lit(f" is worse than required {worst}")))
    many_text = F.when(many, F.concat(F.col("critical").cast("string"), F.lit(f" critical smells exceed limit of {most}")))
    unsafe = F.lit(False) if open_criticals is None else F.coalesce("open_criticals", F.lit(0)) > open_criticals
    reason = F.when(unsafe, "security_gate_failed").otherwise(F.concat_ws("; ", grade_text, many_text))
    return reports.withColumns({"blocked": unsafe | bad | many, "reason": reason})


def security_counters(scans: DataFrame) -> DataFrame:
    """Scans (critical, high, grade) with something serious, as lines."""
    part = lambda c, name: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(name)))
    line = F.concat(F.lit("Security: "), F.concat_ws(", ", part("critical", " CRITICAL"), part("high", " high")), F.lit(" findings (grade "), F.coalesce("grade", F.lit("?")), F.lit(")"))
    return scans.where("critical > 0 or high > 0").withColumn("line", line)


def analysis_plan(nodes: DataFrame, defaults: list[str], tokens: int = 400) -> DataFrame:
    """Which analyses run at a node and with what budget.

    Input: node, available, switched_on, own_on (all may be null for yes), analyses, token_budget (null: the defaults).
    """
    on = F.coalesce("available", F.lit(True)) & F.coalesce("switched_on", F.lit(True)) & F.coalesce("own_on", F.lit(True))
    wanted = F.coalesce("analyses", F.array(*map(F.lit, defaults)))
    return nodes.select("node", on.alias("runs"), F.when(on, wanted).otherwise(F.array().cast("array<string>")).alias("analyses"), F.when(on, F.coalesce("token_budget", F.lit(tokens))).otherwise(0).alias("token_budget"))


def reindex_plan(changed: DataFrame, by: str, most: int = 20) -> DataFrame:
    """Per project whether its changed files are read one by one (up to ``most``, at least one) or all anew."""
    n = changed.groupBy(by).agg(F.countDistinct("file").alias("changed"))
    return n.withColumn("mode", F.when((F.col("changed") > 0) & (F.col("changed") <= most), "incremental").otherwise("full"))


def impact(rows: DataFrame, by: str, least: int, most: int = 10) -> DataFrame:
    """Distinct files at risk by group, and how many have ``least`` findings or more; the worst ``most`` of these by name."""
    n = rows.groupBy(by, "file").agg(F.count("*").alias("n"))
    w = W.partitionBy(by).orderBy(F.desc("n"), "file")
    ranked = n.withColumn("r", F.row_number().over(w))
    worst = F.array_sort(F.collect_list(F.when((F.col("r") <= most) & (F.col("n") >= least), F.struct("r", "file"))))
    got = ranked.groupBy(by).agg(F.count("*").alias("files"), F.count_if(F.col("n") >= least).alias("over"), F.max("n").alias("most"), worst.alias("x"))
    return got.select(by, "files", F.least("over", F.lit(most)).cast("bigint").alias("details"), "most", F.array_join(F.transform("x", lambda v: v["file"]), ",").alias("worst"))


def skills(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The skill and section for each type of finding that has one; ``more`` holds further types (as of a summary's map)."""
    known = F.create_map(*[F.lit(x) for k, (s, d) in C.SMELL_SKILLS.items() for x in (k, f"{s} {d}")])
    types = rows.select("type") if more is None else rows.select("type").unionByName(more.select("type"))
    return types.distinct().withColumn("skill", F.try_element_at(known, F.col("type"))).where("skill is not null")


def select_skills(nodes: DataFrame, languages: DataFrame, smells: DataFrame, most: int = 5) -> DataFrame:
    """(node, place, skill, section): language skills first, then those of the node's words, then those of its smells.

    nodes: node, text; languages: node, language, seq; smells: node, type, seq. A skill and section counts once.
    """
    lang = languages.select("node", F.lit(0).alias("tier"), F.col("seq").cast("bigint").alias("at"), F.concat("language", F.lit("-patterns")).alias("skill"), F.lit("").alias("section"))
    low = F.lower("text")
    rules = [F.when(low.rlike("|".join(words)), F.struct(F.lit(i).cast("bigint").alias("at"), F.lit(s).alias("skill"), F.lit(d).alias("section"))) for i, (words, s, d) in enumerate(C.NODE_SKILLS)]
    said = nodes.select("node", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("x")).select("node", F.lit(1).alias("tier"), "x.at", "x.skill", "x.section")
    known = F.create_map(*[x for k, (s, d) in C.SMELL_SKILLS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("skill"), F.lit(d).alias("section")))])
    found = smells.select("node", F.lit(2).alias("tier"), F.col("seq").cast("bigint").alias("at"), F.try_element_at(known, F.col("type")).alias("x")).where("x is not null").select("node", "tier", "at", "x.skill", "x.section")
    once = lang.unionByName(said).unionByName(found).groupBy("node", "skill", "section").agg(F.min(F.struct("tier", "at")).alias("first"))
    w = W.partitionBy("node").orderBy("first", "skill", "section")
    return once.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most).select("node", "place", "skill", "section")
