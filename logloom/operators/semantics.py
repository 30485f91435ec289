"""Rule-based findings, first failures and the important timeline."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.severity import rank_of, severity_rank
from logloom.functions.text import fold
from logloom.operators.filters import is_important
from logloom.operators.ordered import BLOCK_ROWS, in_block, with_block
from logloom.plans.profiles import LogProfile
from logloom.plans.rules import DEFAULT_RULES, SEVERITIES, SemanticRule
from logloom.schema import ORDER_KEYS

FINDING_COLUMNS = ["rule_id", "kind", "severity", "reason", "confidence"]


def _and(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def rule_test(rule: SemanticRule) -> Column:
    """Rule as one boolean over the folded helper columns."""
    tests = []
    if rule.categories:
        tests.append(F.col("_category").isin(*sorted({name.lower() for name in rule.categories})))
    if rule.min_verbosity is not None:
        tests.append(F.col("_rank") >= rank_of(rule.min_verbosity))
    if rule.message_contains_any:
        tests.append(
            reduce(
                lambda a, b: a | b,
                [F.contains(F.col("_message"), F.lit(term.lower())) for term in rule.message_contains_any],
            )
        )
    tests += [F.contains(F.col("_message"), F.lit(term.lower())) for term in rule.message_contains_all]
    return _and(tests)


# What severe events that no rule matched are called, the stronger first.
FALLBACKS = (
    SemanticRule("fallback.fatal", "runtime.fatal", "critical", "Fatal error"),
    SemanticRule("fallback.error", "runtime.error", "high", "Unclassified error", confidence=0.5),
)


def _finding(rule: SemanticRule) -> Column:
    values = [rule.id, rule.kind, rule.severity, rule.reason, rule.confidence]
    return F.struct(*[F.lit(value).alias(name) for name, value in zip(FINDING_COLUMNS, values)])


def with_folded(events: DataFrame) -> DataFrame:
    """Add the columns that rules are tested on: ``_category``, ``_message``, ``_rank``."""
    return events.withColumns(
        {
            "_category": fold(F.col("category")),
            "_message": fold(F.col("message")),
            "_rank": severity_rank(F.col("verbosity")),
        }
    )


def _with_findings(events: DataFrame, rules: Sequence[SemanticRule]) -> DataFrame:
    """Add array ``_findings``: one entry per matching rule, in rule order."""
    entries = [F.when(rule_test(rule), _finding(rule)) for rule in rules]
    found = F.array_compact(F.array(*entries)) if entries else F.array()
    return with_folded(events).withColumn("_findings", found)


def match_rules(events: DataFrame, rules: Sequence[SemanticRule] = DEFAULT_RULES) -> DataFrame:
    """One row per event and matching rule. Rules are plan-time data, so nothing is joined."""
    found = _with_findings(events, rules)
    return found.select(*events.columns, F.inline("_findings"))


def fallback_tests() -> list[Column]:
    """Tests of ``FALLBACKS`` for events that no rule matched."""
    return [(F.col("_rank") == 5) | F.contains(F.col("_message"), F.lit("fatal error")), F.col("_rank") == 4]


def _fallback() -> Column:
    """For events no rule matched: fatal first, then error, else null."""
    return F.coalesce(*[F.when(test, _finding(rule)) for test, rule in zip(fallback_tests(), FALLBACKS, strict=True)])


def fallback_findings(events: DataFrame, rules: Sequence[SemanticRule] = DEFAULT_RULES) -> DataFrame:
    """Generic findings for severe events that no rule matched."""
    unmatched = _with_findings(events, rules).filter(F.size("_findings") == 0)
    return unmatched.withColumn("_finding", _fallback()).filter(F.col("_finding").isNotNull()).select(
        *events.columns, "_finding.*"
    )


def classify(events: DataFrame, rules: Sequence[SemanticRule] = DEFAULT_RULES) -> DataFrame:
    """Rule findings and fallbacks in one pass over the events."""
    found = _with_findings(events, rules)
    either = F.when(F.size("_findings") > 0, F.col("_findings")).otherwise(F.array_compact(F.array(_fallback())))
    return found.withColumn("_findings", either).select(*events.columns, F.inline("_findings"))


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def _urgency() -> Column:
    """Position in the search order: critical first, then high, then medium; low is never a failure."""
    order = {name: i for i, name in enumerate(reversed(SEVERITIES)) if name != "low"}
    urgency = F.lit(None).cast("int")
    for name, i in order.items():
        urgency = F.when(F.col("severity") == name, F.lit(i)).otherwise(urgency)
    return urgency


def _earliest(findings: DataFrame, *keys: str) -> DataFrame:
    """Earliest finding of the highest urgency per key.

    A narrow pass finds urgency and line, combined map-side; the rows
    themselves are then fetched by that line.
    """
    ranked = findings.withColumn("_urgency", _urgency()).filter(F.col("_urgency").isNotNull())
    # Urgency and line in one number, so that the minimum needs no sort.
    place = F.shiftleft(F.col("_urgency").cast("bigint"), 60) + F.col("line_number")
    best = ranked.groupBy(*keys).agg(F.min(place).alias("_place"))
    return ranked.withColumn("_place", place).join(best, [*keys, "_place"], "left_semi")


def _first_rule(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key when several rules met on the same event: the smallest rule id."""
    columns = ["line_number", "timestamp", "category", "verbosity", "message", *FINDING_COLUMNS]
    picked = F.min(F.struct("rule_id", *[c for c in columns if c != "rule_id"])).alias("_pick")
    return rows.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_pick.{name}").alias(name) for name in columns])


def first_failure(findings: DataFrame) -> DataFrame:
    """Per source the earliest critical finding, else high, else medium, else nothing."""
    return _first_rule(_earliest(findings, "source_id"), "source_id")


def first_failure_by_system(findings: DataFrame, systems: Sequence[str] = ()) -> DataFrame:
    """First failure per source and subsystem, the part of the kind before the first dot."""
    tagged = findings.withColumn("system", F.substring_index("kind", ".", 1))
    if systems:
        tagged = tagged.filter(F.col("system").isin(*systems))
    return _first_rule(_earliest(tagged, "source_id", "system"), "source_id", "system")


def timeline(
    events: DataFrame,
    rules: Sequence[SemanticRule] = DEFAULT_RULES,
    profile: LogProfile | None = None,
    limit: int = 80,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Findings and important events by line, the first ``limit`` entries of each source.

    An event is one entry however many rules it meets; ``kinds`` lists them.
    """
    found = _with_findings(events, rules)
    either = F.when(F.size("_findings") > 0, F.col("_findings")).otherwise(F.array_compact(F.array(_fallback())))
    important = is_important(profile) if profile is not None else F.lit(False)
    entries = found.withColumns({"_findings": either, "is_important": important}).filter(
        (F.size("_findings") > 0) | F.col("is_important")
    )
    rows = with_block(entries, block_rows)
    # Top of each block first, so that a dominant source is cut down in parallel.
    rows = rows.withColumn("_place", F.row_number().over(in_block())).filter(F.col("_place") <= limit)
    whole = Window.partitionBy("source_id").orderBy("line_number")
    rows = rows.withColumn("_place", F.row_number().over(whole)).filter(F.col("_place") <= limit)
    return rows.select(
        *ORDER_KEYS,
        "timestamp",
        "category",
        "verbosity",
        "message",
        F.array_join(F.transform("_findings", lambda f: f["kind"]), ",").alias("kinds"),
        "is_important",
    )
