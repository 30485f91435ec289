"""What rules and a profile say about a log, as one narrow table that is landed once.

The table has a row per event: its place, time and severity, a bit for every
rule that it meets, and whether the profile calls it important. Only events
that say something carry their texts. Counts, findings by kind, first failures
and the timeline are all read from this table, so the log is parsed once however
many of them are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.severity import rank_of
from logloom.operators.filters import is_important
from logloom.operators.ordered import BLOCK_ROWS, in_block, with_block
from logloom.operators.semantics import FALLBACKS, FINDING_COLUMNS, fallback_tests, rule_test, with_folded
from logloom.plans.profiles import LogProfile
from logloom.plans.rules import DEFAULT_RULES, SEVERITIES, SemanticRule
from logloom.schema import ORDER_KEYS
from logloom.sources.scratch import settle

# Rules per column of bits.
WORD = 62
TEXTS = ["category", "verbosity", "message"]
FAILURE_COLUMNS = ["line_number", "timestamp", *TEXTS, *FINDING_COLUMNS]


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("bigint"))


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Findings:
    """The landed table, and what its bits stand for: the rules, then the two fallbacks."""

    table: DataFrame
    options: tuple[SemanticRule, ...]

    def _has(self, option: int) -> Column:
        return F.col(f"bits_{option // WORD}").bitwiseAND(F.lit(1 << option % WORD)) != 0

    def _by_urgency(self, options: Sequence[int]) -> list[int]:
        """The options that are failures, the most urgent first, then by rule id."""
        failures = [i for i in options if self.options[i].severity != "low"]
        return sorted(failures, key=lambda i: (-SEVERITIES.index(self.options[i].severity), self.options[i].id))

    def _worst(self, options: Sequence[int]) -> Column:
        """The most urgent of the options that an event meets, else null."""
        tests = [F.when(self._has(i), F.lit(i)) for i in self._by_urgency(options)]
        return F.coalesce(*tests) if tests else F.lit(None).cast("int")

    def counts(self) -> DataFrame:
        """Per source: events, warnings, errors, important events."""
        level = F.col("level")
        return self.table.groupBy("source_id").agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(level == rank_of("warning")).alias("warnings"),
            F.count_if(level >= rank_of("error")).alias("errors"),
            F.count_if("important").alias("important"),
        )

    def kinds(self, *keys: str) -> DataFrame:
        """``kind, count`` of the findings, in all or by ``source_id``; one row of sums per key on the way."""
        sums = self.table.groupBy(*keys).agg(*[F.count_if(self._has(i)).alias(f"_{i}") for i in range(len(self.options))])
        by_kind: dict[str, list[int]] = {}
        for i, option in enumerate(self.options):
            by_kind.setdefault(option.kind, []).append(i)
        rows = [
            F.struct(F.lit(kind).alias("kind"), _sum([F.col(f"_{i}") for i in options]).alias("count"))
            for kind, options in by_kind.items()
        ]
        return sums.select(*keys, F.inline(F.array(*rows))).where("count > 0")

    def first_failure(self) -> DataFrame:
        """Per source the earliest critical finding, else high, else medium, else nothing."""
        return self._first(self.table.withColumn("_worst", self._worst(range(len(self.options)))))

    def first_failure_by_system(self, systems: Sequence[str] = ()) -> DataFrame:
        """First failure per source and subsystem, the part of the kind before the first dot."""
        by_system: dict[str, list[int]] = {}
        for i, option in enumerate(self.options):
            by_system.setdefault(option.kind.split(".")[0], []).append(i)
        parts = [
            F.struct(F.lit(system).alias("system"), self._worst(options).alias("_worst"))
            for system, options in by_system.items()
            if not systems or system in systems
        ]
        if not parts:
            parts = [F.struct(F.lit("").alias("system"), F.lit(None).cast("int").alias("_worst"))]
        return self._first(self.table.select("*", F.inline(F.array(*parts))), "system")

    def _first(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows with ``_worst`` to the first of the highest urgency, by way of a minimum of fixed width."""
        keys = ("source_id", *keys)
        ranks = [len(SEVERITIES) - SEVERITIES.index(option.severity) for option in self.options]
        urgency = F.element_at(F.array(*map(F.lit, ranks)), F.col("_worst") + 1).cast("bigint")
        placed = rows.where(F.col("_worst").isNotNull()).withColumn(
            "_place", F.shiftleft(urgency, 60) + F.col("line_number")
        )
        least = placed.groupBy(*keys).agg(F.min("_place").alias("_place"))
        first = placed.join(least, [*keys, "_place"], "left_semi").dropDuplicates([*keys, "_place"])
        said = F.array(*[F.struct(*[F.lit(getattr(o, _ATTRIBUTES[c])).alias(c) for c in FINDING_COLUMNS]) for o in self.options])
        return first.withColumn("_said", F.element_at(said, F.col("_worst") + 1)).select(
            *keys, *[F.col(f"_said.{c}") if c in FINDING_COLUMNS else F.col(c) for c in FAILURE_COLUMNS]
        )

    def timeline(self, limit: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """Findings and important events by line, the first ``limit`` entries of each source.

        An event is one entry however many rules it meets; ``kinds`` lists them.
        """
        words = [F.col(c) for c in self.table.columns if c.startswith("bits_")]
        said = reduce(lambda a, b: a | b, [word != 0 for word in words])
        kinds = F.array_compact(F.array(*[F.when(self._has(i), F.lit(o.kind)) for i, o in enumerate(self.options)]))
        rows = with_block(self.table.where(said | F.col("important")), block_rows)
        # Top of each block first, so that a dominant source is cut down in parallel.
        rows = rows.withColumn("_place", F.row_number().over(in_block())).where(F.col("_place") <= limit)
        whole = Window.partitionBy("source_id").orderBy("line_number")
        rows = rows.withColumn("_place", F.row_number().over(whole)).where(F.col("_place") <= limit)
        return rows.select(
            *ORDER_KEYS, "timestamp", *TEXTS, F.array_join(kinds, ",").alias("kinds"), F.col("important").alias("is_important")
        )


_ATTRIBUTES = {"rule_id": "id", "kind": "kind", "severity": "severity", "reason": "reason", "confidence": "confidence"}


def judged(events: DataFrame, rules: Sequence[SemanticRule], profile: LogProfile | None) -> DataFrame:
    """``events`` with ``level``, the columns of bits, and ``important``."""
    folded = with_folded(events).withColumn("level", F.col("_rank"))
    met = folded.withColumns({f"_met_{i}": _flag(rule_test(rule)) for i, rule in enumerate(rules)})
    any_rule = reduce(lambda a, b: a | b, [F.col(f"_met_{i}") for i in range(len(rules))], F.lit(False))
    for place, test in enumerate(fallback_tests(), len(rules)):
        met = met.withColumn(f"_met_{place}", ~any_rule & _flag(test))
        any_rule = any_rule | F.col(f"_met_{place}")
    total = len(rules) + len(FALLBACKS)
    words = {
        f"bits_{w // WORD}": _sum(
            [F.when(F.col(f"_met_{i}"), F.lit(1 << i % WORD)).otherwise(0) for i in range(w, min(w + WORD, total))]
        )
        for w in range(0, total, WORD)
    }
    important = _flag(is_important(profile)) if profile is not None else F.lit(False)
    rows = met.withColumns({**words, "important": important})
    return rows.select(*events.columns, "level", *words, "important")


def land_findings(
    events: DataFrame, rules: Sequence[SemanticRule] = DEFAULT_RULES, profile: LogProfile | None = None
) -> Findings:
    """Judge every event and write down the verdicts; continuation lines play no part."""
    rows = judged(events.select(*ORDER_KEYS, "timestamp", *TEXTS), rules, profile)
    words = [c for c in rows.columns if c.startswith("bits_")]
    says = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in words]) | F.col("important")
    rows = rows.withColumns({c: F.when(says, F.col(c)) for c in TEXTS})
    return Findings(settle(rows, "findings"), (*rules, *FALLBACKS))
