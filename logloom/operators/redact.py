"""Redaction of whole events. Stateless, so it serves batch and streams alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.redaction import STANDARD_RULES, RedactionRule, redact_field, redact_text


def redact(events: DataFrame, rules: tuple[RedactionRule, ...] = STANDARD_RULES) -> DataFrame:
    """Redact message, continuation lines and field values; other columns stay, the hash included.

    Columns that the caller has left out are not needed.
    """
    redacted = {
        "message": redact_text(F.col("message"), rules),
        "continuation_lines": F.transform("continuation_lines", lambda line: redact_text(line, rules)),
        "fields": F.transform_values("fields", lambda key, value: redact_field(key, value, rules)),
    }
    return events.withColumns({name: column for name, column in redacted.items() if name in events.columns})


def extract_profile_fields(events: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Add fields found by the profile's own patterns (field name to pattern with one group).

    A pattern that matches sets its field over any value of the same name; one
    that does not match leaves it alone.
    """
    for name, pattern in patterns.items():
        if re.compile(pattern).groups < 1:
            raise ValueError(f"pattern for {name!r} has no group")
    if not patterns:
        return events
    message = F.col("message")
    found = F.map_filter(
        F.create_map(
            *[
                part
                for name, pattern in patterns.items()
                for part in (F.lit(name), F.when(F.rlike(message, F.lit(pattern)), F.regexp_extract(message, pattern, 1)))
            ]
        ),
        lambda _, value: value.isNotNull(),
    )
    events = events.withColumn("_found", found)
    kept = F.map_filter("fields", lambda key, _: ~F.map_contains_key(F.col("_found"), key))
    return events.withColumn("fields", F.map_concat(kept, "_found")).drop("_found")
