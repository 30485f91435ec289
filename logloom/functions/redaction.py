"""Replacing identifiers in text and in extracted fields by placeholders."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RedactionRule:
    """One replacement.

    ``pattern`` is a Java regular expression whose first group is kept.
    ``guard`` is a literal every match contains, in any of the listed
    spellings: a cheap substring test spares the regex on most rows.
    ``field_keys`` are lower-case map keys whose whole value is replaced.
    """

    placeholder: str
    pattern: str
    guard: tuple[str, ...] = ()
    field_keys: tuple[str, ...] = ()


def _labelled(stem: str, tail: str, value: str = "[A-Za-z0-9_-]+") -> str:
    """``<stem><tail>`` followed by ``=`` or ``:`` and an optionally quoted value."""
    first, rest = stem[0], stem[1:]
    return rf'(?U)(\b[{first.upper()}{first}]{rest}{tail}"?\s*(?:=|:)\s*"?){value}'


# The order matters: session before ticket before user.
STANDARD_RULES = (
    RedactionRule("<session_id>", _labelled("session", "(?:Id)?"), ("ession",), ("session", "sessionid")),
    RedactionRule("<ticket_id>", _labelled("ticket", "(?:Id)?"), ("icket",), ("ticket", "ticketid")),
    RedactionRule("<user_id>", _labelled("user", "(?:Id)?"), ("ser",), ("user", "userid")),
)

# Further placeholders, applied only on request.
EXTENDED_RULES = STANDARD_RULES + (
    RedactionRule("<lobby_id>", _labelled("lobby", "(?:Id)?"), ("obby",), ("lobby", "lobbyid")),
    RedactionRule("<entity_id>", _labelled("entity", "(?:Id)?"), ("ntity",), ("entity", "entityid")),
    RedactionRule("<queue_name>", _labelled("queue", "(?:Name)?"), ("ueue",), ("queue", "queuename")),
    RedactionRule(
        "<machine_name>", _labelled("machine", "(?:Name)?", "[A-Za-z0-9_.-]+"), ("achine",), ("machine", "machinename")
    ),
    RedactionRule("<project_name>", _labelled("project", "(?:Name)?"), ("roject",), ("project", "projectname")),
    RedactionRule("<ip_address>", r"(\b)(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", (".",)),
)


def redact_text(text: Column, rules: tuple[RedactionRule, ...] = STANDARD_RULES) -> Column:
    """Apply the rules in order; texts that hold none of their guards are passed through."""
    replaced = text
    for rule in rules:
        replaced = F.regexp_replace(replaced, F.lit(rule.pattern), F.lit("$1" + rule.placeholder))
    if not all(rule.guard for rule in rules):
        return replaced
    words = dict.fromkeys(word for rule in rules for word in rule.guard)
    candidate = reduce(lambda a, b: a | b, [F.contains(text, F.lit(word)) for word in words])
    return F.when(candidate, replaced).otherwise(text)


def redact_field(key: Column, value: Column, rules: tuple[RedactionRule, ...] = STANDARD_RULES) -> Column:
    """Values under an identifying key are replaced whatever they hold."""
    result = redact_text(value, rules)
    for rule in reversed(rules):
        if rule.field_keys:
            result = F.when(F.lower(key).isin(*rule.field_keys), F.lit(rule.placeholder)).otherwise(result)
    return result
