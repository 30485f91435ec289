"""Semantic rules: data that says which events mean what."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

# Severities from weakest to strongest.
SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class SemanticRule:
    """A rule; an absent part does not constrain. All text matching ignores letter case."""

    id: str
    kind: str
    severity: str
    reason: str
    categories: tuple[str, ...] = ()
    min_verbosity: str | None = None
    message_contains_any: tuple[str, ...] = ()
    message_contains_all: tuple[str, ...] = ()
    confidence: float = 1.0

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"rule {self.id!r}: severity must be one of {', '.join(SEVERITIES)}")

    @classmethod
    def from_mapping(cls, data: Mapping[str, Any]) -> SemanticRule:
        match = data.get("match") or {}
        return cls(
            id=data["id"],
            kind=data["kind"],
            severity=data["severity"],
            reason=data["reason"],
            categories=tuple(match.get("categories") or ()),
            min_verbosity=match.get("min_verbosity"),
            message_contains_any=tuple(match.get("message_contains_any") or ()),
            message_contains_all=tuple(match.get("message_contains_all") or ()),
            confidence=float(data.get("confidence", 1.0)),
        )


def load_rules(data: Mapping[str, Any] | Iterable[Mapping[str, Any]]) -> tuple[SemanticRule, ...]:
    entries = data.get("rules", ()) if isinstance(data, Mapping) else data
    rules = tuple(SemanticRule.from_mapping(entry) for entry in entries)
    if len({rule.id for rule in rules}) != len(rules):
        raise ValueError("rule ids must be unique")
    return rules


DEFAULT_RULES = (
    SemanticRule(
        id="net.failure",
        kind="network.failure",
        severity="high",
        reason="Connection failed",
        categories=("LogNet", "LogNetTraffic"),
        min_verbosity="Display",
        message_contains_any=("NetworkFailure", "PendingConnectionFailure", "ConnectionTimeout"),
        confidence=0.9,
    ),
    SemanticRule(
        id="session.join",
        kind="online.session",
        severity="high",
        reason="Joining a session failed",
        message_contains_all=("JoinSession", "failed"),
        confidence=0.85,
    ),
    SemanticRule(
        id="login.failed",
        kind="online.login",
        severity="medium",
        reason="Login failed",
        categories=("LogOnline",),
        message_contains_any=("Login failed", "authentication failed"),
        confidence=0.8,
    ),
    SemanticRule(
        id="travel.failure",
        kind="travel.failure",
        severity="high",
        reason="Travel failed",
        categories=("LogTravel", "LogWorld"),
        min_verbosity="Warning",
        confidence=0.6,
    ),
    SemanticRule(
        id="load.failure",
        kind="load.failure",
        severity="medium",
        reason="Loading or streaming failed",
        categories=("LogLoad", "LogStreaming", "LogPakFile"),
        min_verbosity="Warning",
        message_contains_any=("failed", "missing", "could not"),
        confidence=0.7,
    ),
    SemanticRule(
        id="script.error",
        kind="script.error",
        severity="medium",
        reason="Script error",
        categories=("LogScript", "LogBlueprint"),
        min_verbosity="Warning",
        confidence=0.7,
    ),
)
