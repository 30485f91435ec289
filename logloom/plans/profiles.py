"""Profiles: which categories are noise, what is important."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from logloom.functions.redaction import STANDARD_RULES, RedactionRule


class ProfileError(ValueError):
    """A profile is unknown or incomplete."""


@dataclass(frozen=True)
class LogProfile:
    name: str
    version: str | None = None
    noise_categories: tuple[str, ...] = ()
    important_categories: tuple[str, ...] = ()
    important_patterns: tuple[str, ...] = ()
    output_preferences: Mapping[str, str] = field(default_factory=dict)
    # Field name to a pattern whose first group is the value.
    field_patterns: Mapping[str, str] = field(default_factory=dict)
    # Placeholder name to a pattern of what it stands for in normalized texts.
    dedupe_patterns: Mapping[str, str] = field(default_factory=dict)

    @property
    def normalizing_rules(self) -> tuple[RedactionRule, ...]:
        """The standard redaction, then the profile's own placeholders in their order."""
        own = [RedactionRule(f"<{name}>", f"()(?:{pattern})") for name, pattern in self.dedupe_patterns.items()]
        return (*STANDARD_RULES, *own)

    @classmethod
    def from_mapping(cls, data: Mapping[str, Any], origin: str = "profile") -> LogProfile:
        """Build from any mapping; ``name`` is required, unknown keys are ignored."""
        if not data or data.get("name") is None:
            raise ProfileError(f"{origin} is missing a name")
        version = data.get("version")
        return cls(
            name=str(data["name"]),
            version=None if version is None else str(version),
            noise_categories=tuple(data.get("noise_categories") or ()),
            important_categories=tuple(data.get("important_categories") or ()),
            important_patterns=tuple(data.get("important_patterns") or ()),
            output_preferences=dict(data.get("output_preferences") or {}),
            field_patterns=dict(data.get("field_patterns") or {}),
            dedupe_patterns=dict(data.get("dedupe_patterns") or {}),
        )

    def extend(self, child: LogProfile) -> LogProfile:
        """Inheritance: this profile with the child's entries added, the child's name and preferences winning."""

        def merged(mine: tuple[str, ...], theirs: tuple[str, ...]) -> tuple[str, ...]:
            seen = {entry.lower() for entry in mine}
            return mine + tuple(entry for entry in theirs if entry.lower() not in seen)

        return replace(
            self,
            name=child.name,
            version=child.version if child.version is not None else self.version,
            noise_categories=merged(self.noise_categories, child.noise_categories),
            important_categories=merged(self.important_categories, child.important_categories),
            important_patterns=merged(self.important_patterns, child.important_patterns),
            output_preferences={**self.output_preferences, **child.output_preferences},
            field_patterns={**self.field_patterns, **child.field_patterns},
            dedupe_patterns={**self.dedupe_patterns, **child.dedupe_patterns},
        )


# The two profiles known by name.
BUILT_IN_PROFILES = {
    "ue-default": LogProfile(
        name="ue-default",
        version="1",
        noise_categories=("LogSlate", "LogRHI", "LogRenderer", "LogShaderCompilers"),
        important_categories=("LogOnline", "LogNet", "LogTravel", "LogOutputDevice"),
        important_patterns=("NetworkFailure", "TravelFailure", "JoinSession", "Fatal error"),
        output_preferences={"summary": "compact"},
    ),
    "ue-online": LogProfile(
        name="ue-online",
        version="1",
        noise_categories=("LogSlate", "LogRHI"),
        important_categories=("LogOnline", "LogNet", "LogNetTraffic", "LogTravel"),
        important_patterns=("JoinSession", "NetworkFailure", "Login failed", "PendingConnectionFailure"),
        output_preferences={"summary": "online"},
    ),
}


def load_profile(source: str | Mapping[str, Any]) -> LogProfile:
    """A mapping, the path of a YAML or JSON file, or a built-in name in any letter case.

    An existing file wins over a built-in of the same name.
    """
    if isinstance(source, Mapping):
        return LogProfile.from_mapping(source)
    if os.path.isfile(source):
        return LogProfile.from_mapping(_read_mapping(source), f"profile {source!r}")
    for name, profile in BUILT_IN_PROFILES.items():
        if name.lower() == source.lower():
            return profile
    raise ProfileError(f"unknown profile {source!r}")


def _read_mapping(path: str) -> Mapping[str, Any]:
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)
