"""The structured query: seven optional constraints, all of which must hold."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import timedelta
from typing import Any


def split_csv(text: str | None) -> tuple[str, ...]:
    """Comma list option: entries trimmed, empty ones dropped."""
    if text is None:
        return ()
    return tuple(entry.strip() for entry in text.split(",") if entry.strip())


_CLOCK = re.compile(
    r"^(?P<sign>-)?(?:(?P<days>[0-9]+)[.:](?=[0-9]+:[0-9]+:[0-9]+))?(?P<h>[0-9]+):(?P<m>[0-9]+)(?::(?P<s>[0-9]+)(?:\.(?P<f>[0-9]{1,7}))?)?$"
)
_DAYS_AND_CLOCK = re.compile(r"^(?P<sign>-)?(?P<days>[0-9]+)[.](?P<h>[0-9]+):(?P<m>[0-9]+)$")


def parse_duration(text: str | timedelta | None) -> timedelta | None:
    """``[d.]hh:mm[:ss[.f]]``, or a bare number of days; anything else means no constraint."""
    if text is None or isinstance(text, timedelta):
        return text
    try:
        return _duration(text.strip())
    except OverflowError:
        return None


def _duration(text: str) -> timedelta | None:
    if re.fullmatch(r"-?[0-9]+", text):
        return timedelta(days=int(text))
    match = _CLOCK.match(text) or _DAYS_AND_CLOCK.match(text)
    if match is None:
        return None
    parts = match.groupdict()
    days, hours, minutes = int(parts["days"] or 0), int(parts["h"]), int(parts["m"])
    seconds = int(parts.get("s") or 0)
    if hours > 23 and parts.get("s") is not None and parts["days"] is None and parts.get("f") is None:
        # Three numbers with the first too large for hours are days, hours and minutes.
        days, hours, minutes, seconds = hours, minutes, seconds, 0
    if hours > 23 or minutes > 59 or seconds > 59:
        return None
    fraction = (parts.get("f") or "").ljust(7, "0")
    value = timedelta(
        days=days, hours=hours, minutes=minutes, seconds=seconds, microseconds=int(fraction or 0) / 10
    )
    return -value if parts["sign"] else value


def format_duration(value: timedelta | None) -> str | None:
    """``[-][d.]hh:mm:ss[.fffffff]``, the constant duration format."""
    if value is None:
        return None
    sign, value = ("-", -value) if value < timedelta(0) else ("", value)
    hours, rest = divmod(value.seconds, 3600)
    days = f"{value.days}." if value.days else ""
    fraction = f".{value.microseconds * 10:07d}" if value.microseconds else ""
    return f"{sign}{days}{hours:02d}:{rest // 60:02d}:{rest % 60:02d}{fraction}"


@dataclass(frozen=True)
class LogQuery:
    included_categories: tuple[str, ...] = ()
    excluded_categories: tuple[str, ...] = ()
    min_verbosity: str | None = None
    contains_text: str | None = None
    since: timedelta | None = None
    until: timedelta | None = None
    exclude_profile_noise: bool = False

    @property
    def has_time_window(self) -> bool:
        return self.since is not None or self.until is not None

    @classmethod
    def from_options(
        cls,
        category: str | None = None,
        exclude_category: str | None = None,
        min_level: str | None = None,
        contains: str | None = None,
        since: str | timedelta | None = None,
        until: str | timedelta | None = None,
        exclude_profile_noise: bool = False,
    ) -> LogQuery:
        return cls(
            included_categories=split_csv(category),
            excluded_categories=split_csv(exclude_category),
            min_verbosity=min_level,
            contains_text=contains,
            since=parse_duration(since),
            until=parse_duration(until),
            exclude_profile_noise=exclude_profile_noise,
        )

    def to_dict(self) -> dict[str, Any]:
        """The saved filter specification."""
        return {
            "included_categories": list(self.included_categories),
            "excluded_categories": list(self.excluded_categories),
            "min_verbosity": self.min_verbosity,
            "contains_text": self.contains_text,
            "since": format_duration(self.since),
            "until": format_duration(self.until),
            "exclude_profile_noise": self.exclude_profile_noise,
        }

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> LogQuery:
        return cls(
            included_categories=tuple(data.get("included_categories") or ()),
            excluded_categories=tuple(data.get("excluded_categories") or ()),
            min_verbosity=data.get("min_verbosity"),
            contains_text=data.get("contains_text"),
            since=parse_duration(data.get("since")),
            until=parse_duration(data.get("until")),
            exclude_profile_noise=bool(data.get("exclude_profile_noise", False)),
        )


EMPTY_QUERY = LogQuery()
