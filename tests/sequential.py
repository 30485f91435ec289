"""Plain sequential versions of the ordered operators, one line after the other."""

from __future__ import annotations

import re

EVENT_HEAD = re.compile(
    r"(?:\[\d{4}\.\d\d\.\d\d-\d\d\.\d\d\.\d\d:\d{3}\][^\[]*\[\s*[+-]?\d+\s*\]\s*)?Log\w*\s*:\s*\S"
)


def stitch(texts):
    """List of (line number, raw head, trimmed continuation lines)."""
    events = []
    for number, text in enumerate(texts, 1):
        if not text.strip():
            continue
        follows = events and text[0].isspace() and not EVENT_HEAD.match(text.lstrip())
        if follows:
            events[-1][2].append(text.strip())
        else:
            events.append((number, text, []))
    return events


def bursts(events, window=10_000):
    """Events as (line, key, milliseconds or None) to (line, count)."""
    result, last = [], None
    for line, key, at in events:
        close = last and last[0] == key and at is not None and last[1] is not None and at - last[1] <= window
        if close:
            result[-1][1] += 1
        else:
            result.append([line, 1])
        last = (key, at)
    return [tuple(entry) for entry in result]


def indexed_context(lines, anchors, before, after):
    pairs = set()
    for anchor in anchors:
        at = lines.index(anchor)
        pairs |= {(anchor, line) for line in lines[max(0, at - before) : at + after + 1]}
    return pairs
