"""Which candidates become spans: beside a plain walk of the trees and a plain choice among overlaps."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import pii_boost
from logloom.llm.pii_boost import FEATURES, KINDS, SIZES, Fit, Model


def texts(n=400, seed=3):
    rng = random.Random(seed)

    def card():
        digits = [rng.randrange(10) for _ in range(15)]
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
        return "".join(map(str, digits)) + str(-total % 10)

    out = []
    for i in range(n):
        octets = ".".join(str(rng.randrange(256)) for _ in range(4))
        kinds = [f"mail user{i}@site{i % 7}.org", f"host {octets}", f"card {card()}", f"tel +44 20 7946 {rng.randrange(1000, 9999)}",
                 f"id {rng.randrange(10**14, 10**15)}", "300.400.1.1", "plain words only", "see a at b", f"{card()[:12]}"]
        out.append(" and ".join(rng.sample(kinds, 3)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    twice = "4465758382889437 4465758382889437"
    more = [f"paid with {twice} today", "write to jane (at) example (dot) org please", "server 10[.]1[.]2[.]3 is down", None, ""]
    rows = list(enumerate(texts() + more))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii_spans", F.lit("own"))


def margin(model, c):
    total = model.base
    for feature, cut, leaf in model.trees:
        k = 0
        while k < len(feature):
            k = 2 * k + (2 if c[FEATURES[feature[k]]] > cut[k] else 1)
        total += leaf[k - len(feature)]
    return total


def meet(a, b):
    return a[0] < b[1] and b[0] < a[1]


def chosen(model, base, candidates):
    """The surest first, then the longer, then the earlier; none over another or over a base span."""
    rated = []
    for c in candidates:
        m = margin(model, c)
        if c["valid"] == 1 and m >= model.thresholds[c["kind"]]:
            rated.append((-m, c["start"] - c["end"], c["start"], c["kind"], c["end"]))
    taken = [(b["start"], b["end"]) for b in base]
    free = [r for r in sorted(rated) if not any(meet((r[2], r[4]), t) for t in taken)]
    spans = [(b["start"], b["kind"], b["end"]) for b in base]
    own = []
    for _, _, start, kind, end in free:
        if not any(meet((start, end), o) for o in own):
            own.append((start, end))
            spans.append((start, kind, end))
    return sorted(spans)


def test_selection_like_a_plain_one(table):
    spans = pii_boost.with_spans(table)
    model = pii_boost.learn(spans)
    assert model.trees and any(np.isfinite(model.thresholds))
    given = {r["doc_id"]: r for r in spans.collect()}
    for r in pii_boost.find(table).collect():
        own = given[r["doc_id"]]
        assert [tuple(s) for s in r["pii_spans"]] == chosen(model, own["pii_base"], own["pii_candidates"])


def test_what_the_base_rules_miss(table):
    rows = {r["doc_id"]: r for r in pii_boost.find(table).where("doc_id >= 400").collect()}
    found = {i: [r["text"][s["start"] : s["end"]] for s in r["pii_spans"]] for i, r in rows.items() if r["text"]}
    assert found[400] == ["4465758382889437", "4465758382889437"] and not rows[400]["pii_base"]
    assert found[401] == ["jane (at) example (dot) org"] and found[402] == ["10[.]1[.]2[.]3"]
    assert rows[403]["pii_spans"] == rows[404]["pii_spans"] == []


def test_plain_texts_gain_nothing(table):
    for r in pii_boost.find(table).where("doc_id < 400").collect():
        for s in r["pii_spans"]:
            said = r["text"][s["start"] : s["end"]]
            assert not re.fullmatch(r"[0-9]{15}|300\.400\.1\.1|a at b", said) or s in r["pii_base"], (said, r["text"])


def test_labels_and_parts(table):
    counts = pii_boost.pattern_counts(pii_boost.with_spans(table), Fit(), "text").collect()
    assert {r["label"] for r in counts} == {0, 1} and {r["held"] for r in counts} == {0, 1}
    # No candidate is a negative only because no base span overlaps it.
    assert all(r["valid"] == 0 or r["kind"] in (2, 3) for r in counts if r["label"] == 0)


def test_thresholds_come_from_held_rows():
    values = np.array([[2, 16, 1, 1, 0, 0, 0, 0], [2, 16, 1, 0, 0, 0, 0, 0]] * 2)
    labels, held = np.array([1.0, 0.0, 1.0, 0.0]), np.array([False, False, True, True])
    good = pii_boost.fit(values, labels, np.array([50.0, 50, 9, 9]), held)
    assert np.isfinite(good.thresholds[2]) and np.isinf(good.thresholds[0])
    # The pattern that looks right while learning is wrong too often in the held part.
    bad = pii_boost.fit(np.vstack([values, values[2]]), np.append(labels, 0.0), np.array([50.0, 50, 9, 9, 9]), np.append(held, True))
    assert np.isinf(bad.thresholds[2])
    assert pii_boost.fit(values, labels, np.array([0.0, 0, 9, 9]), held) == Model(0.0, (), (np.inf,) * len(KINDS))
