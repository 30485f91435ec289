"""Personal data: candidate spans scored by gradient boosting.

Base rules find emails, IP addresses, card and phone numbers exactly as
written. Besides, generators with a wide reach propose further spans (spelled
out or bracketed addresses, other separators, numbers without a country code).
Format and context of a candidate become eight small whole-number features.
Boosted trees score them; per kind, the least score whose labelled candidates
are right often enough is the threshold. Candidates above it are added to the
base spans, the best first where they overlap.

Labels come from the corpus itself: a candidate is positive if a base span of
its kind overlaps it, negative if its format check fails or a base span of
another kind overlaps it. The rest, among them all that the base rules miss, is
not learned from: nothing is a negative because the base rules do not know it.
The trees learn from three quarters of the texts, by a hash of the text, and the
thresholds are set on the last quarter. All candidates of all documents count:
they are grouped by their features, of which there are at most ``PATTERNS``
different ones, and only these counts reach the driver.

Everything that touches texts is DataFrame functions; trees become nested
conditions. No shuffle but that of the feature counts.

Defined results: null text counts as empty. Positions are code points, ends
exclusive. Repeated rows get equal results. Without labelled candidates of both
kinds nothing is added to the base spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# How many values each feature can have: kind, digits, strong form, valid, key word, before, after, separators.
SIZES = (4, 21, 2, 2, 2, 4, 4, 7)
PATTERNS = int(np.prod(SIZES))
FEATURES = ("kind", "digits", "strong", "valid", "word", "before", "after", "marks")

_LOCAL = "A-Za-z0-9._%+-"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# The base rules. Look-behinds and possessive parts only keep a search from starting
# inside a run of which the start has failed already; the matches are the same.
BASE = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT = r"(?:@|\x20?[(\[{]at[)\]}]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?[(\[{](?:dot|\.)[)\]}]\x20?|\x20dot\x20)"
GENERATORS = (
    rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}})++",
    r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|[(\[{]\.[)\]}])\x20?[0-9]{1,3}){3}(?![0-9])",
    r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){11,18}(?![0-9])",
    r"(?<![0-9A-Za-z])(?:\+|00)?\x20?\(?[0-9][0-9\x20()./-]{6,22}[0-9](?![0-9])",
)
# In every match of the first generator; cheaper to search for, as it has no local part.
SPELLED = rf"(?i){_AT}[a-z0-9-]{{1,63}}{_DOT}[a-z0-9-]"
WORDS = (
    r"(?i)\b(e-?mail|mail|contact|write to|reach|courriel|correo)\b",
    r"(?i)\b(ip|host|server|address|addr|from|client|adresse)\b",
    r"(?i)\b(card|visa|mastercard|amex|credit|debit|pan|karte|carte|tarjeta)\b",
    r"(?i)\b(phone|tel|telephone|call|fax|mobile|cell|telefon|portable|movil)\b",
)
CONTEXT = 24
# Columns of the results; a caller's columns of these names are replaced.
ADDED = ("pii_base", "pii_candidates", "pii_spans")
SPAN = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,end:int,found:string>>"


@dataclass(frozen=True)
class Fit:
    trees: int = 24
    depth: int = 3
    rate: float = 0.4
    ridge: float = 1.0
    precision: float = 0.99
    held: int = 4  # one in so many texts is held for the thresholds


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[tuple[tuple[int, ...], tuple[int, ...], tuple[float, ...]], ...]
    thresholds: tuple[float, ...]  # by kind, of the margin


def located(text: Column, pattern: str, matches: Column) -> Column:
    """Matches with their places, from the lengths of what stands between them."""
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def take(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["between"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    both = F.zip_with(
        F.slice(between, 1, F.size(matches)),
        matches,
        lambda a, b: F.struct(a.alias("between"), b.alias("found")),
    )
    return F.when(F.size(matches) > 0, F.aggregate(both, start, take, lambda acc: acc["out"])).otherwise(
        F.array().cast(FOUND)
    )


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    flipped = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(flipped, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def base_valid(kind: int, found: Column) -> Column:
    digits = digits_of(found)
    if kind == 1:
        return found.rlike(rf"^{_PART}(\.{_PART}){{3}}$")
    if kind == 2:
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == 3:
        return F.length(digits).between(9, 15)
    return F.lit(True)


def side(char: Column) -> Column:
    """0 nothing or space, 1 letter, 2 digit, 3 other."""
    return (
        F.when(char.isNull() | (char == "") | char.rlike(r"\s"), 0)
        .when(char.rlike(r"\p{L}"), 1)
        .when(char.rlike("[0-9]"), 2)
        .otherwise(3)
    )


def features(kind: int, text: Column, x: Column) -> list[Column]:
    found, digits = x["found"], digits_of(x["found"])
    lower = F.lower(found)
    context = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
    marks = F.regexp_replace(found, r"[0-9A-Za-z]", "")
    valid = base_valid(kind, F.regexp_replace(found, r"[\x20()\[\]{}]", "") if kind == 1 else found)
    if kind == 0:
        strong = lower.rlike(r"@|[(\[{]at[)\]}]")
        valid = lower.rlike(r"(?:\.|[)\]}]|dot)\x20?[a-z]{2,24}$")
    elif kind == 1:
        strong = ~found.contains(" ")
    elif kind == 2:
        strong = F.size(F.array_distinct(F.split(marks, ""))) <= 1
    else:
        strong = found.rlike(r"^(?:\+|00|\x20?\()")
        valid = valid & found.rlike(r"[()./-]|\+")
    return [
        F.lit(kind),
        F.least(F.length(digits), F.lit(SIZES[1] - 1)),
        strong.cast("int"),
        valid.cast("int"),
        context.rlike(WORDS[kind]).cast("int"),
        side(F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1)))),
        side(F.substring(text, x["end"] + 1, F.lit(1))),
        F.least(F.length(marks), F.lit(SIZES[7] - 1)),
    ]


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base spans and candidates, ``pii_base`` and ``pii_candidates``; columns of these names are replaced."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
    prefix = "pii_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    whole = F.coalesce(F.col(text), F.lit(""))
    has_digit = whole.rlike("[0-9]")
    guards = (whole.contains("@"), has_digit & whole.contains("."), has_digit, has_digit & whole.contains("+"))
    wide = (whole.rlike(SPELLED), has_digit & whole.contains("."), has_digit, has_digit)
    none = F.array().cast("array<string>")
    marked = docs.withColumns(
        {
            f"{prefix}{name}_{i}": F.when(guard[i], F.regexp_extract_all(whole, F.lit(rules[i]), F.lit(0))).otherwise(none)
            for name, rules, guard in (("base", BASE, guards), ("wide", GENERATORS, wide))
            for i in range(len(KINDS))
        }
    )

    def base(i: int) -> Column:
        places = F.filter(located(whole, BASE[i], F.col(f"{prefix}base_{i}")), lambda x: base_valid(i, x["found"]))
        return F.transform(places, lambda x: F.struct(x["start"], F.lit(i).alias("kind"), x["end"]))

    def candidates(i: int) -> Column:
        def row(x: Column) -> Column:
            named = [c.alias(n) for c, n in zip(features(i, whole, x), FEATURES, strict=True)]
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), *named)

        return F.transform(located(whole, GENERATORS[i], F.col(f"{prefix}wide_{i}")), row)

    kinds = range(len(KINDS))
    spans = F.array_sort(F.concat(*[base(i) for i in kinds]).cast(SPAN))
    return marked.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        spans.alias("pii_base"),
        F.concat(*[candidates(i) for i in kinds]).alias("pii_candidates"),
    )


def overlaps(spans: Column, x: Column, kind: Column | None = None) -> Column:
    def hit(s: Column) -> Column:
        both = (s["start"] < x["end"]) & (x["start"] < s["end"])
        return both if kind is None else both & (s["kind"] == kind)

    return F.exists(spans, hit)


def pattern_counts(spans: DataFrame, how: Fit, text: str) -> DataFrame:
    """Labelled candidates by features: one row per pattern, label, and whether it is held for the thresholds."""
    base, c = F.col("pii_base"), F.col("c")
    label = F.when(overlaps(base, c, c["kind"]), 1).when((c["valid"] == 0) | overlaps(base, c), 0)
    held = (F.pmod(F.xxhash64(text), F.lit(how.held)) == 0).cast("int").alias("held")
    return (
        spans.where(F.size("pii_candidates") > 0)
        .select("pii_base", held, F.explode("pii_candidates").alias("c"))
        .select(*[c[n].alias(n) for n in FEATURES], label.alias("label"), "held")
        .where(F.col("label").isNotNull())
        .groupBy(*FEATURES, "label", "held")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit(values: np.ndarray, labels: np.ndarray, weights: np.ndarray, held: np.ndarray, how: Fit = Fit()) -> Model:
    """Trees from pattern rows, their labels and how often each occurs; thresholds from the rows that are held."""
    never = Model(0.0, (), (np.inf,) * len(KINDS))
    counts = weights
    # Rows that are held weigh nothing while the trees grow.
    weights = np.where(held, 0.0, weights)
    if not weights.any() or len(np.unique(labels[weights > 0])) < 2:
        return never
    weights = weights / weights.sum() * np.count_nonzero(weights)
    share = float((weights * labels).sum() / weights.sum())
    base = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(labels), base), []
    inner = 2**how.depth - 1
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = weights * (labels - p), weights * p * (1 - p)
        node, feature, cut = np.zeros(len(labels), np.int64), [0] * inner, [max(SIZES)] * inner
        for k in range(inner):
            own = node == k
            best = 1e-9
            g_all, h_all = slope[own].sum(), curve[own].sum()
            for j, size in enumerate(SIZES):
                g = np.bincount(values[own, j], slope[own], size).cumsum()[:-1]
                h = np.bincount(values[own, j], curve[own], size).cumsum()[:-1]
                gain = g**2 / (h + how.ridge) + (g_all - g) ** 2 / (h_all - h + how.ridge) - g_all**2 / (h_all + how.ridge)
                if gain.max() > best:
                    best, feature[k], cut[k] = float(gain.max()), j, int(gain.argmax())
            node[own] = 2 * k + 1 + (values[own, feature[k]] > cut[k])
        at = node - inner
        leaf = how.rate * np.bincount(at, slope, inner + 1) / (np.bincount(at, curve, inner + 1) + how.ridge)
        margin = margin + leaf[at]
        trees.append((tuple(feature), tuple(cut), tuple(map(float, leaf))))
    thresholds = []
    for kind in range(len(KINDS)):
        own = np.flatnonzero((values[:, 0] == kind) & held)
        order = own[np.argsort(-margin[own], kind="stable")]
        good, seen = (counts * labels)[order].cumsum(), counts[order].cumsum()
        # Patterns of one margin stand or fall together.
        last = np.append(margin[order][1:] < margin[order][:-1] - 1e-12, True) if len(order) else np.zeros(0, bool)
        ok = np.flatnonzero(last & (good >= how.precision * seen) & (good > 0))
        thresholds.append(float(margin[order[ok[-1]]]) - 1e-9 if len(ok) else np.inf)
    return Model(base, tuple(trees), tuple(thresholds))


def learn(spans: DataFrame, how: Fit = Fit(), text: str = "text") -> Model:
    """At most four rows for each of the ``PATTERNS`` reach the driver."""
    rows = pattern_counts(spans, how, text).orderBy(*FEATURES, "label", "held").collect()
    table = np.array([tuple(r) for r in rows], np.int64).reshape(-1, len(FEATURES) + 3)
    label, held, n = table[:, -3].astype(float), table[:, -2] == 1, table[:, -1].astype(float)
    return fit(table[:, :-3], label, n, held, how)


def margin_of(model: Model, c: Column) -> Column:
    def branch(tree: tuple, k: int) -> Column:
        feature, cut, leaf = tree
        if k >= len(feature):
            return F.lit(leaf[k - len(feature)])
        if cut[k] >= SIZES[feature[k]]:
            return branch(tree, 2 * k + 1)
        return F.when(c[FEATURES[feature[k]]] > cut[k], branch(tree, 2 * k + 2)).otherwise(branch(tree, 2 * k + 1))

    total = F.lit(model.base)
    for tree in model.trees:
        total = total + branch(tree, 0)
    return total


def added(model: Model) -> Column:
    """Candidates above their threshold that overlap no base span; of overlapping ones the best."""
    if all(np.isinf(model.thresholds)):
        return F.array().cast(SPAN)
    # What fails its format check is no proposal, whatever the trees make of its context.
    free = F.filter("pii_candidates", lambda c: (c["valid"] == 1) & ~overlaps(F.col("pii_base"), c))

    def rated(c: Column) -> Column:
        limit = F.element_at(F.array(*map(F.lit, model.thresholds)), c["kind"] + 1)
        margin = margin_of(model, c)
        # Sorted by what comes first: the surer, then the longer, then the earlier.
        return F.struct(
            (-margin).alias("order"),
            (c["start"] - c["end"]).alias("size"),
            c["start"].alias("start"),
            c["kind"].alias("kind"),
            c["end"].alias("end"),
            (margin >= limit).alias("in"),
        )

    best = F.array_sort(F.filter(F.transform(free, rated), lambda x: x["in"]))

    def take(acc: Column, x: Column) -> Column:
        one = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
        return F.when(overlaps(acc, x), acc).otherwise(F.concat(acc, F.array(one)))

    return F.when(F.size(free) > 0, F.aggregate(best, F.array().cast(SPAN), take)).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find(docs: DataFrame, how: Fit = Fit(), text: str = "text") -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``, arrays of (start, kind, end) sorted by start and kind."""
    spans = with_spans(docs, text)
    model = learn(spans, how, text)
    both = F.array_sort(F.concat(F.col("pii_base"), added(model)))
    kept = [F.col(f"`{c}`") for c in spans.columns if c.lower() not in ADDED]
    return spans.select(*kept, "pii_base", both.alias("pii_spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def take(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        label = F.element_at(names, s["kind"] + 1)
        inside = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, label)).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, take, finish)).otherwise(text)
