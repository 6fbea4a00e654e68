"""Quality rules: a learned decision list over document statistics, in built-in functions only.

Sequential covering: a rule is grown by adding the threshold condition with the best
information gain over the documents that the rule still covers, pruned back on rows
held out of growing, and kept if it stays precise there; the documents it covers are
taken out and the next rule is grown. The list becomes one conditional expression.

A NULL text counts as empty: all statistics are 0. Labels that are NULL are not used;
a document labelled twice counts twice. With no usable label the list is empty and
only the base rules decide. Repeated rows are documents of their own, extra columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelab.llm.common import checked_columns, let, stored, table, words
from sitelab.llm.registry import query

WINDOW = 8
FEATURES = (
    "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "bangs", "distinct", "line_words", "log_words",
)
#: Thresholds tried per statistic: its quantiles over the labelled rows.
CUTS = 31
#: Labelled rows used at most; a hash of doc_id chooses them. Documented bound of the fit.
LABELLED = 1_000_000


def _plain_length(text: Column) -> Column:
    """Code points outside white space."""
    for space in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(space), F.lit(""))
    return F.length(text)


def _repeated(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words occurring twice or more."""

    def covered(windows: Column) -> Column:
        def positions(pairs: Column) -> Column:
            twice = F.filter(
                pairs,
                lambda p, i: F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False))
                | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twice, lambda p: p["i"]))

        def length(at: Column) -> Column:
            gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(pairs, lambda p: let(positions(p), length))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0).cast("long"))

    def doubled(h: Column, step: int) -> Column:
        """Hash of each element with the one ``step`` later; the last ``step`` go."""
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))

    return let(
        hashes,
        lambda h: F.when(
            F.size(h) > WINDOW,
            let(doubled(h, 1), lambda two: let(doubled(two, 2), lambda four: let(doubled(four, 4), covered))),
        ).otherwise(F.lit(0).cast("long")),
    )


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the base counts and the statistics that rules may test; columns ``carried`` along come last."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(
        hashes,
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.size(F.array_distinct(h)).alias("n_distinct"),
            _repeated(h).alias("n_repeat_words"),
        ),
    )
    by_line = let(
        lines,
        lambda found: F.struct(
            F.size(found).alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        ),
    )
    counted = docs.select(
        "doc_id",
        *carried,
        by_word.alias("_w"),
        by_line.alias("_l"),
        _plain_length(text).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]")).alias("_upper"),
        F.regexp_count(text, F.lit(r"[0-9]")).alias("_digit"),
        F.regexp_count(text, F.lit(r"[.,;:?]")).alias("_mark"),
        F.regexp_count(text, F.lit(r"!")).alias("_bang"),
    ).select("*", "_w.*", "_l.*")
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    rows = F.greatest(F.col("n_lines"), F.lit(1))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbols"),
        (F.col("n_dup_lines") / rows).alias("dup_lines"),
        (F.col("n_repeat_words") / n).alias("repeats"),
        (F.col("_upper") / chars).alias("upper"),
        (F.col("_digit") / chars).alias("digits"),
        (F.col("_mark") / n).alias("marks"),
        (F.col("_bang") / n).alias("bangs"),
        (F.col("n_distinct") / n).alias("distinct"),
        *carried,
        (F.col("n_words") / rows).alias("line_words"),
        F.log1p("n_words").alias("log_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _all(rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.holds()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def learn_rules(
    rows: DataFrame, bad: str = "bad", most_rules: int = 10, most_conditions: int = 4, precision: float = 0.85, least: int = 8
) -> list[Rule]:
    """Rules for ``bad`` rows, in order; ``rows`` holds FEATURES, ``bad`` and ``grow`` (False: held out).

    What comes to the driver is bounded: the cuts, one count per statistic and cut for
    each condition, and one pair of counts per condition of a rule.
    """
    quantiles = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    found = rows.agg(*[F.percentile_approx(f, quantiles, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(found[f] or [])) for f in FEATURES}
    # A statistic that is mostly one value has few quantiles: the step above it is a cut too.
    above = rows.agg(*[F.min(F.when(F.col(f) > F.lit(cuts[f][0] if cuts[f] else 0.0), F.col(f))).alias(f) for f in FEATURES]).first()
    for f in FEATURES:
        if above[f] is not None:
            cuts[f] = sorted({*cuts[f], above[f]})
    places = F.array(*[_place(f, cuts[f]) for f in FEATURES])
    placed = stored(rows.select(*FEATURES, bad, "grow", places.alias("_places")), "rules-rows")
    left, rules = placed, []
    while len(rules) < most_rules:
        rule: list[Condition] = []
        while len(rule) < most_conditions:
            inside = left.filter(F.col("grow") & _all(rule))
            counts = (
                inside.select(bad, F.posexplode("_places").alias("f", "place"))
                .groupBy("f", "place")
                .agg(F.sum(F.col(bad).cast("long")).alias("p"), F.sum((~F.col(bad)).cast("long")).alias("n"))
                .collect()
            )
            best = _best_condition(counts, cuts, least)
            if best is None:
                break
            rule.append(best[1])
            if best[2] == 0:
                break
        if not rule:
            break
        rule = _pruned(left.filter(~F.col("grow")), rule, bad, precision)
        if not rule:
            break
        rules.append(tuple(rule))
        left = left.filter(~_all(rule))
    return rules


def _place(feature: str, cuts: list[float]) -> Column:
    """How many cuts a value reaches."""
    value = F.col(feature)
    reached = F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda cut: cut <= value)
    return F.size(reached)


def _best_condition(counts, cuts, least: int):
    table = {(r["f"], r["place"]): (r["p"], r["n"]) for r in counts}
    best = None
    for i, feature in enumerate(FEATURES):
        places = [table.get((i, b), (0, 0)) for b in range(len(cuts[feature]) + 1)]
        p0, n0 = (sum(x[k] for x in places) for k in (0, 1))
        if not p0 or not n0:
            continue
        p = n = 0
        for b, cut in enumerate(cuts[feature]):
            p, n = p + places[b][0], n + places[b][1]
            for at_least, hit, miss in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = _gain(hit, miss, p0, n0)
                if hit >= least and gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Condition(feature, at_least, float(cut)), miss)
    return best


def _pruned(held: DataFrame, rule: list[Condition], bad: str, precision: float) -> list[Condition]:
    """The shortest beginning of the rule that is best on rows held out of growing; [] if none is precise."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _all(rule[:k])
        sums += [
            F.coalesce(F.sum((hit & F.col(bad)).cast("long")), F.lit(0)).alias(f"p{k}"),
            F.coalesce(F.sum((hit & ~F.col(bad)).cast("long")), F.lit(0)).alias(f"n{k}"),
        ]
    found = held.agg(*sums).first()
    scored = [
        ((p - n) / (p + n), -k)
        for k in range(1, len(rule) + 1)
        if (p := found[f"p{k}"]) and p / (p + (n := found[f"n{k}"])) >= precision
    ]
    return rule[: -max(scored)[1]] if scored else []


def verdict(rules: list[Rule]) -> Column:
    """1-based number of the first rule that covers a row, 0 if none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        out = F.when(_all(rule), number) if out is None else out.when(_all(rule), number)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(stats: DataFrame, labels: DataFrame, bound: int = LABELLED, **options) -> list[Rule]:
    """Rules from (doc_id, quality) labels; documents that the base rules reject need no rule."""
    marked = checked_columns(labels, {"doc_id": "long", "quality": "int"}).filter(F.col("quality").isin(0, 1))
    rows = stats.filter(~base_failed()).join(marked, "doc_id")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1_000_000))
    rows = stored(
        rows.select("doc_id", *FEATURES, (F.col("quality") == 0).alias("bad"), draw.alias("draw")), "rules-labelled"
    )
    total = rows.count()
    share = min(1.0, bound / max(total, 1))
    rows = rows.filter(F.col("draw") < int(share * 1_000_000)).withColumn(
        "grow", F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2
    )
    return learn_rules(rows, **options) if total else []


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (number of the learned rule, 0 if none) and kept."""
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


@query("op4_quality_rules")
def op4(spark, sf_dir) -> DataFrame:
    stats = stored(statistics(table(spark, sf_dir, "documents")), "rules-stats")
    rules = fit(stats, table(spark, sf_dir, "labels"))
    return apply_rules(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
