"""Quality filter: fixed base rules, then a decision list learned from labels by sequential covering.

Built-in functions only. The learner sees the corpus through counts: each step of growing a rule is one aggregation that
returns, for every feature and threshold, how many good and bad labelled rows a condition would cover. Its size is
features x thresholds, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.sqltext import indices, let, words
from shelfpace.llm.staging import stage

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols_per_word", "dup_lines_per_word", "repeat_share", "n_words")
BINS = 24  # thresholds of a feature
MAX_RULES = 6
MAX_CONDITIONS = 3
MIN_COVERED = 5  # bad rows that a rule has to cover among the growing rows
MIN_PRECISION = 0.8  # share of bad rows that a rule needs among the pruning rows it covers


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


@dataclass
class Rule:
    """Rejects the rows that fulfil all conditions."""

    conditions: list[Condition] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return F.coalesce(out, F.lit(False))


PLACE_BITS = 20  # of a packed window: the rest is its hash


def _packed(w: Column) -> Column:
    """Per 3-word window one number: its hash in the upper bits, its place in the lower ones."""
    hashed = F.transform(
        w, lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long"))
    )
    return F.slice(hashed, 1, F.greatest(F.size(w) - 2, F.lit(0)))


def _window(w: Column, i: Column) -> Column:
    return F.struct(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _covered(places: Column) -> Column:
    """Words inside the windows that start at the sorted places."""
    each = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    return F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _repeated_exactly(w: Column) -> Column:
    """Places of repeated windows from the sorted windows themselves: slower, but sure of every hash."""
    windows = F.transform(indices(F.size(w) - 2), lambda i: F.struct(_window(w, i).alias("g"), i.alias("i")))

    def hits(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce((k >= 0) & (x["g"] == F.get(s, F.greatest(k, F.lit(0)))["g"]), F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    return let(F.sort_array(windows), hits)


def _repeated(w: Column, packed: Column) -> Column:
    """Places of repeated windows: neighbours among the sorted packed windows with equal hashes.

    The words of each such pair are compared. If one pair differs, or the places need more bits, the windows are sorted
    themselves.
    """
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")
    pairs = F.transform(
        F.filter(packed, lambda x, k: F.shiftright(x.bitwiseXOR(F.get(packed, k + 1)), PLACE_BITS) == 0),
        lambda x: F.struct(x.bitwiseAND(low).cast("int").alias("a"), F.shiftright(x, PLACE_BITS).alias("h")),
    )

    def exact(found: Column) -> Column:
        nexts = F.transform(
            F.filter(packed, lambda x, k: (k > 0) & (F.shiftright(x.bitwiseXOR(F.get(packed, F.greatest(k - 1, F.lit(0)))), PLACE_BITS) == 0)),
            lambda x: x.bitwiseAND(low).cast("int"),
        )

        def checked(b: Column) -> Column:
            wrong = F.exists(F.arrays_zip(found["a"].alias("a"), b.alias("b")), lambda z: _window(w, z["a"]) != _window(w, z["b"]))
            return F.when(wrong, _repeated_exactly(w)).otherwise(F.sort_array(F.array_union(found["a"], b)))

        return F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(let(nexts, checked))

    return F.when(F.size(w) > (1 << PLACE_BITS), _repeated_exactly(w)).otherwise(let(pairs, exact))


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id and the five base counts of every whole text; null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbol = "[" + "".join("\\" + c for c in SYMBOLS) + "]"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(text.rlike(symbol), F.size(F.split(text, symbol)) - 1).otherwise(0).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.inline(F.array(let(words(text), lambda w: F.struct(w.alias("w"), _packed(w).alias("packed"))))),
    )
    # Sorting stands outside the lambdas: there it works on plain longs.
    rows = rows.select("doc_id", "n_symbols", "n_dup_lines", F.inline(F.array(F.struct("w", F.sort_array("packed").alias("packed")))))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        let(_repeated(F.col("w"), F.col("packed")), _covered).alias("n_repeat_words"),
    )


def with_features(measures: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return measures.select(
        "*",
        (F.col("word_chars") / n).alias("word_length"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_dup_lines") / n).alias("dup_lines_per_word"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """Bad and good rows that each possible further condition covers."""
    bins = [
        F.struct(F.lit(f).alias("feature"), sum((F.when(F.col(f) > F.lit(t), 1).otherwise(0) for t in ts), F.lit(0)).alias("bin"))
        for f, ts in cuts.items()
        if ts
    ]
    if not bins:
        return {}
    counted = rows.select("bad", F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    table = {(r["feature"], r["bin"]): (r["bad"], r["n"] - r["bad"]) for r in counted.collect()}
    out = {}
    for f, ts in cuts.items():
        for k, t in enumerate(ts):
            for above in (True, False):
                parts = [v for (g, b), v in table.items() if g == f and (b > k) == above]
                out[Condition(f, above, t)] = (sum(p[0] for p in parts), sum(p[1] for p in parts))
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]], bad: int, good: int) -> Rule:
    """Add the condition with the largest information gain until no good row is covered or nothing gains."""
    import math

    rule = Rule()
    while good and len(rule.conditions) < MAX_CONDITIONS:
        now = math.log2(bad / (bad + good))
        choices = _counts(rows.filter(rule.column()), cuts)
        scored = [(p * (math.log2(p / (p + n)) - now), c, p, n) for c, (p, n) in choices.items() if p >= MIN_COVERED]
        best = max(scored, key=lambda s: (s[0], s[1].feature, s[1].above, s[1].threshold), default=None)
        if best is None or best[0] <= 1e-9:
            break
        rule.conditions.append(best[1])
        bad, good = best[2], best[3]
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """Cut the rule to the beginning that is best on the pruning rows: one aggregation for all beginnings."""
    starts = [Rule(rule.conditions[: k + 1]) for k in range(len(rule.conditions))]
    sums = [F.sum(F.when(r.column(), F.col("bad")).otherwise(0)).alias(f"p{k}") for k, r in enumerate(starts)]
    sums += [F.sum(F.when(r.column(), 1 - F.col("bad")).otherwise(0)).alias(f"n{k}") for k, r in enumerate(starts)]
    got = rows.agg(*sums).first().asDict()
    value = [(got[f"p{k}"] or 0, got[f"n{k}"] or 0) for k in range(len(starts))]
    best = max(range(len(starts)), key=lambda k: ((value[k][0] - value[k][1]) / max(1, sum(value[k])), -k))
    return starts[best], *value[best]


def learn_rules(labelled: DataFrame, key: str = "doc_id") -> list[Rule]:
    """Ordered rules from rows with the features and ``bad`` (0 or 1): sequential covering.

    A third of the rows, chosen by a hash of the key, prunes and judges rules, the rest grows them. Rows covered by a
    rule leave both parts. Learning stops at the first rule that is not precise enough on the pruning rows. No labelled
    rows, or none of them bad: no rules.
    """
    part = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(3))
    rows = labelled.withColumn("prune", part == 0).filter(F.col("bad").isNotNull())
    quantiles = rows.agg(*(F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 2000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(quantiles[f] or [])) for f in FEATURES}
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = rows
        for r in rules:
            left = left.filter(~r.column())
        grow, prune = left.filter(~F.col("prune")), left.filter("prune")
        bad, n = grow.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
        if bad < MIN_COVERED:
            break
        rule = _grow(grow, cuts, bad, n - bad)
        if not rule.conditions:
            break
        rule, hit, missed = _prune(prune, rule)
        if hit < 1 or hit / (hit + missed) < MIN_PRECISION:
            break
        rules.append(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: number of the first rule that rejects a row, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for k, r in enumerate(rules, 1):
        out = out.when(r.column(), F.lit(k))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts and verdict for every document: doc_id, the base counts, base_failed, kept, rule.

    ``labels`` has doc_id and quality (1 good, 0 bad). The list is learned on labelled documents that pass the base rules.
    ``rule`` is the number of the rejecting rule.

    Null text: no words, so base_failed. Null doc_ids, and rows that repeat an id, are judged like others; they take part
    in learning only as far as labels name them. Labels that are null or name no document are not used; several labels of
    a document count once, as bad if any is. Other columns of either table are not read. Without labels, or without
    documents, only the base rules hold.
    """
    measured = stage(with_features(base_measures(docs)), "quality")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    marks = marks.groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    rules = learn_rules(stage(measured.filter(~F.col("base_failed")).join(marks, "doc_id").select("doc_id", "bad", *FEATURES), "quality-labelled"))
    rule = F.when(~F.col("base_failed"), verdict(rules))
    return measured.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & rule.isNull()).alias("kept"), rule.alias("rule"))
