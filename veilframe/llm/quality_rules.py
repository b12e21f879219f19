"""Quality rules: decision lists learned by sequential covering, applied as Spark conditional expressions.

Statistics of a text are built-in SQL functions only. A bounded sample of labelled
statistics is learned from on the driver (plain Python lists); the learned list is
emitted as one ordered ``CASE WHEN`` expression, so applying it is a projection:
no shuffle, no Python on the executors.

Defined results: a null text counts as the empty text (no words); a document
without words fails the base rule; ties between conditions go to the first feature
in ``FEATURES`` and the smallest threshold; with no labelled example the list is
empty and the default verdict (keep) holds; repeated rows are judged one by one;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import common

#: Ratios the rules may test, in the order that breaks ties.
FEATURES = (
    "symbol_ratio", "pipe_ratio", "bang_ratio", "repeat_ratio", "dup_line_ratio",
    "upper_ratio", "digit_ratio", "distinct_ratio", "mean_word_chars", "same_next_ratio", "log_words",
)
#: Labelled documents of each class that a list is learned from, at most.
PER_CLASS = 1500
#: Thresholds tried for each feature.
CUTS = 24
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule must be right on so many of the pruning examples it covers.
MIN_PRECISION = 0.9
MIN_COVER = 3

BASE_MIN_WORDS = 50


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.cut if self.above else row[self.feature] < self.cut

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= F.lit(self.cut) if self.above else of[self.feature] < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` with value computed once: a lambda variable, not an inlined expression."""
    return F.transform(F.array(value), body)[0]


def base_columns(text: Column) -> dict[str, Column]:
    """The counts of a text, as SQL expressions (null text: the empty text)."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, common.BLANK + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD))
    return {
        "words": words,
        "word_chars": F.length(F.regexp_replace(text, common.BLANK + "+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_pipes": (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))).cast("long"),
        "n_bangs": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
        "n_digits": (F.length(text) - F.length(F.regexp_replace(text, r"[0-9]+", ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which is found twice or more, first included.

    Windows are sorted beside their positions, so equal ones are neighbours; then the
    positions of the repeated ones are sorted and the union of [i, i + 2] is summed.
    n log n in the words of the text, inside the row.
    """

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.struct(
                    F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i")
                ),
            ),
        ).otherwise(F.expr("cast(array() as array<struct<k:string,i:int>>)"))

    def repeated(s: Column) -> Column:
        at = F.transform(
            s,
            lambda x, j: F.when(
                (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]), x["i"]
            ),
        )
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def covered(d: Column) -> Column:
        steps = F.transform(d, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(d, j + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(words, lambda w: _let(F.sort_array(windows(w)), lambda s: _let(repeated(s), covered)))


def statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the base counts and the ``FEATURES``, each name behind ``prefix``; a column of such a name is replaced."""
    base = base_columns(F.col(f"`{text}`"))
    p = lambda n: f"{prefix}{n}"
    (words,) = common.fresh(docs, "words")
    out = docs.withColumns({words if k == "words" else p(k): v for k, v in base.items()})
    w = F.col(words)
    same_next = F.when(
        F.size(w) > 1,
        _let(w, lambda x: F.size(F.filter(F.transform(x, lambda v, j: v == F.get(x, j - 1)), lambda b: b))),
    ).otherwise(0)
    out = out.withColumns(
        {
            p("n_words"): F.size(w).cast("long"),
            p("n_repeat_words"): repeat_words(w),
            p("n_distinct"): F.size(F.array_distinct(w)).cast("long"),
            p("n_same_next"): same_next.cast("long"),
        }
    ).drop(words)
    chars, n = F.greatest(F.col(p("word_chars")), F.lit(1)), F.greatest(F.col(p("n_words")), F.lit(1))
    ratio = lambda a, b: F.col(p(a)).cast("double") / b
    return out.withColumns(
        {
            p("symbol_ratio"): ratio("n_symbols", chars),
            p("pipe_ratio"): ratio("n_pipes", n),
            p("bang_ratio"): ratio("n_bangs", n),
            p("repeat_ratio"): ratio("n_repeat_words", n),
            p("dup_line_ratio"): ratio("n_dup_lines", n),
            p("upper_ratio"): ratio("n_upper", chars),
            p("digit_ratio"): ratio("n_digits", chars),
            p("distinct_ratio"): ratio("n_distinct", n),
            p("mean_word_chars"): ratio("word_chars", n),
            p("same_next_ratio"): ratio("n_same_next", n),
            p("log_words"): F.log1p(F.col(p("n_words")).cast("double")),
        }
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < BASE_MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def _thresholds(rows: list[dict], feature: str) -> list[float]:
    values = sorted({r[feature] for r in rows})
    mids = [(a + b) / 2 for a, b in zip(values, values[1:])]
    step = max(1, len(mids) // CUTS)
    return mids[::step]


def _grow(pos: list[dict], neg: list[dict]) -> Rule:
    """Conditions added one by one by information gain until no negative example is covered."""
    rule: list[Condition] = []
    while neg and len(rule) < MAX_CONDITIONS:
        before = math.log2(len(pos) / (len(pos) + len(neg)))
        best: tuple[float, Condition | None] = (1e-9, None)
        for f in FEATURES:
            for cut in _thresholds(pos + neg, f):
                up, un = sum(r[f] >= cut for r in pos), sum(r[f] >= cut for r in neg)
                for above, p, n in ((True, up, un), (False, len(pos) - up, len(neg) - un)):
                    if p >= MIN_COVER:
                        gain = p * (math.log2(p / (p + n)) - before)
                        if gain > best[0]:
                            best = (gain, Condition(f, above, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        pos, neg = [r for r in pos if best[1].holds(r)], [r for r in neg if best[1].holds(r)]
    return tuple(rule)


def _prune(rule: Rule, pos: list[dict], neg: list[dict]) -> tuple[Rule, float, int]:
    """The prefix of the rule that is best on the pruning examples, its precision and how many it covers rightly."""
    best = (rule, -2.0, 0.0, 0)
    for k in range(len(rule), 0, -1):
        p = sum(all(c.holds(r) for c in rule[:k]) for r in pos)
        n = sum(all(c.holds(r) for c in rule[:k]) for r in neg)
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[1] or worth == best[1] and p > best[3]:
            best = (rule[:k], worth, p / (p + n) if p + n else 0.0, p)
    return best[0], best[2], best[3]


def learn(rows: list[dict]) -> list[Rule]:
    """An ordered list of rules that reject; a text under none of them is kept.

    ``rows`` hold ``FEATURES`` and ``label`` (0: to be rejected). Two rows of three
    grow rules, every third prunes them. A rule that is wrong too often on the
    pruning rows ends the learning.
    """
    rows = [r for r in rows if all(r[f] is not None for f in FEATURES)]
    grow = [r for i, r in enumerate(rows) if i % 3 != 2]
    prune = [r for i, r in enumerate(rows) if i % 3 == 2]
    split = lambda rs: ([r for r in rs if r["label"] == 0], [r for r in rs if r["label"] == 1])
    (pos, neg), (ppos, pneg) = split(grow), split(prune)
    rules: list[Rule] = []
    while len(pos) >= MIN_COVER and len(rules) < MAX_RULES:
        rule = _grow(pos, neg)
        if not rule:
            break
        rule, precision, right = _prune(rule, ppos, pneg)
        if precision < MIN_PRECISION or right < 1:
            break
        rules.append(rule)
        left = lambda rs: [r for r in rs if not all(c.holds(r) for c in rule)]  # noqa: E731, B023
        pos, neg, ppos, pneg = left(pos), left(neg), left(ppos), left(pneg)
    return rules


def verdict(rules: list[Rule], of: dict[str, Column]) -> tuple[Column, Column]:
    """(kept, rule number or null) as one ordered conditional expression each."""
    if not rules:
        return F.lit(True), F.lit(None).cast("int")
    fired = None
    for i, rule in enumerate(rules, 1):
        cond = rule[0].column(of)
        for c in rule[1:]:
            cond = cond & c.column(of)
        fired = F.when(cond, F.lit(i)) if fired is None else fired.when(cond, F.lit(i))
    return fired.isNull(), fired


def examples(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[dict]:
    """Labelled statistics (a bounded sample) to learn from; base failures are left to the base rule."""
    # Counted where the texts are: numbers alone reach the driver.
    got = statistics(common.sample(spark, docs, labels, "quality", per_class)).where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return [r.asDict() for r in got.select("doc_id", "label", *FEATURES).orderBy("doc_id").collect()]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> list[Rule]:
    return learn(examples(spark, docs, labels))


def judge(docs: DataFrame, rules: list[Rule], prefix: str = "") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``rule`` (number of the rule that fired) and ``kept``."""
    out = statistics(docs, prefix=prefix)
    kept, fired = verdict(rules, {f: F.col(f"{prefix}{f}") for f in FEATURES})
    failed = base_failed(F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words"))
    return out.withColumns({f"{prefix}base_failed": failed, f"{prefix}rule": fired, f"{prefix}method_kept": kept}).withColumn(
        f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.col(f"{prefix}method_kept")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts, the base rule and the learned verdict."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(spark, docs, common.table(spark, sf_dir, "labels"))
    return judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def reject(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that neither the base rule nor the list rejects, with their own columns only."""
    (prefix,) = common.fresh(docs, "qr_")
    return judge(docs, rules, prefix).where(F.col(f"{prefix}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
