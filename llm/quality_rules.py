"""Quality rules: a learned decision list as ordered Spark conditions.

Statistics of a text are plain Spark expressions.  Sequential covering learns
rules that reject bad texts from labelled statistics:

* *grow*: add the threshold condition with the largest FOIL gain until a rule
  covers hardly any good text.  All thresholds of all statistics are weighed by
  one aggregate per step: the histogram of labels over (statistic, quantile bin);
* *prune*: keep the prefix of conditions that is best on texts set aside;
* *cover*: texts that an accepted rule rejects are left out, then the next rule
  is grown; a rule that is not precise enough on the set aside ends the list.

The list is emitted as one CASE expression, so it runs inside the scan of the
texts, with no shuffle.  The fit reads at most ``FIT_ROWS`` labelled rows (the
smallest hashes of the id); the rules are applied to every text.

Defined cases: a null text has no words; a text without words fails the base
rule; labels that contradict each other for one id, or are neither 0 nor 1, are
left out; without labels of both kinds the list is empty and keeps everything;
each row is judged by its own text, ids may be null or repeated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, free_name, written

#: Bound of the fit: labelled rows.
FIT_ROWS = 20_000
QUANTILES = 64
MIN_PRECISION = 0.95
MIN_COVER = 5
MAX_RULES = 12
MAX_CONDITIONS = 4

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics the rules may use: shares, independent of the length of a text.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words": "CAST(n_words AS DOUBLE)",
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: windows are hashed
    and sorted with their positions, equal neighbours give the positions."""

    def covered(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - 2)
        hashes = F.transform(starts, lambda i: F.struct(
            F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")))
        twice = _let(F.sort_array(hashes), lambda s: F.filter(
            F.transform(s, lambda x, j: F.when(
                (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])),
            lambda i: i.isNotNull()))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    return _let(words, lambda w: F.when(F.size(w) >= 3, covered(w)).otherwise(0)).cast("long")


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the base statistics and those the rules need, all BIGINT.
    Columns of ``df`` with these names are replaced."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    per_words = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d"),
        _repeat_words(w).alias("r")))
    per_lines = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    w, x = free_name(df.columns, f"{prefix}word_stats"), free_name(df.columns, f"{prefix}line_stats")
    return (df.withColumns({w: per_words, x: per_lines})
              .withColumns({f"{prefix}{k}": v for k, v in {
                  "n_words": F.col(w)["n"],
                  "word_chars": (F.length(body) - F.regexp_count(body, F.lit(SPACE_CLASS))).cast("long"),
                  "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
                  "n_dup_lines": F.col(x)["d"],
                  "n_repeat_words": F.col(w)["r"],
                  "n_lines": F.col(x)["n"],
                  "n_distinct": F.col(w)["d"],
                  "n_upper": F.regexp_count(body, F.lit("[A-Z]")).cast("long"),
                  "n_marks": F.regexp_count(body, F.lit("[!?]")).cast("long"),
              }.items()})
              .drop(w, x))


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self, prefix: str = "") -> str:
        value = FEATURES[self.feature]
        if prefix:
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                         "n_distinct", "n_upper", "n_marks"):
                value = value.replace(name, f"`{prefix}{name}`")
        return f"({value}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def kept(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list: false where the base rule or a rule in order rejects."""
    branches = "".join(f" WHEN {' AND '.join(c.sql(prefix) for c in rule)} THEN FALSE" for rule in rules)
    listed = F.expr(f"CASE{branches} ELSE TRUE END") if rules else F.lit(True)
    return F.when(base_failed(prefix), False).otherwise(listed)


def labelled_statistics(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                        label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id, bad, <FEATURES>`` of a bounded sample of labelled rows that pass the base rule, written."""
    sample = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
              .where("id IS NOT NULL AND y IN (0, 1)").groupBy("id")
              .agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
              .select("id", (F.col("y") == 0).alias("bad"))
              .orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    # At most fit_rows ids; written, else the base rule moves below the join and
    # the statistics of every text are computed to filter by it.
    rows = written(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(
        F.broadcast(sample), "id"), "sample")
    return written(with_statistics(rows, "t").where(~base_failed())
                   .select("id", "bad", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()]), "labelled")


def _foil(p: float, n: float, p0: float, n0: float) -> float:
    if p <= 0:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _below(cuts: list[float], name: str) -> Column:
    """The number of thresholds below the value of a statistic."""
    value = F.col(name)
    return F.size(F.filter(F.lit([float(c) for c in cuts] or [0.0]), lambda t: t < value)).alias(name)


def learn(stats: DataFrame) -> list[Rule]:
    """Sequential covering over :func:`labelled_statistics`."""
    names = list(FEATURES)
    cuts = {name: sorted(set(values or [])) for name, values in zip(names, stats.agg(*[
        F.percentile_approx(name, [i / QUANTILES for i in range(QUANTILES + 1)], 10_000) for name in names]).first())}
    # Per statistic the number of thresholds below the value; a third is set aside for pruning.
    bins = written(stats.select("bad", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0).alias("aside"), *[
        _below(cuts[n], n) for n in names]), "bins")
    level = {n: {t: i for i, t in enumerate(cuts[n])} for n in names}

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:  # value > cuts[i]  <=>  at least i + 1 thresholds are below it
            at = level[c.feature][c.threshold]
            out = out & ((F.col(c.feature) > at) if c.above else (F.col(c.feature) <= at))
        return out

    def counts(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
        """Bad and good texts by (statistic, bin): at most features x bins rows."""
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names]))
        got = (rows.select("bad", pairs.alias("x")).groupBy("x.f", "x.b")
               .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect())
        return {(r["f"], r["b"]): (r["p"], r["n"]) for r in got}

    def best(rows: DataFrame) -> tuple[Condition | None, int, int]:
        """The condition with the largest gain, and the good texts it covers."""
        seen = counts(rows)
        first = [v for (f, _), v in seen.items() if f == names[0]]
        p0, n0 = sum(p for p, _ in first), sum(n for _, n in first)
        top = (0.0, None, 0)
        for name in names:
            low_p = low_n = 0
            for at, threshold in enumerate(cuts[name][:-1]):
                p, n = seen.get((name, at), (0, 0))
                low_p, low_n = low_p + p, low_n + n
                for above, cp, cn in ((True, p0 - low_p, n0 - low_n), (False, low_p, low_n)):
                    if cp >= MIN_COVER and cp + cn < p0 + n0:
                        gain = _foil(cp, cn, p0, n0)
                        if gain > top[0] + 1e-9:
                            top = (gain, Condition(name, above, float(threshold)), cn)
        return top[1], top[2], n0

    rules: list[Rule] = []
    left = bins
    while len(rules) < MAX_RULES:
        grow, rule = left.where(~F.col("aside")), ()
        while len(rule) < MAX_CONDITIONS:
            condition, good, _ = best(grow.where(holds(rule)))
            if condition is None:
                break
            rule += (condition,)
            if good == 0:
                break
        if not rule:
            break
        prefixes = [rule[:i] for i in range(1, len(rule) + 1)]
        row = left.where("aside").agg(*[f for p in prefixes for f in (
            F.count_if(holds(p) & F.col("bad")), F.count_if(holds(p) & ~F.col("bad")))]).first()
        worth = [(row[2 * i], row[2 * i + 1]) for i in range(len(prefixes))]
        i = max(range(len(prefixes)), key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), worth[k][0], -k))
        p, n = worth[i]
        if p < 1 or p < MIN_PRECISION * (p + n):
            break
        rules.append(prefixes[i])
        left = left.where(~holds(prefixes[i]))
    return [_centred(stats, rule) for rule in rules]


def _centred(stats: DataFrame, rule: Rule) -> Rule:
    """The rule with each threshold moved half way to the next larger value
    among the texts that meet the other conditions: none of them changes sides,
    and a new text needs more than the least sign to do so."""
    def others(c: Condition) -> Column:
        return F.expr(" AND ".join([f"{o.feature} {'>' if o.above else '<='} {o.threshold!r}D" for o in rule if o != c] or ["TRUE"]))

    following = stats.agg(*[F.min(F.when(others(c) & (F.col(c.feature) > c.threshold), F.col(c.feature))) for c in rule]).first()
    return tuple(Condition(c.feature, c.above, (c.threshold + v) / 2 if v is not None else c.threshold)
                 for c, v in zip(rule, following))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
        fit_rows: int = FIT_ROWS) -> list[Rule]:
    return learn(labelled_statistics(docs, labels, text, doc_id, label, fit_rows))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """All columns of ``docs``, the statistics, ``base_failed`` and ``kept``."""
    stats = with_statistics(docs, text)
    return stats.withColumns({"base_failed": base_failed(), "kept": kept(rules)})


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows that the list keeps, with the columns of ``docs`` alone."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return with_statistics(docs, text, prefix).where(kept(rules, prefix)).select(*[f"`{c}`" for c in docs.columns])
