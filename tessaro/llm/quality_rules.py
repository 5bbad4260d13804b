"""Quality rules: a decision list learned from labelled statistics by sequential covering.

Every text gets counts in plain Spark functions.  Rules are conjunctions of
thresholds on ratios of these counts; each is grown condition by condition for
FOIL gain, pruned on rows kept apart, and its rows are taken away before the next
one is grown.  The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaro.llm._work import let, settle, words

#: Base rules, fixed by the task.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

FEATURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbol_ratio": "n_symbols / word_chars",
    "bang_ratio": "n_bangs / n_words",
    "upper_ratio": "n_upper / word_chars",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "repeat_ratio": "n_repeat_words / n_words",
    "distinct_ratio": "n_distinct / n_words",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions; precision and rows are those of the rows kept apart."""

    conditions: tuple[Condition, ...]
    precision: float
    rows: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _repeat_words(tokens: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more; windows are told apart by a 64-bit hash.

    Every array is bound by let: an expression that the optimizer moved into a lambda
    would be computed again for each element.
    """

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(a: Column) -> Column:
            last = F.size(a) - 1
            same = lambda x, k: ((k > 0) & (F.get(a, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(a, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(a, same), lambda x: x["i"]))

        spans = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return let(placed, lambda a: let(twins(a), lambda p: F.aggregate(spans(p), F.lit(0), lambda s, x: s + x)))

    counted = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)
    return let(tokens, lambda w: let(hashes(w), counted)).cast("long")


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns and the counts of every whole text; null text counts as empty."""
    text = F.col("_text")
    less = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    base = docs.select(*[docs[c] for c in keep], F.coalesce(docs["text"], F.lit("")).alias("_text"))
    split = base.withColumn("_words", words(text)).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    )
    tokens = F.col("_words")
    return split.select(
        *keep,
        F.size(tokens).cast("long").alias("n_words"),
        F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
        less(r"[#*$%&|<>]").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(tokens).alias("n_repeat_words"),
        F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"),
        less("[A-Z]").alias("n_upper"),
        less("[!?]").alias("n_bangs"),
    )


def with_features(counts: DataFrame) -> DataFrame:
    """Adds the ratios; where nothing is counted a ratio is 0."""
    return counts.withColumns({k: F.coalesce(F.expr(f"try_divide({v.replace(' / ', ', ')})"), F.lit(0.0)) for k, v in FEATURES.items()})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    max_fit_rows: int = 12_000,
    bins: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.97,
    min_rows: int = 3,
) -> list[Rule]:
    """The decision list for labels(doc_id, quality): quality 0 is what rules may reject.

    At most ``max_fit_rows`` labelled documents, least by a hash of their id, are
    read; two labels of one id: the lower counts; null labels don't.  A rule is kept
    only if it is right on ``min_precision`` of the rows kept apart.  No labels, or
    labels of one kind: no rules.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.min("quality") == 0).alias("bad"))
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id")
        .limit(max_fit_rows)
    )
    fitted = docs.select("doc_id", "text").join(F.broadcast(settle(sample)), "doc_id")  # at most max_fit_rows rows
    rows = with_features(settle(text_counts(fitted, "bad", "h"))).where(~base_failed())
    grid = rows.agg(*[F.percentile_approx(f, [i / bins for i in range(bins + 1)], 10_000).alias(f) for f in FEATURES]).first()
    if grid is None or any(grid[f] is None for f in FEATURES):
        return []
    cuts = {f: sorted(set(grid[f])) for f in FEATURES}
    place = {f: F.expr(f"size(filter(array({', '.join(f'{x!r}D' for x in cuts[f])}), t -> {f} > t))") for f in FEATURES}
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), place[f].cast("int").alias("bin")) for f in FEATURES])
    rows = settle(rows.select("bad", (F.pmod("h", F.lit(3)) == 0).alias("apart"), *FEATURES, pairs.alias("pairs")))

    def counts(where: str, apart: bool) -> dict:
        """(feature, bin) -> (bad, good); at most features x bins rows come back."""
        got = rows.where(f"({where}) and {'' if apart else 'not '}apart").select("bad", F.explode("pairs").alias("p"))
        return {(r[0], r[1]): (r[2], r[3]) for r in got.groupBy("p.feature", "p.bin").agg(F.count_if("bad"), F.count_if(~F.col("bad"))).collect()}

    def total(where: str) -> tuple[int, int]:
        r = rows.where(f"({where}) and apart").agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
        return r[0], r[1]

    rules: list[Rule] = []
    left = "true"
    while len(rules) < max_rules:
        grown: list[Condition] = []
        while len(grown) < max_conditions:
            found = counts(" and ".join([left, *(c.sql() for c in grown)]), apart=False)
            best = _best_condition(found, cuts, min_rows)
            if best is None:
                break
            grown.append(best[0])
            if best[1] == 0:
                break
        pruned = None
        for k in range(1, len(grown) + 1):  # shortest first: drop the last conditions where the rest do as well
            bad, good = total(" and ".join([left, *(c.sql() for c in grown[:k])]))
            precision = bad / (bad + good) if bad + good else 0.0
            if bad >= min_rows and precision >= min_precision and (pruned is None or precision > pruned.precision):
                pruned = Rule(tuple(grown[:k]), precision, bad + good)
        if pruned is None:
            break
        rules.append(pruned)
        left += f" and not ({pruned.sql()})"
    return rules


def _best_condition(found: dict, cuts: dict, min_rows: int) -> tuple[Condition, int] | None:
    """The condition of largest FOIL gain over binned counts, and how many good rows it still covers."""
    best, most = None, 1e-9
    for f, edges in cuts.items():
        by = [found.get((f, b), (0, 0)) for b in range(len(edges) + 1)]
        bad, good = sum(x for x, _ in by), sum(y for _, y in by)
        if not bad or not good:
            continue
        prior = math.log2(bad / (bad + good))
        low_bad = low_good = 0
        for b, cut in enumerate(edges):  # bin b: values above edges[b - 1], up to edges[b]
            low_bad, low_good = low_bad + by[b][0], low_good + by[b][1]
            for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if p >= min_rows and n < good:
                    gain = p * (math.log2(p / (p + n)) - prior)
                    if gain > most:
                        best, most = (Condition(f, above, float(cut)), n), gain
    return best


def rejected_by(rules: list[Rule]) -> Column:
    """1-based number of the first rule that a row meets, 0 if none: the list as one CASE."""
    if not rules:
        return F.lit(0)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END")


def judge_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, the four base counts, base_failed, kept, rule (0: none).

    Null or empty texts have no words and fail the base rules.  Null ids and repeated
    rows are judged like others.  Only doc_id and text are read.
    """
    rules = learn_rules(docs, labels, **options)
    judged = with_features(text_counts(docs, "doc_id")).withColumns({"base_failed": base_failed(), "rule": rejected_by(rules)})
    out = judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that the rules keep, all their columns."""
    rules = learn_rules(docs, labels, **options)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    judged = with_features(text_counts(rows, "row")).where(~base_failed() & (rejected_by(rules) == 0))
    return judged.select("row.*")
