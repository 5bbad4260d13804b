"""Mixing sources to target token weights by entropy balancing.

The rates are those nearest to "every word once" (in relative entropy over words) under
which each constraint's words meet their target: exponential tilts, rate = exp(sum of the
duals of the constraints that a document takes part in).  The convex dual is solved by
Newton steps.  Every step is an aggregation over the table of cells: the gradient, the
diagonal block of the first family of constraints (sources, of any number) and the small
block that remains once it is eliminated, which the driver solves.  The duals of the
first family stay a table.  Rates become whole copies by ordered selection: documents in
hash order get one copy more until the fraction of the words is reached, the small
documents last, so that they also make up what the large ones missed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaro.llm._work import BROADCAST_ROWS, join_on, join_small, ranks, running_before, settle, words

WEIGHTS = (5, 2, 1)
#: Rows of one source that are ordered together; values of all families but the first, taken together.
BLOCK_ROWS, SMALL_FAMILIES = 2_000, 64
#: Newton steps at most, and the relative error of every constraint at which they end.
STEPS, TOLERANCE = 60, 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, words, rows, target) for sizes(source, size); the table has one row a source.

    Sources by code point, null last, weigh ``weights`` in turn.  Targets are
    min(ceiling * words, level * weight): the level at which they share what there is.
    """
    per = settle(sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")))
    per = join_on(per, ranks(per, "source"), ["source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = settle(per.select("source", "words", "rows", weight.alias("weight"), (F.col("words") * ceiling).alias("cap")))
    total, level = per.agg(F.sum("words") * share).first()[0] or 0.0, 0.0
    while True:  # sources that the level fills stay full at higher levels, so it rises until it fills no other
        full = F.col("cap") < level * F.col("weight")
        held, rest = per.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        above = (total - held) / rest if rest else level
        if above <= level:
            return per.select("source", "words", "rows", F.least("cap", level * F.col("weight")).alias("target"))
        level = above


def balance(cells: DataFrame, first: str, targets: DataFrame, others: dict[str, dict] | None = None) -> DataFrame:
    """(first, dual) and, where there are others, rows (name, value, dual) of theirs: see ``rates``.

    cells: one row a cell: first, the columns of others, and words.  targets: (first,
    target).  others: column -> {value: target}; values that it lacks are free.  Targets
    must be such that some mix meets all of them: overlapping families share one total.
    Values of the first family without words or target get no dual: their rate is 0.
    """
    others = others or {}
    small = [(c, v) for c in others for v in others[c]]
    if len(small) > SMALL_FAMILIES:
        raise ValueError(f"{len(small)} values in small families; at most {SMALL_FAMILIES}")
    # Two values of one family never meet in a cell.
    pairs = [(i, j) for i in range(len(small)) for j in range(i + 1, len(small)) if small[i][0] != small[j][0]]
    mu = np.zeros(len(small))
    aims = np.array([others[c][v] for c, v in small], float)
    usable = join_on(cells.select(first, *others, "words"), targets.where("target > 0"), [first]).where("words > 0")
    usable = settle(usable.select(first, *others, "words", "target"))
    duals, per = usable.select(first).distinct().withColumn("dual", F.lit(0.0)), None
    near = F.broadcast if duals.count() <= BROADCAST_ROWS else lambda df: df
    for _ in range(STEPS):
        inside = [F.col(c).eqNullSafe(F.lit(v)) for c, v in small]
        tilt = sum((F.when(i, float(m)).otherwise(0.0) for i, m in zip(inside, mu)), F.col("dual"))
        mass = join_on(usable, near(duals), [first]).withColumn("mass", F.col("words") * F.exp(tilt))
        held = lambda what: F.sum(F.when(what, F.col("mass")).otherwise(0.0))
        before, per = per, mass.groupBy(first).agg(
            F.sum("mass").alias("d"), F.first("target").alias("target"), F.first("dual").alias("dual"),
            *[held(x).alias(f"c{i}") for i, x in enumerate(inside)], *[held(inside[i] & inside[j]).alias(f"m{i}_{j}") for i, j in pairs],
        )
        per = settle(per.withColumn("g", F.col("d") - F.col("target")), over=before)
        cross = [F.col(f"c{i}") for i in range(len(small))]
        sums = per.agg(
            F.max(F.abs(F.col("g")) / F.col("target")),
            *[F.sum(c) for c in cross], *[F.sum(c * F.col("g") / F.col("d")) for c in cross],
            *[F.sum(a * b / F.col("d")) for i, a in enumerate(cross) for b in cross[i:]], *[F.sum(f"m{i}_{j}") for i, j in pairs],
        ).first()
        if sums[0] is None:
            break
        n, move = len(small), np.zeros(len(small))
        error = sums[0]
        if n:
            gradient = np.array(sums[1 : n + 1]) - aims
            error = max(error, float(np.max(np.abs(gradient) / np.maximum(aims, 1.0))))
            block, taken = np.diag(np.array(sums[1 : n + 1])), np.zeros((n, n))
            ends = 2 * n + 1 + n * (n + 1) // 2
            taken[np.triu_indices(n)] = sums[2 * n + 1 : ends]
            for (i, j), x in zip(pairs, sums[ends:]):
                block[i, j] = block[j, i] = x
            schur = block - (taken + np.triu(taken, 1).T)
            # Families share a total, so the system has a free direction: the least move is taken.
            move = np.linalg.lstsq(schur, -(gradient - np.array(sums[n + 1 : 2 * n + 1])), rcond=1e-12)[0]
        if error <= TOLERANCE:
            duals = per.select(first, "dual")
            break
        step = -(F.col("g") + sum((c * float(m) for c, m in zip(cross, move)), F.lit(0.0))) / F.col("d")
        # Upward the exponential overshoots: no dual rises by more than 1 a step, and coupled moves shrink together.
        shrink = 1.0 / max(1.0, float(move.max())) if n else 1.0
        mu += shrink * move
        duals = per.select(first, (F.col("dual") + F.least(step * shrink, F.lit(1.0))).alias("dual"))
    else:
        raise RuntimeError(f"no balance within {STEPS} steps: do the families' targets share one total?")
    return duals if not small else duals.withColumn("others", F.array(*[F.lit(float(m)) for m in mu]))


def rates(cells: DataFrame, first: str, targets: DataFrame, others: dict[str, dict] | None = None) -> DataFrame:
    """cells with ``rate``: the exponential tilt of each, 0 where the first family gives no words or no target."""
    duals = balance(cells, first, targets, others)
    small = [(c, v) for c in others or {} for v in others[c]]
    if small:
        at = [F.when(F.col(c).eqNullSafe(F.lit(v)), F.element_at("others", i + 1)).otherwise(0.0) for i, (c, v) in enumerate(small)]
        joined = join_on(cells, duals, [first], "left")
        return joined.withColumn("rate", F.coalesce(F.exp(sum(at, F.col("dual"))), F.lit(0.0))).drop("dual", "others")
    return join_on(cells, duals, [first], "left").withColumn("rate", F.coalesce(F.exp("dual"), F.lit(0.0))).drop("dual")


def mix_rates(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """docs(doc_id, source, size, tie) with source_size, target, rate and copies.

    Order within a source is by hash of (doc_id, tie), so reruns agree; rows equal in
    all columns are interchangeable.
    """
    docs = settle(docs.select("doc_id", "source", "size", "tie"))
    targets = source_targets(docs, weights, share, ceiling)
    totals = settle(rates(targets.select("source", "words", "rows", "target"), "source", targets.select("source", "target")))
    rows = join_small(docs, totals, ["source"]).withColumn("large", F.col("size") * F.col("rows") > F.col("words") / 4)
    rows = rows.withColumnRenamed("words", "source_size").withColumn("h", F.xxhash64(F.lit(17), "doc_id", "tie"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS))
    rows = rows.withColumn("block", F.floor((F.shiftrightunsigned("h", 1) / F.lit(2.0**63)) * blocks).cast("long")).drop("rows")
    # A rate that is whole but for the last step's error has no part.
    near = F.abs(F.col("rate") - F.round("rate")) < 1e-6
    rows = rows.withColumn("whole", F.when(near, F.round("rate")).otherwise(F.floor("rate")))
    rows = rows.withColumn("part", F.when(near, F.lit(0.0)).otherwise(F.col("rate") - F.col("whole")))
    order = [F.col("h"), F.col("doc_id"), F.col("tie"), F.col("size")]
    rows = settle(running_before(rows, ["source", "large"], "block", order, "size"))
    sizes = lambda what: F.sum(F.when(what, F.col("size")).otherwise(0))
    classes = settle(rows.groupBy("source").agg(sizes(F.col("large")).alias("large_words"), sizes(~F.col("large")).alias("small_words")))
    rows = join_small(rows, classes, ["source"])
    got = F.col("large") & (F.col("before") + F.col("size") / 2 <= F.col("part") * F.col("large_words")) & (F.col("part") > 0)
    rows = rows.withColumn("extra", got)
    taken = settle(rows.groupBy("source").agg(sizes(F.col("extra")).alias("large_taken")))
    rows = join_small(rows, taken, ["source"])
    wanted = F.least("small_words", F.greatest(F.lit(0.0), F.col("part") * (F.col("large_words") + F.col("small_words")) - F.col("large_taken")))
    extra = F.col("extra") | (~F.col("large") & (F.col("before") + F.col("size") / 2 <= wanted) & (F.col("part") > 0))
    copies = F.least(F.lit(math.floor(ceiling)), (F.col("whole") + extra.cast("int"))).cast("int")
    return rows.select("doc_id", "source", "size", "tie", "source_size", "target", "rate", copies.alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): words of each text, null text none; tie tells texts of one id apart."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"], docs["source"], F.size(words(text)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes), copies, rate.

    Null source is a source of its own; null doc_id is an id like any other; empty
    texts have size 0 and take 0; repeated rows are mixed one by one; no rows in,
    none out.  Other columns are not read.
    """
    m = mix_rates(sized(docs), **options)
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as its copies say, all its columns kept.

    A document of no words cannot move a word count: it stays once.  Rows of equal
    id, source and text share the sum of their copies, dealt out among them in turn.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    key = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.xxhash64(text).alias("tie"))
    rates = mix_rates(sized(docs), **options).groupBy("doc_id", "source", "tie", "size").agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
    joined = join_on(key, rates, ["doc_id", "source", "tie"]).select("row", "size", "total", "rows")
    # Rows that are alike all over take the floor of the mean, and as many of them as needed one more.
    base, more = F.floor(F.col("total") / F.col("rows")), F.col("total") % F.col("rows")
    alike = Window.partitionBy(F.xxhash64("row"), "size").orderBy(F.xxhash64("row"))
    copies = F.when(F.col("size") == 0, 1).when(F.col("rows") == 1, F.col("total")).otherwise(base + (F.col("turn") <= more).cast("long"))
    single = joined.where("rows = 1").withColumn("turn", F.lit(1))
    several = joined.where("rows > 1").withColumn("turn", F.row_number().over(alike))
    out = single.unionByName(several).withColumn("n", copies.cast("int")).where("n > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
