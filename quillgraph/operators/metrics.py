"""Evaluation measures over (truth, predicted) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F




def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 for each class seen; 0 where undefined."""
    hit = (F.col("truth") == F.col("predicted")).cast("long")
    c = confusion(rows)
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum(hit * F.col("n")).alias("tp"), F.sum("n").alias("support"))
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    j = t.join(p, "label", "full").na.fill(0)
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    j = j.withColumn("precision", safe(F.col("tp"), F.col("guessed"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    return j.select("label", "tp", (F.col("guessed") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(safe(2 * F.col("tp"), F.col("guessed") + F.col("support")), 6).alias("f1"))


def kappa(rows: DataFrame) -> DataFrame:
    """Cohen's kappa, plain and quadratic-weighted, over numbered classes.

    Agreement by chance needs only the sums over each side's classes: the
    weighted one is a difference of moments, the plain one meets by class.
    """
    c = confusion(rows)
    apart = F.pow(F.col("truth") - F.col("predicted"), 2) * F.col("n")
    power = lambda x, k: F.sum(F.pow(F.col(x).cast("double"), k) * F.col("n"))
    m = c.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0)).alias("off"), F.sum(apart).alias("far"), power("truth", 1).alias("t1"), power("truth", 2).alias("t2"), power("predicted", 1).alias("p1"), power("predicted", 2).alias("p2"))
    t, p = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("nt")), c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("np"))
    same = t.join(p, "label").agg(F.coalesce(F.sum(F.col("nt").cast("double") * F.col("np")), F.lit(0.0)).alias("same"))
    total = F.col("total").cast("double")
    by_chance, far_by_chance = total - F.col("same") / total, F.col("t2") + F.col("p2") - 2 * F.col("t1") * F.col("p1") / total
    # One row on either side.
    return m.join(F.broadcast(same)).select(F.round(1 - F.try_divide(F.col("off"), by_chance), 6).alias("kappa"), F.round(1 - F.try_divide(F.col("far"), far_by_chance), 6).alias("weighted_kappa"))


def overall(rows: DataFrame) -> DataFrame:
    """n, accuracy, balanced accuracy, macro and weighted F1 over the classes seen, and Matthews' coefficient."""
    c = confusion(rows)
    t, p = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp")), c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    j = t.join(p, "label", "full").na.fill(0).withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("guessed")), F.lit(0.0)))
    double = lambda x: F.col(x).cast("double")
    s = j.agg(F.sum("support").alias("n"), F.sum("tp").alias("c"), F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("balanced"), F.avg("f1").alias("macro"), F.sum(F.col("f1") * F.col("support")).alias("weighted"), F.sum(double("support") * double("guessed")).alias("tp_"), F.sum(double("support") * double("support")).alias("tt"), F.sum(double("guessed") * double("guessed")).alias("pp"))
    square = double("n") * double("n")
    mcc = F.coalesce(F.try_divide(double("c") * double("n") - F.col("tp_"), F.sqrt((square - F.col("pp")) * (square - F.col("tt")))), F.lit(0.0))
    return s.select("n", F.round(F.col("c") / F.col("n"), 6).alias("accuracy"), F.round("balanced", 6).alias("balanced_accuracy"), F.round("macro", 6).alias("macro_f1"), F.round(F.col("weighted") / F.col("n"), 6).alias("weighted_f1"), F.round(mcc, 6).alias("mcc"))


def grouped_macro_f1(rows: DataFrame, group: str) -> DataFrame:
    """Per group: n and the mean F1 of the classes seen in it."""
    both = rows.select(group, F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("g"), (F.col("truth") == F.col("predicted")).cast("int").alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("g"), F.lit(0).alias("tp")))).alias("e"))
    c = both.groupBy(group, "e.label").agg(F.sum("e.s").alias("s"), F.sum("e.g").alias("g"), F.sum("e.tp").alias("tp"))
    return c.groupBy(group).agg(F.sum("s").alias("n"), F.round(F.avg(2 * F.col("tp") / (F.col("s") + F.col("g"))), 6).alias("macro_f1"))


def mcnemar(rows: DataFrame) -> DataFrame:
    """Exact two-sided p from (first_right, second_right): which of two predictions is right where they differ; 1 without such rows."""
    d = rows.agg(F.count_if(F.col("first_right") & ~F.col("second_right")).alias("b"), F.count_if(~F.col("first_right") & F.col("second_right")).alias("c"))
    n, least = F.col("b") + F.col("c"), F.least("b", "c")
    # log C(n, i) grows from i to i + 1 by log((n - i) / (i + 1)); the sum of the tail is taken in logs.
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    step = lambda s, i: F.struct((s["term"] + F.log((n - i + 1).cast("double") / i)).alias("term"), (s["sum"] + F.exp(s["term"] + F.log((n - i + 1).cast("double") / i))).alias("sum"))
    tail = F.when(least == 0, start["sum"]).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(least, F.lit(1))), start, step)["sum"])
    return d.select("b", "c", F.round(F.when(n == 0, 1.0).otherwise(F.least(2 * tail, F.lit(1.0))), 9).alias("p"))


def _drawn(groups: DataFrame, draws: int, seed: int) -> DataFrame:
    """``groups`` (c, ...) once for each draw, with ``w``: how often it is drawn, Poisson(1) by a hash of group and draw."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("c").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))), 1, 10), 16, 10).cast("long") + 0.5) / float(1 << 40)
    weight = sum((F.when(F.col("_u") >= limit, 1).otherwise(0) for limit in (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)), F.lit(0))
    return groups.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_u", u).withColumn("w", weight).drop("_u")


def bootstrap_metrics(rows: DataFrame, cluster: str, draws: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """metric, low, high, mean of accuracy, macro_f1, kappa and weighted_kappa (classes as numbers), resampling clusters.

    A cluster is its counts of (truth, predicted). They are weighted and summed
    to one confusion for each draw before they are shuffled; every metric comes
    from these draws x classes x classes counts.
    """
    own = rows.groupBy(F.col(cluster).alias("c"), "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    own = own.groupBy("c").agg(F.collect_list(F.struct("truth", "predicted", "n")).alias("cells"))
    # A cluster is drawn once, with all its counts; those of one that is not drawn make no row.
    drawn = _drawn(own, draws, seed).select("draw", "w", F.explode(F.when(F.col("w") > 0, F.col("cells"))).alias("e"))
    seen = drawn.groupBy("draw", "e.truth", "e.predicted").agg(F.sum(F.col("w") * F.col("e.n")).alias("n"))
    truth = seen.groupBy("draw", F.col("truth").alias("label")).agg(F.sum("n").alias("s"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    guess = seen.groupBy("draw", F.col("predicted").alias("label")).agg(F.sum("n").alias("g"))
    classes = truth.join(guess, ["draw", "label"], "full").na.fill(0, ["s", "tp", "g"])
    s, g, k = F.col("s"), F.col("g"), F.col("label")
    by_draw = classes.groupBy("draw").agg(
        F.sum("s").alias("all"), F.sum("tp").alias("right"), F.avg(2 * F.col("tp") / (s + g)).alias("macro_f1"), F.sum(s.cast("double") * g).alias("chance"),
        F.sum(k * k * s).alias("ss"), F.sum(k * s).alias("st"), F.sum(k * k * g).alias("gg"), F.sum(k * g).alias("gt"),
    )
    far = seen.groupBy("draw").agg(F.sum((F.col("truth") - F.col("predicted")) ** 2 * F.col("n")).alias("far"))
    n, apart = F.col("all"), F.col("chance") / F.col("all") / F.col("all")
    # Distance by chance: the mean of (truth - predicted) ** 2 over independent classes.
    by_chance = (F.col("ss") + F.col("gg")) / n - 2.0 * F.col("st") * F.col("gt") / n / n
    metrics = {"accuracy": F.col("right") / n, "macro_f1": F.col("macro_f1"), "kappa": F.try_divide(F.col("right") / n - apart, 1 - apart), "weighted_kappa": 1 - F.try_divide(F.col("far") / n, by_chance)}
    long = by_draw.join(far, "draw").select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in metrics.items()])).alias("r")).select("r.*")
    tail = (1 - level) / 2
    # A value for each draw.
    return long.groupBy("metric").agg(*[F.round(x, 6).alias(c) for c, x in (("low", F.percentile("value", F.lit(tail))), ("high", F.percentile("value", F.lit(1 - tail))), ("mean", F.avg("value")))])


def bootstrap_mean(rows: DataFrame, cluster: str, value: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of a mean, resampling clusters with Poisson(1) weights.

    Each cluster is summed first and meets every draw; a weight depends only on
    (cluster, draw), so lost tasks repeat alike.
    """
    sums = rows.groupBy(F.col(cluster).alias("c")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = _drawn(sums, draws, seed)
    means = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.avg("mean").alias("mean"))


def weighted(rows: DataFrame, weight: Column) -> DataFrame:
    """Accuracy and mean F1 of the classes seen, each row counting by its weight."""
    right = F.col("truth") == F.col("predicted")
    c = rows.groupBy("truth", "predicted").agg(F.sum(weight).cast("double").alias("w"))
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("w").alias("s"), F.sum(F.when(right, F.col("w")).otherwise(0.0)).alias("tp"))
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("w").alias("g"))
    j = t.join(p, "label", "full").na.fill(0)
    return j.filter(F.col("s") + F.col("g") > 0).agg(F.round(F.try_divide(F.sum("tp"), F.sum("s")), 6).alias("weighted_accuracy"), F.round(F.avg(2 * F.col("tp") / (F.col("s") + F.col("g"))), 6).alias("macro_f1"))


def hit_rates(rows: DataFrame, up: str, realised: str, cost: float) -> DataFrame:
    """n, share of right directions, share of rises, mean move and the hit rate at which trading at ``cost`` breaks even."""
    rose, move = F.col(realised) > 0, F.avg(F.abs(realised))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(up) == rose).cast("int")), 6).alias("hit_rate"), F.round(F.avg(rose.cast("int")), 6).alias("base_rate"),
        F.round(move, 6).alias("mean_move"), F.round(0.5 + F.try_divide(F.lit(cost), 2 * move), 6).alias("break_even"),
    )


def band_verdict(bands: DataFrame) -> DataFrame:
    """Whether realised shares rise from band to band (band, mean, share), and whether the means lie above them. One row a band."""
    before = F.lag("share").over(Window.orderBy("band"))
    rising = F.bool_and(F.coalesce(F.col("share") > F.col("before"), F.lit(True)))
    s = bands.withColumn("before", before).agg(F.count(F.lit(1)).alias("bands"), rising.alias("rising"), F.avg(F.col("mean") - F.col("share")).alias("above"))
    ranks = (F.col("bands") >= 2) & F.col("rising")
    return s.select("bands", F.when(~ranks, "DOES_NOT_RANK").when(F.col("above") > 0, "RANKS_WELL_BUT_OVERSTATES_LEVEL").otherwise("RANKS_WELL").alias("verdict"))


def mean_probability(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda a, b: (a + b) / 2)


def best_class(probabilities: Column) -> Column:
    """Place, from 1, of the greatest; the first of equal ones."""
    return F.array_position(probabilities, F.array_max(probabilities)).cast("int")


def expected_net(probabilities: Column, class_means: Sequence[float], cost: float) -> Column:
    parts = F.zip_with(probabilities, F.array(*map(F.lit, class_means)), lambda p, m: p * m)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) - cost


def gated_delta(rows: DataFrame, cluster: str, a: str, b: str, least: float, draws: int = 1000) -> DataFrame:
    """Mean of a - b, its interval over resampled clusters, and whether it passes: by ``least`` and above 0, or only not below 0."""
    each = rows.withColumn("_delta", F.col(a) - F.col(b))
    interval = bootstrap_mean(each, cluster, "_delta", draws)
    # One row on either side.
    both = each.agg(F.avg("_delta").alias("delta")).join(F.broadcast(interval.select("low", "high")))
    return both.select(F.round("delta", 6).alias("delta"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), ((F.col("delta") >= least) & (F.col("low") > 0)).alias("primary_gate"), (F.col("delta") >= 0).alias("strict_gate"))


def gates(found: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """metric, value, threshold, passed for the columns of a one-row table; an absent value does not pass."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for m, t in thresholds.items()])
    long = found.select(F.explode(rows).alias("r")).select("r.*")
    return long.select("metric", F.round("value", 6).alias("value"), "threshold", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("passed"))


def parity(one: DataFrame, two: DataFrame, keys: list[str], features: list[str], tolerance: float = 1e-6, share: float = 0.999) -> DataFrame:
    """Rows of ``one``, those whose features all agree with ``two`` (both null agrees), and whether these reach ``share``."""
    other = two.select(*keys, *[F.col(f).alias(f"_{f}") for f in features], F.lit(True).alias("_there"))
    agree = [F.coalesce(F.abs(F.col(f) - F.col(f"_{f}")) <= tolerance, F.col(f).isNull() & F.col(f"_{f}").isNull()) for f in features]
    all_agree = F.col("_there").isNotNull()
    for a in agree:
        all_agree = all_agree & a
    s = one.join(other, keys, "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(all_agree).alias("same"))
    return s.withColumn("passed", F.col("same") >= share * F.col("n"))
