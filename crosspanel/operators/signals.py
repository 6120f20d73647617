"""Event signals, scores and rankings as projections over (ticker, ..) rows.  Nothing reads the clock: ``as_of`` is an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import clip, col, div, series
from crosspanel.operators.metrics import global_row_number


def scaled_where(x: str, regime: str, threshold: float = 0.0, factor: float = 0.3) -> Column:
    """x where the regime reaches the threshold, else x * factor; an unknown regime scales too."""
    return F.when(F.col(regime) >= threshold, F.col(x)).otherwise(F.col(x) * factor)


def meaningful_trades(df: DataFrame, least: float = 1000.0) -> DataFrame:
    """Open-market purchases and sales without a plan, of some size where it is known."""
    return df.filter(~F.coalesce("is_10b5_1", F.lit(False)) & F.col("transaction_type").isin("P", "S") & (F.col("total_value").isNull() | (F.col("total_value") >= least)))


def excluded(df: DataFrame, price: str = "price", year: int = 252, fall: float = -0.3, drawdown: float = -0.5, least: int = 30, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Latest row of the entities that fell too far over the year or from their peak."""
    w = series(entity, time)
    frame = w.rowsBetween(-(year - 1), 0)
    df = df.withColumn("year_return", div(price, F.lag(price, year - 1).over(w)) - 1).withColumn("__d", div(price, F.max(price).over(frame)) - 1)
    df = df.withColumn("worst", F.when(F.count(price).over(frame) >= least, F.min("__d").over(frame)))
    last = df.withColumn("__n", F.row_number().over(w.orderBy(F.desc(time)))).filter("__n = 1")
    return last.filter((F.col("year_return") <= fall) | (F.col("worst") <= drawdown)).drop("__d", "__n")


def freshness(confidence: str, age_days: str, news: str, stale: int = 60, expired: int = 120) -> Column:
    """Struct of the confidence before and after: stale x 0.6, expired x 0.3, little news x 0.7."""
    c = F.col(confidence) * F.when(F.col(age_days) > expired, 0.3).when(F.col(age_days) > stale, 0.6).otherwise(1.0) * F.when(F.col(news) < 5, 0.7).otherwise(1.0)
    return F.struct(F.col(confidence).alias("before"), c.alias("after"))


def flags(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())


def reasons(conditions: dict[str, Column]) -> Column:
    return F.concat_ws("; ", *[F.when(c, F.lit(n)) for n, c in conditions.items()])


def conflicting(scores: list[str], threshold: float = 0.2, small: float = 0.05) -> Column:
    """Two scores of some size or more, one above and one below the threshold."""
    a = F.array(*[F.col(s) for s in scores])
    return (F.size(F.filter(a, lambda x: F.abs(x) > small)) >= 2) & F.exists(a, lambda x: x > threshold) & F.exists(a, lambda x: x < -threshold)


def review_selection(df: DataFrame, n: int, score: str = "score", conflict: str = "conflict", entity: str = "ticker") -> DataFrame:
    """Up to 3n rows: the n best buys, the n worst sells, conflicting ones, then others by size of their score."""
    size = [F.desc(F.abs(score)), entity]
    # No more of any kind can be chosen than are first in its order, so each kind is cut while it is sorted.
    cut = [df.filter(F.col(score) > 0).orderBy(*size).limit(n), df.filter(F.col(score) < 0).orderBy(*size).limit(n), df.filter(conflict).orderBy(*size).limit(5 * n), df.orderBy(*size).limit(5 * n)]
    keys = reduce(DataFrame.union, [c.select(entity) for c in cut]).distinct()
    df = df.join(F.broadcast(keys), entity, "left_semi")
    df = df.withColumn("__side", F.row_number().over(Window.partitionBy(F.col(score) > 0).orderBy(*size)))
    kind = F.when((F.col("__side") <= n) & (F.col(score) > 0), 0).when((F.col("__side") <= n) & (F.col(score) < 0), 1).when(F.col(conflict), 2).otherwise(3)
    df = df.withColumn("__kind", kind).withColumn("__o", F.row_number().over(Window.partitionBy("__kind").orderBy(F.desc(F.abs(score)), entity)))
    keep = df.filter(F.col("__o") <= 3 * n)  # no more of any kind can be chosen
    return keep.orderBy("__kind", "__o").limit(3 * n).select(*[c for c in df.columns if not c.startswith("__")], F.element_at(F.array(*map(F.lit, ("buy", "sell", "conflict", "fill"))), F.col("__kind") + 1).alias("reason"))


#: A big surprise, a small one, a big one in revenue; expected returns of 40 days of the two models; share of revenue in the
#: blended surprise; how revenue that confirms or contradicts changes the expected return.
BIG, SMALL, BIG_REVENUE, BASE_RETURN, ENHANCED_RETURN, REVENUE_SHARE, CONFIRMED, CONTRADICTED = 0.20, 0.05, 0.05, 0.0184, 0.0302, 0.30, 1.4, 0.7


def surprise_signal(
    df: DataFrame, as_of: str, surprise: str = "surprise", beat: str = "beat", before: str = "prior_beat", revenue: str = "revenue_surprise", time: str = "announcement_date",
) -> DataFrame:
    """Drift after earnings: adds days, freshness, composite_surprise, direction, strength, expected_return, actionable, hold_days.

    Surprises are shares (.2 is 20 %).  A big one is moderate, and strong if the quarter before went the same way; revenue that agrees
    raises a moderate one and the expected return, revenue that disagrees lowers both (revenue beats if its surprise is above 0).  A
    small one is weak, and moderate if a big revenue surprise agrees.  Otherwise the direction is neutral.
    """
    s, b, r = F.col(surprise), F.col(beat), F.col(revenue)
    big, small, known = F.abs(s) > BIG, F.abs(s) >= SMALL, r.isNotNull()
    same = known & (b == (r > 0))
    streak = F.coalesce(F.col(before) == b, F.lit(False))
    strength = F.when(big & same, "strong").when(big & known, "moderate").when(big & streak, "strong").when(big, "moderate")
    strength = strength.when(small & same & (F.abs(r) >= BIG_REVENUE), "moderate").otherwise("weak")
    sign = F.when(b, 1.0).otherwise(-1.0)
    size = F.when(big & same, ENHANCED_RETURN * CONFIRMED).when(big & known, ENHANCED_RETURN * CONTRADICTED).when(big, ENHANCED_RETURN).when(small, BASE_RETURN).otherwise(0.0)
    days = F.datediff(F.lit(as_of).cast("date"), time)
    out = df.withColumn("days", days).withColumn("freshness", F.when(days <= 10, "fresh").when(days <= 30, "recent").when(days <= 60, "stale").otherwise("expired"))
    out = out.withColumn("composite_surprise", F.when(known, (1 - REVENUE_SHARE) * s + REVENUE_SHARE * r).otherwise(s))
    out = out.withColumn("direction", F.when(big | small, F.when(b, "long").otherwise("short")).otherwise("neutral")).withColumn("strength", strength).withColumn("expected_return", size * sign)
    firm, early = F.col("strength") != "weak", F.col("freshness").isin("fresh", "recent")
    hold = F.when(firm & early, 40).when(firm & (F.col("freshness") == "stale"), 20).when(early & small, 40)
    return out.withColumn("hold_days", hold).withColumn("actionable", F.col("hold_days").isNotNull())


def insider_clusters(df: DataFrame, days: int = 30, least: int = 2, entity: str = "ticker", who: str = "insider_name", side: str = "transaction_type", time: str = "transaction_date", value: str = "total_value", role: str | None = None) -> DataFrame:
    """Windows of ``days`` from each transaction's day on in which at least so many different insiders act on the same side.

    An insider's day counts in the windows that start on it or up to ``days`` before, so each row meets a bounded number of windows and
    everything is summed by group.
    """
    weight = F.col(role) if role else F.lit(1.0)
    own = df.groupBy(entity, side, who, F.col(time).alias("day")).agg(F.sum(value).alias("value"), F.sum(weight).alias("__w"), F.count("*").alias("__k"))
    starts = own.select(entity, side, F.col("day").alias("start")).distinct()
    reach = own.withColumn("start", F.explode(F.sequence(F.date_sub("day", days), F.col("day")))).join(starts, [entity, side, "start"], "left_semi")
    found = reach.groupBy(entity, side, "start").agg(F.count_distinct(who).alias("insiders"), F.sum("value").alias("value"), F.max("day").alias("end"), div(F.sum("__w"), F.sum("__k")).alias("role_weight"))
    return found.filter(F.col("insiders") >= least)


def monthly_clusters(df: DataFrame, days: int = 30, least: int = 2, entity: str = "ticker", who: str = "insider_name", side: str = "transaction_type", time: str = "transaction_date", value: str = "total_value") -> DataFrame:
    """(entity, month, side, start, end, insiders, value): clusters of at most one starting day in each month.

    Of the days of a month on which anyone acts, the first counts from which on ``days`` hold at least so many different insiders on
    one side; then each side with so many is a cluster, from its first to its last day in the window.  A day is a row of its own and
    meets a bounded number of windows; no array of an entity's trades is built.
    """
    own = df.groupBy(entity, side, who, F.col(time).alias("day")).agg(F.sum(value).alias("value"))
    starts = own.select(entity, F.col("day").alias("__s")).distinct()
    reach = own.withColumn("__s", F.explode(F.sequence(F.date_sub("day", days), F.col("day")))).join(starts, [entity, "__s"], "left_semi")
    found = reach.groupBy(entity, "__s", side).agg(F.count_distinct(who).alias("insiders"), F.sum("value").alias("value"), F.min("day").alias("start"), F.max("day").alias("end"))
    found = found.filter(F.col("insiders") >= least).withColumn("month", F.trunc("__s", "month"))
    first = F.min("__s").over(Window.partitionBy(entity, "month"))  # at most the days of a month, twice
    return found.withColumn("__f", first).filter(F.col("__s") == F.col("__f")).select(entity, "month", side, "start", "end", "insiders", "value")


def separate_clusters(clusters: DataFrame, entity: str = "ticker", side: str = "transaction_type") -> DataFrame:
    """Greedy choice of clusters that don't overlap, the largest insiders * value first.

    The choice is sequential within an entity and side, whose clusters are folded as one array (at most one for each of its dates).
    """
    size = (F.col("insiders") * F.col("value")).alias("__s")
    rows = clusters.groupBy(entity, side).agg(F.sort_array(F.collect_list(F.struct(size, F.col("start"), F.col("end"), F.col("insiders"), F.col("value"), F.col("role_weight"))), asc=False).alias("__a"))
    empty = F.slice("__a", 1, 0)
    chosen = F.aggregate("__a", empty, lambda s, x: F.when(F.exists(s, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"])), s).otherwise(F.concat(s, F.array(x))))
    return rows.select(entity, side, F.inline(chosen)).select(entity, side, "start", "end", "insiders", "value", "role_weight")


def role_weight(title: str) -> Column:
    """Weight of an insider by title, from 1 for a chief executive to .3 for an unknown one.  The words are looked for anywhere, so a
    director ("cto" within) weighs .7."""
    t = F.lower(F.coalesce(title, F.lit("")))
    ranks = (
        ("ceo|chief executive", 1.0), ("cfo|chief financial", 0.9), ("coo|chief operating|president", 0.8), ("cto|chief tech|chief product", 0.7),
        ("director", 0.6), ("vp|vice president|evp|svp", 0.5), ("officer", 0.4),
    )
    return F.coalesce(*[F.when(t.rlike(words), weight) for words, weight in ranks], F.lit(0.3))


def insider_score(trades: DataFrame, clusters: DataFrame, entity: str = "ticker") -> DataFrame:
    """(entity, insider_score, confidence): .4 role-weighted net share of purchases + .6 of the clusters, inside [-1, 1].

    A cluster of n insiders counts (n - 2) x .15 x its mean role weight, one of sales minus half of that.  Confidence: up to .5 for ten
    trades, .3 for a cluster, .2 for a total value above a million.
    """
    buys = F.col("transaction_type") == "P"
    worth = F.col("total_value") * F.col("role_weight")
    up, down = F.coalesce(F.sum(F.when(buys, worth)), F.lit(0.0)), F.coalesce(F.sum(F.when(~buys, worth)), F.lit(0.0))
    total = F.coalesce(F.sum("total_value"), F.lit(0.0))
    net = trades.groupBy(entity).agg(F.when(total > 0, (up - down) / (up + down + 1)).otherwise(0.0).alias("net"), total.alias("__v"), F.count("*").alias("__n"))
    impact = (F.col("insiders") - 2) * 0.15 * F.col("role_weight") * F.when(buys, 1.0).otherwise(-0.5)
    both = net.join(clusters.groupBy(entity).agg(F.sum(impact).alias("cluster")), entity, "left")
    confidence = F.least(F.lit(1.0), F.col("__n") / 10) * 0.5 + F.when(F.col("cluster").isNotNull(), 0.3).otherwise(0.0) + F.when(F.col("__v") > 1_000_000, 0.2).otherwise(0.0)
    return both.select(entity, clip(0.4 * F.col("net") + 0.6 * F.coalesce("cluster", F.lit(0.0)), -1, 1).alias("insider_score"), F.least(F.lit(1.0), confidence).alias("confidence"))


def patent_score(df: DataFrame, as_of: str, emerging: list[str], entity: str = "ticker", time: str = "filing_date") -> DataFrame:
    """Patents of each entity up to a date: number, filings a year since the first, trend of the last year against the one before
    (20 %), 25 points each for number (of 100), speed (of 20), claims (of 20) and the share of emerging areas; the rank and signal that
    these give; and the moat, breadth x sqrt(depth) / 20 up to 1.  A row is a patent in one area."""
    age = F.datediff(F.lit(as_of).cast("date"), time)
    rows = df.filter(age >= 0)
    s = rows.groupBy(entity).agg(
        F.count("*").alias("patents"), F.max(age).alias("__first"), F.count(F.when(age < 365, 1)).alias("recent"), F.count(F.when((age > 365) & (age < 730), 1)).alias("before"),
        F.avg("claims_count").alias("__k"), F.count("area").alias("__in"), F.count(F.when(F.col("area").isin(emerging), 1)).alias("__e"), F.count_distinct("area").alias("__a"),
    )
    speed = F.col("patents") / F.greatest(F.col("__first") / 365, F.lit(1.0))
    part = lambda x: 25 * F.least(F.coalesce(x, F.lit(0.0)), F.lit(1.0))
    s = s.withColumn("velocity", speed).withColumn("score", part(F.col("patents") / 100) + part(speed / 20) + part(F.col("__k") / 20) + part(div("__e", F.nullif(F.col("__in"), F.lit(0)))))
    s = s.withColumn("trend", F.when(F.col("recent") > F.col("before") * 1.2, "accelerating").when(F.col("recent") < F.col("before") * 0.8, "decelerating").otherwise("stable"))
    s = s.withColumn("rank", F.when(F.col("score") >= 75, "pioneer").when(F.col("score") >= 50, "leader").when(F.col("score") >= 25, "average").otherwise("laggard"))
    s = s.withColumn("strength", F.when(F.col("score") >= 75, 0.8).when(F.col("score") >= 50, 0.5).when(F.col("score") >= 25, 0.0).otherwise(-0.3))
    moat = F.least(F.col("__a") * F.sqrt(div("__in", F.nullif(F.col("__a"), F.lit(0)))) / 20, F.lit(1.0))
    return s.withColumn("moat", F.coalesce(moat, F.lit(0.0))).drop("__first", "__k", "__in", "__e", "__a")


def sector_boost(df: DataFrame, strength: str = "strength", top: int = 3, bottom: int = 3, best: float = 0.30, worst: float = -0.25) -> DataFrame:
    """Rank of each sector; the boost falls from ``best`` for the first by equal steps over the ``top`` sectors, the headwind grows by equal
    steps over the ``bottom`` ones to ``worst`` for the last; others have none."""
    df = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(strength), "sector")).cast("long")).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))  # a row per sector
    headwind = worst * (F.col("rank") - (F.col("__n") - bottom)) / bottom
    return df.withColumn("boost", F.when(F.col("rank") <= top, best * (1 - (F.col("rank") - 1) / top)).when(F.col("rank") > F.col("__n") - bottom, headwind).otherwise(0.0)).drop("__n")


def breadth_tilt(df: DataFrame, score: str = "score", sector: str = "sector", weight: str | None = None, limit: float = 0.05, least: int = 3) -> DataFrame:
    """Per sector: weighted score, share above the limit, and a tilt 1 + .5 tanh(z / 2) in [.8, 1.2] from the gap of breadth to the mean."""
    w = F.col(weight) if weight else F.lit(1.0)
    s = df.groupBy(sector).agg(F.count("*").alias("n"), (F.sum(w * F.col(score)) / F.sum(w)).alias("mean_score"), F.avg((F.col(score) > limit).cast("double")).alias("breadth"))
    whole = Window.partitionBy()
    z = div(F.col("breadth") - F.avg("breadth").over(whole), F.nullif(F.stddev_pop("breadth").over(whole), F.lit(0.0)))
    return s.withColumn("tilt", F.when(F.col("n") < least, 1.0).otherwise(clip(1 + 0.5 * F.tanh(F.coalesce(z, F.lit(0.0)) / 2), 0.8, 1.2)))


def factor_regime(df: DataFrame, weights: dict[str, float], mild: float = 0.15, strong: float = 0.40) -> DataFrame:
    """Composite of indicator scores over those that say something, its regime and a confidence from size and agreement."""
    live = {c: F.abs(F.coalesce(F.col(c), F.lit(0.0))) > 0.001 for c in weights}
    total = sum((F.when(live[c], F.col(c) * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(live[c], F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    df = df.withColumn("composite", F.coalesce(div(total, F.nullif(weight, F.lit(0.0))), F.lit(0.0)))
    c = F.col("composite")
    agree = sum((F.when(live[k] & (F.signum(F.col(k)) == F.signum(c)), 1).otherwise(0) for k in weights), F.lit(0)) / F.greatest(sum((live[k].cast("int") for k in weights), F.lit(0)), F.lit(1))
    regime = F.when(c >= strong, "risk_on").when(c >= mild, "mild_risk_on").when(c <= -strong, "risk_off").when(c <= -mild, "mild_risk_off").otherwise("neutral")
    return df.withColumn("regime", regime).withColumn("confidence", clip(0.5 * F.least(F.abs(c) / strong, F.lit(1.0)) + 0.5 * agree, 0, 1))


def tilted_ic(ic: str, multiplier: str, strength: float, confidence: str | Column, exempt: Column | None = None) -> Column:
    """ic * (1 + (multiplier - 1) * strength * confidence); exempt rows keep theirs."""
    t = F.col(ic) * (1 + (F.col(multiplier) - 1) * strength * col(confidence))
    return F.when(exempt, F.col(ic)).otherwise(t) if exempt is not None else t


def composite(df: DataFrame, weights: dict[str, float], missing: float = 0.05, most: float = 0.2, tilt: str | None = None) -> DataFrame:
    """Weighted sum of scores (missing ones 0) less ``missing`` for each missing one, up to ``most``; then times the tilt.

    Confidence: .5 + .5 x the share that the commoner sign has among the scores beyond .1, less .1 for each missing one up to .5.
    """
    total = sum(weights.values()) or 1.0
    s = sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / total) for c, w in weights.items()), F.lit(0.0))
    absent = sum((F.col(c).isNull().cast("int") for c in weights), F.lit(0))
    pos = sum((F.coalesce(F.col(c) > 0.1, F.lit(False)).cast("int") for c in weights), F.lit(0))
    neg = sum((F.coalesce(F.col(c) < -0.1, F.lit(False)).cast("int") for c in weights), F.lit(0))
    score = s - F.least(absent * missing, F.lit(most))
    consensus = F.coalesce(div(F.greatest(pos, neg), F.nullif(pos + neg, F.lit(0))), F.lit(0.0))
    confidence = F.round(F.greatest(F.lit(0.0), F.round(0.5 + 0.5 * consensus, 3) - F.least(absent * 0.1, F.lit(0.5))), 3)
    return df.withColumn("composite", score * F.col(tilt) if tilt else score).withColumn("missing", absent).withColumn("confidence", confidence)


def percentile_signals(df: DataFrame, score: str = "composite", entity: str = "ticker", by: tuple[str, ...] = ()) -> DataFrame:
    """strong_buy / buy in the first 10 / 25 % with a positive score, sell / strong_sell in the last, else hold."""
    if by:
        w = Window.partitionBy(*by)
        df = df.withColumn("__p", (F.row_number().over(w.orderBy(F.desc(score), entity)) - 1) / F.count(F.lit(1)).over(w))
    else:
        df = global_row_number(df, [F.desc(score), F.col(entity)], "__k").withColumn("__p", (F.col("__k") - 1) / F.col("__k_of")).drop("__k", "__k_of")
    up, down = F.col(score) > 0, F.col(score) < 0
    return df.withColumn("signal", F.when((F.col("__p") < 0.1) & up, "strong_buy").when((F.col("__p") < 0.25) & up, "buy").when((F.col("__p") >= 0.9) & down, "strong_sell").when((F.col("__p") >= 0.75) & down, "sell").otherwise("hold")).drop("__p")


def threshold_signal(score: str, mild: float = 0.1, strong: float = 0.3) -> Column:
    s = F.col(score)
    return F.when(s >= strong, "strong_buy").when(s >= mild, "buy").when(s <= -strong, "strong_sell").when(s <= -mild, "sell").otherwise("hold")


def evidence_first(items: str, n: int = 3) -> Column:
    return F.slice(items, 1, n)


def agreement(scores: list[str], small: float = 0.05) -> Column:
    """Share of the scores of some size that have the majority's sign; NULL without any."""
    a = F.filter(F.array(*[F.col(s) for s in scores]), lambda x: F.abs(x) > small)
    pos = F.size(F.filter(a, lambda x: x > 0))
    return div(F.greatest(pos, F.size(a) - pos), F.nullif(F.size(a), F.lit(0)))


def keyword_vote(text: str, good: list[str], bad: list[str]) -> Column:
    """-1, 0 or 1: which list has more substrings in the text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    count = lambda ks: sum((F.contains(t, F.lit(k)).cast("int") for k in ks), F.lit(0))
    return F.signum(count(good) - count(bad)).cast("int")


def confidence_weighted(df: DataFrame, by: list[str], score: str = "score", confidence: str = "confidence") -> DataFrame:
    """Sum of score * confidence over the sum of confidences, and the share of rows with its sign."""
    s = df.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.coalesce(div(F.sum(F.col(score) * F.col(confidence)), F.nullif(F.sum(confidence), F.lit(0.0))), F.lit(0.0)).alias("aggregate"), F.count("*").alias("n"), F.avg((F.col(score) > 0).cast("double")).alias("__p"), F.avg((F.col(score) < 0).cast("double")).alias("__m"))
    return s.select(*by, "aggregate", "n", F.when(F.col("aggregate") > 0, F.col("__p")).when(F.col("aggregate") < 0, F.col("__m")).otherwise(0.0).alias("agreement"))


def moat_score(gross: str, roe: str, cap: str, profit: str, growth: str, operating: str, debt: str) -> Column:
    """Points for margins, return on equity, size, growth and debt (in percent of equity), inside [0, 1]; unknown and zero values give
    none."""
    def points(c: str, *bands: tuple[float, float]) -> Column:
        return F.coalesce(*[F.when(F.col(c) > limit, p) for limit, p in bands], F.lit(0.0))

    falling = F.when(F.col(growth) < 0, -0.1).otherwise(0.0)
    owed = F.when(F.col(debt) > 200, -0.1).when((F.col(debt) < 50) & (F.col(debt) != 0), 0.1).otherwise(0.0)
    total = points(gross, (0.6, 0.2), (0.4, 0.1)) + points(roe, (0.25, 0.2), (0.15, 0.1)) + points(cap, (500e9, 0.15), (100e9, 0.1)) + points(profit, (0.25, 0.15), (0.15, 0.08))
    return clip(total + points(growth, (0.2, 0.1)) + falling + points(operating, (0.3, 0.1)) + owed, 0, 1)


#: Themes that weigh half as much again.
HOT = ["artificial_intelligence", "cybersecurity", "energy_transition"]


def forward_score(momentum: str, moat: str, themes: Column | str, hot: list[str] | None = None) -> Column:
    """Outlook in [-1, 1]: .6 of the sector's momentum, .18 of the moat beyond .3, and .3 of each of the first three exposures (half as
    much again for hot themes), up to .4.  themes is an array of (theme, exposure) structs; what is NULL adds nothing."""
    col_ = F.col(themes) if isinstance(themes, str) else themes
    worth = F.transform(F.slice(col_, 1, 3), lambda x: x["exposure"] * 0.3 * F.when(x["theme"].isin(hot or HOT), 1.5).otherwise(1.0))
    theme = F.least(F.lit(0.4), F.aggregate(worth, F.lit(0.0), lambda s, x: s + x))
    parts = [F.col(momentum) * 2 * 0.3, (F.col(moat) - 0.3) * 0.6 * 0.3, theme]
    return clip(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), -1, 1)


def outlook(score: str | Column) -> Column:
    s = col(score)
    return F.when(s >= 0.3, "strong_tailwinds").when(s >= 0.1, "tailwinds").when(s > -0.1, "neutral").when(s > -0.3, "headwinds").otherwise("strong_headwinds")


def moat_width(score: str) -> Column:
    return F.when(F.col(score) >= 0.6, "wide").when(F.col(score) >= 0.35, "narrow").otherwise("none")


def theme_exposure(df: DataFrame, themes: DataFrame, text: str = "description", least: float = 0.3, most: int = 1000) -> DataFrame:
    """(row columns, theme, exposure): .8 for pure plays, .1 for each keyword up to .5, .4 for the sector, .5 for the industry.

    ``themes`` has theme, keywords, sectors, industries and pure (arrays), one row per theme; more than ``most`` are an error, as they
    are broadcast.
    """
    if themes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} themes")
    pairs = df.crossJoin(F.broadcast(themes))
    words_hit = F.least(0.1 * F.size(F.filter("keywords", lambda k: F.contains(F.lower(text), k))), F.lit(0.5))
    inside = lambda a, c: F.coalesce(F.array_contains(a, F.col(c)), F.lit(False))
    x = F.greatest(F.when(inside("pure", "ticker"), 0.8).otherwise(0.0), words_hit, F.when(inside("sectors", "sector"), 0.4).otherwise(0.0), F.when(inside("industries", "industry"), 0.5).otherwise(0.0))
    return pairs.withColumn("exposure", x).filter(F.col("exposure") >= least).select(*df.columns, "theme", "exposure")


def first_signal(ml: str, sentiment: str, value: str, risk: str) -> DataFrame | Column:
    """.5 model + .25 sentiment + .25 fundamentals, where cheapness and risk shift the last."""
    f = F.when(F.col(value) == "cheap", 0.5).when(F.col(value) == "expensive", -0.5).otherwise(0.0) - F.when(F.col(risk) == "high", 0.3).otherwise(0.0)
    return clip(0.5 * F.col(ml) + 0.25 * F.col(sentiment) + 0.25 * f, -1, 1)


def alignment_confidence(signs: list[str]) -> Column:
    """.9 when all non-zero signs agree, .7 for a majority, else .5."""
    a = F.filter(F.array(*[F.signum(F.col(s)) for s in signs]), lambda x: x != 0)
    s, n = F.abs(F.aggregate(a, F.lit(0.0), lambda t, x: t + x)), F.size(a)
    return F.when((n > 0) & (s == n), 0.9).when(s > 0, 0.7).otherwise(0.5)


def alpha_decay(days: str | Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear between (day, value) points, flat outside."""
    d = col(days)
    out = F.when(d <= points[0][0], points[0][1])
    for (a, x), (b, y) in zip(points, points[1:], strict=False):
        out = out.when(d <= b, x + (y - x) * (d - a) / (b - a))
    return out.otherwise(points[-1][1])


def penalised(score: str, residual: str, year_return: str, drawdown: str, threshold: float = -40.0, scale: float = 0.5) -> Column:
    """Score less a malus for residual momentum below -1 (.5 and .2 of its excess and its square), .5 for each 10 % that the year's
    return lies below -30 %, and ``scale`` for each 10 % that the drawdown lies below ``threshold`` (in percent); NULLs cost nothing."""
    weak = F.greatest(-1 - F.coalesce(residual, F.lit(0.0)), F.lit(0.0))
    year = F.least(F.lit(0.0), (F.col(year_return) * 100 + 30) / 10 * 0.5)
    deep = F.least(F.lit(0.0), (F.col(drawdown) * 100 - threshold) / 10) * scale
    return F.col(score) - 0.5 * weak - 0.2 * weak * weak + F.coalesce(year.cast("double"), F.lit(0.0)) + F.coalesce(deep.cast("double"), F.lit(0.0))


