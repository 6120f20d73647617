"""Dictionary-based text measures.  Word lists and patterns are arguments; the defaults are short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import clip, col, div, series, upper_median

#: Punctuation that is stripped from words before they are looked up.
EDGES = ".,!?;:"


def words(text: str | Column) -> Column:
    """Lower-case words split at white space, without edge punctuation; empty for NULL."""
    parts = F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.btrim(w, F.lit(EDGES)))


def hits(tokens: str | Column, lexicon: list[str]) -> Column:
    """How many of the words are in the list.  Spark looks words up in a hash set as soon as the list has more than ten."""
    return F.size(F.filter(col(tokens), lambda w: w.isin(*lexicon)))


def whole(pattern: str) -> str:
    """The pattern where no letter, digit or underscore stands beside it, in any case."""
    return rf"(?is)(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"


def topic_score(text: str | Column, keywords: list[str]) -> Column:
    """Different keywords found, plus half of each further match."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(whole("|".join(keywords))), 0)
    # Matches are bound to a name, so that the pattern runs once however often they are counted.
    return F.transform(F.array(found), lambda m: F.size(F.array_distinct(m)) + 0.5 * (F.size(m) - F.size(F.array_distinct(m))))[0]


def with_topic(df: DataFrame, text: str, topics: dict[str, list[str]], out: str = "topic") -> DataFrame:
    """Best topic (the earlier one on ties, 'other' without a match), its score, and the other topics with a score of 1 or more."""
    scores = [F.struct(topic_score(text, k).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("topic")) for i, (t, k) in enumerate(topics.items())]
    df = df.withColumn("__s", F.array(*scores)).withColumn("__b", F.array_max("__s"))
    best = F.when(F.col("__b.score") > 0, F.col("__b.topic")).otherwise("other")
    more = F.transform(F.filter("__s", lambda x: (x["score"] >= 1) & (x["topic"] != F.col("__b.topic"))), lambda x: x["topic"])
    return df.withColumn(out, best).withColumn(f"{out}_score", F.col("__b.score")).withColumn(f"{out}_secondary", F.array_join(more, ",")).drop("__s", "__b")


def with_lexicon_sentiment(df: DataFrame, text: str, positive: list[str], negative: list[str], uncertain: list[str] | None = None) -> DataFrame:
    """Counts and (positive - negative) / sqrt(words) inside [-1, 1]; 0 without words."""
    df = df.withColumn("__w", words(text))
    df = df.select("*", hits("__w", positive).alias("n_positive"), hits("__w", negative).alias("n_negative"), hits("__w", uncertain or [""]).alias("n_uncertain"), F.size("__w").alias("n_words"))
    raw = F.when(F.col("n_words") > 0, clip((F.col("n_positive") - F.col("n_negative")) / F.sqrt("n_words"), -1, 1)).otherwise(0.0)
    unc = F.when(F.col("n_words") > 0, F.least(F.col("n_uncertain") / F.sqrt("n_words"), F.lit(1.0))).otherwise(0.0)
    return df.withColumn("sentiment", raw).withColumn("uncertainty", unc).drop("__w")


def adjusted_sentiment(sentiment: str | Column, multiplier: str | Column, impact: str | Column) -> Column:
    """Bad news times m, good news times 2 - m, plus the topic's own impact, inside [-1, 1]."""
    s, m = col(sentiment), col(multiplier)
    return clip(F.when(s < 0, s * m).otherwise(s * (2 - m)) + col(impact), -1, 1)


def sentiment_label(x: str | Column, limit: float = 0.15) -> Column:
    return F.when(col(x) > limit, "bullish").when(col(x) < -limit, "bearish").otherwise("neutral")


def topic_signal(
    df: DataFrame, by: list[str], topic: str = "topic", secondary: str = "topic_secondary", sentiment: str = "adjusted", strong: tuple[str, ...] = (),
    litigation: str = "litigation", management: str = "management", earnings: str = "earnings",
) -> DataFrame:
    """Per group: the mean of its topics' sentiments, weighted by the root of their counts (half again for strong topics).

    A topic's sentiment is the mean over its articles; an article also counts for its secondary topics, there with half its sentiment.
    Adds the direction beyond .1, a confidence (articles, of 10), the most frequent topic, and alerts: two articles on litigation below
    -.2, one on management below -.1, one on earnings beyond .3.
    """
    # One pass: the texts behind these columns are read once, and each article gives a row for its own topic and one for each other.
    one = lambda t, x, own: F.struct(t.alias("__t"), x.alias("__x"), F.lit(own).alias("__own"))
    others = F.filter(F.split(F.coalesce(secondary, F.lit("")), ","), lambda t: t != "")
    rows = F.concat(F.array(one(F.col(topic), F.col(sentiment).cast("double"), 1)), F.transform(others, lambda t: one(t, F.col(sentiment) * 0.5, 0)))
    t = df.select(*by, F.inline(rows)).groupBy(*by, "__t").agg(F.avg("__x").alias("__x"), F.count("*").alias("__n"), F.sum("__own").alias("__a"))
    w = F.sqrt("__n") * (F.when(F.col("__t").isin(*strong), 1.5).otherwise(1.0) if strong else F.lit(1.0))
    alert = lambda name, least, bad: F.coalesce(F.max((F.col("__t") == name) & (F.col("__n") >= least) & bad), F.lit(False))
    x = F.col("__x")
    s = t.withColumn("__w", w).groupBy(*by).agg(
        (F.sum(F.col("__w") * x) / F.sum("__w")).alias("signal"), F.least(F.sum("__a") / 10, F.lit(1.0)).alias("confidence"), F.max_by("__t", F.struct("__n", "__t")).alias("top_topic"),
        alert(litigation, 2, x < -0.2).alias("litigation_alert"), alert(management, 1, x < -0.1).alias("management_alert"), alert(earnings, 1, F.abs(x) > 0.3).alias("earnings_alert"),
    )
    return s.withColumn("direction", F.when(F.col("signal") > 0.1, "bullish").when(F.col("signal") < -0.1, "bearish").otherwise("neutral"))


#: Fixed values of the earnings signal: what counts as a direction, a strong sentiment, the boost of agreement, and returns of five days.
SLIGHT, STRONG, AGREEMENT, NEUTRAL_RETURN, BULLISH_RETURN, BEARISH_RETURN = 0.05, 0.2, 1.4, 0.0038, 0.0068, 0.0003


def earnings_signal(df: DataFrame, by: list[str], topic: str = "is_earnings", sentiment: str = "sentiment", model: str = "model_score", least: int = 1, firm: int = 2) -> DataFrame:
    """Per group, from its articles on earnings: sentiment, direction, whether another model agrees, confidence, score and expected return.

    Articles are counted all (``articles``) and on the topic (``on_topic``); sentiments are means over the latter, the model's over those
    that have one.  Beyond .2 the direction is bullish or bearish, else neutral and not tradeable.  Models agree if their directions
    (beyond .05) are the same or either is neutral; the same direction that isn't neutral boosts score and confidence by 1.4.
    Confidence: .5 for the size of the sentiment (of .5), .3 for articles (of 3), .2 for agreement.  A group without articles on the
    topic has sentiment 0, no direction and no confidence.
    """
    about = F.coalesce(F.col(topic), F.lit(False))
    s = df.groupBy(*by).agg(
        F.count("*").alias("articles"), F.count(F.when(about, 1)).alias("on_topic"), F.coalesce(F.avg(F.when(about, F.col(sentiment))), F.lit(0.0)).alias("sentiment"),
        F.avg(F.when(about, F.col(model))).alias("model_sentiment"),
    )
    way = lambda c: F.when(F.col(c) > SLIGHT, 1).when(F.col(c) < -SLIGHT, -1).when(F.col(c).isNotNull(), 0)
    a, b, n, x = way("sentiment"), way("model_sentiment"), F.col("on_topic"), F.col("sentiment")
    agree = (a == b) | (a == 0) | (b == 0)
    s = s.withColumn("agree", F.when(b.isNotNull() & (n > 0), agree)).withColumn("boost", F.when((n > 0) & (a == b) & (a != 0), AGREEMENT).otherwise(1.0))
    s = s.withColumn("direction", F.when(n == 0, F.lit(None)).when(x > STRONG, "bullish").when(x < -STRONG, "bearish").otherwise("neutral"))
    confidence = F.least(F.abs(x) / 0.5, F.lit(1.0)) * 0.5 + F.least(n / 3, F.lit(1.0)) * 0.3 + F.when(F.col("agree"), 0.2).otherwise(0.0)
    s = s.withColumn("confidence", F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), confidence * F.col("boost")))).withColumn("score", x * F.sqrt(n) * F.col("boost"))
    s = s.withColumn("expected_return", F.when(n == 0, F.lit(None)).when(F.col("direction") == "bullish", BULLISH_RETURN).when(F.col("direction") == "bearish", BEARISH_RETURN).otherwise(NEUTRAL_RETURN))
    s = s.withColumn("expected_alpha", F.col("expected_return") - NEUTRAL_RETURN).withColumn("tradeable", F.coalesce((n >= least) & F.col("direction").isin("bullish", "bearish"), F.lit(False)))
    return s.withColumn("high_conviction", n >= firm).withColumn("earnings_surprise", (F.abs(x) > 0.4) & (n >= 2))


def with_tone(df: DataFrame, text: str, lists: dict[str, list[str]]) -> DataFrame:
    """Share of each word list among the words of a whole filing without tags, and the net tone (p - n) / (p + n)."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"&[a-zA-Z#0-9]+;", " "), r"\s+", " ")
    tokens = F.regexp_extract_all(F.lower(plain), F.lit(r"([a-zA-Z]+)"), 1)
    df = df.withColumn("__w", tokens).withColumn("tone_words", F.size("__w"))
    df = df.select("*", *[hits("__w", v).alias(f"__{k}") for k, v in lists.items()])
    df = df.select("*", *[F.coalesce(div(f"__{k}", F.nullif(F.col("tone_words"), F.lit(0))), F.lit(0.0)).alias(k) for k in lists])
    if {"positive", "negative"} <= lists.keys():
        df = df.withColumn("net_tone", F.coalesce(div(F.col("__positive") - F.col("__negative"), F.nullif(F.col("__positive") + F.col("__negative"), F.lit(0))), F.lit(0.0)))
    return df.drop("__w", *[f"__{k}" for k in lists])


def tone_change(df: DataFrame, tone: str = "net_tone", entity: str = "ticker", time: str = "date", as_of: str | Column | None = None) -> DataFrame:
    """Change against the entity's previous filing, a label, and the change faded out over 120 days up to ``as_of``."""
    df = df.withColumn("change", F.col(tone) - F.lag(tone).over(series(entity, time)))
    label = F.when(F.col("change") >= 0.06, "much_better").when(F.col("change") >= 0.03, "better").when(F.col("change") <= -0.06, "much_worse").when(F.col("change") <= -0.03, "worse").when(F.col("change").isNotNull(), "same")
    df = df.withColumn("label", label)
    if as_of is not None:
        df = df.withColumn("faded", F.col("change") * F.greatest(F.lit(0.0), 1 - F.datediff(col(as_of), F.col(time)) / 120.0))
    return df


def parse_transcript(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key.., section, speaker, content, is_qa).

    A line opens a section if it starts with a name before a colon: fewer than 80 characters, at most eight words, no digit.  Questions
    start at the first section that announces them, or after two fifths of the sections.
    """
    lines = df.select(*key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("__i", "__line"))
    name = F.regexp_extract("__line", r"^\s*([^:]{1,79}):", 1)
    opens = (name != "") & ~name.rlike(r"\d") & (F.size(F.split(F.trim(name), r"\s+")) <= 8)
    w = Window.partitionBy(*key).orderBy("__i")
    lines = lines.withColumn("__o", opens.cast("int")).withColumn("section", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("__n", F.when(F.col("__o") == 1, F.trim(name))).withColumn("__c", F.when(F.col("__o") == 1, F.regexp_replace("__line", r"^\s*[^:]{1,79}:\s*", "")).otherwise(F.col("__line")))
    out = lines.filter("section > 0").groupBy(*key, "section").agg(F.max("__n").alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__c"))), lambda x: x["__c"]), "\n").alias("content"))
    own = Window.partitionBy(*key)
    mark = F.min(F.when(F.lower("content").rlike("question.and.answer|q&a|first question|take questions|open the (line|floor)"), F.col("section"))).over(own)
    start = F.coalesce(mark, F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(own) * 2 / 5)) + 1)
    return out.withColumn("is_qa", F.col("section") >= start)


def speaker_role(speaker: str | Column) -> Column:
    s = F.lower(col(speaker))
    return F.when(s.rlike(r"\b(ceo|cfo|coo|cto|president|chairman|chief|vp|director|head of)\b"), "management").when(s.rlike("analyst"), "analyst").when(s.contains("operator"), "operator").otherwise("other")


def sentences(text: str | Column, least: int = 10) -> Column:
    """Sentences of more than ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > least)


def hedging(text: str | Column, hedge_words: list[str], phrases: list[str]) -> Column:
    """Share of hedging words plus phrase hits, over the words."""
    w = words(text)
    count = hits(w, hedge_words)
    for p in phrases:
        count = count + F.regexp_count(F.lower(text), F.lit(p))
    return F.coalesce(div(count, F.nullif(F.size(w), F.lit(0))), F.lit(0.0))


def guidance(text: str | Column, specific: list[str], vague: list[str]) -> Column:
    """(specific - vague) / (specific + vague) matches, 0 without any."""
    t = F.lower(text)
    a = sum((F.regexp_count(t, F.lit(p)) for p in specific), F.lit(0))
    b = sum((F.regexp_count(t, F.lit(p)) for p in vague), F.lit(0))
    return F.coalesce(div(a - b, F.nullif(a + b, F.lit(0))), F.lit(0.0))


def weighted_composite(parts: dict[str, float]) -> Column:
    """Weighted mean of the parts that exist; the weight of the others goes to them."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return div(total, F.nullif(weight, F.lit(0.0)))


def half_life(days: str | Column, half: float = 45.0, grace: float = 14.0) -> Column:
    """1 during the grace days, then halved every ``half`` days."""
    return F.pow(F.lit(0.5), F.greatest(col(days) - grace, F.lit(0.0)) / half)


def _context(term: str):
    return lambda x: F.struct(F.lit(term).alias("term"), F.concat(x["a"], x["b"], x["c"]).alias("context"))


def mentions(df: DataFrame, key: list[str], text: str, terms: dict[str, str], context: int = 50) -> DataFrame:
    """(key.., term, context) of every match of each term's pattern, with up to ``context`` characters on both sides.

    One pass over the table.  The surroundings are captured without being passed over, so matches that lie close together all count.
    NULL texts have none.
    """
    found = []
    for term, pattern in terms.items():
        # The term is looked for first, and only where it stands the characters on either side are captured.
        around = rf"(?is)(?=(?:{pattern})(?![\p{{L}}\p{{N}}_]))(?<![\p{{L}}\p{{N}}_])(?<=(^.{{0,{context - 1}}}|.{{{context}}}))(?:{pattern})(?=(.{{0,{context}}}))"
        sides = [F.regexp_extract_all(text, F.lit(around), i).alias(n) for i, n in ((1, "a"), (0, "b"), (2, "c"))]
        found.append(F.transform(F.arrays_zip(*sides), _context(term)))
    return df.filter(F.col(text).isNotNull()).select(*key, F.inline(F.concat(*found)))


def mention_profile(found: DataFrame, key: list[str], emerging: list[str], moat: list[str], totals: DataFrame | None = None) -> DataFrame:
    """Per key: mentions, different terms, shares of emerging and moat terms, and the five most frequent terms."""
    counts = found.groupBy(*key, "term").agg(F.count("*").alias("__n"))
    ranked = counts.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__n"), "term")))
    n = F.sum("__n")
    return ranked.groupBy(*key).agg(n.alias("mentions"), F.count("*").alias("terms"), (F.sum(F.when(F.col("term").isin(*emerging), F.col("__n")).otherwise(0)) / n).alias("emerging_ratio"), (F.sum(F.when(F.col("term").isin(*moat), F.col("__n")).otherwise(0)) / n).alias("moat_ratio"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__k") <= 5, F.struct("__k", "term")))), lambda x: x["term"]), ",").alias("top_terms"))


def period_change(df: DataFrame, value: str, terms: str, entity: str, time: str, lag: int = 1) -> DataFrame:
    """Relative change of a count against an earlier row, its direction at 20 %, and the terms that came and went."""
    w = series(entity, time)
    before, old = F.lag(value, lag).over(w), F.lag(terms, lag).over(w)
    df = df.withColumn("change", div(F.col(value) - before, F.nullif(before, F.lit(0)))).withColumn("added", F.array_except(terms, old)).withColumn("dropped", F.array_except(old, F.col(terms)))
    return df.withColumn("trajectory", F.when(F.col("change") > 0.2, "accelerating").when(F.col("change") < -0.2, "declining").when(F.col("change").isNotNull(), "stable"))


def first_mentions(found: DataFrame, entity: str, term: str, time: str) -> DataFrame:
    return found.groupBy(entity, term).agg(F.min(time).alias("first_date"), F.count("*").alias("mentions"))


def timeline(first: DataFrame, entity: str, term: str) -> DataFrame:
    """Per term: first adopter and date, number of adopters, and the upper median of the dates."""
    kind = dict(first.dtypes)["first_date"]
    number = F.unix_date("first_date") if kind == "date" else F.col("first_date")
    t = first.withColumn("__d", number).groupBy(term).agg(
        F.min("first_date").alias("earliest"), F.min_by(entity, F.struct("first_date", entity)).alias("first_adopter"), F.count("*").alias("adopters"), upper_median("__d").alias("median_date")
    )
    return t.withColumn("median_date", F.date_from_unix_date(F.col("median_date").cast("int")) if kind == "date" else F.col("median_date").cast(kind))


def pioneer_score(first: DataFrame, lines: DataFrame, entity: str, term: str, as_of: str, emerging: list[str] | None = None, half: float = 24.0, relevance: DataFrame | None = None) -> DataFrame:
    """Per entity: months of lead over the median adopter faded with a half-life, breadth, emerging terms, and their mix in [0, 1]: .3
    breadth (of 8), .4 emerging (of 4), .3 lead (of 12 months).

    ``relevance`` (entity, term, weight), where given, adds the sector's part: half the number of terms of weight 1.5 or more (of 4),
    half the weighted lead (terms not named weigh 1).  Where that is above 0 it makes a quarter of the score.
    """
    joined = first.join(lines.select(term, "median_date"), term)
    lead = F.datediff("median_date", "first_date") / 30.44
    age = F.datediff(F.lit(as_of).cast("date"), "first_date") / 30.44
    joined = joined.withColumn("__l", lead * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half)).withColumn("__e", F.col(term).isin(*(emerging or [""])))
    if relevance is None:
        joined = joined.withColumn("__w", F.lit(None).cast("double"))
    else:
        known = relevance.select(entity).distinct().withColumn("__in", F.lit(True))
        joined = joined.join(relevance.select(entity, term, F.col("weight").alias("__w")), [entity, term], "left").join(known, entity, "left")
        joined = joined.withColumn("__w", F.when(F.col("__in"), F.coalesce("__w", F.lit(1.0)))).drop("__in")
    s = joined.groupBy(entity).agg(
        F.avg("__l").alias("lead_months"), F.count("*").alias("breadth"), F.sum(F.col("__e").cast("long")).alias("emerging"),
        F.count(F.when(F.col("__w") >= 1.5, 1)).alias("__near"), F.avg(F.col("__l") * F.col("__w")).alias("__sl"),
    )
    base = 0.3 * F.least(F.col("breadth") / 8, F.lit(1.0)) + 0.4 * F.least(F.col("emerging") / 4, F.lit(1.0)) + 0.3 * clip(F.col("lead_months") / 12, 0, 1)
    sector = F.when(F.col("__sl").isNotNull(), 0.5 * F.least(F.col("__near") / 4, F.lit(1.0)) + 0.5 * clip(F.col("__sl") / 12, 0, 1)).otherwise(0.0)
    return s.withColumn("score", F.when(sector > 0, 0.75 * base + 0.25 * sector).otherwise(base)).drop("__near", "__sl")


def labelled_value(text: str | Column, label: str, low: float | None = None, high: float | None = None, default: float | None = None) -> Column:
    """The number of the first line 'LABEL: number', inside [low, high]; the default if there is no such line or no number in it."""
    found = F.regexp_extract(text, rf"(?m)^\s*{label}:\s*([-+]?[0-9]*\.?[0-9]+)\s*$", 1)
    value = F.nullif(found, F.lit("")).try_cast("double")
    return F.coalesce(clip(value, low, high), F.lit(default).cast("double"))


def labelled_text(text: str | Column, label: str, default: str | None = None) -> Column:
    """The rest of the first line that starts with a label and a colon."""
    found = F.trim(F.regexp_extract(text, rf"(?m)^\s*{label}:(.*)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default).cast("string"))
