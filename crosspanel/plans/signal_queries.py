"""Queries for text measures, signals, state and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import series
from crosspanel.operators import signals as G
from crosspanel.operators import text as N
from crosspanel.plans import backtest as B
from crosspanel.plans.panel_queries import W, _M, _momentum
from crosspanel.plans.registry import PRICES, prices, query, rounded
from crosspanel.streaming import drawdown as D
from crosspanel.streaming import stateful as Z

#: Words that occur in the synthetic texts stand for the domain's word lists.
POS, NEG, UNC = ["the", "and"], ["is", "of"], ["it"]
_ARR = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_WORDS = "list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g'))"
#: Whole words as text.whole() sees them, and those of a list.
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_HIT_LIST = lambda ws: f"list_filter({_TOKENS}, lambda x: list_contains({_ARR(ws)}, x))"
_HIT = lambda ws, col="w": f"len(list_filter({col}, lambda x: list_contains({_ARR(ws)}, x)))"
TOPICS = {"alpha": ["the", "with"], "beta": ["and", "for"], "gamma": ["le", "der"]}


@query("n01_topic", "WITH s AS (SELECT doc_id, " + ", ".join(f"len(list_distinct(m{i})) + 0.5 * (len(m{i}) - len(list_distinct(m{i}))) AS s{i}" for i in range(3)) + " FROM (SELECT doc_id, " + ", ".join(f"{_HIT_LIST(k)} AS m{i}" for i, k in enumerate(TOPICS.values())) + " FROM documents)) SELECT doc_id, CASE WHEN greatest(s0, s1, s2) <= 0 THEN 'other' WHEN s0 >= s1 AND s0 >= s2 THEN 'alpha' WHEN s1 >= s2 THEN 'beta' ELSE 'gamma' END AS topic, CAST(greatest(s0, s1, s2) AS DOUBLE) AS topic_score FROM s")
def _(t):
    return N.with_topic(t("documents"), "text", TOPICS).select("doc_id", "topic", F.col("topic_score").cast("double").alias("topic_score"))


@query("n02_n03_lexicon_sentiment", f"WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, {_HIT(POS)} AS p, {_HIT(NEG)} AS n, {_HIT(UNC)} AS u, len(w) AS k FROM t), s AS (SELECT *, greatest(least((p - n) / sqrt(k), 1), -1) AS s FROM c) SELECT doc_id, round(s, 4) AS sentiment, round(least(u / sqrt(k), 1), 4) AS uncertainty, round(greatest(least(CASE WHEN s < 0 THEN s * 1.5 ELSE s * 0.5 END - 0.02, 1), -1), 4) AS adjusted, CASE WHEN s > 0.15 THEN 'bullish' WHEN s < -0.15 THEN 'bearish' ELSE 'neutral' END AS label FROM s")
def _(t):
    d = N.with_lexicon_sentiment(t("documents"), "text", POS, NEG, UNC)
    return rounded(d.select("doc_id", "sentiment", "uncertainty", N.adjusted_sentiment("sentiment", F.lit(1.5), F.lit(-0.02)).alias("adjusted"), N.sentiment_label("sentiment").alias("label")))


@query("n04_n05_topic_signal", "WITH w AS (SELECT doc_id, source, " + _WORDS + " AS w, " + ", ".join(f"{_HIT_LIST(k)} AS m{i}" for i, k in enumerate(TOPICS.values())) + f" FROM documents), s AS (SELECT source, CASE WHEN len(w) > 0 THEN greatest(least(({_HIT(POS)} - {_HIT(NEG)}) / sqrt(len(w)), 1), -1) ELSE 0 END AS x, " + ", ".join(f"len(list_distinct(m{i})) + 0.5 * (len(m{i}) - len(list_distinct(m{i}))) AS s{i}" for i in range(3)) + """ FROM w),
 b AS (SELECT *, CASE WHEN greatest(s0, s1, s2) <= 0 THEN 'other' WHEN s0 >= s1 AND s0 >= s2 THEN 'alpha' WHEN s1 >= s2 THEN 'beta' ELSE 'gamma' END AS best FROM s),
 r AS (SELECT source, best AS t, x, 1 AS own FROM b UNION ALL SELECT source, 'alpha', x * 0.5, 0 FROM b WHERE s0 >= 1 AND best <> 'alpha' UNION ALL SELECT source, 'beta', x * 0.5, 0 FROM b WHERE s1 >= 1 AND best <> 'beta' UNION ALL SELECT source, 'gamma', x * 0.5, 0 FROM b WHERE s2 >= 1 AND best <> 'gamma'),
 a AS (SELECT source, t, avg(x) AS x, count(*) AS n, sum(own) AS own FROM r GROUP BY 1, 2), v AS (SELECT *, sqrt(n) * CASE WHEN t = 'alpha' THEN 1.5 ELSE 1 END AS v FROM a),
 c AS (SELECT source, sum(v * x) / sum(v) AS signal, least(sum(own) / 10, 1) AS confidence, max_by(t, (n, t)) AS top_topic, bool_or(t = 'beta' AND n >= 2 AND x < -0.2) AS l, bool_or(t = 'gamma' AND x < -0.1) AS m, bool_or(t = 'alpha' AND abs(x) > 0.3) AS e FROM v GROUP BY 1)
 SELECT source, round(signal, 4) AS signal, round(confidence, 4)::DOUBLE AS confidence, top_topic, l AS litigation_alert, m AS management_alert, e AS earnings_alert, CASE WHEN signal > 0.1 THEN 'bullish' WHEN signal < -0.1 THEN 'bearish' ELSE 'neutral' END AS direction FROM c""")
def _(t):
    d = N.with_topic(N.with_lexicon_sentiment(t("documents"), "text", POS, NEG), "text", TOPICS)
    return rounded(N.topic_signal(d.withColumn("adjusted", F.col("sentiment")), ["source"], strong=("alpha",), litigation="beta", management="gamma", earnings="alpha"))


@query("n05_earnings_signal", f"""WITH w AS (SELECT source, lang, doc_id, {_WORDS} AS w, list_has_any({_TOKENS}, ['with', 'for', 'der', 'le']) AS about FROM documents),
 x AS (SELECT source, lang, about, CASE WHEN len(w) > 0 THEN greatest(least(({_HIT(POS)} - {_HIT(NEG)}) / sqrt(len(w)), 1), -1) ELSE 0 END AS x, CASE WHEN doc_id % 3 > 0 THEN doc_id % 11 / 10.0 - 0.5 END AS m FROM w),
 s AS (SELECT source, lang, count(*) AS articles, count(*) FILTER (about) AS n, round(coalesce(avg(x) FILTER (about), 0), 9) AS x, round(avg(m) FILTER (about), 9) AS m FROM x GROUP BY 1, 2),
 d AS (SELECT *, CASE WHEN x > 0.05 THEN 1 WHEN x < -0.05 THEN -1 ELSE 0 END AS a, CASE WHEN m > 0.05 THEN 1 WHEN m < -0.05 THEN -1 WHEN m IS NOT NULL THEN 0 END AS b, CASE WHEN n = 0 THEN NULL WHEN x > 0.2 THEN 'bullish' WHEN x < -0.2 THEN 'bearish' ELSE 'neutral' END AS direction FROM s),
 e AS (SELECT *, CASE WHEN n > 0 THEN a = b OR a = 0 OR b = 0 END AS agree, CASE WHEN n > 0 AND a = b AND a <> 0 THEN 1.4 ELSE 1 END AS boost FROM d)
 SELECT source, lang, articles, n AS on_topic, round(x, 4) AS sentiment, direction, agree, round(CAST(CASE WHEN n = 0 THEN 0 ELSE least(1, boost * (least(abs(x) / 0.5, 1) * 0.5 + least(n / 3, 1) * 0.3 + CASE WHEN agree THEN 0.2 ELSE 0 END)) END AS DOUBLE), 4) AS confidence,
  round(x * sqrt(n) * boost, 4) AS score, CAST(CASE WHEN n = 0 THEN NULL WHEN direction = 'bullish' THEN 0.0068 WHEN direction = 'bearish' THEN 0.0003 ELSE 0.0038 END AS DOUBLE) AS expected_return, coalesce(direction <> 'neutral', false) AS tradeable, abs(x) > 0.4 AND n >= 2 AS earnings_surprise FROM e""")
def _(t):
    d = N.with_lexicon_sentiment(t("documents"), "text", POS, NEG)
    about = F.arrays_overlap(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([\\p{L}\\p{N}_]+)"), 1), F.array(*map(F.lit, ("with", "for", "der", "le"))))
    d = d.withColumn("is_earnings", about).withColumn("model_score", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 11 / 10.0 - 0.5))
    out = N.earnings_signal(d, ["source", "lang"])
    return rounded(out.select("source", "lang", "articles", "on_topic", "sentiment", "direction", "agree", "confidence", "score", "expected_return", "tradeable", "earnings_surprise"))


@query("n07_filing_tone", f"WITH p AS (SELECT page_id, regexp_extract_all(lower(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g')), '([a-zA-Z]+)', 1) AS w FROM pages), c AS (SELECT page_id, len(w) AS k, {_HIT(POS)} AS p, {_HIT(NEG)} AS n FROM p) SELECT page_id, k AS tone_words, round(coalesce(p / nullif(k, 0), 0), 4) AS positive, round(coalesce(n / nullif(k, 0), 0), 4) AS negative, round(coalesce((p - n) / nullif(p + n, 0), 0), 4) AS net_tone FROM c")
def _(t):
    d = N.with_tone(t("pages"), "html", {"positive": POS, "negative": NEG})
    return rounded(d.select("page_id", F.col("tone_words").cast("long").alias("tone_words"), "positive", "negative", "net_tone"))


@query("n08_tone_change", f"{_M}, c AS (SELECT *, x - lag(x) {W} AS change FROM m) SELECT date, ticker, round(change, 4) AS change, CASE WHEN change >= 0.06 THEN 'much_better' WHEN change >= 0.03 THEN 'better' WHEN change <= -0.06 THEN 'much_worse' WHEN change <= -0.03 THEN 'worse' WHEN change IS NOT NULL THEN 'same' END AS label, round(change * greatest(0, 1 - (DATE '1999-01-01' - date) / 120.0), 4) AS faded FROM c")
def _(t):
    d = N.tone_change(_momentum(t), "x", as_of=F.lit("1999-01-01").cast("date"))
    return rounded(d.select("date", "ticker", "change", "label", "faded"))


@query("n09_s22_transcript_sections", """WITH l AS (SELECT conv_id, string_agg(role || ': ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1), x AS (SELECT conv_id, unnest(string_split(t, chr(10))) AS line FROM l) SELECT conv_id, count(*) AS sections, count(*) FILTER (line LIKE 'user:%') AS questions FROM x GROUP BY 1""")
def _(t):
    from crosspanel.sources.panels import flatten_parts

    c = t("conversations").withColumn("text", F.regexp_replace("text", "\n", " "))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), F.col("text").alias("content")))), lambda x: x)
    calls = c.groupBy("conv_id").agg(flatten_parts(parts).alias("t"))
    return N.parse_transcript(calls, ["conv_id"], "t").groupBy("conv_id").agg(F.count("*").alias("sections"), F.count(F.when(F.col("speaker") == "user", 1)).alias("questions"))


@query("n10_hedging_guidance", f"WITH t AS (SELECT doc_id, lower(text) AS l, {_WORDS} AS w FROM documents) SELECT doc_id, round(({_HIT(UNC)} + len(regexp_extract_all(l, 'is of'))) / nullif(len(w), 0), 4) AS hedging, round(coalesce((len(regexp_extract_all(l, '[0-9]+')) - len(regexp_extract_all(l, 'that'))) / nullif(len(regexp_extract_all(l, '[0-9]+')) + len(regexp_extract_all(l, 'that')), 0), 0), 4) AS guidance FROM t")
def _(t):
    d = t("documents")
    return rounded(d.select("doc_id", N.hedging("text", UNC, ["is of"]).alias("hedging"), N.guidance("text", ["[0-9]+"], ["that"]).alias("guidance")))


@query("n11_composite_half_life", "SELECT p_partkey, round((CASE WHEN p_size > 10 THEN 0.6 * p_size / 50.0 ELSE 0 END + 0.4 * p_retailprice / 2000) / (CASE WHEN p_size > 10 THEN 1.0 ELSE 0.4 END), 6) AS composite, round(pow(0.5, greatest(p_size - 14.0, 0) / 45), 6) AS fade FROM part")
def _(t):
    p = t("part").withColumn("a", F.when(F.col("p_size") > 10, F.col("p_size") / 50)).withColumn("b", F.col("p_retailprice") / 2000)
    return rounded(p.select("p_partkey", N.weighted_composite({"a": 0.6, "b": 0.4}).alias("composite"), N.half_life("p_size").alias("fade")), digits=6)


TERMS = {k: k for k in ("with", "this", "there", "was")}
_TOKEN_ROWS = "k AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')) AS k, text FROM documents)"
_MENT = "m AS (SELECT source, doc_id, k AS term FROM (SELECT source, doc_id, unnest(" + _TOKENS + f") AS k FROM documents) WHERE k IN ({', '.join(repr(k) for k in TERMS)}))"


def _mentions(t):
    return N.mentions(t("documents"), ["source", "doc_id"], "text", TERMS).select("source", "doc_id", "term")


@query("n13_mentions", """WITH k AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS ks FROM documents),
 u AS (SELECT doc_id, text, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS i FROM k), p AS (SELECT *, sum(length(k)) OVER (PARTITION BY doc_id ORDER BY i) - length(k) AS before FROM u)
 SELECT doc_id, lower(k) AS term, substr(text, CAST(greatest(before - 50, 0) + 1 AS BIGINT), CAST(least(before, 50) + length(k) + 50 AS BIGINT)) AS context FROM p WHERE lower(k) IN ('with', 'this')""")
def _(t):
    return N.mentions(t("documents"), ["doc_id"], "text", {"with": "with", "this": "this"})


@query("n14_mention_profile", f"WITH {_MENT}, c AS (SELECT source, term, count(*) AS n FROM m GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS k FROM c) SELECT source, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS terms, round(sum(n) FILTER (term = 'with') / sum(n), 4) AS emerging_ratio, round(sum(n) FILTER (term = 'was') / sum(n), 4) AS moat_ratio, string_agg(term, ',' ORDER BY k) AS top_terms FROM k GROUP BY 1")
def _(t):
    return rounded(N.mention_profile(_mentions(t), ["source"], ["with"], ["was"]))


@query("n16_n17_first_mentions_timeline", f"WITH {_MENT}, f AS (SELECT source, term, min(doc_id) AS first_date FROM m GROUP BY 1, 2) SELECT term, min(first_date) AS earliest, min_by(source, (first_date, source)) AS first_adopter, count(*) AS adopters, list_sort(list(first_date))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_date FROM f GROUP BY 1")
def _(t):
    return N.timeline(N.first_mentions(_mentions(t), "source", "term", "doc_id"), "source", "term")


_LEADS = f"""{_MENT}, f AS (SELECT source, term, min(DATE '2020-01-01' + CAST(doc_id AS INTEGER)) AS d FROM m GROUP BY 1, 2),
 t AS (SELECT term, list_sort(list(d))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS md FROM f GROUP BY 1),
 j AS (SELECT source, term, (md - d) / 30.44 * pow(0.5, greatest((DATE '2023-01-01' - d) / 30.44, 0) / 24) AS l FROM f JOIN t USING (term))"""


@query("n18_pioneer_score", f"""WITH {_LEADS}, w AS (SELECT *, CASE WHEN source LIKE '%1%' THEN CASE WHEN term = 'with' THEN 2.0 ELSE 1.0 END END AS w FROM j),
 s AS (SELECT source, avg(l) AS l, count(*) AS b, count(*) FILTER (term = 'with') AS e, count(*) FILTER (w >= 1.5) AS near, avg(l * w) AS sl FROM w GROUP BY 1),
 q AS (SELECT *, 0.3 * least(b / 8, 1) + 0.4 * least(e / 4, 1) + 0.3 * greatest(least(l / 12, 1), 0) AS base, CASE WHEN sl IS NULL THEN 0 ELSE 0.5 * least(near / 4, 1) + 0.5 * greatest(least(sl / 12, 1), 0) END AS sector FROM s)
 SELECT source, round(l, 4) AS lead_months, b AS breadth, e AS emerging, round(CASE WHEN sector > 0 THEN 0.75 * base + 0.25 * sector ELSE base END, 4) AS score FROM q""")
def _(t):
    m = _mentions(t).withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")))
    f = N.first_mentions(m, "source", "term", "day")
    relevance = f.select("source").distinct().filter(F.contains("source", F.lit("1"))).withColumn("term", F.lit("with")).withColumn("weight", F.lit(2.0))
    return rounded(N.pioneer_score(f, N.timeline(f, "source", "term"), "source", "term", "2023-01-01", ["with"], relevance=relevance))


@query("n15_period_change", "WITH q AS (SELECT o_custkey AS k, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, count(*) AS n, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY 1, 2), c AS (SELECT *, (n - lag(n) OVER w) / nullif(lag(n) OVER w, 0) AS change, lag(p) OVER w AS o FROM q WINDOW w AS (PARTITION BY k ORDER BY y)) SELECT k, y, round(change, 4) AS change, CASE WHEN change > 0.2 THEN 'accelerating' WHEN change < -0.2 THEN 'declining' WHEN change IS NOT NULL THEN 'stable' END AS trajectory, len(list_filter(p, lambda x: NOT list_contains(o, x))) AS n_added FROM c WHERE o IS NOT NULL")
def _(t):
    q = t("orders").groupBy(F.col("o_custkey").alias("k"), F.date_trunc("year", "o_orderdate").cast("date").alias("y")).agg(F.count("*").alias("n"), F.collect_set("o_orderpriority").alias("p"))
    d = N.period_change(q, "n", "p", "k", "y").filter("added is not null")
    return rounded(d.select("k", "y", "change", "trajectory", F.size("added").cast("long").alias("n_added")))


@query("n19_surprise_signal", """WITH s AS (SELECT l_orderkey, l_linenumber, DATE '1996-02-20' - CAST(l_shipdate AS DATE) AS days, (CAST(l_tax AS DECIMAL(10, 2)) - CAST(l_discount AS DECIMAL(10, 2))) * 5 AS s, l_tax > l_discount AS beat,
  CASE WHEN l_linenumber > 1 THEN l_linenumber % 2 = 0 END AS prior, CASE WHEN l_returnflag <> 'N' THEN (CAST(l_quantity AS DECIMAL(10, 3)) - 25) / 500 END AS r FROM lineitem),
 a AS (SELECT *, abs(s) > 0.2 AS big, abs(s) >= 0.05 AS small, r IS NOT NULL AND (r > 0) = beat AS same, CASE WHEN days <= 10 THEN 'fresh' WHEN days <= 30 THEN 'recent' WHEN days <= 60 THEN 'stale' ELSE 'expired' END AS freshness FROM s),
 b AS (SELECT *, CASE WHEN big THEN CASE WHEN r IS NULL THEN CASE WHEN prior IS NOT DISTINCT FROM beat THEN 'strong' ELSE 'moderate' END WHEN same THEN 'strong' ELSE 'moderate' END
   WHEN small AND same AND abs(r) >= 0.05 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN big AND r IS NULL THEN 0.0302 WHEN big AND same THEN 0.0302 * 1.4 WHEN big THEN 0.0302 * 0.7 WHEN small THEN 0.0184 ELSE 0 END * CASE WHEN beat THEN 1 ELSE -1 END AS e FROM a)
 SELECT l_orderkey, l_linenumber, days, freshness, CASE WHEN small THEN CASE WHEN beat THEN 'long' ELSE 'short' END ELSE 'neutral' END AS direction, strength, round(CAST(e AS DOUBLE), 6) AS expected_return,
  CASE WHEN freshness IN ('fresh', 'recent') AND (strength <> 'weak' OR small) THEN 40 WHEN freshness = 'stale' AND strength <> 'weak' THEN 20 END AS hold_days,
  round(CAST(CASE WHEN r IS NULL THEN s ELSE 0.7 * s + 0.3 * r END AS DOUBLE), 6) AS composite_surprise FROM b""")
def _(t):
    # Decimals, so that surprises that equal a threshold do so in any engine.
    surprise = (F.col("l_tax").cast("decimal(10,2)") - F.col("l_discount").cast("decimal(10,2)")) * 5
    revenue = F.when(F.col("l_returnflag") != "N", (F.col("l_quantity").cast("decimal(10,3)") - 25) / 500)
    s = t("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("announcement_date"), surprise.alias("surprise"), (F.col("l_tax") > F.col("l_discount")).alias("beat"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") % 2 == 0).alias("prior_beat"), revenue.alias("revenue_surprise"),
    )
    out = G.surprise_signal(s, "1996-02-20").withColumn("composite_surprise", F.col("composite_surprise").cast("double"))
    return rounded(out.select("l_orderkey", "l_linenumber", F.col("days").cast("long").alias("days"), "freshness", "direction", "strength", "expected_return", "hold_days", "composite_surprise"), digits=6)


_TR = "tr AS (SELECT event_type AS ticker, user_id AS who, CASE WHEN event_id % 2 = 0 THEN 'P' ELSE 'S' END AS side, CAST(ts AS DATE) AS d, CAST(value * 100 AS DECIMAL(18, 4)) AS v FROM events)"
_CL = f"{_TR}, cl AS (SELECT a.ticker, a.side, a.d AS start, count(DISTINCT b.who) AS insiders, sum(b.v) AS value, max(b.d) AS stop FROM (SELECT DISTINCT ticker, side, d FROM tr) a JOIN tr b ON a.ticker = b.ticker AND a.side = b.side AND b.d BETWEEN a.d AND a.d + 5 GROUP BY 1, 2, 3 HAVING count(DISTINCT b.who) >= 3)"
_SEP = f"""{_CL}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker, side ORDER BY insiders * value DESC, start DESC) AS k FROM cl),
 g AS (SELECT ticker, side, 0::BIGINT AS k, [] :: STRUCT(a DATE, b DATE)[] AS chosen, 0 AS taken FROM o GROUP BY ALL
  UNION ALL SELECT g.ticker, g.side, o.k, CASE WHEN len(list_filter(chosen, lambda y: y.a <= o.stop AND o.start <= y.b)) > 0 THEN chosen ELSE list_append(chosen, {{'a': o.start, 'b': o.stop}}) END, CASE WHEN len(list_filter(chosen, lambda y: y.a <= o.stop AND o.start <= y.b)) > 0 THEN 0 ELSE 1 END FROM g JOIN o ON o.ticker = g.ticker AND o.side = g.side AND o.k = g.k + 1),
 sep AS (SELECT o.* FROM g JOIN o USING (ticker, side, k) WHERE taken = 1)"""


def _trades(t):
    value = (F.col("value") * 100).cast("decimal(18,4)")  # sums of decimals don't depend on the order
    return t("events").select(F.col("event_type").alias("ticker"), F.col("user_id").alias("insider_name"), F.when(F.col("event_id") % 2 == 0, "P").otherwise("S").alias("transaction_type"), F.col("ts").cast("date").alias("transaction_date"), value.alias("total_value"))


@query("n20_insider_clusters", f"WITH {_CL} SELECT ticker, side AS transaction_type, start, insiders, CAST(value AS DOUBLE) AS value, stop AS \"end\" FROM cl")
def _(t):
    return G.insider_clusters(_trades(t), 5, 3).select("ticker", "transaction_type", "start", "insiders", F.col("value").cast("double").alias("value"), "end")


@query("n21_n22_separate_clusters", f"WITH RECURSIVE {_SEP} SELECT ticker, side AS transaction_type, start, stop AS \"end\", insiders, CAST(value AS DOUBLE) AS value FROM sep")
def _(t):
    return G.separate_clusters(G.insider_clusters(_trades(t), 5, 3)).drop("role_weight").withColumn("value", F.col("value").cast("double"))


@query("n22_monthly_clusters", f"""WITH {_TR}, r AS (SELECT a.ticker, a.d AS s, b.side, count(DISTINCT b.who) AS insiders, sum(b.v) AS value, min(b.d) AS start, max(b.d) AS stop FROM (SELECT DISTINCT ticker, d FROM tr) a
  JOIN tr b ON a.ticker = b.ticker AND b.d BETWEEN a.d AND a.d + 2 GROUP BY 1, 2, 3 HAVING count(DISTINCT b.who) >= 74),
 f AS (SELECT *, CAST(date_trunc('month', s) AS DATE) AS month, min(s) OVER (PARTITION BY ticker, date_trunc('month', s)) AS first FROM r)
 SELECT ticker, month, side AS transaction_type, start, stop AS "end", insiders, CAST(value AS DOUBLE) AS value FROM f WHERE s = first""")
def _(t):
    return G.monthly_clusters(_trades(t), 2, 74).withColumn("value", F.col("value").cast("double"))


@query("n23_insider_score", f"""WITH RECURSIVE {_SEP}, w AS (SELECT *, CASE WHEN who = 0 THEN 1.0 ELSE 0.3 END::DOUBLE AS w FROM tr),
 n AS (SELECT ticker, coalesce(sum(v::DOUBLE * w) FILTER (side = 'P'), 0) AS up, coalesce(sum(v::DOUBLE * w) FILTER (side <> 'P'), 0) AS down, sum(v)::DOUBLE AS v, count(*) AS n FROM w GROUP BY 1),
 r AS (SELECT sep.ticker, sep.side, sep.start, any_value(sep.insiders) AS insiders, avg(w.w) AS role FROM sep JOIN w ON w.ticker = sep.ticker AND w.side = sep.side AND w.d BETWEEN sep.start AND sep.start + 5 GROUP BY 1, 2, 3),
 c AS (SELECT ticker, sum((insiders - 2) * 0.15 * role * CASE WHEN side = 'P' THEN 1 ELSE -0.5 END) AS c FROM r GROUP BY 1)
 SELECT ticker, round(CAST(greatest(least(0.4 * CASE WHEN v > 0 THEN (up - down) / (up + down + 1) ELSE 0 END + 0.6 * coalesce(c, 0), 1), -1) AS DOUBLE), 4) AS insider_score,
  round(CAST(least(1, least(1, n / 10) * 0.5 + CASE WHEN c IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN v > 1000000 THEN 0.2 ELSE 0 END) AS DOUBLE), 4) AS confidence FROM n LEFT JOIN c USING (ticker)""")
def _(t):
    tr = _trades(t).withColumn("role_weight", F.when(F.col("insider_name") == 0, 1.0).otherwise(0.3))
    clusters = G.separate_clusters(G.insider_clusters(tr, 5, 3, role="role_weight"))
    return rounded(G.insider_score(tr.withColumn("total_value", F.col("total_value").cast("double")), clusters))


@query("n24_patent_score", """WITH s AS (SELECT o_custkey AS ticker, count(*) AS patents, max(a) AS first, count(*) FILTER (a < 365) AS recent, count(*) FILTER (a > 365 AND a < 730) AS before, avg(o_orderkey % 30) AS k,
  count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS e, count(DISTINCT o_orderpriority) AS areas FROM (SELECT *, DATE '2000-01-01' - CAST(o_orderdate AS DATE) AS a FROM orders) WHERE a >= 0 GROUP BY 1),
 p AS (SELECT *, patents / greatest(first / 365, 1) AS velocity FROM s), q AS (SELECT *, 25 * least(patents / 100, 1) + 25 * least(velocity / 20, 1) + 25 * least(k / 20, 1) + 25 * e / patents AS score FROM p)
 SELECT ticker, patents, recent, before, round(velocity, 4) AS velocity, round(score, 4) AS score, CASE WHEN recent > before * 1.2 THEN 'accelerating' WHEN recent < before * 0.8 THEN 'decelerating' ELSE 'stable' END AS trend,
  CASE WHEN score >= 75 THEN 'pioneer' WHEN score >= 50 THEN 'leader' WHEN score >= 25 THEN 'average' ELSE 'laggard' END AS rank, CAST(CASE WHEN score >= 75 THEN 0.8 WHEN score >= 50 THEN 0.5 WHEN score >= 25 THEN 0 ELSE -0.3 END AS DOUBLE) AS strength,
  round(least(areas * sqrt(patents / areas) / 20, 1), 4) AS moat FROM q""")
def _(t):
    p = t("orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_orderpriority").alias("area"), (F.col("o_orderkey") % 30).alias("claims_count"))
    return rounded(G.patent_score(p, "2000-01-01", ["1-URGENT", "2-HIGH"]))


@query("n25_sector_boost", """WITH s AS (SELECT p_type AS sector, avg(p_retailprice) AS strength FROM part GROUP BY 1), k AS (SELECT sector, row_number() OVER (ORDER BY strength DESC, sector) AS k, count(*) OVER () AS n FROM s)
 SELECT sector, CAST(k AS BIGINT) AS rank, round(CAST(CASE WHEN k <= 3 THEN 0.3 * (1 - (k - 1) / 3) WHEN k > n - 3 THEN -0.25 * (k - (n - 3)) / 3 ELSE 0 END AS DOUBLE), 6) AS boost FROM k""")
def _(t):
    s = t("part").groupBy(F.col("p_type").alias("sector")).agg(F.avg("p_retailprice").alias("strength"))
    return rounded(G.sector_boost(s).select("sector", "rank", "boost"), digits=6)


@query("n26_breadth_tilt", "WITH s AS (SELECT p_type AS sector, count(*) AS n, avg(p_retailprice / 1000 - 1.45) AS mean_score, avg(CASE WHEN p_retailprice / 1000 - 1.45 > 0.05 THEN 1.0 ELSE 0.0 END) AS breadth FROM part GROUP BY 1) SELECT sector, n, round(mean_score, 4) AS mean_score, round(breadth, 4) AS breadth, round(greatest(least(1 + 0.5 * tanh(coalesce((breadth - avg(breadth) OVER ()) / nullif(stddev_pop(breadth) OVER (), 0), 0) / 2), 1.2), 0.8), 4) AS tilt FROM s")
def _(t):
    return rounded(G.breadth_tilt(t("part").select(F.col("p_type").alias("sector"), (F.col("p_retailprice") / 1000 - 1.45).alias("score"))))


_IND = {f"i{i}": w for i, w in enumerate((0.25, 0.25, 0.15, 0.15, 0.20))}
_LIVE = lambda e: " + ".join(f"CASE WHEN abs(i{i}) > 0.001 THEN {e.format(c=f'i{i}', w=w)} ELSE 0 END" for i, w in enumerate(_IND.values()))


@query("n27_factor_regime", "WITH s AS (SELECT s_suppkey, " + ", ".join(f"(s_suppkey * {7 + 13 * i} + {i}) % 201 / 100.0::DOUBLE - 1 AS i{i}" for i in range(5)) + f""" FROM supplier), c AS (SELECT *, coalesce(({_LIVE('{c} * {w}::DOUBLE')}) / nullif({_LIVE('{w}::DOUBLE')}, 0), 0) AS c FROM s),
 a AS (SELECT *, ({_LIVE('CASE WHEN sign({c}) = sign(c) THEN 1 ELSE 0 END')}) / greatest({_LIVE('1')}, 1) AS agree FROM c)
 SELECT s_suppkey, round(c, 4) AS composite, CASE WHEN c >= 0.4 THEN 'risk_on' WHEN c >= 0.15 THEN 'mild_risk_on' WHEN c <= -0.4 THEN 'risk_off' WHEN c <= -0.15 THEN 'mild_risk_off' ELSE 'neutral' END AS regime, round(greatest(least(0.5 * least(abs(c) / 0.4, 1) + 0.5 * agree, 1), 0), 4) AS confidence FROM a""")
def _(t):
    s = t("supplier").select("s_suppkey", *[((F.col("s_suppkey") * (7 + 13 * i) + i) % 201 / 100.0 - 1).alias(c) for i, c in enumerate(_IND)])
    return rounded(G.factor_regime(s, _IND).select("s_suppkey", "composite", "regime", "confidence"))


@query("n28_tilted_ic", "SELECT p_partkey, round(CASE WHEN p_size = 1 THEN 0.05 ELSE 0.05 * (1 + (p_size / 25.0 - 1) * 0.5 * 0.8) END, 4) AS ic FROM part")
def _(t):
    p = t("part").withColumn("ic", F.lit(0.05)).withColumn("m", F.col("p_size") / 25)
    return rounded(p.select("p_partkey", G.tilted_ic("ic", "m", 0.5, F.lit(0.8), F.col("p_size") == 1).alias("ic")))


_SC = "sc AS (SELECT c_custkey AS ticker, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal / 10000 END AS a, c_custkey % 21 / 10.0 - 1 AS b, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey / 12.5 - 1 END AS c FROM customer)"


def _scored(t):
    c = t("customer")
    return c.select(F.col("c_custkey").alias("ticker"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal") / 10000).alias("a"), (F.col("c_custkey") % 21 / 10.0 - 1).alias("b"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey") / 12.5 - 1).alias("c"))


_COMP = f"""WITH {_SC}, co AS (SELECT *, (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT AS absent, coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2 - least(((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT) * 0.05, 0.2) AS composite,
 (coalesce(a > 0.1, false)::INT + coalesce(b > 0.1, false)::INT + coalesce(c > 0.1, false)::INT) AS p, (coalesce(a < -0.1, false)::INT + coalesce(b < -0.1, false)::INT + coalesce(c < -0.1, false)::INT) AS n FROM sc)"""


@query("n29_composite", f"{_COMP} SELECT ticker, round(composite, 4) AS composite, round(greatest(0, round(0.5 + 0.5 * coalesce(greatest(p, n) / nullif(p + n, 0), 0), 3) - least(absent * 0.1, 0.5)), 3)::DOUBLE AS confidence FROM co")
def _(t):
    return rounded(G.composite(_scored(t), {"a": 0.5, "b": 0.3, "c": 0.2}).select("ticker", "composite", "confidence"))


@query("n30_percentile_signal_all_columns", f"{_COMP}, k AS (SELECT *, (row_number() OVER (ORDER BY round(composite, 9) DESC, ticker) - 1) / count(*) OVER () AS k FROM co) SELECT ticker, round(composite, 9) AS composite, absent AS missing, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, CASE WHEN k < 0.1 AND composite > 0 THEN 'strong_buy' WHEN k < 0.25 AND composite > 0 THEN 'buy' WHEN k >= 0.9 AND composite < 0 THEN 'strong_sell' WHEN k >= 0.75 AND composite < 0 THEN 'sell' ELSE 'hold' END AS signal FROM k")
def _(t):
    c = G.composite(_scored(t), {"a": 0.5, "b": 0.3, "c": 0.2}).withColumn("composite", F.round("composite", 9)).drop("confidence")
    out = G.percentile_signals(c)
    return out.select("ticker", "composite", "missing", *[F.round(x, 4).alias(x) for x in "abc"], "signal")


@query("n30_percentile_signal", f"{_COMP}, k AS (SELECT *, (row_number() OVER (ORDER BY round(composite, 6) DESC, ticker) - 1) / count(*) OVER () AS k FROM co) SELECT ticker, CASE WHEN k < 0.1 AND composite > 0 THEN 'strong_buy' WHEN k < 0.25 AND composite > 0 THEN 'buy' WHEN k >= 0.9 AND composite < 0 THEN 'strong_sell' WHEN k >= 0.75 AND composite < 0 THEN 'sell' ELSE 'hold' END AS signal FROM k")
def _(t):
    c = G.composite(_scored(t), {"a": 0.5, "b": 0.3, "c": 0.2}).withColumn("composite", F.round("composite", 6))
    return G.percentile_signals(c).select("ticker", "signal")


@query("n31_n41_conflict_agreement", f"WITH {_SC}, l AS (SELECT *, list_filter([a, b, c], lambda x: abs(x) > 0.05) AS l FROM sc) SELECT ticker, len(l) >= 2 AND len(list_filter(l, lambda x: x > 0.2)) > 0 AND len(list_filter(l, lambda x: x < -0.2)) > 0 AS conflict, round(greatest(len(list_filter(l, lambda x: x > 0)), len(l) - len(list_filter(l, lambda x: x > 0))) / nullif(len(l), 0), 4) AS agreement FROM l")
def _(t):
    s = _scored(t)
    return rounded(s.select("ticker", F.coalesce(G.conflicting(["a", "b", "c"]), F.lit(False)).alias("conflict"), G.agreement(["a", "b", "c"]).alias("agreement")))


@query("n32_threshold_signal", f"WITH {_SC} SELECT ticker, CASE WHEN b >= 0.3 THEN 'strong_buy' WHEN b >= 0.1 THEN 'buy' WHEN b <= -0.3 THEN 'strong_sell' WHEN b <= -0.1 THEN 'sell' ELSE 'hold' END AS signal FROM (SELECT ticker, CAST(b AS DECIMAL(6, 2)) AS b FROM sc)")
def _(t):
    return _scored(t).withColumn("b", F.col("b").cast("decimal(6,2)")).select("ticker", G.threshold_signal("b").alias("signal"))


@query("n33_confidence_weighted", "SELECT c_mktsegment, round(sum((c_acctbal / 10000) * (c_custkey % 10 / 10.0)) / sum(c_custkey % 10 / 10.0), 4) AS aggregate, count(*) AS n, round(CASE WHEN sum(c_acctbal * (c_custkey % 10)) > 0 THEN avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) ELSE avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) END, 4) AS agreement FROM customer GROUP BY 1")
def _(t):
    c = t("customer").select("c_mktsegment", (F.col("c_acctbal") / 10000).alias("score"), (F.col("c_custkey") % 10 / 10.0).alias("confidence"))
    return rounded(G.confidence_weighted(c, ["c_mktsegment"]))


THEMES = [("metal", ["steel", "part"], ["STANDARD"], ["Brand#11"], [1, 2]), ("wood", ["oak"], ["PROMO"], ["Brand#12"], [3])]


@query("n34_moat_themes", "WITH th(theme, keywords, sectors, industries, pure) AS (VALUES " + ", ".join(f"('{n}', {_ARR(k)}, {_ARR(x)}, {_ARR(i)}, {p})" for n, k, x, i, p in THEMES) + """), e AS (SELECT p_partkey AS ticker, theme, greatest(CASE WHEN list_contains(pure, p_partkey) THEN 0.8 ELSE 0 END, least(0.1 * len(list_filter(keywords, lambda k: contains(lower(p_name), k))), 0.5), CASE WHEN list_contains(sectors, p_type) THEN 0.4 ELSE 0 END, CASE WHEN list_contains(industries, p_brand) THEN 0.5 ELSE 0 END) AS x FROM part, th)
 SELECT ticker, theme, round(CAST(x AS DOUBLE), 4) AS exposure FROM e WHERE x >= 0.3""")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("ticker"), F.col("p_name").alias("description"), F.col("p_type").alias("sector"), F.col("p_brand").alias("industry"))
    themes = p.sparkSession.createDataFrame(THEMES, "theme string, keywords array<string>, sectors array<string>, industries array<string>, pure array<long>")
    return rounded(G.theme_exposure(p, themes).select("ticker", "theme", "exposure"))


_INFO = """WITH i AS (SELECT p_partkey, p_size / 60 AS gross, CASE WHEN p_size % 7 > 0 THEN p_size / 150 END AS roe, p_retailprice * 4e8 AS cap, p_size / 180 AS profit, p_size / 200 - 0.05 AS growth, p_size / 140 AS operating, CAST(p_size * 5 - 10 AS DOUBLE) AS debt FROM part),
 m AS (SELECT *, greatest(0, least(1, CASE WHEN gross > 0.6 THEN 0.2 WHEN gross > 0.4 THEN 0.1 ELSE 0 END + CASE WHEN roe > 0.25 THEN 0.2 WHEN roe > 0.15 THEN 0.1 ELSE 0 END + CASE WHEN cap > 5e11 THEN 0.15 WHEN cap > 1e11 THEN 0.1 ELSE 0 END
  + CASE WHEN profit > 0.25 THEN 0.15 WHEN profit > 0.15 THEN 0.08 ELSE 0 END + CASE WHEN growth > 0.2 THEN 0.1 WHEN growth < 0 THEN -0.1 ELSE 0 END + CASE WHEN operating > 0.3 THEN 0.1 ELSE 0 END
  + CASE WHEN debt > 200 THEN -0.1 WHEN debt < 50 AND debt <> 0 THEN 0.1 ELSE 0 END)) AS moat FROM i)"""


@query("n34_forward_score", f"""{_INFO}, f AS (SELECT *, growth * 0.6 + (moat - 0.3) * 0.18 + least(0.4, gross * 0.3 * CASE WHEN p_partkey % 3 = 0 THEN 1.5 ELSE 1 END + roe_ * 0.3) AS f0 FROM (SELECT *, coalesce(roe, 0) AS roe_ FROM m))
 SELECT p_partkey, round(CAST(moat AS DOUBLE), 4) AS moat, CASE WHEN round(moat, 9) >= 0.6 THEN 'wide' WHEN round(moat, 9) >= 0.35 THEN 'narrow' ELSE 'none' END AS width, round(CAST(greatest(-1, least(1, f0)) AS DOUBLE), 4) AS score,
  CASE WHEN round(f0, 9) >= 0.3 THEN 'strong_tailwinds' WHEN round(f0, 9) >= 0.1 THEN 'tailwinds' WHEN round(f0, 9) > -0.1 THEN 'neutral' WHEN round(f0, 9) > -0.3 THEN 'headwinds' ELSE 'strong_headwinds' END AS outlook FROM f""")
def _(t):
    size = F.col("p_size")
    i = t("part").select(
        "p_partkey", (size / 60).alias("gross"), F.when(size % 7 > 0, size / 150).alias("roe"), (F.col("p_retailprice") * 4e8).alias("cap"), (size / 180).alias("profit"),
        (size / 200 - 0.05).alias("growth"), (size / 140).alias("operating"), (size * 5 - 10).cast("double").alias("debt"),
    )
    i = i.withColumn("moat", F.round(G.moat_score("gross", "roe", "cap", "profit", "growth", "operating", "debt"), 9))
    name = F.when(F.col("p_partkey") % 3 == 0, "cybersecurity").otherwise("other")
    themes = F.array(F.struct(name.alias("theme"), F.col("gross").alias("exposure")), F.struct(F.lit("x").alias("theme"), F.coalesce("roe", F.lit(0.0)).alias("exposure")))
    out = i.withColumn("score", F.round(G.forward_score("growth", "moat", themes), 9))
    return rounded(out.select("p_partkey", "moat", G.moat_width("moat").alias("width"), "score", G.outlook("score").alias("outlook")))


@query("n35_alpha_decay", "SELECT p_partkey, round(CASE WHEN p_size <= 5 THEN 1 WHEN p_size <= 20 THEN 1 - 0.5 * (p_size - 5) / 15.0 WHEN p_size <= 45 THEN 0.5 - 0.4 * (p_size - 20) / 25.0 ELSE 0.1 END, 4) AS alpha FROM part")
def _(t):
    return rounded(t("part").select("p_partkey", G.alpha_decay("p_size", [(5, 1.0), (20, 0.5), (45, 0.1)]).alias("alpha")))


@query("n37_penalties", """WITH s AS (SELECT c_custkey, c_acctbal / 1000 AS s, c_custkey % 40 / 10.0 - 3 AS r, CASE WHEN c_custkey % 9 > 0 THEN CAST(c_nationkey * 2 - 40 AS DECIMAL(6, 2)) / 100 END AS y, CAST(-c_nationkey * 25 AS DECIMAL(8, 2)) / 1000 AS d FROM customer)
 SELECT c_custkey, round(s - 0.5 * greatest(-1 - r, 0) - 0.2 * greatest(-1 - r, 0) * greatest(-1 - r, 0) + coalesce(least(0, (y * 100 + 30) / 10 * 0.5), 0) + least(0, (d * 100 + 40) / 10) * 0.5, 6) AS score FROM s""")
def _(t):
    year, fall = F.when(F.col("c_custkey") % 9 > 0, (F.col("c_nationkey") * 2 - 40).cast("decimal(6,2)") / 100), (-F.col("c_nationkey") * 25).cast("decimal(8,2)") / 1000
    c = t("customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("s"), (F.col("c_custkey") % 40 / 10.0 - 3).alias("r"), year.cast("double").alias("y"), fall.cast("double").alias("d"))
    return rounded(c.select("c_custkey", G.penalised("s", "r", "y", "d").alias("score")), digits=6)


@query("p07_regime_scaling", f"{_M} SELECT date, ticker, round(CASE WHEN x >= 0 THEN r ELSE r * 0.3 END, 4) AS r FROM m")
def _(t):
    return rounded(_momentum(t).select("date", "ticker", G.scaled_where("r", "x").alias("r")))


@query("p06_clip", f"{_M} SELECT date, ticker, round(CASE WHEN x IS NOT NULL THEN greatest(least(x, 1), -1) END, 4) AS x FROM m")
def _(t):
    from crosspanel.functions.columns import clip

    return rounded(_momentum(t).select("date", "ticker", clip("x", -1, 1).alias("x")))


@query("p09_hard_exclusion", f"WITH panel AS ({PRICES}), d AS (SELECT *, price / lag(price, 51) {W} - 1 AS y, price / max(price) OVER (PARTITION BY ticker ORDER BY date ROWS 51 PRECEDING) - 1 AS d FROM panel), w AS (SELECT *, min(d) OVER (PARTITION BY ticker ORDER BY date ROWS 51 PRECEDING) AS worst, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM d) SELECT ticker, date, round(y, 4) AS year_return, round(worst, 4) AS worst FROM w WHERE n = 1 AND (y <= -0.2 OR worst <= -0.6)")
def _(t):
    return rounded(G.excluded(prices(t), year=52, fall=-0.2, drawdown=-0.6).select("ticker", "date", "year_return", "worst"))


@query("p10_freshness", "SELECT c_custkey, round(0.8 * CASE WHEN c_custkey % 200 > 120 THEN 0.3 WHEN c_custkey % 200 > 60 THEN 0.6 ELSE 1 END * CASE WHEN c_nationkey < 5 THEN 0.7 ELSE 1 END, 4) AS after FROM customer")
def _(t):
    c = t("customer").withColumn("conf", F.lit(0.8)).withColumn("age", F.col("c_custkey") % 200)
    return rounded(c.select("c_custkey", G.freshness("conf", "age", "c_nationkey")["after"].alias("after")))


@query("p11_p12_flags_reasons", "SELECT s_suppkey, concat_ws('; ', CASE WHEN s_acctbal < 0 THEN 'negative' END, CASE WHEN s_nationkey > 12 THEN 'far' END) AS reasons FROM supplier")
def _(t):
    return t("supplier").select("s_suppkey", G.reasons({"negative": F.col("s_acctbal") < 0, "far": F.col("s_nationkey") > 12}).alias("reasons"))


@query("p13_regime_ranges", "SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01' THEN 'early' WHEN o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1999-01-01' THEN 'late' END AS regime FROM orders")
def _(t):
    o = t("orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", B.regime_of("d", [("1995-01-01", "1997-01-01", "early"), ("1997-01-01", "1999-01-01", "late")]).alias("regime"))


@query("p14_p15_review_selection", f"""WITH {_SC}, l AS (SELECT ticker, CAST(b AS DECIMAL(6, 2)) AS score, list_filter([a, b, c], lambda x: abs(x) > 0.05) AS l, [a, b, c] AS v FROM sc), q AS (SELECT ticker, score, coalesce(len(l) >= 2 AND len(list_filter(v, lambda x: x > 0.2)) > 0 AND len(list_filter(v, lambda x: x < -0.2)) > 0, false) AS conflict FROM l),
 sd AS (SELECT *, row_number() OVER (PARTITION BY score > 0 ORDER BY abs(score) DESC, ticker) AS side FROM q), kd AS (SELECT *, CASE WHEN side <= 5 AND score > 0 THEN 0 WHEN side <= 5 AND score < 0 THEN 1 WHEN conflict THEN 2 ELSE 3 END AS kind FROM sd),
 o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(score) DESC, ticker) AS o FROM kd) SELECT ticker, CAST(score AS DOUBLE) AS score, ['buy', 'sell', 'conflict', 'fill'][kind + 1] AS reason FROM o ORDER BY kind, o LIMIT 15""")
def _(t):
    s = _scored(t).withColumn("conflict", F.coalesce(G.conflicting(["a", "b", "c"]), F.lit(False))).withColumn("score", F.col("b").cast("decimal(6,2)"))
    return G.review_selection(s, 5).select("ticker", F.col("score").cast("double").alias("score"), "reason")


def _names(flags: dict[int, str]) -> str:
    """SQL of the joined names of the breakers whose flag is true."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {flag} THEN '{D.BREAKERS[i - 1].name}' END" for i, flag in flags.items()) + ")"


def _controller_sql(events: str) -> str:
    """The controller row by row over events(k, ts, value, reset), from a peak of 1,000: t1 to t6 say when each active breaker fired, f1 to
    f6 which fire at the row, e1 to e6 which cool-downs ended by it."""
    each = list(enumerate(D.BREAKERS, 1))
    end = {i: f"(s.t{i} + INTERVAL {b.hours} HOUR)" for i, b in each}
    peak = "CASE WHEN d.reset = 'all' THEN coalesce(s.value, s.peak) WHEN d.reset IS NULL THEN greatest(s.peak, d.value) ELSE s.peak END"
    value = "CASE WHEN d.reset IS NULL THEN d.value ELSE s.value END"
    drawdown = f"(({value}) - ({peak})) / ({peak})"
    fires = {i: f"coalesce(d.reset IS NULL AND {drawdown} <= -{b.limit} AND (s.t{i} IS NULL OR {end[i]} <= d.ts), false)" for i, b in each}
    times = ", ".join(
        f"CASE WHEN {fires[i]} THEN d.ts WHEN d.reset IN ('all', '{b.name}') THEN NULL " + (f"ELSE s.t{i} END" if b.latched else f"WHEN {end[i]} > d.ts THEN s.t{i} END") for i, b in each
    )
    freed = ", ".join("CAST(NULL AS TIMESTAMP)" if b.latched else f"CASE WHEN {end[i]} <= d.ts THEN {end[i]} END" for i, b in each)
    blank = ", ".join(f"CAST(NULL AS TIMESTAMP) AS {c}{i}" for c in "te" for i, _ in each) + ", " + ", ".join(f"false AS f{i}" for i, _ in each)
    exposure = "least(1.0, " + ", ".join(f"CASE WHEN t{i} IS NOT NULL THEN {b.exposure} END" for i, b in each if b.exposure is not None) + ")"
    action = "CASE " + " ".join(f"WHEN f{i} THEN '{b.action}'" for i, b in reversed(each)) + " ELSE 'none' END"
    halted = " OR ".join(f"t{i} IS NOT NULL" for i, b in each if b.action in D.HALTS)
    active, fired = _names({i: f"t{i} IS NOT NULL" for i, _ in each}), _names({i: f"f{i}" for i, _ in each})
    released = " UNION ALL ".join(f"SELECT k, e{i}, 'release', '{b.name}', NULL, NULL, NULL, NULL, NULL, NULL FROM s WHERE e{i} IS NOT NULL" for i, b in each)
    return f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, reset IS NOT NULL, value, reset) AS i FROM ({events})),
        s AS (SELECT DISTINCT k, 0 AS i, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS reset, CAST(NULL AS DOUBLE) AS value, CAST(1000 AS DOUBLE) AS peak, {blank} FROM d
          UNION ALL SELECT d.k, d.i, d.ts, d.reset, {value}, {peak}, {times}, {freed}, {', '.join(fires.values())} FROM s JOIN d ON d.k = s.k AND d.i = s.i + 1)
        SELECT k AS user_id, ts, CASE WHEN reset IS NULL THEN 'value' ELSE 'reset' END AS event, reset AS breaker, round((value - peak) / peak, 6) AS drawdown,
          {fired} AS fired, {active} AS active, {action} AS action, CAST({exposure} AS DOUBLE) AS exposure, ({halted}) AS halted FROM s WHERE i > 0 UNION ALL {released}"""


_BOOKS = """SELECT user_id AS k, ts, CASE WHEN event_type <> 'signup' THEN CAST(1000 + sum(CAST(value - 50 AS DECIMAL(12, 2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) END AS value,
 CASE WHEN event_type = 'signup' THEN CASE WHEN value < 20 THEN 'all' ELSE 'drawdown_20pct' END END AS reset FROM events"""


def _books(t) -> DataFrame:
    """A portfolio per user from 1,000, moved by its events; sign-ups are manual resets, of all breakers or of the latched one."""
    moved = F.sum((F.col("value") - 50).cast("decimal(12,2)")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    reset = F.when(F.col("event_type") == "signup", F.when(F.col("value") < 20, "all").otherwise("drawdown_20pct"))
    return t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (moved + 1000).cast("double").alias("worth"), reset.alias("reset"))


@query("z01_drawdown_controller", _controller_sql(_BOOKS))
def _(t):
    out = D.controlled(_books(t), ["user_id"], "ts", "worth", "reset", initial=1000.0)
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event", "breaker", F.round("drawdown", 6).alias("drawdown"), "fired", "active", "action", "exposure", "halted")


@query("z01_breaker_events", f"SELECT user_id, ts, unnest(string_split(fired, ',')) AS breaker FROM ({_controller_sql(_BOOKS)}) WHERE fired <> ''")
def _(t):
    out = D.controlled(_books(t), ["user_id"], "ts", "worth", "reset", initial=1000.0).filter("fired <> ''")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.explode(F.split("fired", ",")).alias("breaker"))


_STATES = "CASE " + " ".join(f"WHEN d <= -{b.limit} THEN '{b.name}'" for b in reversed(D.BREAKERS)) + " ELSE 'none' END"


@query("z01_drawdown_states", f"""WITH panel AS ({PRICES}), d AS (SELECT *, price / max(price) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM panel)
 SELECT ticker, date, round(d, 4) AS drawdown, {_STATES} AS breaker FROM d""")
def _(t):
    return rounded(D.drawdown_states(prices(t), ["ticker"], "date", "price").select("ticker", "date", "drawdown", "breaker"))


@query("z02_position_factor", """SELECT c_custkey, CASE WHEN d < -0.2 THEN 0.5 WHEN d < -0.1 THEN 0.75 ELSE 1 END::DOUBLE * CASE WHEN n >= 20 AND v > 0.5 THEN 0.5 WHEN n >= 20 AND v > 0.35 THEN 0.75 ELSE 1 END::DOUBLE AS factor,
 CASE WHEN n >= 5 AND v > 0 THEN greatest(0.25, least(2, 0.15 / v::DOUBLE)) ELSE 1 END::DOUBLE AS scale
 FROM (SELECT c_custkey, CAST(-(c_custkey % 30) AS DECIMAL(6, 2)) / 100 AS d, CAST(c_nationkey AS DECIMAL(6, 2)) / 40 AS v, c_custkey % 41 AS n FROM customer)""")
def _(t):
    vol, n = F.col("c_nationkey").cast("decimal(6,2)") / 40, F.col("c_custkey") % 41
    factor = Z.position_factor((-(F.col("c_custkey") % 30)).cast("decimal(6,2)") / 100, vol, n)
    return t("customer").select("c_custkey", factor.alias("factor"), Z.volatility_scale(vol.cast("double"), n).alias("scale"))


@query("z03_latest_status", "SELECT user_id, max_by(event_type, event_id) AS status, round(max_by(value, event_id) - 50, 4) AS slippage FROM events GROUP BY 1")
def _(t):
    e = t("events").select("user_id", "event_id", F.col("event_type").alias("status"), F.col("value").alias("fill"), F.lit(50.0).alias("price"))
    return rounded(Z.latest_status(e, "user_id", "event_id", "status", "fill", "price"))


@query("z05_event_windows", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3")
def _(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = Z.event_windows(e, "ts", "1 hour", "1 hour", None, ["event_type"], "value")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 2).alias("total"))


@query("z06_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, s")
def _(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = Z.sessions(e, "ts", "1 hour", "6 hours", ["user_id"], "value")
    return d.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 2).alias("total"))


_RB = f"{_M}, d AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)), p AS (SELECT panel.* FROM panel SEMI JOIN d USING (date)), h AS (SELECT date, ticker, lead(price) OVER (PARTITION BY ticker ORDER BY date) / price - 1 AS h FROM p), k AS (SELECT m.date, ticker, row_number() OVER (PARTITION BY m.date ORDER BY x DESC, ticker) AS k FROM m SEMI JOIN d USING (date) WHERE x IS NOT NULL), w AS (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM k WHERE k <= 5)"


@query("v07_score_backtest", f"{_RB} SELECT w.date, round(sum(w * h), 4) AS portfolio_return FROM w JOIN h ON w.date = h.date AND w.ticker = h.ticker WHERE h IS NOT NULL GROUP BY 1")
def _(t):
    m = _momentum(t)
    return rounded(B.score_backtest(m, m.select("date", "ticker", "price"), B.rebalance_dates(m, "month"), "x", 5))


@query("v05_date_folds", f"WITH panel AS ({PRICES}), d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)) SELECT date, ticker, CAST(floor(k * 6 / n) AS BIGINT) AS fold FROM panel JOIN d USING (date)")
def _(t):
    return B.date_folds(prices(t), 5).select("date", "ticker", "fold")


@query("v08_blended_scores", f"{_M} SELECT date, ticker, round(0.6 * x + 0.4 * r, 4) AS score FROM m WHERE x IS NOT NULL")
def _(t):
    m = _momentum(t).filter("x is not null")
    w = m.select("date").distinct().withColumn("weight_a", F.lit(0.6)).withColumn("weight_b", F.lit(0.4))
    return rounded(B.blended(m.withColumn("score", F.col("x")), m.withColumn("score", F.col("r")), w))


@query("v14_shuffled_labels", f"{_M}, a AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY ticker) AS i FROM m), b AS (SELECT date, x, row_number() OVER (PARTITION BY date ORDER BY sha256('42|' || date || '|' || ticker), ticker) AS i FROM m) SELECT a.date, ticker, round(x, 4) AS x FROM a JOIN b ON a.date = b.date AND a.i = b.i")
def _(t):
    return rounded(B.shuffled_labels(_momentum(t).select("date", "ticker", "x"), "x"))


# MLlib's ridge in standard units: (C + l / sd(y) diag(var)) b = c with moments over n.
@query("v03_v07_walk_forward_ridge", f"""{_M}, f0 AS (SELECT date, ticker, x, r, lead(price, 4) {W} / price - 1 AS y FROM m), f AS (SELECT * FROM f0 WHERE x IS NOT NULL AND r IS NOT NULL), k AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM f)),
 dd AS (SELECT date, k FROM k JOIN (SELECT max(date) AS date FROM f GROUP BY date_trunc('year', date) ORDER BY 1 OFFSET 1) USING (date)),
 s AS (SELECT dd.date, avg(x) AS mx, avg(r) AS mr, avg(y) AS my, var_pop(x) AS vx, var_pop(r) AS vr, covar_pop(x, r) AS cxr, covar_pop(x, y) AS cx, covar_pop(r, y) AS cr, 0.001 / stddev_pop(y) AS l FROM dd JOIN k ON k.k <= dd.k - 4 JOIN f ON f.date = k.date WHERE y IS NOT NULL GROUP BY 1),
 b AS (SELECT *, (cx * vr * (1 + l) - cr * cxr) / (vx * vr * (1 + l) * (1 + l) - cxr * cxr) AS bx, (cr * vx * (1 + l) - cx * cxr) / (vx * vr * (1 + l) * (1 + l) - cxr * cxr) AS br FROM s)
 SELECT date, ticker, round(my + bx * (x - mx) + br * (r - mr), 4) AS score FROM b JOIN f USING (date)""")
def _(t):
    from crosspanel.operators.labels import forward_return

    m = _momentum(t).withColumn("y", forward_return(4)).select("date", "ticker", "x", "r", "y").dropna(subset=["x", "r"])
    dates = [r["date"] for r in B.rebalance_dates(m, "year").orderBy("date").collect()][1:]
    return rounded(B.walk_forward(m, dates, B.linear_scores(["x", "r"], "y"), 4).select("date", "ticker", "score"))


@query("a26_sub_periods", f"""{_RB}, p0 AS (SELECT w.date, sum(w * h) AS r FROM w JOIN h ON w.date = h.date AND w.ticker = h.ticker WHERE h IS NOT NULL GROUP BY 1), q AS (SELECT * FROM p0 JOIN (VALUES ('first', DATE '1995-01-01', DATE '1998-12-31'), ('second', DATE '1999-01-01', DATE '2002-12-31')) v(name, a, b) ON date BETWEEN a AND b),
 nv AS (SELECT name, date, product(1 + r) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM q), dr AS (SELECT name, min(d) AS max_drawdown FROM (SELECT name, nav / max(nav) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM nv) GROUP BY 1),
 g AS (SELECT name, count(r) AS n, pow(product(1 + r), 12.0 / count(r)) - 1 AS ar, stddev_samp(r) * sqrt(12) AS av FROM q GROUP BY 1)
 SELECT name, n, CASE WHEN n >= 6 THEN round(ar, 4) END AS annual_return, CASE WHEN n >= 6 THEN round(av, 4) END AS annual_volatility, CASE WHEN n >= 6 THEN round(ar / av, 4) END AS sharpe, CASE WHEN n >= 6 THEN round(max_drawdown, 4) END AS max_drawdown FROM g JOIN dr USING (name)""")
def _(t):
    m = _momentum(t)
    r = B.score_backtest(m, m.select("date", "ticker", "price"), B.rebalance_dates(m, "month"), "x", 5)
    periods = m.sparkSession.createDataFrame([("first", "1995-01-01", "1998-12-31"), ("second", "1999-01-01", "2002-12-31")], "name string, start string, end string")
    return rounded(B.sub_periods(r, periods.select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end")), "portfolio_return"))
