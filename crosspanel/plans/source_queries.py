"""Queries for readers, preparation and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel.operators import joins as J
from crosspanel.plans.registry import PRICES, prices, query, rounded
from crosspanel.sources import panels as S
from crosspanel.sources import validation as V


@query("s02_s03_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-01-31' AND l_returnflag = 'R'")
def _(t):
    return t("lineitem").filter("l_shipdate between date'1996-01-01' and date'1996-01-31' and l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@query("s01_entity_range_filter", f"WITH panel AS ({PRICES}) SELECT date, ticker, round(price, 4) AS price FROM panel WHERE ticker IN ('Brand#1', 'Brand#2') AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def _(t):
    return rounded(S.within(prices(t), ["Brand#1", "Brand#2"], "1996-01-01", "1996-12-31").select("date", "ticker", "price"))


@query("s04_s05_sql_aggregates", "SELECT event_type, count(*) AS cnt, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS high, round(avg(value), 4) AS mean FROM events GROUP BY 1 ORDER BY cnt DESC LIMIT 10")
def _(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("cnt"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("high"), F.round(F.avg("value"), 4).alias("mean")).orderBy(F.desc("cnt")).limit(10)


@query("s06_hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def _(t):
    return S.sample(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("s07_s08_insert_ignore", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def _(t):
    return S.insert_ignore(t("customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey")), t("orders").select("o_custkey"), "o_custkey")


@query("s12_s14_history_coverage", f"WITH panel AS ({PRICES}), n AS (SELECT count(DISTINCT date) AS n FROM panel), c AS (SELECT ticker FROM panel GROUP BY 1 HAVING count(price) / (SELECT n FROM n) >= 0.998) SELECT ticker, count(*) AS n FROM panel WHERE ticker IN (SELECT ticker FROM c) GROUP BY 1")
def _(t):
    return S.covered(prices(t), "price", 0.998).groupBy("ticker").agg(F.count("*").alias("n"))


@query("s12_limited_fill", f"WITH panel AS ({PRICES}), g AS (SELECT date, ticker, CASE WHEN price > 30000 THEN price END AS p FROM panel) SELECT date, ticker, round(last_value(p IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS p FROM g")
def _(t):
    g = prices(t).withColumn("p", F.when(F.col("price") > 30000, F.col("price")))
    return rounded(g.select("date", "ticker", S.filled("p", 2).alias("p")), digits=6)


@query("s13_full_dates", f"WITH panel AS ({PRICES}), c AS (SELECT date FROM panel GROUP BY 1 HAVING count(price) = (SELECT count(DISTINCT ticker) FROM panel)) SELECT date, count(*) AS n FROM panel WHERE date IN (SELECT date FROM c) GROUP BY 1")
def _(t):
    return S.full_dates(prices(t), "price").groupBy("date").agg(F.count("*").alias("n"))


@query("s16_html_text", "WITH p AS (SELECT page_id, regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1) AS li FROM pages) SELECT page_id, len(li) AS n, trim(regexp_replace(li[1], '<[^>]+>', '', 'g')) AS first FROM p WHERE len(li) > 0")
def _(t):
    return t("pages").withColumn("li", S.html_cells("html")).filter("size(li) > 0").select("page_id", F.size("li").cast("long").alias("n"), F.element_at("li", 1).alias("first"))


@query("s17_parallel_arrays", "SELECT vec_id, i - 1 AS i, embedding[i] AS x FROM embeddings, range(1, 4) r(i)")
def _(t):
    e = t("embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("x"), F.expr("array(0L, 1L, 2L)").alias("i"))
    return S.parallel_rows(e, ["vec_id"], ["i", "x"])


@query("s20_union_with_fallback", "SELECT n_nationkey, n_name, 'a' AS src FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_nationkey, n_name, 'b' FROM nation WHERE n_regionkey >= 2 AND n_nationkey % 2 = 0")
def _(t):
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    a = n.filter("n_regionkey < 2").withColumn("src", F.lit("a"))
    b = n.filter("n_nationkey % 2 = 0").withColumn("src", F.lit("b"))
    return J.union_first(a, b, key="n_nationkey").select("n_nationkey", "n_name", "src")


@query("s09_json_fields", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM events WHERE len(json_keys(props)) > 0")
def _(t):
    e = t("events").withColumn("k", F.json_object_keys("props")).filter("size(k) > 0")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.element_at(m, F.element_at("k", 1)).alias("first"))


@query("s23_number_after_label", "SELECT p_partkey, CAST(regexp_extract('Sharpe Ratio: ' || p_size || '.5', 'Sharpe Ratio:\\s+([-\\d.]+)', 1) AS DOUBLE) AS v FROM part")
def _(t):
    return t("part").select("p_partkey", S.number_after(F.concat(F.lit("Sharpe Ratio: "), F.col("p_size").cast("string"), F.lit(".5")), "Sharpe Ratio:").alias("v"))


@query("v11_validation", "SELECT 'quantity positive' AS rule, CAST(sum(CASE WHEN l_quantity > 0 THEN 0 ELSE 1 END) AS BIGINT) AS violations FROM lineitem UNION ALL SELECT 'discount small', CAST(sum(CASE WHEN l_discount < 0.05 THEN 0 ELSE 1 END) AS BIGINT) FROM lineitem")
def _(t):
    return V.counts(t("lineitem"), {"quantity positive": "l_quantity > 0", "discount small": "l_discount < 0.05"})


@query("v11_missing_weekdays", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), s AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM d), (SELECT max(date) FROM d), INTERVAL 1 DAY)) AS DATE) AS date) SELECT date FROM s WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM d)")
def _(t):
    return V.missing_weekdays(t("orders").select(F.col("o_orderdate").cast("date").alias("date")))


@query("p01_p05_null_columns", f"WITH panel AS ({PRICES}) SELECT date, ticker, round(price, 6) AS price FROM panel WHERE price IS NOT NULL")
def _(t):
    df = prices(t).withColumn("empty", F.lit(None).cast("double"))
    from crosspanel.operators.fundamentals import available

    keep = available(df, ["price", "empty"])
    return rounded(df.select("date", "ticker", *sorted(keep)).dropna(subset=["price"]), digits=6)


@query("p03_p04_mask", "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS c_acctbal FROM customer")
def _(t):
    from crosspanel.operators.fundamentals import masked

    return masked(t("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_acctbal"], ["BUILDING"], "c_mktsegment").select("c_custkey", "c_acctbal")


@query("o_sorts_sets_strings", "SELECT n_name, upper(n_name) AS up, sha256(n_name) AS h, EXTRACT(quarter FROM DATE '2020-05-17' + n_nationkey)::INTEGER AS q FROM (SELECT n_name, n_nationkey FROM nation EXCEPT SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 0)")
def _(t):
    n = t("nation")
    rest = n.select("n_name", "n_nationkey").exceptAll(n.filter("n_regionkey = 0").select("n_name", "n_nationkey"))
    return rest.select("n_name", F.upper("n_name").alias("up"), F.sha2("n_name", 256).alias("h"), F.quarter(F.date_add(F.lit("2020-05-17").cast("date"), F.col("n_nationkey"))).alias("q"))


@query("s17_ownership_trades", """SELECT user_id, 'ACME' AS ticker, 'User ' || user_id AS insider_name, CASE WHEN user_id % 3 = 0 THEN 'Director' WHEN user_id % 3 = 1 THEN 'CEO' END AS insider_title, event_type = 'signup' AS derivative,
  CAST(ts AS DATE) AS transaction_date, CASE WHEN event_type = 'error' THEN 'S' ELSE 'P' END AS transaction_type, CASE WHEN event_type = 'error' THEN 'D' ELSE 'A' END AS disposition, event_id::DOUBLE AS shares,
  CASE WHEN event_type <> 'click' THEN CAST(value AS DECIMAL(12, 2))::DOUBLE END AS price, CASE WHEN event_type <> 'click' AND CAST(value AS DECIMAL(12, 2)) <> 0 THEN event_id * CAST(value AS DECIMAL(12, 2))::DOUBLE END AS total_value, event_type = 'view' AS planned, NULL AS error
  FROM events WHERE user_id % 50 <> 0
 UNION ALL SELECT DISTINCT user_id, NULL, NULL, NULL, NULL::BOOLEAN, NULL::DATE, NULL, NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN, 'not well-formed' FROM events WHERE user_id % 50 = 0""")
def _(t):
    """An ownership document per user, made from its events (sign-ups are derivative trades, views planned ones), some of them cut off."""
    from crosspanel.sources.panels import ownership_trades

    e = t("events")
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    value = lambda name, x, note="": F.concat(F.lit(f"<{name}><value>"), x, F.lit(f"</value>{note}</{name}>"))
    sale = F.col("event_type") == "error"
    coding = F.concat(F.lit("<transactionCoding>"), F.when(sale, "<transactionCode>S</transactionCode>").otherwise(""), F.when(F.col("event_type") == "view", '<footnoteId id="F1"/>').otherwise('<footnoteId id="F2"/>'), F.lit("</transactionCoding>"))
    price = F.when(F.col("event_type") != "click", value("transactionPricePerShare", F.col("value").cast("decimal(12,2)").cast("string"))).otherwise("")
    amounts = tag("transactionAmounts", F.concat(value("transactionShares", F.col("event_id").cast("string")), price, F.when(sale, value("transactionAcquiredDisposedCode", F.lit("D"))).otherwise("")))
    body = F.concat(value("transactionDate", F.date_format("ts", "yyyy-MM-dd")), coding, amounts)
    plain, derived = F.when(F.col("event_type") != "signup", tag("nonDerivativeTransaction", body)), F.when(F.col("event_type") == "signup", tag("derivativeTransaction", body))
    relation = F.when(F.col("user_id") % 3 == 0, "<isDirector>1</isDirector>").when(F.col("user_id") % 3 == 1, "<officerTitle> CEO </officerTitle>").otherwise("<isDirector>0</isDirector>")
    docs = e.groupBy("user_id").agg(F.array_join(F.collect_list(plain), "").alias("p"), F.array_join(F.collect_list(derived), "").alias("d"))
    xml = F.concat(
        F.lit("<ownershipDocument><issuer><issuerTradingSymbol>ACME</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>User "), F.col("user_id").cast("string"),
        F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship>"), relation, F.lit("</reportingOwnerRelationship></reportingOwner>"), tag("nonDerivativeTable", F.col("p")), tag("derivativeTable", F.col("d")),
        F.lit('<footnotes><footnote id="F1">Under a Rule 10b5-1 plan.</footnote><footnote id="F2">None.</footnote></footnotes></ownershipDocument>'),
    )
    docs = docs.withColumn("x", xml).select("user_id", F.when(F.col("user_id") % 50 == 0, F.expr("substring(x, 1, length(x) - 40)")).otherwise(F.col("x")).alias("x"))
    return ownership_trades(docs, ["user_id"], "x").drop("notes", "owned_after")
