"""Readers and writers, and preparation of panels as they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosspanel.functions.columns import draw, series


def read_csv(spark: SparkSession, path: str, schema: str | StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a stated schema; columns that the files lack are NULL.

    The head of one file is read for the names; a file whose header differs from it raises an error when it is read, and is not read by
    position.
    """
    head = spark.read.option("header", True).csv(path).columns
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    own = StructType([next((f for f in schema if f.name == n), None) or StructType.fromDDL(f"`{n}` string")[0] for n in head])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(own).csv(path)
    return df.select(*[F.col(f.name) if f.name in head else F.lit(None).cast(f.dataType).alias(f.name) for f in schema if columns is None or f.name in columns])


def within(df: DataFrame, entities: list[str] | None, start: str, end: str, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Rows of the entities from start to end, both included; both conditions reach the scan."""
    df = df.filter(F.col(time).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df.filter(F.col(entity).isin(entities)) if entities is not None else df


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of a digest of the key: random, but the same each time."""
    return df.orderBy(draw(key), key).limit(n)


def insert_ignore(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is unknown, one for each key."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*new.columns))).filter("__n = 1").drop("__n")
    return first.join(existing.select(key), key, "left_anti").select(*new.columns)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, or CSV with a header, a folder for each value of ``by``."""
    writer = df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def date_in_name(name: str | Column) -> Column:
    """Time stamp in a name such as ranking_20260203_0856.json, or the date alone at midnight; NULL without one or if there is no such
    day."""
    both = F.regexp_extract(name, r"([0-9]{8})_([0-9]{4})", 0)
    day = F.regexp_extract(name, r"[0-9]{8}", 0)
    exact = F.try_to_timestamp(F.nullif(both, F.lit("")), F.lit("yyyyMMdd_HHmm"))
    return F.when(both != "", exact).otherwise(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyyMMdd")))


def next_trading_day(at: str | Column, close: int = 16) -> Column:
    """The date of a time stamp, or the next one from the closing hour on; weekends go to Monday."""
    at = F.col(at) if isinstance(at, str) else at
    day = F.date_add(at.cast("date"), F.when(F.hour(at) >= close, 1).otherwise(0))
    return F.date_add(day, F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0))


def write_daily_json(df: DataFrame, path: str, time: str) -> None:
    df.withColumn("dt", F.col(time).cast("date")).write.mode("append").partitionBy("dt").json(path)


def null_share(df: DataFrame, value: str, entity: str = "ticker", time: str = "date") -> DataFrame:
    """(entity, share of the panel's dates without a value)."""
    n = df.select(time).distinct().agg(F.count("*").alias("__n"))
    return df.groupBy(entity).agg(F.count(value).alias("__k")).crossJoin(F.broadcast(n)).select(entity, (1 - F.col("__k") / F.col("__n")).alias("missing"))


def covered(df: DataFrame, value: str, least: float, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Rows of the entities that have values on at least that share of the dates."""
    return df.join(null_share(df, value, entity, time).filter(1 - F.col("missing") >= least - 1e-12), entity, "left_semi")


def filled(value: str, limit: int | None = None, w=None) -> Column:
    """Last value carried forward, over at most ``limit`` rows."""
    w = w or series()
    upto = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return F.last(value, ignorenulls=True).over(upto)


def full_dates(df: DataFrame, value: str, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Carries values forward, then keeps the dates on which every entity has one."""
    df = df.withColumn(value, filled(value, None, series(entity, time)))
    n = df.select(entity).distinct().agg(F.count("*").alias("__n"))
    dates = df.groupBy(time).agg(F.count(value).alias("__k")).crossJoin(F.broadcast(n)).filter("__k = __n").select(time)
    return df.join(dates, time, "left_semi")


def month_ends(spark: SparkSession, start: str, end: str, name: str = "date") -> DataFrame:
    months = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("__m")).select(F.last_day("__m").alias(name))


def placeholder(dates: DataFrame, entities: DataFrame, columns: list[str]) -> DataFrame:
    """Every date and entity with NULL values."""
    return entities.crossJoin(F.broadcast(dates)).select("*", *[F.lit(None).cast("double").alias(c) for c in columns])


def flatten_parts(parts: str | Column, who: str = "speaker", what: str = "content") -> Column:
    """'speaker: content' lines of an array of structs."""
    return F.array_join(F.transform(parts, lambda p: F.concat(p[who], F.lit(": "), p[what])), "\n")


def parallel_rows(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Arrays of equal length as rows."""
    return df.select(*keys, F.inline(F.arrays_zip(*arrays)))


def html_text(html: str | Column) -> Column:
    """Text without scripts, styles, tags, entities and double spaces."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"&[a-zA-Z#0-9]+;", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def html_cells(html: str | Column, tag: str = "li") -> Column:
    """Inner texts of a tag, without nested tags."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))


def number_after(text: str | Column, label: str) -> Column:
    """The number behind a label; NULL if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, rf"{label}\s+([-\d.]+)", 1), F.lit("")), F.lit("S999999999D999999")).cast("double")


def sectioned_xml(xml: str | Column, path: str) -> Column:
    """Strings at an XPath."""
    return F.xpath(xml, F.lit(path))


#: The parts of an ownership document that are read.
_NOTE = "footnoteId: array<struct<_id: string>>"
_VALUE = f"struct<value: string, {_NOTE}>"
_TRADE = (
    f"array<struct<transactionDate: {_VALUE}, transactionCoding: struct<transactionCode: string, {_NOTE}>, transactionAmounts: struct<transactionShares: {_VALUE}, "
    f"transactionPricePerShare: {_VALUE}, transactionAcquiredDisposedCode: {_VALUE}>, postTransactionAmounts: struct<sharesOwnedFollowingTransaction: {_VALUE}>>>"
)
OWNERSHIP = (
    "issuer struct<issuerTradingSymbol: string>, reportingOwner array<struct<reportingOwnerId: struct<rptOwnerName: string>, reportingOwnerRelationship: struct<isDirector: string, officerTitle: string>>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction: {_TRADE}>, derivativeTable struct<derivativeTransaction: {_TRADE}>, footnotes struct<footnote: array<struct<_VALUE: string, _id: string>>>, broken string"
)


def ownership_trades(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """The transactions of ownership documents (Form 4), one row each, and one row with ``error`` for each document that is no XML.

    (keys.., ticker, insider_name, insider_title, derivative, transaction_date, transaction_type, disposition, shares, price, total_value,
    owned_after, notes, planned, error).  Owner and title are those of the first reporting owner; one without a title who is marked as a
    director is a Director.  A transaction without a readable date is left out; its code defaults to P, its disposition to A, shares
    that are no number count 0; the value is NULL without a price other than 0.  notes are the texts of the footnotes that it refers to,
    and planned says whether one of them names Rule 10b5-1.  A NULL or empty document gives nothing; a document without tables neither.
    """
    parsed = F.from_xml(F.col(xml), F.lit(OWNERSHIP), {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"})
    docs = df.filter(F.trim(xml) != "").select(*keys, parsed.alias("d"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    owner = F.get("d.reportingOwner", F.lit(0))
    relation = owner["reportingOwnerRelationship"]
    title = F.coalesce(text(relation["officerTitle"]), F.when(F.trim(relation["isDirector"]) == "1", "Director"))

    def marked(path: str, derivative: bool) -> Column:
        return F.transform(F.col(path), lambda x: F.struct(F.lit(derivative).alias("derivative"), x.alias("t")))

    tables = [marked("d.nonDerivativeTable.nonDerivativeTransaction", False), marked("d.derivativeTable.derivativeTransaction", True)]
    both = F.concat(*[F.coalesce(t, F.expr(f"CAST(array() AS {_trades_type()})")) for t in tables])
    head = [*keys, text(F.col("d.issuer.issuerTradingSymbol")).alias("ticker"), text(owner["reportingOwnerId"]["rptOwnerName"]).alias("insider_name"), title.alias("insider_title")]
    rows = docs.filter("d.broken IS NULL").select(*head, F.col("d.footnotes.footnote").alias("__f"), F.explode(both).alias("__r")).select("*", "__r.derivative", "__r.t.*")
    number = lambda c: F.trim(c).try_cast("double")
    amounts = F.col("transactionAmounts")
    shares, price = F.coalesce(number(amounts["transactionShares"]["value"]), F.lit(0.0)), number(amounts["transactionPricePerShare"]["value"])
    places = [F.col("transactionDate"), F.col("transactionCoding"), amounts["transactionShares"], amounts["transactionPricePerShare"], F.col("postTransactionAmounts")["sharesOwnedFollowingTransaction"]]
    wanted = F.flatten(F.array(*[F.coalesce(p["footnoteId"]["_id"], F.array().cast("array<string>")) for p in places]))
    notes = F.transform(F.filter(F.coalesce("__f", F.expr("CAST(array() AS array<struct<_VALUE: string, _id: string>>)")), lambda n: F.array_contains(wanted, n["_id"])), lambda n: F.trim(n["_VALUE"]))
    out = rows.select(
        *keys, "ticker", "insider_name", "insider_title", "derivative", F.trim("transactionDate.value").try_cast("date").alias("transaction_date"),
        F.coalesce(text(F.col("transactionCoding.transactionCode")), F.lit("P")).alias("transaction_type"), F.coalesce(text(amounts["transactionAcquiredDisposedCode"]["value"]), F.lit("A")).alias("disposition"),
        shares.alias("shares"), price.alias("price"), F.when(price != 0, shares * price).alias("total_value"), number(F.col("postTransactionAmounts.sharesOwnedFollowingTransaction.value")).alias("owned_after"),
        notes.alias("notes"), F.exists(notes, lambda n: n.contains("10b5-1")).alias("planned"), F.lit(None).cast("string").alias("error"),
    ).filter("transaction_date IS NOT NULL")
    errors = docs.filter("d.broken IS NOT NULL").select(*keys, F.lit("not well-formed").alias("error"))
    return out.unionByName(errors, allowMissingColumns=True)


def _trades_type() -> str:
    return "array<struct<derivative: boolean, t: " + _TRADE[len("array<") : -1] + ">>"
