"""Market batch: landed cost, price signal, series joins, catalogue cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the cost model.
LB_TO_KG = 2.2046
CIF_RATE, LOGISTICS_PER_KG, IMPORTER_MARGIN, ROAST_LOSS = 0.08, 250.0, 0.15, 0.17


def landed_cost(price_lb: Column, fx: Column, points: Column, tariff: Column) -> dict[str, Column]:
    """FOB price, landed green cost and roasted cost of a kilogram: freight and insurance, tariff, logistics, margin, loss."""
    fob = price_lb + points / 10_000
    green = (fob * LB_TO_KG * fx * (1 + CIF_RATE) * (1 + tariff) + LOGISTICS_PER_KG) * (1 + IMPORTER_MARGIN)
    return {"fob": F.bround(fob, 4), "green": F.bround(green, 0), "roasted": F.bround(green / (1 - ROAST_LOSS), 0)}


def latest_values(series: DataFrame, back: tuple[int, ...] = (0, 1, 7)) -> DataFrame:
    """One row: the latest value and those so many rows earlier, the oldest where there are fewer. For a bounded daily series."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("date", "value")), asc=False), lambda x: x["value"])
    return series.agg(values.alias("v")).select(*[F.element_at("v", F.least(F.size("v"), F.lit(n + 1))).alias(f"v{n}") for n in back])


def price_signal(series: DataFrame) -> DataFrame:
    """One row: current, low, high, mean, place in the range, label (thirds) and trend over five steps of a daily series."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("date", "value")), asc=False), lambda x: x["value"])
    a = series.agg(values.alias("v"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count("*").alias("days"))
    current = F.element_at("v", 1)
    place = F.when(F.col("high") == F.col("low"), 0.5).otherwise((current - F.col("low")) / (F.col("high") - F.col("low")))
    step = current - F.get("v", F.lit(5))
    trend = F.when(F.col("days") < 6, "none").when(step > 0, "up").when(step < 0, "down").otherwise("flat")
    return a.where("days >= 2").select(
        F.round(current, 4).alias("current"),
        F.round("low", 4).alias("low"),
        F.round("high", 4).alias("high"),
        F.round("mean", 4).alias("mean"),
        F.round(place * 100, 1).alias("place"),
        F.when(place <= 0.33, "low").when(place >= 0.67, "high").otherwise("middle").alias("label"),
        trend.alias("trend"),
        "days",
    )


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over the table, 0.5 where constant; the extremes are one aggregated row."""
    ends = df.agg(*[x for c in columns for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
    joined = df.crossJoin(F.broadcast(ends))
    scaled = {c: F.when(F.col(f"__hi_{c}") == F.col(f"__lo_{c}"), 0.5).otherwise((F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def clean_catalogue(df: DataFrame, required: str, positive: list[str], fill: dict[str, str]) -> DataFrame:
    """Rows with an origin and positive scores; missing labels filled; scores scaled."""
    kept = df.where(F.col(required).isNotNull())
    for c in positive:
        kept = kept.where(F.col(c).isNotNull() & (F.col(c) > 0))
    return min_max(kept.fillna(fill), positive)


def running_change(series: DataFrame, key: list[str]) -> DataFrame:
    """(key, date, value, change): change against the row before in percent, one decimal, half to even."""
    before = F.lag("value").over(Window.partitionBy(*key).orderBy("date"))
    return series.withColumn("change", F.bround((F.col("value") - before) / before * 100, 1))
