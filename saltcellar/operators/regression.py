"""Least squares on daily panels: sums in Spark, one small system on the driver.

The data is never gathered. Spark adds up the products of the columns (a matrix of a few
dozen numbers), the driver solves that system, and where residuals are needed Spark passes
over the data again with the solution as constants.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltcellar.functions.columns import ratio
from saltcellar.functions.stats import normal_two_sided, student_critical, student_two_sided
from saltcellar.operators import engagement
from saltcellar.session import settle

# Least rows, labels, significance marks, evidence bounds, 95 % normal quantile.
MIN_DRIVER_ROWS, MIN_PANEL_ROWS = 20, 45
DRIVERS = (
    "order_count", "avg_order_value", "discount_rate", "dine_in_mix", "delivery_mix", "tip_rate", "is_weekend", "store_b",
)
DRIVER_LABELS = {
    "order_count": "Order Count", "avg_order_value": "Avg Order Value", "dine_in_mix": "Dine-In Mix",
    "delivery_mix": "Delivery Mix", "discount_rate": "Discount Rate", "tip_rate": "Tip Rate", "is_weekend": "Weekend",
    "store_b": "Store B (vs A)",
}
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
EVIDENCE = (("High", 0.35, 120), ("Moderate", 0.20, 75))
NORMAL_95 = 1.959963984540054

DRIVER_SCHEMA = (
    "feature string, label string, beta double, std_error double, lower double, upper double, pvalue double, "
    "stars string, strongest boolean, r_squared double, n_obs bigint"
)
PANEL_SCHEMA = (
    "predictor string, peak_lag int, beta double, std_error double, lower double, upper double, pvalue double, "
    "cumulative_pct double, r_squared double, n_obs bigint, n_locations bigint"
)
CURVE_SCHEMA = "predictor string, lag int, effect_pct double"


def driver_features(daily: DataFrame) -> DataFrame:
    """Mixes, rates and dummies per store-day, complete rows only.

    `store_b` marks the second location in name order; it is NULL when there is only one.
    """
    first_two = [r[0] for r in daily.select("location_id").distinct().filter("location_id IS NOT NULL").orderBy("location_id").limit(2).collect()]
    store_b = (F.col("location_id") == first_two[1]).cast("int") if len(first_two) == 2 else F.lit(None).cast("int")
    table = daily.select(
        "location_id",
        "business_date",
        F.col("order_count").cast("double").alias("order_count"),
        "avg_order_value",
        ratio(F.col("total_discounts"), F.col("gross_revenue")).alias("discount_rate"),
        ratio(F.col("dine_in_orders"), F.col("order_count")).alias("dine_in_mix"),
        ratio(F.col("delivery_orders"), F.col("order_count")).alias("delivery_mix"),
        ratio(F.col("total_tips"), F.col("gross_revenue")).alias("tip_rate"),
        (F.weekday("business_date") >= 5).cast("int").alias("is_weekend"),
        store_b.alias("store_b"),
        "net_revenue",
    )
    used = [c for c in DRIVERS if c != "store_b" or len(first_two) == 2]
    return table.dropna(subset=[*used, "net_revenue"])


def standardize(df: DataFrame, columns: Sequence[str], population: bool) -> DataFrame:
    """Columns as z-scores under `<name>_z`.

    With the population deviation a constant column is only centred; with the sample
    deviation it becomes zero.
    """
    spread = F.stddev_pop if population else F.stddev_samp
    facts = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[spread(c).alias(f"{c}_spread") for c in columns]
    ).first()

    def z(name: str) -> Column:
        mean, deviation = facts[f"{name}_mean"], facts[f"{name}_spread"]
        if not deviation:
            return F.col(name) - F.lit(mean) if population and mean is not None else F.lit(0.0)
        return (F.col(name) - F.lit(mean)) / F.lit(deviation)

    return df.withColumns({f"{c}_z": z(c) for c in columns})


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    inverse: np.ndarray
    residual_sum: float
    total_sum: float
    rows: int

    @property
    def r_squared(self) -> float | None:
        return 1.0 - self.residual_sum / self.total_sum if self.total_sum > 0 else None


def _products(df: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    """The symmetric matrix of column products, added up in one aggregate."""
    size = len(columns)
    factor = (lambda c: c) if weight is None else (lambda c: c * weight)
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    row = df.agg(*[F.sum(factor(columns[i] * columns[j])).alias(f"p{i}_{j}") for i, j in cells]).first()
    matrix = np.zeros((size, size))
    for i, j in cells:
        matrix[i, j] = matrix[j, i] = row[f"p{i}_{j}"] or 0.0
    return matrix


def least_squares(df: DataFrame, outcome: str, predictors: Sequence[str]) -> Fit:
    """Ordinary least squares with a constant; collinear columns share the least-norm solution."""
    columns = [F.lit(1.0), *[F.col(p).cast("double") for p in predictors], F.col(outcome).cast("double")]
    products = _products(df, columns)
    gram, moments = products[:-1, :-1], products[:-1, -1]
    inverse = np.linalg.pinv(gram, hermitian=True)
    beta = inverse @ moments
    rows = products[0, 0]
    return Fit(
        names=["const", *predictors],
        beta=beta,
        inverse=inverse,
        residual_sum=max(0.0, float(products[-1, -1] - beta @ moments)),
        total_sum=float(products[-1, -1] - products[0, -1] ** 2 / rows) if rows else 0.0,
        rows=int(rows),
    )


def _linear(weights: np.ndarray, columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for weight, column in zip(weights, columns):
        total = total + F.lit(float(weight)) * column
    return total


def hc3_covariance(df: DataFrame, outcome: str, fit: Fit) -> np.ndarray:
    """Covariance of the coefficients that is robust to unequal variances (HC3)."""
    columns = [F.lit(1.0), *[F.col(p).cast("double") for p in fit.names[1:]]]
    leverage = F.lit(0.0)
    for i, column in enumerate(columns):
        leverage = leverage + column * _linear(fit.inverse[i], columns)
    residual = F.col(outcome) - _linear(fit.beta, columns)
    weighted = df.withColumn("_w", F.pow(ratio(residual, 1.0 - leverage), F.lit(2.0)))
    return fit.inverse @ _products(weighted, columns, F.col("_w")) @ fit.inverse


def _stars(p: float) -> str:
    return next((mark for bound, mark in STARS if p < bound), "ns")


def ols_hc3(features: DataFrame) -> DataFrame:
    """Standardized revenue drivers with robust errors, smallest effect first.

    No rows come back below the least number of store-days.
    """
    spark = features.sparkSession
    table = settle(features)
    if table.limit(MIN_DRIVER_ROWS).count() < MIN_DRIVER_ROWS:
        return spark.createDataFrame([], DRIVER_SCHEMA)
    used = [d for d in DRIVERS if d != "store_b" or not table.filter(F.col(d).isNotNull()).isEmpty()]
    scaled = standardize(table, used, population=True)
    fit = least_squares(scaled, "net_revenue", [f"{d}_z" for d in used])
    errors = np.sqrt(np.diag(hc3_covariance(scaled, "net_revenue", fit)))
    strongest = used[int(np.argmax(np.abs(fit.beta[1:])))]
    rows = []
    for name, beta, error in zip(used, fit.beta[1:], errors[1:]):
        p = normal_two_sided(beta / error) if error > 0 else None
        rows.append(
            (
                name, DRIVER_LABELS[name], float(beta), float(error), float(beta - NORMAL_95 * error),
                float(beta + NORMAL_95 * error), p, _stars(p) if p is not None else "ns", name == strongest,
                fit.r_squared, fit.rows,
            )
        )
    return spark.createDataFrame(sorted(rows, key=lambda r: r[2]), DRIVER_SCHEMA)


def _panel_rows(features: DataFrame, outcome: str, location_id: str) -> DataFrame:
    place = F.col("location_id")
    chosen = features.filter(place != engagement.ALL if location_id == engagement.ALL else place == location_id)
    order = Window.partitionBy("location_id").orderBy("date")
    log_outcome = F.log1p(F.greatest(F.coalesce(F.col(outcome).cast("double"), F.lit(0.0)), F.lit(0.0)))
    logged = chosen.withColumn("outcome_log", log_outcome)
    return logged.withColumns(
        {
            "lag_outcome_1": F.lag("outcome_log", 1).over(order),
            "lag_outcome_7": F.lag("outcome_log", 7).over(order),
            "holiday_flag": F.col("holiday_flag").cast("double"),
            "promo_flag": F.col("promo_flag").cast("double"),
        }
    )


def _daily_source(panel: DataFrame, outcome: str, signals: Sequence[str]) -> DataFrame:
    other = next(o for o in engagement.OUTCOMES if o != outcome)
    means = [F.avg(s).alias(s) for s in engagement.SIGNALS]
    return panel.groupBy("date").agg(
        F.sum(F.col(outcome).cast("double")).alias(outcome), F.sum(F.col(other).cast("double")).alias(other), *means
    ).withColumn("location_id", F.lit(engagement.ALL))


def _levels(df: DataFrame, column: Column) -> list:
    """Sorted levels of a calendar column, without the first one (the reference level)."""
    return sorted(r[0] for r in df.select(column.alias("level")).distinct().collect())[1:]


def _panel_fit(features: DataFrame, outcome: str, location_id: str):
    panel = settle(_panel_rows(features, outcome, location_id))
    weighted = [s for s in engagement.SIGNALS if s.startswith("weighted_")]
    shares = [s for s in engagement.SIGNALS if s.endswith("_share")]
    positive = panel.agg(*[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in weighted]).first()
    signals = ["engagement_index", *(weighted if any(positive[s] > 0 for s in weighted) else shares)]
    source = settle(_daily_source(panel, outcome, signals))
    correlations = engagement.lag_correlations(source)
    peaks = settle(engagement.peak_lag(correlations).filter(F.col("outcome") == outcome))
    lags = {r["signal"]: r["peak_lag"] for r in peaks.collect() if r["signal"] in signals}
    kernels = engagement.lag_kernel(peaks)
    spread = (
        engagement.distributed_lag(source, kernels, outcome)
        .groupBy("date")
        .pivot("signal", signals)
        .agg(F.first("distributed"))
    )
    spread = spread.select("date", *[F.col(s).alias(f"dl_{s}") for s in signals])
    start = panel.agg(F.min("date")).first()[0]
    joined = (
        panel.join(spread, "date", "left")
        .withColumn("trend_idx", F.datediff("date", F.lit(start)).cast("double"))
        .withColumn("dow", F.weekday("date"))
        .withColumn("month_num", F.month("date"))
    )
    scaled_columns = [
        "lag_outcome_1", "lag_outcome_7", "trend_idx", *[f"dl_{s}" for s in signals], "holiday_flag", "promo_flag",
    ]
    complete = settle(
        joined.select("location_id", "dow", "month_num", "outcome_log", *scaled_columns).dropna(
            subset=["outcome_log", *scaled_columns]
        )
    )
    if complete.limit(MIN_PANEL_ROWS).count() < MIN_PANEL_ROWS:
        return None
    # A column without spread explains nothing and stays out of the system.
    spreads = complete.agg(*[F.stddev_samp(c).alias(c) for c in scaled_columns]).first()
    live = [c for c in scaled_columns if spreads[c]]
    table = standardize(complete, live, population=False)
    dummies = {f"dow_{v}": (F.col("dow") == v).cast("double") for v in _levels(complete, F.col("dow"))}
    dummies |= {f"month_{v}": (F.col("month_num") == v).cast("double") for v in _levels(complete, F.col("month_num"))}
    table = table.withColumns(dummies) if dummies else table
    names = [*[f"{c}_z" for c in live], *dummies]
    # Taking each site's means out of every column is the same as a dummy per site, and keeps
    # the system small however many sites there are.
    means = table.groupBy("location_id").agg(*[F.avg(c).alias(f"_mean_{c}") for c in ["outcome_log", *names]])
    within = table.join(means, "location_id").withColumns(
        {c: F.col(c) - F.col(f"_mean_{c}") for c in ["outcome_log", *names]}
    )
    fit = least_squares(within, "outcome_log", names)
    facts = complete.agg(
        F.count_distinct("location_id").alias("places"), (F.var_pop("outcome_log") * F.count(F.lit(1))).alias("total")
    ).first()
    fit.total_sum = facts["total"]
    return fit, signals, lags, facts["places"]


def dynamic_panel(features: DataFrame, outcome: str = "revenue", location_id: str = engagement.ALL) -> DataFrame:
    """Effects of social signals on the log outcome, beside lags, trend, calendar and site.

    One row per signal and flag, with classical errors and Student's t; empty below the least
    number of rows.
    """
    spark = features.sparkSession
    result = _panel_fit(features, outcome, location_id)
    if result is None:
        return spark.createDataFrame([], PANEL_SCHEMA)
    fit, signals, lags, places = result
    # The constant of the demeaned system stands for the sites' own constants.
    freedom = fit.rows - (int(np.linalg.matrix_rank(fit.inverse, hermitian=True)) - 1) - places
    variance = fit.residual_sum / freedom
    critical = student_critical(freedom)
    rows = []
    for name in [*signals, "holiday_flag", "promo_flag"]:
        column = f"dl_{name}_z" if name in signals else f"{name}_z"
        if column not in fit.names:
            rows.append((name, lags.get(name), *[None] * 6, fit.r_squared, fit.rows, places))
            continue
        place = fit.names.index(column)
        beta, error = float(fit.beta[place]), math.sqrt(variance * fit.inverse[place, place])
        p = student_two_sided(beta / error, freedom) if error > 0 else None
        change = (math.exp(beta) - 1) * 100 if name in signals else None
        rows.append(
            (
                name, lags.get(name), beta, error, beta - critical * error, beta + critical * error, p, change,
                fit.r_squared, fit.rows, places,
            )
        )
    return spark.createDataFrame(rows, PANEL_SCHEMA)


def response_curves(panel: DataFrame, max_lag: int = engagement.MAX_LAG) -> DataFrame:
    """The effect of one deviation of a signal, spread over the lags, in percent."""
    kernels = engagement.lag_kernel(panel.filter(F.col("cumulative_pct").isNotNull()), max_lag)
    return kernels.select("predictor", "beta", F.posexplode("weights").alias("place", "weight")).select(
        "predictor",
        (F.col("place") + 1).alias("lag"),
        ((F.exp(F.col("beta") * F.col("weight")) - 1) * 100).alias("effect_pct"),
    )


def evidence_level(r_squared: Column, n_days: Column) -> Column:
    chain = F.lit("Directional")
    for level, least_r2, least_days in reversed(EVIDENCE):
        chain = F.when((r_squared >= least_r2) & (n_days >= least_days), level).otherwise(chain)
    return chain
