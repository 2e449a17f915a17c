"""Synthetic tables, generated on the cluster from hashes of seeds and keys: any partitioning gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.core.checks import as_names, col, reject, require_columns

# The additive risk table of the credit data.
STATUS_RISK = {"Approved and Contracted": -0.15, "Approved Not Contracted": -0.05, "Rejected": 0.10}
SIZE_RISK = {"Small": 0.08, "Medium": 0.03, "Large": -0.03, "Very Large": -0.07}
SECTION_RISK = dict(zip("ABCDEFGHIJKLMNOPQRSTU", (0.65, 0.60, 0.55, 0.50, 0.48, 0.45, 0.42, 0.40, 0.38, 0.36, 0.34, 0.32, 0.30, 0.28, 0.26, 0.24, 0.22, 0.20, 0.18, 0.16, 0.14), strict=True))


def uniform(*parts: Column | int | str) -> Column:
    """A number in (0, 1), decided by a hash of the parts."""
    key = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.shiftrightunsigned(key, 12).cast("double") + 0.5) * 2.0**-52


def normal(*parts: Column | int | str) -> Column:
    """A standard normal number, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(*parts, "r"))) * F.cos(2 * math.pi * uniform(*parts, "a"))


def _pick(options: Sequence[str], *parts: Column | int | str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(uniform(*parts) * len(options)) + 1).cast("int"))


def _risk(table: dict[str, float], name: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(name)]


def simulate_credit_data(spark: SparkSession | None = None, *, row_count: int = 10_000, feature_count: int = 20, max_days: int = 30, seed: int = 42, informative_fraction: float = 1 / 6, signal_strength: float = 0.75, anchor_date: date | None = None) -> tuple[DataFrame, list[str]]:
    """Companies with a status, a 0/1 default and normal features, of which a share shifts with the default; and the features' names.

    Dates lie 1 to ``max_days`` after ``anchor_date`` (default: today).
    """
    if row_count < 1 or feature_count < 1 or max_days < 1 or not 0 <= informative_fraction <= 1 or signal_strength <= 0:
        raise ValueError("counts and signal must be positive, the informative share between 0 and 1")
    spark = spark or SparkSession.builder.getOrCreate()
    k, names = F.col("id"), [f"feature_{i:02d}" for i in range(1, feature_count + 1)]
    count = max(1, int(feature_count * informative_fraction)) if informative_fraction else 0
    draws = spark.range(feature_count).select("id", uniform(seed, "chosen", k).alias("u"), F.when(uniform(seed, "sign", k) < 0.5, -1.0).otherwise(1.0).alias("sign")).orderBy("u").limit(count).collect()
    signs = {r["id"]: r["sign"] for r in draws}
    rows = spark.range(row_count).withColumns({
        "company_id": F.lpad(F.floor(uniform(seed, "company", k) * 1e14).cast("long").cast("string"), 14, "0"),
        "reference_date": F.date_format(F.date_add(F.lit(anchor_date or date.today()), (F.floor(uniform(seed, "day", k) * max_days) + 1).cast("int")), "yyyy-MM-dd"),
        "status": _pick(list(STATUS_RISK), seed, "status", k),
        "industry_section": _pick(list(SECTION_RISK), seed, "section", k),
        "company_size": _pick(list(SIZE_RISK), seed, "size", k),
    })
    risk = F.greatest(F.lit(0.01), F.least(F.lit(0.99), _risk(SECTION_RISK, "industry_section") + _risk(STATUS_RISK, "status") + _risk(SIZE_RISK, "company_size")))
    rows = rows.withColumn("default_flag", (uniform(seed, "default", k) < risk).cast("long"))
    features = [F.round(normal(seed, "feature", i, k) + signs.get(i, 0.0) * signal_strength * (F.col("default_flag") - 0.5), 6).alias(n) for i, n in enumerate(names)]
    return rows.select("company_id", "reference_date", "status", "default_flag", "industry_section", "company_size", *features), names


def simulate_bureau_history(customers: DataFrame, entity_cols: str | Sequence[str], initial_date: date | str, final_date: date | str, frequency: str = "monthly", seed: int = 42, *, late_entry_fraction: float = 0.1, missing_customer_fraction: float = 0.1, missing_period_probability: float = 0.15, score_min: float = 0.0, score_max: float = 1000.0, persistence: float = 0.85, noise_std: float = 25.0, observation_col: str = "observation_date", score_col: str = "score") -> DataFrame:
    """A score history of each distinct customer: a clipped AR(1) path around an own Beta(5, 3) level.

    Some customers begin late, some miss periods. The level is the fifth of seven uniform numbers in order
    (which is Beta(5, 3)); noise and gaps are hashes of seed, key and period, so paths don't depend on row
    order. Months are observed on their last days.
    """
    keys = as_names(entity_cols, "entity_cols", True)
    require_columns(customers, keys)
    start, end = date.fromisoformat(str(initial_date)), date.fromisoformat(str(final_date))
    if start > end or frequency not in ("daily", "weekly", "monthly") or {observation_col, score_col} & set(keys) or observation_col == score_col:
        raise ValueError("dates must be in order, the frequency daily, weekly or monthly, and names different")
    if not all(0 <= x <= 1 for x in (late_entry_fraction, missing_customer_fraction, missing_period_probability, persistence)) or late_entry_fraction + missing_customer_fraction >= 0.5 or score_min >= score_max or noise_std < 0:
        raise ValueError("shares must lie between 0 and 1 (incomplete customers under a half), score_min below score_max")
    missing = F.lit(False)
    for k in keys:
        missing |= col(k).isNull()
    reject(customers, {"customer keys must not be null": missing})
    step = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month"}[frequency]
    first = F.trunc(F.lit(start), "month") if frequency == "monthly" else F.lit(start)
    days = F.sequence(first, F.lit(end), F.expr(f"interval {step}"))
    if frequency == "monthly":
        days = F.filter(F.transform(days, F.last_day), lambda d: d <= F.lit(end))
    key = F.xxhash64(F.lit(seed), *[col(k) for k in keys])
    level = score_min + (score_max - score_min) * F.sort_array(F.array(*[uniform(key, "level", i) for i in range(7)]))[4]
    people = customers.select(*[col(k) for k in keys]).distinct().withColumns({"__key": key, "__level": level, "__group": uniform(key, "group"), "__days": days})

    def advance(path: Column, i: Column) -> Column:
        last = F.when(F.size(path) > 0, F.element_at(path, -1)).otherwise(F.col("__level"))
        noise = noise_std * normal(F.col("__key"), "noise", i)
        new = F.col("__level") + persistence * (last - F.col("__level")) + noise
        return F.concat(path, F.array(F.greatest(F.lit(float(score_min)), F.least(F.lit(float(score_max)), new))))

    path = F.aggregate(F.sequence(F.lit(0), F.size("__days") - 1), F.array().cast("array<double>"), advance)
    late = F.col("__group") < late_entry_fraction
    entry = F.when(late & (F.size("__days") > 1), 1 + F.floor(uniform(F.col("__key"), "entry") * (F.size("__days") - 1))).otherwise(0)
    gaps = ~late & (F.col("__group") < late_entry_fraction + missing_customer_fraction)
    points = people.where(F.size("__days") > 0).select(*[col(k) for k in keys], "__key", entry.alias("__entry"), gaps.alias("__gaps"), F.posexplode(F.arrays_zip(F.col("__days").alias("day"), path.alias("score"))).alias("__i", "__p"))
    kept = (F.col("__i") >= F.col("__entry")) & ~(F.col("__gaps") & (uniform(F.col("__key"), "gap", F.col("__i")) < missing_period_probability))
    return points.where(kept).select(*[col(k) for k in keys], F.col("__p.day").alias(observation_col), F.col("__p.score").alias(score_col))
