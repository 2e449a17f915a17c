"""Monthly sketches of columns: quantiles, bands and distinct counts of any span of months, without reading old rows again."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskloom.core.checks import as_names, col, present, require_columns

#: Size of a quantile sketch, and the binary logarithm of the registers of a distinct-count sketch.
K, LG_K = 4096, 12
SCHEMA = "column string, rows long, present long, ranks binary, kinds binary, cohort string"


def rank_error(k: int = K, shares: bool = False) -> float:
    """What a rank read from a sketch of this size may be wrong by (of 1), in 99 of 100 sketches; with ``shares``, a difference of two ranks.

    It holds for one month and for any merged span alike. Up to ``k`` values are kept as they are and
    give exact answers. The factors are those fitted by the authors of the sketch.
    """
    return 2.446 / k**0.9433 if shares else 2.296 / k**0.9723


def distinct_error(lg_k: int = LG_K) -> float:
    """Standard error of a merged distinct count, as a share of it."""
    return 1.04 / math.sqrt(1 << lg_k)


def monthly_sketches(df: DataFrame, date_col: str, value_cols: str | Sequence[str], *, k: int = K, lg_k: int = LG_K) -> DataFrame:
    """Rows ``column, rows, present, ranks, kinds, cohort`` (yyyyMM): a month's counts and sketches of each column, from one pass.

    Sketches are built in the tasks that read the rows and merged after; a row of sketches a task and month
    is all that is shuffled, so a month of any size is no hot key. Nulls and NaN are not present; texts and other columns that are not
    numbers have distinct counts only. Rows without a date are left out.
    """
    names = as_names(value_cols, "value_cols", True)
    require_columns(df, [date_col, *names])
    numeric = {n: isinstance(df.schema[n].dataType, NumericType) for n in names}
    values = [F.when(present(col(n)), col(n)).alias(f"v{i}") if numeric[n] else col(n).alias(f"v{i}") for i, n in enumerate(names)]
    rows = df.select(F.date_format(col(date_col), "yyyyMM").alias("cohort"), *values).where("cohort is not null")
    parts = []
    for i, n in enumerate(names):
        v = F.col(f"v{i}")
        parts.append(F.count(v).alias(f"n{i}"))
        parts.append((F.kll_sketch_agg_double(v.cast("double"), k) if numeric[n] else F.first(F.lit(None).cast("binary"))).alias(f"q{i}"))
        parts.append(F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), lg_k).alias(f"d{i}"))
    wide = rows.groupBy("cohort").agg(F.count("*").alias("rows"), *parts)
    each = [F.struct(F.lit(n).alias("column"), F.col("rows"), F.col(f"n{i}").alias("present"), F.col(f"q{i}").alias("ranks"), F.col(f"d{i}").alias("kinds")) for i, n in enumerate(names)]
    return wide.select("cohort", F.explode(F.array(*each)).alias("x")).select("x.*", "cohort")


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a column (and what else ``by`` names) over all months given: sums of the counts, merged sketches."""
    some = F.when(F.col("present") > 0, F.col("ranks"))
    whole = F.when(F.count(some) > 0, F.kll_merge_agg_double(some))
    return sketches.groupBy(*by, "column").agg(F.sum("rows").alias("rows"), F.sum("present").alias("present"), whole.alias("ranks"), F.hll_union_agg("kinds").alias("kinds"))


def _numbers() -> Column:
    return (F.col("present") > 0) & F.col("ranks").isNotNull()


def quantile(share: float) -> Column:
    """The least value whose rank reaches ``share`` (0: the minimum, 1: the maximum, both exact); null without values."""
    return F.when(_numbers(), F.kll_sketch_get_quantile_double("ranks", F.lit(float(share))))


def rank(value: float) -> Column:
    """The share of present values up to and with ``value``."""
    return F.when(_numbers(), F.kll_sketch_get_rank_double("ranks", F.lit(float(value))))


def distinct() -> Column:
    """The number of different present values; all but exact for a few hundred, then within :func:`distinct_error`."""
    return F.hll_sketch_estimate("kinds")


def band_shares(sketches: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """The rows given with ``band`` (1 to len(cutoffs) + 1; a band ends with its cutoff) and ``share`` of present values in it."""
    if list(cutoffs) != sorted(cutoffs):
        raise ValueError("cutoffs must not fall")
    ranks = [F.lit(0.0), *[rank(c) for c in cutoffs], F.lit(1.0)]
    each = F.array(*[F.struct(F.lit(i + 1).alias("band"), F.when(_numbers(), ranks[i + 1] - ranks[i]).alias("share")) for i in range(len(cutoffs) + 1)])
    kept = [c for c in sketches.columns if c not in ("ranks", "kinds")]
    return sketches.select(*kept, F.explode(each).alias("__b")).select(*kept, "__b.*")


class SketchStore:
    """Monthly sketches in a folder that all executors reach, a partition a month.

    ``add`` reads the new rows only. A month that is added again is replaced as a whole (so a repeated or
    retried load does no harm); give a month's rows together. ``span`` reads the named months' sketches only.
    """

    def __init__(self, spark: SparkSession, path: str, *, k: int = K, lg_k: int = LG_K) -> None:
        self.spark, self.path, self.k, self.lg_k = spark, path, k, lg_k

    def add(self, df: DataFrame, date_col: str, value_cols: str | Sequence[str]) -> None:
        found = monthly_sketches(df, date_col, value_cols, k=self.k, lg_k=self.lg_k)
        found.write.partitionBy("cohort").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def months(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The stored rows of the months from ``first`` to ``last`` (yyyyMM, both included, open if None)."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        for edge, inside in ((first, F.col("cohort") >= first), (last, F.col("cohort") <= last)):
            rows = rows if edge is None else rows.where(inside)
        return rows

    def span(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """One row a column, merged over the months."""
        return merged(self.months(first, last))

    def cutoffs(self, column: str, parts: int = 10, first: str | None = None, last: str | None = None) -> list[float]:
        """The values between ``parts`` equal parts of a column over the months, each within :func:`rank_error`; none without values."""
        row = self.span(first, last).where(F.col("column") == column).select(*[quantile(i / parts).alias(f"c{i}") for i in range(1, parts)]).first()
        return [] if row is None or row[0] is None else list(row)
