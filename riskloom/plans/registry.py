"""Registered queries over the driver tables, and the same results as DuckDB SQL."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import cube, metrics, modelling, provider, search, selection, sketches, temporal, wide
from riskloom.sources import synthetic, tables
from riskloom.sources.tables import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Ranking metrics.

_GROUPED = ("seg", "PARTITION BY seg ", "GROUP BY seg ")


def _tiles_sql(keys: str, score: str = "score", tiles: int = 10, way: str = "DESC") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}tile, min(s) AS low, max(s) AS high, CAST(count(*) AS BIGINT) AS n, CAST(sum(target) AS BIGINT) AS e
 FROM (SELECT {lead}{score} AS s, target, ntile({tiles}) OVER ({part}ORDER BY {score} {way}) AS tile FROM pred) GROUP BY {lead}tile"""


def _scores_sql(keys: str, score: str = "score") -> str:
    lead = f"{keys}, " if keys else ""
    return f"SELECT {lead}-{score} AS tile, {score} AS low, CAST(count(*) AS BIGINT) AS n, CAST(sum(target) AS BIGINT) AS e FROM pred GROUP BY {lead}{score}"


def _points_sql(counts: str, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""SELECT *, sum(e) OVER ({part}ORDER BY tile) / sum(e) OVER ({part}) AS tpr, sum(n - e) OVER ({part}ORDER BY tile) / sum(n - e) OVER ({part}) AS fpr,
 e / sum(e) OVER ({part}) AS de, (n - e) / sum(n - e) OVER ({part}) AS dn FROM ({counts})"""


def _metric_sql(counts: str, keys: str, what: str) -> str:
    lead, by = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    ks, auc = "max(abs(tpr - fpr))", "sum(dn * (2 * tpr - de) / 2)"
    columns = {"ks": f'round({ks}, 6) AS "KS"', "auc": f"round({auc}, 6) AS auc, round(2 * {auc} - 1, 6) AS gini"}[what]
    return f"WITH pred AS ({tables.SCORED}) SELECT {lead}{columns} FROM ({_points_sql(counts, keys)}){by}"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, tables.SCORED)


for _name, _keys in (("overall", ""), ("grouped", "seg")):
    _by = _keys or None
    query(f"ks_ntile_{_name}", _metric_sql(_tiles_sql(_keys), _keys, "ks"))(lambda s, d, by=_by: _rounded(metrics.ks_ntile("score", _scored(s, d), by)))
    query(f"auc_gini_{_name}", _metric_sql(_tiles_sql(_keys), _keys, "auc"))(lambda s, d, by=_by: _rounded(metrics.auc_gini("score", _scored(s, d), by)))
    query(f"exact_ks_{_name}", _metric_sql(_scores_sql(_keys), _keys, "ks"))(lambda s, d, by=_by: _rounded(metrics.ks_exact("score", _scored(s, d), by)))
    query(f"exact_auc_{_name}", _metric_sql(_scores_sql(_keys), _keys, "auc"))(lambda s, d, by=_by: _rounded(metrics.auc_gini("score", _scored(s, d), by, exact=True)))

query("roc_curve", f"WITH pred AS ({tables.SCORED}), p AS ({_points_sql(_tiles_sql(''), '')}) SELECT CAST(tile AS INT) AS tile, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM p UNION ALL SELECT 0, 0.0, 0.0")(lambda s, d: _rounded(metrics.curve_roc("score", _scored(s, d))))
query("exact_roc", f"WITH pred AS ({tables.SCORED}), p AS ({_points_sql(_scores_sql(''), '')}) SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(low, 6) AS threshold FROM p")(lambda s, d: _rounded(metrics.curve_roc("score", _scored(s, d), exact=True).where("threshold < double('Infinity')")))

_RISK = "CAST(tile AS INT) AS n_tile, round(low, 6) AS minimum_range, round(high, 6) AS maximum_range, n AS total_volume, e AS total_events, n - e AS total_non_events, round(e / n, 6) AS event_rate"
for _name, _way in (("desc", "DESC"), ("asc", "ASC")):
    query(f"risk_table_{_name}", f"WITH pred AS ({tables.SCORED}) SELECT {_RISK} FROM ({_tiles_sql('', way=_way)})")(lambda s, d, up=_way == "ASC": _rounded(metrics.risk_table("score", _scored(s, d), ascending=up)))


# Scores with many equal values: a column breaks the ties.
_TIED = f"SELECT id, seg, period, target, floor(score / 20000) AS score FROM ({tables.SCORED})"


def _tied_sql(what: str) -> str:
    return _metric_sql(_tiles_sql("", way="DESC, id"), "", what).replace(f"({tables.SCORED})", f"({_TIED})", 1)


query("ks_ties", _tied_sql("ks"))(lambda s, d: _rounded(metrics.ks_ntile("score", view(s, d, _TIED), tie_breaker="id")))
query("auc_gini_ties", _tied_sql("auc"))(lambda s, d: _rounded(metrics.auc_gini("score", view(s, d, _TIED), tie_breaker="id")))
query("risk_table_ties", f"WITH pred AS ({_TIED}) SELECT {_RISK} FROM ({_tiles_sql('', way='ASC, id')})")(lambda s, d: _rounded(metrics.risk_table("score", view(s, d, _TIED), ascending=True, tie_breaker="id")))
query("exact_auc_ties", _metric_sql(_scores_sql(""), "", "auc").replace(f"({tables.SCORED})", f"({_TIED})", 1))(lambda s, d: _rounded(metrics.auc_gini("score", view(s, d, _TIED), exact=True)))


def _cube_sql(kind: str) -> str:
    parts = []
    for score in ("score", "reverse"):
        for keys in ("", "seg", "period", "seg, period"):
            labels = ", ".join(f"CAST({k} AS VARCHAR) AS {k}" if k in keys.split(", ") else f"'{cube.OVERALL}' AS {k}" for k in ("seg", "period"))
            if kind == "tiles":
                parts.append(f"SELECT {labels}, {_RISK}, '{score}' AS score FROM ({_tiles_sql(keys, score, 5)})")
                continue
            counts = _tiles_sql(keys, score) if kind == "metrics" else _scores_sql(keys, score)
            auc = "sum(dn * (2 * tpr - de) / 2)"
            parts.append(f"SELECT {labels}, round(max(abs(tpr - fpr)), 5) AS \"KS\", round({auc}, 5) AS \"AUC\", round(2 * {auc} - 1, 5) AS \"Gini\", '{score}' AS score FROM ({_points_sql(counts, keys)}){f' GROUP BY {keys}' if keys else ''}")
    return f"WITH pred AS (SELECT * FROM ({tables.SCORED})) " + " UNION ALL ".join(parts)


query("cube_metrics", _cube_sql("metrics"))(lambda s, d: cube.calculate_metrics(_scored(s, d), ["seg", "period"], ["score", "reverse"]))
query("cube_metrics_exact", _cube_sql("exact"))(lambda s, d: cube.calculate_metrics(_scored(s, d), ["seg", "period"], ["score", "reverse"], exact=True))
query("cube_ntile", _cube_sql("tiles"))(lambda s, d: _rounded(cube.calculate_ntile(_scored(s, d), ["seg", "period"], ["score", "reverse"], n_tiles=5)))


# Point-in-time features.


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, tables.HISTORY), view(spark, sf_dir, tables.SPINE)


def _edge(k: int, unit: str = "months") -> str:
    return f"CAST(r - INTERVAL {k * (7 if unit == 'weeks' else 1)} {'MONTH' if unit == 'months' else 'DAY'} AS DATE)" if k else "r"


def _as_of(value: str, k: int = 0, unit: str = "months", stale: int | None = None) -> str:
    seen = f"{value} IS NOT NULL AND d <= {_edge(k, unit)}" + (f" AND d >= CAST({_edge(k, unit)} - INTERVAL {stale} DAY AS DATE)" if stale is not None else "")
    return f"arg_max({value}, d) FILTER (WHERE {seen})", f"max(d) FILTER (WHERE {seen})"


def _lookup_sql(name: str, value: str, k: int, unit: str = "months", stale: int | None = None, legacy: bool = False) -> str:
    found, day = _as_of(value, k, unit, stale)
    gap = "__" if legacy else "_"
    when = f"{day} AS {value}{gap}{name}_date" if legacy else f"CAST(date_diff('day', {day}, r) AS INT) AS {value}{gap}{name}_date_diff_days"
    return f"round({found}, 6) AS {value}{gap}{name}, {when}"


_SQL_AGGREGATES = {"mean": "avg", "median": "median", "max": "max", "min": "min", "std": "stddev_samp", "sum": "sum", "count": "count"}


def _window_sql(value: str, k: int, kinds: list[str], unit: str = "months") -> str:
    inside = f"FILTER (WHERE d > {_edge(k, unit)})"
    out = [f"{f'CAST(count({value}) {inside} AS BIGINT)' if a == 'count' else f'round({_SQL_AGGREGATES[a]}({value}) {inside}, 6)'} AS {value}_{a}_{k}_{unit}" for a in kinds]
    return ", ".join([*out, f"round({_as_of(value)[0]} - avg({value}) {inside}, 6) AS {value}_current_minus_mean_{k}_{unit}"])


def _temporal_sql(columns: list[str], history: str = tables.HISTORY, spine: str = tables.SPINE, kept: str = "id, segment, r") -> str:
    return f"WITH h AS ({history}), s AS ({spine}) SELECT {', '.join('s.' + c for c in kept.split(', '))}, {', '.join(columns)} FROM s LEFT JOIN h ON h.id = s.id AND d <= r GROUP BY {', '.join('s.' + c for c in kept.split(', '))}"


def _build(spark: SparkSession, sf_dir: str, values: str | list[str] = "total", **options) -> DataFrame:
    base, spine = _history(spark, sf_dir)
    return _rounded(temporal.build_features(base, spine, key_cols="id", date_col="d", reference_date_col="r", value_cols=values, **options))


query("tf_current_lag", _temporal_sql([_lookup_sql(n, v, k) for v in ("total", "most") for n, k in (("current", 0), ("lag_1_months", 1), ("lag_6_months", 6))]))(lambda s, d: _build(s, d, ["total", "most"], windows=(), lags=(1, 6)))
query("tf_windows", _temporal_sql([_lookup_sql("current", "total", 0), *(_window_sql("total", k, ["mean", "max", "min", "sum", "count"]) for k in (3, 12))]))(lambda s, d: _build(s, d, windows=(3, 12), lags=(), aggregations=("mean", "max", "min", "sum", "count")))
query("tf_median_std", _temporal_sql([_lookup_sql("current", "most", 0), _window_sql("most", 24, ["median", "std"])]))(lambda s, d: _build(s, d, "most", windows=(24,), lags=(), aggregations=("median", "std")))
query("tf_staleness", _temporal_sql([_lookup_sql("current", "total", 0, stale=45), _lookup_sql("lag_3_months", "total", 3, stale=45)]))(lambda s, d: _build(s, d, windows=(), lags=(3,), max_staleness_days=45))
query("tf_legacy_names", _temporal_sql([_lookup_sql("current", "total", 0, legacy=True), _lookup_sql("lag_2_months", "total", 2, legacy=True)]))(lambda s, d: _rounded(temporal.temporal_features(*reversed(_history(s, d)), "id", "total", reference_col="r", observation_col="d", windows=(), lags=(2,))))


def _daily(spark: SparkSession, sf_dir: str, unit: str, windows: tuple, lags: tuple) -> DataFrame:
    found = temporal.build_features(view(spark, sf_dir, tables.DAILY), view(spark, sf_dir, tables.DAILY_SPINE), key_cols="id", date_col="d", reference_date_col="r", value_cols="total", period_unit=unit, windows=windows, lags=lags, aggregations=("mean", "count"))
    return _rounded(found)


for _unit, _w, _l in (("days", 5, 3), ("weeks", 2, 1)):
    query(f"tf_{_unit}", _temporal_sql([_lookup_sql("current", "total", 0, _unit), _lookup_sql(f"lag_{_l}_{_unit}", "total", _l, _unit), _window_sql("total", _w, ["mean", "count"], _unit)], tables.DAILY, tables.DAILY_SPINE, "id, r"))(lambda s, d, u=_unit, w=_w, k=_l: _daily(s, d, u, (w,), (k,)))

_RELATED = """SELECT id, segment, r, round(c, 6) AS total_current, cd AS total_current_date_diff_days, round(l, 6) AS total_lag_6_months, ld AS total_lag_6_months_date_diff_days,
 round(m, 6) AS total_mean_12_months, round(hi, 6) AS total_max_12_months, round(lo, 6) AS total_min_12_months, round(sd, 6) AS total_std_12_months, round(c - m, 6) AS total_current_minus_mean_12_months,
 round(c - l, 6) AS total_current_vs_lag_6_months_diff, round(c / nullif(l, 0), 6) AS total_current_vs_lag_6_months_ratio, round(100 * (c - l) / nullif(l, 0), 6) AS total_current_vs_lag_6_months_pct_change,
 round(c / nullif(m, 0), 6) AS total_current_vs_mean_12_months_ratio, round(100 * (c - m) / nullif(m, 0), 6) AS total_current_vs_mean_12_months_pct_change,
 round(c - hi, 6) AS total_current_vs_max_12_months_diff, round(c / nullif(hi, 0), 6) AS total_current_vs_max_12_months_ratio, round(100 * (c - hi) / nullif(hi, 0), 6) AS total_current_vs_max_12_months_pct_change,
 round(c - lo, 6) AS total_current_vs_min_12_months_diff, round(c / nullif(lo, 0), 6) AS total_current_vs_min_12_months_ratio, round(100 * (c - lo) / nullif(lo, 0), 6) AS total_current_vs_min_12_months_pct_change,
 round(hi - lo, 6) AS total_range_12_months, round((c - m) / nullif(sd, 0), 6) AS total_standardized_deviation_12_months, round(sd / nullif(abs(m), 0), 6) AS total_coefficient_of_variation_12_months"""
_PARTS = f"{_as_of('total')[0]} AS c, CAST(date_diff('day', {_as_of('total')[1]}, r) AS INT) AS cd, {_as_of('total', 6)[0]} AS l, CAST(date_diff('day', {_as_of('total', 6)[1]}, r) AS INT) AS ld, " + ", ".join(f"{f}(total) FILTER (WHERE d > {_edge(12)}) AS {n}" for f, n in (("avg", "m"), ("max", "hi"), ("min", "lo"), ("stddev_samp", "sd")))
query("tf_relations", f"{_RELATED} FROM ({_temporal_sql([_PARTS])})")(lambda s, d: _build(s, d, windows=(12,), lags=(6,), aggregations=("mean", "max", "min", "std"), relative_historico=True))

_CUSTOM = {"share": {"op": "divide", "args": [{"col": "most"}, {"op": "subtract", "args": [{"col": "n"}, {"lit": 1}]}]}, "spread": {"op": "sum", "args": [{"col": "total"}, {"op": "multiply", "args": [{"col": "most"}, {"lit": -0.5}]}]}}
_CUSTOM_SQL = "SELECT *, most / nullif(n - 1, 0) AS share, total + most * CAST(-0.5 AS DOUBLE) AS spread FROM ({})"
query("tf_custom_cols", _temporal_sql([x for v in ("share", "spread") for x in (_lookup_sql("current", v, 0), _window_sql(v, 12, ["mean", "count"]))], _CUSTOM_SQL.format(tables.HISTORY)))(lambda s, d: _build(s, d, ["share", "spread"], windows=(12,), lags=(), aggregations=("mean", "count"), create_cols=_CUSTOM))
_FILLED_SQL = f"SELECT id, d, coalesce(most, 0) AS most, coalesce(coalesce(most, 0) / nullif(n - 1, 0), 0) AS share FROM ({tables.HISTORY})"
query("tf_zero_fill", _temporal_sql([x for v in ("most", "share") for x in (_lookup_sql("current", v, 0), _window_sql(v, 12, ["mean", "count"]))], _FILLED_SQL))(lambda s, d: _build(s, d, ["most", "share"], windows=(12,), lags=(), aggregations=("mean", "count"), create_cols={"share": _CUSTOM["share"]}, nullable=False))


# Provider validation.

_PROVIDER = f"WITH sent AS ({tables.SENT}), received AS ({tables.RECEIVED}) "
_INSIDE = "score BETWEEN 0 AND 1000"
_BASE = "199501"


def _summary_sql(side: str) -> str:
    return f"""SELECT '{side}' AS side, CAST(sum(n) AS BIGINT) AS "rows", count(*) AS distinct_keys, CAST(count(id) AS BIGINT) AS valid_distinct_keys, CAST(coalesce(sum(n) FILTER (WHERE id IS NULL), 0) AS BIGINT) AS null_key_rows,
 count(*) FILTER (WHERE n > 1) AS duplicate_key_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_key_rows FROM (SELECT id, count(*) AS n FROM {side} GROUP BY id)"""


@query("pv_key_summary", f"{_PROVIDER}{_summary_sql('sent')} UNION ALL {_summary_sql('received')}")
def _key_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {n: provider.key_summary(view(spark, sf_dir, q), ["id"]).withColumn("side", F.lit(n)) for n, q in (("sent", tables.SENT), ("received", tables.RECEIVED))}
    return sides["sent"].unionByName(sides["received"])


_MATCH = "CAST(count(*) FILTER (WHERE a AND b) AS BIGINT)"
query("pv_match", f"""{_PROVIDER}SELECT {_MATCH} AS matched_distinct_keys, count(*) FILTER (WHERE a) - {_MATCH} AS missing_submitted_keys, count(*) FILTER (WHERE b) - {_MATCH} AS unexpected_received_keys,
 round(100.0 * {_MATCH} / count(*) FILTER (WHERE a), 6) AS submitted_match_percentage, round(100.0 * {_MATCH} / count(*) FILTER (WHERE b), 6) AS received_match_percentage
 FROM (SELECT coalesce(s.id, r.id) AS id, s.id IS NOT NULL AS a, r.id IS NOT NULL AS b FROM (SELECT DISTINCT id FROM sent WHERE id IS NOT NULL) s FULL JOIN (SELECT DISTINCT id FROM received WHERE id IS NOT NULL) r ON s.id = r.id)""")(
    lambda s, d: _rounded(provider.match_summary(view(s, d, tables.SENT), view(s, d, tables.RECEIVED), ["id"]))
)


def _received(spark: SparkSession, sf_dir: str) -> provider.Received:
    return provider.Received.of(view(spark, sf_dir, tables.RECEIVED), "dt", "score")


query("pv_score_quality", f"""{_PROVIDER}SELECT count(*) FILTER (WHERE score IS NULL) AS missing, CAST(0 AS BIGINT) AS invalid, count(score) AS valid, count(*) FILTER (WHERE score < 0) AS below_range, count(*) FILTER (WHERE score > 1000) AS above_range,
 count(*) FILTER (WHERE {_INSIDE}) AS valid_in_range, count(*) FILTER (WHERE dt IS NULL) AS missing_dates, CAST(0 AS BIGINT) AS invalid_dates FROM received""")(lambda s, d: _received(s, d).quality())
query("pv_monthly", f"{_PROVIDER}SELECT strftime(dt, '%Y%m') AS cohort, count(*) AS \"count\" FROM received WHERE dt IS NOT NULL GROUP BY 1")(lambda s, d: _received(s, d).monthly())

_CUTS = f"SELECT unnest(quantile_disc(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cut FROM received WHERE strftime(dt, '%Y%m') = '{_BASE}' AND {_INSIDE}"


@query("pv_cutoffs", f"{_PROVIDER}SELECT CAST(row_number() OVER (ORDER BY cut) AS INT) AS decile, round(cut, 6) AS cutoff FROM ({_CUTS})")
def _cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = _received(spark, sf_dir).cutoffs(_BASE, exact=True)
    return _rounded(spark.createDataFrame([(i, float(c)) for i, c in enumerate(cuts, 1)], "decile int, cutoff double"))


@query("pv_cutoffs_approximate", "SELECT CAST(i AS INT) AS decile, true AS within_bound FROM range(1, 10) r(i)")
def _approximate_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each approximate decile, as the report uses it, lies within 1/1000 of its rank (1/10000 is what is asked for)."""
    received = _received(spark, sf_dir)
    cuts = spark.createDataFrame([(i, float(c)) for i, c in enumerate(received.cutoffs(_BASE), 1)], "decile int, cutoff double")
    inside = received.rows.where((F.col("cohort") == _BASE) & F.col("score").between(0, 1000)).select("score")
    shares = inside.join(F.broadcast(cuts)).groupBy("decile").agg(F.avg((F.col("score") <= F.col("cutoff")).cast("double")).alias("reached"), F.count("*").alias("n"))
    return shares.select("decile", (F.abs(F.col("reached") - F.col("decile") / 10) <= F.greatest(F.lit(0.001), 1.5 / F.col("n"))).alias("within_bound"))


@query("pv_report", f"""{_PROVIDER}SELECT (SELECT min(strftime(dt, '%Y%m')) FROM received) AS baseline, (SELECT count(DISTINCT strftime(dt, '%Y%m')) FROM received) AS months, 'available' AS stability_status, true AS range_warning, CAST(13 AS BIGINT) AS bands,
 CAST(1 AS BIGINT) + (SELECT CAST(count(*) > 0 AS INT) FROM received WHERE score < 0) + (SELECT CAST(count(*) > 0 AS INT) FROM received WHERE score > 1000) + (SELECT CAST(count(*) > 0 AS INT) FROM received WHERE dt IS NULL) + 2 AS warnings""")
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = provider.validate_external_dataframe(view(spark, sf_dir, tables.SENT), view(spark, sf_dir, tables.RECEIVED).withColumn("day", F.col("dt")), "id", "day", "score")
    row = (found["baseline"], len(found["monthly_volume"]), found["stability_status"], found["range_warning"], len({r["band"] for r in found["monthly_bands"]}), len(found["warnings"]))
    return spark.createDataFrame([row], "baseline string, months long, stability_status string, range_warning boolean, bands long, warnings long")


_BAND = "CASE WHEN score IS NULL THEN 'Missing' WHEN score < 0 THEN 'Below 0' WHEN score > 1000 THEN 'Above 1000' ELSE 'D' || CAST(least(1 + (SELECT count(*) FROM cuts WHERE cut < score), 10) AS VARCHAR) END"


@query("pv_bands", f"""{_PROVIDER}, cuts AS ({_CUTS}), b AS (SELECT strftime(dt, '%Y%m') AS cohort, {_BAND} AS band FROM received WHERE dt IS NOT NULL),
 m AS (SELECT cohort, count(*) AS n FROM b GROUP BY cohort), names AS (SELECT unnest({[*provider.BANDS, *provider.OUTSIDE]}) AS band)
 SELECT m.cohort, names.band, count(b.band) AS "count", round(100.0 * count(b.band) / m.n, 6) AS percentage FROM m CROSS JOIN names LEFT JOIN b ON b.cohort = m.cohort AND b.band = names.band GROUP BY m.cohort, names.band, m.n""")
def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    received = _received(spark, sf_dir)
    return _rounded(received.bands(received.cutoffs(_BASE, exact=True), [*provider.BANDS, *provider.OUTSIDE]))


query("pv_histogram", f"""{_PROVIDER}, b AS (SELECT least(CAST(floor(score / 100) AS INT), 9) AS k FROM received WHERE {_INSIDE}), every AS (SELECT unnest(range(10)) AS k)
 SELECT CAST(100 * every.k AS INT) AS lower, CAST(100 * every.k + 100 AS INT) AS upper, every.k = 9 AS upper_inclusive, count(b.k) AS "count", round(100.0 * count(b.k) / (SELECT count(*) FROM b), 6) AS percentage, round(count(b.k) / ((SELECT count(*) FROM b) * 100.0), 8) AS density
 FROM every LEFT JOIN b ON b.k = every.k GROUP BY every.k""")(lambda s, d: _received(s, d).histogram().withColumns({"percentage": F.round("percentage", 6), "density": F.round("density", 8)}))


# Feature selection.

_SEL = f"WITH t AS ({tables.SELECTION}) "
_NUMERIC = ["quantity", "price", "discount", "tax"]


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, tables.SELECTION)


def _each(features: list[str], sql: str) -> str:
    return _SEL + " UNION ALL ".join(sql.replace("{f}", f) for f in features)


query("sel_completeness", _each(["quantity", "sparse", "flag"], "SELECT '{f}' AS feature, round(count({f}) / count(*), 6) AS completeness FROM t"))(lambda s, d: _rounded(selection.quality_table(_selection(s, d), ["quantity", "sparse", "flag"]).select("feature", "completeness")))
query("sel_completeness_grouped", _each(["quantity", "sparse", "flag"], "SELECT status, '{f}' AS feature, round(count({f}) / count(*), 6) AS completeness FROM t GROUP BY status"))(lambda s, d: _rounded(selection.grouped_completeness(_selection(s, d), ["quantity", "sparse", "flag"], ["status"])))
query("sel_variance", _each([*_NUMERIC, "sparse", "flat"], "SELECT '{f}' AS feature, round(var_pop({f}), 2) AS variance FROM t"))(lambda s, d: _rounded(selection.quality_table(_selection(s, d), [*_NUMERIC, "sparse", "flat"]).select("feature", "variance"), 2))
query("sel_cardinality", _each(["quantity", "code", "flat", "flag"], "SELECT '{f}' AS feature, count(DISTINCT {f}) AS unique_count, round(count(DISTINCT {f}) / count(*), 8) AS unique_ratio FROM t"))(
    lambda s, d: selection.cardinality_table(_selection(s, d), ["quantity", "code", "flat", "flag"]).select("feature", F.col("unique").alias("unique_count"), F.round(F.col("unique") / F.col("rows"), 8).alias("unique_ratio"))
)
_PAIRS = [(a, b) for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]]


def _correlations(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    found = selection.correlation_filter(_selection(spark, sf_dir), _NUMERIC, method=method).correlation_pairs
    return _rounded(spark.createDataFrame([(r["left"], r["right"], r["correlation"]) for r in found], "left string, right string, correlation double"), 8)


query("sel_corr_pearson", _SEL + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 8) AS correlation FROM t" for a, b in _PAIRS))(lambda s, d: _correlations(s, d, "pearson"))
_RANKS = ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in _NUMERIC)


@query("sel_corr_spearman", f"{_SEL}, r AS (SELECT {_RANKS} FROM t) " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 8) AS correlation FROM r" for a, b in _PAIRS))
def _spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlations(spark, sf_dir, "spearman")


_CELLS = "(SELECT {f} AS x, target AS y, count(*) AS n FROM t GROUP BY ALL)"
_MARGINS = f"(SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS a FROM {_CELLS})"
query("sel_chi2_codes", _each(["code", "flat"], f"SELECT '{{f}}' AS feature, round(greatest(max(a) * (sum(n * n / (nx * ny)) - 1), 0), 5) AS statistic, (SELECT (count(DISTINCT {{f}}) - 1) * (count(DISTINCT target) - 1) FROM t) AS degrees FROM {_MARGINS}"))(lambda s, d: _rounded(selection.chi_square_table(_selection(s, d), "target", ["code", "flat"]).select("feature", "statistic", "degrees"), 5))
query("sel_chi2_counts", _each(["code", "quantity", "flat"], "SELECT '{f}' AS feature, round(sum((s - e) * (s - e) / nullif(e, 0)), 5) AS statistic FROM (SELECT s, n / sum(n) OVER () * sum(s) OVER () AS e FROM (SELECT sum({f}) AS s, count(*) AS n FROM t GROUP BY target))"))(lambda s, d: _rounded(selection.chi_square_counts_table(_selection(s, d), "target", ["code", "quantity", "flat"]).select("feature", "statistic"), 5))
query("sel_mi_discrete", _each(["code", "quantity"], f"SELECT '{{f}}' AS feature, round(sum(n / a * ln(n * a / (nx * ny))), 8) AS mutual_information FROM {_MARGINS}"))(lambda s, d: _rounded(selection.mutual_information_table(_selection(s, d), "target", ["code", "quantity"], {}), 8))

_EDGES = "(SELECT list_sort(list_distinct(quantile_disc({f}, [0.2, 0.4, 0.6, 0.8]))) FROM t)"
_BINNED = f"(SELECT len(list_filter({_EDGES}, lambda e: e < {{f}})) AS x, target AS y, count(*) AS n FROM t GROUP BY ALL)"
query("sel_mi_binned", _each(["price", "tax"], f"SELECT '{{f}}' AS feature, round(sum(n / a * ln(n * a / (nx * ny))), 8) AS mutual_information FROM {_MARGINS.replace(_CELLS, _BINNED)}"))(
    lambda s, d: _rounded(selection.mutual_information_table(x := _selection(s, d), "target", ["price", "tax"], selection.quantile_edges(x, ["price", "tax"], 5, 0.0)), 8)
)
query("sel_anova", _each(_NUMERIC, "SELECT '{f}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f_statistic FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS g FROM (SELECT count(*) AS n, avg({f}) AS m, var_pop({f}) AS v FROM t GROUP BY target))"))(
    lambda s, d: selection.anova_table(_selection(s, d), "target", _NUMERIC).select("feature", F.round((F.col("ssb") / (F.col("classes") - 1)) / (F.col("ssw") / (F.col("rows") - F.col("classes"))), 6).alias("f_statistic"))
)

_CLASSES = "SELECT l.l_returnflag AS class, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem l"
_BETWEEN = """SELECT '{f}' AS feature, round(sum(n * (m - g) * (m - g)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) AS f_statistic
 FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS g FROM (SELECT count(*) AS n, avg({f}) AS m, var_pop({f}) AS v FROM c GROUP BY class))"""


@query("sel_anova_classes", f"WITH c AS ({_CLASSES}) " + " UNION ALL ".join(_BETWEEN.replace("{f}", f) for f in _NUMERIC))
def _anova_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F of the means of three classes, as the selector gives it."""
    found = selection.anova(view(spark, sf_dir, _CLASSES), "class", _NUMERIC, max_p_value=None).feature_table
    return _rounded(spark.createDataFrame([(r["feature"], r["f_statistic"]) for r in found], "feature string, f_statistic double"))


def _iv_sql(feature: str, code: str, details: bool) -> str:
    bins = f"""SELECT bin, e, o, (e + 0.5) / (sum(e) OVER () + 0.5 * count(*) OVER ()) AS de, (o + 0.5) / (sum(o) OVER () + 0.5 * count(*) OVER ()) AS dn
 FROM (SELECT {code} AS bin, CAST(sum(target) AS DOUBLE) AS e, CAST(count(*) - sum(target) AS DOUBLE) AS o FROM t GROUP BY 1)"""
    if details:
        return f"SELECT '{feature}' AS feature, bin, e AS event_count, o AS non_event_count, round(de, 8) AS distribution_event, round(dn, 8) AS distribution_non_event, round(ln(de / dn), 6) AS woe, round((de - dn) * ln(de / dn), 8) AS iv_component, bin IS NULL AS is_missing FROM ({bins})"
    return f"SELECT '{feature}' AS feature, round(sum((de - dn) * ln(de / dn)), 6) AS iv FROM ({bins})"


def _numeric_bin(f: str) -> str:
    return f"CASE WHEN {f} IS NOT NULL THEN CAST(len(list_filter({_EDGES.replace('{f}', f)}, lambda e: e < {f})) AS VARCHAR) END"


def _iv(spark: SparkSession, sf_dir: str, features: list[str], numeric: list[str], details: bool = False) -> DataFrame:
    data = _selection(spark, sf_dir)
    bins = selection.iv_bins(data, "target", features, selection.quantile_edges(data, numeric, 5, 0.0))
    if details:
        return bins.withColumns({c: F.round(c, p) for c, p in (("distribution_event", 8), ("distribution_non_event", 8), ("woe", 6), ("iv_component", 8))})
    return _rounded(bins.groupBy("feature").agg(F.sum("iv_component").alias("iv")))


query("sel_iv_numeric", _SEL + " UNION ALL ".join(_iv_sql(f, _numeric_bin(f), False) for f in ("sparse", "price")))(lambda s, d: _iv(s, d, ["sparse", "price"], ["sparse", "price"]))
query("sel_iv_categorical", _SEL + _iv_sql("status", "status", False))(lambda s, d: _iv(s, d, ["status"], []))
query("iv_bin_details", _SEL + _iv_sql("sparse", _numeric_bin("sparse"), True) + " UNION ALL " + _iv_sql("status", "status", True))(lambda s, d: _iv(s, d, ["sparse", "status"], ["sparse"], True))


# Folds, models and simulators.


def _folded(spark: SparkSession, sf_dir: str, strategy: str, **options) -> DataFrame:
    rows = view(spark, sf_dir, f"SELECT id, target, o_orderdate AS day FROM ({tables.SCORED.replace('SELECT ', 'SELECT o_orderdate, ', 1)})")
    return modelling.with_folds(rows, "target", 4, strategy, **options)


_ORDERED = f"SELECT id, target, row_number() OVER (ORDER BY o_orderdate, id) - 1 AS k, count(*) OVER () AS n FROM ({tables.SCORED.replace('SELECT ', 'SELECT o_orderdate, ', 1)})"
query("folds_time_blocks", f"SELECT id, CAST(k * 4 // n AS INT) AS fold FROM ({_ORDERED})")(lambda s, d: _folded(s, d, "time_series", date_col="day", order_cols=["id"]).select("id", "fold"))
query("folds_expanding", f"SELECT CAST(k * 4 // n AS INT) AS fold, count(*) AS rows_in, CAST(sum(target) AS BIGINT) AS events FROM ({_ORDERED}) GROUP BY 1")(lambda s, d: _folded(s, d, "expanding", date_col="day", order_cols=["id"]).groupBy("fold").agg(F.count("*").alias("rows_in"), F.sum("target").alias("events")))
query("folds_stratified_counts", f"SELECT CAST((row_number() OVER (PARTITION BY target ORDER BY id) - 1) % 4 AS INT) AS fold, target, count(*) OVER (PARTITION BY target) AS n FROM ({tables.SCORED})".join(("SELECT fold, target, count(*) AS rows_in FROM (", ") GROUP BY fold, target")))(lambda s, d: _folded(s, d, "stratified").groupBy("fold", "target").agg(F.count("*").alias("rows_in")))
query("folds_group", f"SELECT seg, CAST(1 AS BIGINT) AS folds, count(*) AS rows_in, true AS in_range FROM ({tables.SCORED}) GROUP BY seg")(
    lambda s, d: modelling.with_folds(_scored(s, d), "target", 4, "group", group_col="seg").groupBy("seg").agg(F.count_distinct("fold").alias("folds"), F.count("*").alias("rows_in"), F.every(F.col("fold").between(0, 3)).alias("in_range"))
)


def _round_rows(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    """How many rows train and are measured in each round, and the sums of their ids."""
    folded = _folded(spark, sf_dir, "time_series", date_col="day", order_cols=["id"])
    return modelling.in_rounds(folded, 4, strategy).groupBy("round", "side").agg(F.count("*").alias("rows_in"), F.sum("id").alias("ids"))


def _rounds_sql(train: str, first: int) -> str:
    return f"WITH f AS (SELECT id, CAST(k * 4 // n AS INT) AS fold FROM ({_ORDERED})), r AS (SELECT CAST(i AS INT) AS round FROM range({first}, 4) x(i)) SELECT round, CASE WHEN fold = round THEN 'held' ELSE 'train' END AS side, count(*) AS rows_in, CAST(sum(id) AS BIGINT) AS ids FROM r JOIN f ON fold = round OR {train} GROUP BY ALL"


query("cv_rounds_expanding", _rounds_sql("fold < round", 1))(lambda s, d: _round_rows(s, d, "expanding"))
query("cv_rounds_other_folds", _rounds_sql("fold <> round", 0))(lambda s, d: _round_rows(s, d, "time_series"))
query("folds_fold_col", f"SELECT id, CAST(id % 4 AS INT) AS fold FROM ({tables.SCORED})")(lambda s, d: modelling.with_folds(_scored(s, d).withColumn("part", F.col("id") % 4), "target", 4, fold_col="part").select("id", "fold"))


def _rows(spark: SparkSession, table: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r.values()) for r in table], schema)


# With one yes-or-no feature a logistic regression is saturated: its score is the share of events among rows that are alike.
_YES_NO = "SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS DOUBLE) AS x, CAST(CASE WHEN l_returnflag = 'R' OR l_quantity > 45 THEN 1 ELSE 0 END AS INT) AS target, CAST(l_orderkey % 2 AS INT) AS part FROM lineitem"
_EXACTLY = {"maxIter": 100, "tol": 1e-10}


@query("train_logistic", f"SELECT x, count(*) AS rows_in, round(avg(target), 4) AS low, round(avg(target), 4) AS high FROM ({_YES_NO}) GROUP BY x")
def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a logistic regression for all rows, by the one feature."""
    data = view(spark, sf_dir, _YES_NO)
    found = modelling.scored(modelling.fitted(data, "target", ["x"], "logistic_regression", _EXACTLY), data)
    return found.groupBy("x").agg(F.count("*").alias("rows_in"), F.round(F.min("score"), 4).alias("low"), F.round(F.max("score"), 4).alias("high"))


_CV = f"""WITH t AS ({_YES_NO}), r AS (SELECT f.part, x, avg(target) AS rate FROM t, (SELECT DISTINCT part FROM t) f WHERE t.part <> f.part GROUP BY f.part, x),
 c AS (SELECT part, tile, count(*) AS n, CAST(sum(target) AS BIGINT) AS e FROM (SELECT t.part, target, ntile(10) OVER (PARTITION BY t.part ORDER BY rate DESC, target) AS tile FROM t JOIN r ON r.part = t.part AND r.x = t.x) GROUP BY part, tile),
 m AS (SELECT part, round(max(abs(tpr - fpr)), 5) AS ks, round(sum(dn * (2 * tpr - de) / 2), 5) AS auc FROM ({_points_sql('SELECT * FROM c', 'part')}) GROUP BY part),
 v AS (SELECT 'KS' AS metric, ks AS v FROM m UNION ALL SELECT 'AUC', auc FROM m UNION ALL SELECT 'GINI', round(2 * auc - 1, 5) FROM m)
 SELECT metric, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS std, round(min(v), 3) AS min, round(max(v), 3) AS max FROM v GROUP BY metric"""


@query("cv_logistic", _CV)
def _cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation by a fold column; of rows that score alike the events come last, which makes the tiles definite."""
    found = modelling.cross_validate(view(spark, sf_dir, _YES_NO), "target", ["x"], "logistic_regression", _EXACTLY, 2, fold_col="part")
    return _rounded(_rows(spark, found.summary, "metric string, mean double, std double, min double, max double"), 3)


# One feature tells the target, the other is constant: every search must keep the first and only that.
_PLAIN = f"SELECT id, target, target + CAST(id % 7 AS DOUBLE) / 100 AS signal, CAST(1 AS DOUBLE) AS flat, CAST(id % 2 AS INT) AS fold FROM ({tables.SCORED})"
_KEPT = "SELECT 'signal' AS feature, true AS selected UNION ALL SELECT 'flat', false"
_TWO = ["signal", "flat"]
_FAST = {"model": "logistic_regression", "model_params": {"maxIter": 5}}


def _searched(name: str, run: Callable[[DataFrame], list[str]]) -> None:
    """Registers a search: which of the two features it keeps, over the whole table."""

    def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = set(run(view(spark, sf_dir, _PLAIN)))
        return spark.createDataFrame([(f, f in chosen) for f in _TWO], "feature string, selected boolean")

    query(name, _KEPT)(kept)


_searched("sel_l1", lambda x: search.l1_selection(x, "target", _TWO, reg_param=0.01, max_iter=10).selected_features)
_searched("sel_importance", lambda x: search.feature_importance_selection(x, "target", _TWO, model_params={"numTrees": 5}, top_k=1).selected_features)
_searched("sel_permutation", lambda x: search.permutation_importance_selection(modelling.fitted(x, "target", _TWO, **_FAST_FIT), x, "target", _TWO, n_repeats=2, threshold=0.1).selected_features)
_searched("sel_rfe", lambda x: _eliminated(x))
_searched("sel_rfecv", lambda x: search.rfecv(x, "target", _TWO, cv=2, fold_col="fold", **_FAST).selected_features)
_searched("sel_sequential", lambda x: search.sequential_selection(x, "target", _TWO, cv=2, fold_col="fold", **_FAST).selected_features)
_searched("sel_stability", lambda x: search.stability_selection(x, "target", _TWO, method="l1", n_iterations=2, selector_kwargs={"reg_param": 0.01, "max_iter": 5}).selected_features)
_searched("sel_boruta", lambda x: search.boruta(x, "target", _TWO, n_estimators=3, max_iter=8).selected_features)
_FAST_FIT = {"model": "logistic_regression", "params": {"maxIter": 5}}


def _eliminated(rows: DataFrame) -> list[str]:
    with tempfile.TemporaryDirectory(prefix="riskloom-") as folder:
        return search.rfe("rfe", "target", rows, rows, _TWO, output_dir=folder, **_FAST).selected_features


@query("synth_credit", f"SELECT count(*) AS rows_in, true AS dates_inside, true AS flags, CAST(20 AS BIGINT) AS features, true AS finite FROM ({tables.SCORED})")
def _credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for the whole simulated table: as many rows as asked for, days after the anchor, flags, finite features."""
    count = view(spark, sf_dir, tables.SCORED).count()
    rows, names = synthetic.simulate_credit_data(spark, row_count=count, anchor_date=date(2024, 1, 1))
    finite = functools.reduce(Column.__and__, [F.col(n).isNotNull() & (F.abs(n) < 10) for n in names])
    return rows.agg(F.count("*").alias("rows_in"), F.every(F.col("reference_date").between("2024-01-02", "2024-01-31")).alias("dates_inside"), F.every(F.col("default_flag").isin(0, 1)).alias("flags"), F.lit(len(names)).cast("long").alias("features"), F.every(finite).alias("finite"))


@query("synth_bureau", f"SELECT count(*) AS customers, true AS month_ends, true AS in_range, true AS one_a_month, true AS mostly_whole FROM (SELECT DISTINCT id FROM ({tables.SPINE}))")
def _bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for the whole simulated history: every customer, month ends, scores in range, one row a month at most."""
    people = view(spark, sf_dir, tables.SPINE).select("id")
    rows = synthetic.simulate_bureau_history(people, "id", "2022-01-31", "2023-12-31")
    day, score = (c for c in rows.columns if c != "id")
    one = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct(day).alias("days"), F.every(F.col(day) == F.last_day(day)).alias("ends"), F.every(F.col(score).between(0, 1000)).alias("inside"))
    return one.agg(F.count("*").alias("customers"), F.every("ends").alias("month_ends"), F.every("inside").alias("in_range"), F.every(F.col("n") == F.col("days")).alias("one_a_month"), (F.avg((F.col("n") == 24).cast("double")) > 0.5).alias("mostly_whole"))


# Many columns, and sketches.

#: Columns of the wide table; the later half repeats the first but for a little noise.
_WIDE = 280
_WIDE_ROWS = f"""WITH k AS (SELECT unnest(range(1, {_WIDE} + 1)) AS k), b AS (SELECT k, (k - 1) % {_WIDE // 2} + 1 AS b FROM k),
 l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem),
 x AS (SELECT k, list(CAST((l_orderkey * b * b + l_linenumber * ((b * b) % 97)) % (101 + b) + CASE WHEN k > b THEN l_partkey % 7 ELSE 0 END AS DOUBLE) ORDER BY l_orderkey, l_linenumber, l_partkey) AS v FROM l, b GROUP BY k),
 m AS (SELECT k, v, len(v) AS n, list_sum(v) AS s, list_inner_product(v, v) AS q FROM x)"""
_WIDE_CORR = "(a.n * list_inner_product(a.v, c.v) - a.s * c.s) / (sqrt(a.n * a.q - a.s * a.s) * sqrt(c.n * c.q - c.s * c.s))"


@query("sel_corr_wide", f"""{_WIDE_ROWS} SELECT concat('f', a.k) AS "left", concat('f', c.k) AS "right", round({_WIDE_CORR}, 6) AS correlation
 FROM m a JOIN m c ON a.k < c.k WHERE abs({_WIDE_CORR}) >= 0.9""")
def _corr_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of 280 columns that correlate at least 0.9 in size."""
    half = _WIDE // 2
    names = [f"f{k}" for k in range(1, _WIDE + 1)]
    columns = []
    for k, name in enumerate(names, 1):
        b = (k - 1) % half + 1
        noise = "l_partkey % 7" if k > half else "0"
        columns.append(F.expr(f"(l_orderkey * {b * b} + l_linenumber * {b * b % 97}) % {101 + b} + {noise}").cast("double").alias(name))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns)
    pairs = wide.correlation_table(wide.gram(rows, names), names)
    return pairs.where(~F.isnan("correlation") & (F.abs("correlation") >= 0.9)).select("left", "right", F.round("correlation", 6).alias("correlation"))


_SKETCHED = ("l_quantity", "l_discount", "l_extendedprice")
_MONTH_OF = "strftime(l_shipdate, '%Y%m')"


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.monthly_sketches(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", [*_SKETCHED, "l_returnflag"])


@query("pv_sketch_years", " UNION ALL ".join(
    f"""SELECT left({_MONTH_OF}, 4) AS "year", '{c}' AS "column", count(*) AS "rows", count({c}) AS present, round({low}, 2) AS lowest, round({high}, 2) AS highest, {kinds} AS kinds
 FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1"""
    for c, low, high, kinds in [
        ("l_quantity", "min(l_quantity)", "max(l_quantity)", "count(DISTINCT l_quantity)"),
        ("l_discount", "min(l_discount)", "max(l_discount)", "count(DISTINCT l_discount)"),
        ("l_extendedprice", "min(l_extendedprice)", "max(l_extendedprice)", "CAST(NULL AS BIGINT)"),
        ("l_returnflag", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "count(DISTINCT l_returnflag)"),
    ]))
def _sketch_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months merged to years: what the sketches hold exactly (counts, ends, few kinds); prices have too many kinds for that."""
    years = sketches.merged(_sketched(spark, sf_dir).withColumn("year", F.left("cohort", F.lit(4))), ["year"])
    kinds = F.when(F.col("column") != "l_extendedprice", sketches.distinct())
    return years.select("year", "column", "rows", "present", F.round(sketches.quantile(0), 2).alias("lowest"), F.round(sketches.quantile(1), 2).alias("highest"), kinds.alias("kinds"))


@query("pv_sketch_deciles", f"""SELECT {_MONTH_OF} AS cohort, CAST(i AS INT) AS decile, count(*) AS present, true AS within_bound
 FROM lineitem, range(1, 10) r(i) WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1, 2""")
def _sketch_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's deciles of the price: are their ranks among the month's rows, counted exactly, within the stated error?"""
    months = _sketched(spark, sf_dir).where("column = 'l_extendedprice'")
    cuts = F.explode(F.array(*[F.struct(F.lit(i).alias("decile"), sketches.quantile(i / 10).alias("cut")) for i in range(1, 10)]))
    deciles = months.select("cohort", cuts.alias("x")).select("cohort", "x.*")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.date_format("l_shipdate", "yyyyMM").alias("cohort"), F.col("l_extendedprice").cast("double").alias("v")).where("v is not null")
    counts = rows.join(F.broadcast(deciles), "cohort").groupBy("cohort", "decile").agg(F.count("*").alias("present"), F.count_if(F.col("v") < F.col("cut")).alias("below"), F.count_if(F.col("v") <= F.col("cut")).alias("up_to"))
    share, bound = F.col("decile") / 10, sketches.rank_error()
    inside = share.between(F.col("below") / F.col("present") - bound, F.col("up_to") / F.col("present") + bound)
    return counts.select("cohort", "decile", "present", inside.alias("within_bound"))


# Nearest-neighbour information.

_CENTS = """SELECT CAST(l_linestatus = 'F' AS INT) + CAST(l_discount > 0.05 AS INT) AS y, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS quantity,
 CAST(round(l_discount * 100) AS BIGINT) * 1000003 + l_partkey AS mixed FROM lineitem"""
_NEAR = ["price", "quantity", "mixed"]


def _digamma_sql(n: str) -> str:
    z = f"({n} + 8.0)"
    steps = " - ".join(f"1.0 / ({n} + {i}.0)" for i in range(8))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} * {z}) + 1 / (120 * pow({z}, 4)) - 1 / (252 * pow({z}, 6)) - {steps})"


def _neighbours_sql(feature: str) -> str:
    """Third neighbours by lag and lead inside the class, then a range frame over all rows; whole numbers, so less than d is at most d - 1."""
    far, order = "4000000000000000", "OVER (PARTITION BY y ORDER BY v)"
    left = lambda j: f"v - lag(v, {j}, -{far}) {order}" if j else "0"
    right = lambda j: f"lead(v, {j}, {far}) {order} - v" if j else "0"
    third = "least(" + ", ".join(f"greatest({left(j)}, {right(3 - j)})" for j in range(4)) + ")"
    inner = f"SELECT y, v, {third} AS d, count(*) OVER (PARTITION BY y) AS c FROM (SELECT y, {feature} AS v FROM x)"
    counted = f"SELECT *, count(*) OVER (ORDER BY v RANGE BETWEEN greatest(d - 1, 0) PRECEDING AND greatest(d - 1, 0) FOLLOWING) AS m FROM ({inner})"
    total = f"{_digamma_sql('count(*)')} + {_digamma_sql('3')} - avg({_digamma_sql('c')}) - avg({_digamma_sql('m')})"
    return f"SELECT '{feature}' AS feature, round(greatest({total}, 0), 7) AS mutual_information FROM ({counted})"


@query("sel_mi_neighbours", f"WITH x AS ({_CENTS}) " + " UNION ALL ".join(map(_neighbours_sql, _NEAR)))
def _mi_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information with a target of three classes by third neighbours; values are whole numbers, so that both sides count alike."""
    return _rounded(selection.neighbour_information_table(view(spark, sf_dir, _CENTS), "y", _NEAR, 3), 7)
