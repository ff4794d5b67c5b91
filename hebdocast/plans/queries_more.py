"""Registered queries: high-volume tier, country drill-down, metrics, backtest,
assembly, report tables and raw-data profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import (CATEGORICAL_MODE_COLUMNS, HIGH_VOLUME, MODEL_CATEGORICAL_COLUMNS,
                      NUMERIC_FEATURE_COLUMNS, REQUIRED_COLUMNS, SBA, SEASONAL_NAIVE, SPARSE)
from ..operators import (assemble, clean, country, profile, regression, report, scope, scoring)
from ..operators import features as feats
from . import oracle as O
from .queries_core import flow
from .registry import register

b = O.build
P = O.P
q = O.q
FEAT_SQL_COLS = O.FEATURED_COLS


# --- 2.8 high-volume tier ---------------------------------------------------------
@register("hv_frame", b(f"SELECT {FEAT_SQL_COLS} FROM hv", "hv"))
def hv_frame(spark, sf):
    f = flow(spark, sf)
    return f.hv.select(*feats.featured_columns(f.params))


@register("cat_dictionary", b("SELECT * FROM cat_dictionary", "cat_dictionary"))
def cat_dictionary(spark, sf):
    return flow(spark, sf).cat_dictionary


_CODE_SQL = ", ".join(f'd{i}.code AS "{c}_code"' for i, c in enumerate(MODEL_CATEGORICAL_COLUMNS))
_CODE_JOIN = " ".join(
    f"LEFT JOIN cat_dictionary d{i} ON d{i}.column_name = '{c}' AND d{i}.value = CAST(h.{q(c)} AS VARCHAR)"
    for i, c in enumerate(MODEL_CATEGORICAL_COLUMNS))


@register("cat_encoded", b(f'SELECT h."ProductID", h."WeekStart", {_CODE_SQL} FROM hv h {_CODE_JOIN}',
                           "hv", "cat_dictionary"))
def cat_encoded(spark, sf):
    f = flow(spark, sf)
    return f.hv_coded(MODEL_CATEGORICAL_COLUMNS).select(
        "ProductID", "WeekStart", *[f"{c}_code" for c in MODEL_CATEGORICAL_COLUMNS])


@register("hv_split", b("""SELECT
  (SELECT count(*) FROM hv, cut WHERE "WeekStart" <= cut.train_end) AS train_rows,
  (SELECT count(*) FROM hv, cut WHERE "WeekStart" >= cut.valid_start AND "WeekStart" <= cut.valid_end)
    AS valid_rows""", "hv", "cut"))
def hv_split(spark, sf):
    f = flow(spark, sf)
    c = f.cutoffs
    return f.hv.agg(
        F.count_if(F.col("WeekStart") <= F.lit(c.train_end)).alias("train_rows"),
        F.count_if((F.col("WeekStart") >= F.lit(c.valid_start))
                   & (F.col("WeekStart") <= F.lit(c.valid_end))).alias("valid_rows"))


@register("hv_seasonal_naive_valid", b("SELECT * FROM hv_valid_sn", "hv_valid_sn"))
def hv_seasonal_naive_valid(spark, sf):
    return flow(spark, sf).hv_seasonal_valid


@register("hv_state", b("SELECT * FROM hv_state", "hv_state"))
def hv_state(spark, sf):
    return (flow(spark, sf).hv_state
            .select("ProductID", F.posexplode("history").alias("_i", "value"))
            .select("ProductID", (F.col("_i") + 1).cast("long").alias("slot"), "value"))


_STEP_LAGS = ", ".join(
    f'max(CASE WHEN slot = {13 - k} THEN value END) AS "Sales_Qty_lag_{k}"' for k in P.lags)
_STEP_ROLL = ", ".join(
    f'avg(CASE WHEN slot > {12 - w} THEN value END) AS "Sales_Qty_rollmean_{w}", '
    f'stddev_samp(CASE WHEN slot > {12 - w} THEN value END) AS "Sales_Qty_rollstd_{w}"'
    for w in P.windows)


@register("hv_step_features", b(f"""SELECT s."ProductID", any_value(c.origin) AS "WeekStart",
  {_STEP_LAGS}, {_STEP_ROLL},
  CAST(month(any_value(c.origin)) AS BIGINT) AS month,
  CAST((dayofmonth(any_value(c.origin)) - 1) // 7 + 1 AS BIGINT) AS week_of_month,
  CAST(quarter(any_value(c.origin)) AS BIGINT) AS quarter,
  CAST(weekofyear(any_value(c.origin)) AS BIGINT) AS week_of_year,
  CAST(month(any_value(c.origin)) IN (11, 12) AS BIGINT) AS is_year_end,
  CAST(any_value(c.origin) IN (SELECT hw FROM holiday_weeks) AS BIGINT) AS is_lk_holiday_week
FROM hv_state s CROSS JOIN cut c GROUP BY s."ProductID\"""", "hv_state", "cut", "holiday_weeks"))
def hv_step_features(spark, sf):
    f = flow(spark, sf)
    cols = (["ProductID", "WeekStart"] + [feats.lag_name(k) for k in f.params.lags]
            + [f"Sales_Qty_roll{s}_{w}" for w in f.params.windows for s in ("mean", "std")]
            + ["month", "week_of_month", "quarter", "week_of_year", "is_year_end",
               "is_lk_holiday_week"])
    return regression.step_features(f.hv_state, f.cutoffs.origin, f.holiday_week_list,
                                    f.params).select(*cols)


@register("hv_seasonal_naive_forecast", b("SELECT * FROM hv_snf", "hv_snf"))
def hv_seasonal_naive_forecast(spark, sf):
    return flow(spark, sf).hv_seasonal_forecast


def _gbt_valid(name):
    def fn(spark, sf):
        return flow(spark, sf, "hv_modes", "hv_weekly").hv_tree_valid(name)
    return fn


def _gbt_forecast(name):
    def fn(spark, sf):
        return flow(spark, sf, "hv_modes", "hv_weekly").hv_tree_forecast(name)
    return fn


register("hv_gbt_valid")(_gbt_valid("gbt"))
register("hv_gbt_deep_valid")(_gbt_valid("gbt_deep"))
register("hv_gbt_forecast")(_gbt_forecast("gbt"))
register("hv_gbt_deep_forecast")(_gbt_forecast("gbt_deep"))


@register("hv_forecast_violations")
def hv_forecast_violations(spark, sf):
    f = flow(spark, sf, "hv_modes", "hv_weekly")
    return regression.forecast_violations(f.hv_forecast, f.hv_ids, f.params.horizon)


# --- 2.9 country drill-down -------------------------------------------------------
@register("country_fanout", b(f"""SELECT CAST(max(n) AS BIGINT) AS max_distinct_countries,
  count(*) FILTER (WHERE n > 2) AS products_over_limit
FROM (SELECT "ProductID", count(DISTINCT "Country") AS n FROM scoped GROUP BY 1) t""", "scoped"))
def country_fanout(spark, sf):
    f = flow(spark, sf)
    return country.country_fanout(f.scoped, 2)


@register("country_weekly", b("SELECT * FROM country_weekly", "country_weekly"))
def country_weekly(spark, sf):
    return country.country_weekly(flow(spark, sf).scoped)


@register("country_level", b("SELECT * FROM country_level", "country_level"))
def country_level(spark, sf):
    f = flow(spark, sf)
    return country.country_level(country.country_weekly(f.scoped), f.params.country_window)


@register("country_forecast", b("SELECT * FROM country_forecast", "country_forecast"))
def country_forecast(spark, sf):
    f = flow(spark, sf)
    lv = country.country_level(country.country_weekly(f.scoped), f.params.country_window)
    return country.country_forecast(lv, f.cutoffs.origin, f.params.horizon, f.params.country_window)


@register("country_violations", b(f"""SELECT "ProductID", "Country", 'pair' AS violation
FROM country_forecast GROUP BY 1, 2
HAVING count(*) <> {P.horizon} OR min("predicted_Sales_Qty") < 0""", "country_forecast"))
def country_violations(spark, sf):
    f = flow(spark, sf)
    lv = country.country_level(country.country_weekly(f.scoped), f.params.country_window)
    fc = country.country_forecast(lv, f.cutoffs.origin, f.params.horizon, f.params.country_window)
    return country.country_violations(fc, f.params.horizon)


# --- 2.10 metrics, backtest, assembly -----------------------------------------------
def _scored_all(f):
    hv = f.hv_seasonal_valid.select(F.lit(HIGH_VOLUME).alias("tier"), "model",
                                    F.col("y_true").alias("y"), "y_pred")
    sp = f.sparse_validation.where(F.col("y").isNotNull()).select(
        F.lit(SPARSE).alias("tier"), "model", "y", "y_pred")
    return hv.unionByName(sp)


def _metric(name, sql_expr):
    sql = b(f"SELECT tier, model, {sql_expr} AS {name} FROM scored_all GROUP BY tier, model",
            "scored_all")

    def fn(spark, sf):
        t = scoring.metric_table(_scored_all(flow(spark, sf)), "y", "y_pred", ("tier", "model"))
        return t.select("tier", "model", name)
    register(f"metric_{name}", sql)(fn)


_metric("rmse", "sqrt(avg(power(y - y_pred, 2)))")
_metric("mae", "avg(abs(y - y_pred))")
_metric("wmape", "coalesce(sum(abs(y - y_pred)) / nullif(sum(abs(y)), 0), 0)::DOUBLE")


@register("metric_mase", b("SELECT * FROM s_mase", "s_mase"))
def metric_mase(spark, sf):
    f = flow(spark, sf)
    hist = scoring.train_history(f.sparse_long, f.cutoffs.train_end)
    return scoring.mase_per_series(f.sparse_validation, hist)


@register("score_sparse", b("SELECT * FROM score_sparse", "score_sparse"))
def score_sparse(spark, sf):
    f = flow(spark, sf)
    hist = scoring.train_history(f.sparse_long, f.cutoffs.train_end)
    return scoring.score_sparse(f.sparse_validation, hist)


@register("score_high_volume")
def score_high_volume(spark, sf):
    f = flow(spark, sf, "hv_modes", "hv_weekly")
    timings = f.hv_timings()  # all fits side by side
    return scoring.with_timings(scoring.score_high_volume(f.hv_validation), timings)


@register("model_comparison")
def model_comparison(spark, sf):
    f = flow(spark, sf, "hv_modes", "hv_weekly")
    hist = scoring.train_history(f.sparse_long, f.cutoffs.train_end)
    timings = f.hv_timings()
    hv = scoring.with_timings(scoring.score_high_volume(f.hv_validation), timings)
    sparse = scoring.with_timings(scoring.score_sparse(f.sparse_validation, hist), f.sparse_timings())
    return scoring.model_comparison(hv, sparse)


@register("baseline_check", b("""SELECT 'sparse' AS tier, 'wmape' AS metric,
  (SELECT min(model) FROM score_sparse WHERE is_baseline) AS baseline_model,
  (SELECT min(wmape) FROM score_sparse WHERE is_baseline) AS baseline_value,
  (SELECT model FROM score_sparse WHERE NOT is_baseline ORDER BY wmape, model LIMIT 1) AS best_model,
  (SELECT min(wmape) FROM score_sparse WHERE NOT is_baseline) AS best_value,
  (SELECT min(wmape) FROM score_sparse WHERE NOT is_baseline)
    < (SELECT min(wmape) FROM score_sparse WHERE is_baseline) AS beats_baseline""", "score_sparse"))
def baseline_check(spark, sf):
    f = flow(spark, sf)
    hist = scoring.train_history(f.sparse_long, f.cutoffs.train_end)
    comp = scoring.model_comparison(scoring.score_high_volume(f.hv_seasonal_valid),
                                    scoring.score_sparse(f.sparse_validation, hist))
    return scoring.baseline_check(comp, SPARSE, "wmape")


@register("baseline_check_all")
def baseline_check_all(spark, sf):
    f = flow(spark, sf, "hv_modes", "hv_weekly")
    hist = scoring.train_history(f.sparse_long, f.cutoffs.train_end)
    timings = f.hv_timings()
    hv = scoring.with_timings(scoring.score_high_volume(f.hv_validation), timings)
    comp = scoring.model_comparison(hv, scoring.score_sparse(f.sparse_validation, hist))
    return scoring.baseline_check(comp, HIGH_VOLUME, "rmse").unionByName(
        scoring.baseline_check(comp, SPARSE, "wmape"))


@register("select_hv", b("SELECT * FROM sel_hv", "sel_hv"))
def select_hv(spark, sf):
    return assemble.select_high_volume(flow(spark, sf).hv_seasonal_forecast, SEASONAL_NAIVE)


@register("select_sparse", b("SELECT * FROM sel_sparse", "sel_sparse"))
def select_sparse(spark, sf):
    f = flow(spark, sf)
    return assemble.select_sparse(f.sparse_forecast, f.params.sparse_model_choice)


def _assembled(f, hv_model=SEASONAL_NAIVE):
    hv_src = f.hv_seasonal_forecast if hv_model == SEASONAL_NAIVE else f.hv_forecast
    return assemble.assemble(assemble.select_high_volume(hv_src, hv_model),
                             assemble.select_sparse(f.sparse_forecast, f.params.sparse_model_choice))


@register("forecast_12wk", b("SELECT * FROM forecast_12wk", "forecast_12wk"))
def forecast_12wk(spark, sf):
    return _assembled(flow(spark, sf))


@register("forecast_12wk_gbt")
def forecast_12wk_gbt(spark, sf):
    f = flow(spark, sf, "hv_modes", "hv_weekly")
    return assemble.sorted_for_sink(_assembled(f, f.params.hv_model_choice))


@register("forecast_violations", b(f"""SELECT "ProductID", 'missing' AS violation FROM tiers
WHERE "ProductID" NOT IN (SELECT "ProductID" FROM forecast_12wk)
UNION ALL SELECT "ProductID", 'row_count' FROM forecast_12wk GROUP BY 1 HAVING count(*) <> {P.horizon}
UNION ALL SELECT "ProductID", 'negative' FROM forecast_12wk WHERE "predicted_Sales_Qty" < 0""",
                                    "forecast_12wk", "tiers"))
def forecast_violations(spark, sf):
    f = flow(spark, sf)
    return assemble.forecast_violations(_assembled(f), f.tiers, f.params.horizon)


# --- 2.11 report tables ---------------------------------------------------------------
_PAIRS = [(a, bb) for i, a in enumerate(NUMERIC_FEATURE_COLUMNS)
          for bb in NUMERIC_FEATURE_COLUMNS[i + 1:]]


def _corr_sql() -> str:
    parts = []
    for a, bb in _PAIRS:
        both = f"{q(a)} IS NOT NULL AND {q(bb)} IS NOT NULL"
        parts.append(
            f"SELECT '{a}' AS feature_a, '{bb}' AS feature_b, count(*) FILTER (WHERE {both}) AS n_pairs, "
            f"CASE WHEN var_pop({q(a)}) FILTER (WHERE {both}) > 0 AND var_pop({q(bb)}) FILTER (WHERE {both}) > 0 "
            f"THEN covar_pop({q(a)}, {q(bb)}) FILTER (WHERE {both}) / sqrt(var_pop({q(a)}) FILTER (WHERE {both}) "
            f"* var_pop({q(bb)}) FILTER (WHERE {both})) END AS corr FROM featured")
    return b("\nUNION ALL\n".join(parts), "featured")


@register("corr_matrix", _corr_sql())
def corr_matrix(spark, sf):
    return report.correlation_matrix(flow(spark, sf).featured_numeric, NUMERIC_FEATURE_COLUMNS)


@register("feature_importance")
def feature_importance(spark, sf):
    f = flow(spark, sf, "hv_modes", "hv_weekly")
    f.hv_trained  # both models side by side
    gbt, deep = (f.hv_importance(name) for name in f.hv_model_names)
    return gbt.unionByName(deep)


@register("hv_attributions")
def hv_attributions(spark, sf):
    """Every one-step validation prediction of the first model as base plus a value for each input."""
    f = flow(spark, sf, "hv_modes", "hv_weekly")
    names = F.array(*[F.lit(n) for n in f.hv_binning.names])
    return f.hv_attributions(f.hv_model_names[0]).select(
        "ProductID", "WeekStart", "base", "y_pred", F.posexplode("values").alias("_i", "value")).select(
        "ProductID", "WeekStart", F.element_at(names, F.col("_i") + 1).alias("feature"), "value", "base", "y_pred")


@register("loss_curve")
def loss_curve(spark, sf):
    f = flow(spark, sf, "hv_modes", "hv_weekly")
    rows = [(name, i + 1, float(v) ** 0.5) for name, e in f.hv_early.items() for i, v in enumerate(e.losses)]
    return spark.createDataFrame(rows, "model string, round long, valid_rmse double")


@register("actual_vs_predicted_gbt")
def actual_vs_predicted_gbt(spark, sf):
    """The high-volume product of the largest sales: boosted trees, one-step and recursive, beside the
    actual values."""
    return report.top_series(flow(spark, sf, "hv_modes", "hv_weekly").hv_validation, "ProductID", "y_true").select(
        F.lit(HIGH_VOLUME).alias("tier"), "ProductID", "WeekStart", "y_true", "y_pred", "model")


@register("actual_vs_predicted", b(f"""SELECT 'high_volume' AS tier, "ProductID", "WeekStart", y_true,
  y_pred, model FROM hv_valid_sn WHERE "ProductID" = (
    SELECT "ProductID" FROM hv_valid_sn GROUP BY 1 ORDER BY sum(y_true) DESC, "ProductID" LIMIT 1)
UNION ALL
SELECT 'sparse', unique_id, ds, y, y_pred, model FROM sparse_validation
WHERE model = '{SBA}' AND unique_id = (
    SELECT unique_id FROM sparse_validation WHERE model = '{SBA}'
    GROUP BY 1 ORDER BY sum(y) DESC NULLS LAST, unique_id LIMIT 1)""", "hv_valid_sn",
                                   "sparse_validation"))
def actual_vs_predicted(spark, sf):
    f = flow(spark, sf)
    hv = report.top_series(f.hv_seasonal_valid, "ProductID", "y_true").select(
        F.lit(HIGH_VOLUME).alias("tier"), "ProductID", "WeekStart", "y_true", "y_pred", "model")
    sp = report.top_series(f.sparse_validation.where(F.col("model") == SBA), "unique_id", "y").select(
        F.lit(SPARSE).alias("tier"), F.col("unique_id").alias("ProductID"),
        F.col("ds").alias("WeekStart"), F.col("y").alias("y_true"), "y_pred", "model")
    return hv.unionByName(sp)


_ZP = """SELECT f."ProductID", max(zero_streak_length) AS max_zero_streak,
  avg(CAST("Sales_Qty" = 0 AS DOUBLE)) AS zero_share
FROM featured f JOIN tiers t ON t."ProductID" = f."ProductID" WHERE t.tier = 'sparse'
GROUP BY f."ProductID\""""


@register("zero_profile", b(_ZP, "featured", "tiers"))
def zero_profile(spark, sf):
    f = flow(spark, sf)
    return report.zero_profile(f.featured, f.tier_ids(SPARSE))


O.cte("zp", ("featured", "tiers"), "zp AS (" + _ZP + ")")
O.cte("zl", ("zp",), """zl AS (SELECT 'max_zero_streak' AS metric, CAST(max_zero_streak AS DOUBLE) AS v FROM zp
  UNION ALL SELECT 'zero_share', zero_share FROM zp)""")
O.cte("zb", ("zl",), """zb AS (SELECT metric,
  CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
  CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM zl GROUP BY metric)""")
_NB = P.histogram_bins


@register("zero_histogram", b(f"""SELECT g.metric, CAST(g.bin AS BIGINT) AS bin,
  g.lo + g.bin * ((g.hi - g.lo) / {_NB}) AS bin_lo,
  g.lo + (g.bin + 1) * ((g.hi - g.lo) / {_NB}) AS bin_hi,
  coalesce(c.n, 0) AS count
FROM (SELECT metric, lo, hi, unnest(range(0, {_NB})) AS bin FROM zb) g
LEFT JOIN (SELECT z.metric, least(floor((z.v - zb.lo) * {_NB} / (zb.hi - zb.lo)), {_NB - 1}) AS bin,
                  count(*) AS n
           FROM zl z JOIN zb ON zb.metric = z.metric GROUP BY 1, 2) c
  ON c.metric = g.metric AND c.bin = g.bin""", "zl", "zb"))
def zero_histogram(spark, sf):
    f = flow(spark, sf)
    zp = report.zero_profile(f.featured, f.tier_ids(SPARSE)).select(
        F.col("max_zero_streak").cast("double").alias("max_zero_streak"), "zero_share")
    return report.histogram(zp, ["max_zero_streak", "zero_share"], f.params.histogram_bins)


@register("top_products", b("SELECT * FROM top_products", "top_products"))
def top_products(spark, sf):
    f = flow(spark, sf)
    return report.top_products(f.weekly_ext, f.params.top_volume_candidates)


def _eligibility(f):
    p = f.params
    return report.decomposition_eligibility(
        f.featured, report.top_products(f.weekly_ext, p.top_volume_candidates),
        p.decomposition_min_weeks, p.top_volume_target)


@register("decomp_eligible", b("SELECT * FROM decomp_eligible", "decomp_eligible"))
def decomp_eligible(spark, sf):
    return _eligibility(flow(spark, sf))


@register("seasonal_decompose", b("SELECT * FROM decomp", "decomp"))
def seasonal_decompose(spark, sf):
    f = flow(spark, sf)
    return report.seasonal_decompose(f.featured.select("ProductID", "WeekStart", "Sales_Qty"),
                                     f.params.season_length, f.params.decomposition_min_weeks)


@register("yoy", b("""SELECT f."ProductID", CAST(yearweek(f."WeekStart") // 100 AS BIGINT) AS iso_year,
  CAST(weekofyear(f."WeekStart") AS BIGINT) AS iso_week, f."Sales_Qty"
FROM featured f WHERE f."ProductID" IN (SELECT "ProductID" FROM decomp_eligible WHERE selected)""",
                   "featured", "decomp_eligible"))
def yoy(spark, sf):
    f = flow(spark, sf)
    sel = _eligibility(f).where(F.col("selected")).select("ProductID")
    return report.year_over_year(f.featured.join(F.broadcast(sel), "ProductID", "left_semi"))


def _describe_sql() -> str:
    parts = [f"""SELECT '{c}' AS column, count({q(c)}) AS count, avg({q(c)}) AS mean,
  stddev_samp({q(c)}) AS std, CAST(min({q(c)}) AS DOUBLE) AS min,
  quantile_cont({q(c)}, 0.25) AS p25, quantile_cont({q(c)}, 0.5) AS p50,
  quantile_cont({q(c)}, 0.75) AS p75, CAST(max({q(c)}) AS DOUBLE) AS max FROM featured"""
             for c in NUMERIC_FEATURE_COLUMNS]
    return b("\nUNION ALL\n".join(parts), "featured")


@register("describe_features", _describe_sql())
def describe_features(spark, sf):
    return report.describe(flow(spark, sf, "featured_numeric").featured_numeric, NUMERIC_FEATURE_COLUMNS)


# --- 2.12 profiling ---------------------------------------------------------------------
_SCHEMA_SQL = "\nUNION ALL\n".join(
    f"""SELECT CAST({i + 1} AS BIGINT) AS position, '{c}' AS column_name,
  CASE typeof(any_value({q(c)})) WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
       WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE typeof(any_value({q(c)})) END AS data_type,
  count(*) AS n_rows FROM raw""" for i, c in enumerate(REQUIRED_COLUMNS))


@register("profile_schema", b(_SCHEMA_SQL, "raw"))
def profile_schema(spark, sf):
    return profile.schema_profile(flow(spark, sf).raw)


@register("profile_dates", b("""SELECT 'Order Date' AS column_name, min("Order Date") AS min_value,
  max("Order Date") AS max_value, count(*) - count("Order Date") AS missing FROM raw
UNION ALL SELECT 'Invoice Date', min("Invoice Date"), max("Invoice Date"),
  count(*) - count("Invoice Date") FROM raw""", "raw"))
def profile_dates(spark, sf):
    return profile.date_profile(flow(spark, sf).raw)


@register("profile_value_counts", b("""SELECT 'Region' AS column_name, "Region" AS value, count(*) AS n
FROM post_artifact WHERE "Region" IS NOT NULL GROUP BY 2
UNION ALL SELECT 'Country', "Country", count(*) FROM post_artifact WHERE "Country" IS NOT NULL
GROUP BY 2""", "post_artifact"))
def profile_value_counts(spark, sf):
    return profile.value_counts(clean.drop_artifacts(flow(spark, sf).raw), ["Region", "Country"])


@register("profile_distinct", b("""SELECT
  (SELECT count(DISTINCT "Product Code") FROM raw) AS product_codes,
  (SELECT count(DISTINCT "ProductID") FROM prepared) AS product_ids,
  (SELECT count(DISTINCT "Region") FROM post_artifact) AS regions,
  (SELECT count(DISTINCT "Country") FROM post_artifact) AS countries""", "raw", "prepared",
                                "post_artifact"))
def profile_distinct(spark, sf):
    f = flow(spark, sf)
    codes = f.raw.agg(F.countDistinct("Product Code").alias("product_codes"))
    ids = f.prepared.agg(F.countDistinct("ProductID").alias("product_ids"))
    post = clean.drop_artifacts(f.raw).agg(F.countDistinct("Region").alias("regions"),
                                           F.countDistinct("Country").alias("countries"))
    return clean._one_row_pair(clean._one_row_pair(codes, ids), post)


@register("profile_nulls", b("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) - count({q(c)}) AS nulls FROM raw"
    for c in REQUIRED_COLUMNS), "raw"))
def profile_nulls(spark, sf):
    return profile.null_counts(flow(spark, sf).raw)


@register("profile_duplicates", b("""SELECT count(*) AS rows,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM raw) d) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw) d) AS duplicate_rows FROM raw""",
                                  "raw"))
def profile_duplicates(spark, sf):
    return profile.duplicate_count(flow(spark, sf).raw)


@register("profile_negatives", b("""SELECT count(*) FILTER (WHERE "Sales Qty" < 0) AS negative_sales_qty_rows,
  count(*) FILTER (WHERE "Sales USD" < 0) AS negative_sales_usd_rows FROM raw""", "raw"))
def profile_negatives(spark, sf):
    return profile.negatives(flow(spark, sf).raw)


@register("profile_artifacts", b("""SELECT "Region", "Country", "Product Code", "Sales Qty",
  CASE WHEN "Region" = 'Total' THEN 'pivot total row'
       WHEN starts_with("Region", 'Applied filters:') THEN 'filter footer row'
       ELSE 'blank spacer row' END AS artifact_reason
FROM flagged WHERE is_artifact""", "flagged"))
def profile_artifacts(spark, sf):
    return clean.artifact_rows(flow(spark, sf).raw).select(
        "Region", "Country", "Product Code", "Sales Qty", "artifact_reason")


def _norm_in(values):
    return f"upper(trim(\"Product Range\")) IN ({O._in_list(values)})"


@register("profile_exclusions", b(f"""SELECT count(*) FILTER (WHERE {_norm_in(P.merchandise_ranges)}) AS merchandise_rows,
  count(*) FILTER (WHERE {_norm_in(P.rubber_ranges)}) AS rubber_rows,
  count(*) FILTER (WHERE {_norm_in(P.excluded_ranges)}) AS excluded_rows FROM cleaned""", "cleaned"))
def profile_exclusions(spark, sf):
    f = flow(spark, sf)
    return scope.exclusion_counts(f.cleaned, f.params.merchandise_ranges, f.params.rubber_ranges)


@register("profile_summary", b(f"""SELECT * FROM (VALUES
  ('raw_rows', (SELECT count(*) FROM raw)),
  ('raw_regions', (SELECT count(DISTINCT "Region") FROM post_artifact)),
  ('raw_countries', (SELECT count(DISTINCT "Country") FROM post_artifact)),
  ('cleaned_rows_post_dedup', (SELECT count(*) FROM prepared)),
  ('duplicate_rows_dropped', (SELECT count(*) FROM post_artifact) - (SELECT count(*) FROM prepared)),
  ('missing_order_date_rows_imputed', (SELECT count(*) FROM prepared WHERE "Order Date" IS NULL)),
  ('negative_sales_qty_rows', (SELECT count(*) FROM raw WHERE "Sales Qty" < 0)),
  ('negative_sales_usd_rows', (SELECT count(*) FROM raw WHERE "Sales USD" < 0)),
  ('cleaned_products', (SELECT count(DISTINCT "ProductID") FROM prepared)),
  ('in_scope_rows', (SELECT count(*) FROM scoped)),
  ('in_scope_products', (SELECT count(DISTINCT "ProductID") FROM scoped))
) t(metric, value)""", "raw", "post_artifact", "prepared", "scoped"))
def profile_summary(spark, sf):
    from ..operators.profile_summary import summary
    return summary(flow(spark, sf))
