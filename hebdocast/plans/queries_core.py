"""Registered queries: sources, cleaning, scoping, weekly, features, tiers,
sparse-tier forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CROSTON, FIXTURE_PARAMS, NAIVE, SBA, SPARSE, TSB
from ..operators import clean, features, intermittent, scope, tiers, weekly
from ..sources import adapter, calendar
from ..sources.tables import read_table
from . import oracle as O
from .flow import Flow
from .registry import register

b = O.build
CATS_SQL = '"Region", "Country", "Sales Channel", "Brand Category", "Product Range"'


# Registered queries of one session share one Flow per data folder, with its persisted stages and
# scalar jobs, for as long as the folder's files stay the same (names, sizes, times); a change closes it.
_SESSION_FLOWS: dict = {}


def _files(spark, sf) -> tuple:
    """Names, sizes and times of the files of the source tables."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    found = []
    for name in adapter.SOURCE_TABLES:
        path = hadoop(f"{sf}/{name}.parquet")
        for status in path.getFileSystem(conf).listStatus(path):
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(found)


def flow(spark, sf, *keep):
    """The flow of a folder. ``keep`` names further stages to persist, for queries that read them many times: others
    compute from the weekly table only the columns and windows that they read."""
    key, files = (spark.sparkContext.applicationId, sf), _files(spark, sf)
    held = _SESSION_FLOWS.get(key)
    if held is not None and held[0] != files:
        held[1].close()
        held = None
    if held is None:
        f = Flow.from_tables(spark, sf, FIXTURE_PARAMS)
        f.keep("prepared", "weekly_ext")
        held = _SESSION_FLOWS[key] = (files, f)
    return held[1].keep(*keep)


# --- 2.1 sources ------------------------------------------------------------
@register("src_transactions", b("SELECT * FROM raw", "raw"))
def src_transactions(spark, sf):
    return flow(spark, sf).raw


@register("src_pruned_scan", "SELECT l_partkey, l_quantity, l_shipdate FROM lineitem")
def src_pruned_scan(spark, sf):
    return read_table(spark, sf, "lineitem", ["l_partkey", "l_quantity", "l_shipdate"])


@register("week_spine", b("""SELECT CAST(row_number() OVER (ORDER BY wk) AS BIGINT) AS week_index,
       CAST(wk AS DATE) AS "WeekStart"
FROM (SELECT unnest(generate_series(CAST(first_week AS TIMESTAMP), CAST(valid_end AS TIMESTAMP),
                                    INTERVAL 7 DAY)) AS wk FROM cut) s""", "cut"))
def week_spine(spark, sf):
    return calendar.week_spine_of(flow(spark, sf).weekly)


@register("holiday_dim", b("SELECT day FROM holidays", "holidays"))
def holiday_dim(spark, sf):
    return flow(spark, sf).holidays


@register("featured_supplied_holidays", b("""SELECT "ProductID", "WeekStart",
       "WeekStart" IN (SELECT CAST(date_trunc('week', day) AS DATE) FROM supplied_days) AS is_lk_holiday_week
FROM panel""", "panel", "supplied_days"))
def featured_supplied_holidays(spark, sf):
    """Holidays from a table instead of rules: the days of each month with the most urgent orders."""
    f = flow(spark, sf)
    days = (read_table(spark, sf, "orders", ["o_orderdate", "o_orderpriority"])
            .where(F.col("o_orderdate").isNotNull())
            .groupBy(F.col("o_orderdate").cast("date").alias("day"))
            .agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n"))
            .withColumn("most", F.max("n").over(Window.partitionBy(F.date_trunc("month", "day"))))
            .where(F.col("n") == F.col("most")))
    return (features.add_features(f.panel_base, features.holiday_weeks(days), f.params)
            .select("ProductID", "WeekStart", "is_lk_holiday_week"))


# --- 2.2 cleaning -----------------------------------------------------------
@register("clean_artifacts", b("""SELECT * EXCLUDE (is_artifact),
  CASE WHEN "Region" = 'Total' THEN 'pivot total row'
       WHEN starts_with("Region", 'Applied filters:') THEN 'filter footer row'
       ELSE 'blank spacer row' END AS artifact_reason
FROM flagged WHERE is_artifact""", "flagged"))
def clean_artifacts(spark, sf):
    return clean.artifact_rows(flow(spark, sf).raw)


@register("clean_dedup", b("""SELECT count(*) AS rows_before,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM post_artifact) d) AS rows_after,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM post_artifact) d) AS duplicate_rows_dropped
FROM post_artifact""", "post_artifact"))
def clean_dedup(spark, sf):
    post = clean.drop_artifacts(flow(spark, sf).raw)
    before = post.agg(F.count(F.lit(1)).alias("rows_before"))
    after = clean.drop_exact_duplicates(post).agg(F.count(F.lit(1)).alias("rows_after"))
    return (clean._one_row_pair(before, after)
            .withColumn("duplicate_rows_dropped", F.col("rows_before") - F.col("rows_after")))


@register("clean_product_id", b("""SELECT "ProductID", count(*) AS n_rows,
  count(DISTINCT "Product Code") AS n_product_codes, min(length("ProductID")) AS id_length
FROM prepared GROUP BY "ProductID\"""", "prepared"))
def clean_product_id(spark, sf):
    return (flow(spark, sf).prepared.groupBy("ProductID")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.countDistinct("Product Code").alias("n_product_codes"),
                 F.min(F.length("ProductID")).cast("long").alias("id_length")))


@register("clean_parse_dates", b("""SELECT count(*) AS n_rows,
  count(*) - count("Order Date") AS order_date_missing,
  count(*) - count("Invoice Date") AS invoice_date_missing,
  min("Order Date") AS order_date_min, max("Order Date") AS order_date_max,
  min("Invoice Date") AS invoice_date_min, max("Invoice Date") AS invoice_date_max
FROM prepared""", "prepared"))
def clean_parse_dates(spark, sf):
    p = flow(spark, sf).prepared
    return p.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("Order Date").isNull()).alias("order_date_missing"),
                 F.count_if(F.col("Invoice Date").isNull()).alias("invoice_date_missing"),
                 F.min("Order Date").alias("order_date_min"),
                 F.max("Order Date").alias("order_date_max"),
                 F.min("Invoice Date").alias("invoice_date_min"),
                 F.max("Invoice Date").alias("invoice_date_max"))


@register("clean_lead_stats", b("SELECT median_lead_days, negative_lead_rate FROM lead_stats",
                                "lead_stats"))
def clean_lead_stats(spark, sf):
    return clean.lead_stats(flow(spark, sf).prepared)


@register("clean_impute_order_date", b("""SELECT p."ProductID", p."Invoice No", p."Invoice Date",
  p."Invoice Date" - to_days(s.median_lead_days) AS "Order Date"
FROM prepared p CROSS JOIN lead_stats s WHERE p."Order Date" IS NULL""", "prepared", "lead_stats"))
def clean_impute_order_date(spark, sf):
    f = flow(spark, sf)
    missing = f.prepared.where(F.col("Order Date").isNull())
    return (clean.impute_order_date(missing, f.median_lead_days)
            .select("ProductID", "Invoice No", "Invoice Date", "Order Date"))


@register("clean_audit", b("""SELECT
  (SELECT count(*) FROM raw) AS raw_rows,
  (SELECT count(*) FROM flagged WHERE is_artifact) AS artifact_rows_dropped,
  (SELECT count(*) FROM post_artifact) - (SELECT count(*) FROM prepared) AS duplicate_rows_dropped,
  (SELECT count(*) FROM prepared WHERE "Order Date" IS NULL) AS missing_order_dates_imputed,
  median_lead_days, negative_lead_rate,
  (SELECT count(*) FROM prepared) AS cleaned_rows
FROM lead_stats""", "raw", "flagged", "post_artifact", "prepared", "lead_stats"))
def clean_audit(spark, sf):
    f = flow(spark, sf)
    return clean.clean_audit(f.raw, f.median_lead_days, f.negative_lead_rate)


@register("cleaned", b("SELECT * FROM cleaned", "cleaned"))
def cleaned(spark, sf):
    return flow(spark, sf).cleaned


# --- 2.3 scoping ------------------------------------------------------------
@register("scope_normalise", b("""SELECT upper(trim("Product Range")) AS product_range_normalised,
  count(*) AS n_rows FROM cleaned GROUP BY 1""", "cleaned"))
def scope_normalise(spark, sf):
    return (flow(spark, sf).cleaned
            .groupBy(scope.normalise("Product Range").alias("product_range_normalised"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("scoped", b("SELECT * FROM scoped", "scoped"))
def scoped(spark, sf):
    return flow(spark, sf).scoped


_EXCL = O._in_list(O.P.excluded_ranges)


@register("scope_split_products", b(f"""SELECT k."ProductID", k.kept_rows, e.excluded_rows
FROM (SELECT "ProductID", count(*) AS kept_rows FROM scoped GROUP BY 1) k
JOIN (SELECT "ProductID", count(*) AS excluded_rows FROM cleaned
      WHERE upper(trim("Product Range")) IN ({_EXCL}) GROUP BY 1) e ON e."ProductID" = k."ProductID\"""",
                                    "scoped"))
def scope_split_products(spark, sf):
    f = flow(spark, sf)
    return scope.split_products(f.cleaned, f.params.excluded_ranges)


@register("scope_violations", b(f"""SELECT * FROM scoped
WHERE upper(trim("Product Range")) IN ({_EXCL})""", "scoped"))
def scope_violations(spark, sf):
    f = flow(spark, sf)
    return scope.scope_violations(f.scoped, f.params.excluded_ranges)


@register("scope_audit", b(f"""SELECT (SELECT count(*) FROM cleaned) AS cleaned_rows,
  (SELECT count(*) FROM cleaned WHERE upper(trim("Product Range")) IN ({_EXCL})) AS excluded_rows,
  (SELECT count(*) FROM scoped) AS scoped_rows,
  (SELECT count(DISTINCT "ProductID") FROM cleaned) AS cleaned_products,
  (SELECT count(DISTINCT "ProductID") FROM scoped) AS scoped_products""", "scoped"))
def scope_audit(spark, sf):
    f = flow(spark, sf)
    return scope.scope_audit(f.cleaned, f.params.excluded_ranges)


# --- 2.4 weekly -------------------------------------------------------------
@register("week_floor", b("""SELECT DISTINCT CAST("Order Date" AS DATE) AS order_day, "WeekStart",
  CAST(dow AS BIGINT) AS order_dow FROM tx_w""", "tx_w"))
def week_floor(spark, sf):
    from ..functions.columns import week_floor as wf, weekday_mon0
    return (flow(spark, sf).scoped
            .select(F.to_date("Order Date").alias("order_day"), wf("Order Date").alias("WeekStart"),
                    weekday_mon0("Order Date").cast("long").alias("order_dow"))
            .distinct())


@register("weekly_agg", b("""SELECT "ProductID", "WeekStart", q_raw AS "Sales_Qty_raw", "Sales_USD",
  transaction_count FROM wk_num""", "wk_num"))
def weekly_agg(spark, sf):
    return weekly.weekly_sums(flow(spark, sf).scoped)


@register("weekly_modes", b(f"""SELECT "ProductID", "WeekStart", {CATS_SQL} FROM weekly""", "weekly"))
def weekly_modes(spark, sf):
    return weekly.weekly_modes(flow(spark, sf).scoped)


@register("weekly", b("SELECT * FROM weekly", "weekly"))
def weekly_q(spark, sf):
    return flow(spark, sf).weekly


@register("weekly_violations", b("""SELECT "ProductID", "WeekStart", 'duplicate_key' AS violation
FROM weekly GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT "ProductID", "WeekStart", 'negative_qty' FROM weekly WHERE "Sales_Qty" < 0""",
                                  "weekly"))
def weekly_violations(spark, sf):
    return weekly.weekly_violations(flow(spark, sf).weekly)


@register("weekly_audit", b("""SELECT (SELECT count(*) FROM scoped) AS scoped_rows, count(*) AS weekly_rows,
  count(*) FILTER (WHERE returns_exceeded_sales) AS returns_exceeded_sales_weeks,
  min("WeekStart") AS min_week, max("WeekStart") AS max_week FROM weekly""", "weekly"))
def weekly_audit(spark, sf):
    f = flow(spark, sf)
    return weekly.weekly_audit(f.scoped, f.weekly)


# --- 2.5 panel and features -------------------------------------------------
_PANEL_COLS = ('"ProductID", "WeekStart", "Sales_Qty", "Sales_USD", returns_exceeded_sales, '
               'transaction_count, ' + CATS_SQL)


@register("panel", b(f"SELECT {_PANEL_COLS} FROM panel", "panel"))
def panel(spark, sf):
    return flow(spark, sf).panel.select(*features.PANEL_COLUMNS)


@register("product_modes", b(f"""SELECT p."ProductID", {", ".join(f'pm{i}."{c}"' for i, c in
                                                              enumerate(O.CATS))}
FROM pfirst p {" ".join(f'LEFT JOIN pm{i} ON pm{i}."ProductID" = p."ProductID"' for i in range(5))}""",
                             "pfirst", *[f"pm{i}" for i in range(5)]))
def product_modes(spark, sf):
    return features.product_modes(flow(spark, sf).weekly)


_LAG_COLS = ", ".join(f'"Sales_Qty_lag_{k}"' for k in O.P.lags)
_ROLL_COLS = ", ".join(f'"Sales_Qty_roll{s}_{w}"' for w in O.P.windows for s in ("mean", "std"))


@register("feat_lags", b(f'SELECT "ProductID", "WeekStart", {_LAG_COLS} FROM featured', "featured"))
def feat_lags(spark, sf):
    return flow(spark, sf).featured.select(
        "ProductID", "WeekStart", *[features.lag_name(k) for k in O.P.lags])


@register("feat_rolling", b(f'SELECT "ProductID", "WeekStart", {_ROLL_COLS} FROM featured',
                            "featured"))
def feat_rolling(spark, sf):
    return flow(spark, sf).featured.select(
        "ProductID", "WeekStart",
        *[f"Sales_Qty_roll{s}_{w}" for w in O.P.windows for s in ("mean", "std")])


@register("feat_dow", b("""SELECT "ProductID", "WeekStart", dominant_dow, pct_weekend_orders
FROM weekly_ext""", "weekly_ext"))
def feat_dow(spark, sf):
    return weekly.day_of_week_features(flow(spark, sf).scoped)


@register("feat_calendar", b("""SELECT DISTINCT "WeekStart", month, week_of_month, quarter, week_of_year,
  is_year_end FROM featured""", "featured"))
def feat_calendar(spark, sf):
    return flow(spark, sf).featured.select(
        "WeekStart", "month", "week_of_month", "quarter", "week_of_year", "is_year_end").distinct()


@register("feat_holiday_week", b("""SELECT DISTINCT "WeekStart", is_lk_holiday_week FROM featured""",
                                 "featured"))
def feat_holiday_week(spark, sf):
    return flow(spark, sf).featured.select("WeekStart", "is_lk_holiday_week").distinct()


@register("feat_zero_streak", b("""SELECT "ProductID", "WeekStart", "Sales_Qty", zero_streak_length,
  cumulative_zero_weeks FROM featured""", "featured"))
def feat_zero_streak(spark, sf):
    return flow(spark, sf).featured.select(
        "ProductID", "WeekStart", "Sales_Qty", "zero_streak_length", "cumulative_zero_weeks")


@register("feat_unit_price", b('SELECT "ProductID", "WeekStart", unit_price FROM featured',
                               "featured"))
def feat_unit_price(spark, sf):
    return flow(spark, sf).featured.select("ProductID", "WeekStart", "unit_price")


@register("featured", b(f"SELECT {O.FEATURED_COLS} FROM featured", "featured"))
def featured(spark, sf):
    return flow(spark, sf).featured


@register("feature_audit", b("""SELECT count(*) AS featured_rows, count(DISTINCT "ProductID") AS products,
  count(DISTINCT "WeekStart") AS weeks, avg(CAST("Sales_Qty" = 0 AS DOUBLE)) AS zero_sales_share
FROM featured""", "featured"))
def feature_audit(spark, sf):
    return features.feature_audit(flow(spark, sf).featured)


@register("leakage_violations")
def leakage_violations(spark, sf):
    from ..operators.leakage import leakage_violations as lv
    f = flow(spark, sf)
    return lv(f)


_SOURCE_FRAMES = {"Sales_Qty_lag_1": (1, 1), "Sales_Qty_lag_12": (12, 12), "Sales_Qty_rollmean_4": (4, 1),
                  "Sales_Qty_rollstd_12": (12, 1), "product_mean_qty": (None, 1), "zero_streak_length_prev": (None, 1),
                  "dominant_dow_prev": (1, 1)}
_SOURCES_SQL = "\nUNION ALL\n".join(f"""SELECT '{c}' AS feature, count(src) AS n_rows, min("WeekStart" - src)::BIGINT AS nearest_days,
  max("WeekStart" - src)::BIGINT AS farthest_days FROM (SELECT "WeekStart", max("WeekStart") OVER (PARTITION BY "ProductID" ORDER BY "WeekStart"
  ROWS BETWEEN {'UNBOUNDED' if a is None else a} PRECEDING AND {z} PRECEDING) AS src FROM featured)""" for c, (a, z) in _SOURCE_FRAMES.items())


@register("feature_sources", b(_SOURCES_SQL, "featured"))
def feature_sources(spark, sf):
    """How far back the nearest value that a feature reads lies, over all rows."""
    from ..operators import leakage
    f = flow(spark, sf)
    sources = leakage.source_weeks(f.panel_base, f.params)
    days = {c: F.datediff("WeekStart", c) for c in _SOURCE_FRAMES}
    one = sources.agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n_rows"), F.min(d).cast("long").alias("nearest_days"),
                                 F.max(d).cast("long").alias("farthest_days")).alias(c) for c, d in days.items()])
    return one.select(F.explode(F.array(*[F.col(c) for c in days])).alias("x")).select("x.*")


# --- 2.6 tiers --------------------------------------------------------------
@register("tiers", b("SELECT * FROM tiers", "tiers"))
def tiers_q(spark, sf):
    return flow(spark, sf).tiers


@register("tier_violations", b("""SELECT "ProductID", 'duplicate' AS violation FROM tiers
GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT "ProductID", 'no_tier' FROM tiers WHERE tier IS NULL
UNION ALL SELECT "ProductID", 'gap' FROM (SELECT DISTINCT "ProductID" FROM featured) f
  WHERE "ProductID" NOT IN (SELECT "ProductID" FROM tiers)""", "tiers"))
def tier_violations(spark, sf):
    f = flow(spark, sf)
    return tiers.tier_violations(f.tiers, f.weekly_ext)


@register("tier_audit", b("""SELECT count(*) AS products,
  count(*) FILTER (WHERE tier = 'high_volume') AS high_volume_products,
  count(*) FILTER (WHERE tier = 'sparse') AS sparse_products,
  coalesce(sum(CASE WHEN tier = 'high_volume' THEN total_sales_qty ELSE 0 END)
           / nullif(sum(total_sales_qty), 0), 0)::DOUBLE AS high_volume_volume_share
FROM tiers""", "tiers"))
def tier_audit(spark, sf):
    return tiers.tier_audit(flow(spark, sf).tiers)


# --- 2.7 sparse tier --------------------------------------------------------
@register("sparse_long", b("SELECT * FROM slong", "slong"))
def sparse_long(spark, sf):
    return flow(spark, sf).sparse_long


@register("sparse_split", b("""SELECT c.train_end, c.valid_start, c.valid_end,
  (SELECT count(*) FROM slong WHERE ds <= c.train_end) AS train_rows,
  (SELECT count(*) FROM slong WHERE ds >= c.valid_start AND ds <= c.valid_end) AS actual_rows
FROM cut c""", "slong", "cut"))
def sparse_split(spark, sf):
    f = flow(spark, sf)
    c = f.cutoffs
    lg = f.sparse_long
    return lg.agg(
        F.count_if(F.col("ds") <= F.lit(c.train_end)).alias("train_rows"),
        F.count_if((F.col("ds") >= F.lit(c.valid_start)) & (F.col("ds") <= F.lit(c.valid_end)))
        .alias("actual_rows"),
    ).select(F.lit(c.train_end).alias("train_end"), F.lit(c.valid_start).alias("valid_start"),
             F.lit(c.valid_end).alias("valid_end"), "train_rows", "actual_rows")


def _model_fc(model):
    def fn(spark, sf):
        return (flow(spark, sf).sparse_forecast.where(F.col("model") == model)
                .select("unique_id", "ds", "y_pred"))
    return fn


for _name, _model in (("fc_croston", CROSTON), ("fc_sba", SBA), ("fc_tsb", TSB),
                      ("fc_naive", NAIVE)):
    register(_name, b(f"SELECT unique_id, ds, y_pred FROM sparse_forecast WHERE model = '{_model}'",
                      "sparse_forecast"))(_model_fc(_model))


@register("fc_fallback", b(f"""SELECT i.unique_id, coalesce(p.n, 0) AS train_rows,
  coalesce(p.last_y, 0)::DOUBLE AS y_pred
FROM sparse_ids i LEFT JOIN sv_p p ON p.unique_id = i.unique_id
WHERE coalesce(p.n, 0) < {O.P.min_fit_rows}""", "sparse_ids", "sv_p"))
def fc_fallback(spark, sf):
    f = flow(spark, sf)
    lv = intermittent.series_levels(intermittent.train_rows(f.sparse_long, f.cutoffs.train_end),
                                    f.params)
    ids = f.tier_ids(SPARSE).select(F.col("ProductID").alias("unique_id"))
    j = ids.join(lv, "unique_id", "left")
    return (j.where(F.coalesce(F.col("n"), F.lit(0)) < f.params.min_fit_rows)
            .select("unique_id", F.coalesce(F.col("n"), F.lit(0)).alias("train_rows"),
                    F.coalesce(F.col("last_y"), F.lit(0.0)).alias("y_pred")))


@register("fc_sparse_long", b("""SELECT unique_id, model, any_value(y_pred) AS y_pred
FROM sparse_forecast GROUP BY unique_id, model""", "sparse_forecast"))
def fc_sparse_long(spark, sf):
    f = flow(spark, sf)
    wide = intermittent.forecast_wide(f.tier_ids(SPARSE),
                                      intermittent.train_rows(f.sparse_long, f.cutoffs.valid_end),
                                      f.params)
    return intermittent.wide_model_frame(wide)


@register("fc_dedup", b(f"""SELECT unique_id, ds, model, y_pred FROM sparse_forecast WHERE model <> '{CROSTON}'
UNION ALL SELECT unique_id, ds, '{CROSTON}', y_pred FROM sparse_forecast WHERE model = '{NAIVE}'""",
                        "sparse_forecast"))
def fc_dedup(spark, sf):
    """Every Croston row collides with a fallback row (the naive value), which wins."""
    fc = flow(spark, sf).sparse_forecast.select("unique_id", "ds", "model", "y_pred")
    fallback = fc.where(F.col("model") == NAIVE).withColumn("model", F.lit(CROSTON))
    both = fc.withColumn("priority", F.lit(0)).unionByName(fallback.withColumn("priority", F.lit(1)))
    return intermittent.keep_last(both, "priority")


@register("fc_horizon_violations", b(f"""SELECT i."ProductID" AS unique_id, m.model,
  count(f.ds) AS "rows" FROM (SELECT "ProductID" FROM tiers WHERE tier = '{SPARSE}') i
CROSS JOIN (VALUES ('{CROSTON}'), ('{SBA}'), ('{TSB}'), ('{NAIVE}')) m(model)
LEFT JOIN sparse_forecast f ON f.unique_id = i."ProductID" AND f.model = m.model
GROUP BY 1, 2 HAVING count(f.ds) <> {O.P.horizon}""", "tiers", "sparse_forecast"))
def fc_horizon_violations(spark, sf):
    f = flow(spark, sf)
    return intermittent.horizon_violations(f.sparse_forecast, f.params.horizon, f.tier_ids(SPARSE))


@register("sparse_validation", b("SELECT * FROM sparse_validation", "sparse_validation"))
def sparse_validation(spark, sf):
    return flow(spark, sf).sparse_validation


@register("sparse_forecast", b("SELECT * FROM sparse_forecast", "sparse_forecast"))
def sparse_forecast(spark, sf):
    return flow(spark, sf).sparse_forecast


# --- guards ---------------------------------------------------------------------
@register("clean_artifact_violations", b("""SELECT count(*) AS artifact_rows FROM flagged
WHERE is_artifact HAVING count(*) <> 3""", "flagged"))
def clean_artifact_violations(spark, sf):
    return clean.artifact_violations(flow(spark, sf).raw)


@register("week_floor_violations", b('SELECT * FROM scoped WHERE "Order Date" IS NULL', "scoped"))
def week_floor_violations(spark, sf):
    return weekly.week_floor_violations(flow(spark, sf).scoped)
