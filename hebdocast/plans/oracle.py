"""Independent SQL formulation of every checked query (DuckDB dialect).

Written from the semantics, not from the Spark plans: the panel is a spine
joined to the weekly table, zero streaks use gaps-and-islands, modes use
ranked counts, intervals use ``lag`` over demand rows only, and so on. Each
query is a chain of named CTEs resolved by dependency.
"""

from __future__ import annotations

from ..config import FIXTURE_PARAMS, REQUIRED_COLUMNS

P = FIXTURE_PARAMS
CATS = ("Region", "Country", "Sales Channel", "Brand Category", "Product Range")


def q(name: str) -> str:
    return '"' + name + '"'


def _in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _mode_cte(name: str, src: str, keys: list[str], expr: str, alias: str) -> str:
    k = ", ".join(keys)
    return f"""{name} AS (
  SELECT {k}, v AS {alias} FROM (
    SELECT {k}, v, row_number() OVER (PARTITION BY {k} ORDER BY cnt DESC, v) AS rn
    FROM (SELECT {k}, {expr} AS v, count(*) AS cnt FROM {src}
          WHERE {expr} IS NOT NULL GROUP BY {k}, {expr}) c
  ) r WHERE rn = 1)"""


def _win(part: str, order: str, frame: str = "") -> str:
    return f"(PARTITION BY {part} ORDER BY {order} {frame})"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


# Stages that several later ones read: computed once in a statement.
SHARED = ("tx_w", "weekly", "featured", "slong", "hv", "hv_state", "sv_fc")


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    if name in SHARED:
        body = body.replace(f"{name} AS (", f"{name} AS MATERIALIZED (", 1)
    CTES[name] = (deps, body)


# --- transactions -----------------------------------------------------------
_neg = "(l_orderkey + l_linenumber) % 17 = 0"
cte("tx_base", (), f"""tx_base AS (
  SELECT r_name AS "Region", n_name AS "Country", CAST(c_custkey AS VARCHAR) AS "Customer Code",
         c_name AS "Customer ID", p_brand AS "Brand Category",
         CASE WHEN l_orderkey % 613 = 0 THEN NULL
              WHEN l_linenumber = 7 THEN 'PROMO'
              WHEN l_orderkey % 5 = 0 THEN ' ' || lower(p_type)
              ELSE p_type END AS "Product Range",
         o_orderpriority AS "Sales Channel",
         lpad(CAST(l_partkey AS VARCHAR), 5, '0') || '-' || lpad(CAST(l_suppkey % 3 AS VARCHAR), 3, '0')
           || '-' || p_type AS "Product Code",
         CASE WHEN l_orderkey % 431 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS "Order Date",
         CAST(l_shipdate AS TIMESTAMP) AS "Invoice Date",
         CAST(l_orderkey AS VARCHAR) AS "Invoice No",
         CASE WHEN {_neg} THEN -(l_extendedprice * (1 - l_discount)) ELSE l_extendedprice * (1 - l_discount) END AS "Sales USD",
         CASE WHEN {_neg} THEN -l_quantity ELSE l_quantity END AS "Sales Qty",
         CASE WHEN {_neg} THEN -(l_quantity * p_size) ELSE l_quantity * p_size END AS "Sales KG",
         l_orderkey AS _ok
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
       JOIN part ON l_partkey = p_partkey)""")

_nulls = ", ".join(["NULL::VARCHAR"] * 7 + ["NULL::TIMESTAMP"] * 2 + ["NULL::VARCHAR"] + ["NULL::DOUBLE"] * 3)
cte("raw", ("tx_base",), f"""raw AS (
  SELECT * EXCLUDE (_ok) FROM tx_base
  UNION ALL SELECT * EXCLUDE (_ok) FROM tx_base WHERE _ok % 997 = 0
  UNION ALL SELECT 'Total', {_nulls}
  UNION ALL SELECT NULL::VARCHAR, {_nulls}
  UNION ALL SELECT 'Applied filters: none', {_nulls})""")

_all_null = " AND ".join(f"{q(c)} IS NULL" for c in REQUIRED_COLUMNS)
cte("flagged", ("raw",), f"""flagged AS (
  SELECT *, (coalesce("Region" = 'Total', false)
             OR coalesce(starts_with("Region", 'Applied filters:'), false)
             OR ({_all_null})) AS is_artifact FROM raw)""")
cte("post_artifact", ("flagged",),
    "post_artifact AS (SELECT * EXCLUDE (is_artifact) FROM flagged WHERE NOT is_artifact)")
cte("prepared", ("post_artifact",), """prepared AS (
  SELECT *, substr("Product Code", 1, 9) AS "ProductID" FROM (SELECT DISTINCT * FROM post_artifact) d)""")
cte("leads", ("prepared",), """leads AS (
  SELECT CAST(floor((epoch("Invoice Date") - epoch("Order Date")) / 86400.0) AS BIGINT) AS lead_days
  FROM prepared WHERE "Order Date" IS NOT NULL AND "Invoice Date" IS NOT NULL)""")
cte("lead_stats", ("leads",), """lead_stats AS (
  SELECT CAST(trunc(quantile_cont(lead_days, 0.5)) AS INTEGER) AS median_lead_days,
         avg(CAST(lead_days < 0 AS DOUBLE)) AS negative_lead_rate FROM leads)""")
cte("cleaned", ("prepared", "lead_stats"), """cleaned AS (
  SELECT p.* REPLACE (coalesce(p."Order Date", p."Invoice Date" - to_days(s.median_lead_days)) AS "Order Date")
  FROM prepared p CROSS JOIN lead_stats s)""")

_excl = _in_list(P.excluded_ranges)
cte("scoped", ("cleaned",), f"""scoped AS (
  SELECT * FROM cleaned
  WHERE "Product Range" IS NULL OR upper(trim("Product Range")) NOT IN ({_excl}))""")

# --- weekly -----------------------------------------------------------------
cte("tx_w", ("scoped",), """tx_w AS (
  SELECT *, CAST(date_trunc('week', "Order Date") AS DATE) AS "WeekStart",
         isodow("Order Date") - 1 AS dow FROM scoped)""")
cte("wk_num", ("tx_w",), """wk_num AS (
  SELECT "ProductID", "WeekStart", coalesce(sum("Sales Qty"), 0)::DOUBLE AS q_raw,
         coalesce(sum("Sales USD"), 0)::DOUBLE AS "Sales_USD", count(*) AS transaction_count,
         avg(CASE WHEN dow IN (5, 6) THEN 1.0 ELSE 0.0 END)::DOUBLE AS pct_weekend_orders
  FROM tx_w GROUP BY "ProductID", "WeekStart")""")
_wk = ['"ProductID"', '"WeekStart"']
for i, c in enumerate(CATS):
    cte(f"wm{i}", ("tx_w",), _mode_cte(f"wm{i}", "tx_w", _wk, q(c), q(c)))
cte("wm_dow", ("tx_w",), _mode_cte("wm_dow", "tx_w", _wk, "dow", "dominant_dow"))
_wjoin = "\n".join(f"  LEFT JOIN wm{i} USING (\"ProductID\", \"WeekStart\")" for i in range(5))
cte("weekly_ext", ("wk_num", "wm_dow") + tuple(f"wm{i}" for i in range(5)), f"""weekly_ext AS (
  SELECT "ProductID", "WeekStart", greatest(q_raw, 0::DOUBLE) AS "Sales_Qty", "Sales_USD",
         q_raw < 0 AS returns_exceeded_sales, transaction_count,
         {", ".join(q(c) for c in CATS)},
         CAST(dominant_dow AS DOUBLE) AS dominant_dow, pct_weekend_orders
  FROM wk_num
{_wjoin}
  LEFT JOIN wm_dow USING ("ProductID", "WeekStart"))""")
WEEKLY_COLS = ['"ProductID"', '"WeekStart"', '"Sales_Qty"', '"Sales_USD"', "returns_exceeded_sales",
               "transaction_count"] + [q(c) for c in CATS]
cte("weekly", ("weekly_ext",), f"weekly AS (SELECT {', '.join(WEEKLY_COLS)} FROM weekly_ext)")
cte("cut", ("weekly",), """cut AS (
  SELECT max("WeekStart") AS valid_end, CAST(max("WeekStart") - INTERVAL 84 DAY AS DATE) AS train_end,
         CAST(max("WeekStart") - INTERVAL 77 DAY AS DATE) AS valid_start,
         CAST(max("WeekStart") + INTERVAL 7 DAY AS DATE) AS origin,
         min("WeekStart") AS first_week FROM weekly)""")

# --- panel ------------------------------------------------------------------
cte("pfirst", ("weekly",),
    'pfirst AS (SELECT "ProductID", min("WeekStart") AS first_week FROM weekly GROUP BY "ProductID")')
cte("grid", ("pfirst", "cut"), """grid AS (
  SELECT "ProductID", CAST(wk AS DATE) AS "WeekStart" FROM (
    SELECT "ProductID", unnest(generate_series(CAST(pfirst.first_week AS TIMESTAMP),
                                               CAST(cut.valid_end AS TIMESTAMP), INTERVAL 7 DAY)) AS wk
    FROM pfirst CROSS JOIN cut) g)""")
for i, c in enumerate(CATS):
    cte(f"pm{i}", ("weekly",), _mode_cte(f"pm{i}", "weekly", ['"ProductID"'], q(c), q(c)))
_pjoin = "\n".join(f"  LEFT JOIN pm{i} ON pm{i}.\"ProductID\" = g.\"ProductID\"" for i in range(5))
cte("panel", ("grid", "weekly_ext") + tuple(f"pm{i}" for i in range(5)), f"""panel AS (
  SELECT g."ProductID", g."WeekStart", coalesce(w."Sales_Qty", 0)::DOUBLE AS "Sales_Qty",
         coalesce(w."Sales_USD", 0)::DOUBLE AS "Sales_USD",
         coalesce(w.returns_exceeded_sales, false) AS returns_exceeded_sales,
         CAST(coalesce(w.transaction_count, 0) AS BIGINT) AS transaction_count,
         {", ".join(f"pm{i}.{q(c)}" for i, c in enumerate(CATS))},
         w.dominant_dow, coalesce(w.pct_weekend_orders, 0)::DOUBLE AS pct_weekend_orders
  FROM grid g LEFT JOIN weekly_ext w ON w."ProductID" = g."ProductID" AND w."WeekStart" = g."WeekStart"
{_pjoin})""")

_W = '"ProductID"', '"WeekStart"'


def _pw(frame: str = "") -> str:
    return _win('"ProductID"', '"WeekStart"', frame)


cte("holidays", ("cut",), f"""holidays AS (
  SELECT make_date(CAST(y AS BIGINT), m, d) AS day
  FROM (SELECT unnest(range(year(first_week), year(valid_end) + 3)) AS y FROM cut) yy
  CROSS JOIN (VALUES {", ".join(f"({m}, {d})" for m, d in P.holiday_month_days)}) md(m, d))""")
cte("supplied_days", (), """supplied_days AS (
  SELECT day FROM (
    SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n
    FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1) d
  QUALIFY n = max(n) OVER (PARTITION BY date_trunc('month', day)))""")
cte("holiday_weeks", ("holidays",),
    "holiday_weeks AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS hw FROM holidays)")

_lags = ",\n".join(f'    lag("Sales_Qty", {k}) OVER {_pw()} AS "Sales_Qty_lag_{k}"' for k in P.lags)
_rolls = []
for w in P.windows:
    fr = f"ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING"
    _rolls.append(f'    avg("Sales_Qty") OVER {_pw(fr)} AS "Sales_Qty_rollmean_{w}"')
    _rolls.append(f'    stddev_samp("Sales_Qty") OVER {_pw(fr)} AS "Sales_Qty_rollstd_{w}"')
_rolls = ",\n".join(_rolls)
cte("feat1", ("panel",), f"""feat1 AS (
  SELECT *,
{_lags},
{_rolls},
    sum(CASE WHEN "Sales_Qty" <> 0 THEN 1 ELSE 0 END) OVER {_pw("ROWS UNBOUNDED PRECEDING")} AS grp,
    CAST(sum(CASE WHEN "Sales_Qty" = 0 THEN 1 ELSE 0 END) OVER {_pw("ROWS UNBOUNDED PRECEDING")} AS BIGINT)
      AS cumulative_zero_weeks
  FROM panel)""")
cte("featured", ("feat1", "holiday_weeks"), """featured AS (
  SELECT "ProductID", "WeekStart", "Sales_Qty", "Sales_USD", returns_exceeded_sales, transaction_count,
         "Region", "Country", "Sales Channel", "Brand Category", "Product Range",
         "Sales_Qty_lag_1", "Sales_Qty_lag_2", "Sales_Qty_lag_4", "Sales_Qty_lag_12",
         "Sales_Qty_rollmean_4", "Sales_Qty_rollstd_4", "Sales_Qty_rollmean_12", "Sales_Qty_rollstd_12",
         dominant_dow, pct_weekend_orders,
         CAST(month("WeekStart") AS BIGINT) AS month,
         CAST((dayofmonth("WeekStart") - 1) // 7 + 1 AS BIGINT) AS week_of_month,
         CAST(quarter("WeekStart") AS BIGINT) AS quarter,
         CAST(weekofyear("WeekStart") AS BIGINT) AS week_of_year,
         month("WeekStart") IN (11, 12) AS is_year_end,
         "WeekStart" IN (SELECT hw FROM holiday_weeks) AS is_lk_holiday_week,
         CAST(sum(CASE WHEN "Sales_Qty" = 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY "ProductID", grp ORDER BY "WeekStart" ROWS UNBOUNDED PRECEDING) AS BIGINT)
           AS zero_streak_length,
         cumulative_zero_weeks,
         CASE WHEN "Sales_Qty" > 0 THEN "Sales_USD" / "Sales_Qty" END AS unit_price
  FROM feat1)""")
FEATURED_COLS = ('"ProductID", "WeekStart", "Sales_Qty", "Sales_USD", returns_exceeded_sales, '
                 'transaction_count, "Region", "Country", "Sales Channel", "Brand Category", '
                 '"Product Range", "Sales_Qty_lag_1", "Sales_Qty_lag_2", "Sales_Qty_lag_4", '
                 '"Sales_Qty_lag_12", "Sales_Qty_rollmean_4", "Sales_Qty_rollstd_4", '
                 '"Sales_Qty_rollmean_12", "Sales_Qty_rollstd_12", dominant_dow, pct_weekend_orders, '
                 'month, week_of_month, quarter, week_of_year, is_year_end, is_lk_holiday_week, '
                 'zero_streak_length, cumulative_zero_weeks, unit_price')

# --- tiers ------------------------------------------------------------------
cte("tiers", ("featured",), f"""tiers AS (
  SELECT "ProductID", CAST(sum(transaction_count) AS BIGINT) AS transaction_count,
         sum("Sales_Qty") AS total_sales_qty,
         CASE WHEN sum(transaction_count) >= {P.high_volume_threshold} THEN 'high_volume' ELSE 'sparse' END AS tier
  FROM featured GROUP BY "ProductID")""")

# --- sparse tier --------------------------------------------------------------
cte("slong", ("featured", "tiers"), """slong AS (
  SELECT f."ProductID" AS unique_id, f."WeekStart" AS ds, f."Sales_Qty" AS y
  FROM featured f JOIN tiers t ON t."ProductID" = f."ProductID" WHERE t.tier = 'sparse')""")
cte("sparse_ids", ("tiers",),
    "sparse_ids AS (SELECT \"ProductID\" AS unique_id FROM tiers WHERE tier = 'sparse')")


def _ses_w(alpha: float, i: str, n: str) -> str:
    return (f"CASE WHEN {i} = 1 THEN power({1.0 - alpha!r}::DOUBLE, {n} - {i}) "
            f"ELSE {alpha!r}::DOUBLE * power({1.0 - alpha!r}::DOUBLE, {n} - {i}) END")


def _sparse_levels(prefix: str, cutoff: str) -> None:
    """CTEs {prefix}_lv with per-series model values for training weeks <= cutoff."""
    cte(f"{prefix}_tr", ("slong", "cut"),
        f"{prefix}_tr AS (SELECT s.* FROM slong s, cut WHERE s.ds <= cut.{cutoff})")
    cte(f"{prefix}_all", (f"{prefix}_tr",), f"""{prefix}_all AS (
  SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS pos,
         count(*) OVER (PARTITION BY unique_id) AS n FROM {prefix}_tr)""")
    cte(f"{prefix}_dm", (f"{prefix}_all",), f"""{prefix}_dm AS (
  SELECT unique_id, ds, y, pos,
         pos - coalesce(lag(pos) OVER (PARTITION BY unique_id ORDER BY ds), 0) AS intv,
         row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS k,
         count(*) OVER (PARTITION BY unique_id) AS m
  FROM {prefix}_all WHERE y <> 0)""")
    a = P.croston_alpha
    cte(f"{prefix}_d", (f"{prefix}_dm",), f"""{prefix}_d AS (
  SELECT unique_id, count(*) AS m,
         sum(({_ses_w(a, 'k', 'm')}) * y) AS size_level,
         sum(({_ses_w(a, 'k', 'm')}) * intv) AS interval_level,
         sum(({_ses_w(P.tsb_alpha_d, 'k', 'm')}) * y) AS tsb_size_level
  FROM {prefix}_dm GROUP BY unique_id)""")
    cte(f"{prefix}_p", (f"{prefix}_all",), f"""{prefix}_p AS (
  SELECT unique_id, count(*) AS n, arg_max(y, ds) AS last_y,
         sum(({_ses_w(P.tsb_alpha_p, 'pos', 'n')}) * CASE WHEN y <> 0 THEN 1.0 ELSE 0.0 END) AS tsb_prob_level
  FROM {prefix}_all GROUP BY unique_id)""")
    cte(f"{prefix}_lv", ("sparse_ids", f"{prefix}_p", f"{prefix}_d"), f"""{prefix}_lv AS (
  SELECT i.unique_id, p.n, p.last_y,
    CASE WHEN coalesce(p.n, 0) < {P.min_fit_rows} THEN coalesce(p.last_y, 0)::DOUBLE
         WHEN d.m IS NULL THEN 0::DOUBLE
         WHEN d.interval_level <> 0 THEN d.size_level / d.interval_level ELSE d.size_level END AS croston,
    CASE WHEN coalesce(p.n, 0) < {P.min_fit_rows} THEN coalesce(p.last_y, 0)::DOUBLE
         WHEN d.m IS NULL THEN 0::DOUBLE ELSE p.tsb_prob_level * d.tsb_size_level END AS tsb,
    coalesce(p.last_y, 0)::DOUBLE AS naive
  FROM sparse_ids i LEFT JOIN {prefix}_p p ON p.unique_id = i.unique_id
       LEFT JOIN {prefix}_d d ON d.unique_id = i.unique_id)""")
    cte(f"{prefix}_fc", (f"{prefix}_lv", "cut"), f"""{prefix}_fc AS (
  SELECT unique_id, model,
         CASE model WHEN 'CrostonClassic' THEN croston
                    WHEN 'CrostonSBA' THEN CASE WHEN coalesce(n, 0) < {P.min_fit_rows} THEN croston
                                                ELSE {P.sba_factor!r} * croston END
                    WHEN 'TSB' THEN tsb ELSE naive END AS y_pred,
         CAST(cut.{'valid_start' if cutoff == 'train_end' else 'origin'} + CAST(7 * (h - 1) AS INTEGER) AS DATE) AS ds
  FROM {prefix}_lv
  CROSS JOIN (VALUES ('CrostonClassic'), ('CrostonSBA'), ('TSB'), ('Naive')) mm(model)
  CROSS JOIN (SELECT unnest(range(1, {P.horizon} + 1)) AS h) hh
  CROSS JOIN cut)""")


_sparse_levels("sv", "train_end")
_sparse_levels("sf", "valid_end")
cte("sparse_validation", ("sv_fc", "slong"), """sparse_validation AS (
  SELECT f.unique_id, f.ds, f.model, f.y_pred, a.y
  FROM sv_fc f LEFT JOIN slong a ON a.unique_id = f.unique_id AND a.ds = f.ds)""")
cte("sparse_forecast", ("sf_fc",),
    "sparse_forecast AS (SELECT unique_id, ds, model, y_pred FROM sf_fc)")


def build(select: str, *deps: str) -> str:
    """WITH <needed CTEs in definition order> <select>."""
    need: set[str] = set()

    def visit(n: str) -> None:
        if n in need:
            return
        for d in CTES[n][0]:
            visit(d)
        need.add(n)

    for d in deps:
        visit(d)
    parts = [body for name, (_, body) in CTES.items() if name in need]
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- high-volume tier -----------------------------------------------------------
cte("hv", ("featured", "tiers"), """hv AS (
  SELECT f.* REPLACE (CAST(is_year_end AS BIGINT) AS is_year_end,
                      CAST(is_lk_holiday_week AS BIGINT) AS is_lk_holiday_week,
                      CAST(returns_exceeded_sales AS BIGINT) AS returns_exceeded_sales)
  FROM featured f WHERE "ProductID" IN (SELECT "ProductID" FROM tiers WHERE tier = 'high_volume'))""")
MODEL_CATS = ("ProductID",) + CATS
cte("cat_dictionary", ("hv",), "cat_dictionary AS (\n" + "\n  UNION ALL\n".join(
    f"""  SELECT '{c}' AS column_name, v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS code
  FROM (SELECT DISTINCT CAST({q(c)} AS VARCHAR) AS v FROM hv WHERE {q(c)} IS NOT NULL) d{i}"""
    for i, c in enumerate(MODEL_CATS)) + ")")
cte("hv_last", ("hv",), """hv_last AS (
  SELECT "ProductID", "Sales_Qty",
         row_number() OVER (PARTITION BY "ProductID" ORDER BY "WeekStart" DESC) AS r FROM hv)""")
cte("hv_state", ("hv", "hv_last"), """hv_state AS (
  SELECT i."ProductID", CAST(s.slot AS BIGINT) AS slot, l."Sales_Qty" AS value
  FROM (SELECT DISTINCT "ProductID" FROM hv) i
  CROSS JOIN (SELECT unnest(range(1, 13)) AS slot) s
  LEFT JOIN hv_last l ON l."ProductID" = i."ProductID" AND l.r = 13 - s.slot)""")
cte("hv_snf", ("hv_state", "cut"), """hv_snf AS (
  SELECT s."ProductID", s.slot AS forecast_week,
         CAST(c.origin + CAST(7 * (s.slot - 1) AS INTEGER) AS DATE) AS "WeekStart",
         greatest(coalesce(s.value, s.last, 0), 0)::DOUBLE AS "predicted_Sales_Qty",
         'seasonal_naive' AS model
  FROM (SELECT *, last_value(value) OVER (PARTITION BY "ProductID" ORDER BY slot
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM hv_state) s
  CROSS JOIN cut c)""")

# --- country drill-down -----------------------------------------------------------
cte("country_weekly", ("tx_w",), """country_weekly AS (
  SELECT "ProductID", "Country", "WeekStart",
         greatest(coalesce(sum("Sales Qty"), 0), 0)::DOUBLE AS "Sales_Qty"
  FROM tx_w GROUP BY "ProductID", "Country", "WeekStart")""")
cte("country_level", ("country_weekly",), f"""country_level AS (
  SELECT "ProductID", "Country", greatest(avg("Sales_Qty"), 0)::DOUBLE AS level, count(*) AS weeks_used
  FROM (SELECT *, row_number() OVER (PARTITION BY "ProductID", "Country" ORDER BY "WeekStart" DESC) AS rn
        FROM country_weekly) t
  WHERE rn <= {P.country_window} GROUP BY "ProductID", "Country")""")
cte("country_forecast", ("country_level", "cut"), f"""country_forecast AS (
  SELECT "ProductID", "Country", CAST(h AS BIGINT) AS forecast_week,
         CAST(cut.origin + CAST(7 * (h - 1) AS INTEGER) AS DATE) AS "WeekStart",
         level AS "predicted_Sales_Qty", 'rolling_mean_last_{P.country_window}_weeks' AS method
  FROM country_level CROSS JOIN (SELECT unnest(range(1, {P.horizon} + 1)) AS h) hh CROSS JOIN cut)""")

# --- metrics ------------------------------------------------------------------------
cte("hv_valid_sn", ("hv", "cut"), """hv_valid_sn AS (
  SELECT "ProductID", "WeekStart", "Sales_Qty" AS y_true, 'seasonal_naive' AS model,
         coalesce("Sales_Qty_lag_12", "Sales_Qty_lag_1", 0)::DOUBLE AS y_pred
  FROM hv, cut WHERE "WeekStart" >= cut.valid_start AND "WeekStart" <= cut.valid_end)""")
cte("scored_all", ("hv_valid_sn", "sparse_validation"), """scored_all AS (
  SELECT 'high_volume' AS tier, model, y_true AS y, y_pred FROM hv_valid_sn
  UNION ALL SELECT 'sparse', model, y, y_pred FROM sparse_validation WHERE y IS NOT NULL)""")
cte("s_scale", ("slong", "cut"), """s_scale AS (
  SELECT unique_id, coalesce(avg(d), 0)::DOUBLE AS scale FROM (
    SELECT s.unique_id, abs(s.y - lag(s.y) OVER (PARTITION BY s.unique_id ORDER BY s.ds)) AS d
    FROM slong s, cut WHERE s.ds <= cut.train_end) t GROUP BY unique_id)""")
cte("s_mase", ("sparse_validation", "s_scale"), """s_mase AS (
  SELECT n.unique_id, n.model,
         CASE WHEN coalesce(sc.scale, 0) = 0 THEN n.num ELSE n.num / sc.scale END AS mase
  FROM (SELECT unique_id, model, avg(abs(y - y_pred)) AS num FROM sparse_validation
        WHERE y IS NOT NULL GROUP BY unique_id, model) n
  LEFT JOIN s_scale sc ON sc.unique_id = n.unique_id)""")
cte("score_sparse", ("sparse_validation", "s_mase"), """score_sparse AS (
  SELECT 'sparse' AS tier, w.model, w.model IN ('Naive') AS is_baseline, w.wmape,
         coalesce(m.mase, 0)::DOUBLE AS mase
  FROM (SELECT model, coalesce(sum(abs(y - y_pred)) / nullif(sum(abs(y)), 0), 0)::DOUBLE AS wmape
        FROM sparse_validation WHERE y IS NOT NULL GROUP BY model) w
  LEFT JOIN (SELECT model, avg(mase) AS mase FROM s_mase GROUP BY model) m ON m.model = w.model)""")

# --- assembly -----------------------------------------------------------------------
cte("sel_sparse", ("sparse_forecast",), f"""sel_sparse AS (
  SELECT unique_id AS "ProductID",
         CAST(row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS BIGINT) AS forecast_week,
         ds AS "WeekStart", y_pred AS "predicted_Sales_Qty", 'sparse' AS tier, model
  FROM sparse_forecast WHERE model = '{P.sparse_model_choice}')""")
cte("sel_hv", ("hv_snf",), """sel_hv AS (
  SELECT "ProductID", forecast_week, "WeekStart", "predicted_Sales_Qty", 'high_volume' AS tier, model
  FROM hv_snf WHERE model = 'seasonal_naive')""")
cte("forecast_12wk", ("sel_hv", "sel_sparse"),
    "forecast_12wk AS (SELECT * FROM sel_hv UNION ALL SELECT * FROM sel_sparse)")

# --- reports -------------------------------------------------------------------------
cte("top_products", ("featured",), f"""top_products AS (
  SELECT "ProductID", total_sales_qty,
         CAST(row_number() OVER (ORDER BY total_sales_qty DESC, "ProductID") AS BIGINT) AS rank
  FROM (SELECT "ProductID", sum("Sales_Qty") AS total_sales_qty FROM featured GROUP BY 1) t
  ORDER BY total_sales_qty DESC, "ProductID" LIMIT {P.top_volume_candidates})""")
cte("decomp_eligible", ("top_products", "featured"), f"""decomp_eligible AS (
  SELECT "ProductID", rank, total_sales_qty, n_weeks, eligible,
         eligible AND sum(CAST(eligible AS BIGINT)) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING)
                      <= {P.top_volume_target} AS selected,
         CASE WHEN NOT eligible THEN 'short_history' END AS reason,
         CAST({P.decomposition_min_weeks} AS BIGINT) AS required_weeks
  FROM (SELECT t.*, w.n_weeks, w.n_weeks >= {P.decomposition_min_weeks} AS eligible
        FROM top_products t LEFT JOIN (SELECT "ProductID", count(*) AS n_weeks FROM featured
                                       GROUP BY 1) w ON w."ProductID" = t."ProductID") x)""")
_half = P.season_length // 2
cte("decomp_base", ("featured",), f"""decomp_base AS (
  SELECT "ProductID", "WeekStart", "Sales_Qty" AS observed,
         row_number() OVER (PARTITION BY "ProductID" ORDER BY "WeekStart") - 1 AS pos,
         count(*) OVER (PARTITION BY "ProductID") AS n
  FROM featured)""")
cte("decomp_trend", ("decomp_base",), f"""decomp_trend AS (
  SELECT *, CASE WHEN pos >= {_half} AND pos < n - {_half} THEN
      (sum(observed) OVER (PARTITION BY "ProductID" ORDER BY "WeekStart"
                           ROWS BETWEEN {_half - 1} PRECEDING AND {_half - 1} FOLLOWING)
       + 0.5 * (lag(observed, {_half}) OVER (PARTITION BY "ProductID" ORDER BY "WeekStart")
                + lead(observed, {_half}) OVER (PARTITION BY "ProductID" ORDER BY "WeekStart")))
      / {P.season_length} END AS trend
  FROM decomp_base WHERE n >= {P.decomposition_min_weeks})""")
cte("decomp", ("decomp_trend",), f"""decomp AS (
  SELECT p."ProductID", p."WeekStart", p.observed, p.trend, pa.avg_d - c.centre AS seasonal,
         p.observed - p.trend - (pa.avg_d - c.centre) AS resid
  FROM decomp_trend p
  JOIN (SELECT "ProductID", pos % {P.season_length} AS phase, avg(observed - trend) AS avg_d
        FROM decomp_trend GROUP BY 1, 2) pa
    ON pa."ProductID" = p."ProductID" AND pa.phase = p.pos % {P.season_length}
  JOIN (SELECT "ProductID", avg(avg_d) AS centre FROM (
          SELECT "ProductID", pos % {P.season_length} AS phase, avg(observed - trend) AS avg_d
          FROM decomp_trend GROUP BY 1, 2) z GROUP BY 1) c ON c."ProductID" = p."ProductID")""")

# --- profiling ----------------------------------------------------------------------
_F = _in_list(P.excluded_ranges)
