"""The production path: stages written, guarded, published and read back as the next one's input.

Each stage is written once, to a version of its own, with a ``DataFrame.observe`` riding on the write, so
row counts, sums and sketches of distinct values cost no extra pass. Its guards run on that version; offending rows stop
the run, and the former version stays the published one (see ``store``). What is published replaces the stage
inside the flow, so later stages read files instead of recomputing. A run over the same input and parameters
skips what is published already, so a stopped run goes on where it stopped. Observed values and
wall times become rows of a ``run_metrics(run, stage, key, value)`` table (stages x keys rows).
"""

from __future__ import annotations

import base64
import hashlib
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import NUMERIC_FEATURE_COLUMNS, SPARSE
from ..operators import (assemble, clean, country, intermittent, leakage, profile, regression, report, scope, scoring, tiers,
                         weekly)
from ..sources.tables import write_csv
from .store import Store

# A stage's written form; ``weekly`` and ``featured`` are kept with the columns that later stages need.
DEFAULT_STAGES = ("prepared", "cleaned", "scoped", "weekly", "featured", "tiers", "sparse_validation",
                  "sparse_forecast")
FULL_STAGES = DEFAULT_STAGES + ("dictionary", "hv_validation", "hv_forecast", "model_comparison", "forecast", "country_forecast",
                                "correlation", "zero_profile", "decomposition")
HELD = {"weekly": "weekly_ext", "featured": "featured_full"}
ATTRIBUTES = {"dictionary": "cat_dictionary"}
FORMAT = 1  # of the stages' contents; a new one makes every stage anew


class GuardError(ValueError):
    """A stage holds rows that its guard forbids."""


def _comparison(flow) -> DataFrame:
    history = scoring.train_history(flow.sparse_long, flow.cutoffs.train_end)
    hv = scoring.with_timings(scoring.score_high_volume(flow.hv_validation), flow.hv_timings())
    sparse = scoring.with_timings(scoring.score_sparse(flow.sparse_validation, history), flow.sparse_timings())
    return scoring.model_comparison(hv, sparse)


def _forecast(flow) -> DataFrame:
    p = flow.params
    return assemble.assemble(assemble.select_high_volume(flow.hv_forecast, p.hv_model_choice),
                             assemble.select_sparse(flow.sparse_forecast, p.sparse_model_choice))


def _country(flow) -> DataFrame:
    levels = country.country_level(country.country_weekly(flow.scoped), flow.params.country_window)
    return country.country_forecast(levels, flow.cutoffs.origin, flow.params.horizon)


DERIVED: dict[str, Callable] = {
    "model_comparison": _comparison, "forecast": _forecast, "country_forecast": _country,
    "correlation": lambda f: report.correlation_matrix(f.featured, NUMERIC_FEATURE_COLUMNS),
    "zero_profile": lambda f: report.zero_profile(f.featured, f.tier_ids(SPARSE)),
    "decomposition": lambda f: report.seasonal_decompose(
        f.featured.select("ProductID", "WeekStart", "Sales_Qty"), f.params.season_length,
        f.params.decomposition_min_weeks),
}


def guards(flow, stage: str, written: DataFrame) -> dict[str, DataFrame]:
    """Forbidden rows of a stage, by guard."""
    p = flow.params
    if stage == "prepared":
        found = {"product id": clean.product_id_violations(written), "both dates missing": clean.impute_violations(written)}
        if p.expected_artifacts is not None:
            found["artifact rows"] = clean.artifact_violations(flow.raw, p.expected_artifacts)
        return found
    if stage == "cleaned" and p.split_product_ids:
        return {"split products": scope.named_split_violations(written, p.excluded_ranges, p.split_product_ids)}
    if stage == "scoped":
        return {"excluded range": scope.scope_violations(written, p.excluded_ranges),
                "no order date": weekly.week_floor_violations(written)}
    if stage == "weekly":
        return {"weekly table": weekly.weekly_violations(written)}
    if stage == "featured":
        return {"leakage": leakage.panel_violations(written, p)}
    if stage == "tiers":
        return {"tiers": tiers.tier_violations(written, flow.weekly_ext)}
    if stage == "sparse_forecast":
        return {"sparse horizon": intermittent.horizon_violations(written, p.horizon, flow.tier_ids(SPARSE))}
    if stage == "hv_forecast":
        return {"high-volume forecast": regression.forecast_violations(written, flow.hv_ids, p.horizon)}
    if stage == "forecast":
        return {"assembled forecast": assemble.forecast_violations(written, flow.tiers, p.horizon)}
    if stage == "country_forecast":
        found = {"country forecast": country.country_violations(written, p.horizon)}
        if p.country_limit is not None:
            found["country limit"] = country.country_violations_over_limit(flow.scoped, p.country_limit)
        return found
    return {}


def enforce(found: dict[str, DataFrame]) -> None:
    """Raise on the first guard with offending rows, naming some of them."""
    for name, rows in found.items():
        if some := rows.limit(5).collect():
            raise GuardError(f"{name}: " + "; ".join(str(r.asDict()) for r in some))


BUCKETED = ("weekly", "featured")  # read by product in every later stage
SKETCHED = ("ProductID", "Country")  # distinct values of these columns are sketched in every stage that has them


def _fingerprint(flow, store: Store, stage: str) -> str | None:
    """What a stage is made from: the input's files, the parameters and the stage's name. None: not known."""
    if flow.source_path is None:
        return None
    if not hasattr(flow, "_source_fingerprint"):
        flow._source_fingerprint = store.fingerprint(flow.source_path)
    holidays = flow._holidays.semanticHash() if flow._holidays is not None else 0
    return hashlib.sha256(repr((FORMAT, stage, flow._source_fingerprint, holidays, flow.params)).encode()).hexdigest()


def write_stages(flow, out_dir: str, stages: Sequence[str] = DEFAULT_STAGES, run_id: str | None = None) -> DataFrame:
    """Write, guard and publish the stages in order; returns ``run, stage, key, value``. A stage whose published version
    was made from the same input and parameters is not made again."""
    run_id = run_id or uuid.uuid4().hex[:12]
    store, rows = Store(flow.spark, out_dir), []
    if flow.rejects is not None:
        stages = ("rejects", *stages)
    for name in stages:
        held = HELD.get(name, name)
        print_ = _fingerprint(flow, store, name)
        manifest = store.manifest(name)
        if print_ is not None and manifest is not None and manifest["fingerprint"] == print_:
            rows.append((run_id, name, "skipped", 1.0))
        else:
            if name == "dictionary" and manifest is not None:
                flow.former_dictionary = store.read(manifest)
            manifest = _made(flow, store, name, run_id, print_)
        rows += [(run_id, name, k, v) for k, v in manifest["metrics"].items()]
        if name not in DERIVED:
            flow.__dict__[ATTRIBUTES.get(held, held)] = store.read(manifest)
            flow.read_back.add(held)
    return flow.spark.createDataFrame(rows, "run string, stage string, key string, value double")


def _made(flow, store: Store, name: str, run_id: str, print_: str | None) -> dict:
    """Write a stage to a version of its own, guard it there, and publish it."""
    held = HELD.get(name, name)
    df: DataFrame = DERIVED[name](flow) if name in DERIVED else getattr(flow, ATTRIBUTES.get(held, held))
    obs = Observation(f"{name}_{run_id}")
    aggs = [F.count(F.lit(1)).alias("rows")]
    if "Sales_Qty" in df.columns:
        aggs.append(F.sum(F.col("Sales_Qty").cast("double")).alias("sum_Sales_Qty"))
    sketched = [c for c in SKETCHED if c in df.columns]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), profile.LG_K).alias(f"sketch {c}") for c in sketched]
    t = time.perf_counter()
    path = store.staging(name)
    try:
        buckets = int(flow.spark.conf.get("spark.sql.shuffle.partitions")) if name in BUCKETED else 0
        entry = store.write(df.observe(obs, *aggs), path, buckets, order=("WeekStart",))
        seconds = time.perf_counter() - t
        enforce(guards(flow, name, store.read(entry)))
    except BaseException:
        store.delete(path)
        raise
    seen = obs.get
    metrics = {k: float(v) if v is not None else None for k, v in seen.items() if not k.startswith("sketch ")} | {"seconds": float(seconds)}
    sketches = {c: base64.b64encode(bytes(seen[f"sketch {c}"])).decode() for c in sketched if seen[f"sketch {c}"] is not None}
    manifest = entry | {"stage": name, "run": run_id, "fingerprint": print_, "parameters": repr(flow.params), "metrics": metrics,
                        "sketches": sketches}
    store.publish(name, manifest)
    return manifest


def read_stage(spark, out_dir: str, stage: str) -> DataFrame:
    """A published stage of a folder."""
    return Store(spark, out_dir).read(stage)


def distinct_estimates(spark, out_dirs: Sequence[str], stage: str) -> DataFrame:
    """``column_name, n_distinct`` over a stage of several folders (such as one a month), from the sketches in their
    manifests; no row is read."""
    rows = [(c, bytearray(base64.b64decode(x))) for d in out_dirs for c, x in (Store(spark, d).manifest(stage) or {"sketches": {}})["sketches"].items()]
    return profile.merged_distinct(spark.createDataFrame(rows, "column_name string, sketch binary"))


def run(flow, out_dir: str) -> DataFrame:
    """Every stage and output of a flow, the forecast also as CSV; returns the run's metrics."""
    metrics = write_stages(flow, out_dir, FULL_STAGES)
    write_forecast_csv(read_stage(flow.spark, out_dir, "forecast"), f"{out_dir.rstrip('/')}/forecast_csv")
    return metrics


def write_forecast_csv(fc: DataFrame, out_dir: str) -> None:
    """The assembled forecast as CSV parts that are in order one after the other."""
    write_csv(assemble.sorted_for_sink(fc), out_dir)
