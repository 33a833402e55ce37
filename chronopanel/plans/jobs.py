"""The composite jobs, each one chain of the operators with its sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession

from ..contracts import Contracts
from ..operators import eda, learned, quality, results
from ..operators.audits import publication_audit
from ..operators.features import availability, build_features, feature_report
from ..operators.panel import build_panel, join_report
from ..operators.profile import dictionary
from ..operators.rows import Staged
from ..operators.split import assign_split, split_report
from ..operators.target import add_target, modelling_rows, target_report
from ..schema import ENTITY, KEY
from ..session import land, new_folder
from ..sources import io
from ..sources.staging import staging_report

SOURCES = ("entities", "housing", "mortgage_rate", "unemployment")


def panel_from(staged: dict[str, Staged | DataFrame], contracts: Contracts, by_entity: bool = False) -> DataFrame:
    """Staged sources -> panel with its target columns; ``by_entity`` for a panel to be landed ``co_located``."""
    tables = [getattr(staged[s], "table", staged[s]) for s in SOURCES]
    span = staged["housing"].span if isinstance(staged["housing"], Staged) else None
    return add_target(build_panel(*tables, contracts, by_entity, span), contracts.target)


def rebuild(spark: SparkSession, staged: dict[str, Staged], contracts: Contracts, folder: str) -> dict[str, DataFrame]:
    """Staged tables, panel and modelling rows on disk, with every report.

    Failed ERROR checks stop the job before the panel is published under ``folder``.
    Their counts are observed while the panel is landed; only its keys are read
    again for them.
    """
    paths = io.write_tables({s: staged[s].table for s in SOURCES}, folder, "stg_")
    tables = {s: io.read_table(spark, p) for s, p in paths.items()}
    built, seen = panel_from(tables, contracts, by_entity=True), Observation("panel checks")
    panel = land(
        built, "panel", bucket_by=ENTITY, sort_by=KEY, co_located=True, observe=(seen, quality.additive_counts(built.columns, contracts)))
    checks = quality.check_panel(panel, contracts, seen.get)
    failed = quality.failed_errors(checks)
    if failed:
        raise ValueError(f"panel not written; failed checks: {', '.join(failed)}")
    io.write_table(panel, f"{folder}/panel.parquet")
    io.write_table(modelling_rows(panel), f"{folder}/modelling_rows.parquet")
    return {
        "panel": panel,
        "checks": checks,
        "staging": staging_report([staged[s] for s in SOURCES]),
        "joins": join_report(*[tables[s] for s in SOURCES]),
        "target": target_report(panel),
        "dictionary": dictionary(panel, contracts.registry),
    }


def feature_job(panel: DataFrame, contracts: Contracts, folder: str | None = None) -> dict[str, DataFrame]:
    """Feature matrix, its accounting and the publication audit; a leak stops the job."""
    c = contracts.features
    audit = publication_audit(panel, c)
    leaks = [r["feature"] for r in audit.filter("leaks").select("feature").collect()]
    if leaks:
        raise ValueError(f"features read values published after the cutoff: {', '.join(leaks)}")
    features = land(build_features(panel, c), "features", bucket_by=ENTITY, sort_by=KEY)
    if folder:
        io.write_table(features, f"{folder}/features.parquet")
    return {
        "features": features, "audit": audit, "report": feature_report(features, c), "availability": availability(features, c),
    }


def training_job(features: DataFrame, contracts: Contracts, folder: str | None = None, ablation: bool = True) -> dict:
    """Split, fit, select, refit, predict; predictions are saved partitioned by split."""
    split = land(assign_split(features, contracts.split, contracts.features), "split", bucket_by=ENTITY, sort_by=KEY)
    run = learned.train_and_score(split, contracts.features, contracts.target.tau, ablation)
    path = f"{folder}/predictions.parquet" if folder else new_folder(split.sparkSession, "predictions")
    io.write_table(run.predictions, path, partition_by=["split"])
    return {"predictions": split.sparkSession.read.parquet(path), "run": run, "split": split_report(split), "path": path}


def eda_job(panel: DataFrame, contracts: Contracts) -> dict[str, DataFrame]:
    model = modelling_rows(panel)
    return {
        "distribution": eda.describe_target(model), "prevalence": eda.prevalence(model),
        "by_year": eda.prevalence_by_year(model), "by_tier": eda.prevalence_by_tier(model, contracts.target),
        "by_entity": eda.prevalence_by_entity(model), "dispersion": eda.dispersion(model),
        "excluded": eda.excluded_dispersion(panel), "coverage": eda.coverage_summary(panel),
        "missingness": quality.missingness(panel, contracts.registry), "outliers": eda.outliers(panel, contracts.registry),
        "seasonality": eda.seasonality(model), "regime_series": eda.regime_series(model),
        "regime_shifts": eda.regime_shifts(model), "rate_regimes": eda.rate_regimes(model, contracts),
        "representatives": eda.representatives(model), "histogram": eda.histogram(model),
    }


def results_job(predictions: DataFrame, contracts: Contracts, magnitude: str = results.RIDGE, direction: str = results.LOGISTIC) -> dict[str, DataFrame]:
    """Every result table from saved predictions; nothing is refitted."""
    t = contracts.target
    return {
        "headline": results.headline(predictions), "concise": results.concise(predictions),
        "tiers": results.tier_table(predictions, magnitude, direction, t),
        "entities": results.by_entity(predictions, magnitude),
        "base_effect": results.base_effect_correlation(predictions, magnitude),
        "intervals": results.interval_table(
            predictions, {magnitude: ("mae",), direction: ("macro_f1",), "base_effect": ("mae",)}, contracts.bootstrap
        ),
        "claims": results.claim_facts(predictions, t, magnitude, direction),
        "full": results.full_tables(predictions),
        "breakdown": results.breakdown(predictions, [magnitude, direction], t),
        "confusion": results.confusion_tables(predictions, [direction, magnitude]),
    }
