"""All public names in one place."""

from .functions.metrics import calculate_mase, calculate_wape, classify_history
from .functions.registry import get_models_for_category, register_model, unregister_model
from .operators.activity import flag_inactive_items
from .operators.classify import classify_demand, route_models
from .operators.diagnostics import get_diagnostics
from .operators.evaluate import evaluate_benchmarks, select_best_fit, summarize_results
from .operators.series import densify_weekly
from .plans.pipeline import best_fit_pipeline, best_fit_pipeline_parallel, forecast_winners
from .plans.routed import generate_fold_details
from .sources.tables import read_demand, write_csv

evaluate_benchmarks_parallel = evaluate_benchmarks

__all__ = [
    "best_fit_pipeline", "best_fit_pipeline_parallel", "calculate_mase", "calculate_wape", "classify_demand", "classify_history", "densify_weekly",
    "evaluate_benchmarks", "evaluate_benchmarks_parallel", "flag_inactive_items", "forecast_winners", "generate_fold_details", "get_diagnostics",
    "get_models_for_category", "read_demand", "register_model", "route_models", "select_best_fit", "summarize_results", "unregister_model", "write_csv",
]
