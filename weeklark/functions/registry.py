"""Model registries: order matters, since ties go to the earlier model."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column

from . import models


@dataclass(frozen=True)
class Model:
    """``native`` builds a Column from a horizon; ``python`` is f(history, dates, horizon=52, **kw) -> values; ``batch`` the same over lists, a row each."""

    name: str
    native: Callable[[int], Column] | None = None
    python: Callable | None = None
    batch: Callable | None = None


#: The tournament's models in order.
TOURNAMENT = (
    "seasonal_naive", "weekly_hist_avg", "global_avg", "tsb", "temp_agg_ses", "weighted_seasonal_avg", "seasonal_median",
    "seasonal_naive_blend", "holt_winters", "theta", "imapa", "damped_trend_seasonal", "linear_trend_seasonal",
)
#: Fitted in Python; they take part unless the tier is native.
FITTED = ("holt_winters", "theta", "damped_trend_seasonal")

# The models of each demand class, and the class limits.
ROUTES = {
    "smooth": ("weekly_hist_avg", "weighted_seasonal_avg", "holt_winters"),
    "erratic": ("seasonal_median", "weighted_seasonal_avg", "seasonal_naive_blend"),
    "intermittent": ("tsb", "imapa", "temp_agg_ses"),
    "lumpy": ("tsb", "global_avg"),
}
STATISTICAL = {category: ("sba", "stl_ses") for category in ROUTES}

_registry: dict[str, Model] = {}


def _add(model: Model) -> None:
    _registry[model.name] = model


def register_model(name: str, native: Callable[[int], Column] | None = None):
    """Register a model for the tournament.

    With ``native``, a builder of a Column over the series table; otherwise
    a decorator for a Python function of the contract
    ``f(history, dates, horizon=52, **kwargs) -> array of horizon values``.
    A Python model that raises counts as all NaN.
    """
    if native is not None:
        _add(Model(name, native=native))
        return native

    def decorator(f: Callable) -> Callable:
        _add(Model(name, python=f))
        return f

    return decorator


def unregister_model(name: str) -> None:
    _registry.pop(name, None)


def model(name: str) -> Model:
    return _registry[name]


def known(names: Iterable[str]) -> list[str]:
    """The names that are registered; others are skipped."""
    return [n for n in names if n in _registry]


def order_of(name: str) -> int:
    return list(_registry).index(name)


def tournament_names(tier: str = "full") -> list[str]:
    """tier: full (all thirteen models) or native (the ten that are expressions); user models always take part."""
    if tier not in ("full", "native"):
        raise ValueError("tier must be full or native")
    own = [n for n in TOURNAMENT if tier == "full" or n not in FITTED]
    user = [n for n in _registry if n not in TOURNAMENT and n not in ("sba", "stl_ses")]
    return known(own) + user


def get_models_for_category(category: str, kind: str = "full") -> list[str]:
    """Models routed to a demand class; an unknown class gets all of them."""
    routes = STATISTICAL if kind == "statistical" else ROUTES
    return list(routes.get(category, dict.fromkeys(m for names in routes.values() for m in names)))


def _register_all() -> None:
    from . import fitted

    for name in (*TOURNAMENT, "sba"):
        if name in FITTED:
            _add(Model(name, python=getattr(fitted, name), batch=getattr(fitted, f"{name}_batch")))
        else:
            _add(Model(name, native=getattr(models, name)))
    _add(Model("stl_ses", python=fitted.stl_ses, batch=fitted.stl_ses_batch))


_register_all()
