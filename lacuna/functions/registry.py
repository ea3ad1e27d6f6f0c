"""Names for imputers and metrics, open to plugins."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable


class Registry(dict[str, Callable]):
    """A function for each name; empty names and names taken are refused.

    A class of a plugin is registered as what it can do: one with `complete` fills, one with `compute` scores.
    """

    def register(self, name: str) -> Callable[[Callable], Callable]:
        if not name.strip():
            raise ValueError("a name must not be empty")
        if name in self:
            raise ValueError(f"{name} is registered already")

        def add(f: Callable) -> Callable:
            if isinstance(f, type):
                _add_class(self, name, f)
            else:
                self[name] = f
            return f

        return add

    def named(self, name: str) -> Callable:
        if name not in self:
            raise KeyError(f"{name} is unknown; known are {', '.join(sorted(self))}")
        return self[name]


#: cells -> cells with `pred`: f(cells, keys=..., **params)
IMPUTERS = Registry()
#: aggregate columns over scored cells: f(truth, pred, **params)
METRICS = Registry()
#: metrics that need whole tables: f(cells with `truth`, `pred` and `split`, keys, **params) -> keys and the metric
TABLE_METRICS = Registry()


def _add_class(registry: Registry, name: str, cls: type) -> None:
    from lacuna.functions import plugins

    if registry is IMPUTERS and hasattr(cls, "complete"):
        IMPUTERS[name] = plugins.imputer_of(cls)
    elif any(registry is r for r in (METRICS, TABLE_METRICS)) and hasattr(cls, "compute"):
        if name in METRICS or name in TABLE_METRICS:
            raise ValueError(f"{name} is registered already")
        TABLE_METRICS[name] = plugins.metric_of(cls, name)
    else:
        raise TypeError(f"{cls.__name__} has neither `complete` for an imputer nor `compute` for a metric")


def load_plugins(modules: list[str]) -> None:
    for module in modules:
        importlib.import_module(module)


def parameters(text: str | None) -> dict:
    """Keyword arguments from a JSON object."""
    value = json.loads(text) if text else {}
    if not isinstance(value, dict):
        raise ValueError("parameters must be a JSON object")
    return value
