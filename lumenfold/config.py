"""Settings from a JSON file (YAML where a reader for it is installed), with the checks that a deployment needs."""

from __future__ import annotations

import json
from pathlib import Path

from .operators.select import LAMBDAS
from .operators.trees import RELATION_COSTS
from .plans.systems import Setting

#: Dimensions that indexes are built for.
DIMENSION, GRAPH_DIMENSION = 2048, 256


def load(path: str) -> dict:
    """The file's mapping; anything but a mapping at its top is an error."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("settings must be a mapping")
    return found


def check(settings: dict) -> None:
    """Dimensions other than those of the indexes are an error."""
    dense = settings.get("embedding", {}).get("dimension", DIMENSION)
    graph = settings.get("graph_index", {}).get("hidden_dimension", GRAPH_DIMENSION)
    if dense != DIMENSION or graph != GRAPH_DIMENSION:
        raise ValueError(f"dimensions must be {DIMENSION} and {GRAPH_DIMENSION}, not {dense} and {graph}")


def setting_of(settings: dict) -> Setting:
    """What selection and recall take from the settings."""
    s = settings.get("retrieval", settings)
    return Setting(
        per_type_k=int(s.get("per_type_top_k", 25)), top_k=int(s.get("top_k", 10)), budget=int(s.get("budget", 4096)), image_unit=int(s.get("image_unit", 512)), scales=tuple(s.get("lambda_values", LAMBDAS))
    )


def relation_costs(settings: dict) -> dict[str, float]:
    return RELATION_COSTS | {k: float(v) for k, v in settings.get("retrieval", settings).get("relation_costs", {}).items()}
