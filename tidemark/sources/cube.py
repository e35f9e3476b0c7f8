"""The prediction cube: one surface of it, by pushed-down predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["pair", "timestamp", "surface_id", "surface_version", "state_id", "model", "target_horizon", "feature_set"]


def select_surface(cube: DataFrame, **wanted: str) -> DataFrame:
    """Rows of the wanted surface, renamed to dl_*; a surface that is not there gives an empty table of the same schema."""
    for column, value in wanted.items():
        exact = F.trim(column) if column == "surface_id" else F.col(column)
        cube = cube.filter(exact == value)
    return cube.withColumnsRenamed({"signal_strength": "dl_signal", "pred_prob_up": "dl_prob_up", "timestamp": "ts"})


def available_surfaces(cube: DataFrame) -> DataFrame:
    """What could have been asked for."""
    return cube.select("surface_id", "dl_regime", "model", "target_horizon", "feature_set").distinct()
