"""Settings of a run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from strideline.functions.features import default_catalogue
from strideline.ordering import SLICE_ROWS


@dataclass
class Settings:
    axes: list[str] = field(default_factory=lambda: ["acceleration_x", "acceleration_y", "acceleration_z"])
    reduction: str = "euclidean"
    freq: str = "1000ms"
    coarse_labels: list = field(default_factory=lambda: [5.0])
    road_labels: list = field(default_factory=lambda: [1.0, 3.0])
    shares: tuple[float, float, float] = (0.5, 0.25, 0.25)
    quantile: float = 0.99
    extractor: str = "statistical"
    block_rows: int = 60
    catalogue: dict = field(default_factory=default_catalogue)
    fdr_level: float = 0.01
    radii: list = field(default_factory=lambda: [1, 5, 10, 100, 150, 200])
    lengths: list = field(default_factory=lambda: [10, 25, 50, 100, 150, 200])
    max_motifs: int = 2
    contamination: float = 0.01
    trees: int = 750
    tree_rows: int = 5
    class_bounds: tuple[float, float] = (0.25, 0.75)
    models: list = field(default_factory=lambda: ["svc", "cart_tree", "random_forrest", "mlp_classifier"])
    space: dict = field(default_factory=dict)
    draws: int = 50
    folds: int = 5
    seed: int = 0
    slice_rows: int = SLICE_ROWS


#: What the stages of a run depend on.
PREPARATION = ("axes", "reduction", "freq", "coarse_labels", "road_labels", "shares", "quantile", "slice_rows")
FEATURES = {
    "statistical": (*PREPARATION, "extractor", "block_rows", "catalogue", "fdr_level"),
    "motif": (*PREPARATION, "extractor", "radii", "lengths", "max_motifs"),
}


def digest(settings: Settings, fields: tuple[str, ...] | None = None) -> str:
    """Stands for the settings, or for some fields of them."""
    values = {k: v for k, v in asdict(settings).items() if fields is None or k in fields}
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:12]
