"""What to build: one record of parameters per level of the index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from nearpath.plans.clustering import ClusteringAlgorithm, clustering_algorithm
from nearpath.plans.kmeans import SEED

# Labelled rows a node's classifier is trained on at most, so that a fit is one
# task; None trains on all rows. Clusters come from all rows either way, and the
# classifier then places every row.
TRAIN_ROWS = 50_000
MIN_TRAIN_ROWS = 32

SOLVERS = ("adam", "gd")


@dataclass(frozen=True)
class ModelParameters:
    clustering_algorithm: ClusteringAlgorithm
    model_type: str
    epochs: int
    lr: float
    n_categories: int
    solver: str = "adam"
    class_weights: tuple[tuple[int, float], ...] = ()


def _per_level(name: str, value, n_levels: int) -> list:
    if not isinstance(value, (list, tuple)):
        return [value] * n_levels
    if len(value) == 1:
        return list(value) * n_levels
    if len(value) != n_levels:
        raise ValueError(f"{name} has {len(value)} values for {n_levels} levels")
    return list(value)


@dataclass
class BuildConfig:
    """Parameters of a build; single values stand for every level.

    The first four are either all lists (of length one, or one value per
    level) or all single values. ``class_weights`` weighs the classes of every
    node while it is trained. ``train_rows=None`` trains every node on all of its
    rows: ``epochs`` then counts evaluations of a full-batch descent, and ``solver``
    and ``lr`` have no say. ``allow_missing`` accepts nodes that predict fewer
    classes than they were trained with; otherwise the build fails.
    """

    clustering_algorithms: str | ClusteringAlgorithm | Sequence
    epochs: int | Sequence[int]
    model_types: str | Sequence[str]
    lrs: float | Sequence[float]
    n_categories: Sequence[int]
    solver: str = "adam"
    train_rows: int | None = TRAIN_ROWS
    class_weights: dict[int, float] | None = None
    allow_missing: bool = False
    seed: int = SEED
    levels: list[ModelParameters] = field(init=False, repr=False)

    def __post_init__(self):
        from nearpath.operators.score import MODEL_KINDS
        from nearpath.plans.models import hidden_layers

        self.n_categories = list(self.n_categories)
        if not self.n_categories or min(self.n_categories) < 1:
            raise ValueError("an index needs one or more levels, each of one or more classes")
        if self.train_rows is not None and self.train_rows < MIN_TRAIN_ROWS:
            raise ValueError(f"train_rows must be at least {MIN_TRAIN_ROWS}")
        if self.solver not in SOLVERS:
            raise ValueError(f"unknown solver {self.solver!r}, expected one of {SOLVERS}")
        names = ("clustering_algorithms", "epochs", "model_types", "lrs")
        given = [getattr(self, name) for name in names]
        lists = [isinstance(value, (list, tuple)) for value in given]
        if any(lists) and not all(lists):
            raise ValueError(f"mixed lists and single values: {', '.join(names)}")
        for name, value in zip(names, given):
            setattr(self, name, _per_level(name, value, self.n_levels))
        for model_type in self.model_types:
            hidden_layers(model_type)
        self.levels = [
            ModelParameters(
                clustering_algorithm(algorithm), model_type, epochs, lr, n, self.solver,
                tuple(sorted((self.class_weights or {}).items())),
            )
            for algorithm, model_type, epochs, lr, n in zip(
                self.clustering_algorithms, self.model_types, self.epochs, self.lrs,
                self.n_categories,
            )
        ]

        if self.train_rows is None:
            # a user's own function needs the rows of a node in one task
            if any(level.model_type in MODEL_KINDS for level in self.levels):
                raise ValueError("train_rows=None needs one of the model presets")
            if any(level.clustering_algorithm.label is not None for level in self.levels):
                raise ValueError("train_rows=None needs a clustering of all rows, not a function")

    @property
    def n_levels(self) -> int:
        return len(self.n_categories)

    @property
    def clustering_names(self) -> list[str]:
        return [c if isinstance(c, str) else "custom" for c in self.clustering_algorithms]
