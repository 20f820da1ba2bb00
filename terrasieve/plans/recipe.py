"""Feature recipes: fitted on training rows, then plain projections."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import stats

#: Recipes and what they residualise: nothing, the columns that a rank screen
#: finds sensitive, those of a graph, their union, or all geochemistry.
RECIPES = ("Full", "CoreGeo", "NoClimate", "M3_Broad", "M4_Spearman", "M4_GraphGuided", "M4_GraphUnion")

#: Controls of the selection itself, without residuals.
SELECTIONS = ("DropSelected", "SelectedRawOnly")


@dataclass
class FeatureRecipe:
    """Raw columns and residuals of ``residual`` columns, in a fixed order:
    residuals first, each part in catalogue order."""

    name: str
    raw: list[str]
    residual: list[str] = field(default_factory=list)
    climate: list[str] = field(default_factory=list)
    alpha: float = 10.0
    residualizer: stats.Residualizer | None = None

    def fit(self, train: DataFrame) -> FeatureRecipe:
        if self.residual and self.climate:
            self.residualizer = stats.Residualizer(self.residual, self.climate, self.alpha).fit(train)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.residualizer.transform(df) if self.residualizer else df

    @property
    def output_columns(self) -> list[str]:
        made = [c + self.residualizer.suffix for c in self.residual] if self.residualizer else []
        return made + self.raw


def sensitive_columns(train: DataFrame, targets: Sequence[str], climate: Sequence[str], threshold: float = 0.30) -> list[str]:
    """Targets that the rank screen of the training rows finds sensitive."""
    screen = stats.spearman_screen(stats.spearman_pairs(train, targets, climate), threshold, covariates=climate)
    found = {r["target_column"] for r in screen.where("is_spearman_sensitive").collect()}
    return [t for t in targets if t in found]


def columns_of(name: str, sets: Mapping[str, Sequence[str]], sensitive: Collection[str] = (), graph: Collection[str] = ()) -> tuple[list[str], list[str]]:
    """The raw and the residualised columns of a recipe, in catalogue order.

    Besides ``RECIPES``: DropSelected leaves the sensitive columns out,
    SelectedRawOnly keeps nothing else."""
    if name not in (*RECIPES, *SELECTIONS):
        raise ValueError(f"unknown recipe {name}")
    if name in ("Full", "CoreGeo", "NoClimate"):
        return list(sets[{"Full": "full", "CoreGeo": "core_geo", "NoClimate": "no_climate"}[name]]), []
    base = sets["no_climate"]
    if name == "SelectedRawOnly":
        return [c for c in base if c in sensitive], []
    if name == "DropSelected":
        return [c for c in base if c not in sensitive], []
    chosen: set[str] = set()
    if name == "M3_Broad":
        chosen |= set(sets["geochemistry"])
    if name in ("M4_Spearman", "M4_GraphUnion"):
        chosen |= set(sensitive)
    if name in ("M4_GraphGuided", "M4_GraphUnion"):
        chosen |= set(graph)
    return [c for c in base if c not in chosen], [c for c in base if c in chosen]


def make_recipe(name: str, train: DataFrame, sets: dict[str, list[str]], graph: Sequence[str] = (), threshold: float = 0.30) -> FeatureRecipe:
    """A recipe by name, unfitted, its columns chosen on training rows only."""
    screened = name in ("M4_Spearman", "M4_GraphUnion", *SELECTIONS)
    sensitive = sensitive_columns(train, sets["geochemistry"], sets["climate_adjusters"], threshold) if screened else ()
    raw, residual = columns_of(name, sets, sensitive, graph)
    return FeatureRecipe(name, raw, residual, list(sets["climate_adjusters"]) if name.startswith("M") else [])
