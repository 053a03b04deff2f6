"""Value objects of the driver: tasks, roles, category tables, the learned schema."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from enum import StrEnum

from .errors import ConfigError, SchemaError


class Role(StrEnum):
    NUMERIC = "numeric"
    CATEGORICAL = "categorical"
    DATETIME = "datetime"
    TEXT = "text"
    TARGET = "target"
    GROUP = "group"
    TIME = "time"
    FOLD = "fold"
    IGNORE = "ignore"


DEFAULT_METRIC = {"binary": "roc_auc", "multiclass": "log_loss", "regression": "rmse"}


@dataclass(frozen=True)
class Task:
    """Kind of target and the thresholds that type columns."""

    kind: str
    metric: str | None = None
    positive: object = None
    cat_max_unique: int = 20
    id_rate: float = 0.95
    id_min_unique: int = 100
    str_id_rate: float = 0.95
    str_id_min_unique: int = 100
    native_cat_max_unique: int | None = 64

    def __post_init__(self) -> None:
        if self.kind not in DEFAULT_METRIC:
            raise ConfigError(f"task {self.kind!r} is none of {sorted(DEFAULT_METRIC)}")

    @property
    def is_classification(self) -> bool:
        return self.kind != "regression"

    @property
    def scorer(self) -> str:
        return self.metric or DEFAULT_METRIC[self.kind]

    def resolve_positive(self, labels: list) -> object:
        """The named label, else 1 if it occurs, else the greatest."""
        if self.positive is not None:
            if self.positive not in labels:
                raise SchemaError(f"positive label {self.positive!r} does not occur")
            return self.positive
        return 1 if 1 in labels else max(labels)


@dataclass(frozen=True)
class CategoryTable:
    """Keys in code order; the next two codes stand for null and for unseen keys."""

    keys: tuple[str, ...]

    @property
    def null_code(self) -> int:
        return len(self.keys)

    @property
    def unknown_code(self) -> int:
        return len(self.keys) + 1

    def code(self, key: str | None) -> int:
        return self.null_code if key is None else self.keys.index(key) if key in self.keys else self.unknown_code


@dataclass(frozen=True)
class FeatureSchema:
    """Roles, category tables and feature specs, learned once and applied alike at training and scoring."""

    roles: dict[str, str] = field(default_factory=dict)
    dtypes: dict[str, str] = field(default_factory=dict)
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    deltas: dict[str, str] = field(default_factory=dict)  # date column -> report column
    crosses: tuple[tuple[str, str], ...] = ()
    frequency: dict[str, dict[int, float]] = field(default_factory=dict)
    target: dict[str, dict] = field(default_factory=dict)  # column -> {"global": g, "values": {code: v}}
    selected: tuple[str, ...] | None = None

    def of(self, role: Role) -> list[str]:
        return [c for c, r in self.roles.items() if r == role]

    @property
    def numeric(self) -> list[str]:
        return [*self.of(Role.NUMERIC), *(f"{c}__days_to_report" for c in self.deltas), *(f"{c}_freq" for c in self.frequency), *(f"{c}_te" for c in self.target)]

    @property
    def categorical(self) -> list[str]:
        return [*self.of(Role.CATEGORICAL), *(f"{a}__{b}" for a, b in self.crosses)]

    @property
    def features(self) -> list[str]:
        full = self.numeric + self.categorical
        return full if self.selected is None else [f for f in full if f in set(self.selected)]

    def select(self, names: list[str]) -> FeatureSchema:
        if stray := set(names) - set(self.numeric + self.categorical):
            raise SchemaError(f"unknown features {sorted(stray)}")
        if not names:
            raise SchemaError("at least one feature is needed")
        return replace(self, selected=tuple(names))

    def native(self, cap: int | None) -> list[str]:
        """Categoricals that tree models take as nominal: those with at most `cap` categories (None: all)."""
        return [c for c in self.categorical if cap is None or len(self.categories.get(c, ())) <= cap]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FeatureSchema:
        d = json.loads(text)
        ints = lambda m: {int(k): v for k, v in m.items()}
        return cls(
            roles=d["roles"], dtypes=d["dtypes"], categories={k: tuple(v) for k, v in d["categories"].items()}, deltas=d["deltas"], crosses=tuple(tuple(p) for p in d["crosses"]),
            frequency={k: ints(v) for k, v in d["frequency"].items()}, target={k: {"global": v["global"], "values": ints(v["values"])} for k, v in d["target"].items()},
            selected=tuple(d["selected"]) if d["selected"] is not None else None,
        )
