"""Training configuration: nested dataclasses, checked on construction, readable from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

NUMERIC_FILLS = ("mean", "median", "knn", "iterative")
CATEGORY_FILLS = ("most_frequent", "constant")
OUTLIER_METHODS = ("iqr", "zscore", "modified_zscore", "isolation_forest", "lof")
TREATMENTS = ("cap", "remove", "flag", "cap_and_flag")
ENCODINGS = ("target", "woe", "count", "hash", "onehot", "ordinal")
SCALERS = ("standard", "minmax", "robust", "maxabs", "power", "none")
TASKS = ("classification", "regression")
IMPORTANCE = ("mutual_info", "tree", "lasso", "shap")
METRICS = ("roc_auc", "f1", "accuracy", "r2", "rmse", "mae")
RESAMPLING = ("none", "smotetomek", "smoteenn", "smote", "smotenc", "adasyn", "oversample", "undersample", "class_weight")
MODELS = ("logistic_regression", "linear_regression", "decision_tree", "random_forest", "boosting", "mlp")


class ConfigError(ValueError):
    """A setting is outside its allowed values."""


def _one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ConfigError(f"{name} is {value!r}; expected one of {list(allowed)}")


def _share(name: str, value: float) -> None:
    if not 0 < value < 1:
        raise ConfigError(f"{name} is {value!r}; expected a number between 0 and 1")


@dataclass
class DataConfig:
    target: str = "target"
    row_id: str = "id"
    drop_columns: list[str] = field(default_factory=list)
    date_columns: list[str] = field(default_factory=list)
    test_size: float = 0.15
    val_size: float = 0.15

    def __post_init__(self):
        _share("test_size", self.test_size)
        _share("val_size", self.val_size)
        if self.test_size + self.val_size >= 1:
            raise ConfigError("test_size and val_size leave no training rows")


@dataclass
class MissingConfig:
    drop_column_above: float = 0.6
    drop_row_above: float | None = None
    numeric: str = "median"
    categorical: str = "most_frequent"
    indicators: bool = True

    def __post_init__(self):
        _one_of("missing.numeric", self.numeric, NUMERIC_FILLS)
        _one_of("missing.categorical", self.categorical, CATEGORY_FILLS)


@dataclass
class OutlierConfig:
    method: str = "iqr"
    threshold: float = 1.5
    treatment: str = "cap"
    contamination: float = 0.05

    def __post_init__(self):
        _one_of("outliers.method", self.method, OUTLIER_METHODS)
        _one_of("outliers.treatment", self.treatment, TREATMENTS)


@dataclass
class EncodingConfig:
    threshold: int = 20
    high: str = "target"
    model_type: str = "tree"
    override: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        _one_of("encoding.high", self.high, ENCODINGS)
        _one_of("encoding.model_type", self.model_type, ("tree", "linear"))


@dataclass
class ScalingConfig:
    scaler: str = "robust"
    auto_transform: bool = True

    def __post_init__(self):
        _one_of("scaling.scaler", self.scaler, SCALERS)


@dataclass
class SelectionConfig:
    variance: float = 0.01
    correlation: float = 0.95
    n_features: int | None = None
    share: float = 0.5
    method: str = "mutual_info"
    eliminate: bool = False

    def __post_init__(self):
        _one_of("selection.method", self.method, IMPORTANCE)


@dataclass
class ModelingConfig:
    task: str = "classification"
    metric: str = "roc_auc"
    models: list[str] = field(default_factory=lambda: ["logistic_regression", "random_forest", "boosting"])
    folds: int = 5
    trials: int = 0
    seconds: float = 3600
    resampling: str = "smotetomek"
    seed: int = 42
    settings: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        _one_of("modeling.task", self.task, TASKS)
        _one_of("modeling.metric", self.metric, METRICS)
        _one_of("modeling.resampling", self.resampling, RESAMPLING)
        for name in self.models:
            _one_of("modeling.models", name, MODELS)


@dataclass
class TrainingConfig:
    data: DataConfig = field(default_factory=DataConfig)
    missing: MissingConfig = field(default_factory=MissingConfig)
    outliers: OutlierConfig = field(default_factory=OutlierConfig)
    engineering: dict = field(default_factory=dict)
    encoding: EncodingConfig = field(default_factory=EncodingConfig)
    scaling: ScalingConfig = field(default_factory=ScalingConfig)
    selection: SelectionConfig = field(default_factory=SelectionConfig)
    modeling: ModelingConfig = field(default_factory=ModelingConfig)

    @classmethod
    def from_dict(cls, values: dict) -> TrainingConfig:
        return _build(cls, values)

    @classmethod
    def from_yaml(cls, path: str) -> TrainingConfig:
        try:
            import yaml
        except ImportError as error:
            raise ConfigError("reading YAML needs pyyaml") from error
        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle) or {})


def _build(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    unknown = set(values) - set(known)
    if unknown:
        raise ConfigError(f"unknown settings {sorted(unknown)} in {kind.__name__}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory
        nested = isinstance(default, type) and is_dataclass(default)
        made[name] = _build(default, value or {}) if nested else value
    return kind(**made)
