"""Column roles, masking settings and their table form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

METHODS = (
    "noise",
    "generalization",
    "differential_privacy",
    "data_swapping",
    "feature_perturbation",
    "hybrid",
)

# The parts of a setting's label and the fields they show.
LABEL_PARTS = (
    ("noise", "noise_std"),
    ("bin", "generalization_bin"),
    ("eps", "epsilon"),
    ("gender_p", "gender_mask_probability"),
    ("dp_fraction", "hybrid_dp_budget_fraction"),
    ("swap", "swap_fraction"),
    ("perturb", "perturbation_strength"),
)

# Tokens that replace a suppressed category.
SUPPRESSED, GENERALIZED, PERTURBED = "Suppressed", "Any", "Perturbed"


@dataclass(frozen=True)
class MaskSpec:
    """Which column plays which role.

    ``numeric`` is a bounded number, ``flag`` a 0/1 value, ``category`` a small
    dictionary of texts with two usual values; these three can be masked. ``carried``
    columns are released as they are. ``row_id`` must be unique: two rows that share it
    would share their noise.
    """

    row_id: str = "row_id"
    numeric: str = "age"
    lower: float = 18.0
    upper: float = 90.0
    numeric_default: float = 39.0
    flag: str = "income"
    category: str = "gender"
    category_pair: tuple[str, str] = ("Female", "Male")
    carried: tuple[str, ...] = ("education", "occupation")
    sensitive: tuple[str, ...] | None = None

    @property
    def maskable(self) -> tuple[str, str, str]:
        return (self.numeric, self.category, self.flag)

    def is_sensitive(self, column: str) -> bool:
        return self.sensitive is None or column in self.sensitive

    @property
    def quasi_identifiers(self) -> tuple[str, ...]:
        return tuple(c for c in self.maskable if self.is_sensitive(c))

    @property
    def numbers(self) -> tuple[str, str]:
        return (self.numeric, self.flag)

    @property
    def texts(self) -> tuple[str, ...]:
        return (self.category, *self.carried)

    @property
    def features(self) -> tuple[str, ...]:
        """Projected features, in report order."""
        return (*self.numbers, *(f"{c}_code" for c in self.texts))

    def present_in(self, columns: Iterable[str]) -> MaskSpec:
        """The same roles for a table that lacks some columns: absent ones are neither masked nor carried."""
        present = set(columns)
        return replace(self, sensitive=tuple(self.identify(present)), carried=tuple(c for c in self.carried if c in present))

    def identify(self, columns: Iterable[str]) -> list[str]:
        """Sensitive columns that are present, in role order."""
        present = set(columns)
        return [c for c in self.quasi_identifiers if c in present]


@dataclass(frozen=True)
class MaskingConfig:
    """One masking setting."""

    method: str
    noise_std: float = 0.0
    generalization_bin: int = 10
    epsilon: float = 1.0
    gender_mask_probability: float = 0.0
    hybrid_dp_budget_fraction: float = 0.7
    swap_fraction: float = 0.0
    perturbation_strength: float = 0.0

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown masking method: {self.method}")

    def label(self) -> str:
        return "|".join([self.method, *(f"{name}={getattr(self, field)}" for name, field in LABEL_PARTS)])

    def key(self) -> str:
        """Short text that ties the random draws to this setting."""
        return hashlib.sha256(self.label().encode()).hexdigest()[:12]

    def total_epsilon(self, attributes: int = 3) -> float | None:
        """Budget spent over all attributes under sequential composition."""
        if self.method == "differential_privacy":
            return attributes * max(self.epsilon, 1e-6)
        if self.method == "hybrid":
            return attributes * max(self.epsilon * self.hybrid_dp_budget_fraction, 1e-6)
        return None


CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("config_id", T.IntegerType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("noise_std", T.DoubleType(), False),
        T.StructField("generalization_bin", T.IntegerType(), False),
        T.StructField("epsilon", T.DoubleType(), False),
        T.StructField("gender_mask_probability", T.DoubleType(), False),
        T.StructField("hybrid_dp_budget_fraction", T.DoubleType(), False),
        T.StructField("swap_fraction", T.DoubleType(), False),
        T.StructField("perturbation_strength", T.DoubleType(), False),
        T.StructField("config_label", T.StringType(), False),
    ]
)


def config_frame(spark: SparkSession, configs: Sequence[MaskingConfig], first_id: int = 0) -> DataFrame:
    """Settings as a table; ``config_id`` is the position in ``configs``."""
    rows = []
    for position, config in enumerate(configs, start=first_id):
        values = asdict(config)
        typed = [
            values[f.name] if f.name in ("method", "generalization_bin") else float(values[f.name])
            for f in fields(MaskingConfig)
        ]
        rows.append((position, *typed, config.label()))
    return spark.createDataFrame(rows, CONFIG_SCHEMA)
