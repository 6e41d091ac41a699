"""Column roles and job options.

The engine works on one observation table: one row per congested segment in
a time slot. Column names are configurable through ``Roles``; the defaults
are those of the ``raw_obs`` fixture. Options are frozen: derived facts
(transform applied, dropped columns, ...) are returned, never written back.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Feature:
    """How a column may enter a model."""

    column: str
    numeric: bool = True
    stands_in_for: str | None = None  # used only where that column is not
    option: str | None = None  # the model option that lets it in
    rare: bool = False  # infrequent levels are bucketed


@dataclass(frozen=True)
class Roles:
    """Names of the input and derived columns."""

    key: str = "obs_id"
    seg_id: str = "seg_id"
    district: str = "district"
    street: str = "street"
    day: str = "day_text"
    start: str = "start_text"
    end: str = "end_text"
    duration_text: str = "dur_text"
    x: str = "x_text"
    y: str = "y_text"
    z: str = "z_text"
    rank: str = "rank_text"
    length: str = "length_text"
    speed: str = "speed_text"

    # typed / derived names
    x_num: str = "x"
    y_num: str = "y"
    z_num: str = "z"
    rank_num: str = "rank"
    length_num: str = "length"
    speed_num: str = "speed"
    dt_start: str = "dt_start"
    dt_end: str = "dt_end"
    duration_min: str = "duration_min"
    peak: str = "peak"
    hour_sin: str = "hour_sin"
    hour_cos: str = "hour_cos"
    label: str = "target_bin"
    length_log1p: str = "length_log1p"
    length_winsor: str = "length_winsor"

    def text_columns(self) -> list[str]:
        """Text columns that are stripped and cleaned."""
        return [self.street, self.district, self.day, self.end, self.start, self.seg_id, self.duration_text]

    def numeric_text(self) -> list[tuple[str, str]]:
        """(raw text column, typed double column) pairs."""
        return [
            (self.x, self.x_num),
            (self.y, self.y_num),
            (self.z, self.z_num),
            (self.rank, self.rank_num),
            (self.length, self.length_num),
            (self.speed, self.speed_num),
        ]

    def numeric_order(self) -> list[str]:
        """Numeric columns in report order."""
        return [
            self.x_num,
            self.y_num,
            self.z_num,
            self.rank_num,
            self.length_num,
            self.length_log1p,
            self.length_winsor,
            self.speed_num,
            self.duration_min,
            self.hour_sin,
            self.hour_cos,
        ]

    def categorical(self) -> list[str]:
        return [self.street, self.district, self.seg_id, self.peak]

    def features(self) -> list[Feature]:
        """Columns that models may use, in model order; no other column is a
        feature. The raw length serves where its logarithm does not."""
        numeric = [Feature(c) for c in self.numeric_order() if c != self.length_num]
        return [
            *numeric,
            Feature(self.length_num, stands_in_for=self.length_log1p),
            Feature(self.street, numeric=False, option="use_street", rare=True),
            Feature(self.district, numeric=False, rare=True),
            Feature(self.seg_id, numeric=False, option="use_seg_id", rare=True),
            Feature(self.peak, numeric=False),
        ]

    def parents(self) -> dict[str, str]:
        """Target columns that are computed from another column."""
        return {self.label: self.speed_num}


# Fixed values that must equal the reference for equal results.
PEAK_LABEL = "Punta"
OFF_PEAK_LABEL = "Valle"
HIGH_CONGESTION_LABEL = "Alta"
NORMAL_LABEL = "Normal"
HIGH_CONGESTION_SPEED = 20.0
MISSING_LABEL = "Desconocido"
RARE_LABEL = "__RARE__"
MISSING_TEXT_TOKENS = ("nan", "None")
PEAK_WINDOWS = ((7.0, 10.0), (17.0, 20.0))


@dataclass(frozen=True)
class PrepareOptions:
    """Options of the cleaning step."""

    length_transform: str = "log1p"  # none | log1p | winsor
    target: str | None = None  # explicit target: protected from the constant drop
    sum_duration_parts: bool = False  # reference: '1 h 30 min' is 1 h / 30 min, not summed
    winsor_low: float = 0.01
    winsor_high: float = 0.99


@dataclass(frozen=True)
class ModelOptions:
    """Options of the modelling flows."""

    target: str | None = None
    task: str = "auto"  # auto | reg | clf
    test_size: float = 0.2
    seed: int = 42
    rare_threshold: float = 0.01
    use_street: bool = False
    use_seg_id: bool = False
    vif_threshold: float = 10.0
    vif_max_cols: int | None = 70  # no VIF table beyond so many numeric features; None: no bound
    folds: int = 5
    max_selected: int = 10
    exclude_parents: bool = True  # drop the speed column when its label is the target
    top_categories: int = 20
    exact_split: bool = True
    normality_test: str = "auto"  # auto | shapiro | ks (target) or k2 (residuals); auto: Shapiro-Wilk up to shapiro_max_n rows
    shapiro_max_n: int = 5000
    point_limit: int | None = None  # largest number of QQ points kept per variable; None: all
    grid_bins: int = 100  # cells per side of the residual grids

    def __post_init__(self):
        if not 0 < self.test_size < 1:
            raise ValueError("test_size must be between 0 and 1")
        if self.vif_threshold <= 0:
            raise ValueError("vif_threshold must be > 0")

    def with_(self, **kw) -> "ModelOptions":
        return replace(self, **kw)
