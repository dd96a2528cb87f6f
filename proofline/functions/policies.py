"""Policy objects and tables. Values that results depend on are stated as given."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import asdict, dataclass, fields

#: Penalties, module weights, ranks and the order of modules.
PENALTY = {"INFO": "2", "LOW": "8", "MEDIUM": "20", "HIGH": "45", "CRITICAL": "75"}
WEIGHT = {"dataset_integrity": "0.25", "model_integrity": "0.35", "inference_integrity": "0.25", "distribution_shift": "0.15"}
RANK = {"ACCEPT": 0, "REVIEW": 1, "QUARANTINE": 2, "REJECT": 3}
RISK_WEIGHT = {"LOW": 10.0, "MEDIUM": 30.0, "HIGH": 60.0, "CRITICAL": 100.0}
#: Critical categories: dispositions of asset, module and system.
OVERRIDES = {
    "OUTPUT_TAMPERING": ("REJECT", "QUARANTINE", "QUARANTINE"),
    "REPLAY_DETECTED": ("REJECT", "QUARANTINE", "QUARANTINE"),
    "MODEL_SUBSTITUTION": ("QUARANTINE", "QUARANTINE", "QUARANTINE"),
    "BACKDOOR_BEHAVIOR": ("QUARANTINE", "QUARANTINE", "QUARANTINE"),
}
GENESIS = "0" * 64


def content_id(prefix: str, content: dict) -> str:
    """An id over the content as canonical JSON, so equal contents have one id."""
    text = json.dumps({"schema_version": 1, **content}, sort_keys=True, separators=(",", ":"))
    return f"{prefix}:sha256:{hashlib.sha256(text.encode()).hexdigest()}"


class _Checked:
    """A policy whose numbers are finite and positive; those that ``_RATIOS`` names are at most 1."""

    _RATIOS = ()

    def __post_init__(self):
        for f in fields(self):
            if (v := getattr(self, f.name)) is not None and (isinstance(v, bool) or not math.isfinite(v) or v <= 0):
                raise ValueError(f"{f.name} must be positive")
            if f.name in self._RATIOS and v > 1:
                raise ValueError(f"{f.name} must be at most 1")

    @property
    def policy_id(self) -> str:
        """The id of these very values."""
        return content_id(re.sub("(?<!^)(?=[A-Z])", "-", type(self).__name__).lower(), asdict(self))


@dataclass(frozen=True)
class WindowLimits(_Checked):
    """Limits of a profiled window: positive integers."""

    samples: int = 10_000
    file_bytes: int = 1 << 26
    pixels: int = 50_000_000
    failures_shown: int = 20
    path_length: int = 256
    formats_shown: int = 16
    bins: int = 256

    def __post_init__(self):
        super().__post_init__()
        if any(type(getattr(self, f.name)) is not int for f in fields(self)):
            raise ValueError("limits must be integers")
        if self.bins > 4096:
            raise ValueError("bins must be at most 4096")


def _text(name: str, value: object, most: int = 256, optional: bool = False) -> None:
    if optional and value is None:
        return
    if not isinstance(value, str) or not value.strip() or len(value) > most:
        raise ValueError(f"{name} must be a text of at most {most} characters")


def _digest(name: str, value: object) -> None:
    if value is not None and not (isinstance(value, str) and re.fullmatch("sha256:[0-9a-f]{64}", value)):
        raise ValueError(f"{name} must be sha256: and 64 lower-case hex digits")


@dataclass(frozen=True)
class VectorSpace:
    """What the vectors of a window are: only windows of one space can be compared."""

    extractor: str
    version: str
    dimension: int
    normalised: bool = False
    digest: str | None = None

    def __post_init__(self):
        _text("extractor", self.extractor)
        _text("version", self.version)
        _digest("digest", self.digest)
        if type(self.dimension) is not int or self.dimension <= 0:
            raise ValueError("dimension must be a positive integer")

    @property
    def space_id(self) -> str:
        return content_id("vector-space", {**asdict(self), "basis": "DIGEST_DECLARED" if self.digest else "CALLER_DECLARED"})


@dataclass(frozen=True)
class OutputSpace:
    """What the predictions of a window are: classes in order, and what abstaining and unknown mean where declared."""

    labels: tuple[str, ...]
    semantics: str = "CLASS_PROBABILITIES"
    head: str | None = None
    abstention: str | None = None
    unknown: str | None = None
    model_digest: str | None = None

    def __post_init__(self):
        for label in self.labels:
            _text("labels", label)
        if not self.labels or len(set(self.labels)) < len(self.labels):
            raise ValueError("labels must be given and unique")
        _text("semantics", self.semantics)
        for name in ("head", "abstention", "unknown"):
            _text(name, getattr(self, name), optional=True)
        _digest("model_digest", self.model_digest)

    @property
    def space_id(self) -> str:
        return content_id("output-space", {**asdict(self), "basis": "DIGEST_DECLARED" if self.model_digest else "CALLER_DECLARED"})


@dataclass(frozen=True)
class ComparisonPolicy(_Checked):
    """Thresholds of the statistical comparison; a metric exceeds when it is at least its threshold."""

    support: int = 20
    smd: float = 0.8
    quantile: float = 0.5
    median: float = 0.25
    js: float = 0.10
    tv: float = 0.25
    wasserstein: float = 0.10
    epsilon: float = 1e-12

    _RATIOS = ("js", "tv", "wasserstein")


@dataclass(frozen=True)
class PredictionPolicy(ComparisonPolicy):
    """Thresholds of the comparison of predictions; rates move by at least so much."""

    label_js: float = 0.10
    label_tv: float = 0.25
    abstention: float = 0.10
    unknown: float = 0.10

    _RATIOS = ("js", "tv", "wasserstein", "label_js", "label_tv", "abstention", "unknown")


@dataclass(frozen=True)
class VectorPolicy(_Checked):
    """Thresholds of the embedding comparison."""

    support: int = 20
    centroid_cosine: float = 0.10
    centroid_shift: float = 0.50
    dispersion: float = 0.50
    variance: float = 0.50
    mmd: float = 0.05
    nearest_ratio: float = 1.50
    fallback_bandwidth: float = 1.0


@dataclass(frozen=True)
class OutlierPolicy(_Checked):
    """Calibration of outlier scores: from the scores themselves, or ``fixed`` where a threshold is given."""

    fixed: float | None = None
    least: int = 5
    scale: float = 1.4826
    multiplier: float = 3.5
    percentile: float = 95.0


@dataclass(frozen=True)
class TensorPolicy(_Checked):
    """Thresholds of tensor issues."""

    near_zero: float = 1e-8
    zero_fraction: float = 0.99
    tensor_z: float = 8.0
    channel_z: float = 8.0
    ratio: float = 20.0
    energy: float = 0.95
    top: int = 3
    per_tensor: int = 10
    in_total: int = 200


@dataclass(frozen=True)
class BehaviourPolicy(_Checked):
    """Thresholds of behaviour issues."""

    least: int = 8
    flip: float = 0.75
    dominant: float = 0.75
    lift: float = 0.50
    control: float = 0.50
    divergence: float = 10.0


#: Severity, confidence and recommendation of findings by issue code.
ISSUE_FINDINGS = {
    "CUSTOM_OPERATOR_DOMAIN": ("HIGH", 0.98, "QUARANTINE"),
    "OPERATOR_NOT_APPROVED": ("MEDIUM", 0.95, "REVIEW"),
    "NONDETERMINISTIC_OUTPUT": ("MEDIUM", 0.95, "REVIEW"),
    "NEW_NONDETERMINISM": ("MEDIUM", 0.95, "REVIEW"),
    "EXTERNAL_DATA_PATH_UNSAFE": ("HIGH", 0.99, "QUARANTINE"),
    "EXTERNAL_DATA_LOCATION_MISSING": ("HIGH", 0.99, "QUARANTINE"),
    "NO_GRAPH_INPUTS": ("HIGH", 0.99, "QUARANTINE"),
    "NO_GRAPH_OUTPUTS": ("HIGH", 0.99, "QUARANTINE"),
    "EMPTY_GRAPH": ("HIGH", 0.99, "QUARANTINE"),
    "PARAMETER_NAN": ("HIGH", 0.99, "QUARANTINE"),
    "PARAMETER_POSITIVE_INFINITY": ("HIGH", 0.99, "QUARANTINE"),
    "PARAMETER_NEGATIVE_INFINITY": ("HIGH", 0.99, "QUARANTINE"),
    "OUTPUT_NONFINITE": ("HIGH", 0.99, "QUARANTINE"),
    "OUTPUT_CONTRACT_CHANGED": ("HIGH", 0.99, "QUARANTINE"),
    "NEW_OUTPUT_NONFINITE": ("HIGH", 0.99, "QUARANTINE"),
    "EXTERNAL_DATA_NOT_VERIFIED": ("MEDIUM", 0.99, "REVIEW"),
    "INITIALIZER_NAME_MISSING": ("MEDIUM", 0.99, "REVIEW"),
    "RUNTIME_TIMEOUT": ("MEDIUM", 0.99, "REVIEW"),
    "REFERENCE_ARTIFACT_MISMATCH": ("MEDIUM", 0.99, "REVIEW"),
    "DYNAMIC_OR_UNKNOWN_SHAPE": ("LOW", 0.95, "REVIEW"),
    "ALL_ZERO_TENSOR": ("MEDIUM", 0.93, "REVIEW"),
    "CONSTANT_TENSOR": ("LOW", 0.92, "REVIEW"),
    "EXTREME_ZERO_FRACTION": ("LOW", 0.9, "REVIEW"),
    "TENSOR_SCALE_OUTLIER": ("MEDIUM", 0.82, "REVIEW"),
    "CHANNEL_NORM_OUTLIER": ("MEDIUM", 0.84, "REVIEW"),
    "PARAMETER_ENERGY_CONCENTRATION": ("MEDIUM", 0.84, "REVIEW"),
    "DEAD_CHANNEL": ("MEDIUM", 0.9, "REVIEW"),
    "TRIGGER_OUTPUT_DIVERGENCE": ("MEDIUM", 0.9, "REVIEW"),
    "TRIGGER_PREDICTION_FLIP": ("MEDIUM", 0.9, "REVIEW"),
    "TRIGGER_TARGET_CONCENTRATION": ("MEDIUM", 0.9, "REVIEW"),
    "NEW_PARAMETER_ANOMALY": ("MEDIUM", 0.9, "REVIEW"),
    "EXTREME_CHANNEL_SCALE": ("HIGH", 0.88, "REVIEW"),
    "PARAMETER_ANALYSIS_PARTIAL": ("LOW", 1.0, "REVIEW"),
    "BEHAVIOR_ANALYSIS_PARTIAL": ("LOW", 1.0, "REVIEW"),
    "BEHAVIOR_PROTOCOL_INCOMPARABLE": ("LOW", 1.0, "REVIEW"),
    "BEHAVIOR_COMPARISON_PARTIAL": ("LOW", 1.0, "REVIEW"),
    "FINDING_MAPPING_TRUNCATED": ("LOW", 1.0, "REVIEW"),
    "PARAMETER_ANALYSIS_UNAVAILABLE": ("MEDIUM", 1.0, "REVIEW"),
    "BEHAVIOR_ANALYSIS_UNAVAILABLE": ("MEDIUM", 1.0, "REVIEW"),
    "BEHAVIOR_COMPARISON_UNAVAILABLE": ("MEDIUM", 1.0, "REVIEW"),
    "RUNTIME_FAILURE": ("MEDIUM", 0.98, "REVIEW"),
    "TRIGGER_SENSITIVITY": ("HIGH", 0.95, "QUARANTINE"),
    "NEW_TRIGGER_SENSITIVITY": ("HIGH", 0.95, "QUARANTINE"),
    "STRUCTURAL_FINGERPRINT_CHANGED": ("HIGH", 0.99, "REVIEW"),
    "PARAMETER_METADATA_CHANGED": ("HIGH", 0.99, "REVIEW"),
    "PARAMETER_VALUE_CHANGED": ("HIGH", 0.99, "REVIEW"),
}
