"""Parameters of the detection, decision and scan steps, with their documented default values."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

MICROS = 1_000_000


@dataclass(frozen=True)
class DetectorParams:
    window_seconds: int = 60
    velocity_threshold: int = 50  # strictly more than this many writes
    rename_threshold: int = 5  # at least this many renames
    write_types: tuple[str, ...] = ("MODIFIED", "CREATED", "RENAMED")

    @property
    def window_us(self) -> int:
        return self.window_seconds * MICROS


@dataclass(frozen=True)
class FusionParams:
    """Evidence multipliers by flag column; a flag without an entry multiplies by 1."""

    ratios: dict[str, float] = field(default_factory=lambda: {"high_velocity": 3.0, "systematic_rename": 4.0})
    epsilon: float = 1e-9


@dataclass(frozen=True)
class DecisionParams:
    alert: float = 0.50
    pause: float = 0.75
    critical: float = 0.90
    low: float = 0.30
    hmm_boost: float = 0.85
    cooldown_seconds: int = 30
    poll_seconds: int = 3

    @property
    def poll_us(self) -> int:
        return self.poll_seconds * MICROS

    @property
    def cooldown_us(self) -> int:
        return self.cooldown_seconds * MICROS


@dataclass(frozen=True)
class HmmParams:
    """Two-state Gaussian model over name entropy; state order is free, the malicious state has the larger mean."""

    pi: tuple[float, float] = (0.5, 0.5)
    a: tuple[tuple[float, float], tuple[float, float]] = ((0.9, 0.1), (0.1, 0.9))
    mu: tuple[float, float] = (2.1234, 4.5678)
    var: tuple[float, float] = (1.0, 1.0)
    length: int = 15

    @property
    def malicious_state(self) -> int:
        return 1 if self.mu[1] > self.mu[0] else 0


@dataclass(frozen=True)
class ScorecardParams:
    """Linear scorecard: the logistic of an intercept plus a weighted sum of feature columns."""

    intercept: float = -3.0
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "file_delete_archived": 0.8,
            "file_created": 0.4,
            "process_related": 1.1,
            "suspicious_path": 0.9,
            "system_executable": 0.7,
            "path_length": 0.01,
            "directory_depth": 0.05,
            "extension_similarity": -1.2,
            "file_name_entropy": 0.6,
        }
    )


@dataclass(frozen=True)
class ScanParams:
    """How ordered scans are cut so that no key becomes one task.

    ``chunk_seconds`` cuts a drive by time: a task holds at most that many seconds of one drive.
    ``rows_per_chunk`` cuts by event id: ids are unique, so a chunk holds at most that many rows.
    ``rows_per_piece``, if given, cuts time chunks with more steps once more, at quantiles of their times.
    """

    chunk_seconds: int = 600
    rows_per_chunk: int = 1_000_000
    rows_per_piece: int | None = None

    @property
    def chunk_us(self) -> int:
        return self.chunk_seconds * MICROS


@dataclass(frozen=True)
class EngineParams:
    detector: DetectorParams = DetectorParams()
    fusion: FusionParams = field(default_factory=FusionParams)
    decision: DecisionParams = DecisionParams()
    hmm: HmmParams = HmmParams()
    scorecard: ScorecardParams = field(default_factory=ScorecardParams)
    scan: ScanParams = ScanParams()

    def with_config(self, config: dict) -> "EngineParams":
        """Apply a learned configuration (see ``sources.config``); absent sections keep their values."""
        out = self
        patterns = config.get("micropattern_thresholds") or {}
        velocity, rename = patterns.get("high_velocity"), patterns.get("systematic_rename")
        if velocity and rename:
            if velocity["window_seconds"] != rename["window_seconds"]:
                raise ValueError("both micropatterns must use the same window")
            out = replace(
                out,
                detector=replace(
                    out.detector,
                    window_seconds=velocity["window_seconds"],
                    velocity_threshold=velocity["threshold"],
                    rename_threshold=rename["threshold"],
                ),
            )
        if config.get("likelihood_ratios"):
            out = replace(out, fusion=replace(out.fusion, ratios=dict(config["likelihood_ratios"])))
        if config.get("alert_thresholds"):
            known = {f.name for f in fields(DecisionParams)}
            levels = {k: v for k, v in config["alert_thresholds"].items() if k in known}
            out = replace(out, decision=replace(out.decision, **levels))
        if config.get("hmm_parameters"):
            out = replace(out, hmm=replace(out.hmm, length=config["hmm_parameters"]["sequence_length"]))
        return out
