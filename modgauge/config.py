"""Rules that steer the checks: layer boundaries, thresholds, ignore globs.

These are a handful of driver-side values.  They reach the executors as
literals inside column expressions, never as data.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class BoundaryRule:
    """Files matching `pattern` may import only files matching `allowed_imports`."""

    name: str
    pattern: str
    allowed_imports: tuple[str, ...] = ()


# The layered-architecture rules used when none are configured.
DEFAULT_BOUNDARIES = (
    BoundaryRule(
        "Domain Layer",
        "src/domain/**",
        ("src/domain/**", "src/types/**", "src/models/**"),
    ),
    BoundaryRule(
        "Application Layer",
        "src/application/**",
        ("src/domain/**", "src/application/**", "src/types/**", "src/models/**"),
    ),
    BoundaryRule(
        "Presentation Layer",
        "src/presentation/**",
        ("src/application/**", "src/domain/**", "src/types/**", "src/models/**"),
    ),
)


@dataclass(frozen=True)
class Thresholds:
    # The documented defaults.
    dead_code_warning: int = 20
    dead_code_critical: int = 50
    coupling_warning_fan_out: int = 8
    coupling_critical_fan_out: int = 15


@dataclass(frozen=True)
class Ignore:
    """Globs of files that one check leaves out; cycles and coupling ignore nothing."""

    dead_code: tuple[str, ...] = ()
    drift: tuple[str, ...] = ()

    def globs_for(self, check: str) -> tuple[str, ...]:
        return getattr(self, check) if check in ("dead_code", "drift") else ()


@dataclass(frozen=True)
class Rules:
    boundaries: tuple[BoundaryRule, ...] = ()
    thresholds: Thresholds = field(default_factory=Thresholds)
    ignore: Ignore = field(default_factory=Ignore)

    @property
    def effective_boundaries(self) -> tuple[BoundaryRule, ...]:
        return self.boundaries or DEFAULT_BOUNDARIES

    @classmethod
    def from_mapping(cls, config: Mapping[str, Any] | None) -> Rules:
        """Rules from an already parsed document (JSON, YAML, a table row ...).

        Absent parts take their defaults and unknown keys are ignored.
        """
        config = config or {}
        return cls(
            boundaries=tuple(
                BoundaryRule(
                    rule["name"],
                    rule["pattern"],
                    tuple(rule.get("allowed_imports") or ()),
                )
                for rule in config.get("boundaries") or ()
            ),
            thresholds=Thresholds(**_known(Thresholds, config.get("thresholds"))),
            ignore=Ignore(
                **{
                    check: tuple(globs or ())
                    for check, globs in _known(Ignore, config.get("ignore")).items()
                }
            ),
        )


def _known(cls: type, values: Mapping[str, Any] | None) -> dict[str, Any]:
    names = {f.name for f in fields(cls)}
    return {key: value for key, value in (values or {}).items() if key in names}
