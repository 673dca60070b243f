"""Sentences of the findings and the report.

Fixed values: printf templates whose wording downstream tools compare.
"""

DEAD_CODE_DESCRIPTION = "%s `%s` in %s has no references in the codebase."
DEAD_CODE_REMEDY_CRITICAL = (
    "Public %s `%s` is exported but never used. Consider removing it or documenting its "
    "purpose if it is part of a public API surface."
)
DEAD_CODE_REMEDY_OTHER = (
    "%s `%s` appears unused. Verify it is not called via reflection, dynamic dispatch, or "
    "plugin registration before removing."
)

PAIR_DESCRIPTION = (
    "Circular dependency between `%s` and `%s`: %s cross-references (%s -> %s, %s -> %s)."
)
PAIR_REMEDY = (
    "Extract shared code into a third module that both `%s` and `%s` depend on (dependency "
    "inversion principle). Alternatively, use an event/callback pattern to break the direct "
    "coupling."
)

CYCLE_DESCRIPTION = (
    "Dependency cycle involving %s modules: %s -> %s (%s total cross-references). This "
    "indicates deeply entangled module boundaries."
)
CYCLE_REMEDY = (
    "This multi-module cycle requires architectural refactoring. Consider introducing an "
    "abstraction layer or using dependency injection to break the cycle. Prioritize the "
    "weakest coupling point (lowest reference count edge) as the break point."
)

COUPLING_DESCRIPTION = (
    "Module `%s` has a fan-out of %s, depending on %s other modules: %s."
)
COUPLING_REMEDY_CRITICAL = (
    "Module `%s` is heavily coupled to %s other modules. This violates the stable "
    "dependencies principle and makes changes risky. Consider extracting a facade or "
    "interface layer to reduce direct dependencies. Group related dependencies into "
    "sub-modules and route access through a single entry point."
)
COUPLING_REMEDY_WARNING = (
    "Module `%s` has moderate coupling (%s dependencies). Review whether all dependencies "
    "are necessary. Consider using dependency injection or the mediator pattern to reduce "
    "direct coupling."
)

DRIFT_DESCRIPTION = (
    '`%s` (in %s, governed by "%s" boundary) imports `%s` from `%s`, which is outside the '
    "allowed import scope."
)
DRIFT_REMEDY = (
    "Move `%s` to a location within the allowed boundary, or refactor to use an "
    'interface/abstraction defined within the "%s" boundary. Consider applying the '
    'dependency inversion principle: define a trait or protocol inside "%s" that `%s` in '
    "`%s` can implement."
)

ADVICE_DEAD_CODE = (
    "%s. **Remove dead code**: %s unused definitions found. Start with public API surfaces "
    "(critical) and work inward. Run this check regularly in CI to prevent accumulation."
)
ADVICE_CYCLES = (
    "%s. **Break circular dependencies**: %s cycle(s) detected. Apply the dependency "
    "inversion principle — introduce interfaces or abstract modules that both sides depend "
    "on instead of each other."
)
ADVICE_COUPLING = (
    "%s. **Reduce module coupling**: %s module(s) with high fan-out. Consider the facade "
    "pattern for high-coupling modules to reduce direct dependency count and improve change "
    "isolation."
)
ADVICE_DRIFT = (
    "%s. **Enforce architecture boundaries**: %s drift violation(s) found. Add explicit "
    "boundary rules to the configuration and run this in CI to prevent new violations from "
    "being merged."
)
ALL_CLEAR = (
    "No findings at or above the configured severity threshold. Your codebase is healthy "
    "according to this analysis."
)
