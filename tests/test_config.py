from modgauge.config import DEFAULT_BOUNDARIES, BoundaryRule, Ignore, Rules, Thresholds
from modgauge.plans.analysis import CHECKS, select_checks


def test_absent_parts_take_defaults():
    for config in (None, {}, {"boundaries": [], "other": 1}):
        rules = Rules.from_mapping(config)
        assert rules == Rules()
        assert rules.effective_boundaries == DEFAULT_BOUNDARIES
    assert Rules().thresholds == Thresholds(20, 50, 8, 15)


def test_given_parts_are_read_and_unknown_keys_ignored():
    rules = Rules.from_mapping(
        {
            "boundaries": [
                {"name": "D", "pattern": "src/d/**", "allowed_imports": ["src/d/**"]},
                {"name": "E", "pattern": "src/e/**", "colour": "red"},
            ],
            "thresholds": {"coupling_warning_fan_out": 3, "unknown": 1},
            "ignore": {"drift": ["gen/**"], "dead_code": None, "unknown": ["x"]},
        }
    )
    assert rules.boundaries == (
        BoundaryRule("D", "src/d/**", ("src/d/**",)),
        BoundaryRule("E", "src/e/**", ()),
    )
    assert rules.effective_boundaries == rules.boundaries
    assert rules.thresholds == Thresholds(coupling_warning_fan_out=3)
    assert rules.ignore == Ignore(drift=("gen/**",))


def test_only_two_checks_ignore_files():
    ignore = Ignore(dead_code=("a",), drift=("b",))
    assert ignore.globs_for("dead_code") == ("a",)
    assert ignore.globs_for("drift") == ("b",)
    assert ignore.globs_for("coupling") == ()


def test_check_selection():
    assert select_checks() == CHECKS
    assert select_checks(" coupling , dead_code,nonsense") == ("dead_code", "coupling")
    assert select_checks("nonsense") == ()
