"""The same questions in SQL, answered by another engine over the same tables.

The SQL is written from the semantics, not from the Spark plans: NOT IN instead
of an anti join, a self-join for pairs, recursive CTEs for reachability and
cycles, string_split for modules, regular expressions for globs.  Only the
derived tables and the fixed wording are shared.
"""

from __future__ import annotations

import re

from modgauge.functions import texts
from modgauge.plans import report
from modgauge.plans.findings import CATEGORIES
from modgauge.sources import derived

_USED = re.compile(r"\b[a-z_]+(?:__[a-z]+)?\b")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill(template: str, *values: str) -> str:
    """A printf template as a SQL concatenation."""
    parts = template.split("%s")
    assert len(parts) == len(values) + 1, template
    pieces = [_quoted(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [f"CAST({value} AS VARCHAR)", _quoted(part)]
    return "(" + " || ".join(p for p in pieces if p != "''") + ")"


def _module(path: str) -> str:
    inner = (
        f"CASE WHEN starts_with({path}, './') THEN substr({path}, 3) "
        f"WHEN starts_with({path}, '/') THEN substr({path}, 2) ELSE {path} END"
    )
    parts = f"string_split({inner}, '/')"
    return (
        f"CASE WHEN len({parts}) >= 3 AND ({parts})[1] = 'src' THEN ({parts})[2] "
        f"WHEN len({parts}) >= 2 THEN ({parts})[1] ELSE 'root' END"
    )


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _ticked(items: str) -> str:
    return f"list_transform({items}, lambda m: '`' || m || '`')"


ENTRY_LIKE = (
    "(name IN ('main', 'Main') OR starts_with(name, 'test_') OR ends_with(name, '_test') "
    "OR ends_with(name, 'Test') OR ends_with(name, 'Spec'))"
)
DEAD_SEVERITY = (
    f"CASE WHEN {ENTRY_LIKE} THEN 'info' WHEN kind IN ('function', 'method') THEN 'warning' "
    "ELSE 'critical' END"
)
RANK = "CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"
CAPITAL_KIND = "upper(kind[1]) || kind[2:]"


def _dead(source: str, extra: str = "") -> str:
    return (
        f"SELECT name, file, kind, line, {DEAD_SEVERITY} AS severity FROM code_defs "
        "WHERE kind IN ('function', 'method', 'class', 'struct', 'enum', 'trait', 'interface') "
        f"AND name NOT IN (SELECT DISTINCT target_name FROM {source}) "
        "AND split_part(file, '/', -1) NOT IN "
        f"('index.ts', 'index.js', 'mod.rs', 'lib.rs', 'main.rs'){extra}"
    )


def _under(path: str, *folders: str) -> str:
    return "(" + " OR ".join(f"{path} LIKE 'src/{f}/%'" for f in folders) + ")"


def _default_drift(source: str) -> str:
    layers = {
        "domain": ("Domain Layer", ("domain", "types", "models")),
        "application": (
            "Application Layer",
            ("domain", "application", "types", "models"),
        ),
        "presentation": (
            "Presentation Layer",
            ("application", "domain", "types", "models"),
        ),
    }
    return " UNION ALL ".join(
        "SELECT source_file, source_name, target_file, target_name, "
        f"'{name}' AS boundary_name, 'src/{folder}/**' AS boundary_rule FROM {source} "
        f"WHERE source_file <> target_file AND {_under('source_file', folder)} "
        f"AND NOT {_under('target_file', *allowed)}"
        for folder, (name, allowed) in layers.items()
    )


def _matches(path: str, regex: str) -> str:
    return f"regexp_matches({path}, '^{regex}$', 's')"


NUMBERED = _matches("{0}", "src/mod1./.*")
SOURCES = "{0} LIKE 'src/%'"
TESTS = "{0} LIKE '%.test.%'"
OVERLAP_INDEX = (
    f"CASE WHEN {NUMBERED} THEN 0 WHEN {SOURCES} THEN 1 WHEN {TESTS} THEN 2 END"
)
OVERLAP_ALLOWED = (
    "CASE {1} WHEN 0 THEN "
    + _matches("{0}", "src/mod1[0-4]/.*")
    + " OR {0} = 'index.ts' OR {0} LIKE '%/index.ts' WHEN 1 THEN "
    + _matches("{0}", "src/(.*/)?.*[^0]\\.rs")
    + " OR {0} LIKE '%.go' ELSE false END"
)
OVERLAP_NAMES = "['Numbered', 'Sources', 'Closed']"
OVERLAP_PATTERNS = "['src/mod1?/**', 'src/**', '**/*.test.*']"

CTES: dict[str, str] = {
    "code_defs": f"SELECT {_columns(derived.DEFINITION_COLUMNS)} FROM part",
    "overlap_drift": (
        "SELECT source_file, source_name, target_file, target_name, "
        f"{OVERLAP_NAMES}[rule + 1] AS boundary_name, "
        f"{OVERLAP_PATTERNS}[rule + 1] AS boundary_rule FROM "
        f"(SELECT *, {OVERLAP_INDEX.format('source_file')} AS rule FROM code_refs__layered "
        "WHERE source_file <> target_file AND source_file NOT LIKE 'src/models/%') "
        f"WHERE rule IS NOT NULL AND NOT ({OVERLAP_ALLOWED.format('target_file', 'rule')})"
    ),
    "overlap_dead": _dead(
        "code_refs__layered", " AND file NOT LIKE '%.test.%' AND file NOT LIKE 'src/types/%'"
    ),
}


def _coupled(edges: str, warning: int, critical: int) -> str:
    return (
        "SELECT src_module AS module, count(*) AS fan_out, "
        f"CASE WHEN count(*) >= {critical} THEN 'critical' ELSE 'warning' END AS severity, "
        f"list(dst_module ORDER BY dst_module) AS deps FROM {edges} "
        f"GROUP BY src_module HAVING count(*) >= {warning}"
    )


CTES["overlap_coupled"] = _coupled("module_edges__layered", 5, 12)

for _g in derived.CROSSES:
    _reverse = "list_concat([path[1]], list_reverse(path[2:]))"
    CTES |= {
        f"code_refs__{_g}": (
            f"SELECT {_columns(derived.REFERENCE_COLUMNS)} FROM "
            f"(SELECT {_columns(derived.reference_keys(_g))} FROM lineitem)"
        ),
        f"file_edges__{_g}": (
            f"SELECT source_file, target_file, count(*) AS ref_count FROM code_refs__{_g} "
            "GROUP BY source_file, target_file"
        ),
        f"module_edges__{_g}": (
            "SELECT src_module, dst_module, CAST(sum(ref_count) AS BIGINT) AS ref_count, "
            "count(*) AS file_pairs FROM (SELECT "
            f"{_module('source_file')} AS src_module, {_module('target_file')} AS dst_module, "
            f"ref_count FROM file_edges__{_g}) WHERE src_module <> dst_module "
            "GROUP BY src_module, dst_module"
        ),
        f"pairs__{_g}": (
            "SELECT f.src_module AS module_a, f.dst_module AS module_b, "
            "f.ref_count AS forward_refs, b.ref_count AS backward_refs, "
            "f.ref_count + b.ref_count AS total_refs, "
            "CASE WHEN f.ref_count + b.ref_count > 20 THEN 'critical' ELSE 'warning' END "
            f"AS severity FROM module_edges__{_g} f JOIN module_edges__{_g} b "
            "ON f.src_module = b.dst_module AND f.dst_module = b.src_module "
            "WHERE f.src_module < f.dst_module"
        ),
        f"reach__{_g}": (
            f"SELECT src_module AS a, dst_module AS z FROM module_edges__{_g} UNION "
            f"SELECT r.a, e.dst_module FROM reach__{_g} r "
            f"JOIN module_edges__{_g} e ON e.src_module = r.z"
        ),
        f"core__{_g}": (
            f"SELECT e.* FROM module_edges__{_g} e JOIN reach__{_g} r "
            "ON r.a = e.dst_module AND r.z = e.src_module"
        ),
        f"walks__{_g}": (
            "SELECT src_module AS first, dst_module AS tail, [src_module, dst_module] AS path, "
            f"ref_count AS refs FROM core__{_g} WHERE src_module < dst_module UNION ALL "
            "SELECT w.first, e.dst_module, list_append(w.path, e.dst_module), "
            f"w.refs + e.ref_count FROM walks__{_g} w JOIN core__{_g} e "
            "ON e.src_module = w.tail AND e.dst_module > w.first "
            f"AND NOT list_contains(w.path, e.dst_module)"
        ),
        f"closed__{_g}": (
            f"SELECT path, refs, least(path, {_reverse}) AS cycle_key FROM ("
            f"SELECT w.path, w.refs + e.ref_count AS refs FROM walks__{_g} w "
            f"JOIN core__{_g} e ON e.src_module = w.tail AND e.dst_module = w.first "
            "WHERE len(w.path) >= 3)"
        ),
        f"cycles__{_g}": (
            "SELECT path, CAST(len(path) AS INTEGER) AS length, refs AS total_refs, cycle_key "
            "FROM (SELECT *, row_number() OVER (PARTITION BY cycle_key "
            "ORDER BY refs DESC, path = cycle_key DESC) AS nth "
            f"FROM closed__{_g}) WHERE nth = 1"
        ),
        f"dead__{_g}": _dead(f"code_refs__{_g}"),
        f"drift__{_g}": _default_drift(f"code_refs__{_g}"),
        f"coupled__{_g}": _coupled(f"module_edges__{_g}", 8, 15),
    }

RECURSIVE_PREFIXES = ("reach", "walks")

_RELATED = {
    "other_module": "VARCHAR",
    "cycle_count": "BIGINT",
    "module_name": "VARCHAR",
    "fan_out": "BIGINT",
    "dependencies": "VARCHAR",
    "target_name": "VARCHAR",
    "target_file": "VARCHAR",
    "boundary_name": "VARCHAR",
    "boundary_rule": "VARCHAR",
    "kind": "VARCHAR",
}


def _finding(
    source: str,
    category: str,
    severity: str,
    file: str,
    name: str,
    description: str,
    remediation: str,
    line: str = "CAST(NULL AS BIGINT)",
    identity: tuple[str, ...] = (),
    **related: str,
) -> str:
    key_parts = ", ".join([_quoted(category), file, name, *identity])
    values = {
        "diff_key": f"sha256(concat_ws(chr(1), {key_parts}))",
        "severity": severity,
        "category": _quoted(category),
        "file": file,
        "line": line,
        "name": name,
        "description": description,
        "remediation": remediation,
        **{
            f"related_{field}": f"CAST({related.get(field, 'NULL')} AS {kind})"
            for field, kind in _RELATED.items()
        },
    }
    return f"SELECT {_columns(values)} FROM {source}"


def _dead_findings(source: str) -> str:
    return _finding(
        source,
        "dead_code",
        "severity",
        "file",
        "name",
        _fill(texts.DEAD_CODE_DESCRIPTION, CAPITAL_KIND, "name", "file"),
        "CASE WHEN severity = 'critical' THEN "
        + _fill(texts.DEAD_CODE_REMEDY_CRITICAL, "lower(kind)", "name")
        + " ELSE "
        + _fill(texts.DEAD_CODE_REMEDY_OTHER, CAPITAL_KIND, "name")
        + " END",
        line="line",
        identity=("kind",),
        kind="kind",
    )


def _coupling_findings(source: str) -> str:
    shown = f"list_aggregate({_ticked('deps[1:10]')}, 'string_agg', ', ')"
    return _finding(
        source,
        "high_coupling",
        "severity",
        "module || '/'",
        "module",
        _fill(
            texts.COUPLING_DESCRIPTION,
            "module",
            "fan_out",
            "fan_out",
            f"({shown} || CASE WHEN fan_out > 10 THEN ' and ' || (fan_out - 10) || ' more' "
            "ELSE '' END)",
        ),
        "CASE WHEN severity = 'critical' THEN "
        + _fill(texts.COUPLING_REMEDY_CRITICAL, "module", "fan_out")
        + " ELSE "
        + _fill(texts.COUPLING_REMEDY_WARNING, "module", "fan_out")
        + " END",
        module_name="module",
        fan_out="fan_out",
        dependencies="list_aggregate(deps, 'string_agg', ',')",
    )


def _drift_findings(source: str) -> str:
    return _finding(
        source,
        "architectural_drift",
        "'warning'",
        "source_file",
        "source_name",
        _fill(
            texts.DRIFT_DESCRIPTION,
            "source_name",
            "source_file",
            "boundary_name",
            "target_name",
            "target_file",
        ),
        _fill(
            texts.DRIFT_REMEDY,
            "target_name",
            "boundary_name",
            "boundary_name",
            "target_name",
            "target_file",
        ),
        identity=("target_file", "target_name"),
        target_name="target_name",
        target_file="target_file",
        boundary_name="boundary_name",
        boundary_rule="boundary_rule",
    )


def _pair_findings(source: str) -> str:
    return _finding(
        source,
        "circular_dependency",
        "severity",
        "module_a || '/'",
        "module_a || ' <-> ' || module_b",
        _fill(
            texts.PAIR_DESCRIPTION,
            "module_a",
            "module_b",
            "total_refs",
            "module_a",
            "module_b",
            "module_b",
            "module_a",
        ),
        _fill(texts.PAIR_REMEDY, "module_a", "module_b"),
        other_module="module_b",
        cycle_count="total_refs",
    )


def _cycle_findings(source: str) -> str:
    chain = f"list_aggregate({_ticked('path')}, 'string_agg', ' -> ')"
    return _finding(
        source,
        "circular_dependency",
        "'critical'",
        "path[1] || '/'",
        "'cycle(' || length || ')'",
        _fill(texts.CYCLE_DESCRIPTION, "length", chain, "path[1]", "total_refs"),
        _quoted(texts.CYCLE_REMEDY),
        identity=("list_aggregate(cycle_key, 'string_agg', ' -> ')",),
        other_module=chain,
        cycle_count="total_refs",
    )


def _identified(parts: list[str]) -> str:
    return (
        "SELECT sha256(concat_ws(chr(1), diff_key, coalesce(CAST(line AS VARCHAR), ''))) "
        f"AS finding_id, *, {RANK} AS severity_rank FROM ({' UNION ALL '.join(parts)})"
    )


for _g in ("layered", "sparse"):
    CTES[f"findings__{_g}"] = _identified(
        [
            _dead_findings(f"dead__{_g}"),
            _pair_findings(f"pairs__{_g}"),
            _cycle_findings(f"cycles__{_g}"),
            _coupling_findings(f"coupled__{_g}"),
            _drift_findings(f"drift__{_g}"),
        ]
    )
    CTES[f"summary__{_g}"] = (
        "SELECT CAST(category_no AS INTEGER) AS category_no, c.category, "
        "count(f.category) AS finding_count, CASE max(f.severity_rank) WHEN 2 THEN 'critical' "
        "WHEN 1 THEN 'warning' ELSE 'info' END AS worst_severity FROM (VALUES "
        + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES))
        + f") c(category_no, category) LEFT JOIN findings__{_g} f ON f.category = c.category "
        "GROUP BY category_no, c.category"
    )
    CTES[f"totals__{_g}"] = (
        "SELECT count(*) FILTER (severity = 'critical') AS critical_count, "
        "count(*) FILTER (severity = 'warning') AS warning_count, "
        "count(*) FILTER (severity = 'info') AS info_count, count(*) AS total_count "
        f"FROM findings__{_g}"
    )

_ADVICE = (
    "CASE category "
    + " ".join(
        f"WHEN '{c}' THEN {_fill(report.ADVICE[c], 'advice_no', 'finding_count')}"
        for c in CATEGORIES
    )
    + " END"
)
CTES["advice"] = (
    f"SELECT advice_no, category, {_ADVICE} AS advice FROM (SELECT *, "
    "CAST(row_number() OVER (ORDER BY category_no) AS INTEGER) AS advice_no "
    "FROM summary__layered WHERE finding_count > 0 AND "
    "(SELECT critical_count + warning_count FROM totals__layered) > 0)"
)


def _report_lines() -> str:
    defaults = {
        "order_rank": "CAST(0 AS BIGINT)",
        "order_file": "''",
        "order_line": "CAST(0 AS BIGINT)",
        "order_name": "''",
        "finding_id": "''",
    }

    def block(source: str, section: str, number: int, lines: list[str], **keys: str) -> str:
        keyed = _columns({**defaults, **keys})
        listed = ", ".join(lines)
        return (
            f"SELECT CAST({section} AS INTEGER) AS section_no, {number} AS block_no, {keyed}, "
            f"unnest(range({len(lines)}))::INTEGER AS line_no, unnest([{listed}]) AS line "
            f"FROM {source}"
        )

    def by_category(values: dict[str, str]) -> str:
        whens = " ".join(f"WHEN '{c}' THEN {_quoted(v)}" for c, v in values.items())
        return f"CASE category {whens} END"

    section = (
        "CASE category "
        + " ".join(f"WHEN '{c}' THEN {i + 2}" for i, c in enumerate(CATEGORIES))
        + " END"
    )
    summary, totals, filled = (
        "summary__layered",
        "totals__layered",
        "(FROM summary__layered WHERE finding_count > 0)",
    )
    place = "file || CASE WHEN line IS NULL THEN '' ELSE ':' || line END"
    return " UNION ALL ".join(
        [
            block(
                "(SELECT (SELECT count(*) FROM part) AS nodes, "
                "(SELECT count(*) FROM lineitem) AS edges)",
                "0",
                0,
                [
                    "'# Code Health Report'",
                    "''",
                    "'**Repository**: derived'",
                    "'**Timestamp**: now'",
                    _fill("**Graph Size**: %s nodes, %s edges", "nodes", "edges"),
                    "'**Report Version**: 1'",
                    "''",
                ],
            ),
            block(
                totals,
                "1",
                0,
                [
                    "'## Summary'",
                    "''",
                    "'| Category | Count | Worst Severity |'",
                    "'|---|---|---|'",
                ],
            ),
            block(
                summary,
                "1",
                1,
                [
                    _fill(
                        "| %s | %s | %s |",
                        by_category(report.SUMMARY_LABELS),
                        "finding_count",
                        "worst_severity",
                    )
                ],
                order_rank="CAST(category_no AS BIGINT)",
            ),
            block(
                totals,
                "1",
                2,
                [
                    _fill(
                        "| **Total** | **%s** | %s critical, %s warning, %s info |",
                        "total_count",
                        "critical_count",
                        "warning_count",
                        "info_count",
                    ),
                    "''",
                ],
            ),
            block(filled, section, 0, [f"'## ' || {by_category(report.HEADINGS)}", "''"]),
            block(
                "findings__layered",
                section,
                1,
                [
                    _fill(
                        "- **%s** [`%s`](%s) — %s",
                        "upper(severity)",
                        "name",
                        place,
                        "description",
                    )
                    + " || chr(10) || "
                    + _fill("  - _Suggestion_: %s", "remediation"),
                ],
                order_rank="-coalesce(related_fan_out, 0)",
                order_file="file",
                order_line="coalesce(line, 9223372036854775807)",
                order_name="name",
                finding_id="finding_id",
            ),
            block(filled, section, 2, ["''"]),
            block(
                f"(FROM {totals} WHERE critical_count + warning_count > 0)",
                "6",
                0,
                ["'## Recommendations'", "''"],
            ),
            block(
                "advice", "6", 1, ["advice", "''"], order_rank="CAST(advice_no AS BIGINT)"
            ),
            block(
                f"(FROM {totals} WHERE total_count = 0)",
                "6",
                0,
                ["'## All Clear'", "''", _quoted(texts.ALL_CLEAR)],
            ),
        ]
    )


_JSON_RELATED = (
    "CASE category WHEN 'dead_code' THEN json_object('kind', related_kind) "
    "WHEN 'circular_dependency' THEN json_object('other_module', related_other_module, "
    "'cycle_count', related_cycle_count) "
    "WHEN 'high_coupling' THEN json_object('module_name', related_module_name, "
    "'fan_out', related_fan_out, 'dependencies', string_split(related_dependencies, ',')) "
    "ELSE json_object('target_name', related_target_name, 'target_file', "
    "related_target_file, 'boundary_name', related_boundary_name, 'boundary_rule', "
    "related_boundary_rule) END"
)

ALL_FILES = (
    "SELECT source_file AS file FROM code_refs__layered UNION "
    "SELECT target_file FROM code_refs__layered"
)

_CONTRACT = {
    "definitions": (
        "code_defs",
        [("name", "string", True), ("file", "string", True), ("kind", "string", True),
         ("line", "bigint", False)],
    ),
    "references": (
        "code_refs__layered",
        [(c, "string", True)
         for c in ("source_file", "source_name", "target_file", "target_name")],
    ),
}

_FINDING_COLUMNS = (
    "finding_id, diff_key, severity, severity_rank, category, file, line, name, "
    "description, remediation, " + ", ".join(f"related_{field}" for field in _RELATED)
)

ORACLE: dict[str, str] = {
    "module_of_files": f"SELECT file, {_module('file')} AS module FROM ({ALL_FILES})",
    "file_edges": "SELECT * FROM file_edges__layered",
    "module_edges": "SELECT * FROM module_edges__dense",
    "module_links": "SELECT src_module, dst_module, ref_count FROM module_edges__layered",
    "fan_out": (
        "SELECT src_module, count(*) AS fan_out FROM module_edges__layered GROUP BY src_module"
    ),
    "graph_stats": (
        "SELECT (SELECT count(*) FROM code_defs) AS nodes, "
        "(SELECT count(*) FROM code_refs__layered) AS edges"
    ),
    "schema_contract": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS data_type, "
        f"count(*) AS row_count, count(*) - count({column}) AS null_count, "
        f"{'count(*) = count(' + column + ')' if required else 'true'} AS honoured FROM {cte}"
        for table, (cte, columns) in _CONTRACT.items()
        for column, kind, required in columns
    ),
    "dead_code_unreferenced": (
        "SELECT * FROM code_defs WHERE name NOT IN (SELECT target_name FROM code_refs__layered)"
    ),
    "dead_code": f"SELECT *, {RANK} AS severity_rank FROM dead__layered",
    "dead_code_ignoring": f"SELECT *, {RANK} AS severity_rank FROM overlap_dead",
    "dead_code_severity": f"SELECT *, {DEAD_SEVERITY} AS severity FROM code_defs",
    "dead_code_total": (
        "SELECT count(*) AS dead_code_total, CASE WHEN count(*) >= 50 THEN 'critical' "
        "WHEN count(*) >= 20 THEN 'warning' ELSE 'info' END AS severity FROM dead__layered"
    ),
    "glob_match": (
        "SELECT file, "
        + _columns(
            {
                "any_depth": "starts_with(file, 'src/domain/')",
                "by_suffix": _matches("file", "(.*/)?.*\\.test\\..*"),
                "star_crosses": "ends_with(file, '.rs')",
                "one_character": _matches("file", "src/mod./f1\\.rs"),
                "character_set": _matches("file", "src/mod1[0-3]/.*"),
                "negated_set": _matches("file", "src/mod1[^0-3]/.*"),
                "middle_folders": _matches("file", "src/(.*/)?f7\\.rs"),
                "exact_file": "file = 'src/main.rs'",
                "braces_are_plain": "file = 'src/{domain,types}/f1.rs'",
                "malformed": "false",
            }
        )
        + f" FROM ({ALL_FILES})"
    ),
    "drift_boundary_of_file": (
        f"SELECT file, rule AS rule_index, {OVERLAP_NAMES}[rule + 1] AS boundary_name FROM "
        f"(SELECT file, {OVERLAP_INDEX.format('file')} AS rule FROM ({ALL_FILES}))"
    ),
    "drift_import_allowed": (
        "SELECT source_file, target_file, CASE "
        f"WHEN {_under('source_file', 'domain')} "
        f"THEN {_under('target_file', 'domain', 'types', 'models')} "
        f"WHEN {_under('source_file', 'application', 'presentation')} "
        f"THEN {_under('target_file', 'domain', 'application', 'types', 'models')} "
        "END AS import_allowed FROM file_edges__layered"
    ),
    "architectural_drift": "SELECT * FROM drift__layered",
    "drift_overlapping_rules": "SELECT * FROM overlap_drift",
    "pair_cycles": "SELECT * FROM pairs__dense",
    **{
        key: (
            "SELECT list_aggregate(path, 'string_agg', ' -> ') AS path, length, total_refs "
            f"FROM cycles__{g}"
        )
        for key, g in {
            "long_cycles": "layered",
            "long_cycles_ring": "sparse",
        }.items()
    },
    "cycle_canonical": (
        "SELECT list_aggregate(list_concat(path[i + 1:], path[1:i]), 'string_agg', ' -> ') "
        "AS written, list_aggregate(cycle_key, 'string_agg', ' -> ') AS cycle_key "
        "FROM (SELECT path, cycle_key, unnest(range(len(path))) AS i FROM cycles__layered)"
    ),
    "cycle_weakest_edge": (
        "SELECT list_aggregate(path, 'string_agg', ' -> ') AS path, length, "
        "src_module, dst_module, ref_count FROM (SELECT s.path, s.length, e.*, "
        "row_number() OVER (PARTITION BY s.path ORDER BY e.ref_count, e.src_module, "
        "e.dst_module) AS nth FROM (SELECT path, length, unnest(path) AS a, "
        "unnest(list_concat(path[2:], [path[1]])) AS z FROM cycles__layered) s "
        "JOIN module_edges__layered e ON e.src_module = s.a AND e.dst_module = s.z) "
        "WHERE nth = 1"
    ),
    "pair_cycle_evidence": (
        "SELECT src_module, dst_module, source_file, target_file, ref_count, "
        "CAST(nth AS INTEGER) AS rank, module_a, module_b FROM (SELECT m.*, "
        "p.module_a, p.module_b, row_number() OVER (PARTITION BY src_module, dst_module "
        "ORDER BY ref_count DESC, source_file, target_file) AS nth FROM (SELECT "
        f"{_module('source_file')} AS src_module, {_module('target_file')} AS dst_module, * "
        "FROM file_edges__dense) m JOIN pairs__dense p ON m.src_module <> m.dst_module AND "
        "p.module_a = least(src_module, dst_module) AND "
        "p.module_b = greatest(src_module, dst_module)) WHERE nth <= 3"
    ),
    "coupling": (
        "SELECT module, fan_out, severity, list_aggregate(deps, 'string_agg', ',') "
        "AS dependencies FROM coupled__layered"
    ),
    "coupling_dependencies": (
        "SELECT module, fan_out, unnest(deps) AS dependency FROM coupled__layered"
    ),
    "all_findings": f"SELECT {_FINDING_COLUMNS} FROM findings__layered",
    "findings_custom_rules": f"SELECT {_FINDING_COLUMNS} FROM ("
    + _identified(
        [
            _dead_findings("overlap_dead"),
            _coupling_findings("overlap_coupled"),
            _drift_findings("overlap_drift"),
        ]
    )
    + ")",
    "rules_from_mapping": f"SELECT {_FINDING_COLUMNS} FROM ("
    + _identified(
        [
            _dead_findings("overlap_dead"),
            _coupling_findings("overlap_coupled"),
            _drift_findings("drift__layered"),
        ]
    )
    + ")",
    "rejected_rows": (
        "SELECT * FROM (SELECT CASE WHEN regexp_extract(name, '([0-9]+)', 1) LIKE '%7' THEN NULL "
        "ELSE name END AS name, CASE WHEN regexp_extract(name, '([0-9]+)', 1) LIKE '%3' THEN NULL "
        "ELSE file END AS file, kind, line FROM code_defs) WHERE name IS NULL OR file IS NULL"
    ),
    "report_document": (
        "SELECT CAST(json_object('version', '1', 'timestamp', 'now', 'repository', 'derived', "
        "'graph_stats', json_object('nodes', (SELECT count(*) FROM part), 'edges', "
        "(SELECT count(*) FROM lineitem)), 'finding_count', (SELECT total_count FROM "
        "totals__layered)) AS VARCHAR) AS json"
    ),
    "findings_min_severity": (
        f"SELECT {_FINDING_COLUMNS} FROM findings__layered WHERE severity = 'critical'"
    ),
    "report_summary": "SELECT * FROM summary__layered",
    "severity_counts": (
        "SELECT *, CASE WHEN critical_count > 0 THEN 'critical' WHEN warning_count > 0 "
        "THEN 'warning' ELSE 'info' END AS worst_severity FROM totals__layered"
    ),
    "recommendations": "SELECT * FROM advice",
    "report_lines": _report_lines(),
    "ci_gate": (
        "SELECT critical_count, critical_count > 0 AS gate_failed FROM totals__layered"
    ),
    "findings_json": (
        "SELECT finding_id, CAST(json_object('id', finding_id, 'severity', severity, "
        "'category', category, 'location', json_object('file', file, 'line', line, 'name', "
        "name), 'description', description, 'remediation', remediation, 'related', "
        f"{_JSON_RELATED}) AS VARCHAR) AS json FROM findings__layered"
    ),
    "code_quality": (
        "SELECT description, category AS check_name, finding_id AS fingerprint, "
        "CASE severity WHEN 'warning' THEN 'minor' ELSE severity END AS severity, "
        "file AS path, coalesce(line, 1) AS begin_line FROM findings__layered"
    ),
    "findings_diff": " UNION ALL ".join(
        f"SELECT DISTINCT '{change}' AS change, diff_key, category, file, name "
        f"FROM findings__{here} WHERE diff_key NOT IN (SELECT diff_key FROM findings__{there})"
        for change, here, there in (
            ("new", "sparse", "layered"),
            ("resolved", "layered", "sparse"),
        )
    ),
    "findings_trend": (
        "SELECT run_ts, category, finding_count, previous_count, "
        "finding_count - previous_count AS change FROM (SELECT *, lag(finding_count) OVER "
        "(PARTITION BY category ORDER BY run_ts) AS previous_count FROM ("
        "SELECT '2024-01-01' AS run_ts, * FROM summary__layered UNION ALL "
        "SELECT '2024-02-01' AS run_ts, * FROM summary__sparse))"
    ),
}

# A rule for each of fifty files of a hundred modules, between wide ones; see the queries.
_M, _FILE = (f"CAST(nullif(regexp_extract(source_file, '^src/mod([0-9]{{1,2}})/f([0-9]{{1,2}})\\.rs$', {i}), '') AS INTEGER)" for i in (1, 2))
_RULE_OF = (
    "CASE WHEN regexp_matches(source_file, '^src/mod7/f1.\\.rs$') THEN 0 "
    f"WHEN {_M} < 100 AND {_FILE} < 50 THEN 1 + {_FILE} * 100 + {_M} "
    "WHEN ends_with(source_file, '.go') OR regexp_matches(source_file, '/[^/]*\\.go$') THEN 5001 "
    "WHEN starts_with(source_file, 'src/') THEN 5002 END"
)
_MANY = f"SELECT *, {_M} AS m, {_FILE} AS f, {_RULE_OF} AS rule"
_RULE_NAME = (
    "CASE rule WHEN 0 THEN 'Tens' WHEN 5001 THEN 'Go' WHEN 5002 THEN 'Rest' ELSE 'm' || m || 'f' || f END"
)
_RULE_PATTERN = (
    "CASE rule WHEN 0 THEN 'src/mod7/f1?.rs' WHEN 5001 THEN '**/*.go' WHEN 5002 THEN 'src/**' "
    "ELSE 'src/mod' || m || '/f' || f || '.rs' END"
)
ORACLE |= {
    "drift_many_rules": (
        f"SELECT source_file, source_name, target_file, target_name, {_RULE_NAME} AS boundary_name, "
        f"{_RULE_PATTERN} AS boundary_rule FROM ({_MANY} FROM code_refs__layered "
        "WHERE source_file <> target_file AND NOT starts_with(source_file, 'src/models/')) "
        "WHERE rule IS NOT NULL AND NOT CASE rule WHEN 0 THEN starts_with(target_file, 'src/types/') "
        "WHEN 5001 THEN false WHEN 5002 THEN regexp_matches(target_file, '^src/mod1.*/') "
        "ELSE starts_with(target_file, 'src/mod' || m || '/') "
        "OR starts_with(target_file, 'src/mod' || ((m + 1) % 100) || '/f' || f) "
        "OR split_part(target_file, '/', -1) = 'index.ts' END"
    ),
    "drift_boundary_many_rules": (
        f"SELECT file, CAST(rule AS INTEGER) AS rule_index, {_RULE_NAME} AS boundary_name FROM "
        f"({_MANY}, source_file AS file FROM (SELECT file AS source_file FROM ({ALL_FILES}))) "
        "WHERE rule IS NOT NULL"
    ),
    "drift_long_allow_list": (
        "SELECT source_file, source_name, target_file, target_name, 'Listed' AS boundary_name, "
        "'src/mod*' AS boundary_rule FROM code_refs__layered WHERE source_file <> target_file "
        "AND starts_with(source_file, 'src/mod') AND NOT "
        "regexp_matches(target_file, '^src/mod[0-9]{1,2}/f[1-4]?[02468]\\.rs$')"
    ),
    "report_numbered": (
        "SELECT section_no, row_number() OVER (ORDER BY section_no, block_no, order_rank, encode(order_file), "
        "order_line, encode(order_name), finding_id, line_no, row_no, part) AS line_no, text AS line FROM ("
        "SELECT * EXCLUDE (line), unnest(string_split(line, chr(10))) AS text, "
        "generate_subscripts(string_split(line, chr(10)), 1) AS part FROM "
        f"(SELECT *, row_number() OVER () AS row_no FROM ({_report_lines()})))"
    ),
    "report_json": (
        "SELECT CAST(0 AS BIGINT) AS line_no, '{\"version\":\"1\",\"timestamp\":\"now\",\"repository\":\"derived\",'"
        " || '\"graph_stats\":{\"nodes\":' || (SELECT count(*) FROM part) || ',\"edges\":' || "
        "(SELECT count(*) FROM lineitem) || '},\"findings\":[' AS line UNION ALL "
        "SELECT n, CASE WHEN n > 1 THEN ',' ELSE '' END || json FROM (SELECT "
        "row_number() OVER (ORDER BY list_position(['dead_code', 'circular_dependency', 'high_coupling', "
        "'architectural_drift'], category), -coalesce(related_fan_out, 0), encode(file), "
        "coalesce(line, 9223372036854775807), encode(name), finding_id) AS n, "
        "CAST(json_object('id', finding_id, 'severity', severity, 'category', category, 'location', "
        "json_object('file', file, 'line', line, 'name', name), 'description', description, "
        f"'remediation', remediation, 'related', {_JSON_RELATED}) AS VARCHAR) AS json FROM findings__layered) "
        "UNION ALL SELECT (SELECT total_count FROM totals__layered) + 1, ']}'"
    ),
    "findings_history": ORACLE["findings_trend"],
    "findings_stored": (
        "SELECT format, finding_id, severity, category, file, line, name, description, remediation, "
        "related_dependencies AS dependencies FROM findings__layered, "
        "(SELECT unnest(['parquet', 'orc', 'json']) AS format)"
    ),
}


def sql_for(key: str) -> str:
    """The query with the CTEs it needs, dependencies first."""
    ordered: list[str] = []

    def need(sql: str, inside: str | None = None) -> None:
        for name in dict.fromkeys(_USED.findall(sql)):
            if name in CTES and name != inside and name not in ordered:
                need(CTES[name], name)
                ordered.append(name)

    need(ORACLE[key])
    body = ", ".join(f"{name} AS ({CTES[name]})" for name in ordered)
    return f"WITH RECURSIVE {body} {ORACLE[key]}" if ordered else ORACLE[key]


def all_sql() -> dict[str, str]:
    return {key: sql_for(key) for key in ORACLE}
