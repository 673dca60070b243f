"""Table contracts: the two input tables and the findings table."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(name: str, nullable: bool = False) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable)


DEFINITIONS = T.StructType(
    [
        _text("name"),
        _text("file"),
        _text("kind"),
        T.StructField("line", T.LongType(), True),
    ]
)

REFERENCES = T.StructType(
    [
        _text("source_file"),
        _text("source_name"),
        _text("target_file"),
        _text("target_name"),
    ]
)

LOCATION = T.StructType(
    [_text("file"), T.StructField("line", T.LongType(), True), _text("name")]
)

# One nullable struct instead of a union: a finding fills only the fields of
# its own category, and to_json leaves the others out.
RELATED = T.StructType(
    [
        _text("other_module", True),
        T.StructField("cycle_count", T.LongType(), True),
        _text("module_name", True),
        T.StructField("fan_out", T.LongType(), True),
        T.StructField("dependencies", T.ArrayType(T.StringType()), True),
        _text("target_name", True),
        _text("target_file", True),
        _text("boundary_name", True),
        _text("boundary_rule", True),
        _text("kind", True),
    ]
)

FINDINGS = T.StructType(
    [
        _text("finding_id"),
        _text("diff_key"),
        _text("severity"),
        T.StructField("severity_rank", T.IntegerType(), False),
        _text("category"),
        T.StructField("location", LOCATION, False),
        _text("description"),
        _text("remediation"),
        T.StructField("related", RELATED, False),
    ]
)
