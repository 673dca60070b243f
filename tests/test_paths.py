import pytest
from pyspark.sql import functions as F

from modgauge.functions.globs import any_glob, glob_to_regex, matches_glob
from modgauge.functions.paths import basename, module_of
from modgauge.functions.severity import rank_of, severity_label, severity_rank

MODULES = {
    "src/billing/invoice.py": "billing",
    "./src/billing/tax/vat.py": "billing",
    "/src/ledger/book.py": "ledger",
    "tools/gen/make.py": "tools",
    "cmd/serve.go": "cmd",
    "setup.py": "root",
    "Makefile": "root",
    "src/app.py": "src",
    "": "root",
    "tools/": "tools",
    "src//late.py": "",
    "//src/early.py": "",
    "././src/b/c.py": ".",
    "src/": "src",
    "src/billing/": "billing",
    "srcs/billing/x.py": "srcs",
    "/": "root",
    "./": "root",
    "./run.py": "root",
}

GLOBS = [
    ("lib/kiln/**", "lib/kiln/fire.py", True),
    ("lib/kiln/**", "lib/kiln/brick/a/clay.py", True),
    ("lib/kiln/**", "lib/kiln", False),
    ("lib/kiln/**", "lib/kilns/fire.py", False),
    ("lib/kiln/**", "./lib/kiln/fire.py", False),
    ("tests/**", "src/tests/a.rs", False),
    ("**/*.test.*", "a.test.ts", True),
    ("**/*.test.*", "src/x/a.test.ts", True),
    ("src/**/n.rs", "src/n.rs", True),
    ("src/**/n.rs", "src/a/b/n.rs", True),
    ("src/**/n.rs", "src/an.rs", False),
    ("**/n.rs", "n.rs", True),
    ("**/n.rs", "a/n.rs", True),
    ("**/n.rs", "an.rs", False),
    ("*.rs", "src/a/b.rs", True),
    ("src/?.rs", "src/x.rs", True),
    ("src?x.rs", "src/x.rs", True),
    ("a.rs", "axrs", False),
    ("a.rs", "A.rs", False),
    ("[ab].rs", "c.rs", False),
    ("[ab].rs", "b.rs", True),
    ("[!ab].rs", "c.rs", True),
    ("[!ab].rs", "a.rs", False),
    ("[a-c]x", "bx", True),
    ("[c-a]x", "bx", False),
    ("[]]x", "]x", True),
    ("[!]]x", "ax", True),
    ("[a-]", "-", True),
    ("[?]", "?", True),
    ("[?]", "x", False),
    ("{a,b}.rs", "a.rs", False),
    ("{a,b}.rs", "{a,b}.rs", True),
    ("a\\*", "a\\b", True),
    ("src/a**", "src/ab", False),
    ("a***", "ab", False),
    ("[a", "[a", False),
    ("[!]", "!", False),
    ("**", "any/thing", True),
    ("**/", "any/thing", True),
    ("src/**/**/n.rs", "src/n.rs", True),
    ("", "", True),
    ("", "a", False),
    ("*", "", True),
    (".*", ".hidden", True),
    ("*", ".hidden", True),
    ("a+b(c).rs", "a+b(c).rs", True),
    ("*a", "line\nbreak/a", True),
]


def test_module_of(spark):
    df = spark.createDataFrame([(p,) for p in MODULES] + [(None,)], "file string")
    got = dict(df.select("file", module_of(F.col("file"))).collect())
    assert got == {**MODULES, None: None}


def test_basename(spark):
    df = spark.createDataFrame([("src/a/mod.rs",), ("mod.rs",), ("a/",)], "file string")
    assert [r[0] for r in df.select(basename(F.col("file"))).collect()] == [
        "mod.rs",
        "mod.rs",
        "",
    ]


def test_globs(spark):
    paths = spark.createDataFrame(sorted({(p,) for _, p, _ in GLOBS}), "file string")
    globs = list(dict.fromkeys(g for g, _, _ in GLOBS))
    columns = [matches_glob(F.col("file"), g).alias(f"g{i}") for i, g in enumerate(globs)]
    rows = {r["file"]: r for r in paths.select("file", *columns).collect()}
    for glob, path, expected in GLOBS:
        assert rows[path][f"g{globs.index(glob)}"] is expected, (glob, path)


def test_native_and_regular_expression_globs_agree(spark):
    paths = spark.createDataFrame(
        sorted({(p,) for _, p, _ in GLOBS} | {(p,) for p in MODULES}), "file string"
    )
    for glob in dict.fromkeys(g for g, _, _ in GLOBS):
        regex = glob_to_regex(glob)
        by_regex = F.col("file").rlike(regex) if regex is not None else F.lit(False)
        assert paths.filter(matches_glob(F.col("file"), glob) != by_regex).isEmpty(), glob


def test_any_glob_takes_no_globs_and_malformed_ones(spark):
    df = spark.createDataFrame([("a/b.rs",)], "file string")
    file = F.col("file")
    row = df.select(
        any_glob(file, []), any_glob(file, ["x**", "[z"]), any_glob(file, ["x**", "a/*"])
    ).first()
    assert tuple(row) == (False, False, True)


@pytest.mark.parametrize("text,rank", [("CRITICAL", 2), ("Warning", 1), ("info", 0), ("xyz", 0)])
def test_severity_words(spark, text, rank):
    df = spark.createDataFrame([(text,)], "s string")
    row = df.select(severity_rank(F.col("s")), severity_label(severity_rank(F.col("s")))).first()
    assert row[0] == rank == rank_of(text)
    assert row[1] == ("info", "warning", "critical")[rank]
