import random

import pytest
from pyspark.sql import functions as F

from modgauge.operators import cycles, returns
from modgauge.operators.chains import contracted
from modgauge.operators.cycle_core import cyclic_core
from modgauge.operators.cycles import (
    canonical_cycle,
    long_cycles,
    pair_cycles,
    weakest_edges,
)
from modgauge.plans.findings import long_cycle_findings, pair_cycle_findings
from modgauge.runtime import Rounds


def found(edges):
    return {(tuple(r["path"]), r["total_refs"]) for r in long_cycles(edges).collect()}


def ring(names, weight=1):
    return [(a, b, weight + i) for i, (a, b) in enumerate(zip(names, [*names[1:], names[0]]))]


def test_ring_of_five_starts_at_its_smallest_module(edges_of):
    names = ["kiln", "loom", "anvil", "mill", "forge"]
    assert found(edges_of(ring(names, 4))) == {(("anvil", "mill", "forge", "kiln", "loom"), 30)}


def test_pairs_and_trees_have_no_long_cycle(edges_of):
    pairs = [("kiln", "loom", 3), ("loom", "kiln", 8), ("loom", "mill", 2), ("mill", "loom", 2)]
    assert found(edges_of(pairs)) == set()
    tree = [("root", f"n{i}", 1) for i in range(4)] + [("n0", "leaf", 6), ("n3", "leaf", 6)]
    assert found(edges_of(tree)) == set()
    assert found(edges_of([])) == set()


def test_two_rings_through_one_module(edges_of):
    left, right = ring(["hub", "p", "q", "r"], 10), ring(["hub", "x", "y"], 2)
    assert found(edges_of(left + right)) == {
        (("hub", "p", "q", "r"), 46),
        (("hub", "x", "y"), 9),
    }


def test_of_two_directions_the_heavier_is_reported(edges_of):
    names = ["ash", "birch", "cedar", "fir"]
    light, heavy = ring(names, 1), ring(list(reversed(names)), 20)
    assert found(edges_of(light + heavy)) == {(("ash", "fir", "cedar", "birch"), 86)}
    assert sorted(r["total_refs"] for r in pair_cycles(edges_of(light + heavy)).collect()) == [
        23, 23, 23, 27,
    ]
    even = [(a, b, 7) for a, b, _ in light + heavy]
    assert found(edges_of(even)) == {(tuple(names), 28)}


def test_weakest_edge(edges_of):
    edges = edges_of([("oak", "elm", 14), ("elm", "yew", 5), ("yew", "pine", 6), ("pine", "oak", 5)])
    row = weakest_edges(long_cycles(edges)).first()
    assert (row["src_module"], row["dst_module"], row["ref_count"]) == ("elm", "yew", 5)


def brute_force(edges):
    """All simple cycles of three or more nodes, heavier direction, by plain search."""
    weights = {(a, b): w for a, b, w in edges}
    best = {}

    def walk(path, total):
        for (a, b), w in weights.items():
            if a != path[-1]:
                continue
            if b == path[0] and len(path) >= 3:
                backwards = (path[0], *reversed(path[1:]))
                key = min(tuple(path), backwards)
                candidate = (total + w, tuple(path) == key, tuple(path))
                best[key] = max(best.get(key, candidate), candidate)
            elif b > path[0] and b not in path:
                walk([*path, b], total + w)

    for node in {a for a, _, _ in edges}:
        walk([node], 0)
    return {(path, total) for total, _, path in best.values()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs_against_brute_force(edges_of, seed):
    rng = random.Random(seed)
    nodes = [f"m{i}" for i in range(8)]
    rows = [
        (a, b, rng.randint(1, 9))
        for a in nodes
        for b in nodes
        if a != b and rng.random() < 0.26
    ]
    assert found(edges_of(rows)) == brute_force(rows)


def test_acyclic_part_is_not_walked(edges_of):
    """2**19 paths lie between the two rings; none is on a cycle."""
    names = [f"m{i:02d}" for i in range(25)]
    rows = [(a, b, 1) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows += [(names[2], names[0], 1), (names[24], names[22], 1)]
    assert {path for path, _ in found(edges_of(rows))} == {tuple(names[0:3]), tuple(names[22:25])}


def test_dense_part_that_leads_nowhere_adds_no_paths(spark, edges_of):
    """One strong component, but of its 2**18 upward paths only those home are walked."""
    names = [f"m{i:02d}" for i in range(20)]
    rows = [(a, b, 1) for i, a in enumerate(names[1:], 1) for b in names[i + 1 :]]
    # All are strongly connected through m00, which only a two-step way leaves.
    rows += [(names[-1], "m00", 1), ("m00", names[1], 1)]
    rounds = Rounds(spark)
    core, count = cyclic_core(with_reverse(edges_of(rows)), len(rows), rounds)
    numbered, _ = rounds.written(returns.numbered_edges(core, rounds), n=F.count("*"))
    kept = returns.ways_back(numbered, rounds).collect()
    starts = {64 * r["word"] + bit for r in kept for bit in range(64) if r["bits"] >> bit & 1}
    assert starts == {0}  # m00


def with_reverse(edges):
    return cycles._with_reverse(edges)


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    result = work()
    spark.sparkContext.setJobGroup("other", "other")
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_core_of_a_long_ring_takes_few_jobs(spark, edges_of):
    edges = with_reverse(edges_of(ring([f"m{i}" for i in range(600)])))
    (core, count), jobs = jobs_of(spark, "ring", lambda: cyclic_core(edges, 600, Rounds(spark)))
    assert core.count() == count == 600
    assert jobs < 60, jobs  # about three for each of eleven rounds


def test_long_ring_takes_few_jobs(spark, edges_of):
    names = [f"m{i}" for i in range(600)]
    edges = edges_of(ring(names))
    rows, jobs = jobs_of(spark, "long ring", lambda: found(edges))
    at = names.index(min(names))
    assert rows == {(tuple(names[at:] + names[:at]), 600 + 599 * 300)}
    assert jobs < 40, jobs


def test_contraction_leaves_junctions_and_takes_out_loops(spark, edges_of):
    """Two modules joined by three ways, a dead end on one of them, and a ring through the first."""
    ways = [("a", "x1", 5), ("x1", "x2", 2), ("x2", "b", 4), ("a", "b", 1), ("b", "y", 3), ("y", "a", 7), ("x1", "end", 1)]
    hub = [("a", "p", 1), ("p", "q", 1), ("q", "a", 1)]
    alone = ring(["r3", "r1", "r2"], 2)
    edges, count, loops = contracted(with_reverse(edges_of(ways + hub + alone)), 13, Rounds(spark))
    left = {(r["src"], r["dst"], tuple(r["inner"]), r["refs"]) for r in edges.collect()}
    assert left == {
        ("a", "x1", (), 5), ("x1", "b", ("x2",), 6), ("a", "b", (), 1), ("b", "a", ("y",), 10), ("x1", "end", (), 1),
    }
    assert count == 5
    out = {(r["src"], tuple(r["inner"]), r["refs"], r["weakest"]["ref_count"]) for part in loops for r in part.collect()}
    assert out == {("a", ("p", "q"), 3, 1), ("r1", ("r2", "r3"), 9, 2)}


@pytest.mark.parametrize("seed", range(6))
def test_graphs_with_chains_against_brute_force(edges_of, seed):
    """Random graphs whose edges are cut into chains of up to four, some with their reverse."""
    rng = random.Random(100 + seed)
    rows, n = {}, 0
    for a in range(6):
        for b in range(6):
            if a != b and rng.random() < 0.4:
                inner = [f"c{rng.randrange(1000):03d}x{n + i}" for i in range(rng.choice([0, 0, 1, 3]))]
                n += 4
                path = [f"m{a}", *inner, f"m{b}"]
                for x, y in zip(path, path[1:]):
                    rows[x, y] = rng.randint(1, 5)
                    if inner and rng.random() < 0.5:
                        rows[y, x] = rng.randint(1, 5)
    edges = [(a, b, w) for (a, b), w in rows.items()]
    assert found(edges_of(edges)) == brute_force(edges)


def test_more_starts_than_one_word_holds(edges_of):
    """Eighty triangles and a two-way ladder: starts in several words, one of them negative as a number."""
    rows = [e for i in range(80) for e in ring([f"t{i:03d}a", f"t{i:03d}b", f"t{i:03d}c"])]
    rows += [(f"t{i:03d}a", f"t{i + 1:03d}a", 1) for i in range(79)]
    rows += [(f"t{i + 1:03d}a", f"t{i:03d}b", 1) for i in range(0, 79, 9)]
    assert found(edges_of(rows)) == brute_force(rows)


def test_files_of_the_rounds_are_removed(spark, edges_of, tmp_path):
    import glob

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/rounds-*"))
    cycle = long_cycles(edges_of([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("c", "b", 1)]))
    assert set(glob.glob(f"{folder}/rounds-*")) == before
    assert cycle.count() == 1


@pytest.mark.parametrize("a,b", [("pqrst", "rstpq"), ("pqrst", "tpqrs"), ("pqrst", "ptsrq"), ("pqrst", "rqpts")])
def test_canonical_key_ignores_rotation_and_direction(spark, a, b):
    df = spark.createDataFrame([(list(a),), (list(b),)], "path array<string>")
    assert df.select(canonical_cycle(F.col("path"))).distinct().count() == 1


def test_pair_threshold(edges_of):
    edges = edges_of(
        [("a", "b", 12), ("b", "a", 8), ("c", "d", 12), ("d", "c", 9), ("a", "d", 99)]
    )
    rows = {(r["module_a"], r["module_b"]): r for r in pair_cycles(edges).collect()}
    assert {k: (r["total_refs"], r["severity"]) for k, r in rows.items()} == {
        ("a", "b"): (20, "warning"),
        ("c", "d"): (21, "critical"),
    }


def test_texts(edges_of):
    pair = pair_cycle_findings(pair_cycles(edges_of([("a", "b", 3), ("b", "a", 4)]))).first()
    assert pair["description"] == (
        "Circular dependency between `a` and `b`: 7 cross-references (a -> b, b -> a)."
    )
    assert (pair["location"]["file"], pair["location"]["name"]) == ("a/", "a <-> b")
    cycle = long_cycle_findings(
        long_cycles(edges_of([("a", "b", 1), ("b", "c", 2), ("c", "a", 3)]))
    ).first()
    assert cycle["description"].startswith(
        "Dependency cycle involving 3 modules: `a` -> `b` -> `c` -> a (6 total cross-references)."
    )
    assert (cycle["location"]["file"], cycle["location"]["name"]) == ("a/", "cycle(3)")
    assert cycle["related"]["other_module"] == "`a` -> `b` -> `c`"
    assert cycle["severity"] == "critical"


def test_identity_survives_a_turned_cycle(edges_of):
    one_way = [("a", "b", 9), ("b", "c", 9), ("c", "a", 9)]
    other_way = [("a", "c", 5), ("c", "b", 5), ("b", "a", 5)]
    keys = {
        long_cycle_findings(long_cycles(edges_of(rows))).first()["diff_key"]
        for rows in (one_way, other_way, one_way + other_way)
    }
    assert len(keys) == 1
