"""The schedule against its definition, the mix against a row-by-row version."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

from conftest import TESTDATA
from modgauge.llm import mixing, queries


def plain_slots(blocks, weights):
    """All slots one after another: release times, deadlines, earliest first."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        shares = mixing.whole_shares({s: weights[s] for s in left}, max(mixing.PERIOD, 2 * len(left)))
        period, done, t = sum(shares.values()), dict.fromkeys(left, 0), 0
        while True:
            ready = [s for s, e in shares.items() if done[s] * period // e <= t]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * period // shares[s]), s))
            if done[s] == left[s]:
                break
            out.append(s)
            done[s] += 1
            t += 1
        left = {s: n - done[s] for s, n in left.items() if n > done[s]}
    return out


def slots_of(plan):
    found = {}
    for p in plan:
        for s, at in p["slots"].items():
            for k in range(p["first"][s], p["last"][s]):
                rounds, i = divmod(k - p["first"][s], len(at))
                found[p["start"] + rounds * p["period"] + at[i]] = s
    return [found[t] for t in sorted(found)], sorted(found)


def test_schedule_is_the_definition(monkeypatch):
    rng = random.Random(3)
    for period in (12, 50, 1000):
        monkeypatch.setattr(mixing, "PERIOD", period)
        for _ in range(15):
            names = [f"s{i}" for i in range(rng.randrange(1, 7))]
            blocks = {s: rng.choice([0, 1, 5, 40, 300]) for s in names}
            weights = {s: rng.choice([1, 2, 0.3, 7.5, 100]) for s in names}
            order, slots = slots_of(mixing.phases(blocks, weights))
            assert slots == list(range(len(slots)))
            assert order == plain_slots(blocks, weights)
            assert Counter(order) == {s: n for s, n in blocks.items() if n}


def test_never_a_block_off():
    shares = mixing.whole_shares({"a": 5, "b": 3.3, "c": 1, "d": 0.001}, 1000)
    assert sum(shares.values()) == 1000 and min(shares.values()) >= 1
    done = Counter()
    for t, s in enumerate(mixing.one_period(shares), 1):
        done[s] += 1
        assert all(abs(done[x] - e * t / 1000) < 1 for x, e in shares.items())
    assert done == shares


def test_never_a_block_off_the_given_weights():
    small = {f"s{i:02}": 1.0 for i in range(19)}
    for weights in (
        {"hot": 0.9} | {f"s{i}": 0.01 for i in range(10)},
        {"hot": (19 / 2) ** 0.5} | small,
        {"rare": 0.0001, "a": 0.3333, "b": 0.6666},
    ):
        total = sum(map(Fraction, weights.values()))
        first = mixing.phases({s: int(30_000 * w / total) + 9 for s, w in weights.items()}, weights)[0]
        order, _ = slots_of([first])
        assert len(order) > 25_000
        done, at = Counter(), {s: Fraction(w) / total for s, w in weights.items()}
        for t, s in enumerate(order, 1):
            done[s] += 1
            assert t % 7 or all(abs(done[x] - w * t) < 1 + Fraction(1, 10**9) for x, w in at.items())


def test_query_on_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 40)  # several hash ranges for each source
    folder = f"{TESTDATA}/sf0.01"
    rows = queries.op8_mixing(spark, folder).collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: r.source for r in rows} == docs
    sizes = Counter(docs.values())
    blocks = {s: -(-n // mixing.BLOCK) for s, n in sizes.items()}
    expected = plain_slots(blocks, {s: n**mixing.TEMPERATURE for s, n in sizes.items()})
    by_slot = defaultdict(list)
    for r in rows:
        by_slot[r.slot].append(r)
    assert [by_slot[t][0].source for t in range(len(expected))] == expected
    seen = Counter()
    for t in range(len(expected)):
        held = by_slot[t]
        s = held[0].source
        assert {(r.source, r.block) for r in held} == {(s, seen[s])}
        seen[s] += 1
        last = seen[s] == blocks[s]
        assert sorted(r.place for r in held) == list(range(len(held)))
        assert last or len(held) == mixing.BLOCK


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    rows = [(i, f"t{i}", ["a", "b", None, "", "c"][i % 5], 1) for i in range(60)]
    rows += [(None, None, "a", 2), (1, "t1", "b", 1), (1, "t1", "b", 1), (5, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slots int")
    mixed = mixing.mix(docs, block=4)
    got = mixed.collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    assert len({(r._mix_slot, r._mix_place) for r in got}) == len(rows)
    assert {r._mix_slot for r in got} == set(range(max(r._mix_slot for r in got) + 1))
    ordered = mixing.in_order(mixed, 1 + max(r._mix_slot for r in got), 3, docs.columns)
    key = sorted(got, key=lambda r: (r._mix_slot, r._mix_place))
    assert [tuple(r) for r in ordered.collect()] == [tuple(r)[:4] for r in key]
    assert mixing.mix(docs.limit(0)).collect() == []
    assert len(mixing.mix(docs, {"a": 3.0, "zz": 1.0}).collect()) == len(rows)
