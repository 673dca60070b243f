"""The network against plain loops, held-out accuracy, and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import TESTDATA
from modgauge.llm import langid, queries


def test_reader_equals_plain_loops():
    rng = np.random.default_rng(1)
    network = langid.Network.fresh(["a", "b", "c"])
    data = rng.integers(0, 256, 700).astype(np.uint8)
    starts = np.array([0, 256, 512])
    windows = langid.windows_of(data, starts, np.array([256, 512, 700]))
    got = langid.Reader(network).probabilities(windows)
    for i, start in enumerate(starts):
        held = [*data[start : min(start + 256, 700)].tolist()]
        held += [0] * (langid.WINDOW + langid._REACH - len(held))
        hidden = []
        for f in range(langid._SIZE):
            width = langid.WIDTHS[f // langid.FILTERS]
            values = [
                sum(float(network.tables[j][held[p + j], f - langid._FIRST[j]]) for j in range(width))
                for p in range(langid.WINDOW)
            ]
            hidden.append(max(0.0, max(values) + float(network.bias[f])))
        z = np.array(hidden) @ network.dense[:-1] + network.dense[-1]
        expected = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        # A window stops at the next one's bytes; those are zero here only at the end.
        if i == 2:
            assert np.allclose(got[i], expected, atol=1e-4)
    own = network.values(windows).max(axis=1) + network.bias
    z = np.maximum(own, 0) @ network.dense[:-1] + network.dense[-1]
    assert np.allclose(got, langid._softmax(z), atol=1e-4)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    network = langid.Network.fresh(["a", "b"])
    windows = rng.integers(97, 123, (4, langid.WINDOW + langid._REACH)).astype(np.uint8)
    label, weight = np.array([0, 1, 1, 0]), np.full(4, 0.25, np.float32)

    def loss():
        p = network.values(windows).max(axis=1) + network.bias
        p = langid._softmax(np.maximum(p, 0) @ network.dense[:-1] + network.dense[-1])
        return -(weight * np.log(p[np.arange(4), label])).sum()

    for p, g in zip(network.parameters(), network.gradients(windows, label, weight), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = p[at]
        p[at] = kept + 1e-3
        up = loss()
        p[at] = kept - 1e-3
        down = loss()
        p[at] = kept
        assert abs((up - down) / 2e-3 - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_held_out_accuracy_on_given_texts(spark):
    folder = f"{TESTDATA}/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op13_langid(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 < r.score <= 1 and r.lang_pred in ("de", "en", "es", "fr") for r in got)
    unseen = [r for r in got if r.held_out]
    assert len(unseen) > 150
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in unseen) >= 0.98 * len(unseen)


def rows_of(spark):
    de, fr = "der hund und die katze sind nicht im garten ", "le chien et la chatte ne sont pas dans le jardin "
    rows = [(i, de * (1 + i % 9), "de", "x") for i in range(60)] + [(100 + i, fr * (1 + i % 9), "fr", "x") for i in range(60)]
    rows += [(300 + i, "der hund ist " * 3, "de", "x") for i in range(200)]  # copies
    rows += [(900, None, "de", "x"), (901, "", "fr", "x"), (902, "12 34 !?", "fr", "x"), (903, de, None, "x"), (None, fr, "fr", "x"),
             (904, (fr * 40_000), None, "x"), (905, "é", None, "x"), (903, de, None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")


def test_odd_rows(spark):
    docs = rows_of(spark)
    got = langid.languages(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[903].lang_pred == "de" and by[904].lang_pred == "fr" and by[905].lang_pred in ("de", "fr")
    assert by[None].held_out and by[None].lang_pred == "fr"
    assert len([r for r in got if r.doc_id == 903]) == 2
    # The same rows in another order give the same predictions.
    again = langid.languages(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_nothing_to_learn_from(spark):
    docs = rows_of(spark)
    assert langid.languages(docs.limit(0)).collect() == []
    unlabelled = langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_held_out_rows_and_their_languages_teach_nothing(spark):
    docs = rows_of(spark)
    turned = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(str, langid.languages(turned).collect())) == sorted(map(str, langid.languages(docs).collect()))
