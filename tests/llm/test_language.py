"""The recurrent network: gradients, held-out accuracy and edge cases."""

import os

import numpy as np
import pytest

from tidewake.llm import language_id as li

FOLDER = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = li.fresh(["a", "b", "c"], 4, 1)
    net = li.Network(net.labels, *[w.astype(np.float64) for w in net.arrays()])
    lanes = rng.integers(0, 5, (7, 6))
    lanes[5:, 2] = li.PAD
    target = rng.integers(0, 3, 6)
    _, grads = li.gradients(net, lanes, target)
    for w, g in zip(net.arrays(), grads):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in w.shape) if w is not net.byte else (rng.integers(2), rng.integers(0, 5), rng.integers(12))
            old, eps = w[at], 1e-3
            w[at] = old + eps
            up = li.gradients(net, lanes, target)[0]
            w[at] = old - eps
            down = li.gradients(net, lanes, target)[0]
            w[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3


def test_positions_and_long_texts():
    net = li.fresh(["a", "b"], 4, 1)
    chance = li.positions(net, np.array([[1, 2], [3, li.PAD]]))
    assert chance.shape == (2, 2, 2) and np.allclose(chance.sum(axis=2), 1, atol=1e-5)
    pieces = [b"abc" * 100, b"", b"x" * 200_000]
    whole = li.document_chances(net, pieces)
    assert np.allclose(whole[0], li.document_chances(net, pieces[:1])[0], atol=1e-5) and whole[1].sum() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    from tidewake.llm.query_language import op10_language
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    got = op10_language(spark, FOLDER).toPandas()
    own = got[got.held_out]
    assert (own.lang_pred.values == truth.loc[own.doc_id].values).mean() > 0.95
    assert len(got) == len(truth) and got.score.between(0, 1).all()


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "le chat et le chien", "fr", "x"), (3, None, "en", "x"), (4, "", "fr", "x"),
            (5, "123 !?", None, "x"), (6, "été", None, "x"), (2, "le chat et le chien", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string")
    got = li.predict(df, li.train(df)).collect()
    assert len(got) == 7 and [r.lang_pred for r in got if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in li.predict(df, li.train(df.limit(0))).collect()} == {"und"}
    assert li.predict(df.limit(0), li.train(df)).count() == 0
