"""Language profiles and toxicity scores: held-out accuracy and odd texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortry.llm import language_id, toxicity
from cohortry.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prototypes = language_id.learn_prototypes(docs.where(~held_out("doc_id")))
    judged = language_id.identify_languages(docs, prototypes).where(held_out("doc_id") & (F.col("n_chars") > 100))
    right, n = judged.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97
    assert judged.where("score < 0 or score > 1").count() == 0


def test_odd_texts_and_clashing_columns(documents):
    docs = documents((1, "the cat and the dog and the house", "en"), (2, "der Hund und die Katze und das Haus", "de"), (3, None, "en"), (4, "123 !!", None),
                     (5, "", "de"), (6, "the and " * 200_000, None), (2, "der Hund und die Katze und das Haus", "de"), (7, "𐐨𐐩 中文", None))
    prototypes = language_id.learn_prototypes(docs)
    assert list(prototypes) == ["de", "en"]
    found = language_id.identify_languages(docs.withColumn("score", F.lit("old")), prototypes).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 8 and by_id[1]["lang_pred"] == "en" and by_id[2]["lang_pred"] == "de" and by_id[6]["lang_pred"] == "en"
    assert [by_id[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and by_id[3]["score"] == 0
    assert by_id[7]["lang_pred"] in ("de", "en")
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, {}).collect()} == {"und"}
    assert language_id.identify_languages(docs.limit(0), prototypes).collect() == []
    assert language_id.learn_prototypes(docs.limit(0)) == {}


def test_profile_is_the_bundle_of_bound_trigrams():
    vectors, letters = language_id.profiles(["abc"])
    a = language_id.letter_vectors().astype(float)
    grams = [(0, 1, 2), (1, 2, 3), (2, 3, 0)]
    wanted = sum(np.roll(a[x], 2) * np.roll(a[y], 1) * a[z] for x, y, z in grams)
    assert np.array_equal(vectors[0], wanted) and letters[0] == 3


def _random_texts(n, seed=1):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        some = list(rng.choice(words, rng.integers(3, 150)))
        labels.append(i % 3 == 0)
        if labels[-1]:
            for _ in range(2):
                some.insert(int(rng.integers(len(some))), "zorgq" + "".join(rng.choice(list("abcdefgh"), 2)))
        texts.append(" ".join(some))
    return texts, np.array(labels, float)


def test_toxicity_learns_stems_of_unseen_words():
    texts, labels = _random_texts(700)
    net = toxicity.train(texts[:450], labels[:450])
    found, best = net.score(toxicity.read_all(pa.array(texts[450:], pa.large_string())))
    said = found[best] >= 0.7
    assert (said == labels[450:]).mean() > 0.95


def test_gradients_agree_with_differences():
    words = toxicity.read_words(pa.array(["ab cd ef gh ab", "xy ab cd"], pa.large_string()))
    net = toxicity.Network(3)
    rng = np.random.default_rng(0)
    for name, value in net.weights.items():
        net.weights[name] = rng.standard_normal(value.shape).astype(np.float64)
    gates = rng.standard_normal((2, 5, 6 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool)
    keep: dict = {}
    net.forward(gates, mask, keep)
    out = net.weights["out"]
    states, weight = keep["states"], keep["weight"]
    value = np.einsum("h,tnh->tn", out, states)
    by_weight = weight * (value - (weight * value).sum(axis=0))
    by_states = weight[:, :, None] * out + by_weight[:, :, None] * net.weights["attend"]
    ahead, own = net._layer_grad(keep["ahead"], mask, net.weights["ahead"], by_states[:, :, :toxicity.HIDDEN])
    for n, t, k in ((0, 2, 1), (1, 0, 25), (1, 2, 12), (0, 4, 7)):
        step = 1e-3
        high, low = gates.copy(), gates.copy()
        high[n, t, k] += step
        low[n, t, k] -= step
        slope = (net.forward(high, mask).sum() - net.forward(low, mask).sum()) / (2 * step)
        assert abs(slope - ahead[n, t, k]) < 2e-3 * max(1, abs(slope))
    assert own.shape == net.weights["ahead"].shape and len(words.first) == 3


def test_windows_cover_every_word():
    first = np.array([0, 0, 1, 48, 200, 200])
    owner, begin, length = toxicity.windows(first)
    covered = set()
    for o, b, n in zip(owner, begin, length):
        assert first[o] <= b and b + n <= first[o + 1] and 0 < n <= toxicity.WINDOW
        covered.update(range(b, b + n))
    assert covered == set(range(200)) and 0 not in owner and 4 not in owner


def test_passages_are_whole_in_a_window_wherever_they_stand():
    _, begin, length = toxicity.windows(np.array([0, 400]))
    for size, least in ((16, 16), (32, 32), (48, 42)):
        for place in range(0, 400 - size):
            inside = np.minimum(begin + length, place + size) - np.maximum(begin, place)
            assert inside.max() >= least


def test_toxicity_of_odd_texts(spark, documents):
    docs = documents((1, "fine words here", None), (2, None), (3, ""), (4, "!!! ..."), (5, "word " * 100_000), (1, "fine words here"), (None, "no id"))
    labels = spark.createDataFrame(pa.table({"doc_id": pa.array([1, 5], pa.int64()), "toxic": pa.array([0, 1], pa.int32())}))
    net = toxicity.learn_toxicity(docs, labels)
    found = toxicity.score_toxicity(docs.withColumn("toxicity", F.lit(1)), net).collect()
    by_id = {r["doc_id"]: r["toxicity"] for r in found}
    assert len(found) == 7 and by_id[2] == by_id[3] == by_id[4] == 0 and all(0 <= v <= 1 for v in by_id.values())
    assert toxicity.score_toxicity(docs.limit(0), net).collect() == []
    silent = toxicity.learn_toxicity(docs, labels.limit(0))
    assert all(r["toxicity"] < 0.5 for r in toxicity.score_toxicity(docs, silent).collect())
