import random
import zlib

import numpy as np

from anchorline.llm import toxicity as X
from anchorline.llm.registry import QUERIES
from tests.llm.plain import FOLDER, documents


def test_the_risk_finds_the_informative_features():
    rnd = random.Random(3)
    texts = [[f for f in range(20) if rnd.random() < 0.3] for _ in range(1500)]
    toxic = [rnd.random() < 0.15 for _ in texts]
    texts = [[*t, *(f for f in (20, 21, 22) if bad and rnd.random() < 0.8)] for t, bad in zip(texts, toxic, strict=True)]
    positive = [t for t, bad in zip(texts, toxic, strict=True) if bad][:120]
    weights, bias = X.fit_nnpu(positive, texts, 23, 0.15)
    assert weights[20:].min() > np.abs(weights[:20]).max()
    scores = [1 / (1 + np.exp(-bias - sum(weights[f] for f in t))) for t in texts]
    assert abs(np.mean(scores) - 0.15) < 0.01
    right = [(s >= 0.3) == bad for s, bad in zip(scores, toxic, strict=True)]
    assert np.mean(right) > 0.97


def corpus(spark, n=400):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.2
        words = [f"w{rnd.randrange(500)}q" for _ in range(rnd.randint(20, 60))]
        words += [rnd.choice(["scum", "Idiot,", "clownish"]) for _ in range(3 if bad else 0)]
        rnd.shuffle(words)
        rows.append((i, " ".join(words), bad))
        if i % 2:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad boolean")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_scores_separate_and_read_nothing_but_the_text(spark):
    docs, labels = corpus(spark)
    model = X.train(docs, labels)
    scored = X.score(docs, model).collect()
    assert np.mean([(r.score >= 0.3) == r.bad for r in scored]) > 0.97
    moved = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "bad")
    assert sorted(r.score for r in X.score(moved, model).collect()) == sorted(r.score for r in scored)


def test_edge_cases(spark):
    docs, labels = corpus(spark)
    model = X.train(docs, labels)
    odd = spark.createDataFrame(
        [(1, None, "a"), (1, "", "b"), (None, "scum", "c"), (2, "scum " * 50_000, "d"), (2, "scum " * 50_000, "d")],
        "doc_id long, text string, score string",
    )
    got = X.score(odd, model).collect()
    assert X.score(odd, model).columns == ["doc_id", "text", "score"] and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and got[3].score == got[4].score
    assert X.score(odd.limit(0), model).count() == 0
    nothing = X.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in X.score(odd, nothing).collect()} == {0.0}
    assert X.train(docs.limit(0), labels) == X.Model({}, float("-inf"))
    twice = labels.unionAll(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    assert X.train(docs, twice).weights.keys() == model.weights.keys()


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    toxic = [got[r.doc_id].predicted for r in held if r.toxic == 1]
    clean = [got[r.doc_id].predicted for r in held if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def test_shares_and_bias_cover_all_texts(spark):
    docs, labels = corpus(spark, 300)
    texts = docs.unionAll(docs.where("doc_id < 50")).select("doc_id", X.text_of().alias("text")).repartition(5)
    all_texts = [r.text for r in texts.collect()]
    wanted = ["scum", "idio*1", "clow*1", "w1q", "nowhere"]
    plain = {f: sum(f in X.text_features(t) for t in all_texts) for f in wanted}
    assert X.shares_of(texts, wanted) == (plain, 350)
    assert X.shares_of(texts.limit(0), wanted)[0] == dict.fromkeys(wanted, 0)
    weights = {"scum": 2.0, "clow*1": 1.5}
    bias = X.bias_over(texts, weights, 0.2)
    assert abs(X.Model(weights, bias).scorer()(all_texts).mean() - 0.2) < 1e-6
    model = X.train(docs, labels, max_unlabelled=40)  # few texts for the steps, all for the bias
    prior = np.mean([r.toxic for r in labels.collect()])
    assert abs(model.scorer()([r.text for r in docs.collect()]).mean() - prior) < 1e-6


def test_a_search_for_features_equals_the_features_of_the_text():
    rnd = random.Random(9)
    words = ["Scum,", "clownish", "clowning", "idiots", "x-ray", "naïve", "a", "12", "STUPIDEST"]
    for _ in range(200):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))
        wanted = set(rnd.sample(sorted(X.text_features(" ".join(words))), 6))
        assert X.finder(wanted)(text) == sorted(X.text_features(text) & wanted)


def test_features_given_up_early_would_not_be_chosen(spark, monkeypatch):
    docs, labels = documents(spark).select("doc_id", "text"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    counted = []
    whole = X.shares_of
    monkeypatch.setattr(X, "shares_of", lambda texts, wanted: counted.append(len(wanted)) or whole(texts, wanted))
    early = X.train(docs, labels, max_unlabelled=300)
    monkeypatch.setattr(X, "SURE", 1e9)
    assert X.train(docs, labels, max_unlabelled=300) == early
    assert counted[0] < counted[1]
