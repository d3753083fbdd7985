"""The label model, the pattern voters and repeated ids of the toxicity operator."""

import numpy as np

from webstrata.llm import toxicity


def test_label_model_learns_from_agreement_alone():
    random = np.random.default_rng(3)
    truth = random.random(4000) < 0.2
    right = np.array([0.7, 0.6, 0.5, 0.4, 0.6])  # how often a voter votes in its own class
    votes = random.random((4000, 5)) < np.where(truth[:, None], right, 0.01)
    # The best that can be known, given the true rates.
    known = np.where(votes, np.log(right / 0.01), np.log((1 - right) / 0.99)).sum(axis=1)
    best = ((known + np.log(0.2 / 0.8) > 0) == truth).mean()
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]])  # one voter three times
    posterior = toxicity.label_model(votes.astype(float), votes[:, :5].sum(axis=1), 0.2)
    assert ((posterior > 0.5) == truth).mean() > best - 0.02
    assert abs(posterior.mean() - 0.2) < 1e-3
    # Labels only name the side.
    assert (toxicity.toxic_side(posterior, truth.astype(float)) == posterior).all()
    assert np.allclose(toxicity.toxic_side(1 - posterior, truth.astype(float)), posterior)


def test_looks_and_hidden_words():
    def looks(text):
        seen, hidden = toxicity.looks_of(text)
        return [toxicity.PATTERNS[k] for k in seen], hidden

    assert looks("such an i d i o t here") == (["spaced"], {"idiot"})
    kinds, hidden = looks("such a m0r0n!")
    assert kinds == ["masked"] and "moron" in hidden
    kinds, hidden = looks("what a looooser")
    assert kinds == ["stretched"] and {"loser", "looser"} <= hidden
    assert looks("You are a fool.")[0] == ["address"]
    assert looks("GET OUT NOW!")[0] == ["shouted"]
    assert looks(None) == ([], set()) and looks("") == ([], set())
    assert looks("a plain text, with 1,024 words") == ([], set())
    toxicity.looks_of("x" * 3_000_000 + "0a1b2c" * 100_000)  # long runs cost no more than their length


def test_repeated_ids_and_clashing_columns(spark):
    bad, good = "what a grubby blorp they be", "a fine day it was by the sea"
    rows = [(i, (bad if i % 3 == 0 else good) + f" w{i}", "mine") for i in range(300)]
    rows += [(3, None, "mine"), (3, "zz " + good, "mine"), (None, bad, "mine")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)],
                                   "doc_id bigint, toxic int")
    first = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.orderBy("text").repartition(5), labels)
    assert first.lexicon == again.lexicon and np.array_equal(first.weights, again.weights)
    assert first.score(bad) > 0.5 > first.score(good)
    assert first.score("b l o r p") > first.score("")
    scored = toxicity.score(docs.withColumn("score", docs["text"]), first)
    assert scored.columns == ["doc_id", "text", "other", "score", "predicted"]
    assert scored.count() == len(rows)
