import numpy as np
import pytest
from pyspark.sql import functions as F

from classmeter.llm import quality, queries, toxicity
from classmeter.llm.common import held_out

SF = "/root/testdata/sf0.1"


def judged(spark, query, label):
    scored = query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    return np.array([r[label] for r in rows]), np.array([r.predicted for r in rows]), np.array([r.score for r in rows])


def auc(y, score):
    better = score[y == 1][:, None] - score[y == 0][None, :]
    return ((better > 0) + 0.5 * (better == 0)).mean()


def test_quality_of_held_out_documents(spark):
    y, predicted, score = judged(spark, queries.op4_quality, "quality")
    assert (y == predicted).mean() > 0.99 and auc(y, score) > 0.99


def test_toxicity_of_held_out_documents(spark):
    y, predicted, score = judged(spark, queries.op3_toxicity, "toxic")
    assert (y == predicted).mean() > 0.95 and auc(y, score) > 0.94


def test_folds(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3_000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality.fit_trees(x[:2_000], y[:2_000])
    assert ((model.scores(x[2_000:]) > 0.5) == y[2_000:]).mean() > 0.97


def test_flat_trees_score_like_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((200, 3))
    model = quality.fit_trees(x, (x[:, 0] + 0.2 * rng.random(200) > 0.6).astype(float), trees=5, depth=3)
    for row, score in zip(x, model.scores(x)):
        total = model.base
        for feature, bound, value in zip(model.feature, model.bound, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > bound[node] else 1)
            total += value[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("y, score", [([], 0.5), ([1, 1], 0.99), ([0], 0.01)])
def test_trees_without_both_labels(y, score):
    model = quality.fit_trees(np.zeros((len(y), 2)), np.array(y, float))
    assert model.scores(np.ones((3, 2))) == pytest.approx([score] * 3)


def test_statistics():
    assert quality.statistics(None) == quality.statistics(b"") == [0.0] * len(quality.STATISTICS)
    values = dict(zip(quality.STATISTICS, quality.statistics(b"Aa bb, aa 12\naa")))
    assert values["digits"] == 2 / 15 and values["upper"] == 1 / 15
    assert values["different_words"] == 4 / 5 and values["top_word"] == 2 / 5
    assert values["capital_words"] == 1 / 5 and values["short_words"] == 1.0
    assert len(quality.statistics(b" \n ")) == len(quality.STATISTICS)


def test_variety_is_measured_over_the_whole_text():
    varied, same = " ".join(f"w{i}" for i in range(200)), " ".join(["w"] * 200)
    at = quality.STATISTICS.index("different_words_near")
    near = lambda *parts: quality.statistics(" ".join(parts).encode())[at]
    assert near(varied) == 1.0 and near(varied, varied) == 1.0
    assert near(varied, same) == near(same, varied) == pytest.approx((1 + 1 / 200) / 2)


def test_a_row_counts_as_often_as_its_weight():
    x, y = np.array([[0.0], [0.0], [1.0], [1.0]]), np.array([0, 1, 0, 1.0])
    model = quality.fit_trees(x, y, weight=np.array([9, 1, 10, 30.0]))
    assert model.scores(np.array([[0.0], [1.0]])) == pytest.approx([0.1, 0.75], abs=0.02)
    assert quality.fit_trees(x, y).scores(x) == pytest.approx([0.5] * 4)


def test_contradictory_labels_teach_nothing(spark):
    words = lambda i: f"plain{i % 7} text{i % 5}"
    docs = [(i, f"{words(i)} vile" if i % 4 == 0 else f"{words(i)} odd" if i % 4 == 1 else words(i)) for i in range(400)]
    labels = [(i, 1) for i in range(0, 400, 4)] + [(i, y) for i in range(1, 400, 4) for y in (0, 1)] + [(i, 0) for i in range(2, 400, 4)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "vile" in model.weights and "odd" not in model.weights


def test_nnpu_finds_the_toxic_words():
    """Words 0 and 1 are toxic, 2 and 3 are not; an eighth of the unlabelled documents is toxic."""
    x = np.array([[1, 0, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1], [0, 0, 0, 0], [0, 0, 0, 1]], np.float32)
    toxic, unlabelled = np.array([50, 50, 0, 0, 0.0]), np.array([50, 50, 300, 200, 200.0])
    w = toxicity.fit_nnpu(x, toxic, unlabelled, prior=0.125)
    f = x @ w[:-1] + w[-1]
    assert (f > 0).tolist() == [True, True, False, False, False]
    assert (w[:-1] >= 0).all()


def test_terms():
    assert toxicity.terms_of(None) == toxicity.terms_of("") == set()
    assert toxicity.terms_of("Abcd, abce x!") == {"abcd", "abce", "x", "abc*", "abc**"}


def test_wanted_terms_only(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    texts = [None, "", "Abcd, abce x!", "abcdefg abcxyz abcd zz", "abcdefgh abcdefgi abcdefg", "İstanbul ünter"]
    every = set().union(*map(toxicity.terms_of, texts))
    for wanted in (every, {"abc**", "abcd*"}, {"abcd", "abcdef**"}, set()):
        terms = toxicity.Terms(wanted.__contains__)
        assert [terms.of(t) for t in texts * 2] == [toxicity.terms_of(t) & wanted for t in texts * 2]


def test_terms_are_counted_over_all_rows(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED", 50)
    expected = {None: 0}
    for r in edge_docs.collect():
        for term in [None, *toxicity.terms_of(r.text)]:
            expected[term] = expected.get(term, 0) + 1
    counts = toxicity.term_counts(edge_docs)
    assert dict(map(tuple, counts.collect())) == expected
    few = counts.where("term in ('same', 'sam*', 'ka**', 'kalo*')")
    again = dict(map(tuple, toxicity.term_counts(edge_docs, toxicity._bitmap(few)).collect()))
    assert again.keys() >= {r.term for r in few.collect()} and all(expected[t] == n for t, n in again.items())


def test_a_rare_word_is_found_beyond_the_draw(spark):
    """Counts cover all documents, so a word is found that the few documents of the draw hardly hold."""
    words = lambda i: f"plain{i % 7} text{i % 5}"
    docs = [(i, words(i) + (" vile" if i % 100 == 0 else " foul" if i % 2 == 0 and i < 400 else "")) for i in range(4_000)]
    labels = [(i, 1) for i in range(0, 4_000) if "vile" in docs[i][1] or "foul" in docs[i][1]] + [(i, 0) for i in range(1, 4_000, 2)]
    model = toxicity.train(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), max_unlabelled=60
    )
    assert {"vile", "foul"} <= model.weights.keys()


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, edge_docs, no_docs, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    odd = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, None), (None, 1), (6, 0), (6, 1), (8, 1), (9, 0), (77, 1)], f"doc_id long, {label} int")
    for docs in (edge_docs, no_docs):
        for labels in (none, odd):
            model = module.train(docs, labels)
            rows = docs.select("text", module.score(model, F.col("text")).alias("s")).collect()
            assert len(rows) == docs.count()
            assert all(0 <= r.s <= 1 for r in rows)
            assert len({r.s for r in rows if not r.text}) <= 1


def test_labels_that_are_learned_from(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (5, None), (None, 1)], "doc_id long, quality int")
    rows = quality.labelled(docs, quality.agreed(labels, "quality"), 1_000).collect()
    free = {r.doc_id for r in docs.where(~held_out(F.col("doc_id"))).collect()} - {None, 3}
    assert {r.doc_id for r in rows} == free
    few = quality.labelled(docs, quality.agreed(labels, "quality"), 10).collect()
    assert len(few) == 10
