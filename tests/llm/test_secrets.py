import re

import pytest
from pyspark.sql import functions as F

from classmeter.llm import secrets

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")


def plain(text):
    return [(m.start() + 1, m.group(), text[: m.start()], text[m.end() :]) for m in RUN.finditer(text or "") if re.search("[0-9]", m.group())]


def test_every_candidate_with_its_place(edge_docs, spark):
    texts = ['a token = "0a1b2c3d4e5f60718293a4b5c6d7e8f9" end', "4532015112830366 and 192.168.100.200, é 0123456789abX", "x" * 30, "9" * 4_000, "abcdefghijk1 abcdefghijkl 1bcdefghijkl"]
    docs = spark.createDataFrame([(100 + i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for frame in (docs, edge_docs):
        rows = [(str(r.doc_id), r.text) for r in frame.select("doc_id", "text").collect()]
        expected = sorted((d, start, secret) for d, t in rows for start, secret, *_ in plain(t))
        found = secrets.findings(frame)
        got = found.collect()
        assert sorted((str(r.doc_id), r.start, r.secret) for r in got) == expected
        beside = {(d, start): (left, right) for d, t in rows for start, _, left, right in plain(t)}
        for r in got:
            left, right = beside[str(r.doc_id), r.start]
            assert len(r.left) <= secrets.BESIDE and left.endswith(r.left) and right.startswith(r.right)


def test_features(spark):
    found = spark.createDataFrame([(1, "src/a1", 5, "the12ABab--", 'my token = "', '" next word')], "doc_id long, path string, start int, secret string, left string, right string")
    row = secrets.features(found, ["the", "word"]).first()
    assert row.length == 11 and row.digits == 2 / 11 and row.upper == 2 / 11 and row.signs == 2 / 11
    assert row.changes == 4 / 11 and row.covered == pytest.approx(3 / 11) and row.quoted == row.assigned == 1.0
    assert row.different == 9 / 11 or row.different == 10 / 11
    assert set(row.beside) >= {"path:src", "before:token", "before:my", "after:next", "after:word"}


def test_forest_removes_false_positives(spark):
    """Held-out findings of the corpus: what is assigned to a credential stays, numbers and addresses go."""
    rows = secrets.scan(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    from classmeter.llm.common import held_out

    judged = rows.where(held_out(F.col("doc_id")) & F.col("label").isNotNull()).select("label", "predicted").collect()
    assert len(judged) > 30 and {r.label for r in judged} == {0, 1}
    assert sum(r.label == r.predicted for r in judged) / len(judged) > 0.97


def test_edges(spark, edge_docs, no_docs):
    assert secrets.scan(no_docs).collect() == []
    rows = secrets.scan(edge_docs).collect()
    assert all(r.score == 0.5 and r.predicted == 1 for r in rows)  # no labels, no forest
    assert secrets.dictionary(no_docs) == []
    words = secrets.dictionary(spark.createDataFrame([("bb the the éaa éaa zz",), (None,)], "text string"), words=2)
    assert words == ["the", "éaa"]


def test_no_python_in_the_plan(spark, edge_docs):
    plan = secrets.scan(edge_docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def beside(text, secret):
    """start, left and right of a value that is in a text once."""
    assert text.count(secret) == 1
    at = text.index(secret)
    return at + 1, text[max(at - secrets.BESIDE, 0) : at], text[at + len(secret) :][: secrets.BESIDE]


def test_neighbours_reach_over_other_runs(spark):
    """Long names, names and = in one run with the value, and many runs in a row."""
    value = "0a1b2c3d4e5f60718293"
    texts = [
        f'access_token = "{value}" and a_long_name_here after',
        f'é client_secret="{value}"; other_long_names',
        f'export AWS_SECRET_ACCESS_KEY="{value}"',
        f"client_secret={value} internationalisation",
        f"'a b'={value}",
        " ".join(f"run{i:09d}" for i in range(20)) + f" {value}" + "".join(f"|run{i:09d}" for i in range(20, 40)),
        value,
        f"{value}==",
    ]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = secrets.findings(docs).collect()
    found = {r.doc_id: r for r in rows if value in r.secret}
    for i, text in enumerate(texts):
        secret = value if i < 7 else f"{value}=="
        assert (found[i].secret, found[i].start, found[i].left, found[i].right) == (secret, *beside(text, secret))
    for r in rows:
        assert (r.start, r.left, r.right) == beside(texts[r.doc_id], r.secret)
    labels = {r.doc_id: r for r in secrets.labelled(secrets.features(secrets.findings(docs), [])).collect() if value in r.secret}
    assert [labels[i].label for i in range(3)] == [1.0] * 3 and all(labels[i].assigned == 1.0 for i in range(5))
    assert "before:access_token" in labels[0].beside and "before:client_secret" in labels[3].beside


def test_values_that_a_name_is_given(spark):
    """Short ones, ones without a digit, and ones with other characters; each with its place."""
    given = {
        'password = "P@ssw0rd!2024"': ["P@ssw0rd!2024"],
        "db_password: hunter22\nrest": ["hunter22"],
        'my "secret": "correct horse battery staple", and': ["correct horse battery staple"],
        "TOKEN='abcdefghijklmnop' é": ["abcdefghijklmnop"],
        r'pwd = "a\"b c"': [r"a\"b c"],
        'é api_key := "x"; auth => y': ["x", "y"],
        "?token=abc&key=d,e&user=z": ["abc", "d,e"],
        '{"apikey":5,"token":"q","no":1}': ["5", "q"],
        "secret: password: z9": ["password:", "z9"],
        'passwd = "unclosed word': ["unclosed"],
        "key = it's": ["it's"],
        "client_secret=0123456789ab!x": ["0123456789ab!x"],
        "password=4711": ["4711"],
        'password = ""': [],
        'password = "  "\n': [],
        "password =": [],
        "monkeys: none, key words": [],
    }
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(given)], "doc_id long, text string, source string")
    found = secrets.labelled(secrets.findings(docs)).orderBy("doc_id", "start").collect()
    for i, (text, values) in enumerate(given.items()):
        mine = [r for r in found if r.doc_id == i]
        assert [r.secret for r in mine] == values, text
        for r in mine:
            at = r.start - 1
            assert text[at : at + len(r.secret)] == r.secret
            assert (r.left, r.right) == (text[:at][-secrets.BESIDE :], text[at + len(r.secret) :][: secrets.BESIDE])
            assert r.label != 0.0


def test_long_values_and_many(spark):
    texts = ['token = "' + "a b" * 50_000 + '"', "key=a&" * 50_000, "key:" * 50_000, "token=" + "a,'" * 50_000, "password " + "=" * 50_000]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    counts = dict(secrets.findings(docs).groupBy("doc_id").count().collect())
    assert counts[0] == 1 and counts[1] == 50_000 and counts[2] >= 1 and counts[3] == 1


def test_a_rare_label_is_learned_at_every_size(spark):
    """Findings labelled by their makers, not in quotes: six keys among many numbers, far more than are drawn."""
    key = lambda i: "".join("aK9zQ4xW7mB2"[(i * 7 + j * 5) % 12] for j in range(24))
    texts = [(i, f"see part 10{i:06}.4471 of it") for i in range(600)] + [(1_000 + i, f"use {key(i)} here") for i in range(6)]
    docs = spark.createDataFrame([(*t, "p") for t in texts], "doc_id long, text string, source string")
    found = secrets.features(secrets.findings(docs), []).withColumn("label", (F.col("doc_id") >= 1_000).cast("double"))
    model = secrets.train(found, max_rows=20, trees=10)
    assert model is not None
    scored = model.transform(found).select("doc_id", "prediction").collect()
    assert len(scored) == 606 and all((r.doc_id >= 1_000) == (r.prediction == 1.0) for r in scored)
    assert secrets.train(found.where("label = 0"), max_rows=20) is None
    assert secrets.train(found.withColumn("label", F.lit(None).cast("double"))) is None
