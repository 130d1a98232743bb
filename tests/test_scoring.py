"""The scorer against known cases and against token sets drawn at random."""

import random

import pytest
from pyspark.sql import functions as F

from classmeter.functions import sqltext
from classmeter.functions.exprs import round_float
from classmeter.operators.scoring import answered, score_submissions

# right answer, submitted, score, equal, F1 of from, select, where
CASES = [
    ("SELECT * FROM bolts WHERE torque > 9000;", "select  *\nfrom BOLTS -- all\nwhere torque >  9000",
     100.0, True, (1, 1, 1)),
    ("SELECT name, color FROM parts WHERE maker = 'Acme';", "SELECT name FROM parts", 60.0, False, (1, 0.667, 0)),
    ("SELECT a FROM t", "SELECT a FROM t WHERE b = 1", 100.0, False, (1, 1, 1)),
    ("SELECT t.name, p.kind FROM people t JOIN pets p ON t.id = p.owner;",
     "SELECT x.name, p.kind FROM other_table x JOIN pets p ON 1 = 2", 100.0, True, (1, 1, 1)),
    ("INSERT INTO tools (name, size) VALUES ('Hammer', 5);", "INSERT INTO tools (name, size) VALUES ('Hammer', 5)",
     100.0, True, (1, 1, 1)),
    ("SELECT kind, COUNT(*) FROM snacks GROUP BY pet_id, kind", "SELECT kind, COUNT(*) FROM snacks",
     86.7, False, (0.667, 1, 1)),
    ("SELECT w.label, (SELECT COUNT(*) FROM faults WHERE part_id = w.part_id) FROM wheels w;",
     "SELECT label FROM wheels", 20.0, False, (0, 0.667, 0)),
    ("SELECT a, b FROM t WHERE (x = 1) AND y BETWEEN 1 AND 2",
     "SELECT b AS bb, t.a FROM t WHERE y between 1 and 2 and x = 1", 100.0, True, (1, 1, 1)),
    ("SELECT a FROM t; -- done", "SELECT a FROM t", 60.0, False, (0, 1, 1)),
    ("SELECT 1", "SELECT 2", 70.0, False, (1, 0, 1)),
]


def score_all(spark, pairs):
    problems = [(i, right) for i, (right, _) in enumerate(pairs)]
    given = [(i, i, text) for i, (_, text) in enumerate(pairs)]
    scored = score_submissions(
        spark.createDataFrame(given, "student_id long, problem_id long, student_sql string"),
        spark.createDataFrame(problems, "problem_id long, correct_answer string"),
    )
    return {r.problem_id: r for r in scored.collect()}


def test_known_cases(spark):
    found = score_all(spark, [(right, text) for right, text, *_ in CASES])
    for i, (_, _, score, equal, f1) in enumerate(CASES):
        row = found[i]
        parts = row.details.score_breakdown
        assert row.score == score, CASES[i]
        assert row.details.is_equal is equal
        assert (parts.from_f1, parts.select_f1, parts.where_f1) == pytest.approx(f1)


# --- drawn token sets, rendered to text in random layout: the sets that were drawn must be found

GAPS = (" ", "  ", "\n", "\t", " \n ", "\u00a0", " \x1c")
NAMES = ("a", "t", "parts", "maker_9", "_x", "zz")
COLUMNS = ("a", "color", "count(*)", "max(a)", "coalesce(b)", "*", "size")
CONDITIONS = ("a = 1", "torque > 9000", "kind like '(x)'", "y between 1 or 2", "(a = 1 or b = 2", "c)")


def shouted(rng, text):
    return "".join(c.upper() if rng.random() < 0.3 else c for c in text)


def gap(rng):
    return rng.choice(GAPS)


def drawn(rng, pool, least=1):
    return set(rng.sample(pool, rng.randint(least, min(4, len(pool)))))


def many(rng, items):
    """The items in random order, some twice."""
    items = sorted(items) + rng.choices(sorted(items), k=rng.randint(0, 2)) if items else []
    rng.shuffle(items)
    return items


def dressed_column(rng, name):
    if "(" in name or name == "*":
        return name
    form = rng.choice(("{}", "`{}`", "t.{}", "`t`.`{}`", "{}" + gap(rng) + "as" + gap(rng) + "b2"))
    return form.format(name)


def dressed_condition(rng, text):
    whole = text.count("(") == text.count(")") and not text.startswith("(")
    for _ in range(rng.randint(0, 3) if whole else 0):
        text = "(" + rng.choice(("", " ")) + text + rng.choice(("", " ")) + ")"
    return text


def rendered(rng, tables, columns, conditions):
    comma = lambda: rng.choice(("", " ")) + "," + rng.choice(("", gap(rng)))
    columns = comma().join(dressed_column(rng, c) for c in many(rng, columns))
    names = many(rng, tables)
    if rng.random() < 0.5:  # joins name the tables; what stands before the first join is not looked at
        source = "first_one x" + "".join(f"{gap(rng)}left join{gap(rng)}{n} on 1 = 1" for n in names)
    else:
        source = comma().join(n + rng.choice(("", gap(rng) + "alias")) for n in names)
    text = f"select{gap(rng)}{columns}{gap(rng)}from{gap(rng)}{source}"
    if conditions:
        rule = f"{gap(rng)}and{gap(rng)}".join(dressed_condition(rng, c) for c in many(rng, conditions))
        text += f"{gap(rng)}where{gap(rng)}{rule}"
    if rng.random() < 0.3:
        text += gap(rng) + "-- a remark from x where y\n"
    text = shouted(rng, text)
    return text if "--" in text else text + rng.choice(("", ";", "; \n"))


def drawn_sets(rng):
    return drawn(rng, NAMES), drawn(rng, COLUMNS), drawn(rng, CONDITIONS, 0)


def test_drawn_sets_are_found(spark):
    rng = random.Random(7)
    sets = [(drawn_sets(rng), drawn_sets(rng)) for _ in range(1_500)]
    sets += [(one, one) for one, _ in sets[:200]]
    found = score_all(spark, [tuple(rendered(rng, *side) for side in pair) for pair in sets])
    for i, pair in enumerate(sets):
        details = found[i].details
        for side, expected in zip((details.correct, details.student), pair):
            assert (set(side.tables), set(side.columns), set(side.conditions)) == expected
        assert details.is_equal is (pair[0] == pair[1])
        assert [details.from_ok, details.select_ok, details.where_ok] == [a == b for a, b in zip(*pair)]


def test_points_follow_the_overlap(spark):
    """For right sets of m and given ones of n tokens that share k, a part earns 2k / (m + n) of its weight."""
    pool = [f"c{i}" for i in range(6)]
    cases = [(m, n, k) for m in (1, 2, 4) for n in (1, 2, 4) for k in range(min(m, n) + 1) if m + n - k <= len(pool)]
    lists = [(", ".join(pool[:m]), ", ".join(pool[m - k : m - k + n])) for m, n, k in cases]
    found = score_all(spark, [(f"SELECT {a} FROM t", f"SELECT {b} FROM t") for a, b in lists])
    for i, (m, n, k) in enumerate(cases):
        share = 2 * k / (m + n)
        row = found[i]
        assert row.details.score_breakdown.select_f1 == pytest.approx(share, abs=5e-4)
        assert row.details.score_breakdown.select == pytest.approx(30 * share, abs=0.051)
        assert row.score == pytest.approx(70 + 30 * share, abs=0.051)


def test_normal_form(spark):
    texts = {
        None: "", "": "", ";;": ";", " A\n-- x ; y\n b ;\t": "a b", "a; ;\x1d": "a;", "x--y": "x",
        "Select  'É'\u00a0From\tT": "select 'é' from t", "--": "", "a ;b;": "a ;b",
    }
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, sql string")
    got = {r.i: r.n for r in frame.select("i", sqltext.normalize_sql_text(F.col("sql")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_round_float_is_exact(spark):
    rng = random.Random(3)
    values = [0.35, 0.25, 0.75, 6.15, 2.675, 1.005, 100.0, 0.0, 0.05, 86.66666666666667]
    values += [rng.randrange(0, 100000) / 1000 + rng.choice([0, 0.05, 0.005]) for _ in range(5000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for row in frame.select("v", round_float(F.col("v"), 1).alias("a"), round_float(F.col("v"), 3).alias("b")).collect():
        assert (row.a, row.b) == (round(row.v, 1), round(row.v, 3)), row.v


def test_blank_answers_are_refused(spark):
    frame = spark.createDataFrame([(1, " \n\t"), (2, None), (3, "x")], "i long, student_sql string")
    assert [r.i for r in answered(frame).collect()] == [3]
