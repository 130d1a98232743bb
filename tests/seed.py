"""A small platform made up for the tests; test_seed works its results out by hand."""

from __future__ import annotations

import datetime
from decimal import Decimal

from classmeter.sources.schemas import SCHEMAS
from classmeter.sources.tables import Tables, with_defaults
from pyspark.sql import functions as F

DAY = datetime.datetime(2023, 11, 6, 7, 30)


def minute(i: int) -> datetime.datetime:
    return DAY + datetime.timedelta(minutes=i)


STUDENTS, MENTORS, ADMINS = range(1, 7), range(21, 25), range(41, 44)
PROBLEMS = [
    # problem, author, difficulty, scenario
    (101, 21, "Easy", 501),
    (102, 21, "Medium", None),
    (103, 22, "Easy", 502),
    (104, 22, "Hard", 503),
    (105, 23, "Medium", None),
    (106, 21, "Easy", 501),
    (107, 22, "Medium", None),
]
ATTEMPTS = [
    # student, problem, number, reviewer, score
    (1, 101, 1, None, "50"),
    (1, 101, 2, 21, "90"),
    (1, 103, 1, None, "70"),
    (1, 102, 1, 21, "80"),
    (2, 101, 1, None, "55"),
    (2, 103, 1, 22, "95"),
    (2, 104, 1, None, "40"),
    (3, 101, 1, 21, "59.50"),
    (3, 105, 1, None, "100"),
    (4, 104, 1, 22, "88.25"),
    (4, 105, 1, 23, "61.75"),
    (4, 105, 2, None, "92.50"),
    (5, 103, 1, None, "100"),
]
HAVE_TOPIC = [(101, "basics"), (106, "basics"), (102, "joins"), (104, "joins"), (103, "windows"), (104, "windows"), (105, "windows"), (107, "sets")]
RECEIVED = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (1, 6)]


def seed_tables(spark) -> Tables:
    people = [*STUDENTS, *MENTORS, *ADMINS]
    known = {
        "user": [(i, f"Person {i:02}", f"p{i}@example.com", "x") for i in people],
        "student": [(i,) for i in STUDENTS],
        "mentor": [(i,) for i in MENTORS],
        "admin": [(i,) for i in ADMINS],
        "topic": [(name,) for name in ("basics", "joins", "sets", "windows")],
        "scenario": [(n, s, f"Scenario number {n}") for n, s in ((501, 1), (502, 1), (503, 2), (504, 4))],
        "problem": [(p, a, "SELECT 1", DAY, f"Problem {p}", d, s) for p, a, d, s in PROBLEMS],
        "attempt": [
            (s, p, n, m, Decimal(score), minute(i), m and "noted") for i, (s, p, n, m, score) in enumerate(ATTEMPTS)
        ],
        "resource": [(r, m, f"Resource {r}", "Video") for r, m in ((301, 21), (302, 21), (303, 22), (304, 23))],
        "notification": [(n,) for n in range(1, 11)],
        "have_topic": HAVE_TOPIC,
        "resourcetopic": [(r, "joins") for r in (301, 302, 303, 304)],
        "access": [(301, 1), (302, 1), (301, 2)],
        "send": [(41, 7), (42, 8)],
        "receive": RECEIVED,
    }

    def frame(name):
        schema = SCHEMAS[name][: len(known[name][0])]
        return with_defaults(spark.createDataFrame(known[name], schema), name, F.lit(DAY).cast("timestamp_ntz"))

    return Tables({name: (lambda name=name: frame(name)) for name in known})
