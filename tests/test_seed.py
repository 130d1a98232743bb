"""Results of the small platform, worked out by hand from the lists in seed.py."""

from decimal import Decimal

import pytest

from classmeter.operators import learner, mentor, reports, writes
from conftest import rows


def pick(frame, *places):
    return [tuple(r[i] for i in places) for r in rows(frame)]


def test_saved_questions(seed):
    assert pick(reports.students_without_attempts(seed), 0) == [(6,)]
    assert pick(reports.problems_by_mentor(seed, "Person 21"), 0, 2) == [(101, "Easy"), (102, "Medium"), (106, "Easy")]
    assert sorted(rows(reports.problem_count_by_difficulty(seed))) == [("Easy", 3), ("Hard", 1), ("Medium", 3)]
    # 100; 242.5 / 3; 159.5 / 2; 290 / 4; 190 / 3
    assert pick(reports.top_students(seed), 0, 2, 3) == [(5, 100.0, 1), (4, 80.83, 3), (3, 79.75, 2), (1, 72.5, 4), (2, 63.33, 3)]
    best = [(p, s, float(score)) for p, s, score in pick(reports.best_score_per_problem(seed), 0, 2, 4)]
    assert best == [(101, 1, 90.0), (102, 1, 80.0), (103, 5, 100.0), (104, 4, 88.25), (105, 3, 100.0)]


def test_first_failures(seed):
    # three of six students fail 101 at first, which is not more than half
    assert rows(reports.first_attempt_failures(seed)) == []
    found = pick(reports.first_attempt_failures(seed, ratio=0.1), 0, 2, 3, 4)
    assert found == [(101, 3, 6, 0.5), (104, 1, 6, pytest.approx(1 / 6))]


def test_scores_of_scenario_problems(seed):
    # Easy: 101 and 103, 519.5 / 7; Hard: 104, 128.25 / 2, halves up
    assert rows(reports.scenario_score_by_difficulty(seed)) == [("Easy", 74.21, 7), ("Hard", 64.13, 2)]


def test_notification_counts(seed):
    counts = dict(pick(reports.notification_counts(seed), 0, 3))
    assert {u: n for u, n in counts.items() if n} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1} and len(counts) == 13


def test_student_performance(seed):
    found = {r[0]: r[3:] for r in rows(reports.student_performance(seed))}
    near = {s: (n, pytest.approx(mean), best, k) for s, n, mean, best, k in [
        (1, 3, 72.5, 90, 4), (2, 3, 190 / 3, 95, 3), (3, 2, 79.75, 100, 2), (4, 2, 242.5 / 3, 92.5, 3), (5, 1, 100, 100, 1),
    ]}
    assert found.pop(6) == (0, None, None, 0)
    assert {s: (r[0], r[1], float(r[2]), r[3]) for s, r in found.items()} == near


def test_problem_statistics(seed):
    found = {r[0]: (r[3], r[4], r[5] and round(r[5], 6), r[6]) for r in rows(reports.problem_statistics(seed))}
    assert found == {
        101: ("basics", 3, 63.625, 4),
        102: ("joins", 1, 80.0, 1),
        103: ("windows", 3, 88.333333, 3),
        104: ("joins,windows", 2, 64.125, 4),  # each attempt once for each topic
        105: ("windows", 2, 84.75, 3),
        106: ("basics", 0, None, 0),
        107: ("sets", 0, None, 0),
    }
    clean = {r[0]: r[6] for r in rows(reports.problem_statistics(seed, faithful=False))}
    assert clean == {101: 4, 102: 1, 103: 3, 104: 2, 105: 3, 106: 0, 107: 0}


def test_mentor_activity(seed):
    found = {r[0]: r[2:] for r in rows(reports.mentor_activity(seed))}
    assert found == {21: (3, 2, 2, 76.5), 22: (3, 1, 2, 91.625), 23: (1, 1, 1, 61.75), 24: (0, 0, 0, None)}
    assert pick(mentor.mentor_summary(seed, 24), 0, 2, 3, 4, 5) == [(24, 0, 0, 0, 0.0)]


def test_high_scores(seed):
    alerts = writes.alert_rows(seed.attempt, seed.notification).orderBy("noti_id")
    found = rows(alerts.select("noti_id", "student_id", "problem_id", "attempt_no"))
    assert found == [(11, 1, 101, 2), (12, 2, 103, 1), (13, 3, 105, 1), (14, 4, 105, 2), (15, 5, 103, 1)]


def test_learner_page(seed):
    assert rows(learner.student_summary(seed, 4))[0][4] == 80.8
    assert pick(learner.recent_attempts(seed, 1, n=2), 2, 5) == [(102, 1), (103, 1)]
    assert pick(learner.recommend_problems(seed, 1), 2) == [(106,), (105,), (107,)]
    assert sorted(rows(learner.problems_passed(seed))) == [(3, 1), (5, 1)]
    assert pick(learner.browse_problems(seed, 1, attempted="yes"), 0) == [(101,), (103,), (102,)]
    untried = learner.browse_problems(seed, 1, topic="WINDOW", attempted="no")
    assert pick(untried, 0, 5) == [(104, "joins,windows"), (105, "windows")]
    assert rows(learner.browse_problems(seed, topic="_")) == []
    assert pick(learner.problem_attempts(seed, 1, 101), 2) == [(2,), (1,)]
    assert (4, 105, 2, Decimal("92.50")) in rows(learner.latest_score(seed))
    assert rows(learner.my_attempt_stats(seed, 1, score_min=80)) == [(1, 85.0, 1, 2, 50.0)]
    assert rows(learner.my_attempt_stats(seed, 1, score_min=99)) == [(1, None, 0, 0, None)]
    assert pick(learner.scenario_list(seed, 1), 2) == [(502,), (501,)]
    assert pick(learner.scenario_rank(seed, 502), 0, 2, 3) == [(502, 2, 103)]


def test_score_bounds_are_taken_as_given(seed):
    scores = lambda **bounds: sorted(float(r[5]) for r in rows(learner.my_attempts(seed, 4, **bounds)))
    assert scores(score_max=1000) == [61.75, 88.25, 92.5]
    assert scores(score_min=88.254) == scores(score_min="88.2500001") == [92.5]
    assert scores(score_min=-5, score_max=88.25) == [61.75, 88.25]


def test_mentor_page(seed):
    assert pick(mentor.pending_reviews(seed, 21, n=3), 2, 4, 6) == [(1, 101, 1), (2, 101, 1)]
    assert sorted(rows(mentor.feedback_given(seed))) == [(21, 3), (22, 2), (23, 1)]
    assert rows(mentor.feedback_given(seed, 22)) == [(22, 2)]
    mine = {r[1]: r for r in rows(mentor.my_problems(seed, 21))}
    assert mine[101][5:] == (4, 63.62, 25.0, 3, "basics")  # 63.625, halves to even; one of four passes
    assert mine[106][5:] == (0, 0.0, 0.0, 0, "basics")
    assert pick(mentor.my_problems(seed, 21, min_attempts=1, max_attempts=3), 1) == [(102,)]
    bands = {r[0]: r[2:] for r in rows(mentor.problem_analytics(seed))}
    assert bands[101] == (4, 63.62, 1, 0, 3)
    failers = sorted(rows(mentor.repeat_failers(seed, more_than=0)))
    assert failers == [(1, "Person 01", 1), (2, "Person 02", 2), (3, "Person 03", 1)]
    assert pick(mentor.hardest_problems(seed, 2), 0, 1) == [(101, "Problem 101"), (104, "Problem 104")]
    assert rows(mentor.topic_average(seed, "WINDOW")) == [(80.9375, 8)]
    accessed = {r[1]: r[5:7] for r in rows(mentor.my_resources(seed, 21))}
    assert accessed == {301: (2, 2), 302: (1, 1)}
