"""Keyed writes as batch jobs: a snapshot and a delta give the next snapshot.

A job writes its delta and the key sets that follow from it to the shared
folder once, and returns lazy frames over them and the snapshot. Write these
to a new path and switch readers to it; nothing is changed in place, so a lost
executor only repeats its tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from classmeter.functions.joins import left_join_sparse
from classmeter.functions.numbering import number_within
from classmeter.functions.sqltext import strip
from classmeter.sources.schemas import KEYS, REFERENCES, SCHEMAS
from classmeter.operators.quality import meaningful_text, parse_generated
from classmeter.session import buckets, written
from classmeter.sources.tables import Tables, assign_ids, typed, with_defaults

PAIR = ["student_id", "problem_id"]
ATTEMPT = list(KEYS["attempt"])


def number_attempts(t: Tables, scored: DataFrame, settled: bool = False, dealt: bool = False) -> DataFrame:
    """New attempt rows: numbers go on from the pair's largest one, in time order.

    The batch and the largest numbers of the snapshot's pairs meet in the
    shuffle that numbers the batch. `settled`: see `number_within`. For a
    snapshot whose attempts are `dealt` out by student, the batch is numbered
    where it meets by problem, and goes to the students' buckets without the
    texts that told equal times apart.
    """
    ties = [F.asc(c) for c in ("student_sql", "score") if c in scored.columns]
    order = [F.asc_nulls_last("submit_time"), *ties]
    needed = [c for c in (*PAIR, "submit_time", "score", "student_sql") if c in scored.columns]
    numbered = number_within(scored.select(*needed), PAIR, order, "_n", settled, "problem_id" if dealt else None)
    if dealt:
        numbered = numbered.drop("student_sql").repartition(buckets(numbered.sparkSession), "student_id")
    last = t.attempt.groupBy(*PAIR).agg(F.max("attempt_no").alias("_last"))
    number = F.col("_n") + F.coalesce("_last", F.lit(0))
    found = numbered.join(last, PAIR, "left").withColumns(
        {
            "attempt_no": number,
            "mentor_id": F.lit(None),
            "feedback": F.lit(None),
        }
    )
    return typed(found, "attempt")


def append_attempts(t: Tables, scored: DataFrame) -> Tables:
    return t.replace(attempt=t.attempt.unionByName(number_attempts(t, scored)))


def accepted_feedback(t: Tables, updates: DataFrame, dealt: bool = False) -> DataFrame:
    """Reviews with a text, by the author of the problem; the last one per attempt.

    `updates` holds the attempt key, mentor_id, feedback and sent_at. With
    `dealt` the reviews meet by student, as attempts do that are dealt out so.
    """
    worded = updates.withColumn("feedback", strip(F.col("feedback"))).filter("feedback <> ''")
    owner = t.problem.select("problem_id", F.col("user_id").alias("mentor_id"))
    own = worded.join(owner, ["problem_id", "mentor_id"], "left_semi")
    if dealt:
        own = own.select(*ATTEMPT, "sent_at", "mentor_id", "feedback").repartition(buckets(own.sparkSession), "student_id")
    last = own.groupBy(*ATTEMPT).agg(F.max(F.struct("sent_at", "mentor_id", "feedback")).alias("_last"))
    return last.select(*ATTEMPT, F.col("_last.mentor_id").alias("_mentor"), F.col("_last.feedback").alias("_feedback"))


def reviewed(t: Tables, accepted: DataFrame) -> DataFrame:
    """All attempts with the reviews that `accepted_feedback` lets through, and the reviewer `_before`."""
    joined = t.attempt.withColumn("_before", F.col("mentor_id")).join(accepted, ATTEMPT, "left")
    return joined.withColumns(
        {
            "mentor_id": F.coalesce("_mentor", "mentor_id"),
            "feedback": F.coalesce("_feedback", "feedback"),
        }
    ).select(*SCHEMAS["attempt"].names, "_before")


def with_feedback(t: Tables, accepted: DataFrame, rows: DataFrame | None = None) -> Tables:
    """The next snapshot with the accepted reviews, which are written, or with `rows`, those of `reviewed`, if these are."""
    return t.replace(attempt=typed(reviewed(t, accepted) if rows is None else rows, "attempt"))


def apply_feedback(t: Tables, updates: DataFrame) -> Tables:
    return with_feedback(t, written(accepted_feedback(t, updates), "feedback"))


def new_topics(
    t: Tables, pairs: DataFrame, bridge: str = "have_topic", now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(topics to add, bridge rows to add) for pairs of an entity and a topic name."""
    key = KEYS[bridge][0]
    wanted = pairs.select(key, strip(F.col("topic_name")).alias("topic_name"))
    wanted = wanted.filter("topic_name <> ''").distinct()
    names = wanted.select("topic_name").distinct().join(t.topic, "topic_name", "left_anti")
    now = F.current_timestamp() if now is None else now
    topics = names.withColumns({"description": F.lit(""), "created_at": now})
    rows = wanted.join(t[bridge], [key, "topic_name"], "left_anti")
    return typed(topics, "topic"), typed(rows, bridge)


def upsert_topics(
    t: Tables, pairs: DataFrame, bridge: str = "have_topic", now: Column | None = None
) -> Tables:
    topics, rows = new_topics(t, pairs, bridge, now)
    return t.replace(
        **{"topic": t.topic.unionByName(topics), bridge: t[bridge].unionByName(rows)}
    )


def _tried(t: Tables, problems: DataFrame) -> DataFrame:
    """Those of `problems` that somebody attempted; other attempts are dropped before the distinct."""
    return t.attempt.select("problem_id").join(problems, "problem_id", "left_semi").distinct()


def problem_delete_outcomes(t: Tables, requests: DataFrame) -> DataFrame:
    """What each request (mentor_id, problem_id) leads to: deleted, refused or not found."""
    requests = written(requests.select("mentor_id", "problem_id").distinct(), "requests")
    asked = requests.select("problem_id").distinct()
    own = t.problem.select("problem_id", F.col("user_id").alias("mentor_id"), F.lit(True).alias("_own"))
    tried = _tried(t, asked).withColumn("_tried", F.lit(True))
    judged = requests.join(own, ["problem_id", "mentor_id"], "left")
    judged = judged.join(tried, "problem_id", "left")
    outcome = (
        F.when(F.col("_own").isNull(), "not found")
        .when(F.col("_tried").isNotNull(), "refused")
        .otherwise("deleted")
    )
    return judged.select("mentor_id", "problem_id", outcome.alias("outcome"))


def without_problems(t: Tables, gone: DataFrame) -> Tables:
    return t.replace(
        problem=t.problem.join(gone, "problem_id", "left_anti"),
        have_topic=t.have_topic.join(gone, "problem_id", "left_anti"),
    )


def guarded_delete_problem(t: Tables, requests: DataFrame) -> Tables:
    outcomes = problem_delete_outcomes(t, requests)
    gone = outcomes.filter("outcome = 'deleted'").select("problem_id")
    return without_problems(t, written(gone, "gone-problems"))


def scenario_delete_outcomes(t: Tables, requests: DataFrame) -> DataFrame:
    """What each request (student_id, scenario_no) leads to."""
    requests = written(requests.select("student_id", "scenario_no").distinct(), "requests")
    own = t.scenario.select("scenario_no", "student_id", F.lit(True).alias("_own"))
    theirs = t.problem.select("problem_id", "scenario_no")
    theirs = written(theirs.join(requests, "scenario_no", "left_semi"), "scenario-problems")
    used = theirs.join(_tried(t, theirs.select("problem_id")), "problem_id", "left_semi")
    used = used.select("scenario_no").distinct().withColumn("_used", F.lit(True))
    judged = requests.join(own, ["scenario_no", "student_id"], "left")
    judged = judged.join(used, "scenario_no", "left")
    outcome = (
        F.when(F.col("_own").isNull(), "not found")
        .when(F.col("_used").isNotNull(), "refused")
        .otherwise("deleted")
    )
    return judged.select("student_id", "scenario_no", outcome.alias("outcome"))


def guarded_delete_scenario(t: Tables, requests: DataFrame) -> Tables:
    """Delete scenarios none of whose problems was tried, and those problems."""
    gone = scenario_delete_outcomes(t, requests).filter("outcome = 'deleted'").select("scenario_no")
    gone = written(gone, "gone-scenarios")
    problems = t.problem.join(gone, "scenario_no", "left_semi").select("problem_id")
    left = without_problems(t, written(problems, "gone-problems"))
    return left.replace(scenario=t.scenario.join(gone, "scenario_no", "left_anti"))


def deletable_users(t: Tables, ids: DataFrame) -> DataFrame:
    """Users whose removal does not remove a problem that was tried."""
    ids = written(ids.select("user_id").distinct(), "asked-users")
    theirs = t.problem.select("problem_id", "user_id").join(ids, "user_id", "left_semi")
    theirs = written(theirs, "their-problems")
    tried = _tried(t, theirs.select("problem_id"))
    authors = theirs.join(tried, "problem_id", "left_semi").select("user_id").distinct()
    return ids.join(authors, "user_id", "left_anti")


@dataclass(frozen=True)
class Removal:
    """What a cascade does: the keys that go, by relation, and what it does to rows with several references.

    `met` holds, by relation, the different references of which one or more go,
    with `_lost` (the row goes) and `_no_<column>` (the column is cleared).
    """

    keys: dict[str, DataFrame]
    met: dict[str, DataFrame]


def _edges(relation: str, keys: dict[str, DataFrame]) -> list[tuple[str, str, str, str, str]]:
    return [edge for edge in REFERENCES if edge[0] == relation and edge[2] in keys]


def _identity(relation: str, edges: list[tuple[str, str, str, str, str]]) -> list[str]:
    """The columns that decide what happens to a row, with its key if others refer to it."""
    referred = any(edge[2] == relation for edge in REFERENCES)
    return list(dict.fromkeys([*(KEYS[relation] if referred else ()), *(edge[1] for edge in edges)]))


# Keys that go and are few enough to be sent to all executors, whatever Spark thinks of their size.
FEW_GONE = 2_000_000


def _hits(frame: DataFrame, edges: list[tuple[str, str, str, str, str]], keys: dict[str, DataFrame]) -> DataFrame:
    """The rows that refer to what goes, with `_lost` (the row goes) and `_no_<column>` (the column is cleared).

    Each reference is looked up by itself. While the keys that go are few, the
    rows stay where they are; else they are shuffled by that reference.
    """
    lost, gone = F.lit(False), []
    for n, (_, column, parent, key, rule) in enumerate(edges):
        mark = f"_no_{column}" if rule == "null" else f"_gone_{n}"
        met = keys[parent].select(F.col(key).alias(column)).distinct().withColumn(mark, F.lit(True))
        if keys[parent].limit(FEW_GONE + 1).count() <= FEW_GONE:
            frame = frame.join(F.broadcast(met), column, "left")
        elif rule == "null":
            frame = left_join_sparse(frame, met, column, [c for c in frame.columns if c != column])
        else:
            frame = frame.join(met, column, "left")
        frame = frame.withColumn(mark, F.coalesce(mark, F.lit(False)))
        gone.append(F.col(mark))
        lost = lost if rule == "null" else lost | F.col(mark)
    marks = [c for c in frame.columns if c.startswith("_gone_")]
    return frame.filter(reduce(Column.__or__, gone)).withColumn("_lost", lost).drop(*marks)


def _met(frame: DataFrame, relation: str, edges: list[tuple[str, str, str, str, str]], keys: dict[str, DataFrame]) -> DataFrame:
    """The references of the rows that a removal meets, each combination of them once."""
    who = _identity(relation, edges)
    cleared = [f"_no_{edge[1]}" for edge in edges if edge[4] == "null"]
    hit = _hits(frame.select(*who), edges, keys)
    return hit.groupBy(*who).agg(*(F.max(c).alias(c) for c in ("_lost", *cleared)))


def plan_removal(t: Tables, ids: DataFrame, guard: bool = True) -> Removal:
    """Follow the declared references from the users `ids`, relation by relation.

    Users that `deletable_users` leaves out stay, as a problem that was tried
    is not removed; `guard=False` removes them as well. Each relation is read
    once, joined once, and what the removal does to it is written once.
    """
    ids = deletable_users(t, ids) if guard else ids.select("user_id").distinct()
    keys: dict[str, DataFrame] = {"user": written(ids, "gone-user")}
    met: dict[str, DataFrame] = {}
    for relation in SCHEMAS:
        edges = _edges(relation, keys)
        referred = any(edge[2] == relation for edge in REFERENCES)
        if len(edges) > 1 or any(edge[4] == "null" for edge in edges):
            met[relation] = written(_met(t[relation], relation, edges, keys), f"met-{relation}")
            if referred:
                keys[relation] = met[relation].filter("_lost").select(*KEYS[relation])
        elif edges and referred:
            _, column, parent, key, _ = edges[0]
            removed = keys[parent].select(F.col(key).alias(column))
            lost = t[relation].join(removed, column, "left_semi").select(*KEYS[relation])
            keys[relation] = written(lost, f"gone-{relation}")
    return Removal(keys, met)


def hit(removal: Removal, relation: str, frame: DataFrame) -> DataFrame:
    """The rows that a removal meets, with `_lost` and `_no_<column>`; `frame` holds the references of the relation."""
    return _hits(frame, _edges(relation, removal.keys), removal.keys)


def told(removal: Removal, relation: str, frame: DataFrame) -> DataFrame:
    """The rows of a relation with `_lost` and `_no_<column>`."""
    who = _identity(relation, _edges(relation, removal.keys))
    met = removal.met[relation].withColumnsRenamed({c: f"_met_{c}" for c in who})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_met_{c}")) for c in who])
    return frame.join(met, same, "left").drop(*(f"_met_{c}" for c in who))


def cleared(removal: Removal, relation: str, rows: DataFrame) -> DataFrame:
    """What stays of the rows that `told` gives, without references to what goes."""
    marks = [c.removeprefix("_no_") for c in rows.columns if c.startswith("_no_")]
    kept = rows.filter(~F.coalesce("_lost", F.lit(False)))
    kept = kept.withColumns({c: F.when(~F.coalesce(f"_no_{c}", F.lit(False)), F.col(c)) for c in marks})
    return typed(kept, relation)


def without_removed(t: Tables, removal: Removal) -> Tables:
    """The snapshot after a removal: each relation is read once and joined once."""
    left: dict[str, DataFrame] = {"user": t.user.join(removal.keys["user"], "user_id", "left_anti")}
    for relation in SCHEMAS:
        edges = _edges(relation, removal.keys)
        if relation in removal.met:
            left[relation] = cleared(removal, relation, told(removal, relation, t[relation]))
        elif edges:
            _, column, parent, key, _ = edges[0]
            gone = removal.keys[parent].select(F.col(key).alias(column))
            left[relation] = typed(t[relation].join(gone, column, "left_anti"), relation)
    return t.replace(**left)


def cascade_delete_user(t: Tables, ids: DataFrame, guard: bool = True) -> Tables:
    """Delete users and all that depends on them, along the declared references; see `plan_removal`."""
    return without_removed(t, plan_removal(t, ids, guard))


def dismiss_notification(t: Tables, pairs: DataFrame) -> Tables:
    """Reading and deleting a notification both remove the receive row."""
    key = list(KEYS["receive"])
    seen = written(pairs.select(*key).distinct(), "seen")
    return t.replace(receive=t.receive.join(seen, key, "left_anti"))


# Actions and the status they set.
STATUS_OF = {"ban": "banned", "unban": "active"}


def set_status(t: Tables, changes: DataFrame) -> Tables:
    """Apply (user_id, action, sent_at); the last action of a user counts."""
    status = F.coalesce(*(F.when(F.col("action") == a, s) for a, s in STATUS_OF.items()))
    known = changes.withColumn("_to", status).filter("_to is not null")
    last = known.groupBy("user_id").agg(F.max_by("_to", F.struct("sent_at", "_to")).alias("_to"))
    user = t.user.join(written(last, "statuses"), "user_id", "left")
    return t.replace(user=typed(user.withColumn("status", F.coalesce("_to", "status")), "user"))


# What a password's hash looks like: a scheme, then parameters and digest after dollar signs.
HASHED = r"^\$?[A-Za-z0-9_-]+(\$[^$]+)+$"


def is_hash(password: Column) -> Column:
    """A hashed password; an absent one passes."""
    return F.coalesce(password.rlike(HASHED), F.lit(True))


def edit_outcomes(t: Tables, changes: DataFrame) -> DataFrame:
    """Changes (user_id, name, email, status, password, sent_at), cleaned, with an outcome.

    The last change of a user counts; of those sent together the one with the
    greatest values does, and the others are superseded. An e-mail held by
    another user refuses the whole change; of several users that ask for the
    same one, the lowest id gets it. `password` is a password's hash, see
    `HASHED`; another text refuses the change.
    """
    word = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    fields = ("name", "email", "status", "password")
    every = changes.select("user_id", "sent_at", *(word(c).alias(c) for c in fields)).distinct()
    every = written(every, "edits")
    rank = F.struct("sent_at", *fields)
    last = every.groupBy("user_id").agg(F.max(rank).alias("_last"))
    clean = last.select("user_id", "_last.*")
    old = every.join(last, "user_id").filter(rank != F.col("_last")).select(
        "user_id", "sent_at", *fields, F.lit("superseded").alias("outcome")
    )
    asked = clean.filter("email is not null").select("email").distinct()
    held = t.user.select("email", F.col("user_id").alias("_holder"))
    held = held.join(asked, "email", "left_semi").groupBy("email")
    held = held.agg(F.min("_holder").alias("_low"), F.max("_holder").alias("_high"))
    other = (F.col("_low") != F.col("user_id")) | (F.col("_high") != F.col("user_id"))
    judged = clean.join(held, "email", "left")
    judged = judged.withColumn("_taken", F.coalesce(other, F.lit(False)))
    fit = F.col("email").isNotNull() & ~F.col("_taken") & is_hash(F.col("password"))
    free = judged.filter(fit).groupBy("email")
    judged = judged.join(free.agg(F.min("user_id").alias("_first")), "email", "left")
    known = t.user.select("user_id", F.lit(True).alias("_known"))
    judged = judged.join(known, "user_id", "left")
    outcome = (
        F.when(F.col("_known").isNull(), "not found")
        .when(~is_hash(F.col("password")), "password not hashed")
        .when(F.col("_taken") | (F.col("_first") != F.col("user_id")), "email in use")
        .otherwise("changed")
    )
    return judged.select("user_id", "sent_at", *fields, outcome.alias("outcome")).union(old)


def edit_users(t: Tables, changes: DataFrame) -> Tables:
    """Overwrite only what a change gives; a status counts only if it is a known one."""
    good = edit_outcomes(t, changes).filter("outcome = 'changed'").drop("outcome", "sent_at")
    status = F.when(F.col("status").isin(*STATUS_OF.values()), F.col("status"))
    good = good.withColumn("status", status)
    fields = ["name", "email", "status", "password"]
    good = good.withColumnsRenamed({c: f"_{c}" for c in fields})
    user = t.user.join(written(good, "good-edits"), "user_id", "left")
    user = user.withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    return t.replace(user=typed(user, "user"))


def problem_edit_outcomes(t: Tables, changes: DataFrame) -> DataFrame:
    """Changes (mentor_id, problem_id, title, description, correct_answer, difficulty, sent_at).

    Only the author edits a problem, and title and answer are needed. The last
    change of a problem that is fit counts; the others are superseded. A
    missing difficulty stands for Easy.
    """
    fields = ("title", "description", "correct_answer")
    clean = changes.select(
        "mentor_id", "problem_id", "sent_at",
        *(strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields),
        F.coalesce("difficulty", F.lit("Easy")).alias("difficulty"),
    )
    clean = written(clean.distinct(), "problem-edits")
    own = t.problem.select("problem_id", F.col("user_id").alias("mentor_id"), F.lit(True).alias("_own"))
    known = clean.join(own, ["problem_id", "mentor_id"], "left")
    reason = F.when(F.col("_own").isNull(), "not found").when(
        F.least(F.length("title"), F.length("correct_answer")) == 0, "missing field"
    )
    known = known.withColumn("_reason", reason)
    rank = F.struct("sent_at", *fields, "difficulty")
    last = known.filter("_reason is null").groupBy("problem_id").agg(F.max(rank).alias("_last"))
    judged = known.join(last, "problem_id", "left")
    late = F.when(rank != F.col("_last"), "superseded")
    outcome = F.coalesce("_reason", late, F.lit("changed"))
    return judged.select("mentor_id", "problem_id", "sent_at", *fields, "difficulty", outcome.alias("outcome"))


def edit_problems(t: Tables, changes: DataFrame) -> Tables:
    fields = ["title", "description", "correct_answer", "difficulty"]
    good = problem_edit_outcomes(t, changes).filter("outcome = 'changed'")
    good = good.select("problem_id", *(F.col(c).alias(f"_{c}") for c in fields))
    problem = t.problem.join(written(good, "good-edits"), "problem_id", "left")
    problem = problem.withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    return t.replace(problem=typed(problem, "problem"))


# Roles a request may name.
ROLES = ("student", "mentor", "admin")


def registration_outcomes(t: Tables, requests: DataFrame) -> DataFrame:
    """Requests (request_id, name, email, password, role), cleaned, with an outcome.

    All fields are needed, `password` is a password's hash, an e-mail is used
    once (the lowest request wins), and the role is a known one.
    """
    fields = ("name", "email", "password", "role")
    clean = requests.select(
        "request_id", *(strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields)
    )
    held = t.user.select("email", F.lit(True).alias("_held")).distinct()
    judged = clean.join(held, "email", "left")
    reason = (
        F.when(F.least(*(F.length(c) for c in fields)) == 0, "missing field")
        .when(F.col("_held"), "email in use")
        .when(~F.col("role").isin(*ROLES), "invalid role")
        .when(~is_hash(F.col("password")), "password not hashed")
    )
    judged = judged.withColumn("_reason", reason)
    first = judged.filter("_reason is null").groupBy("email")
    judged = judged.join(first.agg(F.min("request_id").alias("_first")), "email", "left")
    late = F.when(F.col("_first") != F.col("request_id"), "email in use")
    outcome = F.coalesce("_reason", late, F.lit("created"))
    return judged.select("request_id", *fields, outcome.alias("outcome"))


def register_users(t: Tables, requests: DataFrame, now: Column | None = None) -> Tables:
    """Add the users of valid requests and their rows in the relation of their role."""
    created = registration_outcomes(t, requests).filter("outcome = 'created'")
    users = assign_ids(created, t.user, "user_id", ["request_id"])
    added = {"user": with_defaults(users, "user", now)}
    for role in ROLES:
        members = users.filter(F.col("role") == role).select("user_id")
        added[role] = with_defaults(members, role, now)
    return t.replace(**{name: t[name].unionByName(rows) for name, rows in added.items()})


def add_generated(
    t: Tables, payloads: DataFrame, author_id: int, now: Column | None = None
) -> Tables:
    """Insert generated problems and their topics.

    `payloads` holds payload_id, scenario_no, payload and difficulty. Payloads
    of scenarios without a meaningful description are left out. Ids rise by
    payload and position.
    """
    now = F.current_timestamp() if now is None else now
    clear = meaningful_text(t.scenario, "scenario_description").filter("meaningful")
    wanted = payloads.join(clear.select("scenario_no"), "scenario_no", "left_semi")
    keys = ["payload_id", "scenario_no"]
    problems, topics, _ = parse_generated(wanted, "payload", F.col("difficulty"), keys)
    new = assign_ids(problems, t.problem, "problem_id", ["payload_id", "position"])
    rows = new.withColumns({"user_id": F.lit(author_id), "create_time": now})
    place = ["payload_id", "position"]
    pairs = topics.join(new.select("problem_id", *place), place).select("problem_id", "topic_name")
    added = upsert_topics(t, pairs, now=now)
    return added.replace(problem=t.problem.unionByName(typed(rows, "problem")))


def alert_rows(attempts: DataFrame, notification: DataFrame, mark: int = 90) -> DataFrame:
    """Attempts at or above the mark with the id of the notification each one causes.

    Ids rise by day, student and time.
    """
    good = attempts.filter(F.col("score") >= mark)
    day = F.asc_nulls_last(F.to_date("submit_time"))
    order = [day, "student_id", "submit_time", "problem_id", "attempt_no", "score"]
    return assign_ids(good, notification, "noti_id", order)


def high_score_alerts(
    t: Tables, attempts: DataFrame, mark: int = 90, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(notification rows, receive rows) caused by newly inserted attempts."""
    rows = alert_rows(attempts, t.notification, mark)
    now = F.current_timestamp() if now is None else now
    sent = typed(rows.select("noti_id", now.alias("send_time")), "notification")
    got = typed(rows.select(F.col("student_id").alias("receiver_id"), "noti_id"), "receive")
    return sent, got


def running_problem_counts(problems: DataFrame) -> DataFrame:
    """Problems inserted per author; works on a batch and on a stream."""
    return problems.groupBy("user_id").agg(F.count(F.lit(1)).alias("problems_created"))
