"""Declared schemas, keys, references and column rules of the fifteen relations."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "id": T.LongType(),
    "int": T.IntegerType(),
    "text": T.StringType(),
    "time": T.TimestampNTZType(),
    "date": T.DateType(),
    "score": T.DecimalType(5, 2),
}


def _schema(columns: str) -> T.StructType:
    pairs = (column.split(":") for column in columns.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Relation and column names of the learning platform's data model.
SCHEMAS: dict[str, T.StructType] = {
    "user": _schema("user_id:id name:text email:text password:text status:text created_at:time"),
    "student": _schema("user_id:id enrollment_date:date total_problems_attempted:int"),
    "mentor": _schema("user_id:id expertise_area:text problems_created:int"),
    "admin": _schema("user_id:id admin_level:text"),
    "topic": _schema("topic_name:text description:text created_at:time"),
    "scenario": _schema("scenario_no:id student_id:id scenario_description:text created_at:time"),
    "problem": _schema(
        "problem_id:id user_id:id correct_answer:text create_time:time title:text "
        "difficulty:text scenario_no:id description:text"
    ),
    "attempt": _schema(
        "student_id:id problem_id:id attempt_no:int mentor_id:id score:score "
        "submit_time:time feedback:text"
    ),
    "resource": _schema(
        "resource_id:id user_id:id title:text res_type:text uploaded_time:time resource_url:text"
    ),
    "notification": _schema("noti_id:id send_time:time"),
    "have_topic": _schema("problem_id:id topic_name:text"),
    "resourcetopic": _schema("resource_id:id topic_name:text"),
    "access": _schema("resource_id:id student_id:id access_time:time"),
    "send": _schema("sender_id:id noti_id:id"),
    "receive": _schema("receiver_id:id noti_id:id"),
}

SUBMISSIONS = _schema("student_id:id problem_id:id student_sql:text submit_time:time")

# Primary keys, and the one other unique column.
KEYS: dict[str, tuple[str, ...]] = {
    "user": ("user_id",),
    "student": ("user_id",),
    "mentor": ("user_id",),
    "admin": ("user_id",),
    "topic": ("topic_name",),
    "scenario": ("scenario_no",),
    "problem": ("problem_id",),
    "attempt": ("student_id", "problem_id", "attempt_no"),
    "resource": ("resource_id",),
    "notification": ("noti_id",),
    "have_topic": ("problem_id", "topic_name"),
    "resourcetopic": ("resource_id", "topic_name"),
    "access": ("resource_id", "student_id"),
    "send": ("sender_id", "noti_id"),
    "receive": ("receiver_id", "noti_id"),
}
UNIQUE = {"user": ("email",)}

# Child relation and column -> parent relation (by its key), delete rule.
REFERENCES: list[tuple[str, str, str, str, str]] = [
    ("student", "user_id", "user", "user_id", "cascade"),
    ("mentor", "user_id", "user", "user_id", "cascade"),
    ("admin", "user_id", "user", "user_id", "cascade"),
    ("scenario", "student_id", "student", "user_id", "cascade"),
    ("problem", "user_id", "mentor", "user_id", "cascade"),
    ("problem", "scenario_no", "scenario", "scenario_no", "null"),
    ("attempt", "student_id", "student", "user_id", "cascade"),
    ("attempt", "problem_id", "problem", "problem_id", "cascade"),
    ("attempt", "mentor_id", "mentor", "user_id", "null"),
    ("resource", "user_id", "mentor", "user_id", "cascade"),
    ("have_topic", "problem_id", "problem", "problem_id", "cascade"),
    ("have_topic", "topic_name", "topic", "topic_name", "cascade"),
    ("resourcetopic", "resource_id", "resource", "resource_id", "cascade"),
    ("resourcetopic", "topic_name", "topic", "topic_name", "cascade"),
    ("access", "resource_id", "resource", "resource_id", "cascade"),
    ("access", "student_id", "student", "user_id", "cascade"),
    ("send", "sender_id", "user", "user_id", "cascade"),
    ("send", "noti_id", "notification", "noti_id", "cascade"),
    ("receive", "receiver_id", "user", "user_id", "cascade"),
    ("receive", "noti_id", "notification", "noti_id", "cascade"),
]

# Closed vocabularies.
VOCABULARY: dict[str, dict[str, tuple[str, ...]]] = {
    "user": {"status": ("active", "banned")},
    "admin": {"admin_level": ("Super", "Standard")},
    "problem": {"difficulty": ("Easy", "Medium", "Hard")},
    "resource": {
        "res_type": ("Article", "Video", "Tutorial", "Documentation", "Exercise"),
    },
}

# Columns that must be present, and the largest length of each text column.
REQUIRED: dict[str, tuple[str, ...]] = {
    "user": ("name", "email", "password"),
    "scenario": ("student_id", "scenario_description"),
    "problem": ("user_id", "correct_answer", "title", "difficulty"),
    "attempt": ("student_id", "problem_id", "attempt_no"),
    "resource": ("user_id", "title", "res_type"),
}
# Forms refuse these when they are empty after stripping.
NOT_BLANK: dict[str, tuple[str, ...]] = {
    "user": ("name", "email", "password"),
    "scenario": ("scenario_description",),
    "problem": ("title", "correct_answer"),
    "resource": ("title", "resource_url"),
}
MAX_LENGTH: dict[str, dict[str, int]] = {
    "user": {"name": 100, "email": 150, "password": 255, "status": 10},
    "mentor": {"expertise_area": 100},
    "admin": {"admin_level": 10},
    "topic": {"topic_name": 100},
    "problem": {"title": 200, "difficulty": 6},
    "resource": {"title": 200, "res_type": 15, "resource_url": 500},
    "have_topic": {"topic_name": 100},
    "resourcetopic": {"topic_name": 100},
}

# What an omitted column gets; "now" and "today" stand for the load time.
DEFAULTS: dict[str, dict[str, object]] = {
    "user": {"status": "active", "created_at": "now"},
    "student": {"enrollment_date": "today", "total_problems_attempted": 0},
    "mentor": {"expertise_area": "General", "problems_created": 0},
    "admin": {"admin_level": "Standard"},
    "topic": {"created_at": "now"},
    "scenario": {"created_at": "now"},
    "problem": {"create_time": "now"},
    "attempt": {"submit_time": "now"},
    "resource": {"uploaded_time": "now"},
    "notification": {"send_time": "now"},
    "access": {"access_time": "now"},
}
