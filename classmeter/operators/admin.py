"""User administration and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from classmeter.functions import filters
from classmeter.operators.learner import in_order, of
from classmeter.operators.reports import names
from classmeter.session import written
from classmeter.sources.tables import Tables, typed


def roles(t: Tables) -> DataFrame:
    """Users with their role; a user in several subtypes gets the first of the list."""
    found = t.user
    # Role precedence.
    kinds = ("student", "mentor", "admin")
    for kind in kinds:
        members = t[kind].select("user_id", F.lit(kind).alias(f"_{kind}"))
        found = found.join(members, "user_id", "left")
    role = F.coalesce(*(F.col(f"_{kind}") for kind in kinds), F.lit("unknown"))
    return found.withColumn("role", role)


def effective_status() -> Column:
    """A missing or empty status counts as active."""
    return F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("active"))


def user_directory(
    t: Tables, role: str | None = None, status: str | None = None, search: str | None = None
) -> DataFrame:
    found = roles(t).withColumn("status", effective_status())
    found = filters.where_given(found, role, lambda r: F.col("role") == r)
    found = filters.where_given(found, status, lambda s: F.col("status") == s)
    found = filters.where_given(
        found,
        search,
        lambda s: filters.contains_text(F.coalesce("name", F.lit("")), s)
        | filters.contains_text(F.coalesce("email", F.lit("")), s),
    )
    return found.select(
        "user_id",
        F.col("name").alias("username"),
        "email",
        "role",
        "status",
        F.col("created_at").alias("joined_date"),
    ).orderBy("user_id")


def user_totals(t: Tables) -> DataFrame:
    """Totals over all users, before any filter of the directory."""
    problems = t.problem.agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = t.user.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(effective_status() == "banned").alias("banned_users"),
    )
    active = F.col("total_users") - F.col("banned_users")
    return totals.select(
        "total_users", active.alias("active_users"), "banned_users", problems.alias("total_problems")
    )


def inbox(t: Tables, user_id: int | None = None) -> DataFrame:
    """Received notifications, newest first, one row per sender."""
    mine = of(t.receive, "receiver_id", user_id)
    sends = t.send
    if user_id is not None:  # a few of all sends
        sends = sends.join(mine.select("noti_id").distinct(), "noti_id", "left_semi")
    senders = sends.join(names(t, "sender_id", "sender_name"), "sender_id", "left")
    listed = (
        mine.join(t.notification, "noti_id")
        .join(senders, "noti_id", "left")
        .select(
            "receiver_id",
            "noti_id",
            "send_time",
            F.coalesce("sender_name", F.lit("System")).alias("sender_name"),
            "sender_id",
        )
    )
    return in_order(listed, user_id, F.desc_nulls_first("send_time"), "noti_id", "sender_id")


def notification_receivers(
    t: Tables, noti_id: int | None = None, asker_id: int | None = None
) -> DataFrame:
    """All receivers of a notification and their number, if the asker is one of them."""
    to = of(t.receive, "noti_id", noti_id)
    if asker_id is not None:
        allowed = to.filter(F.col("receiver_id") == asker_id).select("noti_id").distinct()
        to = to.join(allowed, "noti_id", "left_semi")
    counts = to.groupBy("noti_id").agg(F.count(F.lit(1)).alias("receiver_count"))
    people = t.user.select(F.col("user_id").alias("receiver_id"), "name", "email")
    listed = (
        to.join(people, "receiver_id")
        .join(counts, "noti_id")
        .select("noti_id", F.col("receiver_id").alias("user_id"), "name", "email", "receiver_count")
    )
    return in_order(listed, noti_id, "name", "user_id")


# Recipient choices of a message.
AUDIENCES = ("all_students", "all_mentors", "all_users", "specific")


def audience(t: Tables, rule: str, user_id: int | None = None) -> DataFrame:
    """User ids a recipient choice stands for."""
    if rule == "all_students":
        return t.student.select("user_id")
    if rule == "all_mentors":
        return t.mentor.select("user_id")
    if rule == "all_users":
        return t.user.select("user_id")
    if rule == "specific" and user_id is not None:
        return t.user.filter(F.col("user_id") == user_id).select("user_id")
    raise ValueError(f"unknown audience {rule!r}, or no user named for it")


def deliver(t: Tables, messages: DataFrame) -> DataFrame:
    """Receive rows of messages (noti_id, rule, user_id).

    A message to a whole group is a rare, single announcement: these are
    matched to the users' groups as a small side, one row per receiver.
    """
    groups = t.student.select("user_id", F.lit("all_students").alias("rule"))
    groups = groups.union(t.mentor.select("user_id", F.lit("all_mentors")))
    groups = groups.union(t.user.select("user_id", F.lit("all_users")))
    wide = messages.filter("rule <> 'specific'").select("noti_id", "rule")
    # Three groups are all keys there are, so the announcements, not the users, must move.
    wide = groups.join(written(wide, "announcements"), "rule")
    one = messages.filter("rule = 'specific'").join(t.user.select("user_id"), "user_id", "left_semi")
    receiver = F.col("user_id").alias("receiver_id")
    return wide.select(receiver, "noti_id").union(one.select(receiver, "noti_id"))


def send_notification(
    t: Tables, sender_id: int, rule: str, user_id: int | None = None, now: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notification, send, receive) rows of one new message.

    The sender must be an admin and a single recipient a known user; anything
    else is an error.
    """
    if t.admin.filter(F.col("user_id") == sender_id).isEmpty():
        raise PermissionError(f"user {sender_id} is not an admin")
    if rule == "specific" and t.user.filter(F.col("user_id") == user_id).isEmpty():
        raise ValueError(f"no user {user_id}")
    now = F.current_timestamp() if now is None else now
    first = t.notification.agg((F.coalesce(F.max("noti_id"), F.lit(0)) + 1).alias("noti_id"))
    noti_id = first.scalar()
    receivers = audience(t, rule, user_id)
    return (
        typed(first.withColumn("send_time", now), "notification"),
        typed(first.withColumn("sender_id", F.lit(sender_id)), "send"),
        typed(receivers.select(F.col("user_id").alias("receiver_id"), noti_id.alias("noti_id")), "receive"),
    )
