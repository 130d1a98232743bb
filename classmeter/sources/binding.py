"""The test tables (star schema, events, documents, pages, chats) seen as the relations.

Every source row is used. Ids of the user kinds are kept apart by large
offsets, so they stay apart however many customers there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from classmeter.sources.schemas import VOCABULARY
from classmeter.sources.tables import Tables, typed

MENTORS = 1_000_000_000_000
ADMINS = 2_000_000_000_000
CHATTERS = 3_000_000_000_000
RES_TYPES = VOCABULARY["resource"]["res_type"]
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
# The nation table has this many rows at every scale.
NATIONS = 25

RAW = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(RAW[table]).parquet(f"{sf_dir}/{table}.parquet")


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    """All relations, and the inputs of the scoring and gate jobs, as lazy frames."""
    read = lambda table: raw(spark, sf_dir, table)
    builders = {
        "user": lambda: users(read),
        "student": lambda: students(read),
        "mentor": lambda: mentors(read),
        "admin": lambda: admins(read),
        "topic": lambda: topics(read),
        "scenario": lambda: scenarios(read),
        "problem": lambda: problems(read),
        "attempt": lambda: attempts(read("lineitem"), read("orders")),
        "resource": lambda: resources(read),
        "notification": lambda: notifications(read),
        "have_topic": lambda: have_topics(read),
        "resourcetopic": lambda: resource_topics(read),
        "access": lambda: accesses(read),
        "send": lambda: sends(read),
        "receive": lambda: receives(read),
        "submissions": lambda: submissions(read),
        "staged": lambda: staged(read),
        "payloads": lambda: payloads(read),
        "questions": lambda: questions(read),
    }
    return Tables(builders)


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _user(key: Column, offset: int, name: Column) -> list[Column]:
    status = F.when(key % 7 == 0, "banned").otherwise("active")
    email = F.concat(F.regexp_replace(F.lower(name), "[ #]", "."), F.lit("@example.com"))
    return [
        (key + offset).alias("user_id"),
        name.alias("name"),
        email.alias("email"),
        F.lit("not set").alias("password"),
        status.alias("status"),
        F.expr(EPOCH).alias("created_at"),
    ]


def chatters(read) -> DataFrame:
    """One learner per conversation; these have never submitted anything."""
    return read("conversations").select("conv_id").distinct()


def users(read) -> DataFrame:
    chat_name = F.concat(F.lit("Chat#"), F.col("conv_id").cast("string"))
    parts = [
        read("customer").select(*_user(F.col("c_custkey"), 0, F.col("c_name"))),
        read("supplier").select(*_user(F.col("s_suppkey"), MENTORS, F.col("s_name"))),
        read("nation").select(*_user(F.col("n_nationkey").cast("long"), ADMINS, F.col("n_name"))),
        chatters(read).select(*_user(F.col("conv_id"), CHATTERS, chat_name)),
    ]
    first, *rest = parts
    for part in rest:
        first = first.union(part)
    return typed(first, "user")


def students(read) -> DataFrame:
    ids = read("customer").select(F.col("c_custkey").alias("user_id"))
    ids = ids.union(chatters(read).select(F.col("conv_id") + CHATTERS))
    ids = ids.withColumn("enrollment_date", F.expr(f"to_date({EPOCH})"))
    return typed(ids.withColumn("total_problems_attempted", F.lit(0)), "student")


def mentors(read) -> DataFrame:
    nation = read("nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("expertise_area")
    )
    found = read("supplier").join(nation, "s_nationkey", "left")
    found = found.withColumn("user_id", F.col("s_suppkey") + MENTORS)
    return typed(found.withColumn("problems_created", F.lit(0)), "mentor")


def admins(read) -> DataFrame:
    level = F.when(F.col("n_regionkey") == 0, "Super").otherwise("Standard")
    return read("nation").select(
        (F.col("n_nationkey").cast("long") + ADMINS).alias("user_id"), level.alias("admin_level")
    )


def _author(key: Column, read) -> Column:
    return key % row_count(read("supplier")) + MENTORS


def problems(read) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    difficulty = F.when(size <= 20, "Easy").when(size <= 38, "Medium").otherwise("Hard")
    answer = F.concat(
        F.lit("SELECT p_name, p_brand FROM "),
        F.lower("p_type"),
        F.lit(" WHERE p_size > "),
        size.cast("string"),
        F.lit(" AND p_brand = '"),
        F.col("p_brand"),
        F.lit("';"),
    )
    scenario = F.when(key % 3 == 0, key % row_count(read("documents")))
    part = read("part").select(
        key.alias("problem_id"),
        _author(key, read).alias("user_id"),
        answer.alias("correct_answer"),
        F.expr(f"{EPOCH} + make_dt_interval(cast(p_partkey % 365 as int))").alias("create_time"),
        F.col("p_name").alias("title"),
        difficulty.alias("difficulty"),
        scenario.alias("scenario_no"),
        F.concat_ws(" ", "p_brand", "p_type").alias("description"),
    )
    return typed(part, "problem")


def have_topics(read) -> DataFrame:
    words = F.array_union(F.array("p_type"), F.split("p_name", " "))
    return read("part").select(
        F.col("p_partkey").alias("problem_id"), F.explode(words).alias("topic_name")
    )


def topics(read) -> DataFrame:
    names = have_topics(read).select("topic_name").distinct()
    names = names.withColumn("description", F.lit(""))
    return typed(names.withColumn("created_at", F.expr(EPOCH)), "topic")


def scenarios(read) -> DataFrame:
    doc = F.col("doc_id")
    found = read("documents").select(
        doc.alias("scenario_no"),
        (doc % row_count(read("customer"))).alias("student_id"),
        F.col("text").alias("scenario_description"),
        F.expr(f"{EPOCH} + doc_id * interval '1' minute").alias("created_at"),
    )
    return typed(found, "scenario")


def _lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def attempts(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines as attempts: customer tried part, the line number is the attempt number."""
    reviewed = F.col("l_returnflag") == "R"
    note = F.concat(F.lit("note "), F.col("l_linenumber").cast("string"))
    found = _lines(lineitem, orders).select(
        F.col("o_custkey").alias("student_id"),
        F.col("l_partkey").alias("problem_id"),
        F.col("l_linenumber").alias("attempt_no"),
        F.when(reviewed, F.col("l_suppkey") + MENTORS).alias("mentor_id"),
        (F.col("l_quantity") * 2).cast("decimal(5,2)").alias("score"),
        F.col("l_shipdate").alias("submit_time"),
        F.when(reviewed, note).when(F.col("l_returnflag") == "A", "").alias("feedback"),
    )
    return typed(found, "attempt")


def staged(read) -> DataFrame:
    """Incoming attempts before the gates: some reviews lack a text, some scores are out of range."""
    shift = ((F.col("l_tax") - F.col("l_discount")) * 100).cast("decimal(5,2)")
    note = F.when(F.col("l_returnflag") == "R", "seen").when(F.col("l_returnflag") == "A", "")
    return _lines(read("lineitem"), read("orders")).select(
        F.col("o_custkey").alias("student_id"),
        F.col("l_partkey").alias("problem_id"),
        F.col("l_linenumber").alias("attempt_no"),
        F.when(F.col("l_linestatus") == "F", F.col("l_suppkey") + MENTORS).alias("mentor_id"),
        ((F.col("l_quantity") * 2).cast("decimal(5,2)") + shift).cast("decimal(6,2)").alias("score"),
        F.col("l_shipdate").alias("submit_time"),
        note.alias("feedback"),
    )


def submissions(read) -> DataFrame:
    """Four shapes of answers, told apart by the line number; see `problems` for the right one."""
    kind = F.lower("p_type")
    right = F.concat(
        F.lit("SELECT p_name, p_brand FROM "),
        kind,
        F.lit(" WHERE p_size > "),
        F.col("p_size").cast("string"),
        F.lit(" AND p_brand = '"),
        F.col("p_brand"),
        F.lit("';"),
    )
    quantity = F.col("l_quantity").cast("int").cast("string")
    shape = F.col("l_linenumber") % 4
    text = (
        F.when(shape == 0, right)
        .when(shape == 1, F.concat(F.lit("SELECT p_name FROM "), kind))
        .when(
            shape == 2,
            F.concat(
                F.lit("select p_brand, p_name from "), kind, F.lit(" where p_size > "), quantity
            ),
        )
        .otherwise(F.concat(F.lit("SELECT * FROM part p JOIN "), kind, F.lit(" x ON 1 = 1")))
    )
    wanted = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate"]
    # By the key of the join that follows; it also shares out a file that is one split.
    lines = _lines(read("lineitem").select(*wanted).repartition("l_orderkey"), read("orders"))
    part = read("part").select("p_partkey", "p_type", "p_size", "p_brand")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_custkey").alias("student_id"),
        F.col("l_partkey").alias("problem_id"),
        text.alias("student_sql"),
        F.col("l_shipdate").alias("submit_time"),
        F.col("l_linenumber").alias("line_no"),
    )


def resources(read) -> DataFrame:
    key = F.col("page_id")
    kinds = RES_TYPES
    kind = F.element_at(F.array(*map(F.lit, kinds)), (key % len(kinds)).cast("int") + 1)
    found = read("pages").select(
        key.alias("resource_id"),
        _author(key, read).alias("user_id"),
        F.concat(F.lit("Page "), key.cast("string")).alias("title"),
        kind.alias("res_type"),
        F.expr(f"{EPOCH} + page_id * interval '1' minute").alias("uploaded_time"),
        F.col("url").alias("resource_url"),
    )
    return typed(found, "resource")


def uploads(read) -> DataFrame:
    """Resource forms before the gates: the whole page as title, and one kind too many."""
    kinds = (*RES_TYPES, "Other")
    kind = F.element_at(
        F.array(*map(F.lit, kinds)), (F.col("page_id") % len(kinds)).cast("int") + 1
    )
    return read("pages").select(
        F.col("page_id").alias("resource_id"),
        F.lit(None).cast("long").alias("user_id"),
        F.col("html").alias("title"),
        kind.alias("res_type"),
        F.col("url").alias("resource_url"),
    )


def resource_topics(read) -> DataFrame:
    """Pages share the part types as topics."""
    kinds = F.array(*map(F.lit, PART_TYPES))
    return read("pages").select(
        F.col("page_id").alias("resource_id"),
        F.element_at(kinds, (F.col("page_id") % len(PART_TYPES)).cast("int") + 1).alias(
            "topic_name"
        ),
    )


def accesses(read) -> DataFrame:
    views = read("events").filter(F.col("event_type") == "view")
    pair = [
        (F.col("event_id") % row_count(read("pages"))).alias("resource_id"),
        F.col("user_id").alias("student_id"),
    ]
    return views.groupBy(*pair).agg(F.min("ts").alias("access_time"))


def _alerts(read) -> DataFrame:
    return read("events").filter(F.col("event_type").isin("signup", "error"))


def notifications(read) -> DataFrame:
    return _alerts(read).select(F.col("event_id").alias("noti_id"), F.col("ts").alias("send_time"))


def receives(read) -> DataFrame:
    return _alerts(read).select(
        F.col("user_id").alias("receiver_id"), F.col("event_id").alias("noti_id")
    )


def sends(read) -> DataFrame:
    errors = read("events").filter(F.col("event_type") == "error")
    return errors.select(
        (F.col("event_id") % NATIONS + ADMINS).alias("sender_id"),
        F.col("event_id").alias("noti_id"),
    )


def payloads(read) -> DataFrame:
    """Generated problem lists as JSON, one per document, and the bare document as a bad one."""
    problem = lambda title, body, sql, topics: F.struct(
        title.alias("title"),
        body.alias("description"),
        sql.alias("correct_sql"),
        topics.alias("topics"),
    )
    text, lang, source = F.col("text"), F.col("lang"), F.col("source")
    query = F.concat(F.lit(" SELECT "), lang, F.lit(" FROM "), source)
    blank = F.lit("  ")
    listed = F.array(
        problem(text, source, query, F.array(lang, text, blank)),
        problem(F.concat(F.lit(" "), source), blank, query, F.array(source)),
        problem(lang, source, blank, F.array(lang)),
    )
    good = F.to_json(F.struct(listed.alias("problems")))
    key = F.col("doc_id")
    docs = read("documents")
    return docs.select(
        (key * 2).alias("payload_id"), key.alias("scenario_no"), good.alias("payload"), lang.alias("difficulty")
    ).union(docs.select(key * 2 + 1, key, text, F.lit("hard")))


def questions(read) -> DataFrame:
    """Candidate SQL texts for the read-only gate: event commands, chats and documents."""
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    command = (
        F.when(kind == "view", F.concat(F.lit("SELECT * FROM events WHERE id = "), key))
        .when(kind == "signup", F.concat(F.lit("INSERT INTO events VALUES ("), key, F.lit(")")))
        .when(kind == "purchase", F.concat(F.lit("select created_at from topic -- "), key))
        .when(kind == "error", F.concat(F.lit("SELECT 1; DELETE FROM events WHERE id = "), key))
        .otherwise(F.concat(F.lit("with x as (select "), key, F.lit(") select * from x")))
    )
    turn = F.concat_ws("-", F.lit("chat"), F.col("conv_id"), F.col("turn"))
    return (
        read("events")
        .select(F.concat(F.lit("event-"), key).alias("question_id"), command.alias("sql"))
        .union(read("conversations").select(turn, F.concat(F.lit("SELECT "), F.col("text"))))
        .union(
            read("documents").select(
                F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("text")
            )
        )
    )
