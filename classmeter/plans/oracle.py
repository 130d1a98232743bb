"""The same results as plain SQL over the test tables, written apart from the Spark code."""

from __future__ import annotations

import re

MENTORS, ADMINS, CHATTERS = 10**12, 2 * 10**12, 3 * 10**12
NOW = "TIMESTAMP '2024-06-01 12:00:00'"
START = "TIMESTAMP '2024-01-01 00:00:00'"
# All white space, for patterns; the inside of a character class.
W = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{W}]+', ''), '[{W}]+$', '')"


def half_up(total: str, n: str) -> str:
    """Two places, halves up, in whole cents."""
    cents = f"CAST({total} * 100 AS BIGINT)"
    return f"((2 * {cents} + {n}) // (2 * {n})) / 100.0::DOUBLE"


def half_even(total: str, n: str, digits: int = 2) -> str:
    """Halves to the even digit, in whole units of the last place."""
    n = n if digits == 2 else f"({n} * 10)"
    cents = f"CAST({total} * 100 AS BIGINT)"
    up = f"((2 * {cents} + {n}) // (2 * {n}))"
    tie = f"((2 * {cents} + {n}) % (2 * {n}) = 0 AND {up} % 2 = 1)"
    return f"({up} - CASE WHEN {tie} THEN 1 ELSE 0 END) / {10.0**digits}::DOUBLE"


def mean(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE) / nullif(count({x}), 0)"


def author(key: str) -> str:
    return f"{MENTORS} + {key} % (SELECT count(*) FROM supplier)"


def _user(key: str, offset: int, name: str, source: str) -> str:
    return (
        f"SELECT {key} + {offset} AS user_id, {name} AS name, "
        f"regexp_replace(lower({name}), '[ #]', '.', 'g') || '@example.com' AS email, "
        f"CASE WHEN {key} % 7 = 0 THEN 'banned' ELSE 'active' END AS status, "
        f"{START} AS created_at FROM {source}"
    )


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
ANSWER = (
    "'SELECT p_name, p_brand FROM ' || lower(p_type) || ' WHERE p_size > ' || p_size "
    "|| ' AND p_brand = ''' || p_brand || ''';'"
)

RELATIONS: dict[str, str] = {
    "chatters": "SELECT DISTINCT conv_id FROM conversations",
    "users": " UNION ALL ".join(
        [
            _user("c_custkey", 0, "c_name", "customer"),
            _user("s_suppkey", MENTORS, "s_name", "supplier"),
            _user("n_nationkey::BIGINT", ADMINS, "n_name", "nation"),
            _user("conv_id", CHATTERS, "('Chat#' || conv_id)", "chatters"),
        ]
    ),
    "student": f"SELECT c_custkey AS user_id FROM customer "
    f"UNION ALL SELECT conv_id + {CHATTERS} FROM chatters",
    "mentor": f"SELECT s_suppkey + {MENTORS} AS user_id FROM supplier",
    "admin": f"SELECT n_nationkey::BIGINT + {ADMINS} AS user_id FROM nation",
    "problem": f"""SELECT p_partkey AS problem_id, {author('p_partkey')} AS user_id,
        {ANSWER} AS correct_answer, {START} + to_days(CAST(p_partkey % 365 AS INT)) AS create_time,
        p_name AS title,
        CASE WHEN p_size <= 20 THEN 'Easy' WHEN p_size <= 38 THEN 'Medium' ELSE 'Hard' END AS difficulty,
        CASE WHEN p_partkey % 3 = 0 THEN p_partkey % (SELECT count(*) FROM documents) END AS scenario_no,
        p_brand || ' ' || p_type AS description FROM part""",
    "have_topic": """SELECT DISTINCT p_partkey AS problem_id, topic_name FROM (
        SELECT p_partkey, p_type AS topic_name FROM part
        UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part)""",
    "topic": "SELECT DISTINCT topic_name FROM have_topic",
    "scenario": f"""SELECT doc_id AS scenario_no, doc_id % (SELECT count(*) FROM customer) AS student_id,
        text AS scenario_description, {START} + to_minutes(doc_id) AS created_at FROM documents""",
    "attempt": f"""SELECT o_custkey AS student_id, l_partkey AS problem_id, l_linenumber AS attempt_no,
        CASE WHEN l_returnflag = 'R' THEN l_suppkey + {MENTORS} END AS mentor_id,
        CAST(l_quantity * 2 AS DECIMAL(5,2)) AS score, l_shipdate AS submit_time,
        CASE l_returnflag WHEN 'R' THEN 'note ' || l_linenumber WHEN 'A' THEN '' END AS feedback
        FROM {LINES}""",
    "staged": f"""SELECT o_custkey AS student_id, l_linenumber AS attempt_no,
        CASE WHEN l_linestatus = 'F' THEN l_suppkey + {MENTORS} END AS mentor_id,
        CAST(l_quantity * 2 AS DECIMAL(5,2)) + CAST((l_tax - l_discount) * 100 AS DECIMAL(5,2)) AS score,
        CASE l_returnflag WHEN 'R' THEN 'seen' WHEN 'A' THEN '' END AS feedback FROM {LINES}""",
    "submissions": f"""SELECT o_custkey AS student_id, l_partkey AS problem_id, l_linenumber AS line_no,
        l_shipdate AS submit_time, CAST(l_quantity AS INT) AS quantity, p_size,
        CASE l_linenumber % 4 WHEN 0 THEN {ANSWER}
        WHEN 1 THEN 'SELECT p_name FROM ' || lower(p_type)
        WHEN 2 THEN 'select p_brand, p_name from ' || lower(p_type) || ' where p_size > '
             || CAST(l_quantity AS INT)
        ELSE 'SELECT * FROM part p JOIN ' || lower(p_type) || ' x ON 1 = 1' END AS student_sql
        FROM {LINES} JOIN part ON l_partkey = p_partkey""",
    "resource": f"""SELECT page_id AS resource_id, {author('page_id')} AS user_id,
        'Page ' || page_id AS title,
        ['Article', 'Video', 'Tutorial', 'Documentation', 'Exercise'][page_id % 5 + 1] AS res_type,
        {START} + to_minutes(page_id) AS uploaded_time, url AS resource_url FROM pages""",
    "uploads": """SELECT page_id AS resource_id, NULL AS user_id, html AS title, url AS resource_url,
        ['Article', 'Video', 'Tutorial', 'Documentation', 'Exercise', 'Other'][page_id % 6 + 1]
        AS res_type FROM pages""",
    "resourcetopic": """SELECT page_id AS resource_id,
        ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][page_id % 6 + 1] AS topic_name
        FROM pages""",
    "access": """SELECT event_id % (SELECT count(*) FROM pages) AS resource_id, user_id AS student_id,
        min(ts) AS access_time FROM events WHERE event_type = 'view' GROUP BY ALL""",
    "notification": """SELECT event_id AS noti_id, ts AS send_time FROM events
        WHERE event_type IN ('signup', 'error')""",
    "receive": """SELECT user_id AS receiver_id, event_id AS noti_id FROM events
        WHERE event_type IN ('signup', 'error')""",
    "send": f"""SELECT {ADMINS} + event_id % 25 AS sender_id, event_id AS noti_id FROM events
        WHERE event_type = 'error'""",
    "questions": """SELECT 'event-' || event_id AS question_id, CASE event_type
        WHEN 'view' THEN 'SELECT * FROM events WHERE id = ' || event_id
        WHEN 'signup' THEN 'INSERT INTO events VALUES (' || event_id || ')'
        WHEN 'purchase' THEN 'select created_at from topic -- ' || event_id
        WHEN 'error' THEN 'SELECT 1; DELETE FROM events WHERE id = ' || event_id
        ELSE 'with x as (select ' || event_id || ') select * from x' END AS sql FROM events
        UNION ALL SELECT 'chat-' || conv_id || '-' || turn, 'SELECT ' || text FROM conversations
        UNION ALL SELECT 'doc-' || doc_id, text FROM documents""",
    "texts": """SELECT 'try-' || student_id || '-' || problem_id || '-' || line_no AS text_id,
        student_sql AS sql FROM submissions
        UNION ALL SELECT 'answer-' || problem_id, correct_answer FROM problem
        UNION ALL SELECT question_id, sql FROM questions""",
    "normals": rf"""SELECT text_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(
        sql, ';[{W}]*$', ''), '--[^\n]*', '', 'g'), '[{W}]+', ' ', 'g')), ' ') AS n FROM texts""",
    "bodies": """SELECT text_id, n, substr(n, 8) AS body, starts_with(n, 'select ')
        AND instr(substr(n, 8), ' from ') > 0 AS ok FROM normals""",
    "rests": """SELECT *, CASE WHEN ok THEN substr(body, instr(body, ' from ') + 6) ELSE '' END AS rest
        FROM bodies""",
    "clauses": """SELECT text_id, CASE WHEN ok THEN substr(body, 1, instr(body, ' from ') - 1) ELSE n END AS s,
        CASE WHEN instr(rest, ' where ') > 0 THEN substr(rest, 1, instr(rest, ' where ') - 1) ELSE rest END AS f,
        CASE WHEN instr(rest, ' where ') > 0 THEN substr(rest, instr(rest, ' where ') + 7) ELSE '' END AS w
        FROM rests""",
    "payloads": """SELECT doc_id AS scenario_no, text, lang, source, doc_id * 2 AS good,
        doc_id * 2 + 1 AS bad FROM documents""",
    "drafted": f"""SELECT problem_id, user_id, difficulty, scenario_no FROM problem
        UNION ALL SELECT problem_id + 10000000000000, user_id, difficulty, NULL FROM problem WHERE problem_id % 4 = 0
        UNION ALL SELECT scenario_no + 20000000000000, {MENTORS} + scenario_no % 2, 'Easy', scenario_no FROM scenario""",
    "tallies": f"""SELECT student_id AS user_id, count(DISTINCT problem_id) AS problems, {mean('score')} AS mean,
        max(score) AS best, count(*) AS attempts, sum(score) AS total, count(score) AS scored
        FROM attempt GROUP BY student_id""",
    "performance": f"""SELECT user_id, name, email, coalesce(t.problems, 0) AS problems_attempted,
        t.mean AS average_score, t.best AS highest_score, coalesce(t.attempts, 0) AS total_attempts,
        t.total, coalesce(t.scored, 0) AS scored
        FROM users SEMI JOIN student USING (user_id) LEFT JOIN tallies t USING (user_id)""",
    "statistics": f"""SELECT problem_id, title, difficulty, topics, coalesce(x.students, 0) AS students_attempted,
        x.mean AS average_score, coalesce(x.n, 0) * greatest(coalesce(labels, 0), 1) AS total_attempts,
        (SELECT name FROM users u WHERE u.user_id = p.user_id) AS created_by_mentor
        FROM problem p LEFT JOIN topic_lines USING (problem_id) LEFT JOIN (SELECT problem_id,
        count(DISTINCT student_id) AS students, {mean('score')} AS mean, count(*) AS n
        FROM attempt GROUP BY problem_id) x USING (problem_id)""",
    "topic_lines": """SELECT problem_id, string_agg(topic_name, ',' ORDER BY topic_name) AS topics, count(*) AS labels
        FROM have_topic GROUP BY problem_id""",
    "mine": """SELECT a.*, p.title, p.difficulty, p.user_id AS author_id FROM attempt a
        JOIN problem p USING (problem_id)""",
    "alerts": f"""SELECT max_id + row_number() OVER (ORDER BY CAST(submit_time AS DATE), student_id,
        submit_time, problem_id, attempt_no, score) AS noti_id, student_id AS receiver_id,
        {NOW} AS send_time FROM attempt, (SELECT max(noti_id) AS max_id FROM notification)
        WHERE score >= 90""",
}


def with_relations(sql: str) -> str:
    """Put the relations a query names, and those they name, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in RELATIONS:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(RELATIONS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    parts = ", ".join(f"{name} AS ({RELATIONS[name]})" for name in needed)
    return f"WITH {parts} {sql}"


MY = (
    "student_id, problem_id, title, difficulty, attempt_no, score, submit_time, feedback FROM mine"
)
IN_RANGE = (
    "CAST(submit_time AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' "
    "AND score BETWEEN 50 AND 90 AND difficulty = 'Easy'"
)
STATS = f"""student_id, {mean('score')} AS avg_score, count(*) FILTER (score >= 90) AS high_score_count,
    count(*) AS total_attempts, 100.0::DOUBLE * count(*) FILTER (score >= 90) / count(*) AS high_score_pct"""
NEWEST = "submit_time DESC, attempt_no DESC, problem_id, score DESC"
BROWSE = """SELECT p.problem_id, p.title, p.difficulty, u.name AS author, p.scenario_no, topics
    FROM problem p JOIN users u USING (user_id) JOIN topic_lines USING (problem_id)"""
PENDING = """SELECT mentor_id, place, student_id, u.name AS student_name, problem_id, title, attempt_no,
    score, submit_time FROM (SELECT * EXCLUDE (mentor_id), author_id AS mentor_id, CAST(row_number() OVER (PARTITION BY author_id
    ORDER BY submit_time, student_id, problem_id, attempt_no, score) AS INTEGER) AS place FROM mine WHERE {0}) x
    JOIN users u ON u.user_id = x.student_id WHERE place <= 10"""
MY_PROBLEMS = f"""SELECT p.user_id AS mentor_id, p.problem_id, p.title, p.difficulty, p.create_time,
    count(a.problem_id) AS total_attempts,
    coalesce({half_even('sum(a.score)', 'count(a.score)')}, 0) AS avg_score,
    coalesce(CAST(printf('%.2f', (count(*) FILTER (a.score >= 60))::DOUBLE / nullif(count(a.problem_id), 0) * 100)
        AS DOUBLE), 0) AS pass_rate,
    count(DISTINCT a.student_id) AS unique_students, any_value(topics) AS topics
    FROM problem p LEFT JOIN attempt a USING (problem_id) JOIN topic_lines USING (problem_id)
    WHERE {{0}} GROUP BY p.user_id, p.problem_id, p.title, p.difficulty, p.create_time {{1}}"""
REVIEW = """SELECT author_id, problem_id, title, student_id, s.name AS student_name, attempt_no, score,
    submit_time, r.name AS reviewer_name, feedback FROM mine JOIN users s ON s.user_id = student_id
    LEFT JOIN users r ON r.user_id = mentor_id"""
DIRECTORY = """SELECT u.user_id, name AS username, email, CASE
    WHEN u.user_id IN (SELECT user_id FROM student) THEN 'student'
    WHEN u.user_id IN (SELECT user_id FROM mentor) THEN 'mentor'
    WHEN u.user_id IN (SELECT user_id FROM admin) THEN 'admin' ELSE 'unknown' END AS role,
    status, created_at AS joined_date FROM users u"""
ROLE_SETS = """SELECT 'all_students' AS rule, user_id FROM student
    UNION ALL SELECT 'all_mentors', user_id FROM mentor UNION ALL SELECT 'all_users', user_id FROM users"""
COUNTED = [
    ("user", "users"), ("student", "student"), ("mentor", "mentor"), ("admin", "admin"),
    ("topic", "topic"), ("scenario", "scenario"), ("problem", "problem"), ("attempt", "attempt"),
    ("resource", "resource"), ("notification", "notification"), ("have_topic", "have_topic"),
    ("resourcetopic", "resourcetopic"), ("access", "access"), ("send", "send"),
    ("receive", "receive"),
]
ROW_COUNTS = " UNION ALL ".join(
    f"SELECT '{label}' AS relation, count(*) AS n_rows FROM {name}" for label, name in COUNTED
)
SCORE_CASE = "CASE line_no % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"
HIT = "quantity = p_size"
SCORE = SCORE_CASE.format("100.0", "60.0", f"CASE WHEN {HIT} THEN 90.0 ELSE 70.0 END", "40.0")


def shape(a: str, b: str, c: str, d: str) -> str:
    return f"CAST({SCORE_CASE.format(a, b, c, d)} AS DOUBLE)"


def listed(items: str) -> str:
    return f"array_to_string(list_sort(list_distinct({items})), '|')"


def pieces(text: str, mark: str) -> str:
    return (
        f"list_filter(list_transform(string_split({text}, '{mark}'), lambda x: {strip('x')}), "
        "lambda x: x <> '')"
    )


NAMED = rf"regexp_extract_all(f, '(?:^|[^\p{{L}}\p{{N}}_])(?:from|join)[{W}]+([a-z_][a-z0-9_]*)', 1)"
FIRST_WORDS = f"list_transform({pieces('f', ',')}, lambda x: regexp_extract(x, '^[^{W}]+'))"
BARE = rf"regexp_replace(replace(x, '`', ''), '(?i)[{W}]+as[{W}]+[\p{{L}}\p{{N}}_]+$', '')"
COLUMN = (
    f"CASE WHEN contains(x, '(') OR contains(x, ')') THEN x "
    f"ELSE {strip(f'string_split({BARE}, chr(46))[-1]')} END"
)
DEPTH = (
    rf"least(length(regexp_replace(regexp_extract(x, '^(\([{W}]*)*'), '[^(]', '', 'g')), "
    rf"length(regexp_replace(regexp_extract(x, '([{W}]*\))*$'), '[^)]', '', 'g')))"
)
UNWRAPPED = strip(
    rf"regexp_replace(regexp_replace(x, '^(\([{W}]*){{' || {DEPTH} || '}}', ''), "
    rf"'([{W}]*\)){{' || {DEPTH} || '}}$', '')"
)
WRITE_WORDS = "insert|update|delete|drop|alter|truncate|create"


def gate(words: str) -> str:
    low = f"lower({strip('sql')})"
    reason = (
        f"CASE WHEN NOT starts_with({low}, 'select') THEN 'not a select' "
        f"WHEN regexp_matches({low}, '{words}') THEN 'write word' END"
    )
    return f"SELECT question_id, {reason} AS reason, {reason} IS NULL AS accepted FROM questions"


def cut(x: str) -> str:
    return f"CASE WHEN length({x}) > 200 THEN substr({x}, 1, 197) || '...' ELSE {x} END"


LEVEL = "CASE WHEN lang IN ('easy', 'medium', 'hard') THEN upper(lang[1]) || lang[2:] ELSE 'Easy' END"
GENERATED = f"""SELECT good AS payload_id, scenario_no, 0 AS position, {cut(strip('text'))} AS title,
    nullif({strip('source')}, '') AS description, 'SELECT ' || lang || ' FROM ' || source AS correct_answer,
    {LEVEL} AS difficulty FROM payloads WHERE {strip('text')} <> ''
    UNION ALL SELECT good, scenario_no, 1, source, NULL, 'SELECT ' || lang || ' FROM ' || source, {LEVEL}
    FROM payloads"""
GENERATED_TOPICS = f"""SELECT DISTINCT payload_id, scenario_no, position, topic_name FROM (
    SELECT good AS payload_id, scenario_no, 0 AS position, unnest([lang, {strip('substr(text, 1, 100)')}])
        AS topic_name FROM payloads WHERE {strip('text')} <> ''
    UNION ALL SELECT good, scenario_no, 1, source FROM payloads) WHERE topic_name <> ''"""
TAGGED = """SELECT student_id, {0} AS {1}, count(*) AS n_rows, CAST(sum(attempt_no) AS BIGINT) AS numbers
    FROM staged GROUP BY 1, 2"""
NO_TEXT = "mentor_id IS NOT NULL AND feedback IS NULL"
OUTSIDE = "score < 0 OR score > 100"
KEY_CHECKS = [
    ("user", "user_id", "users"), ("student", "user_id", "student"), ("mentor", "user_id", "mentor"),
    ("admin", "user_id", "admin"), ("topic", "topic_name", "topic"),
    ("scenario", "scenario_no", "scenario"), ("problem", "problem_id", "problem"),
    ("attempt", "student_id,problem_id,attempt_no", "attempt"),
    ("resource", "resource_id", "resource"), ("notification", "noti_id", "notification"),
    ("have_topic", "problem_id,topic_name", "have_topic"),
    ("resourcetopic", "resource_id,topic_name", "resourcetopic"),
    ("access", "resource_id,student_id", "access"), ("send", "sender_id,noti_id", "send"),
    ("receive", "receiver_id,noti_id", "receive"), ("user", "email", "users"),
]
KEYS = " UNION ALL ".join(
    f"SELECT '{label}' AS relation, '{keys}' AS key, concat_ws(',', {keys}) AS value, count(*) AS n_rows "
    f"FROM {name} GROUP BY {keys} HAVING count(*) > 1"
    for label, keys, name in KEY_CHECKS
)
# Relations with foreign ids put in on purpose, for the reference check.
BROKEN = {
    "attempt": """(SELECT * REPLACE (CASE WHEN student_id % 5 = 0 THEN problem_id + 4000000000000 ELSE problem_id END
        AS problem_id, CASE WHEN attempt_no = 3 THEN student_id ELSE mentor_id END AS mentor_id) FROM attempt)""",
    "have_topic": """(SELECT * REPLACE (CASE WHEN problem_id % 7 = 0 THEN upper(topic_name) ELSE topic_name END
        AS topic_name) FROM have_topic)""",
    "send": """(SELECT * REPLACE (CASE WHEN noti_id % 2 = 0 THEN sender_id + 4000000000000 ELSE sender_id END
        AS sender_id) FROM send)""",
}
EDGES = [
    ("student", "user_id", "users", "user_id"), ("mentor", "user_id", "users", "user_id"),
    ("admin", "user_id", "users", "user_id"), ("scenario", "student_id", "student", "user_id"),
    ("problem", "user_id", "mentor", "user_id"), ("problem", "scenario_no", "scenario", "scenario_no"),
    ("attempt", "student_id", "student", "user_id"), ("attempt", "problem_id", "problem", "problem_id"),
    ("attempt", "mentor_id", "mentor", "user_id"), ("resource", "user_id", "mentor", "user_id"),
    ("have_topic", "problem_id", "problem", "problem_id"), ("have_topic", "topic_name", "topic", "topic_name"),
    ("resourcetopic", "resource_id", "resource", "resource_id"),
    ("resourcetopic", "topic_name", "topic", "topic_name"),
    ("access", "resource_id", "resource", "resource_id"), ("access", "student_id", "student", "user_id"),
    ("send", "sender_id", "users", "user_id"), ("send", "noti_id", "notification", "noti_id"),
    ("receive", "receiver_id", "users", "user_id"), ("receive", "noti_id", "notification", "noti_id"),
]


def edge_sql(child: str, column: str, parent: str, key: str) -> str:
    label = "user" if parent == "users" else parent
    of, to = BROKEN.get(child, f"(SELECT * FROM {child})"), f"(SELECT * FROM {parent})"
    return (
        f"SELECT '{child}' AS child, '{column}' AS \"column\", '{label}' AS parent, "
        f"CAST(c.{column} AS VARCHAR) AS missing_key, count(*) AS n_rows FROM {of} c "
        f"WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {to} p WHERE p.{key} = c.{column}) "
        f"GROUP BY c.{column}"
    )


NEXT_ATTEMPTS = """(SELECT student_id, attempt_no + 1 AS attempt_no, mentor_id,
    problem_id + CASE WHEN student_id % 5 = 0 THEN 4000000000000 ELSE 0 END AS problem_id FROM attempt)"""
_ATTEMPT = "student_id, problem_id, attempt_no"
DELTA_KEYS = f"""SELECT 'attempt' AS relation, 'student_id,problem_id,attempt_no' AS key,
        concat_ws(',', {_ATTEMPT}) AS value, n_new, coalesce(n_held, 0) AS n_held
    FROM (SELECT {_ATTEMPT}, count(*) AS n_new FROM {NEXT_ATTEMPTS} GROUP BY ALL)
    LEFT JOIN (SELECT {_ATTEMPT}, count(*) AS n_held FROM attempt GROUP BY ALL) USING ({_ATTEMPT})
    WHERE n_new + coalesce(n_held, 0) > 1"""
DELTA_BRIDGE = """(SELECT problem_id, CASE WHEN problem_id % 7 = 0 THEN upper(topic_name)
    ELSE reverse(topic_name) END AS topic_name FROM have_topic)"""
DELTA_EDGES = [
    (NEXT_ATTEMPTS, "attempt", "student_id", "student", "user_id", "student"),
    (NEXT_ATTEMPTS, "attempt", "problem_id", "problem", "problem_id", "problem"),
    (NEXT_ATTEMPTS, "attempt", "mentor_id", "mentor", "user_id", "mentor"),
    (DELTA_BRIDGE, "have_topic", "problem_id", "problem", "problem_id", "problem"),
    (DELTA_BRIDGE, "have_topic", "topic_name", "topic", "topic_name",
     "(SELECT topic_name FROM topic UNION ALL SELECT upper(topic_name) FROM topic)"),
]


def delta_edge(delta: str, child: str, column: str, parent: str, key: str, held: str) -> str:
    return (
        f"SELECT '{child}' AS child, '{column}' AS \"column\", '{parent}' AS parent, "
        f"CAST(c.{column} AS VARCHAR) AS missing_key, count(*) AS n_rows FROM {delta} c "
        f"WHERE c.{column} IS NOT NULL AND c.{column} NOT IN (SELECT {key} FROM {held} WHERE {key} IS NOT NULL) "
        f"GROUP BY c.{column}"
    )


def violation(relation: str, key: str, source: str, column: str, kind: str, wrong: str) -> str:
    return (
        f"SELECT '{relation}' AS relation, {key} AS id, '{column}' AS \"column\", "
        f"'{kind}' AS violation FROM {source} WHERE {wrong}"
    )


DOC_FORM = """(SELECT doc_id, nullif(source, 'src0') AS correct_answer, text AS title,
    CASE WHEN lang = 'en' THEN 'Easy' ELSE 'Difficult' END AS difficulty FROM documents)"""
VIOLATIONS = " UNION ALL ".join(
    [
        violation("resource", "resource_id", "uploads", "user_id", "missing", "user_id IS NULL"),
        violation("resource", "resource_id", "uploads", "title", "missing", "title IS NULL"),
        violation("resource", "resource_id", "uploads", "title", "blank", f"{strip('title')} = ''"),
        violation("resource", "resource_id", "uploads", "resource_url", "blank", f"{strip('resource_url')} = ''"),
        violation("resource", "resource_id", "uploads", "title", "too long", "length(title) > 200"),
        violation("resource", "resource_id", "uploads", "resource_url", "too long", "length(resource_url) > 500"),
        violation("problem", "doc_id", DOC_FORM, "correct_answer", "missing", "correct_answer IS NULL"),
        violation("problem", "doc_id", DOC_FORM, "title", "missing", "title IS NULL"),
        violation("problem", "doc_id", DOC_FORM, "title", "blank", f"{strip('title')} = ''"),
        violation("problem", "doc_id", DOC_FORM, "title", "too long", "length(title) > 200"),
        violation("problem", "doc_id", DOC_FORM, "difficulty", "too long", "length(difficulty) > 6"),
    ]
)
NUMBERED = """SELECT s.student_id, s.problem_id, CAST(coalesce(last_no, 0) + row_number() OVER (
    PARTITION BY s.student_id, s.problem_id ORDER BY s.submit_time, s.student_sql, {0}) AS INTEGER) AS attempt_no,
    CAST(NULL AS BIGINT) AS mentor_id, CAST({0} AS DECIMAL(5,2)) AS score, s.submit_time,
    CAST(NULL AS VARCHAR) AS feedback FROM submissions s LEFT JOIN (SELECT student_id, problem_id,
    max(attempt_no) AS last_no FROM attempt GROUP BY ALL) l USING (student_id, problem_id)"""
REVIEWS = """SELECT student_id, problem_id, attempt_no, max(CAST(submit_time AS VARCHAR) || '|'
    || CAST(reviewer AS VARCHAR)) AS last, 'seen ' || problem_id AS text FROM (
    SELECT a.*, coalesce(a.mentor_id, p.user_id) AS reviewer, p.user_id AS author FROM attempt a
    JOIN problem p USING (problem_id)) WHERE reviewer = author AND attempt_no <> 2
    GROUP BY student_id, problem_id, attempt_no"""
TRIED = "(SELECT problem_id FROM attempt)"
ASKED = f"CASE WHEN p.difficulty = 'Hard' THEN {MENTORS} ELSE p.user_id END"
DELETE_OUTCOME = f"""SELECT {ASKED} AS mentor_id, p.problem_id, CASE WHEN {ASKED} <> p.user_id THEN 'not found'
    WHEN p.problem_id IN {TRIED} THEN 'refused' ELSE 'deleted' END AS outcome FROM drafted p"""
SCENARIO_OUTCOME = f"""SELECT student_id, scenario_no, CASE WHEN scenario_no IN (SELECT scenario_no
    FROM drafted WHERE scenario_no IS NOT NULL AND problem_id IN {TRIED})
    THEN 'refused' ELSE 'deleted' END AS outcome FROM scenario"""
BANNED = "(SELECT user_id FROM users WHERE status = 'banned')"
DELETABLE = f"""(SELECT user_id FROM users WHERE status = 'banned' AND user_id NOT IN (
    SELECT user_id FROM problem WHERE problem_id IN {TRIED}))"""

# The platform after new attempts, reviews of all attempts, and the removal of banned users with all that is theirs.
RELATIONS["later"] = f"""SELECT student_id, problem_id, attempt_no, mentor_id, score, submit_time FROM attempt
    UNION ALL SELECT student_id, problem_id, attempt_no, mentor_id, score, submit_time
    FROM ({NUMBERED.format("s.line_no * 10")})"""
RELATIONS["reviewed"] = f"""SELECT a.student_id, a.problem_id, a.score,
    coalesce(CAST(string_split(r.last, '|')[2] AS BIGINT), a.mentor_id) AS mentor_id FROM later a
    LEFT JOIN ({REVIEWS.replace("FROM attempt a", "FROM later a")}) r USING (student_id, problem_id, attempt_no)"""
RELATIONS["stayed"] = f"""SELECT student_id, problem_id, score,
    CASE WHEN mentor_id NOT IN {BANNED} THEN mentor_id END AS mentor_id FROM reviewed
    WHERE student_id NOT IN {BANNED} AND problem_id IN (SELECT problem_id FROM problem WHERE user_id NOT IN {BANNED})"""
KEPT = {
    "kept_performance": f"""SELECT u.user_id, name, email, coalesce(x.problems, 0) AS problems_attempted,
        x.mean AS average_score, x.best AS highest_score, coalesce(x.n, 0) AS total_attempts
        FROM student JOIN users u USING (user_id) LEFT JOIN (SELECT student_id AS user_id,
        count(DISTINCT problem_id) AS problems, {mean('score')} AS mean, max(score) AS best, count(*) AS n
        FROM stayed GROUP BY student_id) x USING (user_id) WHERE status <> 'banned'""",
    "kept_statistics": f"""SELECT p.problem_id, title, difficulty, topics, coalesce(x.students, 0) AS students_attempted,
        x.mean AS average_score, coalesce(x.n, 0) * greatest(coalesce(labels, 0), 1) AS total_attempts,
        u.name AS created_by_mentor FROM problem p JOIN users u USING (user_id)
        LEFT JOIN topic_lines USING (problem_id) LEFT JOIN (SELECT problem_id,
        count(DISTINCT student_id) AS students, {mean('score')} AS mean, count(*) AS n
        FROM stayed GROUP BY problem_id) x USING (problem_id) WHERE status <> 'banned'""",
    "kept_activity": f"""SELECT user_id, name AS mentor_name,
        (SELECT count(*) FROM problem p WHERE p.user_id = u.user_id) AS problems_created,
        (SELECT count(*) FROM resource r WHERE r.user_id = u.user_id) AS resources_uploaded,
        coalesce(x.students, 0) AS students_mentored, x.mean AS avg_student_score
        FROM users u SEMI JOIN mentor USING (user_id) LEFT JOIN (SELECT mentor_id AS user_id,
        count(DISTINCT student_id) AS students, {mean('score')} AS mean FROM stayed GROUP BY mentor_id) x
        USING (user_id) WHERE status <> 'banned'""",
}


def left_of(gone: str) -> dict[str, str]:
    """What a cascade leaves of each relation when the users `gone` go."""
    scenario = f"(SELECT scenario_no FROM scenario WHERE student_id NOT IN {gone})"
    problem = f"(SELECT problem_id FROM problem WHERE user_id NOT IN {gone})"
    resource = f"(SELECT resource_id FROM resource WHERE user_id NOT IN {gone})"
    return {
        "user": f"users WHERE user_id NOT IN {gone}",
        "student": f"student WHERE user_id NOT IN {gone}",
        "mentor": f"mentor WHERE user_id NOT IN {gone}",
        "admin": f"admin WHERE user_id NOT IN {gone}",
        "topic": "topic",
        "scenario": f"scenario WHERE student_id NOT IN {gone}",
        "problem": f"""(SELECT * REPLACE (CASE WHEN scenario_no IN {scenario} THEN scenario_no END AS scenario_no)
            FROM problem WHERE user_id NOT IN {gone})""",
        "attempt": f"""(SELECT * REPLACE (CASE WHEN mentor_id NOT IN {gone} THEN mentor_id END AS mentor_id)
            FROM attempt WHERE student_id NOT IN {gone} AND problem_id IN {problem})""",
        "resource": f"resource WHERE user_id NOT IN {gone}",
        "notification": "notification",
        "have_topic": f"have_topic WHERE problem_id IN {problem}",
        "resourcetopic": f"resourcetopic WHERE resource_id IN {resource}",
        "access": f"access WHERE student_id NOT IN {gone} AND resource_id IN {resource}",
        "send": f"send WHERE sender_id NOT IN {gone}",
        "receive": f"receive WHERE receiver_id NOT IN {gone}",
    }


# The columns of each relation that a digest covers.
TOLD = {
    "user": "user_id name email status", "student": "user_id", "mentor": "user_id", "admin": "user_id",
    "topic": "topic_name", "scenario": "scenario_no student_id scenario_description",
    "problem": "problem_id user_id correct_answer create_time title difficulty scenario_no",
    "attempt": "student_id problem_id attempt_no mentor_id score submit_time feedback",
    "resource": "resource_id user_id title res_type uploaded_time resource_url",
    "notification": "noti_id send_time", "have_topic": "problem_id topic_name",
    "resourcetopic": "resource_id topic_name", "access": "resource_id student_id access_time",
    "send": "sender_id noti_id", "receive": "receiver_id noti_id",
}


def digests(left: dict[str, str]) -> str:
    def shown(column: str) -> str:
        text = f"strftime({column}, '%Y-%m-%d %H:%M:%S')" if column.endswith("_time") else f"CAST({column} AS VARCHAR)"
        return f"coalesce({text}, '-')"

    parts = []
    for name, source in left.items():
        row = f"concat_ws('|', {', '.join(map(shown, TOLD[name].split()))})"
        parts.append(
            f"SELECT '{name}' AS relation, count(*) AS n_rows, "
            f"CAST(sum(CAST('0x' || substr(md5({row}), 1, 12) AS UBIGINT)) AS VARCHAR) AS digest FROM {source}"
        )
    return " UNION ALL ".join(parts)


WHOLE = {name: "users" if name == "user" else name for name in TOLD}
EDITS = """SELECT user_id, 'Learner ' || user_id AS new_name, CASE user_id % 3
    WHEN 0 THEN 'pair' || CAST(floor(user_id / 2) AS BIGINT) || '@example.com'
    WHEN 1 THEN 'supplier.000000001@example.com' END AS new_email,
    CASE WHEN user_id % 2 = 0 THEN 'banned' END AS new_status FROM student"""
JUDGED = f"""SELECT e.*, CASE WHEN e.user_id % 5 = 0 THEN 'password not hashed' WHEN EXISTS (SELECT 1 FROM users u WHERE u.email = e.new_email
    AND u.user_id <> e.user_id) OR e.user_id <> min(e.user_id) FILTER (e.user_id % 5 <> 0) OVER (PARTITION BY coalesce(e.new_email,
    CAST(e.user_id AS VARCHAR))) THEN 'email in use' ELSE 'changed' END AS outcome FROM ({EDITS}) e"""

REQUESTS = """SELECT doc_id AS request_id, CASE WHEN source <> 'src0' THEN source ELSE '' END AS name,
    CASE WHEN source = 'src1' THEN 'supplier.000000001@example.com' ELSE lang || '-' || n_chars
    || '@example.com' END AS email, n_chars, CASE lang WHEN 'en' THEN 'student' WHEN 'fr' THEN 'mentor'
    WHEN 'de' THEN 'admin' END AS role FROM documents"""
CREATED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY request_id) AS turn
    FROM ({REQUESTS}) WHERE name <> '' AND role IS NOT NULL AND n_chars % 7 <> 0 AND email NOT IN (SELECT email FROM users))
    WHERE turn = 1"""
CLEAR = rf"""(SELECT scenario_no FROM scenario WHERE length({strip('scenario_description')}) >= 10
    AND length(regexp_replace(scenario_description, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 3)"""
NEW_PROBLEMS = f"""SELECT *, (SELECT max(problem_id) FROM problem) + row_number() OVER (
    ORDER BY payload_id, position) AS problem_id FROM ({GENERATED}) WHERE scenario_no IN {CLEAR}"""

QUERIES: dict[str, str] = {
    "scan_relations": ROW_COUNTS,
    "load_snapshot": digests(WHOLE),
    "assign_identity": """SELECT doc_id, source, (SELECT max(problem_id) FROM problem)
        + row_number() OVER (ORDER BY doc_id) AS problem_id FROM documents""",
    "apply_defaults": f"""SELECT conv_id * 1000 + turn AS user_id, role || ' ' || turn AS name,
        conv_id || '-' || turn AS email, CAST(NULL AS VARCHAR) AS password,
        CASE WHEN role = 'system' THEN 'banned' ELSE 'active' END AS status, {NOW} AS created_at
        FROM conversations""",
    "register_views": """SELECT difficulty, count(*) AS problems, CAST(sum(total_attempts) AS BIGINT) AS topic_attempts,
        max(students_attempted) AS most_students FROM statistics GROUP BY difficulty""",
    "view_performance": """SELECT user_id, name, email, problems_attempted, average_score, highest_score,
        total_attempts FROM performance WHERE total_attempts > 0""",
    "view_activity": f"""SELECT user_id, name AS mentor_name,
        (SELECT count(*) FROM problem p WHERE p.user_id = u.user_id) AS problems_created,
        (SELECT count(*) FROM resource r WHERE r.user_id = u.user_id) AS resources_uploaded,
        (SELECT count(DISTINCT student_id) FROM attempt WHERE mentor_id = u.user_id) AS students_mentored,
        (SELECT {mean('score')} FROM attempt WHERE mentor_id = u.user_id) AS avg_student_score
        FROM users u WHERE user_id IN (SELECT user_id FROM problem)""",
    "result_as_strings": """SELECT CAST(student_id AS VARCHAR) AS student_id,
        CAST(problem_id AS VARCHAR) AS problem_id, CAST(attempt_no AS VARCHAR) AS attempt_no,
        coalesce(CAST(mentor_id AS VARCHAR), 'None') AS mentor_id, CAST(score AS VARCHAR) AS score,
        strftime(submit_time, '%Y-%m-%d %H:%M:%S') AS submit_time, coalesce(feedback, 'None') AS feedback,
        CAST(CAST(score AS DOUBLE) / 3 AS VARCHAR) AS third,
        CASE WHEN score >= 60 THEN 'True' ELSE 'False' END AS good FROM attempt""",
    "students_without_attempts": """SELECT user_id AS student_id, name, email FROM users
        WHERE user_id IN (SELECT user_id FROM student) AND user_id NOT IN (SELECT student_id FROM attempt)""",
    "problems_by_mentor": """SELECT p.problem_id, p.title, p.difficulty, u.name AS mentor_name FROM problem p
        JOIN users u USING (user_id) WHERE u.name = 'Supplier#000000001'""",
    "problem_count_by_difficulty": "SELECT DISTINCT difficulty, count(*) OVER (PARTITION BY difficulty) AS problem_count FROM problem",
    "top_students": f"""SELECT user_id AS student_id, name AS student_name, {half_up('total', 'scored')} AS avg_score,
        attempts AS total_attempts FROM tallies JOIN users USING (user_id) WHERE user_id IN (SELECT user_id FROM student)
        QUALIFY row_number() OVER (ORDER BY {half_up('total', 'scored')} DESC, attempts DESC, name, user_id) <= 5""",
    "best_score_per_problem": """SELECT problem_id, title AS problem_title, student_id, name AS student_name, score
        FROM (SELECT *, rank() OVER (PARTITION BY problem_id ORDER BY score DESC) AS place FROM mine)
        JOIN users ON users.user_id = student_id WHERE place = 1""",
    "first_attempt_failures": """SELECT problem_id, title AS problem_title, n AS failed_first_attempts,
        learners AS total_students, n / learners AS fail_ratio FROM problem JOIN (SELECT problem_id, count(*) AS n,
        (SELECT count(*) FROM student) AS learners FROM attempt WHERE attempt_no = 1 AND score < 60
        GROUP BY problem_id) USING (problem_id) WHERE n > 0.002::DOUBLE * learners""",
    "scenario_score_by_difficulty": f"""SELECT difficulty, {half_up('sum(score)', 'count(score)')} AS avg_score,
        count(*) AS attempt_count FROM mine WHERE problem_id IN (SELECT problem_id FROM problem WHERE scenario_no >= 0)
        GROUP BY difficulty""",
    "notification_counts": """SELECT user_id, name, email, (SELECT count(*) FROM receive
        WHERE receiver_id = user_id) AS notif_count FROM users""",
    "student_performance": """SELECT user_id, name, email, problems_attempted, average_score, highest_score,
        total_attempts FROM performance""",
    "problem_statistics": "SELECT * FROM statistics",
    "problem_statistics_clean": """SELECT s.* EXCLUDE (total_attempts), (SELECT count(*) FROM attempt a
        WHERE a.problem_id = s.problem_id) AS total_attempts FROM statistics s""",
    "mentor_activity": f"""SELECT user_id, name AS mentor_name,
        (SELECT count(*) FROM problem p WHERE p.user_id = u.user_id) AS problems_created,
        (SELECT count(*) FROM resource r WHERE r.user_id = u.user_id) AS resources_uploaded,
        (SELECT count(DISTINCT student_id) FROM attempt WHERE mentor_id = u.user_id) AS students_mentored,
        (SELECT {mean('score')} FROM attempt WHERE mentor_id = u.user_id) AS avg_student_score FROM users u WHERE user_id IN (SELECT user_id FROM mentor)""",
    "student_summary": f"""SELECT user_id AS student_id, name, email, problems_attempted,
        CASE WHEN scored > 0 THEN {half_even('total', 'greatest(scored, 1)', 1)} ELSE 0 END AS avg_score,
        highest_score, total_attempts FROM performance""",
    "recent_attempts": f"""SELECT student_id, place, problem_id, title, difficulty, attempt_no, score, submit_time
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY student_id ORDER BY {NEWEST}) AS INTEGER) AS place FROM mine)
        WHERE place <= 10""",
    "recommend_problems": """SELECT student_id, choice, problem_id, title, difficulty FROM (
        SELECT s.user_id AS student_id, p.problem_id, p.title, p.difficulty, CAST(row_number() OVER (
        PARTITION BY s.user_id ORDER BY p.difficulty, p.problem_id) AS INTEGER) AS choice FROM student s, problem p
        WHERE p.difficulty IN ('Easy', 'Medium') AND NOT EXISTS (SELECT 1 FROM attempt a
        WHERE a.student_id = s.user_id AND a.problem_id = p.problem_id)) WHERE choice <= 5""",
    "problems_passed": """SELECT student_id, count(DISTINCT problem_id) AS problems_passed FROM attempt
        WHERE score = 100 GROUP BY student_id""",
    "browse_problems": BROWSE,
    "browse_problems_filtered": BROWSE + """ WHERE p.difficulty = 'Easy' AND p.scenario_no IS NULL
        AND p.problem_id IN (SELECT problem_id FROM have_topic WHERE contains(lower(topic_name), 'small'))
        AND p.problem_id NOT IN (SELECT problem_id FROM attempt WHERE student_id = 7)""",
    "browse_problems_attempted": BROWSE
    + " WHERE p.problem_id IN (SELECT problem_id FROM attempt WHERE student_id = 7)",
    "topic_list": "SELECT topic_name, '' AS description FROM topic",
    "problem_attempts": """SELECT student_id, problem_id, attempt_no, score, submit_time, feedback FROM attempt""",
    "latest_score": """SELECT student_id, problem_id, attempts, score AS latest_score FROM (SELECT *,
        count(*) OVER (PARTITION BY student_id, problem_id) AS attempts, CAST(row_number() OVER (
        PARTITION BY student_id, problem_id ORDER BY submit_time DESC, attempt_no DESC, score DESC) AS INTEGER) AS place
        FROM attempt) WHERE place = 1""",
    "my_attempts": f"SELECT {MY}",
    "my_attempts_filtered": f"SELECT {MY} WHERE {IN_RANGE} AND coalesce(feedback, '') = ''",
    "my_attempts_local_dates": f"""SELECT {MY} WHERE feedback <> ''
        AND CAST(submit_time - CASE WHEN summer THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS DATE)
        BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
    "my_attempt_stats": f"SELECT {STATS} FROM mine GROUP BY student_id",
    "my_attempt_stats_filtered": f"""SELECT {STATS} FROM mine WHERE {IN_RANGE} AND feedback <> ''
        GROUP BY student_id""",
    "attempt_outcomes": """SELECT student_id, problem_id, attempt_no, score, submit_time, 'Failed' AS status
        FROM attempt WHERE score < 60""",
    "outcome_counts": f"""SELECT student_id, count(*) AS total_attempts, count(*) FILTER (score >= 60) AS passed_count,
        count(*) FILTER (score < 60) AS failed_count, {mean('score')} AS avg_score FROM attempt
        GROUP BY student_id""",
    "scenario_list": """SELECT student_id, row_number() OVER (PARTITION BY student_id
        ORDER BY created_at DESC, scenario_no DESC) AS display_index, scenario_no, created_at,
        scenario_description FROM scenario""",
    "scenario_rank": """SELECT scenario_no, student_id, display_index, p.problem_id, p.title, p.difficulty FROM (
        SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY created_at, scenario_no) AS display_index
        FROM scenario) LEFT JOIN problem p USING (scenario_no)""",
    "mentor_summary": f"""SELECT user_id, name AS mentor_name,
        (SELECT count(*) FROM problem p WHERE p.user_id = u.user_id) AS problems_created,
        (SELECT count(*) FROM resource r WHERE r.user_id = u.user_id) AS resources_uploaded,
        (SELECT count(DISTINCT student_id) FROM attempt WHERE mentor_id = u.user_id) AS students_mentored,
        coalesce((SELECT {mean('score')} FROM attempt WHERE mentor_id = u.user_id), 0) AS avg_student_score FROM users u WHERE user_id IN (SELECT user_id FROM mentor)""",
    "pending_reviews": PENDING.format("feedback IS NULL"),
    "pending_reviews_blank": PENDING.format("coalesce(feedback, '') = ''"),
    "recent_problems": """SELECT mentor_id, place, problem_id, title, difficulty, create_time FROM (SELECT *,
        user_id AS mentor_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY create_time DESC,
        problem_id DESC) AS INTEGER) AS place FROM problem) WHERE place <= 5""",
    "feedback_given": """SELECT author_id AS mentor_id, count(*) AS feedback_given FROM mine
        WHERE feedback IS NOT NULL AND feedback <> '' GROUP BY author_id""",
    "my_problems": MY_PROBLEMS.format("true", ""),
    "my_problems_filtered": MY_PROBLEMS.format(
        "p.difficulty = 'Easy' AND CAST(p.create_time AS DATE) BETWEEN DATE '2024-02-01' AND DATE '2024-10-31' "
        "AND p.problem_id IN (SELECT problem_id FROM have_topic WHERE contains(lower(topic_name), 'small'))",
        "HAVING count(a.problem_id) BETWEEN 20 AND 35",
    ),
    "problem_analytics": f"""SELECT p.problem_id, p.title, count(a.problem_id) AS total_attempts,
        coalesce({half_even('sum(a.score)', 'count(a.score)')}, 0) AS avg_score,
        count(*) FILTER (a.score >= 90) AS high_scores,
        count(*) FILTER (a.score >= 60 AND a.score < 90) AS medium_scores,
        count(*) FILTER (a.score < 60) AS low_scores
        FROM problem p LEFT JOIN attempt a USING (problem_id) GROUP BY p.problem_id, p.title""",
    "recent_attempts_of_problem": """SELECT problem_id, place, student_id, u.name AS student_name, attempt_no, score,
        submit_time FROM (SELECT *, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY submit_time DESC,
        student_id, attempt_no DESC, score DESC) AS INTEGER) AS place FROM attempt) JOIN users u ON u.user_id = student_id
        WHERE place <= 10""",
    "review_attempts": REVIEW,
    "review_attempts_filtered": REVIEW + " WHERE feedback <> '' AND score BETWEEN 50 AND 90",
    "my_resources": """SELECT r.user_id AS mentor_id, r.resource_id, r.title, r.res_type, r.uploaded_time,
        count(a.student_id) AS access_count, count(DISTINCT a.student_id) AS unique_students,
        any_value(x.topic_name) AS topics FROM resource r JOIN resourcetopic x USING (resource_id)
        LEFT JOIN access a USING (resource_id) GROUP BY ALL""",
    "resource_analytics": """SELECT a.resource_id, a.access_time, a.student_id, u.name AS student_name FROM access a
        JOIN student s ON s.user_id = a.student_id JOIN users u ON u.user_id = s.user_id""",
    "resource_totals": """SELECT resource_id, count(*) AS total_accesses, count(DISTINCT student_id)
        AS unique_students FROM access GROUP BY resource_id""",
    "hardest_problems": f"""SELECT problem_id, p.title, {mean('a.score')} AS avg_score, count(*) AS attempts
        FROM attempt a JOIN problem p USING (problem_id) GROUP BY problem_id, p.title
        ORDER BY avg_score, problem_id LIMIT 5""",
    "repeat_failers": """SELECT student_id, u.name AS student_name, count(*) AS failures FROM attempt
        JOIN users u ON u.user_id = student_id WHERE score < 60 GROUP BY ALL HAVING count(*) > 3""",
    "topic_average": f"""SELECT {mean('score')} AS avg_score, count(score) AS scored_attempts FROM attempt
        WHERE problem_id IN (SELECT problem_id FROM have_topic WHERE contains(lower(topic_name), 'small'))""",
    "user_directory": DIRECTORY,
    "user_directory_filtered": f"""SELECT * FROM ({DIRECTORY}) WHERE role = 'student' AND status = 'banned'
        AND (contains(lower(username), 'customer#') OR contains(lower(email), 'customer#'))""",
    "user_totals": """SELECT count(*) AS total_users, count(*) FILTER (status <> 'banned') AS active_users,
        count(*) FILTER (status = 'banned') AS banned_users, (SELECT count(*) FROM problem) AS total_problems
        FROM users""",
    "inbox": """SELECT r.receiver_id, n.noti_id, n.send_time, coalesce(u.name, 'System') AS sender_name,
        s.sender_id FROM notification n JOIN receive r USING (noti_id) LEFT JOIN send s USING (noti_id)
        LEFT JOIN users u ON u.user_id = s.sender_id""",
    "notification_receivers": """SELECT r.noti_id, u.user_id, u.name, u.email,
        count(*) OVER (PARTITION BY r.noti_id) AS receiver_count FROM receive r
        JOIN users u ON u.user_id = r.receiver_id""",
    "audience": ROLE_SETS,
    "deliver": f"""SELECT r.receiver_id, r.noti_id FROM receive r WHERE r.noti_id NOT IN (SELECT noti_id FROM send)
        UNION ALL SELECT user_id, (SELECT max(noti_id) FROM notification) + length(rule) FROM ({ROLE_SETS})""",
    "send_notification": f"""SELECT (SELECT max(noti_id) FROM notification) + 1 AS noti_id, user_id AS receiver_id,
        {ADMINS} AS sender_id, {NOW} AS send_time FROM mentor""",
    "normalize_sql_text": "SELECT text_id, n AS normal FROM normals",
    "split_clauses": "SELECT text_id, s AS select_part, f AS from_part, w AS where_part FROM clauses",
    "extract_tables": f"""SELECT text_id, CASE WHEN f = '' THEN '' WHEN len({NAMED}) > 0 THEN {listed(NAMED)}
        ELSE {listed(FIRST_WORDS)} END AS found FROM clauses""",
    "extract_columns": f"""SELECT text_id, {listed(f"list_transform({pieces('s', ',')}, lambda x: {COLUMN})")}
        AS found FROM clauses""",
    "extract_conditions": f"""SELECT text_id, {listed(f"list_filter(list_transform({pieces('w', ' and ')}, lambda x: {UNWRAPPED}), lambda x: x <> '')")}
        AS found FROM clauses""",
    "set_f1": """SELECT problem_id, 2.0::DOUBLE * (CAST(hits AS DOUBLE) / given) * (CAST(hits AS DOUBLE) / wanted)
        / (CAST(hits AS DOUBLE) / given + CAST(hits AS DOUBLE) / wanted) AS f1 FROM (
        SELECT problem_id, count(*) AS wanted, count(*) FILTER (list_contains(string_split(title, ' '), topic_name))
        AS hits, any_value(len(list_distinct(string_split(title, ' ')))) AS given
        FROM have_topic JOIN problem USING (problem_id) GROUP BY problem_id)""",
    "score_submissions": f"""SELECT student_id, problem_id, line_no, CAST({SCORE} AS DOUBLE) AS score,
        line_no % 4 = 0 AS is_equal, true AS from_ok, line_no % 4 IN (0, 2) AS select_ok,
        line_no % 4 = 0 AS where_ok, 40.0::DOUBLE AS from_points, {shape('30', '20', '30', '0')} AS select_points,
        {shape('30', '0', f'CASE WHEN {HIT} THEN 20 ELSE 0 END', '0')} AS where_points, 1.0::DOUBLE AS from_f1,
        {shape('1', '0.667', '1', '0')} AS select_f1,
        {shape('1', '0', f'CASE WHEN {HIT} THEN 0.667 ELSE 0 END', '0')} AS where_f1 FROM submissions""",
    "feedback_rule": TAGGED.format(f"CASE WHEN {NO_TEXT} THEN 'feedback required' ELSE 'valid' END", "reason"),
    "score_range_rule": TAGGED.format(f"CASE WHEN {OUTSIDE} THEN 'score out of range' ELSE 'valid' END", "reason"),
    "key_uniqueness": KEYS,
    "vocabulary_rule": """SELECT 'resource' AS relation, 'res_type' AS "column", res_type AS value, count(*) AS n_rows
        FROM uploads WHERE res_type = 'Other' GROUP BY res_type
        UNION ALL SELECT 'problem', 'difficulty', lang, count(*) FROM documents GROUP BY lang
        UNION ALL SELECT 'problem', 'difficulty', 'hard', count(*) FROM documents""",
    "orphan_check": " UNION ALL ".join(edge_sql(*edge) for edge in EDGES),
    "delta_keys": DELTA_KEYS,
    "delta_orphans": " UNION ALL ".join(delta_edge(*edge) for edge in DELTA_EDGES),
    "required_and_length": VIOLATIONS,
    "read_only_gate": gate(WRITE_WORDS),
    "read_only_gate_word": gate(rf"\b({WRITE_WORDS})\b"),
    "meaningful_text": rf"""SELECT scenario_no, length({strip('scenario_description')}) >= 10
        AND length(regexp_replace(scenario_description, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 3 AS meaningful
        FROM scenario""",
    "parse_generated": GENERATED,
    "parse_generated_topics": GENERATED_TOPICS,
    "parse_generated_refused": "SELECT bad AS payload_id, scenario_no FROM payloads",
    "parse_answer": f"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE 'SELECT ' || role END AS sql,
        CASE WHEN role = 'system' THEN '' ELSE {strip('text')} END AS explanation FROM conversations""",
    "append_attempts": f"""SELECT student_id, problem_id, attempt_no, mentor_id, score, submit_time, feedback FROM attempt
        UNION ALL ({NUMBERED.format("s.line_no * 10")})""",
    "submit_attempts": NUMBERED.format(f"({SCORE})"),
    "take_submissions": f"""SELECT student_id, count(*) AS attempts, CAST(sum(score) AS DECIMAL(20,2)) AS points,
        CAST(sum(attempt_no) AS BIGINT) AS numbers,
        CAST(sum(told) AS BIGINT) + (SELECT count(*) FROM receive r WHERE r.receiver_id = e.student_id) AS notices,
        (SELECT count(*) FROM submissions s WHERE s.student_id = e.student_id AND line_no = 5) AS blank,
        (SELECT count(*) FROM submissions s WHERE s.student_id = e.student_id AND line_no = 6) AS unknown
        FROM (SELECT student_id, attempt_no, score, 0 AS told FROM attempt UNION ALL
        SELECT student_id, attempt_no, score, CAST(score >= 90 AS INT) FROM ({NUMBERED.format(f"({SCORE})").replace(
            "FROM submissions s", "FROM (SELECT * FROM submissions WHERE line_no NOT IN (5, 6)) s")})) e
        GROUP BY student_id""",
    "apply_feedback": f"""SELECT a.student_id, a.problem_id, a.attempt_no,
        coalesce(CAST(string_split(r.last, '|')[2] AS BIGINT), a.mentor_id) AS mentor_id, a.score,
        a.submit_time, coalesce(r.text, a.feedback) AS feedback
        FROM attempt a LEFT JOIN ({REVIEWS}) r USING (student_id, problem_id, attempt_no)""",
    "upsert_topics": """SELECT CAST(NULL AS BIGINT) AS problem_id, topic_name FROM (SELECT topic_name FROM topic
        UNION SELECT p_brand FROM part) UNION ALL SELECT problem_id, topic_name FROM (SELECT problem_id, topic_name
        FROM have_topic UNION SELECT p_partkey, p_brand FROM part)""",
    "guarded_delete_problem": DELETE_OUTCOME,
    "guarded_delete_problem_left": f"""SELECT o.problem_id, h.topic_name FROM ({DELETE_OUTCOME}) o
        LEFT JOIN have_topic h ON h.problem_id = o.problem_id WHERE o.outcome <> 'deleted'""",
    "guarded_delete_scenario": SCENARIO_OUTCOME,
    "guarded_delete_scenario_left": f"""SELECT 'scenario' AS relation, scenario_no AS id FROM ({SCENARIO_OUTCOME})
        WHERE outcome = 'refused' UNION ALL SELECT 'problem', problem_id FROM drafted p
        LEFT JOIN ({SCENARIO_OUTCOME}) o USING (scenario_no) WHERE o.outcome IS NULL OR o.outcome = 'refused'""",
    **KEPT,
    "cascade_delete_user": digests(left_of(DELETABLE)),
    "cascade_delete_attempts": f"""SELECT student_id, count(*) AS n_rows, count(mentor_id) AS marked
        FROM {left_of(DELETABLE)["attempt"]} GROUP BY student_id""",
    "deletable_users": f"SELECT user_id FROM {DELETABLE}",
    "cascade_delete_all": digests(left_of(BANNED)),
    "dismiss_notification": "SELECT receiver_id, noti_id FROM receive WHERE noti_id NOT IN (SELECT noti_id FROM send)",
    "set_status": """SELECT user_id, CASE WHEN user_id IN (SELECT receiver_id FROM receive WHERE noti_id IN (
        SELECT noti_id FROM send)) THEN 'banned' ELSE 'active' END AS status FROM users""",
    "edit_outcomes": f"""SELECT user_id, outcome FROM ({JUDGED})
        UNION ALL SELECT user_id, 'superseded' FROM student WHERE user_id % 2 = 0""",
    "edit_users": f"""SELECT u.user_id, CASE WHEN outcome = 'changed' THEN new_name ELSE name END AS name,
        CASE WHEN outcome = 'changed' THEN coalesce(new_email, email) ELSE email END AS email,
        CASE WHEN outcome = 'changed' THEN coalesce(new_status, status) ELSE status END AS status
        FROM users u LEFT JOIN ({JUDGED}) j ON j.user_id = u.user_id""",
    "problem_edit_outcomes": f"""SELECT CASE WHEN difficulty = 'Hard' THEN {MENTORS} - 1 ELSE user_id END AS mentor_id,
        problem_id, sent_at, CASE WHEN difficulty = 'Hard' THEN 'not found'
        WHEN sent_at = 2 AND problem_id % 3 = 0 THEN 'missing field'
        WHEN sent_at = 1 AND problem_id % 3 <> 0 THEN 'superseded' ELSE 'changed' END AS outcome
        FROM problem, (SELECT CAST(unnest([1, 2]) AS INT) AS sent_at)""",
    "edit_problems": """SELECT problem_id, CASE WHEN difficulty = 'Hard' THEN title WHEN problem_id % 3 = 0
        THEN 'Edit 1' ELSE 'Edit 2' END AS title, CASE WHEN difficulty = 'Hard' THEN correct_answer
        ELSE 'SELECT 2' END AS correct_answer, CASE WHEN difficulty = 'Hard' THEN 'Hard' WHEN problem_id % 2 = 0
        THEN 'Medium' ELSE 'Easy' END AS difficulty, CASE WHEN difficulty = 'Hard' THEN description ELSE 'changed' END AS description
        FROM problem""",
    "register_users": f"""SELECT user_id, username AS name, email, role, status FROM ({DIRECTORY})
        UNION ALL SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY request_id), name, email,
        role, 'active' FROM ({CREATED})""",
    "add_generated": f"""SELECT problem_id, user_id, scenario_no, title, difficulty, correct_answer FROM problem
        UNION ALL SELECT problem_id, {MENTORS}, scenario_no, title, difficulty, correct_answer
        FROM ({NEW_PROBLEMS})""",
    "add_generated_topics": f"""SELECT problem_id, topic_name FROM have_topic
        UNION ALL SELECT n.problem_id, x.topic_name FROM ({NEW_PROBLEMS}) n JOIN ({GENERATED_TOPICS}) x
        USING (payload_id, position)""",
    "read_only_query": """SELECT p.difficulty, CAST(count(*) AS VARCHAR) AS attempts, CAST(max(a.score) AS VARCHAR)
        AS best, min(a.feedback) AS note FROM attempt a JOIN problem p USING (problem_id) GROUP BY p.difficulty""",
    "high_score_alerts": "SELECT noti_id, receiver_id, send_time FROM alerts",
    "stream_high_score_alerts": "SELECT noti_id, receiver_id, send_time FROM alerts",
    "running_problem_counts": "SELECT user_id, count(*) AS problems_created FROM problem GROUP BY user_id",
    "stream_problem_counts": "SELECT user_id, count(*) AS problems_created FROM problem GROUP BY user_id",
    "stream_quality_gate": TAGGED.format(
        f"CASE WHEN {NO_TEXT} THEN 'feedback required' WHEN {OUTSIDE} THEN 'score out of range' ELSE 'valid' END",
        "outcome",
    ),
    "stream_attempt_numbering": """SELECT student_id, problem_id, score, submit_time, CAST(last_no + row_number() OVER (
        PARTITION BY student_id, problem_id ORDER BY submit_time, score) AS INTEGER) AS attempt_no
        FROM attempt JOIN (SELECT student_id, problem_id, max(attempt_no) AS last_no FROM attempt
        GROUP BY ALL) USING (student_id, problem_id)""",
    "score_labels": """SELECT CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good'
        WHEN score >= 60 THEN 'pass' ELSE 'fail' END AS band, CASE WHEN score = 100 THEN 'success'
        WHEN score >= 70 THEN 'warning' ELSE 'danger' END AS tier,
        strftime(submit_time, '%b. %d, %Y') AS shown, count(*) AS n_rows FROM attempt GROUP BY ALL""",
    "short_texts": f"""SELECT scenario_no, array_to_string(words[1:30], ' ')
        || CASE WHEN len(words) > 30 THEN ' …' ELSE '' END AS preview, substr(scenario_description, 1, 50) AS start
        FROM (SELECT *, regexp_split_to_array({strip('scenario_description')}, '[{W}]+') AS words FROM scenario)""",
}

# Summer time of the zone: from the second Sunday of March (first Sunday of April
# before 2007) to the first Sunday of November (last of October), at 10:00 and 9:00 UTC.
SUMMER = """(submit_time >= make_timestamp(year(submit_time), 4, 1, 10, 0, 0)
    + to_days(CAST((7 - dayofweek(make_date(year(submit_time), 4, 1))) % 7 AS INT))
    AND submit_time < make_timestamp(year(submit_time), 10, 31, 9, 0, 0)
    - to_days(CAST(dayofweek(make_date(year(submit_time), 10, 31)) AS INT)))"""
QUERIES["my_attempts_local_dates"] = QUERIES["my_attempts_local_dates"].replace("summer", SUMMER)

ORACLE = {key: with_relations(sql) for key, sql in QUERIES.items()}
