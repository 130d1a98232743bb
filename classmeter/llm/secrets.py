"""Secret scans: candidates by a pattern, false positives removed by a random forest.

A candidate is a long run of the characters that keys and tokens are made of,
with a digit in it, or whatever a credential's name is given: the value after
the name and = or :, of any length and characters. The forest looks at its length, its character classes and
the changes between them, how much of it words of the corpus cover, the path
of the document, and the neighbouring words. It learns from labelled findings.

All steps are DataFrame, SQL and Spark ML functions in the JVM. Candidates are
cut out of a text where it lies; what is shuffled is the word counts,
pre-aggregated, and at most `max_rows` labelled findings of each label.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from classmeter.llm.common import held_out, saved

# Labelled findings of each label that a forest is fitted on, at most; words in the dictionary.
MAX_ROWS, DICTIONARY = 20_000, 400
# Characters on either side that neighbouring words are taken from.
BESIDE = 60
# Characters that a match and what lies before it have together, at least.
AWAY = 4
CANDIDATE = r"[A-Za-z0-9+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*"
LEAST = 12
_RUN = r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST
# Names under which credentials are kept, for labelling.
NAMES = "token|secret|password|passwd|pwd|apikey|api_key|key|auth|credential"
# A name, and what stands between it and its value.
_SIGN = r"[\"'`]?\s{0,16}[=:]{1,2}>?\s{0,16}"
_NAMED = rf"(?i:{NAMES}){_SIGN}"
# In quotes up to the closing one, escaped quotes skipped; else up to a blank, a quote that
# closes, or the next name and sign. Possessive throughout, so that long values need no stack.
_IN_QUOTES = "|".join(rf"(?<={q})(?=\s*[^\s{q}])(?:[^{q}\\\r\n]++|\\.)++(?={q})" for q in "\"'`")
_BARE = r"(?![\s\"'`])(?:[^\s\"'`&;,]++|[\"'`](?![\s,;&:}\])]|$)|[&;,](?!\s|$|[\"'`]?[A-Za-z0-9_.-]{1,64}[\"'`]?[=:]))++"
_GIVEN = rf"(?<=[=:>\s\"'`])(?<=[=:]>?\s{{0,16}}[\"'`]{{0,3}})(?<={_NAMED}[\"'`]{{0,3}})(?!(?<=[=:])[=:>])(?:{_IN_QUOTES}|{_BARE})"

NUMBERS = ("length", "digits", "lower", "upper", "signs", "dots", "changes", "different", "covered", "hex", "quoted", "assigned", "path_length", "path_digits")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, start (from 1, in characters), secret, left and right for each candidate.

    `left` and `right` are the BESIDE characters beside it, or all up to the
    text's border. A run that begins with a name and = gives what follows them.
    Null and empty texts have none; repeated rows have theirs each. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(f"{_RUN}|{_NAMED}"))
    rows = _placed(_placed(rows, "runs", _RUN), "given", _GIVEN).drop("text")
    runs = F.transform(F.filter("runs", lambda c: c["secret"].rlike("[0-9]")), _without_name)
    # In order of place, the longer first: a run that is the beginning of a value, or all of it, is no second candidate.
    placed = F.transform(F.concat(runs, "given"), lambda c: F.struct(c["start"].alias("start"), (-F.char_length(c["secret"])).alias("less"), c.alias("c")))
    rows = rows.select("doc_id", "path", F.array_sort(placed).alias("placed"))
    first = F.filter("placed", lambda c, i: (i == 0) | (F.get("placed", i - 1)["start"] != c["start"]))
    return rows.select("doc_id", "path", F.explode(first).alias("c")).select("doc_id", "path", "c.c.*")


def _placed(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """`rows` with an array of start, secret, left and right for each match of `pattern` in `text`.

    A match and what lies before it have AWAY characters or more together, so
    that BESIDE characters reach over BESIDE / AWAY matches at most.
    """
    rows = rows.withColumns({"found": F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "between": F.split("text", pattern, -1)})
    lengths = F.transform("found", lambda r, i: F.char_length(r) + F.char_length(F.get("between", i)))
    at = F.aggregate(
        lengths,
        F.array(F.lit(0)),
        lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )
    # What lies between, and the matches, in turn.
    parts = F.flatten(F.transform("between", lambda x, i: F.array(x, F.coalesce(F.get("found", i), F.lit("")))))
    rows = rows.withColumns({"ends": at, "parts": parts})
    rows = rows.withColumns(
        {
            "tails": F.transform("parts", lambda x: F.right(x, F.lit(BESIDE))),
            "heads": F.transform("parts", lambda x: F.left(x, F.lit(BESIDE))),
        }
    )
    reach = 2 * (BESIDE // AWAY + 1)
    each = F.transform(
        "found",
        lambda r, i: F.struct(
            (F.get("ends", i) + F.char_length(F.get("between", i)) + 1).alias("start"),
            r.alias("secret"),
            F.right(F.array_join(F.slice("tails", F.greatest(2 * i + 2 - reach, F.lit(1)), F.least(2 * i + 1, F.lit(reach))), ""), F.lit(BESIDE)).alias("left"),
            F.left(F.array_join(F.slice("heads", 2 * i + 3, reach), ""), F.lit(BESIDE)).alias("right"),
        ),
    )
    return rows.withColumn(name, each).drop("found", "between", "ends", "parts", "tails", "heads")


def _without_name(c: Column) -> Column:
    """A run without the name and the = that it begins with; they are on its left then."""
    name = F.regexp_extract(c["secret"], r"^[^=]*=+(?=[^=])", 0)
    return F.struct(
        (c["start"] + F.char_length(name)).alias("start"),
        F.substr(c["secret"], F.char_length(name) + 1).alias("secret"),
        F.right(F.concat(c["left"], name), F.lit(BESIDE)).alias("left"),
        c["right"].alias("right"),
    )


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY) -> list[str]:
    """The words of three letters or more that most occur, over all documents; ties by code point."""
    each = docs.select(F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("word")).where(F.char_length("word") >= 3)
    top = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return sorted(r.word for r in top.collect())


def _share(text: Column, characters: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{characters}]", "")) / F.char_length(text)


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """`found` with NUMBERS, and the tokens of path and neighbouring words in `beside`."""
    secret = F.col("secret")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(secret, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.char_length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    known = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "$^"
    path = F.coalesce("path", F.lit(""))
    before = F.filter(F.split(F.lower("left"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    after = F.filter(F.split(F.lower("right"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")

    def tag(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(name), v))

    return found.withColumns(
        {
            "length": F.char_length(secret).cast("double"),
            "digits": _share(secret, "0-9"),
            "lower": _share(secret, "a-z"),
            "upper": _share(secret, "A-Z"),
            "signs": _share(secret, "+/_=-"),
            "dots": _share(secret, "."),
            "changes": (runs - 1) / F.char_length(secret),
            "different": F.size(F.array_distinct(F.split(secret, ""))) / F.char_length(secret),
            "covered": 1 - F.char_length(F.regexp_replace(F.lower(secret), known, "")) / F.char_length(secret),
            "hex": _share(secret, "0-9a-fA-F"),
            "quoted": (F.col("left").rlike("[\"'`]$") & F.col("right").rlike("^[\"'`]")).cast("double"),
            "assigned": F.col("left").rlike("[=:]\\s*[\"'`]?$").cast("double"),
            "path_length": F.char_length(path).cast("double"),
            "path_digits": F.char_length(F.regexp_replace(path, "[^0-9]", "")).cast("double"),
            "beside": F.concat(
                tag("path:", F.split(path, "[^A-Za-z]+")),
                tag("before:", F.slice(F.reverse(before), 1, 2)),
                tag("after:", F.slice(after, 1, 2)),
            ),
        }
    )


def labelled(found: DataFrame) -> DataFrame:
    """`found` with a label where it is beyond doubt: 1 for what is assigned to a credential's
    name in quotes, 0 for plain numbers, numbered names and addresses that no such name is given; others have none."""
    left, secret = F.col("left"), F.col("secret")
    named = F.lower(left).rlike(rf"({NAMES})[\"']?\s*[=:]\s*[\"'`]$")
    plain = secret.rlike(r"^[0-9+/_.=-]+$") | secret.rlike(r"^[A-Za-z]+[0-9]{0,4}([.-][A-Za-z0-9]+)*\.(com|net|org)\.?$")
    return found.withColumn("label", F.when(named, 1.0).when(plain & ~left.rlike(rf"{_NAMED}[\"'`]{{0,3}}$"), 0.0))


def train(examples: DataFrame, max_rows: int = MAX_ROWS, trees: int = 40, depth: int = 6, seed: int = 7) -> PipelineModel | None:
    """A forest from features with a label (0.0 or 1.0; others are left out); None without both labels.

    At most `max_rows` of each label are learned from, the first in the order
    of a hash, so a rare label is there at every size. Each counts for as many
    as were there of its label, so the draw does not shift their shares.
    """
    counts = examples.where(F.col("label").isin(0.0, 1.0)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    there = {r.label: r.n for r in counts.collect()}  # two rows at most
    if len(there) < 2:
        return None
    order = (F.xxhash64("doc_id", "start", "secret"), "doc_id", "start", "secret", "left", "right")
    drawn = [
        examples.where(F.col("label") == label).orderBy(*order).limit(max_rows).withColumn("weight", F.lit(max(1.0, n / max_rows)))
        for label, n in sorted(there.items())
    ]
    rows = saved(drawn[0].unionByName(drawn[1]), "secret-examples")
    stages = [
        HashingTF(inputCol="beside", outputCol="beside_hashed", numFeatures=128, binary=True),
        VectorAssembler(inputCols=[*NUMBERS, "beside_hashed"], outputCol="x"),
        RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird"),
    ]
    return Pipeline(stages=stages).fit(rows)


def scan(docs: DataFrame, examples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, start, length, secret, left, label, score and predicted for every candidate of `docs`.

    `examples` are labelled features (see `features`); by default the ones of
    `docs` outside the held-out fold that `labelled` is sure of. Without both
    labels among them there is no forest, and every candidate scores 0.5 and is
    reported.
    """
    found = labelled(features(findings(docs, id_col, text_col, path_col), dictionary(docs, text_col)))
    found = saved(found, "secret-findings")
    model = train(found.where(~held_out(F.col("doc_id"))) if examples is None else examples)
    scored = found.withColumn("score", F.lit(0.5))
    if model is not None:
        scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        F.col("doc_id").alias(id_col), "start", F.col("length").cast("int").alias("length"), "secret", "left", F.col("label").cast("int").alias("label"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
