"""The relations as lazy DataFrames: reading, writing, defaults, views, text form."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from classmeter.functions.numbering import number_within
from classmeter.sources.commits import CommitLog
from classmeter.sources.schemas import DEFAULTS, SCHEMAS


class Tables:
    """Relations by name; each frame is declared on first use and then reused."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._builders:
                raise AttributeError(f"no relation {name!r}")
            self._frames[name] = self._builders[name]()
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __contains__(self, name: str) -> bool:
        return name in self._builders

    def replace(self, **frames: DataFrame) -> "Tables":
        """The same relations with some of them exchanged."""
        builders = {name: (lambda name=name: self[name]) for name in self}
        builders.update({name: (lambda frame=frame: frame) for name, frame in frames.items()})
        return Tables(builders)


def typed(df: DataFrame, relation: str) -> DataFrame:
    """The declared columns of a relation, cast to the declared types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[relation]))


def _versions(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, f"{path}/_versions")


def load(spark: SparkSession, path: str, version: int | None = None) -> Tables:
    """Read a snapshot, by default the last one written whole, with the declared schemas.

    A folder without version records holds one parquet folder per relation.
    """
    log = _versions(spark, path)
    version = log.last() if version is None else version
    folders = {relation: relation for relation in SCHEMAS} if version is None else log.read(version)

    def reader(relation: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(SCHEMAS[relation]).parquet(f"{path}/{folders[relation]}")

    return Tables({relation: reader(relation) for relation in SCHEMAS})


def write_snapshot(t: Tables, path: str, changed: Collection[str] | None = None) -> int:
    """Write the next version of all relations, or of the `changed` ones, and return its number.

    Every relation goes to a folder of its own. The record that names all
    fifteen is written last, so a refresh that stops before is read as the
    version before it. Folders of older versions stay until `drop_versions`.
    """
    spark = t[next(iter(SCHEMAS))].sparkSession
    log = _versions(spark, path)
    last = log.last()
    version = 1 if last is None else last + 1
    folders = {} if last is None else log.read(last)
    for relation in SCHEMAS:
        if changed is None or relation in changed or relation not in folders:
            folders[relation] = f"{relation}/{version}-{uuid.uuid4().hex}"
            typed(t[relation], relation).write.parquet(f"{path}/{folders[relation]}")
    log.write(version, folders)
    return version


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the last `keep` versions, with the folders that only they name."""
    log = _versions(spark, path)
    numbers = log.numbers()
    cut = max(0, len(numbers) - max(1, keep))
    held = {folder for number in numbers[cut:] for folder in log.read(number).values()}
    for number in numbers[:cut]:
        gone = set(log.read(number).values()) - held
        log.forget(number)
        for folder in gone:
            log.remove_folder(f"{path}/{folder}")


def register(spark: SparkSession, t: Tables) -> list[str]:
    """Expose the relations and the three summary views under SQL names."""
    from classmeter.operators import reports

    frames = {relation: t[relation] for relation in SCHEMAS}
    # Names of the summary views.
    frames["studentperformancesummary"] = reports.student_performance(t)
    frames["problemstatistics"] = reports.problem_statistics(t)
    frames["mentoractivitydashboard"] = reports.mentor_activity(t)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return list(frames)


def with_defaults(df: DataFrame, relation: str, now: Column | None = None) -> DataFrame:
    """Declared columns in order; omitted or null ones get the relation's default."""
    now = F.current_timestamp() if now is None else now
    rules = DEFAULTS.get(relation, {})

    def value(field: T.StructField) -> Column:
        given = F.col(field.name) if field.name in df.columns else F.lit(None)
        given = given.cast(field.dataType)
        if field.name not in rules:
            return given
        rule = rules[field.name]
        fill = now if rule in ("now", "today") else F.lit(rule)
        return F.coalesce(given, fill.cast(field.dataType))

    return df.select(*(value(f).alias(f.name) for f in SCHEMAS[relation]))


def assign_ids(
    new: DataFrame,
    existing: DataFrame,
    key: str,
    order_by: list[str | Column],
) -> DataFrame:
    """Give new rows serial keys after the largest existing one.

    The numbering follows `order_by` and is a function of the data alone, so a
    retried task assigns the same keys. No task holds more than a block of the
    rows, see `number_within`.
    """
    base = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("base")).scalar()
    order = [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order_by]
    numbered = number_within(new.drop(key), [], order, key)
    return numbered.withColumn(key, F.col(key) + base)


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as the text a Python `str()` of it gives; null is `None`."""
    return df.select(*(_cell(f).alias(f.name) for f in df.schema))


def _cell(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        exact = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        text = F.when(F.endswith(exact, F.lit(".000000")), whole).otherwise(exact)
    elif isinstance(field.dataType, T.BooleanType):
        text = F.initcap(value.cast("string"))
    elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        text = _float_text(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("None"))


def _float_text(value: Column) -> Column:
    """Plain digits from 1e-4 up to 1e16, as Python prints floats; `1e+16` style outside."""
    java = value.cast("string")
    size = F.abs(value)
    plain = java.cast("decimal(38,20)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    zero = F.when(F.abs(power) < 10, "0").otherwise("")
    spread = F.concat(mantissa, sign, zero, F.abs(power).cast("string"))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(spread)
    )
