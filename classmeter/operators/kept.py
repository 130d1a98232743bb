"""The three summary views from counts that are kept up to date, without reading all attempts again.

What the views need of attempts, problems and resources is held as counts per
(key, other key) and per (student, score). Rows that are added count 1, rows
that are taken away -1, so distinct counts and maxima survive deletes: a pair
or a score is there as long as its count is above 0. Changes may be folded in
any order; a count that a removal brought below 0 waits for its rows.

Counts of a whole snapshot are dealt out by the key that they have in common,
the student or the author, and many changes become another run beside them: a
key's rows of all runs are in one bucket, and are summed up there by who reads
them.

A change is a frame of a relation's rows with a column `sign`, under the
relation's name, or under that of the one count that it moves. The functions
below make the changes of the write jobs from what these have written already,
so only the rows that a job touches are counted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from classmeter.operators import reports, writes
from classmeter.session import Dealt, buckets, deal, written
from classmeter.sources.commits import CommitLog
from classmeter.sources.schemas import KEYS
from classmeter.sources.tables import Tables

# The counts: relation, keys, whether scores are summed as well.
COUNTS: dict[str, tuple[str, tuple[str, ...], bool]] = {
    "tries": ("attempt", ("student_id", "problem_id"), True),
    "marks": ("attempt", ("student_id", "score"), False),
    "reviews": ("attempt", ("mentor_id", "student_id"), True),
    "authored": ("problem", ("user_id",), False),
    "uploaded": ("resource", ("user_id",), False),
}
# Rows without a value there are not counted.
NEEDED = {"marks": "score", "reviews": "mentor_id"}

Changes = dict[str, DataFrame]


@dataclass(frozen=True)
class Kept:
    """The counts by name, each with its keys, `n`, and for some `scored` and `total`; `runs` are those that are dealt out."""

    frames: dict[str, DataFrame]
    runs: dict[str, Dealt] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]


def _measures(name: str) -> list[str]:
    return ["n", "scored", "total"] if COUNTS[name][2] else ["n"]


def _dealt_by(name: str) -> str:
    """The key that a count is dealt out by: all counts of attempts hold the student."""
    keys = COUNTS[name][1]
    return "student_id" if "student_id" in keys else keys[0]


def _needed(name: str, rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(NEEDED[name]).isNotNull()) if name in NEEDED else rows


def _counted(name: str, rows: DataFrame, parts: int = 0) -> DataFrame:
    """The counts that signed rows stand for.

    Summed in the map tasks first or, with `parts`, where the rows of a key
    that the count is dealt out by meet.
    """
    _, keys, scores = COUNTS[name]
    rows = _needed(name, rows).select(*keys, *(["score"] if scores and "score" not in keys else []), "sign")
    if parts:
        rows = rows.repartition(parts, _dealt_by(name))
    sums = [F.sum("sign").cast("long").alias("n")]
    if scores:
        signed = F.when(F.col("sign") > 0, F.col("score")).otherwise(-F.col("score"))
        sums.append(F.sum(F.when(F.col("score").isNotNull(), F.col("sign")).otherwise(0)).cast("long").alias("scored"))
        sums.append(F.coalesce(F.sum(signed), F.lit(0)).cast("decimal(28,2)").alias("total"))
    return rows.groupBy(*keys).agg(*sums)


def _some(name: str) -> Column:
    """Counts that say anything; those of rows that came and went are dropped."""
    return reduce(Column.__or__, [F.col(m) != 0 for m in _measures(name)])


def added(**rows: DataFrame) -> Changes:
    return {relation: frame.withColumn("sign", F.lit(1)) for relation, frame in rows.items()}


def removed(**rows: DataFrame) -> Changes:
    return {relation: frame.withColumn("sign", F.lit(-1)) for relation, frame in rows.items()}


def together(*changes: Changes) -> Changes:
    out: Changes = {}
    for change in changes:
        for relation, rows in change.items():
            out[relation] = out[relation].unionByName(rows) if relation in out else rows
    return out


def build(t: Tables) -> Kept:
    """The counts of a whole snapshot, written."""
    whole = added(attempt=t.attempt, problem=t.problem, resource=t.resource)
    parts = buckets(t.attempt.sparkSession)
    return _dealt({name: _counted(name, whole[of], parts) for name, (of, *_) in COUNTS.items()})


def _dealt(counts: dict[str, DataFrame], runs: dict[str, Dealt] | None = None) -> Kept:
    """Counts written as they are dealt out, beside those that are."""
    new = {name: deal(frame, f"kept-{name}", _dealt_by(name), COUNTS[name][1]) for name, frame in counts.items()}
    runs = {**(runs or {}), **new}
    return Kept({name: _read(name, runs[name]) for name in COUNTS}, runs)


def _read(name: str, table: Dealt) -> DataFrame:
    """The counts of all runs."""
    return table.rows() if len(table.runs) == 1 else _summed(name, table.rows()).filter(_some(name))


def fold(kept: Kept, changes: Changes) -> Kept:
    """The counts after `changes`, lazily; `settled` or `write` them before the next fold.

    Many changes of counts that are dealt out are summed up and written as
    another run. Others are summed up and written, see `_merged` for how the
    counts meet them. Changes are read twice, so they come from written rows.
    """
    frames, runs = dict(kept.frames), dict(kept.runs)
    for name, (relation, keys, _) in COUNTS.items():
        moves = [_needed(name, changes[of]) for of in (relation, name) if of in changes]
        changed = _rows(moves) if name in runs else 1
        if changed > FEW:
            for rows in moves:
                runs[name] = runs[name].add(_counted(name, rows, runs[name].buckets))
            frames[name] = _read(name, runs[name])
        elif moves and changed:
            counts = [_counted(name, rows) for rows in moves]
            delta = _summed(name, reduce(DataFrame.union, counts)) if len(counts) > 1 else counts[0]
            delta = written(delta.filter(_some(name)), f"change-{name}")
            frames[name] = _merged(name, list(keys), kept[name], delta)
            runs.pop(name, None)
    return Kept(frames, runs)


def _rows(moves: list[DataFrame]) -> int:
    """How many rows change, exact up to `FEW`."""
    return sum(rows.limit(FEW + 1).count() for rows in moves)


def _summed(name: str, counts: DataFrame) -> DataFrame:
    """Counts of which a key may have several."""
    types = {m: counts.schema[m].dataType for m in _measures(name)}
    return counts.groupBy(*COUNTS[name][1]).agg(*(F.sum(m).cast(kind).alias(m) for m, kind in types.items()))


def settled(kept: Kept) -> Kept:
    """The same counts, written; those in runs are, and become one run again when there are more than `MOST_RUNS`."""
    runs = {name: table for name, table in kept.runs.items() if len(table.runs) <= MOST_RUNS}
    return _dealt({name: frame for name, frame in kept.frames.items() if name not in runs}, runs)


# Changed keys that are few enough for the counts to stay where they are.
FEW = 100_000
MOST_RUNS = 8


def _merged(name: str, keys: list[str], old: DataFrame, delta: DataFrame) -> DataFrame:
    """The counts with the changes.

    A few changes meet the counts in joins that do not shuffle the counts; keys
    that are new are those that no count meets. Many are added up with the
    counts in one shuffle of both.
    """
    if delta.limit(FEW + 1).count() > FEW:
        return _summed(name, old.unionByName(delta)).filter(_some(name))
    measures = _measures(name)
    new = delta.withColumnsRenamed({c: f"_{c}" for c in delta.columns})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    moved = {m: (F.col(m) + F.coalesce(F.col(f"_{m}"), F.lit(0))).cast(old.schema[m].dataType) for m in measures}
    stay = old.join(new, same, "left").withColumns(moved).select(*keys, *measures)
    met = old.select(*keys).join(new, same, "left_semi")
    fresh = new.join(met, same, "left_anti").select(*(F.col(f"_{c}").alias(c) for c in (*keys, *measures)))
    return stay.unionByName(fresh).filter(_some(name))


# --- the changes of the write jobs


def feedback_changes(t: Tables, accepted: DataFrame, rows: DataFrame | None = None) -> Changes:
    """Of `writes.with_feedback`: the attempts that get another reviewer, without and with; other counts stay."""
    rows = writes.reviewed(t, accepted) if rows is None else rows
    rows = rows.filter(~F.col("mentor_id").eqNullSafe(F.col("_before")))
    before = F.struct(F.lit(-1).alias("sign"), F.col("_before").alias("mentor_id"))
    after = F.struct(F.lit(1).alias("sign"), F.col("mentor_id"))
    return {"reviews": _moved(rows, before, after)}


def _moved(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """Each row twice, read once: as it was and as it is."""
    as_both = F.explode(F.array(before, after)).alias("_as")
    return rows.select("student_id", "problem_id", "score", as_both).select("student_id", "problem_id", "score", "_as.*")


def problem_changes(t: Tables, gone: DataFrame) -> Changes:
    """Of `writes.without_problems`; nobody tried those."""
    return removed(problem=t.problem.join(gone, "problem_id", "left_semi"))


def removal_changes(t: Tables, removal: writes.Removal) -> Changes:
    """Of `writes.without_removed`: what goes, and attempts that lose their reviewer."""
    met = writes.hit(removal, "attempt", t.attempt.select("student_id", "problem_id", "mentor_id", "score"))
    rows = deal(met, "met-attempts", "student_id", ("problem_id",)).rows()
    stay = rows.filter(~F.col("_lost") & F.col("_no_mentor_id"))
    before = F.struct(F.lit(-1).alias("sign"), F.col("mentor_id"))
    after = F.struct(F.lit(1).alias("sign"), F.lit(None).cast("long").alias("mentor_id"))
    changes = removed(attempt=rows.filter("_lost").drop("_lost", "_no_mentor_id"))
    changes |= {"reviews": _moved(stay, before, after)}
    for relation in ("problem", "resource"):
        key = list(KEYS[relation])
        changes |= removed(**{relation: t[relation].join(removal.keys[relation], key, "left_semi")})
    return changes


# --- the views


def _totals(pairs: DataFrame, by: str, other: str) -> DataFrame:
    """As `reports.attempt_totals` gives them, but for the highest score."""
    return pairs.filter("n > 0").groupBy(by).agg(
        F.count(other).alias("others"),
        F.sum("n").alias("n"),
        F.sum("scored").alias("scored"),
        F.sum("total").cast("decimal(28,2)").alias("total"),
    )


def student_performance(t: Tables, kept: Kept) -> DataFrame:
    """Equal to `reports.student_performance` of the snapshot that `kept` follows."""
    highest = kept["marks"].filter("n > 0").groupBy("student_id").agg(F.max("score").alias("highest"))
    totals = _totals(kept["tries"], "student_id", "problem_id").join(highest, "student_id", "left")
    return reports.student_performance(t, totals)


def problem_statistics(t: Tables, kept: Kept, faithful: bool = True) -> DataFrame:
    return reports.problem_statistics(t, faithful, _totals(kept["tries"], "problem_id", "student_id"))


def mentor_activity(t: Tables, kept: Kept) -> DataFrame:
    created = [
        kept[name].filter("n > 0").select("user_id", F.col("n").alias(figure))
        for name, figure in (("authored", "problems"), ("uploaded", "resources"))
    ]
    return reports.mentor_activity(t, (created[0], created[1]), _totals(kept["reviews"], "mentor_id", "student_id"))


# --- kept with the versions of a snapshot


def write(kept: Kept, path: str, version: int) -> None:
    """Write the counts that belong to a version of the snapshot at `path`; readers see all or none of them."""
    spark = next(iter(kept.frames.values())).sparkSession
    folders = {name: f"_kept/{name}/{version}-{uuid.uuid4().hex}" for name in COUNTS}
    for name, folder in folders.items():
        kept[name].write.parquet(f"{path}/{folder}")
    CommitLog(spark, f"{path}/_kept/_versions").write(version, folders)


def load(spark: SparkSession, path: str, version: int) -> Kept | None:
    """The counts of a version of the snapshot; None if they were not written whole."""
    log = CommitLog(spark, f"{path}/_kept/_versions")
    if not log.has(version):
        return None
    return Kept({name: spark.read.parquet(f"{path}/{folder}") for name, folder in log.read(version).items()})
