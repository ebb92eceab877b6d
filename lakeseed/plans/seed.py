"""Seed plans: ordered steps that stop at the first failure."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[SparkSession], DataFrame | None]


class SeedError(RuntimeError):
    """A failed step, with the plan's name and the step's place in it."""


def execute(spark: SparkSession, sql: str) -> None:
    """Run one statement or a script of several, and discard its result.

    Text that is not one statement is run as a compound statement, with a last ``;`` added
    where it has none, so Spark's own parser finds where each statement ends. Text that does
    not parse has run nothing. A blank text does nothing.
    """
    if not sql.strip():
        return
    for text in (sql, f"BEGIN\n{sql}\nEND", f"BEGIN\n{sql}\n;\nEND"):
        try:
            result = spark.sql(text)
            break
        except ParseException as error:
            refused = error
    else:
        raise refused
    if result.columns:
        result.write.format("noop").mode("overwrite").save()


def read_scripts(spark: SparkSession, path: str) -> list[str]:
    """Texts of a SQL file, or of all files of a folder by name, from any file system Spark reads."""
    files = spark.read.text(path, wholetext=True)
    return [row["value"] for row in files.orderBy(F.col("_metadata.file_path")).collect()]


def execute_files(spark: SparkSession, path: str) -> None:
    for script in read_scripts(spark, path):
        execute(spark, script)


@dataclass
class SeedPlan:
    """Named list of steps, run in the order in which they were added."""

    name: str
    steps: list[tuple[str, Step]] = field(default_factory=list)

    def with_sql(self, sql: str) -> SeedPlan:
        self.steps.append(("sql", lambda spark: execute(spark, sql)))
        return self

    def with_sql_file(self, path: str) -> SeedPlan:
        """The file, or each file of a folder, is read when the plan runs, not when it is added."""
        self.steps.append((path, lambda spark: execute_files(spark, path)))
        return self

    def with_step(self, step: Step, label: str = "custom") -> SeedPlan:
        self.steps.append((label, step))
        return self

    def run(self, spark: SparkSession, retry_for: float = 0.0, interval: float = 0.25) -> None:
        """Run all steps; the first failure ends the run.

        With ``retry_for`` seconds the whole list is run again after a failure, so
        its steps must bear a rerun.
        """
        deadline = time.monotonic() + retry_for
        while True:
            try:
                self._run_once(spark)
                return
            except SeedError:
                if time.monotonic() + interval > deadline:
                    raise
                time.sleep(interval)

    def _run_once(self, spark: SparkSession) -> None:
        for number, (label, step) in enumerate(self.steps, 1):
            try:
                step(spark)
            except Exception as error:
                raise SeedError(f"failed to seed {self.name} at step {number} ({label}): {error}") from error


@dataclass(frozen=True)
class SeedSpec:
    """Seeds given as options: all SQL strings run before all files."""

    name: str
    sql: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)

    def plan(self) -> SeedPlan:
        plan = SeedPlan(self.name)
        for text in self.sql:
            plan.with_sql(text)
        for path in self.files:
            plan.with_sql_file(path)
        return plan
