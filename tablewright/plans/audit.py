"""Row counts after each step, gathered while the rows pass by.

Counting costs no job of its own. An observed count is exact unless a lost executor
makes a stage run again, in which case its rows may be counted twice; nothing but
the audit table depends on it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.storage import stored

AUDIT_SCHEMA = (
    "migration_id string, client_id string, blueprint_id string, gate string, position int, "
    "step string, rows_before bigint, rows_after bigint"
)


class Watch:
    """Looks at the rows of one run of one blueprint."""

    def rows(self, step: str, frame: DataFrame, *, gate: str = "G2") -> DataFrame:
        """The frame, with its rows counted under the name of a step."""
        return frame

    def settle(self, frame: DataFrame) -> DataFrame:
        """The frame, stored if this is a run and not just a plan."""
        return frame


@dataclass
class Step:
    name: str
    gate: str
    observation: Observation


@dataclass
class CountingWatch(Watch):
    steps: list[Step] = field(default_factory=list)

    def rows(self, step: str, frame: DataFrame, *, gate: str = "G2") -> DataFrame:
        observation = Observation(f"{step} {uuid.uuid4().hex}")
        self.steps.append(Step(step, gate, observation))
        return frame.observe(observation, F.count(F.lit(1)).alias("rows"))

    def settle(self, frame: DataFrame) -> DataFrame:
        return stored(frame)

    def counts(self) -> list[tuple[str, str, int | None]]:
        """Step, gate and rows. None where the plan never got to the step."""
        return [(step.name, step.gate, step.observation.get.get("rows")) for step in self.steps]


def audit_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, AUDIT_SCHEMA)
