"""Looks: what a formula has to know of a whole column, for any number of columns in one pass.

A question goes to a column. Each row gives evidence, or none; the evidence says, bit by
bit, which answers it allows; the answer is made of the bits that all evidence allows. All
questions to a table are put together: one scan, in which each task keeps one number a
question, and one row of answers, which is a subquery of the plan that asks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.names import field


# Plan nodes that leave a file's rows in their order.
_IN_PLACE = ("Project", "Filter", "CollectMetrics", "SubqueryAlias")


@dataclass(frozen=True, eq=False)
class Question:
    """``allows`` gives the bits (BIGINT) of what is evidence, ``answer`` what the common bits mean."""

    evidence: Column
    allows: Callable[[Column], Column]
    answer: Callable[[Column], Column]


def ask(frame: DataFrame, questions: Sequence[Question]) -> Column:
    """The answers of a table's columns as one struct, ``answer0``, ``answer1`` and so on.

    Without any evidence the bits are NULL, and so is what is made of them.
    """
    given = frame.select(*(question.evidence.alias(f"evidence{i}") for i, question in enumerate(questions)))
    common = given.agg(*(F.bit_and(_bits(question, F.col(f"evidence{i}"))).alias(f"bits{i}") for i, question in enumerate(questions)))
    answers = (question.answer(F.col(f"bits{i}")).alias(f"answer{i}") for i, question in enumerate(questions))
    return common.select(F.struct(*answers)).scalar()


def _bits(question: Question, evidence: Column) -> Column:
    return F.when(evidence.isNotNull(), question.allows(evidence))


def asked(frame: DataFrame, questions: Sequence[Question], name: str = "__told") -> tuple[DataFrame, list[Column]]:
    """The frame with the answers in a column, and each answer. Without questions nothing changes."""
    if not questions:
        return frame, []
    while name in frame.columns:
        name = "_" + name
    told = frame.withColumn(name, ask(frame, questions))
    return told, [field(name)[f"answer{i}"] for i in range(len(questions))]


def first_bit(values: Sequence[Column]) -> Callable[[Column], Column]:
    """The value of the lowest bit that is set."""
    return lambda bits: F.coalesce(*(F.when(bits.bitwiseAND(1 << i) != 0, value) for i, value in enumerate(values)))


def reads_files(frame: DataFrame) -> bool:
    """Whether a frame is files read, with nothing done to them but filters and computed columns.

    Looking at it again then only reads some of their columns again.
    """
    node = frame._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.getClass().getSimpleName() in _IN_PLACE:
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation"
