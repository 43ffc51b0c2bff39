"""Configuration-driven table transformation on Spark."""

from tablewright import names
from tablewright.errors import (
    ConfigValidationError,
    ErrorDetail,
    FileGuardError,
    PipelineError,
    TablewrightError,
    TransformError,
    WriteVerificationError,
)
from tablewright.operators.derivations import apply_derivations
from tablewright.operators.filters import apply_filters
from tablewright.operators.joins import apply_join
from tablewright.operators.mappings import apply_mappings
from tablewright.plans.blueprint import plan, transform
from tablewright.plans.pipeline import run, validate
from tablewright.sources.tables import prefix_columns, read_table
from tablewright.spec import load, load_file

__all__ = [
    "ConfigValidationError",
    "ErrorDetail",
    "FileGuardError",
    "PipelineError",
    "TablewrightError",
    "TransformError",
    "WriteVerificationError",
    "apply_derivations",
    "apply_filters",
    "apply_join",
    "apply_mappings",
    "load",
    "load_file",
    "plan",
    "prefix_columns",
    "read_table",
    "run",
    "transform",
    "validate",
]
