"""mendwell: data-quality operators over plain Spark DataFrames.

Profile, detect, inject, repair, score, compare and publish multi-table
datasets. Every operator takes DataFrames and returns DataFrames.
"""

from mendwell.spec import (
    ControlScope,
    Dataset,
    ForeignKey,
    Rule,
    Scenario,
    TableSpec,
)

__all__ = ["ControlScope", "Dataset", "ForeignKey", "Rule", "Scenario", "TableSpec"]
