"""Allowed values of enumerated columns, and the split of rows into valid and quarantined ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each enumerated column may hold.
END_STATUS = "completed abandoned handed-off".split()
SESSION_STATUS = ["active", *END_STATUS]
SESSION_TYPE = "claude-code claude-ai co-work cursor copilot windsurf cline codex aider other".split()
STATE_STATUS = "planned in-progress blocked needs-review done abandoned".split()
STATE_PRIORITY = "critical high medium low".split()
DECISION_STATUS = "active superseded revisit revoked".split()
ENTITY_TYPE = "person service file module concept api tool library config endpoint".split()
OBSERVATION_CATEGORY = "general architecture decision blocker pattern progress gotcha learned preference convention dependency risk".split()
CONTEXT_CATEGORY = "architecture audit spec reference onboarding runbook postmortem guide".split()
RELATION = "owns depends_on blocks unblocks works_with part_of uses produces consumes calls extends replaces tests deploys_to related_to".split()
RELATION_SOURCE = "EXTRACTED INFERRED AMBIGUOUS".split()
RECORD_TYPE = "entity observation decision context state".split()
CANDIDATE_STATUS = "pending approved rejected".split()
REVIEW_ACTION = "approve reject".split()


def folded(x: Column) -> Column:
    """Trimmed and in lower case, as candidate fields are compared."""
    return F.lower(F.trim(x))


def in_unit(x: Column) -> Column:
    """Whether a confidence or weight lies from 0 to 1; null and NaN don't."""
    return F.coalesce(x.between(0.0, 1.0), F.lit(False))


def checked(rows: DataFrame, rules: dict[str, Iterable[str] | Column]) -> DataFrame:
    """``rows`` with ``errors``: the names of the ``rules`` that a row breaks, in their order; a rule is a column's allowed values, or a condition."""
    holds = lambda name, rule: rule if isinstance(rule, Column) else F.col(name).isin(*rule)
    broken = F.array(*[F.when(~F.coalesce(holds(n, r), F.lit(False)), F.lit(n)) for n, r in rules.items()])
    return rows.withColumn("errors", F.filter(broken, lambda x: x.isNotNull()))


def split_valid(rows: DataFrame, rules: dict[str, Iterable[str] | Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``errors``)."""
    both = checked(rows, rules)
    return both.where(F.size("errors") == 0).drop("errors"), both.where(F.size("errors") > 0)
