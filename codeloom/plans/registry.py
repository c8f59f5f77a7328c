"""All queries of the core and their SQL."""

from __future__ import annotations

from codeloom.plans import problems, reference
from codeloom.plans.problem_sql import SQL as PROBLEM_SQL
from codeloom.plans.reference_sql import SQL as REFERENCE_SQL

QUERIES = {**reference.QUERIES, **problems.QUERIES}
SQL = {**REFERENCE_SQL, **PROBLEM_SQL}
FLAGSHIP = "hybrid_search"
