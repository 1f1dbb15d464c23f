"""All queries of the reference's operators, and the SQL that gives the same rows."""

from folioscope.plans import checks, diagnosis, evaluation, normalization, registry_reports, relational, selection, spans  # noqa: F401
from folioscope.plans.registry import QUERIES, SQL  # noqa: F401
