"""All queries outside the training-data subpackage."""

from sparkloom.plans import analytics, base, code, retrieval, source  # noqa: F401  (they register themselves)

QUERIES, ORACLE_SQL = base.QUERIES, base.ORACLE_SQL
