"""What this subpackage adds to the driver contract."""

from frameloom.llm.queries import QUERIES
from frameloom.llm.sql import SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
