"""Every operator as a query on the test tables, with the SQL it is checked against."""

from cohortloom.catalog.queries import QUERIES
from cohortloom.catalog.sql import SQL

__all__ = ["QUERIES", "SQL"]
