"""All queries by name, and the SQL that gives the same rows."""

from textlex.plans import documents, lexical, reviews

QUERIES = {**documents.QUERIES, **lexical.QUERIES, **reviews.QUERIES}
ORACLE = {**documents.ORACLE, **lexical.ORACLE, **reviews.ORACLE}
