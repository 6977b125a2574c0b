"""All queries outside the llm subpackage and their SQL."""

from __future__ import annotations

from tagloom.plans import codemap, general

QUERIES = {**codemap.QUERIES, **general.QUERIES}
SQL = {**codemap.SQL, **general.SQL}
