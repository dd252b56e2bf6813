"""All queries of the screening operators by name, and their SQL."""

from . import code, content, email, ledger, packages, payments, secrets, sources, urls, web

MODULES = (content, secrets, code, urls, email, packages, payments, web, ledger, sources)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
