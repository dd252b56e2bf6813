"""Queries of this subpackage by name, and their SQL."""

from . import bpe, fingerprint, htmltext, jaccard, langid, lm, media, mixing, quality, urlfilter

MODULES = (mixing, htmltext, media, quality, langid, bpe, urlfilter, lm, jaccard, fingerprint)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
