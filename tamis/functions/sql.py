"""Parsers as SQL functions, for queries that are written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import email, secrets, shell, urls, web

FUNCTIONS = {"parse_command": shell.parse_commands, "parse_message": email.parse_raw, "read_page": web.read_page, "redact_spans": secrets.redact_spans, "is_private_ip": urls.is_private_any}


def register(spark: SparkSession) -> list[str]:
    """Register all of them; returns their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return list(FUNCTIONS)
