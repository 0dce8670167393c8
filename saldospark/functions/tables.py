"""Table functions for SQL: what the operators do to a document, in a lateral join."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and definition of each function; all are SQL themselves, so a lateral join of one is planned like any other query.
FUNCTIONS = {
    "document_lines": r"(texto STRING) RETURNS TABLE (linea INT, contenido STRING) RETURN SELECT pos, col FROM (SELECT posexplode(split(texto, '\\n')))",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session: ``SELECT ... FROM docs, LATERAL document_lines(docs.text)``."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
