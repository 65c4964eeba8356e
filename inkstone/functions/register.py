"""The scalar functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: SQL bodies that the session keeps as functions; they stay inside generated code.
SQL_FUNCTIONS = {
    "fix_tildes(s STRING) RETURNS STRING": r"regexp_replace(s, '(\\d+\\.?\\d*)~+(\\d+\\.?\\d*)', '$1-$2')",
    "collection_name(s STRING) RETURNS STRING": "concat('doc_', substring(md5(s), 1, 8))",
    "content_key(b BINARY) RETURNS STRING": "substring(sha2(b, 256), 1, 16)",
    "bullet_budget(n INT) RETURNS INT": "CASE WHEN n <= 10 THEN 5 WHEN n <= 25 THEN 8 ELSE 12 END",
    "terms(s STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(s, '[가-힣a-zA-Z0-9]+', 0)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in SQL_FUNCTIONS]
