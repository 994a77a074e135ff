"""Names and keys as SQL functions, for sessions that query in SQL. Their bodies are SQL, which the optimiser inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import COHORT_STOP_WORDS


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, r'(?U)\\s+', ' '))"


def before_comma() -> str:
    return "lower(split(coalesce(name, ''), ',')[0])"


STOP = r"(?<![\p{L}\p{N}_])(" + "|".join(COHORT_STOP_WORDS) + r")(?![\p{L}\p{N}_])"
BODIES = {
    "building_name": squeezed(f"regexp_replace({before_comma()}, '[^a-z0-9 ]', '')"),
    "study_name": squeezed(f"regexp_replace({before_comma()}, r'[^\\p{{L}}\\p{{N}} ]', '')"),
    "cohort_name": squeezed(f"regexp_replace(regexp_replace(lower(replace(coalesce(name, ''), ',', ' ')), r'{STOP}', ' '), r'(?U)[^\\p{{L}}\\p{{N}}_\\s]', ' ')"),
    "repost_key": "lower(regexp_replace(coalesce(name, ''), '[^a-zA-Z0-9]', ''))",
    "district_key": f"trim(regexp_replace({squeezed("lower(coalesce(name, ''))")}, r'\\s*district$', ''))",
}


def register(spark: SparkSession) -> None:
    """Make building_name, study_name, cohort_name, repost_key and district_key(name) known to a session's SQL."""
    for name, body in BODIES.items():
        spark.sql(f"create or replace temporary function {name}(name string) returns string return {body}")
