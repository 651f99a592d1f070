"""Type-guarded access to dynamic JSON; each helper gives SQL text, usable inside lambdas.

A value of another JSON type reads as null: casts alone would turn "5" into 5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'variant')"


def kind(value: str, path: str = "$") -> str:
    return f"schema_of_variant({at(value, path)})"


def string(value: str, path: str = "$") -> str:
    return f"(case when {kind(value, path)} = 'STRING' then try_variant_get({value}, '{path}', 'string') end)"


def filled(value: str, path: str = "$") -> str:
    """A string that isn't empty."""
    return f"nullif({string(value, path)}, '')"


def is_number(value: str, path: str = "$") -> str:
    return f"coalesce({kind(value, path)} rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)', false)"


def count(value: str, path: str = "$") -> str:
    """A number of at least 0 as a long; 0 for anything else."""
    return f"(case when {is_number(value, path)} then greatest(coalesce(cast(try_variant_get({value}, '{path}', 'double') as bigint), 0L), 0L) else 0L end)"


def is_object(value: str, path: str = "$") -> str:
    return f"coalesce({kind(value, path)} like 'OBJECT%', false)"


def is_array(value: str, path: str = "$") -> str:
    return f"coalesce({kind(value, path)} like 'ARRAY%', false)"


def array(value: str, path: str = "$") -> str:
    """Elements of a JSON array; an empty array for anything else."""
    return f"(case when {is_array(value, path)} then try_variant_get({value}, '{path}', 'array<variant>') else cast(array() as array<variant>) end)"


def exists(value: str, path: str) -> str:
    """Present and not null."""
    return f"coalesce({kind(value, path)} not in ('VOID', 'NULL'), false)"


def is_true(value: str, path: str) -> str:
    return f"coalesce({kind(value, path)} = 'BOOLEAN' and try_variant_get({value}, '{path}', 'boolean'), false)"


def raw(text: Column | str, *path: Column | str) -> Column:
    """JSON text (a string's own text) at a path joined from literals and columns; keys keep their order."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in path]
    return F.call_function("get_json_object", F.col(text) if isinstance(text, str) else text, F.concat(*parts) if len(parts) > 1 else parts[0])
