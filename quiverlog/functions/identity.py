"""Canonical identities of compounds, as Python functions and as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlog.errors import InvalidParameterError


def quote_literal(value: str) -> str:
    """SQL literal: quotes doubled; with a backslash, backslashes doubled and an E in front."""
    quoted = "'" + value.replace("\\", "\\\\").replace("'", "''") + "'"
    return "E" + quoted if "\\" in value else quoted


def quote_literal_column(value: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(F.instr(value, "\\") > 0, F.concat(F.lit("E"), quoted)).otherwise(quoted)


def compound_identity(kind: str, roles: Mapping[str, str]) -> str:
    """``Type@(role='value', ...)``, roles in byte order of their names."""
    ordered = sorted(roles.items(), key=lambda x: (x[0].encode(), x[1].encode()))
    return f"{kind}@({', '.join(f'{r}={quote_literal(v)}' for r, v in ordered)})"


def compound_identity_column(kind: str, roles: Mapping[str, Column]) -> Column:
    """The same for each row; null where a role is null."""
    parts: list[Column] = [F.lit(f"{kind}@(")]
    for k, role in enumerate(sorted(roles, key=str.encode)):
        parts += [F.lit(f"{', ' if k else ''}{role}="), quote_literal_column(roles[role].cast("string"))]
    return F.concat(*parts, F.lit(")"))


def compound_prefix(kind: str) -> str:
    return f"{kind}@("


def with_compound_edges(rows: DataFrame, kind: str, roles: Mapping[str, Column], keep: list[Column]) -> DataFrame:
    """``keep`` and ``edges``, array<struct<subject, predicate, object>> of a row's compound; null where a role is null.

    The identity is made once for each row, in a projection of its own.
    """
    names = sorted(roles, key=str.encode)
    own = rows.select(*keep, compound_identity_column(kind, roles).alias("_cid"), *(roles[r].cast("string").alias(f"_role{i}") for i, r in enumerate(names)))
    edges = F.array(*(F.struct(F.col("_cid").alias("subject"), F.lit(r).alias("predicate"), F.col(f"_role{i}").alias("object")) for i, r in enumerate(names)))
    return own.select(*own.columns[: len(keep)], F.when(F.col("_cid").isNotNull(), edges).alias("edges"))


def check_roles(kind: str, declared: set[str], given: list[str]) -> None:
    if not declared:
        raise InvalidParameterError(f"no roles are declared for {kind}")
    if sorted(given) != sorted(declared):
        raise InvalidParameterError(f"{kind} takes each of these roles once: {', '.join(sorted(declared))}; there are: {', '.join(sorted(given))}")
