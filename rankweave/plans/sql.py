"""Helpers that write DuckDB SQL with the same fixed values as the functions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from rankweave.functions import vocab


def quote(text: object) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def values(name: str, columns: str, rows: Iterable[Iterable[object]]) -> str:
    """A CTE of literal rows."""
    lit = lambda x: x if isinstance(x, Raw) else (f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x) if isinstance(x, int) else quote(x))
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows) + ")"


class Raw(str):
    """SQL that is not quoted."""


def listed(items: Iterable[str]) -> Raw:
    return Raw("[" + ", ".join(quote(x) for x in items) + "]::VARCHAR[]")


def lookup(expr: str, table: Mapping[str, object], default: str | None = None) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {v if isinstance(v, (int, float)) else quote(v)}" for k, v in table.items())
    return f"(CASE {expr} {whens} ELSE {expr if default is None else default} END)"


ABBR = values("abbr", "a, f", vocab.ABBREVIATIONS.items())


def tokens(source: str, key: str = "doc_id", text: str = "text", name: str = "tok") -> str:
    """CTE (key, term): the tokens of a table's text, abbreviations written out."""
    return f"""{name} AS (
  SELECT {key}, unnest(string_split(coalesce(f, t), ' ')) AS term
  FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9][a-z0-9+#_]*')) AS t FROM {source}) LEFT JOIN abbr ON t = a)"""


#: Postings and statistics of `documents`.
INDEX = (
    ABBR
    + ",\n"
    + tokens("documents")
    + """,
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
dls AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY doc_id),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dls) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS avgdl),
terms AS (SELECT term, count(*) AS df, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM post, corpus GROUP BY term, n)"""
)


def canonical_skill(source: str, column: str, keys: str, name: str) -> str:
    """CTEs that add `skill`, the canonical name of a column, to (keys, column); the last is called `name`."""
    whens = " ".join(f"WHEN ends_with(s3, {quote(x)}) AND length(s3) > {len(x)} THEN trim(substr(s3, 1, length(s3) - {len(x)}))" for x in vocab.SUFFIXES)
    return f"""{name}1 AS (SELECT {keys}, trim(regexp_replace(regexp_replace(lower(trim({column})), '[''"]', '', 'g'), '\\s+', ' ', 'g')) AS s1 FROM {source}),
{name}2 AS (SELECT {keys}, {lookup("s1", vocab.ALIASES)} AS s2 FROM {name}1),
{name}3 AS (SELECT {keys}, {lookup("s2", vocab.ABBREVIATIONS)} AS s3 FROM {name}2),
{name}4 AS (SELECT {keys}, CASE {whens} ELSE s3 END AS s4 FROM {name}3),
{name} AS (SELECT {keys}, trim({lookup("s4", vocab.ABBREVIATIONS)}) AS skill FROM {name}4)"""
