"""DuckDB SQL of folds: a recursive query that takes one row of each key a step."""

from __future__ import annotations


def fold_sql(log: str, key: str, order: str, state: dict[str, tuple[str, str]], out: str, where: str = "n > 0", into: str | None = None) -> str:
    """state: column to (start, next); next reads the state before as r.column and the row as l.column. out reads run and its row.
    into: the name of a further table of the result, for a query that follows."""
    starts = ", ".join(f"{a} AS {c}" for c, (a, _) in state.items())
    steps = ", ".join(f"{b} AS {c}" for c, (_, b) in state.items())
    last = f"SELECT {out} FROM run r JOIN numbered l ON l.{key} = r.fold_key AND l.n = r.n WHERE r.{where}"
    return (
        f"numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM {log}), "
        f"run AS (SELECT {key} AS fold_key, CAST(0 AS BIGINT) AS n, {starts} FROM (SELECT DISTINCT {key} FROM numbered) UNION ALL "
        f"SELECT l.{key}, l.n, {steps} FROM run r JOIN numbered l ON l.{key} = r.fold_key AND l.n = r.n + 1)"
    ) + (f", {into} AS ({last})" if into else f" {last}")
