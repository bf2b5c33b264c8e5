"""Builders for DuckDB oracle SQL (written independently of the Spark plans)."""

from __future__ import annotations


def mean_sql(tbl: str, key: str, value: str) -> str:
    """One value per key: the value itself when constant, else the mean."""
    return (f"(SELECT {key} AS k, CASE WHEN min({value}) = max({value}) THEN min({value})::DOUBLE "
            f"ELSE avg({value}::DOUBLE) END AS v FROM {tbl} WHERE {key} IS NOT NULL GROUP BY {key})")


def mode_sql(tbl: str, key: str, value: str) -> str:
    """Most frequent non-null value per key, smallest on ties."""
    return f"""(SELECT k, v FROM (
        SELECT {key} AS k, {value} AS v,
               row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}::VARCHAR) AS rn
        FROM {tbl} WHERE {key} IS NOT NULL AND {value} IS NOT NULL
        GROUP BY {key}, {value}) WHERE rn = 1)"""


def augment_sql(base: str, lkey: str, right: str, rkey: str, nums, cats, base_cols: str = "b.*",
                round_means: bool = True) -> str:
    """Base rows once, with per-key means of ``nums`` and modes of ``cats``."""
    sel, joins = [base_cols], []
    for i, f in enumerate(nums):
        joins.append(f"LEFT JOIN {mean_sql(right, rkey, f)} n{i} ON b.{lkey} = n{i}.k")
        sel.append(f"round(n{i}.v, 6) AS {f}" if round_means else f"n{i}.v AS {f}")
    for i, f in enumerate(cats):
        joins.append(f"LEFT JOIN {mode_sql(right, rkey, f)} m{i} ON b.{lkey} = m{i}.k")
        sel.append(f"m{i}.v AS {f}")
    return f"SELECT {', '.join(sel)} FROM {base} b " + " ".join(joins)


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(f"({p})" for p in parts)
