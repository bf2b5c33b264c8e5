"""Reduce-then-join: the row-preserving augmentation join and its parts.

J1 left_join_m1, J2 fanout, J3 augment (flagship), J4 left_join, J5 key_overlap,
A1 reduce_by_key, P1/P2 plan_features.

Plan shape of :func:`augment`::

    scan(right, pruned) -> key in the base's type -> filter(key not null)
      -> anti join with the crowded keys -> exchange by key -> agg (key)
      + semi join with the crowded keys
          -> inline(a row per text column, and one with all numbers)
          -> partial agg (key, column, value) -> exchange -> final agg
          -> partial agg (key) -> exchange -> final agg
                                                          # one row per key
    scan(base) ------------------------------------------ left join

Rows of most keys are shuffled once, as they are, and a key's most frequent
values are counted where its rows meet. Keys of more than ``CROWDED`` rows are
found first, by a count over the key columns; they are few, and broadcast. Their
first aggregation spreads one key over all reducers by value, and the map-side
partial aggregation shrinks it to one row per value per task before any
shuffle; the second carries only constant-size buffers (``min_by``, sums), so no
key, however large, is collected into one task. Without text columns one
aggregation by key is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.functions.columns import (
    NUMERIC,
    OTHER,
    STRING,
    TEMPORAL,
    as_double,
    as_list,
    col,
    quote,
    field_types,
    type_class,
)
from widen.sources.tables import TableRef

_RK = "__widen_rk{}"
#: Keys of more rows are reduced by counts of their values, spread over all tasks.
CROWDED = 20_000


# ---------------------------------------------------------------------------
# Which requested features survive
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class FeaturePlan:
    kept: tuple
    unknown: tuple  # requested but not a column of the right table (P1)
    collisions: tuple  # name already in the base table, case-insensitive (P2)


def plan_features(base_columns, right_columns, right_keys, features=None) -> FeaturePlan:
    """P1 + P2 without side effects: an empty/None request means every non-key column."""
    keys = set(as_list(right_keys))
    right = [c for c in right_columns if c not in keys]
    requested = right if not features else [f for f in as_list(features) if f not in keys]
    present = set(right_columns)
    base_lower = {c.lower() for c in base_columns}
    kept, unknown, coll, seen = [], [], [], set()
    for f in requested:
        if f in seen:
            continue
        seen.add(f)
        if f not in present:
            unknown.append(f)
        elif f.lower() in base_lower:
            coll.append(f)
        else:
            kept.append(f)
    return FeaturePlan(tuple(kept), tuple(unknown), tuple(coll))


def project(t: TableRef | DataFrame, features=None, keys=None) -> DataFrame:
    """Requested ∩ existing columns, join keys always included."""
    df = t.df if isinstance(t, TableRef) else t
    keys = as_list(keys if keys is not None else (t.right_keys if isinstance(t, TableRef) else []))
    if not features:
        return df
    have = set(df.columns)
    chosen = [f for f in as_list(features) if f in have and f not in keys]
    return df.select(*[col(c) for c in keys + list(dict.fromkeys(chosen))])


# ---------------------------------------------------------------------------
# One-to-many detection
# ---------------------------------------------------------------------------


def key_counts(df: DataFrame, keys) -> DataFrame:
    keys = as_list(keys)
    nn = None
    for k in keys:
        c = col(k).isNotNull()
        nn = c if nn is None else nn & c
    return df.filter(nn).groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def fanout(df: DataFrame, keys) -> DataFrame:
    """One row: distinct non-null keys, keys with more than one row, largest count.

    Null keys are ignored (pandas ``value_counts`` does the same).
    """
    return key_counts(df, keys).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_dup_keys"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("max_rows_per_key"),
    )


def has_many(df: DataFrame, keys) -> bool:
    return bool(fanout(df, keys).first()["n_dup_keys"])


# ---------------------------------------------------------------------------
# A1: reduce to one row per key
# ---------------------------------------------------------------------------


def _not_null(keys) -> Column:
    out = None
    for k in keys:
        c = col(k).isNotNull()
        out = c if out is None else out & c
    return out


def reduce_by_key(
    df: DataFrame,
    keys,
    features=None,
    null_token: str | None = None,
    keep_null_keys: bool = False,
) -> DataFrame:
    """One row per key (A1).

    Per feature column and key: all null -> null; one distinct non-null value
    -> that value; numeric (booleans included) -> mean as double; string or
    temporal -> most frequent value, smallest value on ties. Nulls are ignored by
    the mode unless ``null_token`` is given, in which case they count as that
    token once two or more distinct non-null values exist (the reference's
    behaviour with ``'nan'``). Null keys are dropped unless ``keep_null_keys``.
    Arrays, maps, structs and binaries are rejected.
    """
    keys = as_list(keys)
    types = field_types(df)
    missing = [k for k in keys if k not in types]
    if missing:
        raise ValueError(f"key column(s) {missing} not in table")
    feats = [f for f in (as_list(features) or [c for c in df.columns if c not in keys])
             if f in types and f not in keys]
    feats = list(dict.fromkeys(feats))
    bad = [f for f in feats if type_class(types[f]) == OTHER]
    if bad:
        raise TypeError(f"cannot reduce columns of type {[str(types[f]) for f in bad]}: {bad}")
    src = df if keep_null_keys else df.filter(_not_null(keys))
    key_cols = [col(k) for k in keys]
    if not feats:
        return src.select(*key_cols).distinct()

    nums = [f for f in feats if type_class(types[f]) == NUMERIC]
    texts = [f for f in feats if f not in nums]
    if not texts:
        # numbers only: one aggregation, partial sums map-side
        aggs = []
        for f in nums:
            x = as_double(f, types[f])
            lo, hi = F.min(x), F.max(x)
            aggs.append(F.when(lo == hi, lo).otherwise(F.avg(x)).alias(f))
        return src.groupBy(*key_cols).agg(*aggs)

    names = [f"__widen_ck{i}" for i in range(len(keys))]
    crowded = F.broadcast(src.groupBy(*[k.alias(n) for k, n in zip(key_cols, names)]).agg(F.count(F.lit(1)).alias("__widen_cn"))
                          .filter(F.col("__widen_cn") > CROWDED).select(*names))  # fewer than rows / CROWDED
    same = [k.eqNullSafe(F.col(n)) for k, n in zip(key_cols, names)]
    few = _reduce_rows(src.join(crowded, same, "left_anti"), key_cols, nums, texts, types, null_token)
    many = _reduce_counts(src.join(crowded, same, "left_semi"), key_cols, nums, texts, types, null_token)
    out = [*key_cols, *[col(f) for f in feats]]
    return few.select(*out).unionByName(many.select(*out))


def _reduce_rows(src: DataFrame, key_cols, nums, texts, types, null_token) -> DataFrame:
    """Keys of up to ``CROWDED`` rows: the rows are shuffled once, by key, and a
    key's values are counted where its rows meet."""
    out = []
    for f in nums:
        x = as_double(f, types[f])
        lo, hi = F.min(x), F.max(x)
        out.append(F.when(lo == hi, lo).otherwise(F.avg(x)).alias(f))
    for f in texts:
        s = col(f).cast("string")
        best = F.mode(s if null_token is None else F.coalesce(s, F.lit(null_token)), True)  # smallest value on ties
        if null_token is not None:
            real = F.when(s != F.lit(null_token), s)
            lo, hi = F.min(real), F.max(real)
            best = F.when(lo.isNull() | (lo == hi), lo).otherwise(best)
        out.append((best.cast(types[f]) if type_class(types[f]) == TEMPORAL else best).alias(f))
    # sorted, so that a key's rows are added up in the order in which they came
    return src.repartition(*key_cols).sortWithinPartitions(*key_cols).groupBy(*key_cols).agg(*out)


def _reduce_counts(src: DataFrame, key_cols, nums, texts, types, null_token) -> DataFrame:
    """Keys of any number of rows, which meet in no task."""
    # long form: a row (key, column, value) per text column, counted first and
    # then reduced to the most frequent value with a constant-size buffer; the
    # numbers ride along in one more row as partial sums, so there is one scan
    # and one pair of aggregations, and a key is one group for both kinds
    xs = [F.lit(None).cast("double").alias(f"__x{j}") for j in range(len(nums))]
    rows = []
    for i, f in enumerate(texts):
        s = col(f).cast("string")
        if null_token is not None:
            s = F.coalesce(s, F.lit(null_token))
        rows.append(F.struct(F.lit(i).alias("__c"), s.alias("__s"), *xs))
    if nums:
        rows.append(F.struct(F.lit(-1).alias("__c"), F.lit(None).cast("string").alias("__s"),
                             *[as_double(f, types[f]).alias(f"__x{j}") for j, f in enumerate(nums)]))
    long = src.select(*key_cols, F.inline(F.array(*rows)))
    sums = [g(f"__x{j}").alias(f"__{n}{j}") for j in range(len(nums))
            for g, n in ((F.sum, "t"), (F.count, "k"), (F.min, "lo"), (F.max, "hi"))]
    grouped = long.groupBy(*key_cols, "__c", "__s").agg(F.count(F.lit(1)).alias("__n"), *sums)
    c, s, n = F.col("__c"), F.col("__s"), F.col("__n")
    out = []
    for j, f in enumerate(nums):
        lo, hi = F.min(f"__lo{j}"), F.max(f"__hi{j}")
        out.append(F.when(lo == hi, lo).otherwise(F.try_divide(F.sum(f"__t{j}"), F.sum(f"__k{j}"))).alias(f))
    for i, f in enumerate(texts):
        is_f = c == i
        real = s.isNotNull() if null_token is None else (s.isNotNull() & (s != F.lit(null_token)))
        # smallest (-count, value) = most frequent, then smallest value
        best = F.min_by(s, F.when(is_f & s.isNotNull(), F.struct((-n).alias("a"), s.alias("b"))))
        if null_token is not None:
            only = F.min_by(s, F.when(is_f & real, s))
            n_real = F.count(F.when(is_f & real, F.lit(1)))
            best = F.when(n_real == 0, F.lit(None)).when(n_real == 1, only).otherwise(best)
        if type_class(types[f]) == TEMPORAL:
            best = best.cast(types[f])
        out.append(best.alias(f))
    return grouped.groupBy(*key_cols).agg(*out)


# ---------------------------------------------------------------------------
# Row-preserving left equi-join against a right side unique on its keys
# ---------------------------------------------------------------------------


def in_key_type(base: DataFrame, right: DataFrame, left_keys, right_keys) -> DataFrame:
    """``right`` with text keys read in the type of the base's keys (numbers,
    dates, timestamps), before anything makes them unique: ``'1'``, ``'01'`` and
    ``' 1'`` are one key of a number base. What does not parse becomes null and
    never matches."""
    bt, rt = field_types(base), field_types(right)
    for lk, rk in zip(left_keys, right_keys):
        if type_class(rt[rk]) == STRING and type_class(bt[lk]) in (NUMERIC, TEMPORAL):
            right = right.withColumn(rk, F.trim(col(rk)).try_cast(bt[lk]))
    return right


def _key_condition(base: DataFrame, right: DataFrame, left_keys, tmp_keys, null_keys: str) -> Column:
    bt, rt = field_types(base), field_types(right)
    cond = None
    for lk, rk in zip(left_keys, tmp_keys):
        lc, rc = base[quote(lk)], right[quote(rk)]
        # a text key of the base is read in the type of the right's (at most one match per row)
        if type_class(bt[lk]) == STRING and type_class(rt[rk]) in (NUMERIC, TEMPORAL):
            lc = F.trim(lc).try_cast(rt[rk])
        else:
            bools = [isinstance(t, T.BooleanType) for t in (bt[lk], rt[rk])]
            if bools == [True, False] and type_class(rt[rk]) == NUMERIC:
                lc = lc.cast("int")
            elif bools == [False, True] and type_class(bt[lk]) == NUMERIC:
                rc = rc.cast("int")
        eq = lc.eqNullSafe(rc) if null_keys == "match" else lc == rc
        cond = eq if cond is None else cond & eq
    return cond


def left_join_m1(
    base: DataFrame,
    right: DataFrame,
    left_keys,
    right_keys,
    null_keys: str = "never",
    validate: bool = False,
) -> DataFrame:
    """Left join that keeps every base row once.

    ``right`` must be unique on ``right_keys`` (e.g. the output of
    :func:`reduce_by_key`). Text keys against a number or date base are read in
    its type first; as several texts can be one key, the right side is then
    reduced to one row per key again. Right keys are renamed to reserved names
    before the join and dropped after, so a base column named like a right key
    survives. The strategy is left to Catalyst and AQE, which broadcast only
    sides whose measured size is under the configured threshold and otherwise
    sort-merge (with skew splitting of the base side).
    """
    lk, rk = as_list(left_keys), as_list(right_keys)
    if len(lk) != len(rk) or not lk:
        raise ValueError(f"need matching key lists, got {lk} and {rk}")
    if null_keys not in ("never", "match"):
        raise ValueError("null_keys must be 'never' or 'match'")
    typed = in_key_type(base, right, lk, rk)
    if typed is not right:
        right = reduce_by_key(typed, rk, keep_null_keys=(null_keys == "match"))
    tmp = [_RK.format(i) for i in range(len(rk))]
    r = right.select(*[col(k).alias(t) for k, t in zip(rk, tmp)],
                     *[col(c) for c in right.columns if c not in rk])
    if null_keys == "never":
        r = r.filter(_not_null(tmp))
    out = base.join(r, _key_condition(base, r, lk, tmp, null_keys), "left").drop(*tmp)
    if validate:
        n0, n1 = base.count(), out.count()
        if n0 != n1:
            raise AssertionError(f"row count changed by join: {n0} -> {n1}")
    return out


# ---------------------------------------------------------------------------
# Augmentation join (flagship)
# ---------------------------------------------------------------------------


def augment(
    base: DataFrame,
    table: TableRef | DataFrame,
    features=None,
    left_keys=None,
    right_keys=None,
    reduce: str = "always",
    null_keys: str = "never",
    null_token: str | None = None,
    validate: bool = False,
) -> DataFrame:
    """Widen ``base`` with features of ``table`` without changing its rows.

    P1 (requested ∩ existing), P2 (drop names already in the base), A1 (one
    row per right key) and J1. ``reduce='always'`` is lazy and starts no job;
    ``'auto'`` first checks for duplicate keys (J2) and skips the reduction,
    keeping column types, when the right side is already unique.
    """
    if isinstance(table, TableRef):
        df = table.df
        left_keys = left_keys or list(table.left_keys)
        right_keys = right_keys or list(table.right_keys)
    else:
        df = table
    lk, rk = as_list(left_keys), as_list(right_keys or left_keys)
    plan = plan_features(base.columns, df.columns, rk, features)
    if not plan.kept:
        return base
    right = in_key_type(base, df.select(*[col(c) for c in rk + list(plan.kept)]), lk, rk)
    if reduce == "auto" and not has_many(right, rk):
        reduced = right
    elif reduce in ("always", "auto"):
        reduced = reduce_by_key(right, rk, plan.kept, null_token=null_token,
                                keep_null_keys=(null_keys == "match"))
    else:
        raise ValueError("reduce must be 'always' or 'auto'")
    return left_join_m1(base, reduced, lk, rk, null_keys=null_keys, validate=validate)


# ---------------------------------------------------------------------------
# J4, J5
# ---------------------------------------------------------------------------


def left_join(base: DataFrame, right: DataFrame, left_keys, right_keys, columns=None) -> DataFrame:
    """Plain left join that may multiply base rows (J4); right keys dropped."""
    lk, rk = as_list(left_keys), as_list(right_keys)
    keep = [c for c in (as_list(columns) or right.columns) if c not in rk]
    tmp = [_RK.format(i) for i in range(len(rk))]
    right = in_key_type(base, right, lk, rk)
    r = right.select(*[col(k).alias(t) for k, t in zip(rk, tmp)], *[col(c) for c in keep])
    return base.join(r, _key_condition(base, r, lk, tmp, "never"), "left").drop(*tmp)


def key_overlap(base: DataFrame, left_key: str, other: DataFrame, right_key: str) -> DataFrame:
    """Share of base rows whose key occurs in ``other`` (J5); denominator all base rows.

    The semi join only needs the distinct right keys, so it shuffles at most
    one row per key per task on the right side.
    """
    tmp = _RK.format(0)
    typed = in_key_type(base, other.select(col(right_key)), [left_key], [right_key])
    keys = typed.select(col(right_key).alias(tmp)).filter(F.col(tmp).isNotNull()).distinct()
    keys = keys.withColumn("__hit", F.lit(1))
    cond = _key_condition(base, keys, [left_key], [tmp], "never")
    # keys are distinct, so the left join keeps every base row exactly once
    return base.select(col(left_key)).join(keys, cond, "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("__hit").alias("n_matched"),
    ).select("n_rows", "n_matched",
             F.try_divide(F.col("n_matched").cast("double"), F.col("n_rows")).alias("overlap"))
