"""Join catalog: joinable-table search and catalog frames.

A catalog row describes one joinable table for a base table:
``id, dataset_name, score, left_columns_names, right_columns_names, size,
join_key, description``. Here it is a DataFrame from start to end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.functions.ranking import global_rank
from widen.functions.columns import NUMERIC, STRING, as_list, classes, col, field_types
from widen.sources.tables import TableRef

# Fixed values that must equal the reference's.
MIN_SCORE = 0.5
MAX_SIZE = 100_000_000
MIN_SIZE = 20_000

CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("left_columns_names", T.StringType()),
    T.StructField("right_columns_names", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("join_key", T.IntegerType()),
    T.StructField("description", T.StringType()),
])

SEARCH_SCHEMA = ("results array<struct<id:string, score:double, "
                 "metadata:struct<name:string, size:bigint, description:string>, "
                 "augmentation:struct<type:string, left_columns_names:array<array<string>>, "
                 "right_columns_names:array<array<string>>>>>")


def _key_like(df: DataFrame, columns=None) -> list[str]:
    """Integer and text columns: the ones whose values can be compared as keys."""
    types = field_types(df)
    kinds = classes(df)
    cs = as_list(columns) or df.columns
    return [c for c in cs if kinds[c] == STRING or (kinds[c] == NUMERIC and isinstance(
        types[c], (T.ByteType, T.ShortType, T.IntegerType, T.LongType)))]


def _distinct_values(df: DataFrame, columns, table: str | None = None) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    out = df.select(F.inline(F.array(*rows))).filter(F.col("value").isNotNull()).distinct()
    return out if table is None else out.withColumn("table", F.lit(table))


def _hashed(values: DataFrame) -> DataFrame:
    return values.withColumn("value", F.unhex(F.md5("value")))


def _value_bytes(df: DataFrame):
    """Bytes of all values: a text's own, 8 for anything else."""
    kinds = classes(df)
    texts = [c for c in df.columns if kinds[c] == STRING]
    out = F.count(F.lit(1)) * F.lit(8 * (len(df.columns) - len(texts)))
    for c in texts:
        out = out + F.coalesce(F.sum(F.octet_length(col(c))), F.lit(0))
    return out.cast("bigint")


def _place(base: DataFrame, name):
    """Place of a column, given by name, in the base table (from 0)."""
    return F.create_map(*[x for i, c in enumerate(base.columns) for x in (F.lit(c), F.lit(i))])[name]


def find_joinable(
    base: DataFrame,
    candidates: dict[str, DataFrame],
    base_columns=None,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Containment of each base key column in each candidate column.

    ``containment = |values(base col) ∩ values(cand col)| / |values(base col)|``
    on distinct non-null values compared as text. Both sides are reduced to
    distinct ``(column, value)`` pairs before the join on ``value``, so the join
    emits one row per shared value and candidate column (never all pairs).
    Returns ``(dataset_name, left_column, right_column, n_base_values,
    n_shared_values, score, size, join_key)`` with ``score >= min_score``;
    ``size`` is the bytes of the table's values (8 a number or date, a text's own
    bytes), ``join_key`` the place of the base column in the base table. Values
    are compared by a 128-bit hash, so long texts are not shuffled.
    """
    bcols = _key_like(base, base_columns)
    left = _hashed(_distinct_values(base, bcols)).select(F.col("column").alias("left_column"), "value")
    n_base = left.groupBy("left_column").agg(F.count(F.lit(1)).alias("n_base_values"))
    right, sizes = None, None
    for name, df in candidates.items():
        cols_ = _key_like(df)
        if not cols_:
            continue
        r = _hashed(_distinct_values(df, cols_, name)).select(F.col("table").alias("dataset_name"),
                                                    F.col("column").alias("right_column"), "value")
        s = df.agg(_value_bytes(df).alias("size")).select(F.lit(name).alias("dataset_name"), "size")
        right = r if right is None else right.unionByName(r)
        sizes = s if sizes is None else sizes.unionByName(s)
    shared = (left.join(right, "value")
              .groupBy("left_column", "dataset_name", "right_column").agg(F.count(F.lit(1)).alias("n_shared_values")))
    out = shared.join(n_base, "left_column").join(sizes, "dataset_name")
    score = F.try_divide(F.col("n_shared_values").cast("double"), F.col("n_base_values"))
    return out.select("dataset_name", "left_column", "right_column", "n_base_values", "n_shared_values",
                      score.alias("score"), "size", _place(base, F.col("left_column")).alias("join_key")).filter(
        F.col("score") >= min_score)


def to_search_results(joinable: DataFrame) -> DataFrame:
    """J6 rows -> one search-result JSON document per base column and dataset
    (the shape a remote dataset search answers with): ``(left_column, join_key,
    json)``. A document holds as many results as the dataset has columns at
    most, however many datasets there are."""
    res = F.struct(
        F.concat_ws(".", "dataset_name", "right_column").alias("id"),
        F.col("score"),
        F.struct(F.col("dataset_name").alias("name"), F.col("size"),
                 F.lit(None).cast("string").alias("description")).alias("metadata"),
        F.struct(F.lit("join").alias("type"),
                 F.array(F.array(F.col("left_column"))).alias("left_columns_names"),
                 F.array(F.array(F.col("right_column"))).alias("right_columns_names")).alias("augmentation"),
    )
    return joinable.groupBy("left_column", "join_key", "dataset_name").agg(
        F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("right_column"), res.alias("r")))).getField("r")
                           .alias("results"))).alias("json")).drop("dataset_name")


def ingest_search_results(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """C4: search-result JSON -> flat catalog rows.

    Keeps ``augmentation.type = 'join'``; dataset name with spaces and ``/``
    turned into ``_``; missing description -> ``'N/A'``; key lists rendered as
    stringified lists (as the catalog file stores them). ``join_key`` is the
    index of the searched base column, from the column of that name (0 without
    it, a search by the first column).
    """
    key = col("join_key").cast("int") if "join_key" in docs.columns else F.lit(0)
    parsed = docs.select(F.from_json(col(json_col), SEARCH_SCHEMA).alias("d"), key.alias("join_key"))
    r = parsed.select(F.explode("d.results").alias("r"), "join_key").filter(F.col("r.augmentation.type") == "join")

    def listed(c):
        return F.concat(F.lit("['"), F.array_join(F.flatten(c), "', '"), F.lit("']"))

    return r.select(
        F.col("r.id").alias("id"),
        F.translate(F.col("r.metadata.name"), " /", "__").alias("dataset_name"),
        F.col("r.score").alias("score"),
        listed(F.col("r.augmentation.left_columns_names")).alias("left_columns_names"),
        listed(F.col("r.augmentation.right_columns_names")).alias("right_columns_names"),
        F.col("r.metadata.size").alias("size"),
        F.col("join_key"),
        F.coalesce(F.col("r.metadata.description"), F.lit("N/A")).alias("description"),
    )


def clean_key_names(catalog: DataFrame) -> DataFrame:
    """Strip ``[ ] ' "`` from stringified key lists; also give
    ``left_keys``/``right_keys`` as arrays so composite keys keep working."""
    out = catalog
    for c, k in (("left_columns_names", "left_keys"), ("right_columns_names", "right_keys")):
        clean = F.regexp_replace(col(c), "[\\[\\]'\"]+", "")
        out = out.withColumn(c, clean).withColumn(k, F.split(clean, ", *"))
    return out


def dedup_catalog(catalog: DataFrame, order=None) -> DataFrame:
    """One row per ``id``: highest score first, then the join key text
    (deterministic, unlike ``dropDuplicates``)."""
    order = order or [F.desc("score"), F.asc("left_columns_names"), F.asc("right_columns_names")]
    w = Window.partitionBy("id").orderBy(*order)
    return catalog.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")


def merge_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old + new, the old row wins per ``id``."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    return dedup_catalog(both, [F.asc("__src"), F.desc("score"), F.asc("left_columns_names")]).drop("__src")


def admit(catalog: DataFrame, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE,
          min_score: float = MIN_SCORE) -> DataFrame:
    """Size within bounds (inclusive) and score at least ``min_score``."""
    return catalog.filter(F.col("size").between(min_size, max_size) & (F.col("score") >= min_score))


def pending(catalog: DataFrame, present: DataFrame, name_col: str = "dataset_name") -> DataFrame:
    """Rows whose dataset is not already materialised."""
    return catalog.join(present.select(col(name_col).alias("dataset_name")).distinct(), "dataset_name", "left_anti")


def prune(catalog: DataFrame, present: DataFrame, name_col: str = "dataset_name") -> DataFrame:
    """Rows whose dataset is available."""
    return catalog.join(present.select(col(name_col).alias("dataset_name")).distinct(), "dataset_name", "left_semi")


def lookup_base(registry: DataFrame, name: str) -> DataFrame:
    """C11: the registry row of one base table."""
    return registry.filter(F.col("base_table_name") == name)


def register_base(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows (by name) to the registry."""
    return registry.unionByName(rows)


def next_table(catalog: DataFrame, policy: str = "catalog_desc", order_col: str | None = None) -> DataFrame:
    """The pool in visiting order, as ``rank`` (1 = next).

    ``catalog_desc`` takes the last catalog row first (the reference pops a
    list): ``order_col`` holds the place of a row in the catalog. Without it the
    last searched column comes first, by id.
    ``score`` takes the best score, ``size`` the smallest table; ties by id.
    """
    if policy == "catalog_desc":
        order = [-col(order_col)] if order_col else [-F.col("join_key"), F.col("id")]
    elif policy == "score":
        order = [-F.col("score"), F.col("id")]
    elif policy == "size":
        order = [F.col("size"), F.col("id")]
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return global_rank(catalog, order)


@dataclass(frozen=True)
class PoolEntry:
    """A catalog row as a table of the pool, opened when its turn comes."""

    name: str
    left_keys: tuple
    right_keys: tuple
    score: float | None
    size: int | None
    description: str | None
    open_table: Callable[[str], DataFrame]

    def table(self) -> TableRef:
        return TableRef(self.name, self.open_table(self.name), list(self.left_keys), list(self.right_keys), score=self.score,
                        size=self.size, description=self.description)


def load_pool(catalog: DataFrame, open_table: Callable[[str], DataFrame], available: DataFrame | None = None,
              policy: str = "catalog_desc", order_col: str | None = None, one_per_dataset: bool = True) -> list[PoolEntry]:
    """C3 + G5: the catalog's tables in visiting order, none of them opened yet.

    Rows of datasets that are not ``available`` (``dataset_name``) fall out; of a
    dataset's rows the best by score, then id, stays unless ``one_per_dataset``
    is off. Catalog rows reach the driver: they are what the loop is made of.
    """
    if available is not None:
        catalog = prune(catalog, available)
    if one_per_dataset:
        first = F.expr("row_number() OVER (PARTITION BY dataset_name ORDER BY score DESC, id)")
        catalog = catalog.withColumn("__best", first).filter(F.col("__best") == 1).drop("__best")
    ranked = next_table(clean_key_names(catalog), policy, order_col)
    rows = sorted(ranked.select("rank", "dataset_name", "left_keys", "right_keys", "score", "size", "description").collect())
    return [PoolEntry(r.dataset_name, tuple(r.left_keys), tuple(r.right_keys), r.score, r["size"], r.description, open_table)
            for r in rows]
