"""Source divergence audit: how far the sources of a language differ in words.

Each source of a language, and the language as a whole, gives every kept term
(one in at least ``min_docs`` documents of the language) a smoothed share p in
whole billionths; a pair of shares p, q has the divergence
f = floor((p - q)^2 / (p + q)). Two sources are compared by the sum of f over
all kept terms, a source with its language by the terms that it has more of.

Pairs are summed over run-length columns: the vocabulary of a language is dealt
to chunks of bounded size; in a chunk the terms are reordered by their counts,
so that equal counts stand together, the counts of each source become runs, and
a pair of sources costs one step per piece that the boundaries of both leave:
f of the two shares times the length. Terms that neither source of a block of
pairs has are one run more, known from the size of the vocabulary alone.

All arithmetic is on whole numbers, so results do not depend on the order of
sums. Shares need 10^9 times a count: beyond 64 bits that is done on Python
integers or decimals.

Defined results: null text, language and source count as ''; a text without
terms adds to no count but its group occurs; repeated rows count each; very
long texts are read piece by piece; a language without kept terms has only
pairs of value 0; a language of one source has no pairs; an empty table gives
an empty result; only the three named columns are read, whatever others there
are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells (terms x sources) of a chunk's dense counts, which a task holds.
CHUNK_CELLS = 250_000
#: Sources of one side of a block of pairs.
SOURCE_BLOCK = 256
#: Entries of a task's term counts before they are handed on.
HELD_TERMS = 150_000
#: Bytes of a text that are split at a time.
TEXT_BYTES = 4_000_000
BILLION = 1_000_000_000
# Bytes that belong to terms; A-Z are lower-cased, all others end a term.
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

RESULT = "lang string, source string, part string, item string, value long, rank int"


def text_terms(raw: bytes):
    """Lists of the terms of a text in UTF-8, a bounded stretch at a time."""
    start = 0
    while start < len(raw):
        stop = min(len(raw), start + TEXT_BYTES)
        piece = raw[start:stop].translate(_TERM_BYTES)
        if stop < len(raw):
            cut = piece.rfind(b" ")
            while cut < 0 and stop < len(raw):  # one term so far
                more = raw[stop:stop + TEXT_BYTES].translate(_TERM_BYTES)
                stop += len(more)
                cut = more.rfind(b" ")
                cut = cut if cut < 0 else len(piece) + cut
                piece += more
            if cut >= 0 and stop < len(raw):
                piece, stop = piece[:cut], start + cut + 1
        yield piece.split()
        start = stop


def _counted(batches):
    """(lang, source, term, n, docs) of the batches of a task, summed as long
    as they fit."""
    held: dict = {}
    size = 0

    def out():
        for (lang, source), (counts, in_docs) in held.items():
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(counts, pa.binary(), size=n),
                 pa.array(counts.values(), pa.int64(), size=n), pa.array(map(in_docs.__getitem__, counts), pa.int64(), size=n)],
                ["lang", "source", "term", "n", "docs"])
            counts.clear()

    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, b.column(2)):
            group = held.get((lang, source))
            if group is None:
                group = held[lang, source] = Counter(), Counter()
            counts, in_docs = group
            before, distinct = len(counts), set()
            for terms in text_terms(text.as_py()):
                counts.update(terms)
                distinct.update(terms)
            in_docs.update(distinct)
            size += len(counts) - before
            if size > HELD_TERMS:
                yield from out()
                held, size = {}, 0
    yield from out()


def _filled(name: str):
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), partial sums of
    the tasks."""
    rows = docs.select(_filled(lang).alias("lang"), _filled(source).alias("source"),
                       _filled(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return counted.withColumn("term", F.col("term").cast("string"))


def kept_terms(counts: DataFrame, min_docs: int = 10) -> DataFrame:
    """lang, term, total and cells (source, n) of the terms in at least
    ``min_docs`` documents of their language: one row per kept term.

    One shuffle by (lang, term): both sums and the cells are made where the
    rows of a term meet. A term has one cell per source of its language."""
    by_term = (counts.repartition("lang", "term").groupBy("lang", "term", "source")
               .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return (by_term.groupBy("lang", "term")
            .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"),
                 F.collect_list(F.struct("source", "n")).alias("cells"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "total", "cells"))


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """Smoothed shares of counts, in billionths."""
    if len(counts) and int(counts.max()) + 2 > 9 * BILLION:
        return np.array([1 + BILLION * (int(c) + 2) // (n + 2 * v) for c in counts], np.int64)
    return 1 + BILLION * (counts.astype(np.int64) + 2) // max(1, n + 2 * v)


def run_columns(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, counts) of the runs of each row of a sources x terms matrix,
    after its terms were ordered by their counts, first source first."""
    if not matrix.shape[1]:
        return [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in matrix]
    order = np.lexsort(matrix[::-1])
    out = []
    for row in matrix:
        own = row[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out.append((starts, own[starts]))
    return out


def pair_sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], terms: int) -> int:
    """Sum of f over the pieces of two run-length columns of shares."""
    cuts = np.union1d(a[0], b[0])
    if not len(cuts):
        return 0
    p = a[1][np.searchsorted(a[0], cuts, "right") - 1]
    q = b[1][np.searchsorted(b[0], cuts, "right") - 1]
    lengths = np.diff(np.append(cuts, terms))
    return int(((p - q) ** 2 // (p + q) * lengths).sum())


def _pairs_of_block(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """lang, a, b, value, covered of every pair of sources of one block, over
    the terms of one chunk that a source of the block has."""
    lang, _, left, right = (k.as_py() for k in key)
    sources = sorted(zip(groups["source"].to_pylist(), groups["n"].to_pylist(), groups["side"].to_pylist(),
                         groups["v"].to_pylist()))
    at = {s: i for i, (s, _, _, _) in enumerate(sources)}
    matrix = np.zeros((len(sources), terms.num_rows), np.int64)
    if terms.num_rows:
        cells = terms["cells"].combine_chunks()
        owner = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
        flat = cells.flatten()
        names = flat.field("source").dictionary_encode()
        rows = np.array([at[s] for s in names.dictionary.to_pylist()])[names.indices.to_numpy(zero_copy_only=False)]
        matrix[rows, owner] = flat.field("n").to_numpy(zero_copy_only=False)
    columns = [(starts, shares(counts, n, v)) for (starts, counts), (_, n, _, v) in
               zip(run_columns(matrix), sources)]
    out = [(lang, sa, sb, pair_sum(columns[i], columns[j], terms.num_rows), terms.num_rows)
           for i, (sa, _, side_a, _) in enumerate(sources) for j, (sb, _, side_b, _) in enumerate(sources)
           if (i < j if left == right else side_a == left and side_b == right)]
    cols = list(zip(*out)) or [()] * 5
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "a", "b", "value", "covered"])


def _share(n: str, total: str = "n_sum", v: str = "v"):
    """The smoothed share in SQL, in decimals as 10^9 times a count may exceed 64 bits."""
    return F.expr(f"CAST(1 + (CAST({BILLION} AS DECIMAL(19,0)) * ({n} + 2)) DIV ({total} + 2 * {v}) AS BIGINT)")


_F = "(p - q) * (p - q) DIV (p + q)"


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, lang: str = "lang", source: str = "source",
                      text: str = "text", chunk_cells: int = CHUNK_CELLS, block: int = SOURCE_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank.

    part ``pair``: every other source of the language, by the sum of f, all
    ranks. part ``term``: the ``top`` kept terms that the source has more of
    than its language, by f. Ties by item in the order of UTF-8.

    What one task holds: a chunk of ``chunk_cells`` cells; blocks of about
    ``block`` x ``block`` pairs. No column of a hot source or language is held
    whole: both only have more chunks.
    """
    from widen.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    terms = kept_terms(term_counts(docs, lang, source, text), min_docs).checkpoint()
    sums = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(
        F.sum("c.n").alias("n_sum"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_sum"))
    # a scan of two columns; sources without terms are groups too
    groups = (docs.select(_filled(lang).alias("lang"), _filled(source).alias("source")).distinct()
              .join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                          for c in ("n_sum", "v", "lang_sum"))).checkpoint())

    # one row per language: how its sources fall into blocks and its terms into chunks
    plan = (groups.groupBy("lang").agg(F.count("*").alias("g"), F.max("v").alias("v"), F.max("lang_sum").alias("lang_sum"))
            .withColumn("blocks", F.ceil(F.col("g") / F.lit(block)).cast("int"))
            .withColumn("chunks", F.greatest(F.lit(1), F.ceil(
                F.col("v") * F.least("g", F.lit(2 * block)) / F.lit(chunk_cells)).cast("int"))))
    side = F.expr("pmod(xxhash64(source), blocks)").cast("int")
    pairs_of_blocks = F.expr("filter(flatten(transform(sequence(0, blocks - 1), i -> transform(sequence(0, blocks - 1), "
                             "j -> struct(i AS left, j AS right)))), x -> x.left <= x.right)")
    dealt = (terms.join(plan.select("lang", "blocks", "chunks"), "lang")
             .select("lang", F.expr("pmod(xxhash64(term), chunks)").cast("int").alias("chunk"), "cells", "blocks",
                     F.explode(pairs_of_blocks).alias("x"))
             .select("lang", "chunk", F.col("x.left").alias("left"), F.col("x.right").alias("right"),
                     F.expr("filter(cells, c -> pmod(xxhash64(c.source), blocks) IN (x.left, x.right))").alias("cells"))
             .where(F.size("cells") > 0))
    sides = (groups.join(plan.select("lang", "blocks", "chunks"), "lang").withColumn("side", side)
             .select("lang", "source", F.col("n_sum").alias("n"), "v", "side", F.explode(pairs_of_blocks).alias("x"),
                     "chunks")
             .where("side IN (x.left, x.right)")
             .select("lang", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.col("x.left").alias("left"),
                     F.col("x.right").alias("right"), "source", "n", "v", "side"))
    sides = sides.toDF(*sides.columns)  # columns of its own, as both sides stem from one table
    keys = ["lang", "chunk", "left", "right"]
    parts = (dealt.groupBy(*keys).cogroup(sides.groupBy(*keys))
             .applyInArrow(_pairs_of_block, "lang string, a string, b string, value long, covered long"))
    n = groups.select("lang", "source", "n_sum", "v")
    # terms that no source of the block has are one more run: both counts are 0
    pairs = (parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))
             .join(n.select("lang", F.col("source").alias("a"), F.col("n_sum").alias("na"), "v"), ["lang", "a"])
             .join(n.select("lang", F.col("source").alias("b"), F.col("n_sum").alias("nb")), ["lang", "b"])
             .withColumn("p", F.when(F.col("v") > 0, _share("0", "na"))).withColumn("q", F.when(F.col("v") > 0, _share("0", "nb")))
             .withColumn("value", F.col("value") + F.coalesce(F.expr(_F) * (F.col("v") - F.col("covered")), F.lit(0))))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                  F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"),
                        "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    own = (terms.join(plan.select("lang", "v", "lang_sum"), "lang")
           .select("lang", "term", F.explode("cells").alias("c"), _share("total", "lang_sum").alias("q"))
           .select("lang", F.col("c.source").alias("source"), "term", F.col("c.n").alias("n"), "q")
           .join(n, ["lang", "source"]).where("n > 0").withColumn("p", _share("n")).where("p > q")
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_F).alias("value")))
    order = "row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)"
    own = own.withColumn("rank", F.expr(order)).where(F.col("rank") <= top)
    return both.withColumn("rank", F.expr(order)).unionByName(own).select(
        *[F.col(f.split()[0]).cast(f.split()[1]) for f in RESULT.split(", ")])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLES = {"op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                  coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_sum FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term
      GROUP BY w.lang, w.source, w.term),
s AS (SELECT lang, source, sum(n) AS n_sum FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n_sum, 0) + 2 * v.v) AS p,
             1 + (1000000000::HUGEINT * (k.total + 2)) // (v.lang_sum + 2 * v.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
      LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM o WHERE part = 'pair' OR rank <= 10
"""}
