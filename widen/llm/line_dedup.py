"""Repeated passages of lines, found by winnowing and deleted but for the first.

A gram is the shortest run of lines from a line on that has ``gram_words`` words;
a window is the shortest run from a line on, or up to a line, that has
``window_words``. Marks are all windows, and of each window from a line on the
gram with the least hash (the last of equals). Each mark is joined to its first
place, the match is extended line by line both ways, and the lines of the later
run are deleted. A deleted line always equals an earlier one, so the first copy
of everything stays.

Every line of a passage of ``window_words`` words or more is in a window that the
passage holds whole: in that from its first line on or, behind it, in the one up
to the line itself. What a window is depends on its lines alone, so each copy of
the passage has the same ones, and each meets an equal earlier one whichever
document that is: no line of a later copy is missed. Of shorter passages those
with a chosen gram on both sides are found too.

Documents are ordered by id, lines by place. Lines are compared without white
space around them; blank lines are no lines and stay where they are.

Defined results: a null text stays null and has no lines; an empty one stays
empty; rows that repeat both id and text are one document and get one result,
rows that repeat only the id are documents of their own; null ids come first; an
empty table gives an empty result; other columns are kept, and a column that has
the name of a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.llm.common import without


def line_table(text: str | None) -> tuple[list[int], list[int]]:
    """Hashes (signed 64-bit) and word counts of the lines of a text."""
    lines = [x.strip() for x in (text or "").split("\n")]
    lines = [x for x in lines if x]
    return ([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines], [len(x.split()) for x in lines])


def _stretches(words: list[int], least: int) -> list[int]:
    """For every line the end of the shortest run from it with ``least`` words
    (one past it), or 0 if the text ends before."""
    total = np.r_[0, np.cumsum(words)]
    end = np.searchsorted(total, total[:-1] + least)
    return np.where(end <= len(words), end, 0).tolist()


def fingerprints(hashes: list[int], words: list[int], gram_words: int, window_words: int) -> list[tuple[int, int]]:
    """(hash, first line) of the windows and the selected grams."""
    if not hashes:
        return []
    gram_end, window_end = _stretches(words, gram_words), _stretches(words, window_words)
    raw = np.array(hashes, np.int64).tobytes()
    total = np.r_[0, np.cumsum(words)]
    start = np.searchsorted(total, total[1:] - window_words, side="right") - 1  # of the window up to a line
    windows = {(s, e) for s, e in enumerate(window_end) if e} | {
        (s, e) for e, s in enumerate(start.tolist(), 1) if s >= 0}
    grams = [xxhash.xxh3_64_intdigest(raw[8 * s:8 * e]) - (1 << 63) if e else None for s, e in enumerate(gram_end)]
    chosen = set()
    best: list[int] = []  # starts of grams that may still be least, hashes rising
    nxt = 0
    for s, stop in enumerate(window_end):
        if not stop:
            break  # later windows reach beyond the text too
        while nxt < len(grams) and gram_end[nxt] and gram_end[nxt] <= stop:
            while best and grams[best[-1]] >= grams[nxt]:
                best.pop()
            best.append(nxt)
            nxt += 1
        while best and best[0] < s:
            best.pop(0)
        if best:
            chosen.add(best[0])
    marks = {(s, grams[s]) for s in chosen} | {
        (s, xxhash.xxh3_64_intdigest(raw[8 * s:8 * e]) - (1 << 63)) for s, e in windows}
    return [(h, s) for s, h in sorted(marks)]


def extend(own, other, shift: int, starts: list[int]) -> list[tuple[int, int]]:
    """Runs (first line, one past the last) around ``starts`` where line i of
    ``own`` equals line i - shift of ``other``."""
    own, other = np.asarray(own, np.int64), np.asarray(other, np.int64)
    low, high = max(0, shift), min(len(own), len(other) + shift)
    if high <= low:
        return []
    # places of lines that differ; a run is what lies between two of them
    apart = np.flatnonzero(own[low:high] != other[low - shift:high - shift]) + low
    at = np.unique(np.array([s for s in starts if low <= s < high], np.int64))
    k = np.searchsorted(apart, at)
    differs = np.isin(at, apart)
    first = np.r_[low - 1, apart][k][~differs] + 1
    last = np.r_[apart, high][k][~differs]
    return list(dict.fromkeys(zip(first.tolist(), last.tolist())))


def _described(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [line_table(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([h for h, _ in rows], pa.list_(pa.int64())),
                 pa.array([w for _, w in rows], pa.list_(pa.int32()))], ["doc", "id", "lines", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(_key(id_col, text).alias("doc"), F.col(id_col).alias("id"), F.col(text)).mapInArrow(
        run, f"doc binary, id {kind}, lines array<long>, words array<int>")


def _marks(described: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """(doc, id, mark, at) of all documents. Made anew for each use: the marks
    are more bytes than the lines that they come from."""
    def run(batches):
        for b in batches:
            found = [fingerprints(h, w, gram_words, window_words)
                     for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array([h for f in found for h, _ in f], pa.int64()),
                 pa.array([s for f in found for _, s in f], pa.int32())], ["doc", "id", "mark", "at"])

    kind = described.schema["id"].dataType.simpleString()
    return described.select("doc", "id", "lines", "words").mapInArrow(
        run, f"doc binary, id {kind}, mark long, at int")


def _key(id_col: str, text: str):
    """One key of 128 bits for rows of equal id and text."""
    return F.unhex(F.md5(F.to_json(F.struct(F.col(id_col).alias("id"), F.sha2(F.col(text), 256).alias("text")))))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram_words: int = 25,
                  window_words: int = 50) -> DataFrame:
    """(doc, runs): for each document that has any, the runs of its lines that
    repeat earlier ones, as (first, past) structs; doc is its key."""
    from widen.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    # rows of equal id and text are one document
    described = (_described(docs, id_col, text).where(F.size("lines") > 0).groupBy("doc")
                 .agg(*[F.first(c).alias(c) for c in ("id", "lines", "words")]).checkpoint())
    marks = _marks(described, gram_words, window_words)
    # a mark that many documents have is one row a task before the shuffle
    first = (marks.groupBy("mark").agg(F.min(F.struct("id", "doc", "at")).alias("f"), F.count("*").alias("n"))
             .where("n > 1").select("mark", F.col("f.doc").alias("other"), F.col("f.at").alias("other_at")))
    hits = (marks.join(first, "mark").where("doc <> other OR at <> other_at")
            .select("doc", "other", F.col("at"), (F.col("at") - F.col("other_at")).alias("shift")))
    # one row a pair of documents: the lines of both are sent once, however many shifts there are
    runs = (hits.groupBy("doc", "other", "shift").agg(F.sort_array(F.collect_set("at")).alias("starts"))
            .groupBy("doc", "other").agg(F.collect_list(F.struct("shift", "starts")).alias("shifts"),
                                         F.min("shift").alias("least"), F.max("shift").alias("most")))
    lines = described.select("doc", "lines")
    ends = lines.select(F.col("doc").alias("other"), F.col("lines").alias("other_lines"))
    # of the other document only the lines beside this one's are kept
    low = F.greatest(F.lit(0), -F.col("most"))
    both = (runs.join(lines, "doc").join(ends, "other")
            .select("doc", "lines", "shifts", low.alias("low"),
                    F.slice("other_lines", low + 1, F.greatest(F.lit(0), F.least(
                        F.size("lines") - F.col("least"), F.size("other_lines")) - low)).alias("beside")))

    def run(batches):
        for b in batches:
            doc, first, past = [], [], []
            own, beside = b.column(1), b.column(4)
            for i, (d, shifts, low) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3)))):
                x, y = (c[i].values.to_numpy(zero_copy_only=False) for c in (own, beside))
                # what one row finds is joined: runs of many shifts may be the same lines
                covered = np.zeros(len(x) + 1, np.int32)
                for s in shifts:
                    for start, stop in extend(x, y, s["shift"] + low, s["starts"]):
                        covered[start] += 1
                        covered[stop] -= 1
                inside = np.diff(np.r_[0, (np.cumsum(covered) > 0).astype(np.int8)])
                for start, stop in zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist()):
                    doc.append(d)
                    first.append(start)
                    past.append(stop)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.binary()), pa.array(first, pa.int32()),
                                              pa.array(past, pa.int32())], ["doc", "first", "past"])

    found = both.mapInArrow(run, "doc binary, first int, past int")
    return found.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("first", "past"))).alias("runs"))


def delete_lines(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """Text without the lines of the runs, and how many those are."""
    drop = {i for a, b in runs for i in range(a, b)}
    out, n = [], 0
    for x in text.split("\n"):
        if x.strip():
            if n not in drop:
                out.append(x)
            n += 1
        else:
            out.append(x)
    return "\n".join(out), len(drop)


def row_key(id_col: str, text: str):
    """One key for rows of equal id and text, for use outside of this module."""
    return _key(id_col, text)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram_words: int = 25,
               window_words: int = 50) -> DataFrame:
    """Input columns, the text without repeated passages, and n_deleted."""
    docs = without(docs, ["n_deleted"])
    runs = repeated_runs(docs, id_col, text, gram_words, window_words)
    # input columns travel in one struct, so that their names meet no others
    packed = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("x"),
                         _key(id_col, text).alias("doc"))
    rows = packed.join(runs, "doc", "left").select("x", "runs")
    place, names = docs.columns.index(text), [*docs.columns, "n_deleted"]

    def run(batches):
        for b in batches:
            columns = b.column(0).flatten()
            texts, counts = [], []
            for t, r in zip(columns[place].to_pylist(), b.column(1).to_pylist()):
                done = (t, 0) if t is None or not r else delete_lines(t, [(x["first"], x["past"]) for x in r])
                texts.append(done[0])
                counts.append(done[1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names)

    schema = T.StructType([*docs.schema.fields, T.StructField("n_deleted", T.LongType())])
    return rows.mapInArrow(run, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_deleted", F.length("text").cast("long").alias("n_chars"),
                                   F.md5("text").alias("text_md5"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES: dict[str, str] = {}
