"""Best-fit packing of documents into fixed-length token sequences, with a
certificate.

Documents are tokenized in the tasks; only piece descriptions (id, start,
length, checksum) are shuffled, never ids. Pieces shorter than a sequence are
dealt to parts of bounded size; each part runs best-fit decreasing and computes
a lower bound of its bin count from dual-feasible functions. A part whose count
meets its bound is certified and final. The pieces of the other parts are dealt
anew among themselves and packed again, for as long as that saves a sequence.

Defined results: null and empty texts are documents of the end id only;
repeated rows are documents of their own; an empty table gives an empty result;
only the id and text columns are read.
"""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.llm.common import byte_level_encoder, slices

PIECES = "piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of whole texts by a byte-level BPE file.

    If the ids of the file follow the order of its merges, as such files mostly
    do, and it splits text by the usual pattern, the faster of two encoders gives
    the same ids; texts with a special token's string, texts that it refuses and
    other files go to the other one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            file = json.load(f)
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        self.fast = byte_level_encoder(file)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        for i, t in enumerate(texts):
            if not any(x in t for x in self.special) and (ids := self.fast(t)) is not None:
                out[i] = np.array(ids, dtype="<u4")
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest:
            encoded = self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False)
            for i, e in zip(rest, encoded):
                out[i] = np.array(e.ids, dtype="<u4")
        return out


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks that a worker runs."""
    return WordEncoder(path)


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of ``size`` but the first."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def token_pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                 text: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """One row per piece: id, piece, start, length, crc32 of its ids."""
    id_type = docs.schema[id_col].dataType

    def cut(batches):
        encoder = shared_encoder(vocabulary)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows, out = [], []
            for start, stop in slices(texts, batch_chars):
                for k, own in enumerate(encoder.encode([t or "" for t in texts[start:stop]]), start):
                    own = np.append(own, np.uint32(end_id))
                    for p, (s, n) in enumerate(piece_bounds(len(own), size)):
                        rows.append(k)
                        out.append((p, s, n, zlib.crc32(own[s:s + n].astype("<u4").tobytes())))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32())]
                + [pa.array(c, pa.int64()) for c in cols[1:]], [id_col, "piece", "start", "length", "ids_crc32"])

    schema = f"`{id_col}` {id_type.simpleString()}, {PIECES}"
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(cut, schema)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, bins) of lengths given in decreasing order.

    Open bins are stacks by what room they have left; one integer has a bit for
    each room that occurs, so the least sufficient room is one bit operation.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n = 0, 0
    for i, x in enumerate(lengths.tolist()):
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            own = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, own = size, n
            n += 1
        bins[i], offsets[i] = own, size - room
        if room > x:
            stacks[room - x].append(own)
            rooms |= 1 << (room - x)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Least number of bins that dual-feasible functions prove.

    Family 1, threshold k: lengths over size - k count as a whole bin, lengths
    under k as nothing, the rest as they are. Family 2, k: a length counts as
    floor((k + 1) x / size) k-ths of a bin, or as is where that divides.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    many, total = np.cumsum(count), np.cumsum(count * x)
    best = -(-int(total[-1]) // size)
    k = np.arange(1, size // 2 + 1)
    large = many[-1] - many[size - k]
    middle = total[size - k] - total[k - 1]
    best = max(best, int((-(-(large * size + middle) // size)).max()))
    for k in range(1, 100):
        whole = (k + 1) * x % size == 0
        twice = np.where(whole, x * k, (k + 1) * x // size * size)  # in units of 1 / (size * k)
        best = max(best, -(-int((count * twice).sum()) // (size * k)))
    return best


def _bins():
    """Number of sequences: each has one piece at its start."""
    return F.coalesce(F.sum((F.col("offset") == 0).cast("int")), F.lit(0)).alias("bins")


def pack(pieces: DataFrame, size: int = 2048, part_pieces: int = 20_000, rounds: int | None = None) -> DataFrame:
    """Add sequence_id and offset to rows that have ``length`` (1 to size).

    No sequence is shared by two parts; numbers of sequences are any longs.
    Parts with a gap exchange pieces for as long as that saves a sequence, or
    ``rounds`` times if that is given.
    """
    from widen.session import checkpoint_dir

    checkpoint_dir(pieces.sparkSession)
    columns = pieces.columns
    # the checkpoint fixes row numbers: they identify rows, also equal ones
    rows = pieces.checkpoint().withColumn("__row", F.monotonically_increasing_id())
    full = rows.where(F.col("length") >= size).select(
        *columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def packed_part(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "__row"], ascending=[False, True])
        x = part["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(x, size)
        return part.assign(__bin=bins, offset=offsets, __gap=n - lower_bound(x, size))

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in
                                                  ("__part", "__bin", "offset", "__gap"))])

    def deal(part_rows: DataFrame, n: int, k: int) -> DataFrame:
        parts = max(1, -(-n // part_pieces))
        return (part_rows.withColumn("__part", F.pmod(F.xxhash64("__row", F.lit(k)), F.lit(parts)))
                .groupBy("__part").applyInPandas(packed_part, schema).checkpoint())

    def numbered(df: DataFrame, k: int) -> DataFrame:
        seq = F.lit(k << 56) + F.shiftleft("__part", 28) + F.col("__bin")
        return df.select(*columns, seq.alias("sequence_id"), "offset")

    def state(df: DataFrame):
        # one row: pieces and sequences of the parts with a gap
        return df.where("__gap > 0").agg(F.count("*").alias("n"), _bins()).first()

    open_rows = rows.where(F.col("length") < size)
    packed, done, generation = deal(open_rows, open_rows.count(), 0), full, 0
    while rounds is None or generation < rounds:
        s = state(packed)
        if not s.n:
            break
        again = deal(packed.where("__gap > 0").select(*columns, "__row"), s.n, generation + 1)
        if again.agg(_bins()).first().bins >= s.bins:
            break
        done = done.unionByName(numbered(packed.where("__gap <= 0"), generation))
        packed, generation = again, generation + 1
    return done.unionByName(numbered(packed, generation))


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text: str = "text", part_pieces: int = 20_000, rounds: int | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(token_pieces(docs, vocabulary, size, end_id, id_col, text), size, part_pieces, rounds)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, vocabulary_path("byte_bpe_50k.json"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}
