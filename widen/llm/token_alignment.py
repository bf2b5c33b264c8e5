"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A blank and the text is encoded by a byte-level vocabulary (A), the text by a
SentencePiece model (B), which adds the blank itself. Both token lists cover
the same bytes; where tokens of both end, the text falls into groups, and
tokens whose byte ranges overlap are linked. Over all documents, each pair of
ids is counted by the documents that hold it linked.

Ends are intersected by galloping: the list with fewer ends drives, and each of
its ends is found in the longer list by steps that double until they pass it,
then by halving; the ends of many stretches of text search at once. The rank found says where a token of the
shorter list stops among those of the longer one, so differences of ranks are
the ranges of overlapping tokens, and ranks of equal ends slice the groups.

No token of either list spans a blank that starts a run of blanks and is beside
a character that is no white space, so every such place is a common end; what
lies between is aligned once and, if it recurs, kept in a bounded cache.

The documents are read twice: for the counts, and for the results, which need
counts of all documents. Pair counts are bounded by the vocabularies and not by
the documents; they are broadcast if there are few enough (checked), and joined
to the documents' pairs by a shuffle if not.

Defined results: null and empty texts have no tokens, and neither have texts
whose bytes a model does not keep (such as those with U+2581): all counts are 0
and the groups are ''. Repeated rows count as documents each; an empty table
gives an empty result; very long texts are cut at blanks, and a stretch without
blanks is aligned whole. Other columns are kept, whatever their names, but the
text; one that has the name of a result column is replaced.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.llm.common import Kept, byte_level_encoder, byte_level_entries, slices

BLANK = "▁"
#: Bound of each generation of the caches of a worker, in stretches.
CACHE = 250_000
#: Longer stretches are aligned but not kept.
CACHED_CHARS = 64
#: Most pairs of ids whose counts are broadcast (24 bytes each).
BROADCAST_PAIRS = 4_000_000
#: Pairs that a task sums before it hands them on.
HELD_PAIRS = 2_000_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Characters of stretches that are encoded by one call.
BLOCK_CHARS = 20_000
_ODD_BLANK = re.compile(r" \s")


def gallop(ends: np.ndarray, start: np.ndarray, last: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``ends`` the place in ``long`` of the first value that is not
    less, searched from ``start`` to ``last``, whose value never is less.

    All ends search at once: steps double until they pass the end, then the
    stretch that holds it is halved."""
    low = start - 1  # what stands there is less
    step = np.ones_like(low)
    going = np.arange(len(ends))
    while len(going):
        probe = low[going] + step[going]
        less = (probe < last[going]) & (long[np.minimum(probe, last[going])] < ends[going])
        going, probe = going[less], probe[less]
        low[going] = probe
        step[going] *= 2
    high = np.minimum(low + step, last)
    going = np.flatnonzero(high - low > 1)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        less = long[middle] < ends[going]
        low[going[less]] = middle[less]
        high[going[~less]] = middle[~less]
        going = going[high[going] - low[going] > 1]
    return high


def align_ends(short: np.ndarray, at_short: np.ndarray, long: np.ndarray, at_long: np.ndarray):
    """(left, right, common) of stretches: ``short`` and ``long`` are ends that
    increase over all stretches, ``at_short`` and ``at_long`` the places where
    each stretch begins, and the end of the last. left and right are places in
    both that overlap, common whether an end of ``short`` is one of ``long``,
    with the place there."""
    n = np.diff(at_short)
    owner = np.repeat(np.arange(len(n)), n)
    rank = gallop(short, at_long[:-1][owner], at_long[1:][owner] - 1, long)
    common = long[rank] == short
    first = np.empty_like(rank)
    first[1:] = rank[:-1] + common[:-1]  # of a new stretch: where it begins, as stretches end together
    first[:1] = at_long[0]
    count = rank - first + 1  # differences of ranks are the overlapped ranges
    left = np.repeat(np.arange(len(short)), count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return left, right, common, rank


class Aligner:
    """Both vocabularies, and the alignment of stretches of text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a) as f:
            file = json.load(f)
        ranks = byte_level_entries(file)
        self.fast_a, self.slow_a = byte_level_encoder(file), Tokenizer.from_file(path_a)
        self.slow_a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for e, i in ranks.items():
            self.bytes_a[i] = e
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace(BLANK, " ").encode())
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in xs]) for xs in (self.bytes_a, self.bytes_b))
        # a token as text before another of its side, before the other side, and before the next group
        self.shown = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"]
        self.pair_cache = Kept(CACHE, CACHED_CHARS)

    def encode_a(self, text: str) -> list[int]:
        ids = self.fast_a(text)
        return self.slow_a.encode(text, add_special_tokens=False).ids if ids is None else ids

    @staticmethod
    def stretches(text: str) -> list[str]:
        """Stretches of a blank and the text, each without its first blank."""
        if text[0] != " " and text[-1] != " " and not _ODD_BLANK.search(text):
            return text.split(" ")
        whole, cuts = " " + text, [0]
        for m in re.finditer(r"(?<! ) ", whole):
            i = m.start()
            if i and (not whole[i - 1].isspace() or i + 1 < len(whole) and not whole[i + 1].isspace()):
                cuts.append(i)
        return [whole[i + 1:j] for i, j in zip(cuts, [*cuts[1:], len(whole)])]

    def ids_b(self, stretches: list[str]) -> list[list[int]]:
        """Ids of blank and stretch; the model adds one blank, but to nothing."""
        found = self.b.encode(stretches, num_threads=1)
        for k, s in enumerate(stretches):
            if not s:
                found[k] = [self.b.piece_to_id(BLANK)]
        return found

    def _plain(self, s: str) -> bool:
        """Whether no token goes beyond the stretch in a row of such stretches."""
        return bool(s) and not s[0].isspace() and not s[-1].isspace() and BLANK not in s

    def _encoded(self, stretches: list[str]):
        """(good, ids_a, at_a, ids_b, at_b) of stretches one by one."""
        lists_a = [self.encode_a(" " + s) for s in stretches]
        lists_b = self.ids_b(stretches)
        good = [all(b"".join([parts[i] for i in ids]) == b" " + s.encode()
                    for ids, parts in ((a, self.bytes_a), (b, self.bytes_b)))
                for s, a, b in zip(stretches, lists_a, lists_b)]
        flat, at = [], []
        for lists in (lists_a, lists_b):
            own = [x if g else [] for x, g in zip(lists, good)]
            flat.append(np.array([i for x in own for i in x], np.int64))
            at.append(np.array([len(x) for x in own], np.int64))
        return np.array(good, bool), flat[0], at[0], flat[1], at[1]

    def _encoded_row(self, stretches: list[str]):
        """The same for plain stretches, by one call for all of them."""
        row = " ".join(stretches)
        raw = (" " + row).encode()
        ids_a, ids_b = self.encode_a(" " + row), self.b.encode(row)
        if any(b"".join([parts[i] for i in ids]) != raw for ids, parts in ((ids_a, self.bytes_a), (ids_b, self.bytes_b))):
            return self._encoded(stretches)
        stops = np.cumsum(np.array([len(s.encode()) + 1 for s in stretches]))
        out = []
        for ids, sizes in ((np.array(ids_a, np.int64), self.sizes_a), (np.array(ids_b, np.int64), self.sizes_b)):
            at = np.searchsorted(np.cumsum(sizes[ids]), stops) + 1
            out += [ids, np.diff(np.append(0, at))]
        return np.ones(len(stretches), bool), *out

    def align(self, stretches: list[str]):
        """Alignment of all stretches together: (good, ids_a, at_a, ids_b, at_b,
        links, at_links, groups), where places ``at`` begin each stretch; links
        are packed id pairs, groups (tokens of A, tokens of B) behind each
        common end. Stretches whose bytes a model does not keep are not good and
        hold nothing."""
        parts, start = [], 0
        while start < len(stretches):
            stop, chars = start, 0
            plain = self._plain(stretches[start])
            while stop < len(stretches) and (stop == start or chars < BLOCK_CHARS and self._plain(stretches[stop]) == plain):
                chars += len(stretches[stop])
                stop += 1
            parts.append((self._encoded_row if plain else self._encoded)(stretches[start:stop]))
            start = stop
        if not parts:
            parts = [self._encoded([])]
        good, ids_a, n_a, ids_b, n_b = map(np.concatenate, zip(*parts))
        at_a, at_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        less_a = np.diff(at_a) <= np.diff(at_b)
        links, link_owner, group_a, group_b = [], [], [], []
        for swap, of in ((False, good & less_a), (True, good & ~less_a)):
            (ends_s, at_s), (ends_l, at_l) = ((ends_b, at_b), (ends_a, at_a)) if swap else ((ends_a, at_a), (ends_b, at_b))
            own = np.flatnonzero(of)
            if not len(own):
                continue
            place_s, place_l = _ranges(at_s[own], at_s[own + 1]), _ranges(at_l[own], at_l[own + 1])
            left, right, common, rank = align_ends(ends_s[place_s], np.cumsum([0, *np.diff(at_s)[own]]),
                                                   ends_l[place_l], np.cumsum([0, *np.diff(at_l)[own]]))
            a, b = (place_l[right], place_s[left]) if swap else (place_s[left], place_l[right])
            links.append(ids_a[a] << 32 | ids_b[b])
            link_owner.append(np.searchsorted(at_s, place_s[left], "right") - 1)
            ga, gb = (place_l[rank[common]], place_s[common]) if swap else (place_s[common], place_l[rank[common]])
            group_a.append(ga)
            group_b.append(gb)
        empty = [np.empty(0, np.int64)]
        links, link_owner = np.concatenate(links + empty), np.concatenate(link_owner + empty)
        order = np.argsort(link_owner, kind="stable")
        at_links = np.searchsorted(link_owner[order], np.arange(len(stretches) + 1))
        groups = np.sort(np.concatenate(group_a + empty)) + 1, np.sort(np.concatenate(group_b + empty)) + 1
        return good, ids_a, at_a, ids_b, at_b, links[order], at_links, groups

    def linked_pairs(self, stretches: list[str]) -> list[bytes | None]:
        """Packed id pairs of all links of each stretch."""
        good, *_, links, at, _ = self.align(stretches)
        raw, cuts = links.tobytes(), (8 * at).tolist()
        return [raw[i:j] if g else None for g, i, j in zip(good.tolist(), cuts, cuts[1:])]

    def described(self, stretches: list[str], scores) -> list[tuple[str, bytes, bytes] | None]:
        """(groups, packed counts, packed pairs) of each stretch. ``scores``
        gives the counts of pairs and whether they are the best of their A id."""
        good, ids_a, at_a, ids_b, at_b, links, at, (stop_a, stop_b) = self.align(stretches)
        n, best = scores(links)
        count_sum, n_best = (np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[at] for v in (n, best))
        first = np.searchsorted(stop_a, at_a[:-1], "right")
        last = np.searchsorted(stop_a, at_a[1:], "right")
        numbers = np.stack([np.diff(at_a), np.diff(at_b), last - first, np.diff(at), np.diff(n_best), np.diff(count_sum)], 1)
        # tokens in the order of the text of groups: A before B in each group
        n_a, n_b = len(ids_a), len(ids_b)
        mark_a, mark_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        mark_a[stop_a - 1], mark_b[stop_b - 1] = 1, 2
        group_of_a = np.searchsorted(stop_a, np.arange(n_a), "right")
        group_of_b = np.searchsorted(stop_b, np.arange(n_b), "right")
        before = np.concatenate([[0], stop_b])  # tokens of B before each group
        text = np.empty(n_a + n_b, np.int64)
        text[np.arange(n_a) + before[group_of_a]] = 3 * ids_a + mark_a
        text[np.arange(n_b) + np.append(stop_a, n_a)[group_of_b]] = 3 * ids_b + mark_b
        shown = [self.shown[i] for i in text.tolist()]
        raw, raw_pairs = np.ascontiguousarray(numbers, np.int64).tobytes(), links.tobytes()
        size, cuts, pair_cuts = 8 * len(COUNTS), (at_a + at_b).tolist(), (8 * at).tolist()
        return [("".join(shown[i:j])[:-1], raw[k * size:k * size + size], raw_pairs[pi:pj]) if g else None
                for k, (g, i, j, pi, pj) in enumerate(zip(good.tolist(), cuts, cuts[1:], pair_cuts, pair_cuts[1:]))]


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = stop - start
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


@functools.lru_cache(maxsize=1)
def shared_aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for all tasks that a worker runs."""
    return Aligner(path_a, path_b)


@functools.lru_cache(maxsize=1)
def _shared_cache(run: str) -> Kept:
    """One cache of described stretches for all tasks of a run in a worker."""
    return Kept(CACHE, CACHED_CHARS)


def _summed(parts: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate(weights))
    return keys, n


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text: str = "text",
                batch_chars: int = 2_000_000) -> DataFrame:
    """pair (id of A << 32 | id of B) and n, the documents that hold it linked.

    Tasks sum what their documents hold before anything is shuffled."""
    def counted(batches):
        aligner = shared_aligner(path_a, path_b)
        parts, weights, held = [], [], 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for start, stop in slices(texts, batch_chars):
                split = [set(aligner.stretches(t)) for t in texts[start:stop] if t]
                known, new = aligner.pair_cache.lookup(set().union(*split), aligner.linked_pairs)
                for keys in split:
                    found = [known[k] if k in known else new[k] for k in keys]
                    if None not in found:
                        parts.append(np.unique(np.frombuffer(b"".join(found), np.int64)))
                        weights.append(np.ones(len(parts[-1]), np.int64))
                        held += len(parts[-1])
                if held > HELD_PAIRS:
                    keys, n = _summed(parts, weights)
                    if 2 * len(keys) > HELD_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
                        parts, weights, held = [], [], 0
                    else:
                        parts, weights, held = [keys], [n], len(keys)
        if parts:
            keys, n = _summed(parts, weights)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    return (docs.select(F.col(f"`{text}`")).mapInArrow(counted, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text",
                 broadcast_pairs: int = BROADCAST_PAIRS, batch_chars: int = 2_000_000) -> DataFrame:
    """Input columns without the text, then n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups (ids as ``a1,a2|b1;a3|b2,b3``).

    ``path_a`` and ``path_b`` are vocabulary files that every executor has.
    """
    from widen.session import checkpoint_dir

    spark = docs.sparkSession
    checkpoint_dir(spark)
    counts = pair_counts(docs, path_a, path_b, text, batch_chars).checkpoint()
    few = counts.count() <= broadcast_pairs
    table = None
    if few:
        rows = counts.toArrow()  # at most broadcast_pairs rows
        keys, n = (rows[c].to_numpy() for c in ("pair", "n"))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        owners = keys >> 32
        starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(keys) else np.empty(0, np.int64)
        best = n == np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(n)))) if len(n) else n > 0
        table = spark.sparkContext.broadcast((keys, n, best))
    run_id = uuid.uuid4().hex

    low = {text.lower(), *COUNTS, "groups"}
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in low]
    # input columns travel in one struct, so that their names meet no others
    df = docs.select(F.struct(*kept, *([] if kept else [F.lit(0).alias("none")])).alias("x"), F.col(f"`{text}`").alias("text"))

    def scores(keys):
        if table is None:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        own, n, best = table.value
        at = np.searchsorted(own, keys)
        return n[at], best[at].astype(np.int64)

    def aligned(batches):
        aligner = shared_aligner(path_a, path_b)
        cache = _shared_cache(run_id)
        for b in batches:
            texts = b.column(1).to_pylist()
            for start, stop in slices(texts, batch_chars):
                split = [aligner.stretches(t) if t else [] for t in texts[start:stop]]
                known, new = cache.lookup(set().union(*split), lambda keys: aligner.described(keys, scores))
                groups, numbers, pairs = [], [], []
                for own in split:
                    found = [known[s] if s in known else new[s] for s in own]
                    if None in found:
                        found = []
                    groups.append(";".join([f[0] for f in found]))
                    numbers.append(np.frombuffer(b"".join([f[1] for f in found]), np.int64).reshape(-1, len(COUNTS)).sum(0))
                    if not few:
                        pairs.append(np.unique(np.frombuffer(b"".join([f[2] for f in found]), np.int64),
                                               return_counts=True))
                out = [b.column(0).slice(start, stop - start), *(pa.array(c) for c in np.array(numbers).T.copy()),
                       pa.array(groups, pa.string())]
                if not few:
                    out += [pa.array([p[k] for p in pairs], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    schema = T.StructType([df.schema["x"], *(T.StructField(c, T.LongType()) for c in COUNTS),
                           T.StructField("groups", T.StringType())])
    if not few:
        schema = schema.add("pairs", T.ArrayType(T.LongType())).add("times", T.ArrayType(T.LongType()))
    out = df.mapInArrow(aligned, schema)
    if not few:
        out = _joined(out, counts)
    return out.select(*(["x.*"] if kept else []), *COUNTS, "groups")


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """count_sum and n_best by a join on the pair: the side of the counts has
    each pair once, and a pair that most documents hold is split like any
    skewed key of the other side."""
    rows = rows.checkpoint().withColumn("row", F.monotonically_increasing_id())  # the checkpoint fixes row numbers
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("best"))
    scored = (counts.join(best, F.shiftright(counts["pair"], 32) == best["a"])
              .select("pair", "n", (F.col("n") == F.col("best")).alias("is_best")))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    sums = (links.join(scored, links["pairs"] == scored["pair"]).groupBy("row")
            .agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("best_sum"),
                 F.sum(F.col("times") * F.col("n")).alias("sum")))
    return (rows.drop("n_best", "count_sum", "pairs", "times").join(sums, "row", "left")
            .withColumn("n_best", F.coalesce("best_sum", F.lit(0))).withColumn("count_sum", F.coalesce("sum", F.lit(0))))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", *COUNTS, F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
