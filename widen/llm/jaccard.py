"""Jaccard join of documents on word n-grams by blocked sparse products.

The join is the product of the incidence matrix of documents and n-grams with
its transpose, of which only entries above a bound are wanted. Three bounds that
follow from the set sizes keep the blocks small, and none drops a link:

* Own members. A set of n with more than n - t n members that no other set has is
  linked with none. These are counted among a share of all members first, then
  among all members of the sets that are left, and once more in each cluster.
  Members go through the shuffle as sorted runs of one bucket of hashes, so that
  one takes a few bytes.
* Rare members. Linked sets share t n members or more, so with the members that
  several sets have in one order, rarest first, they share one of the first
  c - t n + 1 of each set's c. Sets that share no such member have no link; chains
  of them make clusters, and entries outside a cluster's block are zero. A passage
  that many documents hold stands last in that order and chains few.
* Sizes. Sets whose sizes differ by more than t are never linked: what a cluster
  keeps is cut into bands of sizes, if it is more than one block holds, and bands
  into blocks of bounded weight; only blocks of equal or neighbouring bands are
  multiplied.

A task multiplies one pair of blocks in strips of rows of a bounded number of
pairs, however many small sets the blocks hold, adds up overlaps over runs of
columns and returns a forest of the links it finds, never all pairs. Equal sets
are one row of the matrix.

Defined results: a null or empty text and one without words has an empty set
and is linked with nothing; rows with a null id take no part in links and keep
their size and a null component; repeated ids with one text are equal sets, with
different texts each row is a document of its own; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widen.llm.common import slices
from widen.llm.components import components

#: Bound of a block, in members, of a strip of a product, in pairs of sets, and of
#: the members that are counted at a time: that bounds memory, not the result.
BLOCK, PAIRS, RUN = 200_000, 4_000_000, 2_000_000
#: Words of more bytes are hashed one by one.
LONG = 64
#: Bits of the first signature; fewer only in tests of equal ones.
KEY_MASK = (1 << 64) - 1
_A = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: By number of bytes, the bits that they take of a number of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _word_hashes(text: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places, of all at a time: their first eight
    bytes are mixed in, then the next eight of those that go on."""
    eights = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))  # from each byte on
    h = _mix(length.astype(np.uint64) * _A + (eights[start] & _FIRST[np.minimum(length, 8)]))
    for k in np.flatnonzero(length > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(text[start[k]:start[k] + length[k]])
    on, done = np.flatnonzero((length > 8) & (length <= LONG)), 8
    while len(on):
        left = length[on] - done
        h[on] = _mix(h[on] * _A + (eights[start[on] + done] & _FIRST[np.minimum(left, 8)]))
        on, done = on[left > 8], done + 8
    return h


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one text after the other, and
    the number of each. Words are runs without ASCII white space, with A-Z in
    lower case; fewer than n words make one gram."""
    raw = [(t or "").encode() for t in texts]
    text = b" ".join(raw).lower()
    octets = np.frombuffer(text, np.uint8)
    blank = np.ones(len(text) + 2, bool)
    blank[1:-1] = (octets == 32) | (octets - np.uint8(9) < 5)
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    begin, length = edge[::2], edge[1::2] - edge[::2]
    h = _word_hashes(text, begin, length)
    # texts are one blank apart
    count = np.diff(np.searchsorted(begin, np.r_[0, np.cumsum([len(r) + 1 for r in raw])]))
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    # a short text's words, then blanks up to n
    size = np.repeat(count, count)
    start = np.flatnonzero((place + n <= size) | ((size < n) & (place == 0)))
    gram = np.zeros(len(start), np.uint64)
    for k in range(n):
        inside = place[start] + k < size[start]
        nth = np.where(inside, h[np.minimum(start + k, max(0, len(h) - 1))], np.uint64(k + 1)) if len(h) else gram
        gram = _mix(gram * _A + nth + np.uint64(k))
    own = owner[start]
    at = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(at, at[1:]):
        gram[a:b].sort()
    if len(gram):
        keep = np.r_[True, (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])]
        gram, own = gram[keep], own[keep]
    return gram, np.bincount(own, minlength=len(texts))


@dataclass(frozen=True)
class Bound:
    """Similarity ``num / den``, and what follows from it for set sizes."""

    num: int
    den: int

    def linked(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)

    def least_overlap(self, n):
        """No partner of a set of n shares less than this."""
        return -(-self.num * n // self.den)

    def every(self) -> int:
        """One of so many members is enough to count first: sets of which more
        than about 60 % are their own are told by these."""
        return max(1, 3 * self.den // (5 * max(1, self.den - self.num)))

    def slack(self, size: str) -> str:
        """SQL: the most own members of a linked set of a size."""
        return f"{size} - ({size} * {self.num} + {self.den - 1}) div {self.den}"


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), _longs(values))


def _signed(texts: list[str | None], n: int, mask: int):
    """(start, stop, grams, sizes, keys, checks) of runs of texts; key and check
    are a 128-bit signature of the set."""
    for start, stop in slices(texts, 2_000_000):
        gram, size = shingle_sets(texts[start:stop], n)
        at = np.r_[0, np.cumsum(size)]
        raw = [gram[at[i]:at[i + 1]].tobytes() for i in range(stop - start)]
        key = np.array([xxhash.xxh3_64_intdigest(r) & mask for r in raw], np.uint64)
        check = np.array([xxhash.xxh64_intdigest(r, 7) for r in raw], np.uint64)
        yield start, stop, gram, size, key, check


def sketches(docs: DataFrame, n: int, id_col: str, text: str) -> DataFrame:
    """id, size, key and check (a 128-bit signature of the set), text hash."""
    mask = KEY_MASK

    def run(batches):
        for b in batches:
            for start, stop, _, size, key, check in _signed(b.column(1).to_pylist(), n, mask):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, stop - start), _longs(size), _longs(key), _longs(check),
                     b.column(2).slice(start, stop - start)], ["id", "size", "key", "check", "text_hash"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text), F.xxhash64(text)).mapInArrow(
        run, f"id {kind}, size long, key long, check long, text_hash long")


def _packed(values: np.ndarray) -> bytes:
    """Numbers by bytes of one rank: high ranks of small numbers take no space."""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _own_members(rows: DataFrame, read, every: int, members: int) -> DataFrame:
    """(key, check, own): how many members of each set, of one in ``every`` by
    hash, no other set has; sets without one may be missing. ``read`` gives
    (grams, sizes, keys, checks) of a batch of ``rows``; ``members`` is about the
    number of all. Never too many are counted: members are compared by 48 bits,
    and a set that comes twice may have none.

    A chunk is what a task holds at a time. Its members are dealt to buckets by
    hash, each sent as one sorted run with the numbers of their sets in the chunk;
    one that several of the chunk's sets have is sent once, without a set.
    """
    buckets = max(1, min(256, members // every // 1000), members // every // RUN)

    def chunk(held, name):
        gram, size, key, check = (np.concatenate(x) for x in zip(*held))
        _, one = np.unique(np.stack([key, check], 1), axis=0, return_index=True)
        once = np.zeros(len(size), bool)
        once[one] = True  # equal sets of a chunk count once
        owner = np.repeat(np.arange(1, len(size) + 1), size)
        inside = np.repeat(once, size)
        gram, owner = gram[inside], owner[inside]
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][:len(gram)])
        several = np.diff(np.r_[first, len(gram)]) > 1
        mark, owner = gram[first] >> np.uint64(16), np.where(several, 0, owner[first])
        bucket = ((mark >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
        at = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        out = [(name % buckets, name, True, len(key), _packed(key), _packed(check))]
        for b in np.flatnonzero(np.diff(at)).tolist():
            m = mark[at[b]:at[b + 1]]
            out.append((b, name, False, len(m), _packed(np.diff(m, prepend=np.uint64(0))), _packed(owner[at[b]:at[b + 1]])))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()))],
            ["bucket", "chunk", "names", "n", "x", "y"])

    def dealt(batches):
        name, held, count = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for gram, size, key, check in read(b):
                use = gram % np.uint64(every) == 0
                owner = np.repeat(np.arange(len(size)), size)[use]
                held.append((gram[use], np.bincount(owner, minlength=len(size)), key, check))
                count += len(owner) + len(size)
                if count > RUN:
                    yield chunk(held, name)
                    name, held, count = name + 1, [], 0
        if held:
            yield chunk(held, name)

    def alone(t):
        chunks, names, sizes, x, y = (t.column(k).to_pylist() for k in range(1, 6))
        out = [(c, True, n, p, q) for c, is_names, n, p, q in zip(chunks, names, sizes, x, y) if is_names]
        runs = [k for k, is_names in enumerate(names) if not is_names]
        if runs:
            mark = np.concatenate([np.cumsum(_unpacked(x[k], sizes[k])) for k in runs])
            owner = np.concatenate([_unpacked(y[k], sizes[k]) for k in runs])
            run = np.repeat(np.arange(len(runs)), [sizes[k] for k in runs])
            order = np.argsort(mark, kind="stable")
            new = np.r_[True, mark[order[1:]] != mark[order[:-1]], True]
            single = order[new[1:] & new[:-1]]
            single = np.sort(single[owner[single] > 0])
            at = np.searchsorted(run[single], np.arange(len(runs) + 1))
            for r, k in enumerate(runs):
                sets, times = np.unique(owner[single[at[r]:at[r + 1]]], return_counts=True)
                if len(sets):
                    out.append((chunks[k], False, len(sets), _packed(np.diff(sets, prepend=np.uint64(0))), _packed(times)))
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["chunk", "names", "n", "x", "y"])

    def summed(t):
        names, sizes, x, y = (t.column(k).to_pylist() for k in range(1, 5))
        k = names.index(True)
        key, check = _unpacked(x[k], sizes[k]), _unpacked(y[k], sizes[k])
        own = np.zeros(len(key) + 1, np.int64)
        for is_names, n, p, q in zip(names, sizes, x, y):
            if not is_names:
                own[np.cumsum(_unpacked(p, n)).astype(np.int64)] += _unpacked(q, n).astype(np.int64)
        found = np.flatnonzero(own[1:])
        return pa.table([_longs(key[found]), _longs(check[found]), _longs(own[1:][found])], ["key", "check", "own"])

    return (rows.mapInArrow(dealt, "bucket int, chunk long, names boolean, n int, x binary, y binary")
            .groupBy("bucket").applyInArrow(alone, "chunk long, names boolean, n int, x binary, y binary")
            .groupBy("chunk").applyInArrow(summed, "key long, check long, own long"))


def _rare(sets: DataFrame, bound: Bound) -> DataFrame:
    """(key, rare): the members by which a set may be linked, fewest holders
    first; sets without one are left out."""
    members = sets.select("key", F.size("set").cast("long").alias("size"), F.explode("set").alias("m"))
    held = members.groupBy("m").agg(F.count("*").alias("n")).where("n > 1")
    found = members.join(held, "m").groupBy("key").agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "m"))).alias("found"))
    first = F.expr(f"size(found) + 1 - (size * {bound.num} + {bound.den - 1}) div {bound.den}")
    return found.withColumn("first", first.cast("int")).where("first > 0").select(
        "key", F.slice("found", 1, F.col("first")).getField("m").alias("rare"))


def _rare_edges(named: DataFrame) -> DataFrame:
    """Edges (a, b) between sets (row, key, rare) that share a rare member: every
    holder and the least one. Tasks first join the holders they have, so that one
    which a third of the documents hold leaves one row a task for the shuffle."""
    def held(batches):
        keys, nodes = [], []
        for b in batches:
            lists = b.column(1)
            keys.append(lists.flatten().to_numpy(zero_copy_only=False))
            nodes.append(np.repeat(b.column(0).to_numpy(zero_copy_only=False),
                                   np.diff(lists.offsets.to_numpy(zero_copy_only=False))))
        if not keys:
            return None
        k, v = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.empty(0, bool)
        return k, v, first

    def inner(batches):
        if (found := held(batches)) is not None and len(found[0]):
            k, v, first = found
            least = v[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
            pairs = np.unique(np.stack([v, least], 1)[v != least], axis=0)
            yield pa.RecordBatch.from_arrays([_longs(pairs[:, 0]), _longs(pairs[:, 1])], ["a", "b"])

    def outer(batches):
        if (found := held(batches)) is not None and len(found[0]):
            k, v, first = found
            yield pa.RecordBatch.from_arrays([_longs(k[first]), _longs(v[first])], ["member", "a"])

    # row numbers are short in the shuffle, where keys are random bytes
    rows = named.select("row", "rare")
    across = rows.mapInArrow(outer, "member long, a long").selectExpr("member", "a", "min(a) OVER (PARTITION BY member) AS b")
    found = rows.mapInArrow(inner, "a long, b long").union(across.where("a <> b").select("a", "b")).distinct()
    names = named.select("row", "key")
    return (found.join(names.select(F.col("row").alias("a"), F.col("key").alias("ka")), "a")
            .join(names.select(F.col("row").alias("b"), F.col("key").alias("kb")), "b")
            .where("ka <> kb").select(F.col("ka").alias("a"), F.col("kb").alias("b")).distinct())


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(key, packed, bytes): a text of each set in ``wanted`` (id, text_hash,
    key), compressed for the shuffle."""
    def packed(batches):
        for b in batches:
            raw = [pa.compress(t.encode(), "zstd", asbytes=True) for t in b.column(2).to_pylist()]
            sizes = pc.binary_length(b.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), sizes],
                                             ["id", "text_hash", "packed", "bytes"])

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(packed, f"id {kind}, text_hash long, packed binary, bytes long")
    return (rows.join(wanted.select("id", "text_hash", "key"), ["id", "text_hash"]).groupBy("id", "text_hash")
            .agg(*[F.first(c).alias(c) for c in ("key", "packed", "bytes")]).select("key", "packed", "bytes"))


def _read_texts(n: int):
    """Function from a batch of ``_texts`` to (start, stop, grams, sizes) of runs of it."""
    def read(b):
        raw, sizes = b.column(1).to_pylist(), b.column(2).to_pylist()
        at = 0
        while at < len(raw):
            stop, held = at, 0
            while stop < len(raw) and (stop == at or held < 2_000_000):
                held += sizes[stop]
                stop += 1
            yield at, stop, *shingle_sets([pa.decompress(r, k, "zstd", asbytes=True).decode()
                                           for r, k in zip(raw[at:stop], sizes[at:stop])], n)
            at = stop

    return read


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(key, set) of ``_texts``."""
    read = _read_texts(n)

    def run(batches):
        for b in batches:
            for start, stop, gram, size in read(b):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), _lists(gram, size)], ["key", "set"])

    return texts.select("key", "packed", "bytes").mapInArrow(run, "key long, `set` array<long>")


def _live(wanted: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """Rows of ``wanted`` whose sets may have a link by their own members in the cluster."""
    # counted among a third of all members by hash: that can only be too few
    members = sets.join(wanted.select("key", "cluster"), "key").select(
        "cluster", "key", F.explode(F.filter("set", lambda x: F.pmod(x, F.lit(3)) == 0)).alias("m"))
    lone = (members.groupBy(F.xxhash64("cluster", "m").alias("m")).agg(F.count("*").alias("n"), F.min("key").alias("key"))
            .where("n = 1").groupBy("key").agg(F.count("*").alias("own")))
    return _few_own(wanted, lone, bound)


def _few_own(wanted: DataFrame, own: DataFrame, bound: Bound) -> DataFrame:
    """Rows of ``wanted`` (key, size) that have no more own members (key, own) than linked sets may."""
    return wanted.join(own, "key", "left").where(f"coalesce(own, 0) <= {bound.slack('size')}").drop("own")


def _places(live: DataFrame, bound: Bound) -> DataFrame:
    """(cluster, key, to): the pairs of blocks (p, q) that each set is multiplied in, and
    its side there (0, 1, or 2 for a block with itself)."""
    weight = live.groupBy("cluster").agg(F.sum("size").alias("weight"))
    weighed = live.join(weight, "cluster").select("cluster", "key", "size", "weight")
    one = F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(2).alias("side")))
    small = weighed.where(F.col("weight") <= BLOCK).select("cluster", "key", one.alias("to"))
    large = weighed.where(F.col("weight") > BLOCK).withColumn(
        "band", F.floor(F.log(F.col("size").cast("double")) / float(np.log(bound.den / bound.num))))
    blocks = large.groupBy("cluster", "band").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    above = blocks.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = blocks.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    plan = blocks.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")
    x = large.join(plan, ["cluster", "band"]).withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")))
    # a block is named by band and number
    name = "shiftleft(cast({} as bigint), 24) + {}"
    to = f"""
      concat(
        transform(sequence(0L, blocks - 1), j -> named_struct(
          'p', {name.format('band', 'least(i, j)')}, 'q', {name.format('band', 'greatest(i, j)')},
          'side', CASE WHEN i = j THEN 2 WHEN i < j THEN 0 ELSE 1 END)),
        CASE WHEN above IS NULL THEN array() ELSE transform(sequence(0L, above - 1), j -> named_struct(
          'p', {name.format('band', 'i')}, 'q', {name.format('(band + 1)', 'j')}, 'side', 0)) END,
        CASE WHEN below IS NULL THEN array() ELSE transform(sequence(0L, below - 1), j -> named_struct(
          'p', {name.format('(band - 1)', 'j')}, 'q', {name.format('band', 'i')}, 'side', 1)) END)"""
    return small.unionByName(x.select("cluster", "key", F.expr(to).alias("to")))


def _dealt(sets: DataFrame, live: DataFrame, bound: Bound) -> DataFrame:
    """Sets with the pairs of blocks that they are multiplied in."""
    placed = sets.join(_places(live, bound), "key")
    return placed.select("cluster", F.explode("to").alias("to"), "key", F.size("set").cast("long").alias("size"), "set").select(
        "cluster", "to.p", "to.q", "to.side", "key", "size", "set")


def multiply(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048, dense: float = 0.01) -> np.ndarray:
    """Overlaps of all sets of a block with all of another: the product of two
    sparse matrices over the columns that both have.

    Columns with few entries add their pairs of rows one by one; columns where
    more than a share ``dense`` of all pairs meet are multiplied as dense runs.
    """
    na, nb = len(a), len(b)
    va, vb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(va, vb)
    out = np.zeros(na * nb)
    if not len(shared):
        return out.reshape(na, nb)

    def entries(v, sets):
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        c = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        own = np.flatnonzero(shared[c] == v)
        own = own[np.argsort(c[own], kind="stable")]
        return c[own], rows[own], np.bincount(c[own], minlength=len(shared))

    (ca, ra, da), (cb, rb, db) = entries(va, a), entries(vb, b)
    heavy = da * db > max(1.0, dense * na * nb)
    begin = np.cumsum(db) - db
    light = np.flatnonzero(~heavy[ca])
    times = db[ca[light]]
    cut = np.searchsorted(np.cumsum(times), np.arange(0, times.sum(), 4_000_000))
    for lo, hi in zip(cut, [*cut[1:], len(light)]):
        e, t = light[lo:hi], times[lo:hi]
        other = np.repeat(begin[ca[e]] - np.cumsum(t) + t, t) + np.arange(t.sum())
        out += np.bincount(np.repeat(ra[e], t) * nb + rb[other], minlength=na * nb)
    out = out.reshape(na, nb)
    number = np.cumsum(heavy) - 1
    columns = max(1, min(columns, int(heavy.sum()), 4 * PAIRS // max(na, nb)))
    ia, ib = np.flatnonzero(heavy[ca]), np.flatnonzero(heavy[cb])
    xa, xb = number[ca[ia]], number[cb[ib]]
    for s in range(0, int(heavy.sum()), columns):
        la, lb = (slice(*np.searchsorted(x, (s, s + columns))) for x in (xa, xb))
        ma, mb = np.zeros((na, columns), np.float32), np.zeros((nb, columns), np.float32)
        ma[ra[ia[la]], xa[la] - s] = 1
        mb[rb[ib[lb]], xb[lb] - s] = 1
        out += ma @ mb.T
    return out


class _Forest:
    """Edges that join what all edges seen join."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, rows: np.ndarray, cols: np.ndarray) -> None:
        while len(rows):
            # of the edges between two trees one is enough, and one a tree is taken at a time
            p, q = self.up[rows], self.up[cols]
            apart = p != q
            rows, cols = rows[apart], cols[apart]
            high, low = np.maximum(p, q)[apart], np.minimum(p, q)[apart]
            tree, first = np.unique(high, return_index=True)
            self.edges += zip(rows[first].tolist(), cols[first].tolist())
            self.up[tree] = low[first]
            while not np.array_equal(roots := self.up[self.up], self.up):
                self.up = roots


def _block_links(keys: list[int], sizes: list[int], sides: list[int], sets: list[np.ndarray], bound: Bound):
    keys, sizes, sides = np.array(keys), np.array(sizes, np.int64), np.array(sides)
    left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    if not len(left) or not len(right):
        return []
    forest = _Forest(len(keys))
    beside = [sets[j] for j in right]
    step = max(1, PAIRS // len(right))
    for s in range(0, len(left), step):
        strip = left[s:s + step]
        over = multiply([sets[i] for i in strip], beside).astype(np.int64)
        r, c = np.nonzero(bound.linked(over, sizes[strip][:, None], sizes[right][None, :]))
        r, c = strip[r], right[c]
        other = keys[r] != keys[c]
        forest.add(r[other], c[other])
    return [(keys[i], keys[j]) for i, j in forest.edges]


def links(dealt: DataFrame, bound: Bound) -> DataFrame:
    """A forest (a, b) of the links of each pair of blocks."""
    def run(batches):
        name, held, out = None, ([], [], [], []), []
        for b in batches:
            lists = b.column(6)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy(zero_copy_only=False)
            at = at - at[0]
            for i, (cluster, p, q, side, key, size) in enumerate(zip(*(b.column(k).to_pylist() for k in range(6)))):
                if (cluster, p, q) != name:
                    if name is not None:
                        out += _block_links(*held, bound)
                    name, held = (cluster, p, q), ([], [], [], [])
                for h, v in zip(held, (key, size, side, values[at[i]:at[i + 1]].copy())):
                    h.append(v)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                out = []
        if name is not None:
            out += _block_links(*held, bound)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return (dealt.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
            .mapInArrow(run, "a long, b long"))


def _kinds(sketched: DataFrame) -> DataFrame:
    """A row per set: one of its texts, its size, and the range of its second signature."""
    return sketched.groupBy("key").agg(F.min(F.struct("id", "text_hash")).alias("one"), F.min("check").alias("lo"),
                                       F.max("check").alias("hi"), F.min("size").alias("size")).checkpoint()


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row: sets link when den times their
    overlap is at least num times their union; component_id is the least id
    that links reach."""
    from widen.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    bound = Bound(num, den)
    mask = KEY_MASK
    all_rows = sketches(docs, n, id_col, text).checkpoint()
    members = all_rows.agg(F.sum("size")).first()[0] or 0

    def signed(b):
        return (x[2:] for x in _signed(b.column(0).to_pylist(), n, mask))

    counted = _own_members(docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(text), signed, bound.every(),
                           members).checkpoint()
    kinds = _kinds(all_rows.where("size > 0 AND id IS NOT NULL"))
    clash = kinds.where("lo <> hi").select("key")
    if not clash.isEmpty():
        # different sets with one 64-bit key: about three in ten billion sets; they are named anew by both signatures
        all_rows, counted = (x.join(clash.withColumn("clash", F.lit(True)), "key", "left").withColumn(
            "key", F.when(F.col("clash"), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("clash").select(
            *x.columns) for x in (all_rows, counted))
        kinds = _kinds(all_rows.where("size > 0 AND id IS NOT NULL"))
    # by a share of all members first; the texts of what is left are moved once
    wanted = _few_own(kinds.select("one.id", "one.text_hash", "key", "size"),
                      counted.groupBy("key").agg(F.sum("own").alias("own")), bound).checkpoint()
    texts = _texts(docs, wanted, id_col, text).checkpoint()
    read = _read_texts(n)

    def named(b):
        keys = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        return ((gram, size, keys[start:stop], np.zeros(stop - start, np.uint64)) for start, stop, gram, size in read(b))

    again = _own_members(texts, named, 1, wanted.agg(F.sum("size")).first()[0] or 0).select("key", "own")
    few = _few_own(wanted, again, bound).select("key", "size").checkpoint()
    sets = _sets(texts.join(few, "key"), n).checkpoint()
    rare = _rare(sets, bound).checkpoint().withColumn("row", F.monotonically_increasing_id())
    edges = _rare_edges(rare).checkpoint()
    clusters = components(edges).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    chained = clusters.join(few, "key").select("key", "cluster", "size").checkpoint()
    live = _live(chained, sets, bound).checkpoint()
    found = components(links(_dealt(sets, live, bound), bound).checkpoint())
    least = (found.join(kinds, found["node"] == kinds["key"]).groupBy("component").agg(F.min("one.id").alias("least")))
    names = found.join(least, "component").select(F.col("node").alias("key"), "least")
    named = kinds.select("key", "one.id").withColumnRenamed("id", "first").join(names, "key", "left").select(
        "key", F.coalesce("least", "first").alias("component_id"))
    out = all_rows.select("id", F.col("size").alias("n_shingles"), F.when(
        (F.col("size") > 0) & F.col("id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES = {"op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(w.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""}
