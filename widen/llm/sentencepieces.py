"""SentencePiece BPE encoding and decoding with byte spans of the original text.

The model file is read directly: pieces with scores, the flags of the
normaliser and its compiled character map. Normalisation is longest-prefix
matching in that map (a double-array trie) and records, for every byte it
writes, where in the original it came from; every piece is projected through
that alignment to a span of original bytes. Where the map is empty and no piece
holds a blank after another character, a text falls into words that are encoded
once and kept in a bounded cache.

Defined results: null counts as empty; an empty text has the end id only, with
an empty span at its end; repeated rows are encoded each; an empty table gives
an empty result; other columns are kept, and a column that has the name of a
result column is replaced.
"""

from __future__ import annotations

import functools
import heapq
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.llm.common import Recent, slices

BLANK = "▁"
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bound of each generation of the word cache of a worker, in entries.
CACHE = 250_000


# ---------------------------------------------------------------------------
# model file
# ---------------------------------------------------------------------------

def _fields(raw: bytes):
    """(number, value) of the fields of one message of the wire format."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = raw[at:at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = raw[at:at + n], at + n
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie over byte strings, whose values
    are places in a block of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size:]

    def longest(self, raw: bytes, at: int) -> tuple[int, int] | None:
        """(bytes matched, place of the replacement) of the longest key at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(raw)):
            b = raw[i]
            node ^= b
            unit = units[node]
            if unit & 0x800000FF != b:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def replacement(self, place: int) -> bytes:
        return self.texts[place:self.texts.index(b"\0", place)]


class Model:
    """A BPE model of the format, with what encoding and decoding need."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix, self.strip_blanks, self.escape = True, True, True
        charsmap = b""
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0],
                                    p.get(3, NORMAL)))
            elif number == 3:
                n = dict(_fields(value))
                charsmap = n.get(2, b"")
                self.dummy_prefix, self.strip_blanks = bool(n.get(3, 1)), bool(n.get(4, 1))
                self.escape = bool(n.get(5, 1))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a BPE model")
        self.map = CharacterMap(charsmap)
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        order = {s: n for n, s in enumerate(sorted({self.pieces[i][1] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[self.pieces[i][1]] for p, i in self.ids.items()}
        self.pairs = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.sizes = [len(p.encode()) if kind != BYTE else 1 for p, _, kind in self.pieces]
        self.blanks = [p.count(BLANK) for p, _, _ in self.pieces]
        self._tables()
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.end = next(i for i, (p, _, _) in enumerate(self.pieces) if p == "</s>")
        # merges stay within a word if blanks stand only at the start of pieces
        self.by_word = self.escape and not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.identity = not self.map.units and not self.strip_blanks and self.dummy_prefix and self.by_word
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.cache = Recent(CACHE)

    def _tables(self) -> None:
        """Arrays for merging many words at once: symbols of characters, and
        rank and result of every pair of symbols that is a piece."""
        n = len(self.pieces)
        self.char_ids = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i

        def symbol(p):
            return int(self.char_ids[ord(p)]) if len(p) == 1 else self.ids.get(p)

        rows = []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                left, right = symbol(p[:cut]), symbol(p[cut:])
                if left is not None and right is not None:
                    rows.append((left << 22 | right, self.rank[p], i))
        rows.sort()
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.array(c, np.int64) for c in zip(*rows))
        self.no_rank = len(self.rank)
        self.own_sizes = np.array(self.sizes) - 2 * np.array(self.blanks)

    def _surface(self, i: int) -> bytes:
        p, _, kind = self.pieces[i]
        if kind == BYTE:
            return bytes([int(p[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else p.replace(BLANK, " ").encode()

    # -- normalisation ------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and for each of its bytes and its end the place in
        the original's bytes."""
        raw = text.encode()
        out, align, at = bytearray(), [], 0
        blank = BLANK.encode() if self.escape else b" "

        def step(at):
            m = self.map.longest(raw, at)
            if m is not None:
                return m[0], self.map.replacement(m[1])
            n = 1
            while at + n < len(raw) and raw[at + n] & 0xC0 == 0x80:
                n += 1
            return n, raw[at:at + n]

        if self.strip_blanks:
            while at < len(raw):
                n, piece = step(at)
                if piece.strip(b" "):
                    break
                at += n
        if at >= len(raw):
            return "", [at]
        if self.dummy_prefix:
            out += blank
            align += [at] * len(blank)
        after_blank = self.strip_blanks
        while at < len(raw):
            n, piece = step(at)
            while after_blank and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                written = piece.replace(b" ", blank)
                out += written
                align += [at] * len(written)
                after_blank = self.strip_blanks and piece.endswith(b" ")
            at += n
        align.append(at)
        if self.strip_blanks:
            while out.endswith(blank):
                del out[-len(blank):]
                at = align[len(out)]
                del align[len(out) + 1:]
        return out.decode(), align

    # -- encoding -----------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Pieces of one text: the best-scored neighbouring pair merges, the
        leftmost first among equals, until no pair is a piece."""
        if len(text) > 200:
            return self._merge_long(text)
        parts, rank, none = list(text), self.rank.get, len(self.rank)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same with a heap of pairs and links between parts."""
        parts: list[str | None] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i, j):
            k = self.rank.get(parts[i] + parts[j])
            if k is not None:
                heapq.heappush(heap, (k, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or len(parts[i]) + len(parts[j]) != size or right[i] != j:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i], i)
            if right[i] < n:
                offer(i, right[i])
        return [p for p in parts if p is not None]

    def _segments(self, word: str) -> list[str]:
        """Cut between characters that stand side by side in no piece: no
        merge can cross there."""
        pairs, out, start = self.pairs, [], 0
        for i, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in pairs:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        """(id, bytes) of the pieces of a normalised text; unknown characters
        fall to their bytes where the model has these."""
        out = []
        for segment in self._segments(text):
            for p in self.merge(segment):
                k = self.ids.get(p)
                if k is not None:
                    out.append((k, self.sizes[k]))
                elif self.bytes:
                    out += [(self.bytes[b], 1) for b in p.encode()]
                elif out and out[-1][0] == self.unknown:
                    out[-1] = self.unknown, out[-1][1] + len(p.encode())
                else:
                    out.append((self.unknown, len(p.encode())))
        return out

    def _merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many words and the place of each word's first one.

        All words merge at once: a round merges the best, leftmost pair of
        every word that still has one. Characters without a piece have symbols
        above the pieces and never merge.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.char_ids[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")].astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []

        def ranks(left, right):
            at = np.searchsorted(self.pair_keys, key := left << 22 | right)
            at[at == len(self.pair_keys)] = 0
            found = self.pair_keys[at] == key
            return np.where(found, self.pair_ranks[at], self.no_rank), np.where(found, self.pair_ids[at], 0)

        r, merged = (np.full(len(symbols), self.no_rank, np.int64), np.zeros(len(symbols), np.int64))
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        r[inside], merged[inside] = ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            n = len(symbols)
            best = np.minimum.reduceat(r * n + np.arange(n), starts)
            live = best // n < self.no_rank
            if not live.all():  # words without a pair are finished
                over = np.repeat(~live, np.diff(np.r_[starts, n]))
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                keep = ~over
                place = np.cumsum(keep) - 1
                symbols, owner, r, merged = symbols[keep], owner[keep], r[keep], merged[keep]
                at = place[(best % n)[live]]
            else:
                at = best % n
            if not len(symbols):
                break
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, r, merged = symbols[keep], owner[keep], r[keep], merged[keep]
            at = place[at]
            r[at] = self.no_rank
            changed = np.r_[at, at[at > 0] - 1]
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[owner[changed] == owner[changed + 1]]
            r[changed], merged[changed] = ranks(symbols[changed], symbols[changed + 1])
        symbols = np.concatenate([np.empty(0, np.int64), *done_symbols])
        owner = np.concatenate([np.empty(0, np.int64), *done_owner])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _learn(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids and original byte counts of words. One blank before a
        word is understood if it is given without any."""
        out: list = [None] * len(words)
        escaped = [w if w.startswith(BLANK) else BLANK + w for w in words]
        short = [i for i, w in enumerate(escaped) if len(w) <= 200]
        symbols, at = self._merge_words([escaped[i] for i in short])
        known = symbols < len(self.pieces)
        odd = np.add.reduceat(~known, at[:-1]) > 0 if len(short) else []
        ids = np.where(known, symbols, 0)
        packed, sizes = ids.astype("<i4").tobytes(), self.own_sizes[ids].astype("<i4").tobytes()
        slow = set(range(len(words))).difference(short)
        for k, i in enumerate(short):
            if odd[k]:
                slow.add(i)
            else:
                out[i] = packed[4 * at[k]:4 * at[k + 1]], sizes[4 * at[k]:4 * at[k + 1]]
        for i in slow:
            pieces = self._pieces(escaped[i])
            # a blank is three bytes here and one in the original
            out[i] = (array("i", [k for k, _ in pieces]).tobytes(),
                      array("i", [n - 2 * self.blanks[k] for k, n in pieces]).tobytes())
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text: spans are bytes of the original
        text in UTF-8; the end id has an empty span at the end."""
        plain = [self.identity and BLANK not in t for t in texts]
        words = [(_blank_runs(t) if "  " in t or t[:1] == " " or t[-1:] == " " else t.split(" ")) if fast and t else []
                 for t, fast in zip(texts, plain)]
        cache = self.cache.known({w for ws in words for w in ws}, self._learn)
        out = []
        for t, fast, ws in zip(texts, plain, words):
            if not fast:
                out.append(self._encode_aligned(t))
                continue
            found = [cache[w] for w in ws]
            ids = np.frombuffer(b"".join([f[0] for f in found]), "<i4")
            sizes = np.frombuffer(b"".join([f[1] for f in found]), "<i4").astype(np.int64)
            if len(sizes):
                sizes[0] -= 1  # the blank put before the text has no bytes there
            ends = np.cumsum(sizes)
            last = ends[-1] if len(ends) else 0
            out.append((np.append(ids, np.int32(self.end)), np.append(ends - sizes, last), np.append(ends, last)))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]

    def _encode_aligned(self, text: str):
        normal, align = self.normalise(text)
        pieces = []
        if self.by_word:
            for w in _escaped_words(normal):
                pieces += self._pieces(w)
        else:
            pieces = self._pieces(normal)
        place = np.array(align, np.int64)
        at = np.cumsum([0, *(n for _, n in pieces)])
        total = len(text.encode())
        ids = np.array([*(k for k, _ in pieces), self.end], "<i4")
        return ids, np.append(place[at[:-1]], total), np.append(place[at[1:]], total)

    # -- decoding -----------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Text of ids: blanks restored, the first one dropped, byte runs read
        as UTF-8 with each bad byte replaced."""
        ids = [k for k in ids if self.pieces[k][2] != CONTROL]
        if not ids:
            return ""
        first = self.surface[ids[0]]
        if self.dummy_prefix and self.pieces[ids[0]][2] == NORMAL and first.startswith(b" "):
            first = first.lstrip(b" ") if self.strip_blanks else first[1:]
        raw = first + b"".join(map(self.surface.__getitem__, ids[1:]))
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, run = [], bytearray()
            for n, k in enumerate(ids):
                if self.pieces[k][2] == BYTE:
                    run += self.surface[k]
                else:
                    out += [_read(run), (first if n == 0 else self.surface[k]).decode()]
                    run.clear()
            return "".join([*out, _read(run)])


def _read(raw: bytearray) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[at:at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _escaped_words(normal: str) -> list[str]:
    """Cut before every run of blanks."""
    out, start = [], 0
    for i in range(1, len(normal)):
        if normal[i] == BLANK and normal[i - 1] != BLANK:
            out.append(normal[start:i])
            start = i
    return out + [normal[start:]] if normal else out


def _blank_runs(text: str) -> list[str]:
    """Words with their leading blanks as they are encoded; a word after a
    single blank is given without it, as a plain split gives it."""
    words = _escaped_words(BLANK + text.replace(" ", BLANK))
    return [w[1:] if len(w) > 1 and w[1] != BLANK else w for w in words]


@functools.lru_cache(maxsize=2)
def shared_model(path: str) -> Model:
    """One model, and so one word cache, for all tasks that a worker runs."""
    return Model(path)


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

RESULT = ("ids", "starts", "ends", "decoded")


def encode_pieces(docs: DataFrame, model: str, text: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """Input columns without the text, then ids, starts, ends (byte spans of
    the original, one per id) and decoded.

    ``model`` is the path of the model file, which every executor has.
    """
    kept = [c for c in docs.columns if c != text and c.lower() not in RESULT]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"))

    def lists(parts, kind):
        values = np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    def run(batches):
        m = shared_model(model)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for start, stop in slices(texts, batch_chars):
                found = m.encode_all([t or "" for t in texts[start:stop]])
                decoded = [m.decode(ids.tolist()) for ids, _, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(start, stop - start).columns[:-1], lists([f[0] for f in found], np.int32),
                     lists([f[1] for f in found], np.int64), lists([f[2] for f in found], np.int64),
                     pa.array(decoded, pa.string())], [*kept, *RESULT])

    schema = T.StructType([*df.drop("__text").schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("starts", T.ArrayType(T.LongType())),
                           T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())])
    return df.mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                         F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
                         F.array_max("ends").alias("n_bytes"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
