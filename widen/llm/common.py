"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slices(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts with about ``chars`` characters, so that
    what a task holds at a time does not depend on how long texts are."""
    start = 0
    while start < len(texts):
        stop, held = start, 0
        while stop < len(texts) and (stop == start or held < chars):
            held += len(texts[stop] or "")
            stop += 1
        yield start, stop
        start = stop


def without(df: DataFrame, names) -> DataFrame:
    """The frame without columns of these names, in any case of letters."""
    low = {n.lower() for n in names}
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in low])


class Recent:
    """A bounded cache of what was asked for lately, in two generations: when
    the young one is full it becomes the old one, and what is asked for again
    returns from there."""

    def __init__(self, bound: int):
        self.bound, self.young, self.old = bound, {}, {}

    def known(self, keys: set, learn) -> dict:
        """The young generation with all of ``keys``; ``learn`` gives values
        for a list of unseen ones. One call's keys are held whatever the bound."""
        if len(self.young) > self.bound:
            self.old, self.young = self.young, {}
        unseen = []
        for k in keys.difference(self.young):
            v = self.old.get(k)
            if v is None:
                unseen.append(k)
            else:
                self.young[k] = v
        if unseen:
            self.young.update(zip(unseen, learn(unseen)))
        return self.young


class Kept:
    """A cache of texts of at most ``longest`` characters that were asked for at
    least twice: a table of hashes tells which were asked for before, so that the
    many that stand in one place only do not crowd out the others."""

    def __init__(self, bound: int, longest: int, bits: int = 24):
        self.longest, self.recent, self.seen, self.mask = longest, Recent(bound), np.zeros(1 << bits, bool), (1 << bits) - 1

    def lookup(self, keys: set[str], learn):
        """Two dicts, of which the first or the second has each key; ``learn``
        gives values of unknown ones."""
        known, old = self.recent.young, self.recent.old
        if len(known) > self.recent.bound:
            self.recent.old, self.recent.young = known, {}
            known, old = self.recent.young, self.recent.old
        unseen = []
        for k in keys.difference(known):
            v = old.get(k, known)
            if v is known:
                unseen.append(k)
            else:
                known[k] = v
        if not unseen:
            return known, known
        own = dict(zip(unseen, learn(unseen)))
        marks = np.fromiter((hash(k) & self.mask for k in unseen), np.int64, len(unseen))
        again = self.seen[marks]
        self.seen[marks] = True
        for k, a in zip(unseen, again.tolist()):
            if a and len(k) <= self.longest:
                known[k] = own[k]
        return known, own


# The characters by which byte-level vocabularies write bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {
    chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def byte_level_entries(file: dict) -> dict[bytes, int]:
    """Bytes and id of the entries of a byte-level vocabulary file, without
    those that hold other characters, which stand for themselves."""
    return {bytes(_BYTE_OF[c] for c in e): i for e, i in file["model"]["vocab"].items() if all(c in _BYTE_OF for c in e)}


def byte_level_encoder(file: dict):
    """Function from a text without special tokens to its ids by a byte-level
    BPE file, several times as fast as the file's own library; it gives None for
    texts that it cannot encode (very long runs of white space), and for all
    texts if the file's ids do not follow its merges or it splits otherwise."""
    import public_tokenizers
    import tiktoken

    model, split = file["model"], file.get("pre_tokenizer") or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    if (file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or not split.get("use_regex", True)
            or [model["vocab"][m] for m in merges] != list(range(256, 256 + len(merges)))):
        return lambda text: None
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_level_entries(file),
                               special_tokens={})._core_bpe.encode_ordinary

    def encoded(text: str):
        try:
            return encode(text)
        except BaseException as e:  # a panic of the native code is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return None

    return encoded
