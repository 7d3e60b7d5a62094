"""Exact duplicates by counting quotient filters and a byte comparison.

Every partition builds a counting quotient filter of its fingerprints; filters are cut at quotient
ranges, and the pieces of a range are merged from their sorted remainders, which loses nothing. Only
texts whose fingerprint was counted more than once are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm.common import SPACE, id_and_text
from factloom.session import materialize

#: Documents whose ids are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Fingerprints aimed at in one merged range of quotients.
RANGE_ROWS = 65_536


def normalised(text: bytes) -> bytes:
    """Every run of ASCII white space becomes one space."""
    words = b" ".join(text.split())
    if not words:
        return b" " if text else b""
    blank = b" \t\n\x0b\x0c\r"
    return (b" " if text[:1] in blank else b"") + words + (b" " if text[-1:] in blank else b"")


class CountingQuotientFilter:
    """Counts of 64-bit fingerprints in slots: quotients give places, slots hold remainders.

    The top ``skip`` bits, shared by all entries, are kept once (``top``). The next ``bits`` are the quotient.
    Entries lie in order, each in the slot of its quotient or as far behind it as earlier ones push it. Three
    marks of a slot tell quotients from slots: its quotient has entries, its entry continues the run of the
    entry before, its entry is not in its own slot. A slot without marks is empty. Whole fingerprints can be
    read back in order, so merging is lossless.
    """

    OCCUPIED, CONTINUED, SHIFTED = (np.uint8(1 << i) for i in range(3))

    def __init__(self, marks, remainders, tallies, bits: int, top: int = 0, skip: int = 0):
        self.marks, self.remainders, self.tallies, self.bits, self.top, self.skip = marks, remainders, tallies, bits, top, skip

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray, bits: int | None = None, top: int = 0, skip: int = 0) -> CountingQuotientFilter:
        """Filter of fingerprints in any order; by default three of four slots are filled at most."""
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
        return cls.laid_out(prints[first], np.add.reduceat(counts, first) if len(first) else counts[:0], bits, top, skip)

    @classmethod
    def laid_out(cls, prints, counts, bits: int | None = None, top: int = 0, skip: int = 0) -> CountingQuotientFilter:
        """Filter of ascending, distinct fingerprints."""
        bits = max(1, (4 * len(prints) // 3).bit_length()) if bits is None else bits
        rest, order = prints << np.uint64(skip), np.arange(len(prints))
        quotients = (rest >> np.uint64(64 - bits)).astype(np.int64)
        slots = np.maximum.accumulate(quotients - order) + order if len(prints) else order
        size = max(1 << bits, int(slots[-1]) + 1 if len(prints) else 0)
        marks, remainders, tallies = np.zeros(size, np.uint8), np.zeros(size, np.uint64), np.zeros(size, np.int64)
        marks[quotients] |= cls.OCCUPIED
        marks[slots[1:][quotients[1:] == quotients[:-1]]] |= cls.CONTINUED
        marks[slots[slots != quotients]] |= cls.SHIFTED
        remainders[slots] = rest & np.uint64((1 << (64 - bits)) - 1)
        tallies[slots] = counts
        return cls(marks, remainders, tallies, bits, top, skip)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.marks))

    def prints(self) -> np.ndarray:
        """All fingerprints, ascending."""
        used = np.flatnonzero(self.marks)
        run = np.cumsum((self.marks[used] & self.CONTINUED) == 0) - 1
        quotients = np.flatnonzero(self.marks & self.OCCUPIED).astype(np.uint64)[run]
        rest = (quotients << np.uint64(64 - self.bits)) | self.remainders[used]
        return rest if self.skip == 0 else (rest >> np.uint64(self.skip)) | np.uint64(self.top << (64 - self.skip))

    @property
    def counts(self) -> np.ndarray:
        return self.tallies[self.marks != 0]

    def with_(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Merge of two filters along their sorted entries; equal entries add their counts."""
        prints, counts, more, added = self.prints(), self.counts, other.prints(), other.counts
        at = np.searchsorted(prints, more)
        known = np.zeros(len(more), bool)
        inside = at < len(prints)
        known[inside] = prints[at[inside]] == more[inside]
        counts[at[known]] += added[known]
        new = ~known
        return self.laid_out(np.insert(prints, at[new], more[new]), np.insert(counts, at[new], added[new]), None, self.top, self.skip)

    @classmethod
    def merged(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter | None:
        """Merge of all filters; only ones of like size meet, so that each entry moves a logarithmic number of times."""
        held: list[CountingQuotientFilter] = []
        for one in filters:
            while held and len(held[-1]) < 2 * len(one):
                one = held.pop().with_(one)
            held.append(one)
        while len(held) > 1:
            held.append(held.pop().with_(held.pop()))
        return held[0] if held else None

    def pieces(self, range_bits: int) -> Iterator[CountingQuotientFilter]:
        """Cut at ranges of fingerprints that share their top ``range_bits``."""
        prints, counts = self.prints(), self.counts
        ranges = prints >> np.uint64(64 - range_bits) if range_bits else np.zeros(len(prints), np.uint64)
        starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(ranges) else np.zeros(0, np.int64)
        for a, b in zip(starts, np.r_[starts[1:], len(ranges)], strict=True):
            yield self.laid_out(prints[a:b], counts[a:b], None, int(ranges[a]), range_bits)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, print`` of every row; null text counts as empty."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hexes, prints = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                sha = hashlib.sha256(normalised(text or b""))
                hexes.append(sha.hexdigest())
                prints.append(int.from_bytes(sha.digest()[:8], "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hexes, pa.string()), pa.array(prints, pa.int64())],
                names=["doc_id", "text_sha256", "print"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(digest, f"doc_id {kind}, text_sha256 string, print long")


def repeated_prints(prints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints that occur more than once, with their count, through the filters."""
    range_bits = max(0, (max(1, rows) // RANGE_ROWS).bit_length())
    columns = ("range", "bits", "marks", "remainders", "tallies")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for batch in batches)
        whole = CountingQuotientFilter.merged(CountingQuotientFilter.of(p, np.ones(len(p), np.int64)) for p in parts)
        if whole is not None:
            for f in whole.pieces(range_bits):
                values = (f.top, f.bits, f.marks.tobytes(), f.remainders.tobytes(), f.tallies.tobytes())
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=list(columns))

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        one = CountingQuotientFilter.merged(
            CountingQuotientFilter(
                np.frombuffer(r.marks, np.uint8), np.frombuffer(r.remainders, np.uint64), np.frombuffer(r.tallies, np.int64),
                r.bits, r.range, range_bits,
            )
            for r in pieces.itertuples(index=False)
        )
        counts = one.counts
        return pd.DataFrame({"print": one.prints()[counts > 1].view(np.int64), "n": counts[counts > 1]})

    schema = "range long, bits int, marks binary, remainders binary, tallies binary"
    return prints.select("print").mapInArrow(build, schema).groupBy("range").applyInPandas(merge, "print long, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``docs``.

    Null text counts as empty; empty texts are equal to each other. The smallest id of equal texts
    stays, null ids last; of rows that repeat this id too, one stays. An empty table gives no rows.
    A very long text is hashed and compared whole, like any other.
    """
    docs = id_and_text(docs, id_col, text_col)
    rows = materialize(digests(docs), "digests")
    often = materialize(repeated_prints(rows, rows.count()), "repeated")
    suspects = rows.join(often.select("print"), "print", "left_semi").select("doc_id").distinct()
    suspects = materialize(suspects, "suspects")
    if suspects.count() <= BROADCAST_IDS:
        suspects = F.broadcast(suspects)
    met = suspects.withColumnRenamed("doc_id", "met")
    texts = docs.join(met, docs["doc_id"].eqNullSafe(met["met"]), "left_semi")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    # The byte comparison: equal texts meet in one group, after copies of a partition were combined.
    groups = texts.groupBy(text.alias("text")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    # Numbered before the join, so that a large group of copies is dealt by id and the join may be split.
    first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("print")) == 1
    found = rows.withColumn("_first", first).join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_first") & F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256",
    )
