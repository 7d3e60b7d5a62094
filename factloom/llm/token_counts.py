"""Token counts by byte-pair merging with a heap over a linked list of symbols.

The merge ranks come from the model file; no identifiers are made. A text falls into segments that
no merge can cross, so segments repeat and their counts are remembered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from factloom.llm.common import id_and_text

#: Segments remembered by a Python worker, and the longest one worth remembering.
REMEMBERED, LONGEST = 1_000_000, 48


class PieceMerger(dict):
    """Token counts of segments under the merge ranks of a piece model; remembers what it has counted."""

    BLANK = "▁"

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        usual = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        #: A symbol is the place of its piece in this list; characters without a piece are -1.
        self.symbol = {model.id_to_piece(i): n for n, i in enumerate(usual)}
        place = {x: n for n, x in enumerate(sorted({model.get_score(i) for i in usual}, reverse=True))}
        #: The rank of a merge that makes the symbol; pieces may share one, then the leftmost goes first.
        self.rank = [place[model.get_score(i)] for i in usual]
        crossing = [p for p in self.symbol if self.BLANK in p.lstrip(self.BLANK)]
        if crossing or {c for p in self.symbol for c in p} - self.symbol.keys():
            raise ValueError("a piece has an inner blank, or a character that is no piece")
        self.joined = {
            (self.symbol[p[:k]], self.symbol[p[k:]]): s
            for p, s in self.symbol.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol
        }
        # No piece joins these to others, so segments also start at a run of them.
        alone = re.escape("".join(c for c in "\n\t" if not any(c in p and len(p) > 1 for p in self.symbol)))
        rest = f"[^{self.BLANK}{alone}]*"
        self.segments = re.compile(f"{self.BLANK}+{rest}" + (f"|[{alone}]+{rest}" if alone else ""))

    def merged(self, segment: str) -> int:
        """Initial symbols minus merges; a character without a piece counts its UTF-8 bytes."""
        symbols = [self.symbol.get(c, -1) for c in segment]
        n = len(symbols)
        following, leading = [*range(1, n), -1], list(range(-1, n - 1))
        joined, rank, push = self.joined.get, self.rank, heapq.heappush
        at = [joined(pair, -1) for pair in zip(symbols, symbols[1:])]  # the symbol a merge here would make
        at.append(-1)
        heap = [rank[s] << 40 | i for i, s in enumerate(at) if s >= 0]
        heapq.heapify(heap)
        merges, place = 0, (1 << 40) - 1
        while heap:
            top = heapq.heappop(heap)
            i = top & place
            made = at[i]
            if made < 0 or rank[made] != top >> 40:
                continue  # one of the two has been merged with its other neighbour
            merges += 1
            symbols[i] = made
            j = following[i]
            at[i] = at[j] = -1
            k = following[i] = following[j]
            if k >= 0:
                leading[k] = i
                at[i] = s = joined((made, symbols[k]), -1)
                if s >= 0:
                    push(heap, rank[s] << 40 | i)
            h = leading[i]
            if h >= 0:
                at[h] = s = joined((symbols[h], made), -1)
                if s >= 0:
                    push(heap, rank[s] << 40 | h)
        if -1 in symbols:
            n += sum(len(c.encode()) - 1 for c in segment if c not in self.symbol)
        return n - merges

    def __missing__(self, segment: str) -> int:
        n = self.merged(segment)
        if len(segment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        found = self.segments.findall(self.BLANK + text.replace(" ", self.BLANK))
        return sum(map(self.__getitem__, found))


@lru_cache(2)
def merger(model_file: str) -> PieceMerger:
    """One per Python worker, so that its memory of segments serves all its tasks."""
    return PieceMerger(model_file)


def token_counts(
    docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; ``over_limit`` is ``n_tokens > limit``.

    Null text counts as empty, with 0 bytes and 0 tokens. Special strings inside a text are ordinary
    text. Rows are independent, so ties and repeated rows need no rule; an empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merger(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            n_tokens = pa.array([tokens.count(t) if t else 0 for t in texts], pa.int64())
            over = pa.compute.greater(n_tokens, limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
