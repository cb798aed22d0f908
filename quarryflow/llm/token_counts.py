"""Operator 3: token counts by heap-and-linked-list byte-pair merging, without identifiers.

The symbols of a text form a linked list; a heap holds the adjacent pairs that the piece list knows. The pair of lowest
rank, leftmost first, is merged again and again. The count is the number of initial symbols minus the number of merges;
a character that the piece list lacks counts as its UTF-8 bytes, by byte fallback.

A text is cut where no piece can reach across: before a space that follows something else, and around line feeds, which
no piece holds. Counts of short parts are kept in a bounded memo.

Defined results: null and empty texts have no tokens; control strings such as "<s>" in a text are ordinary characters;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import Memo, arrow_limits, held, map_rows

SPACE = "▁"


class PieceCounter:
    """The merges of a sentencepiece BPE model whose normalizer is the identity with a dummy prefix.

    Pieces are numbered from 1 by score. `pairs` maps two adjacent pieces to the one they form; a heap entry is the rank
    of that one followed by a position in one small integer: the lowest rank first, the leftmost among equals."""

    def __init__(self, path: str, memo_entries: int = 120_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        number = {model.id_to_piece(i): r for r, i in enumerate(sorted(usable, key=model.get_score, reverse=True), 1)}
        score = {r: model.get_score(model.piece_to_id(p)) for p, r in number.items()}
        self.rank = [0]  # pieces of equal score have one rank, the first one's number
        for r in range(1, len(number) + 1):
            self.rank.append(r if r == 1 or score[r] != score[r - 1] else self.rank[-1])
        if any(SPACE in p.lstrip(SPACE) for p in number) or any("\n" in p for p in number):
            raise ValueError("pieces that cross word starts or line feeds are not supported")
        if not any(map(model.is_byte, range(model.vocab_size()))):
            raise ValueError("models without byte fallback are not supported")
        if any(model.encode(x) != model.encode(y) for x, y in self.SAME) or any(model.encode(x) == model.encode(y) for x, y in self.APART):
            raise ValueError("a normalizer that changes text is not supported")
        self.bits, self.unknown = len(number).bit_length(), 0
        self.chars = Memo(lambda c: self.unknown, longest=0)
        self.chars.update((p, i) for p, i in number.items() if len(p) == 1)
        halves = ((number.get(p[:k]), number.get(p[k:]), i) for p, i in number.items() for k in range(1, len(p)))
        self.pairs = {a << self.bits | b: i for a, b, i in halves if a and b}
        self.parts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.memo = Memo(self.count_part, memo_entries)

    #: Texts that an identity normalizer with a dummy prefix must read alike, and apart.
    SAME = ((" a", SPACE + "a"), (" ﬁ ", SPACE + "ﬁ" + SPACE), ("a b", "a" + SPACE + "b"))
    APART = (("ﬁ", "fi"), ("a  b", "a b"), ("a ", "a"), (" a", "a"), ("é", "e\u0301"), ("Ａ", "A"), ("a\tb", "a b"))

    def count_part(self, part: str) -> int:
        bits, get, rank = self.bits, self.pairs.get, self.rank
        ids = [*map(self.chars.__getitem__, part)]
        n = total = len(ids)
        if not all(ids):
            total = sum(1 if i else len(c.encode()) for c, i in zip(part, ids))
        s = n.bit_length()
        heap = [rank[r] << s | i for i, (a, b) in enumerate(pairwise(ids)) if (r := get(a << bits | b))]
        if not heap:
            return total
        heapify(heap)
        after, before, place = [*range(1, n + 1)], [*range(-1, n - 1)], (1 << s) - 1
        ids.append(self.unknown)
        while heap:
            key = heappop(heap)
            i = key & place
            j = after[i]
            made = get(ids[i] << bits | ids[j])
            if not made or rank[made] != key >> s:
                continue  # a part of this pair was merged meanwhile
            total -= 1
            k = after[i] = after[j]
            ids[i], ids[j], h = made, self.unknown, before[i]
            if k < n:
                before[k] = i
                if r := get(made << bits | ids[k]):
                    heappush(heap, rank[r] << s | i)
            if h >= 0 and (r := get(ids[h] << bits | made)):
                heappush(heap, rank[r] << s | h)
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.memo.__getitem__, self.parts.findall(SPACE + text.replace(" ", SPACE))))


def counter(path: str) -> PieceCounter:
    return held(("pieces", path), lambda: PieceCounter(path))


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of every whole text."""
    arrow_limits(df.sparkSession)
    kind = df.select(id_col).schema[0].dataType

    def run(c: dict[str, list]) -> dict[str, list]:
        n = [counter(path).count(t) for t in c["text"]]
        return {id_col: c["id"], "n_bytes": [len((t or "").encode()) for t in c["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    schema = pa.schema([(id_col, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return map_rows(df.select(id_col, text_col).toDF("id", "text"), run, f"{id_col} {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", schema)
