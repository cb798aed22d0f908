"""Operator 9: byte-level BPE as a streaming transducer with bounded lookahead, and its incremental inverse.

Encoding cuts the text into pretokens, then turns the bytes of each pretoken into tokens. Rank-ordered merging has a
sufficient lookahead: whether a token that ends at some byte is final depends only on a bounded number of bytes after
it, because each merge that could still reach back over a boundary must have a lower rank than the one to its left, so
chains of such merges end. `sufficient_lookahead` computes the bound from the merge list. The transducer keeps a
window of bytes, emits every token that ends at least that far before the window's end, and so needs constant memory
for any input. Decoding maps identifiers to bytes and runs them through an incremental UTF-8 state machine.

Defined results: null text is the empty text, with no tokens; special strings inside a text become their special
identifier, as the tokenizer library does by default; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, arrow_limits, held, map_rows

#: Fixed values of the byte-level format: the bytes that stand for themselves, and the pretoken pattern.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
#: Characters of text that are cut into pretokens at once.
BLOCK = 1 << 16
SHIFT = 20


def byte_alphabet() -> dict[str, int]:
    """Character to byte: printable bytes stand for themselves, the others for 256, 257, ... in order."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes after a token's end that decide whether it is final. merges: (left, right, result) in rank order.

    reach[x]: bytes to the right of a token x that can matter for a merge of x with what follows, over the merges seen
    so far. A merge (u, v) can be undone only by an earlier-ranked merge that takes a token on v's right edge away,
    which needs that token's reach; the edge of v is v, its right part, the right part of that, and so on."""
    edge: dict[int, set[int]] = {}
    reach: dict[int, int] = {}
    for left, right, made in merges:
        on_edge = edge.get(right) or {right}
        need = length[right] + max((reach.get(x, 0) for x in on_edge), default=0)
        reach[left] = max(reach.get(left, 0), need)
        edge.setdefault(made, {made}).update(on_edge)
    return max(reach.values(), default=0)


class Transducer:
    """pairs: left << SHIFT | right -> rank << SHIFT | result."""

    def __init__(self, byte_ids: list[int], merges: list[tuple[int, int, int]], length: dict[int, int], window: int = 512):
        self.byte_ids, self.length = byte_ids, length
        self.pairs: dict[int, int] = {}
        for rank, (left, right, made) in enumerate(merges):
            self.pairs.setdefault(left << SHIFT | right, rank << SHIFT | made)
        self.lookahead = sufficient_lookahead(merges, length)
        # The first token of a full window always ends before the lookahead begins, so every window emits something.
        self.window = max(window, 4 * self.lookahead, self.lookahead + max(length.values()))

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of one window, lowest rank and then leftmost first."""
        if len(ids) > 32:
            return self._merge_long(ids)
        get, big, mask = self.pairs.get, 1 << 62, (1 << SHIFT) - 1
        ranks = [get(a << SHIFT | b, big) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == big:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [made := best & mask]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(made << SHIFT | ids[i + 1], big)
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | made, big)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get, mask = len(ids), self.pairs.get, (1 << SHIFT) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], k = rank & mask, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := get(ids[i] << SHIFT | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << SHIFT | ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of the concatenated chunks, each as soon as it is stable; holds no more than a window and a chunk."""
        held = bytearray()
        for chunk in chunks:
            held += chunk
            while len(held) >= self.window:
                tokens, at = self.merge([self.byte_ids[b] for b in held[: self.window]]), 0
                for t in tokens:
                    if at + self.length[t] > self.window - self.lookahead:
                        break
                    at += self.length[t]
                    yield t
                del held[:at]
        yield from self.merge([self.byte_ids[b] for b in held])


class ByteBpe:
    """A tokenizer file of the byte-level kind, read by its path."""

    def __init__(self, path: str, memo_entries: int = 120_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        raw = lambda piece: bytes(alphabet[c] for c in piece)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.bytes_of = {i: raw(piece) for piece, i in vocab.items()}
        by_byte = {alphabet[c]: vocab[c] for c in alphabet}
        self.transducer = Transducer([by_byte[b] for b in range(256)], [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], {i: len(b) for i, b in self.bytes_of.items()})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretoken, self.cut = regex.compile(PRETOKEN), regex.compile(r"(?<=[^\p{White_Space}])(?=\p{White_Space})")
        self.memo = Memo(self._pretoken_ids, memo_entries)

    def _pretoken_ids(self, piece: str) -> bytes:
        step = self.transducer.window
        return array("I", self.transducer.stream(piece[i : i + step].encode() for i in range(0, len(piece), step))).tobytes()

    def _plain(self, text: str) -> Iterator[bytes]:
        """Identifiers of a text without special strings, a block at a time; a block ends before white space that
        follows something else, where a pretoken always ends."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > BLOCK and (found := self.cut.search(text, at + BLOCK)):
                end = found.start()
            yield b"".join(map(self.memo.__getitem__, self.pretoken.findall(text, at, end) if end < len(text) else self.pretoken.findall(text, at)))
            at = end

    def encode(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit identifiers, in pieces."""
        for part in self.split.split(text) if self.split and any(s in text for s in self.special) else [text]:
            if part in self.special:
                yield array("I", [self.special[part]]).tobytes()
            elif part:
                yield from self._plain(part)

    def decode(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """Text of identifiers; a character that spans pieces waits in the state machine."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of.__getitem__
        for piece in pieces:
            yield machine.decode(b"".join(map(table, array("I", piece))))
        yield machine.decode(b"", True)


def tokenizer(path: str) -> ByteBpe:
    return held(("byte_bpe", path), lambda: ByteBpe(path))


def digest(path: str, text: str | None) -> tuple[int, str, str]:
    """Token count, hash of the identifiers, hash of the decoded text; the text is never held twice."""
    bpe, n, ids, out = tokenizer(path), 0, hashlib.sha256(), hashlib.sha256()

    def passing() -> Iterator[bytes]:
        nonlocal n
        for piece in bpe.encode(text or ""):
            n += len(piece) // 4
            ids.update(piece)
            yield piece

    for part in bpe.decode(passing()):
        out.update(part.encode())
    return n, ids.hexdigest(), out.hexdigest()


def encode_column(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: the tokens themselves."""
    arrow_limits(df.sparkSession)
    one = lambda text: [i for piece in tokenizer(path).encode(text or "") for i in array("I", piece)]
    kind = df.select(id_col).schema[0].dataType.simpleString()
    source = df.select(id_col, text_col)
    return map_rows(source.toDF("id", "text"), lambda c: {id_col: c["id"], "ids": [one(t) for t in c["text"]]}, f"{id_col} {kind}, ids array<int>", pa.schema([(id_col, _arrow(kind)), ("ids", pa.list_(pa.int32()))]))


def decode_column(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: null identifiers give the empty text."""
    arrow_limits(df.sparkSession)
    one = lambda ids: "".join(tokenizer(path).decode([array("I", ids or []).tobytes()]))
    kind = df.select(id_col).schema[0].dataType.simpleString()
    return map_rows(df.select(id_col, ids_col).toDF("id", "ids"), lambda c: {id_col: c["id"], "text": [one(x) for x in c["ids"]]}, f"{id_col} {kind}, text string", pa.schema([(id_col, _arrow(kind)), ("text", pa.string())]))


def digest_column(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    arrow_limits(df.sparkSession)
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(c: dict[str, list]) -> dict[str, list]:
        n, ids, out = zip(*(digest(path, t) for t in c["text"]))
        return {id_col: c["id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": out}

    names = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(df.select(id_col, text_col).toDF("id", "text"), run, names, pa.schema([(id_col, _arrow(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
