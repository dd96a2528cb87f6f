"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without regular expressions over a whole slice of documents at once: each code point becomes a
symbol (its class with what its neighbours say), each symbol a transition function on eight states, and composition of
those functions is associative. So blocks are composed side by side, the blocks' functions are scanned, and every
position then knows its state and whether a token starts there. The slices between starts feed a cached pair merger.
Token ends stay with the ids, so that a decoded byte can be traced to its token.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded one by one; an empty
table gives an empty result; input columns that clash with the results' are replaced. Special tokens are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from proofline.llm.textcols import slices

# ---------------------------------------------------------------- pre-tokenisation

#: States: an open letter, number or other run; a space that joins what follows; an open white-space run; one or two
#: letters of a contraction to come; a closed token.
_LETTER, _NUMBER, _OTHER, _JOIN, _BLANK, _ONE, _TWO, _CLOSED = range(8)
#: Symbols: letter, number, other, apostrophe of a two- or three-character contraction, space or other white space
#: before something else, white space before white space or the end. The first symbol of a document adds 8.
_L, _N, _O, _C2, _C3, _SPACE_LAST, _WHITE_LAST, _WHITE = range(8)
_BLOCK = 128


@cache
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, other or white space."""
    import regex

    table = np.full(0x110000, _O, dtype=np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    points = np.frombuffer(every.encode("utf-32-le"), dtype=np.uint32)
    for pattern, kind in ((r"\p{L}+", _L), (r"\p{N}+", _N), (r"\s+", _WHITE)):
        for m in regex.finditer(pattern, every):
            table[points[m.start() : m.end()]] = kind
    table[0x1C:0x20] = _O  # separators that Python's \s takes as white space, Unicode's White_Space does not
    return table


@cache
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts) by 8 * symbol + state."""
    step, starts = np.zeros((16, 8), dtype=np.uint8), np.ones((16, 8), dtype=bool)
    for symbol in range(16):
        for state in range(8):
            kind, at = symbol % 8, state if symbol < 8 else _CLOSED
            nxt, new = {
                _L: (_LETTER, at not in (_LETTER, _JOIN)),
                _N: (_NUMBER, at not in (_NUMBER, _JOIN)),
                _O: (_OTHER, at not in (_OTHER, _JOIN)),
                _C2: (_OTHER, False) if at in (_OTHER, _JOIN) else (_ONE, True),
                _C3: (_OTHER, False) if at in (_OTHER, _JOIN) else (_TWO, True),
                _SPACE_LAST: (_JOIN, True),
                _WHITE_LAST: (_CLOSED, True),
                _WHITE: (_BLANK, at != _BLANK),
            }[kind]
            if kind == _L and at in (_ONE, _TWO):
                nxt, new = (_CLOSED if at == _ONE else _ONE), False
            step[symbol, state], starts[symbol, state] = nxt, new
    return step.ravel(), starts.ravel()


def _symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbols of code points; firsts: where documents begin."""
    kind = _classes()[points]
    begins = np.zeros(len(points) + 3, dtype=bool)
    begins[firsts] = True
    begins[len(points) :] = True
    after = np.append(kind, np.full(3, _WHITE, dtype=np.uint8))
    white = kind == _WHITE
    last = white & (after[1 : len(kind) + 1] != _WHITE) & ~begins[1 : len(kind) + 1]
    out = kind.copy()
    out[last] = np.where(points[last] == 0x20, _SPACE_LAST, _WHITE_LAST)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.append(points, np.zeros(3, dtype=points.dtype))
        same1 = ~begins[quotes + 1]
        one, two = padded[quotes + 1], padded[quotes + 2]
        out[quotes[same1 & np.isin(one, [ord(c) for c in "stmd"])]] = _C2
        pairs = one.astype(np.uint64) << np.uint64(32) | two.astype(np.uint64)
        out[quotes[same1 & ~begins[quotes + 2] & np.isin(pairs, [ord(p[0]) << 32 | ord(p[1]) for p in ("re", "ve", "ll")])]] = _C3
    out[firsts] += 8
    return out


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Indices of the code points at which pre-tokens start."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    step, starts = _machine()
    wide = _symbols(points, firsts).astype(np.int64) * 8
    rows = -(-n // _BLOCK)
    grid = np.concatenate([wide, np.zeros(rows * _BLOCK - n, dtype=np.int64)]).reshape(rows, _BLOCK)
    columns = np.ascontiguousarray(grid.T)
    # each block's function: where each of the eight states ends up
    functions = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for symbol in columns:
        functions = step[symbol[:, None] + functions]
    # inclusive scan of the functions by doubling: composition is associative
    span = 1
    while span < rows:
        functions[span:] = np.take_along_axis(functions[span:], functions[:-span].astype(np.int64), axis=1)
        span *= 2
    state = np.concatenate([[_CLOSED], functions[:-1, _CLOSED]]).astype(np.uint8)
    found = np.empty((_BLOCK, rows), dtype=bool)
    for j, symbol in enumerate(columns):
        at = symbol + state
        found[j] = starts[at]
        state = step[at]
    return np.flatnonzero(found.T.ravel()[:n])


# ---------------------------------------------------------------- merging


class Codec:
    """Ranks of a byte-level vocabulary with a bounded cache of merged pieces, as packed little-endian ids."""

    CACHED = 400_000

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost among equals."""
        whole = self.packed.get(piece)
        if whole is not None:
            return whole
        ranks, n = self.ranks, len(piece)
        if n <= 48:
            parts = [piece[i : i + 1] for i in range(n)]
            joined = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            while joined:
                low = min(joined)
                if low == _NEVER:
                    break
                i = joined.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del joined[i]
                if i < len(joined):
                    joined[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
                if i:
                    joined[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
            return b"".join(map(self.packed.__getitem__, parts))
        return self._merge_long(piece)

    def _merge_long(self, piece: bytes) -> bytes:
        """The same with a heap over linked parts: n log n for pieces of any length."""
        n, ranks = len(piece), self.ranks
        end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := back[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.packed[piece[i : end[i]]])
            i = end[i]
        return b"".join(out)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens."""
        have = self.cache
        out = list(map(have.get, pieces))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    piece = pieces[i]
                    got = have.get(piece)
                    if got is None:
                        got = self.merge(piece)
                        if len(piece) <= 64:
                            have[piece] = got
                    out[i] = got
            if len(have) > self.CACHED:
                have.clear()
        return out


_NEVER = 1 << 60


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(data: np.ndarray, at: np.ndarray, model: Codec) -> list[np.ndarray]:
    """Ids of each document of a flat slice."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:  # documents with broken bytes are read as the decoder's replacements
        parts = [raw[a:b].decode("utf-8", "replace").encode("utf-8") for a, b in zip(at, at[1:])]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        raw = b"".join(parts)
        text = raw.decode("utf-8")
        data = np.frombuffer(raw, dtype=np.uint8)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    full = at[:-1][at[1:] > at[:-1]]
    starts = leads[token_starts(points, np.searchsorted(leads, full))]
    bounds = starts.tolist()
    pieces = [raw[a:b] for a, b in zip(bounds, [*bounds[1:], len(raw)])]
    packed = model.pieces(pieces)
    first = np.searchsorted(starts, at).tolist()
    return [np.frombuffer(b"".join(packed[a:b]), dtype="<u4") for a, b in zip(first, first[1:])]


def encoded(batches: Iterable[pa.RecordBatch], path: str, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches with ``ids`` and ``token_ends`` (byte offset after each token) beside their other columns."""
    model = codec(path)
    for batch in batches:
        for first, last, data, at in slices(batch.column(batch.schema.get_field_index(text))):
            docs = encode_texts(data, at, model)
            sizes = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
            ids = np.concatenate(docs) if docs else np.zeros(0, dtype="<u4")
            lengths = model.lengths[ids]
            total = np.cumsum(lengths)
            before = np.concatenate([[0], total])[sizes[:-1]]
            ends = total - np.repeat(before, np.diff(sizes))
            lists = lambda values, sizes=sizes: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int32()))
            part = batch.slice(first, last - first)
            keep = [i for i, n in enumerate(part.schema.names) if n.lower() not in ("ids", "token_ends")]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), lists(ids.astype(np.int32)), lists(ends.astype(np.int32))], [*(part.schema.names[i] for i in keep), "ids", "token_ends"])


def decoded(batches: Iterable[pa.RecordBatch], path: str, ids: str = "ids") -> Iterator[pa.RecordBatch]:
    """Batches with ``decoded`` (the bytes of their ids) beside their other columns; null ids decode to no bytes."""
    model = codec(path)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(ids))
        values, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        stops = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        tokens = list(map(model.tokens.__getitem__, values.tolist()))
        out = pa.array([b"".join(tokens[a:b]) for a, b in zip(stops, stops[1:])], pa.binary())
        keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != "decoded"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), out], [*(batch.schema.names[i] for i in keep), "decoded"])


def _with(df: DataFrame, **fields: T.DataType) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name.lower() not in fields]
    return T.StructType([*kept, *(T.StructField(n, t) for n, t in fields.items())])


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``token_ends`` of a text column under the vocabulary at ``path``, which each worker opens itself."""
    return df.mapInArrow(lambda it: encoded(it, path, text), _with(df, ids=T.ArrayType(T.IntegerType()), token_ends=T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes that a column of ids stands for."""
    return df.mapInArrow(lambda it: decoded(it, path, ids), _with(df, decoded=T.BinaryType()))


def digests(batches: Iterable[pa.RecordBatch], keep: tuple[str, ...] = ("doc_id",)) -> Iterator[pa.RecordBatch]:
    """The columns to keep, the number of ids, and SHA-256 of ids and decoded bytes."""
    for batch in batches:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        values, sizes = column["ids"].flatten().to_numpy(zero_copy_only=False).astype("<u4"), pc.list_value_length(column["ids"]).to_numpy(zero_copy_only=False)
        stops = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        own = [
            pa.array(sizes, pa.int64()),
            pa.array([hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(stops, stops[1:])], pa.string()),
            pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in column["decoded"]], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*(column[n] for n in keep), *own], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])


def digest(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, on demand the ids, and the digests: one pass over the texts, with the generators of ``encode`` and ``decode`` joined end to end."""
    keep = ("doc_id", "ids") if ids else ("doc_id",)
    schema = "doc_id long, " + "ids array<int>, " * ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(lambda it: digests(decoded(encoded(it, path), path), keep), schema)


def vocabulary() -> str:
    """The production vocabulary's place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
