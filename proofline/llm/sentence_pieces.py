"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model crosses from another character to a white-space marker (checked when the model is read), so the
marked words of a text (a run of markers with what follows up to the next run) are segmented independently. Each slice
of documents is cut into marked words at once, its distinct words are looked up in a table, and the ids are joined
back by position, as one gather. The table is made first: marked words are counted over all documents, the most
frequent ``TABLED`` ones are segmented once, by Spark, and sent to the tasks. Which words these are never changes an id.
The words beyond are segmented where they stand, once per slice (most occur once or twice): a join by position over
a shuffle would send every document's ids to save that.

Defined cases: a null or empty text has the end id alone and decodes to the empty text; repeated rows are encoded one
by one; an empty table gives an empty result; input columns that clash with the results' are replaced; U+2581 is the
marker itself and decodes to a space; bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.textcols import slices

#: The white-space marker, as the model's format fixes it.
MARK = "▁"
_MARK_BYTES = MARK.encode()
#: Marked words in the table sent to the tasks, and the length in bytes of the longest of them: at most 20 MB.
TABLED, TABLED_BYTES = 1 << 17, 48
#: A slice reports a marked word for the table from so many occurrences on. It bounds the shuffle and changes no id.
REPORTED = 4
SLICE = 4 << 20
_CACHED = 200_000
_NEVER = 1 << 60


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("proofline-each-byte", _each_byte)


class Pieces:
    """A BPE piece model with byte fallback: ranks of its pieces, surfaces of its ids."""

    def __init__(self, path: str):
        import sentencepiece  # reads the model file; segmentation below is its own

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        plain = sorted((i for i in range(size) if not special[i]), key=lambda i: (-model.get_score(i), i))
        if any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("pieces cross white-space markers: marked words are not independent")
        self.rank = {names[i]: r for r, i in enumerate(plain)}
        self.id = {names[i]: i for i in plain}
        self.byte = {int(names[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        surface = lambda i: b"" if model.is_control(i) else bytes([int(names[i][3:-1], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i) else names[i].replace(MARK, " ").encode()
        self.surface = [surface(i) for i in range(size)]
        self.control = np.array([model.is_control(i) for i in range(size)])
        self.decimal = [str(i) for i in range(size)]
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def segment(self, word: str) -> tuple[int, ...]:
        """Ids of one marked word: the adjacent parts whose join ranks best are joined first, the leftmost among equals."""
        rank = self.rank
        if len(word) > 48:
            parts = self._long(word)
        else:
            parts = list(word)
            joined = [rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            while joined:
                low = min(joined)
                if low == _NEVER:
                    break
                i = joined.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del joined[i]
                if i < len(joined):
                    joined[i] = rank.get(parts[i] + parts[i + 1], _NEVER)
                if i:
                    joined[i - 1] = rank.get(parts[i - 1] + parts[i], _NEVER)
        out: list[int] = []
        for part in parts:
            known = self.id.get(part)
            if known is not None:
                out.append(known)
            elif self.byte:
                out.extend(self.byte[b] for b in part.encode())
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one id
                out.append(self.unknown)
        return tuple(out)

    def _long(self, word: str) -> list[str]:
        """Parts of a word of any length: a heap over linked parts, n log n."""
        n, rank = len(word), self.rank
        stop, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = stop[i]
            if not alive[i] or j >= n or stop[j] != end:
                continue
            alive[j], stop[i] = False, end
            if end < n:
                back[end] = i
                if (r := rank.get(word[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            if (h := back[i]) >= 0 and (r := rank.get(word[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        found, i = [], 0
        while i < n:
            found.append(word[i : stop[i]])
            i = stop[i]
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for: the first piece loses its marker, bytes that form no character become U+FFFD."""
        tokens = list(map(self.surface.__getitem__, ids.tolist()))
        first = next(iter(np.flatnonzero(~self.control[ids]).tolist()), None)
        if first is not None and tokens[first][:1] == b" " and ids[first] != self.unknown and tokens[first] != b"" and int(ids[first]) not in self._bytes:
            tokens[first] = tokens[first][1:]
        raw = b"".join(tokens)
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "proofline-each-byte").encode()
        return raw

    @property
    def _bytes(self) -> frozenset[int]:
        return frozenset(self.byte.values())


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _valid(data: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A slice as valid UTF-8 with plain spaces for markers."""
    raw = data.tobytes()
    try:
        raw.decode()
        bad = False
    except UnicodeDecodeError:
        bad = True
    if not bad and _MARK_BYTES not in raw:
        return raw, at
    parts = [raw[a:b] for a, b in zip(at, at[1:])]
    parts = [(p.decode("utf-8", "proofline-each-byte").encode() if bad else p).replace(_MARK_BYTES, b" ") for p in parts]
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def marked_words(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All marked words of a slice in order, as distinct values with indices, and the first word of each document (and the total).

    Every text that is not empty begins with one more marker, as the model's format wants it.
    """
    raw, at = _valid(data, at)
    full = at[:-1][at[1:] > at[:-1]]
    led = np.insert(np.frombuffer(raw, dtype=np.uint8), full, 0x20)
    firsts = full + np.arange(len(full))
    space = led == 0x20
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[firsts] = True
    starts = np.flatnonzero(opens)
    offsets = pa.py_buffer(np.append(starts, len(led)).astype(np.int32))
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(led)])
    begin = at + np.concatenate([[0], np.cumsum(at[1:] > at[:-1])])
    return words.dictionary_encode(), np.searchsorted(starts, begin)


def _segment(model: Pieces, words: list[bytes], table: dict[bytes, tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Ids of distinct words: from the table, from what the worker saw lately, or segmented here."""
    own, out = model.cache, []
    for word in words:
        got = table.get(word)
        if got is None:
            got = own.get(word)
            if got is None:
                got = model.segment(word.decode().replace(" ", MARK))
                if len(word) <= TABLED_BYTES:
                    own[word] = got
        out.append(got)
    if len(own) > _CACHED:
        own.clear()
    return out


def encode_slice(data: np.ndarray, at: np.ndarray, model: Pieces, table: dict[bytes, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents one after another, each with the end id; offsets of the documents)."""
    words, first = marked_words(data, at)
    distinct = _segment(model, words.dictionary.to_pylist(), table)
    sizes = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
    begins = np.cumsum(sizes) - sizes
    pool = np.fromiter((i for ids in distinct for i in ids), dtype=np.int32, count=int(sizes.sum()))
    index = words.indices.to_numpy(zero_copy_only=False)
    counts = sizes[index]
    ends = np.concatenate([[0], np.cumsum(counts)])
    joined = pool[np.repeat(begins[index] - ends[:-1], counts) + np.arange(ends[-1])]
    stops = ends[first[1:]]
    return np.insert(joined, stops, model.end).astype(np.int32), np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])


def _broadcast_table(spark, found: DataFrame) -> object:
    rows = found.select("chunk", "ids").toArrow()
    return spark.sparkContext.broadcast(dict(zip(rows.column("chunk").to_pylist(), map(tuple, rows.column("ids").to_pylist()))))


def distinct_chunks(docs: DataFrame, path: str, text: str = "text", most: int | None = TABLED, reported: int = REPORTED) -> DataFrame:
    """(chunk, n, ids): marked words, how often slices reported them, and their ids, each segmented once.

    ``most``: the most frequent so many, of at most ``TABLED_BYTES`` bytes. With most=None and reported=1 it is every distinct
    marked word with its exact count.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in slices(batch.column(0), SLICE):
                words, _ = marked_words(data, at)
                n = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
                keep = n >= reported
                if most is not None:
                    keep &= np.diff(np.frombuffer(words.dictionary.buffers()[1], dtype=np.int32)[: len(words.dictionary) + 1]) <= TABLED_BYTES
                yield pa.RecordBatch.from_arrays([words.dictionary.filter(pa.array(keep)), pa.array(n[keep], pa.int64())], ["chunk", "n"])

    def segmented(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            ids = [model.segment(w.decode().replace(" ", MARK)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["chunk", "n", "ids"])

    seen = docs.select(text).mapInArrow(counted, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    if most is not None:
        # the limit is one task's work on at most ``most`` rows of each partition; segmenting is spread again
        seen = seen.orderBy(F.desc("n"), "chunk").limit(most).repartition(F.xxhash64("chunk"))
    return seen.mapInArrow(segmented, "chunk binary, n long, ids array<int>")


def _with(df: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name.lower() not in fields), *(T.StructField(n, t) for n, t in fields.items())])


def encode(df: DataFrame, path: str, text: str = "text", tabled: int = TABLED) -> DataFrame:
    """``df`` with ``ids`` of a text column under the model at ``path``, the end id last. Two passes over the texts: table, then ids."""
    sent = _broadcast_table(df.sparkSession, distinct_chunks(df, path, text, tabled))
    schema = _with(df, ids=T.ArrayType(T.IntegerType()))

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = pieces(path), sent.value
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != "ids"]
            for begin, end, data, at in slices(batch.column(batch.schema.get_field_index(text)), SLICE):
                ids, ends = encode_slice(data, at, model, table)
                part = batch.slice(begin, end - begin)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), lists], [*(part.schema.names[i] for i in keep), "ids"])

    return df.mapInArrow(encoded, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text that a column of ids stands for; null ids decode to the empty text."""

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != "decoded"]
            rows = _id_rows(batch.column(batch.schema.get_field_index(ids)))
            out = pa.array([model.decode(x) for x in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), out], [*(batch.schema.names[i] for i in keep), "decoded"])

    return df.mapInArrow(decoded, _with(df, decoded=T.StringType()))


def _id_rows(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of ids; null is empty."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, SHA-256 of the ids in decimal and of the decoded text: ids are digested and decoded as they come."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            rows = _id_rows(batch.column(1))
            of_ids = [hashlib.sha256(" ".join(map(model.decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in rows]
            of_text = [hashlib.sha256(model.decode(x)).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = encode(docs.select("doc_id", "text"), path).select("doc_id", "ids")
    return own.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    """The production model's place."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
