"""Removal of repeated byte strings by suffix sorting.

Every byte that is covered by a string of ``LENGTH`` bytes which also starts earlier (in a document with a smaller id,
or earlier in the same document) is removed. Strings are judged on the input, overlaps count, and no string crosses
documents.

Only suffixes that can repeat are sorted. Each window of ``LENGTH`` bytes belongs to the smallest fingerprint among
the ``ANCHOR``-byte strings inside it, so equal windows belong to equal anchors at equal places, and windows of
anchors that occur once in the corpus are no repeats. Anchors number about 2 in 70 bytes. The suffixes of the other
anchors are sorted, group by group, deep-shallow (``deep_shallow``): a multikey quicksort over 8-byte characters to a
shallow depth, then blind tries for the groups that still hang together. Equal strings come out side by side. The first
sort is over the suffixes where runs of windows start, to the runs' lengths, which settles copies of whole runs; the
second is over the windows of the runs that are left.

Documents are dealt to buckets of about ``BUCKET_BYTES``. A bucket first resolves its own repeats and sends on only the
first of each, so a passage that a third of all documents share arrives at the sort once per bucket, not once per
document; beyond ``FAN_IN`` buckets the sort has further levels, each merging at most so many.

Defined cases: null and empty texts have no bytes and stay as they are; rows that share an id are ordered by their
bucket, then text, equal rows one after the other (one of them is first), so an id on a third of all rows is no single
bucket; a null id comes after all others; a table without rows gives none; columns of the input that clash with the
results' are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.textcols import RollingHash, flat, slices

LENGTH, ANCHOR = 100, 32
BUCKET_BYTES = 1 << 20
FAN_IN = 4_096
SHALLOW = 16
#: Windows sorted at a time.
SORTED = 300_000
_CHUNK = 1 << 20
#: Anchors that a task remembers to have told of.
TOLD = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, place, first window, last window + 1) of each run of windows that one anchor owns.

    Equal fingerprints inside a window count from the left, which the window's content decides.
    """
    width, out = LENGTH - ANCHOR + 1, []
    if len(data) < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    ends = np.repeat(at[1:], np.diff(at))
    for base in range(0, len(data) - LENGTH + 1, _CHUNK):
        part = data[base : base + _CHUNK + LENGTH - 1]
        prints = RollingHash(part).every(ANCHOR)
        low = prints & ~_PLACE | np.arange(len(prints), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :]) if width > span else low
        place = (low & _PLACE).astype(np.int64)
        start = np.arange(len(place)) + base
        whole = start + LENGTH <= ends[start]
        start, place = start[whole], place[whole]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
        stop = np.concatenate([new[1:], [len(start)]])
        out.append((prints[place[new]], place[new] + base, start[new], start[stop - 1] + 1))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Group number of each sorted element: a new one where any key changes."""
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _quicksort(words: np.ndarray, start: np.ndarray, size: np.ndarray, now: np.ndarray, label: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """Multikey quicksort of all groups at once, to ``SHALLOW`` bytes; ``order`` takes the items of each place.

    A round parts every open group by the 8-byte character of its middle member into the smaller, the equal and the
    greater; the equal go on with the next character. Returns (place, item, group) of the groups that still hang together.
    """
    slot, depth = np.arange(len(now)), np.zeros(len(now), dtype=np.int64)
    deep = []
    while len(now):
        heads = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        count = np.diff(np.concatenate([heads, [len(now)]]))
        many = np.repeat(count > 1, count)
        shallow = depth < SHALLOW
        hang = many & ~shallow
        if hang.any():
            deep.append((slot[hang], now[hang], np.repeat(slot[heads], count)[hang]))
        go = many & shallow
        slot, now, label, depth = slot[go], now[go], label[go], depth[go]
        if not len(now):
            break
        heads = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        count = np.diff(np.concatenate([heads, [len(now)]]))
        char = words[start[now] + np.minimum(depth, size[now] - 8)].astype(np.uint64)
        pivot = np.repeat(char[heads + count // 2], count)
        side = (char >= pivot).astype(np.int64) + (char > pivot)
        key = np.repeat(np.arange(len(heads)), count) * 3 + side
        by = np.argsort(key, kind="stable")
        now, label, depth = now[by], key[by], depth[by] + 8 * (side[by] == 1)
        order[slot] = now
    if not deep:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    slot, now, label = (np.concatenate(x) for x in zip(*deep))
    by = np.argsort(slot, kind="stable")
    return slot[by], now[by], label[by]


def deep_shallow(buffer: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by group, then by their first ``size`` bytes (8 at least, the same in a group), then as they come.

    Returns (order, fresh): the suffix at each place, and whether it differs from the one before.
    """
    padded = np.concatenate([buffer, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    now = np.argsort(group, kind="stable")
    order, fresh = now.copy(), np.ones(len(now), dtype=bool)
    slot, now, label = _quicksort(words, start, size, now, _runs(now, group), order)
    # blind tries, those of all groups at once: a member is compared once, with its trie's first leaf, and hangs where
    # they part; what hangs at one branch is a trie again
    while len(now):
        head = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        leaf = np.repeat(now[head], np.diff(np.concatenate([head, [len(now)]])))
        depth, branch, side = (np.zeros(len(now), dtype=np.int64) for _ in range(3))
        open_, k = np.arange(len(now)), SHALLOW
        while len(open_):
            # the last word of a suffix overlaps the one before it
            off = np.minimum(k, size[now[open_]] - 8)
            own, other = words[start[now[open_]] + off].astype(np.uint64), words[start[leaf[open_]] + off].astype(np.uint64)
            apart = own != other
            at = open_[apart]
            if len(at):
                # the first byte that differs, from the highest bit that does
                odd = own[apart] ^ other[apart]
                depth[at] = off[apart] + sum((odd < np.uint64(1 << 8 * j)).astype(np.int64) for j in range(1, 8))
                branch[at] = buffer[start[now[at]] + depth[at]]
                side[at] = np.where(own[apart] > other[apart], 1, -1)
            k += 8
            open_ = open_[~apart & (off + 8 < size[now[open_]])]
        # what is smaller than the leaf comes first, the sooner it parts from it; what is greater, the later
        by = np.lexsort((now, branch, -depth * side, side, label))
        new = np.diff(_runs(by, label, side, depth, branch), prepend=-1) > 0
        now, side = now[by], side[by]
        order[slot] = now
        fresh[slot] |= new
        fresh[slot[(side == 0) & ~new]] = False
        heads = np.flatnonzero(new)
        count = np.diff(np.concatenate([heads, [len(now)]]))
        more = np.repeat(count > 1, count) & (side != 0)
        label = np.repeat(slot[heads], count)[more]
        slot, now = slot[more], now[more]
    return order, fresh


def repeats(buffer: np.ndarray, start: np.ndarray, size: np.ndarray | int, group: np.ndarray) -> np.ndarray:
    """Which suffixes equal an earlier one of their group over their first ``size`` bytes."""
    size = np.broadcast_to(np.asarray(size, dtype=np.int64), start.shape)
    order, fresh = deep_shallow(buffer, start, size, group)
    found = np.zeros(len(start), dtype=bool)
    found[order[~fresh]] = True
    return found


def _anchored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of documents, for the count: (h, b), where b is the bucket.

    An anchor that a slice holds twice is known to repeat: its buckets go on as b = -2 - bucket, and one row with
    b = -1 tells the other tasks. What a task has told goes on as known from then on.
    """
    told = np.zeros(0, dtype=np.int64)
    for batch in batches:
        buckets = batch.column(0).to_numpy()
        for first, last, data, at in slices(batch.column(1)):
            h, place, _, _ = anchors(data, at)
            own = buckets[first:last][np.searchsorted(at, place, side="right") - 1].astype(np.int64)
            order = np.lexsort((own, h))
            h, own = h[order].view(np.int64), own[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            size = np.diff(np.concatenate([np.flatnonzero(new), [len(h)]]))
            before = told[np.minimum(np.searchsorted(told, h), len(told) - 1)] == h if len(told) else np.zeros(len(h), dtype=bool)
            many = np.repeat(size > 1, size) | before
            distinct = new.copy()
            distinct[1:] |= own[1:] != own[:-1]
            known, tell, single = many & distinct, many & new & ~before, ~many
            told = np.union1d(told if len(told) < TOLD else told[:0], h[tell])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[known], h[tell], h[single]])), pa.array(np.concatenate([-2 - own[known], np.full(int(tell.sum()), -1), own[single]]))], ["h", "b"])


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, the known ones apart, those that are known to repeat or share their anchor with another row: (bucket, h)."""
    held = None
    for batch in batches:
        h, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        joined = held is not None and held[2]
        if held is not None:
            h, bucket = np.concatenate([[held[0]], h]), np.concatenate([[held[1]], bucket])
        known = bucket < -1
        if not len(h):
            continue
        twin = np.zeros(len(h), dtype=bool)
        twin[1:] = (h[1:] == h[:-1]) & ~known[1:] & ~known[:-1]
        both = twin.copy()
        both[:-1] |= twin[1:]
        both[0] |= joined
        # the last row may find its twin in the next batch
        wait = not known[-1]
        use = (both | known) & (bucket != -1)
        held = (h[-1], bucket[-1], bool(both[-1])) if wait else None
        if wait:
            use[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(np.where(known, -2 - bucket, bucket)[use]), pa.array(h[use])], ["bucket", "h"])
    if held is not None and held[2] and held[1] >= 0:
        yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([held[0]], pa.int64())], ["bucket", "h"])


_LAST = np.iinfo(np.int64).max


def _ordered(docs: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A bucket's documents by id, then text; and their ids with null as the largest."""
    ids = docs["_id"].fill_null(_LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        texts = docs["_raw"].to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or b"")), dtype=np.int64)
    return docs.take(pa.array(order)), ids[order]


_PARTS = pa.schema([("h", pa.int64()), ("bucket", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("start", pa.int64()), ("off", pa.int32()), ("end", pa.int64()), ("bytes", pa.binary())])
_PARTS_DDL = "h long, bucket long, row int, id long, start long, off int, end long, bytes binary"


def _spans(bucket: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Repeated windows, in order, as rows with the byte ranges [start, end) that they cover."""
    if len(start):
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(start)]]) - 1
        bucket, row, start, end = bucket[new], row[new], start[new], start[last] + LENGTH
    else:
        end = start
    n = len(start)
    none = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(bucket, pa.int64()), pa.array(row, pa.int32()), none(pa.int64()), pa.array(start, pa.int64()), none(pa.int32()), pa.array(end, pa.int64()), none(pa.binary())], schema=_PARTS)


def _windows(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges laid end to end: (range of each element, element)."""
    size = stop - first
    which = np.repeat(np.arange(len(first)), size)
    return which, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + first[which]


def _in_bucket(docs: pa.Table, shared: pa.Table) -> pa.Table:
    """A bucket's own repeats, as spans, and what it sends on: runs of windows that are first in the bucket."""
    docs, ids = _ordered(docs)
    data, at = flat(docs["_raw"])
    h, place, first, stop = anchors(data, at)
    known = np.sort(shared["h"].to_numpy())
    if not len(known) or not len(h):
        return pa.Table.from_batches([], schema=_PARTS)
    near = np.minimum(np.searchsorted(known, h.view(np.int64)), len(known) - 1)
    mine = known[near] == h.view(np.int64)
    h, place, first, stop = h[mine], place[mine], first[mine], stop[mine]
    bucket = int(docs["_bucket"][0].as_py())
    # anchors that the bucket holds twice are sorted here
    names, back, times = np.unique(h, return_inverse=True, return_counts=True)
    twice = times[back] > 1
    which, start = _windows(first[twice], stop[twice])
    which = np.flatnonzero(twice)[which]
    repeated = np.zeros(len(start), dtype=bool)
    for a, b in _cuts(back[which]):
        group = back[which[a:b]].astype(np.int64) << 8 | (place[which[a:b]] - start[a:b])
        repeated[a:b] = repeats(data, start[a:b], LENGTH, group)
    row = np.searchsorted(at, start[repeated], side="right") - 1
    out = [_spans(np.full(len(row), bucket), row, start[repeated] - at[row])]
    # what is first in the bucket goes on, run by run; anchors held once go on whole
    which, start = which[~repeated], start[~repeated]
    new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([new[1:], [len(start)]]).astype(np.int64) - 1 if len(start) else new
    w = np.concatenate([which[new], np.flatnonzero(~twice)])
    a, b = np.concatenate([start[new], first[~twice]]), np.concatenate([start[last] + LENGTH, stop[~twice] - 1 + LENGTH])
    if len(w):
        r = np.searchsorted(at, a, side="right") - 1
        raw = data.tobytes()
        parts = [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
        out.append(pa.RecordBatch.from_arrays([pa.array(h[w].view(np.int64)), pa.array(np.full(len(a), bucket)), pa.array(r, pa.int32()), pa.array(ids[r]), pa.array(a - at[r]), pa.array(place[w] - a, pa.int32()), pa.nulls(len(a), pa.int64()), pa.array(parts, pa.binary())], schema=_PARTS))
    return pa.Table.from_batches(out, schema=_PARTS)


def _lined(data: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of a flat array laid out in another order."""
    _, place = _windows(at[:-1][order], at[1:][order])
    return data[place]


def _cuts(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``SORTED`` elements that keep groups whole. Elements of a group need not be adjacent: then the range is all."""
    if len(group) <= SORTED or (np.diff(group) < 0).any():
        yield 0, len(group)
        return
    edges = np.concatenate([np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    a = 0
    while a < len(group):
        k = min(int(np.searchsorted(edges, a + SORTED)), len(edges) - 1)
        yield a, int(edges[k])
        a = int(edges[k])


def _across(batches: Iterable[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Runs of windows, sorted by anchor, resolved against each other: spans, and before the last level the runs that stay first.

    Rows without bytes are spans of earlier levels and go on as they are.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def resolve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {n: table[n].combine_chunks() for n in ("h", "bucket", "row", "id", "start", "off", "bytes")}
        h, bucket, row, ids, start, off = (col[n].to_numpy() for n in ("h", "bucket", "row", "id", "start", "off"))
        order = np.lexsort((start, row, bucket, ids))
        data, at = flat(col["bytes"])
        _, name, times = np.unique(h, return_inverse=True, return_counts=True)
        # an anchor's only run meets nothing here
        order = order[times[name[order]] > 1] if last else order
        ends = np.cumsum(np.diff(at)[order])
        lined, lined_at = _lined(data, at, order), np.concatenate([[0], ends])
        size = np.diff(lined_at)
        copy = repeats(lined, lined_at[:-1], size, (name[order].astype(np.int64) << 8 | off[order]) << 16 | size)
        gone = order[copy]
        if len(gone):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(gone), pa.int64()), pa.array(bucket[gone]), pa.array(row[gone]), pa.nulls(len(gone), pa.int64()), pa.array(start[gone]), pa.nulls(len(gone), pa.int32()), pa.array(start[gone] + np.diff(at)[gone]), pa.nulls(len(gone), pa.binary())], schema=_PARTS)
        order = order[~copy]
        if last:
            left = np.bincount(name[order], minlength=len(times))
            order = order[left[name[order]] > 1]
        which, win = _windows(at[:-1][order], at[1:][order] - LENGTH + 1)
        run = order[which]
        shift = win - at[run]
        group = name[run].astype(np.int64) << 8 | (off[run] - shift)
        found = repeats(data, win, LENGTH, group)
        yield _spans(bucket[run[found]], row[run[found]], start[run[found]] + shift[found])
        if not last:
            stay = ~found
            run, win, shift = run[stay], win[stay], shift[stay]
            if len(run):
                new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (win[1:] != win[:-1] + 1)]))
                end = np.concatenate([new[1:], [len(run)]]) - 1
                r, raw = run[new], data.tobytes()
                parts = [raw[a : b + LENGTH] for a, b in zip(win[new].tolist(), win[end].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[r]), pa.array(bucket[r]), pa.array(row[r]), pa.array(ids[r]), pa.array(start[r] + shift[new]), pa.array((off[r] - shift[new]).astype(np.int32)), pa.nulls(len(r), pa.int64()), pa.array(parts, pa.binary())], schema=_PARTS)

    for batch in batches:
        own = batch.column("bytes").is_null()
        settled = batch.filter(own)
        if settled.num_rows:
            yield settled.select(_PARTS.names)
            batch = batch.filter(pc.invert(own))
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("bytes").nbytes
        # about as many windows as a run has bytes beyond LENGTH
        if size > 3 * SORTED:
            table = pa.Table.from_batches(held)
            h = table["h"].to_numpy()
            salt = table["salt"].to_numpy()
            before = np.flatnonzero((h != h[-1]) | (salt != salt[-1]))
            cut_at = int(before[-1]) + 1 if len(before) else 0
            if cut_at:
                yield from resolve(table.slice(0, cut_at))
            held = table.slice(cut_at).to_batches()
            size = sum(b.column("bytes").nbytes for b in held)
    if held:
        yield from resolve(pa.Table.from_batches(held))


def _removed(docs: pa.Table, spans: pa.Table, characters: bool = False) -> pa.Table:
    """A bucket's documents without the bytes of their spans; with ``characters`` also as text without the characters that lost a byte."""
    docs, _ = _ordered(docs)
    data, at = flat(docs["_raw"])
    row = spans["row"].to_numpy()
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edge, at[row] + spans["start"].to_numpy(), 1)
    np.add.at(edge, at[row] + spans["end"].to_numpy(), -1)
    gone = np.cumsum(edge[:-1]) > 0
    opens = gone.copy()
    if len(data):
        opens[1:] &= ~gone[:-1]
        begins = at[:-1][at[1:] > at[:-1]]
        opens[begins] = gone[begins]
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    n_gone = count(gone)
    kept_at = np.concatenate([[0], np.cumsum(np.diff(at) - n_gone)])
    left = data[~gone].tobytes()
    parts = [left[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist())]
    own = {"kept": pa.array(parts, pa.binary()), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(n_gone), "n_spans": pa.array(count(opens))}
    if characters:
        begins = (data & 0xC0) != 0x80
        begins[at[:-1][at[1:] > at[:-1]]] = True
        char = np.cumsum(begins) - 1
        stays = ~(np.bincount(char, weights=gone) > 0)[char] if len(data) else ~gone
        ends = np.concatenate([[0], np.cumsum(count(stays))])
        text = data[stays].tobytes()
        own["whole"] = pa.array([text[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
    return pa.table({n: docs[n] for n in docs.column_names if n not in ("_id", "_raw", "_bucket")} | own)


def bucket_of(key: str, text: str, buckets: int) -> Column:
    """The bucket of a row; rows that share an id are spread by their texts."""
    return F.pmod(F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")), F.lit(buckets))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, fan_in: int = FAN_IN, characters: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans`` in place of the text.

    ``characters`` adds ``whole``: the bytes of the characters that lost none, so that a cut inside one leaves no part of it.
    """
    own = ("kept", "n_bytes", "n_removed", "n_spans", *(["whole"] if characters else []), "_id", "_raw", "_bucket")
    rest = [c for c in docs.columns if c.lower() not in own and c != text]
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / bucket_bytes))
    renamed = [F.col(key).cast("long").alias("_id"), F.col(text).cast("binary").alias("_raw"), bucket_of(key, text, buckets).alias("_bucket")]
    raw = docs.select(*rest, *renamed)
    counted = raw.select("_bucket", "_raw").mapInArrow(_anchored, "h long, b long")
    counted = counted.select("h", F.col("b").cast("int").alias("b") if buckets < 1 << 31 else "b")
    # known rows are dealt by bucket too, so a frequent anchor is spread
    dealt = counted.repartition(F.when(F.col("b") < -1, F.xxhash64("h", "b")).otherwise(F.col("h")))
    in_order = dealt.sortWithinPartitions(F.col("b") < -1, "h").select("h", F.col("b").cast("long").alias("b"))
    shared = in_order.mapInArrow(_repeated, "bucket long, h long")
    grouped = raw.groupBy("_bucket")
    runs = grouped.cogroup(shared.groupBy("bucket")).applyInArrow(_in_bucket, _PARTS_DDL)
    # each level is read once: spans that are settled pass through it
    level, last = fan_in, False
    while not last:
        last = buckets <= level
        salt = F.lit(0).cast("long") if last else F.col("bucket") % F.lit(math.ceil(buckets / level))
        salted = runs.withColumn("salt", F.when(F.col("h").isNull(), F.lit(0).cast("long")).otherwise(salt))
        ready = salted.repartition(F.coalesce("h", F.xxhash64("bucket", "row")), "salt").sortWithinPartitions("h", "salt")
        runs = ready.mapInArrow(lambda it, last=last: _across(it, last), _PARTS_DDL)
        level *= fan_in
    spans = runs.where("bytes IS NULL").select("bucket", "row", "start", "end")
    numbers = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    fields = [*(raw.schema[c] for c in rest), T.StructField("kept", T.BinaryType()), *numbers]
    if characters:
        fields.append(T.StructField("whole", T.BinaryType()))
    return grouped.cogroup(spans.groupBy("bucket")).applyInArrow(lambda a, b: _removed(a, b, characters), T.StructType(fields))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents without what they repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
