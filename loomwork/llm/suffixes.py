"""Removal of byte strings that an earlier document has, by suffix sorting with a difference cover.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller doc_id. All strings are
judged on the input, and none crosses documents.

Sorting all suffixes of a corpus would move each byte many times over. Three lossless steps come first:

* Copies. Equal texts go to the same slice of documents (copies of more than COPY_BYTES or COPIES rows are spread over
  several), where the first stands for all; the others lose everything.
* Sifting. Each window of LENGTH bytes names its minimizer: of the 20-byte grams in it the one with the least hash, the
  leftmost of equals. Equal windows have equal minimizers. Slices of documents send their sets of minimizers, packed, to
  buckets by hash; a minimizer found in one document alone can't belong to a string that two documents share, and its
  windows are done with.
* Grouping. Neighbouring windows with one minimizer overlap; together they are a context, a piece of text of less than two
  windows with a fixed place of its minimizer. Equal windows have equal minimizers, so all windows that may be equal are in
  contexts of one minimizer. A slice has one row for equal contexts, with the places where they stand packed into it.

The contexts are dealt out by minimizer and each task sorts the suffixes of its contexts by the difference cover modulo 3:
the triples at places 1 and 2 are sorted and named, the string of names is sorted by recursion unless the names differ,
the remaining suffixes are sorted by a byte and the rank after it, and both lists are merged. Neighbours in that order that
agree in LENGTH bytes are equal windows; the least document of each class decides.

A minimizer with more than HOT contexts (such as one of a passage that a large part of the documents share) is not left to
one task. Its distinct contexts are cut in two: windows with at least n bytes before the minimizer, and those with fewer,
which have more bytes behind it. Equal windows fall on the same side and agree in the bytes that all windows of their side
hold, by which the halves are dealt to tasks and sorted as above. Halves that are still crowded are cut again; the last
cut leaves one window each, and those of one task are equal. What is found is joined to the packed rows.

Where a document holds a context that an earlier document has too, all of it goes. Where it is itself the first, those of
its windows go whose class has an earlier document. Contexts that share less than a window are dropped before the sort:
two contexts can only share one if they agree in the 15 bytes to the left or to the right of the minimizer.

Defined cases: null text counts as empty; texts shorter than LENGTH lose nothing; a null doc_id counts as larger than all
others, and rows without one don't affect each other; rows that share a doc_id are one document and don't affect each
other; repeated rows give equal rows; a table without rows gives none; other columns are not read; a doc_id that isn't an
integer is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from xxhash import xxh64_intdigest as xxh64

from loomwork.llm.common import drop_scratch, join_counted, join_keyed, only, release, scratch, unknown

LENGTH = 50
GRAM = 20
#: Copies of one text in a slice: rows, and bytes.
COPIES = 2_000
COPY_BYTES = 8_000_000
#: Contexts (one for each slice that has it) of a minimizer that a task sorts, and bytes of text behind a bin of minimizers.
HOT = 20_000
BIN_BYTES = 16_000
#: Bytes of text in a slice, of text behind a bucket of minimizers, and of contexts behind a task that sorts.
SLICE_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000
SORT_BYTES = 64_000_000
#: Bytes that are hashed, and bytes of contexts that are sorted, at a time; the place of a hashed byte must fit PLACE_BITS.
CHUNK = 1_000_000
PLACE_BITS = np.uint64(21)
#: Bits of a minimizer's hash that are compared while sifting; more matches than there are only sift less.
SIFT_BITS = 46
LAST = (1 << 63) - 1


# --- minimizers


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes at each place."""
    x = b.astype(np.uint64)
    for step in (1, 2):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    tail = x[16:] * np.uint64(0x165667B19E3779F9)
    x = x[:-4] | x[4:] << np.uint64(32)
    n = len(tail)
    low, high = x[:n] * np.uint64(0x9E3779B97F4A7C15), x[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = low ^ (high << np.uint64(31) | high >> np.uint64(33)) ^ (tail << np.uint64(17) | tail >> np.uint64(47))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def contexts(b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of at least `length` bytes: first and last window of each context, its minimizer's hash and place."""
    h = gram_hashes(b)
    key = h >> PLACE_BITS << PLACE_BITS | np.arange(len(h), dtype=np.uint64)
    place = (sliding_min(key, length - GRAM + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:] - 1, len(place) - 1)
    at = place[first]
    return first, last, h[at], at


def document_contexts(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document, first window, last window, hash, place of the minimizer) of parts of many documents.

    Short documents are hashed together, with the windows that would cross them cut away; long ones go in parts that
    overlap by a window, which may cut a context in two but no window.
    """
    held: list[tuple[int, bytes]] = []
    size = 0

    def together():
        b = np.frombuffer(b"".join(t for _, t in held), np.uint8)
        sizes = np.array([len(t) for _, t in held])
        ends = np.cumsum(sizes)
        first, last, h, at = contexts(b, length)
        # windows lie within a document: cut contexts where one ends
        doc = np.searchsorted(ends, first, side="right")
        doc_last = np.searchsorted(ends, last, side="right")
        many = doc_last - doc + 1
        each = np.repeat(np.arange(len(first)), many)
        d = doc[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        a = np.maximum(first[each], (ends - sizes)[d])
        z = np.minimum(last[each], ends[d] - length)
        ok = a <= z
        names = np.array([i for i, _ in held])
        return b, names[d[ok]], (ends - sizes)[d[ok]], a[ok], z[ok], h[each][ok], at[each][ok]

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > CHUNK:
            whole = np.frombuffer(t, np.uint8)
            for start in range(0, len(t) - length + 1, CHUNK):
                b = whole[start : start + CHUNK + length - 1]
                first, last, h, at = contexts(b, length)
                yield b, np.full(len(first), i), np.full(len(first), -start), first, last, h, at
            continue
        if size + len(t) > CHUNK and held:
            yield together()
            held, size = [], 0
        held.append((i, t))
        size += len(t)
    if held:
        yield together()


# --- sorting suffixes


def joined(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Numbers that are in the order of the pairs (x, y); y has `bits` bits at most. They are named anew if they need over 64."""
    if int(x.max(initial=0)).bit_length() + bits > 64:
        x = np.unique(x, return_inverse=True)[1].astype(np.uint64)
    return x << np.uint64(bits) | y


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes of text (uint64 symbols from 1 to 2**32 - 1, below 2**32 of them) in order, by the difference cover {1, 2} mod 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.append(text, np.zeros(3, np.uint64))
    bits = max(int(s.max()).bit_length(), n.bit_length())
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with an empty triple at the end if the first list ends with the text
    sample = np.append(one, two)
    pairs = joined(s[:-1], s[1:], bits)
    triples = joined(pairs[sample], s[sample + 2], bits)
    names = np.unique(triples, return_inverse=True)[1].astype(np.uint64)
    if int(names.max()) + 1 < len(sample):
        order = suffix_array(names + np.uint64(1))
        rank = np.empty(len(sample), np.uint64)
        rank[order] = np.arange(1, len(sample) + 1, dtype=np.uint64)
    else:
        rank = names + np.uint64(1)
    of = np.zeros(n + 3, np.uint64)
    of[sample] = rank
    by_rank = np.empty(len(sample), np.int64)
    by_rank[rank.astype(np.int64) - 1] = sample
    by_rank = by_rank[by_rank < n]
    rest = np.arange(0, n, 3)
    by_one = joined(s[rest], of[rest + 1], bits)
    order = np.argsort(by_one, kind="stable")
    rest, by_one = rest[order], by_one[order]
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    smaller = np.searchsorted(joined(s[first], of[first + 1], bits), by_one)
    both = np.append(second, rest)  # named together, so that the numbers can be compared
    of_pair = joined(pairs[both], of[both + 2], bits)
    smaller += np.searchsorted(of_pair[: len(second)], of_pair[len(second) :])
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + smaller
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = by_rank
    return out


def earlier_windows(pieces: list[bytes], least: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each piece, the runs (first byte, end) of its windows that also start in a piece of a smaller document."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), sizes)
    inside = np.arange(len(text)) - starts[piece] <= sizes[piece] - length
    order = suffix_array(text.astype(np.uint64) + np.uint64(1))
    order = order[inside[order]]
    rows = np.lib.stride_tricks.sliding_window_view(text, length)[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    owner = least[piece[order]]
    first = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    gone = np.sort(order[first < owner])
    if len(gone):
        cut = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1] + 1) | (piece[gone[1:]] != piece[gone[:-1]])))
        for a, z in zip(gone[cut].tolist(), gone[np.append(cut[1:], len(gone)) - 1].tolist(), strict=True):
            i = int(piece[a])
            out[i].append((a - int(starts[i]), z - int(starts[i]) + length))
    return out


# --- sifting over the cluster


def packed(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def sifted(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - SIFT_BITS)


def originals(t: pa.Table) -> tuple[list[bytes], list[int], np.ndarray]:
    """A slice's texts with a place each: the row that stands for equal texts, and whether the row is such a row.

    The first by doc_id stands for its copies.
    """
    data, o = t.column("data").to_pylist(), t.column("o").to_numpy()
    first: dict[bytes, int] = {}
    for i, d in enumerate(data):
        j = first.setdefault(d, i)
        if o[i] < o[j]:
            first[d] = i
    of = [first[d] for d in data]
    return data, of, np.array([i == j for i, j in enumerate(of)], bool)


def numbered(o: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows that share a doc_id, counted by the hash of their text: with the slice and the doc_id it names a row."""
    order = np.lexsort((r, o))
    new = np.append(True, o[order][1:] != o[order][:-1])
    at = np.arange(len(o))
    out = np.empty(len(o), np.int32)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def only_originals(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, o and number of the rows that stand for equal texts."""
    data, _, own = originals(t)
    o, r = t.column("o").to_numpy()[own], t.column("r").to_numpy()[own]
    return [d for d, x in zip(data, own, strict=True) if x], o, numbered(o, r)


def sets_of_slice(buckets: int, length: int):
    """A slice's distinct minimizers by bucket, and which of them two documents of the slice share."""

    def run(t: pa.Table) -> pa.Table:
        texts, o, _ = only_originals(t)
        hs, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, doc, _, _, _, h, _ in document_contexts(texts, length):
            hs.append(sifted(h))
            docs.append(o[doc])
        h, d = np.concatenate(hs), np.concatenate(docs)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        shared = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(h) else np.empty(0, bool)
        h = h[at]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, shared, bucket = (h // np.uint64(buckets))[order], shared[order], bucket[order]
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
        rows = [(int(bucket[a]), packed(h[a:z]), np.packbits(shared[a:z]).tobytes()) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        mine = t.column("slice")[0].as_py()
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "slice": pa.array([mine] * len(rows), pa.int32()), "hashes": pa.array(cols[1], pa.binary()), "shared": pa.array(cols[2], pa.binary())})

    return run


def hits_of_bucket(buckets: int):
    """Which minimizers of each slice are found in another document."""

    def run(t: pa.Table) -> pa.Table:
        k = t.column("bucket")[0].as_py()
        sets = [unpacked(x) for x in t.column("hashes").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(s)).astype(bool) for f, s in zip(t.column("shared").to_pylist(), sets, strict=True)]
        values, n = np.unique(np.concatenate(sets), return_counts=True)
        many = n > 1
        for s, f in zip(sets, flags, strict=True):
            many[np.searchsorted(values, s[f])] = True
        out = [packed(s[many[np.searchsorted(values, s)]] * np.uint64(buckets) + np.uint64(k)) for s in sets]
        return pa.table({"slice": t.column("slice"), "hits": pa.array(out, pa.binary())})

    return run


#: A place of a context: the document's order, the byte where it starts, the number of the document's row.
SPOT = np.dtype([("o", "<i8"), ("pos", "<i8"), ("k", "<i4")])
CONTEXT = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("least", pa.int64()), ("core", pa.int32()), ("size", pa.int32()), ("spots", pa.binary()), ("piece", pa.binary())])
FOUND = "slice int, spots binary, m bigint, size int, runs array<int>"


def cut_binary(data: bytes, bounds: np.ndarray) -> pa.Array:
    """data cut at the bounds (which start with 0) as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)])


def contexts_of_slice(length: int):
    """The contexts whose minimizer is found in another document, a row for equal ones, with their places."""

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        if not t.num_rows or not found.num_rows:
            return CONTEXT.empty_table()
        known = np.sort(np.concatenate([unpacked(x) for x in found.column("hits").to_pylist()]))
        if not len(known):
            return CONTEXT.empty_table()
        texts, o, k = only_originals(t)
        parts, pieces = [], []
        for b, doc, base, first, last, h, at in document_contexts(texts, length):
            s = sifted(h)
            near = np.minimum(np.searchsorted(known, s), len(known) - 1)
            ok = np.flatnonzero(known[near] == s)
            raw = b.tobytes()
            mine = [raw[a:z] for a, z in zip(first[ok].tolist(), (last[ok] + length).tolist(), strict=True)]
            core = (at[ok] - first[ok]).astype(np.int32)
            c = np.fromiter((xxh64(p, k) for p, k in zip(mine, core.tolist(), strict=True)), np.uint64, len(mine)).view(np.int64)
            parts.append((h[ok].view(np.int64), c, o[doc[ok]], k[doc[ok]], first[ok] - base[ok], core, np.array([len(p) for p in mine], np.int32)))
            pieces += mine
        if not pieces:
            return CONTEXT.empty_table()
        h, c, o, k, pos, core, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((o, c, h))
        h, c, o, k, pos, core, size = (x[order] for x in (h, c, o, k, pos, core, size))
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        spots = np.empty(len(h), SPOT)
        spots["o"], spots["pos"], spots["k"] = o, pos, k
        return pa.table([*(pa.array(x[at]) for x in (h, c, o, core, size)), cut_binary(spots.tobytes(), np.append(at, len(h)) * SPOT.itemsize), pa.array([pieces[i] for i in order[at].tolist()], pa.binary())], schema=CONTEXT)

    return run


# --- sorting over the cluster


def may_share(h: np.ndarray, core: np.ndarray, pieces: list[bytes], length: int) -> np.ndarray:
    """Pieces that agree with another of their group in enough bytes on one side of the minimizer to share a window."""
    side = (length - GRAM + 1) // 2
    out = np.zeros(len(pieces), bool)
    left = [p[max(0, c - side) : c] for p, c in zip(pieces, core.tolist(), strict=True)]
    right = [p[c + GRAM : c + GRAM + side] for p, c in zip(pieces, core.tolist(), strict=True)]
    for part in (left, right):
        seen: dict[tuple[int, bytes], int] = {}
        for i, key in enumerate(zip(h.tolist(), part, strict=True)):
            if len(key[1]) == side:
                j = seen.setdefault(key, i)
                if j != i:
                    out[i] = out[j] = True
    return out


def runs_of_groups(g: np.ndarray, core: np.ndarray, m: np.ndarray, size: np.ndarray, pieces: pa.Array, length: int) -> dict[int, list[int]]:
    """By place, first byte and end of each run that an earlier document has, one after the other.

    Rows are distinct pieces in the order of their groups g; no window is in two groups. Groups are sorted about CHUNK bytes
    at a time.
    """
    out: dict[int, list[int]] = {}
    if not len(g):
        return out
    bounds = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
    total = np.append(0, np.cumsum(size.astype(np.int64)))
    many = np.repeat(np.diff(bounds) > 1, np.diff(bounds))  # a group of one piece has no other window to compare
    start = 0
    while start < len(bounds) - 1:
        stop = max(start + 1, int(np.searchsorted(total[bounds], total[bounds[start]] + CHUNK, side="right")) - 1)
        pick = np.flatnonzero(many[bounds[start] : bounds[stop]]) + bounds[start]
        start = stop
        raw = pieces.take(pa.array(pick)).to_pylist()
        keep = np.flatnonzero(may_share(g[pick], core[pick], raw, length))
        if len(keep):
            found = earlier_windows([raw[i] for i in keep], m[pick[keep]], length)
            out.update((int(pick[i]), [x for run in runs for x in run]) for i, runs in zip(keep.tolist(), found, strict=True) if runs)
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts) if parts else None


def sort_contexts(length: int):
    """The packed rows that lose bytes: whole contexts where a document is later than m, runs of bytes where it is m. Tasks hold whole minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        order = np.lexsort((t.column("c").to_numpy(), t.column("h").to_numpy()))
        h, c, least, core, size = (t.column(x).to_numpy()[order] for x in ("h", "c", "least", "core", "size"))
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        m = np.minimum.reduceat(least, at)
        of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
        pieces = t.column("piece").take(pa.array(order[at])).combine_chunks()
        runs = runs_of_groups(h[at], core[at], m, size[at], pieces, length)
        spots = t.column("spots").take(pa.array(order)).combine_chunks()
        with_runs = np.zeros(len(at), bool)
        with_runs[list(runs)] = True
        # a row of one place in the least document, none of whose windows an earlier one has, loses nothing
        rows = np.flatnonzero((least > m[of]) | (pc.binary_length(spots).to_numpy() > SPOT.itemsize) | with_runs[of])
        lists = pa.array([runs.get(i, []) for i in of[rows].tolist()], pa.list_(pa.int32()))
        slices_ = t.column("slice").to_numpy()[order][rows]
        yield pa.RecordBatch.from_arrays([pa.array(slices_), spots.take(pa.array(rows)), pa.array(m[of[rows]]), pa.array(size[rows]), lists], ["slice", "spots", "m", "size", "runs"])

    return run


def sort_parts(length: int):
    """g, p, m, _n, runs of distinct parts of contexts; runs are what a part of the least document m loses, _n how many contexts have it.
    Tasks hold whole groups g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        order = np.argsort(t.column("g").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        pieces = t.column("piece").combine_chunks()
        g, core, m = (t.column(x).to_numpy() for x in ("g", "core", "m"))
        runs = runs_of_groups(g, core, m, pc.binary_length(pieces).to_numpy(), pieces, length)
        rows = pa.array(np.flatnonzero((t.column("n").to_numpy() > 1) | np.isin(np.arange(len(g)), list(runs))))
        lists = pa.array([runs.get(i, []) for i in rows.to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(t.column(x).take(rows).combine_chunks() for x in ("g", "p", "m", "n")), lists], ["g", "p", "m", "_n", "runs"])

    return run


def halves(parts: DataFrame, length: int) -> DataFrame:
    """Parts of contexts cut in two by the bytes before the minimizer: lo to hi of them become lo to mid and mid + 1 to hi.

    h, c, m name the context; at is where the part starts in it, core where the minimizer starts in the part. All windows of
    a part hold the lo bytes before the minimizer, the minimizer and the bytes behind it that a window with hi before it has;
    g is the hash of these, by which the part meets all that can share a window with it, and p that of its bytes.
    """
    mid = F.expr("cast(floor((lo + hi) / 2) as int)")
    sides = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
    cut = parts.drop("g", "p").withColumn("side", F.explode(sides)).withColumn("lo", F.col("side.lo")).withColumn("hi", F.col("side.hi")).drop("side")
    cut = cut.withColumn("a", F.greatest(F.lit(0), F.col("core") - F.col("hi"))).withColumn("z", F.least(F.length("piece") - length, F.col("core") - F.col("lo"))).filter("a <= z")
    cut = cut.select("h", "c", "m", "lo", "hi", (F.col("at") + F.col("a")).alias("at"), (F.col("core") - F.col("a")).alias("core"), F.expr(f"substring(piece, a + 1, z - a + {length})").alias("piece"))
    held = F.expr(f"substring(piece, core - lo + 1, lo + {length} - hi)")
    return cut.withColumn("g", F.xxhash64("h", "lo", "hi", held)).withColumn("p", F.xxhash64("piece"))


def runs_of_crowded(crowded: DataFrame, length: int, hot_contexts: int) -> DataFrame:
    """h, c, m, _n (rows), runs of the contexts of crowded minimizers, sorted in parts."""
    whole = crowded.groupBy("h", "c").agg(F.min("least").alias("m"), F.count(F.lit(1)).alias("_n"), F.first("piece").alias("piece"), F.first("core").alias("core"))
    parts = whole.select("h", "c", "m", F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"), F.lit(0).alias("at"), "core", "piece")
    contexts_ = scratch(whole.select("h", "c", "m", "_n"), "suffix-crowded", codec="zstd")
    found = []
    while True:
        parts = scratch(halves(parts, length), "suffix-parts", codec="zstd")
        kinds = parts.groupBy("g", "p").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("n"), F.first("piece").alias("piece"), F.first("core").alias("core"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
        kinds = scratch(kinds, "suffix-kinds", codec="zstd")
        many = scratch(kinds.filter("lo < hi").groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_contexts).select("g"), "suffix-many")
        again = bool(many.head(1))
        ready = kinds.join(many, "g", "left_anti") if again else kinds
        lost = scratch(ready.select("g", "p", "m", "n", "core", "piece").repartition("g").mapInArrow(sort_parts(length), "g bigint, p bigint, m bigint, _n bigint, runs array<int>"), "suffix-lost", codec="zstd")
        mine = join_counted(parts.select("h", "c", F.col("m").alias("own"), "at", F.length("piece").alias("size"), "g", "p"), lost, ["g", "p"])
        gone = F.when(F.col("own") > F.col("m"), F.array(F.lit(0), F.col("size"))).otherwise(F.col("runs"))
        found.append(mine.select("h", "c", F.transform(gone, lambda x: x + F.col("at")).alias("runs")).filter(F.size("runs") > 0))
        if not again:
            break
        parts = parts.join(many, "g", "left_semi")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    # a context has at most length - GRAM + 1 windows, which bounds its list
    runs = every.groupBy("h", "c").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return contexts_.join(runs, ["h", "c"], "left").select("h", "c", "m", "_n", F.coalesce("runs", F.array().cast("array<int>")).alias("runs"))


def crowded_minimizers(found: DataFrame, total: int, hot_contexts: int) -> DataFrame:
    """h of more than hot_contexts rows; they are counted in bins first, which bounds what is counted one by one."""
    bins = max(1, total // BIN_BYTES)
    binned = found.select("h", F.pmod("h", F.lit(bins)).alias("bin"))
    counted = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_contexts).select(c)
    full = scratch(counted(binned, "bin"), "suffix-bins")
    return scratch(counted(binned.join(full, "bin", "left_semi"), "h"), "suffix-hot") if full.head(1) else full.select(F.col("bin").alias("h"))


def lost_bytes(found: DataFrame, total: int, length: int, hot_contexts: int) -> DataFrame:
    """slice, spots, m, size, runs: the packed contexts that lose bytes."""
    hot = crowded_minimizers(found, total, hot_contexts)
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SORT_BYTES))
    sort = lambda df: df.select("h", "c", "least", "core", "size", "slice", "spots", "piece").repartition(tasks, "h").mapInArrow(sort_contexts(length), FOUND)
    if not hot.head(1):
        return sort(found)
    crowded = found.join(hot, "h", "left_semi")
    runs = scratch(runs_of_crowded(crowded, length, hot_contexts), "suffix-runs", codec="zstd")
    spots = join_counted(crowded.select("h", "c", "slice", "spots", "size"), runs, ["h", "c"])
    return sort(found.join(hot, "h", "left_anti")).unionByName(spots.select("slice", "spots", "m", "size", "runs"))


def sliced(df: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, o (its order), r (hash of the text), data, slice of the documents, and the bytes of all texts together."""
    docs = only(df, "doc_id", "text").select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("o"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    docs = docs.withColumn("r", F.xxhash64("data"))
    per = scratch(docs.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data").cast("long")).alias("size")), "suffix-texts")
    total = per.agg(F.sum("size")).first()[0] or 0
    slices = max(1, -(-total // SLICE_BYTES))
    spread = F.greatest(F.ceil(F.col("n") / COPIES), F.ceil(F.col("size") / COPY_BYTES))
    copied = scratch(per.filter(F.col("n") > 1).select("r", spread.alias("spread")).filter("spread > 1"), "suffix-copied")
    docs = join_keyed(docs, copied, "r", "left")
    salt = F.when(F.col("spread").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("o"), F.col("spread")))
    return docs.select("doc_id", "o", "r", "data", F.pmod(F.xxhash64("r", salt.cast("long")), F.lit(slices)).cast("int").alias("slice")), total


def repeats(df: DataFrame, length: int = LENGTH, hot_contexts: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, o, r, data, slice), and the packed contexts that lose bytes, with documents by o and numbered()."""
    unknown(df, ["doc_id", "text"])
    if not isinstance(df.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id must be an integer")
    spark = df.sparkSession
    docs, total = sliced(df)
    buckets = max(1, -(-total // BUCKET_BYTES))
    sets = docs.groupBy("slice").applyInArrow(sets_of_slice(buckets, length), "bucket int, slice int, hashes binary, shared binary")
    hits = sets.groupBy("bucket").applyInArrow(hits_of_bucket(buckets), "slice int, hits binary")
    kinds = "h bigint, c bigint, least bigint, core int, size int, spots binary, piece binary, slice int"
    found = docs.groupBy("slice").cogroup(hits.groupBy("slice")).applyInArrow(with_slice(contexts_of_slice(length)), kinds)
    found = scratch(found, "suffix-contexts", codec="zstd")
    del sets, hits
    release(spark)
    lost = scratch(lost_bytes(found, total, length, hot_contexts), "suffix-lost", codec="zstd")
    drop_scratch(found)
    release(spark)
    return docs, lost


def with_slice(make):
    """make's table with the slice of the left group."""

    def run(t: pa.Table, other: pa.Table) -> pa.Table:
        out = make(t, other)
        mine = t.column("slice")[0].as_py() if t.num_rows else None
        return out.append_column("slice", pa.array([mine] * out.num_rows, pa.int32()))

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    at = np.flatnonzero(new)
    return list(zip(starts[at].tolist(), ends[np.append(at[1:], len(starts)) - 1].tolist(), strict=True))


def ranges_of(lost: pa.Table) -> tuple[np.ndarray, ...]:
    """o, k, start, end of the byte ranges that the packed rows describe."""
    spots = np.frombuffer(b"".join(lost.column("spots").to_pylist()), SPOT)
    row = np.repeat(np.arange(lost.num_rows), pc.binary_length(lost.column("spots")).to_numpy() // SPOT.itemsize)
    m, size = lost.column("m").to_numpy()[row], lost.column("size").to_numpy()[row]
    later, first = spots["o"] > m, np.flatnonzero(spots["o"] == m)
    runs = lost.column("runs").combine_chunks()
    edges, values = runs.offsets.to_numpy().astype(np.int64), runs.values.to_numpy().astype(np.int64)
    n = np.diff(edges)[row[first]] // 2
    each = np.repeat(first, n)
    at = edges[row[each]] + 2 * (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
    pos = spots["pos"]
    o, k = (np.concatenate([spots[x][later], spots[x][each]]) for x in ("o", "k"))
    return o, k, np.concatenate([pos[later], pos[each] + values[at]]), np.concatenate([pos[later] + size[later], pos[each] + values[at + 1]])


def each_document(docs: DataFrame, lost: DataFrame, length: int, make, columns: list[tuple[str, pa.DataType]], fields: str) -> DataFrame:
    """make(data, runs) for each document, with the runs of bytes to remove."""
    names = ["doc_id", *(n for n, _ in columns)]

    def run(t: pa.Table, gone: pa.Table) -> pa.Table:
        o, k, a, z = ranges_of(gone) if gone.num_rows else (np.empty(0, np.int64),) * 4
        order = np.lexsort((k, o))
        o, k, a, z = o[order], k[order], a[order], z[order]
        at = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (k[1:] != k[:-1]))) if len(o) else np.empty(0, np.int64)
        of = {(int(o[i]), int(k[i])): merged(a[i:j], z[i:j]) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(o)], strict=True)}
        data, standing, own = originals(t)
        owner = t.column("o").to_numpy()
        number = np.zeros(len(data), np.int32)
        number[own] = numbered(owner[own], t.column("r").to_numpy()[own])
        rows = []
        for i, (d, j) in enumerate(zip(data, standing, strict=True)):
            copy = owner[j] < owner[i] and len(d) >= length
            rows.append(make(d, [(0, len(d))] if copy else of.get((int(owner[j]), int(number[j])), [])))
        cols = list(zip(*rows, strict=True)) or [[]] * len(columns)
        return pa.table([t.column("doc_id"), *(pa.array(c, kind) for c, (_, kind) in zip(cols, columns, strict=True))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.groupBy("slice").cogroup(lost.groupBy("slice")).applyInArrow(run, f"doc_id {kind}, {fields}")


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove(df: DataFrame, length: int = LENGTH, hot_contexts: int = HOT) -> DataFrame:
    """doc_id, kept binary: the bytes that stay (a cut may fall within a character)."""
    docs, lost = repeats(df, length, hot_contexts)
    return each_document(docs, lost, length, lambda d, runs: (without(d, runs),), [("kept", pa.binary())], "kept binary")


def report(df: DataFrame, length: int = LENGTH, hot_contexts: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, lost = repeats(df, length, hot_contexts)
    make = lambda d, runs: (len(d), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(d, runs)).hexdigest())
    columns = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    return each_document(docs, lost, length, make, columns, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
