"""Operator 7: removal of byte strings that an earlier document has, with suffix arrays per shard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mix
from .store import Stage, release_shuffles

#: Length of the strings, of an anchor, and the number of anchor starts in a string.
LENGTH, ANCHOR = 50, 16
STARTS = LENGTH - ANCHOR + 1
CHUNK_BYTES = 1 << 20
#: Bytes of runs in a shard of the suffix arrays, and the different runs that one anchor may bring into it; an anchor
#: with more is refined by its neighbouring bytes, and what is still larger is cut into several shards.
SHARD_BYTES = 1 << 20
SHARD_RUNS = 1 << 8
#: Runs of each of the shards into which such an anchor is cut.
CUT_RUNS = 1 << 8
#: Bytes of an anchor after it was refined once, twice and so on: of the bytes of a string outside its anchor half lie
#: after it or more than half before it, and these are added to the anchor.
WIDTHS = [ANCHOR]
while WIDTHS[-1] < LENGTH - 8:
    WIDTHS.append(WIDTHS[-1] + (LENGTH - WIDTHS[-1]) // 2)
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = mix(np.arange(301, 557, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _words8(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number."""
    return np.ndarray((len(body) - 7,), "<u8", body.tobytes(), strides=(1,))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return v if have == width else np.minimum(v[: len(v) - (width - have)], v[width - have :])


def _powers(n: int, base: int, cache={}) -> np.ndarray:  # noqa: B006
    if base not in cache or len(cache[base]) < n:
        out = np.full(max(n, CHUNK_BYTES + (1 << 16)), base, np.uint64)
        out[0] = 1
        cache[base] = np.multiply.accumulate(out)
    return cache[base][:n]


def _prefix_sums(body: np.ndarray) -> np.ndarray:
    """Sums of value * base**place before each place, modulo 2**64: all in uint64, as a float would lose low bits."""
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_VALUES[body] * _powers(len(body), _BASE), dtype=np.uint64, out=out[1:])
    return out


def runs(texts: list[bytes]):
    """Cuts each text's strings of LENGTH bytes into runs that share an anchor.

    The anchor of a string is its ANCHOR-byte substring with the least hash, the leftmost of equals; so equal strings
    have equal anchors at equal offsets, wherever they stand. Returns the joined bytes and, per run: the text's number,
    its first string's place in the joined bytes, the number of strings, the anchor's hash, then each text's place, and
    per run the anchor's place.
    """
    body = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
    n = len(body) - 8
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return body, none, none, none, np.zeros(0, np.uint64), at, none
    w = _words8(body)
    grams = mix(w[: n - ANCHOR + 1] * np.uint64(0x9E3779B97F4A7C15) + mix(w[8 : n - ANCHOR + 9]))
    width = len(grams)
    if n <= int(_PLACE):
        least = _sliding_min((grams & ~_PLACE) | np.arange(width, dtype=np.uint64), STARTS)
        anchor = (least & _PLACE).astype(np.int64)
    else:  # one text of more than 16 MB: the same in overlapping parts
        anchor = np.empty(width - STARTS + 1, np.int64)
        part = 1 << 20
        for a in range(0, len(anchor), part):
            own = grams[a : a + part + STARTS - 1]
            least = _sliding_min((own & ~_PLACE) | np.arange(len(own), dtype=np.uint64), STARTS)
            anchor[a : a + part] = (least & _PLACE).astype(np.int64) + a
    text = np.repeat(np.arange(len(texts)), np.diff(at))[: len(anchor)]
    whole = np.arange(len(anchor)) + LENGTH <= at[text + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    new &= whole
    first = np.flatnonzero(new)
    ends = np.concatenate([[0], np.cumsum(whole)])
    after = np.concatenate([first[1:], [len(anchor)]])
    count = ends[after] - ends[first]
    return body, text[first], first, count, grams[anchor[first]], at, anchor[first]


def _chunks(texts: list[bytes]):
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= CHUNK_BYTES):
            held += len(texts[j])
            j += 1
        yield i, j
        i = j


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, which depend on their bytes and lengths alone."""
    return mix((sums[end] - sums[start]) * _powers(len(sums), _INVERSE)[start] + (end - start).astype(np.uint64))


def _keyed_texts(batch):
    return (*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()])


def _anchors(batches):
    """Rows ``h, doc, k``: the different anchors of each text, by hash."""
    for batch in batches:
        docs, ks, texts = _keyed_texts(batch)
        for i, j in _chunks(texts):
            _, text, _, _, h, _ = runs(texts[i:j])[:6]
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), pa.array(docs[i:j][text[once]]), pa.array(ks[i:j][text[once]])], names=["h", "doc", "k"])


def _pieces(batches):
    """Rows ``h, piece, doc, k, at, n``: the runs whose anchor is among the text's shared ones, with a hash of their bytes.

    ``n`` is the number of strings plus 64 times the anchor's offset in the run.
    """
    for batch in batches:
        docs, ks, texts = _keyed_texts(batch)
        lists = batch.column(3)
        for i, j in _chunks(texts):
            body, text, first, count, h, at, anchor = runs(texts[i:j])
            own = lists.slice(i, j - i)
            wanted = own.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(j - i), np.diff(own.offsets.to_numpy()))
            salt = mix(np.arange(j - i, dtype=np.uint64))
            keep = np.isin(h ^ salt[text], wanted.view(np.uint64) ^ salt[owner])
            text, first, count, h, anchor = text[keep], first[keep], count[keep], h[keep], anchor[keep]
            piece = _hashes(_prefix_sums(body), first, first + count + LENGTH - 1)
            made = [h.view(np.int64), piece.view(np.int64), docs[i:j][text], ks[i:j][text], (first - at[text]).astype(np.int32), (count + 64 * (anchor - first)).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=_RUN)


_RUN = ["h", "piece", "doc", "k", "at", "n"]
_RUN_TYPES = "h long, piece long, doc long, k long, at int, n int"


def _refined(sums: np.ndarray, first: np.ndarray, count: np.ndarray, offset: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The runs at these places, split by the bytes beside their anchor of ``width`` bytes.

    Of a run's strings those with ``side`` bytes or more after the anchor have these bytes and the old anchor for their new
    one; the others have as many before it, and these. Which half a string is in, its anchor's offset says, so equal
    strings still have equal anchors. Returns the new runs' old ones, first places, counts, offsets, and hashes of anchor
    and run.
    """
    side = (LENGTH - width) // 2
    most = LENGTH - width - side
    anchor, last = first + offset, first + count - 1
    right = np.maximum(first, anchor - most)
    has_right, has_left = right <= last, first < anchor - most
    of_right = _hashes(sums, np.where(has_right, anchor, 0), np.where(has_right, anchor + width + side, 0))
    of_left = _hashes(sums, np.where(has_left, anchor - side, 0), np.where(has_left, anchor + width, 0)) ^ np.uint64(1)
    old = np.concatenate([np.flatnonzero(has_right), np.flatnonzero(has_left)])
    is_right = np.repeat([True, False], [has_right.sum(), has_left.sum()])
    begin = np.where(is_right, right[old], first[old])
    n = np.where(is_right, last[old], np.minimum(last, anchor - most - 1)[old]) - begin + 1
    at = np.where(is_right, anchor[old], anchor[old] - side) - begin
    kinds = np.where(is_right, of_right[old], of_left[old]).view(np.int64)
    return old, begin, n, at, kinds, _hashes(sums, begin, begin + n + LENGTH - 1).view(np.int64)


def _bytes(batches, refine: bool):
    """Rows ``h, piece, doc, k, at, n, bytes`` of the runs ``h, piece, at, n`` that each text is asked for.

    ``refine`` splits each run by the bytes beside its anchor.
    """
    for batch in batches:
        docs, ks, texts = _keyed_texts(batch)
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        flat = lists.flatten()
        h, piece, at, n = (flat.field(c).to_numpy() for c in ("h", "piece", "at", "n"))
        for i, j in _chunks(texts):
            body = np.frombuffer(b"".join(texts[i:j]) + b"\0" * 8, np.uint8)
            base = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])]).astype(np.int64)
            a, b = int(ends[i] - ends[0]), int(ends[j] - ends[0])
            text = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
            first, count, offset = base[text] + at[a:b], n[a:b].astype(np.int64) % 64, n[a:b].astype(np.int64) // 64
            kinds, key = h[a:b], piece[a:b]
            if refine:
                old, first, count, offset, kinds, key = _refined(_prefix_sums(body), first, count, offset, ANCHOR)
                text = text[old]
            yield from _run_batches(body, first, count, offset, kinds, key, docs[i:j][text], ks[i:j][text], first - base[text])


def _finer(batches, width: int):
    """Rows ``h, piece, doc, k, at, n, bytes`` of the same, whose anchors have ``width`` bytes, split by the bytes beside these."""
    for batch in batches:
        docs, ks, at, n = (batch.column(c).to_numpy() for c in ("doc", "k", "at", "n"))
        data = batch.column("bytes").cast(pa.binary())
        body, ends = _values(data)
        old, first, count, offset, kinds, key = _refined(_prefix_sums(body), ends[:-1], n.astype(np.int64) % 64, n.astype(np.int64) // 64, width)
        yield from _run_batches(body, first, count, offset, kinds, key, docs[old], ks[old], at[old] + first - ends[old])


def _run_batches(body, first, count, offset, kinds, key, docs, ks, at):
    for c in range(0, len(first), 1 << 15):
        own = slice(c, c + (1 << 15))
        made = [kinds[own], key[own], docs[own], ks[own], at[own].astype(np.int32), (count[own] + 64 * offset[own]).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in made], _slices(body, first[own], count[own] + LENGTH - 1)], names=[*_RUN, "bytes"])


def _values(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a binary array, and where each value begins in them, with the end."""
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    return np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _slices(body: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The byte ranges as one binary array."""
    ends = np.concatenate([[0], np.cumsum(length)])
    places = np.arange(ends[-1]) + np.repeat(start - ends[:-1], length)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body[places])])


def suffix_array(body: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the first ``depth`` bytes from there (at least), by Larsson-Sadakane refinement.

    Starts from groups of equal eight bytes; each round doubles the compared length and sorts only inside groups that
    still have several members, by the rank of the place as far on.
    """
    n = len(body)
    words = _words8(np.concatenate([body, np.zeros(8, np.uint8)]))[:n].byteswap()
    order = np.argsort(words)
    key = words[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    length = 8
    while length < depth:
        size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        own = order[tied]
        key = rank[own] * np.int64(n + 2) + rank[np.minimum(own + length, n)] + 1
        by = np.argsort(key)
        order[tied] = own[by]
        key = key[by]
        new[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        rank[order] = starts[np.cumsum(new) - 1]
        length *= 2
    return order


def common_prefixes(body: np.ndarray, order: np.ndarray, breaks: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's common prefixes of neighbours in the suffix array, up to ``cap``; in text order, vectorised.

    A place whose neighbour continues the place before it has one byte less in common than that place. Only the others
    (and the starts of pieces, ``breaks``) are compared; a running maximum of place + prefix carries them on.
    """
    n = len(body)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    inner = (before[1:] > 0) & (before[:-1] >= 0)
    fresh[1:] = ~(inner & (body[:-1] == body[np.maximum(before[1:] - 1, 0)]) & (before[1:] - 1 == before[:-1]))
    fresh[breaks] = True
    padded = np.concatenate([body, np.zeros(cap + 8, np.uint8)])
    words = _words8(padded)
    places = np.flatnonzero(fresh & (before >= 0))
    got = np.zeros(n, np.int64)
    live = places
    for step in range(0, cap, 8):
        x = words[live + step] ^ words[np.minimum(before[live] + step, len(words) - 1)]
        equal = x == 0
        low = x & (~x + np.uint64(1))
        bits = np.where(equal, 64, np.log2(np.maximum(low, 1).astype(float)).astype(np.int64))
        got[live] += bits // 8
        live = live[equal]
        if not len(live):
            break
    started = np.where(fresh, np.arange(n) + got, 0)
    group = np.cumsum(fresh) - 1
    prefix = started[np.flatnonzero(fresh)][group] - np.arange(n)
    prefix = np.maximum(prefix, 0)
    return prefix[order]


class Shard:
    """Runs of bytes in one suffix array: equal strings of LENGTH bytes are neighbours with as long a common prefix."""

    def __init__(self, data: pa.Array):
        values, ends = _values(data)
        self.lengths = np.diff(ends)
        self.run = np.repeat(np.arange(len(data)), self.lengths + 1)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])
        self.body = np.full(len(self.run), 255, np.uint8)  # no byte of UTF-8, so a separator
        self.body[np.arange(len(values)) + np.repeat(np.arange(len(data)), self.lengths)] = values
        order = suffix_array(self.body, 64)
        group = np.cumsum(common_prefixes(self.body, order, self.starts, 96) < LENGTH)
        whole = (np.arange(len(self.body)) + LENGTH <= (self.starts + self.lengths)[self.run])[order]
        #: Places of the strings in the order of the suffix array, and where a new string begins in it.
        self.order = order[whole]
        group = group[whole]
        self.first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)

    def strings(self) -> np.ndarray:
        """The different strings, ascending, as rows of bytes."""
        return self.body[self.order[self.first][:, None] + np.arange(LENGTH)]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value of each different string, for all its occurrences."""
        return np.repeat(values, np.diff(np.concatenate([self.first, [len(self.order)]])))

    def least(self, owners: np.ndarray, ufunc=np.minimum) -> np.ndarray:
        """The least (or by another ufunc) owner of each different string."""
        return ufunc.reduceat(owners[self.run[self.order]], self.first) if len(self.first) else np.zeros(0, np.int64)

    def spans(self, hit: np.ndarray, docs: np.ndarray, ks: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """``doc, k, a, b`` of the stretches that the strings of these places cover."""
        hit = np.sort(self.order[hit])
        run = self.run[hit]
        cut = np.ones(len(hit), bool)
        cut[1:] = (run[1:] != run[:-1]) | (np.diff(hit) > LENGTH)
        begin = np.flatnonzero(cut)
        end = np.concatenate([begin[1:], [len(hit)]])[: len(begin)] - 1
        own = run[begin]
        shift = at[own].astype(np.int64) - self.starts[own]
        made = [docs[own], ks[own], hit[begin] + shift, hit[end] + LENGTH + shift]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["doc", "k", "a", "b"])


def _held(batches, keys: int, most: int):
    """Arrow tables of whole groups of the first ``keys`` columns, of about ``most`` bytes in the last one (0: one group each)."""
    held: list = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        cuts = [0, *new] if not most else ([0, int(new[-1])] if len(new) else [0])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(a, b - a).combine_chunks()
        held = table.slice(cuts[-1]).combine_chunks().to_batches()
        size = sum(x.column(x.num_columns - 1).nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _binary(table: pa.Table) -> pa.Array:
    return table.column(table.num_columns - 1).combine_chunks() if table.num_rows else pa.array([], pa.binary())


def _one(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def repeating(data: pa.Array, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What of the runs may be in a run of another document: the runs' numbers, the place in each, and the bytes there.

    By hashes of the strings, which equal strings share: from a run's first such string to its last, so none is left out.
    """
    body, ends = _values(data)
    n = np.maximum(np.diff(ends) - (LENGTH - 1), 0)
    run = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(run)) + np.repeat(ends[:-1] - (np.cumsum(n) - n), n)
    sums = _prefix_sums(body)
    key = (sums[place + LENGTH] - sums[place]) * _powers(len(sums), _INVERSE)[place]
    order = np.argsort(key)
    key, own = key[order], docs[run[order]]
    same = key[1:] == key[:-1]
    # a group of equal hashes has several documents if two neighbours in it differ
    group = np.cumsum(np.concatenate([[0], ~same])) if len(key) else np.zeros(0, np.int64)
    several = np.zeros(len(key) + 1, bool)
    several[group[1:][same & (own[1:] != own[:-1])]] = True
    hit = np.sort(order[several[group]])
    new = np.flatnonzero(np.diff(run[hit], prepend=-1))
    begin, end = place[hit[new]], place[hit[np.append(new[1:], len(hit))[: len(new)] - 1]] + LENGTH
    kept = run[hit[new]]
    return kept, begin - ends[kept], _slices(body, begin, end - begin)


def _by_suffixes(batches):
    """Rows ``h, doc, k, at, bytes`` sorted by h: shards of whole anchors, in which a smaller owner takes a string.

    Strings whose hash no other document has are left out of the suffix array at both ends of a run.
    """
    for table in _held(batches, 1, SHARD_BYTES):
        docs, ks, at = (_one(table.column(c)) for c in (1, 2, 3))
        kept, begin, data = repeating(_binary(table), docs)
        if not len(kept):
            continue
        docs, ks, at = docs[kept], ks[kept], at[kept] + begin
        shard = Shard(data)
        low = shard.spread(shard.least(docs))
        yield shard.spans(np.flatnonzero(low < docs[shard.run[shard.order]]), docs, ks, at)


def _shard_strings(batches):
    """Rows ``h, part, low, high, string``: the different strings of each shard (h, part), ascending, with their owners."""
    for table in _held(batches, 2, 0):
        shard, docs = Shard(_binary(table)), _one(table.column(2))
        n = len(shard.first)
        same = [np.full(n, table.column(c)[0].as_py()) for c in (0, 1)]
        flat = np.ascontiguousarray(shard.strings()).ravel()
        strings = _slices(flat, np.arange(n) * LENGTH, np.full(n, LENGTH))
        made = [*same, shard.least(docs), shard.least(docs, np.maximum)]
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in made], strings], names=["h", "part", "low", "high", "bytes"])


def _merge_shards(batches):
    """Rows ``h, part, kind, doc, k, at, bytes`` sorted by the first three: of each shard first (kind 0) the strings that
    some shard has from a smaller owner ``doc``, then (kind 1) its runs. The strings are found in the shard's suffix
    array by binary search.
    """
    for table in _held(batches, 2, 0):
        kind = _one(table.column(2))
        n = int((kind == 0).sum())
        needles = table.slice(0, n)
        own = table.slice(n).combine_chunks()
        if not n or not own.num_rows:
            continue
        docs, ks, at = (_one(own.column(c)) for c in (3, 4, 5))
        shard = Shard(_binary(own))
        if not len(shard.first):
            continue
        known = np.ascontiguousarray(shard.strings()).view(f"S{LENGTH}").ravel()
        wanted = np.array(needles.column(6).to_pylist(), f"S{LENGTH}")
        place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        low = np.full(len(known), np.iinfo(np.int64).max)
        found = known[place] == wanted
        low[place[found]] = _one(needles.column(3))[found]
        yield shard.spans(np.flatnonzero(shard.spread(low) < docs[shard.run[shard.order]]), docs, ks, at)


def _cut(batches):
    """Of each text with its spans: what is removed, and the digest of the rest."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((s["a"], s["b"]) for s in spans or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out.append((sum(b - a for a, b in merged), len(merged), digest.hexdigest(), merged))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc", "k", "n_removed", "n_spans", "kept_sha256", "spans"])


def _rows(stage: Stage, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, doc, k, text``: (doc, k) tells rows of different id or text apart; ``doc`` orders them.

    ``k`` is 0 where the id is on one row only, else a hash of the text. Null ids get the greatest ``doc``.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    twins = stage.save(rows.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("twin")))
    several = F.col("id").isNull() | F.col("twin").isNotNull()
    rows = rows.join(twins, F.col("id") == F.col("twin"), "left")
    return rows.select("id", F.coalesce("id", F.lit((1 << 63) - 1)).alias("doc"), F.when(several, F.xxhash64("text")).otherwise(0).alias("k"), "text")


def _judge(stage: Stage, runs_: DataFrame) -> DataFrame:
    """The runs that need a look, with ``whole`` (a smaller document has the same run) and ``kinds``, the different runs
    of their anchor. Both are sums that are taken before the shuffle, so a hot anchor is no hot task.
    """
    owners = stage.save(runs_.groupBy("h", "piece").agg(F.min("doc").alias("owner")))
    release_shuffles(stage.spark)
    kinds = owners.groupBy("h").agg(F.count("*").alias("kinds"))
    judged = runs_.join(owners.join(kinds, "h"), ["h", "piece"]).where("kinds > 1 or owner < doc")
    judged = stage.save(judged.select(*runs_.columns, (F.col("owner") < F.col("doc")).alias("whole"), "kinds"))
    stage.drop(owners)
    release_shuffles(stage.spark)
    return judged


def _span_of_run() -> list:
    return ["doc", "k", F.col("at").cast("long").alias("a"), (F.col("at") + F.col("n") % 64 + (LENGTH - 1)).cast("long").alias("b")]


def _in_shards(runs_: DataFrame) -> DataFrame:
    """Spans of runs whose anchors fit in one shard each."""
    dealt = runs_.select("h", "doc", "k", "at", "bytes").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(_by_suffixes, _SPAN_TYPES)


def _refine(runs_: DataFrame, width: int) -> DataFrame:
    """The runs with bytes of anchors of ``width`` bytes, split by the bytes beside these."""
    own = runs_.select(*_RUN, "bytes")
    return own.mapInArrow(lambda batches: _finer(batches, width), f"{_RUN_TYPES}, bytes binary")


def _across_shards(stage: Stage, runs_: DataFrame) -> DataFrame:
    """Spans of runs whose anchors are cut into several shards (h, part), each with a suffix array of its own.

    The shards' different strings are merged by string; those that a smaller document has go back to the shards that
    also have them, which look them up in their suffix arrays by binary search.
    """
    part = F.pmod(F.xxhash64("doc", "k", "at"), F.ceil(F.col("kinds") / min(SHARD_RUNS, CUT_RUNS))).cast("long")
    runs_ = runs_.select("h", part.alias("part"), F.lit(1).alias("kind"), "doc", "k", "at", "bytes")
    dealt = runs_.select("h", "part", "doc", "bytes").repartition("h", "part").sortWithinPartitions("h", "part")
    strings = stage.save(dealt.mapInArrow(_shard_strings, "h long, part long, low long, high long, bytes binary"))
    merged = strings.groupBy("h", "bytes").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").drop("most")
    needles = strings.join(merged, ["h", "bytes"]).where("least < high").select(
        "h", "part", F.lit(0).alias("kind"), F.col("least").alias("doc"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("at"), "bytes"
    )
    both = needles.unionByName(runs_).repartition("h", "part").sortWithinPartitions("h", "part", "kind")
    return both.mapInArrow(_merge_shards, _SPAN_TYPES)


_SPAN_TYPES = "doc long, k long, a long, b long"


def repeated_strings(spark: SparkSession, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id; strings are judged on
    the input. ``spans`` are the removed stretches [start, end) of the UTF-8 bytes. Null and empty texts have 0 bytes.
    Each row is judged by its own text: rows with equal ids don't count against each other, whatever their texts, rows
    with a null id come after all others and don't count against each other either, equal rows get equal results. An
    empty table gives an empty result; other columns are not looked at. Very long texts are cut into runs of strings
    like others; only their last step, the digest, takes a text whole.

    1. Equal texts: all of a later copy goes, so only the first goes on. The texts that go on are written once, dealt by
    row, so that no later join moves them. 2. Every text names the anchors of its strings; counts by anchor find those
    that two documents share. 3. Only these runs of strings are looked at, by a hash of their bytes. Where a smaller
    document has the same run, all of it goes. 4. The different runs of an anchor are compared string by string: anchors
    are dealt to shards, each shard sorts its runs in a suffix array, and equal strings are neighbours with 50 common
    bytes. Equal strings have equal anchors, so shards of whole anchors need no merging. 5. Runs of an anchor with more
    than SHARD_RUNS kinds are split by the 17 bytes after or before it, and 3. and 4. apply to them; what has too many
    kinds even so is split by further bytes (WIDTHS), and at last cut into several shards that are merged by binary search.
    """
    stage = Stage(spark, "repeats")
    rows = _rows(stage, df, id_col, text_col)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keys = stage.save(rows.where(F.octet_length("text") >= LENGTH).select("doc", "k", F.unhex(F.sha2("text", 256)).alias("key"), F.octet_length("text").cast("long").alias("n")))
    size = keys.agg(F.sum("n")).first()[0] or 0
    firsts = keys.groupBy("key").agg(F.min("doc").alias("owner"), F.max("doc").alias("high")).where("owner < high")
    copies = stage.save(keys.join(firsts, "key").where("owner < doc").select("doc", "k").distinct())
    again = stage.save(keys.groupBy("doc", "k").count().where("count > 1").select("doc", "k"))
    stage.drop(keys)
    long = rows.where(F.octet_length("text") >= LENGTH).select("doc", "k", "text").join(copies, ["doc", "k"], "left_anti")
    once = long.join(again, ["doc", "k"], "left_anti").unionByName(long.join(again, ["doc", "k"], "left_semi").dropDuplicates(["doc", "k"]))
    docs = stage.save_dealt(once, ["doc", "k"], size)
    release_shuffles(spark)
    anchors = stage.save(docs.mapInArrow(_anchors, "h long, doc long, k long"))
    known = stage.save(anchors.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h"))
    release_shuffles(spark)
    shared = stage.save(anchors.join(known.hint("shuffle_hash"), "h", "left_semi"))
    stage.drop(anchors)
    release_shuffles(spark)
    lists = shared.groupBy("doc", "k").agg(F.collect_list("h").alias("hs"))
    pieces = stage.save(docs.join(lists, ["doc", "k"]).select("doc", "k", "text", "hs").mapInArrow(_pieces, _RUN_TYPES))
    stage.drop(shared)
    release_shuffles(spark)
    judged = _judge(stage, pieces)
    stage.drop(pieces)
    release_shuffles(spark)

    def with_bytes(asked: DataFrame, refine: bool) -> DataFrame:
        lists = asked.groupBy("doc", "k").agg(F.collect_list(F.struct("h", "piece", "at", "n")).alias("runs"))
        joined = docs.join(lists, ["doc", "k"]).select("doc", "k", "text", "runs")
        return stage.save(joined.mapInArrow(lambda batches: _bytes(batches, refine), f"{_RUN_TYPES}, bytes binary"))

    few = with_bytes(judged.where(f"not whole and kinds <= {SHARD_RUNS}"), False)
    spans = [stage.save(_in_shards(few))]
    stage.drop(few)
    release_shuffles(spark)
    refined = with_bytes(judged.where(f"not whole and kinds > {SHARD_RUNS}"), True)
    finer = _judge(stage, refined)
    stage.drop(refined)
    steps = [judged, finer]
    spans.append(stage.save(_in_shards(finer.where(f"not whole and kinds <= {SHARD_RUNS}"))))
    for width in WIDTHS[1:-1]:
        hot = finer.where(f"not whole and kinds > {SHARD_RUNS}")
        if hot.isEmpty():
            break
        refined = stage.save(_refine(hot, width))
        finer = _judge(stage, refined)
        stage.drop(refined)
        steps.append(finer)
        spans.append(stage.save(_in_shards(finer.where(f"not whole and kinds <= {SHARD_RUNS}"))))
    spans += [x.where("whole").select(*_span_of_run()) for x in steps]
    spans.append(_across_shards(stage, finer.where(f"not whole and kinds > {SHARD_RUNS}")))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    found = stage.save(every.groupBy("doc", "k").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    for step in steps:
        stage.drop(step)
    release_shuffles(spark)
    cut = docs.join(found, ["doc", "k"], "left").select("doc", "k", "text", "spans")
    cut = cut.mapInArrow(_cut, "doc long, k long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    cut = stage.save(cut)
    stage.drop(docs)
    gone = copies.withColumn("copy", F.lit(True))
    sized = rows.select("id", "doc", "k", n_bytes.alias("n_bytes"), F.when(n_bytes < LENGTH, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("own"))
    out = sized.join(cut, ["doc", "k"], "left").join(gone, ["doc", "k"], "left")
    whole = F.array(F.array(F.lit(0).cast("long"), "n_bytes"))
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"),
    )
