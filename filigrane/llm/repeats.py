"""Suffix-array dedup: byte strings that start in an earlier document too are removed, found by expanding intervals of a
Burrows-Wheeler transform level by level up to the minimum length."""
from __future__ import annotations

import gc
import random
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.common import base, groups, id_out, map_arrow, scratch
from filigrane.llm.words import mix, span_hashes

LENGTH = 50
#: Bytes of an anchor. Every string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the one with the least hash, the
#: leftmost of equals, is its anchor, so equal strings have equal anchors at equal places.
GRAM = 22
#: Windows handled at once, anchors gathered by a task before it sends them on; a transform has half of SYMBOLS and what an anchor adds.
STRETCH, GATHER, SYMBOLS = 1_000_000, 1_000_000, 700_000
#: Bytes of texts whose windows are found together; parts of the documents in which their suspects are put together.
JOINT, PARTS = 200_000, 512
#: Anchors of a bucket in expectation; distinct stretches of an anchor above which its strings are dealt out singly.
BUCKET, CROWDED = 1_000_000, 8_000
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(b: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of every n bytes, from overlapping words of eight."""
    w = b.astype(np.uint64)
    for shift in (1, 2, 4):
        w = w[:-shift] | (w[shift:] << np.uint64(8 * shift))
    out = np.zeros(len(b) - n + 1, np.uint64)
    for k in [*range(0, n - 8, 8), n - 8]:
        out = (out ^ w[k:k + len(out)]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix(out)


def windows(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, first window, windows, anchor hash) for stretches of windows that share an anchor; windows lie in one piece each."""
    whole = np.frombuffer(b"".join(pieces), np.uint8)
    if len(whole) < length:
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(whole)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, m = 1, key
    want = length - GRAM + 1
    while 2 * span <= want:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[:len(m) - (want - span)], m[want - span:])
    at = (m & _PLACE).astype(np.int64)
    across = (np.cumsum([len(p) for p in pieces[:-1]], dtype=np.int64)[:, None] - np.arange(1, length)).ravel()
    at[across[(across >= 0) & (across < len(at))]] = -1
    first = np.flatnonzero(np.diff(at, prepend=-2))
    n = np.diff(first, append=len(at))
    inside = at[first] >= 0
    first, n = first[inside], n[inside]
    return whole, first, n, h[at[first]]


def sections(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, first window, windows, anchor hash) for stretches of windows of a text that share an anchor."""
    for off, piece in _pieces(text, length):
        yield off, *windows([piece], length)[1:]


def _pieces(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of pieces with at most STRETCH windows each; every window lies in one piece."""
    last = len(text) - length + 1
    for off in range(0, max(0, last), STRETCH):
        yield off, text[off:min(off + STRETCH, last) + length - 1]


def _blocks(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(row, offset, bytes) of the pieces of many texts, some JOINT bytes at a time: short texts would cost a round of small steps each."""
    row, offset, pieces, size = [], [], [], 0
    for k, text in texts:
        for off, piece in _pieces(text):
            row.append(k)
            offset.append(off)
            pieces.append(piece)
            size += len(piece)
            if size >= JOINT:
                yield np.array(row), np.array(offset), pieces
                row, offset, pieces, size = [], [], [], 0
    if pieces:
        yield np.array(row), np.array(offset), pieces


def _piece_of(pieces: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece that holds each place, and where each piece begins."""
    begin = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    return np.searchsorted(begin, first, side="right") - 1, begin


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and short anchor in one number. An anchor is the least of many hashes, so its upper bits are small; buckets go by those in the
    middle, which are even."""
    return (((h >> np.uint64(32)) & np.uint64((1 << bits) - 1)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _in_order(key: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by key (of so many bits), then value. In one number where they fit, as numbers alone sort much faster than their places."""
    low = int(value.max()).bit_length() if len(value) else 0
    if bits + low <= 64:
        both = np.sort((key << np.uint64(low)) | value.astype(np.uint64))
        return both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(value.dtype)
    order = np.lexsort((value, key))
    return key[order], value[order]


def _texts(batches):
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            yield i, t.as_py().encode()


def _gather(bits: int):
    """Anchors by bucket. Those that two documents of the same task share are suspects at once, and only one of them
    goes on, so a passage of very many documents is one anchor per task."""
    def packed(keys: list[np.ndarray], ids: np.ndarray, docs: list[np.ndarray], deal: random.Random):
        key, doc = np.concatenate(keys), np.concatenate(docs)
        keys.clear()
        docs.clear()
        key, doc = _in_order(key, doc, 32 + bits)
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[once], doc[once]
        lead = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(lead)
        n = np.diff(first, append=len(key))
        many = np.repeat(n > 1, n)
        for pick, kind in ((many, 1), (lead, 0)):
            k, d = key[pick], doc[pick]
            low = np.uint64(len(ids).bit_length())
            place, short = _in_order(((k >> np.uint64(32)) << low) | d.astype(np.uint64), k & np.uint64(0xFFFFFFFF), bits + int(low))
            bucket, d, short = (place >> low).astype(np.int64), (place & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), short.astype(np.uint32)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(d)]):
                held, n = np.unique(d[a:b], return_counts=True)
                own = int(bucket[a])
                # the suspects found here need no counting and are dealt out over all routes, those of one bucket too
                yield {"route": [deal.randrange(1 << bits) if kind else own], "bucket": [own], "kind": [kind], "ids": [zlib.compress(np.diff(ids[held], prepend=0).tobytes(), 1)],
                       "counts": [zlib.compress(n.astype(np.uint32).tobytes(), 1)], "anchors": [short[a:b].tobytes()]}

    def run(batches):
        ids: list[int] = []

        def numbered():
            for i, text in _texts(batches):
                ids.append(i)
                yield len(ids) - 1, text
        keys, docs, n, deal = [], [], 0, None
        for row, _, pieces in _blocks(numbered()):
            _, first, _, h = windows(pieces)
            keys.append(_short(h, bits))
            docs.append(row[_piece_of(pieces, first)[0]])
            n += len(h)
            if n >= GATHER:
                deal = deal or random.Random(ids[0])
                yield from packed(keys, np.array(ids, np.int64), docs, deal)
                n = 0
        if n:
            yield from packed(keys, np.array(ids, np.int64), docs, deal or random.Random(ids[0]))
    return run


def _suspect(batches):
    """Anchors of more than one document, by part of the documents: a row per route and part, so their number does not go with documents
    times buckets."""
    def by_part(ids: list[np.ndarray], anchors: list[np.ndarray]) -> dict:
        i, a = np.concatenate(ids), np.concatenate(anchors)
        ids.clear()
        anchors.clear()
        part = (mix(i.view(np.uint64)) % np.uint64(PARTS)).astype(np.int16)
        order = np.argsort(part, kind="stable")
        i, a, part = i[order], a[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = [*cuts[1:], len(i)]
        return {"part": part[cuts], "ids": [i[x:y].tobytes() for x, y in zip(cuts, ends)], "anchors": [a[x:y].tobytes() for x, y in zip(cuts, ends)]}

    for g in groups(batches, "route"):
        held_i, held_a, own_i, own_a = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for bucket, kind, i, n, a in zip(*(g.column(c).to_pylist() for c in ("bucket", "kind", "ids", "counts", "anchors"))):
            ids = np.repeat(np.cumsum(np.frombuffer(zlib.decompress(i), np.int64)), np.frombuffer(zlib.decompress(n), np.uint32))
            anchors = np.frombuffer(a, np.uint32).astype(np.uint64) | np.uint64(bucket << 32)
            (held_i if kind else own_i).append(ids)
            (held_a if kind else own_a).append(anchors)
            if sum(map(len, held_i)) > GATHER:
                yield by_part(held_i, held_a)
        ids, anchors = np.concatenate(own_i), np.concatenate(own_a)
        if len(ids):
            order = np.argsort(anchors)
            a, i = anchors[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            many = np.minimum.reduceat(i, first) < np.maximum.reduceat(i, first)
            keep = np.repeat(many, np.diff(first, append=len(a)))
            held_i.append(i[keep])
            held_a.append(a[keep])
        if held_i:
            yield by_part(held_i, held_a)


def _listed(batches):
    """The suspects of every document."""
    for g in groups(batches, "part"):
        ids = np.frombuffer(b"".join(g.column("ids").to_pylist()), np.int64)
        anchors = np.frombuffer(b"".join(g.column("anchors").to_pylist()), np.uint64)
        order = np.argsort(ids)
        ids, anchors = ids[order], anchors[order]
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        yield {"_id": ids[cuts], "anchors": [anchors[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(ids)])]}


def _stretches(bits: int):
    """Where the windows of suspected anchors are, and a hash of their bytes. A block's texts share their suspects: an anchor
    suspected in one of them is so in all that hold it."""
    def run(batches):
        names = ("_id", "_td", "at", "n", "anchor", "k")
        for b in batches:
            ids, tds = (np.asarray(b.column(k), np.int64) for k in (0, 1))
            held: list[tuple] = []
            size = 0
            for row, off, pieces in _blocks((k, t.as_py().encode()) for k, t in enumerate(b.column(2))):
                whole, first, n, h = windows(pieces)
                wanted = np.unique(np.frombuffer(b"".join(b.column(3)[k].as_py() for k in np.unique(row).tolist()), np.uint64))
                short = _short(h, bits)
                pick = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short)
                at, m = first[pick], n[pick]
                piece, begin = _piece_of(pieces, at)
                held.append((ids[row[piece]], tds[row[piece]], at - begin[piece] + off[piece], m, h[pick].view(np.int64),
                             span_hashes(whole, at, at + m + LENGTH - 1).view(np.int64)))
                size += len(at)
                if size > 200_000:
                    yield dict(zip(names, map(np.concatenate, zip(*held))))
                    held, size = [], 0
            if held:
                yield dict(zip(names, map(np.concatenate, zip(*held))))
    return run


def _bytes(batches):
    """The bytes of chosen stretches."""
    for b in batches:
        out: dict[str, list] = {"anchor": [], "k": [], "m": [], "first": [], "bytes": []}
        size = 0
        asked = b.column(2)
        ends, flat = asked.offsets.to_pylist(), asked.values
        fields = {c: flat.field(c).to_pylist() for c in ("at", "n", "anchor", "k", "m")}
        for row, (i, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
            text = text.as_py().encode()
            at = slice(ends[row], ends[row + 1])
            parts = [text[p:p + n + LENGTH - 1] for p, n in zip(fields["at"][at], fields["n"][at])]
            for name, v in zip(out, (fields["anchor"][at], fields["k"][at], fields["m"][at], [i] * len(parts), parts)):
                out[name].extend(v)
            size += sum(map(len, parts))
            if size > 4_000_000:
                yield out
                out, size = {n: [] for n in out}, 0
        yield out


def earliest(parts: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For every string of `length` bytes in the parts, by part and place: the least id of the parts that hold it.

    The suffixes of all parts are ordered (each part ends in a mark of its own, so the order is total) and give the
    transform. Intervals of suffixes with a common prefix of l bytes are extended backward by every character that
    precedes them: the first suffix of each such character in an interval marks where an interval of l + 1 begins. So
    the common prefixes come by increasing length; the expansion stops at `length`."""
    sizes = np.array([len(p) for p in parts])
    t = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    t[ends] = 0
    n = len(t)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    left = ends[owner] - np.arange(n)  # symbols before the mark
    # ranks of prefixes by doubling; a place rides in the low bits of its key, so that keys alone are sorted and equal
    # suffixes come in the order of their parts
    bits = n.bit_length()
    if 3 * bits > 63:
        raise ValueError("too many symbols for one transform")
    place = np.arange(n, dtype=np.int64)
    key, reach = np.zeros(n, np.int64), 4
    for j in range(reach):
        nxt = np.zeros(n, np.int64)
        nxt[:n - j] = t[j:]
        key = (key << 9) | np.where(left >= j, nxt, 0)
    while True:
        packed = np.sort((key << bits) | place)
        order = packed & ((1 << bits) - 1)
        packed >>= bits
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], packed[1:] != packed[:-1]]))
        if reach > sizes.max():
            break
        nxt = np.zeros(n, np.int64)
        nxt[:n - reach] = rank[reach:] + 1
        key = (rank << bits) | np.where(left >= reach, nxt, 0)
        reach *= 2
    sa = order.astype(np.int32)
    isa = np.empty(n, np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    # the transform, the step back from a suffix to the one before it, and the last earlier place of its character
    inner = sa > 0
    char = np.where(inner, t[sa - 1], 0)
    at = np.flatnonzero(char)
    back = isa[sa[at] - 1]
    chars = char[at].astype(np.uint16)
    by = np.argsort(chars, kind="stable")
    same = np.full(len(at), -1, np.int32)
    same[by[1:]] = np.where(chars[by[1:]] == chars[by[:-1]], at[by[:-1]], -1)
    at = at.astype(np.int32)
    place = np.arange(n, dtype=np.int32)
    mark = np.zeros(n, np.int32)  # where intervals begin; once an interval begins somewhere, it does at all later levels
    mark[:len(parts)] = place[:len(parts)]  # the ends of parts are alone
    start = np.zeros(n, np.int32)
    for _ in range(length):
        new = same < start[at]
        begun = back[new]
        mark[begun] = begun
        at, back, same = at[~new], back[~new], same[~new]
        start = np.maximum.accumulate(mark)
    first = np.flatnonzero(start == place)
    low = np.minimum.reduceat(ids[owner[sa]], first)
    found = np.repeat(low, np.diff(first, append=n))[isa]
    return [found[e - s:e - length + 1] for e, s in zip(ends, sizes)]


def _expand(batches):
    """Whole anchors, sorted, several to a transform."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        anchor = np.asarray(b.column(b.schema.get_field_index("anchor")))
        upto = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(b.column(b.schema.get_field_index("bytes"))), np.int64))])
        new = np.flatnonzero(np.concatenate([[last is not None and anchor[0] != last], anchor[1:] != anchor[:-1]]))
        start = 0
        while True:  # up to the first anchor that begins with half the symbols at hand
            full = np.searchsorted(upto, upto[start] + SYMBOLS // 2 - size)
            k = np.searchsorted(new, max(full, start + (not held)))
            if k == len(new):
                break
            stop = int(new[k])
            yield _expanded([*held, b.slice(start, stop - start)])
            held, size, start = [], 0, stop
        held.append(b.slice(start))
        size += int(upto[-1] - upto[start])
        last = anchor[-1]
    if held:
        yield _expanded(held)


def _expanded(held: list[pa.RecordBatch]) -> dict:
    every = pa.Table.from_batches(held)
    ids = np.asarray(every.column("first").combine_chunks(), np.int64)
    found = earliest(every.column("bytes").to_pylist(), ids)
    return {"anchor": every.column("anchor").combine_chunks(), "k": every.column("k").combine_chunks(), "least": [_packed(f) for f in found]}


def _packed(least: np.ndarray) -> bytes:
    """Least ids by place; eight bytes where all are the same."""
    return least[:1].tobytes() if (least == least[0]).all() else zlib.compress(least.tobytes(), 1)


def _longs(eight: pa.Array) -> np.ndarray:
    """The numbers in an array of eight bytes each."""
    first = np.frombuffer(eight.buffers()[1], np.int32, 1, 4 * eight.offset)[0] if len(eight) else 0
    return np.frombuffer(eight.buffers()[2], np.int64, len(eight), first) if len(eight) else np.zeros(0, np.int64)


def _ranges(batches):
    """Bytes to remove: of every window whose string starts in a smaller document."""
    for b in batches:
        ids, tds, at, n = (np.asarray(b.column(k), np.int64) for k in range(4))
        least = b.column(4)
        same = np.asarray(pc.binary_length(least), np.int64) == 8
        low = _longs(least.filter(pa.array(same)))
        whole = np.flatnonzero(same)[low < ids[same]]
        row, starts, ends = [], [], []
        for k in np.flatnonzero(~same).tolist():
            gone = np.frombuffer(zlib.decompress(least[k].as_py()), np.int64) < ids[k]
            if gone.any():
                cut = np.flatnonzero(np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
                row += [k] * (len(cut) // 2)
                starts += cut[0::2]
                ends += cut[1::2]
        row = np.concatenate([whole, np.array(row, np.int64)])
        starts = np.concatenate([np.zeros(len(whole), np.int64), np.array(starts, np.int64)])
        ends = np.concatenate([n[whole], np.array(ends, np.int64)])
        yield {"_id": ids[row], "_td": tds[row], "s": at[row] + starts, "e": at[row] + ends + LENGTH - 1}


def _cut(batches):
    for b in batches:
        out: dict[str, list] = {"_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        cuts = b.column(2)
        bounds = cuts.offsets.to_pylist()
        all_s, all_e = (np.asarray(cuts.values.field(c)) for c in ("s", "e"))
        for row, (i, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
            text = text.as_py().encode()
            kept, spans, removed = text, 0, 0
            if cuts[row].is_valid and bounds[row] < bounds[row + 1]:
                s, e = all_s[bounds[row]:bounds[row + 1]], all_e[bounds[row]:bounds[row + 1]]
                order = np.argsort(s)
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))  # runs that touch are one
                s, e = s[new], e[np.append(new[1:] - 1, len(e) - 1)]
                spans, removed = len(s), int((e - s).sum())
                kept = b"".join(text[a:z] for a, z in zip([0, *e.tolist()], [*s.tolist(), len(text)]))
            for name, v in zip(out, (i, len(text), removed, spans, kept)):
                out[name].append(v)
        yield out


def _settled(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps; what is still needed has been written. The first round
    frees the plans, which the end of the last job still held, the second one what hung on them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): one row per row of docs.

    Every byte that lies in a string of LENGTH bytes which also starts in a document with a smaller id is removed.
    Strings are those of the input and never cross documents; n_spans counts maximal removed runs.

    1. Every task lists the anchors of its documents by hash bucket. Anchors that more than one document holds are
       suspects: one pass over each bucket, with one entry per task and anchor.
    2. Stretches of windows with a suspected anchor are listed by place and a hash of their bytes, and equal ones are
       combined (least id). Where an anchor has one stretch only, all its strings have that id. Otherwise the bytes of
       its distinct stretches meet in one task, and `earliest` finds the least id of each string in them. An anchor
       with very many stretches is taken apart: its strings are combined one by one, so no task gets them all.
    3. The least ids return to the places they came from, and texts meet their removed ranges.

    Null and empty texts have no bytes. A null id sorts first. Rows that share an id are documents of equal standing:
    neither removes from the other. Kept bytes need not be valid UTF-8. Empty input gives an empty result."""
    spark = docs.sparkSession
    rows = base(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    # buckets follow the size of the corpus, so that each stays small; 31 bits and the short anchor share a 64-bit number
    bits = min(31, max(4, (size * 2 // (LENGTH - GRAM + 2) // BUCKET).bit_length()))
    keyed = rows.withColumn("_td", F.hash("_text"))
    stretches, done = _candidates(spark, rows, keyed, bits)
    _settled(spark)
    ranges = _removed(spark, keyed, stretches)
    done()
    _settled(spark)
    per = ranges.groupBy("_id", "_td").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))
    out = map_arrow(keyed.join(per, ["_id", "_td"], "left").select("_id", "_text", "cuts"), _cut,
                    "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(id_out(), "n_bytes", "n_removed", "n_spans", "kept")


def _candidates(spark: SparkSession, rows: DataFrame, keyed: DataFrame, bits: int):
    packed = map_arrow(rows, _gather(bits), "route long, bucket long, kind int, ids binary, counts binary, anchors binary")
    by_part = map_arrow(packed.repartition(1 << min(bits, 12), "route").sortWithinPartitions("route"), _suspect, "part long, ids binary, anchors binary")
    suspects, drop = scratch(map_arrow(by_part.repartition("part").sortWithinPartitions("part"), _listed, "_id long, anchors binary"))
    del packed, by_part
    _settled(spark)
    stretches, drop2 = scratch(map_arrow(keyed.join(suspects, "_id").select("_id", "_td", "_text", "anchors"), _stretches(bits),
                                         "_id long, _td int, at long, n int, anchor long, k long"))
    drop()
    return stretches, drop2


def _removed(spark: SparkSession, keyed: DataFrame, stretches: DataFrame) -> DataFrame:
    key = ["anchor", "k"]
    distinct, drop = scratch(stretches.groupBy(*key).agg(F.min(F.struct("_id", "_td", "at", "n")).alias("first"), F.max("_id").alias("last")))
    count = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    several = (distinct.join(count, "anchor").select("first.*", "anchor", "k", "m")
               .groupBy("_id", "_td").agg(F.collect_list(F.struct("at", "n", "anchor", "k", "m")).alias("asked")))
    shown, drop2 = scratch(map_arrow(keyed.join(several, ["_id", "_td"]).dropDuplicates(["_id", "_td"]).select("_id", "_text", "asked"), _bytes,
                                     "anchor long, k long, m long, first long, bytes binary"))
    _settled(spark)
    few = map_arrow(shown.where(f"m <= {CROWDED}").repartition("anchor").sortWithinPartitions("anchor"), _expand,
                    "anchor long, k long, least binary")
    each = (shown.where(f"m > {CROWDED}").select(*key, "first", F.posexplode(F.expr(
        f"transform(sequence(1, length(bytes) - {LENGTH - 1}), i -> substring(bytes, i, {LENGTH}))")).alias("place", "string")))
    low = each.groupBy("string").agg(F.min("first").alias("low"))
    crowded = each.join(low, "string").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "low"))).alias("lows"))
    crowded = map_arrow(crowded.select(*key, F.col("lows.low").alias("low")), _pack, "anchor long, k long, least binary")
    least, drop3 = scratch(few.unionByName(crowded))
    drop2()
    _settled(spark)
    alone = distinct.join(count, "anchor", "left_anti").where("first._id < last").select(*key, F.col("first._id").alias("low"))
    # both joins read the same rows and columns of the stretches, so that they are shuffled once
    stretches = stretches.where("_id is not null")
    whole = stretches.join(alone, key).where("low < _id").select(
        "_id", "_td", F.col("at").alias("s"), F.expr(f"at + n + {LENGTH - 1}").alias("e"))
    parts = map_arrow(stretches.join(least, key).select("_id", "_td", "at", "n", "least"), _ranges,
                      "_id long, _td int, s long, e long")
    out = scratch(whole.unionByName(parts))[0]
    drop()
    drop3()
    return out


def _pack(batches):
    for b in batches:
        yield {"anchor": b.column(0), "k": b.column(1),
               "least": [_packed(np.array(x, np.int64)) for x in b.column(2).to_pylist()]}
