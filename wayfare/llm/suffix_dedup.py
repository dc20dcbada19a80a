"""Exact substring dedup by suffix sorting.

A byte goes if a 50-byte string over it also starts in a document with a smaller id. Suffixes are
compared to a depth of 50 bytes by deep-shallow sorting: a multikey quicksort to a shallow depth, in
vectorised form (each step sorts all groups that still agree by their next eight bytes at once), then
blind tries for the groups that still agree, again a level of all of them at a time. Only suffixes that can
have an equal in another document are sorted: every 50-byte string is filed under its anchor, the
20-byte string in it of least hash, and equal strings have equal anchors.

1. Documents are laid out in blocks of a few MB; each block tells the buckets its anchors' hashes.
2. Buckets answer with the anchors that several blocks have; blocks send the stretches of text whose
   strings share such an anchor, each distinct stretch once with its smallest document id.
3. Buckets sort the suffixes and answer with the smallest id of each; blocks cut their documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import short_batches, stored, text_or_empty

DEPTH, ANCHOR, SHALLOW = 50, 20, 24
BLOCK_BYTES, PIECE_BYTES, BUCKET_BYTES = 4 << 20, 1 << 20, 8 << 20
NO_ID = np.iinfo(np.int64).max
PRIME = np.uint64(0x9E3779B97F4A7C15)


def deep_shallow(text: np.ndarray, starts: np.ndarray, depth: int = DEPTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the suffixes of text (uint8) at starts in order of their first `depth` bytes,
    and for each in that order the number of its class of equals."""
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)

    def refine(members: np.ndarray, keys: np.ndarray) -> None:
        """Sort the members (positions in order, whole groups) by keys within their groups."""
        nonlocal group
        by = np.lexsort((keys, group[members]))
        order[members] = order[members][by]
        keys = keys[by]
        own = group[members]
        new = np.zeros(len(group), np.int64)
        new[members[1:]] = ((own[1:] == own[:-1]) & (keys[1:] != keys[:-1])).astype(np.int64)
        group = group + np.cumsum(new)

    for at in range(0, shallow, 8):  # multikey quicksort, eight bytes to a key
        members = _repeated(group)
        if not len(members):
            return order, group
        word = text[starts[order[members]][:, None] + np.arange(at, at + 8)]
        refine(members, np.ascontiguousarray(word).view(">u8").ravel().astype(np.uint64))
    open_ = _repeated(group)
    width = np.arange(shallow, depth)
    while len(open_):  # a level of all blind tries at once: branch off the first of each group
        own = group[open_]
        first = np.searchsorted(own, own)
        rest = text[starts[order[open_]][:, None] + width]
        lead = rest[first]
        differs = rest != lead
        branch = np.where(differs.any(1), differs.argmax(1), len(width))
        row = np.arange(len(open_))
        byte = np.where(branch < len(width), rest[row, np.minimum(branch, len(width) - 1)], 0).astype(np.int64)
        above = byte > np.where(branch < len(width), lead[row, np.minimum(branch, len(width) - 1)], 0)
        key = np.where(branch == len(width), len(width), np.where(above, 2 * len(width) - branch, branch)) * 256 + byte
        done = len(width) * 256
        refine(open_, key)
        key = key[np.lexsort((key, own))]
        left = open_[key != done]
        own = group[left]
        again = np.zeros(len(left), bool)
        again[1:] |= own[1:] == own[:-1]
        again[:-1] |= own[1:] == own[:-1]
        open_ = left[again]
    return order, group


def _repeated(group: np.ndarray) -> np.ndarray:
    same = group[1:] == group[:-1]
    mask = np.zeros(len(group), bool)
    mask[1:] |= same
    mask[:-1] |= same
    return np.flatnonzero(mask)


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, hash): runs of neighbouring DEPTH-byte strings of one document with one anchor.

    data: the documents' bytes laid end to end; ends: where each ends."""
    begins = np.concatenate([[0], ends[:-1]])
    spans = [(b + at, min(b + at + PIECE_BYTES + DEPTH - 1, e)) for b, e in zip(begins.tolist(), ends.tolist(), strict=True) for at in range(0, max(0, e - b - DEPTH + 1), PIECE_BYTES)]
    out, group, size = [], [], 0
    for span in spans:
        group.append(span)
        size += span[1] - span[0]
        if size >= PIECE_BYTES:
            out.append(_stretches(data, group))
            group, size = [], 0
    if group:
        out.append(_stretches(data, group))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _stretches(data: np.ndarray, spans: list[tuple[int, int]]):
    sizes = np.array([e - b for b, e in spans])
    shift = np.repeat(np.array([b for b, _ in spans]) - (np.cumsum(sizes) - sizes), sizes)
    text = np.concatenate([data[b:e] for b, e in spans])
    with np.errstate(over="ignore"):
        h = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        power, parts = PRIME, {1: h}
        for n in (1, 2, 4, 8):
            h = h[:-n] * power + h[n:]
            power = power * power
            parts[2 * n] = h
        h = parts[16][:-4] * (PRIME * PRIME * PRIME * PRIME) + parts[4][16:]  # ANCHOR = 16 + 4 bytes
        del parts
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    low = (h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    for n in (1, 2, 4, 8):
        low = np.minimum(low[:-n], low[n:])
    low = np.minimum(low[: len(low) - 15], low[15:])  # DEPTH - ANCHOR + 1 = 31 anchors
    at = (low & np.uint64((1 << 22) - 1)).astype(np.int64)
    inside = np.ones(len(at), bool)
    for last in np.cumsum(sizes)[:-1].tolist():
        inside[last - DEPTH + 1 : last] = False
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(at)))
    keep = inside[first]
    first, count = first[keep], count[keep]
    return first + shift[first], count, h[at[first]]


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, ids, sizes, data): documents laid end to end, whole, about BLOCK_BYTES to a row."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=5)
        ids, texts, size = [], [], 0

        def row():
            known = [NO_ID if i is None else i for i in ids]
            return pa.RecordBatch.from_pydict(
                {
                    "ids": pa.array([np.array(known, np.int64).tobytes()]),
                    "sizes": pa.array([np.array([len(t) for t in texts], np.int64).tobytes()]),
                    "data": pa.array([squeeze.compress(b"".join(texts))]),
                }
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= BLOCK_BYTES or len(ids) >= 1 << 16:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    laid = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lay, "ids binary, sizes binary, data binary")
    return laid.withColumn("block", F.monotonically_increasing_id())


def _open(row) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(row.ids, np.int64), np.cumsum(np.frombuffer(row.sizes, np.int64)), _unpack(row.data) if len(row.data) else b""


def _named(ids: np.ndarray, ends: np.ndarray, data: np.ndarray):
    """The stretches of documents that have an id, with the document of each."""
    start, count, h = stretches(data, ends)
    doc = np.searchsorted(ends, start, side="right")
    own = ids[doc] != NO_ID
    return start[own], count[own], h[own], doc[own]


def _distinct(data: bytes, start: np.ndarray, count: np.ndarray, doc_id: np.ndarray) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Number of each distinct stretch in order of appearance, that of every stretch, smallest ids."""
    seen: dict[bytes, int] = {}
    which = [seen.setdefault(data[a:b], len(seen)) for a, b in zip(start.tolist(), (start + count + DEPTH - 1).tolist(), strict=True)]
    which = np.array(which, dtype=np.int64)
    least = np.full(len(seen), NO_ID, np.int64)
    np.minimum.at(least, which, doc_id)
    return seen, which, least


def _smallest(contents: list[bytes], anchors: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
    """For each distinct stretch the smallest id that has each of its strings."""
    counts = np.array([len(c) - DEPTH + 1 for c in contents], dtype=np.int64)
    out = [np.full(n, m, np.int64) for n, m in zip(counts.tolist(), least.tolist(), strict=True)]
    _, place, size = np.unique(anchors, return_inverse=True, return_counts=True)
    rivals = np.flatnonzero(size[place] > 1)
    if not len(rivals):
        return out
    lengths = counts[rivals] + DEPTH - 1
    text = np.frombuffer(b"".join([contents[i] for i in rivals]) + bytes(8), np.uint8)
    base = np.cumsum(lengths) - lengths
    n = counts[rivals]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, rank = deep_shallow(text, np.repeat(base, n) + inner)
    first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
    ids = np.repeat(least[rivals], n)
    best = np.empty(len(order), np.int64)
    best[order] = np.minimum.reduceat(ids[order], first)[rank]
    for i, own in zip(rivals.tolist(), np.split(best, np.cumsum(n)[:-1]), strict=True):
        out[i] = own
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): removed is an array of (start, end) in bytes, kept the rest.

    Matches never cross documents. Rows with a null id lose nothing and are no source; rows that share
    an id are no source to each other; a null text is empty; texts under 50 bytes lose nothing. Extra
    columns are not read. Empty tables give no rows."""
    spark = docs.sparkSession
    short_batches(spark)
    blocks = stored(blocks_of(docs), "blocks")
    total = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    buckets = int(max(64, total // BUCKET_BYTES))
    by = np.uint64(buckets)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, ends, data = _open(row)
                h = np.unique(_named(ids, ends, np.frombuffer(data, np.uint8))[2])
                bucket, rest = (h % by).astype(np.int64), ((h // by) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                order = np.lexsort((rest, bucket))
                bucket, rest = bucket[order], rest[order]
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                blobs = [own.tobytes() for own in np.split(rest, first[1:])] if len(first) else []
                yield pd.DataFrame({"bucket": bucket[first], "block": row.block, "blob": blobs})

    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        asked = [np.unique(np.frombuffer(x, np.uint32)) for x in group["blob"]]
        every = np.sort(np.concatenate(asked))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        return pd.DataFrame({"block": group["block"], "found": [np.intersect1d(a, shared, assume_unique=True).tobytes() for a in asked], "bucket": key[0]})

    asked = blocks.mapInPandas(ask, "bucket int, block long, blob binary")
    found = asked.groupBy("bucket").applyInPandas(answer, "block long, found binary, bucket int").where(F.octet_length("found") > 0)
    found = stored(found, "anchors").groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("answers"))

    def surviving(row, ids, ends, data):
        """The stretches whose anchor another document may have, as every later step sees them."""
        start, count, h, doc = _named(ids, ends, np.frombuffer(data, np.uint8))
        if not len(h):
            return start, count, h, doc
        by_doc = np.lexsort((doc, h))
        hs, ds = h[by_doc], doc[by_doc]
        many = hs[1:][(hs[1:] == hs[:-1]) & (ds[1:] != ds[:-1])]
        keep = np.isin(h, np.unique(many))
        names = (h % by) << np.uint64(32) | ((h // by) & np.uint64(0xFFFFFFFF))
        answers = row.answers if row.answers is not None else []
        known = [np.uint64(a["bucket"]) << np.uint64(32) | np.frombuffer(a["found"], np.uint32).astype(np.uint64) for a in answers]
        if known:
            keep |= np.isin(names, np.concatenate(known))
        return start[keep], count[keep], h[keep], doc[keep]

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, ends, data = _open(row)
                start, count, h, doc = surviving(row, ids, ends, data)
                seen, which, least = _distinct(data, start, count, ids[doc])
                if not seen:
                    continue
                anchor = np.zeros(len(seen), np.uint64)
                anchor[which] = h
                contents, bucket = list(seen), (anchor % by).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    b = int(bucket[own[0]])
                    sizes = np.array([len(contents[i]) for i in own], np.int64)
                    blob = _pack(np.array([len(own)], np.int64), sizes, anchor[own], least[own], np.frombuffer(b"".join([contents[i] for i in own]), np.uint8))
                    yield pd.DataFrame({"bucket": [b], "block": [row.block], "blob": [blob]})

    def sort(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        every: dict[bytes, int] = {}
        anchors, least, parts = [], [], []
        for blob in group["blob"]:
            raw = _unpack(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            sizes, anchor, ids = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint64, n, 8 + 8 * n), np.frombuffer(raw, np.int64, n, 8 + 16 * n)
            at, which = 8 + 24 * n, []
            for size, a, i in zip(sizes.tolist(), anchor.tolist(), ids.tolist(), strict=True):
                k = every.setdefault(raw[at : at + size], len(every))
                at += size
                if k == len(anchors):
                    anchors.append(a)
                    least.append(i)
                elif i < least[k]:
                    least[k] = i
                which.append(k)
            parts.append(which)
        best = _smallest(list(every), np.array(anchors, np.uint64), np.array(least, np.int64))
        return pd.DataFrame({"block": group["block"], "bucket": key[0], "found": [_pack(*[best[k] for k in which]) for which in parts]})

    schema = "block long, bucket int, found binary"
    placed = blocks.join(found, "block", "left")
    told = placed.mapInPandas(tell, "bucket int, block long, blob binary")
    sorted_ = stored(told.groupBy("bucket").applyInPandas(sort, schema), "suffixes")
    replies = sorted_.groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("smallest"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                ids, ends, data = _open(row)
                start, count, h, doc = surviving(row, ids, ends, data)
                seen, which, _ = _distinct(data, start, count, ids[doc])
                gone = np.zeros(len(data) + 1, np.int32)
                if seen:
                    sizes = np.fromiter((len(c) - DEPTH + 1 for c in seen), np.int64, len(seen))
                    first = np.cumsum(sizes) - sizes
                    anchor = np.zeros(len(seen), np.uint64)
                    anchor[which] = h
                    bucket, best = (anchor % by).astype(np.int64), np.empty(sizes.sum(), np.int64)
                    for part in row.smallest:
                        own = np.flatnonzero(bucket == part["bucket"])
                        at = np.arange(sizes[own].sum()) + np.repeat(first[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own])
                        best[at] = np.frombuffer(_unpack(part["found"]), np.int64)
                    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    repeat = best[np.repeat(first[which], count) + inner] < np.repeat(ids[doc], count)
                    at = (np.repeat(start, count) + inner)[repeat]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + DEPTH, -1)
                covered = np.cumsum(gone)[:-1] > 0
                begins = np.concatenate([[0], ends[:-1]])
                for first_doc in range(0, len(ids), 256):
                    rows = {"doc_id": [], "n_bytes": [], "removed": [], "kept": []}
                    for d in range(first_doc, min(first_doc + 256, len(ids))):
                        b, e = int(begins[d]), int(ends[d])
                        own = covered[b:e]
                        cuts = (b + np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))).tolist() if own.any() else []
                        spans = [(x - b, y - b) for x, y in zip(cuts[::2], cuts[1::2], strict=True)]
                        kept, at = [], b
                        for x, y in zip(cuts[::2], cuts[1::2], strict=True):
                            kept.append(data[at:x])
                            at = y
                        rows["doc_id"].append(None if ids[d] == NO_ID else int(ids[d]))
                        rows["n_bytes"].append(e - b)
                        rows["removed"].append([{"start": x, "end": y} for x, y in spans])
                        rows["kept"].append(b"".join([*kept, data[at:e]]))
                    yield pa.RecordBatch.from_pydict(
                        rows,
                        pa.schema(
                            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
                        ),
                    )

    final = placed.join(replies, "block", "left")
    return final.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
