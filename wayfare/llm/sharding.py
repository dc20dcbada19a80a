"""Sharding by histogram sort: probe the key space, count exact bytes below each probe, refine
until every splitter is exact to one row, then exchange the rows once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import fresh, stored, text_or_empty

KEY_SPACE = 1 << 63


def _histogram(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) in each of the len(probes)+1 gaps; a key equal to a probe lies above it."""
    edges = np.asarray(probes, dtype=np.int64)

    def count(batches):
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch["key"].to_numpy(), side="right")
            np.add.at(size, at, batch["size"].to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pd.DataFrame({"gap": full.astype(np.int32), "bytes": size[full], "n": rows[full]})

    found = keys.mapInPandas(count, "gap int, bytes long, n long").groupBy("gap").agg(F.sum("bytes"), F.sum("n"))
    size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for gap, b, n in found.collect():  # at most len(probes) + 1 rows
        size[gap], rows[gap] = b, n
    return size, rows


def find_splitters(keys: DataFrame, parts: int, tolerance: float = 0.0, fan_out: int = 32) -> list[int]:
    """parts-1 splitters of keys(key long >= 0, size long) with near equal bytes between them.

    Every round counts exact bytes below fan_out probes in each open interval, on all rows.
    An interval closes when a probe is within tolerance * total / parts bytes of its target or
    when no more than one row is left between its ends. What reaches the driver is bounded by
    parts * fan_out counts, whatever the number of rows."""
    total, _ = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    targets = [total * j / parts for j in range(1, parts)]
    spans = [[0, KEY_SPACE - 1, 0, total] for _ in targets]  # low, high, bytes below each
    open_ = set(range(len(targets))) if total else set()
    while open_:
        probes = set()
        for i in open_:
            low, high = spans[i][:2]
            step = max(1, (high - low) // fan_out)
            probes.update([low, high], range(low + step, high, step))
        probes = sorted(probes)
        size, rows = _histogram(keys, probes)
        below, before = np.cumsum(size)[:-1], np.cumsum(rows)[:-1]
        for i in list(open_):
            at = int(np.searchsorted(below, targets[i], side="right"))
            low, high = max(at - 1, 0), min(at, len(probes) - 1)
            if below[low] > targets[i]:
                high = low
            spans[i] = [probes[low], probes[high], int(below[low]), int(below[high])]
            near = min(abs(below[low] - targets[i]), abs(below[high] - targets[i]))
            if probes[high] - probes[low] <= 1 or before[high] - before[low] <= 1 or near <= tolerance * total / parts:
                open_.discard(i)
    return [s[0] if t - s[2] <= s[3] - t else s[1] for s, t in zip(spans, targets, strict=True)]


def shard_documents(
    docs: DataFrame, shards: int = 8, part_bytes: int = 8 << 20, min_parts: int = 8, most_parts: int = 1 << 16
) -> DataFrame:
    """docs plus size, shard and slot: shards of near equal bytes (off by one document at most),
    rows of equal text next to each other, slots gapless from 0 within a shard.

    The key is 31 bits of the text's hash above 32 bits of the id's, so a text that a third of the
    rows hold is still split. The same probing also finds the finer cuts that keep each task of the
    only exchange near part_bytes (larger where there would be more than most_parts of them in all, as the
    driver holds their counts: 1.6 GB for 100 TB). Texts whose 31 bits agree may alternate, and a group
    of equal texts is cut where the end of a shard falls into it. A null text has size 1 and counts as empty; a null id is a key
    like any other; rows alike in id and text stay on one side of a cut. Empty tables give no rows.
    Extra columns are kept; a column named size, shard or slot is replaced."""
    docs = docs.drop("size", "shard", "slot")
    key, part = fresh(docs, "key", "part")
    text = text_or_empty()
    rows = docs.withColumn("size", (F.octet_length(text) + 1).cast("long")).withColumn(
        key,
        F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(
            F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))
        ),
    )
    keys = stored(rows.select(F.col(key).alias("key"), "size"), "shardkeys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, min(most_parts // shards, max(min_parts, -(-total // (shards * part_bytes)))))
    cuts = find_splitters(keys, shards * per_shard)
    _, counts = _histogram(keys, cuts)
    by_shard = counts.reshape(shards, per_shard)
    starts = (np.cumsum(by_shard, axis=1) - by_shard).ravel()
    edges, ahead = np.asarray(cuts, dtype=np.int64), starts.astype(np.int64)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("long")
    def before(parts: pd.Series) -> pd.Series:
        return pd.Series(ahead[parts.to_numpy()])

    rows = rows.withColumn(part, part_of(key))
    place = F.row_number().over(Window.partitionBy(part).orderBy(key, "doc_id"))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "size",
        F.floor(F.col(part) / per_shard).cast("int").alias("shard"),
        (before(part) + place - 1).cast("long").alias("slot"),
    )
