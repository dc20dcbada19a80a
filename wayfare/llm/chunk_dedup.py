"""Substring dedup by content-defined chunks: a gear rolling hash cuts texts where its high bits are
zero, so that cuts move along with the text when something is inserted before them; chunks are
deduplicated by digest."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import forget, fresh, join_hot, short_batches, stored, text_or_empty

PASSAGE_WORDS = 50
GEAR = np.random.default_rng(1729).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes, least: int = 32, mask_bits: int = 5, most: int = 256) -> list[int]:
    """Ends of the chunks of data, all at the start of a UTF-8 character; each chunk but the last has
    at least `least` bytes and none more than `most`."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    for step in (1, 2, 4, 8, 16):  # h[i] becomes the sum of GEAR[b[i-j]] << j over 2 * step bytes
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    heads = (b & 0xC0) != 0x80
    ends = np.flatnonzero((h[:-1] >> np.uint32(32 - mask_bits) == 0) & heads[1:]) + 1
    ends, cuts, at = ends.tolist(), [], 0
    while n - at > least:
        k = bisect_left(ends, at + least)
        cut = ends[k] if k < len(ends) else n
        if cut - at > most:
            cut = min(at + most, n)
            while cut < n and not heads[cut]:
                cut -= 1
        cuts.append(cut)
        at = cut
    if at < n:
        cuts.append(n)
    return cuts


def chunks(docs: DataFrame, key: str) -> DataFrame:
    """(a, b, doc_id, key, start, size): the chunks of every text, named by a 128-bit digest."""

    def cut(batches):
        for batch in batches:
            for first in range(0, len(batch), 64):
                a, rows = [], []
                part = batch.iloc[first : first + 64]
                for i, text in enumerate(part["text"]):
                    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
                    for end in cut_points(data):
                        a.append(xxhash.xxh3_128_digest(data[at:end]))
                        rows.append((i, at, end - at))
                        at = end
                if rows:
                    names = np.frombuffer(b"".join(a), np.int64).reshape(-1, 2)
                    i, start, size = np.array(rows, dtype=np.int64).T
                    own = part.iloc[i]
                    yield pd.DataFrame(
                        {"a": names[:, 0], "b": names[:, 1], "doc_id": own["doc_id"].to_numpy(), key: own[key].to_numpy(), "start": start.astype(np.int32), "size": size.astype(np.int32)}
                    )

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), key, "text")
    return named.mapInPandas(cut, f"a long, b long, doc_id long, `{key}` long, start int, size int")


def passages(data: bytes, words: list[tuple[int, int]], start: int, end: int) -> list[int]:
    """Names of the passages of PASSAGE_WORDS words with the chunk from start to end in or next to them;
    equal names of one chunk mean equal bytes from the passage to the chunk, both included."""
    first, last = bisect_left(words, (start, 0)), bisect_right(words, end, key=lambda w: w[1]) - 1
    out = []
    for i in range(max(0, min(first, last + 1 - PASSAGE_WORDS)), min(first, len(words) - PASSAGE_WORDS) + 1):
        low, high = min(start, words[i][0]), max(end, words[i + PASSAGE_WORDS - 1][1])
        out.append(xxhash.xxh3_64_intdigest(data[low:high], start - low) - (1 << 63))
    return out


def in_passages(rows: DataFrame, copies: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, start): the chunks of runs(key, start, end) that lie in a passage of PASSAGE_WORDS words or
    more which a document with a smaller id has too. copies: every chunk that two documents share."""
    run = runs.select(F.col(key), F.col("start").alias("low"), "end")
    asked = copies.join(run, key).where("start >= low and start < end").select("a", "b").distinct()
    places = copies.join(asked, ["a", "b"], "left_semi").groupBy(key, "doc_id").agg(F.collect_set(F.struct("start", "size")).alias("places"))
    texts = rows.select(key, "text").join(places, key)

    def name(batches):
        for batch in batches:
            out = []
            for k, doc, text, own in zip(batch[key], batch["doc_id"], batch["text"], batch["places"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                words = [m.span() for m in re.finditer(rb"\S+", data)]
                out += [(n, k, doc, p["start"]) for p in own for n in passages(data, words, p["start"], p["start"] + p["size"])]
            if out:
                yield pd.DataFrame(out, columns=["name", key, "doc_id", "start"])

    named = stored(texts.mapInPandas(name, f"name long, `{key}` long, doc_id long, start int"), "passages")
    shared = named.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return named.join(shared.drop("last"), "name").where("doc_id > first").select(key, "start").distinct()


def remove_repeats(docs: DataFrame, least_run: int = 128) -> DataFrame:
    """docs with n_bytes, removed (array of (start, end) in bytes), first_doc_ids and kept_text.

    A chunk is a repeat if a document with a smaller id has one of the same digest. Adjacent repeats
    form runs; runs of at least least_run bytes are removed. Of shorter ones those go that are in a
    passage of PASSAGE_WORDS words which a smaller id has, byte by byte; others (a stray common line)
    stay. Documents of less than least_run bytes that equal one with a smaller id go whole. Repeats within one document stay too. Rows with a null id are neither removed from nor a source;
    null and empty texts have no chunks; rows alike in id and text give the same result. Extra
    columns are kept, those of the names above replaced. Empty tables give no rows."""
    short_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "removed", "first_doc_ids", "kept_text")
    key, spans = fresh(docs, "row_key", "row_spans")
    rows = docs.withColumn(key, F.xxhash64("doc_id", text_or_empty()))
    cut = stored(chunks(rows, key), "chunks")
    shared = cut.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    shared = stored(shared.drop("last"), "chunk-shared")
    copies = stored(join_hot(cut, shared, ["a", "b"], "n", cut.count()), "chunk-copies")
    forget(cut, shared)
    repeats = copies.where("doc_id > first").select(key, "start", "size", "first").distinct()
    run_type = "array<struct<start:int,end:int,sources:array<bigint>>>"

    def join_up(acc, c):
        last = F.element_at(acc, -1)
        end = c["start"] + c["size"]
        alone = F.array(F.struct(c["start"].alias("start"), end.alias("end"), F.array(c["first"]).alias("sources")))
        longer = F.struct(last["start"].alias("start"), end.alias("end"), F.array_union(last["sources"], F.array(c["first"])).alias("sources"))
        return (
            F.when(F.size(acc) == 0, alone)
            .when(last["end"] == c["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))
            .otherwise(F.concat(acc, alone))
            .cast(run_type)
        )

    ordered = repeats.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "size", "first"))).alias(spans))
    runs = stored(ordered.select(key, F.explode(F.aggregate(spans, F.array().cast(run_type), join_up)).alias("run")).select(key, "run.*"), "chunk-runs")
    length = F.octet_length(text_or_empty())
    small = rows.where(length.between(1, least_run - 1) & F.col("doc_id").isNotNull()).select(key, F.col("doc_id").cast("long").alias("doc_id"), "text", length.alias("end"))
    before = small.groupBy("text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    whole = small.join(before, "text").where("doc_id > first").select(key, F.lit(0).alias("start"), "end", F.array("first").alias("sources")).distinct()
    short = runs.where(F.col("end") - F.col("start") < least_run)
    proved = in_passages(rows, copies, short, key).withColumnRenamed("start", "at")
    proved = short.join(proved, key).where("at >= start and at < end").select(short.columns).distinct()
    taken = runs.where(F.col("end") - F.col("start") >= least_run).union(proved.join(whole.select(key), key, "left_anti")).union(whole)
    found = taken.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "sources"))).cast(run_type).alias(spans))
    joined = rows.join(found, key, "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, removed, strict=True):
            if own is None or not len(own):
                out.append(text)
                continue
            data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
            for r in own:
                kept.append(data[at : r["start"]])
                at = r["end"]
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    empty = F.array().cast("array<struct<start:int,end:int>>")
    pairs = F.transform(spans, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    sources = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda r: r["sources"]))))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        F.coalesce(pairs, empty).alias("removed"),
        F.coalesce(sources, F.array().cast("array<bigint>")).alias("first_doc_ids"),
        without(F.col("text"), pairs).alias("kept_text"),
    )
