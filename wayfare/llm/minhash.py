"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is posted under each (coordinate, value) pair of its signature. Two documents that agree
on at least `least` of the coordinates must meet under one of the rarest pairs of either, so only
that prefix is posted. Each list is merged in one place: the agreements of its members are counted on
whole signatures, members that are in one class by then are skipped, and what leaves the list is a
spanning forest of the pairs above the match threshold. The classes that these make hold every
candidate pair; each is then settled in one place on full shingle sets, of which a document's are sent
once, again skipping what is already linked. Lists and classes too large for one task are cut into
parts; only where parts stay apart is each pair of parts compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import connected_components, forget, join_hot, short_batches, stored, with_ids

CACHE_WORDS = 300_000
PART_ROWS, PART_SHINGLES = 4_096, 1 << 21  # of a list or class that are held by one task
COORDINATES, LEAST = 48, 24  # a pair of similarity 0.8 agrees on fewer than 24 of 48 once in 1.2 million


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, words: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `width` words; A-Z are lower-cased, words end
    at ASCII white space, fewer words than width count as one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(width, len(h)), np.uint64)
        for i in range(min(width, len(h))):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            low = np.minimum(low, (factors[:, None] * shingles[None, at : at + 4096]).min(axis=1))
        low = low * np.uint64(0xD6E8FEB86659FD93)
    coordinate = np.arange(len(factors), dtype=np.uint64)
    return ((low & ~np.uint64(63)) | coordinate).view(np.int64)


def signatures(docs: DataFrame, width: int = 2, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, tokens, sketch): a 128-bit name of the shingle set, its signature,
    each value with its coordinate in the low bits, and eight bits of each value as the sketch."""
    factors = np.random.default_rng(11).integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    short_batches(docs.sparkSession)

    def sign(batches):
        words = _Words()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = shingle_set(text, width, words)
                name = xxhash.xxh3_128_digest(own.tobytes())
                a, b = np.frombuffer(name, np.int64)
                tokens = _signature(own, factors) if len(own) else np.empty(0, np.int64)
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(own), a, b, tokens, (tokens >> 6).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_a", "set_b", "tokens", "sketch"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(sign, "doc_id long, n_shingles long, set_a long, set_b long, tokens array<long>, sketch binary")


def _whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows of sorted batches, cut where the key changes: as few groups at once as a batch holds."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        keys = batch[key].to_numpy()
        at = int(np.searchsorted(keys, keys[-1]))
        if held and keys[0] != held[-1][key].iloc[-1]:
            yield pd.concat(held, ignore_index=True)
            held = []
        if at:
            yield pd.concat([*held, batch[:at]], ignore_index=True)
            held = []
        held.append(batch[at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _settle(count: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of count indices by the edges (a, b)."""
    label, before = np.arange(count) if label is None else label, None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
    return label


SMALL_LIST = 64


def _merge_list(sketch: np.ndarray, n: np.ndarray, known: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Classes of one list's members: pairs with enough agreements link, and so do members of one known
    class. Each member is counted against those only that no class has reached yet."""
    label, left = np.arange(len(n)), np.arange(len(n))
    flat = np.ascontiguousarray(sketch.T)
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        rest = flat[:, left]
        while queue and len(left):
            at = queue.pop()
            agree = (rest == flat[:, at : at + 1]).sum(0, dtype=np.uint16)
            size = n[left]
            hit = (agree >= least) & (100 * np.minimum(size, n[at]) >= percent * np.maximum(size, n[at])) | (known[left] == known[at])
            if hit.any():
                label[left[hit]] = root
                queue.extend(left[hit])
                left, rest = left[~hit], rest[:, ~hit]
    return label


def _forest(lists: DataFrame, least: int, percent: int) -> DataFrame:
    """Links (u, v) that span the pairs above the match threshold within each unit of
    lists(unit, id, n, c, sketch); members of one class c count as linked."""

    def merge(batches):
        for frame in _whole_groups(batches, "unit"):
            unit, ids, n, known = (frame[x].to_numpy() for x in ("unit", "id", "n", "c"))
            sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(ids), -1)
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            sizes = np.diff(np.append(starts, len(unit)))
            label = np.arange(len(unit))
            for at, size in zip(starts[sizes > SMALL_LIST], sizes[sizes > SMALL_LIST], strict=True):
                own = slice(at, at + size)
                label[own] = at + _merge_list(sketch[own], n[own], known[own], least, percent)
            ends = np.repeat(np.where(sizes <= SMALL_LIST, starts + sizes, starts), sizes)
            a, b, row = [], [], np.arange(len(unit))
            for d in range(1, min(SMALL_LIST, int(sizes.max()))):
                row = row[row + d < ends[row]]
                agree = (sketch[row] == sketch[row + d]).sum(1)
                hit = (agree >= least) & (100 * np.minimum(n[row], n[row + d]) >= percent * np.maximum(n[row], n[row + d])) | (known[row] == known[row + d])
                a.append(row[hit])
                b.append(row[hit] + d)
            if a:
                label = _settle(len(unit), np.concatenate(a), np.concatenate(b), label)
            moved = label != np.arange(len(unit))
            yield pd.DataFrame({"u": ids[label[moved]], "v": ids[moved]})

    return _in_units(lists).mapInPandas(merge, "u long, v long")


def _in_units(rows: DataFrame) -> DataFrame:
    return rows.repartition("unit").sortWithinPartitions("unit", "id")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def linked_classes(sets: list[np.ndarray], known: np.ndarray, percent: int) -> np.ndarray:
    """The first index of each set's class, where sets that share percent of their union link and sets
    of one known class do. A set is merged with what no class has reached yet: linked sets must hold one
    of its rarest shingles, and the full overlap of those that do is counted."""
    count, label = len(sets), np.arange(len(sets))
    if count == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True)) if known[0] != known[1] else 0
        if known[0] == known[1] or 100 * both >= percent * (len(a) + len(b) - both):
            label[1] = 0
        return label
    sizes = np.array([len(s) for s in sets])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner, mark = np.repeat(np.arange(count), sizes), np.zeros(len(names), bool)
    kin: dict[int, np.ndarray] = {}
    order = np.argsort(known, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(known[order])) + 1):
        kin[known[group[0]]] = group
    left = np.ones(count, bool)

    def posted() -> tuple[np.ndarray, np.ndarray]:
        keep = left[owner]
        at = np.argsort(codes[keep], kind="stable")
        return owner[keep][at], np.concatenate([[0], np.cumsum(np.bincount(codes[keep], minlength=len(names)))])

    (members, starts), indexed, n_left = posted(), count, count
    for root in range(count):
        if not left[root]:
            continue
        fresh_ones = kin[known[root]]
        queue = list(fresh_ones)
        left[fresh_ones], label[fresh_ones] = False, root
        n_left -= len(fresh_ones)
        while queue and n_left:
            at = queue.pop()
            own = codes[offsets[at] : offsets[at + 1]]
            df = starts[own + 1] - starts[own]
            rare = sizes[at] - -(-percent * int(sizes[at]) // 100) + 1
            if rare < len(own):
                pick = np.argpartition(df, rare - 1)[:rare]
                own_rare, df = own[pick], df[pick]
            else:
                own_rare = own
            if not df.any():
                continue
            near = np.zeros(count, bool)
            near[members[_ranges(starts[own_rare], df)]] = True
            near &= left
            near &= 100 * np.minimum(sizes, sizes[at]) >= percent * np.maximum(sizes, sizes[at])
            found = np.flatnonzero(near)
            if not len(found):
                continue
            mark[own] = True
            shared = np.add.reduceat(mark[codes[_ranges(offsets[found], sizes[found])]].astype(np.int64), np.cumsum(sizes[found]) - sizes[found])
            mark[own] = False
            hits = found[100 * shared >= percent * (sizes[at] + sizes[found] - shared)]
            for hit in hits:
                if left[hit]:
                    group = kin[known[hit]]
                    left[group], label[group] = False, root
                    n_left -= len(group)
                    queue.extend(group)
            if 2 * n_left < indexed:
                (members, starts), indexed = posted(), n_left
    return label


def _confirmed(units: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v, parts) that span those of full sets within each unit of units(unit, parts, id, c, set_a,
    text); u is the smallest id that v reaches there."""

    def settle(batches):
        words = _Words()
        for frame in _whole_groups(batches, "unit"):
            unit, parts, u, v, of = frame["unit"].to_numpy(), frame["parts"].to_numpy(), [], [], []
            cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                ids, known, sets = [], [], []
                for row in range(lo, hi) if hi - lo > 1 else ():
                    own = shingle_set(frame["text"].iat[row], width, words)
                    if np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)[0] == frame["set_a"].iat[row]:
                        ids.append(frame["id"].iat[row])
                        known.append(frame["c"].iat[row])
                        sets.append(own)
                if len(sets) > 1:
                    label = linked_classes(sets, np.array(known), percent)
                    moved = np.flatnonzero(label != np.arange(len(ids)))
                    u.extend(ids[k] for k in label[moved])
                    v.extend(ids[k] for k in moved)
                    of.extend(parts[lo] for _ in moved)
            yield pd.DataFrame({"u": u, "v": v, "parts": of}, dtype=np.int64)

    return _in_units(units).mapInPandas(settle, "u long, v long, parts long")


def _in_parts(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, id, parts, ...) with the unit of each row's part."""
    return rows.withColumn("unit", F.xxhash64(key, F.pmod(F.xxhash64("id"), "parts")))


def _in_pairs_of_parts(rows: DataFrame, key: str) -> DataFrame:
    """rows once for each pair of parts that theirs is in, with the unit of the pair."""
    part = F.pmod(F.xxhash64("id"), "parts")
    other = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part <> other")
    return other.withColumn("unit", F.xxhash64(key, F.least("part", "other"), F.greatest("part", "other"))).drop("part", "other")


def _still_mixed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of keys that are cut into parts and hold more than one class c."""
    mixed = rows.where("parts > 1").groupBy(key).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select(key)
    return rows.where("parts > 1").join(mixed, key)


def _classes(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with c, the class of id by the links."""
    found = connected_components(links).withColumnRenamed("component_id", "c")
    return rows.drop("c").join(found, "id", "left").withColumn("c", F.coalesce("c", "id"))


def near_duplicates(
    docs: DataFrame,
    width: int = 2,
    percent: int = 80,
    coordinates: int = COORDINATES,
    least: int = LEAST,
    part_rows: int = PART_ROWS,
    part_shingles: int = PART_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Equal sets form one class before anything is joined. Null, empty and blank texts have no set and
    link with nothing. Rows that share an id are one document; a row with a null id takes its class's
    component and is kept only if nothing names the class (component_id is then null). Extra columns
    are not read. Empty tables give no rows. Links are those of all pairs of full sets, but for pairs
    that agree on fewer than `least` of the coordinates. Work grows with the square only of lists and
    classes of more than part_rows documents that hold many groups without links between them."""
    sigs = stored(signatures(docs, width, coordinates), "minhash-sigs")
    blank, full = sigs.where("n_shingles = 0"), sigs.where("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    firsts = classes.where("id is not null").select("set_a", "set_b", F.col("id").alias("doc_id"))
    reps = sigs.join(firsts, ["set_a", "set_b", "doc_id"]).dropDuplicates(["set_a", "set_b", "doc_id"])
    reps = stored(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "set_a", "tokens", "sketch"), "minhash-classes")

    # the tokens of texts that share an id are posted as one set, under which each text's sketch is sent
    posted = reps.select("id", F.explode("tokens").alias("token"))
    common = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = posted.join(common, "token").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("own"))
    prefix = own.where(F.size("own") >= least).select("id", F.slice("own.token", 1, F.size("own") - least + 1).alias("prefix"))
    lists = prefix.join(reps.drop("tokens"), "id").select(F.explode("prefix").alias("token"), "id", "n", F.col("id").alias("c"), "sketch")
    lists = stored(lists, "minhash-lists")
    heavy = lists.groupBy("token").agg(F.ceil(F.count("*") / part_rows).alias("parts")).where("parts > 1")
    heavy, sketched = stored(heavy, "minhash-heavy"), ["unit", "id", "n", "c", "sketch"]
    placed = lists.join(heavy, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    candidates = stored(_forest(_in_parts(placed, "token").select(sketched), least, percent), "minhash-candidates")
    links = candidates
    if not heavy.isEmpty():
        apart = _still_mixed(_classes(lists.join(heavy, "token"), links), "token")
        links = links.union(_forest(_in_pairs_of_parts(apart, "token").select(sketched), least, percent))
    clusters = connected_components(links).withColumnRenamed("component_id", "cluster")

    members = clusters.join(reps.select("id", "set_a", "n"), "id")
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / part_rows, F.sum("n") / part_shingles)).alias("parts"))
    members = stored(members.join(sizes, "cluster").select("id", "set_a", "cluster", "parts", F.col("id").alias("c")), "minhash-clusters")
    forget(reps, lists, heavy, candidates)
    texts = with_ids(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), members.select("id"), "id")
    texts = texts.withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["id", "text_hash"]).drop("text_hash")
    texts = stored(texts, "minhash-texts")
    sent = ["unit", "parts", "id", "c", "set_a", "text"]
    links = stored(_confirmed(_in_parts(members, "cluster").join(texts, "id").select(sent), width, percent), "minhash-links")
    found = links.where("parts = 1 and u <> v").select(F.col("v").alias("id"), F.col("u").alias("component_id")).distinct()
    cut, links = members.where("parts > 1"), links.where("parts > 1").select("u", "v")
    if not cut.isEmpty():
        apart = _still_mixed(_classes(cut, links), "cluster")
        more = _confirmed(_in_pairs_of_parts(apart, "cluster").join(texts, "id").select(sent), width, percent)
        found = found.union(connected_components(links.union(more.select("u", "v"))))

    named = classes.join(found, "id", "left").select("set_a", "set_b", F.coalesce("component_id", "id").alias("component_id"), "copies")
    rows = join_hot(full.select("doc_id", "n_shingles", "set_a", "set_b"), named, ["set_a", "set_b"], "copies", full.count())
    rows = rows.select("doc_id", "n_shingles", "component_id").union(blank.select("doc_id", "n_shingles", "doc_id"))
    kept = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id"))
    return rows.withColumn("kept", kept)
