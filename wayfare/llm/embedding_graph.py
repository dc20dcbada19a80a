"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards; each shard builds a graph by greedy search and robust
pruning, and the adjacency lists of a vector's shards are united. Range-expanding greedy search from
the medoid of each of its shards then gathers all vectors within the threshold of a query. Groups so large and tight
that splitting may cut through them leave cores in their shards; all links of a core's vectors are
found by exact comparison instead. Every link is verified in double precision, and recall is audited
against brute force on bounded samples of queries, in cores and outside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import connected_components, forget, join_hot, short_batches, stored

SHARD_ROWS, FAN_OUT, DEGREE, ALPHA = 4_000, 64, 24, 1.2
#: A core: this many or more home vectors of one shard within this cosine of their pivot.
CORE_ROWS, CORE_COSINE, BLOCK_ROWS = 64, 0.9, 4_000
NOTHING = -2.0


def unit(embeddings) -> np.ndarray:
    x = np.stack([np.asarray(e, dtype=np.float64) for e in embeddings])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the `width` best found for each query, best first; -1 pads. All queries step
    together, each from its best vertex not yet expanded, until none is left."""
    n = len(queries)
    ids, cos, done = np.full((n, width), -1), np.full((n, width), NOTHING), np.zeros((n, width), bool)
    ids[:, 0], cos[:, 0] = entry, queries @ x[entry]
    live = np.arange(n)
    while len(live):
        waiting = np.where(done[live] | (ids[live] < 0), NOTHING - 1, cos[live])
        best = waiting.argmax(1)
        more = waiting[np.arange(len(live)), best] > NOTHING
        live, best = live[more], best[more]
        if not len(live):
            break
        done[live, best] = True
        near = graph[ids[live, best]]
        value = np.einsum("qrd,qd->qr", x[near], queries[live])
        value[(near < 0) | (near[:, :, None] == ids[live][:, None, :]).any(2)] = NOTHING
        every = np.concatenate([cos[live], value], 1)
        top = np.argsort(-every, axis=1, kind="stable")[:, :width]
        row = np.arange(len(live))[:, None]
        ids[live] = np.where(every[row, top] > NOTHING, np.concatenate([ids[live], near], 1)[row, top], -1)
        done[live] = np.concatenate([done[live], np.zeros_like(near, bool)], 1)[row, top]
        cos[live] = every[row, top]
    return ids, cos


def robust_prune(x: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """For each vertex of own, up to `degree` of its candidates near (-1 pads): the nearest, then the
    nearest not already closer, by the factor ALPHA, to one chosen before."""
    near = np.where(near == own[:, None], -1, near)
    dist = np.where(near < 0, np.inf, 1 - np.einsum("qrd,qd->qr", x[near], x[own]))
    order = np.argsort(dist, axis=1, kind="stable")
    row = np.arange(len(own))[:, None]
    near, dist = near[row, order], dist[row, order]
    same = np.zeros_like(near, bool)
    for shift in range(1, near.shape[1]):  # equal candidates lie next to each other or at equal distance
        hit = (near[:, shift:] == near[:, :-shift]) & (near[:, shift:] >= 0)
        if not (dist[:, shift:] == dist[:, :-shift])[near[:, shift:] >= 0].any():
            break
        same[:, shift:] |= hit
    dist[same] = np.inf
    between = 1 - np.einsum("qad,qbd->qab", x[near], x[near])
    out, alive = np.full((len(own), degree), -1), np.isfinite(dist)
    for k in range(degree):
        pick = np.where(alive, dist, np.inf).argmin(1)
        ok = alive[np.arange(len(own)), pick]
        if not ok.any():
            break
        out[ok, k] = near[np.arange(len(own)), pick][ok]
        alive &= ~((ALPHA * between[np.arange(len(own)), pick] <= dist) & ok[:, None])
        alive[np.arange(len(own)), pick] = False
    return out


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build_graph(x: np.ndarray, width: int = 32, degree: int = DEGREE, seed: int = 3) -> np.ndarray:
    """Adjacency (n by degree, -1 pads) by inserting vertices in growing batches, with back edges."""
    n, entry = len(x), medoid(x)
    graph = np.full((n, degree), -1)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        own = order[at : at + size]
        found, _ = beam_search(x, graph, entry, x[own], width)
        graph[own] = robust_prune(x, own, found, degree)
        source, target = np.repeat(own, degree), graph[own].ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        touched, first, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max()) if len(count) else 0
        for start in range(0, most, 2 * degree):  # hubs take their back edges a part at a time
            take = touched[count > start]
            extra = np.full((len(take), 2 * degree), -1)
            for i, (f, c) in enumerate(zip(first[count > start], count[count > start], strict=True)):
                part = source[f + start : f + min(c, start + 2 * degree)]
                extra[i, : len(part)] = part
            graph[take] = robust_prune(x, take, np.concatenate([graph[take], extra], 1), degree)
        at += len(own)
        size = min(256, max(1, at))
    return graph


def range_search(x: np.ndarray, graph: list[np.ndarray], padded: np.ndarray, queries: np.ndarray, least: float, width: int, slack: float = 0.1) -> list[np.ndarray]:
    """For each query (vertex number) all vertices found with cosine >= least, itself excepted.

    A beam search lands near the query; from there the search goes on through every vertex within
    slack of the threshold, along edges in either direction, until no new one turns up."""
    entry, out = medoid(x), []
    source, target = np.repeat(np.arange(len(graph)), [len(g) for g in graph]), np.concatenate(graph) if len(graph) else np.empty(0, int)
    edges = np.unique(np.concatenate([source, target]) * np.int64(len(x)) + np.concatenate([target, source]))
    both = np.split(edges % len(x), np.searchsorted(edges // len(x), np.arange(1, len(x))))
    for first in range(0, len(queries), 256):
        own = queries[first : first + 256]
        ids, cos = beam_search(x, padded, entry, x[own], width)
        for q, near, value in zip(own.tolist(), ids, cos, strict=True):
            open_ = np.append(near[(value >= least - slack) & (near >= 0)], q)
            seen = np.zeros(len(x), bool)
            seen[open_] = True
            hits = [open_]
            while len(open_):
                more = np.unique(np.concatenate([both[v] for v in open_.tolist()]))
                more = more[~seen[more]]
                seen[more] = True
                open_ = more[x[more] @ x[q] >= least - slack]
                hits.append(open_)
            every = np.unique(np.concatenate(hits))
            every = every[(x[every] @ x[q] >= least) & (every != q)]
            out.append(every)
    return out


def _centres(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        for c in range(k):
            own = sample[nearest == c]
            if len(own):
                mean = own.mean(0)
                centres[c] = mean / max(np.sqrt((mean * mean).sum()), 1e-12)
    return centres


#: Rows of an oversized shard that one task deals, levels that are split by centres, and rows its centres are fitted on.
DEALT_ROWS, CENTRE_LEVELS, SAMPLE_ROWS = 50_000, 8, 32 * FAN_OUT


def deal(vectors: DataFrame, overlap: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors(id, weight, embedding) once for each shard they are in: plus shard and home (whether it
    is their nearest). Shards over shard_rows are split again, by at most FAN_OUT centres fitted on a
    hash sample of about SAMPLE_ROWS of their rows. Centres are fitted by executors and sent, ahead of the rows,
    to each of the tasks that a shard is dealt by; the driver sees nothing. What CENTRE_LEVELS splits
    leave oversized is so tight that cores find its links, and is split by hash."""
    state, level = stored(vectors.withColumns({"shard": F.lit(""), "home": F.lit(True)}), "shards"), 0
    columns, schema = state.columns, state.schema

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        size = group["size"].iloc[0]
        group = group.sort_values("id")
        k = int(min(FAN_OUT, len(group), max(2, -(-2 * overlap * size // shard_rows))))
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "centres": [_centres(unit(group["embedding"]), k).ravel()]})

    while True:
        sizes = stored(state.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > shard_rows), "shard-sizes")
        if sizes.isEmpty():
            return state
        big = state.join(sizes, "shard")
        if level >= CENTRE_LEVELS:
            piece = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / shard_rows)).cast("string")
            parted = big.withColumn("shard", F.concat("shard", F.lit("/"), piece)).select(columns)
        else:
            drawn = F.pmod(F.xxhash64("id", F.lit(level)), "size") < SAMPLE_ROWS
            centres = stored(big.where(drawn).groupBy("shard").applyInPandas(fit, "shard string, centres array<double>"), "centres")
            tasks = F.ceil(F.col("size") / DEALT_ROWS)
            ahead = centres.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("task"), F.col("centres").alias("embedding"), F.lit(0).alias("kind"))
            rows = big.withColumns({"task": F.pmod(F.xxhash64("id"), tasks), "kind": F.lit(1)}).drop("size")
            sent = rows.unionByName(ahead, allowMissingColumns=True).repartition("shard", "task").sortWithinPartitions("shard", "task", "kind")
            parted = sent.mapInPandas(_splitter(overlap if level == 0 else 2, columns), schema)
        before, state, level = state, stored(state.join(sizes, "shard", "left_anti").select(columns).union(parted), "shards"), level + 1
        forget(before, sizes)


def _splitter(most: int, columns: list[str]):
    """Deals rows to the `most` nearest of the centres that come before them in the partition."""

    def split(batches):
        shard, centres = None, None
        for batch in batches:
            cuts = np.flatnonzero((batch["kind"] == 0).to_numpy())
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                own = batch.iloc[lo:hi]
                if len(own) and own["kind"].iloc[0] == 0:
                    shard, flat, own = own["shard"].iloc[0], own["embedding"].iloc[0], own.iloc[1:]
                    centres = np.asarray(flat, float)
                if not len(own):
                    continue
                x = unit(own["embedding"])
                c = centres.reshape(-1, x.shape[1])
                take = min(most, len(c))
                nearest = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :take]
                for rank in range(take):
                    part = own[columns].copy()
                    part["shard"] = [f"{shard}/{i}" for i in nearest[:, rank]]
                    part["home"] = own["home"].astype(bool) & (rank == 0)
                    yield part.astype({"id": "int64", "weight": "int64"})

    return split


def find_cores(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pivot, rows) of the cores of x, largest first by a sample of possible pivots; no row is in two."""
    left, out = np.arange(len(x)), []
    while len(left) >= CORE_ROWS:
        tried = left[np.unique(np.linspace(0, len(left) - 1, 256).astype(int))]
        close = x[tried] @ x[left].T >= CORE_COSINE
        mean = x[left[close[close.sum(1).argmax()]]].mean(0)
        pivot = mean / np.sqrt((mean * mean).sum())
        own = left[x[left] @ pivot >= CORE_COSINE][:BLOCK_ROWS]
        if len(own) < CORE_ROWS:
            break
        out.append((pivot, own))
        left = np.setdiff1d(left, own)
    return out


def core_links(vectors: DataFrame, pivots: list, least: float) -> DataFrame:
    """vectors(id, weight, embedding, core), pivots(core, pivot) -> (id, home, hot, n, root) with the
    links of which one end or both are in a core. What links with a core's vector lies, by the triangle
    inequality, within both angles of the pivot; those visitors are compared with the core in blocks."""
    names, x = [r.core for r in pivots], np.array([r.pivot for r in pivots])
    reach = np.cos(min(np.pi, np.arccos(least) + np.arccos(CORE_COSINE))) - 1e-9

    def visit(batches):
        for batch in batches:
            if len(batch):
                row, at = np.nonzero(unit(batch["embedding"]) @ x.T >= reach)
                own = batch.iloc[row].copy()
                own["pivot"] = [names[i] for i in at]
                yield own

    visits = stored(vectors.mapInPandas(visit, "id long, weight long, embedding array<double>, core string, pivot string"), "visits")
    blocks = visits.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    visits = visits.join(F.broadcast(blocks), "pivot")
    dealt = visits.select("*", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(False).alias("inside"))
    members = visits.where("core = pivot").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("inside"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        inside = group["inside"].to_numpy()
        c, v = group[inside], group[~inside]
        c_id, v_id, hot = c["id"].to_numpy(), v["id"].to_numpy(), v["core"].notna().to_numpy()
        if not len(v):
            return pd.DataFrame({"id": c_id, "home": True, "hot": True, "n": 0, "root": c_id})
        hit = (unit(v["embedding"]) @ unit(c["embedding"]).T >= least) & (v_id[:, None] != c_id)
        # a visitor in a core has its links counted with that core
        n = np.concatenate([v["weight"].to_numpy() @ hit, np.where(hot, 0, hit @ c["weight"].to_numpy())])
        top = np.iinfo(np.int64).max
        c_root, v_root, before = c_id.copy(), v_id.copy(), None
        while before is None or (c_root != before).any():
            before = c_root.copy()
            v_root = np.minimum(v_root, np.where(hit, c_root, top).min(1))
            c_root = np.minimum(c_root, np.where(hit, v_root[:, None], top).min(0))
        keep = np.concatenate([np.ones(len(c), bool), hit.any(1)])
        out = {"id": np.concatenate([c_id, v_id]), "home": True, "hot": np.concatenate([np.ones(len(c), bool), hot]), "n": n, "root": np.concatenate([c_root, v_root])}
        return pd.DataFrame(out)[keep]

    return dealt.unionByName(members).groupBy("pivot", "block").applyInPandas(compare, "id long, home boolean, hot boolean, n long, root long")


def search_links(vectors: DataFrame, least: float, overlap: int, width: int) -> tuple[DataFrame, DataFrame]:
    """vectors(id, weight, embedding) -> counts(id, hot, n): the weight of those an id links with, and
    whether it is in a core; and edges(u, v) that span the links. Every vector is searched for in all
    of its shards, and a link found from either end counts at both."""
    dealt = deal(vectors, overlap)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        x, ids = unit(group["embedding"]), group["id"].to_numpy()
        home, core, pivots = np.flatnonzero(group["home"].to_numpy()), [None] * len(ids), [None] * len(ids)
        for k, (pivot, own) in enumerate(find_cores(x[home])):
            pivots[home[own[0]]] = pivot
            for i in home[own]:
                core[i] = f"{group['shard'].iloc[0]}#{k}"
        return pd.DataFrame({"id": ids, "near": [ids[g[g >= 0]] for g in build_graph(x, width)], "core": core, "pivot": pivots})

    lists = dealt.groupBy("shard").applyInPandas(build, "id long, near array<long>, core string, pivot array<double>")
    near = F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")
    united = stored(lists.groupBy("id").agg(near, F.max("core").alias("core"), F.max("pivot").alias("pivot")), "graph")
    pivots = united.where("pivot is not null").select("core", "pivot").collect()  # at most a row for CORE_ROWS vectors

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        ids, x, weight = group["id"].to_numpy(), unit(group["embedding"]), group["weight"].to_numpy()
        graph = []
        for near in group["near"]:
            at = np.searchsorted(ids, near)
            at = at[at < len(ids)]
            graph.append(at[np.isin(ids[at], near)])
        padded = np.full((len(ids), max(1, max(map(len, graph)))), -1)
        for i, near in enumerate(graph):
            padded[i, : len(near)] = near
        hot = group["core"].notna().to_numpy()
        queries = np.flatnonzero(~hot)
        found = [f[~hot[f]] for f in range_search(x, graph, padded, queries, least, width)]
        u = np.repeat(queries, [len(f) for f in found])
        v = np.concatenate(found) if len(u) else np.empty(0, int)
        low, high = np.divmod(np.unique(np.minimum(u, v) * np.int64(len(ids)) + np.maximum(u, v)), len(ids))
        return pd.DataFrame({"u": ids[low], "v": ids[high], "weight_u": weight[low], "weight_v": weight[high]})

    joined = dealt.join(united.drop("pivot"), "id")
    pairs = joined.groupBy("shard").applyInPandas(search, "u long, v long, weight_u long, weight_v long").distinct()
    pairs = stored(pairs, "links")
    counted = pairs.select(F.col("u").alias("id"), F.col("weight_v").alias("n")).union(pairs.select("v", "weight_u"))
    edges = pairs.select("u", "v")
    if pivots:
        cored = stored(core_links(vectors.join(united.select("id", "core"), "id"), pivots, least), "core-links")
        counted, edges = counted.union(cored.select("id", "n")), edges.union(cored.select("id", "root"))
    counted = counted.groupBy("id").agg(F.sum("n").alias("n"))
    every = united.select("id", F.col("core").isNotNull().alias("hot")).join(counted, "id", "left")
    return stored(every.withColumn("n", F.coalesce("n", F.lit(0))), "link-counts"), edges


def audit(vectors: DataFrame, found: DataFrame, least: float, queries: int) -> float:
    """Links found over links there are, by brute force against all vectors for up to `queries` of those
    that found(id, n) names, and as many again of those with links."""
    drawn = F.xxhash64("id", F.lit(9))
    some = found.orderBy(drawn, "id").limit(queries).union(found.where("n > 0").orderBy(drawn, "id").limit(queries)).select("id").distinct()
    picked = vectors.join(F.broadcast(some), "id", "left_semi").select("id", "embedding").toPandas()
    if not len(picked):
        return 1.0
    ids, q = picked["id"].to_numpy(), unit(picked["embedding"])

    def count(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if len(batch):
                hit = (unit(batch["embedding"]) @ q.T >= least) & (batch["id"].to_numpy()[:, None] != ids)
                total += (hit * batch["weight"].to_numpy()[:, None]).sum(0)
        yield pd.DataFrame({"id": ids, "there": total})

    there = vectors.mapInPandas(count, "id long, there long").groupBy("id").agg(F.sum("there").alias("there"))
    row = there.join(found, "id").agg(F.sum(F.least("n", "there")), F.sum("there")).first()
    return 1.0 if not row[1] else row[0] / row[1]


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, overlap: int = 3, width: int = 32, audit_queries: int = 128, recall: float = 0.98
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    Null, empty or zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different length. Equal vectors are one class before the graph is built and link with
    each other. Rows with a null id take their class's component, and count as vectors. If the audit
    finds less than `recall`, the search is repeated with wider beams and more overlap, twice at most,
    and then fails rather than return less than 0.9. Extra columns are not read."""
    short_batches(vectors.sparkSession, 4_000)
    rows = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda e: e.cast("double") + 0.0).alias("embedding"))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("embedding", lambda e: e != 0)
    rows = stored(rows.withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    classes = rows.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    classes = stored(classes, "vector-classes")
    named = classes.where("id is not null").groupBy("id", "weight", "embedding").agg(F.lit(1).alias("one")).drop("one")
    parts = []
    for (size,) in named.select(F.size("embedding")).distinct().collect():
        own, wide, more = named.where(F.size("embedding") == size), width, overlap
        for attempt in range(3):
            counts, edges = search_links(own, least, more, wide)
            share = min(audit(own, counts.where(part), least, audit_queries) for part in ("not hot", "hot"))
            if share >= recall:
                break
            wide, more = 2 * wide, more + 1
        if share < 0.9:
            raise RuntimeError(f"audited recall is {share:.3f}")
        parts.append((counts, edges))
    if not parts:
        nothing = F.lit(0).cast("long").alias("n_links")
        return rows.select("vec_id", nothing, F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts, edges = parts[0]
    for more_counts, more_edges in parts[1:]:
        counts, edges = counts.union(more_counts), edges.union(more_edges)
    roots = connected_components(edges)
    known = classes.join(counts.drop("hot"), "id", "left").join(roots, "id", "left").select(
        "embedding", "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("c")
    )
    fine = rows.where("fine")
    out = join_hot(fine.select("vec_id", "embedding"), known, ["embedding"], "weight", fine.count()).select("vec_id", "n_links", "c")
    out = out.union(rows.where("not fine").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("c").alias("component_id"),
        F.when(F.col("vec_id").isNull(), F.col("c").isNull()).otherwise(F.col("vec_id") == F.col("c")).alias("kept"),
    )
