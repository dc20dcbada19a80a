"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

A solution is a set of bins. Crossover injects whole well-filled bins of one parent into another,
drops the bins that hold duplicates and best-fits the displaced pieces, longest first. Pieces are
dealt at random to blocks of bounded size; every block is evolved on several islands whose elites
migrate in a ring. Bins that stay underfilled are packed again across blocks until one block is left:
so evolution has two aims, fewer bins, and with as few the room that is left in as few of them as can
be, as only those have to be packed again."""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import short_batches, stored

CACHE_WORDS = 600_000
WORD = re.compile(r"([^\W\d_]+)((?:(?!<\|)[!-&(-/:-@\[-^`{-~])*)")  # letters, then ASCII signs but ' and _
PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TokenCache:
    """ids of a text as the tokenizer gives them, by way of its blank-separated words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words
    in turn; words are lower-cased first where that can't change what the tokenizer would do."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.bytes = {b: chr(256 + i) for i, b in enumerate(hidden)}  # how the byte level spells the others
        self._reset()

    def _reset(self):
        self.known, self.size, self.tails = {"": 0}, 0, {}
        self.starts, self.lens, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self._reset()
        known, pending, at = self.known, [], []
        for text in texts:
            if "<|" not in text and (
                text.isascii() or unicodedata.is_normalized("NFC", text) and not ("Σ" in text or "İ" in text)
            ):
                text = text.lower()
            words = text.replace("\n", " ").split(" ")
            for word in set(words).difference(known):
                known[word] = len(known)
                pending.append(word)
            at.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        self._learn(pending)
        out = []
        for index in at:
            sizes = self.lens[index]
            shift = self.starts[index] - (np.cumsum(sizes) - sizes)
            out.append(self.flat[np.arange(sizes.sum()) + np.repeat(shift, sizes)])
        return out

    def _letters(self, word: str) -> list[int]:
        """ids of a lower-case run of letters, which is one token before the model splits it."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes)
        return [t.id for t in self.model.tokenize(word)]

    def _ids(self, words: list[str]) -> list[list[int]]:
        """ids of words; letters, and letters before other signs, without the costly general way."""
        out, hard, at = [], [], []
        for word in words:
            match = WORD.fullmatch(word)
            if match and match[1].isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word) and "İ" not in word) and word == word.lower():
                ids, tail = self._letters(match[1]), match[2]
                if tail:
                    if tail not in self.tails:
                        if len(self.tails) > 50_000:
                            self.tails.clear()
                        self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
                    ids = ids + self.tails[tail]
                out.append(ids)
            else:
                at.append(len(out))
                out.append(None)
                hard.append(word)
        for i, found in zip(at, self.tokenizer.encode_batch_fast(hard, add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def _learn(self, words: list[str]):
        first = len(self.known) - len(words)
        if len(self.known) > len(self.starts):
            self.starts, self.lens = (np.resize(x, 2 * len(self.known)) for x in (self.starts, self.lens))
        for at in range(0, len(words), 4096):
            part = self._ids(words[at : at + 4096])
            sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            ids = np.fromiter((i for x in part for i in x), dtype=np.uint32, count=sizes.sum())
            if self.size + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.size + len(ids)))
            self.flat[self.size : self.size + len(ids)] = ids
            own = slice(first + at, first + at + len(part))
            self.lens[own], self.starts[own] = sizes, self.size + np.cumsum(sizes) - sizes
            self.size += len(ids)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document's ids and end_id, cut every `length`.

    A null or empty text is the single id end_id. Only doc_id and text are read."""
    short_batches(docs.sparkSession)

    def cut(batches):
        cache = TokenCache(tokenizer_path)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text").to_pylist()
            for first in range(0, len(texts), 64):
                group = [t or "" for t in texts[first : first + 64]]
                rows, doc, ids_out = [], [], []
                for i, ids in enumerate(cache.encode(group)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), length)):
                        own = ids[start : start + length]
                        rows.append((piece, start, len(own), zlib.crc32(own.tobytes())))
                        doc.append(first + i)
                        if with_ids:
                            ids_out.append(own.astype(np.int32))
                piece, start, size, crc = zip(*rows, strict=True)
                arrays = [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    fields = PIECE_FIELDS + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, fields)


def best_fit(sizes: np.ndarray, order, capacity: int, bins: np.ndarray, free: list[int]) -> None:
    """Put the pieces of order into the fullest bin that takes them, opening bins as needed: fills in
    bins (piece to bin) and free (room by bin)."""
    rooms: dict[int, list[int]] = {}
    mask = 0
    for b, room in enumerate(free):
        rooms.setdefault(room, []).append(b)
        mask |= 1 << room
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i] = b
        free[b] = room = room - size
        rooms.setdefault(room, []).append(b)
        mask |= 1 << room


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of bins, then how evenly they are filled."""
    fill = np.bincount(bins, sizes)
    return len(fill), -float((fill**2).sum()) / capacity**2


def cross(sizes, first, second, capacity, rng) -> np.ndarray:
    """A child of `second` with whole bins injected from `first`, the fuller the likelier."""
    fill = np.bincount(first, sizes) / capacity
    chosen = rng.random(len(fill)) < 0.6 * fill**8
    injected = chosen[first]
    hit = np.zeros(second.max() + 1, bool)
    hit[second[injected]] = True
    displaced = ~injected & hit[second]
    return _rebuild(sizes, [(first, injected), (second, ~injected & ~displaced)], displaced, capacity, rng)


def mutate(sizes, parent, capacity, rng) -> np.ndarray:
    """Empty the least filled bins and a few others, and best-fit what they held."""
    fill = np.bincount(parent, sizes)
    gone = rng.random(len(fill)) < 0.03
    gone[np.argsort(fill)[: max(2, len(fill) // 50)]] = True
    return _rebuild(sizes, [(parent, ~gone[parent])], gone[parent], capacity, rng)


def _rebuild(sizes, kept, displaced, capacity, rng) -> np.ndarray:
    bins, n = np.full(len(sizes), -1, np.int64), 0
    for source, own in kept:
        names, local = np.unique(source[own], return_inverse=True)
        bins[own] = n + local
        n += len(names)
    placed = bins >= 0
    free = (capacity - np.bincount(bins[placed], sizes[placed], minlength=n)).astype(int).tolist()
    loose = np.flatnonzero(displaced)
    best_fit(sizes, loose[np.argsort(-sizes[loose] + rng.random(len(loose)) * 3)], capacity, bins, free)
    return bins


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], seed: int, size: int = 4, generations: int = 6) -> list[np.ndarray]:
    """The next population, best first. It ends early only when no packing can be better: no fewer bins,
    and none but one with room left."""
    rng, least = np.random.default_rng(seed), math.ceil(sizes.sum() / capacity)
    population = list(population)
    while len(population) < size:
        bins = np.empty(len(sizes), np.int64)
        jitter = rng.random(len(sizes)) * (0 if not population else capacity / 8)
        best_fit(sizes, np.argsort(-sizes + jitter, kind="stable"), capacity, bins, [])
        population.append(bins)
    rank = lambda b: fitness(sizes, b, capacity)
    population.sort(key=rank)
    for _ in range(generations):
        fill = np.bincount(population[0], sizes)
        if len(population) < 2 or len(fill) == least and (fill < capacity).sum() <= 1:
            break
        a, b = rng.choice(len(population), 2, replace=False)
        children = [cross(sizes, population[min(a, b)], population[max(a, b)], capacity, rng), mutate(sizes, population[0], capacity, rng)]
        children.append(cross(sizes, population[max(a, b)], population[min(a, b)], capacity, rng))
        population = sorted(population + children, key=rank)[:size]
    return population


def pack(items: DataFrame, capacity: int = 2048, block_rows: int = 4096, islands: int = 2, epochs: int = 2, full: float = 0.95) -> DataFrame:
    """items(doc_id, piece, start, length, ids_crc32) plus sequence_id and offset.

    No sequence is longer than capacity; offsets are gapless from 0. Rows alike in all columns are
    separate pieces; a null id is carried along. An empty table gives no rows."""
    parts, level, rest = [], 0, stored(items.withColumn("salt", F.rand(5)), "pieces")
    left = rest.count()
    while True:
        blocks = max(1, -(-left // block_rows))
        rest = rest.withColumn("block", F.floor(F.col("salt") * blocks).cast("long"))
        placed = stored(_pack_blocks(rest, capacity, islands, epochs, level), "packed")
        rest = stored(placed.where(F.col("fill") < full * capacity).select(*items.columns, F.rand(level + 6).alias("salt")), "pieces")
        before, left = left, rest.count()
        if blocks == 1 or left > 0.9 * before:  # pieces that don't fill bins among so many others won't among fewer
            parts.append(placed)
            break
        parts.append(placed.where(F.col("fill") >= full * capacity))
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(*items.columns, "sequence_id", "offset")


def _pack_blocks(rest: DataFrame, capacity: int, islands: int, epochs: int, level: int) -> DataFrame:
    lengths = rest.groupBy("block").agg(F.sort_array(F.collect_list("length"), asc=False).alias("lengths"))
    state = stored(lengths.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))), "islands")
    state = state.withColumn("genomes", F.array().cast("array<array<int>>"))
    fields = "block long, lengths array<long>, island int, genomes array<array<int>>"
    for epoch in range(epochs):

        def grow(batches, epoch=epoch):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    sizes = np.asarray(row["lengths"], np.int64)
                    start = [np.asarray(g, np.int64) for g in row["genomes"]]
                    seed = (row["block"] * 64 + row["island"]) * 16 + epoch
                    out.append([g.tolist() for g in evolve(sizes, capacity, start, seed)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("block", "lengths", "island")), pa.array(out, pa.list_(pa.list_(pa.int32())))],
                    ["block", "lengths", "island", "genomes"],
                )

        state = stored(state.select("block", "lengths", "island", "genomes").mapInArrow(grow, fields), "islands")
        if epoch < epochs - 1:  # the elite of each island moves on to the next
            elites = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.slice("genomes", 1, 1).alias("elite"))
            state = state.join(elites, ["block", "island"]).withColumn("genomes", F.concat("genomes", "elite"))
    bins = F.size(F.array_distinct(F.element_at("genomes", 1)))
    best = state.groupBy("block").agg(F.min_by(F.element_at("genomes", 1), F.struct(bins, "island")).alias("genome"))

    def emit(own: pa.Table, solution: pa.Table) -> pa.Table:
        own = own.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        sizes, block = own.column("length").to_numpy(), own.column("block")[0].as_py()
        bins = np.asarray(solution.column("genome")[0].as_py(), np.int64)
        order = np.argsort(bins, kind="stable")
        ahead = np.cumsum(sizes[order]) - sizes[order]
        first = np.searchsorted(bins[order], np.arange(bins.max() + 1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ahead - ahead[first][bins[order]]
        fill = np.bincount(bins, sizes)[bins]
        sequence = (level << 56) + (block << 20) + bins
        return (
            own.append_column("sequence_id", pa.array(sequence))
            .append_column("offset", pa.array(offset))
            .append_column("fill", pa.array(fill, pa.float64()))
            .select([f.name for f in out_schema])
        )

    out_fields = [*rest.columns, "sequence_id", "offset", "fill"]
    out_schema = rest.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "fill": F.lit(0.0)}).select(*out_fields).schema
    return rest.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(emit, out_schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Pieces of docs with the sequence and offset of each."""
    return pack(pieces(docs, tokenizer_path, capacity), capacity)
