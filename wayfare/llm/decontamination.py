"""Benchmark decontamination: a BM25 inverted index of the test items, walked with block-max WAND.

Every training passage is a query. All items scoring above the threshold are retrieved, and each is
verified by the overlap of its question and its answer with the text around the passage.

A unit's commoner terms can't reach the threshold without its rarer, essential ones; passages whose
essential terms leave every unit below the threshold are told apart by array arithmetic over the
whole document, and only the others walk the postings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import short_batches

EDGES = ".,;:!?\"'()[]{}<>|*#$%&@~`^_+=/\\-"
CACHE_WORDS = 300_000
HIT = "item_id long, score double, question_overlap double, answer_overlap double"


def normal_words(text: str | None) -> list[str]:
    """Lower-case words without outer punctuation."""
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The answer is the last sentence, or the last quarter of the words of a single sentence."""
    raw = (text or "").lower().split()
    ends = [i + 1 for i, w in enumerate(raw[:-1]) if w[-1] in ".?!:"]
    cut = ends[-1] if ends else len(raw) - max(1, len(raw) // 4)
    return normal_words(" ".join(raw[:cut])), normal_words(" ".join(raw[cut:]))


def shingles(words: list[str], width: int = 5) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@dataclass
class Index:
    """Impacts are BM25 weights divided by the score of the unit with itself, so that one threshold
    serves all units; a unit is a stretch of an item no longer than a passage."""

    terms: dict[str, int]
    units: list[int]  # unit -> item
    ids: list
    shingle_sets: list[tuple[set, set]]
    sizes: list[int]
    postings: list[np.ndarray]
    impacts: list[np.ndarray]
    block_max: list[np.ndarray]
    most: np.ndarray  # by term; 0 for no term
    block: int
    essential: tuple[np.ndarray, np.ndarray, np.ndarray]  # by term: first, then units and impacts
    rest: float  # no unit's other terms weigh more


REST = 0.4


class _Codes(dict):
    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = code = self.terms.get(word.strip(EDGES), 0)
        return code


def build_index(items: list[tuple[int, str]], df: dict[str, int], n_units: int, mean: float, window: int, block: int = 16) -> Index:
    terms: dict[str, int] = {}
    lists: list[list[tuple[int, float]]] = [[]]
    units, ids, sets, sizes = [], [], [], []
    essential: list[list[tuple[int, float]]] = [[]]
    k1, b = 1.2, 0.75
    for item_id, text in items:
        question, answer = question_and_answer(text)
        words = question + answer
        if not words:
            continue
        ids.append(item_id)
        sets.append((shingles(question), shingles(answer)))
        sizes.append(len(words))
        for part in split_units(words, 2 * window // 3):
            counts: dict[str, int] = {}
            for w in part:
                counts[w] = counts.get(w, 0) + 1
            own = {
                w: float(np.log1p((n_units - df[w] + 0.5) / (df[w] + 0.5))) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(part) / mean))
                for w, c in counts.items()
            }
            whole = sum(own.values())
            for w, x in own.items():
                if w not in terms:
                    terms[w] = len(lists)
                    lists.append([])
                    essential.append([])
                lists[terms[w]].append((len(units), x / whole))
            left = 1.0
            for w in sorted(own, key=lambda w: (df[w], w)):
                if left <= REST:
                    break
                left -= own[w] / whole
                essential[terms[w]].append((len(units), own[w] / whole))
            units.append(len(ids) - 1)
    postings = [np.array([u for u, _ in x], dtype=np.int64) for x in lists]
    impacts = [np.array([s for _, s in x]) for x in lists]
    tops = [np.array([x[i : i + block].max() for i in range(0, len(x), block)]) for x in impacts]
    most = np.array([x.max() if len(x) else 0.0 for x in impacts])
    first = np.concatenate([[0], np.cumsum([len(x) for x in essential])])
    flat = [e for x in essential for e in x]
    must = (first, np.array([u for u, _ in flat], dtype=np.int64), np.array([x for _, x in flat]))
    return Index(terms, units, ids, sets, sizes, postings, impacts, tops, most, block, must, REST)


def split_units(words: list[str], window: int) -> list[list[str]]:
    n = max(1, -(-len(words) // window))
    step = -(-len(words) // n)
    return [words[i : i + step] for i in range(0, len(words), step)]


def block_max_wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (unit, score) with score >= threshold for distinct query terms, by document-at-a-time
    traversal that skips where list maxima, then block maxima, can't reach the threshold."""
    at = {t: 0 for t in query}
    found = []
    threshold -= 1e-12
    live = [(int(index.postings[t][0]), t) for t in query if len(index.postings[t])]
    while live:
        live.sort()
        total, pivot = 0.0, -1
        for k, (_, t) in enumerate(live):
            total += index.most[t]
            if total >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        unit = live[pivot][0]
        while pivot + 1 < len(live) and live[pivot + 1][0] == unit:
            pivot += 1
        ahead = live[: pivot + 1]
        reach = 0.0
        for _, t in ahead:
            p = at[t] + int(np.searchsorted(index.postings[t][at[t] :], unit))
            if p < len(index.postings[t]):
                reach += index.block_max[t][p // index.block]
        if reach >= threshold and ahead[0][0] == unit:
            score = sum(float(index.impacts[t][at[t]]) for _, t in ahead)
            if score >= threshold:
                found.append((unit, score))
            to = unit + 1
        elif reach >= threshold:
            to = unit
        else:
            to = unit + 1
        moved = []
        for u, t in ahead:
            if u < to:
                at[t] += int(np.searchsorted(index.postings[t][at[t] :], to))
                if at[t] < len(index.postings[t]):
                    moved.append((int(index.postings[t][at[t]]), t))
            else:
                moved.append((u, t))
        live = moved + live[pivot + 1 :]
    return found


def _passages(index: Index, codes: np.ndarray, stride: int, per: int, threshold: float) -> np.ndarray:
    """Numbers of the passages (`per` strides each, one from every stride on) in which the essential
    terms of some unit weigh enough."""
    first, units, weights = index.essential
    at = np.flatnonzero(first[codes + 1] > first[codes])
    sizes = first[codes[at] + 1] - first[codes[at]]
    flat = np.arange(sizes.sum()) + np.repeat(first[codes[at]] - (np.cumsum(sizes) - sizes), sizes)
    n = len(codes) // stride + per + 1
    key, place = np.unique(units[flat] * n + np.repeat(at // stride, sizes) + per, return_inverse=True)
    sums = np.bincount(place, weights[flat], minlength=len(key))
    shifted = np.concatenate([key - i for i in range(per)])
    passage, place = np.unique(shifted, return_inverse=True)
    total = np.bincount(place, np.tile(sums, per), minlength=len(passage))
    hit = np.unique(passage[total >= threshold - index.rest - 1e-9] % n) - per
    return np.unique(np.maximum(hit, 0))


def leaks(index: Index, codes_of: _Codes, text: str | None, window: int, threshold: float, overlap: float) -> list[dict]:
    """Items that the text holds, one entry each, the best passage's score."""
    raw = (text or "").lower().split()
    if not raw or not index.units:
        return []
    codes = np.fromiter(map(codes_of.__getitem__, raw), dtype=np.int64, count=len(raw))
    stride = window // 3
    best: dict[int, dict] = {}
    for k in _passages(index, codes, stride, 3, threshold).tolist():
        start, end = k * stride, min(k * stride + 3 * stride, len(raw))
        own = codes[start:end]
        query = np.unique(own[own > 0])
        for unit, score in block_max_wand(index, query.tolist(), threshold):
            item = index.units[unit]
            if item in best:
                best[item]["score"] = max(best[item]["score"], score)
                continue
            size = index.sizes[item] + window
            held = shingles(normal_words(" ".join(raw[max(0, start - size) : end + size])))
            question, answer = index.shingle_sets[item]
            shared = [len(s & held) if len(next(iter(s), ())) == 5 else sum(_inside(x, raw) for x in s) for s in (question, answer)]
            if sum(shared) >= overlap * (len(question) + len(answer)) - 1e-9 and shared[1] + (not answer) > 0:
                best[item] = {
                    "item_id": index.ids[item],
                    "score": score,
                    "question_overlap": shared[0] / max(1, len(question)),
                    "answer_overlap": shared[1] / max(1, len(answer)),
                }
    by_id: dict[int, dict] = {}
    for hit in best.values():  # an id of several texts is found by the best of them
        by_id[hit["item_id"]] = max(by_id.get(hit["item_id"], hit), hit, key=lambda x: (x["score"], x["question_overlap"], x["answer_overlap"]))
    return sorted(by_id.values(), key=lambda x: x["item_id"])


def _inside(part: tuple[str, ...], raw: list[str]) -> bool:
    """Whether the words stand next to each other in raw: for stretches shorter than a shingle."""
    words = normal_words(" ".join(raw))
    return any(tuple(words[i : i + len(part)]) == part for i in range(len(words) - len(part) + 1))


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = 96, threshold: float = 0.6, overlap: float = 0.8, index_bytes: int = 16 << 20
) -> DataFrame:
    """docs plus leaks: array of (item_id, score, question_overlap, answer_overlap).

    A passage is `window` words, one from every third of a window on; a unit has two thirds of a
    window at most, so some passage holds all of it. An item leaks into a document if a passage
    scores at least `threshold` of the item's score with itself and the text around it holds `overlap`
    of the item's 5-word shingles, one of its answer's among them. The index is built and sent in
    blocks of at most about index_bytes of item text, each of which meets all documents; document
    frequencies and mean length are counted over all items. Null or empty items leak nowhere, null or
    empty texts hold nothing, repeated items count once, an id with several texts
    leaks if one of them does; extra columns are kept, leaks replaced."""
    short_batches(docs.sparkSession)
    docs = docs.drop("leaks")
    items = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // index_bytes))

    def unit_words(batches):
        for batch in batches:
            found, sizes = [], []
            for text in batch["text"]:
                question, answer = question_and_answer(text)
                for part in split_units(question + answer, 2 * window // 3) if question + answer else []:
                    found.append(sorted(set(part)))
                    sizes.append(len(part))
            yield pd.DataFrame({"words": found, "size": sizes})

    units = items.select("text").mapInPandas(unit_words, "words array<string>, size long")
    n_units, mean = units.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(1.0))).first()
    counts = units.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    name = "leaks"
    out = docs.withColumn(name, F.array().cast(f"array<struct<{HIT.replace(' ', ':')}>>".replace(",:", ",")))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        words = own.select("text").mapInPandas(unit_words, "words array<string>, size long").select(F.explode("words").alias("word"))
        df = dict(counts.join(words.distinct(), "word", "left_semi").collect())  # bounded by the block's text
        index = build_index([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()], df, n_units, mean, window)
        out = out.withColumn(name, F.concat(name, _search(index, window, threshold, overlap)(F.col("text"))))
    return out


def _search(index: Index, window: int, threshold: float, overlap: float):
    @F.pandas_udf(f"array<struct<{HIT.replace(' ', ':')}>>".replace(",:", ","))
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = _Codes(index.terms)
        for texts in batches:
            yield pd.Series([leaks(index, codes, t, window, threshold, overlap) for t in texts], dtype=object)

    return search
