"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Items are indexed: BM25 impacts over all items, divided by the item's score for its own text, so that a passage holding a
whole item scores 1 for it. Documents are cut into overlapping passages; every passage is a query, and all items at or
above ``THRESHOLD`` are retrieved. Postings are in item order, in blocks of ``BLOCK`` consecutive items with the block's
largest impact:

* an item's essential postings are its largest impacts, as many as it takes for the others, with two of these, to stay below
  the threshold: a passage that scores enough has three of their words. Rare words have large impacts, so essential lists are
  short; only the blocks that they lead to are looked at, whatever the size of the index;
* of these blocks, the sums of block maxima over the passage's words bound all items from above; those below the threshold are
  skipped without reading a posting (both steps are vectorised over the passages of a document);
* in the blocks left, WAND moves over the lists: the pivot is the first item at which the sorted upper bounds reach the
  threshold; items before it are never scored.

Retrieved pairs are verified: of the question (the item without its last sentence) and of the answer (the last sentence,
or the whole of a one-sentence item) at least ``OVERLAP`` of the distinct ``SHINGLE``-word shingles must be in the passage
or its neighbourhood. A shorter part is one shingle.

Statistics (document frequencies, mean length) are those of all items and counted as tables. The index is cut by hash into
shards of about ``SHARD_ITEMS`` items and ``SHARD_WORDS`` words, of one class of length each, as the passages of a shard are
twice as long as its longest item. As many shards as stay within these sizes together are sent to the tasks at once, and each
such part is one pass over the documents: one pass for up to 8,192 items, ten for 80,000. The driver holds one part at a time.

Defined results: null or wordless documents and items match nothing; repeated items are matched each; repeated documents
give repeated rows; a null id stays null; of equal scores the first passage of a document is told; very long items make the
passages of their own length class longer, very long documents take memory in proportion to their words; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, map_rows, materialise

K1, B = 1.2, 0.75
THRESHOLD = 0.7
SHINGLE = 5
OVERLAP = 0.8
BLOCK = 4
SHARD_ITEMS = 8192
#: Words of the items that are sent to the tasks at once.
SHARD_WORDS = 1_000_000
PASSAGE = 192
#: Essential words of an item that a passage must hold.
HITS = 3
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.?!])\s+")
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, start_word int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list, n: int = SHINGLE) -> set:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's words before its last sentence, and those of its last sentence (of all, if it is the only one)."""
    parts = [w for s in SENTENCE.split(text) if (w := words_of(s))]
    if len(parts) < 2:
        return [w for p in parts for w in p], [w for p in parts for w in p]
    return [w for p in parts[:-1] for w in p], parts[-1]


def _head(x: list) -> int:
    """The item a list stands at."""
    return x[1][x[0]]


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Index:
    """Blocks of impact-ordered statistics over one shard of items; ``df``, ``mean`` and ``n`` are those of all items."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float):
        self.items = sorted(((i, t) for i, t in items if words_of(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        vocabulary: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = []
        for at, (_, text) in enumerate(self.items):
            words = words_of(text)
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            raw = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in tf.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                t = vocabulary.setdefault(w, len(vocabulary))
                if t == len(lists):
                    lists.append([])
                lists[t].append((at, x / own))
        self.vocabulary = vocabulary
        blocks = max(1, -(-len(self.items) // BLOCK))
        #: for each block, term -> (items, impacts, largest impact)
        self.postings: list[dict[int, tuple[list[int], list[float], float]]] = [{} for _ in range(blocks)]
        for t, p in enumerate(lists):
            for i, x in p:
                items, impacts, top = self.postings[i // BLOCK].get(t, ([], [], 0.0))
                self.postings[i // BLOCK][t] = (items + [i], impacts + [x], max(top, x))
        # block maxima, block by block
        self.block_ends = np.cumsum([0, *(len(b) for b in self.postings)])
        self.block_terms = np.array([t for b in self.postings for t in b], np.int64)
        self.block_max = np.array([x[2] for b in self.postings for x in b.values()]) * (1 + 1e-9)
        self.parts = [tuple(shingles(p) for p in question_answer(t)) for _, t in self.items]
        self._essential: dict[float, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def essential(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items of each term's essential postings, one term after the other, where each term's begin, and how many of
        its essential words an item needs: a passage with fewer of them scores at most what the others and the largest ones
        of that many give, which is below the threshold."""
        if threshold not in self._essential:
            own: list[list[tuple[float, int]]] = [[] for _ in self.items]
            for block in self.postings:
                for t, (items, impacts, _) in block.items():
                    for i, x in zip(items, impacts):
                        own[i].append((x, t))
            found, need = [], np.ones(len(own), np.int64)
            for i, all_of in enumerate(own):
                all_of.sort(reverse=True)
                largest = np.cumsum([0.0, *(x for x, _ in all_of)])
                for hits in range(min(HITS, len(all_of)), 0, -1):
                    enough = np.flatnonzero(largest[-1] - largest + largest[hits - 1] < threshold - 1e-9)
                    if len(enough) or hits == 1:
                        need[i] = hits
                        found += [(t, i) for _, t in all_of[: enough[0] if len(enough) else len(all_of)]]
                        break
            found.sort()
            ends = np.searchsorted(np.array([t for t, _ in found], np.int64), np.arange(len(self.vocabulary) + 1))
            self._essential[threshold] = np.array([i for _, i in found], np.int64), ends, need
        return self._essential[threshold]

    def live(self, terms: np.ndarray, starts: np.ndarray, threshold: float) -> np.ndarray:
        """(passage, block) pairs whose bound reaches the threshold. ``terms``: the distinct terms of each passage in order, one
        passage after the other, from ``starts`` on. Bounds are summed in slices, so that memory doesn't follow the batch."""
        items, ends, need = self.essential(threshold)
        passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
        count = ends[terms + 1] - ends[terms]
        lead = np.repeat(passage, count) * len(need) + items[_spans(ends[terms], count)]
        lead.sort()
        first = np.flatnonzero(np.append(True, lead[1:] != lead[:-1])) if len(lead) else lead
        lead, hits = lead[first], np.diff(np.append(first, len(lead)))
        lead = lead[hits >= need[lead % len(need)]]
        pairs = np.unique(lead // len(need) * len(self.postings) + lead % len(need) // BLOCK)
        if not len(pairs):
            return np.zeros((0, 2), np.int64)
        p, k = pairs // len(self.postings), pairs % len(self.postings)
        known = passage * len(self.vocabulary) + terms
        out = []
        for a in range(0, len(p), 4096):
            first, size = self.block_ends[k[a : a + 4096]], np.diff(self.block_ends)[k[a : a + 4096]]
            at = _spans(first, size)
            key = np.repeat(p[a : a + 4096], size) * len(self.vocabulary) + self.block_terms[at]
            where = np.searchsorted(known, key)
            hit = known[np.minimum(where, len(known) - 1)] == key
            bound = np.add.reduceat(np.where(hit, self.block_max[at], 0.0), np.cumsum(size) - size)
            out.append(np.flatnonzero(bound >= threshold) + a)
        found = np.concatenate(out)
        return np.stack([p[found], k[found]], 1)

    def wand(self, terms: list[int], block: int, threshold: float) -> Iterator[tuple[int, float]]:
        """Items of one block scoring at least ``threshold`` for the query ``terms``."""
        get = self.postings[block].get
        lists = [[0, *p] for t in terms if (p := get(t))]  # [position, items, impacts, largest impact]
        while lists:
            lists.sort(key=_head)
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[3]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return
            item = _head(lists[pivot])
            if _head(lists[0]) == item:
                score = 0.0
                for x in lists:
                    if _head(x) != item:
                        break
                    score += x[2][x[0]]
                    x[0] += 1
                if score >= threshold:
                    yield item, score
            else:
                for x in lists[:pivot]:
                    x[0] = bisect_left(x[1], item, x[0])
            lists = [x for x in lists if x[0] < len(x[1])]

    def verify(self, item: int, words: list[str]) -> tuple[float, float]:
        """Shares of the question's and of the answer's shingles among those of ``words``."""
        found = shingles(words)
        ends = {len(s) for part in self.parts[item] for s in part} - {SHINGLE}
        for n in ends:  # parts shorter than a shingle
            found |= shingles(words, n)
        return tuple(len(part & found) / len(part) for part in self.parts[item])


class Matcher:
    """Cuts documents into passages and queries a shard with all of them."""

    def __init__(self, index: Index, threshold: float, overlap: float):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        longest = max((len(words_of(t)) for _, t in index.items), default=1)
        self.size = max(PASSAGE, 2 * longest)
        self.step = self.size - longest  # an item's words are whole in one passage

    def __call__(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """``(item id, score, question overlap, answer overlap, first word)`` of the best passage for each leaked item."""
        index = self.index
        words = words_of(text)
        get = index.vocabulary.get
        code = np.array([get(w, -1) for w in words], np.int64)
        place = np.flatnonzero(code >= 0)
        if not len(place):
            return []
        term, size, step = code[place], self.size, self.step
        # each word is in one or more passages [k * step, k * step + size)
        last = place // step
        keys = []
        v = np.int64(len(index.vocabulary))
        for back in range(-(-size // step)):
            k = last - back
            ok = (k >= 0) & (place < k * step + size)
            keys.append(k[ok] * v + term[ok])
        keys = np.unique(np.concatenate(keys))
        passage, terms = keys // v, keys % v
        starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        ends = np.append(starts[1:], len(terms))
        best: dict[int, tuple] = {}
        for p, block in index.live(terms, starts, self.threshold).tolist():
            first = int(passage[starts[p]]) * step
            for item, score in index.wand(terms[starts[p] : ends[p]].tolist(), block, self.threshold):
                around = words[max(0, first - step) : first + size + step]
                q, a = index.verify(item, around)
                if q >= self.overlap and a >= self.overlap and (item not in best or score > best[item][1]):
                    best[item] = (index.items[item][0], float(score), q, a, first)
        return [best[i] for i in sorted(best)]


def _length_class(n: Column) -> Column:
    return F.when(n <= PASSAGE // 2, F.lit(0)).otherwise(F.ceil(F.log2(n / F.lit(PASSAGE / 2)))).cast("int")


def _parts(shards: list) -> list[list[int]]:
    """Shards (rows of ``shard``, ``items``, ``words``) in parts that are sent to the tasks at once."""
    out, items, words = [], 0, 0
    for r in shards:
        if not out or items + r["items"] > SHARD_ITEMS or words + r["words"] > SHARD_WORDS:
            out.append([])
            items = words = 0
        out[-1].append(r["shard"])
        items, words = items + r["items"], words + r["words"]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that the document holds."""
    spark = docs.sparkSession

    def counted():
        def each(row):
            words = words_of(row[1])
            if words:
                yield *row, len(words), sorted(set(words))

        return each

    items = map_rows(benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col)), counted, "item_id long, text string, n long, words array<string>", size=256)
    items = materialise(items.withColumn("class", _length_class(F.col("n"))), "leak-items")
    classes = items.groupBy("class").agg(F.count("*").alias("items"), F.sum("n").alias("words")).collect()  # a row a doubling of length
    if not classes:
        return spark.createDataFrame([], SCHEMA)
    n, mean = sum(r["items"] for r in classes), sum(r["words"] for r in classes) / sum(r["items"] for r in classes)
    cuts = {r["class"]: max(1, -(-r["items"] // SHARD_ITEMS), -(-r["words"] // SHARD_WORDS)) for r in classes}
    cuts = {c: k if k == 1 else -(-k * 5 // 4) for c, k in cuts.items()}  # shards by hash aren't quite equal
    cut = F.create_map(*[F.lit(x) for c, k in cuts.items() for x in (c, k)])[F.col("class")]
    items = items.withColumn("shard", F.concat_ws(":", "class", F.pmod(F.xxhash64("item_id", "text"), cut)))
    df = items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = items.select("shard", F.explode("words").alias("word")).distinct().join(df, "word")
    df, items = materialise(df, "leak-frequencies"), materialise(items.select("shard", "item_id", "text", "n"), "leak-shards")
    shards = items.groupBy("shard").agg(F.count("*").alias("items"), F.sum("n").alias("words")).orderBy("shard").collect()  # a row a shard
    rows, parts = docs.select(F.col(id_col).cast("long"), F.col(text_col)), _parts(shards)
    found = []
    for part in parts:
        held: dict[str, tuple[list, dict]] = {s: ([], {}) for s in part}  # of the sizes checked by _parts
        for r in items.where(F.col("shard").isin(part)).collect():
            held[r.shard][0].append((r.item_id, r.text))
        for r in df.where(F.col("shard").isin(part)).collect():
            held[r.shard][1][r.word] = r.df
        sent = spark.sparkContext.broadcast(list(held.values()))

        def make(sent=sent):
            matchers = [Matcher(Index(own, words, n, mean), threshold, overlap) for own, words in sent.value]
            return lambda row: ((row[0], *x) for matcher in matchers for x in matcher(row[1]))

        out = map_rows(rows, make, SCHEMA)
        if len(parts) > 1:  # one part in memory at a time
            out = materialise(out, "leaks-found")
            sent.destroy()
        found.append(out)
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item."""
    leaks = materialise(find_leaks(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct(), "leaks")
    return docs.join(checked_broadcast(leaks), id_col, "left_anti").select(*docs.columns)
