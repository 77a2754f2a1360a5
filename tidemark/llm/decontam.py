"""Benchmark decontamination: BM25 with block-max WAND, then exact overlap.

The test items form an inverted index: per term, postings in ascending item
order, cut into blocks of ``BLOCK`` items that store their largest impact.
Impacts are BM25 weights divided by the item's own retrieval threshold, so
"all items above threshold" is one bound, 1, for every item.

Every document is read as overlapping passages, and each passage is a
query. The terms of a passage first give a bound for each block of items
(the sum of the blocks' largest impacts, less what an item's most common
terms can add, which is set against its threshold beforehand); passages
with no block at 1 are done. The rest run block-max WAND: cursors by item,
a pivot where the terms' largest impacts reach 1, the block bound checked
before any item is scored. Items found are verified on the whole document:
the five-word shingles of the question, and the words of the answer.

Items are few; if they are many, they are dealt to parts of bounded size
and each part is one pass over the documents, with counts over all items.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import word_bytes

#: Words of a passage, and how far apart passages start.
PASSAGE, STRIDE = 128, 64
#: Share of five-word shingles of the question, and of the answer's words.
QUESTION_OVERLAP, ANSWER_OVERLAP, SHINGLE = 0.8, 0.5, 5
K1, B = 1.2, 0.75
BLOCK = 4
#: Sums of strides and blocks that a text has at once.
SUMS = 4_000_000
#: Items up to which one index is sent to the tasks, and bytes of their texts.
PART_ITEMS, PART_BYTES = 20_000, 32 << 20
_SENTENCE_END = re.compile(r"[.!?:]\s+(?=\S)|\n+")


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence or line is the answer, what precedes it the
    question. Where that leaves under five words, or under half of them, to
    the question, the whole item is the question."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text.rstrip())]
    if ends:
        question, answer = text[: ends[-1]], text[ends[-1] :]
        n = len(word_bytes(question))
        if n >= max(SHINGLE, len(word_bytes(answer))):
            return question, answer
    return text, ""


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """All runs of n words; a shorter list is one run."""
    if not words:
        return set()
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n))))


class BlockMaxIndex:
    """BM25 inverted index of test items, with block-max WAND retrieval."""

    def __init__(self, items: list[tuple], df: dict[bytes, int], n_items: int, mean_words: float):
        """items: (id, text). df, n_items, mean_words: over all test items."""
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t or "") for _, t in items]
        tokens = [word_bytes(t) for _, t in items]
        idf = lambda t: np.log1p((n_items - df.get(t, 1) + 0.5) / (df.get(t, 1) + 0.5))
        raw: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.common = common = {t for t, n in df.items() if n > max(3, n_items / 20)}
        for i, words in enumerate(tokens):
            if not words:
                continue
            weight = {t: float(idf(t)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words)) for t, tf in Counter(words).items()}
            theta = self._threshold(i, weight)
            for t, w in weight.items():
                raw[t].append((i, w / theta))
        self.postings = {t: ([i for i, _ in p], [w for _, w in p]) for t, p in raw.items()}
        self.most = {t: max(w) for t, (_, w) in self.postings.items()}
        self.block_most = {t: {} for t in self.postings}
        for t, (at, ws) in self.postings.items():
            for i, w in zip(at, ws):
                b = self.block_most[t]
                b[i // BLOCK] = max(b.get(i // BLOCK, 0.0), w)
        # The first filter leaves out common terms: what they can add to an
        # item is known, so the rare ones must reach the rest of its threshold.
        spare = np.ones(len(items))
        for t in common & self.postings.keys():
            for i, w in zip(*self.postings[t]):
                spare[i] -= w
        self.always = {i // BLOCK for i in np.flatnonzero(spare <= 0) if tokens[i]}
        self.n_blocks = max(1, -(-len(items) // BLOCK))
        self.term_id, starts, blocks, bounds = {}, [0], [], []
        for t in sorted(self.postings.keys() - common):
            best: dict[int, float] = {}
            for i, w in zip(*self.postings[t]):
                if spare[i] > 0:
                    best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), w / spare[i])
            self.term_id[t] = len(self.term_id)
            blocks += best.keys()
            bounds += best.values()
            starts.append(len(blocks))
        self.starts = np.array(starts)
        self.blocks, self.bounds = np.array(blocks, dtype=np.int64), np.array(bounds)

    def _threshold(self, item: int, weight: dict[bytes, float]) -> float:
        """A score that every passage reaches whose question overlap suffices.

        Missing words cost a shingle each at least, so no more than the
        allowed share of the question's words is missing: take the
        heaviest away. A passage holds a stride's part of a longer item.
        """
        words = word_bytes(self.parts[item][0]) or word_bytes(self.parts[item][1])
        runs = max(1, len(words) - SHINGLE + 1)
        missing = int((1 - QUESTION_OVERLAP) * runs + 1e-9)
        weights = sorted((weight[t] for t in set(words)), reverse=True)
        return 0.999 * sum(weights[missing:]) * min(1.0, STRIDE / len(words))

    def candidate_passages(self, words: list[bytes]) -> list[int]:
        """Passages (by stride) in which some block of items may reach its bound."""
        n = max(1, -(-len(words) // STRIDE))
        if self.always:
            return list(range(n))
        at = [(i, k) for i, k in enumerate(map(self.term_id.get, words)) if k is not None]
        if not at:
            return []
        place, term = np.array(at).T
        # Distinct terms of a stride; a passage is two strides.
        key = np.unique(place // STRIDE * len(self.term_id) + term)
        stride, term = key // len(self.term_id), key % len(self.term_id)
        found: list[int] = []
        # Some strides at a time, so that a long text's sums stay small.
        span = max(1, SUMS // self.n_blocks - 1)
        for a in range(0, n, span):
            lo, hi = np.searchsorted(stride, (a, a + span + 1))
            if lo == hi:
                continue
            s, t, rows = stride[lo:hi] - a, term[lo:hi], min(span, n - a)
            counts = self.starts[t + 1] - self.starts[t]
            flat = np.repeat(self.starts[t] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            sums = np.bincount(np.repeat(s, counts) * self.n_blocks + self.blocks[flat], self.bounds[flat], (rows + 1) * self.n_blocks).reshape(rows + 1, -1)
            both = sums[:-1] + sums[1:]
            found += (a + np.flatnonzero((both >= 1 - 1e-9).any(axis=1))).tolist()
        return found

    def search(self, words: Iterable[bytes]) -> list[int]:
        """Block-max WAND: every item whose impacts over the distinct words sum to 1."""
        lists = [[self.postings[t], 0, t] for t in set(words) if t in self.postings]
        found = []
        bound = 1 - 1e-9
        while True:
            lists = [x for x in lists if x[1] < len(x[0][0])]
            lists.sort(key=lambda x: x[0][0][x[1]])
            total, pivot = 0.0, None
            for k, x in enumerate(lists):
                total += self.most[x[2]]
                if total >= bound:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = lists[pivot][0][0][lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][0][lists[pivot + 1][1]] == item:
                pivot += 1
            block = item // BLOCK
            ceiling = sum(self.block_most[x[2]].get(block, 0.0) for x in lists[: pivot + 1])
            if ceiling < bound:
                # No item up to the block's end, or before the next list starts, can reach it.
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0][0][lists[pivot + 1][1]])
                goal = max(goal, item + 1)
            elif lists[0][0][0][lists[0][1]] == item:
                score = sum(x[0][1][x[1]] for x in lists[: pivot + 1])
                if score >= bound:
                    found.append(item)
                goal = item + 1
            else:
                goal = item
            for x in lists[: pivot + 1]:
                x[1] = bisect_left(x[0][0], goal, x[1])

    def verify(self, item: int, runs: set, words: set) -> tuple[float, float] | None:
        """Overlap of question and answer with what of them the document holds,
        if both suffice."""
        wanted, said = self.runs_of(item), set(word_bytes(self.parts[item][1]))
        q = len(wanted & runs) / len(wanted)
        a = len(said & words) / len(said) if said else 1.0
        return (q, a) if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP else None

    def runs_of(self, item: int) -> set[tuple[bytes, ...]]:
        """Runs of the question that are looked for; a question under five words
        is one run of its length."""
        question, answer = map(word_bytes, self.parts[item])
        return shingles(question) or shingles(answer)

    def match(self, text: str | None) -> list[tuple]:
        """(item id, question overlap, answer overlap) of all items in the text."""
        words = word_bytes(text)
        if not words:
            return []
        candidates = set(chain.from_iterable(self.search(words[p * STRIDE : p * STRIDE + PASSAGE]) for p in self.candidate_passages(words)))
        if not candidates:
            return []
        # Only what the candidates ask for is kept of the document's runs.
        wanted: dict[int, set] = defaultdict(set)
        for i in candidates:
            for run in self.runs_of(i):
                wanted[len(run)].add(run)
        runs: set = set()
        for n, own in wanted.items():
            runs |= own.intersection(zip(*(islice(words, k, None) for k in range(n))))
        distinct = set().union(*(word_bytes(self.parts[i][1]) for i in candidates)).intersection(words)
        checked = ((self.ids[i], self.verify(i, runs, distinct)) for i in sorted(candidates))
        return [(i, *v) for i, v in checked if v]


def _parts(benchmark: DataFrame) -> Iterable[tuple[list, dict, int, float]]:
    """Items in parts of bounded size, with counts over all items for their terms."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // PART_ITEMS), -(-size // PART_BYTES))
    words = items.select(F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " "))).alias("t"))
    total = items.select(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")))).first()[0] or 1
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    df = words.where("t <> ''").groupBy("t").count()
    for p in range(parts):
        mine = [(r.item_id, r.text) for r in dealt.where(F.col("part") == p).orderBy("item_id", "text").collect()]
        if not mine:
            continue
        own = {w for _, t in mine for w in word_bytes(t)}
        if parts == 1:
            counts = df
        else:
            terms = dealt.sparkSession.createDataFrame([(w.decode("utf-8", "replace"),) for w in own], "t string")
            counts = df.join(terms, "t", "left_semi")
        yield mine, {r.t.encode(): r["count"] for r in counts.collect()}, n, total / max(1, n)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a test item: doc_id, item_id, question, answer.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other
    columns are ignored. Null or empty texts match nothing, repeated rows
    each match, null ids stay, an empty benchmark gives no rows. Overlaps are
    shares from 0 to 1.
    """
    slim = docs.select("doc_id", "text")
    schema = T.StructType([slim.schema["doc_id"], T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("question", T.DoubleType()), T.StructField("answer", T.DoubleType())])
    out = None
    for part in _parts(benchmark):
        found = _over(slim, part, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _over(slim: DataFrame, part: tuple, schema: T.StructType) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(BlockMaxIndex(*part))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, index = to_arrow_schema(schema), shared.value
        for batch in batches:
            rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in index.match(text.as_py())]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return slim.mapInArrow(run, schema)


def flagged_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document (id) with leaks: its items and best overlap.

    The number of items of a document is at most that of the benchmark. Rows
    of one id, and those with a null id, are one document here.
    """
    leaks = find_leaks(docs, benchmark)
    return leaks.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("question").alias("question_overlap"), F.max("answer").alias("answer_overlap"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with the same columns."""
    schema, out = docs.schema, docs
    place = docs.columns.index("text")
    for part in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(BlockMaxIndex(*part))

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                clean = [not shared.value.match(t.as_py()) for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
