"""Benchmark decontamination: every passage of the corpus queries a BM25 index of test items.

The index holds the test items. A document is cut into overlapping passages, twice as long as
the longest item, so that every item copied into a document lies within some passage. Each
passage is a query; its score for an item is the BM25 weight of the item's terms that it has, as
a share of the weight of all the item's terms. All items with a score of at least ``MIN_SCORE``
are retrieved with block-max WAND (Ding and Suel, 2011): items stand in blocks, each term knows
its largest weight overall and in each block, and only where those bounds reach the threshold is
an item scored. Bounds are summed for all passages of a batch at once; what they leave is
searched item by item. A retrieved item is then verified on the passage's words: word triples of
its question and words of its answer must recur, or nearly all triples of both together.

Words are runs of letters and digits in lower case, so spacing and marks, as in formulas, code and
lists, make no difference; in scripts that are written without spaces each character is a word.

A task needs the index of all items, so items come in passes of a bounded number, each of which
reads the corpus once; a usual benchmark takes one pass. Document frequencies and lengths are
those of all items, so a pass doesn't change a score. No step shuffles documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import executors_can_import, settle, text_slices

K1, B = 1.2, 0.75
#: Share of an item's BM25 weight that a passage must have.
MIN_SCORE = 0.5
#: Shares of a question's word triples and of an answer's words that a passage must have.
MIN_QUESTION, MIN_ANSWER = 0.5, 0.5
#: Share of all word triples of an item that suffices alone, whatever became of its answer.
MIN_WHOLE = 0.8
#: Items with fewer words count only if all of both recur.
SHORT_WORDS = 8
BLOCK_ITEMS, PASS_ITEMS = 8, 20_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
_SEPARATORS = r"[^\p{L}\p{N}\p{M}]+"
#: Scripts without spaces between words.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, as a dictionary array; and where each text's words begin."""
    texts = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), _SEPARATORS, " ")
    if pc.any(pc.match_substring_regex(texts, _UNSPACED)).as_py():
        texts = pc.replace_substring_regex(texts, _UNSPACED, r" \1 ")
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = lists.flatten()
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.zeros(len(some) + 1, np.int64)
    np.cumsum(some, out=before[1:])
    words = words.filter(pa.array(some)).dictionary_encode()
    lower = pc.utf8_lower(words.dictionary).dictionary_encode()
    return pa.DictionaryArray.from_arrays(pc.take(lower.indices, words.indices), lower.dictionary), before[bounds]


def plain_words(text: str) -> list[str]:
    return split_words(pa.array([text]))[0].to_pylist()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's words up to its last sentence, and those of that sentence; a lone sentence is cut after two thirds."""
    words, bounds = split_words(pa.array(_SENTENCE.split(text), pa.string()))
    parts = [words[a:b].to_pylist() for a, b in zip(bounds, bounds[1:], strict=False) if b > a]
    if len(parts) > 1:
        return [w for words in parts[:-1] for w in words], parts[-1]
    words = parts[0] if parts else []
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


class Statistics:
    """What BM25 needs of all items: their number, mean and largest length, and in how many each term is."""

    def __init__(self, split: list[tuple[list[str], list[str]]]) -> None:
        lengths = [len(q) + len(a) for q, a in split]
        self.n, self.total, self.longest = len(split), sum(lengths), max(lengths, default=1)
        self.with_term = Counter(t for q, a in split for t in {*q, *a})


class ItemIndex:
    """Inverted index of test items with the bounds that block-max WAND needs."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None) -> None:
        split = [(item_id, *question_and_answer(text or "")) for item_id, text in items]
        split = [x for x in split if x[1] or x[2]]
        known = statistics or Statistics([x[1:] for x in split])
        self.item_ids = [x[0] for x in split]
        self.terms: dict[str, int] = {}
        number = lambda words: [self.terms.setdefault(w, len(self.terms)) for w in words]
        self.questions = [number(q) for _, q, _ in split]
        self.answers = [number(a) for _, _, a in split]
        counts = [Counter(q + a) for q, a in zip(self.questions, self.answers, strict=True)]
        lengths = [sum(c.values()) for c in counts]
        self.longest = known.longest
        average = known.total / max(1, known.n)
        idf = {t: math.log1p((known.n - n + 0.5) / (n + 0.5)) for word, t in self.terms.items() for n in [known.with_term[word]]}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, (c, length) in enumerate(zip(counts, lengths, strict=True)):
            weights = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / average)) for t, n in c.items()}
            whole = sum(weights.values())
            for t, w in weights.items():
                postings[t].append((i, w / whole))
        k = len(self.terms)
        self.most = np.array([max(w for _, w in postings[t]) for t in range(k)])
        # for each term: its blocks, one after the other, its largest weight and its postings in each
        bounds, blocks, largest, self.lists = [0], [], [], []
        for t in range(k):
            in_block: dict[int, list[tuple[int, float]]] = defaultdict(list)
            for i, w in postings[t]:
                in_block[i // BLOCK_ITEMS].append((i, w))
            blocks += in_block
            largest += [max(w for _, w in found) for found in in_block.values()]
            self.lists += in_block.values()
            bounds.append(len(blocks))
        self.bounds, self.blocks, self.largest = np.array(bounds), np.array(blocks, np.int64), np.array(largest)
        self.n_blocks = -(-len(self.item_ids) // BLOCK_ITEMS)
        self.triples = [set(zip(q, q[1:], q[2:])) or {tuple(q)} for q in self.questions]
        self.answer_words = [set(a) for a in self.answers]
        self.whole = [set(zip(w, w[1:], w[2:])) for q, a in zip(self.questions, self.answers, strict=True) for w in [q + a]]

    def retrieve(self, entries: list[int]) -> list[tuple[int, float]]:
        """Items of one block with a score of at least ``MIN_SCORE``, for a passage's terms in that block.

        Postings are walked in item order. The pivot is the first item at which the terms' largest
        weights in the block can reach the threshold; terms that stand before it skip to it.
        """
        walks = [[self.lists[e], 0, self.largest[e]] for e in entries]
        found = []
        while True:
            walks.sort(key=_item)
            bound, pivot = 0.0, None
            for walk in walks:
                bound += walk[2]
                if bound >= MIN_SCORE - 1e-9:
                    pivot = _item(walk)
                    break
            if pivot is None:
                return found
            score, left = 0.0, []
            for walk in walks:
                postings, at, _ = walk
                while at < len(postings) and postings[at][0] < pivot:
                    at += 1
                if at < len(postings) and postings[at][0] == pivot:
                    score += postings[at][1]
                    at += 1
                if at < len(postings):
                    walk[1] = at
                    left.append(walk)
            if score >= MIN_SCORE - 1e-9:
                found.append((pivot, score))
            walks = left

    def verify(self, item: int, words: list[int]) -> tuple[float, float] | None:
        """Shares of the question's word triples and of the answer's words among a passage's words, if they suffice."""
        triples, answer = self.triples[item], self.answer_words[item]
        size = len(next(iter(triples)))
        there = set(zip(*(words[i:] for i in range(size)), strict=False)) if size else {()}
        question = len(triples & there) / len(triples)
        answered = len(answer.intersection(words)) / len(answer) if answer else 1.0
        if len(self.questions[item]) + len(self.answers[item]) < SHORT_WORDS:
            enough = question == answered == 1.0
        else:
            enough = (question >= MIN_QUESTION and answered >= MIN_ANSWER) or (size == 3 and len(self.whole[item] & there) >= MIN_WHOLE * len(self.whole[item]))
        return (question, answered) if enough else None


def _item(walk: list) -> int:
    return walk[0][walk[1]][0]


def term_numbers(texts: pa.Array, index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word's term in the index, -1 if it has none; and where each text's words begin."""
    words, bounds = split_words(texts)
    known = index.terms.get
    numbers = np.fromiter((known(w, -1) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
    return numbers[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64), bounds


def leaks(texts: pa.Array, index: ItemIndex) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question share, answer share) of each item that a passage has, passage by passage."""
    numbers, bounds = term_numbers(texts, index)
    stride = index.longest
    sizes = np.diff(bounds)
    # passages of 2 * stride words, one every ``stride`` words
    passages = np.maximum(1, -(-sizes // stride) - 1)
    first = np.cumsum(passages) - passages
    at = np.flatnonzero(numbers >= 0)
    text = np.searchsorted(bounds, at, side="right") - 1
    step = (at - bounds[text]) // stride
    k = max(1, len(index.terms))
    keys = []
    for back in (0, 1):
        ok = (step - back >= 0) & (step - back < passages[text])
        keys.append((first[text[ok]] + step[ok] - back) * k + numbers[at[ok]])
    keys = np.unique(np.concatenate(keys))
    passage, term = keys // k, keys % k
    bound = np.bincount(passage, index.most[term], int(passages.sum())) if len(keys) else np.zeros(1)
    some = bound[passage] >= MIN_SCORE - 1e-9
    passage, term = passage[some], term[some]
    if not len(passage):
        return
    # bounds by block, for a bounded number of passages at a time; what is left is walked
    for low, high in _groups(passage, 1 << 16):
        p, t = passage[low:high], term[low:high]
        n = index.bounds[t + 1] - index.bounds[t]
        where = np.repeat(index.bounds[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.repeat(p - p[0], n) * index.n_blocks + index.blocks[where]
        live = np.bincount(pairs, index.largest[where]) >= MIN_SCORE - 1e-9
        left = live[pairs]
        pairs, where = pairs[left], where[left]
        order = pairs.argsort(kind="stable")
        pairs, where = pairs[order], where[order]
        cuts = np.flatnonzero(np.diff(pairs, prepend=-1, append=-1)).tolist() if len(pairs) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            found = index.retrieve(where[a:b].tolist())
            if found:
                number = int(pairs[a]) // index.n_blocks + int(p[0])
                row = int(np.searchsorted(first, number, side="right")) - 1
                begin = int(bounds[row]) + (number - int(first[row])) * stride
                words = numbers[begin : min(begin + 2 * stride, int(bounds[row + 1]))].tolist()
                for item, score in found:
                    if shares := index.verify(item, words):
                        yield row, item, score, *shares


def _groups(keys: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Slices of about ``size`` entries that don't part equal keys (sorted)."""
    low = 0
    while low < len(keys):
        high = int(np.searchsorted(keys, keys[min(low + size, len(keys) - 1)], side="left"))
        if high <= low or low + size >= len(keys):
            high = len(keys) if low + size >= len(keys) else int(np.searchsorted(keys, keys[low], side="right"))
        yield low, high
        low = high


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_share, answer_share) for each test item found in a document.

    ``docs`` (doc_id, text), ``items`` (item_id, text). Null and empty texts and items match
    nothing; items without letters and digits neither. A row of ``docs`` gives a row for each
    item found in it, so documents without any don't appear; repeated and null doc_ids are
    treated row by row. Equal items are all reported.
    """
    spark = docs.sparkSession
    executors_can_import(spark)
    found = None
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    for index in _indexes(items):
        known = spark.sparkContext.broadcast(index)  # of at most PASS_ITEMS items

        def search(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, 4 << 20):
                yield pa.RecordBatch.from_pylist(_by_text(part, known.value), _HITS)

        one = rows.mapInArrow(search, "doc_id bigint, item_id bigint, score double, question_share double, answer_share double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, score double, question_share double, answer_share double")
    return found


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_share", pa.float64()), ("answer_share", pa.float64())])


def _by_text(part: pa.RecordBatch, index: ItemIndex) -> list[dict]:
    best: dict[tuple[int, int], tuple] = {}
    for row, item, *shares in leaks(part.column("text"), index):
        best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), tuple(shares))
    ids = part.column("doc_id")
    return [{"doc_id": ids[row].as_py(), "item_id": index.item_ids[item], "score": s, "question_share": q, "answer_share": a} for (row, item), (s, q, a) in sorted(best.items())]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each item, and its length under the empty term."""
    for batch in batches:
        for text in batch.column("text").to_pylist():
            question, answer = question_and_answer(text)
            if question or answer:
                terms = ["", *{*question, *answer}]
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([len(question) + len(answer)] + [0] * (len(terms) - 1), pa.int64())], names=["term", "length"])


def _indexes(items: DataFrame) -> Iterator[ItemIndex]:
    """Indexes of at most ``PASS_ITEMS`` items each; the test set streams by in its order of ids."""
    items = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL")
    part: list[tuple[int, str]] = []
    shared: DataFrame | None = None
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if len(part) == PASS_ITEMS:
            if shared is None:
                terms = items.mapInArrow(_item_terms, "term string, length bigint")
                shared = settle(terms.groupBy("term").agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.max("length").alias("longest")), "item-terms")
            yield ItemIndex(part, _statistics(part, shared))
            part = []
        part.append((row.item_id, row.text))
    if part:
        yield ItemIndex(part, None if shared is None else _statistics(part, shared))


def _statistics(part: list[tuple[int, str]], shared: DataFrame) -> Statistics:
    """Those of all items, for the terms of one pass."""
    made = Statistics([question_and_answer(text) for _, text in part])
    own = shared.sparkSession.createDataFrame([(t,) for t in ["", *made.with_term]], "term string")
    for row in shared.join(own, "term").collect():  # the terms of a pass
        if row.term:
            made.with_term[row.term] = row.n
        else:
            made.n, made.total, made.longest = row.n, row.total, row.longest
    return made


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with all their columns; each row is judged by its own text."""
    spark = docs.sparkSession
    executors_can_import(spark)
    at, schema = docs.columns.index("text"), docs.schema
    for index in _indexes(items):
        known = spark.sparkContext.broadcast(index)  # of at most PASS_ITEMS items

        def clean(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, 4 << 20, at):
                keep = np.ones(part.num_rows, bool)
                keep[[row for row, *_ in leaks(part.column(at), known.value)]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
