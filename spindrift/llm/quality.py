"""Quality rules for texts, applied as a cascade that stops at the first rule that rejects.

The base figures (words, symbols, repeated lines and words) are computed for every text. The
other rules run in an order found on a sample: each rule's cost is timed and its rejections are
counted there, and rules with more rejections per second come first. A text is kept if no rule
rejects it, so the order, and with it the sample, changes the time alone, never the verdict.
"""

from __future__ import annotations

import time
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import executors_can_import, text_slices

#: Texts on which the rules' order is found, and the share of rows that they are drawn from.
SAMPLE_ROWS, SAMPLE_SHARE = 400, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•")
ELLIPSES = ("...", "…")
_WHITE = " \t\n\x0b\x0c\r"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: 0 no letter, 1 letter, 3 upper-case letter."""
    kinds = {"Lu": 3, "Ll": 1, "Lt": 1, "Lm": 1, "Lo": 1}
    return np.fromiter((kinds.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)), np.uint8, 0x110000)


class Text:
    """One text; what rules share is computed once, when a rule first asks."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.words = self.text.encode("utf-8", "surrogatepass").split()  # splits at these six characters
        self.n_words = len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [line for line in self.text.split("\n") if line.strip(_WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def numbers(self) -> np.ndarray:
        """The words, numbered by first appearance."""
        known: dict[bytes, int] = {}
        return np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that the text has twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        a, k = self.numbers, int(self.numbers.max()) + 1
        pairs = a[:-1] * k + a[1:]
        if k >= 1 << 20:  # keeps the next product within 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * k + a[2:]
        order = windows.argsort(kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if not same.any():
            return 0
        found = np.zeros(n, bool)
        starts = np.concatenate((order[1:][same], order[:-1][same]))
        for i in range(3):
            found[starts + i] = True
        return int(found.sum())

    @cached_property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")

    @cached_property
    def letters(self) -> np.ndarray:
        return _letters()[self.codes]

    @cached_property
    def n_letter_words(self) -> int:
        """Words with a letter."""
        codes = self.codes
        white = (codes == 32) | ((codes >= 9) & (codes <= 13))
        word_of = np.cumsum(white)  # constant within a word
        with_letter = word_of[self.letters > 0]
        return int((np.diff(with_letter) > 0).sum()) + bool(len(with_letter))

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


#: Each says whether it rejects a text; all compare whole numbers.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word length": lambda t: not 2 * t.n_words <= t.word_chars <= 12 * t.n_words,
    "repeated lines": lambda t: 100 * t.n_dup_lines > 50 * len(t.lines),
    "capitals": lambda t: 100 * int((t.letters == 3).sum()) > 40 * int((t.letters > 0).sum()),
    "words without letters": lambda t: 100 * t.n_letter_words < 60 * t.n_words,
    "one word": lambda t: 100 * max(Counter(t.words).values(), default=0) > 30 * t.n_words,
    "bullets": lambda t: 100 * sum(line.lstrip(_WHITE).startswith(BULLETS) for line in t.lines) > 90 * len(t.lines),
    "ellipses": lambda t: 100 * sum(line.rstrip(_WHITE).endswith(ELLIPSES) for line in t.lines) > 30 * len(t.lines),
}


def sample_texts(docs: DataFrame) -> list[str | None]:
    """At most ``SAMPLE_ROWS`` texts, drawn from the first partitions that have so many; the first rows of a small table."""
    rows = docs.select("text")
    drawn = rows.sample(SAMPLE_SHARE, seed=7).take(SAMPLE_ROWS)
    return [row.text for row in (drawn if len(drawn) == SAMPLE_ROWS else rows.take(SAMPLE_ROWS))]


def order_rules(texts: list[str | None]) -> list[str]:
    """The rules' names by rejections per second over ``texts``, the most first; by cost where none rejects."""
    _letters()
    seconds, rejected = Counter(), Counter()
    for text in texts:
        for name, rule in RULES.items():
            fresh = Text(text)
            began = time.perf_counter()
            rejected[name] += rule(fresh)
            seconds[name] += time.perf_counter() - began
    return sorted(RULES, key=lambda name: (-rejected[name] / max(seconds[name], 1e-9), seconds[name]))


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text) with its figures and verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    Null texts count as empty and fail the base rules, as does any text of under 50 words. Rows
    of equal or null doc_id are judged one by one, texts of any length whole; other columns are
    left out, and an empty table gives an empty one. Without ``order``, ``sample_texts`` give it.
    """
    executors_can_import(docs.sparkSession)
    order = order or order_rules(sample_texts(docs))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [RULES[name] for name in order]
        for batch in text_slices(batches, 16 << 20):
            figures, failed, kept = [], [], []
            for text in batch.column("text"):
                t = Text(text.as_py())
                figures.append([getattr(t, name) for name in names])
                failed.append(t.base_failed)
                kept.append(not t.base_failed and not any(rule(t) for rule in rules))
            columns = np.array(figures, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=["doc_id", *names, "base_failed", "kept"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(judged, "doc_id bigint, " + "".join(f"{n} bigint, " for n in names) + "base_failed boolean, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with all their columns; rows are judged by themselves.

    Here the verdict is all that is asked, so the base rules stand first in the cascade and no
    figure is computed that a decision doesn't need.
    """
    executors_can_import(docs.sparkSession)
    order = order_rules(sample_texts(docs))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [RULES[name] for name in order]
        for batch in text_slices(batches, 16 << 20, at):
            keep = []
            for text in batch.column(at):
                t = Text(text.as_py())
                keep.append(t.n_words >= MIN_WORDS and not any(rule(t) for rule in rules) and not t.base_failed)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (
    SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM docs),
numbered AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
windows AS (
    SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(i, 2) OVER o AS last FROM numbered WINDOW o AS (PARTITION BY r ORDER BY i)),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM windows WHERE last IS NOT NULL),
repeated AS (SELECT r, count(DISTINCT i + d) AS n FROM counted, (VALUES (0), (1), (2)) AS t(d) WHERE n > 1 GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, w, count(*) AS n FROM numbered GROUP BY r, w) GROUP BY r),
figures AS (
    SELECT l.r, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(top.n, 0) AS n_top,
        length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS n_letters,
        len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
        len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
    FROM listed l LEFT JOIN repeated USING (r) LEFT JOIN top USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * n_dup_lines > 50 * n_lines
        OR 100 * n_upper > 40 * n_letters OR 100 * n_letter_words < 60 * n_words OR 100 * n_top > 30 * n_words
        OR 100 * n_bullets > 90 * n_lines OR 100 * n_ellipses > 30 * n_lines) AS kept
FROM failed
"""
