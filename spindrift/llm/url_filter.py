"""URL filtering: host and path rules, and character models of accepted and rejected URLs.

Rules decide first; the longest that fits wins. All other URLs are judged by two variable-order
Markov models over bytes with Witten-Bell smoothing (Cleary and Witten, 1984; Witten and Bell,
1991): the difference of the two log-likelihoods, divided by the URL's length, is held against
a calibrated threshold.

Labels are weak: a URL whose host has a word of ``SEED_WORDS`` between dots, hyphens or digits is
an example of a rejected URL, any other of an accepted one. All distinct URLs are examples. Each
accepted one with a host is also, with its name spelled from seed words instead, a rejected one,
so that a corpus without bad hosts still has a model.

The models are tables of counts (``UrlTables``): Spark counts each byte together with the
``ORDER`` bytes before it, and all shorter strings from these. A URL's score is the sum of one
number for each of its bytes; these numbers are joined to blocks of URLs. Neither counts nor
models pass the driver, and sums of whole numbers don't depend on their order.

The threshold must not be set on words that the models know. So words and hosts are dealt to
``FOLDS`` folds; models that saw none of a fold's words and hosts score its examples, and the
threshold is the one that serves these held-out scores best. ``UrlModel.held_out`` has the share
of held-out rejected and of held-out accepted examples above it: what to expect of hosts with
words that no list has. The models that judge are then fitted on all examples.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import executors_can_import, settle, slices

#: (action, host/path)
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
SEED_WORDS = [
    "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "clickbait", "escort", "free", "gambling", "jackpot", "loan", "loans",
    "nude", "payday", "phishing", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx",
]
ORDER, FOLDS = 5, 4
#: UTF-8 bytes of URLs that one task scores at once, about; and parts of a nat in which a byte's score is counted.
BLOCK_BYTES, UNIT = 256 << 10, 1 << 32
_BETWEEN = re.compile(rb"[-.0-9]+")
#: A wrongly rejected URL counts as so many wrongly accepted ones when the threshold is set.
REJECTION_COST = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


class HostRules:
    """Finds the longest rule whose host is a URL's host or a parent of it, and whose path begins the URL's."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host[host].append((slash + path, rule, action))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, str | None, str | None] = (-1, None, None)
        while True:
            for start, rule, action in self.by_host.get(host, ()):
                if len(rule) > best[0] and path.startswith(start):
                    best = (len(rule), rule, action)
            if "." not in host:
                return best[1], best[2]
            host = host.partition(".")[2]


class MarkovModel:
    """Log-probability of a string's bytes, each after up to ``order`` bytes before it.

    A byte that followed a context is scored there, mixed with the shorter contexts by
    Witten-Bell weights; else the context's escape weight is paid and the next shorter one asked.
    """

    def __init__(self, strings: list[bytes], order: int = ORDER) -> None:
        self.order = order
        counts: dict[bytes, Counter] = defaultdict(Counter)
        for string in strings:
            padded = b"\x02" * order + string
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    counts[padded[i - k : i]][padded[i : i + 1]] += 1
        self.seen: dict[bytes, float] = {}
        self.escape: dict[bytes, float] = {}
        self.blank = math.log(1 / 256)
        for context in sorted(counts, key=len):  # shorter ones first: longer ones mix them in
            followed = counts[context]
            total, kinds = sum(followed.values()), len(followed)
            for byte, n in followed.items():
                shorter = math.exp(self._shorter(context, byte))
                self.seen[context + byte] = math.log((n + kinds * shorter) / (total + kinds))
            self.escape[context] = math.log(kinds / (total + kinds))

    def _shorter(self, context: bytes, byte: bytes) -> float:
        return self._after(context[1:], byte) if context else self.blank

    def _after(self, context: bytes, byte: bytes) -> float:
        paid = 0.0
        while True:
            known = self.seen.get(context + byte)
            if known is not None:
                return paid + known
            paid += self.escape.get(context, 0.0)
            if not context:
                return paid + self.blank
            context = context[1:]

    def log_likelihood(self, string: bytes) -> float:
        padded, k = b"\x02" * self.order + string, self.order
        return sum(self._after(padded[i - k : i], padded[i : i + 1]) for i in range(k, len(padded)))


def host_of(url: bytes) -> bytes:
    return url.partition(b"://")[2].partition(b"/")[0]


def folds_of(url: bytes) -> set[int]:
    """The folds of a URL's seed words, or else of its host."""
    host = host_of(url)
    words = {w for w in _BETWEEN.split(host) if w.decode("utf-8", "replace") in SEED_WORDS}
    return {crc32(w) % FOLDS for w in words or (host,)}


NO_FRAME = b"https://name.example/"


def seed_names() -> list[str]:
    return [*SEED_WORDS, *map("-".join, permutations(SEED_WORDS, 2))]


def spelled(frame: bytes, name: str) -> bytes:
    """A URL with ``name`` in place of the longest host label: it differs from an accepted one in its name alone."""
    scheme, _, rest = frame.partition(b"://")
    host, slash, path = rest.partition(b"/")
    return scheme + b"://" + host.replace(max(host.split(b"."), key=len), name.encode(), 1) + slash + path


def spelled_urls(frames: list[bytes]) -> list[bytes]:
    """URLs with hosts of one seed word and of each two: all names and all ``frames`` in turn, until both have been used."""
    frames, names = [x for x in frames if host_of(x)] or [NO_FRAME], seed_names()
    return [spelled(frames[k % len(frames)], names[k % len(names)]) for k in range(max(len(names), len(frames)))]


class UrlModel:
    """Two Markov models and the threshold between their classes, of examples in memory."""

    def __init__(self, accepted: list[bytes], rejected: list[bytes]) -> None:
        rejected = spelled_urls(accepted) + rejected
        good: list[float] = []
        bad: list[float] = []
        for fold in range(FOLDS):
            self._fit([x for x in accepted if fold not in folds_of(x)], [x for x in rejected if fold not in folds_of(x)])
            good += [self.score(x) for x in accepted if folds_of(x) == {fold}]
            bad += [self.score(x) for x in rejected if folds_of(x) == {fold}]
        self.threshold = calibrated(good, bad)
        share = lambda scores: sum(x > self.threshold for x in scores) / len(scores) if scores else None
        #: Shares of held-out rejected and of held-out accepted examples that the threshold rejects.
        self.held_out = share(bad), share(good)
        self._fit(accepted, rejected)

    def _fit(self, accepted: list[bytes], rejected: list[bytes]) -> None:
        self.accepted, self.rejected = MarkovModel(accepted or [b"https://"]), MarkovModel(rejected)

    def score(self, url: bytes) -> float:
        """How much likelier, in nats a byte, the URL is among rejected ones; 0 if empty."""
        return (self.rejected.log_likelihood(url) - self.accepted.log_likelihood(url)) / len(url) if url else 0.0


def calibrated(good: list[float], bad: list[float]) -> float:
    """The threshold with the least cost on held-out scores.

    In the gap that it falls in it stands nearer to the rejected side, by the same cost.
    """
    scores = np.concatenate((good, bad))
    cost = np.concatenate((np.full(len(good), REJECTION_COST / max(1, len(good))), np.full(len(bad), -1 / max(1, len(bad)))))
    order = scores.argsort()
    # threshold below the i-th score: it and all above are rejected
    above = np.append(np.cumsum(cost[order][::-1])[::-1], 0.0)
    i = int(above.argmin())
    ranked = scores[order]
    if i == 0:
        return max(0.0, float(ranked[0]) - 1e-9) if len(ranked) else 0.0
    low, high = float(ranked[i - 1]), float(ranked[min(i, len(ranked) - 1)])
    return max(0.0, low + (high - low) * REJECTION_COST / (1 + REJECTION_COST))


def model_text(url: str) -> bytes:
    """What the models see of a URL: all of it up to a query or fragment, A-Z lower-cased."""
    return url.encode("utf-8", "surrogatepass").lower().partition(b"#")[0].partition(b"?")[0]


def model_column(url: Column) -> Column:
    """``model_text`` as a string column."""
    cut = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    return F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(text: bytes) -> np.ndarray:
    """Each byte of a text with the ``ORDER`` bytes before it, as one number."""
    padded = np.frombuffer(b"\x02" * ORDER + text, np.uint8).astype(np.int64)
    found = np.zeros(len(text), np.int64)
    for k in range(ORDER + 1):
        found = (found << 8) | padded[k : k + len(text)]
    return found


ALL = FOLDS  # the model that leaves out no fold
EXAMPLE = "text binary, rejected boolean, without int"


def _numbered(accepted: DataFrame) -> DataFrame:
    """``accepted`` (text, hash, url) with ``i``, its place (from 0) by hash and url."""
    accepted = accepted.withColumn("part", F.shiftright("hash", 52))
    counts = accepted.groupBy("part").agg(F.count("*").alias("m"))
    earlier = counts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("earlier"))  # 4,096 rows at most
    place = F.row_number().over(Window.partitionBy("part").orderBy("hash", "url"))
    return accepted.withColumn("place", place).join(F.broadcast(earlier), "part").select("text", (F.col("place") - 1 + F.col("earlier")).alias("i"))


def examples_of(pages: DataFrame) -> DataFrame:
    """All examples of ``pages`` (url), settled: text, rejected, and the models (bits of ``without``) that may not see it."""
    host, _ = host_and_path(F.col("url"))
    marked = F.exists(F.split(host, "[-.0-9]+"), lambda word: word.isin(SEED_WORDS))
    urls = pages.select(F.col("url").cast("string").alias("url")).where("url IS NOT NULL").distinct()
    urls = settle(urls.select("url", model_column(F.col("url")).alias("text"), marked.alias("marked"), F.xxhash64("url").alias("hash")), "urls")
    at = F.instr("text", "://")
    frames = urls.where(~F.col("marked") & (at > 0) & (F.substring_index(F.substr(F.col("text"), at + 3), "/", 1) != "")).select("text", "hash", "url")
    n = frames.count()
    names = seed_names()
    spell = (_numbered(frames) if n else pages.sparkSession.createDataFrame([(NO_FRAME.decode(), 0)], "text string, i bigint")).select("text", F.lit(True).alias("rejected"), "i")
    rows = urls.select("text", F.col("marked").alias("rejected"), F.lit(None).cast("bigint").alias("i")).unionByName(spell)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rejected = [], []
            for text, kind, i in zip(*(batch.column(c).to_pylist() for c in ("text", "rejected", "i")), strict=True):
                text = text.encode()
                made = [text] if i is None else [spelled(text, names[k % len(names)]) for k in range(i, max(len(names), n), max(1, n))]
                texts += made
                rejected += [kind] * len(made)
            without = [sum(1 << fold for fold in folds_of(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(rejected, pa.bool_()), pa.array(without, pa.int32())], names=["text", "rejected", "without"])

    examples = settle(rows.mapInArrow(described, EXAMPLE), "examples")
    # a model without any accepted example gets one
    seen = examples.where("NOT rejected").agg(*(F.count_if(F.col("without").bitwiseAND(1 << m) == 0) for m in range(ALL + 1))).head()
    if not all(seen):
        lone = pages.sparkSession.createDataFrame([(bytearray(b"https://"), False, sum(1 << m for m in range(ALL + 1) if seen[m]))], EXAMPLE)
        examples = settle(examples.unionByName(lone), "examples")
    return examples


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a batch's examples and how often they occur, by kind and ``without``."""
    for batch in slices_of(batches):
        groups: dict[tuple[bool, int], list[np.ndarray]] = defaultdict(list)
        for text, rejected, without in zip(*(batch.column(c).to_pylist() for c in ("text", "rejected", "without")), strict=True):
            groups[rejected, without].append(windows(text))
        for (rejected, without), found in groups.items():
            window, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(window, pa.int64()), pa.array(n, pa.int64()), pa.array([rejected] * len(n), pa.bool_()), pa.array([without] * len(n), pa.int32())],
                names=["window", "n", "rejected", "without"],
            )


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (part for batch in batches for part in slices(batch, "text", BLOCK_BYTES))


def _kinds() -> list[str]:
    """Columns of counts: of accepted and rejected examples, for each model."""
    return [f"{kind}{m}" for m in range(ALL + 1) for kind in "ar"]


_BODY = (1 << 48) - 1


def _key(window: Column | str, bytes_kept: Column) -> Column:
    """The last bytes of a window and their number, as one number."""
    low = F.expr("shiftleft(1L, 8 * kept)") - 1
    return F.shiftleft(bytes_kept.cast("bigint"), 48).bitwiseOR(F.col(window).bitwiseAND(low))


class UrlTables:
    """The two Markov models of each fold and of all examples, as tables of counts; and the threshold.

    ``grams`` counts each string of 1 to ``ORDER + 1`` bytes in the windows of all examples,
    ``contexts`` what followed each of up to ``ORDER`` bytes and how many kinds of it.
    """

    def __init__(self, examples: DataFrame) -> None:
        spark = examples.sparkSession
        executors_can_import(spark)
        counted = examples.mapInArrow(_counted, "window bigint, n bigint, rejected boolean, without int")
        of = lambda kind, m: (F.col("rejected") == (kind == "r")) & (F.col("without").bitwiseAND(1 << m) == 0)
        whole = counted.groupBy("window").agg(*(F.sum(F.when(of(c[0], int(c[1:])), F.col("n")).otherwise(F.lit(0))).alias(c) for c in _kinds()))
        kept = settle(whole, "windows").withColumn("kept", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))))
        self.grams = settle(kept.withColumn("gram", _key("window", F.col("kept"))).groupBy("gram").agg(*(F.sum(c).alias(c) for c in _kinds())), "grams")
        sums = [x for c in _kinds() for x in (F.sum(c).alias(f"total_{c}"), F.count_if(F.col(c) > 0).alias(f"kinds_{c}"))]
        self.contexts = settle(self.grams.withColumn("context", _context(F.col("gram"))).groupBy("context").agg(*sums), "contexts")
        self.threshold, self.held_out = 0.0, (None, None)

    def likeness(self, found: DataFrame, models: list[int]) -> DataFrame:
        """For each of the distinct numbers ``window``: q0, q1, ..., how much likelier, in nats times ``UNIT``, each of ``models`` finds it among rejected URLs."""
        counts = [f"{kind}{m}" for m in models for kind in "ar"]
        grams = self.grams.select("gram", *counts)
        contexts = self.contexts.select("context", *(f"{x}_{c}" for c in counts for x in ("total", "kinds")))
        asked = found.withColumn("kept", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1)))).withColumn("gram", _key("window", F.col("kept")))
        asked = asked.withColumn("context", _context(F.col("gram")))
        short = F.lit(3 << 48)  # up to two bytes: tables of a fixed size at most, asked by all
        low = asked.where("kept <= 2").join(F.broadcast(grams.where(F.col("gram") < short)), "gram", "left").join(F.broadcast(contexts.where(F.col("context") < short)), "context", "left")
        high = asked.where("kept > 2").join(grams.where(F.col("gram") >= short), "gram", "left").join(contexts.where(F.col("context") >= short), "context", "left")
        stats = F.struct("kept", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in [*counts, *contexts.columns[1:]]))
        rows = low.unionByName(high).groupBy("window").agg(F.sort_array(F.collect_list(stats)).alias("by_order"))

        def log_chance(c: str) -> Column:
            mixed = lambda shorter, x: F.when(x[f"total_{c}"] > 0, (x[c] + x[f"kinds_{c}"] * shorter) / (x[f"total_{c}"] + x[f"kinds_{c}"])).otherwise(shorter)
            return F.ln(F.aggregate("by_order", F.lit(1 / 256), mixed))

        return rows.select("window", *(F.rint((log_chance(f"r{m}") - log_chance(f"a{m}")) * UNIT).cast("bigint").alias(f"q{k}") for k, m in enumerate(models)))

    def scores(self, texts: DataFrame, models: list[int]) -> DataFrame:
        """``texts`` (text binary, at: which of ``models``, ...) with ``score``: nats a byte; 0 where text is null or empty.

        Texts are dealt into blocks of about ``BLOCK_BYTES``; a block asks for each of its
        windows once, so that what all URLs have in common is no hot key.
        """
        texts = settle(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        blocks = 1 + (texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // BLOCK_BYTES
        dealt = texts.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        asked = settle(dealt.where("text IS NOT NULL").select("block", "text").groupBy("block").applyInArrow(_windows_of, "block bigint, window bigint"), "block-windows")
        likeness = self.likeness(asked.select("window").distinct(), models)
        answers = asked.join(likeness, "window")
        names = [f"q{k}" for k in range(len(models))]
        kept = [f for f in texts.schema if f.name != "row"]
        schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

        def judged(rows: pa.Table, answers: pa.Table) -> pa.Table:
            answers = answers.sort_by("window")
            known, values = answers.column("window").to_numpy(), [answers.column(c).to_numpy() for c in names]
            score = []
            for text, at in zip(rows.column("text").to_pylist(), rows.column("at").to_pylist(), strict=True):
                score.append(int(values[at][known.searchsorted(windows(text))].sum()) / UNIT / len(text) if text else 0.0)
            return rows.select([f.name for f in kept]).append_column("score", pa.array(score, pa.float64()))

        return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judged, schema)

    def score(self, url: bytes) -> float:
        """How much likelier, in nats a byte, one URL is among rejected ones; 0 if empty."""
        if not url:
            return 0.0
        counts = [f"{kind}{ALL}" for kind in "ar"]
        chances = dict.fromkeys(counts, 0.0)
        body = [int(x) for x in windows(url)]
        asked = {(k << 48) | (x & ((1 << 8 * k) - 1)) for x in body for k in range(1, ORDER + 2)}
        about = {x: (x >> 48) << 48 | (x & _BODY) >> 8 for x in asked}
        grams = self.grams.where(F.col("gram").isin(sorted(asked))).select(F.lit(True).alias("whole"), "gram", *counts, *(F.lit(0).cast("bigint").alias(f"kinds_{c}") for c in counts))
        contexts = self.contexts.where(F.col("context").isin(sorted(set(about.values())))).select(F.lit(False).alias("whole"), "context", *(f"total_{c}" for c in counts), *(f"kinds_{c}" for c in counts))
        known = {(r[0], r[1]): r[2:] for r in grams.union(contexts).collect()}  # those of one URL
        for x in body:
            for at, c in enumerate(counts):
                chance = 1 / 256
                for k in range(1, ORDER + 2):
                    gram = (k << 48) | (x & ((1 << 8 * k) - 1))
                    total, kinds = (known.get((False, about[gram])) or (0,) * 4)[at::2]
                    if total:
                        chance = ((known.get((True, gram)) or (0,) * 4)[at] + kinds * chance) / (total + kinds)
                chances[c] += math.log(chance)
        return (chances[counts[1]] - chances[counts[0]]) / len(url)


def _context(gram: Column) -> Column:
    """What stands before a gram's last byte, with the gram's number of bytes."""
    return gram.bitwiseAND(~_BODY).bitwiseOR(F.shiftright(gram.bitwiseAND(_BODY), 8))


def _windows_of(rows: pa.Table) -> pa.Table:
    found = [windows(text) for text in rows.column("text").to_pylist()]
    window = np.unique(np.concatenate(found))
    return pa.table({"block": pa.array(np.full(len(window), rows.column("block")[0].as_py()), pa.int64()), "window": pa.array(window, pa.int64())})


def calibrated_table(scores: DataFrame) -> tuple[float, tuple[float | None, float | None]]:
    """What ``calibrated`` finds, for a table (score, rejected); and the shares of rejected and of accepted rows above it.

    Costs are whole numbers, and equal scores stay together.
    """
    counted = scores.groupBy("score").agg(F.count_if("rejected").alias("bad"), F.count_if(~F.col("rejected")).alias("good"))
    counted = settle(counted.withColumn("part", F.floor(F.col("score") * 64)), "held-out")
    low, high, good, bad = counted.agg(F.min("score"), F.max("score"), F.sum("good"), F.sum("bad")).head()
    if low is None:
        return 0.0, (None, None)
    cost = F.col("good") * F.lit(REJECTION_COST * max(1, bad)) - F.col("bad") * F.lit(max(1, good))
    counted = counted.withColumn("cost", cost)
    parts = counted.groupBy("part").agg(F.sum("cost").alias("whole"))
    later = parts.select("part", (F.sum("whole").over(Window.orderBy(F.desc("part"))) - F.col("whole")).alias("later"))  # a row for 1/64 nat a byte
    within = F.sum("cost").over(Window.partitionBy("part").orderBy(F.desc("score")))
    above = counted.withColumn("within", within).join(F.broadcast(later), "part").select("score", (F.col("within") + F.col("later")).alias("cost"))
    best = above.orderBy("cost", "score").head()  # this score and all above it are rejected
    if best.cost > 0:
        below, at = high, high
    else:
        below, at = counted.where(F.col("score") < best.score).agg(F.max("score")).head()[0], best.score
    threshold = max(0.0, at - 1e-9) if below is None else max(0.0, below + (at - below) * REJECTION_COST / (1 + REJECTION_COST))
    over = counted.where(F.col("score") > threshold).agg(F.sum("bad"), F.sum("good")).head()
    return threshold, ((over[0] or 0) / bad if bad else None, (over[1] or 0) / good if good else None)


def fit_urls(pages: DataFrame) -> UrlTables:
    """Models and threshold from all distinct URLs of ``pages`` (url)."""
    executors_can_import(pages.sparkSession)
    examples = examples_of(pages)
    model = UrlTables(examples)
    held_out = examples.select("text", "rejected", F.try_element_at(F.create_map(*(x for fold in range(FOLDS) for x in (F.lit(1 << fold), F.lit(fold)))), F.col("without")).alias("at")).where("at IS NOT NULL")
    model.threshold, model.held_out = calibrated_table(model.scores(held_out, list(range(FOLDS))).select("score", "rejected"))
    return model


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, model: UrlTables | UrlModel | None = None) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score.

    ``verdict`` is ``allow`` or ``block``: the rule's, or else the models'. ``score`` is null
    where a rule decides. Null and empty URLs have no rule and are allowed. Rows are judged one
    by one, so repeated or null page_ids are kept; other columns, whatever their names, are left
    out. An empty table gives an empty one. ``model`` is fitted on ``pages`` unless given; a
    ``UrlModel``, of examples in memory, is sent to all tasks.
    """
    spark = pages.sparkSession
    executors_can_import(spark)
    known = spark.sparkContext.broadcast((HostRules(rules), model if isinstance(model, UrlModel) else None))
    fields = "page_id bigint, host string, path string, text binary, at int, rule string, action string"

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, urls = known.value
        for batch in batches:
            rule, action, text, score = [], [], [], []
            for url, host, path in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True):
                fits, does = found.find(host, path)
                rule.append(fits)
                action.append(does)
                text.append(None if fits else model_text(url or ""))
                score.append(urls.score(text[-1]) if urls and not fits else None)
            made = [pa.array(text, pa.binary()), pa.array([0] * len(text), pa.int32()), pa.array(rule, pa.string()), pa.array(action, pa.string())]
            made += [pa.array(score, pa.float64())] if urls else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), *made], names=["page_id", "host", "path", "text", "at", "rule", "action", "score"][: 3 + len(made)])

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string")).select("page_id", "url", host.alias("host"), path.alias("path"))
    if isinstance(model, UrlModel):
        rows = rows.mapInArrow(ruled, f"{fields}, score double")
    else:
        model = model or fit_urls(pages)
        rows = model.scores(rows.mapInArrow(ruled, fields), [ALL])
    score = F.when(F.col("rule").isNull(), F.col("score"))
    verdict = F.coalesce("action", F.when(score > model.threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")
