"""Chat formatting with a token mask that says which tokens are trained on.

A conversation's turns are rendered one after the other with this template::

    system:     <<SYS>>text<</SYS>>
    user:       [INST]text[/INST]
    assistant:  <s>text</s>
    any other:  <<ROLE>>role<<TEXT>>text<</ROLE>>

Inside texts and role names, a control string gets a backslash after its first character (one
more if it has some already), so that what is left of it is no control string; reading takes
one away. The whole rendering is encoded once, with offsets. Control strings are single tokens
that no other token reaches across, so texts between them are encoded by the batch, and offsets
follow from the tokens' lengths in bytes. The mask is found by binary search: the turns' text
spans are sorted, and so are the tokens' spans; a token is trained on if it meets an assistant's
span.

A conversation is written as segments of about ``SEGMENT_CHARS`` characters at most. They are cut
between turns, and within a longer turn before a single space between two other characters, which
the tokenizer's pattern always gives to the word behind it; so a segment's ids are those that it
has in the whole. Turns are sorted into ranges, so several tasks format a conversation that holds
a large part of all turns, each in bounded memory. Reading streams the segments of a conversation
in order; its digest is a hash of all its text, hence one task's sequential work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import executors_can_import, release_memory, settle, shuffle_partitions, text_slices, tokenizer_path
from spindrift.llm.tokens import SAFE_SPACE, encoder

TOKENIZER = "byte_bpe_50k.json"
SEGMENT_CHARS = 1 << 17
#: Characters of segments that leave a task together.
BATCH_CHARS = 1 << 20
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
#: Strings that a text may not hold as they are: the template's, and the tokenizer's own special token.
CONTROLS = [*(mark for pair in ROLES.values() for mark in pair), *OTHER, "<|endoftext|>"]

_RESTS = {c: "|".join(regex.escape(x[1:]) for x in CONTROLS if x[0] == c) for c in {x[0] for x in CONTROLS}}
_PLAIN = regex.compile("|".join(rf"(?<={regex.escape(c)})\\*(?={rest})" for c, rest in _RESTS.items()))
_ESCAPED = regex.compile("|".join(rf"(?<={regex.escape(c)})\\(?=\\*(?:{rest}))" for c, rest in _RESTS.items()))
_MAY_HOLD = regex.compile(r"[\[<]").search
_MARK = regex.compile("|".join(map(regex.escape, sorted(CONTROLS, key=len, reverse=True))))
_TURN = regex.compile(
    "|".join(f"(?P<{role}>{regex.escape(a)}(?P<{role}_text>.*?){regex.escape(b)})" for role, (a, b) in ROLES.items())
    + f"|(?P<other>{regex.escape(OTHER[0])}(?P<role>.*?){regex.escape(OTHER[1])}(?P<other_text>.*?){regex.escape(OTHER[2])})",
    regex.S,
)

SEGMENTS = (
    "conv_id bigint, segment bigint, text string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>, "
    "turn_starts array<int>, turn_ends array<int>, trained array<boolean>"
)
_TYPES = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()), *[pa.list_(pa.int32())] * 2, pa.list_(pa.bool_())]


def escape(text: str) -> str:
    return _PLAIN.sub(lambda found: found[0] + "\\", text) if _MAY_HOLD(text) else text


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    if role in ROLES:
        before, after = ROLES[role]
    else:
        before, after = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    inside = escape(text)
    return before + inside + after, len(before), len(before) + len(inside)


def turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a rendering; ``start`` and ``end`` enclose the escaped text."""
    at = 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn begins at {at}")
        at = found.end()
        kind = found.lastgroup if found.lastgroup in ROLES else next(k for k in (*ROLES, "other") if found[k] is not None)
        role = unescape(found["role"]) if kind == "other" else kind
        start, end = found.span(f"{kind}_text")
        yield role, unescape(text[start:end]), start, end


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    """The tokenizer file with the control strings as special tokens, which texts can't hold."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([c for c in CONTROLS if made.token_to_id(c) is None])
    return made


def mask_tokens(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> np.ndarray:
    """Which tokens meet a span; spans are sorted and don't overlap."""
    if not len(span_starts):
        return np.zeros(len(starts), bool)
    after = np.searchsorted(span_ends, starts, side="right")  # the first span that ends behind the token's start
    near = np.minimum(after, len(span_starts) - 1)
    return (after < len(span_starts)) & (span_starts[near] < ends)


class ChatEncoder:
    """Ids of rendered pieces, and the characters that they stand for, by a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        self.library, self.texts = chat_tokenizer(path), encoder(path)
        if self.texts.kind != "byte":
            raise ValueError(f"{path} is no byte-level file: its tokens don't tell their lengths")
        added = {i: token.content for i, token in self.library.get_added_tokens_decoder().items()}
        self.lengths = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            # a character of the file's own alphabet stands for a byte
            self.lengths[i] = len(added[i].encode()) if i in added else len(token)
        self._around: dict[str, np.ndarray] = {}

    def around(self, marks: str) -> np.ndarray:
        """Ids of what stands before or behind a text: marks, and perhaps a role's name."""
        found = self._around.get(marks)
        if found is None:
            found = np.array(self.library.encode(marks, add_special_tokens=False).ids, np.uint32)
            if len(marks) < 200 and len(self._around) < 1000:
                self._around[marks] = found
        return found

    def encode(self, pieces: list[tuple[str, int, int]]) -> list[np.ndarray]:
        """Ids of each piece (rendering, text start, text end); all texts are encoded together."""
        ids, bounds = self.texts.encode(pa.array([piece[start:end] for piece, start, end in pieces], pa.large_string()))
        return [np.concatenate((self.around(piece[:start]), ids[a:b], self.around(piece[end:]))) for (piece, start, end), a, b in zip(pieces, bounds, bounds[1:], strict=False)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one behind its last; a token may hold a part of a character."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if not text.isascii():
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            character = np.cumsum((raw & 0xC0) != 0x80) - 1
            starts, ends = character[starts], character[ends - 1] + 1
        if len(ids) and ends[-1] != len(text):
            raise ValueError("tokens don't cover the text")
        return starts.astype(np.int32), ends.astype(np.int32)


@lru_cache(maxsize=1)
def chat_encoder(path: str) -> ChatEncoder:
    return ChatEncoder(path)


def make_segment(parts: list[tuple[str, str, int, int]], ids: list[np.ndarray], coder: ChatEncoder) -> dict:
    """The columns of a segment of rendered turns or parts of one (role, rendering, text start, text end) and their ids."""
    sizes = np.array([len(rendered) for _, rendered, _, _ in parts])
    shift = np.cumsum(sizes) - sizes
    turn_starts = shift + [start for _, _, start, _ in parts]
    turn_ends = shift + [end for _, _, _, end in parts]
    trained = np.array([role == "assistant" for role, *_ in parts], bool)
    text, all_ids = "".join(rendered for _, rendered, _, _ in parts), np.concatenate(ids)
    starts, ends = coder.spans(text, all_ids)
    some = trained & (turn_ends > turn_starts)
    return {
        "text": text, "ids": all_ids.astype(np.int32), "starts": starts, "ends": ends, "loss_mask": mask_tokens(starts, ends, turn_starts[some], turn_ends[some]),
        "turn_starts": turn_starts.astype(np.int32), "turn_ends": turn_ends.astype(np.int32), "trained": trained,
    }


def pieces_of(rendered: str, start: int, end: int, most: int) -> Iterator[tuple[str, int, int]]:
    """A rendered turn in pieces of about ``most`` characters: (piece, text start, text end) in each."""
    low = 0
    while low < len(rendered):
        # never within a mark: from the text's second character to its last but one
        found = SAFE_SPACE.search(rendered, max(low + most, start + 1), max(end - 1, 0)) if len(rendered) - low > most else None
        high = found.start() if found else len(rendered)
        inside = min(max(start - low, 0), high - low), min(max(end - low, 0), high - low)
        yield rendered[low:high], *inside
        low = high


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments (``SEGMENTS``) of all conversations (conv_id, turn, role, text), numbered in order.

    Rows are ordered by turn, nulls first, then by role and text; rows with equal turns all
    count. Null texts and roles are empty ones. A null conv_id is a conversation of its own.
    Texts of any length are taken whole, other columns left alone; no rows give no segments.
    """
    spark = conversations.sparkSession
    executors_can_import(spark)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chat_encoder(tokenizer_path(tokenizer))
        # a conversation goes on in the next task, whose number is larger
        open_id, segment, parts, found, held, done, waiting = None, TaskContext.get().partitionId() << 32, [], [], 0, [], 0

        def close() -> None:
            nonlocal parts, found, held, segment, waiting
            if parts:
                done.append({"conv_id": open_id, "segment": segment} | make_segment(parts, found, coder))
                waiting += held
                parts, found, held, segment = [], [], 0, segment + 1

        for batch in text_slices(batches, BATCH_CHARS):
            turns = [
                (conv_id, role, piece)
                for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)
                for piece in pieces_of(*render(role, text), segment_chars)
            ]
            for (conv_id, role, piece), ids in zip(turns, coder.encode([piece for _, _, piece in turns]), strict=True):
                if conv_id != open_id or (held and held + len(piece[0]) > segment_chars):
                    close()
                    open_id = conv_id
                parts.append((role, *piece))
                found.append(ids)
                held += len(piece[0])
                if waiting >= BATCH_CHARS:
                    yield _batch(done)
                    done.clear()
                    waiting = 0
        close()
        if done:
            yield _batch(done)

    rows = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.repartitionByRange(shuffle_partitions(spark), "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(formatted, SEGMENTS)


def _batch(segments: list[dict]) -> pa.RecordBatch:
    names = [field.split()[0] for field in SEGMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([s[name] for s in segments], kind) for name, kind in zip(names, _TYPES, strict=True)], names=names)


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> Iterator[str]:
    """What the masked tokens cover of each trained span, unescaped, span by span."""
    starts, ends = starts[mask], ends[mask]
    # a character of several bytes may be shared by tokens: each token adds what lies behind all earlier ones
    reached = np.maximum.accumulate(ends) if len(ends) else ends
    whole = np.ones(len(starts), bool)
    whole[1:] = starts[1:] <= reached[:-1]
    gaps = np.cumsum(~whole)
    for low, high in spans:
        first, last = np.searchsorted(reached, low, side="right"), np.searchsorted(starts, high, side="left")
        if first >= last:
            yield ""
        elif gaps[first] == gaps[last - 1]:
            yield unescape(text[max(starts[first], low) : min(reached[last - 1], high)])
        else:
            at, pieces = low, []
            for start, end in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True):
                pieces.append(text[max(start, at) : min(end, high)])
                at = max(at, end)
            yield unescape("".join(pieces))


class Reader:
    """Follows a conversation's segments in order: turns by their marks, and the text under the mask."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0
        self.role: str | None = None
        self.closing: str | None = None  # the mark that ends what is open
        self.name: list[str] = []

    def take(self, text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> None:
        spans: list[tuple[int, int]] = []
        at = 0
        for found in _MARK.finditer(text):
            self._inside(text[at : found.start()], at, spans)
            self._mark(found[0])
            at = found.end()
        self._inside(text[at:], at, spans)
        for masked in masked_texts(text, starts, ends, mask, spans):
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(masked)
        self.chars += len(text)
        self.tokens += len(starts)
        self.loss_tokens += int(mask.sum())

    def _inside(self, piece: str, at: int, spans: list[tuple[int, int]]) -> None:
        if not piece:
            return
        if self.closing is None:
            raise ValueError(f"text outside turns: {piece[:40]!r}")
        if self.closing == OTHER[1]:
            self.name.append(piece)
            return
        self.turns.update(unescape(piece).encode("utf-8", "surrogatepass"))
        if self.role == "assistant":
            spans.append((at, at + len(piece)))

    def _mark(self, mark: str) -> None:
        if self.closing is None:
            if mark == OTHER[0]:
                self.role, self.closing, self.name = None, OTHER[1], []
                return
            self.role = next((role for role, (before, _) in ROLES.items() if before == mark), None)
            if self.role is None:
                raise ValueError(f"no turn begins with {mark}")
            self._begin(self.role, ROLES[self.role][1])
        elif mark != self.closing:
            raise ValueError(f"{mark} within a turn")
        elif mark == OTHER[1]:
            self._begin(unescape("".join(self.name)), OTHER[2])
        else:
            self.turns.update(b"\n")
            self.n_turns += 1
            self.closing = None

    def _begin(self, role: str, closing: str) -> None:
        self.turns.update(f"{role}\n".encode("utf-8", "surrogatepass"))
        self.closing = closing

    def digest(self) -> dict:
        if self.closing is not None:
            raise ValueError(f"conversation {self.conv_id} ends within a turn")
        return {
            "conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars, "n_tokens": self.tokens, "loss_tokens": self.loss_tokens,
        }


def read_back(segments: DataFrame) -> DataFrame:
    """What the segments hold of each conversation, parsed from their text and read under their mask.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars,
    loss_sha256 (of the masked text), formatted_chars, n_tokens, loss_tokens. A segment that is
    missing within a turn, or text outside turns, is an error.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            names, texts = batch.column("conv_id").to_pylist(), batch.column("text")
            lists = [batch.column(c) for c in ("starts", "ends", "loss_mask")]
            for i, conv_id in enumerate(names):
                if now is None or now.conv_id != conv_id:
                    if now:
                        done.append(now.digest())
                    now = Reader(conv_id)
                now.take(texts[i].as_py(), *(x[i].values.to_numpy(zero_copy_only=False) for x in lists))
            if done:
                yield pa.RecordBatch.from_pylist(done, _DIGEST)
                done = []
        if now:
            yield pa.RecordBatch.from_pylist([*done, now.digest()], _DIGEST)
        release_memory()

    rows = segments.select("conv_id", "segment", "text", "starts", "ends", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint")


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())]
)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(settle(format_conversations(conversations.unionByName(added)), "chat")).drop("n_tokens", "loss_tokens")


_FOUND = r"[<\[]\\*(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|<ROLE>>|<TEXT>>|</ROLE>>|\|endoftext\|>)"
ORACLE_SQL = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '{_FOUND}')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
        ELSE 25 + length(role) + len(regexp_extract_all(role, '{_FOUND}')) END AS size FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
