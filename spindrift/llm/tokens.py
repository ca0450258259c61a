"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

A tokenizer file splits a text into pieces before its model sees any of them, and no piece
crosses a single space that stands between two other characters (byte-level files) or any white
space (word-end files). So a text is cut at such places, each distinct word's ids are kept in a
memory bounded in bytes, and a text's ids are gathered from there. The ids equal those of
``Tokenizer.encode(text, add_special_tokens=False)``. ``plain`` encoders are those with
``encode_special_tokens`` set: strings of special tokens inside a text are ordinary text there;
in others they give the special tokens' ids. Files of any other build are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of words and their ids that a worker keeps; when full, those that the text at hand doesn't have go.
MEMORY_BYTES = 16 << 20
#: Longer words (in bytes) aren't kept.
KEPT_LENGTH = 128
#: UTF-8 bytes of text that are encoded at once; longer texts are cut at safe places.
TEXT_BYTES = 4 << 20
#: Characters of a word that the library encodes at once, where punctuation lets it be cut.
WORD_CHARS = 1 << 16
#: Pieces of unusual words, and strings of marks behind usual ones, that are kept as Python objects.
KEPT_PIECES = 1 << 14

# White space as the tokenizer files' patterns see it, and those patterns.
_WHITE = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0  -     　"
_BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_IRREGULAR = f"(^|[{_WHITE}]) | ([{_WHITE}]|$)"  # a space beside white space or at an end
_BYTE_CUT = re.compile(f"(?<=[^{_WHITE}])(?= [^{_WHITE}])")
#: Such a place in a text for a byte-level file, found from the space on.
SAFE_SPACE = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_WORD_CUT = re.compile("[ \t\n\r]+")
# Letters end a piece and marks begin one: there a word without white space can be cut.
_MARK_CUT = re.compile("(?<=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])(?=[,.;:!?\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
#: Marks that form one piece behind a word; an apostrophe may begin another.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Characters on which this module's and the library's pattern engines surely agree.
_PLAIN = re.compile("[\n -~À-ɏ]*").fullmatch
#: A word of letters alone among these: one piece, with the space before it.
_USUAL = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+$"


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALPHABET = _byte_characters()
_SPACE = _ALPHABET[32]


def ranges(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start : start + length]`` of each pair, one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return values[at]


class _Kept:
    """Words and their ids, in arrays."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.starts.nbytes + self.lengths.nbytes

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, -1 if it isn't kept."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def replace(self, words: pa.Array, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Keep these words only; each has its ids at a place of ``ids``."""
        some = pc.less_equal(pc.binary_length(words), KEPT_LENGTH)
        at = some.to_numpy(zero_copy_only=False)
        self.words, self.lengths = words.filter(some), lengths[at]
        self.ids = ranges(ids, starts[at], self.lengths)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths


class TextEncoder:
    """Encodes batches of texts with the tokenizer file at ``path``.

    Memory: ``MEMORY_BYTES`` twice (words behind a space and others), and what the words of
    ``TEXT_BYTES`` of text (one span, or a part of a longer text) take. A single run of letters
    without any break is given to the library as it is.
    """

    def __init__(self, path: str, plain: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.kind = _kind(added, *(json.loads(part.__getstate__()) if part else {} for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)))
        self.special = {} if plain else {token.content: self.tokenizer.token_to_id(token.content) for token in added}
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._model = self.tokenizer.model
        self._pieces: dict[str, list[int]] = {}
        # words behind a space, known without it; and words as they stand
        self._after_space, self._as_is = _Kept(), _Kept()

    @property
    def held_bytes(self) -> int:
        """What the kept words take."""
        return self._after_space.nbytes + self._as_is.nbytes

    def _ids_of(self, words: pa.Array, kept: _Kept, before: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and lengths for distinct words, ``before`` being put before each.

        A word of letters with marks behind them has the letters' ids and the marks' ids.
        """
        cores = pc.utf8_rtrim(words, characters=_TAIL)
        usual = pc.match_substring_regex(cores, _USUAL)
        keys = pc.if_else(usual, cores, words)
        tails = _ends(words, pc.binary_length(keys).to_numpy(zero_copy_only=False)).dictionary_encode()
        keys = keys.dictionary_encode()
        # the keys' ids: kept ones, then those of new keys
        known = kept.find(keys.dictionary)
        new = known < 0
        made = array("I")
        ends = []
        fresh = keys.dictionary.filter(pa.array(new))
        for word, plainly in zip(fresh.to_pylist(), pc.match_substring_regex(fresh, _USUAL).to_pylist(), strict=True):
            if plainly:
                made.extend(self._piece(before + (word.lower() if self.kind == "word" else word)))
            else:
                self._encode_text(before + word, made)
            ends.append(len(made))
        new_ends = np.array(ends, np.int64)
        new_starts = np.concatenate((np.zeros(1, np.int64), new_ends))[:-1] if len(ends) else new_ends
        starts, lengths = np.empty(len(known), np.int64), np.empty(len(known), np.int64)
        starts[~new], lengths[~new] = kept.starts[known[~new]], kept.lengths[known[~new]]
        starts[new], lengths[new] = len(kept.ids) + new_starts, new_ends - new_starts
        ids = np.concatenate((kept.ids, np.frombuffer(made, np.uint32) if made else np.empty(0, np.uint32)))
        if new.any():
            if kept.nbytes + fresh.nbytes + 12 * len(fresh) + 4 * len(made) > MEMORY_BYTES:
                kept.replace(keys.dictionary, ids, starts, lengths)
            else:
                kept.replace(pa.concat_arrays([kept.words, fresh]), ids, np.append(kept.starts, starts[new]), np.append(kept.lengths, lengths[new]))
        # key and tail of each word, one after the other
        marks = [self._marks(x) for x in tails.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in marks], np.int64)
        places = len(ids) + np.cumsum(sizes) - sizes
        of_key, of_tail = keys.indices.to_numpy(), tails.indices.to_numpy()
        both = np.stack((starts[of_key], places[of_tail]), axis=1).ravel(), np.stack((lengths[of_key], sizes[of_tail]), axis=1).ravel()
        ids = ranges(np.concatenate((ids, np.array([i for x in marks for i in x], np.uint32))), *both)
        lengths = lengths[of_key] + sizes[of_tail]
        return ids, np.cumsum(lengths) - lengths, lengths

    def _piece(self, piece: str) -> list[int]:
        letters = piece.replace(" ", _SPACE) if piece.isascii() else piece.encode().decode("latin-1").translate(_ALPHABET)
        return [token.id for token in self._model.tokenize(letters)]

    def _kept_piece(self, piece: str) -> list[int]:
        """Ids of any piece."""
        made = self._pieces.get(piece)
        if made is None:
            made = [token.id for token in self._model.tokenize(piece.encode().decode("latin-1").translate(_ALPHABET))]
            if len(piece) <= KEPT_LENGTH:
                if len(self._pieces) >= KEPT_PIECES:
                    self._pieces.clear()
                self._pieces[piece] = made
        return made

    def _marks(self, tail: str) -> list[int]:
        return self._kept_piece(tail) if tail else []

    def _encode_text(self, text: str, into: array) -> None:
        """Add a text's ids, piece by piece where this module knows the pieces."""
        if _PLAIN(text):
            for piece in _BYTE_PIECES.finditer(text) if self.kind == "byte" else _WORD_PIECES.finditer(text.lower()):
                into.extend(self._kept_piece(piece[0]))
            return
        low = 0
        while low < len(text):
            at = _MARK_CUT.search(text, low + WORD_CHARS)
            high = at.start() if at else len(text)
            into.extend(self.tokenizer.encode(text[low:high], add_special_tokens=False).ids)
            low = high

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin and the last one's end; null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for low, high in _spans(sizes):
            part = texts.slice(low, high - low)
            if self.kind == "whole":
                ids, n = self._whole(part)
            elif (special := self._special_texts(part)).any():
                ids, n = _merged(part, special, self._around_special, self._span)
            else:
                ids, n = self._span(part)
            found.append(ids)
            counts.append(n)
        bounds = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=bounds[1:])
        return (np.concatenate(found) if found else np.empty(0, np.uint32)), bounds

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _special_texts(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold the string of a special token that counts as one."""
        found = np.zeros(len(texts), bool)
        for content in self.special:
            found |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        return found

    def _around_special(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts with special tokens: the library takes these out first, so the parts between are texts of their own."""
        cut, made, counts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")"), [], []
        for text in texts.to_pylist():
            parts = [np.array([self.special[x]], np.uint32) if i % 2 else self._span(pa.array([x], pa.large_string()))[0] for i, x in enumerate(cut.split(text))]
            made += parts
            counts.append(sum(map(len, parts)))
        return np.concatenate(made), np.array(counts, np.int64)

    def _span(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 1 and pc.binary_length(texts)[0].as_py() > TEXT_BYTES:
            return self._long(texts[0].as_py())
        return self._many(texts)

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """One long text, in parts that begin at safe cuts."""
        cut, parts, low = (_BYTE_CUT if self.kind == "byte" else _WORD_CUT), [], 0
        while low < len(text):
            at = cut.search(text, low + TEXT_BYTES // 4)
            high = at.start() if at else len(text)
            parts.append(self._of_chunks([self._chunks(text[low:high])])[0])
            low = high
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)], np.int64)

    def _chunks(self, text: str) -> list[str]:
        return _BYTE_CUT.split(text) if self.kind == "byte" else _WORD_CUT.split(text)

    def _of_chunks(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        chunks: list[str] = []
        bounds = [0]
        for text in texts:
            chunks += text
            bounds.append(len(chunks))
        words = pa.array(chunks, pa.string()).dictionary_encode()
        ids, starts, lengths = self._ids_of(words.dictionary, self._as_is)
        at = words.indices.to_numpy()
        return ranges(ids, starts[at], lengths[at]), _sums(lengths[at], np.array(bounds))

    def _many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "byte":
            odd = pc.match_substring_regex(texts, _re2(_IRREGULAR)).to_numpy(zero_copy_only=False)
            if odd.any():
                return _merged(texts, odd, lambda x: self._of_chunks(map(self._chunks, x.to_pylist())), self._many)
        else:
            texts = pc.replace_substring_regex(texts, "[\t\n\r]", " ")
        lists = pc.split_pattern(texts.cast(pa.string()), " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        ids, starts, lengths = self._ids_of(words.dictionary, self._after_space, " " if self.kind == "byte" else "")
        if self.kind == "byte":  # nothing stands before a text's first word
            first = pc.take(words.dictionary, pa.array(at[bounds[:-1]])).dictionary_encode()
            more, places, sizes = self._ids_of(first.dictionary, self._as_is)
            at = at.astype(np.int64)
            at[bounds[:-1]] = len(starts) + first.indices.to_numpy()
            starts, lengths, ids = np.concatenate((starts, len(ids) + places)), np.concatenate((lengths, sizes)), np.concatenate((ids, more))
        return ranges(ids, starts[at], lengths[at]), _sums(lengths[at], bounds)


def _ends(words: pa.Array, skipped: np.ndarray) -> pa.Array:
    """What follows the first ``skipped`` bytes of each word."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    lengths = np.diff(bounds) - skipped
    held = words.buffers()[2]
    found = ranges(np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8), bounds[:-1] + skipped, lengths)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(found))


def _merged(texts: pa.Array, odd: np.ndarray, of_odd: Callable, of_even: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of all texts, in order, where ``odd`` ones are encoded by ``of_odd`` and the others by ``of_even``."""
    made, starts, counts, before = [], np.empty(len(texts), np.int64), np.empty(len(texts), np.int64), 0
    for at, encode in ((np.flatnonzero(~odd), of_even), (np.flatnonzero(odd), of_odd)):
        if len(at):
            ids, n = encode(texts.take(pa.array(at)))
            starts[at], counts[at] = before + np.cumsum(n) - n, n
            made.append(ids)
            before += len(ids)
    return ranges(np.concatenate(made), starts, counts), counts


def _kind(added: Iterable, before: dict, pieces: dict) -> str:
    """How the texts of a tokenizer file may be cut: at spaces (byte), at white space (word), or not (whole)."""
    if any(token.normalized or token.lstrip or token.rstrip for token in added):
        return "whole"
    if not before and pieces.get("type") == "ByteLevel" and pieces["use_regex"] and not pieces["add_prefix_space"]:
        return "byte"
    steps = [x["type"] for x in before.get("normalizers", [])], [x["type"] for x in pieces.get("pretokenizers", [])]
    if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and pieces["pretokenizers"][0]["pattern"] == {"Regex": _WORD_PIECES.pattern}:
        return "word"
    return "whole"


def _re2(pattern: str) -> str:
    return "".join(c if c.isascii() and c.isprintable() else f"\\x{{{ord(c):x}}}" for c in pattern)


def _sums(lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=total[1:])
    return np.diff(total[bounds])


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``TEXT_BYTES`` together; a longer text stands alone."""
    low, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and held + size > TEXT_BYTES:
            yield low, i
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)


@lru_cache(maxsize=1)
def encoder(path: str, plain: bool = True) -> TextEncoder:
    """This worker's encoder for a tokenizer file; one of another file or kind takes its place."""
    return TextEncoder(path, plain)
