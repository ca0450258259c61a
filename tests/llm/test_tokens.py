"""Encoding, flat files, record files and packing, on difficult texts and tables."""

from __future__ import annotations

import resource
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import packing, token_counts, token_files, tokens
from spindrift.llm.common import tokenizer_path

TEXTS = ["", None, " ", "one", "  two  spaces ", "line\nend\n\n  x", "it's I'LL 12,345", "日本語 é é İ ΣΑΣ", "<|endoftext|> <|startoftext|>", "a b\x1cc\x85d\x0be", "foo, bar... baz*** $%&", "x" * 3000]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@lru_cache
def library(name, plainly=True):
    made = Tokenizer.from_file(tokenizer_path(name))
    if plainly:
        made.encode_special_tokens = True
    return made


def plain(name, texts, plainly=True):
    return [x.ids for x in library(name, plainly).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(name, texts, plainly=True):
    ids, bounds = tokens.encoder(tokenizer_path(name), plainly).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


@pytest.mark.parametrize("plainly", [True, False])
@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_librarys(name, plainly):
    assert encoded(name, TEXTS, plainly) == plain(name, TEXTS, plainly)
    assert encoded(name, [], plainly) == []


PARTS = [*"ab Z'1s\n\t\r \u3000é.<|*日’-", "<|endoftext|>", "<|startoftext|>"]


@pytest.mark.parametrize("plainly", [True, False])
@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=8))
def test_ids_equal_the_librarys_on_any_text(name, plainly, texts):
    assert encoded(name, texts, plainly) == plain(name, texts, plainly)


@pytest.mark.parametrize("plainly", [True, False])
@pytest.mark.parametrize("name", FILES)
def test_long_texts_are_cut_safely(name, plainly, monkeypatch):
    monkeypatch.setattr(tokens, "TEXT_BYTES", 64)
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 2000)
    monkeypatch.setattr(tokens, "KEPT_LENGTH", 5)
    monkeypatch.setattr(tokens, "WORD_CHARS", 7)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    text = "alpha beta,  gamma\n\ndelta it's 12 " * 30
    texts = [text, "short", text[:70], "日本語、" * 40 + "終。end" + "ΣΑΣ.é，" * 30, "aGVs/bG8+9" * 50, f"{text[:90]}<|endoftext|>{text[:90]}"]
    assert encoded(name, texts, plainly) == plain(name, texts, plainly)


@pytest.mark.parametrize("name", FILES)
def test_memory_is_bounded_in_bytes(name):
    """Up to 50 MB of texts without spaces: base64, minified code, and CJK."""
    rng = np.random.default_rng(3)
    letters = {"base64": "ABCDEFGHijklmnopqrstuvwx0123456789+/", "code": "abcxyz(){}=;.,+_", "cjk": "".join(map(chr, range(0x4E00, 0x4F00))) + "。，"}
    alphabets = [np.array(list(x)) for x in letters.values()]
    coder = tokens.encoder(tokenizer_path(name))
    before, most, done = resident(), 0, 0
    while done < (50 if coder.kind == "byte" else 12) << 20:
        texts = pa.array(["".join(rng.choice(alphabets[k % 3], 100_000)) for k in range(10)])
        coder.encode(texts)
        done += texts.nbytes
        most = max(most, resident())
        assert coder.held_bytes <= 2 * tokens.MEMORY_BYTES
    assert most - before < 250


def resident():
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * resource.getpagesize() >> 20


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", 1) for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, length int").repartition(3)


def test_flat_files_count_what_was_encoded(spark):
    got = sorted(token_counts.count_document_tokens(documents(spark, TEXTS)).collect())
    assert [tuple(r) for r in got] == [(i, len(x)) for i, x in enumerate(plain("byte_bpe_50k.json", TEXTS))]
    assert token_counts.count_document_tokens(documents(spark, [])).count() == 0
    assert token_counts.count_document_tokens(documents(spark, ["a", "b", "b"], [None, 7, 7])).count() == 3


@pytest.mark.parametrize("block", [2, 6, 10, 1000])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng, end = np.random.default_rng(block), 9
    wanted = []
    for f in range(3):
        ids = rng.integers(5, 10, 57 + f).astype("<u2")
        if f == 2:
            ids[:40] = 1  # one document over many blocks
        ids.tofile(tmp_path / f"part-{f}.ids")
        count, nth = 0, 0
        for x in ids:
            if x == end:
                wanted.append((f, nth, count, True))
                count, nth = 0, nth + 1
            else:
                count += 1
        if count:
            wanted.append((f, nth, count, False))
    (tmp_path / "part-9.ids").touch()
    got = token_counts.token_counts(spark, str(tmp_path), end, "<u2", block).collect()
    assert sorted((int(r.path[-5]), r.nth, r.n_tokens, r.ended) for r in got) == wanted


def test_records_come_back(spark):
    ids = [5, 3, None, 5, 9, 0, 1, 2, 4, 6, 7, 8]
    got = token_files.token_digest(documents(spark, TEXTS, ids)).collect()
    order = sorted(range(len(ids)), key=lambda i: -1 if ids[i] is None else ids[i])
    made = {i: [*x, 1] for i, x in enumerate(plain("word_bpe_49k.json", TEXTS, plainly=False))}
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [ids[i] for i in order]
    assert Counter(r.ids_crc32 for r in got) == Counter(zlib.crc32(np.array(x, "<u4").tobytes()) for x in made.values())
    ranked = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ranked] == np.cumsum([0, *(r.n_tokens for r in ranked[:-1])]).tolist()
    assert token_files.token_digest(documents(spark, [])).count() == 0


@pytest.mark.parametrize("run_bytes", [1, 100, 1 << 20])
def test_runs_are_bounded_in_bytes(spark, tmp_path, run_bytes):
    runs = token_files.write_records(documents(spark, TEXTS * 3), str(tmp_path), run_bytes=run_bytes)
    kept = runs.collect()
    assert all(r.bytes <= run_bytes or r.n_records == 1 for r in kept) and sum(r.n_records for r in kept) == 3 * len(TEXTS)
    read = token_files.read_records(spark.createDataFrame(kept, runs.schema)).collect()
    made = {i: [*x, 1] for i, x in enumerate(plain("word_bpe_49k.json", TEXTS * 3, plainly=False))}
    assert {r.doc_id: r.ids for r in read} == made and len({(r.part, r.nth) for r in read}) == len(read)


def test_damaged_records_are_found():
    record = token_files.pack_record(None, np.array([1, 70000], np.uint32), True)
    data = bytearray(token_files.frame(record))
    doc_id, ids = token_files.unpack_record(token_files.unframe(memoryview(data), 0)[0])
    assert doc_id is None and ids.tolist() == [1, 70000]
    for at in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            token_files.unframe(memoryview(broken), 0)


def test_masking_follows_its_formula():
    crc = zlib.crc32(b"abc")
    assert token_files.masked_crc(b"abc") == (((crc >> 15) | (crc << 17) & 0xFFFFFFFF) + 0xA282EAD8) % 2**32


def unpacked(plan, capacity):
    places = {}
    for length, rank, n, sequence, offset in plan.runs:
        for i in range(n):
            places.setdefault(sequence + i, []).append((offset, length))
    counts = Counter()
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
            counts[length] += 1
        assert at <= capacity
    return len(places), counts


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_hold_every_piece_once(histogram):
    plan = packing.plan_packing(histogram, 64, 8)
    used, counts = unpacked(plan, 64)
    assert counts == Counter(histogram) and used == plan.sequences
    for length in histogram:
        ranks = sorted((r, n) for x, r, n, _, _ in plan.runs if x == length)
        assert [r for r, _ in ranks] == np.cumsum([0, *(n for _, n in ranks[:-1])]).tolist()


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - length)
    return len(gaps)


@pytest.mark.parametrize("low, high", [(1, 1024), (300, 700), (1, 200)])
def test_plans_are_near_best_fit_decreasing(low, high):
    lengths = np.random.default_rng(low).integers(low, high + 1, 3000).tolist()
    used, _ = unpacked(packing.plan_packing(dict(Counter(lengths))), 1024)
    assert used <= 1.02 * best_fit_decreasing(lengths, 1024) + 1


def test_the_plan_does_not_grow_with_the_corpus():
    lengths = np.random.default_rng(1).integers(1, 129, 4000)
    plans = [packing.plan_packing({x: n * k for x, n in Counter(lengths.tolist()).items()}, 128, 16) for k in (1, 100)]
    assert len(plans[1].runs) < 1.3 * len(plans[0].runs) and plans[1].sequences <= 100 * plans[0].sequences


def test_packed_documents(spark):
    texts = [*TEXTS, "word " * 5000, None, "one"]
    got = packing.pack_documents(documents(spark, texts)).collect()
    made = [[*x, 2] for x in plain("byte_bpe_50k.json", texts, plainly=False)]
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in enumerate(made):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 1024 for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(documents(spark, [])).count() == 0
