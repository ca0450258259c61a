"""Sharding, quality rules, near-duplicates, decontamination and the pipeline, against plain versions."""

from __future__ import annotations

import random
import re
import zlib

import pytest
from compare import difference, oracle

from spindrift.llm import decontaminate, near_dup, quality, queries, sharding

WORDS = [f"{a}{b}" for a in "banana cherry damson elder fig grape hazel iris".split() for b in "abcdefghijklmnop"]
SCHEMA = "doc_id long, text string, kept boolean, n_words int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, True, 1) for i, t in rows], SCHEMA)


def some_text(rng, n=80):
    return " ".join(rng.choices(WORDS, k=n))


def test_shards_hold_every_row_once(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, some_text(rng, 5)) for i in range(300)] + [(7, "same")] * 150 + [(None, None)] * 3 + [(400, "")]
    written = sharding.shard_records(frame(spark, rows).repartition(5), f"{tmp_path}/a", 6, bucket_bytes=500)
    got = sharding.shard_digest(written).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = {}
    for r in got:
        assert r.grown_shard in (r.shard, 6)
        shards.setdefault(r.shard, []).append(r.slot)
        shards.setdefault(("id", r.doc_id), set()).add(r.shard)
    assert all(sorted(slots) == list(range(len(slots))) for k, slots in shards.items() if isinstance(k, int))
    assert all(len(v) == 1 for k, v in shards.items() if isinstance(k, tuple))
    grown = {r.doc_id: r.shard for r in sharding.shard_records(frame(spark, rows), f"{tmp_path}/b", 7, bucket_bytes=500).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    empty = sharding.shard_digest(sharding.shard_records(frame(spark, []), f"{tmp_path}/c", 6))
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), oracle(sf_dir), queries.ORACLE_SQL[name]) is None


def test_quality_edges(spark):
    rng = random.Random(2)
    good = "\n".join(some_text(rng, 12) + "." for _ in range(10))
    rows = [(1, good), (2, good.upper()), (3, None), (4, ""), (5, re.sub(" ", " | ", good)), (6, (some_text(rng, 10) + "\n") * 9), (7, good), (None, good), (8, "a\tb\x0bc\x0cd\r\ne  f")]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 5, 6, 7, None)] == [True, False, False, False, False, False, True, True]
    assert got[8].n_words == 6 and got[6].base_failed and got[6].n_dup_lines == 8
    assert sorted(r.doc_id or 0 for r in quality.keep_good(frame(spark, rows)).collect()) == [0, 1, 7]
    long = spark.createDataFrame([(9, good * 400, 1, True), (9, good, 2, False)], "doc_id long, text string, n_words int, base_failed boolean")
    assert [(r.doc_id, r.n_words, r.kept) for r in quality.judge(long).orderBy("n_words").collect()] == [(9, 120, True), (9, 400 * 120 - 399, False)]
    assert quality.judge(frame(spark, [])).count() == 0 and quality.keep_good(frame(spark, [])).columns == ["doc_id", "text", "kept", "n_words"]


def test_verdict_does_not_depend_on_the_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted(quality.judge(docs, order).collect()) for order in (list(quality.RULES), list(quality.RULES)[::-1]))
    assert a == b


def brute_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 20), (2, 2)])
def test_components_equal_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    rng = random.Random(seed)
    rows, base = [], [some_text(rng, 60).split() for _ in range(4)]
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 6])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i * 3 + 1, " ".join(words) if i % 9 else " ".join(words).upper()))
    rows += [(1000, "only four words here"), (1001, "Only  four words\nhere"), (1002, ""), (1003, None), (1004, " \t"), (1005, "Ééé ééé"), (1006, "ééé ééé"), (1007, some_text(rng, 30000))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, rows).repartition(4)).collect()}
    assert got == brute_components(rows)


def test_near_dup_edges(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (3, "x y z"), (2, None)]
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.doc_id == 5} == {5} and all(r.kept for r in got if r.doc_id is not None)
    kept = near_dup.keep_representatives(frame(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == ["doc_id", "text", "kept", "n_words"]
    clashing = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 5, 6)], "doc_id long, text string, Row_Key long, cls long")
    assert [tuple(r) for r in near_dup.keep_representatives(clashing).collect()] == [(1, "a b c d e f", 5, 6)]


def test_odd_sketches_estimate_high_similarities():
    import numpy as np

    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 900, dtype=np.int64).astype(np.uint64)
    a, b = (np.concatenate((shared, rng.integers(0, 2**63, 50, dtype=np.int64).astype(np.uint64))) for _ in range(2))
    x, y = (near_dup.odd_sketch(near_dup.min_hashes(s, near_dup._FINE_FACTORS, near_dup._FINE_OFFSETS), near_dup._FINE_SALTS, near_dup.FINE_WORDS) for s in (a, b))
    differ = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
    low, high = (near_dup.most_differing_bits(0.9 + d, near_dup.FINE_SAMPLES, near_dup.FINE_WORDS) for d in (0.05, -0.05))
    assert low < differ < high


def test_leaks_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(4)
    items = [(i, some_text(rng, 25).capitalize() + ". " + some_text(rng, 8).capitalize() + ".") for i in range(30)] + [(90, None), (91, "..."), (92, "fig a")]
    rows = [(i, some_text(rng, rng.choice([5, 100, 700]))) for i in range(120)]
    leaks = {(500 + k, i) for k, i in enumerate((0, 7, 29))}
    rows += [(d, some_text(rng, 300) + "\n" + dict(items)[i].upper().replace(" ", "  ") + " " + some_text(rng, 40)) for d, i in leaks]
    rows += [(600, None), (601, ""), (None, dict(items)[3])]
    test = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, rows), test).collect()}
    norm = lambda t: " " + " ".join(decontaminate.plain_words(t or "")) + " "
    wanted = {(d, i) for d, t in rows for i, q in items if norm(q).strip() and norm(q) in norm(t)}
    assert got == wanted and leaks < got
    kept = [r.doc_id for r in decontaminate.drop_leaks(frame(spark, rows), test).collect()]
    assert sorted(map(str, kept)) == sorted(str(d) for d, t in rows if d not in {x for x, _ in wanted})
    assert decontaminate.find_leaks(frame(spark, []), test).count() == 0
    assert decontaminate.drop_leaks(frame(spark, rows), test.limit(0)).count() == len(rows)


def test_bounds_and_walk_equal_full_scoring():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    items = [(i, some_text(rng, 20)) for i in range(60)]
    index = decontaminate.ItemIndex(items)
    texts = [some_text(rng, 50) + " " + " ".join(rng.choice(items)[1].split()[: rng.randrange(4, 20)]) for _ in range(80)]
    found = {(row, item) for row, item, *_ in decontaminate.leaks(pa.array(texts), index)}
    weight = {(t, i): w for e, postings in enumerate(index.lists) for i, w in postings for t in [int(np.searchsorted(index.bounds, e, side="right")) - 1]}
    numbers, bounds = decontaminate.term_numbers(pa.array(texts), index)
    stride, wanted = index.longest, set()
    for row in range(len(texts)):
        words = numbers[bounds[row] : bounds[row + 1]].tolist()
        for start in range(0, max(1, -(-len(words) // stride) - 1) * stride, stride):
            passage = words[start : start + 2 * stride]
            for i in range(len(items)):
                score = sum(weight.get((t, i), 0.0) for t in {t for t in passage if t >= 0})
                if score >= decontaminate.MIN_SCORE - 1e-9 and index.verify(i, passage):
                    wanted.add((row, i))
    assert found == wanted and found


def test_pipeline_equals_its_stages_in_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in docs if not quality.Text(t).base_failed and not any(rule(quality.Text(t)) for rule in quality.RULES.values())]
    components = brute_components(left)
    left = [(i, t) for i, t in left if components[i][1] == i]
    norm = lambda t: " " + " ".join(decontaminate.plain_words(t)) + " "
    left = [i for i, t in left if not any(norm(q) in norm(t) for _, q in items)]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(left)
    held = {}
    for r in got:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert max(held.values()) <= 1024


def test_copies_with_marks_that_stand_alone_are_found():
    import pyarrow as pa

    rng = random.Random(12)
    short, sums = "If x + y = 7 , name x .", "If x + y = 7 and x - y = 3 , what is x ? The answer is : x = 5 ."
    dashed = " ".join(w for word in some_text(rng, 24).split() for w in (word, "-")) + ". " + some_text(rng, 6) + "."
    items = [(1, short), (2, sums), (3, dashed), (4, some_text(rng, 20) + ". " + some_text(rng, 5) + ".")]
    index = decontaminate.ItemIndex(items)
    texts = [some_text(rng, lead) + " " + text + " " + some_text(rng, 60) for _, text in items for lead in (0, 7, 33, 50)]
    texts += [some_text(rng, 40) + " " + " – ".join(items[3][1].split()) + " " + some_text(rng, 40), "- + =", "", None, some_text(rng, 90)]
    norm = lambda t: " " + " ".join(decontaminate.plain_words(t or "")) + " "
    wanted = {(row, i) for row, t in enumerate(texts) for i, (_, q) in enumerate(items) if norm(q) in norm(t)}
    found = {(row, item) for row, item, *_ in decontaminate.leaks(pa.array(texts), index)}
    assert wanted <= found and {(4 * i + k, i) for i in range(4) for k in range(4)} | {(16, 3)} <= wanted
    assert not {row for row, _ in found} & {17, 18, 19, 20}


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    rng = random.Random(21)
    base = [some_text(rng, 60).split() for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        near = list(words)
        near[30] = "elsewhere"
        rows += [((7, None)[k % 2], " ".join(words)), ((None, 7, 100 + k)[k % 3], " ".join(near))]
    rows += [rows[0]] * 3 + [rows[1]] * 2 + [(None, None), (None, None), (7, " "), (7, " ")]
    components = brute_components([(n, t) for n, (_, t) in enumerate(rows)])
    docs = frame(spark, rows).repartition(3)
    with_keys = docs.withColumn("row_key", near_dup._row_key())
    classes = with_keys.where("length(text) > 1").groupBy("text").agg({"row_key": "min"}).toDF("cls", "row_key")
    texts = near_dup._texts_of(classes.select("cls"), classes, with_keys.dropDuplicates(["row_key"])).collect()
    assert sorted(r.cls for r in texts) == sorted(r.text for r in texts) == sorted({t for _, t in rows if t and t.strip()})
    kept = near_dup.keep_representatives(docs).collect()
    place = {t: components[n][1] for n, (_, t) in enumerate(rows)}
    ids = {}
    for i, t in rows:
        ids.setdefault(place[t], []).append(i)
    with_words = [r for r in kept if (r.text or "").strip()]
    assert sorted(place[r.text] for r in with_words) == sorted({place[t] for _, t in rows if (t or "").strip()})
    for r in with_words:
        assert r.doc_id == min((i for i in ids[place[r.text]] if i is not None), default=None) and (r.doc_id, r.text) in rows
    assert sorted((str(r.doc_id), r.text or "") for r in kept if not (r.text or "").strip()) == [("7", " "), ("7", " "), ("None", ""), ("None", "")]
    judged = near_dup.near_duplicates(docs).collect()
    assert len(judged) == len(rows) and len({r.cls for r in judged if r.cls is not None}) == 24


CODE = "def area(w, h):\n    return w*h\n\nprint(area(3, 4))  # what is printed? 12"
LIST = "Name each:\n- the first planet\n- the second planet\n- the third planet\nMercury; Venus; Earth"
FORMULA = "If $x^2 + y^2 = 25$ and x-y=1, what is x*y? It is 12."
CHINESE = "在一个三角形中，两个角分别是四十度和六十度，那么第三个角是多少度？第三个角是八十度。"
JAPANESE = "東京から大阪までの距離は約五百キロです。時速百キロで走ると何時間かかりますか。五時間です。"


def test_items_of_all_kinds_are_found_in_other_text():
    import pyarrow as pa

    rng = random.Random(31)
    items = list(enumerate([CODE, LIST, FORMULA, CHINESE, JAPANESE, some_text(rng, 15).replace(" ", "\u00a0") + ". " + some_text(rng, 4) + "."]))
    index = decontaminate.ItemIndex(items)
    around = [some_text(rng, 50), "这里是别的文字，" * 6, "x = f(a, b); " * 9, "- one\n- two\n"]
    texts = [a + sep + item + sep + b for _, item in items for a in around for b in around for sep in (" ", "\n")] + [CHINESE.replace("，", " ， "), FORMULA.replace("+", " + ").replace("-", " - ")]
    found = {(row, item) for row, item, *_ in decontaminate.leaks(pa.array(texts), index)}
    norm = lambda t: " " + " ".join(decontaminate.plain_words(t)) + " "
    wanted = {(row, i) for row, t in enumerate(texts) for i, item in items if norm(item) in norm(t)}
    assert found == wanted and len(wanted) == len(texts)
    assert not list(decontaminate.leaks(pa.array([*around, None, "", "+ - =", "这里是别的文字" * 500]), index))


def test_an_item_with_another_answer_is_found_and_a_part_of_it_is_not():
    import pyarrow as pa

    rng = random.Random(32)
    question = some_text(rng, 30).capitalize() + "."
    index = decontaminate.ItemIndex([(1, question + " Seven."), (2, some_text(rng, 12) + ". " + some_text(rng, 12) + ".")])
    texts = [some_text(rng, 40) + " " + question + " Eight. " + some_text(rng, 40), some_text(rng, 40) + " " + " ".join(question.split()[:12]) + " " + some_text(rng, 40)]
    assert {(row, item) for row, item, *_ in decontaminate.leaks(pa.array(texts), index)} == {(0, 0)}


def test_scores_do_not_depend_on_passes(spark, monkeypatch):
    rng = random.Random(33)
    items = spark.createDataFrame([(i, some_text(rng, rng.choice([9, 20, 60])) + ". " + some_text(rng, 5) + ".") for i in range(25)] + [(30, None), (31, "--")], "item_id long, text string")
    rows = frame(spark, [(r.item_id, some_text(rng, 30) + " " + (r.text or "") + " " + some_text(rng, 70)) for r in items.collect()] + [(99, some_text(rng, 20000))])
    one = sorted(map(tuple, decontaminate.find_leaks(rows, items).collect()))
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 7)
    many = sorted(map(tuple, decontaminate.find_leaks(rows, items).collect()))
    assert [r[:2] for r in one] == [r[:2] for r in many] and len(one) >= 25
    assert all(abs(a - b) < 1e-12 for x, y in zip(one, many, strict=True) for a, b in zip(x[2:], y[2:], strict=True))


def test_stages_take_rows_as_they_come(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(41)
    good = ["\n".join(some_text(rng, 12) + "." for _ in range(8)) for _ in range(4)]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").head().text
    long = "\n".join(some_text(rng, 12) + "." for _ in range(5000))
    rows = [(1, good[0]), (1, good[0]), (1, good[1]), (None, good[2]), (None, good[2]), (None, None), (2, None), (3, ""), (4, good[0]), (5, good[3] + "\n" + item), (6, long), (7, "too short")]
    docs = spark.createDataFrame([(i, t, "x", 1, b"k", 5) for i, t in rows], "doc_id long, text string, PART string, sequence_id int, row_key binary, item_id long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        kept[name] = stage(spark, docs, sf_dir)
        if name != "packing":
            assert kept[name].schema.simpleString() == docs.schema.simpleString()
    ids = {name: sorted(((r.doc_id, r.text) for r in found.collect()), key=str) for name, found in kept.items() if name != "packing"}
    assert ids["quality rules"] == sorted([r for r in rows if r[1] and r[1] != "too short"], key=str)
    empty = [r for r in rows if not r[1]]
    assert ids["near-dedup"] == sorted([(1, good[0]), (1, good[1]), (None, good[2]), rows[9], rows[10], rows[11], *empty], key=str)
    assert ids["decontamination"] == sorted([r for r in rows if r[0] != 5], key=str)
    pieces = kept["packing"].collect()
    assert sorted(str(r.doc_id) for r in pieces if r.piece == 0) == sorted(str(i) for i, _ in rows)
    assert max(r.piece for r in pieces) > 10


def test_texts_that_share_a_passage_are_not_linked_by_it(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 1)
    rng = random.Random(51)
    passage = some_text(rng, 60)
    rows = [(i, passage + " " + some_text(rng, 25)) for i in range(0, 90, 3)]
    for i, t in rows[::3]:
        words = t.split()
        words[-1] = "changed"
        rows.append((i + 1, " ".join(words)))
        rows.append((i + 2, " ".join(words[2:])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, rows).repartition(3)).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) == 30


def test_pairs_with_one_large_band_in_common_are_compared(spark, monkeypatch):
    """40 texts share a passage and one band; two of them are linked, and have no second band in common."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 1)
    rng = random.Random(52)
    passage = some_text(rng, 40)
    rows = [(i, passage + " " + some_text(rng, 40)) for i in range(39)]
    rows.append((39, rows[7][1].rsplit(" ", 8)[0]))
    docs = frame(spark, rows).withColumn("row_key", near_dup._row_key())
    classes = docs.mapInArrow(near_dup._signatures, near_dup.MARKS).selectExpr("doc_id AS cls", "row_key", "n_shingles", "sketch", f"transform(sequence(0, {near_dup.BANDS - 1}), i -> if(i = 3, 7L, 1000 * doc_id + i)) AS bands")
    members = classes.selectExpr("7L AS key", "cls")
    roots = spark.createDataFrame([], "node long, root long")
    for prune in (True, False):
        got = near_dup._open_pairs(members, classes, roots, docs, prune).collect()
        assert [(r.a, r.b) for r in got] == [(7, 39)]
