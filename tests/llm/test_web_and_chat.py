"""URL filtering, HTML extraction and chat formatting."""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pytest
from compare import difference, oracle
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import chat, html_text, training_pages, url_filter
from spindrift.llm.boosting import BoostedTrees
from spindrift.llm.common import tokenizer_path
from spindrift.llm.dom import parse


@pytest.mark.parametrize(
    "url, host, path",
    [
        ("HTTP://WWW.Example.COM/A/b?q=/x#y", "www.example.com", "/A/b"), ("https://a.b", "a.b", ""), ("x://h#f/g", "h", ""), ("x://h?/g", "h", ""), ("no scheme", "", ""), (None, "", ""), ("", "", ""),
        ("://É.com/é", "É.com", "/é"), ("a://b/c://d/e", "b", "/c://d/e"),
    ],
)
def test_host_and_path(spark, url, host, path):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    got = url_filter.judge_urls(df, model=url_filter.UrlModel([], [])).head()
    assert (got.host, got.path) == (host, path)


def test_rules_take_the_longest(spark):
    rules = url_filter.HostRules(url_filter.RULES)
    assert rules.find("www.example.com", "/en/71") == ("example.com/en/7", "allow")
    assert rules.find("example.com", "/en/8") == ("com/en/", "block")
    assert rules.find("com", "/en/") == ("com/en/", "block") and rules.find("notexample.com", "/en/7") == ("com/en/", "block")
    assert rules.find("a.example.net", "/de/80") == ("example.net/de/8", "block") and rules.find("net", "/de/8") == ("net/de/", "allow")
    assert rules.find("org", "/es") == (None, None) and rules.find("", "") == (None, None)


def test_markov_models_are_distributions():
    model = url_filter.MarkovModel([b"abcabc", b"abd"], 3)
    for context in (b"", b"ab", b"zz", b"abc"):
        total = sum(np.exp(model._after(context[-3:], bytes([c]))) for c in range(256))
        assert abs(total - 1) < 1e-9
    assert model.log_likelihood(b"abcabc") > model.log_likelihood(b"cbacba")


def test_held_out_urls_are_told_apart(spark):
    names = ["meadow", "river", "harbour", "castle", "window", "garden", "letter", "mirror"]
    good = [f"https://{a}{b}.example.org/{k}" for a in names for b in names for k in range(3)]
    bad = [f"https://{a}-{w}{k}.example.org/{k}" for a in names for w in ("casino", "pills", "bets") for k in range(4)]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(rows).collect()}
    assert sum(got[i] == "allow" for i in range(len(good))) >= 0.99 * len(good)
    assert sum(got[i + len(good)] == "block" for i in range(len(bad))) >= 0.95 * len(bad)
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def plain_log_likelihood(strings, order, string):
    """Witten-Bell by its definition, from raw counts."""
    followed = {}
    for known in strings:
        padded = b"\x02" * order + known
        for i in range(order, len(padded)):
            for k in range(order + 1):
                followed.setdefault(padded[i - k : i], []).append(padded[i])

    def chance(context, byte):
        shorter = chance(context[1:], byte) if context else 1 / 256
        after = followed.get(context)
        if not after:
            return shorter
        kinds = len(set(after))
        return (after.count(byte) + kinds * shorter) / (len(after) + kinds)

    padded = b"\x02" * order + string
    return sum(np.log(chance(padded[i - order : i], padded[i])) for i in range(order, len(padded)))


def test_models_equal_their_definition():
    known = [b"https://abra.example/en", b"https://cadabra.example/de", b"http://abba.example/"]
    for order in (0, 2, 5):
        model = url_filter.MarkovModel(known, order)
        for string in (b"https://abra.example/de", b"zzz", b"", "é://ö".encode()):
            assert abs(model.log_likelihood(string) - plain_log_likelihood(known, order, string)) < 1e-9


def test_verdicts_equal_a_plain_version(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = url_filter.fit_urls(pages)
    urls = sorted({r.url for r in pages.collect() if r.url})
    bad_word = lambda u: any(w in url_filter.SEED_WORDS for w in re.split(r"[-.0-9]+", re.match(r"[^/?#]*", u.partition("://")[2])[0].lower()))
    good, bad = ([url_filter.model_text(u) for u in urls if bad_word(u) == kind] for kind in (False, True))
    order = {x: i for i, x in enumerate(url_filter.model_text(r.url) for r in pages.select("url").distinct().orderBy(F.xxhash64("url"), "url").collect())}
    spelled = url_filter.spelled_urls(sorted(good, key=order.get))
    verdicts = {}
    for r in url_filter.judge_urls(pages, model=model).collect():
        verdicts[r.page_id] = (r.host, r.path, r.rule, r.verdict)
    scored = 0
    for r in pages.collect():
        rest = (r.url or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(action, rule) for action, rule in url_filter.RULES for h, _, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        action, rule = max(fits, key=lambda x: len(x[1]), default=(None, None))
        if rule is None:
            text = url_filter.model_text(r.url or "")
            score = (plain_log_likelihood(spelled + bad, 5, text) - plain_log_likelihood(good, 5, text)) / max(1, len(text)) if scored < 25 or bad_word(r.url or "") else model.score(text)
            scored += 1
            action = "block" if score > model.threshold else "allow"
        assert verdicts[r.page_id] == (host, path, rule, action)
    assert scored > 10


def test_models_and_threshold_come_from_all_urls(spark):
    """More URLs than a sample of 2,000 held: counts, scores, threshold and held-out shares are those of all of them."""
    names = ["meadow", "river", "harbour", "castle", "window", "garden"]
    urls = [f"http://{a}{k % 13}.{b}/{k}" for k in range(70) for a in names for b in names] + [f"http://{a}-casino.{b}/" for a in names for b in names]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    ordered = [url_filter.model_text(r.url) for r in pages.select("url").distinct().orderBy(F.xxhash64("url"), "url").collect()]
    good, bad = ([x for x in ordered if (b"casino" in x) == kind] for kind in (False, True))
    assert len(good) == 2520 and len(url_filter.spelled_urls(good)) == 2520
    plain = url_filter.UrlModel(good, bad)
    got = url_filter.fit_urls(pages)
    letters = got.grams.where(F.shiftright("gram", 48) == 1).agg(F.sum("a4"), F.sum("r4")).head()
    assert tuple(letters) == (sum(map(len, good)), sum(map(len, url_filter.spelled_urls(good) + bad)))
    assert abs(got.threshold - plain.threshold) < 1e-6 and got.held_out == pytest.approx(plain.held_out)
    few = pages.where("page_id % 211 = 0 OR page_id >= 2520").union(spark.createDataFrame([(-1, "ftp://unseen-WORDS.é/")], pages.schema))
    for r in url_filter.judge_urls(few, [], got).join(few, "page_id").collect():
        text = url_filter.model_text(r.url)
        assert abs(r.score - plain.score(text)) < 1e-8 and (r.verdict == "block") == (r.score > got.threshold)
    text = url_filter.model_text(urls[5])
    assert abs(got.score(text) - plain.score(text)) < 1e-9


RULE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM p JOIN r ON ends_with('.' || host, '.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
SELECT page_id, host, path, rule, action FROM p LEFT JOIN m USING (page_id)
"""


def test_hosts_paths_and_rules_equal_sql(spark, sf_dir):
    got = url_filter.op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("action"))
    assert difference(got, oracle(sf_dir), RULE_SQL) is None


def test_rows_that_repeat_and_columns_that_clash(spark):
    rows = [(1, "https://a.example.org/es/1", "x", "h"), (1, "https://a.example.org/es/1", "y", "h"), (None, None, None, None), (None, "https://b.example.com/en/7x", "x", ""), (2, "", "x", ""), (3, "https://" + "long" * 20000 + ".org/", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    got = sorted(((r.page_id, r.host[:20], r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()), key=str)
    assert got == sorted([(1, "a.example.org", "org/es/", "block")] * 2 + [(None, "", None, "allow"), (None, "b.example.com", "example.com/en/7", "allow"), (2, "", None, "allow"), *[x for x in got if x[0] == 3]], key=str) and any(x[:3] == (3, "longlonglonglonglong", None) for x in got)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def trees():
    return html_text.fit_trees()


def test_trees_split_what_is_separable():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((BoostedTrees(40).fit(x, y).margins(x) > 0) == y).mean() > 0.97


def test_decoding_never_keeps_a_child_without_its_parent():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 7
        parents = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        margins = rng.normal(size=n) * 2
        best, best_score = None, -np.inf
        for bits in range(2**n):
            kept = [(bits >> i) & 1 for i in range(n)]
            if all(not kept[i] or parents[i] < 0 or kept[parents[i]] for i in range(n)):
                score = sum(-np.logaddexp(0, -m if k else m) for k, m in zip(kept, margins, strict=True))
                if score > best_score:
                    best, best_score = kept, score
        assert html_text.decode(parents, margins).astype(int).tolist() == best


def test_held_out_pages(trees):
    right = 0
    for source in training_pages.training_pages(60, 12345):
        page = parse(source)
        wanted = html_text.text_of(page, html_text.main_elements(page)).replace(training_pages.MARK, "")
        right += html_text.main_texts([source.replace(training_pages.MARK, "")], trees)[0] == wanted
    assert right >= 54


def test_pages_of_the_table(spark, sf_dir, trees):
    def article(source):
        body = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
        blocks = (re.sub(r"<[^>]*>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1)>", body))
        return "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages, trees).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_page_edges(spark, trees):
    sources = [None, "", "<", "<p", "plain words", "<html><body><article><p>A&amp;B &lt;x&gt; &nbsp; c<br>d</p><script>if (a</b) {}</script><p>E</article>", "<!-- <p>x", "<div " + "a" * 2000]
    rows = spark.createDataFrame([(i, "u", s, 1) for i, s in enumerate(sources)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r.text for r in html_text.extract(rows, trees).collect()}
    assert got[0] == got[1] == "" and got[5] == "A&B <x> c d\n\nE" and len(got) == len(sources)
    assert got[4] == "plain words"
    assert html_text.extract(rows.limit(0), trees).count() == 0


def test_foreign_elements_and_text_outside_elements(trees):
    def page(inside):
        return f"<html><body><article><p>A first sentence of the text. {inside} It goes on.</p><p>Another one ends it.</p></article></body></html>"

    def text(inside):
        return f"A first sentence of the text. {inside} It goes on.\n\nAnother one ends it."

    tail = "It goes on.\n\nAnother one ends it."
    for closed in ('<svg width="1"/>', "<math/>", "<svg class='x' />", "<math />"):
        assert html_text.main_texts([page(closed)], trees)[0].endswith(tail)
    assert html_text.main_texts([page('<svg/> between <svg><text>gone</text></svg>')], trees)[0] == text("between")
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation>E=mc^2</annotation></semantics></math>"
    assert html_text.main_texts([page(formula)], trees)[0] == text("E=mc2")
    words = "The river rose in the night, and by morning the lower fields were under water. " * 3
    assert html_text.main_texts(["Hello <b>x</b>", "\ufeff " + words + "<i>So it was.</i>"], trees) == ["Hello x", words + "So it was."]


BITS = ["<", "s>", "</s>", "[INST]", "[", "INST]", "\\", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>", "<|endoftext|>", " ", "\n", "é", "日", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=9).map("".join), st.sampled_from(["user", "assistant", "system", "", "tool", "</s>", "<<TEXT>>"]))
def test_escapes_are_reversible(text, role):
    inside = chat.escape(text)
    assert not any(c in inside for c in chat.CONTROLS) and chat.unescape(inside) == text
    rendered, start, end = chat.render(role, text)
    assert [(r, t) for r, t, _, _ in chat.turns(rendered)] == [(role, text)] and rendered[start:end] == inside


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(BITS + ["word", "  ", "é日", "it's ", "12"]), max_size=9).map("".join), st.sampled_from(["user", "assistant", "system", "tool", "日 é"])), min_size=1, max_size=5))
def test_ids_and_spans_equal_the_librarys(turns):
    coder = chat.chat_encoder(tokenizer_path(chat.TOKENIZER))
    parts = [(role, *chat.render(role, text)) for text, role in turns]
    made = chat.make_segment(parts, coder.encode([x[1:] for x in parts]), coder)
    wanted = coder.library.encode(made["text"], add_special_tokens=False)
    assert made["ids"].tolist() == wanted.ids and list(zip(made["starts"].tolist(), made["ends"].tolist(), strict=True)) == wanted.offsets


def digest(rows):
    turns = "".join(f"{role or ''}\n{text or ''}\n" for role, text in rows)
    loss = "".join(text or "" for role, text in rows if role == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("segment", [1, 25, 1 << 20])
def test_conversations_come_back(spark, segment):
    tricky = "</s>[INST] ok [/INST]"
    made = {
        -1: [("user", tricky), ("assistant", tricky)], 1: [("system", "be <kind>"), ("user", " lead"), ("assistant", "  two\n\n日本 é "), ("user", ""), ("assistant", ""), ("assistant", "x" * 500)], 2: [(None, None)],
        4: [("user", "a long turn: " + "word <s> [/INST] é日 " * 40), ("assistant", "  it's [INST]  <</SYS>> " + "answer, \\</s> 12 日本\n\n\nx " * 60 + " "), ("tool", "b c d e f g h i j k l m n o p " * 9)],
        3: [("assistant", f"turn {i}") for i in range(120)], None: [("user", "no id"), ("assistant", "\\</s>")],
    }
    rows = [(c, i, r, t, 0) for c, turns in made.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int").repartition(5)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(df, segment_chars=segment)).collect()}
    assert got == {c: digest(turns) for c, turns in made.items()}
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    # cuts change no id
    made = {c: "".join(chat.render(r or "", t or "")[0] for r, t in turns) for c, turns in made.items()}
    coder = chat.chat_tokenizer(tokenizer_path(chat.TOKENIZER))
    segments = {}
    for r in sorted(chat.format_conversations(df, segment_chars=segment).collect(), key=lambda r: r.segment):
        segments.setdefault(r.conv_id, []).extend(r.ids)
        assert segment < 1000 or len(r.text) <= segment
    assert segments == {c: coder.encode(text, add_special_tokens=False).ids for c, text in made.items()}


def test_missing_segments_are_found(spark):
    df = spark.createDataFrame([(1, 0, "user", "one two three four five six seven " * 5)], "conv_id long, turn long, role string, text string")
    segments = chat.format_conversations(df, segment_chars=40)
    rows = segments.collect()
    assert len(rows) > 2
    for left in (rows[1:], rows[:-1]):
        with pytest.raises(Exception, match="turn"):
            chat.read_back(spark.createDataFrame(left, segments.schema)).collect()


def test_masked_texts_leave_gaps_out():
    text, starts, ends = "abcdefgh", np.array([0, 2, 2, 5, 6]), np.array([2, 4, 5, 6, 8])
    for mask, spans, wanted in (([1] * 5, [(1, 7)], ["bcdefg"]), ([1, 0, 0, 1, 1], [(0, 8)], ["abfgh"]), ([0, 1, 1, 0, 0], [(0, 1), (3, 8)], ["", "de"]), ([0] * 5, [(0, 8)], [""])):
        assert list(chat.masked_texts(text, starts, ends, np.array(mask, bool), spans)) == wanted


def test_masks_equal_a_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(50):
        ends = np.cumsum(rng.integers(1, 4, 30))
        starts = ends - rng.integers(0, 3, 30).clip(0, 1) - 1
        cuts = np.sort(rng.choice(60, 8, replace=False))
        a, b = cuts[::2], cuts[1::2]
        plain = [any(s < y and x < e for x, y in zip(a, b, strict=True)) for s, e in zip(starts, ends, strict=True)]
        assert chat.mask_tokens(starts, ends, a, b).tolist() == plain


STORY = ["The harbour was built in 1874, and it was too small from the first day.", "Ships waited outside for a week; their captains wrote letters that nobody answered.", "In the end the town paid for a second mole, and the letters stopped."]
#: Layouts as people write them, none from the generator that the trees are fitted on; main text is STORY, between h1 and end.
LAYOUTS = {
    "blog": """<!doctype html><html><head><title>t</title></head><body class="home single"><div id="page" class="site"><header id="masthead" class="site-header"><a href="/">The Quay</a><nav class="main-navigation"><ul><li><a href="/">Home</a></li>
        <li><a href="/about">About us</a></li></ul></nav></header><div id="primary" class="content-area"><main class="site-main"><article class="post-12 post type-post hentry"><header class="entry-header"><h1 class="entry-title">{h1}</h1></header>
        <div class="entry-content">{body}</div></article><div id="comments" class="comments-area"><h2>Two thoughts</h2><ol class="comment-list"><li class="comment"><p>I was there once. It rained all week.</p></li></ol></div></main></div>
        <aside id="secondary" class="widget-area"><section class="widget"><h2>Recent</h2><ul><li><a href="/1">Old cranes</a></li></ul></section></aside><footer id="colophon" class="site-footer">Proudly made by hand.</footer></div></body></html>""",
    "news": """<html><body><div class="cookie-consent">We use cookies. <button>Accept</button></div><header><nav><a href=/w>World</a> <a href=/s>Sport</a></nav></header><main><article class="story"><h1>{h1}</h1>{body}
        <aside class="related"><h3>Read next</h3><a href="/x">Lighthouse sold</a></aside></article></main><footer><p>&copy; Evening Post. All rights reserved.</p></footer></body></html>""",
    "manual": """<html><body><div class="sidebar"><ul><li><a href="a">Start</a></li><li><a href="b">Install</a></li><li><a href="c">Use</a></li></ul></div><div class="body" role="main"><section id="harbour"><h1>{h1}</h1>{body}</section></div>
        <div class="footer">Last built on Monday.</div></body></html>""",
    "plain": """<html><body><div class="nav"><a href="/">Start</a> | <a href="/a">Archive</a></div><div class="content"><h1>{h1}</h1>{body}</div><div class="footer">Copyright by the town</div></body></html>""",
    "shop": """<html><body><div class="promo">Sale! Everything must go. <a href="/sale">Look</a></div><form class="search"><input name=q><button>Find</button></form><section class="page-content"><h1>{h1}</h1>{body}</section>
        <div class="newsletter-signup"><p>Get our letter every week.</p></div><ul class="social"><li><a href="/f">Follow</a></li></ul></body></html>""",
    "bare": """<h1>{h1}</h1>{body}""",
}


def test_layouts_that_others_write(trees):
    body = "".join(f"<p>{x}</p>" for x in STORY)
    wanted = "\n\n".join(["The second mole", *STORY])
    got = {name: html_text.main_texts([layout.format(h1="The second mole", body=body)], trees)[0] for name, layout in LAYOUTS.items()}
    right = [name for name, text in got.items() if text == wanted]
    assert all(x in text for text in got.values() for x in STORY), got
    assert len(right) >= len(LAYOUTS) - 1, {k: v for k, v in got.items() if v != wanted}


def test_pages_that_repeat_and_columns_that_clash(spark, trees):
    page = "<article><p>" + "It was a long night on the river. " * 3 + "</p></article>"
    long = "<html><body><nav><a href=x>Menu</a></nav><article>" + "<p>One more sentence of a very long text, as it goes.</p>" * 20000 + "</article></body></html>"
    rows = [(1, "u", page, "x", 0), (1, "u", page, "y", 0), (None, None, page, "x", 0), (None, None, None, None, None), (2, "v", long, "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(df, trees).collect()
    assert sorted(map(str, (r.page_id for r in got))) == ["1", "1", "2", "None", "None"]
    assert {r.text for r in got if r.page_id == 1} == {("It was a long night on the river. " * 3).strip()} and all(r.n_chars == len(r.text) for r in got)
    assert next(r.text for r in got if r.page_id == 2).count("One more sentence") == 20000
    assert html_text.extract(df.limit(0), trees).count() == 0


FIRST, SECOND = (" ".join(f"{w}{i} and so the story of the river goes on, told at length." for i in range(12)) for w in ("one", "two"))


@pytest.mark.parametrize("between", [
    "<!-->", "<!--->", "<!-- a --!>", "<!-- a -->", "<!---->", "<div><svg><path d='x'></div>", "<svg><path d='x'>", "<svg><g><svg/><title>Icon</svg>", "<div><video src=a></div>", "<div><audio src=a></div>",
    "<div><canvas id=c></div>", "<div><object data=x></div>", "<div><template><p>hidden</div>", "<div><select><option>a<option>b</div>", "<select><option>a", "<object><object>x</object>y</object>",
    "<object><p>x</p><div>y</div></object>", "<video><source src=a>no video</video>", "<video><video>x</video>y</video>", "<svg><foreignObject><p>x</p></foreignObject><text>y</text></svg>",
    "<div><svg><a href=x><text>y</text></div>", "<canvas><p>x</p></canvas>", "<svg><style>p{}</svg>", "<script>'<p>'</script>", "<p><svg><path></p>",
])
def test_what_is_not_shown_hides_nothing_else(between):
    page = parse(f"<html><body><article><p>{FIRST}</p>{between}<p>{SECOND}</p></article></body></html>")
    assert " ".join(t for _, _, t in page.texts).split() == f"{FIRST} {SECOND}".split()
    places = {page.tags[node] for node, _, text in page.texts if text.strip()}
    assert places == {"p"} and not any(page.linked)
    assert len({block for _, block, text in page.texts if text.strip()}) == 2
