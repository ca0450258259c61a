"""Main text of web pages: boosted trees over the elements' features, decoded along the tree.

Each element of a page (``dom``) gets the log-odds, from gradient-boosted trees, that it holds
main text. The decision is taken for the whole tree at once: an element can be kept only if its
parent is, and of all choices that obey this the likeliest is found by one pass from the leaves
up and one back down. The trees are fitted on pages that ``training_pages`` writes, whose main
text is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.boosting import BoostedTrees
from spindrift.llm.common import executors_can_import, text_slices
from spindrift.llm.dom import Page, parse
from spindrift.llm.training_pages import MARK, training_pages

#: Pages that the trees are fitted on.
TRAINING_PAGES, SEED = 700, 7
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "figure", "figcaption", "blockquote", "pre", "span", "body", "dialog", "menu", "button", "label"]
#: Words of class, id and role that speak for one kind of element.
WORDS = {
    "main": "article articlebody content contents entry main post postbody story text body page prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toc pagination pager topnav subnav",
    "header": "header masthead banner logo topbar branding site sitehead hero",
    "footer": "footer foot copyright colophon legal imprint contentinfo bottom",
    "side": "sidebar aside side related widget widgets rail recommended complementary trending popular tags more",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense adslot teaser dfp outbrain taboola commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall banner message warning disclaimer dialog",
    "form": "form search login register contact searchbox signin field input",
    "comment": "comment comments reply replies respond disqus discussion reader feedback response responses",
    "share": "share sharing social follow tweet facebook meta byline author print",
}
_KIND_OF = {word: kind for kind, words in WORDS.items() for word in words.split()}
_KINDS = {kind: i for i, kind in enumerate(WORDS)}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOPS = re.compile(r"[.!?…。]")


@lru_cache(maxsize=4096)
def kinds_of(names: str) -> tuple[int, ...]:
    """Kinds that the words of an element's names speak for."""
    words = _SPLIT.split(_CAMEL.sub(" ", names).lower())
    return tuple({_KINDS[_KIND_OF[w]] for w in words if w in _KIND_OF})


def features(page: Page) -> np.ndarray:
    """A row for each element: its tag and names, its ancestors', its subtree's text, links and tags, its place."""
    n, k = len(page.tags), len(_KINDS)
    own = np.zeros((n, k))
    above = np.zeros((n, k))
    tag = np.zeros((n, len(TAGS)))
    tag_above = np.zeros((n, len(TAGS)))
    size, linked, stops, direct = (np.zeros(n) for _ in range(4))
    before = np.zeros(n)
    elements, paragraphs, items, inputs = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    depth, index, hidden = np.zeros(n), np.zeros(n), np.zeros(n)
    children = np.zeros(n)
    texts_of: dict[int, int] = {}
    total = 0
    for (node, _, text), link in zip(page.texts, page.linked, strict=True):
        length = len(text.strip())
        if node >= 0 and length:
            size[node] += length
            direct[node] += length
            stops[node] += len(_STOPS.findall(text))
            linked[node] += length * link
            texts_of.setdefault(node, total)
        total += length
    for i in range(n):
        name, parent, given = page.tags[i], page.parents[i], page.attributes[i]
        if given:
            names = " ".join(given[a] for a in ("class", "id", "role", "itemprop", "aria-label") if a in given)
            own[i, list(kinds_of(names))] = 1
            hidden[i] = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        if name in TAGS:
            tag[i, TAGS.index(name)] = 1
        paragraphs[i], items[i], inputs[i] = name == "p", name in ("li", "a"), name in ("input", "button")
        if parent >= 0:
            above[i] = np.maximum(own[parent], above[parent])
            tag_above[i] = np.maximum(tag[parent], tag_above[parent])
            depth[i] = depth[parent] + 1
            hidden[i] = max(hidden[i], hidden[parent])
            index[i] = children[parent]
            children[parent] += 1
        before[i] = texts_of.get(i, -1)
    for i in range(n - 1, -1, -1):
        parent = page.parents[i]
        if parent >= 0:
            for sums in (size, linked, stops, elements, paragraphs, items, inputs):
                sums[parent] += sums[i]
            if before[i] >= 0 and (before[parent] < 0 or before[i] < before[parent]):
                before[parent] = before[i]
    siblings = np.array([children[p] if p >= 0 else 1 for p in page.parents])
    part = np.array([size[p] if p >= 0 else max(total, 1) for p in page.parents])
    some = np.maximum(size, 1)
    rest = np.stack(
        [
            np.log1p(size), np.log1p(direct), size / max(total, 1), size / np.maximum(part, 1), linked / some, stops / some, elements / some, paragraphs / elements, items / elements, np.log1p(paragraphs),
            inputs, depth, index, index / np.maximum(siblings, 1), np.log1p(siblings), np.maximum(before, 0) / max(total, 1), hidden,
        ],
        axis=1,
    )
    return np.hstack((own, above, tag, tag_above, rest))


def decode(parents: list[int], margins: np.ndarray) -> np.ndarray:
    """The likeliest choice of elements in which none is kept without its parent."""
    n = len(parents)
    # log-likelihood of keeping an element with its best choice below, and of dropping it with all below
    keep, drop = -np.logaddexp(0, -margins), -np.logaddexp(0, margins)
    for i in range(n - 1, -1, -1):
        if parents[i] >= 0:
            keep[parents[i]] += max(keep[i], drop[i])
            drop[parents[i]] += drop[i]
    kept = np.zeros(n, bool)
    for i in range(n):
        kept[i] = keep[i] > drop[i] and (parents[i] < 0 or kept[parents[i]])
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    """The kept elements' text: white space within a block is one space, blocks are two line ends apart."""
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        if node >= 0 and kept[node]:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


def main_elements(page: Page) -> np.ndarray:
    """Labels of a training page: the elements that hold text marked as main."""
    main = np.zeros(len(page.tags), bool)
    for node, _, text in page.texts:
        if MARK in text:
            while node >= 0 and not main[node]:
                main[node] = True
                node = page.parents[node]
    return main


@lru_cache(maxsize=2)
def fit_trees(pages: int = TRAINING_PAGES, seed: int = SEED) -> BoostedTrees:
    """Trees fitted on ``pages`` written pages; in these, main text carries a private-use mark. Fitted once in a process."""
    parsed = [parse(x) for x in training_pages(pages, seed)]
    labels = np.concatenate([main_elements(p) for p in parsed])
    for p in parsed:
        p.texts = [(node, block, text.replace(MARK, "")) for node, block, text in p.texts]
    return BoostedTrees().fit(np.concatenate([features(p) for p in parsed]), labels.astype(float))


def main_texts(sources: list[str | None], trees: BoostedTrees) -> list[str]:
    """The main text of each page; null and empty pages have none."""
    parsed = [parse(x or "") for x in sources]
    parsed_features = [features(p) for p in parsed]
    margins = trees.margins(np.concatenate(parsed_features)) if parsed else np.empty(0)
    at, found = 0, []
    for p in parsed:
        found.append(text_of(p, decode(p.parents, margins[at : at + len(p.tags)])))
        at += len(p.tags)
    return found


def extract(pages: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    ``text`` is empty if there is no main text; ``n_chars`` counts its code points. Pages are
    taken whole. Null html counts as empty. Repeated and null page_ids are kept as they come;
    other columns, whatever their names, are left out. An empty table gives an empty one.
    Text outside all elements is judged as an article's. Content that no browser shows goes:
    scripts, styles, templates, what stands in for frames and media, drawings, form controls.
    """
    spark = pages.sparkSession
    executors_can_import(spark)
    known = spark.sparkContext.broadcast(trees or fit_trees())  # its size is fixed by the trees' number and depth

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2 << 20, "html"):
            texts = main_texts(part.column("html").to_pylist(), known.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extracted, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
