"""Main text of web pages: boosted trees over DOM elements, decoded along the tree.

*Features* of an element (``dom.FEATURES``) describe its subtree's text and link density, tag, class, id and role
words, depth, siblings and place. *Labels* come from pages that mark their article with ``<article>`` or
``<main>``. Each is also rebuilt in other layouts (``_variants``), with the article in a plain container and with
menus, side bars, notices, adverts, forms and comments around and inside it, so that the trees learn the
features and not one template. At most ``TRAINING_PAGES`` pages are used, the first by a hash of their ids.

*Scoring* turns MLlib's boosted trees into arrays that every task evaluates for its own pages, so the pages
themselves are never shuffled. *Decoding* finds the best labelling in which every path from the root reads
outside, then inside, then dropped: an element is never kept below one that was dropped, and switching costs
``SWITCH``.

Defined results: null or empty html gives an empty text; null urls and ids pass through; repeated rows come
back as often as they came; an empty table gives an empty result; if no page marks its article, elements
are scored by a fixed rule on tags and attribute words; extra columns are ignored. Pages are parsed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import FEATURES, FORM, OFF, RAW, Page
from .frames import pick, prepare, stage

TRAINING_PAGES = 160
TREES, DEPTH = 12, 4
SWITCH = 1.0


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees as arrays: leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 2 * total  # MLlib's logistic loss puts the log-odds at twice the margin


def _as_arrays(model) -> Trees:
    """Read a fitted MLlib ``GBTClassificationModel`` into arrays (its nodes are few: trees x 2**depth)."""
    out: list[list] = []

    def walk(node, weight: float) -> int:
        at = len(out)
        out.append([0, 0.0, at, at, weight * node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            out[at][:2] = [split.featureIndex(), split.threshold()]
            out[at][2] = walk(node.leftChild(), weight)
            out[at][3] = walk(node.rightChild(), weight)
        return at

    roots = [walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree.rootNode(), w)
             for tree, w in zip(model.trees, model.treeWeights)]
    columns = list(zip(*out))
    return Trees(np.array(columns[0], np.int64), np.array(columns[1]), np.array(columns[2], np.int64), np.array(columns[3], np.int64),
                 np.array(columns[4]), np.array(roots), max((t.depth for t in model.trees), default=0))


def _rule_scores(page: Page, x: np.ndarray) -> np.ndarray:
    """Scores without a model: adverse tags or words above count against, text without links counts for."""
    column = {name: k for k, name in enumerate(FEATURES)}
    adverse = x[:, column["off_above"]] + x[:, column["bad_above"]] + x[:, column["form_above"]]
    return np.where(adverse > 0, -2.0, np.where((x[:, column["links"]] < 0.5) & (x[:, column["log_chars"]] > 0), 1.0, -0.5))


def decode(parents: list[int], tags: list[str], scores: np.ndarray, own: np.ndarray) -> list[bool]:
    """The elements inside the main text: the best outside / inside / dropped labelling of the tree."""
    n = len(parents)
    gains = (np.clip(scores, -4, 4) * (1 + own)).tolist()
    outside, inside, dropped = [-g for g in gains], gains[:], [-g for g in gains]
    for v in range(n - 1, 0, -1):
        p = parents[v]
        if tags[v] in RAW:
            inside[v] = -1e9
        outside[p] += max(outside[v], inside[v] - SWITCH)
        inside[p] += max(inside[v], dropped[v] - SWITCH)
        dropped[p] += dropped[v]
    state = [0] * n
    state[0] = int(inside[0] - SWITCH > outside[0])
    for v in range(1, n):
        above = state[parents[v]]
        if above == 0:
            state[v] = int(inside[v] - SWITCH > outside[v])
        elif above == 1:
            state[v] = 1 if inside[v] >= dropped[v] - SWITCH else 2
        else:
            state[v] = 2
    return [s == 1 for s in state]


def main_text(source: str, trees: Trees | None) -> str:
    page = Page(source)
    x = page.features()
    scores = trees.log_odds(x) if trees is not None else _rule_scores(page, x)
    return page.text(decode(page.parents, page.tags, scores, x[:, 1]))


# ---------------------------------------------------------------- training pages

_CONTAINERS = ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="entry"', "div"]


def _inner(source: str, tag: str) -> tuple[str, str, str] | None:
    """Source before, within and after the first such element (pages nest them rarely; the last end counts)."""
    low = source.lower()
    start = low.find(f"<{tag}")
    begin = low.find(">", start) + 1
    end = low.rfind(f"</{tag}")
    return (source[:start], source[begin:end], source[end:]) if 0 <= start < begin <= end else None


def _variants(source: str, number: int) -> Iterator[str]:
    """The page, and its article in other layouts. ``data-keep`` marks the article, ``data-drop`` parts to drop."""
    tag = next((t for t in ("article", "main") if f"<{t}" in source.lower()), None)
    cut = _inner(source, tag) if tag else None
    if cut is None:
        return
    before, inner, after = cut
    yield f"{before}<{tag} data-keep>{inner}{after}"
    article = Page(inner)
    lines = [line for line in article.text([True] * len(article.tags)).split("\n") if line] or ["-"]
    pick_line = lambda k: lines[k % len(lines)][:160]
    links = "".join(f'<li><a href="/{k}">{pick_line(k)[:18]}</a></li>' for k in range(5))
    notes = [f'<div class="cookie-notice"><p>{pick_line(1)}</p><button>OK</button></div>',
             f'<div class="notice">{pick_line(2)}</div>', f'<div class="banner"><p>{pick_line(0)}</p></div>']
    menus = [f"<nav><ul>{links}</ul></nav>", f'<div class="menu"><ul>{links}</ul></div>', f'<ul id="navbar">{links}</ul>']
    heads = [f"<header><div>{pick_line(0)[:30]}</div></header>", f'<div id="header"><a href="/">{pick_line(0)[:30]}</a></div>', ""]
    sides = [f"<aside><h2>{pick_line(1)[:20]}</h2><p>{pick_line(2)}</p><ul>{links}</ul></aside>",
             f'<div class="sidebar"><h3>{pick_line(2)[:20]}</h3><p>{pick_line(0)}</p></div>', f'<div class="related"><ul>{links}</ul></div>']
    adverts = [f'<div class="ad">{pick_line(1)}</div>', f'<div class="sponsored"><p>{pick_line(2)}</p></div>', f'<section id="promo"><p>{pick_line(0)}</p></section>']
    forms = [f'<form><label>{pick_line(0)[:20]}</label><input name="q"><button>{pick_line(1)[:10]}</button></form>',
             f'<div class="newsletter"><p>{pick_line(1)}</p><form><input><button>OK</button></form></div>', ""]
    comments = [f'<section class="comments"><h3>{pick_line(0)[:20]}</h3><div class="comment"><p>{pick_line(1)}</p></div><div class="comment"><p>{pick_line(2)}</p></div></section>',
                f'<div id="comments"><ol><li><p>{pick_line(2)}</p></li><li><p>{pick_line(0)}</p></li></ol></div>', ""]
    foots = [f"<footer>&copy; {pick_line(0)[:40]} <p>{pick_line(1)}</p></footer>", f'<div class="footer"><p>{pick_line(2)}</p></div>', f'<div id="footer">{pick_line(1)}</div>']
    for k in range(3):
        r = number * 3 + k
        at = lambda options, step: options[(r // step) % len(options)]
        container = at(_CONTAINERS, 1)
        mid = inner.find("</p>") + 4
        dropped = at([at(adverts, 2), at(forms, 3), at(comments, 2), ""], 1).replace("<", "<!-- --><", 1)
        dropped = f"<div data-drop{' class=' + repr('ad') if r % 2 else ' class=' + repr('share')}>{dropped}{pick_line(r)}</div>" if r % 3 else ""
        body = inner[:mid] + dropped + inner[mid:] if mid >= 4 else inner + dropped
        yield (f"<html><body>{at(heads, 2)}{at(menus, 1)}{at(notes, 3)}{at(adverts, 1) if r % 2 else ''}<div><{container} data-keep>{body}</{container.split()[0]}>"
               f"{at(comments, 1)}{at(sides, 2)}</div>{at(forms, 2)}{at(foots, 1)}</body></html>")
    # all parts side by side
    container = _CONTAINERS[number % (len(_CONTAINERS) - 1)]
    around = [*heads, *menus, *notes, *adverts, *sides, *forms, *comments, *foots]
    turn = number % len(around)
    around = around[turn:] + around[:turn]
    middle = len(around) // 2
    yield (f"<html><body>{''.join(around[:middle])}<{container} data-keep>{inner}</{container.split()[0]}>"
           f"{''.join(around[middle:])}</body></html>")


def _labelled(page: Page) -> np.ndarray:
    """1 for elements in the marked article and not in a marked or plainly adverse part of it."""
    inside = np.zeros(len(page.tags), bool)
    gone = np.zeros(len(page.tags), bool)
    for v in range(1, len(page.tags)):
        p = page.parents[v]
        inside[v] = inside[p] or "data-keep" in page.attributes[v]
        gone[v] = gone[p] or "data-drop" in page.attributes[v] or (inside[p] and page.tags[v] in OFF | FORM | RAW)
    return inside & ~gone


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, source in zip(batch.column("number").to_pylist(), batch.column("html").to_pylist()):
            for variant in _variants(source or "", number):
                page = Page(variant)
                x, y = page.features(), _labelled(page)
                keep = np.array([t not in RAW for t in page.tags])
                x, y = x[keep], y[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1))),
                     pa.array(y.astype(np.float64))], ["x", "label"])


def fit(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> Trees | None:
    """Boosted trees from at most ``training_pages`` pages with a marked article; None if there are none.

    ``pages`` has ``id`` and ``html``.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    marked = F.lower("html").rlike("<(article|main)[\\s>]")
    # of rows that share an id, the one with the smallest html
    marked_pages = pages.where(marked & F.col("id").isNotNull())
    first = (marked_pages.select("id", F.xxhash64("id").alias("h")).distinct().orderBy("h", "id").limit(training_pages).collect())
    if not first:
        return None
    ids = sorted({r["id"] for r in first})
    number = F.create_map(*[F.lit(v) for k, i in enumerate(ids) for v in (i, k)])
    chosen = (marked_pages.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("html").alias("html"))
              .select(F.element_at(number, F.col("id")).alias("number"), "html"))
    rows = stage(chosen.mapInArrow(_training_rows, "x array<double>, label double"), "training")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    train = rows.select(array_to_vector("x").alias("features"), "label").coalesce(4).persist()
    try:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=7, maxBins=48, cacheNodeIds=False).fit(train)
        return _as_arrays(model)
    finally:
        train.unpersist()


def _extracted(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s or "", trees) for s in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    return run


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """Per row: the id, the url, ``text`` (blocks joined by a newline) and ``n_chars`` (code points)."""
    prepare(df.sparkSession)
    pages = pick(df, id=id_col, url=url_col, html=html_col)
    kind = pages.schema["id"].dataType.simpleString()
    model = trees if trees is not None else fit(pages)
    out = pages.mapInArrow(_extracted(model), f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
