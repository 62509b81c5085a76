"""Main text of web pages by boosted trees over DOM nodes.

The page becomes a tree of block-level nodes (see dom). Boosted trees, learnt from pages made by sample_pages, give each
node the log-odds that its text belongs to the article. A dynamic program over the tree then picks a state for each
node: all article, all not, or mixed, which only a node with children can be and which costs MIXED. Descendants of a
node that is all article, or all not, follow it, so choices never contradict each other.

Null and empty html has empty text. Text outside any markup is a block like others. Repeated rows give the same text.
No pages give no rows. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.llm.boosting import Boosted, fit
from mixlens.llm.common import with_python
from mixlens.llm.dom import Page, features, parse
from mixlens.llm.sample_pages import Maker

PAGES = 1000
SEED = 20240917
MIXED = 1.5
LIMIT = 4.0

_MODEL: list[Boosted] = []


def labelled(count: int, seed: int) -> list[tuple[Page, np.ndarray]]:
    """Made pages with the share of each node's text that is of the article; nan where it has none."""
    out = []
    maker = Maker(seed)
    for _ in range(count):
        page = parse(maker.page())
        size, good = np.zeros(len(page.tags)), np.zeros(len(page.tags))
        for owner, text in page.blocks:
            bare = len(text.replace("\x01", "").replace("\x02", ""))
            while owner >= 0:
                size[owner] += bare
                good[owner] += bare * (text[0] == "\x01")
                owner = page.parents[owner]
        page.blocks = [(k, t.replace("\x01", "").replace("\x02", "")) for k, t in page.blocks]
        with np.errstate(invalid="ignore"):
            out.append((page, good / size))
    return out


def model() -> Boosted:
    """The trees, learnt once in a process; the same each time."""
    if not _MODEL:
        made = labelled(PAGES, SEED)
        x = np.concatenate([features(p) for p, _ in made])
        share = np.concatenate([s for _, s in made])
        pure = (share <= 0.02) | (share >= 0.98)
        _MODEL.append(fit(x[pure], (share[pure] > 0.5).astype(float)))
    return _MODEL[0]


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Whether each text block is kept: the best states of the tree, each node counting once if it has text."""
    n = len(page.tags)
    odds = np.clip(odds, -LIMIT, LIMIT)
    texts = np.zeros(n, np.int64)
    for owner, _ in page.blocks:
        texts[owner] += 1
    filled = texts > 0
    for k in range(n - 1, 0, -1):
        filled[page.parents[k]] |= filled[k]
    keep, drop = np.where(filled, odds, 0.0), np.where(filled, -odds, 0.0)
    # a mixed node judges its own text by itself; its children choose freely
    mixed = np.where(texts > 0, np.abs(odds), 0.0) - MIXED
    nested = np.zeros(n, bool)
    for k in range(n - 1, 0, -1):
        p = page.parents[k]
        if filled[k]:
            nested[p] = True
        best = max(keep[k], drop[k], mixed[k] if nested[k] else -np.inf)
        keep[p] += keep[k]
        drop[p] += drop[k]
        mixed[p] += best
    state = np.zeros(n, np.int8)  # 1 keep, -1 drop, 0 mixed
    for k in range(n):
        above = state[page.parents[k]] if k else 0
        if above:
            state[k] = above
        elif nested[k] and mixed[k] > max(keep[k], drop[k]):
            state[k] = 0
        else:
            state[k] = 1 if keep[k] > drop[k] else -1
    return [state[owner] > 0 or (state[owner] == 0 and odds[owner] > 0) for owner, _ in page.blocks]


class Extractor:
    def __init__(self, trees: Boosted) -> None:
        self.trees = trees

    def __call__(self, sources: list[str | None]) -> list[list]:
        pages = [parse(s) for s in sources]
        made = [features(p) for p in pages]
        odds = np.split(self.trees(np.concatenate(made)), np.cumsum([len(x) for x in made])[:-1]) if made else []
        return [["\n".join(t for (_, t), kept in zip(p.blocks, decode(p, o), strict=True) if kept) for p, o in zip(pages, odds, strict=True)]]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model())
    made = with_python(pages.select("page_id", "url", "html"), ["html"], ["page_id", "url"], "text string", lambda: Extractor(shared.value), rows=64)
    return made.withColumn("n_chars", F.length("text").cast("long"))
