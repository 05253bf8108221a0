"""Main text of web pages: a graphical model over the tree of a page's blocks.

Every element and every run of text is a node that is content or not. A node's
own evidence is a weighted sum of features (kind of element, hints in its
attributes, length, share of linked text, sentence ends). Each edge between a
parent and a child has a potential for the four cases of the two, by the
child's kind. As the graph is a tree, one pass of messages from the leaves to
the root and one back give exact marginals (sum-product). Weights and
potentials are learned from labelled pages by the gradient of the likelihood,
which is the difference between counted and expected features.

The pages of a portion are one forest whose levels are NumPy arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchwork.llm.common import portions, ship
from stitchwork.llm.page_tree import HINT_NAMES, KIND_NAMES, Tree, labelled_pages, parse

#: Labelled pages that a model learns from, at most.
SAMPLE_PAGES = 500
STEPS = 200
RATE = 0.1
RIDGE = 2e-4
#: Characters of pages that one forest holds.
PORTION_CHARS = 2_000_000

_COUNTS = ("chars", "linked", "endings", "rights")
#: Kinds whose presence above a node is a feature of the node.
_ABOVE_KINDS = tuple(KIND_NAMES.index(k) for k in ("main", "nav", "header", "footer", "aside", "form"))
#: Places in the feature vector: own measures, kind, hints, and what the elements above are.
_KIND = 8
_HINT = _KIND + len(KIND_NAMES)
_ABOVE = _HINT + len(HINT_NAMES)
FEATURES = _ABOVE + len(HINT_NAMES) + len(_ABOVE_KINDS)


@dataclass
class Model:
    weights: np.ndarray  #: by feature: evidence for content
    pairs: np.ndarray  #: by the child's kind, parent's state, child's state


@dataclass
class Forest:
    """Nodes of many pages; ``levels`` holds those of each depth, the roots first."""

    parent: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    levels: list[np.ndarray]
    chars: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    sizes = [len(t.parent) for t in trees]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.zeros(0, np.int64)
    join = lambda name: np.concatenate([np.array(getattr(t, name), np.int64) for t in trees])
    parent = join("parent") + np.repeat(starts, sizes)
    depth, kind, hints = join("depth"), join("kind"), join("hints")
    levels = np.split(depth.argsort(kind="stable"), np.cumsum(np.bincount(depth))[:-1])
    counts = np.stack([join(name) for name in _COUNTS], axis=1).astype(np.float64)
    for level in levels[:0:-1]:
        np.add.at(counts, parent[level], counts[level])
    signs = hints.copy()
    for bit, number in enumerate(_ABOVE_KINDS, len(HINT_NAMES)):
        signs |= (kind == number).astype(np.int64) << bit
    above = np.zeros(len(parent), np.int64)
    for level in levels[1:]:
        above[level] = above[parent[level]] | signs[parent[level]]
    chars, linked, endings, rights = counts.T
    page = np.repeat(counts[starts, 0], sizes)
    whole = np.maximum(chars, 1)
    features = np.zeros((len(parent), FEATURES))
    features[:, :_KIND] = np.stack([
        np.ones(len(parent)), np.log1p(chars) / 6, linked / whole, np.minimum(1, 40 * endings / whole), chars / np.maximum(page, 1),
        chars < 25, rights > 0, (rights > 0) & (chars < 400)], axis=1)
    features[np.arange(len(parent)), _KIND + kind] = 1
    for place, bits, n in ((_HINT, hints, len(HINT_NAMES)), (_ABOVE, above, FEATURES - _ABOVE)):
        features[:, place:place + n] = bits[:, None] >> np.arange(n) & 1
    return Forest(parent, kind, features, levels, chars)


def marginals(model: Model, woods: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content by node, and of the joint states by edge (parent, child): 00, 01, 10, 11; a root's are zero.

    Messages are log-odds of content.
    """
    n = len(woods.parent)
    belief = woods.features @ model.weights  # own evidence, then what the children say
    e00, e01, e10, e11 = model.pairs.reshape(-1, 4)[woods.kind].T
    upward = np.zeros(n)
    for level in woods.levels[:0:-1]:
        own = belief[level]
        upward[level] = np.logaddexp(e11[level] + own, e10[level]) - np.logaddexp(e01[level] + own, e00[level])
        np.add.at(belief, woods.parent[level], upward[level])
    outer = belief.copy()  # with what the parent says
    without = np.zeros(n)
    for level in woods.levels[1:]:
        without[level] = own = outer[woods.parent[level]] - upward[level]
        outer[level] += np.logaddexp(e11[level] + own, e01[level]) - np.logaddexp(e10[level] + own, e00[level])
    joint = np.stack([e00, e01 + belief, e10 + without, e11 + without + belief])
    joint = np.exp(joint - joint.max(axis=0))
    joint /= joint.sum(axis=0)
    joint[:, woods.levels[0]] = 0
    return 1 / (1 + np.exp(-np.clip(outer, -500, 500))), joint


def _states(trees: list[Tree], texts: list[str], woods: Forest) -> np.ndarray:
    """1 for the blocks that the page's main text holds, and for elements most of whose text they are."""
    good, base = np.zeros(len(woods.parent)), 0
    for tree, text in zip(trees, texts):
        left = Counter(" ".join(x.split()) for x in (text or "").split("\n\n"))
        for node, block in tree.blocks:
            if left[block] > 0:
                left[block] -= 1
                good[base + node] = woods.chars[base + node]
        base += len(tree.parent)
    for level in woods.levels[:0:-1]:
        np.add.at(good, woods.parent[level], good[level])
    return (good > 0.5 * woods.chars).astype(np.int64)


def fit(pages: list[tuple[str, str]], steps: int = STEPS) -> Model:
    """A model from pages and their main texts (blocks joined by an empty line)."""
    trees = [parse(html or "") for html, _ in pages]
    woods = forest(trees)
    state = _states(trees, [text for _, text in pages], woods)
    inner = np.concatenate(woods.levels[1:]) if len(woods.levels) > 1 else np.zeros(0, np.int64)
    counted = np.zeros((len(KIND_NAMES), 2, 2))
    np.add.at(counted, (woods.kind[inner], state[woods.parent[inner]], state[inner]), 1)
    model = Model(np.zeros(FEATURES), np.zeros((len(KIND_NAMES), 2, 2)))
    size = len(woods.parent)
    means = [np.zeros_like(model.weights), np.zeros_like(model.pairs)]
    squares = [np.zeros_like(model.weights), np.zeros_like(model.pairs)]
    for step in range(1, steps + 1):
        belief, joint = marginals(model, woods)
        expected = np.stack([np.bincount(woods.kind, x, len(KIND_NAMES)) for x in joint], axis=1).reshape(counted.shape)
        slopes = [woods.features.T @ (state - belief) / size - RIDGE * model.weights, (counted - expected) / size - RIDGE * model.pairs]
        for i, (values, slope) in enumerate(zip((model.weights, model.pairs), slopes)):
            means[i] = 0.9 * means[i] + 0.1 * slope
            squares[i] = 0.99 * squares[i] + 0.01 * slope**2
            values += RATE * means[i] / (1 - 0.9**step) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def usual_model() -> Model:
    """The model of the labelled pages that ``page_tree`` writes by rule."""
    return fit(labelled_pages(SAMPLE_PAGES))


def learned(labelled: DataFrame, html: str = "html", text: str = "text", most: int = SAMPLE_PAGES) -> Model:
    """A model of a table's pages and main texts, and of the rule's own; of more than ``most`` pages, those of least hash count."""
    rows = (labelled.select(F.col(html).alias("html"), F.col(text).alias("text")).filter("html IS NOT NULL")
            .orderBy(F.xxhash64("html", F.lit(7)), "html", "text").limit(most).collect())
    return fit([*labelled_pages(SAMPLE_PAGES), *((r.html, r.text) for r in rows)])


def texts_of_pages(model: Model, pages: list[str]) -> list[str]:
    """The main text of each page."""
    trees = [parse(html or "") for html in pages]
    if not trees:
        return []
    content, _ = marginals(model, forest(trees))
    out, base = [], 0
    for tree in trees:
        out.append("\n\n".join([block for node, block in tree.blocks if content[base + node] >= 0.5]))
        base += len(tree.parent)
    return out


def _task(model: Model, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for pages in portions(batch.column(2).to_pylist(), PORTION_CHARS):
                texts = texts_of_pages(model, pages)
                own = batch.slice(done, len(pages))
                done += len(pages)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return run


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", model: Model | None = None) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Text is that of the blocks whose marginal for content is a half or more,
    in page order, with an empty line between them. White space inside a block
    (any that Unicode knows) is one blank; character references are decoded.
    A null or empty page, and one without main text, has an empty text.
    Repeated rows are pages of their own, null ids and urls stay. An empty
    table gives no rows. Other columns are not read. ``model`` is that of
    ``learned`` or else the usual one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = {f.name: f.dataType for f in pages.schema.fields}
    out = T.StructType([T.StructField(id, kinds[id]), T.StructField(url, kinds[url]), T.StructField("text", T.StringType()),
                        T.StructField("n_chars", T.LongType())])
    return pages.select(id, url, html).mapInArrow(_task(model or usual_model(), to_arrow_schema(out)), out)


ship(__name__)
