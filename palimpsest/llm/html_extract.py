"""Main text of HTML pages: blocks labelled by a recurrent network that reads the whole page.

The network is trained in one task: on pages laid out with the words of a bounded sample, and on
the sample's pages that mark their article. Every page is then parsed and labelled whole, in the
task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import block_labeller
from .cluster import tidy
from .html_blocks import Block, blocks_of

#: Pages of the sample at most, their characters at most, and pages laid out for training.
MOST_PAGES, MOST_CHARS, LAID_OUT = 200, 100_000, 900
#: Blocks that a task labels at a time, further ones of the last page included.
STEP = 1 << 14


def fit(pages: list[str], laid_out: int = LAID_OUT) -> block_labeller.Net:
    """The network, by the pages' words and by those that mark their article."""
    parsed = [blocks_of(p) for p in pages]
    texts = [b.text for p in parsed for b in p if len(b.text) > 20]
    marked = [m for m in map(block_labeller.self_marked, parsed) if m]
    return block_labeller.train(block_labeller.laid_out(laid_out, texts) + marked)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = MOST_PAGES) -> block_labeller.Net:
    """fit, in one task, on at most `most` pages of at most MOST_CHARS characters, chosen by a hash of id and html."""
    h, rows = F.xxhash64("id", "html"), pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html"))
    rows = rows.where(F.length("html").between(1, MOST_CHARS)).orderBy(h, "id", "html").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(page for b in batches for page in b.column(0).to_pylist())
        out = io.BytesIO()
        np.savez(out, **fit(found))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["net"])

    made = rows.select("html").repartition(1).mapInArrow(tidy(run), "net binary").collect()
    if not made:  # no page to learn from
        return fit([])
    with np.load(io.BytesIO(made[0]["net"])) as held:
        return dict(held)


def main_texts(net: block_labeller.Net, pages: Iterator[str | None]) -> Iterator[str]:
    """The main text of each page, a few pages at a time."""
    held: list[list[Block]] = []

    def done() -> Iterator[str]:
        for own, good in zip(held, block_labeller.label(net, held), strict=True):
            yield " ".join(b.text for b, g in zip(own, good, strict=True) if g)

    size = 0
    for page in pages:
        held.append(blocks_of(page or ""))
        size += len(held[-1])
        if size >= STEP or len(held) >= STEP:
            yield from done()
            held.clear()
            size = 0
    yield from done()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: block_labeller.Net | None = None) -> DataFrame:
    """(id, url, text, n_chars), a row for each row of pages: its main text, and that text's code points.

    Main text is what the network marks among the page's blocks: the article without menus,
    headers, footers, sidebars, notices, adverts, forms and comments; scripts, styles, markup
    comments and form controls are never text. Character references are decoded; white space (of
    Unicode) within a block becomes one space; blocks are joined in page order by one space.
    Null, empty and textless pages have an empty text; ids and urls may be null or repeated; very
    long pages are read whole; an empty table gives an empty result. Other columns aren't read.
    net is a trained network; without one it is trained on a sample of the pages.
    """
    net = net or train(pages, id_col, html_col)
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(main_texts(shared.value, (x.as_py() for x in batch.column(2))))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(tidy(run), "id long, url string, text string, n_chars long")
