"""Links within cells of a grid or band, without ever making all pairs of a cell.

A cell's rows are compared block against block; of its links only a spanning forest is
returned, which has the same connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_workers

#: Cells with more rows are cut into blocks and joined block by block.
BLOCK = 4096
#: Cells up to this size are first screened together, without a loop over cells.
SMALL = 48

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _forest(values: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of one cell's links: at most one less than it has rows."""
    left, edges = np.arange(len(values)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(np.broadcast_to(values[at], (len(left), *values.shape[1:])), values[left])
            if hit.any():
                edges += [(at, x) for x in left[hit].tolist()]
                queue += left[hit].tolist()
                left = left[~hit]
    return edges


def _cell_links(cell: np.ndarray, values: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of whole cells; ``cell`` is sorted."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(starts, len(cell)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    linked = sizes > SMALL
    small = ~linked[owner]
    for d in range(1, int(sizes[~linked].max(initial=1))):
        a = np.flatnonzero(small[:-d] & (owner[d:] == owner[:-d]))
        if not len(a):
            break
        linked[owner[a[near(values[a], values[a + d])]]] = True
    edges = [(starts[c] + x, starts[c] + y) for c in np.flatnonzero(linked) for x, y in _forest(values[starts[c] : starts[c] + sizes[c]], near)]
    a = np.array(edges, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def _link(near: Near, decode: Callable[[pa.Array], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell has at most two blocks of rows, so little is held."""
        kept = None

        def emit(t: pa.Table) -> pa.RecordBatch:
            keys = np.stack([t.column(k).to_numpy() for k in range(4)])
            cell = np.cumsum(np.concatenate(([0], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            column = t.column(4).combine_chunks()
            a, b = _cell_links(cell, decode(column), near)
            return pa.record_batch([column.take(pa.array(a)), column.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([kept, t]) if kept is not None else t
            last = np.ones(t.num_rows, bool)  # rows of the last cell wait for the next batch
            for k in range(4):
                column = t.column(k).to_numpy()
                last &= column == column[-1:]
            first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            kept = t.slice(first)
            if first:
                yield emit(t.slice(0, first))
        if kept is not None and kept.num_rows > 1:
            yield emit(kept)

    return run


def cell_links(cells: DataFrame, near: Near, decode: Callable[[pa.Array], np.ndarray], block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct values of ``cells(choice int, cell long, value)``.

    A cell of more than ``block`` rows is cut into blocks and each pair of blocks is a task
    of its own, so no group of any size meets in one task.
    """
    kind = dict(cells.dtypes)["value"]
    heavy = cells.groupBy("choice", "cell").count().where(F.col("count") > block)
    blocks = F.coalesce(F.ceil(F.col("count") / F.lit(block)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("value"), blocks).cast("int")
    dealt = (
        cells.join(heavy, ["choice", "cell"], "left")
        .select("choice", "cell", "value", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("choice", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "value")
    )
    keys = ["choice", "cell", "lo", "hi"]
    return with_workers(dealt).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link(near, decode), f"a {kind}, b {kind}")
