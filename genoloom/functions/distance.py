"""Edit distance with costs of its own, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a batch's table that are worked on at once, and what stands behind a text's end.
CELLS, PAST = 1 << 22, -1


def codes(texts: list[str], width: int) -> np.ndarray:
    out = np.full((len(texts), width), PAST, np.int64)
    for i, x in enumerate(texts):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), "<u4")
    return out


def distances(left: list[str], right: list[str], delete: float, insert: float, substitute: float, match: float) -> np.ndarray:
    """Least cost of turning each of ``left`` into that of ``right``, all pairs at once.

    A row of the table is worked out for all pairs: what comes from above and aside is a minimum of two vectors, and what
    comes along the row is a running minimum after each place's insertions are taken off.
    """
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a, b = codes(left, int(n_left.max(initial=0))), codes(right, int(n_right.max(initial=0)))
    steps = np.arange(b.shape[1] + 1) * float(insert)
    row = np.repeat(steps[None], len(left), 0)
    out = row[np.arange(len(left)), n_right].copy()
    for i in range(a.shape[1]):
        best = row + delete
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + np.where(a[:, i : i + 1] == b, match, substitute))
        row = np.minimum.accumulate(best - steps, axis=1) + steps
        done = n_left == i + 1
        out[done] = row[done, n_right[done]]
    return out


def weighted_distance(df: DataFrame, a: str, b: str, name: str = "distance", delete: float = 1, insert: float = 1, substitute: float = 1, match: float = 0) -> DataFrame:
    """``df`` with the least cost of edits that turn text ``a`` into text ``b``: null where either is null.

    Costs are of a deleted, inserted, replaced and equal character and not below 0. Pairs of about equal lengths share a
    table of CELLS cells at most, or of one pair; a pair takes time by the product and memory by the sum of its lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(x).to_pylist() for x in (a, b))
            known = sorted((i for i in range(batch.num_rows) if left[i] is not None and right[i] is not None), key=lambda i: (len(left[i]), len(right[i])))
            out: list[float | None] = [None] * batch.num_rows
            at = 0
            while at < len(known):
                end, width = at, 0
                while end < len(known) and (end == at or max(width, len(right[known[end]])) * (end - at + 1) <= CELLS):
                    width = max(width, len(right[known[end]]))
                    end += 1
                part = known[at:end]
                for i, x in zip(part, distances([left[i] for i in part], [right[i] for i in part], delete, insert, substitute, match).tolist(), strict=True):
                    out[i] = x
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{name}` double")
