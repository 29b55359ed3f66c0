"""The source index: descriptors beside the fingerprints of each clip's edges, stored once and read by every step that compares sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.kernels import edge_vectors
from ..sources.shared import written

EDGES = "source_id long, head array<double>, tail array<double>"


def _fingerprints(batches: Iterator[pa.RecordBatch], sr: int) -> Iterator[pa.RecordBatch]:
    """All clips of a batch at once."""
    for b in batches:
        if b.num_rows:
            samples = b.column("samples").combine_chunks() if isinstance(b.column("samples"), pa.ChunkedArray) else b.column("samples")
            values, ends = samples.values.to_numpy(zero_copy_only=False), samples.offsets.to_numpy()
            sides = edge_vectors([values[a:z].astype(float) for a, z in zip(ends[:-1], ends[1:])], sr)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(s).ravel()), s.shape[1]).cast(pa.list_(pa.float64())) for s in sides]
            yield pa.RecordBatch.from_arrays([b.column("source_id"), *lists], names=[c.split()[0] for c in EDGES.split(", ")])


def built(sources: DataFrame, clips: DataFrame, sr: int) -> DataFrame:
    """sources (source_id, ...) with head and tail of their clip (source_id, samples), as a stored table; without a clip both are null.

    With them decode.step_costs counts how unlike a clip's end and the next one's start are.
    """
    edges = clips.where("samples is not null").select("source_id", "samples").mapInArrow(lambda b: _fingerprints(b, sr), EDGES)
    return written(sources.join(edges, "source_id", "left"), "sources")
