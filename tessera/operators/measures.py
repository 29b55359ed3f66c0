"""Quality of a rendering against its target, and the choice between two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import improves, quality_score
from ..functions.vectors import clip, dot, norm


def chroma_cosine(frames: DataFrame) -> DataFrame:
    """Mean cosine of (target, a, b) frames that both have sound, 0 to 1; 0 without any."""
    size = norm("a") * norm("b")
    return frames.groupBy("target").agg(clip(F.coalesce(F.avg(F.when(size > 1e-8, dot("a", "b") / size)), F.lit(0.0)), 0.0, 1.0).alias("chroma"))


def choose_renderer(metrics: DataFrame) -> DataFrame:
    """metrics (target, base, other as structs chroma, onset, log_mel, boundary): both scores, and whether the other is taken."""

    def score(x: str) -> F.Column:
        return quality_score(*(F.col(f"{x}.{n}") for n in ("chroma", "onset", "log_mel", "boundary")))

    return metrics.select("target", score("base").alias("base_score"), score("other").alias("other_score"), improves("base", "other").alias("accepted"))
