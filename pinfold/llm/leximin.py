"""One ranking from scores of different scales (problem 6): leximin over percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pinfold.operators.ranks import number_rows, percent_ranks

#: The percentile of a score that is missing: as many are above as below.
MISSING = 0.5


def leximin(items: DataFrame, scores: dict[str, list[str]], ties: list[str], rank: str = "rank") -> DataFrame:
    """The columns of ``items``, a percentile ``pct_<score>`` for each score, ``weakest`` and ``rank``, from 1.

    ``scores`` names the score columns and the columns within whose groups each one's percentile is taken (none: over
    all rows). The percentiles of an item, ascending, are compared in order: the item with the higher weakest score comes
    first, of equal ones that with the higher next one, and so on; what is left is decided by ``ties``, ascending, nulls
    first. Percentiles don't depend on ranges or distributions, so no score can decide by its scale. A score that is
    null or NaN counts as MISSING. Repeated rows are ranked one after the other. An empty table stays empty. Columns of
    ``items`` called like the new ones are an error.
    """
    new = [*(f"pct_{s}" for s in scores), "weakest", rank]
    if clash := set(new) & set(items.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    out = items
    for s, group in scores.items():
        out = percent_ranks(out, group, s, f"pct_{s}")
    out = out.withColumns({f"pct_{s}": F.coalesce(f"pct_{s}", F.lit(MISSING)) for s in scores})
    out = out.withColumn("__v", F.array_sort(F.array(*[f"pct_{s}" for s in scores])))
    order = [*(F.col("__v")[k].desc() for k in range(len(scores))), *(F.col(t).asc_nulls_first() for t in ties)]
    return number_rows(out.withColumn("weakest", F.col("__v")[0]), order, rank, start=1).drop("__v")
