"""Exponentially weighted means with windows that only grow.

With weight d = 1 - 2/(span+1) per row, the sum of x_i * d^(t-i) is kept as
running sums inside blocks of rows, scaled by d^-(row in block), plus the
closing sum of the block before. Rows more than one block back have a weight
below 1e-17 against the newest value, which has weight 1 because the mean is
taken at rows that hold a value; other rows repeat the last mean. The cost per
row does not depend on the span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio
from tickloom.operators.recipe import Level
from tickloom.operators.series import Frames


def reach(span: int) -> int:
    """Rows after which a weight is below 1e-17."""
    return math.ceil(math.log(1e-17) / math.log(1 - 2 / (span + 1)))


def weighted_means(f: Frames, columns: dict[str, tuple[str, int]]) -> tuple[list[Level], int]:
    """Levels that make each `name: (input, span)`, and the rows they look back."""
    block = max([reach(span) for _, span in columns.values()], default=1)
    row_of, block_of, place_of = (f"__ew_{part}_{block}" for part in ("row", "block", "place"))
    inner = Window.partitionBy(*f.partition, block_of).orderBy(f.series.time, *f.series.ties)
    inner = inner.rowsBetween(Window.unboundedPreceding, 0)
    place = F.col(place_of)

    def decay(span: int) -> Column:
        return F.lit(1 - 2 / (span + 1))

    sums, closing, means, filled = {}, {}, {}, {}
    for name, (x, span) in columns.items():
        weight = F.pow(decay(span), -place)
        sums[f"__ewn_{name}"] = F.coalesce(F.sum(F.col(x) * weight).over(inner), F.lit(0.0))
        sums[f"__ewd_{name}"] = F.coalesce(
            F.sum(F.when(F.col(x).isNotNull(), weight)).over(inner), F.lit(0.0)
        )
        for part in "nd":
            at_end = F.when(place == block - 1, F.col(f"__ew{part}_{name}"))
            closing[f"__ewp{part}_{name}"] = F.coalesce(
                F.last(at_end, ignorenulls=True).over(f.before), F.lit(0.0)
            )
        step = F.pow(decay(span), F.lit(block))
        means[f"__ewm_{name}"] = F.when(
            F.col(x).isNotNull(),
            ratio(
                F.col(f"__ewn_{name}") + F.col(f"__ewpn_{name}") * step,
                F.col(f"__ewd_{name}") + F.col(f"__ewpd_{name}") * step,
            ),
        )
        filled[name] = F.col(f"__ewm_{name}")
    row = F.row_number().over(f.order) - 1
    return [
        Level(add={row_of: row}),
        Level(
            add={
                block_of: F.floor(F.col(row_of) / block),
                place_of: (F.col(row_of) % block).cast("double"),
            }
        ),
        Level(add=sums),
        Level(add=closing),
        Level(add=means),
        Level(carry=filled),
    ], block
