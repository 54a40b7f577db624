"""Feature groups as levels of window expressions.

Every level of all requested groups becomes one projection, so Spark plans one
Window operator per level and one shuffle and sort for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from tickloom.operators.series import Frames, Series, SeriesLayout, plan_series


@dataclass
class Level:
    """Columns computed together: projections, running sums, fills."""

    add: dict[str, Column] = field(default_factory=dict)
    cumulate: dict[str, Column] = field(default_factory=dict)
    carry: dict[str, Column] = field(default_factory=dict)


@dataclass
class Recipe:
    outputs: list[str]
    levels: list[Level]
    back: int = 0
    ahead: int = 0
    number: bool = False  # needs the row position as `__pos`
    filled: dict[str, Column] = field(default_factory=dict)  # forward-filled inputs


RecipeMaker = Callable[[Frames], Recipe]


def add_features(
    df: DataFrame,
    series: Series,
    makers: Iterable[RecipeMaker],
    layout: SeriesLayout | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The input columns (or only `keep`) plus the outputs of all groups."""
    layout = layout or plan_series(df, series)
    recipes = [make(layout.frames) for make in makers]
    kept = df.columns if keep is None else keep
    outputs = list(dict.fromkeys(c for r in recipes for c in r.outputs))

    filled = {n: c for r in recipes for n, c in r.filled.items()}
    if filled:
        df = layout.open(df).carry(filled).close()

    frame = layout.open(
        df,
        back=max((r.back for r in recipes), default=0),
        ahead=max((r.ahead for r in recipes), default=0),
    )
    if any(r.number for r in recipes):
        frame = frame.number("__pos")
    for depth in range(max((len(r.levels) for r in recipes), default=0)):
        level = [r.levels[depth] for r in recipes if depth < len(r.levels)]
        frame = frame.add({n: c for x in level for n, c in x.add.items()})
        frame = frame.scan(
            cumulate={n: c for x in level for n, c in x.cumulate.items()},
            carry={n: c for x in level for n, c in x.carry.items()},
        )
    return frame.close().select(*kept, *[c for c in outputs if c not in kept])
