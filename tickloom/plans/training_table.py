"""From bars with news to a training table, its fitted parts and a report."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import prepare as P
from tickloom.operators import statistics as S
from tickloom.operators.calendar import with_calendar
from tickloom.operators.cross_asset import SECTOR_SYMBOLS, cross_asset_features
from tickloom.operators.sentiment import sentiment_features
from tickloom.operators.series import Series, plan_series
from tickloom.operators.technical import technical_features
from tickloom.session import materialise
from tickloom.sources.tables import project, validate_bars


@dataclass
class TrainingPlan:
    """Switches and parameters; the defaults are those of the usual run."""

    target_column: str = "close"
    prediction_horizon: int = 12
    include_technical: bool = True
    include_cross_asset: bool = False
    include_events: bool = True
    technical_groups: Sequence[str] | None = None
    sentiment_groups: Sequence[str] | None = None
    max_features: dict[str, int] = field(
        default_factory=lambda: {"unknown_future": 40, "known_future": 15, "static": 8}
    )
    lag_periods: Sequence[int] = (1, 3, 5, 10, 20)
    train_share: float = 0.8
    backward_fill: bool = False
    exact_fits: bool = True  # False: quantiles from one sketching pass
    availability_lag: int = 1
    sectors: Sequence[str] = tuple(SECTOR_SYMBOLS)
    nearest_calendar_day: bool = False  # True for daily bars
    interactions: Sequence[tuple[str, str]] | None = None  # None: the usual pairs whose columns exist
    min_rows: int | None = None


@dataclass
class TrainingTable:
    table: DataFrame
    roles: P.Roles
    selected: dict[str, list[str]]
    scaler: P.RobustScaler
    labels: P.LabelEncoder | None
    importance: DataFrame
    elapsed: float

    def report(self, time_column: str = "bar_ts") -> DataFrame:
        """One row: shape, date range, missing share, features per role, best ten."""
        df = self.table
        best = self.importance.orderBy(F.col("importance_score").desc(), "feature").limit(10)
        facts = {
            "columns": F.lit(len(df.columns)),
            "elapsed_seconds": F.lit(self.elapsed),
            **{f"{role}_features": F.lit(len(cs)) for role, cs in self.selected.items()},
            "top_features": F.array(*[F.lit(r.feature) for r in best.collect()]),
        }
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(time_column).alias("first_ts"),
            F.max(time_column).alias("last_ts"),
            S.missing_share(df.columns).alias("missing_percentage"),
        ).withColumns(facts)


def add_all_features(
    bars: DataFrame, series: Series, plan: TrainingPlan, daily: DataFrame | None = None
) -> DataFrame:
    """The feature stages that are switched on, as one lazy plan."""
    df = bars
    layout = plan_series(bars, series)
    if plan.include_technical:
        df = technical_features(df, series, groups=plan.technical_groups, layout=layout)
    if plan.include_cross_asset:
        if daily is None:
            raise ValueError("cross-asset features need the daily series table")
        df = cross_asset_features(df, daily, plan.sectors, series.time, plan.availability_lag)
    if plan.include_events:
        if "headline_count" in df.columns:
            df = sentiment_features(df, series, groups=plan.sentiment_groups, layout=layout)
        df = with_calendar(df, series.time, nearest=plan.nearest_calendar_day, source=bars)
    return df


def build_training_table(
    bars: DataFrame,
    series: Series,
    plan: TrainingPlan | None = None,
    *,
    info: DataFrame | None = None,
    daily: DataFrame | None = None,
) -> TrainingTable:
    """All stages in order. Features are written once, because the fits after them
    read them several times and by column. Lags and products are scored without
    being made, and only the selected ones are made. Selection, encoding and
    scaling are fitted on the training part."""
    plan = plan or TrainingPlan()
    started = time.time()
    entity = series.entity[0]
    validate_bars(bars, series.time, plan.min_rows or 1)
    df = add_all_features(bars, series, plan, daily)
    if info is not None:
        df = P.with_static_info(df, info, entity)
    df = P.all_finite(df)
    df = P.with_target(df, series, plan.target_column, plan.prediction_horizon)
    df = P.time_split(df, series, plan.train_share)
    df = materialise(df, "features")

    train = df.where("is_train")
    skip = [*series.keys, "target", "time_idx", "is_train"]
    roles = P.assign_roles(train, skip=skip, target=plan.target_column)
    texts = [c for c in P.categorical_columns(df) if c not in series.keys]
    labels = P.fit_labels(train, texts) if texts else None
    if labels:
        df = labels.transform(df)
        train = df.where("is_train")

    candidates, layout = _candidates(df, roles, plan, texts), plan_series(df, series)
    roles.unknown_future += candidates.made()
    scores = P.score_candidates(train, candidates, "target", series, layout, exact=plan.exact_fits)
    selected, score = P.best_features(scores, roles, plan.max_features)
    wanted = list(dict.fromkeys(c for cs in selected.values() for c in cs))
    lags = [(c, k) for k in candidates.periods for c in candidates.lagged if P.lag_name(c, k) in wanted]
    if lags:
        df = P.with_chosen_lags(df, series, lags, layout)
    df = P.with_interactions(df, [p for p in candidates.products if P.product_name(*p) in wanted])
    df = project(df, [*series.keys, "time_idx", "is_train", "target", plan.target_column, *wanted])

    numeric = [c for c in dict.fromkeys([*selected["unknown_future"], *selected["known_future"]]) if c != plan.target_column]
    others = [c for c in wanted if c not in numeric and c != plan.target_column]
    fits = S.written_once(df.where("is_train").select(*numeric, *others))
    scaler = P.fit_scaler(fits, numeric, plan.exact_fits)
    # the median of a scaled column is 0
    medians = {c: 0.0 for c in numeric} | {c: v or 0.0 for (c, _), v in S.quantiles(fits, others, (0.5,), plan.exact_fits).items()}
    rows = [(c, role, score[c]) for role, cs in selected.items() for c in cs]
    importance = df.sparkSession.createDataFrame(rows, "feature string, role string, importance_score double")
    df = scaler.transform(df)
    df = P.fill_gaps(df, series, [*numeric, *others], backward=plan.backward_fill, medians=medians, layout=layout)
    return TrainingTable(df, roles, selected, scaler, labels, importance, time.time() - started)


def _candidates(df: DataFrame, roles: P.Roles, plan: TrainingPlan, texts: Sequence[str]) -> P.Candidates:
    """What a plan chooses from: all columns with a role, lags of the unknown ones and the target's column, and products."""
    held = [c for role in plan.max_features for c in getattr(roles, role)]
    lagged = [c for c in [*P.lag_candidates(roles.unknown_future), plan.target_column] if c not in texts]
    named = plan.interactions
    if named is None:
        named = [p for p in P.USUAL_PAIRS if set(p) <= {*roles.unknown_future, plan.target_column} - set(texts)]
    return P.Candidates(list(dict.fromkeys(held)), list(named), list(dict.fromkeys(lagged)), list(plan.lag_periods))
