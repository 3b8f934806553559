"""Demand forecasting on Spark ML: trend model, two boosted models, their blend."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.calendar import FLOATING, SET_DATES, us_holiday
from larder.functions.ratios import blend
from larder.operators.positions import chronological_holdout, expanding_folds, with_positions
from larder.operators.quantiles import exact_quantiles
from larder.plans.boosting import Growth, Plan, TreeModel, fit_many, fit_trees
from larder.plans.evaluate import evaluate
from larder.plans.reports import with_bounds
from larder.schemas import KEYS
from larder.session import stage

ORDER = ["date", *KEYS]
TARGET = "sales_quantity"

# Blend weights, bounds, seasonal terms (period in days, order), change points.
BLEND = {"trend_prediction": 0.4, "boosted_prediction": 0.3, "leafwise_prediction": 0.3}
BOUND_SHARE = 0.1
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3)}
MONTHLY = {"monthly": (30.5, 5)}
CHANGE_POINTS, CHANGE_RANGE = 25, 0.8
HIGH_VALUE_WEIGHT = 2.0
HIGH_DEMAND_SHARE = 0.75
VARIANTS = 8  # permuted features scored in one pass


@dataclass(frozen=True)
class Boosting:
    """Settings of a boosted regressor.

    ``rounds`` is the most trees grown; growing ends when the validation error has not fallen for
    ``patience`` trees, and the model keeps the trees up to its best. ``leaves`` limits a tree that grows
    best-first; without it ``depth`` alone does.
    """

    rounds: int = 1000
    patience: int = 50
    rate: float = 0.01
    depth: int | None = 6
    leaves: int | None = None
    row_share: float = 0.8
    column_share: float = 0.8
    min_leaf_rows: int = 1
    shrink: float = 1.0  # added to the weight of a leaf
    bins: int = 64  # candidate cuts per feature
    seed: int = 42

    @property
    def growth(self) -> Growth:
        return Growth(self.rate, self.depth, self.leaves, self.min_leaf_rows, self.shrink, self.row_share, self.column_share, self.seed)

    @property
    def plan(self) -> Plan:
        return Plan(self.growth, self.rounds, self.patience, self.bins)

    def regressor(self, features: str, prediction: str) -> GBTRegressor:
        """Spark ML's booster, for models without validation rows."""
        return GBTRegressor(
            featuresCol=features,
            labelCol=TARGET,
            predictionCol=prediction,
            maxIter=self.rounds,
            stepSize=self.rate,
            maxDepth=self.depth,
            subsamplingRate=self.row_share,
            featureSubsetStrategy=str(self.column_share),
            minInstancesPerNode=self.min_leaf_rows,
            seed=self.seed,
            maxBins=self.bins,
        )


# As many leaves and as few rows in each as the second model has.
BOOSTED = Boosting()
LEAFWISE = Boosting(depth=None, leaves=31, min_leaf_rows=20, shrink=0.0)


def feature_names(df: DataFrame) -> list[str]:
    """Numeric columns that are no key, date, target or helper."""
    skipped = {*KEYS, "date", TARGET, "fold", "position", "is_test", "row_weight", "is_validation"}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skipped]


def _span(df: DataFrame) -> tuple[str, int]:
    row = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("no dated rows to fit a trend on")
    return row["lo"].isoformat(), max(1, (row["hi"] - row["lo"]).days)


def trend_terms(origin: str, days: int, seasons: dict[str, tuple[float, int]]) -> dict[str, str]:
    """SQL expressions of the linear trend, its hinges and the Fourier terms."""
    day = f"datediff(date, date'{origin}')"
    scaled = f"({day} / {float(days)}D)"
    terms = {"t": scaled}
    for i in range(1, CHANGE_POINTS + 1):
        at = CHANGE_RANGE * i / CHANGE_POINTS
        terms[f"t_hinge_{i}"] = f"greatest({scaled} - {at!r}D, 0.0D)"
    for name, (period, order) in seasons.items():
        for k in range(1, order + 1):
            angle = f"(2.0D * pi() * {k} * {day} / {period}D)"
            terms[f"t_{name}_sin_{k}"] = f"sin{angle}"
            terms[f"t_{name}_cos_{k}"] = f"cos{angle}"
    return terms


def _sql_stage(terms: dict[str, str]) -> SQLTransformer:
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in terms.items()) + " FROM __THIS__")


def _drop_stage(columns: list[str]) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(columns)}) FROM __THIS__")


def fit_trend(history: DataFrame, shrink: float = 0.05, label: str = TARGET, prediction: str = "trend_prediction") -> PipelineModel:
    """Trend and seasonality model: one ridge regression over all rows."""
    terms = trend_terms(*_span(history), SEASONS | MONTHLY)
    return Pipeline(
        stages=[
            _sql_stage(terms),
            VectorAssembler(inputCols=list(terms), outputCol="trend_features"),
            LinearRegression(featuresCol="trend_features", labelCol=label, predictionCol=prediction, regParam=shrink),
            _drop_stage(list(terms)),
        ]
    ).fit(history)


def weighted(rows: DataFrame) -> DataFrame:
    """Training weight: high-value rows count double."""
    if "is_high_value" not in rows.columns:
        return rows.withColumn("row_weight", F.lit(1.0))
    return rows.withColumn("row_weight", F.when(F.col("is_high_value") == 1, HIGH_VALUE_WEIGHT).otherwise(1.0))


def fit_boosted(rows: DataFrame, names: list[str], settings: Boosting, prediction: str, saved: str | None = None) -> PipelineModel:
    """Boosted model on the rows not marked ``is_validation``, stopped early on those that are.

    ``saved``: a shared folder from which a fit that broke off goes on.
    """
    fit = fit_trees(rows, names, settings.growth, settings.rounds, settings.patience, TARGET, "row_weight", "is_validation", prediction, settings.bins, saved)
    return PipelineModel(stages=[fit])


def fit_side_by_side(parts: list[DataFrame], names: list[str], settings: list[Boosting], predictions: list[str]) -> list[list[TreeModel]]:
    """As ``fit_boosted``, for each part and setting; the models share the jobs of their rounds."""
    return fit_many(parts, names, [s.plan for s in settings], TARGET, "row_weight", "is_validation", predictions)


def fit_ensemble(features: DataFrame, boosted: Boosting = BOOSTED, leafwise: Boosting = LEAFWISE) -> PipelineModel:
    """Fit the three models on a feature table and blend them in one saved pipeline.

    The boosted models train on everything before the last of five expanding folds
    and stop early on that fold; the trend model uses all rows.
    """
    names = feature_names(features)
    folds = weighted(expanding_folds(features, ORDER)).withColumn("is_validation", F.col("fold") == 5)
    rows = stage(folds.drop("position"), "training")
    trend = fit_trend(rows)
    first, second = (PipelineModel(stages=[m]) for m in fit_side_by_side([rows], names, [boosted, leafwise], ["boosted_prediction", "leafwise_prediction"])[0])
    total = " + ".join(f"{c} * {w}D" for c, w in BLEND.items())
    combine = SQLTransformer(statement=f"SELECT *, {total} AS prediction FROM __THIS__")
    bounds = SQLTransformer(
        statement=f"SELECT *, prediction * {1 - BOUND_SHARE}D AS pred_lower, prediction * {1 + BOUND_SHARE}D AS pred_upper FROM __THIS__"
    )
    return PipelineModel(stages=[trend, first, second, combine, bounds, _drop_stage(["trend_features"])])


def blended(scored: DataFrame) -> DataFrame:
    """Blend and bounds for a table that already holds the three predictions."""
    return with_bounds(scored.withColumn("prediction", blend(BLEND)), share=BOUND_SHARE)


def cross_validate(features: DataFrame, boosted: Boosting = BOOSTED, leafwise: Boosting = LEAFWISE, folds: int = 5) -> DataFrame:
    """Metrics of both boosted models per expanding fold: (model, fold, metrics)."""
    names = feature_names(features)
    rows = stage(weighted(expanding_folds(features, ORDER, folds)), "folds")
    parts = [rows.where(F.col("fold") <= k).withColumn("is_validation", F.col("fold") == k) for k in range(1, folds + 1)]
    fitted = fit_side_by_side(parts, names, [boosted, leafwise], ["prediction", "prediction"])
    metrics = []
    for k, (part, models) in enumerate(zip(parts, fitted, strict=True), 1):
        for name, model in zip(("boosted", "leafwise"), models, strict=True):
            scored = model.transform(part.where("is_validation"))
            metrics.append(evaluate(scored).withColumns({"model": F.lit(name), "fold": F.lit(k)}))
    return reduce(DataFrame.unionByName, metrics)


def backtest(features: DataFrame, share: float = 0.2, boosted: Boosting = BOOSTED, leafwise: Boosting = LEAFWISE) -> DataFrame:
    """Train on all but the last share of rows by date, evaluate on the rest."""
    split = stage(chronological_holdout(features, ORDER, share).drop("position"), "holdout")
    model = fit_ensemble(split.where("not is_test").drop("is_test"), boosted, leafwise)
    test = split.where("is_test").drop("is_test")
    return evaluate(model.transform(test)).withColumn("test_size", test.agg(F.count(F.lit(1))).scalar())


def performance(model: PipelineModel, features: DataFrame) -> DataFrame:
    return evaluate(model.transform(features))


def fit_single(flat: DataFrame, settings: Boosting = BOOSTED, seed: int = 42) -> PipelineModel:
    """One boosted model on the flat features, stopping early on a fixed random fifth of the rows."""
    names = feature_names(flat)
    draw = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in ORDER if c in flat.columns]), F.lit(5))
    rows = flat.withColumn("is_validation", draw == 0).withColumn("row_weight", F.lit(1.0))
    return fit_boosted(rows, names, settings, "prediction")


# --- batch scoring with label indexes ---

SCORER = Boosting(rounds=100, rate=0.1)  # grown to the end: scoring has no validation rows
INDEXED = ["store_id", "promotions", "seasonality_factors", "external_factors", "demand_trend", "customer_segments"]


def _scoring_rows(demand: DataFrame) -> DataFrame:
    day = F.col("date")
    return demand.na.drop("any").withColumns({"day": F.day(day), "month": F.month(day), "year": F.year(day)})


def fit_scorer(demand: DataFrame, settings: Boosting = SCORER) -> PipelineModel:
    """Label indexes (alphabetical, unknown labels are errors) and a boosted model in one pipeline."""
    rows = _scoring_rows(demand).withColumn("store_id", F.col("store_id").cast("string"))
    indexed = [f"{c}_index" for c in INDEXED]
    inputs = [*[f"{c}_code" for c in indexed], "price", "day", "month", "year"]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=INDEXED, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="error"),
            # a sum is a plain number: without the indexer's levels a tree cuts codes like any other feature
            SQLTransformer(statement="SELECT *, " + ", ".join(f"{c} + 0.0D AS {c}_code" for c in indexed) + " FROM __THIS__"),
            VectorAssembler(inputCols=inputs, outputCol="features"),
            settings.regressor("features", "predicted_sales_quantity"),
            _drop_stage([*indexed, *[f"{c}_code" for c in indexed], "features"]),
        ]
    ).fit(rows)


def with_high_demand(scored: DataFrame, prediction: str = "predicted_sales_quantity", share: float = HIGH_DEMAND_SHARE) -> DataFrame:
    """Flag predictions above the table's upper quartile."""
    cut = exact_quantiles(scored, prediction, [share])[share]
    return scored.withColumn("high_demand", F.col(prediction) > F.lit(cut))


def score(model: PipelineModel, demand: DataFrame) -> DataFrame:
    """Predictions with the high-demand flag, highest first."""
    rows = _scoring_rows(demand).withColumn("store_id", F.col("store_id").cast("string"))
    scored = stage(model.transform(rows), "scored")
    return with_high_demand(scored).orderBy(F.desc("predicted_sales_quantity"), *ORDER)


# --- multiplicative outlook with holidays ---

REGRESSORS = ["promotions_code", "seasonality_code", "trend_code"]
HOLIDAY_NAMES = [name for name, *_ in SET_DATES + FLOATING]
NORMAL_80 = 1.2815515655446004


def _outlook_rows(rows: DataFrame, terms: dict[str, str]) -> DataFrame:
    name = F.coalesce("_holiday", F.lit(""))
    flags = {f"h_{i}": name.startswith(n).cast("double") for i, n in enumerate(HOLIDAY_NAMES)}
    named = rows.withColumn("_holiday", us_holiday(F.col("date")))
    return named.withColumns({c: F.expr(e) for c, e in terms.items()} | flags).drop("_holiday")


def demand_outlook(
    demand: DataFrame, periods: int = 30, values: dict[str, float] | None = None, shrink: float = 0.01
) -> DataFrame:
    """Fitted and future demand per date: (ds, yhat, yhat_lower, yhat_upper).

    A regression on log1p(demand) makes trend, seasons, holidays and regressors act
    as factors. Regressors are set to ``values`` (0 when absent) on every date, and
    the bounds hold 80 % of the residuals.
    """
    origin, days = _span(demand)
    terms = trend_terms(origin, days, SEASONS)
    extra = [c for c in demand.columns if c in REGRESSORS or c.startswith("segment_")]
    inputs = [*terms, *[f"h_{i}" for i in range(len(HOLIDAY_NAMES))], *extra]
    assemble = VectorAssembler(inputCols=inputs, outputCol="outlook_features", handleInvalid="skip")
    rows = assemble.transform(_outlook_rows(demand.withColumn("log_y", F.log1p(TARGET)), terms))
    fit = LinearRegression(featuresCol="outlook_features", labelCol="log_y", predictionCol="log_yhat", regParam=shrink).fit(rows)
    sigma = fit.summary.rootMeanSquaredError
    last = demand.agg(F.max("date").alias("last"))
    ahead = last.select(F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", periods))).alias("date"))
    frame = demand.select("date").distinct().unionByName(ahead)
    frame = frame.withColumns({c: F.lit(float((values or {}).get(c, 0))) for c in extra})
    scored = fit.transform(assemble.transform(_outlook_rows(frame, terms)))
    level, band = F.col("log_yhat"), NORMAL_80 * sigma
    return scored.select(
        F.col("date").alias("ds"),
        F.expm1(level).alias("yhat"),
        F.expm1(level - band).alias("yhat_lower"),
        F.expm1(level + band).alias("yhat_upper"),
    )


# --- importance and attribution ---


def _boosters(model) -> list[TreeModel]:
    """Tree models of a pipeline, in order; pipelines may hold pipelines."""
    if isinstance(model, TreeModel):
        return [model]
    return [t for s in getattr(model, "stages", []) for t in _boosters(s)]


def gain_importance(model: PipelineModel, names: list[str], spark, nth: int = 0) -> DataFrame:
    """(feature, importance) of the nth booster of a pipeline, by split gain; one row per feature."""
    rows = [(n, float(v)) for n, v in zip(names, _boosters(model)[nth].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


def cover_importance(model: PipelineModel, names: list[str], spark, nth: int = 0) -> DataFrame:
    """(feature, importance): mean number of training rows (by weight) in the splits on each feature; 0 for a feature no split uses."""
    rows = [(n, float(v)) for n, v in zip(names, _boosters(model)[nth].covers, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


def row_attributions(model: PipelineModel, rows: DataFrame, nth: int = 0) -> DataFrame:
    """``rows`` with ``attributions``, exact Shapley values of the nth booster per feature, and ``expected``, its mean prediction.

    They sum to the prediction less ``expected``.
    """
    booster = _boosters(model)[nth]
    return booster.attributions(rows).withColumn("expected", F.lit(booster.expected))


def mean_attribution(model: PipelineModel, rows: DataFrame, nth: int = 0) -> DataFrame:
    """(feature, importance): mean absolute attribution of each feature over ``rows``."""
    names = _boosters(model)[nth].getOrDefault("names")
    sums = row_attributions(model, rows, nth).agg(*[F.avg(F.abs(F.get("attributions", F.lit(i)))).alias(f"a{i}") for i in range(len(names))])
    pairs = [F.struct(F.lit(n).alias("feature"), F.col(f"a{i}").alias("importance")) for i, n in enumerate(names)]
    return sums.select(F.inline(F.array(*pairs)))


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def trend_attribution(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Mean |coefficient * (x - mean x)| per term of the trend model, as aggregates."""
    line = next(s for s in model.stages if hasattr(s, "coefficients"))
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    terms = model.stages[0].transform(rows)
    means = terms.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    centred = terms.withColumn("_m", means)
    sums = centred.agg(
        *[F.avg(F.abs((F.col(c) - F.col(f"_m.{c}")) * F.lit(float(b)))).alias(c) for c, b in zip(names, line.coefficients.toArray())]
    )
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in names]
    return sums.select(F.explode(F.array(*pairs)).alias("x")).select("x.feature", "x.importance")


def _shuffled(features: DataFrame, names: list[str], seed: int) -> DataFrame:
    """Every row next to the feature values of another row, in a fixed random cycle."""
    keyed = features.withColumn("_draw", F.xxhash64(F.lit(seed), *ORDER))
    placed = with_positions(keyed, ["_draw", *ORDER], "_pos").drop("_draw")
    n = placed.agg(F.count(F.lit(1))).scalar()
    other = placed.select(
        F.when(F.col("_pos") == 0, n - 1).otherwise(F.col("_pos") - 1).alias("_pos"), *[F.col(c).alias(f"_other_{c}") for c in names]
    )
    return placed.join(other, "_pos")


def permutation_importance(model: PipelineModel, features: DataFrame, prediction: str = "prediction", seed: int = 7) -> DataFrame:
    """Rise of the mean absolute error when one feature's values come from other rows.

    One global shuffle pairs the rows; ``VARIANTS`` features are then scored in each pass over them.
    """
    names = feature_names(features)
    paired = stage(_shuffled(features, names, seed), "permuted")
    error = F.avg(F.abs(F.col(prediction) - F.col(TARGET))).alias("_mae")
    base = model.transform(paired.select(*features.columns)).agg(error).scalar()
    parts = []
    for at in range(0, len(names), VARIANTS):
        some = names[at : at + VARIANTS]
        spread = paired.withColumn("_variant", F.explode(F.array(*[F.lit(n) for n in some])))
        swapped = {n: F.when(F.col("_variant") == n, F.col(f"_other_{n}")).otherwise(F.col(n)) for n in some}
        scored = model.transform(spread.withColumns(swapped).select(*features.columns, "_variant"))
        parts.append(scored.groupBy(F.col("_variant").alias("feature")).agg(error))
    return reduce(DataFrame.unionByName, parts).select("feature", (F.col("_mae") - base).alias("importance"))


def dependence(model: PipelineModel, rows: DataFrame, feature: str, interaction: str | None = None) -> DataFrame:
    """(value, attribution, interaction value) of one trend term, per row."""
    line = next(s for s in model.stages if hasattr(s, "coefficients"))
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    weight = float(line.coefficients.toArray()[names.index(feature)])
    terms = model.stages[0].transform(rows)
    mean = terms.agg(F.avg(feature)).scalar()
    shown = F.col(interaction) if interaction else F.lit(None).cast("double")
    return terms.withColumn("_mean", mean).select(
        F.col(feature).alias("value"), ((F.col(feature) - F.col("_mean")) * F.lit(weight)).alias("attribution"), shown.alias("interaction")
    )


def boosted_dependence(model: PipelineModel, rows: DataFrame, feature: str, interaction: str | None = None, nth: int = 0) -> DataFrame:
    """(value, attribution, interaction value) of one feature of a boosted model, per row, in one pass over the rows."""
    at = _boosters(model)[nth].getOrDefault("names").index(feature)
    shown = F.col(interaction).cast("double") if interaction else F.lit(None).cast("double")
    explained = row_attributions(model, rows, nth)
    return explained.select(F.col(feature).cast("double").alias("value"), F.get("attributions", F.lit(at)).alias("attribution"), shown.alias("interaction"))
