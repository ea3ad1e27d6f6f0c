"""Downstream models on filled tables, by MLlib: the same families and settings, not the same digits."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.registry import IMPUTERS, TABLE_METRICS
from lacuna.operators import scores
from lacuna.operators.cells import AT, KEYS

MODELS = ("linear", "random_forest", "xgboost")
#: Columns that a wide table may have.
MOST_COLUMNS = 2000


def wide(cells: DataFrame, target: int, n_cols: int, on: str = "pred") -> DataFrame:
    """(row_id, split, label, f0..): rows with a label and all features."""
    x = cells.groupBy("row_id", "split").pivot("col_id", list(range(n_cols))).agg(F.first(on))
    names = {c: "label" if c == target else f"f{c}" for c in range(n_cols)}
    return x.select("row_id", "split", *[F.col(str(c)).alias(n) for c, n in names.items()]).dropna(how="any")


def estimator(model: str, task: str, n_train: int):
    """Settings: L2 with C = 1 and a free intercept.  Boosted trees are in `boosting`, forests in `forest`."""
    cls = task == "classification"
    if model == "linear":
        return LogisticRegression(regParam=1.0 / max(1, n_train), standardization=False, maxIter=1000) if cls else LinearRegression(solver="normal", regParam=0.0)
    raise ValueError(f"model must be one of {MODELS}")


def predict(table: DataFrame, features: list[str], model: str, task: str = "classification", **sizes) -> DataFrame:
    """(row_id, label, pred, score) of the test rows; float labels of classes are cut to whole numbers.

    `xgboost` is second-order boosting: 300 rounds at depth 6, rate 0.05, 0.9 of rows and columns; `random_forest` 300 trees
    at depth 30.
    """
    x = table if model in ("xgboost", "random_forest") else VectorAssembler(inputCols=features, outputCol="features").transform(table)
    if task == "classification":
        x = x.withColumn("label", F.col("label").cast("int").cast("double"))
    train = x.filter("split = 'train'")
    n = train.count()
    if n < 2 or not x.filter("split = 'test'").limit(1).count():
        raise ValueError("two train rows and a test row are needed")
    if model == "xgboost":
        from lacuna.operators import boosting

        return boosting.predict(boosting.fit(train, features, task=task, **sizes), x.filter("split = 'test'"), features)
    if model == "random_forest":
        from lacuna.operators import forest

        return forest.predict(train, x.filter("split = 'test'"), features, task, **sizes)
    out = estimator(model, task, n, **sizes).fit(train).transform(x.filter("split = 'test'"))
    score = vector_to_array("probability")[1] if task == "classification" else F.col("prediction")
    return out.select("row_id", "label", F.col("prediction").alias("pred"), score.alias("score"))


def downstream(predictions: DataFrame, keys: list[str], task: str = "classification") -> DataFrame:
    """All scores of one model's test rows from one set of predictions."""
    if task == "regression":
        return scores.r2(predictions.withColumnRenamed("label", "truth"), keys)
    out = scores.accuracy_f1(predictions, keys)
    for part in (scores.balanced_accuracy(predictions, keys), scores.ranked_scores(predictions, keys)):
        out = out.join(part, keys)
    return out


CLASS_SCORES, NUMBER_SCORES = ("accuracy", "balanced_accuracy", "f1", "roc_auc", "average_precision"), ("r2",)


def pooled(predictions: DataFrame, keys: list[str], task: str = "classification") -> DataFrame:
    """One prediction per row from those of all imputations: of classes the label most give and the mean score, else the mean."""
    label = predictions.groupBy(*keys, "row_id").agg(F.first("label").alias("label"))
    if task == "regression":
        return predictions.groupBy(*keys, "row_id").agg(F.first("label").alias("label"), F.avg("pred").alias("pred"), F.avg("score").alias("score"))
    return scores.mi_vote(predictions, keys).join(label, [*keys, "row_id"])


def mi_downstream(predictions: DataFrame, keys: list[str], task: str = "classification") -> DataFrame:
    """(keys, metric, mi_mean, mi_std, mi_pooled) from (keys, imputation_id, row_id, label, pred, score).

    Mean and population sd over the imputations where the metric is defined, and the metric of the pooled predictions.
    """
    from lacuna.sources.tables import cut_lineage

    metrics = list(CLASS_SCORES if task == "classification" else NUMBER_SCORES)
    predictions = cut_lineage(predictions)
    each = downstream(predictions, [*keys, "imputation_id"], task).unpivot([*keys, "imputation_id"], metrics, "metric", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    over = each.groupBy(*keys, "metric").agg(F.avg("value").alias("mi_mean"), F.stddev_pop("value").alias("mi_std"))
    one = downstream(cut_lineage(pooled(predictions, keys, task)), keys, task).unpivot(keys, metrics, "metric", "mi_pooled")
    return over.join(one, [*keys, "metric"], "left")


def mi_wide(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per `keys` with `downstream_<metric>_<model>_mi_<mean, std or pooled>`, from `mi_downstream` over keys and model."""
    names = [(m, k) for m in (*CLASS_SCORES, *NUMBER_SCORES) for k in MODELS]
    pick = lambda m, k, c: F.max(F.when((F.col("metric") == m) & (F.col("model") == k), F.col(c))).alias(f"downstream_{m}_{k}_{c}")
    return rows.groupBy(*keys).agg(*[pick(m, k, c) for m, k in names for c in ("mi_mean", "mi_std", "mi_pooled")])


def _downstream_metric(model: str):
    def metric(cells: DataFrame, keys: list[str], target_col: int | None = None, task: str = "classification", **sizes) -> DataFrame:
        """A row per run: accuracy, or R2 in regression, of the model on the test rows."""
        if target_col is None or "split" not in cells.columns:
            raise ValueError("target_col and a split of the rows are needed")
        x = cells.withColumn("pred", F.when(F.col("col_id") == target_col, F.col("truth")).otherwise(F.col("pred")))
        cols = sorted(r.col_id for r in x.select("col_id").distinct().limit(MOST_COLUMNS + 1).collect())
        if len(cols) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns")
        parts = []
        for run in x.select(*keys).distinct().collect():  # a model is fitted for each run
            one = x.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(run[k]) for k in keys]))
            p = predict(wide(one, target_col, max(cols) + 1), [f"f{c}" for c in cols if c != target_col], model, task, **sizes)
            parts.append(downstream(p.withColumns({k: F.lit(run[k]) for k in keys}), keys, task).select(*keys, F.col("accuracy" if task == "classification" else "r2").alias(f"downstream_accuracy_{model}")))
        return reduce(DataFrame.unionByName, parts)

    return metric


for _model in MODELS:
    TABLE_METRICS.register(f"downstream_accuracy_{_model}")(_downstream_metric(_model))


def missforest(cells: DataFrame, keys=KEYS, rounds: int = 2, trees: int = 20, depth: int = 8) -> DataFrame:
    """Chained forests over the cells of each run; a column without values gets the mean of the column means."""
    parts = []
    for run in cells.select(*keys).distinct().collect():  # forests are fitted for each run
        one = cells.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(run[k]) for k in keys]))
        means = {r.col_id: r.mean for r in one.groupBy("col_id").agg(F.avg("value").alias("mean")).limit(MOST_COLUMNS + 1).collect()}
        if len(means) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns")
        known = [m for m in means.values() if m is not None]
        overall = sum(known) / len(known) if known else 0.0
        table = one.groupBy("row_id").pivot("col_id", sorted(means)).agg(F.first("value"))
        table = table.select("row_id", *[(F.col(str(c)) if means[c] is not None else F.lit(overall)).alias(f"f{c}") for c in sorted(means)])
        names = [f"f{c}" for c in sorted(means)]
        done = chained(table, names, rounds, "random_forest", trees, depth).unpivot("row_id", names, "name", "pred").select("row_id", F.substring("name", 2, 20).cast("bigint").alias("col_id"), "pred")
        parts.append(one.join(done, list(AT)).withColumn("pred", F.coalesce("value", "pred")))
    return reduce(DataFrame.unionByName, parts)


IMPUTERS.register("missforest")(missforest)


def _learned(learner: str, train: DataFrame, to: DataFrame, features: list[str], column: str) -> DataFrame:
    """(row_id, predicted) for the rows `to` by a learner of `column` from the other features."""
    if learner == "boosting":
        from lacuna.operators import boosting

        names = lambda x: x.withColumn("label", F.col(column))
        done = boosting.predict(boosting.fit(names(train), features, task="regression", rounds=60, depth=4, rate=0.1), names(to), features)
        return done.select("row_id", F.col("pred").alias("predicted"))
    est = {
        "linear": lambda: LinearRegression(featuresCol="__x", labelCol=column, regParam=1e-3, predictionCol="predicted"),
        "forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=8, seed=0, featuresCol="__x", labelCol=column, predictionCol="predicted"),
    }[learner]()
    x = VectorAssembler(inputCols=features, outputCol="__x")
    return est.fit(x.transform(train)).transform(x.transform(to)).select("row_id", "predicted")


LEARNERS = ("linear", "forest", "boosting")


def searched(table: DataFrame, features: list[str], rounds: int = 5, tol: float = 1e-3, learners: tuple[str, ...] = LEARNERS) -> tuple[DataFrame, list[tuple]]:
    """`table` (row_id, features) without nulls, and a log (round, column, learner, held-out error, change) of how it was filled.

    Columns with missing values are visited from the least missing share to the largest.  In the first round each
    learner is fitted on four fifths of a column's known rows, and the one with the least squared error on the others
    is kept for the column.  A round whose fills differ from the last ones by less than `tol` of the columns' standard
    deviations, root mean square, is the last.  Columns without any value become the mean of the column means.
    """
    from lacuna.sources.tables import Rounds

    stats = table.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in features for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))]).first()
    known = [stats[f"mean_{c}"] for c in features if stats[f"n_{c}"]]
    rest = sum(known) / len(known) if known else 0.0
    holes = sorted((c for c in features if 0 < stats[f"n_{c}"] < stats["n"]), key=lambda c: (-stats[f"n_{c}"], features.index(c)))
    spread = {c: stats[f"sd_{c}"] or 1.0 for c in holes}
    rounds_of = Rounds(table.sparkSession, "columns")
    x = table.select("row_id", *[F.coalesce(c, F.lit(stats[f"mean_{c}"] if stats[f"n_{c}"] else rest)).alias(c) for c in features], *[F.col(c).isNull().alias(f"__{c}") for c in holes])
    x, log, choice = rounds_of.write(x), [], {}
    for k in range(rounds if holes else 0):
        moved = 0.0
        for c in holes:
            others = [f for f in features if f != c]
            seen, error = x.filter(~F.col(f"__{c}")), None
            if k == 0:
                apart = F.pmod(F.xxhash64(F.lit(c), "row_id"), F.lit(5)) == 0
                tried = {}
                for name in learners:
                    done = _learned(name, seen.filter(~apart), seen.filter(apart), others, c).join(seen.select("row_id", F.col(c).alias("truth")), "row_id")
                    tried[name] = done.agg(F.avg((F.col("predicted") - F.col("truth")) ** 2).alias("e")).first().e
                tried = {name: e for name, e in tried.items() if e is not None} or {learners[0]: float("nan")}
                choice[c] = min(tried, key=tried.get)
                error = tried[choice[c]] ** 0.5
            fill = _learned(choice[c], seen, x.filter(F.col(f"__{c}")), others, c)
            after = rounds_of.write(x.join(fill, "row_id", "left").withColumn("__before", F.col(c)).withColumn(c, F.when(F.col(f"__{c}"), F.coalesce("predicted", c)).otherwise(F.col(c))).drop("predicted"))
            change = after.filter(F.col(f"__{c}")).agg(F.avg((F.col(c) - F.col("__before")) ** 2).alias("m")).first().m ** 0.5 / spread[c]
            x = after.drop("__before")
            log.append((k, c, choice[c], error, change))
            moved = max(moved, change)
        if moved < tol:
            break
    return x.drop(*[f"__{c}" for c in holes]), log


LOG = "round int, column string, learner string, error double, change double"


def hyperimpute(cells: DataFrame, keys=KEYS, rounds: int = 5, tol: float = 1e-3, learners: tuple[str, ...] = LEARNERS, log_path: str | None = None) -> DataFrame:
    """Each column of each run by the learner that does best on it (`searched`); the log goes to `log_path`, if given."""
    parts = []
    for run in cells.select(*keys).distinct().collect():  # models are fitted for each run
        one = cells.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(run[k]) for k in keys]))
        cols = sorted(r.col_id for r in one.select("col_id").distinct().limit(MOST_COLUMNS + 1).collect())
        if len(cols) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns")
        names = [f"f{c}" for c in cols]
        table = one.groupBy("row_id").pivot("col_id", cols).agg(F.first("value")).select("row_id", *[F.col(str(c)).cast("double").alias(f"f{c}") for c in cols])
        done, log = searched(table, names, rounds, tol, tuple(learners))
        if log_path:
            rows = cells.sparkSession.createDataFrame(log, LOG).withColumns({k: F.lit(run[k]) for k in keys})
            rows.coalesce(1).write.mode("append").parquet(log_path)  # a row per column and round
        done = done.unpivot("row_id", names, "name", "pred").select("row_id", F.substring("name", 2, 20).cast("bigint").alias("col_id"), "pred")
        parts.append(one.join(done, list(AT)).withColumn("pred", F.coalesce("value", "pred")))
    return reduce(DataFrame.unionByName, parts)


IMPUTERS.register("hyperimpute")(hyperimpute)


def feature_ranking(table: DataFrame, features: list[str], k: int = 20) -> DataFrame:
    """(rank, feature, feature_position, coefficient, size, test_auc): features by the size of their logistic coefficient.

    Missing values become the exact median, features are centred and divided by their population standard deviation,
    all of the train rows; without a `split` all rows are.  `test_auc` is that of the test rows, null without two classes there.
    """
    from lacuna.operators.impute import medians

    table = table if "split" in table.columns else table.withColumn("split", F.lit("train"))
    train = table.filter("split = 'train'")
    if train.filter("label IS NOT NULL").select("label").distinct().limit(3).count() != 2:
        raise ValueError("the target must be binary")
    high = train.agg(F.max("label")).first()[0]
    cells = train.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("col_id", "value"))
    middle = {r.col_id: r.median for r in medians(cells, []).collect()}  # a row per feature
    whole = table.select("split", (F.col("label") == high).cast("double").alias("label"), *[F.coalesce(F.col(f).cast("double"), F.lit(middle.get(j, 0.0))).alias(f) for j, f in enumerate(features)])
    about = whole.filter("split = 'train'").agg(F.count("label").alias("n"), *[g(f).alias(f"{name}_{f}") for f in features for name, g in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    scaled = whole.select("split", "label", *[((F.col(f) - about[f"mean_{f}"]) / (about[f"sd_{f}"] or 1.0)).alias(f) for f in features])
    x = VectorAssembler(inputCols=features, outputCol="features").transform(scaled.filter("label IS NOT NULL"))
    fitted = LogisticRegression(maxIter=5000, regParam=1.0 / about.n, standardization=False).fit(x.filter("split = 'train'"))
    tested = fitted.transform(x.filter("split <> 'train'")).select(F.lit(1).alias("one"), "label", vector_to_array("probability")[1].alias("score"))
    auc = scores.roc_auc(tested, ["one"]).first()
    w = sorted(((abs(c), j, c) for j, c in enumerate(fitted.coefficients.toArray().tolist())), key=lambda e: (-e[0], features[e[1]]))
    rows = [(n, features[j], j, c, size, auc.roc_auc if auc else None) for n, (size, j, c) in enumerate(w[:k], 1)]
    return table.sparkSession.createDataFrame(rows, "rank int, feature string, feature_position int, coefficient double, size double, test_auc double")


def chained(table: DataFrame, features: list[str], rounds: int = 2, model: str = "random_forest", trees: int = 20, depth: int = 8) -> DataFrame:
    """Chained equations: every column with missing values is fitted on the others, in turn, for some rounds.

    Columns without any value become 0.  The state is cut after each round.
    """
    from lacuna.sources.tables import cut_lineage

    row = table.agg(*[F.count(F.col(c)).alias(c) for c in features], F.count(F.lit(1)).alias("__n")).first()
    holes = [c for c in features if 0 < row[c] < row["__n"]]
    means = table.agg(*[F.avg(c).alias(c) for c in features]).first()
    x = table.select("*", *[F.col(c).isNull().alias(f"__{c}") for c in holes]).fillna({c: means[c] if row[c] else 0.0 for c in features})
    for _ in range(rounds):
        for c in holes:
            others = [f for f in features if f != c]
            v = VectorAssembler(inputCols=others, outputCol="__x").transform(x)
            est = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=0, featuresCol="__x", labelCol=c) if model == "random_forest" else LinearRegression(featuresCol="__x", labelCol=c, regParam=1e-3)
            fitted = est.fit(v.filter(~F.col(f"__{c}")))
            x = fitted.transform(v).withColumn(c, F.when(F.col(f"__{c}"), F.col("prediction")).otherwise(F.col(c))).drop("prediction", "__x")
        x = cut_lineage(x)
    return x.drop(*[f"__{c}" for c in holes])
