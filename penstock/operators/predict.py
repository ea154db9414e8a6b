"""Training data for forecasts and categories, and models by pyspark.ml."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money_sum
from .spend import SPEND


def spending_grid(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Month by category, filled with zeros; a fact's amount is split evenly over its categories, else it goes to its vendor. The grid has months times groups, both known by then."""
    cats = items.where("category is not null").select("fact_id", "category").distinct()
    k = cats.groupBy("fact_id").agg(F.count("*").alias("k"))
    f = facts.where(F.col("fact_type").isin(*SPEND)).select("id", "vendor", "total_amount", F.trunc("event_date", "MM").alias("month"))
    rows = f.join(cats, F.col("id") == F.col("fact_id"), "left").join(k, "fact_id", "left")
    rows = rows.select("month", F.coalesce("category", "vendor").alias("group"), (F.col("total_amount") / F.coalesce("k", F.lit(1))).alias("a")).groupBy("month", "group").agg(money_sum("a").alias("amount"))
    months = rows.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    grid = rows.select("group").distinct().crossJoin(F.broadcast(months))
    return grid.join(rows, ["month", "group"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))


def forecast(grid: DataFrame, window: int = 6, horizon: int = 3) -> DataFrame:
    """Linear regression on the last months' amounts, pooled over groups; horizon months ahead, one after another."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    w = Window.partitionBy("group").orderBy("month")
    lags = [f"l{i}" for i in range(1, window + 1)]
    rows = grid.select("group", "month", "amount", *[F.lag("amount", i).over(w).alias(f"l{i}") for i in range(1, window + 1)]).na.drop()
    va = VectorAssembler(inputCols=lags, outputCol="x")
    model = LinearRegression(featuresCol="x", labelCol="amount", regParam=0.1).fit(va.transform(rows))
    last = grid.groupBy("group").agg(F.max("month").alias("m"), F.slice(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("month", "amount"))), lambda x: x["amount"])), 1, window).alias("h")).where(F.size("h") == window)
    coef, b = F.array(*[F.lit(float(c)) for c in model.coefficients]), float(model.intercept)
    out = last
    for i in range(1, horizon + 1):
        nxt = F.greatest(F.lit(0.0), F.aggregate(F.zip_with("h", coef, lambda x, c: x * c), F.lit(b), lambda s, x: s + x))
        out = out.withColumn(f"p{i}", nxt).withColumn("h", F.slice(F.concat(F.array(f"p{i}"), "h"), 1, window))
    steps = F.array(*[F.struct(F.add_months("m", i).alias("month"), F.round(f"p{i}", 2).alias("amount")) for i in range(1, horizon + 1)])
    return out.select("group", F.inline(steps))


def category_training(stars: DataFrame, least: int = 5) -> DataFrame:
    """name, vendor, category of categories with enough examples."""
    often = stars.groupBy("category").count().where(F.col("count") >= least).select("category")
    return stars.where("category is not null").join(often, "category", "left_semi").select("name", "vendor", "category")


def train_category_classifier(rows: DataFrame, least: int = 50):
    """A pipeline of tokens, hashed counts and logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, StringIndexer, Tokenizer

    if rows.count() < least:
        raise ValueError(f"fewer than {least} rows to learn from")
    stages = [StringIndexer(inputCol="category", outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"), Tokenizer(inputCol="name", outputCol="tokens"), HashingTF(inputCol="tokens", outputCol="features", numFeatures=1 << 12), LogisticRegression(maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(rows)


def classify(model, rows: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    from pyspark.ml.feature import IndexToString
    from pyspark.ml.functions import vector_to_array

    names = model.stages[0].labels
    out = rows
    for stage in model.stages[1:]:
        out = stage.transform(out)
    out = IndexToString(inputCol="prediction", outputCol="predicted", labels=names).transform(out)
    return out.withColumn("confidence", F.array_max(vector_to_array("probability"))).where(F.col("confidence") >= min_confidence).drop("tokens", "features", "rawPrediction", "probability", "prediction")
