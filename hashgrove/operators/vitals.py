"""Person-day features, deviation from a person's baseline, rates and a baseline classifier."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashgrove.operators.quantiles import exact_quantiles
from hashgrove.session import materialize

READINGS = ("body_temperature", "heart_rate", "blood_oxygen")


def person_day(df: DataFrame) -> DataFrame:
    """Mean, least and greatest of each reading per person and day.

    A mean without any reading takes the population median, marked by ``<reading>_missing``. The medians of all readings
    are exact and found together, from counts per value.
    """
    days = df.groupBy("person_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("readings"),
        F.max("age").alias("age"),
        F.max("location").alias("location"),
        F.bool_or("confirmed").alias("confirmed"),
        *[F.avg(r).alias(f"{r}_mean") for r in READINGS],
        *[F.min(r).alias(f"{r}_min") for r in READINGS],
        *[F.max(r).alias(f"{r}_max") for r in READINGS],
    )
    long = df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reading"), F.col(r).cast("double").alias("value")) for r in READINGS])).alias("r"))
    # one row for each reading
    medians = {m["reading"]: m["q"][0] for m in exact_quantiles(long.select("r.*"), "reading", "value", [0.5]).collect()}
    filled = {}
    for r in READINGS:
        mean = F.col(f"{r}_mean")
        filled[f"{r}_missing"] = mean.isNull()
        filled[f"{r}_mean"] = F.coalesce(mean, F.lit(medians.get(r)).cast("double"))
    return days.withColumns(filled)


def baseline_deviation(df: DataFrame, days: int = 7) -> DataFrame:
    """A person's daily temperature against the mean of that person's ``days`` rows before."""
    daily = df.groupBy("person_id", F.to_date("ts").alias("day")).agg(
        F.avg("body_temperature").alias("temperature")
    )
    before = Window.partitionBy("person_id").orderBy("day").rowsBetween(-days, -1)
    return daily.withColumn(
        "deviation", F.col("temperature") - F.avg("temperature").over(before)
    )


def location_rate(df: DataFrame) -> DataFrame:
    """Persons seen and share of confirmed cases by location and day, each person once."""
    persons = df.groupBy("location", F.to_date("ts").alias("day"), "person_id").agg(
        F.bool_or("confirmed").alias("confirmed")
    )
    return persons.groupBy("location", "day").agg(
        F.count(F.lit(1)).alias("persons"),
        (F.count_if("confirmed") / F.count(F.lit(1))).alias("rate"),
    )


def _person_features(df: DataFrame) -> DataFrame:
    means = person_day(df).groupBy("person_id").agg(
        F.max("age").cast("double").alias("age"),
        F.bool_or("confirmed").cast("double").alias("label"),
        *[F.avg(f"{r}_mean").alias(r) for r in READINGS],
        *[F.avg(F.col(f"{r}_missing").cast("double")).alias(f"{r}_missing") for r in READINGS],
    )
    inputs = ["age", *READINGS, *[f"{r}_missing" for r in READINGS]]
    # one row per person, read again by each pass of the fit
    written = materialize(means, "person-features")
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(written)


def person_features(df: DataFrame, train_percent: int = 80) -> DataFrame:
    """One row of inputs per person with the label and whether the person is learned from.

    Persons, not readings, are split, by the first byte of the MD5 of their id.
    """
    first_byte = F.conv(F.substring(F.md5(F.col("person_id").cast("string")), 1, 2), 16, 10).cast("int")
    return _person_features(df).withColumn("train", first_byte * 100 < 256 * train_percent)


def confirmed_classifier(
    df: DataFrame, train_percent: int = 80
) -> tuple[DataFrame, float]:
    """Scores of all persons by a class-weighted logistic regression, and the area under ROC of the held-out ones."""
    persons = person_features(df, train_percent)
    # names both classes, should the training persons have only one
    both = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}
    persons = persons.withColumn("label", F.col("label").alias("label", metadata=both))
    train = persons.where("train")
    share = train.agg(F.avg("label").alias("share")).select("share").scalar()
    weighted = train.withColumn(
        "weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    )
    model = LogisticRegression(weightCol="weight", maxIter=20).fit(weighted)
    scored = model.transform(persons)
    area = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(scored.where("not train"))
    inputs = ["age", *READINGS, *[f"{r}_missing" for r in READINGS]]
    scores = scored.select(
        "person_id", vector_to_array("probability")[1].alias("score"), F.col("label").cast("int"), "train", *inputs
    )
    return scores, area
