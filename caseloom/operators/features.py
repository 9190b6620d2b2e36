"""Wide per-case features, and optional models on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.policy import DISQUALIFYING, REVIEW
from caseloom.operators.resolve import corroboration

FIELDS = ("visa_class", "sponsor_id", "arrival_date", "species_code", "home_world", "declared_purpose", "applicant_name")
VISAS = ("XW-1", "XW-2", "DIP-1", "MED-3", "TRANSIT-7")
FEES = ("paid", "unpaid", "waived", "unknown")
KINDS = ("adjudicator", "intake", "biometric", "sponsor_letter", "registry", "fee_receipt", "scanned_page")
STAMPS = ("APPROVED", "DENIED", "REVIEW", "NEEDS_REVIEW")
DAMAGE_SHOWN = ("sponsor_id", "visa_class", "arrival_date")


def one_hot(c: Column, values: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.coalesce((c == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in values]


def has(c: Column, values: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.coalesce(F.array_contains(c, v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in values]


def coverage(columns: list[str]) -> tuple[Column, Column]:
    """How many of the columns are known, and their share."""
    n = sum(F.col(c).isNotNull().cast("int") for c in columns)
    return n.alias("known_field_count"), (n / F.lit(float(len(columns)))).alias("known_field_frac")


def stale_margin(reference: Column, arrival: Column, days: int = 180) -> Column:
    return (F.datediff(reference, arrival) - days) / F.lit(float(days))


def packet_features(records: DataFrame, obs: DataFrame, facts: DataFrame, path: str = "path", paths: tuple[str, ...] = ()) -> DataFrame:
    """One wide row of doubles for each record; what depends on the corpus context
    (``reference_date``, ``revoked``) is computed here, after the context was joined."""
    r = records.join(corroboration(obs), "case_id", "left").join(facts, "case_id", "left")
    num = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    margin = stale_margin(F.col("reference_date"), F.col("arrival"))
    known, share = coverage(list(FIELDS))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return r.select(
        "case_id",
        *[F.col(c).isNotNull().cast("double").alias(f"known_{c}") for c in FIELDS],
        known.cast("double").alias("known_field_count"),
        share.alias("known_field_frac"),
        *[num(F.col(c)).alias(c) for c in ("obs_total", "fields_corroborated", "fields_conflicting")],
        F.size(flags).cast("double").alias("n_flags"),
        F.arrays_overlap(flags, F.array(*map(F.lit, DISQUALIFYING))).cast("double").alias("has_disqualifying"),
        F.size(F.array_intersect(flags, F.array(*map(F.lit, REVIEW)))).cast("double").alias("n_review_flags"),
        *has(flags, DISQUALIFYING + REVIEW, "flag"),
        *one_hot(F.col("visa_class"), VISAS, "visa"),
        *one_hot(F.col("fee_status"), FEES, "fee"),
        num(F.col("flags_known")).alias("risk_flags_known"),
        F.coalesce("biometric_confidence", F.lit(-1.0)).alias("biometric_confidence"),
        F.col("biometric_confidence").isNotNull().cast("double").alias("biometric_confidence_known"),
        F.coalesce(F.array_contains("revoked", F.col("sponsor_id")).cast("double"), F.lit(0.0)).alias("sponsor_revoked"),
        F.coalesce(margin, F.lit(0.0)).alias("stale_margin"),
        margin.isNotNull().cast("double").alias("stale_margin_known"),
        *has(F.col("page_types"), KINDS, "page"),
        F.least(F.coalesce(F.size("page_types"), F.lit(0)), F.lit(20)).cast("double").alias("n_pages"),
        num(F.col("has_text_layer")).alias("has_text_layer"),
        *has(F.col("damaged_fields"), DAMAGE_SHOWN, "damaged"),
        num(F.col("injection_detected")).alias("injection_detected"),
        num(F.col("sample_denial_watermark")).alias("sample_denial_watermark"),
        *has(F.col("stamps"), STAMPS, "stamp"),
        *one_hot(F.col(path), paths, "path"),
    )


def allowed(columns: list[str], banned: tuple[str, ...] = ("case_id",), prefixes: tuple[str, ...] = ("stamp_", "page_")) -> list[str]:
    """Features a model may see, in a fixed order: not identities, nor what gives the verdict away."""
    return sorted(c for c in columns if c not in banned and not c.startswith(prefixes))


def vectorise(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """Columns in training order as one vector; absent and null ones are 0."""
    from pyspark.ml.feature import VectorAssembler

    have = set(df.columns)
    filled = df.select("*", *[(F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)).alias(f"_v_{c}") for c in columns])
    return VectorAssembler(inputCols=[f"_v_{c}" for c in columns], outputCol=name).transform(filled).drop(*[f"_v_{c}" for c in columns])


def candidate_models(label: str = "label", features: str = "features", seed: int = 7) -> dict:
    """The estimators to choose from. Boosted trees are one-vs-rest: Spark ML has two classes only."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler

    scaler = StandardScaler(inputCol=features, outputCol="scaled", withMean=True)
    return {
        "logistic": Pipeline(stages=[scaler, LogisticRegression(featuresCol="scaled", labelCol=label, family="multinomial", regParam=0.01)]),
        "forest": RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=100, seed=seed),
        **{f"boosted_{d}": OneVsRest(classifier=GBTClassifier(featuresCol=features, maxDepth=d, maxIter=40, seed=seed), featuresCol=features, labelCol=label) for d in (2, 3, 4)},
    }


def out_of_fold(df: DataFrame, estimator, folds: int, label: str = "label") -> DataFrame:
    """Probabilities for every row from models that did not see its fold (column ``fold``)."""
    from functools import reduce

    from pyspark.ml.functions import vector_to_array

    parts = []
    for k in range(folds):
        model = estimator.fit(df.where(F.col("fold") != k))
        parts.append(model.transform(df.where(F.col("fold") == k)).select("case_id", F.col(label).alias("label"), vector_to_array("probability").alias("p")))
    return reduce(DataFrame.unionByName, parts)


def load_model(path: str):
    """A saved pipeline, or None where there is none: the path table decides then."""
    from pyspark.ml import PipelineModel

    try:
        return PipelineModel.load(path)
    except Exception as e:  # a missing or unreadable artifact is a defined state
        if "does not exist" in str(e) or "PATH_NOT_FOUND" in str(e) or "No such file" in str(e):
            return None
        raise
