"""Tables with an explicit schema, NaN read as NULL, column roles kept as field metadata."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import nan_to_null

# The columns of the public UCI clinical table (id 45) with type, role and meaning.
CLINICAL_COLUMNS = [
    ("age", T.DoubleType(), "continuous", "years"),
    ("sex", T.IntegerType(), "binary", "1 = male"),
    ("cp", T.IntegerType(), "nominal", "chest pain type, 1 to 4"),
    ("trestbps", T.DoubleType(), "continuous", "resting blood pressure, mm Hg"),
    ("chol", T.DoubleType(), "continuous", "serum cholesterol, mg/dl"),
    ("fbs", T.IntegerType(), "binary", "fasting blood sugar above 120 mg/dl"),
    ("restecg", T.IntegerType(), "nominal", "resting electrocardiogram, 0 to 2"),
    ("thalach", T.DoubleType(), "continuous", "maximum heart rate, beats per minute"),
    ("exang", T.IntegerType(), "binary", "exercise induced angina"),
    ("oldpeak", T.DoubleType(), "continuous", "ST depression"),
    ("slope", T.IntegerType(), "nominal", "slope of the ST segment, 1 to 3"),
    ("ca", T.DoubleType(), "continuous", "major vessels coloured, 0 to 3"),
    ("thal", T.DoubleType(), "nominal", "3, 6 or 7"),
    ("num", T.IntegerType(), "target", "severity, 0 to 4"),
]

CLINICAL_SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType(), False, {"role": "key", "description": "row number"})]
    + [T.StructField(name, kind, True, {"role": role, "description": text}) for name, kind, role, text in CLINICAL_COLUMNS]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """Read parquet or CSV; floating NaN becomes NULL so that every aggregate skips it.

    CSV needs an explicit schema: inference would scan the file twice and guess types.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if fmt == "csv" and schema is None:
        raise ValueError("a CSV source needs an explicit schema")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return with_roles(nan_to_null(df), {f.name: f.metadata for f in schema.fields} if schema is not None else {})


def with_roles(df: DataFrame, roles: dict[str, dict]) -> DataFrame:
    """Attach ``{"role": ..., "description": ...}`` to columns as field metadata."""
    for name, meta in roles.items():
        if meta:
            df = df.withMetadata(name, meta)
    return df


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: ``(column, type, role, description, non_null)``."""
    counts = df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in df.schema.fields])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(f.metadata.get("role", "")).alias("role"),
            F.lit(f.metadata.get("description", "")).alias("description"),
            F.col(f.name).alias("non_null"),
        )
        for f in df.schema.fields
    ]
    return counts.select(F.inline(F.array(*rows)))


def shape(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def join_on_key(features: DataFrame, target: DataFrame, key: str = "row_id") -> DataFrame:
    """Put feature and target columns side by side, one row per key."""
    return features.join(target, key, "inner")


def read_labels(spark: SparkSession, path: str, column: str = "target") -> DataFrame:
    """A one-column integer label file with a header."""
    return spark.read.schema(f"{column} int").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)
