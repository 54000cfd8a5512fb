"""HR sheet: load as text, strip headers, rename and cast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movewell.fixed_values import HR_DISTANCE, HR_ID, HR_MODE, HR_SALARY, HR_UNIT


def read_hr(spark: SparkSession, path: str, fmt: str = "csv", **options: str) -> DataFrame:
    """The sheet as stored. CSV columns stay text; load_hr casts the ones it needs."""
    if fmt == "csv":
        options = {"header": "true", **options}
    return strip_headers(spark.read.format(fmt).options(**options).load(path))


def strip_headers(sheet: DataFrame) -> DataFrame:
    return sheet.toDF(*(name.strip() for name in sheet.columns))


def load_hr(sheet: DataFrame) -> DataFrame:
    """Typed HR reference. A value that does not parse becomes null instead of failing the job."""
    sheet = strip_headers(sheet)
    return sheet.select(
        F.col(f"`{HR_ID}`").try_cast("bigint").alias("employee_id"),
        F.col(f"`{HR_UNIT}`").alias("bu"),
        F.col(f"`{HR_MODE}`").alias("moyen_dep"),
        F.col(f"`{HR_SALARY}`").try_cast("double").alias("salaire_brut_annuel"),
        F.col(f"`{HR_DISTANCE}`").try_cast("double").alias("distance_km"),
    )


def hr_ids(hr: DataFrame) -> DataFrame:
    """Distinct known employee ids, kept distributed."""
    return hr.select(F.col("employee_id").cast("bigint").alias("employee_id")).dropna().distinct()


def write_hr(hr: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the enriched sheet to a folder of its own; one that it is read from is refused."""
    hadoop = hr.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path).toUri().getPath().rstrip("/")
    if any(f"{hadoop(file).toUri().getPath()}/".startswith(f"{target}/") for file in hr.inputFiles()):
        raise ValueError(f"{path} holds the sheet that is read; write to another folder")
    hr.write.format(fmt).mode("overwrite").save(path)
