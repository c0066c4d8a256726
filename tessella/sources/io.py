"""Readers and writers: CSV and Parquet in, predictions out, sample data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.units import first_occurrence
from .roles import Roles


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", infer: bool = False) -> DataFrame:
    """A CSV file with a header; quoted cells, doubled quotes, one line a row, blank lines skipped. Strings unless inferred; of columns that share a name the last stays."""
    df = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=False, inferSchema=infer, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    plain = spark.read.csv(path, header=False, sep=delimiter, quote='"', escape='"').head(1)
    if not plain:
        raise ValueError(f"{path} is empty")
    names = [x or f"_c{k}" for k, x in enumerate(plain[0])]
    renamed = df.toDF(*[f"c{k}" for k in range(len(names))])
    return renamed.select(*[F.col(f"c{names[: len(names)].index(n) if names.count(n) == 1 else max(i for i, x in enumerate(names) if x == n)}").alias(n) for n in dict.fromkeys(names)])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or a CSV file by its name."""
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def count_rows(spark: SparkSession, path: str) -> int:
    return read_table(spark, path).count()


def column_index(df: DataFrame, name: str) -> int:
    return df.columns.index(name) if name in df.columns else -1


def from_two_tables(units: DataFrame, obs: DataFrame, roles: Roles, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Units and observations by their roles; observations of unknown units are dropped."""
    roles.check(units, obs)
    u, o = roles.units_of(units, keep), roles.obs_of(obs)
    if u.groupBy("unit_id").count().where("count > 1").head(1):
        raise ValueError(f"{roles.unit} does not identify units: some value occurs twice")
    return u, o.join(u.select("unit_id"), "unit_id", "left_semi")


def from_one_table(rows: DataFrame, roles: Roles, order: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The same from one denormalised table: a unit's own columns are those of its first row in the order given."""
    roles.check(rows, rows)
    first = first_occurrence(rows.where(F.col(roles.unit).isNotNull()), roles.unit, order)
    return roles.units_of(first, keep), roles.obs_of(rows)


def from_pandas(spark: SparkSession, units, obs, roles: Roles, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Units and observations of two pandas frames, which the driver holds already; missing values of any kind are nulls."""
    return from_two_tables(_of_pandas(spark, units), _of_pandas(spark, obs), roles, keep)


def _of_pandas(spark: SparkSession, rows) -> DataFrame:
    texts = rows.select_dtypes(exclude=["number", "bool", "datetime"])
    df = spark.createDataFrame(rows.assign(**{c: x.astype(object).where(x.notna(), None) for c, x in texts.items()}))
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").csv(path, header=True, nullValue="NA")


def sample_data(spark: SparkSession, units: int = 50, items: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Units with three covariates and two targets, and 3 to 11 observations of each; for tests and trials."""
    u = spark.range(units).select(
        F.format_string("u%05d", "id").alias("unit_id"), (F.rand(seed) * 20 + 40).alias("latitude"), (F.rand(seed + 1) * 30).alias("longitude"),
        (F.rand(seed + 2) * 2000).alias("elevation"), (F.rand(seed + 3) * 4 + 4).alias("ph"), F.exp(F.randn(seed + 4)).alias("nitrogen"), (F.rand(seed + 5) * 3).cast("int").alias("habitat"),
    )
    n = F.expr("3 + cast(pmod(xxhash64(unit_id), 9) AS int)")
    o = u.select("unit_id", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("code", F.pmod(F.xxhash64("unit_id", "k", F.lit(seed)), F.lit(items)))
    o = o.select("unit_id", F.format_string("item%04d", "code").alias("item"), (F.pmod(F.xxhash64("unit_id", "k"), F.lit(1000)) / 10 + 0.1).alias("weight"), F.format_string("g%03d", (F.col("code") / 5).cast("long")).alias("genus"), F.format_string("f%02d", (F.col("code") / 20).cast("long")).alias("family"))
    return u, o
