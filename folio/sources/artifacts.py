"""A content-addressed artifact table: idempotent puts, latest versions, lookups by hash."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import schemas
from folio.operators.registry import latest

KEYS = ["document_id", "family", "scope", "entity_id"]


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class ArtifactStore:
    """A Parquet table partitioned by family, at a path that all executors reach.

    Putting the same content again adds a row with a newer time only, which keeps it the latest; the
    body is stored once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/{name}", schema)

    @property
    def bodies(self) -> DataFrame:
        return self._read("bodies", "document_id string, scope string, entity_id string, content_hash string, body string, family string")

    @property
    def touches(self) -> DataFrame:
        return self._read("touches", "document_id string, scope string, entity_id string, content_hash string, written_at timestamp, family string")

    def put(self, rows: DataFrame) -> DataFrame:
        """rows: KEYS, body (canonical JSON), written_at. Returns them with content_hash; bodies already stored are not written again."""
        hashed = rows.withColumn("content_hash", F.substring(F.sha2("body", 256), 1, 12))
        new = hashed.join(self.bodies.select(*KEYS, "content_hash"), [*KEYS, "content_hash"], "left_anti").dropDuplicates([*KEYS, "content_hash"])
        new.select("document_id", "scope", "entity_id", "content_hash", "body", "family").write.mode("append").partitionBy("family").parquet(f"{self.path}/bodies")
        hashed.select("document_id", "scope", "entity_id", "content_hash", "written_at", "family").write.mode("append").partitionBy("family").parquet(f"{self.path}/touches")
        return hashed.select(*KEYS, "content_hash")

    def latest(self, family: str) -> DataFrame:
        """KEYS, content_hash, body of the newest version of each entity of a family."""
        newest = latest(self.touches.where(F.col("family") == family), KEYS, "written_at", "content_hash")
        return newest.join(self.bodies, [*KEYS, "content_hash"])

    def get(self, refs: DataFrame) -> DataFrame:
        """The bodies of refs (KEYS, content_hash); a ref without one raises when the result is computed."""
        rows = refs.join(self.bodies, [*KEYS, "content_hash"], "left")
        return rows.withColumn("body", F.when(F.col("body").isNull(), F.raise_error(F.concat(F.lit("no artifact "), "content_hash"))).otherwise(F.col("body")))

    def pages(self, document_id: str, families: tuple[str, ...]) -> DataFrame:
        """Distinct entities of a document over several families, in order."""
        return self.touches.where((F.col("document_id") == document_id) & F.col("family").isin(*families)).select("entity_id").distinct().orderBy("entity_id")


def read_json_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A JSON table with its fixed schema; nothing is inferred."""
    return spark.read.schema(schemas.TABLES[name]).json(path)


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, sha256 of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def page_manifest(documents: DataFrame) -> DataFrame:
    """document_id, page_number, page_id from document_id, page_count."""
    from folio.functions.ids import page_id

    rows = documents.where("page_count > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"))
    return rows.withColumn("page_id", page_id(F.col("page_number")))


def page_filter(spark: SparkSession, spec: str) -> DataFrame:
    """page_id of a filter such as 15,18-20."""
    from folio.functions.ids import page_id

    parts = spark.createDataFrame([(p.strip(),) for p in spec.split(",") if p.strip()], "part string")
    ends = F.split("part", "-")
    low, high = ends[0].cast("int"), F.coalesce(F.try_element_at(ends, F.lit(2)), ends[0]).cast("int")
    return parts.select(F.explode(F.sequence(low, high)).alias("n")).select(page_id(F.col("n")).alias("page_id")).distinct()
