"""Advisory streams: the stateless steps run on a stream as they do on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.refs import clean_github_refs, explode_chain, normalize_refs, split_github_urls
from patchloom.operators.filters import filter_by_source, filter_code_refs, with_found
from patchloom.sources import schemas
from patchloom.sources.files import osv_columns


def stream_osv_commits(spark: SparkSession, path: str, source: str = "github") -> DataFrame:
    """Fix commits of advisories as their files arrive below path (one folder for each ecosystem)."""
    raw = spark.readStream.schema(schemas.OSV).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return commits_of(osv_columns(raw.withColumn("ecosystem", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))), source)


def commits_of(advisories: DataFrame, source: str = "github") -> DataFrame:
    """One row for each fix commit of advisories with refs, on one source."""
    rows = with_found(filter_code_refs(advisories.filter("refs is not null")), "code_refs", normalize_refs(F.col("code_refs")))
    return explode_chain(with_found(filter_by_source(rows, source), "chain", clean_github_refs(split_github_urls(F.col("commits")))))
