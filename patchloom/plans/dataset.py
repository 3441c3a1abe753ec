"""Compositions: from advisories and commit tables to labelled samples, as chains of DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from patchloom.operators import filters, joins, patches, rows
from patchloom.streaming.advisories import commits_of


def fix_commits(advisories: DataFrame, bug_classes: DataFrame, source: str = "github") -> DataFrame:
    """Fix commits of advisories with the class of their first weakness."""
    found = commits_of(advisories, source)
    return joins.bug_class(found.withColumn("cwe", found["cwe_id"][0]), bug_classes, "cwe")


def build_dataset(commits: DataFrame, metadata: DataFrame, bug_classes: DataFrame, software_types: DataFrame, extensions: list[str], blacklist: list[str] | None = None) -> DataFrame:
    """Fix rows: commits with their metadata, cleaned, classified, one row for each changed source file."""
    joined = rows.keep_first(joins.attach_by_row(commits, metadata, "commit_sha"), ["commit_sha", "vuln_id"], ["chain_ord_pos"])
    clean = filters.drop_projects(filters.patch_filter(joined), blacklist)
    classed = joins.bug_class(clean.withColumn("cwe", clean["cwe_id"][0]), bug_classes, "cwe").withColumnRenamed("project", "project_url")
    return joins.software_type(patches.fix_scenario(classed, extensions), software_types)
