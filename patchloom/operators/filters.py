"""Row filters of the cleaning, generating and labelling stages. Negative predicates keep null values."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from patchloom.functions.refs import code_refs, file_extension, refs_of_source
from patchloom.operators.ranks import quantiles

UNKNOWN_CWES = ("NVD-CWE-Other", "NVD-CWE-noinfo", "Unknown")
SOFTWARE_TYPES = ("utility", "middleware", "framework", "operating system", "web application", "server", "browser", "unk")


def with_refs(df: DataFrame, column: str = "refs") -> DataFrame:
    """Rows whose array is there and holds something but "nan"."""
    return df.filter(F.size(F.filter(F.coalesce(column, F.array()), lambda r: r.isNotNull() & (r != "nan"))) > 0)


def with_found(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column of value, without rows where that is null. A generator keeps later filters from computing it again."""
    return df.withColumn("found_", F.explode(F.array(value))).filter("found_ is not null").withColumn(name, F.col("found_")).drop("found_")


def filter_code_refs(df: DataFrame, refs: str = "refs") -> DataFrame:
    return with_found(df, "code_refs", code_refs(F.col(refs)))


def filter_by_source(df: DataFrame, source: str, refs: str = "code_refs") -> DataFrame:
    return with_found(df, "commits", refs_of_source(F.col(refs), source))


def patch_filter(df: DataFrame) -> DataFrame:
    """Rows with a class, a last fix and a first parent, not of a merge; before_first_fix_commit becomes its first element."""
    merge = F.coalesce(F.lower("message"), F.lit("")).contains("merge message")
    rows = df.filter(F.col("cwe_id").isNotNull() & F.col("last_fix_commit").isNotNull() & ~merge)
    return rows.withColumn("before_first_fix_commit", F.get("before_first_fix_commit", 0)).filter("before_first_fix_commit is not null")


def drop_multi_cwe(df: DataFrame) -> DataFrame:
    return df.filter(F.size("cwe_id") == 1)


def drop_unknown_cwe(df: DataFrame) -> DataFrame:
    return df.filter(~F.arrays_overlap("cwe_id", F.array(*map(F.lit, UNKNOWN_CWES))))


def drop_projects(df: DataFrame, blacklist: list[str] | None, column: str = "commit_href") -> DataFrame:
    """Rows whose URL matches none of the patterns; null or no patterns drop nothing, and a null URL stays."""
    return df.filter(~F.coalesce(F.col(column).rlike("|".join(blacklist)), F.lit(False))) if blacklist else df


def by_language(df: DataFrame, languages: list[str], table: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Rows with one of the requested languages, and the extensions of those; unknown names are skipped with a warning."""
    known = [name for name in languages if name in table]
    if unknown := [name for name in languages if name not in table]:
        warnings.warn(f"no extensions are known for {', '.join(unknown)}", stacklevel=2)
    rows = df.filter(F.arrays_overlap("language", F.array(*map(F.lit, known)).cast("array<string>")))
    return rows, [e for name in known for e in table[name]]


def is_source_file(path: Column, extensions: list[str] | None = None) -> Column:
    """Whether a path has one of the extensions (of its part after the last dot) and is no test."""
    test = path.contains("tests/") | path.contains("test/") | F.lower(F.element_at(F.split(path, "/"), -1)).contains("test")
    return ~test & F.lower(F.element_at(F.split(path, r"\."), -1)).isin(extensions) if extensions else ~test


def drop_renamed_removed(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("status").eqNullSafe("renamed") & ~F.col("status").eqNullSafe("removed"))


def max_pair_size(df: DataFrame, limit: float) -> DataFrame:
    """File pairs with a mean size below limit; missing size columns are an error."""
    if missing := {"a_file_size", "b_file_size"}.difference(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    return df.filter((F.col("a_file_size") + F.col("b_file_size")) / 2 < limit)


def similarity_filter(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    return df.filter(F.col("sim_ratio") >= threshold).withColumn("sim_ratio", F.round("sim_ratio", 3))


def scanned_versions(findings: DataFrame, dataset: DataFrame, parent: bool = True, fix: bool = True) -> DataFrame:
    """Findings in versions that are a parent or a fix of the dataset, as asked for."""
    names = ["a_version"] * parent + ["b_version"] * fix
    versions = dataset.select(F.explode(F.array(*names).cast("array<string>")).alias("version")).distinct()
    return findings.join(versions, "version", "left_semi")


def drop_other(df: DataFrame, column: str, wanted: object) -> DataFrame:
    """Drop unsafe rows whose column isn't wanted (null included) and the safe rows that share their vuln_commit_hash."""
    other = df.filter((F.col("label") == "unsafe") & ~F.col(column).eqNullSafe(F.lit(wanted)))
    hashes = other.select("vuln_commit_hash").filter("vuln_commit_hash is not null").distinct().withColumn("other_", F.lit(True))
    rows = df.join(hashes, "vuln_commit_hash", "left")
    drop = (F.col("label") == "unsafe") & ~F.col(column).eqNullSafe(F.lit(wanted)) | (F.col("label") == "safe") & F.col("other_").isNotNull()
    return rows.filter(~F.coalesce(drop, F.lit(False))).select(*df.columns)


def attribute_filters(
    df: DataFrame, bf_class: str | None = None, cwe: int | None = None, project: str | None = None, software_type: str | None = None
) -> DataFrame:
    """Rows of the target class, weakness, project and software type; a project or type that is unknown is an error."""
    if bf_class:
        df = drop_other(df, "bf_class", bf_class)
    if cwe:
        df = drop_other(df, "cwe_id", cwe)
    if project:
        if df.filter(F.col("project") == project).isEmpty():
            raise ValueError(f"no project {project} in the data")
        df = df.filter(F.col("project") == project)
    if software_type:
        if software_type not in SOFTWARE_TYPES:
            raise ValueError(f"no software type {software_type}")
        df = df.filter(F.col("sw_type") == software_type)
    return df


def between_quantiles(df: DataFrame, column: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows within the exact quantiles of a column."""
    least, most = quantiles(df, column, [low, high])
    return df.filter(F.col(column).between(F.lit(least), F.lit(most)))


def negative_candidates(files: DataFrame, excluded: DataFrame, extensions: list[str]) -> DataFrame:
    """Modified source files of the extensions, not excluded and without test in their name."""
    rows = files.join(excluded.select("file_path").distinct(), "file_path", "left_anti")
    return rows.filter(~F.lower("file_path").contains("test") & (F.col("status") == "modified") & file_extension(F.col("file_path")).isin(extensions))


def nonempty_code(df: DataFrame, code: str = "code", lost: Observation | None = None) -> DataFrame:
    """Rows whose code isn't null or blank; lost gets the number of others as lost["rows"], without another pass, once the result is used."""
    good = F.coalesce(F.length(F.trim(code)) > 0, F.lit(False))
    rows = df if lost is None else df.observe(lost, F.count_if(~good).alias("rows"))
    return rows.filter(good)


def quoted(keywords: list[str]) -> str:
    """Pattern of messages that start with one of the keywords."""
    return "^(" + "|".join(re.escape(k) for k in keywords) + ")"
