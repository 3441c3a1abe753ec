"""Ordering, deduplication, pairing and seeded sampling of rows.

Randomness is md5(seed:key), so a result depends on neither partitions nor order, and other engines can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.operators.filters import quoted
from patchloom.operators.ranks import least_rows, ranked, running


def seeded(seed: int, *key: Column | str) -> Column:
    """Random order of a key: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]))


def seeded_fraction(seed: int, *key: Column | str) -> Column:
    """Random number in [0, 1) of a key."""
    return F.conv(F.substring(seeded(seed, *key), 1, 8), 16, 10).cast("double") / 4294967296.0


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rank_ = 1").drop("rank_")


def repeats(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The rows that keep_first drops."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rank_ > 1").drop("rank_")


def keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    return keep_first(df, keys, [F.desc(sequence)])


def dedup_fix_rows(df: DataFrame, sequence: str) -> DataFrame:
    """Last row per all columns but dataset, score, cwe_id, project and the sequence.

    Rows meet by two 64-bit digests of these columns instead of their values, some of which are long arrays.
    """
    keys = [c for c in df.columns if c not in ("dataset", "score", "cwe_id", "project", sequence)]
    placed = df.withColumns({"one_": F.xxhash64(*keys), "two_": F.xxhash64(F.lit(1), *keys)})
    return keep_last(placed, ["one_", "two_"], sequence).drop("one_", "two_")


def func_id(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ids from 0 within each file, in order of all columns; a file's rows may be in many tasks."""
    return running(df, keys, [c for c in df.columns if c not in keys], {"func_id": F.lit(1)}).withColumn("func_id", F.col("func_id").cast("int"))


def order_chain(chains: DataFrame, commits: DataFrame) -> DataFrame:
    """Distinct commits of each chain (chain_id, sha) by author date and sha, with position from 1, the last one, and its parents.

    commits has sha, author_date and parents. A chain with an unknown commit is dropped. before_first_fix_commit holds
    the parents of the last commit, as the column's users expect.
    """
    rows = chains.select("chain_id", "sha").distinct().join(commits, "sha", "left")
    broken = rows.filter("author_date is null").select("chain_id").distinct()
    order = Window.partitionBy("chain_id").orderBy("author_date", "sha")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = rows.join(broken, "chain_id", "left_anti").withColumns({
        "chain_ord_pos": F.row_number().over(order), "last_fix_commit": F.last("sha").over(whole), "before_first_fix_commit": F.last("parents").over(whole),
    })
    return ordered.drop("parents")


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(seeded(seed, key), key)


def sort_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)


def random_rows(df: DataFrame, n: int, seed: int, *key: str, last: bool = False) -> DataFrame:
    """n random rows, those of the least (or the last) seeded order of key."""
    return least_rows(df, n, seeded(seed, *key), list(key), last)


def drop_tag(df: DataFrame, tag: str, ratio: float, seed: int, key: str = "id") -> DataFrame:
    """Drop round(ratio * n) random rows of a tag, or all of them when ratio is 1 or more."""
    other = df.filter(~F.col("tag").eqNullSafe(tag))
    if ratio >= 1:
        return other
    own = df.filter(F.col("tag") == tag)
    n, dropped = own.agg(F.count("*"), F.round(F.count("*") * ratio)).first()
    return other.unionByName(random_rows(own, n - int(dropped), seed, key, last=True))


def single_function_files(df: DataFrame) -> DataFrame:
    """Safe rows, and unsafe rows that are alone in their project, file and label."""
    safe = F.coalesce(F.col("label") == "safe", F.lit(False))
    n = F.count("*").over(Window.partitionBy("project", "fpath", "label"))
    return df.filter(safe).unionByName(df.filter(~safe).withColumn("n_", n).filter("n_ < 2").drop("n_"))


def pair_negatives(vulnerable: DataFrame, negatives: DataFrame, seed: int, keywords: list[str] | None = None) -> DataFrame:
    """Each vulnerable file (id, project, file_path) with a random negative of its project (sha, file_path, message), each used once.

    A negative of the same path doesn't fit (a null path is one of its own); with keywords, nor does one whose message is
    null or starts with one of them. As many files as possible get a partner; the others have nulls.

    Both sides of a project stand in random order of their paths, and at random within a path, and the one side is shifted
    against the other round a circle of M places. With a_p files and b_p negatives of path p, and prefix sums A_p and B_p of
    the paths before it, files of p meet negatives of p only for shifts strictly between B_p - A_p - a_p and
    B_p - A_p + b_p. Where no a_p + b_p is above M, these intervals together are no longer than M, so the largest
    B_p - A_p + b_p is a shift at which no such pair meets. M is the largest of both sides' rows and of all a_p + b_p, and
    the places that are left over are one more path. This is a maximum: either the smaller side is used up, or the path
    with the largest a_p + b_p meets all rows of other paths.
    """
    pool = negatives
    if keywords is not None:
        pool = pool.filter(F.col("message").isNotNull() & ~F.col("message").rlike(quoted(keywords)))
    names = ["non_vuln_commit_hash", "non_vuln_file_path"]
    pool = pool.select("project", F.col("sha").alias(names[0]), F.col("file_path").alias(names[1])).distinct()
    counts = vulnerable.select("project", F.col("file_path").alias("path_"), F.lit(1).alias("a_"), F.lit(0).alias("b_"))
    counts = counts.union(pool.select("project", names[1], F.lit(0), F.lit(1))).groupBy("project", "path_").agg(F.sum("a_").alias("a_"), F.sum("b_").alias("b_"))
    sizes = counts.groupBy("project").agg(F.sum("a_").alias("a"), F.sum("b_").alias("b"), F.max(F.col("a_") + F.col("b_")).alias("c")).withColumn("m_", F.greatest("a", "b", "c"))
    left_over = sizes.select("project", F.lit(None).cast("string").alias("path_"), (F.col("m_") - F.col("a")).alias("a_"), (F.col("m_") - F.col("b")).alias("b_"), F.lit(True).alias("over_"))
    paths = counts.withColumn("over_", F.lit(False)).unionByName(left_over)
    paths = running(paths, ["project"], ["over_", seeded(seed + 1, F.coalesce("path_", F.lit(""))), "path_"], {"at_a_": F.col("a_"), "at_b_": F.col("b_")})
    shift = paths.groupBy("project").agg(F.max(F.col("at_b_") + F.col("b_") - F.col("at_a_")).alias("shift_"), F.sum("a_").alias("m_"))
    starts = paths.filter(~F.col("over_")).join(shift, "project").select(F.col("project").alias("of_"), "path_", "at_a_", "at_b_", "shift_", "m_")

    def placed(df: DataFrame, path: str, keys: list[str], start: str) -> DataFrame:
        rows = ranked(df, ["project", path], seeded(seed, *keys), keys)
        met = rows.join(starts, (F.col("project") == F.col("of_")) & F.col(path).eqNullSafe(F.col("path_")))
        return met.withColumn("place_", F.col(start) + F.col("r_") - 1)

    files = placed(vulnerable, "file_path", ["id"], "at_a_").withColumn("place_", (F.col("place_") + F.col("shift_")) % F.col("m_")).select(*vulnerable.columns, "place_")
    others = placed(pool, names[1], names, "at_b_").select("project", "place_", *names)
    return files.join(others, ["project", "place_"], "left").select(*vulnerable.columns, *names).unionByName(vulnerable.filter("project IS NULL"), allowMissingColumns=True)


def augment(vulnerable: DataFrame, negatives: DataFrame, n: int, seed: int) -> DataFrame:
    """n further negatives for each vulnerable file of a project, as rows of dataset non-vuln; n < 1 is an error."""
    if n < 1:
        raise ValueError("n must be at least 1")
    a = ranked(vulnerable, ["project"], seeded(seed, "id"), ["id"])
    wanted = a.select("project", "project_url", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col("r_") - 1) * n + i + 1)).alias("r_"))
    b = ranked(negatives.distinct(), ["project"], seeded(seed, "sha", "file_path"), ["file_path"])
    b = b.select("project", "r_", F.col("sha").alias("non_vuln_commit_hash"), F.col("file_path").alias("non_vuln_file_path"))
    return wanted.join(b, ["project", "r_"]).drop("r_").withColumn("dataset", F.lit("non-vuln"))


def random_files(files: DataFrame, targets: DataFrame, seed: int, max_commits: int | None = None) -> DataFrame:
    """Random commits' candidate files (project, sha, file_path) per project until targets' target is reached.

    Commits come in random order; one is taken while fewer files than the target came before it, and at most max_commits.
    """
    per = files.groupBy("project", "sha").agg(F.count("*").alias("n"))
    order = ranked(per, ["project"], seeded(seed, "sha"), ["sha"], F.col("n"))
    taken = order.join(targets, "project").filter(F.col("before_") < F.col("target"))
    taken = taken.filter(F.col("r_") <= max_commits) if max_commits else taken
    return files.join(taken.select("project", "sha"), ["project", "sha"], "left_semi")


def lookup_status(found: DataFrame, targets: DataFrame, visited: DataFrame) -> DataFrame:
    """status per project: success when the target is reached, visited when all its commits were seen, else stop."""
    n = found.groupBy("project").agg(F.count("*").alias("n"))
    rows = targets.join(n, "project", "left").join(visited, "project", "left")
    done = F.coalesce("n", F.lit(0)) >= F.col("target")
    return rows.select("project", F.when(done, "success").when(F.coalesce("all_seen", F.lit(False)), "visited").otherwise("stop").alias("status"))


def upsert_status(lookup: DataFrame, updates: DataFrame) -> DataFrame:
    """One status per project_url, that of the largest seq."""
    return keep_last(lookup.unionByName(updates), ["project_url"], "seq")


def open_projects(projects: DataFrame, lookup: DataFrame) -> DataFrame:
    return projects.join(lookup.filter(F.col("status").isin("success", "visited")).select("project_url").distinct(), "project_url", "left_anti")


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
