"""From commits and file pairs to labelled files, lines and snippets."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from patchloom.functions.code import change_status, hunk_lines, line_count, pair_hash
from patchloom.functions.refs import repo_path
from patchloom.operators.filters import drop_renamed_removed, is_source_file
from patchloom.operators.rows import dedup_fix_rows, seeded_fraction


def fix_scenario(df: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """One row for each changed source file of a commit, with its changes and lines; renamed and removed files are left out.

    df has the columns of a cleaned dataset: files (map of name to changes), project_url, commit_sha and more.
    """
    rows = df if "project" in df.columns else df.withColumns({"owner": repo_path(F.col("project_url"))["owner"], "project": repo_path(F.col("project_url"))["project"]})
    each = rows.withColumn("seq_", F.xxhash64("commit_sha", "vuln_id")).select(*rows.columns, "seq_", F.explode("files").alias("file_path", "f")).drop("files")
    each = each.filter(is_source_file(F.col("file_path"), extensions))
    lines = hunk_lines(F.col("f.patch"))
    made = each.withColumn("lines_", lines).select(
        *[c for c in ("dataset", "project", "owner", "project_url", "vuln_id", "cwe_id", "score", "bf_class", "operation") if c in each.columns],
        F.col("before_first_fix_commit").alias("vuln_commit_hash"), F.col("last_fix_commit").alias("fixed_commit_hash"), "file_path",
        "f.additions", "f.deletions", "f.changes", F.col("f.raw_url").alias("raw_url_fix"),
        F.replace("f.raw_url", "commit_sha", "before_first_fix_commit").alias("raw_url_vuln"), F.col("lines_.deleted").alias("locs_deleted"),
        F.col("lines_.added").alias("locs_added"), change_status(F.col("f.status"), F.col("f.patch")).alias("status"), F.lit("fix").alias("scenario"), "seq_",
    )
    return dedup_fix_rows(drop_renamed_removed(made), "seq_").drop("seq_")


def diff_blocks(diffs: DataFrame, extensions: list[str], key: str = "id", text: str = "diff") -> DataFrame:
    """key, start (line number from 0), a_path, b_path of a diff's file headers with one of the extensions, no tests, no /dev/null."""
    cut = diffs.select(key, F.explode(F.array(F.split(text, "\n"))).alias("lines_"))
    both = F.arrays_zip(F.col("lines_").alias("line"), F.expr("slice(lines_, 2, size(lines_))").alias("next"))
    paired = cut.select(key, F.posexplode(both).alias("start", "p_")).select(key, "start", "p_.line", "p_.next")
    ends = F.lit(False)
    for e in extensions:
        ends = ends | F.col("line").endswith(e)
    rows = paired.filter(F.col("line").startswith("--- ") & ends & F.col("next").startswith("+++ ")).select(
        key, "start", F.regexp_replace(F.substring("line", 5, 1 << 20), "^a/", "").alias("a_path"), F.regexp_replace(F.substring("next", 5, 1 << 20), "^b/", "").alias("b_path")
    )
    return rows.filter(~F.col("a_path").contains("/dev/null") & ~F.col("b_path").contains("/dev/null") & ~F.col("a_path").contains("test") & ~F.col("b_path").contains("test"))


def _longest_rising(values: np.ndarray) -> np.ndarray:
    """Places of a longest strictly rising subsequence."""
    ends, at, before = [], [], np.full(len(values), -1)
    for i, v in enumerate(values.tolist()):
        j = bisect_left(ends, v)
        before[i] = at[j - 1] if j else -1
        if j == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[j], at[j] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], np.int64)


def _anchors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal lines that a diff of a and b keeps: of the lines rarest on their more frequent side, nth with nth, those that rise together."""
    kinds = np.intersect1d(a, b)
    if not len(kinds):
        return kinds[:0], kinds[:0]
    count = lambda x: np.bincount(np.searchsorted(kinds, x[np.isin(x, kinds)]), minlength=len(kinds))
    n, m = count(a), count(b)
    rare = kinds[np.maximum(n, m) == np.maximum(n, m).min()]

    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of rare lines, sorted by line and place, and (line, nth) of each as a number."""
        at = np.flatnonzero(np.isin(x, rare))
        kind = np.searchsorted(rare, x[at])
        order = np.argsort(kind, kind="stable")
        at, kind = at[order], kind[order]
        first = np.searchsorted(kind, kind)
        return at, kind * np.int64(len(a) + len(b) + 1) + np.arange(len(at)) - first

    at_a, of_a = places(a)
    at_b, of_b = places(b)
    _, i, j = np.intersect1d(of_a, of_b, assume_unique=True, return_indices=True)
    i, j = at_a[i], at_b[j]
    order = np.argsort(i)
    i, j = i[order], j[order]
    kept = _longest_rising(j)
    return i[kept], j[kept]


def changed_blocks(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """[i1, i2, j1, j2] of each run of lines that differ: lines i1 to i2 of a stand for j1 to j2 of b, and all others are equal in order.

    Equal heads and tails are taken off; the rarest common lines of what is left are anchors, most of them lines that stand
    once on each side; and the same goes on between anchors, until nothing is common.
    """
    kept, todo = [np.zeros((0, 2), np.int64)], [(0, len(a), 0, len(b))]
    while todo:
        i1, i2, j1, j2 = todo.pop()
        n = min(i2 - i1, j2 - j1)
        apart = np.flatnonzero(a[i1 : i1 + n] != b[j1 : j1 + n])
        head = int(apart[0]) if len(apart) else n
        kept.append(np.stack([np.arange(i1, i1 + head), np.arange(j1, j1 + head)], 1))
        i1, j1, n = i1 + head, j1 + head, n - head
        apart = np.flatnonzero(a[i2 - n : i2][::-1] != b[j2 - n : j2][::-1])
        tail = int(apart[0]) if len(apart) else n
        kept.append(np.stack([np.arange(i2 - tail, i2), np.arange(j2 - tail, j2)], 1))
        i2, j2 = i2 - tail, j2 - tail
        if i1 < i2 and j1 < j2:
            x, y = _anchors(a[i1:i2], b[j1:j2])
            if len(x):
                x, y = x + i1, y + j1
                kept.append(np.stack([x, y], 1))
                todo += zip([i1, *(x + 1).tolist()], [*x.tolist(), i2], [j1, *(y + 1).tolist()], [*y.tolist(), j2], strict=True)
    same = np.concatenate(kept)
    same = same[np.argsort(same[:, 0])]
    starts = np.concatenate([[[0, 0]], same + 1])
    ends = np.concatenate([same, [[len(a), len(b)]]])
    open_ = (starts < ends).any(1)
    return np.stack([starts[open_, 0], ends[open_, 0], starts[open_, 1], ends[open_, 1]], 1).tolist()


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """changed_blocks of arrays of line digests, so that no text leaves the JVM."""
    return pd.Series([changed_blocks(np.asarray(x), np.asarray(y)) for x, y in zip(a, b, strict=True)])


def _compared(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with a_lines_, b_lines_ and blocks_; a null text has one empty line."""
    lines = lambda text: F.split(F.coalesce(text, F.lit("")), "\n")
    rows = pairs.withColumns({"a_lines_": lines(a), "b_lines_": lines(b)})
    digests = lambda c: F.transform(c, lambda line: F.xxhash64(line))
    return rows.withColumn("blocks_", _blocks(digests("a_lines_"), digests("b_lines_")))


def line_edits(pairs: DataFrame, key: str = "id", a: str = "a_text", b: str = "b_text") -> DataFrame:
    """Changed lines of file pairs: key, hunk, side (a, b), line_no, line, and per pair size_a, size_b.

    Lines of a pair without change give one row with hunk -1 and nulls, so that its sizes are known.
    """
    rows = _compared(pairs.select(key, a, b), a, b).select(key, "a_lines_", "b_lines_", F.posexplode_outer("blocks_").alias("hunk", "at"))

    def side(name: str, first: int) -> Column:
        low, n = F.col("at")[first], F.col("at")[first + 1] - F.col("at")[first]
        return F.transform(F.slice(f"{name}_lines_", low + 1, n), lambda line, i: F.struct(F.lit(name).alias("side"), (low + i + 1).cast("long").alias("line_no"), line.alias("line")))

    lines = F.when(F.col("at").isNotNull(), F.concat(side("a", 0), side("b", 2)))
    sizes = [F.size("a_lines_").cast("long").alias("size_a"), F.size("b_lines_").cast("long").alias("size_b")]
    each = rows.select(key, F.coalesce("hunk", F.lit(-1)).alias("hunk"), *sizes, F.explode_outer(lines).alias("e"))
    return each.select(key, "hunk", "e.side", "e.line_no", "e.line", "size_a", "size_b")


def line_diff(pairs: DataFrame, unsafe_label: str = "unsafe", key: str = "id") -> DataFrame:
    """Regions of the changed lines of both sides, blank and comment lines aside, tied by pair_hash, with sim_ratio.

    pairs has key, owner, project, a_version, b_version, a_path, b_path, a_text, b_text. The a side gets unsafe_label.
    """
    edits = line_edits(pairs, key)
    code = (F.trim("line") != "") & ~F.ltrim("line").startswith("//") & ~F.ltrim("line").startswith("/*")
    counted = edits.withColumn("code", F.coalesce(code, F.lit(False)))
    per = counted.groupBy(key).agg(F.count_if("code").alias("changed"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    ratio = per.select(key, (1.0 - F.col("changed") / (F.col("size_a") + F.col("size_b"))).alias("sim_ratio"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("line_no"))))
    hunks = counted.filter("code").groupBy(key, "hunk").agg(side("a").alias("dels"), side("b").alias("adds"))
    meta = pairs.drop("a_text", "b_text")
    hashed = hunks.join(meta, key).withColumn("pair_hash", pair_hash(*[F.col(c) for c in ("owner", "project", "a_path", "a_version", "dels", "b_version", "adds")]))
    lines = counted.filter("code").select(key, "hunk", "side", "line_no", F.length("line").alias("ecol"))
    rows = lines.join(hashed, [key, "hunk"]).join(ratio, key)
    on_a = F.col("side") == "a"
    return rows.select(
        "owner", "project", F.when(on_a, F.col("a_version")).otherwise(F.col("b_version")).alias("version"),
        F.when(on_a, F.col("a_path")).otherwise(F.col("b_path")).alias("fpath"), F.col("line_no").alias("sline"), F.lit(0).alias("scol"),
        F.col("line_no").alias("eline"), "ecol", F.when(on_a, unsafe_label).otherwise("safe").alias("label"), "pair_hash", "sim_ratio",
    )


def paired_snippets(pairs: DataFrame, key: str = "id", vuln: str = "a_text", fix: str = "b_text", context: int = 3) -> DataFrame:
    """key, vuln_snippet, fix_snippet: the lines of the first hunk of each side with context, null on a side that it leaves unchanged.

    A hunk goes on as long as no more than twice the context's lines are equal between two changes.
    """
    rows = _compared(pairs.select(key, vuln, fix), vuln, fix)
    start = F.struct(F.get("blocks_", 0).alias("last"), F.lit(True).alias("open"), F.lit(False).alias("a"), F.lit(False).alias("b"))

    def step(s: Column, at: Column) -> Column:
        near = s["open"] & (at[0] - s["last"][1] <= 2 * context)
        grown = F.struct(at.alias("last"), F.lit(True).alias("open"), (s["a"] | (at[1] > at[0])).alias("a"), (s["b"] | (at[3] > at[2])).alias("b"))
        return F.when(near, grown).otherwise(F.struct(s["last"].alias("last"), F.lit(False).alias("open"), s["a"].alias("a"), s["b"].alias("b")))

    found = rows.withColumn("h_", F.aggregate("blocks_", start, step))

    def snippet(name: str, first: int) -> Column:
        low = F.greatest(F.get("blocks_", 0)[first] - context, F.lit(0))
        high = F.least(F.col("h_.last")[first + 1] + context, F.size(f"{name}_lines_"))
        return F.when(F.col(f"h_.{name}"), F.array_join(F.slice(f"{name}_lines_", low + 1, high - low), "\n"))

    return found.select(key, snippet("a", 0).alias("vuln_snippet"), snippet("b", 2).alias("fix_snippet"))


def random_snippets(df: DataFrame, seed: int, key: str = "id", text: str = "text") -> DataFrame:
    """df with snippet: as many lines as the mean of size_vuln and size_fix, from a random start.

    Where a size is null it is random: up to 5 % of the file's lines for size_vuln and 25 % for size_fix. Where the file
    has no more lines than that, the start is in its first half.
    """
    lines = F.split(text, "\n")
    n = F.size(lines)
    vuln = F.coalesce(F.col("size_vuln"), F.floor(seeded_fraction(seed, key, F.lit("v")) * (F.round(n * 0.05) + 1)))
    fix = F.coalesce(F.col("size_fix"), F.floor(seeded_fraction(seed, key, F.lit("f")) * (F.round(n * 0.25) + 1)))
    size = F.bround((vuln + fix) / 2.0).cast("int")
    room = F.when(n > size, n - size).otherwise(F.round(n / 2))
    start = F.floor(seeded_fraction(seed, key, F.lit("s")) * (room + 1)).cast("int")
    return df.withColumn("snippet", F.when(F.coalesce(F.col(text), F.lit("")) != "", F.array_join(F.slice(lines, start + 1, size), "\n")))


def to_samples(df: DataFrame, fix: bool = False) -> DataFrame:
    """Up to three samples of each row: vuln (unsafe), fix (safe, if asked for) and non-vuln (safe), of those that aren't blank.

    df has vuln_code, fix_code and non_vuln_code. Safe samples lose cwe_id and score; LOC counts lines.
    """
    kinds = [("vuln_code", "vuln", "unsafe"), *([("fix_code", "fix", "safe")] if fix else []), ("non_vuln_code", "non-vuln", "safe")]
    samples = F.array(*[F.struct(F.col(c).alias("input"), F.lit(tag).alias("tag"), F.lit(label).alias("label")) for c, tag, label in kinds])
    rows = df.withColumn("s_", F.explode(F.filter(samples, lambda s: F.length(F.trim(F.coalesce(s["input"], F.lit("")))) > 0)))
    unsafe = F.col("s_.label") == "unsafe"
    rows = rows.withColumns({c: F.when(unsafe, F.col(c)) for c in ("cwe_id", "score") if c in df.columns})
    return rows.select(*[c for c in rows.columns if c not in ("s_", "vuln_code", "fix_code", "non_vuln_code")], "s_.*", line_count(F.col("s_.input")).alias("LOC"))
