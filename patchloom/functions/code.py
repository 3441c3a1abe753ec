"""Expressions over source code, patches, regions and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRINGS = r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')"""
_C_STYLE = _STRINGS + r"|//[^\n]*|/\*[\s\S]*?\*/"
_PYTHON_STYLE = _STRINGS + r"|#[^\n]*"
#: Extensions by comment style.
C_STYLE = ("js", "cpp", "cc", "hpp", "hh", "c++", "cxx", "java", "c", "h")
PYTHON_STYLE = ("py",)


def strip_comments(code: Column, extension: Column) -> Column:
    """Code without comments, by extension; string literals keep theirs, and unknown extensions change nothing."""
    ext = F.lower(extension)
    return (
        F.when(ext.isin(*C_STYLE), F.regexp_replace(code, _C_STYLE, "$1"))
        .when(ext.isin(*PYTHON_STYLE), F.regexp_replace(code, _PYTHON_STYLE, "$1"))
        .otherwise(code)
    )


def strip_markup_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def code_tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(r"[A-Za-z_]\w*|\d+|\S"), F.lit(0))


def line_count(code: Column) -> Column:
    """Lines of a snippet; a line feed at its end begins none, and no text has no lines."""
    body = F.regexp_replace(code, r"\n$", "")
    return F.when(code == "", 0).otherwise(F.size(F.split(body, "\n")))


def context_count(contexts: Column) -> Column:
    return F.when(F.trim(contexts) == "", 0).otherwise(F.size(F.split(F.trim(contexts), " ")))


def function_hash(*, pair_hash: Column, key: list[Column]) -> Column:
    """The pair's hash, or the md5 of the function's place where there is none."""
    return F.coalesce(F.nullif(pair_hash, F.lit("")), F.md5(F.concat_ws("_", *[k.cast("string") for k in key])))


def pair_hash(owner: Column, project: Column, a_path: Column, a_version: Column, deleted: Column, b_version: Column, added: Column) -> Column:
    """sha1 that ties the regions of both sides of one hunk; deleted and added are arrays of line numbers."""
    lines = lambda x: F.array_join(x.cast("array<string>"), "_")
    return F.sha1(F.array_join(F.array(owner, project, a_path, a_version, lines(deleted), b_version, lines(added)), "_"))


def split_repo_path(path: Column, root: str = "") -> Column:
    """Struct of owner, project, version and fpath after a root prefix."""
    parts = F.split(F.regexp_replace(path, f"^{root}/", "") if root else path, "/")
    rest = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/")
    return F.struct(F.get(parts, 0).alias("owner"), F.get(parts, 1).alias("project"), F.get(parts, 2).alias("version"), rest.alias("fpath"))


def join_repo_path(root: Column, owner: Column, project: Column, version: Column, fpath: Column) -> Column:
    return F.concat_ws("/", root, owner, project, version, fpath)


def slice_function(text: Column, sline: Column, scol: Column, eline: Column, ecol: Column) -> Column:
    """Lines sline to eline (from 1), the first cut from scol and the last to ecol (from 0); one line is cut both ways."""
    lines = F.slice(F.split(text, "\n"), sline, F.greatest(eline - sline + 1, F.lit(0)))
    n, first, last = F.size(lines), F.get(lines, 0), F.element_at(lines, -1)
    more = F.concat(F.array(first.substr(scol + 1, F.length(first))), F.slice(lines, 2, F.greatest(n - 2, F.lit(0))), F.array(last.substr(F.lit(1), ecol)))
    return F.when(n == 0, "").when(n == 1, first.substr(scol + 1, ecol - scol)).otherwise(F.array_join(more, "\n"))


def label_to_int(label: Column, labels: dict[str, int] | None = None) -> Column:
    """safe 0, unsafe 1; another label raises an error."""
    out = F.lit(None).cast("int")
    for name, value in (labels or {"safe": 0, "unsafe": 1}).items():
        out = F.when(label == name, value).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("null")))).cast("int"))


def hunk_headers(patch: Column) -> Column:
    """Array of structs old_start, new_start of the @@ headers of a patch."""
    headers = F.regexp_extract_all(patch, F.lit("@@ .* @@"), F.lit(0))
    start = lambda h, part, sign: F.replace(F.substring_index(F.get(F.split(h, " "), part), ",", 1), F.lit(sign), F.lit("")).cast("int")
    return F.transform(headers, lambda h: F.struct(start(h, 1, "-").alias("old_start"), start(h, 2, "+").alias("new_start")))


def replace_sha_in_url(raw_url: Column, sha: Column, vulnerable_sha: Column) -> Column:
    return F.replace(raw_url, sha, vulnerable_sha)


def hunk_lines(patch: Column) -> Column:
    """Struct of deleted (line numbers of the old side) and added (of the new side), over all hunks of a patch.

    A line that starts with neither sign counts on both sides; the rest of a header's line belongs to no side.
    """
    rest = lambda parts: F.slice(parts, 2, (1 << 31) - 2)
    bodies = F.transform(rest(F.split(patch, "@@ .* @@")), lambda b: rest(F.split(b, "\n")))
    zipped = F.arrays_zip(hunk_headers(patch).alias("h"), bodies.alias("lines"))

    def side(hunks: Column, own: str, other: str, start: str) -> Column:
        def one(hunk: Column) -> Column:
            # Lines of the other side take no number, so a line's number is its place among the rest.
            mine = F.filter(hunk["lines"], lambda line: ~line.startswith(other))
            placed = F.transform(mine, lambda line, i: F.struct(line.startswith(own).alias("own"), (hunk["h"][start] + i).alias("at")))
            return F.transform(F.filter(placed, lambda x: x["own"]), lambda x: x["at"])

        return F.flatten(F.transform(hunks, one))

    # An array of one, so that both sides take the hunks from one cut.
    both = F.transform(F.array(zipped), lambda hunks: F.struct(side(hunks, "-", "+", "old_start").alias("deleted"), side(hunks, "+", "-", "new_start").alias("added")))
    return F.when(patch.isNotNull(), F.get(both, 0))


def change_status(status: Column, patch: Column) -> Column:
    """The status of a changed file; where it is missing, removed if the patch adds no line, else null."""
    return F.coalesce(status, F.when(~patch.contains("\n+"), F.lit("removed")))


def contained(outer: list[Column], inner: list[Column]) -> Column:
    """Whether the region outer (sline, scol, eline, ecol) holds inner."""
    place = lambda line, col: F.struct(line.alias("l"), col.alias("c"))
    return (place(outer[0], outer[1]) <= place(inner[0], inner[1])) & (place(inner[2], inner[3]) <= place(outer[2], outer[3]))


def region_is_null(region: list[Column]) -> Column:
    out = F.lit(True)
    for part in region:
        out = out & (F.coalesce(part, F.lit(0)) == 0)
    return out


def same_region(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def inbounds(region: list[Column], other: list[Column]) -> Column:
    """Whether the lines of other lie within those of region."""
    return (region[0] <= other[0]) & (other[2] <= region[2])


def hybrid_label(inner: bool = False) -> Column:
    """Struct of label, cwe, sfp joined from the columns diff_label, diff_cwe, diff_sfp, sa_label, sa_cwe, sa_sfp.

    Unsafe on one side alone is unsafe, or safe for an inner join, with that side's classes. Unsafe on both sides takes
    "a|b" for cwe where these differ, else for sfp where those do; a null one gives way to the other's.
    """
    diff, sa = F.col("diff_label"), F.col("sa_label")
    both = (diff == "unsafe") & (sa == "unsafe")
    by_sa = (sa == "unsafe") & (diff == "safe")
    by_one = by_sa | (diff == "unsafe") & (sa == "safe")

    def joined(name: str) -> Column:
        a, b = F.col(f"diff_{name}"), F.col(f"sa_{name}")
        return F.when(a.eqNullSafe(b), a).otherwise(F.nullif(F.concat_ws("|", a, b), F.lit("")))

    same_cwe = F.col("diff_cwe").eqNullSafe(F.col("sa_cwe"))
    cwe = F.when(both, joined("cwe")).when(by_sa, F.col("sa_cwe")).otherwise(F.col("diff_cwe"))
    sfp = F.when(both & same_cwe, joined("sfp")).when(by_sa, F.col("sa_sfp")).otherwise(F.col("diff_sfp"))
    label = F.when(by_one, "safe" if inner else "unsafe").otherwise(diff)
    return F.struct(label.alias("label"), cwe.alias("cwe"), sfp.alias("sfp"))
