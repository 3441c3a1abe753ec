"""Expressions over reference URLs, commits, paths and names: Column in, Column out, arrays sorted and distinct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOSTS = ("github", "bitbucket", "gitlab", "git")
CODE_REF = r"(github|bitbucket|gitlab|git).*(/commit/|/commits/)"


def distinct_sorted(values: Column) -> Column:
    """Set of the non-null values as a sorted array; null when it is empty or values is null."""
    out = F.sort_array(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))
    return F.get(F.filter(F.array(out), lambda a: F.size(a) > 0), 0)  # names out once, so that nesting doesn't multiply it


def _times(text: Column, part: str) -> Column:
    return F.size(F.split(text, part)) - 1


def _split_urls(refs: Column, keep: Callable[[Column], Column] | None) -> Column:
    def parts(ref: Column) -> Column:
        protocol = F.when(ref.contains("http://"), F.lit("http://")).otherwise(F.lit("https://"))
        by_protocol = F.when(ref.contains("http://"), F.split(ref, "http://")).otherwise(F.split(ref, "https://"))
        count = F.when(ref.contains("http://"), _times(ref, "http://")).otherwise(_times(ref, "https://"))
        pieces = F.when(ref.contains(","), F.split(ref, ",")).otherwise(
            F.transform(F.filter(by_protocol, lambda p: p != ""), lambda p: F.concat(protocol, p))
        )
        pieces = F.filter(pieces, keep) if keep else pieces
        return F.when(count > 1, pieces).otherwise(F.array(ref))

    return distinct_sorted(F.flatten(F.transform(refs, parts)))


def split_urls(refs: Column) -> Column:
    """References that hold several URLs become one each: cut at commas if there are any, else at the protocol."""
    return _split_urls(refs, None)


def split_github_urls(refs: Column) -> Column:
    """As split_urls, keeping of several URLs those of github.com alone; a single URL is kept as it is."""
    return _split_urls(refs, lambda p: p.contains("github.com"))


def normalize_ref(ref: Column) -> Column:
    """A reference to a commit in its plain form, or null when it names no commit."""
    return (
        F.when(ref.contains("CONFIRM:"), F.replace(ref, F.lit("CONFIRM:"), F.lit("")))
        .when(~ref.rlike(r"\b[0-9a-f]{5,40}\b"), F.lit(None).cast("string"))
        .when(ref.contains("git://") & ref.contains("github.com"), F.replace(ref, F.lit("git://"), F.lit("https://")))
        .when(ref.contains("/master?"), F.lit(None).cast("string"))
        .when(ref.contains("#comments") | ref.contains("#commitcomment"), F.substring_index(ref, "#", 1))
        .when(ref.contains(".patch"), F.replace(ref, F.lit(".patch"), F.lit("")))
        .when(ref.contains("%23"), F.replace(ref, F.lit("%23"), F.lit("#")))
        .otherwise(ref)
    )


def normalize_refs(refs: Column) -> Column:
    return distinct_sorted(F.transform(refs, normalize_ref))


def clean_github_ref(ref: Column) -> Column:
    """A GitHub commit URL without anchors and query strings, or null when it isn't one."""
    return (
        F.when(ref.contains("#diff") | ref.rlike(r"github.com.*:"), F.lit(None).cast("string"))
        .when(ref.contains("#"), F.substring_index(ref, "#", 1))
        .when(~ref.rlike("[0-9a-f]{6,40}"), F.lit(None).cast("string"))
        .when(ref.contains("?w=1"), F.replace(ref, F.lit("?w=1"), F.lit("")))
        .when(ref.contains("?branch="), F.substring_index(ref, "?branch=", 1))
        .when(ref.contains("?diff=split"), F.replace(ref, F.lit("?diff=split"), F.lit("")))
        .when(ref.rlike("(,|/)$"), F.when(ref.contains("/"), F.regexp_replace(ref, ".$", "")).otherwise(F.replace(ref, F.lit(","), F.lit(""))))
        .when(ref.contains(")"), F.replace(ref, F.lit(")"), F.lit("")))
        .otherwise(ref)
    )


def clean_github_refs(refs: Column) -> Column:
    return distinct_sorted(F.transform(refs, clean_github_ref))


def ref_source(ref: Column) -> Column:
    """github, bitbucket, gitlab, git or other, by the first of these names that the reference contains."""
    out = F.when(ref.contains(HOSTS[0]), HOSTS[0])
    for host in HOSTS[1:]:
        out = out.when(ref.contains(host), host)
    return out.otherwise("other")


def code_refs(refs: Column) -> Column:
    """References to commits on code hosts; null when there are none."""
    return distinct_sorted(F.filter(refs, lambda r: r.rlike(CODE_REF)))


def refs_of_source(refs: Column, source: str) -> Column:
    return distinct_sorted(F.filter(refs, lambda r: r.contains(source)))


def project_of_chain(chain: Column) -> Column:
    """URL of the project of the chain's last commit in sorted order, without pull-request parts."""
    last = F.element_at(F.array_sort(chain), -1)
    before = F.element_at(F.split(last, "/commit/|/commits/"), 1)
    return F.when(before.contains("pull"), F.substring_index(before, "/pull/", 1)).otherwise(before)


def explode_chain(df: DataFrame, chain: str = "chain") -> DataFrame:
    """One row for each commit of a chain: commit_href, project, commit_sha and patch (SINGLE or MULTI) are added."""
    rows = df.withColumn("patch", F.when(F.size(chain) > 1, "MULTI").otherwise("SINGLE")).withColumn("commit_href", F.explode(chain))
    href = F.col("commit_href")
    # By a generator, so that joins on the hash don't match the pattern again.
    rows = rows.withColumn("sha_", F.explode(F.array(F.regexp_replace(href, "https?://github.com/.*/commits?/", ""))))
    sha = F.col("sha_")
    return rows.withColumns({
        "project": F.array_join(F.slice(F.split(href, "/"), 1, 5), "/"),
        "commit_sha": F.when(sha.contains("http"), F.element_at(F.split(sha, "/"), -1)).otherwise(sha),
    }).drop("sha_")


def commit_url_parts(url: Column) -> Column:
    """Struct of owner, project and sha of a commit URL, also for commits of pull requests."""
    parts = F.split(F.regexp_replace(url, "//commit", "/commit"), "/")
    return F.struct(F.get(parts, 3).alias("owner"), F.get(parts, 4).alias("project"), F.element_at(parts, -1).alias("sha"))


def repo_path(project_url: Column) -> Column:
    parts = F.split(project_url, "/")
    return F.struct(F.element_at(parts, -2).alias("owner"), F.element_at(parts, -1).alias("project"))


def clean_sha(shas: Column) -> Column:
    """First of an array of commit hashes, cut at # and ?."""
    return F.substring_index(F.substring_index(F.get(shas, 0), "#", 1), "?", 1)


def file_extension(name: Column) -> Column:
    """Lower-case suffix without the dot; empty when the base name has none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def files_extensions(files: Column) -> Column:
    """Extensions of the names in a map of changed files, of those with a dot; null when there are none."""
    return distinct_sorted(F.transform(F.filter(F.map_keys(files), lambda f: f.contains(".")), file_extension))


def languages_of(extensions: Column, table: dict[str, list[str]]) -> Column:
    """Languages whose extension list holds one of extensions; null when none does."""
    by_extension: dict[str, list[str]] = {}
    for name, own in table.items():
        for e in own:
            by_extension.setdefault(e, []).append(name)
    lookup = F.create_map(*[x for e, names in by_extension.items() for x in (F.lit(e), F.array(*map(F.lit, names)))])
    found = F.transform(extensions, lambda e: F.coalesce(F.try_element_at(lookup, e), F.array().cast("array<string>")))
    return distinct_sorted(F.flatten(found))


def parse_cwe_id(text: Column) -> Column:
    """First integer in text, or null."""
    return F.regexp_extract(text, r"\d+", 0).try_cast("int")


def scanner_cwe(cwe: Column, allowed: list[int], drop_unavailable: bool = False) -> Column:
    """CWE-%03d of a number or CWE name; one that isn't allowed is null or raises an error."""
    number = F.element_at(F.split(F.upper(cwe), "CWE-"), -1).cast("int")
    missing = F.lit(None).cast("string") if drop_unavailable else F.raise_error(F.concat(F.lit("CWE-"), number.cast("string"), F.lit(" not available."))).cast("string")
    return F.when(number.isin(allowed), F.format_string("CWE-%03d", number)).when(cwe.isNotNull(), missing)


#: Names under which a scanner knows a language.
SCANNER_LANGUAGES = {"js": "javascript", "c++": "cpp", "c#": "csharp", "py": "python", "go": "go", "java": "java", "rb": "ruby", "swift": "swift"}


def scanner_language(language: Column) -> Column:
    """The scanner's own name of a language; one that it doesn't know raises an error."""
    name = F.lower(language)
    out = F.when(name.isin(*sorted(set(SCANNER_LANGUAGES.values()))), name)
    for alias, target in SCANNER_LANGUAGES.items():
        out = out.when(name == alias, target)
    unknown = F.raise_error(F.concat(F.lit("Programming language "), language, F.lit(" not available."))).cast("string")
    return out.when(language.isNotNull(), unknown)


def normalize_word(word: Column) -> Column:
    """Letters alone in lower case; a word without letters is kept, in lower case."""
    letters = F.lower(F.regexp_replace(word, "[^a-zA-Z]", ""))
    return F.when(letters == "", F.lower(word)).otherwise(letters)


def subtokens(name: Column) -> Column:
    return F.split(name, r"\|")


def split_next(text: Column) -> Column:
    return F.split(text, r"<_\*\*next\*\*_>")


def legal_name(name: Column, unknown: str = "<OOV>") -> Column:
    return (name != unknown) & name.rlike(r"^[a-zA-Z|]+$")


def first_match_word(name: Column, words: Column, unknown: str = "<OOV>") -> Column:
    """Struct of the place among the legal words (from 0) and the word that equals name after normalisation, or null."""
    legal = F.filter(words, lambda w: legal_name(w, unknown))
    hits = F.filter(F.transform(legal, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda s: normalize_word(s["word"]) == normalize_word(name))
    return F.get(hits, 0)
