"""Queries on references, commits, lookups and cleaning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions import advisories as A
from patchloom.functions import refs as R
from patchloom.operators import aggregates, filters, joins, rows
from patchloom.plans.inputs import given
from patchloom.plans.registry import query
from patchloom.sources import files, lookups, schemas

_NORMAL = """CASE WHEN contains(url, 'CONFIRM:') THEN replace(url, 'CONFIRM:', '')
 WHEN NOT regexp_matches(url, '\\b[0-9a-f]{5,40}\\b') THEN NULL
 WHEN contains(url, 'git://') AND contains(url, 'github.com') THEN replace(url, 'git://', 'https://')
 WHEN contains(url, '/master?') THEN NULL
 WHEN contains(url, '#comments') OR contains(url, '#commitcomment') THEN split_part(url, '#', 1)
 WHEN contains(url, '.patch') THEN replace(url, '.patch', '') WHEN contains(url, '%23') THEN replace(url, '%23', '#') ELSE url END"""
_CLEAN = """CASE WHEN contains(url, '#diff') OR regexp_matches(url, 'github.com.*:') THEN NULL
 WHEN contains(url, '#') THEN split_part(url, '#', 1) WHEN NOT regexp_matches(url, '[0-9a-f]{6,40}') THEN NULL
 WHEN contains(url, '?w=1') THEN replace(url, '?w=1', '') WHEN contains(url, '?branch=') THEN split_part(url, '?branch=', 1)
 WHEN contains(url, '?diff=split') THEN replace(url, '?diff=split', '')
 WHEN regexp_matches(url, '(,|/)$') THEN left(url, length(url) - 1) WHEN contains(url, ')') THEN replace(url, ')', '') ELSE url END"""
_SOURCE = "CASE WHEN contains(url, 'github') THEN 'github' WHEN contains(url, 'bitbucket') THEN 'bitbucket' WHEN contains(url, 'gitlab') THEN 'gitlab' WHEN contains(url, 'git') THEN 'git' ELSE 'other' END"
_CODE = "regexp_matches(url, '(github|bitbucket|gitlab|git).*(/commit/|/commits/)')"


@query(f"SELECT id, url, {_NORMAL} AS normalized, {_CLEAN} AS cleaned, {_SOURCE} AS source FROM refs_in", ("refs",))
def ref_normalize(spark: SparkSession, d: str) -> DataFrame:
    """T03, T04, T05."""
    url = F.col("url")
    first = lambda x: F.get(x, 0)
    return given(spark, d, "refs").select("id", "url", first(R.normalize_refs(F.array(url))).alias("normalized"), first(R.clean_github_refs(F.array(url))).alias("cleaned"), R.ref_source(url).alias("source"))


@query(
    """WITH p AS (SELECT id, url || CASE WHEN id % 3 = 0 THEN ',' || url || '/b' WHEN id % 3 = 1 THEN url || '/c' ELSE '' END AS ref FROM refs_in),
c AS (SELECT id, ref, CASE WHEN id % 3 = 0 THEN string_split(ref, ',') WHEN id % 3 = 1 THEN list_transform(list_filter(string_split(ref, 'https://'), lambda x: x <> ''), lambda x: 'https://' || x) ELSE [ref] END AS parts FROM p)
SELECT id, array_to_string(list_sort(list_distinct(parts)), ' ') AS urls,
 array_to_string(list_sort(list_distinct(CASE WHEN id % 3 = 2 THEN parts ELSE list_filter(parts, lambda x: contains(x, 'github.com')) END)), ' ') AS github_urls FROM c""",
    ("refs",),
)
def ref_split(spark: SparkSession, d: str) -> DataFrame:
    """T01, T02."""
    more = F.when(F.col("id") % 3 == 0, F.concat(F.lit(","), "url", F.lit("/b"))).when(F.col("id") % 3 == 1, F.concat("url", F.lit("/c"))).otherwise("")
    refs = given(spark, d, "refs").select("id", F.array(F.concat("url", more)).alias("refs"))
    return refs.select("id", F.array_join(R.split_urls(F.col("refs")), " ").alias("urls"), F.coalesce(F.array_join(R.split_github_urls(F.col("refs")), " "), F.lit("")).alias("github_urls"))


_GROUPED = "g AS (SELECT owner_id, list(url) AS refs FROM refs_in GROUP BY owner_id)"


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, "refs").groupBy("owner_id").agg(F.collect_list("url").alias("refs"))


@query(f"WITH k AS (SELECT owner_id, list_sort(list_distinct(list(url) FILTER ({_CODE}))) AS code, list_sort(list_distinct(list(url) FILTER ({_CODE} AND contains(url, 'github')))) AS commits FROM refs_in GROUP BY owner_id) SELECT owner_id, array_to_string(code, ' ') AS code_refs, array_to_string(commits, ' ') AS commits FROM k WHERE len(commits) > 0", ("refs",))
def ref_filter_source(spark: SparkSession, d: str) -> DataFrame:
    """F01, F02, F03."""
    rows_ = filters.filter_by_source(filters.filter_code_refs(filters.with_refs(_grouped(spark, d))), "github")
    return rows_.select("owner_id", F.array_join("code_refs", " ").alias("code_refs"), F.array_join("commits", " ").alias("commits"))


@query(f"SELECT source, n, round(100.0 * n / sum(n) OVER (), 4)::DOUBLE AS percent FROM (SELECT {_SOURCE} AS source, count(*) AS n FROM refs_in GROUP BY 1)", ("refs",))
def ref_share(spark: SparkSession, d: str) -> DataFrame:
    """A02."""
    return aggregates.ref_source_share(_grouped(spark, d))


@query(f"WITH {_GROUPED} SELECT len(refs)::INT AS commits, count(*) AS n FROM g GROUP BY 1", ("refs",))
def commits_per_advisory(spark: SparkSession, d: str) -> DataFrame:
    """A02."""
    return aggregates.commits_per_advisory(_grouped(spark, d), "refs")


@query(f"""WITH g AS (SELECT owner_id, url, count(*) OVER (PARTITION BY owner_id) AS n, max(url) OVER (PARTITION BY owner_id) AS last FROM refs_in)
SELECT owner_id, url AS commit_href, array_to_string(string_split(url, '/')[1:5], '/') AS project,
 CASE WHEN contains(s, 'http') THEN string_split(s, '/')[-1] ELSE s END AS commit_sha, CASE WHEN n > 1 THEN 'MULTI' ELSE 'SINGLE' END AS patch,
 string_split_regex(last, '/commit/|/commits/')[1] AS last_project, string_split(url, '/')[4] AS owner, string_split(url, '/')[-1] AS sha
FROM (SELECT *, regexp_replace(url, 'https?://github.com/.*/commits?/', '') AS s FROM g)""", ("refs",))
def commit_explode(spark: SparkSession, d: str) -> DataFrame:
    """T06, T07, T08."""
    chains = _grouped(spark, d).withColumn("last_project", R.project_of_chain(F.col("refs"))).withColumnRenamed("refs", "chain")
    parts = R.commit_url_parts(F.col("commit_href"))
    return R.explode_chain(chains).select("owner_id", "commit_href", "project", "commit_sha", "patch", "last_project", parts["owner"].alias("owner"), parts["sha"].alias("sha"))


@query("SELECT id, split_part(split_part(url, '#', 1), '?', 1) AS sha, regexp_extract(url, '[^/]\\.([^./]+)$', 1) AS extension, TRY_CAST(regexp_extract(url, '\\d+', 0) AS INT) AS number, string_split(url, '/')[-2] AS owner FROM refs_in", ("refs",))
def sha_and_names(spark: SparkSession, d: str) -> DataFrame:
    """T09, T10, T12, T08."""
    u = F.col("url")
    return given(spark, d, "refs").select("id", R.clean_sha(F.array(u)).alias("sha"), R.file_extension(u).alias("extension"), R.parse_cwe_id(u).alias("number"), R.repo_path(u)["owner"].alias("owner"))


@query("""WITH c AS (SELECT DISTINCT chain_id, commit_sha AS sha, author_date, parent FROM commits_in), w AS (SELECT *, row_number() OVER o AS p,
 last_value(sha) OVER f AS last_fix_commit, last_value(parent) OVER f AS parents FROM c WINDOW o AS (PARTITION BY chain_id ORDER BY author_date, sha), f AS (PARTITION BY chain_id ORDER BY author_date, sha ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT chain_id, sha, p::INT AS chain_ord_pos, last_fix_commit, parents FROM w WHERE chain_id % 7 > 0""", ("commits",))
def chain_order(spark: SparkSession, d: str) -> DataFrame:
    """W01."""
    c = given(spark, d, "commits")
    known = c.filter("chain_id % 7 > 0").select(F.col("commit_sha").alias("sha"), "author_date", F.col("parent").alias("parents"))
    out = rows.order_chain(c.select("chain_id", F.col("commit_sha").alias("sha")), known)
    return out.select("chain_id", "sha", "chain_ord_pos", "last_fix_commit", F.col("before_first_fix_commit").alias("parents"))


@query("""WITH s AS (SELECT id, 'r' || CAST(id % 40 AS VARCHAR) AS repo, left(sha, 4 + (id % 37)::INT) AS short, sha FROM refs_in),
j AS (SELECT a.id, a.repo, min(b.sha) AS sha FROM s a JOIN s b ON a.repo = b.repo AND starts_with(b.sha, a.short) GROUP BY a.id, a.repo) SELECT * FROM j""", ("refs",))
def short_sha(spark: SparkSession, d: str) -> DataFrame:
    """J11."""
    s = given(spark, d, "refs").select("id", F.concat(F.lit("r"), (F.col("id") % 40).cast("string")).alias("repo"), "sha")
    short = s.withColumn("sha", F.expr("left(sha, 4 + cast(id % 37 as int))"))
    return joins.expand_short_sha(short, s.drop("id")).select("id", "repo", "sha")


def _doubled(select: str) -> str:
    """select with the braces of JSON text doubled, so that those of table names alone are filled in."""
    return re.sub(r"\{\{(\w+)\}\}", r"{\1}", select.replace("{", "{{").replace("}", "}}"))


_OSV_JSON = """SELECT o_orderkey, o_custkey, concat('{"id": "V-', CAST(o_orderkey AS STRING), '", "aliases": ["b", "a", "b"], "summary": "s ', o_orderpriority, '", "details": "d", "modified": "2020-01-02T03:04:05Z", "published": "2020-01-01T00:00:00Z", "references": [{"url": "https://github.com/x/y"}, {"url": "https://a"}], "database_specific": {',
 CASE WHEN o_orderkey % 2 = 0 THEN '"severity": "HIGH", "cwe_ids": ["CWE-2", "CWE-1"]' ELSE '"severity": null' END,
 '}, "affected": [{"ranges": [{"type": "GIT", "repo": "https://github.com/x/y.git", "events": [{"introduced": "', CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE 'i1' END, '"}, {"fixed": "f', CAST(o_orderkey AS STRING), '"}]}, {"type": "SEMVER", "repo": "z", "events": [{"fixed": "no"}]}], "ecosystem_specific": {"severity": "LOW"}, "database_specific": {"cwes": [{"cweId": "CWE-79"}], "cvss": ',
 CASE WHEN o_orderkey % 4 = 0 THEN '"CVSS:3.1/AV:N"' ELSE '{"score": 7.5}' END, '}}]}') AS js FROM {orders}"""


@query("""SELECT 'npm' AS ecosystem, 'V-' || o_orderkey AS vuln_id, 'a b' AS aliases, CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity,
 CASE WHEN o_orderkey % 4 > 0 THEN 7.5::DOUBLE END AS score, CASE WHEN o_orderkey % 2 = 0 THEN 'CWE-1 CWE-2' ELSE 'CWE-79' END AS cwe_id,
 array_to_string(list_sort(['https://github.com/x/y', 'https://a', 'https://github.com/x/y/commit/f' || o_orderkey]), ' ') AS refs,
 CASE WHEN o_orderkey % 3 > 0 THEN 'https://github.com/x/y/commit/i1' END AS introduced, 's ' || o_orderpriority || ' d' AS text, '2020-01-01' AS day FROM orders""")
def nested_accessors(spark: SparkSession, d: str) -> DataFrame:
    """S01, P01 to P06, P10, P11."""
    raw = given(spark, d, _doubled(_OSV_JSON)).select(F.from_json("js", schemas.OSV).alias("r")).select("r.*", F.lit("npm").alias("ecosystem"))
    osv = files.osv_columns(raw)
    joined = {c: F.array_join(c, " ") for c in ("aliases", "cwe_id", "refs", "introduced")}
    return osv.withColumns(joined).select("ecosystem", "vuln_id", "aliases", "severity", "score", "cwe_id", "refs", "introduced",
                                          A.join_text(F.col("summary"), F.col("details")).alias("text"), A.published_day(F.col("published_date")).alias("day"))


_NVD_JSON = """SELECT o_custkey AS k, concat('{"cve": {"CVE_data_meta": {"ID": "CVE-', CAST(o_orderkey AS STRING), '"}, "problemtype": {"problemtype_data": [{"description": [{"value": "CWE-', CAST(o_orderkey % 100 AS STRING), '"}]}]}, "description": {"description_data": [{"value": "', o_orderpriority, '"}]}, "references": {"reference_data": [{"url": "u2"}, {"url": "u1"}]}}, "impact": {',
 CASE WHEN o_orderkey % 3 > 0 THEN '"baseMetricV2": {"severity": "LOW", "exploitabilityScore": 2.5, "impactScore": 6.4}' ELSE '' END, '}, "publishedDate": "2020-05-06T01:02Z", "lastModifiedDate": "2021"}') AS js FROM {orders}"""


@query("""SELECT 'CVE-' || o_orderkey AS cve_id, 'CWE-' || (o_orderkey % 100) AS cwes, o_orderpriority AS description, CASE WHEN o_orderkey % 3 > 0 THEN 'LOW' END AS severity,
 CASE WHEN o_orderkey % 3 > 0 THEN 2.5::DOUBLE END AS exploitability, CASE WHEN o_orderkey % 3 > 0 THEN 6.4::DOUBLE END AS impact, '2020-05-06T01:02Z' AS published_date, '2021' AS last_modified_date, 'u1 u2' AS refs FROM orders""")
def nvd_accessors(spark: SparkSession, d: str) -> DataFrame:
    """The feed's items as rows."""
    raw = given(spark, d, _doubled(_NVD_JSON)).select(F.from_json("js", schemas.NVD_ITEM).alias("item"))
    return raw.select(*A.nvd_columns(F.col("item"))).withColumns({c: F.array_join(c, " ") for c in ("cwes", "refs")})


@query("SELECT 'G' || event_id AS vuln_id, 'A' || (event_id % 7) AS aliases, 'CWE-' || (event_id % 50) AS cwe_id, (event_id % 10)::DOUBLE AS score, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def ghsa_accessors(spark: SparkSession, d: str) -> DataFrame:
    """S02, P07 and JSON text."""
    e = given(spark, d, "SELECT * FROM {events}")
    own = F.concat(F.lit("G"), F.col("event_id").cast("string"))
    nodes = F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), (F.col("event_id") % 50).cast("string")).alias("cweId"))).alias("nodes"))
    ids = F.array(F.struct(own.alias("value")), F.struct(F.concat(F.lit("A"), (F.col("event_id") % 7).cast("string")).alias("value")))
    r = e.select(own.alias("ghsaId"), ids.alias("identifiers"), nodes.alias("cwes"), (F.col("event_id") % 10).cast("double").alias("score"), "props")
    return r.select(F.col("ghsaId").alias("vuln_id"), F.array_join(A.ghsa_aliases(F.col("identifiers"), F.col("ghsaId")), " ").alias("aliases"), F.array_join(A.ghsa_cwes(F.col("cwes")), " ").alias("cwe_id"), "score", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT vuln_id, score, summary, published_date, dataset, chain FROM (
 SELECT 'O' || o_orderkey AS vuln_id, 1.5::DOUBLE AS score, o_orderpriority || ' x' AS summary, '2020-01-01' AS published_date, 'OSV' AS dataset, 'c' AS chain FROM orders
 UNION ALL SELECT 'N' || o_orderkey, 2.5::DOUBLE, o_orderstatus, '2021-02-03', 'NVD', 'c' FROM orders)""")
def unified_advisories(spark: SparkSession, d: str) -> DataFrame:
    """P09, U01."""
    osv = given(spark, d, "SELECT 'O' || o_orderkey AS vuln_id, array('CWE-1') AS cwe_id, 1.5D AS score, array('c') AS commits, o_orderpriority AS summary, 'x' AS details, '2020-01-01T00' AS published_date FROM {orders}")
    nvd = given(spark, d, "SELECT 'N' || o_orderkey AS cve_id, array('CWE-1') AS cwes, 2.5D AS impact, array('c') AS commits, o_orderstatus AS description, '2021-02-03T00' AS published_date FROM {orders}")
    return A.unify_advisories(osv, nvd).select("vuln_id", "score", "summary", "published_date", "dataset", F.array_join("chain", " ").alias("chain"))


_CLASSES = "(0, 'c1', 'DCL', 'Declare', 1), (1, 'c1', 'DCL', 'Define', 2), (2, 'c1', 'DVR', 'Verify', 2), (3, 'c2', 'MAD', 'Address', 7), (4, 'c2', 'MAD', 'Read', 79)"
_CLUSTERS = "('primary', 886, 'Unused', NULL, NULL, 3), ('secondary', 998, 'Glitch', 885, 'Risky', 2), ('secondary', 960, 'Ambiguous', 889, 'Exceptions', 7), ('none', 900, 'Other', NULL, NULL, 5)"
_TYPES = "('O1', 'P2', 'server'), ('o2', 'p3', 'utility'), ('o3', 'p3', 'browser')"
_ABSTRACT = "('CWE-1', 'list', 'Base'), ('CWE-1', 'deprecated', 'x'), ('CWE-2', 'deprecated', 'Class'), ('CWE-3', 'software_development', 'v'), ('CWE-4', 'seven_kingdoms', 'v')"


def _lookup(spark: SparkSession, values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


_CWES = "SELECT p_partkey AS id, 'CWE-' || CAST(p_size % 10 AS STRING) AS cwe_id, 'o' || CAST(p_partkey % 5 AS STRING) AS owner, ' P' || CAST(p_size % 5 AS STRING) || ' ' AS project FROM {part}"


@query(f"""WITH c(ord, category, bf_class, operation, cwe) AS (VALUES {_CLASSES}), f AS (SELECT cwe, arg_min(bf_class, ord) AS bf_class, arg_min(operation, ord) AS operation FROM c GROUP BY cwe),
k(level, cluster, title, parent_cluster, parent_title, cwe) AS (VALUES {_CLUSTERS}), s AS (SELECT cwe, CASE level WHEN 'primary' THEN 'CWE-' || cluster || ': ' || title ELSE 'CWE-' || parent_cluster || ': ' || parent_title END AS sfp FROM k WHERE level <> 'none'),
t(owner, project, sw_type) AS (VALUES {_TYPES}), a(cwe_id, kind, abstraction) AS (VALUES {_ABSTRACT}),
b AS (SELECT cwe_id, CASE WHEN cwe_id = 'CWE-1' THEN 'Base' WHEN cwe_id = 'CWE-2' THEN 'Deprecated Class' WHEN cwe_id = 'CWE-3' THEN 'Software Development View Category' ELSE '7 Pernicious Kingdoms View Category' END AS abstraction FROM a GROUP BY cwe_id),
p AS (SELECT p_partkey AS id, 'CWE-' || (p_size % 10) AS cwe_id, p_size % 10 AS n, 'o' || (p_partkey % 5) AS owner, 'p' || (p_size % 5) AS project FROM part)
SELECT p.id, p.cwe_id, bf_class, operation, sfp, coalesce(sw_type, 'unk') AS sw_type, abstraction, CASE WHEN n IN (1, 2) THEN 'CWE-19: Data' END AS sw_category
FROM p LEFT JOIN f ON f.cwe = n LEFT JOIN s ON s.cwe = n LEFT JOIN t ON lower(t.owner) = p.owner AND lower(t.project) = p.project LEFT JOIN b ON b.cwe_id = p.cwe_id""")
def class_lookup(spark: SparkSession, d: str) -> DataFrame:
    """J07, J08, J09, J10, T12."""
    p = given(spark, d, _CWES)
    out = joins.bug_class(p, _lookup(spark, _CLASSES, "ord, category, bf_class, operation, cwe"))
    out = joins.fault_cluster(out, _lookup(spark, _CLUSTERS, "level, cluster, title, parent_cluster, parent_title, cwe"))
    out = joins.software_type(out, _lookup(spark, _TYPES, "owner, project, sw_type"))
    out = joins.cwe_abstraction(out, _lookup(spark, _ABSTRACT, "cwe_id, kind, abstraction"))
    out = joins.software_category(out, _lookup(spark, "(19, 'Data', 1), (19, 'Data', 2)", "category, title, cwe"))
    return out.select("id", "cwe_id", "bf_class", "operation", "sfp", "sw_type", "abstraction", "sw_category")


@query("""WITH p AS (SELECT p_size % 10 AS k FROM part) SELECT CASE k WHEN 1 THEN 'Base' WHEN 2 THEN 'Deprecated Class' ELSE '7 Pernicious Kingdoms View Category' END AS abstraction, count(*) AS n FROM p WHERE k IN (1, 2, 4) GROUP BY 1""")
def abstraction_totals(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    counts = given(spark, d, _CWES).groupBy("cwe_id").agg(F.count("*").alias("n"))
    wanted = ["Base", "Deprecated Class", "7 Pernicious Kingdoms View Category"]
    return joins.abstraction_totals(counts, _lookup(spark, _ABSTRACT, "cwe_id, kind, abstraction"), wanted)


_LANG_ROWS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN 'B' || CAST(o_orderkey % 3 AS STRING) END AS bf_class, 'CWE-' || CAST(o_orderkey % 30 AS STRING) AS cwe_id, CASE o_orderkey % 6 WHEN 0 THEN 'a.js,b.py' WHEN 1 THEN 'x.c' WHEN 2 THEN 'x.java' WHEN 3 THEN 'q.js' WHEN 4 THEN 'm.go,n.rb' ELSE 'README' END AS names FROM {orders}"
_LANG = "CASE o_orderkey % 6 WHEN 0 THEN ['JavaScript', 'Python'] WHEN 1 THEN ['C/C++'] WHEN 2 THEN ['Java'] WHEN 3 THEN ['JavaScript'] WHEN 4 THEN ['Go', 'Ruby'] END"


def _languages(spark: SparkSession, d: str) -> DataFrame:
    r = given(spark, d, _LANG_ROWS)
    named = F.map_from_arrays(F.split("names", ","), F.transform(F.split("names", ","), lambda n: F.lit(1)))
    r = r.withColumn("files_extension", R.files_extensions(named))
    return r.withColumn("language", R.languages_of(F.col("files_extension"), lookups.LANGUAGE_EXTENSIONS))


@query(f"SELECT o_orderkey AS id, array_to_string({_LANG}, ',') AS language FROM orders WHERE o_orderkey % 6 IN (0, 1, 3)")
def language_filter(spark: SparkSession, d: str) -> DataFrame:
    """T10, T11, F07, U02."""
    rows_, _ = filters.by_language(_languages(spark, d), ["JavaScript", "C/C++", "Klingon"], lookups.LANGUAGE_EXTENSIONS)
    return rows_.select("id", F.array_join("language", ",").alias("language"))


@query(f"""WITH r AS (SELECT 'B' || (o_orderkey % 3) AS bf_class, {_LANG} AS l FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 6 < 5),
t AS (SELECT l FROM r GROUP BY l ORDER BY count(*) DESC, array_to_string(l, ',') LIMIT 5) SELECT bf_class, language, count(*) AS n FROM (SELECT bf_class, unnest(l) AS language FROM r WHERE l IN (SELECT l FROM t)) GROUP BY 1, 2""")
def language_flow(spark: SparkSession, d: str) -> DataFrame:
    """A05."""
    return aggregates.class_language_flow(_languages(spark, d))


@query("SELECT 'CWE-' || (o_orderkey % 30) AS cwe_id, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1 ORDER BY n DESC, cwe_id LIMIT 10")
def top_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """A06, A01."""
    return aggregates.top_unmapped_cwe(_languages(spark, d))


@query("""SELECT id, commit_sha, parent AS before_first_fix_commit FROM commits_in WHERE cwe IS NOT NULL AND last_fix_commit IS NOT NULL AND parent IS NOT NULL
 AND NOT contains(lower(coalesce(message, '')), 'merge message') AND cwe <> 'CWE-7' AND NOT regexp_matches(commit_href, 'o1/|o2/p3')""", ("commits",))
def patch_filter(spark: SparkSession, d: str) -> DataFrame:
    """F04, F05, F06."""
    c = given(spark, d, "commits").withColumns({"cwe_id": F.when(F.col("cwe").isNotNull(), F.array(F.when(F.col("cwe") == "CWE-7", "Unknown").otherwise(F.col("cwe")))), "before_first_fix_commit": F.when(F.col("parent").isNotNull(), F.array("parent"))})
    kept = filters.drop_projects(filters.drop_unknown_cwe(filters.drop_multi_cwe(filters.patch_filter(c))), ["o1/", "o2/p3"])
    return filters.drop_projects(kept, None).select("id", "commit_sha", "before_first_fix_commit")


@query("""SELECT id, file_path, status FROM commits_in WHERE NOT contains(file_path, 'tests/') AND NOT contains(file_path, 'test/') AND NOT contains(lower(string_split(file_path, '/')[-1]), 'test')
 AND lower(string_split(file_path, '.')[-1]) IN ('js', 'py', 'gz') AND (status IS NULL OR status NOT IN ('renamed', 'removed')) AND (a_file_size + b_file_size) / 2 < 600""", ("commits",))
def source_files(spark: SparkSession, d: str) -> DataFrame:
    """F08, F09, F10."""
    c = filters.max_pair_size(given(spark, d, "commits"), 600)
    return filters.drop_renamed_removed(c.filter(filters.is_source_file(F.col("file_path"), ["js", "py", "gz"]))).select("id", "file_path", "status")


@query("""SELECT id, file_path FROM commits_in WHERE status = 'modified' AND NOT contains(lower(file_path), 'test') AND regexp_extract(file_path, '[^/]\\.([^./]+)$', 1) IN ('js', 'gz') AND file_path NOT IN (SELECT file_path FROM commits_in WHERE id = 6)""", ("commits",))
def negative_candidates(spark: SparkSession, d: str) -> DataFrame:
    """F16."""
    c = given(spark, d, "commits")
    return filters.negative_candidates(c, c.filter("id = 6"), ["js", "gz"]).select("id", "file_path")


@query("SELECT id, round(0.5 + (id % 50) / 100.0, 3)::DOUBLE AS sim_ratio FROM commits_in WHERE 0.5 + (id % 50) / 100.0 >= 0.8 AND commit_sha IN (SELECT commit_sha FROM commits_in WHERE id % 2 = 0 UNION ALL SELECT last_fix_commit FROM commits_in WHERE id % 3 = 0)", ("commits",))
def similarity_and_versions(spark: SparkSession, d: str) -> DataFrame:
    """F11, F12."""
    c = given(spark, d, "commits").withColumn("sim_ratio", F.lit(0.5) + (F.col("id") % 50) / F.lit(100.0)).withColumn("version", F.col("commit_sha"))
    pairs = c.select(F.when(F.col("id") % 2 == 0, F.col("commit_sha")).alias("a_version"), F.when(F.col("id") % 3 == 0, F.col("last_fix_commit")).alias("b_version"))
    return filters.scanned_versions(filters.similarity_filter(c), pairs).select("id", "sim_ratio")


def _targets(column: str, value: str) -> str:
    return f"(label = 'unsafe' AND {column} IS DISTINCT FROM {value})"


@query(f"""WITH x AS (SELECT * FROM attributes_in WHERE NOT {_targets('bf_class', "'click'")} AND NOT (label = 'safe' AND vuln_commit_hash IN (SELECT vuln_commit_hash FROM attributes_in WHERE {_targets('bf_class', "'click'")}))),
y AS (SELECT * FROM x WHERE NOT {_targets('cwe_id', '2')} AND NOT (label = 'safe' AND vuln_commit_hash IN (SELECT vuln_commit_hash FROM x WHERE {_targets('cwe_id', '2')})))
SELECT id, label, bf_class, cwe_id, project, sw_type FROM y WHERE project = 'p1' AND sw_type = 'server'""", ("attributes",))
def attribute_filters(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    return filters.attribute_filters(given(spark, d, "attributes"), "click", 2, "p1", "server").select("id", "label", "bf_class", "cwe_id", "project", "sw_type")


@query("SELECT project, max(last) AS status FROM (SELECT o_custkey % 90 AS project, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1) GROUP BY project HAVING max(last) NOT IN ('F')")
def status_upsert(spark: SparkSession, d: str) -> DataFrame:
    """W10, J16."""
    o = given(spark, d, "SELECT o_custkey % 90 AS project_url, CASE o_orderstatus WHEN 'F' THEN 'success' ELSE o_orderstatus END AS status, o_orderkey AS seq FROM {orders}")
    lookup = rows.upsert_status(o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1"))
    left = rows.open_projects(lookup, lookup)
    return joins.fix_projects(left, o).select(F.col("project_url").alias("project"), "status")


@query("""SELECT e.event_id AS id, coalesce(r.cwe, 'unsafe') AS cwe, printf('CWE-%03d', (e.event_id % 3 + 20)::INT) AS shown, CASE e.event_id % 3 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' ELSE 'java' END AS language
FROM events e LEFT JOIN (VALUES ('click', 'CWE-79'), ('view', 'CWE-20')) r(rule_id, cwe) ON e.event_type = r.rule_id""")
def scanner_names(spark: SparkSession, d: str) -> DataFrame:
    """J17, T13."""
    e = given(spark, d, "SELECT event_id AS id, event_type AS rule_id, CASE event_id % 3 WHEN 0 THEN 'JS' WHEN 1 THEN 'py' ELSE 'Java' END AS l, 'cwe-' || CAST(event_id % 3 + 20 AS STRING) AS c FROM {events}")
    out = joins.rule_to_cwe(e, _lookup(spark, "('click', 'CWE-79'), ('view', 'CWE-20')", "rule_id, cwe"))
    return out.select("id", "cwe", R.scanner_cwe(F.col("c"), [20, 21, 22]).alias("shown"), R.scanner_language(F.col("l")).alias("language"))


@query("""SELECT o_custkey % 40 AS project_url, count(DISTINCT o_orderkey % 13) AS files, count(DISTINCT o_orderkey % 13) * 3 AS target, array_to_string(list_sort(list_distinct(list_concat(list('v' || o_orderkey % 3), list('f' || o_orderkey % 4)))), ' ') AS excluded FROM orders GROUP BY 1""")
def project_files(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    o = given(spark, d, "SELECT o_custkey % 40 AS project_url, o_orderkey % 13 AS file_path, 'v' || CAST(o_orderkey % 3 AS STRING) AS vuln_commit_hash, 'f' || CAST(o_orderkey % 4 AS STRING) AS fixed_commit_hash FROM {orders}")
    return aggregates.project_files(o).withColumn("excluded", F.array_join("excluded", " "))
