"""Queries on code, patches, regions and fused labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions import advisories as A
from patchloom.functions import code as C
from patchloom.functions import refs as R
from patchloom.operators import aggregates, contexts, filters, joins, patches, rows
from patchloom.plans.inputs import given
from patchloom.plans.registry import query
from patchloom.sinks import bag_lines, code_lines
from patchloom.sources import files


@query(r"SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS plain, len(regexp_extract_all(html, '[A-Za-z_]\w*|\d+|\S')) ::INT AS tokens FROM pages")
def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    """T14 (markup), T15."""
    p = given(spark, d, "SELECT page_id, html FROM {pages}")
    return p.select("page_id", F.md5(C.strip_markup_comments(F.col("html"))).alias("plain"), F.size(C.code_tokens(F.col("html"))).alias("tokens"))


@query("SELECT 'a = \"http://x\"; ' || chr(10) || 'b = ' || o_orderkey || ';' AS code, (o_orderkey % 2)::INT AS label FROM orders")
def code_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """What is written as JSON lines."""
    text = F.concat(F.lit('a = "http://x"; // note\nb = /* c */'), F.col("o_orderkey").cast("string"), F.lit(";"))
    o = given(spark, d, "SELECT o_orderkey FROM {orders}").select(F.col("o_orderkey").alias("id"), text.alias("input"), F.when(F.col("o_orderkey") % 2 == 0, "safe").otherwise("unsafe").alias("label"))
    return code_lines(o)


@query("""SELECT doc_id AS id, (len(string_split(regexp_replace(text, '\\n$', ''), chr(10))))::INT AS loc, md5(text) AS hash, md5('o_p_v_' || doc_id || '_1_2_3_4') AS place_hash,
 sha1('o_p_a_v1_1_2_v2_3') AS pair, len(string_split(trim(text), ' '))::INT AS contexts FROM documents WHERE text <> ''""")
def code_measures(spark: SparkSession, d: str) -> DataFrame:
    """T16, T17, T18."""
    t = given(spark, d, "SELECT doc_id AS id, text FROM {documents} WHERE text <> ''")
    place = C.function_hash(pair_hash=F.lit(""), key=[F.lit(x) for x in ("o", "p", "v")] + [F.col("id")] + [F.lit(i) for i in (1, 2, 3, 4)])
    lits = [F.lit(x) for x in ("o", "p", "a", "v1")]
    pair = C.pair_hash(*lits, F.array(F.lit(1), F.lit(2)), F.lit("v2"), F.array(F.lit(3)))
    return t.select("id", C.line_count(F.col("text")).alias("loc"), C.function_hash(pair_hash=F.md5("text"), key=[F.col("id")]).alias("hash"), place.alias("place_hash"), pair.alias("pair"), C.context_count(F.col("text")).alias("contexts"))


@query("""SELECT o_orderkey AS id, 'o' || (o_custkey % 50) AS owner, 'p' AS project, 'v1' AS version, 'src/a' || o_orderkey || '.js' AS fpath, 'root/o' || (o_custkey % 50) || '/p/v1/src/a' || o_orderkey || '.js' AS whole,
 'https://x/' || substr(sha1('p'), 1, 7) || '/f' AS url FROM orders""")
def repo_paths(spark: SparkSession, d: str) -> DataFrame:
    """T19, T23."""
    o = given(spark, d, "SELECT o_orderkey AS id, 'root/o' || CAST(o_custkey % 50 AS STRING) || '/p/v1/src/a' || CAST(o_orderkey AS STRING) || '.js' AS path FROM {orders}")
    p = o.withColumn("p", C.split_repo_path(F.col("path"), "root"))
    whole = C.join_repo_path(F.lit("root"), F.col("p.owner"), F.col("p.project"), F.col("p.version"), F.col("p.fpath"))
    sha = F.substring(F.sha1(F.lit("p")), 1, 7)
    return p.select("id", "p.*", whole.alias("whole"), C.replace_sha_in_url(F.lit("https://x/abc/f"), F.lit("abc"), sha).alias("url"))


@query("""WITH t AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents WHERE len(string_split(text, chr(10))) >= 3)
SELECT id, substr(l[1], 3) || chr(10) || l[2] || chr(10) || left(l[3], 4) AS three, substr(l[2], 2, 5) AS one FROM t""")
def slice_function(spark: SparkSession, d: str) -> DataFrame:
    """T20."""
    t = given(spark, d, "SELECT doc_id AS id, text FROM {documents}").filter(F.size(F.split("text", "\n")) >= 3)
    i = lambda n: F.lit(n)
    return t.select("id", C.slice_function(F.col("text"), i(1), i(2), i(3), i(4)).alias("three"), C.slice_function(F.col("text"), i(2), i(1), i(2), i(6)).alias("one"))


_PATCH = "'@@ -' || CAST(o_orderkey % 90 + 1 AS STRING) || ',4 +' || CAST(o_orderkey % 70 + 1 AS STRING) || ',5 @@ f' || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+c' || chr(10) || '+d' || chr(10) || ' e' || chr(10) || '@@ -200,2 +210,1 @@' || chr(10) || '-x' || chr(10) || ' y' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '+z' ELSE '' END"


@query("""SELECT o_orderkey AS id, (o_orderkey % 90 + 2) || ' 200' AS deleted, (o_orderkey % 70 + 2) || ' ' || (o_orderkey % 70 + 3) || CASE WHEN o_orderkey % 2 = 0 THEN ' 211' ELSE '' END AS added,
 (o_orderkey % 90 + 1) || ' 200' AS starts, CASE WHEN o_orderkey % 3 = 0 THEN 'modified' END AS status FROM orders""")
def hunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """W06, T22, D06's status."""
    o = given(spark, d, f"SELECT o_orderkey AS id, {_PATCH} AS patch FROM {{orders}}")
    h = o.withColumn("h", C.hunk_lines(F.col("patch")))
    join = lambda c: F.array_join(c.cast("array<string>"), " ")
    return h.select("id", join(F.col("h.deleted")).alias("deleted"), join(F.col("h.added")).alias("added"), join(F.transform(C.hunk_headers(F.col("patch")), lambda x: x["old_start"])).alias("starts"), C.change_status(F.when(F.col("id") % 3 == 0, "modified"), F.col("patch")).alias("status"))


@query(f"""WITH r AS (SELECT o_orderkey AS id, u.i, CASE WHEN u.i = 1 THEN 'src/a.js' ELSE 'src/b.js' END AS file_path FROM orders, (VALUES (1), (2)) u(i))
SELECT id, file_path, 'v' || id AS vuln_commit_hash, 'u/v' || id || '/f' AS raw_url_vuln, (id % 90 + 2) || ' 200' AS deleted FROM r WHERE NOT (i = 2 AND id % 5 = 0)""")
def fix_scenario(spark: SparkSession, d: str) -> DataFrame:
    """D06, W02, F08, F09, Q14's explode."""
    o = given(spark, d, f"SELECT o_orderkey, {_PATCH} AS patch FROM {{orders}}")
    change = lambda status: F.struct(F.lit(1).alias("additions"), F.lit(1).alias("deletions"), F.lit(2).alias("changes"), status.alias("status"), F.concat(F.lit("u/s"), F.col("o_orderkey").cast("string"), F.lit("/f")).alias("raw_url"), F.col("patch").alias("patch"))
    status = F.when(F.col("o_orderkey") % 5 == 0, "removed")
    named = F.create_map(F.lit("src/a.js"), change(F.lit("modified")), F.lit("src/b.js"), change(status), F.lit("src/test/c.js"), change(F.lit("modified")), F.lit("d.py"), change(F.lit("modified")))
    key = F.col("o_orderkey").cast("string")
    df = o.select(F.lit("OSV").alias("dataset"), F.concat(F.lit("https://github.com/o/p"), key).alias("project_url"), F.concat(F.lit("s"), key).alias("commit_sha"), F.concat(F.lit("v"), key).alias("before_first_fix_commit"), F.concat(F.lit("s"), key).alias("last_fix_commit"), key.alias("vuln_id"), F.lit("CWE-1").alias("cwe_id"), F.lit(1.0).alias("score"), F.lit("b").alias("bf_class"), F.lit("op").alias("operation"), named.alias("files"))
    out = patches.fix_scenario(df.union(df), ["js"])
    return out.select(F.col("vuln_id").cast("long").alias("id"), "file_path", "vuln_commit_hash", "raw_url_vuln", F.array_join(F.col("locs_deleted").cast("array<string>"), " ").alias("deleted"))


@query("""SELECT o_orderkey AS id, 1 AS start, 'src/a' || o_orderkey || '.js' AS a_path, 'src/b.js' AS b_path FROM orders""")
def diff_blocks(spark: SparkSession, d: str) -> DataFrame:
    """D02."""
    text = "'diff' || chr(10) || '--- a/src/a' || CAST(o_orderkey AS STRING) || '.js' || chr(10) || '+++ b/src/b.js' || chr(10) || '--- a/x.py' || chr(10) || '+++ b/x.py' || chr(10) || '--- a/test/y.js' || chr(10) || '+++ b/test/y.js' || chr(10) || '--- /dev/null.js' || chr(10) || '+++ b/n.js'"
    return patches.diff_blocks(given(spark, d, f"SELECT o_orderkey AS id, {text} AS diff FROM {{orders}}"), ["js"])


_HELD = """(f.sline, f.scol) <= (r.sline, r.scol) AND (r.eline, r.ecol) <= (f.eline, f.ecol)"""


@query(f"""WITH f AS (SELECT * FROM functions_in QUALIFY row_number() OVER (PARTITION BY owner, project, version, fpath, ftype, ord ORDER BY sline, eline) = 1),
h AS (SELECT r.owner, r.project, r.version, r.fpath, r.label, r.pair_hash, arg_max((f.sline, f.scol, f.eline, f.ecol, f.ftype), CASE WHEN f.ftype = 'fn_dec' THEN 1000 ELSE 0 END + f.ord) AS b
 FROM (SELECT *, row_number() OVER () AS n FROM regions_in) r JOIN f ON r.owner = f.owner AND r.project = f.project AND r.version = f.version AND r.fpath = f.fpath AND {_HELD} GROUP BY r.n, r.owner, r.project, r.version, r.fpath, r.label, r.pair_hash)
SELECT DISTINCT owner, project, version, fpath, b[1] AS sline, b[2] AS scol, b[3] AS eline, b[4] AS ecol, b[5] AS ftype, label, pair_hash FROM h""", ("regions", "functions"))
def enclosing_function(spark: SparkSession, d: str) -> DataFrame:
    """J06, F17."""
    keys = joins.FILE + ["ftype", "ord"]
    f = given(spark, d, "functions").groupBy(*keys).agg(F.min(F.struct("sline", "eline", "scol", "ecol")).alias("r")).select(*keys, "r.*")
    return joins.enclosing_function(given(spark, d, "regions"), f)


@query("""SELECT DISTINCT f.owner, f.fpath, f.sline, f.eline, f.ftype, r.cwe, r.sfp FROM functions_in f LEFT JOIN (SELECT owner, project, version, fpath, sline - 1 AS sline, 0 AS scol, eline + 3 AS eline, 1 AS ecol, label AS cwe, 's1' AS sfp FROM regions_in WHERE label <> 'safe') r USING (owner, project, version, fpath, sline, scol, eline, ecol)""", ("functions", "regions"))
def attach_cwe(spark: SparkSession, d: str) -> DataFrame:
    """J05, W04, P13."""
    f = A.cast_positions(given(spark, d, "functions"))
    r = given(spark, d, "regions").withColumns({"sline": (F.col("sline") - 1).cast("string"), "scol": F.lit("x"), "eline": (F.col("eline") + 3).cast("string"), "ecol": F.lit("1"), "sfp": F.lit("s1")})
    return joins.attach_cwe(f.drop("ord"), A.cast_positions(r)).select("owner", "fpath", F.col("sline").cast("int").alias("sline"), F.col("eline").cast("int").alias("eline"), "ftype", "cwe", "sfp")


_FUSED = """fused AS (SELECT coalesce(a.hash, b.hash) AS hash, CASE WHEN a.hash IS NULL THEN 'safe' ELSE a.label END AS diff_label, a.cwe AS diff_cwe, a.sfp AS diff_sfp, CASE WHEN b.hash IS NULL THEN 'safe' ELSE b.label END AS sa_label, b.cwe AS sa_cwe, b.sfp AS sa_sfp
 FROM diff_labels_in a FULL JOIN static_labels_in b ON a.hash = b.hash)"""


@query(f"WITH {_FUSED} SELECT * FROM fused", ("diff_labels", "static_labels"))
def fuse_labels(spark: SparkSession, d: str) -> DataFrame:
    """J02, J03, J04, U01."""
    return joins.fuse_labels(given(spark, d, "diff_labels"), given(spark, d, "static_labels"))


def _joined(inner: bool) -> str:
    both = "diff_label = 'unsafe' AND sa_label = 'unsafe'"
    pair = lambda c: f"CASE WHEN diff_{c} IS NOT DISTINCT FROM sa_{c} THEN diff_{c} ELSE nullif(concat_ws('|', diff_{c}, sa_{c}), '') END"
    return f"""WITH {_FUSED} SELECT hash, CASE WHEN diff_label <> sa_label THEN '{'safe' if inner else 'unsafe'}' ELSE diff_label END AS label,
 CASE WHEN {both} THEN {pair('cwe')} WHEN sa_label = 'unsafe' THEN sa_cwe ELSE diff_cwe END AS cwe,
 CASE WHEN {both} AND diff_cwe IS NOT DISTINCT FROM sa_cwe THEN {pair('sfp')} WHEN sa_label = 'unsafe' AND diff_label = 'safe' THEN sa_sfp ELSE diff_sfp END AS sfp FROM fused"""


@query(_joined(False), ("diff_labels", "static_labels"))
def hybrid_label(spark: SparkSession, d: str) -> DataFrame:
    """U03, outer."""
    return joins.join_labels(fuse_labels(spark, d))


@query(_joined(True), ("diff_labels", "static_labels"))
def hybrid_label_inner(spark: SparkSession, d: str) -> DataFrame:
    """U03, inner."""
    return joins.join_labels(fuse_labels(spark, d), inner=True)


@query("""WITH w AS (SELECT *, count(*) OVER (PARTITION BY project, fpath, label) AS n FROM (SELECT * REPLACE (CASE WHEN label = 'safe' THEN 'safe' ELSE 'unsafe' END AS label) FROM regions_in)),
k AS (SELECT * FROM w WHERE label = 'safe' OR n < 2) SELECT fpath, label, owner, sline, eline, (row_number() OVER (PARTITION BY fpath ORDER BY ecol, eline, label, owner, pair_hash, project, scol, sline, version) - 1)::INT AS func_id FROM (SELECT DISTINCT * EXCLUDE n FROM k)""", ("regions",))
def single_function_files(spark: SparkSession, d: str) -> DataFrame:
    """A08, W04, W05."""
    r = given(spark, d, "regions").withColumn("label", F.when(F.col("label") == "safe", "safe").otherwise("unsafe"))
    single = rows.single_function_files(r).distinct()
    return rows.func_id(single.select("ecol", "eline", "label", "owner", "pair_hash", "project", "scol", "sline", "version", "fpath"), ["fpath"]).select("fpath", "label", "owner", "sline", "eline", "func_id")


@query("""WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
SELECT path, n::INT AS line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM l""")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    """K04."""
    t = given(spark, d, "SELECT doc_id AS path, text FROM {documents}").select("path", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return contexts.line_offsets(t.withColumn("line_no", F.col("p") + 1)).select("path", "line_no", "offset")


@query("""WITH l AS (SELECT string_split(text, ' ') AS l FROM documents), w AS (SELECT DISTINCT unnest(list_zip(l[:-2], l[2:])) AS p FROM l WHERE len(l) > 1), v AS (SELECT p[1] AS a, p[2] AS b FROM w)
SELECT a, b, CASE WHEN lower(regexp_replace(a, '[^a-zA-Z]', '', 'g')) = '' THEN lower(a) ELSE lower(regexp_replace(a, '[^a-zA-Z]', '', 'g')) END AS normal, regexp_matches(a, '^[a-zA-Z|]+$') AS legal,
 CASE WHEN regexp_matches(a, '^[a-zA-Z|]+$') THEN (CASE WHEN regexp_matches(b, '^[a-zA-Z|]+$') THEN 1 ELSE 0 END) END AS place, len(string_split(a || '|' || b, '|'))::INT AS parts FROM v WHERE lower(regexp_replace(a, '[^a-zA-Z]', '', 'g')) <> lower(regexp_replace(b, '[^a-zA-Z]', '', 'g'))""")
def words_and_names(spark: SparkSession, d: str) -> DataFrame:
    """All words that stand beside each other."""
    # Words are exploded from an array of one, so that a text is cut once.
    cut = F.col("cut")
    both = F.arrays_zip(F.slice(cut, 1, F.size(cut) - 1).alias("a"), F.slice(cut, 2, F.size(cut) - 1).alias("b"))
    t = given(spark, d, "SELECT text FROM {documents}").select(F.explode(F.array(F.split("text", " "))).alias("cut"))
    w = t.filter(F.size(cut) > 1).select(F.explode(both).alias("p")).select("p.a", "p.b").distinct()
    w = w.filter(F.lower(F.regexp_replace("a", "[^a-zA-Z]", "")) != F.lower(F.regexp_replace("b", "[^a-zA-Z]", "")))
    hit = R.first_match_word(F.col("a"), F.array("b", "a"))
    return w.select("a", "b", R.normalize_word(F.col("a")).alias("normal"), R.legal_name(F.col("a")).alias("legal"), hit["pos"].alias("place"), F.size(R.subtokens(F.concat_ws("|", "a", "b"))).alias("parts"))


_PAIRS = """SELECT d.doc_id AS id, 'o' AS owner, 'p' AS project, 'v1' AS a_version, 'v2' AS b_version, 'a.js' AS a_path, 'a.js' AS b_path, d.text AS a_text,
 replace(d.text, 'the ', 'THE ') || chr(10) || '// note' || chr(10) || 'end' AS b_text FROM {documents} d WHERE d.text IS NOT NULL"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, _PAIRS)


#: Lines of _PAIRS by number: those with "the " differ, and two are added; lines changed one after another are a hunk.
_CHANGED = """t AS (SELECT doc_id AS id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), l AS (SELECT id, len(a) AS n, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM t),
c AS (SELECT id, n, i, line, replace(line, 'the ', 'THE ') AS other FROM l WHERE contains(line, 'the ') UNION ALL SELECT id, len(a), len(a) + 1, NULL, '// note' FROM t UNION ALL SELECT id, len(a), len(a) + 2, NULL, 'end' FROM t),
h AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS hunk FROM c)"""


@query(f"""WITH {_CHANGED}, e AS (SELECT id, n, hunk, 'a' AS side, i, line FROM h WHERE line IS NOT NULL UNION ALL SELECT id, n, hunk, 'b', i, other FROM h),
k AS (SELECT * FROM e WHERE trim(line, ' ') <> '' AND NOT starts_with(ltrim(line, ' '), '//') AND NOT starts_with(ltrim(line, ' '), '/*')),
p AS (SELECT id, hunk, sha1('o_p_a.js_v1_' || coalesce(string_agg(i::VARCHAR, '_' ORDER BY i) FILTER (side = 'a'), '') || '_v2_' || coalesce(string_agg(i::VARCHAR, '_' ORDER BY i) FILTER (side = 'b'), '')) AS pair_hash FROM k GROUP BY 1, 2),
r AS (SELECT id, 1.0::DOUBLE - count(*)::DOUBLE / (2 * first(n) + 2) AS sim_ratio FROM k GROUP BY 1)
SELECT 'o' AS owner, 'p' AS project, CASE side WHEN 'a' THEN 'v1' ELSE 'v2' END AS version, 'a.js' AS fpath, i AS sline, 0 AS scol, i AS eline, length(line)::INT AS ecol, CASE side WHEN 'a' THEN 'unsafe' ELSE 'safe' END AS label, pair_hash, round(sim_ratio, 9) AS sim_ratio FROM k JOIN p USING (id, hunk) JOIN r USING (id)""")
def line_diff(spark: SparkSession, d: str) -> DataFrame:
    """D01, A11."""
    return patches.line_diff(_pairs(spark, d)).withColumn("sim_ratio", F.round("sim_ratio", 9))


@query(f"""WITH {_CHANGED}, g AS (SELECT *, i - lag(i) OVER (PARTITION BY id ORDER BY i) - 1 > 6 AS cut FROM h), s AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY id ORDER BY i) AS part FROM g),
f AS (SELECT id, min(i) AS low, max(i) AS high, count(line) AS olds FROM s WHERE part = 0 GROUP BY 1), b AS (SELECT doc_id AS id, string_split(text, chr(10)) AS a, string_split(replace(text, 'the ', 'THE ') || chr(10) || '// note' || chr(10) || 'end', chr(10)) AS b FROM documents)
SELECT id, CASE WHEN olds > 0 THEN array_to_string(a[greatest(low - 3, 1) : high + 3], chr(10)) END AS vuln_snippet, array_to_string(b[greatest(low - 3, 1) : high + 3], chr(10)) AS fix_snippet FROM f JOIN b USING (id)""")
def paired_snippets(spark: SparkSession, d: str) -> DataFrame:
    """D03."""
    return patches.paired_snippets(_pairs(spark, d))


@query("""WITH u AS (SELECT doc_id AS id, 'vuln' AS tag, 'unsafe' AS label, text AS input, 'CWE-1' AS cwe_id FROM documents UNION ALL SELECT doc_id, 'fix', 'safe', text || 'x', NULL FROM documents UNION ALL SELECT doc_id, 'non-vuln', 'safe', 'y', NULL FROM documents WHERE doc_id % 2 = 0)
SELECT id, tag, label, cwe_id, md5(input) AS h FROM u WHERE length(trim(input)) > 0""")
def samples(spark: SparkSession, d: str) -> DataFrame:
    """D05, F18."""
    t = given(spark, d, "SELECT doc_id AS id, text AS vuln_code, text || 'x' AS fix_code, CASE WHEN doc_id % 2 = 0 THEN 'y' ELSE '  ' END AS non_vuln_code, 'CWE-1' AS cwe_id, 1.0 AS score FROM {documents}")
    return filters.nonempty_code(patches.to_samples(t, fix=True), "input").select("id", "tag", "label", "cwe_id", F.md5("input").alias("h"))


def _share(seed: int, name: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || id || ':{name}'), 1, 8))::BIGINT / 4294967296.0)"


@query(f"""WITH t AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n, CASE WHEN doc_id % 2 = 0 THEN 4 END AS v FROM documents),
s AS (SELECT *, round_even((coalesce(v, floor({_share(3, 'v')} * (round(n * 0.05) + 1))) + floor({_share(3, 'f')} * (round(n * 0.25) + 1))) / 2.0, 0)::INT AS size FROM t), r AS (SELECT *, floor({_share(3, 's')} * (CASE WHEN n > size THEN n - size ELSE round(n / 2) END + 1))::INT AS start FROM s)
SELECT id, CASE WHEN coalesce(text, '') <> '' THEN coalesce(array_to_string(lines[start + 1 : start + size], chr(10)), '') END AS snippet FROM r""")
def random_snippets(spark: SparkSession, d: str) -> DataFrame:
    """D04."""
    t = given(spark, d, "SELECT doc_id AS id, text, CASE WHEN doc_id % 2 = 0 THEN 4 END AS size_vuln, CAST(NULL AS INT) AS size_fix FROM {documents}")
    return patches.random_snippets(t, 3).select("id", "snippet")


@query("""SELECT 'o/p/f' || l_orderkey || '.js' AS path, CASE WHEN u.k = 0 THEN 'fn_dec' ELSE 'fn_exp' END AS ftype, 0 AS ord, l_linenumber::INT AS sline, 1 AS scol, (l_linenumber + 3)::INT AS eline, (2 + u.k)::INT AS ecol FROM lineitem, (VALUES (0), (1)) u(k)""")
def function_bounds(spark: SparkSession, d: str) -> DataFrame:
    """S06."""
    line = """'{"path": "o/p/f' || CAST(l_orderkey AS STRING) || '.js", "fnDec": ["' || CAST(l_linenumber AS STRING) || ',1,' || CAST(l_linenumber + 3 AS STRING) || ',2"], "fnExps": ["' || CAST(l_linenumber AS STRING) || ',1,' || CAST(l_linenumber + 3 AS STRING) || ',3"]}'"""
    l_ = given(spark, d, f"SELECT {line.replace('{', '{{').replace('}', '}}')} AS value FROM {{lineitem}}")
    return files.function_bounds(l_)


@query("""SELECT event_id::DOUBLE AS precision, (event_id % 7)::DOUBLE AS f1, (event_id % 5)::DOUBLE AS tnr FROM events WHERE event_id % 3 > 0""")
def metric_log(spark: SparkSession, d: str) -> DataFrame:
    """S07."""
    names = [m for m in files.METRICS if m not in ("precision", "f1", "tnr")]
    other = " || ' ".join(["'precision: ' || CAST(event_id AS STRING) || ' f1: ' || CAST(event_id % 7 AS STRING) || ' tnr: ' || CAST(event_id % 5 AS STRING)", " ".join(f"{m}: 0.5" for m in names) + "'"])
    e = given(spark, d, f"SELECT CASE WHEN event_id % 3 = 0 THEN 'epoch 1' ELSE {other} END AS value FROM {{events}}")
    return files.metric_rows(e).select("precision", "f1", "tnr")


@query("""WITH b AS (SELECT arg_min(lang, doc_id) AS label, string_split(text, ' ') AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 2), c AS (SELECT tokens, t, count(*) AS n FROM (SELECT tokens, unnest(tokens) AS t FROM b) GROUP BY 1, 2)
SELECT md5(array_to_string(tokens, ' ')) AS bag_id, round(sqrt(sum(n * n)), 6) AS norm, count(*)::INT AS kinds FROM c GROUP BY tokens""")
def labelled_bags(spark: SparkSession, d: str) -> DataFrame:
    """S11, K09."""
    t = given(spark, d, "SELECT doc_id, lang, text FROM {documents} WHERE text IS NOT NULL").select("lang", F.split("text", " ").alias("tokens"))
    lines = bag_lines(t.withColumnRenamed("lang", "label"))
    cut = F.split(F.col("value"), " ")
    bags = files.bag_rows(lines.select(F.get(cut, 0).alias("label"), F.expr("slice(split(value, ' '), 2, size(split(value, ' ')))").alias("tokens")))
    return bags.select("bag_id", F.round("norm", 6).alias("norm"), F.size("counts").alias("kinds"))


@query("""WITH w AS (SELECT p_size || 'w' AS word, max(p_partkey) AS n FROM part WHERE p_partkey >= 20 GROUP BY 1), e AS (SELECT n FROM w ORDER BY n DESC LIMIT 1 OFFSET 30) SELECT word, n FROM w WHERE n > (SELECT n FROM e)""")
def histogram_words(spark: SparkSession, d: str) -> DataFrame:
    """S12."""
    return files.histogram_words(given(spark, d, "SELECT CAST(p_size AS STRING) || 'w ' || CAST(p_partkey AS STRING) AS value FROM {part}"), 20, 30)


@query("""SELECT o_orderkey AS id, u.f AS file_path, 3 AS commit_changes, 'p' AS patch, 'com_1' AS com FROM orders, (VALUES ('a.js'), ('b.js')) u(f)""")
def commit_files(spark: SparkSession, d: str) -> DataFrame:
    """P12, S13."""
    change = F.expr("named_struct('additions', 1, 'deletions', 2, 'changes', 3, 'status', 'modified', 'raw_url', 'u', 'patch', ' p ')")
    o = given(spark, d, "SELECT o_orderkey AS commit_sha FROM {orders}").withColumns({"files": F.create_map(F.lit("a.js"), change, F.lit("b.js"), change), "stats": F.expr("named_struct('additions', 1, 'deletions', 2, 'total', 3)"), "comments": F.create_map(F.lit("com_1"), F.expr("named_struct('author', 'x', 'datetime', 'y', 'body', 'z')"))})
    return A.commit_file_rows(o).join(A.commit_comments(o), "commit_sha").select(F.col("commit_sha").alias("id"), "file_path", "commit_changes", "patch", "com")


@query("""SELECT l_orderkey AS id, sum(l_linenumber)::BIGINT AS n, round(1.0 - (count(*) + 1) / (sum(l_linenumber) + 7.0), 6)::DOUBLE AS ratio FROM lineitem GROUP BY 1""")
def similarity_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A11."""
    g = given(spark, d, "SELECT l_orderkey AS id, CAST(sum(l_linenumber) AS BIGINT) AS n, count(*) AS c FROM {lineitem} GROUP BY 1")
    return g.select("id", "n", F.round(aggregates.similarity_ratio(F.col("c"), F.lit(1), F.col("n"), F.lit(7)), 6).cast("double").alias("ratio"))
