"""Registered queries that write files from the tables in the formats of the sources, and read them by the sources' readers."""

from __future__ import annotations

import tempfile
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import sinks
from patchloom.operators import joins, patches, splits
from patchloom.plans import dataset
from patchloom.plans.inputs import SELECTS, given
from patchloom.plans.registry import query
from patchloom.session import scratch_dir
from patchloom.sources import files, lookups


def _objects(rows: DataFrame, *folders: str) -> DataFrame:
    """value (the JSON of all columns but folders, nulls left out) and folders."""
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns if c not in folders])).alias("value"), *folders)


_COMMIT = "mapreduce.fileoutputcommitter.algorithm.version"


def _dealt(rows: DataFrame, *keys: str | Column, of: int) -> DataFrame:
    """rows in tasks by keys, so many that one has about joins.TASK_ROWS of what has of rows."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-of // joins.TASK_ROWS)), *keys)


def _stored(spark: SparkSession, values: DataFrame, name: str, *folders: str, dealt: bool = False) -> str:
    """Path of text files of values, one for each value of folders in a task; dealt values are in tasks by folders.

    The number of tasks is fixed, as few bytes may be very many files, which adaptive execution would leave to one task.
    Tasks move their own files into place (the committer's second algorithm): with one folder for each row, the first
    would have the driver move all of them one after another at the end.
    """
    path = scratch_dir(spark, name)
    if folders and not dealt:
        values = values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *folders)
    write = values.write.partitionBy(*folders).option(_COMMIT, "2") if folders else values.write
    write.text(path)
    return path


def _urls() -> Column:
    return F.array(F.struct(F.lit("WEB").alias("type"), F.concat(F.lit("https://b/"), "k").alias("url")), F.struct(F.lit("FIX").alias("type"), F.concat(F.lit("https://a/"), "k").alias("url")))


@query("""SELECT 'OSV-' || s_suppkey AS vuln_id, 'e=n' || s_nationkey AS ecosystem, CASE WHEN s_suppkey % 3 > 0 THEN 'CVE-' || s_suppkey END AS alias, s_name AS summary,
 CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS details, '2020-01-01T00:00:00Z' AS published_date, 'https://a/' || s_suppkey || ' https://b/' || s_suppkey AS refs FROM supplier""")
def scan_osv(spark: SparkSession, d: str) -> DataFrame:
    """One file for each advisory, in a folder named by its ecosystem."""
    rows = given(spark, d, "SELECT CAST(s_suppkey AS STRING) AS k, s_suppkey, s_nationkey, s_name FROM {supplier}")
    made = rows.select(
        F.concat(F.lit("OSV-"), "k").alias("id"), F.when(F.col("s_suppkey") % 3 > 0, F.array(F.concat(F.lit("CVE-"), "k"))).alias("aliases"), F.col("s_name").alias("summary"),
        F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).alias("details"), F.lit("2020-01-01T00:00:00Z").alias("published"), _urls().alias("references"),
        F.col("k").alias("f"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("e"),
    )
    found = files.scan_osv_reports(spark, _stored(spark, _objects(made, "f", "e"), "osv", "f", "e"))
    return found.select("vuln_id", "ecosystem", F.get("aliases", 0).alias("alias"), "summary", "details", "published_date", F.array_join("refs", " ").alias("refs"))


@query("""SELECT 'GHSA-' || s_suppkey AS vuln_id, CASE WHEN s_suppkey % 3 > 0 THEN 'CVE-' || s_suppkey END AS alias, s_name AS summary, s_name AS details, 'HIGH' AS severity,
 (s_suppkey % 10)::DOUBLE AS score, 'CWE-20 CWE-79' AS cwes, 'https://a/' || s_suppkey || ' https://b/' || s_suppkey AS refs FROM supplier""")
def scan_ghsa(spark: SparkSession, d: str) -> DataFrame:
    """One file for each advisory."""
    rows = given(spark, d, "SELECT CAST(s_suppkey AS STRING) AS k, s_suppkey, s_name FROM {supplier}")
    own = F.struct(F.concat(F.lit("GHSA-"), "k").alias("value"))
    other = F.struct(F.concat(F.lit("CVE-"), "k").alias("value"))
    made = rows.select(
        F.concat(F.lit("GHSA-"), "k").alias("ghsaId"), F.when(F.col("s_suppkey") % 3 > 0, F.array(own, other)).otherwise(F.array(own)).alias("identifiers"), _urls().alias("references"),
        F.concat(F.lit(" "), "s_name", F.lit("\n")).alias("summary"), F.col("s_name").alias("description"), F.lit("HIGH").alias("severity"),
        F.struct((F.col("s_suppkey") % 10).cast("double").alias("score")).alias("cvss"), F.expr("struct(array(struct('CWE-79' AS cweId), struct('CWE-20' AS cweId), struct('CWE-79' AS cweId)) AS nodes)").alias("cwes"), F.col("k").alias("f"),
    )
    found = files.scan_ghsa_reports(spark, _stored(spark, _objects(made, "f"), "ghsa", "f"))
    return found.select("vuln_id", F.get("aliases", 0).alias("alias"), "summary", "details", "severity", "score", F.array_join("cwe_id", " ").alias("cwes"), F.array_join("refs", " ").alias("refs"))


@query("""SELECT 'CVE-' || s_suppkey AS cve_id, 'CWE-' || s_nationkey AS cwes, s_name AS description, 'LOW' AS severity, (s_suppkey % 10)::DOUBLE AS impact, s_name AS published_date, 'https://a/' || s_suppkey || ' https://b/' || s_suppkey AS refs FROM supplier""")
def scan_nvd(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of a hundred items each."""
    rows = given(spark, d, "SELECT CAST(s_suppkey AS STRING) AS k, s_suppkey, s_nationkey, s_name FROM {supplier}")
    cwe = F.array(F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), F.col("s_nationkey").cast("string")).alias("value"))).alias("description")))
    cve = F.struct(
        F.struct(F.concat(F.lit("CVE-"), "k").alias("ID")).alias("CVE_data_meta"), F.struct(cwe.alias("problemtype_data")).alias("problemtype"),
        F.struct(F.array(F.struct(F.col("s_name").alias("value"))).alias("description_data")).alias("description"), F.struct(_urls().alias("reference_data")).alias("references"),
    )
    metric = F.struct(F.lit("LOW").alias("severity"), (F.col("s_suppkey") % 10).cast("double").alias("impactScore"))
    item = F.struct(cve.alias("cve"), F.struct(metric.alias("baseMetricV2")).alias("impact"), F.col("s_name").alias("publishedDate"))
    feeds = rows.groupBy(F.floor(F.col("s_suppkey") / 100).alias("f")).agg(F.collect_list(item).alias("CVE_Items"))
    found = files.scan_nvd_feed(spark, _stored(spark, _objects(feeds, "f"), "nvd", "f"))
    return found.select("cve_id", F.array_join("cwes", " ").alias("cwes"), "description", "severity", "impact", "published_date", F.array_join("refs", " ").alias("refs"))


@query("""SELECT md5(o_orderkey::VARCHAR) AS commit_sha, o_orderstatus AS author, o_orderpriority AS message, o_custkey::INT AS additions, 'src/' || l_linenumber || '.js' AS file_path, CASE WHEN max(l_returnflag) = 'R' THEN 'removed' ELSE 'modified' END AS status
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority, o_custkey, l_linenumber""")
def scan_commits(spark: SparkSession, d: str) -> DataFrame:
    """Files of a thousand orders' commits each, with a map of changed files."""
    orders = given(spark, d, "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM {orders}")
    lines = given(spark, d, "SELECT l_orderkey AS o_orderkey, l_linenumber, l_returnflag FROM {lineitem}")
    n = lines.count() + orders.count()
    flags = _dealt(lines, "o_orderkey", of=n).groupBy("o_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    changed = flags.groupBy("o_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("changes"))
    commits = _dealt(orders, "o_orderkey", of=n).distinct().join(changed, "o_orderkey")
    name = lambda c: F.concat(F.lit("src/"), c["l_linenumber"].cast("string"), F.lit(".js"))
    change = lambda c: F.struct(name(c).alias("key"), F.struct(F.when(c["l_returnflag"] == "R", "removed").otherwise("modified").alias("status")).alias("value"))
    made = _dealt(commits.withColumn("f", F.floor(F.col("o_orderkey") / 1000)), "f", of=n).select(
        F.md5(F.col("o_orderkey").cast("string")).alias("commit_sha"), F.col("o_orderstatus").alias("author"), F.col("o_orderpriority").alias("message"),
        F.struct(F.col("o_custkey").cast("int").alias("additions")).alias("stats"), F.map_from_entries(F.transform("changes", change)).alias("files"), "f",
    )
    whole = _objects(made, "f").groupBy("f").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    found = files.scan_commit_metadata(spark, _stored(spark, whole, "commits", "f", dealt=True))
    return found.select("commit_sha", "author", "message", "stats.additions", F.explode("files").alias("file_path", "c")).select("commit_sha", "author", "message", "additions", "file_path", F.col("c.status").alias("status"))


@query("""SELECT 'o' || l_suppkey % 3 AS owner, 'p' AS project, 'v1' AS version, 'src/f' || l_orderkey || '.js' AS fpath, l_linenumber::INT AS sline, l_linenumber::INT + l_partkey % 2 * 3 AS eline,
 CASE WHEN l_partkey % 3 = 0 THEN 'CWE-22' ELSE 'unsafe' END AS label FROM lineitem WHERE l_partkey % 5 > 0""")
def scan_sarif(spark: SparkSession, d: str) -> DataFrame:
    """Reports of a thousand orders each; every fifth part's findings are in files of another language."""
    rows = given(spark, d, "SELECT l_orderkey, l_suppkey, l_partkey, CAST(l_linenumber AS INT) AS l_linenumber FROM {lineitem}")
    uri = F.concat(F.lit("o"), (F.col("l_suppkey") % 3).cast("string"), F.lit("/p/v1/src/f"), F.col("l_orderkey").cast("string"), F.when(F.col("l_partkey") % 5 > 0, ".js").otherwise(".py"))
    region = F.struct(F.col("l_linenumber").alias("startLine"), F.lit(1).alias("startColumn"), F.when(F.col("l_partkey") % 2 > 0, F.col("l_linenumber") + 3).alias("endLine"), F.lit(9).alias("endColumn"))
    place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(F.when(F.col("l_partkey") % 3 == 0, "js/zipslip").otherwise("js/other").alias("ruleId"), place.alias("locations"))
    # Dealt out as the few numbers they come from, and only once.
    dealt = _dealt(rows.withColumn("f", F.floor(F.col("l_orderkey") / 1000)), "f", of=rows.count())
    reports = dealt.groupBy("f").agg(F.array(F.struct(F.collect_list(result).alias("results"))).alias("runs"))
    found = files.scan_sarif(spark, _stored(spark, _objects(reports, "f"), "sarif", "f", dealt=True))
    return found.select("owner", "project", "version", "fpath", "sline", F.col("eline").cast("bigint").alias("eline"), "label")


@query("""SELECT 'f' || event_id || '.js' AS fpath, (event_id % 50)::VARCHAR AS sline, (event_id % 50 + 3)::VARCHAR AS eline, CASE WHEN value > 50 THEN 'unsafe' ELSE 'safe' END AS label, md5(event_id::VARCHAR) AS hash, 'a,p' || user_id || ',b c,q,d' AS context_paths
FROM events WHERE event_id % 7 > 0""")
def scan_path_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of another form are skipped."""
    line = """CASE WHEN event_id % 7 = 0 THEN 'other line' ELSE 'f' || CAST(event_id AS STRING) || '.js_' || CAST(event_id % 50 AS STRING) || '_0_' || CAST(event_id % 50 + 3 AS STRING) || '_1 ' ||
 CASE WHEN value > 50 THEN 'unsafe' ELSE 'safe' END || ' ' || md5(CAST(event_id AS STRING)) || ' h a,p' || CAST(user_id AS STRING) || ',b c,q,d' END"""
    path = _stored(spark, given(spark, d, f"SELECT {line} AS value FROM {{events}}"), "contexts")
    return files.scan_path_contexts(spark, path, strict=False).select("fpath", "sline", "eline", "label", "hash", "context_paths")


@query("SELECT o_orderkey, o_orderstatus AS clerk, CASE WHEN o_orderkey % 3 = 0 THEN 'a \"quoted\", cell' ELSE o_orderpriority END AS note FROM orders")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    """CSV with quotes and separators within cells."""
    path = scratch_dir(spark, "table")
    rows = given(spark, d, "SELECT o_orderkey, o_orderstatus AS clerk, CASE WHEN o_orderkey % 3 = 0 THEN 'a \"quoted\", cell' ELSE o_orderpriority END AS note FROM {orders}")
    rows.write.csv(path, header=True, escape='"')
    return files.scan_table(spark, path, "o_orderkey bigint, clerk string, note string")


@query("""WITH s AS (SELECT s_suppkey AS n, repeat('x = ' || s_suppkey || '; ', (s_suppkey % 3 + 1)::INT) || chr(10) AS v FROM supplier)
SELECT 'n=' || n AS folder, octet_length(encode(v))::BIGINT AS size, CASE WHEN octet_length(encode(v)) <= 18 THEN v END AS text, CASE WHEN octet_length(encode(v)) > 18 THEN 'over the size limit' END AS error FROM s""")
def scan_code_files(spark: SparkSession, d: str) -> DataFrame:
    """Files over the limit have an error and no text."""
    path = _stored(spark, given(spark, d, "SELECT repeat('x = ' || CAST(s_suppkey AS STRING) || '; ', CAST(s_suppkey % 3 + 1 AS INT)) AS value, s_suppkey AS n FROM {supplier}"), "code", "n")
    found = files.scan_code_files(spark, path, 18)
    return found.select(F.regexp_extract("path", "/(n=[0-9]+)/", 1).alias("folder"), "size", "text", "error")


@query("SELECT id, label, split, fold, count(*) AS n FROM (SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 'safe' ELSE 'unsafe' END AS label, CASE l.doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, (l.doc_id % 4)::INT AS fold FROM labels l JOIN documents d ON l.doc_id = d.doc_id) GROUP BY 1, 2, 3, 4")
def dataset_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A dataset as CSV, then as Parquet in a folder for each fold and split."""
    split = F.when(F.col("id") % 3 == 0, "test").when(F.col("id") % 3 == 1, "val").otherwise("train")
    rows = given(spark, d, SELECTS["samples"]).select("id", "label", split.alias("split"), (F.col("id") % 4).cast("int").alias("fold"))
    whole, parts = scratch_dir(spark, "dataset"), scratch_dir(spark, "splits")
    sinks.write_dataset(rows, whole, "csv")
    sinks.write_splits(spark.read.csv(whole, header=True, schema="id bigint, label string, split string, fold int"), parts)
    return spark.read.parquet(parts).groupBy("id", "label", "split", "fold").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, (doc_id % 5)::DOUBLE AS first, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS label, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM labels")
def features_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Features and labels by split."""
    rows = given(spark, d, "SELECT doc_id, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS label, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM {labels}")
    path = scratch_dir(spark, "features")
    features: Column = F.array((F.col("doc_id") % 5).cast("double"), F.col("doc_id").cast("double"))
    sinks.write_features(rows.withColumn("features", features), ["a", "b"], path)
    found = spark.read.parquet(f"{path}/features")
    return found.select(F.col("features")[1].cast("bigint").alias("id"), F.col("features")[0].alias("first"), "label", "split")


@query("SELECT o_orderkey AS row_id, o_orderstatus AS clerk, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def attach_by_row(spark: SparkSession, d: str) -> DataFrame:
    """J01."""
    left = given(spark, d, "SELECT o_orderkey AS row_id, o_orderstatus AS clerk FROM {orders}")
    return joins.attach_by_row(left, given(spark, d, "SELECT l_orderkey AS row_id, l_linenumber AS line FROM {lineitem}"))


@query("""WITH u AS (SELECT vec_id AS id, embedding AS v FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM u a JOIN u b ON a.id <> b.id)
SELECT a, b, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS place FROM p) WHERE place <= 5""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """B11's neighbours of all vectors."""
    e = given(spark, d, "SELECT vec_id AS id, embedding AS vector FROM {embeddings}")
    return splits.nearest(e, 5).select("a", "b", F.round("d", 6).alias("d"))


class _Threshold:
    """A model that predicts 1 from a score of 0.5 on."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", (F.col("score") >= 0.5).cast("double"))


@query("""SELECT doc_id AS id, quality AS label, (doc_id % 100)::DOUBLE / 100 AS score, ((doc_id % 100)::DOUBLE / 100 >= 0.5)::INT AS predicted FROM labels""")
def predictions_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """K08."""
    path = scratch_dir(spark, "predictions")
    sinks.write_predictions(_Threshold(), given(spark, d, "SELECT doc_id AS id, quality AS label, CAST(doc_id % 100 AS DOUBLE) / 100 AS score FROM {labels}"), path)
    return spark.read.parquet(path)


@query("""SELECT doc_id AS id, (quality = 0)::INT AS label, n FROM (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n FROM labels)""")
def code_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, one of them sent twice."""
    path = scratch_dir(spark, "code-batches")
    rows = given(spark, d, "SELECT doc_id, quality, CASE WHEN quality = 1 THEN 'safe' ELSE 'unsafe' END AS label, CAST(doc_id AS STRING) AS input FROM {labels}")
    for batch in (0, 1, 0):
        sinks.write_code_jsonl(rows.filter(F.col("quality") == batch), path, batch=str(batch))
    found = sinks.read_code_jsonl(spark, path)
    counts = found.groupBy("label").agg(F.count("*").alias("n"))
    return found.join(counts, "label").select(F.col("code").cast("long").alias("id"), "label", "n")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'unk' ELSE CASE s_suppkey % 2 WHEN 0 THEN 'server' ELSE 'utility' END END AS sw_type, CASE s_nationkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'D' END AS bf_class FROM supplier""")
def lookup_files(spark: SparkSession, d: str) -> DataFrame:
    """Lookups from a folder of YAML files, as a user keeps them, joined with rows by what they name."""
    rows = given(spark, d, "SELECT s_suppkey AS id, 'o' || CAST(s_nationkey AS STRING) AS owner, 'p' || CAST(s_suppkey AS STRING) AS project, 'CWE-' || CAST(s_nationkey % 4 AS STRING) AS cwe_id FROM {supplier}")
    types: dict[str, dict[str, str]] = {}
    for r in rows.filter("id % 3 > 0").toLocalIterator():
        types.setdefault(r.owner, {})[r.project] = "server" if r.id % 2 == 0 else "utility"
    with tempfile.TemporaryDirectory() as folder:
        (Path(folder) / "sw_type.yml").write_text(yaml.safe_dump({"sw_type": types}))
        (Path(folder) / "mappings.yml").write_text(yaml.safe_dump({"mappings": {"bugs_framework": {"data": {"C": {"Op": {0: "zero"}}, "D": {"Op": {1: "one"}}}}}}))
        tables = lookups.load_lookups(spark, folder)
    classed = joins.bug_class(joins.software_type(rows, tables["software_type"]), tables["bug_class"])
    return classed.select("id", "sw_type", "bf_class")


_SHA = "sha1(CAST(o_orderkey AS STRING))"
_END = "'https://github.com/o' || CAST(o_custkey % 50 AS STRING) || '/p' || CAST(o_orderkey % 7 AS STRING)"


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 50 AS o, o_orderkey % 7 AS p, sha1(o_orderkey::VARCHAR) AS sha FROM orders WHERE o_orderkey % 10 < 9 AND o_orderkey % 6 > 0),
f AS (SELECT *, u.i FROM o, (VALUES (1), (2)) u(i) WHERE u.i = 1 OR k % 4 > 0),
s AS (SELECT 'V' || k AS vuln_id, 'o' || o AS owner, 'p' || p AS project, CASE k % 5 WHEN 0 THEN 'B0' WHEN 1 THEN 'B1' WHEN 2 THEN 'B2' END AS bf_class, CASE WHEN p = 3 THEN 'server' ELSE 'unk' END AS sw_type, sha AS fixed_commit_hash, 'v' || k AS vuln_commit_hash,
 CASE i WHEN 1 THEN 'src/a.js' ELSE 'src/b.js' END AS file_path, u.tag, CASE u.tag WHEN 'vuln' THEN 'unsafe' ELSE 'safe' END AS label, CASE u.tag WHEN 'vuln' THEN 'CWE-' || (k % 5) END AS cwe FROM f, (VALUES ('vuln'), ('fix')) u(tag))
SELECT *, CASE WHEN ('0x' || substr(md5('21:' || fixed_commit_hash), 1, 8))::BIGINT / 4294967296.0 < 0.1 THEN 'test' WHEN ('0x' || substr(md5('21:' || fixed_commit_hash), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM s""")
def dataset_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Advisories to fix commits, their metadata, cleaning, classes, changed files, samples and a split, one stage after another."""
    o = f"SELECT o_orderkey, o_custkey, {_SHA} AS sha, {_END} AS repo FROM {{orders}}"
    key = F.col("o_orderkey").cast("string")
    orders = given(spark, d, o)
    advisories = orders.select(
        F.concat(F.lit("V"), key).alias("vuln_id"), F.array(F.concat(F.lit("CWE-"), (F.col("o_orderkey") % 5).cast("string"))).alias("cwe_id"), F.lit(1.0).alias("score"), F.lit("OSV").alias("dataset"),
        F.array(F.when(F.col("o_orderkey") % 10 < 9, F.concat("repo", F.lit("/commit/"), "sha")).otherwise(F.concat(F.lit("https://example.com/"), key))).alias("refs"),
    )
    change = lambda status: F.struct(F.lit(1).alias("additions"), F.lit(1).alias("deletions"), F.lit(2).alias("changes"), status.alias("status"), F.lit("u").alias("raw_url"), F.lit("@@ -1,1 +1,1 @@\n-a\n+b").alias("patch"))
    status = F.when(F.col("o_orderkey") % 4 == 0, "removed").otherwise("modified")
    metadata = orders.select(
        F.col("sha").alias("commit_sha"), F.lit(1).alias("chain_ord_pos"), F.col("sha").alias("last_fix_commit"), F.array(F.concat(F.lit("v"), key)).alias("before_first_fix_commit"),
        F.when(F.col("o_orderkey") % 6 == 0, "Merge message of x").otherwise("fix").alias("message"),
        F.create_map(F.lit("src/a.js"), change(F.lit("modified")), F.lit("src/b.js"), change(status), F.lit("src/test/c.js"), change(F.lit("modified"))).alias("files"),
    )
    classes = given(spark, d, "SELECT n_nationkey AS ord, 'data' AS category, 'B' || CAST(n_nationkey AS STRING) AS bf_class, 'op' AS operation, n_nationkey AS cwe, 't' AS title FROM {nation} WHERE n_nationkey < 3")
    types = given(spark, d, "SELECT DISTINCT 'o' || CAST(o_custkey % 50 AS STRING) AS owner, 'P3 ' AS project, 'server' AS sw_type FROM {orders}")
    files_ = dataset.build_dataset(dataset.fix_commits(advisories, classes).drop("bf_class", "operation", "cwe"), metadata, classes, types, ["js"])
    coded = files_.withColumns({"vuln_code": F.lit("old"), "fix_code": F.lit("new"), "non_vuln_code": F.lit("")})
    made = splits.split_random(patches.to_samples(coded, fix=True), 21, "fixed_commit_hash")
    return made.select("vuln_id", "owner", "project", "bf_class", "sw_type", "fixed_commit_hash", "vuln_commit_hash", "file_path", "tag", "label", F.get("cwe_id", 0).alias("cwe"), "split")
