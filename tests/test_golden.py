"""Rules of references, patches and labels on rows written by hand; nulls and empty values throughout."""

import difflib

import pytest
from pyspark.sql import functions as F

from patchloom.functions import code, refs
from patchloom.operators import aggregates, filters, joins, models, patches, rows, splits
from patchloom.sinks import read_code_jsonl, write_code_jsonl, write_splits
from patchloom.sources import files, lookups
from patchloom.streaming.advisories import commits_of, stream_osv_commits

SHA = "0123456789abcdef0123456789abcdef01234567"
BASE = f"https://github.com/o/p/commit/{SHA}"


def values(spark, column, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_ref(spark):
    cases = {f"{BASE}CONFIRM:": BASE, "https://github.com/o/p/commits/master": None, f"git://github.com/o/p/commit/{SHA}": BASE, f"https://github.com/o/p/commits/master?after={SHA}": None,
             f"{BASE}#comments": BASE, f"{BASE}#commitcomment-1": BASE, f"{BASE}.patch": BASE, f"{BASE}%23diff": f"{BASE}#diff", BASE: BASE, "": None, None: None}
    assert values(spark, refs.normalize_ref, list(cases)) == list(cases.values())
    assert values(spark, refs.normalize_refs, [["x"], [BASE + ".patch", BASE], [], None], "array<string>") == [None, [BASE], None, None]


def test_clean_github_ref(spark):
    cases = {f"{BASE}#diff-1": None, f"{BASE}:{SHA}": None, f"{BASE}#C4/Output.pm": BASE, "https://github.com/o/p/commits/master": None, f"{BASE}?w=1": BASE, f"{BASE}?branch=x": BASE,
             f"{BASE}?diff=split": BASE, f"{BASE}/": BASE, f"{BASE},": BASE, f"{BASE})": BASE, BASE: BASE, None: None}
    assert values(spark, refs.clean_github_ref, list(cases)) == list(cases.values())


def test_split_urls(spark):
    two = [["https://a.bhttps://github.com/c"], ["https://a,https://github.com/b"], ["http://x"], [], None]
    assert values(spark, refs.split_urls, two, "array<string>") == [["https://a.b", "https://github.com/c"], ["https://a", "https://github.com/b"], ["http://x"], None, None]
    assert values(spark, refs.split_github_urls, two, "array<string>") == [["https://github.com/c"], ["https://github.com/b"], ["http://x"], None, None]


def test_names(spark):
    assert values(spark, refs.file_extension, ["a/b.JS", "Makefile", ".hidden", "a.tar.gz", None]) == ["js", "", "", "gz", None]
    assert values(spark, refs.parse_cwe_id, ["CWE-079", "none", None]) == [79, None, None]
    assert values(spark, refs.project_of_chain, [[BASE], [f"https://github.com/o/p/pull/3/commits/{SHA}"]], "array<string>") == ["https://github.com/o/p"] * 2
    assert values(spark, lambda c: refs.languages_of(c, lookups.LANGUAGE_EXTENSIONS), [["js", "py"], ["zzz"], None], "array<string>") == [["JavaScript", "Python"], None, None]
    assert values(spark, lambda c: refs.scanner_cwe(c, [79], True), ["CWE-79", "20", None]) == ["CWE-079", None, None]
    with pytest.raises(Exception, match="not available"):
        values(spark, refs.scanner_language, ["cobol"])
    with pytest.raises(Exception, match="unknown label"):
        values(spark, code.label_to_int, ["maybe"])


def test_comments_and_lines(spark):
    js = 'x = "http://y"; // c\n/* d */ z = \'//k\';'
    assert values(spark, lambda c: code.strip_comments(c, F.lit("js")), [js, None]) == ['x = "http://y"; \n z = \'//k\';', None]
    assert values(spark, lambda c: code.strip_comments(c, F.lit("py")), ["a = '#' # c"]) == ["a = '#' "]
    assert values(spark, lambda c: code.strip_comments(c, F.lit("zz")), [js]) == [js]
    assert values(spark, code.line_count, ["", "a", "a\n", "a\nb", None]) == [0, 1, 1, 2, None]
    assert values(spark, lambda c: code.slice_function(c, F.lit(2), F.lit(1), F.lit(3), F.lit(2)), ["ab\ncdef\nghij\nk"]) == ["def\ngh"]


def test_hunk_lines(spark):
    patch = "@@ -5,3 +5,4 @@ f()\n a\n-b\n+c\n+d\n e\n@@ -20,1 +21,1 @@\n-x\n\\ No newline at end of file"
    deleted, added = [6, 20], [6, 7]
    (row,) = values(spark, code.hunk_lines, [patch])
    assert (row.deleted, row.added) == (deleted, added)
    assert values(spark, code.hunk_lines, [None, "no header"])[0] is None
    long = "@@ -1,1 +5,1 @@ f\n" + "+a\n b\n-c\n" * 20000
    (row,) = values(spark, code.hunk_lines, [long])
    assert row["deleted"] == list(range(2, 40001, 2)) and row["added"] == list(range(5, 40005, 2))


def test_hybrid_labels(spark):
    both = [(d, dc, s, sc) for d in ("safe", "unsafe") for dc in ("A", None) for s in ("safe", "unsafe") for sc in ("A", "B", None)]
    df = spark.createDataFrame([(d, dc, "s1", s, sc, "s2") for d, dc, s, sc in both], "diff_label string, diff_cwe string, diff_sfp string, sa_label string, sa_cwe string, sa_sfp string")
    for inner in (False, True):
        found = [tuple(r.j) for r in df.select(code.hybrid_label(inner).alias("j")).collect()]
        for (d, dc, s, sc), (label, cwe, _) in zip(both, found, strict=True):
            assert label == (d if d == s else "safe" if inner else "unsafe")
            if d == s == "unsafe":
                assert cwe == (dc if dc == sc else "|".join(x for x in (dc, sc) if x) or None)
            else:
                assert cwe == (sc if s == "unsafe" else dc)


def test_enclosing_function(spark):
    place = "owner string, project string, version string, fpath string, sline int, scol int, eline int, ecol int"
    f = [("o", "p", "v", "f", 1, 0, 20, 1, "fn_dec", 0), ("o", "p", "v", "f", 3, 0, 10, 1, "fn_dec", 1), ("o", "p", "v", "f", 4, 0, 6, 1, "fn_exp", 0), ("o", "p", "v", "f", 30, 0, 40, 1, "fn_exp", 1)]
    r = [("o", "p", "v", "f", 5, 0, 5, 3, "unsafe", "h1"), ("o", "p", "v", "f", 31, 0, 32, 0, "safe", "h2"), ("o", "p", "v", "f", 90, 0, 91, 0, "safe", "h3"), ("o", "p", "v", "g", 5, 0, 5, 3, "safe", "h4")]
    regions, functions = spark.createDataFrame(r, place + ", label string, pair_hash string"), spark.createDataFrame(f, place + ", ftype string, ord int")
    found = {(x.sline, x.eline, x.ftype, x.label, x.pair_hash) for x in joins.enclosing_function(regions, functions).collect()}
    assert found == {(3, 10, "fn_dec", "unsafe", "h1"), (30, 40, "fn_exp", "safe", "h2")}


def test_line_diff_is_a_plain_diff(spark):
    a, b = "x\nold\n\nsame\ny", "x\nnew\nmore\n// note\nsame\ny"
    pairs = spark.createDataFrame([(1, "o", "p", "v1", "v2", "a.js", "a.js", a, b), (2, "o", "p", "v1", "v2", "b.js", "b.js", a, a)], "id long, owner string, project string, a_version string, b_version string, a_path string, b_path string, a_text string, b_text string")
    found = patches.line_diff(pairs).collect()
    assert sorted((r.version, r.sline, r.label) for r in found) == [("v1", 2, "unsafe"), ("v2", 2, "safe"), ("v2", 3, "safe")]
    assert len({r.pair_hash for r in found}) == 1 and {round(r.sim_ratio, 6) for r in found} == {round(1 - 3 / 11, 6)}
    (first, second) = sorted(patches.paired_snippets(pairs, context=0).collect())
    assert (first.vuln_snippet, first.fix_snippet) == ("old\n", "new\nmore\n// note") and second.vuln_snippet is None
    assert difflib.SequenceMatcher(None, a.split("\n"), b.split("\n")).ratio() > 0.5


def test_negatives_and_nulls(spark):
    df = spark.createDataFrame([(None,), ("renamed",), ("removed",), ("modified",)], "status string")
    assert {r.status for r in filters.drop_renamed_removed(df).collect()} == {None, "modified"}
    projects = spark.createDataFrame([("a/b",), (None,)], "commit_href string")
    assert filters.drop_projects(projects, ["^a/"]).count() == 1 and filters.drop_projects(projects, None).count() == 2
    with pytest.raises(ValueError):
        filters.max_pair_size(df, 3)
    with pytest.raises(ValueError):
        filters.attribute_filters(df.withColumn("sw_type", F.lit("x")), software_type="toaster")


def test_pairs_are_used_once(spark):
    v = spark.createDataFrame([(i, f"p{i % 3}", f"f{i % 4}") for i in range(30)], "id long, project string, file_path string")
    n = spark.createDataFrame([(f"p{i % 3}", f"s{i}", f"f{i % 5}", "Fix" if i % 7 else "aes x") for i in range(40)], "project string, sha string, file_path string, message string")
    found = rows.pair_negatives(v, n, 1, ["aes"]).collect()
    used = [(r.non_vuln_commit_hash, r.non_vuln_file_path) for r in found if r.non_vuln_commit_hash]
    assert len(found) == 30 and len(used) == len(set(used)) > 20
    assert all(r.file_path != r.non_vuln_file_path for r in found) and not any(int(s[1:]) % 7 == 0 for s, _ in used)
    with pytest.raises(ValueError):
        rows.augment(v, n, 0, 1)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11])
def test_splits_cover_all_rows(spark, n):
    df = spark.createDataFrame([(i, "safe" if i % 3 else "unsafe", f"t{i // 2}", f"h{i % 4}", "s") for i in range(n)], "id long, label string, text string, pair_hash string, project string")
    assert splits.split_random(df, 1).count() == splits.split_stratified(df, "project", 1).count() == splits.split_by_pair(df, 1).count() == n
    assert splits.k_fold_stratified(df, 3, ["label"], 1).filter("fold between 0 and 2").count() == n
    held = splits.split_disjoint(df, 1)
    texts = {s: {r.text for r in held.filter(F.col("split") == s).collect()} for s in ("train", "val", "test")}
    assert not texts["train"] & texts["test"] or any(len({r.label for r in df.filter(F.col("text") == t).collect()}) > 1 for t in texts["train"] & texts["test"])


def test_smote_bags_are_new(spark):
    bags = [(i, "unsafe" if i < 6 else "safe", ["a", "b", f"c{i % 3}"] * (1 + i % 2) + [f"x{i}"]) for i in range(30)]
    df = spark.createDataFrame(bags, "id long, label string, tokens array<string>")
    out = splits.smote_bags(df, 3).collect()
    made = [tuple(r.tokens) for r in out if r.id is None]
    assert len(made) == len(set(made)) > 0 and not {tuple(sorted(t)) for _, _, t in bags} & set(made)
    assert sum(r.label == "safe" for r in out) == 15 and sum(r.label == "unsafe" for r in out) <= 15


def test_metrics_and_models(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, predicted int")
    m = aggregates.confusion_metrics(df).first()
    assert (m.TN, m.FP, m.FN, m.TP, m.Acc, m.Recall) == (2, 1, 1, 1, 0.6, 0.5)
    assert aggregates.confusion_metrics(df.limit(0)).first().MCC == 0
    text = [(i, float(i % 2), "bad bad code" if i % 2 else "good fine code") for i in range(40)]
    data = spark.createDataFrame(text, "id long, label double, input string")
    made = models.with_features(data, models.count_features(data, 5))
    for model in (models.train_adaboost(made, 2), models.train_forest(made, grid={"numTrees": [3]}, folds=2)):
        assert models.evaluate(model, made, "m").first().Acc == 1
    for p in (1, 2):
        found = {r.id: r.prediction for r in models.knn_classify(made.filter("id < 30"), made.filter("id >= 30"), 3, "distance", p).collect()}
        assert found == {i: float(i % 2) for i in range(30, 40)}


def test_files(spark, tmp_path):
    (tmp_path / "npm").mkdir()
    osv = '{"id": "V1", "references": [{"url": "%s"}], "affected": [{"database_specific": {"cvss": %s, "cwes": [{"cweId": "CWE-79"}]}, "ranges": [{"type": "GIT", "repo": "https://github.com/o/p.git", "events": [{"introduced": "0"}, {"fixed": "%s"}]}]}]}'
    (tmp_path / "npm" / "a.json").write_text(osv % (BASE + ".patch", '{"score": 7.5}', SHA[::-1]))
    (tmp_path / "npm" / "b.json").write_text('{"id": "V2"}')
    found = {r.vuln_id: r for r in files.scan_osv_reports(spark, f"{tmp_path}/npm/*.json").collect()}
    assert (found["V1"].ecosystem, found["V1"].score, found["V1"].cwe_id) == ("npm", 7.5, ["CWE-79"]) and found["V1"].introduced is None and found["V2"].refs is None
    chain = commits_of(files.scan_osv_reports(spark, f"{tmp_path}/npm/*.json")).collect()
    assert {r.commit_sha for r in chain} == {SHA, SHA[::-1]} and {r.patch for r in chain} == {"MULTI"}
    stream = stream_osv_commits(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").start()
    stream.processAllAvailable()
    stream.stop()
    assert {r.commit_sha for r in spark.table("arrived").collect()} == {SHA, SHA[::-1]}
    (tmp_path / "r.sarif").write_text('{"runs": [{"results": [{"ruleId": "js/xss", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "o/p/v/a/b.js"}, "region": {"startLine": 3, "startColumn": 1, "endColumn": 9}}}]}, {"ruleId": "zz", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "o/p/v/x.py"}, "region": {"startLine": 1}}}]}]}]}')
    (row,) = files.scan_sarif(spark, f"{tmp_path}/r.sarif").collect()
    assert (row.owner, row.project, row.version, row.fpath, row.sline, row.eline, row.label) == ("o", "p", "v", "a/b.js", 3, 3, "CWE-79")
    (tmp_path / "c.txt").write_text("src/a.js_1_0_5_1 safe h ph a,1,b c,2,d\n")
    (row,) = files.scan_path_contexts(spark, f"{tmp_path}/c.txt").collect()
    assert (row.fpath, row.sline, row.label, row.context_paths) == ("src/a.js", "1", "safe", "a,1,b c,2,d")
    (tmp_path / "t.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        files.scan_table(spark, f"{tmp_path}/t.csv", "a string, b string")
    sizes = {r.size: (r.text, r.error) for r in files.scan_code_files(spark, f"{tmp_path}/*.txt", 5).collect()}
    assert all(text is None and error for text, error in sizes.values())
    (tmp_path / "mappings.yml").write_text("mappings:\n  extensions:\n    Go: [go]\n  bugs_framework:\n    d: {C: {Op: {79: t}}}\n  software_development:\n    19: {title: D, entries: {79: t}}\n  software_fault_pattern:\n    primary: {885: {title: R, clusters: {998: G}}}\n    secondary: {998: {title: G, entries: {79: t}}}\n")
    tables = lookups.load_lookups(spark, str(tmp_path))
    classed = joins.fault_cluster(joins.bug_class(spark.createDataFrame([("CWE-79",), (None,)], "cwe_id string"), tables["bug_class"]), tables["fault_cluster"]).collect()
    assert {(r.cwe_id, r.bf_class, r.sfp) for r in classed} == {("CWE-79", "C", "CWE-885: R"), (None, None, None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a // b\n", "safe", "train"), ("c", "unsafe", "test")], "input string, label string, split string")
    counts = lambda: read_code_jsonl(spark, f"{tmp_path}/j").groupBy("label").count().orderBy("label").collect()
    assert counts() == []
    assert write_code_jsonl(df, f"{tmp_path}/j") and write_code_jsonl(df, f"{tmp_path}/j")
    assert counts() == [(0, 2), (1, 2)]
    # A batch that is written again adds nothing, and one that fails in the middle nothing in part.
    assert write_code_jsonl(df, f"{tmp_path}/j", batch="b/1") and not write_code_jsonl(df, f"{tmp_path}/j", batch="b/1")
    broken = df.repartition(2).withColumn("input", F.when(F.col("label") == "safe", F.raise_error("stop")).otherwise(F.col("input")))
    with pytest.raises(Exception, match="stop"):
        write_code_jsonl(broken, f"{tmp_path}/j", batch="b/2")
    assert counts() == [(0, 3), (1, 3)]
    assert write_code_jsonl(df, f"{tmp_path}/j", batch="b/2") and counts() == [(0, 4), (1, 4)]
    write_splits(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").filter("split = 'test'").count() == 1
