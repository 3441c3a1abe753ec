"""Operators whose shuffles or memory once grew faster than their input."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.functions import code
from patchloom.operators import contexts, joins, patches, splits
from patchloom.plans import queries_files
from patchloom.sources import files
from patchloom.streaming.advisories import commits_of


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_of_vectors_without_structure_meets_plain_blocks(spark, monkeypatch):
    chosen = []
    real = splits._flat_is_less
    monkeypatch.setattr(splits, "_flat_is_less", lambda *given: chosen.append(real(*given)) or chosen[-1])
    rng = np.random.default_rng(1)
    loose = rng.normal(size=(1500, 24))
    tight = np.repeat(rng.normal(size=(30, 24)) * 1000, 50, axis=0) + loose
    for x in (loose, tight):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
        found = {}
        for r in splits.nearest(rows, 3).collect():
            found.setdefault(r.a, {})[r.place] = r.b
        for i in range(0, 1500, 37):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            assert [found[i][k] for k in (1, 2, 3)] == np.lexsort((np.arange(len(d)), d))[:3].tolist()
    assert chosen == [True, False]


def test_short_hashes_never_meet_a_whole_repo(spark):
    shas = [f"{i:03x}{j:02x}" + f"{i * 7 + j:035x}" for i in range(20) for j in range(6)]
    commits = spark.createDataFrame([(f"r{i % 2}", s) for i, s in enumerate(shas)], "repo string, sha string")
    asked = [(i, f"r{i % 2}", s[: i % 41]) for i, s in enumerate(shas)] + [(1000, "r0", "fff"), (1001, "r9", "00"), (1002, "r0", shas[0])]
    out = joins.expand_short_sha(spark.createDataFrame(asked, "id long, repo string, sha string"), commits)
    known = {repo: [s for i, s in enumerate(shas) if f"r{i % 2}" == repo] for repo in ("r0", "r1", "r9")}
    wanted = {(i, repo, min(full)) for i, repo, s in asked if (full := [k for k in known[repo] if k.startswith(s)])}
    assert set(map(tuple, out.select("id", "repo", "sha").collect())) == wanted
    met = [line for line in _plan(out).splitlines() if "Join" in line]
    assert met and all("sha#" in line.split("=", 1)[1] or "head_#" in line for line in met)


def test_diff_blocks_shuffles_nothing(spark):
    diff = "x\n--- a/src/a.js\n+++ b/src/b.js\n--- a/c.js\nno\n--- a/d.js"
    out = patches.diff_blocks(spark.createDataFrame([(1, diff), (2, None), (3, "+++ b/e.js")], "id long, diff string"), ["js"])
    assert "Window" not in _plan(out)
    assert [tuple(r) for r in out.collect()] == [(1, 1, "src/a.js", "src/b.js")]


def test_memory_of_a_task_does_not_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    place = {"owner": "o", "project": "p", "version": "v"}
    rows = [place | {"fpath": f"f{i}", "sline": i, "scol": 0, "eline": i + 1, "ecol": 1} for i in range(200)]
    schema = "owner string, project string, version string, fpath string, sline int, scol int, eline int, ecol int"
    labels = spark.createDataFrame([r | {"label": "CWE-1" if i % 2 else "safe", "sfp": "s"} for i, r in enumerate(rows)], schema + ", label string, sfp string")
    out = joins.attach_cwe(spark.createDataFrame(rows, schema), labels)
    assert "RepartitionByExpression [owner" in _plan(out) and ", 20" in _plan(out)
    assert {r.fpath: r.cwe for r in out.collect()} == {f"f{i}": "CWE-1" if i % 2 else None for i in range(200)}


def test_regions_meet_one_small_block(spark):
    file = "owner string, project string, version string, fpath string, sline int, scol int, eline int, ecol int, "
    bounds = [(1, 200), *[(i, i + w) for i in range(2, 60, 10) for w in (0, 3, 8)]]
    f = spark.createDataFrame([("o", "p", "v", "f", a, 0, b, 9, "fn_dec", n) for n, (a, b) in enumerate(bounds)], file + "ftype string, ord int")
    r = spark.createDataFrame([("o", "p", "v", "f", i, 1, i, 2, f"l{i}", "h") for i in range(1, 200, 3)], file + "label string, pair_hash string")
    out = joins.enclosing_function(r, f)
    wanted = {(f"l{i}", *max((n, a, b) for n, (a, b) in enumerate(bounds) if a <= i <= b)[1:]) for i in range(1, 200, 3)}
    assert {(x.label, x.sline, x.eline) for x in out.collect()} == wanted
    assert "[6,8]" in _plan(out)


def test_contexts_of_a_long_row_reach_python_in_parts(spark):
    df = spark.createDataFrame([(1, [f"w{i},p,w{i % 3}" for i in range(250)]), (2, []), (3, None)], "id long, contexts array<string>")
    vocab = spark.createDataFrame([("word", "w1", 1), ("path", "p", 1)], "kind string, term string, n long")
    out = contexts.context_membership(df, vocab)
    assert "slice(" in _plan(out)
    assert [(r.pos, r.context, r.is_full) for r in out.orderBy("pos").collect()] == [(i, f"w{i},p,w{i % 3}", i == 1) for i in range(250)]


def _report(*uris):
    return {"runs": [{"results": [{"ruleId": '"}{[', "locations": [{"physicalLocation": {"artifactLocation": {"uri": u}, "region": {"startLine": 7}}}]} for u in uris]}, {"results": [{"ruleId": "x"}]}]}


def test_small_reports_are_parsed_where_they_are_read(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"{i}.sarif").write_text(json.dumps(_report(f"o/p/v/a{i}.js", f"o/p/v/b{i}.js"), indent=i))
    found = lambda df: sorted((r.fpath, r.sline, r.label) for r in df.collect())
    out = files.scan_sarif(spark, str(tmp_path))
    assert "Window" not in _plan(out) and "Aggregate" not in _plan(out) and "Repartition" not in _plan(out)
    wanted = sorted((f"{c}{i}.js", 7, "unsafe") for c in "ab" for i in range(3))
    assert found(out) == wanted
    monkeypatch.setattr(files, "WHOLE_BYTES", 0)
    assert found(files.scan_sarif(spark, str(tmp_path))) == wanted


@pytest.mark.parametrize("whole", [0, 8 << 20])
def test_files_that_are_no_json_keep_their_whole_elements(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(files, "WHOLE_BYTES", whole)
    text = json.dumps(_report("o/p/v/a.js", "o/p/v/b.js"))
    (tmp_path / "cut.sarif").write_text(text[: text.index("b.js")])
    (tmp_path / "marked.sarif").write_text("\ufeff" + text.replace(".js", "1.js"))
    (tmp_path / "more.sarif").write_text(text.replace(".js", "2.js") + " }")
    (tmp_path / "blank.sarif").write_text(" \n")
    found = {r.fpath for r in files.scan_sarif(spark, str(tmp_path)).collect()}
    assert found == {"a.js", "a1.js", "b1.js", "a2.js", "b2.js"}


def test_reports_are_dealt_out_once(spark, small, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 500)
    plans = []
    real = queries_files._stored
    monkeypatch.setattr(queries_files, "_stored", lambda s, values, *rest, **more: plans.append(values._jdf.queryExecution().executedPlan().toString()) or real(s, values, *rest, **more))
    queries_files.scan_sarif(spark, small)
    assert plans[0].count("Exchange") == 1 and "REPARTITION_BY_NUM" in plans[0] and "l_orderkey" in plans[0].split("Exchange")[1].split("Scan")[0]


def test_references_and_hunks_are_cut_once(spark):
    url = f"https://github.com/o/p/commit/{'ab12' * 10}"
    df = spark.createDataFrame([(1, [f"{url}.patch,", "x"]), (2, ["https://example.com/a"]), (3, None), (4, [f"{url}.patch"])], "id long, refs array<string>")
    out = commits_of(df)
    joined = out.join(spark.createDataFrame([(url[-40:],)], "commit_sha string"), "commit_sha")
    plan = _plan(joined)
    # The pattern of a commit's URL, of a hash in it and of what stands before it: each in one place.
    assert [plan.count(p) for p in ("(/commit/|/commits/)", "{5,40}", "{6,40}", "/commits?/")] == [1, 1, 1, 1]
    assert {(r.id, r.commit_href, r.commit_sha) for r in out.collect()} == {(1, url, url[-40:]), (4, url, url[-40:])}
    assert out.columns == ["id", "refs", "code_refs", "commits", "chain", "patch", "commit_href", "project", "commit_sha"]

    patch = "@@ -1,2 +1,2 @@ f\n-a\n+b\n c\n@@ -9 +9 @@\n d\n+e"
    hunks = spark.createDataFrame([(patch,), ("no header",), (None,)], "patch string").select(code.hunk_lines(F.col("patch")).alias("h"))
    assert _plan(hunks).count("@@ .* @@") == 2  # the headers, and what is between them
    assert [r.h and (r.h.deleted, r.h.added) for r in hunks.collect()] == [([1], [1, 10]), ([], []), None]


def test_tasks_of_commit_files_grow_with_rows(spark, small, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 500)
    plans = []
    real = queries_files._stored
    monkeypatch.setattr(queries_files, "_stored", lambda s, values, *rest, **more: plans.append(values._jdf.queryExecution().executedPlan().toString()) or real(s, values, *rest, **more))
    rows = sum(spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("orders", "lineitem"))
    found = queries_files.scan_commits(spark, small)
    for key in ("o_orderkey", "f"):
        assert re.search(rf"hashpartitioning\({key}#\d+L, {-(-rows // 500)}\), REPARTITION_BY_NUM", plans[0])
    assert plans[0].count("Exchange hashpartitioning") == 3
    assert found.count() == spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
