"""Repositories as a data source, and evaluations of a small one: its history, a change of it, its packs."""

import json
import os
import subprocess

import pytest

from assaykit import __main__ as cli
from assaykit.plans import evaluate
from assaykit.sources import tree

KEY = "AKIA" + "QRSTUVWXYZABCDEF"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(at), *a], check=True, capture_output=True)

    def put(path, text):
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_bytes(text if isinstance(text, bytes) else text.encode())

    run("init", "-q")
    put("README.md", f"# About\n\nkey = '{KEY}'\n")
    put("src/app/main.py", "import os\n\ndef run(a):\n    if a:\n        os.system(a)\n    return 1\n\ndef old():\n    return 2\n")
    put("tests/test_main.py", "def test_run():\n    assert 1\n")
    put(".gitignore", "out/\n*.log\n")
    put("third_party/x.py", "eval(a)\n")
    put(".env", "SECRET=1\n")
    put("bin.dat", b"\xff\xfe\x00")
    put("web/index.html", "<img src='a'>")
    run("add", "-f", ".")
    run("commit", "-qm", "first")
    put("src/app/main.py", "import os\n\ndef run(a):\n    if a:\n        os.system(a)\n    return 1\n")
    run("add", "-A")
    run("commit", "-qm", "fix: no old (#12)")
    put("out/a.py", "x = 1\n")
    put("a.log", "x\n")
    os.symlink("/etc", at / "link")
    return str(at)


def test_tree(spark, repo):
    tree.register(spark)
    rows = {r.path: (r.text, r.read_status) for r in spark.read.format("tree").load(repo).collect()}
    assert rows[".env"] == (None, "secret-bearing") and rows["bin.dat"] == (None, "not utf-8") and rows["web/index.html"] == ("<img src='a'>", "read")
    assert not any(p.startswith((".git/", "link")) for p in rows) and "src/app/main.py" in rows
    small = spark.read.format("tree").option("maxBytes", 5).option("levels", 0).load(repo)
    assert set(rows) == {r.path for r in small.collect()} and small.where("path = 'README.md'").first().read_status == "too large"
    some = lambda *globs: {r.path for r in spark.read.format("tree").option("globs", "\n".join(globs)).load(repo).collect()}
    assert some("src/**") == {"src/app/main.py"} and some("README.md", "tests/*.py", "no") == {"README.md", "tests/test_main.py"}
    assert some("**/*.py") == {p for p in rows if p.endswith(".py")} and some("none/**") == set()
    every = spark.read.format("tree").load(repo)
    assert every.join(every.where("path = 'README.md'").select("path"), "path", "left_anti").count() == len(rows) - 1
    with pytest.raises(Exception, match="no such directory"):
        spark.read.format("tree").load(repo + "/none").count()


def test_repository_leaves_out(spark, repo):
    files, others = tree.repository(spark, repo)
    paths = {r.path for r in files.collect()}
    assert not paths & {"out/a.py", "a.log", "third_party/x.py"} and "src/app/main.py" in paths
    assert {r.path for r in others.collect()} == {"third_party/x.py"}


def test_change(spark, repo):
    found = evaluate.evaluate(spark, repo, "changes", "HEAD", names=["security", "code-quality", "blast-radius", "change-risk", "requirement-fidelity"])
    got = {r.metric: r.value for r in found.score.metrics.collect()}
    assert got["public_symbols_removed"] == 1 and got["sink_hits_observed"] == 1
    why = {r.metric: r.abstain_reason for r in found.score.metrics.collect()}
    assert why["changed_files_in_churn_hotspots_share"] == why["high_reach_churn_hotspot_share"] == "too_few_commits"
    assert got["excerpts_observed"] >= 2 and got["evidence_lines_observed"] >= 6
    assert {r.path for r in found.narrow.collect()} == {"src/app/main.py"}
    quoted = {(r.unit, r.path, r.start, r.stop) for r in found.packs.excerpts.collect()}
    assert {("security", "src/app/main.py", 2, 7), ("code-quality", "src/app/main.py", 3, 6)} <= quoted


def test_project_and_packs(spark, repo, tmp_path, capsys):
    at = str(tmp_path / "packs")
    assert cli.main(["score", repo, "--dimensions", "reliability,security", "--evidence", at]) == 0
    said = json.loads(capsys.readouterr().out)
    assert {r["dimension"] for r in said["ratings"]} == {"reliability", "security"}
    lines = [r.value for r in spark.read.text(at + "/unit=reliability").collect()]
    assert json.loads(lines[0])["secrets"] == 1 and not any(KEY in x for x in lines) and any("README.md" in x for x in lines)


def test_optional_units(spark, repo):
    for text, there in (("", False), ("active_packs = ['frontend-a11y']\n", True)):
        with open(os.path.join(repo, evaluate.CONFIG), "w") as f:
            f.write(text)
        files = tree.repository(spark, repo)[0]
        own = evaluate.settings_of(files)
        assert ("frontend-a11y" in own.get("active_packs", ())) == there
    with open(os.path.join(repo, evaluate.CONFIG), "w") as f:
        f.write("other = 1\n")
    with pytest.raises(ValueError, match="unknown fields"):
        evaluate.settings_of(tree.repository(spark, repo)[0])
    os.remove(os.path.join(repo, evaluate.CONFIG))
    with pytest.raises(ValueError):
        evaluate.evaluate(spark, repo, "changes")
