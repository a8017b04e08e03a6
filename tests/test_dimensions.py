import json

import pytest

from assaykit import __main__ as cli
from assaykit.plans import dimensions
from assaykit.sources import corpus


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    files = {
        "README.md": "# A",
        "src/a.py": "import os\nos.system(x)\nfor i in y:\n    session.query(i)\nprice: float = 1\n",
        "tests/test_a.py": "def test_a():\n    assert 1\n",
        "tests/fixtures/p.json": '{"ssn": "123-45-6789"}',
        "web/index.html": "<img src=a><img alt='' src=b><input>",
        "db/migrations/1.sql": "DROP TABLE a;\n",
        "uv.lock": "",
        "LICENSE": "x",
        "package.json": "{}",
        "Dockerfile": "FROM x",
    }
    for path, text in files.items():
        p = at / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(at)


def test_all_dimensions(spark, root):
    result = dimensions.combined(spark, corpus.files(spark, root).cache())
    got = {(r.dimension, r.metric): r.value for r in result.metrics.collect()}
    assert got["security", "sink_hits_observed"] == 1 and got["security", "cookie_flags_missing_observed"] is None
    assert got["reliability", "queries_in_loops_observed"] == 1 and got["finance", "float_money_observed"] == 1
    assert got["healthcare", "phi_values_in_test_data_observed"] == 1 and got["frontend-a11y", "images_without_alt_observed"] == 1
    assert got["frontend-a11y", "form_controls_without_label_observed"] == 1 and got["data", "destructive_migration_ops_observed"] == 1
    assert got["test-strategy", "assertion_density_per_test"] == 1
    ratings = {r.dimension: r for r in result.ratings.collect()}
    assert ratings["security"].value == 59 and ratings["security"].available == 85
    assert dimensions.discover(spark).count() == len(dimensions.DIMENSIONS)


def test_a_failure_stays_alone(spark, root):
    def boom(spark, files):
        raise RuntimeError("no")

    some = {"finance": dimensions.DIMENSIONS["finance"], "data": dimensions.Dimension("data", "x", (), boom)}
    ratings = {r.dimension: r for r in dimensions.combined(spark, corpus.files(spark, root), dimensions=some).ratings.collect()}
    assert ratings["data"].reason_code == "dimension_failed" and ratings["finance"].value == 0
    with pytest.raises(ValueError, match="bogus"):
        dimensions.combined(spark, corpus.files(spark, root), ["bogus"])


def test_command_line(spark, root, capsys, tmp_path):
    assert cli.main(["score", root, "--dimensions", "finance,data"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["schema_version"] == 1 and {r["dimension"] for r in said["ratings"]} == {"finance", "data"}
    assert cli.main(["report", root, "--dimensions", "finance", "--out", str(tmp_path / "r.html")]) == 0
    assert "<h2>ratings</h2>" in (tmp_path / "r.html").read_text()
