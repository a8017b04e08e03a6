"""Many globs as one regex: the same paths, tried from their start alone."""

import re

from assaykit.functions import text as T
from assaykit.operators import joins
from assaykit.sources.roles import ROLES

PATHS = ("README.md", "a/README.md", "a/b/README.md", "xREADME.md", "a/tests/b.c", "main.tf", "a/x.graphql", "docs/architecture.md", "x/adr/1.md", "", "/", "a/", ".env", "a/.env.local")


def test_any_glob_fits_what_its_globs_fit():
    for globs in ROLES.values():
        for p in PATHS:
            assert bool(re.search(T.any_glob(globs), p)) == any(re.search(T.glob_regex(g), p) for g in globs), (globs, p)


def test_patterns_of_roles_start_with_their_only_anchor(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", joins.roles_of(joins.F.col("path"), ROLES).alias("roles"))
    for r in df.collect():
        assert r.roles == [role for role, globs in ROLES.items() if any(re.search(T.glob_regex(g), r.path) for g in globs)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "$|^" not in plan
