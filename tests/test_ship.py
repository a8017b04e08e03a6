"""What goes to the workers holds all that the package reads, seen from a worker that has nothing else."""

import os
import subprocess
import sys
from types import SimpleNamespace

from assaykit.functions.ship import ship
from assaykit.operators import markup
from assaykit.sources import registry

ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from assaykit.operators import code, lexer, markup
from assaykit.sources import registry
assert lexer.__file__.startswith(sys.argv[1])
print(repr((registry.fields(), markup.values())))
"""


def test_the_shipped_package_reads_its_rule_files(tmp_path):
    sent = []
    ship(SimpleNamespace(sparkContext=SimpleNamespace(addPyFile=sent.append)))
    done = subprocess.run([sys.executable, "-c", ALONE, sent[0]], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == repr((registry.fields(), markup.values()))
