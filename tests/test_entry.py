import subprocess
import sys

import pytest

from tests.conftest import REPO

HIDE = """
import sys, warnings
warnings.simplefilter("ignore")
for name in {names!r}:
    sys.modules[name] = None
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sum(n[:2] == "op" or n == "pipeline" for n in e.queries()))
"""


def counts(*names):
    out = subprocess.run([sys.executable, "-c", HIDE.format(names=names)], cwd=REPO, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


@pytest.mark.parametrize("missing", ["gneiss.llm", "corpus_pipeline", "public_tokenizers", "xxhash", "gneiss.llm.lines"])
def test_core_queries_without_the_text_operators(missing):
    everything, own = counts(), counts(missing)
    assert own[0] >= 200 and own[1] <= own[0] <= everything[0]
    if missing.startswith(("gneiss", "corpus")):
        assert own[2] == 0
