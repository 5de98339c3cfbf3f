import subprocess
import sys

import pytest


@pytest.mark.parametrize("missing", ["xxhash", "treeloom.llm", "corpus_pipeline"])
def test_entry_without_an_optional_module(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine' in q and 'pipeline' not in q; assert 'knn_cosine' in e.oracle_sql() and set(e.oracle_sql()) <= set(q)"
    if missing != "corpus_pipeline":
        code += "; assert not any(k.startswith('op') and k[2].isdigit() for k in q)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
