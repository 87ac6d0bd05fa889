"""The entry module without the corpus operators or what they need."""

import subprocess
import sys

from .conftest import ROOT


def queries_without(*blocked):
    code = f"import sys; sys.modules.update({{x: None for x in {blocked!r}}}); import __spark_entry__ as e; print(len(e.queries()), *sorted(e.queries())[:3], any(x.startswith('op') for x in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), out[-1]


def test_the_core_loads_without_optional_packages():
    import __spark_entry__ as entry
    from basketlens.plans import QUERIES

    assert queries_without("ahocorasick") == queries_without("basketlens.llm") == (len(QUERIES), "False")
    assert len(entry.queries()) >= len(QUERIES)
