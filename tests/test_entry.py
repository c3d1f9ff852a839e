"""The driver contract: entry runs on sf0.001, every oracle has a query."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "final_xp" in df.columns


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def test_entry_without_the_optional_subpackage():
    """Without ``stridekit.llm`` and the pipeline the other queries are still there."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys; sys.modules['stridekit.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 80 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)
