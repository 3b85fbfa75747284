"""The driver's three functions."""

import os
import re
import subprocess
import sys

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    # iterative or per-row algorithms without a statement; those on text corpora have tests of their own
    without = {q for q in set(queries) - set(oracles) if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert without == {"t1_train_vocabulary", "t2_encode", "r6_fit_classifier", "e12_rouge_l"}


def test_corpus_part_may_be_missing():
    """Without the corpus operators the other queries are still there."""
    code = (
        "import sys; sys.modules['wirecorpus.llm'] = None; import __spark_entry__ as e; "
        "assert e.CORPUS is None and 'b2_decode_headers' in e.queries() and 'pipeline' not in e.queries()"
    )
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.split for r in rows} <= {"train", "test"} and len(rows) == 10


def test_staged_tables_can_be_dropped(spark):
    from wirecorpus import session

    session.drop_staged(spark)
    rows = session.stage(spark.range(10))
    assert rows.count() == 10 and session.drop_staged(spark) == 1 and session.drop_staged(spark) == 0
