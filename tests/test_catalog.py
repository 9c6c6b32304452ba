"""Every query of the catalog against its SQL, on the smallest tables."""

import pytest
from oracle_check import same

from brindle.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    same(spark, catalog.queries()[name], SQL[name], SF)


def test_every_query_without_sql_is_known():
    assert set(catalog.queries()) - set(SQL) == {"codec_fidelity", "index_search", "quantizer_cosine"}


def test_index_search_finds_the_query_itself(spark):
    rows = catalog.queries()["index_search"](spark, SF).collect()
    assert len(rows) == 10 and all(r["verified"] for r in rows) and [r["rank"] for r in rows] == list(range(1, 11))


def test_more_bits_follow_the_exact_ranking_better(spark):
    from brindle.plans.roundtrips import codec_fidelity

    r = {(x["codec"], x["row_bytes"]): x for x in codec_fidelity(spark, SF, 800, 256, 40).collect()}
    for size in (64, 128, 256):
        assert r["levels", size]["rho"] > r["sign", size]["rho"] and r["levels", size]["recall10"] > r["sign", size]["recall10"]


def test_decoded_levels_correlate(spark):
    assert catalog.queries()["quantizer_cosine"](spark, SF).first()["corr"] > 0.98


def test_entry_imports_without_llm():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['brindle.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(k[:2] == 'op' and k[2:3].isdigit() for k in q); print(len(q))"
    p = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert p.returncode == 0 and int(p.stdout) > 60, p.stderr
