import importlib.util

import __spark_entry__ as entry


def test_catalogue(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    has_llm = importlib.util.find_spec("quantavol.llm") is not None and importlib.util.find_spec("quantavol.llm").has_location
    assert has_llm == any(n.startswith("op1_") for n in q)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["z", "entropy", "n_bytes", "bpp", "mse", "psnr", "mae"] and df.count() == 500
