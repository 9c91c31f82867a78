import os

import duckdb
import pytest

from helpers import SF_SMALL
from tools.check_oracles import compare

import __spark_entry__ as entry

# A cross-section of the registry; every query runs in tools/check_oracles.py.
SAMPLE = ["clean_lines", "top_vocab", "kmeans_round3", "label_metrics", "alignment_greedy",
          "best_run", "lexicon_lemmatize"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "token", "n"]
    assert df.count() > 0


def test_registry_matches_oracles():
    qs, ors = entry.queries(), entry.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 60


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    from lexiclust.sources.tables import TABLES
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = duck.execute(entry.oracle_sql()[name])
    verdict = compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(),
                      [d[0] for d in res.description])
    assert verdict == "ok", verdict
