import pytest
from pyspark.sql import functions as F

from lexiclust.functions import text as ft
from lexiclust.operators import text as tx

from helpers import lines_df

ODD = ["plain words only", "mail a.b-c+d@host.example.org now", "see http://x.y/z?q=1 and www.site.mk, ok",
       "\uff57\uff57\uff57.full\uff0ecom \uff20 a\uff20b.cd", "tab\t\u00a0\u2003nbsp\x1cfs -- dash", " \u3000 ", "", None,
       "@", "a://b", "Ѓорѓи — К\u0301 ﬁne №5", "é!è,ê ¿ñ?", "x" * 30 + "@" + "y." * 5 + "z"]


@pytest.mark.parametrize("keep", [ft.REFERENCE_KEEP_CLASS, ft.UNICODE_KEEP_CLASS, "[^a-z]+"])
def test_normalised_as_step_by_step(spark, keep):
    raw = F.col("raw")
    s = F.coalesce(ft._nfkc_udf(raw), raw)
    for pattern in (ft.URL_PATTERN, ft.EMAIL_PATTERN, keep, r"\s+"):
        s = F.regexp_replace(s, "(?U)" + pattern, " ")
    rows = lines_df(spark, ODD).select("raw", ft.normalize_text(raw, keep_class=keep).alias("got"),
                                       F.lower(F.trim(s)).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_lines_are_normalised_once(spark):
    """The rejected lines' group went by a filter that was moved below the aggregation,
    with the whole normalisation."""
    out = tx.clean_lines(lines_df(spark, ["a line that is long enough", "short", "", None,
                                          "a line that is LONG enough!", "\uff41nother line of full length"]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted((r.line_pos, r.text) for r in out.collect()) == [
        (0, "a line that is long enough"), (5, "another line of full length")]
