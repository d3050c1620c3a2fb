"""Scores against values derived from the rules by hand."""

import pytest
from pyspark.sql import functions as F

from coffer.functions import password as pw
from coffer.model import PasswordOptions, Result

KNOWN = {
    "": (0, 0.0), "   ": (0, 0.0), "abc": (0, 0.0), "abcdefgh": (0, 0.0), "aaaaaaaaaa": (0, 12.5), "bcdbcd": (0, 13.5), "zyx321": (0, 15.85), "in 1999 x": (1, 25.86), "password123": (1, 37.39),
    "aBc1dE!gHi": (1, 42.95), "Password1!": (1, 44.62), "anyPassword!123": (3, 71.93), "IntegrationP@ss1": (4, 92.39), "TestP@ssw0rd!Str0ng": (4, 93.78), "Kj9$mP2!xL7&nQ4#wR8@": (4, 100.0),
}


def test_scores(spark):
    df = spark.createDataFrame([(k,) for k in [*KNOWN, None]], "p string")
    rows = {r["p"]: (r["strength"], r["score"]) for r in pw.analysed(F.col("p"), df).collect()}
    assert rows.pop(None) == (0, 0.0)
    assert rows == KNOWN


def test_runs(spark):
    row = spark.createDataFrame([("aaabbbbc",)], "s string").select(pw.repetition_penalty(F.col("s"))).first()
    assert row[0] == 4.5


def test_generated():
    out = pw.generate(50, PasswordOptions.UPPERCASE | PasswordOptions.NUMBERS | PasswordOptions.EXCLUDE_SIMILAR)
    assert len(out) == 50 and not set(out) & set(pw.SIMILAR + pw.LOWERCASE)
    for args in ((0, PasswordOptions.NUMBERS), (5, PasswordOptions.NONE), (5, PasswordOptions.EXCLUDE_SIMILAR)):
        with pytest.raises(ValueError):
            pw.generate(*args)


def test_result_invariants():
    r = Result(False, 2.0, 100, 1, 4)
    assert (r.failed, r.success_rate, r.partial, r.bytes_per_second, r.files_per_second) == (3, 0.25, True, 50.0, 0.5)
    assert Result(True).success_rate == 0
    for bad in ({"processed": 2, "total": 1}, {"elapsed": -1.0}, {"total_bytes": -1}):
        with pytest.raises(ValueError):
            Result(True, **bad)
