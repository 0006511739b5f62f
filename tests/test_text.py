import unicodedata

from pyspark.sql import functions as F

from sonarloom.functions.text import compared


def test_compared_is_nfc_and_trimmed(spark):
    keys = [unicodedata.normalize("NFD", "누리고1") + " ", " é", "　a b ", "", None, "é", "﻿x"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(compared(F.col("k"))).collect()]
    assert got == [None if k is None else unicodedata.normalize("NFC", k).strip() for k in keys]
