"""Romanisation of Greek and Cyrillic, and what stays of other scripts."""

import pytest
from pyspark.sql import functions as F

from capstan.functions import text

WORDS = {
    "Ångela": "Angela", "Jürgen Straße": "Jurgen Strasse", "Łukasz Żak": "Lukasz Zak", "Œuvre Æon": "OEuvre AEon", "Москва": "Moskva", "Чайковский": "Cajkovskij", "Щёлково, Юрий": "Selkovo, Urij",
    "объект": 'ob"ekt', "Київ": "Kiiv", "Αθήνα": "Athena", "Λόγος": "Logos", "Ουρανός": "Ouranos", "άγγελος": "angelos", "Ευρώπη": "Europe", "αϋπνία": "aypnia", "Άγκυρα": "Ankyra", "ψυχή": "psyche", "Ψυχή": "Psyche",
    "ΦΩΣ": "PhOS", "Σφίγξ": "Sphinx", "日本 x": " x", "a\tb\nc": "abc", "": "", None: "",
}


def test_to_ascii(spark):
    rows = spark.createDataFrame([(k,) for k in WORDS], "x string").select("x", text.to_ascii(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == WORDS


@pytest.mark.parametrize("x", ["plain", "naïve café", "日本"])
def test_other_text_is_not_romanised(spark, x):
    assert spark.createDataFrame([(x,)], "x string").select(text.romanise(F.col("x"))).first()[0] == x
