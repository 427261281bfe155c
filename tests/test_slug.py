import pytest
from pyspark.sql import functions as F

from quirelight.functions import text as X
from quirelight.operators import settings as S

# As in the reference's list, written out here on their own.
LETTERS = {
    "a": "àáâãäåā", "c": "çćč", "e": "èéêëēęě", "i": "ìíîïī", "n": "ñńň", "o": "òóôõöøō", "u": "ùúûüūů", "y": "ýÿ", "ss": "ß", "ae": "æ", "oe": "œ",
    "l": "ł", "s": "śš", "z": "źżž", "r": "ř", "t": "ť", "d": "ď",
}
PAIRS = [(letter, plain) for plain, letters in LETTERS.items() for letter in letters]


def test_letters():
    assert len(PAIRS) == 52 and all(S.plain_slug(f"x{a}x {a.upper()}", "none") == f"x{b}x-{b}" for a, b in PAIRS)


@pytest.mark.parametrize("tail", ["", " Čeština, Łódź! " * 40])
def test_slug_column(spark, tail):
    rows = spark.createDataFrame([(k, f"x{a}x{tail}") for k, (a, _) in enumerate(PAIRS)], "k int, text string")
    end = "-cestina-lodz" * 40 if tail else ""
    assert {r.k: r.slug for r in rows.select("k", X.slug(F.col("text")).alias("slug")).collect()} == {k: f"x{b}x{end}" for k, (_, b) in enumerate(PAIRS)}
