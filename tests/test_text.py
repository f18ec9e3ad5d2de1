"""Names, abstracts, citations and entries, case by case."""

import pytest
from pyspark.sql import functions as F

from kelpforge.functions import text


def shown(spark, f, *values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in d.orderBy("i").select(f(F.col("v"))).collect()]


def test_names(spark):
    got = {
        "A. Nicholson": "Nicholson, A.", "R. A. Freitas Jr.": "Freitas, Jr., R. A.", "J. von Neumann": "Neumann, J. von", "W. Smith IV": "Smith, IV, W.", "W. Smith iii": "Smith, iii, W.", "B. Sr": "Sr, B.",
        "International Astronomical Union": "{International Astronomical Union}", "NASA": "{NASA}", "A.": "{A.}", "a. lower": "{a. lower}", "Ab. Two": "{Ab. Two}",
    }
    assert dict(zip(got, shown(spark, text.bibliography_name, *got), strict=True)) == got


def test_several_names(spark):
    got = {
        "A. One & B. Two": "One, A. and Two, B.", "A. One; B. Two, C. Three and D. Four": "One, A. and Two, B. and Three, C. and Four, D.", "A. One (Univ. of X, and Y), B. Two (eds.)": "One, A. and Two, B.",
        "A. One et al.": "One, A. and others", "A. One, B. Two, et al": "One, A. and Two, B. and others", "A. One and others": "One, A. and others", "A.  One\tET AL.": "One, A. and others", "Sandia Labs": "{Sandia Labs}",
        "A. Anderson": "Anderson, A.", ", & ;": "", "": "", "Others and A. One": "{Others} and One, A.",
    }
    assert dict(zip(got, shown(spark, text.bibliography_names, *got), strict=True)) == got
    assert shown(spark, text.bibliography_names, None) == [None]


def test_abstracts(spark):
    same = [r"We find \emph{About}  12\,\% of $N = 200{,}000$", r"we find about 12\, percent of n = 200,000", "WE find~about 12\\,  per cent\nof n = 200,000 ", r"we \textbf{find} about 12\, % of n = 200,000"]
    assert set(shown(spark, text.normalised, *same)) == {r"we find about 12\,% of n = 200,000"}
    assert shown(spark, text.normalised, "percentage of perCent {,} 1{,}2", "", None) == ["percentage of% {,} 1,2", "", None]


def test_citations(spark):
    tex = r"\cite{b, a} \citep[p. 3][x]{c} \citet*{a,,d} \citeauthor{no} \cite*{e} \nocite {f} \cite{}"
    assert shown(spark, text.cited, tex, "", None) == [["a", "b", "c", "d", "e"], [], None]


@pytest.mark.parametrize(
    ("venue", "kind"),
    [
        ("A textbook in a journal", "book"), ("ISBN 1-2", "book"), ("NASA Technical Memorandum", "techreport"), ("Report of a journal", "techreport"), ("RFC 9171", "misc"), ("surfconf", "misc"), ("IAU resolution B2", "misc"), ("CODATA 2018", "misc"),
        ("Nature", "article"), ("Signature notes", "misc"), ("Acta Astronautica", "article"), ("J. Br. Interplanet. Soc.", "misc"), ("Proc. 12 (3)", "article"), ("pp 33:104", "article"), ("web page", "misc"), ("", "misc"), (None, "misc"),
    ],
)
def test_kinds(spark, venue, kind):
    assert shown(spark, text.entry_type, venue) == [kind]


def test_entries(spark):
    rows = [("k1", "On 5% & more", "A. One et al.", 2001, "Journal of X", "http://a_b"), ("k2", "T", "NASA", 1980, "NASA report #1", None), ("k3", "T", "B. Two", 1999, None, "")]
    d = spark.createDataFrame(rows, "k string, t string, a string, y int, v string, u string").orderBy("k")
    got = [r[0] for r in d.select(text.source_entry(*[F.col(c) for c in "ktayvu"])).collect()]
    assert got == [
        "@article{k1,\n  title = {{On 5\\% \\& more}},\n  author = {One, A. and others},\n  year = {2001},\n  journal = {Journal of X},\n  url = {http://a_b},\n}",
        "@techreport{k2,\n  title = {{T}},\n  author = {{NASA}},\n  year = {1980},\n  institution = {NASA report \\#1},\n  note = {Cited by reference; no online link.},\n}",
        "@misc{k3,\n  title = {{T}},\n  author = {Two, B.},\n  year = {1999},\n  note = {Cited by reference; no online link.},\n}",
    ]
