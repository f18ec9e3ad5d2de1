"""Text of references and abstracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# TeX commands whose argument is plain text, and spellings of the sign %.
MARKUP = ("emph", "textbf", "textit", "texttt", "mbox")
PERCENT = ("per cent", "percent", "%")


def normalised(text: Column) -> Column:
    """An abstract as one compares it, whether it comes from TeX or not: lower case, without markup and signs of mathematics, with single spaces (also for ~), digits
    grouped by a bare comma, and % for all its spellings, with no space before it."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[\s~]+", " "))
    bare = F.regexp_replace(spaced, r"\$|\\(?=%)", "")
    words = F.regexp_replace(bare, rf"\\(?:{'|'.join(MARKUP)})\{{([^}}]*)\}}", "$1")
    grouped = F.regexp_replace(words, r"(?<=\d)\{,\}(?=\d)", ",")
    signs = "|".join(p if p == "%" else rf"\b{p}\b" for p in PERCENT)
    return F.trim(F.regexp_replace(F.regexp_replace(grouped, rf" *(?:{signs})", "%"), " +", " "))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def cited(tex: Column) -> Column:
    """Sorted distinct keys of all commands \\cite, \\citep and \\citet, starred or not, with notes in brackets or not."""
    lists = F.regexp_extract_all(tex, F.lit(r"\\cite[pt]?\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1))
    keys = F.transform(F.split(F.array_join(lists, ","), ","), lambda k: F.trim(k))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


# What may follow a family name.
SUFFIXES = ("jr", "jr.", "sr", "sr.", "ii", "iii", "iv")
_PERSON = rf"^([A-Z]\.(?: \S+)*?) (\S+)(?: ((?i:{'|'.join(s.replace('.', r'[.]') for s in SUFFIXES)})))?$"


def bibliography_name(shown: Column) -> Column:
    """A person, who is shown with initials first, under the family name, what follows it between commas. Any other name is an institution's, which braces keep whole.

    The name is read as given names, family name and suffix by one pattern; single spaces are expected.
    """
    given, family, suffix = (F.regexp_extract(shown, _PERSON, k) for k in (1, 2, 3))
    return F.when(family == "", F.format_string("{%s}", shown)).otherwise(F.concat_ws(", ", family, F.nullif(suffix, F.lit("")), given))


def bibliography_names(shown: Column) -> Column:
    """Names as they are shown, as the author field of an entry has them. Commas, semicolons, ampersands and the word `and` stand between names, remarks in round brackets go, and
    a last `et al.` is the name `others`."""
    commas = F.translate(F.regexp_replace(shown, r"\([^)]*\)", ""), "&;", ",,")
    commas = F.regexp_replace(F.regexp_replace(commas, r"(?i)\bet al\b\.?\s*$", ",others"), r"(?i)\band\b", ",")
    names = F.filter(F.transform(F.split(commas, ","), lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))), lambda n: n != "")
    last = F.size(names) - 1
    return F.array_join(F.transform(names, lambda n, i: F.when((i == last) & (F.lower(n) == "others"), "others").otherwise(bibliography_name(n))), " and ")


def entry(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    """A bibliography entry, a field a line; fields that are null or empty are left out."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), v, F.lit("},"))) for name, v in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",")), *lines, F.lit("}"))


def escaped(text: Column) -> Column:
    """The characters &, %, # and _, which TeX reads as commands, escaped."""
    return F.regexp_replace(text, "([&%#_])", r"\\$1")


# Kinds of entries, by what their venue contains (whole words between bars), in order of precedence, and the field in which each names its venue.
VENUES = (
    ("book", ("textbook", "isbn")),
    ("techreport", ("nasa", "ntrs", "report", "technical")),
    ("misc", ("|rfc|", "|iau|", "astm", "codata", "standard")),
    ("article", ("journal", "transactions", "trans.", "review", "letters", "|nature|", "pnas", "geophys", "acta", "astronom", "env.", "environmental", "|j.|", "doi")),
)
VOLUME = (r"\d+\s*\(\d+\)", r"\d+:\d+")
VENUE_FIELDS = {"article": "journal", "book": "publisher", "techreport": "institution", "misc": "howpublished"}
NO_LINK = "Cited by reference; no online link."


def _contains(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", "[.]").replace("|", r"\b") for w in words)


def entry_type(venue: Column) -> Column:
    """The first kind whose words the venue contains; volume and number or pages make it an article too; misc otherwise, also of null."""
    out = F.when(F.lit(False), "misc")
    for kind, words in VENUES:
        volume = f"|{'|'.join(VOLUME)}" if kind == "article" else ""
        out = out.when(venue.rlike(f"(?i){_contains(words)}{volume}"), kind)
    return out.otherwise("misc")


def source_entry(key: Column, title: Column, shown: Column, year: Column, venue: Column, url: Column) -> Column:
    """A source as an entry: its venue in the field that its kind has for it, and a note where there is no link. Titles keep their capitals."""
    kind, linked = entry_type(venue), F.coalesce(url, F.lit("")) != ""
    venues = {field: F.when(kind == k, escaped(venue)) for k, field in VENUE_FIELDS.items()}
    fields = {"title": F.concat(F.lit("{"), escaped(title), F.lit("}")), "author": escaped(bibliography_names(shown)), "year": escaped(year.cast("string"))}
    return entry(kind, key, fields | venues | {"url": url, "note": F.when(~linked, NO_LINK)})


def days_or_never(days: Column) -> Column:
    return F.when(days.isNull(), "never").otherwise(F.format_string("%.0f d (%.2f y)", days, days / 365.25))


def rate_or_unbounded(rate: Column) -> Column:
    return F.when(rate == F.lit(float("inf")), "unbounded").otherwise(F.format_string("%.1f", rate))
