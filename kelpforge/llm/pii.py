"""Personal data by anchors: an Aho-Corasick automaton finds at-signs, schemes, digits and cues; local parsers expand and validate."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm.common import lean
BASE_KINDS = ("email", "ip", "card", "phone")
#: What the method adds: addresses behind a scheme, account numbers behind a cue or with valid check digits, keys and passwords behind a cue or of a known form, postal addresses.
KINDS = (*BASE_KINDS, "url", "account", "secret", "address")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account number", "account no", "acct", "routing number", "ssn", "social security number", "passport", "passport number", "tax id", "kontonummer", "steuernummer", "reisepass", "sozialversicherungsnummer",
        "numéro de compte", "numéro de sécurité sociale", "passeport", "número de cuenta", "número de la seguridad social", "pasaporte")
SECRET_CUES = ("token", "secret", "password", "passwd", "passphrase", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "credential", "bearer",
               "passwort", "kennwort", "schlüssel", "zugangscode", "mot de passe", "jeton", "clé", "contraseña", "clave")
#: Beginnings of keys by which their issuers can be told, and the form of each.
SECRET_FORMS = {"AKIA": r"AKIA[0-9A-Z]{16}", "ASIA": r"ASIA[0-9A-Z]{16}", "ghp_": r"ghp_[A-Za-z0-9]{36}", "gho_": r"gho_[A-Za-z0-9]{36}", "github_pat_": r"github_pat_[A-Za-z0-9_]{40,}", "glpat-": r"glpat-[A-Za-z0-9_-]{20,}", "sk_live_": r"sk_live_[A-Za-z0-9]{20,}",
                "xoxb-": r"xoxb-[A-Za-z0-9-]{20,}", "xoxp-": r"xoxp-[A-Za-z0-9-]{20,}", "AIza": r"AIza[A-Za-z0-9_-]{35}", "eyJ": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "-----BEGIN ": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"}
STREETS_BEHIND = ("Street", "St.", "Avenue", "Ave.", "Road", "Rd.", "Boulevard", "Blvd.", "Lane", "Drive")
STREETS_WITHIN = ("straße", "strasse", "weg", "platz", "allee")
STREETS_BEFORE = ("rue", "avenue", "boulevard", "Rue", "Avenue", "Boulevard", "calle", "Calle", "avenida", "Avenida", "plaza", "Plaza")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_FOUR = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[a-z]+://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"'`]*)?")
_GAP = re.compile(r"[\s:#=.-]{0,4}(?:is\s)?", re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SECRET_GAP = re.compile(r"[\"']?\s{0,3}(?:[:=]|=>|:=)\s{0,3}[\"'`]?", re.ASCII)
_SECRET = re.compile(r"[A-Za-z0-9_+/=.~!#$%&*-]{8,}")
_FORMS = {k: re.compile(v) for k, v in SECRET_FORMS.items()}
_TOWN = r"(?:,? (?:[A-ZÀ-Ý][\w'-]+ ?){1,3})?(?:,? ?[A-Z]{2} [0-9]{5}(?:-[0-9]{4})?)?"
_HOUSE_BEFORE = re.compile(r"[0-9]{1,5}[a-z]?,? (?:[A-Z][\w'-]*\.? ){1,4}$")
_STREET_BEFORE = re.compile(r"(?: (?:de|des|du|del|la|las|los|l'|d'|le))* ?(?:[A-ZÀ-Ý][\w'-]+ ?){1,4}")
_NUMBER_BEHIND = re.compile(r",? (?:n[.º°o]* ?)?[0-9]{1,4}[a-z]?\b")
_POST_TOWN = re.compile(r",? ?[0-9]{5} [A-ZÀ-Ý][\w'-]+")
_TOWN_BEHIND = re.compile(_TOWN)
_ACCOUNT = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(text: str) -> bool:
    """Check digits of an international account number."""
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at + 1)
    return (start, m.end(), True) if m and start < at else None


def _card(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    m = _DIGITS.match(text, at)
    if not m:
        return None
    digits = m[0].replace(" ", "").replace("-", "")
    return at, m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    m = _PHONE.match(text, at)
    return (at, m.end(), 8 <= sum(c.isdigit() for c in m[0]) <= 15) if m else None


def _url(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    m = _URL.match(text, at)
    if not m:
        return None
    end = at + len(m[0].rstrip(".,;:!?)]}"))
    return at, end, "." in text[at:end]


def routing(digits: str) -> bool:
    """Check digit of a bank's routing number in the United States."""
    return len(digits) == 9 and sum(int(d) * w for d, w in zip(digits, (3, 7, 1) * 3, strict=True)) % 10 == 0


def social_security(digits: str) -> bool:
    """Numbers that are given out in the United States: nine digits, no part all 0, and areas below 900 but 666."""
    return len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def nir(digits: str) -> bool:
    """A French social security number, with its key or without."""
    return len(digits) == 13 or len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


#: What the digits behind some cues must fulfil; those behind other cues have no check digits, or several kinds of them.
CHECKS: dict[str, Callable[[str], bool]] = {"iban": lambda digits: False, "routing number": routing, "ssn": social_security, "social security number": social_security, "numéro de sécurité sociale": nir}
_LONGEST_CUE = max(map(len, CHECKS))


def _account(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: just behind a cue."""
    start = _GAP.match(text, at).end()
    if (m := _IBAN.match(text, start)) and iban(m[0]):
        return start, m.end(), True
    m = _ACCOUNT.match(text, start)
    if not m:
        return None
    cue = text[max(0, at - _LONGEST_CUE) : at].lower()
    check = next((f for c, f in CHECKS.items() if cue.endswith(c)), None)
    return start, m.end(), check is None or check("".join(filter(str.isdigit, m[0])))


def _secret(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: just behind a cue. A value that is said to be it, of letters and digits of many kinds."""
    gap = _SECRET_GAP.match(text, at)
    m = gap and _SECRET.match(text, gap.end())
    if not m:
        return None
    value = m[0].rstrip(".!&*")
    return m.start(), m.start() + len(value), len(value) >= 8 and len(set(value)) >= 5 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _issued(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: where a key of a known form may begin."""
    for start, form in _FORMS.items():
        if text.startswith(start, at) and (m := form.match(text, at)):
            return at, m.end(), True
    return None


def _us_address(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: just behind a street's kind; a house number and the street's name stand before it."""
    word = max(text.rfind(" ", floor, at - 1) + 1, floor)
    m = _HOUSE_BEFORE.search(text, max(floor, word - 60), word)
    if not m or (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in ".,-+")) or (at < len(text) and text[at].isalnum()):
        return None
    return m.start(), _TOWN_BEHIND.match(text, at).end(), True


def _german_address(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: just behind the end of a street's name, which begins with a capital and has its number behind it."""
    number = _NUMBER_BEHIND.match(text, at)
    start = at
    while start > max(floor, at - 40) and (text[start - 1].isalpha() or text[start - 1] == "-"):
        start -= 1
    if not number or not text[start].isupper() or at - start < 6:
        return None
    town = _POST_TOWN.match(text, number.end())
    return start, town.end() if town else number.end(), True


def _romance_address(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: just behind rue, calle and the like: a number stands before (French) or behind the name (Spanish)."""
    name = _STREET_BEFORE.match(text, at)
    if not name or not name[0].strip():
        return None
    word = max(text.rfind(" ", floor, at) + 1, floor)
    before = re.search(r"(?<![0-9.,+-])[0-9]{1,4}(?: ?(?:bis|ter))?,? $", text[max(floor, word - 12) : word])
    end = at + len(name[0].rstrip())
    behind = _NUMBER_BEHIND.match(text, end)
    if behind:  # the number stands where Spanish has it
        before, end = None, behind.end()
    elif not before:
        return None
    town = _POST_TOWN.match(text, end)
    return max(floor, word - 12) + before.start() if before else word, town.end() if town else end, True


#: By kind: the parser, and whether it starts at the anchor (else just behind it).
PARSERS: dict[str, tuple[Callable[[str, int, int], tuple[int, int, bool] | None], bool]] = {
    "email": (_email, True),
    "card": (_card, True),
    "phone": (_phone, True),
    "url": (_url, True),
    "account": (_account, False),
    "secret": (_secret, False),
    "issued": (_issued, True),
    "us": (_us_address, False),
    "german": (_german_address, False),
    "romance": (_romance_address, False),
}
#: The kind of span that a parser of another name finds.
FOUND_AS = {"issued": "secret", "us": "address", "german": "address", "romance": "address"}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, (1, ("ip", "card")))
    a.add_word("@", (1, ("email",)))
    a.add_word("+", (1, ("phone",)))
    for s in SCHEMES:
        a.add_word(s, (len(s), ("url",)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize(), c.title()}:
            a.add_word(form, (len(form), ("account",)))
    for c in SECRET_CUES:
        for form in {c, c.upper(), c.capitalize(), c.title()}:
            a.add_word(form, (len(form), ("secret",)))
    for parser, words in (("issued", SECRET_FORMS), ("us", STREETS_BEHIND), ("german", STREETS_WITHIN), ("romance", STREETS_BEFORE)):
        for c in words:
            a.add_word(c, (len(c), (*a.get(c, (0, ()))[1], parser)))  # Avenue is English and French
    a.make_automaton()
    return a


def find_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed in KINDS, then start. For each kind, leftmost and without overlap: an anchor inside the last match, kept or dropped, is passed over."""
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    floor = dict.fromkeys(KINDS, 0)
    for last, (length, kinds) in anchors.iter(text):
        at = last - length + 1
        for name in kinds:
            kind = FOUND_AS.get(name, name)
            if at < floor[kind]:
                continue
            if kind == "ip":  # the whole run of dotted numbers at once
                run = _DOTTED.match(text, at).end()
                floor[kind] = run
                for m in _FOUR.finditer(text, at, run):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        found[kind].append((kind, *m.span()))
                continue
            parse, here = PARSERS[name]
            got = parse(text, at if here else last + 1, floor[kind])
            if got:
                floor[kind] = got[1]
                if got[2]:
                    found[kind].append((kind, got[0], got[1]))
            elif kind == "card":
                floor[kind] = at + 1
    return [s for k in KINDS for s in found[k]]


_anchors = []


def _shared_automaton():
    """Once per Python process."""
    if not _anchors:
        _anchors.append(automaton())
    return _anchors[0]


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans of every whole text, in code points, by kind as listed in KINDS and then start.

    A null text is an empty one and has no spans; rows that repeat stay as they are; an empty table gives no rows.
    Other columns of docs are ignored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _shared_automaton()
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py() or "", a)] for t in part["_text"]]
                yield pa.RecordBatch.from_arrays([part["_id"], pa.array(spans, _SPANS)], names=[id_col, "spans"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(find), f"{id_col} {kind}, spans {SPANS}")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at, until = [], 0, 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= until:
            out += [text[at:start], f"[{kind.upper()}]"]
        until = max(until, end)
        at = until
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced by the kind in brackets; all other columns, and null texts, stay as they are."""
    place = docs.columns.index(text_col)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _shared_automaton()
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t.as_py() for t in part.column(place)]
                new = pa.array([t and redacted(t, find_spans(t, a)) for t in texts], part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(lean(redact), docs.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_private: spans of all kinds but url, which need not be personal."""
    d = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    private = F.size(F.filter("spans", lambda s: s["kind"] != "url")).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    digest = F.sha2(F.encode(_listed(base), "UTF-8"), 256)
    return d.select("doc_id", *counts[: len(BASE_KINDS)], digest.alias("base_sha256"), _listed(F.col("spans")).alias("spans"), private.alias("n_private"), *counts[len(BASE_KINDS) :])
