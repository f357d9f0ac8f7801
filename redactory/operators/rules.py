"""What counts as sensitive: one rule a pattern, in the order in which findings arise.

The patterns, word lists and labels below are fixed values: results depend on them letter by letter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from redactory.functions import checks

PHONE_WORDS = ["phone", "mobile", "cell", "call me", "contact", "number is", "reach me", "ring", "text me", "sms", "fax"]
DOB_WORDS = ["born", "dob", "d.o.b", "date of birth", "birthday", "birthdate", "b-day"]
MONEY_WORDS = ["salary", "revenue", "profit", "invoice", "payment", "income", "wage", "turnover", "earn", "paid", "bonus", "valuation", "fee"]
BSB_WORDS = ["bsb", "bank", "branch", "account", "acct"]
ACCOUNT_WORDS = ["account", "acct", "a/c", "bsb", "bank", "savings", "transfer"]
INTRO_PHRASES = ["my name is", "name is", "i am", "i'm", "im ", "call me", "i'm called", "my name's", "this is", "i go by"]
NAME_STOPWORDS = [
    "Hi", "Hello", "Dear", "Thanks", "Thank", "Kind", "Best", "The", "This", "That", "My", "Please", "Could", "Would", "Should", "Date", "Tax", "File",
    "Her", "His", "Their", "Our", "Your", "Its",
]
NOT_NAMES = [
    "medicare", "tfn", "abn", "acn", "bsb", "licence", "license", "passport", "visa", "ssn", "pension", "centrelink", "ndis", "ihi", "ahpra",
    "number", "card", "id", "identifier", "corp", "corporation", "inc", "incorporated", "ltd", "limited", "pty", "plc", "llc", "llp", "lp", "group",
    "holdings", "partners", "associates", "solutions", "services", "industries", "technologies", "enterprises", "consulting", "management",
    "financial", "capital", "ventures", "global",
]
IDENTIFIER_TYPES = ["PHONE", "EMAIL", "ADDRESS", "DOB", "MEDICARE", "TFN", "PASSPORT", "LICENCE", "CREDIT_CARD", "BANK_ACCOUNT", "BSB", "GPS", "ABN", "ACN"]
MASKABLE_TYPES = [*IDENTIFIER_TYPES, "MONEY", "PASSWORD", "NAME_PII"]
_STREETS = "St|Street|Rd|Road|Ave|Avenue|Dr|Drive|Ln|Lane|Ct|Court|Pl|Place|Cres|Crescent|Blvd|Boulevard|Hwy|Highway|Pde|Parade|Tce|Terrace|Way|Cl|Close"
_STATES = "NSW|VIC|QLD|WA|SA|TAS|ACT|NT"
_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
LICENCE = r"(?i)\b(?:driver'?s?\s*licen[cs]e|licen[cs]e\s*(?:no\.?|number|#)?)\s*[:#]?\s*([A-Z0-9]{6,9})\b"
SECRET = r"(?i)\b(?:password|passwd|pwd|passcode|pass(?:phrase)?|login|credentials?|api[\s_-]?key|secret(?:\s*key)?|token|auth)\b\s*(?:is|=|:)\s*(\S{4,})"
BANK_CONTEXT = r"(?i)\b(bank|account holder|savings account)\b"


def near(d, words: list[str], window: int) -> str:
    """Whether a word stands within so many characters of the match ``x``, as a part of a word or not."""
    first = f"greatest(x.s - {window}, 0)"
    cut = f"substring(t, CAST({first} + 1 AS INT), CAST(x.s + length(x.m) + {window} - {first} AS INT))"
    return d.matches(f"lower({cut})", "|".join(w.replace(".", r"\.") for w in words))


def digits(d, s: str = "x.m") -> str:
    if d.name == "spark" and s == "x.m":
        return "x.d"  # taken once a match, see detect
    return d.replace_all(s, "[^0-9]", "''")


def trimmed(d, s: str = "x.m") -> str:
    return d.replace_all(s, r"^\s+|\s+$", "''")


@dataclass(frozen=True)
class Rule:
    """In value, start, severity and keep, ``x.m`` and ``x.s`` are the match and where it starts, ``t`` is the text."""

    name: str
    type: str
    label: str
    pattern: str
    severity: Callable = lambda d: "'medium'"
    keep: Callable = lambda d: "true"
    value: Callable = trimmed
    start: Callable = lambda d: "x.s"


def _high(d):
    return "'high'"


def _whole(d):
    return "x.m"


def _national(d):
    return f"(CASE WHEN {digits(d)} LIKE '61%' THEN concat('0', substring({digits(d)}, 3)) ELSE {digits(d)} END)"


def _secret(d):
    return d.replace_all(d.extract("x.m", SECRET, 1), r"[.,;:!?]+$", "''")


def _token(d):
    return d.replace_all(d.extract("x.m", r"^\s?(\S{8,64})", 1), r"[.,;:!?]+$", "''")


def _strong(d):
    has = " AND ".join(d.matches(_token(d), p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return f"NOT {d.matches(_token(d), '(?i)^https?://')} AND NOT {d.matches(_token(d), '[@/]')} AND {has}"


RULES = [
    Rule("credit_card", "CREDIT_CARD", "Credit/debit card number", r"\b(?:\d[ -]?){13,19}\b", _high, lambda d: f"length({digits(d)}) BETWEEN 13 AND 19 AND {checks.luhn(d, digits(d))}"),
    Rule("medicare", "MEDICARE", "Medicare number", r"\b(?:[2-6]\d{3})[\s-]?(?:\d{5})[\s-]?(?:\d)(?:[\s/-]?(?:\d))?\b", _high, lambda d: checks.medicare(d, f"substring({digits(d)}, 1, 10)")),
    Rule("tfn", "TFN", "Tax File Number", r"\b(?:\d{3})[\s-]?(?:\d{3})[\s-]?(?:\d{2,3})\b", _high, lambda d: f"{checks.tfn(d, digits(d))} AND ({near(d, ['tfn', 'tax file'], 20)} OR {d.matches('x.m', r'[\s-]')})"),
    Rule("abn", "ABN", "Australian Business Number", r"\b(?:\d{2})\s?(?:\d{3})\s?(?:\d{3})\s?(?:\d{3})\b", keep=lambda d: f"({checks.abn(d, digits(d))} OR {near(d, ['abn'], 15)})"),
    Rule("acn", "ACN", "Australian Company Number", r"\b(?:\d{3})\s?(?:\d{3})\s?(?:\d{3})\b", keep=lambda d: near(d, ["acn", "company number"], 15)),
    Rule("passport", "PASSPORT", "Passport number", r"\b(?:[A-Z]{1,2}\d{7,8})\b", _high, value=_whole),
    Rule("licence", "LICENCE", "Driver licence number", LICENCE.replace("([", "(?:["), _high, value=lambda d: d.extract("x.m", LICENCE, 1)),
    Rule("bsb", "BSB", "Bank BSB", r"\b\d{3}-\d{3}\b", lambda d: f"(CASE WHEN {near(d, BSB_WORDS, 25)} THEN 'high' ELSE 'medium' END)", value=_whole),
    Rule("bank_account", "BANK_ACCOUNT", "Bank account number", r"\b\d{6,10}\b", _high, lambda d: near(d, ACCOUNT_WORDS, 25), _whole),
    Rule("gps", "GPS", "GPS coordinates", r"[-+]?\d{1,2}\.\d{4,}\s*,\s*[-+]?\d{2,3}\.\d{4,}", _high),
    Rule("email", "EMAIL", "Email address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", value=_whole),
    Rule("phone_au", "PHONE", "Phone number", r"(?:\+?61|\b0)(?:[\s.-]?\d){9}\b", keep=lambda d: d.matches(_national(d), "^0[2-9][0-9]{8}$")),
    Rule("phone_service", "PHONE", "Phone number", r"\b(?:1[389]00[\s.-]?\d{3}[\s.-]?\d{3})\b"),
    Rule("phone_ctx", "PHONE", "Phone number", r"\b(?:\d[\d\s.\-()\[\]]{5,18}\d)\b", keep=lambda d: f"length({digits(d)}) BETWEEN 7 AND 12 AND {near(d, PHONE_WORDS, 45)}"),
    Rule(
        "address", "ADDRESS", "Physical address",
        rf"\b(?:\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})?\s+(?:[A-Z][a-zA-Z]+\s+){{1,3}}(?:{_STREETS})\b\.?(?:,?\s+[A-Z][a-zA-Z]+){{0,2}}(?:\s+(?:{_STATES}))?(?:\s+\d{{4}})?)", _high,
    ),
    Rule("dob_written", "DOB", "Date of birth", rf"(?i)\b(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?\s+(?:{_MONTHS})\.?\s+(?:19|20)\d\d\b", keep=lambda d: near(d, DOB_WORDS, 25)),
    Rule("dob_numeric", "DOB", "Date of birth", r"\b(?:0?[1-9]|[12]\d|3[01])[/.-](?:0?[1-9]|1[0-2])[/.-](?:19|20)\d\d\b", keep=lambda d: near(d, DOB_WORDS, 25)),
    Rule(
        "money", "MONEY", "Financial amount", r"\$\s?\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\$\s?\d{4,}(?:\.\d{1,2})?",
        keep=lambda d: f"{d.number(d.replace_all('x.m', '[^0-9.]', chr(39) * 2))} > 1000 AND {near(d, MONEY_WORDS, 40)}",
    ),
    Rule("money_verbal", "MONEY", "Financial amount", r"(?i)\$\s?\d+(?:\.\d+)?\s*(?:million|billion|trillion)\b"),
    Rule(
        "confidential", "CONFIDENTIAL", "Confidential / restricted",
        r"(?i)\b(?:confidential|do not (?:share|forward|distribute)|internal use only|internal only|private and confidential|non-disclosure|nda|proprietary|classified|not for distribution)\b", value=_whole,
    ),
    Rule(
        "business", "BUSINESS_CONFIDENTIAL", "Confidential business data",
        r"(?i)\b(?:annual\s+)?(?:revenue|turnover|arr|mrr|profit|ebitda|valuation|gross margin|net income|client list|customer list)\b[^.\n]{0,40}",
    ),
    Rule(
        "health", "HEALTH", "Health / medical information",
        r"(?i)\b(?:medicare(?:\s*(?:card|number))?|diagnos(?:ed|is)|prescrib(?:ed|tion)|prescription|medication|dosage|\d+\s?mg\b|symptoms?|cancer|diabet(?:es|ic)|depression|anxiety|bipolar|schizophreni\w*|hiv|aids|pregnan\w*|chemotherapy|therapy|psychiatr\w*|mental health|blood test|medical (?:record|history|condition))\b",
        value=_whole,
    ),
    Rule(
        "legal", "LEGAL", "Legal / court information",
        r"(?i)\b(?:lawsuit|litigation|court (?:case|order|reference)|case\s*(?:no\.?|number)\s*[:#]?\s*[A-Z0-9][A-Z0-9/-]{2,}|settlement agreement|legal proceedings|subpoena|plaintiff|defendant)\b",
    ),
    Rule(
        "immigration", "IMMIGRATION", "Immigration / visa details",
        r"(?i)\b(?:visa\s*subclass\s*\d{3}|subclass\s*\d{3}|visa(?:\s*(?:application|status|number))?|immigration|permanent residency|work permit|bridging visa|citizenship application|sponsorship|green card)\b",
    ),
    Rule(
        "password_kw", "PASSWORD", "Password / credential", SECRET.replace(r"(\S{4,})", r"\S{4,}"), _high, value=_secret,
        start=lambda d: f"x.s + {d.position('x.m', d.extract('x.m', SECRET, 1))} - 1",
    ),
    Rule("password_token", "PASSWORD", "Possible password", r"(?:^|\s)\S{8,64}", _high, _strong, _token, lambda d: f"x.s + {d.position('x.m', _token(d))} - 1"),
    Rule("name", "NAME_PII", "Full name (with other PII)", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", value=_whole, keep=lambda d: _is_name(d)),
]


def _is_name(d):
    first, second = d.extract("x.m", "^([A-Za-z]+)", 1), d.extract("x.m", "([A-Za-z]+)$", 1)
    quoted = lambda ws: ", ".join(d.text(w) for w in ws)
    return f"{first} NOT IN ({quoted(NAME_STOPWORDS)}) AND lower({first}) NOT IN ({quoted(NOT_NAMES)}) AND lower({second}) NOT IN ({quoted(NOT_NAMES)})"


#: Why each type matters, for reports.
REASONS = {
    "NAME_PII": "A full name with another personal detail identifies a person directly.",
    "DOB": "A date of birth is used to verify identity.",
    "PASSPORT": "A passport number is a government identity document.",
    "LICENCE": "A driver licence number can be used to impersonate someone.",
    "MEDICARE": "A Medicare number is a sensitive government health identifier.",
    "TFN": "A tax file number enables serious identity fraud.",
    "CREDIT_CARD": "Card numbers are financial credentials.",
    "BSB": "A BSB with an account number enables transfers.",
    "BANK_ACCOUNT": "Bank account details can be used for debits.",
    "MONEY": "A specific amount in context can be commercially or personally sensitive.",
    "PHONE": "A phone number is tied to a person's identity.",
    "EMAIL": "An email address identifies a person and links to accounts.",
    "ADDRESS": "An address reveals where someone lives.",
    "GPS": "Coordinates reveal an exact location.",
    "ABN": "An ABN identifies a business.",
    "ACN": "An ACN identifies a company.",
    "CONFIDENTIAL": "The text is marked as confidential or restricted.",
    "BUSINESS_CONFIDENTIAL": "The text looks like confidential business data.",
    "HEALTH": "Health information is protected personal data.",
    "LEGAL": "Legal or court information is confidential.",
    "IMMIGRATION": "Immigration details are sensitive government records.",
    "PASSWORD": "The text looks like a credential.",
}
