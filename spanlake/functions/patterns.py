"""The pattern table, and its form for each regex engine.

Patterns are kept in ECMAScript form, whose word boundary is ASCII and whose white space is Unicode. Java and RE2 differ
in one or the other, so each form is derived by a rule.
"""

from __future__ import annotations

# The categories and their labels, and the patterns in their order, which breaks ties between matches.
CATEGORIES = [
    ("PERSON", "Person"),
    ("ORGANIZATION", "Organization"),
    ("LOCATION", "Location"),
    ("ADDRESS", "Address"),
    ("SSN", "SSN"),
    ("CREDIT_CARD", "Credit Card"),
    ("EMAIL", "Email"),
    ("PHONE", "Phone"),
    ("DATE", "Date"),
]
PATTERNS = [
    ("SSN", "", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"),
    ("CREDIT_CARD", "", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("EMAIL", "", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", "", r"(?:\+?1[-.\s]?)?\(\d{3}\)[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("PHONE", "", r"(?:\+?1[-.\s])?\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("DATE", "", r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:\d{4}|\d{2})\b"),
    ("DATE", "", r"\b\d{4}[/-](?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])\b"),
    ("DATE", "i", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+(?:0?[1-9]|[12]\d|3[01]),?\s+\d{4}\b"),
    ("DATE", "i", r"\b(?:0?[1-9]|[12]\d|3[01])\s+(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s*,?\s*\d{4}\b"),
    ("ADDRESS", "i", r"\b\d{1,5}\s+(?:[A-Z][a-zA-Z]*\.?\s+){1,4}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct|Place|Pl|Terrace|Ter|Circle|Cir|Highway|Hwy|Parkway|Pkwy)\.?\b"),
    ("ADDRESS", "i", r"\bP\.?\s*O\.?\s*Box\s+\d+\b"),
]
# Model types and the categories they stand for.
MODEL_TYPES = {
    "PERSON": "PERSON",
    "ORGANIZATION": "ORGANIZATION",
    "LOCATION": "LOCATION",
    "ADDRESS": "ADDRESS",
    "STREET_ADDRESS": "ADDRESS",
    "MAILING_ADDRESS": "ADDRESS",
    "DATE": "DATE",
    "ACCOUNT_NUMBER": "SSN",
    "USERNAME": "PERSON",
    "PASSWORD": "SSN",
    "ID_NUMBER": "SSN",
    "SSN": "SSN",
    "CREDIT_CARD": "CREDIT_CARD",
    "EMAIL": "EMAIL",
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE": "PHONE",
    "PHONE_NUMBER": "PHONE",
}

#: ECMAScript white space and line ends, as members of a character class.
SPACE_JAVA = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE_RE2 = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD = "[A-Za-z0-9_]"
_EITHER = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def _spaces(pattern: str, members: str) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(members if inside else f"[{members}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


def java(pattern: str, flags: str = "") -> str:
    """The pattern for Java: a boundary is one-sided where its neighbour can only be a word character."""
    out = _spaces(pattern, SPACE_JAVA)
    head, tail = out.startswith(r"\b"), out.endswith(r"\b")
    body = out[2 * head : len(out) - 2 * tail]
    if head:
        body = (_EITHER if body.startswith("[A-Za-z0-9._%+-]") else f"(?<!{_WORD})") + body
    if tail:
        body += _EITHER if body.endswith(r"\.?") else f"(?!{_WORD})"
    return ("(?i)" if "i" in flags else "") + body


def re2(pattern: str, flags: str = "") -> str:
    return ("(?i)" if "i" in flags else "") + _spaces(pattern, SPACE_RE2)
