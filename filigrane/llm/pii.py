"""Personal data: expressions propose spans, checksums confirm them, nearby words move the score."""
from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame

from filigrane.llm.common import base, id_out, map_arrow

#: Kinds in the order of results, and the words nearby that speak for or against each.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write", "reply"),
    "ip": ("ip", "host", "address", "server", "login", "from"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "payment", "cvv", "expires"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "transfer", "swift", "bic"),
    "ssn": ("ssn", "social", "security", "tax", "insurance"),
}
AGAINST = ("order", "version", "example", "sample", "test", "isbn", "part", "serial", "release", "build")

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN_SIGN = re.compile(r"\x20?[A-Z0-9]")
#: Lengths by country (ISO 13616 registry); a country that is not listed may have any of 15 to 34.
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
    "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,SA,SE,SK,TN,VG,RO 25:LY,PT,ST 26:IS,TR "
    "27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC "
    "33:RU").split()) for c in cs.split(",")}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
WORD = re.compile(r"[a-z-]+")
#: Characters on either side of a span that count as nearby.
NEAR = 48


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064: the first four characters go to the end, letters become 10 to 35, the remainder by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    done = at = 0  # a local part begins behind the last match and behind the last @, so each character is copied once
    while (at := text.find("@", at)) >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        at = done = m.end() if m else at + 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str):
    for m in CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() >= 13 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield m.span()


def _ibans(text: str):
    """From each start the end at the length of its country, or for countries not listed the shortest end, that is not
    inside a word and for which mod 97 holds; the scan goes on behind it, or behind a start that has none."""
    at = 0
    while m := IBAN.search(text, at):
        at = end = m.end()
        code = m[0]
        least = IBAN_LENGTHS.get(code[:2], 15)
        most = IBAN_LENGTHS.get(code[:2], 34)
        while len(code) < most and (sign := IBAN_SIGN.match(text, end)):
            end = sign.end()
            code += text[end - 1]
            after = text[end:end + 1]
            if len(code) >= least and not (after.isascii() and after.isalnum()) and mod97(code):
                yield m.start(), end
                at = end
                break


def _ssns(text: str):
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in the order of KINDS, then start. Ends are exclusive, positions are code points.
    A span that a checksum or a range test has confirmed starts at 0.7, any other at 0.5; a word nearby that speaks for
    the kind adds 0.2, one that speaks against it takes 0.2 away. Social security numbers have no checksum and need a
    word for them. Spans of the four base kinds stay whatever their score."""
    found = [("email", a, b, 0.5) for a, b in _emails(text)]
    found += [("ip", *m.span(), 0.7) for m in IP.finditer(text) if all(map(_small, m.groups()))]
    found += [("card", a, b, 0.7) for a, b in _cards(text)]
    found += [("phone", a, b, 0.5) for a, b in _phones(text)]
    found += [("iban", a, b, 0.7) for a, b in _ibans(text)]
    found += [("ssn", a, b, 0.4) for a, b in _ssns(text)]
    out = []
    for kind, a, b, score in found:
        words = set(WORD.findall(text[max(0, a - NEAR):a].lower())) | set(WORD.findall(text[b:b + NEAR].lower()))
        score += 0.2 * any(w in words for w in CONTEXT[kind]) - 0.2 * any(w in words for w in AGAINST)
        if kind in BASE_KINDS or score >= 0.5:
            out.append((kind, a, b, round(score, 2)))
    return out


def _scan(batches):
    for b in batches:
        out = []
        for t in b.column(1):
            t = t.as_py()
            out.append([{"kind": k, "start": s, "end": e, "score": p, "found": t[s:e]} for k, s, e, p in spans(t)])
        yield {"_id": b.column(0), "spans": out}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of kind, start, end, score and the text found, one row per row of docs.

    Each text is scanned on its own in one pass, so there is no shuffle. Null and empty texts give an empty array, a
    null id stays null, repeated rows give repeated results, empty input gives an empty result."""
    out = map_arrow(base(docs, id_col, text_col), _scan,
                    "_id long, spans array<struct<kind:string,start:long,end:long,score:double,found:string>>")
    return out.select(id_out(), "spans")
