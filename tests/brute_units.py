"""A plain reading of quantities, one text at a time, to hold the operator against."""

import re
import unicodedata
from decimal import Decimal

WON = {"": 1, "천": 10**3, "만": 10**4, "백만": 10**6, "십억": 10**9, "억": 10**8, "천억": 10**11, "조": 10**12}
EN = {"": 1, "m": 10**6, "mn": 10**6, "million": 10**6, "bn": 10**9, "billion": 10**9, "tn": 10**12, "trillion": 10**12}


def clean(s):
    s = unicodedata.normalize("NFKC", s)
    return re.sub("[−△▲]", "-", s).strip()


def unit(u):
    u = re.sub(r"\s|단위|[()\[\]:]", "", u)
    for words, quantity, one in (("원", "krw", 1), ("달러", "usd", 1), ("명", "people", 1), ("주", "shares", 1), ("톤", "mass", 1000)):
        if u.endswith(words) and u[:-1 if len(words) == 1 else -2] in WON:
            return quantity, WON[u[: -len(words)]] * one
    m = re.fullmatch(r"(KRW|₩|USD|US\$|\$)(\w*)", u)
    if m and m[2] in EN:
        return ("krw" if m[1] in ("KRW", "₩") else "usd"), EN[m[2]]
    if u in WON and u:
        return "krw", WON[u]
    table = {"%": ("rate", 100), "%p": ("rate", 100), "퍼센트": ("rate", 100), "‰": ("rate", 10), "bp": ("rate", 1), "bps": ("rate", 1), "kWh": ("energy", 1), "MWh": ("energy", 10**3), "GWh": ("energy", 10**6), "TWh": ("energy", 10**9), "kg": ("mass", 1), "t": ("mass", 1000), "kt": ("mass", 10**6), "개월": ("duration", 1), "년": ("duration", 12), "yr": ("duration", 12)}
    return table.get(u)


def number(s):
    s = s.strip()
    neg = s.startswith("-") or s.startswith("(")
    d = re.sub(r"[-(),\s]", "", s)
    return (-1 if neg else 1) * Decimal(d) if re.fullmatch(r"\d+(\.\d+)?", d) else None


def quantity(s, default=None):
    s = clean(s)
    m = re.fullmatch(r"(-?)(\d+)년\s*(\d+)개월", s)
    if m:
        return "duration", (-1 if m[1] else 1) * (int(m[2]) * 12 + int(m[3]))
    m = re.fullmatch(r"(-?)(\d+)조\s*([\d,]+)억\s*원?", s)
    if m:
        return "krw", (-1 if m[1] else 1) * (int(m[2]) * 10**12 + int(m[3].replace(",", "")) * 10**8)
    m = re.fullmatch(r"(KRW|₩|USD|US\$|\$)\s*([-(]?[\d.,]+\)?)\s*([a-z]*)", s) or re.fullmatch(r"(?P<x>-)(KRW|₩|USD|US\$|\$)\s*([\d.,]+)\s*([a-z]*)", s)
    if m:
        g = m.groups()
        sign = -1 if g[0] == "-" else 1
        c, n, e = g[-3:]
        q, f = unit(c + e)
        return q, int(sign * number(n) * f)
    m = re.fullmatch(r"([-(]?[\d.,]+\)?)\s*(.*)", s)
    if not m or number(m[1]) is None:
        return None
    u = unit(m[2]) if m[2] else (unit(clean(default)) if default else None)
    return (u[0], int((number(m[1]) * u[1]).to_integral_value())) if u else None


def bullet(text):
    s = clean(text)
    for p in (
        r"^(?:\S+ ?\S*) \d{4}년 \d분기 [가-힣 ]+? (?:약 )?([-(₩$KU\d].*) 기록$", r"^\d{4}년 \d분기 [가-힣 ]+: (.+)$", r"^[가-힣 ]+?(?:은|는) (.+?)(?:으로|로) 집계됨\(\d{4}년 \d분기\)$",
        r"^.+?의 [가-힣 ]+(?:이|가) (.+) 수준으로 변동$", r"^(.+?)의 [가-힣 ]+, .+ 부문이 견인$", r"^[가-힣 ]+? (?:약 )?([-(₩$KU\d].*) \(\d위 업체 대비 우위\)$",
    ):
        m = re.match(p, s)
        if m:
            return quantity(re.sub("^약 ", "", m[1]))
    return None


def section(bullets, spec):
    out = {}
    for i, b in enumerate(bullets or []):
        if b is not None and (q := bullet(b)):
            out["bullets", 0, i] = q
    if spec:
        title = clean(spec["title"] or "")
        m = re.search(r"(?:단위:?\s*|\(|\[)([^()\[\]]+?)[)\]]?$", title) if re.search(r"추이.+", title) else None
        default = (spec["unit"] or "").strip() or (m[1] if m else None)
        for i, v in enumerate(spec["values"] or []):
            if v and (q := quantity(v, default)):
                out["values", 0, i] = q
        for k, s in enumerate(spec["series"] or []):
            m = re.search(r"\((.+)\)$", s["name"] or "")
            for i, v in enumerate(s["values"] or []):
                if v and (q := quantity(v, m[1] if m else default)):
                    out["series", k, i] = q
    return out
