"""Plain versions of the contracts, row by row."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK_WORD = re.compile("[^\x20\x09-\x0d]+")
PHRASE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def lower_ascii(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def pii_base(text):
    found = pii(text)
    return {f"n_{k}": len(v) for k, v in found.items()} | {"base_sha256": sha(f"{k}:{s}:{e}" for k, v in found.items() for s, e in v)}


def secrets_base(text):
    text = text or ""
    found = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 18],
        "hex": [m.span() for m in HEX.finditer(text) if len(m[0]) >= 16],
    }
    order = sorted((s, i, k, e) for i, (k, v) in enumerate(found.items()) for s, e in v)
    return {f"n_{k}": len(v) for k, v in found.items()} | {"base_sha256": sha(f"{k}:{s}:{e}" for s, _, k, e in order)}


def decontaminate(docs, items, window=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    by_window = defaultdict(set)
    for item, text in items:
        w = PHRASE_WORD.findall(lower_ascii(text))
        for i in range(max(0, len(w) - window) + 1 if w else 0):
            by_window[tuple(w[i : i + window])].add(item)
    lengths = {len(w) for w in by_window}
    out = []
    for doc, text in docs:
        w = PHRASE_WORD.findall(lower_ascii(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if items_here := by_window.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items_here
        names = sorted(str(x) for x in found)
        out.append((doc, len(w), len(hit), len(names), sha(names), bool(hit)))
    return out


def quality(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    covered = {p + o for at in seen.values() if len(at) > 1 for p in at for o in range(5)}
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    n, rep = len(words), len(covered)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": rep,
        "base_failed": n < 10 or 100 * rep > 20 * n,
    }


def shingles(text, n=2):
    w = BLANK_WORD.findall(lower_ascii(text))
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def near_dups(docs, n=2, percent=80):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by_shingle[x].append(d)
    inter = Counter()
    for ds in by_shingle.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                inter[min(a, b), max(a, b)] += 1
    for (a, b), k in inter.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_-])")
WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{8,13}|ASIA[A-Z0-9]{12,}+|(?:key|acct|client)[_-]?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])")
ENDPOINT = re.compile(r"(?:https?://|jdbc:|postgres(?:ql)?://|mongodb(?:\+srv)?://|s3://)[^\x20\t\n\x0b\f\r\"'<>]{4,}+")
CONFIRMED_BY = {"token": {"access", "weak_access", "endpoint"}, "weak_access": {"token", "assign"}}


def secret_spans(text, scope=200):
    """All findings, comparing every weak part with every other part."""
    text = text or ""
    base = (
        [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        + [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
        + [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    )
    weak = [("token", *m.span()) for m in TOKEN.finditer(text) if all(re.search(x, m[0]) for x in ("[a-z]", "[A-Z]", "[0-9]"))]
    weak += [("weak_access", *m.span()) for m in WEAK_ACCESS.finditer(text)] + [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    linked = [
        ("linked_token" if k == "token" else "linked_access", s, e)
        for k, s, e in weak
        if any(p in CONFIRMED_BY.get(k, ()) and (0 <= ps - e <= scope or 0 <= s - pe <= scope) for p, ps, pe in base + weak)
    ]
    order = ["assign", "access", "hex", "linked_token", "linked_access"]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, order.index(k), k, e) for k, s, e in base + linked))


DOT = r"(?:\x20?[\[(](?:dot|\.)[\])]\x20?)"
SPELLED = re.compile(rf"(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(](?:at|@)[\])]\x20?[a-z0-9-]++(?:{DOT}+[a-z0-9-]++)+", re.I | re.A)
PHONE_PLAIN = re.compile(r"(?<![0-9A-Za-z+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def pii_candidates(text):
    """(kind, start, end) of the base and the wider kinds."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(k, s, e) for k, spans in pii(text).items() for s, e in spans]
    found += [("card_unchecked", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and not luhn(digits(m))]
    for kind, pattern in (("email_spelled", SPELLED), ("phone_plain", PHONE_PLAIN), ("iban", IBAN), ("ssn", SSN)):
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(found)


def iban_remainder(iban):
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97
