"""Names and numbers in running text that need more than one pattern: registered names, staff counts, site guesses."""

from __future__ import annotations

import re

from .text import LONG_LETTERS

# Words that may stand before a company's name without being part of it, and forms in capitals.
BEFORE_NAMES = frozenset(
    "selskapet firmaet bedriften daglig styreleder i og men nå her der da når hos for med til fra av om på etter både også ifølge det den dette the a an and but at in with from by according company firm "
    "nyheter pressemelding oppdatert publisert".split()
)
FORMS = "AS ASA ANS DA SA NUF IKS BA".split()


#: What may run into a name from the left and make it the end of a longer one: a hyphen, an initial, a capitalised word.
_INTO = r"(?:(?P<hyphen>-)|(?<!\w)(?P<initial>[A-ZÆØÅ]\.)[ \t]*|(?P<word>[A-ZÆØÅ][\w&'-]*)[ \t]+)?"


def registered_name(text: str | None, name: str | None) -> str | None:
    """The full registered name as a text writes it, its form in capitals, not the end of a longer name; else null."""
    *first, last = re.findall(r"\w+", name or "") or [""]
    if not first or not text:
        return None
    form = last.upper() if last.upper() in FORMS else f"(?i:{re.escape(last)})"
    spelled = r"[^\w\n]{1,3}".join([f"(?i:{re.escape(w)})" for w in first] + [form])
    pattern = re.compile(rf"{_INTO}(?<!\w)(?P<name>{spelled})(?!\w)")
    at = 0
    while m := pattern.search(text, at):
        free = not (m["hyphen"] or m["initial"]) and (m["word"] is None or m["word"].casefold() in BEFORE_NAMES)
        if free:
            return m["name"]
        at = m.end("name")
    return None


_COUNT = re.compile(
    r"(?i)(?:(?P<fte>årsverk)\D{0,40}?(?P<a>\d[\d .,]*\d|\d)|(?P<b>\d[\d .,]*\d|\d)\s+(?:(?P<fte2>årsverk)|ansatte|medarbeidere|employees)|(?:antall ansatte|number of employees)\D{0,20}?(?P<c>\d[\d .,]*\d|\d))"
)


def staff_count(text: str | None) -> tuple[str, float | None, str | None]:
    """(found, none or conflict, the count, its measure) from a text; years aren't counts, figures that differ conflict."""
    found: dict[tuple[float, str], None] = {}
    for m in _COUNT.finditer(text or ""):
        raw = next(g for g in (m["a"], m["b"], m["c"]) if g)
        number = re.sub(r"[ .](?=\d{3}\b)", "", raw.strip(" .,")).replace(",", ".")
        try:
            n = float(number)
        except ValueError:
            continue
        if 1900 <= n <= 2100 and n == int(n) and len(number) == 4:
            continue
        found[(n, "full_time_equivalents" if m["fte"] or m["fte2"] else "employees")] = None
    if not found:
        return "none", None, None
    if len({n for n, _ in found}) > 1:
        return "conflict", None, None
    n, measure = next(iter(found))
    return "found", n, measure


def site_guesses(name: str, generic: frozenset[str] = frozenset(["bygg", "transport", "eiendom", "holding", "invest", "service", "elektro", "handel", "regnskap", "maskin"])) -> list[str]:
    """Labels that a company's site may have: its words joined and hyphenated, without the legal form, then the first two."""
    for a, b in LONG_LETTERS.items():
        name = name.replace(a, b)
    spellings = [name.lower().translate(str.maketrans("øåäöéü", "oaaoeu"))]
    if re.search("[øå]", name.lower()):
        spellings.append(name.lower().replace("ø", "oe").replace("å", "aa"))
    out: dict[str, None] = {}
    for s in spellings:
        words = [w for w in re.findall(r"[a-z0-9]+", s) if w.upper() not in FORMS]
        for part in (words, words[:2], words[:1]):
            if part and not (len(part) == 1 and (part[0] in generic or len(part[0]) < 4)):
                out["".join(part)] = None
                out["-".join(part)] = None
    return list(out)
