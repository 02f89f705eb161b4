"""Text as Column expressions: folding, name normalisers, numbers of organisations, phones, addresses of sites.

All are null for null unless said otherwise, and stay inside code generation.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms and fillers, one set for each normaliser.
LEGAL_CORE = "as asa ans da enk sa nuf iks sti stiftelsen ba bl sam".split()
LEGAL_TITLE = "as asa sa da ans enk nuf avd".split()
LEGAL_TOKENS = "as asa ans da ba sa nuf enk".split()
LEGAL_NAME = "as asa ans da enk iks sa sam sti stiftelsen nuf".split()
LEGAL_TAIL = "as asa sa da ans ba ks iks nuf enk sf esek brl sti sam".split()
BRANCH_WORDS = r"(?i)\b(AS|ASA|ANS|DA|BA|SA|NUF|ENK|AVD\.?|AVDELING)\b\.?"
FORM_WORDS = "as|asa|sa|da|ans|ba|nuf|ks|enk|stiftelse|forening"
MOD11_WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)
#: Letters of more than one when written in ASCII.
LONG_LETTERS = {"æ": "ae", "Æ": "AE", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "™": "TM", "№": "No"}
#: Public suffixes of two labels; the others have one.
LONG_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au co.nz co.jp com.br priv.no kommune.no".split()
FREEMAIL = (
    "gmail.com online.no hotmail.com outlook.com live.no yahoo.no c2i.net lyse.net icloud.com me.com broadpark.no frisurf.no hotmail.no yahoo.com altibox.no getmail.no "
    "msn.com live.com mac.com yahoo.co.uk hotmail.co.uk start.no nextmail.no chello.no runbox.no runbox.com protonmail.com gmx.com gmx.net tele2.no"
).split()


def _single_letters() -> tuple[str, str]:
    """Letters outside ASCII with the one ASCII letter that they decompose to; ø and å have theirs by rule."""
    pairs = {"ø": "o", "Ø": "O", "å": "a", "Å": "A"}
    for n in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        c = chr(n)
        to = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(to) == 1:
            pairs.setdefault(c, to)
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _single_letters()


def fold(text: Column) -> Column:
    """ASCII in lower case: ø as o, å as a, æ as ae, accents dropped, other signs dropped; null as ''."""
    out = F.coalesce(text, F.lit(""))
    for a, b in LONG_LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(F.regexp_replace(F.translate(out, _FROM, _TO), r"[^\x00-\x7F]", ""))


def words(text: Column) -> Column:
    """The runs of ASCII letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"([a-z0-9]+)"), 1)


def _without(tokens: Column, drop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*drop))


def name_core(name: Column) -> Column:
    return F.array_join(_without(words(fold(name)), LEGAL_CORE), " ")


def norm_title(title: Column) -> Column:
    return F.array_join(_without(words(fold(title)), LEGAL_TITLE), " ")


def name_tokens(name: Column) -> Column:
    """Distinct words in lower case without legal forms; letters of all scripts, not folded."""
    split = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\p{Alnum}]+"), lambda t: t != "")
    return F.array_distinct(_without(split, LEGAL_TOKENS))


def legal_name_core(name: Column) -> Column:
    return F.array_distinct(F.filter(_without(words(fold(name)), LEGAL_NAME), lambda t: F.length(t) > 1))


def name_key(name: Column) -> Column:
    return F.array_join(words(fold(name)), " ")


def squeeze(text: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def core_name(name: Column) -> Column:
    """Without one legal form before or after the name."""
    tail = rf"(?i)\s+({FORM_WORDS})(\s+i\s+likvidasjon|\s+under\s+avvikling)?$"
    return squeeze(F.regexp_replace(F.regexp_replace(squeeze(name), tail, ""), r"(?i)^(as|asa|stiftelsen)\s+", ""))


def strip_legal_tail(name: Column) -> Column:
    """Without the legal forms at the end, unless nothing is left."""
    bare = F.regexp_replace(squeeze(name), rf"(?i)((^|\s+)({'|'.join(LEGAL_TAIL)})[.,]*)+$", "")
    return F.when(F.trim(bare) == "", F.trim(name)).otherwise(F.trim(bare))


def without_branch_words(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, BRANCH_WORDS, " "), r"\s+", " "), F.lit(" -,"))


def subunit_alias(name: Column, parent: Column) -> Column:
    """The trade name of a subunit, null if it only repeats its parent's."""
    own, above = without_branch_words(name), F.coalesce(without_branch_words(parent), F.lit(""))
    low, top = F.lower(own), F.lower(above)
    repeats = (top != "") & ((low == top) | low.startswith(F.concat(top, F.lit(" "))))
    return F.when((own == "") | repeats, None).otherwise(own)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def phone(text: Column) -> Column:
    """Eight digits without the country code, else null."""
    d = F.regexp_replace(digits(text), "^0047", "")
    d = F.when(d.startswith("47") & (F.length(d) == 10), F.substring(d, 3, 8)).otherwise(d)
    return F.when(F.length(d) == 8, d)


def page_phone(text: Column) -> Column:
    """The digits, without 47 before eight of them; any length."""
    d = digits(text)
    return F.when(d.startswith("47") & (F.length(d) == 10), F.substring(d, 3, 8)).otherwise(d)


def find_phones(text: Column) -> Column:
    """Distinct numbers of eight digits in a text."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d[\d\s]{6,10}\d)(?!\d)"), 1)
    return F.array_distinct(F.filter(F.transform(found, page_phone), lambda d: F.length(d) == 8))


def valid_orgnr(number: Column) -> Column:
    """Nine digits whose last is the check digit modulo 11; false for null."""
    total = F.lit(0)
    for i, w in enumerate(MOD11_WEIGHTS):
        total = total + F.substring(number, i + 1, 1).try_cast("int") * w
    check = F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11))
    return F.coalesce(number.rlike(r"^\d{9}$") & (check == F.substring(number, 9, 1).try_cast("int")), F.lit(False))


def find_org_numbers(text: Column) -> Column:
    """Array of (digits, labelled) of the valid numbers of a text; a labelled mention wins over a bare one."""
    body = r"(\d[\d\s.\x{a0}]{7,15}\d)"
    label = rf"(?i)(?:org(?:anisasjonsnummer|\.?\s*nr)\.?\s*[:.]?\s*(?:NO\s?)?|eies\s+av\s+|belongs\s+to\s+(?:org\s+)?|foretaksregisteret\s*[:.]?\s*(?:NO\s?)?){body}"
    vat = r"(?i)\bNO\s?(\d{3}[\s.]?\d{3}[\s.]?\d{3})\s?MVA\b"
    bare = rf"(?i)(?:\bNO[\s.]?)?\b{body}\b(?:\s?MVA\b)?"
    source = F.coalesce(text, F.lit(""))

    def hits(pattern: str) -> Column:
        return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(source, F.lit(pattern), 1), digits), valid_orgnr))

    strong = F.array_union(hits(label), hits(vat))
    weak = F.array_except(hits(bare), strong)
    return F.concat(
        F.transform(strong, lambda d: F.struct(d.alias("digits"), F.lit(True).alias("labelled"))),
        F.transform(weak, lambda d: F.struct(d.alias("digits"), F.lit(False).alias("labelled"))),
    )


def host(address: Column) -> Column:
    """Host of a mail address or site, in lower case, without port; null if there is none."""
    v = F.lower(F.trim(F.trim(address), F.lit(".")))
    v = F.when(v.contains("@"), F.element_at(F.split(v, "@"), -1)).otherwise(F.regexp_replace(F.regexp_replace(v, r"^.*?//", ""), r"[/?#].*$", ""))
    v = F.regexp_replace(v, ":.*$", "")
    return F.when((v != "") & ~v.contains(" "), v)


def registered_domain(address: Column) -> Column:
    """The last labels of the host: two, or three where the last two are a suffix of their own."""
    labels = F.split(host(address), r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    longer = F.when(F.size(labels) >= 3, F.array_join(F.slice(labels, -3, 3), "."))
    return F.when(F.size(labels) >= 2, F.when(two.isin(*LONG_SUFFIXES), longer).otherwise(two))


def site_key(url: Column) -> Column:
    """One key for a site whatever its scheme, www and closing slashes."""
    v = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return F.rtrim(F.regexp_replace(F.regexp_replace(v, "^https?://", ""), r"^www\.", ""), F.lit("/"))


def with_scheme(url: Column) -> Column:
    """https:// before an address without scheme, no closing slashes; null for blank."""
    v = F.trim(url)
    return F.when(v != "", F.rtrim(F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit("https://"), v)), F.lit("/")))


def without_default_port(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^(?i)(http://[^/:]+):80(/|$)", "$1$2"), r"^(?i)(https://[^/:]+):443(/|$)", "$1$2")


def same_site(ours: Column, theirs: Column) -> Column:
    """Equal keys, or one host where theirs has no path and ours only one of a language or home."""
    languages = ["", "en", "no", "nb", "nn", "sv", "da", "de", "en-gb", "en-us", "nb-no", "no-nb", "home", "index.html", "hjem"]
    oh, gh = F.substring_index(ours, "/", 1), F.substring_index(theirs, "/", 1)
    op, gp = F.trim(F.substr(ours, F.length(oh) + 1), F.lit("/")), F.trim(F.substr(theirs, F.length(gh) + 1), F.lit("/"))
    inner = F.when(gp == "", op.isin(*languages)).otherwise((op == gp) | op.startswith(F.concat(gp, F.lit("/"))))
    return F.coalesce((ours == theirs) | ((oh == gh) & inner), F.lit(False))


def plain_text(text: Column) -> Column:
    """Lower case without punctuation, single spaces: equal for texts that differ in nothing else."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def clip(text: Column, limit: int = 200) -> Column:
    """Single spaces, cut to the limit with three dots."""
    v = squeeze(text)
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.rtrim(F.substring(v, 1, limit - 3)), F.lit("...")))


def cut_sentence(text: Column, limit: int = 400) -> Column:
    """Cut at the last sentence end within the limit, else at the last word."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(\s|$)", 1)
    return F.when(F.length(text) <= limit, text).when(sentence != "", sentence).otherwise(F.regexp_replace(head, r"\s+\S*$", ""))


def format_money(amount: Column, currency: Column | None = None) -> Column:
    """Billions and millions with two digits, else whole numbers, after the currency and a sign."""
    size = F.abs(amount)
    body = F.when(size >= 1e9, F.concat(F.format_number(size / 1e9, 2), F.lit("B"))).when(size >= 1e6, F.concat(F.format_number(size / 1e6, 2), F.lit("M"))).otherwise(F.format_number(size, 0))
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.coalesce(currency, F.lit("NOK")) if currency is not None else F.lit("NOK"), F.lit(" "), body)


def label_of(field: Column) -> Column:
    """Words of a name in camel or snake case."""
    v = F.lower(F.trim(F.regexp_replace(F.regexp_replace(field, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")))
    return F.concat(F.upper(F.substring(v, 1, 1)), F.substr(v, F.lit(2)))


def join_words(parts: Column) -> Column:
    """a, b and c."""
    n = F.size(parts)
    return F.when(n <= 1, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(parts, -1)))


def count_of(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def address_text(*parts: Column) -> Column:
    """The parts that aren't blank, with commas."""
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), ", ")
