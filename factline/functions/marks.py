"""Predicates over texts of pages and items by lists of marks, and values as the text that a reader finds.

All are Column expressions; the lists are fixed values, each a parameter of its function.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pages import PARKED_MARKS, SERVER_MARKS, SOON_MARKS
from .text import fold

# Marks of hijacked, parked and dead pages, drafts, spam, boilerplate; applicant systems; industries.
HIJACKED = (
    "casino", "jackpot", "slot machine", "free spins", "no deposit bonus", "online betting", "sportsbook", "poker room", "bet now", "play now and win", "best online casino", "viagra", "cialis", "online pharmacy",
    "cheap pharmacy", "buy pills online", "adult content", "xxx video", "escort service", "webcam girls",
)
PARKED, SERVER_DEFAULT, COMING_SOON = PARKED_MARKS, SERVER_MARKS, SOON_MARKS
DEAD = ("proudly served by", "index of /", "this one is taken", "ingenting ble funnet", "nothing was found", "nothing found", "page not found", "siden finnes ikke", "fant ikke siden", "finner ikke siden", "siden du leter etter", "the page you are looking for")
BOILERPLATE = (
    "informasjonskapsler", "cookies", "personvernerklæring", "personvernerklaering", "aksepter alle", "denne nettsiden bruker", "this website uses", "kontakt oss her", "kontakte oss", "komme i kontakt med oss",
    "contact us here", "din bestilling", "handlekurv", "fri frakt", "gratis frakt", "your order", "free shipping",
)
SPAM_STRONG = (
    "birkin", "aliexpress", "louis vuitton", "viagra", "cialis", "payday loan", "payday loans", "essay writing", "replica bag", "replica bags", "replica handbag", "replica handbags", "replica watch", "replica watches", "replica rolex",
    "cheap jerseys", "cheap handbags",
)
SPAM_WEAK = ("replica", "replicas", "counterfeit", "knockoff", "knockoffs", "casino", "handbag", "handbags")
PLACEHOLDER_TITLES = ("hello world", "hei verden", "hallo verden", "sample page", "eksempelside", "sample post", "eksempelinnlegg", "post format gallery", "untitled", "uten tittel", "draft", "kladd", "ny side", "new page", "test")
APPLICANT_SYSTEMS = {
    "teamtailor": "teamtailor.com", "lever": "jobs.lever.co", "greenhouse": "greenhouse.io", "smartrecruiters": "smartrecruiters.com", "webcruiter": "webcruiter.no", "jobylon": "jobylon.com", "reachmee": "reachmee.com",
    "hr-manager": "hr-manager.net", "recman": "recman.no", "easycruit": "easycruit.com", "jobbnorge": "jobbnorge.no", "workday": "myworkdayjobs.com",
}
INDUSTRY_WORDS = {
    "fishing": ("fiskebat", "fiskefartoy", "fiskerikvote", "fangst av fisk", "sjomat", "fiskekvote", "garnfiske", "tralfiske"), "grocery_retail": ("dagligvare", "matbutikk", "supermarked", "kjedebutikk", "ukens tilbud", "handlekurv"),
    "restaurants": ("bordbestilling restaurant", "restaurantmeny", "takeaway", "bestill mat na"), "hospitality": ("hotellrom", "overnatting", "bestill rom", "ledige rom", "resepsjon hotell"),
    "sports_fitness": ("treningssenter", "medlemskap trening", "gruppetimer", "personlig trener"), "software": ("programvare", "saas platform", "api dokumentasjon", "skylosning"),
    "finance": ("bankkonto", "laan og kreditt", "forsikringsvilkar", "sparekonto"), "healthcare": ("legetime", "pasientjournal", "helsetjeneste", "fastlege"),
}
COMPANY_FORMS = "as asa ans da enk iks sa sam sti stiftelsen nuf ab oy aps ltd llc inc gmbh plc spa srl nv bv co corp".split()


def any_word(text: Column, marks: Sequence[str]) -> Column:
    """Whether one of the marks stands in the text as whole words; false for null."""
    return F.coalesce(F.lower(text).rlike(r"(?U)\b(?:" + "|".join(map(re.escape, marks)) + r")\b"), F.lit(False))


def any_part(text: Column, marks: Sequence[str]) -> Column:
    """Whether one of the marks stands anywhere in the text; false for null."""
    return F.coalesce(F.lower(text).rlike("|".join(map(re.escape, marks))), F.lit(False))


def hijacked(text: Column) -> Column:
    return any_word(text, HIJACKED)


def page_state(text: Column, links: Column) -> Column:
    """parked, server default, coming soon (short and without links of its own), dead, or null for a page of its own."""
    short = (F.length(text) <= 900) & (F.coalesce(links, F.lit(0)) <= 3)
    return F.when(any_part(text, PARKED), "parked").when(any_part(text, SERVER_DEFAULT), "server default").when(short & any_part(text, COMING_SOON), "coming soon").when(any_part(text, DEAD), "dead")


def other_industry(own: Column, text: Column, words: Mapping[str, Sequence[str]] = INDUSTRY_WORDS) -> Column:
    """The first industry other than the own of which a text has two different words; null for an unknown own."""
    folded = fold(text)
    hits = [(k, sum((F.when(folded.contains(w), 1).otherwise(0) for w in ws), F.lit(0))) for k, ws in words.items()]
    return F.when(own.isNotNull(), F.coalesce(*[F.when((F.lit(k) != own) & (n >= 2), k) for k, n in hits]))


def copyright_owners(text: Column) -> Column:
    """Owners named after a copyright sign that have a company's form."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:©|\(c\)|copyright)[ \t]*(?:\d{4}(?:[ \t]*[-–][ \t]*\d{4})?[ \t]*)?(\p{L}[\p{L}\d&,'\- ]{1,60})"), 1)
    forms = F.array(*[F.lit(f) for f in COMPANY_FORMS])
    return F.array_distinct(F.filter(F.transform(found, F.trim), lambda o: F.arrays_overlap(F.split(fold(o), "[^a-z0-9]+"), forms)))


def applicant_system(urls: Column) -> Column:
    """Provider and address of the first address, in their order, of an applicant system; null if there is none."""
    provider = lambda u: F.coalesce(*[F.when(F.lower(u).contains(host), name) for name, host in APPLICANT_SYSTEMS.items()])
    found = F.transform(urls, lambda u: F.struct(provider(u).alias("provider"), u.alias("url")))
    return F.get(F.filter(found, lambda x: x["provider"].isNotNull()), F.lit(0))


def own_item(title: Column, url: Column) -> Column:
    """Whether a feed's item is the company's publication: no comment, product, placeholder or draft."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)[^\w ]", ""))
    comment = F.coalesce(url, F.lit("")).rlike("/comments/|#comment|replytocom=") | bare.rlike(r"^(comments? on|kommentar(er)? (til|på)) ")
    product = F.coalesce(url, F.lit("")).rlike("(?i)//[^/]+.*/(produkt|produkter|product|products|shop|butikk|nettbutikk|vare|varer)/")
    return ~(comment | product | bare.isin(*PLACEHOLDER_TITLES) | bare.rlike(r"^(elementor ?\d+|test(ing)? ?\d*|\d+)$"))


def spam(title: Column) -> Column:
    """2 for a title with a strong mark of spam, 1 for a weak one, else 0; a feed with 2 in one or 1 in two items isn't to be trusted."""
    return F.when(any_word(title, SPAM_STRONG), 2).when(any_word(title, SPAM_WEAK), 1).otherwise(0)


def usable_description(text: Column) -> Column:
    """Whether a text reads as a description: three words, no endless word, no hours, notice, greeting or boilerplate."""
    folded = fold(text)
    words = F.size(F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), 1))
    endless = F.exists(F.split(text, r"\s+"), lambda w: F.length(w) > 40)
    hours = (F.length(text) < 80) & folded.rlike(r"\d{1,2}[:.]\d{2}") & folded.rlike(r"\b(man|tir|ons|tor|fre|lor|son|mon|tue|wed|thu|fri|sat|sun)[a-z]*\b")
    notice = folded.rlike(r"\b(mandag|tirsdag|onsdag|torsdag|fredag|lordag|sondag|konferanse|webinar|pameldingsfrist)\b|\b\d{1,2}\. ?(januar|februar|mars|april|mai|juni|juli|august|september|oktober|november|desember)\b")
    goes_on = folded.rlike(r"^(\S+\s+){0,5}(driver|tilbyr|har|er)\s+(i tillegg|ogsa|dessuten)\b")
    greeting = folded.rlike(r"^(velkommen til|welcome to)\s+[^.!?]{0,80}[.!?]?$")
    return F.coalesce((words >= 3) & ~endless & ~hours & ~notice & ~goes_on & ~greeting & ~any_part(text, DEAD) & ~any_part(text, BOILERPLATE), F.lit(False))


def value_text(value: Column) -> Column:
    """A claim's value (JSON) as plain text: amounts, addresses of sites, postings, roles, places, codes, counts, lists."""
    g = lambda p: F.get_json_object(value, f"$.{p}")
    number = lambda v: F.when(v.try_cast("double") == F.floor(v.try_cast("double")), F.floor(v.try_cast("double")).cast("string")).otherwise(F.format_string("%.2f", v.try_cast("double")))
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull() & (x != ""))
    head = F.substring(F.ltrim(value), 1, 1)
    posting = F.array_join(some(g("title"), g("employer_name"), F.substring(F.coalesce(g("published"), g("application_due")), 1, 10)), " — ")
    role = F.trim(F.concat(F.coalesce(g("role_label"), g("role_code"), g("role")), F.lit(": "), F.coalesce(g("name"), F.lit(""))))
    place = F.array_join(some(g("name"), g("street"), F.array_join(some(g("postcode"), g("city")), " ")), ", ")
    count = F.concat(g("count"), F.coalesce(F.concat(F.lit(" (registered "), g("registered_at"), F.lit(")")), F.lit("")))
    shaped = (
        F.when(g("amount").isNotNull(), F.concat(number(g("amount")), F.lit(" "), F.coalesce(g("currency"), F.lit("NOK"))))
        .when(g("title").isNotNull(), posting).when(g("url").isNotNull(), g("url")).when(F.coalesce(g("role_label"), g("role_code"), g("role")).isNotNull(), role)
        .when(F.coalesce(g("street"), g("postcode"), g("city")).isNotNull(), place).when(g("code").isNotNull() & g("label").isNotNull(), F.concat(g("label"), F.lit(" ("), g("code"), F.lit(")")))
        .when(g("count").isNotNull(), count).otherwise(value)
    )
    listed = F.array_join(F.from_json(value, "array<string>"), ", ")
    plain = F.get_json_object(value, "$")
    return F.when(head == "{", shaped).when(head == "[", listed).when(plain.try_cast("double").isNotNull() & (head != '"'), number(plain)).otherwise(F.coalesce(plain, value))
