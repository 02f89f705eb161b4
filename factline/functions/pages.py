"""Facts from pages and feeds: links, titles, visible text, descriptions, profiles, contacts, dates, feed items.

Each is a plain function of one page's text, given as an Arrow-batched function over columns where a query needs it.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .jsons import linked_data

# Hosts of social pages, first path segments that are no profile, accounts of site builders.
SOCIAL_HOSTS = {"linkedin.com": "linkedin", "facebook.com": "facebook", "instagram.com": "instagram", "x.com": "x", "twitter.com": "x", "youtube.com": "youtube", "youtu.be": "youtube", "tiktok.com": "tiktok"}
NO_PROFILE = {
    "facebook": "sharer sharer.php share.php share dialog policy.php privacy events groups plugins photo.php photo photos permalink.php story.php watch hashtag media reel login login.php l.php home.php search marketplace help tr".split(),
    "instagram": "p reel reels stories explore".split(),
    "x": "intent share home search i".split(),
}
BUILDERS = (
    "wix wixstudio wix-com wixcom wix.com squarespace shopify wordpress wordpressdotcom automattic godaddy jimdo weebly webnode mailchimp hubspot elementor wpengine "
    "envato themeforest mystore mystore.no 21st-digital facebook instagram meta"
).split()
# Terms of links that lead to pages worth reading, best first, and marks of parked and placeholder pages.
PRIORITY_WORDS = (
    "kontakt", "contact", "om-oss", "om_oss", "about-us", "about", "kontor", "personvern", "privacy", "vilkar", "salgsbetingelser", "kjopsbetingelser", "terms", "impressum", "karriere", "jobb", "careers", "jobs", "nyheter", "aktuelt", "news",
)
PARKED_MARKS = (
    "domain is for sale", "domain for sale", "hugedomains", "parked at", "miss hosting", "her flytter snart en ny gjest", "has been informing visitors", "find the best information and most relevant links on all topics related to",
    "buy this domain", "this domain is parked", "future home of something quite cool", "does not have an active website here", "currently does not have an active website", "ingen side enda", "har ikke lagt ut noen nettsider",
    "/cgi-sys/defaultwebpage.cgi", "omdirigeringstjenesten er forbeholdt", "this redirect service is reserved for",
)
SERVER_MARKS = ("welcome to nginx!", "apache2 ubuntu default page", "apache2 debian default page", "test page for the apache http server", "default web site page", "web server's default page")
SOON_MARKS = ("lanseres snart", "kommer snart", "her kommer:", "under construction", "under oppbygging", "coming soon", "nettsiden er under arbeid", "siden er under utvikling", "site under construction")
HOST_MARKS = ("this one is taken, but you can find another available domain", "hosted by one.com", "index of /", "proudly served by litespeed web server")
PLACEHOLDER_MARKS = SOON_MARKS + HOST_MARKS
_SPACE = re.compile(r"\s+")


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class _Reader(HTMLParser):
    """Visible text, title, links, meta values, headings, paragraphs and times of a page."""

    INLINE = frozenset(("a", "b", "i", "em", "strong", "span", "small", "sup", "sub"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.meta: dict[str, str] = {}
        self.title, self.h1 = "", ""
        self.paragraphs: list[str] = []
        self.times: list[str] = []
        self._hidden = 0
        self._open: dict[str, list[str]] = {}
        self._href = ""

    def handle_starttag(self, tag, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style", "noscript", "template"):
            self._hidden += 1
        elif tag == "meta" and (name := (a.get("property") or a.get("name") or "").lower()):
            self.meta.setdefault(name, a.get("content", ""))
        elif tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        elif tag == "base":
            self.meta.setdefault("base", a.get("href", ""))
        if tag in ("title", "h1", "p", "a"):
            self._open[tag] = []
            if tag == "a":
                self._href = a.get("href", "")
        if tag not in self.INLINE:
            self.text.append("\n")

    def handle_endtag(self, tag) -> None:
        if tag not in self.INLINE:
            self.text.append("\n")
        if tag in ("script", "style", "noscript", "template"):
            self._hidden = max(0, self._hidden - 1)
        parts = self._open.pop(tag, None)
        if parts is None:
            return
        got = squeeze("".join(parts))
        if tag == "title" and not self.title:
            self.title = got
        elif tag == "h1" and not self.h1:
            self.h1 = got
        elif tag == "p" and got:
            self.paragraphs.append(got)
        elif tag == "a" and self._href:
            self.links.append((self._href, got))

    def handle_data(self, data) -> None:
        for parts in self._open.values():
            parts.append(data)
        if not self._hidden and "title" not in self._open:
            self.text.append(data)


def read(page: str | None) -> _Reader:
    r = _Reader()
    if page:
        r.feed(page)
        r.close()
    return r


def visible_text(page: str | None) -> str | None:
    """The text that a reader sees, a line for each block; null for null."""
    if page is None:
        return None
    lines = (squeeze(x) for x in "".join(read(page).text).split("\n"))
    return "\n".join(x for x in lines if x)


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower().removeprefix("www.")
    except ValueError:
        return ""


def own_links(page: str | None, url: str | None) -> list[str]:
    """Links to the page's own site, without query and fragment, each once in order."""
    base, out = url or "", {}
    r = read(page)
    for href, _ in r.links:
        try:
            full = urljoin(urljoin(base, r.meta.get("base", "")), href.strip())
            parts = urlsplit(full)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and host_of(full) == host_of(base):
            out[f"{parts.scheme}://{parts.netloc}{parts.path or '/'}"] = None
    return list(out)


def link_rank(url: str, label: str = "") -> int | None:
    """The place of the first priority word in a link or its text."""
    text = f"{urlsplit(url).path} {label}".lower()
    return next((i for i, w in enumerate(PRIORITY_WORDS) if w in text), None)


def description(page: str | None) -> str | None:
    """From linked data, else the meta description, else the first paragraph of 60 characters."""
    if not page:
        return None
    for o in linked_data(page):
        if isinstance(o.get("description"), str) and squeeze(o["description"]):
            return squeeze(o["description"])
    r = read(page)
    for name in ("description", "og:description"):
        if squeeze(r.meta.get(name, "")):
            return squeeze(r.meta[name])
    return next((p for p in r.paragraphs if len(p) >= 60), None)


def brand(page: str | None) -> str | None:
    """From linked data, else og:site_name, else the title's last part."""
    if not page:
        return None
    for o in linked_data(page):
        if "Organization" in str(o.get("@type")) and isinstance(o.get("name"), str):
            return squeeze(o["name"])
    r = read(page)
    return squeeze(r.meta.get("og:site_name", "")) or squeeze(re.split(r"\s[–|-]\s", r.title)[-1]) or None


#: For each platform the paths of profiles, whose group 1 is the part that tells the account.
PROFILE_PATHS = {
    "facebook": re.compile(r"/((?!\d+_\d+$)[^/]+(?:/(?!posts|photos|videos|events|reviews|about)[^/]+)*)(?:/(?:posts|photos|videos|events|reviews|about)(?:/.*)?)?", re.I),
    "instagram": re.compile(r"/([^/]+(?:/[^/]+)*)"),
    "linkedin": re.compile(r"/(company/[^/]+)(?:/.*)?", re.I),
    "tiktok": re.compile(r"/(@[^/]+(?:/[^/]+)*)"),
    "x": re.compile(r"/([^/]+)"),
    "youtube": re.compile(r"/(@[^/]+|(?:channel|user|c)(?:/[^/]+)?)(?:/.*)?", re.I),
}


def social_profile(url: str) -> tuple[str, str] | None:
    """Platform and one canonical address of a company's profile; null for share links, posts and builders' accounts."""
    host = host_of(url)
    platform = next((p for h, p in SOCIAL_HOSTS.items() if (host == h or host.endswith("." + h)) and h != "youtu.be"), None)
    if platform is None:
        return None
    parsed = urlsplit(url)
    path = "/" + "/".join(filter(None, (p.strip() for p in parsed.path.split("/"))))
    if path.lower().startswith("/profile.php") and platform == "facebook":
        number = re.fullmatch(r"(?:.*&)?id=(\d{5,20})(?:&.*)?", parsed.query)
        return (platform, f"https://facebook.com/profile.php?id={number.group(1)}") if number and path.lower() == "/profile.php" else None
    match = PROFILE_PATHS[platform].fullmatch(path)
    if not match or path[1:].split("/")[0].casefold() in NO_PROFILE.get(platform, ()):
        return None
    account = match.group(1)
    return None if account.rsplit("/", 1)[-1].lstrip("@").casefold() in BUILDERS else (platform, f"https://{platform}.com/{account}")


def social_links(page: str | None) -> list[tuple[str, str]]:
    """Profiles that a page links to or names in its linked data, each once, sorted."""
    found = {p for href, _ in read(page).links if (p := social_profile(href))}
    for o in linked_data(page or ""):
        same = o.get("sameAs")
        found |= {p for u in (same if isinstance(same, list) else [same]) if isinstance(u, str) and (p := social_profile(u))}
    return sorted(found)


def mails(page: str | None, domain: str | None = None) -> list[str]:
    """Mail addresses, those of the domain first; placeholders left out."""
    text, found = html.unescape(page or ""), {}
    for at in re.finditer("@", text):  # from each sign to both sides, in the lengths that addresses may have
        left = re.search(r"[\w.+-]{1,64}$", text[max(0, at.start() - 64) : at.start()])
        right = re.match(r"[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}", text[at.end() : at.end() + 255])
        if left and right:
            found[f"{left.group()}@{right.group()}".lower().strip(".")] = None
    good = [m for m in found if not re.search(r"(?:^(?:example|test|your|navn|name)@|@(?:domain|sentry|email)\.|\.(?:png|jpg|gif|webp)$)", m)]
    return sorted(good, key=lambda m: (not (domain and m.endswith("@" + domain)), good.index(m)))


def publication_date(page: str | None) -> str | None:
    """yyyy-MM-dd from article meta values, linked data of an article, or a time element."""
    if not page:
        return None
    r = read(page)
    names = ("article:published_time", "og:article:published_time", "date", "dc.date", "publishdate")
    values = [r.meta[n] for n in names if r.meta.get(n)]
    values += [str(o["datePublished"]) for o in linked_data(page) if "Article" in str(o.get("@type")) or "Posting" in str(o.get("@type")) if o.get("datePublished")]
    return next((m.group() for v in (*values, *r.times) if (m := re.match(r"\d{4}-\d{2}-\d{2}", v.strip()))), None)


def placeholder(text: str | None, links: int = 0) -> bool:
    """A parked or empty page: a mark in a short text with few links of its own; null and blank texts are."""
    low = (text or "").lower()
    return not low.strip() or any(m in low for m in PARKED_MARKS + SERVER_MARKS) or (len(low) <= 900 and links <= 3 and any(m in low for m in PLACEHOLDER_MARKS))


def feed_items(text: str | None) -> list[tuple[str, str, str]]:
    """Title, link and publication text of the items of an RSS or Atom feed, whatever its namespaces; [] if unreadable."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    name = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    out = []
    for item in (e for e in root.iter() if name(e) in ("item", "entry")):
        first: dict[str, str] = {}
        links = []
        for e in item:
            if name(e) == "link":
                links.append((e.get("rel", "alternate") != "alternate", (e.get("href") or e.text or "").strip()))
            first.setdefault(name(e), squeeze(e.text or ""))
        out.append((first.get("title", ""), min(links)[1] if links else "", first.get("pubdate") or first.get("published") or ""))
    return out


def sitemap_links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1))


def unwrap(url: Column) -> Column:
    """The address in a redirect's url parameter, else the address."""
    return F.coalesce(F.try_url_decode(F.nullif(F.regexp_extract(url, r"[?&]url=([^&#]+)", 1), F.lit(""))), url)


def over(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """An Arrow-batched column function of a plain one of one or two values; tuples become structs."""

    def rows(*columns: pd.Series) -> list:
        clean = [c.astype(object).where(c.notna(), None) for c in columns]
        return [f(*row) for row in zip(*clean, strict=True)]

    if isinstance(kind, T.StructType):
        # each batch of a struct is a frame of its fields
        def struct(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for a in batches:
                yield pd.DataFrame(rows(a), columns=kind.fieldNames())

        return pandas_udf(struct, kind)

    def one(a: pd.Series) -> pd.Series:
        return pd.Series(rows(a), dtype=object)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(rows(a, b), dtype=object)

    return lambda *cols: pandas_udf(one if len(cols) == 1 else two, kind)(*cols)


TEXTS = T.ArrayType(T.StringType())
PROFILES = T.ArrayType(T.StructType([T.StructField("platform", T.StringType()), T.StructField("url", T.StringType())]))
ITEMS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "published")]))
