"""Websites of organisations: candidates by source, hosts that are nobody's own, and states.

Null or empty addresses are no candidates. Hosts are compared in small letters without www. Repeats are one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts of chains, whose pages describe the chain, and of directories, marketplaces and site builders.
CHAINS = (
    "joker.no", "coop.no", "rema.no", "rema1000.no", "kiwi.no", "meny.no", "spar.no", "eurospar.no", "extra.no", "obs.no", "obsbygg.no", "europris.no", "7-eleven.no", "narvesen.no", "circlek.no",
    "mcdonalds.no", "burgerking.no", "peppes.no", "dominos.no", "sats.no", "elixia.no", "bestseller.com", "thon.no", "choice.no", "nordicchoicehotels.no", "scandichotels.no", "obos.no", "usbl.no", "styrerommet.no",
)
LISTINGS = (
    "fixit.no", "timma.no", "ledigtime.no", "bestille.no", "mittanbud.no", "finn.no", "gulesider.no", "1881.no", "proff.no", "purehelp.no", "facebook.com", "instagram.com", "linkedin.com", "linktr.ee", "youtube.com",
    "tiktok.com", "x.com", "wix.com", "wixsite.com", "weebly.com", "squarespace.com", "wordpress.com", "google.com", "goo.gl", "bit.ly", "odoo.com", "myshopify.com", "webnode.no", "webnode.com", "jimdofree.com",
    "jimdosite.com", "adobe.com", "myportfolio.com", "one.com", "domeneshop.no", "webhuset.no", "godaddy.com", "sedo.com",
)


def listed(domain: Column, hosts: Sequence[str] = LISTINGS) -> Column:
    """Whether a registered domain is one of a list; false for null."""
    return F.coalesce(F.lower(domain).isin(*hosts), F.lit(False))


def candidates(sources: Sequence[tuple[str, DataFrame]], shut_out: Sequence[str] = LISTINGS) -> DataFrame:
    """org, host, source and rank: for each organisation and host the first source that names it.

    sources: name and (org, host) in their order; hosts that are listed elsewhere are no candidates.
    """
    parts = [rows.select("org", "host", F.lit(i).alias("rank"), F.lit(name).alias("source")) for i, (name, rows) in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where("org is not null and host is not null and host <> ''").where(~listed(F.col("host"), shut_out))
    best = out.groupBy("org", "host").agg(F.min(F.struct("rank", "source")).alias("m"))
    return best.select("org", "host", F.col("m.source").alias("source"), F.col("m.rank").alias("rank"))


def site_state(hosts: Column) -> Column:
    """none, exact (one host) or ambiguous (several), of an array of distinct hosts."""
    return F.when(F.coalesce(F.size(hosts), F.lit(0)) == 0, "none").when(F.size(hosts) == 1, "exact").otherwise("ambiguous")


def relationship(name: Column) -> Column:
    """branch, group or brand, by what a name says of its bearer; null if nothing."""
    low = F.lower(name)
    return F.when(low.rlike(r"\bavd(eling)?\b"), "branch").when(low.rlike(r"\b(konsern|gruppen|group|holding)\b"), "group").when(low.rlike(r"\b(kjede|franchise|butikken)\b"), "brand")
