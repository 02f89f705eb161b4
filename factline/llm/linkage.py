"""Matching of records of several tables without common keys, by a label model over many heuristic matching functions.

Records become profiles of what can be compared: folded name tokens, town, site, organisation number and social page.
Only pairs of profiles of different tables that share a town and at least one blocking key (site, number, social page,
or a name token up to one letter; where the town is unknown, a near name) are candidates; copies of a profile are one. Each matching function votes yes (1), no
(-1) or nothing (0) on a candidate. A generative model with a latent class learns, without labels, how often each
function votes so for matches and for others, and by a maximum spanning tree over the conditional mutual information
which functions depend on each other; its posterior is the confidence of a match.

What votes look like on others is anchored by two sets of pairs that are taken as no matches, as all but a vanishing
part of them are: strangers, which a hash brings together, about one pair for each profile; and rivals, which share a
rare word but have different sites, one pair for each word. Either set weighs half as much as all candidates. The model is fitted on the counts of vote patterns, at most 3 to the power of the number of functions rows, which is
all that the driver gets. In blocks of more than BLOCK profiles it is fitted on the pairs with a second key in common only;
all others are voted on and graded as well, with a share of matches of their own. A record without a town takes the only town known for its site, number, social page or full
name, or where none of them tells a town the only one of the names near its own; if there are several it stays unknown
and can only match records whose town is unknown too.

Nulls abstain. Records without any key have no candidates. Repeated records are one. Blocks are joined with salts, and
pairs of profiles are spread over the records that have them only at the end.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_join, hot_keys
from ..runtime import bounded_broadcast, materialize

# Legal forms and fillers in names.
FILLERS = frozenset("as asa enk da ans sa ba nuf ks norge norway avd avdeling".split())

#: Sites on which a word must be found to be common (a trade's, say, and no name of its own), and the part of all sites.
COMMON_SITES, COMMON_PART = 5, 1 / 2000
#: Without sites: beginnings (of three letters) of the words that a common word is found with, in all and by its names.
COMMON_OTHERS, COMMON_OTHERS_PART = 8, 0.4
#: Part of a common word's sites that another one must share with it, never in one name, to be the same word in another language.
SAME_PART, SAME_SITES = 0.4, 3
#: A host lists others if no word of its own is in more than this part of the names found with it, and it has so many names.
LISTS_PART, LISTS_NAMES = 0.3, 8
#: Profiles of a block beyond which pairs without a second key in common are graded, but the model isn't fitted on them.
BLOCK = 200
#: Profiles of a block that are paired in one part with the others; those of a larger block are spread over more parts.
PART = 500
#: Towns that may be looked for at the end of names; more would be no list to send to the workers. More directories are a table.
MAX_TOWNS = 50_000
THRESHOLD = 0.5


class Vocabulary:
    """What the records tell of words and hosts: common words, each with the one that stands for it, and hosts that list others.

    Its size is bounded: a common word is found on at least COMMON_PART of all sites, and of more than MAX_TOWNS directories
    all are in the table many (host), which workers don't get.
    """

    def __init__(self, common: dict[str, str] | None = None, directories: frozenset[str] = frozenset(), many: DataFrame | None = None):
        self.common = common or {}
        self.directories = directories
        self.many = many
        self._known: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "many": None}

    def standard(self, word: str) -> str:
        """The common word that a word is, or is an abbreviation or a misspelling of; '' for fillers; else the word."""
        if word in FILLERS or len(word) < 2:
            return ""
        if word in self.common:
            return self.common[word]
        if word not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            near_ones = {t for w, t in self.common.items() if (len(word) >= 3 and w.startswith(word)) or (len(word) >= 4 and len(w) >= 4 and near(word, w))}
            self._known[word] = near_ones.pop() if len(near_ones) == 1 else "" if len(word) <= 4 and any(near(word, f) for f in FILLERS) else word
        return self._known[word]

    def rare(self, words: list[str]) -> list[str]:
        """The words that aren't common."""
        return [w for w in words if w not in self.common]


def fold(text: str | None) -> str:
    """Lower case, without accents, other signs as single spaces; æ and ae are one letter, e, as one slip makes them."""
    text = (text or "").lower().replace("æ", "ae").replace("ø", "o").replace("å", "a").replace("&", " og ")
    return " ".join(re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()).replace("ae", "e").split())


def site(url: str | None) -> str:
    """The host without www; '' for null and what is no host."""
    if not url:
        return ""
    host = re.split(r"[/?#:]", re.sub(r"^www\.", "", re.sub(r"^[a-z]+://", "", url.strip().lower())))[0]
    return "" if "." not in host else host


def near(a: str, b: str) -> bool:
    """Whether two words differ by at most one letter left out, added, changed, or two that changed places."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])


def name_words(name: str | None, towns: frozenset[str]) -> tuple[list[str], str]:
    """The name's words, and the town at its end."""
    words, town = fold(name).split(), ""
    for n in (3, 2, 1):
        if len(words) > n and " ".join(words[-n:]) in towns:
            town, words = " ".join(words[-n:]), words[:-n]
            break
    return words, town


def name_tokens(name: str | None, towns: frozenset[str], v: Vocabulary) -> tuple[list[str], str]:
    """The name's words without legal form, common words in one form; the town at its end."""
    words, town = name_words(name, towns)
    return [w for w in map(v.standard, words) if w], town


def learn(rows: DataFrame, towns: frozenset[str]) -> Vocabulary:
    """The vocabulary of rows (name, urls): counts are combined on the map side, and only what is common, whose number is
    bounded, comes to the driver. A word is common by the sites of its names, or as it is found with very different words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, urls in b.itertuples(index=False, name=None):
                words = " ".join(sorted({w for w in name_words(name, towns)[0] if w not in FILLERS and len(w) > 1}))
                out += [(h, words) for h in {site(u) for u in (() if urls is None else urls) if u} | {""} if words]
            yield pd.DataFrame(out, columns=["host", "words"])

    found = materialize(rows.select("name", "urls").mapInPandas(run, "host string, words string").distinct(), "names-by-site")
    named, names = found.where("host <> ''"), found.where("host = ''")  # every name is there once without a host
    word = names.select("words", F.explode(F.split("words", " ")).alias("word"))
    other = F.explode(F.transform(F.array_remove(F.split("words", " "), F.col("word")), lambda w: F.substring(w, 1, 3)))
    kinds = word.select("word", other.alias("o")).groupBy("word").agg(F.count_distinct("o").alias("others"))
    varied = word.groupBy("word").agg(F.count("*").alias("n")).join(kinds.where(F.col("others") >= COMMON_OTHERS), "word")
    varied = varied.where((F.col("others") >= names.count() * COMMON_PART) & (F.col("others") >= F.col("n") * COMMON_OTHERS_PART))
    by_word = named.select("host", "words", F.explode(F.split("words", " ")).alias("word"))
    in_names = by_word.groupBy("host", "word").agg(F.count("*").alias("n"))
    whole = named.groupBy("host").agg(F.count("*").alias("names"))
    most = in_names.groupBy("host").agg(F.max("n").alias("most"))
    lists = whole.where(F.col("names") >= LISTS_NAMES).join(most, "host").where(F.col("most") < F.col("names") * LISTS_PART)
    lists = materialize(lists.select("host"), "directories")
    hosts = frozenset(r["host"] for r in lists.limit(MAX_TOWNS + 1).collect())
    directories, all_of_them = (hosts, None) if len(hosts) <= MAX_TOWNS else (frozenset(), lists)
    own = in_names.join(lists, "host", "left_anti")
    least = max(COMMON_SITES, whole.count() * COMMON_PART)
    sites = {r["word"]: r["n"] for r in own.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}  # at most words per site / COMMON_PART
    for r in varied.collect():  # each of them is in a part of COMMON_PART of all names at least
        sites.setdefault(r["word"], 0)
    if not sites:
        return Vocabulary({}, directories, all_of_them)
    counts = bounded_broadcast(rows.sparkSession.createDataFrame(list(sites), "string").withColumnRenamed("value", "word"))
    common = by_word.join(lists, "host", "left_anti").join(counts, "word")
    per_site = common.groupBy("host").agg(F.collect_set("word").alias("w"))
    pairs = per_site.select(F.explode("w").alias("x"), "w").select("x", F.explode("w").alias("y")).where("x < y").groupBy("x", "y").agg(F.count("*").alias("n"))
    together = common.groupBy("host", "words").agg(F.collect_set("word").alias("w")).select(F.explode("w").alias("x"), "w").select("x", F.explode("w").alias("y")).where("x < y").groupBy("x", "y").agg(F.count("*").alias("both"))
    found = pairs.where(F.col("n") >= SAME_SITES).join(together, ["x", "y"], "left").where("both is null or both * 10 < n").collect()  # of common words only
    stands = {w: w for w in sites}
    for r in sorted(found, key=lambda r: (-r["n"], r["x"], r["y"])):
        few, many = sorted((r["x"], r["y"]), key=lambda w: (sites[w], w))
        if r["n"] >= SAME_PART * sites[few] and stands[few] == few:
            stands[few] = stands[many]
    return Vocabulary(stands, directories, all_of_them)


def same_word(a: str, b: str, v: Vocabulary) -> bool:
    """Equal, one letter off in words of five letters or more, or the other's beginning as an abbreviation."""
    if a == b:
        return True
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return (len(short) >= 5 and near(a, b)) or (len(short) >= 3 and long.startswith(short) and long in v.common)


_PROFILE = "src string, key string, profile string, name string, town string, site string, orgnr string, social string"


def profiles(rows: DataFrame, towns: frozenset[str], v: Vocabulary) -> DataFrame:
    """Profiles of rows (src, key, name, town, urls array, orgnr, social); town is folded, '' where unknown.

    site holds all of a record's sites but directories, with spaces between.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for src, key, name, town, urls, orgnr, social in b.itertuples(index=False, name=None):
                words, end = name_tokens(name, towns, v)
                urls = [] if urls is None else [u for u in urls if u]
                branch = next((m.group(1).replace("-", " ") for u in urls if (m := re.search(r"/avdelinger/([^/?#]+)", u.lower()))), "")
                host = " ".join(sorted({site(u) for u in urls} - {""} - v.directories))
                place = fold(town) or end or (branch if branch in towns else "")
                number = re.sub(r"\D", "", orgnr or "")
                page = re.sub(r"^https?://", "", (social or "").lower()).rstrip("/")
                feature = (" ".join(words), place, host, number if len(number) == 9 else "", page)
                out.append((src, key, "|".join(feature), *feature))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PROFILE.split(", ")])

    out = rows.mapInPandas(run, _PROFILE)
    return out if v.many is None else _without_hosts(materialize(out, "with-directories"), v.many)


def _without_hosts(profile: DataFrame, hosts: DataFrame) -> DataFrame:
    """profile rows whose site lacks the hosts of a table."""
    each = materialize(profile.where("site <> ''").select("site").distinct().select("site", F.explode(F.split("site", " ")).alias("host")), "sites")
    own = hot_join(each, hosts.withColumn("listed", F.lit(True)), "host", how="left").where("listed is null")
    kept = own.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("host")), " ").alias("kept"))
    out = hot_join(profile, kept, "site", how="left").withColumn("site", F.coalesce("kept", F.lit("")))
    names = [c.split()[0] for c in _PROFILE.split(", ")]
    return out.withColumn("profile", F.concat_ws("|", *names[3:])).select(*names)


def company_keys(sites: str, orgnr: str, social: str, name: str, v: Vocabulary) -> list[str]:
    """Keys that tell a company: its site, number, social page, and its whole name of two words or more."""
    keys = ["d:" + d for d in sites.split()] + [k + x for k, x in (("o:", orgnr), ("s:", social)) if x]
    words = sorted(set(name.split()))
    if v.rare(words) and len(words) > 1:
        keys.append("n:" + " ".join(words))
    return keys


def cut_keys(name: str, v: Vocabulary) -> dict[str, str]:
    """Words that aren't common, and long ones with each letter left out, so that words one letter apart share a key;
    a name of common words only is a key as a whole. With each key the first place of the letter left out and the letter:
    of one key they are the same only for the same word. '' for a whole word, and where several words give the key."""
    words = name.split()
    own = v.rare(words)
    out = dict.fromkeys(("w:" + w for w in own), "") or ({"w:" + " ".join(sorted(set(words))): ""} if words else {})
    for w in own:
        for i in range(len(w) if len(w) >= 5 else 0):
            if not i or w[i] != w[i - 1]:
                key, cut = "w:" + w[:i] + w[i + 1 :], f"{i}{w[i]}"
                out[key] = cut if out.get(key, cut) == cut else ""
    return out


def word_keys(name: str, v: Vocabulary) -> list[str]:
    """The keys of cut_keys alone."""
    return sorted(cut_keys(name, v))


def _keyed(profile: DataFrame, words: bool, v: Vocabulary) -> DataFrame:
    """profile, src, town, key and what was cut from a word for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, src, town, name, host, orgnr, social in b.itertuples(index=False, name=None):
                keys = dict.fromkeys(company_keys(host, orgnr, social, name, v), "")
                if words and town:
                    keys |= cut_keys(name, v)
                out += [(p, src, town, k, cut) for k, cut in keys.items()]
            yield pd.DataFrame(out, columns=["profile", "src", "town", "block", "cut"])

    return profile.select("profile", "src", "town", "name", "site", "orgnr", "social").mapInPandas(run, "profile string, src string, town string, block string, cut string")


def _named(names: DataFrame, v: Vocabulary) -> DataFrame:
    """The rows of names (name and others) for each of its word keys, as block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(block=[word_keys(n, v) for n in b["name"]]).explode("block").dropna(subset=["block"])

    return names.mapInPandas(run, ", ".join(f"{c} string" for c in (*names.columns, "block")))


def _near_towns(profile: DataFrame, lacking: DataFrame, v: Vocabulary) -> DataFrame:
    """name and only: the town of the names near that of a row of lacking, where they agree on one.

    Names that have all words in common come before those of which one lacks the trade. Each name is compared once,
    however many profiles have it.
    """
    known = profile.where("town <> '' and name <> ''").groupBy("name").agg(F.min("town").alias("a"), F.max("town").alias("b"))
    known = materialize(_named(known, v).withColumnRenamed("name", "other"), "known-names")
    pairs = hot_join(known, _named(lacking.where("name <> ''").select("name").distinct(), v), "block").select("name", "other", "a", "b").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(vote=[near_names(x, y, v) for x, y in zip(b["name"], b["other"], strict=True)])[["name", "vote", "a", "b"]]

    near = pairs.mapInPandas(run, "name string, vote int, a string, b string").where("vote > 0")
    towns = near.groupBy("name", "vote").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    best = towns.groupBy("name").agg(F.max_by(F.struct("a", "b"), "vote").alias("t"))
    return best.where("t.a = t.b").select("name", F.col("t.a").alias("only"))


def settle_towns(profile: DataFrame, v: Vocabulary) -> DataFrame:
    """profile rows with town filled in where only one is known for the company, and seen, whether it was its own."""
    keys = materialize(_keyed(profile, False, v), "company-keys")
    known = keys.where("town <> ''").groupBy("block").agg(F.min("town").alias("a"), F.max("town").alias("b")).where("a = b").select("block", F.col("a").alias("only"))
    lacking = hot_join(keys.where("town = ''").select("src", "profile", "block"), known, "block")
    exact = materialize(lacking.groupBy("src", "profile").agg(F.min("only").alias("a"), F.max("only").alias("b")), "company-towns")
    rest = materialize(profile.where("town = ''").join(exact, ["src", "profile"], "left_anti").select("src", "profile", "name"), "without-town")
    near = hot_join(rest, _near_towns(profile, rest, v), "name").select("src", "profile", "only")
    filled = exact.where("a = b").select("src", "profile", F.col("a").alias("only")).unionByName(near)
    out = profile.join(filled, ["src", "profile"], "left").withColumn("seen", F.col("town") != "")
    return out.withColumn("town", F.when(F.col("town") != "", F.col("town")).otherwise(F.coalesce("only", F.lit("")))).drop("only")


def _agree(a: str, b: str) -> int:
    """Whether two lists of values (with spaces between) have one in common; nothing if either is empty."""
    return 0 if not a or not b else 1 if a == b or set(a.split()) & set(b.split()) else -1


def _vote_name(a: list[str], b: list[str], v: Vocabulary) -> int:
    """1 if the words of both go together, 0 if one name has words besides the other's, -1 if both do."""
    if not a or not b:
        return 0
    left = [x for x in a if not any(same_word(x, y, v) for y in b)]
    right = [y for y in b if not any(same_word(x, y, v) for x in a)]
    if len(left) == len(a):
        return -1
    return 1 if not left and not right else -1 if left and right else 0


def _vote_exact(a: list[str], b: list[str]) -> int:
    return 0 if not a or not b else 1 if sorted(a) == sorted(b) else 0


def _grams(words: list[str]) -> set[str]:
    text = " ".join(sorted(words))
    return {text[i : i + 3] for i in range(max(1, len(text) - 2))}


def _vote_grams(a: list[str], b: list[str]) -> int:
    """By the share of letter triples in common."""
    if not a or not b:
        return 0
    x, y = _grams(a), _grams(b)
    share = len(x & y) / len(x | y)
    return 1 if share >= 0.6 else -1 if share < 0.25 else 0


def _vote_label(words: list[str], host: str, v: Vocabulary) -> int:
    """Whether the other's site spells the name: all words 1, no word that isn't a trade -1."""
    if not words or not host:
        return 0
    label = host.split(".")[0].replace("-", "").replace("ae", "e")
    own = v.rare(words)
    hit = [w for w in words if w in label or any(near(w, label[i : i + n]) for n in (len(w) - 1, len(w), len(w) + 1) for i in range(len(label) - n + 1) if len(w) >= 5)]
    if own and not any(w in hit for w in own):
        return -1
    if len(hit) == len(words):
        return 1
    return -1 if any(w in v.common and len(w) > 2 and w not in hit for w in words) else 0


def _vote_rare(a: list[str], b: list[str], v: Vocabulary) -> int:
    """The words that aren't common alone: equal, or different."""
    x, y = v.rare(a), v.rare(b)
    if not x or not y:
        return 0
    return 1 if set(x) & set(y) else 0 if any(same_word(p, q, v) for p in x for q in y) else -1


def _vote_trade(a: list[str], b: list[str], v: Vocabulary) -> int:
    """The common words alone (but for the shortest): one in common, or different ones."""
    x, y = [w for w in a if w in v.common and len(w) > 2], [w for w in b if w in v.common and len(w) > 2]
    return 0 if not x or not y else 1 if set(x) & set(y) else -1


def near_names(a: str, b: str, v: Vocabulary) -> int:
    """2 if the words of both go together, 1 if their words that aren't common do and one of them has no common one, else 0."""
    x, y = a.split(), b.split()
    if _vote_name(x, y, v) == 1:
        return 2
    rare = _vote_name(v.rare(x), v.rare(y), v)
    return 1 if rare == 1 and _vote_trade(x, y, v) == 0 else 0


FUNCTIONS = ("site", "orgnr", "social", "name", "exact", "grams", "label", "rare", "trade", "town")


def votes(a: tuple, b: tuple, v: Vocabulary) -> tuple[int, ...]:
    """Votes of all functions on two profiles (name, site, orgnr, social, seen)."""
    x, y = a[0].split(), b[0].split()
    labels = {_vote_label(words, host, v) for words, sites in ((x, b[1]), (y, a[1])) for host in sites.split()}
    label = 1 if 1 in labels and -1 not in labels else -1 if labels and labels <= {-1} else 0
    return (_agree(a[1], b[1]), _agree(a[2], b[2]), _agree(a[3], b[3]), _vote_name(x, y, v), _vote_exact(x, y), _vote_grams(x, y), label, _vote_rare(x, y, v), _vote_trade(x, y, v), 1 if a[4] and b[4] else 0)


class LabelModel:
    """A latent class with a tree of dependences over the votes, fitted by expectation maximisation on pattern counts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, others: np.ndarray, rounds: int = 100, prior: float = 2.0):
        self.x = patterns.astype(int) + 1  # 0 no, 1 nothing, 2 yes
        self.n, self.others = counts.astype(float), others.astype(float)  # of candidates, and of pairs known to be no matches
        self.prior = prior
        self.parent = [-1] * self.x.shape[1]
        start = patterns.sum(axis=1) / np.sqrt(np.maximum(1, np.abs(patterns).sum(axis=1)))
        self.post = 1 / (1 + np.exp(-2.0 * start))
        for tree in (False, True):
            if tree:
                self.parent = self._tree()
            for _ in range(rounds):
                before = self.post
                self._maximise()
                self.post = self._posterior(self.x)
                if np.abs(before - self.post).max() < 1e-6:
                    break

    def _weights(self) -> np.ndarray:
        return np.stack([self.n * (1 - self.post) + self.others, self.n * self.post])

    def _tree(self) -> list[int]:
        """Each function's parent in the maximum spanning tree over the mutual information given the class."""
        w, m = self._weights(), self.x.shape[1]
        gain = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                for c in (0, 1):
                    joint = np.zeros((3, 3))
                    np.add.at(joint, (self.x[:, i], self.x[:, j]), w[c])
                    if joint.sum() > 0:
                        p = joint / joint.sum()
                        q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
                        gain[i, j] += w[c].sum() / w.sum() * np.sum(p[p > 0] * np.log(p[p > 0] / q[p > 0]))
        gain += gain.T
        parent, left = [-1] * m, set(range(1, m))
        inside = {0}
        while left:
            i, j = max(((i, j) for i in inside for j in left), key=lambda e: (gain[e], -e[1]))
            if gain[i, j] > 0.02:
                parent[j] = i
            inside.add(j)
            left.discard(j)
        return parent

    def _maximise(self) -> None:
        w = self._weights()
        self.share = (w[1].sum() + 1) / (self.n.sum() + 2)  # among candidates
        self.tables = []
        for f, p in enumerate(self.parent):
            size = 3 if p >= 0 else 1
            above = self.x[:, p] if p >= 0 else np.zeros(len(self.x), int)
            t = np.empty((2, size, 3))
            for c in (0, 1):
                alone = np.array([3.0, 1.0, 1.0]) if c == 0 else np.array([1.0, 1.0, 3.0])  # functions are better than chance
                np.add.at(alone, self.x[:, f], w[c])
                alone /= alone.sum()
                cells = np.tile(alone * self.prior, (size, 1))
                np.add.at(cells, (above, self.x[:, f]), w[c])
                t[c] = cells / cells.sum(axis=1, keepdims=True)
            self.tables.append(t)

    def _posterior(self, x: np.ndarray) -> np.ndarray:
        log = np.stack([np.full(len(x), np.log(1 - self.share)), np.full(len(x), np.log(self.share))])
        for f, p in enumerate(self.parent):
            above = x[:, p] if p >= 0 else np.zeros(len(x), int)
            for c in (0, 1):
                log[c] += np.log(self.tables[f][c][above, x[:, f]])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


    def among(self, patterns: np.ndarray, counts: np.ndarray, most: float = 1.0, rounds: int = 1000) -> np.ndarray:
        """The posterior of patterns among other pairs, so many of each: functions vote as they do on candidates, but the
        share of matches is that of these pairs, fitted by expectation maximisation, and at most most or the candidates'."""
        first = self._posterior(patterns.astype(int) + 1)
        most = max(1e-12, min(self.share, most))
        log = np.log(np.clip(first, 1e-22, 1)) - np.log(np.clip(1 - first, 1e-22, 1)) - np.log(self.share / (1 - self.share))
        share = most
        for _ in range(rounds):
            post = 1 / (1 + np.exp(-np.clip(log + np.log(share / (1 - share)), -50, 50)))
            before, share = share, min(most, ((counts * post).sum() + 1) / (counts.sum() + 2))
            if not counts.sum() or abs(before - share) < 1e-9:
                break
        return post


def calibrated(post: np.ndarray, factor: float) -> np.ndarray:
    """Posteriors whose log odds are scaled."""
    odds = np.log(np.clip(post, 1e-15, 1 - 1e-15)) - np.log(np.clip(1 - post, 1e-15, 1 - 1e-15))
    return 1 / (1 + np.exp(-factor * odds))


FROM_NAMES = ("name", "exact", "grams", "rare", "trade")


def calibration(x: np.ndarray, n: np.ndarray, model: LabelModel) -> float:
    """The factor for log odds that makes confidences say how often they are right, at most 1.

    Where both records have a site, whether it is the same tells nearly always whether they match: the log odds that the
    functions on names alone give are held against it, and the factor with the greatest likelihood is taken. Correlations
    that the tree has no place for make it less than 1.
    """
    names = [FUNCTIONS.index(f) for f in FROM_NAMES]
    told = (x[:, 0] != 0) & (n > 0)
    if not told.any() or len({*x[told, 0]}) < 2:
        return 1.0
    y, w = x[told, 0] > 0, n[told]
    odds = sum(np.log(_row(model, f, 1, x[told])) - np.log(_row(model, f, 0, x[told])) for f in names)
    shift = np.log(max(1e-9, (w * y).sum()) / max(1e-9, (w * ~y).sum()))
    best, least = 1.0, np.inf
    for factor in np.linspace(0.05, 1.0, 39):
        for move in (0.0, shift / 2, shift):
            z = np.clip(factor * odds + move, -50, 50)
            loss = (w * np.logaddexp(0, np.where(y, -z, z))).sum()
            if loss < least:
                best, least = float(factor), loss
    return best


def _row(model: LabelModel, f: int, c: int, x: np.ndarray) -> np.ndarray:
    """How likely function f's votes are in class c."""
    p = model.parent[f]
    return model.tables[f][c][x[:, p] + 1 if p >= 0 else np.zeros(len(x), int), x[:, f] + 1]


def _blocks(profile: DataFrame, v: Vocabulary, block: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows (at, block, cut, src, id) of all blocks, and the blocks (at) of more than block profiles, None if there are none."""
    keys = _keyed(profile.select(F.col("id").cast("string").alias("profile"), "src", "town", "name", "site", "orgnr", "social"), True, v)
    keys = materialize(keys.withColumn("at", F.concat_ws("@", "block", "town")).select("at", "block", "cut", "src", F.col("profile").cast("long").alias("id")), "blocks")
    large = materialize(keys.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > block).select("at"), "large-blocks")
    return keys, None if large.isEmpty() else large


def _paired(keys: DataFrame) -> DataFrame:
    """a, b: pairs of profile numbers of different tables in one block (several times if they share several).

    Profiles with the same word meet at that word and not again at each key cut from it. Large blocks are spread.
    """
    left = keys.where("src <> 'place'").select("at", F.col("cut").alias("ca"), F.col("src").alias("sa"), F.col("id").alias("a"))
    right = keys.where("src <> 'ad'").select("at", F.col("cut").alias("cb"), F.col("src").alias("sb"), F.col("id").alias("b"))
    pairs = hot_join(left, right, "at", hot_keys(left, "at", PART))
    return pairs.where("sa < sb and (ca = '' or cb = '' or ca <> cb)").select("a", "b")


def _candidates(profile: DataFrame, v: Vocabulary, block: int = BLOCK, blocks: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """a, b: pairs of profile numbers of different tables that share a town and a key, or a near name if both towns are unknown.

    In a block of more than block profiles nearly all pairs are no matches, and the model would take what they have in
    common for a match: there a second key in common is asked for, so each block is parted by the other keys of its
    profiles (and one that has no other is paired by its whole name). The pairs left out are those of _crowded.
    """
    keys, large = blocks or _blocks(profile, v, block)
    if large is not None:
        crowded = hot_join(keys, large, "at")
        second = keys.where("block not like 'w:%'").select("id", F.col("block").alias("more"))
        words = profile.where("name <> ''").select("id", F.explode(F.split("name", " ")).alias("more")).unionByName(profile.where("name <> ''").select("id", F.concat(F.lit("n:"), F.array_join(F.array_sort(F.split("name", " ")), " ")).alias("more")))
        parted = crowded.join(second.unionByName(words).distinct(), "id").where("block <> more and not (block like 'w:%' and levenshtein(substr(block, 3), more) <= 1)")
        parted = parted.select(F.concat_ws("&", "at", "more").alias("at"), F.lit("").alias("cut"), "src", "id")
        keys = materialize(keys.join(bounded_broadcast(large), "at", "left_anti").select("at", "cut", "src", "id").unionByName(parted).distinct(), "parted-blocks")
    return _paired(keys).unionByName(_near_without_town(profile, v)).distinct()


def _crowded(blocks: tuple[DataFrame, DataFrame | None]) -> DataFrame | None:
    """a, b: all pairs of the large blocks, with a second key in common or not; None if no block is large."""
    keys, large = blocks
    return None if large is None else _paired(materialize(hot_join(keys, large, "at"), "crowded")).distinct()


def _near_without_town(profile: DataFrame, v: Vocabulary) -> DataFrame:
    """a, b: pairs of profile numbers of different tables without town whose names are near."""
    rows = profile.where("town = '' and name <> ''")
    keys = materialize(_named(rows.select("name", "src", F.col("id").cast("string").alias("id")), v), "words-without-town")
    left = keys.select("block", F.col("src").alias("sa"), F.col("id").cast("long").alias("a"), F.col("name").alias("x"))
    right = keys.where("src <> 'ad'").select("block", F.col("src").alias("sb"), F.col("id").cast("long").alias("b"), F.col("name").alias("y"))
    pairs = hot_join(left, right, "block").where("sa < sb").select("a", "b", "x", "y").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[near_names(x, y, v) > 0 for x, y in zip(b["x"], b["y"], strict=True)], ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _strangers(profile: DataFrame) -> DataFrame:
    """a, b: about one pair for each profile, of different tables, brought together by a hash."""
    buckets = max(1, profile.count() // 3)
    place = F.pmod(F.xxhash64(F.lit("stranger"), "id"), F.lit(buckets).cast("long"))
    left = profile.select(place.alias("at"), F.col("src").alias("sa"), F.col("id").alias("a"))
    right = profile.where("src <> 'ad'").select(place.alias("at"), F.col("src").alias("sb"), F.col("id").alias("b"))
    return left.join(right, "at").where("sa < sb").select("a", "b")


def _rivals(profile: DataFrame, v: Vocabulary) -> DataFrame:
    """a, b: for each word that isn't common the profiles with the first and the last of the sites of names with it."""
    word = F.explode(F.split("name", " ")).alias("word")
    rows = profile.where("site <> ''").select("id", "site", word).where(F.length("word") >= 5).where(~F.col("word").isin(*sorted({"", *v.common})))
    ends = rows.groupBy("word").agg(F.min(F.struct("site", "id")).alias("x"), F.max(F.struct("site", "id")).alias("y"))
    return ends.where("x.site <> y.site").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _count_votes(pairs: DataFrame, v: Vocabulary) -> DataFrame:
    """a, b, kind, pattern (one letter for each function)."""
    cols = ["name", "site", "orgnr", "social", "seen"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(*[batch[f"{c}_a"] for c in cols], strict=True), zip(*[batch[f"{c}_b"] for c in cols], strict=True)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "kind": batch["kind"], "pattern": ["".join("-0+"[n + 1] for n in votes(x, y, v)) for x, y in zip(*rows, strict=True)]})

    return pairs.mapInPandas(run, "a long, b long, kind string, pattern string")


def matches_expected(found: float, profiles: int, blocks: tuple[DataFrame, DataFrame]) -> float:
    """How many matches the profiles of large blocks have if they have as many as any: of so many profiles, so many are found."""
    return found / max(1, profiles) * blocks[0].join(blocks[1], "at", "left_semi").select("id").distinct().count()


def link(rows: DataFrame, towns: frozenset[str], threshold: float = THRESHOLD) -> DataFrame:
    """key_1, key_2 (the smaller first) and confidence of records of different tables that match.

    rows: src (ad, osm, place), key, name, town, urls (array), orgnr, social.
    """
    spark: SparkSession = rows.sparkSession
    rows = materialize(rows.where("key is not null").distinct(), "rows")
    v = learn(rows, towns)
    records = materialize(profiles(rows, towns, v), "records")
    distinct = records.groupBy("src", "profile").agg(*[F.first(c).alias(c) for c in ("name", "town", "site", "orgnr", "social")])
    settled = materialize(settle_towns(distinct, v).withColumn("id", F.xxhash64("src", "profile")), "profiles")
    blocks = _blocks(settled, v, BLOCK)
    pairs, crowded = _candidates(settled, v, blocks=blocks).withColumn("kind", F.lit("candidate")), _crowded(blocks)
    if crowded is not None:
        pairs = pairs.unionByName(crowded.withColumn("kind", F.lit("crowded"))).groupBy("a", "b").agg(F.min("kind").alias("kind"))  # a candidate is none of the rest
    pairs = pairs.unionByName(_strangers(settled).withColumn("kind", F.lit("stranger"))).unionByName(_rivals(settled, v).withColumn("kind", F.lit("rival")))
    pairs = materialize(pairs, "pairs")
    hot = {s: hot_keys(pairs, s) for s in ("a", "b")}
    compared = pairs
    for s in ("a", "b"):
        side = settled.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("name", "site", "orgnr", "social", "seen")])
        compared = hot_join(compared, side, s, hot[s])
    voted = materialize(_count_votes(compared, v), "votes")
    kinds = ("candidate", "stranger", "rival", "crowded")
    counted = voted.groupBy("pattern").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    counts = sorted(counted.collect())  # at most 3 ** len(FUNCTIONS) rows
    n = np.array([[r[k] for k in kinds] for r in counts], float).reshape(-1, len(kinds))
    if not n[:, [0, 3]].sum():
        return spark.createDataFrame([], "key_1 string, key_2 string, confidence double")
    if not n[:, 0].sum():  # nothing but large blocks
        n[:, 0] = n[:, 3]
    x = np.array([["-0+".index(c) - 1 for c in r["pattern"]] for r in counts])
    others = sum(n[:, i] * n[:, 0].sum() / 2 / max(1.0, n[:, i].sum()) for i in (1, 2))
    fitted = n[:, :3].sum(axis=1) > 0
    model = LabelModel(x[fitted], n[fitted, 0], others[fitted])
    factor = calibration(x[fitted], n[fitted, 0], model)
    sure = model._posterior(x + 1)
    most = 1.0 if crowded is None else matches_expected(n[:, 0] @ sure, settled.count(), blocks) / max(1.0, n[:, 3].sum())
    graded = [(r["pattern"], kind, float(p)) for kind, post in (("candidate", sure), ("crowded", model.among(x, n[:, 3], most))) for r, p in zip(counts, calibrated(post, factor), strict=True)]
    sure = bounded_broadcast(spark.createDataFrame(graded, "pattern string, kind string, confidence double").where(F.col("confidence") >= threshold))
    good = voted.join(sure, ["pattern", "kind"]).select("a", "b", "confidence")
    names = materialize(records.select(F.xxhash64("src", "profile").alias("id"), "key").distinct(), "keys")
    good = hot_join(good, names.select(F.col("id").alias("b"), F.col("key").alias("key_b")), "b", hot["b"])
    good = hot_join(names.select(F.col("id").alias("a"), F.col("key").alias("key_a")), good, "a")
    out = good.groupBy(F.least("key_a", "key_b").alias("key_1"), F.greatest("key_a", "key_b").alias("key_2")).agg(F.max("confidence").alias("confidence"))
    return out


def establishment_rows(ads: DataFrame, places: DataFrame, features: DataFrame, postal: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """The three tables in one form, and the towns of the postal table (its size is checked)."""
    text = F.lit(None).cast("string")
    codes = postal.where("poststed is not null").groupBy("postnummer").agg(F.min("poststed").alias("poststed"))
    names = codes.select("poststed").distinct().limit(MAX_TOWNS + 1).collect()
    if len(names) > MAX_TOWNS:
        raise ValueError("the postal table has too many towns")
    a = ads.select(F.lit("ad").alias("src"), F.col("uuid").alias("key"), F.col("business_name").alias("name"), F.col("municipal").alias("town"), F.array("employer_homepage").alias("urls"), F.col("employer_orgnr").alias("orgnr"), text.alias("social"))
    digits = F.lpad(F.regexp_replace("postcode", r"\D", ""), 4, "0")
    p = places.withColumn("postnummer", F.when(F.col("postcode").isNotNull(), digits)).join(bounded_broadcast(codes), "postnummer", "left")
    p = p.select(F.lit("place").alias("src"), F.col("id").alias("key"), "name", F.col("poststed").alias("town"), F.from_json("websites", "array<string>").alias("urls"), text.alias("orgnr"), F.get_json_object("socials", "$.facebook").alias("social"))
    o = features.select(F.lit("osm").alias("src"), F.col("osm_id").alias("key"), "name", text.alias("town"), F.array("website").alias("urls"), "orgnr", F.get_json_object("socials", "$.facebook").alias("social"))
    return a.unionByName(p).unionByName(o), frozenset(fold(r["poststed"]) for r in names)
