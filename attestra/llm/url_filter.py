"""URL filtering: host rules, then naive Bayes over the words that hosts and paths are made of.

Rules name a host and the start of a path. A rule fits its host and all subdomains; of those that fit, the longest wins.

Other URLs are judged by a multinomial naive Bayes over tokens. Paths split at everything but letters; so do hosts, and
each part of a host is split further by the most probable segmentation into words under a unigram model (Viterbi), so
that names run together count by their words. Word counts come from all URLs: the parts that hosts and paths delimit
themselves, each distinct host once, and the seed words. A word that no count holds costs more with each letter.

There are no labels for URLs, so the classes are distant ones: URLs whose host is segmented into a seed word train the
blocked class, all others the allowed one, over all URLs. The seeds themselves aren't counted, as their counts would only
say that they are seeds: a seed is evidence of a fixed weight, every other token's odds are counted. What decides is the sum
of the tokens' log odds plus the classes' prior, above a margin; so words that keep company with seeds can block a host
without one, and words of clean sites can outweigh a seed.

Nothing is left out of the counts: words, segmentations, tokens and odds are written tables that grow with the URLs, and
are joined with the distinct hosts and paths. Only sums are collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import materialize

#: Words of unwanted sites, and how many occurrences each adds to the unigram model.
SEEDS = (
    "spam", "casino", "bet", "bets", "betting", "poker", "slots", "jackpot", "gambling", "lottery",
    "pill", "pills", "pharma", "viagra", "cialis", "porn", "xxx", "sex", "adult", "escort",
    "ads", "adserver", "track", "tracker", "tracking", "popup", "clickbait", "malware", "phishing", "warez",
    "torrent", "crack", "keygen", "payday", "loans", "forex", "cheap", "replica",
)
#: Words that names are often run together with.
COMMON = ("farm", "win", "free", "online", "best", "shop", "store", "deal", "deals", "news", "blog", "mail", "play", "game", "games", "site", "web", "net", "my", "the", "and", "for", "king", "world", "top", "club", "live", "zone", "city", "now", "hub")
SEED_WEIGHT, COMMON_WEIGHT = 200, 50
#: Letters of a label of a host name at most, by the standard of names; no word of a host is longer.
LONGEST = 63
#: Log odds of a seed word, and what a URL's sum has to be above.
SEED_ODDS, MARGIN = 4.0, 0.0
#: Occurrences that a token's share among all tokens counts for in either class.
SMOOTHING = 50.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EXACT = "decimal(28,16)"


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or without ://."""
    after = "(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(F.col(url), after, k), F.lit(""))
    return F.translate(get(1), _UPPER, _LOWER), get(2)


def longest_rule(rules: Sequence[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The rule (as host + path) that fits and is the longest, and its verdict; nulls if none. rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


@dataclass
class Words:
    """A unigram model of words."""

    costs: dict[str, float]
    unknown: float

    def split(self, name: str) -> list[str]:
        """The cheapest segmentation of a run of letters; of equal ones that with the longer last word."""
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                cost = best[start] + (self.costs[word] if word in self.costs else self.unknown * (1 + len(word)))
                if cost < best[end]:
                    best[end], back[end] = cost, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


def _runs(text: Column) -> Column:
    """The runs of letters of a text, lower-cased."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def _host_runs(host: str = "host") -> Column:
    """The runs of letters of a host without its port and its last label (the domain's own suffix)."""
    labels = F.split(F.substring_index(host, ":", 1), r"\.")
    return _runs(F.array_join(F.when(F.size(labels) > 1, F.slice(labels, F.lit(1), F.size(labels) - 1)).otherwise(labels), "."))


def fit_words(pairs: DataFrame) -> DataFrame:
    """word and count, written, from distinct pairs(host, path, n): runs of letters of at least two sites, of paths, and the seeds.

    A name that only one site has, on whatever subdomains, may be words run together and is no word.
    """
    sites = pairs.select("host").distinct().select(F.explode(_runs(F.col("host"))).alias("word"), F.substring_index("host", ".", -2).alias("site")).distinct()
    of_hosts = sites.groupBy("word").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    of_paths = pairs.select(F.explode(_runs(F.col("path"))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("count"))
    every = of_hosts.union(of_paths).where(f"length(word) <= {LONGEST}").groupBy("word").agg(F.sum("count").alias("count"))
    counted = materialize(every, "url-counted")
    total = max(1, counted.agg(F.sum("count")).first()[0] or 0)
    # a seed is as common as a hundredth of all words, however large the corpus
    seeds = [(w, max(weight, total * weight // 20_000)) for found, weight in ((SEEDS, SEED_WEIGHT), (COMMON, COMMON_WEIGHT)) for w in found]
    seeded = counted.union(pairs.sparkSession.createDataFrame(seeds, "word string, count bigint"))
    return materialize(seeded.groupBy("word").agg(F.max("count").alias("count")), "url-words")


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """run and words for distinct runs(run): each is joined with the counts of those of its parts that are words."""
    whole = words.agg(F.sum("count")).first()[0]

    def split(names: pa.Array, known: pa.Array) -> pa.Array:
        made = []
        for name, counts in zip(names.to_pylist(), known.to_pylist(), strict=True):
            costs = {c["word"]: math.log(whole / c["count"]) for c in counts or ()}
            made.append(Words(costs, math.log(whole + 1)).split(name))
        return pa.array(made, pa.list_(pa.string()))

    within = f"transform(sequence(1, length(run)), s -> transform(sequence(1, least({LONGEST}, length(run) - s + 1)), k -> substring(run, s, k)))"
    parts_of = runs.select("run", F.explode(F.array_distinct(F.flatten(F.expr(within)))).alias("word"))
    known = parts_of.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("word", "count")).alias("known"))
    return materialize(runs.join(known, "run", "left").select("run", F.arrow_udf(split, T.ArrayType(T.StringType()))("run", "known").alias("words")), "url-segmented")


def fit_bayes(pairs: DataFrame, host_tokens: DataFrame) -> tuple[DataFrame, float]:
    """token and odds of every token, written, and the classes' prior.

    pairs: distinct (host, path, n); host_tokens: host, token and times. Both classes are smoothed towards both together.
    Seeds have fixed odds and aren't counted.
    """
    seeds = [f"h:{w}" for w in SEEDS]
    trained = materialize(host_tokens.where(F.col("token").isin(seeds)).select("host", F.lit(True).alias("seeded")).distinct(), "url-seeded")
    marked = pairs.join(trained, "host", "left").withColumn("seeded", F.coalesce("seeded", F.lit(False)))
    hosts = marked.groupBy("host", "seeded").agg(F.sum("n").alias("n"))
    of_hosts = host_tokens.where(~F.col("token").isin(seeds)).join(materialize(hosts, "url-hosts"), "host").select("token", "seeded", (F.col("times") * F.col("n")).alias("n"))
    of_paths = marked.select(F.explode(_path_tokens()).alias("token"), "seeded", "n")
    of_class = lambda seeded: F.sum(F.when(F.col("seeded") == seeded, F.col("n")).otherwise(0))
    counts = materialize(of_hosts.union(of_paths).groupBy("token").agg(of_class(True).alias("bad"), of_class(False).alias("good")), "url-tokens")
    n_bad, n_good = (x or 0 for x in marked.agg(of_class(True), of_class(False)).first())
    sums = [x or 0 for x in counts.agg(F.sum("bad"), F.sum("good")).first()]
    both = F.lit(SMOOTHING) * (F.col("bad") + F.col("good")) / F.lit(float(max(1, sum(sums))))
    share = lambda c, of: (F.col(c) + both) / F.lit(of + SMOOTHING)
    odds = counts.select("token", F.log(share("bad", sums[0]) / share("good", sums[1])).cast(_EXACT).alias("odds"))
    fixed = pairs.sparkSession.createDataFrame([(t,) for t in seeds], "token string").select("token", F.lit(SEED_ODDS).cast(_EXACT).alias("odds"))
    return materialize(odds.union(fixed), "url-odds"), math.log((n_bad + 1) / (n_good + 1))


def _path_tokens() -> Column:
    return F.transform(_runs(F.col("path")), lambda w: F.concat(F.lit("p:"), w))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages(page_id, url, ...).

    verdict is that of the longest rule that fits, or else block where the classifier says so, or else allow. A null URL,
    or one without ://, has an empty host and path, no rule, and is judged by the classes' prior alone. Rows that repeat
    are judged alike and each count; rules of one length fit one host and path only if they are equal. An empty table gives
    no rows; other columns are not read.
    """
    host, path = parts()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    pairs = materialize(urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "url-pairs")
    runs = materialize(pairs.select("host").distinct().select("host", F.explode(_host_runs()).alias("run")), "url-runs")
    words = segmented(runs.select("run").distinct(), fit_words(pairs))
    of_host = runs.join(words, "run").select("host", F.explode("words").alias("word"))
    host_tokens = materialize(of_host.groupBy("host", F.concat(F.lit("h:"), "word").alias("token")).agg(F.count(F.lit(1)).alias("times")), "url-host-tokens")
    odds, prior = fit_bayes(pairs, host_tokens)

    # sums of decimals don't depend on the order of their rows
    of_hosts = host_tokens.join(odds, "token").groupBy("host").agg(F.sum(F.col("odds") * F.col("times")).cast(_EXACT).alias("of_host"))
    of_paths = pairs.select("path").distinct().select("path", F.explode(_path_tokens()).alias("token")).join(odds, "token").groupBy("path").agg(F.sum("odds").cast(_EXACT).alias("of_path"))
    found = urls.join(materialize(of_hosts, "url-of-hosts"), "host", "left").join(materialize(of_paths, "url-of-paths"), "path", "left")
    score = F.lit(prior) + sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("of_host", "of_path")), F.lit(0.0))
    rule, verdict = longest_rule(rules)
    own = F.when(score > MARGIN, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
