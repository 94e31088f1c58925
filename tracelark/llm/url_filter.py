"""URL filter: rules first, then host word segmentation with naive Bayes.

Labels of a host are split into words by a unigram Viterbi search (`cheappills` -> cheap pills); the words
of host and path are scored by a multinomial naive Bayes model. The unigrams come from all documents and all urls and
from the seed names below, each half of the probability: a name of a url counts as a word where the documents' and the
seeds' words don't cover it whole. They are counted, and joined to the names, by Spark; nothing of them comes to the
driver. Letters are those of any script. Words of more than LONGEST letters are known as whole names only. Naive Bayes learns from labelled seed names,
which are a parameter (UrlModel); the defaults are words of the usual block categories and of plain sites. The
rules judge hosts and languages, not words, so the urls that they label are no examples for it.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed.
A word that no seed has is no evidence, so a url of unknown words is allowed. Repeated rows are judged alike; a url of any length
is judged whole. An empty table gives an empty one. Columns of the input named host, path, rule, score and verdict are replaced, all others are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ._rows import col, packed, unpacked
from ._store import durable

#: Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Seed names with their label: what the models learn from.
BLOCKED = """casino bonus|online casino|best casino slots|bets online|sports betting|bet now|poker room|free poker chips|jackpot slots|lucky slots|
pills online|cheap viagra|buy cialis|pharmacy discount|cheap meds|diet pills|weight loss pills|ad server|ads click|click tracker|pixel track|popup ads|banner ads|affiliate offers|
adult video|adult cams|free porn|porn tube|xxx video|sex chat|live sex cams|hot singles|escort girls|nude pics|free download crack|warez crack|torrent crack keygen|serial keys|
payday loans|fast cash loans|easy money now|make money fast|get rich quick|crypto giveaway|free bitcoin|win prize|free prize winner|claim gift card|replica watches|cheap replica bags|essay writing cheap|buy followers|buy likes|spam mail|phish login|malware download|hack tool|seo links cheap"""
ALLOWED = """daily news|city library|school district|open source|public health|local weather|history museum|science journal|world report|music review|art gallery|garden guide|home cooking|travel notes|family recipes|
book club|state university|research institute|medical center|community college|river valley|green energy|sports news|football club|running club|film festival|photo archive|national park|data archive|code forum|help desk|
user manual|developer docs|software project|language school|dictionary online|reference library|encyclopedia project|government office|town hall|court records|tax office|train times|bus routes|bike shop|coffee house|
bakery blog|fashion magazine|kids games|chess club|board games|math lessons|physics lab|chemistry notes|biology class|wild birds|animal rescue|pet care|car repair|house design|free speech|free software|video lessons|
cheap flights|money matters|online courses|download manager|gift shop|watch repair|health news|loans desk library|mail archive|win probability|track field|room design|live music|login help|chat archive|hot springs|blog|www|wiki|shop|store|news|mobile|page|index|article|story|post|archive|about|contact"""


def _seeds(text: str) -> list[list[str]]:
    return [x.split() for x in text.replace("\n", "").split("|")]


#: Letters of the longest word that is looked for within a name.
LONGEST = 24
NO_LETTERS = r"[^\p{L}]+"


class UrlModel:
    """Unigrams for the segmentation, and log odds of each word for naive Bayes (add-alpha smoothing)."""

    def __init__(self, blocked: list[list[str]] | None = None, allowed: list[list[str]] | None = None, alpha: float = 0.5, prior: float = 0.2):
        blocked, allowed = blocked or _seeds(BLOCKED), allowed or _seeds(ALLOWED)
        bad, good = Counter(w for x in blocked for w in x), Counter(w for x in allowed for w in x)
        words = bad.keys() | good.keys()
        total = sum(bad.values()) + sum(good.values())
        self.cost = {w: -math.log((bad[w] + good[w]) / total) for w in words}
        #: A letter outside the words: dearer than any word of that length, so that words win where they fit whole.
        self.letter = 4.0
        self.start = 6.0
        nb, ng = sum(bad.values()) + alpha * len(words), sum(good.values()) + alpha * len(words)
        self.odds = {w: math.log((bad[w] + alpha) / nb) - math.log((good[w] + alpha) / ng) for w in words}
        self.prior = math.log(prior / (1 - prior))
        self.memo: dict[str, list[str]] = {}

    def segment(self, name: str, cost: dict[str, float] | None = None) -> list[str]:
        """The cheapest split of name into known words (the seeds', or those of cost) and runs of unknown letters."""
        if cost is None:
            if name not in self.memo:
                if len(self.memo) > 100_000:
                    self.memo.clear()
                self.memo[name] = self.segment(name, self.cost)
            return self.memo[name]
        longest = max(map(len, cost), default=0)
        n = len(name)
        inf = float("inf")
        # known[i]: name[:i] ends with a known word; loose[i]: it ends within an unknown run
        known, loose = [inf] * (n + 1), [inf] * (n + 1)
        back_k: list = [None] * (n + 1)
        back_l: list = [None] * (n + 1)
        known[0] = 0.0
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                c = cost.get(name[j:i])
                if c is not None:
                    for before, kind in ((known[j], "k"), (loose[j], "l")):
                        if before + c < known[i]:
                            known[i], back_k[i] = before + c, (j, kind)
            for before, kind in ((known[i - 1] + self.start, "k"), (loose[i - 1], "l")):
                if before + self.letter < loose[i]:
                    loose[i], back_l[i] = before + self.letter, (i - 1, kind)
        out, i, kind = [], n, "k" if known[n] <= loose[n] else "l"
        end = n
        while i > 0:
            j, before = (back_k if kind == "k" else back_l)[i]
            if kind == "k" or before == "k":
                out.append(name[j:end])
                end = j
            i, kind = j, before
        out.reverse()
        return out

    def costs(self, name: str, counts: dict[str, int], total: int) -> dict[str, float]:
        """Costs of the counted words of a name, mixed half and half with the seeds'."""
        seeds = {w: math.exp(-c) for w, c in self.cost.items() if w in name}
        return {w: -math.log((counts.get(w, 0) / max(1, total) + seeds.get(w, 0.0)) / 2) for w in counts.keys() | seeds.keys()}


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(u, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _counted(words: Column, frame: DataFrame) -> DataFrame:
    return frame.select(F.explode(words).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def document_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (runs of letters, in lower case) and n over all documents."""
    return _counted(F.split(F.lower(col(text)), NO_LETTERS), docs)


def _names(host: Column, path: Column) -> Column:
    return F.split(F.lower(F.concat(host, F.lit("/"), path)), NO_LETTERS)


def _split(names: DataFrame, words: DataFrame, model: UrlModel) -> DataFrame:
    """names (word, n) with its parts, whether known words cover it whole, and the sum of the parts' log odds."""
    total = words.agg(F.sum("n")).first()[0] or 0
    ends = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("word") - i + 1)), lambda k: F.col("word").substr(i, k))
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), ends))
    pieces = names.select("word", F.explode(F.array_distinct(F.array_append(inner, F.col("word")))).alias("piece"))
    known = pieces.join(words.select(F.col("word").alias("piece"), F.col("n").alias("c")), "piece").groupBy("word")
    known = known.agg(F.map_from_entries(F.collect_list(F.struct("piece", "c"))).alias("known"))

    def parts(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for name, found in it:
            got = []
            for x, f in zip(name, found):
                cost = model.costs(x, dict(f) if f is not None else {}, total)
                out = model.segment(x, cost)
                got.append((out, all(w in cost for w in out), math.fsum(model.odds.get(w, 0.0) for w in out)))
            yield pd.DataFrame(got, columns=["parts", "whole", "odds"])

    cut = F.pandas_udf(parts, "parts array<string>, whole boolean, odds double")
    return names.join(known, "word", "left").withColumn("x", cut("word", "known")).select("word", "n", "x.parts", "x.whole", "x.odds")


def filter_urls(pages: DataFrame, column: str = "url", rules=RULES, model: UrlModel | None = None, words: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, score (log odds of block) and verdict; columns of these names are replaced.

    words: word and n, counted besides the names of the urls (see document_words).
    """
    model = model or UrlModel()
    src = packed(pages, url=col(column))
    names = durable(_counted(_names(*host_and_path(F.col("url"))), src), "url_names")
    words = pages.sparkSession.createDataFrame([], "word string, n long") if words is None else durable(words, "url_words")
    first = _split(names, words, model).select(F.explode(F.when(F.col("whole"), F.col("parts")).otherwise(F.array("word"))).alias("word"), "n")
    words = durable(words.unionByName(first).groupBy("word").agg(F.sum("n").alias("n")), "url_unigrams")
    odds = durable(_split(names, words, model).where("odds != 0").select("word", "odds"), "url_odds")
    urls = src.select("url").distinct()
    urls = urls.select("url", F.explode(_names(*host_and_path(F.col("url")))).alias("word")).join(odds, "word")
    urls = urls.groupBy("url").agg(F.round(F.sum("odds"), 9).alias("odds")).withColumnRenamed("url", "u")
    host, path = host_and_path(F.col("url"))
    out = src.join(urls, F.col("url") == F.col("u"), "left").withColumns({"host": host, "path": path})
    out = out.withColumns({"found": rule_of(F.col("host"), F.col("path"), rules), "score": F.lit(model.prior) + F.coalesce("odds", F.lit(0.0))})
    out = out.withColumns({"rule": F.col("found.rule"), "verdict": F.coalesce(F.col("found.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))})
    return unpacked(out, pages.columns, "host", "path", "rule", "score", "verdict")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    words = document_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    return filter_urls(pages, words=words).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
