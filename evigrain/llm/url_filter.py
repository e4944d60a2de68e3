"""Operator 1, URL filters: host rules, word segmentation by unigram Viterbi, then multinomial naive Bayes.

1. Rules of the form (host, path, verdict). A rule fits its host and all subdomains if the url's path starts
   with the rule's path; the longest fitting rule decides.
2. Urls that no rule fits are judged by their words. Each letter run of a distinct host is split into words by
   the best path under a unigram model: the word counts of the whole corpus, mixed with a small lexicon of web
   words that has WEB_SHARE of the mass. Runs and words may be of any length.
3. Naive Bayes is learned from the pages that rules decide: their verdicts are the labels. Words that stand in a
   rule are no features, so that the labels can't be read off the tokens. Token counts of both classes, add-one
   smoothed, give a log-odds weight for each token that a labelled page has; a page is blocked if its weights exceed
   `threshold`. The prior is the share of blocked pages among the labelled ones; a page without any token has no weights
   and no prior.

Nothing is capped: word counts, token counts and weights are tables that grow with the data and meet the hosts in
shuffled joins, which deal hot keys over parts; hosts and paths are reduced to their distinct forms before
anything is computed. Word counts, urls and forms are written once and read from there.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, no words and so the
odds 0, which the default threshold allows; so is all else without any page that a rule decides; null or repeated
page ids are judged row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.shared import ascii_lower, dealt_join, settled, table, written

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Plain web words.
WEB_WORDS = ("app", "blog", "cloud", "com", "daily", "data", "docs", "example", "forum", "home", "info", "mail", "media", "net", "news", "online", "org", "page", "shop", "site", "store", "tech", "web", "wiki", "world", "www")
#: The share of the unigram model's mass that WEB_WORDS have, in equal parts.
WEB_SHARE = 0.1
#: Letters of a word that its arcs are looked up by.
KEY = 20
#: Letters of a run whose substrings are made in one row.
STRETCH = 256
MAX_RULES = 500


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return pages.select("page_id", rest.alias("_rest")).select("page_id", ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The deciding rule's string and verdict, or nulls. The list is bounded: it is compiled into one expression."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be compiled")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: lower-case runs of ASCII letters in whole texts of all documents."""
    word = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("word")
    return docs.select(word).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def word_shares(counts: DataFrame) -> tuple[DataFrame, float]:
    """word, p: each word's share in the mixture of corpus and lexicon, and the share of a single occurrence."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    lexicon = counts.sparkSession.createDataFrame([(w, WEB_SHARE / len(WEB_WORDS)) for w in WEB_WORDS], "word string, p double")
    seen = counts.select("word", (F.col("n") * ((1 - WEB_SHARE) / max(total, 1))).alias("p"))
    return seen.unionByName(lexicon).groupBy("word").agg(F.sum("p").alias("p")), (1 - WEB_SHARE) / max(total, 1)


def best_split(run: str, words: dict[str, float], once: float) -> list[str]:
    """Viterbi: the split of run with the largest product of word shares. A word that the model lacks has the share
    of a single occurrence, ten times less for each letter; ties go to the longer last word."""
    ten, rare = math.log(10), math.log(once)
    lengths = sorted({len(w) for w in words}, reverse=True)
    logs = {w: math.log(p) for w, p in words.items()}
    best, back = [0.0], [0]
    # The best start of a word that the model lacks: its cost is linear in its length, so one running maximum does.
    start, lead = 0, 0.0
    for end in range(1, len(run) + 1):
        at, score = start, lead - end * ten + rare
        for n in lengths:
            if n > end or (p := logs.get(run[end - n : end])) is None:
                continue
            s = best[end - n] + p
            if s > score or (s == score and end - n < at):
                at, score = end - n, s
        best.append(score)
        back.append(at)
        if score + end * ten > lead:
            start, lead = end, score + end * ten
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """run, words for the distinct letter runs of column run. All substrings of up to KEY letters meet the words that
    they are, or, at KEY letters, that start with them; of the latter those stay that the run holds."""
    shares, once = word_shares(counts)
    # A row makes the substrings that start in a stretch of the run.
    stretch = F.expr(f"explode(sequence(0, (length(run) - 1) div {STRETCH}))").alias("s")
    starts = f"sequence(s * {STRETCH} + 1, least(length(run), (s + 1) * {STRETCH}))"
    pieces = F.expr(f"explode(array_distinct(flatten(transform({starts}, i -> transform(sequence(1, least({KEY}, length(run) - i + 1)), l -> substring(run, i, l))))))")
    runs = runs.filter("run <> ''")
    keys = written(runs.select("run", stretch).select("run", pieces.alias("key")), "substrings")
    # Most runs have the same few letters.
    met = dealt_join(keys, shares.select(F.substring("word", 1, KEY).alias("key"), "word", "p"), ["key"])
    arcs = met.filter((F.length("word") <= KEY) | F.col("run").contains(F.col("word"))).groupBy("run").agg(F.collect_list(F.struct("word", "p")).alias("arcs"))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, arcs: pd.Series) -> pd.Series:
        return pd.Series([best_split(r, {} if a is None else {x["word"]: x["p"] for x in a}, once) for r, a in zip(run, arcs)])

    return runs.join(arcs, "run", "left").select("run", split("run", "arcs").alias("words"))


def path_words(path: Column) -> Column:
    return F.array_join(F.filter(F.split(F.lower(path), "[^a-z]+"), lambda w: w != ""), " ")


def labelled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, path_words, rule and its verdict (null where no rule fits), written once."""
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    return written(parsed(pages).select("page_id", "host", "path", path_words(F.col("path")).alias("path_words"), rule.alias("rule"), verdict.alias("label")), "urls")


def tokenised(urls: DataFrame, counts: DataFrame, rules=RULES) -> DataFrame:
    """For each distinct pair of a host and its path's words: both, how many of its pages rules block (b) and allow
    (g), host_words and the tokens that are features."""
    told = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0))
    forms = written(urls.groupBy("host", "path_words").agg(told("block").alias("b"), told("allow").alias("g")), "forms")
    runs = written(forms.select("host").distinct().select("host", F.posexplode(F.filter(F.split("host", "[^a-z]+"), lambda w: w != "")).alias("at", "run")), "runs")
    split = segmented(runs.select("run").distinct(), counts)
    hosts = dealt_join(runs, split, ["run"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))
    hosts = hosts.select("host", F.flatten(F.transform("parts", lambda x: x["words"])).alias("host_words"))
    named = dealt_join(forms, hosts, ["host"], "left").withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>")))
    given = sorted({w for h, p, _ in rules for w in re.findall("[a-z]+", (h + " " + p).lower())})
    tokens = F.concat("host_words", F.filter(F.split("path_words", " "), lambda w: w != ""))
    kept = F.filter(tokens, lambda w: ~w.isin(given)) if given else tokens
    return written(named.withColumn("tokens", kept), "tokens")


def scored(forms: DataFrame, learns: Column | None = None) -> DataFrame:
    """host, path_words, host_words and odds of blocking; learned from forms for which `learns` holds (all)."""
    b, g = (F.col(c) if learns is None else F.when(learns, F.col(c)).otherwise(0) for c in ("b", "g"))
    token = forms.select("host", "path_words", b.alias("b"), g.alias("g"), F.explode("tokens").alias("token"))
    seen = token.groupBy("token").agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
    seen = written(seen, "token_counts")
    v, nb, ng = (float(x or 0) for x in seen.agg(F.sum(F.when(F.col("b") + F.col("g") > 0, 1)), F.sum("b"), F.sum("g")).first())
    # A token that no labelled page has says nothing.
    weight = F.when(F.col("b") + F.col("g") > 0, F.log((F.col("b") + 1) / (nb + v + 1)) - F.log((F.col("g") + 1) / (ng + v + 1))).otherwise(0.0)
    pb, pg = (float(x or 0) for x in forms.agg(F.sum(b), F.sum(g)).first())
    prior = math.log((pb + 1) / (pg + 1))
    odds = dealt_join(token.select("host", "path_words", "token"), seen.select("token", weight.alias("w")), ["token"]).groupBy("host", "path_words").agg((F.sum("w") + prior).alias("w"))
    return forms.join(odds, ["host", "path_words"], "left").select("host", "path_words", "host_words", F.coalesce("w", F.lit(0.0)).alias("odds"))


def judged(pages: DataFrame, docs: DataFrame, rules=RULES, threshold: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict, host_words and odds of every page."""
    urls = labelled(pages, rules)
    odds = scored(tokenised(urls, written(word_counts(docs), "word_counts"), rules))
    own = F.when(F.col("odds") > threshold, "block").otherwise("allow")
    both = dealt_join(urls, odds, ["host", "path_words"], "left")
    return both.select("page_id", "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "host_words", "odds")


def accuracy(pages: DataFrame, docs: DataFrame, rules=RULES, threshold: float = 0.0, folds: int = 5) -> DataFrame:
    """fold, n, right, majority: for each fold of the hosts, how many of its pages that a rule decides the method gets
    right when it learns from the other folds only, and how many the commoner verdict would get right."""
    forms = tokenised(labelled(pages, rules), written(word_counts(docs), "word_counts"), rules)
    fold = F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(folds))
    out = None
    for k in range(folds):
        odds = scored(forms, fold != k).select("host", "path_words", "odds")
        own = forms.filter(fold == k).join(odds, ["host", "path_words"])
        row = own.agg(F.sum(F.col("b") + F.col("g")).alias("n"), F.sum(F.when(F.col("odds") > threshold, F.col("b")).otherwise(F.col("g"))).alias("right"), F.greatest(F.sum("b"), F.sum("g")).alias("majority"))
        row = row.select(F.lit(k).alias("fold"), "n", "right", "majority")
        out = row if out is None else out.unionByName(row)
    return out


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")), "judged")
