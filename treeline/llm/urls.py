"""URL filters: rules first, then host word segmentation and naive Bayes.

Rules give a verdict for a host with its subdomains and a path prefix; the longest that fits wins. Other urls are
judged by their words: the labels of a host are cut into words by unigram Viterbi, with word counts from all pages'
text, and a multinomial naive Bayes scores these words and the path's tokens. Rules teach it: a url that a rule fits
teaches the rule's verdict. Of the others, those with a seed among their tokens, or on whose page the text is full of seeds,
teach `block`, and the rest teach `allow` at first. Then urls that the model blocks teach `block` from there on, until no
further one does, so words that keep such company, and those that keep theirs, come to count. Labels only ever turn to
`block`, so rounds end; there are as many as the longest chain of urls of which each one's words give the next away.

Each distinct name is segmented once. Its possible words are found by a join with the counts, so neither counts nor
model are broadcast or collected.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and, having no
tokens, is allowed; null and empty html teach no words; names are runs of a to z, so digits, marks and
other letters of a host only part names; a word of a name has at most 63 letters, as many as a host's label may have;
repeated rows are judged alike; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import per_row, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Words of hosts and paths that are not wanted; also known to the segmentation.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "escort", "gambling", "loans", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")

#: No word of a name is longer: the limit of a host's label.
LONGEST = 63
#: Seeds in a page's text, and their share of its words, from which on its url teaches `block`.
MENTIONS, SHARE = 3, 0.1


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def page_text(html: Column) -> Column:
    return F.translate(F.regexp_replace(html, "<[^>]*+>", " "), UPPER, LOWER)


def page_words(html: DataFrame) -> DataFrame:
    """html -> word, times: the words of a to z in the text of all pages."""
    word = F.explode(F.split(page_text(F.col("html")), "[^a-z]++")).alias("word")
    return html.select(word).filter(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("times"))


def full_of(html: Column, seeds: Sequence[str]) -> Column:
    """Whether a page's text mentions seeds at least MENTIONS times, and as SHARE of its words."""
    text = page_text(html)
    found = F.regexp_count(text, F.lit("\\b(?:" + "|".join(seeds) + ")\\b"))
    return F.coalesce((found >= MENTIONS) & (found >= F.lit(SHARE) * F.regexp_count(text, F.lit("[a-z]++"))), F.lit(False))


def cheapest_cut(name: str, parts: list[dict], total: float) -> list[str]:
    """The likeliest words of a name. parts: start, word, times. An unknown stretch is a word as unlikely as it is long."""
    known: dict[int, list[tuple[int, float]]] = {}
    for p in parts:
        known.setdefault(p["start"] + len(p["word"]), []).append((p["start"], -math.log(p["times"] / total)))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        choices = [(best[a][0] + cost, a) for a, cost in known.get(end, [])]
        for a in range(max(0, end - LONGEST), end):
            choices.append((best[a][0] + math.log(total) + math.log(10.0) * (end - a), a))
        best.append(min(choices))
    words, end = [], len(name)
    while end > 0:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """names(name), distinct; counts(word, times) -> name, words array<string>."""
    total = float(counts.agg(F.coalesce(F.sum("times"), F.lit(1))).first()[0])
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    stretches = starts.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1))).alias("n"))
    pieces = stretches.select("name", (F.col("at") - 1).alias("start"), F.expr("substring(name, at, n)").alias("word"))
    parts = pieces.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("start", "word", "times")).alias("parts"))
    out = pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))])

    def make():
        def each(name, parts):
            return name, cheapest_cut(name, parts or [], total)

        return each

    return names.join(parts, "name", "left").select("name", "parts").mapInArrow(per_row(make, out), "name string, words array<string>")


def learned(read: DataFrame) -> DataFrame:
    """read(row, bad, ruled, tokens) -> row, score: log odds for block, after rounds of learning from the rows that it blocks. Rows that are ruled keep their label, bad."""
    each = read.select("row", F.explode("tokens").alias("token"))
    labels, before = read.select("row", F.col("bad").alias("label"), "ruled"), -1
    while True:
        n_block, n = labels.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
        if n_block == before:
            return scores
        before = n_block
        model = written(each.join(labels, "row").groupBy("token").agg(F.sum("label").alias("block"), F.sum(1 - F.col("label")).alias("allow")), "url-model")
        size, block, allow = model.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
        prior = math.log((n_block + 1) / (n - n_block + 1))
        odds = F.log((F.col("block") + 1) / F.lit(float(block + size + 1))) - F.log((F.col("allow") + 1) / F.lit(float(allow + size + 1)))
        scores = written(each.join(written(model.select("token", odds.alias("odds")), "url-odds"), "token").groupBy("row").agg((F.sum("odds") + prior).alias("score")), "url-scores")
        now = F.when((F.col("label") == 1) | (~F.col("ruled") & (F.col("score") > 0)), 1).otherwise(0).cast("long")
        labels = written(labels.join(scores, "row", "left").select("row", now.alias("label"), "ruled"), "url-labels")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, path, rule, verdict, words, score. A score over 0 speaks for block."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), full_of(F.col("html"), seeds).alias("full"))
    urls = urls.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = written(urls.withColumn("row", F.monotonically_increasing_id()), "urls")

    known = pages.sparkSession.createDataFrame([(s, 50) for s in seeds], "word string, times long")
    counts = written(page_words(pages.select("html")).unionByName(known).groupBy("word").agg(F.sum("times").alias("times")), "page-words")
    hosts = rows.select("host").distinct()
    labels = hosts.select("host", F.posexplode(F.split("host", "[^a-z]+")).alias("place", "name")).filter("name != ''")
    words = segmented(labels.select("name").distinct(), counts)
    host_words = labels.join(words, "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("words"))
    # Written, so that the join below meets two plain tables and can split the rows of a frequent host.
    host_words = written(host_words, "host-words")
    path_tokens = F.filter(F.split(F.regexp_replace(F.translate("path", UPPER, LOWER), "[0-9]+", "0"), "[^a-z0-9]+"), lambda t: t != "")
    none = F.array().cast("array<string>")
    read = rows.join(host_words, "host", "left").select("row", "full", F.col("fit.verdict").alias("told"), F.coalesce("words", none).alias("words"), F.concat(F.coalesce("words", none), F.transform(path_tokens, lambda t: F.concat(F.lit("/"), t))).alias("tokens"))
    bad = F.col("full") | F.arrays_overlap(F.transform("tokens", lambda t: F.regexp_replace(t, "^/", "")), F.array(*[F.lit(s) for s in seeds]))
    bad = F.when(F.col("told").isNotNull(), F.col("told") == "block").otherwise(bad)
    read = written(read.withColumn("bad", bad.cast("long")).withColumn("ruled", F.col("told").isNotNull()), "url-tokens")
    judged = rows.join(learned(read), "row", "left").join(read.select("row", "words"), "row", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.array_join("words", " ").alias("words"), "score")
