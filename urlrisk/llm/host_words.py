"""URL verdicts from host names split into words.

Concatenated names are split by the unigram model with the highest likelihood
(Viterbi over word counts of page titles and URL paths); a multinomial naive
Bayes model over the tokens of host and path then scores a URL. Rules for hosts
and paths come first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.skew import lookup_join
from urlrisk.session import materialize

# Words that mark unwanted hosts: a host with one of them is a training case of
# "block", every other one of "allow". They are also known to the word model.
SEED_WORDS = (
    "adult", "ads", "bet", "bets", "betting", "bingo", "casino", "crack", "dating", "escort", "jackpot", "loan", "loans",
    "lottery", "malware", "phishing", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx",
)
# Words that often stand beside them in one name.
COMMON_WORDS = ("best", "buy", "cheap", "farm", "free", "online", "shop", "site", "top", "track", "win", "blog", "www", "mail")
# Each of these words counts as so many of 10,000 corpus words besides its own occurrences: the split of a name depends
# on shares alone, not on the size of the corpus.
SEED_PER_10000 = 18
# Share of an unknown word, a tenth of it for each letter.
UNKNOWN_SHARE = 1 / 30_000
# Words of up to so many letters are looked up as they are, longer ones by their first so many.
DIRECT = 20
# Smoothing of the Bayes model: added to each token count, a share of the mean count; to each class, of all rows.
SMOOTHING = 0.01

Rule = tuple[str, str]  # "host/path prefix", verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path up to ``?`` or ``#``; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        name = F.when(fits, F.lit(text)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def tokens(text: Column) -> Column:
    """Runs of letters in lower case; a run of digits is the token ``0``."""
    masked = F.regexp_replace(F.lower(text), "[0-9]+", " 0 ")
    return F.array_remove(F.split(masked, r"[^\p{L}0]+"), "")


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``(name, parts array<string>)``: each name cut into its likeliest words.

    ``counts`` has ``(word, n)``. Every part of a name that may be a word is looked
    up by a join, so the word table may have any size and words any length; a task
    sees the known words of one name at a time. An unknown stretch may be of any
    length and costs ten times more with each letter. Counts multiplied by a number
    give the same parts.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    spans = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("_at"))
    spans = spans.select(
        "name", "_at", F.explode(F.sequence(F.lit(1), F.least(F.lit(DIRECT), F.length("name") - F.col("_at") + 1))).alias("_n")
    ).withColumn("_part", F.expr("substring(name, _at, _n)"))
    short = spans.join(counts.filter(F.length("word") <= DIRECT).withColumn("_part", F.col("word")), "_part")
    # A longer word begins with a part of full length and goes on as the name does.
    long = counts.filter(F.length("word") > DIRECT).withColumn("_part", F.substring("word", 1, DIRECT))
    goes_on = F.expr("startswith(substring(name, _at), word)")
    long = spans.filter(F.col("_n") == DIRECT).join(long, "_part").filter(goes_on)
    found = short.select("name", "word", "n").unionByName(long.select("name", "word", "n"))
    known = found.groupBy("name").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    def cut(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(a, {w["word"]: w["n"] for w in b} if b is not None else {}, total) for a, b in zip(name, known, strict=True)])

    parts = F.pandas_udf(cut, "array<string>")
    return names.join(known, "name", "left").select("name", parts("name", "known").alias("parts"))


def viterbi(name: str, counts: dict[str, int], total: float) -> list[str]:
    """Likeliest split under independent words; of equal ones the one with the longer last word.

    A known word costs what its share says, any other stretch what its length says.
    The cheapest beginning of an unknown stretch is kept as the end moves on.
    """
    letter, unknown = math.log(10), -math.log(UNKNOWN_SHARE)
    lengths = sorted({len(word) for word, n in counts.items() if n}, reverse=True)
    best, start = [0.0], [0]
    opened, opening = 0.0, 0  # least cost of all before a stretch, less its letters so far
    for end in range(1, len(name) + 1):
        value, begin = opened + letter * end + unknown, opening
        if counts.get(name[begin:end]):
            # This stretch is a word: the cheapest that is none begins elsewhere.
            others = [(best[b] + letter * (end - b) + unknown, b) for b in range(end) if not counts.get(name[b:end])]
            value, begin = min(others, default=(math.inf, 0))
        for length in lengths:
            if length <= end:
                n = counts.get(name[end - length : end])
                if n:
                    value, begin = min((value, begin), (best[end - length] + math.log(total / n), end - length))
        best.append(value)
        start.append(begin)
        if value - letter * end < opened - 1e-12:
            opened, opening = value - letter * end, end
    out, end = [], len(name)
    while end:
        out.append(name[start[end] : end])
        end = start[end]
    return out[::-1]


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    seeds: Sequence[str] = SEED_WORDS,
    min_token_count: int = 1,
) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` for every row.

    ``score`` is the log odds of "block" by the method; the verdict is the
    rule's where one fits, else "block" if the score is above 0. Null and
    malformed URLs have empty host and path and are allowed. Repeated rows are
    judged alike; extra columns are ignored.

    Names are split once per distinct name, hosts and paths (numbers masked)
    are scored once per distinct value, and pages look their host and path up
    in a join that splits hot ones.
    """
    host, path = host_and_path(F.col("_url"))
    title = F.regexp_extract(F.col("_html"), r"(?is)<title[^>]*>(.*?)</title>", 1)
    source = pages.select(
        F.col(id_col).alias("_id"),
        F.col(url_col).alias("_url"),
        (F.col(html_col) if html_col else F.lit(None).cast("string")).alias("_html"),
    )
    urls = source.select(
        "_id", host.alias("_host"), path.alias("_path"), F.coalesce(title, F.lit("")).alias("_title"),
    ).withColumn("_shape", F.regexp_replace("_path", "[0-9]+", "0"))
    urls = materialize(urls.withColumn("_row", F.monotonically_increasing_id()), "urls")

    # Counts of words over all titles and paths, and the seeds with a share of their sum; whole numbers in 1/10,000.
    # An empty list still counts once as itself, so it is removed before exploding.
    seen = urls.select(F.explode(F.concat(tokens(F.col("_title")), tokens(F.col("_shape")))).alias("word"))
    seen = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = materialize(seen, "seen-words")
    seed = SEED_PER_10000 * max(seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"], 1)
    known = pages.sparkSession.createDataFrame([(w, seed) for w in sorted({*seeds, *COMMON_WORDS})], "word string, n long")
    seen = seen.withColumn("n", F.col("n") * 10_000)
    counts = materialize(seen.unionByName(known).groupBy("word").agg(F.sum("n").alias("n")), "words")

    by_host = urls.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    named = by_host.select("_host", F.explode(F.array_distinct(tokens(F.col("_host")))).alias("name"))
    named = materialize(named, "names")
    parts = split_names(named.select("name").distinct(), counts)
    host_tokens = materialize(
        named.join(parts, "name").select("_host", F.explode("parts").alias("token")), "host-tokens"
    )
    seeded = F.max(F.col("token").isin(*seeds).cast("int")).alias("_block")
    classes = by_host.join(host_tokens.groupBy("_host").agg(seeded), "_host", "left").select(
        "_host", "_n", F.coalesce("_block", F.lit(0)).alias("_block")
    )
    classes = materialize(classes, "host-classes")
    by_shape = urls.groupBy("_host", "_shape").agg(F.count(F.lit(1)).alias("_n"))
    shape_tokens = urls.select("_shape").distinct().select("_shape", F.explode(tokens(F.col("_shape"))).alias("token"))
    shape_tokens = materialize(shape_tokens, "path-tokens")
    shape_classes = by_shape.join(classes.select("_host", "_block"), "_host").groupBy("_shape", "_block").agg(F.sum("_n").alias("_n"))

    def token_counts(rows: DataFrame, kind: str) -> DataFrame:
        blocked, allowed = (F.sum(F.when(F.col("_block") == v, F.col("_n")).otherwise(0)) for v in (1, 0))
        return rows.groupBy("token").agg(blocked.alias("_b"), allowed.alias("_a")).withColumn("_kind", F.lit(kind))

    bayes = token_counts(host_tokens.join(classes, "_host"), "host").unionByName(
        token_counts(shape_tokens.join(shape_classes, "_shape"), "path")
    )
    bayes = materialize(bayes.filter(F.col("_a") + F.col("_b") >= min_token_count), "token-counts")
    sums = bayes.groupBy("_kind").agg(F.sum("_b").alias("b"), F.sum("_a").alias("a"), F.count(F.lit(1)).alias("v"))
    of = {r["_kind"]: r for r in sums.collect()}
    prior = classes.agg(
        F.coalesce(F.sum(F.when(F.col("_block") == 1, F.col("_n"))), F.lit(0)).alias("b"),
        F.coalesce(F.sum(F.when(F.col("_block") == 0, F.col("_n"))), F.lit(0)).alias("a"),
    ).first()

    def scored(rows: DataFrame, key: str, kind: str) -> DataFrame:
        r = of.get(kind)
        if r is None:
            return rows.select(key).distinct().withColumn(f"_{kind}_score", F.lit(0.0))
        added = SMOOTHING * (r["a"] + r["b"])
        blocked, allowed = ((F.col(c) + added / r["v"]) / (r[c[1:]] + added) for c in ("_b", "_a"))
        odds = F.log(blocked) - F.log(allowed)
        table = bayes.filter(F.col("_kind") == kind).select("token", odds.alias("_odds"))
        return rows.join(table, "token").groupBy(key).agg(F.sum("_odds").alias(f"_{kind}_score"))

    added = SMOOTHING * (prior["a"] + prior["b"]) or 1
    start = math.log((prior["b"] + added) / (prior["a"] + added))
    pages_scored = lookup_join(urls.drop("_title"), scored(host_tokens, "_host", "host"), "_host", ["_row"])
    pages_scored = lookup_join(pages_scored, scored(shape_tokens, "_shape", "path"), "_shape", ["_row"])
    score = F.lit(start) + F.coalesce("_host_score", F.lit(0.0)) + F.coalesce("_path_score", F.lit(0.0))
    score = F.when(F.col("_host") == "", F.lit(start)).otherwise(score)
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    by_method = F.when((score > 0) & (F.col("_host") != ""), "block").otherwise("allow")
    return pages_scored.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), score.alias("score"),
    )
