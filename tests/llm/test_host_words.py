"""Host splitting against all splits, verdict scores against a plain Bayes model, long names and words."""

import math
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from urlrisk.llm import host_words


def cost_of(parts, counts, total):
    return sum(
        math.log(total / counts[p]) if counts.get(p) else len(p) * math.log(10) - math.log(host_words.UNKNOWN_SHARE) for p in parts
    )


def all_splits(name):
    if not name:
        return [[]]
    return [[name[:k], *rest] for k in range(1, len(name) + 1) for rest in all_splits(name[k:])]


def test_viterbi_finds_the_cheapest_of_all_splits():
    pick = random.Random(3)
    for _ in range(400):
        counts = {"".join(pick.choices("abc", k=pick.randint(1, 5))): pick.choice([1, 7, 90, 2000]) for _ in range(pick.randint(0, 10))}
        total = max(1, sum(counts.values()) * pick.choice([1, 30]))
        name = "".join(pick.choices("abc", k=pick.randint(1, 10)))
        got = host_words.viterbi(name, counts, total)
        assert "".join(got) == name
        best = min(cost_of(parts, counts, total) for parts in all_splits(name))
        assert cost_of(got, counts, total) == pytest.approx(best, abs=1e-9)


def test_names_and_words_of_any_length(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=70))
    names = spark.createDataFrame([("x" * 45,), (f"free{long}bets",), (long[:30] + "free",), ("y" * 3000,)], "name string")
    counts = spark.createDataFrame([("free", 50), ("bets", 50), (long, 3), (long[:25], 1)], "word string, n long")
    got = {r["name"]: r["parts"] for r in host_words.split_names(names, counts).collect()}
    assert got["x" * 45] == ["x" * 45] and got["y" * 3000] == ["y" * 3000]
    assert got[f"free{long}bets"] == ["free", long, "bets"]
    assert got[long[:30] + "free"] == [long[:25], long[25:30], "free"]


def tokens(text):
    return [t for t in regex.split(r"[^\p{L}0]+", regex.sub("[0-9]+", " 0 ", text.lower())) if t]


def judged_plainly(pages, seeds):
    rows = []
    for page, url, html in pages:
        _, found, rest = (url or "").partition("://")
        rest = rest if found else ""
        host = regex.match(r"[^/?#]*", rest).group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = regex.match(r"[^?#]*", rest[len(host):]).group()
        title = regex.search(r"(?is)<title[^>]*>(.*?)</title>", html or "")
        rows.append((page, host, path, regex.sub("[0-9]+", "0", path), title.group(1) if title else ""))
    counts = Counter(t for r in rows for t in tokens(r[4]) + tokens(r[3]))
    seed = host_words.SEED_PER_10000 * max(sum(counts.values()), 1)
    counts = Counter({w: 10_000 * n for w, n in counts.items()})
    for word in {*seeds, *host_words.COMMON_WORDS}:
        counts[word] += seed
    total = sum(counts.values())
    hosts = Counter(r[1] for r in rows)
    parts = {h: [p for name in dict.fromkeys(tokens(h)) for p in host_words.viterbi(name, counts, total)] for h in hosts}
    block = {h: any(p in seeds for p in parts[h]) for h in hosts}
    tables = {"host": Counter(), "path": Counter()}
    for h, n in hosts.items():
        for p in parts[h]:
            tables["host"][p, block[h]] += n
    for _, h, _, shape, _ in rows:
        for t in tokens(shape):
            tables["path"][t, block[h]] += 1
    sums = {k: [sum(n for (_, b), n in t.items() if b == c) for c in (False, True)] for k, t in tables.items()}

    def odds(kind, token):
        if not sum(sums[kind]) or (token, True) not in tables[kind] and (token, False) not in tables[kind]:
            return 0.0
        added = host_words.SMOOTHING * sum(sums[kind])
        size = len({t for t, _ in tables[kind]})
        share = [(tables[kind][token, c] + added / size) / (sums[kind][c] + added) for c in (False, True)]
        return math.log(share[1]) - math.log(share[0])

    n = [sum(n for h, n in hosts.items() if block[h] == c) for c in (False, True)]
    added = host_words.SMOOTHING * sum(n) or 1
    prior = math.log((n[1] + added) / (n[0] + added))
    return {
        (r[0], r[1], r[2]): prior + (sum(odds("host", p) for p in parts[r[1]]) + sum(odds("path", t) for t in tokens(r[3])) if r[1] else 0.0)
        for r in rows
    }


def test_scores_equal_a_plain_bayes_model(spark):
    pick = random.Random(12)
    names = ["freebets", "quiet", "newsdesk", "adsfarm", "gardenblog", "casino9", "mailtop", "z" * 30, "été"]
    pages = []
    for k in range(160):
        host = f"{pick.choice(names)}.{pick.choice(['com', 'example.org', 'net'])}"
        path = pick.choice(["/a/b", "/win/12", "/news/2024/quiet", "", "/x?q=ads"])
        pages.append((k, f"http://{host.upper() if k % 9 == 0 else host}{path}", f"<title>{pick.choice(names)} garden desk</title>"))
    pages += [(200, None, None), (201, "no scheme", "<p>"), (202, "http:///only/path", "<title>x</title>"), (203, "http://" + "w" * 400, None)]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, _row int").repartition(3)
    got = host_words.judge_urls(frame, ()).collect()
    want = judged_plainly(pages, host_words.SEED_WORDS)
    assert len(got) == len(want) == len(pages)
    for row in got:
        score = want[row["page_id"], row["host"], row["path"]]
        assert row["score"] == pytest.approx(score, abs=1e-9)
        assert row["verdict"] == ("block" if score > 0 and row["host"] else "allow")
    # Without any seed word nothing is known to be unwanted: a defined result, everything is allowed.
    none = host_words.judge_urls(frame, (), seeds=()).agg(F.count_if(F.col("verdict") == "block")).first()[0]
    assert none == 0
