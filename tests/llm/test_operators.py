"""Training-data operators against brute force, round trips and held-out labels on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from urlrisk.llm import (
    byte_shards,
    chain_toxicity,
    chat_render,
    host_words,
    merge_replay,
    piecewise_hash,
    rule_quality,
    signature_tree,
    spaced_seeds,
    suffix_dedup,
)

SCHEMA = "doc_id long, text string, lang string, _id string, id long, key int"


def passage(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choices("abcdefghijklmnop", k=pick.randint(2, 8))) for _ in range(n))


def odd_texts():
    base = passage(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    long = passage(2, 9000)
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "ONE two"),
        (9, long), (10, long[:30000] + " tail"), (11, "é" * 700), (12, passage(3, 50) + " " + base + " " + passage(4, 50)),
        (None, passage(5, 40)), (14, passage(6, 40)), (14, passage(6, 40)), (15, "a" * 450), (16, "日本語 " * 120), (3, passage(7, 80)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "x", 7, 1) for i, t in odd_texts()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_shards_are_contiguous_and_even(spark, docs, empty):
    got = byte_shards.balanced_shards(docs, 5).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_texts())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    total, largest = sum(sizes.values()), max(r["size"] for r in got)
    assert all(abs(s - total / 5) <= largest for s in sizes.values())
    for shard in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    assert byte_shards.balanced_shards(empty, 5).count() == 0


def test_shards_split_one_hot_id(spark):
    hot = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = byte_shards.balanced_shards(hot, 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [1000] * 4


def test_escape_is_reversible():
    pick = random.Random(3)
    pieces = [*chat_render.CONTROLS, "\\", "<", "s>", "[", "INST]", "/", "\n", "x"]
    for _ in range(500):
        text = "".join(pick.choices(pieces, k=pick.randint(0, 12)))
        escaped = chat_render.escape(text)
        assert chat_render.unescape(escaped) == text
        assert not any(c in escaped for c in chat_render.CONTROLS)


def test_chat_spans_and_rewritten_history(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok"), (1, 1, None, None), (2, None, "user", ""), (None, 0, "assistant", "b\\")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat_render.format_conversations(df).collect()}
    assert set(got) == {1, 2, None}
    for conv, r in got.items():
        texts = [chat_render.unescape(r["formatted"][t["text_start"] : t["text_end"]]) for t in r["turns"]]
        assert Counter(texts) == Counter(t[3] or "" for t in turns if t[0] == conv)
        assert r["rewrites_at"] is None and "".join(r["formatted"][t["start"] : t["end"]] for t in r["turns"]) == r["formatted"]

    def forgetful(turns):
        return "".join(f"[{role}]{text if k + 1 == len(turns) else '...'}" for k, (role, text) in enumerate(turns))

    def closed(turns):
        return "".join(f"[{role}]{text}" for role, text in turns) + "<end>"

    assert chat_render.locate(forgetful, [("u", "abc"), ("a", "d"), ("u", "e")])[1] == 1
    def shortened(turns):
        return "".join(f"[{role}]{text}" for role, text in (turns if len(turns) < 4 else [("s", "cut"), *turns[-2:]]))

    assert chat_render.locate(shortened, [("u", "abc"), ("a", "d"), ("u", "e"), ("a", "f")])[1] == 3
    text, broken, spans = chat_render.locate(closed, [("u", "abc"), ("a", "d")])
    assert broken is None and [text[s[2] : s[3]] for s in spans] == ["abc", "d"]
    assert chat_render.format_conversations(df.limit(0)).count() == 0


def brute_components(texts):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(texts))


@pytest.mark.parametrize("piece", [4096, 2])
def test_signature_trees_match_brute_force(spark, piece):
    pick = random.Random(9)
    texts = odd_texts()
    for group in range(4):
        words = passage(50 + group, 90).split()
        for k in range(9):
            copy = list(words)
            for _ in range(pick.randint(0, 4)):
                copy[pick.randrange(len(copy))] = f"w{pick.randrange(1000)}"
            texts.append((100 + 10 * group + k, " ".join(copy[: pick.randint(75, 90)])))
    df = spark.createDataFrame([(i, t, "en", "x", 7, 1) for i, t in texts], SCHEMA).repartition(4)
    assert rows(signature_tree.components_of(df, piece_sets=piece)) == brute_components(texts)


def test_one_of_each_group_stays(docs, empty):
    kept = Counter((r["doc_id"], r["text"]) for r in signature_tree.keep_one(docs).collect())
    assert signature_tree.keep_one(docs).columns == docs.columns
    by_id = {i for i, _ in kept}
    assert 1 in by_id and 2 not in by_id and 8 not in by_id and {4, 5, 6, None, 9} <= by_id
    assert max(kept.values()) == 1
    assert signature_tree.components_of(empty).count() == 0


def test_rows_without_words_all_stay(spark):
    blank = [(None, None, "en"), (None, None, "de"), (None, "", "en"), (4, " \t\n\x0b", "en"), (4, " \t\n\x0b", "en"), (4, None, "fr"), (5, "", "en")]
    worded = [(4, "one two", "en"), (4, "one two", "de"), (None, "\x1c", "en"), (6, "\u00a0", "en"), (6, "\u00a0", "fr")]
    df = spark.createDataFrame([(i, t, lang, "x", 7, 1) for i, t, lang in blank * 2 + worded], SCHEMA).repartition(3)
    kept = Counter((r["doc_id"], r["text"], r["lang"]) for r in signature_tree.keep_one(df).collect())
    assert {r: n for r, n in kept.items() if r in blank} == Counter(blank * 2)
    assert Counter(r[:2] for r in kept if r not in blank) == Counter({r[:2] for r in worded})


def brute_repeats(texts):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[p : p + 200] for d in data for p in range(len(d) - 199))
    out = Counter()
    for (i, _), d in zip(texts, data, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - 199):
            if seen[d[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out[i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot_runs", [0, 3, 2048])
def test_repeats_match_brute_force(spark, docs, empty, monkeypatch, hot_runs):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot_runs)
    texts = [t if len(t[1] or "") < 12000 else (t[0], t[1][:12000]) for t in odd_texts()]
    texts += [(200 + k, passage(300 + k, 20) + passage(77, 60)[k:] + passage(400 + k, 20)) for k in range(12)]
    texts += [(300, "ab" * 300), (301, "x" + "ab" * 150), (302, passage(500, 30) * 3)]
    df = spark.createDataFrame([(i, t, "en", "x", 7, 1) for i, t in texts], SCHEMA).repartition(3)
    assert rows(suffix_dedup.removal_digests(df)) == brute_repeats(texts)
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(odd_texts())
    assert suffix_dedup.removal_digests(empty).count() == 0


def test_suffix_mergesort_orders_and_verifies():
    pick = random.Random(4)
    unit = bytes(pick.choices(b"ab", k=260))
    data = np.frombuffer(b"".join(unit[k:] + unit[:k] for k in (0, 0, 3, 9)) + unit, np.uint8)
    hashes = suffix_dedup.RunHashes(data, np.arange(5) * 260, np.full(5, 260))
    items = np.concatenate([np.arange(k * 260, k * 260 + 61) for k in range(5)])
    got = suffix_dedup.Suffixes(data, hashes).sort(items, np.zeros(len(items), np.int64))
    strings = [data[p : p + 200].tobytes() for p in got]
    assert strings == sorted(strings) and sorted(got) == sorted(items)


def test_overlaps_forgive_substitutions(spark, docs, empty):
    item = passage(900, 40).split()
    changed = list(item)
    for k in (5, 14, 23, 31):
        changed[k] = "other"
    found = [(1, passage(901, 30) + " " + " ".join(item).upper() + ". " + passage(902, 9)), (2, " ".join(changed)), (3, " ".join(item[:13])),
             (4, " ".join(item[:8])), (5, passage(903, 300)), (6, None), (7, "tiny item")]
    df = spark.createDataFrame([(i, t, "en", "x", 7, 1) for i, t in found], SCHEMA)
    items = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "Tiny, item!"), (13, "")], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in spaced_seeds.contaminated(df, items).collect()}
    assert got == {1: [10], 2: [10], 3: [10], 7: [12]}
    assert [r["doc_id"] for r in spaced_seeds.drop_contaminated(df, items).collect()] == [4, 5, 6]
    blocks = spaced_seeds.contaminated(df, items, block_bytes=1)
    assert {r["doc_id"]: r["item_ids"] for r in blocks.collect()} == got
    assert spaced_seeds.contaminated(empty, items).count() == 0 and spaced_seeds.contaminated(docs, items.limit(0)).count() == 0


def unhit_scores(masks, longest):
    """By length: the best sum (equal 1, differing -4) of token rows no mask hits, of all rows and of those with equal ends."""
    used = [(len(m), [k for k, c in enumerate(m) if c == "1"]) for m in masks]
    keep = max(map(len, masks)) - 1
    everywhere, begun, out = {(0,): -4, (1,): 1}, {(1,): 1}, {}

    def longer(rows):
        new = {}
        for row, score in rows.items():
            for token in (0, 1):
                more = (*row, token)
                if any(len(more) >= n and all(more[len(more) - n + k] for k in at) for n, at in used):
                    continue
                value, more = score + (1 if token else -4), more[-keep:]
                new[more] = max(new.get(more, value), value)
        return new

    for n in range(2, longest + 1):
        everywhere, begun = longer(everywhere), longer(begun)
        out[n] = max(everywhere.values()), max((v for row, v in begun.items() if row[-1]), default=-n)
    return out


def test_masks_miss_no_accepted_stretch():
    # A sum below 0 is less than 80 % equal. All substitution patterns up to 69 tokens; any longer row splits into
    # pieces of 35 to 69 tokens, each of them below 0.
    scores = unhit_scores(spaced_seeds.MASKS, 69)
    assert all(ends < 0 for n, (_, ends) in scores.items() if n >= spaced_seeds.MIN_TOKENS)
    assert all(every < 0 for n, (every, _) in scores.items() if n >= 35)


def brute_overlaps(docs, items, min_tokens, min_equal):
    """Best overlap of each document and item over all diagonals: the longest accepted stretch, then the most equal tokens."""
    out = {}
    for doc, text in docs:
        spans = [(m.start(), m.end()) for m in re.finditer("[a-z0-9]+", text)]
        found = [text[a:b] for a, b in spans]
        for item, words in items:
            words = words.split()
            for begin in range(1 - len(words), len(found)):
                low, high = max(begin, 0), min(begin + len(words), len(found))
                same = [found[k] == words[k - begin] for k in range(low, high)]
                at = [k for k, x in enumerate(same) if x]
                fits = [(b + 1 - a, -a) for a in at for b in at if b >= a and sum(same[a : b + 1]) >= min_equal * (b + 1 - a) - 1e-9]
                n, a = max(fits, default=(0, 0))
                if n and n >= min(min_tokens, len(words)):
                    a = -a
                    row = (sum(same[a : a + n]), n, -(low + a))
                    out[doc, item] = max(out.get((doc, item), row), row)
    ends = {doc: [m.span() for m in re.finditer("[a-z0-9]+", text)] for doc, text in docs}
    return {(d, i, n, m, ends[d][-s][0], ends[d][-s + n - 1][1]) for (d, i), (m, n, s) in out.items()}


def test_overlaps_match_brute_force(spark):
    pick = random.Random(8)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in [*range(1, 18), 20, 25]]
    items.append((90, " ".join(pick.choices("abc", k=14))))
    found = []
    for n, text in items[:-1]:
        words = text.split()
        patterns = [c for k in range(n // 5 + 1) for c in combinations(range(1, n - 1), k)]
        patterns += [tuple(pick.sample(range(n), n // 5 + 1)) for _ in range(5)]
        for pattern in patterns if len(patterns) < 300 else pick.sample(patterns, 300):
            changed = [f"x{k}" if k in pattern else w for k, w in enumerate(words)]
            found.append(" ".join([*["p"] * pick.randint(0, 3), *changed, *["q"] * pick.randint(0, 3)]))
    found += [" ".join(pick.choices("abcd", k=30)) for _ in range(40)]
    texts = [(k, t) for k, t in enumerate(found)]
    df = spark.createDataFrame([(k, t, "en", "x", 7, 1) for k, t in texts], SCHEMA).repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    for min_tokens, min_equal in ((12, 0.8), (15, 0.9), (8, 0.8), (12, 0.6)):
        got = spaced_seeds.find_overlaps(df, table, min_tokens=min_tokens, min_equal=min_equal).collect()
        want = brute_overlaps(texts, items, min_tokens, min_equal)
        assert {(r["doc_id"], r["item_id"], r["n_tokens"], r["n_equal"], r["start"], r["end"]) for r in got} == want
        assert len(got) == len(want)


def test_bpe_equals_the_library_and_round_trips(docs, empty):
    ranks = merge_replay.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in odd_texts():
        want[i, tuple(known.encode_ordinary(t or "")), (t or "").encode()] += 1
    got = merge_replay.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert merge_replay.token_digests(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_fingerprints(docs, empty):
    texts = [t or "" for _, t in odd_texts()]
    whole = piecewise_hash.fingerprints(pa.array(texts))
    alone = [piecewise_hash.fingerprints(pa.array([t]))[0] for t in texts]
    assert whole == alone and whole[0] == whole[1] and whole[3] == whole[4]
    like = piecewise_hash.likeness([whole[0], whole[0], whole[0]], [whole[1], whole[2], whole[7]])
    assert like[0] == 1 and 0.5 < like[1] < 1 and like[2] < 0.4
    for blocks in (1, 3):
        got = piecewise_hash.fingerprint_edits(docs, n_blocks=blocks).collect()
        order = sorted(odd_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = Counter()
        for k, (i, t) in enumerate(order):
            t, following = t or "", order[k - 1][1] or ""
            half = len(t) // 2
            want[i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert piecewise_hash.fingerprint_edits(empty).count() == 0


def test_url_verdicts(spark):
    urls = ["http://A.net/x", "https://a.example.net/en/1?q", "http://example.com/de/x", "https://w.org/fr/", "http://casino-win.com/7",
            "http://freebets.com/en/1", "http://quiet.com/en/2", None, "no scheme", "x://h.net", "http://Net/", "http://casino-win.com/7"]
    pages = spark.createDataFrame([(k, u, "<title>quiet free</title>", 1) for k, u in enumerate(urls)], "page_id long, url string, html string, host int")
    rules = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in host_words.judge_urls(pages, rules).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][2:] == (None, "block") and got[5][2:] == (None, "block") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9] == ("h.net", "", None, "allow") and got[10][2] == "net/"
    assert host_words.viterbi("freebets", {"free": 5, "bets": 5, "fre": 5}, 100.0) == ["free", "bets"]
    assert host_words.judge_urls(pages.limit(0), rules).count() == 0


def test_verdicts_do_not_depend_on_the_number_of_copies(spark):
    title = "<title>ad s w in e r fr " + passage(40, 30) + "</title>"
    hosts = ["m.ads-track.example.com", "freebets.com", "win-shop.org", "quiet.com", "news.example.org", "adsfree.net", "blog.net"]
    pages = [(k, f"http://{hosts[k % 7]}/{('en', 'de', 'fr')[k % 3]}/{'ab'[k % 2]}/{k}", title) for k in range(20)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    many = pages.crossJoin(spark.range(2000).select()).repartition(4)
    one, more = ({(r["page_id"], r["verdict"], round(r["score"], 6)) for r in host_words.judge_urls(p, ()).collect()} for p in (pages, many))
    assert one == more and {v for _, v, _ in one} == {"allow", "block"}
    counts = spark.createDataFrame([("ad", 300), ("s", 300), ("ads", 18), ("w", 90), ("in", 300), ("win", 18), ("the", 9000)], "word string, n long")
    names = spark.createDataFrame([("ads",), ("win",), ("adswin",), ("thewinner",), ("unknown",)], "name string")
    times = counts.withColumn("n", F.col("n") * 1_000_000)
    assert rows(host_words.split_names(names, counts).select("name", F.concat_ws("+", "parts"))) == rows(
        host_words.split_names(names, times).select("name", F.concat_ws("+", "parts"))
    )


def test_quality_on_held_out_rows(spark, sf_dir, empty):
    good = [(k, passage(k, 60).capitalize() + ".", 1) for k in range(150)]
    bad = [(1000 + k, passage(k, 60).upper().replace(" ", "!! "), 0) for k in range(50)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    ensemble = rule_quality.fit_rules(table.select("doc_id", "text"), table.filter("doc_id % 5 != 0").select("doc_id", "quality"))
    assert 0 < len(ensemble.rules) < 60
    scored = rule_quality.score_quality(table, ensemble).join(table.select("doc_id", "quality"), "doc_id").filter("doc_id % 5 = 0").collect()
    assert all((r["score"] >= 0.5) == (r["quality"] == 1) for r in scored)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in rule_quality.score_quality(odd, ensemble).collect())
    none = rule_quality.fit_rules(empty, table.limit(0).select("doc_id", "quality"))
    assert none.rules == () and rule_quality.score_quality(empty, none).count() == 0


def test_toxicity_chain(spark, docs, empty):
    clean = [(k, passage(k, 40), 0) for k in range(160)]
    toxic = [(1000 + k, passage(k, 20) + (" you idiot, " if k % 2 else " Worthless! ") + passage(k + 7, 20), 1) for k in range(60)]
    table = spark.createDataFrame([*clean, *toxic, (None, "x", 1), (5, None, None)], "doc_id long, text string, toxic int")
    chain = chain_toxicity.fit_chain(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert [c.name for c in chain] == ["insult", "contempt", "toxic"] and len(chain[2].earlier) == 2
    new = spark.createDataFrame([(1, "An IDIOT wrote it"), (2, passage(999, 30)), (3, None), (3, None), (4, "")], "doc_id long, text string")
    got = chain_toxicity.score_toxicity(new, chain).collect()
    assert Counter((r["doc_id"], r["is_toxic"]) for r in got) == Counter({(1, True): 1, (2, False): 1, (3, False): 2, (4, False): 1})
    assert chain_toxicity.drop_toxic(docs, chain).columns == docs.columns
    constant = chain_toxicity.fit_chain(empty, table.limit(0).select("doc_id", "toxic"))
    assert chain_toxicity.score_toxicity(docs, constant).count() == len(odd_texts())
