"""Url filters, conversation tries and periodic runs against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trajq.llm import periodic, prefix_trie, queries, url_filter

# ---- url filter


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host) + len(r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def cheapest(letters, cost, unknown):
    """Every way to cut the letters."""
    best = math.inf
    for cuts in itertools.product([0, 1], repeat=len(letters) - 1):
        at, total = 0, 0.0
        for end in [*[i + 1 for i, c in enumerate(cuts) if c], len(letters)]:
            total += cost.get(letters[at:end], unknown(end - at))
            at = end
        best = min(best, total)
    return best


def check_urls(pages, html):
    """The whole query again, from the rows alone."""
    counts = Counter(w for h in html for w in re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", h or "").lower()) if len(w) <= 24)
    total = math.log(sum(counts.values())) if counts else 0.0
    reader = url_filter.Segmenter(dict(counts))
    seen = {"block": Counter(), "allow": Counter()}
    for _, url, *_ in pages:
        host, path = split_url(url)
        if ruled(host, path)[1]:
            seen[ruled(host, path)[1]].update(reader.tokens(host, path))
    names = set(seen["block"]) | set(seen["allow"])
    n = {k: sum(c.values()) + len(names) for k, c in seen.items()}

    def expected(url):
        host, path = split_url(url)
        rule, verdict = ruled(host, path)
        odds = sum(math.log((seen["block"][t] + 1) / n["block"]) - math.log((seen["allow"][t] + 1) / n["allow"]) for t in reader.tokens(host, path) if t in names and seen["block"] and seen["allow"])
        return host, path, rule, verdict, odds

    return expected, total, counts


def test_query_of_urls(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    expected, _, counts = check_urls(rows, [r[2] for r in rows])
    got = {r["page_id"]: r for r in queries.op11_url_filter(spark, sf).collect()}
    assert len(got) == len(rows)
    for key, url, _ in rows:
        host, path, rule, verdict, odds = expected(url)
        r = got[key]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert abs(r["score"] - 1 / (1 + math.exp(-odds))) < 1e-9
        assert r["verdict"] == (verdict or ("block" if odds > 0 else "allow")) or abs(odds) < 1e-9
        assert "".join(w for w in r["host_words"].split() if w[0] != "#") == re.sub(r"[\W\d_]", "", host)


def test_words_of_hosts_are_the_cheapest_reading():
    rng = random.Random(5)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(25)}
    reader = url_filter.Segmenter(counts)
    total = math.log(sum(counts.values()))
    for _ in range(200):
        name = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 11)))
        words = reader.words(name)
        assert "".join(words) == name
        cost = sum(reader.cost.get(w, total + (len(w) - 1) * math.log(10)) for w in words)
        assert cost == pytest.approx(cheapest(name, reader.cost, lambda k: total + (k - 1) * math.log(10)))
    reader = url_filter.Segmenter({"free": 9, "casino": 5, "games": 7, "as": 20, "in": 30, "news": 8, "daily": 6})
    assert reader.pieces("www2.FreeCasinoGames-24.net".lower())[2:5] == ("free", "casino", "games")
    assert reader.words("x" * 100) and max(map(len, reader.words("x" * 100))) <= url_filter.LONGEST


def test_bayes_learns_what_rules_block(spark):
    pages = [(i, f"http://{'bestcasino' if i % 2 else 'dailynews'}{i}.{'net' if i % 2 else 'org'}/{'x' if i % 2 else 'fr'}/", "<p>best casino daily news") for i in range(40)]
    pages += [(100, "http://newcasino.com/", None), (101, "http://newnews.com/fr/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.filtered(df, queries.RULES).collect()}
    assert (got[100]["verdict"], got[101]["verdict"]) == ("block", "allow") and got[100]["rule"] is None
    assert got[1]["host_words"].startswith("best casino #1")


def test_vocabulary_is_cut_at_a_frequency(spark):
    words = [w for k, w in enumerate(("a", "b", "c", "d", "e")) for _ in range((40, 20, 20, 3, 1)[k])]
    df = spark.createDataFrame([(i, "", f"<i>{w}</i>") for i, w in enumerate(words)], "page_id long, url string, html string")
    assert url_filter.unigrams(df, most=4) == {"a": 40, "b": 20, "c": 20, "d": 3}
    assert url_filter.unigrams(df, most=2) == {"a": 40} and url_filter.unigrams(df, most=0) == {}


def test_odd_urls(spark):
    schema = "page_id long, url string, html string, host string, path string, rule string, ruled string, word string, m string"
    odd = [None, "", "no scheme", "://", "a://b://c/d?e", "http://Example.NET/en/x", "http://example.net", "http://sub.example.net/en", "http://myexample.net/en/", "HTTP://ÄÉ.org/fr/?q", "http://net/", "http://.net/", "http://x.example.com/de/a#b",
           "http://x.example.com?/de/", "http://h#/de/", "http://" + "longname" * 4000 + ".net.com/" + "p/" * 3000, "http://a.net:80/", "http://a\nb.org/fr/\nx", "http://x.org/fr/", "http://x.org/fr/"]
    rows = [(i if i % 7 else None, u, None if i % 3 else "<a>long name</a> word p", *["x"] * 6) for i, u in enumerate(odd)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["host"], r["path"], r["rule"] or "", r["page_id"] or -1) for r in url_filter.filtered(df, queries.RULES).collect())
    assert got == sorted((*split_url(u), ruled(*split_url(u))[0] or "", k or -1) for k, u, *_ in rows)
    allowed = url_filter.filtered(df.where("url not like '%net%' or url is null"), [r for r in queries.RULES if r.verdict == "allow"])
    assert {r["verdict"] for r in allowed.collect()} == {"allow"}
    assert url_filter.filtered(df.limit(0), queries.RULES).count() == 0


# ---- prefix trie


def brute_trie(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    order = lambda y: (*y[:3], hashlib.sha256(f"{len(y[2].encode())}:{y[2]}{y[3]}".encode()).hexdigest()[:32], len(y[3].encode()))
    own = {c: [y[2:] for y in sorted(turns, key=order)] for c, turns in by.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], ends(p)) for p, m in members.items())


def listed(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


TURNS = "conv_id long, turn long, role string, text string"


def test_query_of_tries(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert listed(queries.op12_prefix_trie(spark, sf)) == brute_trie(rows)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_tries_of_odd_turns(spark, parts):
    rng = random.Random(parts)
    rows = [(c, t, rng.choice(["user", None, ""]), rng.choice(["a", "b", "ä" * 3, None, ""])) for c in range(90) for t in range(rng.randrange(0, 11))]
    rows += [(c, 0, "user", "same") for c in range(1000, 3000)]  # copies over several groups of ids
    rows += [(-7, None, "x", "y"), (-7, 3, "b", "c"), (-7, 3, "a", "c"), (-7, 3, "a", "c"), (None, 0, "user", "lost"), (5000, 1, "u", "long " * 50_000)]
    rows += [(6000 + k, t, "u", str(min(t, 60 + k))) for k in range(3) for t in range(70)]  # deep, parting late
    df = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], TURNS + ", key string, depth string, parent string, items string")
    assert listed(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), parts)) == brute_trie(rows)


def test_tries_of_nothing_and_without_turns(spark):
    assert prefix_trie.digest(spark.createDataFrame([], TURNS)).count() == 0
    seqs = spark.createDataFrame([(4, []), (2, [])], "conv_id long, items array<string>")
    assert listed(prefix_trie.trie(seqs)) == [(2, 0, -1, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]


def test_shared_beginnings():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([bytes([rng.randrange(2)]) * 20 for _ in range(rng.randrange(40))] for _ in range(2))
        k = rng.randrange(40)
        b = a[:k] + b
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix_trie.shared(b"".join(a), b"".join(b)) == n


# ---- periodic runs


def brute_runs(words, least=12):
    """For every period, the maximal stretches in which words so far apart agree."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_digest(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if key is not None and words and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_of_runs(spark, sf):
    want = [brute_digest(r["doc_id"], r["text"]) for r in queries.documents(spark, sf).collect()]
    got = [tuple(r)[:8] for r in queries.op13_periodic_runs(spark, sf).collect()]
    assert sorted(got) == sorted(want) and sum(r[1] for r in got) > 10


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        n, letters = rng.randrange(0, 90), rng.choice([1, 2, 3, 8])
        words = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
        least = rng.choice([12, 12, 12, 2, 4, 20])
        assert [tuple(r) for r in periodic.find_runs(np.array(words, np.int64), least).tolist()] == brute_runs(words, least)


def test_common_extensions():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 8, 50, 300):
        for letters in (1, 2, 5):
            words = rng.integers(0, letters, n)
            words[n // 2 :] = words[: n - n // 2]
            ext = periodic.Extensions(words)
            a, b = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
            a, b = a[a != b], b[a != b]
            got = ext.common(a, b)
            for x, y, g in zip(a.tolist(), b.tolist(), got.tolist()):
                k = 0
                while max(x, y) + k < n and words[x + k] == words[y + k]:
                    k += 1
                assert g == k
            assert len(ext.places) <= 3 * (n // 7 + 1)


def test_grid_blocks_hold_every_pair():
    for n, block in ((2, 5), (30, 7), (100, 1000)):
        pairs = [(q, i) for p, x in periodic.grid(n, block) for q, i in zip(p.tolist(), x.tolist())]
        assert pairs == [(q, i) for q in range(1, n // 2 + 1) for i in range(0, n - q, q)]


def test_runs_of_odd_rows(odd, odd_rows, none, make):
    key = lambda r: tuple((x is not None, x) for x in r)
    rows = [r for r in odd_rows if len(r[1] or "") < 50_000]
    assert sorted((tuple(r)[:8] for r in periodic.digest(make(rows)).collect()), key=key) == sorted((brute_digest(r[0], r[1]) for r in rows), key=key)
    assert periodic.digest(odd).count() == len(odd_rows) and periodic.digest(none).count() == periodic.runs(none).count() == 0
    said = make([(1, "x " * 40 + "end", "en", "a"), (2, "a b c", "en", "a"), (None, "p q r " * 5, "en", "a")])
    assert sorted(tuple(r)[1:] for r in periodic.runs(said).collect()) == [(0, 15, 3), (0, 40, 1)]
    assert {r["text"] for r in periodic.collapsed(said).collect()} == {"x end", "a b c", "p q r"}
    long = make([(0, ("w " * 50_000) + "tail", "en", "a")])
    assert periodic.runs(long).first()["length"] == 50_000
