"""Operators 11 to 13 against brute force, on small tables with the odd cases that the docstrings define."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import divergence, prefix_trie, url_filter

# ---- 11 prefix trie ------------------------------------------------------------------------------------------------


def brute_trie(rows):
    """Nodes of the trie from whole sequences of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            key = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), key, r, t))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, n=60):
    rows = []
    for c in [*range(n), -7, -5, 1005]:
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, turn, ["user", "assistant"][turn % 2], f"t{int(rng.integers(0, 2))} é" * int(rng.integers(0, 3))))
    copied = [(c, t, "user", f"same {t}") for c in range(200, 240) for t in range(12)]  # equal, but for what bases change
    return rows + copied


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = conversations(rng)
    if seed:  # nulls, ties, repeated rows, a missing base, a long text
        rows = [r for r in rows if r[0] != 10] + [(3, None, None, None), (3, None, "a", "b"), (4, 1, "user", "tie"), (4, 1, "assistant", "tie"), (4, 1, "user", "tie"), (None, 0, "user", "of none"), (11, 7, "user", "x" * 50_000), (12, 3, "", ""), (13, 3, "a", "bc"), (14, 3, "ab", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(1) for n in ("pos", "key", "rep", "cls", "n", "k", "length", "bytes", "depth")})
    got = prefix_trie.trie(df)
    assert got.dtypes == [(n, "bigint") for n in prefix_trie.NODE] + [("ends_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_trie_of_one_sequence_and_of_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", f"turn {t}") for c in range(40, 45) for t in range(10)]
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, schema)).collect()), key=repr) == brute_trie(rows)
    assert prefix_trie.trie(spark.createDataFrame([], schema)).collect() == []
    short = [(4, 0, "user", "gone")]  # its first turns are replaced by those of a base that is not there
    assert [tuple(r) for r in prefix_trie.trie(spark.createDataFrame(short, schema)).collect()] == brute_trie(short)


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    members = spark.createDataFrame([(r, r + 3 * i) for r in (5, 7) for i in range(400)], "rep long, conv_id long").repartition(7)
    want = {r: hashlib.sha256(",".join(str(r + 3 * i) for i in range(400)).encode()).hexdigest() for r in (5, 7)}
    assert dict(map(tuple, prefix_trie.ids_sha256(members).collect())) == want


# ---- 12 divergence -------------------------------------------------------------------------------------------------


def brute_divergence(rows, least, most):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held, occurs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        held[lang].update(set(words(text)))
        occurs[lang, source].update(words(text))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in held[lang].items() if n >= least]
        whole = Counter({w: sum(occurs[lang, s][w] for s in sources) for w in kept})

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p, q = {s: shares(occurs[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if occurs[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < most]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["The", "the", "naïve", "ÉTÉ", "été", "日本", "a", "x_y", "b2c", "don't", "\U0001f600", "zz", "ı", "İ"]
    rows = [(" ".join(rng.choice(vocabulary, int(rng.integers(0, 12)))), str(rng.choice(["en", "fr"])), f"s{int(rng.integers(0, 4))}") for _ in range(150)]
    rows += [(None, "en", "s9"), ("", None, None), ("only here", "qq", "one"), ("only here", "qq", "two"), ("the the the", "en", None), (rows[0]), ("the " * 20_000, "en", "s0"), ("@@@ 123", "en", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({n: F.lit("own") for n in ("term", "words", "n", "docs", "of", "by", "salt", "item", "value", "rank", "part")})
    got = sorted(map(tuple, divergence.audit(df, min_docs=6, ranks=3).collect()))
    assert got == brute_divergence(rows, 6, 3) and {r[2] for r in got} == {"pair", "term"}
    assert ("qq", "one", "pair", "two", 0, 1) in got  # a language without kept terms
    assert divergence.audit(df.limit(0)).collect() == []


def test_shares_are_exact_beyond_longs(spark):
    """Counts of which a billion times overflows 64 bits."""
    rows = [(c, t, v) for c in (10**11, 9 * 10**11 + 7) for t in (10**12, 3 * 10**13) for v in (1, 10**6)]
    got = spark.createDataFrame(rows, "c long, t long, v long").select("c", "t", "v", F.expr(divergence.share("c", "t")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.t + 5 * r.v) for r in got)


# ---- 13 URL filter -------------------------------------------------------------------------------------------------


def brute_kind(s):
    if s is None:
        return 0
    return 1 if s == "" else 2 if re.fullmatch("[0-9]+", s) else 3 if s.isalpha() else 4 if re.fullmatch(r"[0-9]+\.[A-Za-z]+", s) else 5


def brute_judge(urls, rules, given=None):
    """(host, path, rule, verdict, template, purity) of each url by walking the tree host by host and node by node."""
    pages = []
    for i, url in enumerate(urls):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        label = rule.verdict if rule else (given or {}).get(i)
        pages.append((host, path, rule, label))
    labels = [x[3] for x in pages if x[3]]
    prior = labels.count("block") / len(labels) if labels else 0.0
    m = url_filter.WEIGHT
    found = {}

    def smoothed(own, parent):
        bad, good = (sum(x[3] == v for x in own) for v in ("block", "allow"))
        return (bad + m * parent) / (good + bad + m)

    def segments(path):
        return re.sub("^/", "", path).split("/", url_filter.DEPTH - 1)

    def near(x, n, y, k):
        return abs(x / n - y / k) <= math.sqrt(math.log(2 / url_filter.ALPHA) / 2) * (1 / math.sqrt(n) + 1 / math.sqrt(k))

    def alike(a, b, depth):
        follow = [[sum(brute_kind((segments(x[1])[depth + 1 :] or [None])[0]) == k for x in own) for k in range(6)] for own in (a, b)]
        if not all(near(x, len(a), y, len(b)) for x, y in zip(*follow, strict=True)):
            return False
        bad, all_ = ([sum(x[3] in v for x in own) for own in (a, b)] for v in (("block",), ("block", "allow")))
        return all_[0] == all_[1] if 0 in all_ else (2 * bad[0] >= all_[0]) == (2 * bad[1] >= all_[1]) and near(bad[0], all_[0], bad[1], all_[1])

    def walk(own, node, purity, depth):
        for x in own:
            if len(segments(x[1])) <= depth:
                found[x[0], x[1]] = (node, purity)
        own = [x for x in own if len(segments(x[1])) > depth]
        counts = Counter(segments(x[1])[depth] for x in own)
        branches = defaultdict(list)
        for x in own:
            s = segments(x[1])[depth]
            stays = s == "" or counts[s] >= url_filter.SUPPORT and counts[s] * url_filter.MOST >= len(own)
            branches[f"={s}" if stays else f"*{url_filter.KINDS[brute_kind(s)]}"].append(x)
        merged = []
        for name, rows in sorted(branches.items(), key=lambda b: (-len(b[1]), b[0])):
            to = next((g for g in merged if alike(g[1], rows, depth)), None)
            if to:
                to[0].append(name)
                to[1].extend(rows)
            else:
                merged.append(([name], list(rows)))
        for names, rows in merged:
            walk(rows, node + "/" + "|".join(sorted(names)), smoothed(rows, purity), depth + 1)

    for host in {x[0] for x in pages}:
        own = [x for x in pages if x[0] == host]
        walk(own, "", smoothed(own, prior), 0)
    out = []
    for i, (host, path, rule, label) in enumerate(pages):
        template, purity = found[host, path]
        out.append((i, host, path, rule.text if rule else None, label or ("block" if purity >= url_filter.REJECT else "allow"), template, round(purity, 9), label is not None))
    return out


def urls(rng, n=400):
    hosts = ["a.example.org", "Shop.Example.com", "x.net", "m.x.net", "deep.io"]
    shapes = ["/{l}/{n}", "/{l}/{n}.html", "/{l}/{n}/", "/{l}/{w}/{n}?q=/a", "/shop/{n}/item/{n}#top", "/spam/{n}", "/{w}"]
    fill = lambda s: s.replace("{l}", str(rng.choice(["en", "de", "fr", "es"]))).replace("{n}", str(int(rng.integers(1, 999)))).replace("{w}", "w" + str(rng.choice(list("abcdefgh"))))
    return [f"http{'s' * int(rng.integers(0, 2))}://{rng.choice(hosts, p=[.2, .2, .4, .1, .1])}{fill(str(rng.choice(shapes)))}" for _ in range(n)]


def test_url_filter_equals_brute_force(spark):
    every = urls(np.random.default_rng(6)) + [None, "", "no scheme.org/de/1", "http://", "HTTP://ORG", "ftp://org/x", "x://example.org/en/1", "http://example.org/en/2", "http://y.com/de/", "http://y.com/de", "http://notexample.org/es/1", "://a.example.org?/es/", "a://b://c/d", "http://deep.io/" + "/".join("abcdefghijklmnop"), "http://deep.io/" + "z" * 30_000, "http://xcom/fr/", "http://üñí.org/en/1", "http://x.net/\n/1"]
    every += [every[0]] * 40 + [every[1]] * 2
    df = spark.createDataFrame(list(enumerate(every)), "page_id long, url string").withColumns({n: F.lit(1) for n in ("host", "path", "number", "label", "verdict", "n", "node", "segments", "purity")})
    spam = {i: "block" for i, u in enumerate(every) if u and "/spam/" in u and i % 2}
    fine = {i: "allow" for i, u in enumerate(every) if u and "/shop/" in u and i % 2}
    given = spark.createDataFrame([(i, v) for i, v in (spam | fine).items()], "page_id long, verdict string")
    for labels, told in ((None, None), (given, spam | fine)):
        got = url_filter.judge(df, labels=labels).collect()
        shown = sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9), r.labelled) for r in got)
        assert shown == brute_judge(every, url_filter.RULES, told)
    unlabelled = [r for r in got if not r.labelled and "/spam/" in r.path]
    blocked = [r for r in unlabelled if r.verdict == "block"]
    assert len(unlabelled) > 10 and 2 * len(blocked) > len(unlabelled)  # templates carry labels on to pages without any
    assert all(r.verdict == "allow" for r in got if not r.labelled and "/shop/" in r.path)


def test_url_filter_of_few_pages(spark):
    schema = "page_id long, url string"
    assert url_filter.judge(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None), (None, None), (1, "https://q.org/x"), (1, "https://q.com/de/1?x")]
    got = sorted(map(repr, (r[:5] for r in map(tuple, url_filter.judge(spark.createDataFrame(rows, schema)).collect()))))
    assert got == sorted(map(repr, [(None, "", "", None, "allow"), (None, "", "", None, "allow"), (1, "q.org", "/x", "org/", "allow"), (1, "q.com", "/de/1", "com/de/", "block")]))
    bare = url_filter.judge(spark.createDataFrame(rows, schema), rules=()).collect()
    assert {r.verdict for r in bare} == {"allow"} and not any(r.labelled for r in bare)
