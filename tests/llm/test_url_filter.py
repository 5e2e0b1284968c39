from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from wayfare.llm import url_filter


def judged(spark, pages, labels=()):
    p = spark.createDataFrame(pages, "page_id long, url string, host string, verdict string")
    y = spark.createDataFrame(list(labels), "page_id long, good int")
    return {r.page_id: r for r in url_filter.judge(p, y).collect()}


def test_parts_and_rules(spark):
    urls = ["http://A.Net/x", "https://m.example.net/en/1?q=/de/", "http://example.net/en", "http://w.example.com/de/2", "https://b.org/fr/", "https://b.org", "nothing", None, "x://", "http://net/", "http://inet/q", "http://h.com?x/net/", "a://b://c/d#e"]
    got = judged(spark, [(k, u, "x", "y") for k, u in enumerate(urls)])
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(len(urls))] == [
        ("a.net", "/x", "net/"), ("m.example.net", "/en/1", "example.net/en/"), ("example.net", "/en", "net/"), ("w.example.com", "/de/2", "example.com/de/"), ("b.org", "/fr/", "org/fr/"), ("b.org", "", None),
        ("", "", None), ("", "", None), ("", "", None), ("net", "/", "net/"), ("inet", "/q", None), ("h.com", "", None), ("b:", "//c/d", None),
    ]
    assert [got[k].verdict for k in (0, 1, 3, 4)] == ["block", "allow", "block", "allow"]
    assert judged(spark, []) == {}


def test_templates(spark):
    pages = [(k, f"http://h.com/{'spam' if k % 2 else 'news'}/{k}", "x", "y") for k in range(400)] + [(500, "http://h.com/rare/1", "x", "y"), (501, "http://other.com/a", "x", "y"), (501, "http://other.com/a", "x", "y")]
    labels = [(k, 1 - k % 2) for k in range(0, 400, 3)] + [(k, 1 - k % 2) for k in range(1, 400, 7)]
    got = judged(spark, pages, labels)
    assert got[1].template == "/spam/*" and got[1].verdict == "block" and got[1].purity < 0.1
    assert got[0].verdict == "allow" and got[0].purity > 0.9
    assert got[500].template == "/*/*" and len(got) == 402
    # no labels: nothing tells branches apart, and all is allowed
    assert {r.verdict for r in judged(spark, pages).values()} == {"allow"}


def test_small_share_of_a_hot_host(spark):
    """A directory that is bad throughout is blocked, however large the rest of its host is."""
    dirs = [(f"http://hot.com/d{k % 60}/{k}", 1) for k in range(6000)] + [(f"http://hot.com/bad/{k}", 0) for k in range(60)]
    got = judged(spark, [(k, u, "x", "y") for k, (u, _) in enumerate(dirs)], [(k, good) for k, (_, good) in enumerate(dirs)])
    assert {(got[k].template, got[k].verdict) for k in range(6000, 6060)} == {("/bad/*", "block")}
    assert {got[k].verdict for k in range(6000)} == {"allow"}


def test_branches_below_the_third_segment(spark):
    """However deep the segment is that tells good from bad."""
    heads = {"deep.com": "/a/b", "deeper.com": "/a/b/c/d/e/f"}
    pages = [(2000 * h + k, f"http://{host}{head}/{'spam' if k % 2 else 'news'}/{k}/x", "x", "y") for h, (host, head) in enumerate(heads.items()) for k in range(300)]
    pages += [(9000, "http://deep.com" + "/s" * 500, "x", "y")]
    got = judged(spark, pages, [(k, 1 - k % 2) for k, *_ in pages[:-1]])
    for h, head in enumerate(heads.values()):
        own = [got[2000 * h + k] for k in range(300)]
        assert {r.verdict for r in own[1::2]} == {"block"} and {r.verdict for r in own[::2]} == {"allow"}
        assert {r.template.split("/")[head.count("/") + 1] for r in own} == {"spam", "news"}
        assert all(r.template.count("/") == r.path.count("/") for r in own)
    assert got[9000].template.count("/") == 500 and len(got) == len(pages)


def brute(rows, least=5, z=1.96, weight=4.0):
    """(host, path): (template, purity) of rows (host, path, good or None), by recursion over dictionaries."""
    paths = defaultdict(lambda: [0, 0, 0])
    for host, path, good in rows:
        c = paths[host, path]
        c[0] += 1
        c[1] += good is not None
        c[2] += good or 0
    total = [sum(c[k] for c in paths.values()) for k in range(3)]
    named = {}

    def smooth(c, up):
        return (c[2] + weight * up) / (c[1] + weight)

    def added(cs):
        return [sum(c[k] for c in cs) for k in range(3)]

    def alike(a, b, up):
        x, y, m, k = a[2] + weight * up, b[2] + weight * up, a[1] + weight, b[1] + weight
        p = (x + y) / (m + k)
        return (x / m - y / k) ** 2 <= z * z * p * (1 - p) * (1 / m + 1 / k)

    def grow(host, members, template, level, up):
        pp = smooth(added([paths[host, p] for p in members]), up)
        parts = {p: [x for x in p.split("/") if x] for p in members}
        on = [p for p in members if len(parts[p]) > level]
        c = added([paths[host, p] for p in on])
        grows = c[0] >= least and 0 < c[2] < c[1]
        for p in members:
            if not grows or p not in on:
                named[host, p] = (template + "/*" * (len(parts[p]) - level) or "/", pp)
        if not grows:
            return
        kids, by_value = defaultdict(list), defaultdict(list)
        for p in on:
            by_value[parts[p][level]].append(p)
        for s, ps in by_value.items():
            c = added([paths[host, p] for p in ps])
            kids[s.replace("*", "%2A").replace("|", "%7C") if c[0] >= least and c[1] else "*"] += ps
        grades = defaultdict(list)
        for s, ps in kids.items():
            c = added([paths[host, p] for p in ps])
            grades[int(smooth(c, pp) * 256), -max(1, c[1].bit_length())].append(s)
        branches = []
        for key in sorted(grades):
            c = added([paths[host, p] for s in grades[key] for p in kids[s]])
            if branches and alike(branches[-1][0], c, pp):
                branches[-1] = (added([branches[-1][0], c]), branches[-1][1] + grades[key])
            else:
                branches.append((c, grades[key]))
        for _, names in branches:
            names.sort()
            label = "*" if "*" in names else names[0] if len(names) == 1 else names[0] + ("|" if len(names) == 2 else "|..|") + names[-1]
            grow(host, [p for s in names for p in kids[s]], f"{template}/{label}", level + 1, pp)

    for host in {h for h, _ in paths}:
        grow(host, [p for h, p in paths if h == host], "", 0, (total[2] + 1) / (total[1] + 2))
    sums = defaultdict(lambda: [0, 0, 0])
    for (host, path), (template, _) in named.items():
        for k in range(3):
            sums[host, template][k] += paths[host, path][k]
    return {(h, p): (t, smooth(sums[h, t], pp)) for (h, p), (t, pp) in named.items()}


def test_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        host = rng.choice(["hot.com"] * 8 + ["b.com", "c.com"])
        parts = [rng.choice(["en", "de", "shop", "*", "a|b"]), rng.choice(["x", "y", "z", f"u{rng.randrange(400)}"]), *([str(k)] if rng.random() < 0.7 else []), *(["q", "r"] if rng.random() < 0.2 else [])]
        share = 0.9 if parts[0] in ("en", "*") else 0.15 if parts[1] == "x" else 0.5
        rows.append((k, host, "/" + "/".join(parts), int(rng.random() < share) if rng.random() < 0.5 else None))
    df = spark.createDataFrame(rows, "page_id long, host string, path string, good int")
    branches, found = url_filter.templates(df)
    want = brute([r[1:] for r in rows])
    got = found.collect()
    assert len(got) == len(rows) and len({t for t, _ in want.values()}) > 8
    for r in got:
        template, purity = want[r.host, r.path]
        assert (r.template, round(r.purity, 12)) == (template, round(purity, 12))
    assert branches.agg({"n": "sum"}).first()[0] == len(rows)


def test_alike_siblings_are_one(spark):
    """Two directories that are wholly bad are one branch, beside a good one; and what tells apart may stand deeper."""
    urls = [(f"http://h.com/{d}/{k}", int(d == "ok")) for d in ("s1", "s2", "ok") for k in range(60)] + [(f"http://deep.com/a/b/{d}/{k}", int(d == "y")) for d in "xy" for k in range(200)]
    got = judged(spark, [(k, u, "x", "y") for k, (u, _) in enumerate(urls)], [(k, good) for k, (_, good) in enumerate(urls)])
    assert {got[k].template for k in range(120)} == {"/s1|s2/*"} and {got[k].verdict for k in range(120)} == {"block"}
    assert {(got[k].template, got[k].verdict) for k in range(180, 380)} == {("/a/b/x/*", "block")}
    assert {(got[k].template, got[k].verdict) for k in range(380, 580)} == {("/a/b/y/*", "allow")}


def test_first_of_equal_rules(spark):
    rules = (("block", "a.com", "/"), ("allow", "a.co", "m/"), ("allow", "a.com", "/"))
    r = spark.range(1).select(*(c.alias(n) for n, c in zip(("rule", "verdict"), url_filter.by_rule(F.lit("x.a.com"), F.lit("/q"), rules), strict=True))).first()
    assert tuple(r) == ("a.com/", "block")


def test_odd_rows(spark):
    """Null ids stay, repeated rows too; a very long url and one with nothing but slashes have templates."""
    long = "http://l.com/" + "q" * 200_000
    got = url_filter.judge(
        spark.createDataFrame([(None, "http://a.com/x"), (None, None), (3, long), (3, long), (4, "http://a.com////")], "page_id long, url string"),
        spark.createDataFrame([(3, 0), (3, 1), (None, 0)], "page_id long, good int"),
    ).collect()
    assert sorted((r.page_id or 0, r.template) for r in got) == [(0, "/"), (0, "/*"), (3, "/*"), (3, "/*"), (4, "/")]
    assert all(re.fullmatch("allow|block", r.verdict) for r in got)
