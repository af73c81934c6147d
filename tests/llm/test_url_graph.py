import random
import re
from collections import Counter, defaultdict

import pytest

from quillstone.llm import url_graph as U


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for kind, domain, start in U.RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(start) and (best is None or len(domain + start) > len(best[0])):
            best = (domain + start, kind)
    return best or (None, None)


def brute(rows):
    parts = [(split(u), rule(*split(u)), h) for _, u, h in rows]
    pages, good, bad, links = Counter(), Counter(), Counter(), Counter()
    for (host, _), (_, kind), html in parts:
        if host:
            pages[host] += 1
            good[host] += kind == "allow"
            bad[host] += kind == "block"
            for to in re.findall(r'href="((?:https?:)?//[^"]*)"', html or ""):
                dst = split(to if "://" in to else "x:" + to)[0]
                if dst and dst != host:
                    links[host, dst] += 1
    trust, distrust = ({h: s[h] / n for h, n in pages.items()} for s in (good, bad))
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    t, d = dict(trust), dict(distrust)
    for _ in range(U.STEPS):
        a, b = defaultdict(float), defaultdict(float)
        for (src, dst), n in links.items():
            a[dst] += t.get(src, 0) * n / out[src]
            b[src] += d.get(dst, 0) * n / into[dst]
        t = {h: trust.get(h, 0) + 0.85 * a[h] for h in {*trust, *a}}
        d = {h: distrust.get(h, 0) + 0.85 * b[h] for h in {*distrust, *b, *a}}
    return [(i, *p, r[0], r[1] or ("block" if d.get(p[0], 0) > max(U.LEAST, t.get(p[0], 0)) else "allow")) for (i, _, _), (p, r, _) in zip(rows, parts, strict=True)]


URLS = [None, "", "no scheme", "http://", "http://x.net", "HTTP://A.NET/", "http://net/x", "http://planet/x", "http://b.example.net/en/1?q=/de/", "http://example.net/en", "https://c.example.com/de/9#t", "http://d.org/fr/?x", "http://org/fr/", "x://y?z://net/", "http://É.Example.COM/de/"]


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.example.{t}" for i in range(12) for t in ("com", "org", "net", "edu")]
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    for i in range(300):
        html = "<p>" + "".join(f'<a href="{rng.choice(["http://", "//", "https://"])}{rng.choice(hosts)}/x">l</a>' for _ in range(rng.randrange(4))) + '<a href="/own">o</a>'
        rows.append((100 + i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{i}", html))
    rows += [rows[-1], (None, *rows[-2][1:])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(map(tuple, U.judged(pages).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


@pytest.mark.parametrize("url", URLS)
def test_parts(spark, url):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(url,)], "url string").select(U.host_of(F.col("url")), U.path_of(F.col("url"))).first()
    assert tuple(row) == split(url)


def test_empty(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
