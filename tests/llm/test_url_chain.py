"""Propagation over long chains and on cycles, against exact solutions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cuetide.llm import urlfilter

EDGES, SEEDS = "source string, target string, weight double", "host string, trust double, distrust double"


def test_chain_of_hosts(spark):
    links = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(29)]
    got = {r.host: r for r in urlfilter.propagate(spark.createDataFrame(links, EDGES), spark.createDataFrame([("h29", 0.0, 1.0)], SEEDS)).collect()}
    assert len(got) == 30
    for i in range(30):
        assert got[f"h{i}"].distrust == pytest.approx(0.15 * 0.85 ** (29 - i), rel=1e-9) and got[f"h{i}"].trust == 0
    pages = [(i, f"http://h{i}/", f'<a href="http://h{i + 1}/">') for i in range(29)] + [(29, "http://h29/", "")]
    judged = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), [urlfilter.Rule("h29/", "block")])
    assert {r.verdict for r in judged.collect()} == {"block"}


def test_cycle_settles(spark):
    links = [("a", "b", 1.0), ("b", "a", 1.0)]
    edges, seeds = spark.createDataFrame(links, EDGES), spark.createDataFrame([("a", 1.0, 0.0)], SEEDS)
    got = {r.host: r.trust for r in urlfilter.propagate(edges, seeds).collect()}
    assert got["a"] == pytest.approx(0.15 / (1 - 0.85**2), rel=1e-5) and got["b"] == pytest.approx(0.85 * got["a"], rel=1e-5)
    with pytest.raises(RuntimeError):
        urlfilter.propagate(edges, seeds, most_rounds=5)


def test_verdicts_over_a_planted_graph_of_hosts(spark):
    """Every verdict against rules and ranks computed plainly, over pages whose links cross hosts."""
    rnd = random.Random(11)
    hosts = [f"h{i}.{'net' if i % 9 == 0 else 'org' if i % 7 == 0 else 'com'}" for i in range(60)]
    pages, hot = [], hosts[4]
    for page in range(600):
        host = rnd.choice([*hosts, hot, hot])
        path = rnd.choice(["/", "/fr/", "/en/x", "/de/"])
        targets = [rnd.choice([hosts[rnd.randrange(60)], hot]) for _ in range(rnd.randrange(4))]
        html = None if page % 50 == 0 else " ".join(f'<a href="{rnd.choice(["http://", "//", "HTTPS://"])}{t.upper() if page % 3 else t}/q">' for t in targets) + '<img src="/local.png">'
        pages.append((page, f"http://{host}{path}", html))
    pages += [(900, None, "<a href=//h1.com/>"), (901, "no host", None)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), urlfilter.RULES).collect()}

    rule_of, links, by_host = {}, defaultdict(set), defaultdict(list)
    for page, url, html in pages:
        if not url or "://" not in url:
            continue
        host, _, rest = url.partition("://")[2].partition("/")
        path = "/" + rest
        fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule_of[page] = (host, max(fits, key=lambda r: (len(r.host), len(r.path)), default=None))
        by_host[host].append(rule_of[page][1])
        for target in re.findall(r'href="[A-Za-z]*:?//([^/"]+)', html or ""):
            if target.lower() != host:
                links[host, target.lower()].add(page)
    weight = {k: len(v) for k, v in links.items()}
    seeds = [{h for h, rs in by_host.items() if sum(r is not None and r.verdict == v for r in rs) > len(rs) / 2} for v in ("allow", "block")]
    every = sorted({x for k in weight for x in k} | set(by_host))
    place = {h: i for i, h in enumerate(every)}
    ranks = []
    for forward, seed in ((True, seeds[0]), (False, seeds[1])):
        walk = np.zeros((len(every), len(every)))
        for (a, b), w in weight.items():
            walk[(place[b], place[a]) if forward else (place[a], place[b])] = w
        walk /= np.maximum(walk.sum(0), 1e-300)
        start = np.array([1.0 / len(seed) if h in seed else 0.0 for h in every])
        ranks.append(np.linalg.solve(np.eye(len(every)) - 0.85 * walk, 0.15 * start))
    trust, distrust = ranks
    blocked = 0
    for page, url, _ in pages:
        host, rule = rule_of.get(page, ("", None))
        at = place.get(host)
        bad = at is not None and distrust[at] > 0.5 * (trust[at] + distrust[at])
        want = rule.verdict if rule else "block" if bad else "allow"
        blocked += rule is None and bad
        assert (got[page].verdict, got[page].rule) == (want, rule and rule.text), url
        if at is not None:
            assert got[page].trust == pytest.approx(trust[at], rel=1e-4, abs=1e-12)
    assert seeds[0] and seeds[1] and blocked > 10 and any(r is None and got[p].verdict == "allow" for p, (_, r) in rule_of.items())
