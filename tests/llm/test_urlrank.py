"""URL rules and link-graph judgement against plain Python."""

from corpusmill.llm import urlrank as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SCHEMA = "page_id long, url string, html string, host string, rule string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)


def judge(spark, rows, **k):
    return {r["page_id"]: r for r in U.judge_urls(frame(spark, rows), RULES, **k).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://EXAMPLE.net/en/x?y": ("example.net", "/en/x", "example.net/en/", "allow"),
        "http://a.example.net/en": ("a.example.net", "/en", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://a.net?x=/": ("a.net", "", None, "allow"),
        "x://b.org/fr/#z": ("b.org", "/fr/", "org/fr/", "allow"),
        "https://org/fr/a": ("org", "/fr/a", "org/fr/", "allow"),
        "https://borg/fr/a": ("borg", "/fr/a", None, "allow"),
        "http://x.example.com/de/a://b/c": ("x.example.com", "/de/a://b/c", "example.com/de/", "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://É.Net/": ("É.net", "/", "net/", "block"),
    }
    found = judge(spark, [(n, u, None) for n, u in enumerate(cases)])
    for n, (u, want) in enumerate(cases.items()):
        assert tuple(found[n][c] for c in ("host", "path", "rule", "verdict")) == want, u


def plain(rows):
    hosts, links = {}, {}
    for host, action, targets in rows:
        hosts.setdefault(host, []).append(action)
        for t in set(targets) - {host}:
            links[host, t] = links.get((host, t), 0) + 1
    seeds = [{h: a.count(k) / len(a) for h, a in hosts.items() if k in a} for k in ("allow", "block")]
    result = []
    for kind, seed in enumerate(seeds):
        edges = {(a, b) if kind == 0 else (b, a): n for (a, b), n in links.items()}
        out = {}
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        score = {h: 0.15 * v for h, v in seed.items()}
        for _ in range(10):
            new = {h: 0.15 * v for h, v in seed.items()}
            for (a, b), n in edges.items():
                new[b] = new.get(b, 0) + 0.85 * score.get(a, 0) * n / out[a]
            score = new
        result.append({h: v / 0.15 for h, v in score.items()})
    return result


def test_trust_and_distrust_flow(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">.</a>' for h in hosts)
    rows = [
        (1, "http://bad.net/a", link("x.io")),
        (2, "http://spam.io/a", link("bad.net", "BAD.net")),
        (3, "http://spam.io/b", "<a HREF='//bad.net/'>" + link("spam.io")),
        (4, "http://far.io/", link("spam.io", "good.org")),
        (5, "http://good.org/fr/", link("friend.io", "spam.io")),
        (6, "http://friend.io/", None),
        (7, "http://alone.io/", ""),
        (7, "http://alone.io/", ""),
    ]
    trust, distrust = plain(
        [("bad.net", "block", ["x.io"]), ("spam.io", None, ["bad.net"]), ("spam.io", None, ["bad.net", "spam.io"]), ("far.io", None, ["spam.io", "good.org"]), ("good.org", "allow", ["friend.io", "spam.io"]), ("friend.io", None, []), ("alone.io", None, [])]
    )
    found = U.judge_urls(frame(spark, rows), RULES).collect()
    assert len(found) == len(rows)
    for r in found:
        assert abs(r["trust"] - trust.get(r["host"], 0)) < 1e-6 and abs(r["distrust"] - distrust.get(r["host"], 0)) < 1e-6
        if r["rule"] is None:
            assert r["verdict"] == ("block" if round(r["distrust"] - r["trust"], 9) >= 0.5 else "allow")
    assert {r["page_id"]: r["verdict"] for r in found}[6] == "allow"
    low = {r["host"]: r["verdict"] for r in U.judge_urls(frame(spark, rows), RULES, threshold=0.05).collect()}
    assert low["spam.io"] == "block"


def test_empty_table(spark):
    assert U.judge_urls(frame(spark, []), RULES).count() == 0
