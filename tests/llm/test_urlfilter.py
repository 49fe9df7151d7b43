import re
from collections import Counter, defaultdict

from vetloom.llm import urlfilter as U

SCHEMA = "page_id long, url string, host string, verdict int"


def plain(pages):
    """The same filter by loops over one host at a time."""
    rows = []
    for page_id, url in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(str.maketrans(U.UPPER, U.LOWER))
        rule = max((r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.text), default=None)
        parts = path.removeprefix("/").split("/")
        rows.append([page_id, host, path, rule, tuple("*" if re.fullmatch(U.VARIABLE.strip("^$"), p) else p for p in parts), ""])
    for level in range(max(len(r[4]) for r in rows)):
        nodes = defaultdict(lambda: defaultdict(Counter))
        for _, host, _, rule, parts, template in rows:
            if level < len(parts):
                nodes[host, template][parts[level]].update(["n", *([rule.verdict] if rule else [])])
        for row in rows:
            if level < len(row[4]):
                node, part = nodes[row[1], row[5]], row[4][level]
                c, total = node[part], sum(node.values(), Counter())
                known = c["allow"] + c["block"]
                label = part
                if known and len(node) > 1:
                    p = total["block"] / (total["allow"] + total["block"])
                    var = known * p * (1 - p)
                    if var == 0 or abs(c["block"] - known * p) / var**0.5 < U.SIMILAR:
                        label = "~"
                if len(node) > U.WIDE and c["n"] * U.WIDE < total["n"] or part == "*":
                    label = "*"
                row.append(label)
        for row in rows:
            if level < len(row[4]):
                row[5] += "/" + row.pop()
    tally = defaultdict(Counter)
    for _, host, _, rule, _, template in rows:
        tally[host, template].update([rule.verdict] if rule else [])
    out = []
    for page_id, host, path, rule, _, template in rows:
        c = tally[host, template]
        purity = (c["allow"] + U.SMOOTHING) / (c["allow"] + c["block"] + 2 * U.SMOOTHING)
        verdict = rule.verdict if rule else "block" if purity < U.LEAST_PURE else "allow"
        out.append((page_id or 0, host, path, rule.text if rule else None, verdict, template))
    return sorted(out, key=str)


def test_against_loops(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x#y", "http://a.example.net/de/2", "http://example.com/de", "http://example.com/de/9.html", "ftp://xorg/fr/1", "x://org/fr/#", "http://h.com?q=/de/", "http://net", "http://net/" + "a/" * 500]
    urls += [f"http://m.example.com/{lang}/{i}" for i in range(30) for lang in ("de", "en", "fr")]
    urls += [f"http://w.example.org/{w}{c}/fr/" for w in "abcdef" for c in "ghijklmnop"]
    urls += [f"http://deep.org/{'fr' if i % 2 else 'x'}/a/b/c/d/{'e' if i % 3 else i}/f/{i % 5}/g" for i in range(30)]
    urls += [f"http://q.net/{'en' if i % 3 else 'x' * (i % 7)}/a-{i}.html" for i in range(40)] + ["http://q.net"] * 3
    pages = [(i or None, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], SCHEMA)
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict, r.template) for r in U.judge(df).collect()), key=str)
    assert got == plain(pages)
    assert U.judge(df.limit(0)).count() == 0


def test_template_rejected(spark):
    urls = [f"http://a.net/x{i}/p" for i in range(60)] + ["http://a.net"] + [f"http://b.example.com/{'de' if i % 9 else 'dk'}/x" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in U.judge(df).collect()}
    assert got[0].template == "/*/p" or got[0].template.startswith("/~") or got[0].template.startswith("/*")
    assert got[60].rule is None and len(got) == len(urls)


def test_unlabelled_templates_back_off(spark):
    rules = (U.Rule("block", "x.com", "/a/bad/"), U.Rule("allow", "x.com", "/b/"), U.Rule("block", "y.com", "/de/"))
    urls = [f"http://x.com/a/bad/{i}" for i in range(5)] + [f"http://x.com/b/{i}" for i in range(10)]
    urls += [f"http://y.com/de/{i}" for i in range(8)]
    # below the blocked branch, below the host, with a tail of slashes, on a blocked host, on a host without labelled urls
    asked = {"http://x.com/a/new": ("block", 1 / 7), "http://x.com/c/1": ("allow", 11 / 17), "http://x.com/a/new/q/r/s/t/u": ("block", 1 / 7)}
    asked |= {"http://y.com/en/1": ("block", 1 / 10), "http://y.com": ("block", 1 / 10), "http://z.com/de/1": ("allow", 1 / 2)}
    asked |= {"http://x.com/b": ("allow", 11 / 12)}
    df = spark.createDataFrame([(None, u) for u in urls + [*asked]] + [(1, None)], "page_id long, url string")
    got = U.judge(df, rules, back_off=True).collect()
    assert len(got) == len(urls) + len(asked) + 1
    seen = {f"http://{r.host}{r.path}": (r.verdict, round(r.purity, 6)) for r in got if r.rule is None}
    want = {u: (v, round(p, 6)) for u, (v, p) in asked.items()} | {"http://": ("allow", 0.5)}
    assert seen == want
    assert [(r.host, r.path, r.rule, r.template) for r in got] and U.judge(df.limit(0), rules, back_off=True).count() == 0
