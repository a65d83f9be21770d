"""URL rules and the path-template tree against a plain version."""

import collections
import random
import re

import pytest

from calibra.llm import url_tree
from calibra.llm.queries import URL_RULES

SCHEMA = "page_id long, url string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def chi_square(x, y):
    n, m = sum(x), sum(y)
    return sum((m * i - n * j) ** 2 / (n * m * (i + j)) for i, j in zip(x, y, strict=True) if i + j)


def plain_templates(paths):
    """{path: template} of one host; paths: {path: label}."""
    out = {}

    def visit(node, own, level):
        going = collections.defaultdict(list)
        for path in own:
            segments = path.split("/")[1:]
            if len(segments) <= level:
                out[path] = node
            else:
                going[segments[level]].append(path)
        m = sum(map(len, going.values()))
        if m < url_tree.GROW:
            out.update({p: node + "/??" for ps in going.values() for p in ps})
            return
        rows = []
        for segment, ps in going.items():
            if len(ps) >= 2 and len(ps) ** 2 >= m:
                b, a = (sum(paths[p] == v for p in ps) for v in ("block", "allow"))
                rows.append((b / len(ps), a / len(ps), segment, (b, a, len(ps) - b - a)))
        rows.sort()
        groups = []
        for i, row in enumerate(rows):
            if i and chi_square(row[3], rows[i - 1][3]) <= url_tree.CRITICAL:
                groups[-1].append(row[2])
            else:
                groups.append([row[2]])
        branch = {s: min(g) + ("?" if len(g) > 1 else "") for g in groups for s in g}
        below = collections.defaultdict(list)
        for segment, ps in going.items():
            below[branch.get(segment, "?")] += ps
        for name, ps in below.items():
            visit(f"{node}/{name}", ps, level + 1)

    visit("", list(paths), 0)
    return out


def plain(rows, rules):
    by_host = collections.defaultdict(dict)
    for _, url in rows:
        host, path = plain_parts(url)
        by_host[host][path] = plain_rule(host, path, rules)[1]
    templates = {h: plain_templates(paths) for h, paths in by_host.items()}
    stats = collections.defaultdict(list)
    for h, paths in by_host.items():
        for p, label in paths.items():
            stats[h, templates[h][p]].append(label)
    out = []
    for i, url in rows:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path, rules)
        template = templates[host][path]
        labels = stats[host, template]
        purity = (labels.count("block") + 1) / (len(labels) - labels.count(None) + 2)
        out.append((i, host, path, rule, template, round(purity, 9),
                    verdict or ("block" if purity >= url_tree.PURITY else "allow")))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.template, round(r.purity, 9), r.verdict)
                   for r in frame.collect()), key=repr)


def test_parts(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Exämple.ÄB/Path?x#y", "a://b", "a://b?c/d", "x://://y/z", "a://h/p#f?g",
            "http://h/\nline/ü", "http:///only", "http://h//two//"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], SCHEMA)
    assert got(url_tree.judge_urls(frame, URL_RULES)) == plain(list(enumerate(urls)), URL_RULES)


def test_rules(spark):
    urls = ["http://net/", "http://net", "http://a.net/x", "http://planet/x", "http://a.example.net/en/1",
            "http://example.net/en", "http://x.example.com/de/", "http://b.org/fr/1", "http://b.org/en/1"]
    rules = {r.page_id: r.rule for r in url_tree.judge_urls(
        spark.createDataFrame(list(enumerate(urls)), SCHEMA), URL_RULES).collect()}
    assert [rules[i] for i in range(9)] == ["net/", None, "net/", None, "example.net/en/", "net/", "example.com/de/",
                                           "org/fr/", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_plain(spark, seed):
    rng = random.Random(seed)
    rules = [("block", "h1", "/shop/sale"), ("allow", "h1", "/docs/"), ("block", "h2", "/u/a"), ("allow", "h2", "/u/b/")]
    words = ["shop", "docs", "u", "news", "a", "b", "sale1", "sale2", "", "?"[:0] + "x"]
    rows = []
    for i in range(1500):
        depth = rng.randint(0, 4)
        segments = [rng.choice(words) if rng.random() < 0.7 else str(rng.randint(0, 500)) for _ in range(depth)]
        rows.append((i, f"http://h{rng.choice([1, 1, 1, 2, 3])}/" + "/".join(segments)))
    rows += [(9999, rows[0][1])] * 40 + [(None, None)]
    found = got(url_tree.judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(5), rules))
    assert found == plain(rows, rules)
    assert any("?" in r[4].replace("/??", "") for r in found) and len({r[4] for r in found}) > 20


def test_tree_decides_urls_without_a_rule(spark):
    # item pages of one template: most are blocked by rules, the rest follow; the shop's help pages do not
    urls = [f"http://s.x/item/{i}/buy" for i in range(100)] + [f"http://s.x/help/{i}" for i in range(40)]
    rules = [("block", "s.x", f"/item/{i}/") for i in range(60)] + [("allow", "s.x", "/help/1")]
    out = {r.page_id: r for r in url_tree.judge_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA), rules).collect()}
    assert all(out[i].verdict == "block" for i in range(100)) and out[80].rule is None
    assert out[80].template == "/item/?/buy"
    assert all(out[i].verdict == "allow" for i in range(100, 140))


def test_native_plan(spark, sf_dir):
    from calibra.llm.queries import op11_url_filter

    plan = op11_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExternalRDD", "CartesianProduct"))


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "http://a.net/x", "mine", 3)], "page_id long, url string, host string, salt int")
    row = url_tree.judge_urls(frame, URL_RULES).first()
    assert (row.host, row.salt, row.verdict) == ("a.net", 3, "block")
    assert url_tree.judge_urls(frame.limit(0), URL_RULES).collect() == []


def test_very_deep_and_long_paths(spark):
    urls = ["http://d.net/" + "/".join(["s"] * 3000), "http://d.net/" + "x" * 100_000]
    rows = list(enumerate(urls))
    assert got(url_tree.judge_urls(spark.createDataFrame(rows, SCHEMA), URL_RULES)) == plain(rows, URL_RULES)
