import random
import re

import numpy as np

from paperlake.llm.queries import URL_RULES
from paperlake.llm.url_filter import SPAM_GLOBS, Automaton, Rule, glob_pattern, judge_urls, parse_glob

WIDE = (*URL_RULES, Rule("block", "example.org", "/"), Rule("allow", "a.b", "/x"), Rule("block", "b", "/xy"))


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.name), r.verdict != "block"), default=None)
    return host, path, best and best.name, best.verdict if best else default


def test_against_plain_rules(spark):
    r = random.Random(3)
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "org", "com", "x.com", "xcom", "evil.com", "b", "a.b", "c.a.b", "", "example.org:80", "ü.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q#f", "/fr/", "/de/x", "/x.org/es/", "/xyz", "?a=/de/", "#/de/", "/ü/%20", "/x\ny", "//", "/de/" * 60]
    urls = [f"{r.choice(['http', 'HTTPS', 'a://b'])}://{h}{p}" for h in hosts for p in paths]
    urls += [None, "", "no scheme", "://", "http:/x", "mailto:a@org"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls + urls)], "page_id long, url string, verdict string")
    for rules in (URL_RULES, WIDE, ()):
        got = judge_urls(df, rules).collect()
        assert len(got) == 2 * len(urls)
        for row in got:
            assert (row.host, row.path, row.rule, row.verdict) == plain(row.url, rules), row.url
    assert judge_urls(df.limit(0), URL_RULES).count() == 0


def test_globs():
    globs = ["a*c", "a**c", "?b", "**", "", "x*", "*/y", "é?"]
    texts = ["abc", "a/c", "ab", "ac", "", "x", "xyz", "x/y", "q/y", "éa", "b"]
    pattern = {"a*c": "a[^/]*c", "a**c": "a.*c", "?b": ".b", "**": ".*", "": "", "x*": "x[^/]*", "*/y": "[^/]*/y", "é?": "é."}
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = Automaton([parse_glob(g) for g in globs * 12]).match(data, offsets)  # several words of bits
    for i, t in enumerate(texts):
        for j, g in enumerate(globs * 12):
            assert got[i, j] == bool(re.fullmatch(pattern[g], t, re.S)), (g, t)


def test_globs_decide_where_no_rule_fits(spark):
    hosts = ["casino-win.example.org", "www.cheap-pills.example.com", "free-bets.net", "alphabets.net", "spam-farm.example.org", "CASINO.org", "plain.net"]
    paths = ["", "/", "/casino/x", "/fr/a", "/de/a", "/es/a", "/wp-admin/", "/a/b.exe", "/a.exe/b", "/ü.apk", "/" + "x/" * 5000 + "cgi-bin/y"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "casino", "://", "://casino"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, pattern string")
    seen = set()
    for row in judge_urls(df, URL_RULES, blocked=SPAM_GLOBS).collect():
        host, path, rule, verdict = plain(row.url, URL_RULES)
        fits = [g for g in SPAM_GLOBS if host + path and re.fullmatch(glob_pattern(g), host + path)] if rule is None else []
        assert (row.rule, row.verdict, row.pattern) == (rule, "block" if fits else verdict, fits[0] if fits else None), row.url
        seen.add(row.pattern)
    assert {None, "*casino**", "*pills**", "*-bets**", "**/wp-admin/**", "**.exe", "**.apk", "**/cgi-bin/**"} <= seen
    assert {r.pattern for r in judge_urls(df, (), blocked=()).collect()} == {None}
