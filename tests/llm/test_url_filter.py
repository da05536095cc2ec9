import fnmatch
import random
import re

from tocsin.llm import url_filter
from tocsin.llm.url_filter import RULES, GlobAutomaton


def as_regex(glob):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts), re.S)


def test_automaton_like_regular_expressions():
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?", "é"]) for _ in range(rng.randint(0, 9)))
             for _ in range(150)]
    texts = ["", "/"] + ["".join(rng.choice("ab/.éx\n") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = GlobAutomaton(globs).matches(texts)  # several words of 64 states
    for j, g in enumerate(globs):
        assert got[:, j].tolist() == [bool(as_regex(g).fullmatch(t)) for t in texts], g


def judge_one(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in RULES for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_rules(table):
    urls = [None, "", "x", "http://", "http://org", "http://ORG/", "http://a.org/x?y", "http://aorg/", "http://example.org/es/1",
            "http://example.org/es", "http://w.example.org/en/15", "http://example.org/en/2", "http://b.com/fr/", "b://c.com/de/#x",
            "http://com/fr/x", "http://a.com?x/fr/", "http://x.ads-track.com/", "http://x.de/wp-login.php", "a://b://org/",
            "http://İ.org/\n/x", "http://a.org:80/", "http://e.org/" + "y" * 20_000] * 2
    df = table(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS verdict", "'h' AS host")
    for r in url_filter.judge(df).collect():
        host, path, rule = judge_one(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == dict(RULES)[rule]
        else:
            assert r.verdict == ("block" if r.globs else "allow")
            assert r.globs == [g for g in url_filter.BLOCK_GLOBS if as_regex(g).fullmatch(f".{host}{path}")]


def test_empty(table):
    assert url_filter.judge(table([], "page_id long, url string")).collect() == []


def test_fnmatch_agrees_without_slashes():
    globs, texts = ["a*b", "?x*", "*"], ["ab", "axxb", "zx", "", "zxy"]
    got = GlobAutomaton(globs).matches(texts)
    assert got.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_clashing_columns(table):
    from tocsin.llm.url_filter import judge
    df = table([("http://a.org/x", 7, "old", "r")], "url string, `_found` int, host string, `row` string")
    out = judge(df)
    assert out.columns == ["url", "_found", "row", "host", "path", "rule", "verdict", "globs"]
    r = out.first()
    assert (r["_found"], r["row"], r["host"], r["rule"], r["verdict"]) == (7, "r", "a.org", "org/", "allow")
    assert judge(df.limit(0)).collect() == []
