import itertools
import re
import textwrap

from tocsin.llm import license_scan
from tocsin.llm.license_scan import NOTICES, THRESHOLD, notice_sets, scan, summary

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = [(label, i) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()]
              for i in range(len(words)) if words[i:i + len(p)] == p]
    best, labels = 0.0, set()
    for line in low.split("\n"):
        held = set(WORD.findall(line))
        for label, notice in notice_sets():
            share = len(held & set(notice)) / len(notice)
            if share >= THRESHOLD - 1e-9:
                best, labels = max(best, share), labels | {label}
    base = {p[0] for p in places}
    starts = [p[1] for p in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if places else best)


TEXTS = ([n for _, n in NOTICES] + ["\n".join(["some words", n.upper(), "more"]) for _, n in NOTICES]
         + [" ".join(n.split()[1:]) for _, n in NOTICES] + [" ".join(n.split()[:-3]) for _, n in NOTICES]
         + [" ".join(reversed(n.split())) + " and other words about it" for _, n in NOTICES]
         + [None, "", "\n", "MIT License mit-license MIT\nLICENSE", "the general public license, General Public License",
            "éMIT license", "mitlicense", "apache  license\x00mit license", "permission is hereby granted of charge",
            "license " * 20_000 + "mit license", "Licensed under CC BY-NC 4.0.", "a\x1cb"])


def test_like_brute_force(docs):
    got = {r.doc_id: tuple(r)[1:] for r in summary(scan(docs(TEXTS))).collect()}
    assert got == {k: brute(t) for k, t in enumerate(TEXTS)}


def runs(text):
    """Labels and highest containment over lines and runs of words."""
    base = brute(text)
    words = [w for w in WORD.findall((text or "").lower())]
    best, labels = base[-1], set(base[-2].split(",")) - {""}
    for (label, notice), (_, whole) in zip(notice_sets(), NOTICES):
        span = 2 * len(license_scan.notice_words(whole))
        for at in range(max(1, len(words) - span + 1)):
            share = len(set(words[at:at + span]) & set(notice)) / len(notice)
            if share >= THRESHOLD - 1e-9:
                best, labels = max(best, share), labels | {label}
    return ",".join(sorted(labels)), best


def test_wrapped_notices(docs):
    """Notices over several lines, at all widths, with comment marks and far into a text."""
    texts = [("word " * (k % 150)) + "\n" + mark + textwrap.fill(n, width, break_long_words=False).replace("\n", "\n" + mark) + "\nmore words"
             for k, (width, mark, (_, n)) in enumerate(itertools.product((12, 40, 72), ("", " * ", "rem "), NOTICES))]
    texts += ["\n".join(["licensed", *["so"] * gap, "under", "cc by sa 4.0"]) for gap in range(14)]
    got = {r.doc_id: (r.labels, r.score) for r in summary(scan(docs(texts))).collect()}
    assert got == {k: runs(t) for k, t in enumerate(texts)}
    assert all(label in got[k][0].split(",") for k, (_, mark, (label, _)) in enumerate(
        itertools.product((12, 40, 72), ("", " * ", "rem "), NOTICES)))
    assert got[len(texts) - 1] == ("", 0.0)


def test_repeated_rows_and_null_ids(docs):
    got = summary(scan(docs(["MIT license"] * 3, ids=[1, 1, None]))).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == ["1", "1", "None"] and {r.n_base for r in got} == {1}


def test_empty(table):
    assert scan(table([], "doc_id long, text string")).collect() == []


def test_runs_no_python(docs):
    plan = summary(scan(docs(["x", "MIT license"])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
