import random

from brute import line_dedup as brute
from tocsin.llm import line_dedup
from tocsin.llm.line_dedup import drop_recurring_lines, parse_leaf, parsed


def test_masking():
    assert parsed(" \t ") is None
    assert parsed("id 17 at 2024-01-02")[2] == "id <*> at <*>"
    assert parsed("id 17")[:2] == parsed("id  x9 ")[:2] != parsed("id z")[:2]


def test_variable_fields_become_wildcards():
    lines = [(1, "user ann logged in from home".split()), (2, "user bob logged in from home".split()),
             (3, "user bob went out to town".split())]
    found = dict(parse_leaf(lines, 0.7))
    assert found[1] == found[2] == "user <*> logged in from home".split()
    assert found[3] == lines[2][1]


def texts(seed):
    rng = random.Random(seed)
    names = ["ann", "bob", "eve", "joe", "sue"]
    out = []
    for k in range(120):
        lines = [f"own line {rng.random()} of {k} " + "".join(rng.choice("abcdef") for _ in range(9)) for _ in range(3)]
        lines = [x.replace("0.", "q").translate(str.maketrans("0123456789", "ghijklmnop")) for x in lines]
        if k % 2:
            lines.insert(rng.randint(0, 3), "All rights reserved")
        if k % 3 == 0:
            lines.append(f"Page {k} of 99")
        if k % 4 == 0:
            lines += ["", f"the reader {rng.choice(names)} liked this page very much indeed"]
        if k % 60 == 0:
            lines.append("seldom seen")
        out.append("\n".join(lines))
    return out + out[:10] + [None, "", "\n\n", "All rights reserved", "x" * 50_000 + "\nAll rights reserved"]


def test_like_brute_force(docs):
    own = texts(1)
    ids = [*range(len(own) - 1), None]
    rows = list(zip(ids, own))
    for min_docs, block in ((10, 2048), (3, 2048)):
        got = drop_recurring_lines(docs(own, ids=ids, files=3), min_docs=min_docs, block=block).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, min_docs, 0.7)))


def test_copies_of_a_text_count_once(docs):
    got = drop_recurring_lines(docs(["same\nlines here"] * 30 + ["same\nother"]), min_docs=3).collect()
    assert all(r.n_dropped == 0 for r in got) and len(got) == 31


def test_hot_leaf_is_dealt_into_blocks(docs):
    """Lines of one leaf over many blocks still meet in one template."""
    own = [f"a user named {chr(97 + k % 26)}{chr(97 + k // 26)} has logged in here" for k in range(400)]
    got = drop_recurring_lines(docs(own), min_docs=100, similarity=0.7, block=40).collect()
    assert all(r.n_dropped == r.n_lines == 1 and r.text == "" for r in got)


def hot_leaf(others):
    """A template of 12 lines among others of its leaf, some with variable fields."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = [f"user is now {' '.join(word() if k % 9 else 'n7' for _ in range(2))} {word()} {word()} {word()}"
           for k in range(others)]
    own += [f"user is now {word()} logged in from home" for _ in range(12)]
    own += [f"user is now seen {word()[:1]} {word()[:1]} at {rng.choice('xyz')}" for _ in range(200)]
    rng.shuffle(own)
    return own


def test_hot_leaf_is_parsed_like_brute_force(docs):
    own = hot_leaf(4000)
    got = drop_recurring_lines(docs(own), min_docs=10, block=40).collect()
    assert sorted(map(tuple, got)) == sorted(brute(list(enumerate(own)), 10, 0.7))
    assert all(r.n_dropped == 1 for r in got if own[r.doc_id].endswith("logged in from home"))


def test_indexed_parse_is_the_plain_one(monkeypatch):
    rng = random.Random(8)
    for similarity in (0.3, 0.7, 1.0):
        lines = [(k, [rng.choice(["a", "b", "<*>"]) for _ in range(8)]) for k in range(300)]
        monkeypatch.setattr(line_dedup, "SCANNED", 32)
        indexed = parse_leaf(lines, similarity)
        monkeypatch.setattr(line_dedup, "SCANNED", 1000)
        assert indexed == parse_leaf(lines, similarity)


def test_long_passages_go_at_two_texts(docs):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, edited, copied, other, short = prose(60), prose(55), prose(70), prose(60), prose(49)
    own = [f"{prose(9)}\n{passage}\n{prose(9)}" for _ in range(2)]                       # short texts of their own
    own += [f"{prose(200)}\n{edited} {prose(2)}\n{prose(40)}" for _ in range(3)]          # one template, three lines
    body = f"{prose(30)}\n{prose(20)}"
    own += [f"{body}\n{copied}\n{prose(4)}", f"{body}\n{copied}\n{prose(5)}", f"{body}\n{copied}"]  # near copies
    own += [other, other + " more", other]                                                # the whole text is the passage
    own += [f"{prose(20)}\n{short}" for _ in range(4)]
    got = drop_recurring_lines(docs(own)).collect()
    assert {r.doc_id for r in got if r.n_dropped} == {0, 1, 2, 3, 4}
    assert all(r.n_dropped == 1 and passage not in r.text and edited not in r.text for r in got if r.doc_id < 5)
    # A text apart from the near copies condemns the line in all of them.
    got = drop_recurring_lines(docs(own[5:8] + [f"{prose(100)}\n{copied}"])).collect()
    assert [r.n_dropped for r in got] == [1] * 4 and not any(copied in r.text for r in got)


def test_empty(table):
    assert drop_recurring_lines(table([], "doc_id long, text string")).collect() == []


def near_group(n, rng, lines=6):
    """``n`` texts that differ in one word each, with no line of other texts."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    body = [[word() for _ in range(12)] for _ in range(lines)]
    out = []
    for k in range(n):
        own = [list(x) for x in body]
        own[k % lines][5] = f"edit{word()}"
        out.append("\n".join(" ".join(x) for x in own))
    return out


def test_near_copies_count_once_at_any_number(docs):
    rng = random.Random(11)
    for n in (9, 10, 30, 200):
        got = drop_recurring_lines(docs(near_group(n, rng))).collect()
        assert [r.n_dropped for r in got] == [0] * n, n


def test_lines_of_near_copies_and_of_others(docs):
    """What ten texts of their own share goes from the near copies too; nothing else does."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    notice = "subscribe to our letter for more of this"
    copies = [t + "\n" + notice for t in near_group(40, rng)]
    others = ["\n".join(" ".join(word() for _ in range(9)) for _ in range(5)) + "\n" + notice for _ in range(9)]
    got = drop_recurring_lines(docs(copies + others[:8])).collect()  # 1 + 8 texts
    assert not any(r.n_dropped for r in got)
    got = drop_recurring_lines(docs(copies + others)).collect()  # 1 + 9
    assert all(r.n_dropped == 1 and notice not in r.text for r in got)


def test_sketches_estimate_the_jaccard_similarity():
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    for n, edits in ((30, 2), (2000, 0), (2000, 40), (2000, 400)):
        a = words(n)
        b = list(a)
        for k in rng.sample(range(n), edits):
            b[k] = "other"
        sets = [{tuple(x[i:i + 5]) for i in range(n - 4)} for x in (a, b)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        found = line_dedup.likeness(*[line_dedup.smallest(line_dedup.shingles([x], line_dedup.Words())[0]) for x in (a, b)])
        assert abs(found - true) < (1e-9 if n == 30 else 0.2)


def test_shingles_stay_in_their_line():
    lines = [list("abcdefg"), list("xy"), list("abcde"), list("abcd")]
    found, line = line_dedup.shingles(lines, line_dedup.Words())
    assert sorted(line.tolist()) == [0, 0, 0, 1, 2, 3]
    assert found[line == 0][0] == found[line == 2][0] and len(set(found.tolist())) == 5
    assert [len(x) for x in line_dedup.shingles([], line_dedup.Words())] == [0, 0]
