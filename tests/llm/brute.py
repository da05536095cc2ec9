"""Plain Python versions of the operators, for small tables."""
import re
from collections import defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, n=5):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_duplicates(rows):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id)], row by row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for token in s:
            for other in holders[token]:
                shared[other] += 1
            holders[token].append(k)
        for other, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[other]) - n):
                parent[find(k)] = find(other)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = [None] * len(rows)
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            out[k] = (rows[k][0], len(sets[k]), min(ids) if ids else None)
    return out


def line_dedup(rows, min_docs, similarity):
    """[(doc_id, text)] -> [(doc_id, n_lines, n_dropped, text)]."""
    from tocsin.llm.line_dedup import parse_leaf, parsed
    leaves = defaultdict(dict)
    for text in {t or "" for _, t in rows}:
        for p in {parsed(x) for x in text.split("\n")} - {None}:
            leaves[p[0]].setdefault(p[1], (p[2], set()))[1].add(text)
    gone = set()
    for keys in leaves.values():
        order = sorted(keys, key=lambda k: (-len(keys[k][1]), k))
        found = parse_leaf([(k, keys[k][0].split(" ")) for k in order], similarity)
        texts, members = defaultdict(set), defaultdict(list)
        for k, template in found:
            texts[tuple(template)] |= keys[k][1]
            members[tuple(template)].append(k)
        gone.update(k for t, s in texts.items() if len(s) >= min_docs for k in members[t])
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not parsed(x) or parsed(x)[1] not in gone]
        out.append((doc_id, sum(parsed(x) is not None for x in lines), len(lines) - len(kept), "\n".join(kept)))
    return out
