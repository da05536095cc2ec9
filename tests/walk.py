"""Plain-Python literal walk of the episode rules (test oracle).

Rows are visited in order; lag/lead/fill behave like the data-frame verbs
the rules were written with.
"""
from __future__ import annotations


def walk(rows, scope="series", end="clear"):
    """rows: list of dicts with id, t (int seconds), state (0/1), event (str|None),
    sorted by (id, t).  Returns episodes as (id, start, end, duration)."""
    out = []
    groups = []
    if scope == "series":
        cur = []
        for r in rows:
            if cur and cur[-1]["id"] != r["id"]:
                groups.append(cur)
                cur = []
            cur.append(r)
        if cur:
            groups.append(cur)
    else:
        groups = [rows]
    for g in groups:
        n = len(g)
        starts = []
        for i, r in enumerate(g):
            prev = g[i - 1]["state"] if i > 0 else (0 if scope == "series" else None)
            starts.append(r["t"] if (r["state"] == 1 and prev == 0) else None)
        filled, last = [], None
        for s in starts:
            if s is not None:
                last = s
            filled.append(last)
        seen = set()
        for i, r in enumerate(g):
            nxt = g[i + 1]["state"] if i + 1 < n else (0 if scope == "series" else None)
            clear = r["state"] == 1 and nxt == 0
            ans = r["state"] == 1 and r.get("event") is not None
            is_end = clear or (end == "answered" and ans)
            if not is_end:
                continue
            key = (filled[i], r["id"])
            if key in seen:
                continue
            seen.add(key)
            dur = None if filled[i] is None else r["t"] - filled[i]
            out.append((r["id"], filled[i], r["t"], dur))
    return sorted(out, key=lambda e: (e[0], e[2]))
