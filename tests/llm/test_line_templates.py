import re
from collections import Counter, defaultdict

from stratamill.llm import common
from stratamill.llm.line_templates import line_templates


def brute(rows, depth, share, least):
    parsed, leaves = [], defaultdict(set)
    for i, text in rows:
        found = []
        for line in [] if text is None else text.split("\n"):
            w = [("<*>" if re.search("[0-9]", t) else t) for t in re.findall(r"[^\x20\x09-\x0D]+", line)]
            found.append((line, w, (len(w), *w[:depth])))
            if w:
                leaves[found[-1][2]].add(i)
        parsed.append((i, text, found))
    once = {(i, text): found for i, text, found in parsed}
    cells = Counter((leaf, p, t) for found in once.values() for _, w, leaf in found if len(leaves[leaf]) >= least for p, t in enumerate(w) if t != "<*>")
    have = defaultdict(set)

    def template(w, leaf):
        if not w or len(leaves[leaf]) < least:
            return None
        t = tuple(x if cells[leaf, p, x] >= least else "<*>" for p, x in enumerate(w))
        fixed, words = sum(x != "<*>" for x in t[depth:]), sum(x != "<*>" for x in w[depth:])
        firm = fixed > 0 and 100 * fixed >= share * words if len(w) > depth else any(x != "<*>" for x in w)
        return (leaf, t) if firm else None

    for i, _, found in parsed:
        for _, w, leaf in found:
            if key := template(w, leaf):
                have[key].add(i)
    out = Counter()
    for i, text, found in parsed:
        gone = [len(have.get(template(w, leaf), ())) >= least for _, w, leaf in found]
        kept = None if text is None else "\n".join(line for (line, _, _), x in zip(found, gone) if not x)
        out[i, sum(bool(w) for _, w, _ in found), sum(gone), kept] += 1
    return out


def check(docs, rows, **kw):
    got = Counter(tuple(r) for r in line_templates(docs([(*r, "en", "s") for r in rows]), **kw).collect())
    assert got == brute(rows, kw.get("depth", 2), kw.get("share", 50), kw.get("min_docs", 5))
    return {x[0]: x[1:] for x in got}


def test_fields_and_recurring_lines(docs, odd):
    rows = [(i, f"Own line {chr(97 + i)} of {chr(98 + i)}\nServer 10.0.0.{i} answered in {i} ms\n\nsame footer {'x' if i % 2 else 'y'} here") for i in range(12)]
    rows += [(50, None), (51, ""), (None, "only this"), (52, "Server 10.0.0.9 answered in 3 ms"), (0, rows[0][1])]
    got = check(docs, rows, min_docs=10)
    assert got[3] == (3, 2, "Own line d of e\n") and got[52] == (1, 1, "") and got[50] == (0, 0, None) and got[51] == (0, 0, "") and got[None] == (1, 0, "only this")
    assert line_templates(odd).count() == odd.count() and line_templates(docs([])).count() == 0


def test_a_leaf_has_several_templates_and_unlike_short_lines_stay(docs, monkeypatch):
    rows = [(i, "Please read the terms\nOwn text") for i in range(12)] + [(20 + i, "Please read our policy") for i in range(11)]
    rows += [(40 + i, f"I am {w}\n{i} {i} {i}\nTotal: {i} {i}\nPage {i} of 9") for i, w in enumerate("happy late sorry here there back out fine well sure".split())]
    got = check(docs, rows)
    assert all(got[i][1] == 2 for i in range(12)) and all(got[20 + i] == (1, 1, "") for i in range(11))
    assert got[41] == (4, 1, "I am late\n1 1 1\nTotal: 1 1")
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert check(docs, rows) == got


def test_a_text_of_many_lines(docs):
    long = "\n".join(x for i in range(20_000) for x in (f"Copyright notice number {i}", f"x{chr(97 + i % 26)}{i}y line"))
    rows = [(i, long) for i in range(2)] + [(5 + i, f"Copyright notice number {i}\nText {chr(97 + i)}") for i in range(4)]
    assert check(docs, rows)[0][1] == 20_000
