"""Disclosing terms against their definitions over lists, and what must stay unmarked."""

import re
import time

from panelwright.llm import disclosure, pii

from .docs import odd_rows, prose, table
from .test_scans import brute_base

WORD = re.compile(r"\w+")


def blanked(text):
    for spans in brute_base(text).values():
        for a, b in spans:
            text = text[:a] + " " * (b - a) + text[b:]
    return text


def entities(text):
    return {(k, re.sub("[^0-9]", "", text[a:b]) if k in ("card", "phone") else text[a:b].lower()) for k, s in brute_base(text).items() for a, b in s}


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    n = len(texts)
    words = {t: [w.lower() for w in WORD.findall(blanked(t))] for t in texts}
    raw = {t: {w.lower() for w in WORD.findall(t)} for t in texts}
    held = {t: entities(t) for t in texts}
    action = {}
    for e in set().union(*held.values()):
        mine = [t for t in texts if e in held[t]]
        around = {}
        for t in mine:
            ws = [None, *words[t], None]
            for i in range(1, len(ws) - 1):
                around.setdefault(ws[i], set()).add((ws[i - 1], ws[i + 1]))
        for w, places in around.items():
            d_te, d_t, d_e = sum(w in words[t] for t in mine), sum(w in raw[t] for t in texts), len(mine)
            named = e[0] == "email" and w in re.findall(r"[^\W\d_]{3,}", e[1])
            beyond, ratio, spread = (d_te * n - d_t * d_e) / (d_t * n), d_t / d_te, n / d_e
            if (len(places) > 1 or named) and beyond >= 0.25 and ratio**2 <= spread:
                action[e, w] = "remove" if beyond >= 0.5 and ratio**4 <= spread else "generalise"
    out = []
    for d, t in rows:
        t = t or ""
        marked = {}
        for e in {e for e, _ in action}:
            mine = {w: a for (f, w), a in action.items() if f == e}
            if e in held[t] or sum(w in raw[t] for w in mine) > 1:
                for w, a in mine.items():
                    marked[w] = max(a, marked.get(w, ""))
        out.append((repr(d), [(m.start(), m.end(), marked[m.group().lower()]) for m in WORD.finditer(blanked(t)) if m.group().lower() in marked]))
    return sorted(out)


def places(found):
    return sorted((repr(r.doc_id), [tuple(x) for x in r.term]) for r in found.collect())


def corpus():
    rows = [(i, " ".join(prose(i, 60, 3000))) for i in range(300, 360)]
    rows += [(20 + i, f"{' '.join(prose(i, 60))} Zorblax writes from zor@blax.org near {' '.join(prose(i + 70, 60))}") for i in range(6)]
    rows += [(50 + i, f"call +1 555 010 99{i:02d} or see zorblax {' '.join(prose(i + 200, 30))}") for i in range(3)] + [(90, None), (91, "")]
    rows += [(100, f"{' '.join(prose(1, 60))} quimby asks once@only.net about {' '.join(prose(2, 300))} said Quimby and Quimby left"), (101, f"Quimby again {' '.join(prose(3, 40))}")]
    rows += [(102, f"{' '.join(prose(5, 50))} mail pumbleton.j@only.net or ask Pumbleton {' '.join(prose(6, 50))}")]
    return rows + [(110 + i, f"{' '.join(prose(8, 40))} 10.1.2.3 {' '.join(prose(9, 40))}") for i in range(4)] + odd_rows()


def test_terms_equal_their_definition(spark):
    rows = corpus()
    got = places(disclosure.find(table(spark, rows)))
    assert got == brute(rows)
    texts = {str(d): t for d, t in rows if t}
    named = {(d, texts[d][a:b].lower()) for d, s in got for a, b, _ in s}
    assert ("100", "quimby") in named  # an entity of one document
    assert ("102", "pumbleton") in named  # a piece of an address, seen once
    assert {(str(d), "zorblax") for d in range(20, 26)} <= named
    marked = dict(got)
    assert sum(len(marked[str(d)]) for d in range(300, 360)) <= 0.01 * 60 * 60  # texts without entities


def test_further_text_with_two_disclosing_terms(spark):
    rows = [(i, " ".join(prose(i, 40, 3000))) for i in range(40)]
    rows += [(50, "Quimby of Ovrell wrote. Later Quimby, in Ovrell, signed once@only.net"), (51, "the man Quimby seen at Ovrell"), (52, "only Quimby here")]
    got = dict(places(disclosure.find(table(spark, rows))))
    assert sorted(got.items()) == brute(rows)
    assert len(got["51"]) == 2 and got["52"] == []


def test_copies_and_near_copies_are_no_evidence(spark):
    body = f"{' '.join(prose(20, 30))} a@b.cd {' '.join(prose(21, 30))}"
    rows = [(i, " ".join(prose(i, 80, 3000))) for i in range(5)] + [(20, body)]
    once = dict(places(disclosure.find(table(spark, rows))))
    more = dict(places(disclosure.find(table(spark, rows + [(30 + i, body) for i in range(5)]))))
    assert {d: more[d] for d in once} == once
    near = rows + [(40 + i, body + f" tail{i}") for i in range(3)]
    assert places(disclosure.find(table(spark, near))) == brute(near)


def test_many_spans_in_one_text_end(spark):
    log = " ".join(f"user{i}@host{i % 7}.net {i % 200}.{i % 9}.1.2" for i in range(20_000))
    rows = [(1, log), (2, log + " again"), (3, "plain words")]
    t = time.time()
    got = disclosure.find(table(spark, rows)).collect()
    assert {r.doc_id: (len(r.email), len(r.ip)) for r in got} == {1: (20_000, 20_000), 2: (20_000, 20_000), 3: (0, 0)}
    assert time.time() - t < 240


def test_running_sums(spark):
    rows = [([],), ([5],), (list(range(300)),), ([3] * 257,), (None,)]
    got = spark.createDataFrame(rows, "n array<int>").select("n", pii.running("n").alias("s")).collect()
    for r in got:
        assert r.s == (None if r.n is None else [sum(r.n[:i]) for i in range(len(r.n))])


def test_empty_table(spark):
    assert disclosure.find(table(spark, [])).count() == 0
