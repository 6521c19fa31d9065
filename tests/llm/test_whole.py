"""Work that earlier forms of the operators left out."""

import re

from panelwright.llm import licenses

from .docs import odd_rows, prose, table

def brute_runs(text, notices):
    words, out, score = licenses.words_of(text), set(), 0.0
    for label, notice, share in notices:
        ws = licenses.words_of(notice)
        best = max((len(set(words[i : i + len(ws)]) & set(ws)) for i in range(len(words))), default=0) / len(set(ws))
        if best >= share - 1e-9:
            out.add(label)
            score = max(score, best)
    return out, score


def test_declarations_and_paragraphs(spark):
    notices = licenses.notices()
    rows = [(i, f"{' '.join(prose(i, 20))} {t} {' '.join(prose(i + 1, 20))}") for i, (_, t, _) in enumerate(notices)]
    rows += [(200, "Released under the MIT License."), (201, "Released under the license"), (202, "Licensed under CC BY-NC 4.0."), (203, None), (204, "")]
    plain = {r.doc_id: r for r in licenses.scan(table(spark, rows), phrases={}).collect()}
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows), phrases={}, notices=notices).collect()}
    assert plain[200].labels == "" and (got[200].labels, got[200].score) == ("mit", 1.0)
    assert got[201].labels == got[202].labels == ""
    assert all(label in got[i].labels.split(",") for i, (label, _, _) in enumerate(notices))
    for d, t in rows:
        labels, score = brute_runs(t or "", notices)
        assert set(filter(None, got[d].labels.split(","))) == labels | set(filter(None, plain[d].labels.split(",")))
        assert got[d].score == max(score, plain[d].score)


def test_wrapped_notices(spark):
    rows = [
        (1, "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted"),
        (2, " * This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0."), (3, "Released under\nthe MIT License"),
        (4, "Redistribution and use in source"),
    ]
    plain = {r.doc_id: r.labels for r in licenses.scan(table(spark, rows)).collect()}
    got = {r.doc_id: r.labels for r in licenses.scan(table(spark, rows), notices=licenses.notices()).collect()}
    assert set(plain.values()) == {""} and got == {1: "bsd", 2: "mpl-2.0", 3: "mit", 4: ""}
