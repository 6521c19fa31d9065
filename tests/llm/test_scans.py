import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import decontaminate, language, licenses, pii

from .docs import odd_rows, prose, table

# --- personal data ----------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in KINDS.items()}


def test_base_spans(spark):
    r = random.Random(9)
    parts = ["a@b.c", "a@b", "x_y@z.co.uk", ".", "@", "_", "10.0.0.1", "256.1.1.1", "1.2.3", "007.1.1.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49", " ", "é", "日", "12", "-", "5500005555555559", "+", "%a@b.c_d@e.f"]
    rows = odd_rows() + [(1000 + i, "".join(r.choices(parts, k=r.randint(1, 9)))) for i in range(400)] + [(2000, "a" * 60_000), (2001, "1" * 60_000), (2002, "1 " * 30_000), (2003, "+" + "1(" * 30_000)]
    got = pii.base_spans(table(spark, rows)).select("text", *pii.KINDS).collect()
    assert len(got) == len(rows)
    for g in got:
        assert {k: [(s.start, s.end) for s in g[k]] for k in pii.KINDS} == brute_base(g.text)
        assert all(g.text[s.start : s.end] == s.value for k in pii.KINDS for s in g[k])


def brute_terms(rows):
    """Disclosing spans by the definitions in the module's docstring."""
    word = re.compile(r"\w+")
    counts, slots = {}, []
    for d, t in rows:
        t = t or ""
        for m in word.finditer(t.lower()):
            counts[m.group()] = counts.get(m.group(), 0) + 1
        for kind, spans in brute_base(t).items():
            for a, b in spans:
                v = t[a:b]
                entity = kind, re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower()
                left, right = max(0, a - pii.REACH), t[b : b + pii.REACH]
                cut = len(re.match(r"\w*", t[left:a]).group()) if left else 0
                near = [(m.group().lower(), left + cut + m.start(), left + cut + m.end()) for m in word.finditer(t[left + cut : a])]
                if len(right) == pii.REACH:
                    right = re.sub(r"\w+$", "", right)
                near += [(m.group().lower(), b + m.start(), b + m.end()) for m in word.finditer(right)]
                slots += [(d, entity, *x) for x in near]
    n, n_e, n_te, docs = sum(counts.values()), {}, {}, {}
    for d, e, w, _, _ in slots:
        n_e[e] = n_e.get(e, 0) + 1
        n_te[e, w] = n_te.get((e, w), 0) + 1
        docs.setdefault((e, w), set()).add(d)
    out = {}
    for d, e, w, a, b in slots:
        ratio, spread = counts[w] / n_te[e, w], n / n_e[e]
        if len(docs[e, w]) >= pii.MIN_SEEN and ratio**2 <= spread:
            action = "remove" if ratio**4 <= spread else "generalise"
            out.setdefault(d, {})[a, b] = max(action, out.get(d, {}).get((a, b), ""))
    return {d: sorted((a, b, x) for (a, b), x in s.items()) for d, s in out.items()}


def test_disclosing_terms(spark):
    rows = [(i, f"{' '.join(prose(i, 60))} Zorblax writes from zor@blax.org near {' '.join(prose(i + 70, 60))}") for i in range(6)]
    rows += [(50 + i, f"call +1 555 010 99{i:02d} or see zorblax {' '.join(prose(i + 200, 30))}") for i in range(3)] + [(90, None), (91, "")]
    found = pii.find(table(spark, rows))
    got = {r.doc_id: [tuple(x) for x in r.term] for r in found.collect()}
    wanted = brute_terms(rows)
    assert wanted and got == {d: wanted.get(d, []) for d, _ in rows}
    clean = {r.doc_id: r.sanitised for r in pii.sanitised(found).collect()}
    assert all("zor@blax.org" not in clean[i] and "[EMAIL]" in clean[i] and "Zorblax" not in clean[i] for i in range(6))
    assert clean[90] == clean[91] == ""


def test_pii_of_empty_table(spark):
    assert pii.find(table(spark, [])).count() == 0


# --- licenses ---------------------------------------------------------------


def test_license_scan_equals_sql(spark):
    r = random.Random(4)
    lines = [*licenses.TEMPLATES.values(), "CC BY 4.0", "cc\nby", "General Public\tLicense", "All rights reserved. All Rights Reserved", "cc by by cc by", ""]
    rows = odd_rows()
    for i in range(150):
        text = []
        for _ in range(r.randint(0, 4)):
            w = r.choice(lines).split(" ")
            if r.random() < 0.5:  # leave out or move some words
                w = r.sample(w, max(1, len(w) - r.randint(0, 4)))
            text.append(" ".join(w + prose(r.random(), r.randint(0, 5))))
        rows.append((1000 + i, r.choice(["\n", "\r\n", " "]).join(text)))
    got = licenses.scan(table(spark, rows))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cursor = con.execute(licenses._sql())
    names = [d[0] for d in cursor.description]
    assert got.columns == names
    assert sorted(map(repr, (tuple(x) for x in got.collect()))) == sorted(map(repr, cursor.fetchall()))
    assert any(x.labels and not x.base_labels for x in got.collect())
    assert licenses.scan(table(spark, [])).count() == 0


def test_templates_need_words(spark):
    with pytest.raises(ValueError):
        licenses.scan(table(spark, [(1, "a")]), templates={"none": "..."})


# --- benchmark --------------------------------------------------------------


def brute_tiles(item, text, least):
    """Marked words of the item by the textbook procedure."""
    used_i, used_t = [False] * len(item), [False] * len(text)
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and not used_i[a + n] and not used_t[b + n]:
                    n += 1
                if n > best[0]:
                    best = n, a, b
        if best[0] < least:
            return sum(used_i)
        n, a, b = best
        used_i[a : a + n], used_t[b : b + n] = [True] * n, [True] * n


def test_tiles_equal_the_textbook():
    r = np.random.default_rng(3)
    for _ in range(150):
        item, text = r.integers(0, 3, r.integers(5, 25)).astype(np.uint64), r.integers(0, 3, r.integers(5, 40)).astype(np.uint64)
        at = [(a, b) for a in range(len(item) - 2) for b in range(len(text) - 2) if (item[a : a + 3] == text[b : b + 3]).all()]
        if not at:
            continue
        got = decontaminate.tiles(item, text, *np.array(at).T, 3)
        assert got[0][0] == max(n for n, _, _ in got)
        marked = np.concatenate([np.arange(a, a + n) for n, a, _ in got])
        assert len(set(marked.tolist())) == len(marked) == brute_tiles(item, text, 3)


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_leaks(spark, block_words):
    item = prose(77, 40, 5000)
    parts = [item[i : i + 8] for i in range(0, 40, 8)]
    moved = sum((p + prose(i, 20) for i, p in enumerate(reversed(parts))), [])
    rows = odd_rows() + [
        (100, " ".join(prose(1, 50) + item + prose(2, 50))), (101, ("! ".join(item)).upper()), (102, " ".join(moved)),
        (103, " ".join(prose(3, 30) + item[:15] + prose(4, 30))), (104, " ".join(item[i // 2] if i % 2 else "q" for i in range(80))), (105, " ".join(item * 3)),
    ]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "one two three"), (5, " ".join(prose(5, 30, 5000))), (6, " ".join(item))], "item_id long, text string")
    docs = table(spark, rows)
    got = decontaminate.find_leaks(docs, bench, block_words=block_words).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (100, 101, 102, 105) for i in (1, 6)}
    assert all(r.coverage == 1 for r in got) and {r.n_tiles for r in got if r.doc_id == 102} == {5}
    left = decontaminate.without_leaks(docs, bench, block_words=block_words)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((d for d, _ in rows if d not in (100, 101, 102, 105)), key=repr)
    empty = spark.createDataFrame([], bench.schema)
    assert decontaminate.find_leaks(docs, empty).count() == 0 and decontaminate.find_leaks(table(spark, []), bench).count() == 0
    assert decontaminate.without_leaks(docs, empty).count() == len(rows)


# --- language ---------------------------------------------------------------

SYLLABLES = {"aa": ["ta", "ti", "ko", "na"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ción", "ñe", "llo", "que"]}


def speech(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n))


def test_language_held_out_accuracy_and_odd_rows(spark):
    rows = [(i, speech(lang, i, 3 + i % 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 120)]
    docs = table(spark, [r[:3] for r in rows])
    model = language.fit(language.training_fold(docs), rows_per_label=60, epochs=4)
    assert model.labels == ["aa", "bb", "cc"] and 0 < model.threshold <= 0.4
    test = [(1000 + i, speech(lang, i + 999, 12), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    odd = [(d, t) for d, t in odd_rows() + [(30, "1234 !!"), (31, "²³")]]
    got = language.predict(table(spark, test + odd), model).collect()
    named = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 1000}
    assert np.mean([named[d].lang_pred == lang for d, _, lang in test]) > 0.97
    assert len(got) == len(test) + len(odd) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if not language.has_letter(r.text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in model.labels
    kept = language.accepted_rows(table(spark, test + odd), model)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if r.accepted)
    assert language.predict(table(spark, []), model).count() == 0


def test_language_never_sees_the_held_out_fold(spark):
    docs = table(spark, [(i, "a", None if i % 5 == 0 else "aa") for i in range(60)])
    import zlib

    got = {r.doc_id for r in language.training_fold(docs).collect()}
    assert got == {i for i in range(60) if i % 5 and zlib.crc32(str(i).encode()) % 3 != 1}


def test_language_without_labels(spark):
    docs = table(spark, [(1, "abc", None), (2, None, None), (3, "1", None)])
    model = language.fit(language.training_fold(docs))
    assert [(r.lang_pred, r.accepted) for r in language.predict(docs, model).orderBy("doc_id").collect()] == [("und", True), ("und", False), ("und", False)]


# --- the pipeline -----------------------------------------------------------


def test_pipeline(spark, tmp_path):
    item = prose(500, 30, 5000)
    rows = [(i, speech("aa" if i % 2 else "bb", i, 60), "aa" if i % 2 else "bb") for i in range(40)]
    base = speech("aa", "near", 200)
    rows += [(100, base, "aa"), (101, base.replace(" ", "  "), "aa"), (102, base + " ta", "aa"), (103, " ".join(item), "aa"), (104, None, "aa"), (105, "12 34", None)]
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, left = docs, []
    for name, fn in corpus_pipeline.STAGES[:-1]:
        out = fn(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        left.append({r.doc_id for r in out.collect()})
    everything = {r[0] for r in rows}
    assert left[0] == everything - {104, 105}
    assert left[1] == left[0] - {101}
    assert left[2] == left[1] - {102}
    assert left[3] == left[2] - {103}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == left[3]
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert hashlib.md5(repr(sorted(map(tuple, packed.collect()))).encode()).hexdigest()
