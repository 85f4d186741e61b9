"""The filter audit, the license scan and periodic runs against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest

from curatrix.llm import audit, license_rules, licenses, periodic

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- the filter audit


def plain_audit(corpus, labels):
    """Every order applied to every document, one step after another."""
    last = 1 << 63
    least: dict[str, int] = {}
    for d, t, *_ in corpus:
        least[t or ""] = min(least.get(t or "", last), last if d is None else d)
    docs = []
    for d, t, _, source, *_ in corpus:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": least[t] < (last if d is None else d),
        }
        said = [x for x in labels if d is not None and x[0] == d]
        docs.append((source or "", {f for f, yes in fails.items() if yes}, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {x[0] for x in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        mine = [x[1:] for x in docs if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                before = sum(f in x[0] for x in mine) - len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), before, sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                left = stay
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return sorted(((*k, *v) for k, v in out.items()), key=str)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_matches_a_plain_version(spark, docs, corpus, empty):
    some = [(r[0], i % 2, int(i % 7 == 0)) for i, r in enumerate(corpus) if i % 3 == 0] + [(None, 1, 1), (6, None, 1), (6, 1, None), (9, 0, 0)]
    labels = spark.createDataFrame(some, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, labels)
    assert rows(got, *COLUMNS) == plain_audit(corpus, some)
    assert {r["shapley"] for r in got.collect()} > {0}
    assert audit.audit(empty, labels).count() == 0
    assert rows(audit.audit(docs, labels.limit(0)), *COLUMNS) == plain_audit(corpus, [])


def test_audit_of_hot_rows_and_all_sets_of_filters(spark):
    parts = {"A": "", "B": "", "C": "AB ", "D": "# ", "": ""}
    table = []
    for n, fails in enumerate([c for k in range(6) for c in [*map(set, permutations("ABCDE", k))]][::3]):
        text = "".join(parts.get(x, "") for x in "CD" if x in fails) + " ".join(f"w{0 if 'B' in fails else i}" for i in range(20 if "A" in fails else 60)) + f" u{n}"
        table += [(n * 10, text, "x", "s")] + [(n * 10 + 1, text, "x", "s")] * ("E" in fails)
    table += [(None, None, None, None)] * 500 + [(7, "same text", None, "")] * 500 + [(7, "same text", None, "t")] * 3
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string").repartition(7)
    labels = spark.createDataFrame([(7, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    assert rows(audit.audit(docs, labels), *COLUMNS) == plain_audit(table, [(7, 1, 1), (0, 1, 0)])


def test_audit_query_equals_its_sql(spark):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(audit.SQL)
    names = [c[0] for c in found.description]
    assert rows(audit.query(spark, DATA), *COLUMNS) == sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall()), key=str)


# --- the license scan


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text):
    """Every rule tried at every word, without keywords; containment against all detections."""
    w = plain_words(text)
    joined, found = " " + " ".join(w) + " ", []
    for r, (_, _, _, pattern) in enumerate(license_rules.rules()):
        found += [(r, joined[: m.start()].count(" "), joined[: m.end()].count(" ")) for m in re.finditer(f" (?:{pattern.decode()})(?= )", joined)]
    gone = [any(x < r and a <= s and b >= e for x, a, b in found) or any(x == r and (a, b) != (s, e) and a <= s and b >= e for x, a, b in found) for r, s, e in found]
    base = {}
    for label, phrase in license_rules.BASE:
        p = phrase.split()
        base[label] = [i for i in range(len(w)) if w[i : i + len(p)] == p]
    return w, found, gone, base


NOTICES = [
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "GPLv3 or LGPL v2.1", "GNU Lesser General Public\nLicense version 2.1 or (at your option) any later version", "cc-by, cc by; CC  BY-SA 3.0", "all rights reserved", "https://creativecommons.org/licenses/by-sa/4.0/",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "Tous droits réservés", "2-clause BSD License", "mit license mit license apache license",
]


def test_scan_matches_a_plain_version(spark, docs, corpus, empty):
    rng = random.Random(8)
    table = [(i, f"{' '.join(rng.choices(['some', 'Wörter', 'license', 'gnu', 'cc', 'by', 'mit'], k=rng.randint(0, 9)))} {a}{rng.choice([' ', ', ', chr(10)])}{b}", "clash") for i, (a, b) in enumerate((a, b) for a in NOTICES for b in NOTICES)]
    table += [(None, None, None), (None, "", "x"), (5, NOTICES[0], None), (5, NOTICES[0], None)]
    for df, have in ((spark.createDataFrame(table, "doc_id long, text string, matches string").repartition(3), table), (docs, corpus)):
        got = licenses.scan(df, keep=["doc_id", "text"]).collect()
        assert len(got) == len(have)
        for r in got:
            w, found, gone, base = plain_scan(r.text)
            assert (r.n_words, [(m.rule, m.start, m.end) for m in r.matches], [not m.stays for m in r.matches]) == (len(w), found, gone)
            assert sorted((m.label, m.start) for m in r.matches if m.base) == sorted((k, s) for k, at in base.items() for s in at)
            assert all(m.words == " ".join(w[m.start : m.end]) for m in r.matches)
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (NOTICES[0], "mit"), (NOTICES[1], "cc-by,cc-by-nc-4.0"), (NOTICES[2], "apache,apache-2.0"), (NOTICES[3], "gpl,gpl-3.0"), (NOTICES[4], "gpl-2.0-or-later"), (NOTICES[5], "gpl-3.0,lgpl-2.1"), (NOTICES[6], "lgpl-2.1-or-later"),
        (NOTICES[9], "cc-by-sa"), (NOTICES[10], "mit"), ("GNU GPL v3; gnu lgpl version 2.1; BSD 3-Clause", "bsd-3-clause,gpl-3.0,lgpl-2.1"), ("a mit b license, gnu general license, ccby", ""), (None, ""), ("Permitted by the Mozilla Public License, v. 2.0", "mpl-2.0"), ("Eclipse Public License - v 2.0", "epl-2.0"),
    ],
)
def test_the_more_specific_rule_stays(text, labels):
    found = licenses.detections([w.encode() for w in plain_words(text)])
    names = [license_rules.rules()[r][0] for (r, _, _), gone in zip(found, licenses.suppressed(found), strict=True) if not gone]
    base = [k for k, p in license_rules.BASE if f" {p} " in f" {' '.join(plain_words(text))} "]
    assert ",".join(sorted({*names, *base})) == labels


def test_license_query(spark, tmp_path):
    texts = [*NOTICES, None, "", "no such thing", " ".join(NOTICES) + " x" * 300_000 + " cc by"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in licenses.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for d, text in enumerate(texts):
        w, found, gone, base = plain_scan(text) if len(text or "") < 10_000 else (plain_words(text), *plain_scan(text)[1:])
        at = [s for x in base.values() for s in x]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        kept = {license_rules.rules()[x][0] for (x, _, _), g in zip(found, gone, strict=True) if not g}
        assert r.base_labels == ",".join(sorted(k for k, x in base.items() if x)) and r.labels == ",".join(sorted(kept | {k for k, x in base.items() if x}))
        left = 1.0
        for k in kept:
            left *= 1 - max(license_rules.rules()[x][1] for (x, _, _), g in zip(found, gone, strict=True) if not g and license_rules.rules()[x][0] == k)
        assert r.score == pytest.approx(1 - left) and 0 <= r.score <= 1 and (r.score > 0) == bool(found)


def test_rules_need_words_of_theirs():
    rules = license_rules.rules()
    assert len(rules) > 300
    for label, weight, required, pattern in rules:
        plain = pattern.replace(b"licen[sc]e", b"license licence").replace(b"?", b"")
        assert 0 < weight < 1 and label and required and not re.search(rb"[A-Z]", pattern)
        assert all(any(w.removeprefix(b"v") in plain for w in some) for some in required), (label, required)


# --- periodic runs


def plain_runs(w, least_length=6, least_power=4):
    """Every period, one after another; a run whose period isn't its smallest is one of a divisor."""
    n, out = len(w), []
    for p in range(1, n // least_power + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least_length, least_power * p) and not any(w[s : i + p - q] == w[s + q : i + p] for q in range(1, p)):
                out.append((s, i + p - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_periodic(d, text):
    w = re.findall(WORD, text or "")
    n, h = len(w), zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (d, len(found), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


PERIODIC = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_texts():
    rng = random.Random(3)
    table = []
    for d in range(400):
        w = [rng.choice(["a", "B", "é", "c,", "dd"]) for _ in range(rng.choice([0, 1, 5, 30, 90]))]
        if rng.random() < 0.6:
            unit = [rng.choice(["a", "B", "é"]) for _ in range(rng.randint(1, 7))]
            at = rng.randint(0, len(w))
            w[at:at] = (unit * 12)[: rng.randint(4, 60)]
        table.append((d, rng.choice([" ", "\n", " \t"]).join(w) + rng.choice(["", " ", "\x0b"]), "clash"))
    return table + [(None, None, None), (None, "x " * 50, "y"), (3, "", ""), (3, "q q q q q q q", None), (3, "q q q q q q q", None), (10**12, " \n\t", ""), (7, "a\x1cb\x85 " * 9, "")]


def test_periodic_query_matches_a_plain_version(spark, tmp_path):
    table = periodic_texts()
    edited = sum(zlib.crc32(str(d).encode()) % 10 == 0 and bool(t.split()) for d, t, _ in table if d is not None)
    assert edited > 20
    spark.createDataFrame(table, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.query(spark, str(tmp_path))
    want = sorted((plain_periodic(d, t) for d, t, _ in table), key=str)
    assert rows(got, *PERIODIC) == want
    assert sum(r[1] > 0 for r in want) > 100 and {r[4] for r in want} > {1, 2, 3, 4, 5}


def test_periodic_query_on_the_table(spark):
    have = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert rows(periodic.query(spark, DATA), *PERIODIC) == sorted((plain_periodic(d, t) for d, t in have), key=str)


def test_collapse_of_odd_rows(spark, docs, corpus, empty):
    got = periodic.collapse(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == len(corpus)
    for r in got:
        w = re.findall(WORD, r.text or "")
        assert [tuple(x) for x in r.runs] == plain_runs(w)
        gone = {i for s, length, q in plain_runs(w) for i in range(s + q, s + length)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic.collapse(empty).count() == 0


@pytest.mark.parametrize(("length", "power"), [(6, 4), (2, 2), (1, 2), (8, 3)])
def test_runs_of_many_short_texts(length, power):
    rng = random.Random(length)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(0, 5)):
            k = rng.choice([1, 2, 3])
            w = [rng.randrange(k) for _ in range(rng.randint(0, 50))]
            unit, at = [rng.randrange(k) for _ in range(rng.randint(1, 6))], rng.randint(0, len(w))
            texts.append(w[:at] + (unit * 9)[: rng.randint(0, 40)] + w[at:])
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in texts], dtype=np.int64)))
        got = [[] for _ in texts]
        for s, n, p in zip(*periodic.maximal_runs(np.array([x for w in texts for x in w], np.int64), bounds, length, power), strict=True):
            t = int(np.searchsorted(bounds, s, side="right")) - 1
            got[t].append((int(s - bounds[t]), int(n), int(p)))
        assert got == [plain_runs(w, length, power) for w in texts]


def test_suffixes_and_their_common_lengths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 17, 300):
        w = rng.integers(0, 3, n)
        w[n // 3 :] = w[: n - n // 3] if n > 10 else w[n // 3 :]
        found = periodic.Suffixes(w, np.array([0, n]))
        suffix = [w[i:].tolist() for i in range(n)]
        assert found.order.tolist() == sorted(range(n), key=lambda i: suffix[i])
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y), n - max(a, b))
        assert found.lcp.tolist() == [0] + [shared(a, b) for a, b in zip(found.order[:-1], found.order[1:])]
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        a, b = a[a != b], b[a != b]
        if len(a):
            assert found.common(a, b).tolist() == [shared(*x) for x in zip(a.tolist(), b.tolist())]


def test_long_periodic_texts_take_little_time(spark):
    texts = [(1, "a " * 300_000), (2, "a b c " * 100_000), (3, " ".join(str(i % 50_000) for i in range(300_000))), (4, " ".join(map(str, range(300_000))))]
    got = {r.doc_id: r for r in periodic.collapse(spark.createDataFrame(texts, "doc_id long, text string"), keep=["doc_id"]).collect()}
    assert [[tuple(x) for x in got[d].runs] for d in (1, 2, 3, 4)] == [[(0, 300_000, 1)], [(0, 300_000, 3)], [(0, 300_000, 50_000)], []]
    assert [got[d].collapsed.count(" ") for d in (1, 2, 3, 4)] == [0, 2, 49_999, 299_999]
