"""Operators on documents against plain versions that do just what each contract says."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from curatrix.llm import decontaminate, fingerprint, lines, mixing, simhash, substrings, suffixes, tokens, toxicity
from curatrix.sources.shared import Scratch


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def plain_chunks(text):
    """Line by line: the first boundary from the two last lines that aren't blank, or else the choice among 32 lines."""
    whole = [p for p in (text + b"\n").split(b"\n")[:-1]] if text and not text.endswith(b"\n") else text.split(b"\n")[:-1]
    h = [xxhash.xxh3_64_intdigest(p.rstrip()) for p in whole]

    def hashed(i):
        full = [k for k in range(i + 1) if whole[k].rstrip()][-2:]
        rolled = h[full[0]] if len(full) == 1 else (h[full[0]] * 0x9E3779B97F4A7C15 + h[full[1]]) % 2**64 if full else 0
        return bool(whole[i].rstrip()) and rolled // 2**40 % 4 == 0

    chosen = lambda i: xxhash.xxh3_64_intdigest(np.array(h[max(0, i - 7) : i + 1], "<u8").tobytes())
    out, first, at = [], 0, 0
    while first < len(whole):
        better = lambda i: i + 1 < len(whole) and i + 1 - first < 32 and hashed(i + 1) and chosen(i + 1) < chosen(i)
        last = next((i for i in range(first + 1, min(first + 32, len(whole))) if hashed(i) and not better(i)), None)
        if last is None and first + 32 <= len(whole):
            last = max(i for i in range(first + 1, first + 32) if chosen(i) == min(map(chosen, range(first + 1, first + 32))))
        last = len(whole) - 1 if last is None else last
        end = min(len(text), at + sum(len(p) + 1 for p in whole[first : last + 1]))
        out.append((at, end, last + 1 - first))
        first, at = last + 1, end
    return out


def plain_lines(corpus):
    key = lambda d: (1 << 63) - 1 if d is None else d
    parts = [plain_chunks((t or "").encode()) for _, t, *_ in corpus]
    first: dict[bytes, tuple] = {}
    for (d, t, *_), cs in zip(corpus, parts, strict=True):
        for c, (a, b, n) in enumerate(cs):
            if n >= 2:
                body = (t or "").encode()[a:b]
                first[body] = min(first.get(body, (1 << 64, 0)), (key(d), c))
    out = []
    for (d, t, *_), cs in zip(corpus, parts, strict=True):
        data, kept, gone, n_gone = (t or "").encode(), b"", 0, 0
        for c, (a, b, n) in enumerate(cs):
            if n >= 2 and first[data[a:b]] != (key(d), c):
                gone, n_gone = gone + n, n_gone + 1
            else:
                kept += data[a:b]
        out.append((d, sum(n for _, _, n in cs), gone, n_gone, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_matches_a_plain_version(docs, corpus):
    have = [r for r in corpus if r[0] is not None]
    got = rows(lines.deduplicate(docs.filter("doc_id IS NOT NULL")), "doc_id", "n_lines", "n_removed", "n_chunks", "kept_sha256")
    assert got == plain_lines(have)
    assert sum(r[3] for r in got) > 3


def test_line_dedup_of_odd_rows(spark, docs, corpus, empty):
    assert lines.deduplicate(empty).count() == 0
    same = "\n".join(f"line {i}" for i in range(30))
    table = [(None, same), (None, same), (None, None), (3, ""), (None, same + "\nmore"), (1, "\n\n\n"), (2, "\n\n\n")]
    got = lines.deduplicate(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert len(got) == len(table) and {(r.n_lines, r.n_removed) for r in got if r.text == ""} >= {(0, 0)}
    first = [r for r in got if r.doc_id is None and r.n_lines >= 30]
    # rows that agree in id and text are one: both keep what is first in them; of the longer, one keeps its repeats
    assert len(first) == 3 and len({r.n_removed for r in first if r.n_lines == 30}) == 1
    assert lines.deduplicate(docs).count() == len(corpus)


def test_chunks_of_odd_texts_equal_a_plain_version():
    for text in (b"same\n" * 1000, b"\n" * 500, b"", b"\n", b"a", b"a\n", b"x\n\n" * 200, b"1\n2\n" * 300):
        assert lines.chunks(text) == plain_chunks(text) and max((n for _, _, n in lines.chunks(text)), default=0) <= 32
    rng = random.Random(3)
    for _ in range(200):
        text = b"".join(rng.choice([b"a", b"bb ", b"", b" ", b"c\tc"]) + rng.choice([b"\n", b"\n", b""]) for _ in range(rng.randint(0, 300)))
        assert lines.chunks(text) == plain_chunks(text)


@pytest.mark.parametrize("kind", ["equal", "blank", "period 2", "period 7", "two kinds"])
def test_repetitive_blocks_are_chunked_alike_after_any_beginning(kind):
    """Of 310 lines that two texts share, most stand in chunks that both have, whatever comes before and after them."""
    rng, found = random.Random(kind), []
    for trial in range(100):
        some = [f"{trial} {rng.random()}" for _ in range(7)]
        block = {"equal": some[:1] * 310, "blank": [""] * 310, "period 2": some[:2] * 155, "period 7": (some * 45)[:310], "two kinds": rng.choices(some[:2], k=310)}[kind]
        one, two = ("\n".join([*(f"{rng.random()}" for _ in range(rng.randint(0, 90))), *block, *(f"{rng.random()}" for _ in range(rng.randint(1, 30)))]).encode() for _ in range(2))
        have = {one[a:b] for a, b, _ in lines.chunks(one)}
        found.append(sum(n for a, b, n in lines.chunks(two) if two[a:b] in have))
    assert sum(n >= 310 - 2 * lines.MOST for n in found) >= 95 and min(found) > 0.4 * 310 and sorted(found)[50] >= 0.8 * 310, sorted(found)


def test_two_documents_lose_the_repeated_lines_they_share(spark):
    rng = random.Random(1)
    for block in (["same"] * 300, [""] * 300, ["a b", "c d"] * 150):
        table = [(i, "\n".join([*(f"{i} {rng.random()}" for _ in range(40)), *block, "end"])) for i in range(2)]
        got = {r.doc_id: r.n_removed for r in lines.deduplicate(spark.createDataFrame(table, "doc_id long, text string")).collect()}
        assert got[1] >= 300 - lines.MOST


def test_line_chunks_resist_shifts():
    text = "\n".join(f"line {i * i}" for i in range(200)).encode()
    body = lambda t: {t[a:b] for a, b, _ in lines.chunks(t)}
    assert len(body(text) & body(b"new first line\n" + text)) >= 0.9 * len(body(text))
    assert b"".join(text[a:b] for a, b, _ in lines.chunks(text)) == text
    assert lines.chunks(b"") == []


def test_mixing_meets_its_targets(docs, corpus):
    got = mixing.schedule(docs).collect()
    assert len(got) == len(corpus)
    total, by = sum(r["size"] for r in got), defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r)
        assert r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
    assert sum(t for _, t in by) == pytest.approx(total)
    longest = max(r["size"] for r in got)
    for (size, target), rs in by.items():
        assert target <= 3 * size + 1e-6 and abs(sum(r.taken for r in rs) - target) <= 2 * longest
    assert sum(r.taken for r in got) <= total
    again = mixing.schedule(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_in_parts_of_few_rows_is_the_same(docs, monkeypatch):
    want = sorted(map(str, mixing.schedule(docs).collect()))
    monkeypatch.setattr(mixing, "TOGETHER", 2)
    monkeypatch.setattr(mixing, "TIME_BUCKETS", 1)
    assert sorted(map(str, mixing.schedule(docs).collect())) == want
    assert [mixing._digits(n) for n in (0, 8192, 8193, 2 * 16**5)] == [3, 3, 4, 5]


def test_mixing_empty_and_mixed_rows(docs, empty):
    assert mixing.schedule(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == mixing.schedule(docs).agg({"copies_taken": "sum"}).first()[0]


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def plain_hits(text, items):
    import re

    find = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", lowered(t))
    w, hit, names = find(text), set(), set()
    for item, t in items:
        x = find(t)
        size = min(13, len(x))
        windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
        for i in range(len(w) - size + 1) if size else ():
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                names.add("" if item is None else str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_matches_a_plain_version(spark, docs, corpus, empty):
    pool = [r[1] for r in corpus if r[1]]
    items = [(i, " ".join(t.split()[j : j + n])) for i, (t, j, n) in enumerate([(pool[1], 0, 30), (pool[65], 5, 40), (pool[99], 0, 5), (pool[2], 0, 1), (pool[70], 10, 13)])] + [(9, None), (10, ""), (None, pool[80]), (1, pool[65]), (1, pool[65])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_hit int")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(((r[0], *plain_hits(r[1], items)) for r in corpus), key=str)
    assert rows(decontaminate.annotate(docs, bench), *names) == want
    assert rows(decontaminate.annotate(docs, bench, block_windows=40), *names) == want
    assert {r[2] for r in rows(decontaminate.annotate(docs, bench.limit(0)), *names)} == {0}
    assert decontaminate.annotate(empty, bench).count() == 0


def test_a_passage_of_very_many_items_is_broadcast_without_their_names(spark, monkeypatch):
    n, words_ = 100_000, [f"t{i}" for i in range(20)]
    template, longer = " ".join(words_), " ".join([*words_[5:], "x", "y"])
    bench = spark.range(n).selectExpr("id AS item_id", f"'{template}' AS text").union(spark.createDataFrame([(n + 1, longer)], "item_id long, text string"))
    docs = spark.createDataFrame([(1, template), (2, f"a {template} b"), (3, longer), (4, "none of it"), (5, None)], "doc_id long, text string")
    sent = []
    block = decontaminate._block
    monkeypatch.setattr(decontaminate, "_block", lambda docs, rows: sent.extend(rows) or block(docs, rows))
    # the windows at 5, 6 and 7 of the template are in the longer item too; those after them are its own
    of_both, names = {f"{i}" for i in range(n)} | {f"{n + 1}"}, hashlib.sha256
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.annotate(docs, bench).collect()}
    digest = names(",".join(sorted(of_both)).encode()).hexdigest()
    assert got[1] == got[2] == (20, n + 1, digest) and got[3] == (17, n + 1, digest)
    assert got[4] == got[5] == (0, 0, names(b"").hexdigest())
    assert len(sent) == 10 and len({s for _, s in sent}) == 3 and all(len(s) == 16 for _, s in sent)
    flags = {r.doc_id: r.contaminated for r in decontaminate.flagged(docs, bench, ["doc_id"]).collect()}
    assert flags == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_blocks_are_bounded_by_bytes_too(spark, monkeypatch):
    words_ = [f"{c * 300}" for c in "abcdefghijklmnopqrstuvwxyz"]
    bench = spark.createDataFrame([(1, " ".join(words_))], "item_id long, text string")
    blocks = []
    block = decontaminate._block
    monkeypatch.setattr(decontaminate, "_block", lambda docs, rows: blocks.append(len(rows)) or block(docs, rows))
    docs = spark.createDataFrame([(1, " ".join(words_)), (2, " ".join(words_[:13]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.annotate(docs, bench, block_windows=100).collect()}
    assert got == {1: (26, 1), 2: (13, 1)} and sum(blocks) == 14 and len(blocks) == 3


def test_fingerprints_and_edits(docs, corpus, empty, spark):
    have = sorted((r for r in corpus if r[0] is not None), key=lambda r: r[0])
    unique = [r for i, r in enumerate(have) if i == 0 or r[0] != have[i - 1][0]]
    got = fingerprint.fingerprints(spark.createDataFrame([r[:2] for r in unique], "doc_id long, text string").repartition(4)).orderBy("doc_id").collect()
    assert len(got) == len(unique)
    seen = {}
    for i, g in enumerate(got):
        text, following = unique[i][1] or "", unique[(i + 1) % len(unique)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert (g.doc_id, g.n_chars, g.edited_sha256) == (unique[i][0], len(text), hashlib.sha256(new.encode()).hexdigest())
        assert seen.setdefault(text, g.fingerprint) == g.fingerprint
        assert seen.setdefault(new, g.edited_fingerprint) == g.edited_fingerprint
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        if text == new:
            assert g.near_edited == 1
        both = next((k for k, (a, b) in enumerate(zip(text, new, strict=False)) if a != b), min(len(text), len(new)))
        assert g.common_edited == both
    assert len({*seen.values()}) == len(seen)
    off = []
    for i, g in enumerate(got):
        text, following = unique[i][1] or "", unique[(i + 1) % len(unique)][1] or ""
        for other, near in ((fingerprint.edited(text, following), g.near_edited), (following, g.near_next)):
            a, b = ({t[k : k + 8] for k in range(max(1, len(t) - 7))} if t else set() for t in (text, other))
            off.append(abs(near - (1.0 if text == other else 2 * len(a & b) / max(1, len(a) + len(b)))))
    assert max(off) < 0.3 and sum(off) / len(off) < 0.05
    assert fingerprint.fingerprints(empty).count() == 0 and fingerprint.fingerprints(docs).count() == len(corpus)


def test_fingerprints_of_joined_texts_equal_those_of_the_whole():
    rng = random.Random(4)
    for _ in range(300):
        x, y = ("".join(rng.choices("ab é😀", k=rng.choice([0, 1, 7, 8, 9, 15, 16, 40, 300]))) for _ in range(2))
        new = fingerprint.edited(x, y)
        got = fingerprint._Held(1, x).result(fingerprint._Held(2, y))
        assert got[4] == fingerprint.as_string(fingerprint.Prefixes(fingerprint.code_points(new)).fingerprint())
        same = lambda p, q: next((k for k, (a, b) in enumerate(zip(p, q, strict=False)) if a != b), min(len(p), len(q)))
        assert (got[7], got[8]) == (same(x, new), same(x, y))


def test_fingerprints_of_null_and_repeated_ids(spark):
    table = [(None, "x y"), (None, None), (4, "a"), (4, "a"), (4, "b"), (7, "")]
    got = fingerprint.fingerprints(spark.createDataFrame([(*r, 1) for r in table], "doc_id long, text string, n_chars int")).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t or "")) for d, t in table)
    one = fingerprint.fingerprints(spark.createDataFrame(table[:1], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 3


def plain_simhash(text):
    w = lowered(text).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(corpus):
    fp = [plain_simhash(r[1]) for r in corpus]
    kinds = sorted({*fp})
    to = {f: f for f in kinds}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                to[root(a)] = root(b)
    least = {}
    for r, f in zip(corpus, fp, strict=True):
        if r[0] is not None:
            least[root(f)] = min(least.get(root(f), r[0]), r[0])
    return [(r[0], f"{f:016x}", least.get(root(f))) for r, f in zip(corpus, fp, strict=True)]


def test_simhash_matches_all_pairs(docs, corpus, empty):
    want = plain_groups(corpus)
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    assert len({x[2] for x in want}) < len({x[1] for x in want})
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({x[2] for x in want})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0


def test_simhash_links_random_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x, a, b in zip(base, rng.integers(0, 64, 300), rng.integers(0, 64, 300), strict=True)]
    signed = np.array([*map(int, base), *near], np.uint64).view(np.int64)
    fps = sorted({*map(int, signed)})
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    linked = {frozenset((r.src, r.dst)) for r in got.collect()}
    want = {frozenset((int(a), int(b))) for a, b in zip(signed[:300], signed[300:], strict=True) if a != b}
    assert want <= linked


def plain_windows(corpus):
    start = {}
    for r in corpus:
        w = (r[1] or "").encode().split()
        for i in range(len(w) - 49):
            g = tuple(w[i : i + 50])
            start[g] = min(start.get(g, r[0]), r[0])
    out = []
    for r in corpus:
        w = (r[1] or "").encode().split()
        drop = {j for i in range(len(w) - 49) if start[tuple(w[i : i + 50])] < r[0] for j in range(i, i + 50)}
        kept = [x for j, x in enumerate(w) if j not in drop]
        out.append((r[0], len(w), len(drop), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_matches_a_plain_version(docs, corpus, empty):
    have = [r for r in corpus if r[0] is not None]
    df = docs.filter("doc_id IS NOT NULL")
    want = plain_windows(have)
    assert sum(r[2] for r in want) > 500
    for batches in (1, 2, 5):
        assert rows(substrings.deduplicate(df, batches), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substrings.deduplicate(empty).count() == 0
    assert substrings.deduplicate(docs).count() == len(corpus)


def test_substring_dedup_in_loads_equals_one(spark, docs, corpus, tmp_path):
    have = [r for r in corpus if r[0] is not None]
    path, loads = f"file://{tmp_path}/index", [(0, 60), (60, 210), (210, 220), (220, 10_000)]
    assert len([r for r in have if r[0] >= 220]) > 10
    got, runs = [], []
    for low, high in loads:
        index = substrings.FingerprintIndex(spark, path)
        assert index.runs == runs
        part = docs.filter(f"doc_id >= {low} AND doc_id < {high}")
        got += rows(substrings.deduplicate(part, 1, index), "doc_id", "n_words", "n_removed", "kept_sha256")
        runs = sorted(index.runs)
    assert len(runs) == 1 and sorted(got, key=str) == plain_windows(have)


def test_substring_dedup_verifies_windows_of_an_earlier_load(spark, tmp_path):
    word = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    one, two = f"{word('a', 30)} {word('s', 60)} {word('b', 30)}", f"{word('c', 30)} {word('s', 60)} {word('d', 30)}"
    removed = []
    for i, t in enumerate((one, two)):
        load = spark.createDataFrame([(i, t)], "doc_id long, text string")
        removed.append(substrings.deduplicate(load, 1, substrings.FingerprintIndex(spark, f"file://{tmp_path}/index")).first().n_removed)
    assert removed == [0, 60]


def plain_bytes(corpus, width=200):
    count = Counter()
    texts = [(r[0], (r[1] or "").encode()) for r in corpus]
    for _, t in texts:
        count.update(t[i : i + width] for i in range(len(t) - width + 1))
    out = []
    for d, t in texts:
        drop = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                drop[i : i + width] = True
        n_spans = int((np.diff(np.concatenate(([0], drop.astype(int)))) == 1).sum())
        kept = bytes(c for c, x in zip(t, drop, strict=False) if not x)
        out.append((d, len(t), int(drop.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_matches_a_plain_version(docs, corpus, empty):
    want = plain_bytes(corpus)
    assert sum(r[2] for r in want) > 3000
    assert rows(suffixes.deduplicate(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffixes.deduplicate(empty).count() == 0


def test_suffix_dedup_of_a_passage_between_many_neighbours(spark, docs, corpus):
    rng = np.random.default_rng(3)
    some = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    short, long = some(150), some(230)
    texts = [some(40) + (long if i % 3 else short) + some(40) for i in range(300)]
    table = [(i, t) for i, t in enumerate(texts)]
    many = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    scratch = Scratch(spark)
    _, spans = suffixes.shared_anchors(scratch.keep(suffixes.find(many, suffixes._HOW, False), "t"), scratch)
    contexts, windows = suffixes.compared(suffixes.texts_by_key(many, scratch), spans, 50)
    assert max([r["count"] for r in contexts.groupBy("bucket").count().collect()], default=0) <= 50 and windows.count() > 0
    for data, plain, hot in ((many, table, 50), (many, table, suffixes.HOT), (docs, corpus, 1), (docs, corpus, 5)):
        assert rows(suffixes.deduplicate(data, hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_bytes(plain)


def plain_repeats(left, right, width):
    groups = defaultdict(list)
    for m in range(len(left)):
        for b in range(len(left[m]) + 1):
            for a in range(max(0, width - b), len(right[m]) + 1):
                groups[b, a, left[m][:b], right[m][:a]].append(m)
    out = set()
    for (b, a, _, _), ms in groups.items():
        before, after = {left[m][b : b + 1] for m in ms}, {right[m][a : a + 1] for m in ms}
        if len(ms) > 1 and (len(before) > 1 or before == {b""}) and (len(after) > 1 or after == {b""}):
            out.add((b, a, tuple(ms)))
    return out


def test_maximal_repeats_equal_a_plain_version():
    rng = random.Random(1)
    some = lambda: bytes(rng.choices(b"ab", k=rng.randint(0, 5)))
    for _ in range(500):
        n, width = rng.randint(1, 9), rng.randint(1, 5)
        left, right = [some() for _ in range(n)], [b"x" + some() for _ in range(n)]
        got = [(b, a, tuple(ms)) for b, a, ms in suffixes.maximal_repeats(left, right, width)]
        want = plain_repeats(left, right, width)
        assert len(got) == len({*got}) and {*got} == want
        covered = lambda found: {(m, i) for m, b, a in found for i in range(-b, a)}
        assert covered(suffixes.reaches(left, right, width)) == covered((m, b, a) for b, a, ms in want for m in ms)


def test_a_chain_of_contexts_takes_linear_work():
    n = 8000
    left, right = [str(i).encode()[::-1] + b"q" * 160 for i in range(n)], [b"b" * i + b"c" for i in range(n)]
    assert sum(1 for _ in suffixes.reaches(left, right, 200)) < 20 * n


def test_repeat_groups_have_all_occurrences(spark, docs, corpus):
    texts = {r[0]: (r[1] or "").encode() for r in corpus if r[0] is not None}
    got = defaultdict(set)
    for r in suffixes.repeat_groups(docs.filter("doc_id IS NOT NULL")).collect():
        got[r.repeat].add((r.doc_id, r.start, r.length))
    covered = defaultdict(set)
    for places in got.values():
        assert len({n for _, _, n in places}) == 1 and len({texts[d][s : s + n] for d, s, n in places}) == 1
        for d, s, n in places:
            covered[d].update(range(s, s + n))
    want = {r[0]: r[2] for r in plain_bytes([r for r in corpus if r[0] is not None])}
    assert {d: len(x) for d, x in covered.items()} == {d: n for d, n in want.items() if n}


def test_rows_are_told_apart_by_id_when_their_texts_hashes_collide(spark, docs, corpus, monkeypatch):
    from curatrix.llm import rows as R

    have, seen = [], set()
    for r in corpus:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            have.append(r)
    df = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    monkeypatch.setattr(R.F, "md5", lambda c: R.F.lit("00" * 16))
    assert rows(substrings.deduplicate(df), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_windows(have)
    assert rows(suffixes.deduplicate(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_bytes(have)
    assert rows(lines.deduplicate(df), "doc_id", "n_lines", "n_removed", "n_chunks", "kept_sha256") == plain_lines(have)


def test_old_runs_are_never_shuffled(spark, docs, capsys):
    index = substrings.FingerprintIndex(spark)
    scratch = Scratch(spark)
    for i in range(2):
        substrings.add_batch(index, docs.filter(f"doc_id % 2 = {i}"), scratch)
    assert len(index.runs) == 2
    index.entries().groupBy("anchor", "d0", "d1").count().explain()
    assert "Exchange" not in capsys.readouterr().out
    index.clear()


def test_compaction_leaves_one_entry_for_a_span_and_one_file_for_a_bucket(spark, docs, tmp_path):
    index = substrings.FingerprintIndex(spark, f"file://{tmp_path}/index")
    with Scratch(spark) as scratch:
        for i in range(3):
            substrings.add_batch(index, docs.filter(f"doc_id % 4 = {i}"), scratch)
    each = [r for run in index.runs for r in spark.read.parquet(run).select("anchor", "d0", "d1", "doc").collect()]
    least = {}
    for r in each:
        least[r[:3]] = min(r.doc, least.get(r[:3], r.doc))
    assert len(least) < len(each)
    index.compact(3)
    (run,) = index.runs
    assert sorted((r[:3], r[3]) for r in spark.read.parquet(run).select("anchor", "d0", "d1", "doc").collect()) == sorted(least.items())
    assert len([*Path(run.removeprefix("file://")).glob("*.parquet")]) <= index.buckets


def test_batches_share_one_search_and_few_files(spark, docs, monkeypatch):
    kept = []
    keep, bucketed = Scratch.keep, Scratch.bucketed
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a: (kept.append(name), keep(self, df, name, *a))[1])
    monkeypatch.setattr(Scratch, "bucketed", lambda self, df, name, *a, **b: (kept.append(name), bucketed(self, df, name, *a, **b))[1])
    substrings.deduplicate(docs.filter("doc_id IS NOT NULL"), 5)
    assert Counter(kept) == {"texts": 1, "anchors": 1, "batch": 5, "settled": 5, "old-anchors": 1, "windows": 1, "flags": 1}
    monkeypatch.setattr(substrings, "SHARE", 2)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, *a, f=type(spark.conf).get: "40" if a[0] == "spark.sql.shuffle.partitions" else f(self, *a))
    assert substrings.FingerprintIndex(spark).buckets == 20


def test_long_texts_are_taken_whole(spark):
    rng = np.random.default_rng(6)
    big = " ".join(rng.choice([f"w{i}" for i in range(5000)], 300_000))
    assert len(big) > 1 << 20
    passage = " ".join(big.split()[250_000:250_080])
    table = [(1, big), (2, f"a b {passage} c"), (3, big)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(substrings.deduplicate(df), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_windows(table)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.deduplicate(df).collect()}
    assert got[1] == got[3] == (len(big), 1) and abs(got[2][0] - len(passage)) <= 2
    assert {r.component_id for r in simhash.near_duplicates(df).filter("doc_id <> 2").collect()} == {1}
    out = tokens.read(spark, tokens.write(df, tokens.word_bpe())[0]).orderBy("doc_id").collect()
    assert out[0].n_tokens == out[2].n_tokens and out[0].ids_crc32 == out[2].ids_crc32
    fp = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert fp[1] == fp[3] != fp[2]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r.doc_id: r.n_items for r in decontaminate.annotate(df, bench).collect()} == {1: 1, 2: 1, 3: 1}


def test_token_files_round_trip(spark, docs, corpus, empty, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.word_bpe())
    want, at = [], 0
    order = sorted((r for r in corpus if r[0] is not None), key=lambda r: r[0])
    for r in order:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    df = docs.filter("doc_id IS NOT NULL")
    path, _ = tokens.write(df, tokens.word_bpe(), block_tokens=700, partitions=3)
    got = rows(tokens.read(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted((g[0], *g[2:]) for g in got) == sorted((w[0], *w[2:]) for w in want)
    assert got == sorted(want, key=str)
    assert tokens.read(spark, tokens.write(empty, tokens.word_bpe())[0]).count() == 0
    assert tokens.read(spark, tokens.write(docs, tokens.word_bpe())[0]).count() == len(corpus)


def test_rans_blocks():
    from curatrix.llm.rans import decode_block, encode_block, quantise

    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 50_000).clip(0, 999).astype(np.int64)
    lengths = np.array([20_000, 0, 30_000])
    table = quantise(np.bincount(ids, minlength=1000))
    assert table.freq.sum() == 1 << 20
    block = encode_block(ids, lengths, table, lanes=16, between=100)
    out, n = decode_block(block, table)
    assert (out == ids).all() and (n == lengths).all() and len(block) < 2 * len(ids)
    part, _ = decode_block(block, table, part=3)
    assert (part == ids[3 * 1600 : 4 * 1600]).all()
    with pytest.raises(ValueError):
        decode_block(block[:-1] + bytes([block[-1] ^ 1]), table)
    assert len(decode_block(encode_block(np.zeros(0, int), np.zeros(0, int), table), table)[0]) == 0


def test_segments_against_all_spans():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = rng.normal(-0.3, 1, rng.integers(1, 25)).tolist()
        got = toxicity.segments(x)
        best = max([0.0, *(sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1))])
        assert max([0.0, *(s for _, _, s in got)]) == pytest.approx(best)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        assert {i for i, v in enumerate(x) if v > 0} <= {i for a, b, _ in got for i in range(a, b)}


def plain_toxicity(corpus, labels):
    """Counts, log-odds and scoring units, one document and unit at a time."""
    import math
    import re

    y = {}
    for d, _, t in labels:
        if d is not None and t in (0, 1) and zlib.crc32(str(d).encode()) % 5:
            y[d] = max(t, y.get(d, 0))
    texts = [(r[0], {u for w in re.findall(r"[^\W_]+", (r[1] or "").lower()) for u in toxicity.units(w)}) for r in corpus]
    n, c, t = Counter(), Counter(), Counter()
    for d, us in texts:
        n.update(us)
        if d in y:
            (t if y[d] else c).update(us)
    labelled = [y[d] for d, _ in texts if d in y]
    all_, clean, toxic = len(texts), labelled.count(0), labelled.count(1)
    model = {}
    for u in t:
        p = toxicity.PRIOR * n[u] / all_
        odds = lambda x, all_of: (x + p) / max(1e-9, all_of + toxicity.PRIOR - x - p)
        s = math.log(odds(t[u], toxic)) - math.log(odds(c[u], clean))
        if t[u] >= toxicity.TOXIC_LEAST and s >= toxicity.ODDS_LEAST and s / math.sqrt(1 / (t[u] + p) + 1 / (c[u] + p)) >= toxicity.Z_LEAST:
            model[u] = s
    return model


def test_toxicity_scores_units_as_a_plain_version_does(spark):
    rng = np.random.default_rng(4)
    some = [f"wort{i}es" for i in range(300)]
    corpus = [(i, " ".join([*rng.choice(some, 40), *rng.choice(["Schlimm", "übel", "schlimmer"], 6 if i % 3 == 0 else 0)])) for i in range(300)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(250)] + [(None, 1, 1), (5, 0, None), (6, 0, 0)]
    docs, marks = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_toxicity(corpus, labels)
    assert {"schlimm", "übel", "^schl"} <= set(want)
    for bits, at_once in ((toxicity.FILTER_BITS, toxicity._UNITS), (64, 50)):  # a filter that lets nearly all pass, and counts sent on early
        got, _ = toxicity.fit_units(docs, marks, bits, at_once)
        assert got == pytest.approx(want)


def test_unit_counts_grow_with_tasks_not_with_partitions(spark):
    docs = spark.createDataFrame([(i, f"gleich{i % 7} wort") for i in range(400)], "doc_id long, text string").repartition(80)
    shared = spark.sparkContext.broadcast(toxicity.Labelled(np.arange(400), np.arange(400) % 2))
    each = toxicity._counts(docs, np.ones(64, bool), shared, 1000)
    units = {u for i in range(7) for w in (f"gleich{i}", "wort") for u in toxicity.units(w)}
    assert each.count() <= (80 // toxicity.SPLITS) * (len(units) + 1)
    found = {r.u: (r.n, r.c, r.t) for r in each.groupBy("u").sum("n", "c", "t").toDF("u", "n", "c", "t").collect()}
    assert found[None] == found["wort"] == found["^glei"] == (400, 200, 200) and set(found) == units | {None}
    assert toxicity._gathered(docs.coalesce(3)).rdd.getNumPartitions() == 3


def test_toxic_passages_are_found_and_significant(spark):
    rng = np.random.default_rng(4)
    some = [f"wort{i}es" for i in range(300)]
    bad = "so schlimm und übel schlimm übel ist das"
    corpus = [(i, " ".join([*rng.choice(some, 40), *(bad.split() if i % 3 == 0 else []), *rng.choice(some, 20)])) for i in range(300)]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(250)], "doc_id long, quality int, toxic int")
    for r in toxicity.score(docs, labels).collect():
        assert r.predicted == int(r.doc_id % 3 == 0) and r.n_passages == len(r.passages) == r.predicted
        assert all(40 <= p.start < p.stop <= 48 and p.bits > 4 for p in r.passages)


def test_sums_of_many_passages_are_corrected_in_full(spark):
    import math

    for n in (0, 1, 2, 19, 20, 21, 80, 200):
        passages = spark.createDataFrame([([(0, 1, 1.0, 4.4)] * n, 10 * n)], "passages array<struct<start: int, stop: int, score: double, bits: double>>, n_words int")
        want = max(0.0, 4.4 * n - math.lgamma(n + 1) / math.log(2))
        assert passages.select(toxicity._features()[2]).first()[0] == pytest.approx(math.log1p(want))


def test_karlin_and_logistic_solve_their_equations():
    lam = toxicity.karlin(0.1, 1.5, 0.3)
    assert 0.1 * np.exp(lam * 1.5) + 0.9 * np.exp(-lam * 0.3) == pytest.approx(1)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert toxicity._logistic(x, y) == pytest.approx([2, -1, 0.5], abs=0.25)


def test_words_are_lower_case_letters_and_digits():
    import pyarrow as pa

    w = toxicity.words(pa.array(["Über-Maß, x_9!", None, "", " ,", "a a", "b"]))
    assert [w.distinct[i] for i in w.index] == ["über", "maß", "x", "9", "a", "a", "b"] and w.at.tolist() == [0, 4, 4, 4, 4, 6, 7]


def test_toxicity_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "toxic", "predicted").toPandas()
    pos, neg = got.score[got.toxic == 1].to_numpy(), got.score[got.toxic == 0].to_numpy()
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert auc > 0.9, auc
    precision = (got.toxic[got.predicted == 1] == 1).mean()
    assert precision > 0.85, precision


def test_toxicity_edge_rows(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(r[0], 1, int(i % 4 == 0)) for i, r in enumerate(corpus[:60])] + [(None, 1, 1), (6, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
    assert toxicity.score(empty, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == len(corpus)


def test_word_encoder_agrees_with_the_tokenizer(monkeypatch):
    import pyarrow as pa

    path = tokens.word_bpe()
    patterns = ("a{0}b", "{0}", "x{0}'s {0}{0}9", "A {0}", "{0}Z")
    texts = [p.format(chr(i)) for i in range(0x3000) for p in patterns]
    texts += ["a<b|c <|endoftext|> x", "İstanbul İ", "</w> a</w>b", " ", "", "é x́y", "q ́ a", "<|startoftext|>"]
    own = tokens.WordEncoder(path)
    assert own.wordwise
    wanted = [np.array([*e.ids, tokens.END_ID], own.type).tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(pa.array(texts)).to_pylist() == wanted
    assert own.encode(pa.array(texts)).to_pylist() == wanted  # now from what is known
    monkeypatch.setattr(tokens, "_CACHE", 100)
    assert own.encode(pa.array(texts[::-1])).to_pylist() == wanted[::-1]
    assert own.encode(pa.array(texts)).to_pylist() == wanted and len(own.words.number) == 100
    assert own.encode(pa.array([None, ""], pa.string())).to_pylist() == [own.end.tobytes()] * 2
    assert own.encode(pa.array([], pa.string())).to_pylist() == []


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    import pyarrow as pa

    own = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["two  words", " lead", "", "x\n\ny"]
    assert not own.wordwise
    assert own.encode(pa.array(texts)).to_pylist() == [np.array([*e.ids, tokens.END_ID], own.type).tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_lines_are_taken_in_pieces_of_a_batch(spark):
    """A worker's memory doesn't grow with the batch: it holds no copy of it and not all its chunks."""
    import tracemalloc

    class Taken:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    texts = ["\n".join(f"{i} {j} " + "of a text " * 8 for j in range(900)) for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"k": [b"%d" % i for i in range(100)], "doc": list(range(100)), "text": texts})
    run = lines._found(Taken())
    tracemalloc.start()
    found = sum(out.num_rows for out in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 10_000 and most < sum(map(len, texts)) / 2


def test_line_dedup_writes_nothing_and_shuffles_texts_once(spark):
    from curatrix.sources.shared import listed, own_dir

    before = listed(spark, own_dir(spark))
    got = lines.query(spark, "/root/testdata/sf0.001")
    assert len(got.collect()) == 200 and listed(spark, own_dir(spark)) == before
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_op8_flags_stand_in_few_files(spark, docs, corpus):
    from curatrix.sources.shared import listed, own_dir

    before = listed(spark, own_dir(spark))
    assert substrings.deduplicate(docs).count() == len(corpus)
    (flags,) = (p for p in listed(spark, own_dir(spark)) if p not in before and p.rsplit("/", 1)[1].startswith("flags-"))
    assert sum("/part-" in p for p in listed(spark, flags)) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
