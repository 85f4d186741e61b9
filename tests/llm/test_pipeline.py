"""Each stage of the pipeline against a plain version on its own input."""

from collections import Counter

import corpus_pipeline as P
from curatrix.llm import decontaminate, mixing, toxicity
from curatrix.sources.shared import materialize, table

from .test_text_operators import plain_groups, plain_hits

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    kept = materialize(P.drop_toxic(spark, docs, DATA), "t")
    scored = {r.doc_id: r.predicted for r in toxicity.score(docs, table(spark, DATA, "labels")).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {k for k, v in scored.items() if v == 0}

    before = [(r.doc_id, r.text) for r in kept.collect()]
    kept = materialize(P.drop_near_duplicates(spark, kept, DATA), "t")
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted({g[2] for g in plain_groups(before)})

    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    want = {r.doc_id for r in kept.collect() if not plain_hits(r.text, items)[4]}
    kept = materialize(P.drop_contaminated(spark, kept, DATA), "t")
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want
    assert decontaminate.annotate(kept, table(spark, DATA, "benchmark")).filter("contaminated").count() == 0

    plan = {r.doc_id: r.copies_taken for r in mixing.schedule(kept).collect()}
    mixed = materialize(P.mix_sources(spark, kept, DATA), "t")
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in plan.items() if v})

    out = P.write_tokens(spark, mixed, DATA).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in mixed.collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False))
    assert [name for name, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]


def test_run_is_the_stages_in_order(spark):
    assert P.run(spark, DATA).columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and P.run(spark, DATA).count() > 0


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, k string, row int, n_words long, copy int"
    word = "Ein Satz aus einigen Wörtern, der für sich steht "
    rows = [(i, f"{word}{i} {i * 7} {i * i}", "de", "a", 1, 5, "k", 2, 3, 4) for i in range(30)]
    rows += [rows[3], (None, None, None, None, None, None, None, None, None, None), (50, "", "de", None, 0, 1, "", 1, 1, 1), (51, word * 4000, "de", "b", 1, 1, "", 1, 1, 1), (None, "ohne Nummer " * 9, None, "b", 1, 1, "", 1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        kept = materialize(stage(spark, docs, DATA), "t")
        assert kept.columns == docs.columns and kept.count() > 20
        assert {r.doc_id for r in kept.collect()} <= {r[0] for r in rows}
        empty = materialize(stage(spark, docs.limit(0), DATA), "t")
        assert empty.columns == docs.columns and empty.count() == 0
    assert P.write_tokens(spark, docs, DATA).count() == len(rows) and P.write_tokens(spark, docs.limit(0), DATA).count() == 0
