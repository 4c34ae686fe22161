"""Each stage of the pipeline against brute force on what it was given."""

import public_tokenizers as P
from test_dedup import brute_components, brute_exact
from test_suffix_dedup import brute
from tokenizers import Tokenizer

import corpus_pipeline
from causeway.llm import quality
from causeway.llm._io import keep, table

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    names = docs.columns
    extra = spark.createDataFrame([(None, "Some words that stay here, all of them.", "en", "s", 39), (None, None, "en", "s", None), (5, "", "en", "s", 0)], docs.schema)
    docs = keep(docs.union(extra), "input")
    scores = {(r.doc_id, r.text): r.predicted for r in quality.score(docs, quality.fit(docs.select("doc_id", "text"), table(spark, SMALL, "labels")), carry=("doc_id", "text")).collect()}
    before = docs.collect()
    docs = keep(corpus_pipeline.good_quality(spark, docs, SMALL), "stage")
    assert docs.columns == names
    after = docs.collect()
    assert sorted(map(str, after)) == sorted(str(r) for r in before if scores[r.doc_id, r.text] == 1)

    docs = docs.union(docs.where("doc_id % 7 = 0")).union(spark.createDataFrame([(None, None, "en", "s", None), (None, "null id", "en", "s", 7), (None, "NULL id", "en", "s", 7)], docs.schema))
    docs = keep(docs, "stage")
    want = {(keep_id, sha) for _, keep_id, _, _, sha in brute_exact([(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()])}
    docs = keep(corpus_pipeline.one_of_copies(spark, docs, SMALL), "stage")
    rows = docs.collect()
    assert docs.columns == names and len(rows) == len(want) and {-1 if r.doc_id is None else r.doc_id for r in rows} == {i for i, _ in want}

    numbered = list(enumerate(r.text for r in rows))
    groups = {}
    for k, _, c in brute_components(numbered, 5, 80):
        groups.setdefault(c, set()).add(rows[k].text)
    docs = keep(corpus_pipeline.one_of_near_copies(spark, docs, SMALL), "stage")
    rows = docs.collect()
    texts = [r.text for r in rows]
    assert docs.columns == names and len(texts) == len(groups) and all(sum(t in g for t in texts) == 1 for g in groups.values())

    cut = {i: (n_spans, kept) for i, _, _, n_spans, kept in brute([(r.doc_id, r.text) for r in rows]) if i is not None}
    assert sum(n > 0 for n, _ in cut.values()) > 5
    docs = keep(corpus_pipeline.without_passages(spark, docs, SMALL), "stage")
    out = docs.collect()
    assert docs.columns == names and len(out) == len(rows)
    whole = {r.doc_id: r.text or "" for r in rows}
    for r in out:
        if r.doc_id is not None:
            n_spans, kept = cut[r.doc_id]
            got = (r.text or "").encode()
            # Beside the bytes that stay, at most the rest of a character at either end of a span.
            assert got == kept if whole[r.doc_id].isascii() or not n_spans else len(kept) <= len(got) <= len(kept) + 6 * n_spans
            assert "\ufffd" in whole[r.doc_id] or "\ufffd" not in (r.text or "")
    assert all(r.n_chars in (len(r.text), None) for r in out if r.text is not None)

    pieces = corpus_pipeline.sequences(spark, docs, SMALL).collect()
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(coder.encode(r.text or "").ids) + 1 for r in out)


def test_clashing_names(spark):
    """Columns that are named as what operators add come through, and change nothing."""
    from pyspark.sql import functions as F

    docs = keep(table(spark, SMALL, "documents").where("doc_id % 4 < 2"), "input")
    names = ["__row", "__null", "__maybe", "__at", "predicted", "score", "key", "id", "kept", "others", "no_text", "component_id", "n_removed"]
    more = keep(docs.select("*", *[F.col("doc_id").alias(n) for n in names]), "input")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out, same = keep(stage(spark, more, SMALL), "stage"), stage(spark, docs, SMALL)
        assert out.columns == more.columns and not out.where(" OR ".join(f"NOT {n} <=> doc_id" for n in names)).count()
        assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, same.collect()))
    assert corpus_pipeline.sequences(spark, more, SMALL).columns == corpus_pipeline.sequences(spark, docs, SMALL).columns


def test_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SMALL, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "suffix dedup", "packing"]
