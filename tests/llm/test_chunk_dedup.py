"""Repeated passages against a plain walk over all chunks."""

import numpy as np

from causeway.llm import chunk_dedup
from causeway.llm._chunks import WINDOW, gear, peak_cuts

SCHEMA = "doc_id long, text string, chunk int, n int"


def plain_cuts(data, reach):
    """Peaks one by one, for a single text."""
    h = gear(np.frombuffer(data, np.uint8)).astype(int)
    out = []
    for i in range(WINDOW - 1 + reach, len(data) - reach):
        before, after = h[i - reach : i], h[i + 1 : i + reach + 1]
        if h[i] >= before.max() and h[i] > after.max():
            out.append(i + 1)
    return [*out, len(data)] if data else []


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        cuts = plain_cuts(data, chunk_dedup.REACH)
        again = []
        for k, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
            if data[a:b] in seen:
                again.append(k)
            seen.add(data[a:b])
        spans = chunk_dedup._runs(np.array(again, np.int64), np.array([0, *cuts]), chunk_dedup.LEAST_RUN)
        kept, to = b"", 0
        for a, b in spans:
            kept, to = kept + data[to:a], b
        out[i] = (len(data), len(cuts), sum(b - a for a, b in spans), len(spans), kept + data[to:])
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_chunks, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()}


def test_against_a_walk_over_all_chunks(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(9000, None), (9001, ""), (9002, "ab" * 900), (9003, "short"), (9004, "short")]
    pick = np.random.default_rng(2)
    passage = " ".join("".join(chr(97 + c) for c in pick.integers(0, 26, 6)) for _ in range(60))
    rows += [(9100 + k, f"{'lead ' * k}{chr(65 + k) * 70} {passage} {'tail' * k}") for k in range(5)]
    out = got(chunk_dedup.remove_repeats(spark.createDataFrame([(i, t, 1, 1) for i, t in rows], SCHEMA)))
    assert out == brute(rows)
    assert out[9100][2] == 0 and all(out[9100 + k][2] > 0.6 * len(passage) for k in range(1, 5))


def test_passages_of_51_words_go(spark):
    """Of 300 passages of 51 words of mixed length, nearly all lose most of their second occurrence."""
    pick = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + c) for c in pick.integers(0, 26, pick.integers(2, 9)))
    passages = [" ".join(word() for _ in range(51)) for _ in range(300)]
    rows = [(1000 * k + n, " ".join([*(word() for _ in range(40)), p, *(word() for _ in range(40))]), 1, 1) for k in range(2) for n, p in enumerate(passages)]
    out = got(chunk_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)))
    caught = [out[1000 + n][2] for n in range(300)]
    assert sum(c > 0 for c in caught) >= 297 and sum(out[n][2] for n in range(300)) == 0
    assert sum(caught) > 0.5 * sum(len(p) for p in passages)


def test_nulls_repeats_and_empty(spark):
    text = " ".join(str(k * 7919) for k in range(400))
    df = spark.createDataFrame([(None, text, 1, 1), (None, text, 1, 1), (5, text, 1, 1), (6, text, 1, 1)], SCHEMA)
    out = sorted((r.doc_id is None, r.n_removed > 0) for r in chunk_dedup.remove_repeats(df).collect())
    assert out == [(False, False), (False, True), (True, False), (True, False)]
    assert chunk_dedup.remove_repeats(df.limit(0)).count() == 0


def test_chunks_are_not_written_and_texts_without_runs_stay(spark, monkeypatch, tmp_path):
    """Beside marks nothing is written, and the texts that lose nothing don't join them."""
    written, probed = [], []
    keep, mark = chunk_dedup.keep, chunk_dedup._bloom.mark
    monkeypatch.setattr(chunk_dedup, "keep", lambda df, name: written.append(keep(df, name)) or written[-1])
    monkeypatch.setattr(chunk_dedup._bloom, "mark", lambda *a: probed.append(mark(*a)) or probed[-1])
    pick = np.random.default_rng(12)
    noise = lambda n: "".join(chr(97 + c) for c in pick.integers(0, 26, n))
    shared, few = noise(600), noise(120)
    rows = [(1, noise(300) + shared), (2, shared + noise(500)), (3, few + noise(400)), (4, noise(400) + few), *((10 + k, noise(900)) for k in range(200))]
    # The same id twice: chunk numbers of one count for the other too, whose chunks may be larger.
    rows += [(300, few[:100] + noise(50)), (300, noise(40))]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], SCHEMA)
    out = got(chunk_dedup.remove_repeats(df))
    assert {i: out[i] for i, _ in rows if i != 300} == {i: x for i, x in brute(rows).items() if i != 300} and out[2][2] > 400
    assert [set(x.columns) for x in written] == [{"doc_id", "__repeats"}] and written[0].count() < 10
    assert {1, 2, 300} - {r.doc_id for r in probed[0].where("__open").collect()} <= {1} and probed[0].where("__open").count() < 10


def test_cuts_of_rows_do_not_depend_on_their_neighbours():
    pick = np.random.default_rng(3)
    texts = [pick.integers(0, 256, n, dtype=np.uint8) for n in (0, 5, 400, 1000, 90, 0, 3000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = peak_cuts(np.concatenate(texts), offsets, 32)
    apart = np.concatenate([[c + o for c in plain_cuts(t.tobytes(), 32)] for t, o in zip(texts, offsets, strict=False)])
    assert together.tolist() == apart.astype(int).tolist()


def test_short_slices(spark):
    """Partitions whose texts are shorter than the reach or the hash's window, alone or together."""
    pick = np.random.default_rng(9)
    long = "".join(chr(97 + c) for c in pick.integers(0, 26, 900))
    texts = ["b", "b" * 31, long[:32], long[:33], "", None, "b"]
    for rows in ([(1, "b")], [(1, ""), (2, None)], [(1, long[:31])], [(1, long[:33]), (2, long[:33])], list(enumerate(texts))):
        df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], SCHEMA)
        assert got(chunk_dedup.remove_repeats(df.coalesce(1))) == brute(rows)
    rows = [(1, "b"), (2, long), (3, long), (4, "cd")]
    assert got(chunk_dedup.remove_repeats(spark.createDataFrame([(i, t, 1, 1) for i, t in rows], SCHEMA).repartition(4))) == brute(rows)
    for n in range(1, 70):
        assert peak_cuts(np.frombuffer(long[:n].encode(), np.uint8), np.array([0, n]), 16).tolist() == plain_cuts(long[:n].encode(), 16)
