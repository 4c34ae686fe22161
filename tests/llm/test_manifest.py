"""The Merkle manifest against plain Python."""

import zlib
from hashlib import sha256

import duckdb
import pytest

from causeway.llm import manifest, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, lo long, path string, grp string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(digests, proofs):
    """The root; adds to each leaf's list of (left, right) in proofs."""
    groups = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        for at in range(len(digests)):
            first = at - at % 8
            for i in groups[at]:
                proofs[i].append(("".join(digests[first:at]), "".join(digests[at + 1 : first + 8])))
        groups = [sum(groups[k : k + 8], []) for k in range(0, len(groups), 8)]
        digests = [h(*digests[k : k + 8]) for k in range(0, len(digests), 8)]
    return digests[0]


def plain(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    subroots, paths, order = [], [], sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own = [[] for _ in langs[lang]]
        subroots.append(tree([leaf(r) for r in langs[lang]], own))
        paths.append(own)
    upper = [[] for _ in subroots]
    root = tree(subroots, upper)
    out = []
    for lang, sub, own, up in zip(order, subroots, paths, upper, strict=True):
        for row, mine in zip(langs[lang], own, strict=True):
            way = mine + up
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]) if changed else row[1]
            folded = leaf((row[0], low, *row[2:]))
            for left, right in way:
                folded = h(left, folded, right)
            out.append((row[0], leaf(row), sub, root, h(*[x for pair in way for x in pair]), folded, folded == root))
    return sorted(out, key=repr)


def documents(n, langs):
    rows = [(i, f"Text {i} É" if i % 5 else "lower only", langs[(i * i) % len(langs)], None if i % 7 == 0 else "s", i) for i in range(n)]
    return [(*r, 1, 2, "x", "y") for r in rows]


CASES = {
    "empty": [],
    "one": documents(1, ["en"]),
    "full runs": documents(64, ["en"]),
    "one over": documents(65, ["en"]),
    "many groups": documents(300, [None, "", "de", "en", "=", "é", "zh", "a", "B", "b", "c"]),
    "nulls, ties and repeats": [(None, None, None, None, None, 1, 1, "x", None)] * 20 + [(3, "A", "en", "s", 1, 0, 0, None, "y")] * 9 + [(3, "B", "en", "s", 1, 0, 0, None, "y"), (None, "Long " * 100_000, "en", None, 2, 1, 1, "", "")],
}


@pytest.mark.parametrize("name", CASES)
def test_against_plain_python(spark, tmp_path, name):
    spark.createDataFrame(CASES[name], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == (plain(CASES[name]) if CASES[name] else [])


def test_general_columns(spark):
    df = spark.createDataFrame([(k, k % 3, None) for k in range(50)], "k int, g int, extra string")
    out = manifest.manifest(df, ["k"], "g", "k", {"double": df.k * 2}).collect()
    assert len(out) == 50 and len({r.top for r in out}) == 3 and all(r.double == 2 * r.k for r in out)
    assert {r.digest for r in out} == {h(f"{len(str(k))}:{k}") for k in range(50)}


def test_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op11_manifest"]).fetchall()
    assert sorted(tuple(r) for r in queries.op11_manifest(spark, at).collect()) == sorted(want)
    assert 0 < sum(not r[-1] for r in want) < len(want)
