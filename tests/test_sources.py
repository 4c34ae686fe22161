"""Readers and writers over small files."""

import json

import pytest
from pyspark.sql import functions as F

from causeway.operators import statements
from causeway.sources import readers, writers


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_text(text if isinstance(text, str) else json.dumps(text), encoding=encoding)
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_indicators_and_sentinels(spark, tmp_path):
    path = put(tmp_path, "i.tsv", "Country\tCounty\tState\tSource\tUnit\tVariable\tYear\tMonth\tValue\nSS\t\t\tFAO\tkg\tMaize\t2011\t\t5\nSS\tA\tB\tFAO\tkg\tMaize\t\t3\tx\n")
    df = readers.read_indicators(spark, path)
    assert rows(df) == [("SS", "A", "B", "FAO", "kg", "Maize", -1, 3, None), ("SS", "None", "None", "FAO", "kg", "Maize", 2011, 0, 5.0)]
    back = rows(readers.null_sentinels(df))
    assert back[1] == ("SS", None, None, "FAO", "kg", "Maize", 2011, None, 5.0)


def test_layouts_and_wide_years(spark, tmp_path):
    a = put(tmp_path, "a.csv", "Area,Item Code,Value\nCôte,7,1\n", "latin-1")
    b = put(tmp_path, "b.csv", "Area,Year,Flag\nX,2010,F\n", "latin-1")
    df = readers.read_layouts(spark, [a, b])
    assert df.columns == ["Area", "Value", "Year"] and rows(df) == [("Côte", "1", None), ("X", None, "2010")]
    w = put(tmp_path, "w.csv", "Country Name,Indicator Name,2010,2011\nSS,gdp,1,\nET,gdp,..,3\nUS,gdp,4,5\n")
    assert rows(readers.read_wide_years(spark, w, {"Country Name": "country", "Indicator Name": "variable"}, ["SS", "ET"])) == [("ET", "gdp", 2011, 3.0), ("SS", "gdp", 2010, 1.0)]


def test_adjectives_maps_crops_and_names(spark, tmp_path):
    a = put(tmp_path, "adj.txt", "0 x large y z q 0.7\n1 x small y z q bad\n\n2 short\n")
    assert rows(readers.read_adjectives(spark, a)) == [("large", 0.7)]
    m = put(tmp_path, "map.tsv", 'wm/food\tFAO\t"Food price"\t0.9\nwm/x\tWDI\tY\t0.1\n')
    assert rows(readers.read_concept_map(spark, m, "FAO")) == [("wm/food", "FAO", "Food price", 0.9)]
    d = tmp_path / "dssat"
    d.mkdir()
    put(d, "Upper-Nile_MZ.csv", "day,area,value\n1,2,3\n")
    put(d, "Unity_QQ.csv", "day,area,value\n4,5,6\n")
    assert rows(readers.read_dssat_aggregate(spark, str(d), ["day", "area", "value"], {"MZ": "Maize"})) == [("1", "2", "3", "Upper Nile", "Maize", "DSSAT"), ("4", "5", "6", "Unity", "QQ", "DSSAT")]
    names = spark.createDataFrame([("SS_201806_CS.csv",), ("other",)], "f string")
    found = names.select(*[c.alias(k) for k, c in readers.columns_from_filename(F.col("f"), {"year": r"_(\d{4})", "month": r"_\d{4}(\d{2})"}).items()])
    assert rows(found) == [("2018", "06"), (None, None)]


SIDE = {"concept": "wm/a", "concept_score": 0.8, "polarity": 1, "adjectives": ["large"], "theme": "t"}
STATEMENT = {"id": "s1", "belief": 0.9, "subj": SIDE, "obj": SIDE | {"concept": "wm/b"}, "evidence": [{"evidence_context": {"subj_adjectives": [], "subj_polarity": None, "obj_adjectives": ["small"], "obj_polarity": -1, "text": "x"}}, {}]}


def test_statements_models_and_experiments(spark, tmp_path):
    lines = put(tmp_path, "s.jsonl", json.dumps({"_source": STATEMENT}) + "\n{}\n")
    st = readers.read_statements_jsonl(spark, lines)
    assert rows(statements.evidence_rows(st)) == [("s1", 0, "wm/a", "wm/b", 0.9, 0.8, 0.8, "None", 1, "small", -1, "x")]
    model = put(tmp_path, "m.json", {"id": "m", "statements": [STATEMENT], "conceptIndicators": {"wm/a": {"name": "i", "source": "F", "func": "mean", "period": 12, "resolution": "month", "values": [{"timestamp": 3, "value": 1.5}, {"timestamp": 9, "value": 2}]}, "wm/b": {"name": "j", "values": []}}})
    s, obs = readers.read_create_model(spark, model)
    assert s.count() == 1 and rows(obs.select("concept", "indicator", "ts_ms", "value")) == [("wm/a", "i", 3, 1.5), ("wm/a", "i", 9, 2.0), ("wm/b", "j", None, None)]
    e = put(tmp_path, "e.json", {"experimentType": "PROJECTION", "experimentParams": {"startTime": 1, "endTime": 2, "numTimeSteps": 4, "constraints": [{"concept": "wm/a", "values": [{"step": 2, "value": 7}, {"step": None, "value": 1}]}]}})
    p, c = readers.read_constraints(spark, e)
    assert rows(p) == [("PROJECTION", 1, 2, 4)] and rows(c) == [("wm/a", 2, 7.0)]


def test_extracted_statements_and_groundings(spark, tmp_path):
    agent = lambda n, s: {"concept": {"name": n, "db_refs": {"TEXT": f"the {n}", "UN": [[f"UN/x/{n}", s], ["UN/y", 0.1]]}}, "delta": {"polarity": -1, "adjectives": []}}
    doc = [{"type": "Influence", "belief": 0.7, "id": "1", "subj": agent("rain", 0.9), "obj": agent("crop", 0.4), "evidence": []}, {"type": "Association", "belief": 1, "id": "2"}]
    path = put(tmp_path, "x.json", doc)
    st = readers.read_statements_json(spark, path)
    out = statements.influence_from_groundings(st, "UN", 0.5, 0.3).select("subj", "obj", "subj_pol", "obj_adj").first()
    assert tuple(out) == ("UN/x/rain", "UN/x/crop", -1, "None")
    assert statements.influence_from_groundings(st, "UN", 0.5, 0.5).count() == 0
    g = readers.read_groundings(spark, str(tmp_path / "*.json"), "UN").orderBy("name").collect()
    assert [(r.name, r.text, r.groundings[0].name) for r in g] == [("crop", "the crop", "UN/x/crop"), ("rain", "the rain", "UN/x/rain")]


def test_timings_links_edits_and_edges(spark, tmp_path):
    put(tmp_path, "t1.csv", "Run,Nodes,Edges,K,W,C,S\n1,2,3,10,5000000,1000000,0\n")
    put(tmp_path, "skip.txt", "x\n")
    assert rows(readers.read_timings(spark, str(tmp_path), "t*.csv")) == [(1, 2, 3, 10, 5.0, 1.0, 0)]
    end = lambda t: {"type": t, "source": "s", "content": t[0], "content_type": "c"}
    links = put(tmp_path, "l.json", {"grounding": [{"element_1": end("variable"), "element_2": end("comment"), "score": 0.5}]})
    assert rows(readers.read_links(spark, links)) == [("variable::s::v", "variable", "comment::s::c", "comment", 0.5)]
    edits = put(tmp_path, "d.json", {"relations": [{"source": "a", "target": "b", "polarity": -1, "weights": [0.4]}]})
    assert rows(readers.read_edits(spark, edits)) == [("a", "b", -1, 0.4)]
    assert rows(readers.read_edge_list(spark, put(tmp_path, "e.txt", "a, b\nb,c\n"))) == [("a", "b"), ("b", "c")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, variable string")
    path = str(tmp_path / "table")
    writers.write_table(df, "t", path)
    assert rows(writers.write_table(df.where("k = 1"), "t", path)) == [(1, "a")]
    assert rows(writers.write_tsv(df, "t")) == [(1, "a"), (2, None)]
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k int, variable string")
    assert rows(writers.upsert(df, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert writers.nodes_without_indicator(spark.createDataFrame([("x",), ("y",)], "concept string"), spark.createDataFrame([("x",)], "concept string")).first().concept == "y"


def test_a_table_is_whole_before_and_after_the_switch(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "versioned"), spark.createDataFrame([(1, "a"), (2, None)], "k int, variable string")
    with pytest.raises(FileNotFoundError):
        writers.current(spark, path)
    assert rows(writers.publish(df, path)) == [(1, "a"), (2, None)]
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k int, variable string")

    def lost(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(writers, "_switch", lost)  # stops between the write and the switch
        with pytest.raises(RuntimeError):
            writers.upsert_into(path, new, ["k"])
    assert rows(writers.current(spark, path)) == [(1, "a"), (2, None)]
    before = writers.current(spark, path)
    assert rows(writers.upsert_into(path, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(before) == [(1, "a"), (2, None)] and rows(writers.current(spark, path)) == [(1, "a"), (2, "b"), (3, "c")]


def test_edges_json_in_parts(spark):
    df = spark.createDataFrame([("m", f"n{k:02}", k) for k in range(25)] + [(None, "x", 1)], "model string, dst string, w int")
    out = rows(writers.edges_json(df, ["model"], ["dst", "w"], size=10).where("model = 'm'"))
    assert [r[:3] for r in out] == [("m", 25, 0), ("m", 25, 1), ("m", 25, 2)]
    assert [e["w"] for r in out for e in json.loads(r[3])] == list(range(25))


@pytest.mark.parametrize("text", ["[]", "{}"])
def test_empty_documents(spark, tmp_path, text):
    assert readers.read_links(spark, put(tmp_path, "empty.json", text)).count() == 0
