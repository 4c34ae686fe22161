"""Readers. Paths may be globs; rows that can't be read as their schema become nulls."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import camel_words, lookup
from causeway.sources import schemas


def fill_sentinels(df: DataFrame) -> DataFrame:
    """'None' for missing texts, -1 for a missing year, 0 (annual) for a missing month."""
    texts = {c: F.coalesce(c, F.lit("None")) for c in ("country", "county", "state", "source", "unit", "variable") if c in df.columns}
    return df.withColumns(texts | {"year": F.coalesce("year", F.lit(-1)), "month": F.coalesce("month", F.lit(0))})


def null_sentinels(df: DataFrame) -> DataFrame:
    """The reverse of fill_sentinels()."""
    texts = {c: F.nullif(c, F.lit("None")) for c in ("country", "county", "state", "source", "unit", "variable") if c in df.columns}
    return df.withColumns(texts | {"year": F.nullif("year", F.lit(-1)), "month": F.nullif("month", F.lit(0))})


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated observations with sentinels for what is missing."""
    return fill_sentinels(spark.read.csv(path, schema=schemas.INDICATOR, sep="\t", header=True, enforceSchema=True))


#: A comma outside quotes: an even number of quotes follows it.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _fields(line: Column) -> Column:
    """The fields of a line of a CSV file, without their quotes; empty ones are null."""
    plain = lambda f: F.when(f.rlike('^".*"$'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.split(line, _COMMA, -1), lambda f: F.nullif(plain(f), F.lit("")))


def layout_rows(spark: SparkSession, paths: Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """file, fields (a map from the file's own header to a line's values) and reject, in one scan of all files.

    A file's header is its first line. A line with another number of fields than its header is a
    reject as it stands, with null fields; a line that repeats the header, or is empty, goes. Records are lines.
    """
    # a separator that texts don't hold, and no quotes: each line is one value, decoded
    scan = spark.read.csv([*paths], schema="value string", sep="\x01", quote="", escape="", encoding=encoding)
    lines = scan.select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("__first"), F.monotonically_increasing_id().alias("__at")).where("value <> ''")
    # a file's first block holds its first line; a task reads blocks one after another
    heads = lines.where("__first").groupBy("file").agg(F.min_by("value", "__at").alias("__head"))
    both = lines.join(heads, "file").where(~F.col("__first") | (F.col("value") != F.col("__head")))
    both = both.select("file", "value", _fields(F.col("__head")).alias("__names"), _fields(F.col("value")).alias("__values"))
    fine = F.size("__names") == F.size("__values")
    return both.select("file", F.when(fine, F.map_from_arrays("__names", "__values")).alias("fields"), F.when(~fine, F.col("value")).alias("reject"))


def read_layouts(spark: SparkSession, paths: Sequence[str], drop: str = "Code|Flag|Note|ElementGroup", encoding: str = "ISO-8859-1", rejects: str | None = None) -> DataFrame:
    """CSV files of different layouts as one table of strings, without columns whose names match `drop`.

    Columns are those of all headers, by name. Lines that don't fit their header are left out, or
    kept in the column `rejects`. All files are one scan, however many they are.
    """
    rows = layout_rows(spark, paths, encoding)
    names = [r[0] for r in rows.where("fields IS NOT NULL").select(F.explode(F.map_keys("fields"))).distinct().collect()]  # as many as columns
    columns = [F.element_at("fields", n).alias(n) for n in sorted(names) if not re.search(drop, n)]
    return rows.where("reject IS NULL").select(*columns) if rejects is None else rows.select(*columns, F.col("reject").alias(rejects))


def read_wide_years(spark: SparkSession, path: str, names: Mapping[str, str], countries: Sequence[str], country: str = "Country Name") -> DataFrame:
    """A CSV with a column for each year: chosen columns renamed, chosen countries, one row for each year."""
    df = spark.read.csv(path, header=True)
    years = [c for c in df.columns if re.fullmatch(r"\d{4}", c)]
    picked = df.where(F.col(f"`{country}`").isin(*countries)).select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()], *years)
    return picked.unpivot(list(names.values()), years, "year", "value").withColumns({"year": F.col("year").cast("int"), "value": F.col("value").try_cast("double")}).na.drop(subset=["value"])


def read_adjectives(spark: SparkSession, path: str, adjective: int = 2, response: int = 6) -> DataFrame:
    """Adjectives and responses of a table parted by white space, by column number from 0."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(words, F.lit(adjective)).alias("adjective"), F.get(words, F.lit(response)).try_cast("double").alias("response"))
    return rows.where("adjective IS NOT NULL AND response IS NOT NULL")


def read_concept_map(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """A headerless tab-separated map: concept, source, indicator, score; spaces around and quotes in names go."""
    df = spark.read.csv(path, schema="concept string, source string, indicator string, score double", sep="\t")
    df = df.withColumns({c: F.trim(F.regexp_replace(c, '"', "")) for c in ("concept", "source", "indicator")})
    return df if source is None else df.where(F.col("source") == source)


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_dssat_aggregate(spark: SparkSession, path: str, columns: Sequence[str], crops: Mapping[str, str], name: Column | None = None) -> DataFrame:
    """A crop model's CSV files, whose names (or folders, told by name) are <state>_<crop code>.csv: the columns, state, crop, source."""
    df = spark.read.csv(path, schema=", ".join(f"{c} string" for c in columns), header=True, enforceSchema=True)
    parts = F.split(F.regexp_replace(file_name(), r"\.[^.]*$", "") if name is None else name, "_")
    return df.select(*columns, F.translate(parts[0], "-", " ").alias("state"), F.coalesce(lookup(F.element_at(parts, -1), crops), F.element_at(parts, -1)).alias("crop"), F.lit("DSSAT").alias("source"))


def columns_from_filename(name: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    """For each column, the first group of its pattern in a file name; null where it doesn't match."""
    return {c: F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for c, p in patterns.items()}


def variable_from_filename(name: Column) -> Column:
    """CamelCase file names as words."""
    return camel_words(F.regexp_replace(name, r"\.[^.]*$", ""))


def read_statements_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines whose _source holds a statement."""
    return spark.read.schema(f"_source {schemas.STATEMENT}").json(path).where("_source IS NOT NULL").select("_source.*")


def read_statements_json(spark: SparkSession, path: str, kind: str = "Influence") -> DataFrame:
    """A JSON array of extracted statements, of one type."""
    return spark.read.schema(schemas.EXTRACTED).json(path, multiLine=True).where(F.col("type") == kind)


def groundings(refs: Column, ontology: str) -> Column:
    """The [name, score] pairs of one ontology as array<struct<name, score>>."""
    pairs = F.from_json(F.try_element_at(refs, F.lit(ontology)), "array<array<string>>")
    return F.transform(pairs, lambda p: F.struct(p[0].alias("name"), p[1].try_cast("double").alias("score")))


def read_create_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A model document as statements (model, id, belief, subj, obj, evidence) and observations
    (model, concept, indicator, source, func, resolution, period, ts_ms, value)."""
    doc = spark.read.schema(schemas.MODEL).json(path, multiLine=True)
    statements = doc.select(F.col("id").alias("model"), F.explode("statements").alias("s")).select("model", "s.*")
    series = doc.select(F.col("id").alias("model"), F.explode("conceptIndicators").alias("concept", "i"))
    values = series.select("model", "concept", F.col("i.name").alias("indicator"), "i.source", "i.func", "i.resolution", "i.period", F.explode_outer("i.values").alias("v"))
    return statements, values.select("*", F.col("v.timestamp").alias("ts_ms"), F.col("v.value").alias("value")).drop("v")


def read_constraints(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An experiment document as parameters (start_ms, end_ms, steps) and constraints (concept, step, value).

    Both spellings of the parameters' names are read; constraints with nulls go.
    """
    doc = spark.read.text(path, wholetext=True)  # names that differ by case alone can't share a schema
    inner = F.coalesce(F.get_json_object("value", "$.experimentParam"), F.get_json_object("value", "$.experimentParams"))
    steps = F.coalesce(F.get_json_object("raw", "$.numTimesteps"), F.get_json_object("raw", "$.numTimeSteps"))
    doc = doc.select(F.get_json_object("value", "$.experimentType").alias("experimentType"), inner.alias("raw"))
    doc = doc.select("experimentType", steps.try_cast("int").alias("steps"), F.from_json("raw", schemas.PARAM).alias("p"))
    params = doc.select("experimentType", F.col("p.startTime").alias("start_ms"), F.col("p.endTime").alias("end_ms"), "steps")
    rows = doc.select(F.explode("p.constraints").alias("c")).select("c.concept", F.explode("c.values").alias("v")).select("concept", "v.step", "v.value")
    return params, rows.na.drop()


def read_groundings(spark: SparkSession, path: str, ontology: str) -> DataFrame:
    """Concept names, texts and groundings of all statement files of a glob."""
    df = read_statements_json(spark, path)
    sides = [df.select(F.col(f"{s}.concept.name").alias("name"), F.try_element_at(F.col(f"{s}.concept.db_refs"), F.lit("TEXT")).alias("text"), groundings(F.col(f"{s}.concept.db_refs"), ontology).alias("groundings")) for s in ("subj", "obj")]
    return sides[0].union(sides[1])


def read_timings(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Timing files by name, nanoseconds as milliseconds."""
    df = spark.read.csv(path, schema=schemas.TIMING, header=True, enforceSchema=True, pathGlobFilter=pattern)
    return df.select("run", "nodes", "edges", "kernels", (F.col("wall_ns") / 1e6).alias("wall"), (F.col("cpu_ns") / 1e6).alias("cpu"), "kind")


def element_id(element: Column) -> Column:
    """The name of a link's end: type, source and content."""
    return F.concat_ws("::", element["type"], element["source"], element["content"])


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """A document's link hypotheses: id_1, type_1, id_2, type_2, score."""
    g = spark.read.schema(schemas.LINKS).json(path, multiLine=True).select(F.explode("grounding").alias("g"))
    return g.select(element_id(F.col("g.element_1")).alias("id_1"), F.col("g.element_1.type").alias("type_1"), element_id(F.col("g.element_2")).alias("id_2"), F.col("g.element_2.type").alias("type_2"), "g.score")


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """Edge edits: src, dst, polarity, weight (the first)."""
    r = spark.read.schema(schemas.EDITS).json(path, multiLine=True).select(F.explode("relations").alias("r"))
    return r.select(F.col("r.source").alias("src"), F.col("r.target").alias("dst"), "r.polarity", F.get("r.weights", F.lit(0)).alias("weight"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'source,target'."""
    return spark.read.csv(path, schema="src string, dst string").select(F.trim("src").alias("src"), F.trim("dst").alias("dst"))
