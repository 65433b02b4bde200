"""Readers of catalogue files: tables, stanzas, records, archives, matrices. Each is a lazy DataFrame over a path or glob.

Keys are trimmed and blank keys dropped where a key is named; a field that can't be read as its type is null.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SCHEMA = "string"


def _typed(c: Column, kind: str) -> Column:
    return c if kind == TEXT_SCHEMA else c.try_cast(kind)


def _tasks(df: DataFrame, tasks: int | None) -> DataFrame:
    """A compressed file is one task's scan; what follows may be spread."""
    return df.repartition(tasks) if tasks else df


def read_tsv(spark: SparkSession, path: str, schema: dict[str, str], key: str | None = None, tasks: int | None = None) -> DataFrame:
    """Named columns of tab-separated files with a header (gzip by its suffix); rows with a blank key are dropped."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    out = raw.select(*[_typed(F.trim(F.col(f"`{c}`")), kind).alias(c) for c, kind in schema.items()])
    if key:
        out = out.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return _tasks(out, tasks)


def read_commented_tsv(spark: SparkSession, path: str, schema: dict[str, str], comment: str = "#") -> DataFrame:
    """Tab-separated lines below a commented preamble: comments, the header, and rows of another width are dropped."""
    names = list(schema)
    cells = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith(comment)).select(cells.alias("cells"))
    lines = lines.filter((F.size("cells") == len(names)) & (F.col("cells")[0] != names[0]))
    return lines.select(*[_typed(F.trim(F.col("cells")[k]), kind).alias(c) for k, (c, kind) in enumerate(schema.items())])


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, is_a, xref, synonym, obsolete) of the [Term] stanzas of OBO files; other stanzas are left out."""

    def values(tag: str, shape: str) -> Column:
        return F.regexp_extract_all("value", F.lit(rf"(?m)^{tag}: *{shape}"), F.lit(1))

    stanzas = spark.read.option("lineSep", "\n\n").text(path).filter(F.ltrim("value", F.lit("\n")).startswith("[Term]"))
    return stanzas.select(
        F.get(values("id", r"(\S+)"), F.lit(0)).alias("id"),
        F.get(values("name", r"(.*)"), F.lit(0)).alias("name"),
        values("is_a", r"(\S+)").alias("is_a"),
        values("xref", r"(\S+)").alias("xref"),
        values("synonym", r'"((?:[^"\\]|\\.)*)"').alias("synonym"),
        F.col("value").rlike(r"(?m)^is_obsolete: *true").alias("obsolete"),
    ).filter("id IS NOT NULL")


def read_xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row for each element of the tag; repeated children are arrays to explode."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_archive_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, member, content) of the members of zip and tar archives whose names match; an archive is one task's."""

    def members(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for x in z.namelist():
                    if re.search(pattern, x) and not x.endswith("/"):
                        yield x, z.read(x)
        else:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                for x in t:
                    if x.isfile() and re.search(pattern, x.name):
                        yield x.name, t.extractfile(x).read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path"), batch.column("content"), strict=True):
                for member, content in members(path.as_py(), raw.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([member]), pa.array([content], pa.binary())], ["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def read_archive_tsv(spark: SparkSession, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """Named columns of tab-separated members with a header line."""
    lines = F.filter(F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\r", ""), "\n"), lambda x: x != "")
    rows = read_archive_members(spark, path, pattern).select("member", F.get(lines, F.lit(0)).alias("head"), F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    head, cells = F.split("head", "\t"), F.split("line", "\t")
    return rows.select("member", *[F.get(cells, (F.array_position(head, F.lit(c)) - 1).cast("int")).alias(c) for c in columns])


def read_archive_json(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    """(member, doc): the JSON documents in the members of archives, as structs of the schema."""
    return read_archive_members(spark, path, pattern).select("member", F.from_json(F.decode("content", "UTF-8"), schema).alias("doc"))


def read_json_arrays(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """One row for each element of JSON arrays, one array a line, or a file where `whole`."""
    return spark.read.text(path, wholetext=whole).select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("x")).select("x.*")


def read_wide_matrix(spark: SparkSession, path: str, ident: str, most: int | None = None, sign: float = -1.0) -> DataFrame:
    """(row_id, symbol, value) of a wide matrix whose columns are named 'SYMBOL (ID)'; values times `sign`, no nulls."""
    wide = spark.read.csv(path, header=True)
    wide = wide.limit(most) if most else wide
    named = [(c, re.sub(r" \([^()]*\)$", "", c)) for c in wide.columns if c != ident]
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), F.col(f"`{c}`").try_cast("double").alias("value")) for c, s in named])).alias("x")
    return wide.select(F.col(f"`{ident}`").alias("row_id"), cells).select("row_id", "x.symbol", (F.col("x.value") * sign).alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")


def read_symbols(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(symbol): the distinct symbols of a list of 'SYMBOL (ID)' lines below a header line."""
    return spark.read.text(path).filter(F.trim("value") != header).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("symbol")).filter("symbol <> ''").distinct()


def read_panel(spark: SparkSession, path: str, ident: str, drugs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mutations (row_id, mutation) and folds (row_id, drug, log_fold) of a wide panel of positions P1.. and drugs.

    A mutation is its position and amino acid; '-', '.' and blanks are none. Folds are positive; rows without any go.
    """
    wide = spark.read.csv(path, header=True)
    folds = F.array(*[F.struct(F.lit(d).alias("drug"), F.col(f"`{d}`").try_cast("double").alias("fold")) for d in drugs])
    wide = wide.withColumn("folds", F.filter(folds, lambda x: x["fold"] > 0)).filter(F.size("folds") > 0)
    places = [c for c in wide.columns if re.fullmatch(r"P\d+", c)]
    cells = F.filter(F.array(*[F.struct(F.lit(c[1:]).alias("place"), F.trim(F.col(c)).alias("acid")) for c in places]), lambda x: x["acid"].rlike("^[A-Za-z*]+$"))
    mutations = wide.select(F.col(ident).alias("row_id"), F.explode(F.transform(cells, lambda x: F.concat(x["place"], x["acid"]))).alias("mutation"))
    return mutations, wide.select(F.col(ident).alias("row_id"), F.explode("folds").alias("x")).select("row_id", "x.drug", F.log10("x.fold").alias("log_fold"))


def read_vectors(spark: SparkSession, path: str, ident: str, prefix: str = "z_") -> DataFrame:
    """(row_id, vector): all columns of the prefix in file order; what isn't a number is 0."""
    wide = spark.read.csv(path, header=True)
    cells = [F.coalesce(F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)), F.lit(0.0)) for c in wide.columns if c.startswith(prefix)]
    return wide.select(F.col(f"`{ident}`").alias("row_id"), F.array(*cells).alias("vector"))


def typed_features(text: Column, kinds: list[str]) -> Column:
    """array<struct<kind, start, end, note>> of 'KIND 12..45; /note="x"' features in a text cell, in order of place."""
    shape = rf"\b({'|'.join(kinds)}) <?(\d+)(?:\.\.>?(\d+))?;?(?: */note=\"([^\"]*)\")?"
    parts = [F.regexp_extract_all(text, F.lit(shape), F.lit(k)) for k in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("kind", "start", "end", "note"), strict=True)])
    return F.transform(zipped, lambda x: F.struct(x["kind"].alias("kind"), x["start"].cast("int").alias("start"), F.when(x["end"] != "", x["end"]).otherwise(x["start"]).cast("int").alias("end"), F.nullif(x["note"], F.lit("")).alias("note")))


def read_bom_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header whose first name may carry a byte order mark."""
    raw = spark.read.csv(path, header=True)
    return raw.toDF(*[c.lstrip("﻿").removeprefix("ï»¿") for c in raw.columns])
