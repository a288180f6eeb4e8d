"""Files as documents: discovery, frontmatter, and versioned tables behind a pointer."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KNOWN = {"title": "string", "category": "string", "tags": "array<string>", "observed_at": "string", "confidence": "double", "source": "string", "related_to": "array<string>"}
_SUFFIXES = "txt md markdown rst log srt vtt py ipynb js ts tsx jsx go rs rb php java kt swift c cc cpp h hpp cs scala sh bash zsh sql html css scss vue json jsonl yaml yml toml csv tsv xml".split()


def read_files(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """path, modified, text of every supported file below a folder. Hidden and underscore names, `_processed/` and excluded substrings are
    left out; bytes that aren't UTF-8 become U+FFFD."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = found.where(~name.rlike(r"^[._]") & ~F.col("path").contains("/_processed/") & F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(_SUFFIXES))
    for x in exclude or []:
        found = found.where(~F.col("path").contains(x))

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return found.select("path", F.col("modificationTime").alias("modified"), text("content").alias("text"))


def stale(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources (path, modified) that no cached result is as new as."""
    fresh = cache.select("path", F.col("modified").alias("__m"))
    return sources.join(fresh, (sources["path"] == fresh["path"]) & (fresh["__m"] >= sources["modified"]), "left_anti")


def with_frontmatter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds title, category, tags, observed_at, confidence, source, related_to, attributes (JSON of other keys) from a leading YAML block, which the text
    loses. Without a block, or where it is malformed or no mapping, columns are null and the text stays."""
    schema = ", ".join([f"{k} {v}" for k, v in _KNOWN.items()] + ["attributes string", "body string"])

    def parse(text: str | None) -> tuple:
        none = (*[None] * (len(_KNOWN) + 1), text)
        if not text or not text.startswith("---"):
            return none
        head, mark, body = text[3:].lstrip(" \t").removeprefix("\n").partition("\n---")
        if not mark:
            return none
        try:
            import yaml

            found = yaml.load(head, Loader=yaml.BaseLoader)
        except ImportError:
            raise
        except Exception:  # noqa: BLE001 - malformed YAML leaves the text as it is
            return (*none[:-1], body.partition("\n")[2])
        if not isinstance(found, dict):
            return (*none[:-1], body.partition("\n")[2])
        out = [found.pop(k, None) for k in _KNOWN]
        for k, name in enumerate(_KNOWN):
            if _KNOWN[name] == "array<string>" and out[k] is not None:
                out[k] = [str(x) for x in out[k]] if isinstance(out[k], list) else [x.strip() for x in str(out[k]).split(",") if x.strip()]
        try:
            out[4] = None if out[4] is None else float(out[4])
        except (TypeError, ValueError):
            out[4] = None
        return (*out, json.dumps(found, sort_keys=True) if found else None, body.partition("\n")[2])

    @F.pandas_udf(schema)
    def split(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in text], columns=[*_KNOWN, "attributes", "body"])

    return docs.withColumn("__f", split(text_col)).select(*[c for c in docs.columns if c != text_col], *[F.col(f"__f.{k}").alias(k) for k in [*_KNOWN, "attributes"]], F.col("__f.body").alias(text_col))


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(tables: dict[str, DataFrame], root: str, run: str) -> None:
    """Write all tables as a new version below root/runs/run, then point `current` at it. Readers of older versions go on undisturbed."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{root}/runs/{run}/{name}.parquet")
    jvm, new, fs = _filesystem(spark, f"{root}/_current.{run}")
    out = fs.create(new, True)
    out.write(bytearray(run.encode()))
    out.close()
    # an overwriting rename is one step: a reader sees the old pointer or the new one
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/current"), options)


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the version that `current` points at; without a pointer, of the flat folder."""
    _, at, fs = _filesystem(spark, f"{root}/current")
    if not fs.exists(at):
        return spark.read.parquet(f"{root}/{table}.parquet")
    run = spark.read.text(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/runs/{run}/{table}.parquet")


def read_questions(spark: SparkSession, path: str, ids: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """id, category, question, answer of a benchmark's JSON file: a list of questions, or an object that has one as `questions`."""
    raw = spark.read.text(path, wholetext=True)
    kind = "array<struct<id: string, category: string, question: string, answer: string>>"
    body = F.coalesce(F.get_json_object("value", "$.questions"), F.col("value"))
    found = raw.select(F.explode(F.from_json(body, kind)).alias("q")).select("q.*")
    if ids is not None:
        found = found.where(F.col("id").isin(ids))
    return found if categories is None else found.where(F.col("category").isin(categories))


def read_sqlite(spark: SparkSession, paths: list[str], query: str, schema: str) -> DataFrame:
    """Rows of a query over SQLite files that all executors reach by path, one task per file, in batches."""
    import sqlite3

    names = [x.split(":")[0].strip().strip("`") if ":" in x else x.split()[0] for x in schema.split(",")]

    def run(parts):
        for part in parts:
            for p in part["path"]:
                connection = sqlite3.connect(f"file:{p}?mode=ro", uri=True)
                try:
                    cursor = connection.execute(query)
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)
                finally:
                    connection.close()

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, schema)


def zip_folder(folder: str, archive: str) -> list[str]:
    """Packs the files below a local folder; returns their names."""
    import zipfile
    from pathlib import Path

    names = sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(Path(folder) / n, n)
    return names


def list_zip(archive: str) -> list[str]:
    import zipfile

    with zipfile.ZipFile(archive) as z:
        return sorted(n for n in z.namelist() if not n.endswith("/"))


def unzip(archive: str, folder: str) -> list[str]:
    """Unpacks below a local folder; an archive with a name that leads out of it is refused as a whole."""
    import zipfile

    names = list_zip(archive)
    for n in names:
        checked_path(folder, n)
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder, names)
    return names


def checked_path(root: str, name: str) -> str:
    """root/name, where that stays below root; an error else."""
    from pathlib import PurePosixPath

    parts = PurePosixPath(name.replace("\\", "/")).parts
    if not parts or name.startswith("/") or ".." in parts or ":" in parts[0]:
        raise ValueError(f"{name!r} leads out of the folder")
    return f"{root.rstrip('/')}/{'/'.join(parts)}"
