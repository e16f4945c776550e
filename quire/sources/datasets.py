"""Manifests, label files and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import lexicon as L

MANIFEST = "file_path string, image_path string, path string, document_type string, text string, fields map<string,string>"
DOCUMENT = "doc_id long, pages array<struct<dimensions: struct<height: double, width: double>, blocks: array<struct<lines: array<struct<geometry: struct<x1: double, y1: double, x2: double, y2: double>, words: array<struct<value: string, confidence: double, geometry: struct<x1: double, y1: double, x2: double, y2: double>>>>>>>>>"
UPLOADS, ENGINE_FILES = (".jpg", ".jpeg", ".png", ".pdf"), (".pdf", ".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")


def manifest(spark: SparkSession, path: str, *, max_documents: int = 0) -> DataFrame:
    """Rows of a JSON-lines manifest, blank lines skipped; a malformed line fails the read (``malformed`` tells which).

    ``max_documents``: only the first rows in the order of the file.
    """
    rows = spark.read.schema(MANIFEST).json(path, mode="FAILFAST").withColumn("source_path", F.coalesce("file_path", "image_path", "path"))
    if max_documents <= 0:
        return rows
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_row", F.monotonically_increasing_id())
    return placed.orderBy("_file", "_start", "_row").limit(max_documents).drop("_file", "_start", "_row")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of a manifest's lines that aren't JSON objects; lines count from 1, blank ones too."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_row", F.monotonically_increasing_id())
    order = Window.partitionBy("file").orderBy("_start", "_row")
    numbered = text.withColumn("line", F.row_number().over(order))
    bad = F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")
    return numbered.filter((F.trim("value") != "") & bad).select("file", "line", F.col("value").alias("text"))


def labelled_images(spark: SparkSession, labels: str, folders: list[str]) -> DataFrame:
    """(number, image, xmin, ymin, xmax, ymax, label) of the label files gt_<number>.txt below a folder.

    A file's image is im<number>.jpg of four digits in the first of ``folders`` that has it; files without one are left out.
    """
    lines = spark.read.text(labels, pathGlobFilter="gt_*.txt").select("value", F.regexp_extract("_metadata.file_name", r"^gt_\s*(\d+)\s*\.txt$", 1).try_cast("int").alias("number"))
    found = None
    for rank, folder in enumerate(folders):
        some = spark.read.format("binaryFile").option("pathGlobFilter", "im*.jpg").load(folder).select(F.lit(rank).alias("rank"), F.col("path").alias("image"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
        found = some if found is None else found.unionByName(some)
    best = found.groupBy("name").agg(F.min_by("image", "rank").alias("image"))
    named = lines.filter("number IS NOT NULL").withColumn("name", F.format_string("im%04d.jpg", F.col("number")))
    return label_boxes(named.join(best, "name").drop("name")).drop("value")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Recognised documents as JSON lines in the nested form."""
    return spark.read.schema(DOCUMENT).json(path)


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = UPLOADS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) binary files below a folder."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ok = F.lower(F.col("path")).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return every.filter(ok), every.filter(~ok).select("path", "length")


def data_uri(content: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def split(rows: DataFrame, key: str, train: int = 8, val: int = 1) -> DataFrame:
    """Adds split: tenths of the key's hash, so a row's part never changes."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10
    return rows.withColumn("split", F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test"))


def valid_label(label: Column) -> Column:
    return (F.coalesce(label, F.lit("")) != "") & (label != "###") & label.rlike("[a-zA-Z0-9À-ỹ]")


def clean_label(label: Column) -> Column:
    """Look-alike letters replaced, characters outside the vocabulary dropped."""
    kept = "".join("\\" + c if c in "\\]^-[&" else c for c in L.VOCABULARY)
    return F.trim(F.regexp_replace(F.translate(label, "сао", "cao"), f"[^{kept}]", ""))


def label_boxes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Boxes and labels from lines of eight numbers and a text, bad and empty ones left out."""
    p = F.split(F.trim(F.col(value)), ",", 9)
    n = lambda i: F.get("p", F.lit(i)).try_cast("double").cast("int")
    xs, ys = [n(0), n(2), n(4), n(6)], [n(1), n(3), n(5), n(7)]
    zero = F.lit(0)
    out = lines.withColumn("p", p).filter(F.size("p") == 9)
    full = sum((x.isNull().cast("int") for x in xs + ys), F.lit(0)) == 0
    out = out.filter(full).withColumns({"xmin": F.greatest(zero, F.least(*xs)), "ymin": F.greatest(zero, F.least(*ys)), "xmax": F.greatest(zero, *xs), "ymax": F.greatest(zero, *ys), "raw": F.trim(F.get("p", F.lit(8)))})
    return out.filter(valid_label(F.col("raw")) & (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin"))).withColumn("label", clean_label(F.col("raw"))).drop("p", "raw")


def write_split(rows: DataFrame, path: str, *, name: str | None = None, label: str = "label", content: str = "content") -> None:
    """Rows by split as JSON.  With ``name``: labels as (name, label) rows below labels/, and the images' bytes, if the rows
    have them, as (name, content) rows below images/, both by split; a name's last label in order counts, as in a map."""
    if name is None:
        rows.write.mode("overwrite").partitionBy("split").json(path)
        return
    rows.groupBy("split", F.col(name).alias("name")).agg(F.max(label).alias("label")).write.mode("overwrite").partitionBy("split").json(f"{path}/labels")
    if content in rows.columns:
        rows.select("split", F.col(name).alias("name"), F.col(content).alias("content")).dropDuplicates(["split", "name"]).write.mode("overwrite").partitionBy("split").parquet(f"{path}/images")


def label_map(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One row, one map of a split's names to labels, for readers that want a single JSON object."""
    rows = spark.read.json(f"{path}/labels/split={part}")
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "label")))).alias("labels"))


def page_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with the image of the same document and number; pages and images without a partner are left out."""
    return pages.join(images, ["doc_id", "page"])
