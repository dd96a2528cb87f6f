"""File sources: samples, images, annotations, paired evidence and findings, with rejects recorded instead of raised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.functions.columns import basename, finite

SUFFIXES = "*.{jpg,jpeg,png,bmp,webp,tif,tiff}"
#: Format and inspection level by file extension.
FORMATS = [("onnx", "ONNX", "FULL"), ("pt", "PYTORCH", "HASH_ONLY"), ("pth", "PYTORCH", "HASH_ONLY"), ("h5", "KERAS", "HASH_ONLY"), ("keras", "KERAS", "HASH_ONLY"), ("pb", "TENSORFLOW", "HASH_ONLY"), ("tflite", "TFLITE", "HASH_ONLY"), ("safetensors", "SAFETENSORS", "HASH_ONLY")]


def scan(spark: SparkSession, folder: str, pattern: str = SUFFIXES, max_bytes: int = 1 << 26, most: int | None = None) -> DataFrame:
    """Files below a folder in order of path: (path, length, content) of those within the size cap, the first ``most``.

    Sizes are read from the listing, so the cap is applied before any content is. Spark's listing leaves out files
    without bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    kept = files.where(F.col("length") <= max_bytes).select("path", "length", "content")
    return kept.orderBy("path").limit(most) if most else kept


def identity(files: DataFrame) -> DataFrame:
    """SHA-256, size, format and inspection level of files; empty files are rejected with a code."""
    spark = files.sparkSession
    formats = F.broadcast(spark.createDataFrame(FORMATS, "extension string, format string, inspection string"))
    named = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    return named.join(formats, "extension", "left").select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), F.coalesce("format", F.lit("UNKNOWN")).alias("format"), F.coalesce("inspection", F.lit("HASH_ONLY")).alias("inspection"), F.when(F.col("length") == 0, "EMPTY_FILE").alias("failure_code"))


def images(spark: SparkSession, folder: str, max_bytes: int = 1 << 26, max_pixels: int = 1 << 26) -> DataFrame:
    """Images of a window with a failure code where a file can't be used: hidden files are left out.

    (path, length, failure_code, height, width, channels, mode, data), data in rows of blue, green, red bytes.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).load(folder).select("path", "length")
    listed = listed.where(~basename(F.col("path")).startswith("."))
    decoded = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).load(folder).select("image.*")
    # the two sources write local paths with a different number of slashes
    one = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    joined = listed.withColumn("_at", one("path")).join(decoded.withColumn("_at", one("origin")).drop("origin"), "_at", "left")
    code = F.when(F.col("length") == 0, "EMPTY_FILE").when(F.col("length") > max_bytes, "FILE_TOO_LARGE").when(F.coalesce("width", F.lit(-1)) < 1, "UNDECODABLE").when(F.col("width").cast("long") * F.col("height") > max_pixels, "TOO_MANY_PIXELS").when(~F.col("nChannels").isin(1, 3, 4), "UNSUPPORTED_IMAGE_MODE")
    return joined.select("path", "length", code.alias("failure_code"), "height", "width", F.col("nChannels").alias("channels"), "mode", F.when(code.isNull(), F.col("data")).alias("data"))


_COCO = T.StructType.fromJson(
    {
        "type": "struct",
        "fields": [
            {"name": section, "nullable": True, "metadata": {}, "type": {"type": "array", "containsNull": True, "elementType": {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in fields]}}}
            for section, fields in (
                ("images", (("id", "long"), ("file_name", "string"), ("width", "double"), ("height", "double"))),
                ("categories", (("id", "long"), ("name", "string"))),
                ("annotations", (("id", "long"), ("image_id", "long"), ("category_id", "long"), ("bbox", {"type": "array", "elementType": "double", "containsNull": True}), ("area", "double"), ("iscrowd", "long"))),
            )
        ],
    }
)


def coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections of COCO files as tables: images, categories, annotations."""
    whole = spark.read.schema(_COCO).option("multiLine", True).json(path)
    return {s: whole.select(F.explode(s).alias("r")).select("r.*") for s in ("images", "categories", "annotations")}


def coco_samples(sections: dict[str, DataFrame]) -> DataFrame:
    """A sample per image: its file, its annotations in order of id, and its distinct labels in order."""
    named = sections["annotations"].join(sections["categories"].select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    grouped = named.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "name", "bbox"))).alias("annotations"), F.array_sort(F.collect_set("name")).alias("labels"))
    return sections["images"].select(F.col("id").alias("image_id"), F.col("file_name").alias("sample_id")).join(grouped, "image_id", "left").select("sample_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "annotations")


def yolo_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of label files with the file's stem: (stem, line)."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder).select(stem.alias("stem"), F.col("value").alias("line"))


_FINDING = "finding_id string, module string, asset_type string, asset_id string, category string, severity string, confidence double, reason string, evidence array<string>, recommendation string, limitations array<string>, _corrupt_record string"


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings from JSON lines with ``problem``, the first rule that a row breaks, or null."""
    rows = spark.read.schema(_FINDING).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return finding_problems(rows)


def finding_problems(rows: DataFrame) -> DataFrame:
    """Findings with ``problem``: malformed, blank, out of its range or with too many items."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    problem = F.when(F.col("_corrupt_record").isNotNull(), "MALFORMED") if "_corrupt_record" in rows.columns else F.when(F.lit(False), "MALFORMED")
    for c in ("finding_id", "module", "asset_type", "asset_id", "category", "severity", "reason", "recommendation"):
        problem = problem.when(blank(c), f"BLANK_{c.upper()}")
    problem = (
        problem.when(~F.col("module").isin("dataset_integrity", "model_integrity", "inference_integrity", "distribution_shift"), "UNKNOWN_MODULE")
        .when(~F.col("severity").isin("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"), "UNKNOWN_SEVERITY")
        .when(~F.col("recommendation").isin("ACCEPT", "REVIEW", "QUARANTINE", "REJECT"), "UNKNOWN_RECOMMENDATION")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), "CONFIDENCE_OUT_OF_RANGE")
        .when((F.coalesce(F.size("evidence"), F.lit(0)) < 1) | (F.size("evidence") > 50), "EVIDENCE_COUNT")
        .when(F.size("limitations") > 20, "LIMITATION_COUNT")
    )
    return rows.withColumn("problem", problem)


_PAIR = "descriptor struct<name: string, dimension: int>, reference array<struct<sample_id: string, vec: array<double>>>, current array<struct<sample_id: string, vec: array<double>>>"


def paired_windows(spark: SparkSession, path: str) -> DataFrame:
    """Paired evidence files as rows: (name, role, pos, sample_id, vec)."""
    whole = spark.read.schema(_PAIR).option("multiLine", True).json(path)
    side = lambda c, role: whole.select(F.col("descriptor.name").alias("name"), F.lit(role).alias("role"), F.posexplode(c).alias("pos", "r")).select("name", "role", "pos", "r.*")
    return side("reference", "REFERENCE").union(side("current", "CURRENT"))


def paired_problems(spark: SparkSession, path: str, most: int = 128, dimensions: int = 64) -> DataFrame:
    """Why a paired evidence file can't be used, or null: (file, name, problem), the first rule that it breaks.

    A file has exactly the keys descriptor, reference and current; each window has 1 to ``most`` rows; the dimension
    is 1 to ``dimensions`` and that of every vector; numbers are finite; sample ids are unique in their window.
    """
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = text.withColumn("_keys", F.json_object_keys("value")).withColumn("_p", F.from_json("value", _PAIR))
    sides = [F.col("_p.reference"), F.col("_p.current")]
    size = F.col("_p.descriptor.dimension")
    each = lambda test: test(sides[0]) & test(sides[1])
    fits = lambda side: F.forall(side, lambda r: F.size(r["vec"]).eqNullSafe(size))
    numbers = lambda side: F.forall(side, lambda r: F.forall(r["vec"], finite))
    unique = lambda side: F.size(F.array_distinct(F.transform(side, lambda r: r["sample_id"]))) == F.size(side)
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    problem = (
        F.when(F.col("_keys").isNull(), "MALFORMED")
        .when(F.array_sort("_keys") != F.array(F.lit("current"), F.lit("descriptor"), F.lit("reference")), "WRONG_KEYS")
        .when(no(each(lambda side: F.size(side).between(1, most))), "WINDOW_SIZE")
        .when(no(size.between(1, dimensions)), "DIMENSION_OUT_OF_RANGE")
        .when(no(each(fits)), "DIMENSION_MISMATCH")
        .when(no(each(numbers)), "NOT_FINITE")
        .when(no(each(unique)), "DUPLICATE_SAMPLE_ID")
    )
    return parsed.select("file", F.col("_p.descriptor.name").alias("name"), problem.alias("problem"))
