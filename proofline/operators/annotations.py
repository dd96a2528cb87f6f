"""Annotation checks: references, boxes and label lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions.columns import finite


#: Rows of one task, and the shares into which the rows of one id are dealt before they are counted.
ROWS, SHARES = 500_000, 16


def _counted(given: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(id, given, used): how often each id occurs in either table, null being an id like any other.

    The tasks grow in number with the rows, so what one holds stays level. An id of any frequency is dealt to
    ``SHARES`` tasks by the rest of its row first, and their counts are added.
    """
    share = lambda df: F.pmod(F.xxhash64(*df.columns), F.lit(SHARES)).alias("share")
    rows = given.select("id", F.lit(1).alias("given"), F.lit(0).alias("used"), share(given))
    if used is not None:
        rows = rows.union(used.select("ref", F.lit(0), F.lit(1), share(used)))
    n = given.count() + (used.count() if used is not None else 0)
    total = [F.sum(c).alias(c) for c in ("given", "used")]
    if n <= 8 * ROWS:
        return rows.groupBy("id").agg(*total)
    tasks = max(n // ROWS + 1, int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "id", "share").groupBy("id", "share").agg(*total).repartition(tasks, "id").groupBy("id").agg(*total)


def reference_violations(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """Duplicate ids by section, and annotations whose image or category does not exist: (violation, subject, n)."""
    found = []
    for name, given, used in (("IMAGE", images, "image_id"), ("CATEGORY", categories, "category_id"), ("ANNOTATION", annotations, None)):
        counts = _counted(given, annotations.select(F.col(used).alias("ref"), "id") if used else None)
        twice = F.when(F.col("given") > 1, F.struct(F.lit(f"DUPLICATE_{name}_ID").alias("violation"), F.col("given").alias("n")))
        # a reference that is null names nothing, whatever ids there are
        orphan = F.when((F.col("used") > 0) & ((F.col("given") == 0) | F.col("id").isNull()), F.struct(F.lit(f"ORPHAN_{name}").alias("violation"), F.col("used").alias("n")))
        rows = counts.select(F.col("id").cast("string").alias("subject"), F.explode(F.array_compact(F.array(twice, orphan))).alias("v"))
        found.append(rows.select("v.violation", "subject", "v.n"))
    return found[0].union(found[1]).union(found[2])


def box_violations(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations whose box is malformed, empty, or leaves its image; ``images``: (id, width, height)."""
    b = F.col("bbox")
    at = lambda i: F.get(b, F.lit(i))
    joined = annotations.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id", "left")
    problem = (
        F.when(b.isNull() | (F.size(b) != 4) | F.exists(b, lambda x: ~finite(x)), "BOX_MALFORMED")
        .when((at(2) <= 0) | (at(3) <= 0), "BOX_EMPTY")
        .when((at(0) < 0) | (at(1) < 0) | (at(0) + at(2) > F.col("width")) | (at(1) + at(3) > F.col("height")), "BOX_OUTSIDE_IMAGE")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select("id", "problem")


def parse_label_lines(lines: DataFrame, n_classes: int, line: str = "line") -> DataFrame:
    """Lines ``class xc yc w h`` as columns, with the first problem of each; blank lines are left out."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    box = F.transform(F.slice("parts", 2, 4), lambda x: x.try_cast("double"))
    split = lines.where(F.length(F.trim(line)) > 0).withColumn("parts", parts).withColumn("class_id", F.get("parts", F.lit(0)).try_cast("int")).withColumn("bbox", box)
    problem = (
        F.when(F.size("parts") != 5, "TOKEN_COUNT")
        .when(F.col("class_id").isNull() | F.exists("bbox", lambda x: x.isNull() | F.isnan(x)), "NOT_NUMERIC")
        .when((F.col("class_id") < 0) | (F.col("class_id") >= n_classes), "CLASS_OUT_OF_RANGE")
        .when(F.exists("bbox", lambda x: (x < 0) | (x > 1)), "BOX_OUTSIDE_UNIT")
    )
    return split.withColumn("problem", problem).drop("parts")


def pairing_violations(images: DataFrame, labels: DataFrame, require_labels: bool = True) -> DataFrame:
    """Files by stem: duplicates on either side, labels without an image, and images without labels: (violation, stem)."""
    twice = lambda df, name: df.groupBy("stem").count().where("count > 1").select(F.lit(f"DUPLICATE_{name}_STEM").alias("violation"), "stem")
    found = twice(images, "IMAGE").union(twice(labels, "LABEL")).union(labels.join(images, "stem", "left_anti").select(F.lit("ORPHAN_LABEL").alias("violation"), "stem"))
    return found.union(images.join(labels, "stem", "left_anti").select(F.lit("MISSING_LABEL").alias("violation"), "stem")) if require_labels else found
