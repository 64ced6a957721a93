"""Readers of entity trees, triples, tables of geometries, splits, captions and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rdf
from ..operators.spatial import river_wkt

HREF = "STRUCT<rel: STRING, href: STRING>"
ENTITY = "id STRING, properties MAP<STRING, STRING>, geometry STRING"
PRODUCT = f"{ENTITY}, assets MAP<STRING, STRUCT<href: STRING>>, links ARRAY<{HREF}>"
SEA = "features ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRING>>"
ANNOTATION = "STRUCT<annotations: ARRAY<STRUCT<geometry: STRUCT<coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>>>>"
SENTENCE = (
    "STRUCT<image_id: INT, sentence_id: INT, raw: STRING, tokens: ARRAY<STRING>, aug_rb: STRING, "
    "aug_bt_prob: STRING, aug_bt_chain: STRING>"
)
CAPTIONS = (
    f"images ARRAY<STRUCT<filename: STRING, classcode: INT, sentences: ARRAY<{SENTENCE}>, sentids: ARRAY<INT>>>, "
    "classes MAP<STRING, STRING>"
)


def _documents(spark, path, schema):
    full = f"{schema}, _corrupt STRING"
    reader = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path)


def json_documents(spark, path, schema) -> DataFrame:
    """One document per file; ``malformed_documents`` tells which files are passed over."""
    return _documents(spark, path, schema).filter(F.col("_corrupt").isNull()).drop("_corrupt")


def malformed_documents(spark, path, schema=ENTITY) -> DataFrame:
    """``(file, text)`` of the files that hold no document of the schema."""
    docs = _documents(spark, path, schema).withColumn("file", F.col("_metadata.file_path"))
    # Spark reads the corrupt text only along with another column
    other = F.col(next(c for c in docs.columns if c not in ("_corrupt", "file"))).cast("string")
    return docs.filter(F.col("_corrupt").isNotNull()).select("file", F.coalesce("_corrupt", other).alias("text"))


def entity_documents(spark, root) -> DataFrame:
    """Entity files one folder below ``root``; files at the root itself are not read."""
    return json_documents(spark, f"{root}/*/*", ENTITY).withColumn("wkt", G.geojson_to_wkt(F.col("geometry")))


def river_documents(spark, root) -> DataFrame:
    """River files one folder below ``root``: the lines of each merged to a multipolygon of no width."""
    return json_documents(spark, f"{root}/*/*", ENTITY).withColumn("wkt", river_wkt(F.col("geometry")))


def product_documents(spark, root) -> DataFrame:
    """Product files in the tree ``root/a/b/c/file``."""
    return json_documents(spark, f"{root}/*/*/*/*", PRODUCT).withColumn("wkt", G.geojson_to_wkt(F.col("geometry")))


def feature_collection(spark, path) -> DataFrame:
    """Features of GeoJSON collections: ``id``, ``properties``, ``wkt``."""
    features = json_documents(spark, path, SEA).select(F.explode("features").alias("f"))
    return features.select(
        F.col("f.properties")["ID"].alias("id"),
        F.col("f.properties").alias("properties"),
        G.geojson_to_wkt(F.col("f.geometry")).alias("wkt"),
    )


def text_lines(spark, paths) -> DataFrame:
    """Lines with their place: file, byte offset of the split, position inside the split."""
    lines = spark.read.text(paths)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def ntriples(spark, paths, keep_corrupt=False) -> DataFrame:
    """``s, p, o`` of N-Triples files (plain or gzip); lines that do not parse land in ``_corrupt``."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    term = {n: F.regexp_extract("value", rdf.TRIPLE_LINE, i) for i, n in enumerate("spo", 1)}
    parsed = lines.select(
        *[F.nullif(term[n], F.lit("")).alias(n) for n in "spo"],
        F.when(term["s"] == "", F.col("value")).alias("_corrupt"),
    )
    return parsed if keep_corrupt else parsed.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def ordered_ntriples(spark, paths) -> DataFrame:
    """Triples with ``ord STRUCT<file, split, position>``, comparable in file order."""
    lines = text_lines(spark, paths)
    term = {n: F.regexp_extract("value", rdf.TRIPLE_LINE, i) for i, n in enumerate("spo", 1)}
    return lines.select(
        *[F.nullif(term[n], F.lit("")).alias(n) for n in "spo"], F.struct("file_path", "file_block", "line_no").alias("ord")
    ).filter(F.col("s").isNotNull())


def malformed_lines(spark, paths) -> DataFrame:
    """The lines of N-Triples files that are no triple."""
    return ntriples(spark, paths, keep_corrupt=True).filter(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("value"))


def graph_bundles(spark, paths) -> DataFrame:
    """The published graph: all bundles in one scan, gzip included."""
    return ntriples(spark, list(paths))


def geometry_tsv(spark, path, header="WKT\tEntity") -> DataFrame:
    """``WKT, Entity`` and the line place; only the first tab of a line separates."""
    lines = text_lines(spark, path).filter(F.col("value") != header)
    parts = F.split("value", "\t", 2)
    return lines.select(
        parts[0].alias("WKT"), F.get(parts, F.lit(1)).alias("Entity"), "file_path", "file_block", "line_no"
    )


def line_set(spark, path) -> DataFrame:
    return spark.read.text(path).distinct()


def split_lists(spark, root, split=None) -> DataFrame:
    """Headerless patch lists ``train.csv``, ``val.csv``, ``test.csv``; ``split=None`` unites all three."""
    names = ["train", "val", "test"] if split is None else [split]
    rows = spark.read.schema("patch STRING").csv([f"{root}/{n}.csv" for n in names])
    return rows.withColumn("split", F.regexp_extract("_metadata.file_path", r"([^/]+)\.csv(?:/[^/]*)?$", 1))


def patch_list(spark, path, key) -> DataFrame:
    """Patch names of JSON documents ``{key: [...]}``."""
    return json_documents(spark, path, f"`{key}` ARRAY<STRING>").select(F.explode(key).alias("patch"))


def annotations(spark, path) -> DataFrame:
    """Annotation map ``{patch: {annotations: [...]}}`` → one row per patch with its box rings."""
    docs = spark.read.text(path, wholetext=True)
    entries = docs.select(F.explode(F.from_json("value", f"MAP<STRING, {ANNOTATION}>")).alias("patch", "a"))
    boxes = F.transform("a.annotations", lambda x: F.transform(x["geometry"]["coordinates"][0], lambda c: G.point(c[0], c[1])))
    return entries.select("patch", boxes.alias("boxes"))


def caption_dataset(spark, path) -> DataFrame:
    """One row per image: file name, class code, sentences; augmented fields may be null."""
    images = json_documents(spark, path, CAPTIONS).select(F.explode("images").alias("i"))
    return images.select("i.filename", "i.classcode", "i.sentences")


def sentences(images: DataFrame) -> DataFrame:
    """One row per sentence of ``caption_dataset``."""
    return images.select("filename", "classcode", F.explode("sentences").alias("s")).select("filename", "classcode", "s.*")


def requests(spark, path) -> DataFrame:
    """Labelled requests; a missing request is ``''``, a missing category ``'None'``."""
    rows = spark.read.schema("request STRING, category STRING").option("multiLine", True).json(path)
    return rows.select(
        F.coalesce("request", F.lit("")).alias("request"), F.coalesce("category", F.lit("None")).alias("category")
    )


def embeddings(spark, path, normalise=False) -> DataFrame:
    """``(id, embedding ARRAY<FLOAT>)``."""
    from ..functions.arrays import l2_normalise

    df = spark.read.parquet(path)
    if normalise:
        df = df.withColumn("embedding", l2_normalise(F.col("embedding").cast("array<double>")).cast("array<float>"))
    return df


def fetch(patches: DataFrame, keys: DataFrame, key) -> DataFrame:
    """Rows of the asked keys; an unknown key is an error."""
    found = keys.join(patches.withColumn("_found", F.lit(True)), key, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string")))
    return found.withColumn("_found", F.when(F.col("_found"), True).otherwise(unknown)).filter("_found").drop("_found")


def classification_results(spark, path) -> DataFrame:
    """Request results with both category columns as text."""
    df = spark.read.parquet(path)
    return df.select(
        "request", F.col("expected_category").cast("string"), F.col("detected_category").cast("string"), "request_exists"
    )


def line_segments(spark, path) -> DataFrame:
    """Coast lines given as WKT text lines → segments ``(line, seg, ax, ay, bx, by)``."""
    return segments(spark.read.text(path).select(F.col("value").alias("line"), G.parse_wkt(F.col("value"))[0].alias("points")))


def segments(lines: DataFrame) -> DataFrame:
    """Segments of ``(line, points)`` rows."""
    ends = F.zip_with(
        F.slice("points", 1, F.size("points") - 1),
        F.slice("points", 2, F.size("points") - 1),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
    )
    return lines.select("line", F.posexplode(ends).alias("seg", "e")).select("line", "seg", "e.*")
