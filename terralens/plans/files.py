"""Sources and sinks: tables are written in an input layout to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import geometry as G
from ..functions import rdf
from ..operators import dedup as D
from ..operators import labels as L
from ..operators import numbering as N
from ..operators import requests as Q
from ..operators import triples as T
from ..session import scratch_dir
from ..sources import readers as R
from ..sources import writers as W
from . import dialogue, graph, media, space, vectors
from .common import Catalogue, rounded, table

CAT = Catalogue()
#: Files of one row that a task writes.
FILES = 200
#: Patches of an annotation map, and maps that a task writes.
PATCHES, MAPS = 1000, 20


def spread(rows):
    """``rows`` over as many tasks as their files need: a small table is read by one, which would write every file alone."""
    return rows.repartition(N.bucket_count(rows, FILES))


def folder(spark, key):
    return scratch_dir(spark, key)


def geojson_point(key):
    x, y = graph.xy(key)
    return F.struct(F.lit("Point").alias("type"), F.array(x.cast("double"), y.cast("double")).alias("coordinates"))


def port_documents(spark, sf):
    p = graph.entities(spark, sf, "port")
    key = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    return p.withColumn("k", key).withColumn("geometry", geojson_point("k")).drop("k", "wkt")


SQL_PORT = f"SELECT 'port_' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '\"harbour\"' END AS seamark, {graph.SQL_POINT.format(k='s_suppkey')} AS wkt FROM supplier"


def port_columns(df):
    return df.select("id", F.col("properties")["name"].alias("name"), F.col("properties")["seamark:type"].alias("seamark"), "wkt")


@CAT.add("src_01", SQL_PORT)
def src_01(spark, sf):
    """Entity files one folder down; a file at the root is not read."""
    root = folder(spark, "src_01")
    docs = port_documents(spark, sf)
    spread(docs).write.option("maxRecordsPerFile", 1).json(f"{root}/ports")
    return port_columns(R.entity_documents(spark, root))


@CAT.add(
    "src_02",
    """SELECT 's_' || s_suppkey AS id, s_name AS platform, CASE WHEN s_suppkey % 2 = 0 THEN 'http://t/' || s_suppkey END AS thumb FROM supplier""",
)
def src_02(spark, sf):
    """Product files four folders down."""
    root = folder(spark, "src_02")
    s = table(spark, sf, "supplier")
    href = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("http://t/"), F.col("s_suppkey").cast("string")))
    docs = s.select(
        F.concat(F.lit("s_"), F.col("s_suppkey").cast("string")).alias("id"),
        F.create_map(F.lit("platform"), F.col("s_name")).alias("properties"),
        F.array(F.struct(F.lit("thumbnail").alias("rel"), href.alias("href"))).alias("links"),
        (F.col("s_nationkey") % 3).alias("y"),
        (F.col("s_nationkey") % 4).alias("m"),
        F.col("s_nationkey").alias("d"),
    )
    spread(docs).write.option("maxRecordsPerFile", 1).partitionBy("y", "m", "d").json(root)
    read = R.product_documents(spark, root)
    return read.select("id", F.col("properties")["platform"].alias("platform"), F.col("links")[0]["href"].alias("thumb"))


@CAT.add(
    "src_03",
    f"SELECT c_custkey::VARCHAR AS id, c_name AS name, c_custkey + 1000 AS mrgid, {graph.SQL_POINT.format(k='c_custkey')} AS wkt FROM customer",
)
def src_03(spark, sf):
    """Features of GeoJSON collections, one collection file per hundred customers."""
    root = folder(spark, "src_03")
    props = F.create_map(
        F.lit("ID"), F.col("c_custkey").cast("string"), F.lit("MRGID"), (F.col("c_custkey") + 1000).cast("string"), F.lit("NAME"), F.col("c_name")
    )
    feature = F.struct(props.alias("properties"), geojson_point("c_custkey").alias("geometry"))
    docs = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("part")).agg(F.collect_list(feature).alias("features"))
    docs.drop("part").write.option("maxRecordsPerFile", 1).json(root)
    read = R.feature_collection(spark, root)
    return read.select("id", F.col("properties")["NAME"].alias("name"), F.col("properties")["MRGID"].cast("bigint").alias("mrgid"), "wkt")


@CAT.add("src_04", graph.star_sql())
def src_04(spark, sf):
    """N-Triples scan."""
    path = folder(spark, "src_04")
    W.write_ntriples(graph.star(spark, sf), path)
    return R.ntriples(spark, path)


@CAT.add(
    "src_05",
    f"""SELECT '"' || {graph.SQL_POINT.format(k='c_custkey')} || '"' AS "WKT", '<r/c' || c_custkey || '>' || CASE WHEN c_custkey % 5 = 0 THEN chr(9) || 'extra' ELSE '' END AS "Entity" FROM customer""",
)
def src_05(spark, sf):
    """Two-column TSV, split at the first tab only."""
    path = folder(spark, "src_05")
    c = table(spark, sf, "customer")
    extra = F.when(F.col("c_custkey") % 5 == 0, F.lit("\textra")).otherwise(F.lit(""))
    line = F.concat(F.lit('"'), graph.point_wkt("c_custkey"), F.lit('"\t'), rdf.iri("r/c", F.col("c_custkey")), extra)
    c.select(line.alias("value")).unionByName(spark.createDataFrame([("WKT\tEntity",)], "value string")).write.text(path)
    return R.geometry_tsv(spark, path).select("WKT", "Entity")


@CAT.add("src_06", "SELECT DISTINCT '<r/c' || o_custkey || '>' AS value FROM orders")
def src_06(spark, sf):
    """Line list as a set."""
    path = folder(spark, "src_06")
    table(spark, sf, "orders").select(rdf.iri("r/c", F.col("o_custkey")).alias("value")).write.text(path)
    return R.line_set(spark, path)


@CAT.add("src_07", "SELECT 'p_' || o_orderkey AS patch, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders")
def src_07(spark, sf):
    """Headerless split lists, all three united."""
    root = folder(spark, "src_07")
    o = table(spark, sf, "orders").select(F.concat(F.lit("p_"), F.col("o_orderkey").cast("string")).alias("patch"), "o_orderstatus")
    for status, name in (("F", "train"), ("O", "val"), ("P", "test")):
        o.filter(F.col("o_orderstatus") == status).select("patch").write.csv(f"{root}/{name}.csv")
    return R.split_lists(spark, root)


@CAT.add("src_08", "SELECT 'p_' || o_orderkey AS patch, CASE o_orderstatus WHEN 'F' THEN 'query' ELSE 'archive' END AS split FROM orders")
def src_08(spark, sf):
    """JSON patch lists."""
    root = folder(spark, "src_08")
    patches = table(spark, sf, "orders").select(
        F.concat(F.lit("p_"), F.col("o_orderkey").cast("string")).alias("patch"),
        F.when(F.col("o_orderstatus") == "F", F.lit("query")).otherwise(F.lit("archive")).alias("split"),
    )
    read = []
    for split in ("query", "archive"):
        part = patches.filter(F.col("split") == split)
        bucket = F.pmod(F.xxhash64("patch"), F.lit(N.bucket_count(part, 1000)))
        docs = part.groupBy(bucket.alias("b")).agg(F.collect_list("patch").alias(f"{split}_patches")).drop("b")
        docs.write.option("maxRecordsPerFile", 1).json(f"{root}/{split}")
        read.append(R.patch_list(spark, f"{root}/{split}", f"{split}_patches").withColumn("split", F.lit(split)))
    return read[0].unionByName(read[1])


def box(line):
    """The annotation of an order line: a rectangle as long as its quantity."""
    q = line["l_quantity"]
    ring = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(q, F.lit(0.0)), F.array(q, F.lit(1.0)), F.array(F.lit(0.0), F.lit(1.0)))
    return F.struct(F.struct(F.array(ring).alias("coordinates")).alias("geometry"))


@CAT.add(
    "src_09",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)
SELECT 'p_' || l_orderkey AS patch, count(*)::INTEGER AS boxes, round(sum(l_quantity), 6) AS area FROM b GROUP BY l_orderkey""",
)
def src_09(spark, sf):
    """Annotation maps keyed by patch; one map file per thousand patches, as a file costs more than the patches of a small one."""
    path = folder(spark, "src_09")
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_quantity").alias("line"), F.floor(F.col("l_orderkey") / PATCHES).alias("part"))
    # the lines move once, to the task that writes their map; boxes are made there
    moved = lines.repartition(N.bucket_count(lines.select("part").distinct(), MAPS), "part")
    per = moved.groupBy("part", "l_orderkey").agg(F.collect_list("line").alias("lines"))
    entry = F.struct(F.concat(F.lit("p_"), F.col("l_orderkey").cast("string")), F.struct(F.transform("lines", box).alias("annotations")))
    docs = per.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = R.annotations(spark, path)
    areas = F.aggregate(F.transform("boxes", G.ring_area), F.lit(0.0), lambda acc, a: acc + a)
    return read.select("patch", F.size("boxes").alias("boxes"), F.round(areas, 6).alias("area"))


def caption_files(spark, sf, path):
    tokens = F.split("text", " ")
    sentence = F.struct(
        F.col("doc_id").cast("int").alias("image_id"),
        (F.col("doc_id") * 4).cast("int").alias("sentence_id"),
        F.col("text").alias("raw"),
        tokens.alias("tokens"),
        F.when(F.col("lang") == "en", F.upper("lang")).alias("aug_rb"),
    )
    image = F.struct(
        F.concat("source", F.lit(".png")).alias("filename"),
        F.length("lang").alias("classcode"),
        F.array(sentence).alias("sentences"),
        F.array((F.col("doc_id") * 4).cast("int")).alias("sentids"),
    )
    docs = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(F.collect_list(image).alias("images"))
    docs.drop("part").write.option("maxRecordsPerFile", 1).json(path)


@CAT.add(
    "src_10",
    """SELECT source || '.png' AS filename, 2 AS classcode, doc_id::INTEGER AS image_id, (doc_id * 4)::INTEGER AS sentence_id, text AS raw,
len(string_split(text, ' '))::INTEGER AS n_tokens, CASE WHEN lang = 'en' THEN 'EN' END AS aug_rb, NULL::VARCHAR AS aug_bt_prob FROM documents""",
)
def src_10(spark, sf):
    """Caption dataset: file names, class codes, sentences, optional augmented text."""
    path = folder(spark, "src_10")
    caption_files(spark, sf, path)
    s = R.sentences(R.caption_dataset(spark, path))
    return s.select("filename", "classcode", "image_id", "sentence_id", "raw", F.size("tokens").alias("n_tokens"), "aug_rb", "aug_bt_prob")


@CAT.add("src_11", "SELECT CASE WHEN n_chars % 4 = 0 THEN '' ELSE text END AS request, CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE lang END AS category FROM documents")
def src_11(spark, sf):
    """Labelled requests with defaults for missing keys."""
    path = folder(spark, "src_11")
    entry = F.struct(
        F.when(F.col("n_chars") % 4 != 0, F.col("text")).alias("request"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("category")
    )
    docs = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.requests(spark, path)


@CAT.add("src_12", "WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings) SELECT id, len(v)::INTEGER AS dim, round(list_sum(v::DOUBLE[]), 6) AS total FROM e")
def src_12(spark, sf):
    """Embedding table scan."""
    path = folder(spark, "src_12")
    W.write_embeddings(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), path)
    e = R.embeddings(spark, path)
    return e.select("id", F.size("embedding").alias("dim"), F.round(A.total(A.as_doubles("embedding")), 6).alias("total"))


@CAT.add("src_13", "SELECT l_orderkey AS o_orderkey, o_totalprice FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def src_13(spark, sf):
    """Patches fetched by key."""
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return R.fetch(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), keys, "o_orderkey")


@CAT.add("src_14", "SELECT text AS request, quality::VARCHAR AS expected_category, toxic::VARCHAR AS detected_category, true AS request_exists FROM labels JOIN documents USING (doc_id)")
def src_14(spark, sf):
    """Classification results with text categories."""
    path = folder(spark, "src_14")
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    rows = joined.select(
        F.col("text").alias("request"), F.col("quality").alias("expected_category"), F.col("toxic").alias("detected_category"), F.lit(True).alias("request_exists")
    )
    rows.write.parquet(path)
    return R.classification_results(spark, path)


@CAT.add(
    "src_15_text",
    f"WITH {space.SQL_XY}, {space.SQL_SEG} SELECT (id % 10)::INTEGER AS seg, ax, ay, bx, \"by\" FROM sg",
)
def src_15_text(spark, sf):
    """Coast lines read from WKT text."""
    path = folder(spark, "src_15")
    lines = space.coast_lines(spark, sf).filter(F.size("points") > 1)
    lines.select(G.to_wkt(F.array("points"), F.lit("LINESTRING")).alias("value")).write.text(path)
    return R.line_segments(spark, path).drop("line")


@CAT.add("src_16", f"SELECT p, count(*) AS n FROM ({graph.star_sql()}) GROUP BY p")
def src_16(spark, sf):
    """Gzip bundles of the graph in one scan."""
    root = folder(spark, "src_16")
    paths = []
    for name, *_ in graph.STAR:
        W.write_ntriples(graph.star(spark, sf, (name,)), f"{root}/{name}.nt", compression="gzip")
        paths.append(f"{root}/{name}.nt")
    return T.predicate_counts(R.graph_bundles(spark, paths))


@CAT.add("snk_01", f"SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM ({graph.star_sql()})")
def snk_01(spark, sf):
    """N-Triples lines."""
    path = folder(spark, "snk_01")
    W.write_ntriples(graph.star(spark, sf), path)
    return spark.read.text(path)


@CAT.add("snk_01_table", f"SELECT s, p, o FROM ({graph.star_sql()}) WHERE p = '<o/inNation>'")
def snk_01_table(spark, sf):
    """Triple table stored by predicate; one predicate reads one folder."""
    path = folder(spark, "snk_01_table")
    W.write_triple_table(graph.star(spark, sf), path)
    return T.with_predicate(spark.read.parquet(path), "<o/inNation>").select("s", "p", "o")


@CAT.add(
    "snk_02",
    f"""WITH {graph.SQL_AREA}, last AS (SELECT l_orderkey, arg_max(o, l_partkey) AS wkt FROM w GROUP BY l_orderkey)
SELECT coalesce(wkt, 'null') || chr(9) || '<r/e' || o_orderkey || '>' AS line FROM orders LEFT JOIN last ON l_orderkey = o_orderkey""",
)
def snk_02(spark, sf):
    """Geometry TSV with header; a missing WKT prints null."""
    path = folder(spark, "snk_02")
    W.write_geometry_tsv(D.entity_wkt(graph.area_triples(spark, sf)), path)
    lines = R.text_lines(spark, path).select(F.col("value").alias("line"))
    return lines.filter("line <> 'WKT\\tEntity'")


@CAT.add("snk_03", "SELECT c_custkey::VARCHAR AS id, c_name || ', Ltd' AS name FROM customer")
def snk_03(spark, sf):
    """TSV to CSV."""
    root = folder(spark, "snk_03")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(", Ltd")).alias("name"))
    c.write.options(sep="\t", header=True).csv(f"{root}/tsv")
    W.tsv_to_csv(spark, f"{root}/tsv", f"{root}/csv")
    return spark.read.option("header", True).csv(f"{root}/csv")


@CAT.add(
    "snk_04",
    f"""WITH c AS ({media.CAT.sql["str_05"]}), e AS (SELECT o_orderkey, unnest([c1, c2, c3, c4]) AS raw, unnest([0, 1, 2, 3]) AS i FROM c)
SELECT 'img_' || o_orderkey AS filename, o_orderkey AS image_id, o_orderkey * 4 + i AS sentence_id, o_orderkey * 4 + i AS sentid, raw,
 array_to_string(string_split(raw, ' '), '|') AS tokens FROM e""",
)
def snk_04(spark, sf):
    """Nested caption documents: all sentences with their ids and tokens."""
    path = folder(spark, "snk_04")
    s = [F.col(f"s{i}") for i in range(5)]
    from ..operators import captions as C

    imgs = media.sized(spark, sf).select(
        F.col("o_orderkey").alias("image_id"),
        F.concat(F.lit("img_"), F.col("o_orderkey").cast("string")).alias("filename"),
        F.lit(1).alias("classcode"),
        C.templates(s[0] + s[1] + s[2] + s[3] + s[4], F.col("place"), s).alias("captions"),
    )
    W.write_captions(imgs, path)
    schema = f"filename STRING, classcode INT, sentences ARRAY<{R.SENTENCE}>, sentids ARRAY<INT>"
    each = spark.read.schema(schema).json(path).select("filename", "sentids", F.posexplode("sentences").alias("i", "s"))
    return each.select(
        "filename",
        F.col("s.image_id").cast("bigint").alias("image_id"),
        F.col("s.sentence_id").cast("bigint").alias("sentence_id"),
        F.col("sentids")[F.col("i")].cast("bigint").alias("sentid"),
        F.col("s.raw").alias("raw"),
        F.array_join("s.tokens", "|").alias("tokens"),
    )


@CAT.add("snk_05", "SELECT vec_id AS id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding) AS value FROM embeddings")
def snk_05(spark, sf):
    """Embedding matrix as float32."""
    path = folder(spark, "snk_05")
    W.write_embeddings(vectors.vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("v").alias("embedding")), path)
    return spark.read.parquet(path).select("id", F.posexplode("embedding").alias("pos", "value"))


@CAT.add("snk_06", "SELECT 'img_' || vec_id AS key, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code FROM embeddings")
def snk_06(spark, sf):
    """Hash codes by key in 0/1 form."""
    path = folder(spark, "snk_06")
    code = A.delivery_code(A.sign_code(F.col("v")))
    W.write_codes(vectors.vectors(spark, sf).select(F.concat(F.lit("img_"), F.col("vec_id").cast("string")).alias("key"), code.alias("code")), path)
    return spark.read.parquet(path).select("key", F.array_join(F.col("code").cast("array<string>"), "").alias("code"))


@CAT.add("snk_07", "SELECT conv_id::INTEGER AS conv_id, turn::BIGINT AS turn, role, text FROM conversations")
def snk_07(spark, sf):
    """Every dialogue in its own folder."""
    path = folder(spark, "snk_07")
    W.write_dialogues(Q.transcripts(table(spark, sf, "conversations")), path)
    schema = "conv_id INT, part BIGINT, turns ARRAY<STRUCT<turn: BIGINT, role: STRING, text: STRING>>"
    return spark.read.schema(schema).json(path).select("conv_id", F.inline("turns"))


@CAT.add(
    "snk_08",
    """WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS detected, lang FROM documents)
SELECT text AS request, lang AS expected_category, coalesce(detected, 'Error') AS detected_category, CASE WHEN detected IS NULL THEN 'Error' ELSE 'true' END AS request_exists FROM r""",
)
def snk_08(spark, sf):
    """Request results; failures keep an Error row."""
    path = folder(spark, "snk_08")
    rows = table(spark, sf, "documents").select(
        F.col("text").alias("request"),
        F.col("lang").alias("expected_category"),
        F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("detected_category"),
        F.lit(True).alias("request_exists"),
    )
    W.write_results(rows, path)
    return spark.read.parquet(path)


@CAT.add(
    "snk_09",
    f"""WITH {vectors.SQL_E}, {vectors.SQL_H4}, {vectors.SQL_MAP.format(g='grp, ', cap='nth <= 8')}
SELECT 'MAP' AS metric, grp AS direction, 8 AS k, round(avg(coalesce(ap, 0)), 6) AS value FROM qs LEFT JOIN ap USING (grp, qid) GROUP BY grp""",
)
def snk_09(spark, sf):
    """Metrics as a long table."""
    from ..operators import neighbours, retrieval

    path = folder(spark, "snk_09")
    profile = neighbours.hamming_profile(*vectors.code_sides(vectors.vectors(spark, sf), vectors.ALL_FOUR), keep=8)
    maps = retrieval.mean_average_precision(profile, 8)
    W.write_metrics(
        maps.select(F.lit("MAP").alias("metric"), F.col("grp").alias("direction"), F.lit(8).alias("k"), F.round("map", 6).alias("value")), path
    )
    return spark.read.parquet(path)


@CAT.add("snk_10", f"WITH {media.SQL_SPLIT} SELECT split, 'p_' || o_orderkey AS patch FROM sp")
def snk_10(spark, sf):
    """Query and archive lists."""
    path = folder(spark, "snk_10")
    split = media.smp_01(spark, sf).select("split", F.concat(F.lit("p_"), F.col("o_orderkey").cast("string")).alias("patch"))
    W.write_patch_lists(split, path, "patches", chunk=1000)
    read = spark.read.schema("split STRING, patches ARRAY<STRING>").json(path)
    return read.select("split", F.explode("patches").alias("patch"))


@CAT.add(
    "jn_02_files",
    """SELECT '<r/c' || c_custkey || '>' AS s, '<o/within>' AS p, CASE WHEN c_custkey = 0 THEN 'null' ELSE '<r/c' || (c_custkey - 1) || '>' END AS o FROM customer""",
)
def jn_02_files(spark, sf):
    """Pair ids resolved against TSV lines numbered in file order, source from 0 and target from 1."""
    path = folder(spark, "jn_02")
    c = table(spark, sf, "customer").orderBy("c_custkey")
    c.select(F.concat_ws("\t", graph.point_wkt("c_custkey"), rdf.iri("r/c", F.col("c_custkey"))).alias("value")).write.text(path)
    entities = R.geometry_tsv(spark, path)
    left = N.number_lines(entities, start=0).select("row", F.col("Entity").alias("entity"))
    right = N.number_lines(entities, start=1).select("row", F.col("Entity").alias("entity"))
    number = F.concat(F.lit("<"), F.col("c_custkey").cast("string"), F.lit(">"))
    pairs = table(spark, sf, "customer").select(number.alias("s"), F.lit("<o/within>").alias("p"), number.alias("o"))
    return D.name_pairs(pairs, left, right)


@CAT.add(
    "udf_03",
    "SELECT doc_id, lower(text) || ' [es] [de]' AS text FROM documents",
)
def udf_03(spark, sf):
    """Chained text steps with one table per step."""
    from ..operators.inference import chain_steps

    steps = [
        ("en-es", lambda texts: [t + " [es]" for t in texts]),
        ("es-de", lambda texts: [t + " [de]" for t in texts]),
    ]
    out = chain_steps(table(spark, sf, "documents"), "doc_id", "text", steps, folder(spark, "udf_03"))
    parts = F.regexp_extract("text", r"(?s)^(.*) \[es\] \[de\]$", 1)
    return out.select("doc_id", F.concat(F.lower(parts), F.lit(" [es] [de]")).alias("text"))
