import pytest
from pyspark.sql import functions as F

from terralens.functions import rdf
from terralens.operators import dedup as D
from terralens.operators import patterns as P
from terralens.operators import triples as T
from terralens.sources import readers, writers
from terralens.streaming import products


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def links(spark, data):
    return spark.createDataFrame([(s, o, i) for i, (s, o) in enumerate(data)], "s string, o string, ord bigint")


def walk(data, marker="Geometry_gadm"):
    """Brute force: keep the first, but a marked one gives way to the next."""
    kept, gone = {}, []
    for s, o in data:
        if s not in kept:
            kept[s] = o
        elif marker in kept[s]:
            gone.append((s, kept[s]))
            kept[s] = o
        else:
            gone.append((s, o))
    return sorted(kept.items()), sorted(gone)


def test_geometry_dedup_follows_file_order(spark):
    data = [("a", "Geometry_gadm1"), ("a", "g1"), ("a", "g2"), ("b", "Geometry_gadm2"), ("b", "Geometry_gadm3"), ("c", "g4"), ("c", "Geometry_gadm5"), ("c", "g4"), ("d", "g6")]
    kept, gone = walk(data)
    df = links(spark, data)
    assert rows(D.keep_one_geometry(df)) == kept
    assert rows(D.duplicate_geometries(df).select("s", "o")) == gone
    once = D.keep_one_geometry(df).withColumn("ord", F.lit(0))
    assert rows(D.keep_one_geometry(once)) == kept


def test_largest_geometry_prefers_the_later_tie(spark):
    square = '"POLYGON ((0 0, {n} 0, {n} {n}, 0 {n}, 0 0))"'
    data = [("g", rdf.AS_WKT, square.format(n=2), 0), ("g", rdf.AS_WKT, square.format(n=3), 1), ("g", rdf.AS_WKT, '"POLYGON ((0 0, 9 0, 9 1, 0 1, 0 0))"', 2), ("e", "<p>", "<o>", 3)]
    df = spark.createDataFrame(data, "s string, p string, o string, ord bigint")
    assert rows(D.largest_geometry(df)) == [("e", "<p>", "<o>"), ("g", rdf.AS_WKT, data[2][2])]


def test_pair_names(spark):
    pairs = spark.createDataFrame([("<0>", "<w>", "<1>"), ("<5>", "<w>", "<2>")], "s string, p string, o string")
    left = spark.createDataFrame([(0, "A")], "row bigint, entity string")
    right = spark.createDataFrame([(1, "B"), (2, "C")], "row bigint, entity string")
    assert rows(D.name_pairs(pairs, left, right)) == [("A", "<w>", "B"), ("null", "<w>", "C")]


def test_crs_tag_round_trip(spark):
    df = spark.createDataFrame([(rdf.AS_WKT, '"POINT (1 2)"'), ("<p>", '"x"')], "p string, o string")
    tagged = df.withColumn("o", rdf.add_crs(F.col("p"), F.col("o")))
    assert dict(rows(tagged))[rdf.AS_WKT] == f'"{rdf.EPSG_4326}  POINT (1 2)"'
    assert rows(tagged.withColumn("o", rdf.add_crs(F.col("p"), F.col("o")))) == rows(tagged)
    assert rows(tagged.withColumn("o", rdf.drop_crs(F.col("p"), F.col("o")))) == rows(df)


def test_ntriples_round_trip_and_corrupt_lines(spark, tmp_path):
    terms = [("<a>", "<p>", '"say \\"hi\\" . "@en'), ("_:b", "<p>", f'"1"^^<{rdf.XSD}integer>'), ("<c>", "<q>", "<d>")]
    df = spark.createDataFrame(terms, "s string, p string, o string")
    writers.write_ntriples(df, str(tmp_path / "t"))
    (tmp_path / "t" / "bad.txt").write_text("not a triple\n")
    assert rows(readers.ntriples(spark, str(tmp_path / "t"))) == sorted(terms)
    bad = readers.ntriples(spark, str(tmp_path / "t"), keep_corrupt=True).filter("_corrupt IS NOT NULL")
    assert [r["_corrupt"] for r in bad.collect()] == ["not a triple"]
    ordered = readers.ordered_ntriples(spark, str(tmp_path / "t"))
    assert rows(ordered.select("s", "p", "o")) == sorted(terms)


POI = """{"id": "n1", "properties": {"name": "Big \\"B\\"", "name:fr": "Gros", "addr:city": "X", "wikidata": "Q1"},
"geometry": {"type": "Point", "coordinates": [1.5, 2.0]}}"""


def test_entity_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.json").write_text(POI)
    (tmp_path / "in" / "sub" / "broken.json").write_text('{"id": "n2", ')
    (tmp_path / "in" / "root.json").write_text(POI.replace("n1", "n3"))
    docs = readers.entity_documents(spark, str(tmp_path / "in"))
    voc = rdf.Vocabulary("r/", "o/", "n/", "w/")
    got = set(rows(T.entity_triples(docs, "poi", voc)))
    assert got == {
        ("<r/n1>", rdf.RDF_TYPE, "<o/poi>"),
        ("<r/n1>", "<n/hasGADM_Name>", "\"Big 'B'\""),
        ("<r/n1>", "<n/hasGADM_Name>", '"Gros"@fr'),
        ("<r/n1>", "<o/isInCity>", '"X"'),
        ("<r/n1>", "<o/wikilink>", "<w/Q1>"),
        ("<r/n1>", rdf.HAS_GEOMETRY, "<r/Geometry_poi_n1>"),
        ("<r/Geometry_poi_n1>", rdf.AS_WKT, f'"{rdf.EPSG_4326} POINT (1.5 2)"^^{rdf.WKT_LITERAL}'),
    }


def test_product_stream_gives_the_batch_triples(spark, tmp_path):
    folder = tmp_path / "p" / "a" / "b" / "c"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"{i}.json").write_text(
            '{"id": "x%d", "properties": {"platform": "sentinel-2a", "eo:cloud_cover": 1.5}, "links": [{"rel": "license", "href": "h"}]}' % i
        )
    query = products.stream_product_triples(spark, str(tmp_path / "p"), "sentinel2", str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    batch = T.entity_triples(readers.product_documents(spark, str(tmp_path / "p")), "sentinel2")
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("s", "p", "o")) == rows(batch)
    assert len(rows(batch)) == 12


@pytest.fixture(scope="module")
def small(spark):
    data = [("<a>", "<knows>", "<b>"), ("<b>", "<knows>", "<c>"), ("<c>", "<knows>", "<c>"), ("<a>", "<age>", '"3"'), ("<c>", "<age>", '"9"')]
    return spark.createDataFrame(data, "s string, p string, o string")


def test_patterns(small):
    assert rows(P.match(small, [("?x", "<knows>", "?y"), ("?y", "<knows>", "?z")]).select("x", "y", "z")) == [
        ("<a>", "<b>", "<c>"),
        ("<b>", "<c>", "<c>"),
        ("<c>", "<c>", "<c>"),
    ]
    assert rows(P.match_one(small, ("?x", "<knows>", "?x"))) == [("<c>",)]
    people = P.match_one(small, ("?x", "<knows>", "?y"))
    ages = P.match_one(small, ("?x", "<age>", "?a"))
    assert {tuple(r) for r in P.optional(people, ages).select("x", "a").collect()} == {("<a>", '"3"'), ("<b>", None), ("<c>", '"9"')}
    assert rows(P.minus(people, ages).select("x")) == [("<b>",)]
    assert P.minus(people, ages.withColumnRenamed("x", "q").select("q")).count() == 3
    assert P.exists(people, ages).count() + P.exists(people, ages, negated=True).count() == 3
    with pytest.raises(ValueError, match="connected"):
        P.match(small, [("?x", "<knows>", "?y"), ("?p", "<age>", "?q")])
    with pytest.raises(ValueError, match="no stored relation"):
        P.spatial(people, small, "http://x/unknown", "?x", "?y")
    with pytest.raises(ValueError, match="unknown geometry function"):
        P.unwrap(("http://x/hull", "?x"))


def test_or_as_bag_repeats_rows(small):
    people = P.match_one(small, ("?x", "<knows>", "?y"))
    either = (F.col("x") == "<c>", F.col("y") == "<c>")
    assert P.filter_any(people, *either).count() == 2
    assert P.filter_any(people, *either, as_union=True).count() == 3


def test_literals_come_back_whole(spark, sf, tmp_path):
    texts = ["plain", 'a "quote"', "line\nbreak\r\ttab", "back\\slash", "ends with \\", '\\"', "\\n is no line feed", "", "é 日本"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = rows.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    triples = rows.select(rdf.iri("r/", F.col("doc_id")).alias("s"), F.lit("<o/text>").alias("p"), rdf.literal(F.col("text")).alias("o"))
    path = str(tmp_path / "all.nt")
    writers.write_ntriples(triples, path)
    back = readers.ntriples(spark, path).select("s", rdf.literal_value(F.col("o")).alias("text"))
    want = {f"<r/{r['doc_id']}>": r["text"] for r in rows.collect()}
    assert {r["s"]: r["text"] for r in back.collect()} == want
    assert readers.malformed_lines(spark, path).count() == 0


def test_what_is_no_triple_or_document_is_told(spark, tmp_path):
    (tmp_path / "bad.nt").write_text('<a> <b> <c> .\nnonsense\n<a> <b> "open .\n')
    assert readers.ntriples(spark, str(tmp_path / "bad.nt")).count() == 1
    assert sorted(r["value"] for r in readers.malformed_lines(spark, str(tmp_path / "bad.nt")).collect()) == ['<a> <b> "open .', "nonsense"]
    folder = tmp_path / "docs" / "ports"
    folder.mkdir(parents=True)
    (folder / "good.json").write_text('{"id": "p1", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}')
    (folder / "bad.json").write_text('{"id": "p2", ')
    assert [r["wkt"] for r in readers.entity_documents(spark, str(tmp_path / "docs")).collect()] == ["POINT (1 2)"]
    assert [r["file"].rsplit("/", 1)[1] for r in readers.malformed_documents(spark, f"{tmp_path}/docs/*/*").collect()] == ["bad.json"]


def test_rivers_from_files(spark, tmp_path):
    folder = tmp_path / "tree" / "rivers"
    folder.mkdir(parents=True)
    lines = '{"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "LineString", "coordinates": [[2, 5], [1, 1]]}'
    (folder / "r.json").write_text('{"id": "river_1", "properties": {"waterway": "river"}, "geometry": {"type": "GeometryCollection", "geometries": [%s]}}' % lines)
    docs = readers.river_documents(spark, str(tmp_path / "tree"))
    found = {r["p"]: r["o"] for r in T.entity_triples(docs, "river").collect()}
    assert "MULTIPOLYGON (((0 0, 1 1, 2 5, 2 5, 1 1, 0 0, 0 0)))" in found[rdf.AS_WKT]
    assert rdf.HAS_GEOMETRY in found


def test_patterns_read_their_predicates_only(spark, sf):
    from terralens.plans import graph as plans

    for key in ("jn_05", "jn_06", "jn_07", "flt_06", "agg_27", "flt_01"):
        df = plans.CAT.queries[key](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert scans and all("PartitionFilters: [isnotnull(p" in line or "PartitionFilters: [(p" in line for line in scans), key
    graph, counts = plans.star_store(spark, sf)
    assert counts["<o/orderedBy>"] == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert graph.count() == sum(counts.values())


def test_the_rarest_pattern_comes_first():
    patterns = [("?c", "big", "?n"), ("?n", "small", "?r"), ("?r", "middle", '"x"')]
    assert P.join_order(patterns) == patterns
    assert P.join_order(patterns, {"big": 9, "small": 1, "middle": 5}) == [patterns[2], patterns[1], patterns[0]]
    assert P.join_order(patterns[:2], {"big": 9, "small": 1}) == [patterns[1], patterns[0]]
    # connected, though the next rarest shares nothing yet
    chain = [("?a", "p1", "?b"), ("?b", "p9", "?c"), ("?c", "p2", "?d")]
    assert P.join_order(chain, {"p1": 1, "p2": 2, "p9": 9}) == [chain[0], chain[1], chain[2]]
    with pytest.raises(ValueError):
        P.join_order([("?a", "p", "?b"), ("?c", "q", "?d")])


def test_stored_graph_is_written_without_sorting(spark, monkeypatch):
    rows = [(f"<s{i}>", f"<p{i % 5}>", f'"{i}"') for i in range(200)]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    seen, conf = [], "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(conf, "0")
    writer = type(df.write)
    plain = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: seen.append(spark.conf.get(conf)) or plain(self, *a, **k))
    kept = T.stored(df, "unsorted")
    assert sorted(map(tuple, kept.collect())) == sorted(rows)
    assert int(seen[0]) >= 5 and spark.conf.get(conf, "0") == before
