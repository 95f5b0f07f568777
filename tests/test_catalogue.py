"""Names, biographies, cards, encodings, batches, ranges, shards and file readers on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import bibliography, hashing
from marginalia.operators import paging, search, stateful
from marginalia.sources import documents as sources
from marginalia.sources import shards


def one(spark, value, of, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(of(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("name", "title", "author"),
    [
        ("الرسالة ـ محمد بن إدريس.docx", "الرسالة", "محمد بن إدريس"),
        ("شرح السنة - دراسة جديدة.pdf", "شرح السنة - دراسة جديدة", None),
        ("A - B - C.txt", "A - B - C", None),
        ("فقه اللغة - للشيخ: علي", "فقه اللغة", "علي"),
        ("history - first part.md", "history - first part", None),
        (".docx", "كتاب بدون عنوان", None),
    ],
)
def test_file_names(spark, name, title, author):
    assert tuple(one(spark, name, bibliography.file_name_parts)) == (title, author)


def test_entity_kind(spark):
    kinds = {"مَجْهُولون": "collective", "جامعة المدينة العالمية": "organization", "اللجنة الدائمة للبحوث العلمية والإفتاء": "organization", "جامعة أخرى": "person"}
    assert {n: one(spark, n, bibliography.entity_kind) for n in kinds} == kinds


def test_biography(spark):
    b = one(spark, "عالم (١٦٤ - ٢٤١ هـ = ٧٨٠ - ٨٥٥ م) عاش نحو ٧٧ سنة المصدر: الأعلام.", bibliography.biography)
    assert (b.birth_hijri, b.death_hijri, b.birth_gregorian, b.death_gregorian, b.age, b.age_about, b.reference) == (164, 241, 780, 855, 77, True, "الأعلام")
    b = one(spark, "فقيه (000 - 1205 هـ = 000 - 1790 م)", bibliography.biography)
    assert (b.text, b.birth_hijri, b.death_hijri, b.death_gregorian, b.reference) == ("فقيه (ت 1205 هـ = 1790 م)", None, 1205, 1790, None)
    assert one(spark, "شاعر (٠٠٠ - ٤٤٩ هـ) × قائمة", bibliography.biography).text == "شاعر (ت ٤٤٩ هـ)"


def test_cards():
    assert bibliography.leaves('{"a": " x  y ", "b": ["z", {"c": "x y"}], "n": 3}') == ["x y", "z"]
    assert bibliography.leaves("[broken") == ["[broken"] and bibliography.leaves("  ") == [] and bibliography.leaves(None) == []


def test_sparse_offsets():
    assert bibliography.places_every("ab, (٣) cd", 1) == [0, 1, 7, 8, 9]
    assert bibliography.places_every("x" * 130) == [0, 64, 128] and bibliography.places_every(None) == []


def test_query_folds(spark):
    assert one(spark, "قِراءة  أحمد، café", bibliography.reciter_fold).startswith("قراءه احمد،")
    assert one(spark, "صحيح (البخارى)!", bibliography.corpus_fold) == "صحيح البخاري"


def test_delta_postings():
    ids = [0, 1, 127, 128, 300, 70000]
    assert hashing.delta_bytes([0, 128]) == b"\x00\x80\x01"
    assert hashing.delta_ids(hashing.delta_bytes(ids), len(ids), 70001) == ids and hashing.delta_ids(b"", 0, 5) == []
    for data, count, rows in ((b"\x80", 1, 9), (b"\x01", 2, 9), (b"\x09", 1, 9), (b"\x01\x00", 2, 9)):
        with pytest.raises(ValueError):
            hashing.delta_ids(data, count, rows)


def test_staged_batches(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([400_000, 400_000, 400_000, 2_000_000, 5])], "k int, o int, size long")
    got = [(r.stage, r.batch) for r in stateful.staged_batches(df, "k", "o", "size").orderBy("o").collect()]
    assert got == [(0, 0), (0, 0), (0, 1), (0, 2), (0, 3)]
    df = spark.createDataFrame([(1, i, 800_000) for i in range(12)], "k int, o int, size long")
    got = [(r.stage, r.batch) for r in stateful.staged_batches(df, "k", "o", "size").orderBy("o").collect()]
    assert got == [(0, i) for i in range(10)] + [(1, 0), (1, 1)]


def test_ranges_and_pages(spark):
    assert tuple(one(spark, 39, lambda c: paging.next_range(c, F.lit(40).cast("long"), 8), "long")) == (39, 39)
    assert one(spark, 40, lambda c: paging.next_range(c, F.lit(40).cast("long"), 8), "long") is None
    with pytest.raises(Exception, match="invalid checkpoint"):
        one(spark, 41, lambda c: paging.next_range(c, F.lit(40).cast("long"), 8), "long")
    assert tuple(one(spark, 0, lambda c: paging.visible_rows(F.lit(999), c), "long")) == (0, 0)
    rows = paging.numbered(spark.range(0, 1000, 7), [F.col("id")], F.floor(F.col("id") / 64)).orderBy("id").collect()
    assert [r.row for r in rows] == list(range(1, len(rows) + 1))
    bad = spark.createDataFrame([("a/b", 0)], "id string, t long").withColumn("t", F.timestamp_seconds("t"))
    with pytest.raises(Exception, match="invalid sitemap row"):
        paging.sitemap_pages(bad, "id", "t", F.lit(0), "x").collect()


def test_partition_choice(spark):
    sizes = spark.range(512).select(F.col("id").alias("bucket"), F.lit(1).alias("bytes"))
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    assert hashing.chosen_partitions(terms("book"), sizes).count() == 1
    assert hashing.chosen_partitions(terms("book", "of"), sizes).count() == 0
    assert hashing.chosen_partitions(terms(*(f"{chr(97 + i)}{chr(107 + i % 7)}z" for i in range(26))), sizes).count() == 0


def test_routed_phrase(spark):
    docs = spark.createDataFrame([(1, "a long phrase of words"), (2, "long words phrase"), (3, "")], "doc_id long, folded string")
    words = docs.select("doc_id", F.explode(F.split("folded", " ")).alias("word"))
    assert [r.doc_id for r in search.routed_phrase(docs, words, "long phrase of words").collect()] == [1]
    assert [r.doc_id for r in search.routed_phrase(docs, words, "long words").collect()] == [2]


def test_spine_order_and_broken_files(spark):
    lines = [f"line {i} & <more>" for i in range(120)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "k long, t string")
    got = sources.read_contents(sources.as_contents(docs, "k", "t", "epub"), "epub").where("path = '1'").orderBy("ordinal").collect()
    assert [r.text for r in got] == lines
    broken = spark.createDataFrame([("x", bytearray(b"no zip"))], "path string, content binary")
    assert sources.read_contents(broken, "epub").first().text is None


def test_routed_shards(spark):
    path = shards.new_folder(spark, "t")
    shards.write_routed(spark.range(100).withColumnRenamed("id", "k"), path, "k", 8)
    assert sorted(r.k for r in shards.read_routed(spark, path, "k long", "k", [3, 99, 1000], 8).collect()) == [3, 99]


def test_committed_prefix(spark):
    pages = spark.createDataFrame([("a", 0, True), ("a", 40, None), ("a", 80, True), ("b", 0, True)], "k string, o int, ok boolean")
    assert sorted((r.k, r.o) for r in paging.committed_prefix(pages, "k", "o", "ok").collect()) == [("a", 0), ("b", 0)]
