"""Folds, parser, search against scans, stateful operators with injected clocks, sources, streams and the entry point."""

import datetime as dt
import io
import random
import tracemalloc
import zipfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marginalia import registry
from marginalia.functions import folds, hashing, matching, text
from marginalia.operators import index, rules, search, stateful
from marginalia.plans import views
from marginalia.sources import documents as sources
from marginalia.streaming import events as streaming

SF = "/root/testdata/sf0.001"


def one(spark, value, fold):
    return spark.createDataFrame([(value,)], "t string").select(fold(F.col("t"))).first()[0]


def test_search_fold(spark):
    assert one(spark, "إِنَّمَا الأَعْمَالُ بِالنِّيَّات (٣) ـ", folds.search_fold) == "انما الاعمال بالنيات"
    assert {one(spark, s, folds.search_fold) for s in ("اله", "أله", "الـه")} == {"اله"}
    assert one(spark, "ΟΔΟΣ", folds.search_fold) == "οδοσ" and one(spark, "صالحة", folds.search_fold) == "صالحة"
    assert one(spark, "صالحة", folds.presentation_fold) == "صالحه"


def test_normal_forms(spark):
    assert one(spark, "ﷲ ﻻ", folds.broad_fold) == one(spark, "الله لا", folds.broad_fold)
    assert one(spark, "é", folds.nfc) == "é"


def test_query_parser():
    q = search.parse_query('"of the" rest -x -X \\-y -"a b"')
    assert q.phrase == "of the rest -y" and q.excluded == ("x", "a b")
    with pytest.raises(ValueError):
        search.parse_query("x" * 1025)


def test_index_equals_scan_and_paging_is_complete(spark):
    docs = spark.createDataFrame([(f"b{i % 7}", i, f"row {i} " + ("actions count" if i % 2 == 0 else "nothing")) for i in range(400)], "book string, ordinal int, folded string")
    for phrase in ("actions", "ac", "s c", "x"):
        hits = {r.ordinal for r in search.shard_search(docs, phrase, ["book", "ordinal"], postings=index.trigram_postings(docs, ["book", "ordinal"])).collect()}
        assert hits == {r.ordinal for r in search.shard_search(docs, phrase, ["book", "ordinal"]).collect()}
        assert hits == ({r.ordinal for r in docs.where(F.contains("folded", F.lit(phrase))).collect()} if len(phrase) > 1 else set())
    hits = search.shard_search(docs, "actions", ["book", "ordinal"])
    pages = [search.counted(hits, [F.col("ordinal")], o, 30).collect() for o in range(0, 210, 30)]
    assert [r.ordinal for p in pages for r in p] == list(range(0, 400, 2)) and all(r.total == 200 for p in pages for r in p)


def test_phrase_with_repeated_word(spark):
    words = views.words(spark.createDataFrame([(1, "a b a b a"), (2, "b a")], "doc_id long, text string"))
    assert {(r.doc_id, r.start) for r in search.phrase_search(words, ["a", "b", "a"]).collect()} == {(1, 0), (1, 2)}
    assert {(r.doc_id, r.start) for r in search.heading_search(words, ["a"]).collect()} == {(1, 0), (1, 2), (1, 4), (2, 1)}


def test_hashes_and_distances(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h

    for s in ("", "a", "foobar", "كتاب"):
        assert one(spark, s, hashing.fnv1a) == fnv(s)
    row = spark.createDataFrame([("kitten", "sitting")], "a string, b string").select(text.bounded_levenshtein(F.col("a"), F.col("b"), 2), text.bounded_levenshtein(F.col("a"), F.col("b"), 3), text.ngram_dice("a", "b")).first()
    assert row[0] == 3 and row[1] == 3 and 0 < row[2] < 1


def test_packing_ranges_and_aliases(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate((4, 5, 6, 20, 1, 1))], "k long, i int, n long")
    assert [r.pack for r in stateful.packed_groups(rows, "k", "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]
    ranges = spark.createDataFrame([(1, 0, 10), (1, 12, 20), (1, 30, 40), (1, 41, 90)], "k long, a long, b long")
    assert [(r.start, r.end, r.n) for r in stateful.coalesced_ranges(ranges, "k", "a", "b", 5, 60).orderBy("start").collect()] == [(0, 20, 2), (30, 90, 2)]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "alias string, target string")
    assert {r.alias: r.target for r in stateful.resolved_aliases(chain).collect()} == {"a": "c", "b": "c", "x": "y"}


def test_reconcile_by_identity_then_path(spark):
    was = spark.createDataFrame([(1, "p/a", "i1"), (2, "p/b", "i2"), (3, "p/c", None), (4, "p/d", "dup"), (5, "p/e", "dup")], "id long, path string, identity string")
    now = spark.createDataFrame([("q/a", "i1"), ("p/c", "new"), ("p/d", "dup"), ("z", None)], "path string, identity string")
    assert {(r.id, r.path, r.outcome) for r in stateful.reconciled(was, now).collect()} == {(1, "q/a", "moved"), (2, "p/b", "missing"), (3, "p/c", "same"), (4, "p/d", "same"), (5, "p/e", "missing"), (None, "z", "new")}


def test_as_of(spark):
    rows = spark.createDataFrame([(1, 5), (1, 10), (1, 1)], "k long, at long")
    marks = spark.createDataFrame([(1, 3, "x"), (1, 10, "y")], "k long, at long, v string")
    assert {(r["at"], r.v) for r in search.as_of(rows, marks, ["k"], "at", "v").collect()} == {(1, None), (5, "x"), (10, "y")}


def test_document_sources(spark, tmp_path):
    for kind, name, body in (("epub", "OPS/a.xhtml", "<p>One</p><p>Two &amp; three</p>"), ("docx", "word/document.xml", "<w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two &amp; three</w:t></w:r></w:p>")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(name, body)
        (tmp_path / f"x.{kind}").write_bytes(data.getvalue())
        assert [r.text for r in sources.binary_documents(spark, str(tmp_path), kind).orderBy("ordinal").collect()] == ["One", "Two & three"]
    df = spark.createDataFrame([("=1+1", 1), ("plain", 2), ("-x,\"q\"", 3)], "title string, id long")
    sources.write_catalogue_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in sources.read_catalogue_csv(spark, str(tmp_path / "c"), "title string, id long", "id").collect()} == {tuple(r) for r in df.collect()}
    md = spark.createDataFrame([(1, "# A\nx\n## B\ny\n")], "doc_id long, text string")
    assert [(r.section, r.text) for r in sources.markdown(md).orderBy("ordinal").collect()] == [("A", "x"), ("B", "y")]


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(milliseconds=ms), u, "click", 1.0) for i, (u, ms) in enumerate([(1, 0), (1, 100), (1, 900), (2, 0), (1, 86_400_000 * 3)])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.event_stream(spark, str(tmp_path / "in"), df.schema)
    got = streaming.drained(streaming.debounced(stream, 500), "bursts", str(tmp_path / "c1")).collect()
    assert (1, 2) in {(r.user_id, r.n) for r in got}
    n = streaming.drained(streaming.windowed_counts(stream), "counted", str(tmp_path / "c2"), "complete" if False else "append").count()
    assert n >= 1
    assert streaming.drained(streaming.without_replays(stream), "once", str(tmp_path / "c3")).count() == 5


def test_entry_and_registry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0].total >= len(rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["sch_1_shard_search", "joi_16_shingle_votes", "joi_18_as_of", "str_2_debounce", "agg_18_percentiles", "set_5_version_delta", "txt_1_search_fold", "sch_9_heading_search"])
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in views.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    sql = c.execute(registry.ORACLES[name])
    names = [d[0] for d in sql.description]
    norm = lambda r: tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r)
    assert sorted(map(norm, got.select(*names).collect())) == sorted(map(norm, sql.fetchall()))


def test_folds_with_offsets_equal_the_fold(spark):
    texts = ["إِنَّمَا ( ٤ ) الأَعْمَالُ ﴿٣﴾ （5）x", "İstanbul ΟΔΟΣ", "a—b [12] c", "", "١٢٣ [45] x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folds.search_fold(F.col("t")).alias("plain"), matching.folded_with_offsets("t").alias("f"))
    for r in df.collect():
        assert r.f.folded == r.plain and len(r.f.offsets) == len(r.plain)
        assert all(r.t[at].lower().translate(matching._FORMS)[0] == c or len(r.t[at].lower()) > 1 for c, at in zip(r.plain, r.f.offsets, strict=True) if c != " ")
    assert [r.plain for r in df.collect()][0] == "انما الاعمال x"


def test_folds_with_offsets_of_many_texts_take_little_memory():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(("Word", "مَدْرَسَةٌ", "[12]", "x.y")) for _ in range(400)) for _ in range(3000)]
    batch = pa.array(texts)
    matching.fold_with_offsets(""), next(matching.folded_with_offsets.func(iter([batch[:1]])))
    tracemalloc.start()
    n = sum(len(part) for part in matching.folded_with_offsets.func(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and batch.nbytes > 5e6 and peak < 2 * batch.nbytes


def test_folds_with_offsets_in_slices(monkeypatch):
    rng = random.Random(8)
    signs = "abZ İΣσς()[﴿﴾0٣۴  \n\t\0—.ـًۖۥأآىةؤ𝐀😀é①ǅß"
    texts = [None, "", "\0", "(", "1", ")", "[12", "] a", *("".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3000)), "ab [1] " * 200, None]
    monkeypatch.setattr(matching, "SLICE_BYTES", 256)
    parts = list(matching.folded_slices(pa.array(texts).slice(1)))
    for part in parts:
        part.validate(full=True)
    assert [(r["folded"], r["offsets"]) for part in parts for r in part.to_pylist()] == [matching.fold_with_offsets(t) for t in texts[1:]]
    assert len(parts) > 100 and not list(matching.folded_slices(pa.array([], pa.string())))


def test_folds_with_offsets_drop_marks_inside_words(spark):
    texts = ["الـه", "aۥb ـ c", "ـ(١)ـx", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(folds.search_fold(F.col("t")).alias("plain"), matching.folded_with_offsets("t").alias("f"))
    assert [(r.f.folded, r.f.offsets) for r in df.collect()] == [("اله", [0, 1, 3]), ("ab c", [0, 2, 6, 6]), ("x", [5]), ("", [])]
    assert [r.plain or "" for r in df.collect()] == [r.f.folded for r in df.collect()]
    assert matching.ranges_of("قال الـه", "اله") == [(4, 8)]


def test_fold_offsets_query_has_the_folds_of_the_search_fold(spark):
    got = {r.id: (r.fold, r.n) for r in registry.QUERIES["txt_2_fold_offsets"](spark, SF).collect()}
    assert got == {r.id: (r.fold, r.n) for r in registry.QUERIES["txt_1_search_fold"](spark, SF).collect()}


def test_reference_literals_of_folds_and_terms(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(folds.link_fold, "أَحْمَدُ<b>ى</b>") == "احمدي"
    assert one(folds.facet_fold, "مكّة، المُكَرَّمة") == "مكه المكرمه"
    assert one(folds.aligner_fold, "أُمَّةٌ، وسطى!") == "امه وسطي"
    assert one(folds.base_title, "الكتاب - ط دار العلم") == "الكتاب" and one(folds.base_title, "كتاب - العلم") == "كتاب - العلم"
    assert one(lambda c: text.derive_term(c, "root"), "نور") == "نور" and one(lambda c: text.derive_term(c, "exact"), "  a b ") == "a b"
    assert one(lambda c: hashing.bucket(c, 512), "x").isdigit() and len(one(lambda c: hashing.bucket(c, 512), "x")) == 4


def test_bloom_bits_by_hand(spark):
    def bits(key, count):
        a, b = 2166136261, 0x9E3779B9
        for ch in key:
            a = (a ^ ord(ch)) * 16777619 % 2**32
            b = (b ^ ord(ch)) * 0x85EBCA6B % 2**32
            b ^= b >> 13
        return [(a + i * (b | 1)) % 2**32 % count for i in range(10)]

    df = spark.createDataFrame([("7", 3), ("longer:id", 123456)], "id string, at long")
    got = df.select("id", "at", hashing.bloom_positions(8008)("id", "at").alias("b")).collect()
    assert all(r.b == bits(f"{r.id}:{r['at']}", 8008) for r in got)
    at = spark.range(500).selectExpr("'w' as word", "id as doc_id", "id * 3 as pos")
    filters = hashing.bloom_filters(at)
    asked = at.union(spark.range(500).selectExpr("'w'", "id", "id * 3 + 1"))
    may = hashing.bloom_members(filters, asked).collect()
    assert all(r.may for r in may if r.pos % 3 == 0) and sum(r.may for r in may if r.pos % 3 == 1) < 25


def test_verse_ranking_and_exclusions(spark):
    df = spark.createDataFrame([("1:1", "بسم الله"), ("1:2", "الله"), ("1:3", "(b"), ("1:4", "هٰذا")], "id string, text string")
    got = {r.id: r.score for r in search.verse_ranking(df, "الله").collect()}
    assert got == {"1:1": 92, "1:2": 100}
    assert [r.id for r in search.verse_ranking(df, "(b").collect()] == ["1:3"] and search.verse_ranking(df, "b").count() == 0
    assert [r.id for r in search.verse_ranking(df, "هاذا").collect()] == ["1:4"]  # the small alef read as alef
    assert search.parse_query('x -WITH -with').excluded == ("with",)


def test_rules_that_are_errors(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 12)], "alias long, target long")
    assert {r.alias: r.target for r in stateful.resolved_aliases(chain.where("alias > 4")).collect()}[5] == 12
    with pytest.raises(Exception, match="alias hop limit"):
        stateful.resolved_aliases(chain).collect()
    with pytest.raises(Exception, match="alias cycle"):
        stateful.resolved_aliases(spark.createDataFrame([(1, 2), (2, 1)], "alias long, target long")).collect()
    work = spark.createDataFrame([(1, 5, "save", "d1")], "operation_id long, book_id long, kind string, digest string")
    assert rules.enqueue_decisions(work, work).first().decision == "replay"
    with pytest.raises(Exception, match="reused for different work"):
        rules.enqueue_decisions(work, work.withColumn("digest", F.lit("d2"))).collect()
    marks = iter([1, 2])
    with pytest.raises(RuntimeError, match="changed"):
        rules.fenced(lambda: work, lambda: spark.range(next(marks)).groupBy().count())
    with pytest.raises(Exception, match="outside the managed root"):
        spark.createDataFrame([("a/../b",)], "p string").select(rules.logical_path(F.col("p"))).collect()
    kept = spark.createDataFrame([("modified", "a\\~$x.docx", None), ("renamed", "b.docx", "b.tmp")], "kind string, path string, previous_path string")
    assert [tuple(r) for r in rules.source_events(kept).collect()] == [("move", "b.docx", "b.tmp")]


def test_page_alignment_finds_page_beginnings(spark):
    rng = random.Random(2)
    lines = [" ".join(f"كلمة{rng.randrange(5000)}" for _ in range(30)) for _ in range(60)]
    pages = [(1, p, " ".join(lines[p * 6 : p * 6 + 6]) if p != 4 else "") for p in range(10)]
    got = rules.aligned_pages(spark.createDataFrame(pages, "book long, page long, text string"), spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "book long, ordinal long, text string")).collect()
    assert {r.page: r.paragraph for r in got} == {p: p * 6 if p != 4 else None for p in range(10)}


def test_clean_text_and_footnotes(spark):
    df = spark.createDataFrame([("a&lt;hr&gt;b <a href=inr://man-12>زيد</a> ¬ (٣ ) x ،",)], "t string")
    r = df.select(matching.clean_search(F.col("t")).alias("t"), matching.narrator_ids(F.col("t")).alias("ids")).first()
    assert r.ids == ["12"] and r.t.startswith("a\nb زيد") and "(٣)" in r.t and r.t.endswith("x،")
    notes = spark.createDataFrame([("متن (١)\n____\n(١) حاشية",), ("متن\n(١) أ\n(٢) ب",), ("متن (١)",)], "t string").select(matching.body_and_notes(F.col("t")).alias("x")).collect()
    assert notes[0].x.body == "متن (١)" and notes[1].x.notes == "(١) أ\n(٢) ب" and notes[2].x.notes is None
