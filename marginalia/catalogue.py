"""Queries over names, files, shards and pages, beside those of the registry; the same register holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import bibliography, hashing
from marginalia.operators import index, paging, search, stateful
from marginalia.plans import views
from marginalia.registry import _paragraphs, _table, _texts, _words, query
from marginalia.sources import documents as sources
from marginalia.sources import shards

_FNV = "list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_BUCKET = "lpad(CAST(" + _FNV + " % {1} AS VARCHAR), 4, '0')"
_LINES = "(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS k, trim(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}\\x{1C}-\\x{1F}]+', ' ', 'g')) AS t FROM paragraphs)"
_READ = "SELECT doc_id, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY k)) AS lines FROM " + _LINES + " x WHERE t <> '' GROUP BY doc_id"

# --- names ----------------------------------------------------------------------------------------------

#: Names on which the rules show, in every query of this part.
FILES = ("الرسالة ـ محمد بن إدريس.docx", "شرح السنة - دراسة جديدة.pdf", "A - B - C.txt", "تاريخ - أحمد الكاتب.epub", ".docx", "notes.md", "فقه اللغة - للشيخ: علي")
PEOPLE = ("مجموعة من المؤلفين", "مَجْهُولون", "اللجنة الدائمة للبحوث العلمية والإفتاء", "ملتقى أهل الحديث", "أحمد بن حنبل")
LIVES = ("عالم (١٦٤ - ٢٤١ هـ = ٧٨٠ - ٨٥٥ م) عاش نحو ٧٧ سنة المصدر: الأعلام.", "فقيه (000 - 1205 هـ = 000 - 1790 م)", "شاعر (٠٠٠ - ٤٤٩ هـ) × قائمة", "بلا تاريخ")
CARDS = ('{"a": " x  y ", "b": ["z", {"c": "x y"}], "n": 3}', "[broken", "plain", "  ", '["α", "β", "α"]')


def _given(spark, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "id int, t string")


@query("txt_28_file_names")
def txt_28_file_names(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.substring_index("text", ".", 1), F.lit("-"), "source").alias("t"))
    own = _given(spark, FILES).select((-1 - F.col("id")).cast("long").alias("doc_id"), "t")
    return docs.union(own).select("doc_id", bibliography.file_name_parts(F.col("t")).alias("p")).select("doc_id", "p.*")


@query("txt_29_entity_kind", "SELECT id, ['collective', 'collective', 'organization', 'organization', 'person'][id + 1] AS kind FROM (SELECT unnest(range(5))::INT AS id) x")
def txt_29_entity_kind(spark, sf_dir):
    return _given(spark, PEOPLE).select("id", bibliography.entity_kind(F.col("t")).alias("kind"))


@query("txt_30_biographies")
def txt_30_biographies(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" (ت "), F.col("doc_id").cast("string"), F.lit(" هـ)")).alias("t"))
    own = _given(spark, LIVES).select((-1 - F.col("id")).cast("long").alias("doc_id"), "t")
    lives = docs.union(own).select("doc_id", bibliography.biography(F.col("t")).alias("b")).select("doc_id", "b.*")
    return lives.withColumn("text", F.md5("text"))


@query("txt_31_card_values", "SELECT doc_id, [lang, source, 'shelf ' || (doc_id % 7)] AS leaves FROM documents")
def txt_31_card_values(spark, sf_dir):
    card = F.to_json(F.struct(F.col("lang").alias("a"), F.array("source", "lang").alias("b"), F.struct(F.concat(F.lit(" shelf   "), (F.col("doc_id") % 7).cast("string")).alias("c"), "doc_id").alias("d")))
    return _table(spark, sf_dir, "documents").select("doc_id", bibliography.card_values(card).alias("leaves"))


@query("txt_13_sparse_offsets")
def txt_13_sparse_offsets(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", bibliography.sparse_offsets("t").alias("o")).select("id", F.size("o").alias("n"), F.element_at("o", -1).alias("last"))


@query("txt_38_query_folds")
def txt_38_query_folds(spark, sf_dir):
    t = F.col("t")
    return _texts(spark, sf_dir).select("id", F.md5(bibliography.reciter_fold(t)).alias("reciter"), F.md5(bibliography.corpus_fold(t)).alias("corpus"))


# --- files ----------------------------------------------------------------------------------------------


def _read_back(spark, sf_dir, kind: str) -> DataFrame:
    files = sources.as_contents(_table(spark, sf_dir, "documents"), "doc_id", "text", kind)
    rows = sources.read_contents(files, kind).withColumn("t", F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "))).where("t <> ''")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "t"))), lambda x: x["t"]), "\n")
    return rows.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n"), F.md5(lines).alias("lines"))


@query("src_3_docx", _READ)
def src_3_docx(spark, sf_dir):
    return _read_back(spark, sf_dir, "docx")


@query("src_4_epub", _READ)
def src_4_epub(spark, sf_dir):
    return _read_back(spark, sf_dir, "epub")


@query("src_16_ooxml_census", "SELECT doc_id, 'word/document.xml' AS part, CAST(len(string_split(text, chr(10))) AS BIGINT) AS paragraphs FROM documents")
def src_16_ooxml_census(spark, sf_dir):
    files = sources.as_contents(_table(spark, sf_dir, "documents"), "doc_id", "text", "docx")
    return sources.docx_census(files).select(F.col("path").cast("long").alias("doc_id"), "part", "paragraphs")


@query("src_11_catalogue_csv", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN '=1+' || source WHEN 1 THEN 'a \"b\", ' || lang ELSE '-' || source END AS title, source AS author FROM documents")
def src_11_catalogue_csv(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("=1+"), "source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('a "b", '), "lang")).otherwise(F.concat(F.lit("-"), "source"))
    path = shards.new_folder(spark, "catalogue")
    sources.write_catalogue_csv(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), title.alias("title"), F.col("source").alias("author")), path)
    return sources.read_catalogue_csv(spark, path, "id long, title string, author string", "id")


@query("snk_9_catalogue_lines", "SELECT doc_id, md5('\"' || doc_id || '\",\"' || CASE WHEN regexp_matches(f, '^[=+@\\t\\r-]') THEN '''' ELSE '' END || replace(f, '\"', '\"\"') || '\",\"' || source || '\"') AS line FROM (SELECT doc_id, source, replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' ') AS f FROM documents) x")
def snk_9_catalogue_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(sources.catalogue_line(["doc_id", "text", "source"])).alias("line"))


@query("src_17_page_cache", "SELECT CAST(doc_id % 20 AS VARCHAR) AS book, count(*) AS n, count(DISTINCT doc_id) AS pages FROM paragraphs GROUP BY 1")
def src_17_page_cache(spark, sf_dir):
    xml = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.concat(F.lit("<w:p>"), x, F.lit("</w:p>")).alias("xmlString")))
    path = shards.new_folder(spark, "cache")
    pages = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).cast("string").alias("book"), F.col("doc_id").cast("int").alias("page"), xml.alias("ps"))
    pages.write.partitionBy("book").option("compression", "gzip").json(path)
    return shards.page_cache(spark, path).groupBy("book").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"))


# --- shards ---------------------------------------------------------------------------------------------


@query("src_15_term_posting", "SELECT word AS term, doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS at FROM words WHERE word = 'that' GROUP BY ALL")
def src_15_term_posting(spark, sf_dir):
    path = shards.new_folder(spark, "terms")
    shards.write_routed(index.positional_postings(_words(spark, sf_dir)), path, "term", 16)
    found = shards.read_routed(spark, path, shards.POSTING, "term", ["that"], 16)
    return found.select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("at"))


@query("src_12_json_shards", "SELECT doc_id, lang, md5(text) AS text FROM documents WHERE doc_id IN (1, 50, 77, 150)")
def src_12_json_shards(spark, sf_dir):
    path = shards.new_folder(spark, "json")
    shards.write_routed(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path, "doc_id", 16, "json")
    return shards.read_routed(spark, path, "doc_id long, lang string, text string", "doc_id", [1, 50, 77, 150], 16, "json").withColumn("text", F.md5("text"))


@query("snk_2_restored_shard", "SELECT gram, count(*) AS n FROM (SELECT DISTINCT doc_id, ordinal, substr(folded, i, 3) AS gram FROM (SELECT doc_id, ordinal, folded, unnest(range(1, length(folded) - 1)) AS i FROM paragraphs) a) g WHERE gram >= 'tha' AND gram < 'thb' GROUP BY gram")
def snk_2_restored_shard(spark, sf_dir):
    path = shards.new_folder(spark, "grams")
    index.write_index(index.trigram_postings(_paragraphs(spark, sf_dir), ["doc_id", "ordinal"]), path, 8, "gram")
    return spark.read.parquet(path).where("gram >= 'tha' AND gram < 'thb'").groupBy("gram").agg(F.count("*").alias("n"))


@query("snk_3_replaced_books", "WITH r AS (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND doc_id % 2 = 0) SELECT source AS book, CASE WHEN lang = 'en' AND source IN (FROM r) THEN 'new' ELSE 'old' END AS fingerprint, lang AS scope, count(*) AS n FROM documents WHERE lang <> 'en' OR source NOT IN (FROM r) OR doc_id % 2 = 0 GROUP BY ALL")
def snk_3_replaced_books(spark, sf_dir):
    path = shards.new_folder(spark, "books")
    rows = _table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), F.col("source").alias("book"), "doc_id")
    shards.replace_books(rows.withColumn("fingerprint", F.lit("old")), path, ["scope", "book"])
    shards.replace_books(rows.where("scope = 'en' AND doc_id % 2 = 0").withColumn("fingerprint", F.lit("new")), path, ["scope", "book"])
    return spark.read.parquet(path).groupBy("book", "fingerprint", "scope").agg(F.count("*").alias("n"))


@query("snk_5_delta_postings", "SELECT word, count(*) AS n, sum(doc_id) AS ids FROM (SELECT DISTINCT word, doc_id FROM words) x GROUP BY word")
def snk_5_delta_postings(spark, sf_dir):
    blocks = hashing.posting_blocks(_words(spark, sf_dir).select("word", "doc_id").distinct(), "word", "doc_id")
    return hashing.posting_rows(blocks, "word", "doc_id").groupBy("word").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("snk_11_staged_batches", "SELECT doc_id, (k // 1000)::INT AS stage, ((k % 1000) // 100)::INT AS batch, count(*) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM words) x GROUP BY ALL")
def snk_11_staged_batches(spark, sf_dir):
    rows = _words(spark, sf_dir).withColumn("size", F.octet_length("word"))
    return stateful.staged_batches(rows, "doc_id", "pos", "size").groupBy("doc_id", "stage", "batch").agg(F.count("*").alias("n"))


@query("snk_15_sitemaps", f"SELECT page, count(*) AS n, md5('{paging.SITEMAP_HEAD}' || string_agg('<url><loc>https://example.org/books/' || o_orderkey || '</loc><lastmod>' || strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000Z</lastmod></url>', '' ORDER BY o_orderkey) || '{paging.SITEMAP_TAIL}') AS xml FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 + 1 AS page FROM orders) x GROUP BY page")
def snk_15_sitemaps(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return paging.sitemap_pages(orders, "o_orderkey", "d", F.floor(F.col("o_orderkey") / 4096), "https://example.org/books/").withColumn("xml", F.md5("xml"))


# --- choices of a search, pages, ranges -----------------------------------------------------------------

_PHRASE = "and attion to thanedble the"


@query("sch_6_long_phrase", f"SELECT doc_id FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS f FROM documents) x WHERE contains(f, '{_PHRASE}') AND contains(' ' || f || ' ', ' thanedble ') AND contains(' ' || f || ' ', ' attion ')")
def sch_6_long_phrase(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", views.folded(F.col("text")).alias("folded"))
    return search.routed_phrase(docs, _words(spark, sf_dir), _PHRASE).select("doc_id")


@query("sch_5_phrase_anchor", "SELECT p_partkey, CAST(CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS BIGINT) AS anchor, p_size * 100 > 2000 AND list_sort([a, b, c])[2] <= 167772160 AS more FROM (SELECT *, p_size * 4000000 AS a, (p_partkey % 50) * 4000000 AS b, 100000000 AS c FROM part) x")
def sch_5_phrase_anchor(spark, sf_dir):
    sizes = F.array((F.col("p_size") * 4000000).cast("long"), (F.col("p_partkey") % 50 * 4000000).cast("long"), F.lit(100000000).cast("long"))
    return _table(spark, sf_dir, "part").select("p_partkey", paging.phrase_anchor(sizes, F.col("p_size") * 100).alias("a")).select("p_partkey", "a.*")


@query("sch_11_partition_choice", "WITH t AS (SELECT * FROM (VALUES ('nation'), ('thanedble'), ('attion')) v(term)), g AS (SELECT term, place, substr(term, place, 3) AS gram FROM (SELECT term, unnest(range(1, length(term) - 1)) AS place FROM t) a), b AS (SELECT term, place, " + _FNV.format("gram") + " % 512 AS bucket FROM g) SELECT DISTINCT arg_min(bucket, (bucket * 37 % 101) * 1000 + place) AS bucket FROM b GROUP BY term")
def sch_11_partition_choice(spark, sf_dir):
    terms = spark.createDataFrame([("nation",), ("thanedble",), ("attion",)], "term string")
    sizes = spark.range(512).select(F.col("id").alias("bucket"), (F.col("id") * 37 % 101).alias("bytes"))
    return hashing.chosen_partitions(terms, sizes)


@query("srt_14_visible_rows", "SELECT o_orderkey, CASE WHEN n > 0 THEN s ELSE 0 END AS start, CASE WHEN n > 0 THEN least(n, s + 36) ELSE 0 END AS \"end\" FROM (SELECT o_orderkey, n, greatest(0, least(n - 1, greatest(0, y) // 174 - 8)) AS s FROM (SELECT o_orderkey, o_orderkey % 90 AS n, o_orderkey * 7 % 20000 - 100 AS y FROM orders) a) b")
def srt_14_visible_rows(spark, sf_dir):
    rows = paging.visible_rows(F.col("o_orderkey") * 7 % 20000 - 100, F.col("o_orderkey") % 90)
    return _table(spark, sf_dir, "orders").select("o_orderkey", rows.alias("r")).select("o_orderkey", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


@query("srt_15_committed_prefix", "SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_id <= e.event_id AND f.event_id % 11 = 3)")
def srt_15_committed_prefix(spark, sf_dir):
    pages = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 11 != 3).alias("ok"))
    return paging.committed_prefix(pages, "user_id", "event_id", "ok").select("event_id", "user_id")


@query("str_18_next_range", "SELECT o_orderkey, CASE WHEN a < n THEN a END AS first, CASE WHEN a < n THEN least(n, a + 8388608) - 1 END AS last FROM (SELECT o_orderkey, o_orderkey % 40 * 1000000 AS a, 39000000 AS n FROM orders) x")
def str_18_next_range(spark, sf_dir):
    r = paging.next_range((F.col("o_orderkey") % 40 * 1000000).cast("long"), F.lit(39000000).cast("long"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.start").alias("first"), F.col("r.end").alias("last"))
