"""Every query by name, with its oracle where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import folds, hashing, matching, text
from marginalia.operators import index, rules, search, stateful
from marginalia.plans import relational, views
from marginalia.sources import documents as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Strings on which Arabic folding shows; the same ones stand in the oracles.
ARABIC = (
    "إِنَّمَا الأَعْمَالُ بِالنِّيَّات (٣) ـ", "اله", "أله", "الـه", "مَدْرَسَةٌ كُبْرَى", "رؤية، مسائل!", "ΟΔΟΣ Größe", "١٢٣ [45] x", "والكتابات", "بالمدرسة",
    "قال ( ٤ ) نعم ﴿٣﴾ （5） لا", "أحمد مؤمن رئيس", "نور قال الكاتب", "café été", "<p>نص&nbsp;مئة</p>",
)
_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(ARABIC))
_ALL_TEXTS = f"(SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT -1 - i, t FROM (VALUES {_VALUES}) v(i, t)) s"
_M, _T = "[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}\\x{0640}]", "أإآٱ"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = views.oracle(oracle)
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(ARABIC)], "id long, t string")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")).union(own)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.words(_table(spark, sf_dir, "documents"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.paragraphs(_table(spark, sf_dir, "documents"))


def _relational(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views.register(spark, sf_dir, relational.SPARK[name])
        return spark.sql(relational.SPARK[name])

    return run


for _name in relational.SPARK:
    QUERIES[_name] = _relational(_name)
    ORACLES[_name] = views.oracle(relational.DUCK[_name])

# --- folds: a digest of each text's fold, whole texts -------------------------------------------------


def _fold(name: str, fold: Callable[[Column], Column], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(spark, sf_dir).select("id", fold(F.col("t")).alias("f")).select("id", F.md5("f").alias("fold"), F.length("f").cast("long").alias("n"))

    query(name, f"SELECT id, md5(f) AS fold, length(f) AS n FROM (SELECT id, {sql} AS f FROM {_ALL_TEXTS}) x" if sql else None)(run)


_LOW = "lower(replace({0}, 'Σ', 'σ'))"
_WORDS = "trim(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_UNMARK = "regexp_replace({0}, '" + _M.replace("{", "{{").replace("}", "}}") + "', '', 'g')"
_CTRL = "regexp_replace({0}, '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2069}}\\x{{FEFF}}]', '', 'g')"
_BLANK = "[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{0B}}]"
_NOTE = "regexp_replace({0}, '[(\\[{{﴿（]" + _BLANK + "*[0-9٠-٩۰-۹]+" + _BLANK + "*[)\\]}}﴾）]', ' ', 'g')"
_SPACES = "regexp_replace({0}, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{0B}}]+', ' ', 'g')"


def _sql(*steps: str) -> str:
    out = "t"
    for s in steps:
        out = s.format(out)
    return out


_ALEF_YEH = "translate({0}, '" + _T + "ى', 'ااااي')"
_fold("txt_1_search_fold", folds.search_fold, _sql(_NOTE, _UNMARK, _WORDS, _LOW, _ALEF_YEH))
_fold("txt_3_presentation_fold", folds.presentation_fold, _sql(_LOW, _CTRL, _UNMARK, "translate({0}, '" + _T + "ىؤئة" + folds.DIGITS[0] + "', 'اااايويه" + folds.DIGITS[1] + "')", _WORDS))
_fold("txt_33_heading_fold", folds.heading_fold, _sql(_LOW, _UNMARK, _ALEF_YEH, _SPACES))
_fold("txt_9_root_letters", folds.root_letters, "regexp_replace(t, '[^ء-ي]', '', 'g')")
_fold("txt_10_link_fold", lambda c: folds.link_fold(c, False), "replace(regexp_replace(translate(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&[^;]+;', ' ', 'g'), 'أإآٱىؤئ', 'اااايوي'), '[^ء-غف-ي]', '', 'g'), 'ء', '')")
_fold("txt_37_base_title", folds.base_title, None)
_fold("txt_12_reader_fold", folds.reader_fold, _sql("translate({0}, 'یک', 'يك')", _NOTE, _UNMARK, _WORDS, _LOW, _ALEF_YEH))
_fold("txt_5_verse_fold", folds.verse_fold, _sql("nfc_normalize({0})", "replace({0}, 'ـ', '')", "translate({0}, '" + _T + "ىئؤ', 'ااااييو')", _UNMARK, _SPACES, "trim({0})"))
for _n, _f in (("txt_4_author_fold", folds.author_fold), ("txt_6_broad_fold", folds.broad_fold), ("txt_7_facet_fold", folds.facet_fold), ("txt_8_aligner_fold", folds.aligner_fold), ("txt_11_memory_key", folds.memory_key), ("txt_34_toc_key", folds.toc_key), ("txt_35_toc_filter", folds.toc_filter), ("txt_36_work_key", folds.work_key)):
    _fold(_n, _f, None)

# --- terms, grams, distances ---------------------------------------------------------------------------


@query("txt_20_trigrams", "SELECT gram, count(*) AS n FROM (SELECT DISTINCT doc_id, ordinal, substr(folded, i, 3) AS gram FROM (SELECT doc_id, ordinal, folded, unnest(range(1, length(folded) - 1)) AS i FROM paragraphs) a) g GROUP BY gram")
def txt_20_trigrams(spark, sf_dir):
    return index.trigram_postings(_paragraphs(spark, sf_dir), ["doc_id", "ordinal"]).groupBy("gram").agg(F.count("*").alias("n"))


@query("snk_1_trigram_index", "SELECT gram, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, substr(f, i, 3) AS gram FROM (SELECT doc_id, f, unnest(range(1, length(f) - 1)) AS i FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS f FROM documents) x) a) g GROUP BY gram HAVING count(*) > 1")
def snk_1_trigram_index(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", views.folded(F.col("text")).alias("folded"))
    return index.trigram_postings(docs, ["doc_id"]).groupBy("gram").agg(F.count("*").alias("n_docs")).where("n_docs > 1")


@query("txt_17_affixes")
def txt_17_affixes(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", F.explode(F.split(folds.search_fold(F.col("t")), " ")).alias("w")).groupBy("w", text.strip_affixes(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


@query("txt_22_bounded_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, least(levenshtein(a.n_name, b.n_name), 5) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def txt_22_bounded_levenshtein(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").where("i < j").select("a", "b", text.bounded_levenshtein(F.col("a"), F.col("b"), 4).alias("d"))


@query("txt_23_ordered_letters", "SELECT w, count(*) AS n FROM (SELECT word AS w FROM words) x WHERE regexp_matches(w, 't.*h.*e') GROUP BY w")
def txt_23_ordered_letters(spark, sf_dir):
    return _words(spark, sf_dir).where(F.col("word").rlike("t.*h.*e")).groupBy(F.col("word").alias("w")).agg(F.count("*").alias("n"))


@query("txt_24_snippets", "SELECT doc_id, ordinal, CASE WHEN greatest(pos0 - 40, 0) > 0 THEN '…' ELSE '' END || substr(folded, greatest(pos0 - 40, 0) + 1, least(pos0 + 40, length(folded)) - greatest(pos0 - 40, 0)) || CASE WHEN least(pos0 + 40, length(folded)) < length(folded) THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, ordinal, folded, instr(folded, 'that') - 1 AS pos0 FROM paragraphs) p WHERE pos0 >= 0")
def txt_24_snippets(spark, sf_dir):
    p = _paragraphs(spark, sf_dir).withColumn("at", F.instr("folded", "that") - 1).where("at >= 0")
    return p.select("doc_id", "ordinal", text.snippet(F.col("folded"), F.col("at")).alias("snippet"))


@query("txt_27_segments")
def txt_27_segments(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.explode(text.segments(F.col("text"))).alias("s"))
    return d.select("doc_id", "s.id", F.md5("s.source").alias("source"), F.length("s.source").alias("n"))


@query("txt_32_paths", "SELECT doc_id, CASE WHEN p LIKE '/%' OR p LIKE '%..%' THEN NULL ELSE p END AS path FROM (SELECT doc_id, replace(CASE WHEN doc_id % 9 = 0 THEN '/' WHEN doc_id % 9 = 1 THEN '..\\' ELSE '' END || source || '\\' || lang, '\\', '/') AS p FROM documents) x")
def txt_32_paths(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    raw = F.concat(F.when(F.col("doc_id") % 9 == 0, "/").when(F.col("doc_id") % 9 == 1, "..\\").otherwise(""), "source", F.lit("\\"), "lang")
    p = F.translate(raw, "\\", "/")
    return d.select("doc_id", F.when(F.startswith(p, F.lit("/")) | F.contains(p, F.lit("..")), None).otherwise(p).alias("path"))


@query("fn_5_canonical_json")
def fn_5_canonical_json(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", hashing.canonical_hash(["n_name", "n_regionkey", "n_nationkey"]).alias("h"))


@query("fn_14_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_14_json(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("fn_16_array_utilities", "SELECT conv_id, len(list_distinct(list(role))) AS n_roles, count(*) AS n FROM conversations GROUP BY conv_id")
def fn_16_array_utilities(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.size(F.array_distinct(F.collect_list("role"))).cast("long").alias("n_roles"), F.count("*").alias("n"))


# --- search --------------------------------------------------------------------------------------------


@query("sch_1_shard_search", "SELECT doc_id, ordinal, instr(folded, 'that the') - 1 AS at FROM paragraphs WHERE folded LIKE '%that the%'")
def sch_1_shard_search(spark, sf_dir):
    return search.shard_search(_paragraphs(spark, sf_dir), "that the", ["doc_id", "ordinal"]).select("doc_id", "ordinal", "at")


@query("sch_4_phrase_search", "SELECT a.doc_id, a.pos AS start FROM words a JOIN words b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN words c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 WHERE a.word = 'of' AND b.word = 'the' AND c.word = 'and'")
def sch_4_phrase_search(spark, sf_dir):
    return search.phrase_search(_words(spark, sf_dir), ["of", "the", "and"])


@query("sch_9_heading_search", "SELECT a.doc_id, a.pos AS start FROM words a JOIN words b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN words c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 WHERE a.word LIKE '%ing' AND b.word = 'the' AND c.word LIKE 'th%'")
def sch_9_heading_search(spark, sf_dir):
    return search.heading_search(_words(spark, sf_dir), ["ing", "the", "th"])


@query("sch_7_page_with_total", "SELECT doc_id, ordinal, count(*) OVER () AS total FROM paragraphs WHERE folded LIKE '%with%' ORDER BY doc_id, ordinal LIMIT 40 OFFSET 20")
def sch_7_page_with_total(spark, sf_dir):
    hits = search.shard_search(_paragraphs(spark, sf_dir), "with", ["doc_id", "ordinal"])
    return search.counted(hits, [F.col("doc_id"), F.col("ordinal")], 20, 40).select("doc_id", "ordinal", "total")


@query("sch_18_in_book")
def sch_18_in_book(spark, sf_dir):
    return search.in_book(_table(spark, sf_dir, "documents"), "the")


@query("agg_26_occurrence_counts", "SELECT doc_id, CAST((length(f) - length(replace(f, 'the', ''))) / 3 AS INTEGER) AS n FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS f FROM documents) x WHERE contains(f, 'the')")
def agg_26_occurrence_counts(spark, sf_dir):
    return search.occurrence_counts(_table(spark, sf_dir, "documents"), "the")


@query("agg_17_corpus_census", "SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS letters, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[.,;:!?]')) AS marks, round(len(regexp_extract_all(text, '[.,;:!?]')) * 1.0 / greatest(1, len(regexp_extract_all(text, '\\p{L}'))), 6) AS density FROM documents")
def agg_17_corpus_census(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return d.select("doc_id", n(r"\p{L}").alias("letters"), n("[0-9]").alias("digits"), n("[.,;:!?]").alias("marks"), F.round(n("[.,;:!?]") / F.greatest(F.lit(1), n(r"\p{L}")), 6).alias("density"))


@query("agg_19_element_census", "SELECT count(*) AS pages, CAST(sum(len(regexp_extract_all(html, '<p[ >]'))) AS BIGINT) AS paragraphs, CAST(sum(len(regexp_extract_all(html, '<li[ >]'))) AS BIGINT) AS items, CAST(sum(CASE WHEN regexp_matches(html, '<script[ >]') THEN 1 ELSE 0 END) AS BIGINT) AS with_script FROM pages")
def agg_19_element_census(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.agg(F.count("*").alias("pages"), F.sum(F.regexp_count("html", F.lit("<p[ >]"))).alias("paragraphs"), F.sum(F.regexp_count("html", F.lit("<li[ >]"))).alias("items"), F.count_if(F.col("html").rlike("<script[ >]")).alias("with_script"))


@query("agg_23_ordered_checksum")
def agg_23_ordered_checksum(spark, sf_dir):
    return stateful.ordered_checksum(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("agg_28_json_aggregate", "SELECT source, count(*) AS n, '[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) || ']' AS ids FROM documents GROUP BY source")
def agg_28_json_aggregate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list("doc_id"))).alias("ids"))


@query("agg_30_map_totals", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS left_over FROM events")
def agg_30_map_totals(spark, sf_dir):
    m = F.map_values(F.from_json("props", "map<string,long>"))
    return _table(spark, sf_dir, "events").select("event_id", F.aggregate(m, F.lit(0).cast("long"), lambda a, b: a + b).alias("left_over"))


@query("agg_37_series", "SELECT source, string_agg(CAST(doc_id AS VARCHAR), '>' ORDER BY n_chars, doc_id) AS chain FROM documents GROUP BY source HAVING count(*) >= 2")
def agg_37_series(spark, sf_dir):
    g = _table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("n_chars", "doc_id"))).alias("x"))
    return g.where(F.size("x") >= 2).select("source", F.array_join(F.transform("x", lambda s: s["doc_id"].cast("string")), ">").alias("chain"))


@query("joi_18_as_of", "SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def joi_18_as_of(spark, sf_dir):
    marks = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.min("o_orderkey").alias("o_orderkey"))
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return search.as_of(rows, marks, ["user_id"], "ts", "o_orderkey").select("event_id", "o_orderkey")


@query("joi_12_reconcile")
def joi_12_reconcile(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").dropDuplicates(["doc_id"])
    was = d.where("n_chars > 200").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id")).alias("path"), F.md5("text").alias("identity"))
    now = d.where("n_chars < 9000").select(F.concat_ws("/", F.when(F.col("lang") == "en", F.col("source")).otherwise(F.col("lang")), F.col("doc_id")).alias("path"), F.md5("text").alias("identity"))
    return stateful.reconciled(was, now)


@query("win_7_batch_boundaries")
def win_7_batch_boundaries(spark, sf_dir):
    return stateful.packed_groups(_table(spark, sf_dir, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", "n", 1000)


@query("win_15_segment_packing")
def win_15_segment_packing(spark, sf_dir):
    p = _paragraphs(spark, sf_dir).withColumn("n", F.length("text"))
    return stateful.packed_groups(p, "doc_id", "ordinal", "n", 2000)


@query("win_13_interval_coalescing")
def win_13_interval_coalescing(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("a")).withColumn("b", F.col("a") + 1000)
    return stateful.coalesced_ranges(e, "user_id", "a", "b", 3_600_000, 86_400_000)


@query("str_2_debounce", "SELECT user_id, generation, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT user_id, ts, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS generation FROM (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 7200000000 THEN 1 ELSE 0 END AS fresh FROM events) a) b GROUP BY user_id, generation")
def str_2_debounce(spark, sf_dir):
    return stateful.stable_batches(_table(spark, sf_dir, "events"), "user_id", "ts", 7_200_000)


@query("src_9_markdown", "SELECT doc_id, count(*) AS n FROM paragraphs WHERE NOT regexp_matches(text, '^#{1,6}\\s') GROUP BY doc_id")
def src_9_markdown(spark, sf_dir):
    return sources.markdown(_table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("src_10_plain_text", "SELECT doc_id, ordinal, md5(text) AS h FROM (SELECT doc_id, i - 1 AS ordinal, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n+') AS ls FROM documents) a) b WHERE trim(ls[i]) <> '') x")
def src_10_plain_text(spark, sf_dir):
    return sources.plain(_table(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.md5("text").alias("h"))


@query("src_8_html_paragraphs")
def src_8_html_paragraphs(spark, sf_dir):
    @F.udf("array<string>", useArrow=True)
    def cut(html: str) -> list[str]:
        return sources._markup_paragraphs(html or "")

    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(cut("html")).alias("ordinal", "text"))


@query("src_19_seeded_sample")
def src_19_seeded_sample(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "source").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(100)


@query("str_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_windowed_counts(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


# --- rules of the reference's own tables, on the tables at hand ------------------------------------------

_FNV = "list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query("fn_1_fnv_bucket", "SELECT word, h, lpad(CAST(h % 512 AS VARCHAR), 4, '0') AS bucket FROM (SELECT word, " + _FNV.format("word") + " AS h FROM (SELECT DISTINCT word FROM words) a) b")
def fn_1_fnv_bucket(spark, sf_dir):
    return _words(spark, sf_dir).select("word").distinct().select("word", hashing.fnv1a(F.col("word")).alias("h"), hashing.bucket(F.col("word"), 512).alias("bucket"))


@query("fn_2_gram_buckets", "SELECT DISTINCT word, " + _FNV.format("substr(word, i, 3)") + " % 512 AS bucket FROM (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM (SELECT DISTINCT word FROM words WHERE length(word) >= 3) a) b")
def fn_2_gram_buckets(spark, sf_dir):
    return _words(spark, sf_dir).select("word").distinct().select("word", F.explode(hashing.gram_buckets(F.col("word"))).alias("bucket"))


@query("fn_3_bloom_positions")
def fn_3_bloom_positions(spark, sf_dir):
    w = _words(spark, sf_dir).where("word = 'that'")
    return w.select("doc_id", "pos", F.to_json(hashing.bloom_positions(1 << 20)(F.col("doc_id").cast("string"), F.col("pos").cast("long"))).alias("bits"))


@query("snk_7_bloom_build")
def snk_7_bloom_build(spark, sf_dir):
    return hashing.bloom_filters(_words(spark, sf_dir).where("word in ('that', 'with', 'the')").select("word", "doc_id", "pos"))


@query("flt_14_bloom_membership", "SELECT word, count(*) AS n, count(*) AS n_may FROM words WHERE word IN ('that', 'with') GROUP BY word")
def flt_14_bloom_membership(spark, sf_dir):
    at = _words(spark, sf_dir).where("word in ('that', 'with')").select("word", "doc_id", "pos")
    return hashing.bloom_members(hashing.bloom_filters(at), at).groupBy("word").agg(F.count("*").alias("n"), F.count_if("may").alias("n_may"))


@query("txt_18_derived_terms")
def txt_18_derived_terms(spark, sf_dir):
    q = _texts(spark, sf_dir).select("id", F.substring_index("t", "\n", 1).alias("q"))
    return q.select("id", *[text.derive_term(F.col("q"), m).alias(m) for m in ("exact", "morphological", "root")])


@query("txt_21_trigram_dice")
def txt_21_trigram_dice(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.dice(F.col("text"), F.col("next")), 6).alias("dice"))


@query("txt_2_fold_offsets")
def txt_2_fold_offsets(spark, sf_dir):
    f = _texts(spark, sf_dir).select("id", matching.folded_with_offsets("t").alias("f"))
    return f.select("id", F.md5("f.folded").alias("fold"), F.size("f.offsets").cast("long").alias("n"), F.aggregate("f.offsets", F.lit(0).cast("long"), lambda a, x: a + x).alias("offsets"))


@query("txt_25_match_ranges")
def txt_25_match_ranges(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(matching.match_ranges(F.col("text"), "the")).alias("r")).select("doc_id", "r.start", "r.end")


@query("txt_25_centred_excerpt")
def txt_25_centred_excerpt(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", matching.centred_excerpt(F.col("text"), "that").alias("excerpt"))


@query("txt_26_phrase_offsets")
def txt_26_phrase_offsets(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(matching.phrase_offsets(F.col("text"), "of the")).alias("at"))


@query("txt_15_clean_text")
def txt_15_clean_text(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(matching.clean_plain(F.col("html"))).alias("plain"), F.md5(matching.clean_search(F.col("html"))).alias("search"), F.size(matching.narrator_ids(F.col("html"))).alias("n_narrators"))


@query("txt_16_footnotes")
def txt_16_footnotes(spark, sf_dir):
    own = spark.createDataFrame([(-1, "متن (١) آخر\n____\n(١) حاشية"), (-2, "متن\n(١) أولى\n(٢) ثانية"), (-3, "متن (١) فقط")], "id long, t string")
    t = _texts(spark, sf_dir).where("id >= 0").union(own).select("id", matching.body_and_notes(F.col("t")).alias("x"))
    return t.select("id", F.length("x.body").alias("n_body"), F.length("x.notes").alias("n_notes"))


@query("agg_36_first_difference", """SELECT conv_id, turn, a = b AS identical, CAST(coalesce(min(CASE WHEN substr(a, i, 1) <> substr(b, i, 1) THEN i END) - 1, length(a)) AS INTEGER) AS "offset" FROM (SELECT conv_id, turn, trim(text) AS a, trim(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS b, unnest(range(1, length(text) + 2)) AS i FROM conversations) x WHERE b <> '' AND a <> '' GROUP BY conv_id, turn, a, b""".replace("trim(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS b, unnest(range(1, length(text) + 2)) AS i FROM conversations", "trim(following) AS b, unnest(range(1, length(text) + 2)) AS i FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations) y"))
def agg_36_first_difference(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").withColumn("following", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    d = c.select("conv_id", "turn", matching.first_difference("text", "following").alias("d"))
    return d.where("d.available").select("conv_id", "turn", "d.identical", "d.offset")


@query("flt_1_query_parser", "SELECT doc_id, ordinal FROM paragraphs WHERE folded LIKE '%of the%' AND NOT folded LIKE '%with%' AND NOT folded LIKE '%for%'")
def flt_1_query_parser(spark, sf_dir):
    q = search.parse_query('"of the" -with -WITH -"FOR"')
    return search.shard_search(_paragraphs(spark, sf_dir), q.phrase, ["doc_id", "ordinal"], q.excluded).select("doc_id", "ordinal")


@query("sch_15_verse_ranking", """SELECT doc_id, ordinal, CASE WHEN f = 'that' THEN 100 WHEN concat(' ', f) LIKE '% that%' THEN 92 WHEN f LIKE '%that%' THEN 86 WHEN length(f) <= 10 AND regexp_matches(replace(f, ' ', ''), 't.*h.*a.*t') THEN 68
  WHEN d <= 1 THEN 60 - 5 * d END AS score FROM (SELECT doc_id, ordinal, f, list_min(list_transform(string_split(f, ' '), lambda t: levenshtein(t, 'that'))) AS d FROM (SELECT doc_id, ordinal, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS f FROM paragraphs) a) b WHERE score IS NOT NULL""".replace("\\\\s", "\\s"))
def sch_15_verse_ranking(spark, sf_dir):
    return search.verse_ranking(_paragraphs(spark, sf_dir), "that").select("doc_id", "ordinal", "score")


@query("joi_16_shingle_votes", "SELECT d.doc_id, b.item_id, count(*) AS votes FROM probes60 b JOIN (SELECT DISTINCT doc_id, gram FROM grams20) d ON b.gram = d.gram JOIN (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS f FROM documents) t ON t.doc_id = d.doc_id WHERE contains(t.f, b.whole) GROUP BY d.doc_id, b.item_id HAVING count(*) >= 2")
def joi_16_shingle_votes(spark, sf_dir):
    return views.shingle_votes(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("joi_19_alias_chains", "WITH RECURSIVE c AS (SELECT p_partkey AS alias, p_partkey // 16 AS place, 1 AS hops FROM part WHERE p_partkey > 0 UNION ALL SELECT alias, place // 16, hops + 1 FROM c WHERE place > 0) SELECT alias, place AS target, hops FROM c WHERE place = 0")
def joi_19_alias_chains(spark, sf_dir):
    p = _table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("alias"), F.floor(F.col("p_partkey") / 16).cast("long").alias("target"))
    return stateful.resolved_aliases(p)


@query("joi_17_page_alignment")
def joi_17_page_alignment(spark, sf_dir):
    lines = _paragraphs(spark, sf_dir).select(F.col("doc_id").alias("book"), "ordinal", "text")
    pages = lines.where("ordinal % 3 = 0").select("book", F.col("ordinal").alias("page"), "text")
    return rules.aligned_pages(pages, lines)


@query("agg_22_schema_groups", "SELECT fingerprint, count(*) AS n, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS paths FROM (SELECT user_id, sha256('[' || string_agg('{\"name\":\"' || event_type || '\",\"kind\":\"' || k || '\"}', ',' ORDER BY event_type) || ']') AS fingerprint FROM (SELECT DISTINCT user_id, event_type, CASE WHEN event_type = 'view' THEN 'text' ELSE 'real' END AS k FROM events WHERE event_id % 97 = user_id % 97) a GROUP BY user_id) b GROUP BY fingerprint")
def agg_22_schema_groups(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("event_id % 97 = user_id % 97").select("user_id", F.col("event_type").alias("name"), F.expr("CASE WHEN event_type = 'view' THEN 'text' ELSE 'real' END").alias("kind"))
    return rules.schema_groups(e, by="user_id").withColumn("paths", F.array_join(F.col("paths").cast("array<string>"), ","))


@query("agg_24_root_lists", "SELECT root, doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (SELECT doc_id, pos, translate(word, 'aeiou', '') AS root FROM words) w WHERE root <> '' GROUP BY root, doc_id")
def agg_24_root_lists(spark, sf_dir):
    return rules.root_postings(_words(spark, sf_dir), F.translate("word", "aeiou", "")).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("sch_23_root_lookup", "SELECT doc_id, pos FROM words WHERE translate(word, 'aeiou', '') = 'th'")
def sch_23_root_lookup(spark, sf_dir):
    return rules.root_lookup(rules.root_postings(_words(spark, sf_dir), F.translate("word", "aeiou", "")), "th")


@query("agg_43_verse_ranges", "SELECT doc_id % 120 AS surah, count(*) AS n, min(doc_id % 50) AS first_verse, max(n_chars % 50) AS last_verse FROM documents WHERE doc_id % 120 BETWEEN 1 AND 114 AND doc_id % 50 >= 1 AND n_chars % 50 >= doc_id % 50 GROUP BY 1")
def agg_43_verse_ranges(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").withColumn("related", F.expr("concat('x,', doc_id % 120, ':', doc_id % 50, '-', n_chars % 50, ',9:1-2')"))
    return rules.verse_segments(d).groupBy(F.col("surah").cast("long").alias("surah")).agg(F.count("*").alias("n"), F.min("first").cast("long").alias("first_verse"), F.max("last").cast("long").alias("last_verse"))


@query("agg_34_editions", "WITH e AS (SELECT doc_id, source AS work, lang, 'publisher:' || lang AS t1, CASE WHEN doc_id % 5 > 0 THEN 'volumes:' || (doc_id % 5) END AS t2 FROM documents), o AS (SELECT *, CASE WHEN t2 IS NULL THEN 1 ELSE 2 END AS k FROM e), kept AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.work = o.work AND p.t1 = o.t1 AND (o.t2 IS NULL OR p.t2 = o.t2) AND (p.k > o.k OR p.doc_id > o.doc_id))) SELECT doc_id AS id, n AS n_editions FROM (SELECT doc_id, count(*) OVER (PARTITION BY work) AS n FROM kept) x WHERE n >= 2")
def agg_34_editions(spark, sf_dir):
    none = F.lit(None).cast("string")
    books = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("work"), F.col("source").alias("author_id"), F.lit("").alias("author"), none.alias("edition"), F.col("lang").alias("publisher"), none.alias("investigator"), none.alias("print_source"), (F.col("doc_id") % 5).alias("volumes"), F.lit(0).alias("pages"))
    return rules.edition_groups(books).select("id", "n_editions")


@query("win_14_range_batches")
def win_14_range_batches(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.col("user_id") % 3).alias("owner"), (F.col("event_id") * 997).alias("a")).withColumn("b", F.col("a") + 400)
    return stateful.coalesced_ranges(e, "owner", "a", "b", 1025, 65_535)


@query("str_1_event_normalisation", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'move' WHEN 1 THEN 'remove' WHEN 2 THEN 'replace' ELSE 'upsert' END AS kind, 'books/' || user_id || '/' || event_type || CASE WHEN event_id % 11 = 2 THEN '.old' ELSE '.docx' END AS path, CASE WHEN event_id % 5 = 0 THEN 'books/old.tmp' END AS previous_path FROM events WHERE event_id % 11 NOT IN (0, 1)")
def str_1_event_normalisation(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN 'renamed' WHEN 1 THEN 'deleted' WHEN 2 THEN 'replaced' WHEN 3 THEN 'created' ELSE 'modified' END")
    name = F.expr("concat(CASE WHEN event_id % 11 = 0 THEN '~$' ELSE '' END, event_type, CASE event_id % 11 WHEN 1 THEN '.TMP' WHEN 2 THEN '.old' ELSE '.docx' END)")
    raw = e.select("event_id", kind.alias("kind"), F.concat(F.lit("books\\.\\"), F.col("user_id"), F.lit("//"), name).alias("path"), F.when(F.col("event_id") % 5 == 0, "books/old.tmp").alias("previous_path"))
    return rules.source_events(raw).select("event_id", "kind", "path", "previous_path")


_REVISIONS = "event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'r' || (event_id % 3) END AS base, CASE WHEN event_id % 4 = 0 AND event_id % 8 = 0 THEN NULL ELSE 'r' || (event_id % 3 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) END AS active, CASE WHEN event_id % 7 = 0 THEN 'op' END AS by_operation, CASE WHEN event_id % 6 < 3 THEN 'r' || (event_id % 4) END AS by_fingerprint"


@query("str_3_revision_decision", "SELECT event_id, d AS decision FROM (SELECT event_id, CASE WHEN by_operation IS NULL THEN CASE WHEN coalesce(by_fingerprint = active, false) THEN 'unchanged' WHEN base IS DISTINCT FROM active THEN 'create-conflicted-revision' WHEN by_fingerprint IS NULL THEN 'create-revision' ELSE 'reuse-content' END ELSE 'replay-operation' END AS d FROM (SELECT " + _REVISIONS + " FROM events) r) x")
def str_3_revision_decision(spark, sf_dir):
    return rules.revision_decisions(_table(spark, sf_dir, "events").selectExpr(*[x.strip() for x in _REVISIONS.replace("event_id, ", "event_id;", 1).replace(" AS base, ", " AS base;").replace(" AS active, ", " AS active;").replace(" AS by_operation, ", " AS by_operation;").split(";")])).select("event_id", "decision")


@query("str_5_enqueue_replay", "SELECT event_id AS operation_id, CASE WHEN event_id % 3 = 0 THEN 'replay' ELSE 'enqueue' END AS decision FROM events")
def str_5_enqueue_replay(spark, sf_dir):
    work = _table(spark, sf_dir, "events").select(F.col("event_id").alias("operation_id"), F.col("user_id").alias("book_id"), F.col("event_type").alias("kind"), F.md5("props").alias("digest"))
    return rules.enqueue_decisions(work, work.where("operation_id % 3 = 0")).select("operation_id", "decision")


@query("str_14_snapshot_fence", "SELECT count(*) AS n, max(o_orderkey) AS newest FROM orders")
def str_14_snapshot_fence(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    state = lambda: orders.agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))
    return rules.fenced(state, state)


@query("set_7_counter_merge", """WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS ms, CAST(ts AS DATE) AS d, event_id % 2 AS side FROM events),
n AS (SELECT user_id, event_type, max(n) AS n FROM (SELECT user_id, side, event_type, count(*) AS n FROM e GROUP BY 1, 2, 3) a GROUP BY 1, 2),
c AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM n GROUP BY 1),
l AS (SELECT user_id, max(ms) AS last_at FROM e GROUP BY 1),
d AS (SELECT user_id, count(*) AS n_days, max(d) AS last_day FROM (SELECT DISTINCT user_id, d FROM e) y GROUP BY 1)
SELECT user_id, counts, last_at, n_days, CAST(last_day AS VARCHAR) AS last_day FROM c JOIN l USING (user_id) JOIN d USING (user_id)""")
def set_7_counter_merge(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("d", F.to_date("ts").cast("string"))
    books = F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "event_id")), False), lambda x: x["event_id"].cast("string"))), 1, 50)

    def side(of: int) -> DataFrame:
        rows = e.where(F.col("event_id") % 2 == of)
        counts = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
        return rows.groupBy("user_id").agg(F.max_by(F.col("event_id").cast("string"), "at").alias("last_book"), F.max("at").alias("last_at"), books.alias("opened"), F.collect_set("d").alias("days"), F.map_from_arrays(F.array(F.first("event_type")), F.array(F.array_sort(F.collect_set(F.col("event_id").cast("int") % 7)))).alias("bookmarks")).join(counts, "user_id")

    out = rules.merged_reading(side(0), side(1))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return out.select("user_id", shown.alias("counts"), "last_at", F.size("days").cast("long").alias("n_days"), F.element_at("days", -1).alias("last_day"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrase search with exclusions over folded paragraphs, totals and a stable first page."""
    hits = search.shard_search(_paragraphs(spark, sf_dir), "of the", ["doc_id", "ordinal"], ("with",))
    page = search.counted(hits, [F.col("doc_id"), F.col("ordinal")], 0, 40)
    return page.select("doc_id", "ordinal", "at", text.snippet(F.col("folded"), F.col("at")).alias("snippet"), "total")
