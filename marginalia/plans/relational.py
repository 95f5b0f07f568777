"""Relational pack: joins, aggregates, windows, sorts, paging and set operations over the catalogue tables.

Each entry is a declarative statement; SPARK holds what Spark runs. Where the dialects differ, DUCK holds the
independent wording for the oracle; otherwise both engines read the same standard SQL. Tables stand in for the
library's entities: customers are accounts, orders are their uploads, line items are editorial overrides (line number:
revision, return flag R: withdrawn), events are visits and watch events, documents are books.
"""

from __future__ import annotations

SPARK: dict[str, str] = {}
DUCK: dict[str, str] = {}


def both(name: str, sql: str, duck: str | None = None) -> None:
    SPARK[name], DUCK[name] = sql, duck or sql


# --- filters ---------------------------------------------------------------------------------------
both("flt_4_metadata_predicate", """
SELECT doc_id, source, lang, n_chars FROM documents
WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'fr') AND doc_id % 1400 + 1 BETWEEN 100 AND 900 AND n_chars > 50""")
both("flt_5_scope_coverage", """
SELECT d.source, count(*) AS n_books, sum(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) AS n_covered, min(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) = 1 AS coverage_complete
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id WHERE d.lang = 'en' GROUP BY d.source""")
both("flt_6_library_filter", """
SELECT doc_id, source, lang FROM documents
WHERE lower(concat_ws(' ', source, lang)) LIKE '%src1%' AND lang <> 'de' AND (doc_id % 7 <> 0 AND doc_id % 1400 + 1 >= 10 OR doc_id % 7 = 0)""")
both("flt_7_category_sentinel", """
SELECT coalesce(nullif(trim(CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE source END), ''), 'uncategorised') AS category, count(*) AS n FROM documents GROUP BY 1""")
both("flt_9_facet_equality", """
SELECT DISTINCT event_type, user_id FROM events WHERE event_type = 'click' OR user_id % 10 = 3""")
both("flt_10_public_visibility", """
SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE o.o_orderstatus = 'F'
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
both("flt_11_editorial_overlay", """
SELECT o.o_orderkey, coalesce(nullif(v.flag, ''), o.o_orderstatus) AS status
FROM orders o LEFT JOIN (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END) AS flag FROM lineitem GROUP BY l_orderkey) v ON v.l_orderkey = o.o_orderkey""")
both("flt_16_conditional_flags", """
SELECT c.c_custkey, CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS band,
  EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AS has_pending FROM customer c""")
both("flt_17_temporary_names", """
SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('~$', source) WHEN 1 THEN concat(source, '.tmp') WHEN 2 THEN concat(source, '.swp') WHEN 3 THEN concat('.~lock.', source) ELSE concat(source, '.docx') END AS name FROM documents) n
WHERE NOT (name LIKE '~$%' OR name LIKE '.~lock.%' OR name LIKE '%.tmp' OR name LIKE '%.swp' OR name LIKE '%.part')""")
both("flt_18_keyset_predicate", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' OR (o_orderdate = TIMESTAMP '1996-01-01 00:00:00' AND o_orderkey < 500)""")
both("flt_19_audience", """
SELECT c_custkey FROM customer c WHERE c_mktsegment <> 'MACHINERY' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
# --- joins -----------------------------------------------------------------------------------------
both("joi_1_five_way_join", """
SELECT n.n_name, r.r_name, c.c_mktsegment, count(*) AS n_lines, round(sum(l.l_extendedprice), 2) AS total
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE o.o_orderstatus = 'F' GROUP BY n.n_name, r.r_name, c.c_mktsegment""")
both("joi_2_left_join_on", """
SELECT c.c_custkey, count(o.o_orderkey) AS n_open FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey""")
both("joi_3_coverage_gap", """
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL""")
both("joi_4_alias_anti_join", """
WITH hidden AS (SELECT DISTINCT CASE l_linenumber WHEN 1 THEN concat('central-submission:', l_orderkey) WHEN 2 THEN concat('account-book:', l_orderkey) ELSE CAST(l_orderkey AS STRING) END AS alias FROM lineitem WHERE l_returnflag = 'R'),
aliases AS (SELECT o_orderkey, CAST(o_orderkey AS STRING) AS alias FROM orders UNION ALL SELECT o_orderkey, concat('central-submission:', o_orderkey) FROM orders UNION ALL SELECT o_orderkey, concat('account-book:', o_orderkey) FROM orders)
SELECT b.o_orderkey FROM orders b WHERE NOT EXISTS (SELECT 1 FROM aliases a JOIN hidden h ON h.alias = a.alias WHERE a.o_orderkey = b.o_orderkey)""")
both("joi_5_semi_join", """
SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)""")
both("joi_6_latest_per_key", """
SELECT o_orderkey, l_returnflag, l_linenumber FROM (
SELECT o.o_orderkey, l.l_returnflag, l.l_linenumber, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l.l_linenumber DESC, l.l_partkey, l.l_suppkey) AS k
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey) x WHERE k = 1""")
both("joi_7_view_and_pinned", """
WITH eligible AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P')
SELECT c_custkey FROM customer c WHERE c_custkey IN (SELECT o_custkey FROM eligible) AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c.c_custkey AND p.o_orderstatus = 'P')""")
both("joi_8_hit_to_metadata", """
SELECT l.doc_id, l.toxic, d.source, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 0""")
both("joi_13_bridge", """
SELECT DISTINCT n.n_name, k.key_of, k.role FROM (SELECT c_nationkey AS nk, c_custkey AS key_of, 'author' AS role FROM customer UNION SELECT s_nationkey, s_suppkey, 'coauthor' FROM supplier) k JOIN nation n ON n.n_nationkey = k.nk""")
both("joi_15_unique_name", """
SELECT d.doc_id, u.doc_id AS linked FROM documents d JOIN (SELECT n_chars, min(doc_id) AS doc_id FROM documents GROUP BY n_chars HAVING count(*) = 1) u ON u.n_chars = d.n_chars + 1""")
both("joi_20_slug_routes", """
SELECT d.doc_id, a.slug, min(a.priority) AS priority FROM documents d JOIN (
SELECT doc_id, concat(source, '-', doc_id) AS slug, 0 AS priority FROM documents UNION ALL SELECT doc_id, concat('book-', doc_id), 1 FROM documents WHERE doc_id % 3 = 0) a ON a.doc_id = d.doc_id GROUP BY d.doc_id, a.slug""")
both("joi_21_override_merge", """
SELECT coalesce(r.k, l.k) AS k, coalesce(l.category, r.category, 'general') AS category, CASE WHEN l.k IS NULL THEN 'remote' WHEN r.k IS NULL THEN 'local' ELSE 'both' END AS origin
FROM (SELECT doc_id AS k, source AS category FROM documents WHERE n_chars > 800) r FULL OUTER JOIN (SELECT doc_id AS k, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS category FROM documents WHERE n_chars < 2500) l ON l.k = r.k""")
both("joi_23_facet_override", """
SELECT b.doc_id, CASE WHEN o.doc_id IS NOT NULL THEN o.places ELSE b.source END AS places FROM documents b LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN '' ELSE 'reviewed' END AS places FROM labels) o ON o.doc_id = b.doc_id""")
both("joi_24_match_by_hash", """
WITH l AS (SELECT min(doc_id) AS local_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 0 GROUP BY md5(text)), r AS (SELECT min(doc_id) AS remote_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 1 GROUP BY md5(text))
SELECT l.local_id, r.remote_id FROM l LEFT JOIN r ON r.h = l.h UNION ALL SELECT NULL, r.remote_id FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.h = r.h)""")
both("joi_25_usage_quota", """
SELECT c.c_custkey, u.used, greatest(c.c_acctbal * 100, 0) AS quota, u.used > greatest(c.c_acctbal * 100, 0) AS over FROM customer c JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS used FROM orders GROUP BY o_custkey) u ON u.o_custkey = c.c_custkey""")
both("joi_26_catalogue_inversion", """
SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers, min(l_suppkey) AS first_supplier, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY l_partkey""")
# --- aggregates ------------------------------------------------------------------------------------
both("agg_1_account_counts", """
SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS n_open, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_done FROM orders GROUP BY o_custkey""")
both("agg_2_global_stats", """
SELECT count(*) AS n, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS n_toxic, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS n_low, sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS n_both FROM labels""")
both("agg_3_status_counts", """
SELECT count_if(o_orderstatus = 'O') AS n_ready, count_if(o_orderstatus = 'F') AS n_final, count_if(o_orderstatus = 'P') AS n_pending FROM orders""")
both("agg_4_country_histogram", """
SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_custkey >= (SELECT min(o_custkey) FROM orders WHERE o_totalprice > 50000) GROUP BY n.n_name""")
both("agg_5_bands_suppressed", """
SELECT band, n FROM (SELECT CASE WHEN p_size < 13 THEN 'under 13' WHEN p_size < 18 THEN '13-17' WHEN p_size < 25 THEN '18-24' WHEN p_size < 35 THEN '25-34' ELSE '35+' END AS band, count(*) AS n FROM part GROUP BY 1) b WHERE n >= 5""")
both("agg_6_average_with_floor", """
SELECT n_nationkey, CASE WHEN n >= 5 THEN mean END AS average FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_nationkey) a""")
both("agg_7_distinct_visitors", """
SELECT count(DISTINCT user_id) + 1000 AS visitors, count(*) AS visits FROM events""")
both("agg_8_version_fingerprint", """
SELECT count(*) AS n, sum(o_orderkey) AS s, max(o_orderdate) AS newest, max(o_orderkey) AS top FROM orders""")
both("agg_10_hits_per_book", """
SELECT doc_id, count(*) AS n FROM paragraphs WHERE folded LIKE '%the%' GROUP BY doc_id""")
both("agg_11_facet_directory", """
SELECT lower(source) AS facet, count(DISTINCT lang) AS n_authors, min(source) AS label FROM documents GROUP BY lower(source)""")
both("agg_12_gateway_counts", """
SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang""")
both("agg_13_works_by_category", """
SELECT source, n, row_number() OVER (ORDER BY CASE WHEN source IN ('src0', 'src9') THEN 1 ELSE 0 END, n DESC, source) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) g""")
both("agg_14_by_day", """
SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY CAST(ts AS DATE)""")
both("agg_15_catalogue_summary", """
SELECT count(*) AS n_books, CASE WHEN min(CASE WHEN n_chars >= 0 THEN 1 ELSE 0 END) = 1 THEN sum(n_chars) END AS chars,
  CASE WHEN min(CASE WHEN doc_id % 7 <> 0 THEN 1 ELSE 0 END) = 1 THEN sum(doc_id) END AS years
FROM (SELECT doc_id, max(n_chars) AS n_chars FROM documents GROUP BY doc_id) b""")
both("agg_16_distinct_places", """
SELECT count(DISTINCT p.place) AS n FROM (SELECT source AS place FROM documents UNION ALL SELECT lang FROM documents) p""")
both("agg_18_percentiles", """
SELECT lang, max(CASE WHEN k = least(n - 1, CAST(floor(0.5 * n) AS INT)) THEN n_chars END) AS p50, max(CASE WHEN k = least(n - 1, CAST(floor(0.75 * n) AS INT)) THEN n_chars END) AS p75, max(CASE WHEN k = least(n - 1, CAST(floor(0.9 * n) AS INT)) THEN n_chars END) AS p90
FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) r GROUP BY lang""")
both("agg_20_counter_union", """
SELECT k, sum(n) AS n FROM (SELECT source AS k, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT event_type, count(*) FROM events GROUP BY event_type) u GROUP BY k""")
both("agg_21_type_profile", """
SELECT 'text' AS kind, count(text) AS n, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents UNION ALL SELECT 'lang', count(lang), min(length(lang)), max(length(lang)) FROM documents""")
both("agg_25_logical_occurrences", """
SELECT sum(greatest(a, b)) AS n FROM (SELECT doc_id, count(CASE WHEN folded LIKE '%the%' THEN 1 END) AS a, count(CASE WHEN folded LIKE '%and%' THEN 1 END) AS b FROM paragraphs GROUP BY doc_id) x""")
both("agg_27_interest_weights", """
SELECT d.source, d.lang, sum(l.quality * 2 + 1) AS weight FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source, d.lang""")
both("agg_29_distinct_category", """
SELECT DISTINCT source FROM documents WHERE n_chars > 100""")
both("agg_31_partial_final", """
SELECT sum(n) AS total, count(*) AS shards FROM (SELECT doc_id % 8 AS shard, count(*) AS n FROM paragraphs GROUP BY doc_id % 8) s""")
both("agg_33_owner_usage", """
SELECT o_custkey, count(*) AS n_files, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY o_custkey""")
both("agg_38_century_histogram", """
SELECT b.bucket, count(d.doc_id) AS n FROM (SELECT DISTINCT doc_id % 15 + 1 AS bucket FROM documents) b LEFT JOIN (SELECT doc_id, CAST(ceil((doc_id % 1400 + 1) / 100.0) AS INT) AS century FROM documents WHERE doc_id % 7 <> 0) d ON d.century = b.bucket GROUP BY b.bucket""")
both("agg_39_top_categories", """
SELECT source, n FROM (SELECT source, greatest(count(*), 0) AS n FROM documents GROUP BY source) c ORDER BY n DESC, source LIMIT 5""")
both("agg_40_account_files", """
SELECT source, lang, count(*) AS n, min(doc_id) AS first_seen FROM (SELECT DISTINCT doc_id, source, lang FROM documents) f GROUP BY source, lang""")
both("agg_41_dominant_first", """
SELECT doc_id, source, row_number() OVER (ORDER BY CASE WHEN source = top THEN 0 ELSE 1 END, doc_id) AS place FROM (
SELECT doc_id, source, (SELECT source FROM (SELECT source, count(*) AS n FROM documents WHERE n_chars > 2000 GROUP BY source) t ORDER BY n DESC, source LIMIT 1) AS top FROM documents) d""")
both("agg_42_first_per_page", """
SELECT conv_id, min(turn) AS first_turn, count(*) AS n, count(*) = max(turn) - min(turn) + 1 AS complete FROM conversations GROUP BY conv_id""")
both("agg_44_accuracy_floor", """
SELECT d.source, round(100.0 * avg(l.quality), 6) AS accuracy, 100.0 * avg(l.quality) >= 60 AS above_floor FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source""")
# --- windows ---------------------------------------------------------------------------------------
both("win_1_fair_queue", """
SELECT event_id, user_id, k FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) q WHERE k <= 3""")
both("win_2_round_robin_claim", """
SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) q ORDER BY k, ts, event_id LIMIT 40""")
both("win_3_ordinals", """
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS ordinal FROM documents""")
both("win_4_book_rank", """
SELECT doc_id, ordinal, dense_rank() OVER (ORDER BY first_at, doc_id) AS book_rank FROM (SELECT doc_id, ordinal, min(ordinal) OVER (PARTITION BY doc_id) AS first_at FROM paragraphs WHERE folded LIKE '%that%') h""")
both("win_5_eviction", """
SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM documents WHERE lang <> 'de') c WHERE kept > 500000""")
both("win_6_reclaim", """
SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM documents WHERE source <> 'src0') c WHERE freed < 200000""")
both("win_8_occurrence_offsets", """
SELECT doc_id, n, total - n AS from_at FROM (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM (SELECT doc_id, count(*) AS n FROM words WHERE word = 'the' GROUP BY doc_id) c) t WHERE total - n < 140 AND total > 100""")
both("win_10_latest_record", """
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_linenumber DESC) AS k FROM lineitem) x WHERE k = 1""")
both("win_11_occurrence_index", """
SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM words WHERE word = 'and'""")
# --- sorts and paging ------------------------------------------------------------------------------
both("srt_1_unknown_last", """
SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 1400 + 1 END ASC NULLS LAST, doc_id) AS place FROM documents WHERE lang = 'fr'""")
both("srt_2_result_order", """
SELECT doc_id, ordinal, row_number() OVER (ORDER BY doc_id % 1400, lang, source, doc_id, ordinal) AS place FROM (SELECT p.doc_id, p.ordinal, d.lang, d.source FROM paragraphs p JOIN documents d ON d.doc_id = p.doc_id WHERE p.folded LIKE '%with%') x""")
both("srt_3_known_before_unknown", """
SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END, -(doc_id % 1400), doc_id) AS newest, row_number() OVER (ORDER BY CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END, doc_id % 1400, doc_id) AS oldest FROM documents WHERE source = 'src3'""")
both("srt_4_metric_sort", """
SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id % 1400, doc_id LIMIT 50""")
both("srt_5_directory_sort", """
SELECT n_name, row_number() OVER (ORDER BY n_name) AS by_name, row_number() OVER (ORDER BY n_regionkey, n_name) AS by_region FROM nation""")
both("srt_7_topk", """
SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20""")
both("srt_8_offset_page", """
SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 40 OFFSET 100""")
both("srt_9_has_more", """
SELECT count(*) AS n, count(*) > 40 AS has_more FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 41) p""")
both("srt_10_keyset_page", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey < 400 ORDER BY o_orderkey DESC LIMIT 20""")
both("srt_12_two_source_page", """
SELECT src, id FROM (SELECT 0 AS src, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 1, doc_id FROM documents) u ORDER BY src, id LIMIT 50 OFFSET 20""")
both("srt_13_top_density", """
SELECT doc_id, round(CAST(length(text) AS DOUBLE) / (1 + length(text) - length(replace(text, ' ', ''))), 6) AS density FROM documents ORDER BY 2 DESC, 1 LIMIT 15""")
# --- set operations --------------------------------------------------------------------------------
both("set_1_audit_union", """
SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders UNION ALL SELECT 'line', l_orderkey, l_shipdate FROM lineitem""")
both("set_2_union_distinct", """
SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT user_id FROM events""")
both("set_3_names_registry", """
WITH names AS (SELECT c_name AS name, c_nationkey AS nk FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier)
SELECT nk, count(*) AS n, min(name) AS first_name, (SELECT count(*) FROM names) AS total FROM names GROUP BY nk""")
both("set_4_intersect_except", """
SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) a UNION ALL SELECT 'only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) b""")
both("set_5_version_delta", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS delta
FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 1) a FULL OUTER JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 2 THEN concat(text, '.') ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3) b ON b.doc_id = a.doc_id""")
both("set_6_last_wins", """
SELECT id, v FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY side DESC) AS k FROM (SELECT doc_id AS id, lang AS v, 0 AS side FROM documents UNION ALL SELECT doc_id, source, 1 FROM documents WHERE doc_id % 2 = 0) u) x WHERE k = 1""")
both("set_10_higher_revision", """
SELECT id, rev, side FROM (SELECT id, rev, side, row_number() OVER (PARTITION BY id ORDER BY rev DESC, side DESC) AS k FROM (SELECT doc_id AS id, doc_id % 5 AS rev, 0 AS side FROM documents UNION ALL SELECT doc_id, doc_id % 4, 1 FROM documents) u) x WHERE k = 1""")
both("snk_12_upsert", """
SELECT id, v FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM (SELECT o_orderkey AS id, o_orderstatus AS v, 0 AS seq FROM orders UNION ALL SELECT l_orderkey, max(l_returnflag), 1 FROM lineitem GROUP BY l_orderkey) u) x WHERE k = 1""")
both("snk_13_insert_if_absent", """
SELECT doc_id, 'old' AS origin FROM labels UNION ALL SELECT d.doc_id, 'new' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
both("snk_8_listing_pages", """
SELECT source, page, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, CAST(ceil(row_number() OVER (PARTITION BY source ORDER BY doc_id) / 100.0) AS INT) AS page FROM documents) p GROUP BY source, page""")
both("snk_6_run_lengths", """
SELECT flag, min(pos) AS first_row, count(*) AS n FROM (SELECT pos, flag, pos - row_number() OVER (PARTITION BY flag ORDER BY pos) AS island FROM (SELECT doc_id AS pos, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS flag FROM (SELECT doc_id, max(n_chars) AS n_chars FROM documents GROUP BY doc_id) u) d) i GROUP BY flag, island""")
# --- scalar functions ------------------------------------------------------------------------------
both("fn_4_sha256", "SELECT doc_id, sha256(text) AS h FROM documents", "SELECT doc_id, sha256(text) AS h FROM documents")
SPARK["fn_4_sha256"] = "SELECT doc_id, sha2(text, 256) AS h FROM documents"
both("fn_6_backoff", """
SELECT attempt, least(86400000, 1000 * power(2, least(30, attempt - 1))) AS delay_ms FROM (SELECT DISTINCT CAST(doc_id % 40 + 1 AS INT) AS attempt FROM documents) a""")
both("fn_7_bounded_retry", """
SELECT attempts, least(3600, 30 * power(2, least(attempts, 7))) AS wait_s, CASE attempts WHEN 0 THEN 60 WHEN 1 THEN 300 WHEN 2 THEN 1800 WHEN 3 THEN 7200 ELSE 43200 END AS step_s FROM (SELECT DISTINCT CAST(doc_id % 12 AS INT) AS attempts FROM documents) a""")
both("fn_8_displayable_year", """
SELECT doc_id, CASE WHEN y IS NULL OR y = 99999 THEN NULL WHEN y > 1448 THEN NULL ELSE y END AS shown, CASE WHEN y BETWEEN 1 AND 1448 THEN 1448 - y END AS years_ago FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 99999 ELSE doc_id % 1600 END AS y FROM documents) d""")
both("fn_9_spaced_repetition", """
SELECT doc_id, step, CASE step WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 14 ELSE 30 END AS days, doc_id % 40 >= CASE step WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 14 ELSE 30 END AS due FROM (SELECT doc_id, doc_id % 6 AS step FROM documents) d""")
both("fn_10_plan_progress", """
SELECT doc_id, least(100, CAST(round(100.0 * least(page, pages) / pages) AS INT)) AS percent, greatest(0, CAST(ceil((pages - page) * 1.0 / per_day) AS INT)) AS days_left FROM (SELECT doc_id, doc_id % 90 AS page, doc_id % 80 + 20 AS pages, doc_id % 9 + 1 AS per_day FROM documents) d""")
both("fn_11_pages_per_day", """
SELECT doc_id, greatest(1, least(50, CAST(ceil(n_chars / 600.0) AS INT))) AS suggested FROM documents""")
both("fn_12_period_cutoffs", """
SELECT p.days, count(*) AS n FROM events e JOIN (SELECT 7 AS days UNION ALL SELECT 30 UNION ALL SELECT 90) p ON e.ts >= TIMESTAMP '2024-01-30 00:00:00' - p.days * INTERVAL '1' DAY GROUP BY p.days""")
both("fn_15_scalars", """
SELECT doc_id, substr(source, 4) AS n, instr(text, 'the') AS at, coalesce(nullif(lang, 'en'), 'xx') AS l, greatest(n_chars, 100) AS g, CAST(substr(source, 4) AS INT) AS i FROM documents""")
both("fn_17_age", "SELECT o_orderkey, 2024 - extract(year FROM o_orderdate) AS age FROM orders")
# --- stateful decisions as ordered projections -------------------------------------------------------
both("str_4_state_machine", """
WITH allowed AS (SELECT 'O' AS a, 'P' AS b UNION ALL SELECT 'P', 'F' UNION ALL SELECT 'O', 'F')
SELECT x.o_custkey, x.o_orderkey, x.prev, x.o_orderstatus AS next, allowed.a IS NOT NULL AS ok FROM (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) x LEFT JOIN allowed ON allowed.a = x.prev AND allowed.b = x.o_orderstatus WHERE x.prev IS NOT NULL""")
both("str_7_claim", """
SELECT o_orderkey, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 8 THEN 'blocked' ELSE 'leased' END AS state FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 9 AS attempts FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 9 < 8) j ORDER BY o_orderdate, o_orderkey LIMIT 25""")
both("str_8_supersession", """
SELECT e.event_id FROM events e JOIN (SELECT user_id, event_type, max(event_id) AS newest FROM events GROUP BY user_id, event_type) n ON n.user_id = e.user_id AND n.event_type = e.event_type WHERE e.event_id = n.newest""")
both("str_9_generations", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS generation FROM events""")
both("str_10_reconcile_page", """
SELECT o.o_orderkey FROM orders o WHERE o.o_orderkey > 100 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'N') ORDER BY o.o_orderkey LIMIT 100""")
both("str_11_daily_quota", """
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 5 AS over_quota FROM events GROUP BY user_id, CAST(ts AS DATE)""")
both("str_12_rolling_day", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS in_24h FROM events""")
both("str_16_publication", """
SELECT o_custkey, min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AS all_ready, CASE WHEN min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'publish' WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1 THEN 'wait' ELSE 'reject' END AS decision FROM orders GROUP BY o_custkey""")
both("str_17_conflict_authority", """
SELECT l.l_orderkey, l.l_linenumber, CASE WHEN l.l_linestatus = 'F' AND l.l_returnflag = 'A' THEN 'replay' WHEN o.o_orderkey IS NULL THEN 'not-found' WHEN o.o_orderstatus = 'P' THEN 'wrong-state' WHEN o.o_orderkey % 4 <> l.l_linenumber % 4 THEN 'version-mismatch' ELSE 'resolve' END AS decision FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey""")
both("str_19_capacity_plan", """
SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 + 1000 THEN 'full' WHEN s_acctbal >= 1000 THEN 'on-demand' ELSE 'refuse' END AS plan FROM supplier""")
both("str_21_supervisor", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND left_over = 0 THEN 'done' WHEN quota = 0 THEN 'pause' WHEN o_orderstatus = 'P' THEN 'wait' WHEN left_over > 50 THEN 'start' ELSE 'resume' END AS action FROM (SELECT o_orderkey, o_orderstatus, o_orderkey % 100 AS left_over, o_orderkey % 7 AS quota FROM orders) s""")
both("str_22_provider_health", """
SELECT user_id, max(streak) AS longest, max(streak) >= 3 AS went_down FROM (SELECT user_id, island, count(*) AS streak FROM (SELECT user_id, bad, k - row_number() OVER (PARTITION BY user_id, bad ORDER BY k) AS island FROM (SELECT user_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) e) i WHERE bad = 1 GROUP BY user_id, island) s GROUP BY user_id""")
both("str_23_budgets", """
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests, round(sum(value), 4) AS spent, round(sum(value), 4) > 500 OR count(*) > 10 AS over FROM events GROUP BY user_id, CAST(ts AS DATE)""")
both("str_24_maintenance", """
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1993-01-01 00:00:00' THEN 'delete' WHEN o_orderstatus = 'P' THEN 'requeue' ELSE 'release' END AS sweep FROM orders WHERE o_orderdate < TIMESTAMP '1994-01-01 00:00:00' OR o_orderstatus = 'P'""")
# --- search as relations -----------------------------------------------------------------------------
both("flt_3_substring", "SELECT doc_id, ordinal, instr(folded, 'tion') AS at FROM paragraphs WHERE folded LIKE '%tion%'")
both("flt_2_exclusions", "SELECT doc_id, ordinal FROM paragraphs WHERE folded LIKE '%the%' AND NOT (folded LIKE '%and%' OR folded LIKE '%with%')")
both("joi_9_phrase_adjacency", """
SELECT doc_id, start FROM (SELECT doc_id, pos - CASE word WHEN 'of' THEN 0 ELSE 1 END AS start, word FROM words WHERE word IN ('of', 'the')) c GROUP BY doc_id, start HAVING count(DISTINCT word) = 2""")
both("joi_10_posting_intersection", """
SELECT doc_id FROM words WHERE word IN ('the', 'and', 'with') GROUP BY doc_id HAVING count(DISTINCT word) = 3""")
both("sch_3_term_search", """
SELECT doc_id, pos, count(*) OVER () AS total FROM words WHERE word = 'that' ORDER BY doc_id % 1400, doc_id, pos LIMIT 50""")
both("sch_13_structural", """
SELECT doc_id, field FROM (SELECT doc_id, field, row_number() OVER (PARTITION BY doc_id, field ORDER BY seq) AS k FROM (SELECT doc_id, 'category' AS field, 0 AS seq FROM documents WHERE source LIKE '%1' UNION ALL SELECT doc_id, 'tag', 0 FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 'body', ordinal FROM paragraphs WHERE folded LIKE '%the%') f) x WHERE k = 1""")
both("sch_12_federation", """
SELECT origin, count(*) AS n, count(DISTINCT id) AS n_docs FROM (SELECT 'local' AS origin, doc_id AS id FROM paragraphs WHERE folded LIKE '%the%' UNION ALL SELECT 'uploads', conv_id FROM conversations WHERE lower(text) LIKE '%the%' UNION ALL SELECT 'benchmark', item_id FROM benchmark WHERE lower(text) LIKE '%the%') h GROUP BY origin""")
both("sch_17_suggestions", """
SELECT doc_id, score FROM (SELECT doc_id, max(CASE WHEN source = 'src1' THEN 3 WHEN source LIKE 'src1%' THEN 2 WHEN lang = 'es' THEN 1 ELSE 0 END) AS score FROM documents GROUP BY doc_id) s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 200""")
both("sch_19_recommendations", """
SELECT d.doc_id, coalesce(c.w, 0) * 3 + coalesce(a.w, 0) * 2 AS score FROM documents d LEFT JOIN (SELECT d.source, count(*) AS w FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1 GROUP BY d.source) c ON c.source = d.source LEFT JOIN (SELECT d.lang, count(*) AS w FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1 GROUP BY d.lang) a ON a.lang = d.lang WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY score DESC, d.doc_id LIMIT 20""")
both("sch_24_all_terms", "SELECT doc_id FROM documents WHERE lower(concat_ws(' ', source, lang, text)) LIKE '%src1%' AND lower(concat_ws(' ', source, lang, text)) LIKE '%the%'")
both("sch_25_two_fields", """
SELECT doc_id, CASE WHEN source LIKE '%2%' AND folded_doc LIKE '%der%' THEN 'source,text' WHEN source LIKE '%2%' THEN 'source' ELSE 'text' END AS fields FROM (SELECT doc_id, source, lower(text) AS folded_doc FROM documents) d WHERE source LIKE '%2%' OR folded_doc LIKE '%der%'""")
both("sch_27_count_progress", """
SELECT count(*) AS total, count(DISTINCT doc_id) AS total_documents, true AS exact, count(*) > 40 AS has_more, 'paragraphs' AS unit FROM paragraphs WHERE folded LIKE '%the%'""")
both("srt_11_document_page", """
SELECT doc_id, n, total FROM (SELECT doc_id, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY doc_id) AS k FROM words WHERE word = 'was' GROUP BY doc_id) g WHERE k BETWEEN 11 AND 30""")
both("agg_9_group_by_document", "SELECT doc_id, count(*) AS occurrences, min(pos) AS first_pos FROM words WHERE word = 'the' GROUP BY doc_id")
# --- further operators -------------------------------------------------------------------------------
both("flt_8_alias_contains", """
SELECT DISTINCT n.n_name FROM nation n JOIN (SELECT n_nationkey AS k, n_name AS alias FROM nation UNION ALL SELECT s_nationkey, s_name FROM supplier) a ON a.k = n.n_nationkey WHERE lower(a.alias) LIKE '%1%'""")
both("flt_12_scoped_starts", """
SELECT w.doc_id, w.pos FROM words w JOIN (SELECT doc_id, min(pos) AS title_end, max(pos) AS document_end FROM words WHERE word = 'the' GROUP BY doc_id) f ON f.doc_id = w.doc_id WHERE w.word = 'and' AND w.pos > f.title_end AND w.pos < f.document_end""")
both("flt_13_range_scope", """
SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN (SELECT o_custkey, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) r ON r.o_custkey = l.l_suppkey AND l.l_orderkey BETWEEN r.first_row AND r.last_row""")
both("fn_13_score_blend", """
SELECT doc_id, round(0.62 * (n_chars % 100) / 100 + 0.28 * (doc_id % 10) / 10 + 0.10 / (1 + doc_id % 7), 6) AS score FROM documents""",
     "SELECT doc_id, round(CAST(0.62 AS DOUBLE) * (n_chars % 100) / 100 + CAST(0.28 AS DOUBLE) * (doc_id % 10) / 10 + CAST(0.10 AS DOUBLE) / (1 + doc_id % 7), 6) AS score FROM documents")
SPARK["fn_13_score_blend"] = DUCK["fn_13_score_blend"]
both("joi_11_set_intersection", """
SELECT doc_id FROM words WHERE word = 'that' INTERSECT SELECT doc_id FROM words WHERE word = 'with' INTERSECT SELECT doc_id FROM words WHERE word = 'and'""")
both("joi_14_entity_resolution", """
WITH q AS (SELECT DISTINCT lower(p_brand) AS name FROM part UNION SELECT DISTINCT lower(n_name) FROM nation), c AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation),
exact AS (SELECT q.name, c.id FROM q JOIN c ON c.name = q.name),
part_of AS (SELECT q.name, min(c.id) AS id, count(*) AS n FROM q JOIN c ON c.name LIKE concat('%', q.name, '%') WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.name = q.name) GROUP BY q.name)
SELECT q.name, coalesce(e.id, CASE WHEN p.n = 1 THEN p.id END) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN p.n = 1 THEN 'contained' WHEN p.n > 1 THEN 'review' ELSE 'missing' END AS outcome
FROM q LEFT JOIN exact e ON e.name = q.name LEFT JOIN part_of p ON p.name = q.name""")
both("srt_6_numeric_order", """
SELECT doc_id, row_number() OVER (ORDER BY CAST(substr(source, 4) AS INT), doc_id % 300, doc_id) AS place FROM documents""")
both("set_8_all_names_new", """
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT source AS name FROM documents WHERE n_chars > 15000 UNION SELECT lang FROM documents WHERE n_chars > 25000) k WHERE k.name = d.source OR k.name = d.lang)""")
both("set_11_snapshot_diff", """
WITH was AS (SELECT concat(source, '/', doc_id) AS path, md5(text) AS ident FROM documents WHERE n_chars > 100), now_ AS (SELECT concat(CASE WHEN lang = 'fr' THEN lang ELSE source END, '/', doc_id) AS path, md5(text) AS ident FROM documents WHERE n_chars < 9000),
gone AS (SELECT w.path, w.ident FROM was w WHERE NOT EXISTS (SELECT 1 FROM now_ n WHERE n.path = w.path)), fresh AS (SELECT n.path, n.ident FROM now_ n WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.path = n.path))
SELECT f.path, CASE WHEN g.ident IS NULL THEN 'created' ELSE 'renamed' END AS kind, g.path AS previous FROM fresh f LEFT JOIN (SELECT ident, min(path) AS path FROM gone GROUP BY ident HAVING count(*) = 1) g ON g.ident = f.ident
UNION ALL SELECT g.path, 'deleted', NULL FROM gone g WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.ident = g.ident)""")
both("agg_35_edition_difference", """
SELECT a.doc_id, a.lang = b.lang AS same_lang, a.source = b.source AS same_source, a.n_chars - b.n_chars AS d_chars FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
both("win_9_last_heading", """
SELECT doc_id, ordinal, max(CASE WHEN length(text) < 40 THEN ordinal END) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_at FROM paragraphs""")
both("sch_2_smallest_bucket", """
SELECT p.doc_id, p.ordinal FROM paragraphs p JOIN (SELECT DISTINCT doc_id FROM words WHERE word = (SELECT word FROM (SELECT word, count(DISTINCT doc_id) AS df FROM words WHERE word IN ('that', 'this', 'with') GROUP BY word) c ORDER BY df, word LIMIT 1)) d ON d.doc_id = p.doc_id
WHERE concat(' ', p.folded, ' ') LIKE '% that %' AND concat(' ', p.folded, ' ') LIKE '% this %' AND concat(' ', p.folded, ' ') LIKE '% with %'""")
both("sch_8_field_scoped", """
SELECT w.doc_id, count(*) AS n FROM words w JOIN (SELECT doc_id, max(pos) AS document_end FROM words GROUP BY doc_id) f ON f.doc_id = w.doc_id WHERE w.word = 'the' AND w.pos * 2 > f.document_end GROUP BY w.doc_id""")
both("sch_14_phrase_with_facets", """
SELECT d.source, count(*) AS hits, count(DISTINCT p.doc_id) AS books FROM paragraphs p JOIN documents d ON d.doc_id = p.doc_id WHERE instr(p.folded, 'of the') > 0 AND NOT p.folded LIKE '%with%' GROUP BY d.source""")
both("sch_16_pack_ranking", """
SELECT doc_id, ordinal, CASE WHEN folded = 'that the' THEN 4 WHEN folded LIKE 'that the%' THEN 3 WHEN folded LIKE '%that%' AND folded LIKE '%the%' THEN 2 ELSE 1 END AS rank FROM paragraphs WHERE folded LIKE '%that%' OR folded LIKE '%the%'""")
both("sch_20_category_scope", """
SELECT p.doc_id, p.ordinal FROM paragraphs p WHERE p.folded LIKE '%and%' AND p.doc_id IN (SELECT l.doc_id FROM labels l WHERE l.quality = 1)""")
both("sch_21_facet_narrowing", """
SELECT d.lang, d.source, count(*) AS n FROM documents d JOIN paragraphs p ON p.doc_id = d.doc_id WHERE d.lang IN ('en', 'de') AND p.folded LIKE '%er%' GROUP BY d.lang, d.source""")
both("sch_26_segment_phrases", """
SELECT conv_id, turn, CAST((length(t) - length(replace(t, 'the ', ''))) / 4 AS INT) AS n FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations) c WHERE t LIKE '%the %'""")
both("str_6_lease_recovery", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderkey % 9 >= 8 THEN 'blocked' WHEN o_orderdate < TIMESTAMP '1995-01-01 00:00:00' AND o_orderstatus = 'P' THEN 'recovered' WHEN o_orderstatus = 'P' THEN 'leased' ELSE 'ready' END AS state FROM orders""")
both("str_20_undo", """
SELECT e.event_id, e.value AS now_value, p.value AS undone_to, e.event_id = n.newest AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) e JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) p ON p.user_id = e.user_id AND p.k = e.k - 1 JOIN (SELECT user_id, max(event_id) AS newest FROM events GROUP BY user_id) n ON n.user_id = e.user_id""")
both("flt_15_partial_tokens", """
SELECT doc_id, pos FROM (SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM words) w WHERE word LIKE '%he' AND following LIKE 'th%'""")
