"""Queries over joins, aggregates, windows and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import answers, chunking, crawl, index, layout, retrieve, sync
from loamline.plans.scalars import CANONICAL_SQL, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j1_unindexed(spark, d):
    return index.unseen(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id")), table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def j2_to_parse(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return sync.to_parse(raw, raw.where("doc_id % 2 = 0").select(F.col("sha256").alias("document_id"))).select("doc_id", "sha256")


@query("""
    WITH l AS (SELECT doc_id AS rel, sha256(text) AS sha, md5(text) AS md5, strlen(text) AS size FROM documents WHERE doc_id % 5 <> 0),
    r AS (SELECT doc_id AS rel, CASE WHEN doc_id % 4 = 0 THEN sha256(text || CASE WHEN doc_id % 8 = 0 THEN '!' ELSE '' END) END AS sha, CASE WHEN doc_id % 4 = 1 THEN md5(text) END AS md5, CASE WHEN doc_id % 4 = 2 THEN md5(text) END AS etag, strlen(text) AS size FROM documents WHERE doc_id % 3 <> 0)
    SELECT coalesce(l.rel, r.rel) AS rel,
      CASE WHEN l.rel IS NULL THEN 'delete' WHEN r.rel IS NULL THEN 'upload' WHEN r.sha IS NOT NULL THEN CASE WHEN r.sha = l.sha THEN 'skip' ELSE 'upload' END WHEN r.md5 IS NOT NULL OR r.etag IS NOT NULL THEN 'skip' ELSE 'upload' END AS action,
      CASE WHEN l.rel IS NULL THEN 'local_missing' WHEN r.rel IS NULL THEN 'remote_missing' WHEN r.sha IS NOT NULL THEN CASE WHEN r.sha = l.sha THEN 'match_metadata_sha256' ELSE 'metadata_sha256_mismatch' END
           WHEN r.md5 IS NOT NULL THEN CASE WHEN r.rel % 8 = 1 THEN 'match_content_md5_hex' ELSE 'match_content_md5_base64' END WHEN r.etag IS NOT NULL THEN 'match_etag_md5' ELSE 'no_reliable_remote_checksum' END AS reason
    FROM l FULL JOIN r ON l.rel = r.rel
""")
def j5_f15_q8_mirror(spark, d):
    docs = table(spark, d, "documents")
    local = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("rel"), *sync.digests(F.col("text").cast("binary")))
    k = F.col("doc_id") % 4
    sha = F.when(k == 0, F.sha2(F.concat("text", F.when(F.col("doc_id") % 8 == 0, "!").otherwise("")), 256))
    md5 = F.when(k == 1, F.when(F.col("doc_id") % 8 == 1, F.md5("text")).otherwise(F.base64(F.unhex(F.md5("text")))))
    etag = F.when(k == 2, F.concat(F.lit('"'), F.md5("text"), F.lit('"')))
    remote = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("rel"), sha.alias("sha256"), md5.alias("content_md5"), etag.alias("etag"), F.octet_length("text").cast("long").alias("size"))
    return sync.mirror(local, remote, delete_orphans=True)


@query("SELECT source, sum(n_chars)::BIGINT AS document_total_tokens, count(*) AS chunk_count, max(n_chars) AS last_number FROM documents GROUP BY source")
def a1_a2_a3_totals(spark, d):
    return index.document_totals(table(spark, d, "documents"), "source", "n_chars", "n_chars")


@query("""
    SELECT count(*) AS seen, count(*) FILTER (doc_id % 10 > 2) AS indexed, count(*) FILTER (doc_id % 10 <= 2) AS skipped, count(*) FILTER (doc_id % 10 = 1) AS skipped_schema FROM documents
""")
def a4_index_totals(spark, d):
    return index.totals(index.normalise(_lines(spark, d)))


def _lines(spark, d):
    """Documents as chunk lines; some malformed, some without a required field, some with one that can't be cast."""
    k = F.col("doc_id") % 10
    docs = table(spark, d, "documents")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.format_string("%d_c%04d", "doc_id", F.lit(0)).alias("chunk_id"), F.when(k == 2, "x").otherwise(F.lit("0")).alias("chunk_index"), F.concat(F.lit(" "), "text", F.lit("\r\n")).alias("text"), F.when(k != 1, "v1").alias("parser_version"), F.col("lang").alias("language"), F.when(k == 3, "http://x").alias("source_url"), F.when(k == 4, 7).alias("page_number")))
    return docs.select("doc_id", F.when(k == 0, "{not json").otherwise(line).alias("value"))


@query(r"""
    SELECT doc_id::VARCHAR AS document_id, printf('%d_c%04d', doc_id, 0) AS chunk_id, 0 AS chunk_index, md5(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+', ''), '\s+$', '')) AS content_md5,
           CASE WHEN doc_id % 10 = 3 THEN 'http://x' END AS source_url, CASE WHEN doc_id % 10 = 4 THEN 7 END AS page_number, lang AS meta_language FROM documents WHERE doc_id % 10 > 2
""")
def p1_s5_normalised_chunks(spark, d):
    rows = index.normalise(_lines(spark, d)).where("fault is null")
    return rows.select("document_id", "chunk_id", "chunk_index", F.md5("content").alias("content_md5"), "source_url", "page_number", F.get_json_object("meta", "$.language").alias("meta_language"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a5_status_counts(spark, d):
    return crawl.status_counts(table(spark, d, "events"), "event_type")


@query(r"""
    SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(regexp_replace(text, '\s+', ' ', 'g')) ORDER BY n_chars, doc_id) AS copy FROM documents) WHERE copy = 1
""")
def a6_w2_nearest_per_text(spark, d):
    from loamline.operators.retrieve import one_per_text

    docs = table(spark, d, "documents").select(F.lit("r").alias("request_id"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("distance"), "text")
    return one_per_text(docs).select(F.col("chunk_id").alias("doc_id"))


@query(CANONICAL_SQL.split("SELECT page_id, regexp_replace(scheme")[0] + """
    SELECT count(DISTINCT regexp_replace(scheme || '://' || netloc || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END, '/$', '')) AS urls, (SELECT count(DISTINCT sha256(html)) FROM pages) AS contents FROM v
""")
def a7_distinct_urls(spark, d):
    return crawl.distinct_pages(table(spark, d, "pages"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS joined_md5, count(*) AS parts FROM conversations GROUP BY conv_id")
def a8_joined_texts(spark, d):
    return chunking.joined_texts(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", F.md5("text").alias("joined_md5"), "parts")


@query(r"""
    WITH v AS (SELECT page_id, regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs FROM pages)
    SELECT page_id, len(hrefs) AS n_links, md5(array_to_string(list_transform(hrefs, lambda h: h), ' ')) AS paths_md5 FROM v
""")
def u2_c19_links(spark, d):
    read = crawl.read_pages(table(spark, d, "pages"))
    paths = F.transform("links", lambda x: F.regexp_replace(x["href"], "^[a-z]+://[^/]*", ""))
    return read.select("page_id", "n_links", F.md5(F.array_join(paths, " ")).alias("paths_md5"))


@query(r"""
    WITH v AS (SELECT page_id, len(regexp_extract_all(html, '(?s)<a [^>]*href="[^"]*"')) AS n_links, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM pages),
    n AS (SELECT page_id, n_links, CASE WHEN words = '' THEN 0 ELSE len(string_split(words, ' ')) END AS n_words FROM v)
    SELECT page_id, n_words, n_links, round(CASE WHEN n_words > 0 THEN n_links / n_words WHEN n_links > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS link_density FROM n
""")
def a10_link_density(spark, d):
    return crawl.link_density(crawl.read_pages(table(spark, d, "pages"))).select("page_id", "n_words", "n_links", F.round("link_density", 6).alias("link_density"))


@query(r"""
    WITH v AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS origin, unnest(regexp_extract_all(html, '(?s)<a [^>]*href="/([^"]*)"', 1)) AS path FROM pages)
    SELECT page_id, origin || '/files/' || path AS url, TRUE AS prioritized FROM v WHERE origin LIKE '%example.com' OR origin LIKE '%example.org'
""")
def q6_f8_candidate_links(spark, d):
    # The test pages link to no documents; their links are moved to where documents lie.
    pages = table(spark, d, "pages").withColumn("html", F.regexp_replace("html", 'href="/', 'href="/files/'))
    return crawl.candidates(pages, ("example.com", "example.org"))


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_linenumber = 7 AS prioritized FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, FALSE FROM lineitem),
    b(url, depth) AS (SELECT 'p7', 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 2 OR e.prioritized AND b.depth < 4)
    SELECT url, min(depth) AS depth FROM b GROUP BY url
""")
def q6_d16_crawl_frontier(spark, d):
    # Beyond the depth limit only some links from parts are followed, and none from suppliers.
    part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    li = table(spark, d, "lineitem")
    edges = li.select(part.alias("src"), supplier.alias("dst"), (F.col("l_linenumber") == 7).alias("prioritized")).union(li.select(supplier, part, F.lit(False))).distinct()
    return crawl.crawl(edges, spark.createDataFrame([("p7",)], "url string"))


@query("""
    WITH w AS (SELECT doc_id, generate_subscripts(ss, 1) AS i, len(string_split(unnest(ss), ' ')) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ss FROM documents))
    SELECT doc_id, i - 1 AS sentence, n AS token_len, (sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n)::BIGINT AS token_start FROM w
""")
def w3_running_offsets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("sentence", "line"))
    rows = rows.select("doc_id", F.col("sentence").cast("long").alias("sentence"), F.size(F.split("line", " ")).cast("long").alias("token_len"))
    return chunking.sentence_offsets(rows, "doc_id", "sentence", "token_len")


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS gap FROM events")
def w5_gaps(spark, d):
    return layout.gap_before(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", F.round("gap", 6).alias("gap"))


@query("SELECT conv_id, turn, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS citation FROM conversations")
def w6_running_citation(spark, d):
    return answers.running_citations(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "citation")


@query("SELECT vec_id::VARCHAR AS chunk_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), vec_id::VARCHAR LIMIT 50")
def t1_single_top_k(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id = 3").select(F.lit("one").alias("request_id"), "embedding")
    return retrieve.top_k(asked, e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.lit(None).cast("string").alias("meta")), 50).select("chunk_id", F.round("distance", 6).alias("distance"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def x1_except(spark, d):
    return sync.stale(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS audit_date, CASE WHEN props <> '' THEN sha256(props) END AS query_hash FROM events")
def k9_d15_audit(spark, d):
    from loamline.operators.respond import audit

    e = table(spark, d, "events").select("event_id", "ts", F.col("props").alias("query"))
    return audit(e, F.col("ts")).select("event_id", "audit_date", "query_hash")


_BLOCKS_SQL = """
    p AS (SELECT l_orderkey // 100 AS document_id, 1 + l_orderkey % 3 AS page_number, l_orderkey * 10 + l_linenumber AS block, (l_partkey * 7 % 500)::DOUBLE AS x0, ((l_suppkey * 13 + l_linenumber * 37) % 700)::DOUBLE AS y0,
                 l_partkey * 7 % 500 + l_quantity * 2 AS x1, ((l_suppkey * 13 + l_linenumber * 37) % 700 + 10 + l_linenumber)::DOUBLE AS y1, 'w' || l_partkey AS text FROM lineitem),
    f AS (SELECT * FROM p WHERE block % 9 = 0), b AS (SELECT * FROM p WHERE block % 9 <> 0)
"""


def _blocks(spark, d):
    li = table(spark, d, "lineitem").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    x, y = (F.col("l_partkey") * 7 % 500).cast("double"), ((F.col("l_suppkey") * 13 + F.col("l_linenumber") * 37) % 700).cast("double")
    p = li.select(F.expr("l_orderkey div 100").alias("document_id"), (1 + F.col("l_orderkey") % 3).alias("page_number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity") * 2).alias("x1"), (y + 10 + F.col("l_linenumber")).alias("y1"), F.concat(F.lit("w"), "l_partkey").alias("text"), "file", "at")
    return p.where("block % 9 <> 0"), p.where("block % 9 = 0")


@query(f"""
    WITH {_BLOCKS_SQL},
    c AS (SELECT *, (x0 + x1) / 2 AS centre FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.document_id = b.document_id AND f.page_number = b.page_number
            AND greatest(0, least(b.x1, f.x1) - greatest(b.x0, f.x0)) * greatest(0, least(b.y1, f.y1) - greatest(b.y0, f.y0)) / greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0)) > 0.25)),
    g AS (SELECT *, lead(centre) OVER (PARTITION BY document_id, page_number ORDER BY centre, block) - centre AS gap FROM c),
    m AS (SELECT *, list_sort(list(gap) FILTER (gap IS NOT NULL) OVER (PARTITION BY document_id, page_number)) AS gaps FROM g),
    u AS (SELECT *, CASE WHEN coalesce(gaps[len(gaps) // 2 + 1], 0) = 0 THEN coalesce(list_max(gaps), 0) ELSE gaps[len(gaps) // 2 + 1] END AS usual FROM m),
    k AS (SELECT *, coalesce(sum(CASE WHEN gap > 1.5 * usual THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY centre, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col FROM u)
    SELECT document_id, page_number, string_agg(text, ' ' ORDER BY col, y0, centre, block) AS text FROM k GROUP BY document_id, page_number
""")
def s13_j7_a9_w5_t5_page_text(spark, d):
    # Rows that its ORDER BY leaves tied come as they are stored.
    return layout.page_text(*_blocks(spark, d), ties=("file", "at"))


@query("SELECT conv_id, string_agg(role || chr(9) || coalesce(CASE WHEN turn % 3 > 0 THEN turn::VARCHAR END, ''), chr(10) ORDER BY turn) AS tsv FROM conversations GROUP BY conv_id")
def c22_table_text(spark, d):
    row = F.array("role", F.when(F.col("turn") % 3 > 0, F.col("turn").cast("string")))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))).alias("t"))
    return t.select("conv_id", layout.table_text(F.transform("t", lambda x: x["row"])).alias("tsv"))


@query("SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, -1, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k5_insert_absent(spark, d):
    from loamline.operators import payload

    return payload.insert_absent(table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic")), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, -1 AS quality, -1 AS toxic FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 <> 0")
def k6_overwrite(spark, d):
    from loamline.operators import payload

    return payload.overwrite(table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic")), table(spark, d, "labels"), "doc_id")


@query("SELECT user_id, event_id, event_type, 'r-' || (epoch_us(ts) // 1000) AS request_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank = 1")
def j3_s6_c29_latest_manifest(spark, d):
    from loamline.operators import payload

    return payload.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts").select("user_id", "event_id", "event_type", payload.default_id("r", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).alias("request_id"))


@query("SELECT page_id, url, page_id % 5 <> 0 AS allowed, CASE WHEN page_id % 5 = 1 THEN 4.0 ELSE 1.0 END::DOUBLE AS crawl_delay FROM pages")
def s10_d18_robots(spark, d):
    # A robots file per page stands in for one per site.
    pages = table(spark, d, "pages").select("page_id", F.format_string("http://h%d.org/x", "page_id").alias("u"), "url")
    k = F.col("page_id") % 5
    robots = pages.select(F.format_string("http://h%d.org", "page_id").alias("origin"), F.when(k == 2, 404).otherwise(200).alias("status"), F.when(k == 0, "User-agent: *\nDisallow: /").when(k == 1, "User-agent: *\nCrawl-delay: 4\nDisallow: /y").when(k == 2, "User-agent: *\nDisallow: /").otherwise("").alias("body")).where("page_id % 5 <> 3")
    out = crawl.robots_allow(pages.select("page_id", F.col("u").alias("url"), F.col("url").alias("own")), robots, "loamline")
    return out.select("page_id", F.col("own").alias("url"), "allowed", "crawl_delay")
