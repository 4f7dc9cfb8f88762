"""Queries over scalar functions and predicates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import predicates as p
from loamline.functions import scalar as s

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT event_id, round(1 / (1 + value), 9) AS similarity FROM events")
def c1_similarity(spark, d):
    return table(spark, d, "events").select("event_id", F.round(s.similarity(F.col("value")), 9).alias("similarity"))


@query("""
    SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.95 WHEN 'purchase' THEN 0.8 WHEN 'error' THEN 0.6 ELSE 1.0 END::DOUBLE AS trust_weight,
           round(CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.95 WHEN 'purchase' THEN 0.8 WHEN 'error' THEN 0.6 ELSE 1.0 END / (1 + value), 9) AS final_score FROM events
""")
def c2_c3_trust_score(spark, d):
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "view", "GOV").when(F.col("event_type") == "purchase", "ngo").when(F.col("event_type") == "error", "News").when(F.col("event_type") == "click", "")
    weight = s.trust_weight(level, F.when(F.col("event_type") == "click", "agency"))
    return e.select("event_id", "event_type", weight.alias("trust_weight"), F.round(s.similarity(F.col("value")) * weight, 9).alias("final_score"))


@query(r"SELECT doc_id, CASE WHEN text = '' THEN '' ELSE sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) END AS text_key FROM documents")
def c4_text_key(spark, d):
    return table(spark, d, "documents").select("doc_id", s.text_key(F.col("text")).alias("text_key"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS canonical_md5, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS canonical_len FROM documents")
def c5_canonical_text(spark, d):
    t = s.canonical_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("canonical_md5"), F.length("t").cast("long").alias("canonical_len"))


@query(r"""
    WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?s)(.+?[.?!\n]+|.+?$)'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents)
    SELECT doc_id, len(ss) AS n_sentences, md5(array_to_string(ss, '|')) AS sentences_md5 FROM t
""")
def c6_sentence_split(spark, d):
    t = table(spark, d, "documents").select("doc_id", s.sentences(s.canonical_text(F.col("text"))).alias("ss"))
    return t.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), F.md5(F.array_join("ss", "|")).alias("sentences_md5"))


@query(r"SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n_tokens FROM documents")
def c7_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", s.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query("SELECT page_id, 'bucket/raw/' || regexp_replace(regexp_replace(url, '^https?://', ''), '^/+', '') AS remote FROM pages")
def c26_remote_path(spark, d):
    rel = F.concat(F.lit("//"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/", r"\\\\"))
    return table(spark, d, "pages").select("page_id", s.remote_path(F.lit("bucket"), F.lit("/raw/"), rel).alias("remote"))


_MID = "(l_linenumber * 10 + l_linenumber * 10 + l_quantity) / 2.0 / 120"


@query(f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN {_MID} < .10 THEN 'intro' WHEN {_MID} < .30 THEN 'early' WHEN {_MID} < .75 THEN 'middle' WHEN {_MID} < .95 THEN 'late' ELSE 'footer' END AS html_region,
           CASE WHEN (l_linenumber * 10 + l_quantity / 2.0) / 120 < .10 THEN 'intro' WHEN (l_linenumber * 10 + l_quantity / 2.0) / 120 < .30 THEN 'early' WHEN (l_linenumber * 10 + l_quantity / 2.0) / 120 < .70 THEN 'middle' WHEN (l_linenumber * 10 + l_quantity / 2.0) / 120 < .90 THEN 'late' ELSE 'footer' END AS pdf_region
    FROM lineitem
""")
def c8_c9_regions(spark, d):
    start = F.col("l_linenumber") * 10
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.html_region(start, start + F.col("l_quantity"), F.lit(120)).alias("html_region"), s.pdf_region(start, F.col("l_quantity"), F.lit(120), F.lit(1), F.lit(1)).alias("pdf_region"))


CANONICAL_SQL = r"""
    WITH u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages),
    v AS (SELECT page_id, url, lower(regexp_extract(bare, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(bare, '^[A-Za-z]+://([^/?]*)', 1)) AS netloc,
                 regexp_extract(bare, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS path,
                 list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT regexp_matches(x, '^(fbclid|gclid|mc_cid|mc_eid)='))) AS params FROM u)
    SELECT page_id, regexp_replace(scheme || '://' || netloc || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END, '/$', '') AS canonical_url,
           netloc AS host FROM v
"""


@query(CANONICAL_SQL)
def c10_c15_canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", s.canonical_url(F.col("url")).alias("canonical_url"), s.host(F.col("url")).alias("host"))


@query(r"""
    WITH n AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*(?:/[^/]*)*?/?([^/]*)/*$', 1) AS name FROM pages),
    e AS (SELECT page_id, name, CASE WHEN contains(name, '.') THEN regexp_extract(lower(name), '\.([^.]*)$', 1) WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'html' ELSE 'bin' END AS ext FROM n)
    SELECT page_id, ext, regexp_replace(CASE WHEN name = '' THEN 'response.' || ext ELSE name END, '[^\p{L}\p{N}_.-]', '', 'g')[:240] AS safe_name FROM e
""")
def c11_c12_names(spark, d):
    kind = F.when(F.col("page_id") % 3 == 0, "application/pdf; q=1").when(F.col("page_id") % 3 == 1, "text/html; charset=utf-8")
    t = table(spark, d, "pages").withColumn("ext", s.extension(F.col("url"), kind))
    return t.select("page_id", "ext", s.safe_name(F.col("url"), F.col("ext")).alias("safe_name"))


@query("SELECT doc_id, md5(text) AS bare, md5(text) AS comparable, sha256(text) AS from_base64 FROM documents")
def c13_c14_etags(spark, d):
    quoted = F.concat(F.lit('"'), F.md5("text"), F.lit('"'))
    return table(spark, d, "documents").select("doc_id", s.bare_etag(quoted).alias("bare"), s.comparable_etag(F.concat(F.lit("W/"), F.upper(quoted))).alias("comparable"), s.base64_hex(F.base64(F.unhex(F.sha2("text", 256)))).alias("from_base64"))


@query("SELECT page_id, 'https://bucket' || page_id || '.s3.amazonaws.com/raw/' || page_id || '.html' AS source_url, regexp_extract(url, '^https?://([^/]*)', 1) AS label FROM pages")
def c16_p4_sources(spark, d):
    key = F.format_string("s3://bucket%d/raw/%d.html", "page_id", "page_id")
    return table(spark, d, "pages").select("page_id", s.https_source(key).alias("source_url"), s.source_label(F.col("url")).alias("label"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '[\x00-\x1f\x7f]+', ' ', 'g'), '\s+', ' ', 'g')) AS flat FROM pages")
def c17_reflow(spark, d):
    return table(spark, d, "pages").select("page_id", s.reflow(F.col("html")).alias("flat"))


@query("SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def c28_l2_distance(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(s.l2_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query("SELECT event_id, printf('%d_c%04d', user_id, event_id % 12000) AS chunk_id FROM events")
def c25_padded_id(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("_c"), s.padded(F.col("event_id") % 12000)).alias("chunk_id"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents")
def a11_digests(spark, d):
    from loamline.operators.sync import digests

    return table(spark, d, "documents").select("doc_id", *digests(F.col("text").cast("binary")))


@query("SELECT event_id, value FROM events WHERE json_extract_string(props, '$.k') = '69' AND event_type = 'error'")
def f1_metadata_filter(spark, d):
    from loamline.operators.retrieve import metadata_filter

    return metadata_filter(table(spark, d, "events").where("event_type = 'error'"), "props", {"k": "69", "no key!": "x"}).select("event_id", "value")


@query(r"""
    SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\b(medic(al|ine|ation)|prescrib|diagnos|symptom|treatment|clinic|idiot)\b') THEN 'refusal_medical'
           WHEN regexp_matches(text, '(?i)\b(attorney|sue|lawsuit|contract|custody|divorce|legal advice|crime|sentence)\b') THEN 'refusal_legal' END AS guidance_key FROM conversations
""")
def f3_blocked_intent(spark, d):
    # A word of the test tables stands in for one that is refused.
    text = F.regexp_replace("text", r"(?i)\bidiot\b", "clinic")
    return table(spark, d, "conversations").select("conv_id", "turn", p.blocked_intent(text).alias("guidance_key"))


@query("SELECT event_id, CASE WHEN value / 100 < 0.25 THEN 'refusal_asr_low_confidence' END AS guidance_key FROM events")
def f4_asr_gate(spark, d):
    return table(spark, d, "events").select("event_id", p.asr_refusal(F.lit("voice"), F.col("value") / 100).alias("guidance_key"))


@query(r"SELECT page_id, url FROM pages WHERE regexp_extract(lower(url), '^https?://([^/]*)', 1) LIKE '%example.org' OR regexp_extract(lower(url), '^https?://([^/]*)', 1) LIKE '%ing.example.net'")
def f7_allowed_domains(spark, d):
    return table(spark, d, "pages").where(p.allowed_domain(F.col("url"), ("example.org", "ing.example.net"))).select("page_id", "url")


@query("SELECT page_id, regexp_matches(lower(url), '\\.(pdf|doc|docx|xls|xlsx|csv|zip)$') OR regexp_matches(lower(url), '/documents/|/uploads/|/files/|file=') AS prioritized, regexp_matches(lower(html), 'scheme|eligibility|apply|how to|guidelines|notice') AS topical FROM pages".replace("\\\\", "\\"))
def f9_f10_link_priority(spark, d):
    return table(spark, d, "pages").select("page_id", p.prioritized(F.col("url")).alias("prioritized"), p.topical(F.col("html")).alias("topical"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'images' ELSE 'unsupported' END AS format FROM pages")
def f12_file_format(spark, d):
    k = F.col("page_id") % 4
    key = F.when(k == 0, "a/page").when(k == 1, "a/b.bin").when(k == 2, "a/c.PNG?x=1").otherwise("a/d.xyz")
    content = F.when(k == 0, F.col("html").cast("binary")).when(k == 1, F.lit("%PDF-1.7").cast("binary")).otherwise(F.lit("plain").cast("binary"))
    return table(spark, d, "pages").select("page_id", p.file_format(key, content).alias("format"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'missing_fields' WHEN 1 THEN 'invalid_file_hash' WHEN 2 THEN 'invalid_timestamp' END AS fault FROM documents")
def f13_manifest_fault(spark, d):
    k = F.col("doc_id") % 4
    return table(spark, d, "documents").select("doc_id", p.manifest_fault(F.when(k == 1, "abc").otherwise(F.md5("text")), F.lit("html"), F.when(k != 0, "http://x"), F.when(k == 2, "yesterday").otherwise("2024-01-02T03:04:05.678Z")).alias("fault"))


@query("""
    SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id % 7 = 0 THEN 'not_modified' WHEN a.lang = b.lang THEN 'etag_match' WHEN a.n_chars = b.n_chars THEN 'last_modified_match' WHEN a.text = b.text THEN 'sha_match' ELSE 'changed' END AS change
    FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.doc_id % 3 <> 0
""")
def f14_j3_change_detection(spark, d):
    a = table(spark, d, "documents").withColumn("key", F.col("doc_id") + 1)
    b = table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("key"), F.col("lang").alias("l"), F.col("n_chars").alias("n"), F.sha2("text", 256).alias("sha"))
    both = a.join(b, "key", "left")
    return both.select("doc_id", p.change(F.col("l"), F.col("lang"), F.col("n"), F.col("n_chars"), F.col("sha"), F.sha2("text", 256), F.when(F.col("doc_id") % 7 == 0, 304).otherwise(200)).alias("change"))


@query("SELECT page_id, regexp_matches(html, '(?i)http://|https://|www\\.|file://') AS forbidden FROM pages".replace("\\\\", "\\"))
def f16_forbidden_text(spark, d):
    return table(spark, d, "pages").select("page_id", p.forbidden_text(F.col("html")).alias("forbidden"))
