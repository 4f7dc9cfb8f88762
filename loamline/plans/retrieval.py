"""Queries over chunking, retrieval, answers and channels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import answers, chunking, payload, respond, retrieve
from loamline.plans.scalars import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CHUNKS_SQL = """
    c AS (SELECT vec_id::VARCHAR AS chunk_id, embedding::DOUBLE[] AS e, coalesce(text, '') AS text, label, CASE label % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 WHEN 4 THEN 1.0 ELSE 0.95 END::DOUBLE AS w,
          's3://store/' || coalesce(source, 'none') || '/' || vec_id AS url FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
    r AS (SELECT vec_id::VARCHAR AS request_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 20 = 0)
"""


def chunks(spark, d):
    """The test tables as a vector table: every vector, with the document of its number if there is one, its label as the trust level."""
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    k = F.col("label") % 6
    level = F.when(k == 0, "gov").when(k == 1, "implementing_agency").when(k == 2, "NGO").when(k == 3, "news").when(k == 4, "other")
    meta = F.to_json(F.struct(level.alias("trust_level"), F.when(k == 5, "agency").alias("trust"), F.col("label").cast("string").alias("label")))
    both = e.join(docs, e["vec_id"] == docs["doc_id"], "left")
    return both.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "text", meta.alias("meta"), F.concat(F.lit("s3://store/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("vec_id").cast("string")).alias("source_url"))


def requests(spark, d):
    e = table(spark, d, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("vec_id").cast("string").alias("request_id"), "embedding", F.col("vec_id").cast("string").alias("chunk_id"), "label")


@query(f"""
    WITH {_CHUNKS_SQL}
    SELECT request_id, chunk_id, round(distance, 6) AS distance, place FROM (
      SELECT request_id, chunk_id, list_distance(r.e, c.e) AS distance, row_number() OVER (PARTITION BY request_id ORDER BY list_distance(r.e, c.e), chunk_id) AS place FROM r, c WHERE request_id <> chunk_id) WHERE place <= 50
""")
def j6_t1_vector_top_k(spark, d):
    return retrieve.top_k(requests(spark, d).drop("label"), chunks(spark, d), 50, not_self=True).withColumn("distance", F.round("distance", 6)).withColumn("place", F.col("place").cast("long"))


@query(f"""
    WITH {_CHUNKS_SQL}
    SELECT request_id, chunk_id, round(distance, 6) AS distance FROM (
      SELECT request_id, chunk_id, list_distance(r.e, c.e) AS distance, row_number() OVER (PARTITION BY request_id ORDER BY list_distance(r.e, c.e), chunk_id) AS place FROM r, c WHERE r.label = c.label) WHERE place <= 20
""")
def f1_t1_filtered_top_k(spark, d):
    asked = requests(spark, d).select("request_id", "embedding", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("no key!"), F.lit("x")).alias("filters"))
    return retrieve.top_k(asked, chunks(spark, d), 20).select("request_id", "chunk_id", F.round("distance", 6).alias("distance"))


_RETRIEVE_SQL = r"""
    n AS (SELECT * FROM (SELECT request_id, chunk_id, text, url, w, list_distance(r.e, c.e) AS distance, row_number() OVER (PARTITION BY request_id ORDER BY list_distance(r.e, c.e), chunk_id) AS place FROM r, c WHERE request_id <> chunk_id) WHERE place <= 50),
    u AS (SELECT *, row_number() OVER (PARTITION BY request_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY distance, chunk_id) AS copy FROM n),
    k AS (SELECT *, w / (1 + distance) AS score, row_number() OVER (PARTITION BY request_id ORDER BY w / (1 + distance) DESC, 1 / (1 + distance) DESC, chunk_id) AS number FROM u WHERE copy = 1)
"""


@query(f"WITH {_CHUNKS_SQL}, {_RETRIEVE_SQL} SELECT request_id, number, chunk_id, round(distance, 6) AS distance, round(score, 6) AS final_score FROM k WHERE number <= 5")
def q1_retrieve(spark, d):
    out = retrieve.retrieve(requests(spark, d).drop("label"), chunks(spark, d), 50, 5, not_self=True)
    return out.select("request_id", F.col("number").cast("long").alias("number"), "chunk_id", F.round("distance", 6).alias("distance"), F.round("final_score", 6).alias("final_score"))


@query(f"""
    WITH {_CHUNKS_SQL}, {_RETRIEVE_SQL}
    SELECT request_id, string_agg(chunk_id, ' ' ORDER BY number) AS chunk_ids, round(max(score), 6) AS top_similarity, max(score) >= 0.25 AS enough,
           string_agg(replace(url, 's3://store/', 'https://store.s3.amazonaws.com/'), ' ' ORDER BY number) AS sources FROM k WHERE number <= 5 GROUP BY request_id
""")
def f5_p3_p4_passages(spark, d):
    out = retrieve.passages(retrieve.retrieve(requests(spark, d).drop("label"), chunks(spark, d), 50, 5, not_self=True))
    out = out.withColumn("cites", respond.citations(F.col("passages")))
    return out.select("request_id", F.array_join(F.transform("passages", lambda x: x["chunk_id"]), " ").alias("chunk_ids"), F.round("top_similarity", 6).alias("top_similarity"), "enough", F.array_join(F.transform("cites", lambda x: x["source_url"]), " ").alias("sources"))


_WINDOW_SQL = r"""
    WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    s AS (SELECT doc_id, t, list_transform(list_filter(list_transform(regexp_extract_all(t, '(?s)(.+?[.?!\n]+|.+?$)'), lambda x: trim(x)), lambda x: x <> ''), lambda x: string_split(x, ' ')) AS ss FROM t WHERE t <> ''),
    l AS (SELECT doc_id, t, ss, flatten(ss) AS words, list_transform(range(len(ss) + 1), lambda i: list_sum(list_transform(ss[1:i], lambda x: len(x)))) AS sums FROM s),
    p AS (SELECT doc_id, t, ss, words, list_transform(sums, lambda x: coalesce(x, 0)::BIGINT) AS p FROM l),
    w(doc_id, wi, i, e) AS (
      SELECT doc_id, 0, 0, len(list_filter(p, lambda x: x <= 512)) - 1 FROM p
      UNION ALL
      SELECT doc_id, wi + 1, n, len(list_filter(p, lambda x: x <= p[n + 1] + 512)) - 1
      FROM (SELECT w.doc_id, w.wi, greatest(w.i + 1, w.e - 2) AS n, p.p, len(p.ss) AS m FROM w JOIN p USING (doc_id)) WHERE n < m),
    x AS (SELECT doc_id, wi, p.p[i + 1] AS token_start, CASE WHEN e > i THEN p.p[e + 1] ELSE p.p[i + 1] + 512 END AS token_end, CASE WHEN e > i THEN p.p[e + 1] - p.p[i + 1] ELSE 512 END AS n,
                 array_to_string(CASE WHEN e > i THEN words[p.p[i + 1] + 1 : p.p[e + 1]] ELSE words[p.p[i + 1] + 1 : p.p[i + 1] + 512] END, ' ') AS text, len(string_split(t, ' ')) AS total
          FROM w JOIN p USING (doc_id)),
    g AS (SELECT *, sum(CASE WHEN wi = 0 OR n >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY wi) AS grp FROM x),
    c AS (SELECT doc_id, min(wi) AS window_index, string_agg(text, ' ' ORDER BY wi) AS text, sum(n)::BIGINT AS token_count, min(token_start) AS token_start, arg_max(token_end, wi) AS token_end, any_value(total) AS total FROM g GROUP BY doc_id, grp
          UNION ALL SELECT doc_id, 0, '', 0, 0, 0, 0 FROM t WHERE t = '')
"""


@query(_WINDOW_SQL + """
    SELECT doc_id::VARCHAR AS document_id, doc_id || '_c' || printf('%04d', window_index) AS chunk_id, md5(text) AS text_md5, token_count, token_start, token_end,
           CASE WHEN total = 0 THEN 'unknown' WHEN (token_start + token_end) / 2.0 / total < .10 THEN 'intro' WHEN (token_start + token_end) / 2.0 / total < .30 THEN 'early' WHEN (token_start + token_end) / 2.0 / total < .75 THEN 'middle' WHEN (token_start + token_end) / 2.0 / total < .95 THEN 'late' ELSE 'footer' END AS semantic_region FROM c
""")
def u1_w7_chunk_windows(spark, d):
    out = chunking.html_chunks(table(spark, d, "documents"), "doc_id", "text")
    return out.select("document_id", "chunk_id", F.md5("text").alias("text_md5"), F.col("token_count").cast("long").alias("token_count"), F.col("token_start").cast("long").alias("token_start"), F.col("token_end").cast("long").alias("token_end"), "semantic_region")


@query(_WINDOW_SQL + """
    SELECT doc_id::VARCHAR AS document_id, doc_id || '_c' || printf('%04d', window_index) AS chunk_id, md5(text) AS text_md5, token_count::VARCHAR AS token_count, '[' || token_start || ',' || token_end || ']' AS token_range, total::VARCHAR AS document_total_tokens,
           CASE WHEN doc_id % 2 = 0 THEN 'http://o' WHEN doc_id % 3 = 0 THEN 'http://s' END AS source_url, CASE WHEN lang = source THEN '["' || lang || '"]' ELSE '["' || lang || '","' || source || '"]' END AS headings,
           CASE WHEN doc_id % 2 = 0 THEN '{"raw_sha256":"' || doc_id || '","raw_key":"' || doc_id || '","original_url":"http://o"}' ELSE '{"raw_sha256":"' || doc_id || '","raw_key":"' || doc_id || '"}' END AS provenance, NOT (doc_id % 2 = 0 OR doc_id % 3 = 0) AS lacks_source
    FROM c JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)
""")
def p10_p13_p14_chunk_payload(spark, d):
    docs = table(spark, d, "documents")
    original, source = F.when(F.col("doc_id") % 2 == 0, "http://o"), F.when(F.col("doc_id") % 3 == 0, "http://s")
    about = docs.select(F.col("doc_id").cast("string").alias("document_id"), payload.source_url(original, source, F.lit(None).cast("string")).alias("source_url"), original.alias("original_url"), F.col("lang").alias("title"), F.col("source").alias("parsed_title"), F.lit(None).cast("string").alias("file_type"), F.col("doc_id").cast("string").alias("raw_key"))
    lines = payload.html_payload(chunking.html_chunks(docs, "doc_id", "text").join(about, "document_id"), "v1", F.lit("2024-01-01T00:00:00.000Z"))
    get = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    return lines.select("document_id", get("chunk_id"), F.md5(F.get_json_object("value", "$.text")).alias("text_md5"), get("token_count"), get("token_range"), get("document_total_tokens"), get("source_url"), get("headings"), get("provenance"), (~F.col("value").contains('"source_url"')).alias("lacks_source"))


_PAGE_WINDOW_SQL = _WINDOW_SQL.replace("FROM documents", "FROM (SELECT conv_id || '/' || (turn + 1) AS doc_id, text FROM conversations)")


@query(_PAGE_WINDOW_SQL + """,
    n AS (SELECT split_part(doc_id, '/', 1) AS document_id, split_part(doc_id, '/', 2)::INT AS page_number, row_number() OVER (PARTITION BY doc_id ORDER BY window_index) - 1 AS number, text, token_count, total FROM c),
    m AS (SELECT *, coalesce(sum(token_count) OVER (PARTITION BY document_id ORDER BY page_number, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 sum(CASE WHEN number = 0 THEN total ELSE 0 END) OVER (PARTITION BY document_id) AS whole, max(page_number) OVER (PARTITION BY document_id) AS last_page FROM n),
    q AS (SELECT *, (before + token_count / 2.0) / nullif(whole, 0) AS mid FROM m)
    SELECT document_id, page_number, document_id || '_p' || page_number || '_' || printf('%04d', number) AS chunk_id, text, token_count::INT AS token_count, whole::BIGINT AS document_total_tokens,
           CASE WHEN whole = 0 THEN CASE WHEN page_number = 1 THEN 'intro' WHEN page_number = last_page THEN 'footer' ELSE 'middle' END WHEN mid < .10 THEN 'intro' WHEN mid < .30 THEN 'early' WHEN mid < .70 THEN 'middle' WHEN mid < .90 THEN 'late' ELSE 'footer' END AS semantic_region FROM q
""")
def u1_p11_w4_pdf_chunks(spark, d):
    pages = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).alias("page_number"), "text")
    return chunking.pdf_chunks(pages).drop("chunk_number", "token_start", "token_end")


def _raw_requests(spark, d):
    """User turns as requests, the language, channel and confidence varied."""
    k = F.col("conv_id") % 7
    t = table(spark, d, "conversations").where("role = 'user'")
    return t.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.when(k == 0, "xx").when(k == 1, " EN ").otherwise("hi").alias("language"),
        F.when(k == 2, "fax").when((k == 3) | (k == 5), "Voice").when(k == 4, "sms").otherwise("web").alias("channel"),
        F.when(k == 6, "  ").otherwise(F.col("text")).alias("query"), F.lit("").alias("question"), F.when(k == 5, (F.col("turn") / 4).cast("string")).alias("asr_confidence"), "conv_id", "turn",
    )


@query("""
    SELECT conv_id || '-' || turn AS request_id, CASE conv_id % 7 WHEN 0 THEN 'invalid_language' WHEN 2 THEN 'invalid_channel' WHEN 3 THEN 'missing_asr_confidence' WHEN 6 THEN 'empty_query' END AS error,
           CASE WHEN conv_id % 7 IN (0, 2, 3, 6) THEN 'refusal_invalid_request' WHEN conv_id % 7 = 5 AND turn / 4 < 0.25 THEN 'refusal_asr_low_confidence' END AS guidance_key FROM conversations WHERE role = 'user'
""")
def p5_f2_f4_request_gate(spark, d):
    return respond.gate(respond.canonical_request(_raw_requests(spark, d))).select("request_id", "error", "guidance_key")


@query("""
    SELECT conv_id, turn, 'LANGUAGE: en' || chr(10) || chr(10) || 'PASSAGES:' || chr(10) || '1. ' || trim(text, ' ' || chr(10) || chr(9)) || chr(10) || '2. b' || chr(10) || chr(10) || 'QUESTION:' || chr(10) || 'what?' || chr(10) || chr(10)
           || 'Answer from these passages if relevant; otherwise reply NOT_ENOUGH_INFORMATION. Each factual sentence must end with a [n] citation.' AS prompt FROM conversations
""")
def p6_prompt(spark, d):
    found = F.array(F.struct(F.lit(1).alias("number"), F.col("text").alias("text")), F.struct(F.lit(2).alias("number"), F.lit(" b ").alias("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", respond.prompt(F.lit("en"), F.lit("what?"), found).alias("prompt"))


def _answers(spark, d):
    """Assistant turns as generated answers, in each of the four modes."""
    k = F.col("conv_id") % 5
    t = table(spark, d, "conversations").where("role = 'assistant'")
    text = F.when(k == 0, F.concat("text", F.lit(" [n]."))).when(k == 1, F.concat("text", F.lit(" [2]"))).when(k == 2, F.concat("text", F.lit(" as passage 3 says"))).when(k == 3, F.lit("not_enough_information")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", text.alias("generated"), F.when(F.col("turn") % 4 == 1, 3).otherwise(8).alias("most"))


_LINES_SQL = r"""
    WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 3 ELSE 8 END AS most, CASE conv_id % 5 WHEN 0 THEN text || ' [n].' WHEN 1 THEN text || ' [2]' WHEN 2 THEN text || ' as passage 3 says' WHEN 3 THEN 'not_enough_information' ELSE text END AS g FROM conversations WHERE role = 'assistant'),
    l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(g, '\n'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS ls FROM a),
    m AS (SELECT *, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '(?i)\[n\][.!?]?$'))) > 0 THEN 'placeholder' WHEN len(list_filter(ls, lambda x: regexp_matches(x, '\[(\d+)\][.!?]*$'))) > 0 THEN 'explicit' WHEN len(list_filter(ls, lambda x: regexp_matches(x, '\b\d{1,3}\b'))) > 0 THEN 'number' ELSE 'sequence' END AS mode FROM l),
    f AS (SELECT *, list_transform(ls, lambda x: list_filter(list_transform(regexp_extract_all(x, '\b(\d{1,3})\b', 1), lambda n: n::INT), lambda n: n BETWEEN 1 AND most)[1]) AS firsts FROM m),
    c AS (SELECT *, CASE mode WHEN 'placeholder' THEN list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '(?i)\[n\][.!?]?$') THEN len(list_filter(ls[1:i], lambda y: regexp_matches(y, '(?i)\[n\][.!?]?$')))::INT ELSE try_cast(regexp_extract(x, '\[(\d+)\][.!?]*$', 1) AS INT) END)
                 WHEN 'explicit' THEN list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '\[(\d+)\][.!?]*$') THEN try_cast(regexp_extract(x, '\[(\d+)\][.!?]*$', 1) AS INT) ELSE firsts[i] END)
                 WHEN 'number' THEN list_transform(firsts, lambda n: coalesce(n, 1)) ELSE list_transform(ls, lambda x, i: i::INT) END AS cited FROM f)
    SELECT conv_id, turn, mode, CASE WHEN upper(array_to_string(ls, ' ')) = 'NOT_ENOUGH_INFORMATION' THEN 'NOT_ENOUGH_INFORMATION' WHEN mode = 'sequence' AND len(ls) > most THEN 'INVALID_OUTPUT'
           WHEN len(list_filter(cited, lambda n: n IS NULL OR n < 1 OR n > most)) > 0 THEN 'INVALID_OUTPUT' ELSE 'ACCEPT' END AS decision, array_to_string(list_transform(cited, lambda n: coalesce(n::VARCHAR, '-')), ' ') AS cited FROM c
"""


@query(_LINES_SQL)
def u4_validated_answers(spark, d):
    out = answers.validated(_answers(spark, d), "generated", "most")
    return out.select("conv_id", "turn", "mode", "decision", F.array_join(F.transform("cited", lambda c: c["cited"].cast("string")), " ", "-").alias("cited"))


_RESPONSES_SQL = rf"""
    WITH {_CHUNKS_SQL.split("r AS (")[0].rstrip().rstrip(",")},
    t AS (SELECT conv_id, turn, text, conv_id % 7 AS k FROM conversations WHERE role = 'user'),
    a AS (SELECT conv_id || '-' || turn AS request_id, conv_id, CASE WHEN k IN (0, 2, 3, 6) THEN 'refusal_invalid_request' WHEN k = 5 AND turn / 4 < 0.25 THEN 'refusal_asr_low_confidence'
            WHEN regexp_matches(text, '(?i)\b(medic(al|ine|ation)|prescrib|diagnos|symptom|treatment|clinic)\b') THEN 'refusal_medical'
            WHEN regexp_matches(text, '(?i)\b(attorney|sue|lawsuit|contract|custody|divorce|legal advice|crime|sentence)\b') THEN 'refusal_legal' END AS g FROM t JOIN embeddings ON vec_id = conv_id),
    r AS (SELECT request_id, embedding::DOUBLE[] AS e, '' AS own FROM a JOIN embeddings ON vec_id = conv_id WHERE g IS NULL),
    {_RETRIEVE_SQL.replace("request_id <> chunk_id", "own <> chunk_id")},
    p AS (SELECT request_id, string_agg(chunk_id, ' ' ORDER BY number) AS used, string_agg(replace(url, 's3://store/', 'https://store.s3.amazonaws.com/'), ' ' ORDER BY number) AS urls, max(score) AS top,
                 regexp_extract(trim(arg_min(text, number), ' ' || chr(10) || chr(9)), '^([^\n]*)', 1)[:80] || ' [n].' AS line FROM k WHERE number <= 5 GROUP BY request_id),
    o AS (SELECT a.request_id, g, used, urls, top, CASE WHEN g IS NOT NULL THEN 'refusal' WHEN coalesce(top, 0) < 0.25 THEN 'not_enough_info' ELSE 'answer' END AS resolution,
                 NOT regexp_matches(line, '(?i)http://|https://|www\.|file://') AS accepted, line FROM a LEFT JOIN p ON a.request_id = p.request_id),
    y AS (SELECT *, CASE WHEN resolution = 'answer' THEN CASE WHEN accepted THEN regexp_replace(line, '\[n\]\.$', '[1].') ELSE trim(line) END END AS answer FROM o)
"""


def _responses(spark, d):
    """Requests answered over the test tables; a request's vector is that of its conversation's number."""
    raw = _raw_requests(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    return respond.answer(raw.join(vectors, "conv_id"), chunks(spark, d))


@query(_RESPONSES_SQL + """
    SELECT request_id, resolution, g AS guidance_key, round(top, 6) AS top_similarity, answer, CASE WHEN resolution = 'answer' THEN urls END AS sources,
           CASE WHEN resolution = 'answer' THEN CASE WHEN accepted THEN 'high' ELSE 'low' END END AS confidence, CASE WHEN resolution = 'answer' AND NOT accepted THEN TRUE END AS citation_missing, coalesce(used, '') AS used_chunk_ids FROM y
""")
def q2_q3_handle(spark, d):
    out = _responses(spark, d)
    return out.select("request_id", "resolution", "guidance_key", F.round("top_similarity", 6).alias("top_similarity"), F.array_join("answer_lines", "\n").alias("answer"), F.array_join("sources", " ").alias("sources"), "confidence", "citation_missing", F.array_join("used_chunk_ids", " ").alias("used_chunk_ids"))


@query(_RESPONSES_SQL + """
    SELECT y.request_id, resolution, g AS guidance_key, answer, CASE WHEN resolution = 'answer' AND accepted THEN urls END AS citation_urls,
           CASE WHEN resolution = 'answer' AND k = 5 THEN trim(text, ' ' || chr(10) || chr(9)) END AS transcript FROM y JOIN t ON y.request_id = t.conv_id || '-' || t.turn
""")
def p7_p9_web_voice(spark, d):
    out = respond.voice(_responses(spark, d))
    return out.select("request_id", "resolution", "guidance_key", F.array_join("answer_lines", "\n").alias("answer"), F.array_join("citation_urls", " ").alias("citation_urls"), "transcript")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' WHEN doc_id % 3 = 0 THEN 'hi' ELSE 'en' END AS language FROM documents")
def p7_web_language(spark, d):
    asked = F.when(F.col("lang") == "en", " EN ").when(F.col("doc_id") % 3 == 0, "Hi").when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return table(spark, d, "documents").select("doc_id", respond.web_language(asked).alias("language"))


@query(_RESPONSES_SQL + """
    SELECT request_id, CASE WHEN resolution = 'answer' THEN answer || CASE WHEN accepted THEN chr(10) || 'Source: store.s3.amazonaws.com' ELSE '' END WHEN resolution = 'not_enough_info' THEN 'No authoritative information found.' ELSE 'Unable to provide information.' END AS message,
           CASE WHEN resolution <> 'answer' THEN coalesce(g, resolution) END AS reason FROM y
""")
def p8_sms(spark, d):
    return respond.sms(_responses(spark, d))
