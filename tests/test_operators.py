"""Hand-made cases of the retrieval operators."""

import json

import pytest
from pyspark.sql import functions as F

from loamline.functions import predicates as p
from loamline.functions import scalar as s
from loamline.operators import answers, chunking, crawl, index, respond, retrieve, sync
from loamline.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_windows():
    words = lambda n, tag="w": " ".join(f"{tag}{i}" for i in range(n))
    w = chunking.windows
    assert [(x.text, x.tokens) for x in w("")] == [("", 0)]
    assert [x.text for x in w("One two.")] == ["One two."]
    assert [(x.tokens, x.start, x.end) for x in w(words(512))] == [(512, 0, 512)]
    # A sentence over the limit loses its rest.
    assert [(x.tokens, x.end) for x in w(words(600))] == [(512, 512)]
    # The last two sentences come again, and are short, so they are joined to the window before.
    got = w(f"{words(170, 'a')}. b c. d.")
    assert len(got) == 1 and got[0].text.endswith("b c. d. b c. d. d.") and got[0].tokens == 173 + 3 + 1 and got[0].end == 173
    # Last sentences of 60 words each stay a window of their own.
    got = w(f"{words(300, 'a')}. {words(60, 'b')}. {words(60, 'c')}.")
    assert [(x.index, x.tokens) for x in got] == [(0, 420), (1, 180)]
    assert got[1].text.startswith("b0") and got[1].text.endswith("c59. " + words(60, "c") + ".")


@pytest.mark.parametrize(
    ("text", "most", "decision", "lines"),
    [
        ("", 3, "INVALID_OUTPUT", None),
        (" \n ", 3, "INVALID_OUTPUT", None),
        (None, 3, "INVALID_OUTPUT", None),
        ("Not_Enough_Information", 0, "NOT_ENOUGH_INFORMATION", None),
        ("a [1]", 0, "INVALID_OUTPUT", None),
        ("a\nNOT_ENOUGH_INFORMATION", 3, "NOT_ENOUGH_INFORMATION", None),
        ("a [n].\nb [N]", 3, "ACCEPT", ["a [1].", "b [2]"]),
        ("a [n]\nb [3].", 3, "ACCEPT", ["a [1]", "b [3]."]),
        ("a [n]\nb", 3, "INVALID_OUTPUT", None),
        ("a [n]\nb [n]", 1, "INVALID_OUTPUT", None),
        ("a [2].\nb see 3", 3, "ACCEPT", ["a [2]", "b see 3 [3]"]),
        ("a [2]\nb", 3, "INVALID_OUTPUT", None),
        ("a [9]", 3, "INVALID_OUTPUT", None),
        ("a https://x [1]", 3, "INVALID_OUTPUT", None),
        ("as passage 2 says\nb", 3, "ACCEPT", ["as 2 says [2]", "b [1]"]),
        ("of 77 cases", 3, "ACCEPT", ["of 77 cases [1]"]),
        ("a\nb", 2, "ACCEPT", ["a [1]", "b [2]"]),
        ("a\nb\nc", 2, "INVALID_OUTPUT", None),
        ("see www.x", 2, "INVALID_OUTPUT", None),
    ],
)
def test_answer(spark, text, most, decision, lines):
    r = answers.validated(spark.createDataFrame([(text, most)], "t string, m int"), "t", "m").first()
    assert r.decision == decision
    if lines:
        assert [c.text for c in r.cited] == lines


def test_scalars(spark):
    assert one(spark, s.similarity(F.lit(None).cast("double"))) == 0.0
    assert one(spark, s.trust_weight(F.lit(""), F.lit("NGO"))) == 0.8
    assert one(spark, s.trust_weight(F.lit(None), F.lit(None))) == 1.0
    assert one(spark, s.text_key(F.lit("ＡＢＣ  d"))) == one(spark, s.text_key(F.lit("abc d ")))
    assert one(spark, s.text_key(F.lit(None).cast("string"))) == ""
    for url, want in {
        "HTTPS://Ex.COM/A/?b=2&utm_x=1&a=1#f": "https://ex.com/A/?a=1&b=2",
        "http://x.org/": "http://x.org",
        "//x.org/a?fbclid=1": "http://x.org/a",
        "http://x.org/p/?q=a%20b": "http://x.org/p/?q=a b",
    }.items():
        assert one(spark, s.canonical_url(F.lit(url))) == want
    assert one(spark, s.html_region(F.lit(0), F.lit(0), F.lit(0))) == "unknown"
    assert [one(spark, s.html_region(F.lit(a), F.lit(a), F.lit(100))) for a in (9, 10, 30, 75, 95)] == ["intro", "early", "middle", "late", "footer"]
    assert [one(spark, s.pdf_region(F.lit(a), F.lit(0), F.lit(100), F.lit(1), F.lit(9))) for a in (9, 10, 30, 70, 90)] == ["intro", "early", "middle", "late", "footer"]
    assert [one(spark, s.pdf_region(F.lit(0), F.lit(0), F.lit(0), F.lit(a), F.lit(9))) for a in (1, 5, 9)] == ["intro", "middle", "footer"]
    assert one(spark, s.https_source(F.lit("s3://b"))) == "https://b.s3.amazonaws.com/"
    assert one(spark, s.comparable_etag(F.lit('W/"0xAB"'))) == "ab"


def test_predicates(spark):
    assert one(spark, p.blocked_intent(F.lit("my medicine and my lawsuit"))) == "refusal_medical"
    assert one(spark, p.blocked_intent(F.lit("a diagnosis"))) is None
    assert one(spark, p.blocked_intent(F.lit("I want to Sue"))) == "refusal_legal"
    assert one(spark, p.asr_refusal(F.lit("voice"), F.lit(0.25))) is None
    assert one(spark, p.asr_refusal(F.lit("voice"), F.lit(0.24))) == "refusal_asr_low_confidence"
    assert one(spark, p.allowed_domain(F.lit("https://evilindia.gov.in/x"), ("india.gov.in",)))
    assert one(spark, p.allowed_domain(F.lit("https://x.org"), ()))
    assert one(spark, p.implies_document(F.lit("/a"), F.lit("Gazette")))
    assert not one(spark, p.implies_document(F.lit("/a"), F.lit("more")))
    assert one(spark, p.file_format(F.lit("x/y"), F.lit("riff....WEBP").cast("binary"))) == "images"
    assert one(spark, p.file_format(F.lit("x/y.php"), F.lit("?").cast("binary"))) == "html"


def test_request_order(spark):
    rows = [("1", None, "fax", "", None, None), ("2", "en", "fax", "", None, None), ("3", "en", "voice", "", None, None), ("4", "en", "voice", "q", None, "x"), ("5", "en", "voice", None, "q", "0.5"), ("6", " EN ", "Web", " q ", None, None)]
    got = respond.canonical_request(spark.createDataFrame(rows, "request_id string, language string, channel string, query string, question string, asr_confidence string")).orderBy("request_id").collect()
    assert [r.error for r in got] == ["invalid_language", "invalid_channel", "empty_query", "missing_asr_confidence", None, None]
    assert (got[5].language, got[5].channel, got[5].query) == ("en", "web", "q")


def test_retrieval_filters_and_ties(spark):
    chunks = spark.createDataFrame(
        [("b", [0.0, 1.0], '{"k":"1","n":{"x":2}}', "T x", None), ("a", [0.0, 1.0], '{"k":"1"}', "t  X ", "s3://b/k"), ("c", [1.0, 0.0], '{"trust":"news"}', "u", None), ("d", None, None, "v", None)],
        "chunk_id string, embedding array<float>, meta string, text string, source_url string",
    )
    ask = lambda f: spark.createDataFrame([("r", [0.0, 1.0], f)], "request_id string, embedding array<float>, filters map<string,string>")
    ids = lambda f, k=50: [r.chunk_id for r in retrieve.top_k(ask(f), chunks, k).orderBy("place").collect()]
    assert ids({}) == ["a", "b", "c"] and ids({}, 1) == ["a"]
    assert ids({"k": "1"}) == ["a", "b"] and ids({"no key": "1"}) == ["a", "b", "c"] and ids({"z": "1"}) == []
    got = retrieve.retrieve(ask({}), chunks).orderBy("number").collect()
    assert [(r.chunk_id, r.number) for r in got] == [("a", 1), ("c", 2)] and got[1].trust_weight == 0.6
    assert retrieve.passages(retrieve.retrieve(ask({"z": "1"}), chunks)).count() == 0
    assert retrieve.top_k(ask({}).limit(0), chunks).count() == 0


def test_index_is_idempotent(spark, tmp_path):
    lines = [{"document_id": "d", "chunk_id": f"d_c{i % 3}", "chunk_index": i % 3, "text": None if i == 0 else f" t{i} \r\n", "parser_version": "v", "extra": {"a": [1]}} for i in range(4)]
    raw = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{bad",), ('{"document_id": "d"}',), ('"text"',)], "value string")
    rows = index.normalise(raw)
    assert rows.groupBy("fault").count().collect() and {r.fault: r["count"] for r in rows.groupBy("fault").count().collect()} == {None: 4, "malformed": 2, "missing_field": 1}
    kept = {r.chunk_id: r for r in rows.where("fault is null").collect()}
    assert json.loads(kept["d_c1"].meta)["extra"] == {"a": [1]} and kept["d_c1"].content == "t1"
    path = str(tmp_path / "table")
    assert index.append_unseen(rows, path) == 3
    first = spark.read.parquet(path).orderBy("chunk_id").collect()
    assert len(first) == 3 and len(first[0].embedding) == 64
    index.append_unseen(rows, path)
    assert spark.read.parquet(path).count() == 3


def test_stream_is_idempotent(spark, tmp_path):
    from loamline.streaming.incremental import index_new_files

    src = tmp_path / "chunks"
    src.mkdir()
    write = lambda n, ids: (src / f"{n}.chunks.jsonl").write_text("".join(json.dumps({"document_id": "d", "chunk_id": i, "chunk_index": 0, "text": i, "parser_version": "v"}) + "\n" for i in ids))
    write("one", "abc")
    table = str(tmp_path / "table")
    index_new_files(spark, str(src), table, str(tmp_path / "c1"))
    write("two", "bcd")
    index_new_files(spark, str(src), table, str(tmp_path / "c1"))
    index_new_files(spark, str(src), table, str(tmp_path / "c2"))  # a lost checkpoint
    assert sorted(r.chunk_id for r in spark.read.parquet(table).collect()) == list("abcd")


def test_mirror(spark):
    md5 = "0" * 31 + "1"
    import base64

    there = [("sha", "s", None, None, 1), ("hex", None, md5, None, 1), ("b64", None, base64.b64encode(bytes.fromhex(md5)).decode(), None, 1), ("etag", None, None, f'"{md5.upper()}"', 1), ("multi", None, None, f'"{md5}-2"', 1), ("size", None, None, md5, 2), ("orphan", None, None, None, 1)]
    here = [(r, "s", md5, 1) for r in ("sha", "hex", "b64", "etag", "multi", "size", "new")]
    got = sync.mirror(spark.createDataFrame(here, "rel string, sha256 string, md5 string, size long"), spark.createDataFrame(there, "rel string, sha256 string, content_md5 string, etag string, size long"))
    assert {r.rel: (r.action, r.reason) for r in got.collect()} == {
        "sha": ("skip", "match_metadata_sha256"), "hex": ("skip", "match_content_md5_hex"), "b64": ("skip", "match_content_md5_base64"), "etag": ("skip", "match_etag_md5"),
        "multi": ("upload", "no_reliable_remote_checksum"), "size": ("upload", "no_reliable_remote_checksum"), "new": ("upload", "remote_missing"), "orphan": ("keep", "local_missing"),
    }


def test_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.html").write_text("<html>")
    (raw / "b.html").write_text("<html>")
    (raw / "a.html.manifest.json").write_text('{"file_hash": "abc",\n "size_bytes": 6}')
    (raw / "x.chunks.jsonl").write_text('{"a":1}\n\n  \n{"a":2}\n')
    objects = files.raw_objects(spark, str(raw)).where("path like '%.html'")
    got = files.with_manifest(objects.withColumn("path", F.regexp_replace("path", "^file:/+", "/")), files.manifests(spark, str(raw)).withColumn("raw_key", F.regexp_replace("raw_key", "^file:/+", "/"))).collect()
    assert {r.path.rsplit("/", 1)[1]: r.file_hash for r in got} == {"a.html": "abc", "b.html": None}
    (raw / "y.chunks.jsonl").write_bytes('{"a":"\u00e9"}\n'.encode("latin-1"))
    assert sorted(r.value for r in files.chunk_lines(spark, str(raw)).collect()) == ['{"a":"\u00e9"}', '{"a":1}', '{"a":2}']
    chunks = spark.createDataFrame([("d", "d_c0000", None)], "document_id string, chunk_id string, page_number int")
    files.write_chunk_files(chunks, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"chunk_id":"d_c0000","document_id":"d"}'
    put = spark.createDataFrame([("s", "html", b"1"), ("s", "html", b"1"), ("t", "html", b"2")], "source_id string, ext string, content binary")
    assert files.put_unseen(put, str(tmp_path / "store")) == 2 and files.put_unseen(put, str(tmp_path / "store")) == 0


def test_http_source(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.send_header("ETag", '"e"')
            self.end_headers()
            self.wfile.write(b"body")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    from loamline.sources import http as source

    source.register(spark)
    base = f"http://127.0.0.1:{server.server_port}"
    got = {r.url: r for r in spark.read.format("loamline_http").option("urls", json.dumps([base + "/ok", base + "/no"])).option("attempts", 1).load().collect()}
    server.shutdown()
    assert bytes(got[base + "/ok"].content) == b"body" and got[base + "/ok"].etag == '"e"' and got[base + "/no"].status == 404


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b", False), ("b", "c", False), ("c", "d", False), ("c", "e", True), ("e", "a", True), ("e", "f", True)], "src string, dst string, prioritized boolean")
    got = crawl.crawl(edges, spark.createDataFrame([("a",)], "url string"))
    assert {r.url: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "e": 3, "f": 4}
    html = '<link rel=next href="n.html"><a href="/long/f.pdf">Form</a><script>"/data/v1/all.json?a=1" "/a.json" "rel/f.zip"</script><a href="q">how to apply</a><a>none</a><map><area href="m"></map>'
    page = spark.createDataFrame([(1, "http://h/x/", html), (2, None, None)], "page_id long, url string, html string")
    read = {r.page_id: r for r in crawl.link_density(crawl.read_pages(page)).collect()}
    assert [x.href for x in read[1].links] == ["http://h/x/n.html", "http://h/long/f.pdf", "http://h/x/q", "http://h/x/m"]
    assert read[1].harvested == ["http://h/data/v1/all.json?a=1", "http://h/long/f.pdf"] and read[2].link_density == 0.0
    assert {(r.url, r.prioritized) for r in crawl.candidates(page).collect()} == {("http://h/long/f.pdf", True), ("http://h/x/q", False), ("http://h/data/v1/all.json?a=1", False)}


def test_links_and_robots(spark):
    many = spark.createDataFrame([(1, "http://h/", "".join(f'<a href="/files/{i}">x</a>' for i in range(450)))], "page_id long, url string, html string")
    assert crawl.candidates(many).count() == 400  # a page's first links
    files_ = spark.createDataFrame([("http://h/robots.txt", 200, b"User-agent: *\nDisallow: /no"), ("http://g/robots.txt", 404, None)], "url string, status int, content binary")
    urls = spark.createDataFrame([("http://H/no/x",), ("http://h/yes",), ("http://g/no",), ("nothing",)], "url string")
    robots = crawl.robots_files(urls, lambda asked: asked.join(files_, "url"))
    assert {r.url: r.allowed for r in crawl.robots_allow(urls, robots, "me").collect()} == {"http://H/no/x": False, "http://h/yes": True, "http://g/no": True, "nothing": True}


def test_crawl_fetches_documents_first_and_follows(spark):
    pages = {"http://h/a": '<a href="/b">how to apply</a><a href="/f/one.pdf">pdf</a><a href="http://other/x">notice</a>', "http://h/b": '<a href="/c">notice</a>', "http://h/c": '<a href="/d">notice</a><a href="/files/e">e</a>', "http://h/d": "d", "http://h/files/e": "e", "http://h/f/one.pdf": "same", "http://other/x": "x"}
    table, asked = spark.createDataFrame(list(pages.items()), "url string, html string"), []

    def fetch(frontier):
        asked.append([(r.url, r.prioritized) for r in frontier.collect()])
        return frontier.select("url").join(table, "url")

    got = {r.url: r.depth for r in crawl.crawl_pages(spark.createDataFrame([("HTTP://H/a#x",), ("http://h/a",)], "url string"), fetch, allowed=("h",)).collect()}
    assert got == {"http://h/a": 0, "http://h/b": 1, "http://h/f/one.pdf": 1, "http://h/c": 2, "http://h/files/e": 3}
    assert asked[1] == [("http://h/f/one.pdf", True), ("http://h/b", False)]


def test_html_to_chunks_and_manifests(spark):
    from loamline.operators import ingest

    page = '<html><head><title>A &amp; B</title><link rel="canonical" href="http://c/x"></head><body><p>One two.<p>Three</p><ul><li>four</ul><div>five</div><script><p>six</script></body>'
    objects = spark.createDataFrame([("a.html", page.encode()), ("b.html", page.encode()), ("c.html", "caf\u00e9".encode("latin-1")), ("d.png", b"x"), ("e.html", b"done")], "key string, content binary")
    import hashlib

    done = spark.createDataFrame([(hashlib.sha256(b"done").hexdigest(),)], "document_id string")
    lines, manifests = ingest.parse(objects, done, "v1", F.lit("t"))
    got = [json.loads(r.value) for r in lines.collect()]
    # The last sentence comes again, as it does in every short text of several.
    assert {x["text"]: (x.get("source_url"), x.get("headings")) for x in got} == {"One two. Three four Three four": ("http://c/x", ["A & B"]), "caf\u00e9": (None, None)}
    assert {r.key: (r.saved_chunks, r.error) for r in manifests.collect()} == {"a.html": (1, None), "b.html": (1, None), "c.html": (1, None), "d.png": (None, "no parser for images")}
    ran = []
    assert ingest.run_stages([("one", lambda: ran.append(1)), ("two", lambda: 1 / 0), ("three", lambda: ran.append(3))]) == 1 and ran == [1] and ingest.run_stages([("one", lambda: 1)]) == 0


def test_mirror_is_carried_out(spark, tmp_path):
    here, there = tmp_path / "here", tmp_path / "there"
    (here / "sub").mkdir(parents=True)
    there.mkdir()
    (here / "sub" / "a").write_text("new")
    (here / "b").write_text("same")
    (there / "b").write_text("same")
    (there / "orphan").write_text("x")
    assert sorted((r.rel, r.size) for r in files.listing(spark, str(here)).collect()) == [("b", 4), ("sub/a", 3)]

    def digests(path):
        found = files.raw_objects(spark, str(path)).select(F.regexp_replace("path", f"^file:/*{str(path).lstrip('/')}/", "").alias("rel"), *sync.digests(F.col("content")))
        return found.withColumn("content_md5", F.lit(None).cast("string")).withColumn("etag", F.lit(None).cast("string"))

    plan = sync.mirror(digests(here), digests(there), delete_orphans=True)
    dry = sync.carry_out(plan, f"file://{here}", f"file://{there}", dry_run=True).collect()
    assert {(r.rel, r.action, r.done) for r in dry} == {("sub/a", "upload", False), ("orphan", "delete", False)} and (there / "orphan").exists()
    assert all(r.done for r in sync.carry_out(plan, f"file://{here}", f"file://{there}").collect())
    assert (there / "sub" / "a").read_text() == "new" and not (there / "orphan").exists()


def test_requests_with_their_own_limits_and_odd_vectors(spark):
    chunks = spark.createDataFrame([(f"c{i}", [float(i), 0.0], "{}", f"t{i}", None) for i in range(6)] + [("long", [0.0] * 3, "{}", "l", None), ("null", None, None, None, None)], "chunk_id string, embedding array<float>, meta string, text string, source_url string")
    asked = spark.createDataFrame([("a", [0.0, 0.0], 4, 2), ("b", [5.0, 0.0], None, None), ("none", None, None, None), ("other", [0.0] * 3, None, None)], "request_id string, embedding array<float>, raw_k int, top_k int")
    got: dict = {}
    for r in retrieve.top_k(asked, chunks, 3).orderBy("request_id", "place").collect():
        got.setdefault(r.request_id, []).append(r.chunk_id)
    assert got == {"a": ["c0", "c1", "c2", "c3"], "b": ["c5", "c4", "c3"], "other": ["long"]}
    best = retrieve.retrieve(asked, chunks, 3, 3).groupBy("request_id").count().collect()
    assert {r.request_id: r["count"] for r in best} == {"a": 2, "b": 3, "other": 1}


def test_many_requests_are_answered_in_turns(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "MOST_REQUESTS", 3)
    chunks = spark.createDataFrame([(f"c{i}", [float(i)], None) for i in range(40)], "chunk_id string, embedding array<float>, meta string")
    asked = spark.createDataFrame([(f"r{i}", [float(i)]) for i in range(10)], "request_id string, embedding array<float>")
    assert {(r.request_id[1:], r.chunk_id[1:]) for r in retrieve.top_k(asked, chunks, 1).collect()} == {(str(i), str(i)) for i in range(10)}


def test_a_model_that_fails_refuses_one_request(spark):
    def model(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return "fine [n]."

    chunks = spark.createDataFrame([("c", [0.0], "{}", "text", None)], "chunk_id string, embedding array<float>, meta string, text string, source_url string")
    asked = spark.createDataFrame([(q, "en", "web", q, None, None, [0.0], k) for q, k in (("good", "1"), ("bad", "x"))], "request_id string, language string, channel string, query string, question string, asr_confidence string, embedding array<float>, top_k string")
    got = {r.request_id: r.resolution for r in respond.answer(asked, chunks, generate=respond.guarded(model)).collect()}
    assert got == {"good": "answer", "bad": "refusal"}


def test_layout(spark):
    from loamline.operators import layout

    blocks = [("d", 1, 1, 0.0, 0.0, 100.0, 10.0, "a"), ("d", 1, 2, 0.0, 20.0, 100.0, 30.0, "b\x07"), ("d", 1, 3, 300.0, 5.0, 400.0, 15.0, "right"), ("d", 1, 4, 302.0, 0.0, 402.0, 4.0, "top"), ("d", 1, 5, 1.0, 50.0, 101.0, 60.0, "figure text"), ("e", 2, 1, 0.0, 0.0, 5.0, 5.0, "alone")]
    figures = [("d", 1, 0.0, 50.0, 50.0, 60.0)]
    got = layout.page_text(spark.createDataFrame(blocks, "document_id string, page_number int, block int, x0 double, y0 double, x1 double, y1 double, text string"), spark.createDataFrame(figures, "document_id string, page_number int, x0 double, y0 double, x1 double, y1 double"))
    assert {(r.document_id, r.text) for r in got.collect()} == {("d", "a b top right"), ("e", "alone")}


def test_payload_and_manifests(spark):
    from loamline.operators import payload

    assert one(spark, payload.headings(F.lit("T"), F.lit("T"))) == ["T"] and one(spark, payload.headings(F.lit(""), F.lit(None).cast("string"))) == []
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert {tuple(r) for r in payload.insert_absent(new, old, "k").collect()} == {(1, "o"), (2, "o"), (3, "n")}
    assert {tuple(r) for r in payload.overwrite(new, old, "k").collect()} == {(1, "o"), (2, "n"), (3, "n")}


def test_counts_as_rows_pass(spark):
    rows, seen = index.observed(index.normalise(spark.createDataFrame([("{bad",), ('{"a": 1}',)], "value string")))
    rows.collect()
    assert seen.get == {"seen": 2, "indexed": 0, "skipped": 2}


def test_lines_end_where_unicode_says(spark):
    got = spark.createDataFrame([("a\u2028b\r\nc\x85\n d ",)], "t string").select(answers.lines(F.col("t")).alias("x")).first().x
    assert got == ["a", "b", "c", "d"]


def test_titles_as_written(spark, tmp_path):
    import duckdb

    from loamline.operators import ingest
    from loamline.plans import ingest as plans

    pages = [(1, "<head><title>a &amp;&amp &quot;b&lt</title></head><p>x</p>"), (2, "<p>no title</p>"), (3, "<TITLE\nid='t'>two\nlines</TITLE><title>other &amp</title><p>y"), (4, None), (5, "no paragraph")]
    df = spark.createDataFrame([(k, f"u{k}", x) for k, x in pages], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.title_source) for r in ingest.read_html(df.select("page_id", "html"), F.col("html")).collect()}
    assert got == {1: ('a && "b<', "a &amp;&amp &quot;b&lt"), 2: (None, None), 3: ("two\nlines", "two\nlines"), 4: (None, None), 5: (None, None)}
    # The query is its SQL's, with references that it does not read, without a title or paragraph, and for null.
    df.where("page_id <> 3").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {tuple(r) for r in plans.QUERIES["u2_c18_html_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows == set(con.execute(plans.ORACLES["u2_c18_html_text"]).fetchall())


def test_page_text_as_sql(spark, tmp_path):
    import duckdb

    from loamline.plans import relational

    # Negative order keys, keys beyond a double's digits, no quantity (no centre), no supplier (no y) and pages without any text; no ties.
    rows = [(first + k, 100 * ((k * 37 + n * 11) % 101) + k * 3 + n, (k * 53 + n * 29) % 1000, n, 1.0 + (k * 7 + n * 5) % 50) for first in (-150, 9 * 10**17) for k in range(300) for n in (1, 2, 4)]
    rows += [(1000 + k, k * 17 % 400 + n, None if k % 7 == 1 else k * 41 % 900, n, None if k % 5 == 2 else 3.0 + k % 9) for k in range(100) for n in (2, 3)]
    rows += [(2000 + k, None, k, 1, 5.0) for k in range(9)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    name = "s13_j7_a9_w5_t5_page_text"
    got = {(r.document_id, r.page_number): r.text for r in relational.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {(d, p): t for d, p, t in con.execute(relational.ORACLES[name]).fetchall()}
    assert None in got.values() and min(got)[0] == -1 and max(got)[0] == 9 * 10**15 + 2


def test_tied_blocks_share_a_column(spark):
    from loamline.operators import layout

    # b and c have one centre and block number, and columns part after them and before them.
    blocks = [("d", 1, 1, 0.0, 0.0, 10.0, 5.0, "a"), ("d", 1, 2, 50.0, 9.0, 60.0, 12.0, "b"), ("d", 1, 2, 50.0, 1.0, 60.0, 4.0, "c"), ("d", 1, 3, 100.0, 0.0, 110.0, 5.0, "e"), ("d", 1, 4, 101.0, 0.0, 111.0, 5.0, "f"), ("d", 1, 5, 102.0, 0.0, 112.0, 5.0, "g")]
    schema = "document_id string, page_number int, block int, x0 double, y0 double, x1 double, y1 double, text string"
    for rows in (blocks, blocks[::-1]):
        got = layout.page_text(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))
        assert [r.text for r in got.collect()] == ["a c b e f g"]


def test_tied_blocks_come_as_stored(spark, tmp_path):
    import duckdb

    from loamline.plans import relational

    # Rows of one page, block, centre and y, in two files of which Spark reads the second, larger one first.
    con = duckdb.connect()
    (tmp_path / "lineitem.parquet").mkdir()
    for file, first, n in (("a", 9, 1), ("b", 1, 5)):
        con.execute(f"COPY (SELECT 300 AS l_orderkey, ({first} + {n} - i) * 500 AS l_partkey, 7 AS l_suppkey, 1 AS l_linenumber, 5.0::DOUBLE AS l_quantity FROM range({n}) b(i) ORDER BY i) TO '{tmp_path}/lineitem.parquet/{file}.parquet' (FORMAT parquet)")
    got = relational.QUERIES["s13_j7_a9_w5_t5_page_text"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(3, 1, "w5000 w3000 w2500 w2000 w1500 w1000")]


def test_gaps_without_a_time_come_last(spark):
    from loamline.operators import layout

    rows = spark.createDataFrame([("u", 1, None, 9.0), ("u", 2, 5, 1.0), ("u", 3, 7, 4.0)], "user_id string, event_id int, ts int, value double")
    assert {r.event_id: r.gap for r in layout.gap_before(rows, "user_id", ["ts", "event_id"], "value").collect()} == {2: None, 3: 3.0, 1: 5.0}
