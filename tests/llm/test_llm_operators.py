"""Each operator against brute force, an exact round trip, or held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loamline.llm import components, decontam, exact, html, labelled, pack, pii, queries, shard, simhash, wordpiece
from loamline.llm.common import table
from loamline.llm.tokens import ChunkEncoder


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, duck, name):
    from conftest import canonical

    df = queries.QUERIES[name](spark, sf_dir)
    got = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), names)


# ---------------------------------------------------------------- 1


def test_extraction(spark, sf_dir):
    import html as entities

    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    for r in queries.op1_block_tree_extraction(spark, sf_dir).collect():
        body = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p)


def test_extraction_of_other_pages():
    tree = html.decision_tree()
    body = "A long enough paragraph that tells the story of the day, with a comma and a good many words to be read by all."
    page = f"""<html><head><title>No</title><script>if (a<b) "<p>no</p>"</script></head><body class="home">
      <header><h1>Site name</h1></header><div id="menu-main"><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>
      <div class="cookie-notice">We use cookies to make this site work, and for nothing else at all, as we say here at length for once.</div>
      <article class="post"><header class="entry-header"><h1>Title &amp; more</h1></header><p>{body}<p>Short.</p><p>See <a href=z>this</a> one, too.</p><div class="topbar">Read this as well, and this, and then some of that</div><aside>Beside the point, in some
      <form><p>Name: <input name=n> and tell us what you think about it in your own words</p></form></article>
      <section id="comments"><h3>Comments</h3><p>{body}</p></section><div class="sidebar"><p>{body}</p></div><footer><p>{body}</p></footer>
      <div style="display: none"><p>{body}</p></div><!-- <p>{body}</p> --></body></html>"""
    assert html.main_text(page, tree)[0] == f"Title & more\n{body}\nShort.\nSee this one, too."
    plain = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div>{body}</div><div>{body}<br>{body}</div><div><a href=3>About</a></div></body>"
    assert html.main_text(plain, tree)[0] == f"{body}\n{body} {body}"
    # Names that merely contain such a word, names in other languages, a comment that is an article, a notice in the article's header.
    page = f"""<main><article><header><h1>Title</h1><div class="notice">{body}</div></header><p class="share-price">{body}</p><p id="search-for-life">{body}</p><div class="alert-level">{body}</div><div class="ad-slot big">{body}</div>
      <article><p>{body}</p></article></article><section class="comment-list">{body}</section></main><div class="seitenleiste"><p>{body}</p></div><section class="kommentare"><p>{body}</p><p>{body}</p></section>"""
    assert html.main_text(page, tree)[0] == f"Title\n{body}\n{body}\n{body}"


def test_counts_and_densities_decide(spark):
    """Without a word of what tags say, a tree of counts and densities alone finds nine pages of ten."""
    tree, pages = html.grow(html.labelled()), table(spark, "/root/testdata/sf0.01", "pages").collect()
    same = 0
    for p in pages:
        found = html.blocks(p.html)
        own = [(float(b.words), b.link_words / b.words) for b in found]
        padded = [(0.0, 0.0), *own, (0.0, 0.0)]
        kept = [html.keep(tree, [*own[i], *padded[i], *padded[i + 2], float(b.heading), float(b.item)]) for i, b in enumerate(found)]
        same += kept == [b.article == 1 for b in found]
    assert same >= 0.9 * len(pages)
    # The tree's upper nodes ask for nothing else, either.
    def above(t, depth):
        return [] if isinstance(t, int) or not depth else [t[0], *above(t[2], depth - 1), *above(t[3], depth - 1)]

    assert set(above(html.decision_tree(), 2)) <= set(range(6))


@pytest.mark.parametrize("unit", ["<div>x", "x</p>", "<p>x</b></div>", "<li><a href='x'>x", '<p class="', "<!--", "<script>x", "<h1>x<p>"])
def test_very_long_and_deep_pages_take_linear_time(unit):
    import time

    def took(n):
        began = time.thread_time()
        html.main_text(unit * (n // len(unit)), tree)
        return time.thread_time() - began

    tree = html.decision_tree()
    took(20_000)
    assert took(1_000_000) < 12 * max(took(200_000), 0.05)


# ---------------------------------------------------------------- 2


def test_substituted_passage(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    item = rng.sample(words, 40)
    swapped = [f"x{i}" if i % 6 == 5 else w for i, w in enumerate(item)]
    docs = [(1, " ".join(rng.sample(words, 50) + item + rng.sample(words, 50))), (2, " ".join(rng.sample(words, 50) + swapped)), (3, " ".join(item[:16] + rng.sample(words, 30))), (4, " ".join(item[:9] + rng.sample(words, 60))), (5, " ".join(rng.sample(words, 200))), (6, "! ".join(item).upper())]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {1, 2, 3, 6}


def test_partial_and_short_quotes(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(3000)]
    item, short, tiny = rng.sample(words, 60), [f"s{i}" for i in range(6)], ["t0", "t1"]
    some = lambda n: rng.sample(words, n)
    docs = [(1, some(80) + item[20:33] + some(80)), (2, some(80) + item[20:29] + some(80)), (3, some(20) + short + some(20)), (4, some(20) + short[:5]), (5, some(5) + tiny + some(5)), (6, tiny), (7, some(40))]
    got = decontam.contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(short)), (9, " ".join(tiny)), (10, " !? ")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.matched, r.compared) for r in got.collect()} == {(1, 7, 13, 13), (3, 8, 6, 6), (6, 9, 2, 2)}


def test_large_benchmarks_are_exchanged(spark, sf_dir, monkeypatch):
    """The same rows by exchange as by broadcast, and no text goes through the exchange by seed."""
    want = sorted(map(tuple, queries.op2_spaced_seed_decontamination(spark, sf_dir).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    got = queries.op2_spaced_seed_decontamination(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want and want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_seed = [x.split("hashpartitioning(seed")[0] for x in plan.split("\n") if "hashpartitioning(seed" in x]
    assert len(by_seed) == 2 and "hashpartitioning(row" in plan and "Broadcast" not in plan


# ---------------------------------------------------------------- 3


def test_ids_are_the_tokenizers(texts):
    path = queries.tokenizer("word_bpe_49k.json")
    encoder = ChunkEncoder(path)
    odd = ["", "It's  a test’s é \n<|endoftext|>x <|end of|> 你好　ß", "a\x0bb\x1fc d 'S 12 3", "ÉCOLE, Éé. İx ǅ word... x² ½. ª º’ Ωσς ΑΣ. é. ́. ' '' s's ", "don't!! we've (it'll) \"no\"", "x" * 5000, "ſ K Å", "BELGESİ. İ, xİ! İ İ... aİ-b"]
    rng = random.Random(12)
    odd += ["".join(rng.choice("aİI .,'!x\u0307é") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    every = odd + list(texts.values())
    want = encoder.tokenizer.encode_batch(every, add_special_tokens=False)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.texts(every)] == [e.ids for e in want]


def test_words_before_commas_are_known_words():
    encoder = ChunkEncoder(queries.tokenizer("word_bpe_49k.json"))
    rng = random.Random(13)
    every = ["Word, word. a\nword,\tword. 3, é. a"] + ["".join(rng.choice("aÉß3²ªµ .,,'!\xa0\x85\u0301 \n") for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.texts(every[:1])]
    assert not any(len(c) > 1 and c[-1] in ",." for c in encoder.known)
    got += [np.frombuffer(b, "<u4").tolist() for b in encoder.texts(every[1:])]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(every, add_special_tokens=False)]


def test_packing(spark, sf_dir, texts):
    rows = queries.op3_vector_best_fit(spark, sf_dir).toPandas()
    encoder = ChunkEncoder(queries.tokenizer("word_bpe_49k.json"))
    ids = {d: [*e.ids, 1] for d, e in zip(texts, encoder.tokenizer.encode_batch(list(texts.values()), add_special_tokens=False))}
    for d, pieces in rows.sort_values("piece").groupby("doc_id"):
        assert pieces["piece"].tolist() == list(range(len(pieces))) and pieces["start"].tolist() == [4096 * i for i in range(len(pieces))] and pieces["length"].sum() == len(ids[d])
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[d][p.start : p.start + p.length], "<u4").tobytes())
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        ends = seq["length"].cumsum()
        assert seq["offset"].tolist() == [0, *ends.tolist()[:-1]] and ends.iloc[-1] <= 4096
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 4096) + 1


def test_groups_waste_next_to_nothing(spark):
    """Many small groups come within a sequence or two of the least that the tokens need."""
    rng = np.random.default_rng(15)
    lengths = np.minimum(rng.geometric(0.003, 6000), 4096)
    from loamline.llm.common import stored

    pieces = stored(spark.createDataFrame(list(enumerate(map(int, lengths))), "row long, length long"), "some")
    got = pack.pack(pieces, pack.Capacity(), group=300).toPandas()
    assert len(got) == 6000 and got["row"].is_unique
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        ends = own["length"].cumsum()
        assert own["offset"].tolist() == [0, *ends.tolist()[:-1]] and ends.iloc[-1] <= 4096
    assert got["sequence_id"].nunique() <= 1.002 * -(-lengths.sum() // 4096) + 1


def test_sequences_hold_the_ids(spark, sf_dir, texts):
    path = queries.tokenizer("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents")
    packed = pack.pack_documents(docs, path, cap=pack.Capacity(tokens=1500))
    got: dict = {}
    for s in pack.sequences(packed).collect():
        at = 0
        assert len(s.ids) == sum(s.lengths) <= 1500
        for d, n in zip(s.doc_ids, s.lengths):
            got.setdefault(d, []).append(s.ids[at : at + n])
            at += n
    tokenizer = ChunkEncoder(path).tokenizer
    for d, text in texts.items():
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert sorted(got[d]) == sorted(want[i : i + 1500] for i in range(0, len(want), 1500))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_capacity(rule):
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.geometric(0.01, 3000), 500)
    cap = pack.Capacity(tokens=1000, documents=12, attention=400_000, weights=(1.0, 0.5, 0.5), rule=rule)
    seq, offset = pack.best_fit(lengths, cap)
    for k in range(seq.max() + 1):
        own = lengths[seq == k]
        assert own.sum() <= 1000 and (len(own) == 1 or (len(own) <= 12 and (own**2).sum() <= 400_000))
        at = np.argsort(offset[seq == k])
        assert (offset[seq == k][at] == np.concatenate([[0], own[at].cumsum()[:-1]])).all()
    bound = max(lengths.sum() / 1000, 3000 / 12, (lengths**2).sum() / 400_000)
    # Long pieces come first and fill the tokens, short ones last and use up the document counts.
    assert seq.max() + 1 <= 1.3 * bound
    loose, _ = pack.best_fit(lengths, pack.Capacity(tokens=1000, documents=1000, attention=10**6, rule=rule))
    assert loose.max() + 1 <= -(-lengths.sum() // 1000) + 1


# ---------------------------------------------------------------- 4


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def _roots(fp: dict, d: int) -> dict:
    root = {k: k for k in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= d and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in fp}


def test_near_groups(spark, sf_dir, texts):
    fp = {d: _fingerprint(t) for d, t in texts.items()}
    root = _roots(fp, 3)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op4_simhash_byte_index(spark, sf_dir).collect()} == {(d, f"{fp[d]:016x}", root[d]) for d in fp}


def test_index_finds_every_pair(spark, monkeypatch):
    """Chains and dense groups of fingerprints, with lists so short that they are compared in blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(x,) for x in signed], "id long").select("id", F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("fingerprint"))
    found = {r.id: r.root for r in components.components(simhash.links(prints, simhash.quads_of_eight(), 5, 3)).collect()}
    want = _roots(dict(zip(signed, fps)), 3)
    group = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert group({s: found.get(s, s) for s in signed}) == group(want)


def test_count_filter_rejects_chance_meetings():
    """Fingerprints that share just the four bytes of a quad are rejected by the tally; their bits are never looked at. Without it they all would be."""
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 256, (400, 8), np.uint8)
    raw[:, :4] = 7
    raw[200:, 4] = raw[:200, 4]  # these pairs share a fifth byte
    check = np.ascontiguousarray(raw).view(np.uint64)
    seen = {"tallied": 0, "verified": 0, "near": 0}
    assert simhash.forest(np.arange(400), raw, check, np.zeros(400, int), 5, 3, seen) == []
    pairs = sum((raw[a] == raw[b]).sum() >= 5 for a, b in itertools.combinations(range(400), 2))
    assert seen["tallied"] == 400 * 399 // 2 and 200 <= seen["verified"] == pairs < 3000 and seen["near"] == 0


def test_spanning_links_of_few_and_many_rows():
    """All with all, or from pivots: the same components as of all pairs, over one block and across two."""
    rng = random.Random(16)
    for trial in range(60):
        n, blocks = rng.randint(1, 60), rng.choice((1, 2))
        x, fps = rng.getrandbits(64), []
        for _ in range(n):
            x = rng.getrandbits(64) if rng.random() < 0.3 else x
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
        block = np.array([rng.randrange(blocks) for _ in range(n)])
        two = len(set(block.tolist())) > 1
        near = lambda p, o: np.array([[(fps[a] ^ fps[b]).bit_count() <= 3 for b in o] for a in p]).reshape(len(p), len(o))  # noqa: B023, E731
        want = _components(n, [(a, b) for a, b in itertools.combinations(range(n), 2) if (fps[a] ^ fps[b]).bit_count() <= 3 and (not two or block[a] != block[b])])
        for at_once in (1, 50, 10_000):
            got = simhash.spread(n, block, near, at_once)
            assert len(got) < n and _components(n, got) == want


def _components(n, links):
    root = list(range(n))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


def test_quads_hold_any_five():
    quads = simhash.quads_of_eight()
    assert len(quads) == 14 and all(any(set(q) <= set(c) for q in quads) for c in itertools.combinations(range(8), 5))


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (7, 6)]
    root = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.id: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    loops = {x for x in root if all(x not in e for e in links if e[0] != e[1])}
    assert got == {x: r for x, r in root.items() if x not in loops}


def test_near_copies(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = {i: [rng.choice(words) for _ in range(300)] for i in range(30)}
    rows = [(i, w) for i, w in base.items()]
    for i in range(15):  # three words of three hundred changed: similarity 0.9
        copy = list(base[i])
        for at in (20, 150, 270):
            copy[at] = rng.choice(words)
        rows.append((100 + i, copy))
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert got == set(base)


def _shingles(words, k=5):
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _near_kept(spark, texts):
    return {r.doc_id for r in simhash.near_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}


def _by_brute_force(texts):
    """The least id of each connected group of texts of similarity 0.8 or more."""
    sets, root = {i: _shingles(w) for i, w in texts.items()}, {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_texts_below_the_similarity_stay(spark, monkeypatch):
    """Pairs from 0.70 to 0.79 are no near copies, those from 0.8 on are; groups are compared in blocks."""
    monkeypatch.setattr(simhash, "SET_BLOCK", 2)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    texts = {}
    for i in range(40):
        base = [rng.choice(words) for _ in range(300)]
        texts[i] = base
        for c in range(1, 4):  # words far from each other: each costs five shingles
            copy = list(base)
            for at in range(10, 10 + 20 * rng.randint(4, 10), 20):
                copy[at] = rng.choice(words)
            texts[1000 * c + i] = copy
    sets = {i: _shingles(w) for i, w in texts.items()}
    jaccard = [len(sets[i] & sets[1000 * c + i]) / len(sets[i] | sets[1000 * c + i]) for i in range(40) for c in range(1, 4)]
    assert sum(0.7 <= x < 0.8 for x in jaccard) > 30 and sum(x >= 0.8 for x in jaccard) > 20
    assert _by_brute_force(texts) <= _near_kept(spark, texts)


def test_near_copies_by_block_edits(spark, monkeypatch):
    """Passages appended, cut off or replaced, single words, short texts and a line that most texts have: the same as all pairs, with short lists and blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SET_BLOCK", 4)
    monkeypatch.setattr(simhash, "LEAST_TEXTS", 2)
    rng = random.Random(10)
    words = [f"w{i}" for i in range(5000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    line, texts = some(20), {}
    for i in range(60):
        n = rng.choice((7, 9, 30, 300))
        base = some(n) + line * (i % 3 > 0)
        at, m = rng.randrange(n), rng.randint(1, n // 4)
        texts |= {i: base, 100 + i: base + some(m), 200 + i: base[m:], 300 + i: base[:at] + some(m) + base[at + m :], 400 + i: base[:at] + some(1) + base[at + 1 :]}
    assert _near_kept(spark, texts) == _by_brute_force(texts)


def test_prefixes_meet():
    """Every pair of sets at the similarity, whatever is frequent."""
    rng = np.random.default_rng(11)
    for n in range(1, 120):
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        more = int(n * 0.25 + 1e-9)
        own = int(rng.integers(0, more + 1))
        new = rng.integers(0, 1 << 63, more).astype(np.uint64)
        a, b = np.unique(np.concatenate([both, new[:own]])), np.unique(np.concatenate([both, new[own:]]))
        for frequent in map(np.sort, (both[: n // 2], both, new, both[:0])):
            rank = rng.permutation(len(frequent))
            assert np.isin(simhash.prefix(a, frequent, rank, 0.8), simhash.prefix(b, frequent, rank, 0.8)).any()


# ---------------------------------------------------------------- 5 and 8


@pytest.mark.parametrize(
    ("name", "label", "sf", "least", "found", "rejected"),
    [("op5_factorisation_machine", "quality", "sf0.1", 0.99, 0.95, 0.05), ("op8_compression_toxicity", "toxic", "sf0.1", 0.94, 0.6, 0.01), ("op8_compression_toxicity", "toxic", "sf0.01", 0.88, 0.6, 0.02)],
)
def test_held_out(spark, name, label, sf, least, found, rejected):
    """AUC, the share of the rows labelled 1 that are predicted so, and of the others that are, too."""
    sf = f"/root/testdata/{sf}"
    rows = queries.QUERIES[name](spark, sf).join(table(spark, sf, "labels").select("doc_id", F.col(label).alias("y")), "doc_id").where("held_out").toPandas()
    assert rows["score"].between(0, 1).all() and (rows["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 3) == 1).all()
    rank = rows["score"].rank()
    pos = rows["y"].sum()
    auc = (rank[rows["y"] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(rows) - pos))
    assert auc >= least and (rows[rows["y"] == 1]["predicted"] == 1).mean() >= found and (rows[rows["y"] == 0]["predicted"] == 1).mean() <= rejected


def test_quality_query_is_the_sum_over_pairs(spark, sf_dir, texts):
    """The registered query against a machine that adds up every pair."""
    from loamline.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    m = quality.fit(labelled.sample(docs, labels, "quality", extra=("n_chars",)))
    rows = {r.doc_id: r for r in queries.op5_factorisation_machine(spark, sf_dir).collect()}
    assert set(rows) == set(texts)
    for r in docs.orderBy(F.length("text")).limit(60).collect():
        i, x = next(m.inputs([r.text], [r.n_chars], quality._Buckets()))
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a, b in itertools.combinations(range(len(i)), 2))
        score = 1 / (1 + np.exp(-(m.bias + m.w[i] @ x + pairs)))
        assert abs(rows[r.doc_id].score - score) < 1e-9 and rows[r.doc_id].predicted == (score >= 0.5)


def test_toxicity_query_is_the_models(spark, sf_dir, texts):
    """The registered query against windows compressed one by one."""
    from loamline.llm import toxicity

    m = toxicity.fit(labelled.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic"))
    ordinary, toxic = m.dictionaries.compressors()
    for r in queries.op8_compression_toxicity(spark, sf_dir).collect():
        words = toxicity._words(texts[r.doc_id])
        windows = [toxicity.CARRIER + b" " + b" ".join(words[i : i + 2]) + b" " for i in range(max(1, len(words) - 1))]
        d = np.array(sorted((len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows), reverse=True), float)
        x = np.array([d[0], d[:2].mean(), d[:4].mean(), d[:8].mean(), *(np.log1p((d >= t).sum()) for t in m.thresholds), np.log(len(d))])
        assert abs(r.score - m.logistic(x[None])[0]) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_long_runs_of_bytes_are_cut_without_loss():
    from loamline.llm import toxicity

    assert toxicity._words("Ab, " + "x" * 150 + " c") == [b"ab", b"x" * 64, b"x" * 64, b"x" * 22, b"c"]


def test_linear_score_is_the_sum_over_pairs():
    from loamline.llm import quality

    rng = np.random.default_rng(0)
    m = quality.QualityModel(np.zeros((1, 1)), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    i, x = np.array([2, 5, 11, 17]), rng.normal(size=4)
    want = 0.3 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a, b in itertools.combinations(range(4), 2))
    assert abs(m.raw_score(i, x)[0] - want) < 1e-9


def test_sample_is_bounded_and_leaves_out_held_out_rows(spark, sf_dir):
    rows = labelled.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 20, ("doc_id",))
    assert len(rows) == 20 and all(zlib.crc32(str(r[2]).encode()) % 3 != 1 for r in rows)
    few = labelled.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", most_bytes=20_000)
    assert 0 < len(few) < len(labelled.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic")) and sum(len(r[0].encode()) for r in few) <= 20_000


# ---------------------------------------------------------------- 6


def test_token_counts():
    rng = random.Random(1)
    for _ in range(200):
        vocabulary = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        automaton, known = wordpiece.Automaton.of(vocabulary), set(vocabulary)
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            n = at = 0
            while at < len(word):
                k = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
                if not k:
                    n = -1
                    break
                n, at = n + 1, at + k
            assert automaton.pieces(word) == n


def test_token_count_query(spark, sf_dir, texts):
    """The registered query against the longest piece, again and again."""
    known = set(wordpiece.read_vocabulary(queries.tokenizer("byte_bpe_50k.tiktoken")))
    longest, counts = max(map(len, known)), {}

    def pieces(word):
        n = at = 0
        while at < len(word):
            k = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in known), 0)
            if not k:
                return -1
            n, at = n + 1, at + k
        return n

    for r in queries.op6_linear_wordpiece(spark, sf_dir).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", texts[r.doc_id].encode())
        each = [counts[w] if w in counts else counts.setdefault(w, pieces(b" " + w)) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(1 if n < 0 else n for n in each), each.count(-1))


# ---------------------------------------------------------------- 7


def _hash(*what):
    h = 42
    for x in what:
        h = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), h)
    return ((h >> 11) + 1) * 2.0**-53


def _brute_place(key, forest, drawn=None):
    """Step by step; drawn counts the draws."""
    drawn = [] if drawn is None else drawn

    def u(*what):
        drawn.append(what)
        return _hash(key, *what)

    room = lambda x: sum(map(room, x)) if isinstance(x, list) else x.room
    trees = [[[sorted(tree[r][k], key=lambda leaf: leaf.shard) for k in sorted(tree[r])] for r in sorted(tree)] for tree in forest]
    for g in reversed(range(len(trees))):
        for t in range(shard.ATTEMPTS):
            if u(g, 0, t) > room(trees[g]) / sum(map(room, trees[: g + 1])):
                break
            at, path = trees[g], []
            for level in (1, 2, 3):
                path.append(min((-np.log(u(g, level, t, *path, j)) / room(child), j) for j, child in enumerate(at) if room(child) > 0)[1])
                at = at[path[-1]]
            if u(g, 4, t, at.shard) <= at.weight / at.room:
                return at.shard
    return min((-np.log(u(-1, leaf.shard)) / leaf.weight, leaf.shard) for tree in forest for r in tree.values() for k in r.values() for leaf in k if leaf.weight > 0)[1]


def test_shards(spark, sf_dir, texts):
    rows = queries.op7_weighted_hash_tree(spark, sf_dir).toPandas()
    now, grown = shard.even_forest(40), shard.even_forest(41)
    for r in rows.itertuples():
        assert r.shard == _brute_place(r.doc_id, now) and r.grown_shard == _brute_place(r.doc_id, grown)
        assert r.region == f"region{r.shard % 4}" and r.rack == f"rack{r.shard // 4 % 5}"
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    assert ((rows["shard"] == rows["grown_shard"]) | (rows["grown_shard"] == 40)).all()
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_written_shards(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    shard.write_shards(docs, shard.even_forest(40), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and all(r.loamline_shard == _brute_place(r.doc_id, shard.even_forest(40)) for r in back.select("doc_id", "loamline_shard").collect())


@pytest.mark.parametrize("n", [1, 19, 20, 39, 40, 41, 79, 80])
def test_one_more_shard_takes_rows_only_into_itself(n):
    now, grown = shard.even_forest(n), shard.even_forest(n + 1)
    before, after = ([_brute_place(k, f) for k in range(1500)] for f in (now, grown))
    assert all(a == b or b == n for a, b in zip(before, after)) and abs(sum(b == n for b in after) / 1500 - 1 / (n + 1)) < 0.04
    assert set(before) <= set(range(n)) and max(abs(before.count(s) / 1500 - 1 / n) for s in range(n)) < 0.04


def test_weights_move_only_their_subtree(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    leaf = shard.Leaf

    def forest(w1, w3):
        return [{"a": {"x": [leaf(0, 1.0, 2.0), leaf(1, w1, 4.0)], "y": [leaf(2, 1.0)]}, "b": {"z": [leaf(3, w3, 4.0), leaf(4, 0.0)]}}]

    rows = shard.shard_documents(keys, forest(2.0, 4.0), forest(3.0, 4.0)).toPandas()
    share = rows["shard"].value_counts(normalize=True)
    assert 4 not in share and all(abs(share[s] - w / 8) < 0.015 for s, w in {0: 1, 1: 2, 2: 1, 3: 4}.items())
    moved = rows[rows["shard"] != rows["grown_shard"]]
    assert len(moved) and (moved["grown_shard"] == 1).all()
    # A weight that shrinks only lets keys go, and those that stay in other subtrees stay where they are.
    rows = shard.shard_documents(keys, forest(2.0, 4.0), forest(2.0, 1.0)).toPandas()
    moved = rows[rows["shard"] != rows["grown_shard"]]
    assert len(moved) and (moved["shard"] == 3).all()


def test_a_key_looks_only_into_the_subtrees_it_descends():
    """A visit draws for its regions, its region's racks and its rack's shards: for 20 x 20 x 20 shards some 60 draws and not 8,000."""
    even = [{f"r{a}": {f"k{b}": [shard.Leaf(400 * a + 20 * b + c) for c in range(20)] for b in range(20)} for a in range(20)}]
    for key in range(200):
        drawn: list = []
        _brute_place(key, even, drawn)
        assert len(drawn) == 1 + 60 + 1
    # The levels decide: with the racks of one region told apart otherwise, only its own keys move.
    other = [even[0] | {"r3": {f"k{b}": even[0]["r3"][f"k{19 - b}"] for b in range(20)}}]
    before, after = ([_brute_place(k, f) for k in range(1000)] for f in (even, other))
    assert any(a != b for a, b in zip(before, after)) and all(a == b for a, b in zip(before, after) if a // 400 != 3)


def test_windows_are_compressed_as_one_by_one():
    from loamline.llm import toxicity

    rng = random.Random(21)
    word = lambda: bytes(rng.choice(b"abcdefg\xc3\xa9") for _ in range(rng.randint(1, 9)))
    d = toxicity.Dictionaries(*(b"".join(b" " + word() + b" " for _ in range(3000)).ljust(24_576, b"x")[:24_576] + toxicity.CARRIER for _ in range(2)))
    texts = [[], [b"a"], [b"a", b"a", b"a", b"a"], *([word() for _ in range(700)] for _ in range(40))]
    found = toxicity.Differences(d)
    got = list(found(texts))
    ordinary, toxic = d.compressors()
    for words, have in zip(texts, got, strict=True):
        whole = [toxicity.CARRIER + b" " + w + b" " for w in toxicity.windows(words)]
        assert have.tolist() == sorted((float(len(ordinary.compress(w)) - len(toxic.compress(w))) for w in whole), reverse=True)
    assert not any(isinstance(x, dict) and x for x in vars(found).values())  # a task holds no windows of earlier texts


# ---------------------------------------------------------------- 9


def test_hash_table_grows_and_compares_contents():
    t = exact.ContentTable()
    for i in range(3000):  # all under one hash: equality is of contents
        content = str(i % 1500).encode()
        e = t.find(7, content)
        if e < 0:
            assert i < 1500
            e = t.add(7, content, i)
        assert t.contents[e] == content


def test_grace_recursion():
    records = [(xxhash.xxh64_intdigest(c), c, 1) for c in (f"text {i % 400}".encode() * 20 for i in range(2000))]
    tables = list(exact.grace(iter(records), lambda old, new, _: (old or 0) + new, budget=2000))
    assert len(tables) > 10 and {c: v for t in tables for c, v in zip(t.contents, t.values)} == {c: 5 for _, c, _ in records}


def test_a_hot_text_is_held_once():
    """A million equal rows: the table's entry doesn't grow with them."""
    import tracemalloc

    import pyarrow as pa

    def batches():
        for k in range(0, 1_000_000, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(range(k, k + 10_000), pa.int64()), pa.array(range(k, k + 10_000), pa.int64()), pa.array([b"the same"] * 10_000, pa.binary())], names=["rid", "doc_id", "raw"])

    tracemalloc.start()
    n = sum(b.num_rows for b in exact._local(exact.TABLE_BYTES)(batches()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_000_001 and most < 20 << 20


# ---------------------------------------------------------------- 10

_BASE = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _base(text):
    out = []
    for k, pattern in enumerate(_BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits)) or (k == 3 and 9 <= len(digits) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans(spark, sf_dir, texts):
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.1 2-+(5)@.") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == _base(text)
    for r in queries.op10_bootstrapped_pii(spark, sf_dir).collect():
        base = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.spelled(base).encode()).hexdigest() and set(filter(None, pii.spelled(base).split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]


def test_contexts_teach_identifiers(spark):
    docs = [(i, f"please call me at +1 (555) 555-{1000 + i} today") for i in range(12)] + [(50, "please call me at 555-867-5309 today"), (51, "order number 555-867-5309 again"), (52, "the parts 12345-6789-00 are here"), (53, "mail joe at nothing"), (54, "please call me at (555) 867 5310 today")]
    # Issued formats are seeds, and teach a context in which other strings are secrets; in other contexts they are none.
    docs += [(100 + i, f'the token = "{hashlib.sha1(str(i).encode()).hexdigest()}" is mine') for i in range(8)] + [(120, 'the token = "Zx9_kk21-pqr77" is mine'), (121, f"some {'0' * 20}{'ab1' * 4}{'c' * 8} words"), (122, "model Zx9_kk21-pqr77 too"), (123, "model Ay8_kk21-pqr77 too")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[50].spans == "phone:18:30" and got[50].n_phone == 0 and got[50].base_sha256 == hashlib.sha256(b"").hexdigest() and got[50].n_learnt == got[50].n_spans == 1
    assert got[51].spans == "phone:13:25" and got[52].spans == "" and got[53].spans == "" and got[54].spans == "phone:18:32"
    assert got[0].spans == "phone:18:35" and got[0].n_phone == 1 and got[0].n_learnt == 0
    assert all(got[100 + i].spans == "secret:13:53" for i in range(8)) and got[120].spans == "secret:13:27" and got[122].spans == "secret:6:20" and got[121].spans == got[123].spans == ""
    rows = pii.span_rows(spark.createDataFrame([(1, "email:0:5,phone:7:20"), (2, "")], "doc_id long, spans string")).collect()
    assert [tuple(r) for r in rows] == [(1, "email", 0, 5), (1, "phone", 7, 20)]
    assert pii.span_rows(spark.createDataFrame([], "doc_id long, spans string")).count() == 0


def test_learning_on_a_small_graph(spark):
    """Against the rule spelled out over dictionaries."""
    import math
    from collections import Counter, defaultdict

    rng = random.Random(14)
    spans = []
    for k in range(600):
        ident = f"i{rng.randrange(150)}"
        seed = int(ident[1:]) % 7
        kind, sure = (seed, True) if seed < 4 else (4, False) if seed == 4 else (None, False)
        kinds = 1 << kind if sure else 31 if int(ident[1:]) % 2 else 24
        lean = int(ident[1:]) // 7 % 5 if not sure else seed
        spans.append((ident, kind, sure, kinds, [f"p{lean * 4 + rng.randrange(4) if rng.random() < 0.93 else rng.randrange(20)}" for _ in range(rng.randint(0, 2))]))
    edges = defaultdict(int)
    for ident, _, _, kinds, patterns in spans:
        for p in patterns:
            edges[p, ident] |= kinds
    linked = {i for _, i in edges}
    kind = {i: k for i, k, _, _, _ in spans if k is not None and i in linked}
    settled = {i for i, _, sure, _, _ in spans if sure and i in linked}
    want = {}
    for _ in range(pii.ROUNDS):
        n, whole = Counter((p, kind.get(i)) for p, i in edges), Counter()
        for (p, k), c in n.items():
            whole[p] += c * (pii.DOUBT if k is None else 1)
        good = {(p, k): c / whole[p] for (p, k), c in n.items() if k is not None and c >= pii.SUPPORT and c / whole[p] >= pii.CONFIDENCE}
        miss = defaultdict(float)
        for (p, i), bits in edges.items():
            if i not in settled:
                for (q, k), c in good.items():
                    if q == p and bits >> k & 1:
                        miss[i, k] += math.log(1 - min(c, 0.99))
        best = {}
        for (i, k), m in miss.items():
            if 1 - math.exp(m) >= pii.SCORE:
                best[i] = max(best.get(i, (0, 0)), (round(1 - math.exp(m), 12), -k))
        new = {i: -b[1] for i, b in best.items()}
        want |= new
        kind |= new
        settled |= set(new)
        if not new:
            break
    got = {r.identifier: r.kind for r in pii.learn(spark.createDataFrame(spans, "identifier string, kind int, sure boolean, kinds int, contexts array<string>")).collect()}
    assert got == want and len(want) > 5


def test_secrets_are_learnt_from_the_tables(spark):
    """At sf0.01 tokens stand in one context and are learnt; numbers in random contexts are not."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    learnt = {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in pii.span_rows(queries.op10_bootstrapped_pii(spark, sf)).collect() if r.kind == "secret"}
    assert learnt == {(d, m[1]) for d, t in texts.items() for m in re.finditer('token = "([0-9a-f]{40})"', t or "")} and len(learnt) > 5


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, sf_dir, texts):
    """Against plain versions of its stages, each on what the one before kept."""
    import corpus_pipeline

    docs, kept = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        kept[name] = {r.doc_id for r in docs.collect()}
    firsts = {}
    for d in sorted(kept["toxicity"]):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
    assert kept["exact_dedup"] == set(firsts.values())
    words = {d: texts[d].lower().split() for d in kept["exact_dedup"]}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    near = kept["simhash_near_dedup"]
    assert all(jaccard(a, b) < 0.85 for a, b in itertools.combinations(sorted(near), 2))
    assert all(max(jaccard(d, b) for b in kept["exact_dedup"] if b != d) > 0.6 for d in kept["exact_dedup"] - near)
    passages = [" ".join(decontam_words(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    assert kept["decontamination"] == {d for d in near if not any(p in " ".join(decontam_words(texts[d])) for p in passages)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == kept["decontamination"]


def decontam_words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()
