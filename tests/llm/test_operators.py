"""Operators against plain versions on small tables, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from runloom.llm import html, langid, lines, minhash, mixing, neighbours, packing, plans, quality, suffixes, warc

WHITE = " \t\n\x0b\x0c\r"
DOC = "doc_id long, text string, lang string, source string, twin_ string"
EDGE = [
    (1, None, "en", None, "x"), (2, "", "en", "a", "x"), (None, "Only a line here, long enough.", None, "b", None), (3, "one two", "en", "a", "x"),
    (3, "one two", "en", "a", "x"), (4, "one TWO", "fr", "a", None), (5, "word " * 3000, "en", None, "x"), (6, "\n\n \t\n", None, "c", None), (7, "123 456", "en", "", ""),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, size):
    w = words(lower(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, percent):
    sets, up = {i: shingle_set(t, size) for i, t in rows}, {i: i for i, _ in rows}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(2000, None), (2001, ""), (2002, "a"), (2003, "A"), (2004, "a b")]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(10)):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join([f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 80))] + base[:50])) for i in range(150, 190)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_components(rows, 3, 85)


@pytest.mark.parametrize("size, percent, shapes", [
    (3, 85, [(62, 67, 57), (63, 68, 58), (60, 65, 56), (63, 69, 58)]),
    (5, 80, [(58, 65, 52), (60, 66, 53), (60, 67, 54), (61, 68, 55), (62, 69, 56), (63, 70, 56), (63, 71, 56)]),
])
def test_near_duplicates_of_short_texts_at_the_limit(spark, size, percent, shapes):
    """Pairs of full sets that fit into their sketches while their union does not: (larger set, union, intersection)."""
    rows, linked = [], 0
    for number in range(len(shapes) * 20):
        n, union, both = shapes[number % len(shapes)]
        linked += 100 * both >= percent * union
        common = [f"c{number}_{i}" for i in range(both + size - 1)]
        for side, own in enumerate((n - both, union - n)):
            rows.append((2 * number + side, " ".join(common + [f"o{number}_{side}_{i}" for i in range(own)])))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    want = {i: (n, root, kept) for a in range(0, len(rows), 2) for i, (n, root, kept) in brute_components(rows[a : a + 2], size, percent).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == want
    assert sum(not kept for *_, kept in want.values()) == linked > 0


def test_html_keeps_the_article_only():
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><header>Site</header><nav><a href=/>x</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><aside class=sidebar>Side</aside><div class=ad>Buy</div>"
        "<article><h1>Title &amp; more</h1><p>First, <b>bold\n text</b>,   here.<br>More<p>Second &lt;p&gt; para"
        "<form><input><p>Mail?</p></form><div class='comments'><p>I disagree, strongly, with all of it</p></div></article><footer>&copy;</footer>"
    )
    assert html.main_text(page) == "Title & more\n\nFirst, bold text, here. More\n\nSecond <p> para"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("<p>unclosed <b>text") == "unclosed text"


def test_html_keeps_headings_lists_tables_and_formulas():
    long, shorter = "long, text, of, the, first, part " * 20, "shorter, text, of, the, second, part " * 12
    beside = "<h3>Part</h3><ul><li>item</ul><table><tr><td>cell</table><figure><figcaption>caption</figcaption></figure><ol><li>step</ol>"
    page = f"<body><div><p>{long}</p><p>{long}</p></div>{beside}<ul><li><a href=/>menu</a></ul><div><p>{shorter}</p></div><h4>After</h4></body>"
    got = html.main_text(page).split("\n\n")
    assert got == [long.strip()] * 2 + ["Part", "item", "cell", "caption", "step", shorter.strip()]
    inside = (
        "<article><p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding=tex>x=1</annotation></semantics></math> hold"
        "<object data=a.svg>a figure of x</object>.</p></article>"
    )
    assert html.main_text(inside) == "Let x=1 holda figure of x."


STORY = "<p>" + "long, text, of, it " * 20 + "</p>"
TEASER = "<article><p>Another story, in short</p></article>"


@pytest.mark.parametrize("page, parts", [
    (f'<div class="page share">{STORY * 3}</div>', 3), (f'<div class="social-policy">{STORY * 3}</div>', 3), (f'<div id=sidebar><div class="side ad">{STORY * 3}</div></div>', 3),
    (f'<article><div class="reader-view">{STORY * 3}</div></article>', 3), (f'<article>{STORY * 2}<svg viewBox="0 0 1 1"/>{STORY}</article>', 3),
    (f"<article>{STORY}<select name=x><option>no{STORY}</article>", 2), (f"<article>{STORY}<![CDATA[ x > y ]]>{STORY}</article>", 2),
    (f"<main><article>{STORY * 3}</article>{TEASER}</main>", 3), (f"<body><article>{STORY * 3}</article>{TEASER}</body>", 3),
    (f'<article>{STORY}<div class="related">{STORY * 3}</div></article>', 1), (f'<article>{STORY}<div class="comments">{STORY * 9}</div></article>', 1),
])
def test_html_of_odd_pages(page, parts):
    assert html.main_text(page) == "\n\n".join([("long, text, of, it " * 20).strip()] * parts)


def test_html_of_deep_and_broken_pages_takes_time_in_proportion():
    def seconds(page):
        start = time.perf_counter()
        assert html.main_text(page)
        return time.perf_counter() - start

    for piece in ("<div>y", "<div>y</x></p>", "<p>a, b<select><option>x", "<p>x<svg", "<li>a<ul>"):
        short, long = seconds(piece * 5000), seconds(piece * 50_000)
        assert long < 40 * max(short, 0.02), piece
    assert seconds("<div>y" * 200_000) < 60


def plain_scores(nodes, blocks):
    """Points by walking up from every block, as far as the root."""
    out = {id(n): [0.0, 0, 0] for n in nodes}
    for block in blocks:
        points, share, up, step = html._points(*block), 1.0, block[0], 0
        while up:
            share = (0.0 if up.tag in ("p", "li", "td", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6") else 1.0) if step == 0 else {1: 1.0, 2: 1 / 2, 3: 1 / 6}.get(step, share * 2 / 3)
            out[id(up)][0] += points * share
            out[id(up)][1] += block[2]
            out[id(up)][2] += block[3]
            up, step = up.parent, step + 1
    return out


def test_html_scores_equal_a_plain_tree_scorer(spark, folder):
    pages = [r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").select("html").collect()]
    rng = random.Random(6)
    for _ in range(40):
        pages.append("".join(rng.choice(["<div>", "<p>", "</div>", "<article>", "</article>", "<a href=x>", "</a>", "<li>", "words, and, more ", "<section>"]) for _ in range(80)))
    for page in pages:
        nodes, blocks = html._parse(page)
        html._scored(nodes, blocks)
        want = plain_scores(nodes, blocks)
        for n in nodes:
            assert (n.score, n.chars, n.linked) == (pytest.approx(want[id(n)][0]), want[id(n)][1], want[id(n)][2])


def test_html_frame_keeps_clashing_column(spark):
    pages = spark.createDataFrame([(1, "u", None, "mine"), (1, "u", "<p>x, y</p>", None)], "page_id long, url string, html string, text string")
    got = html.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "text_"] and sorted(r["text_"] for r in got.collect()) == ["", "x, y"]


def test_packing_pieces_and_places(spark, edge, documents):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(plans.tokenizer_path())
    odd = [(100, "It's O'Neil's <|endoftext|>x ΑΣ İstanbul été café́ naïve1 ﬁn 日本 ß a\x85b c don't!"), (101, "Éa,Œuvre... 'll")]
    texts = spark.createDataFrame(odd, "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(documents.select("doc_id", "text")).union(texts)
    rows = packing.pack_documents(docs, plans.tokenizer_path()).collect()
    want = Counter()
    for doc, text in [tuple(r) for r in docs.collect()]:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, first in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[first : first + 2048], "<u4").tobytes()
            want[(doc, piece, first, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_fullest_bin_is_found():
    rng = random.Random(1)
    for _ in range(50):
        counts = Counter(rng.randrange(1, 40) for _ in range(rng.randrange(1, 10)))
        lengths = sorted(counts.items(), reverse=True)
        sums = {lengths[0][0]}
        for length, n in lengths:
            for _ in range(n - (length == lengths[0][0])):
                sums |= {s + length for s in sums}
        got = packing.fullest(lengths, 50)
        assert sum(a * b for a, b in got) == max(s for s in sums if s <= 50) and all(b <= counts[a] for a, b in got)


def test_warc_round_trip(spark):
    body = "é" * 40 + "\r\n\r\n" + "x" * 100 + "\r\n"
    pages = [(1, "http://a/ b", body), (2, None, body), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "WARC/1.1\r\n\r\n"), (None, "u", body), (6, "v", "end\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("twin", F.lit(1))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.warc_round_trip(df, chunk_bytes=16).collect()}
    first = {1: None, 2: 1, 3: None, 4: 3, 5: None, None: 1, 6: None}
    for page, _, text in pages:
        data = (text or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert got[page] == (len(data), digest, "revisit" if first[page] else "response", first[page])


def test_warc_holds_a_chunk_of_a_long_page():
    import tracemalloc

    import pyarrow as pa

    html = "é" * (8 << 20)
    columns = {"page_id": [1], "twin": [1], "url": ["u"], "html": [html], "payload_bytes": [16 << 20], "payload_digest": ["d"], "record_type": ["response"], "refers_to": [None]}
    batch = pa.RecordBatch.from_pydict(columns)
    for run in (warc._digests(1 << 20), warc._records(1 << 20)):
        tracemalloc.start()
        rows = sum(got.num_rows for got in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 << 20 and rows in (1, 16)


def test_mixing_targets_and_quotas(spark, documents, edge):
    rows = mixing.mix_sources(documents).toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all() and len(rows) == documents.count()
    by = rows.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by["target"].sum() - by["size"].sum()) < 1e-6 and ((by["taken"] - by["target"]).abs() <= 2).all()
    again = mixing.mix_sources(documents.repartition(3)).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, rows[key].values)) == sorted(map(tuple, again[key].values))
    assert mixing.mix_sources(edge).count() == len(EDGE)


def test_mixing_of_many_words_keeps_targets_and_small_sources(spark):
    """6e9 words in large and in small documents, beside sources of 3,000 words and of one word."""
    number = F.col("id")
    group = F.when(number < 20000, "big").when(number < 60000, "wide").when(number < 60003, "small").when(number < 60004, "one")
    size = F.when(number < 20000, 250000 + number * 7919 % 100000).when(number < 60000, 1 + number * 31 % 997).when(number < 60003, 1000)
    sizes = spark.range(60006).select(
        number.alias("doc_id"), group.alias("source"), number.alias("twin"), F.coalesce(size, F.lit(1)).cast("long").alias("size")
    )
    by = mixing.mix_sources(sizes, sizes=sizes).groupBy("source").agg(
        F.sum("size").alias("size"), F.first("target").alias("target"), F.first("quota_words").alias("quota"), F.sum("taken").alias("taken"),
        F.max(F.col("taken") - 3 * F.col("size")).alias("over"), F.count("*").alias("docs"),
    ).collect()
    assert sum(r["docs"] for r in by) == 60006 and sum(r["size"] for r in by) > 5.9e9
    for r in by:
        assert r["taken"] == r["quota"] and abs(r["taken"] - r["target"]) <= 1 and r["over"] <= 0, r
    assert {r["source"]: r["taken"] for r in by if r["size"] <= 3000} == {"small": 9000, "one": 3, None: 6}


def test_mixing_caps_are_shared_again(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 90)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sources).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 90, None: 500}, {"a": 5, "b": 2, "c": 1, None: 5}
    target, open_ = {}, set(size)
    left = float(sum(size.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else left * weight[s] / total
        if not over:
            break
        open_ -= over
        left = sum(size.values()) - sum(target.values())
    assert got == pytest.approx(target)


def test_sainte_lague_takes_the_highest_quotients(spark):
    rng = random.Random(2)
    for seats in (1, 7, 60):
        votes = {i: float(rng.randrange(1, 500)) for i in range(9)}
        quotients = sorted(((-v / (2 * k + 1), i, k) for i, v in votes.items() for k in range(seats)))[:seats]
        want = Counter(i for _, i, _ in quotients)
        df = spark.createDataFrame([(0, i, v, seats) for i, v in votes.items()], "g int, p int, v double, s long")
        assert {r["p"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], "p", "v", "s").collect()} == {i: want[i] for i in votes}


def test_language_id(spark, documents, edge):
    fold = langid.held_out_fold(F.col("doc_id"))
    model = langid.learn(documents.where(~fold))
    rows = langid.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where(fold).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(edge, model).collect()]
    assert {d for d, p in got if p == "und"} == {1, 2, 6, 7} and len(got) == len(EDGE)
    nothing = langid.learn(documents.where("false"))
    assert {r["lang_pred"] for r in langid.identify(edge, nothing).collect()} == {"und"}
    assert langid.keep_identified(edge, model).columns == edge.columns


def test_quality_base_in_sql_and_edges(spark, folder, edge):
    con = connect(folder)
    for name, sql in plans.BASE_SQL.items():
        columns = [c[0] for c in con.execute(sql).description]
        assert compare(spark, folder, lambda s, f, n=name, c=columns: plans.QUERIES[n](s, f).select(*c), sql, con) is None
    rows = quality.quality_verdicts(edge).collect()
    assert len(rows) == len(EDGE) and all(r["base_failed"] and not r["kept"] for r in rows)


def test_quality_lines():
    assert quality.line_fails("Home | News | About | Login", 7) and quality.line_fails("Of%%% the*** word### and$$$", 4)
    assert quality.line_fails("© 2020 Someone. All rights reserved.", 6) and quality.line_fails("Next page", 2)
    assert not quality.line_fails("Wh.", 1) and not quality.line_fails("A plain line of prose that goes on without an end", 11)


@pytest.mark.parametrize("r, block, bucket", [(1, 1 << 22, 1 << 20), (2, 3000, 500)])
def test_suffix_removal_equals_brute_force(spark, edge, r, block, bucket):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdé ") for _ in range(3000))
    texts = [text[:1500], text[700:2600], text[100:499], text[100:520] + "é" + text[100:520], "z" * 900, None, "", text[2000:]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r_[0], r_[1]) for r_ in EDGE]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), 400, r, block, bucket)
    seen = Counter((t or "").encode()[k : k + 400] for _, t in rows for k in range(len((t or "").encode()) - 399))
    want = Counter()
    for doc, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 399):
            if seen[data[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[(doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r_)[:5] for r_ in got.collect()) == want


def test_lines_edges_and_hot_key_over_many_tasks(spark, edge):
    hot = "A line that very many documents share."
    rows = [(i, f"{hot}\nown text of document {i}\n  {hot.upper()}\t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["text"], r["n"], r["d"]) for r in lines.dedup_lines(docs, counts=("n", "d")).collect()}
    assert all(got[i] == (f"own text of document {i}", 3, 2) for i in range(299)) and got[299] == (rows[299][1], 3, 0)
    kept = lines.dedup_lines(edge)
    assert kept.columns == edge.columns and sorted(map(str, kept.collect())) == sorted(map(str, edge.collect()))


def test_neighbours_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1400] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), parts=16).toPandas()
    assert set(got["query_id"]) == set(range(0, 3000, 100))
    hits, wide = 0, x.astype(np.float64)
    for query, found in got.groupby("query_id"):
        d = np.sqrt(((wide - wide[query]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(3000), d)) if i != query][:10]
        hits += len(set(want) & set(found["vec_id"]))
        assert found["score"].to_numpy() == pytest.approx(d[found["vec_id"]])
    assert hits / (10 * 30) >= 0.9
    assert got[got["query_id"] == 0].sort_values("rank")["vec_id"].tolist() == list(range(1000, 1010))


def plain_nearest(ids, x, query, k=10):
    wide = x.astype(np.float64)
    d = np.sqrt(((wide - wide[np.flatnonzero(ids == query)[0]]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != query][:k]
    return ids[order].tolist(), d[order]


def test_neighbours_in_parts_of_parts(spark):
    """Three levels of parts; what is shuffled grows with the rows and not with their square."""
    copies = {}
    for n in (1500, 4500):
        rng = np.random.default_rng(2)
        x = (rng.normal(size=(40, 8))[rng.integers(0, 40, n)] * 3 + rng.normal(size=(n, 8))).astype(np.float32)
        ids = np.arange(n)
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = neighbours.nearest(vectors, parts=4, leaf=400).toPandas()
        hits = 0
        for query, found in got.groupby("query_id"):
            want, _ = plain_nearest(ids, x, query)
            assert sorted(found["rank"]) == list(range(1, 11)) and len(set(found["vec_id"])) == 10
            wide = x.astype(np.float64)
            assert found["score"].to_numpy() == pytest.approx(np.sqrt(((wide[found["vec_id"]] - wide[query]) ** 2).sum(axis=1)))
            hits += len(set(want) & set(found["vec_id"]))
        assert hits / (10 * n / 100) >= 0.9
        routed = neighbours.usable_vectors(vectors).where("vec_id % 100 = 0").withColumn("part", F.lit(0).cast("long"))
        index, asked = neighbours._split(neighbours.usable_vectors(vectors).withColumn("part", F.lit(0).cast("long")), routed, 10, 4, 6000, 0.97, 400)
        sizes = index.groupBy("part").count().toPandas()
        assert sizes["count"].max() <= 400 and sizes["count"].sum() == n
        questions, candidates = neighbours._cells(index, asked)
        copies[n] = (questions.count() / (n / 100), candidates.count() / n)
    assert copies[4500][0] <= 2 * copies[1500][0] and copies[4500][1] <= 1.5 * copies[1500][1]


def test_neighbours_of_many_copies(spark):
    """A part that cannot be cut, since half of all rows are one vector and one id is there thousands of times."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 4)).astype(np.float32)
    x[:500] = x[0]
    ids = np.concatenate([np.arange(1000), np.full(1500, 100)])
    x = np.concatenate([x, np.repeat(x[:1], 1500, axis=0)])
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(vectors, parts=2, leaf=200).toPandas()
    for query in (0, 100, 200, 300, 400):
        found = got[got["query_id"] == query].sort_values("rank")
        assert found["vec_id"].tolist() == plain_nearest(ids, x, query)[0] and (found["score"] == 0).all()
    assert set(got["query_id"]) == set(range(0, 1000, 100)) and (got.groupby("query_id").size() == 10).all()


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        minhash.near_duplicates(empty, 3, 85), html.extract_text(pages), packing.pack_documents(empty, plans.tokenizer_path()), warc.warc_round_trip(pages),
        mixing.mix_sources(empty), mixing.mixed_documents(empty), quality.quality_verdicts(empty), suffixes.remove_repeats(empty), lines.dedup_lines(empty),
        neighbours.nearest(vectors), langid.identify(empty, langid.learn(empty)),
    ):
        assert df.count() == 0


def test_packing_letters_that_end_in_a_mark():
    import numpy as np
    from tokenizers import Tokenizer

    from runloom.llm.packing import _Encoder
    from runloom.llm.plans import tokenizer_path

    texts = ["İ. a", "theİ?! b", "xİy.", "İ", "ﬁ, ß; ſ."]
    plain = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    assert list(_Encoder.of(tokenizer_path()).encode(texts)) == [np.array(e.ids, "<u4").tobytes() for e in plain]


def test_learned_keys_are_all_words_and_grams(spark):
    rows = [(1, "Abc ab é abc", "x"), (2, "b abc", "y"), (3, None, "x"), (4, "zz", None)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counted = {n: Counter() for n in range(5)}
    for _, text, lang in rows[:2]:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            counted[0][word, lang] += 1
            for n in range(1, 5):
                for at in range(len(word) + 3 - n):
                    if (key := f" {word} "[at : at + n]).strip():
                        counted[n][key, lang] += 1
    assert model.languages == ["x", "y"] and set(model.tables) == set(range(5))
    for n, (keys, logs) in model.tables.items():
        names = sorted({key for key, _ in counted[n]})
        assert sorted(keys.to_pylist()) == names
        for key, row in zip(keys.to_pylist(), logs):
            for i, lang in enumerate("xy"):
                total = sum(c for (_, own), c in counted[n].items() if own == lang)
                assert row[i] == pytest.approx(np.log((counted[n][key, lang] + 0.5) / (total + 0.5 * len(names))), rel=1e-5)


def test_only_letters_are_words():
    model = langid.Model(["x", "y"], {0: (pa.array(["a"]), np.array([[0.0, -9.0]]))})
    assert [p[0] for p in model.predict(["½ 12 _ Ⅷ", "a²", None, ""])] == ["und", "x", "und", "und"]


def test_pipeline_stages_equal_plain_versions(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    rows = list(EDGE) + [(20 + i, f"{base} tail{i % 3} end{i}", "en", "abc"[i % 3], "x") for i in range(9)] + [(40, base, "en", "a", "y"), (40, base, "en", "a", "y")]
    docs = spark.createDataFrame(rows, DOC).withColumn("near_doc_", F.lit("mine")).withColumn("mix_copy_", F.lit(1))

    # near dedup: one row for each doc_id and text that is the smallest of its group
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    texts = dict(enumerate(dict.fromkeys((r[0], r[1]) for r in rows if r[1] is not None)))
    groups, want = defaultdict(list), Counter({(1, None): 1})
    for i, (_, root, _) in brute_components([(i, t) for i, (_, t) in texts.items()], 5, 80).items():
        groups[root].append(texts[i])
    for members in groups.values():
        least = min((d for d, _ in members if d is not None), default=None)
        want.update(m for m in members if m[0] == least)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want

    # mixing: every row as often as its words are taken, rounded half up
    unique = docs.dropDuplicates(["doc_id", "source", "text"])
    mixed = corpus_pipeline.mixing_stage(spark, unique, "")
    taken = {(r["doc_id"], r["source"], r["twin"]): int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in mixing.mix_sources(unique).collect()}
    assert mixed.columns == docs.columns
    found = Counter((r["doc_id"], r["source"], r["t"]) for r in mixed.withColumn("t", F.xxhash64("text")).collect())
    assert found == Counter({k: n for k, n in taken.items() if n})


def test_repeated_passages_of_whole_tables_equal_brute_force(spark):
    """Every 400-byte window of every text of sf0.01."""
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    seen = Counter(hash(raw[i : i + 400]) for _, raw in rows for i in range(len(raw) - 399))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in plans.QUERIES["op8_suffix_array_dedup"](spark, "/root/testdata/sf0.01").collect()}
    for doc, raw in rows:
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - 399):
            if seen[hash(raw[i : i + 400])] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        away = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~away])
        spans = int(away[:1].sum() + (away[1:] & ~away[:-1]).sum())
        assert got[doc] == (len(raw), int(away.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert sum(v[1] for v in got.values()) > 100_000


def test_answers_of_buckets_are_put_together_in_the_order_of_the_keys():
    import numpy as np

    from runloom.llm import suffixes

    rng = np.random.default_rng(5)
    for n, buckets in ((0, 3), (1, 1), (400, 7), (50, 90)):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        keys[n // 2 :] = keys[: n - n // 2]
        tied = set(keys[::3].tolist())
        rows = suffixes._bucketed(0, keys, buckets)
        parts = [(b.as_py(), np.frombuffer(k.as_py(), np.uint64)) for b, k in zip(rows.column("bucket"), rows.column("keys"))]
        marks = [(b, np.packbits([int(k) in tied for k in part]).tobytes()) for b, part in reversed(parts)]
        assert suffixes._merged(keys, buckets, marks).tolist() == [int(k) in tied for k in keys]
