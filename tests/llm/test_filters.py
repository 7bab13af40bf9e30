"""Quality, decontamination, URL filters, main text."""

from __future__ import annotations

import fnmatch
import pickle
import random
import re
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pytest

from lodestone.llm import decontaminate, mainblocks, quality, urlfilter

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
SF = "/root/testdata/sf0.01"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in texts], DOCS)


def test_quality_learns_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert right / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_quality_never_sees_held_out_labels(spark):
    texts = [(i, f"good text number {i}" if i % 2 else f"bad junk {i} %%%") for i in range(80)]
    docs = documents(spark, texts)
    true = [(i, i % 2) for i in range(80)]
    flipped = [(i, 1 - q if crc32(str(i).encode()) % 4 == 2 else q) for i, q in true]
    both = [quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).orderBy("doc_id").collect() for x in (true, flipped)]
    assert both[0] == both[1]
    assert {r.doc_id: r.predicted for r in both[0]} == dict(true)


def test_quality_defined_cases(spark):
    docs = documents(spark, [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 50_000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(3, 1), (3, 0), (2, 1), (None, 1), (2, None), (1, 7)], "doc_id long, quality int")
    rows = quality.classify(docs, ones).collect()
    assert len(rows) == 5 and all(r.score > 0.99 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality.classify(docs.limit(0), ones).count() == 0
    kept = quality.keep_good(docs, ones)
    assert kept.columns == docs.columns and kept.count() == 5


def plain_features(text):
    """The n-grams' numbers with Python's own integers."""
    words = text.split()
    shapes = [bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in w) for w in words]
    own, shape = [crc32(w) for w in words], [crc32(w) for w in shapes]
    grams = own + [s ^ 1 << 40 for s in shape]
    grams += [3 * a + b * 0x100000001 for a, b in zip(own, own[1:], strict=False)]
    grams += [(5 * a + b * 0x200000003) % 2**64 ^ 1 << 50 for a, b in zip(shape, shape[1:], strict=False)]
    return {(g * 0x9E3779B97F4A7C15 % 2**64) >> 64 - quality.BITS for g in grams}


def test_quality_like_plain_version(spark):
    """Ratios, objective, cross-fitted sigmoid and scores, from their definitions."""
    rng = random.Random(8)
    word = lambda good: rng.choice(["fine", "clear", "Text", "idea", "é1"] if good else ["BUY", "now!!", "$$$", "click", "44"]) if rng.random() < 0.6 else rng.choice(["the", "a", "of", "it"])
    texts = [(i, " ".join(word(i % 3 > 0) for _ in range(rng.randint(3, 30)))) for i in range(90)] + [(200, ""), (201, "never seen words")]
    learned = [(i, t, int(i % 3 > 0)) for i, t in texts[:90] if crc32(str(i).encode()) % 4 != 2]
    learned.sort(key=lambda r: (crc32(str(r[0]).encode()), r[0]))

    def parts(rows):
        counts = [{}, {}]
        for _, t, y in rows:
            for f in plain_features(t.encode()):
                counts[y][f] = counts[y].get(f, 0) + 1
        size = 1 << quality.BITS
        totals = [sum(c.values()) + size for c in counts]
        seen = sorted(set(counts[0]) | set(counts[1]))
        base = np.log(totals[0] / totals[1])
        ratio = {f: float(np.log((counts[1].get(f, 0) + 1) / (counts[0].get(f, 0) + 1)) + base) for f in seen}
        found = [np.array(sorted(plain_features(t.encode())), np.int32) for _, t, _ in rows]
        labels = np.array([y for _, _, y in rows])
        assert all(np.array_equal(f, quality.features(t.encode())) for f, (_, t, _) in zip(found, rows, strict=True))
        got = quality.log_count_ratios(found, labels)
        assert np.allclose([got[f] for f in seen], [ratio[f] for f in seen])
        w, bias, alpha = quality.descend(found, labels, got)
        values = [{int(f): ratio[int(f)] / len(fs) ** 0.5 for f in fs} for fs in found]
        signs = [1 if y else -1 for y in labels]
        cost = [len(rows) / (2 * sum(1 for z in labels if z == y)) for y in labels]
        plain_w = {f: sum(a * y * v.get(f, 0.0) for a, y, v in zip(alpha, signs, values, strict=True)) for f in seen}
        assert np.allclose([w[f] for f in seen], [plain_w[f] for f in seen], atol=1e-6)
        assert abs(bias - sum(a * y for a, y in zip(alpha, signs, strict=True))) < 1e-6
        assert all(-1e-9 <= a <= c + 1e-9 for a, c in zip(alpha, cost, strict=True))
        half = (sum(x * x for x in plain_w.values()) + bias * bias) / 2
        margins = [sum(plain_w[f] * x for f, x in v.items()) + bias for v in values]
        primal = half + sum(c * max(0, 1 - y * m) for c, y, m in zip(cost, signs, margins, strict=True))
        dual = sum(alpha) - half
        assert dual <= primal + 1e-9 and primal - dual < 0.05 * primal  # the rounds are bounded; with more the gap closes
        long_w, long_bias, long_alpha = quality.descend(found, labels, got, rounds=2000, tolerance=1e-6)
        long_half = (long_w @ long_w + long_bias**2) / 2
        long_margins = [sum(long_w[f] * x for f, x in v.items()) + long_bias for v in values]
        long_primal = long_half + sum(c * max(0, 1 - y * m) for c, y, m in zip(cost, signs, long_margins, strict=True))
        assert -1e-9 <= long_primal - (sum(long_alpha) - long_half) < 0.005 * long_primal
        mean = sum(abs(x) for x in plain_w.values()) / size

        def margin(text):
            fs = plain_features(text.encode())
            unseen = base  # the ratio of an n-gram that no row has
            return (sum((0.9 * plain_w.get(f, 0.0) + 0.1 * mean) * ratio.get(f, unseen) for f in fs) / len(fs) ** 0.5 if fs else 0.0) + bias

        return margin

    place, fold = [0, 0], []
    for _, _, y in learned:
        fold.append(place[y] * quality.FOLDS // sum(1 for r in learned if r[2] == y))
        place[y] += 1
    margins = np.zeros(len(learned))
    for k in range(quality.FOLDS):
        other = parts([r for r, f in zip(learned, fold, strict=True) if f != k])
        for i, f in enumerate(fold):
            if f == k:
                margins[i] = other(learned[i][1])
    slope, shift = quality.sigmoid_fit(margins, np.array([y for _, _, y in learned]))
    margin = parts(learned)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.classify(documents(spark, texts), labels).collect()}
    for i, text in texts:
        want = 1 / (1 + np.exp(-(slope * margin(text) + shift)))
        assert abs(rows[i].score - want) < 1e-4, (i, text)
        assert rows[i].held_out == (crc32(str(i).encode()) % 4 == 2)


def test_quality_sample_is_bounded(spark, monkeypatch):
    docs = documents(spark, [(i, f"row {i} " + "word " * (i % 5)) for i in range(60)] + [(1, "another text of one id")] * 50)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: seen.append((len(rows), sum(map(len, rows)), np.bincount(labels).tolist())) or quality.Model(np.zeros(1 << quality.BITS), 0.0, 0.0, float(np.log(0.7 / 0.3))))
    rows = quality.classify(docs, labels).collect()
    assert seen[0][0] == sum(crc32(str(i).encode()) % 4 != 2 for i in range(60))
    assert {(round(r.score, 9), r.predicted) for r in rows} == {(0.7, 1)} or all(r.predicted == (r.score >= 0.7) for r in rows)
    monkeypatch.setattr(quality, "SAMPLE_FEATURES", 60)
    quality.classify(docs, labels)
    assert seen[1][1] <= 120 and min(seen[1][2]) >= 1
    quality.classify(docs, labels, sample_rows=4)
    assert seen[2][2] == [4, 4]


def test_descent_separates():
    rows = [np.array([0, 1 + i % 3], np.int32) for i in range(30)] + [np.array([0, 10 + i % 3], np.int32) for i in range(30)]
    labels = np.array([1] * 30 + [0] * 30)
    model = quality.fit(rows, labels)
    assert all((model.score(r) > 0.5) == bool(y) for r, y in zip(rows, labels, strict=True))


def check_contamination(spark, texts, items, **kinds):
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    usable = [(i, t) for i, t in items if i is not None]
    for i, text in texts:
        n, hit, found = brute.contamination(text, usable)
        listed = brute.sha(",".join(sorted(map(str, found))))
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, sum(hit), len(found), listed, any(hit)), (i, text)


@pytest.mark.parametrize("seed", range(3))
def test_contamination_like_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c", "dé", "E1"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 14, 30])))) for k in range(2 if seed == 0 else 12)]
    if seed:
        items = [(k, t) for k, t in items if len(t.split()) > 2]
    items += [(50, None), (51, "  ,,"), (None, "a a a a a a a a a a"), (0, items[0][1])]
    texts = [(i, " - ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, "x".join([items[0][1]] * 1)), (103, f"q {items[0][1]}, {items[0][1].upper()} z")]
    check_contamination(spark, texts, items)


def test_contamination_no_items(spark):
    check_contamination(spark, [(1, "a b"), (2, None)], [(1, None)])


def test_shards_agree(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(14))) for k in range(40)]
    docs = documents(spark, [(k, f"see {items[k][1]} end {items[(k * 7) % 40][1]}") for k in range(40)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    pick = lambda df: sorted((r.doc_id, r[decontaminate.N_WORDS], r[decontaminate.SPANS], r[decontaminate.ITEMS]) for r in df.collect())
    assert decontaminate.shards_of(bench, shard_words=60).count() > 3
    assert pick(decontaminate.mark(docs, bench, shard_words=60)) == pick(decontaminate.mark(docs, bench))


def test_passes_agree(spark, monkeypatch):
    rng = random.Random(11)
    items = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 40)))) for k in range(40)]
    texts = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) + " " + items[i][1]) for i in range(12)] + [(20, None), (21, "")]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    pick = lambda df: sorted(map(str, df.collect()))
    marked, kept = pick(decontaminate.mark(docs, bench)), pick(decontaminate.decontaminate(docs, bench, max_coverage=0.9))
    monkeypatch.setattr(decontaminate, "RESIDENT_WORDS", 200)
    shards = [(r.shard, r.n) for r in decontaminate.shards_of(bench, shard_words=60).collect()]
    assert len(decontaminate.passes_of(shards)) > 2 and sum(map(len, decontaminate.passes_of(shards))) == len(shards)
    assert pick(decontaminate.mark(docs, bench, shard_words=60)) == marked
    monkeypatch.setattr(decontaminate.mark, "__defaults__", (decontaminate.WINDOW, 60, None))
    assert pick(decontaminate.decontaminate(docs, bench, max_coverage=0.9)) == kept
    check_contamination(spark, texts, items)


def test_passes_hold_a_shard_each_at_least(monkeypatch):
    monkeypatch.setattr(decontaminate, "RESIDENT_WORDS", 10)
    assert decontaminate.passes_of([]) == [[]]
    assert decontaminate.passes_of([(0, 25), (1, 4), (2, 6), (3, 1)]) == [[0], [1, 2], [3]]


def test_long_items_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(n))) for k, n in enumerate((1, 9, 10, 16, 17, 60))]
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(5)) + " " + items[5][1][10 * i : 10 * i + 50]) for i in range(8)]
    check_contamination(spark, texts, items)
    assert decontaminate.pieces_of(spark.createDataFrame(items, "item_id long, text string"), 10).count() > 10


def test_many_equal_short_items_and_eviction(monkeypatch):
    items = [(k, [b"x", b"y"]) for k in range(2000)] + [(5000 + k, [b"x"] * 9 + [b"z%d" % k]) for k in range(200)]
    made = decontaminate.SuffixAutomaton.build(items).unpacked()
    assert len(made.short_items) == 2000
    spans, hit = made.scan([b"q", b"x", b"y", b"x", b"y"] * 3)
    assert spans == [1, 5, 6, 10, 11, 15] and hit == set(range(2000))

    class Held:
        def __init__(self, value):
            self.value = value

    sent = [(Held(pickle.dumps(decontaminate.SuffixAutomaton.build([(k, [b"a", b"b", b"c%d" % k])]))), k) for k in range(4)]
    monkeypatch.setattr(decontaminate, "RESIDENT_WORDS", 6)
    decontaminate.LOADED.clear()
    for _ in range(2):
        assert [a.scan([b"a", b"b", b"c2"])[1] for a in decontaminate.automata(sent)] == [set(), set(), {2}, set()]
        assert sorted(decontaminate.LOADED) == [0, 1]
    decontaminate.LOADED.clear()


def test_decontaminate_cuts_passages(spark):
    item = " ".join(f"k{j}" for j in range(12))
    clean = "Clean text, with some  spaces\nand lines. " * 3
    docs = documents(spark, [(1, clean), (2, f"{clean}{item.upper()}, tail"), (3, item), (4, None), (5, "")])
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert sorted(out) == [1, 2, 4, 5]
    assert out[1].text == clean and out[2].text == clean + "tail" and out[2].n_chars == len(clean) + 4
    assert out[4].text is None and out[5].text == ""


URLS = [
    "http://example.org/en/1", "https://a.b.example.org/en/12?x=/es/", "http://example.org/es/", "http://notexample.org/es/x", "http://org/", "http://org",
    "HTTP://WWW.X.COM/fr/a#b", "http://x.com/de/", "http://com/de/", "http://x.com/DE/", "nourl", "", None, "http://", "http:///es/", "ftp://a.org?x/",
    "http://example.org\\en/1/", "http://x.com.org/fr/", "http://é.org/", "http://x.org/" + "y" * 5000, "http://evil.com/x.org/", "a://b://c.org/d",
]


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    for mark in "#?":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    host, path = host.translate(brute.ASCII_LOWER), slash + path
    best = None
    for verdict, rule in urlfilter.RULES:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            best = max([best, (len(rule), rule, verdict)], key=lambda x: x[0] if x else -1)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls_like_brute_force(spark):
    df = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df).collect()}
    assert rows == {i: brute_verdict(u) for i, u in enumerate(URLS)}
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def test_urls_repeated_rows_and_null_ids(spark):
    rows = [(1, "http://x.com/fr/"), (1, "http://x.com/fr/"), (None, "http://x.com/de/"), (None, None)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in got if r.rule) == [("1", "com/fr/", "allow"), ("1", "com/fr/", "allow"), ("None", "com/de/", "block")]
    assert len(got) == 4


def test_globs_over_many_words():
    rng = random.Random(4)
    rules = [f"{'*.' * rng.randint(0, 1)}{rng.choice('abc')}{'*' * rng.randint(0, 1)}{rng.choice('abc')}.org/{rng.choice('xy')}*{rng.choice('xyz')}" for _ in range(40)]
    auto = urlfilter.compile_rules(rules)
    assert auto.accepts.shape[1] > 3
    urls = [(f"{''.join(rng.choice('abc.') for _ in range(rng.randint(0, 4)))}{rng.choice('abc')}{rng.choice('abc')}.org", "/" + "".join(rng.choice("xyz/") for _ in range(rng.randint(0, 5)))) for _ in range(300)]
    found = urlfilter.match(auto, [b".%s\xff%s" % (h.encode(), p.encode()) for h, p in urls])
    for k, rule in enumerate(rules):
        host, _, path = rule.partition("/")
        want = [fnmatch.fnmatchcase(f".{h}", f"*.{host}") and fnmatch.fnmatchcase(p, f"/{path}*") for h, p in urls]
        assert found[:, k].tolist() == want, rule


ARTICLE = """<!doctype html><html><head><title>T &amp; x</title><style>p>a{}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
<body class="page content"><header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to do many fine things for you every day.</p></div>
<main><article><h1>Big   title &eacute;</h1><p>First paragraph with <b>bold</b> and <a href=x>link</a> text,
over lines.<p>Short.<br>After break &lt;tag&gt; &#8212; dash
<div class="ad-box"><p>Buy this wonderful thing now, it is very cheap today only.</p></div>
<blockquote>A quote of some words.</blockquote><!-- hidden <p>comment</p> -->
<form><input name=q><p>Search here</p></form>
<aside class="sidebar"><p>Related stories of the day and many more words here.</p></aside></article>
<section id="comments"><h2>Comments</h2><article><p>A reader says a lot of things here, long enough to look like text.</p></article></section></main>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_main_text_of_a_full_page():
    want = "Big title é First paragraph with bold and link text, over lines. Short. After break <tag> — dash A quote of some words."
    assert mainblocks.main_text(ARTICLE) == want


def test_main_text_without_article_markup():
    page = "<body><div><a href=1>Home</a> <a href=2>News</a></div><p>" + "A long paragraph of plain words. " * 8 + "</p><p>" + "Another one follows it. " * 8 + "</p><div><a href=3>Imprint</a></div>"
    assert mainblocks.main_text(page) == ("A long paragraph of plain words. " * 8 + "Another one follows it. " * 8).strip()


@pytest.mark.parametrize(("page", "want"), [("", ""), ("<p>", ""), ("<article>a < b", "a < b"), ("<article>x<script>y", "x"), ("<article>x<!-- y", "x"), ("<article><p title='a>b'>z", "z")])
def test_main_text_edges(page, want):
    assert mainblocks.main_text(page) == want


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article>a&nbsp;b", "t"), (2, None, None, "t"), (None, "v", "<article>" + "<p>ok" * 20_000, "t")], "page_id long, url string, html string, text string")
    rows = {r.page_id: (r.url, r.text, r.n_chars) for r in mainblocks.extract(df).collect()}
    assert rows == {1: ("u", "a b", 3), 2: (None, "", 0), None: ("v", " ".join(["ok"] * 20_000), 59_999)}
    assert mainblocks.extract(df.limit(0)).count() == 0


class ArticleText(HTMLParser):
    """The words within the article element, by the standard library's parser: right for the pages of the test tables alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "br") and self.depth:
            self.words.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1"):
            self.words.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.words.append(data)


def article_text(html):
    parser = ArticleText()
    parser.feed(html or "")
    parser.close()
    return " ".join("".join(parser.words).split())


def without_names(html):
    """A page whose containers are all plain ``div`` elements without class, id or role."""
    return re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", re.sub(r' (?:class|id|role)="[^"]*"', "", html))


def test_main_text_of_all_pages_like_a_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in mainblocks.extract(pages).collect()} == want
    bare = spark.createDataFrame([(r.page_id, r.url, without_names(r.html)) for r in pages.collect()], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in mainblocks.extract(bare).collect()} == want


def test_main_text_among_notices_sidebars_and_comments():
    prose = ["One " + "running text of the article goes on here. " * n for n in (6, 4, 7)]
    body = "".join(f"<p>{p}</p>" for p in prose)
    comments = "".join(f"<div class='comment'><p>Reader {k} has a word to say about all of this.</p></div>" for k in range(4))
    page = f"<body><div><a href=/>Start</a> <a href=/n>News</a></div><div class='notice'>Our terms have changed today.</div><div><div><h1>Head line</h1>{body}</div><div id='side'><h3>More</h3><ul><li><a href=1>One other story</a><li><a href=2>Yet another story</a></ul></div></div><div id='comments'>{comments}</div><div>All rights with the paper</div></body>"
    want = " ".join(["Head line", *(p.strip() for p in prose)])
    assert mainblocks.main_text(page) == want
    deep = "<div>" * 20_000 + "<p>x" + "</section></div>" * 20_000
    assert mainblocks.main_text(deep) == "x"


LEAD = "<h1>Title here</h1><p>" + "One two three four five six seven. " * 5 + "</p><p>" + "Another short paragraph of text. " * 4 + "</p>"
LEAD_TEXT = ("Title here " + "One two three four five six seven. " * 5 + "Another short paragraph of text. " * 4).strip()
TALK = "".join(f"<p>{f'reader {k} says a thing or two here ' * 6}</p>" for k in range(8))
LAYOUTS = {
    "section after": f"<article>{LEAD}</article><section id='comments'>{TALK}</section>",
    "section without a name": f"<article>{LEAD}</article><section>{TALK}</section>",
    "within main": f"<main><article>{LEAD}</article><section>{TALK}</section></main>",
    "within the article": f"<article>{LEAD}<section class='user-comments'>{TALK}</section></article>",
    "comments as articles": f"<article>{LEAD}</article><section id='comments'>{TALK.replace('<p>', '<article><p>').replace('</p>', '</p></article>')}</section>",
    "divs": f"<div id='content'><div class='post'>{LEAD}</div><div class='comments-area'>{TALK}</div></div>",
    "a list": f"<div class='entry'>{LEAD}</div><ol class='commentlist'>{TALK.replace('<p>', '<li><p>')}</ol>",
    "long sidebar": f"<article>{LEAD}</article><aside>{TALK * 9}</aside>",
    "a name that is wrong": f"<div class='page has-sidebar'>{LEAD}<div class='sidebar'>{TALK}</div></div>",
    "a form around all": f"<form id='f'><article>{LEAD}</article><div class='notice'>{TALK}</div></form>",
    "unclosed button": f"<article>{LEAD.replace('</h1>', '</h1><button>x')}</article><footer>f</footer>",
    "closed controls": f"<article>{LEAD.replace('</h1>', '</h1><button>x <b>y</b></button><select><option>a</select><svg><text>z</text></svg>')}</article>",
    "only the last button is closed": f"<article>{LEAD.replace('</h1>', '</h1><button>x').replace('</p>', '</p><button>y</button>', 1)}</article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_layouts(name):
    assert mainblocks.main_text(f"<body><nav><a href=/>Home</a></nav>{LAYOUTS[name]}</body>") == LEAD_TEXT


@pytest.mark.parametrize("number", [1, 3, 6, 12, 30])
def test_main_text_leaves_comments_of_any_number_out(spark, number):
    talk = f"<section class=\"comments\">{''.join(f'<p>{f"what reader {k} says " * 18}</p>' for k in range(number))}</section>"
    closed = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.html and "</article>" in r.html and "</body>" in r.html]
    assert closed
    for html in closed:
        want = article_text(html)
        assert mainblocks.main_text(html.replace("</body>", talk + "</body>")) == want
        assert mainblocks.main_text(html.replace("</article>", talk + "</article>")) == want


def test_many_unclosed_controls_take_linear_time():
    page = "<article>" + "<p>ok <button>x <svg>y <select>z" * 30_000
    assert mainblocks.main_text(page).split() == ["ok"] * 30_000


def test_extract_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><h1>T</h1><p>a b")] * 3 + [(None, None, "")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text) for r in mainblocks.extract(df).collect()) == [("1", "T a b")] * 3 + [("None", "")]


def test_tree_fits_its_table():
    x = np.array([row for row, _ in mainblocks.LABELLED], float)
    assert mainblocks.judge(mainblocks.tree(), x).tolist() == [bool(y) for _, y in mainblocks.LABELLED]
