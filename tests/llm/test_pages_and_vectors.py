"""Operators on pages and vectors, and the pipeline."""

import base64
import hashlib
import html as references
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortline.llm import ann, html_extract, toxicity, url_filter, warc
from cohortline.llm.common import load
from cohortline.llm.queries import QUERIES, SQL
from tests.llm import helpers
from tests.llm.test_documents import check_packed
from tools.check import TABLES, compare


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, con, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], SQL[name], sf)
    assert ok, note


# HTML

STORY = "This is the story of the man who was in the town and it was not to be of any use to him or to those who were there. " * 3
PAGES = {
    "<body><nav>Home</nav><article><h1>A  title</h1><p>One<br>two &amp; three&nbsp;x</p><aside>Side</aside><p>Four <a href=x>five</a></article><footer>End</footer>": "A title\nOne two & three x\nFour five",
    f"<div class='menu'><a href=/>Home</a></div><h2>Head</h2><p>{STORY}</p><p>Short.</p><div id=comments><p>{STORY}</p></div>": f"Head\n{STORY.strip()}\nShort.",
    f"<main><header><h1>T</h1></header><div class='cookie-notice'>We use</div><p>{STORY}</p><form>Name <input></form><ul><li><a>More</a><li><a>Else</a></ul></main>": f"T\n{STORY.strip()}",
    "<article><p>a<script>var t='</p>';</script>b<!-- c --><style>p{}</style></p><section class='reader comments'><p>No</p></section></article>": "ab",
    "<article><p>cut off <b": "cut off",
    "<article><p>5 < 6 and &lt;b&gt; &#233; &amp": "5 < 6 and <b> é &",
    "": "",
    "<p><a href=x>only links here</a></p>": "",
    "<article><p class=\"x>y\">quoted</p><div hidden>no</div><div role=navigation>no</div></article>": "quoted",
}


def test_main_text_of_made_pages():
    for page, text in PAGES.items():
        assert html_extract.main_text(page) == text
    assert html_extract.main_text(None) == ""


def test_undecided_blocks_follow_their_neighbours():
    block = html_extract.Block
    found = html_extract.classify([
        block("nav links", 9, "li", False, False), block("short", 0, "p", False, False), block(STORY, 0, "p", False, False),
        block("short too", 0, "p", False, False), block("x" * 300, 0, "p", False, False),
    ])
    assert [b.label for b in found] == ["bad", "bad", "good", "bad", "bad"]


def test_article_marks_are_only_evidence():
    teaser = "<article><h3><a href=x>Another story</a></h3><p>What they read.</p></article>"
    story = STORY.strip()
    for page, text in {
        f"<h1>Head</h1><div><p>{STORY}</p><p>{STORY}</p></div><ul><li><a href=x>More</a></ul>{teaser * 4}": f"Head\n{story}\n{story}",
        f"<main><div><p>{STORY}</p><p>{STORY}</p></div><ul><li><a href=x>More</a></ul>{teaser * 4}</main>": f"{story}\n{story}",
        f"<div><p>{STORY}</p></div><article><h1>T</h1><p>{STORY}</p></article>": f"{story}\nT\n{story}",
        f"<p>Not of it.</p><article><h1>T</h1><p>{STORY}</p><p>Copyright 2024 A Ltd. All rights reserved.</p></article>": f"T\n{story}",
        f"<article><p>{STORY}</p><p>{'zug ' * 60}</p><p>{STORY}</p></article>": f"{story}\n{('zug ' * 60).strip()}\n{story}",
        f"<article><p>{STORY}</p><p><a href=x>One link</a></p><p>{'zug ' * 60}</p><p><a href=x>Two links</a></p></article>": story,
        f"<article><p>{'zug ' * 60}</p></article><p>Else</p>": ("zug " * 60).strip(),
        f"<p>{STORY} \xa9 B.</p><p>\xa9 2024 C</p>": f"{story} \xa9 B.",
    }.items():
        assert html_extract.main_text(page) == text


def test_names_are_whole_and_give_way_to_most_of_the_text():
    story = STORY.strip()
    for page in (
        "<body class='has-sidebar'><p>{}</p></body>", "<html class='modal-open no-menu'><body id=widget><p>{}</p>", "<div class='no-menu'><p>{}</p></div>",
        "<article class='post has-comments'><p>{}</p></article>", "<article class=comments><p>{}</p></article>", "<body><form><div><p>{}</p></div></form></body>",
        "<div class=sidebar><p>{}</p></div><div class=menu><a href=x>Home</a></div>", "<div id=comments><p>{}</p></div><p>Short.</p>", "<form><p>{}</p><nav>Menu here</nav></form>",
    ):
        assert story in html_extract.main_text(page.format(STORY)), page
        assert "Menu" not in html_extract.main_text(page.format(STORY)) and "Home" not in html_extract.main_text(page.format(STORY))
    assert html_extract.main_text("<form><p>All is short.</p><p>Short too.</p></form>") == "All is short.\nShort too."
    assert html_extract.main_text(f"<p>{STORY}</p><div class=widget><p>{STORY}</p><p>Buy it.</p></div>") == f"{story}\n{story}"
    for name in ("sidebar", "site-footer", "comment-list", "cookie-notice", "main-nav l-menu"):
        assert html_extract.main_text(f"<p>{STORY}</p><p>Ends.</p><div class='{name}'><p>{STORY}</p></div>") == f"{story}\nEnds.", name
    assert html_extract.main_text(f"<p hidden>{STORY}</p>") == ""


PROSE = {
    "en": "The house by the river was built in the year of the great flood and it has stood there for more than a hundred years, as the people of the town like to say to all who come to see it.",
    "fr": "La maison au bord de la rivière a été construite dans les années de la grande crue et elle est restée là pendant plus de cent ans, comme le disent les gens de la ville à tous ceux qui viennent.",
    "de": "Das Haus an dem Fluss ist in dem Jahr der großen Flut gebaut worden und es steht dort seit mehr als hundert Jahren, wie die Leute in der Stadt es allen erzählen, die sich das Haus ansehen.",
    "pl": "Dom nad rzeką został zbudowany w roku wielkiej powodzi i stoi tam już ponad sto lat, jak lubią mówić mieszkańcy miasteczka każdemu, kto przyjeżdża go zobaczyć i posłuchać dawnych opowieści.",
    "ru": "Дом у реки был построен в год большого наводнения и стоит там уже больше ста лет, как любят рассказывать жители городка каждому, кто приезжает посмотреть на него и послушать старые истории.",
    "zh": "河边的那座房子是在大洪水那一年建造的,至今已经矗立了一百多年,镇上的人总喜欢把这个故事讲给每一个前来参观的客人听,大家都觉得非常有意思,也愿意再来看看。",
}
MENU = "<div class=menu><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Contact</a></li></ul></div>"
FOOT = "<footer><p>&copy; 2021 Example</p><a href=/d>Terms</a></footer>"


@pytest.mark.parametrize("lang", list(PROSE))
def test_pages_without_marks_in_any_language(lang):
    text = PROSE[lang]
    first, second = text, " ".join(reversed(text.split(" "))) if lang != "zh" else text[::-1]
    page = f"<html><body>{MENU}<div><h2>T {lang}</h2><p>{first}</p><p>{second}</p></div><div class=sidebar><p>{text}</p></div>{FOOT}</body></html>"
    assert html_extract.main_text(page) == f"T {lang}\n{first}\n{second}"
    quoted = f"<html><body>{MENU}<div><p title=don't>{first}</p><p data-x='a > b' lang=\"{lang}\">{second}</p><p title=it's>{first}</p></div>{FOOT}</body></html>"
    assert html_extract.main_text(quoted) == f"{first}\n{second}\n{first}"


def test_teasers_in_articles_do_not_take_the_place_of_prose():
    teasers = "".join(f"<article><a href=/{i}>Read story {i}</a></article>" for i in range(4))
    page = f"<body>{MENU}<div><p>{PROSE['pl']}</p><p>{PROSE['pl']}</p></div>{teasers}{FOOT}</body>"
    assert html_extract.main_text(page) == f"{PROSE['pl']}\n{PROSE['pl']}"


def test_a_lone_short_paragraph_is_the_text():
    for words in ("Closed on Monday.", "Zamknięte w poniedziałek.", "星期一休息。"):
        assert html_extract.main_text(f"<body>{MENU}<p>{words}</p>{FOOT}</body>") == words
    assert html_extract.main_text(f"<body>{MENU}{FOOT}</body>") == ""


def test_tags_end_outside_quotes_of_values(spark):
    cases = {
        '<p><a title="x > y">link</a> more</p>': "link more", "<p title=don't>one</p><p>it's two</p>": "one\nit's two",
        "<div data-a = '>'>in</div><br title='a>b'/>out": "in\nout", '<p class="open>never closed': "never closed",
        "<script src='a>b'>x()</script>y": "y", "a < b and c > d": "a < b and c > d",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = {r["page_id"]: r["block"] for r in warc.derive(warc.responses(df)).filter("record_type = 'conversion'").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    long = "<p " + " ".join(f'a{i}="x > {i}"' for i in range(3000)) + f" style='{'y' * 100_000}'>text</p>"
    one = warc.derive(warc.responses(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")))
    assert one.filter("record_type = 'conversion'").first()["block"] == "text"


def test_extract_rows(spark):
    rows = [(i, f"http://x/{i}", h, "t") for i, h in enumerate(PAGES)] + [(0, None, None, "t"), (None, "u", "<article>" + "<p>x y</p>" * 50_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    want = Counter((i, u, html_extract.main_text(h), len(html_extract.main_text(h))) for i, u, h, _ in rows)
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got) == want
    assert max(r["n_chars"] for r in got) == 50_000 * 4 - 1
    assert html_extract.extract(df.filter("false")).count() == 0


def test_extract_query_like_a_plain_cut_of_the_article(spark, sf):
    pages = {r["page_id"]: r["html"] for r in load(spark, sf, "pages").collect()}
    for r in QUERIES["op1_html_extract"](spark, sf).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", inner[1])) if inner else []
        parts = [" ".join(references.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
        assert r["text"] == "\n".join(p for p in parts if p)


# WARC


def test_records_link_to_their_responses(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x &amp; y</p><script>1</script>", 1), (2, None, None, 1), (1, "http://a/", "<p>x &amp; y</p><script>1</script>", 1)], "page_id long, url string, html string, r int")
    source = warc.responses(df)
    ids = Counter(r["record_id"] for r in source.collect())
    records = warc.serialize(warc.derive(source), "2024-01-01T00:00:00Z").collect()
    assert len(records) == 6 and {r["refers_to"] for r in records} == set(ids)
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert block == r["block"].encode() + b"\r\n\r\n" and len(r["block"].encode()) == r["content_length"]
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert lines["WARC-Refers-To"] == r["refers_to"] and lines["WARC-Type"] == r["record_type"]
        assert lines["WARC-Block-Digest"] == "sha1:" + base64.b16encode(hashlib.sha1(r["block"].encode()).digest()).decode().lower()
    text = next(r for r in records if r["record_type"] == "conversion" and r["page_id"] == 1)
    assert text["block"] == "x & y" and "Content-Length: 34" in text["source_headers"]
    assert warc.derive(warc.responses(df.filter("false"))).count() == 0


def test_conversion_records_decode_every_reference_and_keep_source_headers(spark):
    html = "<p>caf&eacute; &mdash; it&rsquo;s &#8217;&#xE9;&#233; &apos;x&apos; &amp;lt; a&#10;b&nbsp;&#160;c &unknown; &#x110000; A&amp;B</p><p>&hellip;</p>"
    records = warc.derive(warc.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")))
    for r in warc.serialize(records, "2024-01-01T00:00:00Z").collect():
        if r["record_type"] == "conversion":
            assert r["block"] == "café — it’s ’éé 'x' &lt; a b c &unknown; \ufffd A&B\n…"
            assert r["block_digest"] == "sha1:" + hashlib.sha1(r["block"].encode()).hexdigest()
        head = bytes(r["record"]).partition(b"\r\n\r\n")[0].decode().split("\r\n")
        assert f"Source-Digest: {r['source_digest']}" in head
        assert [x.removeprefix("Source-Header: ") for x in head if x.startswith("Source-Header: ")] == r["source_headers"].strip().split("\r\n")


# URLs


def by_rules(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(helpers.UPPER), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark, sf):
    urls = [None, "", "no scheme", "http://Example.ORG/es/1", "https://a.example.org/en/12?x#y", "ftp://x.org", "http://x.org/", "http://xorg/", "HTTP://b.com/fr/", "http://b.com/de/#a", "a://b://c.org/x", "http://notexample.org/es/", "http://ÄB.com/fr/"]
    df = spark.createDataFrame([(i, u, "<p>words of a page</p>", "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    for pages, given in ((df, dict(enumerate(urls))), (load(spark, sf, "pages"), {r["page_id"]: r["url"] for r in load(spark, sf, "pages").collect()})):
        got = url_filter.judge(pages).collect()
        assert len(got) == len(given)
        for r in got:
            host, path, rule, verdict = by_rules(given[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
            assert verdict in (None, r["verdict"])
    assert url_filter.judge(df.filter("false")).count() == 0


def test_names_are_split_as_the_best_of_all_splits():
    counts = {"a": 3, "ab": 5, "b": 2, "abc": 1, "c": 4, "bc": 9}
    total = sum(counts.values())

    def cost(parts):
        return sum(np.log(total) - np.log(counts[p]) if p in counts else np.log(total) + len(p) * np.log(10) for p in parts)

    def splits(s):
        return [[]] if not s else [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in splits(s[i:])]

    for name in ("abc", "abcabc", "xabz", "aabbcc", "zzz"):
        assert np.isclose(cost(url_filter.split_name(name, counts, total)), min(map(cost, splits(name))))
    assert "casino" in url_filter.split_name("bestcasino", {"best": 5}, 10_000)


def test_model_blocks_what_rules_block_elsewhere(spark):
    rows = [(i, f"http://{w}.com/de/{i}", "<p>toad river</p>") for i, w in enumerate(["toadriver", "rivertoad"] * 20)]
    rows += [(100 + i, f"http://{w}.com/fr/{i}", "<p>moss stone</p>") for i, w in enumerate(["mossstone", "stonemoss"] * 20)]
    rows += [(200, "http://toad.net/en/1", ""), (201, "http://moss.net/en/1", ""), (202, "http://casino.net/en/1", None)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[200], got[201], got[202]) == ("block", "allow", "block")


def test_names_with_digits_and_letters_beyond_ascii_are_split(spark):
    text = "best casino casino go poker grün grün blume blume " * 20
    hosts = ["bestcasino24.net", "xxx2go.com", "888poker.com", "GRÜNBLUME.net", "a-1.b22"]
    pages = spark.createDataFrame([(i, f"http://{h}/x", text) for i, h in enumerate(hosts)], "page_id long, url string, html string")
    names = pages.select(url_filter.host_of(F.col("url")).alias("host"))
    got = {r["host"]: r["words"] for r in url_filter.segmented(names, url_filter.word_counts(pages)).collect()}
    assert got["bestcasino24.net"][:3] == ["best", "casino", "24"] and got["xxx2go.com"][:3] == ["xxx", "2", "go"]
    assert got["888poker.com"][:2] == ["888", "poker"] and got["a-1.b22"] == ["a", "1", "b", "22"]
    assert got["grÜnblume.net"][:2] == ["grün", "blume"]
    paths = spark.createDataFrame([("/Straße/Äpfel-12/99/b2",)], "p string").select(url_filter.path_tokens(F.col("p")).alias("t"))
    assert paths.first()["t"] == ["straße", "äpfel", "#", "#", "b2"]
    rows = [(i, f"http://{w}.com/{'de' if i % 2 else 'fr'}/{i}", "<p>toad moss</p>") for i, w in enumerate(["moss", "toad"] * 20)]
    rows += [(200, "http://bestcasino24.net/en/1", ""), (201, "http://moss24.net/en/1", "")]
    judged = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (judged[200], judged[201]) == ("block", "allow")


# Vectors


def recall(vectors, got, every=50, k=5):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lists = defaultdict(list)
    for r in got:
        lists[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = n = 0
    for i in np.flatnonzero(ids % every == 0):
        s = np.round(u @ u[i], 12)
        s[ids == ids[i]] = -9
        true = ids[np.lexsort((ids, -s))][:k]
        mine = sorted(lists[ids[i]])
        assert [r for r, _, _ in mine] == list(range(1, min(k, len(ids) - 1) + 1)) and ids[i] not in [v for _, v, _ in mine]
        assert all(abs(sc - u[i] @ u[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, sc in mine)
        order = [(-round(sc, 12), v) for _, v, sc in mine]
        assert order == sorted(order)
        hit += len(set(true.tolist()) & {v for _, v, _ in mine})
        n += min(k, len(ids) - 1)
    return hit / max(n, 1)


def test_neighbours_query_recall(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in load(spark, sf, "embeddings").collect()]
    assert recall(vectors, QUERIES["op4_nn_descent"](spark, sf).collect()) >= 0.95


def test_neighbours_within_groups_of_near_copies(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=64)
    noise = rng.normal(size=(800, 64)) * 0.019  # neighbours' cosine about 0.9993
    x = np.where((np.arange(800) < 700)[:, None], middle + noise, rng.normal(size=(800, 64)))
    vectors = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert recall(vectors, ann.neighbours(df, shape=ann.Shape(rounds=3, starts=2)).collect()) >= 0.95


def test_scores_that_tie_within_rounding_widen_beam_and_rescoring():
    margin = ann._margin(64)
    scores = [1.0, *[0.9 - margin / 1000 * i for i in range(700)], *[0.5] * 300]
    assert ann._near(scores, 32, 5, margin) == ann._near(scores, 512, 5, margin) == 701
    assert ann._near(scores[:20], 32, 5, margin) == 20 and ann._near([1.0 - i / 100 for i in range(90)], 32, 5, margin) == 32


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(y)) for y in rng.normal(size=6)]) for i in range(150)]
    same = good[7][1]
    good += [(i, same) for i in range(150, 260)]  # one vector owns a large share
    odd = [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] + [1.0] * 5), (306, [1.0, 2.0]), (None, same), (350, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "q") for i, v in good + odd + [good[3]]], "vec_id long, embedding array<float>, q string")
    shape = ann.Shape(rounds=2, starts=2, beam=64)
    got = ann.neighbours(df, shape=shape).collect()
    assert recall(good, got) >= 0.95
    tied = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 200)
    assert [v for _, v in tied] == [7, 150, 151, 152, 153]
    assert ann.neighbours(df.filter("false"), shape=shape).count() == 0
    assert ann.neighbours(df.filter("vec_id = 100"), shape=shape).count() == 0


# Pipeline


def test_pipeline_like_its_stages_done_plainly(spark, sf):
    docs = load(spark, sf, "documents")
    model = toxicity.fit(docs, load(spark, sf, "labels"))
    worth = toxicity._Worth(model.weights, model.shape)
    left = []
    for r in docs.collect():
        w = toxicity.words_of(r["text"])
        odds = model.intercept + sum(worth[x] for x in w) / (len(w) + model.shape.padding)
        if 1 / (1 + np.exp(-odds)) < toxicity.THRESHOLD:
            left.append((r["doc_id"], r["text"]))
    group = helpers.components(left)
    left = [(i, t) for i, t in left if group[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in load(spark, sf, "benchmark").collect()]
    leaked = {r[0] for r in helpers.leaks(left, items) if r[2]}
    left = {i: t for i, t in left if i not in leaked}
    masked = corpus_pipeline.mask_secrets(spark, docs, sf).collect()
    for r in masked:
        assert not helpers.secrets(r["text"]) and r["n_chars"] == len(r["text"])
    masked = [(r["doc_id"], r["text"]) for r in masked if r["doc_id"] in left]
    check_packed(corpus_pipeline.run(spark, sf).collect(), masked, 4096)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]


def test_pipeline_on_odd_rows(spark, odd_docs, sf):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd_docs.columns
    assert docs.filter("doc_id is null and text is null").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
    empty = odd_docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
    assert os.path.exists(corpus_pipeline.__file__)
