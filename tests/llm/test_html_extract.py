import html
import re
import time
from collections import Counter, defaultdict

from spliceloom.llm.html_extract import counted, extracted, log_odds, main_text

SF = "/root/testdata/sf0.001"
CASES = [
    ("<body><nav>menu a b</nav><main><h1>T</h1><p>one\n two<br>three</p><aside>no</aside><section id='comments'>bad</section></main><footer>f</footer>", "T one two three"),
    ("<article><p>a<b>b</b>c &amp; d&#233; &copy</p><p>x<script>if (a<b) y()</script>y<!-- no --></p></article>", "abc & dé © xy"),
    ("<article><header><h1>Head</h1></header><form>f</form><div class='ad'>ad</div><p>body", "Head body"),
    ("<div class='cookie-notice'>we use cookies</div><div><p>only some words of text here</p></div><div class=\"sidebar\">x y z</div>", "only some words of text here"),
    ("", ""), (None, ""), ("<article></article>", ""), ("<<<>", ""),
]


def test_small_pages():
    for page, text in CASES[:-1]:
        assert main_text(page, log_odds({})) == text, page


def test_whole_table_against_the_marked_part(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r for r in extracted(pages).collect()}
    for r in pages.collect():
        assert rows[r.page_id].text == expected(r.html)
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text) and rows[r.page_id].url == r.url


def expected(page):
    part = page[page.find("<article>") + 9 : page.find("</article>")]
    part = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", part))
    return " ".join(html.unescape(part).split())


def test_learned_weights_decide(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    counts = defaultdict(lambda: [0, 0])
    for page in pages:
        for (kind, inside), n in counted(page).items():
            counts[kind][not inside] += n
    weights = log_odds(counts)
    bare = [re.sub("</?article>", "", p) for p in pages]
    good = 0
    for page, plain in zip(pages, bare):
        got, want = Counter(main_text(plain, weights).split()), Counter(expected(page).split())
        good += 2 * sum((got & want).values()) / max(1, sum(got.values()) + sum(want.values()))
        assert main_text(page, {k: -v for k, v in weights.items()}) != expected(page)
    assert good / len(pages) > 0.98
    # class words are learned too
    taught = weights | log_odds({"class:kiosk": (0, 500), "class:box": (300, 200)})
    page = "<p>one two three</p><div class='kiosk'>four five six</div><div class='box'><p>seven</p></div>"
    assert main_text(page, taught) == "one two three seven" and main_text(page, weights) == "one two three four five six seven"


def test_deep_and_stray_elements_take_linear_time():
    begun = time.time()
    assert main_text("<div>" * 50_000 + "x" + "</p>" * 50_000 + "</div>" * 50_000, {}) == "x"
    assert main_text("<article>" + "<p>a <i>" * 50_000 + "<math><mi>y</mi></math>", {}).split() == ["a"] * 50_000 + ["y"]
    assert time.time() - begun < 30


def test_nulls_repeats_and_empty_table(spark):
    pages = spark.createDataFrame([(i, None, p, 1) for i, (p, _) in enumerate(CASES)] * 2 + [(None, "u", "<p>" * 3000 + "x", 2)], "page_id long, url string, html string, text int")
    rows = extracted(pages).collect()
    assert len(rows) == 2 * len(CASES) + 1 and all(r.n_chars == len(r.text) for r in rows)
    assert all(r.text == CASES[r.page_id][1] for r in rows if r.page_id is not None and r.page_id < len(CASES) - 1)
    assert [r.text for r in rows if r.page_id is None] == ["x"]
    assert extracted(pages.limit(0)).count() == 0


def test_all_marked_parts_and_unmarked_texts():
    text = " ".join(f"word{k}" for k in range(100))
    weights = log_odds({})
    assert main_text("<article><p>the smaller part of two</p></article> <article><p>and the larger of the two parts</p></article>", weights) == "the smaller part of two and the larger of the two parts"
    assert text in main_text(f"<div class='story'><p>{text}</p></div><article class='card'><p>a teaser</p></article>", weights)
    assert main_text(f"<div><p>a few words outside</p></div><main><p>{text}</p></main>", weights) == text
    assert main_text("<article><div class='entry-header'><h1>Head</h1></div><p class='side-by-side'>one two</p><div class='sidebar'>no</div></article>", weights) == "Head one two"
    assert main_text("<div class='page-header'>no</div><div><p>only some words of text here</p></div>", weights) == "only some words of text here"


def test_class_words_inside_an_article():
    weights = log_odds({})
    for name in ("social-security", "search-results-table", "related-work", "comment-free-zone", "navy", "reply_to_critics"):
        assert main_text(f"<article><p>one</p><div class='{name}'><p>two</p></div></article>", weights) == "one two", name
    for name in ("comments", "comment-list", "ad", "ad-box", "sidebar", "related-posts", "newsletter-signup", "cookie-notice", "social links", "share"):
        assert main_text(f"<article><p>one</p><div class='{name}'><p>two</p></div></article>", weights) == "one", name
    assert main_text("<div class='social-security'>no</div><div><p>only some words of text here</p></div>", weights) == "only some words of text here"
    taught = weights | log_odds({"class:related-": (0, 500)})
    assert main_text("<article><p>one</p><div class='related-work'><p>two</p></div></article>", taught) == "one"
