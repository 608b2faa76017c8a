import numpy as np
import pytest

from voltframe.llm import html

P1 = "The first paragraph of this page has a good length, some commas, and an end."
P2 = "Another paragraph follows here; it is as long as the other one, or longer, and says more."
P3 = "At last a third one ends the text, which is what the reader came for, after all."
BODY = f"<h1>Title</h1><p>{P1}</p><p>{P2}</p><h2>Part</h2><p>Short.</p><p>{P3}</p>"
WANT = "\n\n".join(["Title", P1, P2, "Part", "Short.", P3])
MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
TALK = "<section class='comments'><h3>Comments</h3><div class=comment><p>I like it a lot, really.</p></div><div class=comment><p>So do I, and more.</p></div></section>"
SIDE = "<div class='sidebar-left'><ul><li><a href=/x>See this</a></li></ul></div><div class='cookie-notice'>We use cookies, as all do.</div>"
END = "<form action=/s><input name=q><button>Go</button></form><footer>&copy; 2020 The makers, all rights reserved.</footer>"

WRAPPERS = [
    "<div class='page has-sidebar'>{}</div>",
    "<div class='content no-sidebar'>{}</div>",
    "<form id='aspnetForm'>{}</form>",
    "<div class='wrapper search-page'>{}</div>",
    "<div class='header-main'>{}</div>",
    "<div id=main class=widget>{}</div>",
    "<header>{}</header>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("article", ["<article>{}</article>", "<main>{}</main>", "<div itemprop=articleBody>{}</div>", "<div class=story>{}</div>"])
def test_wrappers_do_not_empty_a_page(wrapper, article):
    inner = article.format(BODY)
    page = "<html><head><title>T</title></head><body>" + wrapper.format(MENU + inner + TALK + SIDE) + END + "</body></html>"
    assert html.main_text(page) == WANT


def test_no_article_and_no_wrapper():
    assert html.main_text("<body>" + MENU + "<div class=ad>Buy it now, it is cheap.</div>" + BODY + TALK + SIDE + END) == WANT
    assert html.main_text(BODY) == WANT


def test_two_articles_stay_and_teasers_go():
    two = f"<article><h1>One</h1><p>{P1}</p><p>{P2}</p></article><article><h1>Two</h1><p>{P3}</p><p>{P2}</p></article>"
    teaser = "<article class=related><p>Read on.</p></article><article><p>More.</p></article>"
    assert html.main_text("<body>" + MENU + two + teaser + END) == "\n\n".join(["One", P1, P2, "Two", P3, P2])


def test_names_of_paragraphs_are_no_veto():
    page = f"<body>{MENU}<article><h1>Title</h1><p class=related-work>{P1}</p><div class=widget-x><p>{P2}</p></div><div class=share-buttons>Share</div></article>{END}"
    assert html.main_text(page) == "\n\n".join(["Title", P1, P2])


def test_a_long_thread_does_not_replace_the_article():
    talk = "<div id=comments>" + "".join(f"<div class=comment><p>{P2}</p></div>" for _ in range(30)) + "</div>"
    assert html.main_text("<body>" + MENU + "<article>" + BODY + "</article>" + talk + END) == WANT


def test_long_and_deep_pages_are_read_whole():
    many = [f"{P1} {i}" for i in range(20_000)]
    page = "<body>" + MENU + "<article>" + "".join(f"<p>{t}</p>" for t in many) + "</article>" + END
    assert html.main_text(page) == "\n\n".join(many)
    deep = "<div>" * 20_000 + f"<p>{P1}</p>" + "</div>" * 20_000
    assert html.main_text(deep) == P1


def test_ratios_match_a_plain_version():
    page = "<body>" + MENU + BODY + TALK + END + "<ul><li>One, two.</li><li><a href=/>three</a></li></ul>"
    _, found = html.blocks(page)

    def path(e):
        return [] if e is None else [*path(e.parent), e.tag + (".comment" if e.tag == "div" else "")]

    paths = [tuple(path(b.at)) for b in found]
    plain = []
    for k in range(2):
        each = []
        for p in paths:
            same = [b for b, q in zip(found, paths, strict=True) if q == p]
            value = [len(b.text) - b.linked if k == 0 else sum(not c.isalnum() and not c.isspace() and c != "©" for c in b.text) * (b.linked == 0) for b in same]
            each.append(sum(value) / len(same))
        side = [each[0]] * 2 + each + [each[-1]] * 2
        plain.append([sum(w * side[i + j] for j, w in enumerate((0.054, 0.242, 0.408, 0.242, 0.054))) for i in range(len(each))])
    assert np.allclose(html.ratios(found), [t * (1 + m) for t, m in zip(*plain, strict=True)])


def test_threshold_splits_best():
    rng = np.random.default_rng(2)
    x = np.r_[rng.random(20), 50 + rng.random(30)]
    best = max((a.mean() - b.mean()) ** 2 * len(a) * len(b) for v in np.sort(x)[1:] for a, b in [(np.log1p(x[x < v]), np.log1p(x[x >= v]))])
    low, high = np.log1p(x[x < html.threshold(x)]), np.log1p(x[x >= html.threshold(x)])
    assert np.isclose(best, (low.mean() - high.mean()) ** 2 * len(low) * len(high)) and len(high) == 30
    assert (np.ones(5) >= html.threshold(np.ones(5))).all()


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", BODY), (1, "u", BODY), (None, None, None), (2, "v", ""), (3, "w", " <p> </p>")], "page_id long, url string, html string")
    got = html.extract_text(df)
    assert sorted(r.main_text for r in got.collect()) == ["", "", "", WANT, WANT]
    assert html.extract_text(df.where("false")).collect() == []
