import pytest

from sieveline.llm import wrappers

LONG = "words of an article that say what there is to say about number"


def read(pages, url="http://h/x"):
    """Texts of pages of one host, read by its wrapper."""
    merged = None
    for html in pages:
        w = wrappers.wrapper(wrappers.parse(html))
        merged = wrappers.merge(merged, w) if merged else w
    reader = wrappers.Reader.of(wrappers.common(merged))
    return [wrappers.main_text(wrappers.parse(html), wrappers.Reader.load(reader.dump())) for html in pages]


def body(k):
    return "".join(f"<p>{LONG} {k}.{i}</p>" for i in range(k % 3 + 1))


def text(k):
    return "\n\n".join(f"{LONG} {k}.{i}" for i in range(k % 3 + 1))


@pytest.mark.parametrize("layout", ['<div class="content has-sidebar">{}</div>', '<div class="page-with-menu"><article>{}</article></div>', '<div class="sidebar">{}</div>', '<div id="no-comments"><main>{}</main></div>', "<section class='menu-open'><div>{}</div></section>"])
def test_a_layout_class_does_not_empty_a_page(layout):
    pages = [f"<body><nav><a href=/>home</a></nav>{layout.format(body(k))}<div class='footer'>imprint {k}</div></body>" for k in range(9)]
    assert read(pages) == [text(k) for k in range(9)]
    assert [wrappers.main_text(wrappers.parse(p), None) for p in pages] == [text(k) for k in range(9)]


def test_marked_elements_beside_an_article_go():
    pages = [f"<body><div class='site-header'>Site {k}</div><div class=post>{body(k)}</div><div class='post-comments'><p>first {k}!</p></div><div id='cookie-notice'>we bake {k}</div></body>" for k in range(9)]
    assert read(pages) == [text(k) for k in range(9)]


def test_inline_adverts_and_buttons_go_without_ending_a_block():
    pages = [f"<article><p>{LONG} <span class='advert'>Buy <span>now</span> {k}</span>{k} <a class=share href=#>Tweet {k}</a>and <b class=x>more</b></p></article>" for k in range(4)]
    assert read(pages) == [f"{LONG} {k} and more" for k in range(4)]
    assert read(["<article><p>a <span class=advert>never closed</p><p>b</p></article>"]) == ["a\n\nb"]


def test_fixed_text_is_boilerplate_without_any_telling_class():
    html = "<div class=a1><h2>Read more in our paper</h2>{}<div>All rights are ours</div><h1>Title {}</h1></div>"
    pages = [html.format(body(k), k) for k in range(12)]
    want = [f"{text(k)}\n\nTitle {k}" for k in range(12)]
    assert read(pages) == want
    # This is the wrapper's doing: a page alone can't tell.
    assert [wrappers.main_text(wrappers.parse(p), None) for p in pages] != want


def test_equal_pages_alone_fix_nothing(spark):
    html = f"<div><h2>A title</h2><p>{LONG}</p><div>its end</div></div>"
    rows = [(k, "http://one/x", html) for k in range(40)] + [(100 + k, "http://two/x", html) for k in range(40)]
    rows += [(200 + k, "http://two/y", f"<div><h2>Title {k}</h2><p>{LONG} {k}</p><div>end {k}</div></div>") for k in range(6)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert {got[k] for k in (*range(40), *range(100, 140))} == {f"A title\n\n{LONG}\n\nits end"}
    assert all(got[200 + k] == f"Title {k}\n\n{LONG} {k}\n\nend {k}" for k in range(6))


def test_two_templates_on_one_host():
    a = [f"<body><div class=top><p>teaser {k}</p></div><div class=left>{body(k)}</div></body>" for k in range(9)]
    b = [f"<body><div class=top>{body(k)}</div><div class=left><p>teaser {k}</p></div></body>" for k in range(9)]
    got = read([*a, *b])
    assert all(x.endswith(text(k)) for k, x in enumerate(got[:9]))
    assert all(x.startswith(text(k)) for k, x in enumerate(got[9:]))


def test_deep_nesting_and_long_pages():
    deep = "<div>" * 5000 + "<p>inside</p>" + "</div>" * 2500 + " half way " + "</div>" * 2500
    assert read([f"<body><article>{deep}<p>after</p></article></body>"]) == ["inside\n\nhalf way\n\nafter"]
    hidden = "<div>" * 300 + "<nav><p>menu</p>" + "<div>" * 300 + "x" + "</div>" * 300 + "</nav><p>kept</p>"
    assert read([hidden]) == ["kept"]
    order = "".join(f"<div>{i} a" for i in range(400)) + "".join(f" {i} b</div>" for i in reversed(range(400)))
    assert read([f"<article>{order}</article>"])[0].split() == [w for i in range(400) for w in (str(i), "a")] + [w for i in reversed(range(400)) for w in (str(i), "b")]
    assert len(read(["<p>word and word</p>\n" * 50_000])[0]) == 50_000 * 15 - 2


def test_brute_force_over_fixed_and_varying_slots():
    """Every block is fixed or varying by construction; the answer is the varying ones, found here by counting texts."""
    pages = []
    for k in range(20):
        pages.append(["Fixed head", f"Title {k}", *[f"{LONG} {k}.{i}" for i in range(k % 4 + 1)], "Fixed foot"])
    html = ["<div class=z><h2>{}</h2><h1>{}</h1>{}<h4>{}</h4></div>".format(b[0], b[1], "".join(f"<p>{x}</p>" for x in b[2:-1]), b[-1]) for b in pages]
    count = {}
    for b in pages:
        for x in set(b):
            count[x] = count.get(x, 0) + 1
    assert read(html) == ["\n\n".join(x for x in b if count[x] == 1) for b in pages]
