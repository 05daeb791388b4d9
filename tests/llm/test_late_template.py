import json

from sieveline.llm import wrappers

OLD = "<div class=top><p>Old article {i} with words that vary {i}.</p></div>"
# The old path matches here too, but holds only a teaser; the article is elsewhere.
NEW = "<div class=top><p>Teaser {i}</p></div><div class=body><p>New article {i}, {t}.</p></div>"
LONG = "a long text of many words that says what there is to say about number "


def page(k):
    return NEW.format(i=k, t=LONG + f"{k} " + LONG + str(k)) if k >= 1100 else OLD.format(i=k)


def test_elements_first_met_late_are_kept():
    merged = None
    for k in range(3000):
        w = wrappers.wrapper(wrappers.parse(page(k)))
        merged = wrappers.merge(merged, w) if merged else w
    late = [c for c in merged.children if c.key == "div.body"]
    assert merged.pages == 3000 and [c.pages for c in late] == [1900]
    assert wrappers.article_path(wrappers.common(merged)) == ["div.body"]


def test_rare_elements_are_forgotten_and_stay_few():
    merged = None
    for k in range(5000):
        own = "".join(chr(97 + int(x)) for x in str(k))
        w = wrappers.wrapper(wrappers.parse(f"<div class=top><p>text {k}</p></div><div class=q{own}>x</div>" + ("<h2>now and then</h2>" if k % 100 == 0 else "")))
        merged = wrappers.merge(merged, w) if merged else w
    assert len(merged.children) < 1500
    # Packed and read again it is the same, and what one page in RARE or more has stays.
    again = wrappers.common(wrappers._unpack(json.loads(json.dumps(wrappers._pack(merged)))))
    assert {"div.top", "h2"} <= {c.key for c in again.children}
    assert sum(c.key == "div.top" for c in again.children) == 1


def test_a_host_whose_template_changes_late(spark):
    rows = [(k, "http://h/x", page(k)) for k in range(3000)]
    # One task, in order of the pages.
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert len(got) == 3000
    assert all(got[k].startswith(f"New article {k}") for k in range(1100, 3000))
    assert all(got[k] == f"Old article {k} with words that vary {k}." for k in range(1100))
