"""The lexer of tags, and what the checks say of each."""

import pytest

from assaykit.operators import markup

LEXER = markup.Lexer(markup.values())


@pytest.mark.parametrize(
    "text, attributes",
    [
        ("<input a=\"1 > 0\" b='c' d=`e` f=g h>", {"a": ("literal", "1 > 0"), "b": ("literal", "c"), "d": ("literal", "e"), "f": ("literal", "g"), "h": ("bare", "")}),
        ("<a b={() => { x({c: '}'}) }} d = {1}/>", {"b": ("expr", "{() => { x({c: '}'}) }}"), "d": ("expr", "{1}")}),
        ("<a {title} {...rest} />", {"title": ("expr", "{title}")}),
        ("<a :b='c' v-bind:d='e' [attr.f]='g' [h]='i' @click='j'>", {"b": ("literal", "c"), "d": ("literal", "e"), "f": ("literal", "g"), "h": ("literal", "i"), "@click": ("literal", "j")}),
        ("<a href=/x/y>", {"href": ("literal", "/x/y")}),
        ("<a <%= b %> c>", {"c": ("bare", "")}),
        ("<a\n  Alt\n  =\n  'b'\n>", {"alt": ("literal", "b")}),
    ],
)
def test_attributes(text, attributes):
    (tag,) = LEXER.tags(text)
    assert {k: (v["kind"], v["value"]) for k, v in tag["attributes"]} == attributes


def test_what_is_no_tag():
    assert [t["name"] for t in LEXER.tags("i<input; a[0]<b f(x)<c 1 < 2 <d e\n")] == []
    assert LEXER.tags("<a b='c") == [] and LEXER.tags("<a " + "x " * 3000 + ">") == [] and LEXER.tags("<a {b") == []
    assert LEXER.tags("<!-- <a> --> /* <b> */ {# <c> #} <%# <d> %>\n// <e>") == []
    tags = LEXER.tags("x</a>\n<My.Thing>\n<a:b/>")
    assert [(t["name"], t["line"], t["closing"]) for t in tags] == [("a", 1, True), ("My.Thing", 2, False), ("a:b", 3, False)]


def test_long_texts():
    text = "<p>" + "word " * 200_000 + "</p><img>" * 3
    assert [t["name"] for t in LEXER.tags(text)] == ["p", "p", "img", "p", "img", "p", "img"]


CASES = {
    "<img>": [("image", "hit")],
    "<img alt=''>": [("image", "fine")],
    "<area {...a}>": [("image", "unknown")],
    "<Img>": [],
    "<input>": [("control", "hit")],
    "<input type=submit><input type='HIDDEN'>": [],
    "<input type={t}>": [("control", "unknown")],
    "<label>a <input></label><input>": [("control", "fine"), ("control", "hit")],
    "<label/><input>": [("control", "hit")],
    "<label for='a'></label><input id=' a '><input id=b>": [("control", "fine"), ("control", "hit")],
    "<label htmlFor={a}></label><input id={a}><input id='b'>": [("control", "fine"), ("control", "unknown")],
    "<select :title='x'>": [("control", "fine")],
    "<button aria-hidden>": [("hidden", "hit")],
    "<button aria-hidden='false'>": [("hidden", "fine")],
    "<button aria-hidden={h}>": [("hidden", "unknown")],
    "<button aria-hidden={true} disabled={d}>": [("hidden", "unknown")],
    "<button aria-hidden='true' disabled={true}>": [("hidden", "fine")],
    "<div aria-hidden='true' tabindex='0'>": [("hidden", "hit")],
    "<div aria-hidden='true' tabIndex={-1}>": [("hidden", "fine")],
    "<div aria-hidden='true'>": [("hidden", "fine")],
    "<a aria-hidden='true' href='#'>": [("hidden", "hit")],
    "<input type='hidden' aria-hidden='true'>": [("hidden", "fine")],
    "": [],
}


def test_checks(spark):
    rows = [*((i, t) for i, t in enumerate(CASES)), (99, None)]
    df = spark.createDataFrame(rows, "page_id int, html string")
    got = [[] for _ in CASES]
    for r in sorted(markup.checks(df, "page_id", "html").collect(), key=lambda r: (r.page_id, r.line)):
        got[r.page_id].append((r.check, r.state))
    for (text, want), found in zip(CASES.items(), got):
        assert sorted(found) == sorted(want), text


def test_documents_and_browsers(spark):
    files = {
        "a/index.html": '<meta name="viewport" content="width=device-width">',
        "b/index.html": "<html></html>",
        "c/index.html": '<meta name="viewport" content="maximum-scale=1.0">',
        "d/index.html": '<!-- user-scalable=no --><meta name=viewport>',
        "tests/index.html": "<html></html>",
        "x/app/layout.tsx": "export default 1",
        "y/app/layout.tsx": "export const viewport = { userScalable: false }",
        "package.json": '{"browserslist": []}',
        ".browserslistrc": "# none\n",
        "w/.browserslistrc": "last 2 versions",
        "next.config.js": "module.exports = {}",
        "dist/package.json": '{"browserslist": []}',
    }
    df = spark.createDataFrame([*files.items(), ("e/index.html", None)], "path string, text string")
    assert {r.path: r.state for r in markup.viewports(df).collect()} == {"a/index.html": "fine", "b/index.html": "missing", "c/index.html": "zoom_disabled", "d/index.html": "fine", "x/app/layout.tsx": "default", "y/app/layout.tsx": "zoom_disabled"}
    assert {r.path: r.says for r in markup.browser_support(df).collect()} == {"package.json": "declared", "w/.browserslistrc": "declared", "next.config.js": "Next.js"}
