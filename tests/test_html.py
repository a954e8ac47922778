import html as html_lib
from html.entities import html5

from sitefeed.functions.exprs import matches, text
from sitefeed.functions import html

URL = "http://a.com/p/last"


def test_character_references_equal_the_standard_rule(values):
    cases = [
        "plain", "a &amp; b", "&hellip;&#150;&#x41;&notin;", "&bogus; &copy2 &#0; &#x1F600;",
        "&amp;lt; &lt", "&amp", "&#xD800; &#1114112; &#99999999999;", "&&;&#;", "&nbsp;x", "&AMP;",
    ]
    found = values(html.unescape("t"), [(c,) for c in cases], ["t"])
    assert found == [html_lib.unescape(c) for c in cases]


def test_text_has_one_line_per_node(values):
    page = (
        "<!DOCTYPE html><?pi x?><p>a <b>x</b>y<p title='1 > 0'>\xa0 z&nbsp;&amp; </p>"
        "<!-- no --><SCRIPT>no</p></SCRIPT><style>no</style><template>no</template>"
        "1 < 2<br/>\n end<script>open"
    )
    assert values(html.html_to_text("t"), [(page,)], ["t"]) == ["a\nx\ny\nz\xa0&\n1 < 2\nend"]


def test_text_keeps_whole_long_pages(values):
    page = "<p>" + "word <i>x</i> " * 60000 + "</p>" + "<!--" + "-" * 500000 + "-->tail"
    text = values(html.html_to_text("t"), [(page,)], ["t"])[0]
    assert text.count("word") == 60000 and text.endswith("tail")


def test_title_cascade(values):
    og, card = '<meta content="OG &amp; x" property="og:title">', "<meta name='twitter:title' content=TW>"
    cases = {
        "<h2>b</h2><h1> a <i>c</i></h1><title>t</title>": ("ac", "ac"),
        "<h1> </h1><h1>z</h1><h2>b</h2><title>t</title>": ("b", ""),
        "<h3>c</h3><title>t</title>": ("c", "t"),
        og + card + "<title>t</title>": ("OG & x", "t"),
        card + "<title> t </title>": ("TW", "t"),
        '<meta property="og:title" content="">' + card + "<title>t</title>": ("t", "t"),
        '<meta property="og:title">' + card: ("last", URL),
        "<title></title>": ("last", URL),
        "<title>a <b>x</b></title>": ("last", URL),
        "nothing": ("last", URL),
        "<header>no</header><!--<h1>no</h1>--><h1 class='x>y'>yes</h1>": ("yes", "yes"),
    }
    rows = [(page, URL) for page in cases]
    assert values(html.extract_title("p", "u"), rows, ["p", "u"]) == [v[0] for v in cases.values()]
    assert values(html.extract_title("p", "u", "v1"), rows, ["p", "u"]) == [
        v[1] for v in cases.values()
    ]
    assert values(html.extract_title("p", "u"), [("", "http://a.com/")], ["p", "u"]) == [
        "http://a.com/"
    ]
    assert values(html.decorate_title("p", "u"), [("t", URL)], ["p", "u"]) == [f"t ({URL})"]


def test_images(values):
    style2 = 'style="max-width:100%;height:auto;"'
    style1 = 'style="max-width:100%;height:auto;margin:5px 0;"'
    cases = {
        "a<img src='x.png'>b": (
            f'a<img src="http://a.com/p/x.png" {style2}/>b',
            f'a<img src="http://a.com/p/x.png" {style1}/>b',
        ),
        '<IMG alt="1 > 0" src="" data-src=/y.png style=z>': (
            f'<img alt="1 &gt; 0" src="http://a.com/y.png" data-src="/y.png" {style2}/>',
            f'<img alt="1 &gt; 0" src="" data-src="/y.png" {style1}/>',
        ),
        "<img data-original='http://o.org/z?a&amp;b'/>": (
            f'<img data-original="http://o.org/z?a&amp;b" src="http://o.org/z?a&amp;b" {style2}/>',
            f'<img data-original="http://o.org/z?a&amp;b" {style1}/>',
        ),
        "<img alt=n>": ('<img alt="n"/>', f'<img alt="n" {style1}/>'),
        "no image": ("no image", "no image"),
    }
    rows = [(c, URL) for c in cases]
    assert values(html.fix_image_urls("c", "u"), rows, ["c", "u"]) == [v[0] for v in cases.values()]
    assert values(html.fix_image_urls("c", "u", "v1"), rows, ["c", "u"]) == [
        v[1] for v in cases.values()
    ]


def test_matches_are_those_of_extraction(values):
    pages = ["", "no tag", "<a><b c='>'>x</a>", "\x01<a>\x02", "<a>\x02<b>", "$1 <a href=\"$0\\\\\"> \\", "<A\n>é😀<b>"]
    pattern = r"(?is)</?[a-z][^>]*+>"
    for fast, plain in zip(
        values(matches("t", pattern), [(p,) for p in pages], ["t"]),
        values(f"regexp_extract_all(t, {text(pattern)}, 0)", [(p,) for p in pages], ["t"]),
    ):
        assert fast == plain


def test_every_character_name_is_known(values):
    names = sorted(html5)
    cases = [f"x&{n} y" for n in names] + [f"&{n}{n}" for n in names[::50]] + ["&zzzzzz;", "&A;", "&AEli"]
    assert values(html.unescape("t"), [(c,) for c in cases], ["t"]) == [html_lib.unescape(c) for c in cases]
