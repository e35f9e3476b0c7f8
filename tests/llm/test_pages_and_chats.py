"""Pages, archives and conversations."""

import hashlib
from html.parser import HTMLParser

import pytest

from tidemark.llm import arc_convert, chat_render, html_diff


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def extracted(spark, pages):
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text long")
    return {r["page_id"]: r["text"] for r in html_diff.extract(df).collect()}


def test_article_and_chrome(spark):
    body = """<header>H</header><nav><ul><li><a href=x>M</a></li></ul></nav><div class="ad">A</div><article><h1>T &amp; U</h1><p>one  <b>two</b><br>three<p>four
    &eacute;</p><form>F</form><aside>S</aside><script>var x="</p>";</script><!-- c --><div class="sidebar"><p>no</p></div><blockquote>q</blockquote></article>
    <section id="comments"><p>reader</p></section><footer>F</footer>"""
    got = extracted(spark, [(1, "http://h/a", page(body)), (2, "http://h/b", None), (3, None, ""), (4, "nonsense", "plain &lt;b&gt; text")])
    assert got[1] == "T & U\n\none two three\n\nfour é\n\nq"
    assert got[2] == got[3] == ""
    assert got[4] == "plain <b> text"


def test_differencing_where_markup_says_nothing(spark):
    pages = [(k, f"http://h/x/{k}", page(f"<div>Site title</div><p>story {k}</p><p>more {k}</p><div>All rights reserved</div>")) for k in range(6)]
    pages += [(10, "http://other/x/1", page("<div>Site title</div><p>alone</p>")), (11, "http://copy/1", page("<p>same</p>")), (12, "http://copy/2", page("<p>same</p>"))]
    got = extracted(spark, pages)
    assert all(got[k] == f"story {k}\n\nmore {k}" for k in range(6))
    assert got[10] == "Site title\n\nalone" and got[11] == got[12] == "same"


def test_names_of_layouts_and_headlines(spark):
    bodies = [
        ('<div class="layout has-sidebar"><article><p>text</p></article><div class="sidebar">S</div></div>', "text"),
        ('<div class="post comments-open"><article><p>text</p></article><section id="comments"><article>c</article></section></div>', "text"),
        ('<div class="sidebar-left"><div class="menu">M</div><main><p>text</p></main></div>', "text"),
        ('<article><header class="entry-header"><h1>T</h1></header><h2 id="social-history">H</h2><section id="search-methods"><p>text</p></section></article>', "T\n\nH\n\ntext"),
        ('<article><p>text</p><div class="ad-slot">A</div><div class="site-notice">N</div><footer>F</footer></article>', "text"),
        ('<aside><article>A</article></aside><div role="search">S</div><p hidden>x</p><article>text</article>', "text"),
    ]
    got = extracted(spark, [(k, f"http://h{k}/", page(b)) for k, (b, _) in enumerate(bodies)])
    assert got == {k: want for k, (_, want) in enumerate(bodies)}


def test_attributes_are_parsed_and_forms_may_be_frames():
    kept = [
        '<p title="the hidden truth">text</p>', '<p data-id="menu">text</p>', '<div data-role="search">text</div>', "<p data-x='class=\"ad\"'>text</p>",
        '<div title="a > b" data-class=ad>text</div>', '<p alt="aria-hidden=true">text</p>', '<p title="display:none">text</p>',
        '<form id="aspnetForm" action="/x"><div><main><article><p>text</p></article></main></div></form>',
        '<FORM method=post><h1>text</h1></FORM><form><input name=q>F</form>',
        '<article><section class="related-work">text</section></article>', '<article><p class="alert">text</p></article>',
        '<article><div class="notification-systems">text</div></article>', '<article><table class="menu"><tr><td>text</table></article>',
        '<article><section id="ad-hoc-methods">text</section></article>',
    ]
    gone = [
        "<p hidden>no</p>", "<p HIDDEN=hidden>no</p>", "<div aria-hidden = 'true'>no</div>", '<div style="color:red; display : none">no</div>',
        "<div class='x&#32;ad y'>no</div>", "<div id=menu>no</div>", "<div role=search>no</div>", '<form><label>no</label></form><form><h2>no</h2></form>',
        '<article><div class="related-posts">no</div><p class="ad">no</p><div class="alert">no</div><form><h1>no</h1></form></article>',
        '<article><ul class="sponsored"><li>no</ul><section class="comments">no</section></article>', "<aside><form><article>no</article></form></aside>",
    ]
    for body, want in [*((b, ["text"]) for b in kept), *((b, []) for b in gone)]:
        lines, zones = html_diff.text_lines(page(body))
        assert [x for x, z in zip(lines, zones, strict=True) if z != html_diff.CHROME] == want, body
    many = "<form>" * 20_000 + "<h1>text</h1>"
    assert html_diff.text_lines(many)[0] == ["text"]


class Blocks(HTMLParser):
    """A twin of the block extraction, by the standard library's parser: articles of well-formed pages, by one depth counter."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside, self.quiet = [""], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        elif tag in ("script", "style", "form", "aside"):
            self.quiet += 1
        if tag == "br":
            self.handle_data(" ")
        elif tag not in ("b", "a", "i"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i"):
            self.blocks.append("")
        if tag == "article":
            self.inside -= 1
        elif tag in ("script", "style", "form", "aside"):
            self.quiet -= 1

    def handle_data(self, data):
        if self.inside and not self.quiet:
            self.blocks[-1] += data


def by_the_standard_parser(markup):
    parser = Blocks()
    parser.feed(markup)
    parser.close()
    return "\n\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)


def test_whole_pages_equal_a_twin_of_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_diff.extract(pages).collect()}
    assert got == {r["page_id"]: by_the_standard_parser(r["html"] or "") for r in pages.collect()}


def sites(rng, articles: bool):
    """Pages of three hosts with a template each, runs of copies among them, and the text that each should give."""
    pages, want = [], {}
    for host in ("a.example", "b.example", None):
        url = (lambda k, h=host: f"http://{h}/{k // 10}/{k % 10}?q=1") if host else (lambda k: None if k % 2 else "no url")
        for k in range(60):
            body = [f"<p>{host} {n} of page {k if k % 15 > 4 else 0}</p>" for n in range(rng.randrange(1, 5))] if k % 15 in (0, 5) else body if k % 15 < 4 else [f"<p>{host} line {n} of {k}</p>" for n in range(3)]
            inner = "<article>" + "".join(body) + "</article>" if articles else "".join(body)
            top = "".join(f"<div>{host} menu {n}</div>" for n in range(4) if articles is False or n < 2)
            chrome = f"<nav>{k}</nav>" if articles else ""
            i = len(pages)
            pages.append((i, url(k), page(top + chrome + inner + f"<div>All rights of {host}</div>")))
            want[i] = "\n\n".join(x[3:-4] for x in body)
    return pages, want


@pytest.mark.parametrize("articles", [True, False])
def test_differencing_of_whole_sites(spark, articles):
    import random

    pages, want = sites(random.Random(2), articles)
    df = spark.createDataFrame(pages + pages[:3], "page_id long, url string, html string").repartition(4)
    got = html_diff.extract(df).collect()
    assert len(got) == len(pages) + 3
    assert {r["page_id"]: r["text"] for r in got} == want
    # the template's lines went by differencing; without partners they stay
    assert sum(r["n_shared"] for r in got) >= 3 * len(got)
    alone = {r["page_id"]: r["text"] for r in html_diff.extract(df, nearest=0).collect()}
    assert all(alone[k] != want[k] for k in want)


def test_differencing_by_definition(spark):
    import random

    rng = random.Random(4)
    pages = [(k, f"http://h{k % 2}/{rng.randrange(30)}", "".join(f"<p>{rng.choice('abcdefgh')}</p>" for _ in range(rng.randrange(6)))) for k in range(80)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    lines = lambda h: [html_diff._line_hash(x) for x in html_diff.text_lines(h)[0]]
    name = lambda ls: hashlib.sha256(b"".join(x.to_bytes(8, "little", signed=True) for x in ls)).hexdigest()
    for nearest in (1, 2, 5):
        paths = {}
        for _, url, h in pages:
            key = url[7:9], tuple(lines(h))
            paths[key] = min(paths.get(key, "~"), url[9:])
        order = sorted(paths, key=lambda x: (x[0], paths[x], name(x[1])))
        want = {}
        for k, (host, own) in enumerate(order):
            near = order[max(0, k - nearest) : k] + order[k + 1 : k + 1 + nearest]
            want[host, own] = {i for h, other in near if h == host for i in html_diff.shared_lines(list(own), list(other))}
        got = {r["page_id"]: r["text"] for r in html_diff.extract(df, nearest).collect()}
        parsed = {i: html_diff.text_lines(h) for i, _, h in pages}
        assert got == {i: html_diff.kept_lines(*parsed[i], want[url[7:9], tuple(lines(h))])[0] for i, url, h in pages}


def test_pages_without_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text long")
    assert html_diff.extract(none).count() == 0 and arc_convert.convert_pages(none).count() == 0


def naive_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_longest_common_subsequence(monkeypatch):
    import random

    rng = random.Random(5)
    for limit in (1 << 28, 4):
        for _ in range(150):
            a = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
            b = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
            got = html_diff.shared_lines(a, b)
            assert got == sorted(set(got)) and len(got) == naive_lcs(a, b), (a, b, limit)
            at = -1
            for i in got:  # a subsequence of both
                at = b.index(a[i], at + 1)


RESPONSE = b"HTTP/1.0 301 Moved\r\nContent-Type: text/html\r\nX: y\r\n\r\n<p>\nbody\n\n</p>"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    records = [
        ("http://a/x", "20240102030405", "text/html; charset=utf-8", RESPONSE), ("https://b/", "20240102030406", "text/plain", b"no headers"),
        ("dns:a.example", "20240102030407", "text/dns", b"20240102030407\na.example. 3600 IN A 1.2.3.4\n"), ("ftp://c/f", "1999", "x/y", b""), ("http://d/", "20240102030408", "a b c", RESPONSE.replace(b"\r", b"")),
    ]
    data = arc_convert.write_arc(records, version, "f.arc")
    first, *read = arc_convert.read_arc(data, "f.arc")
    assert first.fields["url"] == "filedesc://f.arc"
    assert [(r.fields["url"], r.fields["date"], r.fields["mime"], r.body) for r in read] == records
    assert all(data[r.at :].startswith(r.fields["url"].encode()) for r in read)
    warc = list(arc_convert.read_warc(b"".join(arc_convert.to_warc(r) for r in [first, *read, read[0]])))
    assert [f["WARC-Type"] for f, _ in warc] == ["warcinfo", "response", "resource", "resource", "resource", "response", "response"]
    assert [f["Content-Type"] for f, _ in warc[1:5]] == ["application/http; msgtype=response", "text/plain", "text/dns", "x/y"]
    # the response is as it was: nothing stands before it, and the payload is what follows its own headers
    assert warc[1][1] == RESPONSE and warc[5][1] == RESPONSE.replace(b"\r", b"")
    payload = "sha256:" + hashlib.sha256(b"<p>\nbody\n\n</p>").hexdigest()
    assert warc[1][0]["WARC-Payload-Digest"] == warc[5][0]["WARC-Payload-Digest"] == payload
    assert [f["WARC-Date"] for f, _ in (warc[1], warc[4])] == ["2024-01-02T03:04:05Z", "1999-01-01T00:00:00Z"]
    assert all(f["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(b).hexdigest() and int(f["Content-Length"]) == len(b) for f, b in warc)
    assert len({f["WARC-Record-ID"] for f, _ in warc[:6]}) == 6 and warc[6][0]["WARC-Record-ID"] == warc[1][0]["WARC-Record-ID"]
    with pytest.raises(ValueError):
        list(arc_convert.read_arc(data[:-5]))
    with pytest.raises(ValueError):
        arc_convert.header_fields("http://a 1.2.3.4 20240102030405 5", version)


def test_a_real_file_of_version_1():
    """As crawlers wrote them: the file's description has a header line of version 1, and bodies end in line breaks."""
    about = b"1 0 AlexaInternet\nURL IP-address Archive-date Content-type Archive-length\n"
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello\n"
    data = b"filedesc://IA-1.arc 0.0.0.0 19960923142103 text/plain %d\n%s\n" % (len(about), about) + b"http://www.dryswamp.edu:80/index.html 127.10.100.2 19961104142103 text/html %d\n%s\n\n" % (len(body), body)
    _, record = arc_convert.read_arc(data)
    ((fields, block),) = arc_convert.read_warc(arc_convert.to_warc(record))
    assert (block, fields["WARC-IP-Address"], fields["WARC-Date"]) == (body, "127.10.100.2", "1996-11-04T14:21:03Z")


def test_archives_are_bounded_by_rows_and_bytes(monkeypatch):
    rows = [(k, b"x" * n) for k, n in enumerate([5, 5, 50, 5, 5, 5, 5])]
    monkeypatch.setattr(arc_convert, "BYTES_PER_ARCHIVE", 12)
    assert [[k for k, _ in part] for part in arc_convert._in_archives(iter(rows))] == [[0, 1], [2], [3, 4], [5, 6]]
    monkeypatch.setattr(arc_convert, "ROWS_PER_ARCHIVE", 1)
    assert len(list(arc_convert._in_archives(iter(rows)))) == 7


def test_identifiers_and_references(spark):
    text = "z" * 200
    rows = [(5, "http://a/ b", text), (9, "https://c/", text), (9, "https://c/", text), (2, "http://first/x?y=1#z", text), (2, "http://first/x?y=1#z", text), (None, None, text)]
    got = arc_convert.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len({r["warc_id"] for r in got}) == len(rows)
    uris = {r["uri"] for r in got if r["record_type"] == "response"}
    revisits = [r for r in got if r["record_type"] == "revisit"]
    assert uris == {"http://first/x?y=1#z#page=2"} and len(revisits) == 4
    assert all(r["refers_to_uri"] in uris for r in revisits)


def test_revisits(spark):
    long, short = "x" * 100, "y" * 99
    rows = [(3, "u v", long), (1, None, long), (2, "w", long), (4, "a", short), (5, "b", short), (6, "c", None), (7, "d", ""), (None, "e", long), (1, None, long)]
    got = sorted(map(tuple, arc_convert.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("warc_id", "warc_date", "uri", "refers_to_uri").collect()), key=str)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for i, _, t in rows:
        again = t == long and i != 1
        want.append((i, len(t or ""), digest(t), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)


HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|im_start|>x\n", "", "  spaces  ", "﷐", "<|im_end|>\n"]


def test_escapes_are_reversible():
    for t in HARD:
        assert chat_render.unescape(chat_render.escape(t)) == t
        assert chat_render.unescape_role(chat_render.escape_role("r\\n\n" + t)) == "r\\n\n" + t


def test_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)] + [(2, None, None, None), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns long").repartition(3)
    got = {r["conv_id"]: r for r in chat_render.format_conversations(df).collect()}
    turns = [("assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)]
    learned = "".join(t for r, t in turns if r == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert (got[2]["n_turns"], got[2]["loss_chars"]) == (3, 2)
    assert got[None]["n_turns"] == 1 and not any(r["rewrites_history"] for r in got.values())
    assert chat_render.format_conversations(df.limit(0)).count() == 0


def test_a_template_that_rewrites_history_is_found():
    def shortened(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t[:3]};" for k, (r, t) in enumerate(turns))

    _, spans = chat_render.locate_turns(shortened, [("user", "abcdef"), ("assistant", "ghi")])
    assert [s.rewritten for s in spans] == [False, True]
    output, spans = chat_render.locate_turns(chat_render.marked, [("user", "a"), ("assistant", "b")])
    assert [output[s.text_start : s.text_end] for s in spans] == ["a", "b"] and not any(s.rewritten for s in spans)
