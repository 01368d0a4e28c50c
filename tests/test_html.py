from citelake.functions.html import distinct_blocks, links, shingle_set, title, to_markdown


def test_headings_paragraphs_and_inline_marks():
    page = "<body><h2> A  b </h2><p>x <b>bold</b> <i>it</i> <code>c d</code> <a href=' /u '>link</a><br>next</p></body>"
    assert to_markdown(page) == "## A b\n\nx **bold** *it* `c d` [link](/u) next"


def test_anchor_without_target_or_text_keeps_its_text():
    assert to_markdown("<p><a href=''>only text</a><a href='/x'></a></p>") == "only text"


def test_nested_lists_and_ordinals():
    page = "<ol><li>one<ul><li>in</li></ul></li><li></li><li>two</li></ol>"
    assert to_markdown(page) == "1. one\n  - in\n2. two"


def test_lists_below_other_children_of_an_item_are_not_rendered():
    assert to_markdown("<ul><li>a<div>b<ul><li>lost</li></ul></div></li></ul>") == "- ab"


def test_tables_pad_rows_escape_pipes_and_invent_headers():
    page = "<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>"
    assert to_markdown(page) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    page = "<table><tr><td></td><td> </td></tr><tr><td>1</td><td>2</td></tr></table>"
    assert to_markdown(page).splitlines()[0] == "| col1 | col2 |"
    assert to_markdown(page).splitlines()[2:] == ["|  |  |", "| 1 | 2 |"]


def test_pre_quote_rule_and_loose_text():
    page = "loose<hr><pre> a\n  b </pre><blockquote><p>q1</p><p>q2</p></blockquote><span>s</span>"
    assert to_markdown(page) == "loose\n\n---\n\n```\na\n  b\n```\n\n> q1\n> q2\n\ns"


def test_stripped_and_skipped_elements():
    page = "<body><script>var t='</p>'</script><nav>n</nav><header>h</header><aside>kept</aside><svg><text>no</text></svg></body>"
    assert to_markdown(page) == "kept"


def test_comments_show_unless_turned_off():
    assert to_markdown("<body><!-- ad 0 --><p>x</p></body>") == "ad 0\n\nx"
    assert to_markdown("<body><!-- ad 0 --><p>x</p></body>", keep_comments=False) == "x"


def test_open_paragraphs_are_not_closed_implicitly():
    assert to_markdown("<p><b>a<p>b</p>") == "**ab**"


def test_unknown_end_tags_are_ignored_and_entities_decoded():
    assert to_markdown("<p>a</b> &amp; b</p></div>") == "a & b"


def test_empty_pages():
    assert to_markdown("") == to_markdown(None) == to_markdown("<body> </body>") == ""


def test_repeated_blocks_go_and_short_ones_stay():
    long = "one two three four five six seven eight nine ten"
    assert distinct_blocks([long, "short", long + "", "short", " "]) == [long, "short", "short"]
    assert shingle_set("a b c d") == frozenset()


def test_repeated_blocks_stay_on_request():
    line = "one two three four five six seven eight nine ten"  # with the heading's mark six runs of seven are the same
    page = f"<div class='ad'>{line}</div><h1>{line}</h1><p></p><p>x</p>"
    assert to_markdown(page) == f"{line}\n\nx"
    assert to_markdown(page, repeats=True) == f"{line}\n\n# {line}\n\nx"


def test_links_are_absolute_unique_and_on_the_same_host():
    page = "<a href='/b#x'>1</a><a href='b'>2</a><a href='mailto:x'>3</a><a href='JavaScript:x'>4</a><a href='http://o.org/'>5</a><a href='#t'>6</a>"
    assert links(page, "http://h.org/a/") == ["http://h.org/b", "http://h.org/a/b"]
    assert links(page, "http://h.org/a/", same_host=False)[-1] == "http://o.org/"
    assert links(page, None) == [] and links(None, "http://h.org") == []


def test_title():
    assert title("<head><title> T  x </title></head>") == "T x" and title(None) == ""


def test_references_without_a_semicolon():
    page = "<h1>a&amp;&amp</h1><p>x &lt;y&gt &#65 <a href='/p?a=1&copy=2&amp;b'>&am</a> &</p><!-- &amp -->"
    assert to_markdown(page).startswith("# a&&\n\nx <y> A [&am](/p?a=1")
    assert to_markdown(page, loose=False) == "# a&&amp\n\nx <y&gt &#65 [&am](/p?a=1&copy=2&b) &\n\n&amp"
    assert title("<title>a &quot;b&quot</title>", loose=False) == 'a "b&quot'
