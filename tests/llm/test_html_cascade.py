import random
import re
from collections import Counter

import duckdb

from leadflow.llm import html_text
from leadflow.llm.html_text import page_text


def page(css, body):
    return page_text(f"<style>{css}</style>{body}")


def test_text_of_forms_stays():
    assert page_text("<p>Say <textarea>\none\ntwo  three</textarea> now") == "Say one\ntwo  three now"
    assert page_text("Size <select><option>S<option selected>M<option>L</select> please") == "Size M please"
    assert page_text("<select multiple><optgroup label=x><option>a<option>b</optgroup><option>c</select>") == "a\nb\nc"
    assert page_text("<select></select>x") == "x" and page_text("<datalist><option>a</datalist>x") == "x"


def test_visibility_is_inherited_and_can_come_back():
    assert page_text("<div style='visibility:hidden'>a <b style='visibility:visible'>b</b> c</div>d") == "b\nd"
    assert page("div {visibility: hidden} .v {visibility: visible}", "<div>a<p class=v>b</p><p>c</p></div>") == "b"
    assert page_text("<table><tr><td>a<td style='visibility:hidden'>bbb<td>c<tr style='visibility:collapse'><td>d<tr><td>1<td>2<td>3</table>") == "a |   | c\n1 | 2 | 3"
    assert page_text("<div style='display:none'>a <b style='display:block;visibility:visible'>b</b></div>c") == "c"


def test_cascade():
    for css, shown in (
        (".x{display:none} .x{display:block}", True), (".x{display:block} .x{display:none}", False), ("#i{display:block} .x{display:none}", True), (".x{display:none} p{display:block}", False),
        (".x{display:none !important} #i{display:block}", False), ("div .x{display:none} .x{display:block}", False), ("div p{display:none}", False), ("section p{display:none}", True),
        ("main > p{display:none}", True), ("main > div > p{display:none}", False), ("main div p.x#i{display:none}", False), (".a .x{display:none}", False), ("*{visibility:hidden} p{visibility:visible}", True),
        ("p.x.y{display:none}", True), ("p:hover{display:none}", True), ("main p, q{display:none}", False), ("p{display:none}p{display:none}", False),
    ):
        assert (page(css, "<main><div class=a><p class=x id=i>word</p></div></main>") == "word") is shown, css
    assert page(".x{display:none}", "<p class=x style='display:block'>word") == "word" and page(".x{display:none !important}", "<p class=x style='display:block'>word") == ""
    assert page("[hidden]{color:red}", "<p hidden>a<p hidden style='display:block'>b") == "b"


def test_deep_and_wide_tables():
    assert page_text("<table><tr><td>" * 400 + "x") == "x"
    assert page_text("<table><tr><td colspan=5000>a<td>b<tr><td colspan=1000>1<td>2</table>") == "a | b\n1 | 2"
    assert page_text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a | b\n  | c\n  | d"


def naive_words(markup):
    """Words that show, by asking every rule for every ancestor of every text."""
    builder = html_text.TreeBuilder()
    builder.feed(markup)
    builder.close()
    rules = []
    for order, (names, body) in enumerate(re.findall(r"([^{}]+)\{([^{}]*)\}", html_text._unconditional(" ".join(builder.styles)))):
        for name in names.split(","):
            parts = name.strip().split()
            if parts and all(re.fullmatch(r"[a-z0-9]*(?:[.#][\w-]+)*", p) for p in parts):
                weight = (name.count("#"), name.count("."), sum(p[0] not in ".#" for p in parts))
                rules += [(weight, order, parts, k, v) for k, v in re.findall(r"(display|visibility)\s*:\s*(\w+)", body)]

    def fits(node, part):
        tag, classes, ids = re.match(r"[a-z0-9]*", part)[0], re.findall(r"\.([\w-]+)", part), re.findall(r"#([\w-]+)", part)
        return (not tag or tag == node.tag) and all(c in (node.attrs.get("class") or "").split() for c in classes) and all(i == node.attrs.get("id") for i in ids)

    def matches(node, parts):
        if not fits(node, parts[-1]):
            return False
        return len(parts) == 1 or any(matches(a, parts[:-1]) for a in ancestors(node))

    def ancestors(node):
        while node.parent is not None and node.parent.tag != "#root":
            node = node.parent
            yield node

    def value(node, kind):
        inline = re.findall(rf"{kind}\s*:\s*(\w+)", node.attrs.get("style") or "")
        if inline:
            return inline[-1]
        found = [(w, o, v) for w, o, parts, k, v in rules if k == kind and matches(node, parts)]
        return max(found, key=lambda f: f[:2])[2] if found else ("none" if kind == "display" and "hidden" in node.attrs else "")

    words = Counter()

    def walk(node):
        for c in node.children:
            if not isinstance(c, str):
                walk(c)
                continue
            line = [node, *ancestors(node)]
            if any(n.tag in html_text.HIDDEN or value(n, "display") == "none" or (n.tag == "dialog" and "open" not in n.attrs) for n in line if n.tag != "#root"):
                continue
            seen = next((v for n in line if n.tag != "#root" and (v := value(n, "visibility"))), "visible")
            if seen == "visible":
                words.update(c.split())

    walk(builder.root)
    return words


def shown_words(text):
    return Counter(w for w in re.sub(r"(?m)^\s*(?:(?:-|\d+\.) )+", "", text).split() if w != "|")


def test_pages_have_the_words_that_every_rule_leaves():
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (markup,) in pages:
        got, want = shown_words(page_text(markup)), naive_words(markup)
        loose = {w for w in (got - want) + (want - got)}
        assert all(re.fullmatch(r"[-\d.|]+", w) for w in loose), (loose, markup[:500])  # marks of lists, told from numbers by place only


def test_random_sheets_and_trees():
    rng = random.Random(5)
    for _ in range(300):
        selector = lambda: " ".join(rng.choice(["", "div", "p", "b"]) + rng.choice([".a", ".b", "#i", ".a.b", ""]) or "p" for _ in range(rng.randint(1, 3)))
        css = " ".join(f"{selector()}{{{rng.choice(['display:none', 'display:block', 'visibility:hidden', 'visibility:visible', 'color:red'])}}}" for _ in range(rng.randint(0, 6)))
        n = iter(range(1000))

        def tree(depth):
            tag = rng.choice(["div", "b", "span"])
            attrs = rng.choice(["", " class=a", " class='b a'", " id=i", " style='display:block'", " style='visibility:visible'", " hidden"])
            return f"<{tag}{attrs}> w{next(n)} {''.join(tree(depth + 1) for _ in range(rng.randint(0, 2))) if depth < 4 else ''} w{next(n)} </{tag}>"

        markup = f"<style>{css}</style>{tree(0)}{tree(0)}"
        assert shown_words(page_text(markup)) == naive_words(markup), markup
