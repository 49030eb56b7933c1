from leadflow.llm.html_text import page_text


def test_text_of_a_row_outside_cells_stays():
    assert page_text("<table><tr>note<td>x</td></tr></table>") == "note\nx"
    assert page_text("<table><tr><form><td>a</td><td>b</td></form></tr></table>") == "a | b"
    assert page_text("<table><tr><td>a</td><div>loose</div></tr></table>") == "loose\na"


def test_rules_for_other_media_do_not_hide():
    page = lambda css: page_text(f"<style>{css}</style><div class=nav>menu</div><p>text</p>")
    for css in ("@media print {.nav {display:none}}", "@media (max-width: 600px) {p {color:red} .nav {display:none}} p {color:blue}", "@import 'x.css'; @supports (a:b) {@media print {.nav {display:none}}}"):
        assert page(css) == "menu\n\ntext"
    for css in (".nav {display:none}", "@media print {p {display:none}} .nav {display:none}", "@media screen {.nav {display:none}}", "@media print, screen {.nav {display:none}}", "@import 'x.css'; .nav {display:none}"):
        assert page(css) == "text"
