import numpy as np

from factline.llm import mainbody as M

HTML = """<html><head><title>En sak om fisk – Nordlaks</title></head><body><div class="t"><div>Nordlaks AS</div><a href="/k">Kontakt</a></div>
<div class="m"><h1>En sak om fisk</h1><p>Fisken svømmer i <b>fjorden</b> hele dagen, og det er mye av den i år også.</p></div>
<div class="s"><h3>Les også</h3><a href="/x">En annen sak som ikke er vår, men som er ganske lang likevel</a></div>
<div class="m"><p>Siste avsnitt om fisken, som heller ikke er helt kort.</p></div>
<div class="f"><p>Vi leverer fisk til hele landet, hver dag, året rundt, uten stans.</p><p>Nordlaks AS – org.nr 979543883</p></div></body></html>"""
TEXT = "Nordlaks AS\nKontakt\n\nEn sak om fisk\nFisken svømmer i fjorden hele dagen, og det er\nmye av den i år også.\nLes også\nEn annen sak som ikke er vår, men som er ganske lang likevel\nSiste avsnitt om fisken, som heller ikke er helt kort.\nVi leverer fisk til hele landet, hver dag, året rundt, uten stans.\nNordlaks AS – org.nr 979543883"
TITLE = "En sak om fisk – Nordlaks"


def lines_of(text, page, title, shares=None, window=M.WINDOW, surge=M.SURGE):
    rows, pieces = M.page_lines("nordlaks.no", title, text, page)
    if not rows:
        return []
    numbers, sizes, edges, links = (np.array(x) for x in zip(*rows))
    share = np.ones(len(rows)) if shares is None else np.array([shares(text.split("\n")[n]) for n in numbers], float)
    return numbers[M.body_of(sizes.astype(float), share, edges.astype(bool), links.astype(bool), window, surge)].tolist()


def alien(line):
    return 0.1 if line in ("Nordlaks AS", "Kontakt", "Les også") or "979543883" in line or "uten stans" in line else 1.0


def test_windows_bound_the_body_and_links_are_left_out():
    assert lines_of(TEXT, HTML, TITLE, alien) == [3, 4, 5]
    assert lines_of(TEXT, None, TITLE, alien) == [3, 4, 5, 6, 7, 8]  # without markup nobody tells the teaser's link


def test_the_result_depends_on_window_and_surge():
    assert lines_of(TEXT, HTML, TITLE, alien, surge=1e9) == []
    assert lines_of(TEXT, HTML, TITLE, alien, window=1) == []
    assert 10 in lines_of(TEXT, HTML, TITLE, None, surge=1)


def test_forms_of_pieces():
    own = M._own_words("nordlaks-fisk.no", "En sak – Nordlaks")
    assert M.form_of("© 2024 Nordlaks Fisk AS", own) == "© # @ as"
    assert M.form_of("Tlf. 12 34 56 78", own) == "tlf. #" and M.form_of("Laget i Sør Odal", own) == "laget i ^"


def test_who_tells_what():
    rows, pieces = M.page_lines("nordlaks.no", TITLE, TEXT, HTML)
    assert [says for _, _, _, says in pieces] == [-1, -1, 1, 1, -1, -1, 1, -1, -1]
    assert all(says == 0 for *_, says in M.page_lines("nordlaks.no", TITLE, TEXT, None)[1])


def test_nothing_to_find():
    assert lines_of("Avvis\nGodta alle\n\n", None, None) == []
    assert lines_of(" \n", None, None) == []
    assert lines_of("Kontakt\nMeny", "<html><a>Kontakt</a><a>Meny</a></html>", "X – Y") == []


def test_markup_that_isnt_well_formed():
    for page in ("<p", "<div><p>x</a></div></div></div>", "</p></p>", "<script>x", "<!-- ", "&#x;&amp", "<div class=x><div>" * 3000):
        M.strip_markup(page)
        assert isinstance(lines_of("x" * 100, page, None), list)


def test_long_pages_take_no_quadratic_time():
    import time

    start = time.time()
    for piece in ("<script>", "<!-- ", "<a ", "<div class=x>", "<p>x", "</div>", "<head>", "x < y ", "«"):
        M.strip_markup(piece * 60_000)
    lines_of("ord " * 300_000, None, "ord – " * 100_000)
    lines_of("x" + " " * 300_000 + "x" + "." * 300_000 + "x", None, None)
    lines_of("en linje\n" * 30_000, "<p>en linje</p>" * 30_000, None)
    assert time.time() - start < 60


def test_footer_text_that_a_host_repeats(spark):
    promo = "Vi leverer fisk til hele landet, hver dag, året rundt, uten stans."
    rows = []
    for i in range(6):
        head = f"En lang sak om {('torsk', 'hyse', 'sei', 'laks', 'sild', 'uer')[i]} i havet"
        body = f"Dette er en ganske lang tekst om {('torsk', 'hyse', 'sei', 'laks', 'sild', 'uer')[i]}, som bare finnes på denne siden."
        text = f"Nordlaks\n{head}\n{body}\n{promo}\n© 2024 Nordlaks AS"
        html = "".join(f"<div>{x}</div>" for x in (text.split("\n")[0],)) + f"<h1>{head}</h1><div>{body}</div><div>{promo}</div><div>© 2024 Nordlaks AS</div>"
        rows += [(i, "n.no", html, text, f"{head} – Nordlaks", 7)] * (1 + i % 2)
    rows += [(90, "n.no", None, None, None, 7), (91, "n.no", None, "", None, 7), (92, None, None, "A" * 100, None, 7), (None, "n.no", None, "x" * 100, None, 7)]
    df = spark.createDataFrame(rows, "page_id long, host string, html string, text string, title string, kept int")
    got = M.main_body(df).collect()
    assert sorted(tuple(r) for r in got if r.page_id < 90) == [(i, n) for i in range(6) for n in (1, 2)]
    assert len(got) == len(set(got)) and M.main_body(df.limit(0)).count() == 0
