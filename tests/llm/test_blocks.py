"""Main text: reading of markup, gradients, and held-out pages of other layouts."""

import html
import random

import numpy as np
import pytest

from corpusmill.llm import blocks as B

SCHEMA = "page_id long, url string, html string, text string"


def page(rng, n, layout=0):
    words = lambda k: " ".join("".join(rng.choice(["ti", "on", "er", "st", "&", "é", "ing"]) for _ in range(3)) for _ in range(k))
    paras = [words(rng.randint(3, 40)) for _ in range(rng.randint(1, 8))]
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paras)
    menu = "".join(f"<li><a href='/{k}'>{html.escape(words(1))}</a></li>" for k in range(5))
    head = f"<!DOCTYPE html><html><head><title>{n}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    if layout == 0:
        out = f"{head}<nav><ul>{menu}</ul></nav><!-- ad --><div class='ad'>{html.escape(words(6))}</div><article>{body}</article><footer>&copy; {html.escape(words(5))}</footer>"
    elif layout == 1:
        out = f"{head}<header>{html.escape(words(3))}</header><main>{body}</main><aside>{html.escape(words(9))}</aside><footer>x</footer></body></html>"
    else:
        out = (
            f"{head}<div id='top-nav'>{menu}</div><div class=\"cookie-notice\">{html.escape(words(8))}</div><div class='post-content'>{body}<form><p>join us</p><input></form></div>"
            f"<section id='comments'><p>{html.escape(words(7))}</p></section><div class='sidebar'><p>{html.escape(words(5))}</p></div>"
        )
    return out, " ".join(" ".join(p.split()) for p in paras)


def texts(markup):
    return [b.text for b in B.leaf_blocks(markup)]


def test_reading_of_markup():
    assert texts("<p>a <b>b</b>c&amp;d\n\t e<p>f<br>g") == ["a bc&d e", "f g"]
    assert texts("<div>x<div>y</div>z</div>") == ["x", "y", "z"]
    assert texts("<script>if (a < b) '</p>'</script>t<style>p</style>u<!-- <p>no</p> -->v") == ["tuv"]
    assert texts("a < b and c > d <p title='>'>e") == ["a", "e"] or texts("a < b and c > d <p title='>'>e")[-1] == "e"
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("<p hidden>no</p><div style='display:none'><p>no</p></div>yes") == ["yes"]
    assert texts("<textarea><p>no</textarea>yes<select><option>no</select><button>no</button>") == ["yes"]
    assert texts("") == texts(None) == texts("<p> </p>&nbsp;") == []
    assert texts("&am; &amp &copy; &#233; <i>x</i>&lt;p&gt;") == ["&am; & © é x<p>"]
    assert texts("</p></div>x</article>y") == ["x", "y"]
    assert texts("<p>cut <b") == ["cut"]
    assert [b.path[-1] for b in B.leaf_blocks("<body><div class='Side-bar x1' id=q><p>t")] == [("p",)]
    assert B.leaf_blocks("<div class='Side-bar x1' id=q>t")[0].path == (("div", "side", "bar", "x", "1", "q"),)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in B.fresh_weights().items()}
    x, mask = B.padded([rng.normal(size=(n, B.PATH_SIZE + B.WORD_SIZE + 4)).astype(np.float32) * 0.3 for n in (3, 5)])
    y = (rng.random(mask.shape) < 0.5).astype(np.float32)

    def loss(weights):
        s, _ = B.label_scores(x, mask, weights)
        return float((np.where(mask, np.logaddexp(0, s) - y * s, 0)).sum() / mask.sum())

    grads = B._gradients(x, mask, y, w)
    for name in w:
        at = tuple(int(rng.integers(n)) for n in w[name].shape)
        up, down = ({**w, name: w[name].copy()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - grads[name][at]) < 2e-3, name


@pytest.fixture(scope="module")
def weights():
    rng, r = random.Random(1), np.random.default_rng(2)
    read = [B.leaf_blocks(page(rng, n)[0]) for n in range(120)]
    phrases = [w for b in read for x in b for w in x.text.split()[:3]]
    examples = []
    for b in read:
        labels = [B.taught(x) for x in b]
        examples += [(b, labels), *B.variants(b, labels, r, phrases)]
    return B.train(examples)


@pytest.mark.parametrize("layout,least", [(0, 1.0), (1, 0.9), (2, 0.8)])
def test_pages_not_seen_in_training(weights, layout, least):
    rng = random.Random(50 + layout)
    pages = [page(rng, n, layout) for n in range(60)]
    got = B.main_texts([p for p, _ in pages], weights)
    assert sum(t == want for t, (_, want) in zip(got, pages)) >= least * 60


def test_names_keep_slots_of_their_own():
    names = {*B.SIDE_NAMES, *(n for m in B.MAIN_NAMES for n in B.NAME.findall(m)), *B.MAIN_TAGS, *B.SIDE_TAGS, *B.ENDS_P, "li", "row", "container", "column", "card"}
    assert len({B._slot(n, B.PATH_SIZE) // 2 for n in names}) == len(names)


@pytest.mark.parametrize("main,side", [("article", "cookie"), ("entry", "consent"), ("story", "popup"), ("text", "social"), ("post", "breadcrumbs"), ("article", "tags")])
def test_containers_whose_names_once_met(weights, main, side):
    rng = random.Random(3)
    words = lambda k: " ".join("".join(rng.choice(["ti", "on", "er", "st", "ing"]) for _ in range(3)) for _ in range(k))
    good = 0
    for _ in range(20):
        paras, extra = [words(rng.randint(5, 30)) for _ in range(4)], [words(8) for _ in range(2)]
        open_, close = (f"<{main}>", f"</{main}>") if main == "article" else (f"<div class='{main}'>", "</div>")
        markup = f"<body><div class='{side}'><p>{extra[0]}</p></div>{open_}{''.join(f'<p>{p}</p>' for p in paras)}{close}<div class='{side}'><p>{extra[1]}</p></div></body>"
        good += B.main_texts([markup], weights) == [" ".join(paras)]
    assert good >= 18


def test_late_words_and_far_ancestors_reach_the_vectors():
    early, url = " ".join(f"w{n}" for n in range(40)), "https://host.example/" + "x" * 200
    as_set = lambda block: set(B.vectors([block]).slot.tolist())
    for start in (early, url):
        assert as_set(B.Block((("p",),), f"{start} advert", False)) - as_set(B.Block((("p",),), start, False)) == {B.PATH_SIZE + B._slot("advert", B.WORD_SIZE) // 2}
    deep = lambda tag: B.leaf_blocks(f"<{tag}>{'<div>' * 40}text")
    assert set(B.vectors(deep("aside")).slot.tolist()) != set(B.vectors(deep("article")).slot.tolist())


def test_deeply_nested_pages(weights):
    rng = random.Random(4)
    words = lambda k: " ".join("".join(rng.choice(["ti", "on", "er", "st", "ing"]) for _ in range(3)) for _ in range(k))
    good = 0
    for _ in range(20):
        paras = [words(rng.randint(5, 30)) for _ in range(4)]
        deep = lambda inner: "<div>" * 20 + inner + "</div>" * 20
        markup = f"<body><article>{deep(''.join(f'<p>{p}</p>' for p in paras))}</article><section class=comments>{deep(f'<p>{words(9)}</p><p>{words(20)}</p>')}</section></body>"
        good += B.main_texts([markup], weights) == [" ".join(paras)]
    assert good >= 18


def test_words_at_the_end_of_a_block_decide():
    """Pages told only by a word behind the first eight, and only in blocks behind the first 200."""
    rng = random.Random(6)
    filler = lambda: " ".join(rng.choice(["ti", "on", "er", "st"]) for _ in range(30))

    def made():
        marks = [int(rng.random() < 0.5) for _ in range(12)]
        return [B.Block((("div",),), filler() + (" tale" if m else " advert"), False) for m in marks], marks

    w = B.train([made() for _ in range(120)])
    for blocks, marks in (made() for _ in range(10)):
        x, mask = B.padded([B.vectors(blocks)])
        assert ((B.label_scores(x, mask, w)[0][:, 0] > 0).astype(int) == marks).all()


def test_training_reads_whole_pages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(B, "train", lambda examples: seen.extend(examples) or B.fresh_weights())
    B.fitted(spark.createDataFrame([(1, "u", "<article>" + "".join(f"<p>p{n}</p>" for n in range(1500)) + "</article>", "c")], SCHEMA))
    assert len(seen[0][0]) == len(seen[0][1]) == 1500
    pieces = B.vectors(seen[0][0]).windows(B.WINDOW)
    assert sum(len(rows) for _, rows in pieces) == 1500 and sum(len(rows.at) for _, rows in pieces) == len(B.vectors(seen[0][0]).at)


def test_documents(spark):
    rng = random.Random(9)
    pages = [page(rng, n) for n in range(80)]
    long = "<article>" + "".join(f"<p>paragraph {n} of many</p>" for n in range(3000)) + "</article>"
    rows = [(n, f"u{n}", p, "clash") for n, (p, _) in enumerate(pages)] + [(100, None, None, "c"), (101, "u", "", "c"), (None, "v", pages[3][0], "c"), (3, "u3", pages[3][0], "c"), (102, "w", long, "c")]
    got = B.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["url"]: r["text"] for r in got}
    assert all(by[f"u{n}"] == want for n, (_, want) in enumerate(pages)) and by["v"] == pages[3][1]
    assert by[None] == by["u"] == "" and by["w"].count("paragraph") >= 2900


def test_empty_table(spark):
    assert B.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0
