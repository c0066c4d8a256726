"""Quality, HTML, personal data and chat."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import chat, pii, quality
from tessella.llm.html_extract import blocks, extract, extract_html, tree

GOOD = "The river rose over night, and the people of the town moved their boats. Nobody was hurt in the end."


def junk(rng):
    return " ".join(rng.choice(["BUY!!", "NOW!!", "free***", "click$$$", "|", "win###"]) for _ in range(30))


def test_quality(spark, awkward, nothing):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.sample(GOOD.split(), 15)) if k % 3 else junk(rng), "x") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(bool(k % 3)), 9) for k in range(200)] + [(7, None, 9), (None, 1, 9)], "doc_id long, quality int, text int")
    model = quality.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df.select("doc_id", "text"), model).collect()}
    assert all((got[k] >= 0.5) == bool(k % 3) for k in range(300))
    assert sorted(r["doc_id"] for r in quality.accepted(df, model).collect()) == [k for k in range(300) if k % 3]
    rows = quality.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    again = quality.train(df.repartition(7), labels)
    assert np.allclose(again.weights, model.weights)
    assert quality.score(nothing, model).collect() == []
    assert quality.train(nothing, labels).score(["a", None]).tolist() == [0.5, 0.5]
    assert quality.Model().fit(quality.features(["a", "b"]), np.array([1, 1])).score([""])[0] == pytest.approx(0.75)


def test_quality_of_the_query(spark):
    # the contract's split, scores of all rows, and accuracy on documents that training never saw
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    rows = quality.op5_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    right = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(right) > 500 and np.mean(right) > 0.98


def test_quality_bound_with_repeated_ids(spark):
    # null labels, several labels of an id, and an id that repeats in docs: never more rows than the bound
    docs = spark.createDataFrame([(k % 3 if k < 300 else k, f"text {'!' * (k % 7)} number {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (2, 0), (None, 1)] + [(k, k % 2) for k in range(300, 400)], "doc_id long, quality int")
    shapes = []
    fit = quality.Model.fit

    class Seen(quality.Model):
        def fit(self, x, y, **more):
            shapes.append(len(y))
            return fit(self, x, y, **more)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "Model", Seen)
        quality.train(docs, labels, max_train=50)
        quality.train(docs, labels, max_train=10_000)
    assert shapes[0] == 50 and shapes[1] == 100 + 100 + 100 + 100


PAGES = {
    '<html><head><title>T</title><style>p{}</style></head><body><nav><a href=1>menu</a></nav><article><h1>Head</h1><p>One, two &amp;\n three&nbsp;four<p><b>Bold<br>line<p>x</article><footer>foot</footer></body></html>': "Head\nOne, two & three four\nBold line\nx",
    '<div class="menu"><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></div><div id=content><h1>Hi</h1><p>Some words, more words, and yet more words to read here.<p>Three<div class="comments"><p>Nice, very, nice, lots, of, commas</div></div><aside>side</aside>': "Hi\nSome words, more words, and yet more words to read here.\nThree",
    "<main><form><p>Sign up, now, please, do</p></form><p>Text<script>var a = '<p>no</p>';</script> goes on</p><!-- <p>no --></main><div class=cookie-notice>We use cookies, really</div>": "Text goes on",
    "<p>a < b &lt; c &#x41;&eacute; &unknown; </p>": "a < b < c Aé &unknown;",
    "": "", "<div>": "", "plain": "plain",
    "<ul><li>one<li>two</ul>": "one\ntwo",
    '<div class="post-content no-sidebar widgets"><p>Kept, of course, all of it.</p><div class="article-comments"><p>Gone</p></div><p class="notice">Gone too</p></div>': "Kept, of course, all of it.",
}


def test_html(spark):
    for page, text in PAGES.items():
        assert extract(page) == text, page
    assert extract("<div>" * 30_000 + "deep" + "</div>") == "deep"
    rows = [(k, "u", p, "x") for k, p in enumerate([*PAGES, None, *PAGES])]
    got = {r["page_id"]: r for r in extract_html(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(got) == len(rows) and got[0]["text"] == PAGES[next(iter(PAGES))] and got[len(PAGES)]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values())


LONG = "A first clause, a second clause, and a third, which goes on, and on, until there are enough words, commas, and letters for a paragraph of prose."
#: Pages whose furniture has no telling names: only points and link density find the text.
SCORED = {
    # no article element: boxes of teasers and links beside the content
    f"<body><div><p>Teaser one</p><a href=1>more</a></div><div><h1>T</h1><p>{LONG}<p>{LONG}</div><div><p>Short, stray.</p></div></body>": f"T\n{LONG}\n{LONG}",
    # the text stands outside the only article, which is a teaser
    f"<body><div><article><p>Read next</p></article></div><div><p>{LONG}<p>{LONG}<p>{LONG}</div></body>": f"{LONG}\n{LONG}\n{LONG}",
    # nested articles: the inner ones are a teaser and a reader's comment
    f'<article><h1>T</h1><div><p>{LONG}<p>{LONG}</div><article><p>Next</p></article><article class="comment"><p>{LONG}</p></article><p>End.</article>': f"T\n{LONG}\n{LONG}\nEnd.",
    # siblings heavy with links, inside the article and outside
    f"<main><article><p>{LONG}</p><div>See <a>one thing</a> <a>another thing</a> <a>a third</a></div></article><div><p><a>x</a> <a>y</a> <a>z</a></div></main>": LONG,
    # sections of one article stay together, whatever their length, with captions and lists
    f"<article><section><h2>A</h2><p>{LONG}<p>{LONG}<p>{LONG}</section><section><h2>B</h2><p>Tiny</section><figure><figcaption>Cap</figcaption></figure><ul><li>one<li>two</ul></article><div><p>Bye</div>": f"A\n{LONG}\n{LONG}\n{LONG}\nB\nTiny\nCap\none\ntwo",
    # the same text split over two articles
    f"<div><article><p>{LONG}</article><article><p>{LONG}</article><article><p>No</article></div>": f"{LONG}\n{LONG}",
}


#: Text that is split over containers.
SPLIT = {
    f"<div><div><p>{LONG}</p></div><div><h2>Sub</h2></div><div><p>{LONG}</p></div></div>": f"{LONG}\nSub\n{LONG}",
    f'<div><div class="row"><div><p>{LONG}</p></div></div><div class="row"><div><p>{LONG}</p></div></div></div>': f"{LONG}\n{LONG}",
    f"<table><tr><td>{LONG}</td></tr><tr><td>{LONG}</td></tr></table>": f"{LONG}\n{LONG}",
    f"<body><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><div><div><div><p>{LONG}<p>{LONG}</div></div><div><div><p>{LONG}</div></div></div><div>Imprint</div></body>": f"{LONG}\n{LONG}\n{LONG}",
}


def test_html_split_text():
    for page, text in SPLIT.items():
        assert extract(page) == text, page


def _random_page(rng):
    """A page without telling names, and its article: sections in wrappers, among boxes of links and teasers."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice([", ", ". "])
    text, sections = [], []
    for k in range(rng.randint(1, 5)):
        own = [f"Heading {k} {rng.random():.6f}"] * rng.randint(0, 1) + [f"{rng.random():.6f} " + "".join(sentence(rng.randint(4, 12)) for _ in range(rng.randint(4, 12))).strip() for _ in range(rng.randint(1, 4))]
        text += own
        body = "".join(f"<h2>{x}</h2>" if x.startswith("Heading") else f"<p>{x}</p>" for x in own)
        wrap = rng.randint(0, 2)
        sections.append("<div>" * wrap + f"<section>{body}</section>" + "</div>" * wrap)
    links = lambda n: "<div>" + "".join(f"<a href={k}>{rng.choice(words)} {rng.choice(words)}</a> " for k in range(n)) + "</div>"
    teaser = lambda: f"<div><span>{rng.choice(words)} {rng.choice(words)}</span><a href=1>{rng.choice(words)}</a></div>"
    outer = rng.randint(1, 2)
    around = [links(rng.randint(3, 9)), teaser(), links(4)]
    rng.shuffle(around)
    return "<html><body>" + around[0] + "<div>" * outer + "".join(sections) + "</div>" * outer + around[1] + around[2] + "</body></html>", text


def test_html_random_pages():
    rng = random.Random(8)
    found = wanted = right = 0
    for _ in range(300):
        page, text = _random_page(rng)
        got = extract(page).split("\n")
        found, wanted, right = found + len(got), wanted + len(text), right + len(set(got) & set(text))
    assert right / wanted > 0.99 and right / found > 0.99, (right / wanted, right / found)


def test_html_points_choose(spark):
    for page, text in SCORED.items():
        assert extract(page) == text, page
        printed = "\n".join(blocks([tree(page)]))  # all that no tag and no name marks as furniture
        assert printed != text, page
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert extract_html(empty).collect() == []
    odd = extract_html(spark.createDataFrame([(None, None, "<p>x", 1, "m"), (None, None, "<p>x", 1, "m")], "page_id long, url string, html string, n_chars int, text string")).collect()
    assert [tuple(r) for r in odd] == [(None, None, "x", 1)] * 2


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

AT_RUN = {"ip": "(?<![0-9])", "email": "(?<![A-Za-z0-9._%+-])"}  # in these long texts nothing starts inside a run: saves the plain patterns a quadratic search


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return True


def test_pii_base(spark, awkward, nothing):
    rng = random.Random(1)
    parts = [*"a1 .@-+()_%", "12", "4111111111111111", "a@b.c", "1.2.3.4", "+1 (555) 555-1234", "é", "😀", "..", "\n"]
    docs = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for k in range(1500)]
    docs += [(5000 + k, r["text"] or "") for k, r in enumerate(awkward.collect())]
    got = pii.find_pii(spark.createDataFrame([(k, t, "n") for k, t in docs], "doc_id long, text string, n_email string")).collect()
    text = dict(docs)
    for r in got:
        want = sorted((m.start(), i, m.end()) for i, (kind, p) in enumerate(BASE) for m in re.finditer((AT_RUN if len(text[r["doc_id"]]) > 9999 else {}).get(kind, "") + p, text[r["doc_id"]]) if fits(kind, m[0]))
        said = ",".join(f"{BASE[i][0]}:{a}:{b}" for a, i, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[1] == i for x in want) for i in range(4)]
    rows = pii.find_pii(awkward).collect()
    assert len(rows) == awkward.count() and pii.find_pii(nothing).collect() == []
    assert pii.sanitised(awkward).count() == awkward.count() and pii.sanitised(awkward).columns == awkward.columns


def test_pii_terms(spark):
    docs = [(k, f"Contact agent Zorblax at boss@corp.example now {k} times") for k in range(30)]
    docs += [(100 + k, f"plain contact {k} and agent talk at now times") for k in range(100)] + [(300, "We saw Zorblax, there.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert got[0] == "term:14:21,email:25:42" and got[300] == "term:7:14" and got[101] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert clean[300] == "We saw , there." and "[EMAIL]" in clean[0] and clean[101] == docs[31][1]


def disclosed(docs):
    """Terms that disclose an entity, by counting: each mention's context, its entities, its words."""
    n, near, docs_of, contexts, df = len(set(docs)), {}, {}, {}, {}
    words = lambda t: {w for w in re.split(r"[^0-9A-Za-z\u0080-\U0010ffff]+", t.lower()) if len(w) >= 3 and not re.fullmatch("[0-9]+", w)}
    for doc in set(docs):
        for w in words(doc[1]):
            df.setdefault(w, set()).add(doc)
        for kind, (_, pattern) in enumerate(BASE):
            for m in re.finditer(pattern, doc[1]):
                if not fits(BASE[kind][0], m[0]):
                    continue
                d = re.sub("[^0-9]", "", m[0])
                pool = [m[0].lower().rpartition("@")[2], ".".join(m[0].split(".")[:2]), d[:6], d[:4]][kind]
                before, after = doc[1][max(0, m.start() - pii.CONTEXT) : m.start()], doc[1][m.end() : m.end() + pii.CONTEXT]
                before = re.sub(r"^\S+", "", before) if m.start() > pii.CONTEXT else before
                after = re.sub(r"\S+$", "", after) if len(after) == pii.CONTEXT else after
                around = re.sub(r"[^\s@]*@\S*", " ", f"{before} {after}")
                for c in ((kind, "value", m[0].lower() if kind < 2 else d), (kind, "pool", pool), (kind,)):
                    docs_of.setdefault(c, set()).add(doc)
                    for w in words(around):
                        near.setdefault((c, w), set()).add(doc)
                        contexts.setdefault((c, w), set()).add(around)
    out = set()
    for (c, w), own in near.items():
        k, m, z, n_c = len(own), len(df[w]), pii.Z, len(docs_of[c])
        p = k / m
        low = (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)
        if len(contexts[c, w]) >= pii.SUPPORT and n_c < n and low >= pii.POSTERIOR and math.log(low * n / n_c) >= pii.DISCLOSURE * math.log(n / n_c):
            out.add(w)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pii_terms_of_pooled_entities(spark, awkward, seed):
    # entities whose values all differ: staff of one mail domain behind a code name, a network behind a host name; clean documents share all other words
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(150)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, prose(rng.randrange(4, 60))) for k in range(700)]
    docs += [(1000 + k, f"{prose(rng.randrange(9))} Nightjar {prose(2)} p{k}@corp.example {prose(rng.randrange(20))}") for k in range(25)]
    docs += [(2000 + k, f"{prose(rng.randrange(9))} 10.7.{k}.9 of Ötzi-7 {prose(5)}") for k in range(9)]
    docs += [(3000 + k, f"{prose(3)} +1 (555) 010-{1000 + k} {prose(3)}") for k in range(20)]
    docs += [(4000, f"they saw nightjar {prose(3)}"), (4001, "ötzi slept"), (4002, "nightjar@else.example")]
    docs += [(5000 + k, r["text"] or "") for k, r in enumerate(awkward.where("length(text) < 1000").collect())]
    want = disclosed(docs)
    assert {"nightjar", "ötzi"} <= want
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {(r["doc_id"], r["h"]): r for r in pii.with_spans(df).collect()}
    got, text = {}, {}
    for (doc, _), r in rows.items():
        got[doc] = sorted((x["start"], x["stop"]) for x in r["terms"])
    for doc, t in docs:
        base = [m.span() for kind, p in BASE for m in re.finditer(p, t) if fits(kind, m[0])]
        places = [m.span() for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", t) if m[0].lower() in want]
        text[doc] = [x for x in places if not any(x[0] < b and a < x[1] for a, b in base)]
    assert got == text
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert all(clean[k] == t for k, t in docs if k < 700) and "nightjar" not in clean[4000] and "Nightjar" not in clean[1000] and "[EMAIL]" in clean[1000] and clean[4002] == "[EMAIL]"


def test_pii_columns_with_clashing_names(spark):
    rows = [(1, "a@b.co x", 9, "s", "t", "o", 8), (None, None, None, None, None, None, None), (2, "plain", 5, "s", "t", "o", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, spans string, terms string, own string, n_chars long")
    got = pii.sanitised(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "[EMAIL] x", 9, "s", "t", "o", 9), rows[1], rows[2]], key=str)
    assert pii.find_pii(df).count() == 3


def test_chat(spark):
    texts = ["hi", None, "", "</s>[INST] ok [/INST]", "\\", "\\[INST]\\\\", "<<SYS>", "[", "é😀\n", "[/ROLE][TEXT]"]
    rows = [(c, k, ("user", "assistant", "system", "tool[INST]", None)[(c + k) % 5], texts[(c * 3 + k) % len(texts)], "m") for c in range(12) for k in range(c % 7)]
    rows += [(None, 0, "user", "x", "m"), (50, 1, "user", "same", "m"), (50, 1, "user", "same", "m"), (50, None, "system", "first", "m")]
    events = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string, formatted string")
    rendered = chat.render(chat.fold(events.select("conv_id", "seq", "role", "text")))
    got = {r["conv_id"]: r for r in chat.digests(rendered).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]), r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = "".join(r["formatted"] for r in rendered.where("conv_id = 6").orderBy("pos").collect())
    assert [t for _, t, _ in chat.parse(whole)] == [r[3] or "" for r in rows if r[0] == 6]
    assert chat.digests(chat.render(chat.fold(events.limit(0)))).collect() == []


def test_chat_events(spark):
    log = [
        (1, 0, "message", None, "user", "Q"), (1, 1, "message", None, "assistant", "A"), (1, 2, "delta", None, None, "B"), (1, 3, "delta", 1, None, "C"), (1, 4, "edit", 0, None, "Q2"),
        (1, 5, "regenerate", 1, None, None), (1, 6, "message", None, "assistant", "new"), (1, 7, "delta", None, None, "!"), (1, 8, "delta", 99, None, "lost"), (1, 9, "edit", 6, None, "newer"), (1, 10, "delta", 6, None, "?"),
    ]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, event string, target long, role string, text string")).orderBy("pos").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "Q2"), ("assistant", "newer?")]
