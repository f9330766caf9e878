import difflib
import random
import time
from statistics import NormalDist

from textloom.llm import html_extract as h
from textloom.llm import license_scan as ls
from textloom.llm import url_filter as u

PAGES = "page_id long, url string, html string, host string, text string, form string, wrapper string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)


URLS = [
    (1, "https://Blog.Example.ORG/es/5?q=1", "blog.example.org", "/es/5", "example.org/es/", "block"),
    (2, "http://example.org/en/15", "example.org", "/en/15", "example.org/en/1", "block"),
    (3, "http://a.b.org/x#y", "a.b.org", "/x", "org/", "allow"),
    (4, "http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    (5, "http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    (6, "http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    (7, "http://example.org", "example.org", "", None, "allow"),
    (8, "http://x.com/defr", "x.com", "/defr", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "no scheme.org/es/", "", "", None, "allow"),
    (11, "http://É.org?a=http://b/c", "É.org", "", None, "allow"),
    (5, "http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
]


def test_url_rules(spark):
    df = pages(spark, [(k, url, "") for k, url, *_ in URLS])
    empty = spark.createDataFrame([], "url string, bad boolean")
    got = [tuple(r)[:5] for r in u.judge(df, empty).collect()]
    assert sorted(got, key=repr) == sorted([(k, *rest) for k, _, *rest in URLS], key=repr)
    assert u.judge(df.limit(0), empty).count() == 0
    assert {r["verdict"] for r in u.judge(df, empty, rules=()).collect()} == {"allow"}


def test_mined_rules_block_what_labels_say(spark):
    rng = random.Random(2)
    rows = [(f"http://{'spam' if i % 5 == 0 else 'good'}.net/{rng.choice(['a', 'b'])}/{i}{'?utm=1' if rng.random() < 0.3 else ''}", i % 5 == 0 and rng.random() < 0.95) for i in range(400)]
    labelled = spark.createDataFrame(rows + [(None, True), ("http://q.net/", None)], "url string, bad boolean")
    mined = u.mine(labelled)
    found = [set(r["antecedent"]) for r in mined.collect()]
    assert {"host=spam.net"} in found and not any(f > {"host=spam.net"} and len(f) > 3 for f in found)
    test = pages(spark, [(1, "https://www.spam.net/a/1", ""), (2, "https://good.net/a/1", ""), (3, None, "")])
    assert sorted((r["page_id"], r["verdict"]) for r in u.judge(test, labelled).collect()) == [(1, "block"), (2, "allow"), (3, "allow")]
    # brute force: a url is blocked if it has all tokens of a rule
    urls = test.where("url IS NOT NULL").select("url")
    have = {r["url"]: set(r["t"]) for r in urls.select("url", u.tokens(urls["url"]).alias("t")).collect()}
    assert {r["url"] for r in u.fired(urls, mined).collect()} == {x for x, t in have.items() if any(f <= t for f in found)}


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(4)
    urls = [f"http://{rng.choice('ab')}.{rng.choice(['x', 'y'])}/{rng.choice('pqr')}" for _ in range(60)]
    rows = [(x, rng.random() < (0.8 if "a.x" in x or x.endswith("q") else 0.15)) for x in urls] + [(None, True), ("http://a.x/p", False)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    have = {r["url"]: frozenset(r["t"]) for r in labelled.select("url", u.tokens(labelled["url"]).alias("t")).distinct().collect()}
    bad = sum(b for _, b in rows)
    alike = {}
    for t in set().union(*have.values()):
        urls_ = frozenset(x for x, b in rows if b and t in have[x])
        if sum(b for x, b in rows if b and t in have[x]) >= 3:
            alike.setdefault(urls_, []).append((sum(t in have[x] for x, _ in rows), t))
    first = {min(ts)[1] for ts in alike.values()}
    hosts = lambda ts: [t for t in ts if t.startswith("host=")]
    sets = {frozenset(c) for t in have.values() for k in range(1, len(t) + 1) for c in combinations(sorted(t & first), k) if len(hosts(c)) <= 1}
    whole = {frozenset(t for _, t in ts if not t.startswith("host=") or t == max(hosts(u for _, u in ts), key=len)) for ts in alike.values()} - sets
    tested = {f: (sum(f <= have[x] for x, b in rows if b), sum(f <= have[x] for x, _ in rows)) for f in sets | {f for f in whole if len(f) > 1}}
    tested = {f: v for f, v in tested.items() if v[0] >= 3}
    z, found = NormalDist().inv_cdf(1 - 0.025 / len(tested)), {}
    for f, (k, n) in tested.items():
        share = k / n
        if share >= 0.5 and (share + z * z / (2 * n) - z * (share * (1 - share) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) > bad / len(rows):
            found[f] = (k, n, round(share, 9), round(k / len(rows), 9), round(share * len(rows) / bad, 9))
    want = {f: v for f, v in found.items() if not any(o < f and found[o][2] >= v[2] for o in found if f in sets or len(o) == 1)}
    got = {frozenset(r["antecedent"]): (r["bad"], r["total"], *(round(r[c], 9) for c in ("confidence", "support", "lift"))) for r in u.mine(labelled).collect()}
    assert got == want and want


def test_urls_that_share_many_tokens_are_mined_in_little_time(spark):
    import time

    long = "/".join(f"part{i}" for i in range(30))
    rows = [(f"http://bad.net/{long}/x{i}?q{i % 7}=1", True) for i in range(1000)] + [(f"http://good.net/{long.replace('part3', 'other')}/x{i}", False) for i in range(1000)]
    rng = random.Random(3)
    rows += [("http://mix.net/" + "/".join(rng.sample([f"seg{k}" for k in range(40)], 30)), rng.random() < 0.5) for _ in range(300)]
    start = time.time()
    found = [set(r["antecedent"]) for r in u.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()]
    assert time.time() - start < 90
    assert any(len(f) == 1 and f <= {"host=bad.net", "path=part3"} | {f"path=part3{k}" for k in range(10)} for f in found)


def test_urls_of_many_tokens_are_combined_whole(spark, monkeypatch):
    z = 4.5  # whatever number of combinations is counted as tested
    monkeypatch.setattr(u, "limit", lambda tested, chance: z, raising=False)
    rng, rows = random.Random(5), []
    for i in range(300):  # what tells are three tokens that most urls have; of each url the twelve rarest come first
        tell = [t for t in "pqr" if rng.random() < 0.5]
        rows += [("http://w.net/" + "/".join(rng.sample([f"s{k}" for k in range(12)], 10) + tell), rng.random() < (0.97 if len(tell) == 3 else 0.2))] * (3 if i % 50 == 0 else 1)
    rows += [(f"http://w.net/{rng.choice('pqr')}/s{i % 12}", i % 4 == 0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    have = {r["url"]: set(r["t"]) for r in labelled.select("url", u.tokens(labelled["url"]).alias("t")).distinct().collect()}
    covers = {t: sum(1 << i for i, (x, _) in enumerate(rows) if t in have[x]) for t in set().union(*have.values())}
    bad = sum(1 << i for i, (_, b) in enumerate(rows) if b)
    first = {}  # of tokens that the same bad urls have, the one that fits fewest
    for t, c in sorted(covers.items(), key=lambda x: (x[1].bit_count(), x[0])):
        first.setdefault(c & bad, t)
    names = sorted(first.values())
    assert max(len(t & set(names)) for x, t in have.items() if (x, True) in rows) > u.MOST_COMBINED
    fits, best, want = [(1 << len(rows)) - 1], {0: 0.0}, {}  # of every combination, best: the largest confidence of its sound parts
    for m in range(1, 1 << len(names)):
        own = [i for i in range(len(names)) if m >> i & 1]
        fits.append(fits[m & (m - 1)] & covers[names[own[0]]])
        k, n = (fits[m] & bad).bit_count(), fits[m].bit_count()
        if k >= 3:
            best[m] = max(best[m - (1 << i)] for i in own)
            share = k / n
            if share >= 0.5 and share > best[m] and (share + z * z / (2 * n) - z * (share * (1 - share) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) > bad.bit_count() / len(rows):
                best[m], want[frozenset(names[i] for i in own)] = share, (k, n)
    assert {"path=p", "path=q", "path=r"} in map(set, want) and max(map(len, want)) > 4
    assert {frozenset(r["antecedent"]): (r["bad"], r["total"]) for r in u.mine(labelled).collect()} == want


def test_labels_that_say_nothing_give_no_rules(spark):
    rng = random.Random(6)
    rows = [(f"http://{rng.choice('abcdefgh')}.{rng.choice(['com', 'net'])}/{rng.choice('pqrstuvw')}/{rng.choice('xyz')}?{rng.choice('klmn')}=1", rng.random() < 0.4) for _ in range(1500)]
    assert u.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="has-sidebar"><nav><ul><li>Home</ul></nav>'
    '<div id="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One  <b>bold</b>\n text &eacute;&#233;&#xe9;<p><i>Two</i><aside>Side</aside><form>F<button>B</button></form>'
    '<ul><li>Item a<li>Item b</ul><section class="comments"><p>Reader says</p></section><table><tr><td>c1<td>c2</table>tail</article><div class="sidebar">More</div><footer>&copy; x</footer></body></html>'
)


def extract(spark, rows):
    return {r["page_id"]: r for r in h.extract(pages(spark, rows)).collect()}


def test_article_without_the_rest(spark):
    got = extract(spark, [(1, "http://h.x/1", PAGE), (2, "http://h.x/2", None), (3, None, ""), (4, "http://h.x/4", "plain text &lt;b&gt;"), (5, "http://h.x/5", "<article>open <b>end")])
    assert got[1]["text"] == "Head & line\nOne bold text ééé\nTwo\nItem a\nItem b\nc1\nc2\ntail"
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    assert got[4]["text"] == "plain text <b>" and got[5]["text"] == "open end"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert h.extract(pages(spark, [])).count() == 0


def test_template_of_pages_without_article(spark):
    rows = [(i, f"http://t.x/{i}", f"<body><div>Site name</div><div><p>Story {i} is long</p></div><div>All rights</div></body>") for i in range(6)]
    got = extract(spark, rows + [(9, "http://other.x/", "<body><div>Site name</div></body>")])
    assert [got[i]["text"] for i in range(6)] == [f"Story {i} is long" for i in range(6)] and got[9]["text"] == "Site name"


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://one.x/", "<body><p>story</p></body>") for i in range(3)]
    rows += [(10 + i, f"http://near.x/{i}", f"<body><p>The same long story</p><p>and more of it</p><i>{i} May</i></body>") for i in range(4)]
    rows += [(20 + i, f"http://half.x/{i}", f"<body><div>Site</div><p>{'A copied story' if i < 5 else f'The long story {i}'}</p></body>") for i in range(9)]
    got = extract(spark, rows)
    assert [got[i]["text"] for i in range(3)] == ["story"] * 3
    assert [got[10 + i]["text"] for i in range(4)] == [f"The same long story\nand more of it\n{i} May" for i in range(4)]
    assert [got[20 + i]["text"] for i in range(9)] == ["A copied story"] * 5 + [f"The long story {i}" for i in range(5, 9)]


def test_template_inside_articles(spark):
    """Lines that every article of a host has in one place are template; the texts equal those of a plain count per place."""
    rng = random.Random(9)
    rows, wanted = [], {}
    quote = "a passage that several articles quote word for word"
    for k in range(30):
        body = [f"story {k} " + " ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(rng.randint(2, 5))] + ([quote] if k % 3 == 0 else [])
        page = "<body><nav>Menu</nav><article><h1>Title %d</h1><ul><li>Share this story<li>Print</ul>%s<div>Read more on our site</div></article><p>outside</p></body>" % (k, "".join(f"<p>{b}</p>" for b in body))
        rows.append((k, f"http://{'small' if k < 4 else 'h'}.x/{k}", page))
        lines = [f"Title {k}", "Share this story", "Print", *body, "Read more on our site"]
        wanted[k] = "\n".join(lines if k < 4 else [x for x in lines if x not in ("Share this story", "Print", "Read more on our site")])
    got = extract(spark, rows + [(100, "http://h.x/100", rows[10][2])])
    assert {k: r["text"] for k, r in got.items() if k < 100} == wanted
    assert got[100]["text"] == wanted[10]


def test_later_siblings_of_one_kind_keep_their_text(spark):
    rows = [(1, "http://s.x/1", "<article><div><img></div><h1>T</h1><div>Lead text</div></article>"), (2, "http://s.x/2", "<article><p><b><i>x</i></b> and <u>q</u> <b>y</b></p></article>")]
    got = extract(spark, rows)
    assert got[1]["text"] == "T\nLead text" and got[2]["text"] == "x and q y"


def test_long_and_deep_pages(spark):
    deep = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>" + "word " * 200_000 + "</article>"
    got = extract(spark, [(1, "http://d.x/", deep)])
    assert got[1]["text"].startswith("deep\nword word") and got[1]["n_chars"] == 5 + 200_000 * 5 - 1


def test_depth_changes_no_text(spark):
    deep, end = "<div>" * 250, "</div>" * 250
    rows = [
        (1, "http://d1.x/", f"<div id=page><article>{deep}deep{end}<p>rest of the article</p></article></div>"),
        (2, "http://d2.x/", f"<article>{deep}<nav>Menu</nav>kept<form>Form</form>{end}</article>"),
        (3, "http://d3.x/", f"<p>around</p>{deep}<article>story</article>{end}"),
    ]
    got = extract(spark, rows)
    assert [got[i]["text"] for i in (1, 2, 3)] == ["deep\nrest of the article", "kept", "story"]


def test_wrappers_fold_in_rounds(spark, monkeypatch):
    tags, sizes, infer = "p ul ol dl pre table section figure".split(), spark.sparkContext.accumulator(0), h.infer
    pages_ = ["".join(f"<{t}>x</{t}>" for i, t in enumerate(tags) if n >> i & 1) for n in range(1, 256)]
    forms = {h.written(h.form(p)[0]) for p in pages_}

    def counted(frame):
        sizes.add(int(len(frame) > 40))
        return infer(frame)

    monkeypatch.setattr(h, "infer", counted)
    df = spark.createDataFrame([("a", f) for f in forms] + [("b", min(forms))], "host string, form string")
    got = {r["host"]: h.parsed(r["form"]) for r in h.folded(df, 8).collect()}
    assert sizes.value == 0 and set(got) == {"a", "b"}
    assert {k for n in got["a"][2] for k in ([x[0] for x in n[2]] if n[0] == "*" else [n[0]])} == set(tags) and got["b"] == h.parsed(min(forms))


def accepts(wrapper, page):
    """Whether a wrapper, read as an expression, derives a form: brute force over its nodes."""

    def level(items, nodes):
        if not items:
            return not nodes
        kind, optional, inner = items[0]
        if kind == "*":
            k = 0
            while True:
                if level(items[1:], nodes[k:]):
                    return True
                if k == len(nodes) or not any(x[0] == nodes[k][0] and level(x[2], nodes[k][2]) for x in inner):
                    return False
                k += 1
        if nodes and nodes[0][0] == kind and level(inner, nodes[0][2]) and level(items[1:], nodes[1:]):
            return True
        return optional and level(items[1:], nodes)

    return level(wrapper[2], page[2])


def test_wrapper_accepts_its_pages():
    a, b = h.form("<div><p>x</p><p>y</p><section>s</section></div>")[0], h.form("<div><h2>t</h2><p>z</p></div>")[0]
    assert accepts(h.merged([a, b]), a) and accepts(h.merged([a, b]), b)
    rng = random.Random(3)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1) if depth < 3 and t == 'div' else 'x'}</{t}>" for t in (rng.choice(["div", "p", "ul", "h2"]) for _ in range(rng.randint(0, 4))))

    for _ in range(300):
        forms = [h.form(page())[0] for _ in range(rng.randint(1, 5))]
        wrapper = h.merged(forms)
        assert h.parsed(h.written(wrapper)) == wrapper
        assert all(accepts(wrapper, f) for f in forms)


def test_wrapper_decides_on_pages_without_article(spark, monkeypatch):
    """An offer that a third of the pages have has a slot of its own in the wrapper, so it is template; a text by the
    same name in another slot is not."""
    rows = [(i, f"http://w.x/{i}", f"<body><h2>Site</h2>{'<section>Offer</section>' if i % 3 == 0 else ''}<div><p>Story {i}</p><ul><li>Offer</li></ul><p>More of {i}</p></div></body>" if i else "<body><h2>Site</h2><div><p>Offer</p></div></body>") for i in range(10)]
    got = extract(spark, rows)
    assert [got[i]["text"] for i in range(1, 10)] == [f"Story {i}\nMore of {i}" for i in range(1, 10)] and got[0]["text"] == "Offer"
    monkeypatch.setattr(h, "folded", lambda forms: forms.groupBy("host").agg(h.F.lit("").alias("form")))  # a wrapper without slots
    assert extract(spark, rows)[3]["text"] == "Site\nOffer\nStory 3\nOffer\nMore of 3"


def test_two_pages_tell_a_template(spark):
    got = extract(spark, [(i, f"http://two.x/{i}", f"<div>Site</div><p>The whole story {i}</p>") for i in range(2)])
    assert [got[i]["text"] for i in range(2)] == [f"The whole story {i}" for i in range(2)]


def test_broken_and_wide_pages_take_little_time():
    start = time.time()
    for page in ("<a " * 300_000, "<a '" * 100_000 + ">", "<div>" * 200_000, "<" * 500_000, "<!--" * 100_000, "<p title=\"x>kept</p>" * 50_000):
        list(h.blocks(page, None, frozenset()))
        h.parsed(h.written(h.form(page)[0]))
    wide = [h.form("".join(f"<{'p ul ol'.split()[(i * k) % 3]}>x" for i in range(15_000)))[0] for k in (1, 2)]
    assert accepts_flat(h.merged(wide), wide)
    assert time.time() - start < 60


def accepts_flat(wrapper, forms):
    walk = h.Walk(wrapper)
    for f in forms:
        walk.restart()
        assert all(walk.step(n[0]) is not None for n in f[2])
    return True


def test_patience_is_an_alignment():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))]
        got = ls.patience(a, b)
        assert all(a[x] == b[y] for x, y in got)
        assert all(p[0] < n[0] and p[1] < n[1] for p, n in zip(got, got[1:], strict=False))
    assert len(ls.patience(list("abcdef"), list("abcdef"))) == 6
    assert len(ls.common(list("xaybz"), list("ab"), 0, 5, 0, 2)) == 2


def test_license_cases(spark, docs):
    header = ls.TEMPLATES["apache-2.0-header"]
    filler = "nothing of interest here " * 50
    broken = " ".join(w for i, w in enumerate(header.split()) if i % 9)
    data = [(1, "x Released under the MIT License. y"), (2, filler + header + " " + filler), (3, broken), (4, filler), (5, None), (6, ""), (7, "released UNDER the mit license"), (8, "Released under the MIT License. " * 3), (9, "the license of mit")]
    got = sorted((r["doc_id"], r["license"], round(r["coverage"], 2), r["start"]) for r in ls.license_scan(docs(data)).collect())
    assert [g[:2] for g in got] == [(1, "mit-notice"), (2, "apache-2.0-header"), (3, "apache-2.0-header"), (7, "mit-notice"), (8, "mit-notice"), (8, "mit-notice"), (8, "mit-notice")]
    assert got[0][3] == 2 and got[1][2] == 1.0 and 0.8 <= got[2][2] < 1
    assert ls.license_scan(docs([])).count() == 0


def test_templates_as_a_table_and_whole_licenses(spark, docs):
    table = spark.createDataFrame([("own", "alpha beta gamma delta epsilon"), ("none", " "), (None, "x"), ("empty", None)], "license string, text string")
    data = [(1, "say alpha beta gamma delta epsilon now"), (None, "alpha beta gamma delta epsilon"), (2, "word " * 300_000 + ls.TEMPLATES["bsd-3-clause"]), (2, None)]
    assert sorted(((r["doc_id"], r["license"]) for r in ls.license_scan(docs(data), texts=table).collect()), key=repr) == [(1, "own"), (None, "own")]
    assert ls.license_scan(docs(data), texts=table.limit(0)).count() == 0
    got = [(r["doc_id"], r["license"], r["coverage"]) for r in ls.license_scan(docs(data)).collect()]
    assert got == [(2, "bsd-3-clause", 1.0)]
    for name in ("mit", "isc", "zlib", "unlicense", "bsd-2-clause"):
        text = "Copyright (c) 2001 A. Person\n\n" + ls.TEMPLATES[name].replace(". ", ".\n  * ") + "\nint main() {}"
        assert [f["license"] for f in ls.found_in(text, ls.templates())] == [name]
    broken = " ".join(w for i, w in enumerate(ls.TEMPLATES["apache-2.0-header"].split()) if i % 8)
    for text in (broken + " x " + ls.TEMPLATES["apache-2.0-header"], ls.TEMPLATES["apache-2.0-header"] + " x " + broken):
        assert [f["license"] for f in ls.found_in(text, ls.templates())] == ["apache-2.0-header"] * 2


def test_every_copy_of_a_notice_is_a_row():
    known = ls.templates()
    assert len(ls.found_in("aa bb cc Released under the MIT License. x y Released under the MIT License. dd ee", known)) == 2
    texts = {"a": "red green blue pink grey", "b": "one two one three four five six one seven eight"}
    rng = random.Random(11)
    for case in range(300):
        t = ls.templates(texts=texts)[case % 2]
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [rng.choice(["x", "y", *t.words]) for _ in range(rng.randint(0, 6))]
            words += [w for w in t.words if rng.random() < 0.93]
        # brute force: the most stretches without common words that hold enough of the template
        most = [0]
        for end in range(1, len(words) + 1):
            ways = (most[lo] + 1 for lo in range(max(0, end - 2 * len(t.words)), end) if len(ls.common(words[lo:end], t.words, 0, end - lo, 0, len(t.words))) >= t.need)
            most.append(max([most[-1], *ways]))
        found = ls.found_in(" ".join(words), [t])
        assert len(found) == most[-1]
        assert all(f["words"] >= t.need for f in found)


def test_whole_licenses_in_little_time():
    texts = ls.all_templates()
    assert {"apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0"} <= set(texts)
    known = ls.templates()
    took = {}
    for name in ("apache-2.0", "gpl-2.0", "lgpl-2.1", "gpl-3.0", "mpl-2.0"):
        start = time.process_time()
        found = ls.found_in("Copyright X\n" + texts[name] + "\nend", known)
        took[name] = time.process_time() - start
        assert [(f["license"], round(f["coverage"], 3)) for f in found if f["words"] > 600] == [(name, 1.0)]
    gpl = texts["gpl-3.0"]
    assert took["gpl-3.0"] < 3, took
    one = [t for t in known if t.name == "gpl-3.0"]
    start = time.process_time()
    ls.found_in(gpl, one)
    assert time.process_time() - start < 1
    broken = " ".join(w for i, w in enumerate(gpl.split()) if i % 9)
    found = ls.found_in(broken + " between " * 50 + gpl + " word " * 20_000 + broken, one)
    assert [round(f["coverage"], 1) for f in found] == [0.9, 1.0, 0.9]


def test_filter_words_lose_no_license():
    """A text that covers a template has one of its filter words: checked against a plain scan with difflib."""
    rng = random.Random(8)
    known = ls.templates(texts=ls.TEMPLATES)
    for t in known:
        for _ in range(20):
            kept = [w for w in t.words if rng.random() < 0.9]
            match = sum(b.size for b in difflib.SequenceMatcher(None, kept, t.words, False).get_matching_blocks())
            if match >= t.need:
                assert not t.must.isdisjoint(kept)
                assert any(f["license"] == t.name or f["words"] >= match for f in ls.found_in(" ".join(kept), known))
