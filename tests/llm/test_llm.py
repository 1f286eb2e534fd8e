"""Training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from isoqt.llm import bpe, decontamination, html_extraction, language_id, near_dedup, pii, quality_rules, secret_scans, sharding, url_filters

PROSE = "the cat and the dog went to that old house of stone with a small red door in it for " * 2
TEXTS = [None, "", " \n\t ", "one", PROSE, PROSE, PROSE + "end", "the x | y # z " * 9, "ABC déjà vu 😀 " * 5, "the " + "w" * 3000 + " and of", "a b\na b\n\nc d\na b",
         " ".join(f"word{i} the and" for i in range(700))]
#: Extra columns whose names clash with those the operators make.
SCHEMA = "doc_id long, text string, key string, h long, words int, n_chars int, row string, node string, lang string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, "k", i, 1, None if t is None else len(t), "r", "n", "en") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, PROSE, None, None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id > 99").select(*docs.columns)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(docs, empty):
    rows = quality_rules.measure(docs).collect()
    assert len(rows) == docs.count() and quality_rules.measure(empty).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        text, w = texts[r.doc_id] or "", words(texts[r.doc_id])
        lines = [x for x in text.split("\n") if words(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.keep(docs).columns == docs.columns


def test_near_dedup_brute_force(spark, docs, empty):
    def shingles(text):
        w = words((text or "").lower())
        return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()

    base = [f"w{i}" for i in range(60)]
    made = [(100 + k, " ".join(base[:k] + ["x"] + base[k + 1 :]) if k else " ".join(base)) for k in range(0, 60, 3)]
    made += [(200 + k, " ".join(f"z{j if j % 30 else (j, k)}" for j in range(90))) for k in range(40)]
    all_docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    sets = {r.doc_id: shingles(r.text) for r in all_docs.collect()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    for leaf in (128, 4):  # small leaves: branches and blocks are used
        got = near_dedup.components(all_docs, leaf=leaf).collect()
        assert len(got) == all_docs.count()
        assert {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in got} == {(i, root[i], len(sets[i]), root[i] == i) for i in sets}
    assert near_dedup.components(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect())[4] == 1 and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 4, None}


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, digits(s)[::-1]))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(m[0])]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii(spark, docs, empty, tmp_path):
    odd = ["a@b.c-d@e.f g..h@i.j..k@l.m n@o.", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.4 1.2.3.4444", "4111-1111 1111  1111 4111 1111 1111 1111 5 4111111111111111-",
           "+1 (504) 555-2652. +1-1 +123456789012345678 +44 20 7946 0958)", "@" * 500 + "1" * 900 + " 1" * 3000 + "a." * 900 + "@x.y", "é+1 555 123 45678é𝔘a@b.co " * 3]
    odd += [f"please call customer {k}00{k}-77{k} or mail x{k}@y.org" for k in range(3)] + [f"reach member {4111111111111111} and member AB{k}9981" for k in range(8)]
    spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/odd")
    both = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{tmp_path}/odd"))
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    got = pii.scan(both).collect()
    assert len(got) == both.count() and pii.scan(empty).count() == 0
    for r in got:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(k + ":") for k in pii.KINDS)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert {r.doc_id: r.text for r in clean.collect()}[5] == PROSE
    shown = {r.doc_id: r.text for r in pii.redact(both).collect()}
    assert shown[103] == "<phone>. +1-1 +123456789012345678 <phone>)" and shown[0] is None


def test_context_patterns_find_unseen(spark):
    seeds = [("member", str(4000 + i), True) for i in range(20)]
    edges = spark.createDataFrame(seeds + [("member", "X-1", False), ("version", "2.0", False), ("version", "1.1", True)], "pattern string, instance string, seed boolean")
    assert [tuple(r) for r in pii.rank(edges).collect()] == [("member", "X-1")]


def test_decontamination(spark, docs, empty, tmp_path):
    item = "Tom has 12 apples and gives 5 apples to Mary so how many kg of apples weighing 3 kg each does Tom still have in the end"
    other = item.replace("12", "40").replace("5", "7").replace("Tom", "Peter").replace("3 kg", "9 kg")
    broken = item.replace("does Tom still", "does Peter still").replace("gives 5 apples", "gives 5 apples")
    plain = "nothing here is of any use to a reader who looks for the answer to questions of this kind at all"
    rows = [(1, f"before {item} after"), (2, f"x {other.upper()} y"), (3, f"so {broken}"), (4, plain), (5, None), (6, ""), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short")], "item_id long, text string")
    made = spark.read.parquet(f"{tmp_path}/d")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(made, bench).collect()} == {(1, 7), (2, 7)}
    assert sorted(r.doc_id for r in decontamination.remove(made, bench).collect()) == [3, 4, 5, 6, 6]
    assert decontamination.remove(docs, bench).columns == docs.columns and decontamination.remove(docs, bench).count() == docs.count()
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.remove(docs, bench.limit(0)).count() == docs.count()


def flagged(spark, tmp_path, texts, items):
    """(text number, item number) pairs that are contaminated."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.read.parquet(f"{tmp_path}/d"), bench).collect()}


def test_decontamination_alignments(spark, tmp_path):
    line = "a farmer sells {} baskets of ripe pears at the market each"
    twice = f"{line.format(4)} monday and then {line.format(9)} sunday so count them"
    item = "a train leaves the old station with 30 people and reaches the next town after 5 hours where 5 more people wait in the cold"
    other = item.replace("30", "70").replace("after 5", "after 7").replace("5 more", "9 more")
    tom = "Tom walks 12 miles to the big red house on the hill and after a rest there Tom walks back to the town by night"
    broken = tom.replace("there Tom", "there Peter")
    texts = [f"see {twice} ok", f"see {item} then {other} ok", other, f"{item} {'so it goes on ' * 40} reaches the next town after 8 hours where 6 more people wait",
             f"{tom} or {tom.replace('Tom', 'Mary').replace('12', '3')}", broken, f"{broken} and {broken}"]
    assert flagged(spark, tmp_path, texts, [twice, item, tom]) == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 2)}


def test_decontamination_heavy_short_and_named_items(spark, tmp_path):
    table = "3 4 12 7 8 56 9 9 81 6 7 42 5 5 25"
    question = "who painted the last supper"
    named = "Then Zoltan buys seven red pens for Ilka and after that Zoltan gives two of the pens to a friend of Ilka at the old school"
    new = named.replace("Zoltan", "Priya").replace("Ilka", "Oscar")
    mixed = new.replace("friend of Oscar", "friend of Maud").replace("that Priya", "that Oscar")
    texts = [f"the table {table} is here", f"{table[:-2]}26 {table.replace('1', '2')[::-1]}", f"many ask {question} and when it was", new, mixed, named.lower(), named.upper(), "a single word here", "single", "Bob has 7 apples"]
    assert flagged(spark, tmp_path, texts, [table, question, named, "single", "Tom has 5 apples"]) == {(0, 0), (1, 0), (2, 1), (3, 2), (5, 2), (6, 2), (8, 3), (9, 4)}


def test_bpe_round_trip(docs, empty):
    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = bpe.tokenize(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == docs.count() and bpe.tokenize(empty, path, public_tokenizers.PATTERN).count() == 0
    for r in got:
        assert r.ids == own.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_sharding(docs, empty):
    rows = sharding.place(docs, shards=3).collect()
    assert len(rows) == docs.count() and sharding.place(empty).count() == 0
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in ordered] == sorted([r.doc_id for r in rows], key=lambda d: (d is not None, d))
    assert all([r.slot for r in ordered if r.shard == s] == list(range(sum(r.shard == s for r in rows))) for s in {r.shard for r in rows})
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.grown_shard is None and r.law == "bytes" for r in rows)


def test_html(spark):
    page = ('<body><header>top</header><div class="cookie-notice">x</div><article><header><h1>T &amp; U</h1></header><p>a<br>b &nbsp; c<b>d</b>e<ul><li>one<li>two</ul>'
            '<aside>q</aside></article><section id=comments><article>bad</article></section><script>"</p>"</script>tail')
    rows = [(1, "http://a.com/1", page), (1, "http://a.com/1", page), (2, None, None), (3, "x", ""), (4, "http://a.com/2", "<p>just <i>text</i>")]
    rows += [(10 + i, f"http://b.com/{i}", f"<div class=box>same on all</div><div class=body>only {i}</div>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extraction.extract(pages).collect()]
    want = "T & U\n\na b cde\n\none\n\ntwo"
    assert Counter(got) == Counter([(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0), (4, "just text", 9)] + [(10 + i, f"only {i}", 6) for i in range(9)])
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_html_importance_decides(spark):
    lines = lambda i: "".join(f"<p>line {i} {j}</p>" for j in range(1 + i % 4))
    text = lambda i: "\n\n".join(f"line {i} {j}" for j in range(1 + i % 4))
    foot = "<nav><ul><li>home<li>more</ul></nav><footer>page {}</footer>"
    # A teaser in an article element on every page, the text beside it; the text inside a form; copies of one page.
    teaser = [(i, f"http://a.com/{i}", f"<article>read this next</article><div class=text>{lines(i)}</div>{foot.format(i)}") for i in range(12)]
    form = [(20 + i, f"http://b.com/{i}", f"<form><div class=text>{lines(i)}</div>{foot.format(i)}</form>") for i in range(12)]
    copies = [(40 + i, "http://c.com/1", f"<article>{lines(3)}</article>") for i in range(9)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(teaser + form + copies, "page_id long, url string, html string")).collect()}
    assert got == {i + at: text(i) for i in range(12) for at in (0, 20)} | {40 + i: text(3) for i in range(9)}


def test_html_prior_holds(spark):
    """Comments, repeated stories, layout classes, odd quotes and deep nesting; each host says what the case is."""
    notes = lambda i: "".join(f"<div class=note><b>user {i}</b><p>note {i} {j}</div>" for j in range(1 + i % 5))
    rows = [(i, f"http://comments.com/{i}", f"<article><p>story {i}</article><section class=comments>{notes(i)}</section>") for i in range(20)]
    want = {i: f"story {i}" for i in range(20)}
    rows += [(100 + i, f"http://same.com/{i}", f"<nav>n{i}</nav><div>m{i}</div><article><p>one story</article>") for i in range(8)]
    want |= {100 + i: "one story" for i in range(8)}
    pages = {
        200: ("<body class='home right-sidebar'><article>kept</article>", "kept"), 201: ("<article class='post share'>kept</article>", "kept"),
        202: ("<p class=it's>Hello</p><p title=\"a > b\">you", "Hello\n\nyou"), 203: ("<div>" * 16000 + "deep" + "</div>" * 16000 + "<p>after", "deep\n\nafter"),
        204: ("<div class='page has-sidebar'><p>text</div><div class=sidebar>side</div>", "text"), 205: ("<div class=widget><article>kept</article></div><nav>x</nav>", "kept"),
        206: ("<section id=comments><p>only a comment</section>", ""), 207: ("<a " * 20000, ""), 208: ("<div data-class=ad title='class=ad'>text</div>", "text"),
        209: ("<b>" * 5000 + "x" + "<p>y" * 5000, "x" + "\n\ny" * 5000), 210: ("</p></div>" * 3 + "a</b>b", "ab")}
    rows += [(i, f"http://h{i}.com/", html) for i, (html, _) in pages.items()]
    want |= {i: text for i, (_, text) in pages.items()}
    frame = spark.createDataFrame([(*r, 1, "p", True, 2) for r in rows], "page_id long, url string, html string, key int, path string, prior boolean, host int")
    assert {r.page_id: r.text for r in html_extraction.extract(frame).collect()} == want


def test_html_evidence_grows_with_pages(spark):
    """A line that all pages of a host repeat inside the article stays on few pages and leaves on many; nothing else changes."""
    page = lambda i: f"<article><div class=more>read on</div><p>story {i}</p></article>"
    for n, stays in ((1, True), (2, True), (5, True), (6, False), (30, False)):
        got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame([(i, "http://a.com/", page(i)) for i in range(n)], "page_id long, url string, html string")).collect()}
        assert got == {i: ("read on\n\n" if stays else "") + f"story {i}" for i in range(n)}


def test_url_filters(spark):
    urls = [(1, "http://A.Example.NET/en/x?y"), (2, "https://b.net"), (3, "https://b.net/x"), (4, "http://example.com/de/1#a"), (5, "http://x.org/fr/"), (6, None), (7, "nope"),
            (8, "http://bad.com/1"), (8, "http://bad.com/1"), (9, "http://good.com/2")]
    pages = spark.createDataFrame(urls + [(50 + i, f"http://bad.com/{100 + i}") for i in range(40)] + [(150 + i, f"http://good.com/{200 + i}") for i in range(40)], "page_id long, url string")
    outcomes = spark.createDataFrame([(50 + i, 1) for i in range(40)] + [(150 + i, 0) for i in range(40)] + [(None, 1)], "key long, bad int")
    from pyspark.sql import functions as F

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, outcomes, F.col("page_id")).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2] is None and got[3][2:] == ("net/", "block")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8][3] == "block" and got[9][3] == "allow"
    assert {r.verdict for r in url_filters.judge(pages, outcomes.limit(0), F.col("page_id")).where("rule IS NULL").collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), outcomes, F.col("page_id")).count() == 0


def test_secrets(spark, docs, empty):
    keys = [hashlib.sha1(str(i).encode()).hexdigest().upper() for i in range(60)]
    rows = [(100 + i, f'x token = "{k}" y') for i, k in enumerate(keys[:50])] + [(200 + i, f"see {k} here") for i, k in enumerate(keys[50:])]
    rows += [(300, "Secret: token: abcdefgh passwd=abc api_key='abcdef' AKIA" + "A" * 16 + " " + "ab1" * 9), (301, "ordinary words and 1234567890123456789 numbers")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in secret_scans.scan(both, secret_scans.learn(both)).collect()}
    assert all(got[100 + i].n_assign == 1 for i in range(50)) and sum(got[200 + i].n_grammar for i in range(10)) >= 8
    r = got[300]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1) and r.base_sha256 == hashlib.sha256(",".join(
        x for x in r.spans.split(",") if not x.startswith("grammar")).encode()).hexdigest()
    assert got[301].spans == "" and got[0].spans == ""
    assert secret_scans.scan(empty, secret_scans.learn(empty)).count() == 0


def test_language(spark, sf_dir, docs, empty):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(real)
    rows = language_id.identify(real, model).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert odd[0] == odd[1] == odd[2] == "und" and odd[4] == "en"
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert 0 < len(out) < len(texts) and not any(b in texts[i] for i in out for b in bench)
    passed = {r.doc_id for r in quality_rules.keep(docs).collect()}
    assert set(out) <= passed
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    same = [i for i in out if hashlib.sha256(clean[i].encode()).hexdigest() == out[i].decoded_sha256]
    assert len(same) >= 0.97 * len(out)  # context patterns of the kept documents may differ from those of all
