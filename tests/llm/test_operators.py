"""Each operator against a brute-force version on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import boosting, chat, decontaminate, graph, html, jaccard, langid, packing, pii, quality, suffix, urls
from parchment.llm.common import SPACE

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(quality.WORD)


def words(rng, n):
    return " ".join(rng.choice("the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + rng.choice(["", "", "s", "x", "er"]) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


EDGES = [None, "", " \n ", "one", "a b c d", "é " * 12, "x" * 3000]


# ---- 2 ----


def repeat_words(w):
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    return len({i + k for places in seen.values() if len(places) > 1 for i in places for k in range(5)})


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [*EDGES, "a b c d e a b c d e", "x\nx\n \ny\nx", "| # a *", "w " * 40, *(words(rng, n) + "\n" + words(rng, 5) for n in (5, 50, 400))]
    texts += [texts[-1]]
    got = quality.quality_metrics(documents(spark, texts).withColumn("kept", F.lit("clash"))).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), repeat_words(w))
        assert r.n_symbols == sum(c in quality.SYMBOLS for c in t or "") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * repeat_words(w) > 20 * len(w))
    kept = quality.filter_documents(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns and kept.where("n_chars < 20").count() == 0
    assert quality.quality_metrics(documents(spark, [])).count() == 0


# ---- 3 ----


def sets_of(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(texts):
    sets = [sets_of(t) for t in texts]
    near = [[j for j in range(len(texts)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(texts))]
    group = list(range(len(texts)))
    while True:
        new = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(texts))]
        if new == group:
            return {i: (group[i], len(near[i])) for i in range(len(texts))}
        group = new


def near_copies(rng, n_base=12, copies=6):
    texts = []
    for _ in range(n_base):
        base = words(rng, rng.choice([30, 120, 300])).split()
        for c in range(copies):
            own = list(base)
            for _ in range(c):
                own[rng.randrange(len(own))] = f"changed{rng.randrange(99)}"
            texts.append(" ".join(own))
    return texts


def test_jaccard_join(spark):
    rng = random.Random(2)
    texts = near_copies(rng) + EDGES + ["one", "a b c d", "", None] + [words(rng, 40) for _ in range(10)]
    docs = documents(spark, texts).withColumn("class_id", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()}
    assert got == brute_links(texts)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v[0] == k}
    assert jaccard.join(documents(spark, [])).count() == 0


def test_jaccard_large_group(spark, monkeypatch):
    """A group beyond a leaf and beyond a block is compared whole."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    rng = random.Random(3)
    base = words(rng, 200).split()
    texts = []
    for i in range(90):
        own = list(base)
        own[rng.randrange(200)] = f"v{i}"
        texts.append(" ".join(own))
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(documents(spark, texts)).collect()} == brute_links(texts)


def test_jaccard_repeated_rows(spark):
    docs = documents(spark, ["a b c d e f"] * 2).union(documents(spark, ["a b c d e f"]))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs).collect()) == [(0, 0, 2), (0, 0, 2), (1, 0, 2)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


# ---- 1 ----


def test_decontamination(spark):
    rng = random.Random(4)
    items = [" ".join(f"item{i}word{k}" for k in range(n)) for i, n in enumerate((8, 12, 30, 50, 3))]
    changed = items[3].split()
    for k in (7, 20, 33):
        changed[k] = "other"
    texts = [None, "", words(rng, 60), "before " + items[2].upper() + ", after", " ".join(changed), items[0], words(rng, 20) + " " + items[1], items[4], " ".join(items[2].split()[:9])]
    texts += [texts[3]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_overlaps(documents(spark, texts).withColumn("item_id", F.lit(0)), bench).collect())
    assert got == [(3, 2), (4, 3), (5, 0), (6, 1), (9, 2)]
    assert {r.doc_id for r in decontaminate.remove_contaminated(documents(spark, texts), bench).collect()} == {0, 1, 2, 7, 8}
    assert decontaminate.find_overlaps(documents(spark, texts), bench.where("false")).count() == 0
    assert decontaminate.find_overlaps(documents(spark, []), bench).count() == 0


def brute_overlaps(text, item):
    """All diagonals of a text and an item, token by token."""
    split = lambda x: re.findall("[0-9a-z\x80-\U0010ffff]+", (x or "").lower())
    a, b, best = split(text), split(item), None
    for base in range(-len(b) + 1, len(a)) if len(b) >= decontaminate.MIN_TOKENS else ():
        equal = [0 <= base + k < len(a) and a[base + k] == b[k] for k in range(len(b))]
        inside = [e for k, e in enumerate(equal) if 0 <= base + k < len(a)]
        run = max((j - i for i in range(len(inside)) for j in range(i + 1, len(inside) + 1) if sum(inside[i:j]) >= decontaminate.SHARE * (j - i) - 1e-9), default=0)
        if sum(equal) >= decontaminate.SHARE * len(b) - 1e-9 or run >= decontaminate.STRETCH:
            best = max(best or (0, 0), (sum(equal), run))
    return best and (len(b), *best)


@pytest.mark.parametrize("small", [True, False])
def test_decontamination_against_all_diagonals(spark, monkeypatch, small):
    """Broadcast and joined benchmarks give what all diagonals of all pairs give."""
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    if not small:
        monkeypatch.setattr(decontaminate, "SMALL_TOKENS", 10)
        monkeypatch.setattr(decontaminate, "BITS", 1 << 12)
    rng = random.Random(16)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (8, 9, 12, 20, 40, 40, 5)] + ["same " * 30, None, "", "é ü " * 8]
    texts = [None, "", "same " * 70, "É Ü " * 9 + "."]
    for _ in range(40):
        own = rng.choice([x for x in items if x]).split()
        own = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.1, 0.2, 0.3]) else w for w in own][rng.randrange(3) :]
        texts.append(" ".join([*(rng.choice(vocabulary) for _ in range(rng.randrange(12))), *own, *(rng.choice(vocabulary) for _ in range(9))]))
    expected = {(d, i): found for d, t in enumerate(texts) for i, x in enumerate(items) if (found := brute_overlaps(t, x))}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = decontaminate.find_overlaps(documents(spark, texts).withColumn("item", F.lit(2)), bench).collect()
    assert {(r.doc_id, r.item_id): (r.item_tokens, r.equal_tokens, r.longest_stretch) for r in rows} == expected and len(rows) == len(expected) > 20


def test_decontamination_rows_and_periods(spark):
    """Texts under one key are told apart; a long periodic text against a periodic item stays bounded."""
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, item), (1, "clean text"), (None, item), (2, "same " * 30_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, "same " * 100)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.equal_tokens) for r in decontaminate.find_overlaps(docs, bench).collect()) == [(0, 0, 20), (1, 0, 20), (2, 1, 100)]
    assert [tuple(r) for r in decontaminate.remove_contaminated(docs, bench).collect()] == [(1, "clean text")]


def test_decontamination_paths_agree_on_repeats(spark, monkeypatch):
    """Copies of a text, equal items and words that every text holds: both paths give the same rows, as often."""
    rng = random.Random(21)
    common = "the of and in to a is it"
    items = [f"{common} {words(rng, n)}" for n in (4, 9, 30)] + [common] * 6
    texts = [f"{words(rng, 5)} {common} {words(rng, 30)}" for _ in range(8)] + [items[2]] * 3 + [f"{x} tail" for x in items[:2]]
    docs = documents(spark, texts).union(documents(spark, texts[:2])).union(documents(spark, [None, ""]))
    bench = spark.createDataFrame([(i % 7, t) for i, t in enumerate(items)], "item_id long, text string")
    broadcast = sorted(tuple(r) for r in decontaminate.find_overlaps(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "SMALL_TOKENS", 10)
    monkeypatch.setattr(decontaminate, "BITS", 1 << 12)
    monkeypatch.setattr(decontaminate, "HOT", 2)
    monkeypatch.setattr(decontaminate, "DIAGONALS", 3)
    joined = sorted(tuple(r) for r in decontaminate.find_overlaps(docs, bench).collect())
    expected = sorted((d, i % 7, *found) for d, t in [*enumerate(texts), *enumerate(texts[:2])] for i, x in enumerate(items) if (found := brute_overlaps(t, x)))
    assert joined == broadcast == expected and len(expected) > len(set(expected)) > 20


# ---- 4 ----


def page(article, extra="", host="a.example"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><div class='ad'>Buy</div><article>{article}</article>{extra}<footer>foot</footer></body></html>"


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", page(f"<h1>Title {i}</h1><p>Some <b>bo</b>ld &amp; text{i}<br>next<p>last", "<aside>side</aside><form><button>go</button></form>")) for i in range(5)]
    rows += [(10, None, None), (11, "http://b.example/", ""), (12, "http://b.example/x", "<p>loose &lt;text&gt;"), (13, "http://b.example/y", page("<p>x</p><div class='comments'>reader</div><!-- no --><script>1<2</script>") + "<p"), (4, "http://a.example/4", rows[4][2])]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html.extract(docs).collect()))
    expected = [(i, f"Title {i} Some bold & text{i} next last") for i in range(5)] + [(4, "Title 4 Some bold & text4 next last"), (10, ""), (11, ""), (12, "loose <text>"), (13, "x")]
    assert got == sorted((i, t, len(t)) for i, t in expected)
    assert html.extract(docs.where("false")).count() == 0


def test_html_without_article(spark):
    """Without an article tag, the container with the varying text is found; what never varies is template."""
    rows = [(i, "http://c.example/", f"<html><body><div id=top>Home</div><div id=x><p>{'varying words ' * (i + 3)}</p></div><div id=low>Imprint</div></body></html>") for i in range(4)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == ("varying words " * (r.page_id + 3)).strip() for r in got)


def test_html_classes_against_explicit_vectors(spark):
    """Occurrence vectors, written out, give the same classes, with their tokens nested; the template needs no article tag."""
    rng = random.Random(17)
    rows = []
    for i in range(12):
        teasers = "".join(f"<div class='t'><span>{words(rng, 3)}</span></div>" for _ in range(rng.randrange(1, 5)))
        late = "<div id=late>x</div>" if i % 2 else ""
        rows.append((i, "http://h.example/p", f"<body><div id=top>Home</div>{late}<div id=text><div id=in>{words(rng, 60)}</div> tail {i}</div><div id=more>{teasers}</div></body>"))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h.example"))
    vectors = {}
    for i, _, page_html in rows:
        for kind, value, path in html.tokens(page_html):
            if kind in ("open", "close"):
                vectors.setdefault(f"{kind} {path}/{value}" if path else f"{kind} {value}", [0] * len(rows))[i] += 1
    explicit = {}
    for token, vector in vectors.items():
        explicit.setdefault(tuple(vector), set()).add(token)
    expected = {(frozenset(x[5:] for x in own if x.startswith("open ") and f"close {x[5:]}" in own), all(n < 2 for n in v)) for v, own in explicit.items() if sum(map(bool, v)) >= html.MIN_PAGES}
    got = {(frozenset(r.members), r.once) for r in html.classes(docs).where("host = 'h.example'").collect()}
    assert got == expected and len(got) == 3
    template = {r.host: r for r in html.templates(docs).collect()}
    assert template["h.example"].root == template["*.h.example"].root == "body/div.text" and "open body/div.top" in template["h.example"].fixed
    texts = {r.page_id: r.text for r in html.extract(docs).collect()}
    assert all(texts[i] == re.search("id=in>(.*?)</div>", h)[1] + f" tail {i}" for i, _, h in rows)


def test_html_inside_the_article(spark):
    """Named inline and loose elements go, words of other names do not; quotes may stay open; small hosts use their site's template."""
    inner = "<p title=\"it's>one</p><div class='alert'>two</div><div class='share price'>three</div><p>x <span class='ad'>buy</span> y<p class='comment'>no<p>z <a href='a>b'>link</a>"
    rows = [(i, f"http://a{i % 4}.site.example/", f"<body><article>{inner} {words(random.Random(i), 20)}</article></body>") for i in range(8)]
    rows += [(20, "http://q.example/", "<article></article>"), (21, None, "plain " * 70_000), (22, "http://deep.example/", "<div>" * 3000 + "deep")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"one two three x y z link {words(random.Random(i), 20)}" for i in range(8))
    assert (got[20], got[21], got[22]) == ("", ("plain " * 70_000).strip(), "deep")


# ---- 5 ----


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(400):
        x = [rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(0, 60))]
        assert suffix.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute_removal(texts):
    first = {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), len(b) - len(rest), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(rest).hexdigest())
    return out


def test_removal(spark):
    rng = random.Random(6)
    shared = words(rng, 30)
    texts = [*EDGES, shared, "début " + shared + " fin", shared[:60] + "!" + shared[60:], "ab" * 200, "ab" * 80, "x" * 49, "x" * 50, "\0" * 60, *(words(rng, 40) + shared[10:70] for _ in range(5)), "x" * 3000]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(documents(spark, texts).withColumn("kept", F.lit(1))).collect()}
    assert got == brute_removal(texts)
    assert suffix.remove_repeats(documents(spark, [])).count() == 0


# ---- 6 ----


def checked(kind, t):
    d = re.sub(r"[^0-9]", "", t)
    if kind == "ip":
        return all(int(x) <= 255 for x in t.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in re.finditer(pii.PATTERNS[k], t or "") if checked(k, m.group())]


PERSONAL = [
    "mail a.b@c.example.com, x@y and p@q.r.s@t.u", "é 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 007.000.01.1", "card 4111 1111 1111 1111 or 4111111111111112", "call +1 (212) 555-0100 or +12 3", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" ok",
    "0" * 30 + " " + "a" * 300 + "@", "iban DE89 3704 0044 0532 0130 00", "+49 30 1234567, 4111111111111111",
]


def test_pii_base_and_added(spark):
    texts = [*EDGES, *PERSONAL, PERSONAL[0]]
    docs = documents(spark, texts).withColumn("base", F.lit(1)).withColumn("spans", F.lit(1))
    got = pii.find(docs).withColumn("b", pii.span_list(F.col("base"))).withColumn("s", pii.span_list(F.col("spans"))).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert r.b == ",".join(base_spans(t)) and r.s.startswith(r.b)
        for x in r.s.split(","):
            if x:
                _, a, b = x.split(":")
                assert 0 <= int(a) < int(b) <= len(t)
    assert pii.find(documents(spark, [])).count() == 0


def test_redaction(spark):
    model = ([(1.0, (-1.0,))], {k: 1.01 for k in pii.CANDIDATES})
    docs = documents(spark, ["to a@b.co now", None, "plain", "4111111111111111, 10.0.0.1 end"])
    got = [r.text for r in pii.redact(docs, model).orderBy("doc_id").collect()]
    assert got == ["to <EMAIL> now", None, "plain", "<CARD>, <IP> end"] and pii.redact(docs, model).columns == docs.columns


def test_pii_learns_secrets(spark):
    rng = random.Random(7)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'{words(rng, 12)} token = "{secret()}" {words(rng, 5)}' for _ in range(60)] + [f"{words(rng, 10)} {'a' * 30} {rng.randrange(10**15, 10**16)}" for _ in range(60)]
    docs = documents(spark, texts)
    got = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.span_list(F.col("spans")).alias("s")).collect()}
    assert sum("secret" in got[i] for i in range(60)) >= 57 and not any("secret" in got[i] for i in range(60, 120))


# ---- 7 ----


@pytest.mark.parametrize("counts", [{}, {1: 3}, {2047: 2, 1: 1}, {700: 10, 650: 10, 698: 10}, {k: k % 7 + 1 for k in range(1, 400, 3)}])
def test_cutting_stock(counts):
    plan = packing.solve(counts)
    used = {}
    for pattern, times in plan:
        assert sum(k * n for k, n in pattern.items()) <= packing.CAPACITY
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    assert sum(t for _, t in plan) <= sum(t for _, t in packing.first_fit(counts, packing.CAPACITY))


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(8)
    texts = [*EDGES, words(rng, 3000), "end <|endoftext|> special", "naïve 数字 ١٢٣ \u2028 x\u00a0y", words(rng, 9), words(rng, 9)]
    docs = documents(spark, texts).union(documents(spark, ["one"])).withColumn("length", F.lit(1))
    got = packing.pack(docs).toPandas()
    ids = {i: exact.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    for doc, rows in got[got.doc_id > 0].sort_values("start").groupby("doc_id"):
        assert rows.length.sum() == rows.doc_tokens.iloc[0] == len(ids[doc])
        for r in rows.itertuples():
            piece = ids[doc][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
    assert len(got[got.doc_id == 0]) == 2  # a repeated id is a document of its own
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for r in rows.itertuples():
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert packing.pack(documents(spark, [])).count() == 0


# ---- 8 ----


def test_template_folds_and_rejects():
    tree = chat.fold(chat.parse("{% for m in messages %}{{ 'a' + 'b' }}{% if 1 == 2 %}x{% elif true %}c{% else %}{{ m.text }}{% endif %}{% endfor %}"))
    assert tree == (chat.For("m", (chat.Text("abc"),)),)
    for bad in ("{{ m.__class__ }}", "{% for m in messages %}", "{{ open('x') }}", "{% include x %}", "{{ m.text | exec }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\<s>\\", "", None, "[TEXT]\n</s>\n<s>[ANSWER] x", "é\\"]
    rows = [(c, i, r, t, "x") for c in (1, 2, None) for i, (r, t) in enumerate(zip(["system", "user", "assistant", None, "[TEXT]", "assistant"], nasty, strict=True))]
    rows += [(1, None, "user", "first", "x"), (2, 0, "system", nasty[0], "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(table)).collect()}
    for conv in (1, 2, None):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        learnt = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digest(chat.format_conversations(table.where("false"))).count() == 0


# ---- 9 ----


def test_language(spark):
    rng = random.Random(9)
    make = {"en": "the and thing with that of reading", "de": "der und ist nicht über schön zwölf", "fr": "le la où être déjà garçon avec"}
    rows = [(i, " ".join(rng.choice(make[lang].split()) for _ in range(rng.randint(4, 40))), lang, "s", 0) for i, lang in enumerate(rng.choice(list(make)) for _ in range(300))]
    docs = spark.createDataFrame(rows + [(900, None, "en", "s", 0), (901, "12 34 !", "de", "s", 0), (902, "", None, "s", 0), (903, "der " * 400_000, None, "s", 0), (1, rows[1][1], rows[1][2], "s", 0)], DOC).withColumn("score", F.lit(1))
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    hits = [got[i].lang_pred == lang for i, _, lang, _, _ in rows]
    assert sum(hits) >= 0.98 * len(hits) and [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[902].score == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.where("false"))).collect()} == {"und"}
    assert {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2} == {r.doc_id for r in docs.where(langid.held_out(F.col("doc_id"))).collect() if r.doc_id < 900}


# ---- 10 ----

URLS = [
    ("https://WWW.Example.COM/en/x?q=1", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"), ("http://x.com", "x.com", "", None, None), ("http://x.com/", "x.com", "/", "com/", "allow"),
    ("http://xcom/", "xcom", "/", None, None), ("https://b.net/es/?x#y", "b.net", "/es/", "net/es/", "block"), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://b.net#/fr/", "b.net", "", None, None), ("a://net/fr/1", "net", "/fr/1", "net/fr/", "block"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] + [(3, URLS[3][0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")
    assert urls.judge_urls(pages.where("false")).count() == 0


def test_urls_learn(spark):
    rng = random.Random(10)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    rows = [(f"http://{name()}-{name()}{rng.randrange(999)}.example/{rng.randrange(10**6)}?a=1&b=2", 1.0) for _ in range(300)] + [(f"http://{name()}.example/{name()}", 0.0) for _ in range(300)]
    rng.shuffle(rows)
    labelled = spark.createDataFrame(rows[:400], "url string, label double")
    rest = spark.createDataFrame([(u, y) for u, y in rows[400:]], "url string, y double")
    got = urls.judge_urls(rest, labelled).select((F.col("verdict") == F.when(F.col("y") == 1, "block").otherwise("allow")).alias("ok")).collect()
    assert sum(r.ok for r in got) >= 0.97 * len(got)


def test_constant_model(spark):
    rows = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    assert boosting.fit(rows, ["x"], "y") == [(1.0, (1.0,))]
    assert SPACE


# ---- findings of the review ----


def test_jaccard_runs_reach_recall():
    """Pairs just at the threshold, simulated: each branch of each run samples tokens that the pair shares or not."""
    rng = np.random.default_rng(1)
    n = 300_000
    for depth in (1, 2, 4, jaccard.DEPTH, 2 * jaccard.DEPTH):
        alive = (rng.random(n) < 0.8).astype(np.int64)  # branches that hold both, up to a number that hardly dies out
        for _ in range(depth - 1):
            alive = rng.binomial(np.minimum(alive, 40) * jaccard.BRANCH, 0.8)
        met = (alive > 0).mean()
        assert abs(met - jaccard.meeting_chance(depth)) < 0.005
        assert (1 - jaccard.meeting_chance(depth)) ** jaccard.RUNS <= 1 - jaccard.RECALL


def test_jaccard_split_brings_pairs_together():
    """A crowd of pairs at the threshold in one group: nearly each pair meets in a leaf, whatever the depth."""
    rng = np.random.default_rng(2)
    n = 3000
    marks = rng.integers(0, 3, (2 * n, jaccard.COORDINATES)).astype(np.uint8)  # others agree by a third
    same = rng.random((n, jaccard.COORDINATES)) < 0.8
    marks[1::2] = np.where(same, marks[::2], 3 + rng.integers(0, 200, same.shape))
    leaves, whole = jaccard._split(marks, 5)
    met = np.zeros(n, bool)
    for own in (*leaves, *whole):
        pairs, counts = np.unique(own // 2, return_counts=True)
        met[pairs[counts > 1]] = True
    assert max(len(x) for x in leaves) <= jaccard.LEAF and met.mean() >= jaccard.meeting_chance(2 * jaccard.DEPTH) - 0.02


def test_jaccard_hot_tokens_and_repeated_ids(spark, monkeypatch):
    """Groups beyond GROUP are split by further keys; ids may repeat with other texts or be missing; NUL is no space."""
    monkeypatch.setattr(jaccard, "GROUP", 40)
    monkeypatch.setattr(jaccard, "LEAF", 8)
    rng = random.Random(15)
    texts = near_copies(rng, 3, 60) + [words(rng, 40) for _ in range(20)]
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(documents(spark, texts)).collect()} == brute_links(texts)
    rows = [(5, texts[0]), (5, texts[-1]), (None, texts[0]), (7, texts[-1]), (7, texts[-1]), (8, "a\0b c d e f"), (9, "a b c d e f"), (10, "\0"), (11, "\0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id, r.n_links) for r in jaccard.join(docs).collect())
    assert got == [(False, 5, 5, 1), (False, 5, 5, 2), (False, 7, 5, 2), (False, 7, 5, 2), (False, 8, 8, 0), (False, 9, 9, 0), (False, 10, 10, 1), (False, 11, 10, 1), (True, 0, 5, 1)]
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [5, 5, 8, 9, 10]


def pairs_from_a_pool(rng, n):
    """Pairs of similarity 0.80 to 0.82, each from its own half of the same 100 passages: every shingle has many owners."""
    pool = [[f"s{i}w{k}" for k in range(12)] for i in range(100)]
    texts = []
    while len(texts) < 2 * n:
        own = [w for i in sorted(rng.sample(range(100), 50)) for w in pool[i]]
        other = list(own)
        for x in rng.sample(range(10, 590, 5), 13):
            other[x] = f"new{len(texts)}x{x}"
        a, b = sets_of(" ".join(own)), sets_of(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.82:
            texts += [" ".join(own), " ".join(other)]
    return texts


def test_jaccard_crowd_without_bridges(spark):
    """In a crowd of thousands that no other member bridges, each pair at the threshold is found."""
    texts = pairs_from_a_pool(random.Random(13), 1200)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(documents(spark, texts)).collect()}
    assert got == {d: (d - d % 2, 1) for d in range(len(texts))}


def test_decontamination_seeds_hit_all_substitutions():
    """All ways to substitute as many tokens as an accepted overlap may have, by item length; and no fewer are accepted."""
    for n in range(decontaminate.MIN_TOKENS, 22):
        for gone in itertools.combinations(range(n), n // 5):
            kept = "".join("0" if i in gone else "1" for i in range(n))
            assert any(all(kept[at + i] == "1" for i, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for at in range(n - len(m) + 1)), kept


def test_decontamination_with_substitutions(spark):
    """Items of 8 to 20 tokens with up to a fifth of them substituted, among other words, are found; more are not in items too short for a stretch."""
    rng = random.Random(14)
    items = [" ".join(f"i{n}w{k}" for k in range(n)) for n in range(8, 21)]
    texts, expected = [], []
    for i, item in enumerate(items):
        n = len(item.split())
        for gone in (*(rng.sample(range(n), n // 5) for _ in range(20)), *([k * 4 % n for k in range(n // 5 + 3)],) * (n < decontaminate.STRETCH)):
            own = item.split()
            for k in gone:
                own[k] = "other"
            if len(set(gone)) <= n // 5:
                expected.append((len(texts), i))
            texts.append(f"{words(rng, 9)} {' '.join(own)} {words(rng, 9)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_overlaps(documents(spark, texts), bench).collect()) == expected


@pytest.mark.parametrize(
    "before,after",
    [("<body class='right-sidebar'><article>", "</article></body>"), ("<body class='has-sidebar'><main>", "</main></body>"), ("<body><div id='page-with-sidebar'><article>", "</article></div></body>"), ("<body><article class='post comments-open'>", "</article></body>"), ("<body><div id='page-with-sidebar'><div id='x'>", "</div></div></body>")],
)
def test_html_names_around_the_article(spark, before, after):
    rows = [(i, "http://d.example/", f"<html>{before}<p>{'varying words ' * (i + 3)}</p><div class='comments'>reader {i}</div>{after}</html>") for i in range(4)]
    rows += [(9, "http://e.example/", rows[0][2])]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: ("varying words " * (i % 9 + 3)).strip() for i in (0, 1, 2, 3, 9)}


def test_pii_held_out_figures_by_kind(spark):
    """Strings of forms that the judging trees had not seen, harder than unseen strings of known forms."""
    bank = pii.planted_bank()
    forms = {unseen: {(k, label, form) for _, k, form, *_, label in bank if (form % pii.FORMS_FOLDS == pii.FORMS_FOLDS - 1) == unseen} for unseen in (True, False)}
    assert not forms[True] & forms[False] and {(k, label) for k, label, _ in forms[True]} == {(k, label) for k, label, _ in forms[False]}
    rng = random.Random(18)
    _, limits, figures = pii.train_and_measure(documents(spark, [words(rng, rng.randrange(5, 60)) for _ in range(300)] + EDGES))
    assert set(figures) == set(pii.CANDIDATES) == set(limits)
    for kind, (precision, recall, n) in figures.items():
        print(kind, precision, recall, n)
        assert n >= 50 and precision >= 0.85 and recall >= 0.45, kind


def test_trees_as_expressions(spark):
    """The compiled CASE expressions against walking the trees in plain Python."""
    rng = random.Random(19)
    rows = [(rng.random(), rng.random(), float(rng.randrange(4))) for _ in range(400)]
    table = spark.createDataFrame([(a, b, c, float(a > 0.5 or (b < 0.3 and c > 1))) for a, b, c in rows], "a double, b double, c double, y double")
    trees = boosting.fit(table, ["a", "b", "c"], "y")

    def walk(node, x):
        return node[0] if len(node) == 1 else walk(node[2] if x[node[0]] <= node[1] else node[3], x)

    got = table.select("a", "b", "c", "y", boosting.probability(trees, [F.col(x) for x in "abc"]).alias("p")).collect()
    for r in got:
        margin = sum(w * walk(t, (r.a, r.b, r.c)) for w, t in trees)
        assert abs(r.p - 1 / (1 + np.exp(-2 * margin))) < 1e-9
    assert sum((r.p > 0.5) == (r.y == 1) for r in got) >= 0.95 * len(got)


def test_url_labels_from_pages(spark):
    """Thin pages and pages of links count as blocked; the trees learn it from the urls' form."""
    rng = random.Random(20)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    rows = [(f"http://{name()}.example/{name()}/{name()}", f"<body><p>{words(rng, 200)}</body>") for _ in range(150)]
    rows += [(f"http://{name()}-{name()}{rng.randrange(999)}.example/?a=1&b=2", f"<body>{'<a href=x>link</a> ' * 150}</body>" if rng.random() < 0.5 else f"<p>{words(rng, 20)}</p>") for _ in range(150)]
    rows += [(None, "x"), ("http://a.example/", None)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    assert [r.label for r in urls.page_labels(pages).collect()] == [0.0] * 150 + [1.0] * 150
    got = urls.judge_urls(pages).where("rule is null and page_id < 300").select(((F.col("verdict") == "block") == (F.col("page_id") >= 150)).alias("ok")).collect()
    assert sum(r.ok for r in got) >= 0.97 * len(got) > 200


def test_samples_at_any_size(spark):
    from parchment.llm.common import bounded_sample, sample_limit

    for n in (10, 10**6, 10**12, 10**15):
        assert abs(sample_limit(n, 1000) / 2**63 - min(1, 1000 / n)) < 1e-9 and sample_limit(n, 1000) > 0
    rows = spark.createDataFrame([(1, "same")] * 50 + [(i, "x") for i in range(2000)], "doc_id long, text string")
    assert bounded_sample(rows, 5000).count() == 2050 and 300 < bounded_sample(rows, 500).count() <= 500


def test_language_against_plain_bayes(spark):
    """Counts, priors and scores by an explicit naive Bayes; letters only; any number of languages."""
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice("abcé") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))), rng.choice(["aa", "bb", "cc"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def features(text):
        chars = "".join(c if c.isalpha() else " " for c in text.lower())
        t = f" {' '.join(chars.split())} "
        codes = []
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                code = 0
                for c in t[i : i + n]:
                    code = (code * 0x110000 + ord(c)) % 2**64
                codes.append(int(langid.mix(np.array([(code + n) % 2**64], np.uint64))[0]) % langid.BUCKETS)
        return codes

    counts = {lang: np.full(langid.BUCKETS, langid.SMOOTHING) for lang in ("aa", "bb", "cc")}
    for _, text, lang in rows:
        np.add.at(counts[lang], features(text), 1)
    expected = {}
    for i, text, _ in rows:
        own = {lang: np.log(sum(r[2] == lang for r in rows) / len(rows)) + np.log(c / c.sum())[features(text)].sum() for lang, c in counts.items()}
        best = max(sorted(own), key=own.get)
        expected[i] = (best, 1 / sum(np.exp(x - own[best]) for x in own.values()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert all(got[i][0] == best and abs(got[i][1] - score) < 1e-3 for i, (best, score) in expected.items())
    odd = spark.createDataFrame([(1, "½ ² ① 12"), (2, "_ -"), (3, None), (4, "ª")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(odd, langid.train(docs)).orderBy("doc_id").collect()] == [True, True, True, False]
    many = spark.createDataFrame([(i, chr(0x4E00 + i) * 5, f"l{i:03d}") for i in range(500)], "doc_id long, text string, lang string")
    model = langid.train(many)
    assert len(model[0]) == 500 and langid.predict(many, model).join(many, "doc_id").where("lang_pred = lang").count() >= 480


def test_cutting_stock_beats_first_fit():
    """Lengths that first fit decreasing wastes room on; column generation ends by its bound."""
    counts = {1025: 0, 930: 60, 700: 60, 418: 60, 360: 60, 680: 60}
    plan, plain = packing.solve(counts), packing.first_fit({k: v for k, v in counts.items() if v}, packing.CAPACITY)
    used = sum(t for _, t in plan)
    assert used <= sum(t for _, t in plain) and used * packing.CAPACITY >= sum(k * v for k, v in counts.items())
    assert used < sum(t for _, t in plain)


def test_packing_ids_on_a_whole_table():
    """The rank file and the tokenizer file give the same ids for every text of a table."""
    import os

    import pyarrow.parquet as pq
    from public_tokenizers import path
    from tokenizers import Tokenizer

    table = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(table):
        pytest.skip("no test data")
    texts = [t for t in pq.read_table(table, columns=["text"]).column("text").to_pylist() if t is not None]
    ids = packing.tokenizer_ids()
    exact = Tokenizer.from_file(path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)
    assert all(ids(t).tolist() == e.ids for t, e in zip(texts, exact, strict=True))


def test_chat_closing_and_large_ids(spark):
    """What a template has after its loop ends the last piece; ids beyond 2**53 stay apart; turns are read from the text."""
    rows = [(2**53 + c, t, r, f"{r} {t} </s>\n") for c in (0, 1) for t, r in enumerate(("user", "assistant"))] + [(None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    source = "{% for m in messages %}{{ m.text }}{% endfor %}END"
    whole = {}
    for r in sorted(chat.format_conversations(table, source).collect(), key=lambda r: r.turn_index):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.formatted
    assert whole == {2**53: "user 0 </s>\nassistant 1 </s>\nEND", 2**53 + 1: "user 0 </s>\nassistant 1 </s>\nEND", None: "xEND"}
    pieces = chat.format_conversations(table)
    assert {r.conv_id: r.n_turns for r in chat.digest(pieces).collect()} == {2**53: 2, 2**53 + 1: 2, None: 1}
    glued = pieces.where("conv_id is null").unionByName(pieces.where("conv_id is null"))
    assert chat.digest(glued.coalesce(1)).collect()[0].n_turns == 2


def test_every_text_counts_in_training(spark, monkeypatch):
    """Training takes rows with weights that add up to the strings found in all texts, however many there are."""
    rows = spark.range(21_000).selectExpr("concat('some plain words here ', id) AS text")
    seen = {}

    def fit(rows, features, label, **options):
        seen.setdefault("weights", rows.agg(F.sum(options["weight"])).first()[0])
        seen.setdefault("rows", rows.count())
        return [(1.0, (1.0,))]

    monkeypatch.setattr(pii.boosting, "fit", fit)
    pii.train(rows)
    assert seen["weights"] > 40_500 and seen["rows"] < 20_000
