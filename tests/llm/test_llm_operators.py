"""The training-data operators against brute force on small tables, and their defined results at the edges."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestream.llm import decontamination, html_extract, language_id, license_scan, line_dedup, ngram_join, packing, quality_rules, suffix_dedup, url_filter

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
EDGES = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "Ünïcödé 𝄞 text"), (6, "a b c d e f g " * 3000), (7, "same text here with words"), (8, "same text here with words"), (8, "same text here with words"), (None, "a row without an id")]


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that the operators use themselves
        for c in ("lang_pred", "score", "kept", "hits", "items", "host", "doc", "text_hash", "n_words", "group", "license", "n_lines"):
            df = df.withColumn(c, F.lit("own"))
    return df


# 1


def test_urls(spark):
    rows = [
        (1, "https://a.example.net/en/x?y", "example.net/en/", "allow"), (2, "HTTP://Shop.Example.NET/de/", "net/", "block"), (3, "http://example.com/de/1#t", "example.com/de/", "block"),
        (4, "https://notexample.com/de/", None, "allow"), (5, "http://x.org/fr/casino", "org/fr/", "allow"), (6, "http://x.org/casino", None, "block"), (7, "http://x.org/casinos", None, "allow"),
        (8, "http://bet.org/poker", None, "block"), (9, "http://bet.org/bet-bet", None, "allow"), (10, None, None, "allow"), (11, "no scheme casino", None, "block"), (12, "http://x.net", None, "allow"), (13, "", None, "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("host", F.lit("own"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == {i: (rule, verdict) for i, _, rule, verdict in rows}
    one = {r.page_id: (r.host, r.path) for r in url_filter.filter_urls(df).collect()}
    assert one[2] == ("shop.example.net", "/de/") and one[10] == ("", "") and one[12] == ("x.net", "")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# 2


def shingles(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    best = {i: i for i in sets}

    def find(x):
        while best[x] != x:
            x = best[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                best[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=1, groups=6, size=40):
    rng, rows, line = random.Random(seed), [], "a very common line that many of the short texts share with each other"
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((12, 30, 60, 150)))]
        for k in range(size):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            if g == 0:
                own = line.split() + own[: rng.randrange(3, 12)]
            rows.append((len(rows) * 3 % 1009 + 10, " ".join(own)))
    return rows


@pytest.mark.parametrize("hot", [2, 16])
def test_components_match_brute_force(spark, hot):
    rows = near_copies() + [(2000, None), (2001, ""), (2002, "A b"), (2003, "a B"), (2004, "x " * 4000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs(spark, rows, extra=True), hot=hot).collect()}
    assert got == components(rows)


def test_tree_join_is_exact():
    rng = random.Random(3)
    for _ in range(200):
        base = rng.sample(range(60), rng.randrange(1, 40))
        sets = []
        for _ in range(30):
            s = set(base)
            for _ in range(rng.randrange(0, 8)):
                s ^= {rng.randrange(60)}
            if s:
                sets.append(sorted(s))
        probe = sorted(base)
        want = {i for i, s in enumerate(sets) if 100 * len(set(s) & set(probe)) >= 80 * len(set(s) | set(probe))}
        assert set(ngram_join.tree_join(probe, sets)) == want


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 300, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            cut = int(len(a) * 0.1)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, cut // 2).astype(np.uint64)]))
            if len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                assert ngram_join.may_link(len(a), len(b), ngram_join.bitmap(a), ngram_join.bitmap(b))


def test_join_edges(spark):
    got = ngram_join.near_duplicates(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r.component_id for r in got}
    assert by[8] == 7 and by[1] == 1 and by[2] == 2 and by[None] is None
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    a, b, c = ("the first of some texts with words", "another text that shares nothing at all", "a third one apart from the rest here")
    rows = [(5, a), (5, b), (5, b), (7, a), (9, b), (3, c), (None, a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs(spark, rows)).collect() if r.doc_id)
    assert got == [(3, 4, 3), (5, 3, 5), (5, 3, 5), (5, 3, 5), (7, 3, 5), (9, 3, 5)]


# 3


def test_language(spark):
    words = {"en": "the and with house water light", "de": "der und mit haus wasser licht ß ü", "fr": "le et avec maison eau lumière é"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words[k].split(), k=30)), k) for i, k in enumerate(["en", "de", "fr"] * 30)] + [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (None, "der und mit haus", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    got = language_id.identified(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 900:
            assert r.lang_pred == r.lang
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert language_id.identified(df.limit(0)).count() == 0
    none = language_id.identified(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_grams_do_not_cross_words():
    got = collections.Counter(language_id.grams_of("Ab-cd").tolist())
    pack = lambda *c: int(sum((ord(x) if x != " " else (1 << 21) - 1) << (21 * k) for k, x in enumerate(reversed(c))))
    assert got == collections.Counter([pack(x) for x in "abcd"] + [pack(*x) for x in (" a", "ab", "b ", " c", "cd", "d ")] + [pack(*x) for x in (" ab", "ab ", " cd", "cd ")])


# 4


def contaminated(rows, items, window=13):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for doc, text in rows:
        w, hit, found = norm(text), set(), set()
        for item, t in items:
            iw = norm(t)
            k = min(window, len(iw))
            for s in range(len(iw) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == iw[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("max_words", [100_000, 20])
def test_contamination(spark, max_words):
    long = " ".join(f"Word{k}" for k in range(30))
    items = [(1, long), (2, "Short, item!"), (3, None), (10, "..."), (11, long.upper()), (12, "été à l'école")]
    rows = [(1, "x " * 50 + long.lower().replace(" ", "--")), (2, "a short ITEM b short items"), (3, None), (4, ""), (5, "nothing here"), (6, "Été, à l école! " * 3), (7, "y " * 2000 + " ".join(f"word{k}" for k in range(5, 19)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.judged(decontamination.find_contamination(docs(spark, rows, extra=True), bench, max_words=max_words)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == contaminated(rows, items)
    texts = dict(rows)
    for r in got:  # offsets point into the original
        assert sum(len(decontamination.words_of(texts[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
    assert decontamination.find_contamination(docs(spark, rows), bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontamination.find_contamination(docs(spark, []), bench).count() == 0


# 5


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rows = [*EDGES[:7], (20, "a b c d e f g h i a b c d e f g h j\nx\nx\n \nx# | $"), (21, " ".join(f"w{k}" for k in range(30))), (22, "## word " * 30)]
    table = quality_rules.ledger(docs(spark, rows, extra=True))
    got = {r.doc_id: tuple(r[m] for m in quality_rules.MEASURES) for r in table.collect()}
    assert got == {i: measures(t) for i, t in rows}
    kept = {r.doc_id for r in quality_rules.apply_policy(table, quality_rules.DEFAULT).where("kept").collect()}
    assert kept == {21}
    report = {r.rule: (r.n_failed, r.n_failed_alone) for r in quality_rules.ablations(table, quality_rules.BASE).collect()}
    own = {i: (measures(t)[0] < 20, 100 * measures(t)[4] > 30 * measures(t)[0]) for i, t in rows}
    assert report["few_words"] == (sum(a for a, _ in own.values()), sum(a and not b for a, b in own.values()))
    assert report["repeated_windows"] == (sum(b for _, b in own.values()), sum(b and not a for a, b in own.values()))
    assert quality_rules.ledger(docs(spark, [])).count() == 0


# 6


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [*EDGES, *((100 + k, f"text number {k} " * (k * 7 % 900)) for k in range(120))]
    got = packing.pack_documents(docs(spark, rows, extra=True), TOKENIZER, group_pieces=50).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for doc, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[doc, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= sum(r.length for r in got) / 4096 + 5
    assert packing.pack_documents(docs(spark, []), TOKENIZER).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    e = packing.Encoder(TOKENIZER)
    odd = ["a.b, c.", "don't, stop... it's", "x,, y!, z", "É,è. ß,", "ΣΑΣ, İx", "á, b", "½, ², 3,", "\xa0x,\x85y", "", "a\x1cb", None, "<|endoftext|>"]
    want = [np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert list(e.ids(odd)) == want


def test_added_tokens_are_encoded_as_by_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    odd = ["a <|endoftext|> b", "A<|startoftext|>B.", "x  <|ENDOFTEXT|>\n\ny", "<|endoftext|><|endoftext|>", "Ω <|endoftext|> é", "a <| b |> c", "plain Text, here."]
    assert list(e.ids(odd)) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert e.added == {"<|"} and 49407 in plain.encode(odd[0], add_special_tokens=False).ids


# 7


def test_line_dedup(spark):
    share = "Please subscribe to our weekly newsletter number {} today"
    rows = [(k, f"Own text of document {k * 'x'} here\n{share.format(k)}\nend of it") for k in range(1, 14)] + [(50, None), (51, ""), (52, "short line\n\n"), (None, share.format(99))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows, extra=True)).collect()}
    assert len(got) == len(rows) and got[50].text is None and got[50].n_lines == 0 and got[52].text == "short line\n\n"
    assert got[1].n_dropped == 0 and all(share[:20] not in got[k].text and got[k].n_dropped >= 1 for k in range(2, 14))
    assert got[None].text == "" and got[1].doc == "own"
    # copies of one text are one text
    same = [(k, "An entire document that is copied\nwith several lines of words in it") for k in range(1, 30)]
    assert line_dedup.dedup_lines(docs(spark, same)).where("n_dropped > 0").count() == 0
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# 8


def removed(rows, n=50):
    out, seen = {}, set()
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        own = {raw[p : p + n] for p in range(len(raw) - n + 1)}
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in seen:
                hit[p : p + n] = b"\1" * n
        seen |= own
        kept = bytes(x for x, y in zip(raw, hit, strict=True) if not y)
        out[doc] = (len(raw), sum(hit), sum(1 for j in range(len(raw)) if hit[j] and (j == 0 or not hit[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choices("abcdeé ", k=rng.choice((30, 60, 100, 300)))) for _ in range(25)]
    rows = [(k, "".join(rng.choice(pool)[rng.randrange(20) :] if rng.random() < 0.6 else "".join(rng.choices("xyz ", k=40)) for _ in range(rng.randrange(1, 12)))) for k in rng.sample(range(1000), 120)]
    rows += [(2000, None), (2001, ""), (2002, "a" * 500), (2003, "a" * 49), (2004, "a" * 50), (2005, "ab" * 400)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(spark, rows, extra=True)).collect()}
    assert got == removed(rows)


def test_repeats_in_pieces(monkeypatch):
    raw = random.Random(6).randbytes(4000)
    powers = suffix_dedup.Powers()
    whole = suffix_dedup.anchors(raw, powers)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    parts = suffix_dedup.anchors(raw, powers)
    assert set(whole[0]) == set(parts[0])
    assert sum(b - a + 1 for a, b in zip(parts[2], parts[3], strict=True)) == 4000 - 49


def test_repeats_edges(spark):
    long = "the same passage of more than fifty bytes stands in all of these rows"
    rows = [(5, long), (5, long), (7, "x" + long), (None, long), (None, None)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (5, 0), (5, 0), (7, len(long))]
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


# 9


def test_extraction(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><nav><ul><li>Menu</li></ul></nav><header>Top</header><article><h1>A &amp; B</h1><p>One <b>bold</b>\n text<br>more<p>Two &eacute;<div class='ad'>Buy</div><ul><li>x<li>y</ul><section class='comments'><p>Nice!</p></section></article><aside>S</aside><script>var x='<p>no</p>'</script><form><p>F</p></form><footer>&copy;</footer></body></html>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "<p>plain <i>page</i></p>tail"), (5, "x", "<article><p>cut <!-- open"), (6, "http://h/6", "<article><p>a</p>" + "<p>b</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[1] == "A & B\nOne bold text more\nTwo é\nx\ny" and got[2] == "" and got[3] == "" and got[4] == "plain page\ntail" and got[5] == "cut"
    assert got[6].count("\n") == 5000
    assert html_extract.extract(df.limit(0)).count() == 0


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(k, f"http://s/{k}", f"<div class='x'><p>Welcome to our site</p></div><div class='y'><p>Body number {k} {'w' * k}</p></div>") for k in range(1, 21)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Body number 3 www" and len(got) == 20
    few = html_extract.extract(spark.createDataFrame(rows[:3], "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("Welcome") for r in few)  # too few pages to tell


def test_style_tree_decides_inside_and_beside_articles(spark):
    notice, cards = "<p>Read our terms of use</p>", "<article><h2>Teaser {}</h2></article>"
    rows = [(k, f"http://a/{k}", f"<article><h1>Title {k}</h1>{notice}<p>Prose {k}</p><div>Follow us</div></article>") for k in range(1, 6)]
    rows += [(k, f"http://b/{k}", f"<div class='text'><p>Main text {k}</p></div>{cards.format(k)}{cards.format(-k)}") for k in range(11, 16)]
    copy = "<article><p>One article that a site holds twice</p></article>"
    rows += [(k, f"http://c/{k}", copy) for k in range(21, 29)] + [(30, "http://d/1", f"<div>Own text</div>{copy}")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\nProse {k}" for k in range(1, 6))
    assert all(got[k].startswith(f"Main text {k}\nTeaser {k}") for k in range(11, 16))
    assert all(got[k] == "One article that a site holds twice" for k in range(21, 29))
    assert got[30] == "Own text\nOne article that a site holds twice"


# 10


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    rows = [(1, "Some text\nReleased under the MIT License.\nmore"), (2, mit.replace(". ", ".\n")), (3, "This work is licensed under the GNU General Public License, version 2."), (4, None), (5, ""), (6, "nothing of the kind"), (7, "ALL RIGHTS, reserved!"), (8, "word " * 20000)]
    got = {r.doc_id: (r.license, list(r.licenses)) for r in license_scan.scan_licenses(docs(spark, rows, extra=True)).collect()}
    assert got[1] == ("MIT", ["MIT"]) and got[2][0] == "MIT-text" and got[3] == ("GPL-2.0", ["GPL-2.0", "GPL-3.0"])
    assert got[7][0] == "all-rights-reserved" and all(got[k] == (None, []) for k in (4, 5, 6, 8))
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0
    assert license_scan.scan_licenses(docs(spark, rows), templates={}).where("license IS NOT NULL").count() == 0


def test_size_bounds_lose_nothing(spark):
    rng, words = random.Random(8), license_scan.TEMPLATES["BSD-2-Clause"].split()
    rows = [(k, " ".join(w for w in words if rng.random() < 0.97)) for k in range(40)]
    grams = {n: set(license_scan.bigrams(t)) for n, t in license_scan.TEMPLATES.items()}
    want = {}
    for k, t in rows:
        own = set(license_scan.bigrams(t))
        want[k] = sorted(n for n, g in grams.items() if 2 * len(own & g) / (len(own) + len(g)) >= 0.8)
    assert {r.doc_id: list(r.licenses) for r in license_scan.scan_licenses(docs(spark, rows)).collect()} == want


def test_licenses_of_several_paragraphs_inside_a_document(spark):
    own = ["A program of our own, with a file for the reader.", "It does many things that the other one does not."]
    three = ("Apache-2.0-notice", "BSD-2-Clause", "GPL-3.0-header")
    rows = []
    for k, name in enumerate(three):
        parts = license_scan.TEMPLATES[name].replace(". ", ".\n\n")
        rows += [(k, "\n\n".join([*own * 20, parts, *own * 20])), (10 + k, "\n".join([*own * 20, *license_scan.TEMPLATES[name].replace(". ", ".\n").split("\n"), *own * 20]))]
    rows += [(20, "\n".join(own * 40))]
    got = {r.doc_id: (r.license, r.dice) for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    assert all(got[k + at] == (name, 1.0) for k, name in enumerate(three) for at in (0, 10)) and got[20] == (None, 0.0)


def test_a_leaf_holds_several_templates_and_long_lines_recur_at_two(spark):
    long = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))
    rows = [(i, f"opening of text {chr(97 + i)}{chr(97 + i)} alone\nPosted in category news by user name{chr(97 + i)} today") for i in range(20)]
    rows += [(100 + i, f"some text x{chr(97 + i)}x that differs\nPosted in category lists are shown below here") for i in range(25)]
    rows += [(200, f"the start of one\n{long}"), (201, f"another beginning here entirely\n{long}"), (202, "this line stands in one text only")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert [i for i in range(20) if "Posted" in got[i]] == [0] and [i for i in range(25) if "Posted" in got[100 + i]] == [0]
    assert long in got[200] and long not in got[201] and got[202] == rows[-1][1]


def test_long_texts_lose_many_lines_in_time(spark):
    line = "a line that very many of these texts repeat as it is"
    rows = [(i, f"{chr(97 + i) * 3} {chr(98 + i) * 4}\n" + f"{line}\n" * (20000 if i == 11 else 1)) for i in range(12)]
    got = {r.doc_id: (r.n_dropped, len(r.text)) for r in line_dedup.dedup_lines(docs(spark, rows)).where("n_dropped > 0").collect()}
    assert got[11][0] == 20000 and 0 not in got and len(got) == 11


def test_the_tree_matches_a_recursive_one(spark):
    import math

    pages = []
    for k in range(6):
        extra = "<div class='box'><p>Stay tuned for more of this.</p></div>" if k % 2 else "<section><h2>More</h2><p>Again the same.</p></section>"
        pages.append((k, "http://a.org/x", f"<body><div class='top'><p>Welcome to the site</p></div><article><h1>Title {k}</h1>" + "".join(f"<p>Words {k} {j}</p>" for j in range(k + 1)) + f"</article>{extra}</body>"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    places, _ = html_extract.style_tree(html_extract.parse_pages(frame))
    got = {r.node: r.importance for r in places.collect()}
    tree = {}
    for _, _, html in pages:
        found, nodes = html_extract.parsed_page(html)
        for node, style, _, path in nodes:
            t = tree.setdefault(node, {"styles": collections.Counter(), "texts": collections.Counter(), "pages": 0, "path": path})
            t["styles"][style] += 1
        for node in {n for n, _, _, _ in nodes}:
            tree[node]["pages"] += 1
        for node, text in {(n, t) for n, t, _ in found}:
            tree[node]["texts"][text] += 1

    def importance(node):
        t = tree[node]
        m = t["pages"]
        if m < html_extract.MIN_PAGES:
            return 1.0
        total = sum(t["styles"].values())
        presentation = min(1.0, -sum(c / total * math.log(c / total, m) for c in t["styles"].values()))
        below = [importance(n) for n, x in tree.items() if len(x["path"]) > 1 and x["path"][-2] == node]
        if t["texts"]:
            below.append(1 - sum(math.log(c, m) for c in t["texts"].values()) / len(t["texts"]))
        g = html_extract.DECAY ** len(t["styles"])
        return (1 - g) * presentation + g * sum(below) / len(below)

    assert got.keys() == tree.keys() and len(tree) > 6
    for node, x in got.items():
        assert abs(x - importance(node)) < 1e-9
    texts = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert all("Welcome" not in t for t in texts.values()) and texts[2].startswith("Title 2\nWords 2 0")


def test_names_do_not_take_out_main_parts(spark):
    for html in ("<article class='post-12 post type-post hentry category-news tag-python'><p>Kept words</p></article>", "<div class='content-sidebar-wrap'><main><p>Kept words</p></main></div>", "<div class='layout has-sidebar'><article><p>Kept words</p></article></div>"):
        assert [b[1] for b in html_extract.blocks_of(html)] == ["Kept words"]
    for html in ("<div class='cookie-notice'>x</div>", "<ol class='comment-list'><li><article class='comment'>x</article></li></ol>", "<div id='site-footer'>x</div>", "<div class='ad-slot-1'>x</div>", "<div role='banner'>x</div>"):
        assert html_extract.blocks_of(html) == []
    deep = html_extract.blocks_of("<div class=x>" * 40000 + "end")
    assert [b[1] for b in deep] == ["end"]


def test_a_filter_on_the_ledger_ends_on_a_long_text(spark):
    rows = [(1, "a b c d e f g " * 40000), (2, " ".join(f"w{i}" for i in range(300000)))]
    table = quality_rules.apply_policy(quality_rules.ledger(docs(spark, rows)), quality_rules.DEFAULT)
    assert [r.doc_id for r in table.where("kept").select("doc_id").collect()] == [2]


def test_language_matches_ranks_and_distances_in_plain_python(spark):
    texts = {"aa": ["the cat sat on the mat and the hat", "the rat and the cat"], "bb": ["der hund und die katze", "die maus und der hund sind da"]}
    train = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    frame = spark.createDataFrame(train, "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(frame, size=30)

    def ranks(all_texts):
        counts = collections.Counter()
        for t in all_texts:
            for w in t.split():
                x = f"\0{w}\0"
                counts.update(x[i : i + k] for k in (1, 2, 3) for i in range(len(x) - k + 1) if x[i : i + k].strip("\0") and (k < 3 or x[i + 1] != "\0"))
        pack = lambda g: sum((ord(c) or (1 << 21) - 1) << 21 * k for k, c in enumerate(reversed(g)))
        return [pack(g) for g in sorted(counts, key=lambda g: (-counts[g], pack(g)))][:30]

    plain = {lang: ranks(ts) for lang, ts in texts.items()}
    assert {k: v.tolist() for k, v in profiles.items()} == plain
    for t in ("the dog and the cat", "und die katze", "zzz"):
        own = ranks([t])
        far = {k: sum(abs(p.index(g) - i) if g in p else 30 for i, g in enumerate(own)) for k, p in plain.items()}
        best = min(sorted(far), key=far.get)
        r = language_id.identify(spark.createDataFrame([(1, t)], "doc_id long, text string"), profiles, size=30).first()
        assert r.lang_pred == best and abs(r.score - (1 - far[best] / (30 * len(own)))) < 1e-12


def test_bins_are_those_of_a_plain_sum_of_squares():
    rng = random.Random(5)
    sizes = sorted((rng.randrange(1, 65) for _ in range(400)), reverse=True)
    got = packing.sum_of_squares(sizes, 64)
    open_bins: dict[int, int] = {}  # sequence to free tokens
    used = 0
    for s, (seq, offset) in zip(sizes, got, strict=True):
        count = collections.Counter(open_bins.values())

        def total(gap, rest, count=count):
            c = count.copy()
            if gap is not None:
                c[gap] -= 1
            if rest:
                c[rest] += 1
            return sum(v * v for v in c.values())

        least = min([total(g, g - s) for g in count if g >= s] + [total(None, 64 - s)])
        new = seq not in open_bins and offset == 0
        gap = 64 if new else open_bins[seq]
        assert offset == 64 - gap and total(None if new else gap, gap - s) == least
        used += new
        open_bins.pop(seq, None)
        if gap - s:
            open_bins[seq] = gap - s
    assert used == len({seq for seq, _ in got})


def test_plain_words_go_to_the_model_directly(monkeypatch):
    from tokenizers import Tokenizer

    r, plain, e = random.Random(7), Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    learned = []
    monkeypatch.setattr(e, "_learn", lambda words, own=e._learn: (learned.extend(words), own(words))[1])
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    texts = ["".join(letters), *letters, "Don't it's x's, y'll. z'' 'tis 'S, caf\xe9!! stra\xdfe.### na\xefve,%%% a.b c$$$ 1st x2 2\xb2 x\xb2! \xb5%"]
    texts += ["".join(r.choices([*letters, *map(chr, range(33, 127)), " ", " ", "\n", "'"], k=60)) for _ in range(400)]
    texts += ["café İx 中文 plain words!", "plain words again###"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not [w for w in learned if w.isascii() and w.isalpha() and w.islower()]
    learned.clear()
    list(e.ids(["fresh onewords### twowords!? threew\xf6rds\n"]))
    assert not any(c.isalpha() for w in learned for c in w)
