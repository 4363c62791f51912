"""Archives, token shards, language identification and main-text extraction."""
import hashlib
import html
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.llm import html_extract, langid, queries, token_output, warc
from plotwise.llm.common import shared_folder
from tests.llm import helpers as H

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumn("payload_digest", F.lit("clash")).withColumn("host", F.lit("clash"))


def test_warc_round_trip_and_random_access(spark):
    big = "<p>" + "long text " * 100_000
    copy = "x" * 100
    rows = [(5, "http://a/5", copy), (3, "http://a/3", copy), (9, None, copy), (1, "u\r\nWARC-Type: evil", "y" * 99),
            (2, "u", "y" * 99), (4, "u", None), (6, "u", ""), (7, "u%0A", big), (2 ** 60 + 1, "é", "é" * 60),
            (8, "u", "é" * 60), (None, "n", "null id " * 20), (3, "http://a/3", copy)]
    df = pages(spark, rows)
    folder = shared_folder(spark, "warc-test")
    manifest = warc.write_archives(df, folder, frame_bytes=300, bundle_bytes=400).cache()
    got = warc.read_archives(folder, manifest).collect()
    digest = {r: hashlib.sha256((r[2] or "").encode()).hexdigest() for r in rows}
    first = {}
    for r in rows:
        if len((r[2] or "").encode()) >= 100 and r[0] is not None:
            first[digest[r]] = min(r[0], first.get(digest[r], r[0]))
    many = [digest[r] for r in rows]
    want = []
    for r in rows:
        again = many.count(digest[r]) > 1 and digest[r] in first and r[0] != first[digest[r]]
        want.append((r[0], r[1], len((r[2] or "").encode()), digest[r], "revisit" if again else "response",
                     first[digest[r]] if again else None, None if again else (r[2] or "").encode()))
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    entries = manifest.collect()
    assert len(entries) == len(rows) and len({e.bundle for e in entries}) > 1
    for e in entries:
        assert warc.read_record(folder, e.asDict())["record_id"] == e.record_id
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_a_bundle_is_plain_zstd_with_a_seek_table():
    import zstandard
    frames = [b"a" * 1000, b"b" * 500]
    packed = [zstandard.ZstdCompressor().compress(f) for f in frames]
    bundle = b"".join(packed) + warc.seek_table([(len(p), len(f)) for p, f in zip(packed, frames)])
    assert [s[1:] for s in warc.read_seek_table(bundle)] == [(len(p), len(f)) for p, f in zip(packed, frames)]
    with zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True) as r:
        assert r.read() == b"".join(frames)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def test_batched_encoding_equals_the_library(tokenizer):
    rng = random.Random(1)
    low = [chr(i) for i in range(0x250)] + list("  ''\n\n sstmdrevll'") * 12
    texts = ["".join(rng.choice(low) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice(" 'srevltmd\n\tab1.") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "a", "中文 \U0001f600 text", "<|endoftext|>", "it's we're  they'll", "́a", "word " * 5000]
    got = list(token_output.encode_all(texts, queries.tokenizer_path(), chars=5000))
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_token_shards_round_trip(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_BYTES", 3000)
    rows = [r for r in H.corpus() if r[0] is not None] + [(-5, "negative id", "en", "s", 1)]
    docs = H.frame(spark, rows).repartition(5)
    folder = shared_folder(spark, "tokens-test")
    shards, dictionary = token_output.write_shards(docs, folder, queries.tokenizer_path(), shard_bytes=4000)
    got = sorted(token_output.read_shards(folder, shards, dictionary).collect(), key=lambda r: r.start)
    assert shards.count() > 3 and [r.doc_id for r in got] == sorted(r[0] for r in rows)
    texts, start = {}, 0
    for r in rows:
        texts.setdefault(r[0], []).append(np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4"))
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        assert any(r.ids == t.tolist() and r.ids_crc32 == zlib.crc32(t.tobytes()) for t in texts[r.doc_id])
        start += r.n_tokens
    name = shards.orderBy("shard", "part").first().name
    assert token_output.read_document(folder, name, 1, dictionary).tolist() == got[1].ids
    with pytest.raises(ValueError):
        token_output.read_document(folder, name, 1, b"another")
    null = H.frame(spark, [(None, None, None, None, None), (1, "", None, None, None)])
    assert sorted(((r.doc_id, r.n_tokens) for r in token_output.round_trip(null, queries.tokenizer_path()).collect()),
                  key=repr) == [(1, 1), (None, 1)]
    assert token_output.round_trip(H.frame(spark, []), queries.tokenizer_path()).count() == 0


def test_language_id_held_out_accuracy_and_awkward_texts(spark):
    rng = random.Random(0)
    stems = {"aa": ["ba", "be", "do", "ka"], "bb": ["ti", "tu", "shi", "no"], "cc": ["lö", "äm", "gra", "ust"]}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(stems))
        text = " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(20))
        rows.append((i, text, lang, "s", 1))
    odd = [(400, None, "aa", "s", 1), (401, "", "bb", "s", 1), (402, "123 !!", "cc", "s", 1), (403, "bado", None, "s", 1),
           (None, "tishino tutu", "bb", None, None), (403, "lögra", None, None, None), (404, "ba " * 50_000, "aa", "s", 1)]
    docs = H.frame(spark, rows + odd)
    model = langid.learn(docs.filter(~langid.held_out()))
    got = langid.predict(docs, model).select("doc_id", "text", "lang", "lang_pred", "lang_score").collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.lang_score <= 1 for r in got)
    for r in got:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
        elif r.lang:
            assert r.lang_pred == r.lang
    assert {r.text: r.lang_pred for r in got}["lögra"] == "cc"
    none = langid.learn(H.frame(spark, []))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(H.frame(spark, []), model).count() == 0


def test_held_out_is_crc32_of_the_id(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), langid.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def site_page(i, rng):
    body = [f"Title {i} &amp; more", f"First  paragraph {H.sentence(rng, 20)} &lt;x&gt;", f"second {H.sentence(rng, 30)}"]
    semantic = i % 2 == 0
    main = f"<h1>{body[0]}</h1><p><b>{body[1]}<br><p>{body[2]}</p>"
    wrap = f"<article>{main}</article>" if semantic else f'<div id="c{i % 2}">{main}</div>'
    return (f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
            f'<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Menu {i}</a></li></ul></nav>'
            f'<!-- <p>comment</p> --><div class="ad top">Buy {i}</div>{wrap}<aside>Side {i}</aside>'
            f'<form><input value="<p>"><p>Send {i}</p></form><div class="box"><p>All pages of this site say this.</p></div>'
            f'<div class="comments"><p>Reader {i} says no</p></div><footer>&copy; {i}</footer></body></html>',
            "\n\n".join(" ".join(html.unescape(x).split()) for x in body))


def test_extraction_of_templated_pages(spark):
    rng = random.Random(6)
    made = [site_page(i, rng) for i in range(24)]
    rows = [(i, f"http://h{i % 2}.example/{i}", p) for i, (p, _) in enumerate(made)]
    rows += [(100, "http://h0.example/n", None), (101, None, ""), (102, "no host", made[0][0]), (0, rows[0][1], rows[0][2]),
             (None, "http://one.example/", "<p>A page of its own &eacute;&am</p><p>cut off <a hre"),
             (103, "http://one.example/x", "plain text < 5 and > 3"), (104, "http://long.example/", "<p>" + "long " * 100_000)]
    got = {(r.page_id, r.url): r for r in html_extract.extract(pages(spark, rows)).collect()}
    for i, (_, want) in enumerate(made):
        r = got[i, rows[i][1]]
        assert (r.text, r.n_chars) == (want, len(want))
    assert got[100, "http://h0.example/n"].text == got[101, None].text == ""
    assert got[102, "no host"].text == made[0][1]
    assert got[None, "http://one.example/"].text == "A page of its own é&am\n\ncut off"
    assert got[103, "http://one.example/x"].text == "plain text < 5 and > 3"
    assert got[104, "http://long.example/"].n_chars == 499_999
    assert html_extract.extract(pages(spark, rows)).count() == len(rows)
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_the_template_decides_on_marked_pages_too(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(12):
        body = [f"Title {i}", H.sentence(rng, 40), H.sentence(rng, 30)]
        # a notice without a listed name, on most pages only, and a sentence without an element of its own
        notice = '<div class="box"><p>Write to us, we like mail.</p></div>' if i % 4 else ""
        rows.append((i, f"http://a.example/{i}", f"<html><body><article><h1>{body[0]}</h1><p>{body[1]}</p>{notice}"
                     f"<p>Read on below.</p><p>{body[2]}</p></article></body></html>"))
        want[i] = "\n\n".join(body)
        # the only article is a teaser
        rows.append((100 + i, f"http://b.example/{i}", f"<html><body><article><p>Teaser {i}</p></article>"
                     f"<div><h1>{body[0]}</h1><p>{body[1]}</p><p>{body[2]}</p></div></body></html>"))
        want[100 + i] = want[i]
    # an article that is there twice under equal html, on a host of five pages, is no template
    rows += [(200 + i, f"http://c.example/{i}", f"<html><body><article><p>Text of page {max(i, 3)}</p></article></body></html>")
             for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    for i in range(12):
        assert got[i] == want[i]
        assert want[i] in got[100 + i]
    assert all(got[200 + i] == f"Text of page {max(i, 3)}" for i in range(6))


def test_whole_frame_and_slots_by_the_template(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(9):
        body = H.sentence(rng, 60)
        # over 400 frame tags before the text, each slot of this menu a link of its own
        menu = "".join(f'<div id="m{k}"><a href="/{k}">{k} of {i}</a></div>' for k in range(300))
        # a short section, and a paragraph that is mostly one link
        rows.append((i, f"http://a.example/{i}", f'<html><body>{menu}<div id="t"><h1>Title {i}</h1>{body}</div><div id="s"><p>Short {i}</p>'
                     f'</div><div id="r"><p>{body[::-1]}</p><p>See <a href="/x">the very long name of paper {i}</a></p></div></body></html>'))
        want[i] = "\n\n".join([f"Title {i}", body, f"Short {i}", body[::-1], f"See the very long name of paper {i}"])
    rows += [(20, None, "<ul><li><a href='/'>Menu</a></li></ul><p>Some text that is longer.</p><p><a href='/'>A link.</a></p>")]
    want[20] = "Some text that is longer.\n\nA link."
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == want


def test_classes_are_ordered_and_nested(spark):
    # roles by hand: odd ones are texts. One frame in which 10 and the text 21 wander, 30..34 crossed by 40 and 42 on a
    # page, a list of 50 and 52, and 60, 62, 70, 72, which are as often on each page, but in two lists
    def page(n, first, last, cross):
        middle = [30, 40, 32, 42, 34] if cross else [30, 32, 40, 42, 34]
        return [2, *first, 4, *middle[:5], 6, *[50, 52] * n, 8, *[60, 62] * (n + 1), *[70, 72] * (n + 1), *last, 12]

    made = [page(1, [10, 21], [], False), page(2, [], [21, 10], True), page(3, [21], [10], False)]
    made += [[r for r in page(1, [10], [21], False) if r not in (40, 42)] + [14]]
    rows = [("h", i, roles) for i, roles in enumerate(made)] + [("other", i, [2, 4]) for i in range(3)]
    read = spark.createDataFrame(rows, html_extract.PAGE_ROLES)
    sizes = read.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    members = html_extract.valid(read, html_extract.equal_vectors(read, sizes)).collect()
    classes: dict = {}
    for m in sorted(members, key=lambda m: m["rank"]):
        classes.setdefault((m.host, m.cls), []).append(m.role)
    assert sorted(classes.values()) == sorted([[2, 4, 30, 32, 34, 6, 8, 12], [21], [50, 52], [60, 62], [70, 72], [2, 4]])
    # by brute force: a class's tokens come in its order, over and over
    for (h, _), roles in classes.items():
        for at, _, page_roles in rows:
            own = [r for r in page_roles if r in roles]
            assert at != h or own == roles * (len(own) // len(roles))


def test_roles_are_told_apart_until_nothing_changes(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for i in range(6):
        text = [H.sentence(rng, 25) for _ in range(1 + i % 3)]
        # the two sections differ by the heading between them, and their boxes by their sections
        rows.append((i, f"http://a.example/{i}", "<html><body><h1>Title</h1><section>" + "".join(f"<p>{t}</p>" for t in text)
                     + f'<div><a href="/{i}">Link {i}</a> <a href="/n">and link {i}</a></div></section><h2>Part of {i}</h2>'
                     f"<section><div><b>{text[0][::-1]}</b></div><div>End of {i}</div></section></body></html>"))
        want[i] = "\n\n".join([*text, f"Part of {i}", text[0][::-1], f"End of {i}"])
    df = pages(spark, rows)
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want
    made = html_extract.templates(df).collect()
    steps = html_extract.rounds(made[0].steps)
    assert len(steps) == 2  # sections, then boxes
    # by brute force: with these rounds, no role that half of the pages share has several places
    at: dict = {}
    for _, _, x in rows:
        roles = html_extract.page_roles(list(html_extract.events(x)))
        for classes in steps:
            roles = html_extract.told_apart(roles, classes)
        for r, n in Counter(roles).items():
            at.setdefault(r, []).append(n)
    assert {r for r, n in at.items() if n == [1] * 6 and r % 2 == 0} <= set(made[0].frame)


def test_names_do_not_empty_a_page(spark):
    rng = random.Random(13)
    body = [H.sentence(rng, 30) for _ in range(6)]
    text = "<h1>Title</h1>" + "".join(f"<p>{b}</p>" for b in body)
    shapes = [f'<body class="single no-sidebar">{text}</body>', f'<body class="search">{text}</body>',
              f'<body class="comments-open"><article class="post legal">{text}</article></body>',
              f'<div id="page-search-results">{text}</div>', f'<div id="search">{text}</div><div class="ad">Buy</div>',
              f'<form id="aspnetForm">{text}</form>', f'<html id="menu"><main class="side">{text}</main></html>',
              f'<article><div class="side-by-side">{text}</div></article><div class="comments">{H.sentence(rng, 20)}</div>']
    rows = [(i, None, s) for i, s in enumerate(shapes)]
    # with a template: an element of a listed name around all slots but one
    rows += [(100 + i, f"http://a.example/{i}", f'<html><body><div id="overlay"><div id="a"><p>{H.sentence(rng, 9)} {i}</p></div>'
              f'<div id="b"><p>more {i}</p></div></div><div class="share">Share {i}</div></body></html>') for i in range(5)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    for i in range(len(shapes)):
        assert got[i] == "\n\n".join(["Title", *body]), shapes[i][:60]
    assert all(got[100 + i].endswith(f"{i}\n\nmore {i}") for i in range(5))
