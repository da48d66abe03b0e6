"""Token counts, byte-level BPE, language ID and HTML extraction against libraries, held-out rows and hand-made pages."""

import hashlib
import random
import string
import time
import zlib

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from arbora.llm import bpe, common, html, langid, tokens  # noqa: E402

TEXTS = ["Hello, World! it's 12 o'clock.", "", None, "   \n\n a  b\t\n", "ÉTÉ naïve — 日本語 👍🏽", "a" * 3000, "'s's 'S 've'", "<|endoftext|> x <|startoftext|>", "x́y  z w", "Hello, World! it's 12 o'clock."]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, _id string")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_token_counts(docs):
    own = library()
    got = {r["doc_id"]: r for r in tokens.token_counts(docs, P.path("word_bpe_49k.json"), limit=100).collect()}
    for i, t in enumerate(TEXTS):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100)
    assert tokens.token_counts(docs.where("false"), P.path("word_bpe_49k.json")).count() == 0


def test_chunks_are_spliced_where_both_agree():
    own, r = library(), random.Random(3)
    c = tokens.Counter(P.path("word_bpe_49k.json"), chunk=200, overlap=16)
    texts = ["".join(r.choice(["the ", "Q", "é", "zzz", " ", "\n", "'re", "12", "<|endoftext|>", "!?"]) for _ in range(r.randint(100, 900))) for _ in range(40)]
    for t in [*texts, "x" * 3000, "é" * 900 + " end"]:
        assert c.huge(t) == len(own.encode(t, add_special_tokens=False).ids)
    assert c.widened > 0


def test_texts_without_white_space_take_linear_time():
    """Digits and signs are boundaries, too; where there is none at all the chunk grows, so nothing is encoded again from the start."""
    own, r = library(), random.Random(5)
    c = tokens.Counter(P.path("word_bpe_49k.json"), chunk=1 << 12, overlap=64)
    alphabet = string.ascii_letters + string.digits + "+/"
    for t in ("".join(r.choices(alphabet, k=60_000)), "".join(r.choices("abcé|<>", k=30_000)), "na" * 20_000, "don't|<|endoftext|>x1" * 2000):
        assert c.huge(t) == len(own.encode(t, add_special_tokens=False).ids)
    took = []
    c = tokens.Counter(P.path("word_bpe_49k.json"))
    for n in (1, 4):
        began = time.perf_counter()
        c.huge("".join(r.choices(alphabet, k=n * 500_000)))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe(docs):
    own = encoding()
    for r in bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), with_ids=True).collect():
        t = TEXTS[r["doc_id"]] or ""
        ids = own.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert [own.decode_single_token_bytes(i) for i in ids] == [t.encode()[a:b] for a, b in zip(r["offsets"], [*r["offsets"][1:], len(t.encode())])]


def test_scan_finds_the_patterns_boundaries():
    import regex

    r, kinds = random.Random(5), bpe.classes()
    texts = ["".join(r.choice("'strevmldLL  \n\t a1é²!?.́\x1c\x85字'") for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", "\0", " \0 "]
    for t, own in zip(texts, bpe.pieces(texts, kinds)):
        assert own == regex.findall(P.PATTERN, t)


def words_of(seed: str, r: random.Random) -> str:
    return " ".join("".join(r.choice(seed.split()) for _ in range(r.randint(1, 3))) for _ in range(40))


def test_language(spark):
    r = random.Random(1)
    seeds = {"en": "the ing tion and ou re st", "de": "sch ung ein ich keit über ß", "fr": "eau que le é ment oi"}
    rows = [(i, words_of(seeds[k], r), k) for i, k in enumerate([*seeds] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, "Ж" * 300, None), (1004, rows[0][1], None), (1004, rows[0][1], None)]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, score double")
    got = langid.identify(df, common.remainder(F.col("doc_id"), 4) != 2).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows)
    held = [x for x in rows[:180] if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert sum(by[i]["lang_pred"] == k for i, _, k in held) / len(held) > 0.95
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["rejected"]
    assert not any(by[i]["rejected"] for i in range(180)) and all(0 <= x["score"] <= 1 for x in got)
    assert langid.identify(df, F.lit(False)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.where("false"), F.lit(True)).count() == 0


def test_slices_count_like_the_whole(monkeypatch):
    t = words_of("the é ß 12 , x", random.Random(2)) * 5
    whole = langid.counts(t)
    monkeypatch.setattr(langid, "SLICE", 37)
    parts = langid.counts(t)
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><div id=header><h1>Site</h1></div><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="wrap"><div class="sidebar"><p>%s</div><div class="post post-%d"><h2>Title &amp; more</h2><div class="entry"><p>First  para<br>of %d
<a href=x>link</a>.<p>Second &lt;b&gt;&nbsp;para.<script>var a="<p>no</p>"</script><div class="ad">Buy</div><form><p>Mail</p></form></div></div>
<div id="comments"><p>I like it, a long comment that says a lot about nothing at all</p></div></div><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"https://h.example/{i}", PAGE % ("aside " * (1 + 90 * (i == 3)), i, i), "t") for i in range(6)] + [(10, None, None, "t"), (11, "nope", "", "t"), (12, "https://other/", "just text", "t"), (12, "https://other/", "just text", "t")]
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(pages)
    for i in range(6):
        assert by[i]["text"] == f"Title & more\nFirst para of {i} link.\nSecond <b> para."
        assert by[i]["n_chars"] == len(by[i]["text"])
    assert by[10]["text"] == by[11]["text"] == "" and by[12]["text"] == "just text"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("bad", ["<", "<p", "<p><div></p></span>", "<a href='x", "<!-- x", "<script>a", "<![CDATA[x", "<" * 500, "<div>" * 3000 + "deep", "&#99999999; &bogus; &amp", "<p>퟿</p>"])
def test_any_text_is_a_page(bad):
    assert isinstance(html.extract(bad, None), str)


LONG = "The ferry was late, and the crew told us at length why it had been held up by the tide and the wind. " * 3


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div class='content-side'><h1>Ferry</h1><p>{LONG}</p></div><div class='x'><p>x</p></div>", ["Ferry", LONG.strip()]),
        (f"<article><header><h1>Ferry</h1><p>The lead.</p></header><p>{LONG}</p></article>", ["Ferry", "The lead.", LONG.strip()]),
        (f"<article><h1>Ferry</h1><div class='promotion-history'><p>Up twice.</p></div><section id='legal'><p>Laws.</p></section><p>{LONG}</p></article>", ["Ferry", "Up twice.", "Laws.", LONG.strip()]),
        (f"<article><h1>Ferry</h1><div class='promo'><p>Buy!</p></div><div class='relatedPosts'><p>More</p></div><p>{LONG}</p><p class='ad'>Buy</p><div class='share-buttons'>Tell</div></article><div class='comment-list'><p>{LONG}</p></div>", ["Ferry", LONG.strip()]),
        ("<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000 + "<footer>Us</footer>", [LONG.strip()]),
    ],
)
def test_names_and_depth_drop_no_article_text(body, want):
    page = f"<html><body>{body}</body></html>"
    assert html.extract(page, None).split("\n") == want
    votes = html.ballots(page)
    assert html.extract(page, max(votes, key=lambda v: v[1])[0]).split("\n") == want


def test_pages_of_several_hosts_give_what_they_were_made_of(spark):
    """Generated pages: each host has a template, whose parts and article are known."""
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    templates = [
        "<body><div class='top-nav'>{m}</div><div id='c{i}'><h1>{t}</h1><div class='text'>{p}</div></div><div class='footer'>{f}</div></body>",
        "<body><header>{f}</header><main><article>{p}</article><aside>{m}</aside></main><footer>{f}</footer></body>",
        "<body><table><tr><td class='menu'>{m}<td class='body'>{p}</table><div class='cookie-bar'>{f}</div></body>",
        "<body><div class='a'><div class='b post-{i}'>{p}<div class='comments'><p>{f}</p></div></div></div></body>",
    ]
    pages, want = [], {}
    for k, template in enumerate(templates):
        menu, foot = "".join(f"<a href=/>{say(1)}</a> " for _ in range(8)), say(12)
        for i in range(12):
            parts, title = [say(r.randint(5, 60)) for _ in range(r.randint(1, 9))], say(3)
            n = 100 * k + i
            pages.append((n, f"http://h{k}.example/{i}", template.format(m=menu, f=foot, t=title, i=i, p="".join(f"<p>{x}</p>" for x in parts))))
            want[n] = "\n".join(parts if k else [title, *parts])
    got = {x["page_id"]: x["text"] for x in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want
