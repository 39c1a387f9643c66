"""Quality, main text, near-duplicates, packing, encoding and token counts against plain Python and the libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievelight.llm import chosen_path, components, distribution_quality, host_suffixes, online_packing, speculative_bpe, token_transducer
from sievelight.llm.queries import vocabulary_file

BLANK = r"[^\x20\x09-\x0D]+"


def test_quality_base(docs, data, nothing):
    out = {r["doc_id"]: r for r in distribution_quality.judge(docs).collect()}
    for key, text, *_ in data:
        words = re.findall(BLANK, text or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        seen, doubled = set(), 0
        for line in (text or "").split("\n"):
            if re.search(BLANK, line):
                doubled += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        got = out[key]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"], got["base_failed"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(covered), failed)
        assert not (failed and got["kept"])
    assert distribution_quality.judge(nothing).count() == 0


def test_quality_verdict(spark):
    rnd = random.Random(3)
    common = distribution_quality.COMMON_WORDS["en"].split()
    clean = [" ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(150)) for _ in range(60)]
    junk = [" ".join(w + "%%%$$$###" for w in clean[0].split()), " ".join(str(rnd.randrange(10**8)) for _ in range(120))]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["kept"] for r in distribution_quality.judge(df).collect()}
    assert all(out[i] for i in range(60)) and not out[60] and not out[61]


def test_quality_of_common_words(spark):
    """With as few common words as in the test tables, texts without any, or in another language, go; clean ones stay."""
    rnd = random.Random(4)
    other = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    prose = lambda lang, n: " ".join(rnd.choice(distribution_quality.COMMON_WORDS[lang].split()) if rnd.random() < 0.22 else other() for _ in range(n))
    clean = [(prose(g, 250), g) for g in ("en", "fr", "de", "es") for _ in range(40)]
    bad = [(" ".join(other() for _ in range(n)), g) for g in ("en", "fr", "de", "es") for n in (120, 900)] + [(prose("de", 250), "en"), (prose("en", 250), "fr"), (prose("en", 250), "es")]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(clean + bad)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in distribution_quality.judge(df).collect()}
    assert all(out[i]["kept"] for i in range(len(clean)))
    assert all(not out[i]["kept"] and not out[i]["base_failed"] and out[i]["class_distance"] <= distribution_quality.MOST_CLASSES for i in range(len(clean), len(out)))


def shingles(text):
    words = re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(data):
    sets = {r[0]: shingles(r[1]) for r in data if r[0] is not None}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_near_duplicates(docs, data, nothing):
    want = brute_force(data)
    out = chosen_path.near_groups(docs).collect()
    assert len(out) == len(data)
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    assert chosen_path.near_groups(nothing).count() == 0
    assert len({want[r["doc_id"]][1] for r in chosen_path.keep_one(docs).filter("doc_id is not null").collect()}) == len({c for _, c in want.values()})


def test_large_groups_of_near_copies(spark):
    """A node far over the leaf size: chains of edits whose ends aren't linked, beside unlinked texts with the same passage."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(7))
    base, out = [word() for _ in range(120)], []
    for i in range(90):
        out.append((i, " ".join(base)))
        base[rnd.randrange(120)] = word()
    passage = [word() for _ in range(40)]
    out += [(100 + i, " ".join(passage + [word() for _ in range(25)])) for i in range(60)]
    want = brute_force(out)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in chosen_path.near_groups(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) < 100


def planted_pairs(n, rnd, line=True):
    """``n`` pairs just over and just under the limit around one hot passage, beside a hot group of near copies and unrelated texts with the passage."""
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(7))
    passage = [word() for _ in range(40)]
    out = []
    for i in range(n):
        own = [word() for _ in range(60)]
        other = own[: 60 - 2 - i % 12] + [word() for _ in range(2 + i % 12)]
        out += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + other))]
    base = passage + [word() for _ in range(60)]
    for i in range(n):
        out.append((10_000 + i, " ".join(base[:99] + [word()])))
        out.append((20_000 + i, " ".join(passage + [word() for _ in range(30)])))
    return out


@pytest.mark.parametrize("last", [False, True])
def test_recall_around_a_hot_passage(spark, monkeypatch, last):
    """Every link is found; with no node small and one level, by the exact join alone."""
    if last:
        for name, value in (("LEAF", 0), ("LINEAR", 0), ("LEVELS", 1), ("LARGE", 4)):
            monkeypatch.setattr(chosen_path, name, value)
    rows = planted_pairs(60, random.Random(6))
    want = brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in chosen_path.near_groups(df).collect()}
    assert got == want and 30 < sum(k != c for k, (_, c) in want.items()) < 120


def test_near_duplicates_of_null_and_repeated_keys(spark):
    rnd = random.Random(7)
    text = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[0] + " x"), (None, text[1]), (5, text[2]), (5, text[3]), (7, text[3] + " y"), (8, text[4]), (8, text[4]), (None, text[2] + " z"), (None, None), (9, "")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, _mark string")
    kept = chosen_path.keep_one(df)
    assert kept.columns == df.columns
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert left == Counter([next(x for x in rows[:2] if x in left), rows[2], rows[3], rows[4], rows[6], rows[9], rows[10]])
    strings = df.selectExpr("concat('k', doc_id) AS doc_id", "text")
    assert {r["component_id"] for r in chosen_path.near_groups(strings).filter("doc_id = 'k7'").collect()} == {"k5"}


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(out.values()) == {0, 100} and out[50] == 0 and out[139] == 100
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, data, nothing):
    from tokenizers import Tokenizer

    file = vocabulary_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    out = online_packing.pack(docs, file, windows=3, meet=2).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
    repeated = Counter(r[0] for r in data)
    for key, text, *_ in data:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[key], key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) * repeated[key] and all(r["doc_tokens"] == len(ids) for r in mine)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r["start"] : r["start"] + r["length"]]))
    assert online_packing.pack(nothing, file).count() == 0


ODD = ["", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "  x", "x  ", "a" * 5000, " " * 500, "\n\n\n", "don't we'll  I'm", "<s></s><unk><0x41>", "▁▁x ▁", " " * 33 + "zz1", "中文🙂é́\x1c\x85\xa0 zzz", "①²½ Ⅷ", "x" * 70_000 + " " * 20 + "y"]


def odd_texts():
    rnd = random.Random(1)
    letters = "ab the ing\n\t 　é'sll1239!!<|endoftext|>中文🙂́\x1c\x85\xa0▁ zzz"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(400)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd_texts())] + [(-1, None, 1)], "doc_id long, text string, n_tokens int")


def test_encoding(odd):
    from tokenizers import Tokenizer

    file = vocabulary_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    out = {r["doc_id"]: r for r in speculative_bpe.encode_documents(odd, file, speculative_bpe.PATTERN).collect()}
    for i, t in [*enumerate(odd_texts()), (-1, "")]:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = speculative_bpe.encode_documents(odd, file, speculative_bpe.PATTERN, digests=False)
    back = {r["doc_id"]: r["decoded"] for r in speculative_bpe.decode_documents(whole, file).collect()}
    assert all(back[i] == t for i, t in enumerate(odd_texts()))


def test_token_counts(odd):
    import sentencepiece

    file = vocabulary_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    out = {r["doc_id"]: r for r in token_transducer.count_tokens(odd, file, 50).collect()}
    for i, t in [*enumerate(odd_texts()), (-1, "")]:
        n = len(model.encode(t))
        assert (out[i]["n_tokens"], out[i]["n_bytes"], out[i]["over_limit"]) == (n, len(t.encode()), n > 50), t[:50]


def test_chunk_maps_compose_in_any_order(monkeypatch):
    file = vocabulary_file("piece_bpe_32k.model")
    counter = token_transducer.Counter(file)
    text = "the quick  brown fox▁ jumps " * 40 + "x" * 300 + " end"
    want = counter.count(text)
    for size in (1, 3, 7, 50, 1000):
        monkeypatch.setattr(token_transducer, "CHUNK", size)
        assert token_transducer.Counter(file).count(text) == want


PAGES = [
    ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n text<br>more</p><p>Second</article><footer>f</footer>", "Head & line\nFirst bold text more\nSecond"),
    ("<body><header>Site</header><main><p>One</p><aside>side</aside><form><p>mail</p></form><ul><li>a<li>b</ul></main><div id='comments'><p>nice</p></div></body>", "One\na\nb"),
    ("<article><header><h1>Own head</h1></header><p>Text</p><div class='cookie-notice'>ok</div><section class='comments'><p>reader</p></section><!-- x --></article>", "Own head\nText"),
    ("", ""),
    (None, ""),
    ("plain &lt;text&gt; only", "plain <text> only"),
    ("<p>cut <b", "cut"),
    ("<div><p>a &am; &amp b</p></div>", "a &am; & b"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"https://h{i}.org/x", h, "t") for i, (h, _) in enumerate(PAGES)] + [(99, None, "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in host_suffixes.main_text(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert out[i]["text"] == want and out[i]["n_chars"] == len(want)
    assert out[99]["text"] == "x" and host_suffixes.main_text(df.limit(0)).count() == 0


def test_host_boilerplate(spark):
    page = lambda i: f"<body><div>Welcome to the big site of all things</div><div>Menu of this place here now</div><p>Only page {i} says thing number {i * 7} and {i * 13} in its own words</p><div>Written by editor{i} whose rights are with the owners of this old site and nobody else</div></body>"
    same = "<article><p>The very same article on every page of this host, again and again.</p></article>"
    mirror = "<div>A text in plain blocks that is mirrored as it is on many pages of one host</div><div>And its second block here</div>"
    around = lambda i: f"<div><h1>Title out {i}</h1><p>Lead para outside {i}</p><article><p>Body {i} with words</p><p>Subscribe to our paper now</p></article><p>Tail para {i}</p><p>Read more here</p></div>"
    sets = [("one", page, 300), ("two", lambda i: same, 20), ("three", lambda i: mirror, 5), ("four", around, 40)]
    rows = [(1000 * k + i, f"https://{h}.org/p", f(i)) for k, (h, f, n) in enumerate(sets) for i in range(n)] + [(None, f"https://four.org/p{i}", around(50)) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = host_suffixes.main_text(df, group=40).collect()
    out = {r["page_id"]: r["text"] for r in got}
    assert all(out[i] == f"Only page {i} says thing number {i * 7} and {i * 13} in its own words\nWritten by editor{i}" for i in range(300))
    assert all("very same article" in out[1000 + i] for i in range(20)) and all(out[2000 + i].count("block") == 2 for i in range(5))
    assert all(out[3000 + i] == f"Title out {i}\nLead para outside {i}\nBody {i} with words\nTail para {i}" for i in range(40))
    assert len(got) == len(rows) and sum(r["page_id"] is None and "Body 50" in r["text"] for r in got) == 3


def test_repeated_runs_against_brute_force():
    rnd = random.Random(8)
    for _ in range(40):
        run = [rnd.choice("abcdefgh") * 2 for _ in range(6)]
        pages = [[[rnd.choice("abc") for _ in range(rnd.randrange(0, 9))] + (run if rnd.random() < 0.5 else []) + [rnd.choice("abc") for _ in range(rnd.randrange(6))] for _ in range(rnd.randrange(1, 3))] for _ in range(rnd.randrange(1, 7))]
        same = [rnd.randrange(6) for _ in pages]
        held = defaultdict(set)
        for p, s in zip(pages, same, strict=True):
            for b in p:
                for i in range(len(b) - 3):
                    held[tuple(b[i : i + 4])].add(s)
        want = [[[any(0 <= k <= len(b) - 4 and k <= i < k + 4 and len(held[tuple(b[k : k + 4])]) >= 3 for k in range(i - 3, i + 1)) for i in range(len(b))] for b in p] for p in pages]
        assert host_suffixes.repeated(pages, same, 4, 3) == want


def test_runs_of_three_pages_whatever_the_groups(spark, monkeypatch):
    rnd = random.Random(12)
    runs = [[f"r{k}w{j}" for j in range(8 + k)] for k in range(12)]
    blocks = [[f"own{i}a{j}" for j in range(rnd.randrange(1, 5))] for i in range(90)]
    for k, r in enumerate(runs):
        for i in rnd.sample(range(90), 2 + k % 2):  # on two pages or on three
            blocks[i] += [*r, f"gap{i}g{k}"]
    blocks.append(["seen", *"a banner that is one whole block on three pages".split(), "here"])
    pages = [[b] for b in blocks] + [["a banner that is one whole block on three pages".split(), [f"rest{i}"]] for i in range(3)]
    held = defaultdict(set)
    for p, page in enumerate(pages):
        for b in page:
            for i in range(len(b) - 7):
                held[tuple(b[i : i + 8])].add(p)
    gone = lambda b, i: any(0 <= k <= len(b) - 8 and len(held[tuple(b[k : k + 8])]) >= 3 for k in range(i - 7, i + 1))
    want = ["\n".join(filter(None, (" ".join(w for i, w in enumerate(b) if not gone(b, i)) for b in page))) for page in pages]
    assert want[90] == "seen here" and any("r1w0" in b and "r1w0" not in w for b, w in zip(blocks, want)) and any("r0w0" in w for w in want)
    pages, want = pages + pages[:40] * 3, want + want[:40] * 3  # copies count once
    rows = [(i if i % 9 else None, f"https://h.org/{i}", "".join(f"<div>{' '.join(b)}</div>" for b in page)) for i, page in enumerate(pages)]
    df = spark.createDataFrame([*rows, (1000, "https://other.org", "<p>" + " ".join(runs[0]) + "</p>")], "page_id long, url string, html string").repartition(3)
    for group, most in ((128, 500_000), (7, 0), (1, 500_000)):
        monkeypatch.setattr(host_suffixes, "MOST_HOSTS", most)
        got = {r["url"]: r["text"] for r in host_suffixes.main_text(df, group=group).collect()}
        assert got == {f"https://h.org/{i}": w for i, w in enumerate(want)} | {"https://other.org": " ".join(runs[0])}, group


def test_deep_and_unclosed_markup_in_linear_time():
    import time

    start = time.time()
    assert host_suffixes.blocks("<div>" * 60_000 + "x")[0][0] == "x" and host_suffixes.blocks("<b>" * 30_000 + "<p>y</p></i>" * 30_000)[0][0] == "y"
    assert time.time() - start < 8
