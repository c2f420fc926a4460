"""Sharding, token files, decontamination, PII, BPE, line quality, HTML and toxicity on odd and skewed rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phenogrid.llm import byte_bpe, decontaminate, html_text, pii, quality_lines, sharding, token_files, toxicity
from phenogrid.session import scratch_path
from tests_llm_plain import plain_hits

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Ünïcode ß 漢字 \U0001f600 é"), (5, "a" * 5000), (6, "x\x1cy\x85z　w v"), (None, "no id"), (7, "it's 12 o'clock"), (7, "it's 12 o'clock")]


# sharding

def test_table_is_even_and_moves_little():
    a = sharding.fill_table(sharding.shard_names(64))
    shares = Counter(a)
    assert set(a) == set(range(64)) and max(shares.values()) - min(shares.values()) <= 1
    b = sharding.fill_table(sharding.shard_names(65))
    assert sum(x != y for x, y in zip(a, b)) < 0.1 * len(a)
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"], 7)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 8)


def test_placing_and_writing(spark, docs_of):
    docs = docs_of(ODD).withColumn("shard", F.lit("clash"))
    placed = sharding.place(docs, sharding.document_key(), sharding.shard_names(5), 31)
    owner = sharding.fill_table(sharding.shard_names(5), 31)
    rows = placed.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        key = str(r["doc_id"]) if r["doc_id"] is not None else hashlib.md5(r["text"].encode()).hexdigest()
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 31
        assert (r["slot"], r["shard"]) == (slot, f"shard-{owner[slot]:05d}")
    path = scratch_path(spark, "shards")
    sharding.write_shards(placed, path)
    back = spark.read.schema(placed.schema).parquet(path)
    assert sorted(map(repr, back.select(placed.columns).collect())) == sorted(map(repr, rows))
    assert sharding.place(docs.limit(0), sharding.document_key(), sharding.shard_names(2), 7).collect() == []


# token files

def test_token_store_round_trip(spark, docs_of):
    path = scratch_path(spark, "tokens")
    docs = docs_of(ODD + [(i, f"word{i} and it's <|endoftext|> ÉCOLE İ Σς {i}") for i in range(30, 10, -1)]).repartition(4)
    manifest = token_files.write_store(docs, path, WORDS, end_id=2)
    tokenizer = Tokenizer.from_file(WORDS)
    got = token_files.read_store(spark, path).collect()
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got][0] is None and [r["doc_id"] for r in got[1:]] == sorted(r["doc_id"] for r in got[1:])
    want = sorted((i or -1, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in docs.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] or -1, tuple(np.frombuffer(r["token_ids"], "<u4").tolist())) for r in got) == want
    assert manifest["width"] == 2 and sum(p["n_ids"] for p in manifest["parts"]) == at
    assert manifest == token_files.read_manifest(path)


def test_token_store_of_an_empty_table(spark, docs_of):
    path = scratch_path(spark, "tokens")
    assert token_files.write_store(docs_of(ODD).limit(0), path, WORDS, end_id=2)["parts"] == []
    assert token_files.read_store(spark, path).collect() == []


def test_encoder_keeps_right_ids_when_its_cache_turns_over(monkeypatch):
    monkeypatch.setattr(token_files, "_CACHED", 50)
    encode, tokenizer = token_files.Encoder(WORDS, True), Tokenizer.from_file(WORDS)
    r = random.Random(1)
    for _ in range(60):
        text = " ".join(str(r.randrange(300)) for _ in range(40))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# decontamination

@pytest.mark.parametrize("block", [1, 100_000])
def test_contamination(spark, docs_of, block):
    r = random.Random(3)
    words = ["ein", "Zwei", "drei", "vier4", "fünf", "ß"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (3, None), (4, "?!"), (12, "Ein"), (5, text(25)), (6, text(25))]
    items.append((7, items[0][1].upper().replace("SS", "ß")))
    rows = ODD[:6] + [(20 + i, text(r.randint(0, 60))) for i in range(20)] + [(60, text(5) + items[0][1] + text(4) + items[5][1]), (61, items[0][1] * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs_of(rows), bench, block_windows=block)
    for x in found.collect():
        c = x["contamination"]
        assert (c["n_words"], c["n_hit"], c["item_ids"]) == plain_hits(x["text"], items), x["doc_id"]
        inside = [(m.start(), m.end()) for m in decontaminate._PLACED.finditer(x["text"] or "")]
        assert sum(any(s["start"] <= a and b <= s["stop"] for s in c["spans"]) for a, b in inside) == c["n_hit"]


def test_empty_benchmark_and_documents(spark, docs_of):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    clean = decontaminate.find_contamination(docs_of(ODD), bench.limit(0)).collect()
    assert len(clean) == len(ODD) and all(x["contamination"]["n_hit"] == 0 for x in clean)
    assert decontaminate.find_contamination(docs_of(ODD).limit(0), bench).collect() == []


# personal data

def plain_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [(pii.BASE[k], s, e) for s, k, e in sorted(out)]


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(8)
    bits = ["a", "b.c", "@", "x@y.de", ".", "_", "1", "22", "255", "300", "4111 1111 1111 1111", "+1 (415) 555-0199", "-", " ", "é", "\U0001f600", "+", "10.0.0.1", "%"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert [s[:3] for s in pii.spans_of(t) if s[0] in pii.BASE] == plain_base(t), t


def test_checksums_context_and_long_runs():
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 AND MORE") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789 of") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("call 415-555-0199 now") == ["tel"] and kinds("item 415-555-0199") == []
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 100_000, "+1" * 100_000, "1.1." * 50_000, "A1 " * 60_000):
        pii.spans_of(t)


def test_redaction(docs_of):
    rows = [(i, t) for i, t in ODD] + [(50, "mail a.b@c.org or 10.1.2.3 é"), (51, "x+1@y.co")]
    got = {(r["doc_id"], r["text"]) for r in pii.redact(docs_of(rows)).collect()}
    assert got == {*ODD, (50, "mail [EMAIL] or [IP] é"), (51, "[EMAIL]")}
    assert pii.redact(docs_of(ODD).limit(0)).collect() == []
    spans = {r["doc_id"]: r["s"] for r in docs_of(rows).select("doc_id", pii.span_text(pii.find_spans(F.col("text"))).alias("s")).collect()}
    assert spans[50] == "email:5:14,ip:18:26" and spans[1] == ""


# byte-level BPE

def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_merges_of_the_expression_and_of_the_worker(spark):
    plain, ranks = reference(), byte_bpe.read_ranks(RANKS)
    r = random.Random(4)
    words = ["", "a", "é", "ab", "aa" * 20, "漢字", "\U0001f600", " the", "\n\n", *("".join(r.choice("abcdeé 1-") for _ in range(r.randint(1, 20))) for _ in range(60))]
    got = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").select("w", byte_bpe.fold_merges(F.col("w"), ranks).alias("ids")).collect()
    for x in got:
        if x["w"] is None:
            assert x["ids"] is None
        else:
            assert x["ids"] == plain._encode_single_piece(x["w"]) if x["w"] else x["ids"] == []
            if x["w"]:
                assert byte_bpe.merge_word(x["w"].encode(), ranks) == x["ids"]


@pytest.mark.parametrize("frequent", [0, 3, byte_bpe.FREQUENT])
def test_encoding_and_decoding(spark, docs_of, frequent):
    plain = reference()
    r = random.Random(6)
    alphabet = "ab '  \n\t\r\x0b\x1c\x85\xa0 　é漢字ß\U0001f6001٣.,-#s'll​"
    rows = ODD + [(100 + i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))) for i in range(200)] + [(400, "the cat " * 4000)]
    for x in byte_bpe.encode(docs_of(rows), RANKS, public_tokenizers.PATTERN, frequent=frequent).collect():
        assert x["bpe"]["token_ids"] == plain.encode_ordinary(x["text"] or ""), x["doc_id"]
        assert bytes(x["bpe"]["decoded"]).decode() == (x["text"] or "")
    assert byte_bpe.encode(docs_of(ODD).limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_frequent_words_are_the_most_frequent(docs_of):
    docs = docs_of([(i, "x" + " top" * 8 + " mid" * 4 + " low" + f" only{chr(97 + i)}") for i in range(20)])
    got = lambda most: {r["word"]: r["n"] for r in byte_bpe.frequent_words(docs, public_tokenizers.PATTERN, most=most).collect()}
    assert got(2) == {" top": 160, " mid": 80} and got(1) == {" top": 160}
    assert got(4) == {" top": 160, " mid": 80, " low": 20, "x": 20}


# line quality

def test_line_frequency(spark, docs_of):
    body = "\n".join(f"line {k} " + " ".join(f"word{k}x{j}" for j in range(12)) for k in range(6))
    rows = [(i, f"Shared   LINE here\n{body.replace('word', f'w{i}q').replace('line', f'l{i}')}") for i in range(30)]
    rows += [(100 + i, "\n".join(["shared line here"] * 20 + [f"own{i} words"])) for i in range(3)]
    rows += [(200 + i, rows[0][1]) for i in range(25)] + [(None if i is None else i + 1000, t) for i, t in ODD]
    got = {r["doc_id"]: r for r in quality_lines.judge(docs_of(rows)).collect()}
    # a page in 26 documents has only frequent lines; those of the others but one are their own
    assert all(got[i]["kept"] for i in range(1, 30)) and not any(got[i]["kept"] for i in [0, *range(200, 225)])
    assert not any(got[i]["base_failed"] for i in [0, *range(200, 225)]) and got[0]["clean_text"] == ""
    assert not any(got[100 + i]["kept"] for i in range(3)) and not any(got[100 + i]["base_failed"] is None for i in range(3))
    assert got[1]["clean_text"] == rows[1][1].split("\n", 1)[1] and got[1001]["n_words"] == 0 and got[1001]["base_failed"]
    assert got[None]["n_words"] == 2 and got[1005]["word_chars"] == 5000
    # the same line in few texts of another host stays
    other = docs_of(rows[:30], source=lambda i: f"host{i % 3}")
    assert {r["clean_text"] for r in quality_lines.judge(other).collect()} == {t for _, t in rows[:30]}
    assert quality_lines.judge(docs_of(ODD).limit(0)).collect() == []


def test_lines_count_documents(docs_of):
    """Copies count as often as they occur; rows with the same id once, rows without an id each."""
    rows = [(i, "a page of many copies\nand its second line") for i in range(100)] + [(500, "one id\n again")] * 50 + [(None, "no id")] * 21
    got = {r["line"]: r["n_docs"] for r in quality_lines.frequent_lines(docs_of(rows)).collect()}
    assert sorted(got.values()) == [21, 100, 100]
    clash = docs_of(rows[:3])
    for name in ("host", "lines", "removed", "_id", "_content", "line", "_words", "_lines", "salt", "at", "content"):
        clash = clash.withColumn(name, F.lit("mine"))
    out = quality_lines.judge(clash)
    assert out.columns[:len(clash.columns)] == clash.columns and {r["host"] + r["_id"] for r in out.collect()} == {"minemine"}


def test_repeated_words_against_plain(docs_of):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 14)))) for i in range(150)] + [(900, "x y z " * 4000)]

    def plain(t):
        w = t.split()
        g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        n = Counter(g)
        return len({j for i, x in enumerate(g) if n[x] > 1 for j in range(i, i + 3)})

    for x in quality_lines.base_measures(docs_of(rows)).collect():
        assert x["n_repeat_words"] == plain(x["text"]), x["text"][:80]


# pages

def test_layout():
    assert html_text.visible_text(
        "<head><title>no</title></head><h1>T &amp; t</h1><p>a<p>b <b>c</b>d<ul><li>x<li>y<ol start=3><li>z</ol></ul>"
        "<table><tr><th>aa<th>b<tr><td>c<td>dd</table><pre> k\n  l</pre><div hidden>no</div><i style='Display : none'>no</i>t<br>u<!-- no -->"
        "<script>'</p>'</script></nothing>v") == "T & t\n\na\n\nb cd\n\n- x\n- y\n  3. z\n\naa  b\nc   dd\n\n k\n  l\n\nt\nuv"


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b > c", "<!doctype html", "</p></div>", "<table><td>x", "<li>a<li>b", "<select><option>1<option>2",
                                  "<div>" * 3000 + "deep", "<ul><li>" * 500 + "deep", "<b>" * 2000 + "x", "<script>never closed", "&#0; &bogus; &#x110000;"])
def test_odd_pages(page):
    assert isinstance(html_text.visible_text(page), str)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "<p>a", "old"), (3, "<p>a", "old"), (4, "<p>" + "w " * 200_000, "old")], "page_id long, html string, text string")
    got = sorted((r["page_id"], r["text"] if r["text"] is None else r["text"][:3]) for r in html_text.extract(pages).collect())
    assert got == [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "w w")]
    assert html_text.extract(pages.limit(0)).collect() == []


# toxicity

def test_toxic_expressions_are_learned(spark, docs_of):
    r = random.Random(11)
    plain = ["the", "house", "garden", "river", "stone", "morning", "water", "little", "green", "walking"]
    bad = ["vexgrumble", "vexgrumbles", "vexgrumbling", "vexgrumbled"]

    def text(toxic, forms):
        w = [r.choice(plain) for _ in range(60)]
        for _ in range(3 * toxic):
            w[r.randrange(60)] = r.choice(forms)
        return " ".join(w)

    rows = [(i, text(i % 4 == 0, bad[:3])) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(9999, 1), (None, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(rows), labels, may_learn=F.col("doc_id") % 5 != 0)
    # a form that was never seen shares the evidence of the others
    new = [(1000 + i, text(i % 2 == 0, bad[3:])) for i in range(40)] + ODD
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs_of(new), model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 40 + len({i for i, _ in ODD})
    assert all((got[1000 + i] >= 0.5) == (i % 2 == 0) for i in range(40))
    assert all(got[i] < 0.5 for i in (1, 2, 3))


def test_ratios_are_finite():
    counts = {"^^^a": (3, 1), "^^^b": (1, 9), "^^ab": (2, 2), "^abc": (0, 4), "^^ba": (5, 0), "^^^$": (1, 1)}
    grams, contexts = toxicity._ratios(counts, 0.75)
    assert set(grams) == set(counts) and all(np.isfinite(v) for v in [*grams.values(), *contexts.values()])


def test_without_labels_of_both_classes(spark, docs_of):
    docs = docs_of(ODD)
    for labels, want in (([], 0), ([(4, 0)], 0), ([(4, 1)], 1)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {round(x["score"]) for x in toxicity.score(docs, model).collect()} == {want}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    part = toxicity.in_part("doc_id", 5)
    scored = toxicity.score(docs, toxicity.fit(docs, labels, may_learn=part != 0)).where(part == 0).join(labels, "doc_id").toPandas()
    right = (scored["score"] >= 0.5) == (scored["toxic"] == 1)
    assert right.mean() > 0.93 and right[scored["toxic"] == 0].mean() > 0.97 and right[scored["toxic"] == 1].mean() > 0.5


def test_crc_part(spark, docs_of):
    got = docs_of(ODD).select("doc_id", toxicity.in_part("doc_id", 5).alias("p")).collect()
    assert all(r["p"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5) for r in got)


def test_words_encoded_together_give_the_library_ids():
    from phenogrid.llm.token_files import Encoder, splits_at_blanks

    encode, tokenizer = Encoder(WORDS, False), Tokenizer.from_file(WORDS)
    r = random.Random(11)
    alphabet = "abcXYZéÉß×漢İΣς'’.,!-1²é\U0001f600_<|>"
    texts = [" ".join("".join(r.choices(alphabet, k=r.randint(1, 9))) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += ["<|endoftext|> a <|startoftext|>b", "x" * 3000, None, "", "a\x1cb c\x85d e　f"]
    for text, ids in zip(texts, encode.encode_all(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
    # a vocabulary whose tokens hold the blank before a word is given whole texts
    blanks = public_tokenizers.path("byte_bpe_50k.json")
    assert splits_at_blanks(encode) and not splits_at_blanks(Encoder(blanks, False))
    whole = Encoder(blanks, False, False)
    assert np.frombuffer(whole("a  text of words"), "<u2").tolist() == Tokenizer.from_file(blanks).encode("a  text of words", add_special_tokens=False).ids
