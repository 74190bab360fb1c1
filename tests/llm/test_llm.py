"""The training-data operators against brute force, and on nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollmill.llm import queries as Q
from rollmill.llm.decontaminate import find_contamination
from rollmill.llm.license_scan import scan_notices
from rollmill.llm.packing import ByteBpe, pack_documents, pack_lengths
from rollmill.llm.quality import judge_quality
from rollmill.llm.simhash import components, covering_masks, fingerprint, keep_one, near_duplicates
from rollmill.llm.substring import difference_cover, remove_repeats
from rollmill.llm.suffix_dedup import remove_held_before, suffix_array
from rollmill.llm.token_counts import PieceCounter, count_tokens
from rollmill.llm.toxicity import score_toxicity, train
from rollmill.llm.url_filter import HostRule, judge_urls, mark_listed

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i * i % 9973}" for i in range(30_000))
CLASH = "n_words", "score", "fp", "pack", "part", "keys", "row", "_id", "_text", "kept"


@pytest.fixture(scope="module")
def edge(spark):
    """Null, empty, blank, short, very long and repeated rows, a null id, and columns with the operators' own names."""
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "word", "en"), (5, LONG, "de"), (6, LONG, "de"),
            (7, "é日本 x " * 30, None), (7, "é日本 x " * 30, None), (None, "no id here " * 20, "fr"), (9, "😀\x00 a", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("x") for c in CLASH})


def rows_of(df, *keys):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: str([r[k] for k in keys]))


def documents(spark, name="documents"):
    return [(r[0], r[1] or "") for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*(["doc_id", "text"] if name == "documents" else ["item_id", "text"])).collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_every_operator_takes_edge_rows_and_empty_tables(spark, edge):
    items = spark.createDataFrame([(1, "a word or two"), (None, None), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = train(edge, labels)
    made = {
        "scan": lambda d: scan_notices(d, Q.NOTICES), "pack": lambda d: pack_documents(d, BPE), "near": near_duplicates, "judge": judge_quality,
        "count": lambda d: count_tokens(d, PIECES), "repeats": lambda d: remove_repeats(d, with_text=True),
        "contaminated": lambda d: find_contamination(d, items), "toxic": lambda d: score_toxicity(d, model),
        "held": lambda d: remove_held_before(d, with_text=True),
    }
    for name, fn in made.items():
        got = rows_of(fn(edge), "doc_id")
        assert len({str(r["doc_id"]) for r in got}) == 9, name
        assert len(got) == 10 or name == "pack", name
        assert fn(edge.limit(0)).count() == 0, name


def test_notices(spark):
    cases = {
        "Under the MIT-License, under the mit license!": (2, ["mit"], [0, 4], []), "under th mit licence": (0, [], [], ["mit"]),
        "apache license version 1": (0, [], [], []), "Apache Licence, Version 2.0": (0, [], [], ["apache-2"]), "cc by nd": (0, [], [], []),
        "CC BY NC 4": (1, ["cc-by-nc"], [0], []), "thunder the mit license": (0, [], [], ["mit"]),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    for r, (n, labels, starts, near) in zip(rows_of(scan_notices(df, Q.NOTICES), "doc_id"), cases.values()):
        exact = [s for s in r["spans"] if not s["edits"]]
        assert (len(exact), [s["first_word"] for s in exact]) == (n, starts)
        assert sorted({s["label"] for s in exact}) == labels
        assert {s["label"] for s in r["spans"]} >= set(near)
    query = {r["doc_id"]: r for r in Q.op1_license_scan(spark, SF).collect()}
    for i, text in documents(spark):
        w = ALNUM_WORD.findall(lower(text))
        base = [(k, label) for p, label in Q.NOTICES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = query[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(base), ",".join(sorted({b for _, b in base})))
        assert (r["first_word"], r["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))


def test_urls(spark):
    urls = ["http://A.example.net/en/1", "https://net/x", "ftp://example.com/de/?q", "x", None, "http://foo.net", "http://anet/", "http://l.org/p/?b=2&utm_x=1&a=1#f",
            "http://www.l.org/p?a=1&b=2", "http://l.org/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("l.org/p?a=1&b=2",), ("l.org/p?a=1&b=2",), (None,)], "canonical string")
    got = rows_of(judge_urls(pages, listed, Q.URL_RULES), "page_id")
    assert [r["rule"] for r in got] == ["example.net/en/", "net/", "example.com/de/", None, None, None, None, None, None, None]
    assert [r["verdict"] for r in got] == ["allow", "block", "block", "allow", "allow", "allow", "allow", "block", "block", "allow"]
    assert (got[3]["host"], got[4]["path"], got[2]["path"]) == ("", "", "/de/")
    assert judge_urls(pages.limit(0), listed, [HostRule("a", "/", "block")]).count() == 0
    assert judge_urls(pages, listed.limit(0), []).where("listed").count() == 0


def test_bloom_filter_passes_all_listed(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("u"), F.pmod("id", F.lit(1000))).alias("key"))
    listed = spark.range(0, 1000, 3).select(F.concat(F.lit("u"), "id").alias("u"))
    for blocks in (1, 4096):
        got = mark_listed(rows, listed, key_col="key", listed_col="u", salt_col="id", max_blocks=blocks)
        assert got.count() == 3000 and got.where("listed <> (int(substr(key, 2)) % 3 = 0)").count() == 0


def test_ids_equal_the_library(spark):
    with open(BPE, encoding="utf-8") as f:
        text = f.read()
    ours, library, rnd = ByteBpe(text), Tokenizer.from_str(text), random.Random(3)
    texts = ["it's  we've I'LL", "<|endoftext|> a", "a😀b", "", "x'", LONG[:3000], *("".join(rnd.choice(" \n'\tsdtlrvem1a!é .\x1c\x85") for _ in range(12)) for _ in range(800))]
    ids, counts = ours.encode(texts)
    for part, t in zip(np.split(ids, np.cumsum(counts)[:-1]), texts):
        assert part.tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    rnd = random.Random(5)
    for _ in range(30):
        lengths = [rnd.choice([0, 1, 300, rnd.randint(1, 5000)]) for _ in range(rnd.randint(0, 60))]
        windows = pack_lengths(lengths, (256, 512, 1024, 2048))
        pieces = sorted(p for _, ps in windows for p in ps)
        for d, n in enumerate(lengths):
            at = 0
            for _, start, size in (p for p in pieces if p[0] == d):
                assert start == at and size
                at += size
            assert at == n
        assert sum(sum(p[2] for p in ps) != cap for cap, ps in windows) <= 1
    tk = Tokenizer.from_file(BPE)
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in Q.op3_packing(spark, SF).collect():
        by_doc[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, text in documents(spark):
        ids = np.array([*tk.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for rs in windows.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and rs[0]["padded_length"] == (at if at & (at - 1) == 0 else 2048)


def test_masks_cover_every_pair_in_the_radius():
    masks = covering_masks(2)
    assert len(masks) == 7
    assert all(any(not m & (1 << a | 1 << b) for m in masks) for a in range(64) for b in range(a + 1))


def test_simhash_by_brute_force(spark):
    prints = {}
    for i, text in documents(spark):
        w = words(lower(text))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in Q.op4_simhash(spark, SF).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", find(r["doc_id"]))
    assert fingerprint(b"") == fingerprint(b" \n") == 0


def test_crowded_buckets_and_long_chains(spark):
    from rollmill.llm.simhash import fingerprint_links

    prints = [1 << a | 1 << b for a in range(12) for b in range(a)] + [(1 << k) - 1 << 20 for k in range(0, 40, 2)] + [0xFFFF << 44]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in sorted(set(prints))], "fp long")
    root = {r["node"]: r["root"] for r in components(fingerprint_links(df)).collect()}
    near = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 2]
    assert near and all(root[a] == root[b] for a, b in near)
    assert set(root) == {x for p in near for x in p}


def test_one_document_of_a_group_stays(spark):
    df = spark.createDataFrame([(3, "a b c"), (1, "a b c"), (1, "a b c"), (2, "x y z"), (None, "x y z"), (None, "q r s")], "doc_id long, text string")
    assert sorted(r["doc_id"] or -1 for r in keep_one(df).collect()) == [-1, -1, 1, 2]


def test_rows_that_share_an_id_but_no_text(spark):
    # One text of id 2 leads no component; the other leads one. Id 4 leads two. Id 5 has two texts of one fingerprint.
    rows = [(1, "a b c"), (2, "a b c"), (2, "x y z"), (3, "x y z"), (4, "k l m"), (4, "q r s"), (4, "q r s"), (5, "u v w"), (5, "U v w")]
    first = set()
    for parts in (1, 3, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(tuple(r) for r in keep_one(df).collect())
        assert [(i, t.lower()) for i, t in got] == [(1, "a b c"), (2, "x y z"), (4, "k l m"), (4, "q r s"), (5, "u v w")]
        first.add(tuple(got))
    assert len(first) == 1


def test_quality_measures_and_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.op5_quality_rules(spark, SF).collect()}
    for i, text in documents(spark):
        w, r = words(text), got[i]
        lines = [x for x in text.split("\n") if words(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    right = [got[i]["kept"] == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.8


def test_token_counts_and_splices(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = dict(documents(spark))
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in Q.op6_token_counts(spark, SF).collect()} == {
        i: (len(t.encode()), len(sp.encode(t))) for i, t in texts.items()}
    with open(PIECES, "rb") as f:
        small = PieceCounter(f.read(), chunk_chars=64, overlap_chars=8)
    rnd = random.Random(2)
    hard = ["".join(rnd.choice(["  ", " a", "é", "\n", "word", "日本", "😀", "x" * 40, "   "]) for _ in range(200)) for _ in range(60)]
    assert small.counts([*hard, " " * 500, "x" * 900]) == [len(sp.encode(t)) for t in [*hard, " " * 500, "x" * 900]]
    assert small.widened > 0


def test_token_counts_of_texts_with_the_space_mark(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    mark, rnd = "\u2581", random.Random(4)
    with open(PIECES, "rb") as f:
        model = f.read()
    small = PieceCounter(model, chunk_chars=64, overlap_chars=8)
    hard = ["".join(rnd.choice([mark, f" {mark}", f"{mark} ", mark * 17, " a", "é", "\n", "word", "日本▂█", "  "]) for _ in range(200)) for _ in range(60)]
    hard += [mark * 500, f"x{mark}" * 300, f" {mark}" * 300, "word " * 40 + mark, mark + "word " * 40]
    assert small.counts(hard) == [len(sp.encode(t)) for t in hard]
    small.alike = False
    assert small.counts(hard) == [len(sp.encode(t)) for t in hard]
    long = [LONG[:18_000] + f" {mark} a{mark}b", f"{mark}▂▃▅▇ load {mark}{mark} " * 2_000, "plain"]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in count_tokens(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), PIECES).collect()}
    assert got == {i: (len(t.encode()), len(sp.encode(t))) for i, t in enumerate(long)}


def test_difference_cover():
    for period in (3, 13, 21, 31):
        cover = difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_repeats_by_brute_force(spark):
    texts, count = dict(documents(spark)), Counter()
    for t in texts.values():
        w = words(t)
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    for r in Q.op7_substring_dedup(spark, SF).collect():
        w = words(texts[r["doc_id"]])
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_repeat_inside_one_text_and_its_kept_text(spark):
    passage, fill = [f"p{i}" for i in range(40)], [f"f{i}" for i in range(10)]
    text = "a  b\n" + " ".join(passage) + " c\td " + " ".join(passage) + "\n" + "  ".join(fill)
    got = remove_repeats(spark.createDataFrame([(1, text), (2, "z " * 34)], "doc_id long, text string"), with_text=True).orderBy("doc_id").collect()
    assert (got[0]["n_removed"], got[0]["kept_text"]) == (80, "a  b c\td " + "  ".join(fill))
    assert (got[1]["n_removed"], got[1]["kept_text"]) == (0, "z " * 34)


def test_contamination_by_brute_force(spark):
    docs, items = dict(documents(spark)), dict(documents(spark, "benchmark"))
    docs[10_001], items["one"] = "Solo word", "solo"
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame([(str(i), t) for i, t in items.items()] + [("one", "solo")], "item_id string, text string")
    known = {str(i): ALNUM_WORD.findall(lower(t)) for i, t in items.items()}
    for block in (1 << 20, 40):
        for r in find_contamination(d, b, block_words=block, shard_bytes=1 << 16).collect():
            w = ALNUM_WORD.findall(lower(docs[r["doc_id"]]))
            hit, met = set(), set()
            for i, v in known.items():
                n = min(13, len(v))
                opened = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in opened:
                        met.add(i)
                        hit.update(range(k, k + n))
            digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(w), len(hit), len(met), digest)
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_a_worker_holds_one_block_of_items(tmp_path):
    import pickle

    from pyspark import Broadcast

    from rollmill.llm.decontaminate import Items, each_block

    blocks = []
    for k in range(3):
        (tmp_path / str(k)).write_bytes(pickle.dumps(tuple(Items.of([f"i{k}"], ["some words of an item"], 13))))
        blocks.append(Broadcast(path=str(tmp_path / str(k))))
    for _ in range(2):
        for k, known in enumerate(each_block(blocks)):
            assert known.names == [f"i{k}"] and sum("_value" in vars(b) for b in blocks) == 1
        assert not any("_value" in vars(b) for b in blocks)
    assert [x.names for x in each_block(blocks[:1])] == [["i0"]] and "_value" in vars(blocks[0])


def test_items_that_open_alike_are_compared_in_pieces(spark, monkeypatch):
    opening = "which of the following is the right answer to this one"
    items = [(i, f"{opening} number {i}") for i in range(40)]
    docs = [(d, " ".join(f"{opening} number {(d * 7 + j) % 60} end" for j in range(20))) for d in range(12)]
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    whole = rows_of(find_contamination(d, i), "doc_id")
    monkeypatch.setattr("rollmill.llm.decontaminate.MEETINGS", 50)
    assert rows_of(find_contamination(d, i), "doc_id") == whole
    for r in whole:
        own = {(r["doc_id"] * 7 + j) % 60 for j in range(20)}
        assert r["n_items"] == len([x for x in own if x < 40]) and r["longest_match"] == 13
        assert r["longest_at"] == 14 * min(j for j in range(20) if (r["doc_id"] * 7 + j) % 60 < 40)


def test_classifier_learns_and_never_sees_held_out_labels(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        text = [f"n{rnd.randint(0, 400)}" for _ in range(rnd.randint(20, 80))] + (["vile", "scumbag"] if bad else [])
        rnd.shuffle(text)
        rows.append((i, " ".join(text), rnd.choice(["en", "de"])))
        labels.append((i, int(bad) if zlib.crc32(str(i).encode()) % 4 != 2 else int(not bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = score_toxicity(d, train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_a_repeated_id_is_learnt_from_once(spark, monkeypatch):
    from rollmill.llm.toxicity import TextCnn

    seen, fit = [], TextCnn.fit
    monkeypatch.setattr(TextCnn, "fit", lambda self, texts, y: (seen.append((len(texts), [t.tolist() for t in texts])), fit(self, texts, y))[1])
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"word{i} " * 5 + ("vile" if i % 2 else "fine"), "en") for i in ids] + [(ids[0], f"other{j}", "de") for j in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    for parts in (1, 4):
        train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts), labels)
    assert seen[0][0] < len(ids) and seen[0] == seen[1]


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(0, 40))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def held_before(texts, length=50):
    seen, out = {}, {}
    for i in sorted(texts):
        t = texts[i]
        gone = np.zeros(len(t), bool)
        own = {t[k : k + length] for k in range(len(t) - length + 1)}
        for k in range(len(t) - length + 1):
            if t[k : k + length] in seen:
                gone[k : k + length] = True
        seen.update(dict.fromkeys(own, i))
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup_by_brute_force(spark):
    got = {r[0]: tuple(r)[1:] for r in Q.op10_suffix_dedup(spark, SF).collect()}
    assert got == held_before({i: t.encode() for i, t in documents(spark)})
    rnd = random.Random(6)
    base = "".join(rnd.choice("abc ") for _ in range(400))
    texts = {i: base[(a := rnd.randint(0, 330)) : a + rnd.randint(40, 120)] + "é" * rnd.randint(0, 60) + "\x00" * rnd.randint(0, 60) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in remove_held_before(df).collect()}
    assert got == held_before({i: t.encode() for i, t in texts.items()})


@pytest.mark.parametrize("crowd", [1, 1 << 15])
def test_suffix_dedup_of_a_phrase_in_ever_other_surroundings(spark, monkeypatch, crowd):
    monkeypatch.setattr("rollmill.llm.suffix_dedup.CROWD", crowd)
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choices("abcdefghij klmnop", k=n))
    ahead, behind = ([noise(40) for _ in range(12)] for _ in range(2))
    texts = {i: rnd.choice(ahead) + "subscribe to our newsletter today" + rnd.choice(behind) + noise(rnd.randrange(90)) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in remove_held_before(df).collect()}
    assert got == held_before({i: t.encode() for i, t in texts.items()})


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES:
        after = C.written(stage(spark, docs, SF), name)
        if name == "packing":
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
            continue
        assert after.columns == columns and 0 < after.count() <= docs.count()
        if name == "near_dedup":
            assert near_duplicates(after).groupBy("component_id").count().where("count > 1").count() == 0
        if name == "decontamination":
            assert find_contamination(after, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        docs = after
