"""Training-data operators against brute force and on edge cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from patchscope.llm import bpe, chat, fingerprint, hosts, html, langid, seeds, simhash, toxicity, wavelet

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "a b c d e f", "a b c d e f", "It's  1² naïve\n\n x\t", "漢字 한글 ω", "x" * 3000, "la casa de la noche " * 50, "   "]
SCHEMA = "doc_id long, text string, lang string, ids string, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in enumerate(TEXTS)], SCHEMA)


def test_bpe_equals_library(spark, docs):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.read(PATH).ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN, digests=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_prefix_table_appends_and_edits():
    v, rng = bpe.Vocabulary.read(PATH), random.Random(1)
    for _ in range(50):
        text = bytes(rng.choice(b"abcdeth ionxy==") for _ in range(200))
        grown = bpe.PrefixTable(v, text[:90])
        grown.append(text[90:])
        assert grown.last == bpe.PrefixTable(v, text).last
        grown.replace(50, 53, b"th")
        assert grown.last == bpe.PrefixTable(v, text[:50] + b"th" + text[53:]).last


def test_wavelet_matrix_and_files(spark, docs):
    from tokenizers import Tokenizer

    ids = np.random.default_rng(2).integers(0, 49408, 3000).astype(np.uint16)
    ids[::7] = 5
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (m.ids() == ids).all() and all(m.access(i) == ids[i] for i in range(0, 3000, 101))
    assert m.count(5, 1000) == (ids[:1000] == 5).sum() and m.find(5, 17) == np.flatnonzero(ids == 5)[17]
    own, start = Tokenizer.from_file(WORDS), 0
    got = {r["doc_id"]: r for r in wavelet.encode_to_files(docs, WORDS).collect()}
    for i, t in enumerate(TEXTS):
        want = np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert wavelet.encode_to_files(docs.limit(0), WORDS).count() == 0


def test_masks_hit_every_tolerated_pattern():
    for size in range(seeds.MIN_TOKENS, seeds.WINDOW + 1):
        for wrong in itertools.combinations(range(size), size - -(-8 * size // 10)):
            assert any(all(o + k not in wrong for k in m) for m in seeds.MASKS for o in range(size - m[-1]))


def test_decontamination_tolerates_substitutions(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x {item.replace('three', 'zzz').replace('eight', 'yyy')} y"), (2, "one two other words " * 5), (3, None), (4, ""), (1, "again")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    assert [(r["doc_id"], r["items"], r["matches"]) for r in seeds.contaminated(docs, bench).collect()] == [(1, [7], 8)]
    assert sorted(r["doc_id"] for r in seeds.decontaminate(docs, bench).collect()) == [2, 3, 4]
    assert seeds.contaminated(docs, bench.limit(0)).count() == 0 and seeds.contaminated(docs.limit(0), bench).count() == 0


def test_short_items_and_unspaced_scripts_are_found(spark):
    han = "".join(chr(0x4E00 + 7 * i) for i in range(40))
    items = [(1, "Who wrote the old book today"), (2, "Paris"), (3, han), (4, "one two three four five six seven eight nine ten"), (4, "one two three four five six seven eight nine ten"), (5, "")]
    rows = [(1, "x who wrote, the OLD book today y"), (2, "who wrote the new book today"), (3, "paris!"), (4, "paris is large"), (5, f"abc{han[:20]}\u5FFF{han[21:]}"),
        (6, "one two three four five six seven eight nine ten"), (None, "two three four five six seven eight nine ten one"), (6, "clean text of six words here"), (7, None)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, item_id string, place int")
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    for settings in ({}, {"broadcast_bytes": 0}):
        got = sorted(map(tuple, seeds.overlaps(docs, bench, **settings).select("doc_id", "item_id", "place", "matches").collect()), key=str)
        assert got == sorted([(1, 1, 1, 6), (3, 2, 0, 1), (5, 3, 1, 15), (6, 4, 0, 10)], key=str), settings


def test_exact_dedup_and_composition(spark, docs):
    data = bytes(range(256)) * 700
    assert fingerprint.combine(tuple(divmod(fingerprint.fingerprint(data[:999]), 1 << 31)), 999, tuple(divmod(fingerprint.fingerprint(data[999:]), 1 << 31))) == tuple(divmod(fingerprint.fingerprint(data), 1 << 31))
    got = {r["doc_id"]: r for r in fingerprint.exact_groups(docs).collect()}
    assert (got[0]["keep_id"], got[0]["group_size"], got[0]["kept"]) == (1, 2, False) and got[3]["kept"] and got[2]["keep_id"] == 3
    assert sorted(r["doc_id"] for r in fingerprint.exact_dedup(docs.union(docs)).collect()) == [1, 3, 4, 5, 6, 7, 8]
    small = {tuple(r) for r in fingerprint.fingerprints(docs).collect()}
    assert {tuple(r) for r in fingerprint.fingerprints(docs, huge=2).collect()} == small
    assert fingerprint.exact_groups(docs.limit(0)).count() == 0


def test_chunks_of_bytes_join_to_the_text(spark):
    text = "aé漢" * 50_000
    rows = spark.createDataFrame([(1, text), (2, ""), (None, "ab")], "doc_id long, __text string")
    got = sorted(fingerprint.chunks(rows).collect(), key=lambda r: (r["doc_id"] or 0, r["__no"]))
    assert b"".join(bytes(r["__part"]) for r in got if r["doc_id"] == 1).decode() == text and max(len(r["__part"]) for r in got) == fingerprint.CHUNK
    assert [(r["doc_id"], r["__no"], bytes(r["__part"])) for r in got if r["doc_id"] != 1] == [(None, 0, b"ab"), (2, 0, b"")]


def test_equal_fingerprints_of_unlike_texts_are_told_apart(spark, monkeypatch):
    long = "x" * (fingerprint.CHUNK + 9)
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, long), (5, long[:-1] + "y"), (6, long), (None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = fingerprint.fingerprints
    monkeypatch.setattr(fingerprint, "fingerprints", lambda d: whole(d).withColumn("fp", F.lit(1).cast("long")))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in fingerprint.exact_groups(docs).collect()}
    assert got == {1: (3, 3, False), None: (3, 3, False), 3: (3, 3, True), 2: (2, 1, True), 4: (6, 2, False), 6: (6, 2, True), 5: (5, 1, True)}


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randint(0, 50)) for _ in range(60)) for _ in range(12)]
    texts = [*base, *(b + f" extra{i}" for i, b in enumerate(base)), "", None, "A b", "a B"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [simhash.fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                group[a] = group[b] = min(group[a], group[b])
    got = {r["doc_id"]: r for r in simhash.near_groups(docs).collect()}
    assert all((got[i]["fingerprint"], got[i]["component_id"]) == (f"{fps[i]:016x}", group[i]) for i in got) and len(got) == len(texts)


def test_large_shards_are_split_and_keep_all_links():
    rng = np.random.default_rng(5)
    fp = (np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    fp = np.unique(fp)
    a, b = simhash.spanning(np.zeros(len(fp), int), fp, np.ones(len(fp), bool), np.ones(len(fp), bool), 4)
    assert len({*a.tolist(), *b.tolist()}) == len(fp) and len(set(b.tolist())) == 1


def test_language_of_texts(spark):
    rows = [(i, "the cat and the dog were in the house" if i % 2 else "el gato y el perro en la casa", "en" if i % 2 else "es", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    table = langid.fit(docs)
    asked = spark.createDataFrame([(1, "the dog"), (2, "el perro"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(asked, table).collect()}
    assert (got[1][0], got[2][0]) == ("en", "es") and got[3] == got[4] == got[5] == ("und", 0.0)
    assert langid.identify(asked, langid.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_disguised_words_are_restored():
    counts = toxicity.count_trigrams(["you stupid idiot, the stupid dog is an idiot"] * 50)
    channel = toxicity.Channel(counts)
    assert [channel.restore(w) for w in ("stup1d", "1d10t", "s.t.u.p.i.d", "stuuupid", "$tupid")] == ["stupid", "idiot", "stupid", "stupid", "stupid"]
    assert "=idiot" in toxicity.Features(counts).of("an i d i o t here")


def test_main_text():
    page = "<html><head><script>x='</p>'</script></head><body><nav><a>menu</a></nav><article><h1>T &amp; U</h1><p>a  <b>b<br><p>c<!-- no --><div class='comments'>bad</div></article><footer>f</footer>"
    assert html.main_text(page) == "T & U\na b\nc" and html.main_text(None) == html.main_text("") == ""


def test_template_subtrees_go(spark):
    rows = [(i, f"http://h.example/{i}", f"<div><span>Same on all pages</span></div><p>Text {i}</p>") for i in range(20)]
    got = html.extract(spark.createDataFrame([*rows, (99, None, None)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {**{i: f"Text {i}" for i in range(20)}, 99: ""}


def test_hosts_and_chat_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.net/en/x?q"), (2, None), (3, "no scheme"), (4, "https://example.com/de/")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in hosts.judge(pages, none).collect()}
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("example.com", "/de/", "example.com/de/", "block")}
    turns = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, None, None), (1, 300, "ann", "bye")], "conv_id long, turn long, role string, text string")
    rows = {(r["speaker"], r["part"]): r for r in chat.rotate(turns).collect()}
    assert len(rows) == 4 and rows["ann", 1]["rendered"] == "<|im_start|>assistant\nbye<|im_end|>\n" and rows["unknown", 1]["spans"] == ""
    assert chat.rotate(turns.limit(0)).count() == 0


def test_parts_of_a_dialogue_compose(spark):
    rows = [(c, t, r, f"{r} says {t}") for c in (1, None) for t in range(30) for r in (["ann", "bob"][t % 2], *(["system"] if t == 0 else []))]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, part_start long")
    whole = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(turns, part_turns=1000).collect()}
    parts: dict = {}
    for r in chat.rotate(turns, part_turns=8).collect():
        parts.setdefault((r["conv_id"], r["speaker"]), []).append(r)
    assert set(whole) == set(parts) == {(c, s) for c in (1, None) for s in ("ann", "bob")}
    for key, found in parts.items():
        found.sort(key=lambda r: r["part"])
        assert len(found) == 4 and "".join(r["rendered"] for r in found) == whole[key]["rendered"]
        moved = [f"{int(a) + r['part_start']}-{int(b) + r['part_start']}" for r in found for a, b in (s.split("-") for s in r["spans"].split(",") if s)]
        assert ",".join(moved) == whole[key]["spans"]


def test_bounds_block_hosts_and_are_handed_down(spark):
    # bad.com has bad hosts only, fine.com good ones; new.bad.com has no outcome, one.fine.com a single bad page
    urls = [f"http://{h}{i}.bad.com/" for i in range(20) for h in "ab"] * 5 + [f"http://{h}{i}.fine.com/" for i in range(20) for h in "ab"] * 5
    urls += ["http://new.bad.com/x", "http://one.fine.com/x", "http://unseen.com/"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    bad = [(i, int(".bad." in u)) for i, u in enumerate(urls[:-3])] + [(len(urls) - 2, 1), (len(urls) - 1, None)]
    got = {r["page_id"]: r for r in hosts.judge(pages, spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert len(got) == len(urls) and all(got[i]["verdict"] == ("block" if ".bad." in u else "allow") for i, u in enumerate(urls[:-3]))
    new, one, unseen = (got[len(urls) - k] for k in (3, 2, 1))
    assert new["verdict"] == "block" and one["verdict"] == unseen["verdict"] == "allow" and new["bad_rate"] > unseen["bad_rate"] > one["bad_rate"]


def test_near_copies_of_the_pipeline_equal_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = ["", None, "two words", "Two  words"]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 5, 9):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted(set(group)) and len(got) < len(texts) - 30


def test_templates_inside_articles_go(spark):
    box = "<div>Read us daily</div>"
    rows = [(i, f"http://h.example/{i}", f"<article><h1>T{i}</h1><p>Own text number {i} of this page</p>{box if i != 3 else ''}</article>") for i in range(6)]
    rows += [(10 + i, f"http://s.example/{i}", f"<div>Same here</div><p>Text {i}</p>") for i in range(4)]
    rows += [(20 + i, f"http://c.example/{i}", "<article><p>A copy</p><p>of one page</p></article>") for i in range(5)]
    rows += [(30 + i, f"http://p.example/{i}", f"<article><p>{'A shared passage' if i < 3 else 'Else'}</p><p>Much more text of page {i}</p></article>") for i in range(6)]
    rows += [(40 + i, f"http://m.example/{i}", f"<article><p>{'Other text' * 9} {i}</p>{'<div class=post-share>On X</div>' if i % 2 else ''}</article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\nOwn text number {i} of this page" for i in range(6)) and all(got[10 + i] == f"Text {i}" for i in range(4))
    assert all(got[20 + i] == "A copy\nof one page" for i in range(5)) and got[30].startswith("A shared passage") and "On X" not in got[41]


def test_class_words_take_no_main_text():
    assert html.main_text("<article><div class='article-header'><h1>Title</h1></div><div class='header'><h1>Two</h1></div><p>Text</p></article>") == "Title\nTwo\nText"
    assert html.main_text("<div class='content with-sidebar'><p>All of it</p></div>") == html.main_text("<div class='sidebar'><article>All of it</article></div>") == "All of it"
    assert html.main_text("<article><p>A long text</p><p class='ad'>Buy</p></article>") == "A long text"


def test_long_pieces_are_decoded_whole():
    channel = toxicity.Channel(toxicity.count_trigrams(["you stupid idiot, the stupid dog is an idiot"] * 50))
    assert channel.restore(".".join(["st.up1d"] * 40)).replace(" ", "") == "stupid" * 40


def test_disguised_words_beside_others_are_restored():
    counts = toxicity.count_trigrams(["you stupid idiot, such a total ass; the stupid dog is an idiot"] * 50)
    own = toxicity.Features(counts)
    for text in ("such a i d i o t", "y o u i d i o t", "total-1d10t", "you_1d10t", "s t u p 1 d i d i o t"):
        assert "=idiot" in own.of(text), text
    assert "=stupid" in own.of("stuupid") and "=ass" in own.of("a 455") and "=you" in own.of("y o u i d i o t")


def test_pieces_of_array_slices_equal_the_tokenizer():
    """A block is a slice of the batch's texts; white space of every kind, NULL, empty and special texts."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    encoder, whole = wavelet.PieceEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = ["left out", None, " \t a  b\n\x0b\x0cA b ", "", "Straße über   日本 語", f"x {encoder.special[0]} y" if encoder.special else "x", " ", "a b a"]
    got = encoder.encode(pa.array(texts, pa.string()).slice(1))
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    blocks = list(wavelet.in_blocks(pa.array(texts, pa.string()), 10))
    assert len(blocks) > 2 and [x.as_py() for b in blocks for x in b] == texts


def test_a_word_goes_through_the_model_once_whatever_its_case_and_marks():
    from tokenizers import Tokenizer

    encoder, whole = wavelet.PieceEncoder(WORDS), Tokenizer.from_file(WORDS)
    seen, model = [], encoder.words.fill
    encoder.words.fill = lambda words: seen.extend(words) or model(words)
    texts = ["Zebrafish zebrafish, (ZEBRAFISH)", "--zebrafish. x1y ÉTÉS étés! 日本", None, "zebrafish"]
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    assert encoder.letters and sorted(seen) == ["zebrafish", "étés"]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_whole_texts_are_handled_a_few_rows_at_a_time(spark):
    """An executor's memory: what a worker makes of whole texts holds SLICE_ROWS of them, not an Arrow batch."""
    from patchscope.llm import common

    seen = common.arrow_map(spark.range(0, 3000, 1, 1), lambda b: {"n": [len(b["id"])] * len(b["id"])}, "n int")
    assert seen.agg({"n": "max"}).first()[0] <= common.SLICE_ROWS and seen.count() == 3000


def near_copies(seed: int, groups: int, copies: int) -> list[str | None]:
    """Texts of 20 to 400 words and their copies with up to a seventh of the words changed; few words, none and NULL too."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    texts: list[str | None] = [None, "", "one", "one", "one two", "One  Two"]
    for _ in range(groups):
        base = rng.choice(words, rng.integers(20, 400)).tolist()
        for _ in range(copies):
            text = list(base)
            for place in rng.integers(0, len(text), rng.integers(0, max(2, len(text) // 35))):
                text[place] = str(rng.choice(words))
            texts.append(" ".join(text))
    return texts


def kept_by_all_pairs(texts: list[str | None], similarity: float = 0.8) -> list[int]:
    sets = [simhash.shingles(t, 5) for t in texts]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            whole = len(sets[a]) + len(sets[b]) - shared
            if (shared >= similarity * whole - 1e-9 if whole else True) and (fps[a] ^ fps[b]).bit_count() <= simhash.WIDE_RADIUS:
                label = [label[b] if x == label[a] else x for x in label]
    return sorted({min(i for i, x in enumerate(label) if x == y) for y in label})


@pytest.mark.parametrize("share", [None, 500])
def test_similar_dedup_links_as_all_pairs_would(spark, monkeypatch, share):
    """Also where a group's sets are cut into shares that meet two by two."""
    if share:
        monkeypatch.setattr(simhash, "SHARE_GRAMS", share)
    texts = near_copies(5, 8, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.similar_dedup(docs).select("doc_id").collect())
    assert kept == kept_by_all_pairs(texts) and 8 < len(kept) < len(texts) - 10


def test_near_dedup_makes_at_most_one_row_a_member(spark):
    """Neither candidates nor links grow with the square of a group, whether or not its texts turn out to be similar."""
    sets = [np.unique(np.r_[np.arange(70), np.arange(1000 + 30 * i, 1030 + 30 * i)]).astype(np.uint64) for i in range(200)]
    rows = [(k, i, 0, len(g), [0] * 4) for i, g in enumerate(sets) for k in (1, 2)]
    shared = spark.createDataFrame(rows, "key long, node long, fp long, size int, sketch array<long>")
    found = simhash.candidates(shared, 0.8, simhash.WIDE_RADIUS)
    assert len(sets) - 1 <= found.count() <= len(rows)
    held = spark.createDataFrame([(i, g.astype(np.int64).tolist()) for i, g in enumerate(sets)], "node long, grams array<long>")
    groups = spark.createDataFrame([(i, 0, 0, len(g)) for i, g in enumerate(sets)], "node long, label long, fp long, size int")
    assert simhash.verified(held, groups, 0.8, simhash.WIDE_RADIUS).count() == 0
    assert simhash.verified(held, groups, 0.5, simhash.WIDE_RADIUS).count() == len(sets) - 1


def test_parity_sketches_never_differ_in_more_bits_than_the_sets_in_members():
    rng = np.random.default_rng(3)
    sets = []
    for n in (0, 1, 40, 300, 310, 700, 5000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.r_[base[n // 10 :], rng.integers(0, 1 << 63, 9).astype(np.uint64)])]
    made = [simhash.parity(g) for g in sets]
    words = np.array([len(x) for x in made])
    sketches = simhash.Sketches(np.concatenate(made), np.cumsum(words) - words, words)
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = sketches.apart(a, b)
    assert all(d <= len(np.setxor1d(sets[x], sets[y])) for d, x, y in zip(apart.tolist(), a, b))
    assert len(set(words.tolist())) > 3 and apart[(words[a] != words[b])].any()
