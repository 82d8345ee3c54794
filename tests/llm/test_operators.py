"""Odd rows, brute force, round trips and held-out accuracy of the text corpus operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd import LONG, ODD

from longitab.llm import chat, decontaminate, exact_dedup, language, near_dedup, packing, pitman_yor, quality, queries
from longitab.llm import range_coder, token_files, url_rules
from longitab.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- 1 ------------------------------------------------------------------------------------------
def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def closure(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: root(i) for i in ids}


def planted():
    rng = random.Random(3)
    text = [f"w{rng.randrange(900)}" for _ in range(120)]
    out = []
    for i in range(260):  # one large group, chained by small edits, and strangers
        t = list(text)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(t))
    return out + [" ".join(f"s{rng.randrange(5000)}" for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["x y"] * 30 + ["x y z", "x y z q"]


@pytest.mark.parametrize("region", [near_dedup.REGION, 20])
def test_near_equals_brute_force(frame, monkeypatch, region):
    monkeypatch.setattr(near_dedup, "REGION", region)  # 20: regions are cut deeper
    texts = dict(enumerate(planted()))
    want = closure({i: shingles(t, 2) for i, t in texts.items()})
    got = rows(near_dedup.near_duplicates(frame(list(texts.items())), size=2))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]], 2)) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_odd_rows(frame):
    got = rows(near_dedup.near_duplicates(frame(ODD), size=2))
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[3] == [(0, 3, True)] and by[5] == [(1, 5, True)] * 2
    assert by[6] == [(1, 5, False)] and by[None] == [(5, 9, False)] and by[9] == [(5, 9, True)]
    assert by[8][0][1:] == (7, False)
    assert rows(near_dedup.near_duplicates(frame([]))) == []


def test_near_blocks_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 50)
    near = spark.createDataFrame([(0, 5, i, i % 7, 0, 100, 620, None) for i in range(620)],
                                 "tree int, region long, id long, bits0 long, bits1 long, n long, size long, slices int")
    labels = spark.createDataFrame([(i, 500) for i in range(501, 620)], "id long, component long")
    blocks = near_dedup.dealt(near_dedup.mixed_rows(near, labels))
    assert blocks.groupBy("tree", "region", "kind", "i", "j").count().agg({"count": "max"}).first()[0] <= 3 * near_dedup.REGION
    assert near_dedup.block_members(near, labels, 80).count() == 620
    among = spark.range(0, 620, 10).toDF("id")
    assert near_dedup.block_members(near, labels, 80, among).count() == 62
    # One set for all: every component is joined, by fewer links than a block has documents.
    every = spark.createDataFrame([(i, np.arange(100, dtype=np.uint64).tobytes()) for i in range(620)], "id long, shingles binary")
    links = [(r["a"], r["b"]) for r in rows(near_dedup.block_links(near, labels, 80, every))]
    parent = {}

    def root(i):
        while parent.get(i, i) != i:
            i = parent[i]
        return i
    for a, b in links:
        x, y = sorted((root(500 if a > 500 else a), root(500 if b > 500 else b)))
        if x != y:
            parent[y] = x
    assert {root(i) for i in range(501)} == {0} and len(links) < blocks.count()
    # Seven sets that share 60 of 100 shingles: no link between them.
    apart = spark.createDataFrame([(i, np.r_[np.arange(60), 1000 * (i % 7 + 1) + np.arange(40)].astype(np.uint64).tobytes()) for i in range(620)], "id long, shingles binary")
    assert {a % 7 == b % 7 for a, b in ((r["a"], r["b"]) for r in rows(near_dedup.block_links(near, labels, 80, apart)))} == {True}


def test_near_null_and_repeated_ids(spark, frame):
    a = " ".join(f"w{i}" for i in range(60))
    b, c = a.replace("w59", "x"), " ".join(f"v{i}" for i in range(60))
    docs = [(None, a), (None, b), (3, c), (3, "other words " + " ".join(f"u{i}" for i in range(60))), (5, c + " end"), (7, "q r s"), (7, "q r s")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in rows(near_dedup.near_duplicates(frame(docs)))), key=repr)
    assert sorted(r[2] for r in got if r[0] is None) == [False, True]            # null ids are compared too
    assert [r for r in got if r[0] == 3] == [(3, 3, True)] * 2 and [r for r in got if r[0] == 5] == [(5, 3, False)]
    kept = [(r["doc_id"], r["text"]) for r in rows(near_dedup.without_copies(frame(docs)))]
    assert len(kept) == 5 and sum(i is None for i, _ in kept) == 1 and sum(i == 3 for i, _ in kept) == 2 and sum(i == 7 for i, _ in kept) == 2
    twice = [(3, a), (3, b), (9, c)]                                            # one id, two linked texts
    kept = rows(near_dedup.without_copies(frame(twice)))
    assert len(kept) == 2 and {r["doc_id"] for r in kept} == {3, 9} and kept[0].keys() == set(frame(twice).columns)


def test_near_template_below_the_limit(frame):
    rng = random.Random(9)
    text = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(600):                                                        # about 0.7 to each other, from a small pool of edits
        t = list(text)
        for p in rng.sample(range(50), 5):
            t[2 * p] = f"e{rng.randrange(4)}"
        docs.append((i, " ".join(t)))
    want = closure({i: shingles(t, 2) for i, t in docs})
    assert {r["doc_id"]: r["component_id"] for r in rows(near_dedup.near_duplicates(frame(docs), size=2))} == want


def test_near_bit_filter_misses_less_than_the_forest():
    tail = sum(math.comb(128, x) * .1 ** x * .9 ** (128 - x) for x in range(near_dedup.MAX_BITS + 1, 129))
    assert tail < (1 - .8 ** near_dedup.DEPTH) ** near_dedup.TREES


# -- 2 ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("hot_rows", [exact_dedup.HOT_ROWS, 1])
def test_exact_groups(frame, hot_rows):
    texts = ODD + [(20 + i, "same text" + " " * (i % 3)) for i in range(40)] + [(70, "same text  "), (70, "same text  ")]
    got = rows(exact_dedup.sort_dedup(frame(texts), hot_rows=hot_rows))
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    assert len(got) == len(texts)
    want = {hashlib.sha256(n.encode()).hexdigest(): (len(g), min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]) for n, g in groups.items()}
    assert all((r["group_size"], r["keep_id"]) == want[r["text_sha256"]] for r in got)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(want.keys())
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert rows(exact_dedup.sort_dedup(frame([]))) == []
    whole = exact_dedup.sort_dedup(frame(texts), hot_rows=hot_rows, with_row=True).filter("kept").select("row.*")
    assert whole.columns == frame([]).columns and whole.count() == len(groups)


# -- 3 ------------------------------------------------------------------------------------------
def test_pitman_yor_scores(frame, documents):
    texts = list(zip(documents.doc_id.tolist(), documents.text.tolist()))
    got = {r["doc_id"]: r for r in rows(pitman_yor.score_corpus(frame(texts)))}
    tokens = {i: words(t) + ["\n"] for i, t in texts}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, t in tokens.items() if i not in held for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in t), rel_tol=1e-9)
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def test_pitman_yor_probabilities_sum_to_one(spark, frame):
    train = [(i, t) for i, t in enumerate(["a b c a b", "b b a", "c a"] * 4)]
    counts, shared = pitman_yor.learn(frame(train))
    for context in (ord("a"), ord("b"), pitman_yor.START, ord("z")):
        total = 0.0
        for r in counts.collect():
            shard = pitman_yor.Shard(r["shard"], bytes(r["data"]), shared)
            here, absent = shard.predictive()
            seen = shard.context == context
            total += here[seen].sum()
            rest = np.setdiff1d(np.arange(len(shard.words)), shard.word[seen])
            total += pitman_yor.away(absent, rest, context).sum()
        total += pitman_yor.away(absent, -1, context)  # the unknown word
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_pitman_yor_contexts_are_words(frame):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    train = [(1000 + i, t) for i, t in enumerate(["xa b", "ya c", "xa b", "ya c"] * 20)]
    got = {r["doc_id"]: r["score"] for r in rows(pitman_yor.score_corpus(frame(train + list(zip(held, ["xa b", "xa c", "unseen c"])))))}
    assert got[held[0]] > got[held[1]] + 1  # both words end in a
    model, shared = pitman_yor.learn(frame(train))
    contexts = {c for r in model.collect() for c in pitman_yor.Shard(r["shard"], bytes(r["data"]), shared).contexts.tolist()}
    assert len(contexts) == 5  # the start and each of four words


def test_pitman_yor_pairs_take_little_room():
    rng = np.random.default_rng(3)
    contexts = np.sort(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64))
    key = np.repeat(np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64)), 200)
    at = np.concatenate([np.sort(rng.choice(40_000, 200, replace=False)) for _ in range(500)])
    count = rng.integers(1, 3, len(key)).astype("<i8")
    data = pitman_yor.pack_pairs(key, contexts, at, count)
    assert len(data) < 10 * 40_000 + 100  # hashes of contexts alone are 8 bytes each
    words_, run, contexts_, at_, count_ = pitman_yor.unpack_pairs(data)
    assert (np.repeat(words_, run) == key).all() and (contexts_ == contexts).all() and (at_ == at).all() and (count_ == count).all()


def test_pitman_yor_words_of_odd_texts():
    import pyarrow as pa
    texts = ["", None, "  ", " A b\t\u00c4 \u00c9 \x0b\x0cz\r\n", "x", "a  b ab", "\x1c a \x85 b \u00a0 c", "e"]
    hashes, contexts, at, before, lengths = pitman_yor.numbered(pa.array(texts))
    hash_of = {}
    for t, ids in zip(texts, np.split(at, np.cumsum(lengths)[:-1]), strict=True):
        for w, h in zip(words(t) + ["\n"], hashes[ids].tolist(), strict=True):
            assert hash_of.setdefault(w, h) == h
    assert len(set(hash_of.values())) == len(hash_of)
    assert (contexts[before[np.cumsum(lengths) - lengths]] == pitman_yor.START).all()
    assert contexts[before[5 + lengths[:3].sum()]] == ord("z")  # the word before the end of the fourth text


def test_pitman_yor_odd_rows(frame):
    got = rows(pitman_yor.score_corpus(frame(ODD)))
    assert len(got) == len(ODD) and all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert rows(pitman_yor.score_corpus(frame([]))) == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    assert rows(pitman_yor.score_corpus(frame([(held, "a b")])))[0]["score"] == 0.0  # nothing was learned


# -- 4 ------------------------------------------------------------------------------------------
def test_language_held_out(spark):
    got = queries.op4_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = got.merge(docs)[got.held_out.values]
    assert len(got) == len(docs) and (held.lang == held.lang_pred).mean() > 0.99


def test_language_spans_and_odd_rows(frame):
    en, fr = "the cat and the dog are in the house ", "le chat et le chien sont dans la maison "
    ids = iter(i for i in range(999) if zlib.crc32(str(i).encode()) % 4 != 2)
    train = [(next(ids), (en if k % 2 else fr) * 3) for k in range(40)] + [(next(ids), "\u0436\u0438\u0437\u043d\u044c \u0438 \u0434\u043e\u043c ") for _ in range(5)]
    langs = {i: "en" if t.startswith("the") else "fr" if t.startswith("le") else "ru" for i, t in train}
    model = language.learn(frame(train, langs))
    got = rows(language.identify(frame([(0, en * 2 + fr * 3)] + ODD), model))
    mixed = got[0]
    assert [s["lang"] for s in mixed["spans"]] == ["en", "fr"] and mixed["lang_pred"] == "fr" and 0.5 < mixed["score"] < 0.7
    assert (en * 2 + fr * 3)[mixed["spans"][1]["begin"]:].startswith("le chat")
    und = {r["row"]["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 10} and len(got) == len(ODD) + 1
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    empty = language.learn(frame([]))
    assert {r["lang_pred"] for r in rows(language.identify(frame(ODD), empty))} == {"und"}
    assert rows(language.identify(frame([]), model)) == []


def test_viterbi_equals_brute_force():
    import itertools
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(9, 3)).astype(np.float32) * 3
    path = language.viterbi(scores, lengths, 2.0)
    begin = 0
    for n in lengths:
        value = lambda p: sum(scores[begin + i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert math.isclose(value(path[begin:begin + n].tolist()), best, rel_tol=1e-4, abs_tol=1e-4)
        begin += n


# -- 5 ------------------------------------------------------------------------------------------
def test_quality_against_labels(spark):
    got = queries.op5_quality(spark, "/root/testdata/sf0.01").toPandas()
    m = got.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas())
    assert ((m.weak_label >= 0.5) == (m.quality == 1)).mean() > 0.93 and (m.good == (m.quality == 1)).mean() > 0.9
    assert m.good[m.quality == 1].mean() > 0.97


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    right = (0.9, 0.8, 0.7, 0.85)
    votes = np.stack([np.where(rng.random(len(good)) < a, good, ~good) * 2 for a in right], axis=1)
    prior, p = quality.expectation_maximisation(votes, np.ones(len(good)))
    assert abs(prior - 0.7) < 0.05 and all(abs(p[j, 1, 2] - a) < 0.05 for j, a in enumerate(right))


def test_quality_ignores_the_order_of_rows(spark, frame, documents, monkeypatch):
    texts = list(zip(documents.doc_id.tolist(), documents.text.tolist()))
    texts += [(10_000 + i, texts[3][1]) for i in range(2000)]                   # one text with most of the rows
    runs = []
    for order in (texts, texts[::-1]):
        got = rows(quality.classify(frame(order).repartition(3), train_rows=100))
        runs.append({r["doc_id"]: (r["score"], r["good"]) for r in got})
    assert all(abs(runs[0][i][0] - runs[1][i][0]) < 1e-6 and runs[0][i][1] == runs[1][i][1] for i in runs[0])


def test_quality_odd_rows(frame):
    got = rows(quality.classify(frame(ODD)))
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert rows(quality.classify(frame([]))) == []


# -- 6 ------------------------------------------------------------------------------------------
def test_chat_layouts(spark):
    records = ['{"prompt": "p", "completion": "c"}', '{"instruction": "i", "input": "x", "output": "o"}',
               '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}',
               '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', '{"other": 1}', "no json", None]
    got = rows(chat.format_records(spark.createDataFrame(list(enumerate(records)), "id long, record string"), "id", "record"))
    turns = defaultdict(list)
    for r in got:
        turns[r["id"]].append((r["role"], r["text"]))
    assert turns[0] == [("user", "p"), ("assistant", "c")] and turns[1] == [("user", "i\n\nx"), ("assistant", "o")]
    assert turns[2] == [("user", "q"), ("assistant", "")] and turns[3] == [("user", "q"), ("assistant", "a")]
    assert turns[4] == turns[5] == turns[6] == [(None, None)]


def test_chat_round_trip():
    rng = random.Random(0)
    for _ in range(3000):
        role, text = ("".join(rng.choice(["<", "|", "\\", "\n", "a", "n", "<|im_end|>", "<|im_start|>"]) for _ in range(rng.randrange(9))) for _ in range(2))
        marked, _, _ = chat.format_turn(role, text)
        assert chat.parse_turn(marked) == (role, text) and marked.count("<|im_") == 2
        marked, begin, end = chat.format_turn("assistant", text)
        assert chat.unescape(marked[begin:end]) == text


def test_chat_query_equals_plain_python(spark):
    got = {r["conv_id"]: r for r in rows(queries.op6_chat(spark, SF))}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [(r, queries.CONTROL_TEXT) for r in ("user", "assistant")]
    assert set(got) == set(turns)
    for key, t in turns.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert got[key]["n_turns"] == len(t) and got[key]["loss_chars"] == len(loss)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
        assert got[key]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[key]["formatted_chars"] == sum(len(chat.format_turn(r, x)[0]) for r, x in t)


def test_chat_odd_rows(spark):
    odd = [(1, 0, None, None), (1, 0, None, None), (None, 1, "assistant", "x"), (2, None, "assistant", LONG)]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in rows(chat.digest(chat.format_turns(df)))}
    assert got[1]["n_turns"] == 2 and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == len(LONG)
    assert rows(chat.digest(chat.format_turns(df.limit(0)))) == []


# -- 7 and 8 ------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_cuts_beside_letters_that_fall_apart(name):
    enc = Encoder(queries.vocabulary(name))
    texts = ["A\u0130. b", "\u0130'\u0130!", "\ufb1d, \u0958.", "plain text.", " \u0130", None]
    want = [e.ids + [9] for e in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(pa.array(texts), 9)] == want


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_takes_unknown_words_together(name):
    enc, given = Encoder(queries.vocabulary(name)), []

    class Counted:
        def __getattr__(self, x):
            return getattr(library, x)

        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return library.encode_batch_fast(texts, **more)

    library, enc.tokenizer = enc.tokenizer, Counted()
    rng = np.random.default_rng(1)
    text = " ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (3000, 9)))
    for _ in range(2):
        assert enc.encode([text, text], 9)[1].tolist() == library.encode(text, add_special_tokens=False).ids + [9]
    assert len(given) < 20


def test_words_pass_by_the_expressions_of_the_vocabulary():
    enc, given = Encoder(queries.vocabulary(WORD)), []

    class Counted:
        def __getattr__(self, x):
            return getattr(library, x)

        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return library.encode_batch_fast(texts, **more)

    library, enc.tokenizer = enc.tokenizer, Counted()
    texts = ["Nonesuch w\u00f6rter\n\u03a3\u0391\u03a3 \u01c5ep \u0416\u0443\u043a \u4e2d\u6587 \u00c5ngstr\u00f6m", "First,second\x0bthird\x0cfourth"]
    want = [library.encode(t, add_special_tokens=False).ids + [9] for t in texts]
    assert [x.tolist() for x in enc.encode(texts, 9)] == want
    assert not any(c.isalpha() for t in given for c in t)
    # words that are no letters, or do not stay letters, do not hold up the others
    given.clear()
    texts = ["gr\u00fc\u00df \u0130zmir na\u00efvet\u00e9 \u0939\u093f\u0928\u094d\u0926\u0940 \u00fcber x\u00b2 c\u00f4t\u00e9"]
    want = [library.encode(t, add_special_tokens=False).ids + [9] for t in texts]
    assert [x.tolist() for x in enc.encode(texts, 9)] == want and len(given) == 3


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_lets_go_of_parts(name):
    enc, rng = Encoder(queries.vocabulary(name), kept_parts=50), random.Random(2)
    for _ in range(30):
        texts = ["".join(rng.choice(["ab", " c", "d ", "\u00e9", ".", " ", "w" * 50]) for _ in range(30)) for _ in range(9)]
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids + [5] for t in texts]
        assert [x.tolist() for x in enc.encode(texts, 5)] == want
        assert not any(len(x) > 40 for x in enc.known.number) and len(enc.older.number) < 500


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_equals_library(name):
    e, rng = Encoder(queries.vocabulary(name)), random.Random(1)
    parts = ["a", "b", "'", "s", "t", "re", " ", "  ", "\n", "\t", ",", ".", "1", "_", "\u00e9", "\u0085", "\x1c", "\u00b2", "\u0301", "\u00df",
             "\u03a3", "don't", "<|endoftext|>", "<|", "longword" * 9]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    for t, ids in zip(texts, e.encode(texts, 7)):
        assert e.tokenizer.encode(t, add_special_tokens=False).ids + [7] == ids.tolist()


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (63, 50), (200, 1), (3000, 49_000), (200_000, 300)])
def test_block_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    block = range_coder.encode_block(ids, b"rows", 2, lanes=16)
    back, table, k = range_coder.decode_block(block)
    assert (back == ids).all() and table == b"rows" and k == 2
    if n == 200_000:
        assert len(block) < 2 * n
        with pytest.raises(Exception):
            range_coder.decode_block(block[:-400] + bytes(400))


def test_ranges_carry_over():
    rng, lanes = np.random.default_rng(3), 40
    total = rng.integers(2, 9, (1000, lanes)).astype(np.uint64)
    cum = (rng.random(total.shape) * total).astype(np.uint64)
    count = np.ones_like(total)
    out = range_coder.Writer(lanes)
    for row in zip(cum, count, total):
        out.put(*row, last=True)
    assert len(out.carried) > 100
    src = range_coder.Reader(out.end(), lanes)
    for c, n, t in zip(cum, count, total):
        assert (src.look(t) == c.astype(np.int64)).all()
        src.narrow(c, n, last=True)
    # through words without a zero bit
    out, full = range_coder.Writer(2), (1 << 32) - 1
    out.moved, out.words = [np.array([0, 1])] * 3, [np.array(w, np.uint64) for w in ([7, 1], [full, 2], [full, 3])]
    out.gone[:], out.carried = 3, [(np.array([0]), np.array([3]))]
    assert np.frombuffer(out.end(), "<u4").tolist() == [8, 0, 1, 2, 0, 3, 0, 0, 0, 0]


def test_block_is_the_same_however_many_ids_are_predicted_at_once(monkeypatch):
    ids = (np.random.default_rng(6).random(40_000) ** 3 * 500).astype("<u4")
    blocks = []
    for chunk in (1, 999, 1 << 15):
        monkeypatch.setattr(range_coder, "CHUNK", chunk)
        blocks.append(range_coder.encode_block(ids, b"", 0, lanes=64))
    assert blocks[0] == blocks[1] == blocks[2] and (range_coder.decode_block(blocks[0])[0] == ids).all()


def test_block_does_not_search_for_each_id(monkeypatch):
    ids = (np.random.default_rng(5).random(60_000) ** 4 * 900).astype("<u4")
    calls, search = [], np.searchsorted
    monkeypatch.setattr(range_coder.np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    back = range_coder.decode_block(range_coder.encode_block(ids, b"", 0, lanes=100))[0]
    assert (back == ids).all() and len(calls) < 60  # 600 steps


def test_token_files(spark, frame, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_ids(frame(ODD), path, queries.vocabulary(WORD), partitions=3, block_ids=500)
    got = sorted(rows(token_files.read_ids(spark, path, with_ids=True)), key=lambda r: r["start"])
    e = Encoder(queries.vocabulary(WORD))
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    token_files.write_ids(frame([]), str(tmp_path / "none"), queries.vocabulary(WORD))
    assert rows(token_files.read_ids(spark, str(tmp_path / "none"))) == []


def test_token_files_of_many_short_texts(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 30)
    path = str(tmp_path / "ids")
    token_files.write_ids(frame([(i, "a" if i % 3 else None) for i in range(100)]), path, queries.vocabulary(WORD), partitions=1)
    assert sorted(r["n_docs"] for r in rows(spark.read.parquet(path))) == [10, 30, 30, 30]
    got = sorted(rows(token_files.read_ids(spark, path)), key=lambda r: r["doc_id"])
    assert [r["n_tokens"] for r in got] == [2 if i % 3 else 1 for i in range(100)]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()


def test_cut_covers_every_length():
    for n in range(1, 4200):
        parts = packing.cut(n)
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist() and sum(p[1] for p in parts) == n
        assert all(1 <= length <= packing.CAPACITY // k for _, length, k in parts)


def check_packed(got, texts):
    e = Encoder(queries.vocabulary(BYTE))
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in texts:
        ids = np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(docs[(i, len(ids))], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) % len(ids) == 0
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    tokens = padding = 0
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0] + [r["length"] for r in s])[:-1].tolist()
        used = sum(r["length"] for r in s)
        assert used <= 1024
        tokens, padding = tokens + used, padding + (0 if used & (used - 1) == 0 else 1024 - used)
    return padding / max(1, tokens)


def test_packing(spark, frame, documents):
    texts = list(zip(documents.doc_id.tolist(), documents.text.tolist()))
    for partitions in (1, 211):
        assert check_packed(rows(packing.pack(frame(texts).repartition(partitions), queries.vocabulary(BYTE))), texts) < 0.03
    got = rows(packing.pack(frame(ODD), queries.vocabulary(BYTE)))
    check_packed(got, ODD)
    assert {r["doc_id"] for r in got} == {i for i, _ in ODD}
    assert rows(packing.pack(frame([]), queries.vocabulary(BYTE))) == []


# -- 9 ------------------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = [(1, "http://Example.NET/en/x"), (2, "https://a.b.net/en/"), (3, "https://net"), (4, "http://m.example.com/de/?q=1"), (5, "ftp://x.org/fr/a#b"),
            (6, None), (7, "no scheme"), (8, "http://notnet/"), (9, "http://cheap-pills.example.com/"), (9, "http://cheap-pills.example.com/"), (10, ""),
            (11, "x://spamless.example.com/spam"), (12, "http://e.org?x=://net/"), (13, "http://example.com/de")]
    df = spark.createDataFrame([(i, u, "n") for i, u in urls], "page_id long, url string, rule string")
    rules = [url_rules.HostRule(*r) for r in queries.HOST_RULES]
    got = rows(url_rules.filter_urls(df, rules))
    plain = []
    for i, u in urls:
        host, path = url_rules.split_url(u)
        fit = max((r for r in rules if r.fits(host, path)), key=lambda r: len(r.name), default=None)
        bad = any(p.fits(host, path) for p in url_rules.host_words())
        plain.append((i, host, path, fit and fit.name, fit.verdict if fit else "block" if bad else "allow"))
    assert sorted(map(str, (tuple(r.values()) for r in got))) == sorted(map(str, plain))
    by = {r["page_id"]: r for r in got}
    assert by[1]["rule"] == "example.net/en/" and by[2]["rule"] == "net/" and by[3]["rule"] is None and by[9]["verdict"] == "block"
    assert (by[6]["host"], by[6]["path"], by[6]["verdict"]) == ("", "", "allow") and by[12]["host"] == "e.org" and by[11]["verdict"] == "allow"
    assert rows(url_rules.filter_urls(df.limit(0), rules)) == []


# -- 10 -----------------------------------------------------------------------------------------
def test_decontamination(spark, frame):
    item = " ".join(f"q{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item, "x"), (2, "short Item", "x"), (3, None, "x"), (4, "", "x"), (10, item, "x")], "item_id long, text string, doc_id string")
    texts = ODD + [(30, "pre " + item.upper().replace(" ", "-- ") + " post"), (31, "a short, item."), (32, item[:-4]), (33, "q0 q1 q2 q3"), (34, "shorts items"),
                   (35, "\u00e9\u00e9 short\nitem \u00e9")]
    got = {r["doc_id"]: r for r in rows(decontaminate.find_benchmark(frame(texts), bench)) if r["doc_id"] is not None}
    assert (got[30]["n_words"], got[30]["n_hit"], got[30]["items"]) == (16, 14, ["1", "10"])
    assert (got[31]["n_hit"], got[31]["items"]) == (2, ["2"]) and got[32]["n_hit"] == 13 and not got[33]["contaminated"] and not got[34]["contaminated"]
    assert got[35]["spans"] == [{"begin": 3, "end": 13}] and got[1]["n_words"] == 0 and got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[30]["items_sha256"] == hashlib.sha256(b"1,10").hexdigest()
    assert decontaminate.find_benchmark(frame([]), bench).count() == 0
    assert decontaminate.find_benchmark(frame(ODD), bench.limit(0)).filter("contaminated").count() == 0
    with pytest.raises(ValueError):
        decontaminate.find_benchmark(frame(ODD), bench, max_bytes=3)
