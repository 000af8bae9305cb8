"""The registered queries against plain Python, on small odd tables and on the generated ones."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from graphloom.llm import queries as Q
from graphloom.llm import bpe_automaton, chat_format, lang_id, lm_scoring, near_dedup, packing, quality_rules, suffix_dedup, token_files

from . import brute
from .conftest import SF, texts_of


@pytest.fixture(params=["small", "generated"])
def folder(request, small):
    return small if request.param == "small" else SF


def rows(df):
    return df.collect()


def encoded(name, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation(), tok.no_padding()
    return [x.ids for x in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)], tok


def test_op1(spark, folder):
    t = pq.read_table(f"{folder}/conversations.parquet").to_pylist()
    control = "</s>[INST] ok [/INST]"
    want = brute.conversations([(r["conv_id"], -1 if r["turn"] is None else r["turn"], r["role"], r["text"]) for r in t] + [(-1, 0, "user", control), (-1, 1, "assistant", control)])
    got = rows(Q.op1_chat_format(spark, folder))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    escaped = lambda text: len(text) + len(ESCAPED.findall(text))
    size = {}
    for r in t + [{"conv_id": -1, "role": "user", "text": control}, {"conv_id": -1, "role": "assistant", "text": control}]:
        role, text = r["role"] or "", r["text"] or ""
        n = len("<|im_start|>") + escaped(role) + role.count("\n") + 1 + escaped(text) + len("<|im_end|>\n")
        size[r["conv_id"]] = size.get(r["conv_id"], 0) + n
    assert len(got) == len(want) and {r.conv_id: r.formatted_chars for r in got} == size


ESCAPED = re.compile("|".join([r"\\", *(f"(?={re.escape(c.decode())})." for c in chat_format.CONTROL)]), re.S)


def test_op1_no_control_string_is_left(spark, small):
    """Formatted pieces hold the template's own control strings alone, and read back to what went in;
    pieces are cut between turns, whatever their size."""
    table = spark.read.parquet(f"{small}/conversations.parquet")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(chat_format, "PIECE_BYTES", 50)
        pieces = chat_format.format_conversations(table).orderBy("piece").collect()
    back = []
    for r in pieces:
        body = bytes(r.formatted)
        turns = chat_format.read_turns(body)
        back += [(r.conv_id, a.decode(), b.decode()) for a, b in turns]
        assert len(turns) == r.n_turns and body.startswith(chat_format.START) and body.endswith(chat_format.END)
        assert body.count(b"<|im_start|>") == body.count(b"<|im_end|>") == r.n_turns
        assert not any(c in body for c in chat_format.CONTROL[2:])
        own = [b for a, b in turns if a == b"assistant"]
        assert [chat_format.unescape(body[x.start : x.end]) for x in r.loss] == own
    want = sorted((r.conv_id, -1 if r.turn is None else r.turn, r.role or "", r.text or "") for r in table.collect())
    assert sorted(back) == sorted((c, a, b) for c, _, a, b in want) and len(pieces) > len({c for c, *_ in want})


def test_op2(spark, folder):
    docs = sorted(((i, t or "") for i, t in texts_of(folder)), reverse=True)
    got = {r.doc_id: r for r in rows(Q.op2_fingerprint(spark, folder))}
    prints, off_by = {}, []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        a, b = brute.shingles(t), brute.shingles(edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(a) > 300:
            off_by.append(abs(r.near_edited - len(a & b) / len(a | b)))
    assert len(got) == len(docs) and np.mean(off_by) < 0.06


def test_op2_short_texts(spark, small):
    """Likeness is that of the whole sets of shingles, and texts of other shingles have another fingerprint."""
    docs = sorted(((i, t or "") for i, t in texts_of(small) if (t or "").isascii()), reverse=True)
    got = {r.doc_id: r for r in rows(Q.op2_fingerprint(spark, small))}
    every = {i: t or "" for i, t in texts_of(small)}
    prints = {}
    for i, t in docs:
        prints.setdefault(got[i].fingerprint, set()).add(brute.shingles(t))
        if i - 1 not in every or not every[i - 1].isascii():
            continue
        nxt = every[i - 1]
        a = brute.shingles(t)
        for b, near in ((nxt, got[i].near_next), (t[: len(t) - len(t) // 2] + nxt[: len(t) // 2], got[i].near_edited)):
            b = brute.shingles(b)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9
    assert all(len(x) == 1 for x in prints.values())


def test_op3(spark, folder):
    got = rows(Q.op3_near_dedup(spark, folder))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_duplicates(texts_of(folder))


def test_op2_odd_ids(spark, odd):
    """Rows follow each other by id, hash and text, null ids last; a hot id is cut into ranges of its own."""
    from pyspark.sql import functions as F

    from graphloom.llm import fingerprint

    hot = [(5, f"text {k} of the hot id") for k in range(300)] + [(None, f"no id {k}") for k in range(200)] + [(k, f"word {k}") for k in range(100)]
    for docs in (texts_of(odd), hot):
        df = spark.createDataFrame([(i, t or "") for i, t in docs], "doc_id long, text string")
        got = [(r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(df, "text").collect()]
        hashed = [(r.doc_id, r.h, r.text) for r in df.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()]
        chain = sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]), reverse=True)
        want = [(i, t, chain[(k + 1) % len(chain)][2]) for k, (i, _, t) in enumerate(chain)]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(rows(Q.op2_fingerprint(spark, odd))) == len(texts_of(odd))


def linked_rows(docs):
    """(doc_id, n_shingles, component_id, kept) of rows, which their texts alone link."""
    numbered = [(k, t) for k, (i, t) in enumerate(docs) if i is not None]
    groups = brute.near_duplicates(numbered)
    least = {}
    for k, (n, c, _) in groups.items():
        least[c] = min(least.get(c, docs[k][0]), docs[k][0])
    out = []
    for k, (i, t) in enumerate(docs):
        n = len(brute.shingles(t))
        c = None if i is None else least[groups[k][1]]
        out.append((i, n, c, c is None or i == c))
    return out


def test_op3_odd_ids(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows(Q.op3_near_dedup(spark, odd))]
    assert sorted(got, key=repr) == sorted(linked_rows(texts_of(odd)), key=repr)
    from graphloom.llm.common import documents

    kept = [(r.doc_id, r.text) for r in near_dedup.near_dedup(documents(spark, odd)).collect()]
    docs = texts_of(odd)
    assert sum(i is None for i, _ in kept) == sum(i is None for i, _ in docs)
    assert len([x for x in kept if x[0] == 7]) == 3 and len([x for x in kept if x[0] == 13]) == 1 and len([x for x in kept if x[0] == 9]) == 2


def near_copies_table(spark, n, apart=0, seed=3):
    """n near copies of one text, each with words of its own, and as many as `apart` texts half like it."""
    rand = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    def text(k, cut):
        own = list(base)
        for j in range(cut):
            own[(k * 7 + j * 31) % 120] = f"x{k}_{j}"
        return " ".join(own)
    docs = [(k, text(k, 1)) for k in range(n)] + [(n + k, text(k, 6)) for k in range(apart)]
    rand.shuffle(docs)
    return docs


def test_op3_large_groups(spark, monkeypatch):
    """Where a node is far too large, rows grow with documents, and every link is still found."""
    monkeypatch.setattr(near_dedup, "NODE_LIMIT", 64)
    monkeypatch.setattr(near_dedup, "CLUSTER_SHINGLES", 5000)
    made = {}
    real = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name, *a: made.setdefault(name, []).append(real(df, name, *a)) or made[name][-1])
    dealt = []
    together = near_dedup._together
    monkeypatch.setattr(near_dedup, "_together", lambda rows, *a: dealt.append(rows.count()) or together(rows, *a))
    sums = {}
    for n in (512, 2048):
        docs = near_copies_table(spark, n, apart=12)
        dealt.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        if n == 512:
            assert got == brute.near_duplicates(docs)
        assert {got[k][1] for k in range(n)} == {0}
        sums[n] = sum(dealt)
    assert sums[2048] < 4.6 * sums[512], sums


def test_op3_recall(spark):
    """Links of pairs just above the threshold: all are found, by brute force."""
    rand = random.Random(11)
    docs = []
    for k in range(300):
        base = [f"{k}_{i}" for i in range(100)]
        docs.append((2 * k, " ".join(base)))
        for j in rand.sample(range(100), 3 if k % 2 else 2):
            base[j] = f"new{j}"
        docs.append((2 * k + 1, " ".join(base)))
    want = brute.near_duplicates(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pairs = sum(not kept for _, _, kept in want.values())
    assert got == want and 100 < pairs < 300


def test_op4(spark, folder):
    got = rows(Q.op4_suffix_dedup(spark, folder))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.suffix_dedup(texts_of(folder))


def test_op4_odd_ids(spark, odd):
    """Rows are documents of their own, whatever their ids."""
    docs = texts_of(odd)
    want = brute.suffix_dedup(enumerate(t for _, t in docs))
    got = rows(Q.op4_suffix_dedup(spark, odd))
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(((docs[k][0], *w) for k, w in want.items()), key=key)
    assert sum(w[1] > 0 for w in want.values()) > 8


def test_op4_hot_grams(spark, folder, monkeypatch):
    """Every gram treated as one with many windows: windows dealt out by content give the same result."""
    monkeypatch.setattr(suffix_dedup, "SORT_WINDOWS", 1)
    got = rows(Q.op4_suffix_dedup(spark, folder))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.suffix_dedup(texts_of(folder))


def test_op5(spark, folder):
    got = {r.doc_id: r for r in rows(Q.op5_lang_id(spark, folder))}
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == (brute.fold(d["doc_id"], 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d["text"] or ""))
        if r.held_out and folder == SF:
            right.append(r.lang_pred == d["lang"])
    assert folder != SF or np.mean(right) > 0.9


def profile_of(text, n=lang_id.PROFILE):
    """The most frequent one to three letters of the padded words, ties by value."""
    grams = Counter()
    for word in re.findall("[a-z]+", text.lower()):
        padded = "\x01" + word + "\x01"
        grams.update(word)
        grams.update(padded[i : i + 2] for i in range(len(padded) - 1))
        grams.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != "\x01")
    value = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
    return sorted(grams, key=lambda g: (-grams[g], value(g)))[:n]


def test_op5_distance(spark):
    """lang_pred and score are those of the out-of-place distance, by plain Python."""
    rand = random.Random(6)
    alphabets = {"aa": "abcdefg", "bb": "efghijk", "cc": "hijklmab"}
    text = lambda a, n: " ".join("".join(rand.choices(a, k=rand.randint(2, 6))) for _ in range(n))
    labelled = [(k, text(alphabets[lang], 40), lang) for k, lang in enumerate(sorted(alphabets) * 8)]
    profiles = lang_id.fit_profiles(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    want = {lang: profile_of(" ".join(t for _, t, x in labelled if x == lang)) for lang in alphabets}
    for a in [*alphabets.values(), "abcxyz", "eh"]:
        own_text = text(a, rand.randint(1, 30))
        own = profile_of(own_text)
        far = {lang: sum(min(abs(p.index(g) - k), lang_id.PROFILE) if g in p else lang_id.PROFILE for k, g in enumerate(own)) for lang, p in want.items()}
        best = min(sorted(far), key=far.get)
        assert profiles.predict(own_text.encode()) == (best, pytest.approx(1 - far[best] / (lang_id.PROFILE * len(own))))
    assert profiles.predict(b"12 34") == ("und", 0.0)


def test_op5_fit_rows_are_a_share(spark):
    """Each language gives about the asked number of rows, and a rare one all of its own."""
    docs = [(k, f"text {k}", "big" if k % 10 else "rare") for k in range(5000)] + [(None, None, "big"), (None, "x", None)]
    got = Counter(r.lang for r in lang_id._fit_texts(spark.createDataFrame(docs, "doc_id long, text string, lang string"), 600).collect())
    assert got["rare"] == 500 and 520 < got["big"] < 680


def test_op5_fits_on_all_rows(spark):
    """Profiles and cutoffs count every labelled row, also where a language has several thousand."""
    rand = random.Random(9)
    alphabets = {"aa": "abcdefghijkl", "bb": "ghijklmnopqr"}
    text = lambda a: " ".join("".join(rand.choices(a, k=rand.randint(2, 6))) for _ in range(rand.randint(2, 9)))
    docs = [(k, text(alphabets[lang]), lang) for k, lang in enumerate(sorted(alphabets) * 4000)]
    labelled = spark.createDataFrame([*docs, (-1, None, "aa"), (-2, "zz zz", None)], "doc_id long, text string, lang string")
    profiles = lang_id.fit_profiles(labelled)
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
    scores = {lang: [] for lang in alphabets}
    for i, lang in enumerate(profiles.langs):
        ranked = sorted((r, int(g)) for r, g in zip(profiles.ranks[i], profiles.grams) if r < lang_id.PROFILE)
        assert [g for _, g in ranked] == [code(g) for g in profile_of(" ".join(t for _, t, x in docs if x == lang))]
    for _, t, lang in docs:
        pred, score = profiles.predict(t.encode())
        if pred == lang:
            scores[lang].append(score)
    got = lang_id.fit_cutoffs(labelled, profiles, 0.01, 0.2, 100)
    for lang, own in scores.items():
        low = sorted(own)[math.ceil(0.01 * len(own)) - 1]
        assert got[lang] == math.floor(low * lang_id.SCORE_STEPS) / lang_id.SCORE_STEPS - 0.2


def test_op6(spark, folder):
    held = lambda i: brute.fold(i, 7) == 2
    want = brute.unigram(texts_of(folder), held)
    got = rows(Q.op6_lm_scoring(spark, folder))
    assert len(got) == len(want)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0
    if folder == SF:  # the model beats the unigram base on texts that it hasn't seen
        test = [r for r in got if r.held_out]
        assert sum(r.score for r in test) > sum(r.base_score for r in test)


def lm_tokens(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return lm_scoring._documents_tokens(data, np.array([0, len(data)]))


def fitted(spark, text, head, monkeypatch, times=8):
    """Counts of a text with about `head` words at hand, and a model trained on it in one task."""
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    counts = lm_scoring.head_counts(lm_scoring.count_words(spark.createDataFrame([(text,)], "text string")))
    trainer = lm_scoring.Trainer(counts)
    for _ in range(times):
        trainer.learn(*lm_tokens(text))
    return counts, lm_scoring.Model(counts, trainer.weights)


@pytest.mark.parametrize("head", [1 << 18, 1200])
def test_op6_probabilities(spark, monkeypatch, head):
    """All words' probabilities after any words sum to one, whether they are at hand or in buckets, and
    the words before tell even rare words apart."""
    n = 1500
    text = " ".join(f"left{i} right{i}" for i in range(n)) + " the end" * 200
    counts, model = fitted(spark, text, head, monkeypatch)
    tokens, _ = lm_tokens(text)
    words, times = np.unique(tokens, return_counts=True)
    assert len(counts.words) == len(words) if head > len(words) else 0.9 * head < len(counts.words) <= 1.05 * head
    assert (head > len(words)) == (len(counts.rest) == 1)
    for before in ([tokens[2000]], [], [tokens[5], tokens[2001]]):
        def p(of):
            rows = np.concatenate([np.append(np.array(before, lm_scoring.U64), w) for w in of])
            got, place = model.token_scores(rows, np.arange(0, len(rows) + 1, len(before) + 1))
            return 10 ** got[len(before) :: len(before) + 1], place[len(before) :: len(before) + 1] < len(counts.words)

        each, at_hand = p(words)
        unseen, _ = p([lm_scoring.U64((b << 20) + 3) for b in range(len(counts.rest))])
        assert abs((each * np.where(at_hand, 1, times + 1)).sum() + unseen.sum() - 1) < 1e-3
        if len(before) == 1:
            full = each * np.where(at_hand, 1, times + 1)
            assert full[words == tokens[2001]][0] > 3 * np.median(full)


def test_op6_score_by_hand(spark, monkeypatch):
    """The score of a text, softmax by softmax, in plain Python."""
    import math

    text = " ".join(random.Random(4).choices([f"w{i}" for i in range(60)], weights=range(1, 61), k=3000))
    counts, model = fitted(spark, text, 1 << 18, monkeypatch, 1)
    tokens, off = lm_tokens("w59 w3 w58 w41 never w7")
    got, _ = model.token_scores(tokens, off)
    features, tree = lm_scoring._features(tokens, off), counts.tree
    leaves = counts.leaves(tokens, counts.place(tokens))
    for t in range(len(tokens)):
        total = 0.0
        for step in range(tree.off[leaves[t]], tree.off[leaves[t] + 1]):
            node, pick = int(tree.node[step]), int(tree.pick[step])
            rows = lm_scoring._hash_rows(features[:, t : t + 1], np.array([0]), np.array([node]), counts)[:, 0]
            z = [float(sum(model.weights[r][k] for r in rows)) + float(model.weights[node][k]) for k in range(lm_scoring.WIDTH)]
            total += z[pick] - math.log(sum(map(math.exp, z)))
        known = counts.place(tokens)[t] < len(counts.words)
        assert abs(got[t] - (total / math.log(10) - (0 if known else math.log10(counts.rest_of(tokens)[t])))) < 1e-4
    # a tree: each leaf has a path of its own, frequent words the shorter ones
    paths = {tuple(zip(tree.node[a:b].tolist(), tree.pick[a:b].tolist())) for a, b in zip(tree.off[:-1], tree.off[1:])}
    assert len(paths) == len(tree.off) - 1 and np.diff(tree.off)[0] <= np.diff(tree.off)[-1]


def test_op6_grows_with_the_vocabulary():
    sizes = [lm_scoring.Counts(np.zeros(0, lm_scoring.U64), np.zeros(0, np.int64), 1, v, np.ones(lm_scoring._bucket_count(v), np.int64)) for v in (10**4, 10**6, 10**8)]
    assert sizes[0].rows < sizes[1].rows < sizes[2].rows and len(sizes[0].rest) < len(sizes[1].rest) < len(sizes[2].rest)


def test_op6_rare_words_are_joined(spark, small, monkeypatch):
    """With few words at hand the counts of all others come by the join, and base scores stay exact."""
    monkeypatch.setattr(lm_scoring, "HEAD", 50)
    want = brute.unigram(texts_of(small), lambda i: brute.fold(i, 7) == 2)
    for r in rows(Q.op6_lm_scoring(spark, small)):
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))


@pytest.mark.parametrize("counted", [1 << 20, 700, 50])
def test_op6_counts_in_parts(monkeypatch, counted):
    """However often counts are merged and handed on, their sums are those of all tokens."""
    import pyarrow as pa

    monkeypatch.setattr(lm_scoring, "COUNTED", counted)
    rand = random.Random(6)
    texts = [None, "", *(" ".join(f"w{int(rand.paretovariate(0.7))}" for _ in range(rand.randint(0, 400))) for _ in range(40)), ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 3], pa.string())], ["text"]) for k in range(0, len(texts), 3)]
    want, got = Counter(), Counter()
    for t in texts:
        want.update(lm_tokens(t or "")[0].view(np.int64).tolist())
    for out in lm_scoring._count(iter(batches)):
        words = out.column(0).to_pylist()
        assert len(set(words)) == len(words)
        got.update(dict(zip(words, out.column(1).to_pylist())))
    assert got == want
    assert list(lm_scoring._count(iter([])))[0].num_rows == 0


def test_op6_uses_are_exact():
    """Means over tasks weigh rows by their uses: none is lost past 2 ** 24."""
    trainer = lm_scoring.Trainer(lm_scoring.Counts(np.arange(9, dtype=lm_scoring.U64), np.ones(9, np.int64), 9, 9, np.ones(1, np.int64)))
    for n in [1 << 20] * 16 + [1]:
        trainer._move(np.full((1, n), 3), np.zeros((n, lm_scoring.WIDTH), np.float32))
    assert trainer.uses[3] == (1 << 24) + 1 and trainer.uses.sum() == trainer.uses[3]


def test_op6_moves():
    """A step moves each row along the mean of its gradients, however many it has."""

    def plain(weights, state, rows, gradient):
        key = np.sort(((rows << 32) | np.arange(len(gradient))).ravel())
        row, place = key >> 32, key & 0xFFFFFFFF
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        n = np.diff(np.concatenate([first, [len(row)]]))
        row, mean = row[first], np.take(gradient, place[first], axis=0)
        many = np.flatnonzero(n > 1)
        m = n[many]
        at = np.arange(int(m.sum())) + np.repeat(first[many] - (np.cumsum(m) - m), m)
        mean[many] = np.add.reduceat(np.take(gradient, place[at], axis=0), np.cumsum(m) - m, axis=0) / m[:, None].astype(np.float32)
        own = np.take(state, row, axis=0)
        own[:, 0] += (mean * mean) @ np.ones(lm_scoring.WIDTH, np.float32) / lm_scoring.WIDTH
        own[:, 1] += n
        state[row] = own
        mean *= (np.float32(lm_scoring.STEP / (lm_scoring.FEATURES + 1) ** 0.5) / np.sqrt(own[:, 0]))[:, None]
        weights[row] = np.take(weights, row, axis=0) - mean

    rand = np.random.default_rng(8)
    trainer = lm_scoring.Trainer(lm_scoring.Counts(np.arange(9, dtype=lm_scoring.U64), np.ones(9, np.int64), 9, 4 * 10**6, np.ones(1, np.int64)))
    weights, state = trainer.weights.copy(), np.tile(np.array([lm_scoring.SQUARES, 0], np.float32), (len(trainer.weights), 1))
    for _ in range(3):
        # rows as often used as in training: few very often, most once or twice
        often = (rand.pareto(0.5, (4, 20000)) * 8).astype(np.int64) % len(weights)
        rows = np.where(rand.random((4, 20000)) < 0.5, often, rand.integers(len(weights), size=(4, 20000)))
        gradient = rand.normal(0, 0.1, (20000, lm_scoring.WIDTH)).astype(np.float32)
        trainer._move(rows, gradient)
        plain(weights, state, rows, gradient)
    assert np.abs(trainer.weights - weights).max() < 1e-5 and (trainer.uses == state[:, 1]).all()


def test_op7(spark, folder):
    docs = sorted(texts_of(folder))
    ids, _ = encoded(Q.BYTE_BPE, [t for _, t in docs])
    want, start = {}, 0
    for (i, _), own in zip(docs, ids):
        own = np.array([*own, 0], "<u4")
        want[i] = (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(Q.op7_token_files(spark, folder))} == want


def test_op8(spark, folder):
    docs = texts_of(folder)
    ids, tok = encoded(Q.BYTE_BPE, [t for _, t in docs])
    want = {i: (len(own), brute.sha(np.array(own, "<u4").tobytes()), brute.sha(tok.decode(own, skip_special_tokens=False))) for (i, _), own in zip(docs, ids)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(Q.op8_bpe(spark, folder))} == want


def random_merges(rand, letters, n):
    """Merges of tokens made before; several pairs may give one token."""
    vocab, merges = {c: i for i, c in enumerate(letters)}, []
    while len(merges) < n:
        a, b = rand.choice(list(vocab)), rand.choice(list(vocab))
        if (a, b) not in merges and len(a + b) < 9:
            merges.append((a, b))
            vocab.setdefault(a + b, len(vocab))
    return vocab, merges


def test_op8_any_merges():
    """The automaton of random merge lists walks as the library merges, word by word."""
    from tokenizers import models

    rand = random.Random(8)
    words, several = 0, 0
    for k in range(120):
        vocab, merges = random_merges(rand, "ab" if k % 2 else "abc", rand.randint(1, 40))
        automaton = bpe_automaton.Automaton(vocab, merges, {})
        several += len({a + b for a, b in merges}) < len(merges) and not automaton.unordered
        library = Tokenizer(models.BPE(vocab, merges))
        for _ in range(60):
            word = "".join(rand.choices("ab" if k % 2 else "abc", k=rand.randint(1, 14)))
            assert automaton.walk(word.encode()) == library.encode(word).ids, (merges, word)
            words += 1
    assert words == 7200 and several > 10


def test_op8_table():
    """Every transition of the compiled table is right: two tokens follow each other just if the library
    leaves them so."""
    from tokenizers import models

    rand = random.Random(3)
    for _ in range(20):
        vocab, merges = random_merges(rand, "abc", 9)
        automaton, library = bpe_automaton.Automaton(vocab, merges, {}), Tokenizer(models.BPE(vocab, merges))
        follow = {(automaton.token[x], automaton.token[y]) for x in range(len(automaton.token)) for y in range(len(automaton.token)) if automaton.has_arc(x, y)}
        text = {i: t for t, i in vocab.items()}
        for x in {*automaton.token}:
            for y in {*automaton.token} if not automaton.unordered else ():
                assert ((x, y) in follow) == (library.encode(text[x] + text[y]).ids == [x, y])


def test_op9(spark, folder):
    docs = texts_of(folder)
    ids, _ = encoded(Q.WORD_BPE, [t for _, t in docs])
    whole = {i: np.array([*own, 1], "<u4") for (i, _), own in zip(docs, ids)}
    seen = {i: np.zeros(len(x), int) for i, x in whole.items()}
    got = rows(Q.op9_packing(spark, folder))
    by = {}
    for r in got:
        own = whole[r.doc_id]
        assert r.length > 0 and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        seen[r.doc_id][r.start : r.start + r.length] += 1
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((x == 1).all() for x in seen.values())
    padding = 0
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    # every document of at most a window is one piece, and little is padded
    pieces = Counter(r.doc_id for r in got)
    assert all(pieces[i] == -(-len(x) // 2048) for i, x in whole.items())
    assert folder != SF or padding < 0.05 * sum(map(len, whole.values()))


def test_op9_count_rises_and_nothing_is_cut():
    """Whatever the sizes, items stay whole, no window is too full, and windows are near-equal."""
    rand = random.Random(2)
    for sizes, most in (([1500] * 200, 200), ([1024] * 300, 150), ([rand.randint(1, 2047) for _ in range(500)], 320), ([rand.randint(1, 50) for _ in range(3000)], 40), ([2047, 1], 1), ([7], 1)):
        windows = packing.pack(sizes)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        loads = [sum(sizes[i] for i in w) for w in windows]
        assert max(loads) <= 2048 and len(windows) <= most
        # one window fewer would have been too few for this differencing, or the step was larger than one
        k = len(windows) - 1 - len(windows) // 64
        assert k < -(-sum(sizes) // 2048) or max(sum(sizes[i] for i in p) for p in packing.differencing(sizes, k)) > 2048
    assert [sorted(p) for p in packing.differencing([8, 7, 6, 5, 4], 2)] in ([[0, 2], [1, 3, 4]], [[1, 3, 4], [0, 2]], [[0, 3, 4], [1, 2]], [[1, 2], [0, 3, 4]], [[0, 1], [2, 3, 4]], [[2, 3, 4], [0, 1]])


def test_op9_long_texts_do_not_gather():
    """Documents of many windows leave at once, those of exact multiples too: a task holds remainders alone."""
    import pyarrow as pa

    class Table:
        def encode(self, texts, end):
            return np.arange(1_024_000, dtype=np.uint32), np.array([0, 1_024_000])

    run = packing._packed("none", 1, 2048, False)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "piece_table", lambda *a, **k: Table())
        m.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)})())}))
        fed = []

        def feed():
            for k in range(300):
                fed.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array(["t"])], ["doc_id", "text"])

        n = 0
        for batch in run(feed()):
            n += batch.num_rows
            assert n >= 500 * (len(fed) - 1)  # all of the documents before are out
        assert n == 300 * 500


def test_op10(spark, folder):
    docs = texts_of(folder)
    got = rows(Q.op10_quality_rules(spark, folder))
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: brute.quality(t) for i, t in docs}
    assert not any(r.kept and r.base_failed for r in got)


def binomial_bound(bad, n, level):
    """The exact upper bound by summing the distribution itself."""
    from math import comb

    low, high = 0.0, 1.0
    for _ in range(50):
        p = (low + high) / 2
        tail = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bad + 1))
        low, high = (p, high) if tail > level else (low, p)
    return high


def test_op10_bound():
    for bad, n, level in ((0, 10, 0.05), (0, 400, 0.003), (2, 50, 0.01), (7, 60, 0.05), (30, 200, 0.001)):
        assert quality_rules.upper_bound(bad, n, level) == pytest.approx(binomial_bound(bad, n, level), abs=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.05) == quality_rules.upper_bound(0, 0, 0.05) == 1.0


def test_op10_cutoffs():
    """The cutoff is the certified one of the best balance, by trying all; none where nothing is certified."""
    rand, grid = random.Random(9), quality_rules.GRID
    for good_n in (100, 3000):
        counts = {}
        for stratum in ("a", "b"):
            for rule in ("r", "s"):
                good, bad = np.zeros(grid + 1, np.int64), np.zeros(grid + 1, np.int64)
                for _ in range(good_n):
                    good[min(grid, int(rand.expovariate(0.4)))] += 1
                for _ in range(300):
                    bad[rand.randint(0, grid)] += 1
                counts[stratum, rule] = np.stack([good, bad])
        want = {}
        for key, (good, bad) in counts.items():
            certified = []
            for step in range(grid, 0, -1):
                lost = int(good[step:].sum())
                if binomial_bound(lost, int(good.sum()), 0.05 / 4) > 0.02 / 2:
                    break
                certified.append((int(bad[step:].sum()) - lost, step))
            best = max((g for g, _ in certified), default=0)
            if best > 0:
                want[key] = max(step for g, step in certified if g == best)
        assert quality_rules.choose_cutoffs(counts, 2, 0.02, 0.05) == want
        assert len(want) == (4 if good_n == 3000 else 0)


def test_op10_kept(spark):
    """With enough labels a rule is certified, rejects what lies beyond its cutoff, and keeps its promise
    on documents that were not labelled."""
    rand = random.Random(12)
    def text(junk):
        words = ["".join(rand.choices("abcdefghijklmnop", k=6)) for _ in range(40)]
        return " ".join(w + "#$%&*" if rand.random() < junk else w for w in words)
    docs = [(k, text(0.9 if k % 5 == 0 else 0.0), "en") for k in range(6000)]
    labels = [(k, 0 if k % 5 == 0 else 1) for k in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    judged = quality_rules.judge_quality(df, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("lang")).collect()
    metrics = quality_rules.quality_metrics(df, F.col("lang"))
    cutoffs = quality_rules.fit_cutoffs(metrics, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert ("en", "symbols") in cutoffs
    for r in judged:
        step = min(int(np.ceil(r.n_symbols / max(r.word_chars, 1) / 0.5 * quality_rules.GRID)), quality_rules.GRID)
        assert not r.base_failed and r.kept == (step < cutoffs["en", "symbols"])
        assert r.doc_id < 4000 or r.kept == (r.doc_id % 5 != 0)


def test_odd_ids(spark, odd):
    """Rows with null and repeated ids: each has its result, by its own text."""
    docs = texts_of(odd)
    n = len(docs)
    held = lambda i: i is not None and brute.fold(i, 7) == 2
    tokens = brute.unigram(list(enumerate(t for _, t in docs)), lambda k: held(docs[k][0]))
    got6 = sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows(Q.op6_lm_scoring(spark, odd)))
    assert got6 == sorted((repr(i), tokens[k][0], tokens[k][1], round(float(tokens[k][3]), 6)) for k, (i, _) in enumerate(docs))
    got10 = sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows(Q.op10_quality_rules(spark, odd)))
    assert got10 == sorted((repr(i), *brute.quality(t)) for i, t in docs)
    assert sorted(repr(r.doc_id) for r in rows(Q.op5_lang_id(spark, odd))) == sorted(repr(i) for i, _ in docs)
    ids, _ = encoded(Q.BYTE_BPE, [t for _, t in docs])
    sha = lambda x: brute.sha(np.array(x, "<u4").tobytes())
    assert sorted((repr(r.doc_id), r.ids_sha256) for r in rows(Q.op8_bpe(spark, odd))) == sorted((repr(i), sha(x)) for (i, _), x in zip(docs, ids))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got7 = sorted(rows(Q.op7_token_files(spark, odd)), key=lambda r: r.start)
    assert [r.start for r in got7] == np.cumsum([0, *(r.n_tokens for r in got7[:-1])]).tolist()
    assert [r.doc_id for r in got7] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i))
    assert sorted((repr(r.doc_id), r.ids_crc32) for r in got7) == sorted((repr(i), crc([*x, 0])) for (i, _), x in zip(docs, ids))
    words, _ = encoded(Q.WORD_BPE, [t for _, t in docs])
    assert sorted((repr(r.doc_id), r.length, r.ids_crc32) for r in rows(Q.op9_packing(spark, odd))) == sorted((repr(i), len(x) + 1, crc([*x, 1])) for (i, _), x in zip(docs, words))
    assert n == len(got10)


def test_op7_planes_and_files(spark, small, tmp_path):
    """Segments in bytes and bits read back whole and in part, and files read back from their folder."""
    rand = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), rand.integers(0, 50257, 70_001).astype(np.uint32), rand.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32)):
        for bits in (False, True):
            raw = token_files.write_planes(ids, block=1 << 12, bits=bits)
            assert (token_files.read_planes(raw) == ids).all()
            for a, b in ((0, 1), (4095, 4097), (len(ids) - 3, len(ids) + 9), (7, 7)):
                assert (token_files.read_planes(raw, max(a, 0), b) == ids[max(a, 0) : b]).all()
    from graphloom.llm.common import documents

    path = f"file://{tmp_path}/tokens"
    made = token_files.write_token_files(documents(spark, small), public_tokenizers.path(Q.BYTE_BPE), bits=True, path=path)
    key = lambda df: sorted(map(tuple, token_files.token_digests(df).collect()))
    assert key(made) == key(token_files.read_token_files(spark, path)) == sorted(map(tuple, rows(Q.op7_token_files(spark, small))))


@pytest.mark.parametrize("name", Q.queries())
def test_empty_tables(spark, empty, name):
    got = rows(Q.queries()[name](spark, empty))
    assert [r.conv_id for r in got] == [-1] if name.startswith("op1_") else got == []
