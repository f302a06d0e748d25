import hashlib
import math
import re
import zlib
from collections import Counter, namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm import attention, bpe, chat, language_id, lm, mixing

from .fixtures import SCHEMA, documents, messy, write


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_bpe_query_round_trip(spark, tmp_path):
    rows = [*documents(), (900, "word " * 30000 + "x" * 70000, "en", "s", 1, 1, "", "", 1, 1)]
    got = {r["doc_id"]: r for r in bpe.op9_bpe(spark, write(spark, tmp_path, rows)).collect()}
    for r in rows:
        ids = np.array(bpe.encoding(bpe.VOCABULARY).encode_ordinary(r[1] or ""), "<u4").tobytes()
        assert got[r[0]][1:] == (len(ids) // 4, sha(ids), sha((r[1] or "").encode()))


@pytest.mark.parametrize("seed", range(4))
def test_chunks_stitch_to_the_whole(seed):
    rng = np.random.default_rng(seed)
    letters = list("ab'lsre  \n\t 1.é —")
    for k in range(60):
        text = "".join(rng.choice(letters, rng.integers(1, 300)))
        if k % 4 == 0:
            text = text[:50] + "a" * 100 + text[50:] + " " * 90 + text
        chunks, rows = bpe.chunks_of(text, 40, 12), []
        for j, (start, end, window) in enumerate(chunks):
            lead, trail = bpe.pretokenise(window, start, end, 12, j == 0, j == len(chunks) - 1)
            rows.append({"start": start, "end": end, "window": window, "lead": lead, "trail": trail, "ids": bpe._inner(window, start, lead, trail, bpe.VOCABULARY)})
        assert bpe.stitch(rows, bpe.VOCABULARY) == bpe.encode_text(text, bpe.VOCABULARY)


def test_encode_and_decode_messy_and_empty(spark):
    docs = spark.createDataFrame(messy(), SCHEMA)
    out = bpe.decode(bpe.encode(docs, chunk=200, overlap=50)).collect()
    assert sorted(bytes(r["decoded"]) for r in out) == sorted((r[1] or "").encode() for r in messy())
    assert bpe.encode(docs.limit(0)).count() == 0


def test_language_id(spark, tmp_path):
    names = {"en": "the quick brown fox jumps over the lazy dog and then some more words", "fr": "le renard brun saute par dessus le chien paresseux et encore des mots", "de": "der schnelle braune fuchs springt über den faulen hund und noch mehr wörter"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.permutation(names[k].split())), k, "s", 1, 1, "", "", 1, 1) for i in range(90) for k in [list(names)[i % 3]]]
    rows += [(1000, None, "en", None, 0, 1, "", "", 1, 1), (1001, "123 !?", "en", None, 0, 1, "", "", 1, 1), (1002, "the dog", None, None, 0, 1, "", "", 1, 1)]
    out = {r["doc_id"]: r for r in language_id.op1_language_id(spark, write(spark, tmp_path, rows)).collect()}
    assert len(out) == len(rows)
    for r in rows:
        assert out[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 3 == 1)
        assert 0 <= out[r[0]]["score"] <= 1
    held = [r for r in rows[:90] if out[r[0]]["held_out"]]
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held) > 0
    assert out[1000]["lang_pred"] == out[1001]["lang_pred"] == "und" and out[1002]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language_id.op1_language_id(spark, write(spark, tmp_path, [(1, "abc", None, None, 1, 1, "", "", 1, 1)])).collect()} == {"und"}
    assert language_id.op1_language_id(spark, write(spark, tmp_path, [])).count() == 0


def test_language_scores_do_not_depend_on_neighbours():
    model = (["x", "y"], np.log(np.random.default_rng(0).dirichlet(np.ones(1 << 15), 2)).T.astype(np.float32))
    texts = ["", None, "Hello wörld", "1", "abc def " * 50, "ẞ İ x"]
    together = language_id.predict_texts(texts, *model)
    for i, x in enumerate(texts):
        alone = language_id.predict_texts([x], *model)
        assert alone[0][0] == together[0][i] and math.isclose(alone[1][0], together[1][i], abs_tol=1e-6)
        assert np.isclose(alone[2][0], together[2][i]) and alone[3][0] == together[3][i]


@pytest.mark.parametrize("slice_", [7, 1 << 20])
def test_naive_bayes_by_hand(monkeypatch, slice_):
    """Counts of lower-cased letters with one space for everything else, whatever the slices."""
    monkeypatch.setattr(language_id, "_SLICE", slice_ * 240 if slice_ < 100 else slice_)
    buckets, texts = 64, ["Ab, c!", "zz top AB", "ß", "ab" * 900]
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(buckets), 3)).T.astype(np.float32)
    langs, scores, fits, _ = language_id.predict_texts(texts, ["x", "y", "z"], logs)

    def bucket(gram):
        value = 0
        for c in gram:
            value = (value * 0x100000001B3 + ord(c)) % 2**64
        return int(language_id.mix(np.array([value + len(gram)], np.uint64))[0]) % buckets

    for i, x in enumerate(texts):
        text = re.sub("[^a-zß]+", " ", x.lower()).strip() + " "
        grams = [(text + "  ")[k : k + n] for n in (1, 2, 3) for k in range(len(text))]
        sums = sum(logs[bucket(g)].astype(float) for g in grams)
        odds = np.exp((sums - sums.max()) * min(1, language_id.EVIDENCE / len(grams)))
        assert langs[i] == "xyz"[sums.argmax()] and math.isclose(scores[i], 1 / odds.sum(), rel_tol=1e-4)
        assert math.isclose(fits[i], sums.max() / len(grams) - (np.exp(logs) * logs).sum(axis=0)[sums.argmax()], rel_tol=1e-3)


def filled(sizes, weights=(3.0, 1.0, 2.0)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in free}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), [None, "a", "b", "zé", "ab", "hot"][int(rng.choice(6, p=[0.1, 0.1, 0.1, 0.1, 0.1, 0.5]))]) for i in range(400)]
    full = [(i, t, "en", s, 1, 1, "", "", 1, 1) for i, t, s in rows] + [(1000, None, None, "nul", 1, 1, "", "", 1, 1)]
    out = mixing.op5_mixing(spark, write(spark, tmp_path, full)).collect()
    sizes = Counter()
    for r in full:
        sizes[r[3]] += len((r[1] or "").split())
    goal, taken, source = filled(sizes), Counter(), {r[0]: r[3] for r in full}
    for r in out:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], goal[s], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = mixing.op5_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixing_of_messy_and_empty_tables(spark, tmp_path):
    assert mixing.op5_mixing(spark, write(spark, tmp_path, messy())).count() == len(messy())
    assert mixing.op5_mixing(spark, write(spark, tmp_path, [])).count() == 0
    docs = spark.createDataFrame(messy(), SCHEMA)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    total = sum(len((r[1] or "").split()) for r in messy())
    assert abs(sum(len((r["text"] or "").split()) for r in out.collect()) - 1.5 * total) <= 4


def test_mixing_runs_no_python(spark, tmp_path):
    plan = mixing.op5_mixing(spark, write(spark, tmp_path, documents()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_lm_query(spark, tmp_path):
    rows = documents()
    out = {r["doc_id"]: r for r in lm.op4_lm_score(spark, write(spark, tmp_path, rows)).collect()}
    tokens = {r[0]: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())] + [None] for r in rows}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        assert out[i]["train_tokens"] == n and out[i]["n_tokens"] == len(t) and out[i]["n_known"] == sum(counts[w] > 0 for w in t)
        assert math.isclose(out[i]["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert -20 * len(t) * 400 < out[i]["score"] < 0
    assert lm.op4_lm_score(spark, write(spark, tmp_path, messy())).count() == len(messy())
    assert lm.op4_lm_score(spark, write(spark, tmp_path, [])).count() == 0


VOCABULARY_SIZE = 2 * lm.encoding(lm.VOCABULARY).n_vocab + 2


def subword_model(seed: int) -> lm.Subwords:
    rng = np.random.default_rng(seed)
    counts = (rng.pareto(1, VOCABULARY_SIZE) * 3).astype(np.int64)
    return lm.Subwords(counts, rng.poisson(0.02, (attention.INPUTS, attention.INPUTS)).astype(float))


def plain_class_logs(flat, model: lm.Subwords, ids: list[int], place: int) -> np.ndarray:
    """Log probabilities of all classes at one place of a text, by loops over what its window shows before it."""
    p = {k: v.astype(np.float64) for k, v in attention.views(flat).items()}
    begin = place // attention.STRIDE * attention.STRIDE - attention.CONTEXT - 1
    states = []
    for slot, at in enumerate(range(begin, place)):
        if at >= -1:
            token = attention.BEGIN if at == -1 else model.inputs.of[ids[at]]
            states.append(p["embed"][token] + p["place"][slot])
    w = attention.WIDTH
    q, k, v = ([e @ p["qkv"][:, j * w : (j + 1) * w] for e in states] for j in range(3))
    weight = np.array([math.exp(float(q[-1] @ x) / math.sqrt(w)) for x in k])
    read = sum(a * x for a, x in zip(weight / weight.sum(), v, strict=True))
    h = states[-1] + read @ p["mix"]
    logits = model.prior[token].astype(np.float64) + h @ p["out"] + p["bias"]
    return logits - logits.max() - math.log(np.exp(logits - logits.max()).sum())


def test_lm_score_by_plain_loops(monkeypatch, spark):
    """Without training rows, scores are those of the first parameters; here these are any."""
    rng = np.random.default_rng(4)
    flat = (rng.standard_normal(attention.SIZE) * 0.3).astype(np.float32)
    monkeypatch.setattr(attention, "initial", lambda seed: flat.copy())
    texts = ["Ab cd-ef gh", "", "x " * 90 + "yz", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "__rid long, text string").selectExpr("*", "false as train")
    got = {r["rid"]: r["score"] for r in lm.score(docs).collect()}
    model = lm.Subwords(np.zeros(VOCABULARY_SIZE, np.int64), np.zeros((attention.INPUTS, attention.INPUTS)))
    for i, text in enumerate(texts):
        words = [lm.subwords_of([w], lm.VOCABULARY)[0].tolist() for w in (text or "").lower().encode().split()] + [[VOCABULARY_SIZE - 1]]
        ids, expected, at = [x for w in words for x in w], 0.0, 0
        for w in words:
            for j, x in enumerate(w):
                before = attention.BEGIN if j == 0 else int(model.inputs.of[w[j - 1]])
                kind = model.cls[model.inputs.of[x]]
                inside = np.flatnonzero(model.cls == kind)
                share = model.share[model.inputs.of[x]] / model.share[inside].sum()
                assert model.pairs[before].sum() == 0
                expected += plain_class_logs(flat, model, ids, at)[kind] + math.log(share) + model.inputs.within[x]
                at += 1
        assert math.isclose(got[i], expected / math.log(10), rel_tol=1e-4)


def test_lm_probabilities_of_all_subwords_sum_to_one():
    model, rng = subword_model(1), np.random.default_rng(2)
    machine = attention.Machine((rng.standard_normal(attention.SIZE) * 0.3).astype(np.float32), model.prior)
    every = np.arange(VOCABULARY_SIZE)
    classes = model.cls[model.inputs.of]
    for n in (0, 1, 40):
        ids = rng.integers(0, VOCABULARY_SIZE, n + 1)
        x, _, _, _ = attention.windows(model.inputs.of[ids], model.cls[model.inputs.of[ids]], np.array([0, n + 1]))
        here = np.repeat(x[[n // attention.STRIDE]], attention.CLASSES, axis=0)
        target = np.zeros((attention.CLASSES, attention.STRIDE), np.int64)
        target[:, n % attention.STRIDE] = np.arange(attention.CLASSES)
        logs = machine.log_probabilities(here, target)[:, n % attention.STRIDE]
        for before in (attention.BEGIN, 5):
            total = np.exp(logs[classes] + model.given(every, np.full(VOCABULARY_SIZE, before))).sum()
            assert math.isclose(total, 1, rel_tol=1e-3)


def test_lm_long_words_have_no_floor(spark):
    rng = np.random.default_rng(0)
    word = "".join(rng.choice(list("qxzjkvw"), 2000))
    docs = spark.createDataFrame([(0, "the cat " * 50, True), (1, word, False), (2, word[:200], False)], "__rid long, text string, train boolean")
    got = {r["rid"]: r["score"] for r in lm.score(docs).collect()}
    assert got[1] < 8 * got[2] < -300


def test_lm_learns_from_what_it_reads(spark):
    """Texts like those that taught it score higher than with an untrained model, others don't."""
    rng = np.random.default_rng(3)
    syllables = {0: "ka ro mi ten su".split(), 1: "blo che fri gou wy".split()}
    prose = lambda k: " ".join("".join(rng.choice(syllables[k], 2)) for _ in range(60))
    rows = [(i, prose(i % 2), i < 300) for i in range(340)] + [(400, " ".join(x for p in zip(prose(0).split(), prose(1).split(), strict=True) for x in p), False)]
    got = {r["rid"]: r for r in lm.score(spark.createDataFrame(rows, "__rid long, text string, train boolean")).collect()}
    held = [got[i]["score"] / got[i]["n_tokens"] for i in range(300, 340)]
    assert np.mean(held) > -2.2  # the syllables of one kind alone would allow -1.4, those of both -2
    assert got[400]["score"] / got[400]["n_tokens"] < np.mean(held) - 0.3


def test_lessons_hold_every_training_window_once():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{rng.integers(0, 50)}" for _ in range(n)).encode() for n in (0, 5, 40, 300, 70, 1)]
    train = np.array([True, True, False, True, True, False])
    prepared = lm.prepare(0, np.arange(len(texts)), train, texts, lm.VOCABULARY)
    part = lm.Part(namedtuple("Row", [c.split()[0] for c in lm._PART.split(", ")])(*prepared))
    model = subword_model(5)
    seen = Counter()
    for turn in range(lm.ROUNDS):
        for _, y, w in lm.lessons(part, model, turn):
            seen.update(y[w > 0].tolist())
    expected = Counter()
    for t, k in zip(texts, train, strict=True):
        if k:
            ids = np.append(lm.subwords_of(t.split(), lm.VOCABULARY)[0], VOCABULARY_SIZE - 1)
            expected.update(model.cls[model.inputs.of[ids]].tolist())
    assert seen == expected


def test_attention_gradients_and_windows():
    rng = np.random.default_rng(0)
    flat = attention.initial(1) + (rng.standard_normal(attention.SIZE) * 0.05).astype(np.float32)
    machine = attention.Machine(flat, rng.standard_normal((attention.INPUTS, attention.CLASSES)).astype(np.float32))
    x = rng.integers(0, attention.BEGIN, (3, attention.LENGTH))
    x[0, :5] = attention.PAD
    y = rng.integers(0, attention.CLASSES, (3, attention.STRIDE))
    gradient = machine.gradient(x, y, np.ones(y.shape, np.float32))
    at = 0
    for name, part in attention.views(gradient).items():
        i = at + int(np.abs(part).argmax())
        old, step = flat[i], np.float32(2e-2)
        flat[i] = old + step
        high = -machine.log_probabilities(x, y).mean()
        flat[i] = old - step
        low = -machine.log_probabilities(x, y).mean()
        flat[i] = old
        assert math.isclose(gradient[i], (high - low) / (2 * step), rel_tol=0.05), name
        at += part.size
    first = np.array([0, 0, 1, 70, 120])
    _, _, real, place = attention.windows(np.arange(120), np.arange(120), first)
    assert sorted(place[real].tolist()) == list(range(120))


def test_subwords_of_words_with_other_white_space():
    for words in ([b"abc", "x y".encode(), " z".encode()], [b"one", b"two"], []):
        ids, width = lm.subwords_of(words, lm.VOCABULARY)
        assert len(width) == len(words) and width.sum() == len(ids)
        decoded = lm.encoding(lm.VOCABULARY).decode_bytes((ids // 2).tolist())
        assert decoded == b"".join(b" " + w for w in words)


CHATS = [
    ("User: hi there\nAssistant: hello\nhow are you?\nUser: fine", ["user", "assistant", "user"]),
    ("<|system|>\nbe kind\n<|user|>\nwhat is this?\n<|assistant|>\na test", ["system", "user", "assistant"]),
    ("### Human:\nquestion one\n\n### Assistant:\nanswer\n\nmore of it without a mark", None),
    ("Human: note: a: b\nAI: ok", ["user", "assistant"]),
]


@pytest.mark.parametrize("text,roles", CHATS)
def test_parse_chats(text, roles):
    turns = chat.parse(text)
    if roles:
        assert [r for r, _ in turns] == roles
    assert all(x.strip() for _, x in turns)
    assert chat.render(turns).count("<|end|>") <= len(turns)


def expected_chats(written):
    """What op6_chat_format returns, by conversation, from all written turns in one place."""
    talks = {}
    for r in sorted(written, key=lambda r: ((r["conv"] or ""), r["conv"] is not None, r["turn"] is not None, r["turn"] or 0, r["role"] is not None, r["role"] or "", r["h"])):
        talks.setdefault(r["conv"], []).append((r["role"], r["line"], r["shown"]))
    teach = [k for k in talks if k is None or zlib.crc32(k.encode()) % 3 != 1]
    tables = chat.tables_of(sum((chat.counted([(r, x) for r, x, _ in talks[k]]) for k in teach), np.zeros(sum(chat._SIZES)))).fixed()
    digest = lambda turns: hashlib.sha256(chat.render(turns).encode()).hexdigest()
    out = {}
    for k, turns in talks.items():
        lines = chat.lines_of("\n".join(x for _, x, _ in turns))
        logs, marks = chat.emissions(lines, tables)
        best, back = tables.start + logs[0], []
        for row in logs[1:]:
            ways = best[:, None] + tables.move
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        path = [int(best.argmax())]
        for x in reversed(back):
            path.append(int(x[path[-1]]))
        found = chat.turns_of(chat.spoken(np.array(path[::-1]), lines, marks))
        out[k] = (len(turns), len(found), " ".join(r for r, _ in found), " ".join(r or "?" for r, _, _ in turns), digest(found), digest([(r, x.strip()) for r, _, x in turns if r in chat.ROLES and x.strip()]))
    return out


ODD_CHATS = [
    (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, None, None, None), (None, 3, "user", "a?\n\n"), (2, 5, "assistant", "x" * 50000), (3, 0, "user", " "), (3, 1, "assistant", ""), (3, 2, "user", "\n"),
    *[(4, k, ("user", "assistant")[k % 2], ("", "why?", "so. And on.", "- a\n\n- b", "same", "same")[k % 6]) for k in range(300)], *[(5, 7, "user", "again")] * 40, *[(6, k, "user", "") for k in range(30)],
]


@pytest.mark.parametrize("turns,chars", [(1, 1 << 20), (7, 1 << 20), (100, 60), (4096, 4 << 20)])
def test_chat_query_against_plain_decoding(spark, tmp_path, monkeypatch, turns, chars):
    spark.createDataFrame(ODD_CHATS, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    written = chat.written_turns(spark.read.parquet(f"{tmp_path}/conversations.parquet")).withColumn("h", F.xxhash64("line")).collect()
    monkeypatch.setattr(chat, "PIECE_TURNS", turns)
    monkeypatch.setattr(chat, "PIECE_CHARS", chars)
    pieces = chat.pieces_of(chat.written_turns(spark.read.parquet(f"{tmp_path}/conversations.parquet")))
    assert pieces.filter(f"size(roles) > {turns}").isEmpty() and (turns > 1) == (pieces.count() < len(ODD_CHATS))
    got = {None if r["conv_id"] is None else str(r["conv_id"]): tuple(r)[3:] for r in chat.op6_chat_format(spark, str(tmp_path)).collect()}
    assert got == expected_chats(written)


def test_chat_query(spark, data, tmp_path):
    frame = chat.op6_chat_format(spark, data)
    out = frame.toPandas()
    assert len(out) == spark.read.parquet(f"{data}/conversations.parquet").select("conv_id").distinct().count()
    right = (out.rendered_sha256 == out.written_sha256).groupby(out["style"]).mean()
    assert right["headings"] > 0.8 and right.mean() > 0.4 and set(right.index) <= set(chat.STYLES)
    written = chat.written_turns(spark.read.parquet(f"{data}/conversations.parquet")).withColumn("h", F.xxhash64("line")).collect()
    assert {str(r["conv_id"]): tuple(r)[3:] for r in frame.collect()} == expected_chats(written)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert chat.op6_chat_format(spark, str(tmp_path)).count() == 0
    frame = spark.createDataFrame([("User: a", 1, "k"), (None, 2, "l"), ("", 3, "m")], "transcript string, turns int, __chat string")
    got = chat.format_chats(frame).collect()
    assert [len(r["turns"]) for r in got] == [1, 0, 0] and got[1]["rendered"] == "" and [r["__chat"] for r in got] == ["k", "l", "m"]


def test_many_sequences_at_once():
    rng, tables = np.random.default_rng(1), chat.USUAL.fixed()
    logs = [rng.integers(-3, 1, (n, 6)) for n in (5, 1, 9, 5, 30)]
    together = chat.best_paths(logs, [tables.start] * 5, tables.move)
    assert all((chat.viterbi(x, tables) == p).all() for x, p in zip(logs, together, strict=True))
    assert chat.best_paths([], [], tables.move) == []
    score = lambda x, p: tables.start[p[0]] + x[np.arange(len(p)), p].sum() + tables.move[p[:-1], p[1:]].sum()
    for x, p in zip(logs, together, strict=True):
        assert chat.transfer(x, np.broadcast_to(tables.start, (6, 6)), tables.move)[0].max() == score(x, p)


def test_rendered_turns():
    assert chat.render([("user", "a"), ("user", "b"), ("assistant", "c")]) == "<|user|>\na\nb\n<|end|>\n<|assistant|>\nc\n<|end|>\n"
    assert chat.render([]) == ""


def test_tables_are_shares_of_what_was_counted():
    counts = chat.counted([("user", "User: why?"), ("assistant", "\nAI: so\n- a"), (None, "stray"), ("user", "no marker")])
    start, move, mark, yes, lines = np.split(counts, np.cumsum(chat._SIZES)[:-1])
    assert start.tolist() == [0, 1, 0, 0, 0, 0] and lines.tolist() == [0, 2, 1, 0, 1, 1]
    move = move.reshape(6, 6)
    # user opens, blank goes on, assistant opens, goes on; the stray turn and the step behind it teach nothing
    assert {(a, b): move[a, b] for a, b in zip(*np.nonzero(move), strict=True)} == {(1, 4): 1, (4, 2): 1, (2, 5): 1}
    assert mark.reshape(6, 3)[1].tolist() == [1, 0, 1] and yes.reshape(6, 5)[1].tolist() == [0, 1, 0, 0, 0] and yes.reshape(6, 5)[5].tolist() == [0, 0, 0, 1, 0]
    tables = chat.tables_of(counts)
    assert np.allclose(np.exp(tables.move).sum(axis=1), 1) and np.allclose(np.exp(tables.yes) + np.exp(tables.no), 1)


def test_viterbi_is_the_best_path():
    from itertools import product

    logs, tables = np.log(np.random.default_rng(4).dirichlet(np.ones(6), 5)), chat.USUAL
    value = lambda p: tables.start[p[0]] + logs[0, p[0]] + sum(tables.move[a, b] + logs[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:], strict=False)))
    best = max(product(range(6), repeat=5), key=value)
    assert math.isclose(value(tuple(chat.viterbi(logs, tables))), value(best))
