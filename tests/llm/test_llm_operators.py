"""Operators of hubweave.llm against plain Python on small awkward tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hubweave.llm import chat_format, common, exact_dedup, language_id, line_dedup, lm_scoring, mixing, ngram_join, quality, sentencepiece_codec, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, set_id string, line string"


def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 40, 90]))) for _ in range(30)]
    texts = [None, "", "  \n\t ", "one", "ONE", "one two three four", "word " * 3000, "x" * 20000, *base, *base[:6]]
    for t in base[:12]:
        words = t.split()
        for _ in range(5):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append("\n".join(copy) if rng.random() < 0.3 else " ".join(copy))
    rng.shuffle(texts)
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), 0, 7, "k", "s", "l") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_ngram_groups(docs, rows, empty):
    sets = {r[0]: shingles(r[1]) for r in rows}
    expect = brute_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(docs).collect()}
    assert got == {i: (len(sets[i]), expect[i]) for i in sets}
    assert len(set(expect.values())) < len(expect) - 10
    assert ngram_join.ngram_groups(empty).count() == 0


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_with_clashing_hashes(docs):
    """A hash of two values only: the ordinals alone tell chunks apart."""
    from pyspark.sql import functions as F

    plain = sorted(exact_dedup.exact_dedup(docs).collect())
    weak = sorted(exact_dedup.exact_dedup(docs, chunk_hash=lambda c: F.pmod(F.xxhash64(c), F.lit(2))).collect())
    assert plain == weak


def test_chunks_follow_content():
    data = random.Random(1).randbytes(40000)
    ends = exact_dedup.chunk_ends(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and exact_dedup.chunk_ends(b"") == []
    pieces = {data[a:b] for a, b in itertools.pairwise([0, *ends])}
    moved = b"some bytes in front" + data
    again = {moved[a:b] for a, b in itertools.pairwise([0, *exact_dedup.chunk_ends(moved)])}
    assert len(pieces & again) >= len(pieces) - 2
    assert max(b - a for a, b in itertools.pairwise([0, *exact_dedup.chunk_ends(b"a" * 300000)])) <= 65536


def test_mixing(docs, rows, empty):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert {i: r["size"] for i, r in got.items()} == size
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got.values())
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        per[r[3]][0] += size[r[0]]
        per[r[3]][1] += got[r[0]]["taken"]
        per[r[3]][2] = got[r[0]]["target"]
    names = sorted((s for s in per if s), key=str) + [None]
    weights = dict(zip(names, (5, 2, 1), strict=True))
    left, target = set(names), {}
    total = sum(p[0] for p in per.values())
    while left:
        share = total - sum(target.values())
        over = [s for s in left if share * weights[s] / sum(weights[x] for x in left) > 3 * per[s][0]]
        if not over:
            target |= {s: share * weights[s] / sum(weights[x] for x in left) for s in left}
            break
        target |= {s: 3.0 * per[s][0] for s in over}
        left -= set(over)
    for s in names:
        assert per[s][2] == pytest.approx(target[s])
        assert abs(per[s][1] - target[s]) <= 4 * mixing.BLOCK
    assert sorted(mixing.mix(docs.repartition(2)).collect()) == sorted(got.values())
    assert mixing.mix(empty).count() == 0


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["a b  C", None, "", "dé\tf\x0b g", "aa" * 900 + " z"]
    whole = {i: s.tolist() for i, s in common.shingle_sets(pa.array(texts), 2)}
    for i, t in enumerate(texts):
        assert whole[i] == next(common.shingle_sets(pa.array([t], pa.string()), 2))[1].tolist()
    assert [len(whole[i]) for i in range(5)] == [2, 0, 0, 2, 1]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=6).round(1).tolist() for i in range(230)}
    bad = {7: None, 8: [1.0, None] + [0.0] * 4, 9: [float("nan")] * 6, 50: [float("inf")] * 6}
    frame = spark.createDataFrame([(i, bad.get(i, v), 1) for i, v in vectors.items()], "vec_id long, embedding array<float>, rank int").repartition(4)
    ints = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors.items() if i not in bad}
    expect = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted(((int(ints[q] @ ints[c]), c) for c in ints if c != q), key=lambda x: (-x[0], x[1]))[:5]
        expect += [(q, k + 1, c, s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, topk_search.top_k(frame).collect())) == sorted(expect)
    assert topk_search.top_k(frame.limit(0)).count() == 0


def test_top_k_of_components_near_the_largest_double(spark):
    """Scaled components overflow a double; scores are still exact, clamped to 64 bits."""
    rows = [(0, [1e307, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [-1.7e308, 0.0]), (4, [2.0**53 + 2, 0.5]), (5, [0.0, 0.7])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1).collect()

    def whole(x):
        return [int(c) * 256 if abs(c) >= 2.0**53 else int(np.floor(c * 256)) for c in x]

    expect = []
    for i, x in rows:
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole(x), whole(y))))), j) for j, y in rows if j != i)
        expect += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(expect)


def test_top_k_of_large_components_and_repeated_ids(spark):
    rows = [(0, [1.0, 1.0]), (1, [300000.0, 1.0]), (2, [2.0, 2.0]), (50, [3e38, -2e38]), (50, [-1e9, 1e9]), (7, [2.0, 2.0]), (100, []), (3, [])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got))
    ints = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows]
    expect = []
    for i, q in ints:
        if i % 50 == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True)))), c) for c, v in ints if c != i and len(v) == len(q))[:5]
            expect += [(i, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    assert got == sorted(expect)


def test_quality(spark, docs, rows, empty):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["good", "words", "here", "and", "there"]) for _ in range(30)) if i % 2 else "$$$ %%% " * 15) for i in range(120)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_documents(frame, labels).collect()}
    for i, _ in texts:
        assert got[i]["predicted"] == i % 2 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    scored = quality.score_documents(docs, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] == 0.5 for r in quality.score_documents(docs, labels.limit(0)).collect())
    assert quality.score_documents(empty, labels).count() == 0
    kept = {r["doc_id"] for r in quality.keep_good(frame, labels).collect()}
    assert kept == {i for i, _ in texts if i % 2}


def test_language_id(spark, docs, empty):
    words = {"xx": ["sch", "ung", "keit"], "yy": ["tion", "eau", "que"]}
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for i in range(100) for lang in [["xx", "yy"][i % 2]]]
    frame = spark.createDataFrame([*texts, (1000, None, "xx"), (1001, "12 ?!", None), (1002, "", "xx")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(frame).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["score"] > 0.9 for i, _, lang in texts)
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and got[1000]["score"] == 0
    assert {r["lang_pred"] for r in language_id.identify(frame.withColumn("lang", frame["lang"].substr(9, 1)).where("false")).collect()} == set()
    assert language_id.identify(docs).count() == docs.count() and language_id.identify(empty).count() == 0


def test_ppm_code_length_by_hand(spark):
    """Code lengths of one language against the recursion written out plainly."""
    import pandas as pd

    text = b"abracadabra"
    counts = collections.Counter()
    padded = b"\0\0\0" + text
    for i in range(len(text)):
        counts[int.from_bytes(padded[i : i + 4], "big")] += 1
    model = language_id.compile_trees(pd.DataFrame([("x", g, n) for g, n in counts.items()], columns=["lang", "gram", "n"]))

    def cost(context, symbol, k):
        if k < 0:
            return 8.0
        seen = collections.Counter()
        for i in range(len(text)):
            if padded[i + 3 - k : i + 3] == context[len(context) - k :]:
                seen[padded[i + 3]] += 1
        if not seen:
            return cost(context, symbol, k - 1)
        n, d = sum(seen.values()), len(seen)
        return np.log2((n + d) / seen[symbol]) if symbol in seen else np.log2((n + d) / d) + cost(context, symbol, k - 1)

    probe = b"abrazda"
    back = b"\0\0\0" + probe.replace(b"z", b"\0")
    expect = sum(cost(back[i : i + 3], back[i + 3] if probe[i : i + 1] != b"z" else 255, 3) for i in range(len(probe)))
    (_, bits), = language_id.code_lengths(pa.array([probe.decode()]), model)
    assert bits[0, 0] == pytest.approx(expect, rel=1e-5)


def test_lm_scoring(spark, empty):
    texts = [(0, "a b a b c"), (1, "a b c"), (2, None), (3, "d d d e"), (4, " ")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (1, 1), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(frame, labels, 64, 16).collect()}

    def model(ids):
        uni, bi = collections.Counter(), collections.Counter()
        for i, t in texts:
            w = (t or "").split() if i in ids else []
            uni.update(w)
            bi.update(zip(w, w[1:], strict=False))
        return uni, bi

    def loss(w, uni, bi):
        p = {x: (uni[x] + 1) / (sum(uni.values()) + 6) for x in "abcde"}
        out = 0
        for k, x in enumerate(w):
            held = uni[w[k - 1]] if k else 0
            both = min(bi[w[k - 1], x], held) if k else 0
            out -= np.log2((both + lm_scoring.STRENGTH * p[x]) / (held + lm_scoring.STRENGTH))
        return out / len(w)

    for i, t in texts:
        w = (t or "").split()
        a, b = (loss(w, *model({1})), loss(w, *model({0, 1, 2, 3, 4}))) if w else (0, 0)
        assert got[i]["n_tokens"] == len(w)
        assert (got[i]["loss_target"], got[i]["loss_background"], got[i]["score"]) == (pytest.approx(a), pytest.approx(b), pytest.approx(a - b))
    assert lm_scoring.score_documents(empty, labels, 64, 16).count() == 0


def test_lm_scoring_counts_all_words_and_bigrams(spark):
    """More words than a vocabulary of 65,536 and repeated and null ids, against plain counts; frequent words counted before or not."""
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.35)) % 200000}" for _ in range(400)) for _ in range(290)]
    texts += [" ".join(f"x{i}" for i in range(70000)), None, "", "one"]
    rows = [(i % 250 if i != 17 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1)], "doc_id long, quality int")
    split = [(t or "").split() for t in texts]
    every = {w for words in split for w in words}
    assert len(every) > 1 << 16
    models = []
    for some in ([i for i, (d, _) in enumerate(rows) if d is not None and d < 200 and d % 3 == 0], range(len(rows))):
        uni, bi = collections.Counter(), collections.Counter()
        for i in some:
            uni.update(split[i])
            bi.update(itertools.pairwise(split[i]))
        models.append((uni, bi, sum(uni.values()) + len(every) + 1))

    def loss(words, uni, bi, total):
        bits = 0.0
        for h, w in zip([None, *words], words, strict=False):
            p = (uni[w] + 1) / total
            bits -= np.log2((bi[h, w] + lm_scoring.STRENGTH * p) / ((uni[h] if h else 0) + lm_scoring.STRENGTH))
        return bits / max(1, len(words))

    expect = sorted((-1 if d is None else d, len(w), *(loss(w, *m) for m in models)) for (d, _), w in zip(rows, split, strict=True))
    for args in ((), (0, 5), (64, 3), (64, 40, 30), (64, 40, 2000)):  # the last two: few words or bigrams may be known, the rest is salted
        found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["loss_target"], r["loss_background"]) for r in lm_scoring.score_documents(frame, labels, *args).collect())
        assert [f[:2] for f in found] == [e[:2] for e in expect]
        assert np.allclose([f[2:] for f in found], [e[2:] for e in expect], rtol=1e-9)


def test_lm_scoring_moves_packed_texts():
    import pyarrow as pa

    texts = [None, b"", b"a" * 9_000_000, "w\u00f6rd".encode(), b"\xff no text", b"last"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts, pa.binary()).view(pa.string())], ["doc_id", "text"])
    packed = list(lm_scoring._packed([rows]))
    assert sum(b.nbytes for b in packed) < 5_000
    found = list(lm_scoring._unpacked(b.append_column("target", pa.array([False] * len(b))) for b in packed))
    assert [x for b in found for x in b["text"].view(pa.binary()).to_pylist()] == texts
    assert [x for b in found for x in b["doc_id"].to_pylist()] == list(range(6)) and len(found) == 2


def test_line_dedup(spark, empty):
    line = "the quick brown fox jumps over the lazy dog near the river bank while many people watch it happen every single day of the year"
    rows = [(0, f"{line}\nunique words here"), (1, f"Other!\n{line.upper()} \n\n"), (2, None), (3, f"{line} 12\n{line} 345"), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_groups(frame).collect()}
    assert len(got) == 10
    assert [k for k, r in sorted(got.items()) if not r["kept"]][0] == (1, 2)
    assert got[0, 1]["kept"] and got[0, 1]["group_id"] == got[1, 2]["group_id"] and got[3, 1]["group_id"] == got[3, 2]["group_id"]
    assert got[2, 1]["group_id"] is None and got[2, 1]["kept"] and got[1, 3]["kept"]
    texts = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(frame).collect()}
    assert texts[0] == rows[0][1] and texts[1] == "Other!\n\n" and texts[2] is None
    # rows that share an id, and rows without one, lose their own lines only
    shared = spark.createDataFrame([(7, f"{line}\nfirst"), (7, f"second\n{line}"), (None, f"{line}\nthird"), (None, None)], "doc_id long, text string").coalesce(1)
    left = line_dedup.deduplicated(shared).collect()
    assert sum(r["text"] is not None and line in r["text"] for r in left) == 1 and len(left) == 4
    assert {w for r in left if r["text"] for w in r["text"].split("\n") if w != line} == {"first", "second", "third"}
    assert [r["doc_id"] for r in left if r["text"] and line in r["text"]] == [None]
    assert line_dedup.line_groups(empty).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo <|im_end|>"), (1, 2, "ann", None), (1, None, "system", "rules"), (2, 0, "system", "only"), (None, 0, None, "x"), (3, 0, "ann", "t"), (3, 0, "ann", "t")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r["conv_id"], r["participant"]): r for r in chat_format.rotate_perspectives(frame).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, None), (None, "unknown"), (3, "ann")}
    ann = got[1, "ann"]
    assert ann["text"] == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann["text"][s["start"] : s["end"]] for s in ann["spans"]] == ["hi<|im_end|>", "<|im_end|>"]
    assert got[3, "ann"]["n_turns"] == 2
    long = spark.range(600).selectExpr("9L as conv_id", "cast(id as int) as turn", "'ann' as role", "'t' as text")
    pages = sorted((r["page"], r["n_turns"]) for r in chat_format.rotate_perspectives(long).collect())
    assert pages == [(1, 256), (2, 256), (3, 88)]
    # pages in order are the rendering that an uncut conversation has, and so are their spans
    talk = long.selectExpr("conv_id", "turn", "if(turn % 3 = 0, 'ann', 'bob') as role", "concat('t', repeat('x', turn % 7)) as text", "turn as start")
    for who in ("ann", "bob"):
        own = sorted((r for r in chat_format.rotate_perspectives(talk).collect() if r["participant"] == who), key=lambda r: r["page"])
        whole = "".join(r["text"] for r in own)
        assert [r["text_offset"] for r in own] == [0, len(own[0]["text"]), len(own[0]["text"]) + len(own[1]["text"])]
        said = [whole[x["start"] : x["end"]] for r in own for x in r["spans"]]
        assert said == ["t" + "x" * (t % 7) + "<|im_end|>" for t in range(600) if (t % 3 == 0) == (who == "ann")]
    assert chat_format.rotate_perspectives(frame.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_recall_on_edited_lines(spark):
    """Lines of 5 to 60 words, some with words changed, added or lost: groups against edit similarity of all pairs."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuwzéñ") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8, 9]))) for _ in range(500)]
    lines = []
    for _ in range(24):
        words = [rng.choice(vocab) for _ in range(rng.choice([5, 7, 9, 14, 27, 40, 60]))]
        for k in range(4):
            copy = list(words)
            for _ in range(k and rng.randint(1, max(1, len(words) // 9))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = rng.choice([[rng.choice(vocab)], [], [rng.choice(vocab)]])
            lines.append(" ".join(copy))
    lines += lines[:3] + ["", "!!", "a" * 30000, "a" * 30000 + " b", "shared passage of some length " * 4 + "one", "other words before the shared passage of some length"]
    frame = spark.createDataFrame([(i // 3, "\n".join(lines[i : i + 3]), "s", 1) for i in range(0, len(lines), 3)], "doc_id long, text string, line string, key int").repartition(3)
    got = line_dedup.line_groups(frame).collect()
    group = {lines[3 * r["doc_id"] + r["line_no"] - 1]: r["group_id"] for r in got}
    assert len(got) == len(lines)
    similar = same = 0
    for a, b in itertools.combinations(sorted(x for x in set(lines) if len(x) < 1000 and x[:1].isalpha()), 2):
        longest = max(len(a), len(b))
        if abs(len(a) - len(b)) <= 0.2 * longest and edit_distance(a, b) <= 0.2 * longest + 1e-9:
            similar += 1
            same += group[a] == group[b]
    assert similar > 80 and same >= 0.9 * similar
    by_group = collections.Counter(r["group_id"] for r in got if r["group_id"] is not None)
    kept = collections.Counter(r["group_id"] for r in got if r["kept"] and r["group_id"] is not None)
    assert set(kept) == set(by_group) and set(kept.values()) == {1}
    assert all(r["group_size"] == by_group.get(r["group_id"], 1) for r in got)


def test_sentencepiece_equals_the_library(spark, docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode(docs).collect()}
    for r in rows:
        assert got[r[0]]["token_ids"] == (sp.encode(r[1]) if r[1] else []) and got[r[0]]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()}
    assert back == {r[0]: r[1] or "" for r in rows}
    assert sentencepiece_codec.encode(empty).count() == 0


def test_viterbi_is_best():
    """Unigram scores: the best of all segmentations."""
    pieces = {"▁": (0, -2.0), "a": (1, -3.0), "b": (2, -3.0), "ab": (3, -4.0), "▁a": (4, -4.5), "ba": (5, -3.5), "▁ab": (6, -8.0)}
    codec = sentencepiece_codec.Codec({"kind": "unigram", "pieces": pieces, "bytes": None, "unknown": 99, "raw": [x.replace("▁", " ").encode() for x in pieces]})

    def best(word):
        return 0.0 if not word else max((pieces[word[:k]][1] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in pieces), default=-1e9)

    score = {i: s for i, s in pieces.values()}
    for n in range(1, 6):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            assert sum(score[i] for i in codec.encode([word])[1].tolist()) == pytest.approx(best("▁" + word))


def test_pipeline_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    def frame(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def left(stage, rows):
        return collections.Counter((r["doc_id"], r["text"]) for r in p.__dict__[stage](spark, frame(rows), None).collect())

    rows = [(None, "a"), (None, "a"), (1, "b"), (None, "b"), (2, "b"), (2, "clean"), (3, "c"), (3, "c"), (3, "c"), (2, "d"), (4, "d"), (None, None), (5, "")]
    assert left("exact_dedup_stage", rows) == collections.Counter([(None, "a"), (2, "b"), (2, "clean"), (3, "c"), (4, "d"), (5, "")])

    words = [[f"{name}{k}" for k in range(60)] for name in "pqrst"]
    texts = [" ".join(w) for w in words]
    near = [" ".join([*w[:-1], "changed"]) for w in words]
    rows = [(None, texts[0]), (None, near[0]), (7, texts[1]), (None, near[1]), (8, texts[2]), (7, near[2]), (9, texts[3]), (9, texts[3]), (9, near[3]), (7, texts[4]), (None, "short"), (None, None)]
    found = left("near_dedup_stage", rows)
    assert sum(found.values()) == 7
    assert [sum(n for (_, t), n in found.items() if t in pair) for pair in zip(texts, near, strict=True)] == [1] * 5
    assert {found[k] for k in [(7, texts[1]), (7, near[2]), (7, texts[4]), (None, "short"), (None, None)]} == {1}

    rows = [(None, "one two"), (None, "three"), (6, "four five six"), (6, "seven"), (6, "seven"), (10, "eight " * 70)]
    docs = frame(rows)
    mixed = collections.Counter((r["doc_id"], r["text"]) for r in p.mixing_stage(spark, docs, None).collect())
    # one source takes each of its words once
    assert mixed == collections.Counter(rows)


def test_ngram_groups_of_rows_without_ids(spark):
    text = [f"w{k}" for k in range(60)]
    far = [f"v{k}" for k in range(60)]
    rows = [(None, " ".join(text)), (None, " ".join(far)), (4, " ".join([*far[:-1], "x"])), (3, " ".join([*far[:-2], "y", "z"])), (9, " ".join(text[:-1])), (None, " ".join([*text[:-1], "x"]))]
    found = ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(r["component_id"] for r in found) == [3, 3, 3, 9, 9, 9]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    kept = common.materialize(p.exact_dedup_stage(spark, docs, sf))
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["text"]].append(r["doc_id"])
    assert {r["doc_id"] for r in kept.collect()} == {max(v) for v in texts.values()}
    near = common.materialize(p.near_dedup_stage(spark, kept, sf))
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept.collect()}
    assert {r["doc_id"] for r in near.collect()} == {i for i, c in brute_components(sets).items() if i == c}
    mixed = p.mixing_stage(spark, near, sf)
    assert mixed.columns == p.COLUMNS
    out = p.run(spark, sf)
    assert out.where("not round_trip").count() == 0 and out.count() > 0
