"""Filter audit, spelling variants and SimHash groups against plain Python."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from hubweave.llm import filter_audit, simhash_dedup, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, mask int, part string, word string, key long, bits long, words string, quality int"


def corpus():
    """Copies, near copies, short and empty texts, nulls in every column, repeated rows and ids, one very long text."""
    rng = random.Random(11)
    stems = ["straße", "übung", "éclair", "windows", "garden", "colour", "aabba", "banana", "ÀÿÀÿ", "Quite", "x"]
    vocab = stems + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    vocab += [w[:k] + rng.choice("abcÉ") + w[k + 1 :] for w in vocab for k in [rng.randrange(len(w))]] + [w + w[-1] for w in vocab[:40]]
    texts = [None, None, "", "", " \n\t ", "one", "Two", "#hash & more", "ABC DEF ghi", "x" * 3000, " ".join(rng.choice(vocab) for _ in range(20000))]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([2, 3, 49, 50, 70, 200]))) for _ in range(40)]
    texts += base + base[:15] + base[:3] * 6
    for t in base[:20]:
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(vocab + ["B%d" % rng.randrange(9), "A|C"])
            texts.append("\x0b".join(w) if rng.random() < 0.2 else "  ".join(w))
    rng.shuffle(texts)
    rows = [(i, t, None, rng.choice(["s1", "s2", "", None]), None, 5, 1, "p", "w", 3, 4, "z", 1) for i, t in enumerate(texts)]
    rows += [(None, *rows[3][1:]), (None, base[0], None, None, *rows[0][4:]), (None, *rows[5][1:]), rows[7], rows[7], (9, "another text of nine", *rows[9][2:])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fails(text):
    words = WORD.findall(text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute_audit(rows, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    ids = collections.defaultdict(set)
    for r in rows:
        if r[0] is not None:
            ids[r[1] or ""].add(r[0])
    known = []
    for r in rows:
        text = r[1] or ""
        failed = {c for c, v in fails(text).items() if v}
        if r[0] is not None and min(ids[text]) < r[0]:
            failed.add("E")
        known.append((r[3] or "", failed, r[0] in good, r[0] in toxic))
    out = {}
    for part in {k[0] for k in known}:
        own = [k for k in known if k[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [k for k in left if c in k[1]]
                left = [k for k in left if c not in k[1]]
                shapley[c] += len(gone)
                failing = sum(c in k[1] for k in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(k[1] == {c} for k in own), sum(k[2] for k in gone), sum(k[3] for k in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return out


def test_filter_audit(spark, docs, rows, empty):
    rng = random.Random(5)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, len(rows), 2)] + [(4, 1, 0), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in filter_audit.audit(docs, marks).collect()}
    assert got == brute_audit(rows, labels)
    assert len(got) == 3 * 600
    assert filter_audit.audit(empty, marks).count() == 0
    nothing = {k: v for k, v in ((tuple(r[:3]), list(r[3:])) for r in filter_audit.audit(docs, marks.where("false")).collect())}
    assert nothing == brute_audit(rows, [])


def test_filter_audit_of_other_filters(spark, docs):
    from pyspark.sql import functions as F

    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs.drop("lang"), marks, {"x": lambda text, words: F.size(words) == 0}, "y", part_col="key").collect()
    assert {(r["part"], r["filter_order"], r["step"]) for r in got} == {("3", o, s) for o in ("xy", "yx") for s in (1, 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, marks, dict.fromkeys("ABCDEFG", filter_audit.FILTERS["A"]), "H")


def test_lattice_counts_orders():
    for n in (1, 2, 3, 5):
        edges = filter_audit.lattice("ABCDEFG"[:n])
        fact = [1, 1, 2, 6, 24, 120]
        assert len(edges) == n << (n - 1)
        for state, k, orders in edges:
            assert orders == fact[bin(state).count("1")] * fact[n - 1 - bin(state).count("1")]
        for k in range(n):
            assert sum(o for _, f, o in edges if f == k) == fact[n]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_spelling(rows):
    n = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{r[0]}:{run}".encode())
            if r[0] is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, count = {}, {}
    for w in words:
        others = [v for v in words if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], count[w], words[form[w]] if form[w] else None)
    return out


def test_spelling_groups(docs, rows, empty):
    expect = brute_spelling(rows)
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_groups(docs).collect()}
    assert got == expect
    assert sum(v[0] is not None for v in expect.values()) >= 5
    assert spelling.spelling_groups(empty).count() == 0


def test_roots_of_long_chains(spark):
    chain = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(20)] + [("side", "w07"), ("a", "b")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "b" if w == "a" else "w20" for w, _ in chain}


def test_near_words_in_blocks(spark, monkeypatch):
    """Tiles cut into many blocks, and words beyond one byte a letter, give the same near words."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abж𐍈") for _ in range(rng.randint(5, 7))) for _ in range(400)})
    table = spark.createDataFrame([(w, rng.randint(3, 9)) for w in words], "word string, n long")
    n = {r[0]: r[1] for r in table.collect()}
    expect = {}
    for w in words:
        others = [v for v in words if near(w, v)]
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            expect[w] = (len(others), n[best], best)
    for block in (4, 2000):
        monkeypatch.setattr(spelling, "BLOCK", block)
        assert {r[0]: tuple(r)[1:] for r in spelling.near_words(table).collect()} == expect


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_simhash(rows):
    bits = [plain_fingerprint(r[1]) for r in rows]
    known = sorted(set(bits))
    root = {b: b for b in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(known, 2):
        if bin(a ^ b).count("1") <= 3:
            root[find(a)] = find(b)
    smallest = {}
    for r, b in zip(rows, bits):
        if r[0] is not None:
            smallest[find(b)] = min(r[0], smallest.get(find(b), r[0]))
    return sorted(((r[0], f"{b:016x}", smallest.get(find(b))) for r, b in zip(rows, bits)), key=str)


def test_simhash_groups(docs, rows, empty):
    expect = brute_simhash(rows)
    got = sorted((tuple(r) for r in simhash_dedup.simhash_groups(docs).collect()), key=str)
    assert got == expect
    assert len({e[2] for e in expect}) < len({e[1] for e in expect})
    assert simhash_dedup.simhash_groups(empty).count() == 0


def test_fingerprints_agree_with_the_built_in_hash(spark):
    from pyspark.sql import functions as F

    text = "drei wörter hier"
    h = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (1 << 64) - 1
    assert simhash_dedup.fingerprint(text) == h == xxhash.xxh64_intdigest(text.encode(), 42)


def test_band_keys_and_pivots_lose_no_pair(spark):
    """All fingerprints within 3 bits of some meet under a key, and the distance table keeps them."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    pairs = []
    for base in rng.integers(-(2**63), 2**63 - 1, 30).tolist():
        for k in range(4):
            flips = sum(1 << int(b) for b in rng.choice(64, k, replace=False))
            other = ((base & (1 << 64) - 1) ^ flips)
            pairs.append((base, other - (1 << 64) if other >> 63 else other))
    table = spark.createDataFrame(pairs, "a long, b long")
    row = lambda c: F.struct(*[d.alias(f"d{k}") for k, d in enumerate(simhash_dedup.distance_table(F.col(c), simhash_dedup.pivots()))])
    seen = table.select(F.size(F.array_intersect(simhash_dedup.band_keys(F.col("a")), simhash_dedup.band_keys(F.col("b")))).alias("keys"), simhash_dedup.within(row("a"), row("b"), simhash_dedup.PIVOTS).alias("kept"))
    assert seen.where("keys = 0 or not kept").count() == 0
    far = spark.createDataFrame([(0, -1)], "a long, b long").select(simhash_dedup.within(row("a"), row("b"), simhash_dedup.PIVOTS).alias("kept")).first()[0]
    assert not far


def test_votes_against_a_plain_neighbour_loop(spark):
    """Scores of the quality classifier against one similarity at a time, on the same latent vectors."""
    from hubweave.llm import quality

    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    texts = [(i, " ".join(rng.choice(vocab[: 50 + 30 * (i % 2)]) for _ in range(rng.randint(1, 60)))) for i in range(90)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(70)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(frame, labels).collect()}
    import pyarrow as pa

    n1, n0 = sum(model["labels"] == 1), sum(model["labels"] == 0)
    assert n1 + n0 == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(70))
    for i, text in texts:
        counts = next(c for _, c in quality.term_counts(pa.array([text])))
        own = quality.latent(counts, model["idf"], model["axes"])[0]
        near = sorted(((float(own @ v), label) for v, label in zip(model["vectors"], model["labels"])), reverse=True)[: quality.NEIGHBOURS]
        weights = [(max(s, 0) ** 4 / (n1 if label else n0), label) for s, label in near]
        total = sum(w for w, _ in weights)
        assert got[i] == pytest.approx(sum(w * label for w, label in weights) / total if total else model["prior"], abs=1e-4)


def test_earlier_operators_on_null_ids_repeated_rows_long_texts_and_clashing_columns(spark):
    """Every row comes back once and equal rows alike; extra columns named like results or keys are ignored."""
    from hubweave.llm import exact_dedup, language_id, lm_scoring, quality, sentencepiece_codec

    rng = random.Random(1)
    long = " ".join(rng.choice(["wort", "noch", "ein", "langer", "Text"]) for _ in range(60000))
    texts = [(None, "kein Name hier"), (None, "kein Name hier"), (5, long), (5, long), (6, "x" * 200000), (7, ""), (8, None), (9, "ein Satz mit Worten"), (9, "anderer Satz"), (10, "deux mots"), (11, "zwei Worte")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, key long, load binary, n long, part int, target boolean, quality int, size long"
    rows = [(i, t, "de" if k % 2 else "fr", None, 0, 1.0, True, 1, None, 1, 1, False, 0, 1) for k, (i, t) in enumerate(texts)]
    frame = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(5, 1, 0), (9, 0, 0), (10, 1, 0), (11, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {
        "quality": quality.score_documents(frame, labels), "language": language_id.identify(frame), "lm": lm_scoring.score_documents(frame, labels),
        "pieces": sentencepiece_codec.encode(frame), "exact": exact_dedup.exact_dedup(frame),
    }
    for name, table in found.items():
        # products of blocks of rows differ in their last places with the block
        got = collections.Counter(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in table.collect())
        assert sum(got.values()) == len(rows), name
        assert sorted(n for n in got.values() if n > 1) == [2, 2], name
    assert {r["n_tokens"] for r in found["lm"].where("doc_id = 5").collect()} == {60000}
    assert {r["group_size"] for r in found["exact"].where("doc_id is null").collect()} == {2}


def test_chat_with_clashing_columns_and_a_long_text(spark):
    from hubweave.llm import chat_format

    rows = [(1, 0, "ann", "a" * 300000, 5, "p", 0), (1, 1, "bob", "b", 5, "p", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, page int, participant string, text_offset long")
    got = {r["participant"]: r for r in chat_format.rotate_perspectives(frame).collect()}
    assert set(got) == {"ann", "bob"} and got["ann"]["text"].count("a" * 300000) == 1 and got["bob"]["page"] == 1
