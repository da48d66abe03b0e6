"""Context mixing against a coder written down bit by bit, and what it is made of."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from arbora.llm import common, lmscore  # noqa: E402


def coded(before: bytes, word: bytes):
    """(byte, contexts by order, byte before, text it belongs to) of a word's bytes and the gap behind it."""
    tail = before[-2:] if len(before) > 1 else b" " + before
    word += b" "
    for j in range(len(word)):
        record = tail + b" " + word[:j] if j < 2 else b" " + word[:j]
        padded = bytes(reversed(record[-5:])).ljust(5, b"\0")
        yield word[j], [record[-1:], record[-2:], record[-3:], padded, word[:j]], record[-1], (tail, word[:2]) if j < 2 else word


def bits_of(tree, byte):
    for i in range(tree.depth[byte]):
        yield int(tree.places[byte, i]), int(tree.bits[byte, i])


def brute(model, texts, flags):
    """Scores by plain loops: counts in dictionaries of true contexts, one bit after the other."""
    split = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    tree, mixer = model.mixer.tree, model.mixer
    words, pairs, segs, coding, table = Counter(), Counter(), Counter(), Counter(), Counter()
    cuts = []
    for ws, train in zip(split, flags):
        h = np.concatenate([lmscore.spelled(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in ws])
        cut, _ = lmscore.segments(h, np.array([len(ws) - 1]))
        cuts.append([tuple(ws[a:b]) for a, b in zip([0, *cut[:-1]], cut)])
        if train:
            segs.update(cuts[-1])
            for before, w in zip([b"\n", *ws], ws):
                words[w] += 1
                pairs[before, w] += 1
                coding[(before[-2:] if len(before) > 1 else b" " + before), (w + b" ")[:2]] += 1
    done = set()
    for before, w in pairs:
        for byte, contexts, _, own in coded(before, w):
            if (own, len(contexts[4])) not in done:
                done.add((own, len(contexts[4])))
                n = words[own[:-1]] if isinstance(own, bytes) else coding[own]
                for place, bit in bits_of(tree, byte):
                    for k, c in enumerate(contexts):
                        table[k, c, place, bit] += math.sqrt(n)
    count = lambda n: float(lmscore.COUNT[lmscore.rounded(np.array([n]))[0]])

    def log10(before, w):
        total = 0.0
        for byte, contexts, last, own in coded(before, w):
            without = (words[own[:-1]] if isinstance(own, bytes) else coding[own]) == 1
            for place, bit in bits_of(tree, byte):
                x, gate = [], 0
                for k, c in enumerate(contexts):
                    n = [count(table[k, c, place, b]) for b in (0, 1)]
                    if without:
                        n[bit] = max(0.0, n[bit] - 1)
                    x.append(math.log((n[1] + 0.1) / (n[0] + 0.1)))
                    if k >= 2:
                        gate = gate * lmscore.SEEN + sum(n[0] + n[1] >= y for y in (1, 4, 32))
                z = min(15.0, max(-15.0, sum(a * b for a, b in zip([*x, 1.0], mixer.weights[gate]))))
                p = (1 / (1 + math.exp(-z)) + mixer.refined[last, int(np.rint(min(8.0, max(-8.0, z)) * 2 + 16))]) / 2
                p = min(1 - 1e-6, max(1e-6, p))
                total += math.log10(p if bit else 1 - p)
        return total

    out = []
    for ws, train, own in zip(split, flags, cuts):
        score, at = 0.0, 0
        for seg in own:
            inside = 1.0
            for w in seg:
                before = ws[at - 1] if at else b"\n"
                p = (1 - model.spell) * (words[w] - train) / max(1, model.total - train) + model.spell * 10 ** log10(before, w)
                inside *= (pairs[before, w] - train + model.weight * p) / (words[before] - train + model.weight)
                at += 1
            score += math.log10(model.anew * inside + (1 - model.anew) * (segs[seg] - train) / max(1, model.segs - train))
        out.append(score)
    return out


def corpus(seed: int, n: int, words: int = 60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(words)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 30))) for _ in range(n)]
    return [*texts, *texts[:5], None, "", "  \n", "zzz Unseen-Wörd " * 2, "a" * 300], [i % 5 != 1 for i in range(n + 10)]


def test_scores_are_those_of_a_plain_coder(spark, monkeypatch):
    texts, flags = corpus(3, 30, 15)
    monkeypatch.setattr(lmscore, "SLOT_BITS", (22, 22))  # so many slots that hardly two contexts share one
    monkeypatch.setattr(lmscore, "SHORT_BITS", (16, 22, 22))
    made, real = [], lmscore.Model.__init__
    monkeypatch.setattr(lmscore.Model, "__init__", lambda self, *a: made.append(self) or real(self, *a))
    common.ship(spark)
    df = spark.createDataFrame([(i, t, f, "clash") for i, (t, f) in enumerate(zip(texts, flags))], "doc_id long, text string, train boolean, score string")
    got = {x["doc_id"]: x for x in lmscore.score(df, F.col("train")).collect()}
    want = brute(made[0], texts, flags)
    for i, x in enumerate(want):
        assert abs(got[i]["score"] - x) < 1e-3 * (1 + abs(x) / 100), (i, got[i]["score"], x)
        assert abs(got[i]["bits_per_byte"] * sum(len(w) + 1 for w in [*(texts[i] or "").encode().split(), b"\n"]) + x * math.log2(10)) < 0.01 * (1 + abs(x))


def test_coded_words_are_a_probability():
    """Behind any two bytes, all words of one and two letters and a sample of others add up to at most 1."""
    r = random.Random(2)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 4))).encode() for _ in range(50)]
    tree = lmscore.Tree(np.bincount(np.frombuffer(b" ".join(words), np.uint8), minlength=256))
    widths = (16, 18, 20, 18, 18)
    tables = [np.zeros(2 << w, np.float32) for w in widths]
    rests, heads = lmscore.rest_texts(words), lmscore.head_texts(np.array([0x6162 << 16 | (w + b" ")[0] << 8 | (w + b" ")[1] for w in words], np.uint32))
    for texts, origin in ((rests, 1), (heads, 3)):
        lmscore.add_counts(tables, texts, origin, np.ones(len(texts)), tree, widths)
    states = [lmscore.rounded(t).reshape(-1, 2) for t in tables]
    m = lmscore.Mixer(tree, [s[:, 0].astype(np.int16) | s[:, 1].astype(np.int16) << 6 for s in states], widths)
    assert m.learn(rests, 1) > 0 and m.learn(heads, 3) > 0
    m.refine()
    every = [bytes([x]) for x in range(256) if x != 32] + [bytes([a, b]) for a in range(256) for b in range(256) if 32 not in (a, b)]
    every += [w for w in set(words) if len(w) > 2]
    plain = np.zeros(len(every), bool)
    head = m.log10(lmscore.head_texts(np.array([0x6162 << 16 | (w + b" ")[0] << 8 | (w + b" ")[1] for w in every], np.uint32)), 3, plain)
    total = (10 ** (head + m.log10(lmscore.rest_texts(every), 1, plain))).sum()
    assert 0.5 < total <= 1 + 1e-6


def test_ids_of_any_type_null_and_repeated(spark):
    texts, flags = corpus(5, 20)
    df = spark.createDataFrame([(None if i == 3 else i % 12, t, f) for i, (t, f) in enumerate(zip(texts, flags))], "doc_id int, text string, train boolean")
    got = lmscore.score(df, F.col("train"))
    assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert Counter(x["doc_id"] for x in got.collect()) == Counter(x["doc_id"] for x in df.collect())
    named = lmscore.score(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), F.col("train")).collect()
    assert sorted(round(x["score"], 2) for x in named) == sorted(round(x["score"], 2) for x in got.collect())
    assert lmscore.score(df.where("false"), F.lit(True)).count() == 0
    alone = lmscore.score(df, F.lit(None).cast("boolean")).collect()
    assert len(alone) == len(texts) and all(x["held_out"] and x["score"] <= 0 and x["base_score"] == 0 for x in alone)


def test_blocks_and_owners_change_nothing(spark, monkeypatch):
    """Many small blocks, owners and partial tables, added up in several rounds, give the same as one."""
    texts, flags = corpus(7, 60)
    df = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(zip(texts, flags))], "doc_id long, text string, train boolean")
    one = {x["doc_id"]: x["score"] for x in lmscore.score(df.coalesce(1), F.col("train")).collect()}
    for name, value in (("BLOCK", 400), ("OWNED", 200), ("FAN", 2), ("PIECE", 50)):
        monkeypatch.setattr(lmscore, name, value)
    many = {x["doc_id"]: x["score"] for x in lmscore.score(df.repartition(3), F.col("train")).collect()}
    for i, x in one.items():
        assert abs(many[i] - x) < 0.05 * (1 + abs(x))  # the mixer's weights depend a little on the order of learning
    assert abs(sum(many.values()) / sum(one.values()) - 1) < 0.02


def test_what_stands_twice_is_told_from_what_stands_once(spark):
    r = random.Random(4)
    letters = "abcdefgh"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:10]])]
    got = {x["doc_id"]: x["bits_per_byte"] for x in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()}
    twice = [got[i] for i in [*range(10), *range(60, 70)]]
    once = [got[i] for i in range(10, 60)]
    assert max(twice) < 0.6 * min(once)


def test_distinct_and_squeezed():
    r = np.random.default_rng(6)
    for keys in (r.integers(0, 50, 500).astype(np.uint64), r.integers(0, 1 << 63, 3000).astype(np.uint64) | np.uint64(1 << 63), np.repeat(r.integers(0, 1 << 40, 900).astype(np.uint64), 3), np.zeros(0, np.uint64), np.array([7], np.uint32), (r.integers(0, 8, 4000).astype(np.uint64) << np.uint64(60)) | r.integers(0, 9, 4000).astype(np.uint64)):
        every, first, place = np.unique(keys, return_index=True, return_inverse=True)
        a, b, c = lmscore.distinct(keys)
        assert (a == every).all() and (b == place).all() and (c == first).all()
        assert (lmscore.expanded(lmscore.squeezed(keys), keys.dtype) == keys).all()
    assert (np.cumsum(lmscore.steps(every)) == every).all()


def test_pairs_and_segments():
    """A pair's hash depends on both words, the first word's on a text's end; weights fit the pairs seen once."""
    end = lmscore.spelled(np.frombuffer(lmscore.END, np.uint8), np.array([0]), np.array([1]))[0]
    h = np.array([11, 12, 11, 12, end, 11, 12, end], np.uint64)
    two = lmscore.pairs(h)
    assert two[0] == two[5] and two[1] == two[3] == two[6] and two[2] not in two[3:] and (two & np.uint64(1)).all()
    cut, seg = lmscore.segments(h, np.array([4, 7]))
    assert {5, 8} <= set(cut.tolist()) and not (seg & np.uint64(1)).any()
    alone, own = lmscore.segments(h[5:], np.array([2]))
    assert own.tolist() == seg[-len(own) :].tolist()
    left = np.array([1000 * x / (1000 + x) for x in lmscore.WEIGHTS])
    w = lmscore.Model({"n": 10, "v": 3, "once": 1, "segs": 5, "segs_once": 2, "pairs_once": 200}, left, None).weight
    assert abs(1000 * w / (1000 + w) - 200) < 10


def test_texts_are_coded_online():
    """Weights and table learn inside each text, STEP tokens behind what is coded, as plain loops over its bits do."""
    r = random.Random(11)
    words = sorted({"".join(r.choice("abcdexyz") for _ in range(r.randint(1, 6))).encode() for _ in range(60)})
    tree = lmscore.Tree(np.bincount(np.frombuffer(b" ".join(words), np.uint8), minlength=256))
    heads = np.array([0x6162 << 16 | (w + b" ")[0] << 8 | (w + b" ")[1] for w in words], np.uint32)
    kinds = [(lmscore.head_texts(heads), 3, np.arange(len(words)) % 3 == 0), (lmscore.rest_texts(words), 1, np.arange(len(words)) % 4 == 0)]
    widths = (16, 18, 20, 18, 18)
    tables = [np.zeros(2 << w, np.float32) for w in widths]
    for texts, origin, _ in kinds:
        lmscore.add_counts(tables, texts[:30], origin, np.arange(1, 31), tree, widths)
    states = [lmscore.rounded(t).reshape(-1, 2) for t in tables]
    m = lmscore.Mixer(tree, [s[:, 0].astype(np.int16) | s[:, 1].astype(np.int16) << 6 for s in states], widths)
    for texts, origin, _ in kinds:
        m.learn(texts[:30], origin)
    m.refine()
    size = np.array([1, 150, 32, 33, 64, 65, 3, 200] + [40] * 70)
    token = np.array([r.randrange(len(words)) for _ in range(size.sum())])
    before = m.weights.copy(), m.refined.copy()
    got = m.online(kinds, [token, token], size)
    known = [[m.inputs([texts[i]], origin, without[i : i + 1]) for i in range(len(words))] for texts, origin, without in kinds]
    at = 0
    for n in size.tolist():
        weights, seen, held = m.weights.copy(), np.zeros((256, 33, 2)), []
        for j in range(n):
            if j % lmscore.STEP == 0:  # what was coded since is learned
                count = Counter(gate for _, gate, *_ in held)
                step = np.zeros_like(weights)
                for x, gate, off, last, cell, bit in held:
                    step[gate] += lmscore.RATE * off * x / max(50, count[gate])
                    seen[last, cell, bit] += 1
                weights, held = weights + step, []
            total = 0.0
            for k in range(2):
                x, gates, bits, lasts, _ = known[k][token[at]]
                for b in range(len(bits)):
                    z = min(15.0, max(-15.0, float(x[:, b] @ weights[gates[b]])))
                    plain, cell = 1 / (1 + math.exp(-z)), int(np.rint(min(8.0, max(-8.0, z)) * 2 + 16))
                    zeros, ones = seen[lasts[b], cell]
                    p = (m.refined[lasts[b], cell] * lmscore.OWN + ones) / (zeros + ones + lmscore.OWN)
                    p = min(1 - 1e-6, max(1e-6, (plain + p) / 2))
                    total += math.log10(p if bits[b] else 1 - p)
                    held.append((x[:, b], int(gates[b]), bits[b] - plain, lasts[b], cell, int(bits[b])))
            assert abs(got[at] - total) < 1e-3 * (1 + abs(total)), (n, j, got[at], total)
            at += 1
    assert (before[0] == m.weights).all() and (before[1] == m.refined).all()
    assert np.allclose(m.online(kinds, [token[1:151], token[1:151]], np.array([150])), got[1:151], atol=1e-4)  # up to the text alone


def test_a_text_of_its_own_kind_is_learned_as_it_goes(spark):
    """A long text of rare letters costs clearly less than the same words in texts of their own."""
    r = random.Random(13)
    plain = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(60)) for _ in range(40)]
    own = ["".join(r.choice("xyz") for _ in range(r.randint(9, 14))) for _ in range(400)]
    rows = [(i, t, True) for i, t in enumerate(plain)] + [(1000, " ".join(own), False)]
    rows += [(2000 + i, " ".join(own[i : i + 20]), False) for i in range(0, len(own), 20)]
    got = {x["doc_id"]: x["score"] for x in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), F.col("train")).collect()}
    pieces = sum(got[2000 + i] for i in range(0, len(own), 20))
    print("whole, in pieces:", got[1000], pieces)
    assert got[1000] > 0.95 * pieces


def test_no_context_ends_at_a_gap():
    """With heads of eight bytes every byte of a text is coded once, behind the last five bytes of the running text."""
    r = random.Random(17)
    texts = [[*("".join(r.choice("abcé\0") for _ in range(r.randint(1, 9))).encode() for _ in range(n)), b"\n"] for n in (0, 1, 2, 30, 60)]
    block = lmscore.Block(lmscore.zstandard.compress(b" ".join(b" ".join(t) for t in texts)), bytes([1] * len(texts)), 3, 48, np.uint64)
    heads, rests, at = lmscore.head_texts(block.heads), lmscore.rest_texts(block.words), 0
    (head, rest) = lmscore.ORIGINS[block.heads.dtype]
    for words in texts:
        running = b"\0\0 \n " + b"".join(w + b" " for w in words)
        where = 5
        for w in words:
            whole = b""
            for text, origin in ((heads[block.head[at]], head), (rests[block.at[at]], rest)):
                symbol, _, context, last = lmscore.contexts([text], origin)
                for k in range(len(symbol)):
                    i = where + len(whole)
                    five = np.frombuffer(running[i - 5 : i], np.uint8)
                    other = lmscore.contexts([bytes(five) + b"x"], (0, 5))[2]
                    assert symbol[k] == running[i] and last[k] == five[-1]
                    assert [c[k] for c in context[:4]] == [c[0] for c in other[:4]], (w, k)
                    whole += bytes([symbol[k]])
            assert whole == w + b" "
            where, at = where + len(whole), at + 1


def test_what_stands_before_a_gap_tells_what_comes(spark, monkeypatch):
    """The last five bytes count at a word's start: new words by the third and fourth byte before the gap."""
    r = random.Random(19)
    ends = {"".join(x): y for x, y in zip([(a, b) for a in "abcdef" for b in "abcdef"], r.sample([a + b + c for a in "klmnop" for b in "klmnop" for c in "qr"], 36))}
    fresh = lambda: "".join(r.choice("stuvwxyz") for _ in range(6))
    texts = []
    for _ in range(80):
        own = [r.choice(list(ends)) for _ in range(40)]
        texts.append(" ".join(x for a in own for x in (fresh() + a + "gh", ends[a] + fresh())))
    df = spark.createDataFrame([(i, t, i % 5 != 1) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    total = lambda **k: {x["doc_id"]: x["score"] for x in lmscore.score(df, F.col("train"), **k).collect()}
    short, whole = total(), total(reach=4)
    assert sum(whole[i] for i in whole if i % 5 == 1) > 0.97 * sum(short[i] for i in short if i % 5 == 1)
    for name, value in (("BLOCK", 3000), ("OWNED", 2000)):
        monkeypatch.setattr(lmscore, name, value)
    many = total(reach=4)
    assert abs(sum(many.values()) / sum(whole.values()) - 1) < 0.02


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_the_jvm_codes_as_the_columns_do(spark, kind):
    """Texts of any length, seen once or more, get from Coder.java what Mixer.online and the mixing of words, pairs and segments give."""
    r = random.Random(23)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(150)]
    texts = [" ".join(r.choices(vocabulary, k=n)) for n in (0, 1, 31, 32, 33, 63, 64, 65, 300, 5, 5)] + ["é" * 700]
    flags = [i % 3 != 1 for i in range(len(texts))]
    block = lmscore.Block(lmscore.zstandard.compress(b" ".join(b" ".join([*t.encode().split(), b"\n"]) for t in texts)), bytes(flags), 3, 64, kind)
    head, rest = lmscore.ORIGINS[np.dtype(kind)]
    heads, rests = lmscore.head_texts(block.heads), lmscore.rest_texts(block.words)
    tree = lmscore.Tree(np.bincount(np.frombuffer(b" ".join(block.words), np.uint8), minlength=256))
    widths = (16, 18, 20, 18, 18)
    tables = [np.zeros(2 << w, np.float32) for w in widths]
    lmscore.add_counts(tables, heads, head, block.head_times, tree, widths)
    lmscore.add_counts(tables, rests, rest, block.word_times, tree, widths)
    states = [lmscore.rounded(t).reshape(-1, 2) for t in tables]
    m = lmscore.Mixer(tree, [s[:, 0].astype(np.int16) | s[:, 1].astype(np.int16) << 6 for s in states], widths)
    m.learn(rests, rest)
    m.refine()
    sums = {"n": int(block.word_times.sum()), "v": len(vocabulary), "once": 9, "segs": 40, "segs_once": 20, "pairs_once": 200}
    model = lmscore.Model(sums, np.array([1000 * x / (1000 + x) for x in lmscore.WEIGHTS]), m)
    bits = m.online([(heads, head, block.head_times == 1), (rests, rest, block.word_times == 1)], [block.head, block.at], np.diff(block.last, prepend=-1))
    want, inside, segment = np.zeros(len(texts)), 1.0, 0
    for i, x in enumerate(bits):
        own, before = int(block.learned[i]), block.word_times[block.at[i - 1] if i and block.text[i - 1] == block.text[i] else block.at[block.last[0]]]
        p = (1 - model.spell) * (block.word_times[block.at[i]] - own) / (sums["n"] - own) + model.spell * 10**x
        inside *= (block.key_times[block.pair[i]] - own + model.weight * p) / (before - own + model.weight)
        if i + 1 == block.cut[segment]:
            want[block.text[i]] += math.log10(model.anew * inside + (1 - model.anew) * (block.key_times[block.seg[segment]] - own) / (sums["segs"] - own))
            inside, segment = 1.0, segment + 1
    parts = model.parts(block, *(x.astype(np.int64) for x in (block.word_times, block.head_times, block.key_times)))
    data = b" " + b" ".join(b" ".join([*t.encode().split(), b"\n"]) for t in texts) + b" "
    df = spark.createDataFrame([tuple(map(bytearray, (data, *parts)))] * 2, "text binary, marks binary, numbers binary, whole binary")
    coder = common.java_function(spark, "Coder.java", model.packed(np.dtype(kind).itemsize // 2), "array<double>")
    for row in df.select(coder(*df.columns).alias("score")).collect():
        assert np.allclose(row["score"], want, rtol=1e-3, atol=1e-3)


def test_keys_that_differ_in_low_bits_are_not_mended_one_by_one(monkeypatch):
    """Heads of eight bytes share their high bits: one more sort, not one for each of them."""
    r = np.random.default_rng(29)
    keys = (r.integers(0, 20000, 60000).astype(np.uint64) << np.uint64(49)) | r.integers(0, 3000, 60000).astype(np.uint64)
    calls, real = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(1) or real(*a, **k))
    a, b, c = lmscore.distinct(keys)
    monkeypatch.undo()
    every, first, place = np.unique(keys, return_index=True, return_inverse=True)
    assert (a == every).all() and (b == place).all() and (c == first).all() and len(calls) < 100
