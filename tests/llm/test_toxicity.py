import random
import zlib

from tessera.llm import toxicity as X


def made(spark, n=400, seed=3):
    rnd = random.Random(seed)
    syll = ["an", "be", "co", "dé", "eau", "fi", "go", "hi", "ka", "lo", "mi", "no"]
    word = lambda: "".join(rnd.choices(syll, k=rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(20, 200))]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["scumbag", "idiotic", "wretch" + word()]))
        docs.append((i, " ".join(w).capitalize()))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = made(spark)
    rows = X.toxicity(docs, labels).collect()
    assert len(rows) == 400
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9
    toxic = [r["score"] for r in held if truth[r["doc_id"]]]
    clean = [r["score"] for r in held if not truth[r["doc_id"]]]
    assert sum(a > b for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = made(spark, 120)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert sorted(X.toxicity(docs, labels).collect()) == sorted(X.toxicity(docs, flipped).collect())


def test_messy_documents_and_labels(spark, messy, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    rows = X.toxicity(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in X.toxicity(messy, nothing).collect()} == {0.5}
    assert X.toxicity(empty, labels).count() == 0


def test_rare_in_both_says_little():
    counts = {}
    for w, c in {b"hello": (500, 500), b"scum": (0, 200), b"rarer": (1, 0)}.items():
        for g in X.windows(w):
            a = counts.setdefault(g, (0, 0))
            counts[g] = (a[0] + c[0], a[1] + c[1])
    model = X.train(counts)
    assert X.word_ratio(model, b"scum") > 3 > abs(X.word_ratio(model, b"hello"))
    assert abs(X.word_ratio(model, b"zzz")) < X.word_ratio(model, b"scum")


def plain_kneser_ney(counts, order):
    """log p(toxic) - log p(ordinary) of every counted n-gram, from the definitions: interpolated Kneser-Ney of each class over its own counts, backing off to continuation counts that both classes share."""
    import math

    # every n-gram that ends a counted one, and how many different bytes stand before it
    suffixes = {w[i:] for w in counts for i in range(len(w))}
    before = {s: len({t for t in suffixes if len(t) == len(s) + 1 and t[1:] == s}) for s in suffixes}
    before = {s: n for s, n in before.items() if n}

    def discount(values):
        ones, twos = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    drop = discount(list(before.values()))

    def shared(s):
        below = shared(s[1:]) if len(s) > 1 else 1 / 256
        same = [n for t, n in before.items() if t[:-1] == s[:-1]]
        if not same:
            return below
        return max(before.get(s, 0) - drop, 0) / sum(same) + drop * len(same) / sum(same) * below

    out = {}
    for w in counts:
        p = []
        for k in (0, 1):
            d = discount([c[k] for c in counts.values() if c[k]])
            same = [c[k] for v, c in counts.items() if v[:-1] == w[:-1] and c[k]]
            below = shared(w[1:]) if len(w) > 1 else 1 / 256
            own = max(counts[w][k] - d, 0) / sum(same) if counts[w][k] else 0.0
            p.append(own + (d * len(same) / sum(same) if same else 1.0) * below)
        out[w] = math.log(p[1] / p[0])
    return out


def test_model_matches_plain_kneser_ney():
    rnd = random.Random(11)
    for order in (2, 3, 4):
        counts: dict = {}
        for _ in range(60):
            w = bytes(rnd.choices(b"abc", k=rnd.randint(1, 5)))
            k, n = rnd.randint(0, 1), rnd.choice([1, 1, 1, 2, 2, 5])
            for g in X.windows(w, order):
                a = list(counts.get(g, (0, 0)))
                a[k] += n
                counts[g] = tuple(a)
        model, want = X.train(counts, order), plain_kneser_ney(counts, order)
        assert all(abs(model[w] - want[w]) < 1e-9 for w in want)
        word = b"abcab"
        assert abs(X.word_ratio(model, word, order) - sum(model.get(g, model.get(b"\xff" + g[:-1], 0.0)) for g in X.windows(word, order))) < 1e-9
