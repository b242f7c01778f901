import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import decontamination, entry, language_id, near_dedup, quality_classifier, quality_rules
from faultline.llm.common import mix, span_hashes, word_spans
from tests.oracle import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = "/root/testdata/sf0.001"
ODD = [None, "", " \n", "a", "a b", "a b c a b c", "\x0b a\x0cb \x1c\x85 x", "a b c d a b c e\n\n a\n a\n a", "x y z " * 40, "1234 !!"]


def frame(spark, values, extra="score double, s string"):
    return spark.createDataFrame([(k, x, None, "e") for k, x in enumerate(values)], f"doc_id long, text string, {extra}")


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_sql(spark, name):
    assert same(spark, connect(DATA), entry.QUERIES[name], entry.ORACLES[name], DATA) is None


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, places, seen, dup = Counter(g), set(), set(), 0
    for k, x in enumerate(g):
        places |= {k, k + 1, k + 2} if count[x] > 1 else set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(places)


def test_quality_statistics(spark):
    for r in quality_rules.score(frame(spark, ODD), []).collect():
        want = brute_statistics(ODD[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) == (not r.kept)


def test_statistics_stay_exact_when_hashes_collide(spark, monkeypatch):
    """With a hash of a few values nearly all windows collide; long texts and random ones must give the same counts."""
    rnd = random.Random(8)
    values = [*ODD, "a b c " * 30_000, *(" ".join(rnd.choice("abcd") for _ in range(n)) for n in (3, 4, 7, 40, 300) for _ in range(6))]
    weak = quality_rules._STATISTICS.replace("xxhash64(w[i], w[i + 1], w[i + 2])", "shiftleft(pmod(xxhash64(w[i], w[i + 1], w[i + 2]), 5L), 40)")
    assert weak != quality_rules._STATISTICS
    for sql in (quality_rules._STATISTICS, weak):
        monkeypatch.setattr(quality_rules, "_STATISTICS", sql)
        for r in quality_rules.score(frame(spark, values), []).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(values[r.doc_id])


def test_the_quality_query(spark):
    """Base columns of every whole text by brute force, and the learned verdicts by the rules' own conditions in Python."""
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rules, held = quality_rules.learn(docs, labels), {r.doc_id: r.text for r in docs.collect()}
    rows = entry.QUERIES["op6_quality_rules"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(held)
    x = {r.doc_id: r for r in docs.select("doc_id", quality_rules.statistics("text").alias("s")).select("doc_id", *(F.expr(q).alias(n) for n, q in quality_rules.FEATURES.items())).collect()}
    for r in rows:
        want = brute_statistics(held[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        one = np.array([[x[r.doc_id][n] for n in quality_rules.FEATURES]])
        assert r.kept == (not r.base_failed and not any(quality_rules._covered(rule, one)[0] for rule in rules))


def test_quality_rules_learn(spark):
    good = [" ".join(f"w{(k * 7 + j * 13) % 997}x{j}." for j in range(80)) for k in range(60)]
    bad = [x.replace(".", "#$%!!") for x in good]
    docs = frame(spark, good + bad + [None])
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)] + [(0, None), (999, 0)], "doc_id long, quality int")
    rules = quality_rules.learn(docs, labels)
    assert rules and {r.doc_id for r in quality_rules.keep(docs, rules).collect()} == set(range(60))
    assert quality_rules.keep(docs, rules).columns == docs.columns and quality_rules.learn(docs, labels.limit(0)) == []
    twice = docs.unionAll(docs.where("doc_id % 3 = 0")).unionAll(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))).repartition(5)
    assert quality_rules.learn(twice, labels) == rules


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(values, width, percent):
    sets, root, at = [shingles(x, width) for x in values], list(range(len(values))), defaultdict(list)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        common = Counter(o for g in s for o in at[g])
        for g in s:
            at[g].append(k)
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((top(k), top(o)))
                root[b] = a
    return {k: (len(sets[k]), top(k)) for k in range(len(values))}


def test_near_duplicates(spark):
    rnd = random.Random(5)
    values = list(ODD)
    for _ in range(6):
        base = [f"w{rnd.randrange(400)}" for _ in range(120)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randrange(10)):
                copy[rnd.randrange(120)] = f"n{rnd.randrange(9999)}"
            values.append(" ".join(copy))
        values += [" ".join(base).upper(), " ".join(base)]
    for width, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, values), width=width, percent=percent).collect()}
        assert got == brute_components(values, width, percent)
    kept = near_dedup.deduplicate(frame(spark, values), width=5, percent=80)
    assert {r.doc_id for r in kept.collect()} == {k for k, (_, c) in brute_components(values, 5, 80).items() if k == c}
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def matrix_components(values, width, percent):
    """``brute_components`` by one product of the incidence matrix with itself."""
    sets, place = [shingles(x, width) for x in values], {}
    grid = np.zeros((len(values), len({g for s in sets for g in s})), np.float32)
    for k, s in enumerate(sets):
        grid[k, [place.setdefault(g, len(place)) for g in s]] = 1
    common, size = (grid @ grid.T).astype(np.int64), np.array([len(s) for s in sets])
    linked = (100 * common >= percent * (size[:, None] + size - common)) & (size > 0)
    label = np.arange(len(values))
    while True:
        now = np.where(linked, label, len(label)).min(axis=1, initial=len(label))
        now = np.minimum(now, label)
        if (now == label).all():
            return {k: (int(size[k]), int(label[k])) for k in range(len(values))}, linked
        label = now


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(90)]
    values = []
    for k in range(2000):  # some near the source, some near another copy only, some linked with none
        copy = list(base) if k < 1500 else values[rnd.randrange(1500)].split()
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 6, 9])):
            at, how = rnd.randrange(len(copy)), rnd.random()
            copy[at : at + 1] = [f"n{rnd.randrange(40)}"] if how < 0.6 else [] if how < 0.8 else [copy[at], "and"]
        values.append(" ".join(copy))
    for width, percent in ((3, 85), (5, 80)):
        want, linked = matrix_components(values, width, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, values), width=width, percent=percent).collect()}
        assert got == want and 100 < sum(k == c for k, (_, c) in want.items()) < 1900 and linked.sum() > 100_000


def test_rows_of_one_id_are_one_document(spark):
    say = lambda seed: " ".join(f"s{seed}w{k}" for k in range(60))
    x, y, z = say(1), say(2), say(3)
    rows = [(1, x), (1, y), (3, x + " more"), (4, y + " more"), (5, z), (6, z + " more"), (7, z), (7, "else " + say(4)), (8, say(4)), (None, x), (None, None), (9, None), (9, say(5)), (9, say(5)), (10, "")]
    want = {(1, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 5), (8, 5), (None, None), (9, 9), (10, 10)}
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect()} == want
        assert sorted((r.doc_id or 0) for r in near_dedup.deduplicate(df).collect()) == [0, 0, 1, 1, 5, 9, 9, 9, 10]
    named = spark.createDataFrame([("b", x), ("a", x), ("c", y)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(named).collect()} == {("a", "a", True), ("b", "a", False), ("c", "c", True)}


def test_recall_of_the_query(spark):
    """All links of the table, by all pairs that share a shingle."""
    values = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    order = sorted(values)
    want = {order[k]: (n, order[c]) for k, (n, c) in brute_components([values[k] for k in order], 3, 85).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in entry.QUERIES["op5_near_dedup"](spark, DATA).collect()} == want


def test_leaks(spark):
    rnd = random.Random(3)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    items = [say(30) for _ in range(8)] + ["tiny", None, " "]
    values = [None, "", say(200), say(100) + " " + items[0].upper() + "\n" + say(50), say(9) + items[1][:60] + "zz" + items[1][62:] + say(9), items[2][: len(items[2]) // 2], "a tiny one"]
    benchmark = spark.createDataFrame([(k, x, 1) for k, x in enumerate(items)], "item_id long, text string, doc_id int")
    for block in (50, 10**6):
        got = {(r.doc_id, r.item_id): r.edits for r in decontamination.leaks(frame(spark, values), benchmark, block_chars=block).collect()}
        assert got == {(3, 0): 0, (4, 1): 2, (6, 8): 0}
    assert {r.doc_id for r in decontamination.clean(frame(spark, values), benchmark).collect()} == {0, 1, 2, 5}
    assert decontamination.leaks(frame(spark, values), benchmark.limit(0)).count() == 0 == decontamination.leaks(frame(spark, []), benchmark).count()


def plain_edits(item, text):
    """Least edits between the item and a part of the text, by the full table, row by row."""
    chars, columns = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, c in enumerate(item, 1):
        now = np.append(k, np.minimum(row[:-1] + (chars != ord(c)), row[1:] + 1))
        row = np.minimum.accumulate(now - columns) + columns
    return int(row.min())


def altered(rnd, item, edits):
    s = list(item)
    for _ in range(edits):
        k, how = rnd.randrange(len(s)), rnd.random()
        s[k : k + 1] = ["z"] if how < 0.4 else [] if how < 0.7 else [s[k], "y"]
    return "".join(s)


def test_leaks_within_the_budget_are_all_found():
    rnd = random.Random(4)
    say = lambda n: " ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(n))
    for size in (5, 12, 22, 31, 60, 179):  # the first four are too short for grams of 8
        item = say(30)[:size].strip()
        (index,) = decontamination.indexes([(0, item)], decontamination.Q, decontamination.RATE)
        k = int(0.1 * len(item))
        assert int(index.budgets[0]) == k and index.q == (8 if size > 31 else 4)
        for edits in [0, 1, k, k, k, k + 1, k + 2] * 3:
            text = decontamination.normal("q r s " * 20 + altered(rnd, item, edits) + " t u v" * 20)
            want = plain_edits(item, text)
            assert [e for _, _, e, _ in decontamination.find(index, [text])] == ([want] if want <= k else [])


def test_the_decontamination_query(spark):
    """Every document against every item, by the full table, where a quarter of the item occurs as it is; the budget of a tenth leaves such a quarter or a lone half."""
    want = set()
    items = [(r.item_id, decontamination.normal(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        text = decontamination.normal(r.text)
        for name, item in items:
            k, n = int(0.1 * len(item)), len(item)
            size = n // (k + 1)  # of k + 1 equal parts one at least has no edit
            if any(item[a : a + size] in text for a in range(0, n - size + 1, size)) and plain_edits(item, text) <= k:
                want.add((r.doc_id, name))
    found = entry.QUERIES["op7_decontamination"](spark, DATA)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want and found.columns == ["doc_id", "item_id", "edits", "budget", "end_at"]


def test_leaks_of_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from it"
    benchmark = spark.createDataFrame([(1, item), (2, item), (None, item.upper()), (3, " ")], "item_id long, text string")
    long = "word " * 300_000 + item
    rows = [(None, item), (None, item), (5, "clean"), (5, item), (6, long), (7, None)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, item_id string, edits int")
    for block in (30, 10**6):
        assert decontamination.leaks(docs, benchmark, block_chars=block).count() == 4 * 3
        kept = decontamination.clean(docs, benchmark, block_chars=block)
        assert kept.columns == docs.columns and [(r.doc_id, r.text) for r in kept.orderBy("doc_id").collect()] == [(5, "clean"), (7, None)]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, ~language_id.held_out("doc_id"), per_language=60)
    held = docs.where(language_id.held_out("doc_id"))
    said = language_id.identify(held, model, keep=("lang",)).collect()
    assert np.mean([r.lang == r.lang_pred for r in said]) > 0.97 and all(0 <= r.score <= 1 for r in said)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(frame(spark, ODD), model).collect()}
    assert all(odd[k] == ("und", 0.0) for k in (0, 1, 2, 9)) and odd[8][0] != "und"
    assert {r.doc_id for r in language_id.certain(frame(spark, ODD), model, least=0.0).collect()} == {3, 4, 5, 6, 7, 8}
    none = language_id.train(docs.limit(0), F.lit(True))
    assert language_id.identify(frame(spark, ODD), none).where("lang_pred <> 'und'").count() == 0


def test_the_language_query(spark):
    """Every row's label and score, against the model's own machines one text at a time, and its accuracy on held-out rows."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = entry.QUERIES["op8_language_id"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang]) > 0.95


def test_all_languages_are_learned(spark):
    """More languages than families list, ids that repeat, null ids, and a language that has most rows."""
    rnd = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    say = lambda k: " ".join("".join(rnd.choice(letters[k % 20 : k % 20 + 6]) for _ in range(5)) + letters[k % 26] * 3 for _ in range(40))
    rows = [(k * 100 + j, say(k), f"q{k}") for k in range(12) for j in range(30)] + [(10_000 + j, say(0), "q0") for j in range(400)]
    rows += [(7, rows[7][1], "q0")] * 500 + [(None, say(3), "q4")] * 5 + [(20_000, "long " * 200_000, "en"), (20_001, None, "en")]
    docs = spark.createDataFrame([(i, t, x, 1.0) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    model = language_id.train(docs, F.lit(True), per_language=40, most_texts=100)
    assert {n for d in model.within.values() for n in d.names} == {f"q{k}" for k in range(12)} | {"en"}
    said = language_id.identify(docs, model, keep=("lang",)).collect()
    assert len(said) == len(rows) and np.mean([r.lang == r.lang_pred for r in said if r.doc_id is not None]) > 0.95
    again = language_id.train(docs.repartition(7), F.lit(True), per_language=40, most_texts=100)
    assert all(np.array_equal(model.within[f].weights, again.within[f].weights) for f in model.within)


def test_machines_vote_as_written():
    """``decide`` against a plain count of every duel."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, (30, 12)) + np.eye(12)[k] for k in range(4)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    duels = language_id.Duels.fit(x, np.repeat(np.array(list("abcd"), object), 30))
    for row in x:
        votes, sums = Counter(), Counter()
        for (a, b), w, bias in zip(duels.pairs, duels.weights, duels.biases):
            m = float(w @ row + bias)
            votes["abcd"[a] if m >= 0 else "abcd"[b]] += 1
            sums["abcd"[a]] += m
            sums["abcd"[b]] -= m
        best = max("abcd", key=lambda n: (votes[n], sums[n], -ord(n)))
        name, p = duels.decide(row)
        assert name == best and abs(p - 1 / (1 + np.exp(-4 * sums[best] / 3))) < 1e-5


def test_training_holds_its_sample_once():
    """Machines on inner products equal those on whole rows, and no single-precision copy of the sample is made."""
    import tracemalloc

    rng = np.random.default_rng(8)
    languages = np.repeat(np.array(["de", "en", "es", "fr"], object), 400)
    x = rng.random((1600, language_id.DIMENSIONS), np.float32) + np.repeat(np.eye(4, language_id.DIMENSIONS, dtype=np.float32) * 20, 400, axis=0)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)
    y = np.where(np.arange(600) < 300, 1, -1).astype(np.float32)
    (w, b), (w2, b2) = (language_id.hinge_machine(x, y, np.arange(600), *more) for more in ((), (language_id.products(x),)))
    assert np.allclose(w, w2, atol=1e-3) and abs(b - b2) < 1e-3
    tracemalloc.start()
    inner = language_id._inner(x)
    model = language_id.Model.fit(x, languages, inner=inner)
    model.floor = language_id.calibrate(x, languages, inner)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.25 * x.nbytes and 0 < model.floor < 1
    assert all(model.parts(x[k].astype(np.float32))[0] == languages[k] for k in range(0, 1600, 97))
    plain = language_id.Model.fit(x, languages)
    assert np.allclose(plain.family.weights, model.family.weights, atol=1e-3) and language_id._inner(np.zeros((7, 12))) is None


def test_language_floor(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, ~language_id.held_out("doc_id"), calibrated=True)
    held = [r.text for r in docs.where(language_id.held_out("doc_id")).collect() if len((r.text or "").split()) >= 50]
    rnd = random.Random(7)
    say = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9))) for _ in range(120))
    strange = [say(a) for a in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "0123456789abcdef", "0123456789x", "абвгдежзийклмнопрсту") for _ in range(4)]
    strange += [
        "Вчера вечером мы пошли к реке, где было очень тихо и спокойно. Старый рыбак рассказывал нам о своих путешествиях. " * 3,
        "Wczoraj wieczorem poszliśmy nad rzekę, gdzie było bardzo cicho. Stary rybak opowiadał nam o swoich podróżach. " * 3,
        "Eilen illalla menimme joelle, jossa oli hyvin hiljaista. Vanha kalastaja kertoi meille matkoistaan ja kutsui kaikki teelle. " * 3,
        "Dün akşam çok sessiz ve sakin olan nehre gittik. Yaşlı balıkçı bize yolculuklarını anlattı ve herkesi çaya davet etti. " * 3,
        "昨天晚上我们去了河边，那里非常安静。老渔夫给我们讲了他的旅行故事。" * 3,
    ]
    kept = {r.doc_id for r in language_id.certain(frame(spark, held + strange), model).collect()}
    assert len(kept & set(range(len(held)))) >= 0.99 * len(held) and not kept & set(range(len(held), len(held) + len(strange)))
    with pytest.raises(ValueError):
        language_id.certain(docs, language_id.train(docs.limit(0), F.lit(True)))


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality_classifier.train(docs, labels, ~quality_classifier.held_out("_id"))
    rows = quality_classifier.score(docs, model).join(labels, "doc_id").where(quality_classifier.held_out("doc_id")).collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    values = [*ODD, "word " * 200_000, "no-spaces" * 50_000, "é"]
    odd = {r.doc_id: r.score for r in quality_classifier.score(frame(spark, values, "quality double, s string"), model).collect()}
    assert odd[0] == odd[1] == odd[2] == 0 and all(0 <= x <= 1 for x in odd.values())
    assert quality_classifier.train(docs, labels.limit(0)).prior == 0.5


def plain_score(model, text):
    """The score of one text, passage by passage, with counts in dictionaries and sums in loops."""
    data, w = np.frombuffer((text or "").encode(), np.uint8), model.weights
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    form, codes = quality_classifier.passages(data, np.array([0, len(data)])).form, []
    for k in range(0, len(starts), quality_classifier.PASSAGE_WORDS):
        words = list(zip(starts, ends))[k : k + quality_classifier.PASSAGE_WORDS]
        begin, end = words[0][0], starts[k + len(words)] if k + len(words) < len(starts) else len(data)
        said = [span_hashes(data, np.array([a]), np.array([b]))[0] for a, b in words]
        runs = [mix(np.array([int(data[j]) | int(data[j + 1]) << 8 | int(data[j + 2]) << 16], np.uint64))[0] for j in range(begin, end - 2)]
        parts = []
        for hashes, n in ((said, quality_classifier.WORD_BUCKETS), (runs, quality_classifier.GRAM_BUCKETS)):
            sums = [0.0] * n
            for h in hashes:
                top = int(h) >> (64 - (2 * n - 1).bit_length())
                sums[top >> 1] += -1 if top & 1 else 1
            roots = [np.sign(x) * abs(x) ** 0.5 for x in sums]
            parts += [x / max(1e-6, sum(y * y for y in roots) ** 0.5) for x in roots]
        parts += np.clip((form[k // quality_classifier.PASSAGE_WORDS] - model.mean) / model.scale, -6, 6).tolist()
        codes.append(np.tanh(np.array(parts) @ w["E"] + w["e"]))
    if not codes:
        return 0.0
    gates = [float(sum(np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"]))) * w["w"])) for h in codes]
    weights = [np.exp(g) / sum(np.exp(x) for x in gates) for g in gates]
    return float(1 / (1 + np.exp(-(sum(a * h for a, h in zip(weights, codes)) @ w["c"] + w["d"]))))


def test_the_classifier_query(spark):
    """Scores one text at a time in plain loops, and the learned model's held-out accuracy."""
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = quality_classifier.train(docs, labels, ~quality_classifier.held_out("_id"))
    again = docs.unionAll(docs.where("doc_id % 2 = 0")).unionAll(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).repartition(5)
    twice = quality_classifier.train(again, labels, ~quality_classifier.held_out("_id"))
    assert all(np.array_equal(model.weights[k], twice.weights[k]) for k in model.weights)
    held, quality = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    rows = entry.QUERIES["op1_quality_classifier"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(held)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        if len(held[r.doc_id] or "") < 6000:
            assert abs(r.score - plain_score(model, held[r.doc_id])) < 1e-4
    known = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and quality.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in known]) > 0.9
