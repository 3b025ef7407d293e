import re

from sparkloom.llm import license_scan as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "...", "cc", "cc by", "CC-BY cc by, all RIGHTS reserved", "by cc", "general public license general public license", "licence all rights  \n reserved.",
    "all all rights rights reserved", "é" * 9 + " cc by cc by", "x " * 30000 + "all rights reserved", "general public", "ccby cc1 by",
]


def run(spark, texts, **kinds):
    rows = [(i, t, "a", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, hash int").repartition(2)


def test_base_places_match_brute_force(spark, tmp_path):
    run(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op1_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), (i, t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_notices_with_gaps_and_near_misses(spark, tmp_path):
    mit = L.NOTICES["mit"].split()
    gap = " ".join(mit[:18] + ["(the", "Software)", "of", "ours"] + mit[18:])
    texts = [" ".join(mit), gap, " ".join(mit[:5]), " ".join(reversed(mit)), "Licensed under the Apache License, Version 2.0."]
    run(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.labels, r.score) for r in L.op1_license_scan(spark, str(tmp_path)).collect()}
    assert got[0] == ("mit", 1.0) and got[1][0] == "mit" and 0.8 < got[1][1] < 1
    assert got[2] == ("", 0.0) and got[3] == ("", 0.0) and got[4] == ("apache-2.0", 1.0)


def test_repeated_and_missing_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, "cc by")], "doc_id long, text string")
    assert L.license_spans(docs).count() == 3
    assert L.license_spans(docs.where("false")).count() == 0


def test_each_place_of_a_notice_counts_once(spark):
    part = "Licensed under the Apache License"
    texts = [part, f"{part} {part}", f"{part} {part} {part}", f"{part}, Version 2.0. {part}", f"{part} {part}, Version 2.0.", "mit " + " ".join(L.NOTICES["mit"].split()[:14] * 3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.label, s.score) for s in r.spans] for r in L.license_spans(docs).collect()}
    assert [got[i] for i in (0, 1, 2, 5)] == [[]] * 4
    assert got[3] == [("apache-2.0", 1.0)] and got[4] == [("apache-2.0", 1.0)]


def test_notices_against_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = []
    for _ in range(60):  # notices with words left out or put in, one after another
        words = []
        for _ in range(rng.randint(1, 3)):
            n = L.NOTICES[rng.choice(sorted(L.NOTICES))].split()
            n = [w for w in n if rng.random() > 0.05]
            if rng.random() < 0.4:
                n.insert(rng.randrange(len(n)), "other")
            words += [*n, *("filler" for _ in range(rng.choice([0, 3, 40])))]
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: {s.label: s.score for s in r.spans} for r in L.license_spans(docs).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        grams = {tuple(words[j : j + L.LONG]) for j in range(len(words) - L.LONG + 1)}
        for label, notice in L.NOTICES.items():
            n = notice.split()
            own = [tuple(n[j : j + L.LONG]) for j in range(len(n) - L.LONG + 1)]
            share = sum(g in grams for g in own) / len(own)  # no span holds more
            if label in got[i]:
                assert L.LEAST <= got[i][label] <= share + 1e-9
            else:
                assert notice not in t


def longest(text, label):
    """Share of a notice's grams in the longest chain of hits that rises in text and notice."""
    words, n = re.findall(r"[a-z0-9]+", text.lower()), L.NOTICES[label].split()
    own = [n[j : j + L.LONG] for j in range(len(n) - L.LONG + 1)]
    hits = [(i, j) for i in range(len(words)) for j, g in enumerate(own) if words[i : i + L.LONG] == g]
    best = {}
    for i, j in hits:
        best[i, j] = 1 + max((v for (a, b), v in best.items() if a < i and b < j), default=0)
    return max(best.values(), default=0) / len(own)


def test_titles_tails_and_notices_in_a_row(spark):
    import random

    whole = "Licensed under the Apache License, Version 2.0"
    texts = ["Apache License Version 2.0\n" + whole, whole + " " + whole, "the Apache License, Version 2.0 " + whole, whole + "\nApache License Version 2.0", "Apache License Version 2.0. See: Apache License Version 2.0\n" + whole]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.label, s.score) for s in r.spans] for r in L.license_spans(docs).collect()}
    assert all(("apache-2.0", 1.0) in got[i] for i in range(len(texts)))
    rng = random.Random(5)
    mixed = []
    for _ in range(80):  # one notice, with a few words put in or left out, a part of it before or behind
        label = rng.choice(sorted(L.NOTICES))
        n = L.NOTICES[label].split()
        out = [w for w in n if rng.random() > 0.04]
        if rng.random() < 0.6:
            out.insert(rng.randrange(len(out) + 1), "other")
        if rng.random() < 0.4:
            k = rng.randint(1, 5)
            out = n[-k:] + out if rng.random() < 0.5 else out + n[:k]
        mixed.append((" ".join(out), label))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(mixed)], "doc_id long, text string")
    got = {r.doc_id: {s.label: s.score for s in r.spans} for r in L.license_spans(docs).collect()}
    for i, (text, label) in enumerate(mixed):
        want = longest(text, label)
        assert got[i].get(label, 0) == (want if want >= L.LEAST else 0), (text, label)


def test_very_long_texts_and_clashing_columns(spark):
    part = "Licensed under the Apache License "
    docs = spark.createDataFrame([(1, part * 4000 + "Version 2.0", 1, 2, "x")], "doc_id long, text string, pos int, row int, template string")
    (r,) = L.license_spans(docs).collect()
    assert [(s.label, s.score) for s in r.spans] == [("apache-2.0", 1.0)] and r.n_words == 20003
