import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from sparkloom.llm import quality as Q

KIND = "doc_id long, text string, lang string, source string, w string, l int, of string, n int, start int"


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(windows)
    again = {i + k for i, g in enumerate(windows) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed, len(lines)


def vector(c):
    n = max(c[0], 1)
    half = lambda x: math.floor(x + 0.5)
    return [half(1000 * x) for x in (math.log(n), math.log((c[1] + 1) / n), math.log(1 + 20 * c[2] / n), math.sqrt(c[3] / max(c[6], 1)), math.sqrt(c[4] / n))]


FLOOR = np.diag([float(v) ** 2 for v in Q.STATISTICS.values()])


def step(x, centre, cov):
    d = x - centre
    d2 = (d * np.linalg.solve(cov + FLOOR, d.T).T).sum(axis=1)
    bucket = np.floor(np.log2(d2 + 1e-6) * Q.FINE)
    upto = np.sort(bucket)[math.ceil(len(x) * Q.HALF) - 1]
    own = x[bucket <= upto]
    cov = own.T @ own / len(own) - np.outer(own.mean(axis=0), own.mean(axis=0))
    return own.mean(axis=0), cov, np.linalg.slogdet(cov + FLOOR)[1], d2[bucket <= upto].max()


def estimate(x):
    q = np.percentile(x, [25, 50, 75], axis=0)
    z = np.maximum((q[2] - q[0]) / 1.349, np.sqrt(np.diag(FLOOR)))
    soft = np.cov(np.round(np.tanh((x - q[1]) / z) * 10000).T, bias=True)
    spread = np.sqrt(np.maximum(np.diag(soft), 1))
    tied = soft / np.outer(spread, spread) * np.outer(z, z)
    np.fill_diagonal(tied, z * z)
    best = None
    for centre, cov in ((q[1], np.diag(z * z)), (q[1], tied), (x.mean(axis=0), np.cov(x.T, bias=True))):
        for _ in range(Q.FIRST):
            now = step(x, centre, cov)
            centre, cov = now[:2]
        if best is None or now[2] < best[2]:
            best = now
    for _ in range(Q.MOST):
        now = step(x, *best[:2])
        if not now[2] < best[2] - 1e-9:
            break
        best = now
    return best


def verdicts(rows):
    """(counts, kept, distance or None) for each row."""
    told = [counts(r[1]) for r in rows]
    group = defaultdict(list)
    for r, c in zip(rows, told, strict=True):
        if not c[5]:
            group[r[2], r[3]].append(vector(c))
    own = {k for k, v in group.items() if len(v) >= Q.LEAST}
    rest = defaultdict(list)
    for k, v in group.items():
        if k not in own:
            rest[k[0]] += v
    pool = [v for r in rest.values() if len(r) < Q.LEAST for v in r]
    made = {k: estimate(np.array(group[k], float)) for k in own} | {(k,): estimate(np.array(v, float)) for k, v in rest.items() if len(v) >= Q.LEAST}
    made |= {(): estimate(np.array(pool, float))} if len(pool) >= Q.LEAST else {}
    out = []
    for r, c in zip(rows, told, strict=True):
        key = (r[2], r[3])
        e = made.get(key) or (made.get((r[2],)) or made.get(()) if key in group else None)
        if e is None:
            out.append((c, not c[5], None))
            continue
        d = np.array(vector(c), float) - e[0]
        d2 = d @ np.linalg.solve(e[1] + FLOOR, d) / max(1, e[3] / Q.quantile(Q.HALF))
        out.append((c, not c[5] and d2 <= Q.quantile(1 - Q.BEYOND), d2))
    return out


def texts(n, seed, lang, source, first=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(int(math.exp(rng.gauss(5, 0.6))) + 50)]
        if i % 17 == 0:
            words += words[5:15]
        if i % 29 == 0:
            words = [w + rng.choice(["", "##", "|", " $"]) for w in words]  # junk
        for j in range(7, len(words), 9):
            words[j] += rng.choice(["\n", "\nsame line\n", "\t", " \n \n"])
        out.append((first + i, " ".join(words), lang, source))
    return out


def table(spark, rows, path):
    spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], KIND).repartition(5).write.parquet(f"{path}/documents.parquet")


def test_counts_and_verdicts_match_brute_force(spark, tmp_path):
    rows = texts(450, 1, "en", "a") + texts(260, 2, "en", None, 1000) + texts(90, 3, "de", "a", 2000) + texts(140, 4, "de", "b", 3000) + texts(60, 5, None, "c", 4000) + texts(150, 6, "fr", "c", 5000)
    odd = [None, "", "a a a a", "one two three " * 40, "x y\x1cz " * 30, "\n\n a \n a \n\t\n a \n", "word " * 60, " ".join(map(str, range(60))), "é$ " + " ".join(f"w{i}" for i in range(60))]
    rows += [(9000 + i, t, "en", "a") for i, t in enumerate(odd)] + [(None, "x", None, None), rows[0], rows[0], (9100, " ".join(f"v{i % 30011}" for i in range(120000)), "en", "a")]
    table(spark, rows, tmp_path)
    got = defaultdict(list)
    for r in Q.op11_quality_rules(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for r, (c, kept, d2) in zip(rows, verdicts(rows), strict=True):
        for x in got[r[0]]:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == c[:6], r[0]
            assert (x.distance is None) == (d2 is None) and (d2 is None or math.isclose(x.distance, d2, rel_tol=1e-6, abs_tol=1e-6))
            assert x.kept == kept
    junk = [r for i, r in enumerate(texts(450, 1, "en", "a")) if i % 29 == 0]
    assert not any(x.kept for r in junk[1:] for x in got[r[0]])
    clean = [x.kept or x.base_failed for i, r in enumerate(texts(450, 1, "en", "a")) if i % 29 for x in got[r[0]]]
    assert np.mean(clean) == 1.0


def test_few_texts_are_kept_and_an_empty_table(spark, tmp_path):
    rows = texts(30, 1, "en", "a")
    table(spark, rows, tmp_path / "a")
    table(spark, [], tmp_path / "b")
    assert all(r.kept != r.base_failed and r.distance is None for r in Q.op11_quality_rules(spark, str(tmp_path / "a")).collect())
    assert Q.op11_quality_rules(spark, str(tmp_path / "b")).count() == 0


def test_equal_texts_and_reruns_agree(spark, tmp_path):
    rows = texts(300, 1, "en", "a") + [(10000 + i, "the same words " + " ".join(f"a{j}" for j in range(60)), "en", "a") for i in range(700)]
    table(spark, rows, tmp_path)
    first, again = ({(r.doc_id, r.kept, r.distance) for r in Q.op11_quality_rules(spark, str(tmp_path)).collect()} for _ in range(2))
    assert first == again and len({x[1:] for x in first if x[0] >= 10000}) == 1


def test_quantiles():
    assert abs(Q.quantile(0.95) - 11.0705) < 1e-3 and abs(Q.quantile(0.75) - 6.62568) < 1e-3
