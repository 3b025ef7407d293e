import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from sparkloom.llm import langid as G

WORDS = {"en": ["the", "and", "with", "that", "thing"], "de": ["der", "und", "nicht", "schön", "für"], "fr": ["le", "être", "ça", "pour", "queue"]}


def rows(n=240, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        out.append((i, "\n".join(" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 6))), lang, "s" + str(i % 2)))
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "c") for r in data], "doc_id long, text string, lang string, source string, lang_pred string").repartition(3)


def test_held_out_accuracy_and_odd_texts(spark, tmp_path):
    data = rows() + [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 34 !?", "de", "s"), (903, "the " * 60000, None, "s"), (None, "und nicht für", "de", None), (5, "le queue", "fr", "s")]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = G.op9_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    truth = {i: lang for i, _, lang, _ in rows()}
    test = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(test) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in test]) > 0.95
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "en" and by[None].lang_pred == "de"


def test_every_label_is_learned_and_reruns_agree(spark):
    rng = random.Random(4)
    data = rows() + [(1000 + i, f"same eight bytes {rng.random()}", f"rare{i:03d}", "s") for i in range(230)]
    docs = frame(spark, data)
    a, b = G.train(docs), G.train(docs.repartition(7))
    assert a.labels == b.labels and len(a.labels) == 233
    assert all(np.array_equal(x, y) for x, y in zip([*a.tables, a.out], [*b.tables, b.out], strict=True))


def test_more_labels_than_the_sample_has_room_for(spark, monkeypatch):
    data = [(i, f"some text {i % 3000} of its own", f"l{i % 3000:04d}", "s") for i in range(6000)]
    seen = []
    monkeypatch.setattr(G.Network, "fit", lambda self, x, y: seen.append((len(self.labels), len(set(y.tolist())))))
    G.train(frame(spark, data))
    assert seen == [(3000, 3000)]


def test_prediction_is_the_filters_own_sum():
    net = G.Network(["a", "b"])
    rng = np.random.default_rng(2)
    net.out = rng.standard_normal(net.out.shape).astype(np.float32)
    x = rng.integers(0, 256, (3, G.WINDOW)).astype(np.uint8)
    tops = []
    for t, c, w in zip(net.tables, net.bias, G.WIDTHS, strict=True):
        z = np.stack([sum(t[j][x[:, i + j]] for j in range(w)) for i in range(G.WINDOW - w + 1)])
        tops.append(z.max(axis=0) + c)
    want = G.softmax(np.maximum(np.concatenate(tops, axis=1), 0) @ net.out + net.out_bias)
    assert np.allclose(net.probabilities(x, net.folded()), want, atol=1e-4)


def test_windows_cover_whole_texts():
    data, off = G._raw(pa.array(["a" * 600, None, "", "bc"]))
    x, text, held = G.windows(data, off)
    assert text.tolist() == [0, 0, 0, 3] and held.tolist() == [256, 256, 88, 2] and x[3, :3].tolist() == [98, 99, 0]


def test_nothing_to_learn_from(spark, tmp_path):
    frame(spark, [(1, "abc", None, "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.lang_pred, r.score) for r in G.op9_langid(spark, str(tmp_path)).collect()] == [("und", 0.0)]
    assert G.predictor(G.Network([])) is not None


def test_pipeline_stages(spark, tmp_path):
    data = rows(120, 1)
    copies = [(1000 + i, data[i][1], data[i][2], data[i][3]) for i in range(10)]
    junk = [(2000, "123 456", "en", "s0"), (2001, None, "en", "s0")]
    frame(spark, data + copies + junk).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        else:
            docs = out
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    language, lines, near, mixed, packed = seen
    assert not language & {2000, 2001} and len(language) == 130
    assert lines <= language and near <= lines and mixed <= near and packed == mixed
    assert len(near & {r[0] for r in copies}) < 10
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(run.columns)
    assert {r.doc_id for r in run.collect()} == packed


def test_no_exact_copy_survives(spark, tmp_path):
    data = rows(120, 1)
    copies = [(1000 + i, *data[i][1:]) for i in range(60)]
    frame(spark, data + copies).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lines = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert {r.doc_id for r in lines.collect()} == {r[0] for r in data}
    near = corpus_pipeline.near_dedup(spark, lines, str(tmp_path))
    assert not {r.doc_id for r in near.collect()} & {r[0] for r in copies}


def test_pipeline_with_odd_rows(spark, tmp_path):
    data = rows(90, 3)
    odd = [(3000, None, None, None), (None, "der und nicht schön für den", "de", "s0"), (3001, "", "en", None), (3001, "", "en", None), (5, data[5][1], "fr", "s1"), (3002, "the thing and that with " * 9000, "en", "s0"), (3003, "the and thing", None, None)]
    table = spark.createDataFrame([(*r, "x", 3, 4, "y") for r in data + odd], "doc_id long, text string, lang string, source string, key string, hash int, piece int, row string").repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "near_dedup":
            assert not any(r.text is None or r.text == "" for r in docs.collect())
            n = Counter(r.doc_id for r in docs.collect())
            assert max(n.values()) == 1 and {3002, 5} <= set(n)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in got if r.piece == 0)
    assert copies == Counter(r.doc_id for r in docs.collect())
    ids = {r.doc_id: r.text for r in docs.collect()}
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert all(total[d] == copies[d] * (len(plain.encode(ids[d], add_special_tokens=False).ids) + 1) for d in ids)


def test_pipeline_with_a_column_of_line_dedup(spark, tmp_path):
    data = rows(60, 1)
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(data + [(1000, *data[0][1:])])], "doc_id long, text string, lang string, source string, chunks_removed int, row string")
    out = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {(r.doc_id, r.chunks_removed) for r in out.collect()} == {(r[0], i) for i, r in enumerate(data)}
    from sparkloom.llm import line_dedup

    assert line_dedup.dedup_runs(docs).columns == ["doc_id", "text", "lang", "source", "row", "chunks_removed"]


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, rows(3)).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
