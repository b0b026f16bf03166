import random
import zlib

import numpy as np

from lexquarry.llm import lang_id

KIND = "doc_id long, text string, lang string"
SETS = {"a": ["foo", "bar", "baz"], "b": ["ñandú", "año", "qué"], "c": ["zzyzx", "wxyw", "kqk"]}


def documents(n):
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(SETS["abc"[i % 3]]) for _ in range(rng.randint(4, 40))), "abc"[i % 3]) for i in range(n)]


def held_out(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 3 == 1


def test_held_out_documents(spark):
    docs = documents(400)
    df = spark.createDataFrame([*docs, (900, None, "a"), (901, "12 ! 3", "b"), (902, "", None), (903, "foo bar", None), (None, "qué año", "b")], KIND)
    df = df.selectExpr("*", "1 AS id", "'x' AS score", "'y' AS lang_pred", "2 AS h", "3 AS rate")
    rows = lang_id.predict(df, lang_id.fit(df), carry=("lang", "score")).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert len(rows) == 405 and {got[d] for d in (900, 901, 902)} == {"und"} and got[903] == "a"
    out = [got[d] == lang for d, _, lang in docs if held_out(d)]
    assert len(out) > 100 and np.mean(out) > 0.97


def test_labels_of_held_out_documents_are_not_learned(spark):
    """Wrong labels on held-out rows change nothing."""
    docs = documents(300)
    wrong = [(d, t, "z" if held_out(d) else lang) for d, t, lang in docs]
    fits = [lang_id.fit(spark.createDataFrame(x, KIND)) for x in (docs, wrong)]
    assert fits[1].langs == ["a", "b", "c"] and all((fits[0].out[k] == fits[1].out[k]).all() for k in ("w", "b"))


def test_repeated_rows_count_once_and_partitions_do_not_matter(spark):
    docs = documents(200)
    one = lang_id.training_segments(spark.createDataFrame(docs, KIND).repartition(1), "doc_id", "text", "lang")
    two = lang_id.training_segments(spark.createDataFrame(docs + docs[:50] * 20, KIND).repartition(7), "doc_id", "text", "lang")
    assert one[0] == two[0] and sorted(map(bytes, one[1].astype(np.uint8))) == sorted(map(bytes, two[1].astype(np.uint8)))


def test_nothing_to_learn_and_very_long_texts(spark):
    df = spark.createDataFrame(documents(6), KIND)
    assert {r["lang_pred"] for r in lang_id.predict(df, lang_id.fit(df.limit(0))).collect()} == {"und"}
    assert lang_id.predict(df.limit(0), lang_id.fit(df)).count() == 0
    long = spark.createDataFrame([(1, "ñandú año " * 150_000, "b")], KIND)
    row = lang_id.predict(long, lang_id.fit(spark.createDataFrame(documents(200), KIND))).first()
    assert row["lang_pred"] == "b" and 0.5 < row["score"] <= 1


def test_gradients_equal_differences():
    """Backpropagation through time against finite differences, in one direction."""
    rng = np.random.default_rng(4)
    one = lang_id.Direction(rng)
    one.p = {k: v.astype(np.float64) for k, v in one.p.items()}
    ids, weight = rng.integers(0, 257, (9, 3)), rng.normal(size=(9, 3, lang_id.HIDDEN))

    def loss():
        return float((one.forward(ids)[0].astype(float) * weight).sum())

    _, trace = one.forward(ids, True)
    g = one.backward(ids, trace, weight.astype(np.float32))
    for name in ("x", "u", "c"):
        for _ in range(12):
            at = (int(rng.choice(ids.ravel())) if name == "x" else int(rng.integers(lang_id.HIDDEN)), int(rng.integers(one.p[name].shape[1])))
            kept, sides = one.p[name][at], []
            for step in (1e-3, -1e-3):
                one.p[name][at] = kept + step
                sides.append(loss())
            one.p[name][at] = kept
            assert abs((sides[0] - sides[1]) / 2e-3 - g[name][at]) < 5e-3 * (1 + abs(g[name][at])), (name, at)


def walked(network, data):
    """Pooled probabilities of one text, position by position in plain steps."""
    h, total = lang_id.HIDDEN, np.zeros(len(network.langs))

    def states(one, piece):
        s, out = np.zeros(h), []
        for b in piece:
            add = one.p["x"][b].astype(float)
            z, r = np.split(1 / (1 + np.exp(-(add[: 2 * h] + s @ one.p["u"]))), 2)
            s = s + z * (np.tanh(add[2 * h :] + (r * s) @ one.p["c"]) - s)
            out.append(s)
        return out

    for i in range(0, len(data), lang_id.SEGMENT):
        piece = data[i : i + lang_id.SEGMENT]
        for a, b in zip(states(network.ahead, piece), states(network.back, piece[::-1])[::-1]):
            e = np.exp(np.concatenate([a, b]) @ network.out["w"] + network.out["b"])
            total += e / e.sum()
    return total / max(1, len(data))


def test_pooled_probabilities_equal_a_walk():
    """Texts of whole pieces, or of one short one, so that no piece is padded."""
    network = lang_id.Network(["a", "b", "c"])
    for text in (b"some text", "ñandú año".encode(), b"x", b"xyz " * lang_id.SEGMENT, bytes(range(32, 127)) * lang_id.SEGMENT):
        data = text[: max(1, len(text) // lang_id.SEGMENT) * lang_id.SEGMENT][: 3 * lang_id.SEGMENT]
        got = network.documents(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        np.testing.assert_allclose(got[0], walked(network, data), atol=2e-4)
    assert (network.documents(np.zeros(0, np.uint8), np.array([0, 0])) == 0).all()
