"""That models and scans take all there is: every labelled row and pair, every token."""

import numpy as np

from test_models import corpus
from weft.llm import crf, quality, secret_scan


def test_quality_fits_all_rows_and_pairs(spark):
    """Cuts, weights and threshold are those of all labelled rows and all pairs, by brute force."""
    draw = np.random.default_rng(1)
    n = 700
    y = (draw.random(n) < 0.8).astype(int)
    x = np.round(draw.normal(0, 1, (n, len(quality.NAMES))) + 0.5 * y[:, None], 2)
    x[:, 3], x[:, 4] = 0.0, -np.abs(x[:, 4])
    rows = quality.written(spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "_x array<double>, y int").repartition(3), "rows")
    model = quality.fit(rows)
    cuts = np.quantile(x, np.linspace(0.02, 0.98, quality.STEPS), axis=0).T
    assert np.allclose(model.cuts, cuts, rtol=0, atol=1e-12)
    z = quality.steps(x, model.cuts)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    pull, w = 0.5 / (y == 0).sum(), np.zeros(z.shape[1])
    for _ in range(30):  # Newton over all pairs
        p = 1 / (1 + np.exp(-diff @ w))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + pull * np.eye(len(w)), diff.T @ (p - 1) / len(diff) + pull * w)
        w -= step
    cost = lambda w: np.logaddexp(0, -diff @ w).mean() + pull / 2 * w @ w
    assert np.abs(step).max() < 1e-9 and cost(model.weights) - cost(w) < 3e-6 and np.abs(model.raw(x) - z @ w).max() < 0.05
    assert np.isclose(model.centre, np.quantile(z @ model.weights, (y == 0).mean()), rtol=0, atol=1e-9)


def test_quality_takes_every_label(spark):
    """More labelled rows than any sample held, with repeated ids, labels without a text and labels that are none."""
    docs = spark.range(25_000).selectExpr("id as doc_id", "concat('text ', id) as text").union(spark.createDataFrame([(5, "another"), (None, "none")], "doc_id long, text string"))
    labels = spark.range(24_000).selectExpr("id as doc_id", "cast(id % 9 > 0 as int) as quality").union(spark.createDataFrame([(24_100, 7), (24_200, None), (30_000, 1), (0, 1)], "doc_id long, quality int"))
    rows = quality.measured(docs.selectExpr("doc_id", "text", "xxhash64(text) as h"), ["doc_id", "h"])
    assert dict(quality.labelled(rows, labels).groupBy("y").count().collect()) == {0: 2_666, 1: 21_334}


def test_field_reads_every_token():
    """Secrets of letters alone and short ones are found, and spans are those of the best path over all tokens of a text."""
    model = secret_scan.fit([e for t in corpus(400, 1) for e in secret_scan.examples(t)])
    for text in ("the river passphrase kXhGqPzRtVbNmWcLdFgJ of green stone", "the river pwd: x7Kq2aZ of green stone"):
        assert [text[a:z] for a, z in model.spans(text)] in (["kXhGqPzRtVbNmWcLdFgJ"], ["x7Kq2aZ"])
    held = corpus(200, 2)
    cases = [v for t in held for v in secret_scan.plainer(t, 7)]
    assert len(cases) > 30 and sum((s[0], s[1]) in model.spans(t) for t, s in cases) >= 0.8 * len(cases)
    for text in [*held, *(t for t, _ in cases), "token " * 30 + "no id x7Kq2aZ", "", "=", "1 22 a-b/c+d== ß user:" * 9]:
        whole, want = secret_scan.text_features(text), []
        for run in secret_scan.open_runs(text):
            emit = np.array([model.weights[secret_scan.observed(text, a, z, whole)].sum(0) for a, z in run])
            tags = crf.viterbi(emit[None], model.trans, np.array([len(run)]))[0]
            want += [place for place, tag in zip(run, tags) if tag]
        got = [place for run in secret_scan.open_runs(text) for place in run if any(a <= place[0] and place[1] <= z for a, z in model.spans(text))]
        assert got == want
