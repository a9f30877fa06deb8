"""Packing, coding, media, scans and classifiers: brute force, round trips, held-out accuracy, and the odd cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weft.llm import crf, media, packing, pii, quality, secret_scan, sentence_piece, toxicity

ODD = [None, "", " \n\t", "a", "É ß ﬁ İstanbul Σ", "x\x1cy <|endoftext|> z", "  two  spaces ", "\x00 \x85 　", "Word. word, WORD! it's 12 é" * 40, "漢字かな😀"]
SCHEMA = "doc_id long, text string, score double, length string, sequence_id long, digest string, spans string"


def table_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 0.5, "x", 1, "d", "s") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def test_packing(spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    lib = Tokenizer.from_file(path)
    texts = [*ODD, *ODD, "long " * 900, *["same length"] * 50]
    ids = [*range(len(ODD)), *range(len(ODD)), None, *[99] * 50]
    rows = packing.packed(table_of(spark, texts, ids), path, 64).collect()
    want = []
    for i, t in zip(ids, texts):
        tokens = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(i), k // 64, k, len(tokens[k : k + 64]), zlib.crc32(np.array(tokens[k : k + 64], "<u4").tobytes())) for k in range(0, len(tokens), 64)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 64
    assert packing.packed(table_of(spark, ["x"]).limit(0), path).count() == 0


def best_fit_one_by_one(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


def test_plan_is_best_fit():
    draw = random.Random(9)
    for _ in range(40):
        size = draw.choice([10, 64, 100])
        lengths = [draw.randint(1, size) for _ in range(draw.randint(1, 150))]
        histogram = {n: lengths.count(n) for n in lengths}
        slots = packing.best_fit(histogram, size)
        used: dict[int, int] = {}
        for n, a, z, base, _ in slots:
            for k in range(z - a):
                used[base + k] = used.get(base + k, 0) + n
        assert sorted(size - u for u in used.values()) == best_fit_one_by_one(lengths, size)
        ranks = sorted((n, k) for n, a, z, _, _ in slots for k in range(a, z))
        assert ranks == sorted((n, k) for n, c in histogram.items() for k in range(c))
    assert len(packing.best_fit({n: 10**9 + n for n in range(1, 200)}, 200)) < 20_000  # counts don't matter


def test_sentencepiece(spark):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    v = sentence_piece.Vocabulary.of(path)
    draw = random.Random(10)
    alphabet = "  ▁\n\taeinrst ÀéßΣ你好😀\x00\x85."
    texts = [t or "" for t in ODD] + ["".join(draw.choices(alphabet, k=draw.choice([1, 5, 40, 300]))) for _ in range(400)] + ["international" * 400]
    for t in texts:
        ids = np.frombuffer(v.encode(t), "<u4").tolist()
        assert ids == lib.encode(t) and v.decode(v.encode(t)) == lib.decode(ids)
    rows = sentence_piece.decoded(sentence_piece.encoded(table_of(spark, ODD), path), path).collect()
    assert {r.doc_id: r.n_ids for r in rows} == {i: len(lib.encode(t or "")) for i, t in enumerate(ODD)}


def test_unigram_search():
    draw = random.Random(11)
    pieces = {p: (i, -draw.random() * 9) for i, p in enumerate({"".join(draw.choices("abc", k=n)) for n in (1, 1, 1, 2, 2, 2, 3, 3, 4) for _ in range(3)} | set("abc"))}
    v = sentence_piece.Vocabulary(pieces, None, 0, bpe=False)
    for n in (0, 1, 7, 50, 400):
        text = "".join(draw.choices("abc", k=n))
        best = [0.0] + [-1e18] * n
        for i in range(1, n + 1):
            best[i] = max(best[j] + pieces[text[j:i]][1] for j in range(max(0, i - 4), i) if text[j:i] in pieces)
        found = list(v.search(text))
        assert "".join(found) == text and sum(pieces[p][1] for p in found) == pytest.approx(best[n])


def test_media(spark):
    texts = [*ODD, ODD[8], "b" * 64, "b" * 65, "x" * 200_000]
    got = media.text_media(table_of(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.text_media(table_of(spark, ["x"]).limit(0)).count() == 0
    html = '<p>One<figure><img src="sha256:aa" alt="no"><img src=b.png><figcaption>Cap <b>x</b></figcaption></figure>two<img src=c.png alt=" own "><script>no</script>'
    assert [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.sequence(html)] == [(0, "text", "One", None), (1, "image", "sha256:aa", "Cap x"), (2, "image", "b.png", "Cap x"), (3, "text", "two", None), (4, "image", "c.png", "own")]
    assert media.sequence(None) == []
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("aa", 5)], "digest string, width int")
    assert {(r.position, r.width) for r in media.resolved(media.sequences(pages), store).collect()} == {(1, 5), (2, None), (4, None)}


def test_crf_against_enumeration():
    from itertools import product

    draw = np.random.default_rng(12)
    emit, trans, lengths = draw.normal(size=(3, 4, 3)), draw.normal(size=(3, 3)), np.array([4, 2, 1])
    tags = draw.integers(0, 3, (3, 4))
    score = lambda e, t: sum(e[i, y] for i, y in enumerate(t)) + sum(trans[a, b] for a, b in zip(t, t[1:]))
    paths = [list(product(range(3), repeat=n)) for n in lengths]
    best = crf.viterbi(emit, trans, lengths)
    assert all(tuple(best[i][: lengths[i]]) == max(p, key=lambda t: score(emit[i], t)) for i, p in enumerate(paths))
    loss, d_emit, d_trans = crf.gradients(emit, trans, tags, lengths)
    assert loss == pytest.approx(np.mean([np.log(sum(np.exp(score(emit[i], t)) for t in p)) - score(emit[i], tuple(tags[i][: lengths[i]])) for i, p in enumerate(paths)]))
    e = emit.copy()
    e[0, 1, 2] += 1e-6
    assert (crf.gradients(e, trans, tags, lengths)[0] - loss) / 1e-6 == pytest.approx(d_emit[0, 1, 2], abs=1e-4)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SECRETS = ["password=b7db7aa4a5fc", "PassWord : 'short'", "api_key=\"a.b_c-d+e/f=\" token: ab token:abcdef", "AKIA" + "A1" * 9, "AKIASHORT", "x" + "0123456789abcdef" * 2 + "g", "deadbeef" * 3, "ſecret=abcdefgh", "toKen=abcdefgh", *ODD]


def test_secret_patterns(spark):
    model = secret_scan.fit(secret_scan.examples(" ".join(SECRETS[:7]) + " 12345678 tel 555555555"))
    got = {r.doc_id: r for r in secret_scan.scan(table_of(spark, SECRETS), model).collect()}
    for i, t in enumerate(SECRETS):
        t = t or ""
        want = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(want))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    assert secret_scan.masked("a SECRETX b", [(2, 9, "crf"), (4, 6, "hex")]) == "a [SECRET] b"
    assert secret_scan.train(table_of(spark, ["x"]).limit(0)).spans("token 12345678") == []


def test_secret_field_learns():
    draw = random.Random(13)
    text = " ".join(f"w password={''.join(draw.choices('0123456789abcdef', k=20))} w" if i % 2 else f"w call {draw.randint(10**9, 10**10)} w" for i in range(200))
    data = [e for k in range(0, len(text), 400) for e in secret_scan.examples(text[k : k + 400])]
    model = secret_scan.fit(data)
    assert model.spans("w w pwd=9f8e7d6c5b4a39281706 w") == [(8, 28)] and model.spans("w call 5551234567 w") == []


PII = ["a.b@x-y.example.com, c@d", "@ @x.y a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.255", "4539 1488 0343 6467 4539-1488-0343-6468", "+1 (988) 555-2485 +12 34", "+1" + "2" * 30, "1" * 40, *ODD]


def test_pii_patterns(spark):
    model = pii.fit([])
    got = {r.doc_id: r for r in pii.scan(table_of(spark, PII), model).collect()}
    for i, t in enumerate(PII):
        t = t or ""
        want = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0]
        want += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        joined = ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(want))
        assert (got[i].spans, got[i].base_sha256) == (joined, hashlib.sha256(joined.encode()).hexdigest())


def test_network_phones_need_no_plus():
    class Reader:
        def spans(self, texts):
            return [[(m.start(), m.end(), "phone") for m in re.finditer(r"[(0-9][()0-9 -]+[0-9]", t)] for t in texts]

    text = "call (555) 123-4567 or 555-123-4568 ext, not 555-1234 or 1234 5678 9012 3456"
    ((base, found),) = pii.all_spans([text], Reader())
    assert base == [] and [text[a:z] for a, z, k in found if k == "model_phone"] == ["(555) 123-4567", "555-123-4568"]


def test_pii_network():
    draw = random.Random(14)
    line = lambda: f"word er th +1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)} the on {draw.randint(1, 255)}.{draw.randint(1, 255)}.{draw.randint(1, 255)}.{draw.randint(1, 255)} in 12 ab{draw.randint(1, 9)}"
    model = pii.fit([e for _ in range(300) for e in pii.examples(line())])
    text = line()
    found = {(a, z) for a, z, _ in model.spans([text])[0]}
    truth = {(a, z) for a, z, _ in pii.base_spans(text)}
    assert len(found & truth) >= 1
    draw = np.random.default_rng(15)  # gradients of the LSTM
    x, w, b = draw.normal(size=(2, 3, pii.EMBED)), draw.normal(size=(pii.EMBED + pii.HIDDEN, 4 * pii.HIDDEN)) * 0.3, np.zeros(4 * pii.HIDDEN)
    out, held = pii.lstm(x, w, b)
    dx, dw, _ = pii.lstm_back(np.ones_like(out), held, w)
    w2, x2 = w.copy(), x.copy()
    w2[3, 5] += 1e-6
    x2[1, 0, 2] += 1e-6
    assert (pii.lstm(x, w2, b)[0].sum() - out.sum()) / 1e-6 == pytest.approx(dw[3, 5], abs=1e-4)
    assert (pii.lstm(x2, w, b)[0].sum() - out.sum()) / 1e-6 == pytest.approx(dx[1, 0, 2], abs=1e-4)


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


@pytest.mark.parametrize(("run", "label", "least"), [(toxicity.op4_toxicity, "toxic", 0.7), (quality.op5_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, run, label, least):
    sf = "/root/testdata/sf0.01"
    rows = run(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y = np.array([r[label] for r in rows])
    assert auc(np.array([r.score for r in rows]), y) > least and np.mean([r.predicted == r[label] for r in rows]) > 0.9


def test_classifiers_without_labels(spark):
    docs = table_of(spark, [*ODD, "you are an idiot. fine", "nothing here", "she said he is not an idiot"])
    none = spark.createDataFrame([], "text string, y int")
    rows = {r.doc_id: r for r in toxicity.scored(docs, toxicity.train(none)).collect()}
    assert rows[10].predicted == 1 and rows[11].predicted == 0 and rows[12].score < rows[10].score and len(rows) == len(ODD) + 3
    assert {r.score for r in quality.scored(docs, quality.train(none)).collect()} == {0.5}
    g = toxicity.grammar()
    assert g.best([toxicity.PLAIN]) is None and g.best([toxicity.TARGET, toxicity.INSULT]) > g.best([toxicity.INSULT]) > g.best([toxicity.NEGATION, toxicity.INSULT])
