import base64
import quopri
import random

import numpy as np
import pyarrow as pa

from sonarloom.llm import leaks as L
from sonarloom.llm.mail import text_parts, words

rng = random.Random(11)
VOCABULARY = [a + b for a in ("ba", "do", "ki", "mu", "re", "sa", "té") for b in ("lan", "mor", "nis", "pul", "tek", "vor", "zim")]
PASSAGES = {i: " ".join(rng.choice(VOCABULARY) for _ in range(40)) + f" {100 + i}." for i in range(1, 7)}


def brute(docs, passages, run=13):
    found = set()
    for d, text in docs:
        for part in text_parts(text) if text else []:
            w = words(part)
            grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
            for i, p in passages:
                v = words(p) if p else []
                if any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                    found.add((d, i))
    return found


def mail(body, encoding=None, kind="text/plain", eol="\n"):
    head = f"Subject: x{eol}Content-Type: {kind}; charset=utf-8{eol}"
    if encoding == "base64":
        body, head = base64.encodebytes(body.encode()).decode(), head + f"Content-Transfer-Encoding: base64{eol}"
    elif encoding == "quoted-printable":
        body, head = quopri.encodestring(body.encode()).decode(), head + f"Content-Transfer-Encoding: Quoted-Printable{eol}"
    return head + eol + body.replace("\n", eol)


def test_text_parts():
    inner = "--b\nContent-Type: application/pdf; name=x.pdf\n\nno\n--b\nContent-Type: text/plain; name=\"n.txt\"\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--b\n\nbare\n--b--\nepilogue"
    assert sorted(text_parts("MIME-Version: 1.0\nContent-Type: multipart/mixed;\n boundary=\"b\"\n\npreamble\n" + inner)) == ["bare", "hello"]
    assert words(text_parts(mail("<p>a<b>b</b>&eacute;</p>c<!-- d --><br>e", kind="text/html"))[0]) == ["abé", "c", "e"]
    assert text_parts("Content-Type: multipart/mixed; boundary=b\n\n--b\n\none\n--bar three four\n--b \n\ntwo\n--b--\n--b\n\nno") in (["two", "one\n--bar three four"], ["one\n--bar three four", "two"])
    for name, read in (("a.yaml", True), ("notes.css", True), ("x.bin", False), ("x", False)):
        assert bool(text_parts(f"Content-Type: application/octet-stream; name={name}\n\nhello")) == read
    assert text_parts("no header at all\nmore") == ["no header at all\nmore"]
    assert text_parts("") == [""] and text_parts("A: b") == [""]
    for cut in range(0, 400, 7):
        text_parts(mail("x " * 300, "base64")[:cut])
    assert words("Ｆull_ｗidth Cаfе́") == ["full", "width", "café"]


def test_found_against_brute_force(spark):
    docs, n = [], 0
    for i, passage in PASSAGES.items():
        w = passage.split()
        for length, start in ((12, 3), (13, 0), (13, 9), (14, 20), (40, 0)):
            piece = w[start : start + length]
            noise = [rng.choice(VOCABULARY) for _ in range(30)]
            at = rng.randrange(30)
            text = " ".join(noise[:at] + piece + noise[at:])
            text = text.replace(" ", "\n> ", 3).replace(" m", "; M") if n % 2 else text
            docs.append((n, mail(text, (None, "base64", "quoted-printable")[n % 3], eol="\r\n" if n % 5 == 0 else "\n")))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "x " * 100_000), (n + 3, docs[1][1]), (None, docs[2][1])]
    items = [*PASSAGES.items(), (90, None), (91, ""), (92, "too short")]
    got = L.leaks(spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, ids string, item_id int"), spark.createDataFrame([(i, p, 0.5) for i, p in items], "item_id long, passage string, cosine double")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["kind"] == "verbatim"} == brute([d for d in docs if d[0] is not None], items)
    assert all(r["cosine"] > 0.999 for r in got if r["kind"] == "verbatim")


def found(spark, docs, items=None, **options):
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list((items or PASSAGES).items()), "item_id long, passage string"), **options)
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in got.collect()}


def test_paraphrase(spark):
    w = PASSAGES[1].split()
    changed = [x if k % 8 < 7 else "other" for k, x in enumerate(w)]
    assert found(spark, [(1, "A: b\n\n" + " ".join(changed)), (2, "A: b\n\n" + " ".join(reversed(w)))]) == {(1, 1): "paraphrase"}


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(list(PASSAGES.items()), "item_id long, passage string")
    assert L.leaks(docs, items).count() == 0
    assert L.leaks(spark.createDataFrame([(1, "A: b\n\nc")], docs.schema), items.limit(0)).count() == 0


def test_product_and_sums(monkeypatch):
    r = np.random.default_rng(0)
    lengths = [5, 1, 64, 30, 64, 64, 9]
    columns, starts = r.integers(0, 20, sum(lengths)).astype(np.int16), np.cumsum([0, *lengths[:-1]])
    right, weight, a = r.standard_normal((20, 4)), r.random(20), np.zeros((len(lengths), 20))
    for row, (first, n) in enumerate(zip(starts, lengths)):
        for c in columns[first : first + n]:
            a[row, c] += weight[c]
    for chunk in (1 << 15, 1, 70):
        monkeypatch.setattr(L, "_CHUNK", chunk)
        assert np.allclose(L._product(columns, starts, right, weight), a.T @ (a @ right), rtol=1e-4)
        assert np.allclose(L._sums(right.astype(np.float32), columns, starts), (a / weight) @ right, rtol=1e-3, atol=1e-4)


def test_space_is_fitted_on_every_part(spark):
    """40 of 40,000 parts hold a word of their own each. As many vectors as columns in use span all of them, if no part is left out."""
    numbers = spark.range(40_000).selectExpr("id as doc_id", "0 as part", "if(id % 1000 = 0, array(-1 - int(id / 1000)), array(0, 1, 1)) as ids")
    used = [0, 1, *range(L.OWN, L.OWN + 40)]
    own = L.latent_space(numbers, [np.array([0], np.int32)], rank=len(used))[used]
    idf = np.log(40_001 / (1 + np.array([39_960, 39_960, *[1] * 40]))) + 1
    assert np.allclose(own @ own.T, np.diag(idf**2), atol=0.02)


def test_windows_at_both_scales():
    """Windows of every part, short and long, against plain loops; long passages come in pieces."""
    r = np.random.default_rng(3)
    space = r.standard_normal((L.OWN + L.OTHERS, 12)).astype(np.float32)
    passages = {7: r.integers(0, 300, 150).astype(np.int32), 9: r.integers(0, 300, 40).astype(np.int32), 11: r.integers(0, 300, 3).astype(np.int32)}
    parts = [r.integers(-50, 300, n).astype(np.int32) for n in (0, 5, 16, 63, 64, 65, 200)] + [np.concatenate([[5], passages[7][21:50], [-3] * 5]).astype(np.int32), passages[11]]
    flat, offsets = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    asked = L._Asked(space, passages)
    part, item, first, cosine = asked.long_windows(flat, offsets, -2.0)
    unit = lambda v: v / np.linalg.norm(v)
    want = {}
    for p, text in enumerate(parts):
        for k in range(0, max(1, -(-len(text) // L.BLOCK) - L.SPAN // L.BLOCK + 1) if len(text) else 0):
            v = unit(space[L._columns(text[k * L.BLOCK : k * L.BLOCK + L.SPAN])].sum(0))
            for j, passage in enumerate(passages.values()):
                for q in range(0, max(1, len(passage) - L.SPAN // 2), L.SPAN // 2):
                    want.setdefault((p, j, k * L.BLOCK), []).append(float(v @ unit(space[L._columns(passage[q : q + L.SPAN])].sum(0))))
    got = {}
    for p, j, f, c in zip(part, item, first, cosine):
        got.setdefault((int(p), int(j), int(f - offsets[p])), []).append(float(c))
    assert got.keys() == want.keys() and all(np.allclose(sorted(got[k]), sorted(want[k]), atol=1e-4) for k in want)
    assert asked.equal_windows(flat, offsets) == {(7, 0)}


def test_common_against_dynamic_programming():
    for _ in range(50):
        a, b = np.array([rng.randrange(-1, 5) for _ in range(rng.randrange(0, 25))], int), np.array([rng.randrange(0, 5) for _ in range(rng.randrange(1, 12))], int)
        run, sub = np.zeros((len(a) + 1, len(b) + 1), int), np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                run[i + 1, j + 1] = run[i, j] + 1 if x == y else 0
                sub[i + 1, j + 1] = sub[i, j] + 1 if x == y else max(sub[i, j + 1], sub[i + 1, j])
        assert L._common(a.tolist(), b.tolist()) == (run.max(), sub[-1, -1])


def changed(words_, how, share, rng):
    """Words replaced by others of the corpus, by unheard ones, moved by one place, or with others put between; numbers stay."""
    out = []
    for w in words_:
        hit = rng.random() < share and not w.strip(".").isdigit()
        if how == "corpus":
            out.append(rng.choice(VOCABULARY) if hit else w)
        elif how == "new":
            out.append(f"new{rng.randrange(10**6)}" if hit else w)
        elif how == "between":
            out += [w, f"far{rng.randrange(10**6)}"] if hit else [w]
        else:
            out.insert(len(out) - (1 if hit and out else 0), w)
    return out


def test_recall_of_rewordings_with_the_defaults(spark):
    """At least 0.9 of what verification accepts is proposed by the cosines, for each way and share of change."""
    rng, docs, ways = random.Random(21), [], {}
    for how in ("corpus", "new", "between", "order"):
        for share in (0.1, 0.2, 0.3, 0.4, 0.5, 1.0 if how in ("between", "order") else 0.45):
            for i, p in PASSAGES.items():
                lead = [rng.choice(VOCABULARY) if k % 3 else f"w{rng.randrange(999)}" for k in range(rng.randrange(90))]
                ways[len(docs)] = (how, share)
                docs.append((len(docs), "A: b\n\n" + " ".join(lead + changed(p.split(), how, share, rng) + lead[::-1])))
    every, got = found(spark, docs, min_cosine=-2.0), found(spark, docs)
    assert got.keys() <= every.keys() and len(every) > 120
    for way in set(ways.values()):
        accepted = {k for k in every if ways[k[0]] == way}
        assert len(accepted & got.keys()) >= 0.9 * len(accepted), way


def test_short_passages_and_spaced_words(spark):
    items = PASSAGES | {50: "five words of its own"}
    docs = [(1, "A: b\n\nhere are five words of its own indeed"), (2, "A: b\n\n" + " ".join(x for w in PASSAGES[2].split() for x in (w, f"far{w}", f"away{w}")))]
    assert found(spark, docs, items) == {(1, 50): "paraphrase", (2, 2): "paraphrase"}


def test_pieces_hold_every_part():
    r = np.random.default_rng(8)
    parts = [r.integers(-9, 99, n).astype(np.int32) for n in (0, 3, 500, 1, 0, 40, 41, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    for most in (1, 60, 10_000):
        for given in (batch, batch.slice(2)):
            got = [(int(d), flat[a:b].tolist()) for b_ in L._pieces(iter([given]), most) for flat, offsets in [L._flat(b_)] for d, a, b in zip(b_.column(0).to_pylist(), offsets, offsets[1:])]
            assert got == [(d, parts[d].tolist()) for d in given.column(0).to_pylist()]
