import random

import numpy as np

from sonarloom.llm import overlaps as O

SCHEMA = "file_id string, split string, genre_sub string, excerpt_md5 string, carries_signal boolean, excerpt_levels array<float>, side string, class long"


def brute(rows):
    out = set()
    for f, s, _, m, ok, x, *_ in rows:
        for f2, s2, _, m2, ok2, y, *_ in rows:
            if not (ok and ok2 and f and f2) or f == f2 or (s or "").strip().lower() not in ("val", "test") or (s2 or "").strip().lower() != "train":
                continue
            same = bool(m and m2 and m.strip() and m.strip().lower() == m2.strip().lower())
            close = False
            if x and y and len(x) == len(y) == 24:
                with np.errstate(invalid="ignore"):
                    d = [float(np.float32(a)) - float(np.float32(b)) for a, b in zip(x, y) if a is not None and b is not None]
                d = [v for v in d if np.isfinite(v)]
                close = any(sum(abs(v - g - 0.5) <= 0.5 + 1e-9 for v in d) >= 20 for g in d)
            if same or close:
                out.add((min(f, f2), max(f, f2)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    bases = [[rng.gauss(-30, 6) for _ in range(24)] for _ in range(12)]
    for k, base in enumerate(bases):
        rows.append((f"t{k}", rng.choice(["train", " TRAIN"]), "g", f"H{k % 9}", True, base))
        for bad in range(0, 7):
            y = [v + 3.0 * rng.random() // 1 + rng.uniform(-0.49, 0.49) * (bad > 0) for v in base] if bad == 6 else [v + 2.5 + rng.uniform(-0.49, 0.49) for v in base]
            for i in rng.sample(range(24), bad):
                y[i] += rng.choice([-1, 1]) * rng.uniform(1.2, 9)
            rows.append((f"e{n}", rng.choice(["val", "Test "]), rng.choice(["a", "b", None]), rng.choice([None, "", f"h{n}", f"h{k}"]), True, y))
            n += 1
    edge = [float(i) for i in range(24)]
    rows += [
        ("edge", "train", None, None, True, edge), ("near", "test", None, None, True, [v + (i % 2) for i, v in enumerate(edge)]), ("over", "test", None, None, True, [v + 1.01 * (i % 2) for i, v in enumerate(edge)]),
        ("nan", "test", "g", None, True, [float("nan"), None, float("-inf"), 4.0, *edge[4:]]), ("nan5", "test", "g", None, True, [float("nan")] * 5 + edge[5:]),
        ("short", "test", "g", None, True, edge[:20]), ("none", "test", "g", None, True, None), ("mute", "test", "g", "h1", False, edge), ("unsure", "val", "g", "h1", None, edge), ("both", "val", "g", "h1", True, edge), ("both", "train", "g", "h1", True, edge),
        (None, "val", "g", "h1", True, edge), ("odd", "dev", "g", "h1", True, edge), ("lost", None, "g", "h1", True, edge),
    ]
    rows += rows[:9]
    full = [(*r, "clash", 1) for r in rows]
    got = O.cross_split_overlaps(spark.createDataFrame(full, SCHEMA))
    assert {(r["file_id_a"], r["file_id_b"]) for r in got.collect()} == brute(rows)
    assert ("edge", "near") in brute(rows) and ("edge", "over") not in brute(rows)


def test_hot_buckets_and_copies(spark, monkeypatch):
    """Buckets crowded on either side or both, and copies that hold half of all rows: the same pairs."""
    monkeypatch.setattr(O, "HOT", 3)
    monkeypatch.setattr("sonarloom.operators.skew.LEAST", 4)
    rng = random.Random(9)
    base = [rng.gauss(-30, 6) for _ in range(24)]
    for trains, evals in ((20, 20), (2, 40), (40, 2)):
        rows = [(f"{s[0]}{i}", s, "g", f"h{i % 2}", True, [v + rng.uniform(-0.2, 0.2) for v in base] if i % 2 else base, "", 0) for s, n in (("train", trains), ("val", evals)) for i in range(n)]
        got = O.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == len({(r["file_id_a"], r["file_id_b"]) for r in got}) == trains * evals
        assert sum(r["same"] for r in got) == trains * evals / 2


def test_cells_beyond_the_range(spark):
    """Steps of hundreds of dB share the outermost cells and are still found."""
    base = [0.0, -500.0, 900.0, 0.0, 700.0] * 4 + [1.0, 2.0, 3.0, 4.0]
    rows = [("t", "train", "g", None, True, base, "", 0), ("e", "val", "g", None, True, [v + 7.25 for v in base], "", 0)]
    assert O.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).count() == 1


def test_empty(spark):
    assert O.cross_split_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0
