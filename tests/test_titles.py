import difflib
import random
import time

import pytest

from quillon.functions.legal import likeness, normalize_name
from quillon.operators import titles

WORDS = "quy định về quản lý kho lưu trữ đất đai thuế phí lệ môi trường nước biển rừng giáo dục y tế của bộ tại vùng".split()


def names(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.choice([1, 2, 4, 9, 20, 45]))) for _ in range(n)]


def test_bound_is_sound():
    old, now = names(1, 20), names(2, 40) + ["", "ф" * 70]
    plain = [normalize_name(x) for x in now]
    alphabet, chunks = titles.encode(plain)
    for a in old:
        length = titles.common(normalize_name(a), alphabet, chunks)
        for b, n, got in zip(now, plain, length):
            row = [0] * (len(n) + 1)
            for x in normalize_name(a):
                last = row
                row = [0]
                for j, y in enumerate(n):
                    row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
            assert got == row[-1]
            assert likeness(a, b) <= 2 * got / max(1, len(normalize_name(a)) + len(n)) + 1e-9


def test_no_pair_is_lost(spark, monkeypatch):
    monkeypatch.setattr(titles, "ASKED_BLOCK", 7)
    monkeypatch.setattr(titles, "TITLE_BLOCK", 11)
    old, now = names(3, 25) + ["Bộ luật Hình sự"], names(4, 50) + ["BỘ LUẬT HÌNH SỰ (sửa đổi)", "Bộ luật hình sự", None, " "]
    a = spark.createDataFrame([(f"o{i}", x) for i, x in enumerate(old)], "key string, title string")
    t = spark.createDataFrame([(i, f"n{i}", x) for i, x in enumerate(now)], "key long, number string, title string")
    ratio = {(f"o{i}", j): round(likeness(x, y), 6) for i, x in enumerate(old) for j, y in enumerate(now) if y and y.strip()}
    truth = {k: r for k, r in ratio.items() if r >= 0.5}
    assert {(r.asked, r.meta_id): r.ratio for r in titles.alike(a, t, 0.5).collect()} == truth
    assert truth["o25", 50] >= 0.5 and truth["o25", 51] == 1.0
    got = {(r.asked, r.meta_id): r.ratio for r in titles.alike(a, t, 0.5, 5).collect()}
    for i in range(len(old)):
        order = lambda d: sorted(((-r, j) for (k, j), r in d.items() if k == f"o{i}"))[:5]
        assert order(got) == order(truth)


def test_registered_queries_compare_all_titles(spark, sf):
    import pyarrow.parquet as pq

    from quillon.plans import legal

    read = lambda t, *c: zip(*pq.read_table(f"{sf}/{t}.parquet", columns=list(c)).to_pydict().values())
    now = list(read("document_metadata", "meta_id", "ten_van_ban"))
    truth = {(k, m, round(likeness(x, y), 6)) for k, x in read("document_legacy", "so_hieu", "ten_van_ban") for m, y in now if x and y and likeness(x, y) >= 0.5}
    assert {(r.asked, r.meta_id, r.ratio) for r in legal.fuzzy_ratio(spark, sf).collect()} == truth


def alike_by_difflib(a, plain, least):
    ratios = [round(difflib.SequenceMatcher(None, a, b).ratio(), 6) for b in plain]
    return {i: r for i, r in enumerate(ratios) if r >= least}


@pytest.mark.parametrize("letters", ["ab ", "abcdefghij ", "ab\U00010000é漢"])
@pytest.mark.parametrize("longest", [3, 70, 199, 260])
def test_blocks_of_many_titles_are_those_of_difflib(letters, longest):
    rng = random.Random(f"{letters}{longest}")
    some = lambda: "".join(rng.choices(letters, k=rng.randint(1, longest)))
    asked = [some() for _ in range(4)] + ["zz", "a" * 200, "ab c" * 260]
    plain = [some() for _ in range(15)] + [a[5:60] + a[:9] + "q" for a in asked]
    alphabet, chunks = titles.encode(plain)
    for a in asked:
        for least in (0.1, 0.6):
            place, ratio = titles.alike_in(a, plain, alphabet, chunks, least)
            assert dict(zip(place.tolist(), ratio.tolist())) == alike_by_difflib(a, plain, least)


def test_all_pairs_take_a_part_of_the_time_of_difflib(spark):
    old, now = ([" ".join(random.Random(f"{s}{i}").choices(WORDS, k=30)) for i in range(n)] for s, n in (("old", 25), ("now", 2000)))
    a = spark.createDataFrame([(f"o{i}", x) for i, x in enumerate(old)], "key string, title string")
    t = spark.createDataFrame([(i, f"n{i}", x) for i, x in enumerate(now)], "key long, number string, title string")
    assert titles.alike(a.limit(1), t.limit(1), 0.0).count() == 1  # starts the workers
    began = time.perf_counter()
    found = titles.alike(a, t, 0.5).select("asked", "meta_id").collect()
    took = time.perf_counter() - began
    began = time.perf_counter()
    truth = alike_by_difflib(normalize_name(old[0]), [normalize_name(x) for x in now], 0.5)
    assert {r.meta_id for r in found if r.asked == "o0"} == set(truth)
    assert took < (time.perf_counter() - began) * len(old) / 2


def pairs_by_difflib(a, t, least):
    return sorted((f"o{i}", j, r) for i, x in enumerate(a) for j, r in alike_by_difflib(normalize_name(x), [normalize_name(y) for y in t], least).items())


@pytest.mark.parametrize("letters", ["ab", "abcdefghij ", "ab\U00010000ø漢"])
def test_all_pairs_are_those_of_difflib(spark, monkeypatch, letters):
    monkeypatch.setattr(titles, "TITLE_BLOCK", 20)
    monkeypatch.setattr(titles, "ROWS", 2)
    rng = random.Random(letters)
    some = lambda longest: "x" + "".join(rng.choices(letters, k=rng.randint(1, longest))) + "y"
    old = [some(n) for n in (3, 30, 70, 130, 180, 260, 700)] + ["ab b" * 160, "zz"]
    now = [some(n) for n in (3, 30, 70, 130, 190, 190, 260, 700)] + [x[5:60] + x[:9] + "q" for x in old] + [x[:120] + "b" * 40 + x[125:150] for x in old for _ in range(8)]
    old, now = old + old[:3], now + now[:9] * 5
    a = spark.createDataFrame([(f"o{i}", x) for i, x in enumerate(old)], "key string, title string")
    t = spark.createDataFrame([(i, None, x) for i, x in enumerate(now)], "key long, number string, title string")
    for least in (0.1, 0.5, 0.8):
        got = titles.alike(a, t, least).collect()
        assert sorted((r.asked, r.meta_id, r.ratio) for r in got) == pairs_by_difflib(old, now, least)


def test_repeated_titles_are_compared_once(spark):
    old, now = ([" ".join(random.Random(f"{s}{i}").choices(WORDS, k=30)) for i in range(n)] for s, n in (("old", 20), ("now", 100)))
    a = spark.createDataFrame([(f"o{i}", x) for i, x in enumerate(old * 20)], "key string, title string")
    t = spark.createDataFrame([(i, f"n{i}", x) for i, x in enumerate(now * 60)], "key long, number string, title string")
    assert titles.alike(a.limit(1), t.limit(1), 0.0).count() == 1  # starts the workers
    began = time.perf_counter()
    found = titles.alike(a, t, 0.5).groupBy("asked").count().collect()
    took = time.perf_counter() - began
    began = time.perf_counter()
    truth = pairs_by_difflib(old, now, 0.5)
    once = time.perf_counter() - began
    assert sum(r["count"] for r in found) == len(truth) * 20 * 60
    assert took < once * 20 * 60 / 200
