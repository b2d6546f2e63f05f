import os

import numpy as np
import pytest

from quillon.llm.bpe import DEFAULT_VOCABULARY
from quillon.llm.mixing import Mixture, rake, rake_cells

DOCS = "doc_id long, text string, lang string, source string, loai string, copies int, m double"
TARGET = "source string, weight double, max_repeats int"


def test_rake_meets_source_margins_within_caps():
    keys = [(s, x, t) for s in "abc" for x in ("vi", "en") for t in ("luat", "other")]
    tokens = np.random.default_rng(0).integers(100, 10_000, len(keys)).astype(float)
    weights, caps = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 4}
    m, total = rake(tokens, keys, weights, caps)
    for s in weights:
        here = np.array([k[0] == s for k in keys])
        assert (tokens[here] * m[here]).sum() == pytest.approx(total * weights[s], rel=1e-6)
        assert m[here].max() <= caps[s] + 1e-9


def test_rake_without_anything():
    assert rake(np.zeros(0), [], {"a": 1.0}, {"a": 1})[1] == 0
    assert rake(np.array([5.0]), [("x", "vi", "luat")], {"a": 1.0}, {"a": 1})[0].tolist() == [0]


def test_a_source_without_repeats_is_left_out():
    keys = [("a", "vi", "luat"), ("b", "vi", "luat")]
    m, total = rake(np.array([100.0, 300.0]), keys, {"a": 0.5, "b": 0.5}, {"a": 4, "b": 0})
    assert total == 400 and m.tolist() == [4.0, 0.0]


def test_margins_are_reported_and_can_be_set():
    keys = [(s, x, "luat") for s in "ab" for x in ("vi", "en")]
    tokens = np.array([600.0, 400.0, 700.0, 300.0])
    _, _, own = rake_cells(tokens, keys, {"a": 0.5, "b": 0.5}, {"a": 4, "b": 4})
    assert [(x[:2], round(x[2], 3), round(x[3], 3)) for x in own] == [(("language", "en"), 0.35, 0.35), (("language", "vi"), 0.65, 0.65), (("topic", "luat"), 1.0, 1.0)]
    _, _, tied = rake_cells(tokens, keys, {"a": 0.5, "b": 0.5}, {"a": 8, "b": 8}, {"language": {"en": 0.5}})
    assert {x[1]: round(x[3], 3) for x in tied}["en"] == 0.35  # all rows are taken as often as allowed, so nothing can move: the report says so
    keys, tokens = [*keys, ("c", "vi", "luat"), ("c", "en", "luat")], np.array([600.0, 400.0, 700.0, 300.0, 50.0, 50.0])
    m, _, half = rake_cells(tokens, keys, {"a": 0.45, "b": 0.45, "c": 0.1}, {"a": 8, "b": 8, "c": 1}, {"language": {"en": 0.5}})
    assert {x[1]: x[3] for x in half}["en"] == pytest.approx(0.5, abs=0.02) and m[1] > m[0]


@pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no public vocabulary here")
class TestMixture:
    def rows(self):
        rows, k = [], 0
        for source, n in (("big", 900), ("small", 60), ("unnamed", 50), (None, 20), (" big", 20)):
            for i in range(n):
                k += 1
                rows.append((k, f"văn bản số {i} " * (1 + i % 30), ("vi", "en", None, "VI")[i % 4], source, ("luat", None, "")[i % 3], 1, 0.5))
        rows += [(9001, None, "vi", "big", "luat", 0, 0.0), (9002, "", "vi", "big", "luat", 0, 0.0)]
        return rows

    def test_shares_and_caps(self, spark):
        docs = spark.createDataFrame(self.rows(), DOCS)
        target = spark.createDataFrame([("big", 0.7, 1), ("small", 0.25, 3), ("absent", 0.05, 2)], TARGET)
        mix = Mixture(docs, target)
        shares = {r.source: r for r in mix.shares().collect()}
        assert shares["absent"].share == 0 and shares["absent"].rows_taken == 0
        assert shares["big"].share == pytest.approx(0.7 / 0.95, rel=0.01) and shares["small"].share == pytest.approx(0.25 / 0.95, rel=0.01)
        rows = mix.rows().collect()
        assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small"}
        assert max(r.copies for r in rows if r.source == "small") <= 3 and max(r.copies for r in rows if r.source == "big") == 1
        again = {(r.doc_id, r.copies) for r in Mixture(docs.repartition(7), target).rows().collect()}
        assert again == {(r.doc_id, r.copies) for r in rows}

    def test_odd_targets(self, spark):
        docs = spark.createDataFrame(self.rows(), DOCS)
        target = spark.createDataFrame([("big", 0.4, 1), ("big", 0.3, None), ("small", 0.3, 3), ("unnamed", None, 2), (None, 0.5, 1), ("x", -1.0, -2)], TARGET)
        mix = Mixture(docs, target)
        shares = {r.source: r for r in mix.shares().collect()}
        assert set(shares) == {"big", "small", "unnamed", "x"} and shares["unnamed"].share == 0
        assert shares["big"].share == pytest.approx(0.7, rel=0.02)
        assert {r.axis for r in mix.margins().collect()} == {"language", "topic"}

    def test_empty_tables(self, spark):
        docs, target = spark.createDataFrame([], DOCS), spark.createDataFrame([("big", 1.0, 1)], TARGET)
        mix = Mixture(docs, target)
        assert mix.rows().count() == 0 and [r.share for r in mix.shares().collect()] == [0.0]
        assert Mixture(spark.createDataFrame(self.rows(), DOCS), target.where("false")).rows().count() == 0
